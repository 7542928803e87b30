"""Column expressions for disclosure text: decoding, markup, lines, chunks, company names, labelled fields."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..session import ship

SPACE = r"(?U)\s"


def strip(c: Column) -> Column:
    """Without white space of any script at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def let(value: Column, body) -> Column:
    """body(value), with value worked out once; in nested functions Spark would work it out at each mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines(text: Column) -> Column:
    """Lines at any line break; a last empty piece is none."""
    cut = F.split(text, "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]")
    whole = let(cut, lambda c: F.when(F.element_at(c, -1) == "", F.slice(c, 1, F.size(c) - 1)).otherwise(c))
    return F.when(text.isNull() | (text == ""), F.array().cast("array<string>")).otherwise(whole)


# --- bytes and markup ---


@F.pandas_udf(StringType())
def _cp949(raw: pd.Series) -> pd.Series:
    def one(b):
        if b is None:
            return None
        try:
            return bytes(b).decode("cp949")
        except UnicodeDecodeError:
            return bytes(b).decode("utf-8", "replace")

    return raw.map(one)


def decode_bytes(raw: Column) -> Column:
    """UTF-8 where valid, else cp949, else UTF-8 with replacement signs. Python runs for invalid UTF-8 only."""
    ship()
    valid = F.is_valid_utf8(raw.cast("binary").cast("string"))
    return F.when(valid, raw.cast("string")).otherwise(_cp949(F.when(~valid, raw)))


# Named entities resolved without Python.
ENTITIES = {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#39;": "'", "&copy;": "©", "&middot;": "·", "&reg;": "®", "&hellip;": "…", "&ndash;": "–", "&mdash;": "—", "&euro;": "€"}


@F.pandas_udf(StringType())
def _unescape(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else html.unescape(x))


def unescape(text: Column) -> Column:
    """HTML entities: the common ones in the JVM, a text with others as a whole in Python."""
    ship()
    out = text
    for name, sign in ENTITIES.items():
        out = F.replace(out, F.lit(name), F.lit(sign))
    plain = F.replace(out, F.lit("&amp;"), F.lit("&"))
    known = "|".join(k[1:-1] for k in ENTITIES)
    other = text.rlike(rf"&(?!(?:{known}|amp);)(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#[xX][0-9a-fA-F]+);?") | text.rlike(r"&amp;(?:[A-Za-z#])")
    return F.when(~other, plain).otherwise(_unescape(F.when(other, text)))


# The entities of pages; the ampersand comes last, so that nothing is resolved twice.
PAGE_ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&nbsp;": "\u00a0", "&copy;": "©", "&middot;": "·", "&amp;": "&"}
#: The blanks (Unicode Zs) that SQL's trim takes off; no tabs or line breaks.
BLANKS = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def strip_markup(text: Column, entities: dict[str, str] | None = None) -> Column:
    """Text of a marked-up document: no style, script or head, no comments; tags end lines; entities resolved; blank lines dropped.

    Without `entities` all of HTML's are resolved, those cut off before the semicolon too, and blanks of any kind count. With them it is as SQL
    has it: only these are resolved, in their order; style goes first, then script, then head; only blanks and tabs are squeezed, only BLANKS trimmed."""
    if entities is None:
        t = F.regexp_replace(text, r"(?is)<(style|script|head)\b[^>]*>.*?</\1\s*>", " ")
    else:
        t = text
        for name in ("[sſ]tyle", "[sſ]cript", "head"):  # RE2 folds ſ to s; its word and space characters are ASCII, without \v
            t = F.regexp_replace(t, rf"(?is)<{name}(?![0-9A-Za-z_])[^>]*>.*?</{name}[ \t\n\f\r]*>", " ")
    t = F.regexp_replace(t, r"(?s)<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?s)<[^>]+>", "\n")
    if entities is None:
        t, trim = F.regexp_replace(unescape(t), "[ \t 　]+", " "), strip
    else:
        for name, sign in entities.items():
            t = F.replace(t, F.lit(name), F.lit(sign))
        t, trim = F.regexp_replace(t, "[ \t]+", " "), lambda x: F.btrim(x, F.lit(BLANKS))
    kept = F.filter(F.transform(F.split(t, "\n"), trim), lambda x: x != "")
    return F.array_join(kept, "\n")


# --- chunks ---


def chunks(text: Column, most: int = 800, overlap: int = 100) -> Column:
    """Arrays of whole lines, joined: a chunk ends before the line that would make it longer than `most` characters, and the next one begins with so many of its last lines as have `overlap` characters. Line breaks don't count."""
    kept = F.filter(F.transform(F.split(F.regexp_replace(text, "[ \t]+", " "), "\n"), strip), lambda x: x != "")
    chars = lambda ls: F.aggregate(ls, F.lit(0), lambda n, x: n + F.length(x))
    empty = F.array().cast("array<string>")

    def tail(ls: Column) -> Column:
        """Last lines until they have `overlap` characters."""
        zero = F.struct(empty.alias("keep"), F.lit(0).alias("n"))
        step = lambda s, x: F.when(s["n"] >= overlap, s).otherwise(F.struct(F.array_prepend(s["keep"], x).alias("keep"), (s["n"] + F.length(x)).alias("n")))
        return F.aggregate(F.reverse(ls), zero, step, lambda s: s["keep"])

    def add(s: Column, x: Column) -> Column:
        full = (chars(s["open"]) + F.length(x) > most) & (F.size(s["open"]) > 0)
        rest = tail(s["open"])
        return F.when(full, F.struct(F.array_append(s["done"], F.array_join(s["open"], "\n")).alias("done"), F.array_append(rest, x).alias("open"))).otherwise(F.struct(s["done"].alias("done"), F.array_append(s["open"], x).alias("open")))

    return F.aggregate(kept, F.struct(empty.alias("done"), empty.alias("open")), add, lambda s: F.when(F.size(s["open"]) > 0, F.array_append(s["done"], F.array_join(s["open"], "\n"))).otherwise(s["done"]))


# --- company names ---

# Legal forms before and after a name.
LEGAL_BEFORE = ["주식회사", "㈜", r"\(주\)", r"\(유\)", "유한회사", "재단법인", "사단법인"]
LEGAL_AFTER = [
    "주식회사", "㈜", r"\(주\)", r"\(유\)", "유한회사", "Incorporated", r"Inc\.?", "Corporation", r"Corp\.?", r"Co\.?,?\s*Ltd\.?", "Limited", r"Ltd\.?", "LLC", r"L\.L\.C\.?",
    "GmbH", r"S\.A\.S", r"S\.A\.", r"B\.V\.", r"N\.V\.", r"Pte\.?\s*Ltd\.?", r"Zrt\.?",
]

def canonical_name(raw: Column) -> Column:
    """A company's name without its legal forms and its Latin reading in brackets, peeled until nothing more comes off; the name itself if nothing would be left.

    Every layer takes a character at least, so there are no more layers than characters; once one takes nothing, the rest are skipped."""
    base = squeeze(F.coalesce(raw, F.lit("")))

    def peel(name: Column) -> Column:
        name = strip(F.regexp_replace(name, r"(?U)\s*\(([^()]*[A-Za-z][^()]*)\)\s*$", ""))
        name = strip(F.regexp_replace(name, rf"(?iuU)\s*({'|'.join(LEGAL_AFTER)})\s*[.,]?\s*$", ""))
        name = strip(F.regexp_replace(name, rf"(?U)^\s*({'|'.join(LEGAL_BEFORE)})\s*", ""))
        return F.regexp_replace(name, r"^[ ,;·]+|[ ,;·]+$", "")

    def layer(s: Column, _: Column) -> Column:
        return F.when(s["stop"], s).otherwise(let(peel(s["name"]), lambda n: F.struct(n.alias("name"), (n == s["name"]).alias("stop"))))

    def peeled(b: Column) -> Column:
        start = F.struct(b.alias("name"), (b == "").alias("stop"))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(b))), start, layer, lambda s: F.when(s["name"] == "", b).otherwise(s["name"]))

    return let(base, peeled)


def match_key(name: Column) -> Column:
    """What two spellings of a name have in common: lower case, no blanks, brackets, dots, commas or middle dots."""
    return F.lower(F.regexp_replace(canonical_name(name), r"(?U)[\s()·,.]+", ""))


# --- labelled fields of fixed forms; documents are arrays of lines ---

# What stands for no value, and labels that are never values.
NO_VALUE = ["", "-", "해당없음", "없음", "N/A"]
LABELS = [
    "성명", "생년월일", "생년월일 또는 사업자등록번호", "성별", "국내외 구분", "국적", "최대주주 및 발행회사와의 관계", "겸직내용1", "겸직내용2", "변경일", "변경원인", "주식의 종류",
    "변경전주식수", "증감주식수", "변경후주식수", "비고", "최근 매출액(원)", "최근매출액(원)", "주요사업", "회사와의 관계", "회사와 관계", "매출액대비(%)", "매출액 대비(%)",
    "자기자본(원)", "자기자본대비(%)", "회사와 최근 3년간 동종계약 이행여부", "대규모법인여부", "대기업해당여부",
]


def label_form(line: Column) -> Column:
    """A line as labels are compared: without its number and leading hyphens, blanks squeezed."""
    bare = F.regexp_replace(strip(line), r"(?U)^\d+\s*\.\s*", "")
    return squeeze(F.regexp_replace(bare, "^-+", ""))


def labelled(ls: Column) -> Column:
    """[(i, line, form, raw, value)] of all lines, i from 1: raw is the next line unless it stands for no value, value the same unless it is a label.

    Made once for a document and handed to the functions below, which then only look at it."""
    formed = F.transform(ls, lambda x: F.struct(strip(x).alias("line"), label_form(x).alias("form")))

    def entry(all_: Column, x: Column, k: Column) -> Column:
        return let(F.get(all_, k + 1), lambda after: F.struct((k + 1).alias("i"), x["line"].alias("line"), x["form"].alias("form"), F.when(is_value(after["line"]), after["line"]).alias("raw"), F.when(is_value(after["line"]) & ~after["form"].isin(*LABELS), after["line"]).alias("value")))

    return let(formed, lambda all_: F.transform(all_, lambda x, k: entry(all_, x, k)))


def first_at(doc: Column, *forms: str) -> Column:
    """Number of the first line that is one of the labels; null without one."""
    return F.get(F.filter(doc, lambda x: x["form"].isin(*forms)), F.lit(0))["i"]


def line_at(doc: Column, i: Column) -> Column:
    return F.get(doc, i - 1)["line"]


def is_value(x: Column) -> Column:
    return x.isNotNull() & ~x.isin(*NO_VALUE)


def field(doc: Column, *labels: str, after: str | None = None) -> Column:
    """The line after a label; labels are tried in the order given, from the section label `after` on. Labels and signs for no value are not values."""

    def tried(start: Column | None) -> Column:
        own = lambda label: F.get(F.filter(doc, lambda x: (x["form"] == label) if start is None else (x["form"] == label) & (x["i"] >= start)), F.lit(0))["value"]
        return F.coalesce(*map(own, labels))

    return let(first_at(doc, after), tried) if after else tried(None)


def money(raw: Column) -> Column:
    """All digits as one whole number; signs and points are lost."""
    return F.nullif(F.regexp_replace(raw, r"[^0-9]", ""), F.lit("")).try_cast("decimal(38,0)")


def percent(raw: Column) -> Column:
    return F.nullif(F.regexp_extract(F.replace(raw, F.lit(",")), r"-?\d+(\.\d+)?", 0), F.lit("")).try_cast("double")


def iso_date(raw: Column) -> Column:
    """First yyyy mm dd, with or without separators, as yyyy-mm-dd; the calendar isn't asked."""
    found = F.regexp_extract(raw, r"\d{4}[-.\s/]?\d{2}[-.\s/]?\d{2}", 0)
    return F.nullif(F.regexp_replace(found, r"^(\d{4})[-.\s/]?(\d{2})[-.\s/]?(\d{2})$", "$1-$2-$3"), F.lit(""))


def clean_name(raw: Column) -> Column:
    x = strip(raw)
    return F.when(is_value(x), x)


def strip_trailing_paren(name: Column) -> Column:
    return F.nullif(strip(F.regexp_replace(name, r"(?U)\s*\([^()]*\)\s*$", "")), F.lit(""))


def section_end(doc: Column, start: Column) -> Column:
    """Number of the first line after start that heads a numbered section; else one after the last."""
    head = F.get(F.filter(doc, lambda x: (x["i"] > start) & x["line"].rlike(r"(?U)^\d+\s*\.\s+\S")), F.lit(0))["i"]
    return F.coalesce(head, F.size(doc) + 1)


# How corrections and filings for a subsidiary begin.
CORRECTION_HEAD, CORRECTED_TITLE = "정정신고(보고)", "정정관련 공시서류"
SUBSIDIARY_INTRO, SUBSIDIARY_TAIL, SUBSIDIARY_DEPTH = ("자회사인", "종속회사인"), "의 ", 12


def body_start(doc: Column) -> Column:
    """Where a correction's corrected body begins: the second line that is its title; 1 in other filings."""
    second = let(field(doc, CORRECTED_TITLE), lambda title: F.get(F.filter(doc, lambda x: x["line"] == title), F.lit(1))["i"])
    return F.when(F.get(doc, F.lit(0))["form"] == CORRECTION_HEAD, F.coalesce(second, F.lit(1))).otherwise(1)


def subsidiary_name(doc: Column) -> Column:
    """The subsidiary a filing is made for: within two lines after an introduction near the top."""
    intros = F.filter(F.slice(doc, 1, SUBSIDIARY_DEPTH), lambda x: x["form"].isin(*SUBSIDIARY_INTRO))

    def name(x: Column) -> Column:
        def pick(one: Column, two: Column) -> Column:
            second = F.when(is_value(two) & ~two.startswith(SUBSIDIARY_TAIL), two)
            return F.when(is_value(one), F.when(~one.startswith(SUBSIDIARY_TAIL), one)).otherwise(second)

        return pick(x["raw"], F.when(line_at(doc, x["i"] + 1).isNotNull(), line_at(doc, x["i"] + 2)))

    return F.get(F.array_compact(F.transform(intros, name)), F.lit(0))


# Legal forms that a comma may cut off a name.
FRAGMENT = r"(?iu)^\s*(Ltd|Inc|lnc|LLC|Corp|Co|GmbH|Pte|Zrt|S\.?A|B\.?V|N\.?V)\b\.?\s*(\([^()]*\))?[.,)\s]*$"


def split_companies(raw: Column) -> Column:
    """Names in a list: cut at commas outside brackets; a piece that is a mere legal form belongs to the name before it.

    The text is cut at all commas, and a piece is put to the one before it while that one has open brackets."""
    empty = F.array().cast("array<string>")
    zero = F.struct(empty.alias("parts"), F.lit(0).alias("depth"))
    # what is left of a piece's brackets: closing ones that nothing in the piece opened, then opening ones
    sign = lambda n, c: F.when(c.isin("(", "["), n + 1).when(c.isin(")", "]"), F.greatest(F.lit(0), n - 1)).otherwise(n)
    after = lambda depth, piece: F.aggregate(F.regexp_extract_all(piece, F.lit(r"[()\[\]]"), F.lit(0)), depth, sign)
    joined = lambda parts, x: F.array_append(F.slice(parts, 1, F.size(parts) - 1), F.concat(F.element_at(parts, -1), F.lit(","), x))
    step = lambda s, x: F.struct(F.when(s["depth"] > 0, joined(s["parts"], x)).otherwise(F.array_append(s["parts"], x)).alias("parts"), after(s["depth"], x).alias("depth"))
    pieces = F.aggregate(F.split(F.coalesce(raw, F.lit("")), ","), zero, step, lambda s: s["parts"])

    def glue(names: Column, x: Column) -> Column:
        joined = F.array_append(F.slice(names, 1, F.size(names) - 1), F.concat(F.element_at(names, -1), F.lit(", "), strip(x)))
        return F.when((F.size(names) > 0) & x.rlike(FRAGMENT), joined).otherwise(F.array_append(names, x))

    return F.array_compact(F.transform(F.aggregate(pieces, empty, glue), lambda x: strip_trailing_paren(clean_name(x))))


# --- evidence and output ---


def evidence_window(text: Column, names: Column, around: int = 400, fallback: int = 800) -> Column:
    """Struct (text, found): the surroundings of each name's first place, overlapping ones merged, joined by ' […] '; else the text's beginning."""
    flat = squeeze(F.coalesce(text, F.lit("")))
    spans = F.filter(F.transform(names, lambda n: F.struct(F.greatest(F.lit(1), F.position(n, flat) - around).alias("a"), F.position(n, flat).alias("at"), F.length(n).alias("n"))), lambda s: s["at"] > 0)
    spans = F.array_sort(F.transform(spans, lambda s: F.struct(s["a"], F.least(F.length(flat) + 1, s["at"] + s["n"] + around).alias("b"))))
    none = F.array().cast("array<struct<a:int,b:int>>")
    merge = lambda done, s: F.when((F.size(done) > 0) & (F.element_at(done, -1)["b"] >= s["a"]), F.array_append(F.slice(done, 1, F.size(done) - 1), F.struct(F.element_at(done, -1)["a"].alias("a"), F.greatest(F.element_at(done, -1)["b"], s["b"]).alias("b")))).otherwise(F.array_append(done, s))
    merged = F.aggregate(spans, none, merge)
    shown = F.array_join(F.transform(merged, lambda s: F.substring(flat, s["a"], s["b"] - s["a"])), " […] ")
    return F.when(F.size(spans) > 0, F.struct(shown.alias("text"), F.lit(True).alias("found"))).otherwise(F.struct(F.substring(flat, 1, fallback).alias("text"), F.lit(False).alias("found")))


def shorten(text: Column, most: int = 400) -> Column:
    return F.substring(squeeze(text), 1, most)


def zip_strict(a: Column, b: Column, names: tuple[str, str]) -> Column:
    """Pairs of two arrays; arrays of different sizes are an error."""
    return F.when(F.size(a) == F.size(b), F.arrays_zip(a.alias(names[0]), b.alias(names[1]))).when(a.isNotNull() & b.isNotNull(), F.raise_error(F.concat(F.lit("arrays of "), F.size(a), F.lit(" and "), F.size(b), F.lit(" values"))))


def dashed_date(yyyymmdd: Column) -> Column:
    return F.concat_ws("-", F.substring(yyyymmdd, 1, 4), F.substring(yyyymmdd, 5, 2), F.substring(yyyymmdd, 7, 2))


def price_line(date: Column, close: Column, volume: Column, change: Column) -> Column:
    """One line of a price list."""
    moved = F.when(change.isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), F.when(change > 0, "+").otherwise(""), F.format_string("%.2f", change), F.lit("%)")))
    return F.concat(date.cast("string"), F.lit("  close "), F.format_number(close, 0), moved, F.lit("  volume "), F.format_number(volume, 0))


def code6(code: Column) -> Column:
    """Security codes have six digits; shorter ones get zeros in front."""
    return F.when(F.length(code) < 6, F.lpad(code, 6, "0")).otherwise(code)
