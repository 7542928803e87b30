"""Text expressions and form parsers against plain Python and hand-made documents."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quillstrata.functions import text as X
from quillstrata.operators import forms


def one(spark, value, expr, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "name"),
    [("(주)가온", "가온"), ("주식회사 가온", "가온"), ("가온㈜", "가온"), ("Gaon Co., Ltd.", "Gaon"), ("가온 (GAON Inc.)", "가온"), ("가온 주식회사 (Gaon Corp.)", "가온"), ("Ltd", "Ltd"), ("  ", ""), ("가온(미주)", "가온(미주)"), ("가온에너지 Ohio, LLC", "가온에너지 Ohio")],
)
def test_canonical_name(spark, raw, name):
    assert one(spark, raw, X.canonical_name) == name
    assert one(spark, name, X.canonical_name) == name


def plain_chunks(text, most, overlap):
    lines = [x.strip() for x in re.sub(r"[ \t]+", " ", text).split("\n")]
    out, held = [], []
    for line in filter(None, lines):
        if held and sum(map(len, held)) + len(line) > most:
            out.append("\n".join(held))
            back = []
            for x in reversed(held):
                if sum(map(len, back)) >= overlap:
                    break
                back.insert(0, x)
            held = back
        held.append(line)
    return out + (["\n".join(held)] if held else [])


def test_chunks_equal_a_plain_loop(spark):
    rng = random.Random(5)
    texts = ["\n".join("w" * rng.randint(0, 60) for _ in range(rng.randint(0, 60))) for _ in range(40)] + ["", "\n \n", "x" * 2000]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string").select("k", X.chunks(F.col("t"), 200, 50).alias("c"))
    assert {r["k"]: r["c"] for r in df.collect()} == {k: plain_chunks(t, 200, 50) for k, t in enumerate(texts)}


@pytest.mark.parametrize(("raw", "value"), [("90,960,000", 90960000), ("1.5", 15), ("-", None), ("", None), (None, None)])
def test_money(spark, raw, value):
    got = one(spark, raw, X.money)
    assert (None if got is None else int(got)) == value


@pytest.mark.parametrize(("raw", "value"), [("12.5%", 12.5), ("-3", -3.0), ("1,234.5", 1234.5), ("none", None)])
def test_percent(spark, raw, value):
    assert one(spark, raw, X.percent) == value


@pytest.mark.parametrize(("raw", "value"), [("2026.07.01", "2026-07-01"), ("20260701", "2026-07-01"), ("on 2026-07-01.", "2026-07-01"), ("July", None)])
def test_date(spark, raw, value):
    assert one(spark, raw, X.iso_date) == value


@pytest.mark.parametrize(("raw", "names"), [("가(중국), 나(미국)", ["가", "나"]), ("New Energy Co., Ltd, 나", ["New Energy Co., Ltd", "나"]), ("-", []), (None, []), ("가[a,b], 나", ["가[a,b]", "나"])])
def test_split_companies(spark, raw, names):
    assert one(spark, raw, X.split_companies) == names


def test_markup(spark):
    raw = "<html><head><title>t</title></head><style>p{}</style><p>a &amp; b&nbsp;c</p><!-- x\ny --><td>&eacute;</td>\n\n<br>  z <script>1<2</script></html>"
    assert one(spark, raw, X.strip_markup) == "a & b c\né\nz"
    assert one(spark, None, X.strip_markup) is None


def test_pages_equal_their_sql(spark, tmp_path):
    """Cut-off, nested and unknown entities, other blanks and line ends, blocks in blocks, odd tag names."""
    import duckdb

    from quillstrata.plans.registry import ORACLES, QUERIES

    rng = random.Random(11)
    parts = [
        "<style>", "</style>", "<script x>", "</script >", "</script\x0b>", "<head>", "</head\n>", "<STYLE\n>", "<ſtyle>", "<styleé>", "<styles>", "<header>", "<!--", "-->", "<p>", "<", ">", "<>", "a", "b c", "é", "\n", "\r\n", "\r", "\t", " ", "  ", "\f", "\x0b",
        "\x85", "\u2028", "\u00a0", "\u3000", "\u200b", "&amp", "&amp;", "&lt;", "&lt", "&gt;", "&quot;", "&nbsp;", "&copy;", "&copy", "&middot;", "&apos;", "&eacute;", "&#39;", "&#x41;", "amp;", "lt;", "&", "$1", "\\1", "한",
    ]
    pages = ["<title>x and&amp</title>", "", None, " \n ", *("".join(rng.choices(parts, k=rng.randint(1, 40))) for _ in range(3000))]
    spark.createDataFrame(list(enumerate(pages)), "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    got = {r["page_id"]: r["body"] for r in QUERIES["strip_markup"](spark, str(tmp_path)).collect()}
    assert got[0] == "x and&amp" and got == dict(c.execute(ORACLES["strip_markup"]).fetchall())


def test_decode(spark):
    rows = [(b"plain",), ("한글".encode(),), ("한글".encode("cp949"),), (b"\xff\xff",), (None,)]
    got = [r[0] for r in spark.createDataFrame(rows, "b binary").select(X.decode_bytes(F.col("b"))).collect()]
    assert got == ["plain", "한글", "한글", "��", None]


def parse(spark, report, text, filer="가온"):
    rows = forms.parse_filings(spark.createDataFrame([(filer, report, text)], "corp_name string, report_nm string, doc_text string")).orderBy("seq").collect()
    return [(r["subject"], r["predicate"], r["object"], r["amount_krw"] and int(r["amount_krw"]), r["ratio_pct"], r["start_date"], r["end_date"], r["note"]) for r in rows]


def test_supply(spark):
    text = "2. 계약금액(원)\n1,000\n3. 계약상대\n나래㈜\n-회사와의 관계\n-\n5. 계약기간\n시작일\n2026-01-02\n종료일\n2026-03-04"
    assert parse(spark, "단일판매ㆍ공급계약체결", text) == [("가온", "SUPPLIES_TO", "나래㈜", 1000, None, "2026-01-02", "2026-03-04", None)]
    assert parse(spark, "단일판매ㆍ공급계약해지", text) == []
    assert parse(spark, "단일판매ㆍ공급계약체결", "계약상대\n회사와의 관계\n나래\n협력사") == []
    assert parse(spark, "주주총회소집결의", text) == []
    assert parse(spark, "단일판매ㆍ공급계약체결", text, filer=" ") == []


def test_stake(spark):
    text = "1. 발행회사\n회사명(국적)\n다솜 (대한민국)\n2. 취득내역\n취득금액(원)\n500\n자기자본대비(%)\n7.5\n3. 취득후 소유주식수 및 지분비율\n지분비율(%)\n30\n취득예정일자\n20260505"
    assert parse(spark, "타법인주식및출자증권취득결정", text) == [("가온", "INVESTS_IN", "다솜", 500, 7.5, "2026-05-05", None, None), ("가온", "OWNS_STAKE", "다솜", None, 30.0, "2026-05-05", None, None)]
    several = text.replace("다솜 (대한민국)", "다솜(중국), 라온 Co., Ltd(미국)")
    assert [t[2:5] for t in parse(spark, "타법인주식및출자증권취득결정", several)] == [("다솜", None, None), ("라온 Co., Ltd", None, None)]
    assert parse(spark, "타법인주식및출자증권처분결정", text) == []


def test_guarantee_prefers_the_guarantee(spark):
    text = "1. 채무자\n마루\n채무(차입)금액(원)\n100\n채무보증금액(원)\n120\n채무보증기간\n시작일\n2026-01-01\n종료일\n-"
    assert parse(spark, "타인에대한채무보증결정", text) == [("가온", "GUARANTEES_DEBT_OF", "마루", 120, None, "2026-01-01", None, None)]


def test_shareholders(spark):
    block = "성명\n{}\n최대주주 및 발행회사와의 관계\n{}\n"
    text = "1. 개인별 세부변동사항\n" + block.format("김가", "발행회사 임원") + block.format("김가", "친인척") + block.format("바다", "계열사임원") + block.format("사랑", "-") + "2. 총괄현황\n성명\n생년월일\n성명\n아무개"
    assert [(t[0], t[1], t[2], t[7]) for t in parse(spark, "최대주주등소유주식변동신고서", text)] == [("김가", "OFFICER_OF", "가온", "발행회사 임원"), ("바다", "RELATED_PARTY_OF", "가온", "계열사임원"), ("사랑", "RELATED_PARTY_OF", "가온", None)]


def test_subsidiary_and_correction(spark):
    text = "자회사인\n자람\n의 주요경영사항신고\n3. 계약상대\n차오"
    assert [t[:3] for t in parse(spark, "공급계약체결(자회사의 주요경영사항)", text)] == [("자람", "SUBSIDIARY_OF", "가온"), ("자람", "SUPPLIES_TO", "차오")]
    text = "정정신고(보고)\n1. 정정관련 공시서류\n공급계약체결\n계약상대\n옛\n공급계약체결\n계약상대\n새"
    assert [t[:3] for t in parse(spark, "[기재정정]공급계약체결", text)] == [("가온", "SUPPLIES_TO", "새")]


def test_evidence_window(spark):
    df = spark.createDataFrame([("a " * 300 + "NAME" + " b" * 300, ["NAME", "no"])], "t string, n array<string>").select(X.evidence_window(F.col("t"), F.col("n"), 10, 20).alias("w"))
    assert tuple(df.first()["w"]) == ("a a a a a NAME b b b b b", True)
