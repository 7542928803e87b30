r"""Format-preserving pseudonyms for personal data, in DataFrame functions alone.

Validated numbers and dates are replaced by a keyed permutation of their own format: a Feistel network over two
mixed-radix halves (or, for names and long numbers, two halves of a string, sign by sign), whose rounds add SHA-256 of (key, kind, round, other half). Equal values get
equal pseudonyms in all documents, different values different ones, and the key's owner can undo them. Kinds, in the order in which they are looked for:

- card: 13 to 19 digits, single or in groups, with a right Luhn digit. All but the last digit are permuted, the last is made right again.
- iban: two letters, two digits, 11 to 30 letters or digits, with the right remainder of 97. Digits of the account are permuted; the check digits are made right.
- ssn: ddd-dd-dddd with an area other than 000, 666 and 9xx, group and serial not zero; permuted among such numbers.
- date: yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy or dd/mm/yyyy, or mm/dd/yyyy where the second number is no month; a real day from year 1400 on. Permuted within its
  400 years, which always have 146,097 = 189 * 773 days. A day has one pseudonym in all orders; it is written in the order of the value.
- phone: (ddd) ddd-dddd or ddd ddd dddd, also with dots or hyphens, with or without +c before; or + and 8 to 15 digits in groups. The country code (after a plus: one
  digit for 1 and 7, else two) stays, the other digits are permuted, so a number is linked to itself however it is grouped.
- ipv4: four octets up to 255; permuted among all addresses. ipv6: eight groups, or fewer around ::, not at either end; permuted, and written in eight groups of four digits.
- email: letters and digits of the part before the sign, permuted among letters of both cases and digits; the other signs and the domain stay. Spellings that differ in
  case are different values.

The key is written into the query's plan; whoever may read plans and event logs may read it.

What does not validate stays as it is, as do phone numbers in groups without a plus that aren't 3-3-4. Separators stay where they are. Null text gives null. Repeated rows get equal results; other columns stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, prepare

_EDGE, _STOP = r"(?<![A-Za-z0-9])(?<!\d[.\-/])", r"(?![A-Za-z0-9])(?![.\-/]\d)"
# Formats.
FORMATS = {
    "card": r"(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}|\d{4}[ -]\d{6}[ -]\d{5})",
    "iban": r"(?:[A-Z]{2}\d{2}[A-Z0-9]{11,30}|[A-Z]{2}\d{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)",
    "ssn": r"\d{3}-\d{2}-\d{4}",
    "date": r"(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})",
    "phone": r"(?:(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\(?\d{1,5}\)?){2,6})",
    "ipv4": r"\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}",
    "ipv6": r"(?<!:)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?!:)",
}
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"
ANY = "(?:" + EMAIL + "|" + _EDGE + "(?:" + "|".join(FORMATS.values()) + ")" + _STOP + ")"
ROUNDS = 8
DIGITS = "0123456789"
HEX, NAME = DIGITS + "abcdef", DIGITS + "ABCDEFGHIJKLMNOPQRSTUVWXYZ" + "abcdefghijklmnopqrstuvwxyz"


def feistel(key: str, kind: str, a: str, b: str, m: str, n: str, undo: bool = False) -> str:
    """SQL: struct(a, b) permuted in 0..m-1 x 0..n-1; a, b, m and n are SQL of longs."""
    f = f"cast(conv(substr(sha2(concat('{key}|{kind}|', i, '|', {{}}), 256), 1, 15), 16, 10) as bigint)"
    sign = "-" if undo else "+"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if undo else f"sequence(0, {ROUNDS - 1})"
    return (
        f"aggregate({order}, named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, i) -> if(i % 2 = 0, "
        f"named_struct('a', pmod(s.a {sign} pmod({f.format('s.b')}, {m}), {m}), 'b', s.b), named_struct('a', s.a, 'b', pmod(s.b {sign} pmod({f.format('s.a')}, {n}), {n}))))"
    )


def string_feistel(key: str, kind: str, d: str, signs: str, undo: bool = False) -> str:
    """SQL: a string of up to 64 of the signs, permuted among those of its length."""
    sign = "-" if undo else "+"
    order = f"sequence({ROUNDS - 1}, 0, -1)" if undo else f"sequence(0, {ROUNDS - 1})"

    def moved(t: str, other: str) -> str:
        h = f"sha2(concat('{key}|{kind}|', i, '|', length({t}), '|', {other}), 256)"
        one = f"substr('{signs}', pmod(instr('{signs}', substr({t}, j, 1)) - 1 {sign} cast(conv(substr(h, 2 * j - 1, 2), 16, 10) as int), {len(signs)}) + 1, 1)"
        spread = f"array_join(transform(sequence(1, length({t})), j -> {one}), '')"
        return f"if(length({t}) = 0, '', {_let(h, 'h', spread)})"

    half = f"cast(length({d}) div 2 as int)"
    step = f"if(i % 2 = 0, named_struct('a', {moved('s.a', 's.b')}, 'b', s.b), named_struct('a', s.a, 'b', {moved('s.b', 's.a')}))"
    return _let(f"aggregate({order}, named_struct('a', substr({d}, 1, {half}), 'b', substr({d}, {half} + 1)), (s, i) -> {step})", "w", "concat(w.a, w.b)")


def _power(n: str, base: int = 10) -> str:
    return f"cast(pow({base}, {n}) as bigint)"


def _refill(shape: str, chars: str, on: str) -> str:
    """SQL: shape with its characters of the class `on` replaced, in order, by those of chars."""
    return (
        f"aggregate(split({shape}, ''), named_struct('out', '', 'k', 1), (s, c) -> if(c rlike '{on}', named_struct('out', concat(s.out, substr({chars}, s.k, 1)), 'k', s.k + 1), "
        f"named_struct('out', concat(s.out, c), 'k', s.k)), s -> s.out)"
    )


def _let(value: str, name: str, body: str) -> str:
    """SQL: body with name bound to value."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _permuted_digits(key: str, kind: str, d: str) -> str:
    """SQL: a string of 2 to 36 digits, permuted."""
    half = f"cast(length({d}) div 2 as int)"
    rest = f"(length({d}) - {half})"
    s = feistel(key, kind, f"cast(substr({d}, 1, {half}) as bigint)", f"cast(substr({d}, {half} + 1) as bigint)", _power(half), _power(rest))
    return _let(s, "p", f"concat(lpad(cast(p.a as string), {half}, '0'), lpad(cast(p.b as string), {rest}, '0'))")


def _luhn_sum(d: str, first: int) -> str:
    """SQL: Luhn sum of a digit string; the digit `first` places from the right end (from 0) is the first not doubled."""
    return (
        f"aggregate(sequence(1, length({d})), 0, (s, k) -> s + element_at(if((length({d}) - k) % 2 = {first % 2}, array(0,1,2,3,4,5,6,7,8,9), array(0,2,4,6,8,1,3,5,7,9)), "
        f"cast(substr({d}, k, 1) as int) + 1))"
    )


def _iban_rest(d: str) -> str:
    """SQL: remainder of 97 of an IBAN's letters and digits, moved by four."""
    return (
        f"aggregate(split(concat(substr({d}, 5), substr({d}, 1, 4)), ''), 0, (s, c) -> if(c rlike '[0-9]', (s * 10 + cast(c as int)) % 97, (s * 100 + ascii(c) - 55) % 97))"
    )


def _pseudonym(key: str, x: str) -> str:
    """SQL: the pseudonym of a match, or the match itself where it does not validate."""
    digits = f"regexp_replace({x}, '[^0-9]', '')"
    # card
    card = _let(digits, "d", f"if({_luhn_sum('d', 0)} % 10 = 0, {_let(_permuted_digits(key, 'card', 'substr(d, 1, length(d) - 1)'), 'q', _refill(x, f'concat(q, cast(pmod(10 - {_luhn_sum('q', 1)}, 10) as string))', '[0-9]'))}, {x})")
    # iban: the account's digits, then check digits of 98 less the remainder with 00 in their place
    plain = f"replace({x}, ' ', '')"
    account = "regexp_replace(substr(d, 5), '[^0-9]', '')"
    filled = _refill("concat(substr(d, 1, 2), '00', substr(d, 5))", "concat('00', q)", "[0-9]")
    checked = _let(filled, "e", f"concat(substr(e, 1, 2), lpad(cast(98 - {_iban_rest('e')} as string), 2, '0'), substr(e, 5))")
    iban = _let(plain, "d", f"if({_iban_rest('d')} = 1 and length({account}) between 2 and 30, {_let(_permuted_digits(key, 'iban', account), 'q', _let(checked, 'r', _refill(x, 'r', '[A-Z0-9]')))}, {x})")
    # ssn: areas 1-665 and 667-899, groups 1-99, serials 1-9999
    area = "cast(substr(d, 1, 3) as bigint)"
    valid = f"{area} between 1 and 899 and {area} <> 666 and substr(d, 4, 2) <> '00' and substr(d, 6) <> '0000'"
    s = feistel(key, "ssn", f"(({area} - if({area} > 666, 2, 1)) * 99 + cast(substr(d, 4, 2) as bigint) - 1)", "cast(substr(d, 6) as bigint) - 1", "(898 * 99)", "9999")
    built = "concat(lpad(cast(p.a div 99 + if(p.a div 99 >= 665, 2, 1) as string), 3, '0'), '-', lpad(cast(p.a % 99 + 1 as string), 2, '0'), '-', lpad(cast(p.b + 1 as string), 4, '0'))"
    ssn = _let(digits, "d", f"if({valid}, {_let(s, 'p', built)}, {x})")
    # date
    day = f"coalesce(try_to_date({x}, 'yyyy-MM-dd'), try_to_date({x}, 'yyyy/MM/dd'), try_to_date({x}, 'dd.MM.yyyy'), try_to_date({x}, 'dd/MM/yyyy'), try_to_date({x}, 'MM/dd/yyyy'))"
    n = "datediff(t, date'1800-01-01')"
    s = feistel(key, "date", f"pmod({n}, 146097) div 773", f"pmod({n}, 146097) % 773", "189", "773")
    moved = f"date_add(date'1800-01-01', cast(floor({n} / 146097) * 146097 + p.a * 773 + p.b as int))"
    shape = f"case when {x} rlike '^[0-9]{{4}}-' then 'yyyy-MM-dd' when {x} rlike '^[0-9]{{4}}/' then 'yyyy/MM/dd' when {x} rlike '[.]' then 'dd.MM.yyyy' when try_to_date({x}, 'dd/MM/yyyy') is null then 'MM/dd/yyyy' else 'dd/MM/yyyy' end"
    shown = f"case {shape} when 'yyyy-MM-dd' then date_format(y, 'yyyy-MM-dd') when 'yyyy/MM/dd' then date_format(y, 'yyyy/MM/dd') when 'dd.MM.yyyy' then date_format(y, 'dd.MM.yyyy') when 'MM/dd/yyyy' then date_format(y, 'MM/dd/yyyy') else date_format(y, 'dd/MM/yyyy') end"
    date = _let(day, "t", f"if(t is not null and t >= date'1400-01-01' and t < date'9800-01-01', {_let(_let(s, 'p', moved), 'y', shown)}, {x})")
    # phone
    code = f"if(not contains({x}, '+'), 0, if(substr(d, 1, 1) in ('1', '7'), 1, 2))"
    phone = _let(digits, "d", _let(code, "n", f"if(length(d) between if(n = 0, 10, 8) and 15, {_let(_permuted_digits(key, 'phone', 'substr(d, n + 1)'), 'q', _refill(x, 'concat(substr(d, 1, n), q)', '[0-9]'))}, {x})"))
    # ipv4
    octet = lambda k: f"cast(split({x}, '[.]')[{k}] as bigint)"
    s = feistel(key, "ipv4", f"{octet(0)} * 256 + {octet(1)}", f"{octet(2)} * 256 + {octet(3)}", "65536", "65536")
    ipv4 = f"if({' and '.join(f'{octet(k)} <= 255' for k in range(4))}, {_let(s, 'p', 'concat_ws(chr(46), p.a div 256, p.a % 256, p.b div 256, p.b % 256)')}, {x})"
    # ipv6: the groups on both sides of ::, filled up with zeros
    left, right = f"split(substring_index(lower({x}), '::', 1), ':')", f"if(contains({x}, '::'), split(substring_index(lower({x}), '::', -1), ':'), cast(array() as array<string>))"
    groups = _let(f"named_struct('l', {left}, 'r', {right})", "g", "concat(g.l, array_repeat('0', 8 - size(g.l) - size(g.r)), g.r)")
    spread = _let("array_join(transform(g, y -> lpad(y, 4, '0')), '')", "d", _let(string_feistel(key, "ipv6", "d", HEX), "q", "array_join(transform(sequence(0, 7), k -> substr(q, 4 * k + 1, 4)), ':')"))
    ipv6 = _let(groups, "g", f"if(size(g) = 8, {spread}, {x})")
    # email: letters and digits of the local part
    local, before = f"regexp_replace(substring_index({x}, '@', 1), '[^A-Za-z0-9]', '')", f"substring_index({x}, '@', 1)"
    email = _let(local, "d", _let(string_feistel(key, "email", "d", NAME), "q", f"concat({_refill(before, 'q', '[A-Za-z0-9]')}, substr({x}, instr({x}, '@')))"))
    full = lambda k: f"{x} rlike '^{FORMATS[k]}$'".replace("\\", "\\\\")
    return (
        f"case when contains({x}, '@') then {email} when {full('ipv6')} then {ipv6} when {full('ssn')} then {ssn} when {full('date')} then {date} when {full('ipv4')} then {ipv4} when {full('phone')} then {phone} "
        f"when {full('card')} then {card} when {full('iban')} then {iban} else {x} end"
    )


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with personal data in the text replaced, and n_pii: how many values were. key: letters and digits; a column n_pii is replaced."""
    if not key.isalnum():
        raise ValueError("key: letters and digits")
    prepare(docs.sparkSession)
    out = docs.drop("n_pii").withColumn(text_col, F.col(text_col).cast("string"))
    text = F.col(text_col)
    found, named = fresh(out, "_found"), fresh(out, "_named")
    # most texts have none and are only searched
    matches = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    out = out.withColumn(found, F.when(text.rlike("[0-9@]|::"), matches).otherwise(F.array().cast("array<string>")))
    out = out.withColumn(named, F.expr(f"transform({found}, x -> {_pseudonym(key, 'x')})"))
    gaps = F.split(text, ANY, -1)
    whole = F.concat_ws("", F.flatten(F.transform(F.arrays_zip(gaps.alias("gap"), F.col(named).alias("new")), lambda z: F.array(F.coalesce(z["gap"], F.lit("")), F.coalesce(z["new"], F.lit(""))))))
    changed = F.size(F.filter(F.arrays_zip(F.col(found).alias("a"), F.col(named).alias("b")), lambda z: z["a"] != z["b"]))
    return out.withColumn(text_col, F.when(text.isNull() | (F.size(found) == 0), text).otherwise(whole)).withColumn("n_pii", F.when(F.col(found).isNull(), 0).otherwise(changed)).drop(found, named)
