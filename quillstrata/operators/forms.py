"""Relations from fixed-form filings, as one projection over parsed lines and an explode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

SUPPLIES_TO, OWNS_STAKE, INVESTS_IN, GUARANTEES_DEBT_OF = "SUPPLIES_TO", "OWNS_STAKE", "INVESTS_IN", "GUARANTEES_DEBT_OF"
SUBSIDIARY_OF, OFFICER_OF, RELATED_PARTY_OF = "SUBSIDIARY_OF", "OFFICER_OF", "RELATED_PARTY_OF"
STATES = [SUBSIDIARY_OF, OFFICER_OF, RELATED_PARTY_OF]

# Parts of report names.
TARGET_KEYWORDS = ["공급계약", "타법인주식", "출자", "채무보증", "합병", "분할", "영업양수", "영업양도", "지분", "주식변동", "유상증자", "신규시설투자"]
SUPPLY, STAKE, GUARANTEE, SHAREHOLDER = "공급계약", "타법인주식", "채무보증", "최대주주등소유주식변동"
NEGATIVE = "해지|취소|처분"

TRIPLE = "struct<subject:string,predicate:string,object:string,amount_krw:decimal(38,0),ratio_pct:double,start_date:string,end_date:string,note:string>"


def triple(subject: Column, predicate: Column | str, object_: Column, amount=None, ratio=None, start=None, end=None, note=None) -> Column:
    own = F.lit(predicate) if isinstance(predicate, str) else predicate
    rest = {"amount_krw": amount, "ratio_pct": ratio, "start_date": start, "end_date": end, "note": note}
    return F.struct(subject.alias("subject"), own.alias("predicate"), object_.alias("object"), *((F.lit(None) if v is None else v).alias(k) for k, v in rest.items())).cast(TRIPLE)


def some(t: Column, there: Column) -> Column:
    """The triple in an array, or an empty array."""
    return F.when(there, F.array(t)).otherwise(F.array().cast(f"array<{TRIPLE}>"))


def _own(form: str) -> Column:
    """The document of filings of this form; null, so that nothing is looked for, in all others."""
    return F.when(F.col("_form") == form, F.col("_doc"))


def supply(rows: DataFrame) -> tuple[DataFrame, Column]:
    doc = _own(SUPPLY)
    rows = rows.withColumns({"_s_object": X.field(doc, "계약상대", "계약상대방"), "_s_amount": X.money(X.field(doc, "계약금액(원)")), "_s_from": X.iso_date(X.field(doc, "시작일", after="계약기간")), "_s_to": X.iso_date(X.field(doc, "종료일", after="계약기간")), "_s_note": X.field(doc, "회사와의 관계")})
    return rows, some(triple(F.col("_subject"), SUPPLIES_TO, F.col("_s_object"), F.col("_s_amount"), None, F.col("_s_from"), F.col("_s_to"), F.col("_s_note")), F.col("_s_object").isNotNull())


def stake(rows: DataFrame) -> tuple[DataFrame, Column]:
    doc = _own(STAKE)
    rows = rows.withColumns({
        "_k_issuers": X.split_companies(X.field(doc, "회사명", "회사명(국적)", after="발행회사")), "_k_note": X.field(doc, "회사와 관계", "회사와의 관계"), "_k_from": X.iso_date(X.field(doc, "취득예정일자")),
        "_k_share": X.percent(X.field(doc, "지분비율(%)", after="취득후 소유주식수 및 지분비율")), "_k_amount": X.money(X.field(doc, "취득금액(원)")), "_k_ratio": X.percent(X.field(doc, "자기자본대비(%)")),
    })
    single = F.size("_k_issuers") == 1
    amount, ratio = F.when(single, F.col("_k_amount")), F.when(single, F.col("_k_ratio"))
    invests = F.transform("_k_issuers", lambda x: triple(F.col("_subject"), INVESTS_IN, x, amount, ratio, F.col("_k_from"), None, F.col("_k_note")))
    owns = some(triple(F.col("_subject"), OWNS_STAKE, F.get("_k_issuers", F.lit(0)), None, F.col("_k_share"), F.col("_k_from"), None, F.col("_k_note")), single & F.col("_k_share").isNotNull())
    return rows, F.concat(invests, owns)


def guarantee(rows: DataFrame) -> tuple[DataFrame, Column]:
    doc = _own(GUARANTEE)
    rows = rows.withColumns({
        "_g_object": X.field(doc, "채무자"), "_g_amount": X.money(X.field(doc, "채무보증금액(원)", "채무(차입)금액(원)")), "_g_ratio": X.percent(X.field(doc, "자기자본대비(%)")),
        "_g_from": X.iso_date(X.field(doc, "시작일", after="채무보증기간")), "_g_to": X.iso_date(X.field(doc, "종료일", after="채무보증기간")), "_g_note": X.field(doc, "회사와의 관계"),
    })
    return rows, some(triple(F.col("_subject"), GUARANTEES_DEBT_OF, F.col("_g_object"), F.col("_g_amount"), F.col("_g_ratio"), F.col("_g_from"), F.col("_g_to"), F.col("_g_note")), F.col("_g_object").isNotNull())


def shareholders(rows: DataFrame) -> tuple[DataFrame, Column]:
    """One relation for each person named in the section of individual changes; the first block of a name counts."""
    doc = _own(SHAREHOLDER)
    rows = rows.withColumns({"_p_section": X.first_at(doc, "개인별 세부변동사항"), "_p_relations": F.filter(doc, lambda x: x["form"] == "최대주주 및 발행회사와의 관계")})
    rows = rows.withColumns({"_p_start": F.coalesce("_p_section", F.lit(1)), "_p_end": F.when(F.col("_p_section").isNull(), F.size(doc) + 1).otherwise(X.section_end(doc, F.col("_p_section")))})
    rows = rows.withColumn("_p_blocks", F.filter(doc, lambda x: (x["form"] == "성명") & (x["i"] >= F.col("_p_start")) & (x["i"] < F.col("_p_end")) & x["value"].isNotNull()))
    first = F.filter("_p_blocks", lambda p: p["i"] == F.get(F.filter("_p_blocks", lambda q: q["value"] == p["value"]), F.lit(0))["i"])
    note = lambda p: F.get(F.filter("_p_relations", lambda r: r["i"] >= p["i"]), F.lit(0))["raw"]
    rows = rows.withColumn("_p_people", F.transform(first, lambda p: F.struct(p["value"].alias("name"), note(p).alias("note"))))

    def kind(note: Column) -> Column:
        flat = F.replace(note, F.lit(" "))
        return F.when(flat.contains("임원") & ~flat.contains("계열사"), OFFICER_OF).otherwise(RELATED_PARTY_OF)

    return rows, F.transform("_p_people", lambda p: triple(p["name"], kind(p["note"]), F.col("_subject"), note=p["note"]))


PARSERS = {SUPPLY: supply, STAKE: stake, GUARANTEE: guarantee, SHAREHOLDER: shareholders}


def parse_filings(filings: DataFrame, name_col: str = "corp_name", report_col: str = "report_nm", text_col: str = "doc_text") -> DataFrame:
    """filings with one row for each relation found, as columns subject, predicate, object, amount_krw, ratio_pct, start_date, end_date, note and seq.

    One pass over the table: a filing's fields are looked for with its own form's labels only, as the other forms see no document."""
    rows = filings.withColumn("_filer", X.strip(F.coalesce(name_col, F.lit("")))).withColumn("_report", F.coalesce(report_col, F.lit("")))
    rows = rows.where((F.col("_filer") != "") & (F.coalesce(text_col, F.lit("")) != ""))
    rows = rows.withColumn("_all", X.labelled(X.lines(F.col(text_col))))
    start = X.body_start(F.col("_all"))
    rows = rows.withColumn("_doc", F.when(start > 1, X.labelled(F.transform(F.slice("_all", start, F.size("_all")), lambda x: x["line"]))).otherwise(F.col("_all"))).drop("_all")
    rows = rows.withColumn("_sub", X.subsidiary_name(F.col("_doc")))
    rows = rows.withColumn("_sub", F.when(F.col("_sub") != F.col("_filer"), F.col("_sub"))).withColumn("_subject", F.coalesce("_sub", "_filer"))
    parent = some(triple(F.col("_sub"), SUBSIDIARY_OF, F.col("_filer")), F.col("_sub").isNotNull())
    form = F.when(F.col("_report").rlike(NEGATIVE), "none")
    for keyword in PARSERS:
        form = form.when(F.col("_report").contains(keyword), keyword)
    rows = rows.withColumn("_form", form.otherwise("none"))
    none = F.array().cast(f"array<{TRIPLE}>")
    found = F.when(F.col("_form") == "none", none)
    for keyword, parser in PARSERS.items():
        rows, own = parser(rows)
        found = found.when(F.col("_form") == keyword, own)
    out = rows.select(*filings.columns, F.posexplode(F.concat(parent, F.coalesce(found, none))).alias("seq", "_t"))
    return out.select(*filings.columns, "seq", "_t.*")


def targets(filings: DataFrame, report_col: str = "report_nm") -> DataFrame:
    """Filings whose report names hold one of the keywords."""
    return filings.where(F.col(report_col).rlike("|".join(TARGET_KEYWORDS)))
