"""Documents to chunks with vectors, relations to stored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks
from .ingest import insert_absent
from .vectors import encoder

PROPS = ["amount_krw", "ratio_pct", "start_date", "end_date", "note"]
PROPS_SCHEMA = "amount_krw decimal(38,0), ratio_pct double, start_date string, end_date string, note string"
#: Characters that stored names may have.
NAME_CHARS = 200


def chunk_documents(filings: DataFrame, key: str = "rcept_no", text: str = "doc_text", keep: list[str] | None = None, most: int = 800, overlap: int = 100) -> DataFrame:
    """One row for each chunk of the documents that have text: (key, *keep, chunk_idx, content)."""
    rows = filings.where(F.col(text).isNotNull())
    return rows.select(key, *(keep or []), F.posexplode(chunks(F.col(text), most, overlap)).alias("chunk_idx", "content"))


def embed_documents(filings: DataFrame, stored: DataFrame, key: str = "rcept_no", text: str = "doc_text", encode=None) -> DataFrame:
    """stored chunks (key, chunk_idx, content, embedding) and those of documents that aren't there yet; chunks that exist stay as they are."""
    fresh = filings.join(stored.select(key).distinct(), key, "left_anti")
    made = chunk_documents(fresh, key, text).withColumn("embedding", (encode or encoder())("content"))
    return insert_absent(stored, made, [key, "chunk_idx"])


def stored_triples(triples: DataFrame, model: str = "rules") -> DataFrame:
    """Relations as they are appended: names cut, properties as JSON without nulls, and what made them."""
    return triples.select("rcept_no", F.substring("subject", 1, NAME_CHARS).alias("subject_name"), "predicate", F.substring("object", 1, NAME_CHARS).alias("object_name"), F.to_json(F.struct(*PROPS)).alias("props_json"), F.lit(model).alias("model"), ((F.length("subject") > NAME_CHARS) | (F.length("object") > NAME_CHARS)).alias("was_cut"))


def props(json: Column) -> Column:
    """The properties of a stored relation."""
    return F.from_json(json, PROPS_SCHEMA)
