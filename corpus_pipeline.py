"""Cleaning a corpus of documents: toxicity, line dedup, near-dedup, benchmark decontamination, packing.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the columns of
documents, with n_chars brought up to date where the text changes. Stages are separate functions so that a driver can write and
reread each one's rows; run() does the same, into the shared checkpoint folder, so no stage is worked out twice.

In every stage null text counts as empty, a row without doc_id stays (line dedup takes it for the last, and a packed one keeps its null id), repeated rows are
judged alike, an empty table gives an empty one, and columns that the operators give names to keep their own values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstrata.llm.common import fresh, stored
from quillstrata.llm.decontam import keep_clean
from quillstrata.llm.linededup import dedup_lines
from quillstrata.llm.nearcopies import keep_first
from quillstrata.llm.packing import pack
from quillstrata.llm.queries import TOXIC_FROM, remainder, table
from quillstrata.llm.toxicity import toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score as toxic go."""
    score = fresh(docs, "toxicity")
    return toxicity(docs, table(spark, sf_dir, "labels"), learn=remainder(3) != 1, out_col=score).where(F.col(score) < TOXIC_FROM).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go."""
    out = dedup_lines(docs, out_cols=(fresh(docs, "n_lines"), fresh(docs, "n_dropped")))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, found by SimHash and MinHash and checked for 0.8 of their five-word shingles in common, the smallest doc_id stays."""
    return keep_first(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which windows of benchmark items make up a twentieth go."""
    return keep_clean(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents that are left, with their places in sequences of 2048 tokens."""
    return pack(docs, capacity=2048, end_id=0, keep_ids=False)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("simhash_near_dedup", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("best_fit_packing", pack_sequences),
]

#: No SQL: string kernels and token ids are beyond it; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
