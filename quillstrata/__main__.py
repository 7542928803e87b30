"""Registered queries and daily jobs from the command line.

python -m quillstrata                              lists queries and jobs
python -m quillstrata QUERY DATA_DIR [OUT]         runs a query and shows its rows, or writes them
python -m quillstrata relations ROOT [LIMIT]       relations of stored filings that have none yet
python -m quillstrata graph ROOT                   nodes and edges from the stored relations
python -m quillstrata chunks ROOT                  chunks and vectors of filings that have none yet
python -m quillstrata evaluate ROOT QUESTIONS [K]  hits and recall by vectors, graph and both, of questions in JSON lines
"""

from __future__ import annotations

import sys

from pyspark.sql import functions as F

from .plans import daily
from .plans.registry import QUERIES
from .session import session


def evaluate(store: daily.Store, questions: str, k: str = "5"):
    from .api import Engine
    from .sources import read_questions

    chunks = store.read("doc_chunk", daily.CHUNK).withColumn("chunk_id", F.concat_ws("|", "rcept_no", "chunk_idx"))
    edges = store.spark.read.parquet(store.path("graph_edge"))
    return Engine(store.spark, edges, chunks).evaluate(read_questions(store.spark, questions), int(k)).orderBy("type", "mode")


JOBS = {
    "relations": lambda store, *limit: daily.extract_relations(store, *map(int, limit)),
    "graph": daily.load_relations,
    "chunks": daily.embed_filings,
    "evaluate": evaluate,
}


def main(args: list[str]) -> int:
    if len(args) < 2 or args[0] not in {*JOBS, *QUERIES}:
        print("\n".join([*sorted(QUERIES), *JOBS]))
        return 0 if not args else 2
    spark = session()
    if args[0] in JOBS:
        out = JOBS[args[0]](daily.Store(spark, args[1]), *args[2:])
        print(out if isinstance(out, int | tuple) else out.toPandas().to_string(index=False))
        return 0
    df = QUERIES[args[0]](spark, args[1])
    if len(args) > 2:
        df.write.mode("overwrite").parquet(args[2])
    else:
        df.show(50, truncate=120)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
