"""Vectors, evidence and retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evals as E
from ..operators import vector_index as VI
from ..operators import vectors as V
from ..sources.views import chunk_vectors, table
from .registry import query

SCORED = """v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label AS ql, e AS qe FROM v WHERE vec_id % 50 = 0),
    s AS (SELECT query_id, ql, vec_id AS id, label, list_dot_product(e, qe) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(qe, qe))) AS score FROM v, q)"""


def queries_of(spark, d):
    return chunk_vectors(spark, d).where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


def nearest(spark, d, k=5, where=None):
    return V.top_k(chunk_vectors(spark, d), queries_of(spark, d), k, where)


@query("knn_topk", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) SELECT query_id, id, round(score, 4) AS score, rank FROM r WHERE rank <= 5")
def knn_topk(spark, d):
    return nearest(spark, d).withColumn("score", F.round("score", 4))


@query("knn_filtered", f"WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s WHERE label = 3) SELECT query_id, id, round(score, 4) AS score, rank FROM r WHERE rank <= 5")
def knn_filtered(spark, d):
    return nearest(spark, d, where=F.col("label") == 3).withColumn("score", F.round("score", 4))


@query("l2_normalise", "SELECT vec_id, round(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * 3 * x * 3)), 4) AS size_before, 1.0::DOUBLE AS size_after FROM embeddings")
def l2_normalise(spark, d):
    three = F.transform("embedding", lambda x: x * 3)
    return chunk_vectors(spark, d).select("vec_id", F.round(V.dot(three, three), 4).alias("size_before"), F.round(V.norm(V.normalised(three)), 4).alias("size_after"))


@query("cosine_agreement", "SELECT round(avg(c), 6) AS mean, round(min(c), 6) AS least FROM (SELECT list_dot_product(e, r) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(r, r))) AS c FROM (SELECT CAST(embedding AS DOUBLE[]) AS e, list_transform(CAST(embedding AS DOUBLE[]), lambda x: round(x, 1)) AS r FROM embeddings))")
def cosine_agreement(spark, d):
    c = V.cosine(F.col("embedding"), F.transform("embedding", lambda x: F.round(x, 1)))
    return chunk_vectors(spark, d).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.min(c), 6).alias("least"))


@query("hybrid_union", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s)
    SELECT 0 AS axis, n_nationkey AS pos, n_name || ' -[SUBSIDIARY_OF]-> ' || r_name AS text FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT 1, CAST(rank AS INTEGER), 'vector ' || id FROM r WHERE query_id = 0 AND rank <= 5""")  # fmt: skip
def hybrid_union(spark, d):
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    g = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_nationkey").alias("pos"), F.concat("n_name", F.lit(" -[SUBSIDIARY_OF]-> "), "r_name").alias("text"))
    v = V.top_k(chunk_vectors(spark, d), queries_of(spark, d).where("query_id = 0")).select(F.col("rank").cast("int").alias("pos"), F.concat(F.lit("vector "), F.col("id").cast("string")).alias("text"))
    return V.hybrid(g, v)


@query("retrieval_eval", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    m AS (SELECT query_id, CASE WHEN ql < 5 THEN 'multi_hop' ELSE 'single_hop' END AS type, count(*) FILTER (WHERE label = ql) > 0 AS hit, least(1, count(*) FILTER (WHERE label = ql)) / 2.0 + CASE WHEN count(*) FILTER (WHERE label = (ql + 1) % 10) > 0 THEN 0.5 ELSE 0 END AS recall,
          count(*) FILTER (WHERE label = ql) + count(*) FILTER (WHERE label = (ql + 1) % 10) > 0 AS any_hit FROM r WHERE rank <= 5 GROUP BY query_id, ql)
    SELECT type, round(avg(CAST(any_hit AS INTEGER)), 6) AS hit_at_k, round(avg(recall), 6) AS recall, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT query_id, 'all', hit, recall, any_hit FROM m) GROUP BY type""")  # fmt: skip
def retrieval_eval(spark, d):
    labels = chunk_vectors(spark, d).select("vec_id", "label")
    near = nearest(spark, d).join(labels, F.col("id") == F.col("vec_id"))
    evidence = near.select(F.col("query_id"), F.col("rank").alias("pos"), F.concat(F.lit("Topic ("), F.col("label").cast("string"), F.lit(") end")).alias("text"))
    gold = F.array(*(F.concat(F.lit("topic "), x.cast("string"), F.lit(" end")) for x in (F.col("label"), (F.col("label") + 1) % 10)))
    q = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 5, "multi_hop").otherwise("single_hop").alias("type"), gold.alias("gold"))
    out = E.summarise(E.score_questions(q, evidence, ["query_id"]))
    return out.select("type", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("recall", 6).alias("recall"), "n")


@query("retrieval_modes", f"""WITH {SCORED}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s),
    f AS (SELECT query_id, ql, CASE WHEN ql < 5 THEN 'multi_hop' ELSE 'single_hop' END AS type, max(CAST(label = ql AS INTEGER)) AS v1, max(CAST(label = (ql + 1) % 10 AS INTEGER)) AS v2, CAST(ql % 2 = 0 AS INTEGER) AS g FROM r WHERE rank <= 5 GROUP BY 1, 2),
    m AS (SELECT type, 'vector' AS mode, v1, v2 FROM f UNION ALL SELECT type, 'graph', g, g FROM f UNION ALL SELECT type, 'hybrid', greatest(v1, g), greatest(v2, g) FROM f)
    SELECT type, mode, round(avg(greatest(v1, v2)), 6) AS hit_at_k, round(avg((v1 + v2) / 2.0), 6) AS recall, count(*) AS n FROM (SELECT * FROM m UNION ALL SELECT 'all', mode, v1, v2 FROM m) GROUP BY 1, 2""")  # fmt: skip
def retrieval_modes(spark, d):
    """Questions about a topic and the one after it, by vectors, by a graph in which every other topic has an edge to the next, and by both."""
    from ..operators import graph as G

    name = lambda x: F.concat(F.lit("topic "), x.cast("string"), F.lit(" end"))
    labels = chunk_vectors(spark, d).select("vec_id", "label")
    edges = labels.select("label").distinct().where("label % 2 = 0").select(F.col("label").cast("string").alias("eid"), name(F.col("label")).alias("src"), F.lit("SUPPLIES_TO").alias("rel"), name((F.col("label") + 1) % 10).alias("dst"), F.lit("r").alias("rcept_no"))
    q = labels.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.when(F.col("label") < 5, "multi_hop").otherwise("single_hop").alias("type"), F.array(name(F.col("label")), name((F.col("label") + 1) % 10)).alias("gold"), "label")
    seeds = q.where("label % 2 = 0").select("query_id", name(F.col("label")).alias("name"))
    near = nearest(spark, d).join(labels, F.col("id") == F.col("vec_id")).select("query_id", F.col("rank").alias("pos"), name(F.col("label")).alias("text"))
    scored = E.score_modes(q.drop("label"), {"vector": near, "graph": G.search_each(edges, seeds, "query_id", 1).select("query_id", "pos", "text")}, "query_id")
    return E.summarise(scored, ["type", "mode"]).select("type", "mode", F.round("hit_at_k", 6).alias("hit_at_k"), F.round("recall", 6).alias("recall"), "n")


@query("embed_chunks")
def embed_chunks(spark, d):
    """Chunks of every document with their hashed vectors."""
    from ..functions.text import chunks

    rows = table(spark, d, "documents").select("doc_id", F.posexplode(chunks(F.col("text"))).alias("chunk_idx", "content"))
    return rows.select("doc_id", "chunk_idx", F.length("content").alias("chars"), V.encoder(64)("content").alias("embedding"))


@query("knn_index")
def knn_index(spark, d):
    """The nearest by cells of the index; no SQL, as it is approximate (tests measure its recall against the exact scan)."""
    return VI.search(VI.build(chunk_vectors(spark, d)), queries_of(spark, d)).withColumn("score", F.round("score", 4))
