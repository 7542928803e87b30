"""The relation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph as G
from ..sources.views import state_triples, supply_triples, table
from .registry import query

SUPPLY = """supply AS (SELECT s_name AS subject, c_name AS object, o_orderkey AS rcept_no, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS amount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN customer ON o_custkey = c_custkey)"""
STATE = """state AS (SELECT n_name AS src, 'SUBSIDIARY_OF' AS rel, r_name AS dst, CAST(n_nationkey AS BIGINT) AS rcept_no FROM nation JOIN region ON n_regionkey = r_regionkey
    UNION ALL SELECT s_name, 'OFFICER_OF', n_name, s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey)"""
#: Edges of the graph on which paths are searched: states, and one supply relation for each pair.
WHOLE = f"""WITH {SUPPLY}, {STATE}, e0 AS (SELECT src, rel, dst, rcept_no FROM state UNION ALL SELECT subject, 'SUPPLIES_TO', object, min(rcept_no) FROM supply GROUP BY 1, 3),
    e AS (SELECT src || '|' || rel || '|' || dst AS eid, * FROM e0)"""
BOTH = ", u AS (SELECT eid, src AS a, dst AS b, rel, src AS start, rcept_no FROM e UNION ALL SELECT eid, dst, src, rel, src, rcept_no FROM e WHERE src <> dst)"
SEED = "Supplier#000000001"


def graph(spark, d):
    s = supply_triples(spark, d).groupBy(F.col("subject").alias("src"), F.lit("SUPPLIES_TO").alias("rel"), F.col("object").alias("dst")).agg(F.min("rcept_no").alias("rcept_no"))
    st = state_triples(spark, d).select(F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"), "rcept_no")
    return st.unionByName(s).select(F.concat_ws("|", "src", "rel", "dst").alias("eid"), "src", "rel", "dst", "rcept_no")


def seed(spark):
    return spark.createDataFrame([(SEED,)], "name string")


@query("event_edges", f"WITH {SUPPLY} SELECT subject, object, rcept_no, arg_max(amount, row(line, amount)) AS amount, count(*) AS n_support FROM supply GROUP BY 1, 2, 3")
def event_edges(spark, d):
    rows = supply_triples(spark, d).withColumn("k", F.struct("line", "amount"))
    return G.event_edges(rows, "k", ["amount"]).select("subject", "object", "rcept_no", "amount", "n_support")


@query("state_edges", f"WITH {STATE} SELECT src AS subject, rel AS predicate, dst AS object, min(rcept_no) AS rcept_no, count(*) AS n_support FROM (SELECT * FROM state UNION ALL SELECT src, rel, dst, rcept_no + 1000 FROM state) GROUP BY 1, 2, 3")
def state_edges(spark, d):
    t = state_triples(spark, d)
    return G.state_edges(t.unionByName(t.withColumn("rcept_no", F.col("rcept_no") + 1000)), ["rcept_no"])


@query("nodes_with_aliases", f"""WITH {SUPPLY}, raw AS (SELECT subject AS raw FROM supply UNION SELECT object || ' Co., Ltd.' FROM supply UNION SELECT '(주)' || object FROM supply)
    SELECT name, array_to_string(list_sort(list(raw)), ';') AS aliases FROM (SELECT raw, replace(replace(raw, ' Co., Ltd.', ''), '(주)', '') AS name FROM raw) GROUP BY name""")  # fmt: skip
def nodes_with_aliases(spark, d):
    t = supply_triples(spark, d).select("subject", "object").distinct()
    both = t.select("subject", F.concat("object", F.lit(" Co., Ltd.")).alias("object")).unionByName(t.select("subject", F.concat(F.lit("(주)"), "object").alias("object")))
    return G.nodes(both).select("name", F.array_join("aliases", ";").alias("aliases"))


@query("unique_names", f"WITH {STATE} SELECT count(DISTINCT n) AS nodes, count(DISTINCT n) AS names FROM (SELECT src AS n FROM state UNION ALL SELECT dst FROM state)")
def unique_names(spark, d):
    return G.nodes(state_triples(spark, d)).agg(F.count("*").alias("nodes"), F.countDistinct("name").alias("names"))


@query("predicate_counts", f"WITH {STATE}, {SUPPLY} SELECT rel AS predicate, count(*) AS n FROM (SELECT rel FROM state UNION ALL SELECT 'SUPPLIES_TO' FROM supply) GROUP BY 1")
def predicate_counts(spark, d):
    return state_triples(spark, d).select("predicate").unionByName(supply_triples(spark, d).select("predicate")).groupBy("predicate").agg(F.count("*").alias("n"))


@query("degree_topk", WHOLE + " SELECT name, rel, count(*) AS degree FROM (SELECT src AS name, rel FROM e UNION ALL SELECT dst, rel FROM e) GROUP BY 1, 2 ORDER BY degree DESC, name, rel LIMIT 50")
def degree_topk(spark, d):
    return G.degrees(graph(spark, d)).orderBy(F.desc("degree"), "name", "rel").limit(50)


@query("neighbours_1hop", WHOLE + BOTH + f" SELECT DISTINCT a, b, rel, start, rcept_no FROM u WHERE a = '{SEED}' AND a <> b")
def neighbours_1hop(spark, d):
    return G.paths(graph(spark, d), seed(spark), 1).select(F.get("names", F.lit(0)).alias("a"), F.get("names", F.lit(1)).alias("b"), F.get("rels", F.lit(0)).alias("rel"), F.get("starts", F.lit(0)).alias("start"), F.get("rcepts", F.lit(0)).alias("rcept_no"))


TWO = f" SELECT DISTINCT u1.a AS n1, u1.b AS n2, u2.b AS n3, u1.rel AS r1, u2.rel AS r2, u1.start AS s1, u2.start AS s2, u1.rcept_no AS c1, u2.rcept_no AS c2 FROM u u1 JOIN u u2 ON u1.b = u2.a WHERE u1.a = '{SEED}' AND u1.eid <> u2.eid AND u1.a <> u2.b"


@query("paths_2hop", WHOLE + BOTH + TWO)
def paths_2hop(spark, d):
    p = G.paths(graph(spark, d), seed(spark), 2).where("depth = 2")
    return p.select(*(F.get("names", F.lit(k)).alias(f"n{k + 1}") for k in range(3)), *(F.get(c, F.lit(k)).alias(f"{a}{k + 1}") for c, a in (("rels", "r"), ("starts", "s"), ("rcepts", "c")) for k in range(2)))


RENDERED = f""", p1 AS (SELECT DISTINCT a AS n1, b AS n2, rel AS r1, start AS s1, rcept_no AS c1 FROM u WHERE a = '{SEED}' AND a <> b),
    p2 AS ({TWO}),
    t AS (SELECT 1 AS depth, n1 || CASE WHEN s1 = n1 THEN ' -[' || r1 || ']-> ' ELSE ' <-[' || r1 || ']- ' END || n2 AS text, r1 AS ra, r1 AS rb, c1 AS rcept_no, [n1, n2] AS names FROM p1
      UNION ALL SELECT 2, n1 || CASE WHEN s1 = n1 THEN ' -[' || r1 || ']-> ' ELSE ' <-[' || r1 || ']- ' END || n2 || CASE WHEN s2 = n2 THEN ' -[' || r2 || ']-> ' ELSE ' <-[' || r2 || ']- ' END || n3, r1, r2, c1, [n1, n2, n3] FROM p2),
    k AS (SELECT *, least(coalesce(nullif(list_position(['SUPPLIES_TO','INVESTS_IN','OWNS_STAKE','GUARANTEES_DEBT_OF','SUBSIDIARY_OF','OFFICER_OF','RELATED_PARTY_OF'], ra), 0), 8), coalesce(nullif(list_position(['SUPPLIES_TO','INVESTS_IN','OWNS_STAKE','GUARANTEES_DEBT_OF','SUBSIDIARY_OF','OFFICER_OF','RELATED_PARTY_OF'], rb), 0), 8)) AS rank FROM t),
    o AS (SELECT text, depth, CAST(rank AS INTEGER) AS rank, min(rcept_no) AS rcept_no FROM k GROUP BY 1, 2, 3 ORDER BY depth, rank, text LIMIT 60)"""


@query("hop_budget_limit", WHOLE + BOTH + RENDERED + " SELECT text, depth, rank, rcept_no FROM o")
def hop_budget_limit(spark, d):
    return G.search(graph(spark, d), seed(spark), 2).select("text", "depth", F.col("rank").cast("int").alias("rank"), "rcept_no")


@query("path_render", WHOLE + BOTH + RENDERED + " SELECT DISTINCT text FROM t WHERE depth = 1")
def path_render(spark, d):
    return G.paths(graph(spark, d), seed(spark), 1).select(G.render(F.col("names"), F.col("rels"), F.col("starts")).alias("text")).distinct()


@query("relation_order", WHOLE + BOTH + RENDERED + " SELECT rank, count(DISTINCT text) AS n FROM k GROUP BY 1")
def relation_order(spark, d):
    p = G.paths(graph(spark, d), seed(spark), 2).select(G.rank(F.col("rels")).cast("int").alias("rank"), G.render(F.col("names"), F.col("rels"), F.col("starts")).alias("text"))
    return p.groupBy("rank").agg(F.countDistinct("text").alias("n"))


@query("find_connection", WHOLE + BOTH + RENDERED + " SELECT DISTINCT text, depth FROM t WHERE len(list_filter(names, lambda x: contains(replace(x, ' ', ''), 'Supplier#000000001'))) > 0 AND len(list_filter(names, lambda x: contains(replace(x, ' ', ''), 'Supplier#000000002'))) > 0")
def find_connection(spark, d):
    p = G.paths(graph(spark, d), seed(spark), 2).select("depth", G.render(F.col("names"), F.col("rels"), F.col("starts")).alias("text"), F.col("names").alias("entities"))
    return G.with_both(p, SEED, "Supplier#000000002").select("text", "depth").distinct()


#: Names along all paths of one and two hops from two suppliers, and what stands in evidence of either.
SHARED = """, s AS (SELECT DISTINCT [a, b] AS names FROM u WHERE a IN (SEEDS) AND a <> b
      UNION SELECT DISTINCT [u1.a, u1.b, u2.b] FROM u u1 JOIN u u2 ON u1.b = u2.a WHERE u1.a IN (SEEDS) AND u1.eid <> u2.eid AND u1.a <> u2.b)
    SELECT DISTINCT unnest(names) AS name FROM s WHERE len(list_filter(names, lambda x: contains(x, '000000001'))) > 0 AND contains(names[1], 'Supplier') INTERSECT SELECT DISTINCT unnest(names) FROM s WHERE len(list_filter(names, lambda x: contains(x, '000000002'))) > 0"""


@query("shared_partners", "SELECT name FROM (" + WHOLE + BOTH + SHARED.replace("SEEDS", f"'{SEED}', 'Supplier#000000002'").replace("'000000001'", f"'{SEED}'").replace("'000000002'", "'Supplier#000000002'") + f") WHERE name NOT IN ('{SEED}', 'Supplier#000000002')")
def shared_partners(spark, d):
    both = spark.createDataFrame([(SEED,), ("Supplier#000000002",)], "name string")
    return G.shared_partners(G.paths(graph(spark, d), both, 2).select(F.col("names").alias("entities")), SEED, "Supplier # 000000002")


@query("graph_overview", WHOLE + ", n AS (SELECT src AS name FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS n_nodes, name FROM n WHERE name IN (SELECT n_name FROM nation) ORDER BY name LIMIT 10")
def graph_overview(spark, d):
    return G.overview(graph(spark, d), table(spark, d, "nation").select(F.col("n_name").alias("name")))


@query("overview_fallback", WHOLE + ", n AS (SELECT src AS name FROM e UNION SELECT dst FROM e) SELECT (SELECT count(*) FROM n) AS n_nodes, name FROM n ORDER BY name LIMIT 10")
def overview_fallback(spark, d):
    """Examples where no company of the universe is in the graph."""
    return G.overview(graph(spark, d), spark.createDataFrame([("nobody",)], "name string"))


@query("company_relations", WHOLE + BOTH + RENDERED.replace(f"a = '{SEED}'", "a IN (SELECT s_name FROM supplier ORDER BY s_name LIMIT 3)").replace("ORDER BY depth, rank, text LIMIT 60)", "HAVING depth = 1 ORDER BY depth, rank, text LIMIT 60)") + " SELECT text, depth, rank, rcept_no FROM o")
def company_relations(spark, d):
    """What a client gets for one hop around the names that a text holds: the first four characters of a name suffice, so it is three suppliers."""
    from ..api import Engine

    return Engine(spark, graph(spark, d)).get_company_relations("Supplier or buyer", 1).select("text", "depth", F.col("rank").cast("int").alias("rank"), "rcept_no")


#: Order lines with spellings of the two ends that change from line to line.
SPELT = "spelt AS (SELECT CASE line % 3 WHEN 0 THEN '(주)' || subject WHEN 1 THEN subject || ' Co., Ltd.' ELSE subject END AS s_raw, CASE line % 2 WHEN 0 THEN '  ' || object || ' Inc.' ELSE object END AS o_raw, subject, object, rcept_no, line, amount FROM supply)"


def spelt(spark, d):
    """Relations as they are stored: spellings vary, some lines are states."""
    t, line = supply_triples(spark, d), F.col("line") % 3
    subject = F.when(line == 0, F.concat(F.lit("(주)"), "subject")).when(line == 1, F.concat("subject", F.lit(" Co., Ltd."))).otherwise(F.col("subject"))
    object_ = F.when(F.col("line") % 2 == 0, F.concat(F.lit("  "), "object", F.lit(" Inc."))).otherwise(F.col("object"))
    return t.select(F.struct("rcept_no", "line", "amount").alias("triple_id"), subject.alias("subject"), F.when(F.col("amount") % 4 == 0, "RELATED_PARTY_OF").otherwise("SUPPLIES_TO").alias("predicate"), object_.alias("object"), "rcept_no", "amount")


def followed(spark, d):
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").cast("string").alias("corp_code"), F.concat(F.lit("주식회사 "), "s_name").alias("corp_name"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_suppkey").cast("string")).alias("stock_code"), (F.col("s_suppkey") % 2 == 0).alias("in_universe"))


@query("graph_edges", f"""WITH {SUPPLY}, t AS (SELECT row(rcept_no, line, amount) AS id, subject AS src, CASE WHEN amount % 4 = 0 THEN 'RELATED_PARTY_OF' ELSE 'SUPPLIES_TO' END AS rel, object AS dst, rcept_no, amount FROM supply)
    SELECT src, rel, dst, rcept_no, arg_max(amount, id) AS amount, count(*) AS n_support FROM t WHERE rel = 'SUPPLIES_TO' GROUP BY 1, 2, 3, 4
    UNION ALL SELECT src, rel, dst, arg_min(rcept_no, id), arg_min(amount, id), count(*) FROM t WHERE rel <> 'SUPPLIES_TO' GROUP BY 1, 2, 3""")  # fmt: skip
def graph_edges(spark, d):
    """Relations between canonical names, merged."""
    return G.load_graph(spelt(spark, d), followed(spark, d), props=("amount",))[1].drop("eid")


@query("graph_nodes", f"""WITH {SUPPLY}, {SPELT}, raw AS (SELECT s_raw AS raw, subject AS name FROM spelt UNION SELECT o_raw, object FROM spelt UNION SELECT '주식회사 ' || s_name, s_name FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0)
    SELECT name, array_to_string(list_sort(list(raw)), ';') AS aliases, any_value(CASE WHEN s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0 THEN CAST(s_suppkey AS VARCHAR) END) AS stock_code, coalesce(bool_or(s_suppkey % 2 = 0 AND s_suppkey % 3 <> 0), false) AS in_universe FROM raw LEFT JOIN supplier ON s_name = name GROUP BY name""")  # fmt: skip
def graph_nodes(spark, d):
    """Companies with all their spellings; those that are followed have their code."""
    return G.load_graph(spelt(spark, d), followed(spark, d), props=("amount",))[0].select("name", F.array_join("aliases", ";").alias("aliases"), "stock_code", "in_universe")


@query("list_companies", "SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') AS stock_code, s_name AS corp_name, n_name AS sector FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def list_companies(spark, d):
    from ..functions.text import code6

    s, n = table(spark, d, "supplier"), table(spark, d, "nation")
    return s.join(n, s.s_nationkey == n.n_nationkey).select(code6(F.col("s_suppkey").cast("string")).alias("stock_code"), F.col("s_name").alias("corp_name"), F.col("n_name").alias("sector"))


@query("pattern_supplier_of_nation", WHOLE + " SELECT DISTINCT o.src AS supplier, o.dst AS nation, s.dst AS customer FROM e o JOIN e s ON o.src = s.src WHERE o.rel = 'OFFICER_OF' AND s.rel = 'SUPPLIES_TO'")
def pattern_supplier_of_nation(spark, d):
    e = graph(spark, d)
    a = e.where("rel = 'OFFICER_OF'").select(F.col("src").alias("supplier"), F.col("dst").alias("nation"))
    b = e.where("rel = 'SUPPLIES_TO'").select(F.col("src").alias("supplier"), F.col("dst").alias("customer"))
    return a.join(b, "supplier").distinct().select("supplier", "nation", "customer")


@query("pattern_parent_of_parent", WHOLE + " SELECT DISTINCT a.src AS start, a.dst AS via, b.dst AS end FROM e a JOIN e b ON a.dst = b.src WHERE a.rel = 'OFFICER_OF' AND b.rel = 'SUBSIDIARY_OF' AND a.src <> b.dst")
def pattern_parent_of_parent(spark, d):
    return G.pattern_path(graph(spark, d), "OFFICER_OF", "SUBSIDIARY_OF")


@query("pattern_home_market", f"""WITH {SUPPLY}, {STATE}, sold AS (SELECT DISTINCT s.subject AS src, n_name AS dst FROM supply s JOIN customer ON s.object = c_name JOIN nation ON c_nationkey = n_nationkey)
    SELECT src, dst FROM sold INTERSECT SELECT src, dst FROM state WHERE rel = 'OFFICER_OF'""")  # fmt: skip
def pattern_home_market(spark, d):
    """Suppliers that sell to customers of their own nation: pairs linked by both relations, of which one points from the nation."""
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    home = c.join(n, c.c_nationkey == n.n_nationkey).select(F.col("c_name").alias("dst"), "n_name")
    sold = graph(spark, d).where("rel = 'SUPPLIES_TO'").join(home, "dst").select(F.col("n_name").alias("src"), F.lit("BUYS_FROM").alias("rel"), F.col("src").alias("dst"))
    return G.pattern_both(graph(spark, d).select("src", "rel", "dst").unionByName(sold), "OFFICER_OF", "BUYS_FROM", turned=True)


@query("pattern_common_customers", WHOLE + f" SELECT dst AS name FROM e WHERE rel = 'SUPPLIES_TO' AND src IN ('{SEED}', 'Supplier#000000002') GROUP BY dst HAVING count(DISTINCT src) = 2")
def pattern_common_customers(spark, d):
    return G.pattern_common(graph(spark, d), "SUPPLIES_TO", [SEED, "Supplier#000000002"])


NAMES = "n AS (SELECT DISTINCT p_name AS name, regexp_replace(p_name, '[\\s()]+', '', 'g') AS k FROM part WHERE length(regexp_replace(p_name, '[\\s()]+', '', 'g')) >= 2)"
QUESTIONS = "q AS (SELECT l_orderkey * 10 + l_linenumber AS id, min('who makes ' || p_name || ' for ' || l_returnflag) AS question FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1)"


def questions(spark, d):
    li, p = table(spark, d, "lineitem"), table(spark, d, "part")
    each = li.join(p, li.l_partkey == p.p_partkey).groupBy((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"))
    return each.agg(F.min(F.concat(F.lit("who makes "), "p_name", F.lit(" for "), "l_returnflag")).alias("question"))


@query("entity_link", f"WITH {NAMES}, {QUESTIONS} SELECT id, name FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY length(name) DESC, name) AS rn FROM q JOIN n ON contains(regexp_replace(question, '[\\s()]+', '', 'g'), k) OR (length(k) >= 4 AND contains(regexp_replace(question, '[\\s()]+', '', 'g'), left(k, 4)))) WHERE rn <= 3")
def entity_link(spark, d):
    names = table(spark, d, "part").select(F.col("p_name").alias("name"))
    return G.mentioned(G.link(questions(spark, d), names), "id").select("id", "name")
