"""Property graph as node and edge tables: building, paths of one and two hops, rendering, linking, overview."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import canonical_name
from .forms import STATES

# Order of relations in answers.
PRIORITY = ["SUPPLIES_TO", "INVESTS_IN", "OWNS_STAKE", "GUARANTEES_DEBT_OF", "SUBSIDIARY_OF", "OFFICER_OF", "RELATED_PARTY_OF"]
SEEDS, PATHS = 3, 60


def names_of(*columns: DataFrame) -> DataFrame:
    """(raw, name): the different spellings in tables of one column each, and their canonical names, worked out once for each."""
    ends = [c.toDF("raw") for c in columns]
    both = ends[0]
    for more in ends[1:]:
        both = both.unionByName(more)
    return both.where("raw IS NOT NULL").distinct().withColumn("name", canonical_name(F.col("raw")))


def spellings(triples: DataFrame) -> DataFrame:
    return names_of(triples.select("subject"), triples.select("object"))


def nodes(triples: DataFrame) -> DataFrame:
    """(name, aliases): one node for each canonical name, with all spellings."""
    return spellings(triples).groupBy("name").agg(F.array_sort(F.collect_set("raw")).alias("aliases"))


def canonical(triples: DataFrame) -> DataFrame:
    """triples with canonical names as subject and object; rows without one of them are dropped, as they are no edges."""
    names = spellings(triples)
    for end in ("subject", "object"):
        triples = triples.join(names.select(F.col("raw").alias(end), F.col("name").alias("_name")), end).withColumn(end, F.col("_name")).drop("_name")
    return triples


def load_graph(triples: DataFrame, companies: DataFrame | None = None, order: str = "triple_id", props: tuple[str, ...] = ("amount_krw", "ratio_pct", "start_date", "end_date", "note")) -> tuple[DataFrame, DataFrame]:
    """Stored relations and the followed companies to (nodes, edges), between canonical names.

    nodes: (name, aliases, corp_code, stock_code, in_universe); companies (corp_code, corp_name, stock_code, in_universe) that are followed and have a
    stock code are nodes even without a relation. edges: (eid, src, rel, dst, rcept_no, *props, n_support): event relations one for each filing, with the last value of each
    property that isn't null; state relations one for each pair, with filing and properties of the first. order: the column that says which row comes first."""
    rows = canonical(triples)
    events = event_edges(rows, order, list(props), clean=True)
    states = state_edges(rows, [order, "rcept_no", *props], clean=True).drop(order)
    edges = events.unionByName(states).select(F.concat_ws("|", "subject", "predicate", "object", F.when(~F.col("predicate").isin(*STATES), F.col("rcept_no").cast("string"))).alias("eid"), F.col("subject").alias("src"), F.col("predicate").alias("rel"), F.col("object").alias("dst"), "rcept_no", *props, "n_support")
    found = spellings(triples).withColumns({"corp_code": F.lit(None).cast("string"), "stock_code": F.lit(None).cast("string"), "in_universe": F.lit(None).cast("boolean")})
    if companies is not None:
        own = companies.where("in_universe AND stock_code IS NOT NULL").select(F.col("corp_name").alias("raw"), F.col("corp_code").cast("string").alias("corp_code"), F.col("stock_code").cast("string").alias("stock_code"))
        found = found.unionByName(own.select("raw", canonical_name(F.col("raw")).alias("name"), "corp_code", "stock_code", F.lit(True).alias("in_universe")))
    last = F.max(F.when(F.col("in_universe"), F.struct("corp_code", "stock_code")))
    made = found.groupBy("name").agg(F.array_sort(F.collect_set("raw")).alias("aliases"), last.alias("_c"))
    return made.select("name", "aliases", "_c.corp_code", "_c.stock_code", F.col("_c").isNotNull().alias("in_universe")), edges


def event_edges(triples: DataFrame, order: str, props: list[str], clean: bool = False) -> DataFrame:
    """One edge for each (subject, predicate, object, filing) of canonical names; of each property the last that isn't null. clean: names are canonical already."""
    keys = ["subject", "predicate", "object", "rcept_no"]
    rows = triples.where(~F.col("predicate").isin(*STATES))
    rows = rows if clean else canonical(rows)
    return rows.groupBy(*keys).agg(*(F.max_by(p, F.when(F.col(p).isNotNull(), F.col(order))).alias(p) for p in props), F.count("*").alias("n_support"))


def state_edges(triples: DataFrame, order: list[str], clean: bool = False) -> DataFrame:
    """One edge for each (subject, predicate, object) of canonical names, with its earliest evidence. clean: names are canonical already."""
    rows = triples.where(F.col("predicate").isin(*STATES))
    rows = rows if clean else canonical(rows)
    keys = ["subject", "predicate", "object"]
    first = rows.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_first"), F.count("*").alias("n_support"))
    return first.select(*keys, "_first.*", "n_support")


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge (eid, src, rel, dst, rcept_no) from either end as (a, b, start); a self-loop once."""
    there = edges.select("eid", F.col("src").alias("a"), F.col("dst").alias("b"), "rel", F.col("src").alias("start"), "rcept_no")
    back = edges.where("src <> dst").select("eid", F.col("dst").alias("a"), F.col("src").alias("b"), "rel", F.col("src").alias("start"), "rcept_no")
    return there.unionByName(back)


def paths(edges: DataFrame, seeds: DataFrame, hops: int = 2, by: str | None = None) -> DataFrame:
    """Different undirected paths of 1 to hops (at most 2) edges from the seeds (name), ends apart, no edge twice: (depth, names, rels, starts, rcepts).

    by: a column of the seeds that tells questions apart; each question's paths begin at its own seeds, and have its value in that column."""
    hops = max(1, min(2, hops))
    u = both_ways(edges)
    of = [by] if by else []
    if by:
        seeds = mentioned(seeds, by).select(by, F.col("name").alias("a"))
    else:
        seeds = F.broadcast(seeds.select(F.col("name").alias("a")).orderBy(F.desc(F.length("a")), "a").limit(SEEDS))
    own = u.join(seeds, "a")
    one = own.where("a <> b").select(*of, F.lit(1).alias("depth"), F.array("a", "b").alias("names"), F.array("rel").alias("rels"), F.array("start").alias("starts"), F.array("rcept_no").alias("rcepts"))
    if hops == 1:
        return one.distinct()
    second = u.select(F.col("eid").alias("eid2"), F.col("a").alias("b"), F.col("b").alias("c"), F.col("rel").alias("rel2"), F.col("start").alias("start2"), F.col("rcept_no").alias("rcept2"))
    two = own.join(second, "b").where("eid <> eid2 AND a <> c").select(*of, F.lit(2).alias("depth"), F.array("a", "b", "c").alias("names"), F.array("rel", "rel2").alias("rels"), F.array("start", "start2").alias("starts"), F.array("rcept_no", "rcept2").alias("rcepts"))
    return one.unionByName(two).distinct()


def render(names: Column, rels: Column, starts: Column) -> Column:
    """A -[R]-> B where the relation starts at A, else A <-[R]- B, and so on along the path."""
    step = lambda r, k: F.concat(F.when(F.get(starts, k) == F.get(names, k), F.concat(F.lit(" -["), r, F.lit("]-> "))).otherwise(F.concat(F.lit(" <-["), r, F.lit("]- "))), F.get(names, k + 1))
    return F.concat(F.get(names, F.lit(0)), F.array_join(F.transform(rels, step), ""))


def rank(rels: Column) -> Column:
    """Place of a path's most important relation; unknown ones come last."""
    place = F.transform(rels, lambda r: F.nullif(F.array_position(F.array(*map(F.lit, PRIORITY)), r), F.lit(0)))
    return F.coalesce(F.array_min(F.array_compact(place)), F.lit(len(PRIORITY) + 1))


def citation(rcepts: Column) -> Column:
    return F.get(F.array_compact(rcepts), F.lit(0))


def search(edges: DataFrame, seeds: DataFrame, hops: int = 2, limit: int = PATHS) -> DataFrame:
    """Evidence texts, shorter paths first, each once: (text, depth, rank, rcept_no, entities, rel_types)."""
    found = paths(edges, seeds, hops).select(render(F.col("names"), F.col("rels"), F.col("starts")).alias("text"), "depth", rank(F.col("rels")).alias("rank"), citation(F.col("rcepts")).alias("rcept_no"), F.col("names").alias("entities"), F.col("rels").alias("rel_types"))
    once = found.groupBy("text").agg(F.min(F.struct("depth", "rank", "rcept_no")).alias("_k"), F.first("entities").alias("entities"), F.first("rel_types").alias("rel_types"))
    return once.select("text", "_k.*", "entities", "rel_types").orderBy("depth", "rank", "text").limit(limit)


def search_each(edges: DataFrame, seeds: DataFrame, by: str, hops: int = 2, limit: int = PATHS) -> DataFrame:
    """As search, for many questions at once: seeds (by, name) to (by, pos, text, rcept_no), at most `limit` texts a question."""
    found = paths(edges, seeds, hops, by).select(by, render(F.col("names"), F.col("rels"), F.col("starts")).alias("text"), "depth", rank(F.col("rels")).alias("rank"), citation(F.col("rcepts")).alias("rcept_no"))
    once = found.groupBy(by, "text").agg(F.min(F.struct("depth", "rank", "rcept_no")).alias("_k")).select(by, "text", "_k.*")
    return once.withColumn("pos", F.row_number().over(W.partitionBy(by).orderBy("depth", "rank", "text"))).where(F.col("pos") <= limit).select(by, "pos", "text", "rcept_no")


def link(questions: DataFrame, names: DataFrame, text: str = "question", name: str = "name") -> DataFrame:
    """(question row, name): names that a question mentions, by their whole key or, from four characters on, by its first four.

    Either way the question holds the key's first four characters, or the whole shorter key, so the join is one of equal pieces: each
    question gives its pieces of these lengths once. The names are broadcast while their bytes are within 32 MB."""
    bare = lambda c: F.regexp_replace(c, r"(?U)[\s()]+", "")
    n = names.select(F.col(name).alias("name"), bare(F.col(name)).alias("_key")).where(F.length("_key") >= 2).distinct()
    n = n.select("name", F.substring("_key", 1, 4).alias("_piece"))
    size, *there = n.agg(F.sum(F.length("_piece") + F.length("name") + 16), *(F.max(F.length("_piece") == k) for k in (2, 3, 4))).first()
    n = F.broadcast(n) if (size or 0) <= 32 << 20 else n
    q = F.col("_q")
    cuts = lambda k: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(q) - (k - 1))), lambda at: F.substring(q, at, F.lit(k)))
    pieces = [cuts(k) for k, some in zip((2, 3, 4), there) if some]
    if not pieces:
        return questions.join(n, F.lit(False)).drop("_piece")
    cut = questions.withColumn("_q", bare(F.col(text))).withColumn("_piece", F.explode(F.array_distinct(F.concat(*pieces))))
    return cut.join(n, "_piece").drop("_q", "_piece")


def mentioned(linked: DataFrame, by: str, most: int = SEEDS) -> DataFrame:
    """The longest names of each question first."""
    w = W.partitionBy(by).orderBy(F.desc(F.length("name")), "name")
    return linked.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def with_both(evidence: DataFrame, a: str, b: str) -> DataFrame:
    """Evidence whose entities hold both names; blanks don't count."""
    has = lambda x: F.exists("entities", lambda e: F.contains(F.replace(e, F.lit(" ")), F.lit(x.replace(" ", ""))))
    return evidence.where(has(a) & has(b))


def shared_partners(evidence: DataFrame, a: str, b: str) -> DataFrame:
    """Names that stand in evidence (entities) of both: an entity belongs to a company if it holds the name, blanks aside; the two themselves don't count."""
    holds = lambda e, x: F.contains(F.replace(e, F.lit(" ")), F.lit(x.replace(" ", "")))
    side = lambda x: evidence.where(F.exists("entities", lambda e: holds(e, x))).select(F.explode("entities").alias("name")).distinct()
    return side(a).intersect(side(b)).where(~holds(F.col("name"), a) & ~holds(F.col("name"), b))


def pattern_path(edges: DataFrame, first: str, second: str) -> DataFrame:
    """(start, via, end): a -[first]-> b -[second]-> c along the edges' directions, each once: what the parent of a company supplies, say."""
    a = edges.where(F.col("rel") == first).select(F.col("src").alias("start"), F.col("dst").alias("via")).distinct()
    b = edges.where(F.col("rel") == second).select(F.col("src").alias("via"), F.col("dst").alias("end")).distinct()
    return a.join(b, "via").where("start <> end").select("start", "via", "end")


def pattern_both(edges: DataFrame, one: str, other: str, turned: bool = False) -> DataFrame:
    """(src, dst): pairs that are linked by both relations, the second from dst to src if turned: subsidiaries that their parent guarantees, say.

    One aggregation over the edges of both kinds, as a join would need two."""
    kept = edges.where(F.col("rel").isin(one, other))
    flip = F.lit(turned) & (F.col("rel") == other)
    pairs = kept.select(F.when(flip, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(flip, F.col("src")).otherwise(F.col("dst")).alias("dst"), "rel")
    return pairs.groupBy("src", "dst").agg(F.max(F.col("rel") == one).alias("_a"), F.max(F.col("rel") == other).alias("_b")).where("_a AND _b").select("src", "dst")


def pattern_common(edges: DataFrame, rel: str, names: list[str], incoming: bool = False) -> DataFrame:
    """(name): what all the names have the relation to, or, if incoming, what has it to all of them: companies that supply two customers, say."""
    near, far = ("dst", "src") if incoming else ("src", "dst")
    wanted = sorted(set(names))
    found = edges.where((F.col("rel") == rel) & F.col(near).isin(wanted)).groupBy(F.col(far).alias("name")).agg(F.count_distinct(near).alias("_n"))
    return found.where(F.col("_n") == len(wanted)).select("name")


def degrees(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("name"), "rel").groupBy("name", "rel").agg(F.count("*").alias("degree"))


def overview(edges: DataFrame, universe: DataFrame, examples: int = 10) -> DataFrame:
    """(n_nodes, name): examples from the universe if it has nodes, else the first names."""
    names = edges.select(F.explode(F.array("src", "dst")).alias("name")).distinct()
    total = names.agg(F.count("*").alias("n_nodes"))
    known = names.join(universe.select("name").distinct(), "name", "left_semi").orderBy("name").limit(examples).withColumn("_known", F.lit(0))
    first = names.orderBy("name").limit(examples).withColumn("_known", F.lit(1))
    best = known.unionByName(first).withColumn("_best", F.min("_known").over(W.partitionBy()))  # 2 * examples rows at most
    return best.where("_known = _best").orderBy("name").limit(examples).crossJoin(F.broadcast(total)).select("n_nodes", "name")
