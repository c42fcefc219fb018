"""Graphs as edge tables: nearest neighbours, kNN graphs, shared neighbours, cores, clusters."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import table
from ..plans.components import components
from ..plans.ranking import positions
from ..plans.scratch import forget, materialize
from .neighbours import knn


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))


@register("knn_join", """WITH d AS (SELECT q.vec_id AS query, p.vec_id AS id, list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS distance FROM embeddings q, embeddings p WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d) SELECT query, id, rank, round(distance, 5) AS distance FROM r WHERE rank <= 10""")
def _knn(spark, d):
    v = _vectors(spark, d)
    return knn(v.where("id % 100 = 0"), v, 10).select("query", "id", F.col("rank").cast("long").alias("rank"), F.round("distance", 5).alias("distance"))


def knn_weights(neighbours: DataFrame) -> DataFrame:
    """(query, id, weight): shares proportional to exp(-d / (2 tau^2)) with tau^2 the median squared distance of the query."""
    n = neighbours.withColumn("t", F.median("distance").over(Window.partitionBy("query")))
    n = n.withColumn("e", F.exp(-F.col("distance") / (2 * F.greatest("t", F.lit(1e-12)))))
    return n.select("query", "id", (F.col("e") / F.sum("e").over(Window.partitionBy("query"))).alias("weight"))


@register("knn_label_impute", """WITH d AS (SELECT q.vec_id AS query, p.vec_id AS id, p.label, list_sum(list_transform(list_zip(q.embedding, p.embedding), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) ** 2)) AS distance FROM embeddings q, embeddings p),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY round(distance, 9), id) AS rank FROM d), k AS (SELECT *, exp(-distance / (2 * greatest(median(distance) OVER (PARTITION BY query), 1e-12))) AS e FROM r WHERE rank <= 10)
SELECT query, label, round(sum(e) / any_value(t), 5) AS share FROM (SELECT *, sum(e) OVER (PARTITION BY query) AS t FROM k) GROUP BY query, label""")
def _impute(spark, d):
    """Shares of labels among the ten nearest of every embedding, itself included."""
    v = _vectors(spark, d)
    w = knn_weights(knn(v, v, 10))
    labels = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label")
    return w.join(labels, "id").groupBy("query", "label").agg(F.round(F.sum("weight"), 5).alias("share"))


def canonical_edges(edges: DataFrame) -> DataFrame:
    """(u, v) with u < v, distinct; self-loops and nulls go. edges: (a, b)."""
    return edges.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct()


def _edges(spark, d) -> DataFrame:
    """Parts on consecutive lines of an order: a co-purchase graph over all parts."""
    l = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("a"))
    after = l.select("l_orderkey", (F.col("line") - 1).alias("line"), F.col("a").alias("b"))
    return canonical_edges(l.join(after, ["l_orderkey", "line"]))


_E = "e AS MATERIALIZED (SELECT DISTINCT least(a.l_partkey, b.l_partkey) AS u, greatest(a.l_partkey, b.l_partkey) AS v FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 AND a.l_partkey <> b.l_partkey)"
_ADJ = "j AS (SELECT u AS n, v AS m FROM e UNION ALL SELECT v, u FROM e)"


@register("edges_canonical", f"WITH {_E} SELECT u, v FROM e")
def _canonical(spark, d):
    return _edges(spark, d)


def adjacency(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionAll(edges.select(F.col("v"), F.col("u")))


@register("graph_degrees", f"WITH {_E}, {_ADJ} SELECT n, count(*) AS degree FROM j GROUP BY n")
def _degrees(spark, d):
    return adjacency(_edges(spark, d)).groupBy("n").agg(F.count("*").alias("degree"))


def oriented(edges: DataFrame) -> DataFrame:
    """(u, v, low, high): every edge with the end of fewer neighbours first (ties by id). No node is the low end of more edges than the square root of twice their number."""
    degree = adjacency(edges).groupBy("n").agg(F.count("*").alias("d"))
    e = edges.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    up = (F.col("du") < F.col("dv")) | ((F.col("du") == F.col("dv")) & (F.col("u") < F.col("v")))
    return e.select("u", "v", F.when(up, F.col("u")).otherwise(F.col("v")).alias("low"), F.when(up, F.col("v")).otherwise(F.col("u")).alias("high"))


def shared_neighbours(edges: DataFrame) -> DataFrame:
    """(u, v, shared): the number of common neighbours of each edge, 0 included.

    Each triangle is found once, as a pair of edges from its node of the lowest degree that a third edge closes, so hubs list no pairs.
    """
    e = materialize(oriented(edges), "oriented")
    pairs = e.select("low", F.col("high").alias("x")).join(e.select("low", F.col("high").alias("y")), "low").where("x < y")
    closed = pairs.join(e.select(F.col("u").alias("x"), F.col("v").alias("y")), ["x", "y"])
    sides = closed.select(F.explode(F.array(*(F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")) for a, b in (("low", "x"), ("low", "y"), ("x", "y"))))).alias("e")).select("e.*")
    return e.select("u", "v").join(sides.groupBy("u", "v").agg(F.count("*").alias("shared")), ["u", "v"], "left").na.fill(0)


_SH = "s AS (SELECT e.u, e.v, count(b.n) AS shared FROM e LEFT JOIN j a ON a.n = e.u LEFT JOIN j b ON b.n = e.v AND b.m = a.m GROUP BY ALL)"


@register("graph_shared_neighbours", f"WITH {_E}, {_ADJ}, {_SH} SELECT u, v, shared FROM s")
def _shared(spark, d):
    return shared_neighbours(_edges(spark, d))


@register("graph_prune_shared", f"WITH {_E}, {_ADJ}, {_SH} SELECT u, v FROM s WHERE shared >= 1")
def _prune(spark, d):
    return shared_neighbours(_edges(spark, d)).where("shared >= 1").select("u", "v")


def _listed(around: DataFrame, degree: DataFrame, least: int) -> DataFrame:
    """(u, v), u < v, of the pairs with so many common neighbours: every node is sent the lists of its neighbours' larger neighbours, and counts them in its own task."""
    kept = around.join(degree.where("d > 1").select(F.col("n").alias("m")), "m", "left_semi").join(degree.where(f"d >= {least}").select("n"), "n", "left_semi")
    lists = kept.groupBy("m").agg(F.sort_array(F.collect_list("n")).alias("all"))
    sent = lists.select("all", F.posexplode("all").alias("at", "u")).where("at + 1 < size(all)").select("u", F.expr("slice(all, at + 2, size(all))").alias("after"))
    return sent.repartition("u").select("u", F.explode("after").alias("v")).groupBy("u", "v").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("u", "v")


def _by_prefix(around: DataFrame, degree: DataFrame, ranked: DataFrame, least: int) -> DataFrame:
    """The same pairs: candidates meet at neighbours other than the least - 1 of the highest degree, and are counted on the neighbours of their end of the lower degree."""
    front = ranked.where(f"at <= size - {least - 1}").select("n", "m")
    pairs = front.select(F.col("n").alias("u"), "m").join(front.select(F.col("n").alias("v"), "m"), "m").where("u < v").select("u", "v").distinct()
    pairs = pairs.join(degree.toDF("u", "du"), "u").join(degree.toDF("v", "dv"), "v")
    few = pairs.select("u", "v", F.when(F.col("du") <= F.col("dv"), F.col("u")).otherwise(F.col("v")).alias("n"), F.when(F.col("du") <= F.col("dv"), F.col("v")).otherwise(F.col("u")).alias("other"))
    both = few.join(ranked.select("n", "m"), "n").join(around.select(F.col("n").alias("other"), "m"), ["other", "m"])
    return both.groupBy("u", "v").agg(F.count("*").alias("shared")).where(F.col("shared") >= least).select("u", "v")


#: Neighbours of a node at most for the lists of augment_snn(), and listed pairs for each end of an edge that need no look at the other way.
LISTED, CHEAP = 20_000, 256


def augment_snn(edges: DataFrame, least: int, listed: int = LISTED, cheap: int = CHEAP) -> DataFrame:
    """edges and every other pair with at least so many common neighbours; unchanged for 0.

    Pairs are counted at the nodes that they share, or, where that lists more than candidates and their
    counting would, by prefixes: two nodes with that many in common share one besides the least - 1 neighbours
    of the highest degree of each, so a hub brings only those together that have few better ones. Both ways
    give the same pairs; a graph with a node of more than `listed` neighbours always takes the second.
    """
    if least == 0:
        return edges
    edges = materialize(edges, "edges")
    around = adjacency(edges)
    degree = materialize(around.groupBy("n").agg(F.count("*").alias("d")), "degrees")
    pairs_of = F.sum(F.col("d") * (F.col("d") - 1) / 2)
    most, ends, pairs, mean = (x or 0 for x in degree.agg(F.max("d"), F.sum("d"), pairs_of, F.avg("d")).first())
    lists = most <= listed
    if not lists or pairs > cheap * ends:
        ranked = positions(around.join(degree.toDF("m", "dm"), "m"), ["n"], ["dm", "m"], "at", "size").drop("__bucket")
        ranked = materialize(ranked.where(f"size >= {least}"), "around")
        met = ranked.where(f"at <= size - {least - 1}").groupBy("m").agg(F.count("*").alias("d")).agg(pairs_of).first()[0] or 0
        lists &= pairs <= met * (1 + mean)
    more = _listed(around, degree, least) if lists else _by_prefix(around, degree, ranked, least)
    return edges.union(more).distinct()


@register("graph_augment_snn", f"WITH {_E}, {_ADJ} SELECT u, v FROM e UNION SELECT a.n, b.n FROM j a JOIN j b ON a.m = b.m AND a.n < b.n GROUP BY ALL HAVING count(*) >= 2")
def _augment(spark, d):
    return augment_snn(_edges(spark, d), 2)


def cap_degree(edges: DataFrame, most: int) -> DataFrame:
    """Per node the best edges by (shared neighbours, then smaller neighbour); an edge stays if either end keeps it."""
    s = shared_neighbours(edges)
    ends = s.select(F.col("u").alias("n"), F.col("v").alias("m"), "u", "v", "shared").unionAll(s.select("v", "u", "u", "v", "shared"))
    r = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("shared"), "m"))
    return ends.withColumn("r", r).where(F.col("r") <= most).select("u", "v").distinct()


@register("graph_cap_degree", f"""WITH {_E}, {_ADJ}, {_SH}, b AS (SELECT u AS n, v AS m, u, v, shared FROM s UNION ALL SELECT v, u, u, v, shared FROM s)
SELECT DISTINCT u, v FROM (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY n ORDER BY shared DESC, m) <= 2)""")
def _cap(spark, d):
    return cap_degree(_edges(spark, d), 2)


def k_core(edges: DataFrame, least: int) -> DataFrame:
    """Drops edges at nodes of fewer than `least` edges until none is left to drop."""
    while True:
        weak = adjacency(edges).groupBy("n").count().where(F.col("count") < least).select("n")
        rest = materialize(edges.join(weak.select(F.col("n").alias("u")), "u", "left_anti").join(weak.select(F.col("n").alias("v")), "v", "left_anti").select("u", "v"), "core")
        if rest.count() == edges.count():
            return rest
        forget(edges)
        edges = rest


@register("graph_two_core")
def _core(spark, d):
    return k_core(materialize(_edges(spark, d), "edges"), 2)


def connected(edges: DataFrame) -> DataFrame:
    """(n, component): the smallest node reachable, by star steps."""
    return components(edges.select(F.col("u").alias("a"), F.col("v").alias("b"))).withColumnRenamed("vertex", "n")


@register("graph_components", f"WITH RECURSIVE {_E}, {_ADJ}, r AS (SELECT n, n AS c FROM (SELECT DISTINCT n FROM j) UNION SELECT j.m, r.c FROM r JOIN j ON j.n = r.n WHERE r.c < j.m) SELECT n, min(c) AS component FROM r GROUP BY n")
def _components(spark, d):
    return connected(_edges(spark, d))


def cluster_network(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b, weight): edges between clusters a < b, summed; those inside a cluster drop. labels: (n, c)."""
    x = edges.join(labels.toDF("u", "cu"), "u").join(labels.toDF("v", "cv"), "v").where("cu <> cv")
    return x.groupBy(F.least("cu", "cv").alias("a"), F.greatest("cu", "cv").alias("b")).agg(F.count("*").alias("weight"))


def _labels(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("n"), (F.col("p_size") % 4).cast("long").alias("c"))


_L = "c AS (SELECT p_partkey AS n, (p_size % 4)::BIGINT AS c FROM part)"


@register("graph_cluster_network", f"WITH {_E}, {_L} SELECT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b, count(*) AS weight FROM e JOIN c x ON x.n = u JOIN c y ON y.n = v WHERE x.c <> y.c GROUP BY ALL")
def _network(spark, d):
    return cluster_network(_edges(spark, d), _labels(spark, d))


@register("graph_collapse_pairs", f"WITH {_E}, {_L} SELECT DISTINCT least(x.c, y.c) AS a, greatest(x.c, y.c) AS b FROM e JOIN c x ON x.n = u JOIN c y ON y.n = v")
def _collapse(spark, d):
    """Unordered label pairs, self-pairs kept."""
    l = _labels(spark, d)
    return _edges(spark, d).join(l.toDF("u", "x"), "u").join(l.toDF("v", "y"), "v").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


@register("graph_cpm", f"""WITH {_E}, {_L}, m AS (SELECT count(*)::DOUBLE AS m FROM e), i AS (SELECT count(*)::DOUBLE AS w FROM e JOIN c x ON x.n = u JOIN c y ON y.n = v WHERE x.c = y.c), k AS (SELECT sum(w * w) AS s FROM (SELECT c, count(*)::DOUBLE AS w FROM (SELECT u AS n FROM e UNION ALL SELECT v FROM e) JOIN c USING (n) GROUP BY c))
SELECT round((2 * w - 1.0 * s / (2 * m)) / (2 * m), 8) AS quality FROM m, i, k""")
def _cpm(spark, d):
    """Quality of a partition: (2 w_inside - gamma sum(W_c^2) / 2m) / 2m with degree weights."""
    e, l = _edges(spark, d), _labels(spark, d)
    m = e.agg(F.count("*").cast("double").alias("m"))
    i = e.join(l.toDF("u", "x"), "u").join(l.toDF("v", "y"), "v").where("x = y").agg(F.count("*").cast("double").alias("w"))
    k = adjacency(e).join(l, "n").groupBy("c").agg(F.count("*").cast("double").alias("w")).agg(F.sum(F.col("w") * F.col("w")).alias("s"))
    return m.join(F.broadcast(i)).join(F.broadcast(k)).select(F.round((2 * F.col("w") - F.col("s") / (2 * F.col("m"))) / (2 * F.col("m")), 8).alias("quality"))


@register("compact_labels", "WITH f AS (SELECT p_brand, min(p_partkey) AS first FROM part GROUP BY 1), r AS (SELECT p_brand, row_number() OVER (ORDER BY first) - 1 AS label FROM f) SELECT p_partkey, label FROM part JOIN r USING (p_brand)")
def _compact(spark, d):
    """Labels renumbered 0.. in first-seen order; only the distinct labels are ranked."""
    p = table(spark, d, "part")
    first = p.groupBy("p_brand").agg(F.min("p_partkey").alias("first")).withColumn("label", F.row_number().over(Window.orderBy("first")) - 1)
    return p.join(first, "p_brand").select("p_partkey", "label")


@register("graph_union_sources", f"WITH {_E}, a AS (SELECT u, v, (u + v) % 7 AS w, 1 AS s FROM e WHERE u % 3 <> 0 UNION ALL SELECT u, v, (u * v) % 5, 2 FROM e WHERE u % 2 = 0) SELECT u, v, min(w)::BIGINT AS distance, CASE WHEN count(DISTINCT s) = 2 THEN 'Both' WHEN min(s) = 1 THEN 'Primary' ELSE 'Secondary' END AS source FROM a GROUP BY u, v")
def _union(spark, d):
    """Union of two edge sets with their origin and the smaller distance."""
    e = _edges(spark, d)
    a = e.where("u % 3 <> 0").selectExpr("u", "v", "(u + v) % 7 AS w", "1 AS s").unionAll(e.where("u % 2 = 0").selectExpr("u", "v", "(u * v) % 5 AS w", "2 AS s"))
    source = F.when(F.min("s") != F.max("s"), "Both").when(F.min("s") == 1, "Primary").otherwise("Secondary")
    return a.groupBy("u", "v").agg(F.min("w").cast("long").alias("distance"), source.alias("source"))
