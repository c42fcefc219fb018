"""Selecting, masking and stacking matrices by index and name; scalar transforms and memberships of their cells."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..matrix import X, Matrix, part_by_order, table
from ..plans.ranking import global_position
from ..plans.spread import spread
from .stats import moments, parse_index_spec, rounded


def take_rows(m: Matrix, ids: list[int]) -> DataFrame:
    """(position, col_id, val): the rows in the order asked for, repeats kept; unknown ids give nothing. ids: a caller's short list."""
    wanted = m.cells.sparkSession.createDataFrame(list(enumerate(ids)), "position long, row_id long")
    return F.broadcast(wanted).join(m.cells, "row_id").select("position", "col_id", "val")


@register("matrix_take_rows", f"WITH {X}, w AS (SELECT unnest(range(6))::BIGINT AS position, unnest([1, 2, 3, 7, 7, 99999999])::BIGINT AS row_id) SELECT position, col_id, val FROM x JOIN w USING (row_id)")
def _take_rows(spark, d):
    return take_rows(part_by_order(spark, d), parse_index_spec("1-3,7,7,99999999"))


def rows_triplets(m: Matrix, rows: DataFrame) -> DataFrame:
    """(position, row_id, col_id, val) of the rows asked for; a row without cells, or out of range, gives one line without a column. rows: (position, row_id)."""
    return rows.join(m.cells, "row_id", "left").select("position", "row_id", "col_id", "val")


@register("matrix_rows_triplets", f"WITH {X}, w AS (SELECT p_partkey - 1 AS position, p_partkey * 2 AS row_id FROM part) SELECT position, w.row_id, col_id, val FROM w LEFT JOIN x USING (row_id)")
def _rows_triplets(spark, d):
    rows = table(spark, d, "part").select((F.col("p_partkey") - 1).alias("position"), (F.col("p_partkey") * 2).alias("row_id"))
    return rows_triplets(part_by_order(spark, d), rows)


@register("matrix_row_names", "SELECT p_partkey AS row_id, p_name AS name FROM part")
def _row_names(spark, d):
    return part_by_order(spark, d).features


@register("matrix_column_names", "SELECT o_orderkey AS col_id, o_orderkey::VARCHAR AS name FROM orders")
def _column_names(spark, d):
    return part_by_order(spark, d).samples


def renumbered(kept: DataFrame, id_: str) -> DataFrame:
    """kept with new, 0 and up in order of the id."""
    return global_position(kept, id_).withColumn("new", F.col("position") - 1).drop("position")


def subset_columns(m: Matrix, keep: DataFrame) -> Matrix:
    """The columns whose name is kept, numbered from 0 in the matrix's order, whatever the order asked for; other names are ignored. keep: (name)."""
    kept = renumbered(m.samples.join(keep.select("name").distinct(), "name", "left_semi"), "col_id")
    cells = m.cells.join(kept.select("col_id", "new"), "col_id").select("row_id", F.col("new").alias("col_id"), "val")
    return Matrix(cells, m.features, kept.select(F.col("new").alias("col_id"), "name"))


def subset_rows(m: Matrix, keep: DataFrame) -> Matrix:
    """As subset_columns, for rows."""
    kept = renumbered(m.features.join(keep.select("name").distinct(), "name", "left_semi"), "row_id")
    cells = m.cells.join(kept.select("row_id", "new"), "row_id").select(F.col("new").alias("row_id"), "col_id", "val")
    return Matrix(cells, kept.select(F.col("new").alias("row_id"), "name"), m.samples)


@register("matrix_subset_columns", f"""WITH {X}, k AS (SELECT o_orderkey AS col_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE o_orderstatus = 'F')
SELECT row_id, new AS col_id, val FROM x JOIN k USING (col_id)""")
def _subset_columns(spark, d):
    keep = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("name")).unionAll(spark.range(1).select(F.lit("absent").alias("name")))
    return subset_columns(part_by_order(spark, d), keep).cells.select("row_id", "col_id", "val")


@register("matrix_subset_rows", f"""WITH {X}, n AS (SELECT DISTINCT p_name FROM part WHERE p_size < 20), k AS (SELECT p_partkey AS row_id, row_number() OVER (ORDER BY p_partkey) - 1 AS new FROM part SEMI JOIN n USING (p_name))
SELECT new AS row_id, col_id, val FROM x JOIN k USING (row_id)""")
def _subset_rows(spark, d):
    return subset_rows(part_by_order(spark, d), table(spark, d, "part").where("p_size < 20").select(F.col("p_name").alias("name"))).cells.select("row_id", "col_id", "val")


@register("matrix_subset_both", f"""WITH {X}, r AS (SELECT p_partkey AS row_id, row_number() OVER (ORDER BY p_partkey) - 1 AS a FROM part SEMI JOIN (SELECT p_name FROM part WHERE p_size < 20) USING (p_name)),
c AS (SELECT o_orderkey AS col_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS b FROM orders WHERE o_orderstatus = 'F') SELECT a AS row_id, b AS col_id, val FROM x JOIN r USING (row_id) JOIN c USING (col_id)""")
def _subset_both(spark, d):
    rows = table(spark, d, "part").where("p_size < 20").select(F.col("p_name").alias("name"))
    columns = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("name"))
    return subset_columns(subset_rows(part_by_order(spark, d), rows), columns).cells.select("row_id", "col_id", "val")


def mask_columns(m: Matrix, keep: DataFrame) -> Matrix:
    """The columns marked true, numbered from 0 in order. keep: (col_id, keep), one row for each column; anything else is an error."""
    odd = m.samples.join(keep, "col_id", "full_outer").where("name IS NULL OR keep IS NULL")
    if keep.count() != m.n_cols or not odd.isEmpty():
        raise ValueError("a mask needs one value for each column")
    kept = renumbered(m.samples.join(keep.where("keep"), "col_id", "left_semi"), "col_id")
    cells = m.cells.join(kept.select("col_id", "new"), "col_id").select("row_id", F.col("new").alias("col_id"), "val")
    return Matrix(cells, m.features, kept.select(F.col("new").alias("col_id"), "name"))


@register("matrix_mask_columns", f"WITH {X}, k AS (SELECT o_orderkey AS col_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS new FROM orders WHERE o_totalprice > 100000) SELECT row_id, new AS col_id, val FROM x JOIN k USING (col_id)")
def _mask(spark, d):
    keep = table(spark, d, "orders").select(F.col("o_orderkey").alias("col_id"), (F.col("o_totalprice") > 100000).alias("keep"))
    return mask_columns(part_by_order(spark, d), keep).cells.select("row_id", "col_id", "val")


def concatenate(blocks: list[tuple[DataFrame, int]], axis: str) -> DataFrame:
    """(row_id, col_id, val) of blocks side by side (axis col_id) or stacked (row_id); each block's ids go on where the last one's ended. blocks: cells and their size along the axis."""
    out, at = None, 0
    for cells, size in blocks:
        moved = cells.select(*((F.col(c) + at).alias(c) if c == axis else F.col(c) for c in ("row_id", "col_id", "val")))
        out, at = moved if out is None else out.unionByName(moved), at + size
    return out


for _axis, _other in (("col_id", "row_id"), ("row_id", "col_id")):

    @register(f"matrix_concatenate_{_axis[:3]}", f"WITH {X}, n AS (SELECT max({_axis}) + 1 AS n FROM x) SELECT {_axis}, {_other}, val FROM x UNION ALL SELECT {_axis} + n, {_other}, 2 * val FROM x, n")
    def _concatenate(spark, d, axis=_axis):
        cells = part_by_order(spark, d).cells
        size = cells.agg(F.max(axis) + 1).first()[0]
        return concatenate([(cells, size), (cells.withColumn("val", F.col("val") * 2), size)], axis)


def row_stats_across(backends: DataFrame, names: DataFrame, n: int) -> DataFrame:
    """nnz, tot, mu and sig per row name over the columns of several backends, n in all. backends: (backend, row_id, col_id, val). names: (row_id, name)."""
    return backends.join(names, "row_id").groupBy("name").agg(*moments(n))


@register("matrix_row_stats_across", """WITH b AS (SELECT l_linestatus AS backend, l_partkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS val FROM lineitem GROUP BY ALL), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT backend, col_id FROM b))
SELECT p_type AS name, count(*) FILTER (val > 0) AS nnz, sum(val) AS tot, round(sum(val) / any_value(n), 6) AS mu, round(sqrt(greatest(0, sum(val * val) / any_value(n) - (sum(val) / any_value(n)) ** 2)), 6) AS sig FROM b JOIN part ON p_partkey = row_id CROSS JOIN n GROUP BY 1""")
def _row_stats_across(spark, d):
    b = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("backend"), F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    names = table(spark, d, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("name"))
    return rounded(row_stats_across(b, names, b.select("backend", "col_id").distinct().count()), "mu", "sig")


@register("matrix_column_stats_across", """WITH b AS (SELECT l_linestatus AS backend, l_partkey AS row_id, l_orderkey AS col_id, sum(l_quantity) AS val FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size < 25 GROUP BY ALL), n AS (SELECT count(*) AS n FROM part WHERE p_size < 25)
SELECT backend, col_id, count(*) FILTER (val > 0) AS nnz, sum(val) AS tot, round(sum(val) / any_value(n), 6) AS mu, round(sqrt(greatest(0, sum(val * val) / any_value(n) - (sum(val) / any_value(n)) ** 2)), 6) AS sig FROM b CROSS JOIN n GROUP BY ALL""")
def _column_stats_across(spark, d):
    """Column statistics over a selection of rows, over several backends."""
    rows = table(spark, d, "part").where("p_size < 25").select(F.col("p_partkey").alias("row_id"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_linestatus").alias("backend"), F.col("l_partkey").alias("row_id"), F.col("l_orderkey").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    return rounded(b.join(rows, "row_id", "left_semi").groupBy("backend", "col_id").agg(*moments(rows.count())), "mu", "sig")


def centred(cells: DataFrame, m_rows: int) -> DataFrame:
    """(row_id, col_id, val, centred, implicit): stored entries less their column's mean over all rows, stored or not; implicit is what every entry that is not stored becomes."""
    mean = cells.groupBy("col_id").agg((F.sum("val") / m_rows).alias("mean"))
    return cells.join(mean, "col_id").select("row_id", "col_id", "val", (F.col("val") - F.col("mean")).alias("centred"), (-F.col("mean")).alias("implicit"))


@register("matrix_centre_columns", f"WITH {X}, m AS (SELECT col_id, sum(val) / (SELECT count(*) FROM part) AS m FROM x GROUP BY 1) SELECT row_id, col_id, round(val - m, 6) AS centred, round(-m, 6) AS implicit FROM x JOIN m USING (col_id)")
def _centre(spark, d):
    m = part_by_order(spark, d)
    return rounded(centred(m.cells, m.n_rows), "centred", "implicit").drop("val")


def log_softmax(cells: DataFrame) -> DataFrame:
    """(row_id, col_id, val): x - max - ln(sum(exp(x - max))) over the stored entries of a column."""
    top = cells.groupBy("col_id").agg(F.max("val").alias("top"))
    parts = cells.join(top, "col_id").withColumn("x", F.col("val") - F.col("top"))
    total = parts.groupBy("col_id").agg(F.log(F.sum(F.exp("x"))).alias("log"))
    return parts.join(total, "col_id").select("row_id", "col_id", (F.col("x") - F.col("log")).alias("val"))


@register("matrix_log_softmax", f"WITH {X}, t AS (SELECT *, val - max(val) OVER (PARTITION BY col_id) AS v FROM x) SELECT row_id, col_id, round(v - ln(sum(exp(v)) OVER (PARTITION BY col_id)), 6) + 0.0::DOUBLE AS val FROM t")
def _log_softmax(spark, d):
    return log_softmax(part_by_order(spark, d).cells).select("row_id", "col_id", (F.round("val", 6) + F.lit(0.0)).alias("val"))


def sigmoid(x: Column) -> Column:
    """1 / (1 + exp(-x)), from the side that does not overflow."""
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, 1 / (1 + e)).otherwise(e / (1 + e))


@register("sigmoid", "SELECT c_custkey, round(CASE WHEN c_acctbal >= 0 THEN 1 / (1 + exp(-c_acctbal / 1000)) ELSE exp(c_acctbal / 1000) / (1 + exp(c_acctbal / 1000)) END, 9) AS p FROM customer")
def _sigmoid(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.round(sigmoid(F.col("c_acctbal") / 1000), 9).alias("p"))


def sparse_distance(cells: DataFrame, n_rows: int) -> DataFrame:
    """(a, b, distance): sqrt(sum((x - y)**2) / n_rows) for columns a < b with a row in common; for other pairs it follows from their norms alone. From sums of squares and a join on rows."""
    norms = cells.groupBy("col_id").agg(F.sum(F.col("val") * F.col("val")).alias("q"))
    a, b = (cells.select("row_id", F.col("col_id").alias(c), F.col("val").alias(f"v{c}")) for c in "ab")
    dot = a.join(b, "row_id").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("dot"))
    dot = dot.join(norms.select(F.col("col_id").alias("a"), F.col("q").alias("qa")), "a").join(norms.select(F.col("col_id").alias("b"), F.col("q").alias("qb")), "b")
    return dot.select("a", "b", F.sqrt(F.greatest(F.lit(0.0), F.col("qa") + F.col("qb") - 2 * F.col("dot")) / n_rows).alias("distance"))


_NM = "c AS (SELECT l_suppkey % 1000 AS row_id, p_brand AS col_id, sum(l_quantity) AS val FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL)"


@register("sparse_distance", f"""WITH {_NM}, q AS (SELECT col_id, sum(val * val) AS q FROM c GROUP BY 1), d AS (SELECT x.col_id AS a, y.col_id AS b, sum(x.val * y.val) AS dot FROM c x JOIN c y ON x.row_id = y.row_id AND x.col_id < y.col_id GROUP BY ALL)
SELECT a, b, round(sqrt(greatest(0, i.q + j.q - 2 * dot) / 1000), 6) AS distance FROM d JOIN q i ON i.col_id = a JOIN q j ON j.col_id = b""")
def _distance(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    cells = l.groupBy((F.col("l_suppkey") % 1000).alias("row_id"), F.col("p_brand").alias("col_id")).agg(F.sum("l_quantity").alias("val"))
    return rounded(sparse_distance(cells, 1000), "distance")


def _some(matched: DataFrame) -> DataFrame:
    if matched.isEmpty():
        raise ValueError("no column of the matrix is named in the annotation")
    return matched


def onehot(labels: DataFrame, samples: DataFrame) -> DataFrame:
    """(col_id, label, share): 1 for a column's label; columns without one have no row, labels of unknown columns go. No match at all is an error. labels: (name, label)."""
    return _some(samples.join(labels, "name")).select("col_id", "label", F.lit(1.0).alias("share"))


@register("membership_onehot", "SELECT o_orderkey AS col_id, o_orderpriority AS label, 1.0::DOUBLE AS share FROM orders WHERE o_orderstatus <> 'P'")
def _onehot(spark, d):
    o = table(spark, d, "orders")
    labels = o.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").cast("string").alias("name"), F.col("o_orderpriority").alias("label"))
    return onehot(labels, part_by_order(spark, d).samples)


def membership_proportions(wide: DataFrame, samples: DataFrame, name: str) -> DataFrame:
    """(col_id, label, share): a wide table of shares, a column for each label, melted and aligned by name. Shares are copied as they are, zeros and nulls have no row. No match at all is an error."""
    labels = [c for c in wide.columns if c != name]
    known = _some(wide.join(samples.withColumnRenamed("name", "__name"), F.col(name) == F.col("__name")))
    return known.unpivot(["col_id"], labels, "label", "share").where("share <> 0")


@register("membership_proportions", """WITH w AS (SELECT l_orderkey AS col_id, sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END) AS r, sum(CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END) AS a, sum(CASE WHEN l_returnflag = 'N' THEN l_quantity ELSE 0 END) - 20 AS n FROM lineitem GROUP BY 1)
SELECT col_id, label, round(v, 6) AS share FROM (SELECT *, unnest(['r', 'a', 'n']) AS label, unnest([r, a, n]) AS v FROM w) JOIN orders ON o_orderkey = col_id WHERE v <> 0""")
def _proportions(spark, d):
    wide = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("order")).agg(*(F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity")).otherwise(0.0)).alias(f.lower()) for f in "RAN")).withColumn("n", F.col("n") - 20)
    return rounded(membership_proportions(wide, part_by_order(spark, d).samples, "order"), "share")


@register("passing_rows", f"WITH {X} SELECT row_id FROM x GROUP BY 1 HAVING count(*) FILTER (val > 0) >= 20 AND sum(val) >= 600")
def _passing(spark, d):
    """Rows with enough positive columns and, where a least total is asked for, enough of it."""
    return part_by_order(spark, d).cells.groupBy("row_id").agg(F.count_if(F.col("val") > 0).alias("n"), F.sum("val").alias("t")).where("n >= 20 AND t >= 600").select("row_id")


def merge_nearby(sites: DataFrame, key: str, distance: int, ends: DataFrame | None = None) -> DataFrame:
    """(key, site, n): clusters taken from the left, each at most distance from its FIRST site; of a cluster the site with the most ends within half the distance, its borders rounded, the first on ties.

    sites: (key, pos, n); ends: (key, pos, n), by default the sites themselves. Which site opens a cluster depends
    on the one before; keys are dealt to tasks, and a key's positions walked once, from cluster to cluster, with
    ends counted by differences of running sums.
    """
    pos = F.col("pos").cast("long").alias("pos")
    if ends is None:
        both = sites.select(key, pos, F.col("n").cast("long").alias("n"), F.lit(True).alias("__site"))
    else:
        both = sites.select(key, pos, F.lit(0).cast("long").alias("n"), F.lit(True).alias("__site")).unionAll(ends.select(key, pos, F.col("n").cast("long"), F.lit(False)))

    def walk(batches):
        for batch in batches:
            names, runs = batch.column(0), batch.column(1)
            out = [], [], []
            for i, run in enumerate(runs):
                every, count, site = (run.values.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "__site"))
                order = np.argsort(every)
                every, before = every[order], np.concatenate([[0], np.cumsum(count[order])])
                pos = every[site[order]]
                low, high = np.floor(pos - distance / 2 + 0.5), np.floor(pos + distance / 2 + 0.5)
                n = before[np.searchsorted(every, high, "right")] - before[np.searchsorted(every, low, "left")]
                at = 0
                while at < len(pos):
                    end = int(np.searchsorted(pos, pos[at] + distance, "right"))
                    best = at + int(n[at:end].argmax())
                    for column, value in zip(out, (i, pos[best], n[best])):
                        column.append(value)
                    at = end
            yield pa.record_batch([names.take(pa.array(out[0], pa.int64())), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())], names=[key, "site", "n"])

    known = both.where(F.col(key).isNotNull() & F.col("pos").isNotNull()).groupBy(key, "pos").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("__site").alias("__site"))
    runs = known.groupBy(key).agg(F.collect_list(F.struct("pos", "n", "__site")).alias("run"))
    return runs.mapInArrow(walk, f"`{key}` {dict(sites.dtypes)[key]}, site long, n long")


@register("merge_nearby_sites", """WITH RECURSIVE s AS MATERIALIZED (SELECT l_partkey AS gene, date_diff('day', DATE '1970-01-01', l_shipdate::DATE) AS pos, count(*) AS own FROM lineitem GROUP BY ALL),
c AS MATERIALIZED (SELECT s.gene, s.pos, sum(e.own)::BIGINT AS n FROM s JOIN s e ON e.gene = s.gene AND e.pos BETWEEN s.pos - 30 AND s.pos + 30 GROUP BY ALL),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY pos) AS i FROM c),
w AS (SELECT gene, pos, n, i, pos AS start FROM r WHERE i = 1 UNION ALL SELECT r.gene, r.pos, r.n, r.i, CASE WHEN r.pos - w.start > 60 THEN r.pos ELSE w.start END FROM w JOIN r ON r.gene = w.gene AND r.i = w.i + 1)
SELECT gene, arg_max(pos, (n, -pos)) AS site, max(n) AS n FROM w GROUP BY gene, start""")
def _merge_nearby(spark, d):
    lines = table(spark, d, "lineitem")
    l = lines.select(F.col("l_partkey").alias("gene"), F.expr("cast(datediff(l_shipdate, DATE'1970-01-01') AS bigint)").alias("pos"))
    return merge_nearby(spread(l, lines.count(), "gene").groupBy("gene", "pos").agg(F.count("*").alias("n")), "gene", 60)


@register("genome_order", "SELECT p_partkey AS gene, row_number() OVER (ORDER BY p_size, p_retailprice, p_partkey) - 1 AS place FROM part WHERE p_brand <> 'Brand#11'")
def _genome_order(spark, d):
    """Genes numbered by chromosome and position, scaffolds left out."""
    p = table(spark, d, "part").where("p_brand <> 'Brand#11'")
    return global_position(p, "p_size", "p_retailprice", "p_partkey").select(F.col("p_partkey").alias("gene"), (F.col("position") - 1).alias("place"))


def top_hits(results: DataFrame, block: str, least: float = 0.7, most: int = 5) -> DataFrame:
    """Per block the variants and traits of a probability of at least `least`: the `most` largest with their rank, ties by variant and trait, and how many more there are. results: (block, variant, trait, pip)."""
    hits = results.where(F.col("pip") >= least)
    rank = F.row_number().over(Window.partitionBy(block).orderBy(F.desc("pip"), "variant", "trait"))
    shown = hits.withColumn("rank", rank).where(F.col("rank") <= most)  # a limit for each block, taken before the shuffle too
    more = hits.groupBy(block).agg(F.greatest(F.count("*") - most, F.lit(0)).alias("more"))
    return shown.join(more, block)


@register("top_hits", """WITH s AS (SELECT l_suppkey AS block, l_partkey AS variant, l_linenumber AS trait, max(l_discount) * 10.0 AS pip FROM lineitem GROUP BY ALL)
SELECT block, variant, trait, round(pip, 6) AS pip, row_number() OVER (PARTITION BY block ORDER BY pip DESC, variant, trait) AS rank, greatest(count(*) OVER (PARTITION BY block) - 5, 0) AS more FROM s WHERE pip >= 0.7 QUALIFY rank <= 5""")
def _top_hits(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("block"), F.col("l_partkey").alias("variant"), F.col("l_linenumber").alias("trait")).agg((F.max("l_discount") * 10.0).alias("pip"))
    return top_hits(s, "block").select("block", "variant", "trait", F.round("pip", 6).alias("pip"), "rank", "more")


def inclusion_probabilities(samples: DataFrame) -> DataFrame:
    """(variant, pip): 1 less the product over effects of 1 - alpha, averaged over draws. samples: (draw, effect, variant, alpha); a variant without alpha in a draw has 0 there."""
    draws = samples.select("draw").distinct().count()
    each = samples.groupBy("variant", "draw").agg((1 - F.product(1 - F.col("alpha"))).alias("p"))
    return each.groupBy("variant").agg((F.sum("p") / draws).alias("pip"))


@register("inclusion_probabilities", """WITH s AS (SELECT l_linenumber AS draw, l_suppkey % 5 AS effect, l_partkey AS variant, max(l_discount) AS alpha FROM lineitem GROUP BY ALL), n AS (SELECT count(DISTINCT draw) AS n FROM s),
e AS (SELECT variant, draw, 1 - product(1 - alpha) AS p FROM s GROUP BY ALL) SELECT variant, round(sum(p) / any_value(n), 6) AS pip FROM e CROSS JOIN n GROUP BY 1""")
def _inclusion(spark, d):
    s = table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("draw"), (F.col("l_suppkey") % 5).alias("effect"), F.col("l_partkey").alias("variant")).agg(F.max("l_discount").alias("alpha"))
    return rounded(inclusion_probabilities(s), "pip")


def upper_tail_of_half(m: Column, k: Column) -> Column:
    """P(X >= k) for X binomial of m trials of 1/2; k above m counts as m, and without trials the result is 1. By the ratios of successive terms from the last."""
    k = F.least(k, m)
    steps = F.sequence(F.lit(0), F.greatest(m - k - 1, F.lit(0)).cast("int"))
    # Terms C(m, i) for i = m, m - 1, ... k.
    walk = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")), lambda s, j: F.struct((s["term"] * (m - j) / (j + 1)).alias("term"), (s["sum"] + s["term"] * (m - j) / (j + 1)).alias("sum")))
    return F.when((m <= 0) | (k <= 0), 1.0).when(k == m, F.pow(F.lit(2.0), -m)).otherwise(walk["sum"] * F.pow(F.lit(2.0), -m))


@register("binomial_upper_tail", """WITH t AS (SELECT l_partkey AS part, CASE WHEN l_partkey % 9 = 0 THEN 0 ELSE least(count(*), 50) END AS m, least(count(*) FILTER (l_returnflag <> 'N'), 50) + l_partkey % 30 AS k FROM lineitem GROUP BY 1),
p AS (SELECT part, m, k, list_sum(list_transform(range(least(k, m), m + 1), lambda i: exp(lgamma(m + 1) - lgamma(i + 1) - lgamma(m - i + 1) - m * ln(2)))) AS p FROM t) SELECT part, m, k, round(CASE WHEN m = 0 OR k <= 0 THEN 1 ELSE p END, 8) AS p FROM p""")
def _binomial(spark, d):
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.least(F.count("*"), F.lit(50)).alias("m"), F.least(F.count_if(F.col("l_returnflag") != "N"), F.lit(50)).alias("k"))
    t = t.select("part", F.when(F.col("part") % 9 == 0, 0).otherwise(F.col("m")).alias("m"), (F.col("k") + F.col("part") % 30).alias("k"))
    return t.select("part", "m", "k", F.round(upper_tail_of_half(F.col("m"), F.col("k")), 8).alias("p"))


def log_factorial(x: Column) -> Column:
    """ln x!: summed below 32, from there by Stirling's series, whose error is below 1e-15 of the result."""
    import math

    n = x.cast("double")
    far = n * F.log(n) - n + 0.5 * F.log(2 * math.pi * n) + 1 / (12 * n) - 1 / (360 * n * n * n) + 1 / (1260 * F.pow(n, F.lit(5)))
    return F.when(x < 32, F.get(F.array(*(F.lit(math.log(math.factorial(i))) for i in range(32))), F.greatest(x, F.lit(0)).cast("int"))).otherwise(far)


def fisher_greater(a: Column, b: Column, c: Column, d: Column) -> Column:
    """One-sided exact test of a two by two table: the chance of a or more in its corner, the margins held. Tables of any size; the terms run over at most the smaller margin."""
    row, col, n = a + b, a + c, a + b + c + d
    first = log_factorial(row) + log_factorial(n - row) + log_factorial(col) + log_factorial(n - col) - log_factorial(n) - log_factorial(a) - log_factorial(b) - log_factorial(c) - log_factorial(d)
    steps = F.sequence(a.cast("int"), F.least(row, col).cast("int"))
    ratio = lambda i: (row - i) * (col - i) / ((i + 1) * (n - row - col + i + 1)).cast("double")
    walk = F.aggregate(steps, F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum")), lambda s, i: F.struct((s["term"] * ratio(i)).alias("term"), (s["sum"] + s["term"]).alias("sum")))
    return F.least(F.lit(1.0), F.exp(first) * walk["sum"])


@register("fisher_exact_greater", """WITH t AS (SELECT l_partkey AS part, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'O') AS a, count(*) FILTER (l_returnflag = 'R' AND l_linestatus <> 'O') AS b, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus = 'O') AS c, count(*) FILTER (l_returnflag <> 'R' AND l_linestatus <> 'O') AS d FROM lineitem GROUP BY 1)
SELECT part, round(least(1, list_sum(list_transform(range(a, least(a + b, a + c) + 1), lambda i: exp(lgamma(a + b + 1) - lgamma(i + 1) - lgamma(a + b - i + 1) + lgamma(c + d + 1) - lgamma(a + c - i + 1) - lgamma(d - a + i + 1) - lgamma(a + b + c + d + 1) + lgamma(a + c + 1) + lgamma(b + d + 1))))), 8) AS p FROM t""")
def _fisher(spark, d):
    r, o = F.col("l_returnflag") == "R", F.col("l_linestatus") == "O"
    t = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(*(F.count_if(c).alias(n) for n, c in (("a", r & o), ("b", r & ~o), ("c", ~r & o), ("d", ~r & ~o))))
    return t.select("part", F.round(fisher_greater(*map(F.col, "abcd")), 8).alias("p"))


def strip_backend_suffix(path: Column) -> Column:
    """Drops .zarr.zip, .zarr or .h5 from the end."""
    return F.regexp_replace(path, r"\.(zarr\.zip|zarr|h5)$", "")


def basename(path: Column) -> Column:
    """The last part of a path without its last extension, nor one of .zarr, .h5ad and .h5 that is then left, as of sample.zarr.zip."""
    stem = F.regexp_replace(F.substring_index(F.rtrim(path, F.lit("/")), "/", -1), r"(.)\.[^.]*$", "$1")
    return F.regexp_replace(stem, r"\.(zarr|h5ad|h5)$", "")


@register("path_names", """WITH f AS (SELECT n_nationkey AS id, 'data/' || n_name || CASE n_nationkey % 5 WHEN 0 THEN '.zarr' WHEN 1 THEN '.h5' WHEN 2 THEN '.zarr.zip' WHEN 3 THEN '.h5ad.gz' ELSE '.tsv.gz' END AS path FROM nation)
SELECT id, regexp_replace(path, '\\.(zarr\\.zip|zarr|h5)$', '') AS stripped, regexp_replace(regexp_replace(string_split(path, '/')[-1], '(.)\\.[^.]*$', '\\1'), '\\.(zarr|h5ad|h5)$', '') AS base FROM f""")
def _paths(spark, d):
    k = F.col("n_nationkey") % 5
    path = F.concat(F.lit("data/"), "n_name", F.when(k == 0, ".zarr").when(k == 1, ".h5").when(k == 2, ".zarr.zip").when(k == 3, ".h5ad.gz").otherwise(".tsv.gz"))
    return table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), strip_backend_suffix(path).alias("stripped"), basename(path).alias("base"))


def weighted_degrees(edges: DataFrame) -> DataFrame:
    """(n, degree): the summed weight at each node; a self-loop counts twice. edges: (u, v, w)."""
    return edges.select(F.col("u").alias("n"), "w").unionAll(edges.select("v", "w")).groupBy("n").agg(F.sum("w").alias("degree"))


@register("graph_weighted_degrees", """WITH e AS (SELECT o_custkey AS u, l_suppkey AS v, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT n, sum(w) AS degree FROM (SELECT u AS n, w FROM e UNION ALL SELECT v, w FROM e) GROUP BY n""")
def _weighted_degrees(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return weighted_degrees(l.groupBy(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.sum("l_quantity").alias("w")))


def total_weight(edges: DataFrame) -> DataFrame:
    """One row: the summed weight of the edges, each pair of nodes once at its smallest weight, self-loops included. edges: (u, v, w), in any direction."""
    pairs = edges.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.min("w").alias("w"))
    return pairs.agg(F.sum("w").alias("total"))


@register("graph_total_weight", "WITH e AS (SELECT o_custkey AS u, l_suppkey AS v, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY ALL), p AS (SELECT least(u, v) AS u, greatest(u, v) AS v, min(w) AS w FROM e GROUP BY ALL) SELECT sum(w) AS total FROM p")
def _total_weight(spark, d):
    l = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return total_weight(l.groupBy(F.col("o_custkey").alias("u"), F.col("l_suppkey").alias("v")).agg(F.sum("l_quantity").alias("w")))


def knn_graph(neighbours: DataFrame, reciprocal: bool) -> DataFrame:
    """(u, v, distance) with u < v of a table of nearest neighbours (query, id, distance): pairs that name each other (reciprocal), or either of them; the smaller distance. Self pairs go."""
    e = neighbours.where("query <> id").select(F.least("query", "id").alias("u"), F.greatest("query", "id").alias("v"), (F.col("query") < F.col("id")).alias("up"), "distance")
    e = e.groupBy("u", "v").agg(F.count_distinct("up").alias("ways"), F.min("distance").alias("distance"))
    return (e.where("ways = 2") if reciprocal else e).select("u", "v", "distance")


_NN = "g AS (SELECT l_partkey AS q, l_suppkey AS i, min(l_extendedprice) AS distance FROM lineitem GROUP BY ALL), n AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY q ORDER BY distance, i) <= 5)"
for _kind, _having in (("union", ""), ("reciprocal", "HAVING count(DISTINCT q < i) = 2")):

    @register(f"knn_graph_{_kind}", f"WITH {_NN} SELECT least(q, i) AS u, greatest(q, i) AS v, min(distance) AS distance FROM n WHERE q <> i GROUP BY ALL {_having}")
    def _knn_graph(spark, d, reciprocal=_kind == "reciprocal"):
        n = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query"), F.col("l_suppkey").alias("id")).agg(F.min("l_extendedprice").alias("distance"))
        n = n.withColumn("r", F.row_number().over(Window.partitionBy("query").orderBy("distance", "id"))).where("r <= 5")
        return knn_graph(n.select("query", "id", "distance"), reciprocal)
