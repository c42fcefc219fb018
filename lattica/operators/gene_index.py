"""Genes looked up in a vocabulary of feature names by tiers, kinds of names, and matched statistics.

Every tier is an equality of keys, so a lookup is one hash join of exploded keys and never
compares each query with each name: a name's runs of parts between underscores are keys too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import names as N
from ..matrix import part_by_order, table
from ..plans.scratch import broadcast_small, materialize

#: Gene symbols that HGNC renamed, old and new.
RENAMES = (
    ("h1f0", "h1-0"), ("h1fx", "h1-10"), ("hist1h1b", "h1-5"), ("hist1h1c", "h1-2"), ("hist1h1d", "h1-3"), ("hist1h1e", "h1-4"), ("hist1h2ac", "h2ac6"), ("hist1h2bk", "h2bc12"), ("hist1h4c", "h4c3"),
    ("hist2h2be", "h2bc21"), ("hist3h2a", "h2ac25"), ("h2afx", "h2ax"), ("h2afv", "h2az2"), ("h2afz", "h2az1"), ("h2afy", "macroh2a1"), ("h3f3a", "h3-3a"), ("h3f3b", "h3-3b"),
    ("marc1", "mtarc1"), ("marc2", "mtarc2"), ("sepp1", "selenop"), ("selt", "selenot"), ("sepw1", "selenow"), ("fam129a", "niban1"), ("fam129b", "niban2"), ("fam129c", "niban3"), ("rarres3", "plaat4"),
    ("fyb", "fyb1"), ("cd97", "adgre5"), ("gpr56", "adgrg1"), ("kiaa0101", "pclaf"), ("c10orf54", "vsir"), ("tmem66", "saraf"), ("atpif1", "atp5if1"), ("fam46c", "tent5c"), ("whsc1", "nsd2"),
)
#: Types of features that stand behind a name's last underscore.
TYPES = ("Gene_Expression", "Gene", "Antibody_Capture", "CRISPR_Guide_Capture", "Multiplexing_Capture", "Custom", "Peaks")
#: Families renamed by rule, old and new prefix before a number.
FAMILIES = (("march", "marchf"), ("sept", "septin"))


def _core(low: Column) -> Column:
    return F.substring_index(low, "/", 1)


def _ensembl(part: Column) -> Column:
    return (F.length(part) >= 8) & part.startswith("ens") & part.rlike("[0-9]")


def _aliases(symbol: Column) -> Column:
    """Other symbols of a symbol in lower case, in the order in which they are tried."""
    renames = lambda pairs: F.create_map(*(F.lit(x) for p in pairs for x in p))
    found = [F.element_at(renames(RENAMES), symbol), F.element_at(renames([(b, a) for a, b in RENAMES]), symbol)]
    for old, new in FAMILIES:
        for a, b in ((old, new), (new, old)):
            number = F.substring(symbol, len(a) + 1, 40).try_cast("long")
            found.append(F.when(symbol.rlike(f"^{a}[0-9]+$") & (number < 1 << 32), F.concat(F.lit(b), number.cast("string"))))
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _runs(low: Column) -> Column:
    """All runs of neighbouring parts between underscores, but the whole."""
    parts = F.split(low, "_")
    n = F.size(parts)
    runs = F.flatten(F.transform(F.sequence(F.lit(1), n), lambda i: F.transform(F.sequence(i, n), lambda j: F.struct((j - i + 1).alias("n"), F.array_join(F.slice(parts, i, j - i + 1), "_").alias("run")))))
    return F.array_distinct(F.transform(F.filter(runs, lambda r: r["n"] < n), lambda r: r["run"]))


def match_genes(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, row_id, tier) of the queries that match: the first row of the first tier that any row matches.

    Tiers, letter case ignored: 1 the whole name, 2 its last part (a symbol) without what follows a slash, 3 its leading
    Ensembl id, 4 the query's own symbol or, after it, its Ensembl id, 5 other symbols of the query's symbol, as whole
    names and then as symbols, 6 whole parts anywhere in the name. queries: (query); names: (row_id, name).
    """
    low = F.lower("name")
    core = _core(low)
    head = F.substring_index(core, "_", 1)
    keyed = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    own = F.array(keyed("exact", low), keyed("symbol", F.substring_index(core, "_", -1)), keyed("ensg", F.when(_ensembl(head), head)))
    known = names.where("name IS NOT NULL").select("row_id", F.explode(F.concat(own, F.transform(_runs(low), lambda r: keyed("run", r)))).alias("k")).select("row_id", "k.*")
    known = known.where("key IS NOT NULL").groupBy("kind", "key").agg(F.min("row_id").alias("row_id"))
    g = F.lower("query")
    core, symbol = _core(g), F.substring_index(_core(g), "_", -1)
    head = F.substring_index(core, "_", 1)
    tried = lambda tier, step, kind, key: F.struct(F.lit(tier).alias("tier"), (F.lit(step) if isinstance(step, int) else step).alias("step"), F.lit(kind).alias("kind"), key.alias("key"))
    aliases = F.flatten(F.transform(_aliases(symbol), lambda a, i: F.array(tried(5, 2 * i, "exact", a), tried(5, 2 * i + 1, "symbol", a))))
    plan = F.array(tried(1, 0, "exact", g), tried(2, 0, "symbol", g), tried(3, 0, "ensg", g), tried(4, 0, "symbol", F.when(symbol != g, symbol)), tried(4, 1, "ensg", F.when(_ensembl(head), head)), tried(6, 0, "run", g))
    asked = queries.where("query IS NOT NULL").select("query").distinct().select("query", F.explode(F.concat(plan, aliases)).alias("k")).select("query", "k.*").where("key IS NOT NULL")
    found = asked.join(known, ["kind", "key"]).groupBy("query").agg(F.min(F.struct("tier", "step", "row_id")).alias("best"))
    return found.select("query", "best.row_id", "best.tier")


def flexible_pairs(queries: DataFrame, names: DataFrame) -> DataFrame:
    """(query, row_id): every pair where the name is the query or holds it as whole parts between underscores, letter case ignored; a join of keys."""
    low = F.lower("name")
    runs = names.where("name IS NOT NULL").select("row_id", F.explode(F.array_distinct(F.concat(F.array(low), _runs(low)))).alias("key"))
    asked = queries.where("query IS NOT NULL").select("query").distinct().withColumn("key", F.lower("query"))
    return asked.join(runs, "key").select("query", "row_id")


def parse_locus(name: Column) -> Column:
    """struct(chr, start, end) of chr1:1000-2000, 1_1000_2000 and the like in any letter case, if the end is not before the start; else null."""
    parts = F.split(F.regexp_replace(F.lower(name), "^chr", ""), "[:_-]", 3)
    start, end = (F.when(F.get(parts, F.lit(i)).rlike("^[+]?[0-9]+$"), F.get(parts, F.lit(i)).try_cast("long")) for i in (1, 2))
    return F.when((F.size(parts) == 3) & (end >= start), F.struct(parts[0].alias("chr"), start.alias("start"), end.alias("end")))


def canonical(name: Column, kind: str) -> Column:
    """A name under a kind's rule: exact as it is, gene the last part after an underscore, its type of feature left out, locus as chr_start_end, mixed by what the name looks like."""
    gene = F.substring_index(F.regexp_replace(name, f"_({'|'.join(TYPES)})$", ""), "_", -1)
    rules = {"exact": name, "gene": gene, "locus": N.canon_locus(name)}
    rules["mixed"] = F.when(parse_locus(name).isNotNull(), rules["locus"]).when(F.contains(name, F.lit("_")), gene).otherwise(name)
    return rules[kind]


def detect_kind(names: DataFrame) -> str:
    """The kind of a set of names: mixed if a tenth or more are loci and a tenth or more others have an underscore, locus or gene for half or more, else exact. names: (name)."""
    locus = parse_locus(F.col("name")).isNotNull()
    n, loci, genes = names.agg(F.count("*"), F.count_if(locus), F.count_if(~locus & F.contains("name", F.lit("_")))).first()
    if not n:
        return "exact"
    if loci >= 0.1 * n and genes >= 0.1 * n:
        return "mixed"
    return "locus" if loci >= 0.5 * n else "gene" if genes >= 0.5 * n else "exact"


def _vocabulary(spark, d) -> DataFrame:
    """Parts under names of several conventions."""
    p, k = table(spark, d, "part"), F.col("p_partkey") % 5
    symbol = F.when(F.col("p_partkey") % 11 == 0, F.concat(F.lit("MARCHF"), F.col("p_size").cast("string"))).otherwise(F.concat(F.lit("GENE"), F.col("p_partkey").cast("string")))
    ensembl = F.concat(F.lit("ENSG0000"), F.col("p_partkey").cast("string"))
    name = F.when(k == 0, symbol).when(k == 1, F.concat_ws("_", ensembl, symbol)).when(k == 2, F.concat(symbol, F.lit("/count/spliced"))).when(k == 3, F.concat_ws("_", F.lit("x"), symbol, F.lit("y"))).otherwise(ensembl)
    return p.select(F.col("p_partkey").alias("row_id"), name.alias("name"))


_VOCABULARY = """s AS (SELECT p_partkey AS row_id, CASE WHEN p_partkey % 11 = 0 THEN 'MARCHF' || p_size ELSE 'GENE' || p_partkey END AS symbol, 'ENSG0000' || p_partkey AS ensembl FROM part),
v AS (SELECT row_id, lower(CASE row_id % 5 WHEN 0 THEN symbol WHEN 1 THEN ensembl || '_' || symbol WHEN 2 THEN symbol || '/count/spliced' WHEN 3 THEN 'x_' || symbol || '_y' ELSE ensembl END) AS name FROM s),
k AS (SELECT row_id, name, string_split(string_split(name, '/')[1], '_')[-1] AS symbol, string_split(string_split(name, '/')[1], '_')[1] AS head FROM v)"""


@register("match_genes", f"""WITH {_VOCABULARY}, q AS (SELECT DISTINCT CASE l_linenumber % 5 WHEN 0 THEN 'gene' || l_partkey WHEN 1 THEN 'ENSG0000' || l_partkey WHEN 2 THEN 'ENSG0000' || l_partkey || '_other' WHEN 3 THEN 'March' || l_partkey % 50 ELSE 'none' || l_partkey END AS query FROM lineitem),
g AS (SELECT query, lower(query) AS g, string_split(string_split(lower(query), '/')[1], '_')[-1] AS symbol, string_split(string_split(lower(query), '/')[1], '_')[1] AS head FROM q),
ens AS (SELECT * FROM k WHERE length(head) >= 8 AND head LIKE 'ens%' AND regexp_matches(head, '[0-9]')),
t AS (SELECT query, row_id, 1 AS tier, 0 AS step FROM g JOIN k ON k.name = g UNION ALL SELECT query, row_id, 2, 0 FROM g JOIN k ON k.symbol = g UNION ALL SELECT query, row_id, 3, 0 FROM g JOIN ens ON ens.head = g
  UNION ALL SELECT query, row_id, 4, 0 FROM g JOIN k ON k.symbol = g.symbol WHERE g.symbol <> g UNION ALL SELECT query, row_id, 4, 1 FROM g JOIN ens ON ens.head = g.head WHERE length(g.head) >= 8 AND g.head LIKE 'ens%' AND regexp_matches(g.head, '[0-9]')
  UNION ALL SELECT query, row_id, 5, 0 FROM g JOIN k ON k.name = 'marchf' || substr(g.symbol, 6) WHERE regexp_matches(g.symbol, '^march[0-9]+$') UNION ALL SELECT query, row_id, 5, 1 FROM g JOIN k ON k.symbol = 'marchf' || substr(g.symbol, 6) WHERE regexp_matches(g.symbol, '^march[0-9]+$')
  UNION ALL SELECT query, row_id, 6, 0 FROM g JOIN v ON v.name = 'x_' || g || '_y')
SELECT query, row_id, tier FROM t QUALIFY row_number() OVER (PARTITION BY query ORDER BY tier, step, row_id) = 1""")
def _match_genes(spark, d):
    l, k = table(spark, d, "lineitem"), F.col("l_linenumber") % 5
    p = F.col("l_partkey").cast("string")
    q = F.when(k == 0, F.concat(F.lit("gene"), p)).when(k == 1, F.concat(F.lit("ENSG0000"), p)).when(k == 2, F.concat(F.lit("ENSG0000"), p, F.lit("_other"))).when(k == 3, F.concat(F.lit("March"), (F.col("l_partkey") % 50).cast("string"))).otherwise(F.concat(F.lit("none"), p))
    return match_genes(l.select(q.alias("query")), _vocabulary(spark, d))


def matched_statistics(cells: DataFrame, groups: DataFrame, neighbours: DataFrame) -> DataFrame:
    """(row_id, sample, imputed, residual): sums over the columns of a sample of what their matched columns hold, and of the columns themselves divided by it.

    A column's matched cells are averaged with weights in proportion to exp(-distance); its own cells are divided by
    this average, scaled to the column's own total, where it has any. cells: (row_id, col_id, val); groups: (col_id, sample);
    neighbours: (query, id, distance) as of neighbours.knn(). Columns without a match keep their cells and impute nothing.
    """
    cells = materialize(cells.select("row_id", "col_id", "val"), "cells")
    by = Window.partitionBy("query")
    w = neighbours.withColumn("e", F.exp(F.min("distance").over(by) - F.col("distance")))
    w = materialize(w.select(F.col("query").alias("col_id"), F.col("id").alias("neighbour"), (F.col("e") / F.sum("e").over(by)).alias("weight")), "weights")
    there = cells.withColumnsRenamed({"col_id": "neighbour", "val": "there"}).join(w.select("neighbour").distinct(), "neighbour", "left_semi")
    there = materialize(there, "matched")
    # What a sample imputes and a column's total are sums of products, taken factor by factor.
    weights = w.join(groups, "col_id").groupBy("neighbour", "sample").agg(F.sum("weight").alias("weight"))
    imputed = there.join(weights, "neighbour").groupBy("row_id", "sample").agg(F.sum(F.col("there") * F.col("weight")).alias("imputed"))
    held = w.join(there.groupBy("neighbour").agg(F.sum("there").alias("held")), "neighbour").groupBy("col_id").agg(F.sum(F.col("held") * F.col("weight")).alias("h"))
    # A matched average is needed only where the column has a cell itself.
    hat = cells.join(there.select("row_id").distinct(), "row_id", "left_semi").join(w, "col_id").join(broadcast_small(there), ["neighbour", "row_id"])
    hat = hat.groupBy("col_id", "row_id").agg(F.sum(F.col("there") * F.col("weight")).alias("hat"))
    totals = cells.groupBy("col_id").agg(F.sum("val").alias("x")).join(held, "col_id", "left").join(groups, "col_id")
    own = cells.join(hat, ["col_id", "row_id"], "left").join(totals.select("col_id", "sample", F.when(F.col("h") > 0, F.col("x") / F.col("h")).otherwise(1.0).alias("scale")), "col_id")
    ratio = F.when(F.col("hat") > 0, F.col("val") / (F.col("hat") * F.col("scale"))).otherwise(F.col("val"))
    none = F.lit(0.0)
    residual = own.groupBy("row_id", "sample").agg(F.sum(F.coalesce(ratio, none)).alias("residual"))
    out = imputed.select("row_id", "sample", F.coalesce("imputed", none).alias("imputed"), none.alias("residual")).unionAll(residual.select("row_id", "sample", none, "residual"))
    return out.groupBy("row_id", "sample").agg(F.sum("imputed").alias("imputed"), F.sum("residual").alias("residual"))


_S = """x AS (SELECT l_suppkey AS row_id, l_partkey AS col_id, sum(l_quantity)::DOUBLE AS val FROM lineitem GROUP BY ALL), g AS (SELECT p_partkey AS col_id, p_size % 3 AS sample FROM part),
n AS (SELECT l_partkey AS query, l_orderkey % 40 AS id, min(l_discount) * 10.0 AS distance FROM lineitem WHERE l_partkey <> l_orderkey % 40 GROUP BY ALL), w AS (SELECT query, id, exp(-distance) / sum(exp(-distance)) OVER (PARTITION BY query) AS w FROM n),
h AS (SELECT w.query AS col_id, x.row_id, sum(val * w) AS hat FROM w JOIN x ON x.col_id = w.id GROUP BY ALL), t AS (SELECT a.col_id, CASE WHEN h > 0 THEN x / h ELSE 1 END AS scale FROM (SELECT col_id, sum(val) AS x FROM x GROUP BY 1) a LEFT JOIN (SELECT col_id, sum(hat) AS h FROM h GROUP BY 1) b USING (col_id)),
b AS (SELECT coalesce(x.col_id, h.col_id) AS col_id, coalesce(x.row_id, h.row_id) AS row_id, val, hat FROM x FULL JOIN h ON h.col_id = x.col_id AND h.row_id = x.row_id)"""


@register("matched_statistics", f"WITH {_S} SELECT row_id, sample, round(sum(coalesce(hat, 0)), 5) AS imputed, round(sum(coalesce(CASE WHEN hat > 0 THEN val / (hat * scale) ELSE val END, 0)), 5) AS residual FROM b JOIN g USING (col_id) LEFT JOIN t USING (col_id) GROUP BY ALL")
def _matched(spark, d):
    """Parts by suppliers, matched through a table of neighbours derived from orders."""
    l = table(spark, d, "lineitem")
    cells = l.groupBy(F.col("l_suppkey").alias("row_id"), F.col("l_partkey").alias("col_id")).agg(F.sum("l_quantity").cast("double").alias("val"))
    near = l.where("l_partkey <> l_orderkey % 40").groupBy(F.col("l_partkey").alias("query"), (F.col("l_orderkey") % 40).alias("id")).agg((F.min("l_discount") * 10.0).alias("distance"))
    groups = table(spark, d, "part").select(F.col("p_partkey").alias("col_id"), (F.col("p_size") % 3).alias("sample"))
    found = matched_statistics(cells, groups, near)
    return found.select("row_id", "sample", F.round("imputed", 5).alias("imputed"), F.round("residual", 5).alias("residual"))
