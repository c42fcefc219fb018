"""Tiered lookup, kinds of names and matched statistics against plain versions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import gene_index as gi


def plain_lookup(query, names):
    g, low = query.lower(), [(i, n.lower()) for i, n in names]
    ensembl = lambda s: len(s) >= 8 and s.startswith("ens") and any(c.isdigit() for c in s)
    exact, symbol, ensg = {}, {}, {}
    for i, n in low:
        core = n.split("/")[0]
        exact.setdefault(n, i)
        symbol.setdefault(core.rsplit("_")[-1], i)
        if ensembl(core.split("_")[0]):
            ensg.setdefault(core.split("_")[0], i)
    core = g.split("/")[0]
    s, head = core.split("_")[-1], core.split("_")[0]
    for tier, table in ((1, exact), (2, symbol), (3, ensg)):
        if g in table:
            return table[g], tier
    if s != g and s in symbol:
        return symbol[s], 4
    if ensembl(head) and head in ensg:
        return ensg[head], 4
    aliases = [b for a, b in gi.RENAMES if a == s] + [a for a, b in gi.RENAMES if b == s]
    for old, new in gi.FAMILIES:
        for a, b in ((old, new), (new, old)):
            if s.startswith(a) and s[len(a) :].isdigit():
                aliases.append(f"{b}{int(s[len(a) :])}")
    for alias in aliases:
        for table in (exact, symbol):
            if alias in table:
                return table[alias], 5
    for i, n in low:
        if n.endswith(f"_{g}") or n.startswith(f"{g}_") or f"_{g}_" in n:
            return i, 6
    return None


def test_match_genes_by_tiers(spark):
    random.seed(3)
    symbols = ["CD8A", "H4C3", "MARCHF2", "SEPTIN7", "MTARC1", "TP53", "ACTB", "MARCH9", "hist1h1b", "GPR56", "a_b", "x"]
    names = []
    for i in range(120):
        s = random.choice(symbols)
        e = f"ENSG0000{random.randrange(12)}"
        names.append((i, random.choice([s, f"{e}_{s}", e, f"{s}/count/spliced", f"{e}_{s}/m6a", f"x_{s}_y", f"{s}_z", f"w_x_{s}"])))
    names = sorted(set(names))[:60] + [(200, "ENSG00009999_TP53"), (201, "left_mid_part_right")]
    queries = [*symbols, "cd8a", "ENSG00003", "ensg00007_none", "ENSG00003_CD8A", "HIST1H4C", "h1-5", "MARCH2", "march02", "SEPT7", "marc1", "adgre5", "nothing", "b_x", "y", "z", "w_x", "x_CD8A", "CD8A/other", "", "marchf9", "march", "ens1", "ensg00009999", "mid", "MID_part", "left"]
    got = {r.query: (r.row_id, r.tier) for r in gi.match_genes(spark.createDataFrame([(q,) for q in [*queries, None]], "query string"), spark.createDataFrame([*names, (999, None)], "row_id long, name string")).collect()}
    want = {q: w for q in queries if (w := plain_lookup(q, names))}
    assert got == want and {t for _, t in want.values()} == {1, 2, 3, 4, 5, 6}
    pairs = {tuple(r) for r in gi.flexible_pairs(spark.createDataFrame([(q,) for q in queries], "query string"), spark.createDataFrame(names, "row_id long, name string")).collect()}
    assert pairs == {(q, i) for q in queries for i, n in names if q and f"_{q.lower()}_" in f"_{n.lower()}_"}


def test_kinds_of_names(spark):
    names = {"chr1:10-20": ("1", 10, 20), "CHR2_5_9": ("2", 5, 9), "X-1-2": ("x", 1, 2), "1_9_5": None, "A_B": None, "gene": None, "1_2_x": None}
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name: tuple(r.l) if r.l else None for r in df.select("name", gi.parse_locus(F.col("name")).alias("l")).collect()} == names
    rules = {"exact": "ENSG1_CD8A_Gene_Expression", "gene": "CD8A", "mixed": "CD8A"}
    for kind, want in rules.items():
        assert spark.range(1).select(gi.canonical(F.lit("ENSG1_CD8A_Gene_Expression"), kind)).first()[0] == want
    assert spark.range(1).select(gi.canonical(F.lit("chr1:10-20"), "mixed"), gi.canonical(F.lit("Actin"), "mixed"), gi.canonical(F.lit("MyGene"), "gene")).first()[:] == ("1_10_20", "Actin", "MyGene")
    kinds = {"mixed": ["1_1_2", "a_b", *"cdefg"], "locus": ["1_1_2", "2_3_4", "x"], "gene": ["a_b", "c"], "exact": ["a", "b", "a_b"]}
    for want, some in kinds.items():
        assert gi.detect_kind(spark.createDataFrame([(n,) for n in some], "name string")) == want
    assert gi.detect_kind(df.where("false")) == "exact"


@pytest.mark.parametrize("seed", [1, 2])
def test_matched_statistics(spark, seed):
    random.seed(seed)
    cells = {(g, c): float(random.randrange(1, 9)) for g in range(6) for c in range(10) if random.random() < 0.5}
    groups = {c: c % 3 for c in range(9)}
    near = {(c, random.choice([x for x in range(10) if x != c])): random.random() * 30 for c in range(8) for _ in range(3)}
    imputed, residual = {}, {}
    for c, s in groups.items():
        mine = {k[1]: math.exp(-d + min(x for (q, _), x in near.items() if q == c)) for k, d in near.items() if k[0] == c}
        total = sum(mine.values())
        hat = {g: sum(w / total * cells.get((g, i), 0.0) for i, w in mine.items()) for g in range(6)} if mine else {}
        x, h = sum(v for (_, j), v in cells.items() if j == c), sum(hat.values())
        for g in range(6):
            v, z = cells.get((g, c)), hat.get(g, 0.0)
            if v is None and not z:
                continue
            imputed[g, s] = imputed.get((g, s), 0.0) + z
            residual[g, s] = residual.get((g, s), 0.0) + ((v / (z * (x / h)) if z > 0 else v) if v is not None else 0.0)
    got = gi.matched_statistics(
        spark.createDataFrame([(*k, v) for k, v in cells.items()], "row_id long, col_id long, val double"), spark.createDataFrame(list(groups.items()), "col_id long, sample int"), spark.createDataFrame([(*k, v) for k, v in near.items()], "query long, id long, distance double")
    ).collect()
    assert {(r.row_id, r.sample) for r in got} == set(imputed)
    assert all(abs(r.imputed - imputed[r.row_id, r.sample]) < 1e-9 and abs(r.residual - residual[r.row_id, r.sample]) < 1e-9 for r in got)


def test_matched_statistics_shuffle_no_pairs_of_columns_and_rows(spark):
    """A thousand columns matched with three others of a thousand rows each: the three million products are never shuffled."""
    written = lambda: sum(e.totalShuffleWrite() for e in (lambda x: [x.apply(i) for i in range(x.size())])(spark.sparkContext._jsc.sc().statusStore().executorList(False)))
    hubs = spark.range(3000).selectExpr("id % 1000 AS row_id", "id div 1000 AS col_id", "1D + id % 7 AS val")
    cells = hubs.unionAll(spark.range(10, 1010).selectExpr("id % 10 AS row_id", "id AS col_id", "2D AS val"))
    groups = spark.range(1010).selectExpr("id AS col_id", "id % 2 AS sample")
    near = spark.range(3000).selectExpr("10 + id div 3 AS query", "id % 3 AS id", "double(id % 3) AS distance")
    before = written()
    found = {(r.row_id, r.sample): r for r in gi.matched_statistics(cells, groups, near).collect()}
    assert written() - before < 1_000_000
    w = [math.exp(-i) / sum(math.exp(-j) for j in range(3)) for i in range(3)]
    value = lambda row, col: 1.0 + (1000 * col + row) % 7
    assert all(abs(found[row, s].imputed - 500 * sum(w[i] * value(row, i) for i in range(3))) < 1e-6 for row in (0, 3, 999) for s in (0, 1))
