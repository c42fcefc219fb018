"""Windows carried over between buckets: one key with most rows, many small buckets, plain Python as the measure."""

import random
from statistics import median

import pytest

from lattica.operators import genetics, intervals, windows
from lattica.plans import ranking


@pytest.fixture(autouse=True)
def small_buckets(monkeypatch):
    monkeypatch.setattr(ranking, "MOST", 60)
    monkeypatch.setattr(ranking, "LEAST", 10)


@pytest.fixture(scope="module")
def skewed(spark):
    """One group with nine tenths of the rows, ties, groups of one row, a null group."""
    random.seed(7)
    rows = [(i, "hot" if random.random() < 0.9 else random.choice(["a", "b", None, f"g{i}"]), round(random.random(), 2), random.random() < 0.4, float(random.randrange(1, 9))) for i in range(1500)]
    return rows, spark.createDataFrame(rows, "id long, grp string, p double, hit boolean, w double")


def by_group(rows):
    out = {}
    for r in rows:
        out.setdefault(r[1], []).append(r)
    return out


def test_buckets_of_a_hot_group_are_even(skewed):
    dealt = ranking.ranged(skewed[1], "grp", "p", "id")
    sizes = [r["count"] for r in dealt.groupBy("__bucket", "grp").count().where("grp = 'hot'").collect()]
    assert len(sizes) > 10 and max(sizes) < 10 * median(sizes)
    assert max(r["count"] for r in dealt.groupBy("__bucket").count().collect()) < 10 * median(sizes)


def test_running_measures(skewed):
    rows, df = skewed
    dealt = ranking.ranged(df, "grp", "-p", "id")
    measures = {"n": ("sum", ranking.F.lit(1)), "low": ("min", ranking.F.col("w")), "high": ("max", ranking.F.col("w"))}
    for reverse in (False, True):
        for before in (False, True):
            got = {r.id: (r.n, r.low, r.high, r.all) for r in ranking.running(dealt, ["grp"], ["-p", "id"], measures, {"all": ("sum", ranking.F.col("w"))}, reverse, before).collect()}
            for group in by_group(rows).values():
                order = sorted(group, key=lambda r: (-r[2], r[0]), reverse=reverse)
                for i, r in enumerate(order):
                    seen = [x[4] for x in order[: i + (not before)]]
                    assert got[r[0]] == (len(seen), min(seen, default=None), max(seen, default=None), sum(x[4] for x in group))
    assert ranking.running(ranking.ranged(df.where("false"), "grp", "p"), ["grp"], ["p"], measures).collect() == []


def test_multiple_testing(skewed):
    rows, df = skewed
    q = {r.id: r.q for r in windows.bh_by_group(df, "grp").collect()}
    kept = {by: {r.id for r in windows.bh_reject(df.withColumn("p", df.p * df.p * df.p), "grp", 0.2, by).collect()} for by in (False, True)}
    for group in by_group(rows).values():
        m, low = len(group), 1.0
        order = sorted(group, key=lambda r: (r[2], r[0]))
        for i in range(m - 1, -1, -1):
            low = min(low, order[i][2] * m / (i + 1))
            assert abs(q[order[i][0]] - low) < 1e-12
        for by in (False, True):
            level = 0.2 / (sum(1 / i for i in range(1, m + 1)) if by else 1)
            passed = [r[2] ** 3 for i, r in enumerate(order) if r[2] ** 3 <= level * (i + 1) / m]
            assert {r[0] for r in group} & kept[by] == {r[0] for r in group if passed and r[2] ** 3 <= max(passed)}


def test_harmonic_numbers(spark):
    from pyspark.sql import functions as F

    got = {r.m: r.h for r in spark.range(400).select(F.col("id").alias("m"), windows.harmonic(F.col("id")).alias("h")).collect()}
    assert all(abs(got[m] - sum(1 / i for i in range(1, m + 1))) < 1e-13 for m in range(400))


def test_enrichment_auc_and_medians(skewed):
    rows, df = skewed
    es = {r.grp: r.es for r in windows.running_enrichment(df, "grp", ["-p", "id"], "hit", "w").collect()}
    area = {r.grp: (r.auc, r.auprc) for r in genetics.auc(df, "grp", "p", "hit").collect()}
    middle = {r.grp: r["median"] for r in ranking.medians(df, ["grp"], "w", "id").collect()}
    for name, group in by_group(rows).items():
        order, run, best = sorted(group, key=lambda r: (-r[2], r[0])), 0.0, 0.0
        weight, misses = sum(r[4] for r in group if r[3]), sum(not r[3] for r in group)
        if weight and misses:
            for r in order:
                run += r[4] / weight if r[3] else -1 / misses
                best = run if round(abs(run), 9) > round(abs(best), 9) else best
        assert abs(es[name] - best) < 1e-9
        assert middle[name] == median(r[4] for r in group)
        yes, no = [r[2] for r in group if r[3]], [r[2] for r in group if not r[3]]
        if not yes or not no:
            assert area[name] == (None, None)
            continue
        assert abs(area[name][0] - sum((a > b) + (a == b) / 2 for a in yes for b in no) / (len(yes) * len(no))) < 1e-12
        precise, hits = [], 0
        for i, r in enumerate(sorted(group, key=lambda r: (-r[2], not r[3])), 1):
            hits += r[3]
            precise += [hits / i] if r[3] else []
        assert abs(area[name][1] - sum(precise) / len(precise)) < 1e-9


@pytest.fixture(scope="module")
def spans(spark):
    """Overlapping, touching, nested and empty intervals on one long chromosome and few others."""
    random.seed(11)
    rows = []
    for i in range(900):
        s = random.randrange(9000)
        rows.append(("1" if random.random() < 0.9 else random.choice("23"), s, s + random.choice([0, 1, 3, 8, 8, 15, 400 if i % 97 == 0 else 5]), i))
    return rows, spark.createDataFrame(rows, "chr string, start long, end long, peak long")


@pytest.mark.parametrize("rule", ["inclusive", "abutting", "strict"])
def test_merge_intervals(spans, rule):
    rows, df = spans
    want = []
    for c in "123":
        current = None
        for _, s, e, _ in sorted((r for r in rows if r[0] == c), key=lambda r: r[1:3]):
            joins = current and {"inclusive": s <= current[2] + 1, "abutting": s <= current[2], "strict": s < current[2]}[rule]
            if joins:
                current[2], current[3] = max(current[2], e), current[3] + 1
            else:
                current = [c, s, e, 1]
                want.append(current)
    assert sorted(map(tuple, intervals.merge_intervals(df, "chr", "start", "end", rule).collect())) == sorted(map(tuple, want))


@pytest.mark.parametrize("most", [10**6, 40])
def test_peak_counts(spark, spans, monkeypatch, most):
    """Counts per peak and barcode by cells, whole and split, with few peaks at once; all pairs as the measure."""
    monkeypatch.setattr(intervals, "CHUNK", 16)
    rows, df = spans
    random.seed(5)
    frags = [(random.choice("1112"), s := random.randrange(9000), s + random.choice([0, 2, 30, 90]), random.choice(["x", "x", "y", "z", f"b{i % 50}"])) for i in range(1200)]
    frags += [("1", 100, 140, "x")] * 300 + [("9", 1, 5, "x"), ("1", 5, 50, None)]
    got = {(r.peak, r.barcode): r.val for r in intervals.peak_counts(spark.createDataFrame(frags, "chr string, start long, end long, barcode string"), df, most).collect()}
    want = {}
    for c, s, e, peak in rows:
        for d, a, b, barcode in frags:
            if c == d and barcode and e > s and b > a and a < e and s < b:
                want[peak, barcode] = want.get((peak, barcode), 0) + 1
    assert got == want
    assert intervals.peak_counts(spark.createDataFrame([], "chr string, start long, end long, barcode string"), df).collect() == []


def test_peak_counts_leave_split_cells_once(spark, spans):
    """Counts of a split cell are final and leave their task in blocks of pairs: none are gathered or added up afterwards."""
    rows, df = spans
    frags = spark.range(3000).selectExpr("'1' AS chr", "id % 900 * 10 AS start", "id % 900 * 10 + 50 AS end", "id % 40 AS barcode")
    found = intervals.peak_counts(frags, df, 100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("FlatMapGroupsInArrow") == 1
    want = sum(1 for c, s, e, _ in rows if c == "1" and e > s for b in range(40) if any(i % 900 * 10 < e and s < i % 900 * 10 + 50 for i in range(b, 3000, 40)))
    assert found.count() == want


@pytest.mark.parametrize("width", [0, 3, 20])
def test_points_of_a_place_follow_one_another(spark, width):
    """All pairs of points with windows and intervals, whose points come out by place, so that a file holds a place's list nearly once."""
    random.seed(6)
    where = [(i, i % 2, random.randrange(-30, 60)) for i in range(120)]
    points, centres = spark.createDataFrame(where, "id long, chr int, pos int"), spark.createDataFrame([(i, c, p // 2) for i, c, p in where], "gene long, chr int, centre int")
    found = intervals.within_window(points, centres, "chr", width)
    assert sorted((r.gene, r.id) for r in found.collect()) == sorted((g, i) for g, c, x in where for i, d, p in where if c == d and abs(p - x // 2) <= width)
    spans = centres.selectExpr("gene", "chr", "centre AS start", f"centre + {width} AS end")
    inside = intervals.containing(points, spans, ["chr"], 1)
    assert sorted((r.gene, r.id) for r in inside.collect()) == sorted((g, i) for g, c, x in where for i, d, p in where if c == d and x // 2 <= p <= x // 2 + width)
    for df in (found, inside) if width <= intervals.NARROW else (inside,):
        places = [(r.chr, r.pos) for r in df.collect()]
        assert len([1 for a, b in zip([None, *places], places) if a != b]) == len(set(places))


def test_tiles_are_cut_after_the_shuffle(spark):
    """Tiles of long intervals, also before 0, by counting; what is shuffled is a row for each stretch of tiles."""
    random.seed(7)
    frags = [(random.choice("12"), s := random.randrange(-900, 3000), s + random.choice([0, 1, 10, 700]), random.randrange(3)) for _ in range(150)]
    want = {}
    for c, s, e, b in frags:
        for t in range(int(s / 10), int((e - 1) / 10) + 1) if e > s else ():
            want[c, t, b] = want.get((c, t, b), 0) + 1
    df = spark.createDataFrame(frags, "chr string, start long, end long, barcode int").where("end > start")
    assert {(r.chr, r.tile, r.barcode): r.val for r in intervals.tile_counts(df, 10).collect()} == want
    plan = intervals.tile_counts(df, 10)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.rindex("tile") > 0 and "partial_count" in plan[: plan.index("Exchange hashpartitioning")]


def test_pairs_in_tasks_by_points(spark, monkeypatch):
    """joins that return all pairs run in as many tasks as their points ask for, few or many bytes, and lose none."""
    monkeypatch.setattr(intervals, "POINTS", 50)
    where = [(i, i % 3, i % 90) for i in range(900)]
    points, centres = spark.createDataFrame(where, "id long, chr int, pos int"), spark.createDataFrame([(i, c, p) for i, c, p in where if i % 5 == 0], "gene long, chr int, centre int")
    spans = centres.selectExpr("gene", "chr", "centre - 2 AS start", "centre + 2 AS end")
    cases = ((2, intervals.within_window(points, centres, "chr", 2)), (12, intervals.within_window(points, centres, "chr", 12)), (2, intervals.containing(points, spans, ["chr"], 1)), (2, intervals.containing(points, spans, ["chr"], 1, 900)))
    for width, found in cases:
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count(", 18), REPARTITION_BY_NUM") == 2
        assert sorted((r.gene, r.id) for r in found.collect()) == sorted((g, i) for g, c, x in where if g % 5 == 0 for i, d, p in where if c == d and abs(p - x) <= width)
        tasks = [r["count"] for r in found.groupBy(intervals.F.spark_partition_id()).count().collect()]
        assert len(tasks) > 4 and max(tasks) < 0.5 * sum(tasks)
