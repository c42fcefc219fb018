import pytest
from oracle import rows_of, rows_of_sql, tables

from lattica import catalog

catalog.load()


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_equals_sql(spark, sf, name):
    assert rows_of(catalog.QUERIES[name](spark, sf)) == rows_of_sql(tables(sf), catalog.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_two_core(spark, sf):
    left = {tuple(sorted(r)) for r in catalog.QUERIES["edges_canonical"](spark, sf).collect()}
    while True:
        degree = {}
        for e in left:
            for n in e:
                degree[n] = degree.get(n, 0) + 1
        rest = {e for e in left if min(degree[e[0]], degree[e[1]]) >= 2}
        if rest == left:
            break
        left = rest
    assert {tuple(sorted(r)) for r in catalog.QUERIES["graph_two_core"](spark, sf).collect()} == left


def test_parse_index_spec():
    from lattica.operators.stats import parse_index_spec

    assert parse_index_spec("1-3,10,20-22") == [1, 2, 3, 10, 20, 21, 22]
    for bad in ("5-1", "abc", ""):
        with pytest.raises(ValueError):
            parse_index_spec(bad)


def test_bh_known_values(spark):
    from lattica.operators.windows import benjamini_hochberg

    df = spark.createDataFrame([(0, 0.001), (1, 0.01), (2, 0.5), (3, 0.9)], "id int, p double")
    q = {r.id: r.q for r in benjamini_hochberg(df).collect()}
    assert abs(q[0] - 0.004) < 1e-12 and abs(q[1] - 0.02) < 1e-12 and abs(q[3] - 0.9) < 1e-12


def test_match_keys_of_any_length(spark):
    """Prefix tiers over more than a thousand lengths, and empty keys."""
    from lattica.operators.align import match_keys

    names = ["q" * n for n in range(1, 1201)]
    queries = spark.createDataFrame([(n,) for n in names] + [("",), (None,)], "query string")
    keys = spark.createDataFrame([(n + "k",) for n in names[1100:]] + [("r",)], "key string")
    found = {r.query: (r.key, r.tier) for r in match_keys(queries, keys).collect()}
    assert found["q" * 1200] == ("q" * 1200 + "k", 3) and found["q"] == ("q" * 1101 + "k", 3)
    assert match_keys(spark.createDataFrame([("q" * 1150 + "zz",)], "query string"), spark.createDataFrame([("q" * 1150,)], "key string")).first().tier == 4


def test_ranged_positions_with_ties(spark):
    from lattica.plans import ranking

    df = spark.createDataFrame([(i, float(i % 3) if i % 7 else None) for i in range(500)], "id int, v double")
    rows = ranking.global_position(df, "v", "id").collect()
    want = sorted(((r.v is not None, r.v or 0.0, r.id) for r in rows))
    assert [(r.v is not None, r.v or 0.0, r.id) for r in sorted(rows, key=lambda r: r.position)] == want
    assert sorted(r.position for r in rows) == list(range(1, 501))


def test_mask_needs_a_value_for_each_column(spark, sf):
    from lattica.matrix import part_by_order
    from lattica.operators.access import mask_columns

    m = part_by_order(spark, sf)
    with pytest.raises(ValueError):
        mask_columns(m, m.samples.selectExpr("col_id", "true AS keep").limit(3))


def test_merge_nearby_known_values(spark):
    from lattica.operators.access import merge_nearby

    sites = spark.createDataFrame([("g", p, n) for p, n in ((10, 2), (15, 5), (20, 5), (21, 9), (40, 1))] + [("h", 1, 1)], "gene string, pos long, n long")
    # Counts within five of 10, 15, 20, 21, 40: 7, 12, 19, 14, 1.
    assert sorted(map(tuple, merge_nearby(sites, "gene", 10).collect())) == [("g", 20, 19), ("g", 21, 14), ("g", 40, 1), ("h", 1, 1)]
    ends = spark.createDataFrame([("g", 12, 50), ("g", 38, 3), ("h", 9, 9)], "gene string, pos long, n long")
    assert sorted(map(tuple, merge_nearby(sites, "gene", 10, ends).collect())) == [("g", 10, 50), ("g", 21, 0), ("g", 40, 3), ("h", 1, 0)]
