"""Tasks that do not grow with the tables: plans of the queries, with few rows allowed a task."""

import re

import pytest

from lattica import catalog
from lattica.matrix import table
from lattica.plans import spread

catalog.load()


@pytest.fixture
def dealt(spark, sf, monkeypatch):
    """The plan of a query and the number of tasks that its lines fill."""
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    wanted = -(-table(spark, sf, "lineitem").count() // 500)
    assert wanted > 4  # of the session
    return lambda name: (catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString(), wanted)


def exchanges(plan):
    return re.findall(r"Exchange hashpartitioning\((.*), (\d+)\), (\w+)", plan)


def test_nearby_sites_in_one_shuffle(dealt):
    """a key's lines are dealt once, to as many tasks as the lines ask for."""
    plan, wanted = dealt("merge_nearby_sites")
    assert [(int(n), kind) for _, n, kind in exchanges(plan)] == [(wanted, "REPARTITION_BY_NUM")]
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan


def test_nearby_sites_without_a_place(spark):
    from lattica.operators.access import merge_nearby

    sites = spark.createDataFrame([("g", 5, 2), ("g", None, 9), (None, 5, 1), ("g", 9, None), ("g", 5, 1)], "gene string, pos long, n long")
    assert [tuple(r) for r in merge_nearby(sites, "gene", 5).collect()] == [("g", 5, 3)]


@pytest.mark.parametrize("name, last", [("sums_by_groupings", 2), ("matrix_folded_stats", 1)])
def test_sums_in_tasks_of_bounded_rows(dealt, name, last):
    """lines are dealt once by order, and what is joined to them by the keys of its sums."""
    plan, wanted = dealt(name)
    numbers = [int(n) for _, n, kind in exchanges(plan) if kind == "REPARTITION_BY_NUM"]
    assert numbers == [wanted * last, wanted]


def test_prefix_of_all_keys_is_one_row(spark, monkeypatch):
    """keys that share a prefix are joined as one row; before, each key was."""
    from lattica.operators import align

    written = []
    monkeypatch.setattr(align, "materialize", lambda df, name: written.append((name, df)) or df)
    match_keys = align.match_keys

    keys = spark.createDataFrame([(f"Customer#{i:04d}",) for i in range(3000)] + [("Custo",)], "key string")
    queries = spark.createDataFrame([("Custom",), ("none7",), ("Customer#0007zz",), ("Customer#0005@x",), ("Customer#0009",)], "query string")
    assert sorted(map(tuple, match_keys(queries, keys).collect())) == [("Custom", "Customer#0000", 3), ("Customer#0005@x", "Customer#0005", 2), ("Customer#0007zz", "Custo", 4), ("Customer#0009", "Customer#0009", 1)]
    third = [df for name, df in written if name == "hits"][2]._jdf.queryExecution().optimizedPlan().toString()
    join = third[third.index("Join Inner, (query") :]
    assert "Aggregate [start" in join
