import os
import random

from ledgerloom.lineage import scratch, settle, shared_dir
from ledgerloom.operators import counted
from ledgerloom.operators.components import roots


def test_random_graphs_and_a_long_chain(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(120)] + [(1000 + i, 1001 + i) for i in range(40)]
    edges += [(5000, x) for x in range(5001, 5200)] + [(7, 7)]
    label = {}
    for a, b in edges:
        la, lb = label.setdefault(a, {a}), label.setdefault(b, {b})
        if la is not lb:
            la |= lb
            for x in lb:
                label[x] = la
    want = {(n, min(g)) for n, g in label.items() if n != min(g)}
    got = roots(spark.createDataFrame(edges, "u long, v long"))
    assert set(map(tuple, got.collect())) == want
    assert roots(spark.createDataFrame([], "u long, v long")).count() == 0


def test_hubs_are_met_in_place(spark, monkeypatch):
    """Frequent keys by broadcast, the others by shuffle: the same components, the same joins."""
    monkeypatch.setattr(counted, "HUBS", 8)
    edges = [(1, x) for x in range(10, 90)] + [(x, 500 + x // 9) for x in range(40, 100)] + [(900, 901), (901, 902)]
    got = {r.u: r.v for r in roots(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[x] == 1 for x in range(10, 90)) and got[901] == got[902] == 900
    rows = spark.createDataFrame([(k, i) for i in range(90) for k in [i % 9 if i < 30 else 0]] + [(77, 0), (None, 1)], "k long, i long")
    keyed = rows.where("k <> 77").groupBy("k").agg({"*": "count"}).withColumnRenamed("count(1)", "n")
    for how in ("inner", "left"):
        assert sorted(map(str, counted.join_counted(rows, keyed, "k", 92, how).collect())) == sorted(map(str, rows.join(keyed, "k", how).collect()))


def test_scratch_tables_go_but_for_kept_ones(spark):
    held = lambda: {n for n in os.listdir(shared_dir(spark)) if n.startswith("trial")}
    with scratch(spark) as outer:
        with scratch(spark) as inner:
            settle(spark.range(3), "trial-a")
            kept = inner(settle(spark.range(5), "trial-b"))
        assert len(held()) == 1 and kept.count() == 5
    assert not held()
    assert outer
