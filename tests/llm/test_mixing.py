import math
import re
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerloom.llm import mixing
from ledgerloom.llm.common import table

from .helpers import DATA, awkward, empty


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = total - sum(3 * sizes[s] for s in capped)
        unit = left / sum(weight[s] for s in free) if free else 0
        over = {s for s in free if weight[s] * unit > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * unit for s in names}
        capped |= over


def hold(docs):
    texts = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    sizes = defaultdict(int)
    for _, text, source in texts:
        sizes[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    targets = plain_targets(sizes)
    got = mixing.mix(docs).collect()
    taken, largest = defaultdict(int), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, targets[r.source], abs_tol=1e-6)
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
        largest[r.source] = max(largest[r.source], r.size)
    return got, taken, targets, largest


def test_every_source_comes_near_its_target(spark):
    docs = table(spark, DATA, "documents")
    got, taken, targets, largest = hold(docs)
    assert len(got) == docs.count()
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


def test_one_source_of_many_rows_and_one_of_few(spark):
    rows = [(i, "w " * (1 + i % 40), "big" if i % 3 else f"s{i % 5}") for i in range(3000)]
    _, taken, targets, largest = hold(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert all(abs(taken[s] - targets[s]) <= largest[s] for s in targets)


def test_awkward_rows(spark):
    docs = awkward(spark)
    got, *_ = hold(docs)
    assert len(got) == docs.count() and {r.size for r in got if r.doc_id in (3, 4, 5)} == {0}
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mix(docs.where("doc_id = 3")).first().target == 0.0
    again = mixing.mix(docs.withColumn("size", docs.n_chars))
    assert [r["size"] for r in again.where("doc_id = 6").collect()] == [6000]


def test_the_mix_repeats_documents(spark):
    docs = awkward(spark)
    words = sum(r.taken for r in mixing.mix(docs).collect())
    mixed = mixing.apply_mix(docs)
    assert mixed.columns == docs.columns
    assert sum(len((r.text or "").split()) for r in mixed.collect()) == words


def test_the_level_of_many_capped_sources(spark):
    """Geometric sizes: one source after another reaches its ceiling."""
    rows = [(i, "w " * (2 ** (i % 13)), f"s{i % 13:02d}") for i in range(260)]
    hold(spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_extra_columns_with_clashing_names(spark):
    own = ["row", "h", "missing", "skey", "base", "threshold", "copy", "n", "prefix", "below", "open", "budget", "part", "level"]
    docs = awkward(spark)
    clash = docs.select("*", *[F.lit(7).alias(c) for c in own], *[F.lit(c).alias(c) for c in ("size", "taken", "target")])
    mixed, plain = mixing.apply_mix(clash), mixing.apply_mix(docs)
    assert mixed.columns == clash.columns and mixed.select(*docs.columns).exceptAll(plain).count() == 0
    assert mixed.where("base = 7 AND threshold = 7 AND `copy` = 7 AND size = 'size'").count() == plain.count() == mixed.count()
    found = mixing.mix(clash)
    assert found.where("h = 7 AND skey = 7 AND row = 7").count() == docs.count()
    assert {r["size"] for r in found.where("doc_id = 6").collect()} == {6000}
    assert mixing.apply_mix(empty(spark)).count() == 0


def test_more_sources_than_are_broadcast(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 3)
    hold(spark.createDataFrame([(i, "w " * (i % 9), f"s{i % 7}") for i in range(300)], "doc_id long, text string, source string"))


def test_query_columns(spark):
    found = mixing.op3_source_mix(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("source_size", "bigint"), ("target", "double"), ("taken", "bigint")]
    assert found.exceptAll(mixing.mix(table(spark, DATA, "documents")).select(found.columns)).count() == 0
