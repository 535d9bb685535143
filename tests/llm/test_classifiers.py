import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from ledgerloom.llm import langid, quality
from ledgerloom.llm.bytewindows import windows
from ledgerloom.llm.common import held_out, sampled, table

from .helpers import DATA, awkward, empty

BIG = "/root/testdata/sf0.1"


def test_windows_hold_every_byte_once():
    texts = [b"", b"a", b"x" * 255, b"y" * 256, bytes(range(256)) * 3]
    cut, of, own = windows(texts, 256, 3)
    for i, t in enumerate(texts):
        mine = cut[of == i]
        joined = mine[0].tobytes() + b"".join(w[3:].tobytes() for w in mine[1:])
        assert joined.rstrip(b"\0") == t.rstrip(b"\0") and len(joined) >= len(t)


def test_language_accuracy_held_out(spark):
    docs = table(spark, BIG, "documents").where(F.col("lang").isNotNull())
    model = langid.fit(docs)
    got = langid.predict(docs, model, ("doc_id", "lang")).where(held_out()).collect()
    right = sum(r.lang == r.lang_pred for r in got)
    assert right / len(got) >= 0.97
    assert all(0 <= r.score <= 1 for r in got)
    scorer = langid.Scorer(model)
    assert scorer.predict([None, b"", b"12 !?", "☃".encode()])[0] == ["und"] * 4
    assert scorer.predict([b"x" * 500_000])[0][0] in model.languages


def test_tables_equal_the_network():
    rng = np.random.default_rng(0)
    texts = [bytes(rng.integers(97, 123, 300, dtype=np.uint8)) for _ in range(20)]
    model = langid.train(texts, ["a", "b"] * 10)
    cut, _, _ = windows(texts, 256, 3)
    e = model.embed[cut]
    span = cut.shape[1] - 3
    answers = sum(e[:, j : j + span] @ model.conv[j] for j in range(4)).max(axis=1)
    want = np.maximum(answers + model.bias, 0) @ model.out + model.out_bias
    assert np.allclose(langid.Scorer(model).logits(cut), want, atol=1e-3)


def test_language_of_awkward_rows(spark):
    docs = awkward(spark)
    found = langid.predict(docs, langid.fit(docs)).collect()
    assert len(found) == docs.count()
    assert {r.lang_pred for r in found if r.doc_id in (3, 4, 5)} == {"und"}
    assert langid.predict(empty(spark), langid.fit(empty(spark))).count() == 0
    kept = langid.keep_known(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect() if r.doc_id) == [1, 1, 2, 6, 7]
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r.doc_id for r in langid.keep_known(unlabelled).collect() if r.doc_id) == [1, 1, 2, 6, 7]


def test_quality_accuracy_held_out(spark):
    docs, labels = table(spark, BIG, "documents"), table(spark, BIG, "labels")
    model = quality.fit(docs, labels)
    got = quality.score_documents(docs, model).join(labels, "doc_id").where(held_out()).collect()
    y, s = np.array([r.quality for r in got]), np.array([r.score for r in got])
    assert ((s >= 0.5) == y).mean() >= 0.95
    order = np.argsort(np.argsort(s))
    auc = (order[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc >= 0.97


def test_attention_gradient():
    rng = np.random.default_rng(2)
    m = quality.train([], [])
    m.out_bias = np.array([0.1])
    x, of = rng.random((7, quality.BUCKETS)), np.array([0, 0, 0, 1, 2, 2, 2])
    y, w = np.array([1.0, 0.0, 1.0]), np.array([1.0, 2.0, 0.5])
    loss = lambda: -(w * (y * np.log(p := quality._forward(m, x, of, 3)[-1]) + (1 - y) * np.log(1 - p))).sum() / 3
    for name, g in zip(quality.Model.__dataclass_fields__, quality._gradient(m, x, of, y, w)):
        value = getattr(m, name)
        spot = tuple(rng.integers(0, n) for n in value.shape)
        value[spot] += 1e-5
        up = loss()
        value[spot] -= 2e-5
        down = loss()
        value[spot] += 1e-5
        assert abs((up - down) / 2e-5 - g[spot]) < 1e-6


def test_quality_by_blocks_equals_all_at_once():
    rng = np.random.default_rng(4)
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 700, quality.PASSAGE * quality.BLOCK * 2, 5000)]
    model = quality.train([], [])
    cut, of, own = windows(texts, quality.PASSAGE, 1)
    want = quality._forward(model, quality.features(cut, own), of, len(texts))[-1]
    assert np.allclose(quality.score(model, texts), want, atol=1e-6)


def plain_score(m, text):
    """A document's score by the formulas, passage after passage, byte pair after byte pair."""
    hidden, energy = [], []
    for at in range(0, max(1, len(text)), quality.PASSAGE - 1):
        part = text[at : at + quality.PASSAGE]
        if at and len(part) < 2:
            continue
        counts = [0] * quality.BUCKETS
        for a, b in zip(part, part[1:]):
            counts[((a * 257 + b) * 0x9E3779B1 % (1 << 32)) >> 23] += 1
        root = [math.sqrt(c) for c in counts]
        norm = math.sqrt(sum(counts)) or 1
        h = [math.tanh(sum(r / norm * m.encode[i, j] for i, r in enumerate(root) if r) + m.bias[j]) for j in range(quality.HIDDEN)]
        gate = lambda w, k: sum(h[j] * w[j, k] for j in range(quality.HIDDEN))
        energy.append(sum(m.attend[k] * math.tanh(gate(m.tanh, k)) / (1 + math.exp(-gate(m.sigm, k))) for k in range(quality.GATE)))
        hidden.append(h)
    weight = [math.exp(e - max(energy)) for e in energy]
    z = [sum(w * h[j] for w, h in zip(weight, hidden)) / sum(weight) for j in range(quality.HIDDEN)]
    return 1 / (1 + math.exp(-max(-30, min(30, sum(a * b for a, b in zip(z, m.out)) + m.out_bias[0]))))


def test_quality_query_against_brute_force(spark):
    docs, labels = table(spark, DATA, "documents"), table(spark, DATA, "labels")
    model = quality.fit(docs, labels)
    found = quality.op5_quality_mil(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    got = {r.doc_id: r for r in found.collect()}
    rows = docs.collect()
    assert len(got) == len(rows)
    for r in rows:
        row, want = got[r.doc_id], plain_score(model, (r.text or "").encode())
        assert abs(row.score - want) < 1e-4 and row.predicted == int(row.score >= 0.5)
        assert row.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_language_query(spark):
    found = langid.op8_language_id(spark, DATA)
    assert found.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")]
    learnt = {r.lang for r in table(spark, DATA, "documents").where(~held_out() & F.col("lang").isNotNull()).collect()}
    rows = {r.doc_id: r.text for r in table(spark, DATA, "documents").collect()}
    for r in found.collect():
        letters = any(c.isalpha() for c in rows[r.doc_id] or "")
        assert r.lang_pred in learnt if letters else r.lang_pred == "und"
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)


def test_samples_are_whole_rows_within_their_bounds(spark):
    rows = [(h, h * 10, "x" * (50 if h % 3 else 500)) for h in range(40)]
    frame = spark.createDataFrame(rows, "h long, t long, text string")
    got = sampled(frame, 10, 700)
    assert [(r.h, len(r.text)) for r in got] == [(0, 500), (1, 50), (2, 50), (4, 50), (5, 50)]
    assert sampled(frame.repartition(7), 10, 700) == got and sampled(frame.limit(0), 10, 700) == []


def test_learning_sees_late_passages_and_windows(spark):
    """What tells the classes apart stands at the end of long texts only."""
    rng = np.random.default_rng(5)
    word = lambda letters: "".join(rng.choice(list(letters), 5))
    rows = []
    for i in range(240):
        good = i % 2
        text = " ".join(word("mnopqr") for _ in range(2400)) + " " + " ".join(word("abc" if good else "xyz") for _ in range(500))
        rows.append((i, text, "aa" if good else "bb", good))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, quality int")
    got = quality.score_documents(docs, quality.fit(docs.select("doc_id", "text"), docs.select("doc_id", "quality"))).collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 2) for r in got]) >= 0.95


def test_an_empty_language_is_a_value(spark):
    rows = [(i, "abc cba bca " * 9 if i % 2 else "xyz zyx yxz " * 9, "" if i % 2 else "zz") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    assert model.languages == ["", "zz"]
    assert all(r.lang_pred == r.lang for r in langid.predict(docs, model, ("lang",)).collect())


def test_quality_of_awkward_rows(spark):
    docs = awkward(spark)
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (4, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    found = quality.score_documents(docs, quality.fit(docs, labels)).collect()
    assert len(found) == docs.count() and all(0 <= r.score <= 1 for r in found)
    none = quality.fit(empty(spark), labels.limit(0))
    assert quality.score_documents(empty(spark), none).count() == 0


def test_a_worker_keeps_one_stage_s_model_and_returns_memory():
    """What another stage kept goes; freed memory leaves the process when a partition ends."""
    import numpy as np
    import psutil

    from ledgerloom.llm import common

    made = []
    make = lambda x: made.append(x) or [x]
    assert common.loaded(make, 1) is common.loaded(make, 1) and made == [1]
    assert common.loaded(make, 2) == [2] and common.loaded(make, 1) == [1] and made == [1, 2, 1] and len(common._held) == 1
    own = psutil.Process().memory_info

    def run(batches):
        rows = [bytes(900) for _ in range(200_000)]
        yield len(rows)
        del rows

    before = own().rss
    assert list(common.returning(run)(iter(()))) == [200_000]
    assert own().rss - before < 90_000_000 and np.zeros(1)[0] == 0
