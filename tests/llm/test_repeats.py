import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerloom.llm import repeats
from ledgerloom.llm.common import table
from ledgerloom.llm.rindex import RunIndex

from .helpers import DATA, awkward, empty


def plain(texts, length=200):
    """Per text: removed spans."""
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = [i for i in range(len(t) - length + 1) if count[t[i : i + length]] > 1]
        gone = np.zeros(len(t) + 1, bool)
        for i in hit:
            gone[i : i + length] = True
        edge = np.flatnonzero(np.diff(np.r_[False, gone]))
        out.append(list(zip(edge[::2].tolist(), edge[1::2].tolist())))
    return out


def hold(docs):
    rows = [(r.doc_id, (r.text or "").encode()) for r in docs.collect()]
    want = Counter()
    for (d, t), spans in zip(rows, plain([t for _, t in rows])):
        kept = b"".join(t[a:b] for a, b in zip([0, *(b for _, b in spans)], [*(a for a, _ in spans), len(t)]))
        want[d, tuple(spans), kept] += 1
    got = Counter((r.doc_id, tuple((s.start, s.end) for s in r.removed), bytes(r.kept)) for r in repeats.repeated_spans(docs).collect())
    assert got == want
    return want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.binary(max_size=60).map(lambda b: bytes(x % 3 for x in b)), min_size=1, max_size=6))
def test_statistics_of_small_texts(texts):
    index = RunIndex(texts)
    got, at = index.statistics(), 0
    for n, t in enumerate(texts):
        for i in range(len(t)):
            best = 0
            for m, u in enumerate(texts):
                for j in range(len(u)):
                    if (m, j) != (n, i):
                        k = 0
                        while i + k < len(t) and j + k < len(u) and t[i + k] == u[j + k]:
                            k += 1
                        best = max(best, k)
            assert got[at] == best
            at += 1


def test_runs_are_few_in_repetitive_texts():
    text = bytes(random.Random(1).randrange(4) for _ in range(500))
    assert RunIndex([text] * 40).runs < 40 * 500 / 8


def test_anchors_cover_every_start_once():
    rng = random.Random(2)
    for size in (0, 199, 200, 500, 140_000):
        text = bytes(rng.randrange(256) for _ in range(size))
        _, lo, count = repeats.anchors(text)
        starts = np.concatenate([np.arange(a, a + c) for a, c in zip(lo, count)]) if len(lo) else np.empty(0)
        assert starts.tolist() == list(range(max(0, size - 199)))


def test_against_brute_force(spark):
    want = hold(table(spark, DATA, "documents"))
    assert any(spans for _, spans, _ in want)


def test_hot_passages(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(6))
    shared = " ".join(word() for _ in range(60))
    rows = [(i, " ".join(word() for _ in range(rng.randrange(40))) + shared + word()) for i in range(900)]
    rows += [(2000 + i, "z" * 3000) for i in range(3)] + [(3000, "q" * 199), (3001, "r" * 201)]
    hold(spark.createDataFrame(rows, "doc_id long, text string"))


def test_a_line_in_every_document_and_a_string_thousands_of_times(spark, monkeypatch):
    """Frequent anchors: equal contexts are combined, different ones are split by longer grams, down to the string."""
    monkeypatch.setattr(repeats, "GROUP", 20)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line, string = " ".join(word() for _ in range(43))[:300], " ".join(word() for _ in range(29))[:200]
    rows = [(i, f"{word()} {word()}{line}{word()} {word()}") for i in range(300)]
    rows += [(1000 + i, " ".join(string + word() for _ in range(100))) for i in range(50)]
    rows += [(2000 + i, line[i % 60 :] + word() * 20) for i in range(200)] + [(2500 + i, word() * 9 + line[: 150 + i]) for i in range(120)]
    rows += [(3000, rows[7][1]), (3001, rows[7][1]), (3002, line), (3003, line)]
    hold(spark.createDataFrame(rows, "doc_id long, text string"))


def test_splits_keep_every_string():
    rng = random.Random(10)
    data = bytes(rng.randrange(4) for _ in range(336))
    for gram in (*repeats.LONGER, 200):
        (batch,) = repeats._split_batches(200, gram)(iter([pa.RecordBatch.from_arrays([pa.array([b"c" * 16]), pa.array([data])], ["cid", "data"])]))
        starts = [at + i for at, n in zip(batch["at"].to_pylist(), batch["count"].to_pylist()) for i in range(n)]
        assert sorted(starts) == list(range(137))


def test_runs_of_a_context_are_joined_and_stay_one_row(spark):
    """Single strings that follow each other are one run; where a context occurs, its runs are not multiplied out."""
    runs = spark.createDataFrame([([(5, 6), (0, 2), (2, 3), (8, 9), (6, 8), (8, 9), (20, 30), (21, 25)],)], "r array<struct<lo: int, hi: int>>")
    assert [tuple(x) for x in runs.select(repeats._joined(F.col("r")).alias("r")).first().r] == [(0, 3), (5, 9), (20, 30)]
    rng = random.Random(12)
    line = bytes(rng.randrange(97, 123) for _ in range(230))
    data = [line[:k] + b"#" + line[k:] for k in (3, 7, 226)] * 40
    rows = [(bytes([1, i]) * 8, 5, hashlib.md5(d).digest(), 0, len(d) - 199, d) for i, d in enumerate(data)]
    pieces = repeats.settle(spark.createDataFrame(rows, repeats._PIECES), "pieces")
    got = repeats.marks_of(pieces, 200, (200,)).collect()
    assert len(got) == 120 and all([tuple(x) for x in r.runs] == [(5, 37)] for r in got)


def test_awkward_rows(spark):
    hold(awkward(spark))
    assert repeats.repeated_spans(empty(spark)).count() == 0


def test_query_columns(spark):
    row = repeats.op4_suffix_dedup(spark, DATA).where("n_removed = 0").first()
    text = table(spark, DATA, "documents").where(f"doc_id = {row.doc_id}").first().text.encode()
    assert (row.n_bytes, row.n_spans, row.kept_sha256) == (len(text), 0, hashlib.sha256(text).hexdigest())
