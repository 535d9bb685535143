import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerloom.llm import packing
from ledgerloom.llm.common import table

from .helpers import DATA, awkward, empty

PATH = public_tokenizers.path("byte_bpe_50k.json")
REFERENCE = Tokenizer.from_file(PATH)
TOKENS = packing.Tokens(PATH, public_tokenizers.PATTERN)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab é.\n\t ½ 12<|endoftx>'s  "), max_size=60) | st.text(max_size=30))
def test_cached_words_give_the_ids_of_the_whole_text(text):
    assert TOKENS.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> ", "x<|endoftext|>\n y z", "<|endoftext|"])
def test_added_tokens_have_ids_of_their_own(text):
    assert TOKENS.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é.\n\t ½ 12<|endoftx>'s  "), max_size=40) | st.text(max_size=20), max_size=8))
def test_blocks_of_texts_give_the_ids_of_each(texts):
    assert [x.tolist() for x in TOKENS.block(texts)] == [REFERENCE.encode(t, add_special_tokens=False).ids for t in texts]


class Counting:
    def __init__(self, encoding):
        self.encoding, self.calls = encoding, 0

    def encode_ordinary(self, text):
        self.calls += 1
        return self.encoding.encode_ordinary(text)


def test_the_words_of_a_text_are_encoded_together(monkeypatch):
    """One call of the encoder for each new word took more CPU time than all else in packing."""
    text = " ".join(f"w{i}x" for i in range(5000))
    counting = Counting(TOKENS._encoding)
    monkeypatch.setattr(TOKENS, "_encoding", counting)
    assert TOKENS.ids(text).tolist() == REFERENCE.encode(text, add_special_tokens=False).ids
    assert counting.calls < 10


def test_what_a_worker_keeps_does_not_grow_with_the_words_it_met():
    text = " ".join(f"w{i}x" for i in range(30_000))
    TOKENS.ids("a b")
    tracemalloc.start()
    try:
        TOKENS.ids(text)
        assert tracemalloc.get_traced_memory()[0] < 500_000
    finally:
        tracemalloc.stop()


def test_texts_come_in_small_batches(spark, monkeypatch):
    """10,000 rows at once, whatever their size, were most of a worker's memory. The session's own setting stays."""
    key, own = "spark.sql.execution.arrow.maxBytesPerBatch", packing._pack_batches

    def checked(path, window):
        run = own(path, window)

        def small(batches):
            def each():
                for b in batches:
                    assert b.nbytes < 8 << 20
                    yield b

            return run(each())

        return small

    monkeypatch.setattr(packing, "_pack_batches", checked)
    docs = spark.range(0, 300, 1, 1).selectExpr("id AS doc_id", "repeat('some text ', 6000) AS text")
    before = spark.conf.get(key, None)
    assert packing.pack(docs).selectExpr("sum(length)").first()[0] > 300 * 6000
    assert spark.conf.get(key, None) == before


def hold(docs, window=2048):
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    ids = {d: REFERENCE.encode(t or "", add_special_tokens=False).ids + [1] for d, t in texts}
    rows = packing.pack(docs, window=window).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length > 0 and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(own, dtype="<u4").tobytes())
        by_doc[r.doc_id].append((r.start, r.length))
        by_seq[r.sequence_id].append((r.offset, r.length))
    for pieces in by_seq.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= window and end & (end - 1) == 0
    return ids, by_doc, by_seq


def test_every_id_lies_in_one_piece(spark):
    docs = table(spark, DATA, "documents")
    ids, by_doc, _ = hold(docs)
    for d, own in ids.items():
        end = 0
        for start, length in sorted(by_doc[d]):
            assert start == end
            end += length
        assert end == len(own)


def test_awkward_rows(spark):
    docs = awkward(spark).coalesce(1)
    _, by_doc, _ = hold(docs, 64)
    assert sum(length for _, length in by_doc[1]) % 2 == 0 and by_doc[3] == by_doc[4] == [(0, 1)]
    assert packing.pack(empty(spark)).count() == 0


def test_neighbours_share_rare_terms():
    docs = [np.array(d, dtype=np.uint16) for d in ([1, 2, 3, 900], [1, 2, 4, 5], [6, 7, 900, 900], [1, 2, 3, 8])]
    index = packing.Index(docs)
    assert list(index.neighbours(docs[0], np.ones(4, bool)))[1:3] in ([2, 3], [3, 2])
    assert 2 not in list(index.neighbours(docs[0], np.array([True, True, False, True])))


def test_neighbours_score_every_term_of_long_seeds():
    """Documents of hundreds of terms: order and members as BM25 by its formula over all terms."""
    rng = np.random.default_rng(1)
    docs = [(rng.zipf(1.3, rng.integers(300, 1500)) % 4000).astype(np.uint16) for _ in range(60)]
    index, n, mean = packing.Index(docs), len(docs), np.mean([len(d) for d in docs])
    held = [dict(zip(*np.unique(d, return_counts=True))) for d in docs]
    df = Counter(t for h in held for t in h)

    def score(seed, i):
        norm = 1.2 * (1 - 0.75 + 0.75 * len(docs[i]) / mean)
        terms = set(seed.tolist()) & set(held[i])
        return sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * held[i][t] * 2.2 / (held[i][t] + norm) for t in terms)

    for seed in range(0, 60, 7):
        assert len(np.unique(docs[seed])) > 100
        unused = np.arange(n) != seed
        scores = [score(docs[seed], i) for i in range(n)]
        want = sorted((i for i in range(n) if unused[i] and scores[i] > 0), key=lambda i: (-scores[i], i))
        assert list(index.neighbours(docs[seed], unused)) == want


def test_packing_is_lexical():
    rng = np.random.default_rng(0)
    topics = [rng.integers(1000 * t, 1000 * t + 40, 100).astype(np.uint16) for t in range(4) for _ in range(10)]
    order = rng.permutation(40)
    packer = packing.Packer(0, 512)
    packer.shard([(int(i), topics[i]) for i in order])
    packer.close()
    groups = defaultdict(set)
    for doc, *_, seq, _ in packer.rows:
        groups[seq].add(doc // 10)
    assert np.mean([len(g) for g in groups.values()]) < 2.2


@pytest.mark.parametrize("size", [1, 63, 64, 65, 4097])
def test_sizes_around_the_window(size):
    packer = packing.Packer(3, 64)
    packer.shard([(9, np.arange(size, dtype=np.uint16))])
    packer.close()
    assert sum(r[2] for r in packer.rows) == size and all(r[5] >> 32 == 3 for r in packer.rows)
