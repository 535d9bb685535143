"""Packing documents into fixed windows by lexical retrieval.

Each scan partition is packed where it is read, so nothing is shuffled. Its documents are cut into shards; a shard
gets a BM25 inverted index over token ids, and every window is filled greedily from the unused neighbours that the
index returns for the window's seed document. The document that overflows a window is cut, and what is left of it
seeds the next one. Only the last window of a partition can be short; it is cut into powers of two, which need no
padding.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded, returning, settle, table

WINDOW = 2048
END_ID = 1
SHARD_DOCS = 2048
SHARD_TOKENS = 4_000_000
K1, B = 1.2, 0.75
DENSE = 16
BLOCK_DOCS, BLOCK_CHARS = 1024, 4_000_000
SLICE = 1 << 17

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long"
)


def _byte_of_symbol() -> dict[str, int]:
    """The byte that each symbol of a byte-level vocabulary stands for: printable ones for themselves."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class Tokens:
    """Ids of whole texts under a byte-level BPE file.

    The strings of added tokens are cut out first, wherever they stand, and have ids of their own. A space between two
    other characters always starts a new piece of the vocabulary's splitting pattern, so texts may be cut there, and
    each different word of a block of texts is encoded once. Texts with runs of spaces go to the encoder whole. Nothing
    is kept from one block to the next.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._added = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        if any(x.get(k) for x in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with conditions on what is around them are not supported")
        longest = sorted(self._added, key=len, reverse=True)
        self._cut = re.compile(f"({'|'.join(map(re.escape, longest))})") if longest else None
        symbol = _byte_of_symbol()
        ranks = {bytes(map(symbol.__getitem__, k)): v for k, v in spec["model"]["vocab"].items() if k not in self._added}
        self._encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._spaced = np.zeros(1 << 16, dtype=bool)
        self._spaced[[v for k, v in ranks.items() if k[:1] == b" "]] = True

    def _exact(self, text: str) -> np.ndarray:
        return np.array(self._encoding.encode_ordinary(text), dtype=np.uint16)

    def _whole(self, text: str) -> np.ndarray:
        if self._cut and self._cut.search(text):
            parts = enumerate(self._cut.split(text))  # every second part is an added token
            return np.concatenate([np.array([self._added[p]], np.uint16) if i % 2 else self._exact(p) for i, p in parts if p])
        return self._exact(text)

    def ids(self, text: str) -> np.ndarray:
        return self.block([text])[0]

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The ids of a word start where an id's bytes start with a space."""
        out: list = [None] * len(texts)
        cut = []
        for i, text in enumerate(texts):
            if " " not in text or "  " in text or text[0].isspace() or text[-1].isspace() or self._cut and self._cut.search(text):
                out[i] = self._whole(text)
            else:
                cut.append(i)
        if not cut:
            return out
        first, rest = zip(*(texts[i].split(" ", 1) for i in cut))
        words = pc.split_pattern(pa.array(rest, pa.large_string()), " ")
        ends = np.asarray(words.offsets)[1:]
        found = words.values.dictionary_encode()
        del words, rest
        number, count = np.asarray(found.indices), len(found.dictionary)
        different = pa.ListArray.from_arrays(pa.array([0, count], pa.int32()), found.dictionary)
        ids = self._exact(" " + pc.binary_join(different, pa.scalar(" ", pa.large_string()))[0].as_py())
        del found, different
        starts = np.flatnonzero(self._spaced[ids])
        if len(starts) != count:
            raise ValueError("the splitting pattern joins what spaces divide")
        sizes = np.diff(np.r_[starts, len(ids)])
        a = 0
        for i, head, b in zip(cut, first, ends):  # all ids of a text: a run of them for each of its words
            own = number[a:b]
            size = sizes[own]
            end = np.cumsum(size)
            at = np.repeat(starts[own] - end + size, size) + np.arange(end[-1])
            out[i] = np.concatenate([self._exact(head), ids[at]])
            a = b
        return out


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _tokens(path: str) -> Tokens:
    import public_tokenizers

    return Tokens(path, public_tokenizers.PATTERN)


class Index:
    """A shard's BM25 inverted index: postings (document, impact) by token id.

    A term that more than one in DENSE documents hold is kept as a row of impacts, zero where it is absent: adding
    rows is quicker than scattering long postings."""

    def __init__(self, docs: list[np.ndarray]):
        self.n = len(docs)
        lengths = np.array([len(d) for d in docs], dtype=np.float64)
        pairs = np.empty(int(lengths.sum()), dtype=np.uint32)
        at = 0
        for i, d in enumerate(docs):
            pairs[at : at + len(d)] = d.astype(np.uint32) << 11 | np.uint32(i)
            at += len(d)
        pairs.sort()
        starts = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1], True])
        slices = [slice(a, a + SLICE) for a in range(0, len(starts) - 1, SLICE)]  # temporaries of all would be long
        df = np.zeros(1 << 16, dtype=np.int64)
        for s in slices:
            df += np.bincount(pairs[starts[:-1][s]] >> 11, minlength=1 << 16)
        idf = np.log1p((self.n - df + 0.5) / (df + 0.5))
        norm = K1 * (1 - B + B * lengths / lengths.mean())
        dense = df * DENSE > self.n
        self.row = np.where(dense, np.cumsum(dense) - 1, -1)
        self.rows = np.zeros((int(dense.sum()), self.n))
        self.at = np.r_[0, np.cumsum(np.where(dense, 0, df))]
        self.doc, self.impact = np.empty(self.at[-1], dtype=np.uint16), np.empty(self.at[-1])
        at = 0
        for s in slices:
            pair, tf = pairs[starts[:-1][s]], starts[1:][s] - starts[:-1][s]
            doc, term = pair & 2047, pair >> 11
            impact = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
            often = dense[term]
            self.rows[self.row[term[often]], doc[often]] = impact[often]
            end = at + len(pair) - int(often.sum())
            self.doc[at:end], self.impact[at:end] = doc[~often], impact[~often]
            at = end

    def scores(self, seed: np.ndarray) -> np.ndarray:
        """BM25 of every document by all of the seed's terms."""
        terms = np.unique(seed)
        row = self.row[terms]
        score = self.rows[row[row >= 0]].sum(axis=0)
        a, b = self.at[terms[row < 0]], self.at[terms[row < 0] + 1]
        size = b - a
        if size.sum():
            at = np.repeat(a - np.cumsum(size) + size, size) + np.arange(size.sum())
            score += np.bincount(self.doc[at], weights=self.impact[at], minlength=self.n)
        return score

    def neighbours(self, seed: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        """Unused documents by the BM25 score of all of the seed's terms, best first, ties by position; sorted as far
        as they are asked for."""
        score = self.scores(seed)
        found = np.flatnonzero((score > 0) & unused)
        score, count = score[found], 16
        while len(found):
            least = np.partition(score, -count)[-count] if count < len(score) else -np.inf
            best = score >= least
            yield from found[best][np.argsort(-score[best], kind="stable")].tolist()
            found, score, count = found[~best], score[~best], 8 * count


class Packer:
    """Packs one partition; rows() hands over the finished pieces."""

    def __init__(self, part: int, window: int = WINDOW):
        self.window, self.next_id = window, part << 32
        self.open: list[tuple] = []
        self.room = window
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.rows.append((doc_id, start, len(ids), crc, total, self.next_id, at))
            at += len(ids)
        self.next_id += 1

    def put(self, doc_id, start: int, ids: np.ndarray, total: int) -> np.ndarray:
        """Fill the open window from ``ids``; what does not fit comes back."""
        part = ids[: self.room]
        self.open.append((doc_id, start, part, total))
        self.room -= len(part)
        if not self.room:
            self._emit(self.open)
            self.open, self.room = [], self.window
        return ids[len(part) :]

    def shard(self, docs: list[tuple]) -> None:
        """docs: (doc_id, ids). Whole windows of long documents go out first, the rest is packed by retrieval."""
        rest = []
        for doc_id, ids in docs:
            cut = len(ids) - len(ids) % self.window
            for a in range(0, cut, self.window):
                self._emit([(doc_id, a, ids[a : a + self.window], len(ids))])
            if cut < len(ids):
                rest.append((doc_id, cut, ids[cut:], len(ids)))
        if not rest:
            return
        index, unused = Index([r[2] for r in rest]), np.ones(len(rest), dtype=bool)
        cursor, queue, seed = 0, iter(()), None
        while True:
            if seed is None or self.room == self.window and not self.open:
                queue = iter(())
            pick = next((i for i in queue if unused[i]), None)
            if pick is None:
                while cursor < len(rest) and not unused[cursor]:
                    cursor += 1
                if cursor == len(rest):
                    return
                pick = cursor
                seed = None
            unused[pick] = False
            doc_id, start, ids, total = rest[pick]
            left = self.put(doc_id, start, ids, total)
            if len(left):  # the window was closed; the rest of this document seeds the next one
                left = self.put(doc_id, start + len(ids) - len(left), left, total)
                seed = None
            if self.open and seed is None:
                seed = pick
                queue = index.neighbours(ids, unused)

    def close(self) -> None:
        """Cut the last, short window into sequences of powers of two."""
        pieces, left = self.open, self.window - self.room
        self.open, self.room = [], self.window
        while left:
            size = 1 << (left.bit_length() - 1)
            taken, kept, need = [], [], size
            for doc_id, start, ids, total in pieces:
                part = ids[:need]
                need -= len(part)
                if len(part):
                    taken.append((doc_id, start, part, total))
                if len(part) < len(ids):
                    kept.append((doc_id, start + len(part), ids[len(part) :], total))
            self._emit(taken)
            pieces, left = kept, left - size


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """doc_ids and texts, as many at once as the bounds on a block allow; a longer text is a block of its own."""
    doc_ids, texts, size = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 128):
            part = batch.slice(at, 128)
            for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                text = text or ""
                if texts and (len(texts) == BLOCK_DOCS or size + len(text) > BLOCK_CHARS):
                    yield doc_ids, texts
                    doc_ids, texts, size = [], [], 0
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text)
    if texts:
        yield doc_ids, texts


def _pack_batches(path: str, window: int):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def flush(packer: Packer) -> pa.RecordBatch:
        columns = list(zip(*packer.rows)) or [()] * len(names)
        packer.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, tokens, shard, held = Packer(TaskContext.get().partitionId(), window), loaded(_tokens, path), [], 0
        end = np.array([END_ID], dtype=np.uint16)
        for doc_ids, texts in _blocks(batches):
            for doc_id, own in zip(doc_ids, tokens.block(texts)):
                ids = np.concatenate([own, end])
                shard.append((doc_id, ids))
                held += len(ids)
                if len(shard) == SHARD_DOCS or held > SHARD_TOKENS:
                    packer.shard(shard)
                    shard, held = [], 0
                    yield flush(packer)
        packer.shard(shard)
        packer.close()
        yield flush(packer)

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, window: int = WINDOW) -> DataFrame:
    """(doc_id, text) -> one row per piece: its document, place there, checksum of ids, sequence and offset.

    A null or empty text is the end id alone. Repeated rows are packed as often as they come; rows without doc_id
    keep null. Other columns are ignored, an empty table gives no pieces. ``window`` must be a power of two. Sequence
    ids are unique and grow within a scan partition; they depend on how the input is split into partitions. The pieces
    are settled: few bytes, and only so can the batches of texts be bounded without a setting of the caller's session.
    """
    chosen = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return settle(chosen.mapInArrow(returning(_pack_batches(tokenizer or default_tokenizer(), window)), SCHEMA), "pieces")


def op7_lexical_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
