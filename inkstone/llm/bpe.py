"""Byte-level BPE encoding and decoding with a pair occurrence index.

Each task takes its partition in runs of up to four million characters (or one longer text), which bounds its memory. It
gathers the words of a run that it hasn't met before in the partition, lays them out as one row of symbols and indexes
every mergeable pair by its rank with the list of all its positions there. Ranks are then applied in ascending order: a
rank merges all its positions at once, left to right, and the pairs that the merges make or break update the lists of
the affected ranks. Words once encoded stay in a bounded table, so that in the rest of the partition they cost a lookup.

Defined results: a null text counts as empty (no ids, empty decoded text); texts of any length are encoded whole; a
special token's string in a text becomes its single id, as in the tokenizers library; of equal pairs the leftmost merges
first; repeated rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The split of the public byte-level vocabularies, in full and for texts of ASCII alone.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+"
#: Words that a task remembers before it starts afresh.
REMEMBERED = 150_000
#: Position lists longer than this are merged as arrays.
LONG_LIST = 48


class PairIndexBpe:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab: dict[str, int] = spec["model"]["vocab"]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        shown = {b: chr(b) for b in printable}
        shown |= {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in shown)}
        to_byte = {c: b for b, c in shown.items()}
        self.byte_ids = np.array([vocab[shown[b]] for b in range(256)], np.int32)
        self.bytes_of = {i: bytes(to_byte[c] for c in t) for t, i in vocab.items() if all(c in to_byte for c in t)}
        self.rank: dict[int, int] = {}  # by both ids in one number
        self.merged: list[tuple[int, int, int]] = []
        for k, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << 20 | vocab[b]] = k
            self.merged.append((vocab[a], vocab[b], vocab[a + b]))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[int, ...]] = {}
        self._split, self._split_ascii = regex.compile(SPLIT).findall, re.compile(SPLIT_ASCII).findall

    def words(self, text: str) -> list[str]:
        return self._split_ascii(text) if text.isascii() else self._split(text)

    def learn(self, words: list[str]) -> None:
        """Encodes distinct new words together. Symbols lie in arrays, whose long position lists are merged as a whole."""
        data = [w.encode() for w in words]
        ends = np.cumsum([0, *map(len, data)])
        n = int(ends[-1])
        symbol = self.byte_ids[np.frombuffer(b"".join(data), np.uint8)]
        after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
        full = ends[:-1][np.diff(ends) > 0]
        before[full] = -1
        after[np.append(full[1:], n)[: len(full)] - 1] = -1
        places: dict[int, list] = {}
        active: list[int] = []

        def add(pairs: np.ndarray, at: np.ndarray) -> None:
            """Puts positions on the lists of their pairs' ranks."""
            if len(pairs) == 0:
                return
            order = np.argsort(pairs, kind="stable")
            pairs, at = pairs[order], at[order]
            cuts = np.flatnonzero(np.append(True, pairs[1:] != pairs[:-1]))
            for pair, group in zip(pairs[cuts].tolist(), np.split(at, cuts[1:]), strict=True):
                r = self.rank.get(pair)
                if r is not None:
                    if r not in places:
                        places[r] = []
                        heapq.heappush(active, r)
                    places[r].extend(group.tolist())

        left = np.flatnonzero(after >= 0)
        add(symbol[left].astype(np.int64) << 20 | symbol[after[left]], left)
        rank, sym, nxt, prv = self.rank, memoryview(symbol), memoryview(after), memoryview(before)
        while active:
            r = heapq.heappop(active)
            a, b, new = self.merged[r]
            found = places.pop(r)
            if len(found) > LONG_LIST and a != b:  # no two of its places overlap, so all merge at once
                p = np.unique(np.array(found, np.int64))
                q = after[p]
                ok = (q >= 0) & (symbol[p] == a) & (symbol[np.maximum(q, 0)] == b)
                p, q = p[ok], q[ok]
                symbol[p], symbol[q] = new, -1
                following = after[q]
                after[p] = following
                on = following >= 0
                before[following[on]] = p[on]
                add(np.int64(new) << 20 | symbol[following[on]], p[on])
                o = before[p]
                o = o[o >= 0]
                add(symbol[o].astype(np.int64) << 20 | new, o)
                continue
            for p in sorted(found):
                q = nxt[p]
                if q < 0 or sym[p] != a or sym[q] != b:
                    continue  # an earlier merge took one of the two
                sym[p], sym[q] = new, -1
                k = nxt[p] = nxt[q]
                if k >= 0:
                    prv[k] = p
                    if (x := rank.get(new << 20 | sym[k])) is not None:
                        if x not in places:
                            places[x] = []
                            heapq.heappush(active, x)
                        places[x].append(p)
                o = prv[p]
                if o >= 0 and (x := rank.get(sym[o] << 20 | new)) is not None:
                    if x not in places:
                        places[x] = []
                        heapq.heappush(active, x)
                    places[x].append(o)
        kept = symbol >= 0
        counts = np.append(0, np.cumsum(kept))[ends].tolist()
        ids = symbol[kept].tolist()
        self.known.update((w, tuple(ids[counts[k] : counts[k + 1]])) for k, w in enumerate(words))

    def encode_all(self, texts: list[str]) -> Iterator[list[int]]:
        """The ids of each text, in order; the new words of all the texts are encoded together."""
        parts = [[t] if self.cut is None else self.cut.split(t) for t in texts]
        split = [[[p] if k % 2 else self.words(p) for k, p in enumerate(x)] for x in parts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        self.learn([w for w in dict.fromkeys(chain.from_iterable(ws for x in split for ws in x[::2])) if w not in self.known])
        get = self.known.__getitem__
        for x in split:
            ids = list(chain.from_iterable(map(get, x[0])))
            for k in range(1, len(x)):
                ids.extend([self.special[x[k][0]]] if k % 2 else chain.from_iterable(map(get, x[k])))
            yield ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def codec(path: str) -> PairIndexBpe:
    return PairIndexBpe(path)


def _in_turn(texts: list[str], most: int = 4_000_000) -> Iterator[list[str]]:
    """Runs of consecutive texts of a bounded number of characters; a longer text makes a run of its own."""
    run: list[str] = []
    size = 0
    for t in texts:
        if run and size + len(t) > most:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def encode(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and ids of every text."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            at = 0
            for run in _in_turn([t or "" for t in batch.column(1).to_pylist()]):
                ids = pa.array(bpe.encode_all(run), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(run)), ids], ["doc_id", "ids"])
                at += len(run)

    return _plain(docs).mapInArrow(work, "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and the text that the ids stand for."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        for batch in batches:
            texts = pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id bigint, text string")


def digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """n_tokens, the digest of the ids and the digest of the decoded text of every document, ids made and read in one pass."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(tokenizer)
        written = [str(i) for i in range(max(bpe.bytes_of) + 1)].__getitem__
        for batch in batches:
            rows: list[tuple[int, str, str]] = []
            for run in _in_turn([t or "" for t in batch.column(1).to_pylist()]):
                for ids in bpe.encode_all(run):
                    listed = hashlib.sha256(",".join(map(written, ids)).encode()).hexdigest()
                    rows.append((len(ids), listed, hashlib.sha256(bpe.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _plain(docs).mapInArrow(work, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
