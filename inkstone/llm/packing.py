"""Best-fit packing of token sequences, improved by a swap-based local search.

Documents are tokenized, cut into pieces of at most ``capacity`` tokens and dealt by a hash of the row's number into
groups; so a group has about ``group_pieces`` pieces whatever ids the rows carry (the sizes are binomial, a group of
twice the mean doesn't occur). Each group is packed best-fit decreasing; then the emptiest bin gives its pieces away to
fuller bins by moves, one-for-one, one-for-two and two-for-one exchanges, each of which raises the sum of squared fills,
until the bin is empty or none helps. Every piece and every pair of pieces of every bin is considered: only lengths
matter, and the distinct lengths of a bin are few because they must add up to no more than its capacity. Bins that are
exactly full are closed. The pieces of bins that stay open meet again, dealt anew, level by level, until one group holds
them all or a level saves under one sequence in a thousand.

Defined results: a null text counts as empty and makes one piece that holds only the end mark; texts of any length are
encoded whole; of pieces of one length any order is as good, and the one by doc_id, piece and start is taken; repeated
rows are packed as separate pieces; an empty table gives no rows; other columns of the input are not read.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
PACKED = f"{PIECES}, row bigint, sequence_id bigint, offset bigint, is_open boolean"
#: About how many pieces one task packs together.
GROUP_PIECES = 4096
#: The share of the open sequences that a level must save for another to follow.
LEAST_SAVED = 0.001


@lru_cache(maxsize=2)
def encoder(path: str):
    """Text to ids as the tokenizers library gives them for a byte-level BPE file, its special tokens found in texts included."""
    import json
    import re

    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    to_byte = {chr(b): b for b in visible}
    to_byte |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(visible))}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(to_byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    from public_tokenizers import PATTERN

    plain = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    cut = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def encode(text: str) -> list[int]:
        if cut is None or not cut.search(text):
            return plain(text)
        ids: list[int] = []
        for part in cut.split(text):
            ids += [special[part]] if part in special else plain(part)
        return ids

    return encode


def cut_pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece: the first takes the remainder, all others are full."""
    first = len(ids) % capacity or capacity
    if len(ids) <= capacity:
        return [(0, len(ids))]
    return [(0, first)] + [(s, capacity) for s in range(first, len(ids), capacity)]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int) -> DataFrame:
    """A row for each piece of each document, with the checksum of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*encode(text.as_py() or ""), end_id], dtype="<u4")
                for k, (start, length) in enumerate(cut_pieces(ids, capacity)):
                    rows.append((doc_id, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            if rows:
                cols = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each piece, best-fit decreasing."""
    bins = np.empty(len(lengths), np.int64)
    free: list[tuple[int, int]] = []
    n = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        at = bisect.bisect_left(free, (size, -1))
        if at < len(free):
            room, k = free.pop(at)
        else:
            room, k, n = capacity, n, n + 1
        bins[i] = k
        if room > size:
            bisect.insort(free, (room - size, k))
    return bins


def improve(lengths: np.ndarray, bins: np.ndarray, capacity: int) -> np.ndarray:
    """The local search. Every step takes tokens from the emptiest open bin to a bin that is at least as full."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    stuck = np.zeros(len(fill), bool)
    while True:
        usable = np.flatnonzero((fill > 0) & (fill < capacity) & ~stuck)
        if not len(usable):
            return bins
        source = usable[np.argmin(fill[usable])]
        mine = np.flatnonzero(bins == source)
        others = np.flatnonzero((fill[bins] < capacity) & (bins != source) & (fill[bins] >= fill[source]))
        step = _step(lengths, bins, fill, capacity, mine, others)
        if step is None:
            stuck[source] = True
            continue
        give, take, target = step
        bins[give] = target
        bins[take] = source
        gain = int(lengths[give].sum() - lengths[take].sum())
        fill[target] += gain
        fill[source] -= gain


def _pairs(lengths: np.ndarray, bins: np.ndarray, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bin and each two lengths that it holds, two pieces of them. The pieces are sorted by bin and length."""
    starts = np.ones(len(pieces), bool)
    starts[1:] = (bins[pieces][1:] != bins[pieces][:-1]) | (lengths[pieces][1:] != lengths[pieces][:-1])
    nth = np.arange(len(pieces)) - np.flatnonzero(starts)[np.cumsum(starts) - 1]
    pieces = pieces[nth < 2]  # two of a length suffice
    at = bins[pieces]
    begin = np.concatenate([[True], at[1:] != at[:-1]])
    size = np.diff(np.append(np.flatnonzero(begin), len(pieces)))
    later = np.repeat(size, size) - (np.arange(len(pieces)) - np.repeat(np.flatnonzero(begin), size)) - 1
    one = np.repeat(np.arange(len(pieces)), later)
    two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(later) - later, later)
    return pieces[one], pieces[two]


def _step(lengths, bins, fill, capacity, mine, others):
    """(pieces given, pieces taken, target bin) of the step that raises squared fill most, the simplest kind first."""
    if not len(others):
        return None
    source = fill[bins[mine[0]]]
    none = np.empty(0, np.int64)

    def best(give: np.ndarray, taken: np.ndarray, where: np.ndarray) -> tuple[int, int, int] | None:
        """(value, which size is given, which of taken) of the best exchange; give is sorted, taken are sizes in bins where."""
        if not len(give) or not len(taken):
            return None
        k = np.searchsorted(give, taken + capacity - fill[where], "right") - 1
        gain = np.where(k >= 0, give[k] - taken, 0)
        value = np.where(gain > 0, gain * (fill[where] - source + gain), 0)
        top = int(np.argmax(value))
        return (int(value[top]), int(k[top]), top) if value[top] > 0 else None

    sizes, of = np.unique(lengths[mine], return_index=True)
    targets = np.unique(bins[others])
    if found := best(sizes, np.zeros(len(targets), np.int64), targets):
        return mine[[of[found[1]]]], none, targets[found[2]]
    _, once = np.unique(bins[others] * np.int64(capacity + 1) + lengths[others], return_index=True)
    single = others[once]
    if found := best(sizes, lengths[single], bins[single]):
        return mine[[of[found[1]]]], single[[found[2]]], bins[single[found[2]]]
    order = others[np.lexsort((lengths[others], bins[others]))]
    one, two = _pairs(lengths, bins, order)
    for_two = best(sizes, lengths[one] + lengths[two], bins[one])
    x, y = _pairs(lengths, bins, mine[np.argsort(lengths[mine], kind="stable")])
    sums, of_two = np.unique(lengths[x] + lengths[y], return_index=True)
    two_for = best(sums, lengths[single], bins[single])
    if for_two and (two_for is None or for_two[0] >= two_for[0]):
        k = for_two[2]
        return mine[[of[for_two[1]]]], np.array([one[k], two[k]]), bins[one[k]]
    if two_for:
        k = of_two[two_for[1]]
        return np.array([x[k], y[k]]), single[[two_for[2]]], bins[single[two_for[2]]]
    return None


def pack_group(frame: pd.DataFrame, capacity: int, first_id: int) -> pd.DataFrame:
    """Packs the pieces of one group; sequence ids count up from first_id."""
    frame = frame.sort_values(["length", "doc_id", "piece", "start", "row"], kind="stable").reset_index(drop=True)
    lengths = frame["length"].to_numpy(np.int64)
    bins = improve(lengths, best_fit(lengths, capacity), capacity)
    _, bins = np.unique(bins, return_inverse=True)
    order = np.argsort(bins, kind="stable")
    frame, bins, lengths = frame.iloc[order], bins[order], lengths[order]
    ends = np.cumsum(lengths)
    fill = np.bincount(bins, weights=lengths).astype(np.int64)
    frame = frame[["doc_id", "piece", "start", "length", "ids_crc32", "row"]].copy()
    frame["sequence_id"] = first_id + bins
    frame["offset"] = ends - lengths - (np.cumsum(fill) - fill)[bins]
    frame["is_open"] = fill[bins] < capacity
    return frame


def _packer(capacity: int, first: int):
    def one(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        return pack_group(frame, capacity, first + (int(key[0]) << 20))

    return one


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """A row for each piece with its sequence and its place there. Lays intermediate tables in the shared folder."""
    numbered = pieces(docs, tokenizer, capacity, end_id).withColumn("row", F.monotonically_increasing_id())
    level, rest, n, held, done = 0, settle(numbered, "pieces"), None, None, []
    while True:
        n = rest.count() if n is None else n
        groups = max(1, -(-n // group_pieces))
        dealt = rest.select(*numbered.columns).withColumn("grp", F.pmod(F.xxhash64("row", F.lit(level)), F.lit(groups)))
        packed = settle(dealt.groupBy("grp").applyInPandas(_packer(capacity, level << 54), PACKED), "packed")
        first = (F.col("offset") == 0).cast("long")  # a sequence has one piece there
        count = packed.agg(F.sum(first).alias("sequences"), F.sum(F.col("is_open").cast("long")).alias("pieces"), F.sum(F.when(F.col("is_open"), first)).alias("held")).first()
        if held is not None and (count["sequences"] or 0) > held * (1 - LEAST_SAVED):
            done.append(packed if count["sequences"] <= held else rest)
            break
        if groups == 1 or not count["pieces"]:
            done.append(packed)
            break
        done.append(packed.where("not is_open"))
        level, rest, n, held = level + 1, packed.where("is_open"), count["pieces"], count["held"]
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.drop("is_open", "row")
