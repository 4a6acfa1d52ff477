"""Resampling towards a target distribution, with exact document weights from bit-sliced aggregation.

A feature is a run of one to LONGEST consecutive words; its bucket is the crc32 of its bytes modulo BUCKETS. A document's
bucket counts are kept as bit planes: plane k holds, for each bucket, bit k of its count, 10000 bits in 157 machine
words. A bucket's gain, the scaled logarithm of how much likelier the target makes it, is kept as planes too: bit j of
its size, once for the gains above zero and once for those below. The sum of the gains over a document's features is then

    sum over k and j of 2 ** (k + j) * (popcount(count_k AND above_j) - popcount(count_k AND below_j)),

which is exact whatever the counts, and its floored mean is the weight. Corpus and target totals are sums of the same
planes, one row a bucket from each task. The planes are written once and read twice.

The draw keeps the highest scores, weight plus Gumbel noise from a hash of the document's id. Scores are integers of a
range that the gains' and the noise's own ranges bound, so their histogram (at most some 150,000 rows) gives the score at
which the draw ends; only rows from there on are dealt out by ranges of score, sorted where they lie and numbered.

Defined results: a null text has no features, and a document without features has weight 0; texts of any length are read
whole; a null doc_id is hashed as the empty text and comes last among equal scores; rows that repeat a doc_id are
documents of their own, and which of fully equal rows gets the better rank is left open; an empty table gives no rows,
and an empty target gives gains from the documents alone; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ascii_words import words
from .common import settle

BUCKETS, LONGEST, SCALE = 10_000, 2, 1000
LEAST_WORDS, SEED = 20, 7
#: The share of eligible documents that is drawn, as a fraction.
SHARE = (25, 100)
#: Documents whose planes are worked on at once: about 2 MB for each bit of their largest count.
BLOCK = 500
PLANE_WORDS = -(-BUCKETS // 64)
PLANE_BYTES = 8 * PLANE_WORDS
PLANES = "doc_id bigint, n_words bigint, n_features bigint, planes binary"


def bucket_counts(found: list[bytes], longest: int = LONGEST) -> np.ndarray:
    """How many features of a document's words fall into each bucket. A run's crc32 goes on from that of the run one shorter."""
    sums = list(map(crc32, found))
    every = [sums]
    spaced = [b" " + w for w in found]
    for k in range(1, longest):
        sums = list(map(crc32, spaced[k:], sums))
        every.append(sums)
    buckets = np.fromiter(chain.from_iterable(every), np.int64) % BUCKETS
    return np.bincount(buckets, minlength=BUCKETS)


def to_planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of whole numbers, lowest bit first: a row of PLANE_WORDS machine words for each bit of the largest."""
    n = int(values.max(initial=0)).bit_length()
    bits = np.zeros((n, 64 * PLANE_WORDS), np.uint8)
    bits[:, : len(values)] = (values >> np.arange(n)[:, None]) & 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def plane_table(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_features and the planes of every row's bucket counts."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n_words, n_features, planes = [], [], []
                for text in batch.column(1):
                    found = words(text.as_py())
                    counts = bucket_counts(found)
                    n_words.append(len(found))
                    n_features.append(int(counts.sum()))
                    planes.append(to_planes(counts).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(planes, pa.binary())], ["doc_id", "n_words", "n_features", "planes"])

    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"))
    return plain.mapInArrow(work, PLANES)


def stacked(held: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The planes of several documents as rows, with each row's document and bit."""
    sizes = np.array([len(x) // PLANE_BYTES for x in (v.as_py() for v in held)], np.int64)
    rows = np.frombuffer(b"".join(v.as_py() for v in held), np.uint64).reshape(-1, PLANE_WORDS)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    bit = np.arange(len(rows)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return rows, owner, bit


def totals(planes: DataFrame) -> np.ndarray:
    """Features in each bucket over all rows."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                rows, _, bit = stacked(whole.column(0).slice(at, BLOCK))
                for k in np.unique(bit):
                    total += np.unpackbits(rows[bit == k].view(np.uint8), axis=1, bitorder="little")[:, :BUCKETS].sum(axis=0, dtype=np.int64) << k
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    got = planes.select("planes").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.int64)
    out[got["bucket"].to_numpy()] = got["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Each bucket's gain: the floored, scaled logarithm of its smoothed share in the target over that in the source."""
    s_all, t_all = float(source.sum() + BUCKETS), float(target.sum() + BUCKETS)
    return np.array([math.floor(SCALE * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


class GainPlanes:
    """Signed gains as planes, which sum the gains over the features of documents."""

    def __init__(self, gain: np.ndarray):
        self.signed = [(1, to_planes(np.maximum(gain, 0))), (-1, to_planes(np.maximum(-gain, 0)))]

    def sums(self, held: pa.Array) -> np.ndarray:
        """The sum of gains over each document's features."""
        rows, owner, bit = stacked(held)
        found = np.zeros(len(rows), np.int64)
        for sign, planes in self.signed:
            for j, plane in enumerate(planes):
                found += sign * (np.bitwise_count(rows & plane).sum(axis=1, dtype=np.int64) << j)
        out = np.zeros(len(held), np.int64)
        np.add.at(out, owner, found << bit)
        return out


def weighted(planes: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of every row. The gains go to the tasks as planes, at most some 80 kB."""
    held = planes.sparkSession.sparkContext.broadcast(GainPlanes(gain))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                n = batch.column(2).to_numpy()
                weight = held.value.sums(batch.column(3)) // np.maximum(n, 1)
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weight, pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return planes.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def noise(seed: int) -> Column:
    """Scaled Gumbel noise from the hash of a document's id."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296)))


def draw(scored: DataFrame, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """scored (doc_id, n_words, score and more) with rank: 1, 2, 3 ... for the share of eligible rows that is drawn, else null.

    scored must give the same rows each time it is read."""
    spark = scored.sparkSession
    able = F.col("n_words") >= least_words
    counts = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).toArrow().sort_by([("score", "descending")])
    reached = np.cumsum(counts["n"].to_numpy())
    n_drawn = share[0] * int(reached[-1] if len(reached) else 0) // share[1]
    blank = F.lit(None).cast("long").alias("rank")
    if not n_drawn:
        return scored.select("*", blank)
    last = counts["score"][int(np.searchsorted(reached, n_drawn))].as_py()
    near = able & (F.col("score") >= last)
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("apart")]
    top = scored.where(near).withColumn("apart", F.xxhash64(F.monotonically_increasing_id()))  # equal rows can part at a bound of ranges
    dealt = top.repartitionByRange(*order).sortWithinPartitions(*order).drop("apart")
    place = F.monotonically_increasing_id()
    dealt = settle(dealt.select("*", F.shiftright(place, 33).alias("part"), place.bitwiseAND((1 << 33) - 1).alias("place")), "drawn")
    sizes = sorted((r["part"], r["n"]) for r in dealt.groupBy("part").agg(F.count("*").alias("n")).collect())  # one row a task
    before = np.cumsum([0] + [n for _, n in sizes]).tolist()
    starts = spark.createDataFrame([(p, b) for (p, _), b in zip(sizes, before, strict=False)], "part bigint, before bigint")
    rank = F.col("before") + F.col("place") + 1
    numbered = dealt.join(F.broadcast(starts), "part").select(*scored.columns, F.when(rank <= n_drawn, rank).alias("rank"))
    return numbered.unionByName(scored.where(~near).select("*", blank))


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, least_words: int = LEAST_WORDS, share: tuple[int, int] = SHARE) -> DataFrame:
    """doc_id, n_features, weight, score, rank and n_words of every row of docs; target gives the texts to be like."""
    planes = settle(plane_table(docs), "planes", compression="zstd")
    like = plane_table(target.select(F.lit(None).alias("doc_id"), "text"))
    gain = gains(totals(planes), totals(like))
    scored = weighted(planes, gain)
    scored = settle(scored.withColumn("score", F.col("weight") + noise(seed)), "scored")
    return draw(scored, least_words, share).select("doc_id", "n_features", "weight", "score", "rank", "n_words")


_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_RUNS = "list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
ORACLE_SQL = f"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS r, doc_id, len(w) AS n_words, {_RUNS} AS f FROM (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents)),
b AS (SELECT {_RUNS} AS f FROM (SELECT coalesce({_WORDS}, []) AS w FROM benchmark)),
df AS (SELECT r, feature, count(*) AS c FROM (SELECT r, unnest(f) AS feature FROM d) GROUP BY ALL),
bf AS (SELECT feature, count(*) AS c FROM (SELECT unnest(f) AS feature FROM b) GROUP BY ALL),
crc_table AS MATERIALIZED (SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(n)),
step(feature, bytes, pos, c) AS (
    SELECT feature, hex(encode(feature)), CAST(1 AS BIGINT), CAST(4294967295 AS BIGINT) FROM (SELECT feature FROM df UNION SELECT feature FROM bf)
    UNION ALL
    SELECT feature, bytes, pos + 2, xor(c >> 8, v) FROM step JOIN crc_table ON n = xor(c & 255, CAST('0x' || substr(bytes, pos, 2) AS BIGINT)) WHERE pos < strlen(bytes)),
k AS (SELECT feature, xor(c, 4294967295) % 10000 AS bucket FROM step WHERE pos > strlen(bytes)),
s AS (SELECT bucket, sum(c) AS s FROM df JOIN k USING (feature) GROUP BY bucket),
t AS (SELECT bucket, sum(c) AS t FROM bf JOIN k USING (feature) GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln((coalesce(t, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(s), 0) FROM s) + 10000) / ((coalesce(s, 0) + 1.0::DOUBLE) * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)))) AS BIGINT) AS gain
      FROM (SELECT CAST(unnest(range(10000)) AS BIGINT) AS bucket) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)),
w AS (SELECT r, CAST(floor(CAST(sum(c * gain) AS DOUBLE) / sum(c)) AS BIGINT) AS weight FROM df JOIN k USING (feature) JOIN g USING (bucket) GROUP BY r),
x AS (SELECT doc_id, n_words, len(f) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM d LEFT JOIN w USING (r)),
o AS (SELECT *, CASE WHEN n_words >= 20 THEN row_number() OVER (PARTITION BY n_words >= 20 ORDER BY score DESC, doc_id) END AS place FROM x)
SELECT doc_id, n_features, weight, score, CASE WHEN place <= 25 * (SELECT count(*) FROM x WHERE n_words >= 20) // 100 THEN place END AS rank, n_words FROM o
"""
