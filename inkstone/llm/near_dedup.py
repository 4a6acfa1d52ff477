"""Near-duplicate classes by ProbMinHash over weighted five-word shingles, banding and verification.

Shingles are weighted 1 + ln(count). Every shingle is a Poisson process whose rate is its weight; its arrivals fall on
random registers, a register keeps the shingle of its earliest arrival, and a shingle stops as soon as its next arrival
comes later than all registers of its document. Two documents agree in a register with their probability Jaccard. That may
lie far below the Jaccard similarity of their shingle sets where a passage is repeated in one and stands once in the
other, so a document with repeated shingles has a second signature, in which all its weights are one; two such signatures
agree in a register with the Jaccard similarity itself. Where nothing is repeated both signatures are the same.

Texts with the same words are one node, so copies are never compared. The signatures' bands deal the nodes into
buckets. A shingle that only one node holds can't be shared, which bounds every similarity from above: nodes of which
too many shingles are their own have no partner and leave, and pairs that the bound rules out are not formed. Nor are
pairs whose distances from the bucket's first leader differ too much, for Jaccard distance obeys the triangle rule. In a
few rounds every node of a bucket meets the bucket's leader, first the node with the fewest shingles of its own, then any;
pairs are verified by the Jaccard similarity of their shingle sets, and verified links are joined to classes by
alternating large-star and small-star steps. Nodes of one class need not meet again, so buckets of one class are done.

What the leaders missed is found in one last comparison of the nodes whose buckets still hold two classes, and it is
exact. Order a node's shingles by the number of such nodes that hold them. Two similar nodes share one of the first
n - ceil(similarity * n) + 1 shingles of each. If the rarest shingle they share has few holders, the lists of holders of
such rare shingles give the pair; a list has at most RARE nodes, so these pairs are in proportion to the shingles. If it
has many, all that they share is common shingles, and both must hold enough of those; such pairs meet in their buckets,
the nodes outside a bucket's largest class against its other classes. Random edits of one text hold rare shingles of
their own, so a large group of them that aren't linked makes few pairs.

All of it is joins and aggregates; no group is gathered in a task, and the side of a join that holds leaders, verdicts
or labels is unique by key, so adaptive execution can split a hot one.

Defined results: texts of any length are read whole; words are runs of letters, digits and underscores, lower-cased. A text of one to four words has one
shingle, so it is similar only to the same words. Texts without a word (null and empty too) are copies of one another.
A class is named by its smallest doc_id, a null doc_id counting as smallest, and that document stays; of repeated rows
one stays. An empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside_row, discard, settle

WIDTH = 5
SIMILARITY = 0.8
#: A pair of similarity 0.8 shares no band with probability 2e-5, one of 0.85 with 2e-8, however often shingles are repeated.
BANDS, ROWS = 36, 6
#: Words whose shingles a task holds at once, beside one whole text.
RUN_WORDS = 100_000
#: Words whose hashes a worker keeps between texts. An executor may keep more workers than it has cores, and each keeps its own.
HASHED_WORDS = 30_000
#: Rounds of leaders before the comparison across classes.
LEADERS = 3
#: The most holders of a shingle that counts as rare in the comparison across classes; pairs beyond it meet in buckets.
RARE = 32
#: What bounds are lowered by, for a bound computed in doubles may lie just above a pair that meets it exactly.
SLACK = 1e-9
NO_ID = -(2**63)

_word = re.compile(r"\w+").findall
_GOLD, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class _Hashes(dict):
    """Word to 64-bit hash; starts afresh when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= HASHED_WORDS:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


_hash = _Hashes()


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer."""
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[str]:
    return _word((text or "").lower())


def shingles(words: list[str], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of a text, ascending, and their counts."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    h = np.fromiter(map(_hash.__getitem__, words), np.uint64, len(words))
    if len(h) < width:
        h = np.concatenate([h, np.full(width - len(h), len(h), np.uint64)])
    n = len(h) - width + 1
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = mix(out + h[k : k + n] * _GOLD + np.uint64(k + 1))
    return np.unique(out, return_counts=True)


def prob_minhash(elements: np.ndarray, weights: np.ndarray, doc: np.ndarray, n_docs: int, k: int) -> np.ndarray:
    """Signatures (n_docs, k) of documents whose weighted elements stand one after another."""
    time = np.full(n_docs * k, np.inf)
    kept = np.zeros(n_docs * k, np.uint64)
    at = np.zeros(len(elements))
    e, w, d = elements, weights, doc
    arrival = 0
    while len(e):
        arrival += 1
        draw = mix(e + np.uint64(arrival * int(_GOLD) % 2**64))
        at = at - np.log(((draw >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53) / w
        slot = d * k + (mix(draw ^ _B) % np.uint64(k)).astype(np.int64)
        np.minimum.at(time, slot, at)
        won = time[slot] == at
        kept[slot[won]] = e[won]
        if len(e) > n_docs:
            last = time.reshape(n_docs, k).max(axis=1)[d]
        else:
            own, back = np.unique(d, return_inverse=True)
            last = time.reshape(n_docs, k)[own].max(axis=1)[back]
        on = at < last
        e, w, d, at = e[on], w[on], d[on], at[on]
    return kept.reshape(n_docs, k)


def bands_of(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(n_docs, bands) keys; equal where all rows of the band are equal."""
    out = np.zeros((len(signature), bands), np.uint64)
    out += np.arange(bands, dtype=np.uint64)
    for r in range(rows):
        out = mix(out + signature[:, r::rows][:, :bands] * _GOLD)
    return out.view(np.int64)


def _signed(bands: int, rows: int):
    """(doc_id, text_hash, row, text) to (doc_id, text_hash, row, words_key, bands)."""

    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()))
    names = ["doc_id", "text_hash", "row", "words_key", "bands"]

    def flush(run: list[tuple]) -> pa.RecordBatch:
        sizes = [len(x[4]) for x in run]
        full = [k for k, n in enumerate(sizes) if n]
        keys: list = [[] for _ in run]
        for weighted in (False, True):
            of = [k for k in full if not weighted or run[k][5].max() > 1]
            if not of:
                continue
            e = np.concatenate([run[k][4] for k in of])
            w = 1.0 + np.log(np.concatenate([run[k][5] for k in of])) if weighted else np.ones(len(e))
            d = np.repeat(np.arange(len(of)), [sizes[k] for k in of])
            for k, b in zip(of, bands_of(prob_minhash(e, w, d, len(of), bands * rows), bands, rows), strict=True):
                keys[k] = np.union1d(keys[k], b) if weighted else b
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((*([x[k] for x in run] for k in range(4)), keys), types, strict=True)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            run: list[tuple] = []
            size = 0
            for i, t, row, text in zip(*(batch.column(c) for c in range(4)), strict=True):
                words = words_of(text.as_py())
                key = hashlib.blake2b(" ".join(words).encode(), digest_size=16).hexdigest()
                run.append((i.as_py(), t.as_py(), row.as_py(), key, *shingles(words)))
                size += len(words)
                if size > RUN_WORDS:
                    yield flush(run)
                    run, size = [], 0
            if run:
                yield flush(run)

    return work


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, text) to (node, shingles); 32 bits of a shingle's hash are kept, which moves a similarity by under 1e-4."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [np.unique(shingles(words_of(x.as_py()))[0].astype(np.uint32)).view(np.int32) for x in part.column(1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int32()))], ["node", "shingles"])


def _identified(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _similarities(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b, root_a, root_b) with the Jaccard similarity of their shingle sets."""
    left = sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b"))
    right = sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a"))
    both = F.size(F.array_intersect("set_a", "set_b"))
    joined = pairs.join(left, "b").join(right, "a").withColumn("both", both)
    return joined.select("a", "b", "root_a", "root_b", (F.col("both") / (F.size("set_a") + F.size("set_b") - F.col("both"))).alias("similarity"))


def _relabel(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """rows with their root replaced by the root of the class that it has joined."""
    new = roots.select(F.col("node").alias("root"), F.col("root").alias("__new"))
    return rows.join(new, "root", "left").withColumn("root", F.coalesce("__new", "root")).drop("__new")


def _open(rows: DataFrame, label: str = "root") -> DataFrame:
    """The rows of buckets that hold two classes or more. The list of these is written first, so that the join deals out
    both of its sides anew and can split a bucket that holds very many nodes."""
    mixed = rows.groupBy("bucket").agg(F.min(label).alias("lo"), F.max(label).alias("hi")).where("lo < hi").select("bucket")
    return rows.join(settle(mixed, "open-buckets"), "bucket").select(*rows.columns)


def _held(sets: DataFrame) -> DataFrame:
    """(shingle, holders, node): how many nodes hold each shingle, and the smallest of them."""
    return sets.select("node", F.explode("shingles").alias("shingle")).groupBy("shingle").agg(F.count("*").alias("holders"), F.min("node").alias("node"))


def _linkable(sets: DataFrame, similarity: float) -> DataFrame:
    """(node, n, shared): the nodes whose shingles are shared with others often enough for a link, with both counts."""
    alone = _held(sets).where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    rows = sets.select("node", F.size("shingles").alias("n")).join(alone, "node", "left")
    return rows.select("node", "n", (F.col("n") - F.coalesce("alone", F.lit(0))).alias("shared")).where(F.col("shared") >= similarity * F.col("n") - SLACK)


def _ranked(rest: DataFrame, sets: DataFrame, similarity: float, rare: int) -> DataFrame:
    """(node, root, n, common, first) of the open nodes: how many of their shingles are common among the open nodes, and
    the rare ones that stand among the first of their order."""
    own = settle(sets.join(rest.select("node", "root").distinct(), "node").select("node", "root", "shingles"), "open-sets")
    held = settle(_held(own), "holders")
    alone = held.where("holders = 1").groupBy("node").agg(F.count("*").alias("alone"))
    few = held.where(F.col("holders").between(2, rare)).select("shingle", "holders")
    listed = own.select("node", F.explode("shingles").alias("shingle")).join(few, "shingle")
    listed = listed.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("holders", "shingle"))).alias("listed"))
    each = own.select("node", "root", F.size("shingles").alias("n")).join(alone, "node", "left").join(listed, "node", "left")
    alone_n, listed_n = F.coalesce("alone", F.lit(0)), F.coalesce(F.array_size("listed"), F.lit(0))
    first_n = F.greatest(F.col("n") - F.ceil(similarity * F.col("n") - SLACK) + 1 - alone_n, F.lit(0)).cast("int")
    found = each.select("node", "root", "n", (F.col("n") - alone_n - listed_n).alias("common"), F.slice("listed", 1, first_n)["shingle"].alias("first"))
    found = settle(found, "ranked")
    discard(own)
    discard(held)
    return found


def _across(rest: DataFrame, sets: DataFrame, similarity: float, rare: int) -> DataFrame:
    """The pairs (a, b, root_a, root_b) of nodes of two classes that may be similar."""
    ranked = _ranked(rest, sets, similarity, rare)
    one = ranked.select("node", "root", "n", F.explode("first").alias("shingle"))
    two = one.select("shingle", *(F.col(c).alias(f"{c}_a") for c in ("node", "root", "n")))
    sized = F.least("n", "n_a") >= similarity * F.greatest("n", "n_a") - SLACK
    by_rare = one.join(two, "shingle").where((F.col("node") < F.col("node_a")) & (F.col("root") != F.col("root_a")) & sized)
    other = ["node", "root", "n", "shared", "away"]
    rows = rest.drop("shared").join(ranked.select("node", F.col("common").alias("shared")), "node").where(F.col("shared") >= similarity * F.col("n") - SLACK)
    rows = settle(_open(rows), "buckets")
    sizes = rows.groupBy("bucket", "root").agg(F.count("*").alias("rows"))
    main = settle(sizes.groupBy("bucket").agg(F.max(F.struct("rows", "root"))["root"].alias("main")), "main-classes")
    marked = rows.join(main, "bucket")
    outer = marked.where("root != main").select("bucket", *(F.col(c).alias(f"{c}_a") for c in other))
    once = (F.col("root") == F.col("main")) | (F.col("node") < F.col("node_a"))
    by_bucket = marked.join(outer, "bucket").where((F.col("root") != F.col("root_a")) & once & _partners(similarity))
    pairs = [p.select(F.greatest("node", "node_a").alias("a"), F.least("node", "node_a").alias("b"), F.col("root").alias("r"), F.col("root_a").alias("s"), (F.col("node") > F.col("node_a")).alias("first")) for p in (by_rare, by_bucket)]
    both = pairs[0].union(pairs[1])
    return both.select("a", "b", F.when(F.col("first"), F.col("r")).otherwise(F.col("s")).alias("root_a"), F.when(F.col("first"), F.col("s")).otherwise(F.col("r")).alias("root_b")).distinct()


def _partners(similarity: float) -> Column:
    """Whether two nodes can be similar at all, by sizes, shared shingles and distances from the bucket's first leader."""
    least, most = F.least("n", "n_a"), F.greatest("n", "n_a")
    near = F.coalesce(F.abs(F.col("away") - F.col("away_a")) <= 1 - similarity + SLACK, F.lit(True))
    common = similarity / (1 + similarity) * (F.col("n") + F.col("n_a"))
    return near & (least >= similarity * most - SLACK) & (F.least("shared", "shared_a") >= common - SLACK)


def labels(nodes: DataFrame, identified: DataFrame, similarity: float = SIMILARITY, leaders: int = LEADERS, rare: int = RARE) -> DataFrame:
    """(node, root) of every node that shares a bucket; nodes: (node, doc_id, text_hash, bands)."""
    first = settle(_open(nodes.select(F.explode("bands").alias("bucket"), "node"), "node").withColumn("root", F.col("node")), "buckets")
    busy = nodes.join(first.select("node").distinct(), "node", "left_semi").select("node", "doc_id", "text_hash")
    texts = identified.join(busy, ["doc_id", "text_hash"]).select("node", "text").dropDuplicates(["node"])  # a row per node, however many copies
    sets = settle(texts.mapInArrow(_sets, "node bigint, shingles array<int>"), "sets")
    found = settle(busy.select("node", F.col("node").alias("root")), "labels")
    rest = settle(_open(first.join(_linkable(sets, similarity), "node").withColumn("away", F.lit(None).cast("double"))), "buckets")
    discard(first)
    other = ["node", "root", "n", "shared", "away"]
    for turn in range(leaders + 1):
        if rest.isEmpty():
            break
        if turn < leaders:
            own = (F.col("n") - F.col("shared")) / F.col("n") if turn == 0 else F.lit(0.0)
            lead = F.min(F.struct(own.alias("own"), F.xxhash64("node", F.lit(turn)).alias("rank"), *other)).alias("lead")
            outer = settle(rest.groupBy("bucket").agg(lead).select("bucket", *(F.col(f"lead.{c}").alias(f"{c}_a") for c in other)), "leaders")
            pairs = rest.join(outer, "bucket").where(F.col("root") != F.col("root_a")).where(_partners(similarity))
            pairs = pairs.select(F.col("node_a").alias("a"), F.col("node").alias("b"), "root_a", F.col("root").alias("root_b")).distinct()
        else:
            pairs = _across(rest, sets, similarity, rare)
        seen = settle(_similarities(pairs, sets), "similarities")
        if turn == 0 and leaders:
            away = F.when(F.col("node") == F.col("a"), 0.0).otherwise(1 - F.col("similarity"))
            known = rest.drop("away").join(outer.select("bucket", F.col("node_a").alias("a")), "bucket").join(seen.select("a", F.col("b").alias("node"), "similarity"), ["a", "node"], "left")
            placed = settle(known.withColumn("away", away).select(rest.columns), "buckets")
            discard(rest)
            rest = placed
        links = seen.where(F.col("similarity") >= similarity).select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
        if links.isEmpty():
            continue
        roots = components(links)
        grown = settle(_relabel(found, roots).select("node", "root"), "labels")
        discard(found)
        found = grown
        if turn < leaders:
            fewer = settle(_open(_relabel(rest, roots)), "buckets")
            discard(rest)
            rest = fewer
    discard(sets)
    return found


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge (a, b); root is the smallest node of its component."""
    edges = settle(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the least neighbours are written, so that the joins can split a node that very many are linked to
        least = settle(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = settle(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "stars")
        low = settle(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = settle(small.union(low.select("a", F.col("m").alias("b"))).where("a != b").distinct(), "edges")
        for done in (edges, least, large, low):
            discard(done)
        edges = new
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


class Classes(NamedTuple):
    """rows: (doc_id, row, words_key) of every row; of: words_key with its class, by the row that stands for it."""

    rows: DataFrame
    of: DataFrame


def classes(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, similarity: float = SIMILARITY, leaders: int = LEADERS, rare: int = RARE) -> Classes:
    """The near-duplicate classes of docs."""
    identified = _identified(docs)
    numbered = identified.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text_hash", "row", "text")
    signed = settle(numbered.mapInArrow(_signed(bands, rows), "doc_id bigint, text_hash bigint, row bigint, words_key string, bands array<bigint>"), "signed")
    least = F.min(F.struct("doc_id", "text_hash", "row")).alias("least")
    nodes = signed.groupBy("words_key").agg(least, F.first("bands").alias("bands"), F.count("*").alias("copies"))
    nodes = settle(nodes.select(F.monotonically_increasing_id().alias("node"), "words_key", "least.*", "copies", "bands"), "nodes")
    found = nodes.drop("bands").join(labels(nodes, identified, similarity, leaders, rare), "node", "left").withColumn("root", F.coalesce("root", "node"))
    found = settle(found, "labelled")
    rep = settle(found.groupBy("root").agg(least, F.sum("copies").alias("class_size")).select("root", F.col("least.doc_id").alias("rep_id"), F.col("least.text_hash").alias("rep_hash"), F.col("least.row").alias("rep_row"), "class_size"), "representatives")
    of = settle(found.select("root", "words_key").join(rep, "root").select("words_key", "rep_id", "rep_hash", "rep_row", "class_size"), "classes")
    for done in (nodes, found, rep):
        discard(done)
    return Classes(signed.select("doc_id", "row", "words_key"), of)


def resolve(docs: DataFrame) -> DataFrame:
    """A row per row of docs: doc_id, class_id (smallest doc_id of its class), class_size, kept."""
    found = classes(docs)
    real = lambda c, name: F.when(F.col(c) != NO_ID, F.col(c)).alias(name)
    return found.rows.join(found.of, "words_key").select(real("doc_id", "doc_id"), real("rep_id", "class_id"), "class_size", (F.col("row") == F.col("rep_row")).alias("kept"))


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each class; all columns as they were."""
    reps = classes(docs).of.select(F.col("rep_id").alias("id"), F.col("rep_hash").alias("text_hash")).distinct()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    marked = beside_row(docs, id=F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)), text_hash=F.xxhash64(text))
    return marked.join(reps, ["id", "text_hash"]).dropDuplicates(["id", "text_hash"]).select("row.*")
