"""Secret scan: fixed patterns, and a character convolutional network over every candidate in its context.

The patterns find assignments, access keys and long hexadecimal runs; their spans always stand. A candidate is every
other run of LEAST or more characters that secrets are written in. The network sees a view of fixed layout: characters in
front, the candidate, characters behind. Its first layer holds a weight for each filter, place of the filter and
character (which is a convolution of one-hot characters), the largest answers over the candidate and over its context go
through a hidden layer to one output. A candidate longer than a view is seen in several views, the largest answer counts.

Training labels are findings: what the patterns find is a secret; candidates of plain form (at most two changes
between letters and digits) are none; other candidates have no label. Findings are also shown with another value of
the same kinds (base64, hexadecimal, prefixed keys) and with the context of another candidate, so that neither one
alphabet nor the keyword decides. A third of the labelled views is held out: on them the answers are calibrated (Platt) and
the threshold is set to even odds, or lower as far as finding TARGET_RECALL of its findings asks for.

Texts are read once: a written table holds each row's spans and its candidates' views. Every distinct labelled view takes
part. They are dealt by hash into shards of about SHARD_VIEWS views, one row each. In each of ROUNDS rounds every shard
takes the network of the round before through Adam steps that show all of its views, and Spark sums the shards' networks,
weighted by their views, to the next one. A last pass counts the held-out answers by label, in steps of 1 / FINE; slope,
offset and threshold come from these counts.

Defined results: a null text counts as empty and has no spans; texts and candidates of any length are read whole; rows
that repeat get the same result each; without any finding in the table there is no network and only the patterns' spans
come out; where no finding is left to train on, none is held out; nothing depends on partitions, for shards are made by hash
and their sums are of whole numbers; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import copy
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

KINDS = ("assign", "access", "hex")
NETWORK = "network"
LEAST = 16
#: Characters of a view: in front of the candidate, of it, behind it.
BEFORE, INNER, AFTER = 24, 64, 8
VIEW = BEFORE + INNER + AFTER
WIDTH, FILTERS, HIDDEN = 5, 32, 16
TARGET_RECALL = 0.98
STEPS, BATCH, RATE = 400, 256, 0.004
#: About how many labelled views a shard holds, and how many shards a file holds at most.
SHARD_VIEWS, FILE_SHARDS = 4096, 32
#: Rounds of training, and a shard's steps in a round; more where that many don't show all of its views.
ROUNDS, ROUND_STEPS = 10, 40
#: Networks are summed as whole numbers, in units of 1 / UNIT; answers are counted in steps of 1 / FINE, up to FAR.
UNIT, FINE, FAR = 2**24, 1024, 64
#: Views scored at once: about 6 MB for each step of a filter.
SCORE_BATCH = 512

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_assign_hints = ("passw", "secret", "token", "api")
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"[0-9a-f]{32,}")  # runs are taken whole, so shorter ones drop out
#: Characters as numbers of the network: padding, the printable ones of ASCII, line ends and tabs, all others.
PAD, BREAK, OTHER = 0, 96, 97
SYMBOLS = 98
_symbol = np.array([BREAK if c in (9, 10, 13) else c - 31 if 32 <= c < 127 else OTHER for c in range(128)], np.uint8)
_allowed = np.array([chr(c) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-" for c in range(128)] + [False])


class Found(NamedTuple):
    """What a text holds: pattern spans (start, rank of kind, end), their values and the candidates, by code points."""

    spans: list[tuple[int, int, int]]
    values: list[tuple[int, int]]
    candidates: list[tuple[int, int]]
    symbols: np.ndarray


def _core(text: str, start: int, end: int) -> tuple[int, int]:
    """A run without what joins it to its surroundings: stops and dashes at its ends, a name and the sign = in front."""
    while start < end and text[start] in ".-=":
        start += 1
    while start < end and text[end - 1] in ".-":
        end -= 1
    named = text.find("=", start, end)
    if named >= 0 and len(text[named:end].strip("=")) >= LEAST:
        start = named + 1
        while text[start] == "=":
            start += 1
    return start, end


def find(text: str | None) -> Found:
    """Pattern spans and candidates of a whole text."""
    text = text or ""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ascii_ = np.minimum(chars, 128)
    inside = np.zeros(len(chars) + 2, np.int8)
    inside[1:-1] = _allowed[ascii_]
    edges = np.flatnonzero(np.diff(inside))
    long = edges[1::2] - edges[::2] >= LEAST
    runs = list(zip(edges[::2][long].tolist(), edges[1::2][long].tolist(), strict=True))
    spans, values = [], []
    low = text.lower()
    if any(h in low for h in _assign_hints):
        for m in _assign.finditer(text):
            if len(m[2]) >= 8:
                spans.append((m.start(), 0, m.end()))
                values.append(m.span(2))
    for start, end in runs:  # keys and hexadecimal runs lie in runs of these characters
        for kind, pattern in ((1, _access), (2, _hex)):
            for m in pattern.finditer(text, start, end):
                if m.end() - m.start() >= LEAST:
                    spans.append((m.start(), kind, m.end()))
                    values.append(m.span())
    spans.sort()
    cores = [_core(text, a, b) for a, b in runs]
    candidates = [(a, b) for a, b in cores if b - a >= LEAST and not _overlaps(spans, a, b)]
    symbols = np.append(_symbol, OTHER)[ascii_].astype(np.uint8)
    return Found(spans, sorted(set(values)), candidates, symbols)


def _overlaps(spans: list[tuple[int, int, int]], start: int, end: int) -> bool:
    return any(a < end and start < b for a, _, b in spans)


def views(symbols: np.ndarray, start: int, end: int) -> np.ndarray:
    """The views of a candidate, one after the other: VIEW symbols each."""
    out = []
    for at in range(start, max(end, start + 1), INNER):
        view = np.zeros(VIEW, np.uint8)
        front = symbols[max(0, at - BEFORE) : at]
        view[BEFORE - len(front) : BEFORE] = front
        stop = min(end, at + INNER)
        view[BEFORE : BEFORE + stop - at] = symbols[at:stop]
        behind = symbols[stop : stop + AFTER]
        view[BEFORE + INNER : BEFORE + INNER + len(behind)] = behind
        out.append(view)
    return np.concatenate(out)


def plain(value: np.ndarray) -> bool:
    """Whether a candidate's symbols have a form that secrets don't have: no more than two changes between letters and digits."""
    letters = (value >= 34) & (value <= 59) | (value >= 66) & (value <= 91)
    digits = (value >= 17) & (value <= 26)
    return int(np.count_nonzero(np.diff(digits[letters | digits].astype(np.int8)))) <= 2


SCHEMA = "doc_id bigint, spans array<struct<start: int, kind: int, end: int>>, starts array<int>, ends array<int>, views binary, findings array<binary>, others array<binary>"


def scan_table(docs: DataFrame) -> DataFrame:
    """Spans, candidates with their views, and views with a label, of every row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for text in batch.column(1):
                    f = find(text.as_py())
                    seen = [views(f.symbols, a, b).tobytes() for a, b in f.candidates]
                    rows.append({
                        "spans": [{"start": a, "kind": k, "end": b} for a, k, b in f.spans],
                        "starts": [a for a, _ in f.candidates],
                        "ends": [b for _, b in f.candidates],
                        "views": b"".join(seen),
                        "findings": [views(f.symbols, a, b)[:VIEW].tobytes() for a, b in f.values],
                        "others": [v[:VIEW] for (a, b), v in zip(f.candidates, seen, strict=True) if plain(f.symbols[a:b])],
                    })
                made = pa.array(rows, _arrow)
                yield pa.RecordBatch.from_arrays([batch.column(0), *made.flatten()], ["doc_id", *(f.name for f in _arrow)])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(work, SCHEMA)


_span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_arrow = pa.struct([("spans", pa.list_(_span)), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32())), ("views", pa.binary()), ("findings", pa.list_(pa.binary())), ("others", pa.list_(pa.binary()))])


class Network:
    """One convolution over characters, largest answers over candidate and context, a hidden layer, one output."""

    #: Filters that start here lie (but for two characters) on the candidate; all others on its context.
    FIRST, LAST = BEFORE - 2, BEFORE + INNER - WIDTH + 1

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.filters = rng.normal(0, 0.3, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.filters[:, PAD] = 0
        self.bias = np.zeros(FILTERS, np.float32)
        self.hidden = rng.normal(0, (1 / FILTERS) ** 0.5, (2 * FILTERS, HIDDEN)).astype(np.float32)
        self.hidden_bias = np.zeros(HIDDEN, np.float32)
        self.out = rng.normal(0, (1 / HIDDEN) ** 0.5, HIDDEN).astype(np.float32)
        self.out_bias = np.zeros(1, np.float32)
        self.slope, self.offset, self.threshold = 1.0, 0.0, 0.5

    def parameters(self) -> list[np.ndarray]:
        return [self.filters, self.bias, self.hidden, self.hidden_bias, self.out, self.out_bias]

    def _pooled(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The largest answers (candidate, then context) and where they were given."""
        n = VIEW - WIDTH + 1
        f = self.filters[0][x[:, :n]]
        for k in range(1, WIDTH):
            f += self.filters[k][x[:, k : k + n]]
        inner, a = f[:, self.FIRST : self.LAST], self.FIRST
        outer = np.concatenate([f[:, : self.FIRST], f[:, self.LAST :]], axis=1)
        where = np.stack([inner.argmax(axis=1) + a, outer.argmax(axis=1)], axis=1)
        where[:, 1] += (where[:, 1] >= self.FIRST) * (self.LAST - self.FIRST)
        best = np.take_along_axis(f, where, axis=1)
        return np.maximum(best + self.bias, 0).reshape(len(x), -1), where

    def logits(self, x: np.ndarray) -> np.ndarray:
        """The output for each view before calibration."""
        out = [np.empty(0, np.float32)]
        for at in range(0, len(x), SCORE_BATCH):
            h = np.maximum(self._pooled(x[at : at + SCORE_BATCH])[0] @ self.hidden + self.hidden_bias, 0)
            out.append(h @ self.out + self.out_bias[0])
        return np.concatenate(out).astype(float)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(x) + self.offset, -40, 40)))

    def gradients(self, x: np.ndarray, y: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, in the order of parameters()."""
        pooled, where = self._pooled(x)
        before = pooled @ self.hidden + self.hidden_bias
        h = np.maximum(before, 0)
        p = 1 / (1 + np.exp(-np.clip(h @ self.out + self.out_bias[0], -40, 40)))
        e = ((p - y) / len(x)).astype(np.float32)
        d_h = e[:, None] * self.out * (before > 0)
        d_pooled = (d_h @ self.hidden.T) * (pooled > 0)
        d_pooled = d_pooled.reshape(len(x), 2, FILTERS)
        d_filters = np.zeros_like(self.filters)
        rows = np.arange(len(x))[:, None, None]
        for k in range(WIDTH):
            np.add.at(d_filters[k], (x[rows, where + k], np.arange(FILTERS)), d_pooled)
        d_filters[:, PAD] = 0
        return [d_filters, d_pooled.sum(axis=(0, 1)), pooled.T @ d_h, d_h.sum(axis=0), h.T @ e, e.sum(keepdims=True)]


def _descend(net: Network, x: np.ndarray, y: np.ndarray, batches: Iterable[np.ndarray]) -> Network:
    """The network after an Adam step for each batch of rows; it is changed in place."""
    held = net.parameters()
    first, second = [np.zeros_like(p) for p in held], [np.zeros_like(p) for p in held]
    for step, chosen in enumerate(batches, 1):
        for p, m, v, g in zip(held, first, second, net.gradients(x[chosen], y[chosen]), strict=True):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def fit(x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
    """A network by Adam over drawn batches."""
    rng = np.random.default_rng(seed)
    return _descend(Network(seed), x, y, (rng.integers(0, len(x), BATCH) for _ in range(steps)))


def calibrate(net: Network, x: np.ndarray, y: np.ndarray, recall: float = TARGET_RECALL) -> Network:
    """Platt's slope and offset on held-out views; the threshold is even odds, or lower where the recall asked for needs it."""
    return _calibrated(net, net.logits(x), y, np.ones(len(y)), recall)


def _calibrated(net: Network, f: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float = TARGET_RECALL) -> Network:
    """The same from outputs f of label y that occur n times."""
    good, bad = n[y == 1].sum(), n[y != 1].sum()
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps of a two-parameter logistic regression, slightly pulled to slope one
        p = 1 / (1 + np.exp(-np.clip(a * f + b, -40, 40)))
        w = n * (p * (1 - p) + 1e-9)
        off = n * (p - target)
        grad = np.array([(off * f).sum() + 1e-2 * (a - 1), off.sum()])
        hess = np.array([[(w * f * f).sum() + 1e-2, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -5, 5)
    net.slope, net.offset = max(float(a), 1e-3), float(b)
    order = np.argsort(f[y == 1], kind="stable")
    upto = np.cumsum(n[y == 1][order])
    net.threshold = 0.5
    if good:
        least = f[y == 1][order][np.searchsorted(upto, int(np.floor((1 - recall) * good)), "right")]
        net.threshold = min(0.5, float(1 / (1 + np.exp(-np.clip(net.slope * least + net.offset, -40, 40)))))
    return net


_ALPHABETS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_PREFIXES = ("", "", "", "ghp_", "sk-", "AKIA", "xoxb-")


def varied(findings: np.ndarray, others: np.ndarray, seed: int | list[int] = 11) -> np.ndarray:
    """The findings, the same with other values, and with the contexts of other candidates."""
    rng = np.random.default_rng(seed)
    new = findings.copy()
    for view in new:
        letters = _ALPHABETS[rng.integers(len(_ALPHABETS))]
        value = _PREFIXES[rng.integers(len(_PREFIXES))] + "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(LEAST, INNER - 5)))
        view[BEFORE : BEFORE + INNER] = 0
        view[BEFORE : BEFORE + len(value)] = _symbol[np.frombuffer(value.encode(), np.uint8)]
    moved = np.concatenate([findings, new])
    if len(others):
        lent = others[rng.integers(0, len(others), len(moved))]
        moved[:, :BEFORE], moved[:, BEFORE + INNER :] = lent[:, :BEFORE], lent[:, BEFORE + INNER :]
    return np.concatenate([findings, new, moved])


SHARD = ("findings", "others", "held_findings", "held_others")


def shards(scanned: DataFrame) -> DataFrame | None:
    """(shard, findings, others, held_findings, held_others): every distinct labelled view once; None without a finding."""
    label = lambda column, good: scanned.select(F.explode(column).alias("view"), F.lit(good).alias("good"))
    seen = settle(label("findings", True).union(label("others", False)).distinct(), "secret-views")
    held = F.pmod(F.xxhash64("view", F.lit("held")), F.lit(3)) == 2
    n = seen.agg(F.count("*").alias("views"), F.count_if("good").alias("findings"), F.count_if(F.col("good") & ~held).alias("left")).first()
    if not n["findings"]:
        return None
    held = held if n["left"] else F.lit(False)
    many = -(-n["views"] // SHARD_VIEWS)
    files = max(min(many, 3 * seen.sparkSession.sparkContext.defaultParallelism), -(-many // FILE_SHARDS))
    dealt = seen.withColumn("shard", F.pmod(F.xxhash64("view"), F.lit(many)).cast("int")).repartition(files, "shard")
    good = F.col("good")
    parts = zip(SHARD, (good & ~held, ~good & ~held, good & held, ~good & held), strict=True)
    lists = [F.sort_array(F.collect_list(F.when(of, F.col("view")))).alias(name) for name, of in parts]
    return settle(dealt.groupBy("shard").agg(*lists), "secret-shards")


def _shown(batch: pa.RecordBatch, row: int, held: bool, turn: int) -> tuple[np.ndarray, np.ndarray]:
    """What a shard shows in a turn, training or held-out views, with labels."""
    good, bad = (np.frombuffer(b"".join(batch.column(f"held_{c}" if held else c)[row].as_py()), np.uint8).reshape(-1, VIEW) for c in SHARD[:2])
    good = varied(good, bad, [11, turn, batch.column("shard")[row].as_py()])
    return np.concatenate([good, bad]), np.concatenate([np.ones(len(good)), np.zeros(len(bad))])


def _next(dealt: DataFrame, net: Network, turn: int) -> Network:
    """The mean of the networks that the shards make of net, by numbers of views."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 + sum(p.size for p in net.parameters()), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = _shown(batch, row, False, turn)
                if not len(x):
                    continue
                order = np.random.default_rng([turn, batch.column("shard")[row].as_py()]).permutation(len(x))
                steps = max(ROUND_STEPS, -(-len(x) // BATCH))
                own = _descend(copy.deepcopy(net), x, y, (order[np.arange(k * BATCH, (k + 1) * BATCH) % len(x)] for k in range(steps)))
                flat = np.concatenate([p.ravel() for p in own.parameters()]).astype(float)
                total[0] += len(x)
                total[1:] += np.rint(np.clip(flat, -16, 16) * UNIT).astype(np.int64) * len(x)
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total)), pa.int32()), pa.array(total)], ["place", "value"])

    sums = dealt.mapInArrow(work, "place int, value bigint").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
    sums = sums.sort_values("place")["value"].to_numpy(np.int64)
    mean, made, at = sums[1:] / (float(sums[0]) * UNIT), copy.deepcopy(net), 0
    for p in made.parameters():
        p[...] = mean[at : at + p.size].reshape(p.shape)
        at += p.size
    return made


def _answers(dealt: DataFrame, net: Network, held: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Outputs, rounded down to steps, labels and how often they occur over all held-out (or all training) views."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                x, y = _shown(batch, row, held, ROUNDS)
                steps = np.floor(np.clip(net.logits(x), -FAR, FAR) * FINE).astype(np.int64)
                keys, n = np.unique(np.stack([y.astype(np.int64), steps]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (*keys, n)], ["label", "step", "n"])

    made = dealt.mapInArrow(work, "label bigint, step bigint, n bigint").groupBy("label", "step").agg(F.sum("n").alias("n"))
    made = made.toPandas().sort_values(["label", "step"])  # at most 2 * (2 * FAR * FINE + 1) rows
    return made["step"].to_numpy(float) / FINE, made["label"].to_numpy(float), made["n"].to_numpy(float)


def train(scanned: DataFrame) -> Network | None:
    """The calibrated network of all labelled views, or None where no row has a finding. Views that repeat count once."""
    dealt = shards(scanned)
    if dealt is None:
        return None
    net = Network()
    for turn in range(ROUNDS):
        net = _next(dealt, net, turn)
    f, y, n = _answers(dealt, net, True)
    return _calibrated(net, *((f, y, n) if (y == 1).any() else _answers(dealt, net, False)))


RESULT = "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_network bigint, base string, spans string"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans and n_network of every row."""
    scanned = settle(scan_table(docs), "secret-candidates", compression="zstd")
    net = docs.sparkSession.sparkContext.broadcast(train(scanned))
    names = (*KINDS, NETWORK)

    def shown(spans: list[tuple[int, int, int]]) -> str:
        return ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000).to_pylist()
                x = np.frombuffer(b"".join(r["views"] for r in batch), np.uint8).reshape(-1, VIEW)
                p = net.value.probabilities(x) if net.value is not None else np.zeros(len(x))
                least = net.value.threshold if net.value is not None else 2.0
                out, k = [], 0
                for r in batch:
                    base = [(s["start"], s["kind"], s["end"]) for s in r["spans"]]
                    more = []
                    for a, b in zip(r["starts"], r["ends"], strict=True):
                        n = -(-(b - a) // INNER)
                        if p[k : k + n].max() >= least:
                            more.append((a, len(KINDS), b))
                        k += n
                    kinds = [sum(s[1] == i for s in base) for i in range(len(KINDS))]
                    out.append((r["doc_id"], *kinds, len(more), shown(base), shown(base + more)))
                types = [pa.int64()] * 5 + [pa.string()] * 2
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "n_assign", "n_access", "n_hex", "n_network", "base", "spans"])

    found = scanned.select("doc_id", "spans", "starts", "ends", "views").mapInArrow(work, RESULT)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "n_network")
