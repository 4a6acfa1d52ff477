"""Each operator against a brute-force version, an exact round trip or held-out accuracy."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from inkstone.llm import bpe, exact_dedup, html_main_text, language_crf, license_scan, near_dedup, packing, quality_gam, quality_rules, queries, textstats, toxicity_chain

PATH = public_tokenizers.path("byte_bpe_50k.json")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def docs(sf_dir):
    return duckdb.sql(f"SELECT * FROM '{sf_dir}/documents.parquet'").df()


@pytest.fixture(scope="session")
def labelled(docs, sf_dir):
    return docs.merge(duckdb.sql(f"SELECT * FROM '{sf_dir}/labels.parquet'").df(), on="doc_id")


@pytest.fixture(scope="session")
def reference():
    return Tokenizer.from_file(PATH)


def ids_of(reference, text):
    return reference.encode(text or "", add_special_tokens=False).ids


# 1 packing


def test_packing_query(spark, sf_dir, docs, reference):
    got = queries.op1_best_fit_packing(spark, sf_dir).toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert fill.max() <= 2048
    assert len(fill) <= -(-int(got["length"].sum()) // 2048) + 2
    for _, bin_ in got.sort_values("offset").groupby("sequence_id"):
        assert (bin_["offset"].to_numpy() == np.cumsum(bin_["length"]) - bin_["length"]).all()
    pieces = {k: g.sort_values("piece") for k, g in got.groupby("doc_id")}
    assert set(pieces) == set(docs["doc_id"])
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = np.array([*ids_of(reference, text), 0], "<u4")
        g = pieces[doc_id]
        assert list(g["piece"]) == list(range(len(g))) and g["length"].sum() == len(ids)
        assert len(g) == -(-len(ids) // 2048) and (g["length"].iloc[1:] == 2048).all()
        for start, length, crc in zip(g["start"], g["length"], g["ids_crc32"], strict=True):
            assert crc == zlib.crc32(ids[start : start + length].tobytes())


@given(st.lists(st.integers(1, 100), min_size=1, max_size=120))
@settings(max_examples=60, deadline=None)
def test_local_search_never_loses_a_piece_or_adds_a_bin(lengths):
    lengths = np.array(lengths)
    first = packing.best_fit(lengths, 100)
    after = packing.improve(lengths, first, 100)
    assert len(np.unique(after)) <= len(np.unique(first))
    assert np.bincount(after, weights=lengths).max() <= 100
    assert (np.bincount(after, weights=lengths) ** 2).sum() >= (np.bincount(first, weights=lengths) ** 2).sum()


def test_local_search_empties_a_bin():
    lengths = np.array([6, 5, 5, 4])
    assert len(np.unique(packing.improve(lengths, np.array([0, 1, 2, 2]), 10))) == 2


def test_packing_over_several_levels(spark):
    rows = spark.createDataFrame([(i, "word " * (5 + 37 * i % 400)) for i in range(300)], "doc_id long, text string")
    got = packing.pack(rows, PATH, 512, 0, group_pieces=40).toPandas()
    assert got.duplicated(["doc_id", "piece"]).sum() == 0 and got["doc_id"].nunique() == 300
    assert got.groupby("sequence_id")["length"].sum().max() <= 512
    alone = packing.best_fit(got["length"].to_numpy(), 512).max() + 1
    assert got["sequence_id"].nunique() <= 1.06 * alone  # groups of forty pieces can't reach what one group does


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=2, max_size=24), st.integers(40, 60))
def test_the_search_ends_only_where_no_step_helps(sizes, capacity):
    lengths = np.array(sizes)
    bins = packing.improve(lengths, packing.best_fit(lengths, capacity), capacity)
    fill = np.bincount(bins, weights=lengths).astype(int)
    assert fill.max() <= capacity and fill.sum() == lengths.sum()
    open_bins = [b for b in range(len(fill)) if 0 < fill[b] < capacity]
    for source in sorted(open_bins, key=lambda b: fill[b])[:1]:
        mine = np.flatnonzero(bins == source)
        gives = [(i,) for i in mine] + [(i, j) for i in mine for j in mine if i < j]
        for t in open_bins:
            if t == source or fill[t] < fill[source]:
                continue
            theirs = np.flatnonzero(bins == t)
            takes = [()] + [(i,) for i in theirs] + [(i, j) for i in theirs for j in theirs if i < j]
            for give in gives:
                for take in takes:
                    if len(give) + len(take) > 3 or (len(give) == 2 and not take):
                        continue
                    gain = lengths[list(give)].sum() - (lengths[list(take)].sum() if take else 0)
                    assert not 0 < gain <= capacity - fill[t]


def test_rows_without_doc_id_are_dealt_evenly(spark):
    rows = spark.createDataFrame([(None, "word " * (5 + 37 * i % 90)) for i in range(3000)], "doc_id long, text string").repartition(4)
    numbered = packing.pieces(rows, PATH, 512, 0).withColumn("row", F.monotonically_increasing_id())
    groups = numbered.groupBy(F.pmod(F.xxhash64("row", F.lit(0)), F.lit(10)).alias("grp")).count().collect()
    assert len(groups) == 10 and max(r["count"] for r in groups) < 400
    got = packing.pack(rows, PATH, 512, 0, group_pieces=300).toPandas()
    fill = got.groupby("sequence_id")["length"].sum()
    assert len(got) == 3000 and fill.max() <= 512 and len(fill) <= 1.02 * got["length"].sum() / 512 + 1


# 2 BPE


@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_bpe_equals_the_library(reference, texts):
    codec = bpe.codec(PATH)
    for text, ids in zip(texts, codec.encode_all(texts), strict=True):
        assert ids == ids_of(reference, text)
        assert codec.decode(ids) == reference.decode(ids, skip_special_tokens=False) == text


@pytest.mark.parametrize("text", ["<|endoftext|>", "a<|endoftext|> b", "don't I'LL we've", "x" * 3000, " \n\n a  \t b \r\n", "\x1c\x1d a\x85b c²³½", "日本語 テスト é́ 😀" * 9, "aaaa" * 50, "\x00\x0b\x0c"])
def test_bpe_on_hard_texts(reference, text):
    codec = bpe.codec(PATH)
    (ids,) = codec.encode_all([text])
    assert ids == ids_of(reference, text) == packing.encoder(PATH)(text)
    assert codec.decode(ids) == text


def test_bpe_query(spark, sf_dir, docs, reference):
    got = {r.doc_id: r for r in queries.op2_bpe_round_trip(spark, sf_dir).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        ids = ids_of(reference, text)
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()


def test_bpe_frames_round_trip(spark):
    rows = spark.createDataFrame([(1, "ab cd"), (2, None)], "doc_id long, text string")
    back = bpe.decode(bpe.encode(rows, PATH), PATH)
    assert sorted((r.doc_id, r.text) for r in back.collect()) == [(1, "ab cd"), (2, "")]


# 3 toxicity


def test_toxicity_catches_planted_documents_and_leaves_clean_ones(spark, labelled, docs):
    words = "idiot moron loser clown scum fool jerk stupid dumb pathetic worthless disgusting trash".split()
    rng = np.random.default_rng(3)
    clean = [f"the {' '.join(rng.choice(['tree', 'river', 'stone', 'house', 'light', 'road'], 40))}" for _ in range(400)]
    toxic = [f"{c} you {rng.choice(words)} and {rng.choice(words)} so {rng.choice(words)}" for c in clean[:120]]
    rows = [(i, t) for i, t in enumerate([*clean, *toxic])]
    labels = [(i, int(i >= 400), 1) for i, _ in rows]
    got = toxicity_chain.classify(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int, quality int"))
    held = [(r.doc_id >= 400, r.predicted) for r in got.collect() if r.held_out]
    assert held and all(bool(p) == t for t, p in held)


def test_chain_feeds_earlier_probabilities_to_later_links():
    rng = np.random.default_rng(0)
    n = 600
    first = rng.random(n) < 0.4
    docs = [np.array(sorted({*rng.integers(100, 200, 5).tolist(), *([7] if f else [])})) for f in first]
    labels = {c: first if c in ("kind_3", toxicity_chain.OVERALL) else np.zeros(n, bool) for c in toxicity_chain.CHAIN}
    chain = toxicity_chain.fit_chain(docs, labels)
    assert [link.feeds for link in chain] == [False, False, True, False, True]  # categories that no row shows feed nothing
    assert [len(link.dense) for link in chain] == [0, 0, 0, 1, 1]
    assert 7 in chain[2].words and chain[-1].dense[0] > 0


def test_categories_are_clusters_of_toxic_rows():
    rng = np.random.default_rng(1)
    vocabulary = [range(10, 20), range(20, 28), range(30, 36), range(40, 45)]
    kind = rng.choice([-1, 0, 1, 2, 3], 1500, p=[0.6, 0.16, 0.12, 0.08, 0.04])
    docs = [np.array(sorted({*rng.integers(100, 180, 8).tolist(), *(rng.choice(vocabulary[k], 3).tolist() if k >= 0 else [])})) for k in kind]
    toxic = kind >= 0
    toxic[:30] |= kind[:30] < 0  # toxic rows without a telling word
    got = toxicity_chain.kinds_of(docs, toxic)
    assert (got == kind).mean() > 0.99
    assert (toxicity_chain.kinds_of(docs, np.zeros(1500, bool)) == -1).all() and (toxicity_chain.kinds_of([], np.zeros(0, bool)) == -1).all()


def test_every_link_is_trained_on_small_tables(spark):
    for sf in ("sf0.01", "sf0.1"):
        chain = toxicity_chain.train(*(spark.read.parquet(f"/root/testdata/{sf}/{t}.parquet") for t in ("documents", "labels")))
        assert all(link.feeds and link.words for link in chain) and (chain[-1].dense > 0).any()


def plain_logistic(x, y, extra, l2):
    """Ridge logistic regression by Newton's steps; the intercept isn't pulled."""
    z = np.column_stack([x, extra, np.ones(len(y))])
    theta = np.zeros(z.shape[1])
    pull = np.append(np.full(z.shape[1] - 1, l2), 0.0)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ theta, -40, 40)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pull + 1e-9)
        theta -= np.linalg.solve(h, z.T @ (p - y) + pull * theta)
    return theta


def test_training_equals_a_plain_chain():
    """Words, folds, out-of-fold inputs and links, by another solver."""
    rng = np.random.default_rng(2)
    n = 900
    kind = rng.choice([-1, 0, 1], n, p=[0.6, 0.25, 0.15])
    docs = [np.array(sorted({*rng.integers(100, 130, 6).tolist(), *(rng.choice(range(10 * k + 10, 10 * k + 14), 2).tolist() if k >= 0 else [])})) for k in kind]
    toxic = (kind >= 0) ^ (rng.random(n) < 0.05)
    labels = {c: kind == k for k, c in enumerate(toxicity_chain.CATEGORIES)} | {toxicity_chain.OVERALL: toxic}
    chain = toxicity_chain.fit_chain(docs, labels)
    x = np.zeros((n, 130))
    for r, d in enumerate(docs):
        x[r, d] = 1

    def chosen(rows, y):
        odds = lambda w: (x[rows, w][y == 1].sum(), x[rows, w][y == 0].sum())
        out = []
        for w in range(130):
            (a, b), n1, n0 = odds(w), y.sum(), len(y) - y.sum()
            z = (np.log((a + 0.5) / (n1 - a + 0.5)) - np.log((b + 0.5) / (n0 - b + 0.5))) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
            out += [w] if a + b >= 5 and abs(z) >= 4 else []
        return out

    extra, fold = np.empty((n, 0)), np.arange(n) % toxicity_chain.FOLDS
    for name, link in zip(toxicity_chain.CHAIN, chain, strict=True):
        y = labels[name].astype(float)
        if y.max() == 0:
            assert not link.feeds
            continue
        l2 = toxicity_chain.OVERALL_L2 if name == toxicity_chain.OVERALL else toxicity_chain.CATEGORY_L2
        words = chosen(np.arange(n), y)
        theta = plain_logistic(x[:, words], y, extra, l2)
        assert sorted(link.words) == words
        f = x[:, words] @ theta[: len(words)] + extra @ theta[len(words) : -1] + theta[-1]
        g = x[:, words] @ [link.words[w] for w in words] + extra @ link.dense + link.intercept
        loss = lambda f, held: np.logaddexp(0, -f * (2 * y - 1)).sum() + l2 / 2 * (np.asarray(held) ** 2).sum()  # noqa: B023, E731
        assert loss(g, [*link.words.values(), *link.dense]) <= loss(f, theta[:-1]) * 1.02 + 0.1
        assert np.abs(1 / (1 + np.exp(-f)) - 1 / (1 + np.exp(-g))).mean() < 0.01
        unseen = np.empty(n)
        for k in range(toxicity_chain.FOLDS):
            learn, hold = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
            some = chosen(learn, y[learn])
            t = plain_logistic(x[np.ix_(learn, some)], y[learn], extra[learn], l2)
            unseen[hold] = x[np.ix_(hold, some)] @ t[: len(some)] + extra[hold] @ t[len(some) : -1] + t[-1]
        p = np.clip(1 / (1 + np.exp(-unseen)), 1e-4, 1 - 1e-4)
        extra = np.column_stack([extra, np.log(p / (1 - p))])


def test_toxicity_query_equals_a_plain_chain(spark, sf_dir, docs):
    chain = toxicity_chain.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = {r.doc_id: r for r in queries.op3_toxicity_chain(spark, sf_dir).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        words = {toxicity_chain.bucket(w) for w in re.findall(r"\w+", (text or "").lower())}
        logits = []
        for name, link in zip([f"p_{c}" for c in toxicity_chain.CATEGORIES] + ["score"], chain, strict=True):
            f = link.intercept + sum(link.words.get(w, 0.0) for w in words) + sum(a * b for a, b in zip(link.dense, logits, strict=True))
            p = 1 / (1 + np.exp(-np.clip(f, -40, 40)))
            assert got[doc_id][name] == pytest.approx(p, abs=1e-9)
            q = min(max(p, 1e-4), 1 - 1e-4)
            logits += [np.log(q / (1 - q))] if link.feeds else []
        assert got[doc_id].predicted == int(got[doc_id].score >= 0.3)


def test_toxicity_learns_words_beyond_ten_thousand_rows(spark):
    own = spark.range(15_500).toDF("doc_id").where(~toxicity_chain.held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = [r.doc_id for r in own.collect()]
    late = set(ids[10_000:])
    assert len(late) > 1_000
    rows = [(i, "plain words zorble" if i in late else "plain words", int(i in late)) for i in ids]
    frame = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    chain = toxicity_chain.train(frame.drop("toxic"), frame.drop("text"))
    assert toxicity_chain.bucket("zorble") in chain[-1].words


# 4 near duplicates


def brute_classes(texts):
    """Connected components of Jaccard >= 0.8 over five-word shingles, copies of the same words together."""
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"\w+", (t or "").lower())
        sets[i] = frozenset(zip(*(w[k:] for k in range(5)), strict=False)) or frozenset([tuple(w)])
    root = {i: i for i in texts}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    for a, b in {(a, b) for h in holders.values() for a in h for b in h if a < b}:
        both = len(sets[a] & sets[b])
        if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in texts}


def test_near_dedup_equals_brute_force(spark, sf_dir, docs):
    got = queries.op4_near_dedup(spark, sf_dir).toPandas()
    want = brute_classes(dict(zip(docs["doc_id"], docs["text"], strict=True)))
    assert dict(zip(got["doc_id"], got["class_id"], strict=True)) == want
    assert (got["kept"] == (got["doc_id"] == got["class_id"])).all()
    assert dict(zip(got["doc_id"], got["class_size"], strict=True)) == {i: Counter(want.values())[c] for i, c in want.items()}


def test_near_dedup_of_a_large_family(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    texts = {}
    for i in range(150):
        w = list(base)
        for _ in range(rng.integers(0, 9)):
            w[rng.integers(0, 200)] = f"x{rng.integers(10**6)}"
        texts[i] = " ".join(w)
    for i in range(150, 200):
        texts[i] = " ".join(base[:60] + [f"y{rng.integers(10**6)}" for _ in range(60)])
    got = near_dedup.resolve(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    assert dict(zip(got["doc_id"], got["class_id"], strict=True)) == brute_classes(texts)


def test_bounds_let_pairs_of_exactly_four_fifths_pass(spark):
    sizes = [(4 * m, 5 * m, 4 * m, s, None, None) for m in range(1, 400) for s in (4 * m, 5 * m)]
    sizes += [(9 * m, 9 * m, 8 * m, 8 * m, None, None) for m in range(1, 200)]
    pairs = spark.createDataFrame(sizes, "n long, n_a long, shared long, shared_a long, away double, away_a double")
    assert pairs.where(near_dedup._partners(0.8)).count() == len(sizes)


@pytest.mark.parametrize(("leaders", "rare"), [(0, 1), (1, 32)])
def test_near_dedup_of_edits_that_mostly_are_not_linked(spark, leaders, rare):
    """The last comparison finds every link, whether rare shingles or common ones show it."""
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in rng.integers(0, 500, 140)]
    texts = {}
    for i in range(160):
        words = list(base)
        for at in rng.choice(140, rng.integers(1, 9), replace=False):
            words[at] = f"x{rng.integers(0, 6)}" if i % 2 else f"y{rng.integers(0, 10_000)}"
        texts[i] = " ".join(words)
    sets = {i: set(zip(*(t.split()[k:] for k in range(5)), strict=False)) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in texts:
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = near_dedup.classes(frame, leaders=leaders, rare=rare)
    got = {r.doc_id: r.rep_id for r in found.rows.join(found.of, "words_key").collect()}
    assert got == {i: find(i) for i in texts} and 10 < len(set(got.values())) < 160


def test_near_dedup_of_a_hundred_thousand_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    near = spark.createDataFrame([(7, text + " w60 w61"), (8, "something else is said in this text")], "doc_id long, text string")
    got = near_dedup.resolve(rows.union(near).repartition(8)).groupBy("class_id", "class_size", "kept").count().collect()
    assert sorted((r.class_size, r.kept, r["count"]) for r in got) == [(1, True, 1), (100_001, False, 100_000), (100_001, True, 1)]


def test_near_dedup_links_appended_texts_of_exactly_four_fifths(spark):
    texts = {}
    for m in (7, 13, 14, 15, 26, 28, 30):
        words = [f"w{m}x{i}" for i in range(5 * m + 4)]
        texts |= {2 * m: " ".join(words[: 4 * m + 4]), 2 * m + 1: " ".join(words)}
    got = near_dedup.resolve(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    assert dict(zip(got["doc_id"], got["class_id"], strict=True)) == {i: i // 2 * 2 for i in texts}


def test_near_dedup_links_texts_that_differ_in_repetition(spark):
    texts = {}
    for m in range(80):
        once, rest, tail = ([f"{c}{m}x{i}" for i in range(n)] for c, n in (("p", 44), ("q", 44), ("t", 17)))
        texts |= {2 * m: " ".join(once * 10 + rest), 2 * m + 1: " ".join(once + rest + tail)}
    want = brute_classes(texts)
    assert set(want.values()) == set(range(0, 160, 2))
    got = near_dedup.resolve(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).toPandas()
    assert dict(zip(got["doc_id"], got["class_id"], strict=True)) == want


def test_prob_minhash_estimates_probability_jaccard():
    rng = np.random.default_rng(1)
    a, b = (dict(zip(range(k, k + 60), rng.integers(1, 5, 60).tolist(), strict=True)) for k in (0, 20))
    exact = sum(1 / sum(max(a.get(y, 0) / a[x], b.get(y, 0) / b[x]) for y in {*a, *b}) for x in {*a} & {*b})
    e = near_dedup.mix(np.array([*a, *b], np.uint64) + np.uint64(99))
    sig = near_dedup.prob_minhash(e, np.array([*a.values(), *b.values()], float), np.repeat([0, 1], 60), 2, 4000)
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.04


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 100), (7, 7)]
    got = {r.node: r.root for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# 5 licenses


def test_license_query_base_figures(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, sf_dir).collect()}
    phrases = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
        places = [(i, label) for p, label in phrases for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        starts = [i for i, _ in places]
        r = got[doc_id]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(starts), min(starts, default=None), max(starts, default=None))
        assert r.base_labels == ",".join(sorted({x for _, x in places})) and set(r.base_labels.split(",")) - {""} <= set(r.labels.split(","))
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(r.labels)


@pytest.mark.parametrize(
    ("text", "labels"),
    [
        ("Licensed under the Apache License, Version 2.0.", {"apache-2.0"}),
        ("GNU Lesser General Public License v2.1 or later", {"lgpl-2.1-or-later", "gpl"}),
        ("CC BY-NC-SA 4.0", {"cc-by-nc-sa-4.0", "cc-by"}),
        ("SPDX-License-Identifier: MIT", {"mit"}),
        ("nothing here", set()),
        ("All rights reserved", {"reserved"}),
    ],
)
def test_license_labels_and_suppression(spark, text, labels):
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert set(row.labels.split(",")) - {""} == labels


def test_license_detections_equal_brute_force(spark):
    text = "The MIT License and the MIT license, GPL v3, licensed under the terms of the GNU General Public License version 3 or later; public domain; CC BY 4.0 cc by cc by-sa"
    row = license_scan.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    padded = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
    found = {(r.label, r.priority, padded[: m.start()].count(" "), padded[: m.start()].count(" ") + m[0].count(" ")) for r in license_scan.rules() for m in re.finditer(f" {r.pattern}(?= )", padded)}
    want = {d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2])) for e in found)}
    assert {(d.label, d.priority, d.start, d.stop) for d in row.detections} == want
    assert len(license_scan.rules()) >= 300


def sample(tree, pick):
    """A text that a parsed pattern matches: repeats as often and branches as far down the list as pick(least, most) says."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            first = arg[pick(0, len(arg) - 1)]
            out += chr(first[1]) if str(first[0]) == "LITERAL" else {"CATEGORY_DIGIT": "7", "CATEGORY_WORD": "u"}.get(str(first[1]), "q")
        elif name == "BRANCH":
            out += sample(arg[1][pick(0, len(arg[1]) - 1)], pick)
        elif name == "SUBPATTERN":
            out += sample(arg[3], pick)
        else:
            assert name in ("MAX_REPEAT", "MIN_REPEAT"), name
            out += "".join(sample(arg[2], pick) for _ in range(pick(arg[0], min(arg[1], 3))))
    return out


def test_each_license_rule_is_found_in_a_text_of_its_phrase_alone(spark):
    rules = license_scan.rules()
    texts = sorted({sample(re._parser.parse(r.pattern), pick) for r in rules for pick in (min, max)})
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: {(d.label, d.priority, d.start, d.stop) for d in r.detections} for r in license_scan.scan(rows).collect()}
    compiled = [(r, re.compile(f" {r.pattern}(?= )")) for r in rules]
    for i, text in enumerate(texts):
        padded = f" {text} "
        found = {(r.label, r.priority, padded[: m.start()].count(" "), padded[: m.start()].count(" ") + m[0].count(" ")) for r, p in compiled for m in p.finditer(padded)}
        assert found
        want = {d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2])) for e in found)}
        assert got[i] == want, text


def test_license_query_labels_equal_every_rule_without_gate(spark, sf_dir, docs):
    compiled = [(r.label, r.priority, re.compile(f" {r.pattern}(?= )")) for r in license_scan.rules()]
    base = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
    got = {r.doc_id: r for r in queries.op5_license_scan(spark, sf_dir).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        padded = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))) + " "
        found = {(label, p, padded[: m.start()].count(" "), padded[: m.start()].count(" ") + m[0].count(" ")) for label, p, rx in compiled for m in rx.finditer(padded)}
        kept = {d[0] for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2])) for e in found)}
        kept |= {label for phrase, label in base if f" {phrase} " in padded}
        assert got[doc_id].labels == ",".join(sorted(kept))


@pytest.mark.parametrize(("name", "label"), [("GPLv2", "gpl-2.0"), ("GPLv3", "gpl-3.0"), ("LGPLv3", "lgpl-3.0"), ("LGPLv2.1", "lgpl-2.1"), ("AGPLv3", "agpl-3.0"), ("Expat License", "mit"), ("PSF license", "psf-2.0"), ("Internet Systems Consortium License", "isc"), ("Apache 2.0", "apache-2.0"), ("CeCILL-B", "cecill-b"), ("Commons Clause", "commons-clause")])
def test_license_names(spark, name, label):
    assert label in license_scan.scan(spark.createDataFrame([(1, f"it is licensed under {name} here")], "doc_id long, text string")).first().labels.split(",")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 5), st.integers(0, 12), st.integers(1, 6)), max_size=25))
def test_suppression_equals_all_pairs(spark, spans):
    found = [(f"l{i}", p, start, start + size) for i, (p, start, size) in enumerate(spans)]
    row = spark.createDataFrame([(found,)], f"all array<{license_scan.DETECTION}>").select(license_scan.suppressed(F.col("all")).alias("kept")).first()
    want = {d for d in found if not any(e[2] <= d[2] and e[3] >= d[3] and (e[1] > d[1] or (e[1] == d[1] and e[3] - e[2] > d[3] - d[2])) for e in found)}
    assert {tuple(d) for d in row.kept} == want


# 6 exact duplicates


def test_exact_dedup_query(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op6_exact_dedup(spark, sf_dir).collect()}
    groups = defaultdict(list)
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        groups[text.translate(LOWER)].append(doc_id)
    for text, members in groups.items():
        for doc_id in members:
            r = got[doc_id]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (max(members), len(members), doc_id == max(members), hashlib.sha256(text.encode()).hexdigest())


def test_index_persists_over_batches_and_sessions(spark, tmp_path):
    frame = lambda session, *rows: session.createDataFrame(list(rows), "doc_id long, text string")
    path = f"file://{tmp_path}/index"
    first = exact_dedup.DigestIndex(spark, path, buckets=3)
    exact_dedup.resolve(frame(spark, (1, "A"), (2, "b")), first).collect()
    spark.sql(f"DROP TABLE {first.table}")  # as in a session whose catalogue doesn't know it
    other = spark.newSession()
    index = exact_dedup.DigestIndex(other, path)
    assert index.buckets == 3
    second = exact_dedup.resolve(frame(other, (5, "a"), (6, "c"), (7, "C")), index)
    assert {r.doc_id: (r.keep_id, r.kept) for r in second.collect()} == {5: (1, False), 6: (7, False), 7: (7, True)}
    assert [r.doc_id for r in exact_dedup.keep_one(frame(other, (8, "B"), (9, "d")), index).collect()] == [9]
    assert index.read().count() == 4
    index.drop()
    assert not (tmp_path / "index").exists()


def test_new_digests_come_from_an_anti_join_that_leaves_the_index_in_place(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=4)
    rows = exact_dedup.digested(spark.range(50).selectExpr("id AS doc_id", "CAST(id % 20 AS string) AS text"))
    index.add(rows, f"file://{tmp_path}/first")
    top = rows.groupBy("digest").agg(F.max("doc_id"))
    plan = top.join(index.read().select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "LeftAnti" in plan and "Bucketed: true" in plan
    assert index.add(rows, f"file://{tmp_path}/second").count() == 0 and index.read().count() == 20
    index.drop()


class Lost(Exception):
    pass


@pytest.mark.parametrize("stop", ["rows", "0/new", "append 0", "0/appended", "1/new", "append 1", "1/appended", "verdicts", None])
def test_a_batch_that_stops_anywhere_goes_on(spark, tmp_path, monkeypatch, stop):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, f"file://{tmp_path}/index", buckets=2)
    exact_dedup.resolve(frame((1, "a"), (9, "Z")), index, "earlier").collect()
    docs = frame((10, "A"), (11, "b"), (12, "B"), (13, "c"), (14, "c"), (90, "d"), (91, "z"), (92, "D"), (None, "e"))
    with monkeypatch.context() as m:
        settle_at, append, appended = exact_dedup.settle_at, exact_dedup.DigestIndex._append, []

        def stopping_settle(df, path, *more):
            if stop and path.endswith("/" + stop):
                raise Lost
            out = settle_at(df, path, *more)
            return out

        def stopping_append(self, new):
            append(self, new)
            appended.append(1)
            if stop == f"append {len(appended) - 1}":
                raise Lost

        m.setattr(exact_dedup, "settle_at", stopping_settle)
        m.setattr(exact_dedup.DigestIndex, "_append", stopping_append)
        if stop:
            with pytest.raises(Lost):
                exact_dedup.resolve(docs, index, "second")
    want = {10: (1, False), 11: (12, False), 12: (12, True), 13: (14, False), 14: (14, True), 90: (92, False), 91: (9, False), 92: (92, True), None: (None, True)}
    for _ in range(2):  # the retry, and the same batch once more
        assert {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.resolve(docs, index, "second").collect()} == want
        assert {r.doc_id for r in exact_dedup.keep_one(docs, index, "second").collect()} == {12, 14, 92, None}
        assert index.entries().count() == 6 == index.entries().distinct().count()
    assert [r.kept for r in exact_dedup.resolve(docs, index, "third").collect()] == [False] * 9
    index.drop()


def test_exact_dedup_in_more_ranges_gives_the_same(spark, docs):
    frame = spark.createDataFrame(docs[["doc_id", "text"]])
    one, many = (sorted(v.select("digest", "keep_id", "group_size").collect()) for v in (exact_dedup.added(frame, ranges=n)[1] for n in (1, 5)))
    assert one == many


# 7 rules


def brute_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


def test_rules_query_base_counts(spark, sf_dir, docs):
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, sf_dir).collect()}
    for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
        r, want = got[doc_id], brute_base(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r.kept and r.base_failed)


@given(st.text(alphabet="ab \n\t#é", max_size=60))
@settings(max_examples=150, deadline=None)
def test_counts_equal_brute_force(text):
    c = textstats.counts(text)
    assert (c.n_words, c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words) == brute_base(text)


def test_rules_keep_clean_documents(spark, sf_dir, labelled):
    got = {r.doc_id: r for r in queries.op7_quality_rules(spark, sf_dir).collect()}
    good = [got[i] for i, q in zip(labelled["doc_id"], labelled["quality"], strict=True) if q == 1 and not got[i].base_failed]
    bad = [got[i] for i, q in zip(labelled["doc_id"], labelled["quality"], strict=True) if q == 0]
    assert np.mean([r.kept for r in good]) > 0.97 and np.mean([r.kept for r in bad]) < 0.1


def test_rules_query_verdicts_equal_a_plain_version(spark, sf_dir, docs):
    counted = {i: textstats.counts(t) for i, t in zip(docs["doc_id"], docs["text"], strict=True)}
    votes = {i: "".join(str(rule(c)) for _, rule in quality_rules.RULES) for i, c in counted.items()}
    good = quality_rules.fit(sorted(Counter(votes.values()).items()))
    for r in queries.op7_quality_rules(spark, sf_dir).collect():
        n_words, *_, n_repeat = brute_base(docs["text"][docs["doc_id"] == r.doc_id].iloc[0])
        failed = n_words < 50 or 100 * n_repeat > 50 * n_words
        assert (r.votes, r.kept) == (votes[r.doc_id], not failed and good[votes[r.doc_id]] >= 0.5)


def test_expectation_maximisation_finds_the_accurate_rule():
    rng = np.random.default_rng(2)
    truth = rng.random(5000) < 0.7
    votes = np.stack([np.where(rng.random(5000) < a, truth, ~truth) for a in (0.95, 0.9, 0.85, 0.55)] + [np.full(5000, 2)], 1).astype(int)
    patterns = Counter("".join(map(str, v)) for v in votes)
    good = quality_rules.fit(sorted(patterns.items()))
    decided = np.array([good["".join(map(str, v))] >= 0.5 for v in votes])
    assert (decided == truth).mean() > 0.93 and good["11102"] > 0.9 and good["00012"] < 0.1


# 8 language


def test_chunked_marginals_equal_plain_forward_backward():
    rng = np.random.default_rng(0)
    lengths = np.array([1, 64, 65, 200, 3, 129])
    scores, transitions = rng.normal(size=(lengths.sum(), 4)), rng.normal(size=(4, 4))
    got, at = language_crf.marginals(scores, lengths, transitions), 0
    for n in lengths:
        want, _ = language_crf._expected(scores[at : at + n][None], transitions)
        assert np.allclose(want[0], got[at : at + n], atol=1e-4)
        at += n


def test_language_query_on_held_out_documents(spark, sf_dir, docs):
    lang = dict(zip(docs["doc_id"], docs["lang"], strict=True))
    got = queries.op8_language_crf(spark, sf_dir).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in got if r.held_out]) > 0.95


def test_language_query_equals_forward_backward_over_whole_texts(spark, sf_dir, docs):
    model = language_crf.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    for r in queries.op8_language_crf(spark, sf_dir).collect():
        words = language_crf.words_of(text[r.doc_id])
        if not words:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        known = {w: e for w, e in zip(dict.fromkeys(words), language_crf.emissions(list(dict.fromkeys(words)), model), strict=True)}
        share = language_crf._expected(np.array([known[w] for w in words], np.float64)[None], model.transitions.astype(np.float64))[0][0].mean(axis=0)
        assert r.score == pytest.approx(share.max(), abs=2e-3)
        assert r.lang_pred == model.languages[int(share.argmax())] or np.sort(share)[-1] - np.sort(share)[-2] < 4e-3


@pytest.mark.parametrize(("text", "words"), [("²", []), ("① Ⅷ ½ 12 _", []), ("a²b", ["a", "b"]), ("Größe 3x", ["größe", "x"]), ("日本語", ["日本語"]), (None, [])])
def test_words_are_runs_of_letters(text, words):
    assert language_crf.words_of(text) == words


def test_words_of_a_switched_text(docs):
    passages = [(lang, language_crf.words_of(t)[:80]) for lang, t in zip(docs["lang"], docs["text"], strict=True)]
    model = language_crf.fit(passages)
    by = {lang: next(language_crf.words_of(t)[:40] for l, t in zip(docs["lang"], docs["text"], strict=True) if l == lang and len(language_crf.words_of(t)) > 40) for lang in ("en", "de")}
    (m,) = language_crf.Labeller(model).word_marginals([by["en"] + by["de"]])
    best = [model.languages[k] for k in m.argmax(axis=1)]
    assert best[:40].count("en") > 35 and best[40:].count("de") > 35


# 9 pages


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("plain  text &amp; more", "plain text & more"),
        ("<div id=menu><a href=x>Home</a></div><div class='content'><p>Hello <b>wor</b>ld, this is a long paragraph. Really long.</p><p>Second, here.</p></div><div id='comments'><p>I disagree, this is silly.</p></div>", "Hello world, this is a long paragraph. Really long. Second, here."),
        ("<body><nav><ul><li><a>x</a><article><p>Broken nav but text, fine.</p></article><footer>f</footer>", "Broken nav but text, fine."),
        ("<main><h2>Title</h2><p>Para one is here, long enough.</p><aside>side</aside><form><label>Name</label></form><ul><li>item one</li><li>item two</li></ul></main>", "Title Para one is here, long enough. item one item two"),
        ("<nav>only</nav><footer>x</footer>", ""),
        ("<article><p>a<br>b<script>x</script></p><style>p{}</style><!-- c --></article>", "a b"),
    ],
)
def test_main_text(page, text):
    assert html_main_text.main_text(page) == text


def test_selected_text_outside_the_scope_stays():
    para = [f"Paragraph {i} tells of many things, and it is long enough to be read; so it goes on." for i in range(12)]
    tagged = lambda some: "".join(f"<p>{p}</p>" for p in some)
    lead = f"<html><body><div class=page><p>{para[0]}</p><div class=text>{tagged(para[1:])}</div></div></body></html>"
    assert html_main_text.main_text(lead) == " ".join(para)
    split = f"<html><body><article>{tagged(para[:7])}</article><div><section>{tagged(para[7:])}</section></div><ul class=menu><li>Home</li></ul></body></html>"
    assert html_main_text.main_text(split) == " ".join(para)
    siblings = f"<div>{tagged(para[:6])}</div><div class=sidebar><p>{para[0]}</p></div><div>{tagged(para[6:])}</div>"
    assert html_main_text.main_text(siblings) == " ".join(para)
    around = f"<html><body><div>Skip</div><article><h1>Title</h1>{tagged(para)}</article><div>Top</div></body></html>"
    assert html_main_text.main_text(around) == " ".join(["Title", *para])


PARA = [f"Paragraph {i} tells of many things, and it is long enough to be read; so it goes on." for i in range(12)]


def tagged(some):
    return "".join(f"<p>{p}</p>" for p in some)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        # no article element: only the ratios tell what is content
        (f"<body><div><a href=/>Home</a> <a href=/x>News</a></div><div>Buy shoes now</div><div><h2>Title</h2>{tagged(PARA)}</div><div>Call us</div></body>", ["Title", *PARA]),
        (f"<body><table><tr><td>Shop</td><td><div>{'<br><br>'.join(PARA)}</div></td></tr></table></body>", PARA),
        # reader comments without a class of theirs
        (f"<body><div>{tagged(PARA)}</div><div><h3>3 Comments</h3><div><p>{PARA[1]}</p></div></div></body>", PARA),
        (f"<article>{tagged(PARA)}<div><p>Posted by reader: Tom</p><p>{PARA[2]}</p></div></article>", PARA),
        # attributes whose values only look like marks
        (f"<article><p title='the hidden cave'>{PARA[0]}</p><p data-x='comments'>{PARA[1]}</p><section class='related-work'>{tagged(PARA[2:5])}</section><p id=notice>{PARA[5]}</p></article>", PARA[:6]),
        (f"<article>{tagged(PARA)}<p hidden>{PARA[0]}</p><p style='display: none'>{PARA[0]}</p><p aria-hidden=true>{PARA[0]}</p></article>", PARA),
    ],
)
def test_main_text_without_telling_marks(page, text):
    assert html_main_text.main_text(page) == " ".join(text)


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article>{tagged(PARA)}<div>Text in a div of its own.</div><section id=social-policy><h3>Social policy</h3>{tagged(PARA[:1])}</section></article>", [*PARA, "Text in a div of its own.", "Social policy", PARA[0]]),
        (f"<article>{tagged(PARA[:3])}<section id='comments-of-the-court'>{tagged(PARA[3:5])}</section><h2>Responses</h2>{tagged(PARA[5:])}</article>", [*PARA[:5], "Responses", *PARA[5:]]),
        (f"<article>{tagged(PARA)}</article><div><h3>What readers say</h3><div><p>{PARA[0]}</p></div></div>", PARA),
        (f"<article>{tagged(PARA)}<div class=comments-list><p>{PARA[1]}</p></div><div class='related'><a href=x>One of many things, and it is long.</a></div></article>", PARA),
    ],
)
def test_marks_are_a_prior(page, text):
    assert html_main_text.main_text(page) == " ".join(text)


def article_of(page):
    import html

    article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"</?b>", "", re.sub(r"</?(p|br|h1)>", " ", article))).split())


def test_ratios_without_marks_find_the_articles(monkeypatch):
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    for name in ("OUTSIDE", "NOISE", "MAYBE"):
        monkeypatch.setattr(html_main_text, name, 1.0)
    assert np.mean([html_main_text.main_text(p) == article_of(p) for p in pages]) >= 0.9


def test_marks_without_ratios_miss_articles_that_the_ratios_find(monkeypatch):
    """The same pages with no class, id or landmark: marks alone take everything, ratios the article."""
    pages = [h for (h,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall()]
    bare = [re.sub(r"</?(nav|footer|article)>", lambda m: m[0].replace(m[1], "div"), p).replace(' class="ad"', "") for p in pages]
    ends = lambda p: article_of(p)[-40:]
    found = [html_main_text.main_text(b) for b in bare]
    assert np.mean([f.endswith(ends(p)) for f, p in zip(found, pages, strict=True)]) >= 0.85
    monkeypatch.setattr(html_main_text, "selected", lambda nodes: np.array([n.worth >= 1 for n in nodes]))
    assert np.mean([a != html_main_text.main_text(b) for a, b in zip(found, bare, strict=True)]) >= 0.85


@pytest.mark.parametrize("page", ['<a "', "<a b='>\"'", '<a b=">"', "<a '\">", "<!--", "<a b=", "<", "<p title='"])
def test_broken_tags_are_read_in_linear_time(page):
    import time

    began = time.process_time()
    html_main_text.main_text(page * 40_000)
    assert time.process_time() - began < 5


@pytest.mark.parametrize("page", ["<div>x<p>y</p>", "<b>x<i>y", "<ul><li>x", "<table><tr><td>x"])
def test_deep_pages_are_read_in_linear_time(page):
    import time

    took = []
    for n in (4_000, 32_000):
        began = time.process_time()
        html_main_text.main_text(page * n)
        took.append(time.process_time() - began)
    assert took[1] < 30 * took[0] + 1


def test_html_query_equals_the_articles(spark, sf_dir):
    pages = dict(duckdb.sql(f"SELECT page_id, html FROM '{sf_dir}/pages.parquet'").fetchall())
    for r in queries.op9_html_extraction(spark, sf_dir).collect():
        want = article_of(pages[r.page_id])
        assert (r.text, r.n_chars) == (want, len(want))


# 10 classifier


def test_classifier_query_on_held_out_documents(spark):
    quality = dict(duckdb.sql("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet'").fetchall())
    got = queries.op10_quality_classifier(spark, "/root/testdata/sf0.01").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and r.predicted == int(r.score >= 0.3) and 0 <= r.score <= 1 for r in got)
    held = [(r.predicted, quality[r.doc_id]) for r in got if r.held_out and r.doc_id in quality]
    assert np.mean([p == q for p, q in held]) > 0.85


def test_classifier_query_equals_plain_lookups(spark, sf_dir, docs):
    model = quality_gam.train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    text = dict(zip(docs["doc_id"], docs["text"], strict=True))
    find = lambda edges, v: int(np.searchsorted(edges, v, side="right"))
    for r in queries.op10_quality_classifier(spark, sf_dir).collect():
        x = quality_gam.features(text[r.doc_id])
        f = model.intercept + sum(t[find(e, v)] for t, e, v in zip(model.tables, model.edges, x, strict=True))
        f += sum(t[find(model.pair_edges[i], x[i]), find(model.pair_edges[j], x[j])] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
        assert r.score == pytest.approx(1 / (1 + np.exp(-f)), abs=1e-9)


def test_additive_model_learns_a_pair():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_gam.PairwiseGam(pairs=3).fit(x[:3000], y[:3000])
    assert (0, 1) in model.pairs or (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9


def test_scores_are_sums_of_table_entries():
    rng = np.random.default_rng(6)
    x = rng.random((500, 3))
    model = quality_gam.PairwiseGam().fit(x, (x[:, 0] > 0.4).astype(float))
    row = x[7]
    f = model.intercept + sum(t[np.searchsorted(e, v, side="right")] for t, e, v in zip(model.tables, model.edges, row, strict=True))
    f += sum(t[np.searchsorted(model.pair_edges[i], row[i], side="right"), np.searchsorted(model.pair_edges[j], row[j], side="right")] for (i, j), t in zip(model.pairs, model.pair_tables, strict=True))
    assert model.score(x)[7] == pytest.approx(1 / (1 + np.exp(-f)))


def test_packing_result_is_a_frame():
    frame = pd.DataFrame([(1, 0, 0, 5, 1, 0), (2, 0, 0, 5, 2, 1)], columns=["doc_id", "piece", "start", "length", "ids_crc32", "row"])
    assert packing.pack_group(frame, 10, 40)["sequence_id"].tolist() == [40, 40]
