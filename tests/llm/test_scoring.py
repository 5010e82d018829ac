"""Language model, resampling and filter audit against plain versions, on awkward documents too."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from odweave.llm import crc_resampling, filter_audit, ngram_lm

from . import helpers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    base = helpers.documents(spark, sf_dir, 60)
    odd = spark.createDataFrame([(None, "no id and a text of some words", "en", None, 30, None, None), (None, None, None, None, 0, None, None)], helpers.SCHEMA)
    return base.unionByName(odd).repartition(3)


def key(doc_id):
    return "" if doc_id is None else str(doc_id)


# --- language model ----------------------------------------------------------


def plain_model(train: list[list[str]], order: int):
    """p(word, context) of interpolated modified Kneser-Ney, from dictionaries."""
    counts = [Counter() for _ in range(order + 1)]
    for t in train:
        x = ["<s>"] * (order - 1) + t
        for i in range(order - 1, len(x)):
            counts[order][tuple(x[i - order + 1 : i + 1])] += 1
    for k in range(order - 1, 0, -1):
        for g in counts[k + 1]:
            counts[k][g[1:]] += 1
    below, cut = [None], [None]
    for k in range(1, order + 1):
        met = defaultdict(Counter)
        for g, c in counts[k].items():
            met[g[:-1]]["all"] += c
            met[g[:-1]][min(c, 3)] += 1
        below.append(met)
        n = Counter(counts[k].values())
        d = [0, 0.5, 1, 1.5]
        if all(n[i] for i in (1, 2, 3, 4)):
            y = n[1] / (n[1] + 2 * n[2])
            e = [0] + [i - (i + 1) * y * n[i + 1] / n[i] for i in (1, 2, 3)]
            d = e if min(e) >= 0 else d
        cut.append(d)
    types = len(counts[1])

    def p(word, context):
        out = 1 / (types + 1)
        for k in range(1, order + 1):
            h = tuple(context[len(context) - k + 1 :])
            m = below[k].get(h)
            if m:
                c = counts[k][(*h, word)]
                out = (max(c - cut[k][min(c, 3)], 0) + sum(cut[k][i] * m[i] for i in (1, 2, 3)) * out) / m["all"]
        return out

    return p, [g[0] for g in counts[1]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_language_model_equals_plain_version(docs, order):
    rows = [(r["doc_id"], [*WORD.findall((r["text"] or "").translate(LOWER)), "</s>"]) for r in docs.select("doc_id", "text").collect()]
    held = [zlib.crc32(key(i).encode()) % 5 == 1 for i, _ in rows]
    train = [t for (_, t), h in zip(rows, held, strict=True) if not h]
    p, vocabulary = plain_model(train, order)
    if order > 1:  # of some contexts the shares of all words and of an unknown one make 1
        for context in (["<s>"] * (order - 1), train[0][: order - 1], ["unheard"] * (order - 1)):
            assert math.isclose(sum(p(w, context) for w in vocabulary) + p("unheard of", context), 1, rel_tol=1e-9)
    c = Counter(w for t in train for w in t)
    n, v = sum(c.values()), len(c)
    want = []
    for (i, t), h in zip(rows, held, strict=True):
        x = ["<s>"] * (order - 1) + t
        score = sum(math.log10(p(x[j], x[j - order + 1 : j])) for j in range(order - 1, len(x)))
        want.append((key(i), h, len(t), sum(c[w] > 0 for w in t), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), 6), round(score, 6)))
    scores, model = ngram_lm.language_model(docs, ngram_lm.every_fifth(), order, block=4000, slice_tokens=3000)
    got = scores.collect()
    assert sorted((key(r["doc_id"]), *r[1:5], round(r["base_score"], 6), round(r["score"], 6)) for r in got) == sorted(want)
    # The model's own arrays score documents as well as the corpus that they come from.
    again, _ = ngram_lm.language_model(docs, F.lit(True), order, model=model, block=50_000)
    assert sorted((key(r["doc_id"]), round(r["score"], 9)) for r in again.collect()) == sorted((key(r["doc_id"]), round(r["score"], 9)) for r in got)


def test_language_model_of_nothing(docs):
    assert ngram_lm.language_model(docs.limit(0), ngram_lm.every_fifth())[0].count() == 0
    unlearned = ngram_lm.language_model(docs.where("doc_id is null"), F.lit(True))[0].collect()
    assert sorted((r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"], r["score"]) for r in unlearned) == [(1, 0, 0, 0.0, 0.0), (9, 0, 0, 0.0, 0.0)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_places_of_a_block(order):
    """Each token's n-gram and context stand at the places that are told, as a search for each of them finds."""
    rnd = np.random.default_rng(order)
    sizes = np.array([5, 1, 300, 2, 1])
    words, tokens = np.unique(rnd.integers(0, 1 << 63, 40).astype(np.uint64))[::-1], rnd.permutation(np.append(np.arange(40), rnd.integers(0, 40, sizes.sum() - 40)))
    g = ngram_lm.grams(words, tokens, sizes, order)
    for k, (keys, own, context) in enumerate(ngram_lm.places(words, tokens, sizes, order), 1):
        above = g[k].context if k < order else g[0].context
        assert (keys == np.unique(np.concatenate([g[k - 1].key, above]))).all()
        assert (own == np.searchsorted(keys, g[k - 1].key)).all() and (context == np.searchsorted(keys, above)).all()


def test_packed_arrays():
    for a in ([], [0], [255, 256, 0], [1 << 63, (1 << 64) - 1, 5]):
        x = np.array(a, np.uint64)
        assert (ngram_lm.unpack(ngram_lm.pack(x)) == x).all() and (ngram_lm.unpack_keys(ngram_lm.pack_keys(np.sort(x))) == np.sort(x)).all()


# --- resampling --------------------------------------------------------------


def plain_buckets(text: str | None, n: int = 2, size: int = 10_000) -> tuple[int, list[int]]:
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    runs = [" ".join(w[i : i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]
    return len(w), [zlib.crc32(x.encode()) % size for x in runs]


def test_ring_equals_runs_put_together():
    text = "Ab c-d É42 " * 30 + "x" * 50 + "\x00\x7fé tail"
    for n in (1, 2, 3, 5):
        want = plain_buckets(text, n)
        count, got = crc_resampling.ring_buckets(text.encode(), n)
        assert (count, sorted(got.tolist())) == (want[0], sorted(want[1]))
    for limit in (1, 2, 7, 64):  # a piece of the scan never cuts a word
        assert [w for p in crc_resampling.word_pieces(text.encode(), limit) for w in p] == [w for p in crc_resampling.word_pieces(text.encode()) for w in p]


def test_resampling_equals_plain_version(spark, docs):
    target = spark.createDataFrame([("one two three words of é texts",), ("a line of some length",), (None,), ("",)], "text string")
    rows = [(r["doc_id"], *plain_buckets(r["text"])) for r in docs.select("doc_id", "text").collect()]
    s, t = Counter(b for *_, f in rows for b in f), Counter(b for r in target.collect() for b in plain_buckets(r["text"])[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in range(10_000)]
    scored = []
    for i, n, f in rows:
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{key(i)}".encode()).hexdigest()[:8], 16)
        scored.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    long = sorted((r for r in scored if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = [(key(r[0]), k + 1) for k, r in enumerate(long[: 25 * len(long) // 100])]
    got = crc_resampling.resample(docs, target).collect()
    assert sorted((key(r["doc_id"]), r["n_features"], r["weight"], r["score"]) for r in got) == sorted((key(i), *r) for i, _, *r in scored)
    assert sorted((key(r["doc_id"]), r["rank"]) for r in got if r["rank"]) == sorted(rank)
    assert crc_resampling.resample(docs.limit(0), target).count() == 0
    assert crc_resampling.resample(docs.limit(5), target.limit(0)).count() == 5


# --- audit -------------------------------------------------------------------


def test_audit_equals_plain_version(spark, docs):
    labels = spark.createDataFrame([(i, q, t) for i, q, t in [(10_003, 1, 0), (10_003, 0, 1), (10_006, 1, 1), (10_012, 1, None), (None, 1, 1), (1, 1, 0), (2, 0, 1), (3, 1, 1)]], "doc_id long, quality int, toxic int")
    rows = [(r["doc_id"], r["text"] or "", r["lang"] or "") for r in docs.collect()]
    first: dict[str, int] = {}
    for i, text, _ in rows:
        if i is not None:
            first[text] = min(first.get(text, i), i)
    known = defaultdict(lambda: [False, False])
    for r in labels.collect():
        known[r["doc_id"]] = [known[r["doc_id"]][0] or r["quality"] == 1, known[r["doc_id"]][1] or r["toxic"] == 1]
    found = []
    for i, text, lang in rows:
        w = WORD.findall(text)
        fails = "".join(f for f, bad in zip("ABCDE", (
            len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", text)) > 10 * len(text), bool(re.search(r"[#$%&*|]", text)), i is not None and first[text] < i), strict=True) if bad)
        found.append((lang, fails, *(known[i] if i is not None else (False, False))))
    want = {}
    for part in {f[0] for f in found}:
        removed_all = Counter()
        for order in map("".join, permutations("ABCDE")):
            left = [f for f in found if f[0] == part]
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                failing = sum(f in x[1] for x in found if x[0] == part)
                want[part, order, k + 1] = [len(left), len(gone), failing - len(gone), sum(x[0] == part and x[1] == f for x in found), sum(x[2] for x in gone), sum(x[3] for x in gone)]
                removed_all[f] += len(gone)
        for order in map("".join, permutations("ABCDE")):
            for k, f in enumerate(order):
                want[part, order, k + 1].append(removed_all[f])
    got = filter_audit.filter_interactions(docs, labels).collect()
    assert {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in got} == want and len(got) == len(want)
    assert filter_audit.filter_interactions(docs.limit(0), labels).count() == 0
    assert filter_audit.filter_interactions(docs.limit(4), labels.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
