"""Scores of the trained operators, computed again in plain Python, and the search for benchmark items by full comparison."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from tests.llm.helpers import documents, texts

from pyspark.sql import functions as F

from odweave.llm import decontam, quality_llr, quality_rff, secrets

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_quality_ratio_is_the_mean_of_its_buckets(spark, sf_dir):
    docs = documents(spark, sf_dir, 60)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    table = quality_llr.log_ratios(docs, good)
    buckets = {(r["doc_id"], r["text"]): r["b"] for r in quality_llr.with_words(docs, "doc_id", "text").selectExpr("doc_id", "text", f"{quality_llr.hashed()} as b").collect()}
    of_id = {}
    for (i, t), b in buckets.items():
        n = len(WORD.findall(t or ""))
        assert len(b) == max(0, 2 * n - 1)
        of_id[i] = sum(table[x] for x in b) / len(b) if b else 0.0
    for r in quality_llr.quality(docs, good).collect():
        assert math.isclose(r["llr"], of_id[r["doc_id"]], rel_tol=1e-6, abs_tol=1e-6)
        if abs(r["llr"] - quality_llr.THRESHOLD) > 1e-6:
            assert r["kept"] == (not r["base_failed"] and r["llr"] >= quality_llr.THRESHOLD)


def test_classifier_is_ridge_with_isotonic_levels(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    rows = docs.select("doc_id", "text").collect()
    quality = {r["doc_id"]: r["quality"] for r in labels.collect()}
    raw = [(r["text"] or "").encode() for r in rows]
    buf, off = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    x = np.concatenate([quality_rff.statistics(buf[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]])) for i in range(len(rows))]).astype(np.float32).astype(float)
    fold = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in rows])
    y = np.array([quality.get(r["doc_id"], -1) for r in rows])
    fit, held = (fold > 1) & (y >= 0), (fold == 1) & (y >= 0)
    mean, scale = x[fit].mean(0), x[fit].std(0)
    scale[scale < 1e-6] = 1
    z = quality_rff.fourier(x, mean, scale)
    # Ridge by least squares over stacked rows; the constant is not penalised.
    penalty = np.eye(z.shape[1]) * math.sqrt(quality_rff.RIDGE)
    penalty[0] = 0
    w = np.linalg.lstsq(np.concatenate([z[fit], penalty]), np.concatenate([y[fit], np.zeros(len(penalty))]), rcond=None)[0]
    score = z @ w
    got = {r["doc_id"]: r["score"] for r in quality_rff.classify(docs, labels).collect()}
    bins = np.clip(np.floor((score + 0.5) / 2 * quality_rff.BINS), 0, quality_rff.BINS - 1)
    kinds, inverse = np.unique(bins[held], return_inverse=True)
    n, s = np.bincount(inverse).astype(float), np.bincount(inverse, weights=y[held])
    v = (s + 0.02) / (n + 0.04)
    # Isotonic by its minimax formula.
    mean_of = lambda a, b: np.average(v[a : b + 1], weights=n[a : b + 1])
    levels = [max(min(mean_of(a, b) for b in range(i, len(v))) for a in range(i + 1)) for i in range(len(v))]
    want = np.interp(score, -0.5 + (kinds + 0.5) * 2 / quality_rff.BINS, levels)
    off_by = np.abs(want - np.array([got[r["doc_id"]] for r in rows]))
    # A score at the edge of a bin may fall on either side of it.
    assert np.quantile(off_by, 0.99) < 1e-3


def test_markov_ratio_on_unseen_strings(spark):
    rnd = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    words = "order status customer invoice total amount payment method address street country region product price count index value handler request response session config default".split()
    random_ones = ["".join(rnd.choice(letters) for _ in range(rnd.randint(28, 44))) for _ in range(200)]
    plain = ["_".join(rnd.choice(words) for _ in range(5)) + f"_{rnd.randint(1, 2030)}" for _ in range(200)]
    rows = [(i, f"before {t} after") for i, t in enumerate(random_ones + plain)]
    got = {r["doc_id"]: r for r in secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    caught = sum(got[i]["n_markov"] + got[i]["n_hex"] > 0 for i in range(200))
    assert caught >= 190
    assert sum(got[i]["n_markov"] > 0 for i in range(200, 400)) <= 2


def test_markov_ratio_decides_alone(spark, sf_dir):
    """Keys of several alphabets, letters alone among them, from 16 characters on; tokens of the documents are left alone."""
    rnd = random.Random(29)
    low, up, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    samples = secrets.labelled_samples(spark).unionByName(secrets.trusted_samples(docs, labels.where("quality = 1"))).cache()
    assert samples.where("is_random").count() == secrets.SAMPLES < samples.where("not is_random").count()
    rows, of = [], {}
    for least, alphabet, n in ((0.95, low + up + digits + "+/", 16), (0.95, low + up, 16), (0.9, up + digits, 16), (0.9, low + digits, 16), (0.9, low, 16), (0.95, low, 26), (0.95, up + digits, 20)):
        of[len(of)] = least
        rows += [(1000 * (len(of) - 1) + i, "the key " + "".join(rnd.choice(alphabet) for _ in range(n)) + " is here") for i in range(200)]
    got = secrets.secrets(spark.createDataFrame(rows, "doc_id long, text string"), samples).where("n_markov = 1 or n_access = 1").collect()
    found = Counter(r["doc_id"] // 1000 for r in got)
    assert all(found[k] >= least * 200 for k, least in of.items()), found
    plain = secrets.secrets(docs, samples).agg(F.sum("n_markov"), F.sum(F.expr("size(base)"))).first()
    tokens = docs.select(F.sum(F.size(F.regexp_extract_all("text", F.lit(secrets.TOKEN), F.lit(0))))).first()[0]
    assert plain[0] <= 1e-3 * tokens


def test_secrets_of_a_long_text(spark):
    """Places hold over many folds of matches, and an empty list of trusted documents leaves the made samples."""
    hexes, n = "0123456789abcdef" * 2, 3 * secrets.FOLD + 5
    text = "é" + f"{hexes} é " * n + 'token: "abcdefgh"'
    docs = spark.createDataFrame([(1, text), (2, hexes * 20_000), (None, hexes), (3, None)], "doc_id long, text string")
    samples = secrets.labelled_samples(spark, 500)
    assert secrets.trusted_samples(docs, docs.limit(0)).isEmpty()
    got = {r["doc_id"]: r for r in secrets.secrets(docs, samples).collect()}
    assert [tuple(x) for x in got[1]["base"]] == [(1 + 35 * i, 2, 33 + 35 * i) for i in range(n)] + [(1 + 35 * n, 0, len(text) - 1)]
    assert got[1]["added"] == [] and [tuple(x) for x in got[2]["base"]] == [(0, 2, 640_000)]
    assert got[None]["spans"] == "hex:0:32" and got[3]["spans"] == ""


def within(item: str, text: str, e: int) -> bool:
    """Whether some stretch of the text is within e edits of the item, column by column."""
    row = np.arange(len(item) + 1)
    code = np.array([ord(c) for c in item])
    for c in text:
        step = np.minimum(row[1:] + 1, row[:-1] + (code != ord(c)))
        new = np.concatenate([[0], step])
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
        if row[-1] <= e:
            return True
    return False


def test_decontamination_against_every_item(spark, sf_dir):
    rnd = random.Random(23)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").limit(12).collect()]
    rows = [(i, t[:1500]) for i, t in texts(documents(spark, sf_dir, 12)) if t]
    for j, (_, x) in enumerate(bench):
        n, e = len(decontam.normal(x)), len(decontam.normal(x)) // decontam.ERROR_DIVISOR
        for edits in (e - 1, e, e + 1, e + 3):
            t = list(decontam.normal(x))
            for p in rnd.sample(range(n), edits):
                t[p] = rnd.choice(["", "#", t[p] + "#"])
            rows.append((50_000 + 10 * j + edits - e, "words in front " + "".join(t) + " words behind"))
    got = Counter()
    for r in decontam.contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect():
        got.update((r["doc_id"], h["item_id"]) for h in r["hits"])
    want = Counter()
    for i, t in rows:
        for j, x in bench:
            item = decontam.normal(x)
            if within(item, decontam.normal(t), len(item) // decontam.ERROR_DIVISOR):
                want[(i, j)] += 1
    assert len(want) >= 2 * len(bench) and got == want
