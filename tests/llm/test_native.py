"""Chat formatting, mixing, secrets and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import awkward, documents, texts

from odweave.llm import chat, mixing, quality_llr, secrets
from odweave.llm.common import words_column

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_chat_round_trip(spark):
    hard = [
        "</s>[INST] ok [/INST]", "<s>", r"<\s>", r"<\\/s> <\s", "<", "[/INST", "<<s>", "[[/INST]]", "a\nb</s>\n", "", None, r"\[INST] [\INST] [\\/ROLE]", "x" * 50_000 + "</s>",
        "<" + "\\" * 300 + "s>", "é\U0001f600<s>",
    ]
    rows = [(1, i, r, t) for i, t in enumerate(hard) for r in ("user", "assistant", "system", "a:b%3A[/ROLE]<s>", None)]
    rows += [(2, 0, "user", "hi"), (2, 0, "user", "hi"), (None, None, None, None), (3, None, "assistant", "<s>")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    turns = chat.loss_spans(chat.format_turns(df))
    role, text, good = chat.parse_turn(turns["segment"])
    assert turns.where(~good | (role != turns["role"]) | (text != turns["text"])).count() == 0
    got = {r["conv_id"]: r for r in chat.digests(turns).collect()}
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    assert set(got) == set(by)
    for c, seq in by.items():
        seq.sort()
        assert got[c]["n_turns"] == len(seq)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for *_, r, x in seq).encode()).hexdigest()
        said = "".join(x for *_, r, x in seq if r == "assistant")
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(said), hashlib.sha256(said.encode()).hexdigest())
    # The mask decides what counts: moved by one place, or given to another turn, it says something else.
    only = turns.where("conv_id = 3")
    assert chat.digests(only).first()["loss_sha256"] == hashlib.sha256(b"<s>").hexdigest()
    for change in (("loss_start", F.col("loss_start") + 1), ("loss_length", F.col("loss_length") - 1), ("loss_start", F.lit(None).cast("int"))):
        assert chat.digests(only.withColumn(*change)).first()["loss_sha256"] != hashlib.sha256(b"<s>").hexdigest()
    # The concatenation itself parses into the same turns.
    whole = "".join(r["segment"] for r in turns.where("conv_id = 1").orderBy("turn", "role", "text").collect())
    assert len(re.findall(r"(?s)<s>.*?</s>|\[INST\].*?\[/INST\]|\[ROLE\].*?\[/ROLE\]", whole)) == len(hard) * 5
    told = [(r, x) for *_, r, x in by[1]]
    shorter = whole.replace("x" * 50_000, "")
    for size in (1, 7, 1000, len(whole)):  # read as characters that come in pieces of any size
        reader, text = chat.Reader(), whole if size >= 1000 else shorter
        read = [t for i in range(0, len(text), size) for t in reader.feed(text[i : i + size])]
        assert sorted(read) == sorted((r, x if size >= 1000 else x.replace("x" * 50_000, "")) for r, x in told) and not reader.rest
    with pytest.raises(ValueError):
        chat.Reader().feed("<s>ok</s>stray text")
    broken = turns.where("conv_id = 2").withColumn("segment", F.replace("segment", F.lit("hi"), F.lit("ho")))
    with pytest.raises(Exception, match="does not read back"):
        chat.digests(broken).collect()
    assert chat.digests(chat.loss_spans(chat.format_turns(df.limit(0)))).count() == 0


def test_words_at_the_ends_of_a_text(spark):
    texts = ["f", "of", "ff of fluff", "fabf", "\x0cab cd\x0c", "\x0c \x0b", "\x20\x09\x0a\x0b\x0c\x0d", "ntrb0u ntrb0u", "\\f\\", "\xa0f\xa0", "\x1ff\x1f", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", F.expr(words_column()).alias("w"))
    assert {r["i"]: r["w"] for r in df.collect()} == {i: WORD.findall(t or "") for i, t in enumerate(texts)}


def repeated(words):
    tri = Counter(zip(words, words[1:], words[2:]))
    hit = set()
    for i, t in enumerate(zip(words, words[1:], words[2:])):
        if tri[t] > 1:
            hit |= {i, i + 1, i + 2}
    return len(hit)


def test_quality_counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    got = quality_llr.quality(docs, good).collect()
    want = Counter()
    for i, t in texts(docs):
        w, lines = WORD.findall(t or ""), [x for x in (t or "").split("\n") if WORD.search(x)]
        rep = repeated(w)
        want[(i, len(w), sum(map(len, w)), sum((t or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))] += 1
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(not r["kept"] for r in got if r["base_failed"])
    assert quality_llr.quality(docs.limit(0), good).count() == 0
    assert all(r["llr"] == 0 for r in quality_llr.quality(docs, good.limit(0)).collect())


def test_ratios_count_every_trusted_document(spark, sf_dir):
    """The target is all trusted rows, whichever way Spark joins them; rows without a doc_id are raw corpus only."""
    docs = documents(spark, sf_dir, 60)
    docs = docs.unionByName(docs.where("doc_id >= 10015").withColumn("doc_id", F.lit(None).cast("long")))
    good = docs.select("doc_id").where("doc_id % 2 = 0 or doc_id is null")
    ways = []
    for limit, ids in (("10MB", quality_llr.BROADCAST_IDS), ("10MB", 0), ("-1", 0)):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        ways.append(quality_llr.log_ratios(docs, good, 64, ids))
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    raw, want = np.zeros(64), np.zeros(64)
    for r in quality_llr.with_words(docs, "doc_id").select("doc_id", F.expr(quality_llr.hashed(64)).alias("b")).collect():
        n = np.bincount(r["b"], minlength=64) if r["b"] else np.zeros(64)
        raw += n
        want += n * (r["doc_id"] is not None and r["doc_id"] % 2 == 0)
    prior = (raw + 0.5) / (raw.sum() + 32)
    want = np.log((want + 20 * prior) / (want.sum() + 20)) - np.log(prior)
    assert all(np.allclose(w, want) for w in ways)


def test_quality_tells_junk(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_llr.quality(docs, labels.where("quality = 1")).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = ([r for r in got if r["quality"] == q] for q in (1, 0))
    assert sum(r["kept"] for r in good) >= 0.99 * len(good)
    assert sum(r["kept"] for r in bad) <= 0.3 * len(bad)


def base_spans(t):
    out = []
    for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t):
        if len(m[1]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 32]
    return sorted(out)


def test_secrets(spark, sf_dir):
    docs = documents(spark, sf_dir)
    want = {}
    for i, t in texts(docs):
        want[i] = base_spans(t or "")
    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    samples = secrets.labelled_samples(spark).unionByName(secrets.trusted_samples(docs, trusted)).cache()
    found = secrets.secrets(docs, samples).collect()
    assert len(found) == docs.count()
    for r in found:
        b = want[r["doc_id"]]
        joined = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        assert [tuple(x) for x in r["base"]] == b
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == q for _, k, _ in b) for q in range(3))
    by_id = {r["doc_id"]: r["spans"] for r in found}
    key = next(i for i, t, *_ in awkward() if t and t.startswith("key 9fK2"))
    assert by_id[key] == "markov:4:36"  # the random key, not the identifier
    # What the ratio adds, token by token: the models counted again from the samples.
    code, table = {c: i + 1 for i, c in enumerate(secrets.ALPHABET)}, np.full((2, secrets.CLASSES, secrets.CLASSES), 0.5)
    for r in samples.collect():
        for x, y in zip(r["text"], r["text"][1:]):
            table[int(r["is_random"]), code.get(x, 0), code.get(y, 0)] += 1
    log = np.log(table / table.sum(2, keepdims=True))
    added = {}
    for i, t in texts(docs):
        added[i] = []
        for m in re.finditer("[A-Za-z0-9+/_=-]{8,}", t or ""):
            ratio = sum(log[1, code[x], code[y]] - log[0, code[x], code[y]] for x, y in zip(m[0], m[0][1:]))
            if ratio >= max(14, 0.5 * (len(m[0]) - 1)) and not any(s < m.end() and m.start() < e for s, _, e in want[i]):
                added[i].append((m.start(), 3, m.end()))
    assert all([tuple(x) for x in r["added"]] == added[r["doc_id"]] for r in found)
    assert sum(r["n_markov"] for r in found) == sum(len(added[r["doc_id"]]) for r in found) > 1
    assert secrets.secrets(docs.limit(0)).count() == 0


def waterfill(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, out, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:
        rest = total - sum(out.values())
        share = {s: rest * w[s] / sum(w[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = 2 * sizes[s]
            open_.discard(s)
        if not open_:
            return out


def test_mixing(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows, blocks = mixing.mix(docs)
    got = rows.collect()
    assert sorted((r["doc_id"], r["size"]) for r in got) == sorted((i, len(WORD.findall(t or ""))) for i, t in texts(docs))
    sizes = defaultdict(int)
    for r in got:
        sizes[r["source"]] += r["size"]
    want, taken = waterfill(dict(sizes)), defaultdict(int)
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert r["target"] == pytest.approx(want[r["source"]], rel=1e-9, abs=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    again = mixing.mix(docs.repartition(7))[0].collect()
    key = lambda r: (r["doc_id"], r["size"], r["taken"])
    assert sorted(map(key, got)) == sorted(map(key, again))
    cells = Counter((b["doc_id"], b["first_word"]) for b in blocks.where("doc_id <> 10006").collect())
    assert max(cells.values()) == 1
    assert mixing.mix(docs.limit(0))[0].count() == 0


def draws(spark, l, r, d, n):  # noqa: E741
    rows = spark.range(n).selectExpr("xxhash64(id) as key", f"{l}L as lw", f"{r}L as rw", f"{d}L as quota")
    return sorted(x["take"] for x in mixing.hypergeometric(rows).select("take").collect())


@pytest.mark.parametrize("l, r, d", [(300, 700, 200), (3, 1, 2), (0, 9, 4), (5, 0, 5), (40_000, 60_000, 30_000)])
def test_hypergeometric_is_exact(spark, l, r, d):  # noqa: E741
    got, lo, hi = Counter(draws(spark, l, r, d, 4000)), max(0, d - r), min(l, d)
    choose = lambda n, k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
    p = {j: math.exp(choose(l, j) + choose(r, d - j) - choose(l + r, d)) for j in range(lo, hi + 1)}
    assert set(got) <= set(p)
    cells, seen, want = [], 0, 0.0  # neighbours pooled to 40 expected draws a cell
    for j in p:
        seen, want = seen + got[j], want + 4000 * p[j]
        if want >= 40:
            cells.append((seen, want))
            seen, want = 0, 0.0
    chi = sum((s - w) ** 2 / w for s, w in cells)
    assert chi < len(cells) + 4 * math.sqrt(2 * len(cells)) + 4


@pytest.mark.parametrize("size", [10**3, 10**9, 10**13])
def test_hypergeometric_at_every_size(spark, size):
    l, r, d, n = 3 * size, 5 * size, 2 * size, 4000  # noqa: E741
    mean, sd = d * l / (l + r), math.sqrt(d * l / (l + r) * r / (l + r) * (l + r - d) / (l + r - 1))
    z = [(x - mean) / sd for x in draws(spark, l, r, d, n)]
    assert abs(sum(z)) / n < 4 / math.sqrt(n) and abs(sum(x * x for x in z) / n - 1) < 4 * math.sqrt(2 / n)
    assert 2.8 < z[-1] < 5 and -5 < z[0] < -2.8 and abs(z[n // 2]) < 0.08
    if size > 10**3:
        assert len(set(z)) > 0.95 * n  # every value can be drawn, not those of a stride alone; at 1e9 some 119 of 4000 meet another by chance
