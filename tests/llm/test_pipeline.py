"""The pipeline's stages, each on what the one before kept, against brute force."""

from __future__ import annotations

import random
from collections import defaultdict

import corpus_pipeline as P
from tests.llm.helpers import documents
from tests.llm.test_grouped import SPACES, distance, shingle_set, union, words
from tests.llm.test_native import WORD, waterfill

from odweave.llm import decontam, quality_llr
from odweave.llm.common import stored


def rows(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def kept_lines(docs):
    place = [(i, n, x.strip(SPACES)) for i, r in sorted(docs.items()) for n, x in enumerate(r["text"].split("\n"))]
    kinds = sorted({x for *_, x in place if x}, key=len)
    links = []
    for i, a in enumerate(kinds):
        for b in kinds[i + 1 :]:
            if len(b) - len(a) > 2:
                break
            if len(a) >= 40 and (a[:12] == b[:12] or a[-12:] == b[-12:]) and distance(a, b) <= 2:
                links.append((a, b))
    label, seen, out = union(kinds, links), set(), defaultdict(list)
    for i, n, x in place:
        if not x or label[x] not in seen:
            out[i].append(docs[i]["text"].split("\n")[n])
        if x:
            seen.add(label[x])
    return {i: "\n".join(v) for i, v in out.items() if WORD.search("\n".join(v))}


def test_stages(spark, sf_dir):
    docs = documents(spark, sf_dir, 90)
    assert [n for n, _ in P.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "decontamination", "source_mixing"]
    stage = dict(P.STAGES)

    one = stored(stage["quality_rules"](spark, docs, sf_dir))
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    assert one.schema.simpleString() == docs.schema.simpleString()
    assert set(rows(one)) == {r["doc_id"] for r in quality_llr.quality(docs, good).where("kept").collect()}

    two = stored(stage["line_dedup"](spark, one, sf_dir))
    assert {i: r["text"] for i, r in rows(two).items()} == kept_lines(rows(one))
    assert two.columns == docs.columns and all(r["n_chars"] == len(r["text"]) for r in rows(two).values())

    three = stored(stage["near_dedup"](spark, two, sf_dir))
    sets = {i: shingle_set(r["text"]) for i, r in rows(two).items()}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    assert set(rows(three)) == set(union(ids, links).values())

    four = stored(stage["decontamination"](spark, three, sf_dir))
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found = {r["doc_id"] for r in decontam.contamination(three, bench).where("size(hits) > 0").collect()}
    assert set(rows(four)) == set(rows(three)) - found and four.columns == docs.columns

    five = rows(stage["source_mixing"](spark, four, sf_dir))
    sizes, taken = defaultdict(int), defaultdict(int)
    left = rows(four)
    for r in left.values():
        sizes[r["source"]] += len(WORD.findall(r["text"]))
    want = waterfill(dict(sizes))
    for r in five.values():
        taken[r["source"]] += r["taken"]
        assert 0 < r["taken"] <= 2 * r["size"]
        assert r["text"] == left[r["doc_id"]]["text"] and r["size"] == len(WORD.findall(r["text"]))
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)


def test_stages_with_repeated_rows_and_long_texts(spark, sf_dir):
    """Repeated rows, very long texts, and rows without a doc_id."""
    docs = documents(spark, sf_dir, 20)
    schema = docs.schema
    extra = [(None, "a row without an id and with nine words", "en", "s1", 39, None, None)] * 3 + [(77_777, "twice the same few words in here", "en", None, 32, None, i) for i in range(2)]
    docs = stored(docs.unionByName(spark.createDataFrame(extra, schema)))
    stage = dict(P.STAGES)
    assert docs.where("doc_id = 10006").count() == 2 and docs.where("doc_id in (10012, 10013)").count() == 2

    near = stored(stage["near_dedup"](spark, docs, sf_dir))
    assert near.schema.simpleString() == docs.schema.simpleString()
    assert [near.where(f"doc_id = {i}").count() for i in (10006, 10007, 77_777)] == [1, 0, 1]
    assert near.where("doc_id is null").count() == 1 and near.where("doc_id in (10012, 10013)").count() == 1

    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    mixed = stage["source_mixing"](spark, docs, sf_dir).collect()
    taken = defaultdict(int)
    for r in mixed:
        taken[r["source"]] += r["taken"]
    want = waterfill(dict(sizes))
    assert all(abs(taken[s] - want[s]) <= 1 for s in want)
    texts = {(r["doc_id"], r["source"], r["text"]) for r in docs.collect()}
    assert all((r["doc_id"], r["source"], r["text"]) in texts and r["size"] == len(WORD.findall(r["text"])) for r in mixed)
    assert sum(r["doc_id"] == 10006 for r in mixed) <= 2 and sum(r["doc_id"] is None for r in mixed) <= 3


def test_near_duplicates_of_families(spark):
    """A family whose copies miss the similarity to each other but not to the original, and one that misses both."""
    from odweave.llm import superminhash

    rnd = random.Random(12)
    vocab = [f"v{i}" for i in range(4000)]
    docs = []
    for f, edits in enumerate((1, 2, 3)):
        base = [rnd.choice(vocab) for _ in range(140)]
        for i in range(40):
            t = list(base)
            for _ in range(edits * (i > 0)):
                t[rnd.randrange(140)] = f"own{f}_{i}_{rnd.random()}"
            docs.append((1000 * f + (500 if i == 0 else i), " ".join(t)))
    sets = {i: shingle_set(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(ids, links)
    got = {r["doc_id"]: r["component_id"] for r in superminhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(5)).collect()}
    assert got == want and len(words(docs[0][1])) == 140
