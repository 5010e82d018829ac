"""MinHash, line join, decontamination, suffix dedup, chaining and classifier against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import tracemalloc
from collections import Counter, defaultdict
from itertools import combinations
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.helpers import documents, texts

from odweave.llm import chaining, decontam, line_join, quality_rff, suffix_dedup, superminhash
from odweave.llm.common import noded, passing, stored
from odweave.llm.graph import components
from odweave.sources.storage import shared_folder

ASCII_LOWER = {i: i + 32 for i in range(65, 91)}
SPACES = " \t\n\x0b\f\r"


def split(t):
    for c in SPACES[1:]:
        t = t.replace(c, " ")
    return [w for w in t.split(" ") if w]


def words(t):
    return split((t or "").translate(ASCII_LOWER))


def union(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randint(0, 400), rnd.randint(0, 400)) for _ in range(250)] + [(1000 + i, 1001 + i) for i in range(300)]
    want = union({x for e in edges if e[0] != e[1] for x in e}, edges)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def shingle_set(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def test_near_duplicates(spark, sf_dir):
    docs = documents(spark, sf_dir, 120)
    rows = texts(docs)
    sets = {i: shingle_set(t) for i, t in rows}
    ids = sorted(sets)
    links = [(a, b) for x, a in enumerate(ids) for b in ids[x + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(ids, links)
    got = superminhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in got) == Counter((i, len(sets[i]), want[i], want[i] == i) for i, _ in rows)
    assert superminhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_duplicates_in_a_family(spark):
    """Copies of one text with edits, many of them shared by two or three copies: links are those of all pairs."""
    rnd = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    pool = [(rnd.randrange(150), rnd.choice(["x", "y", "", "z z"])) for _ in range(120)]
    texts = {}
    for i in range(120):
        own, w = rnd.sample(pool, rnd.randrange(1, 9)), list(base)
        if i % 3 == 1 and i > 3:
            w = texts[i - 1].split(" ")
            own = own[:2]
        for at, new in own:
            if at < len(w):
                w[at] = new
        texts[i] = " ".join(x for x in w if x)
    sets = {i: shingle_set(t) for i, t in texts.items()}
    edges = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = union(list(sets), edges)
    got = superminhash.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    assert 1 < len(set(want.values())) < len(want)


def test_superminhash_is_the_sequential_definition():
    rnd = np.random.default_rng(3)
    for n in (1, 3, 40, 700):
        x = np.unique(rnd.integers(0, 2**63, n).astype(np.uint64))
        got = superminhash.signatures(x, np.array([0, len(x)]), 32)[0]
        best = np.full(32, np.inf)
        for e in x:
            p = list(range(32))
            for j in range(32):
                r = superminhash.K.mix(np.array([(int(e) + (2 * j + 1) * 0xA0761D6478BD642F) % 2**64], np.uint64))[0]
                k = j + int(superminhash.K.mix(np.array([int(e) ^ ((2 * j + 2) * 0xE7037ED1A0B428DB % 2**64)], np.uint64))[0]) % (32 - j)
                p[j], p[k] = p[k], p[j]
                best[p[j]] = min(best[p[j]], j + (int(r) >> 11) / 2**53)
        assert np.array_equal(got, best)


def test_superminhash_estimates_similarity():
    rnd = np.random.default_rng(4)
    pool = np.unique(rnd.integers(0, 2**63, 1500).astype(np.uint64))
    a, b = pool[:1000], pool[250:1250]
    s = superminhash.signatures(np.concatenate([a, b]), np.array([0, 1000, 2000]), 512)
    assert abs((s[0] == s[1]).mean() - 750 / 1250) < 0.07


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def edited(rnd, a, n):
    b = list(a)
    for _ in range(n):
        k, i = rnd.randrange(3), rnd.randrange(len(b) + 1)
        if k == 0:
            b.insert(i, rnd.choice("abcé"))
        elif b and i < len(b):
            if k == 1:
                del b[i]
            else:
                b[i] = rnd.choice("abcé")
    return "".join(b)


def test_edit_distances():
    rnd = random.Random(2)
    for _ in range(2500):
        a = "".join(rnd.choice("abcé") for _ in range(rnd.randint(0, 90)))
        b, t = edited(rnd, a, rnd.randint(0, 8)), rnd.randint(1, 9)
        assert line_join.edit_distance(a, b, t) == min(distance(a, b), t + 1)
    for _ in range(300):
        p = "".join(rnd.choice("ab") for _ in range(rnd.randint(1, 20)))
        t = "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 40))) + edited(rnd, p, 2)
        where = defaultdict(int)
        for i, c in enumerate(p):
            where[c] |= 1 << i
        best = min(distance(p, t[i:j]) for i in range(len(t) + 1) for j in range(i, len(t) + 1))
        assert decontam.find(where, len(p), t, 5)[0] == min(best, 6)


def test_line_join_finds_every_link(spark):
    rnd = random.Random(8)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(38, 60))).strip() for _ in range(25)]
    lines = [edited(rnd, rnd.choice(base), rnd.randint(0, 3)).replace("\n", "") for _ in range(400)] + ["short", "short", "", "  ", base[0], "  " + base[0] + "\t"]
    rnd.shuffle(lines)
    rows = [(i // 7, lines[i : i + 7]) for i in range(0, len(lines), 7)]
    docs = spark.createDataFrame([(i, "\n".join(x)) for i, x in rows] + [(10**6, None), (10**6 + 1, "")], "doc_id long, text string").repartition(4)
    place = [(i, n, x.strip(SPACES)) for i, ls in rows for n, x in enumerate(ls)]
    kinds = sorted({x for *_, x in place if x})
    links = [(a, b) for i, a in enumerate(kinds) for b in kinds[i + 1 :] if min(len(a), len(b)) >= 40 and abs(len(a) - len(b)) <= 2 and distance(a, b) <= 2]
    label = union(kinds, links)
    first, want = {}, defaultdict(list)
    for i, n, x in sorted(place):
        if x:
            if label[x] in first:
                want[i].append(n)
            first.setdefault(label[x], (i, n))
    for pairs in (line_join.BUCKET_PAIRS, 3):  # also with nearly every key dealt in blocks
        got = {r["doc_id"]: r["drop"] for r in line_join.dedup_lines(docs, most=pairs).collect()}
        assert got == dict(want)
    out = {r["doc_id"]: r["text"] for r in line_join.without_lines(docs).select("row.*").collect()}
    assert out[10**6] is None and out[10**6 + 1] == ""
    assert out[rows[3][0]] == "\n".join(x for n, x in enumerate(rows[3][1]) if n not in want[rows[3][0]])
    assert line_join.dedup_lines(docs.limit(0)).count() == 0


def test_line_join_of_odd_rows(spark):
    """Rows of one doc_id with other texts, equal rows, null ids and texts, and columns with the names that the operator uses."""
    a, b = "a line of more than forty characters, number one", "another line of more than forty characters, two"
    near = b.replace("two", "tow")
    rows = [(0, a, 1), (1, a + "\nonly here", 2), (1, b + "\nshort", 3), (1, b + "\nshort", 3), (None, "first without an id, more than forty characters\n" + a, 4), (2, near, 5), (3, None, 6), (3, None, 6), (None, "", 7)]
    docs = spark.createDataFrame([(i, t, k, k, k, k) for i, t, k in rows], "doc_id long, text string, node int, drop int, _d int, row int").repartition(3)
    got = line_join.without_lines(docs).select("row.*", "n_removed", "n_fuzzy").collect()
    assert sorted(((r["node"], r["text"], r["n_removed"], r["n_fuzzy"]) for r in got), key=str) == sorted(
        [(1, a, 0, 0), (2, "only here", 1, 0), (3, b + "\nshort", 0, 0), (3, b + "\nshort", 0, 0), (4, "first without an id, more than forty characters", 1, 0), (5, "", 1, 1), (6, None, 0, 0), (6, None, 0, 0), (7, "", 0, 0)], key=str)
    assert got[0].asDict().keys() == {*docs.columns, "n_removed", "n_fuzzy"}


@pytest.mark.parametrize("n", [1000, 4000])
def test_lines_of_a_large_family(spark, n):
    """Many variants of one line: each is compared with a few lines, not with all others."""
    rnd = random.Random(n)
    base = "this line of boiler plate stands in very many documents of the corpus, with an edit each"
    docs = spark.createDataFrame([(i, edited(rnd, base, 1 + (i % 50 == 0)) if i else base) for i in range(n)], "doc_id long, text string").repartition(8)
    compared = spark.sparkContext.accumulator(0)

    def counted(batches, t, least, keep=line_join._verify):
        def seen():
            for batch in batches:
                compared.add(batch.num_rows)
                yield batch
        return keep(seen(), t, least)

    blocks = spark.sparkContext.accumulator(0)

    def counted_blocks(block, t, keep=line_join._verify_blocks):
        side = block.column("side").to_pylist()
        right = sum(side)
        blocks.add((len(side) - right) * (right or len(side) // 2))
        return keep(block, t)

    before = line_join._verify, line_join._verify_blocks
    line_join._verify, line_join._verify_blocks = counted, counted_blocks
    try:
        drop = {r["doc_id"] for r in line_join.dedup_lines(docs).collect()}
    finally:
        line_join._verify, line_join._verify_blocks = before
    assert drop == set(range(1, n))
    assert n <= compared.value + blocks.value < 40 * n


def test_decontamination(spark, sf_dir):
    docs = documents(spark, sf_dir, 60)
    rnd = random.Random(3)
    bench = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    clean = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.contamination(docs, spark.createDataFrame(bench, "item_id long, text string")).collect()}
    for i, t in texts(docs):
        n = decontam.normal(t)
        assert {j for j, x in bench if decontam.normal(x) in n and len(x) >= 40} <= set(clean[i])
    planted = []
    for i, (j, x) in enumerate(bench):
        e = len(decontam.normal(x)) // decontam.ERROR_DIVISOR
        planted += [(20_000 + 2 * i, j, "some words before " + edited(rnd, x, e).translate({i: i - 32 for i in range(97, 123)}) + " and after"), (20_001 + 2 * i, None, edited(rnd, x, 3 * e + 25)[::-1])]
    more = spark.createDataFrame([(i, t) for i, _, t in planted] + [(1, None), (2, "")], "doc_id long, text string")
    items = spark.createDataFrame(bench + [(900, None), (901, "tiny")], "item_id long, text string")
    for chars in (decontam.ITEM_CHARS, 4000):  # also in several passes
        got = {r["doc_id"]: [h["item_id"] for h in r["hits"]] for r in decontam.contamination(more, items, chars=chars).collect()}
        assert all((j in got[i]) if j is not None else not got[i] for i, j, _ in planted)
        left = {r["doc_id"] for r in decontam.decontaminated(more, items, chars=chars).collect()}
        assert left == {i for i in got if not got[i]}
    assert decontam.contamination(more, items.limit(0)).where("size(hits) > 0").count() == 0


def test_decontamination_of_short_items(spark):
    """No item is too short: without room for an edit it is found as whole words, from ERROR_DIVISOR characters on within its edits."""
    items = spark.createDataFrame([(1, "What is 6x7"), (2, "Which river flows through old Vienna?"), (3, "pi"), (4, " "), (5, None)], "item_id long, text string")
    docs = spark.createDataFrame(
        [(1, "Q: what  is 6x7?"), (2, "somewhat is 6x78"), (3, "x which river flows thruogh old vienna? y".replace("thruogh", "throgh")), (4, "which river flows past old Vienna?"), (5, "pie and spin"), (6, "so pi, then"), (7, None)],
        "doc_id long, text string")
    got = {r["doc_id"]: [(h["item_id"], h["distance"]) for h in r["hits"]] for r in decontam.contamination(docs, items).collect()}
    assert got == {1: [(1, 0)], 2: [], 3: [(2, 1)], 4: [], 5: [], 6: [(3, 0)], 7: []}
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items).collect()} == {2, 4, 5, 7}
    assert {r["doc_id"] for r in decontam.decontaminated(docs, items, least=12).collect()} == {1, 2, 4, 5, 6, 7}


def removed(rows, length=50):
    first: dict[bytes, int] = {}
    for i, t in rows:
        raw = (t or "").encode()
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            first[s] = min(first.get(s, i), i)
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - length + 1):
            if first[raw[p : p + length]] < i:
                gone[p : p + length] = True
        runs = int(gone[:1].sum() + (np.diff(gone.astype(int)) == 1).sum())
        out[i] = (len(raw), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(raw, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(spark, sf_dir):
    docs = documents(spark, sf_dir, 100)
    want = removed(texts(docs))
    got = suffix_dedup.repeated_bytes(docs).collect()
    assert len(got) == docs.count()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == want
    assert suffix_dedup.repeated_bytes(docs.limit(0)).count() == 0


SMALL = {
    "one": [(1, "x" * 80)], "equal": [(1, "abc" * 30), (2, "abc" * 30)], "unlike": [(1, "a" * 60), (2, "b" * 70)], "short": [(1, "tiny"), (2, "tiny"), (3, None)],
    "one id, two texts": [(0, "first text " * 9), (1, "first text " * 9), (1, "second " * 12 + "first text " * 6), (2, "second " * 12)], "no ids": [(None, "abc" * 40), (None, "abc" * 40), (5, "abc" * 40)],
}


@pytest.mark.parametrize("name", SMALL)
def test_suffix_dedup_small(spark, name):
    rows = SMALL[name]
    got = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    want = Counter()
    for i, t in rows:
        others = [x for j, x in rows if i is not None and j is not None and j < i]
        n, gone, spans, kept = removed([(j, x) for j, x in enumerate(others)] + [(len(others), t)])[len(others)]
        want[(i, n, gone, spans, kept)] += 1
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got) == want


def test_suffix_dedup_in_many_parts(spark, sf_dir):
    docs = documents(spark, sf_dir, 60)
    want = removed(texts(docs))
    for parts, hot in (("400", suffix_dedup.HOT), ("8", 3)):  # also with nearly every shared anchor counted as hot
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        try:
            got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_bytes(docs, hot=hot).collect()}
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "8")
        assert got == want


def test_equal_hashes_are_not_equal_bytes():
    """Stretches whose hashes are made equal are told apart by their bytes."""
    text = np.frombuffer(b"aaaa" * 20 + b"bbbb" * 20 + b"aaaa" * 20, np.uint8)
    begin, size = np.array([0, 80, 160]), np.array([80, 80, 80])
    keep, gone = suffix_dedup.firsts(text, begin, size, np.zeros(3, np.uint64), np.array([1, 2, 3]))
    assert keep.tolist() == [0, 1] and gone.tolist() == [2]


def test_suffix_dedup_periodic(spark):
    rnd = random.Random(9)
    pieces = ["".join(rnd.choice("ab") for _ in range(rnd.randint(20, 90))) for _ in range(12)] + ["ab" * 60, "a" * 90, "abcabcabc" * 12]
    rows = [(i, "".join(rnd.choice(pieces) for _ in range(rnd.randint(1, 9)))) for i in range(60)]
    got = suffix_dedup.repeated_bytes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in got} == removed(rows)


def test_chaining(spark, sf_dir):
    docs = documents(spark, sf_dir, 80)
    rnd = random.Random(6)
    vocab = [f"w{i}" for i in range(3000)]
    passage = [rnd.choice(vocab) for _ in range(90)]
    rows = []
    for i in range(12):
        p = list(passage)
        if i % 2:
            for j in range(5, 90, 15):
                p[j] = f"edit{i}_{j}"
            del p[40]
        rows.append((50_000 + i, " ".join([rnd.choice(vocab) for _ in range(100)] + p + [rnd.choice(vocab) for _ in range(60)])))
    rows += [(60_000 + i, " ".join(rnd.choice(vocab) for _ in range(200))) for i in range(5)] + [(70_000, None), (70_001, "")]
    all_ = docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r["doc_id"]: r for r in chaining.passage_summary(all_, chaining.shared_passages(all_)).collect()}
    assert found[50_000]["n_passages"] == 0
    for i in range(1, 12):
        r = found[50_000 + i]
        assert 50_000 in r["sources"]
        start, end = map(int, r["spans"].split(",")[0].split(":")[0].split("-"))
        assert abs(start - 100) <= 6 and abs(end - 190) <= 7
    assert all(found[60_000 + i]["n_passages"] == 0 for i in range(5))
    assert found[10_007]["sources"] == [10_006] and found[10_008]["sources"] and found[70_000]["n_passages"] == 0
    assert chaining.shared_passages(all_.limit(0)).count() == 0


def test_chain_scores_prefer_collinear():
    l, d = np.array([0, 10, 500, 20, 30]), np.array([0, 10, 15, 20, 30])  # noqa: E741
    assert chaining.chains(l, d)[0] == [0, 1, 3, 4]
    assert chaining.chains(l[:0], d[:0]) == [] and spans(own('a', 60), own('b', 60)) == set()


def spans(lead, mine):
    """Words of ``mine`` in any passage, of two lists of words."""
    code = lambda t: np.array([hash(x) for x in t]).view(np.uint64)
    return {x for s, e, *_ in chaining.passages(code(lead), code(mine)) for x in range(s, e)}


def own(name, n):
    return [f"{name}{i}" for i in range(n)]


def test_passages_beyond_a_long_gap():
    for gap in (50, 100, 200, 800):
        for first, second in ((60, 60), (200, 80)):
            p, q = own("p", first), own("q", second)
            found = spans(p + own("a", gap) + q, p + own("b", gap) + q)
            assert found >= set(range(first)) | set(range(first + gap, first + gap + second))


def test_passages_beside_a_short_phrase():
    for first, gap, second in ((60, 30, 14), (55, 24, 20), (55, 30, 55), (14, 30, 60)):
        for turn in range(25):
            p, q = own(f"p{turn}_", first), own(f"q{turn}_", second)
            found = spans(own("x", 30) + p + own("a", gap) + q + own("y", 30), own("u", 20) + p + own("b", gap) + q + own("v", 40))
            want = set(range(20, 20 + first)) | set(range(20 + first + gap, 20 + first + gap + second)) if second == first else set(range(20, 20 + first)) if first > 50 else set(range(20 + first + gap, 20 + first + gap + second))
            assert found == want


def found_pairs(spark, docs):
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in docs], "doc_id long, text string").repartition(3)
    return {(r["a"], r["b"]): r["end"] - r["start"] for r in chaining.shared_passages(df).collect()}


def test_passage_whose_parts_stand_in_earlier_documents(spark):
    """b and c share 60 words; each part of them stands in other documents before, in one or in many."""
    docs, want = [], set()
    for turn in range(24):
        part, many = (2, 3)[turn % 2], (1, 12)[turn // 2 % 2]
        p, i = own(f"p{turn}_", 60), 1000 * turn
        for x in range(part):
            piece = p[60 // part * x : 60 // part * (x + 1)]
            docs += [(i + 100 * x + j, own(f"a{turn}_{x}_{j}_", 30) + piece + own(f"z{turn}_{x}_{j}_", 30)) for j in range(many)]
        docs += [(i + 900, own(f"b{turn}_", 40) + p), (i + 901, p + own(f"c{turn}_", 40))]
        want.add((i + 900, i + 901))
    assert set(found_pairs(spark, docs)) == want


def test_windows_of_frequent_parts(spark):
    """Texts put together from a few frequent parts: every word in 50 equal words that an earlier document has is in a passage."""
    rnd = random.Random(8)
    for turn in range(2):
        parts = [own(f"p{turn}_{i}_", n) for i, n in enumerate((17, 24, 33, 40, 26, 48, 30, 20))]
        texts_ = []
        for i in range(90):
            t = []
            for part in rnd.sample(parts, rnd.randint(2, 4)):
                t += part + (own(f"o{turn}_{i}_{len(t)}_", rnd.randint(5, 30)) if rnd.random() < 0.5 else [])
            texts_.append(t)
        df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts_)], "doc_id long, text string").repartition(4)
        got = {i: set() for i in range(90)}
        for r in chaining.shared_passages(df).collect():
            got[r["b"]] |= set(range(r["start"], r["end"]))
        seen, n = set(), 0
        for i, t in enumerate(texts_):
            here = [tuple(t[j : j + 50]) for j in range(len(t) - 49)]
            want = {x for j, w in enumerate(here) if w in seen for x in range(j, j + 50)}
            assert want <= got[i]
            n += bool(want)
            seen |= set(here)
        assert n > 30


def test_windows_reach_out_of_a_run():
    at = lambda *run: [(np.arange(*run) + 900, np.arange(*run))]
    assert chaining.beyond(at(60, 80), 200, 16, 50).tolist() == list(range(26, 65))
    assert chaining.beyond(at(60, 75), 200, 16, 50).tolist() == [] and chaining.beyond(at(0, 40), 40, 16, 50).tolist() == []
    assert chaining.beyond(at(0, 200), 200, 16, 50).tolist() == []
    assert chaining.beyond(at(60, 120), 130, 16, 50).tolist() == [*range(26, 60), *range(71, 81)]


def test_hashes_of_windows():
    """A window has the same hash wherever its words stand, and another one if a word differs or two change places."""
    rnd = np.random.default_rng(9)
    part, other = rnd.integers(1, 1 << 63, 50).astype(np.uint64), rnd.integers(1, 1 << 63, 400).astype(np.uint64)
    changed, turned = part.copy(), part.copy()
    changed[31] += np.uint64(1)
    turned[[7, 8]] = part[[8, 7]]
    h = np.concatenate([part, other[:77], part, changed, other[77:], turned, part])
    hashes = chaining.windows(h, np.arange(len(h) - 49), 50, chaining.summed(h)).tolist()
    spelled = [tuple(h[i : i + 50].tolist()) for i in range(len(h) - 49)]
    assert len(set(hashes)) == len(set(spelled)) == len(set(zip(hashes, spelled, strict=True))) < len(h) - 50


def test_passage_with_words_replaced(spark):
    docs, want = [], set()
    for every in (5, 6, 7, 8, 10):
        for turn in range(8):
            p = own(f"p{every}_{turn}_", 50)
            q = [f"new{every}_{turn}_{i}" if i % every == 2 else x for i, x in enumerate(p)]
            i = 1000 * every + 2 * turn
            docs += [(i, own(f"a{i}_", 40) + p + own(f"b{i}_", 40)), (i + 1, own(f"c{i}_", 30) + q + own(f"d{i}_", 50))]
            want.add((i, i + 1))
    found = found_pairs(spark, docs)
    assert set(found) == want and min(found.values()) >= 50


def test_seeds_are_packed_in_bounded_memory():
    """Two tasks and what they leave behind have to fit beside the JVM's heap: a megabyte of text a pack, a few of a bucket."""

    def most(f):
        tracemalloc.start()
        out = f()
        top = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return top, out

    rng = random.Random(5)
    text = [" ".join(f"{rng.randrange(1 << 20):05x}" for _ in range(2000)) for _ in range(700)]
    batches = [pa.RecordBatch.from_pydict({"doc_id": pa.array(range(i, i + 50), pa.int64()), "text": text[i : i + 50]}) for i in range(0, 700, 50)]
    list(chaining._seeds(iter(batches[:2]), 8, 4, 16, 8))  # tables of powers stay
    top, n = most(lambda: sum(len(x) // 8 for b in chaining._seeds(iter(batches), 200, 4, 16, 8) for x in b.column("fps").to_pylist()))
    assert n > 1_400_000 and top < 40e6
    rows = chaining.BUCKET_BYTES // 6
    fps = (np.arange(rows, dtype=np.uint64) % np.uint64(rows // 3) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(16)) & ~np.uint64(1)
    docs = np.arange(rows, dtype=np.int64)
    bucket = pa.table({"fps": [chaining.packed(fps)], "docs": [chaining.packed(docs)], "near": [np.zeros(rows, "<u2").tobytes()]})
    top, pairs = most(lambda: chaining._shared(bucket, chaining.RARE, 7))
    assert pairs.num_rows > rows // 2 and top < 150e6


def test_common_is_longest():
    rnd = random.Random(4)
    for _ in range(300):
        a, b = ([rnd.randrange(6) for _ in range(rnd.randint(1, 25))] for _ in range(2))
        i, j = chaining.common(np.array(a), np.array(b))
        n = np.zeros((len(a) + 1, len(b) + 1), int)
        for x in range(len(a)):
            for y in range(len(b)):
                n[x + 1, y + 1] = n[x, y] + 1 if a[x] == b[y] else max(n[x, y + 1], n[x + 1, y])
        assert all(a[x] == b[y] for x, y in zip(i, j, strict=True)) and np.all(np.diff(i) > 0) and np.all(np.diff(j) > 0)
        assert len(i) == n[-1, -1] or len(a) == len(b) and len(i) == sum(map(int.__eq__, a, b)) >= len(a) / 2


def test_classifier(spark, sf_dir):
    at = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = (spark.read.parquet(f"{at}/{t}.parquet") for t in ("documents", "labels"))
    got = quality_rff.classify(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(got) > 40
    right = sum((r["predicted"] == r["quality"]) for r in got)
    assert right >= 0.93 * len(got)
    hard = documents(spark, sf_dir, 5)
    scored = quality_rff.classify(hard, labels).collect()
    assert len(scored) == hard.count() and all(0 <= r["score"] <= 1 for r in scored)
    assert quality_rff.classify(hard.limit(0), labels).count() == 0
    assert quality_rff.classify(hard, labels.limit(0)).where("score = 0.5").count() == hard.count()


@pytest.mark.parametrize("v, w, want", [([3, 1, 2], [1, 1, 1], [2, 2, 2]), ([0, 1, 0.5], [1, 1, 3], [0, 0.625, 0.625])])
def test_isotonic(v, w, want):
    assert np.allclose(quality_rff.isotonic(np.array(v, float), np.array(w, float)), want)


@pytest.mark.parametrize(("n", "step"), [(40, 6), (200, 6), (200, 8)])
def test_chaining_finds_families_of_near_copies(spark, n, step):
    """Each text copies the passage of some earlier one with one word in ``step`` replaced: all have a partner at 0.83 or more, few with the first text."""
    rnd = random.Random(n + step)
    word = lambda: f"w{rnd.randrange(60_000):05d}"
    copies = [[word() for _ in range(60)]]
    for _ in range(1, n):
        x = list(rnd.choice(copies))
        for j in range(rnd.randrange(step), 60, step):
            x[j] = word()
        copies.append(x)
    rows = [(i, " ".join([*(word() for _ in range(30)), *x, *(word() for _ in range(30))])) for i, x in enumerate(copies)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = chaining.passage_summary(df, chaining.shared_passages(df)).where("n_passages > 0").count()
    assert found >= 0.97 * (n - 1)


def test_chaining_tells_rows_of_one_doc_id_apart(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    rows = [(1, a), (1, b), (2, f"{a} between {b}"), (None, b), (3, None)]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
        got = chaining.passage_summary(df, chaining.shared_passages(df)).collect()
        assert sorted((r["doc_id"] or 0, r["n_passages"], r["n_passage_words"]) for r in got if r["doc_id"] in (2, 3)) == [(2, 0, 0), (3, 0, 0)]
        assert sorted(r["n_passage_words"] for r in got if r["doc_id"] == 1) == [60, 60]
        assert [r["n_passage_words"] for r in got if r["doc_id"] is None] == [60]
        assert {s for r in got for s in r["sources"]} <= {1, 2, None} and all(2 in r["sources"] for r in got if r["doc_id"] not in (2, 3))


def test_bucket_rows_grow_with_lines():
    """Lines that all share a key leave their bucket as so many rows, not as all their pairs, and none is left out."""
    for n in (3, 8, 20, 60, 300):
        h = np.arange(1, n + 1)
        bucket = pa.table({"keys": [np.append(np.full(n, 8), np.full(n, 9)).astype("<u8").tobytes()], "lines": [np.append(h, h).tobytes()]})
        found = line_join._match(bucket, line_join.BUCKET_PAIRS).to_pylist()
        assert len(found) <= line_join.LINE_PAIRS * 2 * n
        assert {x for r in found for x in (r["a"], r["b"]) if x is not None} == set(h.tolist())
        assert len(found) == n * (n - 1) // 2 or all(r["key"] == 4 and r["b"] is None for r in found) and len(found) == n


def test_line_join_of_lines_that_share_a_hash(spark):
    """With the first hash cut to two bits lines of all kinds share it: the second one keeps them apart, and links are the same."""
    rnd = random.Random(3)
    short = [f"line {i} of its own" for i in range(24)]
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(60)).strip(" ") for _ in range(8)]
    near = [x[:3] + "#" + x[4:] for x in base]  # the second hash sees the ends of a line
    rows = [(1, "\n".join(short)), (2, "\n".join(base)), (3, "\n".join(near)), (4, short[3] + "\n" + base[5]), (None, short[7])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    of = lambda df: sorted((r["doc_id"] or 0, r["n_removed"], r["n_fuzzy"], r["drop"]) for r in df.collect())
    want = [(0, 1, 0, [0]), (3, 8, 8, list(range(8))), (4, 2, 0, [0, 1])]
    assert of(line_join.dedup_lines(docs)) == want
    for bits in (2, 1):
        assert of(line_join.dedup_lines(docs, bits=bits)) == want


def test_line_join_of_counters(spark, monkeypatch):
    """One sentence with a random number a line: links are found by shortened middles, and no block of lines is compared with another."""
    rnd = random.Random(8)
    n = 1200
    lines = [f"the meter in the cellar of the old house on the hill showed {rnd.randrange(10**6):06d} units in the evening" for _ in range(n)]
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(8)
    blocks = spark.sparkContext.accumulator(0)

    def counted(block, t, keep=line_join._verify_blocks):
        blocks.add(1)
        return keep(block, t)

    monkeypatch.setattr(line_join, "_verify_blocks", counted)
    drop = {r["doc_id"] for r in line_join.dedup_lines(docs).collect()}
    number = [x[60:66] for x in lines]
    by: dict[str, list[int]] = defaultdict(list)
    for i, x in enumerate(number):
        for v in line_join.shortened(x, 2):
            by[v].append(i)
    root = list(range(n))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for group in by.values():
        for i, j in combinations(group, 2):
            if top(i) != top(j) and line_join.edit_distance(number[i], number[j], 2) <= 2:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    assert drop == {i for i in range(n) if top(i) != i} and blocks.value == 0


def test_chaining_equals_all_pairs(spark, sf_dir):
    """All earlier texts against each later one, by the same chaining and alignment: no document with a passage is missed, nor are its words."""
    rows = sorted({r["doc_id"]: r["text"] for r in documents(spark, sf_dir, 120).collect()}.items())
    rows = [(i, t) for i, t in rows if len(t or "") < 40_000]
    code: dict[str, int] = {}
    words = [np.array([code.setdefault(w, len(code)) for w in (t or "").translate(ASCII_LOWER).split()], np.uint64) for _, t in rows]
    words = [chaining.K.mix(w + np.uint64(1)) for w in words]
    seeds = [set(chaining.runs(w, np.zeros(len(w), np.int64), chaining.SEED_WORDS)[0].tolist()) for w in words]
    want: dict[int, set[int]] = {}
    for j, (b, _) in enumerate(rows):
        for i in range(j):
            if seeds[i] & seeds[j]:
                for start, end, *_ in chaining.passages(words[i], words[j]):
                    want.setdefault(b, set()).update(range(start, end))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["n_passage_words"] for r in chaining.passage_summary(df, chaining.shared_passages(df)).collect()}
    assert {i for i, n in got.items() if n} == set(want) and len(want) > 10
    assert all(n <= len(want.get(i, ())) for i, n in got.items()) and sum(got.values()) >= 0.99 * sum(map(len, want.values()))


def test_chaining_of_all_pairs_of_frequent_seeds(spark, monkeypatch):
    """Asked for all pairs of frequent seeds, chaining finds the passages of every two texts of a family, over several blocks of a seed."""
    monkeypatch.setattr(chaining, "BLOCK", 8)
    rnd = random.Random(3)
    word = lambda: f"w{rnd.randrange(60_000):05d}"
    copies = [[word() for _ in range(60)]]
    for _ in range(1, 40):
        x = list(rnd.choice(copies))
        for j in range(rnd.randrange(12), 60, 12):
            x[j] = word()
        copies.append(x)
    hashed = {w: chaining.K.mix(np.array([i + 1], np.uint64))[0] for i, w in enumerate(sorted({w for x in copies for w in x}))}
    arrays = [np.array([hashed[w] for w in x], np.uint64) for x in copies]
    want = {(i, j): sum(p[1] - p[0] for p in chaining.passages(arrays[i], arrays[j])) for j in range(40) for i in range(j)}
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(copies)], "doc_id long, text string").repartition(4)
    pairs = lambda **k: {(r["a"], r["b"]): r["n"] for r in chaining.shared_passages(df, **k).groupBy("a", "b").agg(F.sum(F.expr("end - start")).alias("n")).collect()}
    got = pairs(exact=True)
    assert got == {p: n for p, n in want.items() if n} and 100 < len(got)
    assert got.keys() > pairs().keys()


def test_lines_of_a_key_in_one_task(spark, monkeypatch):
    """Keys of some hundred lines take no rounds of leaders: one task compares a key's lines, a family costs few comparisons, components are those of all pairs."""
    rnd = random.Random(4)
    base = ["".join(rnd.choice("abcdefgh é") for _ in range(56)) for _ in range(3)]
    head = "the same beginning of every line, and then "
    lines = sorted({head + edited(rnd, rnd.choice(base), rnd.randint(0, 3)).replace("\n", "") for _ in range(400)})
    lines = sorted({x.strip() for x in lines} | {f"{head}{rnd.randrange(10**9):09d} of other units and nothing else besides" for _ in range(100)})
    links = [(a, b) for a, b in combinations(lines, 2) if line_join.edit_distance(a, b, 2) <= 2]
    label = union(lines, links)
    monkeypatch.setattr(line_join, "common_links", None)
    compared, keep = [], line_join.edit_distance
    monkeypatch.setattr(line_join, "edit_distance", lambda a, b, t: compared.append(1) or keep(a, b, t))
    block = pa.table({"h": list(range(len(lines))), "text": lines})
    found = line_join._verify_key(block, 2, 40, line_join._verify).to_pylist()
    got = union(lines, [(lines[r["a"]], lines[r["b"]]) for r in found])
    same = lambda of: len({(label[x], of[x]) for x in lines}) == len(set(label.values())) == len(set(of.values()))
    assert same(got) and len(found) < 2 * len(lines) and 20 * len(compared) < len(lines) ** 2
    assert line_join._verify_key(block, 2, 200, line_join._verify).num_rows == 0
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string").repartition(4)
    first = {label[x]: i for i, x in reversed(list(enumerate(lines)))}
    assert {r["doc_id"] for r in line_join.dedup_lines(docs).collect()} == {i for i, x in enumerate(lines) if first[label[x]] != i}


def test_stored_frames_leave_no_shuffle_files_and_batches_are_bounded(spark):
    def held():
        return int(spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses().size())

    before = held()
    stored(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    end = time.time() + 20
    while held() > before and time.time() < end:
        time.sleep(0.2)
    assert held() == before
    count = lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"]) for b in batches)
    rows = spark.range(0, 10_000, 1, 1).select(F.repeat(F.lit("abcdefghij"), 200).alias("t")).mapInArrow(count, "n long").collect()
    assert len(rows) > 3 and max(r["n"] for r in rows) < 5 << 20


def test_stored_frames_go_when_their_reader_has_ended(spark, sf_dir):
    there = lambda: {p.name for p in Path(shared_folder(spark).removeprefix("file:")).glob("odweave/frame-*")}
    docs = noded(documents(spark, sf_dir).select("doc_id", "text"))
    edges = spark.createDataFrame([(i, i + 1) for i in range(9)], "a long, b long")
    for of in (lambda: components(edges), lambda: line_join.dedup_lines(docs), lambda: superminhash.grouped(docs)):
        before = there()
        found = of()
        assert not found.isEmpty() and len(there() - before) == 1

    @passing
    def ends_badly():
        raise ValueError(stored(edges).isEmpty())

    before = there()
    with pytest.raises(ValueError, match="False"):
        ends_badly()
    assert there() == before
