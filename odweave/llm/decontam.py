"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in lower case with runs of white space as one
blank. An item of n characters may differ by e = n // ERROR_DIVISOR edits; it is
split into e + 1 pieces, one of which any passage within e edits holds unchanged.
All pieces of all items are found in one pass over a document (Aho-Corasick); each
hit fixes where the item would begin, give or take e, and Myers' bit-parallel
distance decides on that stretch of the document.

An item too short for any edit (e = 0) is searched as it is, as whole words. Items of fewer
than ``least`` characters can be left out; by default none are. Null and blank ones match nothing. Items with the same text all match. Null and blank texts hold nothing. Rows are
searched one by one, so repeated rows, rows that share a doc_id and rows without one
get what their own text holds. Texts are searched whole; a very long one takes some
ten times its size in the task that has it. Empty tables give documents without hits,
or no rows. Other columns are not looked at.

The items go to every task in chunks of at most ITEM_CHARS characters: the size of
the benchmark is summed first, and one that is larger is searched chunk after chunk,
each a pass of its own, so no automaton outgrows a task.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K

ERROR_DIVISOR, MIN_ITEM = 12, 1
ITEM_CHARS = 4_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def find(pattern: dict[str, int], m: int, text: str, limit: int) -> tuple[int, int]:
    """(least distance, end) of the pattern anywhere in ``text``, by Myers' bit-parallel columns; distance limit + 1 if none is within ``limit``."""
    mask, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best, end = mask, 0, m, min(m, limit + 1), 0
    for j, c in enumerate(text):
        eq = pattern.get(c, 0)
        v = eq | down
        h = (((eq & up) + up) ^ up) | eq
        right_up, right_down = down | (~(h | up) & mask), up & h
        score += bool(right_up & top) - bool(right_down & top)
        if score < best:
            best, end = score, j + 1
        right_up, right_down = right_up << 1 & mask, right_down << 1 & mask  # an occurrence may begin anywhere
        up, down = right_down | (~(v | right_up) & mask), right_up & v
    return best, end


class Matcher:
    """Items of a benchmark, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]], divisor: int, least: int):
        import ahocorasick

        self.items, self.automaton = [], ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            t = normal(text)
            if len(t) < max(least, 1):
                continue
            e = len(t) // divisor
            at = [len(t) * i // (e + 1) for i in range(e + 2)]
            where: dict[str, int] = {}
            for i, c in enumerate(t):
                where[c] = where.get(c, 0) | 1 << i
            for a, b in zip(at[:-1], at[1:], strict=True):
                pieces.setdefault(t[a:b], []).append((len(self.items), a))
            self.items.append((item_id, where, len(t), e, not e))
        for piece, where_at in pieces.items():
            self.automaton.add_word(piece, (len(piece), where_at))
        if pieces:
            self.automaton.make_automaton()
        self.empty = not pieces

    def hits(self, text: str | None) -> list[tuple[int, int]]:
        """(item_id, distance) of all items that occur in the text."""
        if self.empty or not text:
            return []
        t = normal(text)
        found: dict[int, int] = {}
        tried: set[tuple[int, int]] = set()
        for end, (n, where_at) in self.automaton.iter(t):
            for i, offset in where_at:
                item_id, where, m, e, short = self.items[i]
                if found.get(i) == 0:
                    continue
                if short:
                    if (end + 1 == n or not t[end - n].isalnum()) and (end + 1 == len(t) or not t[end + 1].isalnum()):
                        found[i] = 0
                    continue
                begin = end + 1 - n - offset
                slot = (i, begin // (e + 1))  # hits a few characters apart look at one stretch
                if slot in tried:
                    continue
                tried.add(slot)
                low = slot[1] * (e + 1) - e
                d, _ = find(where, m, t[max(0, low) : low + m + 3 * e + 1], e)
                if d <= e and d < found.get(i, e + 1):
                    found[i] = d
        return sorted((self.items[i][0], d) for i, d in found.items())


def _search(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], divisor: int, least: int) -> Iterator[pa.RecordBatch]:
    """The rows with the hits of these items added to those that they have."""
    matcher = Matcher(items, divisor, least)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))
    for batch in (piece for b in batches for piece in K.pieces(b, b.column("text"))):
        before = batch.column("hits").to_pylist()
        out = [h + [{"item_id": i, "distance": d} for i, d in matcher.hits(t)] for h, t in zip(before, batch.column("text").to_pylist(), strict=True)]
        out = [sorted(h, key=lambda x: (x["item_id"], x["distance"])) for h in out]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), pa.array(out, kind)], ["doc_id", "text", "hits"])


def _chunks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[int, str]]]:
    """The items in lists of at most ``limit`` characters (or one item)."""
    size = F.coalesce(F.length("text"), F.lit(0)) + 64
    total = benchmark.agg(F.sum(size)).first()[0] or 0
    if total <= limit:
        yield [(r["item_id"], r["text"]) for r in benchmark.select("item_id", "text").collect()]
        return
    # Beyond the checked size: parts by hash, each about a third of the limit.
    parts = -(-3 * total // limit)
    for p in range(parts):
        yield [(r["item_id"], r["text"]) for r in benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == p).select("item_id", "text").collect()]


def contamination(docs: DataFrame, benchmark: DataFrame, divisor: int = ERROR_DIVISOR, least: int = MIN_ITEM, chars: int = ITEM_CHARS) -> DataFrame:
    """doc_id and hits (array of item_id, distance) of every row of ``docs``."""
    kind = "array<struct<item_id: long, distance: int>>"
    rows = docs.select("doc_id", "text", F.array().cast(kind).alias("hits"))
    for items in _chunks(benchmark, chars):  # the rows pass the chunks one after the other; nothing is joined by id
        rows = rows.mapInArrow(partial(_search, items=items, divisor=divisor, least=least), f"doc_id long, text string, hits {kind}")
    return rows.select("doc_id", "hits")


def decontaminated(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows of ``docs`` that hold no item."""
    src, schema = docs, docs.schema
    for items in _chunks(benchmark, limits.get("chars", ITEM_CHARS)):
        src = src.mapInArrow(partial(_keep_clean, items=items, divisor=limits.get("divisor", ERROR_DIVISOR), least=limits.get("least", MIN_ITEM)), schema)
    return src


def _keep_clean(batches: Iterator[pa.RecordBatch], items: list[tuple[int, str]], divisor: int, least: int) -> Iterator[pa.RecordBatch]:
    matcher = Matcher(items, divisor, least)
    for batch in (piece for b in batches for piece in K.pieces(b, b.column("text"))):
        yield batch.filter(pa.array([not matcher.hits(t) for t in batch.column("text").to_pylist()], pa.bool_()))
