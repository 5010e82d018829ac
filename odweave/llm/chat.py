r"""Chat formatting with a grammar round trip.

A turn is rendered as ``<s>text</s>`` for the assistant, ``[INST]text[/INST]``
for the user and ``[ROLE]role:text[/ROLE]`` for any other role. A conversation
is the concatenation of its turns.

Grammar of the parser: conversation = turn*; a turn starts with one of the three
openers and ends at the first matching closer; in ``[ROLE]`` the role ends at the
first colon (what a role's name must not hold is percent-coded, see NAME_CODES).
Inside a body, a control string whose first character is followed by backslashes
stands for the same with one backslash less.

Each turn is rendered plain and parsed again. Where the parse differs from the
source, or the body holds a control string, the conflicting content gets a
backslash after its first character, and the turn is parsed once more; a turn
that still differs is an error. No control string has its first character a
second time, so a body and a closer, or two turns, never form one between them.

What a conversation says is read back from its formatted text alone: ``Reader`` takes
it as a stream of characters, in pieces that tell nothing of where turns begin, and
finds the turns by the grammar. Every turn that it recovers is held against the
source's, in order; one that differs, or text left over, is an error.

Null texts and null roles are empty strings. Rows of a conversation are ordered
by turn (null first), then role, then text, so ties and repeated rows have a
defined order. A null conv_id is a conversation of its own. A very long text is held by
one task as the turn that it is. An empty table gives no rows. Input columns beside
conv_id, turn, role and text are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import partitions

# The control strings of the template.
CONTROL = r"(?:/?s>|/?INST\]|/?ROLE\])"
CONFLICT = r"([<\[])(\\*)(?=" + CONTROL + ")"
BARE = r"[<\[]" + CONTROL
# What a role's name must not hold as it is; the escape itself is coded first and read last.
NAME_CODES = (("%", "%25"), (":", "%3A"), ("[", "%5B"), ("<", "%3C"))


def _render(role: Column, body: Column) -> Column:
    name = role
    for char, code in NAME_CODES:
        name = F.replace(name, F.lit(char), F.lit(code))
    return (
        F.when(role == "assistant", F.concat(F.lit("<s>"), body, F.lit("</s>")))
        .when(role == "user", F.concat(F.lit("[INST]"), body, F.lit("[/INST]")))
        .otherwise(F.concat(F.lit("[ROLE]"), name, F.lit(":"), body, F.lit("[/ROLE]")))
    )


TURN = r"(?s)^(?:<s>(.*?)</s>|\[INST\](.*?)\[/INST\]|\[ROLE\](.*?):(.*?)\[/ROLE\])$"


def _unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"([<\[])\\(?=\\*" + CONTROL + ")", "$1")


def parse_turn(segment: Column) -> tuple[Column, Column, Column]:
    """(role, text, whether the segment is one well-formed turn)."""
    opened = F.when(segment.startswith("<s>"), 1).when(segment.startswith("[INST]"), 2).otherwise(3)
    body = F.when(opened == 1, F.regexp_extract(segment, TURN, 1)).when(opened == 2, F.regexp_extract(segment, TURN, 2)).otherwise(F.regexp_extract(segment, TURN, 4))
    raw = F.regexp_extract(segment, TURN, 3)
    name = raw
    for char, code in reversed(NAME_CODES):
        name = F.replace(name, F.lit(code), F.lit(char))
    role = F.when(opened == 1, "assistant").when(opened == 2, "user").otherwise(name)
    # A turn is well formed if it matches as a whole and no bare control string is left in its body.
    return role, _unescape(body), segment.rlike(TURN) & ~body.rlike(BARE)


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, segment: the rendered turn, checked to parse back to its source.

    A conversation's formatted text is its segments in order, nothing between. They stay
    apart, so a conversation that holds a third of all rows is no single string or task.
    """
    src = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain = src.withColumn("_plain", _render(F.col("role"), F.col("text")))
    role, text, good = parse_turn(F.col("_plain"))
    same = good & (role == F.col("role")) & (text == F.col("text"))
    escaped = F.regexp_replace("text", CONFLICT, r"$1$2\\")
    tried = plain.withColumn("segment", F.when(same, F.col("_plain")).otherwise(_render(F.col("role"), escaped)))
    role, text, good = parse_turn(F.col("segment"))
    kept = good & (role == F.col("role")) & (text == F.col("text"))
    return tried.select("conv_id", "turn", "role", "text", F.when(kept, F.col("segment")).otherwise(F.raise_error(F.concat(F.lit("turn does not parse back: "), "segment"))).alias("segment"))


def loss_spans(turns: DataFrame) -> DataFrame:
    """Adds loss_start and loss_length, the loss mask: the code points of a segment that count (an assistant's body as written)."""
    mine = F.col("role") == "assistant"
    return turns.withColumn("loss_start", F.when(mine, 3)).withColumn("loss_length", F.when(mine, F.length("segment") - 7))


OPENERS = {"<s>": ("assistant", "</s>"), "[INST]": ("user", "[/INST]"), "[ROLE]": (None, "[/ROLE]")}
ESCAPED = re.compile(r"([<\[])\\(?=\\*" + CONTROL + ")")


class Reader:
    """Recovers (role, text) of the turns in a stream of characters that comes in pieces of any size."""

    def __init__(self) -> None:
        self.rest = ""

    def feed(self, piece: str) -> list[tuple[str, str]]:
        """The turns that end in this piece."""
        s, at, turns = self.rest + piece, 0, []
        while (turn := self._turn(s, at)) is not None:
            turns.append(turn[:2])
            at = turn[2]
        self.rest = s[at:]
        return turns

    @staticmethod
    def _turn(s: str, at: int) -> tuple[str, str, int] | None:
        """Role, text and end of the turn that begins here, None if it does not end yet."""
        for opener, (role, closer) in OPENERS.items():
            if not s.startswith(opener, at):
                continue
            begin = at + len(opener)
            if role is None:
                colon = s.find(":", begin)
                if colon < 0:
                    return None
                role, begin = s[begin:colon], colon + 1
                for char, code in reversed(NAME_CODES):
                    role = role.replace(code, char)
            end = s.find(closer, begin)
            return None if end < 0 else (role, ESCAPED.sub(r"\1", s[begin:end]), end + len(closer))
        if any(opener.startswith(s[at : at + len(opener)]) for opener in OPENERS):
            return None
        raise ValueError(f"no turn begins at {s[at : at + 40]!r}")


def turn_code(role: str, text: str) -> int:
    """What Spark's xxhash64(role, text) gives."""
    code = xxhash.xxh64_intdigest(text.encode(), xxhash.xxh64_intdigest(role.encode(), 42))
    return code - (1 << 64) if code >> 63 else code


def digests(turns: DataFrame) -> DataFrame:
    """By conversation, read back from the formatted text: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    ``turns`` has the loss mask as of ``loss_spans``; what counts for the loss is the text under it, unescaped. The text of a conversation is streamed in order through the reader and running hashes;
    no conversation is held in memory, however long.
    """
    read = turns.select("conv_id", "turn", "segment", F.xxhash64("role", "text").alias("code"), "loss_start", "loss_length")
    role, text, _ = parse_turn(F.col("segment"))  # only ties of conv_id and turn come to these
    ordered = read.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", role, text)
    return ordered.select("conv_id", "segment", "code", "loss_start", "loss_length").mapInArrow(_stream, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


class Conversation:
    """Running digests of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.reader, self.codes = conv_id, Reader(), deque()
        self.n = self.loss = self.size = 0
        self.turns, self.said = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, codes: list[int]) -> None:
        self.size += len(text)
        self.codes.extend(codes)
        for role, body in self.reader.feed(text):
            if not self.codes or turn_code(role, body) != self.codes.popleft():
                raise ValueError(f"turn {self.n} of conversation {self.conv_id} does not read back as its source")
            self.n += 1
            self.turns.update(f"{role}\n{body}\n".encode())

    def count(self, masked: str) -> None:
        """Text under the mask of one segment."""
        body = ESCAPED.sub(r"\1", masked)
        self.loss += len(body)
        self.said.update(body.encode())

    def row(self) -> tuple:
        if self.codes or self.reader.rest:
            raise ValueError(f"conversation {self.conv_id} does not end with a turn")
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss, self.said.hexdigest(), self.size


def _stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = {"conv_id": pa.int64(), "n_turns": pa.int64(), "turns_sha256": pa.string(), "loss_chars": pa.int64(), "loss_sha256": pa.string(), "formatted_chars": pa.int64()}
    now: Conversation | None = None

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds.values())], list(kinds))

    for batch in batches:
        ids, segments, codes, starts, lengths = (batch.column(c).to_pylist() for c in ("conv_id", "segment", "code", "loss_start", "loss_length"))
        out, at = [], 0
        while at < len(ids):
            end = at
            while end < len(ids) and ids[end] == ids[at]:
                end += 1
            if now is None or now.conv_id != ids[at]:
                if now is not None:
                    out.append(now.row())
                now = Conversation(ids[at])
            now.add("".join(segments[at:end]), codes[at:end])
            for i in range(at, end):
                if starts[i] is not None:
                    now.count(segments[i][starts[i] : starts[i] + lengths[i]])
            at = end
        yield table(out)
    if now is not None:
        yield table([now.row()])
