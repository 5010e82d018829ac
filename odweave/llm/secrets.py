"""Secret scans, in DataFrame functions alone.

Three patterns give the base spans. A second method reads every other token of 8
characters or more (as many as the base asks of an assigned value) under two
character Markov models, one of random strings and one of ordinary tokens, both
trained from labelled samples, and adds the tokens whose log-likelihood ratio is
high: in sum, so that short tokens have to be the clearer ones, and a character, so
that long ordinary ones do not add up. No rule on the kinds of characters comes first.

Spans are in code points, end exclusive. Null and empty texts have none. Texts
are read whole, however long; repeated rows, and rows without a doc_id, are scanned one by one; columns of the input beside
doc_id and text are not looked at; an empty table gives an empty result. A text
without a match costs one pass of each pattern and nothing else.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doubles_literal

# The base patterns. Letters of the key words count in either case, ASCII only.
KEYS = "(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
ASSIGN = KEYS + r"""["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_HEAD = KEYS + r"""["']?\x20*[:=]\x20*["']?"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ("assign", "access", "hex", "markov")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 8, 16, 32

#: Characters of the models; all others are one more class.
ALPHABET = string.ascii_letters + string.digits + "+/=_-"
CLASSES = len(ALPHABET) + 1
#: Tokens that the models read, and the nats in sum and a character from which a token counts as random.
TOKEN = "[A-Za-z0-9+/_=-]{8,}"
NATS, RATIO = 14.0, 0.5
PRIOR = 0.5  # what each pair of characters counts beforehand
SAMPLES = 4000  # made strings of each kind
TRUSTED_DOCS = 2000  # documents, least by hash of those given as ordinary, whose distinct tokens are samples of ordinary ones

# Parts of ordinary identifiers, for the sample of non-secrets.
PARTS = (
    "get set is has on to from with user name value index count list map item node tree graph table column row key path file data text line word token id "
    "time date start end min max sum mean total batch queue task job stage worker server client request response header body parse format write read open "
    "close update delete insert select filter group order join merge split test config option default error result message event handler manager service"
).split()


def labelled_samples(spark: SparkSession, n: int = SAMPLES) -> DataFrame:
    """text, is_random: ``n`` random strings of six alphabets and several lengths, made from digests, and ``n`` ordinary ones: identifiers of the usual spellings, numbers, rules of one character."""
    ids = spark.range(n)
    h = lambda i, m: F.pmod(F.xxhash64(F.lit(i), "id"), F.lit(m)).cast("int")
    words = F.split(F.lit(" ".join(PARTS)), " ")
    part = lambda i: F.get(words, h(i, len(PARTS)))
    number = h(9, 3000).cast("string")
    names = F.get(
        F.array(
            F.concat_ws("_", part(1), part(2), part(3), part(4), number), F.concat(part(1), F.initcap(part(2)), F.initcap(part(3)), F.initcap(part(4)), number),
            F.concat_ws("-", part(1), part(2), number, part(3)), F.concat_ws("/", part(1), part(2), part(3), F.concat(part(4), number)),
            F.upper(F.concat_ws("_", part(1), part(2), part(3))), F.concat(part(1), part(2), part(3), number),
            F.concat_ws("-", F.lit(1970) + h(5, 80), F.lpad(F.lit(1) + h(6, 12), 2, "0"), F.lpad(F.lit(1) + h(7, 28), 2, "0")),
            F.substring(F.concat(*[F.abs(F.xxhash64(F.lit(k), "id")) for k in (5, 6)]), F.lit(1), F.lit(8) + h(7, 13)),
            F.repeat(F.substring(F.lit("=-_/+x0"), F.lit(1) + h(5, 7), F.lit(1)), F.lit(8) + h(6, 40)),
        ),
        F.pmod("id", F.lit(9)).cast("int"),
    )
    alphabets = F.array(*[F.lit(x) for x in (
        string.ascii_letters + string.digits + "+/", string.ascii_letters + string.digits, string.ascii_letters,
        string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits, string.ascii_lowercase,
    )])
    letter = lambda i: F.substring(F.col("of"), F.lit(1) + F.pmod(F.xxhash64(i, "id"), F.length("of")).cast("int"), F.lit(1))
    strings = ids.withColumn("of", F.get(alphabets, F.pmod("id", F.lit(6)).cast("int"))).select(
        F.array_join(F.transform(F.sequence(F.lit(1), F.lit(16) + h(8, 28)), letter), "").alias("text"), F.lit(True).alias("is_random"),
    )
    return strings.unionByName(ids.select(names.alias("text"), F.lit(False).alias("is_random")))


def trusted_samples(docs: DataFrame, ids: DataFrame, n: int = TRUSTED_DOCS) -> DataFrame:
    """text, is_random: the distinct tokens, base spans left out, of the ``n`` documents that are least by hash among ``ids`` (doc_id)."""
    some = ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    text = F.coalesce("text", F.lit(""))
    for pattern in (ASSIGN, "AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), "[0-9a-f]{%d,}" % MIN_HEX):
        text = F.regexp_replace(text, pattern, " ")
    tokens = docs.join(F.broadcast(some), "doc_id", "left_semi").select(F.explode(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))).alias("text"))
    return tokens.distinct().withColumn("is_random", F.lit(False))


def _class(c: str) -> str:
    return f"(case when ascii({c}) < 128 then get({_CODES}, ascii({c})) else 0 end)"


_CODES = doubles_literal([ALPHABET.find(chr(i)) + 1 for i in range(128)]).replace("array<double>", "array<int>")


def _pairs(text: str) -> str:
    """SQL: indexes of a string's neighbouring characters in the table of the models."""
    return f"aggregate(array(transform(split({text}, ''), c -> {_class('c')})), cast(array() as array<int>), (a, k) -> transform(sequence(1, size(k) - 1), i -> k[i - 1] * {CLASSES} + k[i]))"


def train(samples: DataFrame) -> list[float]:
    """Log ratio of the transition probabilities, random over ordinary, by pair of character classes; at most CLASSES squared rows reach the driver."""
    pairs = samples.where("length(text) >= 2").select("is_random", F.explode(F.expr(_pairs("text"))).alias("pair"))
    rows = pairs.groupBy("pair").agg(F.count_if("is_random").alias("r"), F.count_if(~F.col("is_random")).alias("o")).collect()
    table = {k: [PRIOR] * (CLASSES * CLASSES) for k in "ro"}
    for row in rows:
        table["r"][row["pair"]] += row["r"]
        table["o"][row["pair"]] += row["o"]
    out = []
    for c in range(CLASSES):
        r, o = (table[k][c * CLASSES : (c + 1) * CLASSES] for k in "ro")
        out += [math.log(x / sum(r)) - math.log(y / sum(o)) for x, y in zip(r, o, strict=True)]
    return out


#: Matches of a text whose places are told in one fold; the folds' own first places are told in another.
FOLD = 256


def spans(text: str, pattern: str, kind: int, good: str) -> str:
    """SQL: spans of the leftmost, non-overlapping matches for which ``good`` (of the match m) holds.

    The pieces between the matches and the matches alternate, so the places are running sums of their lengths. They are told
    FOLD matches at a time: an array that grows by one element is copied, so a single fold would cost the square of the matches.
    """
    q = pattern.replace("\\", "\\\\").replace("'", "\\'")
    none = "cast(array() as array<struct<start: int, kind: int, end: int>>)"
    long = "length(x.p) + coalesce(length(x.m), 0)"
    bind = lambda value, zero, name, body: f"aggregate(array({value}), cast(null as {zero}), (_n, {name}) -> {body})"
    pairs = f"zip_with(split({text}, '{q}', -1), regexp_extract_all({text}, '{q}', 0), (p, m) -> struct(p as p, m as m))"
    parts = f"transform(sequence(0, (size(y) - 1) div {FOLD}), b -> slice(y, cast(b * {FOLD} + 1 as int), {FOLD}))"
    starts = f"aggregate(z, array(0), (s, g) -> array_append(s, element_at(s, -1) + aggregate(g, 0, (n, x) -> n + {long})))"
    of_part = f"""aggregate(g, struct({none} as s, at as at), (acc, x) -> struct(
          if(x.m is not null and {good}, array_append(acc.s, struct(acc.at + length(x.p) as start, {kind} as kind, acc.at + length(x.p) + length(x.m) as end)), acc.s) as s,
          acc.at + {long} as at), acc -> acc.s)"""
    kind_of = "array<struct<start: int, kind: int, end: int>>"
    told = f"flatten(zip_with(z, slice({starts}, 1, size(z)), (g, at) -> {of_part}))"
    return bind(pairs, kind_of, "y", bind(parts, kind_of, "z", told))


def scan(docs: DataFrame, ratios: list[float], nats: float = NATS, least: float = RATIO) -> DataFrame:
    """doc_id, base and added: arrays of (start, kind, end), sorted; kind indexes KINDS."""
    q = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    none = "cast(array() as array<struct<start: int, kind: int, end: int>>)"
    table = doubles_literal(ratios)
    gated = lambda gate, sql: F.expr(f"if(text rlike '{q(gate)}', {sql}, {none})")
    long_value = f"length(regexp_replace(x.m, '^{q(ASSIGN_HEAD)}', '')) >= {MIN_ASSIGN}"
    ratio = f"aggregate({_pairs('x.m')}, 0.0D, (a, b) -> a + get({table}, b))"
    random_token = f"{ratio} >= greatest({nats}, {least} * (length(x.m) - 1))"
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id",
        gated(ASSIGN.removesuffix("+") + "{%d,}" % MIN_ASSIGN, spans("text", ASSIGN, 0, long_value)).alias("assign"),
        gated("AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), spans("text", ACCESS, 1, f"length(x.m) >= {MIN_ACCESS}")).alias("access"),
        gated("[0-9a-f]{%d,}" % MIN_HEX, spans("text", HEX, 2, f"length(x.m) >= {MIN_HEX}")).alias("hex"),
        gated(TOKEN, spans("text", TOKEN, 3, random_token)).alias("tokens"),
    )
    return found.select(
        "doc_id",
        F.sort_array(F.concat("assign", "access", "hex")).alias("base"),
        F.expr("filter(tokens, t -> not exists(concat(assign, access, hex), b -> b.start < t.end and t.start < b.end))").alias("added"),
    )


def _joined(column: str) -> Column:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"concat_ws(',', transform({column}, s -> concat(array({names})[s.kind], ':', s.start, ':', s.end)))")


def secrets(docs: DataFrame, samples: DataFrame | None = None, nats: float = NATS, least: float = RATIO) -> DataFrame:
    """One row a row of ``docs``: doc_id, base and added spans, counts by kind, digest of the base spans, all spans as text."""
    ratios = train(labelled_samples(docs.sparkSession) if samples is None else samples)
    of = lambda k: F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)")
    return scan(docs, ratios, nats, least).select(
        "doc_id", "base", "added",
        of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.size("added").cast("long").alias("n_markov"),
        F.sha2(_joined("base"), 256).alias("base_sha256"),
        _joined("sort_array(concat(base, added))").alias("spans"),
    )
