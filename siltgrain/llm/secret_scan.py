"""Operator 8, secret scans, in DataFrame functions only.

Base kinds are patterns: ``assign`` (a keyword, = or :, a value of 6 or more), ``access`` (AKIA and 16 or more) and ``hex`` (24 or more hexadecimal
digits). The method adds the kind ``entropy``: over each candidate string, a run of 20 or more characters of the base-64 alphabets with a letter and a
digit, a window slides; the sum of n log n over the counts of its characters is kept up as one character enters and one leaves, which gives the window's
Shannon entropy. A candidate is reported if its greatest entropy reaches the threshold of its character class (hexadecimal or wider) and no
allow-list pattern matches it or the text just before it. Spans are in code points, end exclusive.

A text without a match of a pattern costs one search for it; only texts with one are cut up. There is no shuffle, so a lost task is simply run again.

Defined results: a null text counts as empty and has no spans (redact leaves it null); a null doc_id stays null; repeated rows are scanned once each; an
empty table gives no rows; other columns are ignored (scan) or passed on (redact).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "entropy")
# The base patterns. A run of hexadecimal digits or of an access key is matched as a whole, so its least length can stand in the pattern;
# a value that is too short still uses up its text, so that of ``assign`` can't.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
#: Finds texts that may hold a candidate: only runs with a digit, each tried once.
MAY_HOLD = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_=-]{20,}+"
LEAST_VALUE, WINDOW = 6, 20
#: n log n of one more than n, less that of n; places that are appended to one array before a next one is begun.
STEPS = [(n + 1) * math.log2(n + 1) - (n * math.log2(n) if n else 0.0) for n in range(WINDOW)]
RUN = 256
#: Bits a character of a window, for hexadecimal candidates and for others.
HEX_BITS, WIDE_BITS = 2.9, 3.7
#: Values that are no secrets, and what stands before digests that are none.
ALLOWED = r"(?i)example|sample|placeholder|dummy|changeme|xxxx|0123456789|123456789|abcdefgh|^[0-9+/_=-]+$|^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ALLOWED_BEFORE = r"(?i)(sha-?[0-9]*|md5|crc32|checksum|digest|commit|revision|etag|integrity|uuid)[\"']?[\x20:=-]*[\"']?$"
MARK = "[SECRET]"


def _places(text: Column, pattern: str) -> Column:
    """Array of (start, end, value, before) of the pattern's matches, leftmost and non-overlapping; before: the text since the last match, its end. Places
    are appended to runs of RUN, and the runs joined, so the copying grows with the number of matches, not with its square."""
    kind = "array<struct<start:int,end:int,value:string,before:string>>"

    def found(pieces: Column, values: Column) -> Column:
        def step(state: Column, i: Column) -> Column:
            piece, value = F.get(pieces, i), F.get(values, i)
            start = state.at + F.length(piece)
            place = F.struct(start.alias("start"), (start + F.length(value)).alias("end"), value.alias("value"), F.right(piece, F.lit(24)).alias("before"))
            return F.struct((start + F.length(value)).alias("at"), F.array_append(state.found, place).alias("found"))

        def run(runs: Column, first: Column) -> Column:
            start = F.struct(F.coalesce(F.get(runs, F.size(runs) - 1).at, F.lit(0)).alias("at"), F.array().cast(kind).alias("found"))
            return F.array_append(runs, F.aggregate(F.sequence(first, F.least(first + RUN, F.size(values)) - 1), start, step))

        runs = F.aggregate(F.sequence(F.lit(0), F.size(values) - 1, F.lit(RUN)), F.array().cast(f"array<struct<at:int,found:{kind}>>"), run)
        return F.flatten(F.transform(runs, lambda r: r.found))

    # Wrapped in an array, so that the text is cut up once, not once for each place.
    cut = F.struct(F.split(text, pattern, -1).alias("pieces"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("values"))
    once = F.get(F.transform(F.array(cut), lambda c: found(c["pieces"], c["values"])), F.lit(0))
    return F.when(text.rlike(pattern), once).otherwise(F.array().cast(kind))


def _greatest_entropy(value: Column) -> Column:
    """The greatest Shannon entropy of the windows of an ASCII string. The sum of n log n over a window's characters is kept up as one character enters and
    one leaves: STEPS has what it gains where a character is already there n times, and the count of that one character is all a step needs."""
    steps = F.array(*map(F.lit, STEPS))

    def gain(char: Column, others: Column) -> Column:
        return F.get(steps, F.length(others) - F.length(F.replace(others, char, F.lit(""))))

    def step(state: Column, i: Column) -> Column:
        entered = state.total + gain(F.substring(value, i + 1, F.lit(1)), F.substring(value, F.greatest(i - WINDOW + 2, F.lit(1)), F.least(i, F.lit(WINDOW - 1))))
        left = gain(F.substring(value, i - WINDOW + 2, F.lit(1)), F.substring(value, i - WINDOW + 3, F.lit(WINDOW - 1)))
        full = i >= WINDOW - 1
        return F.struct(F.when(full, entered - left).otherwise(entered).alias("total"), F.when(full, F.least(state.least, entered)).otherwise(state.least).alias("least"))

    first = F.struct(F.lit(0.0).alias("total"), F.lit(WINDOW * math.log2(WINDOW)).alias("least"))
    return math.log2(WINDOW) - F.aggregate(F.sequence(F.lit(0), F.length(value) - 1), first, step).least / WINDOW


def _secretive(place: Column) -> Column:
    value = place["value"]
    bits = F.when(value.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(HEX_BITS)).otherwise(F.lit(WIDE_BITS))
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    return F.when(mixed & ~value.rlike(ALLOWED) & ~place.before.rlike(ALLOWED_BEFORE), _greatest_entropy(value) >= bits).otherwise(F.lit(False))


def spans(text: Column) -> Column:
    """Array of (start, kind, end) of all spans of a text, in order of start and kind; kind: its place in KINDS."""
    text = F.coalesce(text, F.lit(""))

    def of(kind: int, places: Column) -> Column:
        return F.transform(places, lambda p: F.struct(p.start.alias("start"), F.lit(kind).alias("kind"), p.end.alias("end")))

    none = F.array().cast("array<struct<start:int,end:int,value:string,before:string>>")
    assign = F.filter(_places(text, ASSIGN), lambda p: F.length(F.regexp_extract(p["value"], ASSIGN, 2)) >= LEAST_VALUE)
    entropy = F.when(text.rlike(MAY_HOLD), F.filter(_places(text, CANDIDATE), _secretive)).otherwise(none)
    return F.array_sort(F.concat(of(0, assign), of(1, _places(text, ACCESS)), of(2, _places(text, HEX)), of(3, entropy)))


def _joined(found: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(names, s.kind), s.start, s.end)), ",")


def scan(docs: DataFrame) -> DataFrame:
    """One row for each document: doc_id, the number of spans of each kind, spans, and the SHA-256 of the base ones."""
    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), spans(F.col("text")).alias("found"))

    def of_kind(k: int) -> Column:
        return F.size(F.filter("found", lambda s: s.kind == k)).cast("bigint")

    counts = [of_kind(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    base = F.filter("found", lambda s: s.kind < 3)
    return found.select("doc_id", *counts[:3], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("found")).alias("spans"), counts[3])


def redact(docs: DataFrame, mark: str = MARK) -> DataFrame:
    """docs with each run of overlapping spans in text replaced by mark; n_chars, if there is one, follows where a text changed."""
    text = F.col("text")

    def step(state: Column, s: Column) -> Column:
        new = F.concat(state.out, F.substring(text, state.at + 1, s.start - state.at), F.lit(mark))
        out = F.when(s.start >= state.at, new).otherwise(state.out)
        return F.struct(F.greatest(state.at, s.end).alias("at"), out.alias("out"))

    found = F.col("__spans")
    clean = F.aggregate(found, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step, lambda s: F.concat(s.out, F.substring(text, s.at + 1, F.length(text))))
    changed = text.isNotNull() & (F.size(found) > 0)
    out = docs.withColumn("__spans", spans(text)).withColumn("__clean", F.when(changed, clean))
    columns = [F.coalesce("__clean", text).alias("text") if c == "text" else F.when(F.col("__clean").isNotNull(), F.length("__clean").cast(docs.schema[c].dataType)).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns)
