"""Operator 9, quality rules: weak supervision over simple rules.

Each rule votes good (1), bad (0) or abstains. Expectation-maximisation over the corpus estimates how often each rule is right for good and for bad
documents, and the posterior probability of "good" decides in place of all rules having to pass. The rules' votes are all that the estimate needs, and
there are at most 3 ** 9 different combinations, so what comes to the driver is one count for each combination that occurs.

A base check stands before it: fewer than 20 words, or more than 30 % of the words in repeated 8-word windows, fails.

Defined results: a null or empty text has no words and fails the base check; a null doc_id stays null; repeated rows count once each; with an empty
table there is nothing to estimate and no rows; other columns are ignored (features) or passed on (keep_good).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltgrain.llm.common import Scratch, slices, text_bytes
from siltgrain.llm.textops import Lines, Words, sums

MIN_WORDS, MAX_REPEATED, WINDOW = 20, 0.3, 8
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, votes string"
SYMBOL, UPPER, LETTER, STOP = (np.zeros(256, bool) for _ in range(4))
SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
UPPER[65:91] = True
LETTER[65:91] = LETTER[97:123] = True
STOP[[ord(c) for c in ".!?:;\"')"]] = True
#: name, bad below, good from, good to, bad above: between bad and good the rule abstains. Each is a share or a count, see measures().
RULES = (
    ("words", MIN_WORDS, 60, 100_000, 1e9),
    ("word_length", 2.0, 3.0, 9.0, 14.0),
    ("symbols_per_word", -1.0, -1.0, 0.02, 0.1),
    ("upper_share", -1.0, -1.0, 0.15, 0.4),
    ("shouts_per_word", -1.0, -1.0, 0.02, 0.1),
    ("stuttered_words", -1.0, -1.0, 0.05, 0.2),
    ("repeated_lines", -1.0, -1.0, 0.1, 0.5),
    ("repeated_windows", -1.0, -1.0, 0.05, MAX_REPEATED),
    ("closed_lines", 0.1, 0.5, 2.0, 3.0),
)


def count_texts(data: np.ndarray, offsets: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """(base counts of each text, votes as rows of 0: bad, 1: good, 2: abstains)."""
    words = Words(data, offsets)
    lines = Lines(words)
    n = np.diff(words.bounds)
    chars = np.zeros(len(words.starts), np.int64)
    if len(data):
        chars = sums(data & 0xC0 != 0x80, np.append(0, np.arange(len(data)) + 1))
        whole = np.concatenate([[0], np.cumsum(chars)])
        chars = whole[words.ends] - whole[words.starts]
    again = lines.again()
    repeated = words.covered(WINDOW)
    out = {
        "n_words": n,
        "word_chars": sums(chars, words.bounds),
        "n_symbols": sums(SYMBOL[data], offsets),
        "n_dup_lines": sums(again, lines.bounds),
        "n_repeat_words": sums(repeated, words.bounds),
    }
    stutter = np.zeros(len(words.starts), bool)
    stutter[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
    full = lines.words > 0
    closed = np.zeros(len(full), bool)
    closed[full] = STOP[data[words.ends[np.searchsorted(words.starts, lines.ends[full]) - 1] - 1]]
    some, n_lines = np.maximum(n, 1), np.maximum(sums(full, lines.bounds), 1)
    measures = (
        n,
        out["word_chars"] / some,
        out["n_symbols"] / some,
        sums(UPPER[data], offsets) / np.maximum(sums(LETTER[data], offsets), 1),
        sums(data == 33, offsets) / some,
        sums(stutter, words.bounds) / some,
        out["n_dup_lines"] / n_lines,
        out["n_repeat_words"] / some,
        sums(closed, lines.bounds) / n_lines,
    )
    votes = np.full((len(n), len(RULES)), 2, np.uint8)
    for i, (x, (_, below, low, high, above)) in enumerate(zip(measures, RULES, strict=True)):
        votes[(x >= low) & (x <= high), i] = 1
        votes[(x < below) | (x > above), i] = 0
    return out, votes


def base_failed(counts: dict[str, np.ndarray]) -> np.ndarray:
    return (counts["n_words"] < MIN_WORDS) | (counts["n_repeat_words"] > MAX_REPEATED * counts["n_words"])


def _as_strings(votes: np.ndarray) -> list[str]:
    return [row.tobytes().decode() for row in votes + 48]


def features(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the rules' votes (a digit each) of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for a, b in slices(offsets, 1 << 20):
                counts, votes = count_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column(0).slice(a, b - a).cast(pa.int64()), *(pa.array(counts[k], pa.int64()) for k in COUNTS), pa.array(_as_strings(votes))]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *COUNTS, "votes"])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def fit(votes: np.ndarray, weights: np.ndarray, rounds: int = 200) -> np.ndarray:
    """The posterior probability of "good" for each row of votes, after expectation-maximisation over all of them.

    Documents are good, or bad in the way that one of the rules is about: junk of one kind need not break the other rules, so one class of "bad" alone
    would take rules that fire on different junk for unreliable ones. Each rule has in each class a rate of calling a document bad when it votes, which
    is its accuracy there; abstentions say nothing. All rates are estimated, with no limits but one of order: no rule calls good documents bad more often
    than those of any bad class. So a rule whose calls keep off other rules' junk is right about its own, and one that fires alike on everything is
    unreliable. The first guess counts twice for good and once for each rule that calls a document bad; it decides where the votes show neither. Each
    rate starts from one made-up document.
    """
    fires, passes = (votes == 0).astype(float), (votes == 1).astype(float)
    p = np.column_stack([np.full(len(votes), 2.0), fires + 0.001])
    p /= p.sum(1, keepdims=True)
    for _ in range(rounds):
        by_class = p * weights[:, None]
        called, voted = by_class.T @ fires + 0.05, by_class.T @ (fires + passes) + 1
        rates = called / voted
        least = np.vstack([np.zeros((1, votes.shape[1]), int), np.argsort(rates[1:], 0) + 1])  # good, then the bad classes by their rates
        pooled = np.take_along_axis(called, least, 0).cumsum(0) / np.take_along_axis(voted, least, 0).cumsum(0)
        rates = np.maximum(rates, pooled.min(0))  # the most likely rates in that order: good takes in the classes below it
        rates[0] = pooled.min(0)
        odds = np.log(by_class.sum(0) + 0.1) + fires @ np.log(rates).T + passes @ np.log1p(-rates).T
        new = np.exp(odds - odds.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        moved, p = np.abs(new - p).max(initial=0), new
        if moved < 1e-9:
            break
    return p[:, 0]


def posteriors(votes: DataFrame) -> dict[str, float]:
    """Combination of votes -> probability of "good", from a table with a column votes. At most 3 ** len(RULES) counts come to the driver."""
    rows = sorted((r.votes, r["count"]) for r in votes.groupBy("votes").count().collect())
    if not rows:
        return {}
    matrix = np.array([[ord(c) - 48 for c in v] for v, _ in rows], np.uint8)
    found = fit(matrix, np.array([n for _, n in rows], float))
    return {v: float(p) for (v, _), p in zip(rows, found, strict=True)}


def judge(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """features() of each document, base_failed, quality (the posterior) and kept. Texts are read once; the counts wait in the shared folder."""
    spark = docs.sparkSession
    counted = Scratch(spark).table(features(docs), "features")
    known = spark.createDataFrame([*posteriors(counted).items()], "votes string, quality double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = counted.join(F.broadcast(known), "votes").withColumn("base_failed", failed)
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= threshold)).select("doc_id", *COUNTS, "base_failed", "kept", "quality", "votes")


def keep_good(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of docs that are kept, with all their columns; texts are read twice, so that they are never dealt out anew."""
    known, schema, at = posteriors(features(docs).select("votes")), docs.schema, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets, 1 << 20):
                counts, votes = count_texts(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                keep = ~base_failed(counts) & (np.array([known[v] for v in _as_strings(votes)]) >= threshold)
                yield batch.slice(a, b - a).filter(pa.array(keep))

    return docs.mapInArrow(run, schema)
