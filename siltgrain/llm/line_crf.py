"""Operator 3, quality classifier: a linear-chain conditional random field over the lines of a text.

Each line that holds a word is labelled good or bad. Its features are what shares of its words and characters lie in which range, for itself and for the
lines before and after it, so that a label also depends on its neighbourhood; the chain adds a weight for each pair of labels that follow one another.
A text's quality is the average of its lines' marginal probabilities of "good" by forward-backward, each weighted with the line's length in bytes.

Training maximises the conditional likelihood, a document's label holding for its lines. Only labels, of at most ``most_per_class`` documents of each
class (those with the smallest hashes), come to the driver with their texts.

Defined results: a text without words, null or empty ones among them, scores 0; a null doc_id stays null and counts as not held out; repeated rows are
scored once each; without labels of both classes every text with words scores 0.5; an empty table gives no rows; other columns are ignored (classify)
or passed on (keep_good).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siltgrain.llm.common import slices
from siltgrain.llm.labelled import kept, scored, training_rows
from siltgrain.llm.textops import Lines, Words, sums

#: Where each measure of a line is cut into ranges: one feature for each range.
RANGES = {
    "words": (1.5, 3.5, 7.5, 15.5, 40.5, 100.5),
    "word_bytes": (2, 3, 4, 5, 6, 8, 11, 16),
    "symbols_per_word": (0.005, 0.05, 0.2, 0.6, 1.2),
    "shouts_per_word": (0.005, 0.05, 0.2, 0.6),
    "upper_share": (0.005, 0.03, 0.1, 0.3, 0.6),
    "digit_share": (0.005, 0.03, 0.1, 0.3),
    "stops_per_word": (0.01, 0.05, 0.15, 0.3, 0.6),
    "stuttered_words": (0.005, 0.05, 0.2, 0.5),
    "repeated_words": (0.005, 0.1, 0.3, 0.6),
    "distinct_words": (0.1, 0.3, 0.5, 0.7, 0.9),
    "seen_before": (0.5,),
    "closed": (0.5,),
}
WIDTHS = [len(x) + 1 for x in RANGES.values()]
N_OWN = sum(WIDTHS)
#: One row of weights for the line itself, the one before and the one after; then first line, last line and bias.
N_FEATURES = 3 * N_OWN + 3
_SYMBOL, _UPPER, _DIGIT, _STOP, _LETTER = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[[ord(c) for c in "#*$%&|<>=_{}[]\\^~@+"]] = True
_UPPER[65:91] = True
_LETTER[65:91] = _LETTER[97:123] = True
_DIGIT[48:58] = True
_STOP[[ord(c) for c in ".,;:?"]] = True
Model = tuple[np.ndarray, np.ndarray]


class Chains:
    """The lines with words of some texts as chains: ranges[i] has the feature of each measure of line i; bounds: of the lines of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets)
        lines = Lines(words)
        full = np.flatnonzero(lines.words > 0)
        starts, ends = lines.starts[full], lines.ends[full]
        self.length = (ends - starts).astype(float)
        self.bounds = np.searchsorted(full, lines.bounds)
        first = np.searchsorted(words.starts, starts)
        n = lines.words[full]
        spans = np.concatenate([first, [len(words.starts)]])

        def of_bytes(mark: np.ndarray) -> np.ndarray:
            total = np.concatenate([[0], np.cumsum(mark)])
            return total[ends] - total[starts]

        stutter = np.zeros(len(words.starts), bool)
        stutter[1:] = (words.hashes[1:] == words.hashes[:-1]) & (words.text[1:] == words.text[:-1])
        line_of = np.repeat(np.arange(len(full)), n)
        keys = words.hashes ^ (line_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(keys, kind="stable")
        new = np.ones(len(keys), bool)
        new[order[1:]] = keys[order[1:]] != keys[order[:-1]]
        letters = np.maximum(of_bytes(_LETTER[data]), 1)
        measures = (
            n,
            sums((words.ends - words.starts).astype(float), spans) / n,
            of_bytes(_SYMBOL[data]) / n,
            of_bytes(data == 33) / n,
            of_bytes(_UPPER[data]) / letters,
            of_bytes(_DIGIT[data]) / np.maximum(self.length, 1),
            of_bytes(_STOP[data]) / n,
            sums(stutter, spans) / n,
            sums(words.covered(8), spans) / n,
            sums(new, spans) / n,
            lines.again()[full],
            _STOP[data[words.ends[first + n - 1] - 1]] if len(full) else np.zeros(0),
        )
        self.ranges = np.empty((len(full), len(measures)), np.int32)
        base = 0
        for i, (x, cut) in enumerate(zip(measures, RANGES.values(), strict=True)):
            self.ranges[:, i] = base + np.searchsorted(cut, np.asarray(x, float))
            base += len(cut) + 1

    @classmethod
    def of(cls, texts: list[bytes], most: int = 1 << 20) -> Chains:
        """The chains of many texts, some ``most`` bytes at a time, which bounds the memory that their hashes take."""
        offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
        parts = [cls(np.frombuffer(b"".join(texts[a:b]), np.uint8), offsets[a : b + 1] - offsets[a]) for a, b in slices(offsets, most)]
        out = cls.__new__(cls)
        out.ranges, out.length = (np.concatenate([getattr(p, name) for p in parts]) for name in ("ranges", "length"))
        out.bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(p.bounds) for p in parts]))])
        return out

    def ends_of_chains(self) -> tuple[np.ndarray, np.ndarray]:
        is_first, is_last = (np.zeros(len(self.ranges), bool) for _ in range(2))
        some = self.bounds[1:] > self.bounds[:-1]
        is_first[self.bounds[:-1][some]] = True
        is_last[self.bounds[1:][some] - 1] = True
        return is_first, is_last

    def scores(self, weights: np.ndarray) -> np.ndarray:
        """The weight of "good" over "bad" of each line by itself."""
        is_first, is_last = self.ends_of_chains()
        own, before, after = (weights[i * N_OWN : (i + 1) * N_OWN][self.ranges].sum(1) for i in range(3))
        out = own + weights[-1]
        out[1:] += np.where(is_first[1:], 0, before[:-1])
        out[:-1] += np.where(is_last[:-1], 0, after[1:])
        return out + is_first * weights[-3] + is_last * weights[-2]

    def gradient(self, per_line: np.ndarray) -> np.ndarray:
        """Of the weights, from that of each line's score."""
        is_first, is_last = self.ends_of_chains()
        out = np.zeros(N_FEATURES)
        k = self.ranges.shape[1]
        out[:N_OWN] = np.bincount(self.ranges.ravel(), np.repeat(per_line, k), N_OWN)
        follows, precedes = np.flatnonzero(~is_first), np.flatnonzero(~is_last)
        out[N_OWN : 2 * N_OWN] = np.bincount(self.ranges[follows - 1].ravel(), np.repeat(per_line[follows], k), N_OWN)
        out[2 * N_OWN : 3 * N_OWN] = np.bincount(self.ranges[precedes + 1].ravel(), np.repeat(per_line[precedes], k), N_OWN)
        out[-3:] = per_line[is_first].sum(), per_line[is_last].sum(), per_line.sum()
        return out


def marginals(scores: np.ndarray, bounds: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability of "good" of each line, expected number of each pair of labels, log of the partition functions' product) by forward-backward.

    All chains step together, the longest first, so that those that have ended fall away at the end. pairs[a, b]: weight of label b after label a.
    """
    counts = np.diff(bounds)
    order = np.argsort(-counts, kind="stable")
    counts, first = counts[order], bounds[:-1][order]
    longest = int(counts[0]) if len(counts) else 0
    active = np.searchsorted(-counts, -np.arange(longest), "left")
    alpha = np.zeros((len(scores), 2))
    beta = np.zeros((len(scores), 2))
    node = np.column_stack([np.zeros_like(scores), scores])
    for t in range(longest):
        at = first[: active[t]] + t
        if t:
            into = alpha[at - 1][:, :, None] + pairs
            alpha[at] = np.logaddexp(into[:, 0], into[:, 1]) + node[at]
        else:
            alpha[at] = node[at]
    expected = np.zeros((2, 2))
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        out = pairs + (node[at + 1] + beta[at + 1])[:, None, :]
        beta[at] = np.logaddexp(out[:, :, 0], out[:, :, 1])
    total = alpha + beta
    whole = np.logaddexp(total[:, 0], total[:, 1])
    inner = np.ones(len(scores), bool)
    inner[bounds[1:][np.diff(bounds) > 0] - 1] = False
    at = np.flatnonzero(inner)
    if len(at):
        joint = alpha[at][:, :, None] + pairs + (node[at + 1] + beta[at + 1])[:, None, :] - whole[at][:, None, None]
        expected = np.exp(joint).sum(0)
    starts = bounds[:-1][np.diff(bounds) > 0]
    return np.exp(total[:, 1] - whole), expected, float(whole[starts].sum())


def train(chains: Chains, labels: np.ndarray, rounds: int = 150, rate: float = 0.1, decay: float = 0.5) -> Model:
    """(weights, pair weights) of the greatest likelihood less decay / 2 times their squares, by gradient ascent with adapted steps (Adam)."""
    counts = np.diff(chains.bounds)
    y = np.repeat(labels, counts).astype(float)
    seen = np.zeros((2, 2))
    for label in (0, 1):
        seen[label, label] = np.maximum(counts[labels == label] - 1, 0).sum()
    x = np.zeros(N_FEATURES + 4)
    mean, square = np.zeros_like(x), np.zeros_like(x)
    scale = 1 / max(1, len(y))
    for step in range(1, rounds + 1):
        p, expected, _ = marginals(chains.scores(x[:-4]), chains.bounds, x[-4:].reshape(2, 2))
        g = (np.concatenate([chains.gradient(y - p), (seen - expected).ravel()]) - decay * x) * scale
        mean, square = 0.9 * mean + 0.1 * g, 0.99 * square + 0.01 * g * g
        x = x + rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return x[:-4], x[-4:].reshape(2, 2)


def score(data: np.ndarray, offsets: np.ndarray, model: Model) -> np.ndarray:
    """The quality of each text."""
    chains = Chains(data, offsets)
    good, _, _ = marginals(chains.scores(model[0]), chains.bounds, model[1])
    return sums(good * chains.length, chains.bounds) / np.maximum(sums(chains.length, chains.bounds), 1e-9)


def model_of(docs: DataFrame, labels: DataFrame, most_per_class: int = 1000) -> Model:
    """Trained on the labelled documents that are not held out; see labelled.training_rows()."""
    rows = training_rows(docs, labels, "quality", most_per_class)
    y = np.array([label for label, _ in rows])
    if len(set(y.tolist())) < 2:
        return np.zeros(N_FEATURES), np.zeros((2, 2))
    return train(Chains.of([t.encode() for _, t in rows]), y)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_per_class: int = 1000) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    model = model_of(docs, labels, most_per_class)
    return scored(docs, lambda data, offsets: score(data, offsets, model), threshold)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_per_class: int = 1000) -> DataFrame:
    """The rows of docs whose quality is at least threshold, with all their columns."""
    model = model_of(docs, labels, most_per_class)
    return kept(docs, lambda data, offsets: score(data, offsets, model), threshold)
