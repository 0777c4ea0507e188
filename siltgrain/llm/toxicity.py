"""Operator 1, toxicity: subword bags, averaged embeddings and a linear softmax, trained jointly in numpy.

Each word is the bag of its character 3- to 5-grams with its boundaries and of itself, all hashed into one table of embeddings; a word's vector is their
average, so an unseen spelling shares the vectors of the pieces that it keeps. The vectors of a text's distinct words in a window average into its vector, and a
linear softmax over that gives its class. A text has windows of ``WINDOW`` words, half overlapping, and is as toxic as its most toxic window, in
training as in scoring: a few words in a long text are not averaged away. After training each n-gram's vector and the softmax fold into one number.

Training takes a fixed number of steps, whatever the number of texts, so that few labels are gone over more often. Only labels, of at most ``most_per_class`` documents of each class (those with the smallest hashes), come to the driver with their texts.

Defined results: a null or empty text has no words and scores as the bias alone does; a null doc_id stays null and counts as not held out; repeated
rows are scored once each; without labels of both classes every score is 0; an empty table gives no rows; other columns are ignored. A very long text is
scored whole, by one task that holds it with the n-grams of its distinct words.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from siltgrain.llm.common import ragged
from siltgrain.llm.labelled import scored, training_rows
from siltgrain.llm.textops import LOWER, Hashes, cuts, owner, salted

BUCKETS = 20  # bits
#: Training texts that an n-gram must occur in to be learnt: so many, or this share of them if that is more. What a few texts have says nothing of others.
LEAST_TEXTS, LEAST_SHARE = 3, 1 / 200
GRAMS = (3, 4, 5)
WINDOW = 6
_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not (chr(i).isalnum())]] = 32


def fold(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower case for ASCII and Latin-1 letters, a space for other ASCII than letters and digits, and a space around each text."""
    n = len(offsets) - 1
    out = np.full(len(data) + n + 1, 32, np.uint8)
    at = np.arange(len(data)) + np.repeat(np.arange(1, n + 1), np.diff(offsets))
    out[at] = _FOLD[data]
    upper = np.flatnonzero((out[:-1] == 0xC3) & (out[1:] >= 0x80) & (out[1:] <= 0x9E) & (out[1:] != 0x97)) + 1
    out[upper] += 32
    return out, offsets + np.arange(n + 1)


class Bags:
    """The n-grams of the distinct words of some texts: gram[i] belongs to word word[i]; bounds: of the words of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data, offsets = fold(data, offsets)
        letter = data != 32
        starts, ends = cuts(letter, np.array([0, len(data)]))
        spans, shift = Hashes(data), np.uint64(64 - BUCKETS)
        hashes = spans.of(starts, ends)
        first = np.sort(np.unique(salted(hashes, owner(starts, offsets)), return_index=True)[1])  # a text's distinct words, as they first come
        starts, ends, hashes = starts[first], ends[first], hashes[first]
        self.bounds = np.searchsorted(starts, offsets)
        sizes, number = ends - starts, np.arange(len(starts))
        grams, words = [hashes], [number]
        for n in GRAMS:
            count = np.maximum(sizes + 3 - n, 0)  # with the space on either side
            at = ragged(starts - 1, count)
            grams.append(spans.of(at, at + n))
            words.append(np.repeat(number, count))
        self.gram = (np.concatenate(grams) >> shift).astype(np.int64)
        self.word = np.concatenate(words)
        self.size = np.bincount(self.word, minlength=len(starts)).astype(np.float32)


def windows(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last word) of each window, within texts of so many words; a text has at least one."""
    half = WINDOW // 2
    n = np.maximum(1, -(-(counts - half) // half))
    text = np.repeat(np.arange(len(counts)), n)
    first = half * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return text, first, np.minimum(first + WINDOW, counts[text])


def train(texts: list[str], labels: np.ndarray, size: int = 8, updates: int = 3400, batch: int = 16, rate: float = 0.02, decay: float = 0.05, toxic_weight: float = 7 / 3, seed: int = 7) -> tuple[np.ndarray, float]:
    """(number of each n-gram, bias): the difference of the classes' logits. The most toxic window of each text, as it then stands, takes the gradient.

    toxic_weight: of a toxic text against another. With 7 / 3, what is as likely as not for classes of one size scores 0.7.
    """
    rng = np.random.default_rng(seed)
    raw = [t.encode() for t in texts]
    parts, pairs = [], []
    for i in range(0, len(raw), batch):
        some = raw[i : i + batch]
        bags = Bags(np.frombuffer(b"".join(some), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in some])]))
        text, first, last = windows(np.diff(bags.bounds))
        order = np.argsort(bags.word, kind="stable")
        parts.append((labels[i : i + batch], bags.gram[order], bags.word[order], bags.size, text, bags.bounds[text] + first, bags.bounds[text] + last))
        pairs.append(np.unique(owner(bags.word, bags.bounds) << BUCKETS | bags.gram) & ((1 << BUCKETS) - 1))
    learnt = np.flatnonzero(np.bincount(np.concatenate(pairs), minlength=1 << BUCKETS) >= max(LEAST_TEXTS, LEAST_SHARE * len(texts)))
    number = np.full(1 << BUCKETS, -1, np.int32)
    number[learnt] = np.arange(len(learnt))
    n = len(learnt)
    for i, (y, gram, word, sizes, *rest) in enumerate(parts):
        gram = number[gram]
        keep = gram >= 0
        parts[i] = y, gram[keep], np.bincount(word[keep], minlength=len(sizes)), sizes, *rest
    vectors = rng.normal(0, 0.1, (n, size)).astype(np.float32)
    softmax = np.stack([-np.ones(size), np.ones(size)]).astype(np.float32) * 0.5
    params = [vectors, softmax, np.zeros(2, np.float32)]
    means, squares = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    rounds = -(-updates // len(parts))
    for round_ in range(rounds):
        for k in rng.permutation(len(parts)):
            y, gram, kept, sizes, text, first, last = parts[k]
            if not len(gram):
                continue
            vectors, softmax, bias = params
            flat = vectors @ (softmax[1] - softmax[0])
            by_gram = np.concatenate([[0.0], np.cumsum(flat[gram], dtype=np.float64)])
            ends = np.cumsum(kept)
            word_sum = (by_gram[ends] - by_gram[ends - kept]) / sizes
            total = np.concatenate([[0.0], np.cumsum(word_sum, dtype=np.float64)])
            logit = (total[last] - total[first]) / np.maximum(last - first, 1)
            best = np.lexsort((logit, text))[np.concatenate([np.flatnonzero(np.diff(text)), [len(text) - 1]])]
            z = logit[best] + bias[1] - bias[0]
            error = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) * np.where(y == 1, np.float32(toxic_weight), np.float32(1)) / len(y)
            weight = np.zeros(len(sizes) + 1, np.float32)
            share = error / np.maximum(last[best] - first[best], 1)
            np.add.at(weight, first[best], share)
            np.add.at(weight, last[best], -share)
            of_word = np.cumsum(weight[:-1]) / sizes
            of_word[np.abs(of_word) < 1e-9] = 0
            per_gram = np.repeat(of_word, kept)
            used = np.flatnonzero(per_gram)
            push = np.bincount(gram[used], per_gram[used], minlength=n).astype(np.float32)  # the gradient of each n-gram's number
            touched = np.flatnonzero(push)
            towards = push[touched] @ vectors[touched]
            grads = [push[:, None] * (softmax[1] - softmax[0]), np.stack([-towards, towards]), np.array([-error.sum(), error.sum()])]
            step += 1
            for p, g, m, s in zip(params, grads, means, squares, strict=True):
                m *= 0.9
                m += 0.1 * g
                s *= 0.99
                s += 0.01 * g * g
                now = rate * (1 - round_ / (rounds + 1))
                if p.ndim == 2:
                    p *= 1 - now * decay
                p -= (now * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    vectors, softmax, bias = params
    numbers = np.zeros(1 << BUCKETS, np.float32)
    numbers[learnt] = vectors @ (softmax[1] - softmax[0])
    return numbers, float(bias[1] - bias[0])


def score(data: np.ndarray, offsets: np.ndarray, numbers: np.ndarray, bias: float) -> np.ndarray:
    """The probability of "toxic" of each text."""
    bags = Bags(data, offsets)
    of_word = np.bincount(bags.word, numbers[bags.gram], minlength=len(bags.size)) / np.maximum(bags.size, 1)
    total = np.concatenate([[0.0], np.cumsum(of_word)])
    counts = np.diff(bags.bounds)
    text, first, last = windows(counts)
    logit = (total[bags.bounds[text] + last] - total[bags.bounds[text] + first]) / np.maximum(last - first, 1)
    best = np.maximum.reduceat(logit, np.flatnonzero(np.diff(text, prepend=-1))) if len(text) else np.zeros(0)
    return 1 / (1 + np.exp(-np.clip(best + bias, -50, 50)))


def model_of(docs: DataFrame, labels: DataFrame, most_per_class: int = 1500) -> tuple[np.ndarray, float]:
    """Trained on the labelled documents that are not held out; see training_rows()."""
    rows = training_rows(docs, labels, "toxic", most_per_class)
    if len({y for y, _ in rows}) < 2:
        return np.zeros(1 << BUCKETS, np.float32), -50.0
    return train([t for _, t in rows], np.array([y for y, _ in rows]))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, most_per_class: int = 1500) -> DataFrame:
    """One row for each document: doc_id, held_out, score, predicted."""
    numbers, bias = model_of(docs, labels, most_per_class)
    model = docs.sparkSession.sparkContext.broadcast((numbers, bias))  # 2 ** BUCKETS numbers at any size of the input
    return scored(docs, lambda data, offsets: score(data, offsets, *model.value), threshold)
