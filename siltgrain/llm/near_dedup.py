"""Operator 6, near-duplicates: improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard similarity.

A text is the set of its 5-word shingles (one shingle of all its words if it has fewer), ASCII letters in lower case. A shingle's weight is
(1 + ln tf) * idf with tf its count in the text and idf = 1 + IDF_SHARE * ln(N / df) / ln N: damped, so that what copies share, which the copies
themselves make frequent, still outweighs what sets them apart. df is counted over all texts in a count-min sketch of fixed size, less the usual count
of its cells, and counts that the other shingles of a cell can make up are taken for 1: so rare shingles weigh the same in a table of any size, and an error
is one of less than so many documents.

1. BANDS * ROWS consistent samples of each text give BANDS bucket keys, in one pass over the source.
2. Texts with equal words are one: the one with the least doc_id stands for all (a hash aggregation with partial sums).
3. In each bucket the text with the least hash for that band is its centre, so buckets of the same texts have different centres. Each text is
   verified against its centres by the exact weighted Jaccard similarity, first in ``FIRST`` of the bands, then in the others where it is not yet linked
   to the centre. Links are the edges of a graph whose components are found by label propagation with pointer jumping over tables in the shared folder.
4. A bucket whose texts are not all in one component is gone over again, in blocks: each text outside its centre's component is compared with every text
   of the bucket in another component. First the pairs with the most equal samples are verified, which links most, together with the other bands' centres;
   then all that are still apart, inside their block, so that only links come out; only pairs whose total weights already rule out the threshold are passed
   over. So within a bucket no pair of texts of different components stays uncompared, and no group is held whole by one task.

Nothing of all documents comes to the driver but the sketch. Defined results: a null text, or one without words, is in a class of its own; rows with a
null doc_id are in no class (keep_one keeps them); rows that repeat a doc_id count as one document; an empty table gives no
rows; other columns are ignored (classes) or passed on (keep_one). A very long text is one run of its shingles, held by one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltgrain.llm.common import Scratch, ragged, slices, text_bytes
from siltgrain.llm.textops import Words, mix, salted, sequences

SHINGLE, THRESHOLD, IDF_SHARE = 5, 0.8, 0.05
BANDS, ROWS, FIRST = 16, 4, 4
#: Cells of the count-min sketch: DEPTH rows of 2 ** WIDTH, written in CHUNKS parts.
DEPTH, WIDTH, CHUNKS = 2, 20, 512
#: The share of equal samples from which a pair is verified first in step 4: four standard deviations below the threshold.
NEAR = THRESHOLD - 4 * (THRESHOLD * (1 - THRESHOLD) / (BANDS * ROWS)) ** 0.5
BLOCK, BEST = 512, 2
_TABLE_BITS = 14
_rng = np.random.default_rng(0xC0FFEE)
_SEEDS = (_rng.integers(0, 1 << 63, BANDS * ROWS, np.uint64) << np.uint64(1)) | np.uint64(1)


def _gamma2(rng: np.random.Generator, shape: tuple[int, int]) -> np.ndarray:
    return -np.log(rng.random(shape) * rng.random(shape) + 1e-300)


#: For each sample and each of 2 ** _TABLE_BITS hash values: r and ln c with r, c ~ Gamma(2, 1), and beta uniform.
R = _gamma2(_rng, (BANDS * ROWS, 1 << _TABLE_BITS)).astype(np.float32) + np.float32(1e-6)
LOG_C = np.log(_gamma2(_rng, (BANDS * ROWS, 1 << _TABLE_BITS)) + 1e-30).astype(np.float32)
BETA = _rng.random((BANDS * ROWS, 1 << _TABLE_BITS)).astype(np.float32)


class Shingled:
    """The distinct shingles of some texts, ordered by text and hash: hash, count tf; bounds: of the shingles of each text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        words = Words(data, offsets, fold=True)
        runs, bounds = sequences(words.hashes, words.bounds, SHINGLE, shorter=True)
        text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        order = np.argsort((text.astype(np.uint64) << np.uint64(42)) | (runs >> np.uint64(22)))
        runs, text = runs[order], text[order]
        new = np.ones(len(runs), bool)
        new[1:] = (runs[1:] != runs[:-1]) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        self.hash, text = runs[at], text[at]
        self.tf = np.diff(np.append(at, len(runs)))
        self.bounds = np.searchsorted(text, np.arange(len(offsets)))


def word_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """(two hashes of the words of each text, numbers of words)."""
    words = Words(data, offsets, fold=True)
    place = np.arange(len(words.hashes)) - words.bounds[words.text]
    at = salted(words.hashes, place)
    n = np.diff(words.bounds).astype(np.uint64)
    keys = []
    for part in (at, mix(at ^ np.uint64(0xA5A5A5A5A5A5A5A5))):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(part)])
        keys.append(mix(total[words.bounds[1:]] - total[words.bounds[:-1]] + n))
    return keys, n.astype(np.int64)


def cells(hashes: np.ndarray) -> list[np.ndarray]:
    """The sketch's cell of each hash in each row."""
    return [(mix(hashes + np.uint64(0x9E3779B97F4A7C15 * (d + 1) % (1 << 64))) >> np.uint64(64 - WIDTH)).astype(np.int64) for d in range(DEPTH)]


def idf(hashes: np.ndarray, sketch: np.ndarray, n_texts: int) -> np.ndarray:
    df = np.minimum.reduce([sketch[d][c] for d, c in enumerate(cells(hashes))])
    return 1 + IDF_SHARE * np.clip(np.log(max(n_texts, 1) / np.maximum(df, 1)) / np.log(max(n_texts, 2)), 0, 1)


def weights(s: Shingled, sketch: np.ndarray, n_texts: int) -> np.ndarray:
    return (1 + np.log(s.tf)) * idf(s.hash, sketch, n_texts)


def samples(s: Shingled, weight: np.ndarray) -> np.ndarray:
    """By text and sample: the hash of the sampled (shingle, level) of improved consistent weighted sampling; 0 for a text without words."""
    out = np.zeros((len(s.bounds) - 1, BANDS * ROWS), np.uint64)
    full = np.flatnonzero(np.diff(s.bounds))
    if not len(full):
        return out
    starts, log_w = s.bounds[:-1][full], np.log(weight).astype(np.float32)
    counts = np.diff(np.append(starts, len(log_w)))
    low = s.hash & np.uint64(0xFFFFFFFF)
    for k in range(BANDS * ROWS):
        at = ((s.hash * _SEEDS[k]) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)
        r, beta = R[k][at], BETA[k][at]
        level = np.floor(log_w / r + beta)
        bits = (LOG_C[k][at] - r * (level - beta + 1)).view(np.uint32)
        order = np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64)  # in the order of the numbers
        order <<= np.uint64(32)
        order |= low
        won = np.flatnonzero(order == np.repeat(np.minimum.reduceat(order, starts), counts))
        won = won[np.searchsorted(won, starts)]  # the first, should two be equal
        out[full, k] = mix(s.hash[won] + level[won].astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return out


def _batches(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    for batch in batches:
        data, offsets = text_bytes(batch.column(1))
        for a, b in slices(offsets, most):
            yield batch.column(0).slice(a, b - a), data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def _read_sketch(rows) -> np.ndarray:
    size = DEPTH * (1 << WIDTH) // CHUNKS
    out = np.zeros(DEPTH << WIDTH, np.int64)
    for r in rows:
        out[r.chunk * size : (r.chunk + 1) * size] = np.frombuffer(r.counts, "<i8")
    return out.reshape(DEPTH, -1)


def _pack(counts: np.ndarray) -> bytes:
    return zlib.compress(counts.astype("<i8").tobytes(), 1)


def _unpack(blob: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), "<i8")


def _count(docs: DataFrame) -> DataFrame:
    """The sketch of each task, in parts; summed by part it is that of the table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = np.zeros((DEPTH, 1 << WIDTH), np.int64)
        some = False
        for _, data, offsets in _batches(batches):
            some = True
            for d, c in enumerate(cells(Shingled(data, offsets).hash)):
                sketch[d] += np.bincount(c, minlength=1 << WIDTH)
        if some:
            parts = sketch.reshape(CHUNKS, -1)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(CHUNKS), pa.int32()), pa.array([_pack(p) for p in parts], pa.binary())], ["chunk", "counts"])

    def total(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((DEPTH << WIDTH) // CHUNKS, np.int64)
        for batch in batches:
            for blob in batch.column(1).to_pylist():
                counts += _unpack(blob)
        yield pa.RecordBatch.from_arrays([pa.array([keys[0].as_py()], pa.int32()), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["chunk", "counts"])

    return docs.mapInArrow(run, "chunk int, counts binary").groupBy("chunk").applyInArrow(total, "chunk int, counts binary")


def without_noise(sketch: np.ndarray) -> np.ndarray:
    """Counts less what the median cell of their row holds; 0 where that is less than five deviations of the cells."""
    usual = np.median(sketch, axis=1, keepdims=True)
    spread = 1.4826 * np.median(np.abs(sketch - usual), axis=1, keepdims=True)
    out = sketch - usual
    out[out < 5 * spread] = 0
    return out


class _Sketch:
    """The sketch as tasks get it: one broadcast of fixed size."""

    def __init__(self, spark, rows, n_texts: int):
        found = np.clip(without_noise(_read_sketch(rows)), 0, (1 << 31) - 1).astype(np.int32)
        self.value, self.n_texts = spark.sparkContext.broadcast(found), n_texts

    def weights(self, s: Shingled) -> np.ndarray:
        return weights(s, self.value.value, self.n_texts)


def _sampled(docs: DataFrame, sketch: _Sketch) -> DataFrame:
    """doc_id, two hashes of the words, their number, bands (bucket keys) and the samples' low bytes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, data, offsets in _batches(batches):
            keys, n = word_keys(data, offsets)
            s = Shingled(data, offsets)
            found = samples(s, sketch.weights(s))
            bands = np.zeros((len(found), BANDS), np.uint64)
            for i in range(ROWS):
                bands = mix(bands + found[:, i::ROWS] * np.uint64(2 * i + 3))
            bands = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS).cast(pa.list_(pa.int64()))
            low = (found & np.uint64(0xFFFF)).astype("<u2")
            columns = [ids, *(pa.array(k.view(np.int64)) for k in keys), pa.array(n), bands, pa.array([x.tobytes() for x in low], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key1", "key2", "n_words", "bands", "low"])

    return docs.mapInArrow(run, "doc_id bigint, key1 bigint, key2 bigint, n_words bigint, bands array<bigint>, low binary")


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts, each as ordered hashes and their weights."""
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    low, total = np.minimum(a[1][at[same]], b[1][same]).sum(), a[1].sum() + b[1].sum()
    return float(low / (total - low)) if total > low else 1.0


def _verified(pairs: DataFrame, texts: DataFrame, sketch: _Sketch) -> DataFrame:
    """Those of the pairs (a, b) whose similarity is at least THRESHOLD. Rows of one a follow one another, so each a is cut up once."""
    with_b = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")).hint("merge"), "b")
    both = with_b.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")).hint("merge"), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
            out = []
            data, offsets = text_bytes(column)
            for i, j in slices(offsets, 1 << 20):
                s = Shingled(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                w = sketch.weights(s)
                out += [(s.hash[x:y], w[x:y]) for x, y in zip(s.bounds[:-1], s.bounds[1:], strict=True)]
            return out

        for batch in batches:
            for start in range(0, len(batch), 256):
                part = batch.slice(start, 256)
                a = part.column(0).to_numpy()
                new = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]]))
                left, right = cut(part.column(2).take(pa.array(new))), cut(part.column(3))
                which = np.searchsorted(new, np.arange(len(a)), "right") - 1
                keep = [similarity(left[i], x) >= THRESHOLD for i, x in zip(which, right, strict=True)]
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a bigint, b bigint")


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(doc_id, class): the least id of the component of each end of a link (a, b).

    In each round a node takes the least label around it and then that label's own label, until nothing changes; the rounds grow with the logarithm of
    the components' diameters. Each round's labels are a table in the shared folder.
    """
    both = scratch.table(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), f"{name}-edges")
    labels = scratch.table(both.groupBy("a").agg(F.least("a", F.min("b")).alias("label")), f"{name}-0")
    step, before = 0, ""
    while True:
        step += 1
        around = both.join(labels.select(F.col("a").alias("b"), F.col("label").alias("next")), "b").groupBy("a").agg(F.min("next").alias("next"))
        nearer = labels.join(around, "a").select("a", F.col("label").alias("old"), F.least("label", "next").alias("label"))
        jump = labels.select(F.col("a").alias("label"), F.col("label").alias("jumped"))
        moved = nearer.join(jump, "label", "left").select("a", F.least("label", "jumped").alias("label"), (F.least("label", "jumped") != F.col("old")).alias("changed"))
        labels = scratch.table(moved, f"{name}-{step}")
        if before:
            scratch.drop(before)
        before = f"{name}-{step - 1}"
        if not labels.filter("changed").limit(1).count():
            scratch.drop(f"{name}-edges")
            return labels.select(F.col("a").alias("doc_id"), F.col("label").alias("class"))
        labels = labels.select("a", "label")


def joined(found: DataFrame, links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """components() with more links: found is (doc_id, class) without them. Only links between components go through label propagation, as links of classes."""
    ends = links.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct().join(found, "doc_id", "left").select("doc_id", F.coalesce("class", "doc_id").alias("class"))
    ends = scratch.table(ends, f"{name}-ends")
    one, two = (ends.select(F.col("doc_id").alias(x), F.col("class").alias(f"class_{x}")) for x in "ab")
    between = links.join(one, "a").join(two, "b").filter("class_a <> class_b").select(F.least("class_a", "class_b").alias("a"), F.greatest("class_a", "class_b").alias("b")).distinct()
    top = components(scratch.table(between, f"{name}-between"), scratch, name).select(F.col("doc_id").alias("class"), F.col("class").alias("to"))
    every = found.unionByName(ends.join(found.select("doc_id"), "doc_id", "left_anti"))
    every = scratch.table(every.join(top, "class", "left").select("doc_id", F.coalesce("to", "class").alias("class")), f"{name}-classes")
    scratch.drop(f"{name}-ends", f"{name}-between")
    return every


def _buckets(sampled: DataFrame) -> DataFrame:
    return sampled.select("doc_id", F.posexplode("bands").alias("band", "bucket"))


def _centres(members: DataFrame, scratch: Scratch) -> DataFrame:
    """band, bucket and the centre a of all buckets with more than one of members (doc_id, band, bucket). A table of its own, so that the optimizer can split or broadcast what joins it."""
    least = F.struct(F.xxhash64("doc_id", "band").alias("order"), F.col("doc_id").alias("a"))
    centres = members.groupBy("band", "bucket").agg(F.min(least).alias("centre"), F.count("*").alias("n"))
    return scratch.table(centres.filter("n > 1").select("band", "bucket", F.col("centre.a").alias("a")), "centres")


def _star_pairs(members: DataFrame, centres: DataFrame) -> DataFrame:
    """Distinct pairs (a: a bucket's centre, b) of members (doc_id, band, bucket)."""
    pairs = members.join(centres, ["band", "bucket"]).filter("doc_id <> a")
    return pairs.select(F.least("a", "doc_id").alias("x"), F.greatest("a", "doc_id").alias("y"), "a", F.col("doc_id").alias("b")).groupBy("x", "y").agg(F.min("a").alias("a")).select("a", F.when(F.col("x") == F.col("a"), F.col("y")).otherwise(F.col("x")).alias("b"))


def _mixed(sampled: DataFrame, classes: DataFrame, scratch: Scratch, name: str) -> DataFrame | None:
    """The members of buckets whose texts are not all in one component: band, bucket, doc_id, class, main, the centre's class, and a, the centre. None: no
    such bucket."""
    members = _buckets(sampled.select("doc_id", "bands")).join(classes.select("doc_id", "class"), "doc_id", "left").withColumn("class", F.coalesce("class", "doc_id"))
    least = F.struct(F.xxhash64("doc_id", "band").alias("order"), F.col("class").alias("class"), F.col("doc_id").alias("a"))
    mixed = members.groupBy("band", "bucket").agg(F.min(least).alias("centre"), F.min("class").alias("low"), F.max("class").alias("high"))
    mixed = scratch.table(mixed.filter("low <> high").select("band", "bucket", F.col("centre.class").alias("main"), F.col("centre.a").alias("a")), f"buckets-{name}")
    inside = scratch.table(members.join(mixed, ["band", "bucket"]), f"mixed-{name}")
    return inside if inside.limit(1).count() else None


def _in_blocks(inside: DataFrame, size: F.Column, most: int, scratch: Scratch, name: str) -> DataFrame:
    """inside as blocks of about ``most`` by size: each member once (asks 0) for each block of askers, each text outside its centre's class (asks 1) for
    each block of members. Dealt out by band, bucket, block and asker, to group by: a shuffle of its own, lest all blocks of a bucket stay in one task."""
    sizes = inside.groupBy("band", "bucket").agg(
        F.ceil(F.sum(size) / most).cast("int").alias("blocks"), F.ceil(F.sum(F.when(F.col("class") != F.col("main"), size)) / most).cast("int").alias("askers")
    )
    inside = inside.join(scratch.table(sizes, f"sizes-{name}"), ["band", "bucket"])

    def own(n: str) -> F.Column:
        return F.pmod(F.xxhash64("doc_id"), F.col(n)).cast("int")

    def every(n: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(n) - 1))

    held = inside.withColumn("block", own("blocks")).withColumn("asker", every("askers")).withColumn("asks", F.lit(0))
    asking = inside.filter("class <> main").withColumn("block", every("blocks")).withColumn("asker", own("askers")).withColumn("asks", F.lit(1))
    return held.unionByName(asking).drop("blocks", "askers", "main", "a").repartition("band", "bucket", "block", "asker")


def _best_pairs(inside: DataFrame, sampled: DataFrame, best: int, scratch: Scratch) -> DataFrame:
    """Pairs of texts that share a bucket but no component, one of them outside its centre's: of each such text and block those with the most equal samples."""
    blocks = _in_blocks(inside.join(sampled.select("doc_id", "low"), "doc_id"), F.lit(1), BLOCK, scratch, "best")

    def compare(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        ids, group, asks = (table.column(c).to_numpy() for c in ("doc_id", "class", "asks"))
        low = np.frombuffer(b"".join(table.column("low").to_pylist()), "<u2").reshape(len(ids), -1)
        mine = np.flatnonzero(asks == 0)
        for i in np.flatnonzero(asks == 1):
            equal = (low[mine] == low[i]).mean(1)
            at = np.flatnonzero((equal >= NEAR) & (group[mine] != group[i]))
            if len(at) > best:
                at = at[np.argpartition(-equal[at], best - 1)[:best]]
            if len(at):
                other = ids[mine[at]]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ids[i])), pa.array(np.maximum(other, ids[i]))], ["a", "b"])

    return blocks.groupBy("band", "bucket", "block", "asker").applyInArrow(compare, "a bigint, b bigint").distinct()


def _rest_links(inside: DataFrame, sampled: DataFrame, texts: DataFrame, sketch: _Sketch, scratch: Scratch) -> DataFrame:
    """All links between texts that share a bucket but no component, one of them outside its centre's: verified where they lie, so that only links come out.

    A pair is looked at in the first band in which its texts meet. Its similarity is at most the smaller total weight over the larger.
    """
    with_text = inside.join(sampled.select("doc_id", "bands"), "doc_id").join(texts.hint("merge"), "doc_id")
    blocks = _in_blocks(with_text, F.length("text") + 64, 2 << 20, scratch, "rest")

    def compare(keys: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches)).combine_chunks()
        ids, group, asks = (table.column(c).to_numpy() for c in ("doc_id", "class", "asks"))
        bands = np.array(table.column("bands").to_pylist(), np.int64).reshape(len(ids), -1)
        mine, band = np.flatnonzero(asks == 0), keys[0].as_py()
        s = Shingled(*text_bytes(table.column("text")))
        w = sketch.weights(s)
        total = np.add.reduceat(np.append(w, 0.0), s.bounds[:-1]) * (np.diff(s.bounds) > 0)
        for i in np.flatnonzero(asks == 1):
            least, most = np.minimum(total[mine], total[i]), np.maximum(total[mine], total[i])
            near = (least >= (THRESHOLD - 1e-9) * most) & (group[mine] != group[i]) & ((bands[mine] == bands[i]).argmax(1) == band)
            at = mine[near]
            if not len(at):
                continue
            sizes = np.diff(s.bounds)[at]
            place = ragged(s.bounds[at], sizes)
            own, weight = s.hash[s.bounds[i] : s.bounds[i + 1]], w[s.bounds[i] : s.bounds[i + 1]]
            found = np.minimum(np.searchsorted(own, s.hash[place]), len(own) - 1)
            both = np.where(own[found] == s.hash[place], np.minimum(weight[found], w[place]), 0.0)
            shared = np.bincount(np.repeat(np.arange(len(at)), sizes), both, minlength=len(at))
            other = ids[at[shared >= THRESHOLD * (total[at] + total[i] - shared)]]
            if len(other):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(other, ids[i])), pa.array(np.maximum(other, ids[i]))], ["a", "b"])

    return blocks.groupBy("band", "bucket", "block", "asker").applyInArrow(compare, "a bigint, b bigint").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """One row for each doc_id: doc_id, class_id (the least doc_id of its group) and copy_of (the least doc_id of those with the same words)."""
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).filter("doc_id is not null")
    sketch = _Sketch(spark, _count(docs).collect(), docs.count())
    sampled = scratch.table(_sampled(docs, sketch), "sampled")
    own = F.when(F.col("n_words") == 0, F.col("doc_id"))
    documents = sampled.groupBy("doc_id").agg(F.min(F.struct("key1", "key2", "n_words")).alias("k")).select("doc_id", "k.*").withColumn("own", own)
    documents = scratch.table(documents, "documents")
    copies = scratch.table(documents.groupBy("key1", "key2", "n_words", "own").agg(F.min("doc_id").alias("copy_of")), "copies")
    first = copies.filter("n_words > 0").select(F.col("copy_of").alias("doc_id"), "key1", "key2")
    firsts = sampled.join(first, ["doc_id", "key1", "key2"], "left_semi").groupBy("doc_id").agg(F.min("bands").alias("bands"), F.min("low").alias("low"))
    firsts = scratch.table(firsts, "firsts")
    scratch.drop("sampled")

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of some ids, found once for a step; merging keeps the plan the same at every size."""
        found = docs.join(ids.hint("merge"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("text").alias("text"))
        return scratch.table(found, f"texts-{name}")

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        pairs = scratch.table(pairs, f"pairs-{name}")
        texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), name)
        links = scratch.table(_verified(pairs, texts, sketch), f"links-{name}")
        scratch.drop(f"pairs-{name}", f"texts-{name}")
        return links

    members = _buckets(firsts).filter(F.col("band") < FIRST)
    found = components(verified(_star_pairs(members, _centres(members, scratch)), "star"), scratch, "star")
    inside = _mixed(firsts, found, scratch, "best")
    if inside is not None:
        stars = inside.filter((F.col("band") >= FIRST) & (F.col("class") != F.col("main"))).select("a", F.col("doc_id").alias("b"))
        pairs = stars.unionByName(_best_pairs(inside, firsts, BEST, scratch))
        ordered = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        new = verified(ordered, "best")
        if new.limit(1).count():
            found = joined(found, new, scratch, "best")
            inside = _mixed(firsts, found, scratch, "rest")
    if inside is not None:
        new = scratch.table(_rest_links(inside, firsts, texts_of(inside.select("doc_id").distinct(), "rest"), sketch, scratch), "links-rest")
        if new.limit(1).count():
            found = joined(found, new, scratch, "rest")
    scratch.drop("firsts", "centres", "texts-rest", *(f"{x}-{y}" for x in ("mixed", "sizes", "buckets", "links") for y in ("star", "best", "rest")))
    by_copy = copies.join(found.select(F.col("doc_id").alias("copy_of"), "class"), "copy_of", "left").select("key1", "key2", "n_words", "own", "copy_of", F.coalesce("class", "copy_of").alias("class_id"))
    return documents.join(by_copy, (documents.key1 == by_copy.key1) & (documents.key2 == by_copy.key2) & (documents.n_words == by_copy.n_words) & documents.own.eqNullSafe(by_copy.own)).select("doc_id", "class_id", "copy_of")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stand for their group: those with its least doc_id, once, and those without a doc_id."""
    found = classes(docs).filter("doc_id = class_id").select(F.col("doc_id").alias("__class"))
    kept = docs.filter("doc_id is not null").join(found, F.col("doc_id").cast("bigint") == F.col("__class"), "left_semi")
    once = kept.withColumn("__row", F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))).filter("__row = 1").drop("__row")
    return once.unionByName(docs.filter("doc_id is null"))
