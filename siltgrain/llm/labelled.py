"""What the two classifiers share: which labelled documents they learn from, and how scores become rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltgrain.llm.common import slices, text_bytes

SCHEMA = "doc_id bigint, held_out boolean, score double, predicted int"


def held_out(doc_id) -> F.Column:
    """Whether a document is kept from learning: the CRC-32 of its id as text leaves 1 modulo 3. A null id is not held out, and never learnt from."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "utf-8")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, column: str, most_per_class: int) -> list[tuple[int, str]]:
    """(label, text) of at most most_per_class documents of each class, those whose ids have the smallest hashes, in that order.

    The chosen ids are at most 2 * most_per_class, so they are broadcast to the scan of the texts.
    """
    usable = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    keyed = usable.groupBy("doc_id").agg(F.min("label").alias("label")).withColumn("order", F.xxhash64("doc_id"))
    chosen = keyed.filter("label = 0").orderBy("order", "doc_id").limit(most_per_class).unionByName(keyed.filter("label = 1").orderBy("order", "doc_id").limit(most_per_class))
    ids = docs.sparkSession.createDataFrame([tuple(r) for r in chosen.collect()], keyed.schema)
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("order").alias("order"), F.min("label").alias("label"), F.min("text").alias("text"))
    return [(r.label, r.text) for r in sorted(found.collect(), key=lambda r: (r.order, r.doc_id))]


def scored(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """doc_id, held_out, score and predicted of each document, score() taking the bytes and offsets of some texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(2))
            for a, b in slices(offsets, 1 << 20):
                found = score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                columns = [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(found, pa.float64()), pa.array((found >= threshold).astype(np.int32), pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, SCHEMA)


def kept(docs: DataFrame, score: Callable[[np.ndarray, np.ndarray], np.ndarray], threshold: float) -> DataFrame:
    """The rows of docs, with all their columns, whose score is at least threshold."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_bytes(batch.column(at))
            for a, b in slices(offsets, 1 << 20):
                found = score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield batch.slice(a, b - a).filter(pa.array(found >= threshold))

    return docs.mapInArrow(run, docs.schema)
