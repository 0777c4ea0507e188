"""An extension: postings of documents that keep arriving, as a stream of collection lines.

Each micro-batch writes its documents' postings and lengths under its own number, so a batch that runs again after a failure replaces itself. The index of
all batches is put together when it is loaded; document frequencies and the cut-off are those of the whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from siltgrain.operators import index
from siltgrain.sources.collection import parse_collection


def ingest(spark: SparkSession, source: str, path: str, checkpoint: str, mode: index.Mode = index.Mode.TF, **trigger) -> StreamingQuery:
    """Starts a query that indexes the text files of the folder source, new ones as they come, into path. trigger: as writeStream.trigger() takes it."""

    def write(batch: DataFrame, number: int) -> None:
        docs = parse_collection(batch)
        index.all_postings(docs, mode).write.mode("overwrite").parquet(f"{path}/postings/batch={number}")
        index.doc_lengths(docs).write.mode("overwrite").parquet(f"{path}/docs/batch={number}")

    stream = spark.readStream.schema("value string").text(source)
    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def load(spark: SparkSession, path: str, mode: index.Mode = index.Mode.TF, df_cutoff: int = index.DF_CUTOFF) -> index.Index:
    """The index over all batches so far; a document is in one batch only."""
    postings, docs = (spark.read.parquet(f"{path}/{name}").drop("batch") for name in ("postings", "docs"))
    terms = index.term_stats(postings, mode).filter(F.col("df") >= df_cutoff)
    kept = postings.join(terms.select("term"), "term", "left_semi")
    return index.Index(mode, df_cutoff, kept, terms, docs, index.collection_stats(docs))
