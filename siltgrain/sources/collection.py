"""Readers and writers of line-oriented files: collections, query batches and results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GZIP_MAGIC = bytes.fromhex("1f8b")


def _head(spark: SparkSession, path: str) -> bytes:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return bytes(x for x in (stream.read(), stream.read()) if x >= 0)
    finally:
        stream.close()


def _lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The lines of raw or gzip files. Spark's text reader knows gzip by the suffix .gz; other gzip files are known by their first two bytes."""
    found = [r.path for r in spark.read.format("binaryFile").load(paths).select("path").collect()]
    odd = [p for p in found if not p.endswith(".gz") and _head(spark, p) == GZIP_MAGIC]
    plain = [p for p in found if p not in odd]
    lines = spark.read.text(plain).select("value") if plain else spark.createDataFrame([], "value string")
    if odd:

        def unpacked(batches):
            import gzip

            import pyarrow as pa

            for batch in batches:
                for content in batch.column(0).to_pylist():
                    yield pa.RecordBatch.from_arrays([pa.array(gzip.decompress(content).decode("utf-8", "replace").split("\n"))], ["value"])

        lines = lines.unionByName(spark.read.format("binaryFile").load(odd).select("content").mapInArrow(unpacked, "value string"))
    return lines


def read_collection(spark: SparkSession, *paths: str) -> DataFrame:
    """docid, text of lines ``<docid> TAB <text>``. Blank lines, and lines whose docid is no number of 0 or more, are skipped."""
    return parse_collection(_lines(spark, list(paths)))


def parse_collection(lines: DataFrame) -> DataFrame:
    """The same of a table with a column value."""
    parts = F.split("value", "\t", 2)
    parsed = lines.select(F.get(parts, F.lit(0)).try_cast("bigint").alias("docid"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("text"))
    return parsed.filter("docid >= 0")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """qid, term_pos, term of a query file: its first line is the number of queries, then ``<qid> <length> <terms>``. See parse_queries()."""
    with_number = spark.sparkContext.textFile(path).zipWithIndex()  # the order of lines decides which of two queries of one id holds
    lines = spark.createDataFrame(with_number, "value string, seq bigint")
    return parse_queries(lines.filter("seq > 0"))


def parse_queries(lines: DataFrame) -> DataFrame:
    """The terms of lines (value, seq) ``<qid> <length> <terms>``: at most length terms, and of lines with one id the last."""
    parts = F.filter(F.split(F.trim("value"), "[ \t]+"), lambda w: w != "")
    parsed = lines.select("seq", F.get(parts, F.lit(0)).try_cast("int").alias("qid"), F.get(parts, F.lit(1)).try_cast("int").alias("length"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))).alias("terms")).filter("qid is not null and length is not null")
    last = parsed.groupBy("qid").agg(F.max_by(F.struct("length", "terms"), "seq").alias("q"))
    return last.select("qid", F.posexplode(F.slice("q.terms", F.lit(1), F.greatest(F.col("q.length"), F.lit(0)))).alias("term_pos", "term"))


def result_lines(results: DataFrame) -> DataFrame:
    """``q: <qid> no: <docid>`` for each result, with what orders them: qid and rank (or docid, where there is no rank)."""
    order = "rank" if "rank" in results.columns else "docid"
    return results.select("qid", F.col(order).cast("bigint").alias("place"), F.format_string("q: %d no: %d", "qid", "docid").alias("line"))


def write_results(results: DataFrame, path: str) -> None:
    """Text files that hold the result lines in ascending order of qid and place."""
    result_lines(results).orderBy("qid", "place").select("line").write.mode("overwrite").text(path)
