"""The inverted index: postings and the statistics of terms, documents and the collection, as plain DataFrames."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrain.functions import scoring
from siltgrain.functions.text import words

#: The least document frequency of terms that get postings.
DF_CUTOFF = 9
#: Ranges of terms that a dictionary is numbered by, about.
RANGES = 64
#: The most rows of terms, queries or candidates that are broadcast.
SMALL = 500_000


class Mode(str, Enum):
    """What postings hold besides the document."""

    NONPOSITIONAL = "nonpositional"
    TF = "tf"
    POSITIONAL = "positional"

    @property
    def has_tf(self) -> bool:
        return self is not Mode.NONPOSITIONAL

    @property
    def has_positions(self) -> bool:
        return self is Mode.POSITIONAL


@dataclass
class Index:
    """postings: term, docid, doc_len [, tf [, positions]]; terms: term, df [, max_tf, max_tf_len]; docs: docid, doc_len; stats: one row."""

    mode: Mode
    df_cutoff: int
    postings: DataFrame
    terms: DataFrame
    docs: DataFrame
    stats: DataFrame

    def cache(self, postings: bool = True) -> Index:
        """Keeps the tables for the session; without postings, which are made anew from the documents by each query, only the small ones."""
        for df in (*[self.postings] * postings, self.terms, self.docs, self.stats):
            df.persist()
        return self

    def write(self, path: str) -> None:
        """Parquet below path; postings ranged and sorted by term, so that reading a term's postings skips other row groups."""
        self.postings.repartitionByRange("term", "docid").sortWithinPartitions("term", "docid").write.mode("overwrite").parquet(f"{path}/postings")
        self.terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        self.docs.write.mode("overwrite").parquet(f"{path}/docs")
        kept = self.stats.withColumn("mode", F.lit(self.mode.value)).withColumn("df_cutoff", F.lit(self.df_cutoff))
        kept.write.mode("overwrite").parquet(f"{path}/stats")


def load(spark: SparkSession, path: str) -> Index:
    """What Index.write() wrote. The mode comes with it."""
    stats = spark.read.parquet(f"{path}/stats")
    kept = stats.first()
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "docs")]
    return Index(Mode(kept["mode"]), kept["df_cutoff"], *tables, stats.drop("mode", "df_cutoff"))


def small(rows: DataFrame) -> DataFrame:
    """rows, to be broadcast if there are at most SMALL; they are counted when this is called."""
    return F.broadcast(rows) if rows.limit(SMALL + 1).count() <= SMALL else rows


def doc_lengths(docs: DataFrame) -> DataFrame:
    """docid, doc_len: the number of tokens; a document without tokens has 0."""
    return docs.select("docid", F.size(words(F.col("text"))).cast("bigint").alias("doc_len"))


def collection_stats(lengths: DataFrame) -> DataFrame:
    """n_docs (documents without tokens too), total_len, avg_len."""
    total = F.coalesce(F.sum("doc_len"), F.lit(0).cast("bigint"))
    return lengths.agg(F.count("*").alias("n_docs"), total.alias("total_len")).withColumn("avg_len", F.try_divide(F.col("total_len").cast("double"), F.col("n_docs")))


def _counted(docs: DataFrame, mode: Mode) -> DataFrame:
    """The postings of docs without two rows of one docid: each row's words are sorted and their runs counted in the row itself, so no token moves."""
    cut = docs.select("docid", words(F.col("text")).alias("words"))
    sized = F.size("words").cast("bigint").alias("doc_len")
    if not mode.has_tf:
        return cut.select("docid", sized, F.explode(F.array_distinct("words")).alias("term")).select("term", "docid", "doc_len")
    placed = F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))) if mode.has_positions else F.col("words")
    ordered = cut.select("docid", sized, F.sort_array(placed).alias("words"))

    def word(i: Column) -> Column:
        return F.get("words", i)["w"] if mode.has_positions else F.get("words", i)

    places = F.sequence(F.lit(0), F.col("doc_len").cast("int") - 1)
    starts = F.when(F.col("doc_len") > 0, F.filter(places, lambda i: (i == 0) | (word(i) != word(i - 1)))).alias("starts")

    def run(start: Column, n: Column) -> Column:
        tf = F.coalesce(F.get("starts", n + 1), F.col("doc_len").cast("int")) - start
        more = [F.transform(F.slice("words", start + 1, tf), lambda x: x["i"]).alias("positions")] if mode.has_positions else []
        return F.struct(word(start).alias("term"), tf.cast("bigint").alias("tf"), *more)

    found = ordered.select("*", starts).select("docid", "doc_len", F.inline(F.transform("starts", run)))
    return found.select("term", "docid", "doc_len", "tf", *["positions"] * mode.has_positions)


def all_postings(docs: DataFrame, mode: Mode = Mode.TF) -> DataFrame:
    """The postings of every term. Each carries its document's length, so that scoring needs no further join. A docid's rows, if there are several, are counted
    together; such docids are looked for when this is called, and without any no token moves."""
    if docs.groupBy("docid").count().filter("count > 1").isEmpty():
        return _counted(docs, mode)
    cut = docs.select("docid", words(F.col("text")).alias("words"))
    exploded = cut.select("docid", F.size("words").cast("bigint").alias("doc_len"), F.posexplode("words").alias("pos", "term"))
    found = [F.first("doc_len").alias("doc_len")]
    if mode.has_tf:
        found.append(F.count("*").alias("tf"))
    if mode.has_positions:
        found.append(F.sort_array(F.collect_list("pos")).alias("positions"))
    return exploded.groupBy("term", "docid").agg(*found)


def term_stats(postings: DataFrame, mode: Mode = Mode.TF) -> DataFrame:
    """term, df and, with term frequencies, max_tf and max_tf_len: the posting of greatest tf, of those the shortest document's."""
    found = [F.count("*").alias("df")]
    if not mode.has_tf:
        return postings.groupBy("term").agg(*found)
    # Both are array sizes, so below 2 ** 31: one number for the pair keeps to the hash aggregate, where a struct would be sorted.
    most = F.max(F.shiftleft(F.col("tf").cast("bigint"), 32) + (F.lit((1 << 32) - 1) - F.col("doc_len")))
    less = (F.lit((1 << 32) - 1) - F.col("most").bitwiseAND(F.lit((1 << 32) - 1))).alias("max_tf_len")
    return postings.groupBy("term").agg(*found, most.alias("most")).select("term", "df", F.shiftright("most", 32).alias("max_tf"), less)


def build(docs: DataFrame, mode: Mode | str = Mode.TF, df_cutoff: int = DF_CUTOFF) -> Index:
    """The index of docs (docid, text), texts normalised; docids unique and 0 or more. Terms of a lower document frequency than df_cutoff are left out:
    the terms are counted when this is called, and postings move only if more terms stay than small() broadcasts."""
    mode = Mode(mode)
    postings = all_postings(docs, mode)
    terms = term_stats(postings, mode).filter(F.col("df") >= df_cutoff)
    if df_cutoff > 1:
        terms = terms.persist()  # counted here to choose the join, then read by it
    kept = postings if df_cutoff <= 1 else postings.join(small(terms.select("term")), "term", "left_semi")
    lengths = doc_lengths(docs)
    return Index(mode, df_cutoff, kept, terms, lengths, collection_stats(lengths))


def upper_bounds(index: Index) -> DataFrame:
    """term, ub: the BM25 score of each term's posting of greatest tf (of those, the shortest document)."""
    ub = scoring.bm25(F.col("max_tf"), F.col("df"), F.col("n_docs"), F.col("max_tf_len"), F.col("avg_len"))
    return index.terms.crossJoin(F.broadcast(index.stats)).select("term", ub.alias("ub"))


def dictionary(index: Index) -> DataFrame:
    """term, termid: ids from 0 in the order of terms, by counts of ranges, so that no task sorts all terms."""
    return numbered_terms(index).select("term", "termid")


def numbered_terms(index: Index) -> DataFrame:
    """The terms table with termid. The ranges lie between given terms, some RANGES of them picked by hash, so they are the same whenever a part of the plan
    runs: ids of Spark's own range partitions are not, where a plan counts them apart from numbering within them."""
    from pyspark.sql import Window

    every = max(1, index.terms.count() // RANGES)
    picked = index.terms.filter(F.pmod(F.xxhash64("term"), F.lit(every)) == 0) if every > 1 else index.terms
    ends = sorted(r.term for r in picked.select("term").limit(4 * RANGES).collect())
    ends = F.array(*map(F.lit, ends)) if ends else F.array().cast("array<string>")
    ranged = index.terms.withColumn("part", F.size(F.filter(ends, lambda e: e <= F.col("term"))))
    local = ranged.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1)
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    numbered = local.join(F.broadcast(before.select("part", "before")), "part")
    return numbered.select(*index.terms.columns, (F.col("at") + F.col("before")).cast("bigint").alias("termid"))
