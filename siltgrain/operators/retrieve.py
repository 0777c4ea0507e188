"""Query batches over an index: all terms (conjunctive) or any term (disjunctive, ranked by BM25).

Queries are rows (qid, term_pos, term). Terms without postings are dropped; queries left without terms give no rows. Joins are left to the optimizer and
adaptive execution, which broadcast the batch or the terms only below their size threshold and split skewed terms otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltgrain.functions import scoring
from siltgrain.operators.index import SMALL, Index, small


def known_terms(index: Index, queries: DataFrame) -> DataFrame:
    """qid, term_pos, term, df of the terms that have postings."""
    return queries.join(index.terms.select("term", "df"), "term").select("qid", "term_pos", "term", "df")


def ordered_terms(index: Index, queries: DataFrame) -> DataFrame:
    """known_terms() with ord: from 1, the rarest first, then as in the query."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("df", "term_pos"))
    return known_terms(index, queries).withColumn("ord", place.cast("bigint"))


def least_df(index: Index, queries: DataFrame) -> DataFrame:
    """qid, min_df: a bound on the number of conjunctive results."""
    return known_terms(index, queries).groupBy("qid").agg(F.min("df").alias("min_df"))


def _distinct(index: Index, queries: DataFrame) -> DataFrame:
    """qid, term, df, times: how often the query has the term. A batch of no more than SMALL is broadcast, so that postings don't move by term: a frequent
    term's postings, for each query that has it, would meet in one task."""
    return small(known_terms(index, small(queries)).groupBy("qid", "term").agg(F.first("df").alias("df"), F.count("*").alias("times")))


def conjunctive(index: Index, queries: DataFrame) -> DataFrame:
    """qid, docid of the documents that hold all known terms of a query. Where they are few enough to be broadcast, only the documents with a query's rarest term
    are looked at for its others."""
    terms = _distinct(index, queries)
    need = terms.groupBy("qid").agg(F.count("*").alias("need"), F.min(F.struct("df", "term")).alias("rarest"))
    postings = index.postings.select("term", "docid")
    met = postings.join(terms.select("qid", "term"), "term")
    if (need.agg(F.sum("rarest.df")).first()[0] or 0) <= SMALL:
        held = postings.join(F.broadcast(need.select("qid", F.col("rarest.term").alias("term"))), "term").select("qid", "docid")
        met = met.join(F.broadcast(held), ["qid", "docid"], "left_semi")
    met = met.groupBy("qid", "docid").agg(F.count("*").alias("met"))
    return met.join(need, "qid").filter("met = need").select("qid", "docid")


def intersection(index: Index, *terms: str) -> DataFrame:
    """docid of the documents that hold all of a few given terms, in one pass over the postings of these. Unknown terms are dropped."""
    listed = [r.term for r in index.terms.filter(F.col("term").isin(list(terms))).select("term").collect()]  # no more than the terms given
    if not listed:
        return index.docs.select("docid").limit(0)
    found = index.postings.filter(F.col("term").isin(listed)).select("docid")
    return found if len(listed) == 1 else found.groupBy("docid").count().filter(F.col("count") == len(listed)).select("docid")


def candidates(index: Index, queries: DataFrame) -> DataFrame:
    """Distinct qid, docid of the documents that hold any term of a query."""
    return known_terms(index, queries).select("qid", "term").join(index.postings.select("term", "docid"), "term").select("qid", "docid").distinct()


def scores(index: Index, queries: DataFrame) -> DataFrame:
    """qid, docid, score (rounded to 6 places): the sum over the query's terms, one that occurs twice counting twice."""
    if not index.mode.has_tf:
        raise ValueError("ranking needs an index with term frequencies")
    part = F.col("times") * scoring.bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))
    hits = _distinct(index, queries).join(index.postings.select("term", "docid", "tf", "doc_len"), "term").crossJoin(F.broadcast(index.stats))
    return hits.groupBy("qid", "docid").agg(F.round(F.sum(part), 6).alias("score"))


def disjunctive(index: Index, queries: DataFrame, hits: int = 1000) -> DataFrame:
    """qid, docid, score, rank of the exact best ``hits`` documents of each query; ties go to the smaller docid."""
    if hits < 0:
        raise ValueError("hits is 0 or more")
    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    return scores(index, queries).withColumn("rank", place).filter(F.col("rank") <= hits).withColumn("rank", F.col("rank").cast("bigint"))


def pruned(index: Index, queries: DataFrame, hits: int = 1000) -> DataFrame:
    """What disjunctive() gives, scoring fewer documents. The full scores of the documents that hold a query's rarest term give a threshold that the last of its
    best documents reaches; terms that even together stay below it can't bring in a document, so only documents with another of its terms are scored. A term's
    bound is the greatest of its postings' scores, and 0 at least."""
    if not index.mode.has_tf:
        raise ValueError("ranking needs an index with term frequencies")
    stats = F.broadcast(index.stats)
    terms = _distinct(index, queries)
    part = scoring.bm25(F.col("tf"), F.col("df"), F.col("n_docs"), F.col("doc_len"), F.col("avg_len"))
    wanted = small(terms.select("term", "df").distinct())
    # The postings of the batch's terms, kept since they are read for the bounds, the candidates and the scores.
    postings = index.postings.select("term", "docid", "tf", "doc_len").join(wanted.select("term"), "term", "left_semi").persist()
    bounds = postings.join(wanted, "term").crossJoin(stats).groupBy("term").agg(F.greatest(F.max(part), F.lit(0.0)).alias("ub"))
    whole = terms.join(postings, "term").crossJoin(stats).select("qid", "docid", (F.col("times") * part).alias("part"))

    def full(some: DataFrame) -> DataFrame:
        """The scores of the documents of some (qid, term)."""
        held = some.join(postings.select("term", "docid"), "term").select("qid", "docid").distinct()
        return whole.join(held, ["qid", "docid"], "left_semi").groupBy("qid", "docid").agg(F.round(F.sum("part"), 6).alias("score"))

    place = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "docid"))
    rarest = terms.groupBy("qid").agg(F.min(F.struct("df", "term")).alias("t")).select("qid", F.col("t.term").alias("term"))
    reached = full(rarest).withColumn("rank", place).filter(F.col("rank") == hits).select("qid", F.col("score").alias("threshold"))
    # From the least bound on, the terms whose bounds together stay below the threshold; a millionth covers rounding.
    together = F.sum(F.col("times") * F.col("ub")).over(Window.partitionBy("qid").orderBy("ub", "term").rowsBetween(Window.unboundedPreceding, 0))
    weighed = terms.join(bounds, "term").withColumn("together", together).join(reached, "qid", "left")
    needed = weighed.filter("threshold is null or together >= threshold - 0.000002").select("qid", "term")
    return full(needed).withColumn("rank", place).filter(F.col("rank") <= hits).withColumn("rank", F.col("rank").cast("bigint"))


def best_of_one(index: Index, terms: list[str], hits: int) -> DataFrame:
    """docid, score of one query's best documents, without a window over all of them."""
    spark = index.postings.sparkSession
    query = spark.createDataFrame([(1, i, t) for i, t in enumerate(terms)], "qid int, term_pos int, term string")
    return scores(index, query).select("docid", "score").orderBy(F.desc("score"), "docid").limit(hits)


def thresholds(index: Index, queries: DataFrame, hits: int) -> DataFrame:
    """qid, n_hits, least_score and last_docid: the last of each query's best documents."""
    top = disjunctive(index, queries, hits)
    return top.groupBy("qid").agg(F.count("*").alias("n_hits"), F.min("score").alias("least_score"), F.max_by("docid", "rank").alias("last_docid"))


def retrieve(index: Index, queries: DataFrame, algorithm: str, hits: int = 1000) -> DataFrame:
    """Results of a batch. algorithm: SvS (all terms, every match) or WAND (any term, the best ``hits``)."""
    if algorithm == "SvS":
        return conjunctive(index, queries)
    if algorithm == "WAND":
        return disjunctive(index, queries, hits)
    raise ValueError("algorithm is SvS or WAND")
