"""Looking into an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltgrain.operators.index import Index, numbered_terms


def postings_of(index: Index, *terms: str) -> DataFrame:
    """term, docid, tf of some terms; none for an unknown term. The terms reach the scan as a pushed filter."""
    return index.postings.filter(F.col("term").isin(list(terms))).select("term", "docid", "tf")


def pairs(index: Index, term: str) -> DataFrame:
    """docid, pair (``docid:tf``) of a term in the order of docids, to be read row by row."""
    return postings_of(index, term).orderBy("docid").select("docid", F.format_string("%d:%d", "docid", "tf").alias("pair"))


def printed(index: Index, term: str) -> DataFrame:
    """For short lists, which have to fit in one row (see pairs()): one line ``docid:tf docid:tf ...`` in the order of docids, or none for an unknown term."""
    pairs = F.sort_array(F.collect_list(F.struct("docid", "tf")))
    line = F.array_join(F.transform(pairs, lambda p: F.format_string("%d:%d", p.docid, p.tf)), " ")
    return postings_of(index, term).groupBy("term").agg(line.alias("line")).select("line")


def listing(index: Index) -> DataFrame:
    """termid, term, df of all terms with postings."""
    return numbered_terms(index).select("termid", "term", "df")
