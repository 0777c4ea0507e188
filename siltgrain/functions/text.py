"""Tokens as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def words(text: Column) -> Column:
    """The tokens of an already normalised text: cut at single spaces, empty ones dropped; no tokens for a null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def normalized(text: Column) -> Column:
    """Free text brought into the form that words() takes: lower-case runs of ASCII letters and digits, one space between."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def tokens(docs: DataFrame) -> DataFrame:
    """docid, pos (from 0), term of each token of docs (docid, text)."""
    return docs.select("docid", F.posexplode(words(F.col("text"))).alias("pos", "term"))
