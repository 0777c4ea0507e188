"""The registered queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrain.llm import ann, license_scan, line_crf, near_dedup, packing, quality_rules, secret_scan, sentencepiece_codec, token_files, toxicity


def word_bpe() -> str:
    """The place of the tokenizer file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.7)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return sentencepiece_codec.encode(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_crf.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), threshold=0.5)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), word_bpe(), capacity=2048, end_id=0)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(_table(spark, sf_dir, "documents"), word_bpe(), end_id=1)


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.classes(_table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"), threshold=0.5)


def op10_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


QUERIES = {f.__name__: f for f in (op1_toxicity, op2_sentencepiece, op3_line_quality, op4_best_fit_packing, op5_token_files, op6_near_dedup, op7_license_scan, op8_secret_scan, op9_quality_rules, op10_cross_polytope)}


def _secret_sql() -> str:
    """op8 in SQL: matches and the texts between them give the places, and each window's entropy is worked out afresh."""

    def text(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    patterns = [text(x) for x in (secret_scan.ASSIGN, secret_scan.ACCESS, secret_scan.HEX, secret_scan.CANDIDATE)]
    cut = ", ".join(f"string_split_regex(t, {p}) AS p{k}, regexp_extract_all(t, {p}) AS v{k}" for k, p in enumerate(patterns))

    def places(k: int, test: str) -> str:
        start = f"list_sum(list_transform(p{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(v{k}[1:i - 1], lambda x: length(x))), 0)"
        all_of = f"list_transform(range(1, len(v{k}) + 1), lambda i: {{'s': ({start})::BIGINT, 'k': {k}, 'v': v{k}[i], 'b': right(p{k}[i], 24)}})"
        return f"list_transform(list_filter({all_of}, lambda m: {test}), lambda m: {{'s': m.s, 'k': m.k, 'e': m.s + length(m.v)}})"

    n = secret_scan.WINDOW
    bits = f"list_sum(list_transform(map_values(list_histogram(string_split(m.v[j:j + {n - 1}], ''))), lambda c: -(c / {n}.0) * log2(c / {n}.0)))"
    greatest = f"list_max(list_transform(range(1, length(m.v) - {n} + 2), lambda j: {bits}))"
    entropy = f"""regexp_matches(m.v, '[0-9]') AND regexp_matches(m.v, '[A-Za-z]') AND NOT regexp_matches(m.v, {text(secret_scan.ALLOWED)})
      AND NOT regexp_matches(m.b, {text(secret_scan.ALLOWED_BEFORE)})
      AND {greatest} >= CASE WHEN regexp_full_match(m.v, '[0-9a-f]+|[0-9A-F]+') THEN {secret_scan.HEX_BITS} ELSE {secret_scan.WIDE_BITS} END"""
    tests = [f"length(regexp_extract(m.v, {patterns[0]}, 2)) >= {secret_scan.LEAST_VALUE}", "true", "true", entropy]
    every = f"list_concat({places(0, tests[0])}, list_concat({places(1, tests[1])}, list_concat({places(2, tests[2])}, {places(3, tests[3])})))"
    names = "[" + ", ".join(map(text, secret_scan.KINDS)) + "]"

    def joined(found: str) -> str:
        return f"coalesce(array_to_string(list_transform({found}, lambda x: {names}[x.k + 1] || ':' || x.s || ':' || x.e), ','), '')"

    counts = ", ".join(f"len(list_filter(f, lambda x: x.k = {k}))::BIGINT AS n_{name}" for k, name in enumerate(secret_scan.KINDS))
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), c AS (SELECT doc_id, {cut} FROM d),
      e AS (SELECT doc_id, list_sort({every}) AS f FROM c)
      SELECT doc_id, {counts}, sha256({joined("list_filter(f, lambda x: x.k < 3)")}) AS base_sha256, {joined("f")} AS spans FROM e"""


#: The others rest on trained or estimated models, sampling, tokenizer files or an approximate index: tests/llm hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op8_secret_scan": _secret_sql()}
