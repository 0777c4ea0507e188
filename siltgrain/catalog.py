"""The registered queries of the retrieval engine and their DuckDB SQL, over whole tables.

Texts of the test tables are free, so they are normalised first (see functions.text.normalized). The query batches are a fixed one and one made of the
first four words of each benchmark passage; the queries named ..._whole take the whole passages. Indexes are kept for the session, postings of small collections only.
"""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltgrain.functions import hashing, scoring
from siltgrain.functions.text import normalized, tokens, words
from siltgrain.operators import blocks, index, inspect, retrieve
from siltgrain.sources import collection

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_KEPT: dict[tuple, index.Index] = {}
BATCH = ((1, "thern anter ention"), (2, "whou inonble"), (3, "the with"), (4, "zzzz whou"), (5, "whou whou inonble"), (6, "zzzz"), (7, "de la"))
TOP = 10
#: Postings stay in the session for collections whose files are at most this large. Larger ones would fill memory and disk to be read once or twice.
KEPT_BYTES = 64 << 20

SQL_DOCS = r"docs AS (SELECT doc_id AS docid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS words FROM documents)"
SQL_TOK = "tok AS (SELECT docid, unnest(words) AS term, unnest(range(len(words))) AS pos FROM docs)"
SQL_POST = "post AS (SELECT term, docid, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2)"
SQL_DF = "dfs AS (SELECT term, count(*)::BIGINT AS df FROM post GROUP BY 1 HAVING count(*) >= 9)"
SQL_DL = "dl AS (SELECT docid, len(words)::BIGINT AS doc_len FROM docs)"
SQL_ST = "st AS (SELECT count(*)::BIGINT AS n_docs, coalesce(sum(doc_len), 0)::BIGINT AS total_len, sum(doc_len)::DOUBLE / count(*) AS avg_len FROM dl)"
SQL_BENCH = r"""q AS (SELECT qid, unnest(t) AS term, unnest(range(len(t)))::INT AS term_pos FROM
  (SELECT item_id::INT AS qid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:4] AS t FROM benchmark))"""
SQL_WHOLE = r"""q AS (SELECT qid, unnest(t) AS term, unnest(range(len(t)))::INT AS term_pos FROM
  (SELECT item_id::INT AS qid, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS t FROM benchmark))"""
SQL_FIXED = f"""q AS (SELECT qid, unnest(t) AS term, unnest(range(len(t)))::INT AS term_pos FROM
  (SELECT qid, string_split(s, ' ') AS t FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in BATCH)}) v(qid, s)))"""
SQL_KQ = "kq AS (SELECT q.qid, q.term_pos, q.term, d.df FROM q JOIN dfs d USING (term))"
SQL_SCORE = """sc AS (SELECT k.qid, p.docid, round(sum((1.5 * p.tf / (0.5 * (0.7 + 0.3 * l.doc_len / st.avg_len) + p.tf)) * ln((st.n_docs - k.df + 0.5) / (k.df + 0.5))), 6) AS score
  FROM kq k JOIN post p USING (term) JOIN dl l USING (docid) CROSS JOIN st GROUP BY 1, 2)"""
SQL_RANKED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, docid)::BIGINT AS rank FROM sc), top AS (SELECT * FROM rk WHERE rank <= {TOP})"
SQL_AND = """met AS (SELECT k.qid, p.docid, count(*) AS met FROM (SELECT DISTINCT qid, term FROM kq) k JOIN post p USING (term) GROUP BY 1, 2),
  need AS (SELECT qid, count(DISTINCT term) AS need FROM kq GROUP BY 1), both_ AS (SELECT met.qid, met.docid FROM met JOIN need USING (qid) WHERE met = need)"""
SQL_KEPT = "kept AS (SELECT post.* FROM post JOIN dfs USING (term))"
SQL_NUM = "num AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY docid) - 1) // 128 AS block_no, (row_number() OVER (PARTITION BY term ORDER BY docid) - 1) % 128 AS block_pos FROM kept)"
SQL_GAP = "gap AS (SELECT *, docid - coalesce(lag(docid) OVER (PARTITION BY term, block_no ORDER BY docid), 0) AS gap FROM num)"


def query(sql: str | None = None, *ctes: str):
    """Registers a query under its function's name, with SQL after WITH and the given parts."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = (f"WITH {', '.join(ctes)} " if ctes else "") + sql
        return f

    return keep


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Only a session on one machine may leave it unset: its temporary folder is not seen by executors elsewhere."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not known and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set")
    return (known or tempfile.gettempdir()).rstrip("/")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("docid"), normalized(F.col("text")).alias("text"))


def kept_index(spark: SparkSession, sf_dir: str, mode: index.Mode = index.Mode.TF, df_cutoff: int = index.DF_CUTOFF) -> index.Index:
    key = (spark.sparkContext.applicationId, sf_dir, mode, df_cutoff)
    if key not in _KEPT:
        table = docs(spark, sf_dir)
        size = int(str(table._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        _KEPT[key] = index.build(table, mode, df_cutoff).cache(postings=size <= KEPT_BYTES)
    return _KEPT[key]


def fixed_batch(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(q, i, t) for q, s in BATCH for i, t in enumerate(s.split(" "))], "qid int, term_pos int, term string")


def benchmark_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.slice(words(normalized(F.col("text"))), 1, 4)
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("int").alias("qid"), F.posexplode(first).alias("term_pos", "term"))


def passage_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All words of each benchmark passage."""
    every = words(normalized(F.col("text")))
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(F.col("item_id").cast("int").alias("qid"), F.posexplode(every).alias("term_pos", "term"))


@query("SELECT doc_id AS docid, array_to_string(words, ' ') AS text FROM (SELECT docid AS doc_id, words FROM docs)", SQL_DOCS)
def scan_documents(spark, sf_dir):
    lines = docs(spark, sf_dir).select(F.concat_ws("\t", F.col("docid").cast("string"), "text").alias("value"))
    return collection.parse_collection(lines)


@query("SELECT docid, pos::INT AS pos, term FROM tok", SQL_DOCS, SQL_TOK)
def tokenize(spark, sf_dir):
    return tokens(docs(spark, sf_dir))


@query("SELECT coalesce(sum(len(words)), 0)::BIGINT AS n_tokens FROM docs", SQL_DOCS)
def token_count(spark, sf_dir):
    return docs(spark, sf_dir).agg(F.coalesce(F.sum(F.size(words(F.col("text")))), F.lit(0)).cast("bigint").alias("n_tokens"))


@query("SELECT docid, doc_len FROM dl", SQL_DOCS, SQL_DL)
def doc_length(spark, sf_dir):
    return index.doc_lengths(docs(spark, sf_dir))


@query("SELECT n_docs, total_len, round(avg_len, 6) AS avg_len FROM st", SQL_DOCS, SQL_DL, SQL_ST)
def collection_stats(spark, sf_dir):
    return kept_index(spark, sf_dir).stats.select("n_docs", "total_len", F.round("avg_len", 6).alias("avg_len"))


@query("SELECT term, (row_number() OVER (ORDER BY term) - 1)::BIGINT AS termid FROM dfs", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def dictionary(spark, sf_dir):
    return index.dictionary(kept_index(spark, sf_dir))


@query("SELECT count(DISTINCT term)::BIGINT AS n_terms FROM tok", SQL_DOCS, SQL_TOK)
def vocab_size(spark, sf_dir):
    return tokens(docs(spark, sf_dir)).select("term").distinct().agg(F.count("*").alias("n_terms"))


@query("SELECT term, docid, tf FROM post", SQL_DOCS, SQL_TOK, SQL_POST)
def term_frequency(spark, sf_dir):
    return index.all_postings(docs(spark, sf_dir)).select("term", "docid", "tf")


@query("SELECT term, count(*)::BIGINT AS df FROM post GROUP BY 1", SQL_DOCS, SQL_TOK, SQL_POST)
def document_frequency(spark, sf_dir):
    return index.all_postings(docs(spark, sf_dir), index.Mode.NONPOSITIONAL).groupBy("term").agg(F.count("*").alias("df"))


@query("SELECT term, count(*)::BIGINT AS cf FROM tok GROUP BY 1", SQL_DOCS, SQL_TOK)
def collection_frequency(spark, sf_dir):
    return tokens(docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("cf"))


@query("SELECT term, df FROM dfs", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def df_cutoff(spark, sf_dir):
    return kept_index(spark, sf_dir).terms.select("term", "df")


@query("SELECT t.term, t.docid, string_agg(t.pos, ',' ORDER BY t.pos) AS positions FROM tok t JOIN dfs USING (term) GROUP BY 1, 2", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def positions(spark, sf_dir):
    found = index.build(docs(spark, sf_dir), index.Mode.POSITIONAL).postings
    return found.select("term", "docid", F.array_join(F.transform("positions", lambda p: p.cast("string")), ",").alias("positions"))


@query("SELECT term, tf AS max_tf, doc_len AS max_tf_len FROM (SELECT kept.*, doc_len, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_len, docid) AS rn FROM kept JOIN dl USING (docid)) WHERE rn = 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_KEPT)
def max_tf_posting(spark, sf_dir):
    return kept_index(spark, sf_dir).terms.select("term", "max_tf", "max_tf_len")


@query("SELECT qid, term_pos, term FROM q", SQL_BENCH)
def query_parse(spark, sf_dir):
    found = benchmark_batch(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term_pos", "term"))).alias("t"))
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.size("t").cast("string"), F.array_join("t.term", " "))
    return collection.parse_queries(found.select(line.alias("value"), F.lit(1).cast("bigint").alias("seq")))


@query("SELECT qid, unnest(t) AS term, unnest(range(len(t)))::INT AS term_pos FROM (SELECT (item_id % 7)::INT AS qid, max_by(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')[1:3], item_id) AS t FROM benchmark GROUP BY 1)")
def query_last_wins(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    line = F.concat_ws(" ", (F.col("item_id") % 7).cast("string"), F.lit("3"), normalized(F.col("text")))
    return collection.parse_queries(table.select(line.alias("value"), F.col("item_id").alias("seq")))


@query("SELECT qid, term_pos, term FROM kq", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_FIXED, SQL_KQ)
def query_drop_unknown(spark, sf_dir):
    return retrieve.known_terms(kept_index(spark, sf_dir), fixed_batch(spark)).select("qid", "term_pos", "term")


@query("SELECT qid, term_pos, term, df FROM kq", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_BENCH, SQL_KQ)
def query_term_stats(spark, sf_dir):
    return retrieve.known_terms(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir))


@query("SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY df, term_pos)::BIGINT AS ord FROM kq", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_BENCH, SQL_KQ)
def query_term_order(spark, sf_dir):
    return retrieve.ordered_terms(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir)).select("qid", "term", "ord")


@query("SELECT qid, min(df) AS min_df FROM kq GROUP BY 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_BENCH, SQL_KQ)
def query_min_df(spark, sf_dir):
    return retrieve.least_df(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir))


@query("SELECT docid FROM kept WHERE term = 'whou'", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def svs_single_term(spark, sf_dir):
    return retrieve.intersection(kept_index(spark, sf_dir), "whou")


@query("SELECT docid FROM kept WHERE term = 'the' INTERSECT SELECT docid FROM kept WHERE term = 'with'", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def svs_two_terms(spark, sf_dir):
    return retrieve.intersection(kept_index(spark, sf_dir), "the", "with")


@query("SELECT docid FROM kept WHERE term IN ('the', 'with', 'that', 'of') GROUP BY 1 HAVING count(*) = 4", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def svs_multi(spark, sf_dir):
    return retrieve.intersection(kept_index(spark, sf_dir), "the", "zzzz", "with", "that", "of")


@query("SELECT qid, docid FROM both_", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_BENCH, SQL_KQ, SQL_AND)
def svs_batch(spark, sf_dir):
    return retrieve.conjunctive(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir))


@query("SELECT docid FROM kept WHERE term = 'the' INTERSECT SELECT docid FROM kept WHERE term = 'that'", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def svs_intersect_setop(spark, sf_dir):
    found = kept_index(spark, sf_dir)
    one, two = (inspect.postings_of(found, t).select("docid") for t in ("the", "that"))
    return one.intersect(two)


@query("SELECT DISTINCT qid, docid FROM kq JOIN post USING (term)", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_FIXED, SQL_KQ)
def disjunctive_candidates(spark, sf_dir):
    return retrieve.candidates(kept_index(spark, sf_dir), fixed_batch(spark))


@query("SELECT term, round(ln((n_docs - df + 0.5) / (df + 0.5)), 6) AS idf FROM dfs CROSS JOIN st", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST)
def bm25_idf(spark, sf_dir):
    found = kept_index(spark, sf_dir)
    return found.terms.crossJoin(F.broadcast(found.stats)).select("term", F.round(scoring.idf(F.col("n_docs"), F.col("df")), 6).alias("idf"))


@query("SELECT term, docid, round(1.5 * tf / (0.5 * (0.7 + 0.3 * doc_len / avg_len) + tf), 6) AS tf_part FROM kept JOIN dl USING (docid) CROSS JOIN st", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_KEPT)
def bm25_tf(spark, sf_dir):
    found = kept_index(spark, sf_dir)
    part = scoring.tf_part(F.col("tf"), F.col("doc_len"), F.col("avg_len"))
    return found.postings.crossJoin(F.broadcast(found.stats)).select("term", "docid", F.round(part, 6).alias("tf_part"))


@query("SELECT qid, docid, score FROM sc", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_FIXED, SQL_KQ, SQL_SCORE)
def bm25_score(spark, sf_dir):
    return retrieve.scores(kept_index(spark, sf_dir), fixed_batch(spark))


@query("""SELECT term, round((1.5 * tf / (0.5 * (0.7 + 0.3 * doc_len / avg_len) + tf)) * ln((n_docs - df + 0.5) / (df + 0.5)), 6) AS ub FROM
  (SELECT kept.*, doc_len, row_number() OVER (PARTITION BY term ORDER BY tf DESC, doc_len, docid) AS rn FROM kept JOIN dl USING (docid)) JOIN dfs USING (term) CROSS JOIN st WHERE rn = 1""", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_KEPT)  # fmt: skip
def term_upper_bound(spark, sf_dir):
    return index.upper_bounds(kept_index(spark, sf_dir)).select("term", F.round("ub", 6).alias("ub"))


@query("SELECT docid, score FROM top WHERE qid = 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_FIXED, SQL_KQ, SQL_SCORE, SQL_RANKED)
def topk_single_query(spark, sf_dir):
    return retrieve.best_of_one(kept_index(spark, sf_dir), BATCH[0][1].split(" "), TOP)


@query("SELECT qid, count(*)::BIGINT AS n_hits, min(score) AS least_score, max_by(docid, rank) AS last_docid FROM top GROUP BY 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_BENCH, SQL_KQ, SQL_SCORE, SQL_RANKED)
def topk_threshold(spark, sf_dir):
    return retrieve.thresholds(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir), TOP)


@query("SELECT qid, docid, score, rank FROM top", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_BENCH, SQL_KQ, SQL_SCORE, SQL_RANKED)
def wand_topk(spark, sf_dir):
    return retrieve.retrieve(kept_index(spark, sf_dir), benchmark_batch(spark, sf_dir), "WAND", TOP)


@query("SELECT qid, docid, score, rank FROM top", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_FIXED, SQL_KQ, SQL_SCORE, SQL_RANKED)
def maxscore_prune(spark, sf_dir):
    return retrieve.pruned(kept_index(spark, sf_dir), fixed_batch(spark), TOP)


@query("SELECT qid, docid, score, rank FROM top", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_FIXED, SQL_KQ, SQL_SCORE, SQL_RANKED)
def wand_topk_duplicates(spark, sf_dir):
    return retrieve.disjunctive(kept_index(spark, sf_dir), fixed_batch(spark), TOP)


@query("SELECT qid, rank AS place, 'q: ' || qid || ' no: ' || docid AS line FROM top", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_FIXED, SQL_KQ, SQL_SCORE, SQL_RANKED)
def result_lines(spark, sf_dir):
    return collection.result_lines(retrieve.disjunctive(kept_index(spark, sf_dir), fixed_batch(spark), TOP))


@query("SELECT string_agg(docid || ':' || tf, ' ' ORDER BY docid) AS line FROM kept WHERE term = 'whou' HAVING count(*) > 0", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def postings_lookup(spark, sf_dir):
    return inspect.printed(kept_index(spark, sf_dir), "whou")


@query("SELECT (row_number() OVER (ORDER BY term) - 1)::BIGINT AS termid, term, df FROM dfs", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def df_listing(spark, sf_dir):
    return inspect.listing(kept_index(spark, sf_dir))


@query("SELECT DISTINCT term FROM q WHERE term IN (SELECT term FROM dfs)", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_BENCH)
def terms_semi_join(spark, sf_dir):
    return benchmark_batch(spark, sf_dir).select("term").join(kept_index(spark, sf_dir).terms, "term", "left_semi").distinct()


@query("SELECT term, block_no::BIGINT AS block_no, count(*)::BIGINT AS n, min(docid) AS first_docid, max(docid) AS last_docid, sum(tf)::BIGINT AS total_tf FROM num GROUP BY 1, 2", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM)
def block_postings(spark, sf_dir):
    return blocks.blocks(kept_index(spark, sf_dir).postings)


@query("SELECT term, block_no::BIGINT AS block_no, count(*)::BIGINT AS n, min(docid) AS first_docid, max(docid) AS last_docid, sum(tf)::BIGINT AS total_tf, sum(tf)::BIGINT AS n_values FROM num GROUP BY 1, 2", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM)
def block_positions(spark, sf_dir):
    return blocks.blocks(index.build(docs(spark, sf_dir), index.Mode.POSITIONAL).postings)


@query("SELECT * FROM (SELECT term, block_no::BIGINT AS block_no, count(*)::BIGINT AS n, min(docid) AS first_docid, max(docid) AS last_docid, sum(tf)::BIGINT AS total_tf FROM num WHERE term = 'the' GROUP BY 1, 2) WHERE last_docid >= 400", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM)
def block_skip_table(spark, sf_dir):
    return blocks.skip(kept_index(spark, sf_dir).postings, "the", 400)


@query("SELECT term, docid, block_no::BIGINT AS block_no, block_pos::BIGINT AS block_pos, gap FROM gap", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM, SQL_GAP)
def docid_gaps(spark, sf_dir):
    return blocks.gaps(kept_index(spark, sf_dir).postings)


@query("SELECT term, docid FROM kept", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def docid_gaps_roundtrip(spark, sf_dir):
    return blocks.from_gaps(blocks.gaps(kept_index(spark, sf_dir).postings).drop("docid"))


@query("SELECT term, docid, tf FROM kept", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT)
def index_roundtrip(spark, sf_dir):
    path = f"{shared_dir(spark)}/siltgrain-index-{uuid.uuid4().hex}"
    kept_index(spark, sf_dir).write(path)
    return index.load(spark, path).postings.select("term", "docid", "tf")


def _written_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of the positional index, written and read again."""
    path = f"{shared_dir(spark)}/siltgrain-blocks-{uuid.uuid4().hex}"
    blocks.write(blocks.stored(kept_index(spark, sf_dir, index.Mode.POSITIONAL).postings), path)
    return spark.read.parquet(path)


def _listed(values) -> Column:
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")


SQL_PGAP = """pgap AS (SELECT t.term, t.docid, t.pos, t.pos - coalesce(lag(t.pos) OVER (PARTITION BY t.term, t.docid ORDER BY t.pos), 0) AS gap, n.block_no
  FROM tok t JOIN num n USING (term, docid)), pblock AS (SELECT term, block_no, count(*)::BIGINT AS n_values, string_agg(gap, ',' ORDER BY docid, pos) AS position_gaps FROM pgap GROUP BY 1, 2)"""


@query("""SELECT term, block_no::BIGINT AS block_no, count(*)::BIGINT AS n, min(docid) AS first_docid, max(docid) AS last_docid, string_agg(gap, ',' ORDER BY docid) AS gaps,
  string_agg(tf, ',' ORDER BY docid) AS tfs, n_values, position_gaps FROM gap JOIN pblock USING (term, block_no) GROUP BY 1, 2, n_values, position_gaps""",
    SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM, SQL_GAP, SQL_PGAP)
def stored_blocks(spark, sf_dir):
    found = _written_blocks(spark, sf_dir)
    return found.select("term", "block_no", "n", "first_docid", "last_docid", _listed("gaps").alias("gaps"), _listed("tfs").alias("tfs"), "n_values", _listed("position_gaps").alias("position_gaps"))


@query("SELECT t.term, t.docid, count(*)::BIGINT AS tf, string_agg(t.pos, ',' ORDER BY t.pos) AS positions FROM tok t JOIN dfs USING (term) GROUP BY 1, 2", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def stored_blocks_roundtrip(spark, sf_dir):
    found = blocks.decoded(_written_blocks(spark, sf_dir))
    return found.select("term", "docid", "tf", _listed("positions").alias("positions"))


@query("SELECT p.docid, p.tf FROM post p JOIN dfs USING (term) WHERE term = 'the' AND docid >= 400", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF)
def block_seek(spark, sf_dir):
    """A term's postings from a docid on, from stored blocks: those that end before it are not decoded."""
    return blocks.decoded(blocks.seek(_written_blocks(spark, sf_dir), "the", 400)).filter(F.col("docid") >= 400).select("docid", "tf")


@query(f"""SELECT term, block_no::BIGINT AS block_no, arg_min(w, cost * 100 + w)::BIGINT AS width FROM (SELECT term, block_no, w, w * 128 + 32 * count(*) FILTER (gap >= (1::BIGINT << w)) AS cost FROM gap
  CROSS JOIN (SELECT unnest([{", ".join(map(str, blocks.WIDTHS))}]) AS w) GROUP BY 1, 2, 3 HAVING count(*) = 128) GROUP BY 1, 2""", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_KEPT, SQL_NUM, SQL_GAP)  # fmt: skip
def codec_bit_width(spark, sf_dir):
    return blocks.widths(kept_index(spark, sf_dir).postings)


@query("SELECT o_orderkey AS k, o_custkey AS seg, o_orderkey % 1000003 AS off, (o_custkey::BIGINT << 32) | (o_orderkey % 1000003) AS code FROM orders")
def pointer_codec(spark, sf_dir):
    code = hashing.pointer(F.col("o_custkey"), F.col("o_orderkey") % 1000003)
    coded = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"), code.alias("code"))
    return coded.select("k", hashing.pointer_segment(F.col("code")).alias("seg"), hashing.pointer_offset(F.col("code")).alias("off"), "code")


@query("SELECT term, list_reduce(list_prepend(1159241::BIGINT, list_transform(string_split(term, ''), lambda c: ascii(c)::BIGINT)), lambda h, c: xor(h, ((h << 5) + c + (h >> 2)) & 4294967295)) & 134217727 AS hash FROM (SELECT DISTINCT term FROM tok)", SQL_DOCS, SQL_TOK)
def hash_bitwise(spark, sf_dir):
    return tokens(docs(spark, sf_dir)).select("term").distinct().select("term", hashing.word_hash(F.col("term")).alias("hash"))


def _mixer_sql() -> str:
    """The four integer mixers over unsigned 128-bit numbers, reduced modulo 2 ** 64 or 2 ** 32 at each step; a step names the value before it as x."""
    m64, m32 = (f"{1 << n}::UHUGEINT" for n in (64, 32))

    def big(x: int) -> str:
        return f"{x}::UHUGEINT"

    def up(n: int) -> str:
        return f"x * {big(1 << n)} % {m64}"

    def down(n: int) -> str:
        return f"x // {big(1 << n)}"

    def down_signed(n: int) -> str:
        return f"(x // {big(1 << n)} + CASE WHEN x >= {big(1 << 31)} THEN {big(((1 << n) - 1) << (32 - n))} ELSE {big(0)} END)"

    j, m, n = hashing.JENKINS, hashing.MURMUR_64, hashing.MURMUR_32
    steps = {
        "shift_mix": [f"({big((1 << 64) - 1)} - x + {up(21)}) % {m64}", f"xor(x, {down(24)})", f"(x + {up(3)} + {up(8)}) % {m64}", f"xor(x, {down(14)})", f"(x + {up(2)} + {up(4)}) % {m64}", f"xor(x, {down(28)})", f"(x + {up(31)}) % {m64}"],
        "add_xor_mix": [f"(x + {big(j[0])} + {up(12)}) % {m64}", f"xor(xor(x, {big(j[1])}), {down(19)})", f"(x + {big(j[2])} + {up(5)}) % {m64}", f"xor((x + {big(j[3])}) % {m64}, {up(9)})", f"(x + {big(j[4])} + {up(3)}) % {m64}", f"xor(xor(x, {big(j[5])}), {down(16)})"],
        "murmur_mix": [f"xor(x, {down(33)})", f"x * {big(m[0])} % {m64}", f"xor(x, {down(33)})", f"x * {big(m[1])} % {m64}", f"xor(x, {down(33)})"],
        "murmur_mix_int": [f"xor(x, {down_signed(16)})", f"x * {big(n[0])} % {m32}", f"xor(x, {down_signed(13)})", f"x * {big(n[1])} % {m32}", f"xor(x, {down_signed(16)})"],
    }
    out = []
    for name, chain in steps.items():
        bits, kind = (32, "INT") if name.endswith("int") else (64, "BIGINT")
        value = f"(k::HUGEINT % {1 << bits}::HUGEINT + {1 << bits}::HUGEINT) % {1 << bits}::HUGEINT"
        found = f"SELECT k, ({value})::UHUGEINT AS x FROM keys"
        for step in chain:
            found = f"SELECT k, {step} AS x FROM ({found})"
        out.append(f"{name} AS (SELECT k, (CASE WHEN x >= {big(1 << (bits - 1))} THEN x::HUGEINT - {1 << bits}::HUGEINT ELSE x::HUGEINT END)::{kind} AS {name} FROM ({found}))")
    return f"WITH keys AS (SELECT o_orderkey AS k FROM orders), {', '.join(out)} SELECT * FROM shift_mix JOIN add_xor_mix USING (k) JOIN murmur_mix USING (k) JOIN murmur_mix_int USING (k)"


@query(_mixer_sql())
def hash_int_mix(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("k"))
    k = F.col("k")
    return table.select("k", hashing.shift_mix(k).alias("shift_mix"), hashing.add_xor_mix(k).alias("add_xor_mix"), hashing.murmur_mix(k).alias("murmur_mix"), hashing.murmur_mix_int(k).alias("murmur_mix_int"))


@query("SELECT DISTINCT l_partkey FROM lineitem")
def int_set_distinct(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey").distinct()


@query("SELECT qid, term_pos, term FROM q", SQL_WHOLE)
def query_parse_whole(spark, sf_dir):
    found = passage_batch(spark, sf_dir).groupBy("qid").agg(F.sort_array(F.collect_list(F.struct("term_pos", "term"))).alias("t"))
    line = F.concat_ws(" ", F.col("qid").cast("string"), F.size("t").cast("string"), F.array_join("t.term", " "))
    return collection.parse_queries(found.select(line.alias("value"), F.lit(1).cast("bigint").alias("seq")))


@query("SELECT qid, unnest(t) AS term, unnest(range(len(t)))::INT AS term_pos FROM (SELECT (item_id % 7)::INT AS qid, max_by(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+'), item_id) AS t FROM benchmark GROUP BY 1)")
def query_last_wins_whole(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    text = normalized(F.col("text"))
    line = F.concat_ws(" ", (F.col("item_id") % 7).cast("string"), F.size(words(text)).cast("string"), text)
    return collection.parse_queries(table.select(line.alias("value"), F.col("item_id").alias("seq")))


@query("SELECT qid, term_pos, term, df FROM kq", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_WHOLE, SQL_KQ)
def query_term_stats_whole(spark, sf_dir):
    return retrieve.known_terms(kept_index(spark, sf_dir), passage_batch(spark, sf_dir))


@query("SELECT qid, term, row_number() OVER (PARTITION BY qid ORDER BY df, term_pos)::BIGINT AS ord FROM kq", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_WHOLE, SQL_KQ)
def query_term_order_whole(spark, sf_dir):
    return retrieve.ordered_terms(kept_index(spark, sf_dir), passage_batch(spark, sf_dir)).select("qid", "term", "ord")


@query("SELECT qid, min(df) AS min_df FROM kq GROUP BY 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_WHOLE, SQL_KQ)
def query_min_df_whole(spark, sf_dir):
    return retrieve.least_df(kept_index(spark, sf_dir), passage_batch(spark, sf_dir))


@query("SELECT qid, docid FROM both_", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_WHOLE, SQL_KQ, SQL_AND)
def svs_batch_whole(spark, sf_dir):
    return retrieve.conjunctive(kept_index(spark, sf_dir), passage_batch(spark, sf_dir))


@query("SELECT qid, count(*)::BIGINT AS n_hits, min(score) AS least_score, max_by(docid, rank) AS last_docid FROM top GROUP BY 1", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_WHOLE, SQL_KQ, SQL_SCORE, SQL_RANKED)
def topk_threshold_whole(spark, sf_dir):
    return retrieve.thresholds(kept_index(spark, sf_dir), passage_batch(spark, sf_dir), TOP)


@query("SELECT qid, docid, score, rank FROM top", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_DL, SQL_ST, SQL_WHOLE, SQL_KQ, SQL_SCORE, SQL_RANKED)
def wand_topk_whole(spark, sf_dir):
    return retrieve.retrieve(kept_index(spark, sf_dir), passage_batch(spark, sf_dir), "WAND", TOP)


@query("SELECT DISTINCT term FROM q WHERE term IN (SELECT term FROM dfs)", SQL_DOCS, SQL_TOK, SQL_POST, SQL_DF, SQL_WHOLE)
def terms_semi_join_whole(spark, sf_dir):
    return passage_batch(spark, sf_dir).select("term").join(kept_index(spark, sf_dir).terms, "term", "left_semi").distinct()
