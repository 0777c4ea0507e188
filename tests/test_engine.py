"""The retrieval engine on small collections whose results are known, and against plain Python."""

import gzip
import math
import random

import pytest
from pyspark.sql import functions as F

from siltgrain import catalog, cli
from siltgrain.functions import hashing
from siltgrain.functions.text import normalized, tokens
from siltgrain.operators import blocks, index, inspect, retrieve
from siltgrain.plans import checks
from siltgrain.sources import collection
from siltgrain.streaming import ingest

MINI = "1\talpha beta gamma \n2\talpha alpha delta \n3\tbeta delta epsilon zeta \n4\t\n5\talpha beta beta \n6\tgamma \n7\tzeta eta \n8\ttheta "
GOLDEN = [
    ("alpha beta", [1, 5], [(5, 0.963415), (1, 0.868220), (2, 0.529305), (3, 0.415338)]),
    ("gamma", [1, 6], [(6, 1.008925), (1, 0.917723)]),
    ("alpha unknown", [1, 2, 5], [(2, 0.529305), (1, 0.434110), (5, 0.434110)]),
    ("unknown", [], []),
    ("beta beta gamma", [1], [(1, 1.785943), (5, 1.058610), (6, 1.008925), (3, 0.830675)]),
    ("zeta theta", [], [(8, 1.699406), (7, 0.961165), (3, 0.878038)]),
    ("beta delta epsilon", [3], [(3, 2.772318), (2, 0.917723), (5, 0.529305), (1, 0.434110)]),
]


@pytest.fixture(scope="module")
def mini(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("c") / "collection"
    path.write_text(MINI)
    docs = collection.read_collection(spark, str(path))
    return index.build(docs, index.Mode.POSITIONAL, df_cutoff=1).cache()


def batch(spark, texts):
    return spark.createDataFrame([(q, i, t) for q, s in enumerate(texts) for i, t in enumerate(s.split())], "qid int, term_pos int, term string")


def test_golden_results(spark, mini):
    queries = batch(spark, [q for q, _, _ in GOLDEN])
    both = {(r.qid, r.docid) for r in retrieve.retrieve(mini, queries, "SvS").collect()}
    assert both == {(i, d) for i, (_, want, _) in enumerate(GOLDEN) for d in want}
    ranked = sorted((r.qid, r["rank"], r.docid, r.score) for r in retrieve.retrieve(mini, queries, "WAND").collect())
    assert ranked == [(i, k, d, s) for i, (_, _, want) in enumerate(GOLDEN) for k, (d, s) in enumerate(want, 1)]
    few = {(r.qid, r.docid) for r in retrieve.disjunctive(mini, queries, 1).collect()}
    assert few == {(i, want[0][0]) for i, (_, _, want) in enumerate(GOLDEN) if want}
    assert retrieve.disjunctive(mini, queries, 0).count() == 0
    for q, want, top in GOLDEN:
        assert sorted(r.docid for r in retrieve.intersection(mini, *q.split()).collect()) == want
        assert [(r.docid, r.score) for r in retrieve.best_of_one(mini, q.split(), 3).collect()] == top[:3]
    assert {(r.qid, r.min_df) for r in retrieve.least_df(mini, queries).collect()} == {(0, 3), (1, 2), (2, 3), (4, 2), (5, 1), (6, 1)}
    assert [r.term for r in retrieve.ordered_terms(mini, batch(spark, ["beta gamma delta beta"])).orderBy("ord").collect()] == ["gamma", "delta", "beta", "beta"]


def test_statistics(mini):
    assert mini.stats.first()[:] == (8, 17, 2.125)
    assert {r.docid: r.doc_len for r in mini.docs.collect()}[4] == 0
    assert {r.term: r.df for r in mini.terms.collect()} == {"alpha": 3, "beta": 3, "delta": 2, "epsilon": 1, "eta": 1, "gamma": 2, "theta": 1, "zeta": 2}
    assert {(r.term, r.docid): r.positions for r in mini.postings.collect()}["beta", 5] == [1, 2]
    assert [(r.termid, r.term) for r in inspect.listing(mini).orderBy("termid").collect()] == list(enumerate(["alpha", "beta", "delta", "epsilon", "eta", "gamma", "theta", "zeta"]))
    assert [r.line for r in inspect.printed(mini, "alpha").collect()] == ["1:1 2:2 5:1"] and not inspect.printed(mini, "none").collect()
    assert {r.term: (r.max_tf, r.max_tf_len) for r in mini.terms.collect()}["alpha"] == (2, 3)


def test_cutoff_and_negative_scores(spark):
    rows = [(i, "often " + ("eight " if i < 8 else "") + ("nine " if i < 9 else "")) for i in range(12)]
    found = index.build(spark.createDataFrame(rows, "docid long, text string"))
    assert {r.term for r in found.terms.collect()} == {"often", "nine"}
    assert {r.term for r in found.postings.collect()} == {"often", "nine"}
    scored = retrieve.disjunctive(found, batch(spark, ["often eight"])).collect()
    assert len(scored) == 12 and all(r.score < 0 for r in scored)


def test_tokens(spark):
    docs = spark.createDataFrame([(1, "a  b "), (2, ""), (3, None), (4, " x")], "docid long, text string")
    assert sorted((r.docid, r.pos, r.term) for r in tokens(docs).collect()) == [(1, 0, "a"), (1, 1, "b"), (4, 0, "x")]
    got = spark.createDataFrame([("Ab-C é9\nD",), (None,)], "t string").select(normalized(F.col("t")).alias("n"))
    assert [r.n for r in got.collect()] == ["ab c 9 d", ""]


def test_files(spark, tmp_path):
    (tmp_path / "a").write_text("1\tx y\n\nbad\tz\n-3\tq\n2\tno end")
    (tmp_path / "b.gz").write_bytes(gzip.compress(b"3\tpacked\n"))
    (tmp_path / "c").write_bytes(gzip.compress(b"4\thidden pack\n5\t"))
    got = collection.read_collection(spark, *(str(tmp_path / n) for n in ("a", "b.gz", "c")))
    assert sorted(map(tuple, got.collect())) == [(1, "x y"), (2, "no end"), (3, "packed"), (4, "hidden pack"), (5, "")]
    (tmp_path / "q").write_text("4\n1 2 a b c\n2 1 x\n1 3 d  e\tf\n3 0 g\n2 1 \n")
    parsed = collection.read_queries(spark, str(tmp_path / "q")).collect()
    assert sorted(map(tuple, parsed)) == [(1, 0, "d"), (1, 1, "e"), (1, 2, "f")]


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c").write_text(MINI)
    (tmp_path / "q").write_text("2\n7 2 alpha beta\n5 1 gamma\n")
    assert cli.main(["indexer", "-index", f"{tmp_path}/i", "-tf", "-cutoff", "1", "-mb", "5", "-input", f"{tmp_path}/c"], spark) == 0
    cli.main(["buildContiguous", "-input", f"{tmp_path}/i", "-output", f"{tmp_path}/j"], spark)
    cli.main(["retrieval", "-index", f"{tmp_path}/j", "-query", f"{tmp_path}/q", "-algorithm", "SvS"], spark)
    assert capsys.readouterr().out.splitlines() == ["q: 5 no: 1", "q: 5 no: 6", "q: 7 no: 1", "q: 7 no: 5"]
    cli.main(["retrieval", "-index", f"{tmp_path}/j", "-query", f"{tmp_path}/q", "-algorithm", "WAND", "-hits", "1", "-output", f"{tmp_path}/r"], spark)
    assert [r.value for r in spark.read.text(f"{tmp_path}/r").collect()] == ["q: 5 no: 6", "q: 7 no: 5"]
    capsys.readouterr()
    assert cli.main(["readPostings", "-index", f"{tmp_path}/j", "-term", "beta"], spark) == 0
    assert cli.main(["readPostings", "-index", f"{tmp_path}/j", "-term", "none"], spark) == 1
    cli.main(["readPostings", "-index", f"{tmp_path}/j"], spark)
    out = capsys.readouterr().out.splitlines()
    assert out[:2] == ["1:1 3:1 5:2 ", "No postings for term none"] and out[2] == "termid: 0  df: 3" and len(out) == 10
    cli.main(["noop", f"{tmp_path}/c"], spark)
    assert capsys.readouterr().out.startswith("tokens: 17 ")
    with pytest.raises(SystemExit):
        cli.main(["retrieval", "-index", "x", "-query", "y"], spark)
    with pytest.raises(ValueError):
        retrieve.retrieve(None, None, "other")


def test_mode_is_kept_and_checked(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b")], "docid long, text string")
    index.build(docs, "nonpositional", 1).write(str(tmp_path / "i"))
    found = index.load(spark, str(tmp_path / "i"))
    assert found.mode is index.Mode.NONPOSITIONAL and found.df_cutoff == 1 and "tf" not in found.postings.columns
    with pytest.raises(ValueError):
        retrieve.scores(found, batch(spark, ["a"]))


def test_batches_against_plain_python(spark):
    rng = random.Random(4)
    texts = {i: [rng.choice("abcdefghij") * rng.randint(1, 2) for _ in range(rng.randint(0, 12))] for i in range(60)}
    found = index.build(spark.createDataFrame([(i, " ".join(t)) for i, t in texts.items()], "docid long, text string"), df_cutoff=9).cache()
    df = {w: n for w in {w for t in texts.values() for w in t} if (n := sum(w in t for t in texts.values())) >= 9}
    queries = [" ".join(rng.choice("abcdefghijz") * rng.randint(1, 2) for _ in range(rng.randint(1, 4))) for _ in range(25)]
    avg = sum(map(len, texts.values())) / len(texts)
    want_all, want_any = set(), {}
    for q, s in enumerate(queries):
        terms = [t for t in s.split() if t in df]
        for d, t in texts.items():
            if terms and all(w in t for w in terms):
                want_all.add((q, d))
            if any(w in t for w in terms):
                want_any[q, d] = round(sum(1.5 * t.count(w) / (0.5 * (0.7 + 0.3 * len(t) / avg) + t.count(w)) * math.log((60 - df[w] + 0.5) / (df[w] + 0.5)) for w in terms if w in t), 6)
    asked = batch(spark, queries)
    assert {(r.qid, r.docid) for r in retrieve.conjunctive(found, asked).collect()} == want_all
    assert {(r.qid, r.docid) for r in retrieve.candidates(found, asked).collect()} == set(want_any)
    got = retrieve.disjunctive(found, asked, 5).collect()
    for hits in (1, 5, 50):
        assert sorted(map(tuple, retrieve.pruned(found, asked, hits).collect())) == sorted(map(tuple, retrieve.disjunctive(found, asked, hits).collect()))
    for q in range(len(queries)):
        best = sorted(((-s, d) for (i, d), s in want_any.items() if i == q))[:5]
        assert [(pytest.approx(r.score, abs=2e-6), r.docid) for r in sorted((r for r in got if r.qid == q), key=lambda r: r["rank"])] == [(-s, d) for s, d in best]


def test_blocks(spark):
    rng = random.Random(9)
    lists = {"a": sorted(rng.sample(range(5000), 300)), "b": [0, 7], "c": list(range(128))}
    rows = [(t, d, 1) for t, ds in lists.items() for d in ds]
    postings = spark.createDataFrame(rows, "term string, docid long, tf int")
    coded = blocks.gaps(postings)
    assert sorted((r.term, r.docid) for r in blocks.from_gaps(coded.drop("docid")).collect()) == sorted((t, d) for t, d, _ in rows)
    table = {(r.term, r.block_no): (r.n, r.first_docid, r.last_docid) for r in blocks.blocks(postings).collect()}
    assert table["a", 2] == (44, lists["a"][256], lists["a"][299]) and len(table) == 5
    assert {r.block_no for r in blocks.skip(postings, "a", lists["a"][130]).collect()} == {1, 2}
    got = {(r.term, r.block_no): r.width for r in blocks.widths(postings).collect()}
    assert set(got) == {("a", 0), ("a", 1), ("c", 0)} and got["c", 0] == 1


def test_blocks_across_chunks_and_modes(spark):
    """Docids of several chunks; every mode has its own columns."""
    rng = random.Random(5)
    ids = sorted(rng.sample(range(1 << 19), 1000))
    rows = [("a", d, 2, [0, 3]) for d in ids] + [("b", 1 << 18, 1, [4])]
    postings = spark.createDataFrame(rows, "term string, docid long, tf int, positions array<int>")
    found = {(r.term, r.block_no): r[2:] for r in blocks.blocks(postings).collect()}
    want = {("a", i): (len(x), x[0], x[-1], 2 * len(x), 2 * len(x)) for i in range(8) if (x := ids[128 * i : 128 * i + 128])}
    assert found == want | {("b", 0): (1, 1 << 18, 1 << 18, 1, 1)}
    assert blocks.blocks(postings.select("term", "docid")).columns == ["term", "block_no", "n", "first_docid", "last_docid"]
    assert sorted((r.term, r.docid) for r in blocks.from_gaps(blocks.gaps(postings.select("term", "docid"))).collect()) == sorted(r[:2] for r in rows)


def test_stored_blocks(spark, tmp_path):
    """Written, read and decoded in every mode; a term with many positions, an odd order of rows, an empty table, and a scan that skips."""
    rng = random.Random(7)
    rows = [("a", d, 300 if d == 5 else 1 + d % 3) for d in rng.sample(range(1000), 400)] + [("b", 1 << 40, 1)]
    rows = [(t, d, n, sorted(rng.sample(range(5000), n))) for t, d, n in rows]
    whole = spark.createDataFrame(rows, "term string, docid long, tf long, positions array<int>")
    for held in (["term", "docid"], ["term", "docid", "tf"], ["term", "docid", "tf", "positions"]):
        path = str(tmp_path / str(len(held)))
        blocks.write(blocks.stored(whole.select(*held)), path)
        written = spark.read.parquet(path)
        assert blocks.decoded(written).columns == held
        assert sorted(tuple(r) for r in blocks.decoded(written).collect()) == sorted(r[: len(held)] for r in rows)
        assert written.agg({"n": "max"}).first()[0] == 128
        assert blocks.decoded(blocks.stored(whole.select(*held).limit(0))).count() == 0
    found = blocks.seek(written, "a", 900)
    plan = found._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(last_docid,900)" in plan and "EqualTo(term,a)" in plan
    assert {r.docid for r in blocks.decoded(found).collect()} >= {d for t, d, *_ in rows if t == "a" and d >= 900}
    assert found.count() < written.filter("term = 'a'").count()



def test_hashes(spark):
    def word(s):
        h = 1159241
        for c in s.encode():
            h ^= ((h << 5) + c + (h >> 2)) % 2**32
        return h & (1 << 27) - 1

    def murmur(x):
        for c in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 1):
            x = (x ^ x >> 33) * c % 2**64
        return x

    def wang(k):
        k = ((k ^ 2**64 - 1) + (k << 21)) % 2**64
        k ^= k >> 24
        k = k * (1 + 2**3 + 2**8) % 2**64
        k ^= k >> 14
        k = k * (1 + 2**2 + 2**4) % 2**64
        k ^= k >> 28
        return k * (1 + 2**31) % 2**64

    def jenkins(a):
        a = (a * (1 + 2**12) + 0x7ED55D16) % 2**64
        a ^= 0xC761C23C ^ a >> 19
        a = (a * (1 + 2**5) + 0x165667B1) % 2**64
        a = (a + 0xD3A2646C) % 2**64 ^ (a << 9) % 2**64
        a = (a * (1 + 2**3) + 0xFD7046C5) % 2**64
        return a ^ 0xB55A4F09 ^ a >> 16

    def murmur_int(x):
        for shift, c in ((16, 0x85EBCA6B), (13, 0xC2B2AE35), (16, 1)):
            x = (x ^ x >> shift) * c % 2**32
            x -= 2**32 * (x >= 2**31)
        return x

    texts, numbers = ["", "a", "hello", "zebra9" * 5], [0, 1, 2, -1, -7, 12345, 2**40 + 3, 123456789012345, -(2**63), 2**63 - 1]
    assert [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").select(hashing.word_hash(F.col("t")).alias("h")).collect()] == [word(t) for t in texts]
    rows = spark.createDataFrame([(n,) for n in numbers], "k long").select(hashing.murmur_mix(F.col("k")).alias("m"), hashing.mul64(F.col("k"), 0xC4CEB9FE1A85EC53).alias("p"), hashing.add64(F.col("k"), F.lit(2**63 - 5)).alias("s")).collect()
    assert [r.m % 2**64 for r in rows] == [murmur(n % 2**64) for n in numbers]
    assert [r.p % 2**64 for r in rows] == [n * 0xC4CEB9FE1A85EC53 % 2**64 for n in numbers]
    assert [r.s % 2**64 for r in rows] == [(n + 2**63 - 5) % 2**64 for n in numbers]
    for n, r in zip(numbers, spark.createDataFrame([(n,) for n in numbers], "k long").select(*(f(F.col("k")).alias(f.__name__) for f in (hashing.shift_mix, hashing.add_xor_mix, hashing.murmur_mix))).collect(), strict=True):
        assert (r.shift_mix % 2**64, r.add_xor_mix % 2**64, r.murmur_mix % 2**64) == (wang(n % 2**64), jenkins(n % 2**64), murmur(n % 2**64))
    small = [0, 1, -1, 12345, -7, 2**31 - 1, -(2**31)]
    assert [r.m for r in spark.createDataFrame([(n,) for n in small], "k int").select(hashing.murmur_mix_int(F.col("k")).alias("m")).collect()] == [murmur_int(n) for n in small]
    code = spark.range(1).select(hashing.pointer(F.lit(3), F.lit(2**32 - 2)).alias("c")).select("c", hashing.pointer_segment(F.col("c")).alias("s"), hashing.pointer_offset(F.col("c")).alias("o")).first()
    assert code[:] == (3 << 32 | 2**32 - 2, 3, 2**32 - 2)


def test_empty_collection(spark):
    found = index.build(spark.createDataFrame([], "docid long, text string"))
    assert found.stats.first()[:] == (0, 0, None)
    assert retrieve.disjunctive(found, batch(spark, ["a b"])).count() == 0 and retrieve.conjunctive(found, batch(spark, ["a"])).count() == 0


def test_lookups_push_their_terms_and_read_few_columns(spark, mini, tmp_path):
    mini.write(str(tmp_path / "i"))
    found = inspect.postings_of(index.load(spark, str(tmp_path / "i")), "alpha", "beta")
    assert any("In(term, [alpha,beta" in p for p in checks.pushed_filters(found))
    assert all("positions" not in c for c in checks.columns_read(found)) and not checks.runs_python(found)


def test_stream_of_documents(spark, tmp_path):
    lines = MINI.split("\n")
    (tmp_path / "in").mkdir()
    for n, some in enumerate((lines[:3], lines[3:])):
        (tmp_path / "in" / f"{n}.txt").write_text("\n".join(some))
        ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    found = ingest.load(spark, str(tmp_path / "out"), df_cutoff=1)
    assert found.stats.first()[:] == (8, 17, 2.125)
    ranked = sorted((r.qid, r["rank"], r.docid, r.score) for r in retrieve.disjunctive(found, batch(spark, [q for q, _, _ in GOLDEN])).collect())
    assert ranked == [(i, k, d, s) for i, (_, _, want) in enumerate(GOLDEN) for k, (d, s) in enumerate(want, 1)]


def test_whole_passages_become_queries(spark, tmp_path):
    passages = {1: "Aa bb, cc dd ee ff gg", 8: "gg ff ee dd cc bb aa hh", 3: "", 4: None}
    texts = [[w for k, w in enumerate(("aa", "bb", "cc", "dd", "ee", "ff", "gg")) if i % (k + 2) or i < 10] for i in range(30)]
    spark.createDataFrame(list(passages.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    asked = {1: "aa bb cc dd ee ff gg".split(), 8: "gg ff ee dd cc bb aa hh".split()}

    def rows(name):
        return sorted(map(tuple, catalog.QUERIES[name](spark, str(tmp_path)).collect()))

    assert rows("query_parse_whole") == sorted((q, k, t) for q, ts in asked.items() for k, t in enumerate(ts))
    assert rows("query_last_wins_whole") == [(1, k, t) for k, t in enumerate(asked[8])]
    df = {t: sum(t in text for text in texts) for t in asked[1]}
    known = [(q, k, t, df[t]) for q, ts in asked.items() for k, t in enumerate(ts) if t in df]
    assert rows("query_term_stats_whole") == sorted(known)
    assert rows("query_term_order_whole") == sorted((q, t, n) for q in asked for n, (_, _, t) in enumerate(sorted((d, k, t) for i, k, t, d in known if i == q), 1))
    assert rows("query_min_df_whole") == [(q, min(df.values())) for q in asked]
    assert rows("svs_batch_whole") == [(q, i) for q in asked for i, text in enumerate(texts) if len(text) == 7]
    assert rows("terms_semi_join_whole") == [(t,) for t in asked[1]]
    avg = sum(map(len, texts)) / 30
    scores = sorted((-round(sum(1.5 / (0.5 * (0.7 + 0.3 * len(text) / avg) + 1) * math.log((30 - df[t] + 0.5) / (df[t] + 0.5)) for t in text), 6), i) for i, text in enumerate(texts) if text)[:10]
    assert rows("wand_topk_whole") == [(q, i, pytest.approx(-s, abs=2e-6), n) for q in asked for i, s, n in sorted((i, s, n) for n, (s, i) in enumerate(scores, 1))]
    assert rows("topk_threshold_whole") == [(q, 10, pytest.approx(-scores[-1][0], abs=2e-6), scores[-1][1]) for q in asked]


@pytest.fixture
def apart(spark):
    """Neither equal exchanges nor small tables nor parts put together save a plan."""
    conf = {"spark.sql.exchange.reuse": "false", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for name, value in conf.items():
        spark.conf.set(name, value)
    yield spark
    for name in conf:
        spark.conf.unset(name)


def test_dictionary_ids_when_no_exchange_is_reused(apart):
    terms = sorted(random.Random(3).sample([f"{a}{b}" for a in "abcdefgh" for b in range(10000)], 30000))
    table = apart.createDataFrame([(t, 9) for t in terms], "term string, df long")
    found = index.Index(index.Mode.TF, 9, None, table, None, None)
    assert sorted((r.termid, r.term) for r in index.dictionary(found).collect()) == list(enumerate(terms))
    assert sorted(tuple(r) for r in inspect.listing(found).collect()) == [(i, t, 9) for i, t in enumerate(terms)]


def test_no_token_moves_unless_docids_repeat(apart):
    docs = apart.createDataFrame([(1, "b a b"), (2, ""), (3, "a"), (4, None)], "docid long, text string")
    want = {"nonpositional": [("a", 1, 3), ("a", 3, 1), ("b", 1, 3)], "tf": [("a", 1, 3, 1), ("a", 3, 1, 1), ("b", 1, 3, 2)]}
    want["positional"] = [(*r, p) for r, p in zip(want["tf"], ([1], [0], [0, 2]), strict=True)]
    for mode, rows in want.items():
        found = index.all_postings(docs, index.Mode(mode))
        assert "Exchange" not in checks.text_of(found)
        assert sorted(map(tuple, found.collect())) == rows
    again = docs.union(apart.createDataFrame([(3, "a c")], "docid long, text string"))
    assert sorted((r.term, r.docid, r.tf) for r in index.all_postings(again).collect()) == [("a", 1, 1), ("a", 3, 2), ("b", 1, 2), ("c", 3, 1)]


def test_postings_stay_where_they_are_for_a_batch(apart):
    docs = apart.createDataFrame([(i, "x " + "y " * (i % 3) + "z " * (i % 2)) for i in range(60)], "docid long, text string")
    found = index.build(docs)
    both = retrieve.intersection(found, "x", "y", "none")
    assert {r.docid for r in both.collect()} == {i for i in range(60) if i % 3}
    asked = batch(apart, ["x y z", "z none"])
    all_of = retrieve.conjunctive(found, asked)
    assert {(r.qid, r.docid) for r in all_of.collect()} == {(0, i) for i in range(60) if i % 3 and i % 2} | {(1, i) for i in range(1, 60, 2)}
    for df in (found.postings, both, all_of, retrieve.thresholds(found, asked, 10), retrieve.disjunctive(found, asked, 10)):
        assert "SortMergeJoin [term" not in checks.text_of(df)


def test_blocks_move_postings_as_arrays(spark):
    postings = spark.createDataFrame([("a", d, 1, [0]) for d in range(300)], "term string, docid long, tf long, positions array<int>")
    for df in (blocks.blocks(postings), blocks.stored(postings)):
        assert "row_number" not in checks.text_of(df)
    assert {(r.block_no, r.n) for r in blocks.blocks(postings).collect()} == {(0, 128), (1, 128), (2, 44)}
