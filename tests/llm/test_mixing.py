import pytest
from pyspark.sql import functions as F

from hearthmill.llm import mixing as M

pytestmark = pytest.mark.skipif(not __import__("os").path.exists(M.DEFAULT_TOKENIZER), reason="no tokenizer file")


@pytest.fixture
def corpus(spark):
    big = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("big").alias("source"), F.repeat(F.lit("word "), (F.col("id") % 30 + 1).cast("int")).alias("text"))
    tiny = spark.range(60).select((F.col("id") + 10_000).alias("doc_id"), F.lit("tiny").alias("source"), F.repeat(F.lit("rent "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    odd = spark.createDataFrame([(20_000, "big", None), (20_001, "big", ""), (20_002, None, "text"), (20_003, "other", "text")], "doc_id long, source string, text string")
    return big.unionByName(tiny).unionByName(odd)


TARGETS = [("big", 0.9, 1), ("tiny", 0.1, 3)]


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


@pytest.mark.parametrize("chunk", [50_000, 100])
def test_shares_are_reached(spark, corpus, chunk):
    mixture, shares = M.mix(corpus, targets(spark), chunk_rows=chunk)
    s = {r.source: r for r in shares.collect()}
    for name, share, most in TARGETS:
        assert abs(s[name].share - share) < 0.01 and s[name].most_copies <= most
    rows = mixture.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and all(1 <= r.copies for r in rows)
    assert {r.source for r in rows} == {"big", "tiny"} and not {r.doc_id for r in rows} & {20_000, 20_001, 20_002, 20_003}


def test_copies_differ_by_one_at_most_and_sum_to_the_expectation(spark, corpus):
    mixture, shares = M.mix(corpus, targets(spark), budget=30_000)
    s = {r.source: r for r in shares.collect()}
    n = {r.source: r.c for r in mixture.groupBy("source").agg(F.sum("copies").alias("c")).collect()}
    tokens = {r.source: r.t for r in M.token_counts(corpus, "doc_id", "text", ["source"]).groupBy("source").agg(F.sum("n_tokens").alias("t")).collect()}
    for name, share, docs in (("big", 0.9, 4000), ("tiny", 0.1, 60)):
        assert abs(n[name] - docs * min(share * 30_000 / tokens[name], dict((a, c) for a, _, c in TARGETS)[name])) <= 1
    spread = mixture.where("source = 'tiny'").agg(F.min("copies"), F.max("copies")).first()
    assert spread[1] - spread[0] <= 1 and s["tiny"].most_copies <= 3


def test_cap_binds_and_missing_source_is_reported(spark, corpus):
    _, shares = M.mix(corpus, targets(spark, [("big", 0.5, 1), ("tiny", 0.3, 2), ("gone", 0.2, 4)]), budget=10**9)
    s = {r.source: r for r in shares.collect()}
    assert s["tiny"].most_copies == 2 and s["big"].most_copies == 1 and s["gone"].tokens == 0 and s["gone"].share == 0


def test_same_seed_same_mixture(spark, corpus):
    a, b, c = (sorted(map(tuple, M.mix(corpus, targets(spark), budget=20_000, seed=k)[0].collect())) for k in (1, 1, 2))
    assert a == b != c


def test_empty(spark, corpus):
    mixture, shares = M.mix(corpus.limit(0), targets(spark))
    assert mixture.count() == 0 and [r.tokens for r in shares.collect()] == [0, 0]


def test_tokens_round_trip(spark):
    texts = ["Hello world", "café  €1,200\n\n", "", None, "x" * 3000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    enc = M._encoder(M.DEFAULT_TOKENIZER)
    got = {r.doc_id: r.n_tokens for r in M.token_counts(df, "doc_id", "text", []).collect()}
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in texts if t)
