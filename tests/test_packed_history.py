from datetime import datetime, timedelta

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from hearthmill.operators import history, packed
from tests.conftest import rows

SCHEMA = "id long, source string, v string"


def split(spark, texts, source="s"):
    df = spark.createDataFrame([(i, source, t) for i, t in enumerate(texts)], SCHEMA)
    got = rows(packed.split_values(df, "id", ["v"], "source"))
    return {i: [(r[2], r[3]) for r in got if r[0] == i] for i in range(len(texts))}


# enough plain texts to show which pieces stand on their own
PLAIN = ["Alpha", "Beta", "Gamma", "Delta", "Alpha,Beta", "Beta;Gamma", "Gamma|Alpha", "Delta\tAlpha", "Alpha\nDelta", "X/Y", "R & B", "X/Y,Alpha"]


def test_quotes_brackets_blanks_and_positions(spark):
    texts = [*PLAIN, '"Beta, Gamma";Alpha', '["Alpha", "", "The \\"Q\\" Street"]', "'Alpha; Beta'|'Delta'", "Alpha ,, Beta", '"The ""Q"" Street"', "Beta;", "X/Y; R & B", ",Alpha", "Owner's Pick,Alpha"]
    n = len(PLAIN)
    got = split(spark, [*texts, "Owner's Pick"])
    assert got[n] == [(1, "Beta, Gamma"), (2, "Alpha")]
    assert got[n + 1] == [(1, "Alpha"), (3, 'The "Q" Street')]
    assert got[n + 2] == [(1, "Alpha; Beta"), (2, "Delta")]
    assert got[n + 3] == [(1, "Alpha"), (3, "Beta")]
    assert got[n + 4] == [(1, 'The "Q" Street')]
    assert got[n + 5] == [(1, "Beta")]
    assert got[n + 6] == [(1, "X/Y"), (2, "R & B")]
    assert got[n + 7] == [(2, "Alpha")]
    assert got[n + 8] == [(1, "Owner's Pick"), (2, "Alpha")]


def test_slash_separates_where_its_pieces_combine_freely(spark):
    colours = ["red", "green", "blue", "black"]
    texts = [*colours, *[f"{a}/{b}" for a in colours for b in colours if a != b], "blue/red/green"]
    assert split(spark, texts)[len(texts) - 1] == [(1, "blue"), (2, "red"), (3, "green")]
    bound = ["red/green", "Short-term/Holiday", "Flats & Rooms"] * 9
    assert split(spark, bound)[1] == [(1, "Short-term/Holiday")] and split(spark, bound)[2] == [(1, "Flats & Rooms")]


@pytest.mark.parametrize("mark", ["; ", ",", "|", " ~ ", " - ", "\n"])
def test_lists_of_values_that_never_come_again(mark, spark):
    n = 40
    got = split(spark, [mark.join(f"item{i}{x}" for x in "abc") for i in range(n)])
    assert all(got[i] == [(1, f"item{i}a"), (2, f"item{i}b"), (3, f"item{i}c")] for i in range(n))


def test_a_hyphen_stays_where_it_is_no_mark(spark):
    texts = ["Semi - Detached", "Semi-Detached", "Rent-to-Own", *[f"Semi - Detached,Flat {i}" for i in range(12)]]
    got = split(spark, texts)
    assert got[0] == [(1, "Semi - Detached")] and got[1] == [(1, "Semi-Detached")] and got[2] == [(1, "Rent-to-Own")]


def test_edges(spark):
    assert split(spark, [None, "", "  ", '""', "Alpha"]) == {0: [], 1: [], 2: [], 3: [], 4: [(1, "Alpha")]}
    empty = spark.createDataFrame([], SCHEMA)
    assert packed.split_values(empty, "id", ["v"], "source").count() == 0
    nulls = spark.createDataFrame([(1, None, "a,b"), (2, None, "a"), (3, None, "b"), (3, None, "b")], SCHEMA)
    assert rows(packed.split_values(nulls, "id", ["v"], "source")) == [(1, "v", 1, "a"), (1, "v", 2, "b"), (2, "v", 1, "a"), (3, "v", 1, "b"), (3, "v", 1, "b")]
    long = spark.createDataFrame([(1, "s", ",".join(["w"] * 20000)), (2, "s", "w")], SCHEMA)
    assert packed.split_values(long, "id", ["v"], "source").count() == 20001


def test_join_path_beyond_the_broadcast_bound(spark):
    df = spark.createDataFrame([(1, "s", "a,b"), (2, "s", "a"), (3, "t", "b")], SCHEMA)
    a = packed.split_values(df, "id", ["v"], "source")
    b = packed.split_values(df, "id", ["v"], "source", broadcast_rows=0)
    assert rows(a) == rows(b)


def expected_versions(events):
    """(entity, at, order, value) -> versions, the plain way."""
    last = {}
    for e, at, order, v in events:
        if v is not None and ((e, at) not in last or order >= last[e, at][0]):
            last[e, at] = (order, v)
    out = []
    for e in sorted({k[0] for k in last}):
        line = sorted((at, *x) for (k, at), x in last.items() if k == e)
        versions = [x for i, x in enumerate(line) if not i or line[i - 1][2] != x[2]]
        out += [(e, i + 1, x[1], x[0], versions[i + 1][0] if i + 1 < len(versions) else None, x[2]) for i, x in enumerate(versions)]
    return out


T0 = datetime(2025, 1, 1)
EVENTS = st.lists(st.tuples(st.sampled_from(["a", "b"]), st.integers(0, 12), st.integers(0, 5), st.sampled_from([None, 1, 2, 3])), max_size=40)


@given(EVENTS, st.sampled_from([2, 3, 1000]))
@settings(max_examples=8, deadline=None)
def test_versions_against_plain_fold(spark, events, chunk):
    data = [(e, T0 + timedelta(hours=h), i, v) for i, (e, h, _, v) in enumerate(events)]
    df = spark.createDataFrame(data, "e string, at timestamp_ntz, o long, v int")
    got = history.history(df, "e", "at", "o", ["v"], chunk_rows=chunk).select("e", "version_no", "opening", "valid_from", "valid_to", "v")
    want = expected_versions(data)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_several_attributes_and_as_of(spark):
    data = [("a", T0, 1, 5, "x"), ("a", T0 + timedelta(days=1), 2, 5, None), ("a", T0 + timedelta(days=2), 3, 6, None), (None, T0, 4, 1, "y")]
    df = spark.createDataFrame(data, "e string, at timestamp_ntz, o long, p int, q string")
    s = history.store(df, "e", "at", "o", ["p", "q"])
    assert [tuple(r)[1:3] + tuple(r)[5:] for r in history.versions(s, ["p", "q"]).orderBy("version_no").collect()] == [(1, 1, 5, "x"), (2, 2, 5, None), (3, 3, 6, None)]
    patch = s.where("opening = 2").first().patch
    assert patch.p is None and patch.q.v is None  # only q changed, to null
    now = history.as_of(s, history.F.lit(T0 + timedelta(days=1, hours=2)).cast("timestamp_ntz"), ["p", "q"]).first()
    assert (now.opening, now.p, now.q) == (2, 5, None)
    assert history.history(df.limit(0), "e", "at", "o", ["p"]).count() == 0


def test_checkpoints_within_one_chunk(spark):
    data = [("a", T0 + timedelta(days=d), d, d // 2, "x" if d < 30 else "y") for d in range(40)]  # 20 versions
    s = history.store(spark.createDataFrame(data, "e string, at timestamp_ntz, o long, p int, q string"), "e", "at", "o", ["p", "q"])
    assert [r.opening for r in s.where("is_checkpoint").orderBy("at").collect()] == [0, 16, 32]
    assert [tuple(r)[1:3] + tuple(r)[5:] for r in history.versions(s, ["p", "q"]).orderBy("version_no").collect()] == [(i + 1, 2 * i, i, "x" if i < 15 else "y") for i in range(20)]
    late = s.where("opening >= 16")  # what lies before the nearest checkpoint is not needed
    now = history.as_of(late, history.F.lit(T0 + timedelta(days=31, hours=2)).cast("timestamp_ntz"), ["p", "q"]).first()
    assert (now.opening, now.p, now.q) == (30, 15, "y")


def test_a_burst_is_cut_by_rank(spark):
    """20,000 moments within a second, one a year later, and two small entities: no chunk above its bound, and the same versions."""
    burst = spark.range(20_000).select(F.lit("hot").alias("e"), F.timestamp_micros(F.col("id") * 40).alias("at"), "id", (F.col("id") / 7).cast("int").alias("v"))
    late = spark.createDataFrame([("hot", datetime(1971, 1, 1), 20_000, -1), ("a", T0, 1, 5), ("b", T0, 2, None)], "e string, at timestamp, id long, v int")
    df = burst.unionByName(late)
    cut = history.chunked(history.observed(df, "e", "at", "id", ["v"]), 1000)
    sizes = cut.groupBy("entity", "chunk").count().collect()
    assert max(r["count"] for r in sizes) <= 1000 and sum(r["count"] for r in sizes) == 20_002
    hot = [r for r in history.history(df, "e", "at", "id", ["v"], 1000).collect() if r.e == "hot"]
    assert len(hot) == 20_000 // 7 + 2 and sorted(r.version_no for r in hot) == list(range(1, len(hot) + 1)) and max(r.valid_from for r in hot) == datetime(1971, 1, 1)
