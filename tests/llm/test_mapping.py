import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearthmill.llm import mapping as M


def gram_set(t, q=2):
    s = "^" * (q - 1) + t + "$" * (q - 1)
    seen, out = {}, set()
    for g in [*[s[i : i + q] for i in range(max(1, len(s) - q + 1))], *t]:
        seen[g] = seen.get(g, 0) + 1
        out.add((g, seen[g]))
    return out


def plain_join(left, right, t):
    out = set()
    for a in {x for x in left if x}:
        for b in {x for x in right if x}:
            x, y = gram_set(a), gram_set(b)
            j = len(x & y) / len(x | y)
            if j >= t - 1e-12:
                out.add((a, b, round(j, 9)))
    return out


TEXTS = st.lists(st.text("abc", max_size=8), max_size=15)


@given(TEXTS, TEXTS, st.sampled_from([0.2, 0.5, 0.8]))
@settings(max_examples=6, deadline=None)
def test_join_against_brute_force(spark, left, right, t):
    df = lambda xs: spark.createDataFrame([(x,) for x in [*xs, None, ""]], "text string")
    got = {(r.left_text, r.right_text, round(r.jaccard, 9)) for r in M.similarity_join(df(left), df(right), t).collect()}
    assert got == plain_join(left, right, t)


REF = [(1, "Dublin", "county"), (2, "Cork", "county"), (14, "Westmeath", "county"), (6, "Meath", "county"), (17, "Mayo", "county"), (28, "Cork City", "city"), (32, "State", "state"), (40, "Ardsedgemore", "town"), (41, "Ardsedgeagh", "town")]

RULES = M.PlaceRules(dropped=("ireland", "eire"))

COUNTY = {"DUBLIN": 1, "Co. Dublin.": 1, "CO.CORK": 2, "Csrk": 2, "Mao": 17, "Wesmeath": 14, "MEAUH": 6, "Ardsedgemore, Co. Cork": 2, "Dublin (County)": 1, "Cork, Ireland": 2, "Dúblin": 1, "Ireland": 0, "TBC": 0, "110000": 0, "-": 0, "Area H52": 0, "Cork City": 2}
PLACE = {"Ardsedgemore, Co. Dublin": 40, "ardsedgemoer": 40, "Ardsedgeagh Town": 41, "City of Cork": 28, "Cork (City)": 28, "Cork-City": 28, "CorkC ity": 28, "The State": 32, "Cork": 2, "Co. Cork": 2, "Cork (County)": 2, "Nowhereford, Co. Cork": 0, "101460": 0, "x" * 5000: 0}


@pytest.fixture(scope="module")
def mapped(spark):
    ref = spark.createDataFrame(REF, "location_id int, canonical_name string, kind string")
    rows = [("daft", v, True) for v in COUNTY] + [("cso", v, False) for v in PLACE]
    got = M.map_places(spark.createDataFrame(rows, "src string, value string, county_only boolean"), ref, RULES)
    return {(r.src, r.value): r.location_id for r in got.collect()}


@pytest.mark.parametrize("value,want", COUNTY.items())
def test_county_values(mapped, value, want):
    assert mapped["daft", value] == want


@pytest.mark.parametrize("value,want", PLACE.items())
def test_place_values(mapped, value, want):
    assert mapped["cso", value] == want


def test_empty_inputs(spark):
    ref = spark.createDataFrame(REF, "location_id int, canonical_name string, kind string")
    none = spark.createDataFrame([], "src string, value string, county_only boolean")
    assert M.map_places(none, ref, RULES).count() == 0
    one = spark.createDataFrame([("a", "Cork", False), ("a", "Cork", False)], none.schema)
    assert [r.location_id for r in M.map_places(one, ref.limit(0), RULES).collect()] == [0]
    assert M.map_places(one.withColumn("location_id", F.lit(9)), ref, RULES).count() == 1


@pytest.mark.parametrize("name", ["cork", "mayo", "dublin", "westmeath"])
def test_one_edit_or_swap_stays_above_the_threshold(name):
    """Any letter changed, lost, doubled or swapped with the next: Jaccard similarity alone keeps the name."""
    a = gram_set(name)
    for i in range(len(name)):
        for t in (name[:i] + "#" + name[i + 1 :], name[:i] + name[i + 1 :], name[:i] + name[i] + name[i:], name[:i] + name[i : i + 2][::-1] + name[i + 2 :]):
            assert len(a & gram_set(t)) / len(a | gram_set(t)) >= 0.46, t
