import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthmill.llm import contamination as C

ITEM = "Case 813: the licensee of the oak schedule disclaimed the cistern, whereas each foreign developer surrendered the ledger of the mezzanine receipt pursuant to the harvest fair. Is the premium included?"
OTHER = "Question 5: one tenant of the faded gallery measured each boundary in spite of the tax audit so the warden repaid one lodger well ahead of a lightning strike."
FILL = "The flat is bright and near the tram stop. Viewings are held on weekday evenings. "


@pytest.fixture(scope="module")
def index():
    return C.ItemIndex([(1, ITEM), (2, OTHER), (3, ""), (4, None)])


def held(index, *texts):
    return {k for _, k, *_ in index.passages(list(texts))}


def plain_words(text):
    h, _, _, _ = C.words([text])
    return h.tolist()


def changed(text, every, seed=1):
    r = random.Random(seed)
    return " ".join(w if (i + 1) % every else r.choice(["indeed", "thing", "zzz"]) for i, w in enumerate(text.split()))


@pytest.mark.parametrize(
    "passage",
    [
        ITEM,
        ITEM.upper(),
        ITEM.replace(" ", "\n"),
        ITEM.replace(" ", "&nbsp; ").replace(",", ""),
        "<p>" + ITEM.replace("the", "<b>the</b>") + "</p>",
        ITEM.replace("schedule", "sche-\ndule").replace("developer", "de­veloper"),
        changed(ITEM, 6),
        " ".join(ITEM.split()[: int(len(ITEM.split()) * 0.6)]),
        " ".join(ITEM.split()[-int(len(ITEM.split()) * 0.6) :]),
    ],
)
def test_leaks_are_found(index, passage):
    assert held(index, FILL * 3 + passage + " " + FILL * 3) == {1}


@pytest.mark.parametrize(
    "text",
    [
        FILL * 5,
        "",
        FILL + " ".join(ITEM.split()[:9]) + " " + FILL,  # a short quotation
        "Case 9: the lessor of the ash cistern sold the ledger, whereas each local porter rented the hall of the stone house in the course of the harvest fair.",
        " ".join(reversed(ITEM.split())),
        " ".join(w + " " + FILL for w in ITEM.split()),  # scattered words are no passage
    ],
)
def test_harmless_texts(index, text):
    assert held(index, text) == set()


def test_several_items_and_short_ones(index):
    assert held(index, OTHER + FILL + ITEM) == {1, 2}
    short = C.ItemIndex([(7, "Stamp duty"), (8, "Alone")])
    assert held(short, "what is STAMP duty, then?") == {7} and held(short, "left alone here") == {8}


@given(st.lists(st.integers(0, 4), max_size=25), st.lists(st.integers(0, 4), max_size=25))
@settings(max_examples=150, deadline=None)
def test_common_subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = row[:]
        for j, y in enumerate(b):
            row[j + 1] = prev[j] + 1 if x == y else max(prev[j + 1], row[j])
    assert C.common_subsequence(a, b) == row[-1]


def test_words_and_their_places():
    text = "Keep this. <b>Cut</b> &amp; ME_now de\u00advel-\n oper \uff11\uff12 stra\u00dfe"
    h, doc, a, b = C.words(["", text, "cut 12 developer"])
    assert [text[x:y] for x, y, d in zip(a, b, doc, strict=True) if d == 1] == ["Keep", "this", "Cut", "ME", "now", "de\u00advel-\n oper", "\uff11\uff12", "stra\u00dfe"]
    assert h[2] == h[8] and h[6] == h[9] and h[5] == h[10]  # case, full-width digits and breaks aside


DAMAGE = {
    "every 6th word changed": lambda w, r: [x if (i + 1) % 6 else "zz" for i, x in enumerate(w)],
    "every 4th word changed": lambda w, r: [x if (i + 1) % 4 else "zz" for i, x in enumerate(w)],
    "every 3rd word changed": lambda w, r: [x if (i + 1) % 3 else "zz" for i, x in enumerate(w)],
    "every 2nd word changed": lambda w, r: [x if i % 2 == 0 else "zz" for i, x in enumerate(w)],
    "insert after every word": lambda w, r: [y for x in w for y in (x, "zz")],
    "insert after every 2nd word": lambda w, r: [y for i, x in enumerate(w) for y in ((x, "zz") if i % 2 else (x,))],
    "every 3rd word left out": lambda w, r: [x for i, x in enumerate(w) if (i + 1) % 3],
    "first 60 %": lambda w, r: w[: -(-len(w) * 6 // 10)],
    "random 40 % changed": lambda w, r: [x if j else "zz" for x, j in zip(w, r.sample([True] * (len(w) - len(w) * 4 // 10) + [False] * (len(w) * 4 // 10), len(w)), strict=True)],
    "long tags between words": lambda w, r: [y for i, x in enumerate(w) for y in ((x, f'<a title="{"t" * 600}">') if i % 9 == 0 else (x,))],
}


@pytest.mark.parametrize("damage", DAMAGE)
def test_recall_where_half_is_held(damage, spark, data):
    """All test items of the data, damaged, between honest words: nine of ten or more are found, and no item that is not there."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()]
    index, r = C.ItemIndex(items), random.Random(3)
    texts = [FILL + " ".join(DAMAGE[damage](t.split(), r)) + " " + FILL for _, t in items]
    found = {(items[d][0], k) for d, k, *_ in index.passages(texts)}
    right = sum((k, k) in found for k, _ in items)
    assert right >= 0.9 * len(items), right / len(items)
    if "changed" in damage or "out" in damage:
        # an item found in another's text must itself be half held there
        assert len(found) - right <= 0.05 * len(items)


def test_harmless_documents_against_brute_force(spark, data):
    """Every document and item of the small tables: what the pairs let through is all that a search without them finds."""
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{data}/eval_items.parquet").collect()][:80]
    docs = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL").collect()]
    index = C.ItemIndex(items)
    got = {(d, k) for d, k, *_ in index.passages(docs)}
    h, doc, _, _ = C.words(docs)
    seq, _, _ = index.lookup(h, doc)
    want = set()
    for d in range(len(docs)):
        s = seq[doc == d].tolist()
        for k, item in zip(index.ids, index.seqs, strict=True):
            if C.common_subsequence(item, s) >= 0.5 * len(item) and index._verify(item, s):
                want.add((d, k))
    assert got == want


def test_operator_blocks_and_edges(spark):
    docs = spark.createDataFrame([(1, FILL + ITEM, "x"), (2, None, "y"), (3, "", "z"), (4, FILL, None), (5, ITEM + OTHER, "x"), (5, ITEM + OTHER, "x")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None)], "item_id long, text string")
    for size in (500_000, 10):  # one block, and one item a block
        got = sorted((r.doc_id, r.item_id) for r in C.leaks(docs.drop("item_id"), items, block_words=size).collect())
        assert got == [(1, 1), (5, 1), (5, 1), (5, 2), (5, 2)]
    clean = C.without_leaks(docs, items)
    assert clean.columns == docs.columns and clean.count() == 6 and {(4, FILL), (2, None)} <= {(r.doc_id, r.text) for r in clean.collect()}
    assert C.leaks(docs.select("doc_id", "text"), items.limit(0)).count() == 0
    assert C.leaks(clean.select("doc_id", "text"), items).count() == 0
    assert C.leaks(docs.limit(0), items).count() == 0 and C.without_leaks(docs.limit(0), items).count() == 0


@pytest.mark.parametrize("item", [ITEM, ITEM + " " + OTHER])  # 32 and 61 words
@pytest.mark.parametrize("times", [1, 2, 3, 7])
def test_copies_in_a_row_are_a_passage_each(item, times):
    n, before = len(plain_words(item)), len(plain_words(FILL))
    found = C.ItemIndex([(1, item)]).passages([FILL + " ".join([item] * times) + " " + FILL])
    assert sorted((k, a, b, x) for _, k, a, b, _, _, x in found) == [(1, before + i * n, before + (i + 1) * n, 1.0) for i in range(times)]


@pytest.mark.parametrize("passage", [ITEM, " ".join(ITEM.split()[4:]), "zzz " + changed(ITEM, 6) + " zzz"])
def test_words_around_a_passage_stay(index, passage):
    assert plain_words(index.cleaned(FILL + passage + " " + FILL).replace("zzz", "")) == plain_words(FILL + FILL)


@pytest.mark.parametrize("blocks", [500_000, 10])
def test_a_cut_that_joins_another_passage(spark, blocks):
    half = len(ITEM.split()) // 2
    nested = " ".join([*ITEM.split()[:half], OTHER, *ITEM.split()[half:]])
    docs = spark.createDataFrame([(1, FILL + " ".join([ITEM] * 3) + " " + FILL), (2, FILL + nested + " " + FILL), (3, FILL), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(1, OTHER), (2, ITEM)], "item_id long, text string")
    clean = {r.doc_id: r.text and plain_words(r.text) for r in C.without_leaks(docs, items, block_words=blocks).collect()}
    assert clean == {1: plain_words(FILL + FILL), 2: plain_words(FILL + FILL), 3: plain_words(FILL), 4: None}
