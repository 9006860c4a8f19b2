import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hearthmill.llm import pagestyle as P

PROSE = [
    "The flat is bright and close to the tram stop, and buses leave for the city every ten minutes.",
    "Viewings are held on weekday evenings, strictly by appointment with the letting agent.",
    "Our contacts report that most tenants stay for more than two years in this part of the town.",
    "If the boiler fails, write to the landlord within five days and keep a copy of the letter.",
    "A notice of 28 days applies where the tenancy has run for less than six months.",
    "The kitchen opens onto a small garden, with a shed and a table for the summer.",
    "Before you sign, ask whether the deposit has been lodged with the scheme.",
    "We looked at a house near the old mill, but the attic smelled of paint.",
]
KEYWORDS = "Rent Cork rent Galway best rent rent deals Mayo. " * 12
LINKS = "\n".join(f"* [flat {i}](https://go.example/{i})" for i in range(20))
TAGS = " ".join(f"#rent{i}" for i in range(40))
TERMS = ", ".join(f"studio, SKU-{i}, 2 bed, oak floors" for i in range(20))


def share(model, *texts):
    return model.odd_shares(P.parse(list(texts))).tolist()


@pytest.fixture(scope="module")
def model(spark, data):
    """Trained on the whole of the small test corpus."""
    return P.train(spark.read.parquet(f"{data}/documents.parquet"))


@pytest.mark.parametrize("spam", [KEYWORDS, KEYWORDS.upper(), LINKS, TAGS, TERMS])
def test_spam_is_odd(model, spam):
    honest = " ".join(PROSE)
    a, b, c = share(model, spam, honest + "\n" + spam[: len(honest) // 3], honest[: len(spam) // 3] + "\n" + spam)
    assert a > 0.8 and b < 0.5 < c


@pytest.mark.parametrize("text", [" ".join(PROSE), " ".join(PROSE).upper(), " ".join(PROSE) + "\nSee https://www.example.com/a for more.\n- oak floors\n- a shed", "<p>" + "</p><p>".join(PROSE) + "</p>"])
def test_prose_is_not(model, text):
    assert share(model, text)[0] < 0.4


def test_prose_that_is_not_of_the_corpus(model):
    """Paragraphs of the language reference: the model has seen only the test corpus, and limits come from there alone."""
    from pydoc_data.topics import topics

    paragraphs = [" ".join(x.split()) for t in topics.values() for x in t.split("\n\n")]
    prose = [x for x in paragraphs if len(x) > 200 and x.endswith(".") and x.count('"') < 4 and "*" not in x and "::=" not in x]
    flagged = sum(x > 0.5 for x in share(model, *prose))
    assert len(prose) > 100 and flagged <= 0.05 * len(prose)


def test_recall_on_planted_spam(model, spark, data):
    """Spam behind the beginning of each honest page of the corpus."""
    docs = spark.read.parquet(f"{data}/documents.parquet").where("length(text) > 200 AND NOT text RLIKE '(#|http|SKU|\\\\|)'").collect()
    pages = [r.text[:150] + "\n" + spam for r in docs for spam in (KEYWORDS, LINKS, TAGS, TERMS)]
    assert len(pages) > 100 and sum(x > 0.5 for x in share(model, *pages)) >= 0.95 * len(pages)


def test_limits_follow_the_model():
    h = np.zeros((3, P.BINS), int)
    assert P.limits_of(h) == P.Limits() and not P.Limits().odd(np.array([99.0]), np.array([5])).any()
    h[0, 100:200] = 10
    lo, hi = P.limits_of(h).low, P.limits_of(h).high
    assert lo[0] == lo[2] < 1.0 and hi[0] == hi[1] > 2.0


def reference(text, near=25, near_pair=40):
    """Tokens one by one: (classes, marks) of each sentence, for plain words, commas, marks and lines."""
    out, seen, pairs, content, tokens, last = [([], [])], {}, {}, 0, 0, None
    functions = {w: g for g, ws in reversed(P.FUNCTION_WORDS.items()) for w in ws.split()}
    for t in re.findall(r"[a-z]+|,|[.!?]+|\n", text):
        if t == "\n":
            out.append(([], []))
            continue
        k, mark = {",": "M"}.get(t, "E" if t[0] in ".!?" else functions.get(t, "c")), "-"
        if k == "c":
            content += 1
            mark = "r" if content - seen.get(t, -99) <= near else "-"
            seen[t] = content
        if t.isalpha():
            if last is not None and not (k != "c" and last in functions):
                if tokens - pairs.get((last, t), -99) <= near_pair:
                    mark = "b"
                    if out[-1][1]:
                        out[-1][1][-1] = "b"
                pairs[last, t] = tokens
            last = t
        else:
            last = None
        tokens += 1
        out[-1][0].append(k)
        out[-1][1].append(mark)
        if k == "E":
            out.append(([], []))
    return [("".join(c), "".join(m)) for c, m in out if c]


@given(st.lists(st.lists(st.sampled_from(["the", "of", "rent", "flat", "cork", "is", ",", ".", "!?", "\n", "it"]), max_size=60).map(" ".join), max_size=4))
@settings(max_examples=150, deadline=None)
def test_tokens_against_a_plain_loop(texts):
    p = P.parse(texts)
    cut = np.split(p.tokens, np.cumsum(p.sizes)[:-1]) if len(p.sizes) else []
    got = [("".join(P.CLASSES[x & 15] for x in t), "".join("-rb"[x >> 4] for x in t)) for t in cut]
    assert got == [x for t in texts for x in reference(t)]


@given(st.lists(st.text(max_size=120), max_size=4))
@settings(max_examples=150, deadline=None)
def test_sentences_cover_the_text(texts):
    p = P.parse(texts)
    at = np.repeat(np.arange(len(texts)), p.sentences)
    total = np.bincount(at, weights=p.chars, minlength=len(texts))
    assert all(n == 0 or t == len(x) for n, t, x in zip(p.sentences, total, texts, strict=True)) and (p.sizes > 0).all() and p.sizes.sum() == len(p.tokens)


def test_token_classes():
    p = P.parse(["It's a 3-bed at €1,200.50. See https://x.ie/a?b=1 or #tag, SKU-9860 x2y!!"])
    assert "".join(P.CLASSES[x & 15] for x in p.tokens) == "cDNXcPNEcUCHMKKE"


def test_operator_edges(spark):
    docs = spark.createDataFrame([(1, " ".join(PROSE), 0.5), (2, KEYWORDS, None), (3, None, 1.0), (4, "", 1.0), (5, " \n ", 1.0), (2, KEYWORDS, None), (6, " ".join(PROSE) * 400, 0.0)], "doc_id long, text string, odd_share double")
    got = sorted((r.doc_id, r.odd_share > 0.5) for r in P.odd_pages(docs).collect())
    assert got == [(1, False), (2, True), (2, True), (5, False), (6, False)]
    assert P.odd_pages(docs.limit(0)).count() == 0
