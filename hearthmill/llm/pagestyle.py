"""Keyword-stuffed and link-list pages: perplexity under a prose-trained class model.

Words become classes: groups of function words keep their group, content words
are one class, and numbers, codes, addresses, hash tags and marks have theirs.
An interpolated n-gram model over classes is trained on all prose sentences of
the corpus, those that end like a sentence and hold function words. Its counts are
damped to a power below one, so that it learns which sequences prose uses rather than
how often the templates of one corpus do. Whether a content word, or a pair of
words, repeats one shortly before is scored apart, by how often it does in prose, so
that a chain of repeats stays improbable.

Each sentence or line of a page gets its mean surprise (the log of its
perplexity). What is abnormal follows from the model itself: the limits for each
class of length are the median surprise of the corpus's own prose, plus and minus
``spread`` times the distance from there to its 95th and 5th percentile. A page is
flagged when abnormal sentences make up more than half of its characters.

Everything runs on whole Arrow batches: characters, tokens and sentences are numpy
arrays, no loop touches a token. Model and limits are tables of a fixed size, counted
over all documents and summed in Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmill.session import materialize, ship

# fixed values: closed-class words of English, French, German and Spanish, by group
FUNCTION_WORDS = {
    "D": "the a an this that these those my your his her its our their each every any some no all both such"
    " le la les un une des du de l d ce cette ces mon ma mes son sa ses notre votre leur chaque"
    " der die das den dem des ein eine einen einem einer eines dieser diese dieses kein keine jeder jede zum zur im am vom beim"
    " el los las unos unas este esta estos estas su sus mi cada lo al del",
    "P": "of in to for on at by with from about into over after before between under within without through during against since until per near off up out around outside inside than as"
    " à au aux dans par pour sur avec sans sous chez entre vers depuis en"
    " von mit für auf an bei nach aus um über unter zwischen ohne vor seit durch bis"
    " con por para sin sobre hasta desde",
    "R": "i you he she it we they me him us them who which what there here one"
    " je tu il elle nous vous ils on se qui que y"
    " ich er sie es wir ihr man sich wer was"
    " yo él ella nosotros usted ellos nos me te",
    "A": "is are was were be been being am has have had do does did will would can could may might shall should must not"
    " est sont était ont être avoir fait peut doit ne pas"
    " ist sind war wird werden hat haben kann muss nicht soll bleibt"
    " son está están hay ha han ser puede debe",
    "C": "and or but if so because while although though whereas when where how why yet nor then"
    " et ou mais si car donc quand comme où"
    " und oder aber wenn weil dass sowie als wie dagegen"
    " o pero porque cuando como donde incluso",
}
#: token classes: function-word groups, then content word, number, code, address, hash tag, end mark, comma, other mark, and the sentence's beginning
CLASSES = "DPRAC" + "cNKUHEMX" + "^"
ORDER = 4
_K = 16  # room for a class: four bits
_AT = {c: i for i, c in enumerate(CLASSES)}
_WORDS = _AT["c"]  # classes up to here are words
NEW, AGAIN, PAIR = 0, 1, 2  # marks: a word not used shortly before, one used, a pair of words used

_TAG = re.compile(r"</?[a-zA-Z!][^<>]*>")
_LINK_TAG = re.compile(r"<a\s[^<>]*\bhref", re.IGNORECASE)
_BLOCK_TAG = re.compile(r"</?(?:li|p|div|br|tr|h[1-6]|ul|ol|table|section|article|blockquote)\b", re.IGNORECASE)
_ADDRESS = re.compile(r"(?:https?://|www\.)\S+", re.IGNORECASE)
_HELD = "\ue000"  # stands for the characters of an address

# --- characters -------------------------------------------------------------------------------

_LETTER, _DIGIT, _SPACE, _LINE, _COMMA, _END, _QUOTE, _HYPHEN, _HASH, _MONEY, _LINK, _OTHER = range(12)


def _character_tables() -> tuple[np.ndarray, np.ndarray]:
    """Kind and lower-case form of each character of the basic plane; the one entry behind it stands for all others."""
    kind, low = np.full(65537, _OTHER, np.uint8), np.arange(65537, dtype=np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalpha():
            kind[i] = _LETTER
            if len(x := c.lower()) == 1:
                low[i] = min(ord(x), 65536)
        elif c.isalnum() or c == "_":
            kind[i] = _DIGIT
        elif c.isspace():
            kind[i] = _SPACE
    for chars, k in (("\n", _LINE), (",", _COMMA), (".!?", _END), ("'\u2019", _QUOTE), ("-", _HYPHEN), ("#", _HASH), ("€$£", _MONEY), (_HELD, _LINK)):
        for c in chars:
            kind[ord(c)] = k
    return kind, low


_KIND, _LOW = _character_tables()
_POWER = np.cumprod(np.full(4096, 0x9E3779B97F4A7C15, np.uint64))  # wraps around


def _hashes(codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of characters."""
    offset = np.arange(len(codes)) - np.repeat(starts, lengths)
    return np.add.reduceat((codes.astype(np.uint64) + np.uint64(1)) * _POWER[offset % 4096], starts)


def _function_table() -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of the function words, and the class of each."""
    group = {w: _AT[g] for g, ws in reversed(FUNCTION_WORDS.items()) for w in ws.split()}
    texts = list(group)
    codes = np.array([ord(c) for w in texts for c in w], np.uint32)
    lengths = np.array(list(map(len, texts)))
    h = _hashes(codes, np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(h)
    return h[order], np.array(list(group.values()), np.uint8)[order]


_FUNCTION_HASH, _FUNCTION_CLASS = _function_table()


# --- tokens and sentences ---------------------------------------------------------------------


@dataclass
class Pages:
    """Texts of a batch as tokens (class, and mark in the upper bits) in sentences.

    ``sizes`` and ``chars``: tokens and characters of each sentence; ``sentences``: number of sentences of each text.
    The characters of a text's sentences add up to the text's.
    """

    tokens: np.ndarray
    sizes: np.ndarray
    chars: np.ndarray
    sentences: np.ndarray


def _plain_tag(m: re.Match) -> str:
    """A link is an address, the tag of a block a line end, any other tag blank."""
    n = len(m[0])
    return _HELD * n if _LINK_TAG.match(m[0]) else " " * (n - 1) + "\n" if _BLOCK_TAG.match(m[0]) else " " * n


def _blanked(text: str) -> str:
    """Markup and addresses without their words, at the same length."""
    if "<" in text:
        text = _TAG.sub(_plain_tag, text)
    if "://" in text or "www." in text or "WWW." in text or "Www." in text:
        text = _ADDRESS.sub(lambda m: _HELD * len(m[0]), text)
    return text


def _shifted(x: np.ndarray, by: int, fill: int) -> np.ndarray:
    """``x`` moved right (``by`` > 0) or left."""
    out = np.full_like(x, fill)
    if by > 0:
        out[by:] = x[:-by]
    else:
        out[:by] = x[-by:]
    return out


def _recent(groups: np.ndarray, key: np.ndarray, place: np.ndarray, reach: int) -> np.ndarray:
    """Whether the same key occurs in the same group at most ``reach`` places before."""
    mixed = key + groups.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    order = np.argsort(mixed, kind="stable")  # places grow within a group
    g, k, p = groups[order], key[order], place[order]
    hit = np.zeros(len(order), bool)
    hit[1:] = (g[1:] == g[:-1]) & (k[1:] == k[:-1]) & (p[1:] - p[:-1] <= reach)
    out = np.empty(len(order), bool)
    out[order] = hit
    return out


def _places(groups: np.ndarray) -> np.ndarray:
    """Number of each element within its group (groups are runs)."""
    if not len(groups):
        return np.empty(0, np.int64)
    first = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    return np.arange(len(groups)) - np.repeat(first, np.diff(np.r_[first, len(groups)]))


def parse(texts: list[str], near: int = 25, near_pair: int = 40) -> Pages:
    """Tokens and sentences of texts.

    A word is marked as used before if it is a content word used within the last ``near`` content words, or
    part of a pair of words used within the last ``near_pair`` tokens. Sentences end at end marks and lines.
    """
    lengths = np.array(list(map(len, texts)), np.int64)
    # a line end behind every text keeps runs of two texts apart
    joined = "\n".join(map(_blanked, texts)) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
    kind = _KIND[codes]
    doc = np.repeat(np.arange(len(texts)), lengths + 1)
    prev, nxt = _shifted(kind, 1, _LINE), _shifted(kind, -1, _LINE)
    # marks that belong to the word or number around them
    joins = ((kind == _QUOTE) & (prev == _LETTER) & (nxt == _LETTER)) | ((kind == _HYPHEN) & (prev == _LETTER) & (nxt == _DIGIT))
    joins |= ((kind == _COMMA) | (kind == _END)) & (prev == _DIGIT) & (nxt == _DIGIT)
    leads = ((kind == _HASH) & (nxt <= _DIGIT)) | ((kind == _MONEY) & (nxt == _DIGIT))
    body = (kind <= _DIGIT) | joins
    kept = (kind != _SPACE) & (kind != _LINE)
    goes_on = (body & _shifted((body | leads).astype(np.uint8), 1, 0).astype(bool)) | ((kind == prev) & ((kind == _END) & ~joins & ~_shifted(joins.astype(np.uint8), 1, 0).astype(bool) | (kind == _LINK)))
    starts = np.flatnonzero(kept & ~goes_on)
    if not len(starts):
        return Pages(np.empty(0, np.uint8), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64))
    # a token ends where its run does
    inside = kept & goes_on
    runs = np.flatnonzero(np.r_[~inside, True])
    ends = runs[np.searchsorted(runs, starts + 1)]
    size = ends - starts
    flat = np.repeat(starts, size) + (np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size))
    begin = np.cumsum(size) - size
    letters = np.add.reduceat((kind[flat] == _LETTER).astype(np.int64), begin)
    digits = np.add.reduceat((kind[flat] == _DIGIT).astype(np.int64), begin)
    first = kind[starts]
    cls = np.full(len(starts), _AT["X"], np.uint8)
    for k, c in ((_COMMA, "M"), (_END, "E"), (_LINK, "U")):
        cls[first == k] = _AT[c]
    cls[(letters > 0) & (digits == 0)] = _AT["c"]
    cls[(digits > 0) & (letters == 0)] = _AT["N"]
    cls[(digits > 0) & (letters > 0)] = _AT["K"]
    cls[(first == _HASH) & (size > 1)] = _AT["H"]
    h = _hashes(_LOW[codes[flat]], begin, size)
    at = np.minimum(np.searchsorted(_FUNCTION_HASH, h), len(_FUNCTION_HASH) - 1)
    known = (cls == _WORDS) & (_FUNCTION_HASH[at] == h)
    cls[known] = _FUNCTION_CLASS[at[known]]
    tdoc = doc[starts]
    # sentences: a new one behind an end mark, and behind a line end
    lines = np.cumsum(kind == _LINE)[starts]
    opens = np.r_[True, (cls[:-1] == _AT["E"]) | (lines[1:] != lines[:-1])]
    # repeats
    mark = np.zeros(len(starts), np.uint8)
    content = np.flatnonzero(cls == _WORDS)
    if len(content):
        mark[content[_recent(tdoc[content], h[content], _places(tdoc[content]), near)]] = AGAIN
    word = cls <= _WORDS
    pair = np.flatnonzero(word[1:] & word[:-1] & (tdoc[1:] == tdoc[:-1]) & ((cls[1:] == _WORDS) | (cls[:-1] == _WORDS))) + 1
    if len(pair):
        both = h[pair - 1] * np.uint64(0x9E3779B97F4A7C15) + h[pair]
        again = pair[_recent(tdoc[pair], both, _places(tdoc)[pair], near_pair)]
        mark[again] = PAIR
        mark[again[~opens[again]] - 1] = PAIR
    head = np.flatnonzero(opens)
    sizes = np.diff(np.r_[head, len(starts)])
    sdoc = tdoc[head]
    # a sentence's characters reach to the end of its mark or line, the last one's to the text's end
    last = head + sizes - 1
    line_ends = np.flatnonzero(kind == _LINE)
    stop = np.where(cls[last] == _AT["E"], ends[last], line_ends[np.searchsorted(line_ends, ends[last])] + 1)
    closing = np.r_[sdoc[1:] != sdoc[:-1], True]
    offset = np.cumsum(lengths + 1) - (lengths + 1)
    stop = np.where(closing, offset[sdoc] + lengths[sdoc], stop)
    before = np.r_[0, stop[:-1]]
    before = np.where(np.r_[True, sdoc[1:] != sdoc[:-1]], offset[sdoc], before)
    return Pages(cls | mark << 4, sizes, stop - before, np.bincount(sdoc, minlength=len(texts)))


# --- the model --------------------------------------------------------------------------------


def _grams(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Code of the n-gram that ends at each token, padded at the sentence's beginning."""
    place = np.arange(len(cls)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = cls.astype(np.int32)
    for i in range(1, ORDER):
        code = code + (np.where(place >= i, _shifted(cls, i, 0), _AT["^"]).astype(np.int32) << (4 * i))
    return code


def prose(cls: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sentences the model is trained on: five words or more, a quarter of them function words, ended like a sentence."""
    if not len(sizes):
        return np.empty(0, bool)
    head = np.cumsum(sizes) - sizes
    words, function = np.add.reduceat((cls <= _WORDS).astype(np.int64), head), np.add.reduceat((cls < _WORDS).astype(np.int64), head)
    return (words >= 5) & (function * 4 >= words) & (cls[head + sizes - 1] == _AT["E"])


def count_prose(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram counts, counts of function and content words by mark) over the prose sentences."""
    cls, mark = tokens & 15, tokens >> 4
    good = np.repeat(prose(cls, sizes), sizes)
    grams = np.bincount(_grams(cls, sizes)[good], minlength=_K**ORDER)
    word = good & (cls <= _WORDS)
    return grams, np.bincount((cls[word] == _WORDS) * 3 + mark[word], minlength=6)


class ProseModel:
    """Interpolated class n-gram model with the odds of repeats, as one table of costs in nats."""

    def __init__(self, grams: np.ndarray, repeats: np.ndarray, damping: float = 0.25, backing: float = 8.0) -> None:
        n = grams.astype(np.float64).reshape((_K,) * ORDER) ** damping * (grams.reshape((_K,) * ORDER) > 0)
        p = np.full((_K,), 1 / (len(CLASSES) + 2))
        for left in range(ORDER - 1, -1, -1):
            c = n.sum(axis=tuple(range(left)))
            p = (c + backing * p) / (c.sum(axis=-1, keepdims=True) + backing)
        self.cost = -np.log(p).ravel().astype(np.float32)
        r = repeats.astype(np.float64).reshape(2, 3) + 1
        self.repeat = -np.log(r / r.sum(axis=1, keepdims=True)).astype(np.float32)
        self.limits = Limits()

    def surprise(self, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Sum over the tokens of each sentence."""
        if not len(sizes):
            return np.empty(0)
        cls, mark = tokens & 15, tokens >> 4
        cost = self.cost[_grams(cls, sizes)] + np.where(cls <= _WORDS, self.repeat[(cls == _WORDS).astype(np.int8), mark], 0)
        return np.add.reduceat(cost.astype(np.float64), np.cumsum(sizes) - sizes)

    def odd(self, p: Pages, short: int = 8) -> np.ndarray:
        """Whether the surprise of each sentence is abnormal; a short sentence is scored with its neighbours."""
        if not len(p.sizes):
            return np.empty(0, bool)
        n, total = p.sizes.astype(np.float64), self.surprise(p.tokens, p.sizes)
        sdoc = np.repeat(np.arange(len(p.sentences)), p.sentences)
        with_n, with_total = n.copy(), total.copy()
        same = sdoc[1:] == sdoc[:-1]
        with_n[1:] += np.where(same, n[:-1], 0)
        with_n[:-1] += np.where(same, n[1:], 0)
        with_total[1:] += np.where(same, total[:-1], 0)
        with_total[:-1] += np.where(same, total[1:], 0)
        n, total = np.where(n < short, with_n, n), np.where(n < short, with_total, total)
        return self.limits.odd(total / n, n)

    def odd_shares(self, p: Pages) -> np.ndarray:
        """Share of each text's characters in abnormal sentences; 0 for a text without tokens."""
        sdoc = np.repeat(np.arange(len(p.sentences)), p.sentences)
        bad = np.bincount(sdoc, weights=p.chars * self.odd(p), minlength=len(p.sentences))
        return bad / np.maximum(1, np.bincount(sdoc, weights=p.chars, minlength=len(p.sentences)))


#: classes of length, by their least number of tokens, and the bins of the surprise of a sentence, in nats
LENGTHS = (0, 16, 32)
BIN, BINS = 0.01, 4096


@dataclass
class Limits:
    """Bounds of the mean surprise of prose, for each class of length. Without any prose nothing is abnormal."""

    low: tuple[float, ...] = (0.0,) * len(LENGTHS)
    high: tuple[float, ...] = (float("inf"),) * len(LENGTHS)

    def odd(self, mean: np.ndarray, tokens: np.ndarray) -> np.ndarray:
        c = np.searchsorted(LENGTHS, tokens, side="right") - 1
        return (mean < np.array(self.low)[c]) | (mean > np.array(self.high)[c])


def limits_of(histogram: np.ndarray, spread: float = 2.5, least: int = 50) -> Limits:
    """Limits from the histogram (class of length, bin) of prose sentences; a class of fewer than ``least`` takes those of all."""
    low, high = [], []
    for row in histogram:
        h = row if row.sum() >= least else histogram.sum(axis=0)
        if not h.sum():
            return Limits()
        c = np.cumsum(h) / h.sum()
        q05, mid, q95 = ((np.searchsorted(c, q) + 0.5) * BIN for q in (0.05, 0.5, 0.95))
        low.append(max(0.0, mid - spread * (mid - q05)))
        high.append(mid + spread * (q95 - mid))
    return Limits(tuple(low), tuple(high))


# --- DataFrame operators ----------------------------------------------------------------------


def _ints(x: np.ndarray) -> bytes:
    return x.astype("<i4").tobytes()


def _pages(batch: pa.RecordBatch, first: int) -> Pages:
    """The pages of a batch out of three binary columns: tokens, sizes, chars."""
    t, s, c = (batch.column(first + i).to_pylist() for i in range(3))
    sizes = np.frombuffer(b"".join(s), "<i4").astype(np.int64)
    return Pages(np.frombuffer(b"".join(t), np.uint8), sizes, np.frombuffer(b"".join(c), "<i4").astype(np.int64), np.array([len(x) // 4 for x in s], np.int64))


def decompose(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens, sizes, chars): each text that is not empty as its packed tokens and sentences, about a byte for each token."""
    ship(docs.sparkSession)
    schema = docs.select(key).schema.add("tokens", "binary").add("sizes", "binary").add("chars", "binary")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # a few texts at a time, so that their arrays stay in the processor's cache
        for b in (big.slice(i, 64) for big in batches for i in range(0, big.num_rows, 64)):
            p = parse(b.column(1).to_pylist())
            cut = np.cumsum(p.sentences)[:-1]
            sizes, chars = np.split(p.sizes, cut), np.split(p.chars, cut)
            of_text = np.cumsum([int(x.sum()) for x in sizes])[:-1] if len(sizes) else []
            tokens = np.split(p.tokens, of_text)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *[pa.array([f(x) for x in xs], pa.binary()) for f, xs in ((np.ndarray.tobytes, tokens), (_ints, sizes), (_ints, chars))]],
                names=[key, "tokens", "sizes", "chars"],
            )

    return docs.select(key, text).where(F.length(text) > 0).mapInArrow(split, schema)


def _summed(parts: DataFrame, count) -> list:
    """Rows (k, n) of nonzero counts over all parts; ``count`` takes pages and gives one array of a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            got = count(_pages(b, 0))
            total = got if total is None else total + got
        if total is not None and total.any():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["k", "n"])

    return parts.select("tokens", "sizes", "chars").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()


def _table(rows: list, size: int) -> np.ndarray:
    out = np.zeros(size, np.int64)
    for r in rows:
        out[r.k] = r.n
    return out


def train(docs: DataFrame, text: str = "text", spread: float = 2.5) -> ProseModel:
    """The model of all prose sentences in ``docs``; see :func:`train_on`."""
    return train_on(decompose(docs.select(F.lit(0).alias("k"), text), "k", text), spread)


def train_on(parts: DataFrame, spread: float = 2.5) -> ProseModel:
    """The model of all prose sentences of decomposed texts, with its limits. Two tables are collected, of fixed sizes."""

    def grams(p: Pages) -> np.ndarray:
        return np.concatenate(count_prose(p.tokens, p.sizes))

    t = _table(_summed(parts, grams), _K**ORDER + 6)
    model = ProseModel(t[:-6], t[-6:])

    def surprises(p: Pages) -> np.ndarray:
        good = prose(p.tokens & 15, p.sizes)
        mean = np.minimum((model.surprise(p.tokens, p.sizes)[good] / p.sizes[good] / BIN).astype(np.int64), BINS - 1)
        return np.bincount((np.searchsorted(LENGTHS, p.sizes[good], side="right") - 1) * BINS + mean, minlength=len(LENGTHS) * BINS)

    model.limits = limits_of(_table(_summed(parts, surprises), len(LENGTHS) * BINS).reshape(len(LENGTHS), BINS), spread)
    return model


def odd_pages(docs: DataFrame, key: str = "doc_id", text: str = "text", model: ProseModel | None = None, spread: float = 2.5) -> DataFrame:
    """(key, odd_share): share of each document's characters in sentences that are not prose.

    Null and empty texts have no row; a text without any token has share 0.
    """
    parts = materialize(decompose(docs, key, text), "sentences")  # tokenized once, read by the training and by the scoring
    model = model or train_on(parts, spread)
    schema = docs.select(key).schema.add("odd_share", "double")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.odd_shares(_pages(b, 1)), pa.float64())], names=[key, "odd_share"])

    return parts.mapInArrow(score, schema)
