"""Evaluation passages leaking into training text.

The n-grams of the test items are a hash table in a broadcast variable: ordered pairs of
words that stand up to three words apart, so that a pair survives words changed, left out or put
in between. Every training document is scanned once, as a whole, on arrays: words
become hashes, pairs are looked up, and an item is a candidate where its pairs cover enough of its
words. Candidates are then verified: the longest common subsequence of item and
passage, in words, must reach the wanted share of the item, and its bounds are the first and
last of those words. Copies in a row are a passage each. Changed words, markup, case, punctuation and words
broken over lines do not hide a passage; a short quotation and a sentence that
only sounds alike do not reach the share.

An item's pairs that many items have are left out of the search as far as its other pairs
must then still be found, so nothing is lost by it. The table is broadcast in blocks of at
most ``block_words`` words. With more than one block, one scan of the corpus against a bit map of all
pairs, of a fixed size, keeps the documents that can hold any item, and only these meet the blocks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthmill.llm.pagestyle import _hashes, _shifted
from hearthmill.session import materialize, ship

_SKIP = re.compile(r"<[^<>]+>|&(?:[a-zA-Z]{2,8}|#\d{1,6});")
#: a word broken over lines or by a soft hyphen
_BREAK = re.compile(r"(?<=[^\W_])(?:\u00ad|\u200b|[-\u2010][ \t]*\r?\n\s*)(?=[^\W_])")
_JOINER = "\ue001"
#: how far apart the words of a pair stand at most
REACH = 3
#: bits of the map of all pairs, as a power of two
MAP_BITS = 28


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Whether a character of the basic plane belongs to words (1), joins a broken one (2) or neither, and its plain form."""
    kind, plain = np.zeros(65537, np.uint8), np.arange(65537, dtype=np.uint32)
    for i in range(65536):
        c = chr(i)
        if c.isalnum():
            kind[i] = 1
            x = unicodedata.normalize("NFKC", c).casefold()
            plain[i] = ord(x) if len(x) == 1 else i
    kind[65536] = 1  # letters beyond the basic plane: one word character for all
    kind[ord(_JOINER)] = 2
    return kind, plain


_KIND, _PLAIN = _tables()


def _blanked(text: str) -> str:
    """Markup and entities as blanks and breaks inside words as joiners, at the same length."""
    if "<" in text or "&" in text:
        text = _SKIP.sub(lambda m: " " * len(m[0]), text)
    if "\n" in text or "\u00ad" in text or "\u200b" in text:
        text = _BREAK.sub(lambda m: _JOINER * len(m[0]), text)
    return text


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, text number, first character, behind the last character) of each normalised word, markup left out."""
    lengths = np.array(list(map(len, texts)), np.int64)
    joined = "\n".join(map(_blanked, texts)) + "\n"
    codes = np.minimum(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32), 65536)
    kind = _KIND[codes]
    body = kind > 0
    starts = body & ~_shifted(body, 1, False)
    flat = np.flatnonzero(kind == 1)
    if not len(flat):
        return np.empty(0, np.uint64), *[np.empty(0, np.int64)] * 3
    token = (np.cumsum(starts) - 1)[flat]
    begin = np.flatnonzero(np.r_[True, token[1:] != token[:-1]])
    h = _hashes(_PLAIN[codes[flat]], begin, np.diff(np.r_[begin, len(flat)]))
    first, behind = np.flatnonzero(starts), np.flatnonzero(body & ~_shifted(body, -1, False)) + 1
    ends = np.cumsum(lengths + 1)
    doc = np.searchsorted(ends, first, side="right")
    offset = (ends - lengths - 1)[doc]
    return h, doc, first - offset, behind - offset


def common_subsequence(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over ``a``."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def _running(a: list[int], b: list[int]) -> list[int]:
    """:func:`common_subsequence` of ``a`` with each beginning of ``b``, from one word on."""
    at: dict[int, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = s = (1 << len(a)) - 1
    out = []
    for y in b:
        u = s & at.get(y, 0)
        s = ((s + u) | (s - u)) & full
        out.append(len(a) - s.bit_count())
    return out


def aligned(item: list[int], part: list[int]) -> tuple[int, int, int]:
    """(first, behind the last, number) of the item's words in a part.

    Words at the ends with more than twice as many other words between them and the rest are chance (a *the* of the
    text around) and do not count.
    """
    ends = _running(item, part)
    b = max(range(1, len(part) + 1), key=lambda k: (3 * ends[k - 1] - k, -k))
    starts = _running(item[::-1], part[:b][::-1])
    n = max(range(1, b + 1), key=lambda k: (3 * starts[k - 1] - k, -k))
    return b - n, b, starts[n - 1]


class ItemIndex:
    """Pairs of words of a block of test items.

    ``least``: share of an item's words that its pairs must cover in a text for it to be verified. Where half of the words
    are held as one passage, only those with no other held word within ``REACH`` go uncovered.
    ``common``: a pair of more items than that is left out of an item's search where the rest suffices.
    """

    def __init__(self, items: list[tuple[int, str]], share: float = 0.5, least: float = 0.3, common: int = 16) -> None:
        self.share = share
        h, doc, _, _ = words([t or "" for _, t in items])
        self.vocab = np.unique(h)
        at = np.searchsorted(self.vocab, h) + 1
        cut = np.searchsorted(doc, np.arange(len(items) + 1))
        full = [(key, at[a:b]) for (key, _), a, b in zip(items, cut[:-1], cut[1:], strict=True) if b > a]
        self.ids = [k for k, _ in full]
        self.seqs = [s.tolist() for _, s in full]
        self.width = len(self.vocab) + 1
        sizes = np.array([len(s) for s in self.seqs], np.int64)
        self.need = np.maximum(1, np.ceil(least * sizes)).astype(np.int64)
        pair, item, left, right = [], [], [], []
        for k, (_, s) in enumerate(full):
            steps = range(1, min(REACH, len(s) - 1) + 1) if len(s) > 1 else (0,)  # a single word pairs with itself
            for d in steps:
                p = np.arange(len(s) - d)
                pair.append(s[p] * self.width + s[p + d])
                item.append(np.full(len(p), k))
                left.append(p)
                right.append(p + d)
        pair, item, left, right = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (pair, item, left, right))
        rare = self._rare(pair, item, left, right, sizes, common)
        pair, item, left, right = pair[rare], item[rare], left[rare], right[rare]
        order = np.argsort(pair, kind="stable")
        self.pairs, self.first = np.unique(pair[order], return_index=True)
        self.first = np.r_[self.first, len(order)]
        self.item, self.left, self.right = item[order], left[order], right[order]
        self.alone = any(len(s) == 1 for s in self.seqs)

    def _rare(self, pair: np.ndarray, item: np.ndarray, left: np.ndarray, right: np.ndarray, sizes: np.ndarray, common: int) -> np.ndarray:
        """Which pairs take part; lowers each item's need by the words that only pairs left out cover."""
        both = np.unique(np.stack([pair, item]), axis=1)[0]
        u, n = np.unique(both, return_counts=True)
        kept = n[np.searchsorted(u, pair)] <= common if len(pair) else np.empty(0, bool)
        offset = np.cumsum(sizes) - sizes
        covered = np.zeros(int(sizes.sum()), bool)
        for x in (left, right):
            covered[offset[item[kept]] + x[kept]] = True
        lost = sizes - np.add.reduceat(covered.astype(np.int64), offset) if len(sizes) else sizes
        lowered = self.need - lost
        whole = lowered < np.maximum(2, self.need // 3)  # too little would be left to search by
        self.need = np.where(whole, self.need, lowered)
        return kept | whole[item] if len(pair) else kept

    def lookup(self, h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(word as vocabulary number or 0, places of hits, pair of each hit)."""
        if not len(self.vocab):
            return np.zeros(len(h), np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.vocab, h), len(self.vocab) - 1)
        seq = np.where(self.vocab[at] == h, at + 1, 0)
        known = np.flatnonzero(seq)
        place, pair = [], []
        for d in range(0 if self.alone else 1, REACH + 1):
            p = known[known < len(seq) - d]
            p = p[(seq[p + d] > 0) & (doc[p + d] == doc[p])]
            code = seq[p] * self.width + seq[p + d]
            i = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
            hit = self.pairs[i] == code
            place.append(p[hit])
            pair.append(i[hit])
        return seq, np.concatenate(place), np.concatenate(pair)

    def passages(self, texts: list[str]) -> list[tuple[int, int, int, int, int, int, float]]:
        """(text number, item, first word, behind the last word, first character, behind the last, share held) of each passage."""
        h, doc, start, end = words(texts)
        seq, place, pair = self.lookup(h, doc)
        if not len(place):
            return []
        # every item of every hit
        n = self.first[pair + 1] - self.first[pair]
        post = np.repeat(self.first[pair], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        item, place = self.item[post], np.repeat(place, n)
        key = doc[place] * len(self.ids) + item
        # words of the item covered in the text as a whole
        longest = max(map(len, self.seqs))
        marks = np.unique(np.r_[key * longest + self.left[post], key * longest + self.right[post]])
        u, covered = np.unique(marks // longest, return_counts=True)
        enough = u[covered >= self.need[u % len(self.ids)]]
        if not len(enough):
            return []
        at = np.minimum(np.searchsorted(enough, key), len(enough) - 1)
        chosen = np.flatnonzero(enough[at] == key)
        order = chosen[np.lexsort((place[chosen], key[chosen]))]
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        bounds = np.searchsorted(doc, np.arange(len(texts) + 1))
        found = []
        for part in np.split(order, cuts):
            d, k = divmod(int(key[part[0]]), len(self.ids))
            item_words = self.seqs[k]
            low, high = int(bounds[d]), int(bounds[d + 1])
            places = place[part]
            # hits of one passage are no further apart than the passage is long
            breaks = np.flatnonzero(np.diff(places) > len(item_words) + REACH) + 1
            for group in np.split(part, breaks):
                seen = np.unique(np.r_[self.left[post[group]], self.right[post[group]]])
                if len(seen) < self.need[k]:
                    continue
                lo, hi = max(low, int(place[group[0]]) - len(item_words) // 3 - 5), min(high, int(place[group[-1]]) + len(item_words) // 3 + REACH + 5)
                for a, b, held in self._verify(item_words, seq[lo:hi].tolist()):
                    found.append((d, self.ids[k], lo + a - low, lo + b - low, int(start[lo + a]), int(end[lo + b - 1]), held))
        return found

    def _verify(self, item: list[int], seq: list[int]) -> list[tuple[int, int, float]]:
        """(first word, behind the last word, share held) of every passage in a stretch of text; none overlap."""
        width, step = 2 * len(item) + 4, max(1, len(item) // 5)
        found, left = [], [(0, len(seq))]
        while left:
            lo, hi = left.pop()
            if lo >= hi:
                continue
            best: tuple[int, int, int] | None = None
            for a in [*range(lo, max(lo + 1, hi - width + 1), step), *([hi - width] if hi - lo > width else [])]:
                if best and (best[2] == len(item) or a >= best[1]):
                    break  # what follows is another passage's
                part = seq[a : min(hi, a + width)]
                if common_subsequence(item, part) / len(item) < self.share:
                    continue
                x, y, got = aligned(item, part)
                if got / len(item) >= self.share and (not best or got > best[2]):
                    best = (a + x, a + y, got)
            if best:
                found.append((best[0], best[1], best[2] / len(item)))
                left += [(lo, best[0]), (best[1], hi)]
        return found

    def cleaned(self, text: str) -> str:
        """The text without the passages and what stands between their words; again, until none is left."""
        while spans := [(a, b) for *_, a, b, _ in self.passages([text])]:
            out, at = [], 0
            for a, b in sorted(spans):
                if a >= at:
                    out.append(text[at:a])
                at = max(at, b)
            text = "".join(out) + text[at:]
        return text

    def codes(self) -> np.ndarray:
        """Places of the pairs in a bit map of ``MAP_BITS``, the same whatever the block."""
        a, b = np.divmod(self.pairs, self.width)
        return _place(self.vocab[a - 1], self.vocab[b - 1])


def _place(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return ((a * np.uint64(0x9E3779B97F4A7C15) + b) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - MAP_BITS)


def _may_hold(bits: np.ndarray, texts: list[str], least: int, alone: bool) -> np.ndarray:
    """Whether each text has pairs in the map on at least ``least`` words."""
    h, doc, _, _ = words(texts)
    hit = np.zeros(len(h), bool)
    for d in range(0 if alone else 1, REACH + 1):
        p = np.arange(max(0, len(h) - d))
        p = p[doc[p] == doc[p + d]]
        at = _place(h[p], h[p + d])
        p = p[(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0]
        hit[p] = hit[p + d] = True
    return np.bincount(doc[hit], minlength=len(texts)) >= least


# --- DataFrame operators ----------------------------------------------------------------------


def _blocks(items: DataFrame, key: str, text: str, block_words: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of a bounded number of words, streamed from the cluster."""
    block, size = [], 0
    for r in items.select(key, text).where(F.col(text).isNotNull()).orderBy(key).toLocalIterator():
        block.append((r[0], r[1]))
        size += len(r[1].split())
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 64) -> Iterator[pa.RecordBatch]:
    """A few texts at a time, so that their arrays stay small."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)


def _likely(docs: DataFrame, blocks: list[ItemIndex], text: str) -> DataFrame:
    """Documents that can hold any item, by one scan against the bit map of all pairs (32 MB whatever the items)."""
    bits = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for b in blocks:
        at = b.codes()
        np.bitwise_or.at(bits, at >> np.uint64(3), (1 << (at & np.uint64(7))).astype(np.uint8))
    least, alone = min(int(b.need.min(initial=1)) for b in blocks), any(b.alone for b in blocks)
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    column = docs.columns.index(text)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            yield b.filter(pa.array(_may_hold(shared.value, [t or "" for t in b.column(column).to_pylist()], least, alone)))

    out = materialize(docs.mapInArrow(keep, docs.schema), "may-hold")
    shared.destroy()
    return out


def _indexes(items: DataFrame, item_key: str, text: str, share: float, block_words: int) -> list[ItemIndex]:
    return [x for x in (ItemIndex(b, share) for b in _blocks(items, item_key, text, block_words)) if x.ids]


def leaks(docs: DataFrame, items: DataFrame, doc_key: str = "doc_id", item_key: str = "item_id", text: str = "text", share: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """(doc, item, first_word, last_word, held): documents that hold ``share`` or more of an item's words as one passage.

    One row for each passage. Null and empty texts hold nothing; an item without words is never found.
    """
    ship(docs.sparkSession)
    flat = docs.select(F.col(doc_key).alias("d"), F.col(text).alias("t")).where(F.length("t") > 0)
    blocks = _indexes(items, item_key, text, share, block_words)
    if not blocks:
        return docs.sparkSession.createDataFrame([], f"{doc_key} long, {item_key} long, first_word int, last_word int, held double")
    if len(blocks) > 1:
        flat = _likely(flat, blocks, "t")
    kinds = (flat.schema["d"].dataType.simpleString(), items.schema[item_key].dataType.simpleString())

    def scanner(shared) -> Callable:
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in _slices(batches):
                rows = index.passages(b.column(1).to_pylist())
                if rows:
                    d, i, first, behind, _, _, held = zip(*rows, strict=True)
                    ids = b.column(0).take(pa.array(d))
                    yield pa.RecordBatch.from_arrays([ids, pa.array(i), pa.array(first, pa.int32()), pa.array(behind, pa.int32()), pa.array(held, pa.float64())], names=["d", "i", "a", "b", "held"])

        return scan

    sc = docs.sparkSession.sparkContext
    parts = [flat.mapInArrow(scanner(sc.broadcast(x)), f"d {kinds[0]}, i {kinds[1]}, a int, b int, held double") for x in blocks]
    out = reduce(DataFrame.unionByName, parts)
    return out.select(F.col("d").alias(doc_key), F.col("i").alias(item_key), F.col("a").alias("first_word"), (F.col("b") - 1).alias("last_word"), "held")


def without_leaks(docs: DataFrame, items: DataFrame, item_key: str = "item_id", text: str = "text", share: float = 0.5, block_words: int = 500_000) -> DataFrame:
    """``docs`` with every leaked passage cut out of its text, in the scan that finds it; other columns pass through.

    A cut can bring the parts of another passage together, so a text that was cut is searched again until
    nothing is found. Null texts stay. With several blocks of items, each cuts what the one before left.
    """
    ship(docs.sparkSession)
    column = docs.columns.index(text)

    def cutter(shared) -> Callable:
        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for b in _slices(batches):
                texts = b.column(column).to_pylist()
                for d in {x[0] for x in index.passages([t or "" for t in texts])}:
                    texts[d] = index.cleaned(texts[d])
                yield b.set_column(column, b.schema.field(column), pa.array(texts, b.schema.field(column).type))

        return cut

    for x in _indexes(items, item_key, text, share, block_words):
        docs = docs.mapInArrow(cutter(docs.sparkSession.sparkContext.broadcast(x)), docs.schema)
    return docs
