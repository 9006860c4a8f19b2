"""Quantities recorded in different units: parse, segment, convert.

A quantity text such as ``approx. 1.05 thousand euro a month`` is cut into
numbers and unit text. Unit text is segmented by dynamic programming over
tries of prefixes, roots and exponents; what stays ambiguous (``m`` may be
metre, month or million; ``1.225`` may be 1.225 or 1,225) is settled by the
priors of the field the text stands in: its dimension and usual magnitude.

Every distinct text of an Arrow batch is parsed once; distinct unit strings are
memoised in the worker, so the cost of the dynamic program vanishes on real
columns, where a few hundred unit strings cover all rows. There is no shuffle.

Results for odd input: null, empty and number-free texts give null; extra
columns of the input pass through untouched.
"""

from __future__ import annotations

import math
import re
import unicodedata
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmill.session import ship

# --- vocabulary -------------------------------------------------------------------------------

#: multipliers that may stand before a root or right after a number
PREFIXES = {
    "k": 1e3, "thousand": 1e3, "thou": 1e3, "kilo": 1e3, "m": 1e6, "mn": 1e6, "million": 1e6, "mega": 1e6,
    "bn": 1e9, "billion": 1e9, "giga": 1e9, "hecto": 1e2, "deca": 1e1, "deci": 1e-1, "d": 1e-1,
    "c": 1e-2, "centi": 1e-2, "milli": 1e-3, "hundred": 1e2,
}

#: root -> (dimension, factor to the base unit: euro, year, metre, kilogram, litre, square metre)
ROOTS = {
    "€": ("money", 1.0), "eur": ("money", 1.0), "euro": ("money", 1.0), "cent": ("money", 0.01),
    "£": ("sterling", 1.0), "gbp": ("sterling", 1.0), "$": ("dollar", 1.0), "usd": ("dollar", 1.0),
    "year": ("time", 1.0), "yr": ("time", 1.0), "annum": ("time", 1.0), "annual": ("time", 1.0), "a": ("time", 1.0),
    "quarter": ("time", 1 / 4), "qtr": ("time", 1 / 4),
    "month": ("time", 1 / 12), "mth": ("time", 1 / 12), "mo": ("time", 1 / 12), "m": ("time", 1 / 12),
    "fortnight": ("time", 1 / 26),
    "week": ("time", 1 / 52), "wk": ("time", 1 / 52), "w": ("time", 1 / 52),
    "day": ("time", 1 / 365), "dai": ("time", 1 / 365), "d": ("time", 1 / 365), "night": ("time", 1 / 365), "n": ("time", 1 / 365),
    "hour": ("time", 1 / 8760), "hr": ("time", 1 / 8760),
    "metre": ("length", 1.0), "meter": ("length", 1.0), "m": ("time", 1 / 12),
    "inch": ("length", 0.0254), "foot": ("length", 0.3048), "feet": ("length", 0.3048), "ft": ("length", 0.3048),
    "yard": ("length", 0.9144), "yd": ("length", 0.9144), "mile": ("length", 1609.344),
    "gram": ("mass", 1e-3), "g": ("mass", 1e-3), "tonne": ("mass", 1e3), "t": ("mass", 1e3),
    "lb": ("mass", 0.45359237), "pound": ("mass", 0.45359237), "oz": ("mass", 0.028349523125), "ounce": ("mass", 0.028349523125),
    "litre": ("volume", 1.0), "liter": ("volume", 1.0), "l": ("volume", 1.0),
    "acre": ("area", 4046.8564224), "hectare": ("area", 1e4), "ha": ("area", 1e4),
}
#: second readings of a root that has one already
ROOTS_ALSO = {"m": ("length", 1.0)}

#: words that invert the unit that follows, and marks behind a root that set its power
PER = {"per", "p", "/", "a", "an", "every", "each", "in"}
BEFORE_POWER = {"sq": 2, "square": 2, "cu": 3, "cubic": 3}
AFTER_POWER = {"2": 2, "3": 3, "²": 2, "³": 3, "^2": 2, "^3": 3, "^-1": -1, "-1": -1, "ly": -1}
COUNTS = {"one": 1, "two": 2, "three": 3, "four": 4, "six": 6, "twelve": 12}
#: letters and words that carry no unit inside a unit string: calendar, plural
FILL = {"c", "calendar", "s", "es", "cal"}

#: marks that make a unit of the letter before them
_POWERED = ("2", "3", "²", "³", "^")

_SEPARATORS = " .,()[]{}:;-–+*~\"'"


class _Trie:
    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, item: tuple) -> None:
        node = self.root
        for ch in word:
            node = node.setdefault(ch, {})
        node.setdefault("", []).append(item)

    def at(self, text: str, i: int) -> list[tuple[int, tuple]]:
        """All entries that begin at i, each with its end."""
        node, found = self.root, []
        while i < len(text) and text[i] in node:
            node = node[text[i]]
            i += 1
            found += [(i, x) for x in node.get("", ())]
        return found


def _tries() -> _Trie:
    t = _Trie()
    for w, v in PREFIXES.items():
        t.add(w, ("prefix", v))
    for w, v in [*ROOTS.items(), *ROOTS_ALSO.items()]:
        t.add(w, ("root", v))
    for w in PER:
        t.add(w, ("per", None))
    for w, v in BEFORE_POWER.items():
        t.add(w, ("before", v))
    for w, v in AFTER_POWER.items():
        t.add(w, ("after", v))
    for w, v in COUNTS.items():
        t.add(w, ("count", v))
    for w in FILL:
        t.add(w, ("fill", None))
    return t


_TRIE = _tries()

# --- segmentation -----------------------------------------------------------------------------


@dataclass(frozen=True)
class FieldPrior:
    """What the field holds: exponents by dimension, the unit wanted, and the usual size there.

    ``target`` gives, for each dimension, the size of the wanted unit in base
    units (per month: ``{"time": 1/12}``). ``assume`` lists dimensions that a
    text may leave out, which then are taken as in the target.
    """

    dims: tuple[tuple[str, int], ...]
    target: tuple[tuple[str, float], ...] = ()
    assume: tuple[str, ...] = ()
    log10_mean: float = 0.0
    log10_sd: float = 3.0
    absent: float = 1.5
    doubt: float = 1.0


RENT_PER_MONTH = FieldPrior(
    dims=(("money", 1), ("time", -1)), target=(("money", 1.0), ("time", 1 / 12)), assume=("money", "time"), log10_mean=3.1, log10_sd=0.4
)
FLOOR_AREA = FieldPrior(dims=(("length", 2),), target=(("length", 1.0),), assume=("length",), log10_mean=1.9, log10_sd=0.6)


@dataclass(frozen=True)
class _Parse:
    cost: float = 0.0
    factor: float = 1.0
    dims: tuple[tuple[str, int], ...] = ()
    sign: int = 1  # -1: the next root is in the denominator
    power: int = 1  # power set by "square" and the like
    scale: float = 1.0  # prefix waiting for its root
    count: float = 1.0  # "every two weeks"
    last: tuple = field(default=())  # (dimension, size, exponent) of the last root, for powers behind it

    def state(self) -> tuple:
        """What decides how a reading may go on."""
        return self.factor, self.dims, self.sign, self.power, self.scale, self.count, self.last


def _add(dims: tuple, d: str, n: int) -> tuple:
    x = dict(dims)
    x[d] = x.get(d, 0) + n
    return tuple(sorted((k, v) for k, v in x.items() if v))


def _step(p: _Parse, item: tuple, length: int, alone: bool, first: bool) -> _Parse | None:
    """The parse after one more token, or None where grammar forbids it."""
    kind, v = item
    cost = p.cost + 1.0 + (0.7 if length == 1 and not alone else 0.25 if length == 1 else 0.0)
    if kind == "prefix":
        if p.scale != 1.0 or p.sign < 0:
            return None
        # right behind the number a prefix scales the number, else it waits for its root
        return _Parse(cost + (0.0 if first else 0.6), p.factor, p.dims, p.sign, p.power, v, p.count, ())
    if kind == "root":
        dim, size = v
        e = p.sign * p.power
        unit = (size * p.scale * p.count) ** e
        return _Parse(cost, p.factor * unit, _add(p.dims, dim, e), 1, 1, 1.0, 1.0, (dim, size * p.scale * p.count, e))
    if kind == "per":
        return None if p.sign < 0 and length == 1 else _Parse(cost - 0.3, p.factor * p.scale, p.dims, -1, 1, 1.0, 1.0, ())
    if kind == "before":
        return _Parse(cost, p.factor, p.dims, p.sign, v, p.scale, p.count, ())
    if kind == "after":
        if not p.last:
            return None
        dim, size, e = p.last
        new = e * v if v > 0 else -abs(e)
        return _Parse(cost, p.factor * size ** (new - e), _add(p.dims, dim, new - e), 1, 1, 1.0, 1.0, ())
    if kind == "count":
        return _Parse(cost, p.factor, p.dims, p.sign, p.power, p.scale, float(v), ()) if p.sign < 0 else None
    # filler: the plural s only behind a root, calendar only before one
    return _Parse(cost, p.factor, p.dims, p.sign, p.power, p.scale, p.count, p.last)


@lru_cache(maxsize=65536)
def _is_unit(word: str) -> bool:
    """Whether a word is made of unit parts with a root of two letters or more, or is a short form such as ``pcm``."""
    if re.fullmatch(r"p(?:c|p)?[mwadn]", word):
        return True
    reach: list[set[bool]] = [set() for _ in range(len(word) + 1)]
    reach[0] = {False}
    for i in range(len(word)):
        for end, (kind, _) in _TRIE.at(word, i) if reach[i] else ():
            reach[end] |= {root or (kind == "root" and end - i > 1) for root in reach[i]}
    return True in reach[-1]


class TooManyReadings(ValueError):
    """A unit text with more states than are followed: it is reported as unreadable, never read by some of them only."""


@lru_cache(maxsize=65536)
def segment(text: str, skip: float = 2.6, most: int = 20_000) -> tuple[_Parse, ...]:
    """All readings of a unit string, each at its least cost, by dynamic programming over its positions.

    States that only differ in cost are merged; none is dropped. Beyond ``most`` states at a position the text is given up.
    """
    n = len(text)
    found: list[dict[tuple, _Parse]] = [{} for _ in range(n + 1)]
    start = _Parse()
    found[0][start.state()] = start

    def put(i: int, p: _Parse) -> None:
        q = found[i].get(p.state())
        if q is None or p.cost < q.cost:
            found[i][p.state()] = p
            if len(found[i]) > most:
                raise TooManyReadings(text)

    best = [row.values() for row in found]
    for i in range(n):
        if not best[i]:
            continue
        if text[i] in _SEPARATORS:
            for p in best[i]:
                put(i + 1, p)
            if text[i] != "-":
                continue
        run = re.compile(r"[^\W\d_]+").match(text, i)
        starts = i == 0 or not (text[i - 1].isalpha() and text[i].isalpha())
        if starts:  # a whole word, or any single mark, may be noise
            end = run.end() if run else i + 1
            # but not what can only be meant as a unit
            unit = _is_unit(text[i:end]) if run else text[i] in ROOTS or (i > 0 and text[i - 1].isalpha() and text[i] in _POWERED)
            if run and text[end : end + 1] in _POWERED and text[i:end] in ROOTS:
                unit = True
            for p in best[i] if not unit else ():
                put(end, _Parse(p.cost + skip + (0 if run else 1), p.factor * p.scale, p.dims, 1, 1, 1.0, 1.0, ()))
        digits = re.compile(r"\d+").match(text, i)
        if digits and starts:
            for p in best[i]:
                if p.sign < 0 and 0 < int(digits[0]) < 100:
                    put(digits.end(), _Parse(p.cost + 1, p.factor, p.dims, p.sign, p.power, p.scale, float(digits[0]), ()))
        for end, item in _TRIE.at(text, i):
            alone = starts and (end == n or not text[end].isalpha())
            for p in best[i]:
                if (q := _step(p, item, end - i, alone, i == 0 or not text[:i].strip(_SEPARATORS + "€"))) is not None:
                    put(end, q)
    return tuple(_Parse(p.cost + (0.8 if p.sign < 0 else 0.0), p.factor * p.scale, p.dims) for p in best[n])


# --- numbers ----------------------------------------------------------------------------------

_NUMBER = re.compile(r"\d+(?:[.,'’   ]\d+)*")
_SCALE = re.compile(r"^(?:k|m\b|mn\b|bn\b)|thousand|million|billion")
_CURRENCY_BEFORE = re.compile(r"(?:[€£$]|\b(?:eur|euro|gbp|usd))\s*$")
#: what stands before a number that belongs to the unit: "every 2 weeks", "m2"
_RATE_BEFORE = re.compile(r"(?:(?:every|per|each|/)\s*|\b(?:[mckd]?m|ft|yd|in)\^?)$")


@lru_cache(maxsize=65536)
def readings(number: str, scaled: bool = False) -> tuple[tuple[float, float], ...]:
    """(value, cost) of each way to read a number's separators; ``scaled``: a word such as thousand follows."""
    s = re.sub(r"['’   ]", "", number)
    marks = [ch for ch in s if ch in ".,"]
    if not marks:
        return ((float(s), 0.0),)
    out = []
    last = max(s.rfind("."), s.rfind(","))
    tail = len(s) - last - 1
    # the last mark may be the decimal one; a single comma before three digits only where a scale word follows
    if len(set(marks)) == 2 or (len(marks) == 1 and (scaled or tail != 3 or marks[0] == ".")):
        out.append((float(re.sub(r"[.,]", "", s[:last]) + "." + s[last + 1 :]), 1.5 if tail == 3 and len(marks) == 1 and not scaled and marks[0] == "." else 0.0))
    if len(set(marks)) == 1 and all(len(x) == 3 for x in re.split(r"[.,]", s)[1:]) and len(re.split(r"[.,]", s)[0]) <= 3:
        out.append((float(re.sub(r"[.,]", "", s)), 0.3 if marks[0] == "." else 0.0))
    return tuple(out) or ((float(re.sub(r"[.,]", "", s)), 2.0),)


def amounts(text: str) -> list[tuple[str, str]]:
    """(number, unit text) of each amount in a text; counts such as "every 2 weeks" stay unit text."""
    t = unicodedata.normalize("NFKC", text).casefold()
    found = [m for m in _NUMBER.finditer(t) if not _RATE_BEFORE.search(t[: m.start()])]
    out, left = [], 0
    for k, m in enumerate(found):
        right = len(t)
        if k + 1 < len(found):
            gap = t[m.end() : found[k + 1].start()]
            cut = _CURRENCY_BEFORE.search(gap)
            right = m.end() + (cut.start() if cut else len(gap))
        before = t[left : m.start()]
        out.append((m[0], (t[m.end() : right] + " " + before).strip()))
        left = right
    return out


#: words that make another rate of the period behind them, and words that hold a period
_OTHER_RATE = re.compile(r"\b(?:bi|tri|semi|half|twice|thrice)[\s-]*(?:(?:a|per|each|every)\s+)?(?:dai|day|week|fortnight|month|quarter|year|annual|annum)")
_PERIOD_WORD = re.compile(r"[^\W\d_]*(?:week|month|year|annual|annum|fortnight|quarter|night|hour)[^\W\d_]*")


def unknown_rate(unit: str) -> bool:
    """Whether a unit text names a rate that the vocabulary does not have."""
    return bool(_OTHER_RATE.search(unit)) or any(not _is_unit(m[0]) for m in _PERIOD_WORD.finditer(unit))


@lru_cache(maxsize=262144)
def parse_amount(number: str, unit: str, prior: FieldPrior) -> tuple[float, float] | None:
    """(value in the wanted unit, cost) of one amount under a field's prior; null if no reading has its dimension."""
    if unknown_rate(unit):
        return None
    want, target = dict(prior.dims), dict(prior.target)
    fits = []
    for p in segment(unit):
        dims = dict(p.dims)
        missing = [d for d in want if d not in dims and d in prior.assume]
        if all(dims.get(d, 0) == want.get(d, 0) for d in {*dims, *want} if d not in missing):
            fits.append((p.cost + prior.absent * len(missing), p.factor, missing))
    best: tuple[float, float] | None = None
    for cost, factor, missing in fits:
        if cost > min(fits)[0] + prior.doubt:
            continue  # only near ties are settled by magnitude
        for d, e in want.items():
            if d not in missing:
                factor /= target.get(d, 1.0) ** e
        for value, extra in readings(number, bool(_SCALE.search(unit))):
            x = value * factor
            size = min(8.0, 0.5 * ((math.log10(x) - prior.log10_mean) / prior.log10_sd) ** 2) if x > 0 else 8.0
            if best is None or cost + extra + size < best[1]:
                best = (x, cost + extra + size)
    return best


def convert(text: str | None, prior: FieldPrior) -> float | None:
    """The amount of a text in the field's unit: the one that reads best, the first of those that read about as well.

    Null without a readable amount, and where a rate is named that is not known (``biweekly``). Amounts in words are not read.
    """
    if not text:
        return None
    try:
        read = [x for number, unit in amounts(text) if (x := parse_amount(number, unit, prior)) is not None]
    except TooManyReadings:
        return None
    if not read:
        return None
    cheapest = min(cost for _, cost in read)
    return next(x for x, cost in read if cost <= cheapest + prior.doubt)


# --- DataFrame operator -----------------------------------------------------------------------


def to_common_unit(text: Column, prior: FieldPrior) -> Column:
    """Column with the quantity of ``text`` in the field's unit (double; null where none can be read)."""

    @F.pandas_udf("double")
    def convert_batch(s: pd.Series) -> pd.Series:
        codes, values = pd.factorize(s, use_na_sentinel=True)
        known = pd.array([convert(v, prior) for v in values], dtype="Float64")
        out = pd.Series(known).reindex(range(len(values)))
        return pd.Series([None if c < 0 or pd.isna(out[c]) else float(out[c]) for c in codes], dtype="float64")

    return convert_batch(text)


def with_common_unit(df: DataFrame, text: str, out: str, prior: FieldPrior = RENT_PER_MONTH) -> DataFrame:
    """``df`` with ``out``: the quantity written in column ``text``, in the field's common unit."""
    ship(df.sparkSession)
    return df.withColumn(out, to_common_unit(F.col(text), prior))


def unit_conflicts(df: DataFrame, value: str, text: str, tolerance: float = 0.02, prior: FieldPrior = RENT_PER_MONTH, out: str = "common_amount") -> DataFrame:
    """Rows whose stored ``value`` differs from the amount written in ``text`` by more than ``tolerance`` of it.

    Rows without a value or without a digit in the text are dropped before Python sees them.
    """
    kept = df.where(F.col(value).isNotNull() & F.col(text).rlike(r"\p{Nd}"))
    return with_common_unit(kept, text, out, prior).where(
        F.abs(F.col(value).cast("double") - F.col(out)) > F.col(out) * F.lit(tolerance) + F.lit(1e-9)
    )
