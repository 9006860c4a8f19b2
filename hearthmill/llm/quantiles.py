"""Percentiles of very large columns: mergeable sketches with multiplicative rank error.

A sketch is a stack of relative-rank compactors (Cormode, Karnin, Liberty,
Thaler, Vesely 2021). The compactor of level h holds values of weight ``2**h``.
When it overflows, it protects the half next to one tail and compacts sections
of the rest, more of them the rarer the moment (as many as the compaction
counter has trailing ones, plus one): of the sorted values there, every other
one moves up a level. So the rank error shrinks towards the protected tail.

Sketches of partitions, days or feeds merge into the sketch of their union.
Each task builds one small sketch for each group that it meets, so only
sketches are shuffled and a group with a third of all rows costs its task
no more than another. A group of up to ``capacity(k)`` values is held exactly.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmill.session import ship

SECTIONS = 3
DEFAULT_K = 64
#: values, and groups, that a task keeps before it emits what it has
FLUSH_VALUES = 2_000_000
FLUSH_GROUPS = 50_000


def capacity(k: int = DEFAULT_K) -> int:
    """Values that a level holds before it first compacts; groups up to this size are exact."""
    return 2 * SECTIONS * k


def rank_error(k: int = DEFAULT_K, deviations: float = 3.0, tail: float = 1.0) -> float:
    """Bound on the error of a normalised rank, at so many standard deviations.

    ``tail``: share of the values between the rank and the protected end. The error shrinks in proportion to it
    (a multiplicative bound) and is flat far from that end. Four times the figures published for this layout: safe
    under merging in any order.
    """
    return deviations * 4 * min(0.084, (0.0512 / SECTIONS) ** 0.5 * tail) / k


class Sketch:
    """One sketch; ``high`` protects the upper tail, else the lower one."""

    __slots__ = ("high", "k", "levels", "n", "salt", "states")

    def __init__(self, k: int = DEFAULT_K, high: bool = True, salt: int = 0) -> None:
        self.k, self.high, self.n, self.salt = k, high, 0, salt
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.states: list[int] = [0]

    def update(self, values: np.ndarray) -> None:
        self.n += len(values)
        room = 8 * capacity(self.k)
        for i in range(0, len(values), room):
            self.levels[0] = np.concatenate([self.levels[0], values[i : i + room]])
            self._shrink()

    def merge(self, other: Sketch) -> None:
        self.n += other.n
        self.salt = hash((self.salt, other.salt))
        for h, v in enumerate(other.levels):
            if h == len(self.levels):
                self.levels.append(np.empty(0))
                self.states.append(0)
            self.levels[h] = np.concatenate([self.levels[h], v])
            self.states[h] |= other.states[h]
        self._shrink()

    def _sections(self, h: int) -> tuple[int, int]:
        """Number and even size of the sections of a level: more and smaller ones as it compacts more often."""
        m, k = SECTIONS, float(self.k)
        while self.states[h] >= 1 << (m - 1) and k / 2**0.5 >= 4:
            m, k = 2 * m, k / 2**0.5
        return m, max(4, 2 * round(k / 2))

    def _shrink(self) -> None:
        h = 0
        while h < len(self.levels):
            m, k = self._sections(h)
            if len(self.levels[h]) > 2 * m * k:
                v = np.sort(self.levels[h])
                ones = (~self.states[h] & (self.states[h] + 1)).bit_length() - 1
                keep = m * k + (m - min(m, ones + 1)) * k  # the protected half and the sections left alone
                cut = (len(v) - keep) // 2 * 2
                # the coin is a hash of what is compacted and of where: repeatable, independent of the values' parity, and
                # not the same on days that are alike
                coin = (hash((self.salt, self.states[h], h, cut, float(v[0]), float(v[-1]))) >> 7) & 1
                if self.high:
                    up, rest = v[coin:cut:2], v[cut:]
                else:
                    up, rest = v[len(v) - cut + coin :: 2], v[: len(v) - cut]
                if h + 1 == len(self.levels):
                    self.levels.append(np.empty(0))
                    self.states.append(0)
                self.levels[h], self.states[h] = rest, self.states[h] + 1
                self.levels[h + 1] = np.concatenate([self.levels[h + 1], up])
            h += 1

    # --- queries

    def _weighted(self) -> tuple[np.ndarray, np.ndarray]:
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 1 << h, dtype=np.int64) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        return v[order], np.cumsum(w[order])

    def quantiles(self, probs: list[float]) -> list[float | None]:
        """The smallest value whose share of values at or below it reaches each probability."""
        if not self.n:
            return [None] * len(probs)
        v, c = self._weighted()
        at = np.searchsorted(c, np.ceil(np.asarray(probs) * c[-1] - 1e-9).clip(1), side="left")
        return [float(v[min(i, len(v) - 1)]) for i in at]

    def share(self, x: float, inclusive: bool = True) -> float | None:
        """Share of values at or below (or just below) ``x``."""
        if not self.n:
            return None
        v, c = self._weighted()
        i = np.searchsorted(v, x, side="right" if inclusive else "left")
        return float(c[i - 1] / c[-1]) if i else 0.0

    # --- bytes

    def dump(self) -> bytes:
        head = struct.pack("<?IQI", self.high, self.k, self.n, len(self.levels))
        body = b"".join(struct.pack("<QI", s, len(v)) for s, v in zip(self.states, self.levels, strict=True))
        return head + body + np.concatenate(self.levels).astype("<f8").tobytes()

    @classmethod
    def load(cls, data: bytes) -> Sketch:
        high, k, n, count = struct.unpack_from("<?IQI", data)
        s, at = cls(k, high), struct.calcsize("<?IQI")
        parts = [struct.unpack_from("<QI", data, at + i * 12) for i in range(count)]
        flat = np.frombuffer(data, dtype="<f8", offset=at + 12 * count)
        ends = np.cumsum([p[1] for p in parts])
        s.n, s.states, s.salt = n, [p[0] for p in parts], hash((n, len(flat), float(flat.sum())))
        s.levels = [flat[e - p[1] : e].copy() for e, p in zip(ends, parts, strict=True)]
        return s


class TwoTails:
    """A sketch for each tail: the lower one answers below the median, the upper one from it on."""

    __slots__ = ("low", "top")

    def __init__(self, k: int = DEFAULT_K, salt: int = 0) -> None:
        self.low, self.top = Sketch(k, False, salt), Sketch(k, True, salt)

    @property
    def n(self) -> int:
        return self.top.n

    def update(self, values: np.ndarray) -> None:
        self.low.update(values)
        self.top.update(values)

    def merge(self, other: TwoTails) -> None:
        self.low.merge(other.low)
        self.top.merge(other.top)

    def quantiles(self, probs: list[float]) -> list[float | None]:
        low, top = self.low.quantiles(probs), self.top.quantiles(probs)
        return [a if p < 0.5 else b for p, a, b in zip(probs, low, top, strict=True)]

    def share(self, x: float, inclusive: bool = True) -> float | None:
        s = self.low.share(x, inclusive)
        return s if s is None or s < 0.5 else self.top.share(x, inclusive)

    def dump(self) -> bytes:
        low = self.low.dump()
        return struct.pack("<BIQ", 2, len(low), self.n) + low + self.top.dump()  # the count stands where a sketch has it


def load(data: bytes) -> Sketch | TwoTails:
    if data[0] != 2:
        return Sketch.load(data)
    head = struct.calcsize("<BIQ")
    (size,) = struct.unpack_from("<I", data, 1)
    both = TwoTails.__new__(TwoTails)
    both.low, both.top = Sketch.load(data[head : head + size]), Sketch.load(data[head + size :])
    return both


# --- DataFrame operators ----------------------------------------------------------------------


def _key(groups: list[str]) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{g}`").alias(g) for g in groups]), {"ignoreNullFields": "false"})


def _reveal(df: DataFrame, groups: list[str], schema: T.StructType) -> DataFrame:
    """The group columns back out of their JSON key."""
    kinds = T.StructType([T.StructField(g, schema[g].dataType) for g in groups])
    return df.withColumn("__k", F.from_json("__g", kinds)).select(*[F.col(f"__k.`{g}`").alias(g) for g in groups], "n", "sketch")


def sketches(df: DataFrame, groups: list[str], value: str, k: int = DEFAULT_K, high: bool | None = True) -> DataFrame:
    """One sketch for each group: (group columns, n, sketch). Null and NaN values are left out; a null group is a group.

    ``high``: the tail to protect, upper or lower; with None there is a sketch for each. An empty input gives no rows.
    Group columns may not be called n or sketch.
    """
    if {"n", "sketch", "__g"} & set(groups):
        raise ValueError("group columns may not be called n, sketch or __g")
    ship(df.sparkSession)
    flat = df.select(_key(groups).alias("__g"), F.col(f"`{value}`").cast("double").alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Sketch | TwoTails] = {}
        kept = 0
        salt = TaskContext.get().partitionId()  # the same when a task is run again

        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(list(held), pa.string()), pa.array([s.n for s in held.values()], pa.int64()), pa.array([s.dump() for s in held.values()], pa.binary())],
                names=["__g", "n", "sketch"],
            )

        for b in batches:
            codes, names = pd.factorize(b.column(0).to_pandas())
            values = b.column(1).to_numpy(zero_copy_only=False)
            order = np.argsort(codes, kind="stable")
            cuts = np.flatnonzero(np.diff(codes[order])) + 1
            for part in np.split(order, cuts) if len(order) else []:
                name = names[codes[part[0]]]
                if (s := held.get(name)) is None:
                    s = held[name] = TwoTails(k, salt) if high is None else Sketch(k, high, salt)
                s.update(values[part])
            kept += b.num_rows
            if kept > FLUSH_VALUES or len(held) > FLUSH_GROUPS:
                yield emit()
                held.clear()
                kept = 0
        if held:
            yield emit()

    built = flat.mapInArrow(build, "__g string, n long, sketch binary")
    return _reveal(_merged(built), groups, df.schema)


def _merged(partial: DataFrame, ways: int = 32) -> DataFrame:
    """Sketches of the same ``__g`` merged, in two levels, so that no task meets those of all tasks for one group.

    First within (group, one of ``ways`` sets of tasks), then within the group. Each partition streams through its sorted keys.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name: str | None = None
        s: Sketch | None = None
        raw: bytes | None = None
        for b in batches:
            out: list[tuple[str, int, bytes]] = []
            for g, data in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if g != name:
                    if name is not None:
                        out.append((name, *_done(s, raw)))
                    name, s, raw = g, None, data
                else:
                    if s is None:
                        s = load(raw)
                    s.merge(load(data))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=["__g", "n", "sketch"])
        if name is not None:
            n, data = _done(s, raw)
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([data], pa.binary())], names=["__g", "n", "sketch"])

    kind = "__g string, n long, sketch binary"
    salted = partial.withColumn("__s", F.pmod(F.spark_partition_id(), F.lit(ways)))
    first = salted.repartition("__g", "__s").sortWithinPartitions("__g").select("__g", "n", "sketch").mapInArrow(merge, kind)
    return first.repartition("__g").sortWithinPartitions("__g").mapInArrow(merge, kind)


def _done(s: Sketch | None, raw: bytes) -> tuple[int, bytes]:
    """What to emit for a group: bytes seen once pass through unread."""
    return (struct.unpack_from("<Q", raw, 5)[0], raw) if s is None else (s.n, s.dump())


def merge_sketches(df: DataFrame, groups: list[str]) -> DataFrame:
    """Join sketches made apart (days, feeds, partitions) into those of coarser ``groups``."""
    ship(df.sparkSession)
    part = df.select(_key(groups).alias("__g"), "n", "sketch")
    return _reveal(_merged(part), groups, df.schema)


def quantile_columns(df: DataFrame, probs: dict[str, float]) -> DataFrame:
    """``df`` with a column for each named probability (share of values at or below reaches it)."""
    names, ps = list(probs), list(probs.values())

    @F.pandas_udf("array<double>")
    def ask(s: pd.Series) -> pd.Series:
        return s.map(lambda x: load(x).quantiles(ps))

    return df.withColumn("__q", ask("sketch")).select(*[c for c in df.columns], *[F.col("__q")[i].alias(c) for i, c in enumerate(names)])


def error_columns(df: DataFrame, probs: dict[str, float], k: int = DEFAULT_K, high: bool | None = None, deviations: float = 3.0) -> DataFrame:
    """``df`` (with ``n``) with ``<name>_error`` for each probability: the bound on its rank, 0 where the group is held exactly."""
    exact = F.col("n") <= capacity(k)
    tail = {c: min(p, 1 - p) if high is None else 1 - p if high else p for c, p in probs.items()}
    return df.select("*", *[F.when(exact, F.lit(0.0)).otherwise(F.lit(rank_error(k, deviations, t))).alias(f"{c}_error") for c, t in tail.items()])


def shares(sketch: Column, x: Column) -> Column:
    """Struct of the shares of a sketch's values at or below ``x`` and strictly below it (null for a null ``x``)."""

    @F.pandas_udf("at_or_below double, below double")
    def ask(s: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = [(None, None) if pd.isna(y) else ((k := load(z)).share(y), k.share(y, False)) for z, y in zip(s, v, strict=True)]
        return pd.DataFrame(out, columns=["at_or_below", "below"], dtype="float64")

    return ask(sketch, x)


def percentile_suspects(
    stated: DataFrame, sk: DataFrame, on: list[str], value: str, least: float = 0.4, min_rows: int = 40, k: int = DEFAULT_K
) -> tuple[DataFrame, float]:
    """Stated medians that a group's sketch does not bear out, and the error used.

    A row of ``stated`` is suspect when fewer than ``least`` of its group's values may
    lie at or below the stated value, or at or above it. ``sure`` tells those that
    no error within the bound can clear; the others need an exact count.
    """
    e = rank_error(k, 5.0)
    j = stated.join(sk, on).where(F.col("n") >= min_rows).withColumn("s", shares(F.col("sketch"), F.col(value).cast("double")))
    err = F.when(F.col("n") <= capacity(k), F.lit(0.0)).otherwise(F.lit(e))
    worst = F.least(F.col("s.at_or_below"), 1 - F.col("s.below"))
    out = j.withColumn("worst", worst).withColumn("err", err).where(F.col("worst") - F.col("err") < least)
    return out.withColumn("sure", F.col("worst") + F.col("err") < least).drop("sketch", "s"), e
