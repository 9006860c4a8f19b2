"""Deduplicating new batches against all history, without reading all of it again.

State lives in a folder and survives its session (``Linker.open``):

``blocks``  blocking-key table. A block is what is known of one key within one bin of
            event time: first and last moment, the row first accepted there with its
            compared fields, and, once its cluster was touched, the representative.
            Generations of files, in buckets of the key's hash, sorted by the hash, with
            pages of few rows. A batch opens the buckets of its keys only, and of these,
            where it has few keys, only the pages that may hold them.
``rows``    the accepted batches, as they were linked.
``state``   weights, bucket count and generations; written last, so that a run that died
            half way leaves the state before it.

A batch is compared block by block with what its keys have: the vector (time gap, way of
writing the id, agreement of each field) is scored with weights learned from the
history, and a positive score joins two blocks. Clusters are the components (union-find)
of joined blocks; a block's representative is the first accepted row of its cluster. Only
blocks of touched clusters whose representative changed are written again; a block's
current representative is the least of those written, so an append that a retried task
repeats changes nothing. Generations are merged after every ``compact_every`` batches.

All rows of a key in one bin lie less than ``gap`` apart, so a key with a third of all rows
is at most one block for each bin, and is one row for each bin before any shuffle.
"""

from __future__ import annotations

import itertools
import json
import math
from dataclasses import asdict, dataclass, field
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from hearthmill.session import new_path

DAY_MS = 86_400_000


def property_key(text: Column) -> Column:
    """A property id however written: digits and an own-property suffix.

    Wide digits, quotes, blanks, thousands commas, a trailing ``.0``, leading
    zeros and any label in front are dropped; a hyphen and number at the end stay.
    Ids without digits are compared as trimmed lower-case text; blank ones are null.
    """
    t = F.translate(F.lower(text), "０１２３４５６７８９‐‑–—−", "0123456789-----")
    t = F.regexp_replace(t, r"""[\s,"'_#: ​]+""", "")
    s = F.regexp_replace(t, r"^[^0-9]+", "")
    s = F.regexp_replace(s, r"\.0+(?=-|$)", "")
    s = F.regexp_replace(F.regexp_replace(s, r"[^0-9a-z-]", ""), r"^0+(?=[0-9])", "")
    s = F.regexp_replace(s, r"-+$", "")
    return F.when(s != "", s).when(t != "", t)


def event_ms(epoch: Column) -> Column:
    """An epoch in seconds, milli-, micro- or nanoseconds, told apart by its size, as milliseconds."""
    a = F.abs(epoch)
    return (
        F.when(a < 100_000_000_000, epoch * 1000).when(a < 100_000_000_000_000, epoch).when(a < 100_000_000_000_000_000, F.floor(epoch / 1000)).otherwise(F.floor(epoch / 1_000_000))
    ).cast("long")


def keyed(df: DataFrame, key: Column, moment_ms: Column, row_id: str, stage: Column, compared: dict[str, Column], gap: int = DAY_MS, written: Column | None = None) -> DataFrame:
    """Rows ready for linkage: (pid, ms, bin, who). ``who`` orders acceptance: stage, then id; compared fields ride along.

    ``written``: the key as it stood in the source, compared as a level of its own. Rows whose key or moment
    is null take no part.
    """
    text = (key if written is None else written).cast("string")
    who = F.struct(stage.cast("int").alias("stage"), F.col(row_id).cast("long").alias("id"), text.alias("written"), *[c.alias(n) for n, c in compared.items()])
    return (
        df.select(key.alias("pid"), moment_ms.alias("ms"), who.alias("who"))
        .where(F.col("pid").isNotNull() & F.col("ms").isNotNull())
        .withColumn("bin", F.floor(F.col("ms") / gap).cast("long"))
    )


# --- comparison vectors and their weights -----------------------------------------------------

#: levels of a compared field
DIFFER, UNKNOWN, AGREE = 0, 1, 2


def _level(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), F.lit(UNKNOWN)).when(a == b, F.lit(AGREE)).otherwise(F.lit(DIFFER))


def vector(a: str, b: str, near: Column, fields: list[str]) -> list[Column]:
    """Comparison vector of two ``who`` structs: near in time (0 or 1), then the levels of the written id and of each field."""
    return [near.cast("int"), *[_level(F.col(f"{a}.`{f}`"), F.col(f"{b}.`{f}`")) for f in ("written", *fields)]]


@dataclass
class Weights:
    """A logistic model over comparison vectors: evidence in bits, the log odds that two rows are the same advert."""

    bias: float = 0.0
    near: float = 1.0
    agree: dict[str, float] = field(default_factory=dict)
    differ: dict[str, float] = field(default_factory=dict)

    def score(self, levels: list[Column], fields: list[str]) -> Column:
        """Sum of the weights of a vector; an unknown level weighs nothing."""
        total = F.lit(self.bias) + levels[0] * F.lit(self.near)
        for f, level in zip(("written", *fields), levels[1:], strict=True):
            total = total + F.when(level == AGREE, F.lit(self.agree.get(f, 0.0))).when(level == DIFFER, F.lit(self.differ.get(f, 0.0))).otherwise(F.lit(0.0))
        return total


def learn_weights(patterns: dict[tuple[int, ...], int], fields: list[str], ridge: float = 1e-3) -> Weights:
    """Weights from the counts of comparison vectors in the history (at most ``2 * 3 ** (1 + fields)`` of them).

    The label of a vector is the definition of a repeat: rows of one key that are near in time are the
    same advert, others are not. Every possible vector is taught once besides, so that none is left
    to chance, and a vector on the wrong side is taught again until all are on their own: with the
    weights returned, the score alone decides as the definition does.
    """
    names = ["written", *fields]
    space = list(itertools.product((0, 1), *[(DIFFER, UNKNOWN, AGREE)] * len(names)))
    x = np.array([[1.0, v[0], *[float(z == k) for z in v[1:] for k in (AGREE, DIFFER)]] for v in space])
    y = np.array([float(v[0]) for v in space])
    n = np.array([1.0 + patterns.get(v, 0) for v in space])
    w = np.zeros(x.shape[1])
    for _ in range(20):
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            slope = x.T @ (n * (y - p)) - ridge * w
            w = w + np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), slope)
        wrong = (x @ w > 0) != (y > 0)
        if not wrong.any():
            break
        n[wrong] *= 10
    else:
        raise RuntimeError("no weights reproduce the definition of a repeat")
    bits = [float(v) / math.log(2) for v in w]
    return Weights(bits[0], bits[1], dict(zip(names, bits[2::2], strict=True)), dict(zip(names, bits[3::2], strict=True)))


# --- persisted state --------------------------------------------------------------------------


class Linker:
    """Incremental linkage over persisted state; see the module text.

    ``bootstrap`` takes the history once. ``accept`` takes one batch, or several that arrived together, in
    the order of their stages, and returns its repeats: (first_id, dup_id, score).

    ``buckets``: hash buckets of the key, a power of two; they are doubled when generations are merged and
    hold more than ``rows_per_bucket`` blocks on average, without any upper limit. ``page_rows``: blocks in
    a page. ``pushed_keys``: up to so many distinct keys a batch's keys are pushed into the scan.
    """

    def __init__(
        self, spark: SparkSession, compared: list[str], gap: int = DAY_MS, root: str | None = None, buckets: int = 32, rows_per_bucket: int = 65_536, page_rows: int = 128, pushed_keys: int = 256, compact_every: int = 16
    ) -> None:
        self.spark, self.compared, self.gap = spark, compared, gap
        self.root = root or new_path(spark, "linker")
        self.buckets, self.rows_per_bucket, self.page_rows, self.pushed_keys, self.compact_every = buckets, rows_per_bucket, page_rows, pushed_keys, compact_every
        self.number, self.version = 0, 0  # of the next generation and state
        self.generations: list[str] = []
        self.batches: list[str] = []
        self.weights = Weights()
        self._blocks_schema: T.StructType | None = None
        self._rows_schema: T.StructType | None = None

    # --- state

    def save(self) -> Linker:
        """Write the state; what was written before stays until then the one that is opened."""
        own = ("compared", "gap", "buckets", "rows_per_bucket", "page_rows", "pushed_keys", "compact_every", "number", "generations", "batches")
        data = {k: getattr(self, k) for k in own} | {"weights": asdict(self.weights)}
        for k in ("_blocks_schema", "_rows_schema"):
            data[k] = getattr(self, k).json() if getattr(self, k) is not None else None
        self.spark.createDataFrame([(json.dumps(data),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.root}/state/version={self.version:09d}")
        self.version += 1
        return self

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> Linker:
        """Go on where a former session stopped."""
        r = spark.read.text(f"{root}/state").orderBy(F.desc("version")).first()
        data = json.loads(r["value"])
        own = cls(spark, data.pop("compared"), data.pop("gap"), root)
        own.weights = Weights(**data.pop("weights"))
        for k in ("_blocks_schema", "_rows_schema"):
            text = data.pop(k)
            setattr(own, k, T.StructType.fromJson(json.loads(text)) if text else None)
        for k, v in data.items():
            setattr(own, k, v)
        own.version = int(r["version"]) + 1
        return own

    def _bucketed(self, df: DataFrame) -> DataFrame:
        """``df`` with ``h``, the hash of its key, and ``bucket``, its leading bits: buckets are ranges of the hash that do not overlap."""
        h = F.xxhash64("pid")
        bits = self.buckets.bit_length() - 1
        return df.withColumn("h", h).withColumn("bucket", F.shiftrightunsigned(h, 64 - bits).cast("int") if bits else F.lit(0))

    def _write(self, blocks: DataFrame, folders: bool = True) -> None:
        """Write one generation of blocks that lie in their buckets' partitions already; a batch's, which is small, without a folder for each bucket."""
        path = f"{self.root}/blocks/generation={self.number:06d}"
        self.number += 1
        if self._blocks_schema is None:
            self._blocks_schema = _plain_schema(blocks.schema)
        blocks = blocks.select(*[F.col(f.name).cast(f.dataType) for f in self._blocks_schema])
        w = blocks.sortWithinPartitions("bucket", "h", "pid", "bin").write.mode("overwrite")
        w = w.option("parquet.page.row.count.limit", str(self.page_rows)).option("parquet.enable.dictionary", "false")
        (w.partitionBy("bucket") if folders else w).parquet(path)
        self.generations.append(path)

    def _blocks(self, paths: list[str] | None = None) -> DataFrame:
        """Blocks as written, possibly several of one key and bin."""
        paths = self.generations if paths is None else paths
        if not paths:
            return self.spark.createDataFrame([], self._blocks_schema)
        one = [self.spark.read.schema(self._blocks_schema).parquet(p) for p in paths]
        return reduce(DataFrame.unionByName, one)

    @staticmethod
    def _folded(blocks: DataFrame, *also: str) -> DataFrame:
        """One block for each key and bin."""
        return blocks.groupBy(*also, "pid", "bin").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("who").alias("who"), F.min("rep").alias("rep"))

    # --- clusters

    def _near(self, lo: Column, before: Column) -> Column:
        return F.coalesce(lo - before["hi"] < self.gap, F.lit(False))

    def _joins(self, before: str, own: str = "who", lo: str = "lo") -> Column:
        """Whether the score joins a block to the block of its key before it."""
        v = vector(f"{before}.who", own, self._near(F.col(lo), F.col(before)), self.compared)
        return F.col(before).isNotNull() & (self.weights.score(v, self.compared) > 0)

    def bootstrap(self, rows: DataFrame) -> Linker:
        """Take the history (rows as made by :func:`keyed`): one block for each key and bin, and the weights."""
        fields = ["written", *self.compared]
        same = [
            F.when(F.count(f"who.`{f}`") < F.count("*"), UNKNOWN).when(F.min(f"who.`{f}`") == F.max(f"who.`{f}`"), AGREE).otherwise(DIFFER).alias(f"in_{f}") for f in fields
        ]  # levels of a block's own rows
        bins = rows.groupBy("pid", "bin").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.min("who").alias("who"), F.count("*").alias("n"), *same)
        placed = self._bucketed(bins).repartition("bucket")
        w = W.partitionBy("bucket", "pid").orderBy("bin")
        prior = placed.withColumn("before", F.lag(F.struct("hi", "who")).over(w))
        v = vector("before.who", "who", self._near(F.col("lo"), F.col("before")), self.compared)
        within = F.when(F.col("n") > 1, F.concat_ws(",", F.lit(1), *[f"in_{f}" for f in fields])).alias("inside")
        across = F.when(F.col("before").isNotNull(), F.concat_ws(",", *v)).alias("across")
        no_rep = F.lit(None).cast(bins.schema["who"].dataType).alias("rep")
        self._write(prior.select("h", "pid", "bin", "lo", "hi", "who", no_rep, within, across, "bucket"))
        # the vectors seen in the history, at most as many as there are levels
        taught = self._blocks().select(F.explode(F.array("inside", "across")).alias("v")).where("v IS NOT NULL").groupBy("v").count().collect()
        self.weights = learn_weights({tuple(map(int, r.v.split(","))): r["count"] for r in taught}, self.compared)
        return self.save()

    def _known(self, batch: DataFrame) -> DataFrame:
        """Blocks of a batch's keys, from its buckets, and from the pages of its keys where these are few."""
        touched = batch.groupBy("bucket").agg(F.count_distinct("h").alias("n")).collect()  # a row for each bucket
        known = self._blocks()
        if len(touched) < self.buckets:
            known = known.where(F.col("bucket").isin(sorted(r.bucket for r in touched)))
        if sum(r.n for r in touched) <= self.pushed_keys:
            known = known.where(_any_of("h", sorted(r.h for r in batch.select("h").distinct().collect())))
        mine = batch.select("bucket", "pid").distinct()
        return self._folded(known.repartition("bucket").join(mine, ["bucket", "pid"], "left_semi"), "bucket", "h")

    def accept(self, rows: DataFrame) -> DataFrame:
        """Hold a batch against everything accepted before, then accept it.

        Of rows in the batch itself the earliest (stage, then id) counts as accepted before the others.
        """
        path = f"{self.root}/rows/generation={self.number:06d}"
        rows.write.mode("overwrite").parquet(path)
        self._rows_schema = _plain_schema(rows.schema)
        rows = self.spark.read.schema(self._rows_schema).parquet(path)
        mine = self._bucketed(rows.groupBy("pid", "bin").agg(F.min("ms").alias("lo"), F.max("ms").alias("hi"), F.min("who").alias("who"))).repartition("bucket")
        kind, none = rows.schema["who"].dataType, F.lit(None)
        both = mine.select("bucket", "h", "pid", "bin", "lo", "hi", "who", none.cast(kind).alias("old"), none.cast("long").alias("old_lo"), none.cast("long").alias("old_hi"), F.lit(True).alias("new"))
        if self.generations:
            known = self._known(mine)
            both = both.unionByName(known.select("bucket", "h", "pid", "bin", "lo", "hi", "who", F.col("who").alias("old"), F.col("lo").alias("old_lo"), F.col("hi").alias("old_hi"), F.lit(False).alias("new")))
        blocks = both.groupBy("bucket", "h", "pid", "bin").agg(
            F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("who").alias("who"), F.min("old").alias("old"), F.min("old_lo").alias("old_lo"), F.max("old_hi").alias("old_hi"), F.max("new").alias("new")
        )
        w = W.partitionBy("bucket", "pid").orderBy("bin")
        upto = w.rowsBetween(W.unboundedPreceding, -1)
        seen = F.col("old").isNotNull()
        c = blocks.withColumn("before", F.lag(F.struct("hi", "who")).over(w)).withColumn("before_old", F.last(F.when(seen, F.struct(F.col("old_hi").alias("hi"), F.col("old").alias("who"))), ignorenulls=True).over(upto))
        c = c.withColumn("part", F.sum((~self._joins("before")).cast("int")).over(w))
        c = c.withColumn("part_old", F.sum((seen & ~self._joins("before_old", "old", "old_lo")).cast("int")).over(w))
        now = F.min("who").over(W.partitionBy("bucket", "pid", "part"))
        former = F.when(seen, F.min("old").over(W.partitionBy("bucket", "pid", "part_old")))
        changed = c.withColumn("rep", now).withColumn("former", former).where(F.col("new") | (F.col("former.id") != F.col("rep.id")) | (F.col("former.stage") != F.col("rep.stage")))
        at = len(self.generations)
        self._write(changed.select("h", "pid", "bin", "lo", "hi", "who", "rep", none.cast("string").alias("inside"), none.cast("string").alias("across"), "bucket"), folders=False)
        self.batches.append(path)
        delta = self._blocks([self.generations[at]])
        if len(self.generations) > self.compact_every:
            self.compact()
        self.save()
        return self._links(rows, delta)

    def compact(self, all_of_it: bool = False) -> None:
        """Merge the generations of batches into one, and into the history's when they have grown to a fourth of it.

        Files that are no longer named by the state stay until the folder is swept: a batch that is being read may need them.
        """
        first, later = self.generations[:1], self.generations[1:]
        if not later and not all_of_it:
            return
        if all_of_it or self._blocks(later).count() * 4 > self._blocks(first).count():
            later, first = self.generations, []
        blocks = self._blocks(later)
        if not first:
            while blocks.count() > self.buckets * self.rows_per_bucket:
                self.buckets *= 2
        none = F.lit(None).cast("string")
        merged = self._bucketed(self._folded(blocks)).repartition("bucket").select("h", "pid", "bin", "lo", "hi", "who", "rep", none.alias("inside"), none.alias("across"), "bucket")
        self.generations = first
        self._write(merged)

    # --- links

    def links(self) -> DataFrame:
        """The repeats of all batches accepted so far, under the representatives of now."""
        if not self.batches:
            return self.spark.createDataFrame([], "first_id bigint, dup_id bigint, score double")
        return self._links(self.spark.read.schema(self._rows_schema).parquet(*self.batches), self._blocks(self.generations[1:] if self._bootstrapped() else None))

    def _bootstrapped(self) -> bool:
        """Whether the first generation is the history's alone, which no batch has touched."""
        return bool(self.generations) and self.generations[0].endswith("=000000") and not self.batches[0].endswith("=000000")

    def _links(self, rows: DataFrame, blocks: DataFrame) -> DataFrame:
        """Rows under another row's representative; what the score of row and block does not bear out is no link."""
        reps = blocks.where("rep IS NOT NULL").groupBy("pid", "bin").agg(F.min("rep").alias("rep"))
        found = rows.join(reps, ["pid", "bin"]).where("who.stage <> rep.stage OR who.id <> rep.id")
        score = self.weights.score(vector("rep", "who", F.lit(True), self.compared), self.compared)
        return found.select(F.col("rep.id").alias("first_id"), F.col("who.id").alias("dup_id"), score.alias("score")).where("score > 0")


def _plain_schema(schema: T.StructType) -> T.StructType:
    """The same types, every field nullable, as files are read."""
    return T.StructType([T.StructField(f.name, T._parse_datatype_string(f.dataType.simpleString())) for f in schema])


def _any_of(name: str, values: list[int]) -> Column:
    """``name`` equals one of the values, as a balanced tree: unlike a long list it reaches the column index of the files."""
    if not values:
        return F.lit(False)
    if len(values) == 1:
        return F.col(name) == F.lit(values[0])
    mid = len(values) // 2
    return _any_of(name, values[:mid]) | _any_of(name, values[mid:])
