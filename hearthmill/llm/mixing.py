"""Mixing sources to target weights by systematic sampling.

Within a source every document has the same expected number of copies, the
source's share of the budget over its tokens. Documents are put in an order,
their expected copies are prefix-summed, one random offset is added, and a
document is emitted once for each integer that its interval crosses: never
more often than the next integer above its expectation, and the total is right
to one copy. In the order used, documents of like length stand together, so the
tokens come out as close as the copies.

The prefix sum is two-level (chunks of a source, then rows of a chunk), so a
source that holds most of the rows is spread over many tasks.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthmill.session import materialize, ship

DEFAULT_TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: fixed value: the published splitting pattern of this byte-level vocabulary
BYTE_BPE_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_ENCODERS: dict[str, object] = {}


def _encoder(path: str):
    """The tokenizer of a rank file, loaded once for each Python worker."""
    if path not in _ENCODERS:
        import base64

        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _ENCODERS[path] = tiktoken.Encoding("own", pat_str=BYTE_BPE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODERS[path]


def token_counts(docs: DataFrame, key: str, text: str, keep: list[str], path: str = DEFAULT_TOKENIZER) -> DataFrame:
    """(key, kept columns, n_tokens) of every document; null and empty texts have 0 tokens. Whole texts are counted."""
    ship(docs.sparkSession)
    flat = docs.select(F.col(key).alias(key), *keep, F.col(text).alias("__text"))
    names = [key, *keep]
    schema = docs.select(*names).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            n = [len(enc.encode_ordinary(t)) if t else 0 for t in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return flat.mapInArrow(count, schema)


def mix(
    docs: DataFrame, targets: DataFrame, key: str = "doc_id", text: str = "text", source: str = "source", budget: int | None = None, seed: int = 0, chunk_rows: int = 50_000, path: str = DEFAULT_TOKENIZER
) -> tuple[DataFrame, DataFrame]:
    """(mixture, shares) for ``targets`` (source, target_share, max_repeats).

    Mixture: (key, source, n_tokens, copies), copies from 1. Shares: for each target its
    tokens, copies and the share reached. ``budget`` in tokens; by default the most that
    all targets can reach without exceeding ``max_repeats``. A source whose own limit is below
    its part of a given budget gets its limit, and the shares report says so. Documents
    without text, or of sources that are no target, take no part; a target without
    documents gets share 0 and does not bind the budget.
    """
    spark = docs.sparkSession
    want = targets.select("source", "target_share", "max_repeats").where("source IS NOT NULL")
    mine = docs.join(F.broadcast(want.select(F.col("source").alias(source)).distinct()), source, "left_semi").where(F.length(text) > 0)  # a row for each target
    counted = materialize(token_counts(mine, key, text, [source], path), "tokens")
    have = {r[0]: (r[1], r[2]) for r in counted.groupBy(source).agg(F.count("*"), F.sum("n_tokens")).collect()}  # a row for each target
    rows, plan = want.collect(), []
    if budget is None:
        limits = [have[r.source][1] * r.max_repeats / r.target_share for r in rows if have.get(r.source, (0, 0))[1] and r.target_share]
        budget = min(limits, default=0)
    for r in sorted(rows, key=lambda r: r.source):
        n, tokens = have.get(r.source, (0, 0))
        copies = min(float(r.max_repeats), r.target_share * budget / tokens) if tokens else 0.0
        offset = random.Random(f"{seed}|{r.source}").random()
        plan.append((r.source, float(r.target_share), int(r.max_repeats), float(copies), offset, max(1, n // chunk_rows)))
    goal = spark.createDataFrame(plan, "source string, target_share double, max_repeats int, expected double, offset double, chunks int")
    d = counted.withColumnRenamed(source, "source").join(F.broadcast(goal), "source")
    h = F.xxhash64(key, F.lit(seed))
    d = d.withColumn("chunk", F.pmod(h, F.col("chunks")))
    sizes = d.groupBy("source", "chunk").agg(F.count("*").alias("rows"))
    before = F.sum("rows").over(W.partitionBy("source").orderBy("chunk")) - F.col("rows")
    sizes = sizes.select("source", "chunk", before.alias("before"))
    place = F.row_number().over(W.partitionBy("source", "chunk").orderBy("n_tokens", h, key))
    end = (F.col("before") + place) * F.col("expected") + F.col("offset")
    out = d.join(sizes, ["source", "chunk"]).withColumn("end", end).withColumn("copies", (F.floor("end") - F.floor(F.col("end") - F.col("expected"))).cast("int"))
    # a sum of doubles may cross an integer a hair early; the cap is exact
    out = out.withColumn("copies", F.least("copies", "max_repeats")).where("copies > 0")
    mixture = materialize(out.select(key, "source", "n_tokens", "copies"), "mixture")
    got = mixture.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("copies").cast("long").alias("copies"), F.max("copies").alias("most_copies"))
    s = goal.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["tokens", "copies", "most_copies"])
    total = s.agg(F.sum("tokens").alias("total"))
    s = s.crossJoin(F.broadcast(total)).select("source", "target_share", (F.try_divide("tokens", "total")).alias("share"), "tokens", "copies", "most_copies", "max_repeats")
    return mixture, s
