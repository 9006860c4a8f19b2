"""File and catalog sources: Parquet, CSV seeds, JSON landing files, statistical cubes, embedded page data."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- scans ------------------------------------------------------------------------------------


def scan(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None, **options: str) -> DataFrame:
    """A file source. With a schema nothing is inferred, so no job runs before the query does."""
    r = spark.read.format(kind).options(**options)
    return (r.schema(schema) if schema is not None else r).load(path)


def seed_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None) -> DataFrame:
    """A CSV seed with a header. Types are inferred, except those given by column."""
    raw = spark.read.csv(path, header=True, inferSchema=not types or None)
    return raw.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if types and c in types else F.col(f"`{c}`") for c in raw.columns])


def rows_of(spark: SparkSession, sql: str, **params: object) -> list[dict]:
    """Rows of a statement as dictionaries; parameters are bound, never pasted. For small results."""
    return [r.asDict() for r in spark.sql(sql, args=params).collect()]


def jdbc(spark: SparkSession, url: str, dbtable: str, column: str | None = None, lower: str | None = None, upper: str | None = None, partitions: int = 1, **options: str) -> DataFrame:
    """A database table, read in parallel by ranges of ``column`` where one is given."""
    o = {"url": url, "dbtable": dbtable, **options}
    if column:
        o |= {"partitionColumn": column, "lowerBound": str(lower), "upperBound": str(upper), "numPartitions": str(partitions)}
    return spark.read.format("jdbc").options(**o).load()


# --- catalog ----------------------------------------------------------------------------------


def exists(spark: SparkSession, name: str, schema: str | None = None) -> bool:
    return spark.catalog.tableExists(f"{schema}.{name}" if schema else name)


def relations(spark: SparkSession, pattern: str = "*", schema: str | None = None, exclude: str | None = None) -> list[str]:
    """Names of tables and views that match a pattern (``*``, ``?``), sorted."""
    names = [t.name for t in spark.catalog.listTables(schema)]
    return sorted(n for n in names if fnmatch.fnmatch(n, pattern) and not (exclude and fnmatch.fnmatch(n, exclude)))


def columns(spark: SparkSession, name: str) -> list[tuple[str, str]]:
    """(column, type) of a relation, from the analyser: no data is read."""
    return spark.table(name).dtypes


def query_columns(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """(column, type) of a statement's result; it is analysed, not run."""
    return spark.sql(sql).dtypes


def catalog(spark: SparkSession, schema: str | None = None) -> DataFrame:
    """(relation, kind, column, position, type) of every table and view."""
    rows = []
    for t in spark.catalog.listTables(schema):
        full = f"{schema}.{t.name}" if schema and not t.isTemporary else t.name
        rows += [(t.name, t.tableType, c, i, k) for i, (c, k) in enumerate(columns(spark, full), 1)]
    return spark.createDataFrame(rows, "relation string, kind string, column string, position int, type string")


# --- statistical cubes (JSON-stat 2.0) --------------------------------------------------------

#: shape of a cube as far as it is read; category.index may be a list or a map, so it stays text
CUBE = "struct<id:array<string>,size:array<int>,value:array<double>,dimension:map<string,struct<label:string,category:struct<index:string,label:map<string,string>>>>>"


def _codes(index: Column, labels: Column) -> Column:
    """Category codes in order, from an index written as a list or as a map of positions (or the labels alone)."""
    as_list = F.from_json(index, "array<string>")
    as_map = F.from_json(index, "map<string,int>")
    order = F.transform(F.array_sort(F.transform(F.map_entries(as_map), lambda e: F.struct(e["value"], e["key"]))), lambda e: e["key"])
    return F.when(index.startswith("["), as_list).when(index.startswith("{"), order).otherwise(F.map_keys(labels))


def flatten_cube(df: DataFrame, text: str, dims: list[str], keep: list[str] | None = None) -> DataFrame:
    """One row for each value of JSON-stat cubes in column ``text``: for each dimension its code and ``<dim>_Label``.

    The last dimension runs fastest; a position's codes follow from its number by division,
    so no product of dimensions is built. Cells beyond the values are not made; a code without
    a label is its own label; a text that is no cube gives no row.
    """
    c = F.from_json(F.col(text), CUBE)
    base = df.select(*(keep or []), c.alias("c")).where(F.col("c.value").isNotNull() & F.col("c.size").isNotNull())
    size = F.col("c.size")
    codes, labels, strides = [], [], []
    for d in dims:
        cat = F.element_at(F.col("c.dimension"), d)["category"]
        at = F.array_position(F.col("c.id"), d).cast("int")
        codes.append(_codes(cat["index"], cat["label"]).alias(f"__codes_{d}"))
        labels.append(cat["label"].alias(f"__labels_{d}"))
        tail = F.slice(size, at + 1, F.greatest(F.size(size) - at, F.lit(0)))
        strides.append(F.aggregate(tail, F.lit(1).cast("long"), lambda a, x: a * x).alias(f"__stride_{d}"))
    flat = base.select(*(keep or []), *codes, *labels, *strides, F.aggregate(size, F.lit(1).cast("long"), lambda a, x: a * x).alias("__cells"), F.posexplode("c.value").alias("position", "value"))
    out = []
    for d in dims:
        n = F.size(f"__codes_{d}")
        code = F.get(F.col(f"__codes_{d}"), ((F.col("position") / F.col(f"__stride_{d}")).cast("long") % n).cast("int"))
        out += [code.alias(d), F.coalesce(F.element_at(F.col(f"__labels_{d}"), code), code).alias(f"{d}_Label")]
    return flat.where(F.col("position") < F.col("__cells")).select(*(keep or []), "position", *out, "value")


# --- pages ------------------------------------------------------------------------------------


def embedded_json(html: Column, script_id: str) -> Column:
    """Text inside the script tag of that id; null where a page has none."""
    got = F.regexp_extract(html, rf"""(?is)<script[^>]*\bid\s*=\s*["']{script_id}["'][^>]*>(.*?)</script>""", 1)
    return F.nullif(F.trim(got), F.lit(""))


def embedded_rows(df: DataFrame, html: str, script_id: str, path: list[str], item: str, keep: list[str] | None = None) -> DataFrame:
    """One row for each element of the list at ``path`` in a page's embedded JSON, as struct ``item`` of schema ``item``.

    Pages without the script, with broken JSON or without the list give no row.
    """
    kind = f"array<{item}>"
    for p in reversed(path):
        kind = f"struct<`{p}`:{kind}>"
    parsed = F.from_json(embedded_json(F.col(html), script_id), kind)
    for p in path:
        parsed = parsed[p]
    return df.select(*(keep or []), F.explode(parsed).alias("item"))


def cards(html: Column, patterns: list[str], longest: int = 200) -> Column:
    """Fallback when a page has no embedded data: texts of the first pattern with any match, tags stripped, cut to ``longest``."""
    found = [F.regexp_extract_all(html, F.lit(p), F.lit(1)) for p in patterns]
    first = F.coalesce(*[F.when(F.size(f) > 0, f) for f in found], F.array().cast("array<string>"))
    return F.transform(first, lambda t: F.substring(F.trim(F.regexp_replace(F.regexp_replace(t, r"<[^>]*>", " "), r"\s+", " ")), 1, longest))


def page_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))
