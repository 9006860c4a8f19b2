"""Loaders: raw records into bronze tables, with renames, coercion and de-duplication.

One chain for all feeds: rename by alias map -> coerce types (bad values become null) -> first row of
each key in the batch -> drop keys that the table has -> append. The table's keys are read once.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearthmill.functions.datetimes import year_of_period
from hearthmill.operators.relational import anti_null_safe, keep_first
from hearthmill.plans.store import TableStore
from hearthmill.sources.files import flatten_cube

log = logging.getLogger("hearthmill")


@dataclass
class Feed:
    """How one feed becomes rows of one table.

    ``constants`` fill columns that a batch does not bring. ``first_by`` orders the rows of a key in a
    batch, of which the first is kept; without it that is the order in which the batch is read.
    """

    table: str
    schema: str
    keys: list[str]
    aliases: dict[str, str] = field(default_factory=dict)
    constants: dict[str, Column] = field(default_factory=dict)
    computed: dict[str, Callable[[DataFrame], Column]] = field(default_factory=dict)
    first_by: list[str] = field(default_factory=list)
    dedupe_batch: bool = True
    dims: list[str] = field(default_factory=list)

    def fields(self) -> T.StructType:
        return T._parse_datatype_string(self.schema)


def rename(df: DataFrame, aliases: dict[str, str], drop_suffix: str = "_Label") -> DataFrame:
    """Columns under their table names; a byte-order mark and quotes around a name are ignored, unmapped label columns go.

    Where several aliases of one target occur, the first in the map that holds a value counts.
    """
    have = {c.lstrip("\ufeff").strip('"'): c for c in df.columns}
    found: dict[str, list[Column]] = {}
    for source, target in aliases.items():
        if source in have:
            found.setdefault(target, []).append(F.col(f"`{have[source]}`"))
    out = [(F.coalesce(*cs) if len(cs) > 1 else cs[0]).alias(target) for target, cs in found.items()]
    for plain, c in have.items():
        if plain not in aliases and plain not in found and not plain.endswith(drop_suffix):
            out.append(F.col(f"`{c}`").alias(plain))
    return df.select(*out)


def coerce(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the columns of a schema: missing ones null, bad values null, texts of numbers and flags read."""
    out = []
    for f in schema:
        if f.name not in df.columns:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
            continue
        c = F.col(f"`{f.name}`")
        source = df.schema[f.name].dataType
        if source == f.dataType:
            out.append(c.alias(f.name))
        elif isinstance(f.dataType, (T.IntegerType, T.LongType)) and isinstance(source, (T.StringType, T.DoubleType, T.FloatType)):
            out.append(c.try_cast("double").try_cast(f.dataType).alias(f.name))
        elif isinstance(source, (T.ArrayType, T.StructType, T.MapType)):
            out.append(F.to_json(c).alias(f.name) if isinstance(f.dataType, T.StringType) else F.lit(None).cast(f.dataType).alias(f.name))
        else:
            out.append(c.try_cast(f.dataType).alias(f.name))
    return df.select(*out)


def prepare(df: DataFrame, feed: Feed) -> DataFrame:
    """A raw batch as rows of the feed's table, before any de-duplication."""
    d = rename(df, feed.aliases) if feed.aliases else df
    for n, c in feed.constants.items():
        if n not in d.columns:
            d = d.withColumn(n, c)
    for n, make in feed.computed.items():
        d = d.withColumn(n, make(d))
    return coerce(d, feed.fields())


def load(store: TableStore, df: DataFrame, feed: Feed) -> int:
    """Add what is new; returns how many rows were added. An empty batch adds none."""
    return _add(store, prepare(df, feed), feed)


def _first_read(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The first row of each key in reading order, by a partial aggregate; nulls are equal."""
    rest = [F.col(f"`{c}`") for c in rows.columns if c not in keys]
    kept = rows.withColumn("__at", F.monotonically_increasing_id()).groupBy(*keys).agg(F.min(F.struct("__at", *rest)).alias("__row"))
    return kept.select(*keys, "__row.*").select(*rows.columns)


def _add(store: TableStore, rows: DataFrame, feed: Feed) -> int:
    """Add prepared rows whose keys the table lacks."""
    if feed.dedupe_batch:
        order = [F.col(c).asc_nulls_last() for c in feed.first_by]
        rows = keep_first(rows, feed.keys, order) if order else _first_read(rows, feed.keys)
    if store.exists(feed.table):
        rows = anti_null_safe(rows, store.read(feed.table), feed.keys)
    from hearthmill.session import materialize

    rows = materialize(rows, feed.table)
    n = rows.count()
    if n or not store.exists(feed.table):
        store.append(feed.table, rows)
    log.info("%s: %d rows added", feed.table, n)
    return n


def load_rows(store: TableStore, rows: list[dict], feed: Feed, raw_schema: str) -> int:
    """Add records given as dictionaries; fields that a record lacks are null, unknown ones are left out."""
    kind = T._parse_datatype_string(raw_schema)
    data = [tuple(r.get(n) for n in kind.fieldNames()) for r in rows]
    return load(store, store.spark.createDataFrame(data, kind), feed)


def load_all(store: TableStore, batches: dict[str, DataFrame | None], feeds: dict[str, Feed]) -> dict[str, int]:
    """Load each feed that has a batch; a feed that fails counts -1 and does not stop the others."""
    out = {}
    for name, df in batches.items():
        if df is None:
            continue
        try:
            out[name] = load(store, df, feeds[name])
        except Exception:
            log.exception("feed %s failed", name)
            out[name] = -1
    return out


# --- feeds ------------------------------------------------------------------------------------


def _cube(table: str, dims: dict[str, tuple[str, str]], keys: list[str], value: str, periods: tuple[str, ...] = ("TLIST(A1)",)) -> Feed:
    """A statistical cube: dimension ids become ``<name>_code``, their labels ``<name>_label``, from JSON-stat or published CSV headers.

    A cube's rows are held against the table only, never against each other: months share a year.
    """
    aliases = {"STATISTIC": "statistic_code", "STATISTIC Label": "statistic_label", "Statistic Label": "statistic_label", "STATISTIC_Label": "statistic_label"}
    for p in periods:
        aliases[p] = "time_period"
    aliases |= {"Year": "year", "UNIT": "unit", "VALUE": "value"}
    for ident, (name, header) in dims.items():
        aliases |= {ident: f"{name}_code", f"{ident}_Label": f"{name}_label", header: f"{name}_label"}
    labels = ", ".join(f"{n}_code string, {n}_label string" for n, _ in dims.values())
    schema = f"statistic_code string, statistic_label string, time_period string, year int, {labels}, unit string, value {value}, date_fetched timestamp, source string"

    def year(d: DataFrame) -> Column:
        own = F.col("year").try_cast("int") if "year" in d.columns else F.lit(None).cast("int")
        return F.coalesce(own, year_of_period(F.col("time_period"))) if "time_period" in d.columns else own

    constants = {"date_fetched": F.current_timestamp(), "source": F.lit("cso.ie")}
    return Feed(table, schema, keys, aliases, constants, {"year": year}, dedupe_batch=False, dims=["STATISTIC", *periods, *dims])


def cubes() -> dict[str, Feed]:
    """The feeds of the four published cubes (a session must be running)."""
    return {name: _cube(*spec) for name, spec in CUBES.items()}


# fixed values: table, dimension ids with column name and published CSV header, de-duplication keys, type of the value, period dimensions
CUBES = {
    "rent": (
        "raw_cso_rent",
        {"C02970V03592": ("bedrooms", "Number of Bedrooms"), "C02969V03591": ("property_type", "Property Type"), "C03004V03625": ("location", "Location")},
        ["year", "location_label", "bedrooms_label", "property_type_label"], "decimal(10,2)",
    ),
    "cpi": ("raw_cso_cpi", {"C01779V03424": ("commodity", "Commodity Group")}, ["year", "commodity_label", "statistic_code"], "decimal(10,3)", ("TLIST(A1)", "TLIST(M1)", "TLIST(Q1)")),
    "population": ("raw_cso_population", {"C02076V02508": ("age_group", "Age Group"), "C02199V02655": ("sex", "Sex")}, ["year", "age_group_label", "sex_label"], "decimal(12,2)"),
    "income": ("raw_cso_income", {"C02196V02652": ("location", "County and Region")}, ["year", "location_label", "statistic_code"], "decimal(15,2)"),
}

# fixed values: columns of the listings table
LISTING_SCHEMA = (
    "property_id string, daft_shortcode string, title string, seo_title string, price decimal(10,2), price_raw string, abbreviated_price string, property_type string, bedrooms int, "
    "num_bedrooms_raw string, county string, sections string, sale_type string, category string, state string, publish_date bigint, date_of_construction string, scraped_at timestamp, "
    "featured_level string, featured_level_full string, premier_partner boolean, latitude decimal(10,8), longitude decimal(11,8), seo_friendly_path string, seller_id int, seller_name string, "
    "seller_phone string, seller_branch string, seller_type string, licence_number string, total_images int, has_video boolean, has_virtual_tour boolean, has_brochure boolean, ber_rating string, "
    "prs_total_unit_types int, prs_tagline string, property_url string, source string"
)
LISTINGS = Feed("raw_daft_listings", LISTING_SCHEMA, ["property_id", "publish_date"])

# fixed values: shape of one listing in a page's embedded data
LISTING_JSON = (
    "struct<id:string,daftShortcode:string,title:string,seoTitle:string,price:string,abbreviatedPrice:string,propertyType:string,numBedrooms:string,sections:array<string>,saleType:array<string>,"
    "publishDate:bigint,dateOfConstruction:string,category:string,state:string,featuredLevel:string,featuredLevelFull:string,premierPartner:boolean,seoFriendlyPath:string,prsTotalUnitTypes:int,"
    "prsTagline:string,point:struct<coordinates:array<double>>,seller:struct<sellerId:int,name:string,phone:string,branch:string,sellerType:string,licenceNumber:string>,"
    "media:struct<totalImages:int,hasVideo:boolean,hasVirtualTour:boolean,hasBrochure:boolean>,ber:struct<rating:string>>"
)


def flatten_listing(df: DataFrame, item: str, counties: list[str], base_url: str = "") -> DataFrame:
    """Nested listings as flat rows: coordinates are [longitude, latitude], lists joined by commas, county from the title."""
    from hearthmill.functions.strings import digits_to_double, digits_to_int, first_contained

    i = F.col(item)
    quoted = F.coalesce(i["abbreviatedPrice"], i["price"])
    return df.select(
        i["id"].alias("property_id"), i["daftShortcode"].alias("daft_shortcode"), i["title"].alias("title"), i["seoTitle"].alias("seo_title"),
        digits_to_double(quoted).try_cast("decimal(10,2)").alias("price"), i["price"].alias("price_raw"), i["abbreviatedPrice"].alias("abbreviated_price"),
        i["propertyType"].alias("property_type"), digits_to_int(i["numBedrooms"]).alias("bedrooms"), i["numBedrooms"].alias("num_bedrooms_raw"),
        first_contained(i["title"], counties).alias("county"), F.array_join(i["sections"], ",").alias("sections"), F.array_join(i["saleType"], ",").alias("sale_type"),
        i["category"].alias("category"), i["state"].alias("state"), i["publishDate"].alias("publish_date"), i["dateOfConstruction"].alias("date_of_construction"),
        i["featuredLevel"].alias("featured_level"), i["featuredLevelFull"].alias("featured_level_full"), i["premierPartner"].alias("premier_partner"),
        F.get(i["point"]["coordinates"], F.lit(1)).cast("decimal(10,8)").alias("latitude"), F.get(i["point"]["coordinates"], F.lit(0)).cast("decimal(11,8)").alias("longitude"),
        i["seoFriendlyPath"].alias("seo_friendly_path"), i["seller"]["sellerId"].alias("seller_id"), i["seller"]["name"].alias("seller_name"), i["seller"]["phone"].alias("seller_phone"),
        i["seller"]["branch"].alias("seller_branch"), i["seller"]["sellerType"].alias("seller_type"), i["seller"]["licenceNumber"].alias("licence_number"),
        i["media"]["totalImages"].alias("total_images"), i["media"]["hasVideo"].alias("has_video"), i["media"]["hasVirtualTour"].alias("has_virtual_tour"), i["media"]["hasBrochure"].alias("has_brochure"),
        i["ber"]["rating"].alias("ber_rating"), i["prsTotalUnitTypes"].alias("prs_total_unit_types"), i["prsTagline"].alias("prs_tagline"),
        F.concat(F.lit(base_url), i["seoFriendlyPath"]).alias("property_url"),
    )


# --- modes ------------------------------------------------------------------------------------


def load_mode(store: TableStore, table: str, mark: str, force_full: bool = False) -> tuple[str, object | None]:
    """("full", None) for a missing or empty table or when forced, else ("incremental", greatest mark): one pass for count and mark."""
    if force_full or not store.exists(table):
        return "full", None
    r = store.read(table).agg(F.count("*").alias("n"), F.max(mark).alias("m")).first()
    return ("incremental", r.m) if r.n else ("full", None)


def load_cube(store: TableStore, df: DataFrame, feed: Feed, force_full: bool = False) -> bool:
    """Probe, choose the mode, drop years at or before the mark, load. Nothing new counts as success, an error as failure.

    A key column that is null in every row of a batch is an error too: its header was not known, and rows would
    be taken for one another.
    """
    mode, mark = load_mode(store, feed.table, "year", force_full)
    try:
        rows = prepare(df, feed)
        got = rows.agg(F.count("*").alias("n"), *[F.count(f"`{k}`").alias(k) for k in feed.keys]).first()
        if got.n and (lost := [k for k in feed.keys if not got[k]]):
            raise ValueError(f"{feed.table}: no values for {', '.join(lost)}")
        if mode == "incremental" and mark is not None:
            rows = rows.where(F.col("year") > F.lit(mark))
        _add(store, rows, feed)
        return True
    except Exception:
        log.exception("cube %s failed", feed.table)
        return False


def load_cube_text(store: TableStore, df: DataFrame, text: str, feed: Feed, force_full: bool = False) -> bool:
    """Flatten the JSON-stat cubes in column ``text`` and load their cells; dimensions that a cube lacks are null."""
    return load_cube(store, flatten_cube(df, text, feed.dims).withColumnRenamed("value", "VALUE"), feed, force_full)
