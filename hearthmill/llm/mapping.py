"""Mapping free-entered values to a canonical list: prefix-filter set-similarity join.

Texts become sets of padded q-grams and of their single letters (a repeated one counts as a new element):
letters keep texts with swapped, doubled or lost letters alike, of which short words keep few q-grams.
Elements are ordered by global rarity; two sets of Jaccard similarity t or more
must share one of their rarest ``n - ceil(t n) + 1`` elements, so only these
prefixes are joined. Length and position bounds thin the candidates, Jaccard is
then verified exactly, and the best entry is kept.

Only distinct texts are joined: a spelling that a third of all rows use is one
set. Common elements are at the end of the order and hardly ever in a prefix.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from hearthmill.operators.relational import small
from hearthmill.session import materialize

_ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñýÿ"
_PLAIN = "aaaaaaeeeeiiiiooooouuuucnyy"


def plain(text: Column) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(text), _ACCENTED, _PLAIN)


def gram_sets(df: DataFrame, q: int = 2) -> DataFrame:
    """(text, g): the padded q-grams and the letters of each distinct text, the k-th occurrence of one marked with k; null and empty texts left out."""
    s = F.concat(F.lit("^" * (q - 1)), F.col("text"), F.lit("$" * (q - 1)))
    raw = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - q + 1, F.lit(1))), lambda i: F.substring(s, i, q))
    raw = F.concat(raw, F.split(F.col("text"), ""))
    counted = df.select("text").where(F.col("text") != "").distinct().select("text", F.explode(raw).alias("gram")).groupBy("text", "gram").agg(F.count("*").alias("c"))
    marked = counted.select("text", F.explode(F.transform(F.sequence(F.lit(1), F.col("c")), lambda k: F.concat("gram", F.lit("\u0001"), k.cast("string")))).alias("t"))
    return marked.groupBy("text").agg(F.collect_list("t").alias("g"))


def similarity_join(left: DataFrame, right: DataFrame, threshold: float, q: int = 2) -> DataFrame:
    """Pairs of distinct texts (left_text, right_text, jaccard) at or above ``threshold``.

    ``left`` and ``right`` have one column ``text``; null and empty texts match nothing.
    """

    a, b = gram_sets(left, q), gram_sets(right, q)
    counts = a.select(F.explode("g").alias("t")).unionByName(b.select(F.explode("g").alias("t"))).groupBy("t").agg(F.count("*").alias("f"))

    def prefixes(df: DataFrame, side: str) -> DataFrame:
        n = F.size("g")
        e = df.select("text", "g", n.alias("n"), F.explode("g").alias("t")).join(small(counts, 200_000), "t")  # one row for each gram of the alphabet, else Spark splits the hot ones
        pos = F.row_number().over(W.partitionBy("text").orderBy("f", "t"))
        return e.withColumn("pos", pos).where(F.col("pos") <= F.col("n") - F.ceil(F.col("n") * threshold) + 1).select(
            "t", F.col("text").alias(f"{side}_text"), F.col("g").alias(f"{side}_g"), F.col("n").alias(f"{side}_n"), F.col("pos").alias(f"{side}_pos")
        )

    x, y = prefixes(a, "left"), prefixes(b, "right")
    ln, rn = F.col("left_n"), F.col("right_n")
    need = F.ceil((ln + rn) * (threshold / (1 + threshold)) - 1e-9)
    room = 1 + F.least(ln - F.col("left_pos"), rn - F.col("right_pos"))
    # the rest of the overlap lies behind the shared element, up to one less for each shared element before it
    ahead = F.least(F.col("left_pos"), F.col("right_pos")) - 1
    pairs = (
        x.join(y, "t")
        .where((ln >= rn * threshold) & (rn >= ln * threshold) & (room + ahead >= need))
        .select("left_text", "left_g", "left_n", "right_text", "right_g", "right_n")
        .dropDuplicates(["left_text", "right_text"])
    )
    both = F.size(F.array_intersect("left_g", "right_g"))
    return pairs.select("left_text", "right_text", (both / (ln + rn - both)).alias("jaccard")).where(F.col("jaccard") >= threshold)


# --- place names ------------------------------------------------------------------------------


@dataclass(frozen=True)
class PlaceRules:
    """How place names are written in a source: regular expressions of the words around them, lower case and without accents.

    ``unit``: words that say that a place is a whole unit (a county); ``idle``: words that do not name it; ``kind``: a word that is
    part of a name, but may be left out where only the unit is meant; ``dropped``: names that only locate the one before.
    """

    unit: str = r"\b(?:co|county)\b"
    idle: str = r"\b(?:the|town|of|co|county)\b"
    kind: str = "city"
    dropped: tuple[str, ...] = ()


def place_segments(value: Column, rules: PlaceRules) -> Column:
    """Array of the places a typed value names, in order: struct(text without blanks, bare: without city too, is_county).

    Commas, brackets, slashes and spaced hyphens part places; a word in brackets that is the kind or unit
    belongs to the name before it; names that only locate are dropped behind another.
    """
    v = plain(value)
    v = F.regexp_replace(v, rf"\(\s*({rules.kind}|(?:{rules.unit})\.?)\s*\)", " $1 ")
    v = F.regexp_replace(v, rf"\b{rules.kind} of ([a-z]+)", f"$1 {rules.kind}")
    parts = F.split(v, r"[,;()/|]|\s[-–]\s")
    words = F.transform(parts, lambda p: F.trim(F.regexp_replace(p, r"[^a-z0-9]+", " ")))
    words = F.filter(words, lambda p: p != "")
    words = F.filter(words, lambda p, i: (i == 0) | ~p.isin(*rules.dropped))
    named = F.transform(words, lambda p: F.struct(F.regexp_replace(p, rules.idle, "").alias("name"), p.rlike(rules.unit).alias("is_county")))
    seg = F.transform(
        named,
        lambda s: F.struct(
            F.regexp_replace(s["name"], " ", "").alias("text"), F.regexp_replace(s["name"], rf"\b{rules.kind}\b| ", "").alias("bare"), s["is_county"].alias("is_county")
        ),
    )
    return F.filter(seg, lambda s: s["text"] != "")


def map_places(values: DataFrame, reference: DataFrame, rules: PlaceRules, threshold: float = 0.46, q: int = 2) -> DataFrame:
    """Best reference entry of each value: (src, value, location_id, jaccard); 0 and null where none is meant.

    ``values`` (src, value, county_only): a value of a ``county_only`` column always means
    an entry of kind county, whichever place of it names one; else the first place named is
    meant. ``reference`` (location_id, canonical_name, kind). The best entry has the greatest
    similarity, at least ``threshold``; ties go to the fewer edits, then to the smaller id. Values without a letter map to nothing.
    """
    v = materialize(values.select("src", "value", "county_only").distinct(), "values")  # read several times by the join
    v = v.withColumn("segs", place_segments(F.col("value"), rules))
    s = v.select("src", "value", "county_only", F.posexplode("segs").alias("pos", "seg")).select(
        "src", "value", "county_only", "pos", F.when(F.col("county_only"), F.col("seg.bare")).otherwise(F.col("seg.text")).alias("text"), "seg.is_county"
    )
    s = s.where(F.col("county_only") | (F.col("pos") == 0))
    ref = reference.select("location_id", "kind", F.explode(place_segments(F.col("canonical_name"), rules)).alias("seg")).select("location_id", "kind", F.col("seg.text").alias("right_text"))
    pairs = similarity_join(s.select("text"), ref.select(F.col("right_text").alias("text")), threshold, q)
    named = s.join(pairs, s["text"] == pairs["left_text"]).join(ref, "right_text")
    named = named.where(~(F.col("county_only") | F.col("is_county")) | (F.col("kind") == "county"))
    rank = F.struct(
        F.when(F.col("is_county"), 0).otherwise(1).alias("flag"), (-F.col("jaccard")).alias("far"), F.levenshtein("left_text", "right_text").alias("edits"), "location_id", F.col("jaccard").alias("jaccard")
    )
    best = named.groupBy("src", "value").agg(F.min(rank).alias("best"))
    return (
        v.select("src", "value")
        .join(best, ["src", "value"], "left")
        .select("src", "value", F.coalesce("best.location_id", F.lit(0)).cast("int").alias("location_id"), F.col("best.jaccard").alias("jaccard"))
    )
