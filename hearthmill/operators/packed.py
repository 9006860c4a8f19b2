r"""Several values packed in one field: infer the delimiters, split, keep positions.

For each source and field, every candidate mark is scored on the pieces that it cuts:

* piece-count consistency: how little the number of pieces varies between texts that hold the mark
  (one over one plus the squared coefficient of variation);
* piece type regularity: how few types the pieces have (initial, digits, number of words), as one
  minus the entropy of the types over that of sixteen equal ones;
* independence: how freely the pieces on its two sides combine, as the chance that two texts
  with the same piece before the mark have different ones behind it. A mark inside a name (the slash
  of ``Short-term/Holiday``) binds its sides. Where pieces seldom come again, what is usual
  for the mark counts.

All statistics run over the whole table, aggregated to distinct texts first, so one text that holds a
third of the rows is one row from then on. Nothing needs to be known about the values: a field
in which no value ever comes again is split by counts and types.

Splitting respects double quotes (``""`` and ``\"`` inside), single quotes
around a whole item, and JSON-like brackets around the list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearthmill.session import materialize

#: a hyphen between blanks, as one character while a text is cut
_DASH = "\ue003"
#: marks that may separate values, with how freely their sides usually combine: most hardly occur inside names, some often do
CANDIDATES = {",": 0.7, ";": 0.7, "|": 0.7, "\t": 0.7, "\n": 0.7, "~": 0.7, "·": 0.7, "•": 0.7, "¦": 0.7, _DASH: 0.5, "/": 0.1, "&": 0.1}
#: the marks that every text is cut at while another one is scored
BASE = (",", ";", "|", "\t", "\n")

_SPECIAL = {"\t": r"\t", "\n": r"\n", "|": r"\|", "/": "/", "&": "&", "-": r"\-", "]": r"\]", "[": r"\[", "^": r"\^"}


def _class(marks: str | tuple[str, ...]) -> str:
    return "".join(_SPECIAL.get(m, m) for m in marks)


def _body(text: Column) -> Column:
    """The list inside JSON-like brackets, or the text as it is; a hyphen between blanks as one mark."""
    text = F.when(F.contains(text, F.lit(" - ")), F.regexp_replace(text, " -(?= )", f" {_DASH}")).otherwise(text)
    return F.when(text.rlike(r"^\s*\[(?s:.*)\]\s*$"), F.regexp_extract(text, r"^\s*\[((?s:.*))\]\s*$", 1)).otherwise(text)


def _item_pattern(marks: Column) -> Column:
    """Regular expression of one separator and the item behind it; ``marks`` is a character-class body."""
    blank = r"[^\S\t\n]*"
    quoted = rf'{blank}"(?:[^"\\]|""|\\.)*"\s*?(?=[' + "{m}" + rf"]|{blank}$)"
    single = rf"{blank}'(?:[^']|'(?!{blank}(?:[" + "{m}" + rf"]|$)))*'{blank}(?=[" + "{m}" + r"]|$)"
    template = "[{m}]((?s)" + quoted + "|" + single + "|[^{m}]*)"
    return F.replace(F.lit(template), F.lit("{m}"), marks)


def _separated(text: Column, marks: Column) -> Column:
    """Array of the pieces of a packed text, each behind its separator (the first behind an added one)."""
    # a separator in front makes every piece follow one, so that an empty first piece is kept
    lead = F.when(marks.startswith("\\"), F.when(marks.startswith("\\t"), F.lit("\t")).when(marks.startswith("\\n"), F.lit("\n")).otherwise(F.substring(marks, 2, 1))).otherwise(F.substring(marks, 1, 1))
    return F.regexp_extract_all(F.concat(lead, _body(text)), _item_pattern(marks), F.lit(0))


def raw_pieces(text: Column, marks: Column) -> Column:
    """Array of the pieces of a packed text, outer blanks and quotes still on; ``marks`` as in ``_class``."""
    return F.transform(_separated(text, marks), lambda p: p.substr(F.lit(2), F.length(p)))


def clean_piece(piece: Column) -> Column:
    """A piece without outer blanks and enclosing quotes, inner escapes resolved."""
    t = F.regexp_replace(piece, r"^\s+|\s+$", "")
    dq = t.rlike(r'^"(?s:.*)"$') & (F.length(t) >= 2)
    sq = t.rlike(r"^'(?s:.*)'$") & (F.length(t) >= 2)
    body = F.substring(t, F.lit(2), F.length(t) - 2)
    unescaped = F.regexp_replace(F.replace(body, F.lit('""'), F.lit('"')), r"\\(.)", "$1")
    out = F.when(dq, unescaped).when(sq, F.replace(body, F.lit("''"), F.lit("'"))).otherwise(t)
    return F.translate(F.regexp_replace(out, r"^\s+|\s+$", ""), _DASH, "-")


def packed_texts(df: DataFrame, fields: list[str], source: str | None) -> DataFrame:
    """Distinct texts of the fields with their number of rows: (source, field, text, n)."""
    src = F.col(f"`{source}`").cast("string") if source else F.lit(None).cast("string")
    parts = [df.select(src.alias("source"), F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields]
    return reduce(DataFrame.unionByName, parts).where(F.col("text").isNotNull()).groupBy("source", "field", "text").agg(F.count("*").alias("n"))


def _cut(texts: DataFrame, marks: tuple[str, ...], wanted: tuple[str, ...]) -> DataFrame:
    """(source, field, mark, left, right, pieces): the pieces beside each wanted mark outside quotes, when cut at ``marks``.

    For each text and mark there is one row besides, without sides, with the number of ``pieces`` that the mark makes of it.
    """
    held = reduce(lambda x, y: x | y, [F.contains("text", F.lit(" - " if m == _DASH else m)) for m in wanted])
    cut = texts.where(held).withColumn("parts", _separated(F.col("text"), F.lit(_class(marks)))).where(F.size("parts") > 1)
    parts = F.col("parts")
    flank = F.transform(
        F.sequence(F.lit(2), F.size(parts)),
        lambda i: F.struct(F.substring(F.get(parts, i - 1), 1, 1).alias("mark"), F.get(parts, i - 2).alias("left"), F.get(parts, i - 1).alias("right")),
    )
    of_wanted = F.filter(flank, lambda x: x["mark"].isin(list(wanted)))
    inner = lambda c: clean_piece(c.substr(F.lit(2), F.length(c)))
    marks_of = F.transform(F.col("flank"), lambda x: x["mark"])
    none = F.lit(None).cast("string")
    # a row for each flank and one for each mark of a text, so that the work stays linear in its pieces
    sides = F.transform(F.col("flank"), lambda x: F.struct(x["mark"].alias("mark"), inner(x["left"]).alias("left"), inner(x["right"]).alias("right"), F.lit(None).cast("int").alias("pieces")))
    totals = F.transform(F.array_distinct(marks_of), lambda m: F.struct(m.alias("mark"), none.alias("left"), none.alias("right"), (F.size(F.filter(F.col("marks"), lambda x: x == m)) + 1).alias("pieces")))
    return cut.withColumn("flank", of_wanted).withColumn("marks", marks_of).select("source", "field", F.inline(F.concat(sides, totals)))


def _type(piece: Column) -> Column:
    """Type of a piece: its initial, whether it holds digits, and one, two or more words."""
    initial = F.when(piece.rlike(r"^\p{Lu}"), "A").when(piece.rlike(r"^\p{L}"), "a").when(piece.rlike(r"^\p{Nd}"), "0").otherwise("-")
    return F.concat(initial, F.when(piece.rlike(r"\p{Nd}"), "0").otherwise("-"), F.least(F.size(F.split(piece, r"\s+")), F.lit(3)).cast("string"))


def score_delimiters(texts: DataFrame, candidates: dict[str, float] | None = None, doubt: float = 4.0) -> DataFrame:
    """(source, field, mark, texts, consistency, regularity, independence, score) of each candidate that occurs outside quotes.

    ``doubt``: how many observations the usual independence of a mark weighs.
    """
    marks = candidates or CANDIDATES
    base = tuple(m for m in BASE if m in marks)
    sides = [_cut(texts, base, base)] if base else []
    others = tuple(m for m in marks if m not in base)
    sides += [_cut(texts, (*base, *others), others)] if others else []
    pairs = reduce(DataFrame.unionByName, sides).groupBy("source", "field", "mark", "left", "right").agg(
        F.count("*").alias("c"), F.count("pieces").alias("texts"), F.sum("pieces").alias("k"), F.sum(F.col("pieces") * F.col("pieces")).alias("k2")
    )
    pairs = materialize(pairs, "pairs")
    on = ["source", "field", "mark"]
    counts = pairs.groupBy(*on).agg(F.sum("texts").alias("texts"), F.sum("k").alias("k"), F.sum("k2").alias("k2"))
    pairs = pairs.where("left IS NOT NULL")
    mean = F.col("k") / F.col("texts")
    counts = counts.select(*on, "texts", (1 / (1 + (F.col("k2") / F.col("texts") - mean * mean) / (mean * mean))).alias("consistency"))
    kinds = pairs.select(*on, "c", F.explode(F.array(*[F.when(F.col(x) != "", _type(F.col(x))) for x in ("left", "right")])).alias("t")).where("t IS NOT NULL")
    kinds = kinds.groupBy(*on, "t").agg(F.sum("c").alias("c")).groupBy(*on).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log2("c")).alias("s"))
    kinds = kinds.select(*on, F.greatest(F.lit(0.0), 1 - (F.log2("n") - F.col("s") / F.col("n")) / 4).alias("regularity"))
    beside = pairs.where("left <> '' AND right <> '' AND left <> right").groupBy(*on, "left").agg(F.sum("c").alias("n"), F.sum(F.col("c") * (F.col("c") - 1)).alias("same")).where("n > 1")
    # of a piece seen n times, the chance that two of its partners differ, weighed by n - 1
    free = beside.groupBy(*on).agg(F.sum(F.col("n") - 1).alias("seen"), F.sum((F.col("n") - 1) - F.col("same") / F.col("n")).alias("differ"))
    null_safe = lambda a, b: reduce(lambda x, y: x & y, [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in on])
    usual = F.coalesce(*[F.when(F.col("a.mark") == m, F.lit(p)) for m, p in marks.items()])
    joined = counts.alias("a").join(kinds.alias("b"), null_safe("a", "b"), "left").join(free.alias("c"), null_safe("a", "c"), "left")
    seen, differ = F.coalesce("c.seen", F.lit(0)), F.coalesce("c.differ", F.lit(0.0))
    scored = joined.select(*[F.col(f"a.{c}").alias(c) for c in on], "a.texts", "a.consistency", F.coalesce("b.regularity", F.lit(0.0)).alias("regularity"), ((usual * doubt + differ) / (doubt + seen)).alias("independence"))
    return scored.withColumn("score", F.col("consistency") * 0.25 + F.col("regularity") * 0.25 + F.col("independence") * 0.5)


def infer_delimiters(texts: DataFrame, candidates: dict[str, float] | None = None, least: float = 0.6) -> DataFrame:
    """(source, field, marks): the marks of each source and field that score ``least`` or more, as a character-class body."""
    known = list(candidates or CANDIDATES)
    order = F.array(*[F.lit(c) for c in known])
    escaped = F.array(*[F.lit(_class((c,))) for c in known])
    return (
        score_delimiters(texts, candidates)
        .where(F.col("score") >= least)
        .groupBy("source", "field")
        .agg(F.array_sort(F.collect_set(F.array_position(order, F.col("mark")).cast("int"))).alias("k"))
        .select("source", "field", F.array_join(F.transform("k", lambda i: F.element_at(escaped, i)), "").alias("marks"))
    )


def split_values(df: DataFrame, key: str, fields: list[str], source: str | None = None, candidates: dict[str, float] | None = None, broadcast_rows: int = 100_000) -> DataFrame:
    """One row per value: (key, field, pos, item), positions from 1.

    Null texts give no row; an empty value takes a position but gives none;
    repeated values stay. A source and field without any accepted mark keeps its
    texts whole. Sources may be null.

    The inferred marks, one row for each source and field, are written out and
    counted: up to ``broadcast_rows`` they are broadcast and the table is split in
    its scan without any shuffle; beyond, Spark joins on source and field and splits
    skewed ones.
    """
    texts = materialize(packed_texts(df, fields, source), "packed-texts")  # read several times by the scoring
    marks = materialize(infer_delimiters(texts, candidates), "marks")
    if marks.count() <= broadcast_rows:
        marks = F.broadcast(marks)
    src = F.col(f"`{source}`").cast("string") if source else F.lit(None).cast("string")
    packed = F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"`{f}`").cast("string").alias("text")) for f in fields])
    rows = df.select(F.col(f"`{key}`").alias("key"), src.alias("source"), F.inline(F.filter(packed, lambda x: x["text"].isNotNull())))
    r, m = rows.alias("r"), marks.alias("m")
    text = F.col("r.text")
    pieces = F.when(F.col("m.marks").isNull(), F.array(_body(text))).otherwise(raw_pieces(text, F.coalesce(F.col("m.marks"), F.lit(","))))
    items = F.filter(
        F.transform(F.transform(pieces, clean_piece), lambda x, i: F.struct((i + 1).alias("pos"), x.alias("item"))), lambda x: x["item"] != ""
    )
    joined = r.join(m, F.col("r.source").eqNullSafe(F.col("m.source")) & (F.col("r.field") == F.col("m.field")), "left")
    return joined.select(F.col("r.key").alias(key), F.col("r.field").alias("field"), F.inline(items))
