"""String expressions whose results differ between engines, pinned to one meaning.

All of them are plain column expressions: nulls propagate unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: stands for a null field in a surrogate key (fixed value of the public key macro)
NULL_KEY = "_dbt_utils_surrogate_key_null_"


def initcap_words(c: Column) -> Column:
    """Capital after every character that is no letter or digit (``co-operative`` -> ``Co-Operative``), the rest lower."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"([\p{L}\p{Nd}]+|[^\p{L}\p{Nd}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def concat_nulls_empty(*cols: Column) -> Column:
    """Concatenation in which a null counts as an empty string."""
    return F.concat_ws("", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def digits_to_double(c: Column) -> Column:
    """Everything but digits and points stripped, read as a number; null where that leaves none."""
    return F.regexp_replace(c, r"[^\d.]", "").try_cast("double")


def digits_to_int(c: Column) -> Column:
    """Everything but digits stripped, read as an integer; null where that leaves none or too many."""
    return F.regexp_replace(c, r"[^\d]", "").try_cast("int")


def first_contained(c: Column, names: list[str], default: Column | None = None) -> Column:
    """The first of ``names`` (in list order) that the text contains, case aside."""
    up = F.upper(c)
    hits = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.contains(up, F.upper(n)))
    hit = F.get(hits, F.lit(0))
    return hit if default is None else F.coalesce(hit, default)


def split_nth(c: Column, delimiter: str, n: int) -> Column:
    """The n-th part of a text; negative n counts from the end; beyond the parts, an empty string."""
    return F.split_part(c, F.lit(delimiter), F.lit(n))


def quoted(text: str) -> str:
    """A string literal with its quotes doubled."""
    return "'" + text.replace("'", "''") + "'"


def bool_text(c: Column) -> Column:
    """``true``/``false``."""
    return c.cast("string")


def text_hash(c: Column) -> Column:
    """MD5 of a value's text form."""
    return F.md5(c.cast("string"))


def surrogate_key(*cols: Column) -> Column:
    """MD5 over the fields joined by hyphens, null as a fixed word; never null itself."""
    return F.md5(F.concat_ws("-", *[F.coalesce(c.cast("string"), F.lit(NULL_KEY)) for c in cols]))


def row_hash(*cols: Column) -> Column:
    """MD5 over the fields joined by bars, null as empty: the id of a snapshot row."""
    return F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("")) for c in cols]))
