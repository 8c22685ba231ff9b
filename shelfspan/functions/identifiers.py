"""Product codes as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from shelfspan.functions.let import let


CODE = r"\A[0-9]{8,14}\z"


def normalize_upc(x: Column) -> Column:
    """The 8 to 14 digits of a product code, as written; null for what isn't one."""
    return let(x.cast("string"), lambda s: F.when(s.rlike(CODE), s).otherwise(_bare_code(s)))


def _bare_code(x: Column) -> Column:
    s = F.regexp_replace(F.trim(x), r"^(\d+)\.0+$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"[\s\-.]", ""), "[Xx*?]$", "")
    return let(s, lambda v: F.when(v.rlike(CODE), v))


def upc_key(x: Column, check_digit: bool = False) -> Column:
    """The key on which codes match: 14 digits reduced to 12, leading zeros gone, and without the check digit unless it is asked for."""
    short = let(normalize_upc(x), lambda s: F.when(F.char_length(s) == 14, F.right(F.ltrim(s, F.lit("0")), F.lit(12))).otherwise(s))
    bare = let(short, lambda s: F.when(F.ltrim(s, F.lit("0")) == "", s).otherwise(F.ltrim(s, F.lit("0"))))
    return bare if check_digit else let(bare, lambda b: F.when(F.char_length(b) >= 8, F.substr(b, F.lit(1), F.char_length(b) - 1)).otherwise(b))


def is_pseudo_code(x: Column) -> Column:
    """Whether a code has a letter, as internal codes do."""
    return F.coalesce(x.cast("string").rlike("[A-Za-z]"), F.lit(False))
