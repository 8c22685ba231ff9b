"""Alignment of descriptions, brands and codes between the client's file and the panel."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfspan.functions import fuzzy, text
from shelfspan.sources.shared import stored

#: Market words without a place in them, directions, and full names of state codes.
GENERIC = [
    "ta", "tac", "trade", "area", "areas", "operating", "operation", "region", "regions", "zone", "zones", "district", "districts", "account",
    "accounts", "market", "markets", "geography", "geo", "division", "divisions", "territory", "territories", "channel", "channels", "planning",
    "sales", "remaining", "rem", "subregion", "the", "of", "and",
]
DIRECTIONS = [
    "north", "south", "east", "west", "central", "mid", "midwest", "midatlantic", "northern", "southern", "eastern", "western", "northeast",
    "northwest", "southeast", "southwest", "upper", "lower",
]
TOTALS = [
    "total", "all", "national", "overall", "combined", "corporate", "enterprise", "company", "companywide", "customer", "account",
]
HIGH, ENOUGH = 88, 78


#: Pairs of neighbouring characters that strings must share, of the length of the shorter one (n) and of the sum of
#: both lengths (s). If 2 * LCS >= q * s, then at least 3 * LCS - s - 1 pairs of neighbours in the LCS are neighbours
#: in both strings: each character that is left out parts one pair. A stretch for which `partial` is 82 or more has
#: at least 0.41 / 0.59 of the shorter one's length, and what is contained has all of its n - 1 pairs.
ENOUGH_SHARED = {"partial": lambda n, s: 0.23 * n / 0.59 - 1}


def _shared_pieces(left: DataFrame, c: str, right: DataFrame, d: str, enough: Callable[[Column, Column], Column], written: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(c, d): distinct pairs that share as many pairs of neighbouring characters as `enough` asks, at least one, or a string of one character.

    A pair that occurs k times in a string counts k times. `written` is the form of a string that is looked at.
    """

    def pieces(df: DataFrame, x: str, here: str, there: str) -> DataFrame:
        # A string of one character meets the characters of the other side's strings; no other characters meet.
        own = df.select(x, written(F.col(x)).alias("v")).where("v != ''").withColumn("n", F.char_length("v"))
        pairs = own.where("n > 1").select(x, "n", F.explode(F.expr("transform(sequence(1, n - 1), k -> substring(v, k, 2))")).alias("piece"))
        alone = own.where("n = 1").select(x, "n", F.concat(F.lit(here), "v").alias("piece"))
        each = own.select(x, "n", F.explode(F.expr("array_distinct(transform(sequence(1, n), k -> substring(v, k, 1)))")).alias("piece"))
        met = pairs.unionByName(alone).unionByName(each.withColumn("piece", F.concat(F.lit(there), "piece")))
        return met.groupBy(x, "n", "piece").agg(F.count(F.lit(1)).alias("times"))

    a = pieces(left, c, "left:", "right:").withColumnsRenamed({"n": "n_a", "times": "times_a"})
    b = pieces(right, d, "right:", "left:").withColumnsRenamed({"n": "n_b", "times": "times_b"})
    met = a.join(b, "piece")
    counted = met.groupBy(c, d, "n_a", "n_b").agg(F.sum(F.least("times_a", "times_b")).alias("shared"))
    n, s = F.least("n_a", "n_b"), F.col("n_a") + F.col("n_b")
    return counted.where((n == 1) | (F.col("shared") >= enough(n, s) - 1e-9)).select(c, d)


def alike_pairs(left: DataFrame, a: str, right: DataFrame, b: str, cutoff: float) -> DataFrame:
    """(a, b, score): all pairs of distinct strings whose token-set likeness is `cutoff` or more (over 67), without comparing all.

    A pair gets there in one of two ways. Shared words make up most of one side: then that side's rarest words, up to
    the share that may be missing, have one that the other side has. Or the words of both, in order, are alike: then they
    share so many pairs of neighbouring characters (a word's first one with the blank before it) that the rarest of each side, all but as many, have one in common.
    With q = cutoff / 100 and n, m characters and at most k words: for 2 LCS >= q (n + m) at least 3 LCS - n - m - k + 1 neighbours stay neighbours, as each
    character that is left out parts one pair; and m is at least n q / (2 - q).
    """
    q = cutoff / 100
    side = lambda df, x, k: df.select(F.col(x).alias("x"), F.lit(k).alias("side")).where("x is not null").distinct()

    def keys(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for x, k in zip(frame["x"], frame["side"], strict=True):
                words = sorted(set(x.split()))
                n = sum(map(len, words)) + len(words) - 1
                seen: Counter[str] = Counter()
                for w in words:
                    rows.append((x, k, "w" + w, len(w) + 1, 2 * (1 - q) / (2 - q) * n + 1e-6))
                    for i in range(len(w)):
                        pair = f" {w}"[i : i + 2]
                        seen[pair] += 1
                        # Of n - k + 1 pairs as many must be shared as the least partner needs.
                        need = math.ceil((1.5 * q - 1) * (1 + q / (2 - q)) * n - len(words) + 1 - 1e-6)
                        rows.append((x, k, f"p{pair}{seen[pair]}", 1, n - len(words) + 1 - max(need, 1)))
            yield pd.DataFrame(rows, columns=["x", "side", "key", "weight", "spare"])

    found = stored(side(left, a, 0).unionByName(side(right, b, 1)).mapInPandas(keys, "x string, side int, key string, weight int, spare double"))
    often = found.groupBy("key").agg(F.count(F.lit(1)).alias("often"))
    rarest = Window.partitionBy("side", "x", F.substring("key", 1, 1)).orderBy("often", "key").rowsBetween(Window.unboundedPreceding, -1)
    # The rarest keys, until what is before them is more than may be missing.
    first = stored(found.join(often, "key").withColumn("before", F.coalesce(F.sum("weight").over(rarest), F.lit(0))).where("before <= spare").select("x", "side", "key"))
    of = lambda df, k, name: df.where(F.col("side") == k).select("key", F.col("x").alias(name))
    words = lambda df: df.where("key like 'w%'")
    pairs = of(first, 0, a).join(of(words(found), 1, b), "key").unionByName(of(words(found), 0, a).join(of(first, 1, b), "key")).unionByName(of(first, 0, a).join(of(first.where("key like 'p%'"), 1, b), "key"))
    return pairs.select(a, b).distinct().withColumn("score", fuzzy.token_set(a, b)).where(F.col("score") >= cutoff)


def align_brands(client: DataFrame, panel: DataFrame) -> DataFrame:
    """(client_brand, panel_brand, basis): equal but for blanks, else the shortest panel brand that contains it or is contained, else alike in part and in words.

    Inputs have a column `brand`, normalised. Containment needs a client brand of three characters at least.
    Likeness looks at the panel brand that is most alike in part (82 at least) and then at its words (60 at least).
    """
    side = lambda df, c: df.select(F.col("brand").alias(c)).where(f"{c} is not null").distinct()
    c, d = side(client, "c"), side(panel, "d")
    tight = lambda x: text.without_blanks(F.col(x))
    exact = c.join(d, tight("c") == tight("d")).groupBy("c").agg(F.min("d").alias("d")).withColumn("basis", F.lit("equal"))
    near = _shared_pieces(c.join(exact, "c", "left_anti"), "c", d, "d", ENOUGH_SHARED["partial"])
    within = near.where((F.char_length("c") >= 3) & (F.col("d").contains(F.col("c")) | F.col("c").contains(F.col("d")))).groupBy("c").agg(F.min_by("d", F.struct(F.char_length("d"), "d")).alias("d")).withColumn("basis", F.lit("contained"))
    rest = near.join(within, "c", "left_anti").select("c", "d", fuzzy.partial("c", "d").alias("p"), fuzzy.token_set("c", "d").alias("t")).where("p >= 82")
    best = rest.groupBy("c").agg(F.max(F.struct("p", "t", "d")).alias("b")).where("b.t >= 60")
    alike = best.select("c", "b.d", F.lit("alike").alias("basis"))
    return exact.unionByName(within).unionByName(alike).select(F.col("c").alias("client_brand"), F.col("d").alias("panel_brand"), "basis")


def merge_crosswalk(auto: DataFrame, user: DataFrame) -> DataFrame:
    """(client_key, panel_key, basis): the user's entries (last by `position`), and automatic ones for other keys. Blank entries don't count."""
    said = user.where("client_key is not null and panel_key is not null").groupBy("client_key").agg(F.max_by("panel_key", "position").alias("user_key"))
    both = auto.select("client_key", F.col("panel_key").alias("auto_key")).join(said, "client_key", "full")
    return both.select("client_key", F.coalesce("user_key", "auto_key").alias("panel_key"), F.when(F.col("user_key").isNotNull(), "user").otherwise("auto").alias("basis"))


def build_crosswalk(client: DataFrame, panel: DataFrame, cutoff: float = 0.65) -> DataFrame:
    """(client_key, panel_key, score, basis): client codes without a panel twin, matched on brand and description.

    Inputs have upc_key, description, brand (normalised) and position, of each code the first row counts. Panel
    products of the same brand are candidates, or if there is none those of a brand that contains it;
    of these the ones of equal pack and size if there are any. Most alike descriptions win; equal pack and size
    adds 8.
    """
    first = lambda df, p: df.where("upc_key is not null").groupBy(F.col("upc_key").alias(f"{p}_key")).agg(F.min_by(F.struct("description", "brand"), "position").alias("f"), F.min("position").alias(f"{p}_at")).select(f"{p}_key", f"{p}_at", F.col("f.description").alias(f"{p}_desc"), F.col("f.brand").alias(f"{p}_brand"), text.size_key(F.col("f.description")).alias(f"{p}_size"))
    c, d = first(client, "c"), first(panel, "d")
    c = stored(c.join(d, F.col("c_key") == F.col("d_key"), "left_anti").where("c_brand is not null and c_desc is not null"))
    # Codes share descriptions, so forms are compared: of each brand and description, of the panel's with the code that wins a tie.
    mine = c.select("c_brand", "c_desc", "c_size").distinct()
    theirs = stored(d.where("d_brand is not null").groupBy("d_brand", "d_desc", "d_size").agg(F.min("d_at").alias("d_at"), F.max_by("d_key", F.struct(-F.col("d_at"), "d_key")).alias("d_key")))
    brands = lambda df, x: df.select(x).distinct()
    alone = brands(mine, "c_brand").join(brands(theirs, "d_brand"), F.col("c_brand") == F.col("d_brand"), "left_anti")
    wider = _shared_pieces(alone, "c_brand", brands(theirs, "d_brand"), "d_brand", lambda n, _: n - 1).where(F.col("d_brand").contains(F.col("c_brand")))
    within = brands(mine, "c_brand").join(brands(theirs, "d_brand"), F.col("c_brand") == F.col("d_brand"))
    mine = stored(mine.join(within.unionByName(wider), "c_brand"))
    # Forms of equal pack and size first; only those that have none meet all of the brand.
    fitting = stored(mine.join(theirs, (mine["d_brand"] == theirs["d_brand"]) & (mine["c_size"] == theirs["d_size"])).select("c_brand", "c_desc", "c_size", "d_desc", "d_at", "d_key", F.lit(True).alias("fits")))
    others = mine.join(fitting.select("c_brand", "c_desc").distinct(), ["c_brand", "c_desc"], "left_anti").join(theirs, "d_brand").select("c_brand", "c_desc", "c_size", "d_desc", "d_at", "d_key", F.lit(False).alias("fits"))
    pool = fitting.unionByName(others).where("d_desc is not null")
    scored = pool.withColumn("s", F.least(F.lit(100.0), fuzzy.token_set("c_desc", "d_desc") + F.when(F.col("fits"), 8.0).otherwise(0.0)))
    best = scored.where("s > 0").groupBy("c_brand", "c_desc").agg(F.max(F.struct("s", (-F.col("d_at")).alias("at"), F.col("c_size").isNotNull().alias("sized"), "d_key")).alias("b")).select("c_brand", "c_desc", "b.*").where(F.col("s") >= 100 * cutoff)
    return c.join(best, ["c_brand", "c_desc"]).select(F.col("c_key").alias("client_key"), F.col("d_key").alias("panel_key"), F.round(F.col("s") / 100, 3).alias("score"), F.when(F.col("sized") & (F.col("s") >= 92), "brand+size+pack").otherwise("brand+desc").alias("basis"))
