"""Document fingerprints: invertible Bloom lookup sketches of paragraphs (DataFrame functions only).

A sketch has three subtables of cells. Each paragraph's digest is added to one cell of each subtable: the
cell's count goes up by one and its key is XORed with the digest. Sketches of two versions subtract cell by
cell, which cancels what they share. A cell that is left with a count of 1 or -1 holds one digest; taking it
out of its two other cells frees more (peeling), until nothing is left and the differing digests are known.
If something is left, the sketch was too small; its counts tell about how much differs, and so the size of the
larger one that is tried.

Peeling goes through the subtables in turn, so no digest is taken out twice in one step, and every step is
an aggregation by cell. Rows are laid out by `bucket` once; all steps stay within that layout and don't
shuffle again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpoint, small_side, table

#: A paragraph: a line, or stretches of 64 to 128 characters of a longer one, cut after a sentence if possible.
PARAGRAPH = r"[^\n]{1,64}[^\n.!?]{0,64}[.!?]*"
TABLES = 3
#: Cells of a fingerprint's subtable.
CELLS = 8
#: Each level has 4 times as many cells as the one before.
GROWTH_BITS = 2
#: Peeling steps; each takes digests out of one subtable.
STEPS = 12


def digests(text: Column) -> Column:
    """array<long>: 48 bits of hash and a 16-bit check for each distinct paragraph; a repeated paragraph counts once. Null is empty."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0)), lambda p: checked(F.xxhash64(p))))


def checked(hashed: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(hashed, 16), 16)
    return high.bitwiseOR(F.xxhash64(high).bitwiseAND(F.lit(0xFFFF)))


def is_digest(key: Column) -> Column:
    high = F.shiftleft(F.shiftrightunsigned(key, 16), 16)
    return F.xxhash64(high).bitwiseAND(F.lit(0xFFFF)) == key.bitwiseAND(F.lit(0xFFFF))


def cell(key: Column, t: int, spec: Column) -> Column:
    """The digest's cell in subtable t: subtables follow each other. `spec` names a sketch: 32 * level + log2 of a subtable's cells."""
    m = cells_of(spec)
    return (F.xxhash64(key, spec, F.lit(t)).bitwiseAND((m - 1).cast("long")) + t * m).cast("int")


def cells_of(spec: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1), spec.bitwiseAND(F.lit(31)))


def sketch(rows: DataFrame, by: list[str], added: str, removed: str | None) -> DataFrame:
    """(*by, spec, cell, n, key): the sketch of array column `added` minus that of `removed`; a row with cell -2 for each sketch."""
    long = lambda k: F.lit(k).cast("long")
    entry = lambda sign: lambda k: F.struct(long(sign).alias("n"), k.alias("key"))
    entries = [F.transform(added, entry(1)), F.array(F.struct(long(0).alias("n"), long(0).alias("key")))]
    if removed:
        entries.append(F.transform(removed, entry(-1)))
    e = rows.select(*by, "spec", F.explode(F.concat(*entries)).alias("e")).select(*by, "spec", "e.n", "e.key")
    places = F.when(F.col("n") == 0, F.array(F.lit(-2))).otherwise(F.array(*(cell(F.col("key"), t, F.col("spec")) for t in range(TABLES))))
    e = e.select("*", F.explode(places).alias("cell"))
    return e.groupBy(*by, "spec", "cell").agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"))


def peel(cells: DataFrame, by: list[str], digests: bool) -> DataFrame:
    """(*by, spec, cell, digest, n, key): what is left of subtracted sketches, and in rows of negative cells what was taken out.

    With `digests` each digest taken out has a row (cell -1, n: its sign). Without, digests taken out are
    counted: in n of cell -1 the added ones, in n of cell -3 the removed ones, with the sign that they have.
    """
    zero = F.lit(0).cast("long")

    def row(c: Column, n: Column, k: Column, d: Column = zero) -> Column:
        return F.struct(c.cast("int").alias("cell"), n.alias("n"), k.alias("key"), *[d.alias("digest")] * digests)

    rows = cells.withColumn("digest", zero) if digests else cells
    for step in range(STEPS):
        t = step % TABLES
        key, n, spec, here = (F.col(c) for c in ("key", "n", "spec", "cell"))
        pure = (F.abs(n) == 1) & (here >= 0) & is_digest(key) & (cell(key, t, spec) == here)
        taken = row(F.lit(-1), n, zero, key) if digests else row(F.when(n > 0, -1).otherwise(-3), n, zero)
        out = (
            F.when(here < 0, F.array(row(here, n, key, F.col("digest")) if digests else row(here, n, key)))
            .when(pure, F.array(taken, *(row(cell(key, u, spec), -n, key) for u in range(TABLES) if u != t)))
            .when((n != 0) | (key != 0), F.array(row(here, n, key)))
            .otherwise(F.slice(F.array(row(here, n, key)), 1, 0))
        )
        rows = rows.select(*by, "spec", F.explode(out).alias("o")).select(*by, "spec", "o.*")
        rows = rows.groupBy(*by, "spec", "cell", *["digest"] * digests).agg(F.sum("n").alias("n"), F.bit_xor("key").alias("key"))
    return rows


def spec_of(level: int | Column) -> int | Column:
    """Level 0 has a fingerprint's size; each next one has GROWTH_BITS more bits of cells."""
    return level * (32 + GROWTH_BITS) + CELLS.bit_length() - 1


def level_for(differing: Column, levels: int) -> Column:
    """The first level with two cells for each differing digest, `levels` if none has."""
    bits = F.log2(2 * differing / (TABLES * CELLS))
    return F.least(F.greatest(F.lit(0), F.ceil(bits / GROWTH_BITS)), F.lit(levels)).cast("int")


def differing(taken: Column, squares: Column, tilt: Column, spec: Column) -> Column:
    """About how many digests differ, from a sketch that didn't peel: those taken out, and of what is left the squared counts.

    In a subtable of m cells, d digests of which e more are added than removed have squared counts of
    d + (e * e - d) / m in the mean. `squares` and `tilt` are the sums of squared counts and of counts over all subtables.
    """
    m, e = cells_of(spec), tilt / TABLES
    return taken + F.greatest(F.abs(e), (squares / TABLES - e * e / m) * m / (m - 1))


def differences(pairs: DataFrame, by: list[str], digests: bool = True, levels: int = 10) -> DataFrame:
    """What peeling recovers from pairs of digest arrays `a` and `b`, named by the columns `by`.

    (*by, level, added, removed): `added` are the digests in b but not in a, `removed` those in a but
    not in b, sorted arrays, or with digests=False how many there are. `level` is the sketch size that
    sufficed: 0 is a fingerprint's, each next one is larger and hashes anew. A pair begins at the level that its sizes'
    difference asks for; what is left of a sketch that doesn't peel tells about how much differs, and the pair is tried
    again at the level for that, a larger one in any case. So what is exchanged follows how much differs, not how long
    the texts are, and unrelated texts need two or three rounds, not one for each level. There is a checkpoint after each round. Of a
    pair that no level suffices for (a million digests
    differ) the arrays themselves are compared, at level -1. Pairs of the same name are one, given once. Null arrays are empty. If
    rows are laid out by some of the columns `by`, they aren't shuffled again.
    """
    empty = F.array().cast("array<long>")
    pairs = pairs.select(*by, F.coalesce("a", empty).alias("a"), F.coalesce("b", empty).alias("b"))
    pending = pairs.withColumn("level", level_for(F.abs(F.size("a") - F.size("b")), levels))
    found, beyond = None, None
    for _ in range(levels):
        # A pair beyond all levels has an empty sketch of no size: it is named with those that fail, without another pass over all pairs.
        fits = F.col("level") < levels
        rows = pending.select(*by, *(F.when(fits, F.col(c)).otherwise(empty).alias(c) for c in ("a", "b")), F.when(fits, spec_of(F.col("level"))).otherwise(-1).alias("spec"))
        peeled = peel(sketch(rows, by, "b", "a"), by, digests)
        here = F.col("cell") >= 0
        left = F.count_if(here & ((F.col("n") != 0) | (F.col("key") != 0)))
        if digests:
            took = [F.sort_array(F.collect_list(F.when((F.col("cell") == -1) & (F.col("n") == sign), F.col("digest")))) for sign in (1, -1)]
        else:
            took = [F.sum(F.when(F.col("cell") == c, F.abs("n")).otherwise(0)) for c in (-1, -3)]
        odd = F.count_if((F.col("cell") == -1) & (F.abs("n") > 1)) if digests else F.lit(0)
        sums = [F.sum(F.when(w, v).otherwise(0)) for w, v in ((F.col("cell").isin(-1, -3), F.abs("n")), (here, F.col("n") * F.col("n")), (here, F.col("n")))]
        result = peeled.groupBy(*by, "spec").agg((left + odd).alias("left"), took[0].alias("added"), took[1].alias("removed"), *(x.alias(c) for x, c in zip(sums, ("taken", "squares", "tilt"), strict=True)))
        level = (F.col("spec") / 32).cast("int")
        good = F.when((F.col("left") == 0) & (F.col("spec") >= 0), F.struct(level.alias("level"), "added", "removed"))
        larger = F.when(F.col("spec") < 0, levels).otherwise(F.greatest(level + 1, level_for(differing(*map(F.col, ("taken", "squares", "tilt", "spec"))), levels)))
        done = checkpoint(result.select(*by, good.alias("r"), larger.alias("larger")))
        solved, failing = done.where("r is not null").select(*by, "r.*"), done.where("r is null")
        again, never = failing.where(F.col("larger") < levels).select(*by, F.col("larger").alias("level")), failing.where(F.col("larger") >= levels).select(*by)
        found, beyond = (solved, never) if found is None else (found.unionByName(solved), beyond.unionByName(never))
        if again.isEmpty():
            break
        pending = pairs.join(small_side(again), by)
    if beyond.isEmpty():
        return found
    rest = pairs.join(small_side(beyond), by, "left_semi")
    only = lambda x, y: F.sort_array(F.array_except(x, y)) if digests else F.size(F.array_except(x, y)).cast("long")
    return found.unionByName(rest.select(*by, F.lit(-1).alias("level"), only("b", "a").alias("added"), only("a", "b").alias("removed")))


def likeness(a: Column, b: Column, differing: Column) -> Column:
    """Jaccard index of two sets of sizes a and b that differ in so many members; 1 if both are empty."""
    return F.when(a + b == 0, 1.0).otherwise((a + b - differing) / (a + b + differing))


def as_text(sketches: DataFrame, by: list[str], size: Column) -> DataFrame:
    """(*by, fingerprint): the sketch as text: number of paragraphs, then cell.count.key of each cell in use.

    `size` is the number of paragraphs as an aggregate of a sketch's rows.
    """
    c = F.sort_array(F.collect_list(F.when(F.col("cell") >= 0, F.struct("cell", "n", "key"))))
    one = lambda x: F.concat_ws(".", x["cell"].cast("string"), x["n"].cast("string"), F.hex(x["key"]))
    text = F.concat(F.col("size").cast("string"), F.lit(":"), F.array_join(F.transform("c", one), ","))
    return sketches.groupBy(*by).agg(c.alias("c"), size.alias("size")).select(*by, text.alias("fingerprint"))


def bounds(df: DataFrame, column: str, parts: int) -> list[list[int]]:
    """Values that cut a long column into about `parts` (90,000 at most) equal parts, in lists of equal length that follow each other."""
    parts = min(parts, 90_000)
    got = df.select(F.percentile_approx(column, [(k + 1) / parts for k in range(parts - 1)], 10 * parts)).first()[0] if parts > 1 else []
    cuts = sorted(set(got or []))
    width = max(1, round(len(cuts) ** 0.5))
    return [cuts[k : k + width] for k in range(0, len(cuts), width)]


def part_of(value: Column, cuts: list[list[int]]) -> Column:
    """Number of cuts that are at most the value; looks through the first of each list, then through one list."""
    if not cuts:
        return F.lit(0)
    firsts = F.array(*(F.lit(c[0]).cast("long") for c in cuts))
    lists = F.array(*(F.array(*(F.lit(x).cast("long") for x in c)) for c in cuts))
    k = F.size(F.filter(firsts, lambda x: x <= value))
    return F.when(k == 0, 0).otherwise((k - 1) * len(cuts[0]) + F.size(F.filter(F.try_element_at(lists, k), lambda x: x <= value)))


def with_next(docs: DataFrame, doc_id: str, text: str, parts: int) -> DataFrame:
    """(bucket, at, doc_id, text, next_text): each document with the text of the next one by ascending id, the last with that of the first.

    Ids that tie are ordered by text; null ids come first. Documents are laid out in buckets of neighbouring
    ids, and each bucket gets a copy of the next one's first document, so the texts are shuffled once.
    """
    order = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)))
    rows = docs.select(order.alias("order"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    cuts = bounds(rows, "order", parts)
    rows = rows.withColumns({"bucket": part_of(F.col("order"), cuts).cast("int"), "ghost": F.lit(False)})
    heads = rows.groupBy("bucket").agg(F.min("order").alias("order"))  # a row for each bucket: at most 90,000
    turn = Window.orderBy("bucket")
    before = heads.select("bucket", "order", F.lag("bucket").over(turn).alias("before"), F.max("bucket").over(Window.partitionBy()).alias("last"))
    before = before.select(F.col("bucket").alias("of"), F.col("order").alias("first"), F.coalesce("before", "last").cast("int").alias("to"))
    ghosts = rows.join(F.broadcast(before), (F.col("bucket") == F.col("of")) & (F.col("order") == F.col("first")))
    ghosts = ghosts.groupBy("to", "order").agg(F.min("text").alias("text")).select("order", F.lit(None).cast("long").alias("doc_id"), "text", F.col("to").alias("bucket"), F.lit(True).alias("ghost"))
    w = Window.partitionBy("bucket").orderBy("ghost", "order", "text")
    both = rows.withColumn("doc_id", F.col("doc_id").cast("long")).unionByName(ghosts)
    return both.select("bucket", F.row_number().over(w).alias("at"), "doc_id", "text", F.lead("text").over(w).alias("next_text"), "ghost").where(~F.col("ghost")).drop("ghost")


def compare_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next).

    The edited text ends in as many code points of the next document's start as a quarter of the text has.
    `near_*` are Jaccard indexes of distinct paragraphs, from what peeling recovers. A row for each input row,
    repeated ones too; null text is empty, and two texts without a paragraph are alike (1.0). A table of one
    row is its own next document.
    """
    spark = docs.sparkSession
    parts = parts or 16 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - quarter), F.substr("next_text", F.lit(1), quarter))
    rows = with_next(docs, doc_id, text, parts).select("bucket", "at", "doc_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"), "next_text")
    rows = rows.select("bucket", "at", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), digests(F.col("text")).alias("a"), digests(F.col("edited")).alias("b"), digests(F.col("next_text")).alias("c"))
    place = ["bucket", "at"]
    rows = checkpoint(rows).repartition(*place)  # all that follows is by these columns and stays where it is
    sides = lambda *sets: F.explode(F.array(*(F.struct(F.lit(k).alias("side"), F.col(c).alias("b")) for k, c in enumerate(sets))))
    wide = lambda df, values: df.groupBy(*place).agg(*(F.max(F.when(F.col("side") == k, v)).alias(c) for k, (c, v) in enumerate(values.items())))
    by = [*place, "side"]
    apart = differences(rows.select(*place, "a", sides("b", "c").alias("k")).select(*place, "k.side", "a", "k.b"), by, digests=False)
    apart = wide(apart, dict.fromkeys(("d_edited", "d_next"), F.col("added") + F.col("removed")))
    single = rows.select(*place, sides("a", "b").alias("k")).select(*place, "k.side", "k.b", F.lit(spec_of(0)).alias("spec"))
    # Each paragraph is in one cell of each subtable, so the first subtable's counts add up to the number of paragraphs.
    size = F.coalesce(F.sum(F.when(F.col("cell").between(0, CELLS - 1), F.col("n"))), F.lit(0))
    prints = wide(as_text(sketch(single, by, "b", None), by, size), dict.fromkeys(("fingerprint", "edited_fingerprint"), F.col("fingerprint")))
    size = lambda c: F.size(c).cast("double")
    return (
        rows.join(apart, place)
        .join(prints, place)
        .select(
            "doc_id",
            "n_chars",
            "edited_sha256",
            "fingerprint",
            "edited_fingerprint",
            likeness(size("a"), size("b"), F.col("d_edited")).alias("near_edited"),
            likeness(size("a"), size("c"), F.col("d_next")).alias("near_next"),
        )
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edits(table(spark, sf_dir, "documents"))
