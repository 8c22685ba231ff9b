"""Benchmark decontamination by spaced seeds (DataFrame functions only).

A seed is a fixed mask over consecutive words; it hashes the words at its ones and ignores those at its
zeros, so a replaced word at an ignored place doesn't hide a shared passage. Seeds of the benchmark are
joined to the seeds at every word of every document, and around each hit the two texts are compared word by
word on the hit's diagonal: words that agree count 1, words that differ -1, and the best stretch must reach
a score.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.common import checkpoint, table

#: Two masks of nine words and weight six.
MASKS = ("110101101", "111001011")
SPAN = 9
#: A stretch's score must reach this, or this share of a shorter item's words.
MIN_SCORE = 13
MIN_SHARE = 0.7
#: An item too short for these masks, but of at least so many words, is found anywhere in a text; a shorter one only as an entire text.
MIN_INSIDE = 5
#: From so many words on, one inner word of such an item may be replaced: of its two masks, 1010.. and 0101.., one doesn't see that word.
MIN_TOLERANT = 6


def words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def seed(h: Column, at: Column, mask: int) -> Column:
    """Hash of the words that a mask selects from place `at` (from 0) on."""
    return F.xxhash64(F.lit(mask), *(F.get(h, at + k) for k, c in enumerate(MASKS[mask]) if c == "1"))


def windows(df: DataFrame, h: str, at: str) -> DataFrame:
    """A row for each place of array column `h` where seeds fit, with the place as `at`."""
    return df.where(F.size(h) >= SPAN).select("*", F.explode(F.sequence(F.lit(0), F.size(h) - SPAN)).alias(at))


def seeds(df: DataFrame, h: str, at: str) -> DataFrame:
    return windows(df, h, at).select("*", F.explode(F.array(*(F.struct(F.lit(m).alias("mask"), seed(F.col(h), F.col(at), m).alias("key")) for m in range(len(MASKS))))).alias("s")).select("*", "s.mask", "s.key").drop("s")


def _starts_run(i: str, j: str, mask: str) -> Column:
    """Whether the same seed doesn't hit one word earlier as well: of a run of hits on a diagonal only the first is kept."""
    earlier = F.lit(None)
    for m in range(len(MASKS)):
        earlier = F.when(F.col(mask) == m, seed(F.col("h"), F.col(i) - 1, m) == seed(F.col("g"), F.col(j) - 1, m)).otherwise(earlier)
    return ~F.coalesce((F.col(i) > 0) & (F.col(j) > 0) & earlier, F.lit(False))


def best_stretch(h: Column, g: Column, i: Column, j: Column) -> Column:
    """The best-scoring stretch on the diagonal of a hit: struct(score, start, words); start counts the document's words from 0."""
    shift = i - j
    first, last = F.greatest(F.lit(0), -shift), F.least(F.size(g), F.size(h) - shift) - 1

    def step(s: Column, k: Column) -> Column:
        now = F.when(F.get(g, k) == F.get(h, k + shift), 1).otherwise(-1)
        fresh = s["now"] <= 0
        score, start = F.when(fresh, now).otherwise(s["now"] + now), F.when(fresh, k).otherwise(s["from"])
        better = score > s["score"]
        return F.struct(
            score.alias("now"),
            start.alias("from"),
            F.when(better, score).otherwise(s["score"]).alias("score"),
            F.when(better, start).otherwise(s["start"]).alias("start"),
            F.when(better, k).otherwise(s["stop"]).alias("stop"),
        )

    zero = F.struct(*(F.lit(0).alias(c) for c in ("now", "from", "score", "start", "stop")))
    best = F.aggregate(F.sequence(first, last), zero, step)
    return F.transform(F.array(best), lambda b: F.struct(b["score"].alias("score"), (b["start"] + shift).alias("start"), (b["stop"] - b["start"] + 1).alias("words")))[0]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    return benchmark.select(F.col(item_id).alias("item_id"), hashes(F.col(text)).alias("g"))


def _verified(hits: DataFrame) -> DataFrame:
    """Hits with arrays h and g and places i and j, where a stretch around the hit is good enough."""
    # The comparison is generated, not projected: a filter on it would move into the join, for every seed and not just for hits.
    best = F.explode(F.array(best_stretch(F.col("h"), F.col("g"), F.col("i"), F.col("j"))))
    return hits.select("*", best.alias("best")).where(F.col("best.score") >= F.least(F.lit(MIN_SCORE), F.ceil(F.size("g") * MIN_SHARE)))


def _short_keys(h: str, at: Column, n: int) -> list[Column]:
    """Hashes of the n words from place `at` (from 0) on under the masks for items of n words."""
    masks = [range(p, n, 2) for p in (0, 1)] if n >= MIN_TOLERANT else [range(n)]
    return [F.xxhash64(F.lit(n), F.lit(m), *(F.get(h, at + k) for k in places)) for m, places in enumerate(masks)]


def _short_hits(doc: DataFrame, items: DataFrame, sizes: list[int], broadcast: bool) -> DataFrame:
    """(doc, item_id, score, start, words): items of fewer words than SPAN at the places of documents where enough words agree.

    A place carries its own n words, not the document's, so what is compared stays small on either kind of join.
    """

    def places(n: int) -> Column:
        last = F.size("h") - n
        at = F.when(last >= 0 if n >= MIN_INSIDE else last == 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(at, lambda i: F.array(*(F.struct(k.alias("key"), i.alias("start"), F.slice("h", i + 1, n).alias("said")) for k in _short_keys("h", i, n)))))

    side = None
    for n in sizes:
        part = items.where(F.size("g") == n).select("item_id", "g", F.explode(F.array(*_short_keys("g", F.lit(0), n))).alias("key"))
        side = part if side is None else side.unionByName(part)
    at = doc.select("doc", F.explode(F.concat(*map(places, sizes))).alias("at")).select("doc", "at.*")
    n = F.size("g")
    agree = F.size(F.filter(F.arrays_zip("said", "g"), lambda x: x["said"] == x["g"]))
    least = n - F.when(n >= MIN_TOLERANT, 1).otherwise(0)
    ends = (F.get("said", F.lit(0)) == F.get("g", F.lit(0))) & (F.element_at("said", -1) == F.element_at("g", -1))
    return at.join(F.broadcast(side) if broadcast else side, "key").where((F.size("said") == n) & (agree >= least) & ends).select("doc", "item_id", (2 * agree - n).alias("score"), "start", n.alias("words"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str, text: str = "text", item_id: str = "item_id", item_text: str = "text", broadcast_bytes: int = 64 << 20) -> DataFrame:
    """(key, item_id, score, start, words): benchmark items of which a document holds a passage, with its best stretch.

    `key` names the document; rows that share a key are one document. A row for each key and item. Null texts
    are empty; extra columns are ignored. A null key or item_id is a value of its own.

    Items of fewer than SPAN words have masks of their own. From MIN_TOLERANT words on all words but one inner one
    must agree, from MIN_INSIDE on all, anywhere in a text; shorter items must be an entire text. Items without a word give none.

    While the benchmark's seeds, each with its item's word hashes, take at most `broadcast_bytes` (summed
    first), they are broadcast and documents aren't shuffled at all. Beyond that, seeds of both sides meet in
    a shuffle as bare hashes, and word arrays are joined to the hits afterwards.
    """
    doc = docs.select(F.col(f"`{key}`").alias("key"), hashes(F.col(text)).alias("h"))
    items = _items(benchmark, item_id, item_text)
    item_seeds = seeds(items, "g", "j")
    # A seed's row: 8 bytes a word, and about 64 for the rest.
    n = F.size("g")
    fit = F.sum(F.when(n >= SPAN, (n - SPAN + 1).cast("long") * len(MASKS) * (8 * n + 64)))
    too_short = n.between(1, SPAN - 1)
    weight, shorter, sizes = items.agg(F.coalesce(fit, F.lit(0)), F.count_if(too_short), F.sort_array(F.collect_set(F.when(too_short, n)))).first()
    if weight <= broadcast_bytes:
        side = F.broadcast(item_seeds.select(F.col("key").alias("item_key"), F.col("mask").alias("item_mask"), "item_id", "g", "j"))
        at = seeds(doc.select(F.col("key").alias("doc"), "h"), "h", "i")
        hits = at.join(side, (at["key"] == side["item_key"]) & _starts_run("i", "j", "item_mask"))
        found = _verified(hits)
    else:
        doc = docs.select(F.col(f"`{key}`").alias("doc"), F.md5(F.coalesce(F.col(text), F.lit(""))).alias("text_md5"), hashes(F.col(text)).alias("h"))
        words_of = items.select("item_id", F.md5(F.array_join(F.col("g").cast("array<string>"), " ")).alias("item_md5"), "g")
        at = seeds(doc.select("text_md5", "h"), "h", "i").select("text_md5", "i", "key")
        diagonal = F.col("i") - F.col("j")
        pairs = at.join(seeds(words_of, "g", "j").select("item_md5", "j", "key"), "key").groupBy("text_md5", "item_md5", diagonal.alias("shift")).agg(F.min("i").alias("i"))
        pairs = checkpoint(pairs.select("text_md5", "item_md5", "i", (F.col("i") - F.col("shift")).alias("j")))
        found = _verified(doc.join(pairs, "text_md5").join(words_of, "item_md5"))
    found = found.select("doc", "item_id", "best.score", "best.start", "best.words")
    if shorter:
        of = docs.select(F.col(f"`{key}`").alias("doc"), hashes(F.col(text)).alias("h"))
        found = found.unionByName(_short_hits(of, items.where(too_short), sizes, broadcast=shorter * 320 <= broadcast_bytes))
    best = F.max(F.struct(F.col("score"), (-F.col("start")).alias("before"), F.col("words")))
    return found.groupBy("doc", "item_id").agg(best.alias("best")).select(F.col("doc").alias(key), "item_id", F.col("best.score").cast("long").alias("score"), (-F.col("best.before")).cast("long").alias("start"), F.col("best.words").cast("long").alias("words"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id")


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs that hold no passage of a benchmark item; columns, repeats and null ids stay as they are."""
    digest = F.md5(F.coalesce(F.col(text), F.lit("")))
    leaky = leaks(docs.select(digest.alias("text_md5"), F.col(text)), benchmark, "text_md5", text).select("text_md5").distinct()
    return docs.join(leaky, digest == leaky["text_md5"], "left_anti")
