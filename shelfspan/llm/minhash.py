"""Near-duplicate documents by BagMinHash over five-word shingles with their multiplicities.

A document is a bag of shingles. Each unit of a shingle's multiplicity is a Poisson process that throws points
into the registers of a signature, and each register keeps its earliest point. Multiplicities are cut into
dyadic slabs ([0,1), [1,2), [2,4), [4,8), ...); a slab that a bag covers in part keeps the points that fall
into the covered part, so bags that share units share those units' points, and two registers agree with the
probability of the bags' weighted Jaccard index. Points come in time order and a process stops when it is
later than every register, so a signature takes about one or two points for each shingle.

Bands of registers give candidate groups. A group isn't expanded into pairs: its members are compared with
one leader (the one that shares most bands with others), and verified links join components. Members of a
group that still are in different components are looked at once more, together: a pair at the threshold has
so many shingles in common that both have one of them among their rarest, in places that the two sizes bound
(a prefix join, which loses no pair). Shingles that no other such member has come first, so members that have
too many of their own drop out, and what meets is nearly always a link. No step repeats until it has nothing
left to do, but for the components.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.bpe import Remembered
from shelfspan.llm.common import Scratch, free_name, is_small, map_rows, small_batches, small_side, table

WORDS = 5
THRESHOLD = 0.8
#: A pair at the threshold shares no band with probability (1 - 0.8 ** ROWS) ** BANDS, about 7e-6.
BANDS, ROWS = 30, 5

MIX = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = (x ^ (x >> np.uint64(30))) * MIX[1]
    x = (x ^ (x >> np.uint64(27))) * MIX[2]
    return x ^ (x >> np.uint64(31))


@functools.cache
def _word_characters() -> np.ndarray:
    """Whether each character of the basic plane is a letter or digit."""
    return np.fromiter((chr(c).isalnum() for c in range(1 << 16)), bool, 1 << 16)


def word_hashes(text: str) -> np.ndarray:
    """uint64 of each word, in order. Words are runs of letters and digits, lower case.

    A word's hash is a polynomial of its characters, taken from sums over the whole text, and mixed with its length.
    """
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = _word_characters()[np.minimum(c, 0xFFFF)]
    for k in np.flatnonzero(c > 0xFFFF):
        inside[k] = chr(c[k]).isalnum()
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]])))
    start, stop = edge[::2], edge[1::2]
    if not len(start):
        return np.zeros(0, np.uint64)
    size = (stop - start).astype(np.uint64)
    # Places in the word, so that equal words have equal sums wherever they are; powers are taken per place.
    power = _powers(int(size.max()))
    place = np.arange(len(c)) - np.repeat(start, np.diff(np.append(start, len(c)))) if start[0] == 0 else np.arange(len(c)) - np.concatenate([np.zeros(start[0], np.int64), np.repeat(start, np.diff(np.append(start, len(c))))])
    value = np.where(inside, (c.astype(np.uint64) + np.uint64(1)) * power[np.minimum(place, len(power) - 1)], np.uint64(0))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value)])
    return mixed((total[stop] - total[start]) ^ (size * MIX[1]))


def _powers(n: int) -> np.ndarray:
    """At least n powers of an odd constant modulo 2**64."""
    return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, 64), MIX[0]))])


def bag(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles (as hashes, ascending) and how often each occurs. Fewer words than a shingle has make one shingle; none make none."""
    h = word_hashes(text or "")
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    k = min(WORDS, len(h))
    s = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        s = (s ^ (s >> np.uint64(29))) * MIX[0] + h[i : i + len(s)]
    return np.unique(mixed(s), return_counts=True)


def elements(text: str | None) -> list[int]:
    """The bag as a set of int64: one for each occurrence of a shingle. Sets share as many as the bags have in common."""
    shingle, times = bag(text)
    which = np.arange(times.sum(), dtype=np.int64) - np.repeat(np.cumsum(times) - times, times)
    return mixed(np.repeat(shingle, times) + which.astype(np.uint64) * MIX[0]).view(np.int64).tolist()


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard index of two bags; 0 if both are empty."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][i], b[1][j]).sum())
    both = int(a[1].sum() + b[1].sum()) - shared
    return shared / both if both else 0.0


def signature(elements: np.ndarray, weights: np.ndarray, m: int = BANDS * ROWS) -> np.ndarray:
    """Times of the earliest points in m registers, for elements with whole positive weights."""
    top = int(weights.max()).bit_length()
    low = [0, *(1 << k for k in range(top))]
    seed, width, cover = [], [], []
    for slab, at in enumerate(low):
        has = weights > at
        if not has.any():
            break
        size = max(1, at)
        seed.append(mixed(elements[has] + MIX[0] * np.array([slab + 1], np.uint64)))
        width.append(np.full(len(seed[-1]), size, np.uint64))
        cover.append(np.minimum(weights[has] - at, size).astype(np.uint64))
    seed, width, cover = np.concatenate(seed), np.concatenate(width), np.concatenate(cover)
    rate = width.astype(np.float64)
    time, done = np.zeros(len(seed)), 0
    earliest, latest = np.full(m, np.inf), np.inf
    while len(seed):
        # As many points at a time as mostly fill all registers; then the few processes that still are early enough go on.
        points = min(512, -(-6 * m // len(seed))) if latest == np.inf else 2
        u = mixed(seed[:, None] + np.arange(done + 1, done + points + 1, dtype=np.uint64) * MIX[0])
        gap = -np.log1p(-(u >> np.uint64(11)).astype(np.float64) * 2.0**-53)
        # Whole multiples of 2**-36 and rates that are powers of two add up exactly, in whatever order.
        t = time[:, None] + np.cumsum(np.floor(gap * 2.0**36) * 2.0**-36 / rate[:, None], axis=1)
        v = mixed(u ^ MIX[1])
        kept = (((v >> np.uint64(32)) & (width[:, None] - np.uint64(1))) < cover[:, None]) & (t < latest)
        np.minimum.at(earliest, (((v[kept] & np.uint64(0xFFFFFFFF)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64), t[kept])
        done, time = done + points, t[:, -1]
        latest = earliest.max()
        going = time < latest
        seed, width, cover, rate, time = seed[going], width[going], cover[going], rate[going], time[going]
    return earliest


def band_keys(earliest: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """int64 for each band, different from band to band."""
    x = earliest.view(np.uint64).reshape(bands, rows)
    out = mixed(np.arange(1, bands + 1, dtype=np.uint64) * MIX[0])
    for k in range(rows):
        out = mixed(out * MIX[0] + x[:, k])
    return out.view(np.int64)


def digest(text: str) -> Column:
    """MD5 of the text as 16 bytes; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit(""))))


def _signed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, md5, size, bands): a row for each row of docs; bands are null without words, size counts shingles."""

    def make() -> Callable:
        def keys(t: str) -> tuple:
            b = bag(t)
            return (band_keys(signature(*b)).tolist(), int(b[1].sum())) if len(b[0]) else (None, 0)

        known = Remembered(keys, limit=1000)  # copies often are neighbours; only short texts are remembered

        def f(rows: dict[str, list]) -> dict[str, list]:
            got = [known[t] if t and len(t) <= known.LONGEST_KEY else keys(t or "") for t in rows["text"]]
            return {"bands": [x[0] for x in got], "size": [x[1] for x in got]}

        return f

    d = docs.select(F.col(doc_id).alias("doc_id"), digest(text).alias("md5"), F.col(text).alias("text"))
    return map_rows(d, ["text"], "bands array<long>, size long", make, keep=True).drop("text")


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each linked node's component, by alternating large and small stars.

    Edges (a, b) of longs in any direction. Nodes only meet as edges that are partially aggregated before
    they are shuffled; each round is written to the shared folder, and the one before it deleted.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        near = e.unionAll(e.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("least"))
        to = near.join(least, "a")
        if large:
            return to.where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        own = least.select("a", F.col("least").alias("b"))
        return to.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(own).distinct()

    state, before = None, None
    edges = edges.where("a != b").select("a", "b")
    while True:
        scratch = Scratch(edges.sparkSession)
        edges = scratch.save(star(star(edges, True), False))
        if before is not None:
            before.drop()
        now = tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())
        if now == state:
            # Each edge now leads to the least node of its component.
            of = edges.select(F.col("a").alias("node"), F.col("b").alias("label"))
            return of.unionAll(of.select(F.col("label").alias("node"), "label")).distinct()
        state, before = now, scratch


def _verified(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose bags (as sets of elements) overlap enough; a may be a leader of very many."""

    def of(s: str) -> DataFrame:
        found = bags.select(F.col("node").alias(s), F.col("elements").alias(f"of_{s}"))
        named = pairs.select(s).distinct()
        return found.join(F.broadcast(named), s, "left_semi") if is_small(named) else found

    both = small_side(pairs).join(of("b"), "b").join(of("a"), "a")
    shared = F.size(F.array_intersect("of_a", "of_b"))
    return both.where(shared * (1 + threshold) + 1e-6 >= (F.size("of_a") + F.size("of_b")) * threshold).select("a", "b")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, md5, class_id, class_size): a row for each row of docs.

    Rows of a class are linked by texts whose multisets of five-word shingles (words: runs of letters and
    digits, lower case) have a Jaccard index of at least the threshold, directly or through others of the
    class. Equal texts always are of one class, also those without words; null counts as empty. `class_id` is
    the least doc_id of the class (null if it has none), `class_size` its rows. Only one of each set of equal
    texts gets compared. Extra columns are ignored. The result reads tables in the shared folder.
    """
    rows, classes = _classes(docs, doc_id, text, threshold)
    alone = F.col("label").isNull()
    of = rows.join(small_side(classes), "md5", "left")
    return of.select("doc_id", F.lower(F.hex("md5")).alias("md5"), F.when(alone, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, F.lit(1).cast("long")).otherwise(F.col("class_size")).alias("class_size"))


def _classes(docs: DataFrame, doc_id: str, text: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(doc_id, md5) of each row of docs, and (md5, label, class_id, class_size) of each text that some other row has or is alike to."""
    kept, work = Scratch(docs.sparkSession), Scratch(docs.sparkSession)
    rows = kept.save(_signed(docs, doc_id, text))
    texts = rows.groupBy("md5").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    nodes = work.save(texts.select(F.monotonically_increasing_id().alias("node"), "md5", "doc_id", "n", "size", "bands"))
    label = _labels(nodes, docs, doc_id, text, threshold, work)
    member = nodes.join(small_side(label), "node", "left").where("n > 1 OR label IS NOT NULL").select("md5", "doc_id", "n", F.coalesce("label", "node").alias("label"))
    of = work.save(member.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.sum("n").alias("class_size")))
    classes = kept.save(member.select("md5", "label").join(small_side(of), "label").where("class_size > 1"))
    work.drop()
    return rows.select("doc_id", "md5"), classes


def _labels(nodes: DataFrame, docs: DataFrame, doc_id: str, text: str, threshold: float, work: Scratch) -> DataFrame:
    """(node, label) of nodes that are linked to others."""
    bands = nodes.where("bands IS NOT NULL").select("node", "size", F.explode("bands").alias("key"))
    group = work.save(bands.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    live = work.save(bands.join(small_side(group), "key"))

    # A group's leader is the member that most others meet in all groups together.
    met = live.groupBy("node").agg(F.sum("n").alias("met"))
    ranked = live.join(met, "node").groupBy("key").agg(F.max(F.struct("met", "node", "size")).alias("first"))
    leader = work.save(ranked.select("key", F.col("first.node").alias("leader"), F.col("first.size").alias("of_size")))
    fits = F.least("size", "of_size") + 1e-6 >= F.greatest("size", "of_size") * threshold
    pairs = work.save(live.join(small_side(leader), "key").where((F.col("node") != F.col("leader")) & fits).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct())
    bags = _bags(live.select("node").distinct().join(nodes, "node").select("node", "md5", "doc_id"), docs, doc_id, text, work)
    label = components(_verified(pairs, bags, threshold))

    of = live.join(small_side(label), "node", "left").select("key", "node", "size", F.coalesce("label", "node").alias("label"))
    mixed = work.save(of.groupBy("key").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least != most").select("key"))
    open_ = work.save(of.join(small_side(mixed), "key", "left_semi").select("node", "size", "label").distinct())
    pairs = work.save(_prefix_pairs(open_, bags, threshold, work))
    links = _verified(pairs, bags, threshold).join(open_.select(F.col("node").alias("a"), F.col("label").alias("x")), "a").join(open_.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
    links = work.save(links.select(F.col("x").alias("a"), F.col("y").alias("b")).distinct())
    if links.isEmpty():
        return label
    # Components that the second step has linked.
    wider = components(links).select(F.col("node").alias("label"), F.col("label").alias("wider"))
    all_of = label.unionByName(open_.select("node", "label")).distinct()
    return work.save(all_of.join(small_side(wider), "label", "left").select("node", F.coalesce("wider", "label").alias("label")))


def _bags(wanted: DataFrame, docs: DataFrame, doc_id: str, text: str, work: Scratch) -> DataFrame:
    """(node, elements) of the wanted (node, md5, doc_id), from one row of docs each."""
    named = work.save(wanted.select("node", F.col("md5").alias("of_md5"), F.col("doc_id").alias("of_id")))
    d = docs.select(F.col(doc_id).alias("id"), digest(text).alias("md5"), F.col(text).alias("text"))
    found = d.join(small_side(named), (d["md5"] == named["of_md5"]) & d["id"].eqNullSafe(named["of_id"])).select("node", "text").dropDuplicates(["node"])

    def make() -> Callable:
        return lambda rows: {"elements": [elements(t) for t in rows["text"]]}

    return work.save(map_rows(found, ["text"], "elements array<long>", make, keep=True).drop("text"))


def _prefix_pairs(nodes: DataFrame, bags: DataFrame, threshold: float, work: Scratch) -> DataFrame:
    """(a, b): pairs of the nodes (node, size, label) of different labels that may be alike, and among them all that are.

    Sets of sizes x and y at the threshold t share at least t / (1 + t) * (x + y) elements. In an order of all
    elements, the first shared one therefore stands at most at place x + 1 - t / (1 + t) * (x + y) of the one set,
    and likewise in the other: so an element at place p of a set only meets sets up to the size `up_to` below.
    Rare elements come first; those of a single node meet none, so they are counted and not carried.
    """
    share = threshold / (1 + threshold)
    element = bags.join(small_side(nodes.select("node")), "node", "left_semi").select("node", F.explode("elements").alias("e"))
    common = work.save(element.groupBy("e").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    of = element.join(common, "e").groupBy("node").agg(F.collect_list(F.struct("n", "e")).alias("common"))
    of = of.join(nodes, "node").withColumn("own", F.col("size") - F.size("common"))
    prefix = F.floor(F.col("size") * (1 - threshold) + 1 + 1e-6).cast("int") - F.col("own").cast("int")
    entry = of.where(prefix > 0).select("node", "size", "label", "own", F.posexplode(F.slice(F.array_sort("common"), F.lit(1), prefix)).alias("k", "c"))
    up_to = (F.col("size") - F.col("own") - F.col("k")) / share - F.col("size") + 1e-6
    entry = work.save(entry.select(F.col("c.e").alias("e"), "node", "size", "label", up_to.alias("up_to")))
    token = entry.groupBy("e").agg(F.min("label").alias("least"), F.max("label").alias("most"), F.min("size").alias("from_size"), F.max("up_to").alias("to_size"))
    token = work.save(token.where("least != most").select("e", "from_size", "to_size"))
    entry = work.save(entry.join(small_side(token), "e").where("up_to >= from_size AND size <= to_size").select("e", "node", "size", "label", "up_to"))
    x, y = entry.alias("x"), entry.alias("y")
    fits = (F.col("x.node") < F.col("y.node")) & (F.col("x.label") != F.col("y.label")) & (F.col("x.size") <= F.col("y.up_to")) & (F.col("y.size") <= F.col("x.up_to"))
    return x.join(y, (F.col("x.e") == F.col("y.e")) & fits).select(F.col("x.node").alias("a"), F.col("y.node").alias("b")).distinct()


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row of each class of near duplicates, with all columns of docs: that of the least doc_id, null last, then the least MD5 of the text; of repeats of it, any one."""
    rows, classes = _classes(docs, doc_id, text, threshold)
    work = Scratch(docs.sparkSession)
    # Classes are told apart by their labels: the same doc_id may stand in several, or in none.
    member = work.save(rows.join(small_side(classes.select("md5", "label")), "md5"))
    first = member.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "md5")).alias("k"))
    first = work.save(first.select("label", F.col("k.doc_id").alias("of_id"), F.col("k.md5").alias("of_md5")))
    known = member.join(small_side(first), "label").withColumn("stays", (F.col("md5") == F.col("of_md5")) & F.col("doc_id").eqNullSafe(F.col("of_id")))
    known = work.save(known.groupBy("stays", F.col("md5").alias("of_md5"), F.col("doc_id").alias("of_id")).agg(F.count(F.lit(1)).alias("times")))

    own = free_name(docs, "__md5")

    def of(d: DataFrame, named: DataFrame, how: str) -> DataFrame:
        named = small_side(named.select("of_md5", "of_id"))
        return d.join(named, (d[own] == named["of_md5"]) & d[doc_id].eqNullSafe(named["of_id"]), how)

    kept = of(docs.withColumn(own, digest(text)), known.where("NOT stays"), "left_anti")
    repeated = known.where("stays AND times > 1")
    if not repeated.isEmpty():
        kept = of(kept, repeated, "left_anti").unionByName(of(kept, repeated, "left_semi").dropDuplicates([doc_id, own]))
    return kept.drop(own)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
