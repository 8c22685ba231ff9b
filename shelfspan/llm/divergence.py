"""How sources of a language differ in their words: divergence of every pair of sources, and each source's most overused terms.

Texts are counted in the tasks that read them, so what is shuffled is counts by language, source and term. Kept
terms of a language are dealt to blocks by hash. A block's task has the totals of the language's sources and a dense
int64 matrix of sources by terms, of bounded size; it compares all pairs of sources by broadcasting over the block and
keeps the best terms of each source. Partial pair sums are added up, and the blocks' best terms merge into one list a source.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.llm.common import ROWS_AT_A_TIME, Scratch, table

#: Documents of its language that a term is in at least, and terms that a source's list has at most.
DOCUMENTS, TOP = 3, 200
#: Cells of a block's matrix: 2 MB, and twice or thrice as much while pairs are compared.
CELLS = 1 << 18
#: Terms of all sources that a task counts before it returns what it has.
HELD = 400_000
PARTS = 1_000_000_000
#: ASCII letters in lower case and all bytes of other characters stay, and the rest parts terms. On UTF-8 bytes this is `[^\x00-\x40\x5B-\x60\x7B-\x7F]+`.
TERM_BYTES = bytes(b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 0x20 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """(lang, source, term, n, docs): partial counts, and for each group a row with an empty term, so that no group is missed. Nulls count as empty strings."""
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    rows = docs.select(cell(lang).alias("lang"), cell(source).alias("source"), cell(text).cast("binary").alias("text"))
    one = 1 << 48  # documents are counted in the bits above a term's occurrences, as Python's integers have no end

    def batch(held: dict[tuple[str, str], dict[bytes, int]]) -> pa.RecordBatch:
        flat = [(*g, t.decode("utf-8", "replace"), v & (one - 1), v >> 48) for g, terms in held.items() for t, v in [(b"", 0), *terms.items()]]
        columns = list(zip(*flat, strict=True)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = {}, 0
        for b in batches:
            for k in range(0, b.num_rows, ROWS_AT_A_TIME):
                part = b.slice(k, ROWS_AT_A_TIME)
                for g in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), part.column("text"), strict=True):
                    terms = held.setdefault(g[:2], {})
                    size -= len(terms)
                    for t, n in Counter(g[2].as_py().translate(TERM_BYTES).split()).items():
                        terms[t] = terms.get(t, 0) + one + n
                    size += len(terms)
                    if size > HELD:
                        yield batch(held)
                        held, size = {}, 0
        yield batch(held)

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def shares(counts: np.ndarray, total: np.ndarray, kept: int) -> np.ndarray:
    """1 + floor(PARTS * (counts + 1) / (total + kept)) by long division, a thousand at a time: exact for totals below 9e15."""
    d = total + np.int64(kept)
    a = counts + 1
    whole, rest = a // d, a % d
    for _ in range(3):
        whole, rest = whole * 1000 + rest * 1000 // d, rest * 1000 % d
    return whole + 1


def block_tile(frame: pd.DataFrame, top: int = TOP) -> pd.DataFrame:
    """Partial results of one block: rows with a null term are the language's sources (n: their total, lang_n: the language's, kept: its terms), the others counts of the block's terms."""
    head = frame["term"].isna().to_numpy()
    sources = sorted(frame["source"][head])
    row_of = {s: k for k, s in enumerate(sources)}
    heads, cells = frame[head].set_index("source").loc[sources], frame[~head]
    terms = sorted(set(cells["term"]), key=lambda t: t.encode("utf-8", "surrogatepass"))
    column_of = {t: k for k, t in enumerate(terms)}
    tile = np.zeros((len(sources), len(terms)), dtype=np.int64)
    tile[[row_of[s] for s in cells["source"]], [column_of[t] for t in cells["term"]]] = cells["n"].to_numpy(np.int64)
    kept = int(heads["kept"].iloc[0])
    p = shares(tile, heads["n"].to_numpy(np.int64)[:, None], kept) if terms else tile
    q = shares(tile.sum(axis=0), heads["lang_n"].to_numpy(np.int64)[:1], kept) if terms else tile.sum(axis=0)
    out = []
    for k, s in enumerate(sources):
        gap = p[k] - p
        sums = (gap * gap // p).sum(axis=1) if terms else np.zeros(len(sources), dtype=np.int64)
        out += [(s, "pair", o, int(v)) for o, v in zip(sources, sums, strict=True) if o != s]
        over = np.flatnonzero((tile[k] > 0) & (p[k] > q))
        f = (p[k][over] - q[over]) ** 2 // q[over]
        # Terms are in order, so a stable sort by value leaves ties in order.
        out += [(s, "term", terms[over[j]], int(f[j])) for j in np.argsort(-f, kind="stable")[:top]]
    got = pd.DataFrame(out, columns=["source", "part", "item", "value"])
    got.insert(0, "lang", frame["lang"].iloc[0])
    return got


def blocks(docs: DataFrame, scratch: Scratch, documents: int = DOCUMENTS, cells: int = CELLS) -> DataFrame:
    """(lang, block, source, term, n, lang_n, kept): the input of `block_tile`, each block's sources with it."""
    counts = scratch.save(term_counts(docs).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.where("term != ''").withColumns({"all": F.sum("docs").over(of_term), "first": F.min("source").over(of_term)}).where(F.col("all") >= documents)
    kept = scratch.save(kept.select("lang", "source", "term", "n", (F.col("first") == F.col("source")).alias("new")))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count_if("new").alias("new"))
    groups = scratch.save(counts.where("term = ''").select("lang", "source").join(totals, ["lang", "source"], "left").select("lang", "source", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("n", "new"))))
    langs = groups.groupBy("lang").agg(F.sum("n").alias("lang_n"), F.sum("new").alias("kept"), F.greatest(F.lit(1), F.ceil(F.sum("new") * F.count(F.lit(1)) / cells)).cast("int").alias("blocks"))
    langs = scratch.save(langs)
    heads = groups.join(langs, "lang").select("lang", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "lang_n", "kept")
    rows = kept.join(langs, "lang").select("lang", F.pmod(F.xxhash64("term"), "blocks").cast("int").alias("block"), "source", "term", "n", F.lit(0).cast("long").alias("lang_n"), F.lit(0).cast("long").alias("kept"))
    return heads.unionByName(rows)


def audit(docs: DataFrame, documents: int = DOCUMENTS, top: int = TOP, cells: int = CELLS) -> DataFrame:
    """(lang, source, part, item, value, rank) of every group of language and source: part `pair` has all other sources of the language, part `term` at most `top` overused terms.

    Null text, language and source count as empty. A group without terms is compared all the same; languages without a kept term have pairs of value 0. An
    empty table gives no rows. Ties rank by the UTF-8 bytes of the item, repeated rows count each, and other columns aren't looked at. The
    result reads a table in the shared folder.
    """
    spark = docs.sparkSession
    scratch, kept = Scratch(spark), Scratch(spark)
    tiles = blocks(docs, scratch, documents, cells).groupBy("lang", "block").applyInPandas(lambda f: block_tile(f, top), "lang string, source string, part string, item string, value long")
    parts = kept.save(tiles)
    scratch.drop()
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")).alias("rank")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).select("*", place)
    terms = parts.where("part = 'term'").select("*", place).where(F.col("rank") <= top)
    return pairs.unionByName(terms)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(list_concat([''], regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))) AS term FROM documents),
t AS (SELECT lang, source, term, count(*) AS n FROM d GROUP BY ALL),
kept AS (SELECT lang, term FROM d WHERE term <> '' GROUP BY ALL HAVING count(DISTINCT row) >= 3),
g AS (SELECT lang, source FROM t WHERE term = ''),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
cells AS (SELECT g.lang, g.source, kept.term, coalesce(t.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN t ON t.lang = g.lang AND t.source = g.source AND t.term = kept.term),
p AS MATERIALIZED (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + v))::HUGEINT AS p FROM cells JOIN v USING (lang)),
q AS (SELECT lang, term, (1 + (1000000000::HUGEINT * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + v))::HUGEINT AS q FROM (SELECT lang, term, sum(n) AS n FROM cells GROUP BY 1, 2) JOIN v USING (lang)),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
every AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs ON pairs.lang = a.lang AND pairs.source = a.source AND pairs.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM every UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
