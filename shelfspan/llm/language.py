"""Language identification by word-first backoff.

A word that was seen in training adds its log frequency in each language. For an unseen word the longest of
its character n-grams that were seen add theirs instead: of four characters if any was, else of three, two or
one. The language with the highest mean is the answer.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

import numpy as np
import regex
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.bpe import Remembered
from shelfspan.llm.common import Scratch, held_out, map_rows, small_batches, table

#: Documents that are learned from at most: those with the least hashes of their ids.
SAMPLE = 20_000
#: A word or n-gram is known if the sample has it at least so often; of a bounded sample that also bounds the model.
SEEN = 2
LONGEST = 4
#: Characters of a word that n-grams are taken from; longer words are cut in pieces of this length first.
PIECE = 64
WORD = regex.compile(r"\p{L}+")


def training_words(docs: DataFrame, text: str, lang: str, doc_id: str, rows: int = SAMPLE) -> DataFrame:
    """(lang, word, n): counts over at most `rows` documents that have a language, a text and an id and aren't held out."""
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    chosen = usable.select(F.col(doc_id).alias("of")).distinct().orderBy(F.xxhash64("of"), "of").limit(rows)
    used = usable.join(F.broadcast(chosen), F.col(doc_id) == F.col("of"), "left_semi")
    words = used.select(F.col(lang).cast("string").alias("lang"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(rf"\p{{L}}{{1,{PIECE}}}"), F.lit(0))).alias("word"))
    return words.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n"))


def train(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> dict:
    """{"name": of this model, "langs": [...], "units": ascending hashes, "scores": float32 log frequencies with one added, a row for each unit and a column for each language}.

    Units are the words and the n-grams of each length that the sample has at least SEEN times, all of them;
    `unit_hash` tells words from n-grams. Counting is done by Spark; the table, which the sample bounds, is
    collected as hashes and counts. Without a usable document langs is empty.
    """
    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(training_words(docs, text, lang, doc_id))
    langs = sorted(r[0] for r in counts.select("lang").distinct().collect())
    if not langs:
        scratch.drop()
        return {"langs": [], "units": np.zeros(0, np.int64), "scores": np.zeros((0, 0), np.float32)}
    marked = F.concat(F.lit(" "), "word", F.lit(" "))

    def cut(k: int) -> Column:
        all_of = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length("w") - (k - 1), F.lit(1))), lambda i: F.struct(F.lit(k).alias("k"), F.substr("w", i, F.lit(k)).alias("unit")))
        return F.filter(all_of, lambda u: F.char_length(u["unit"]) == k)

    whole = F.array(F.struct(F.lit(0).alias("k"), F.col("word").alias("unit")))
    units = counts.withColumn("w", marked).select("lang", "n", F.explode(F.concat(whole, *map(cut, range(1, LONGEST + 1)))).alias("u"))
    table = units.groupBy("u.k", F.xxhash64("u.k", "u.unit").alias("unit")).agg(*(F.sum(F.when(F.col("lang") == g, F.col("n")).otherwise(0)).alias(f"n{c}") for c, g in enumerate(langs)))
    got = table.where(sum((F.col(f"n{c}") for c in range(len(langs))), F.lit(0)) >= SEEN).toPandas()
    scratch.drop()
    n = got[[f"n{c}" for c in range(len(langs))]].to_numpy(np.float64)
    scores = np.zeros(n.shape, np.float32)
    for k in range(LONGEST + 1):
        of = got["k"].to_numpy() == k
        scores[of] = np.log((n[of] + 1) / (n[of].sum(axis=0) + of.sum()))
    units = got["unit"].to_numpy(np.int64)
    order = np.argsort(units)
    return {"name": uuid.uuid4().hex, "langs": langs, "units": units[order], "scores": scores[order]}


#: Hash of each kind of unit alone, with Spark's seed.
KINDS = tuple(xxhash.xxh64_intdigest(k.to_bytes(4, "little"), 42) for k in range(LONGEST + 1))


def unit_hash(k: int, unit: str) -> int:
    """What Spark's xxhash64 gives for the columns (k, unit): k is 0 for a word, else the n-gram's length."""
    got = xxhash.xxh64_intdigest(unit.encode("utf-8", "surrogatepass"), KINDS[k])
    return got - (1 << 64) if got >= 1 << 63 else got


#: The index of the model that this process has used last, by the model's name: Python workers go from task to task.
_INDEX: dict[str, dict[int, int]] = {}


def index_of(model: dict) -> dict[int, int]:
    """Places of the model's hashes; built once in a process, not in each task."""
    name = model.get("name")
    if name is None or name not in _INDEX:
        built = {h: at for at, h in enumerate(model["units"].tolist())}
        if name is None:
            return built
        _INDEX.clear()
        _INDEX[name] = built
    return _INDEX[name]


def unit_scores(k: int, unit: str, model: dict) -> np.ndarray | None:
    """A unit's row of scores; the first call looks for the index of the model's hashes."""
    if "index" not in model:
        model["index"] = index_of(model)
    at = model["index"].get(unit_hash(k, unit))
    return None if at is None else model["scores"][at]


def word_scores(word: str, model: dict) -> np.ndarray:
    """A word's score in each language."""
    known = unit_scores(0, word, model)
    if known is not None:
        return known
    w = f" {word} "
    for k in range(min(LONGEST, len(w)), 0, -1):
        got = [s for i in range(len(w) - k + 1) if (s := unit_scores(k, w[i : i + k], model)) is not None]
        if got:
            return sum(got) / len(got)
    return np.zeros(len(model["langs"]))


def predict(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """docs with lang_pred string and score double.

    lang_pred is a language of the model, or `und` with score 0 where the text is null or has no letter or the
    model is empty; of languages that tie the first by name. The score is the answer's share of the languages'
    likelihoods, by mean log frequency of up to the square root of the words: it lies between 0 and 1. Rows and
    other columns stay; columns of these names are replaced. One pass without a shuffle.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable:
        model = dict(sent.value)
        langs = model["langs"]
        known = Remembered(lambda w: word_scores(w, model), limit=200_000)

        def one(t: str | None) -> tuple[str, float]:
            words = WORD.findall((t or "").lower())
            if not words or not langs:
                return "und", 0.0
            pieces = words if max(map(len, words)) <= PIECE else [w[k : k + PIECE] for w in words for k in range(0, len(w), PIECE)]
            mean = np.sum(list(map(known.__getitem__, pieces)), axis=0) / len(pieces)
            share = np.exp((mean - mean.max()) * math.sqrt(len(pieces)))
            best = int(np.argmax(mean))
            return langs[best], float(share[best] / share.sum())

        def f(rows: dict[str, list]) -> dict[str, list]:
            got = [one(t) for t in rows[text]]
            return {"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]}

        return f

    return map_rows(docs, [text], "lang_pred string, score double", make, keep=True)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return predict(docs.select("doc_id", "text"), train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
