"""Clusters of vectors by plain Lloyd rounds over whole numbers.

Vectors become vectors of integers, so sums and distances are exact and a rerun, or a task that is done again,
gives the same centroids. In each round the centroids, k times as many numbers as a vector has, go to all
tasks; a task assigns its vectors in NumPy and returns one row of sums and counts for each centroid it has used,
and a groupBy adds these rows up. Vectors are written once, as integers, and never shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspan.llm.common import Scratch, table

CLUSTERS, ROUNDS, DIMENSIONS, SCALE = 16, 3, 64, 64
#: Vectors that a task compares at a time: the differences to one centroid take 2 MB.
AT_A_TIME = 4096
#: Components up to here have squared distances of 64 components that fit 63 bits; others are compared as Python's integers.
PLAIN = 1 << 27


def whole_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component, of vectors with so many components, none null, NaN or infinite. Components, and squared distances, that no long can hold end the job with an error."""
    e = F.transform(F.col(embedding), lambda x: x.cast("double"))
    fine = (F.size(e) == dimensions) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.select(F.col(vec_id).alias("vec_id"), e.alias("e")).where(fine).select("vec_id", F.transform("e", lambda x: F.floor(x * F.lit(float(scale))).cast("long")).alias("v")).where("v is not null")


def first_centroids(whole: DataFrame, k: int = CLUSTERS) -> np.ndarray:
    """The k vectors with the least SHA-256 of `1:` and their id, in that order; those of one id by id, then components. Fewer where there are fewer vectors."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    rows = whole.select(digest.alias("h"), "vec_id", "v").orderBy("h", F.col("vec_id").asc_nulls_first(), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], dtype=np.int64)


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid, the smallest on ties, and the squared distance, of each row of x."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) > PLAIN:
        x, centroids = x.astype(object), centroids.astype(object)
    squared = np.stack([((x - c) ** 2).sum(axis=1) for c in centroids], axis=1)
    at = squared.argmin(axis=1)
    return at.astype(np.int32), squared[np.arange(len(x)), at].astype(np.int64)


def _slices(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.Series, np.ndarray]]:
    for frame in frames:
        for k in range(0, len(frame), AT_A_TIME):
            part = frame.iloc[k : k + AT_A_TIME]
            yield part["vec_id"], np.stack(part["v"].to_numpy()).astype(np.int64)


def moved(whole: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Centroids after one round: floors of the means of their vectors; those without vectors stay."""
    sent = whole.sparkSession.sparkContext.broadcast(centroids)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = sent.value
        total, n = np.zeros(c.shape, dtype=object), np.zeros(len(c), dtype=np.int64)
        for _, x in _slices(frames):
            at, _ = nearest(x, c)
            for k in np.unique(at):
                mine = x[at == k]
                plain = np.abs(mine).max(initial=0) <= PLAIN
                total[k] += (mine if plain else mine.astype(object)).sum(axis=0).astype(object)
                n[k] += len(mine)
        used = np.flatnonzero(n)
        if len(used):
            yield pd.DataFrame({"cluster": used.astype(np.int32), "n": n[used], "s": [[str(v) for v in total[k]] for k in used]})

    parts = whole.mapInPandas(sums, "cluster int, n long, s array<string>")
    d = centroids.shape[1]
    # Sums of a task may have more digits than a long, so they come as text and are added as decimals.
    added = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.get("s", k).cast("decimal(38,0)")) for k in range(d))).alias("s"))
    out = centroids.copy()
    for r in added.collect():  # a row for each centroid
        out[r.cluster] = [int(s) // r.n for s in r.s]
    return out


def assigned(whole: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(vec_id, cluster, distance) of each vector."""
    sent = whole.sparkSession.sparkContext.broadcast(centroids)

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for ids, x in _slices(frames):
            at, distance = nearest(x, sent.value)
            yield pd.DataFrame({"vec_id": ids.to_numpy(), "cluster": at, "distance": distance})

    return whole.mapInPandas(assign, f"vec_id {dict(whole.dtypes)['vec_id']}, cluster int, distance long")


def centroid_digests(centroids: np.ndarray) -> list[str]:
    return [hashlib.sha256(",".join(map(str, map(int, c))).encode()).hexdigest() for c in centroids]


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance) of each usable vector, and the centroids.

    Rows are kept one for one, repeated ids too; vectors that are null, of another length or with a component that is null or not finite have
    no row; a null id is kept. An empty table, or one without usable vectors, gives no rows and no centroids. The
    integer vectors are a table in the shared folder while the rounds run; the result is a table there.
    """
    scratch, kept = Scratch(vectors.sparkSession), Scratch(vectors.sparkSession)
    whole = scratch.save(whole_vectors(vectors, vec_id, embedding, dimensions, scale))
    centroids = first_centroids(whole, k)
    for _ in range(rounds if len(centroids) else 0):
        centroids = moved(whole, centroids)
    if len(centroids):
        got = kept.save(assigned(whole, centroids))
    else:
        got = kept.save(whole.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("long").alias("distance")))
    scratch.drop()
    return got, centroids


def with_inertia(got: DataFrame, centroids: np.ndarray) -> DataFrame:
    """Adds cluster_inertia, inertia and centroid_sha256. What is joined has one row for each centroid."""
    spark = got.sparkSession
    digests = spark.createDataFrame(list(enumerate(centroid_digests(centroids))), "cluster int, centroid_sha256 string")
    per = got.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = got.agg(F.sum("distance").alias("inertia"))
    facts = per.join(digests, "cluster").join(whole, F.lit(True))
    return got.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_inertia(*cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding")))


def op13_sql(rounds: int = ROUNDS, k: int = CLUSTERS) -> str:
    """The same by lists of whole numbers; a mean's floor is taken with a remainder that isn't negative."""
    ctes = [
        f"whole AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings"
        f" WHERE len(embedding) = {DIMENSIONS} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {DIMENSIONS})",
        f"c0 AS (SELECT row_number() OVER (ORDER BY h, vec_id NULLS FIRST, v) - 1 AS cluster, v AS c FROM (SELECT *, sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h FROM whole ORDER BY h, vec_id NULLS FIRST, v LIMIT {k}))",
    ]
    for n in range(rounds + 1):
        ctes.append(
            f"a{n} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(v) AS v, min((d, cluster)) AS best FROM (SELECT row, vec_id, v, cluster, CAST(list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM whole, c{n}) GROUP BY row)"
        )
        if n < rounds:
            ctes.append(
                f"m{n} AS (SELECT cluster, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS c FROM (SELECT best[2] AS cluster, i, sum(v[i])::HUGEINT AS s, count(*)::HUGEINT AS n FROM a{n}, range(1, {DIMENSIONS + 1}) t(i) GROUP BY 1, 2) GROUP BY 1),"
                f" c{n + 1} AS MATERIALIZED (SELECT c{n}.cluster, coalesce(m{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN m{n} USING (cluster))"
            )
    last = f"a{rounds}"
    return (
        "WITH " + ",\n".join(ctes) + f"\nSELECT vec_id, best[2]::INTEGER AS cluster, best[1] AS distance, sum(best[1]) OVER (PARTITION BY best[2])::BIGINT AS cluster_inertia, sum(best[1]) OVER ()::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256"
        f" FROM {last} JOIN c{rounds} ON cluster = best[2]"
    )
