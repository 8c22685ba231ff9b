"""Centroid clusters, source mixes and source divergence."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pandas as pd
import pytest

from shelfspan.llm import centroids, divergence, mixing

SF = "/root/testdata/sf0.001"


def same_rows(df, sql, views, columns):
    """Spark rows equal DuckDB's over the named views."""
    con = duckdb.connect()
    for name, what in views.items():
        if isinstance(what, str):
            con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{what}'")
        else:
            con.register(name, what)
    key = lambda r: tuple((v is None, str(v)) for v in r)
    want = sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall(), key=key)
    got = sorted((tuple(r) for r in df.select(*columns).collect()), key=key)
    assert got == want


# -- clusters


def brute_lloyd(rows, k=16, rounds=3):
    """Rows of (id, whole vector) in Python's integers."""
    c = [v for _, _, v in sorted((hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest(), (i is not None, i or 0), v) for i, v in rows)[:k]]
    best = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, x)), j) for j, x in enumerate(c))
    for _ in range(rounds):
        of = defaultdict(list)
        for _, v in rows:
            of[best(v)[1]].append(v)
        c = [[sum(col) // len(of[j]) for col in zip(*of[j])] if of[j] else x for j, x in enumerate(c)]
    return sorted((str(i), *best(v)[::-1]) for i, v in rows), c


def test_clusters_by_hand(spark):
    rng = np.random.default_rng(1)
    many = [(i, [float(x) for x in rng.normal(size=64)]) for i in range(60)]
    rows = many + [(3, many[4][1]), (3, many[4][1]), (None, many[5][1]), (70, None), (71, []), (72, [1.0] * 63), (73, [1.0] * 63 + [None]), (74, [1.0] * 63 + [math.inf]), (75, [1.0] * 63 + [math.nan]), (76, [-1e7] + [0.0] * 63), (77, [-0.0] * 64)]
    df = spark.createDataFrame([(i, e, "x", 1) for i, e in rows], "vec_id long, embedding array<double>, cluster string, v int").repartition(5)
    whole = [(i, [math.floor(64 * x) for x in e]) for i, e in rows if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e)]
    want, c = brute_lloyd(whole)
    got, found = centroids.cluster(df)
    assert sorted((str(r.vec_id), r.cluster, r.distance) for r in got.collect()) == want
    assert found.tolist() == c
    full = centroids.with_inertia(got, found).collect()
    assert len(full) == len(want) and {r.inertia for r in full} == {sum(w[2] for w in want)}
    assert {r.cluster: r.centroid_sha256 for r in full} == {j: hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest() for j in {w[1] for w in want}}


def test_clusters_of_few_and_none(spark):
    df = spark.createDataFrame([(1, [0.5] * 64), (1, [0.5] * 64), (2, [0.25] * 64)], "vec_id long, embedding array<float>")
    got, found = centroids.cluster(df)
    assert len(found) == 3 and sorted(r.distance for r in got.collect()) == [0, 0, 0]
    got, found = centroids.cluster(df.limit(0))
    assert len(found) == 0 and got.count() == 0 and centroids.with_inertia(got, found).count() == 0


def test_clusters_sql(spark):
    same_rows(centroids.op13_centroid_clusters(spark, SF), centroids.op13_sql(), {"embeddings": f"{SF}/embeddings.parquet"}, ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"])


# -- mixes


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    capped = {s for s in names if not sizes[s]}
    while True:
        left = sum(sizes.values()) - sum(most * sizes[s] for s in capped)
        open_ = [s for s in names if s not in capped]
        level = left / sum(w[s] for s in open_) if open_ else 0
        above = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * w[s] for s in names}
        capped |= above


def brute_rates(lengths, target, most=3):
    """Rates of a source's documents by bisection."""
    mean = sum(lengths) / len(lengths)
    rate = lambda lam, z: min(most, math.exp(min(60, lam * z / mean)))
    if target >= most * sum(lengths) * (1 - 1e-12):
        return {z: most for z in lengths}
    low, high = -1e4, 1e4
    for _ in range(200):
        lam = (low + high) / 2
        low, high = (low, lam) if sum(z * rate(lam, z) for z in lengths) > target else (lam, high)
    return {z: rate(low, z) for z in set(lengths)}


def check_mix(rows, got):
    """rows (doc_id, text, source), got rows of mix() with doc_id."""
    import re

    size = lambda t: len(re.findall("[^\\x20\\x09-\\x0D]+", t or ""))
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, size(t)) for i, t, _ in rows)
    of, source_of = defaultdict(list), {i: s for i, _, s in rows}
    for _, t, s in rows:
        of[s].append(size(t))
    want = brute_targets({s: sum(z) for s, z in of.items()})
    taken = defaultdict(int)
    for r in got:
        s = source_of[r.doc_id]
        assert r.source_size == sum(of[s]) and r.target == pytest.approx(want[s], rel=1e-9) and 0 <= r.taken <= 3 * r.size and r.taken == r.copies * r.size
        assert abs(r.copies - r.rate) < 1 or r.size == 0
        taken[s] += r.taken
    for s, lengths in of.items():
        some = [z for z in lengths if z]
        if some:
            rates = brute_rates(some, want[s])
            for r in got:
                if source_of[r.doc_id] == s and r.size:
                    assert r.rate == pytest.approx(rates[r.size], abs=2e-5)
            assert abs(taken[s] - want[s]) <= max(some) / 2 + 1e-3 * want[s]


def test_mix_by_hand(spark):
    rng = np.random.default_rng(2)
    rows, k = [], 0
    for source, n in (("a", 200), ("b", 40), ("Z", 30), ("é", 10), (None, 25), ("one", 1), ("", 15)):
        for _ in range(n):
            rows.append((k, "w\u00a0 " * int(rng.lognormal(3, 1) + 1), source))
            k += 1
    rows += [(1000 + j, "copy of this\ttext", "a") for j in range(300)]
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \n\t", "nothing"), (2003, "\u3000", "b"), (2004, "x " * 30000, "a"), (0, rows[0][1], "a"), (0, rows[0][1], "a"), (None, "a b c", "a")]
    df = spark.createDataFrame([(i, t, s, 7, "c") for i, t, s in rows], "doc_id long, text string, source string, size int, rank string").repartition(6)
    got = mixing.mix(df).collect()
    check_mix(rows, got)
    again = mixing.mix(df.repartition(3)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))
    whole = mixing.mix(df, keep=["doc_id", "text", "rank"])
    assert whole.columns == ["doc_id", "text", "rank", "size", "source_size", "target", "rate", "copies", "taken"]
    assert mixing.taken_rows(whole).count() == sum(r.copies for r in got)


def test_mix_of_nothing(spark):
    df = spark.createDataFrame([(1, None, None), (2, "", "s")], "doc_id long, text string, source string")
    assert mixing.mix(df.limit(0)).count() == 0
    assert {(r.doc_id, r.size, r.source_size, r.target, r.taken) for r in mixing.mix(df).collect()} == {(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)}
    one = mixing.mix(df.withColumn("text", df.doc_id.cast("string"))).collect()
    assert sum(r.taken for r in one) == 2


def test_mix_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    check_mix([(r.doc_id, r.text, r.source) for r in docs.collect()], mixing.mix(docs).collect())
    assert mixing.op12_source_mix(spark, SF).columns[:5] == ["doc_id", "size", "source_size", "target", "taken"]


# -- divergence


COLUMNS = ["lang", "source", "part", "item", "value", "rank"]


def brute_audit(rows, top=200):
    """Rows of (text, lang, source), in Python's integers."""
    import re

    rows = [tuple(x or "" for x in r) for r in rows]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    found = [(re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", t.translate(lower)), lang, s) for t, lang, s in rows]
    out = []
    for lang in {r[1] for r in rows}:
        df, n = Counter(), defaultdict(Counter)
        for terms, l, s in found:
            if l == lang:
                df.update(set(terms))
                n[s].update(terms)
        kept = [t for t, k in df.items() if k >= 3]
        p = lambda c: (lambda total: {t: 1 + 10**9 * (c[t] + 1) // (total + len(kept)) for t in kept})(sum(c[t] for t in kept))
        of = {s: p(c) for s, c in n.items()}
        q = p(sum(n.values(), Counter()))
        for s in of:
            pairs = [(o, sum((of[s][t] - of[o][t]) ** 2 // of[o][t] for t in kept)) for o in of if o != s]
            terms = [(t, (of[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[s][t] and of[s][t] > q[t]]
            for part, items, k in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(items[:k], 1)]
    return sorted(out)


def test_audit_by_hand(spark):
    rng = np.random.default_rng(3)
    pool = [f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(400)] + ["É", "é", "日本", "\u00a0", "Ab", "aB"]
    rows = [(" ".join(rng.choice(pool, int(rng.integers(1, 60)))), "en", f"s{k % 5}") for k in range(80)]
    rows += [("same same copy", "en", "s0")] * 40 + [(None, "en", None), ("", "en", "empty"), ("a b", None, "x"), ("a c", None, None), ("1 2 3", "xx", "only"), ("x1y_Z ´", "en", "s1"), ("long " * 30000, "en", "s2")]
    df = spark.createDataFrame([(k, *r, 1, "p") for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n int, part string").repartition(5)
    want = brute_audit(rows)
    assert sorted(map(tuple, divergence.audit(df).select(*COLUMNS).collect())) == want
    # Many small blocks, and short lists merged from them.
    assert sorted(map(tuple, divergence.audit(df, top=7, cells=40).select(*COLUMNS).collect())) == brute_audit(rows, 7)
    assert divergence.audit(df.limit(0)).count() == 0
    same_rows(divergence.audit(df), divergence.OP11_SQL, {"documents": pd.DataFrame([(k, *r) for k, r in enumerate(rows)], columns=["doc_id", "text", "lang", "source"])}, COLUMNS)


def test_counts_return_before_they_grow(spark, monkeypatch):
    rows = [(f"a{chr(97 + k)} b", "en", f"s{k % 3}") for k in range(26)]
    df = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(1)
    monkeypatch.setattr(divergence, "HELD", 4)
    got = divergence.term_counts(df).groupBy("term").sum("n", "docs").collect()
    assert {(r[0], r[1], r[2]) for r in got} >= {("b", 26, 26), ("ac", 1, 1)}


def test_shares_of_large_totals():
    c, total = np.array([0, 5 * 10**11, 10**12 - 1], dtype=np.int64), np.int64(9 * 10**12)
    assert divergence.shares(c, np.array([total]), 7).tolist() == [1 + 10**9 * (int(x) + 1) // (int(total) + 7) for x in c]


def test_audit_sql(spark):
    same_rows(divergence.op11_source_divergence(spark, SF), divergence.OP11_SQL, {"documents": f"{SF}/documents.parquet"}, COLUMNS)


# -- stages keep the caller's columns


def test_stages_keep_columns_with_clashing_names(spark):
    from shelfspan.llm import minhash, toxicity

    docs = spark.createDataFrame([(k, f"text {k} of its own kind " * 8, "x", "y", "z") for k in range(8)] + [(9, "text 0 of its own kind " * 8, "a", "b", "c"), (10, None, "d", "e", "f")], "doc_id long, text string, __toxicity string, __md5 string, `__TOXICITY_` string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(8)], "doc_id long, toxic int")
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns and kept.count() < docs.count() and {r["__md5"] for r in kept.collect()} <= {"y", "b", "e"}
    clean = toxicity.reject(docs, labels, threshold=1.1)
    assert clean.columns == docs.columns and sorted(map(str, clean.collect())) == sorted(map(str, docs.collect()))
    for empty in (minhash.deduplicate(docs.limit(0)), toxicity.reject(docs.limit(0), labels)):
        assert empty.columns == docs.columns and empty.count() == 0
