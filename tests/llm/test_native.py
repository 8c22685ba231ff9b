"""Licence scan, chat formatting, decontamination and fingerprints."""

import hashlib
import json
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shelfspan.llm import chat, decontaminate, fingerprints, licenses

LONG = "word " * 40000


# -- licences


def test_licenses(spark):
    mit = "Copyright (c) 2020 Some Body\n\n" + licenses.TEXTS["MIT"].upper().replace(",", "")
    rows = [(1, mit), (2, "prose\nReleased under the M.I.T. Licence.\nmore"), (3, "Released under the MIT license!\nReleased under the MIT licence\n"), (4, None), (5, ""), (6, LONG), (7, "licensed under CC-BY-NC 4.0"), (None, "Licensed under the MIT License"), (3, "(MIT License)"), (8, "the above copyright notice")]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, license string, digest int")
    got = {(r.doc_id, r.license): (r.n_lines, r.entire_text) for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert got == {(1, "MIT"): (0, True), (3, "MIT"): (2, False), (7, "CC-BY-NC-4.0"): (1, True), (None, "MIT"): (1, True)}
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).count() == 0


# -- chat


TEXT = st.text(alphabet="<|>[]/\\\nimstrendINSa_S", max_size=30)


def python_escape(t):
    return re.sub(chat.CONTROL, r"\1\\\2\3", t)


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_escape_is_reversible(text):
    escaped = python_escape(text)
    assert re.sub(chat.CONTROL_ESCAPED, r"\1\2\3", escaped) == text
    assert not any(c in escaped for c in (chat.START, chat.END, "<s>", "</s>", "[INST]", "[/INST]"))


def test_fold_and_render(spark):
    events = [
        (1, 0, 0, "message", "user", "hi"),
        (1, 0, 0, "message", "user", "hi"),  # delivered twice
        (1, 1, 1, "delta", "assistant", "Hel"),
        (1, 3, 1, "delta", None, "there"),
        (1, 2, 1, "delta", None, "lo "),
        (1, 4, 2, None, "user", "again <|im_end|>\n"),
        (1, 5, 3, "message", "assistant", "bad"),
        (1, 6, 3, "regenerate", "assistant", "go"),
        (1, 7, 3, "delta", "assistant", "od"),
        (1, 8, 2, "edit", None, "edited [INST] </s>"),
        (2, 0, 0, "message", "ro\nle%", None),
        (None, 0, 0, "message", None, LONG),
    ]
    df = spark.createDataFrame([(*e, "x") for e in events], "conv_id long, seq long, turn long, kind string, role string, text string, formatted string")
    out = {r.conv_id: r for r in chat.render(chat.fold(df)).select("*", chat.read_back(F.col("formatted")).alias("turns")).collect()}
    turns = lambda r: [(t.role, t.text) for t in r.turns]
    assert turns(out[1]) == [("user", "hi"), ("assistant", "Hello there"), ("user", "edited [INST] </s>"), ("assistant", "good")]
    assert [out[1].formatted[s.start : s.end] for s in out[1].loss_spans] == ["Hello there", "good"]
    assert turns(out[2]) == [("ro\nle%", "")] and out[2].loss_spans == []
    assert turns(out[None]) == [("", LONG)]
    assert chat.render(chat.fold(df.limit(0))).count() == 0


def test_loss_mask_of_a_log(spark):
    """The query's log folds to the rows again, and what the mask covers is the assistant's text."""
    rows = [(1, 0, "user", "a<|im_end|>"), (1, 1, "assistant", "x [INST] y"), (1, 1, "assistant", "x [INST] y"), (1, 2, "assistant", ""), (2, 0, "assistant", "<|im_end|>\n</s>é")]
    rows += [(3, k, "assistant", f"n{k}") for k in range(300)]
    log = chat.log_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r.kind for r in log.collect()} == {"message", "delta", "edit", "regenerate"}
    got = {r.conv_id: r for r in chat.render(chat.fold(log)).select("*", chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    assert got[1].loss == ["x [INST] y", "x [INST] y", ""] and got[2].loss == ["<|im_end|>\n</s>é"] and got[3].loss == [f"n{k}" for k in range(300)]
    assert got[1].n_turns == 4 and [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["x [\\INST] y"] * 2 + [""]


def test_ties_have_a_defined_order(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"seq": F.col("turn"), "kind": F.lit("message")})
    assert [r.text for r in chat.fold(df).collect()] == ["b"]


def test_tied_turns_against_sql(spark, tmp_path):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "x"), (1, 1, "assistant", "x"), (1, 1, "assistant", "y"), (1, 1, "user", "x"), (2, 0, None, "t"), (2, 0, "", None), (2, 0, "assistant", "s")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS FROM '{tmp_path}/conversations.parquet/*.parquet'")
    want = db.execute(chat.OP4_SQL).fetchall()
    assert sorted(map(tuple, chat.op4_chat_format(spark, str(tmp_path)).collect())) == sorted(want)


# -- decontamination


ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"


def swapped(text, *places):
    w = text.split()
    for p in places:
        w[p] = "other"
    return " ".join(w)


@pytest.mark.parametrize("seeds", [100_000, 0])
def test_leaks(spark, seeds):
    filler = " ".join(f"filler{k}" for k in range(50))
    docs = [
        (1, f"{filler} {ITEM.upper()}! {filler}"),
        (2, f"{filler} {swapped(ITEM, 4, 13)} {filler}"),
        (3, f"{filler} {' '.join(ITEM.split()[:8])} {filler}"),
        (4, None),
        (5, ""),
        (6, LONG),
        (7, ITEM.replace(" ", ", ")),
        (7, ITEM.replace(" ", ", ")),
        (None, ITEM),
        (8, swapped(ITEM, 2, 5, 8, 11, 14, 17)),
        (9, "Too short!"),
        (10, f"too short {filler}"),
        (11, f"{filler} One two three, four five six. {filler} one two three four five six"),
        (12, "one two three four five other"),
    ]
    d = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, h int")
    b = spark.createDataFrame([(10, ITEM, "x"), (11, "too short", "x"), (12, None, "x"), (13, "one two three four five six", "x"), (14, "...", "x")], "item_id long, text string, doc_id string")
    got = {(r.doc_id, r.item_id): (r.score, r.start, r.words) for r in decontaminate.leaks(d, b, "doc_id", broadcast_bytes=seeds).collect()}
    assert got == {(1, 10): (20, 50, 20), (2, 10): (16, 50, 20), (7, 10): (20, 0, 20), (None, 10): (20, 0, 20), (9, 11): (2, 0, 2), (11, 13): (6, 50, 6)}
    kept = decontaminate.clean(d, b)
    assert kept.columns == d.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 8, 10, 12]
    assert decontaminate.leaks(d.limit(0), b, "doc_id").count() == 0 and decontaminate.clean(d, b.limit(0)).count() == len(docs)


def test_entire_licences(spark, tmp_path):
    (tmp_path / "Long-1.0.txt").write_text("The Long\n\nLicence.")
    known = licenses.known_licenses(spark, str(tmp_path))
    docs = [(1, "BSD 3-Clause License\n\nCopyright 2020 X\n" + licenses.TEXTS["BSD-3-Clause"].upper()), (2, "prose\nMIT\nmore prose"), (3, "the long license"), (4, licenses.TEXTS["Unlicense"])]
    got = {(r.doc_id, r.license): r.entire_text for r in licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), known).collect()}
    assert got == {(1, "BSD-3-Clause"): True, (3, "Long-1.0"): True, (4, "Unlicense"): True}


def test_leaks_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    items = {r.item_id: split(r.text) for r in bench.collect()}
    want = set()
    for r in docs.collect():
        w = split(r.text)
        grams = {tuple(w[k : k + 9]) for k in range(len(w) - 8)}
        want |= {(r.doc_id, i) for i, g in items.items() if sum(tuple(g[k : k + 9]) in grams for k in range(len(g) - 8)) >= len(g) - 8}
    got = {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench, "doc_id").collect()}
    assert want <= got and len(got) <= len(want) + 2


def test_notices_of_several_lines(spark, tmp_path):
    """Heads of source files and titles of licence files, wrapped and commented out in any way; SQL finds the same."""
    apache = '# Licensed under the Apache License, Version 2.0 (the "License");\n# you may not use this file except in compliance\n# with the License. You may obtain a copy of the License at\n#\n#   https://www.apache.org/licenses/LICENSE-2.0\n'
    gnu = "/*\n * Copyright (C) 2021 Some Body\n *\n * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public Licence as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.\n */\nint main"
    docs = [
        (1, apache),
        (2, "                Apache License\n           Version 2.0, January 2004\n        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
        (3, "// SPDX-License-Identifier: MIT\nfn main() {}"),
        (4, gnu.removesuffix("int main")),
        (5, "This project is licensed under\nthe MIT License.\n\nmore"),
        (6, "# SPDX-License-Identifier: GPL-2.0-or-later"),
        (7, "about the Apache License\nVersion 2.0, January 2004"),
        (8, "\n\n\n"),
        (1, apache),
        (9, gnu),
    ]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kind string")
    got = sorted(tuple(r) for r in licenses.scan(d, licenses.known_licenses(spark)).collect())
    assert got == [
        (1, "Apache-2.0", 2, 2, True),
        (2, "Apache-2.0", 0, 1, False),
        (3, "MIT", 1, 0, False),
        (4, "GPL-3.0", 0, 1, True),
        (5, "MIT", 0, 1, False),
        (6, "GPL-2.0", 1, 0, True),
        (9, "GPL-3.0", 0, 1, False),
    ]
    d.write.parquet(str(tmp_path / "documents.parquet"))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
        assert sorted(con.execute(licenses.op2_sql()).fetchall()) == got


# -- fingerprints


def paragraphs(text):
    return set(re.findall(fingerprints.PARAGRAPH, text or ""))


def test_fingerprints_against_brute_force(spark):
    real = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    docs = [*real, (1000, None), (1001, ""), (1002, "a" * 50000), (1003, "same\ntext"), (1004, "same\ntext"), (None, "née 😀 ok"), (1003, "same\ntext")]
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id long, text string, side string, level int").repartition(5)
    got = sorted(map(json.dumps, (r.asDict() for r in fingerprints.compare_edits(d, parts=7).collect())))
    order = sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, prints = [], {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        q = len(t) // 4
        edited = t[: len(t) - q] + after[:q]
        a, b, c = paragraphs(t), paragraphs(edited), paragraphs(after)
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), round(near(a, b), 9), round(near(a, c), 9)))
    rows = [json.loads(r) for r in got]
    assert sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in rows), key=str) == sorted(want, key=str)
    by_text = {}
    for r in rows:
        by_text.setdefault(dict(docs)[r["doc_id"]], set()).add(r["fingerprint"])
    assert all(len(p) == 1 for p in by_text.values())
    prints = {p for s in by_text.values() for p in s}
    assert len(prints) >= len({frozenset(paragraphs(t)) for _, t in docs})


def test_fingerprint_edges(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fingerprints.compare_edits(empty).count() == 0
    one = spark.createDataFrame([(1, "only one text here")], "doc_id long, text string")
    r = fingerprints.compare_edits(one).first()
    assert (r.n_chars, r.near_next) == (18, 1.0)


def test_differences_recover_digests(spark):
    text = lambda *lines: "\n".join(lines)
    many = [f"line number {k}" for k in range(300)]
    rows = [(1, text("a", "b"), text("b", "c")), (2, text(*many), text(*many[5:], "new")), (3, "", text(*many)), (4, None, None), (5, "x", "x")]
    df = spark.createDataFrame(rows, "pair long, x string, y string").select("pair", fingerprints.digests(F.col("x")).alias("a"), fingerprints.digests(F.col("y")).alias("b"))
    got = {r.pair: r for r in fingerprints.differences(df, ["pair"]).collect()}
    sets = {r.pair: (set(r.a), set(r.b)) for r in df.collect()}
    for k, (a, b) in sets.items():
        assert (got[k].added, got[k].removed) == (sorted(b - a), sorted(a - b))
    assert got[2].level == 0 and got[3].level >= 1
    # 300 digests can't be had from 24 or 96 cells, so two levels are left out; without more levels the arrays are compared.
    assert got[3].level >= 2
    few = {r.pair: r for r in fingerprints.differences(df, ["pair"], levels=1).collect()}
    assert {k: (r.added, r.removed) for k, r in few.items()} == {k: (r.added, r.removed) for k, r in got.items()}
    assert few[3].level == -1 and few[2].level == 0


def test_sketches_follow_the_difference(spark):
    """Long texts that differ by little peel at a small level, unrelated ones of any size at a larger one."""
    text = lambda lo, hi: "\n".join(f"line number {k}" for k in range(lo, hi))
    rows = [(k, text(0, 2000), text(k, 2000)) for k in (1, 8, 60, 400)] + [(5000, text(0, 2000), text(3000, 5000))]
    df = spark.createDataFrame(rows, "pair long, x string, y string").select("pair", fingerprints.digests(F.col("x")).alias("a"), fingerprints.digests(F.col("y")).alias("b"))
    got = {r.pair: (r.level, r.added, r.removed) for r in fingerprints.differences(df, ["pair"], digests=False).collect()}
    assert {k: v[1:] for k, v in got.items()} == {1: (0, 1), 8: (0, 8), 60: (0, 60), 400: (0, 400), 5000: (2000, 2000)}
    levels = [got[k][0] for k in (1, 8, 60, 400, 5000)]
    assert levels == sorted(levels) and levels[0] == 0 and levels[2] <= 2 < levels[4]


def test_rounds_of_unrelated_texts(spark, monkeypatch):
    """What is left of a sketch tells the size of the next one, so texts of any size need few rounds; pairs beyond all levels are compared too."""
    rounds = []
    monkeypatch.setattr(fingerprints, "checkpoint", lambda df, real=fingerprints.checkpoint: rounds.append(1) or real(df))
    text = lambda lo, hi: "\n".join(f"line number {k}" for k in range(lo, hi))
    rows = [(k, text(0, k), text(k, 2 * k + k // 8)) for k in (5, 30, 200, 1500, 3000)] + [(1, text(0, 9), text(0, 9)), (0, None, text(0, 4000))]
    df = spark.createDataFrame(rows, "pair long, x string, y string").select("pair", fingerprints.digests(F.col("x")).alias("a"), fingerprints.digests(F.col("y")).alias("b"))
    want = {k: (k + k // 8, k) for k in (5, 30, 200, 1500, 3000)} | {1: (0, 0), 0: (4000, 0)}
    got = {r.pair: (r.added, r.removed) for r in fingerprints.differences(df, ["pair"], digests=False).collect()}
    assert got == want and len(rounds) <= 3
    few = {r.pair: r for r in fingerprints.differences(df, ["pair"], digests=False, levels=3).collect()}
    assert {k: (r.added, r.removed) for k, r in few.items()} == want
    assert [few[k].level for k in (0, 1, 1500, 3000)] == [-1, 0, -1, -1]
