"""Alignment of brands, customers and codes without a common word."""

import random

import pytest

from shelfspan.functions import fuzzy
from shelfspan.operators import align, markets


def brand_of(c, panel):
    """A client brand's panel brand and basis, comparing all pairs; of equal ones as the operator documents."""
    tight = lambda x: "".join(x.split())
    if same := [d for d in panel if tight(d) == tight(c)]:
        return min(same), "equal"
    if len(c) >= 3 and (within := [d for d in panel if c in d or d in c]):
        return min(within, key=lambda d: (len(d), d)), "contained"
    p, t, d = max((fuzzy.partial_ratio(c, d), fuzzy.token_set_ratio(c, d), d) for d in panel)
    return (d, "alike") if p >= 82 and t >= 60 else None


def names(count, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.choice((1, 2, 3, 4, 6, 9))))
    found = {" ".join(word() for _ in range(rng.choice((1, 1, 2)))) for _ in range(count)}
    changed = set()
    for x in found:
        k = rng.randrange(len(x))
        changed.add(" ".join((x[:k] + rng.choice(("", "a", "bc")) + x[k + rng.choice((0, 1)) :]).split()))
    return sorted(found), sorted(changed - {""})


@pytest.mark.parametrize(
    ("client", "panel"),
    [
        (["pepsi", "cheerois", "x", "ab", "smartwater", "brand#2", "brand#5"], ["pepsico", "cheerios", "extra x", "cabs", "smart water", "maker brand#22", "maker brand#25", "zzz"]),
        (["pepsico", "aaaa"], ["pepsi", "aa", "a"]),
        names(120, 3),
    ],
)
def test_brands_against_brute_force(spark, client, panel):
    frame = lambda rows: spark.createDataFrame([(x,) for x in [*rows, None]], "brand string")
    got = {r.client_brand: (r.panel_brand, r.basis) for r in align.align_brands(frame(client), frame(panel)).collect()}
    assert got == {c: b for c in client if (b := brand_of(c, panel))}


def test_customers(spark):
    got, notes = markets.customer_map(spark, ["Walgreens", "Publix", "Kroger Stores", "Nobody"], ["Wallgreens", "Publix", "Stores Kroger", "Target"])
    assert {c: d for c, (d, _) in got.items()} == {"Walgreens": "Wallgreens", "Publix": "Publix", "Kroger Stores": "Stores Kroger"} and not notes
    got, notes = markets.customer_map(spark, ["Foo"], ["Bar"])
    assert got["Foo"][0] == "Bar" and len(notes) == 1
    assert markets.customer_map(spark, ["Foo", "Fuu"], ["Bar"]) == ({}, []) and markets.customer_map(spark, [], ["Bar"]) == ({}, [])


def test_markets(spark):
    client = ["Total", "Boston Region", "Western NY", "Denver", "Atlantis", "South", "National Account"]
    panel = ["Acme Total US", "Acme Boston TA", "Acme Buffalo TA", "Acme Albany TA", "Acme Denver TA", "Acme Total US NHM", "Acme Miami TA"]
    got = markets.align_labels(spark, client, panel, "Acme")
    by = {m[0]: m[1:] for m in got.matches}
    assert list(by) == client
    assert by["Total"] == ("Acme Total US", "total-rollup", 1.0, False, None)
    assert by["Boston Region"][0] == "Acme Boston TA" and by["Denver"][:2] == ("Acme Denver TA", "fuzzy") and by["Denver"][2] == 1.0
    assert by["Western NY"] == ("Western NY  (rollup of: Acme Buffalo TA)", "geo-rollup", 0.85, True, ["Acme Buffalo TA"])
    assert by["South"] == ("South  (rollup of: Acme Miami TA)", "geo-rollup", 0.85, True, ["Acme Miami TA"])
    # What is left of the country goes to a national label.
    assert by["National Account"][3:] == (True, ["Acme Albany TA"])
    assert by["Atlantis"][0] is None and len(got.warnings) == 3
    assert markets.align_labels(spark, [], panel).matches == [] and [m[1] for m in markets.align_labels(spark, ["a"], []).matches] == [None]


def descriptions(count, seed):
    rng = random.Random(seed)
    pool = ["lime", "fizz", "cola", "a", "b", "12pk", "12oz", "can", "cans", "bottle", "botle", "zero", "sugar", "x", "vanillaextract"]
    return sorted({" ".join(rng.choice(pool) for _ in range(rng.choice((1, 2, 3, 4, 6)))) + rng.choice(("", "", "s", " q")) for _ in range(count)})


@pytest.mark.parametrize("cutoff", [85, 70, 95])
def test_alike_pairs_against_brute_force(spark, cutoff):
    left, right = [*descriptions(150, 1), "", " ", "zzz"], [*descriptions(150, 2), "", "cola", "cola cola lime"]
    frame = lambda rows: spark.createDataFrame([(x,) for x in [*rows, None, rows[0]]], "d string")
    got = {(r.a, r.b) for r in align.alike_pairs(frame(left).toDF("a"), "a", frame(right).toDF("b"), "b", cutoff).collect()}
    assert got == {(a, b) for a in left for b in right if fuzzy.token_set_ratio(a, b) >= cutoff}


def test_crosswalk_of_a_brand_within_a_word(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "upc_key string, description string, brand string, position int")
    got = align.build_crosswalk(frame(("1", "lime cola 12", "pepsi", 0)), frame(("2", "lime cola 12", "pepsico", 0), ("3", "lime cola 12", "other", 1))).collect()
    assert [(r.client_key, r.panel_key) for r in got] == [("1", "2")]
