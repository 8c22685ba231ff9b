"""Alignment of labels that name places or retailers: few, so their lists are known to every task.

Each client label is compared with all labels of the panel by the task that has it; the claims that follow go label by
label, best first. Labels are what a market or customer column has distinct values of, never rows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from shelfspan.functions import fuzzy, geography, text
from shelfspan.operators.align import DIRECTIONS, ENOUGH, GENERIC, HIGH, TOTALS

#: Labels of one side; a column with more isn't one of markets or customers, and the run ends with an error.
LABELS = 50_000
SCHEMA = "client_market string, panel_market string, basis string, score double, caveat boolean, components array<string>"
#: Names of what a match rests on.
EXACT, CUSTOMER_PREFIX, STRIPPED, TOTAL, FUZZY, GEO, NONE = "exact", "customer-prefix", "stripped-suffix", "total-rollup", "fuzzy", "geo-rollup", "none"


@dataclass
class Alignment:
    """matches: (client label, panel label or None, basis, score, caveat, components or None), in the client's order."""

    matches: list[tuple]
    warnings: list[str] = field(default_factory=list)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.matches, SCHEMA)

    def mapped(self) -> dict[str, str]:
        return {m[0]: m[1] for m in self.matches if m[1] is not None}


def checked(labels: Sequence[str]) -> list[str]:
    if len(labels) > LABELS:
        raise ValueError(f"{len(labels)} different labels; {LABELS} at most are compared")
    return list(labels)


def best_of_all(spark: SparkSession, left: Sequence[str], right: Sequence[str], score: Callable[[str, list[str]], tuple[float, int, str]]) -> dict[str, tuple[float, str | None, str]]:
    """For each left label (score, best right label, note): `score` gives the place of the best of all right labels, -1 for none. Left labels are dealt to tasks."""
    if not left or not right:
        return {c: (0.0, None, "") for c in left}
    sent = spark.sparkContext.broadcast(list(right))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [score(c, sent.value) for c in frame["label"]]
            yield pd.DataFrame({"label": frame["label"], "s": [float(g[0]) for g in got], "at": [int(g[1]) for g in got], "note": [g[2] for g in got]})

    rows = spark.createDataFrame([(c,) for c in left], "label string").mapInPandas(run, "label string, s double, at int, note string").collect()  # a row for each label
    return {r.label: (r.s, right[r.at] if r.at >= 0 else None, r.note) for r in rows}


# -- customers


def plain(label: str) -> str:
    """The label as `text.norm_value` has it."""
    return re.sub("[^a-z0-9]+", " ", label.lower()).strip()


def _nearest_customer(c: str, panel: list[str]) -> tuple[float, int, str]:
    mine = plain(c)
    forms = [plain(d) for d in panel]
    if mine in forms:
        return 100.0, forms.index(mine), EXACT
    scores = [fuzzy.token_set_ratio(mine, d) for d in forms]
    at = max(range(len(scores)), key=lambda k: (scores[k], -k))
    return scores[at], at if scores[at] > 0 else -1, FUZZY


def customer_map(spark: SparkSession, client: Sequence[str], panel: Sequence[str], cutoff: float = 90) -> tuple[dict[str, tuple[str, float]], list[str]]:
    """Each client customer's panel customer and score, and warnings: equal after normalising, else the most alike from the cutoff on, the first on ties. A single customer on each side is taken for the same."""
    best = best_of_all(spark, checked(client), checked(panel), _nearest_customer)
    found = {c: (d, s) for c, (s, d, _) in best.items() if d is not None and s >= cutoff}
    if not found and len(client) == 1 == len(panel):
        return {client[0]: (panel[0], best[client[0]][0])}, [f"The customers '{client[0]}' and '{panel[0]}' differ in name; as each side has one only, they are taken for the same, with a caveat."]
    return found, []


# -- markets


def words_of(label: str) -> list[str]:
    """Words of a market label; a state's code is followed by its name."""
    names = {code.lower(): name for name, code in geography.STATES.items()} | {"nyc": "new york"}
    return [w for t in re.findall("[a-z][a-z']*", (label or "").lower()) for w in (t, *names.get(t, "").split())]


def _without(words: list[str], *dropped: Sequence[str]) -> list[str]:
    return [w for w in words if not any(w in d for d in dropped)]


def readings(label: str, own: list[str]) -> list[tuple[str, str]]:
    """Readings of a label with their kinds, from all its words to the customer with the place alone."""
    base = words_of(label)
    bare = _without(base, own)
    place = lambda w: _without(w, GENERIC, DIRECTIONS)
    kinds = (("raw", base), ("no-customer", bare), ("no-generic", place(base)), ("core", place(bare)), ("customer-prefix", own + bare), ("customer-prefix-core", own + place(bare)))
    return [(" ".join(w), kind) for kind, w in kinds if base and w]


def _basis(c: str, d: str, kinds: tuple[str, str]) -> str:
    if plain(c) == plain(d):
        return EXACT
    if any("customer" in k for k in kinds):
        return CUSTOMER_PREFIX
    if kinds[0] in ("core", "no-generic"):
        return STRIPPED
    total = all(any(w in TOTALS for w in re.findall("[a-z][a-z']*", x.lower())) for x in (c, d))
    return TOTAL if total else FUZZY


def _scorer(own: list[str]) -> Callable[[str, list[str]], tuple[float, int, str]]:
    forms: dict[str, list[tuple[str, str]]] = {}

    def score(c: str, panel: list[str]) -> tuple[float, int, str]:
        best, at, kinds = 0.0, -1, ("", "")
        mine = readings(c, own)
        for k, d in enumerate(panel):
            if best == 100.0:
                break
            if d not in forms:
                forms[d] = readings(d, own)
            for x, kind in mine:
                for y, other in forms[d]:
                    s = fuzzy.token_set_ratio(x, y)
                    if s > best:
                        best, at, kinds = s, k, (kind, other)
        return best, at, _basis(c, panel[at], kinds) if at >= 0 else NONE

    return score


def _is_total(label: str) -> bool:
    return re.search(text.TOTAL_WORDS, label) is not None


def _broadest(labels: list[str]) -> str | None:
    """The total with the fewest words that tell something, then the fewest words; the first on ties."""
    strength = lambda x: (len([w for w in re.findall("[a-z][a-z']*", x.lower()) if len(w) > 1 and not any(w in d for d in (GENERIC, DIRECTIONS, TOTALS))]), len(re.findall("[a-z][a-z']*", x.lower())))
    return min((x for x in labels if _is_total(x)), key=strength, default=None)


def align_labels(spark: SparkSession, client: Sequence[str], panel: Sequence[str], customer: str | None = None) -> Alignment:
    """What each client market is compared with; both lists in order of appearance.

    First the broadest totals of both sides. Then each other client market picks the panel market that is most
    alike in any reading, the first on ties; the most alike claim first, from ENOUGH on, if they share a word of place, with a
    caveat below HIGH; losers don't pick again. At last the panel markets that are left and lie within a client
    market's states, in its part of the state if it names one, are summed for the first client market that has them.
    """
    client, panel = checked(client), checked(panel)
    if not client or not panel:
        return Alignment([(c, None, NONE, 0.0, False, None) for c in client])
    own = words_of(customer or "")
    found, used, warnings = {}, set(), []
    mine, theirs = _broadest(client), _broadest(panel)
    if mine is not None and theirs is not None:
        found[mine] = (mine, theirs, TOTAL, 1.0, False, None)
        used.add(theirs)
    rest = [c for c in client if c not in found]
    best = best_of_all(spark, rest, [d for d in panel if d not in used], _scorer(own))
    core = lambda x: set(_without(words_of(x), own, GENERIC, DIRECTIONS))
    for c in sorted(rest, key=lambda c: -best[c][0]):
        s, d, basis = best[c]
        if d is not None and d not in used and s >= ENOUGH and core(c) & core(d):
            used.add(d)
            found[c] = (c, d, basis, s / 100, s < HIGH, None)
            if s < HIGH:
                warnings.append(f"Client market '{c}' is like panel market '{d}' ({s / 100:.2f}, {basis}); they are compared with a caveat.")
    left_c, left_d = [c for c in rest if c not in found], [d for d in panel if d not in used and not _is_total(d)]
    if left_c and left_d:
        places = {r.label: r for r in geography.expand(spark.createDataFrame([(x,) for x in {*left_c, *left_d}], "label string"), "label").collect()}
        for c in left_c:
            at = places[c]
            parts = sorted(d for d in left_d if d not in used and places[d].states and set(places[d].states) <= set(at.states) and (not at.part_cities or set(at.part_cities) & set(places[d].cities)))
            if parts:
                used.update(parts)
                found[c] = (c, f"{c}  (rollup of: {', '.join(parts)})", GEO, 0.85, True, parts)
                warnings.append(f"Client market '{c}' is compared with the sum of {len(parts)} panel markets within it ({', '.join(parts)}), with a caveat.")
    missing = lambda c: (c, None, NONE, (best.get(c) or (0.0,))[0] / 100, False, None)
    return Alignment([found.get(c) or missing(c) for c in client], warnings)


def align_markets(client: DataFrame, panel: DataFrame, customer: str | None = None) -> DataFrame:
    """(client_market, panel_market, basis, score, caveat, components) of frames with `market` and `position`, its place of appearance (see `align_labels`)."""
    order = lambda df: [r.market for r in df.where("market is not null").groupBy("market").agg({"position": "min"}).orderBy("min(position)", "market").limit(LABELS + 1).collect()]
    return align_labels(client.sparkSession, order(client), order(panel), customer).frame(client.sparkSession)
