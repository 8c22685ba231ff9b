"""Benchmark items shorter than a seed, and spoken addresses with any ending."""

import random

import pytest

from shelfspan.llm import decontaminate, pii


@pytest.mark.parametrize("room", [0, 64 << 20])
def test_short_items_against_brute_force(spark, room):
    """Few different words, so that many places almost agree."""
    rng = random.Random(5)
    say = lambda n: [rng.choice("abc") + "x" for _ in range(n)]
    items = [(k, say(n)) for k, n in enumerate([5, 6, 7, 8] * 3)] + [(90, ["ab"] * 4), (91, []), (92, ["ax"])]
    docs = [(k, say(rng.randint(0, 40))) for k in range(60)]
    docs += [(100 + k, say(3) + g[:2] + ["other"] + g[3:] + say(3)) for k, g in items if len(g) > 4] + [(200, ["ab"] * 4), (201, ["ab"] * 5), (202, ["ax"])]
    want = {}
    for d, h in docs:
        for k, g in items:
            n = len(g)
            if not n or (n < 5 and len(h) != n):
                continue
            for i in range(len(h) - n + 1):
                same = [x == y for x, y in zip(h[i : i + n], g, strict=True)]
                if sum(same) >= n - (n >= 6) and same[0] and same[-1]:
                    want[d, k] = max(want.get((d, k), (0, 0, 0)), (2 * sum(same) - n, -i, n))
    frames = [spark.createDataFrame([(k, " ".join(w)) for k, w in rows], f"{name} long, text string") for name, rows in (("doc_id", docs), ("item_id", items))]
    got = {(r.doc_id, r.item_id): (r.score, -r.start, r.words) for r in decontaminate.leaks(*frames, "doc_id", broadcast_bytes=room).collect()}
    assert got == want
    assert (106, 6) in got and (107, 7) in got  # seven and eight words, one replaced


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("write to john at example dot xyz soon", ["john at example dot xyz"]),
        ("ann_at_mail dot example dot online.", ["ann_at_mail dot example dot online"]),
        ("meet at the dot of noon", []),
        ("stand at red dot of paint, or at it dot com", []),
        ("john at example dot x1", []),
        ("john at example dot" + " a dot" * 3000, []),
    ],
)
def test_any_ending(text, want):
    assert [text[a:b] for a, b, _ in pii.all_spans(text, pii.plain_spans(text))] == want


def test_endings_take_linear_time():
    import time

    for text in ("x at " * 40000 + "dot", "x at a" + " dot a" * 40000, "x at a" + ".a" * 60000 + " dot 1", "a_at_" * 20000):
        start = time.monotonic()
        pii.all_spans(text, pii.plain_spans(text))
        assert time.monotonic() - start < 5
