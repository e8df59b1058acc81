"""Targets, draws and the mix itself."""

import random
from collections import Counter, defaultdict

import pytest

from ledgerflow.llm.mixing import mix, repeat

from oracle import equal

COLS = "doc_id long, text string, source string, cell long, key string"


def brute_targets(sizes, share, cap, weights):
    """Water-filling step by step."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed = share * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        if not free:
            return fixed
        level = (total - sum(fixed.values())) / sum(w[s] for s in free)
        over = [s for s in free if cap * sizes[s] < level * w[s]]
        if not over:
            return fixed | {s: level * w[s] for s in free}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(3)
    sources = ["a"] * 60 + ["b"] * 8 + [None] * 10 + ["Z"] * 20 + ["é"] * 5 + ["empty"]
    out = [(i, " ".join("w" * rnd.randint(1, 4) for _ in range(rnd.randint(0, 80))), s, 1, "x")
           for i, s in enumerate(sources)]
    out += [(500, None, "a", 1, "x"), (None, "no id here", "b", 1, "x"), (501, " \t\n", "empty", 1, "x")]
    out += [(502, "one\x0btwo\x85three word", "b", 1, "x")] * 2
    return [(d, "" if s == "empty" and t else t, s, a, b) for d, t, s, a, b in out]


@pytest.mark.parametrize("share,weights", [(1.5, (3, 1, 2)), (0.4, (1,)), (2.0, (1, 5)), (7.0, (1, 1, 9))])
def test_targets_and_draws(spark, rows, share, weights):
    df = spark.createDataFrame(rows, COLS)
    got, plan = mix(df, share=share, weights=weights)
    got = got.collect()
    words = lambda t: len((t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")) - \
        (t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ").count("")
    sizes, biggest = defaultdict(int), defaultdict(int)
    for d, t, s, *_ in rows:
        sizes[s] += words(t)
        biggest[s] = max(biggest[s], words(t))
    want = brute_targets(sizes, share, 2.0, weights)
    source = {d: s for d, t, s, *_ in rows}
    taken = defaultdict(int)
    assert len(got) == len(rows)
    for r in got:
        s = source[r.doc_id]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s])
        assert r.taken == r.size * r.copies <= 2 * r.size
        taken[s] += r.taken
    for s in sizes:
        assert abs(taken[s] - want[s]) <= biggest[s]
    again = mix(df, share=share, weights=weights)[0].collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    mixed = repeat(df, plan)
    assert mixed.columns == df.columns
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({k: n for k, n in _times(got).items() if n})


def _times(rows):
    n = Counter()
    for r in rows:
        n[r.doc_id] += r.copies
    return n


def test_empty(spark):
    rows, plan = mix(spark.createDataFrame([], COLS))
    assert rows.count() == 0 and plan.count() == 0


def test_query(spark):
    ok, why = equal(spark, "op7_source_mix", "/root/testdata/sf0.001")
    assert ok, why
