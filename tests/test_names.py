"""The name join against all pairs, the batch scorer against the plain one, and how few candidates there are."""

from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomgraph.functions.similarity import codes_of, jaro_winkler_batch, jaro_winkler_pair
from loomgraph.operators import names

FIRST = "anna boris clara dmitri elena fedor galina hugo irina jakob karin leon maria nikolai olga pavel quentin rosa stefan tatiana ulrich vera wanda xenia yuri zoe".split()
SYLLABLES = "ba ke li mo nu ra si to va we za chi dro fel gri hal jen kor lan mir nov pet ros sol tur vin".split()


def people(seed, n):
    r = random.Random(seed)
    out = set()
    while len(out) < n:
        out.add(f"{r.choice(FIRST)} {''.join(r.choice(SYLLABLES) for _ in range(r.randint(2, 4)))}")
    return sorted(out)


def spoiled(r, name):
    c = list(name)
    for _ in range(r.randint(1, 3)):
        k = r.randrange(len(c))
        kind = r.random()
        if kind < 0.3 and len(c) > 2:
            del c[k]
        elif kind < 0.6:
            c.insert(k, r.choice("aeioukm"))
        elif k:
            c[k - 1], c[k] = c[k], c[k - 1]
    return "".join(c)


TEXT = st.text(alphabet="abcdé 中", max_size=14)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.none(), TEXT), st.one_of(st.none(), TEXT)), max_size=30))
def test_batch_scorer(pairs):
    got = jaro_winkler_batch([a for a, _ in pairs], [b for _, b in pairs], cells=40)
    wanted = [np.nan if a is None or b is None else jaro_winkler_pair(a, b) for a, b in pairs]
    assert got == pytest.approx(wanted, abs=1e-12, nan_ok=True)


@settings(max_examples=400, deadline=None)
@given(TEXT, TEXT, st.sampled_from([0.72, 0.8, 0.9, 0.97, 1.0]))
def test_alike_texts_reach_the_bound(a, b, least):
    if a and b and jaro_winkler_pair(a, b) >= least:
        assert names.can_meet(least, len(a), len(b))
        assert len(names.bounded(codes_of([a], len(a)), codes_of([b], len(b)), least)[0]) == 1


@pytest.mark.parametrize("least", [0.75, 0.8, 0.9])
def test_same_as_all_pairs(spark, least):
    r = random.Random(5)
    base = people(6, 60)
    texts = base + [spoiled(r, x) for x in base for _ in range(2)] + ["a", "ab", "ba", "aa", "aaaa", "aaab", "", None, "中文字", "中字文", "the the the", "the teh the", "x" * 60, "x" * 59 + "y"]
    other = texts[::2] + ["zz", "abc"]
    left, right = (spark.createDataFrame([(t,) for t in x], f"{c} string") for x, c in ((texts, "a"), (other, "b")))
    got = {(x["a"], x["b"]): x["similarity"] for x in names.alike(left, right, least).collect()}
    wanted = {(a, b): s for a in set(texts) if a for b in set(other) if b for s in [jaro_winkler_pair(a, b)] if s >= least - 1e-9}
    assert got.keys() == wanted.keys() and got == pytest.approx(wanted, abs=1e-9)


def test_few_candidates():
    """Under one pair in a hundred is scored, though a third of the names begin alike."""
    everyone = people(7, 4000)
    everyone = [f"the {x}" if k % 3 == 0 else x for k, x in enumerate(everyone)]
    by = defaultdict(list)
    for x in everyone:
        by[len(x)].append(x)
    scored = sum(len(names.bounded(codes_of(a, n), codes_of(b, m), 0.9)[0]) for n, a in by.items() for m, b in by.items() if names.can_meet(0.9, n, m))
    assert scored < 0.01 * len(everyone) ** 2


def test_many_names(spark):
    """Several blocks of each length; every spoiled name finds its origin."""
    r = random.Random(8)
    base = people(9, 6000)
    rows = spark.createDataFrame([(x,) for x in base], "a string")
    asked = {x: spoiled(r, x) for x in base[::20]}
    queries = spark.createDataFrame([(x,) for x in asked.values()], "b string")
    got = {(x["a"], x["b"]) for x in names.alike(rows, queries, 0.9, block=100).collect()}
    assert got == {(a, b) for a in base for b in set(asked.values()) if jaro_winkler_pair(a, b) >= 0.9 - 1e-9}


def test_threshold_must_exceed_the_boost():
    with pytest.raises(ValueError, match="over 0.7"):
        names.alike(None, None, 0.7)
