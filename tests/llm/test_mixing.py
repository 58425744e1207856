import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rowtide.llm import mixing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0, 1)), max_size=60), st.integers(0, 9))
def test_pivot_keeps_the_sum_and_leaves_one(items, seed):
    w = np.array([a for a, _ in items], float)
    m = w * np.array([p for _, p in items], float)
    before = m.sum()
    left = mixing.pivot(w, m, np.random.default_rng(seed))
    assert m.sum() == pytest.approx(before, abs=1e-4)
    open_ = [i for i in range(len(m)) if 1e-6 * w[i] < m[i] < w[i] * (1 - 1e-6)]
    assert len(open_) <= 1
    assert open_ == ([left] if left is not None else []) or not open_


def test_pivot_keeps_expectations():
    w = np.array([3.0, 5.0, 2.0, 7.0])
    p = np.array([0.2, 0.5, 0.9, 0.4])
    total = np.zeros(4)
    for s in range(4000):
        m = w * p
        mixing.pivot(w, m, np.random.default_rng(s))
        total += m / w
    assert np.abs(total / 4000 - p).max() < 0.04


def docs(spark, n=3000):
    rows = [(i, "Big" if i % 3 else " small ", 1 + i % 50) for i in range(n)]
    rows += [(n, None, 9), (n + 1, "big", None), (n + 2, "BIG ", 0), (n + 3, "other", 5)]
    return spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")


def test_shares_are_reached(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LEAF", 100)
    monkeypatch.setattr(mixing, "FAN", 4)
    t = spark.createDataFrame([(1, "big", 0.5, 2), (1, "small", 0.5, 3), (2, "BIG", 0.3, 1), (2, "small", 0.7, None), (2, "gone", 0.0, 1)], "mix_id int, source string, target_share double, max_repeats int")
    out = mixing.mix(docs(spark), t).cache()
    s = {(r.mix_id, r.source): r for r in mixing.shares(out, t).collect()}
    assert abs(s[1, "BIG"].actual_share - 0.5) < 0.002 and abs(s[1, "SMALL"].actual_share - 0.5) < 0.002
    assert s[1, "SMALL"].most_copies <= 3 and s[1, "BIG"].most_copies <= 2
    assert abs(s[2, "BIG"].actual_share - 0.3) < 0.002 and s[2, "BIG"].most_copies == 1
    assert s[2, "GONE"].tokens == 0
    ids = [(r.mix_id, r.doc_id) for r in out.collect()]
    assert len(ids) == len(set(ids))
    assert not {3000, 3001, 3002, 3003} & {i for _, i in ids}
    # the mix is as large as its caps allow: all of the limiting source
    big = sum(r.tokens for r in docs(spark).collect() if r.source and r.source.strip().lower() == "big" and r.tokens)
    assert abs(s[2, "BIG"].tokens - big) <= 50


def test_same_seed_same_mix(spark):
    t = spark.createDataFrame([(1, "big", 0.1, 1), (1, "small", 0.9, 1)], "mix_id int, source string, target_share double, max_repeats int")
    one, two = (sorted(map(tuple, mixing.mix(docs(spark), t, seed=3).collect())) for _ in range(2))
    assert one == two


def test_sources_without_texts(spark):
    t = spark.createDataFrame([(1, "big", 0.5, 1), (1, "nowhere", 0.5, 1)], "mix_id int, source string, target_share double, max_repeats int")
    out = mixing.mix(docs(spark), t)
    assert {r.source for r in out.collect()} == {"BIG"}
    none = docs(spark).limit(0)
    assert mixing.mix(none, t).count() == 0
    assert {r.actual_share for r in mixing.shares(mixing.mix(none, t), t).collect()} == {None}


def test_a_cap_of_zero_takes_out_one_source_only(spark):
    rows = [(i, ("a", "b", "c")[i % 3], 10 + i % 7) for i in range(3000)]
    sizes = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([(1, "a", 0.4, 0), (1, "b", 0.4, 2), (1, "c", 0.2, None)], "mix_id int, source string, target_share double, max_repeats int")
    mixed = mixing.mix(sizes, targets)
    got = {r.source: r for r in mixing.shares(mixed, targets).collect()}
    assert got["A"].tokens == 0 and got["B"].most_copies == 2
    assert abs(got["B"].tokens / (got["B"].tokens + got["C"].tokens) - 2 / 3) < 0.001
