from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from rowtide.llm import packing, tokens


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=200), st.just(40))
def test_patterns_hold_every_item_and_fit(items, capacity):
    patterns = packing.pack_histogram(Counter(items), capacity)
    placed = Counter()
    for p, n in patterns:
        assert sum(k * v for k, v in p.items()) <= capacity
        for k, v in p.items():
            placed[k] += v * n
    assert placed == Counter(items)
    # any two containers are together fuller than one, but for what new containers needed
    used = sum(n for _, n in patterns)
    assert used <= 2 * -(-sum(items) // capacity) + 1


def test_histogram_refuses_what_does_not_fit():
    with pytest.raises(ValueError):
        packing.pack_histogram({41: 1}, 40)
    assert packing.pack_histogram({}, 40) == []


def test_pack_places_every_piece(spark):
    sizes = [(i, s) for i, s in enumerate([0, 0, 5, 10, 10, 10, 3, 25, 7, 40, 41, None, 20, 10, 1] * 20)] + [(2, 5)]
    df = spark.createDataFrame(sizes, "doc_id bigint, tokens bigint")
    caps = {1: 10, 2: 40}
    out = packing.pack(df, caps).collect()
    for kind, cap in caps.items():
        own = [r for r in out if r.container_kind == kind]
        assert {r.doc_id for r in own if r.container_id is None} == {i for i, s in sizes if s is None}
        load, parts = Counter(), {}
        for r in own:
            if r.container_id is not None:
                load[r.container_id] += r.length
                parts.setdefault(r.doc_id, []).append((r.piece, r.start, r.length))
        assert max(load.values()) <= cap
        assert sorted(load) == list(range(len(load)))
        for i, s in dict(sizes).items():
            if s is None:
                continue
            got = sorted(parts[i])
            once = got[:: 2 if i == 2 else 1]
            assert sum(n for *_, n in once) == s
            assert len(once) == max(1, -(-s // cap))
            assert [b for _, b, _ in once] == [k * cap for k in range(len(once))]
        assert len(load) <= 1.2 * -(-sum(s or 0 for _, s in sizes) // cap)


def test_pack_empty_and_all_blank(spark):
    empty = spark.createDataFrame([], "doc_id bigint, tokens bigint")
    assert packing.pack(empty, {1: 10}).count() == 0
    blank = spark.createDataFrame([(1, 0), (2, 0)], "doc_id bigint, tokens bigint")
    assert {r.container_id for r in packing.pack(blank, {1: 10}).collect()} == {0}


def test_usage(spark):
    df = spark.createDataFrame([(1, 6), (2, 4), (3, 5)], "doc_id bigint, tokens bigint")
    u = packing.usage(packing.pack(df, {1: 10}), {1: 10}).first()
    assert (u.containers, u.tokens, u.fullest, u.used) == (2, 15, 9, 0.75)


def test_tokens_decode_to_the_text(spark):
    texts = ["", "Hello world", "係止機構 弾性片", "a" * 50_000, " \n\t x", None, "it's <|endoftext|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("*", "1 AS extra")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df).collect()}
    e = tokens.encoder()
    for i, t in enumerate(texts):
        assert got[i] == (None if t is None else len(e.encode_ordinary(t)))
        if t is not None:
            assert e.decode(e.encode_ordinary(t)) == t
