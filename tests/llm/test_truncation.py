import random

import pytest
from rowtide.llm import truncation as tr

ENDINGS = [
    ("The lever is guided along the drum.", "whole"),
    ("The lever is guided along the dr", "open"),
    ("The lever is guided along […]", "marked"),
    ("The lever is guided along th...", "marked"),
    ("The lever is guided (see Fig. 3). ", "whole"),
    ("The lever is.\n* * * * *", "whole"),
    ("The lever is\n* * * * *", "open"),
    ("The lever is.\nFIG. 4\n- 3 / 9 -\n", "whole"),
    ("The lever is.\n</claims>", "whole"),
    ("The lever is.</claims>", "whole"),
    ("The lever is.\n(a = b·c)", "whole"),
    ("It moves.\nList of reference signs\n10 lever\n12 drum", "whole"),
    ("It moves.\n【符号の説明】\n10 回転子", "whole"),
    ("案内溝が端子に当接する。", "whole"),
    ("案内溝が端子に", "open"),
    ("by gravity, e.g.", "whole"),
    ("It moves.\n4.", "whole"),
    ("a play of less than 0.", "whole"),
    ("returns, and <mi>d</mi><mo>=</mo><", "open"),
    ("He said “go.”", "whole"),
    ("", "whole"),
    (" \n　", "whole"),
    (None, None),
    ("It moves.\n" + "\n".join(f"{i} part" for i in range(10, 500)), "whole"),
    ("It mo" + "\n* * * * *" * 40, "open"),
]


def test_endings(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(ENDINGS)], "i int, text string")
    got = {r.i: r.ending for r in tr.with_ending(df).collect()}
    assert [(i, t, got[i]) for i, (t, e) in enumerate(ENDINGS) if got[i] != e] == []


def corpus(n=4000):
    rnd = random.Random(5)
    rows, cut = [], set()
    for i in range(n):
        words = " ".join(rnd.choice(["lever", "drum", "the", "is", "guided", "along"]) for _ in range(rnd.randint(20, 400)))
        text = words + "."
        if i % 4 == 0 and len(text) > 1200:
            text = text[:1200]
            cut.add(i)
        rows.append((i, text, "A " if i % 2 == 0 else "b", i))
    return rows, cut


def test_limit_is_found_and_decides(spark):
    rows, cut = corpus()
    rows.append((90_003, "z" * 1199 + ".", "a", 1))
    # one seeming break-off in thousands is one of misreading
    rows.append((90_004, "a heading without an end", "b", 1))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, source_2 int")
    limits = {(r.source, r.unit, r.length) for r in tr.limits(tr.measured(df)).collect()}
    assert ("a", "chars", 1200) in limits
    assert not {x for x in limits if x[0] == "b"}
    found = {r.doc_id: r for r in tr.truncated(df).collect()}
    assert set(found) == {i for i in cut if not rows[i][1].endswith(".")} and all(r.at_limit for r in found.values())
    rate = {r.source: r for r in tr.rates(df).collect()}
    assert rate["b"].truncated == 0 and rate["a"].truncated == len(found)
    # without the limit there is nothing that carries them
    assert tr.truncated(df.where("source = 'b' or length(text) <> 1200")).count() == 0


def test_break_offs_without_a_limit(spark):
    rnd = random.Random(3)
    words = lambda n: " ".join(rnd.choice(["lever", "drum", "the", "is"]) for _ in range(n))
    rows, cut = [], set()
    for i in range(3000):
        source, text = ("often", "never", "long")[i % 3], words(rnd.randint(10, 300)) + "."
        broken = rnd.random() < 0.05 and (source == "often" or source == "long" and len(text) > 1024)
        if broken or i in (4, 7):
            text = text[: rnd.randint(1025 if source == "long" else 20, len(text) - 1) if broken else len(text) - 1]
        if broken:
            cut.add(i)
        rows.append((i, text, source))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    found = {r.doc_id for r in tr.truncated(df).collect()}
    assert found == cut
    m = tr.measured(df)
    at = {(r.source, r.span) for r in tr.break_offs(m, m.where("ending = 'open'")).where("significant").collect()}
    assert {s for s, _ in at} == {"often", "long"}


def test_many_whole_texts_of_one_length_are_no_limit(spark):
    rows = [(i, ("w" * 99 + ".") if i < 300 else "v" * (50 + i % 400) + ".", "s") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    h = tr.hazards(tr.measured(df))
    assert h.where("unit = 'chars' and length = 100").first().n >= 300 and not h.where("significant").count()
    assert tr.limits(tr.measured(df)).count() == 0
    assert tr.truncated(df).count() == 0


def test_no_false_discoveries_without_limits(spark):
    rnd = random.Random(1)
    rows = [(i, "w" * (100 + int(rnd.expovariate(1 / 600))), "s") for i in range(5000)]
    # all of them are broken off, but none at a limit
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    assert tr.hazards(tr.measured(df)).where("significant").count() == 0


def test_empty_null_and_repeated(spark):
    schema = "doc_id bigint, text string, source string"
    empty = spark.createDataFrame([], schema)
    assert tr.truncated(empty).count() == 0 and tr.rates(empty).count() == 0
    rows = [(1, None, None), (2, "", "a")] + [(3, "cut he", None)] * 3 + [(4, "漢" * 300_000, "a"), (5, "漢" * 400_000, "a"), (6, "漢字" * 100_000 + "。", "a"), (7, "漢" * 500_000, "a")]
    df = spark.createDataFrame(rows, schema)
    assert sorted(r.doc_id for r in tr.truncated(df).collect()) == [3, 3, 3, 4, 5, 7]
    rate = {r.source: (r.documents, r.truncated) for r in tr.rates(df).collect()}
    assert rate == {None: (4, 3), "a": (5, 3)}


def test_poisson_tail():
    import pandas as pd

    got = tr._poisson_tail(pd.Series([0, 1, 3, 100]), pd.Series([2.0, 2.0, 2.0, 0.5]))
    assert got.tolist()[:3] == pytest.approx([1.0, 0.8646647, 0.3233236], abs=1e-6)
    assert got[3] < 1e-100


def test_measures_ignore_broken_characters(spark):
    df = spark.createDataFrame([(1, "ab�", "s")], "doc_id bigint, text string, source string")
    r = tr.measured(df).first()
    assert (r.chars, r.bytes) == (2, 2)


def test_endings_equal_their_sql(spark):
    import os

    from compare import connect, duck_rows, spark_rows
    from rowtide.llm import queries

    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("no test tables here")
    for name in ("p8_endings", "p8_lengths"):
        assert spark_rows(queries.QUERIES[name](spark, sf)) == duck_rows(connect(sf), queries.SQL[name])
