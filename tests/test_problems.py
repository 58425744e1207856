import random
import struct
import zlib
from collections import Counter
from datetime import datetime
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from rowtide.functions import canon
from rowtide.operators import cdc, compaction, manifest_diff, ordered, references, selection, skew
from rowtide.queries import problems

T0 = datetime(2025, 1, 1)


def t(n):
    return None if n is None else datetime(2025, 1, 1 + n // 24, n % 24)


@pytest.fixture
def hot(monkeypatch):
    """Makes small inputs count as skewed."""
    monkeypatch.setattr(skew, "ROWS", 5)
    monkeypatch.setattr(compaction, "FRAME_ROWS", 5)
    monkeypatch.setattr(selection, "BROADCAST_ROWS", 0)


def test_canonical_spellings(spark):
    rows = [(" 0A ", "S3A:///b//c///d ", " +i"), (None, None, None), ("", "s3://b/c", "x"), ("0b", "s3:/b/c", ""), ("0b", "/b//c", "")]
    df = spark.createDataFrame(rows, "k string, p string, o string")
    got = df.select(canon.partition_key("k"), canon.file_path("p"), canon.label("o")).collect()
    assert [tuple(r) for r in got] == [("0a", "s3://b/c/d", "+I"), ("", None, None), ("", "s3://b/c", "X"), ("0b", "s3://b/c", ""), ("0b", "/b/c", "")]
    ids = spark.createDataFrame([([3, 1, 3],), (None,), ([],)], "i array<int>").select(canon.id_set("i")).collect()
    assert [r[0] for r in ids] == [[1, 3], None, []]


def test_hot_keys_come_from_counts(spark, monkeypatch):
    """A key of a third and one of a 300th of all rows are both split, and no piece of any key is over the bound."""
    monkeypatch.setattr(skew, "ROWS", 500)
    df = spark.range(300_000).select(F.when(F.col("id") % 3 == 0, -1).when(F.col("id") % 300 == 1, -2).otherwise(F.col("id")).alias("k"), "id")
    hot = skew.hot_keys(df, ["k"])
    of = {r.k: r.h for r in spark.createDataFrame([(-1,), (-2,)], "k bigint").select("k", skew.key_hash(["k"]).alias("h")).collect()}
    assert hot.by_pieces == {256: [of[-1]], 2: [of[-2]]}
    split = df.groupBy("k", skew.piece(["k"], ["id"], hot).alias("p")).count()
    most = {r.k: (r.n, r.most) for r in split.where("k < 0").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.max("count").alias("most")).collect()}
    assert most[-1][0] == 256 and most[-2][0] == 2 and most[-1][1] < 500 * 1.2 and most[-2][1] < 600
    assert split.where("k >= 0 and p <> 0").count() == 0
    every = spark.createDataFrame([(-1, "a"), (-2, "b"), (5, "c"), (6, "d")], "k bigint, name string")
    for how in ("inner", "left", "left_semi"):
        assert sorted(map(tuple, skew.join(df, every, ["k"], ["id"], how).groupBy("k").count().collect()), key=str) == sorted(map(tuple, df.join(every, "k", how).groupBy("k").count().collect()), key=str)
    assert not skew.hot_keys(df.limit(0), ["k"]) and not skew.hot_keys(df.where("k >= 0"), ["k"])


# -- ordered lookups


@pytest.mark.parametrize("block", [1, 3, 4096])
def test_next_bound(spark, block):
    rnd = random.Random(3)
    points = [(rnd.choice([1, 2, None]), rnd.choice([None, *range(40)])) for _ in range(200)]
    bounds = [(rnd.choice([1, 2, 3]), rnd.randrange(60), i) for i in range(15)]
    got = ordered.next_bound(spark.createDataFrame(points, "g int, o bigint").withColumn("x", F.lit(1)), spark.createDataFrame(bounds, "g int, o bigint, x int"), ["g"], "o", ["x"], block)
    got = {(r.g, r.o): (r.bound_o, r.x) for r in got.collect() if r.bound_o is not None}
    want = {}
    for g, o in points:
        later = [(b, x) for h, b, x in bounds if h == g and o is not None and b >= o]
        if later:
            first = min(b for b, _ in later)
            want[g, o] = (first, max(x for b, x in later if b == first))
    assert got == want


def test_row_positions(spark):
    rnd = random.Random(1)
    ids = rnd.sample(range(10_000), 300)
    rows = [(None if i % 3 == 0 else i % 2, i) for i in ids]
    got = ordered.row_positions(spark.createDataFrame(rows, "g int, i bigint"), ["g"], "i", block=97).collect()
    for g in (None, 0, 1):
        own = sorted((r for r in got if r.g == g), key=lambda r: r.i)
        assert [r.pos for r in own] == list(range(len(own)))
    assert ordered.row_positions(spark.createDataFrame([], "g int, i bigint"), ["g"], "i").count() == 0


# -- 1


def service(spark, data=(), deletes=(), units=(), snapshots=()):
    d = spark.createDataFrame(list(data), "file_id bigint, table_id bigint, data_file_path string, data_sequence_number bigint, added_snapshot_id bigint, record_count bigint, removed_at timestamp, kind string")
    e = spark.createDataFrame(list(deletes), "file_id bigint, table_id bigint, content string, file_format string, file_path string, equality_ids array<int>, referenced_data_file string, data_sequence_number bigint, added_snapshot_id bigint, record_count bigint, removed_at timestamp")
    tables = spark.createDataFrame([(1, [1, 2]), (2, None)], "table_id bigint, pk_field_ids array<int>")
    u = spark.createDataFrame(list(units), "unit_id bigint, table_id bigint, kind string, max_seq bigint, starting_snapshot_id bigint, attempt int, status string, logged_at timestamp")
    s = spark.createDataFrame(list(snapshots), "table_id bigint, snapshot_id bigint, sequence_number bigint")
    return d, e, tables, u, s


def test_pending_files(spark):
    data = [
        (1, 1, "a", 1, 10, 5, None, "x"), (2, 1, "b", 2, 20, 5, None, "x"), (3, 1, "c", 3, 30, 5, None, "x"),
        (4, 1, "d", 1, 30, 5, None, "x"),  # came too late for the unit that would have taken it
        (5, 1, "e", 9, 30, 5, None, "x"), (5, 1, "e", 9, 30, None, T0, "x"),  # one listing says removed
        (6, 1, "f", None, 10, 5, None, "x"), (7, 1, "g", 1, 99, 5, None, "x"), (8, None, "h", 1, 10, 5, None, "x"),
    ]
    deletes = [
        (11, 1, "equality_deletes ", "PARQUET", "p", [2, 1, 1], None, 2, 20, 3, None), (12, 1, "EQUALITY_DELETES", "PARQUET", "q", [1], None, 2, 20, 3, None),
        (13, 1, "EQUALITY_DELETES", "PARQUET", "r", [1, 2], None, 3, 30, 3, None), (14, 2, "EQUALITY_DELETES", "PARQUET", "s", [1], None, 3, 30, 3, None), (15, 1, "POSITION_DELETES", "PARQUET", "s", None, "a", 3, 30, 3, None),
    ]
    units = [
        (1, 1, "DATA", 1, 10, 1, "Running", t(0)), (1, 1, "DATA", 1, 10, 1, " committed", t(1)), (2, 1, "EQ_DEL", 2, 20, 1, "COMMITTED", t(2)),
        (3, 1, "DATA", 2, 20, 1, "COMMITTED", t(3)), (3, 1, "DATA", 2, 20, 2, "ROLLED_BACK", t(4)), (4, 1, "DATA", 3, 30, 1, "FAILED", t(5)),
    ]
    args = service(spark, data, deletes, units, [(1, 10, 1), (1, 10, 1), (1, 20, 2), (1, 30, 3)])
    assert sorted(r.file_id for r in manifest_diff.pending(*args).collect()) == [2, 3, 4, 6, 7, 8, 13]
    assert manifest_diff.pending(*service(spark)).count() == 0
    # nothing committed: everything is pending
    d, e, tb, u, s = args
    assert manifest_diff.pending(d, e, tb, u.limit(0), s).count() == 9


def test_diff_of_manifests(spark):
    m = lambda *rows: spark.createDataFrame(list(rows), "table_id bigint, file_id bigint, record_count bigint, change string")
    v = lambda *rows: spark.createDataFrame(list(rows), "table_id bigint, file_id bigint, deleted bigint")
    older, newer = m((1, 1, 10, ""), (1, 2, 10, ""), (1, 3, 10, "")), m((1, 2, 10, ""), (1, 2, 10, ""), (1, 3, 10, ""), (1, 4, 7, ""), (1, 5, None, ""))
    out = manifest_diff.diff(older, newer, v((1, 1, 2), (1, 3, 5)), v((1, 2, 4), (1, 3, 1), (1, 4, 1), (9, 9, 9)))
    got = sorted(tuple(r) for r in out.collect())
    assert got == [(1, 1, "REMOVED", 0, 8), (1, 2, "CHANGED", 0, 4), (1, 3, "CHANGED", 4, 0), (1, 4, "ADDED", 6, 0), (1, 5, "ADDED", None, 0)]
    assert manifest_diff.diff(older, older).count() == 0


def test_deltas_since_count_no_vector_twice(spark):
    data = [(1, 1, "a", 1, 10, 10, None, "x"), (2, 1, "b", 1, 10, 10, None, "x"), (3, 1, "c", 1, 10, 10, t(9), "x"), (4, 1, "d", 4, 40, 10, None, "x")]
    dv = lambda i, of, seq, snap, n, gone=None: (i, 1, "POSITION_DELETES", "PUFFIN", f"v{i}", None, of, seq, snap, n, gone)
    # a: as it was; b: 2 grew to 5 after the processed version; c: 3 were deleted before the file went, with its vector; d: new
    deletes = [dv(11, "a", 2, 20, 4), dv(12, "b", 2, 20, 2, t(8)), dv(13, "b", 4, 40, 5), dv(14, "c", 2, 20, 3, t(9)), dv(15, "d", 4, 40, 1)]
    units = [(1, 1, "DATA", 1, 10, 1, "COMMITTED", t(1)), (2, 1, "DATA", 2, 20, 1, "COMMITTED", t(3))]
    d, e, tables, u, _ = service(spark, data, deletes, units)
    s = spark.createDataFrame([(1, 10, 1, t(0)), (1, 20, 2, t(2)), (1, 20, 2, t(2)), (1, 40, 4, t(8))], "table_id bigint, snapshot_id bigint, sequence_number bigint, committed_at timestamp")
    got = sorted(tuple(r) for r in manifest_diff.version_deltas(d, e, tables, u, s, since=True).collect())
    assert got == [(1, "ADDED", 1, 9, 0), (1, "CHANGED", 1, 0, 3), (1, "REMOVED", 1, 0, 7)]


# -- 2


def test_planned_outputs_are_near_the_target(spark):
    rnd = random.Random(2)
    rows = [(i, "hot" if i % 3 else f"g{i % 40}", rnd.randrange(0, 490), 1000) for i in range(4000)] + [(9000, "single", 5, 1000), (9001, None, 0, 1000), (9002, None, 0, 1000)]
    out = compaction.plan_outputs(spark.createDataFrame(rows, "file_id bigint, g string, size bigint, target bigint"), ["g"], "size", "target").collect()
    assert sorted(r.file_id for r in out) == sorted(r[0] for r in rows if r[1] != "single")
    loads = Counter()
    for r in out:
        loads[r.g, r.out_no] += r.size
    big = [n for (g, _), n in loads.items() if g == "hot"]
    assert len(big) == round(sum(big) / 1000) and 500 <= min(big) and max(big) <= 1500


def test_frames_join_byte_for_byte():
    import zstandard

    c = zstandard.ZstdCompressor(write_checksum=True)
    parts = [c.compress(x) for x in (b"", b"a\n", b"x" * 500_000, bytes(range(256)) * 3000)]
    parts.append(zstandard.ZstdCompressor(write_content_size=False).compress(b"zz"))
    parts.append(struct.pack("<II", 0x184D2A50, 3) + b"abc")
    whole = compaction.join_frames(parts)
    assert whole == b"".join(parts)
    got = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True)
    assert got.decompress(whole) == b"a\n" + b"x" * 500_000 + bytes(range(256)) * 3000 + b"zz"
    for bad in (parts[2][:-1], parts[2][:20], b"plain", parts[2][:3], parts[1] + b"\0"):
        with pytest.raises(ValueError):
            compaction.join_frames([bad])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.text("ab ", max_size=4), max_size=4), max_size=5), st.booleans())
def test_lines_join_without_parsing(files, ended):
    parts = ["\n".join(["head", *f]).encode() + (b"\n" if ended else b"") for f in files]
    out = compaction.join_lines(parts, 1).decode()
    want = []
    for p in parts:
        lines = p.decode().split("\n")
        want += (lines[:-1] if lines[-1] == "" else lines)[1:]
    assert out == ("".join(x + "\n" for x in ["head", *want]) if parts else "")


def test_lines_with_other_headers_are_refused():
    with pytest.raises(ValueError):
        compaction.join_lines([b"a\n1\n", b"b\n2\n"], 1)
    assert compaction.join_lines([b"a\n1", b"", b"a", b"a\n2\n"], 1) == b"a\n1\n2\n"


def test_compacted_deletes_round_trip(spark, hot):
    import json

    import zstandard

    files = [(i, 1, "POSITION_DELETES" if i % 5 == 4 else "EQUALITY_DELETES", "PARQUET", 0, " 0A" if i % 2 else "0a", f"s3a://b//f{i}", [1], None if i % 5 != 4 else "d", 3, 300 + i, None) for i in range(40)]
    files += [(90, 1, "EQUALITY_DELETES", "PARQUET", 0, "0a", "big", [1], None, 3, 9000, None), (91, 1, "EQUALITY_DELETES", "PARQUET", 0, "0a", "gone", [1], None, 3, 10, T0), (92, 1, "EQUALITY_DELETES", "PARQUET", 7, "0a", "alone", [1], None, 3, 10, None), (93, 1, "POSITION_DELETES", "PUFFIN", 0, "0a", "dv", None, "d", 3, 10, None), (94, 1, "EQUALITY_DELETES", "PARQUET", 0, "0a", "nosize", [1], None, 3, None, None)]
    f = spark.createDataFrame(files, "file_id bigint, table_id bigint, content string, file_format string, spec_id int, partition_key string, file_path string, equality_ids array<int>, referenced_data_file string, record_count bigint, file_size_in_bytes bigint, removed_at timestamp")
    rows, n = [], 0
    for i in range(40):
        for k in range(i % 4 + (60 if i == 7 else 0)):
            n += 1
            rows += [(n, 1, f"s3://b/f{i}", 0, "0A ", f"{k % 2:02X}")] * (1 + n % 2)
    r = spark.createDataFrame(rows, "row_id bigint, table_id bigint, file_path string, spec_id int, partition_key string, pk string")
    tables = spark.createDataFrame([(1, 2000)], "table_id bigint, target_delete_file_bytes bigint")
    out = compaction.compact_delete_files(f, r, tables).collect()
    assert {m.file_id for o in out for m in o.members} == set(range(40))
    got, stated = Counter(), Counter()
    for o in out:
        assert sum(m.length for m in o.members) == o.bytes == len(o.payload)
        for m in o.members:
            text = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(o.payload[m.offset : m.offset + m.length])).decode()
            for line in text.splitlines():
                x = json.loads(line)
                if "record_count" in x:
                    stated[m.file_id] += x["record_count"]
                else:
                    got[m.file_id, x["pk"]] += 1
    assert stated == Counter({i: 3 for i in range(40)})
    once = {x[0]: (int(x[2].rsplit("f", 1)[1]), x[5].lower()) for x in rows}
    assert got == Counter(once.values())
    assert sum(o.records for o in out) == 120
    assert compaction.compact_delete_files(f.limit(0), r, tables).count() == 0


@pytest.mark.parametrize("kind", ["zstd", "lines"])
def test_real_files(spark, tmp_path, kind):
    import zstandard

    listing = []
    for i in range(30):
        data = b"id,v\n" + b"".join(b"%d,%d\n" % (i, k) for k in range(i))
        data = b"" if i == 3 else data[:-1] if i == 5 else data
        if kind == "zstd" and data:
            data = zstandard.compress(data)
        p = tmp_path / f"in{i}"
        p.write_bytes(data)
        listing.append((str(p), len(data)))
    df = spark.createDataFrame(listing, "path string, length bigint")
    stale = compaction.compact_paths(spark, df, str(tmp_path / "out"), kind, 1, 100).collect()
    out = compaction.compact_paths(spark, df, str(tmp_path / "out"), kind, 1, 300).collect()
    assert len(stale) > len(out) and not {o.out_path for o in stale} & {o.out_path for o in out}
    assert all(sum(m.length for m in o.members) == o.bytes for o in out)
    crcs = [(p, n, zlib.crc32(open(p, "rb").read()) + (p.endswith("in7") and 1)) for p, n in listing]
    with pytest.raises(Exception, match="checksum differs from the listed"):
        compaction.compact_paths(spark, spark.createDataFrame(crcs, "path string, length bigint, crc bigint"), str(tmp_path / "out"), kind, 1, 300)
    assert 1 < len(out) < 15 and sum(o.files for o in out) == 29
    lines = Counter()
    for o in out:
        data = open(o.out_path, "rb").read()
        assert len(data) == o.bytes
        if kind == "zstd":
            data = zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(data)
        lines.update(x for x in data.decode().replace("id,v", "\nid,v\n").split("\n") if x and x != "id,v")
    assert lines == Counter(f"{i},{k}" for i in range(30) if i != 3 for k in range(i))


def test_deletes_without_row_id_are_all_kept(spark):
    import json

    import zstandard

    f = spark.createDataFrame([(i, 1, "EQUALITY_DELETES", "PARQUET", 0, "0a", f"f{i}", [1], None, 3, 300, None) for i in range(2)], "file_id bigint, table_id bigint, content string, file_format string, spec_id int, partition_key string, file_path string, equality_ids array<int>, referenced_data_file string, record_count bigint, file_size_in_bytes bigint, removed_at timestamp")
    rows = [(None, 1, "f0", 0, "0a", "01"), (None, 1, "f0", 0, "0a", "02"), (None, 1, "f0", 0, "0a", "02"), (7, 1, "f0", 0, "0a", "03"), (7, 1, "f0", 0, "0a", "03")]
    r = spark.createDataFrame(rows, "row_id bigint, table_id bigint, file_path string, spec_id int, partition_key string, pk string")
    out = compaction.compact_delete_files(f, r, spark.createDataFrame([(1, 2000)], "table_id bigint, target_delete_file_bytes bigint")).collect()
    text = "".join(zstandard.ZstdDecompressor().decompressobj(read_across_frames=True).decompress(bytes(o.payload)).decode() for o in out)
    assert sorted(x["pk"] for x in map(json.loads, text.splitlines()) if "pk" in x) == ["01", "02", "02", "03"]


# -- 3


def skewed(spark, n=3000):
    rnd = random.Random(9)
    rows = [(rnd.choice([1, 1, 1, 2, None]), "hot" if rnd.random() < 0.4 else f"k{rnd.randrange(50)}", rnd.choice([None, rnd.randrange(-(10**12), 10**12), 7])) for _ in range(n)]
    return rows, spark.createDataFrame(rows, "t int, k string, v bigint").withColumn("rows", F.lit(0))


@pytest.mark.parametrize("bins", [2, 1024])
def test_exact_quantiles(spark, hot, bins):
    rows, df = skewed(spark)
    probs = [0.0, 0.25, 0.5, 1.0]
    got = {(r.t, r.k, r.prob): (r.rows, r.value) for r in selection.exact_quantiles(df, ["t", "k"], "v", probs, bins if bins > 2 else 64).collect()}
    want = {}
    for key in {(a, b) for a, b, v in rows if v is not None}:
        v = sorted(x for a, b, x in rows if (a, b) == key and x is not None)
        for p in probs:
            want[*key, p] = (len(v), v[max(1, -(-int(p * len(v) * 100) // 100)) - 1 if p * len(v) == int(p * len(v)) else int(p * len(v))])
    assert got == want


def test_quantiles_of_other_types(spark):
    df = spark.createDataFrame([(1, T0), (1, t(5)), (1, t(9)), (2, None)], "k int, v timestamp_ntz").withColumn("d", F.to_date("v"))
    assert [tuple(r) for r in selection.exact_quantiles(df, ["k"], "v", [0.5]).collect()] == [(1, 0.5, 3, t(5))]
    assert selection.exact_quantiles(df, ["k"], "d", [1.0]).first().value == T0.date()
    assert selection.exact_quantiles(df.limit(0), ["k"], "v", [0.5]).count() == 0


@pytest.mark.parametrize("share", [Fraction(1, 4), Fraction(1, 20), Fraction(1, 3)])
def test_heavy_values(spark, hot, share):
    rnd = random.Random(4)
    rows = [(g, rnd.choice(["a", "b", None, f"z{i}"]) if rnd.random() < 0.6 else f"y{i % 30}") for i in range(2000) for g in ((1, None, 2)[i % 3],)]
    rows += [(3, "x")] * 3 + [(3, "y")] + [(4, "p"), (4, "q"), (4, "r"), (4, "s")] + [(5, None)] * 3
    df = spark.createDataFrame(rows, "g int, v string").withColumn("n", F.lit(0))
    got = {(r.g, r.v): r.n for r in selection.heavy_values(df, ["g"], "v", share).collect()}
    total = Counter(g for g, _ in rows)
    want = {k: n for k, n in Counter(r for r in rows if r[1] is not None).items() if n > total[k[0]] * share}
    assert got == want
    assert selection.heavy_values(df.limit(0), ["g"], "v", share).count() == 0


def test_key_stats(spark):
    rows, df = skewed(spark, 500)
    got = {(r.t, r.k): (r.rows, r.distinct_keys) for r in selection.key_stats(df, ["t", "k"], [F.col("v")], ["v"]).collect()}
    want = {key: (n, len({v for a, b, v in rows if (a, b) == key})) for key, n in Counter((a, b) for a, b, _ in rows).items()}
    assert got == want


# -- 4


def test_orphans(spark, hot):
    rnd = random.Random(6)
    parents = [(rnd.choice([1, 2]), rnd.choice("abcd"), t(rnd.choice([0, 5, 20])), t(rnd.choice([None, 3, 20, 30]))) for _ in range(12)] + [(1, "e", None, None), (1, None, t(0), None)]
    children = [(1 if i % 3 else 2, "a" if i % 2 else rnd.choice(["b", "c", "d", "e", "f", None]), i // 2, t(rnd.choice([0, 4, 5, 20, 30, 40, None]))) for i in range(300)]
    p = spark.createDataFrame(parents, "t int, k string, added timestamp, removed timestamp").withColumn("id", F.lit(1))
    c = spark.createDataFrame(children, "t int, k string, id int, at timestamp").withColumn("added", F.lit(1))
    got = Counter(tuple(r) for r in references.orphans(c, p, ["t", "k"], ["id"]).collect())
    want = Counter(x for x in children if not any((a, b) == x[:2] and b is not None and x[3] is not None and s is not None and s <= x[3] and (e is None or e > x[3]) for a, b, s, e in parents))
    assert got == want
    assert references.orphans(c.limit(0), p, ["t", "k"], ["id"]).count() == 0
    assert references.orphans(c, p.limit(0), ["t", "k"], ["id"]).count() == 300


def test_state_orphans(spark, hot):
    rnd = random.Random(8)
    changes = [(rnd.choice(["a", "b", None]), rnd.choice([1, 2, 3, None]), rnd.randrange(3), rnd.choice([True, False, None])) for _ in range(60)]
    children = [(rnd.choice(["a", "a", "b", "c", None]), rnd.choice([1, 2, 3, 4, None]), i) for i in range(200)]
    c = spark.createDataFrame(children, "k string, before bigint, id int")
    s = spark.createDataFrame(changes, "k string, seq bigint, w int, live boolean").withColumn("id", F.lit(9))
    got = sorted(r.id for r in references.state_orphans(c, s, ["k"], ["id"], "before", "seq", F.col("w") > 0, F.col("w"), "live").collect())
    want = []
    for k, before, i in children:
        past = [(q, w, v) for a, q, w, v in changes if a == k and None not in (k, q, v, before) and q < before]
        if not past or not max(past)[2]:
            want.append(i)
    assert got == want


# -- 5


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("skewed_", [False, True])
def test_change_feed(spark, monkeypatch, seed, skewed_):
    if skewed_:
        monkeypatch.setattr(skew, "ROWS", 5)
    rnd = random.Random(seed)
    changes = [(None if k == 9 else k, rnd.choice([1, 2, 3, None]), rnd.choice([0, 1]), rnd.randrange(4), rnd.choice([True, True, False, None]), rnd.choice(["p", "q", None]), rnd.choice([1, None])) for _ in range(400) for k in (0 if rnd.random() < 0.4 else rnd.randrange(10),)]
    feed = changes + rnd.sample(changes, 50)
    rnd.shuffle(feed)
    base = [(0, "base", 5), (77, "base", 6)]
    df = spark.createDataFrame(feed, "k int, q bigint, kind int, o int, live boolean, path string, pos bigint").withColumn("sign", F.lit(1)).withColumn("m", F.lit(1))
    b = spark.createDataFrame(base, "k int, path string, pos bigint")
    state = {r[0]: (True, *r[1:]) for r in base}
    low = lambda v: (v is not None, v)
    for c in sorted((c for c in changes if c[1] is not None and c[4] is not None), key=lambda c: (c[1:4], c[4], low(c[5]), low(c[6]))):
        state[c[0]] = c[4:]
    want = Counter((k, v[1], v[2]) for k, v in state.items() if v[0])
    assert Counter(tuple(r) for r in cdc.apply_changes(df, ["k"], ["q", "kind", "o"], "live", ["path", "pos"], b).collect()) == want
    assert cdc.apply_changes(df.limit(0), ["k"], ["q", "kind", "o"], "live", ["path", "pos"]).count() == 0


def test_stated_before_images_leave_nothing_to_derive(spark):
    full = [(1, 1, True, "a"), (1, 2, False, None), (1, 3, True, "b"), (1, 4, False, "b"), (1, 5, True, "c"), (2, 1, True, "x"), (2, 1, True, "x")]
    lossy = [(3, 1, True, "a"), (3, 2, True, "b"), (3, 3, False, "other"), (4, 1, False, None), (4, 2, True, "d"), (4, 3, False, None), (4, 4, False, None)]
    count = lambda rows: Counter((r.k, r.origin) for r in cdc.signed_images(spark.createDataFrame(rows, "k int, q int, live boolean, path string"), ["k"], ["q"], "live", ["path"]).collect())
    assert count(full) == {(1, "after"): 3, (1, "stated"): 2, (2, "after"): 1}
    assert count(lossy) == {(3, "after"): 2, (3, "derived"): 2, (4, "after"): 1, (4, "stated"): 1}


def test_tiny_shares_are_exact(spark):
    rows = spark.range(100_000).select(F.lit(1).alias("g"), F.when(F.col("id") < 3, "three").when(F.col("id") < 5, "two").otherwise(F.col("id").cast("string")).alias("v"))
    found = lambda share: sorted((r.v, r.n) for r in selection.heavy_values(rows, ["g"], "v", share).collect())
    assert found(Fraction(1, 50_000)) == [("three", 3)] and found(0.5) == []
    for bad in (0, Fraction(1, 10**18)):
        with pytest.raises(ValueError):
            selection.exact_share(bad)


# -- the queries on empty tables


def test_queries_on_empty_tables(spark, tmp_path):
    import glob
    import os

    source = "/root/testdata/sf0.001"
    if not os.path.isdir(source):
        pytest.skip("no test tables here")
    for p in glob.glob(f"{source}/*.parquet"):
        spark.read.parquet(p).limit(0).coalesce(1).write.parquet(str(tmp_path / os.path.basename(p)))
    for name, f in problems.QUERIES.items():
        assert f(spark, str(tmp_path)).count() == 0, name


def test_heavy_values_with_a_share_for_each_kind(spark):
    rows = [("a", "x")] * 3 + [("a", "y")] * 2 + [("b", "x")] * 3 + [("b", "y")] * 2 + [("c", "x")] * 9 + [(None, "x")] * 9
    df = spark.createDataFrame(rows, "kind string, v string")
    got = {(r.kind, r.v): r.n for r in selection.heavy_values(df, ["kind"], "v", ("kind", {"a": Fraction(1, 2), "b": Fraction(1, 4)})).collect()}
    assert got == {("a", "x"): 3, ("b", "x"): 3, ("b", "y"): 2}
