"""Composites, CSV and Bloom filters on literals."""

from __future__ import annotations

import gzip
import zipfile

from pyspark.sql import functions as F

from quernstone.functions import composite as c
from quernstone.operators.bloom import BloomSpec, build, merge, probe
from quernstone.sources import csv


def one(spark, *cols):
    return tuple(spark.range(1).select(*[x.alias(f"c{i}") for i, x in enumerate(cols)]).first())


def test_collection_operations(spark):
    a = F.array(*map(F.lit, ["a", "b", "a"]))
    got = one(spark, c.remove(a, F.lit("a")), c.remove_all(a, F.array(F.lit("a"), F.lit("x"), F.lit("b"))), c.retain_all(a, F.array(F.lit("a"))), c.add(a, F.lit(None)), c.contains_all(a, F.array(F.lit("b"))), c.sorted_distinct(a), c.text(a))
    assert got == (["b", "a"], ["b", "a"], ["a", "a"], ["a", "b", "a"], True, ["a", "b"], "[a, b, a]")


def test_map_operations(spark):
    m = F.create_map(F.lit("k"), F.lit("1"), F.lit("j"), F.lit("2"))
    got = one(spark, c.map_text(c.put(m, F.lit("k"), F.lit("9"))), c.map_text(c.put(m, F.lit("k"), F.lit(None).cast("string"))), c.get_or_default(m, F.lit("z"), F.lit("d")), c.put_if_absent(m, F.lit("k"), F.lit("9"))[1], c.map_text(c.put_if_absent(m, F.lit("n"), F.lit("9"))[0]), c.maps_equal(m, c.sorted_map(m)))
    assert got == ("{j=2, k=9}", "{j=2, k=1}", "d", None, "{j=2, k=1, n=9}", True)


def test_orders(spark):
    pairs = spark.createDataFrame([("aaa", "bbb"), ("bbb", "aaa"), ("aaa", "abb")], "a string, b string").select(c.pair(F.col("a"), F.col("b")).alias("p"))
    assert [c_.p.first for c_ in pairs.orderBy(*c.second_order(F.col("p"))).collect()] == ["bbb", "aaa", "aaa"]
    assert [tuple(x.p) for x in pairs.orderBy(*c.pair_order(F.col("p"))).collect()] == [("aaa", "abb"), ("aaa", "bbb"), ("bbb", "aaa")]
    lists = spark.createDataFrame([(1, ["aaa", "bbb", "ccc", "ddd"]), (2, ["aaa", "bbb", "ccc"]), (3, ["aaa", "bbb", "ccc", "eee"])], "i int, a array<string>")
    assert [r.i for r in lists.orderBy(*c.collection_order(F.col("a"))).collect()] == [2, 1, 3]


def test_csv_fields(spark):
    lines = ['a,b', '', '"x, y",NA,,', '"say ""hi""","back \\\\ slash"', ',', '日本,"é"']
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string").orderBy("i").select(csv.fields(F.col("line"))).collect()]
    assert got == [["a", "b"], [""], ["x, y", "NA", "", ""], ['say "hi"', "back \\ slash"], ["", ""], ["日本", "é"]]


def test_csv_files_positions_gzip_and_zip(spark, tmp_path):
    text = 'a,b\n"c, d",é\n\nlast'
    (tmp_path / "t.csv").write_text(text)
    with gzip.open(tmp_path / "t.csv.gz", "wt") as f:
        f.write(text)
    with zipfile.ZipFile(tmp_path / "t.zip", "w") as z:
        z.writestr("one.csv", text)
        z.writestr("two.csv", "x,y\r\nz")
    for name in ("t.csv", "t.csv.gz"):
        got = sorted((r.pos, r.fields) for r in csv.read(spark, f"file://{tmp_path}/{name}").collect())
        assert got == [(0, ["a", "b"]), (4, ["c, d", "é"]), (13, [""]), (14, ["last"])]
    got = sorted((r.entry, r.pos, r.fields) for r in csv.read_zip(spark, f"file://{tmp_path}/t.zip").collect())
    assert got == [("one.csv", 0, ["a", "b"]), ("one.csv", 4, ["c, d", "é"]), ("one.csv", 13, [""]), ("one.csv", 14, ["last"]), ("two.csv", 0, ["x", "y"]), ("two.csv", 4, ["z"])]


def test_bloom(spark):
    spec = BloomSpec(1000, 0.03)
    assert (spec.bits, spec.hashes) == (7298, 5)
    words = spark.createDataFrame([(str(i),) for i in range(1, 8)] + [(None,)], "w string")
    probes = spark.createDataFrame([(w,) for w in ["1", "7", "8", "9", "10", "aa", None]], "w string")
    filt = merge(build(words.where("w < '4'"), "w", spec), build(words.where("w >= '4'"), "w", spec))
    for bits in (None, 1):
        import quernstone.operators.bloom as b

        keep, b.BROADCAST_BITS = b.BROADCAST_BITS, bits or b.BROADCAST_BITS
        got = {r.w: r.maybe for r in probe(probes, "w", filt, spec).collect()}
        b.BROADCAST_BITS = keep
        assert got["1"] and got["7"] and not got["aa"] and not got[None]


def test_float_codecs_keep_every_value(spark):
    import math
    import struct

    from pyspark.sql import functions as F

    from quernstone.functions import codecs

    values = [1.5, -0.0, 0.0, math.inf, -math.inf, math.nan, None, 5e-324]
    for kind, code in (("double", ">d"), ("float", ">f")):
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}").repartition(2)
        rows = df.select("i", codecs.encode(kind, F.col("v")).alias("b")).select("i", "b", codecs.decode(kind, F.col("b")).alias("v")).collect()
        for r in rows:
            want = values[r.i]
            assert (r.b is None) == (r.v is None) == (want is None)
            if want is not None:
                assert struct.unpack(code, r.b)[0] == r.v or math.isnan(want) and math.isnan(r.v)
                assert math.isnan(want) or struct.pack(code, want) == bytes(r.b)
        bad = spark.createDataFrame([(b"\x00",), (None,), (b"",)], "b binary").select(codecs.decode(kind, F.col("b")).alias("v"))
        assert [r.v for r in bad.collect()] == [None] * 3
        assert df.limit(0).select(codecs.encode(kind, F.col("v"))).count() == 0
