"""CSV files as a data source, and the record log's reports."""

from __future__ import annotations

import bz2
import gzip
import os
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quernstone.plans import sources
from quernstone.sources import csvfiles
from quernstone.streaming import delivery

ODD = ["plain,line", "", 'é,"q ""x"""', "x" * 5000, "a\rb", ",,", "ü" * 700]


def placed(lines):
    out, pos = [], 0
    for line in lines:
        out.append((pos, line))
        pos += len(line) + 1
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("closed", [True, False])
def test_lines_and_positions_whatever_the_ranges(spark, tmp_path, end, closed):
    lines = ODD * 3 + ["last"]
    data = (end.join(lines) + (end if closed else "")).encode()
    (tmp_path / "a b.csv").write_bytes(data)
    (tmp_path / "c.csv.gz").write_bytes(gzip.compress(data))
    (tmp_path / "d.csv.bz2").write_bytes(bz2.compress(data))
    (tmp_path / "_hidden").write_bytes(data)
    (tmp_path / "empty.csv").write_bytes(b"")
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("folder/", "")
        z.writestr("folder/x.csv", data)
        z.writestr("empty.csv", "")
    for size in (700, 4097, 1 << 20):
        got = {}
        for r in csvfiles.lines(spark, str(tmp_path), size).collect():
            got.setdefault((os.path.basename(r.file), r.entry), []).append((r.pos, r.line))
        assert set(got) == {("a b.csv", None), ("c.csv.gz", None), ("d.csv.bz2", None), ("z.zip", "folder/x.csv")}
        assert all(sorted(v) == placed(lines) for v in got.values())


@pytest.mark.parametrize("size", range(1, 9))
def test_no_line_is_lost_or_repeated_at_range_edges(tmp_path, size):
    data = b"ab\n\ncde\r\n\nf\nghijkl"
    (tmp_path / "a.csv").write_bytes(data)
    got = []
    for part in csvfiles._parts(str(tmp_path), size):
        with csvfiles._opened(part.file) as f:
            got += list(csvfiles._range_lines(f, part.first, part.end))
    assert got == [b"ab", b"", b"cde\r", b"", b"f", b"ghijkl"]


def test_more_tasks_than_files_and_a_lost_path(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        for i in range(5):
            z.writestr(f"{i}.csv", "a,b\n" * (csvfiles.BATCH_LINES + 3 if i == 2 else 2))
    spark.dataSource.register(csvfiles.CsvLines)
    rows = spark.read.format(csvfiles.NAME).option("path", str(tmp_path)).load()
    assert rows.rdd.getNumPartitions() == 5
    assert rows.where("entry = '2.csv'").agg(F.count("*"), F.max("pos")).first() == (csvfiles.BATCH_LINES + 3, 4 * (csvfiles.BATCH_LINES + 2))
    assert csvfiles.lines(spark, str(tmp_path)).count() == csvfiles.BATCH_LINES + 11
    with pytest.raises(Exception, match="no/such"):
        csvfiles.read(spark, f"{tmp_path}/no/such").count()


def test_reports_make_a_delivery_visible(spark, tmp_path):
    path = f"file://{tmp_path}/log"
    rows = spark.range(40).select(F.concat(F.lit("t"), F.col("id") % 3).alias("topic"), F.lit(None).cast("string").alias("key"), F.when(F.col("id") > 0, F.lit("né")).alias("value"))
    got = delivery.deliver(rows.repartition(4), path, "first").groupBy("topic").agg(F.sum("records").alias("n"), F.sum("bytes").alias("b")).collect()
    assert sorted(map(tuple, got)) == [("t0", 14, 39), ("t1", 13, 39), ("t2", 13, 39)]
    before = set(os.listdir(tmp_path / "log"))
    with pytest.raises(Exception, match="broken"):
        delivery.deliver(rows.withColumn("value", F.when(F.rand(1) < 2, F.raise_error(F.lit("broken")))), path)
    assert set(os.listdir(tmp_path / "log")) == before
    assert delivery.delivered(spark, path).count() == 40
    assert delivery.deliver(rows.limit(0), path, "nothing").collect() == []
    assert {r.delivery for r in delivery.reports(spark, path).collect()} == {"first"}


def test_small_ranges_share_tasks_and_read_little(spark, tmp_path):
    """As many tasks as the bytes need, not one for each range; a range is read without the rest of its file."""
    (tmp_path / "csv").mkdir()
    lines = [f"line,{i}" for i in range(20_000)]
    for name in ("a.csv", "b.csv"):
        (tmp_path / "csv" / name).write_text("\n".join(lines) + "\n")
    spark.dataSource.register(csvfiles.CsvLines)
    assert spark.read.format(csvfiles.NAME).options(path=str(tmp_path / "csv"), rangebytes=500).load().rdd.getNumPartitions() == 1
    got = {}
    for r in csvfiles.lines(spark, str(tmp_path / "csv"), 500).collect():
        got.setdefault(os.path.basename(r.file), []).append((r.pos, r.line))
    assert {k: sorted(v) for k, v in got.items()} == {"a.csv": placed(lines), "b.csv": placed(lines)}
    tasks = list(csvfiles._tasks(csvfiles._parts(str(tmp_path / "csv"), 500), 100_000))
    ranges = [(p.file, at) for t in tasks for p in t.parts for at in range(p.first, p.end, 500)]
    assert len(tasks) == 5 and ranges == [(p.file, p.first) for p in csvfiles._parts(str(tmp_path / "csv"), 500)]
    with open(tmp_path / "csv" / "a.csv", "rb") as f:
        read = []

        class Counted:
            seek = f.seek

            def read(self, n):
                read.append(n)
                return f.read(n)

        assert list(csvfiles._range_lines(Counted(), 500, 1000)) and sum(read) <= 4096


def test_archives_are_written_as_they_come(tmp_path):
    """An archive's bytes are in its file before all its lines are read."""
    path = f"file://{tmp_path}/zips"
    rows = [(0, 1, "x.csv", f"{i * 7919 % 10**9}-{i * 104729 % 10**9}") for i in range(200_000)] + [(0, 2, "y.csv", "ü"), (0, 2, "z.csv", "z")]

    def batches():
        for i in range(0, len(rows), 10_000):
            if i == 190_000:
                assert os.path.getsize(tmp_path / "zips/0-1.zip") > 500_000
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[i : i + 10_000], strict=True)], ["run", "archive", "entry", "value"])

    assert [b.column(0)[0].as_py() for b in sources._archives(path)(batches())] == [200_000, 2]
    with zipfile.ZipFile(tmp_path / "zips/0-1.zip") as z:
        assert z.testzip() is None and z.read("x.csv").decode() == "".join(r[3] + "\r\n" for r in rows[:200_000])
    with zipfile.ZipFile(tmp_path / "zips/0-2.zip") as z:
        assert [(e.filename, z.read(e).decode()) for e in z.infolist()] == [("y.csv", "ü\r\n"), ("z.csv", "z\r\n")]
