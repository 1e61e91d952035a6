"""The line source: appended, truncated and replaced files, and a restart at any point."""

import io
import os

import pytest

from tracelake.sources.lines import LineReader, changed_files, consumer_cursors, file_snapshot, line_stream, lines_of


def read_all(spark, folder, work, consumer="a", **options):
    """What one run of the query adds."""
    done = f"{work}/out-{consumer}"
    before = {tuple(r) for r in spark.read.schema("path string, offset long, line string, batch long").parquet(done).select("path", "offset", "batch").collect()} if os.path.exists(done) else set()

    def keep(rows, batch):
        from pyspark.sql import functions as F

        rows.withColumn("batch", F.lit(batch).cast("long")).write.mode("append").parquet(done)

    stream = line_stream(spark, folder, **options).writeStream.foreachBatch(keep).option("checkpointLocation", f"{work}/check-{consumer}")
    stream.trigger(availableNow=True).start().awaitTermination()
    if not os.path.exists(done):
        return []
    rows = spark.read.parquet(done).collect()
    return sorted((os.path.basename(r["path"]), r["offset"], r["line"]) for r in rows if (r["path"], r["offset"], r["batch"]) not in before)


def put(path, text, mode="w"):
    with open(path, mode) as f:
        f.write(text)


def test_growing_files_give_each_line_once(spark, tmp_path):
    folder, work = f"{tmp_path}/in", f"{tmp_path}/work"
    os.makedirs(f"{folder}/sub")
    put(f"{folder}/a.jsonl", "one\ntwo\r\nthr")
    put(f"{folder}/sub/b.jsonl", "é\n\n")
    put(f"{folder}/c.txt", "no\n")
    assert read_all(spark, folder, work) == [("a.jsonl", 0, "one"), ("a.jsonl", 4, "two"), ("b.jsonl", 0, "é"), ("b.jsonl", 3, "")]
    assert read_all(spark, folder, work) == []
    put(f"{folder}/a.jsonl", "ee\nfour\n", "a")
    put(f"{folder}/d.jsonl", "new\nopen")
    assert read_all(spark, folder, work) == [("a.jsonl", 9, "three"), ("a.jsonl", 15, "four"), ("d.jsonl", 0, "new")]
    # shorter, in place: from its start
    put(f"{folder}/a.jsonl", "less\n")
    assert read_all(spark, folder, work) == [("a.jsonl", 0, "less")]
    # another file of the same name, longer than the old one
    put(f"{folder}/x.tmp", "quite another file\nwith two lines\n")
    os.rename(f"{folder}/x.tmp", f"{folder}/a.jsonl")
    assert read_all(spark, folder, work) == [("a.jsonl", 0, "quite another file"), ("a.jsonl", 19, "with two lines")]
    # rewritten in place and longer: inode and size fit, the head doesn't
    put(f"{folder}/a.jsonl", "still a different file\nwith more\nand more lines\n")
    assert len(read_all(spark, folder, work)) == 3
    os.remove(f"{folder}/d.jsonl")
    assert read_all(spark, folder, work) == []
    # another consumer has cursors of its own
    assert len(read_all(spark, folder, work, "b")) == 5
    cursors = {(r["consumer"], os.path.basename(r["path"])): r["offset"] for r in consumer_cursors(spark, {c: f"{work}/check-{c}" for c in "ab"}).collect()}
    assert cursors == {(c, n): size for c in "ab" for n, size in (("a.jsonl", 48), ("b.jsonl", 4))}


def test_small_ranges_cut_no_line(spark, tmp_path):
    folder = f"{tmp_path}/in"
    os.makedirs(folder)
    lines = ["x" * (i * 7 % 40) for i in range(200)]
    put(f"{folder}/a.jsonl", "".join(f"{x}\n" for x in lines))
    got = read_all(spark, folder, f"{tmp_path}/work", split=64)
    assert [x[2] for x in got] == lines


@pytest.mark.parametrize("split", [1, 2, 3, 5, 100])
def test_ranges_partition_the_lines(split):
    data = b"ab\n\nc\ndefgh\n\n"
    got = [x for first in range(0, len(data), split) for x in lines_of(io.BytesIO(data), first, min(first + split, len(data)), 0)]
    assert got == [(0, b"ab"), (3, b""), (4, b"c"), (6, b"defgh"), (12, b"")]


def test_unfinished_batch_repeats(tmp_path):
    """A batch planned again from its two offsets reads the same lines; a file replaced in between gives none to it."""
    path = f"{tmp_path}/a.jsonl"
    put(path, "one\ntwo\n")
    reader = LineReader({"path": str(tmp_path)})
    end = reader.latestOffset()
    put(path, "three\n", "a")

    def read(start, end):
        again = LineReader({"path": str(tmp_path)})
        return [t for p in again.partitions(start, end) for b in again.read(p) for t in b.column(2).to_pylist()]

    assert read({}, end) == ["one", "two"] == read({}, end)
    later = LineReader({"path": str(tmp_path)}).latestOffset()
    assert read(end, later) == ["three"]
    put(f"{tmp_path}/new", "uno\ndue\ntre\n")
    os.rename(f"{tmp_path}/new", path)
    assert read(end, later) == []
    newest = LineReader({"path": str(tmp_path)}).latestOffset()
    assert read(later, newest) == ["uno", "due", "tre"]


def test_empty_and_missing_folders(spark, tmp_path):
    assert LineReader({"path": f"{tmp_path}/none"}).latestOffset() == {}
    assert read_all(spark, str(tmp_path), f"{tmp_path}/work") == []


def test_whole_files_that_changed(spark, tmp_path):
    for name, text in (("a", "1\n"), ("b", "2\n"), ("e", "")):
        put(f"{tmp_path}/{name}.jsonl", text)
    empty = spark.createDataFrame([], "path string, length long, modified timestamp")
    first = spark.createDataFrame(file_snapshot(spark, str(tmp_path)).collect(), empty.schema)
    names = lambda df: sorted(os.path.basename(r["path"])[0] for r in df.collect())
    assert names(changed_files(empty, first)) == ["a", "b"]
    put(f"{tmp_path}/a.jsonl", "3\n", "a")
    put(f"{tmp_path}/c.jsonl", "4\n")
    os.utime(f"{tmp_path}/b.jsonl", (1, 1))
    assert names(changed_files(first, file_snapshot(spark, str(tmp_path)))) == ["a", "b", "c"]
