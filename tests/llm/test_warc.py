import base64
import glob
import hashlib
import zlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tracelake.llm import warc

SCHEMA = "page_id long, url string, html string, sha string, salt int, `key` string, archive string"


def pages():
    rows = [(i, f"http://Host{i % 4}.example.com:80/a/{i % 3}?b={i}&a=1", f"<p>page {i}</p>\r\n\r\nWARC/1.1 é") for i in range(40)]
    rows += [(50, "http://x.com/", "<p>same</p>"), (49, "http://y.com/", "<p>same</p>"), (51, None, "<p>same</p>"), (52, "http://x.com/", None), (53, "bad\turl", ""), (None, "http://z.com", "<p>same</p>"), (54, "http://x.com/", "")]
    return rows + [rows[-6], rows[0], (0, rows[0][1], "other payload")]


def wanted(rows):
    first = {}
    for n, (i, u, h) in enumerate(rows):
        key = (i is None, i or 0, u is not None and u or "", n)
        first[h or ""] = min(first.get(h or "", key), key)
    out = []
    for n, (i, _, h) in enumerate(rows):
        f = first[h or ""]
        raw = (h or "").encode()
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f[3] == n else "revisit", None if f[3] == n or f[0] else f[1]))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def archive(spark):
    df = spark.createDataFrame([(*r, "s", 1, "k", "a") for r in pages()], SCHEMA).repartition(3)
    return df, *warc.archived(spark, df)


def digest_rows(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=str)


def test_round_trip(spark, archive):
    _, blocks, _, folder = archive
    back = warc.read_records(spark, warc.unpacked(blocks), folder)
    assert digest_rows(back) == wanted(pages())
    kept = {(r["page_id"], bytes(r["payload"]).decode()) for r in back.where("record_type = 'response'").collect()}
    assert {(i, h or "") for i, _, h in pages()} >= kept and len({h for _, h in kept}) == len({h or "" for _, _, h in pages()})


def test_lookup_finds_every_capture_of_a_url(spark, archive):
    df, blocks, directory, folder = archive
    assert digest_rows(warc.lookup(spark, df, blocks, directory, folder)) == wanted(pages())
    some = spark.createDataFrame([("HTTP://www.x.com",), ("http://nowhere.org/",)], "url string")
    assert sorted(r["page_id"] for r in warc.lookup(spark, some, blocks, directory, folder).collect()) == [50, 52, 54]


def test_small_blocks(spark, archive):
    df, _, _, folder = archive
    captures = warc.write_archives(spark, df, folder + "-2")
    blocks, directory = warc.write_index(spark, captures, lines=3)
    assert directory.count() > 10
    assert digest_rows(warc.lookup(spark, df, blocks, directory, folder + "-2")) == wanted(pages())


def test_a_task_that_runs_again_replaces_nothing(spark, archive, monkeypatch):
    """The same pages written twice to one folder, ties in another order: the first index reads all its records."""
    df, folder = archive[0], archive[3] + "-3"
    with monkeypatch.context() as m:
        m.setattr(warc, "drop_strays", lambda captures, folder: None)
        first = warc.write_archives(spark, df, folder)
        again = warc.write_archives(spark, df.repartition(1).orderBy("html"), folder)
    names = {r["archive"] for r in first.select("archive").collect()}
    assert not names & {r["archive"] for r in again.select("archive").collect()}
    blocks, directory = warc.write_index(spark, first)
    assert digest_rows(warc.lookup(spark, df, blocks, directory, folder)) == wanted(pages())
    warc.drop_strays(first, folder)
    assert {f.rsplit("/", 1)[1] for f in glob.glob(f"{folder.removeprefix('file://')}/*.gz")} == names
    assert digest_rows(warc.lookup(spark, df, blocks, directory, folder)) == wanted(pages())


def test_a_very_long_payload(spark):
    long = "<p>é " + "x y " * 2_000_000
    df = spark.createDataFrame([(1, "http://a.com/", long), (2, "http://b.com/", long), (3, "http://b.com/", "short")], "page_id long, url string, html string")
    blocks, directory, folder = warc.archived(spark, df)
    back = warc.lookup(spark, df, blocks, directory, folder)
    assert digest_rows(back) == wanted([(r["page_id"], r["url"], r["html"]) for r in df.collect()])
    assert back.where("page_id = 1").first()["payload"] == long.encode()


def test_archives_are_standard(archive):
    folder = archive[3].removeprefix("file://")
    data = b"".join(open(f, "rb").read() for f in sorted(glob.glob(f"{folder}/*.warc.gz")))
    n = 0
    while data:
        one = zlib.decompressobj(31)
        raw = one.decompress(data)
        data, n = one.unused_data, n + 1
        head, _, rest = raw.partition(b"\r\n\r\n")
        length = int(next(x.split(b": ")[1] for x in head.split(b"\r\n") if x.startswith(b"Content-Length")))
        assert head.startswith(b"WARC/1.1\r\n") and rest[length:] == b"\r\n\r\n"
    assert n == len(pages())


@given(st.lists(st.text("abc", max_size=3), min_size=1, max_size=30), st.integers(1, 5), st.text("abc", max_size=3))
def test_bisection_finds_all_blocks(keys, size, key):
    keys.sort()
    parts = [keys[i : i + size] for i in range(0, len(keys), size)]
    a, b = warc.blocks_of([key], [p[0] for p in parts], [p[-1] for p in parts])[0]
    assert {j for j, p in enumerate(parts) if key in p} <= set(range(a, b))


def test_url_keys():
    assert warc.url_key("http://WWW.Sub.Example.com/B?z=1&a=2") == "com,example,sub)/b?a=2&z=1"
    assert warc.url_key(None) == "" and warc.url_key("http://h:99999/") == "http://h:99999/"


def test_empty_table(spark, archive):
    blocks, directory, folder = warc.archived(spark, archive[0].limit(0))
    assert warc.read_records(spark, warc.unpacked(blocks), folder).count() == 0
    assert warc.lookup(spark, archive[0], blocks, directory, folder).count() == 0
