import base64
import hashlib
from collections import Counter

import pytest
import zstandard
from pyarrow import fs

from wallscope.llm import op9_warc, queries

SF_DIR = "/root/testdata/sf0.001"


def expected(rows):
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    winner, count = {}, Counter(digest(h) for _, _, h in rows)
    for p, _, h in rows:
        if p is not None:
            winner[digest(h)] = max(p, winner.get(digest(h), p))
    out = Counter()
    for p, _, h in rows:
        d = digest(h)
        other = count[d] > 1 and winner.get(d) is not None and winner[d] != p
        out[p, len((h or "").encode()), d, "revisit" if other else "response", winner[d] if other else None] += 1
    return out


def result(df):
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return Counter(tuple(r[n] for n in names) for r in df.collect())


def test_query_equals_brute_force(spark):
    pages = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").select("page_id", "url", "html").collect()]
    assert result(queries.QUERIES["op9_warc"](spark, SF_DIR)) == expected(pages)


@pytest.mark.parametrize(
    "rows",
    [
        [],
        [(1, "u", "x"), (2, None, "x"), (2, None, "x"), (3, "a\r\nb: c", None), (4, "", ""), (None, "n", "x"), (7, "v", "ü\r\n\r\nWARC/1.1" * 200_000)],
    ],
)
def test_odd_rows(spark, rows):
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, payload string")
    assert result(op9_warc.roundtrip(pages)) == expected(rows)


def test_seek_and_foreign_readers(spark, tmp_path):
    rows = [(i, f"http://x/{i}", f"<p>{i}</p>" * (i * 50)) for i in range(60)]
    root = f"file://{tmp_path}/bundles"
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = op9_warc.write(pages, root, frame_bytes=4096, bundle_bytes=40_000)
    assert index.select("bundle").distinct().count() > 2 and index.where("frame > 0 and offset > 0").count()
    got = {r.page_id: bytes(r.payload).decode() for r in op9_warc.fetch(root, index.where("page_id % 7 = 0")).collect()}
    assert got == {i: html for i, _, html in rows if i % 7 == 0}
    store, base = fs.FileSystem.from_uri(root)
    file = store.get_file_info(fs.FileSelector(base))[0]
    raw = open(file.path, "rb").read()
    whole = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert whole.startswith(b"WARC/1.1\r\nWARC-Type: ")
    op9_warc_orphan = tmp_path / "bundles" / "bundle-orphan.warc.zst"
    op9_warc_orphan.write_bytes(raw)
    assert op9_warc.read(spark, root, index).count() == len(rows)


def headers(spark, root, index):
    """Header fields of all records, by page_id and kind."""
    out = []
    for file in {r.bundle for r in index.collect()}:
        raw = open(f"{root}/{file}", "rb").read()
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        while plain:
            head, rest = plain.split(b"\r\n\r\n", 1)
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            size = int(fields["Content-Length"])
            out.append((fields, rest[:size]))
            plain = rest[size + 4 :]
    return out


def test_records_are_valid_and_named_once(spark, tmp_path):
    rows = [(1, "http://x/ä b\t%41\n", "same"), (2, "http://x/2", "same"), (5, "http://x/5", "same"), (7, "u", "other")]
    rows += [(9, "v", "twice"), (9, "v", "twice"), (8, "w", "twice"), (None, None, "same")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    index = op9_warc.write(pages, str(tmp_path / "plain"))
    found = headers(spark, tmp_path / "plain", index)
    ids = [f["WARC-Record-ID"] for f, _ in found]
    assert len(set(ids)) == len(ids) == len(rows)
    assert sorted(ids) == sorted(r.record_id for r in index.collect())
    by_page = {f.get("X-Page-ID"): (f, body) for f, body in found}
    for fields, body in found:
        assert fields["Content-Type"] == "application/http;msgtype=response" and body.startswith(b"HTTP/1.1 200 OK\r\n")
        if fields["WARC-Type"] == "revisit":
            assert fields["WARC-Profile"] == op9_warc.PROFILE and fields["WARC-Refers-To-Date"] == op9_warc.DATE
            assert body.endswith(b"\r\n\r\n")
        else:
            size = int(dict(x.split(": ", 1) for x in body.split(b"\r\n\r\n")[0].decode().split("\r\n")[1:])["Content-Length"])
            assert len(body.split(b"\r\n\r\n", 1)[1]) == size
    first = by_page["1"][0]
    assert first["WARC-Target-URI"] == "http://x/%C3%A4%20b%09%41%0A"
    assert first["WARC-Refers-To"] == by_page["5"][0]["WARC-Record-ID"] and first["WARC-Refers-To-Target-URI"] == "http://x/5"
    # Two records have the winning page: no identifier stands for both.
    assert "WARC-Refers-To" not in by_page["8"][0] and by_page["8"][0]["X-Refers-To-Page"] == "9"


def test_folders_are_qualified_by_hadoop(spark, tmp_path):
    assert op9_warc.qualified(spark, f"{tmp_path}/a") == op9_warc.qualified(spark, f"file:{tmp_path}/a") == f"file://{tmp_path}/a"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    conf.set("fs.defaultFS", "viewfs://cluster/")
    conf.set("fs.viewfs.mounttable.cluster.link./checkpoints", f"file://{tmp_path}")
    try:
        with pytest.raises(ValueError, match="pyarrow doesn't open viewfs://cluster/checkpoints"):
            op9_warc.qualified(spark, "/checkpoints/warc")
    finally:
        conf.set("fs.defaultFS", before or "file:///")


def test_frames_are_read_by_the_seek_table(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i}</p>" * 40) for i in range(200)]
    root = f"{tmp_path}/seek"
    index = op9_warc.write(spark.createDataFrame(rows, "page_id long, url string, html string"), root, frame_bytes=2000)
    moved = index.withColumn("frame_start", index.frame_start + 1)
    with pytest.raises(Exception, match="isn't where the index has it"):
        op9_warc.fetch(root, moved).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in op9_warc.fetch(root, index).collect()} == {i: h for i, _, h in rows}
