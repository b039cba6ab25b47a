"""Feed loading, metadata and snapshots."""

import hashlib
import json
from datetime import datetime, timedelta, timezone

import pytest

from wallscope.operators import feedinfo
from wallscope.plans import jobs
from wallscope.sources import feeds

NETSET = """#
# drop list of the night shift, six entries
#
185.220.100.0/22 # relay block
45.95.146.0/24

# hosts seen once
193.32.162.7
80.94.95.112 # scanner
2.57.122.0/27

141.98.10.60
"""

ADDRESS_ONLY = """# hosts that knocked, three plain and two set aside
# 193.32.162.7
185.220.101.9
# 80.94.95.112
141.98.10.60
77.90.185.3
"""


def lines(spark, **texts):
    rows = [(source, line) for source, text in texts.items() for line in text.splitlines()]
    return spark.createDataFrame(rows, "source string, line string")


def entries(frame):
    return sorted(row.entry for row in frame.collect())


def test_netset(spark):
    assert len(entries(feeds.load_entries(lines(spark, firehol_level1=NETSET)))) == 6


def test_mixed_netset(spark):
    text = "77.90.185.3\n#\n45.95.146.0/24\nno address here\n77.90.185.3 # second time\n141.98.10.60\n"
    found = entries(feeds.load_entries(lines(spark, s=text)))
    assert found == ["141.98.10.60", "45.95.146.0/24", "77.90.185.3"]


def test_address_only_feed(spark):
    raw = lines(spark, emerging_threats=ADDRESS_ONLY + "10.0.0.0/8\n## 192.0.2.9\n#192.0.2.8\n#  192.0.2.7 \n")
    found = sorted(row.line for row in feeds.normalize_address_only(raw).collect())
    assert found == ["141.98.10.60", "185.220.101.9", "192.0.2.7", "193.32.162.7", "77.90.185.3", "80.94.95.112"]


def test_other_feeds_pass_through(spark):
    raw = lines(spark, other=NETSET, emerging_threats=ADDRESS_ONLY)
    passed = feeds.normalize(raw).where("source = 'other'")
    assert passed.count() == len(NETSET.splitlines())


def test_ipv6_entries(spark):
    found = feeds.load_entries(lines(spark, s="2001:db8::/32 net\n::1\n2001:db8::/129\n")).collect()
    assert sorted((row.entry, row.family, row.plen) for row in found) == [("2001:db8::/32", 6, 32), ("::1", 6, 128)]


def meta_frame(spark, **contents):
    return feeds.parse_meta(spark.createDataFrame(list(contents.items()), "source string, content string"))


def test_metadata_formats(spark):
    digest = hashlib.md5(b"1609459200.0:100:https://example.com/list.txt").hexdigest()
    meta = meta_frame(
        spark,
        new=json.dumps({"timestamp": 1609459200.0, "count": 100, "url": "https://example.com/list.txt"}),
        old=" 1609459200.0|100|https://example.com/list.txt|more|text\n",
        partial='{"timestamp": 5.25}',
        broken='{"timestamp": ',
        short="1609459200.0|100",
        text="garbage",
        words="a|b|c",
    )
    rows = {row.source: row for row in meta.collect()}
    for name in ("new", "old"):
        row = rows[name]
        assert (row.timestamp, row["count"], row.url, row.hash) == (
            1609459200.0,
            100,
            "https://example.com/list.txt",
            digest,
        )
    assert (rows["partial"].timestamp, rows["partial"]["count"], rows["partial"].url) == (5.25, 0, "")
    for name in ("broken", "short", "text", "words"):
        assert tuple(rows[name])[1:] == (None, None, None, None)


@pytest.mark.parametrize("stamp", [1609459200.0, 1704240000.5, 1704240000.123456, 1700000000.1, 10.0, 0.0])
def test_hash_prints_numbers_as_python(spark, stamp):
    (row,) = meta_frame(spark, s=json.dumps({"timestamp": stamp, "count": 3, "url": "u"})).collect()
    assert row.hash == hashlib.md5(f"{stamp}:3:u".encode()).hexdigest()


def test_staleness(spark):
    now = 1704240000
    meta = meta_frame(spark, fresh=f"{now - 60}|1|u", edge=f"{now - 86400}|1|u", old=f"{now - 7 * 86400}|1|u", bad="x")
    rows = {row.source: row.needs_refresh for row in feedinfo.staleness(meta, now).collect()}
    assert rows == {"fresh": False, "edge": False, "old": True, "bad": True}


@pytest.mark.parametrize("age", [0, 59.9, 3600, 86399, 86400, 172805.5, 1e6, -5])
def test_feed_info(spark, age):
    now = 1704240000
    (row,) = feedinfo.feed_info(meta_frame(spark, s=f"{now - age}|7|u"), now).collect()
    assert row.age == str(timedelta(seconds=int(age)))
    assert row["count"] == 7
    updated = datetime.fromtimestamp(now - age, timezone.utc)
    assert row.updated == updated.strftime("%Y-%m-%d %H:%M:%S")


def test_publish_replaces_only_what_is_valid(spark, tmp_path):
    landing, target = tmp_path / "landing", str(tmp_path / "feeds")
    landing.mkdir()
    (landing / "firehol_level1.netset").write_text(NETSET)
    (landing / "emerging_threats.txt").write_text(ADDRESS_ONLY)
    (landing / "unrelated.netset").write_text("9.9.9.9\n")
    meta = jobs.publish_feeds(spark, str(landing), target, now=1000.0)
    counts = {row.source: row["count"] for row in meta.collect()}
    assert counts == {"firehol_level1": 6, "emerging_threats": 5}

    (landing / "firehol_level1.netset").write_text("# nothing valid\nbad\n")
    (landing / "emerging_threats.txt").write_text("192.0.2.77\n")
    meta = {row.source: row for row in jobs.publish_feeds(spark, str(landing), target, now=2000.0).collect()}
    assert (meta["firehol_level1"].timestamp, meta["firehol_level1"]["count"]) == (1000.0, 6)
    assert (meta["emerging_threats"].timestamp, meta["emerging_threats"]["count"]) == (2000.0, 1)
    assert meta["emerging_threats"].hash == hashlib.md5(
        f"2000.0:1:{feeds.DEFAULT_SOURCES['emerging_threats']}".encode()
    ).hexdigest()
    published = feeds.read_published(spark, target)
    assert entries(published.where("source = 'emerging_threats'")) == ["192.0.2.77"]
    assert published.where("source = 'firehol_level1'").count() == 6
    assert feeds.published_sources(spark, target) == ["emerging_threats", "firehol_level1"]

    info = {row.source: row for row in jobs.describe_feeds(spark, target, 2000.0 + 86401).collect()}
    assert info["emerging_threats"].needs_refresh and info["emerging_threats"].age == "1 day, 0:00:01"

    counts = {row.source: (row.entries, row.total_entries) for row in feeds.entry_counts(published).collect()}
    assert counts == {"firehol_level1": (6, 7), "emerging_threats": (1, 7)}


def test_named_sources_replace_the_defaults(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "blocklist_de.txt").write_text("192.0.2.1\n")
    (landing / "firehol_level1.netset").write_text(NETSET)
    meta = jobs.publish_feeds(spark, str(landing), str(tmp_path / "feeds"), 5.0, sources=["blocklist_de"])
    assert [row.source for row in meta.collect()] == ["blocklist_de"]


def test_reading_a_feed_folder(spark, tmp_path):
    (tmp_path / "firehol_level1.netset").write_text(NETSET)
    (tmp_path / "firehol_level1.meta").write_text("1609459200.0|7|u")
    raw = feeds.read_feed_lines(spark, str(tmp_path))
    assert {row.source for row in raw.collect()} == {"firehol_level1"}
    (meta,) = feeds.parse_meta(feeds.read_meta_files(spark, str(tmp_path))).collect()
    assert (meta.source, meta["count"]) == ("firehol_level1", 7)


def test_bad_stamps_spoil_their_own_source_only(spark):
    good = {"good": "1609459200.0|7|u", "json": '{"timestamp": 1609459200.25, "count": 1, "url": "u"}'}
    bad = {"micro": "1704067200000000.0|1|u", "nan": "nan|1|u", "inf": "inf|1|u", "big": '{"timestamp": 1e15, "count": 1}',
           "text": '{"timestamp": "1704067200", "count": 1, "url": "u"}', "none": "", "huge": "1e300|1|u"}
    meta = meta_frame(spark, **good, **bad)
    rows = {row.source: row.timestamp for row in meta.collect()}
    assert rows == {"good": 1609459200.0, "json": 1609459200.25, **dict.fromkeys(bad)}
    assert {row.source for row in feedinfo.feed_info(meta, 1609459300.0).collect()} == set(good)
    assert {row.source for row in feedinfo.staleness(meta, 1609459300.0).where("usable").collect()} == set(good)
    odd = spark.createDataFrame([("a", float("nan")), ("b", float("inf")), ("c", 5.0), ("d", None)], "source string, timestamp double")
    odd = odd.selectExpr("*", "1L AS count", "'u' AS url")
    assert [row.source for row in feedinfo.feed_info(odd, 9.0).collect()] == ["c"]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        feeds.read_published(spark, str(tmp_path))


def land(folder, **lines):
    folder.mkdir(exist_ok=True)
    for source, text in lines.items():
        (folder / f"{source}.netset").write_text(text)
    return str(folder)


def test_an_old_version_is_read_while_a_new_one_is_written(spark, tmp_path):
    target = str(tmp_path / "feeds")
    landing = land(tmp_path / "landing", firehol_level1="192.0.2.0/24\n", emerging_threats="198.51.100.7\n")
    jobs.publish_feeds(spark, landing, target, 10.0)
    first = feeds.published_version(spark, target)
    reading = feeds.read_published(spark, target)
    land(tmp_path / "landing", firehol_level1="203.0.113.0/24\n", emerging_threats="198.51.100.8\n")

    seen = []
    commit = feeds.snapshots.commit

    def slow(*arguments):
        # All of the new version is written; nobody sees any of it.
        seen.append((entries(feeds.read_published(spark, target)), {r.timestamp for r in feeds.read_published_meta(spark, target).collect()}))
        return commit(*arguments)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(feeds.snapshots, "commit", slow)
        jobs.publish_feeds(spark, landing, target, 20.0)
    assert seen == [(["192.0.2.0/24", "198.51.100.7"], {10.0})]
    assert entries(reading) == ["192.0.2.0/24", "198.51.100.7"]
    assert entries(feeds.read_published(spark, target)) == ["198.51.100.8", "203.0.113.0/24"]
    assert entries(feeds.read_published(spark, target, first)) == ["192.0.2.0/24", "198.51.100.7"]
    assert feeds.published_version(spark, target) > first

    assert feeds.snapshots.expire(spark, target, keep=1) == [first]
    assert entries(feeds.read_published(spark, target)) == ["198.51.100.8", "203.0.113.0/24"]
    with pytest.raises(FileNotFoundError):
        feeds.read_published(spark, target, first)


def test_two_publishers_keep_each_others_sources(spark, tmp_path):
    target, commit, turns = str(tmp_path / "feeds"), feeds.snapshots.commit, []

    def overtaken(*arguments):
        if not turns:
            turns.append(1)
            feeds.publish(spark.createDataFrame([("b", "192.0.2.2")], "source string, line string"), target, 2.0)
        return commit(*arguments)

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(feeds.snapshots, "commit", overtaken)
        feeds.publish(spark.createDataFrame([("a", "192.0.2.1")], "source string, line string"), target, 1.0)
    assert entries(feeds.read_published(spark, target)) == ["192.0.2.1", "192.0.2.2"]
    assert feeds.snapshots.versions(spark, target) == [1, 2]


def test_an_incomplete_version_is_passed_over(spark, tmp_path):
    target = str(tmp_path / "feeds")
    feeds.publish(spark.createDataFrame([("a", "192.0.2.1")], "source string, line string"), target, 1.0)
    (tmp_path / "feeds" / "versions" / f"{2:012d}").write_text("")
    assert feeds.published_version(spark, target) == 1
    feeds.publish(spark.createDataFrame([("b", "192.0.2.2")], "source string, line string"), target, 2.0)
    assert feeds.published_version(spark, target) == 3 and len(entries(feeds.read_published(spark, target))) == 2


def test_snapshots_of_older_releases_are_read_and_carried_on(spark, tmp_path):
    target = str(tmp_path / "feeds")
    old = feeds.load_entries(spark.createDataFrame([("a", "192.0.2.1")], "source string, line string"))
    old.write.partitionBy("source").parquet(f"{target}/networks")
    feeds.store_meta(meta_frame(spark, a="5.0|1|u"), f"{target}/meta")
    assert feeds.published_version(spark, target) == 0 and feeds.published_sources(spark, target) == ["a"]
    feeds.publish(spark.createDataFrame([("b", "192.0.2.2")], "source string, line string"), target, 2.0)
    assert entries(feeds.read_published(spark, target)) == ["192.0.2.1", "192.0.2.2"]
    assert feeds.published_sources(spark, target, 0) == ["a"]


def test_only_stale_sources_are_refreshed(spark, tmp_path):
    target = str(tmp_path / "feeds")
    landing = land(tmp_path / "landing", firehol_level1="192.0.2.0/24\n")
    jobs.publish_feeds(spark, landing, target, 100_000.0, only_stale=True)
    land(tmp_path / "landing", firehol_level1="203.0.113.0/24\n", emerging_threats="198.51.100.7\n")
    jobs.publish_feeds(spark, landing, target, 100_060.0, only_stale=True)
    assert entries(feeds.read_published(spark, target)) == ["192.0.2.0/24", "198.51.100.7"]
    assert jobs.stale_sources(spark, target, 100_060.0, ["firehol_level1", "other"]) == ["other"]
    jobs.publish_feeds(spark, landing, target, 186_401.0, only_stale=True)
    stamps = {r.source: r.timestamp for r in feeds.read_published_meta(spark, target).collect()}
    assert stamps == {"firehol_level1": 186_401.0, "emerging_threats": 100_060.0}


def test_older_metadata_is_stored_again_as_json(spark, tmp_path):
    (tmp_path / "old").mkdir()
    (tmp_path / "old" / "a.meta").write_text("1609459200.0|7|https://example.com/a")
    (tmp_path / "old" / "b.meta").write_text('{"timestamp": 5.5, "count": 1, "url": "u"}')
    (tmp_path / "old" / "c.meta").write_text("broken")
    rows = {r.source: r for r in jobs.convert_metadata(spark, str(tmp_path / "old"), str(tmp_path / "new")).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].url == "https://example.com/a" and rows["b"].timestamp == 5.5
    assert rows["a"].hash == hashlib.md5(b"1609459200.0:7:https://example.com/a").hexdigest()
    texts = [json.loads(f.read_text()) for f in (tmp_path / "new").glob("source=a/*.json")]
    assert [t["count"] for t in texts] == [7]
