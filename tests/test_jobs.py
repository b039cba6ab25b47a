"""The command line from raw files to reports, and the streaming jobs."""

import gzip
import os

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tests.test_feeds import ADDRESS_ONLY, NETSET
from wallscope import cli
from wallscope.operators import parse
from wallscope.plans import jobs, reports
from wallscope.sources.logs import write_table
from wallscope.session import scratch_path, scratch_root, scratch_scope
from wallscope.streaming import pipelines

HEAD = "fw.example.net pf[1] 00:00:05.6 rule 1.a.4/0(match):"


def log_line(i, src):
    return (
        f"2025-03-17T1{i % 10}:54:08+02:00 {HEAD} block in on igb{i % 2}: {src}.{1024 + i} > 81.17.24.103.22: "
        f"Flags [S], seq {i}, win 1024, length 0"
    )


SOURCES = ["8.8.8.8", "185.220.101.9", "45.95.146.77", "9.9.9.9", "10.0.0.1"]


@pytest.fixture()
def inputs(spark, tmp_path):
    logs = tmp_path / "logs"
    logs.mkdir()
    (logs / "pf.log").write_text("\n".join(log_line(i, SOURCES[i % 5]) for i in range(40)) + "\njunk\n")
    landing = tmp_path / "landing"
    landing.mkdir()
    (landing / "firehol_level1.netset").write_text(NETSET)
    (landing / "emerging_threats.txt").write_text(ADDRESS_ONLY)
    cities = spark.createDataFrame(
        [("8.8.8.0/24", "United States", "New York"), ("9.0.0.0/8", "Elsewhere", None)],
        "network string, country_name string, city string",
    )
    owners = spark.createDataFrame([("8.8.8.0/24", 15169, "Google LLC")], "network string, asn long, asn_org string")
    write_table(cities, str(tmp_path / "cities"))
    write_table(owners, str(tmp_path / "owners"))
    jobs.build_networks(spark, str(tmp_path / "cities"), str(tmp_path / "geo"), "geo")
    jobs.build_networks(spark, str(tmp_path / "owners"), str(tmp_path / "asn"), "asn")
    return tmp_path


def run(*args):
    return cli.main([str(arg) for arg in args])


def test_whole_chain(spark, inputs, capsys):
    parsed, enriched, published = inputs / "parsed", inputs / "enriched", inputs / "feeds"
    assert run("parse", inputs / "logs", "-o", parsed) == 0
    assert spark.read.parquet(str(parsed)).count() == 40
    assert run("parse", inputs / "logs", "--sample", 2) == 0
    assert "TCP" in capsys.readouterr().out

    assert run("networks", "geo", inputs / "cities", inputs / "geo") == 0
    assert run("publish", inputs / "landing", published) == 0
    assert run("threat", "-t", published, "--info") == 0
    assert "emerging_threats" in capsys.readouterr().out

    assert run("geo", parsed, "-g", inputs / "geo", "-a", inputs / "asn", "-o", inputs / "geo_only") == 0
    assert "threat_is_malicious" not in spark.read.parquet(str(inputs / "geo_only")).columns
    assert run("threat", parsed, "-t", published, "-o", inputs / "threat_only") == 0
    assert run(
        "enrich", parsed, "-g", inputs / "geo", "-a", inputs / "asn", "-t", published, "-o", enriched
    ) == 0
    rows = spark.read.parquet(str(enriched)).collect()
    assert len(rows) == 40
    by_ip = {r.src_ip: (r.geo_city, r.geo_asn, r.threat_is_malicious) for r in rows}
    assert by_ip == {
        "8.8.8.8": ("New York", 15169, False),
        "185.220.101.9": (None, None, True),
        "45.95.146.77": (None, None, True),
        "9.9.9.9": (None, None, False),
        "10.0.0.1": (None, None, False),
    }

    flags = ["--protocol", "--hourly", "--source-ports", "--interfaces", "--asn", "--threat-intel"]
    assert run("report", enriched, "-n", 3, "-p", 2, *flags) == 0
    assert "New York" in capsys.readouterr().out
    assert run("report", enriched, *flags, "-o", inputs / "reports") == 0
    summary = spark.read.parquet(str(inputs / "reports" / "threat_summary")).first()
    assert (summary.malicious_connections, summary.total, summary.pct) == (16, 40, 40.0)


def test_grouped_rows_give_the_same_reports(spark, inputs):
    jobs.publish_feeds(spark, str(inputs / "landing"), str(inputs / "feeds"), 5.0)
    parsed = jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"))
    df = jobs.enrich_logs(
        spark, parsed, geo_path=str(inputs / "geo"), asn_path=str(inputs / "asn"),
        feeds_path=str(inputs / "feeds"), output_path=str(inputs / "enriched"),
    )
    some = {name: True for name in ("protocol", "hourly", "source_ports", "interfaces", "asn", "threat_intel")}
    with scratch_scope(spark):
        chosen = jobs.traffic_reports(df, **some)
        assert len(chosen) == 15
        direct = {name: getattr(reports, name)(df) for name in chosen}
        for name, report in chosen.items():
            assert report.schema.simpleString() == direct[name].schema.simpleString()
            assert report.collect() == direct[name].collect(), name
        log = [name for name, report in chosen.items() if str(inputs / "enriched") in "".join(report.inputFiles())]
        assert log == []
        empty = jobs.traffic_reports(df.limit(0), **some)
        assert empty["threat_summary"].collect() == reports.threat_summary(df.limit(0)).collect()

        skipped = []
        few = df.select("geo_city", "geo_country_name", "dst_port", "src_ip", F.col("timestamp_raw").alias("timestamp"))
        left = jobs.traffic_reports(few, **some, on_skip=lambda name, columns: skipped.append(name))
        assert set(left) | set(skipped) == set(chosen) and len(left) == 5
        assert left["hourly_traffic"].collect() == direct["hourly_traffic"].collect()


def test_publish_tells_what_failed(spark, inputs, capsys):
    (inputs / "landing" / "emerging_threats.txt").write_text("# nothing\n")
    netset = inputs / "landing" / "firehol_level1.netset"
    (inputs / "landing" / "firehol_level1.netset.gz").write_bytes(gzip.compress(netset.read_bytes()))
    netset.unlink()
    assert run("publish", inputs / "landing", inputs / "feeds") == 1
    assert "not published: emerging_threats" in capsys.readouterr().err
    assert run("publish", inputs / "landing", inputs / "feeds", "--source", "firehol_level1") == 0
    (inputs / "landing" / "emerging_threats.txt").write_text(ADDRESS_ONLY)
    assert run("publish", inputs / "landing", inputs / "feeds") == 0
    asked = ["firehol_level1", "blocklist_de"]
    outcome = jobs.publish_outcome(spark, str(inputs / "feeds"), 1.0, asked).collect()
    assert [tuple(row) for row in outcome] == [("blocklist_de", "missing"), ("firehol_level1", "kept")]


def test_errors(inputs, capsys):
    assert run("parse", inputs / "missing") == 1
    assert run("report", inputs / "missing") == 1
    assert run("geo", inputs / "missing", "-g", inputs / "geo") == 1
    assert run("geo", inputs / "geo", "-g", inputs / "missing") == 1
    assert run("geo", inputs / "geo", "-g", inputs / "geo") == 1  # no src_ip column
    assert run("threat", "-t", inputs / "missing") == 1
    assert "error:" in capsys.readouterr().err


def test_intermediate_tables_are_removed(spark, inputs):
    root = scratch_root(spark)
    before = set(os.listdir(root))
    jobs.publish_feeds(spark, str(inputs / "landing"), str(inputs / "feeds"), 5.0)
    jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"))
    jobs.enrich_logs(spark, str(inputs / "parsed"), geo_path=str(inputs / "geo"), output_path=str(inputs / "out"))
    assert set(os.listdir(root)) == before
    with pytest.raises(KeyError), scratch_scope(spark):
        path = scratch_path(spark, "x")
        spark.range(3).write.parquet(path)
        raise KeyError
    assert not os.path.exists(path)


def test_wrappers(spark, inputs):
    parsed = jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"))
    geo = jobs.enrich_logs_with_geo(spark, str(inputs / "parsed"), str(inputs / "geo"), asn_path=str(inputs / "asn"))
    assert geo.count() == 40
    jobs.publish_feeds(spark, str(inputs / "landing"), str(inputs / "feeds"), 5.0)
    both = jobs.enrich_logs_with_threats(spark, geo, str(inputs / "feeds"), "dst_ip", str(inputs / "out"))
    assert both.where("threat_is_malicious").count() == 0
    assert set(parsed.columns) < set(both.columns)


def test_streams(spark, inputs):
    raw, parsed, enriched = inputs / "logs", inputs / "stream_parsed", inputs / "stream_enriched"
    jobs.publish_feeds(spark, str(inputs / "landing"), str(inputs / "feeds"), 5.0)

    def run_both():
        frame = pipelines.stream_parsed(spark, str(raw))
        pipelines.start_parse(frame, str(parsed), str(inputs / "state1"), available_now=True).awaitTermination()
        pipelines.start_enrich(
            spark,
            str(parsed),
            str(enriched),
            str(inputs / "state2"),
            geo=lambda: spark.read.parquet(str(inputs / "geo")),
            feeds_path=str(inputs / "feeds"),
            available_now=True,
            max_files_per_trigger=1,
        ).awaitTermination()
        return spark.read.parquet(str(enriched))

    first = run_both()
    assert first.count() == 40
    assert first.where("threat_is_malicious").count() == 16
    assert run_both().count() == 40  # nothing new

    # A new file and a refreshed feed: only new rows see the new feed.
    (raw / "more.log").write_text(log_line(1, "9.9.9.9") + "\n")
    (inputs / "landing" / "emerging_threats.txt").write_text("9.9.9.9\n")
    jobs.publish_feeds(spark, str(inputs / "landing"), str(inputs / "feeds"), 6.0)
    second = run_both()
    assert second.count() == 41
    assert second.where("src_ip = '9.9.9.9' AND threat_is_malicious").count() == 1


def test_reports_group_only_what_is_selected_in_one_scan(spark, inputs, monkeypatch):
    parsed = jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"))
    df = jobs.enrich_logs(spark, parsed, geo_path=str(inputs / "geo"), output_path=str(inputs / "enriched"))
    stored, materialize = [], reports.materialize

    def watched(table, *arguments, **options):
        stored.append(table)
        return materialize(table, *arguments, **options)

    monkeypatch.setattr(reports, "materialize", watched)
    jobs.traffic_reports(df)
    jobs.traffic_reports(df, protocol=True, source_ports=True, interfaces=True)
    always = {"geo_city", "geo_country_name", "dst_port", "src_ip"}
    for table, columns in zip(stored, (always, always | {"protocol", "src_port", "interface", "direction"}), strict=True):
        assert set(table.columns) == columns | {reports.ROWS, reports._SET}
        plan = table._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") == 1 and plan.count("Expand") == 1 and "Join" not in plan
        (read,) = [line for line in plan.splitlines() if "FileScan" in line]
        schema = read[read.index("ReadSchema") :]
        assert {name for name in df.columns if f"{name}:" in schema} <= columns


def test_a_repeated_batch_uses_the_feeds_it_used_before(spark, inputs):
    """A batch fails after its work, the feeds change, the batch runs again."""
    landing, target, output = str(inputs / "landing"), str(inputs / "feeds"), str(inputs / "replayed")
    jobs.publish_feeds(spark, landing, target, 5.0)
    jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"))

    def run(fails):
        enrich, state = pipelines.enrich, str(inputs / "state")

        def broken(*arguments, **options):
            enrich(*arguments, **options).write.mode("overwrite").parquet(f"{output}/batch_id=0")
            raise RuntimeError("lost")

        with pytest.MonkeyPatch.context() as patch:
            if fails:
                patch.setattr(pipelines, "enrich", broken)
            query = pipelines.start_enrich(spark, str(inputs / "parsed"), output, state, feeds_path=target, available_now=True)
            query.awaitTermination()
        return spark.read.parquet(output)

    with pytest.raises(Exception, match="lost"):
        run(fails=True)
    before = {(r.src_ip, r.threat_is_malicious) for r in spark.read.parquet(output).collect()}
    (inputs / "landing" / "emerging_threats.txt").write_text("9.9.9.9\n")
    (inputs / "landing" / "firehol_level1.netset").write_text("9.9.9.0/24\n")
    jobs.publish_feeds(spark, landing, target, 6.0)
    rows = run(fails=False)
    assert rows.count() == 40 and {(r.src_ip, r.threat_is_malicious) for r in rows.collect()} == before
    assert rows.where("src_ip = '9.9.9.9' AND threat_is_malicious").count() == 0


def test_counts_are_observed_in_the_same_pass(spark, inputs):
    counts = Observation("lines")
    parsed = jobs.parse_logs(spark, str(inputs / "logs"), str(inputs / "parsed"), counts=counts)
    assert counts.get == {"lines": 41, "parsed": 40, "rejected": 1} and parsed.count() == 40
    plan = parse.parse_lines(spark.read.text(str(inputs / "logs")), counts=Observation("more"))._jdf.queryExecution()
    assert plan.executedPlan().toString().count("regexp_replace(line") == 1


def test_a_stream_splits_rejects_off_in_one_pass(spark, inputs):
    raw, output, rejects, state = (str(inputs / name) for name in ("logs", "split", "rejects", "state"))

    def run():
        pipelines.start_parse_all(spark, raw, output, rejects, state, available_now=True).awaitTermination()
        parsed, lines = pipelines.read_parsed(spark, output), pipelines.read_rejects(spark, rejects)
        return parsed, sorted(r.line for r in lines.collect())

    parsed, lines = run()
    direct = parse.parse_lines(spark.read.text(raw))
    assert parsed.schema.simpleString() == direct.schema.simpleString()
    assert sorted(map(str, parsed.collect())) == sorted(map(str, direct.collect())) and lines == ["junk"]
    # A batch without any reject, and one that nothing is left of.
    (inputs / "logs" / "b.log").write_text(log_line(3, "9.9.9.9") + "\n")
    assert (run()[0].count(), run()[1]) == (41, ["junk"])
    (inputs / "logs" / "c.log").write_text("  more junk \n")
    assert (run()[0].count(), run()[1]) == (41, ["junk", "more junk"])
    plan = parse.parse_all(spark.read.text(raw))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(line") == 1
    assert not [name for name in os.listdir(output) if name.startswith("_staged")]
