"""The line parser: literal lines, quirks, files and folders."""

import gzip
from datetime import datetime

import pytest

from wallscope.functions.text import WHITESPACE
from wallscope.operators.parse import parse_lines, rejected_lines
from wallscope.plans import jobs, reports
from wallscope.schemas import PARSED
from wallscope.sources.logs import read_lines

HEAD = "edge-gw.test.invalid pf[417] 00:00:01.250031 rule 7.qLmn.12/0(match): block in on igb0:"
TCP = (
    f"2024-11-05T09:31:47+00:00 {HEAD} 45.83.66.190.51007 > 81.17.24.9.8443: "
    "Flags [S], seq 305419896, win 4096, options [mss 1400,nop,wscale 7], length 0"
)
UDP = f"2024-11-05T09:40:02+00:00 {HEAD} 91.198.174.5.123 > 81.17.24.9.41190: UDP, length 48"


def packet(time="2025-03-17T14:54:08+00:00", head=HEAD, flow="1.2.3.4.5 > 6.7.8.9.10", info="UDP, length 1"):
    return f"{time} {head} {flow}: {info}"


def parse(spark, *lines):
    return parse_lines(spark.createDataFrame([(line,) for line in lines], "value string")).collect()


def test_schema_is_fixed(spark):
    parsed = parse_lines(spark.createDataFrame([(TCP,)], "value string"))
    assert [(f.name, f.dataType) for f in parsed.schema] == [(f.name, f.dataType) for f in PARSED]


def test_tcp_line(spark):
    (row,) = parse(spark, TCP)
    assert row.hostname == "edge-gw.test.invalid"
    assert (row.action, row.direction, row.interface) == ("block", "in", "igb0")
    assert (row.elapsed, row.rule_info) == ("00:00:01.250031", "7.qLmn.12/0(match)")
    assert (row.src_ip, row.src_port, row.dst_ip, row.dst_port) == ("45.83.66.190", "51007", "81.17.24.9", "8443")
    assert (row.protocol, row.tcp_flags, row.seq, row.win, row.length) == ("TCP", "S", 305419896, 4096, 0)
    assert row.timestamp_local == datetime(2024, 11, 5, 9, 31, 47)


def test_udp_line(spark):
    (row,) = parse(spark, UDP)
    assert (row.src_port, row.dst_port, row.protocol, row.length) == ("123", "41190", "UDP", 48)
    assert (row.tcp_flags, row.seq, row.win) == (None, None, None)


@pytest.mark.parametrize(
    "line",
    [
        "This is not a valid log line",
        "",
        packet(time="2025-03-17T14:54:08-05:00"),
        packet(time="2025-03-17T14:54:08Z"),
        packet(time="2025-03-17T14:54:08.123+00:00"),
        packet(flow="2001:db8::1.5 > 6.7.8.9.10"),
        packet(head=HEAD.replace("igb0", "vlan0.100")),
        "x " + packet(),
        "\x01" * 11,
        # Stripping removes the white space that has to follow the colon.
        packet(info="  "),
        packet(info=""),
    ],
)
def test_no_log_entry(spark, line):
    assert parse(spark, line) == []


def test_rejects_are_the_complement(spark):
    lines = [TCP, " junk ", "", UDP + "  "]
    raw = spark.createDataFrame([(line,) for line in lines], "value string")
    assert sorted(row.line for row in rejected_lines(raw).collect()) == ["", "junk"]
    assert parse_lines(raw).count() == 2


def test_surrounding_white_space(spark):
    for char in WHITESPACE:
        (row,) = parse(spark, f"{char}{packet()}{char}{char}")
        assert row.protocol_info == "UDP, length 1", repr(char)


def test_white_space_set_is_that_of_python():
    assert set(WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_unicode_words_and_spaces(spark):
    (row,) = parse(spark, packet(head=HEAD.replace("edge", "größe").replace(" rule ", " rule\xa0")))
    assert row.hostname == "größe-gw.test.invalid"


def test_invalid_utf8_is_replaced(spark, tmp_path):
    (tmp_path / "a.log").write_bytes(packet(info="UDP \xff").encode("latin-1") + b"\n")
    (row,) = parse_lines(read_lines(spark, str(tmp_path))).collect()
    assert row.protocol_info == "UDP �"


def test_offsets(spark):
    rows = parse(
        spark,
        packet(time="2025-03-17T14:54:08+02:00"),
        packet(time="2025-03-17T14:54:08+23:59"),
        packet(time="2025-03-17T14:54:08+00:00"),
    )
    assert [row.timestamp_local.hour for row in rows] == [14, 14, 14]
    times = [row.timestamp.timestamp() for row in rows]
    assert times[2] - times[0] == 2 * 3600
    assert times[2] - times[1] == 23 * 3600 + 59 * 60


@pytest.mark.parametrize(
    "time",
    [
        "2025-13-17T14:58:10+00:00",
        "2025-02-30T14:58:10+00:00",
        "2025-03-17T24:00:00+00:00",
        "2025-03-17T14:54:60+00:00",
        "2025-03-17T14:54:08+24:00",
        "0000-03-17T14:54:08+00:00",
    ],
)
def test_impossible_time_keeps_the_row(spark, time):
    with pytest.raises(ValueError):
        datetime.fromisoformat(time)
    (row,) = parse(spark, packet(time=time))
    assert (row.timestamp, row.timestamp_local, row.timestamp_raw) == (None, None, time)


def test_packet_without_ports(spark):
    (row,) = parse(spark, packet(flow="1.2.3.4 > 5.6.7.8", info="ICMP echo request, length 64"))
    assert (row.src_ip, row.src_port, row.dst_ip, row.dst_port) == ("1.2.3", "4", "5.6.7", "8")
    assert row.protocol == "ICMP"


@pytest.mark.parametrize(
    ("info", "protocol"),
    [
        ("UDP, ICMP, Flags [S]", "UDP"),
        ("ICMP Flags [S]", "ICMP"),
        ("Flags [S]", "TCP"),
        ("Flags", "TCP"),
        ("udp icmp flags", "OTHER"),
    ],
)
def test_protocol_first_hit_wins(spark, info, protocol):
    assert parse(spark, packet(info=info))[0].protocol == protocol


def test_numbers(spark):
    info = "Flags [P.], seq 10:20, ack 1, win 512, length 9, length 7"
    (row,) = parse(spark, packet(info=info))
    assert (row.tcp_flags, row.seq, row.win, row.length) == ("P.", 10, 512, 9)
    (row,) = parse(spark, packet(info="UDP, length 99999999999999999999"))
    assert row.length is None


def test_folder_of_plain_and_gzip_files(spark, tmp_path):
    (tmp_path / "a.log").write_text(TCP + "\n" + UDP + "\r\njunk\n")
    with gzip.open(tmp_path / "b.log.gz", "wt") as file:
        file.write(UDP + "\n")
    (tmp_path / "d.log.1").write_text(UDP)
    (tmp_path / "notes.txt").write_text(UDP)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "c.log").write_text(UDP)
    parsed = jobs.parse_logs(spark, str(tmp_path))
    assert parsed.count() == 4
    assert jobs.parse_logs(spark, str(tmp_path), pattern="*.gz").count() == 1
    # A single file is read whatever its name is.
    assert jobs.parse_logs(spark, str(tmp_path / "notes.txt")).count() == 1


def test_only_lines_of_gzip_files_are_dealt_anew(spark, tmp_path):
    with gzip.open(tmp_path / "a.log.gz", "wt") as file:
        file.write((UDP + "\n") * 100)
    (tmp_path / "b.log").write_text(TCP)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert read_lines(spark, str(tmp_path)).count() == 101
    assert plan(read_lines(spark, str(tmp_path))).count("Exchange") == 1
    assert "Exchange" not in plan(read_lines(spark, str(tmp_path / "b.log")))
    assert "Exchange" not in plan(read_lines(spark, str(tmp_path), "b.*"))
    assert read_lines(spark, str(tmp_path), "*.gz", partitions=3).rdd.getNumPartitions() == 3


def test_parse_to_parquet(spark, tmp_path):
    (tmp_path / "a.log").write_text(TCP + "\n" + UDP)
    out = str(tmp_path / "parsed")
    stored = jobs.parse_logs(spark, str(tmp_path / "a.log"), out)
    assert sorted(row.protocol for row in stored.collect()) == ["TCP", "UDP"]
    assert spark.read.parquet(out).count() == 2


def test_missing_input(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        jobs.parse_logs(spark, str(tmp_path / "nothing"))


def test_protocol_distribution(spark):
    raw = spark.createDataFrame([(TCP,), (UDP,), (UDP,), ("junk",)], "value string")
    rows = reports.protocol_distribution(parse_lines(raw)).collect()
    assert [(r.protocol, r.connections) for r in rows] == [("UDP", 2), ("TCP", 1)]
    assert rows[0].pct == 2 / 3 * 100


def test_the_pattern_runs_once_per_line(spark):
    raw = spark.createDataFrame([(TCP,)], "value string")
    plan = parse_lines(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert "Exchange" not in plan
