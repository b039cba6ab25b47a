"""Reports against counting by hand."""

import random
from collections import Counter, defaultdict
from datetime import datetime

import pytest

from wallscope import cli
from wallscope.functions.services import SERVICE_NAMES
from wallscope.plans import jobs, reports

SCHEMA = (
    "id long, timestamp_local timestamp_ntz, interface string, direction string, protocol string, src_ip string,"
    " src_port string, dst_port string, geo_city string, geo_country_name string, geo_asn long, geo_asn_org string,"
    " threat_is_malicious boolean, threat_a boolean, threat_b boolean"
)


def make_rows(count=600, seed=9):
    from datetime import datetime

    rng = random.Random(seed)
    rows = []
    for i in range(count):
        # One country, one address and one port hold a third of the rows and more.
        country = rng.choice(["Big", "Big", "Small", "Tiny", "Other", None])
        a, b = rng.random() < 0.2, rng.random() < 0.1
        asn = rng.choice([1, 1, 2, 3, None])
        rows.append(
            (
                i,
                rng.choice([None, datetime(2025, 3, 17, rng.randrange(24), 5)]),
                rng.choice(["igb0", "igb1", None]),
                rng.choice(["in", "out", None]),
                rng.choice(["TCP", "UDP", "UDP", None]),
                rng.choice(["1.1.1.1", "1.1.1.1", "2.2.2.2", "3.3.3.3", None]),
                rng.choice(["443", "80", "5", "77777", None]),
                rng.choice(["22", "22", "23", "80", "443", "8080", "5984", "99999999999", None]),
                rng.choice(["X", "Y", "Z", None]),
                country,
                asn,
                rng.choice([None, f"org{asn}", f"org{asn}b"]) if asn else None,
                a or b,
                a,
                b,
            )
        )
    return rows


@pytest.fixture(scope="module")
def rows():
    names = [part.split()[0] for part in SCHEMA.split(",")]
    return [dict(zip(names, row)) for row in make_rows()]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(make_rows(), SCHEMA).repartition(7).cache()


def ranked(counter):
    return sorted(counter.items(), key=lambda item: (-item[1], item[0]))


@pytest.mark.parametrize("column", ["protocol", "interface", "src_port"])
def test_distribution(df, rows, column):
    counts = Counter(r[column] for r in rows if r[column] is not None)
    got = {r[column]: (r.connections, r.pct) for r in reports.value_distribution(df, column).collect()}
    assert got == {k: (n, n / len(rows) * 100) for k, n in counts.items()}


def test_distribution_of_nothing(df):
    assert reports.protocol_distribution(df.limit(0)).collect() == []


def test_interface_directions(df, rows):
    counts = Counter((r["interface"], r["direction"]) for r in rows if r["interface"] and r["direction"])
    want = sorted(counts.items(), key=lambda item: (item[0][0], -item[1], item[0][1]))
    got = [((r.interface, r.direction), r.connections) for r in reports.interface_directions(df).collect()]
    assert got == want


def test_hours_are_sorted_and_local(df, rows):
    counts = Counter(r["timestamp_local"].hour for r in rows if r["timestamp_local"])
    got = reports.hourly_traffic(df).collect()
    assert [(r.hour, r.connections) for r in got] == sorted(counts.items())
    assert got[0].pct == got[0].connections / len(rows) * 100


def test_source_ports(df, rows):
    counts = Counter(r["src_port"] for r in rows if r["src_port"])
    got = reports.source_ports(df, 3).collect()
    assert [(r.src_port, r.connections) for r in got] == ranked(counts)[:3]
    assert all(r.service == SERVICE_NAMES.get(int(r.src_port), "Unknown") for r in got)


def test_top_source_addresses(df, rows):
    counts = Counter(r["src_ip"] for r in rows if r["src_ip"])
    assert [tuple(r) for r in reports.top_source_addresses(df, 2).collect()] == ranked(counts)[:2]


@pytest.mark.parametrize(
    ("key", "report", "ports"),
    [
        ("geo_city", reports.top_cities, reports.city_ports),
        ("geo_country_name", reports.top_countries, reports.country_ports),
        ("geo_asn", reports.top_asns, reports.asn_ports),
    ],
)
def test_locations_and_ports(df, rows, key, report, ports):
    known = [r for r in rows if r[key] is not None]
    top = ranked(Counter(r[key] for r in known))[:2]
    got = report(df, 2).collect()
    sources = {k: {r["src_ip"] for r in known if r[key] == k} - {None} for k, _ in top}
    assert [(r[0], r.connections, r.unique_sources) for r in got] == [(k, n, len(sources[k])) for k, n in top]
    if key == "geo_asn":
        orgs = [min(r["geo_asn_org"] for r in known if r[key] == k and r["geo_asn_org"]) for k, _ in top]
        assert [r.asn_org for r in got] == orgs

    want = []
    for name, total in top:
        here = [r for r in known if r[key] == name and r["dst_port"]]
        for rank, (port, n) in enumerate(ranked(Counter(r["dst_port"] for r in here))[:3], 1):
            unique = len({r["src_ip"] for r in here if r["dst_port"] == port} - {None})
            service = SERVICE_NAMES.get(int(port), "Unknown")
            want.append((name, total, rank, port, service, n, n / total * 100, unique))
    assert [tuple(r) for r in ports(df, 2, 3).collect()] == want


def test_owner_without_any_name(spark):
    frame = spark.createDataFrame([(7, None, "1.1.1.1")], "asn long, asn_org string, src_ip string")
    assert [tuple(r) for r in reports.top_asns(frame).collect()] == [(7, 1, 1, "Unknown")]


def test_owner_columns(df, spark):
    assert reports.asn_columns(df) == ("geo_asn", "geo_asn_org")
    assert reports.asn_columns(df.withColumnsRenamed({"geo_asn": "asn", "geo_asn_org": "asn_org"})) == ("asn", "asn_org")
    assert reports.asn_columns(df.drop("geo_asn")) is None
    with pytest.raises(ValueError):
        reports.top_asns(df.drop("geo_asn"))


def test_threat_summary(df, rows):
    hits = sum(r["threat_is_malicious"] for r in rows)
    assert tuple(reports.threat_summary(df).first()) == (hits, len(rows), hits / len(rows) * 100)
    assert tuple(reports.threat_summary(df.limit(0)).first()) == (0, 0, 0.0)


def test_threat_by_source(df, rows):
    want = [(s, n, n / len(rows) * 100) for s in "ab" if (n := sum(r[f"threat_{s}"] for r in rows))]
    assert [tuple(r) for r in reports.threat_by_source(df).collect()] == want
    only_a = df.where("NOT threat_b")
    assert [r.source for r in reports.threat_by_source(only_a).collect()] == ["a"]


def test_threat_by_country(df, rows):
    total = Counter(r["geo_country_name"] for r in rows if r["geo_country_name"])
    bad = Counter(r["geo_country_name"] for r in rows if r["geo_country_name"] and r["threat_is_malicious"])
    want = [(k, n, total[k], n / total[k] * 100) for k, n in ranked(bad)[:3]]
    assert [tuple(r) for r in reports.threat_by_country(df, 3).collect()] == want


def test_threat_by_asn(df, rows):
    total = Counter(r["geo_asn"] for r in rows if r["geo_asn"])
    bad = defaultdict(int)
    for r in rows:
        if r["geo_asn"] and r["geo_asn_org"] and r["threat_is_malicious"]:
            bad[r["geo_asn"], r["geo_asn_org"]] += 1
    want = [(*k, n, total[k[0]], n / total[k[0]] * 100) for k, n in ranked(bad)[:4]]
    assert [tuple(r) for r in reports.threat_by_asn(df, 4).collect()] == want


def test_enrichment_summary(df, rows):
    row = reports.enrichment_summary(df).first()
    assert row.total == len(rows)
    assert row.geo_resolved == sum(r["geo_country_name"] is not None for r in rows)
    assert row.asn_resolved == sum(r["geo_asn"] is not None for r in rows)
    assert row.malicious_connections_pct == sum(r["threat_is_malicious"] for r in rows) / len(rows) * 100
    assert "malicious_connections" not in reports.enrichment_summary(df.drop("threat_is_malicious")).columns


def test_leading_countries(df, rows):
    counts = Counter(r["geo_country_name"] for r in rows if r["geo_country_name"])
    want = [(k, n, n / len(rows) * 100) for k, n in ranked(counts)[:3]]
    assert [tuple(r) for r in reports.leading_countries(df).collect()] == want


def test_samples(df, rows):
    sample = reports.sample_malicious(df, limit=4, order=["id"], keep=["id"])
    assert sample.columns == ["id", "src_ip", "threat_is_malicious", "threat_a", "threat_b"]
    assert [r.id for r in sample.collect()] == [r["id"] for r in rows if r["threat_is_malicious"]][:4]
    sample = reports.sample_enriched(df, limit=2, order=["id"])
    assert sample.columns[:4] == ["src_ip", "geo_city", "geo_country_name", "geo_asn"]
    assert "geo_asn_org" in reports.sample_enriched(df, order=["id"], per_kind=None).columns


def test_report_selection(df):
    everything = dict.fromkeys(("protocol", "hourly", "source_ports", "interfaces", "asn", "threat_intel"), True)
    base = ["top_cities", "city_ports", "top_countries", "country_ports"]
    assert list(jobs.traffic_reports(df)) == base
    assert len(jobs.traffic_reports(df, **everything)) == 4 + 1 + 1 + 1 + 2 + 2 + 4
    plain = df.drop("geo_asn", "threat_is_malicious")
    assert len(jobs.traffic_reports(plain, **everything)) == 4 + 1 + 1 + 1 + 2
    with pytest.raises(ValueError):
        jobs.traffic_reports(df.drop("dst_port"))


def test_rows_are_aggregated_once_for_their_shares(spark, df, tmp_path):
    path = str(tmp_path / "stored")
    df.write.parquet(path)
    report = reports.protocol_distribution(spark.read.parquet(path))
    report.collect()
    plan = report._jdf.queryExecution().executedPlan().toString()
    assert "ReusedExchange" in plan


def test_samples_are_ordered_to_the_last_column(spark):
    rows = [(None, "c", 1), (datetime(2025, 1, 1), "b", 2), (datetime(2025, 1, 1), "a", 9), (datetime(2024, 1, 1), "z", 0)]
    df = spark.createDataFrame(rows, "timestamp timestamp, src_ip string, length int")
    assert [row.src_ip for row in reports.sample_parsed(df, 4).collect()] == ["z", "a", "b", "c"]


def test_every_printed_row_is_printed(spark, capsys):
    cli._show("Rows", spark.range(2500))
    assert len(capsys.readouterr().out.splitlines()) == 2503


def test_sketches_of_days_merge_within_their_bound(spark):
    """Sources that come back every day count once; an exact small number, a bounded error for a large one."""
    rows = spark.range(60_000).selectExpr(
        "IF(id % 10 = 0, 'small', 'large') AS geo_city",
        "IF(id % 10 = 0, concat('10.0.0.', id % 7), concat('20.', id % 20000)) AS src_ip",
        "CASE WHEN id % 997 <> 0 THEN timestamp_ntz '2025-03-17 12:00:00' + make_dt_interval(id % 5) END AS timestamp_local",
    )
    days = reports.daily_sources(rows, "geo_city")
    assert days.select("day").distinct().count() == 6
    merged = {r.geo_city: r for r in reports.merged_locations(days, "geo_city").collect()}
    exact = {r.geo_city: r for r in reports.top_cities(rows).collect()}
    for city in ("small", "large"):
        assert merged[city].connections == exact[city].connections
        assert abs(merged[city].unique_sources - exact[city].unique_sources) <= 3 * 1.04 / 64 * exact[city].unique_sources
    assert merged["small"].unique_sources == exact["small"].unique_sources == 7
    # Part of the days alone.
    one = reports.merged_locations(days.where("day = date '2025-03-17'"), "geo_city").collect()
    assert sum(r.connections for r in one) < 60_000 / 4
