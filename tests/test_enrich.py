"""Enrichment of rows and addresses."""

import pytest

from wallscope.operators import enrich
from wallscope.operators.enrich import GEO_COLUMNS, MALICIOUS
from wallscope.session import materialize
from wallscope.sources import feeds
from wallscope.sources.networks import asn_networks, geo_networks

CITIES = [
    ("62.40.0.0/16", "NO", "Norway", None, 64.5),
    ("62.40.8.0/24", "NO", "Norway", "Tromso", 69.65),
    ("2a0c:9a40::/32", "PT", "Portugal", "Faro", 37.0),
    ("203.0.113.0/24", "XX", "Nowhere", "Hidden", 1.0),
    ("0.0.0.0/1", "ZZ", "Half", None, 0.0),
]
OWNERS = [("62.40.8.0/24", 64510, "Fjord Net"), ("91.20.3.0/24", 64511, None)]


@pytest.fixture(scope="module")
def geo(spark):
    frame = spark.createDataFrame(
        CITIES, "network string, country_code string, country_name string, city string, latitude double"
    )
    return materialize(geo_networks(frame), "geo")


@pytest.fixture(scope="module")
def asn(spark):
    frame = spark.createDataFrame(OWNERS, "network string, asn long, asn_org string")
    return materialize(asn_networks(frame), "asn")


def threat_frame(spark, **sets):
    rows = [(source, line) for source, listed in sets.items() for line in listed]
    return feeds.load_entries(spark.createDataFrame(rows, "source string, line string"))


@pytest.fixture(scope="module")
def threats(spark):
    return threat_frame(
        spark,
        alpha=["45.83.1.9", "45.83.1.10", "77.91.64.0/20", "2a0c:9a40::/29"],
        beta=["120.5.6.7", "120.5.6.8", "77.91.65.0/24"],
    )


def events(spark, *addresses):
    rows = [(i, a, "10.0.0.1") for i, a in enumerate(addresses)]
    return spark.createDataFrame(rows, "id long, src_ip string, dst_ip string")


ADDRESSES = ["62.40.8.21", "62.40.9.30", "62.40.8.21", "10.1.1.1", "203.0.113.77", "91.20.3.4", "2a0c:9a40::1", "bad", None, "200.1.1.1"]


def test_geo(spark, geo, asn):
    rows = enrich.enrich_with_geolocation(events(spark, *ADDRESSES), geo, asn=asn).sort("id").collect()
    got = [(r.src_ip, r.geo_country_code, r.geo_city, r.geo_asn, r.geo_asn_org, r.geo_network) for r in rows]
    fjord = (64510, "Fjord Net", "62.40.8.0/24")
    assert got == [
        ("62.40.8.21", "NO", "Tromso", *fjord),
        ("62.40.9.30", "NO", None, None, None, None),
        ("62.40.8.21", "NO", "Tromso", *fjord),
        ("10.1.1.1", None, None, None, None, None),  # private
        ("203.0.113.77", None, None, None, None, None),  # documentation range
        ("91.20.3.4", "ZZ", None, 64511, None, "91.20.3.0/24"),
        ("2a0c:9a40::1", "PT", "Faro", None, None, None),
        ("bad", None, None, None, None, None),
        (None, None, None, None, None, None),
        ("200.1.1.1", None, None, None, None, None),
    ]


def test_columns(spark, geo):
    frame = enrich.enrich_with_geolocation(events(spark, "62.40.8.21"), geo)
    assert frame.columns == ["id", "src_ip", "dst_ip", *GEO_COLUMNS]
    types = dict(frame.dtypes)
    assert types["geo_asn"] == "bigint" and types["geo_accuracy_radius"] == "int"
    assert frame.first().geo_asn is None


def test_other_column_and_no_name_clash(spark, geo):
    frame = events(spark, "62.40.8.21").withColumnsRenamed({"src_ip": "ip", "dst_ip": "n"})
    (row,) = enrich.enrich_with_geolocation(frame, geo, "ip").collect()
    assert (row.ip, row.n, row.geo_city) == ("62.40.8.21", "10.0.0.1", "Tromso")


def test_enriching_again_replaces(spark, geo):
    once = enrich.enrich_with_geolocation(events(spark, "62.40.8.21"), geo)
    again = enrich.enrich_with_geolocation(once, geo, "dst_ip")
    assert again.columns == once.columns
    assert again.first().geo_city is None


def test_missing_column(spark, geo, threats):
    with pytest.raises(ValueError):
        enrich.enrich_with_geolocation(events(spark, "62.40.8.21"), geo, "nope")
    with pytest.raises(ValueError):
        enrich.enrich_with_threats(events(spark, "62.40.8.21"), threats, "nope")


def test_empty_input(spark, geo, asn, threats):
    frame = enrich.enrich(events(spark, "62.40.8.21").limit(0), "src_ip", geo, asn, threats, ["alpha"])
    assert frame.count() == 0
    assert frame.columns == ["id", "src_ip", "dst_ip", *GEO_COLUMNS, MALICIOUS, "threat_alpha"]


def test_threat_flags(spark):
    listed = threat_frame(spark, alpha=["45.83.1.9", "77.91.64.0/20"], beta=["120.5.6.7"])
    frame = events(spark, "120.5.6.7", "45.83.1.9", "77.91.64.1", None, "bad", "62.40.8.21")
    rows = enrich.enrich_with_threats(frame, listed).sort("id").collect()
    assert [(r[MALICIOUS], r.threat_alpha, r.threat_beta) for r in rows] == [
        (True, False, True),
        (True, True, False),
        (True, True, False),
        (False, False, False),
        (False, False, False),
        (False, False, False),
    ]


def test_no_address_at_all(spark, threats):
    rows = enrich.enrich_with_threats(events(spark, None, None), threats).collect()
    assert [(r[MALICIOUS], r.threat_alpha) for r in rows] == [(False, False)] * 2


def test_configured_source_without_entries(spark, threats):
    (row,) = enrich.enrich_with_threats(events(spark, "45.83.1.9"), threats, sources=["alpha", "empty"]).collect()
    assert (row.threat_alpha, row.threat_empty) == (True, False)


def addresses(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "ip string")


def test_verdicts(spark, threats):
    frame = addresses(spark, "45.83.1.9", "45.83.1.11", "invalid_ip", "77.91.70.2", "120.5.6.8", "2a0c:9a47::9", "77.91.65.3")
    rows = {row.ip: row.verdicts for row in enrich.verdicts(frame, threats).collect()}
    assert rows == {
        "45.83.1.9": {"alpha": True, "beta": False},
        "45.83.1.11": {"alpha": False, "beta": False},
        "invalid_ip": {"alpha": False, "beta": False},
        "77.91.70.2": {"alpha": True, "beta": False},
        "120.5.6.8": {"alpha": False, "beta": True},
        "2a0c:9a47::9": {"alpha": True, "beta": False},
        "77.91.65.3": {"alpha": True, "beta": True},
    }
    flags = {row.ip: row.is_malicious for row in enrich.is_malicious(frame, threats).collect()}
    assert flags == {ip: any(sources.values()) for ip, sources in rows.items()}


def test_exact_and_network_matches(spark, threats):
    frame = addresses(spark, "45.83.1.9", "77.91.70.2", "62.40.8.21", "10.0.0.1")
    assert [tuple(r) for r in enrich.exact_matches(frame, threats).collect()] == [("45.83.1.9", "alpha")]
    got = sorted(tuple(r) for r in enrich.network_matches(frame, threats).collect())
    assert got == [("45.83.1.9", "alpha"), ("77.91.70.2", "alpha")]


def test_batch_keeps_order_and_duplicates(spark, geo, asn):
    listed = ["62.40.8.21", "bad", "10.0.0.1", "62.40.8.21", "91.20.3.4"]
    rows = enrich.lookup(spark, listed, geo, asn).collect()
    assert [(r.ip, r.city, r.asn) for r in rows] == [
        ("62.40.8.21", "Tromso", 64510),
        ("bad", None, None),
        ("10.0.0.1", None, None),
        ("62.40.8.21", "Tromso", 64510),
        ("91.20.3.4", None, 64511),
    ]


def test_location_counts(spark, geo):
    rows = enrich.location_counts(events(spark, *ADDRESSES), geo).collect()
    assert [tuple(r) for r in rows] == [
        (None, None, 5),
        ("Norway", "Tromso", 2),
        ("Half", None, 1),
        ("Norway", None, 1),
        ("Portugal", "Faro", 1),
    ]


@pytest.mark.parametrize("broadcast", [True, False])
def test_hot_addresses_are_spread_in_one_scan(spark, geo, broadcast):
    """A third of all rows from one address and a third without any address."""
    texts = ["62.40.8.21"] * 300 + [None] * 300 + [f"62.40.{i % 20}.{i}" for i in range(1, 250)] + ["bad"] * 50
    frame = materialize(events(spark, *texts), "events")
    table = materialize(enrich.build_address_table(enrich.address_counts(frame), geo), "addresses")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plain = enrich.attach(frame, table, "src_ip", GEO_COLUMNS)
        spread = enrich.attach(frame, table, "src_ip", GEO_COLUMNS, hot_rows=100, max_hot=100_000)
        plan = spread._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (not broadcast)
        assert plan.count("Exchange hashpartitioning") == (0 if broadcast else 2)
        scans = [line for line in plan.splitlines() if "FileScan" in line and "dst_ip" in line]
        assert len(scans) == 1
        assert spread.count() == len(texts)
        assert sorted(map(str, spread.collect())) == sorted(map(str, plain.collect()))
        # Rows of one address and rows without any meet more than one part.
        parts = enrich.spread_rows(frame.selectExpr("*", "src_ip AS __ip"), table, 100).groupBy("src_ip").agg({"__salt": "max"})
        most = {r[0]: r[1] for r in parts.collect()}
        assert most["62.40.8.21"] == most[None] == 2 and most["bad"] == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("broadcast", [True, False])
def test_verdicts_alone_shuffle_hits_only(spark, threats, broadcast):
    """Addresses that no source lists are dropped before a shuffle; busy ones are spread all the same."""
    texts = ["62.40.8.21"] * 300 + [None] * 300 + ["45.83.1.9"] * 5 + ["77.91.65.3", "bad", "2a0c:9a47::9"]
    texts += [f"99.1.{i}.7" for i in range(200)]
    frame = materialize(events(spark, *texts), "events")
    counts = materialize(enrich.address_counts(frame), "counts")
    table = enrich.threat_table(counts, materialize(threats, "threats"), ["alpha", "beta", "none"], hot_rows=100)
    rows = {r.ip: (r.n, r[MALICIOUS], r.threat_alpha, r.threat_beta, r.threat_none) for r in table.collect()}
    assert rows == {
        "62.40.8.21": (300, False, False, False, False),
        None: (300, False, False, False, False),
        "45.83.1.9": (5, True, True, False, False),
        "77.91.65.3": (1, True, True, True, False),
        "2a0c:9a47::9": (1, True, True, False, False),
    }
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if not broadcast:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        names = ["alpha", "beta"]
        spread = enrich.enrich(frame, threats=threats, sources=names, hot_rows=100)
        whole = materialize(enrich.build_address_table(counts, threats=threats, sources=names), "addresses")
        columns = [MALICIOUS, "threat_alpha", "threat_beta"]
        want = enrich.attach(frame, whole, "src_ip", columns)
        assert spread.columns == want.columns
        assert sorted(map(str, spread.collect())) == sorted(map(str, want.collect()))
        assert spread.where(f"{MALICIOUS} IS NULL").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_verdicts_alone_of_no_source(spark, threats):
    (row,) = enrich.enrich_with_threats(events(spark, "45.83.1.9"), threats, sources=[]).collect()
    assert row[MALICIOUS] is False


def test_addresses_are_looked_up_once(spark, geo, asn, threats):
    """One read of the events, and no join of addresses with network boundaries."""
    frame = materialize(events(spark, *ADDRESSES), "events")
    table = enrich.build_address_table(enrich.address_counts(frame), geo, asn, threats, ["alpha", "beta"])
    plan = table._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation [id") + plan.count("Relation[id") == 1
    assert "Cross" not in plan
    physical = table._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in physical and "Cartesian" not in physical and "SortAggregate" not in physical
