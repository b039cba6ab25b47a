"""Prefix joins against brute force over Python's ipaddress."""

import ipaddress
import random

import pytest

from wallscope.operators import enrich
from wallscope.operators import prefix_join
from wallscope.operators.prefix_join import containing_networks, longest_match
from wallscope.functions.addresses import with_address_key, with_network_key
from wallscope.schemas import GEO_NETWORK
from wallscope.session import materialize
from wallscope.sources.networks import asn_networks, geo_networks


def network_frame(spark, cidrs):
    frame = spark.createDataFrame([(c, f"name {c}") for c in cidrs], "network string, country_name string")
    return geo_networks(frame)


def address_frame(spark, addresses):
    return spark.createDataFrame([(a,) for a in addresses], "ip string").distinct()


def random_networks(rng, count):
    cidrs = {"0.0.0.0/0", "::/0", "10.0.0.0/8", "10.1.0.0/16", "10.1.2.0/24", "10.1.2.3/32", "2001:db8::/32"}
    while len(cidrs) < count:
        if rng.random() < 0.5:
            address, longest = ipaddress.IPv4Address(rng.getrandbits(12) << 20 | rng.getrandbits(20)), 32
        else:
            address, longest = ipaddress.IPv6Address(0x20010DB8 << 96 | rng.getrandbits(20) << 76 | rng.getrandbits(76)), 128
        cidrs.add(str(ipaddress.ip_network((address, rng.randrange(longest + 1)), strict=False)))
    return sorted(cidrs)


def random_hosts(rng, networks, count):
    hosts = ["nonsense", "1.2.3", "::1", "10.1.2.3", "10.1.2.4"]
    for _ in range(count):
        network = ipaddress.ip_network(rng.choice(networks))
        hosts.append(str(network[rng.randrange(network.num_addresses)]))
    return hosts


def containing(host, networks):
    try:
        address = ipaddress.ip_address(host)
    except ValueError:
        return []
    found = [n for n in map(ipaddress.ip_network, networks) if n.version == address.version and address in n]
    return sorted(found, key=lambda n: n.prefixlen)


@pytest.fixture(params=["broadcast", "shuffle"])
def join_kind(request, spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    if request.param == "shuffle":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield request.param
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_longest_match(spark, join_kind):
    rng = random.Random(11)
    networks = random_networks(rng, 150)
    networks.remove("::/0")
    networks.remove("0.0.0.0/0")
    hosts = random_hosts(rng, networks, 300)
    found = longest_match(address_frame(spark, hosts), network_frame(spark, networks)).collect()
    assert len(found) == len(set(hosts))
    for row in found:
        matches = containing(row.ip, networks)
        assert row.network == (str(matches[-1]) if matches else None), row.ip
        assert row.plen == (matches[-1].prefixlen if matches else None)


def test_all_containing_networks(spark, join_kind):
    rng = random.Random(12)
    networks = random_networks(rng, 120)
    hosts = random_hosts(rng, networks, 150)
    keyed = with_address_key(address_frame(spark, hosts), "ip")
    rows = containing_networks(keyed, network_frame(spark, networks)).collect()
    got = sorted((row.ip, row.network) for row in rows)
    want = sorted((host, str(n)) for host in set(hosts) for n in containing(host, networks))
    assert got == want


def test_full_bloom_filter_loses_nothing(spark, monkeypatch):
    """With one word for all keys nearly every probe passes, and the join behind it still decides."""
    monkeypatch.setattr(prefix_join, "WORDS", 1)
    test_all_containing_networks(spark, None)


def test_bloom_filter_prunes_probes_before_the_shuffle(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        networks = materialize(network_frame(spark, [f"62.{i}.{j}.0/24" for i in range(20) for j in range(50)]), "networks")
        hosts = [f"99.{i % 100}.{i // 100}.5" for i in range(2000)] + ["62.7.3.9"]
        keyed = materialize(with_address_key(address_frame(spark, hosts), "ip"), "keyed")
        found = containing_networks(keyed, networks)
        assert [(r.ip, r.network) for r in found.collect()] == [("62.7.3.9", "62.7.3.0/24")]
        plan = found._jdf.queryExecution().executedPlan().toString()
        # Top down: the join with the networks, the shuffle of the probes, and below it the filter.
        assert plan.index("SortMergeJoin") < plan.index("hashpartitioning") < plan.index("__slot#")
        slots = prefix_join.bloom_filter(networks)
        assert slots.count() <= 1000 and slots.where("bit_count(__set) < 1").isEmpty()
        # 2,001 addresses at one length each; about one in a million passes by chance.
        assert prefix_join.lookup_probes(keyed, networks).count() < 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_no_join_without_equality(spark, join_kind):
    found = longest_match(address_frame(spark, ["10.1.2.3"]), network_frame(spark, ["10.0.0.0/8"]))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    if join_kind == "shuffle":
        assert "SortMergeJoin" in plan


def test_special_addresses(spark):
    rng = random.Random(5)
    hosts = """192.168.1.1 10.0.0.1 172.16.0.1 127.0.0.1 8.8.8.8 not_an_ip 100.64.0.1 192.0.0.9 169.254.1.1
        0.1.2.3 ::ffff:8.8.8.8 2001:1::1 203.0.113.1 224.0.0.1 240.0.0.1 255.255.255.255 2606:4700::1 fe80::1%eth0
        2001:20::1 2001:3::1 2002::1 64:ff9b::1 64:ff9b:1::1 ff02::1 fd00::1""".split()
    hosts += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(300)]
    hosts += [str(ipaddress.IPv6Address(rng.getrandbits(128))) for _ in range(200)]
    hosts += [str(ipaddress.IPv6Address(0x2001 << 112 | rng.getrandbits(10) << 102 | rng.getrandbits(40))) for _ in range(100)]

    def expected(text):
        try:
            ip = ipaddress.ip_address(text)
        except ValueError:
            return False
        return ip.is_private or ip.is_reserved or ip.is_loopback or ip.is_multicast

    rows = enrich.build_address_table(address_frame(spark, hosts)).collect()
    assert [row.ip for row in rows if row.is_private != expected(row.ip)] == []
    assert len(rows) == len(set(hosts))


def test_network_tables_drop_what_is_invalid_or_double(spark):
    records = spark.createDataFrame(
        [("10.0.0.7/8", "B"), ("10.0.0.0/8", "A"), ("10.0.0.0/99", "C"), ("x", "D")],
        "network string, country_name string",
    )
    table = geo_networks(records)
    assert table.columns == GEO_NETWORK.fieldNames()
    (row,) = table.collect()
    assert (row.plen, row.network, row.country_name, row.city) == (8, "10.0.0.0/8", "A", None)
    owners = spark.createDataFrame([("8.8.8.0/24", 15169, "Google LLC")], "network string, asn int, asn_org string")
    (row,) = asn_networks(owners).collect()
    assert (row.asn, row.asn_org, row.network) == (15169, "Google LLC", "8.8.8.0/24")


def test_network_key_of_table_is_masked(spark):
    (row,) = with_network_key(spark.createDataFrame([("10.255.0.1/8",)], "c string"), "c").collect()
    assert row.hi == 10 << 56
