"""Ranges and merged networks against Python's ipaddress."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wallscope.functions.addresses import with_network_key
from wallscope.operators import covering, enrich
from wallscope.sources import feeds
from wallscope.sources.networks import asn_networks


def draws(seed, count=120):
    draw = random.Random(seed)
    for _ in range(count):
        if draw.random() < 0.5:
            kind, base, width = ipaddress.IPv4Address, draw.choice([0, 10 << 24, (1 << 32) - 70000]), draw.choice([1, 8, 16])
            top = (1 << 32) - 1
        else:
            kind, base, width = ipaddress.IPv6Address, draw.choice([0, 0x20010DB8 << 96, 0xFFFF << 112]), draw.choice([3, 30, 66, 100])
            top = (1 << 128) - 1
        a, b = (min(top, base + draw.getrandbits(width)) for _ in range(2))
        yield kind(min(a, b)), kind(max(a, b))


@pytest.mark.parametrize("seed", [1, 2])
def test_ranges_have_the_fewest_networks(spark, seed):
    pairs = list(draws(seed))
    pairs += [(ipaddress.ip_address("0.0.0.0"), ipaddress.ip_address("255.255.255.255")), (ipaddress.ip_address("::"), ipaddress.ip_address("f" * 4 + ":ffff" * 7))]
    pairs += [(ipaddress.ip_address("::1"), ipaddress.ip_address("ffff" + ":ffff" * 6 + ":fffe")), (ipaddress.ip_address("1.2.3.4"),) * 2]
    rows = [(k, str(a), str(b)) for k, (a, b) in enumerate(pairs)]
    found = {}
    for r in covering.range_networks(spark.createDataFrame(rows, "id int, first string, last string")).collect():
        found.setdefault(r.id, []).append(r.network)
    for k, (a, b) in enumerate(pairs):
        assert sorted(found[k]) == sorted(map(str, ipaddress.summarize_address_range(a, b))), (a, b)


def test_unusable_ranges_are_left_out(spark):
    rows = [("1.2.3.4", "1.2.3.3"), ("::5", "::4"), ("1.2.3.4", "::1"), ("x", "1.2.3.4"), (None, "1.2.3.4"), ("1.2.3.4", None)]
    assert covering.range_networks(spark.createDataFrame(rows, "first string, last string")).collect() == []


def test_owners_by_range(spark):
    rows = [("192.0.2.7", "192.0.2.16", 7, "Seven"), ("2001:db8::", "2001:db8::ffff", 8, None)]
    table = asn_networks(covering.range_networks(spark.createDataFrame(rows, "first string, last string, asn long, asn_org string")))
    got = sorted((r.network, r.asn) for r in table.collect())
    assert got == [("192.0.2.16/32", 7), ("192.0.2.7/32", 7), ("192.0.2.8/29", 7), ("2001:db8::/112", 8)]


def test_text_of_networks(spark):
    texts = ["0.0.0.0/0", "255.255.255.255/32", "::/0", "::/128", "::1/128", "1::/16", "1:0:0:2::/64", "1:0:0:2:0:0:0:3/128", "1:0:2:3:4:5:6:7/128", "0:1::/32", "fe80::1:0:0:1/128", "1:2:3:4:5:6:7:0/128", "1:2:3:4:5:6::/112"]
    keyed = with_network_key(spark.createDataFrame([(t,) for t in texts], "cidr string"), "cidr")
    for r in keyed.select("cidr", F.expr(covering.network_text()).alias("text")).collect():
        assert r.text == str(ipaddress.ip_network(r.cidr)), r.cidr


def test_cover_runs_no_lambda_per_bit(spark):
    found = covering.cover(spark.createDataFrame([(0, 0, 0, 7)], "hi long, lo long, to_hi long, to_lo long"))
    assert "lambda" not in found._jdf.queryExecution().optimizedPlan().toString()


def made(seed, count=150):
    draw = random.Random(seed)
    for _ in range(count):
        if draw.random() < 0.6:
            bits = draw.choice([0, 4, 11, 12, 13, 20, 24, 24, 25, 26, 32, 32]) if draw.random() < 0.9 else draw.randrange(8, 33)
            bits = max(bits, 6)
            yield str(ipaddress.ip_network((draw.choice([10 << 24, (10 << 24) + (1 << 20), 0]) + draw.getrandbits(draw.choice([10, 21])), bits), strict=False))
        else:
            bits = draw.choice([16, 31, 32, 60, 64, 66, 127, 128])
            yield str(ipaddress.ip_network(((0x20010DB8 << 96) + (draw.getrandbits(4) << 96) + (draw.getrandbits(5) << 62) + draw.getrandbits(3), bits), strict=False))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_networks_equal_collapse_addresses(spark, seed):
    cidrs = list(made(seed))
    sets = {"a": cidrs[:100], "b": cidrs[60:], "edge": ["0.0.0.0/1", "128.0.0.0/1", "ff00::/8", "fe00::/8", "::/2", "255.255.255.255/32"]}
    lines = spark.createDataFrame([(s, c) for s, own in sets.items() for c in own], "source string, line string")
    entries = feeds.load_entries(lines)
    merged = feeds.collapsed(entries)
    assert merged.columns == entries.columns
    for source, own in sets.items():
        kinds = [[n for n in map(ipaddress.ip_network, own) if n.version == v] for v in (4, 6)]
        expected = [str(n) for kind in kinds for n in ipaddress.collapse_addresses(kind)]
        assert sorted(r.entry for r in merged.where(F.col("source") == source).collect()) == sorted(expected)


def test_merged_feeds_give_the_same_verdicts_with_fewer_keys(spark):
    cidrs = list(made(4))
    entries = feeds.load_entries(spark.createDataFrame([("ab"[k % 2], c) for k, c in enumerate(cidrs)], "source string, line string"))
    merged = feeds.collapsed(entries)
    assert merged.count() < entries.count() / 2
    edges = {str(a) for c in cidrs for n in [ipaddress.ip_network(c)] for a in (n[0], n[-1], n[0] - 1 if int(n[0]) else n[0])}
    asked = spark.createDataFrame([(a,) for a in sorted(edges)], "ip string")
    verdicts = [sorted(map(tuple, enrich.network_matches(asked, t).collect())) for t in (entries, merged)]
    assert verdicts[0] == verdicts[1] != []
    maps = [sorted((r.ip, sorted(r.verdicts.items())) for r in enrich.verdicts(asked, t).collect()) for t in (entries, merged)]
    assert maps[0] == maps[1]
