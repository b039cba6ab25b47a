import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from wallscope.functions.addresses import with_network_key
from wallscope.operators import ranges
from wallscope.operators.prefix_join import longest_match, with_any_key
from wallscope.schemas import GEO_NETWORK


def networks(spark, layers):
    rows = [(cidr, k) for k, cidrs in enumerate(layers) for cidr in cidrs]
    keyed = with_network_key(spark.createDataFrame(rows, "cidr string, layer int"), "cidr")
    return keyed.withColumn("score", F.col("plen"))


def expected(ip, cidrs):
    try:
        own = ipaddress.ip_address(ip)
    except ValueError:
        return None
    lengths = [n.prefixlen for n in map(ipaddress.ip_network, cidrs) if n.version == own.version and own in n]
    return max(lengths, default=None)


def made(seed, count=250):
    """Nested and adjacent networks of both families and addresses at and around their edges."""
    draw = random.Random(seed)
    out, addresses = [], []
    for _ in range(count):
        v6 = draw.random() < 0.5
        width, base = (128, draw.choice([0x20010DB8 << 96, 0x2A02 << 112, 0, (1 << 128) - (1 << 100)])) if v6 else (32, draw.choice([10 << 24, 0, 255 << 24, 0x7FFF0000]))
        bits = draw.randrange(width + 1)
        value = (base + draw.getrandbits(draw.choice([2, 9, 20] if not v6 else [2, 40, 70]))) & ((1 << width) - 1)
        kind = ipaddress.IPv6Network if v6 else ipaddress.IPv4Network
        net = kind((value >> (width - bits) << (width - bits), bits))
        out.append(str(net))
        for edge in (int(net.network_address) - 1, int(net.network_address), int(net.broadcast_address), int(net.broadcast_address) + 1, value):
            if 0 <= edge < 1 << width:
                addresses.append(str((ipaddress.IPv6Address if v6 else ipaddress.IPv4Address)(edge)))
    return out, sorted({*addresses})


@pytest.mark.parametrize("seed", [1, 2])
def test_layers_against_ipaddress(spark, seed):
    cidrs, addresses = made(seed)
    layers = [cidrs[:120], cidrs[100:], [c for c in cidrs if c.endswith(("/0", "/1", "/32", "/128"))], []]
    asked = [*addresses, "not an address", "1.2.3", "::ffff:10.0.0.1"]
    keyed = with_any_key(spark.createDataFrame([(a, 7) for a in asked], "ip string, n int"))
    found = ranges.match_layers(keyed, networks(spark, layers), len(layers)).collect()
    assert sorted(r.ip for r in found) == sorted(asked) and {r.n for r in found} == {7}
    for r in found:
        assert [r[f"score_{k}"] for k in range(len(layers))] == [expected(r.ip, c) for c in layers], r.ip


def test_ranges_are_apart_and_complete(spark):
    cidrs = ["10.0.0.0/8", "10.0.0.0/9", "10.0.0.0/24", "10.0.1.0/24", "10.0.1.7/32", "10.255.255.255/32", "0.0.0.0/0"]
    rows = [r for r in ranges.flatten(networks(spark, [cidrs])).collect() if 0x0A0 <= r.bucket <= 0x0AF]
    starts = sorted(((r.hi + (1 << 63)) >> 32, r.score) for r in rows)
    ten = 10 << 24
    first = [(ten, 24), (ten + 256, 24), (ten + 263, 32), (ten + 264, 24), (ten + 512, 9)]
    assert starts[:5] == first
    assert (ten + (1 << 23), 8) in starts and (ten + (1 << 24) - 1, 32) in starts
    assert len({s for s, _ in starts}) == len(starts)


def test_equal_networks_and_gaps(spark):
    rows = ranges.flatten(networks(spark, [["192.0.2.0/25", "192.0.2.5/25", "192.0.2.0/26"]])).collect()
    base = 0xC0000200
    assert sorted(((r.hi + (1 << 63)) >> 32, r.score) for r in rows) == [(base, 26), (base + 64, 25), (base + 128, None)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_an_address_is_one_probe(spark):
    """No address is expanded to prefix lengths, and no boundary is compared with it by a join."""
    cidrs, addresses = made(3, 60)
    keyed = with_any_key(spark.createDataFrame([(a,) for a in addresses], "ip string"))
    assert ranges.probes(keyed).count() == len(addresses)
    found = plan(ranges.match_layers(keyed, networks(spark, [cidrs]), 1))
    assert "Join" not in found
    asked = found[found.index("Union") :]
    # One generator of a single row forms the key; none multiplies addresses.
    assert "__length" not in asked


def test_longest_match_has_the_record(spark):
    cidrs, addresses = made(4, 120)
    records = with_network_key(spark.createDataFrame([(c, c) for c in sorted({*cidrs})], "network string, city string"), "network")
    missing = [F.lit(None).cast(f.dataType).alias(f.name) for f in GEO_NETWORK.fields if f.name not in records.columns]
    found = longest_match(spark.createDataFrame([(a,) for a in [*addresses, "x"]], "ip string"), records.select("*", *missing))
    for r in found.collect():
        length = expected(r.ip, cidrs)
        assert r.plen == length
        assert (r.city is None) == (length is None)
        if r.city:
            assert ipaddress.ip_network(r.city).prefixlen == length and ipaddress.ip_address(r.ip) in ipaddress.ip_network(r.city)
