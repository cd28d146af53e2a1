"""Addresses against the standard library, hosts and validations."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from palisade.functions import addresses, labels


def literals(n):
    """Literals of both kinds in many spellings, near the borders of networks and anywhere, and texts that are none."""
    rng, out = random.Random(8), []
    edges = [int(a) for net in map(ipaddress.ip_network, (*addresses.NOT_GLOBAL, *addresses.GLOBAL, "::ffff:0:0/96", "224.0.0.0/4")) for a in (net.network_address, net.broadcast_address)]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            text = str(ipaddress.IPv4Address(rng.choice([rng.getrandbits(32), (rng.choice(edges) + rng.randrange(-1, 2)) % 2**32])))
        else:
            x = rng.choice([rng.getrandbits(128), (rng.choice(edges) + rng.randrange(-1, 2)) % 2**128, addresses.MAPPED + (rng.choice(edges) + rng.randrange(-1, 2)) % 2**32, rng.getrandbits(16) << 16 * rng.randrange(8) | rng.getrandbits(16)])
            a = ipaddress.IPv6Address(x)
            text = rng.choice([str(a), a.exploded, str(a).upper(), f"{str(a)}%eth0" if rng.random() < 0.2 else str(a)])
            if rng.random() < 0.2:
                text = ":".join(f"{x >> 16 * i & 0xFFFF:x}" for i in range(7, 1, -1)) + ":" + str(ipaddress.IPv4Address(x & 0xFFFFFFFF))
        if rng.random() < 0.25:  # broken in some place
            i = rng.randrange(len(text))
            text = text[:i] + rng.choice(["", ":", "::", ".", "g", "0", "%", " ", "1.2.3.4"]) + text[i + 1 :]
        out.append(text)
    return out + ["", " ", " 1.2.3.4 ", "1.2.3.4\n", "01.2.3.4", "1.2.3", "256.1.1.1", "::", ":::", "1::2::3", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8::", "::%", "%a", "12345::", "1:2:3:4:5:6:7:1.2.3.4", "::1.2.3.4", "::1.2.3.256", None]


def parsed(text):
    try:
        return ipaddress.ip_address((text or "").strip())
    except ValueError:
        return None


def test_both_kinds_equal_the_standard_library(spark):
    texts = literals(10_000)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    found = rows.select("i", addresses.canonical_address(F.col("t")).alias("c"), addresses.is_public(F.col("t")).alias("p")).orderBy("i").collect()
    wanted = [(str(a), a.is_global) if (a := parsed(t)) else ("", False) for t in texts]
    assert [(t, *r[1:]) for t, r in zip(texts, found, strict=True)] == [(t, *w) for t, w in zip(texts, wanted, strict=True)]
    assert sum(bool(a) for a, _ in wanted) > 6000


def test_the_parser_stands_once_in_the_expression(spark):
    text = addresses.is_public(F.col("t"))._jc.toString()
    assert text.count("[1-9]?") == 2 * 4  # once for each kind of literal, in four octets
    assert spark.createDataFrame([("8.8.8.8",)], "t string").where(addresses.is_public(F.col("t"))).count() == 1


def test_regions_know_both_kinds(spark):
    rows = spark.createDataFrame([("8.8.8.8",), ("2001:4860:4860::8888",), ("fe80::1",), ("10.1.1.1",), ("nowhere",)], "ip string")
    found = [r[0] for r in rows.select(labels.region(F.col("ip"), F.lit(None).cast("string"), F.lit("Peru"))).collect()]
    assert found == ["Peru", "Peru", labels.INTERNAL, labels.INTERNAL, labels.UNKNOWN]
