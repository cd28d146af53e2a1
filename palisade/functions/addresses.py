"""IPv4 and IPv6 addresses as column expressions.

An address is read once, into a key: its kind and 32 hexadecimal digits, so that keys
sort as addresses do. Whether it is public is then looked up among the borders of
the special-purpose networks by halving their sorted list.
"""

from __future__ import annotations

from collections.abc import Callable
from ipaddress import IPv6Network, ip_network

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special-purpose networks whose addresses are not global, and the global ones inside them.
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.0.170/31", "192.0.2.0/24",
    "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24", "240.0.0.0/4", "255.255.255.255/32",
    "::1/128", "::/128", "64:ff9b:1::/48", "100::/64", "2001::/23", "2001:db8::/32", "2002::/16", "fc00::/7", "fe80::/10",
)
GLOBAL = ("192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32", "2001:4:112::/48", "2001:20::/28", "2001:30::/28")
SHARED = "100.64.0.0/10"  # not global as IPv4 alone
MAPPED = int(ip_network("::ffff:0:0/96").network_address)  # IPv4 addresses written as IPv6 ones

_OCTET = r"(25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_IPV4 = rf"{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _hex4(text: Column) -> Column:
    """The eight hexadecimal digits of an IPv4 address that is known to be one."""
    octets = F.transform(F.split(text, r"\."), lambda o: F.lpad(F.hex(o.cast("long")), 2, "0"))
    return F.lower(F.array_join(octets, ""))


def _groups(text: Column) -> Column:
    """The eight groups of four digits of an IPv6 address without a scope; null where it is none."""
    dotted = F.regexp_extract(text, r"^(.*:)([0-9.]+)$", 2)
    whole = F.when(dotted.rlike(rf"^{_IPV4}$"), let(_hex4(dotted), lambda h: F.concat(F.regexp_extract(text, r"^(.*:)", 1), F.substring(h, 1, 4), F.lit(":"), F.substring(h, 5, 4)))).otherwise(text)

    def spread(t: Column) -> Column:
        halves = F.split(t, "::")
        part = lambda i: F.filter(F.split(F.coalesce(F.try_element_at(halves, F.lit(i)), F.lit("")), ":", -1), lambda g: F.lit(True))
        filled = lambda a: F.when((F.size(a) == 1) & (a[0] == ""), F.array().cast("array<string>")).otherwise(a)

        def joined(ends: Column) -> Column:
            left, right = ends["left"], ends["right"]
            n = F.size(left) + F.size(right)
            some = F.size(halves) == 2
            zeros = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), 8 - n)), lambda _: F.lit("0"))
            every = F.when(some, F.concat(left, zeros, right)).otherwise(left)
            good = (F.size(halves) <= 2) & F.when(some, n <= 7).otherwise(n == 8) & F.forall(every, lambda g: g.rlike("^[0-9a-fA-F]{1,4}$"))
            return F.when(good, F.transform(every, lambda g: F.lower(F.lpad(g, 4, "0"))))

        return let(F.struct(filled(part(1)).alias("left"), filled(part(2)).alias("right")), joined)

    return let(whole, spread)


def address_key(ip: Column) -> Column:
    """"4" or "6" and 32 digits; null where the text is no address. IPv4 octets have no leading zeros; IPv6 may have a scope."""

    def read(text: Column) -> Column:
        four = F.concat(F.lit("4" + "0" * 24), _hex4(text))
        plain = F.when(text.rlike("^[^%]*%[^%]+$"), F.split_part(text, F.lit("%"), F.lit(1))).otherwise(text)
        return F.when(text.rlike(rf"^{_IPV4}\z"), four).when(text.contains(":"), F.concat(F.lit("6"), F.array_join(_groups(plain), "")))

    return let(_stripped(ip), read)


def canonical_address(ip: Column) -> Column:
    """The shortest form of an address: in IPv6 lower case, no leading zeros, the first longest run of zero groups left out; empty where it is none."""

    def shown(both: Column) -> Column:
        key, text = both["key"], both["text"]
        groups = [F.substring(key, 2 + 4 * i, 4) for i in range(8)]
        line = F.concat_ws(":", *[F.regexp_replace(g, "^0{1,3}", "") for g in groups])
        scope = F.regexp_extract(text, "(%.*)$", 1)
        octets = [F.conv(F.substring(key, 26 + 2 * i, 2), 16, 10) for i in range(4)]
        mapped = F.concat(F.lit("::ffff:"), F.concat_ws(".", *octets))
        return F.when(key.isNull(), "").when(key.startswith("4"), text).when(key.startswith(f"6{MAPPED >> 32:024x}"), F.concat(mapped, scope)).otherwise(F.concat(let(line, _shortened), scope))

    return let(F.struct(address_key(ip).alias("key"), _stripped(ip).alias("text")), shown)


def _shortened(line: Column) -> Column:
    out = F
    for n in range(8, 1, -1):
        run = rf"^(.*?)(?:^|:)0(?::0){{{n - 1}}}(?::|$)(.*)$"
        out = out.when(line.rlike(run), F.regexp_replace(line, run, "$1::$2"))
    return out.otherwise(line)


def _borders() -> list[tuple[str, bool]]:
    """Keys from which on addresses are global or not, sorted; neighbours differ."""
    nets = [(n, False) for n in map(ip_network, NOT_GLOBAL)] + [(n, True) for n in map(ip_network, GLOBAL)]
    spans = [("6" if isinstance(n, IPv6Network) else "4", int(n.network_address), int(n.broadcast_address), k) for n, k in nets]
    shared = int(ip_network(SHARED).network_address)
    spans += [("6", MAPPED + a, MAPPED + b, k) for kind, a, b, k in spans if kind == "4" and a != shared]
    at = sorted({(kind, x) for kind, a, b, _ in spans for x in (a, b + 1)} | {("4", 0), ("6", 0)})
    found: list[tuple[str, bool]] = []
    for kind, x in at:
        inside = [known for k, a, b, known in spans if k == kind and a <= x <= b]
        is_global = not inside or any(inside)
        if not found or found[-1][0][0] != kind or found[-1][1] != is_global:
            found.append((f"{kind}{x:032x}", is_global))
    return found


BORDERS = _borders()


def is_public(ip: Column) -> Column:
    """Whether an address is global: in no special-purpose network; false where it is no address."""

    def halved(key: Column, low: int, high: int) -> Column:
        if high - low == 1:
            return F.lit(BORDERS[low][1])
        middle = (low + high) // 2
        return F.when(key < BORDERS[middle][0], halved(key, low, middle)).otherwise(halved(key, middle, high))

    return F.coalesce(let(address_key(ip), lambda key: F.when(key.isNotNull(), halved(key, 0, len(BORDERS)))), F.lit(False))
