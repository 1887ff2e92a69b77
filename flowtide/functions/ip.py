"""IP address text: canonical form, ordering, and the global-address test.

Addresses live in the tables as canonical text. IPv4 text that passes the
dotted-quad pattern already is canonical, so the IPv6 work below is only
evaluated for rows that contain a colon, and nothing leaves the JVM.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_QUAD = rf"{_OCTET}(?:\.{_OCTET}){{3}}"
_BLANKS = " \t\n\r\f\x0b"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use the result several times in ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def _dotted_tail_as_hex(text: Column) -> Column:
    """``::ffff:1.2.3.4`` -> ``::ffff:102:304``; other text is unchanged."""

    def octet(n: int) -> Column:
        tail = F.substring_index(text, ":", -1)
        return F.split_part(tail, F.lit("."), F.lit(n)).try_cast("int")

    def pair(a: int, b: int) -> Column:
        return F.lower(F.hex(octet(a) * 256 + octet(b)))

    head = F.regexp_replace(text, r"[^:]*$", "")
    return F.when(
        text.rlike(rf":{_QUAD}$"), F.concat(head, pair(1, 2), F.lit(":"), pair(3, 4))
    ).otherwise(text)


def _padded_groups(host: Column) -> Column:
    """Eight four-digit groups joined by ``:``; NULL when not an IPv6 address."""

    def pieces(text: Column) -> Column:
        return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ":"))

    def fill(sides: Column) -> Column:
        left, right = sides["left"], sides["right"]
        missing = F.lit(8) - F.size(left) - F.size(right)
        return (
            F.when(~sides["gap"], left)
            .when(missing >= 1, F.concat(left, F.array_repeat(F.lit("0"), missing), right))
        )

    def split_at_gap(text: Column) -> Column:
        gap = text.contains("::")
        return F.struct(
            gap.alias("gap"),
            pieces(F.regexp_replace(text, r"::.*$", "")).alias("left"),
            F.when(gap, pieces(F.regexp_replace(text, r"^.*?::", "")))
            .otherwise(F.array().cast("array<string>"))
            .alias("right"),
        )

    def join(groups: Column) -> Column:
        proper = (F.size(groups) == 8) & F.forall(groups, lambda g: g.rlike("^[0-9a-f]{1,4}$"))
        return F.when(
            proper, F.array_join(F.transform(groups, lambda g: F.lpad(g, 4, "0")), ":")
        )

    return _let(
        _let(_let(_dotted_tail_as_hex(F.lower(host)), split_at_gap), fill), join
    )


def _short_form(padded: Column) -> Column:
    """Shortest text: no leading zeros, the first longest zero run as ``::``."""

    def mapped(p: Column) -> Column:
        def byte(start: int) -> Column:
            return F.conv(F.substring(p, start, 2), 16, 10)

        return F.concat(
            F.lit("::ffff:"), F.concat_ws(".", byte(31), byte(33), byte(36), byte(38))
        )

    def squeeze(text: Column) -> Column:
        chosen = text
        for run in range(2, 9):
            zeros = "0" + ":0" * (run - 1)
            cut = F.regexp_replace(
                text, rf"^((?:[0-9a-f]+:)*?){zeros}(?::|$)(.*)$", "$1:$2"
            )
            cut = F.when(cut.startswith(":"), F.concat(F.lit(":"), cut)).otherwise(cut)
            chosen = F.when(text.rlike(rf"(?:^|:){zeros}(?::|$)"), cut).otherwise(chosen)
        return chosen

    def pick(p: Column) -> Column:
        bare = F.regexp_replace(p, r"\b0{1,3}(?=[0-9a-f])", "")
        return F.when(p.rlike("^(?:0000:){5}ffff:"), mapped(p)).otherwise(_let(bare, squeeze))

    return _let(padded, pick)


def canonical(host: Column) -> Column:
    """Canonical address text; NULL when ``host`` is not an address."""
    return F.when(host.rlike(rf"^{_QUAD}$"), host).when(
        host.contains(":"), _short_form(_padded_groups(host))
    )


def host_part(value: Column) -> Column:
    """Text before a ``/len`` suffix, surrounding blanks removed."""
    return F.substring_index(strip(value), "/", 1)


def normalize_host(value: Column) -> Column:
    """Canonical host address, or the bare text when it is not an address."""
    host = host_part(value)
    return F.coalesce(canonical(host), host)


def collector_host(value: Column) -> Column:
    """Host part of a collector address field; empty and all-zero mean none."""
    given = F.when(~value.isin("", "AAAAAA=="), value)
    return host_part(given)


def ip_from(value: Column) -> Column:
    """Address of a collector field: canonical, or the bare text when invalid."""
    host = collector_host(value)
    return F.coalesce(canonical(host), host)


def inet_sort_key(ip: Column) -> Column:
    """Text whose order is numeric address order, IPv4 before IPv6."""
    v4 = F.concat(
        F.lit("4"), *(F.lpad(F.split_part(ip, F.lit("."), F.lit(n)), 3, "0") for n in range(1, 5))
    )
    v6 = F.concat(F.lit("6"), F.replace(_padded_groups(ip), F.lit(":"), F.lit("")))
    return F.when(ip.contains(":"), v6).otherwise(v4)


# Address blocks that are not globally reachable, and the parts
# of them that are (IANA special-purpose address registries).
NOT_GLOBAL = (
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12",
    "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24",
    "203.0.113.0/24", "240.0.0.0/4",
    "::/128", "::1/128", "::ffff:0:0/96", "64:ff9b:1::/48", "100::/64", "2001::/23",
    "2001:db8::/32", "2002::/16", "3fff::/20", "fc00::/7", "fe80::/10",
)
GLOBAL_AFTER_ALL = (
    "192.0.0.9/32", "192.0.0.10/32", "2001:1::1/128", "2001:1::2/128", "2001:3::/32",
    "2001:4:112::/48", "2001:20::/28", "2001:30::/28",
)


def _key_of(address: ipaddress.IPv4Address | ipaddress.IPv6Address) -> str:
    if address.version == 4:
        return "4" + "".join(f"{octet:03d}" for octet in address.packed)
    return "6" + address.packed.hex()


def _within(key: Column, networks: tuple[str, ...]) -> Column:
    inside = F.lit(False)
    for text in networks:
        net = ipaddress.ip_network(text)
        inside = inside | key.between(_key_of(net[0]), _key_of(net[-1]))
    return inside


def is_global(ip: Column) -> Column:
    """Whether the canonical address belongs to the public address space."""
    return _let(
        inet_sort_key(ip),
        lambda key: _within(key, GLOBAL_AFTER_ALL) | ~_within(key, NOT_GLOBAL),
    )


def as_address(text: str | None) -> str | None:
    """Driver-side twin of ``normalize_host`` for one filter value; NULL if not an address."""
    if text is None:
        return None
    try:
        return str(ipaddress.ip_address(text.strip().split("/", 1)[0]))
    except ValueError:
        return None


def as_bare_address(text: str) -> str | None:
    """Canonical form of text that is an address and nothing else."""
    try:
        return str(ipaddress.ip_address(text.strip()))
    except ValueError:
        return None
