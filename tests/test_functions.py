import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from flowtide.functions import buckets, ip, labels, proto, service, variants, walk
from flowtide.operators.condense import with_service


def column(spark, values, function, dtype="string"):
    rows = [(n, v) for n, v in enumerate(values)]
    frame = spark.createDataFrame(rows, f"n int, v {dtype}").coalesce(1)
    return [r[0] for r in frame.orderBy("n").select(function(F.col("v"))).collect()]


def test_ip_from(spark):
    cases = {
        "10.0.0.1": "10.0.0.1", "10.0.0.1/32": "10.0.0.1", " 10.0.0.1\t": "10.0.0.1",
        "2001:DB8:0::1": "2001:db8::1", "2001:db8::1/128": "2001:db8::1", "": None,
        "AAAAAA==": None, "abc/12": "abc", None: None, "::": "::", "256.1.1.1": "256.1.1.1",
        "010.0.0.1": "010.0.0.1",
    }
    assert column(spark, list(cases), ip.ip_from) == list(cases.values())


def test_normalize_host_is_not_containment(spark):
    cases = {"10.0.0.0/24": "10.0.0.0", "": "", "AAAAAA==": "AAAAAA==", "FE80::/10": "fe80::"}
    assert column(spark, list(cases), ip.normalize_host) == list(cases.values())


def _addresses():
    rng = random.Random(7)
    texts = [
        "::1", "1::", "::ffff:1.2.3.4", "::1.2.3.4", "1:0:0:2:0:0:0:3", "1:0:0:2:0:0:3:4",
        "0:0:1:0:0:0:0:0", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:0:2:0:3:0:4:0", "fe80::1%eth0",
        "1::2::3", ":::", ":1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", "12345::", "g::1", "1:2", "::1:", ":",
        "2001:0db8:0000:0000:0000:ff00:0042:8329", "64:ff9b::192.0.2.33", "::256.1.1.1",
    ]
    for _ in range(300):
        groups = [rng.choice(["0", "0", "0", f"{rng.randrange(65536):x}", f"{rng.randrange(65536):04X}"]) for _ in range(8)]
        texts.append(":".join(groups))
    return texts


def test_ipv6_text_matches_the_standard_library(spark):
    def model(text):
        try:
            address = ipaddress.ip_address(text)
        except ValueError:
            return None
        if address.version == 6 and address.scope_id:
            return None
        mapped = address.ipv4_mapped if address.version == 6 else None
        return f"::ffff:{mapped}" if mapped else str(address)

    texts = _addresses()
    assert column(spark, texts, ip.canonical) == [model(t) for t in texts]


def test_inet_order(spark):
    texts = ["2001:db8::1", "10.0.0.10", "::5", "10.0.0.2", "9.0.0.1", None]
    keys = column(spark, texts, ip.inet_sort_key)
    ordered = [t for _, t in sorted((k, t) for k, t in zip(keys, texts) if k)]
    assert ordered == ["9.0.0.1", "10.0.0.2", "10.0.0.10", "::5", "2001:db8::1"]


def test_is_global_matches_the_standard_library(spark):
    rng = random.Random(3)
    texts = [
        "192.0.0.9", "192.0.0.8", "100.64.0.1", "100.128.0.1", "8.8.8.8", "224.0.0.1", "255.255.255.255",
        "2606:4700::1111", "2001:db8::1", "2001:20::1", "2001:10::1", "fe80::1", "fd00::1", "::1", "2002::1",
        "64:ff9b::1", "64:ff9b:1::1", "100::1", "ff02::1",
    ]
    texts += [str(ipaddress.IPv4Address(rng.randrange(2**32))) for _ in range(200)]
    assert column(spark, texts, ip.is_global) == [ipaddress.ip_address(t).is_global for t in texts]


def test_protocols(spark):
    cases = {
        "TCP": 6, "tcp": 6, " UDP ": 17, "17": 17, "IPv6_ICMP": 58, "ICMPv6": 58, "ipv6-route": 43,
        "": None, None: None, "HOPOPT": None, "6.9": None,
    }
    assert column(spark, list(cases), proto.protocol_from_text) == list(cases.values())
    names = {6: "TCP", 43: "IP/43", 255: "IP/255", None: "Unknown", 58: "ICMPv6", 132: "SCTP"}
    assert column(spark, list(names), proto.protocol_name, "int") == list(names.values())


def test_app_names(spark):
    rows = [
        (6, 443, None, "HTTPS · TCP/443"), (6, 9200, None, "TCP/9200"), (17, 443, None, "UDP/443"),
        (1, 0, None, "Other · ICMP"), (None, None, None, "Other · Unknown"),
        (6, 8006, "Proxmox", "Proxmox TCP/8006"), (17, 53, None, "DNS · UDP/53"),
    ]
    frame = spark.createDataFrame(rows, "p int, q int, d string, want string")
    got = frame.select(proto.service_label(F.col("d"), F.col("p"), F.col("q")), "want").collect()
    assert all(g == w for g, w in got)


ENDPOINTS = [
    (1, 0, 0, None, None, None, None), (6, 8080, 0, 8080, "source", 8080, None),
    (6, 0, 8080, 8080, "destination", None, 8080), (6, 443, 51000, 443, "source", 443, None),
    (6, 33060, 50000, 33060, "source", 33060, None), (6, 51000, 443, 443, "destination", None, 443),
    (17, 40000, 51820, 51820, "destination", None, 51820), (6, 443, 8443, 443, "source", 443, None),
    (6, 8080, 443, 443, "destination", None, 443), (17, 443, 50000, 443, "source", 443, None),
    (6, 179, 30000, 179, "source", 179, None), (6, 1023, 1024, 1023, "source", 1023, None),
    (6, 30000, 179, 179, "destination", None, 179), (6, 9200, 40000, 9200, "source", 9200, None),
    (6, 32767, 32768, 32767, "source", 32767, None), (6, 40000, 9200, 9200, "destination", None, 9200),
    (6, 1024, 32767, None, None, 1024, 32767), (6, 45000, 50000, None, None, 45000, 50000),
    (17, 53, 53, None, None, 53, 53), (6, 22, 443, None, None, 22, 443),
    (None, 500, 40000, 500, "source", 500, None), (6, None, None, None, None, None, None),
]


def test_service_endpoint(spark):
    frame = spark.createDataFrame(
        [(n, *case[:3]) for n, case in enumerate(ENDPOINTS)], "n int, proto int, src_port int, dst_port int"
    )
    got = with_service(frame).orderBy("n").select(
        "service_port", "service_side", "key_src_port", "key_dst_port"
    ).collect()
    assert [tuple(r) for r in got] == [case[3:] for case in ENDPOINTS]


def test_model_agrees_on_endpoints():
    from brute import endpoint

    for p, s, d, *want in ENDPOINTS:
        assert endpoint(p, s, d) == tuple(want)


def test_key_keeps_empty_slots(spark):
    import hashlib

    names = ", ".join(f"cast(null as string) as {n}" for n in service.KEY_PARTS if n != "proto")
    key = spark.sql(f"select {names}, 6 as proto").select(service.conversation_key()).first()[0]
    assert key == hashlib.sha1(b"|||6||||||").hexdigest()


def test_flow_time(spark):
    values = [1700000000123456000, 0, -5, None]
    got = [str(x) if x else None for x in column(spark, values, lambda c: buckets.nanos_to_timestamp(c).cast("string"), "bigint")]
    assert got == ["2023-11-14 22:13:20.123456", None, None, None]


@pytest.mark.parametrize(
    "line, want",
    [('{"f":1.9}', 1), ('{"f":"1.9"}', None), ('{"f":true}', 1), ('{"f":"12"}', 12), ('{"f":" 12 "}', 12),
     ('{"f":null}', None), ("{}", None), ('{"f":"+6"}', 6), ('{"f":[1]}', None), ('{"f":-3.7}', -3)],
)
def test_as_int(spark, line, want):
    got = column(spark, [line], lambda c: variants.int_field(F.try_parse_json(c), "f"))
    assert got == [want]


def test_flow_type_of_missing_and_null(spark):
    lines = ['{"type":null}', "{}", '{"type":"IPFIX"}', '{"type":""}']
    got = column(spark, lines, lambda c: variants.flow_type_field(F.try_parse_json(c)))
    assert got == ["None", "", "IPFIX", ""]


def test_interface_labels(spark):
    rows = [
        (7, None, "ether1", "d", "up", "ether1 (up)"), (7, "mine", "ether1", "d", None, "mine"),
        (7, "", "", "", "up", "ifIndex 7 (up)"), (7, None, None, None, "", "ifIndex 7"),
        (None, None, None, None, None, "ifIndex —"),
    ]
    frame = spark.createDataFrame(rows, "i int, c string, n string, d string, a string, want string")
    names = [F.col(x) for x in "cnda"]
    got = frame.select(labels.interface_label(*names, labels.if_index_text(F.col("i"), labels.DASH)), "want").collect()
    assert all(g == w for g, w in got)
    nothing = frame.filter("i is null").select(
        labels.interface_label(*names, labels.if_index_text(F.col("i")), F.lit(None).cast("string"))
    ).first()[0]
    assert nothing is None


def test_contains_pattern():
    assert labels.contains_pattern("a_b%c") == "%a_b%c%"
    assert labels.contains_pattern("a\\_b\\d") == "%a\\_bd%"


def test_walk_lines(spark):
    lines = [
        '.1.3.6.1.2.1.31.1.1.1.1.3 = STRING: "ether3"', "1.3.6.1.2.1.2.2.1.5.4 = Gauge32: 1000000000",
        "Timeout: No Response", '.1.3.6.1.2.1.31.1.1.1.18.3 = ""',
    ]
    got = column(spark, lines, walk.line_parts)
    assert [tuple(r) if r else None for r in got] == [
        ("1.3.6.1.2.1.31.1.1.1.1.3", 3, "ether3"), ("1.3.6.1.2.1.2.2.1.5.4", 4, "1000000000"), None,
        ("1.3.6.1.2.1.31.1.1.1.18.3", 3, ""),
    ]
    assert column(spark, ["up(1)", "x", "-5 dB"], walk.first_integer) == [1, None, -5]
