"""Row-by-row models of the aggregation rules, to check the jobs against."""

from __future__ import annotations

import hashlib
from datetime import timedelta

from flowtide.catalogs import SERVICE_NAMES

META = ("src_as", "dst_as", "src_country", "dst_country", "sampling_rate", "tcp_flags", "flow_type")


def endpoint(proto, src, dst):
    """(service port, side, source port of the key, destination port of the key)"""
    s, d = src or 0, dst or 0
    as_source, as_destination = (s, "source", s, None), (d, "destination", None, d)
    if s == 0 or d == 0:
        if s == d:
            return None, None, None, None
        return as_source if s else as_destination
    votes = (
        ((proto, s) in SERVICE_NAMES, (proto, d) in SERVICE_NAMES),
        (s < 1024, d < 1024),
        (s < 32768, d < 32768),
    )
    for for_source, for_destination in votes:
        if for_source != for_destination:
            return as_source if for_source else as_destination
    return None, None, s, d


def floor5(at):
    return at - timedelta(minutes=at.minute % 5, seconds=at.second, microseconds=at.microsecond)


def conversations(flows):
    """Flows (dicts) in arrival order -> {(bucket, key): conversation}"""
    out = {}
    for flow in flows:
        port, side, key_s, key_d = endpoint(flow["proto"], flow["src_port"], flow["dst_port"])
        parts = (
            flow["exporter"], flow["src_addr"], flow["dst_addr"], flow["proto"], port, side,
            key_s, key_d, flow["in_if"], flow["out_if"],
        )
        text = "|".join("" if p is None else str(p) for p in parts)
        key = floor5(flow["received_at"]), hashlib.sha1(text.encode()).hexdigest()
        if key not in out:
            out[key] = {
                **{k: flow[k] for k in META},
                "src_port": None if side == "destination" else flow["src_port"],
                "dst_port": None if side == "source" else flow["dst_port"],
                "service_port": port, "service_side": side, "first_seen": flow["received_at"],
                "last_seen": flow["received_at"], "flow_time": flow["flow_time"],
                "bytes": 0, "packets": 0, "flow_count": 0,
            }
        row = out[key]
        row["bytes"] += flow["bytes"]
        row["packets"] += flow["packets"]
        row["flow_count"] += 1
        row["last_seen"] = max(row["last_seen"], flow["received_at"])
        if flow["flow_time"] and (row["flow_time"] is None or flow["flow_time"] > row["flow_time"]):
            row["flow_time"] = flow["flow_time"]
        for name in META:
            if flow[name] is not None:
                row[name] = flow[name]
    return out
