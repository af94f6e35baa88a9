"""Address columns: validity, number, segment, network bounds."""

from __future__ import annotations

import ipaddress

from pyspark.sql import Column
from pyspark.sql import functions as F

IPV4 = r"^(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)$"

# Address blocks that belong to no country.
LOCAL_BLOCKS = ["127.0.0.0/8", "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16"]


def is_ipv4(ip: Column) -> Column:
    return ip.rlike(IPV4)


def ip_number(ip: Column) -> Column:
    """IPv4 address as a number; null for anything else."""
    parts = F.split(ip, r"\.")
    value = F.lit(0).cast("bigint")
    for i in range(4):
        value = value * 256 + F.get(parts, F.lit(i)).try_cast("bigint")
    return F.when(is_ipv4(ip), value)


def ip_segment(ip: Column) -> Column:
    """First three parts of an IPv4, first two of an IPv6 address; empty for anything else."""
    v6, v4 = F.split(ip, ":"), F.split(ip, r"\.")
    return F.when(F.contains(ip, F.lit(":")), F.array_join(F.slice(v6, 1, 2), ":")).when(
        F.size(v4) == 4, F.array_join(F.slice(v4, 1, 3), ".")).otherwise("")


def block_bounds(block: str) -> tuple[int, int]:
    """First and last address number of a block or a single address."""
    net = ipaddress.ip_network(block, strict=False)
    return int(net.network_address), int(net.broadcast_address)


def in_blocks(number: Column, blocks: list[str]) -> Column:
    hit = F.lit(False)
    for b in blocks:
        lo, hi = block_bounds(b)
        hit = hit | number.between(lo, hi)
    return hit
