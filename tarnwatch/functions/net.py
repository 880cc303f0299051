"""Column functions on addresses, ports, protocols and flags."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from tarnwatch import constants as K
from tarnwatch.functions.columns import cases, col, lookup

_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4_PATTERN = f"^{_OCTET}\\.{_OCTET}\\.{_OCTET}\\.{_OCTET}$"
_LABEL = "[a-zA-Z0-9](?:[a-zA-Z0-9-]{0,61}[a-zA-Z0-9])?"
# fixed value: host name syntax
DOMAIN_PATTERN = f"^(?:{_LABEL}\\.)*{_LABEL}$"


@F.pandas_udf(BooleanType())
def _is_ipv6(values: pd.Series) -> pd.Series:
    def check(text) -> bool:
        try:
            return ipaddress.ip_address(text).version == 6
        except ValueError:
            return False
    return values.map(check)


@F.pandas_udf(BooleanType())
def _ipv6_in_network(values: pd.Series, networks: pd.Series) -> pd.Series:
    def check(text, net) -> bool:
        try:
            return ipaddress.ip_address(text) in ipaddress.ip_network(net, strict=False)
        except ValueError:
            return False
    return pd.Series([check(t, n) for t, n in zip(values, networks)])


def is_ipv4(ip) -> Column:
    return F.coalesce(col(ip).rlike(IPV4_PATTERN), F.lit(False))


def is_valid_ip(ip, ipv6: bool = True) -> Column:
    """IPv4 stays in the JVM; only texts holding a colon reach the IPv6 check."""
    if not ipv6:
        return is_ipv4(ip)
    c = col(ip)
    return is_ipv4(c) | (F.coalesce(c.contains(":"), F.lit(False))
                         & _is_ipv6(F.when(c.contains(":"), c).otherwise("")))


def is_valid_domain(domain) -> Column:
    c = col(domain)
    return F.coalesce(c.rlike(DOMAIN_PATTERN) & (F.length(c) <= 253), F.lit(False))


def ipv4_to_long(ip) -> Column:
    """Dotted quad as BIGINT; NULL when the text is not IPv4."""
    parts = F.split(col(ip), "\\.")
    value = sum((parts[i].try_cast("long") * (256 ** (3 - i)) for i in range(1, 4)),
                parts[0].try_cast("long") * (256 ** 3))
    return F.when(is_ipv4(ip), value)


def ip_in_network(ip, network: str) -> Column:
    """Exact address or CIDR with non-strict host bits, for a literal network."""
    if "/" not in network:
        return F.coalesce(col(ip) == network, F.lit(False))
    try:
        parsed = ipaddress.ip_network(network, strict=False)
    except ValueError:
        return F.lit(False)
    if parsed.version == 4:
        first, last = int(parsed.network_address), int(parsed.broadcast_address)
        return F.coalesce(ipv4_to_long(ip).between(first, last), F.lit(False))
    return (F.coalesce(col(ip).contains(":"), F.lit(False))
            & _ipv6_in_network(F.coalesce(col(ip), F.lit("")), F.lit(network)))


def ip_in_cidr(ip, cidr) -> Column:
    """Same test for a per-row IPv4 CIDR column: compare the shared prefix."""
    c = col(cidr)
    base = F.split(c, "/")[0]
    bits = F.coalesce(F.split(c, "/")[1].try_cast("int"), F.lit(32))
    size = F.pow(F.lit(2.0), F.lit(32) - bits)
    block = lambda x: F.floor(ipv4_to_long(x) / size)
    return F.coalesce(block(ip) == block(base), F.lit(False))


def flow_protocol_code(protocol) -> Column:
    return lookup(F.upper(col(protocol)), K.FLOW_PROTOCOL_CODES, 0.0)


def behavior_protocol_number(protocol) -> Column:
    return lookup(F.upper(col(protocol)), K.BEHAVIOR_PROTOCOL_NUMBERS, 0.0)


def port_category(port) -> Column:
    return cases([(col(port) < 1024, 1.0), (col(port) < 49152, 2.0)], 3.0)


def has_flag(flags, name: str) -> Column:
    lowered = F.transform(col(flags), F.lower)
    return F.coalesce(F.array_contains(lowered, name), F.lit(False)).cast("double")


def decode_tcp_flags(bits) -> Column:
    """Integer flag field to flag names, lowest bit first."""
    names = [F.when(col(bits).bitwiseAND(1 << i) != 0, F.lit(flag))
             for i, flag in enumerate(K.TCP_FLAG_BITS)]
    return F.array_compact(F.array(*names))


def flow_key(source_ip="source_ip", destination_ip="destination_ip", source_port="source_port",
             destination_port="destination_port", protocol="protocol") -> Column:
    """Direction-free key: addresses and ports are ordered independently."""
    a, b, p, q = col(source_ip), col(destination_ip), col(source_port), col(destination_port)
    return F.concat(F.least(a, b), F.lit(":"), F.least(p, q).cast("string"), F.lit("-"),
                    F.greatest(a, b), F.lit(":"), F.greatest(p, q).cast("string"), F.lit("-"),
                    col(protocol))
