"""URLs, page outcomes and redaction."""

from __future__ import annotations

import ipaddress
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BLOCK_SIGNATURES, BLOCKED_NETWORKS


def host_of(url: Column) -> Column:
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def is_https(url: Column) -> Column:
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))) == "https", F.lit(False))


def safe_url(candidate: Column, fallback: Column, hosts: Column) -> Column:
    """The candidate if it is https on an allowed host (array of hosts), else so the fallback, else null."""
    fine = lambda u: is_https(u) & F.coalesce(F.array_contains(hosts, host_of(u)), F.lit(False))
    return F.coalesce(F.when(fine(candidate), candidate), F.when(fine(fallback), fallback))


def registrable_domain(host: Column) -> Column:
    """The last two labels of a host."""
    labels = F.split(F.lower(host), r"\.")
    return F.when(F.size(labels) < 2, F.lower(host)).otherwise(F.array_join(F.slice(labels, -2, 2), "."))


def page_outcome(status: Column, body: Column, sentinels: tuple[str, ...] = ()) -> Column:
    """Struct (outcome, signature) of a fetched page; the first rule that holds decides."""
    lowered = F.lower(F.coalesce(body, F.lit("")))
    signature = F.lit(None).cast("string")
    for s in reversed(BLOCK_SIGNATURES):
        signature = F.when(lowered.contains(s), F.lit(s)).otherwise(signature)
    known = F.lit(not sentinels)
    for s in sentinels:
        known = known | F.coalesce(body, F.lit("")).contains(s)
    outcome = (
        F.when(signature.isNotNull() | status.isin(403, 429), "BLOCKED")
        .when(status == 404, "NOT_FOUND")
        .when(~known | (F.trim(F.coalesce(body, F.lit(""))) == ""), "EMPTY")
        .otherwise("OK")
    )
    told = F.coalesce(signature, F.when(status.isin(403, 429), F.concat(F.lit("http_"), status.cast("string"))))
    return F.struct(outcome.alias("outcome"), told.alias("signature"))


def redact(text: Column) -> Column:
    """User information in URLs and the values of credential fields blanked; null becomes empty."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"://[^/@\s]+:[^/@\s]+@", "://[REDACTED]@")
    names = r"(?i)\b(password|passwd|pwd|api[_-]?key|secret|token|access[_-]?key)\s*=\s*[^&\s;]+"
    return F.regexp_replace(plain, names, "$1=[REDACTED]")


@F.pandas_udf(T.BooleanType())
def is_public_ip(address: pd.Series) -> pd.Series:
    """Whether an address lies outside all blocked networks; false for what is no address."""
    nets = [ipaddress.ip_network(n) for n in BLOCKED_NETWORKS]

    def one(text: str | None) -> bool:
        try:
            ip = ipaddress.ip_address((text or "").strip())
        except ValueError:
            return False
        inner = getattr(ip, "ipv4_mapped", None) or ip
        special = inner.is_loopback or inner.is_link_local or inner.is_multicast or inner.is_reserved or inner.is_unspecified
        return not special and not any(inner.version == n.version and inner in n for n in nets)

    return address.map(one)


def blocked_ipv4(address: Column) -> Column:
    """Whether a dotted IPv4 address lies in a blocked network, in SQL functions only."""
    parts = F.transform(F.split(address, r"\."), lambda p: p.try_cast("bigint"))
    number = F.aggregate(parts, F.lit(0).cast("bigint"), lambda n, p: n * 256 + p)
    ranges = [(int(n.network_address), int(n.broadcast_address)) for n in map(ipaddress.ip_network, BLOCKED_NETWORKS) if n.version == 4]
    inside = F.lit(False)
    for low, high in ranges:
        inside = inside | number.between(low, high)
    return inside


@F.pandas_udf(T.BooleanType())
def robots_allow(robots: pd.Series, agent: pd.Series, url: pd.Series) -> pd.Series:
    """Whether a robots file lets both the agent and everyone fetch a URL; a missing file denies."""
    kept: dict[str, RobotFileParser] = {}

    def one(text: str | None, who: str, where: str) -> bool:
        if not text or not text.strip():
            return False
        if text not in kept:
            kept[text] = RobotFileParser()
            kept[text].parse(text.splitlines())
        return kept[text].can_fetch(who, where) and kept[text].can_fetch("*", where)

    return pd.Series([one(*row) for row in zip(robots, agent, url)], dtype="bool")
