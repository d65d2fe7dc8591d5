"""What each packet says about its flow: candidate application and name, and rule verdicts that don't need the flow."""

from __future__ import annotations

import fnmatch
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.apps import classify_host
from ..functions.payload import HTTP_PORTS, dns_query_name, http_host, is_dns_query, is_tls_client_hello, tls_server_name
from ..sources.rules import Rules
from .decode import _once, payload
from .patterns import pattern_matches

#: What a packet may say: (application, name, how it was told). The first that applies counts.
TLS, HTTP, DNS, PORT = "tls", "http", "dns", "port"


def inspect(packets: DataFrame, policy: str = "engine") -> DataFrame:
    """Adds cand_app, cand_name and cand_kind (null if the packet tells nothing).

    The gates differ by policy: `engine` tries TLS on port 443 or from 50 bytes on, HTTP on its four usual ports and DNS with a
    readable question; `working` and `mt` look at ports 443 and 80 only, and DNS is told by port.
    The payload walks are Python, so rows are first split by the JVM's gates.
    """
    body, n, dst = payload(), F.col("payload_length"), F.col("dst_port")
    dns = (dst == 53) | (F.col("src_port") == 53)
    some = n > 0
    if policy == "engine":
        try_tls, try_http = some & ((dst == 443) | (n >= 50)), some & dst.isin(*HTTP_PORTS)
    else:
        try_tls = F.col("has_tcp") & (dst == 443) & (n > 5) if policy == "working" else (dst == 443) & (n > 5)
        try_http = F.col("has_tcp") & (dst == 80) & some if policy == "working" else (dst == 80) & (n > 10)
    # Only payloads that pass a gate go to the Arrow functions; others become null, which costs them nothing.
    hello = F.when(try_tls & is_tls_client_hello(body), body)
    p = packets.withColumns({"_sni": tls_server_name(hello), "_host": F.when(try_http, http_host(body))})
    if policy == "engine":
        p = p.withColumn("_dns", dns_query_name(F.when(some & dns & is_dns_query(body), body)))
        port = F.when(some & dst.isin(*HTTP_PORTS), "HTTP").when(some & (dst == 443), "HTTPS")
        told = [
            (F.col("_sni").isNotNull(), classify_host(F.col("_sni")), F.col("_sni"), TLS),
            (F.col("_host").isNotNull(), classify_host(F.col("_host")), F.col("_host"), HTTP),
            (F.col("_dns").isNotNull(), F.lit("DNS"), F.col("_dns"), DNS),
            (port.isNotNull() & ~dns, port, F.lit(""), PORT),
        ]
    else:
        told = [
            (F.col("_sni") != "", classify_host(F.col("_sni")), F.col("_sni"), TLS),
            (F.col("_host") != "", classify_host(F.col("_host")), F.col("_host"), HTTP),
        ]
    pick = lambda k: reduce(lambda c, t: c.when(t[0], t[k] if isinstance(t[k], Column) else F.lit(t[k])), told, F.when(F.lit(False), F.lit(None).cast("string")))
    p = _once(p, cand_app=pick(1), cand_name=pick(2), cand_kind=pick(3))
    return p.drop("_sni", "_host", "_dns")


def glob_regex(pattern: str) -> str:
    """An anchored regular expression for a domain pattern: `*.x` is x and all below it, any other is a glob."""
    p = pattern.lower()
    if p.startswith("*."):
        return r"(?s)\A(?:.*\.)?" + _quote(p[2:]) + r"\z"
    out, at = "", 0
    while at < len(p):
        c, at = p[at], at + 1
        end = p.find("]", at + 1 + p.startswith("!", at)) if c == "[" else -1
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif end > 0:
            inside = p[at:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&").replace("^", "\\^")
            out += "[" + ("^" + inside[1:] if inside[0] == "!" else inside) + "]"
            at = end + 1
        else:
            out += _quote(c)
    return rf"(?s)\A{out}\z"


def _quote(text: str) -> str:
    return "".join(c if c.isalnum() else "\\" + c if ord(c) < 128 else c for c in text)


def matches_pattern(domain: str, pattern: str) -> bool:
    """The same for one pair, on the driver."""
    if pattern.startswith("*."):
        return domain == pattern[2:] or domain.endswith(pattern[1:])
    return fnmatch.fnmatchcase(domain, pattern)


def domain_blocked(name: Column, rules: Rules) -> Column:
    """Whether a name is blocked: case-folded, exactly or by a pattern."""
    low = F.lower(name)
    tests = ([low.isin(*rules.names)] if rules.names else []) + [low.rlike(glob_regex(p)) for p in rules.patterns]
    return F.coalesce((name != "") & reduce(Column.__or__, tests), F.lit(False)) if tests else F.lit(False)


def name_contains(name: Column, rules: Rules) -> Column:
    """The simpler policies' rule: any blocked domain is part of the name, as written; an empty one is part of all."""
    return reduce(Column.__or__, [F.coalesce(name, F.lit("")).contains(d) for d in rules.domains], F.lit(False))


def block_reason(src_ip: Column, dst_port: Column, app: Column, name: Column, rules: Rules) -> Column:
    """The first rule that blocks: IP, then PORT, then APP, then DOMAIN; null if none does."""
    return (
        F.when(src_ip.isin(*rules.ips) if rules.ips else F.lit(False), "IP")
        .when(dst_port.isin(*rules.ports) if rules.ports else F.lit(False), "PORT")
        .when(app.isin(*rules.apps) if rules.apps else F.lit(False), "APP")
        .when(domain_blocked(name, rules), "DOMAIN")
    )


def block_reason_by_join(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """The same for rule tables (kind, value) of any size: joins on values for exact rules, an automaton over distinct names for patterns.

    rows: src_ip_s, dst_port, app, name. Adds `reason`.
    """
    def exact(kind: str, column: Column, flag: str) -> tuple[DataFrame, Column]:
        side = rules.where(F.col("kind") == kind).select(F.lower("value").alias(f"_{flag}")).distinct()
        return side, F.lower(column.cast("string")) == F.col(f"_{flag}")

    out = rows
    for kind, column in (("IP", F.col("src_ip_s")), ("PORT", F.col("dst_port")), ("APP", F.col("app")), ("DOMAIN", F.col("name"))):
        side, on = exact(kind, column, kind)
        out = out.join(side, on, "left")
    hit = pattern_matches(rows, rules.where("kind = 'PATTERN'")).select(F.col("name").alias("n")).distinct().withColumn("_PATTERN", F.lit(True))
    out = out.join(hit, F.lower("name") == F.col("n"), "left").drop("n")
    reason = F.when(F.col("_IP").isNotNull(), "IP").when(F.col("_PORT").isNotNull(), "PORT").when(F.col("_APP").isNotNull(), "APP")
    return out.withColumn("reason", reason.when((F.col("_DOMAIN").isNotNull() & (F.col("name") != "")) | F.col("_PATTERN"), "DOMAIN")).drop("_IP", "_PORT", "_APP", "_DOMAIN", "_PATTERN")
