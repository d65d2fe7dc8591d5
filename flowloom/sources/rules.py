"""Block rules and the files that hold them."""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.apps import APP_NAMES
from ..functions.network import parse_ip

# The sections of a rule file, in the order in which they are saved, and the kind of rule in each.
SECTIONS = {"[BLOCKED_IPS]": "IP", "[BLOCKED_APPS]": "APP", "[BLOCKED_DOMAINS]": "DOMAIN", "[BLOCKED_PORTS]": "PORT"}

_LEADING_NUMBER = re.compile(r"\s*([+-]?\d+)")


def leading_int(text: str) -> int:
    """The number at the start of a text, whatever follows; an error without one or beyond 32 bits."""
    found = _LEADING_NUMBER.match(text)
    if not found or not -(2**31) <= int(found[1]) < 2**31:
        raise ValueError(f"no number: {text!r}")
    return int(found[1])


@dataclass(frozen=True)
class Rules:
    """What is blocked. Every change gives a new object; each kind keeps the order in which its rules came."""

    ips: tuple[int, ...] = ()
    ports: tuple[int, ...] = ()
    apps: tuple[str, ...] = ()
    domains: tuple[str, ...] = ()
    errors: tuple[str, ...] = field(default=(), compare=False)

    def _with(self, kind: str, value) -> Rules:
        held = getattr(self, kind)
        return self if value in held and kind != "domains" else replace(self, **{kind: (*held, value)})

    def _without(self, kind: str, value) -> Rules:
        held = list(getattr(self, kind))
        if value in held:
            held.remove(value)  # the first of equal ones
        return replace(self, **{kind: tuple(held)})

    def block_ip(self, ip: str | int) -> Rules:
        return self._with("ips", parse_ip(ip) if isinstance(ip, str) else ip)

    def unblock_ip(self, ip: str | int) -> Rules:
        return self._without("ips", parse_ip(ip) if isinstance(ip, str) else ip)

    def block_port(self, port: int) -> Rules:
        return self._with("ports", port & 0xFFFF)

    def unblock_port(self, port: int) -> Rules:
        return self._without("ports", port & 0xFFFF)

    def block_app(self, app: str | int) -> Rules:
        name = APP_NAMES[app] if isinstance(app, int) and 0 <= app < len(APP_NAMES) else app
        return self._with("apps", name) if name in APP_NAMES else replace(self, errors=(*self.errors, f"unknown app: {app!r}"))

    def unblock_app(self, app: str) -> Rules:
        return self._without("apps", app)

    def block_domain(self, domain: str) -> Rules:
        """A name, or a pattern if it has * or ?."""
        return self._with("domains", domain) if is_pattern(domain) or domain.lower() not in self.names else self

    def unblock_domain(self, domain: str) -> Rules:
        return self._without("domains", domain)

    def clear(self) -> Rules:
        return Rules()

    @property
    def names(self) -> list[str]:
        return [d.lower() for d in self.domains if not is_pattern(d)]

    @property
    def patterns(self) -> list[str]:
        return [d.lower() for d in self.domains if is_pattern(d)]

    def stats(self) -> dict[str, int]:
        return {"blocked_ips": len(self.ips), "blocked_apps": len(self.apps), "blocked_domains": len(self.domains), "blocked_ports": len(self.ports)}

    def table(self, spark: SparkSession) -> DataFrame:
        """(kind, value, seq), for joins with rule sets too large for expressions."""
        rows = [("IP", str(v)) for v in self.ips] + [("PORT", str(v)) for v in self.ports] + [("APP", v) for v in self.apps]
        rows += [("PATTERN" if is_pattern(v) else "DOMAIN", v) for v in self.domains]
        return spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "kind string, value string, seq int")

    def save(self) -> str:
        """The text of a rule file."""
        octets = lambda ip: ".".join(str(ip >> s & 255) for s in (0, 8, 16, 24))
        held = {"IP": [octets(v) for v in self.ips], "APP": self.apps, "DOMAIN": [*[d for d in self.domains if not is_pattern(d)], *[d for d in self.domains if is_pattern(d)]], "PORT": map(str, self.ports)}
        return "\n".join("\n".join([section, *held[kind], ""]) for section, kind in SECTIONS.items())


def is_pattern(domain: str) -> bool:
    return "*" in domain or "?" in domain


def parse_rules(text: str, onto: Rules = Rules()) -> Rules:
    """Adds a rule file's lines; ports and apps that can't be read are kept in `errors`. There are no comments."""
    rules, kind = onto, None
    for line in text.splitlines():
        if not line:
            continue
        if line[0] == "[":
            kind = SECTIONS.get(line)
        elif kind == "IP":
            rules = rules.block_ip(line)
        elif kind == "APP":
            rules = rules.block_app(line)
        elif kind == "DOMAIN":
            rules = rules.block_domain(line)
        elif kind == "PORT":
            try:
                rules = rules.block_port(leading_int(line))
            except ValueError as e:
                rules = replace(rules, errors=(*rules.errors, str(e)))
    return rules


def load_rules(spark: SparkSession, path: str, onto: Rules = Rules()) -> Rules | None:
    """Reads a rule file with Spark's readers; None if it can't be opened. Rule files are configuration, a few lines each."""
    try:
        text = spark.read.text(path, wholetext=True).first()
    except Exception:  # noqa: BLE001  whatever the file system says
        return None
    return parse_rules(text.value if text else "", onto)
