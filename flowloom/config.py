"""Settings from the environment; secrets are masked wherever settings are shown."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field

from .operators.context import MAX_CHARS, MAX_ITEMS, MAX_TOKENS
from .operators.report import MAX_FLOWS

PREFIX = "FLOWLOOM_"
#: What a budget may be to have no limit.
UNLIMITED = ("none", "off", "unlimited")


def _number(value: str) -> int | None:
    return None if value.strip().lower() in UNLIMITED else int(value)


@dataclass(frozen=True)
class Settings:
    max_flows: int = MAX_FLOWS
    address_mode: str = "redact_private"
    max_items: int | None = MAX_ITEMS
    max_chars: int | None = MAX_CHARS
    max_tokens: int | None = MAX_TOKENS
    max_input_tokens: int | None = None
    api_key: str = field(default="", repr=False)

    @staticmethod
    def from_env(env: dict[str, str] | None = None, file: str | None = None) -> Settings:
        """From variables FLOWLOOM_<NAME>; a file of KEY=value lines fills in what the environment lacks."""
        held = dict(os.environ if env is None else env)
        if file and os.path.exists(file):
            for line in open(file, encoding="utf-8"):
                key, sep, value = line.strip().partition("=")
                if sep and not key.startswith("#"):
                    held.setdefault(key.removeprefix("export ").strip(), value.strip().strip("\"'"))
        found = {k[len(PREFIX) :].lower(): v for k, v in held.items() if k.startswith(PREFIX)}
        numbers = {k: _number(found[k]) for k in ("max_flows", "max_items", "max_chars", "max_tokens", "max_input_tokens") if k in found}
        mode = found.get("address_mode", "redact_private")
        if mode not in ("full", "redact_private", "none"):
            raise ValueError(f"unknown address mode: {mode}")
        return Settings(**numbers, address_mode=mode, api_key=found.get("api_key", ""))

    def shown(self) -> dict:
        key = self.api_key
        return asdict(self) | {"api_key": f"{key[:2]}...{key[-2:]}" if len(key) > 8 else "set" if key else "not set"}
