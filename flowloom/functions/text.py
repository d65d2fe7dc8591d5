"""Column expressions over text: names, hashes, estimates, redaction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LONGEST_NAME = 253
INVALID_NAME = "<invalid-hostname>"
CHARS_PER_TOKEN = 3.5

# What in a provider's message looks like a secret, from the most particular to the most general.
SECRETS = [
    r"(?i)\b(?:sk|gsk|xai|pk|api)[-_][A-Za-z0-9_\-]{6,}",
    r"(?i)\bbearer\s+[A-Za-z0-9._\-]{6,}",
    r"(?i)\b(?:api[-_]?key|authorization|access[-_]?token|secret|password)\b\s*[:=]\s*\"?[^\s\"',}]{4,}",
    r"\b[A-Za-z0-9_\-]{40,}\b",
]
LONGEST_MESSAGE = 300


def sanitize_hostname(name: Column) -> Column:
    """A name cut to 253 characters, in lower case, without what can't be in a host name; null stays null.

    A name of which nothing is left is marked as invalid, a blank one is null.
    """
    low = F.regexp_replace(F.lower(F.substring(name, 1, LONGEST_NAME)), r"(?U)^\s+|\s+$", "")
    clean = F.regexp_replace(F.regexp_replace(low, r"[^a-z0-9.\-_]", ""), r"^[.\-_]+|[.\-_]+$", "")
    return F.when(low == "", None).when(clean == "", INVALID_NAME).otherwise(clean)


def leftmost_label(name: Column) -> Column:
    return F.split_part(name, F.lit("."), F.lit(1))


def parent_domain(name: Column) -> Column:
    """The last two labels, or the name if it has fewer."""
    parts = F.filter(F.split(name, r"\."), lambda x: x != "")
    return F.when(F.size(parts) >= 2, F.concat_ws(".", F.slice(parts, -2, 2))).otherwise(name)


def entropy(text: Column) -> Column:
    """Shannon entropy in bits a character; 0 for an empty text."""
    chars, n = F.split(text, ""), F.length(text)
    share = lambda c: F.size(F.filter(chars, lambda x: x == c)) / n
    total = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.abs(share(c) * F.log2(share(c))))
    return F.when(n > 0, total).otherwise(F.lit(0.0))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / CHARS_PER_TOKEN).cast("long")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def one_line(text: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)\s+", " "), "^ | $", "")


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the parts, each on a line, the last one with its white space collapsed."""
    return F.sha2(F.concat_ws("\n", *parts[:-1], one_line(parts[-1])), 256)


def redact_secrets(text: Column) -> Column:
    """One line without what looks like a key, at most LONGEST_MESSAGE characters."""
    clean = one_line(text)
    for pattern in SECRETS:
        clean = F.regexp_replace(clean, pattern, "[redacted]")
    return F.when(F.length(clean) > LONGEST_MESSAGE, F.concat(F.substring(clean, 1, LONGEST_MESSAGE), F.lit("..."))).otherwise(clean)


def neutral_fences(text: Column) -> Column:
    """Five or more equal signs in a row get blanks between them."""
    runs = F.regexp_extract_all(text, F.lit("(={5,}|[^=]+|={1,4}(?!=))"), F.lit(1))
    return F.array_join(F.transform(runs, lambda p: F.when(p.rlike("^={5,}$"), F.rtrim(F.regexp_replace(p, "=", "= "))).otherwise(p)), "")
