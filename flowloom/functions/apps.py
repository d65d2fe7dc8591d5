"""Host name -> application."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Application codes and display names, in code order.
APP_NAMES = [
    "Unknown", "HTTP", "HTTPS", "DNS", "TLS", "QUIC", "Google", "Facebook", "YouTube", "Twitter/X", "Instagram", "Netflix",
    "Amazon", "Microsoft", "Apple", "WhatsApp", "Telegram", "TikTok", "Spotify", "Zoom", "Discord", "GitHub", "Cloudflare",
]

# What host names tell an application, in the order in which they are tried. How a pattern is
# compared: any = anywhere in the name; domain = the name or a parent domain; label = a whole label; start = a label's beginning.
APP_PATTERNS = [
    ("YouTube", [("any", "youtube"), ("any", "ytimg"), ("domain", "youtu.be"), ("any", "yt3.ggpht")]),
    ("Instagram", [("any", "instagram"), ("any", "cdninstagram")]),
    ("WhatsApp", [("any", "whatsapp"), ("domain", "wa.me")]),
    ("Facebook", [("any", "facebook"), ("any", "fbcdn"), ("domain", "fb.com"), ("any", "fbsbx"), ("domain", "meta.com")]),
    ("Netflix", [("any", "netflix"), ("any", "nflxvideo"), ("any", "nflximg")]),
    ("GitHub", [("any", "github"), ("any", "githubusercontent")]),
    ("TikTok", [("any", "tiktok"), ("any", "tiktokcdn"), ("domain", "musical.ly"), ("any", "bytedance")]),
    ("Telegram", [("any", "telegram"), ("domain", "t.me")]),
    ("Spotify", [("any", "spotify"), ("domain", "scdn.co")]),
    ("Discord", [("any", "discord"), ("any", "discordapp")]),
    ("Zoom", [("label", "zoom")]),
    ("Twitter/X", [("any", "twitter"), ("any", "twimg"), ("domain", "x.com"), ("domain", "t.co")]),
    ("Google", [("any", "google"), ("any", "gstatic"), ("any", "googleapis"), ("any", "ggpht"), ("any", "gvt1")]),
    ("Amazon", [("any", "amazon"), ("any", "amazonaws"), ("any", "cloudfront"), ("label", "aws")]),
    ("Microsoft", [("any", "microsoft"), ("domain", "msn.com"), ("start", "office"), ("any", "azure"), ("domain", "live.com"), ("any", "outlook"), ("label", "bing")]),
    ("Apple", [("label", "apple"), ("any", "icloud"), ("any", "mzstatic"), ("any", "itunes")]),
    ("Cloudflare", [("any", "cloudflare"), ("start", "cf-")]),
]

_COMPARE = {
    "any": lambda host, p: host.contains(p),
    "domain": lambda host, p: (host == p) | host.endswith("." + p),
    "label": lambda host, p: F.concat(F.lit("."), host, F.lit(".")).contains(f".{p}."),
    "start": lambda host, p: F.concat(F.lit("."), host).contains("." + p),
}


def classify_host(host: Column) -> Column:
    """The application of a host name: `Unknown` without a name, `HTTPS` for a name that no pattern tells."""
    name = F.lower(host)
    found = F.when(host.isNull() | (host == ""), "Unknown")
    for app, patterns in APP_PATTERNS:
        tests = [_COMPARE[kind](name, p) for kind, p in patterns]
        found = found.when(reduce(Column.__or__, tests), app)
    return found.otherwise("HTTPS")


def app_code(app: Column) -> Column:
    """The code of a display name (0 for any other)."""
    return F.coalesce(F.create_map(*[F.lit(x) for k, n in enumerate(APP_NAMES) for x in (n, k)])[app], F.lit(0))


def app_name(code: Column) -> Column:
    """The display name of a code (`Unknown` for any other)."""
    return F.when(code.between(0, len(APP_NAMES) - 1), F.element_at(F.array(*map(F.lit, APP_NAMES)), code + 1)).otherwise("Unknown")


def classify_sql(host: str) -> str:
    """The same decision as a SQL expression, for comparing engines."""
    sql = {
        "any": "contains(h, '{p}')", "domain": "(h = '{p}' or h like '%.{p}')",
        "label": "contains('.' || h || '.', '.{p}.')", "start": "contains('.' || h, '.{p}')",
    }
    whens = " ".join(
        f"when {' or '.join(sql[kind].format(p=p) for kind, p in patterns)} then '{app}'" for app, patterns in APP_PATTERNS
    )
    return f"(select case when h is null or h = '' then 'Unknown' {whens} else 'HTTPS' end from (select lower({host}) as h))"
