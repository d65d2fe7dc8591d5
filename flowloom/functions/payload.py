"""Names in payloads: TLS server names, HTTP hosts, DNS queries.

Cheap gates are JVM expressions. What needs a walk over length-prefixed fields is one
Arrow UDF over binary columns; it gates itself, since Spark may run a Python UDF on rows that a CASE skips.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType

from .network import uint

HTTP_PORTS = (80, 8000, 8080, 8888)
HTTP_METHODS = ("GET ", "POST", "PUT ", "HEAD", "DELE", "PATC", "OPTI")


def is_tls_client_hello(payload: Column) -> Column:
    """A handshake record of SSL 3.0 to TLS 1.3 that fits in the payload and starts a client hello."""
    return F.coalesce(
        (F.octet_length(payload) >= 9) & (uint(payload, 0, 1) == 0x16) & uint(payload, 1, 2).between(0x0300, 0x0304)
        & (uint(payload, 3, 2) <= F.octet_length(payload) - 5) & (uint(payload, 5, 1) == 1), F.lit(False),
    )


def is_http_request(payload: Column) -> Column:
    return F.coalesce(F.decode(payload.substr(1, 4), "ISO-8859-1").isin(*HTTP_METHODS), F.lit(False))


def is_dns_query(payload: Column) -> Column:
    """A DNS header with the response bit clear and at least one question."""
    return F.coalesce((F.octet_length(payload) >= 12) & (uint(payload, 2, 1) < 128) & (uint(payload, 4, 2) > 0), F.lit(False))


def is_quic_initial(payload: Column) -> Column:
    """Five bytes with the long-header bit set; the version isn't checked."""
    return F.coalesce((F.octet_length(payload) >= 5) & (uint(payload, 0, 1) >= 128), F.lit(False))


def http_host(payload: Column) -> Column:
    """The first non-empty Host header of a request, without its port; null if there is none.

    A header line starts the payload or follows a line break; an empty value is passed over.
    """
    text = F.decode(payload, "ISO-8859-1")
    value = F.regexp_extract(text, r"(?i)(?:^|[\r\n])host:[ \t]*([^ \t\r\n][^\r\n]*)", 1)
    return F.when(is_http_request(payload) & (value != ""), F.split_part(value, F.lit(":"), F.lit(1)))


class _Fields:
    """Reads length-prefixed fields; `left` tells how much is there."""

    def __init__(self, data: bytes, at: int, end: int):
        self.data, self.at, self.end = data, at, end

    def has(self, n: int) -> bool:
        return self.at + n <= self.end

    def number(self, n: int) -> int:
        self.at += n
        return int.from_bytes(self.data[self.at - n : self.at], "big")

    def skip(self, prefix: int) -> bool:
        """Passes a field with a length prefix; false if the prefix isn't there."""
        if not self.has(prefix):
            return False
        size = self.number(prefix)
        self.at += size
        return True


def hello_extensions(data: bytes) -> list[tuple[int, bytes]]:
    """(type, body) of the extensions of a client hello; a list cut short is read as far as it goes."""
    n = len(data)
    if n < 9 or data[0] != 0x16 or not 0x0300 <= int.from_bytes(data[1:3], "big") <= 0x0304 or int.from_bytes(data[3:5], "big") > n - 5 or data[5] != 1:
        return []
    # Record header 5, handshake header 4, version 2, random 32; then session id, cipher suites, compression methods.
    fields = _Fields(data, 43, n)
    if not (fields.skip(1) and fields.skip(2) and fields.skip(1) and fields.has(2)):
        return []
    size = fields.number(2)
    fields.end = min(n, fields.at + size)
    found = []
    while fields.has(4):
        kind, size = fields.number(2), fields.number(2)
        if not fields.has(size):
            break
        found.append((kind, data[fields.at : fields.at + size]))
        fields.at += size
    return found


def server_name(data: bytes | None) -> str | None:
    """The host name of the first usable server-name extension (it may be empty); null if there is none."""
    for kind, body in hello_extensions(data or b""):
        if kind == 0 and len(body) >= 5 and int.from_bytes(body[:2], "big") >= 3 and body[2] == 0:
            size = int.from_bytes(body[3:5], "big")
            if size <= len(body) - 5:
                return body[5 : 5 + size].decode("latin-1")
    return None


def dns_name(data: bytes | None) -> str | None:
    """The queried name: labels from byte 12 up to a zero, a pointer or the end; null if there are none."""
    if not data or len(data) < 12 or data[2] & 0x80 or not (data[4] | data[5]):
        return None
    at, labels = 12, []
    while at < len(data) and 0 < data[at] < 64 and at + 1 + data[at] <= len(data):
        labels.append(data[at + 1 : at + 1 + data[at]].decode("latin-1"))
        at += 1 + data[at]
    return ".".join(labels) or None


def quic_name(data: bytes | None) -> str | None:
    """A server name in what looks like a client hello inside a long-header packet."""
    if not data or len(data) < 5 or data[0] < 128:
        return None
    at = data.find(1, 5)
    while 0 <= at < len(data) - 50:
        name = server_name(data[at - 5 :])
        if name is not None:
            return name
        at = data.find(1, at + 1)
    return None


def _series(walk):
    def run(payload: pd.Series) -> pd.Series:
        return payload.map(lambda b: walk(bytes(b)) if b is not None else None)

    run.__annotations__ = {"payload": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, StringType())


tls_server_name = _series(server_name)
dns_query_name = _series(dns_name)
quic_server_name = _series(quic_name)


@udtf(returnType=StructType().add("type", IntegerType()).add("body", StringType()))
class TlsExtensions:
    """Table function: one row for each extension of a client hello, its body as hex."""

    def eval(self, payload: bytes):
        for kind, body in hello_extensions(bytes(payload or b"")):
            yield kind, body.hex()
