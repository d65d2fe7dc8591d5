"""Fill-in-the-middle: texts cut in three parts at token bounds, by content-defined chunks that are counted once.

Tokens are runs of letters A-Z and a-z, and every other code point by itself. A rolling hash of the last WINDOW bytes cuts
texts into chunks wherever its low bits are zero, so that passages which texts share fall into the same chunks. A task keeps
what it knows of a chunk under the chunk's own bytes (a lookup compares all of them): its tokens, its code points, and
whether it begins and ends with a letter. Counts of neighbouring chunks add up, less one where a run of letters goes on
across the bound. Running sums of them lead to the chunk that holds a cut; only that chunk is looked into.

Form and cuts depend on the id and the seed alone. Both output forms can be taken apart again: see `restored`.

Defined results: a null text is an empty one, and plain; rows without an id hash an empty number; repeated rows give equal
rows; an empty table gives none; other columns are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mix64, steps

#: What stands before the prefix, the suffix and the middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Bytes that the rolling hash sees, bits of it that are zero at a cut (chunks of about 2^CUT_BITS bytes), longest chunk.
WINDOW, CUT_BITS, LONGEST = 16, 9, 8192
#: Bytes of chunks that a task remembers before it starts anew.
CACHE_BYTES = 48 << 20
#: Of 100 documents so many are cut, and of 100 cut ones so many have the suffix first.
CUT_SHARE, SUFFIX_FIRST = 90, 20

_GEAR = mix64(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)
_LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 for b in range(256)])
_INSIDE = np.array([b & 0xC0 == 0x80 for b in range(256)])  # not the first byte of a code point
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def chunk_starts(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Where the chunks of the texts data[start : end] begin (the texts lie one after another).

    A bound depends on the text's own bytes only: those before it within the window, and, for long stretches without one, the distance to the last.
    """
    full = end > start
    start, end = start[full], end[full]
    if not len(start):
        return start
    h, width = _GEAR[data], 1
    while width < WINDOW:  # sums over 2, 4, 8, ... bytes, each from two of the former
        later = h.copy()
        later[width:] += h[:-width] << np.uint32(width)
        h, width = later, 2 * width
    at = np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1
    row = np.searchsorted(start, at, "right") - 1
    at = at[(row >= 0) & (at - start[row] >= WINDOW) & (at < end[row])]
    cuts = np.union1d(start, at)
    reach = np.append(cuts[1:], end[-1])
    reach = np.minimum(reach, end[np.searchsorted(start, cuts, "right") - 1])
    more = (reach - cuts - 1) // LONGEST
    k = np.repeat(np.arange(len(cuts)), more)
    if len(k):
        within = np.arange(len(k)) - np.repeat(np.cumsum(more) - more, more) + 1
        cuts = np.union1d(cuts, cuts[k] + within * LONGEST)
    for _ in range(3):  # a code point isn't parted
        cuts = np.where(_INSIDE[data[np.minimum(cuts, len(data) - 1)]] & (cuts < len(data)), cuts + 1, cuts)
    return np.unique(cuts[cuts < end[-1]])


class Chunks:
    """What is known of chunks, by their bytes: tokens, code points, whether the first and the last byte are letters."""

    def __init__(self):
        self.clear()
        self.asked = self.counted = 0

    def clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.known, self.bytes = np.zeros((1 << 10, 4), np.int64), 0

    def summaries(self, pieces: list[bytes]) -> np.ndarray:
        if self.bytes > CACHE_BYTES:
            self.clear()
        number, first = self.number, len(self.number)
        at = [number.setdefault(p, len(number)) for p in pieces]
        new = list(number)[first:] if len(number) > first else []
        self.asked, self.counted = self.asked + len(pieces), self.counted + len(new)
        if new:
            self.bytes += sum(map(len, new))
            if len(number) > len(self.known):
                self.known = np.concatenate([self.known, np.zeros((len(number), 4), np.int64)])
            self.known[first : len(number)] = _count(new)
        return self.known[at]


def _token_starts(letter: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Where tokens begin, if what is before the first byte isn't a letter."""
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    return begins | ~(letter | inside)


def _count(pieces: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b"".join(pieces), np.uint8)
    size = np.fromiter(map(len, pieces), np.int64, len(pieces))
    at = np.cumsum(size) - size
    letter, inside = _LETTER[data], _INSIDE[data]
    begins = _token_starts(letter, inside)
    begins[at] = ~inside[at]
    return np.stack([np.add.reduceat(begins, at, dtype=np.int64), np.add.reduceat(~inside, at, dtype=np.int64), letter[at], letter[at + size - 1]], axis=1)


def _draws(doc_id: int | None, seed: int) -> list[int]:
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[4 * k : 4 * k + 4], "big") for k in range(4)]


def _transform(batch: pa.RecordBatch, seed: int, chunks: Chunks) -> pa.RecordBatch:
    column = pc.fill_null(batch.column("text"), "").cast(pa.binary())
    rows = len(column)
    bound = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + rows + 1].astype(np.int64)
    held = column.buffers()[2]
    raw = held.slice(bound[0], bound[-1] - bound[0]).to_pybytes() if held is not None else b""
    bound = bound - bound[0]
    data = np.frombuffer(raw, np.uint8)
    at = chunk_starts(data, bound[:-1], bound[1:])
    stop = np.append(at[1:], len(raw))
    known = chunks.summaries([raw[a:b] for a, b in zip(at.tolist(), stop.tolist())])
    row = np.searchsorted(bound[1:], at, "right")
    goes_on = np.zeros(len(at), np.int64)
    goes_on[1:] = known[:-1, 3] & known[1:, 2] & (row[1:] == row[:-1])
    tokens, chars = np.cumsum(known[:, 0] - goes_on), np.cumsum(known[:, 1])
    n = np.bincount(row, known[:, 0] - goes_on, rows).astype(np.int64)
    before = np.cumsum(n) - n
    chars_before = np.append(0, chars)[np.searchsorted(at, bound[:-1], "left")]

    def cut(r: int, unit: int) -> tuple[int, int]:
        """(byte, code point of the text) where the text's token number `unit` begins."""
        if unit >= n[r]:
            return int(bound[r + 1]), -1
        k = int(np.searchsorted(tokens, before[r] + unit, "right"))
        local = before[r] + unit - (tokens[k - 1] if k else 0) + goes_on[k]
        piece = data[at[k] : stop[k]]
        inside = _INSIDE[piece]
        begins = _token_starts(_LETTER[piece], inside)
        place = int(np.flatnonzero(begins)[local])
        return int(at[k]) + place, int((chars[k - 1] if k else 0) - chars_before[r] + np.count_nonzero(~inside[:place]))

    length = np.bincount(row, known[:, 1], rows).astype(np.int64)
    out, marks = [], [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    p, s, m = marks
    for r, doc_id in enumerate(batch.column("doc_id").to_pylist()):
        a, b = int(bound[r]), int(bound[r + 1])
        h1, h2, h3, h4 = _draws(doc_id, seed)
        if a == b or h3 % 100 >= CUT_SHARE or any(raw.find(x, a, b) >= 0 for x in marks):
            out.append((doc_id, int(n[r]), "plain", None, None, raw[a:b]))
            continue
        u, v = sorted((h1 % int(n[r] + 1), h2 % int(n[r] + 1)))
        (x, cx), (y, cy) = cut(r, u), cut(r, v)
        cx, cy = (int(length[r]) if c < 0 else c for c in (cx, cy))
        spm = h4 % 100 < SUFFIX_FIRST
        parts = (s, raw[y:b], p, raw[a:x], m, raw[x:y]) if spm else (p, raw[a:x], s, raw[y:b], m, raw[x:y])
        out.append((doc_id, int(n[r]), "spm" if spm else "psm", cx, cy - cx, b"".join(parts)))
    cols = list(zip(*out))
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    arrays = [pa.array(c, t) for c, t in zip(cols, types)] + [pa.array(cols[5], pa.binary()).cast(pa.string())]
    return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in SCHEMA.split(", ")])


def transform(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars (null if plain), output of each row of (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunks = Chunks()
        for whole in batches:
            for batch in steps(whole, "text"):
                yield _transform(batch, seed, chunks)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of `transform` was made of: parts end where the next mark first stands, as no part holds one."""
    size = len(PREFIX)
    rest = lambda c, n: F.substr(c, n)
    body = rest(output, F.lit(size + 1))
    second = F.when(form == "psm", F.lit(SUFFIX)).otherwise(F.lit(PREFIX))
    first = F.when(form == "psm", F.substring_index(body, SUFFIX, 1)).otherwise(F.substring_index(body, PREFIX, 1))
    body = rest(body, F.char_length(first) + F.char_length(second) + 1)
    then = F.substring_index(body, MIDDLE, 1)
    last = rest(body, F.char_length(then) + size + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(first, last, then)).otherwise(F.concat(then, last, first))
