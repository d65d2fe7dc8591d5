"""Language-model scores by Katz backoff, over bigrams or longer n-grams (`order`).

Counts are discounted after Good and Turing: a count r up to LARGEST is multiplied by
d_r = (r*/r - a) / (1 - a), where r* = (r + 1) n_{r+1} / n_r and a = (LARGEST + 1) n_{LARGEST+1} / n_1; larger
counts stand (see Discounts for uneven counts of counts). A token's probability is its discounted n-gram if that was seen, else the
context's backoff weight times the token's probability after the context without its first token, and so on down to unigrams; a context that was
never seen has weight 1. The weight makes each context sum to exactly one: what its discounted n-grams leave (one count, if none is small enough to
be discounted), over what the shorter n-grams of its unseen continuations have. Unigrams back off to one class of all unknown tokens. At a text's
start contexts are shorter: they begin with one mark of the start. Where counts of counts don't allow Good-Turing, half a count is taken off instead.

How it is computed. Texts stay where they are read; a chunk is a run of rows of one file. Each chunk
counts its own n-grams first, and sends them, once each, to partitioned tables (buckets by the context's hash); a bucket
adds up all chunks' counts and sends each chunk the totals of what it asked for, filed under the chunk in the shared folder, from where the task
that reads the chunk again takes them. So nothing of the vocabulary's size is broadcast or in one task, and a very
frequent token or context is one entry per chunk. Contexts with many continuations are split over several
buckets (in proportion to their share of all tokens); their few sums are added on the driver.

Each order is one such round: a chunk first reads what it was told of the shorter n-grams, since the sums of a context are over their probabilities.

Token ids are 64-bit hashes, and an n-gram is its context's hash and 48 bits of the token's.

Defined results: a null or empty text is the end token alone; rows that repeat an id are scored each;
a row without an id doesn't teach and its held_out is null; without any training row all scores are those of an empty model (0 each token); other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix64, shared_dir, steps

LARGEST = 5
#: Rows of a file, and tokens, that a chunk has at most.
CHUNK_ROWS, CHUNK_TOKENS = 4096, 2_500_000
#: Tokens of the corpus for which there is one bucket more.
BUCKET_TOKENS = 1_000_000
#: White space can't be in a word, so these bytes name what isn't one: the end, the context of the first token, all unknown tokens.
END, START, UNKNOWN = b"\n", b"\t", b"\x0b"

_ASKED = "bucket int, chunk long, ids binary, counts binary, groups binary, runs binary, salts binary, seen binary"
_TOLD = "chunk long, bucket int, counts binary, totals binary, hist binary, sums binary"


def _pack(x: np.ndarray, kind: str) -> bytes:
    """The array with its first bytes first, then its second bytes, and so on, compressed; before them the bytes' number."""
    x = np.ascontiguousarray(x, kind)
    data = x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, "zstd", asbytes=True) if data else b"")


def _pack_counts(x: np.ndarray) -> bytes:
    """Counts in 32 bits each, or in 64 if one needs them; the first byte tells which."""
    x = np.asarray(x).astype(np.int64, copy=False)
    kind = "<u8" if x.max(initial=0) >> 32 else "<u4"
    return bytes([int(kind[-1])]) + _pack(x, kind)


def _unpack_counts(b: bytes) -> np.ndarray:
    return _unpack(b[1:], f"<u{b[0]}").astype(np.int64, copy=False) if b[0] == 8 else _unpack(b[1:], "<u4")


def _unpack(b: bytes, kind: str) -> np.ndarray:
    size, width = int.from_bytes(b[:8], "little"), np.dtype(kind).itemsize
    data = pa.decompress(b[8:], size, "zstd", asbytes=True) if size else b""
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        value = self[word] = len(self)
        return value


class Grams(NamedTuple):
    """The distinct n-grams of a chunk that have a known context, by number."""

    context: np.ndarray  # the number of each one's context (a word, or an n-gram one shorter)
    token: np.ndarray
    count: np.ndarray  # in the chunk's training texts
    of: np.ndarray  # the n-gram of each token of the chunk (-1: none)
    below: np.ndarray  # the number of the n-gram without its first token
    names: np.ndarray  # the hash of each context, by the context's number
    known: np.ndarray  # the corpus count of each context, by the context's number


class Chunk:
    """The tokens of a run of rows; two passes over the same rows give the same chunk."""

    def __init__(self, name: tuple):
        self.id = xxhash.xxh3_64_intdigest(repr(name).encode()) >> 1
        self.number = _Numbers()
        self.end, self.start, self.unknown = (self.number[w] for w in (END, START, UNKNOWN))
        self.doc_ids, self.tokens, self.sizes, self.n = [], [], [], 0

    def add(self, doc_id, text: str | None) -> None:
        found = (text or "").encode("utf-8", "replace").lower().split()
        self.tokens.append(np.fromiter(map(self.number.__getitem__, found), np.int32, len(found)))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(found) + 1)
        self.n += len(found) + 1

    def close(self, mod: int, rest: int) -> Chunk:
        end = np.array([self.end], np.int32)
        self.at = np.concatenate([x for t in self.tokens for x in (t, end)])
        self.tokens = []
        self.size = np.array(self.sizes)
        self.first = np.cumsum(self.size) - self.size
        self.before = np.empty_like(self.at)
        self.before[1:] = self.at[:-1]
        self.before[self.first] = self.start
        self.rest = [None if d is None else zlib.crc32(str(d).encode()) % mod for d in self.doc_ids]
        self.learns = np.repeat([r is not None and r != rest for r in self.rest], self.size)
        self.hash = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in self.number), np.uint64, len(self.number))
        self.width = len(self.number)
        self.number.clear()  # from here on words are numbers
        return self

    def pairs(self, known: np.ndarray) -> Grams:
        """The bigrams. known: the corpus count of each word.

        Unknown tokens are one token, which tells the context's backoff weight.
        """
        width = self.width
        ok = (known[self.before] > 0) | (self.before == self.start)
        code = self.before[ok].astype(np.int64) * width + np.where(known[self.at] > 0, self.at, self.unknown)[ok]
        distinct, inverse = np.unique(code, return_inverse=True)
        del code
        of = np.full(len(self.at), -1, np.int32)
        of[ok] = inverse
        count = np.bincount(inverse, self.learns[ok], len(distinct)).astype(np.int32)
        del inverse
        share = known.copy()
        share[self.start] = known[self.end]
        token = (distinct % width).astype(np.int32)
        return Grams((distinct // width).astype(np.int32), token, count, of, token, self.hash, share)

    def longer(self, known: np.ndarray, grams: Grams, total: np.ndarray) -> Grams:
        """The n-grams one longer, whose contexts are the given ones that the corpus has (total: its count of each)."""
        context = np.append(np.int32(-1), grams.of[:-1])
        context[self.first] = -1
        ok = (context >= 0) & (total[context] > 0) if len(total) else np.zeros(len(context), bool)
        code = context[ok].astype(np.int64) * self.width + np.where(known[self.at] > 0, self.at, self.unknown)[ok]
        distinct, first, inverse = np.unique(code, return_index=True, return_inverse=True)
        of = np.full(len(self.at), -1, np.int32)
        of[ok] = inverse
        count = np.bincount(inverse, self.learns[ok], len(distinct)).astype(np.int32)
        with np.errstate(over="ignore"):
            names = mix64(grams.names[grams.context] * np.uint64(0xD6E8FEB86659FD93) + self.hash[grams.token])
        return Grams((distinct // self.width).astype(np.int32), (distinct % self.width).astype(np.int32), count, of, grams.of[ok][first], names, total)

    def sent(self, grams: Grams, buckets: int, total: int):
        """(bucket, context's hash, 48 bits of the token, salts, number) of the n-grams in the order in which they are sent."""
        salts = np.maximum(1, np.ceil(2.0 * buckets * grams.known[grams.context] / max(1, total))).astype(np.int32)
        ids = mix64(self.hash[grams.token]) >> np.uint64(16)
        with np.errstate(over="ignore"):
            group = mix64(grams.names[grams.context] + np.uint64(0x9E3779B97F4A7C15))
        bucket = ((group + ids % salts.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)
        order = np.lexsort((ids, group, bucket)).astype(np.int32)
        return bucket[order], group[order], ids[order], salts[order], order


def _located(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, text, file, block, row) of rows that are read from files; all others are written to the shared folder first.

    Places in files are only trusted if the rows are a plain scan: above a shuffle, a join or an explode Spark still resolves them, but
    rows then come in another order, or several times.
    """
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")]
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.row_index").alias("row")]
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or not docs.inputFiles():
        docs = materialise(docs.select(*columns), f"{path}/documents")
    return docs.select(*columns, *where)


def _chunks(batches: Iterator[pa.RecordBatch], mod: int, rest: int) -> Iterator[Chunk]:
    chunk, name = None, None
    for batch in (part for whole in batches for part in steps(whole, "text")):
        for doc_id, text, *at in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "file", "block", "row"))):
            new = (at[0], at[1], at[2] // CHUNK_ROWS)
            if name is None or new != name[:3] or chunk.n > CHUNK_TOKENS:
                if chunk:
                    yield chunk.close(mod, rest)
                name = (*new, name[3] + 1 if name and new == name[:3] else 0)
                chunk = Chunk(name)
            chunk.add(doc_id, text)
    if chunk:
        yield chunk.close(mod, rest)


def _cuts(bucket: np.ndarray) -> Iterator[tuple[int, slice]]:
    edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else []
    for a, b in zip(edges, [*edges[1:], len(bucket)]):
        yield int(bucket[a]), slice(a, b)


class Discounts:
    """Good-Turing ratios from counts of counts (n_1 to n_{LARGEST+1}).

    Where copies in the corpus make the counts of counts uneven, so that a ratio isn't between 0 and 1, the ratios come from
    their log-linear fit (simple Good-Turing); where that has no such ratios either, half a count is taken off.
    """

    def __init__(self, counts: np.ndarray):
        n, k, r = np.asarray(counts, float), LARGEST, np.arange(1, LARGEST + 2)
        self.ratio = 1 - 0.5 / r[:k]
        some = n > 0
        fitted = np.exp(np.polyval(np.polyfit(np.log(r[some]), np.log(n[some]), 1), np.log(r))) if some.sum() > 1 else n
        for m in (n, fitted):
            if (m > 0).all() and (a := (k + 1) * m[k] / m[0]) < 1:
                found = (r[1:] * m[1:] / m[:k] / r[:k] - a) / (1 - a)
                if ((found > 0) & (found < 1)).all():
                    self.ratio = found
                    break

    def __call__(self, count: np.ndarray) -> np.ndarray:
        """The discounted counts."""
        return np.where(count <= LARGEST, np.append(0.0, self.ratio)[np.minimum(count, LARGEST)], 1.0) * count

    def mass(self, total: np.ndarray, hist: np.ndarray) -> np.ndarray:
        """The sum of discounted counts, from the sum of counts and the numbers of types with count 1 to LARGEST."""
        r = np.arange(1, LARGEST + 1)
        return total - hist @ (r * (1 - self.ratio))


class Unigrams:
    def __init__(self, hist: np.ndarray, total: int, types: int):
        self.total, self.types, self.discounts = int(total), int(types), Discounts(hist)
        seen = self.discounts.mass(np.array([float(total)]), np.asarray(hist, float)[None, :LARGEST])[0]
        self.unknown = 1.0 - seen / max(1, total)

    def probability(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.discounts(count) / max(1, self.total), self.unknown)


def _merge_words(rows: pa.Table) -> pa.Table:
    """Adds up the chunks' word counts of a bucket; each chunk gets the totals, and one row (chunk -1) the counts of counts."""
    ids = [_unpack(b, "<u8") for b in rows["ids"].to_pylist()]
    counts = [_unpack_counts(b) for b in rows["counts"].to_pylist()]
    distinct, inverse = np.unique(np.concatenate(ids), return_inverse=True)
    total = np.bincount(inverse, np.concatenate(counts), len(distinct)).astype(np.int64)
    told, at = [], 0
    for x in ids:
        told.append(_pack_counts(total[inverse[at : at + len(x)]]))
        at += len(x)
    hist = np.append(np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2], [total.sum(), (total > 0).sum()])
    n = len(told)
    return pa.table(
        {
            "chunk": pa.array([*rows["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([rows["bucket"][0].as_py()] * (n + 1), pa.int32()),
            "counts": pa.array([*told, b""], pa.binary()), "totals": pa.array([b""] * (n + 1), pa.binary()),
            "hist": pa.array([b""] * n + [hist.astype("<i8").tobytes()], pa.binary()), "sums": pa.array([b""] * (n + 1), pa.binary()),
        }
    )


def _merge_grams(unigrams: Unigrams, shortest: bool):
    """Adds up the chunks' n-gram counts of a bucket; each chunk also gets the sums of the contexts that it asked for.

    Sums of a context: its count, how many of its n-grams occur 1 to LARGEST times, and its seen tokens' probabilities one order below
    (`shortest`: for bigrams chunks send the token's count, which takes less room than the probability).
    One row (chunk -1) has the counts of counts and the sums of contexts that are split over buckets.
    """

    def run(rows: pa.Table) -> pa.Table:
        groups = [_unpack(b, "<u8") for b in rows["groups"].to_pylist()]
        runs = [_unpack(b, "<u4") for b in rows["runs"].to_pylist()]
        group = np.concatenate([np.repeat(g, r) for g, r in zip(groups, runs)])
        ids = np.concatenate([_unpack(b, "<u8") for b in rows["ids"].to_pylist()])
        count = np.concatenate([_unpack_counts(b) for b in rows["counts"].to_pylist()])
        seen = np.concatenate([_unpack_counts(b) if shortest else _unpack(b, "<f8") for b in rows["seen"].to_pylist()])
        with np.errstate(over="ignore"):
            _, first, inverse = np.unique(mix64(group * np.uint64(0x9E3779B97F4A7C15) + ids), return_index=True, return_inverse=True)
        total = np.bincount(inverse, count, len(first)).astype(np.int64)
        contexts, of = np.unique(group[first], return_inverse=True)
        m = len(contexts)
        tallies = np.stack([np.bincount(of, total, m)] + [np.bincount(of, total == r, m) for r in range(1, LARGEST + 1)], 1)
        lower = unigrams.probability(seen[first].astype(np.int64)) if shortest else seen[first]
        sums = np.bincount(of, np.where(total > 0, lower, 0.0), m)
        told, totals, hists, held, at = [], [], [], [], 0
        for g, r in zip(groups, runs):
            size = int(r.sum())
            told.append(_pack_counts(total[inverse[at : at + size]]))
            at += size
            where = np.searchsorted(contexts, g)
            totals.append(_pack_counts(tallies[where, 0]))
            hists.append(_pack_counts(tallies[where, 1:].ravel()))
            held.append(_pack(sums[where], "<f8"))
        salts = np.concatenate([_unpack(b, "<u4") for b in rows["salts"].to_pylist()])
        split = np.unique(np.concatenate(groups)[salts > 1])
        where = np.searchsorted(contexts, split)
        hist = np.bincount(np.minimum(total, LARGEST + 2), minlength=LARGEST + 3)[1 : LARGEST + 2]
        told.append(split.astype("<u8").tobytes())
        totals.append(tallies[where].astype("<i8").tobytes())
        hists.append(hist.astype("<i8").tobytes())
        held.append(sums[where].astype("<f8").tobytes())
        return pa.table(
            {
                "chunk": pa.array([*rows["chunk"].to_pylist(), -1], pa.int64()), "bucket": pa.array([rows["bucket"][0].as_py()] * len(told), pa.int32()),
                "counts": pa.array(told, pa.binary()), "totals": pa.array(totals, pa.binary()), "hist": pa.array(hists, pa.binary()), "sums": pa.array(held, pa.binary()),
            }
        )

    return run


class Told:
    """What the buckets told a chunk, from its folder in the shared table."""

    def __init__(self, path: str, chunk: int):
        fs, root = pa.fs.FileSystem.from_uri(path)
        folder = f"{root}/chunk={chunk}"
        files = [f.path for f in fs.get_file_info(pa.fs.FileSelector(folder, allow_not_found=True)) if f.base_name.endswith(".parquet")]
        if not files:
            raise RuntimeError(f"no totals for chunk {chunk}: its rows were read in another order than before")
        self.table = pa.concat_tables(pq.ParquetFile(fs.open_input_file(f)).read() for f in files)
        self.place = {b: k for k, b in enumerate(self.table["bucket"].to_pylist())}

    def __call__(self, bucket: int, column: str) -> bytes:
        return self.table[column][self.place[bucket]].as_py()

    def words(self, chunk: Chunk, buckets: int) -> np.ndarray:
        """The corpus count of each word of the chunk, by its number; START has none."""
        known = np.zeros(chunk.width, np.int64)
        bucket, order = _word_buckets(chunk, buckets)
        for b, where in _cuts(bucket):
            known[order[where]] = _unpack_counts(self(b, "counts"))
        known[[chunk.start, chunk.unknown]] = 0
        return known


def _word_buckets(chunk: Chunk, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    bucket = (mix64(chunk.hash) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((chunk.hash, bucket))
    return bucket[order], order


def _ask_words(buckets: int, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, mod, rest):
            count = np.bincount(chunk.at, chunk.learns, chunk.width)
            bucket, order = _word_buckets(chunk, buckets)
            rows = [(b, chunk.id, _pack(chunk.hash[order[w]], "<u8"), _pack_counts(count[order[w]].astype(np.int64))) + (b"",) * 4 for b, w in _cuts(bucket)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), *[pa.binary()] * 6])], names=[c.split()[0] for c in _ASKED.split(", ")])

    return run


class Level:
    """One order above 1: the folder of its totals, its discounts, and the sums of the contexts that are split over buckets."""

    def __init__(self, path: str, buckets: int, rows: list):
        self.path, self.buckets, self.split = path, buckets, {}
        hist = np.zeros(LARGEST + 1, int)
        for r in rows:  # a row for each bucket; the split contexts are at most twice the buckets
            hist = hist + np.frombuffer(bytes(r.hist), "<i8")
            sums = np.concatenate([np.frombuffer(bytes(r.totals), "<i8").reshape(-1, LARGEST + 1).astype(float), np.frombuffer(bytes(r.sums), "<f8")[:, None]], axis=1)
            for g, x in zip(np.frombuffer(bytes(r.counts), "<u8").tolist(), sums):
                self.split[g] = self.split[g] + x if g in self.split else x
        self.discounts = Discounts(hist)

    def probability(self, chunk: Chunk, grams: Grams, lower: np.ndarray, tokens: int) -> tuple[np.ndarray, np.ndarray]:
        """(probability, corpus count) of each n-gram; lower: the probabilities one order below."""
        bucket, group, _, _, order = chunk.sent(grams, self.buckets, tokens)
        p, seen = np.empty(len(order)), np.empty(len(order), np.int64)
        told = Told(self.path, chunk.id) if len(order) else None
        for b, w in _cuts(bucket):
            count = _unpack_counts(told(b, "counts")).astype(np.int64)
            first = np.append(True, group[w][1:] != group[w][:-1])
            total = _unpack_counts(told(b, "totals")).astype(float)
            hist = _unpack_counts(told(b, "hist")).reshape(-1, LARGEST).astype(float)
            sums = _unpack(told(b, "sums"), "<f8").copy()
            for k, g in enumerate(group[w][first].tolist()):
                if g in self.split:
                    total[k], hist[k], sums[k] = self.split[g][0], self.split[g][1:-1], self.split[g][-1]
            mass = self.discounts.mass(total, hist)
            # A context all of whose n-grams are too frequent to be discounted keeps one count for the others.
            scale = np.where(mass > total - 1e-9, total / (total + 1.0), 1.0)
            left, room = 1.0 - scale * mass / np.maximum(total, 1), 1.0 - sums
            # A context that was never one backs off with weight 1; one whose seen tokens are all there is keeps all its mass.
            full = (room <= 1e-12) & (total > 0)
            weight = np.where(total == 0, 1.0, np.where(full, 0.0, left / np.maximum(room, 1e-300)))
            scale = np.where(full, total / np.maximum(mass, 1e-300), scale)
            at = np.cumsum(first) - 1
            p[order[w]] = np.where(count > 0, self.discounts(count) * scale[at] / np.maximum(total[at], 1), weight[at] * lower[order[w]])
            seen[order[w]] = count
        return p, seen


class Model:
    """What is known of the corpus: its words' totals and, from bigrams on, its levels."""

    def __init__(self, words: str, word_buckets: int, unigrams: Unigrams):
        self.words, self.word_buckets, self.unigrams, self.levels = words, word_buckets, unigrams, []

    def climb(self, chunk: Chunk, beyond: bool):
        """(corpus count of each word, probability of each token, and, if `beyond`, the next order's n-grams with their probabilities one order below)."""
        known = Told(self.words, chunk.id).words(chunk, self.word_buckets)
        single = self.unigrams.probability(known)
        found, grams, lower = single[chunk.at], None, None
        for level in [*self.levels, *[None] * beyond]:
            if grams is None:
                grams = chunk.pairs(known)
                lower = single[grams.token]
            else:
                grams = chunk.longer(known, grams, seen)  # noqa: F821
                lower = p[grams.below]  # noqa: F821
            if level:
                p, seen = level.probability(chunk, grams, lower, self.unigrams.total)
                # Where the context is unknown, the shorter n-gram stands.
                some = grams.of >= 0
                found[some] = p[grams.of[some]]
        return known, found, grams, lower


def _ask_grams(model: Model, buckets: int, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in _chunks(batches, mod, rest):
            known, _, grams, lower = model.climb(chunk, beyond=True)
            bucket, group, ids, salts, order = chunk.sent(grams, buckets, model.unigrams.total)
            rows = []
            for b, w in _cuts(bucket):
                first = np.flatnonzero(np.append(True, group[w][1:] != group[w][:-1]))
                runs = np.diff(np.append(first, w.stop - w.start))
                below = _pack(lower[order[w]], "<f8") if model.levels else _pack_counts(known[grams.token[order[w]]])
                rows.append(
                    (b, chunk.id, _pack(ids[w], "<u8"), _pack_counts(grams.count[order[w]]), _pack(group[w][first], "<u8"), _pack(runs, "<u4"), _pack(salts[w][first], "<u4"), below)
                )
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int64(), *[pa.binary()] * 6])], names=[c.split()[0] for c in _ASKED.split(", ")])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model, mod: int, rest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, v = model.unigrams.total, model.unigrams.types
        for chunk in _chunks(batches, mod, rest):
            known, found, _, _ = model.climb(chunk, beyond=False)
            if n:
                log = np.log10(np.maximum(found, 1e-300))
                base = np.log10((known[chunk.at] + 0.5) / (n + 0.5 * (v + 1)))
            else:
                log = base = np.zeros(len(chunk.at))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(chunk.doc_ids, pa.int64()),
                    pa.array([None if r is None else r == rest for r in chunk.rest], pa.bool_()),
                    pa.array(chunk.size, pa.int64()),
                    pa.array(np.add.reduceat(known[chunk.at] > 0, chunk.first, dtype=np.int64)),
                    pa.array(np.full(len(chunk.size), n, np.int64)),
                    pa.array(np.add.reduceat(base, chunk.first)),
                    pa.array(np.add.reduceat(log, chunk.first)),
                ],
                names=[c.split()[0] for c in _SCORED.split(", ")],
            )

    return run


def score(docs: DataFrame, mod: int = 5, rest: int = 1, work: str | None = None, order: int = 2) -> DataFrame:
    """Scores every row of (doc_id, text); rows with crc32(doc_id) % mod = rest don't teach. order: words of the longest n-grams.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score (log10 of the text's probability).
    """
    path = work or shared_dir(docs.sparkSession)
    located = _located(docs, path)
    word_buckets = max(32, located.rdd.getNumPartitions())
    _table(located.mapInArrow(_ask_words(word_buckets, mod, rest), _ASKED), _merge_words, f"{path}/words")
    told = _stats(docs, f"{path}/words")
    hist = np.sum([np.frombuffer(bytes(r.hist), "<i8") for r in told] or [np.zeros(LARGEST + 3, int)], axis=0)
    model = Model(f"{path}/words", word_buckets, Unigrams(hist[: LARGEST + 1], hist[-2], hist[-1]))
    for n in range(2, order + 1):
        folder, buckets = f"{path}/grams{n}", max(32, (n - 1) * int(model.unigrams.total // BUCKET_TOKENS))
        asked = located.mapInArrow(_ask_grams(model, buckets, mod, rest), _ASKED)
        _table(asked, _merge_grams(model.unigrams, shortest=n == 2), folder)
        model.levels.append(Level(folder, buckets, _stats(docs, folder)))
    return located.mapInArrow(_score(model, mod, rest), _SCORED)


def _table(asked: DataFrame, merge, path: str) -> None:
    """Adds up by bucket and files the answers by chunk."""
    told = asked.groupBy("bucket").applyInArrow(merge, _TOLD)
    told.repartition("chunk").write.mode("overwrite").partitionBy("chunk").parquet(path)


def _stats(docs: DataFrame, path: str) -> list:
    """The buckets' own rows, read from their folder alone: the chunks' folders aren't listed."""
    try:
        return docs.sparkSession.read.schema(_TOLD.replace("chunk long, ", "")).parquet(f"{path}/chunk=-1").select("counts", "totals", "hist", "sums").collect()
    except AnalysisException:  # no rows, no folder
        return []
