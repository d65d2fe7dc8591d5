"""Near-duplicate detection with ProbMinHash signatures.

A document is a weighted set of five-word shingles: a shingle weighs as often as it occurs. Each shingle starts a Poisson process
whose rate is its weight; every arrival falls on one register, which keeps the
shingle that arrives first. A document stops as soon as no further arrival can
beat its latest register. Two registers agree with the probability Jaccard
similarity of the two weighted sets:

    sum over shared shingles i of 1 / sum over all shingles j of max(a_j / a_i, b_j / b_i)

It doesn't change if a text is repeated as a whole, and is the plain Jaccard similarity where no shingle repeats. Texts are linked if it is THRESHOLD or more.

Signatures are cut into bands; documents that share a band are candidates, and
candidates are verified exactly, by this very measure of their shingles.

Defined results: rows without an id take no part; a text without words (null,
empty, only punctuation) is a class of its own; a text of one to four words is one
shingle; rows that repeat an id are one document; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, hash_words, lean, materialise, mix64, shared_dir, steps, words

SHINGLE = 5
THRESHOLD = 0.8
BANDS = 25
ROWS = 5
#: Registers of a signature; the first BANDS * ROWS of them are the bands, all of them estimate the similarity.
REGISTERS = 240
#: Share of equal registers below which a candidate isn't verified: 0.8 less 3.1 standard deviations.
LEAST_EQUAL = 0.72
#: Members of a block of a bucket, and bytes of their shingles; two blocks meet in one task.
BLOCK, BLOCK_BYTES = 512, 16 << 20


def shingles(items: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of SHINGLE words (one shingle if there are fewer words)."""
    n = len(items) - SHINGLE + 1
    with np.errstate(over="ignore"):
        if n < 1:
            x = np.uint64(len(items))
            for h in items:
                x = x * np.uint64(0x9E3779B97F4A7C15) + h
            return mix64(np.array([x], np.uint64)) if len(items) else np.empty(0, np.uint64)
        x = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            x = x * np.uint64(0x9E3779B97F4A7C15) + items[k : k + n]
    return mix64(x)


def signatures(sets: list[np.ndarray], registers: int = REGISTERS) -> np.ndarray:
    """ProbMinHash of each array of shingle hashes, in which a shingle weighs as often as it occurs: one row of register values (0: no shingle)."""
    count = len(sets)
    first = np.full(count * registers, np.inf)
    found = np.zeros(count * registers, np.uint64)
    size = np.array([len(s) for s in sets], np.int64)
    if not size.sum():
        return found.reshape(count, registers)
    # 24 bits of the row and 40 of the shingle: one sort groups the repeats of each row.
    key = (np.repeat(np.arange(count, dtype=np.uint64), size) << np.uint64(40)) | (np.concatenate(sets) >> np.uint64(24))
    key.sort()
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    repeats = np.diff(np.append(new, len(key)))
    key = key[new]
    doc = (key >> np.uint64(40)).astype(np.int64)
    element = (key & np.uint64((1 << 40) - 1)) + np.uint64(1)
    rate = repeats.astype(np.float64)
    state, t = mix64(element), np.zeros(len(key))
    while len(doc):
        with np.errstate(over="ignore"):
            state = state + np.uint64(0x9E3779B97F4A7C15)
        u = mix64(state)
        t = t - np.log(((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / rate
        at = doc * registers + (mix64(u) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(first, at, t)
        won = t == first[at]
        found[at[won]] = element[won]
        # Early termination: an arrival later than all registers of its row ends its process.
        rows = doc[np.concatenate(([True], doc[1:] != doc[:-1]))]
        latest = np.zeros(count)
        latest[rows] = first.reshape(count, registers)[rows].max(axis=1)
        go = t < latest[doc]
        doc, element, rate, state, t = doc[go], element[go], rate[go], state[go], t[go]
    return found.reshape(count, registers)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for whole in batches:
        for batch in steps(whole, "text"):
            texts = [words(t) for t in batch.column("text").to_pylist()]
            sets = [shingles(hash_words(w, cache)) for w in texts]
            values = signatures(sets)
            short = (mix64(values) >> np.uint64(32)).astype("<u4")
            bands = values[:, : BANDS * ROWS].reshape(len(sets), BANDS, ROWS)
            with np.errstate(over="ignore"):
                key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS)).copy()
                for k in range(ROWS):
                    key = mix64(key * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, k])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([xxhash.xxh3_128_digest(b" ".join(w)) if w else None for w in texts], pa.binary()),
                    pa.array([row.tobytes() for row in short], pa.binary()),
                    pa.array(list(key.view(np.int64)), pa.list_(pa.int64())),
                ],
                names=["doc_id", "digest", "sig", "bands"],
            )


def _equal(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps pairs whose signatures agree in LEAST_EQUAL of the registers."""
    for batch in pairs:
        if batch.num_rows:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(-1, REGISTERS) for c in ("sig_a", "sig_b"))
            keep = (a == b).mean(axis=1) >= LEAST_EQUAL
            yield batch.select(["a", "b"]).filter(pa.array(keep))


def weights(text: str | None, cache: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """(shingle hashes in order, how often each occurs) of a text."""
    return np.unique(shingles(hash_words(words(text), cache)), return_counts=True)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The probability Jaccard similarity of two weighted sets (0 if they share nothing)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    # Shingles with the same two weights are one term; most texts have very few such pairs of weights.
    pair, times = np.unique(np.stack([a[1][i], b[1][j]]), axis=1, return_counts=True)
    x, y = pair.astype(np.float64)
    alone_x, alone_y = a[1].sum() - times @ x, b[1].sum() - times @ y
    total = 0.0
    for k in range(0, len(x), 256):
        u, v = x[k : k + 256, None], y[k : k + 256, None]
        below = np.maximum(x / u, y / v) @ times + alone_x / u[:, 0] + alone_y / v[:, 0]
        total += float((times[k : k + 256] / below).sum())
    return total


def _verify(pairs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    last: tuple[object, tuple] = (None, ())
    for batch in pairs:
        for part in steps(batch, "text_b"):
            keep = []
            ids, ta, tb = (part.column(c) for c in ("a", "text_a", "text_b"))
            for i in range(part.num_rows):
                text = ta[i].as_py()
                if last[0] is None or text != last[0]:
                    last = (text, weights(text, cache))
                keep.append(probability_jaccard(last[1], weights(tb[i].as_py(), cache)) >= THRESHOLD - 1e-9)
            yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, packed shingles: hashes in order, then counts) of each text."""
    cache = WordHashes()
    for whole in batches:
        for batch in steps(whole, "text"):
            found = [weights(t, cache) for t in batch.column("text").to_pylist()]
            packed = [h.astype("<u8").tobytes() + n.astype("<u4").tobytes() for h, n in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def unpack(packed: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(packed) // 12
    return np.frombuffer(packed, "<u8", n), np.frombuffer(packed, "<u4", n, 8 * n).astype(np.int64)


def _blocks(rows: pa.Table) -> pa.Table:
    """Links of one block of a bucket (or of two blocks): enough of them to join all members that links between them join.

    Pairs that signatures call alike are verified here, the most alike first, unless links found before have joined their components already; so a large
    family of near copies gives at most a link for each member, however many of its pairs are just too different.
    A pair that meets in several buckets is only looked at in that of the first band it shares.
    """
    ids, comp, side = (np.asarray(rows.column(c).to_numpy()) for c in ("doc_id", "component", "block"))
    sig = np.frombuffer(b"".join(rows.column("sig").to_pylist()), "<u4").reshape(-1, REGISTERS)
    packed = rows.column("packed").to_pylist()
    at, to, band = (rows.column(c)[0].as_py() for c in ("i", "j", "band"))
    left, right = np.flatnonzero(side == at), np.flatnonzero(side == to)
    found = []
    for x in left:
        alike = right[comp[right] != comp[x]]
        if at == to:
            alike = alike[ids[alike] > ids[x]]
        equal = sig[alike] == sig[x]
        share = equal.mean(axis=1)
        take = (share >= LEAST_EQUAL) & (equal[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).all(axis=2).argmax(axis=1) == band)
        found.append(np.stack([np.full(take.sum(), x), alike[take], share[take]]) if take.any() else np.empty((3, 0)))
    x, y, share = np.concatenate(found, axis=1) if found else np.empty((3, 0))
    root: dict[int, int] = {}

    def find(c: int) -> int:
        while (up := root.get(c, c)) != c:
            root[c] = root.get(up, up)
            c = up
        return c

    out = []
    for k in np.argsort(-share, kind="stable").tolist():
        u, v = int(x[k]), int(y[k])
        a, b = find(int(comp[u])), find(int(comp[v]))
        if a != b and probability_jaccard(unpack(packed[u]), unpack(packed[v])) >= THRESHOLD - 1e-9:
            root[max(a, b)] = min(a, b)
            out.append((min(ids[u], ids[v]), max(ids[u], ids[v])))
    return pa.table({"a": pa.array([int(p[0]) for p in out], pa.int64()), "b": pa.array([int(p[1]) for p in out], pa.int64())})


def components(edges: DataFrame, path: str) -> DataFrame:
    """(node, component): the least id that each node of the edges (a, b) reaches; by large-star and small-star rounds.

    Each round is written to the shared folder; only the number of rows and a checksum come back to the driver.
    """
    at, before, k = edges.select("a", "b").where("a <> b").distinct(), None, 0
    while True:
        both = at.select(F.col("a").alias("u"), F.col("b").alias("v")).union(at.select("b", "a"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        at = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: every node hangs on the least of its smaller neighbours, and so do those neighbours
        low = at.groupBy("a").agg(F.min("b").alias("m"))
        at = at.join(low, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).union(low.select("a", "m"))
        at = materialise(at.where("a <> b").distinct(), f"{path}/star{k}")
        now = at.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before, k = tuple(now), k + 1
    return at.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "node").union(at.select("b", "b").distinct())


def near_duplicates(docs: DataFrame, work: str | None = None) -> DataFrame:
    """One row per id of (doc_id, text): doc_id long, class_id long (least id of the class), n_links long.

    n_links counts the verified links that the search has used to join the document's text to others (a class of n different texts has n - 1 or somewhat more of them in all);
    exact copies share a class without a link of their own.
    """
    path = work or shared_dir(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    signed = materialise(docs.mapInArrow(lean(_sign), "doc_id long, digest binary, sig binary, bands array<long>"), f"{path}/signed")
    members = signed.groupBy("doc_id", "digest").agg(F.count("*").alias("n")).drop("n")
    head = members.where("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    same = members.where("digest is not null").join(head, "digest").select("doc_id", "rep", "digest")
    reps = materialise(
        signed.where("digest is not null").join(head, "digest").where("doc_id = rep")
        .groupBy("digest").agg(F.first("rep").alias("doc_id"), F.first("sig").alias("sig"), F.first("bands").alias("bands")),
        f"{path}/reps",
    )
    band = reps.select("doc_id", F.posexplode("bands").alias("band", "key"))
    bucket = band.groupBy("key").agg(F.min("doc_id").alias("center"), F.count("*").alias("size")).where("size > 1")
    inside = materialise(band.join(bucket, "key"), f"{path}/inside")
    sig = reps.select("doc_id", "sig")
    stars = inside.where("doc_id <> center").select(F.col("center").alias("a"), F.col("doc_id").alias("b")).distinct()
    edges = _checked(_signed_pairs(stars, sig), docs, f"{path}/edges")
    comp = materialise(components(edges, f"{path}/first"), f"{path}/component1")

    # Buckets that still hold more than one component: compare their members block by block, in blocks of few members and few bytes.
    held = inside.join(comp, inside.doc_id == comp.node, "left").select("key", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
    size = F.octet_length("packed")
    mixed = held.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size")).where("lo <> hi and size > 2").select("key")
    again = materialise(held.join(mixed, "key"), f"{path}/again")
    texts = docs.join(again.select("doc_id").distinct(), "doc_id", "left_semi")
    packed = materialise(texts.mapInArrow(lean(_pack), "doc_id long, packed binary"), f"{path}/packed")
    weight = again.join(packed.select("doc_id", size.alias("bytes")), "doc_id").groupBy("key").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("bytes") / BLOCK_BYTES)).cast("int").alias("nb"))
    rest = (
        again.join(weight, "key").join(sig, "doc_id").join(packed, "doc_id")
        .withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .select("key", "band", "doc_id", "component", "sig", "packed", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )
    late = materialise(rest.groupBy("key", "i", "j").applyInArrow(_blocks, "a long, b long").distinct(), f"{path}/late")
    links = edges.union(late)
    comp = materialise(components(edges.union(late), f"{path}/second"), f"{path}/component2") if late.limit(1).count() else comp

    ends = links.select(F.col("a").alias("rep")).union(links.select("b")).groupBy("rep").agg(F.count("*").alias("n_links"))
    classes = same.join(comp, same.rep == comp.node, "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("class"))
    classes = classes.join(ends, "rep", "left").select("doc_id", "class", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    # An id whose rows hold several texts joins their classes.
    out = members.select("doc_id").distinct().join(classes, "doc_id", "left")
    return out.groupBy("doc_id").agg(
        F.coalesce(F.min("class"), F.first("doc_id")).alias("class_id"), F.coalesce(F.sum("n_links"), F.lit(0)).alias("n_links")
    )


def _signed_pairs(pairs: DataFrame, sig: DataFrame) -> DataFrame:
    joined = pairs.join(sig.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b").join(
        sig.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a"
    )
    return joined.mapInArrow(lean(_equal), "a long, b long")


def _checked(pairs: DataFrame, docs: DataFrame, path: str) -> DataFrame:
    """The pairs whose texts reach THRESHOLD, written to the shared folder."""
    texts = (
        pairs.join(docs.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
        .join(docs.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    )
    return materialise(texts.mapInArrow(lean(_verify), "a long, b long").distinct(), path)


def similarity(a: str | None, b: str | None) -> float:
    """Probability Jaccard similarity of the two texts' shingles (0 if either has none)."""
    cache = WordHashes()
    return probability_jaccard(weights(a, cache), weights(b, cache))
