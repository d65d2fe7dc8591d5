"""SentencePiece encoding and decoding as a weighted finite-state transducer.

A model file is compiled into three machines:

- the normaliser: rewriting arcs of the model's character map (the longest one counts, other characters
  stay), then blanks: squeezed if the model says so, one added in front, all written as U+2581;
- the pieces: a trie of arcs (state, character) -> state, whose final states emit a piece's id at the weight -score;
  a character that no piece of its own covers also has an arc that emits its bytes (or the unknown piece), dearer than any piece;
- for BPE models, the pair acceptor. Their scores are merge ranks, whose sums don't name the library's result,
  but a sequence of pieces is what merging yields exactly if every two neighbours may stand side by side: undoing
  their merges from the latest back, no joint across their border was ever due first. That leaves one path.

Composing the machines with a text gives a lattice of arcs between its places; its shortest path in the tropical semiring
(minimum, +) is the encoding. All distinct parts of a batch are composed at once, as arrays: arcs by walking the trie from all
places together, distances place by place from the left. No piece goes on after a blank, so a lattice has
a single state at each blank that follows another character; the parts between are remembered.

Defined results: a null or empty text has no ids and decodes to an empty text; U+2581 in a text is a blank;
invalid byte sequences among ids decode to U+FFFD; without bytes in the model, a run of uncovered characters is one unknown piece;
repeated rows and ids get equal results; other columns are ignored. A part without a path (a broken vocabulary) is an error.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Sequences, gather, lean, steps

BLANK = "▁"
#: Bytes of text that are composed at once.
STEP = 4 << 20
#: Parts, and ids of parts, that a worker remembers; longer parts than CACHE_CHARS aren't found again.
CACHE_PARTS, CACHE_IDS, CACHE_CHARS = 500_000, 4_000_000, 48
#: Parts that are composed at once; they have some 25 arcs each.
COMPOSED = 1 << 14
#: Places of the table of judged pairs.
PAIR_SLOTS = 1 << 21
_NEVER = np.int64(1) << 40
_CHAR = 21  # bits of a code point
_MACHINES: dict[str, PieceTransducer] = {}
_AFTER_BLANK_RUN = re.compile(f"(?<=[^{BLANK}])(?={BLANK})")


class Table:
    """Sorted keys with values; `absent` for keys that aren't there."""

    def __init__(self, pairs: dict[int, int], absent: int):
        self.keys = np.array(sorted(pairs) or [-1], np.int64)
        self.values = np.array([pairs.get(int(k), absent) for k in self.keys], np.int64)
        self.absent = absent

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], self.absent)


class Normaliser:
    """Rewriting rules and the treatment of blanks."""

    def __init__(self, rules: dict[str, str], squeeze: bool):
        self.rules, self.squeeze = rules, squeeze
        self.longest = max(map(len, rules), default=0)
        self.starts = re.compile("[" + "".join(map(re.escape, sorted({r[0] for r in rules}))) + "]") if rules else None

    def rewrite(self, text: str) -> str:
        out, at = [], 0
        while found := self.starts.search(text, at):
            here = found.start()
            out.append(text[at:here])
            size = next((n for n in range(min(self.longest, len(text) - here), 0, -1) if text[here : here + n] in self.rules), 0)
            out.append(self.rules[text[here : here + size]] if size else text[here])
            at = here + max(1, size)
        return "".join([*out, text[at:]])

    def __call__(self, texts: pa.Array) -> pa.Array:
        """Rewritten texts, with blanks still as blanks."""
        texts = pc.fill_null(texts, "")
        if self.rules:
            texts = pa.array(map(self.rewrite, texts.to_numpy(zero_copy_only=False)), pa.string())
        texts = pc.replace_substring(texts, BLANK, " ")
        return pc.utf8_trim(pc.replace_substring_regex(texts, "  +", " "), " ") if self.squeeze else texts


def character_map(blob: bytes) -> dict[str, str]:
    """The rules of a model's precompiled map: a double-array trie of UTF-8 byte strings, then zero-ended results."""
    if not blob:
        return {}
    size = int.from_bytes(blob[:4], "little")
    unit, results = np.frombuffer(blob[4 : 4 + size], "<u4").astype(np.int64), blob[4 + size :]
    label = np.where(unit >> 31 & 1, -1, unit & 0xFF)
    below = np.arange(len(unit)) ^ ((unit >> 10) << ((unit & 512) >> 6))
    inner = np.flatnonzero(label > 0)
    children: dict[int, list[int]] = {}
    for at, base in zip(inner.tolist(), (inner ^ label[inner]).tolist()):
        children.setdefault(base, []).append(at)
    rules, open_nodes = {}, [(0, b"")]
    while open_nodes:
        at, key = open_nodes.pop()
        base = int(below[at])
        if unit[at] >> 8 & 1:
            start = int(unit[base] & 0x7FFFFFFF)
            rules[key.decode()] = results[start : results.index(b"\0", start)].decode()
        open_nodes += [(child, key + bytes([label[child]])) for child in children.get(base, []) if child != at]
    return rules


class PairAcceptor:
    """Which pieces BPE can leave side by side."""

    def __init__(self, ids: dict[str, int], cost: np.ndarray):
        self.ids, self.cost = ids, cost
        # Merges happen by ascending cost; equal costs are one time, at which the leftmost joint comes first.
        time = np.unique(cost, return_inverse=True)[1]
        self.left, self.right, self.time = (np.full(len(cost), -1, np.int64) for _ in range(3))
        joints: dict[int, int] = {}
        self.reached = np.zeros(len(cost), bool)
        for piece, k in ids.items():
            parts = self._last(piece)
            self.reached[k] = parts is not None
            if parts and len(parts) == 2:
                self.left[k], self.right[k], self.time[k] = ids[parts[0]], ids[parts[1]], time[k]
            for cut in range(1, len(piece)):
                a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
                if a is not None and b is not None:
                    joints[a << 32 | b] = int(time[k])
        self.joint = Table(joints, int(_NEVER))
        self.slots = np.full(PAIR_SLOTS, -1, np.int64)

    def _last(self, piece: str) -> list[str] | None:
        """The two pieces (or the one character) that the piece comes from; None if merging its text doesn't yield it."""
        at, ids, cost = list(piece), self.ids, self.cost
        while len(at) > 2 or (len(at) == 2 and piece not in ids):
            found = [ids.get(a + b) for a, b in zip(at, at[1:])]
            best = min((k for k, f in enumerate(found) if f is not None), key=lambda k: (cost[found[k]], k), default=None)
            if best is None:
                return None
            at[best : best + 2] = [at[best] + at[best + 1]]
        return at if all(a in ids for a in at) and (len(at) == 2 or at == [piece]) else None

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether each `right` may follow its `left`; pairs that were judged before are looked up."""
        key = left << 20 | right
        slot = (key * 0x9E3779B1 >> 7) & (PAIR_SLOTS - 1)
        held = self.slots[slot]
        ok = held & 1 == 1
        new = np.flatnonzero(held >> 1 != key)
        if len(new):
            ok[new] = self.judge(left[new], right[new])
            self.slots[slot[new]] = key[new] << 1 | ok[new]
        return ok

    def judge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        ok, due, rows = np.ones(len(left), bool), np.full(len(left), _NEVER), np.arange(len(left))
        while len(rows):
            early = self.joint(left << 32 | right) < due
            ok[rows[early]] = False
            a, b = self.time[left], self.time[right]
            go = ~early & (np.maximum(a, b) >= 0)
            rows, left, right, a, b = rows[go], left[go], right[go], a[go], b[go]
            later = a > b  # of equal times the right one is later: the leftmost joint comes first
            due = np.where(later, a, b + 1)
            left, right = np.where(later, self.right[left], left), np.where(later, right, self.left[right])
        return ok


class PieceTransducer:
    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        model.ParseFromString(open(path, "rb").read())
        spec, kinds = model.normalizer_spec, model.SentencePiece
        self.prefix = spec.add_dummy_prefix
        self.normaliser = Normaliser(character_map(spec.precompiled_charsmap), spec.remove_extra_whitespaces)
        text: list[bytes] = []
        self.bytes, self.ids, self.unknown = {}, {}, 0
        for k, piece in enumerate(model.pieces):
            raw = piece.piece.encode()
            if piece.type == kinds.BYTE:
                value = int(piece.piece[3:5], 16)
                self.bytes[value], raw = k, bytes([value])
            elif piece.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids[piece.piece] = k
            elif piece.type == kinds.UNKNOWN:
                self.unknown, raw = k, " ⁇ ".encode()
            else:
                raw = b""
            text.append(raw.replace(BLANK.encode(), b" "))
        self.cost = np.array([-p.score for p in model.pieces], float)
        self.size = np.array([len(t) for t in text], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(text), np.uint8)
        self.other_cost = float(max((self.cost[k] for k in self.ids.values()), default=0.0)) + 10.0
        self.acceptor = PairAcceptor(self.ids, self.cost) if model.trainer_spec.model_type == model.trainer_spec.BPE else None
        self._compile()
        self.cuts = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        self._forget()

    def _compile(self) -> None:
        """The trie's arcs, and what each state emits (-1: nothing)."""
        arcs, emits = {}, [-1]
        for piece, k in self.ids.items():
            if self.acceptor and not self.acceptor.reached[k]:
                continue
            state = 0
            for c in piece:
                key = state << _CHAR | ord(c)
                state = arcs.setdefault(key, len(emits))
                if state == len(emits):
                    emits.append(-1)
            emits[state] = k
        self.arcs, self.emits = Table(arcs, -1), np.array(emits, np.int64)

    def _forget(self) -> None:
        self.stored = Sequences()
        self.known: dict[bool, dict[str, int]] = {False: {}, True: {}}  # by whether a blank comes before

    def lattice(self, points: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(from, to, piece) of all arcs over the places of some parts; points: their characters, ends: where each character's part ends.

        The piece of an arc that emits a character's bytes is -1.
        """
        start = np.arange(len(points))
        place, state, found, single = start, np.zeros(len(points), np.int64), [], np.zeros(len(points), bool)
        while len(start):
            state = self.arcs(state << _CHAR | points[place])
            go = state >= 0
            start, place, state = start[go], place[go] + 1, state[go]
            piece = self.emits[state]
            hit = piece >= 0
            found.append((start[hit], place[hit], piece[hit]))
            single[start[hit & (place == start + 1)]] = True
            go = place < ends[start]
            start, place, state = start[go], place[go], state[go]
        rest = np.flatnonzero(~single)
        found.append((rest, rest + 1, np.full(len(rest), -1)))
        return tuple(np.concatenate(x) for x in zip(*found))

    def shortest(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids on the shortest paths of some normalised parts in a row, and how many each has."""
        if not parts:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = np.fromiter(map(len, parts), np.int64, len(parts))
        points = np.frombuffer("".join(parts).encode("utf-32-le"), "<u4").astype(np.int64)
        last_place = np.cumsum(size)
        first = last_place - size
        start, end, piece = self.lattice(points, np.repeat(last_place, size))
        # Places of different parts are apart, so that the end of one isn't the start of the next.
        owner = np.repeat(np.arange(len(parts)), size)
        shift = owner[start]
        start, end, first, last_place = start + shift, end + shift, first + np.arange(len(parts)), last_place + np.arange(len(parts))
        weight = np.where(piece >= 0, self.cost[piece], self.other_cost)
        depth = end - first[shift]
        order = np.argsort(depth.astype(np.int16) if size.max() < 1 << 15 else depth, kind="stable")
        cuts = np.searchsorted(depth[order], np.arange(1, size.max() + 2))
        distance, back = np.full(len(points) + len(parts), np.inf), np.full(len(points) + len(parts), -1, np.int64)
        before = np.full(len(points) + len(parts), -1, np.int64)  # the piece that ends at a place; -1: none, or bytes
        distance[first] = 0.0
        for a, b in zip(cuts, cuts[1:]):
            arc = order[a:b]
            arc = arc[distance[start[arc]] < np.inf]
            if self.acceptor:
                pair = np.flatnonzero((piece[arc] >= 0) & (before[start[arc]] >= 0))
                ok = np.ones(len(arc), bool)
                ok[pair] = self.acceptor(before[start[arc[pair]]], piece[arc[pair]])
                arc = arc[ok]
            total = distance[start[arc]] + weight[arc]
            if not self.acceptor:  # several arcs may end at a place (of equal paths the one with the longest last arc counts)
                best = np.lexsort((start[arc], np.round(total, 6), end[arc]))
                best = best[np.append(True, end[arc][best][1:] != end[arc][best][:-1])[: len(best)]]
                arc, total = arc[best], total[best]
            distance[end[arc]], back[end[arc]], before[end[arc]] = total, arc, piece[arc]
        # Back from all ends at once.
        steps_back, part, at = [], np.arange(len(parts)), last_place
        while len(part):
            arc = back[at]
            if (arc < 0).any():
                raise ValueError(f"no path for {parts[int(part[(arc < 0).argmax()])][:50]!r}")
            steps_back.append((part, arc))
            at = start[arc]
            go = at > first[part]
            part, at = part[go], at[go]
        part, arc = (np.concatenate(x) for x in zip(*reversed(steps_back)))
        order = np.argsort(part, kind="stable")
        return self._emitted(part[order], piece[arc[order]], points[start[arc[order]] - part[order]], len(parts))

    def _emitted(self, part: np.ndarray, piece: np.ndarray, points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of paths, arc by arc, and how many each of n parts has: pieces, and the bytes (or one unknown piece) of uncovered characters."""
        other = piece < 0
        if other.any() and not self.bytes:
            keep = ~(other & np.append(False, other[:-1] & (part[1:] == part[:-1])))
            part, piece = part[keep], np.where(other, self.unknown, piece)[keep]
        elif other.any():
            chars, which = np.unique(points[other], return_inverse=True)
            written = [[self.bytes[x] for x in chr(c).encode()] for c in chars.tolist()]
            size = np.ones(len(piece), np.int64)
            size[other] = np.array([len(w) for w in written])[which]
            spelt = np.repeat(other, size)
            part, piece = np.repeat(part, size), np.repeat(piece, size)
            piece[spelt] = np.array([b for k in which.tolist() for b in written[k]])
        return piece, np.bincount(part, minlength=n)

    def _numbers(self, parts: pa.Array, blank: bool) -> np.ndarray:
        """The number of each of the (distinct) parts' sequences; new ones are solved together and filed."""
        known, texts = self.known[blank], parts.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(known.get, texts))
        gaps = [k for k, n in enumerate(numbers) if n is None]
        for a in range(0, len(gaps), COMPOSED):
            some = gaps[a : a + COMPOSED]
            for k, n in zip(some, self.stored.add(*self.shortest([BLANK + texts[k] if blank else texts[k] for k in some]))):
                numbers[k] = n
                if len(texts[k]) <= CACHE_CHARS:
                    known[texts[k]] = n
        return np.array(numbers, np.int64)

    def _parts(self, text: str) -> list[str]:
        whole = ((BLANK if self.prefix else "") + text.replace(" ", BLANK)) if text else ""
        return _AFTER_BLANK_RUN.split(whole) if self.cuts else [whole]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has)."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.known[True]) + len(self.known[False]) > CACHE_PARTS or self.stored.used > CACHE_IDS:
            self._forget()
        texts = self.normaliser(texts)
        # Where blanks stand alone between words, every word with the blank before it is a part.
        odd = pc.match_substring_regex(texts, "^ |  | $|^$") if self.cuts and self.prefix else pa.array([True] * len(texts))
        split = pc.split_pattern(texts.filter(pc.invert(odd)), " ")
        coded = split.flatten().dictionary_encode()
        plain = self._numbers(coded.dictionary, True)[coded.indices.to_numpy()]
        listed = [[p for p in self._parts(t) if p] for t in texts.filter(odd).to_pylist()]
        others = pa.array([p for x in listed for p in x], pa.string()).dictionary_encode()
        numbers = np.concatenate([plain, self._numbers(others.dictionary, False)[others.indices.to_numpy()]])
        apart, count = odd.to_numpy(zero_copy_only=False), np.zeros(len(texts), np.int64)
        count[~apart], count[apart] = np.diff(split.offsets.to_numpy()), np.fromiter(map(len, listed), np.int64, len(listed))
        start = np.zeros(len(texts), np.int64)
        start[~apart] = np.cumsum(count[~apart]) - count[~apart]
        start[apart] = len(plain) + np.cumsum(count[apart]) - count[apart]
        ids, size = self.stored.joined(gather(numbers, start, count))
        ends = np.append(0, np.cumsum(size))
        last = np.cumsum(count)
        return ids, ends[last] - ends[last - count]

    def decode(self, ids: np.ndarray, size: np.ndarray) -> list[str]:
        """The texts of id sequences in a row."""
        raw = gather(self.raw, self.start[ids], self.size[ids]).tobytes()
        ends = np.append(0, np.cumsum(self.size[ids]))
        last = np.cumsum(size)
        whole = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[last - size].tolist(), ends[last].tolist())]
        return [w[1:] if self.prefix and w.startswith(" ") else w for w in whole]

    def comes_back(self, texts: pa.Array, ids: np.ndarray, size: np.ndarray) -> list[bool]:
        """Whether decoding gives each text (as the normaliser leaves it) back."""
        return [a == b for a, b in zip(self.decode(ids, size), self.normaliser(texts).to_numpy(zero_copy_only=False).tolist())]


def machine(path: str) -> PieceTransducer:
    """The compiled machine of a model file; a Python worker keeps it from task to task."""
    if path not in _MACHINES:
        _MACHINES[path] = PieceTransducer(path)
    return _MACHINES[path]


def _ragged(ids: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size)), pa.int32()), pa.array(ids.astype(np.int32)))


def _encoded(docs: DataFrame, model: str, schema: str, columns) -> DataFrame:
    """Encodes every row; columns(machine, batch, ids, sizes) gives the columns of the schema."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(model)
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                ids, size = fst.encode(batch.column("text"))
                yield pa.RecordBatch.from_arrays(columns(fst, batch, ids, size), names=[c.split()[0] for c in schema.split(", ")])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(lean(run), schema)


def encode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, token_ids array<int> of every row of (doc_id, text)."""
    return _encoded(docs, model, "doc_id long, token_ids array<int>", lambda fst, batch, ids, size: [batch.column("doc_id"), _ragged(ids, size)])


def encode_exact(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, token_ids array<int>, exact (decoding the ids gives the text back) of every row of (doc_id, text)."""
    columns = lambda fst, batch, ids, size: [batch.column("doc_id"), _ragged(ids, size), pa.array(fst.comes_back(batch.column("text"), ids, size), pa.bool_())]
    return _encoded(docs, model, "doc_id long, token_ids array<int>, exact boolean", columns)


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (of the ids as little-endian 32-bit integers), exact (decoding gives the text back)."""

    def columns(fst: PieceTransducer, batch: pa.RecordBatch, ids: np.ndarray, size: np.ndarray) -> list[pa.Array]:
        raw, last = memoryview(ids.astype("<u4").tobytes()), 4 * np.cumsum(size)
        crc = [zlib.crc32(raw[a:b]) for a, b in zip((last - 4 * size).tolist(), last.tolist())]
        return [batch.column("doc_id"), pa.array(size), pa.array(crc, pa.int64()), pa.array(fst.comes_back(batch.column("text"), ids, size), pa.bool_())]

    return _encoded(docs, model, "doc_id long, n_tokens long, ids_crc32 long, exact boolean", columns)


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of every row of (doc_id, token_ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = machine(model)
        for batch in batches:
            ids = pc.fill_null(batch.column("token_ids"), [])
            size = pc.list_value_length(ids).to_numpy(zero_copy_only=False).astype(np.int64)
            text = fst.decode(ids.flatten().to_numpy(zero_copy_only=False).astype(np.int64), size)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(text, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "token_ids").mapInArrow(lean(run), "doc_id long, text string")
