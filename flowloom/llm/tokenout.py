"""Token ids as files: Arrow streams of equal-length sequences.

A folder holds, for each range of ascending doc_id, two Arrow IPC streams:

- `part-NNNNN.arrows`: batches of `ids` and `mask`, both fixed-size lists of SEQUENCE
  entries. Documents follow one another without gaps and are cut into sequences;
  the mask is false on the padding of the last sequence only. Every batch but the
  last has BATCH sequences, so the place of a sequence follows from its number, and
  a memory-mapped file gives it without a copy.
- `docs-NNNNN.arrows`: doc_id, start (ids before it in the part) and n_tokens.

The id type is the smallest unsigned integer that holds the vocabulary.

Defined results: a null text is an empty document (the end id alone); rows that
repeat an id are written one after another, in the order of a hash of their texts; rows without an id come first;
an empty table gives a folder without parts and no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Sequences, gather, steps

SEQUENCE = 1024
BATCH = 256
#: Bytes of text that are encoded at once.
STEP = 4 << 20
#: Words, and ids of words, that a worker remembers; longer words than CACHE_CHARS aren't found again.
CACHE_WORDS, CACHE_IDS, CACHE_CHARS = 1_200_000, 8_000_000, 48

# Fixed values, for RE2: white space of Unicode followed by a blank; letters of Latin scripts.
_BEFORE_BLANK = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_ENCODERS: dict[str, WordwiseEncoder] = {}


class WordwiseEncoder:
    """Encodes whole texts with the tokenizers library, each distinct word once.

    The pre-tokenizer of byte-level BPE never joins a non-blank character to a blank after it, so the encoding of a text is
    that of its words, each with the blank before it, in a row; and it always cuts between a letter or digit and the ASCII marks
    at a word's end. A word of letters is one run, which the library's model is asked for directly; other words go through
    the whole library. Texts in which a blank follows other white space or that name a special token, and vocabularies of
    another make, are encoded as one.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        made = json.load(open(path, encoding="utf-8"))
        kind, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        self.wordwise = made.get("normalizer") is None and kind.get("type") == "ByteLevel" and not kind.get("add_prefix_space") and kind.get("use_regex", True)
        self.plain = self.wordwise and model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix"))
        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        if self.plain and hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)  # each word is asked for once
        self.wide = self.library.get_vocab_size() > 65_536
        self.added = [t["content"] for t in made.get("added_tokens") or []]
        # Byte-level vocabularies write a byte that prints as itself, and the others from 256 on.
        prints = {b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255}
        others = (b for b in range(256) if b not in prints)
        self.letters = {b: b for b in prints} | {b: 256 + k for k, b in enumerate(others)}
        self._forget()

    def _forget(self) -> None:
        self.stored = Sequences()
        self.known: dict[bool, dict[str, int]] = {False: {}, True: {}}  # by whether a blank comes before

    def _library(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _numbers(self, words: pa.Array, blank: bool) -> np.ndarray:
        """The number of each of the (distinct) words' sequences; new ones are encoded and filed."""
        known, texts = self.known[blank], words.to_numpy(zero_copy_only=False).tolist()
        numbers = list(map(known.get, texts))
        gaps = [k for k, n in enumerate(numbers) if n is None]
        if gaps:
            plain = pc.match_substring_regex(words.take(pa.array(gaps)), f"^[{_LATIN}]+$").to_numpy(zero_copy_only=False).tolist() if self.plain else [False] * len(gaps)
            ask, letters, before = self.model.tokenize, self.letters, chr(self.letters[32]) if blank else ""
            rest = iter(self._library([(" " if blank else "") + texts[k] for k, p in zip(gaps, plain) if not p]))
            found = []
            for k, p in zip(gaps, plain):
                if p:
                    w = texts[k]
                    found.append([t.id for t in ask(before + (w if w.isascii() else w.encode().decode("latin-1").translate(letters)))])
                else:
                    found.append(next(rest))
            for k, n in zip(gaps, self.stored.add_lists(found)):
                numbers[k] = n
                if len(texts[k]) <= CACHE_CHARS:
                    known[texts[k]] = n
        return np.array(numbers, np.int64)

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Sequence numbers of distinct words after a blank: of their stems, and of the marks at their ends (0: none)."""
        stems = pc.utf8_rtrim(words, characters=string.punctuation)
        cut = pc.and_(pc.not_equal(stems, words), pc.match_substring_regex(stems, f"[{_LATIN}0-9]$"))
        stems = pc.if_else(cut, stems, words).dictionary_encode()
        marks = np.zeros(len(words), np.int64)
        marked = pc.replace_substring_regex(words.filter(cut), f"(?s)^.*[{_LATIN}0-9]", "").dictionary_encode()
        marks[cut.to_numpy(zero_copy_only=False)] = self._numbers(marked.dictionary, False)[marked.indices.to_numpy()]
        return self._numbers(stems.dictionary, True)[stems.indices.to_numpy()], marks

    def encode(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, how many each has); nulls are empty, `end` follows each text."""
        if not len(texts):
            return np.empty(0, np.uint32), np.empty(0, np.int64)
        if len(self.known[True]) + len(self.known[False]) > CACHE_WORDS or self.stored.used > CACHE_IDS:
            self._forget()
        texts = pc.fill_null(texts, "")
        whole = pc.match_substring_regex(texts, _BEFORE_BLANK) if self.wordwise else pa.array([True] * len(texts))
        for content in self.added:
            whole = pc.or_(whole, pc.match_substring(texts, content))
        split = pc.split_pattern(pc.if_else(whole, "", texts), " ")
        offsets = split.offsets.to_numpy().astype(np.int64)
        first = offsets[:-1] - offsets[0]
        coded = split.flatten().dictionary_encode()
        code = coded.indices.to_numpy()
        heads = coded.dictionary.take(pa.array(code[first])).dictionary_encode()
        head = self._numbers(heads.dictionary, False)[heads.indices.to_numpy()]
        apart = whole.to_numpy(zero_copy_only=False)
        head[apart] = np.array(self.stored.add_lists(self._library(texts.filter(whole).to_pylist())), np.int64)
        stems, marks = self._words(coded.dictionary)
        word_ids, size = self.stored.joined(np.stack([stems, marks], 1).ravel())
        head_ids, head_size = self.stored.joined(head)
        size = size.reshape(-1, 2).sum(1)
        start = np.cumsum(size) - size
        pool, start, size = np.concatenate([word_ids, head_ids]), start[code], size[code]
        start[first], size[first] = len(word_ids) + np.cumsum(head_size) - head_size, head_size
        ids, size = gather(pool, start, size), np.add.reduceat(size, first)
        return (ids, size) if end is None else (np.insert(ids, np.cumsum(size), end), size + 1)


def encoder(path: str) -> WordwiseEncoder:
    """The encoder of a vocabulary file; a Python worker keeps it, with its words, from task to task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordwiseEncoder(path)
    return _ENCODERS[path]


def _filesystem(path: str):
    return pa.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else pa.fs.FileSystem.from_uri(f"file://{path}")


class _Part:
    """Writes one part; the file gets its name when it is whole, so a task that runs again replaces it."""

    def __init__(self, folder: str, number: int, wide: bool):
        self.fs, root = _filesystem(folder)
        self.fs.create_dir(root, recursive=True)
        self.names = [f"{root}/{kind}-{number:05d}.arrows" for kind in ("part", "docs")]
        attempt = TaskContext.get().taskAttemptId() if TaskContext.get() else 0
        self.drafts = [f"{n}.{attempt}.tmp" for n in self.names]
        self.kind = pa.uint32() if wide else pa.uint16()
        self.schema = pa.schema([("ids", pa.list_(self.kind, SEQUENCE)), ("mask", pa.list_(pa.bool_(), SEQUENCE))])
        self.index = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])
        self.files = [self.fs.open_output_stream(d) for d in self.drafts]
        self.streams = [pa.ipc.new_stream(f, s) for f, s in zip(self.files, (self.schema, self.index))]
        self.held, self.n_held, self.total, self.docs = [], 0, 0, 0

    def add(self, doc_ids: pa.Array, ids: np.ndarray, size: np.ndarray) -> None:
        """Documents in a row: their ids, and how many each has."""
        ids = ids.astype(self.kind.to_pandas_dtype())
        start = self.total + np.cumsum(size) - size
        self.streams[1].write_batch(pa.record_batch([doc_ids, pa.array(start), pa.array(size)], schema=self.index))
        self.total += len(ids)
        self.docs += len(size)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= SEQUENCE * BATCH:
            self._write(last=False)

    def _write(self, last: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.empty(0, self.kind.to_pandas_dtype())
        step = SEQUENCE * BATCH
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            self._batch(ids[a : a + step], step)
        rest = ids[whole:]
        if last and len(rest):
            self._batch(np.append(rest, np.zeros(-len(rest) % SEQUENCE, ids.dtype)), len(rest))
            rest = rest[:0]
        self.held, self.n_held = [rest], len(rest)

    def _batch(self, ids: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(ids)) < real)
        columns = [pa.FixedSizeListArray.from_arrays(x, SEQUENCE) for x in (pa.array(ids, self.kind), mask)]
        self.streams[0].write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> tuple[int, int]:
        self._write(last=True)
        for stream, file, draft, name in zip(self.streams, self.files, self.drafts, self.names):
            stream.close()
            file.close()
            self.fs.move(draft, name)
        return self.total, self.docs


class TokenFile:
    """Random access to the sequences of one part; local files are mapped, not read."""

    def __init__(self, folder: str, number: int):
        fs, root = _filesystem(folder)
        local = isinstance(fs, pa.fs.LocalFileSystem)
        self.source, index = (pa.memory_map(n) if local else fs.open_input_file(n) for n in (f"{root}/{kind}-{number:05d}.arrows" for kind in ("part", "docs")))
        self.batches = list(pa.ipc.open_stream(self.source))
        self.docs = pa.ipc.open_stream(index).read_all()

    def __len__(self) -> int:
        return sum(b.num_rows for b in self.batches)

    def _row(self, column: int, k: int) -> pa.Array:
        return self.batches[k // BATCH].column(column).slice(k % BATCH, 1).flatten()

    def sequence(self, k: int) -> np.ndarray:
        return self._row(0, k).to_numpy()

    def mask(self, k: int) -> np.ndarray:
        return self._row(1, k).to_numpy(zero_copy_only=False)

    def ids(self, start: int, n: int) -> np.ndarray:
        """The ids start to start + n of the part, whatever sequences they lie in."""
        step, found = SEQUENCE * BATCH, []
        while n:
            batch = self.batches[start // step].column(0)
            piece = batch.flatten().slice(start % step, n).to_numpy()
            found.append(piece)
            start, n = start + len(piece), n - len(piece)
        return np.concatenate(found) if found else np.empty(0, np.uint16)


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int, parts: int | None = None) -> list[tuple[int, int, int]]:
    """Writes (doc_id, text) to the folder in ascending doc_id order; (part, ids, documents) of each part.

    Parts are ranges of (doc_id, hash of the text), so that rows of one id, or without one, may fill several; without a number there are as many as
    the input has partitions, and no fewer than the session's shuffles have.
    """
    parts = parts or max(docs.rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, part, library = TaskContext.get().partitionId(), None, encoder(tokenizer)
        for whole in batches:
            for batch in steps(whole, "text", STEP):
                part = part or _Part(folder, number, library.wide)
                part.add(batch.column("doc_id"), *library.encode(batch.column("text"), end_id))
        if part:
            total, n = part.close()
            yield pa.RecordBatch.from_pydict({"part": [number], "n_ids": [total], "n_docs": [n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    ranged = rows.repartitionByRange(parts, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text").drop("h")
    return sorted(tuple(r) for r in ranged.mapInArrow(write, "part long, n_ids long, n_docs long").collect())


def read_tokens(spark: SparkSession, folder: str, parts: list[tuple[int, int, int]]) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32."""
    out = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not parts:
        return spark.createDataFrame([], out)
    base = np.cumsum([0, *(p[1] for p in parts)])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, before in zip(*(batch.column(c).to_pylist() for c in ("part", "base"))):
                file = TokenFile(folder, number)
                for index in file.docs.to_batches(max_chunksize=4096):
                    where = list(zip(index.column("start").to_pylist(), index.column("n_tokens").to_pylist()))
                    crc = [zlib.crc32(file.ids(a, n).astype("<u4").tobytes()) for a, n in where]
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": index.column("doc_id"), "start": pa.array([a + before for a, _ in where], pa.int64()), "n_tokens": index.column("n_tokens"), "ids_crc32": pa.array(crc, pa.int64())}
                    )

    listed = spark.createDataFrame([(p[0], int(b)) for p, b in zip(parts, base)], "part long, base long")
    return listed.repartition(len(parts)).mapInArrow(read, out)
