"""Token-ID output: Arrow stream files of equal-length sequences that are read back without copying.

Documents are range-partitioned and sorted by id; each task encodes its documents whole, ends each with end_id, packs the
ids end to end into sequences of one length, and writes one Arrow IPC file of record batches with two fixed-size-list
columns: ids (the narrowest unsigned type that holds the vocabulary) and mask (false where the last sequence is padded).
A batch's metadata lists the documents that end in it, so any sequence can be read at once, and documents too. Files go
to the folder that all executors share, under a name that a repeated task writes again in full.

pyarrow's file systems write and read the files: file:// and, where libhdfs is installed, hdfs://.
"""

from __future__ import annotations

import json
import re
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, shared_dir, slices, table

#: Pieces of text and words whose ids a worker keeps at most, in two generations.
CACHE_PIECES = 300_000


#: How the pre-tokenizer of a vocabulary of words with ends cuts a text in lower case.
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: A tokenizer's whole description but for its vocabulary, as those cuts take it for granted.
_DESCRIPTION = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": {"Regex": _SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
}
_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
#: Texts of ASCII and Latin-1 letters, and the same cut for them, in lower case.
_PLAIN = re.compile(r"[\t\n\r -~À-ÖØ-öø-ÿ]*+")
_WORDS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|'(?:s|t|re|ve|m|ll|d)|[^\sa-zß-öø-ÿ0-9]+")
_LETTERS = "".join(map(chr, [*range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)]))
_PROBES = ["Word", "word,", "ÉTÉ!!", "straße.", "ñandú***", "çà|", "---", "LoweR?", "it's", "A1b'LL22", "x--'s"]


def _is_plain(text: str) -> bool:
    """Whether _WORDS cuts a text as the tokenizer does: none of its special tokens can be in it."""
    return _PLAIN.fullmatch(text) is not None and "<|" not in text


class Encoder:
    """Encodes whole texts to what the tokenizer's own encode() gives for them.

    Where the tokenizer never joins pieces across a blank or line feed, and probes show it, pieces are encoded once and
    looked up after that. Where its description is _DESCRIPTION and _MODEL, its special tokens begin with <| and probes
    agree, texts of ASCII and Latin-1 letters are cut here and their words go to the tokenizer's model, once each. Other
    tokenizers, and any that truncates, pads or draws, encode whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.code = "H" if self.dtype is np.uint16 else "I"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        bare = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {ord(c): bare.pre_tokenize_str(c)[0][0] for c in _LETTERS}
        whole = [self._whole(a + b + c) for a in _PROBES for b in (" ", "\n", "  ") for c in _PROBES]
        told = json.loads(self.tokenizer.to_str())
        model = {k: v for k, v in told["model"].items() if k not in ("vocab", "merges")}
        steady = told["truncation"] is None and told["padding"] is None and not model.get("dropout")
        self.by_piece = steady and whole == [self._whole(a) + self._whole(c) for a in _PROBES for _ in range(3) for c in _PROBES]
        marked = all(t["content"].startswith("<|") for t in told["added_tokens"])
        cut_so = marked and model == _MODEL and all(told[k] == v for k, v in _DESCRIPTION.items())
        self.plain = self.by_piece and cut_so and all(self._joined(p) == self._whole(p) for p in _PROBES)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.dtype).tobytes()

    def _word(self, word: str) -> bytes:
        """The model's ids of one of the pieces that _WORDS cuts."""
        tokens = self.tokenizer.model.tokenize(word if word.isascii() else word.translate(self.letters))
        return array(self.code, [t.id for t in tokens]).tobytes()

    def _joined(self, text: str) -> bytes:
        return b"".join([self._word(w) for w in _WORDS.findall(text.lower())])

    def _learn(self, words: set[str], pieces: set[str]) -> None:
        """Puts what is new into the newer generation: from the older one, or encoded."""
        known, older, rest, word = self.known, self.older, [], self._word
        for w in words:
            got = older.get(w)
            known[w] = word(w) if got is None else got
        for p in pieces:
            got = older.get(p)
            if got is None and self.plain and _is_plain(p):
                got = self._joined(p)
            if got is None:
                rest.append(p)
            else:
                known[p] = got
        for p, e in zip(rest, self.tokenizer.encode_batch(rest, add_special_tokens=False), strict=True):
            known[p] = array(self.code, e.ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of dtype; a null text has none.

        When the newer generation of known pieces is full it becomes the older one, so that pieces in use stay known.
        """
        if not self.by_piece:
            return [self._whole(t or "") for t in texts]
        if len(self.known) > CACHE_PIECES // 2:
            self.known, self.older = {}, self.known
        cut_here = [self.plain and _is_plain(t or "") for t in texts]
        split = [_WORDS.findall((t or "").lower()) if c else (t or "").replace("\n", " ").split(" ") for t, c in zip(texts, cut_here, strict=True)]
        words, pieces = (set().union(*[own for own, c in zip(split, cut_here, strict=True) if c is kind]).difference(self.known) for kind in (True, False))
        if words or pieces:
            self._learn(words, pieces)
        known = self.known
        return [b"".join(map(known.__getitem__, own)) for own in split]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker and file, so that later tasks find its pieces known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _schema(dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class _Packer:
    """Writes ids as batches of rows sequences; keeps no more than one batch."""

    def __init__(self, sink, dtype, length: int, rows: int):
        self.schema, self.dtype, self.length, self.most = _schema(dtype, length), dtype, length, length * rows
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.held = self.written = 0
        self.docs: list[tuple[int | None, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        while self.held + len(ids) > self.most:
            room = self.most - self.held
            self._take(ids[:room])
            ids = ids[room:]
            self.flush()
        self._take(ids)
        self.docs.append((doc_id, self.written + self.held))

    def _take(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.held += len(ids)

    def flush(self) -> None:
        if not self.held and not self.docs:
            return
        ids = np.concatenate([*self.parts, np.zeros(-self.held % self.length, dtype=self.dtype)])
        mask = np.arange(len(ids)) < self.held
        columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), self.length) for x in (ids, mask)]
        ends = np.array([e for _, e in self.docs], dtype=np.int64).tobytes()
        names = np.array([-1 if d is None else d for d, _ in self.docs], dtype=np.int64).tobytes()
        nulls = np.array([d is None for d, _ in self.docs], dtype=bool).tobytes()
        self.writer.write_batch(pa.record_batch(columns, schema=self.schema), custom_metadata={b"doc_id": names, b"null": nulls, b"end": ends})
        self.written += self.held
        self.parts, self.held, self.docs = [], 0, []

    def close(self) -> None:
        self.flush()
        self.writer.close()


def _writer(path: str, folder: str, end_id: int, length: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(path)
        task = TaskContext.get()
        part = task.partitionId()
        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        name, draft = f"{root}/ids-{part:06d}.arrow", f"{root}/.ids-{part:06d}-{task.taskAttemptId()}"
        end = np.array([end_id], dtype=own.dtype)
        docs = ids = 0
        with system.open_output_stream(draft) as sink:
            packer = _Packer(sink, own.dtype, length, rows)
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    some = batch.slice(a, b - a)
                    for doc_id, got in zip(some.column("doc_id").to_pylist(), own.encode(some.column("text").to_pylist()), strict=True):
                        held = np.concatenate([np.frombuffer(got, dtype=own.dtype), end])
                        packer.add(doc_id, held)
                        docs, ids = docs + 1, ids + len(held)
            packer.close()
        system.move(draft, name)
        yield pa.record_batch({"part": pa.array([part], pa.int64()), "file": pa.array([f"ids-{part:06d}.arrow"]), "n_docs": pa.array([docs], pa.int64()), "n_ids": pa.array([ids], pa.int64())})

    return run


def write_ids(docs: DataFrame, tokenizer_path: str, folder: str, end_id: int = 1, length: int = 2048, rows: int = 64) -> DataFrame:
    """Writes docs (doc_id, text) in ascending doc_id order; gives (part, file, n_docs, n_ids, start) of the files.

    start is the number of ids in the files before. A null or empty text is its end id alone; null doc_ids come first;
    rows of one doc_id follow each other by text; other columns are left out. An empty table writes no documents.
    """
    ranged = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    files = cut(ranged.mapInArrow(_writer(tokenizer_path, folder, end_id, length, rows), "part long, file string, n_docs long, n_ids long"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    return files.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, offset in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                local = isinstance(system, fs.LocalFileSystem)
                with pa.memory_map(f"{root}/{name}") if local else system.open_input_file(f"{root}/{name}") as source:
                    file = pa.ipc.open_file(source)
                    base = begin = crc = 0
                    for k in range(file.num_record_batches):
                        got, meta = file.get_batch_with_custom_metadata(k)
                        ids = np.asarray(got.column("ids").values)
                        real = int(np.count_nonzero(np.asarray(got.column("mask").values)))
                        meta = meta or {}
                        ends = np.frombuffer(meta.get(b"end", b""), dtype=np.int64)
                        names = np.frombuffer(meta.get(b"doc_id", b""), dtype=np.int64).tolist()
                        nulls = np.frombuffer(meta.get(b"null", b""), dtype=bool)
                        at, out = 0, []
                        for name_, null, e in zip(names, nulls, ends.tolist(), strict=True):
                            crc = zlib.crc32(ids[at : e - base].astype("<u4").tobytes(), crc)
                            out.append((None if null else name_, offset + begin, e - begin, crc))
                            at, begin, crc = e - base, e, 0
                        crc = zlib.crc32(ids[at:real].astype("<u4").tobytes(), crc)
                        base += real
                        doc, start, n, sums = zip(*out, strict=True) if out else ((), (), (), ())
                        yield pa.record_batch({"doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_crc32": pa.array(sums, pa.int64())})

    return run


def read_ids(files: DataFrame, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of write_ids(), one file a task."""
    work = files.select("file", "start").repartition(max(1, files.count()), "file")
    return work.mapInArrow(_reader(folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_read(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """What read_ids() finds in newly written files in the shared folder."""
    folder = f"{shared_dir(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    return read_ids(write_ids(docs, tokenizer_path, folder, **options), folder)


def op7_token_id_output(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path("word_bpe_49k.json")
    return encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path)
