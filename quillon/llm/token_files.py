"""Token ids in Arrow files of equal-length sequences, and their way back.

Documents are dealt to range partitions of (doc_id, text hash). Each partition is encoded in that
order, an end id follows each document, and the ids are packed into sequences of `length`. A
partition becomes two Arrow IPC files: `ids-*.arrow`, record batches of two fixed-size lists, the ids
(uint16 if all ids fit, else uint32) and a mask that is false on padding, and
`docs-*.arrow`, the documents' ids, offsets and lengths. All lists of a column have one length, so the
buffers of a memory-mapped batch are matrices: row i of a column is found by arithmetic, without a copy.

A task writes under a name of its own attempt and reports it; only reported files count, so
a repeated or speculative attempt does no harm.

Encoding is that of the tokenizer on whole texts. Where its description shows that no token crosses ASCII white space, that letters are
lowered and how words end (see by_pieces), it works on pieces between white space; distinct pieces are encoded
once a process, in a table of bounded size. Texts of any other tokenizer are encoded whole.

Defined results: null texts are empty and give the end id alone; null ids come first; rows with equal
id are ordered by a hash of their text; extra columns are ignored; an empty table gives no files.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .base import by_bytes, materialize, release, shared_path

LENGTH = 2048
SEQUENCES_PER_BATCH = 64
MAX_PIECES = 1_000_000
GROUP_BYTES = 1 << 23
AT_ONCE = 4096
GATHERED_AT_ONCE = 1 << 17
END_ID = 2

#: How a tokenizer is described whose words can be encoded piece by piece.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
WORD_END, MARK = "</w>", "<|"

_encoders: dict[tuple[str, str], PieceEncoder] = {}


def by_pieces(described: dict) -> bool:
    """Whether a tokenizer, as its file describes it, encodes a text as its pieces between ASCII white space one by one: it lowers letters,
    drops white space, cuts words by WORDS, and ends each with a token that ends in WORD_END. Special tokens must be told by MARK."""
    split = {"type": "Split", "pattern": {"Regex": WORDS}, "behavior": "Removed", "invert": True}
    into = described["pre_tokenizer"] or {}
    words, *rest = into.get("pretokenizers", [None])
    bytes_only = len(rest) == 1 and rest[0]["type"] == "ByteLevel" and not rest[0]["add_prefix_space"] and not rest[0].get("use_regex", True)
    model = described["model"]
    plain = model["type"] == "BPE" and model["end_of_word_suffix"] == WORD_END and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "unk_token", "byte_fallback", "ignore_merges"))
    special = all(t["content"].startswith(MARK) and not (t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"]) and not any(map(str.isspace, t["content"])) for t in described["added_tokens"])
    lowered = (described["normalizer"] or {}).get("normalizers") == NORMALIZERS
    return words == split and bytes_only and plain and special and lowered and not described["truncation"] and not described["padding"]


def id_type(tokenizer: str, end_id: int, dtype: str | None = None) -> str:
    """The type of ids: uint16 if all of the vocabulary and the end id fit. A narrower one than that is refused."""
    from tokenizers import Tokenizer

    last = max(end_id, *Tokenizer.from_file(tokenizer).get_vocab(with_added_tokens=True).values())
    dtype = dtype or ("uint16" if last <= np.iinfo(np.uint16).max else "uint32")
    if last > np.iinfo(dtype).max:
        raise ValueError(f"ids up to {last} don't fit {dtype}")
    return dtype


class PieceEncoder:
    """Ids of texts by way of a table of white-space pieces, each of which is encoded once.

    The table is three arrays, pieces, ids and offsets, so a million pieces take about 30 MB. Splitting, the
    distinct pieces of a group of texts and their look-up are Arrow operations; a group's ids are
    gathered from the table at once. A table of more than MAX_PIECES keeps the pieces used since it
    was last cut, or none if that is most of them; a piece that is gone is encoded again."""

    def __init__(self, path: str, dtype: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has a core, and each thread keeps memory of its own
        self.tokenizer, self.dtype = Tokenizer.from_file(path), np.dtype(dtype)
        self.by_pieces = by_pieces(json.loads(self.tokenizer.to_str()))
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends_word = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends_word[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self._clear()

    @classmethod
    def get(cls, path: str, dtype: str) -> PieceEncoder:
        if (path, dtype) not in _encoders:
            _encoders[path, dtype] = cls(path, dtype)
        return _encoders[path, dtype]

    def _clear(self) -> None:
        self.pieces, self.ids = pa.array([], pa.string()), np.zeros(0, self.dtype)
        self.first, self.used = np.zeros(1, np.int64), np.zeros(0, bool)

    def _ids(self, pieces: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _add(self, pieces: pa.Array, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.ids = np.concatenate([self.ids, ids.astype(self.dtype)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(sizes)])
        self.used = np.concatenate([self.used, np.ones(len(sizes), bool)])

    def _add_one_by_one(self, pieces: pa.Array) -> None:
        """Some pieces at a time: what the tokenizer returns for one takes a hundred times its bytes."""
        ids, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for at in range(0, len(pieces), AT_ONCE):
            lists = self._ids(pieces.slice(at, AT_ONCE).to_pylist())
            ids.append(np.fromiter(chain.from_iterable(lists), self.dtype))
            sizes.append(np.fromiter(map(len, lists), np.int64, len(lists)))
        self._add(pieces, np.concatenate(ids), np.concatenate(sizes))

    def _add_letters(self, pieces: pa.Array) -> None:
        """Pieces of letters only, many at a time with spaces between: each ends with the one token of its
        that ends a word. Where that isn't so, they are encoded one by one."""
        for at in range(0, len(pieces), AT_ONCE):
            part = pieces.slice(at, AT_ONCE)
            ids = np.concatenate([np.array(x, np.int64) for x in self._ids([" ".join(part.slice(i, 256).to_pylist()) for i in range(0, len(part), 256)])])
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(part):
                self._add(part, ids, np.diff(ends, prepend=0))
            else:
                self._add_one_by_one(part)

    def _rows(self, pieces: pa.Array) -> np.ndarray:
        """Where pieces are in the table; -1 if they aren't."""
        return pc.fill_null(pc.index_in(pieces, self.pieces), -1).to_numpy(zero_copy_only=False)

    def _learn(self, pieces: pa.Array) -> None:
        """Put new pieces in the table. A full stop or comma after an ASCII letter is a token of its own, so
        the piece before it is what is encoded."""
        marked = pc.match_substring_regex(pieces, "[A-Za-z][.,]$")
        ends, pieces = pieces.filter(marked), pieces.filter(pc.invert(marked))
        stems = pc.utf8_slice_codeunits(ends, 0, -1)
        plain = pc.unique(pa.concat_arrays([pieces, stems]))
        plain = plain.filter(pa.array(self._rows(plain) < 0))
        letters = pc.utf8_is_alpha(plain)
        self._add_letters(plain.filter(letters))
        self._add_one_by_one(plain.filter(pc.invert(letters)))
        rows = self._rows(stems)
        sizes = np.diff(self.first)[rows]
        marks = np.where(pc.ends_with(ends, ".").to_numpy(zero_copy_only=False), *(self._ids([m])[0][0] for m in ".,"))
        self._add(ends, np.insert(self.ids[_spans(self.first[rows], sizes)], np.cumsum(sizes), marks), sizes + 1)

    def _cut(self) -> None:
        keep = np.flatnonzero(self.used)
        if len(keep) > MAX_PIECES // 2:
            return self._clear()
        first, sizes = self.first[keep], np.diff(self.first)[keep]
        self.ids = self.ids[_spans(first, sizes)]
        self.pieces, self.first, self.used = self.pieces.take(pa.array(keep)), np.append(0, np.cumsum(sizes)), np.zeros(len(keep), bool)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts without nulls, one after the other, and how many each has."""
        if not self.by_pieces:
            found = self._ids(texts.to_pylist())
            return np.fromiter(chain.from_iterable(found), np.int64).astype(self.dtype), np.fromiter(map(len, found), np.int64, len(found))
        if len(self.pieces) > MAX_PIECES:
            self._cut()
        # The tokenizer lowers letters itself; doing so first makes pieces alike, but special tokens are exact.
        lists = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, MARK), texts, pc.ascii_lower(texts)))
        coded = lists.flatten().dictionary_encode()
        rows = self._rows(coded.dictionary)
        if (rows < 0).any():
            self._learn(coded.dictionary.filter(pa.array(rows < 0)))
            rows = self._rows(coded.dictionary)
        self.used[rows] = True
        rows = rows[coded.indices.to_numpy(zero_copy_only=False)]
        del coded
        sizes = np.diff(self.first)[rows]
        before = np.append(0, np.cumsum(sizes))  # ids before each piece
        ids = np.empty(before[-1], self.dtype)
        for at in range(0, len(rows), GATHERED_AT_ONCE):
            part = slice(at, at + GATHERED_AT_ONCE)
            ids[before[at] : before[min(at + GATHERED_AT_ONCE, len(rows))]] = self.ids[_spans(self.first[rows[part]], sizes[part])]
        return ids, np.diff(before[lists.offsets.to_numpy() - lists.offsets[0].as_py()])


def _spans(first: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers first[i], first[i] + 1, ... of all spans, one span after the other."""
    ends = np.cumsum(sizes)
    most = max(ends[-1], int((first + sizes).max())) if len(ends) else 0
    kind = np.int32 if most <= np.iinfo(np.int32).max else np.int64  # a group has millions
    out = np.repeat((first - (ends - sizes)).astype(kind), sizes)
    out += np.arange(len(out), dtype=kind)
    return out


def _schemas(dtype: str, length: int) -> tuple[pa.Schema, pa.Schema]:
    ids = pa.schema([("ids", pa.list_(pa.field("item", pa.from_numpy_dtype(np.dtype(dtype)), nullable=False), length)), ("mask", pa.list_(pa.field("item", pa.bool_(), nullable=False), length))])
    return ids, pa.schema([("doc_id", pa.int64()), ("offset", pa.int64()), ("n_tokens", pa.int64())])


class _Packer:
    """Writes ids as batches of SEQUENCES_PER_BATCH sequences; the last batch may be shorter, and the
    last sequence is padded."""

    def __init__(self, sink: pa.NativeFile, schema: pa.Schema, dtype: str, length: int):
        self.writer, self.schema, self.dtype, self.length = pa.ipc.new_file(sink, schema), schema, np.dtype(dtype), length
        self.pending, self.held = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.length * SEQUENCES_PER_BATCH:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        """Write full batches; at the end also what is left, padded."""
        flat, step = np.concatenate([np.zeros(0, self.dtype), *self.pending]), self.length * SEQUENCES_PER_BATCH
        real = len(flat) if last else len(flat) // step * step
        whole = -(-real // self.length) * self.length
        if whole > len(flat):
            flat = np.concatenate([flat, np.zeros(whole - real, self.dtype)])
        for at in range(0, whole, step):
            part = flat[at : min(at + step, whole)]
            mask = np.arange(at, at + len(part)) < real
            columns = [pa.FixedSizeListArray.from_arrays(pa.array(x), type=self.schema.field(i).type) for i, x in enumerate((part, mask))]
            self.writer.write_batch(pa.record_batch(columns, schema=self.schema))
        self.pending = [flat[whole:].copy()]
        self.held = len(self.pending[0])

    def close(self) -> None:
        self._flush(True)
        self.writer.close()


def write(docs: DataFrame, tokenizer: str, end_id: int = END_ID, length: int = LENGTH, dtype: str | None = None, folder: str | None = None) -> DataFrame:
    """Write docs (doc_id, text) to folder, ids as dtype, by default the narrowest that holds the vocabulary. The manifest, one row a file pair: part, ids_file,
    docs_file, n_tokens, n_docs and start, the number of ids in all parts before."""
    folder, dtype = folder or shared_path(docs.sparkSession, "token-files"), id_type(tokenizer, end_id, dtype)
    ids_schema, docs_schema = _schemas(dtype, length)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        encoder, end = PieceEncoder.get(tokenizer, dtype), np.dtype(dtype).type(end_id)
        name = f"{context.partitionId():06d}-{context.taskAttemptId()}.arrow"
        packer, total, n_docs = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            if packer is None:
                fs, base = pafs.FileSystem.from_uri(folder)
                fs.create_dir(base)
                sink, docs_sink = (fs.open_output_stream(f"{base}/{kind}-{name}") for kind in ("ids", "docs"))
                packer, index = _Packer(sink, ids_schema, dtype, length), pa.ipc.new_file(docs_sink, docs_schema)
            counts = []
            for ids, sizes in map(encoder.encode, by_bytes(batch.column("text"), GROUP_BYTES)):
                packer.add(np.insert(ids, np.cumsum(sizes), end))
                counts.append(sizes + 1)
                release()
            counts = np.concatenate(counts)
            offsets = total + np.cumsum(counts) - counts
            total, n_docs = total + int(counts.sum()), n_docs + len(counts)
            index.write_batch(pa.record_batch([batch.column("doc_id").cast(pa.int64()), pa.array(offsets), pa.array(counts)], schema=docs_schema))
        if packer is not None:
            for x in (packer, index, sink, docs_sink):
                x.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "ids_file": [f"{folder}/ids-{name}"], "docs_file": [f"{folder}/docs-{name}"], "n_tokens": [total], "n_docs": [n_docs]})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"))
    ordered = ordered.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    files = materialize(ordered.mapInArrow(encode, "part long, ids_file string, docs_file string, n_tokens long, n_docs long"), "token-manifest")
    # A row a file: parts are ordered as their ids are.
    before = F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return materialize(files.withColumn("start", F.coalesce(before, F.lit(0)).cast("long")), "token-starts")


def open_batches(uri: str) -> pa.ipc.RecordBatchFileReader:
    """Local files are mapped into memory, others opened as a stream with random access."""
    fs, path = pafs.FileSystem.from_uri(uri)
    return pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path))


def sequence(uri: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """One sequence of a file and its mask; the ids are a view of the file, not a copy."""
    reader = open_batches(uri)
    batch = reader.get_batch(number // SEQUENCES_PER_BATCH)
    i = number % SEQUENCES_PER_BATCH
    length = batch.schema.field("ids").type.list_size
    return batch.column("ids").flatten().to_numpy(zero_copy_only=True)[i * length : (i + 1) * length], batch.column("mask")[i].values.to_numpy(zero_copy_only=False)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        for row in rows.to_pylist():
            reader, which, done, flat = open_batches(row["ids_file"]), -1, 0, np.zeros(0, np.uint32)
            index = open_batches(row["docs_file"])
            for k in range(index.num_record_batches):
                docs, crcs = index.get_batch(k), []
                for at, n in zip(docs.column("offset").to_pylist(), docs.column("n_tokens").to_pylist(), strict=True):
                    crc = 0
                    while n:
                        while at >= done + len(flat):
                            done, which = done + len(flat), which + 1
                            flat = reader.get_batch(which).column("ids").flatten().to_numpy(zero_copy_only=True)
                        piece = flat[at - done : at - done + n]
                        crc, at, n = zlib.crc32(piece.astype("<u4"), crc), at + len(piece), n - len(piece)
                    crcs.append(crc)
                start = pa.array(docs.column("offset").to_numpy() + row["start"])
                yield pa.record_batch([docs.column("doc_id"), start, docs.column("n_tokens"), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    # A file a task: the manifest has a row a file, so ranges of single rows.
    return manifest.repartitionByRange(max(1, manifest.count()), "part").mapInArrow(_read, "doc_id long, start long, n_tokens long, ids_crc32 long")
