"""Token ids in directly addressable codes (operator 8).

An id is split into byte-wide chunks. Level 0 holds the lowest chunk of every id, level k the k-th chunk of
those ids that have one, in order. Each level has a continuation bitmap (bit i: the i-th id of the level goes
on in the next level) and a rank directory (ones before every 512th bit), so any id is found by at most four
look-ups of a chunk, a bit and a rank, without decoding its neighbours.

File: segments, then the directory of segments and of documents, its length and the magic bytes. A segment
holds whole documents. All integers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

MAGIC = b"CVDAC1\n\0"
RANK_BITS = 512
_RANK_BYTES = RANK_BITS // 8
_ONES = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """One segment."""
    left, levels = np.asarray(ids, dtype=np.uint32), []
    while True:
        more = left >> np.uint32(8)
        goes_on = more > 0
        bits = np.packbits(goes_on, bitorder="little")
        bits = np.concatenate([bits, np.zeros(-len(bits) % _RANK_BYTES, np.uint8)])
        ranks = np.concatenate([[0], np.cumsum(_ONES[bits].reshape(-1, _RANK_BYTES).sum(axis=1, dtype=np.int64))])[:-1]
        levels.append((len(left), (left & np.uint32(255)).astype(np.uint8).tobytes() + bits.tobytes() + ranks.astype("<u4").tobytes()))
        left = more[goes_on]
        if not len(left):
            break
    return struct.pack(f"<I{len(levels)}I", len(levels), *[n for n, _ in levels]) + b"".join(x for _, x in levels)


class Segment:
    """Random access to one segment. read(offset, length) gives bytes of it."""

    def __init__(self, read):
        (k,) = struct.unpack("<I", read(0, 4))
        self.read, self.sizes = read, struct.unpack(f"<{k}I", read(4, 4 * k))
        at, self.at = 4 + 4 * k, []
        for n in self.sizes:
            blocks = -(-n // RANK_BITS)
            self.at.append((at, at + n, at + n + blocks * _RANK_BYTES))
            at += n + blocks * _RANK_BYTES + 4 * blocks

    def __len__(self) -> int:
        return self.sizes[0]

    def _rank(self, level: int, i: int) -> int:
        """Ones of the level's bitmap before bit i."""
        _, bits, ranks = self.at[level]
        block = i // RANK_BITS
        if i == self.sizes[level] and i % RANK_BITS == 0:
            return self.sizes[level + 1] if level + 1 < len(self.sizes) else 0
        (before,) = struct.unpack("<I", self.read(ranks + 4 * block, 4))
        return before + (int.from_bytes(self.read(bits + block * _RANK_BYTES, _RANK_BYTES), "little") & ((1 << i % RANK_BITS) - 1)).bit_count()

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < len(self):
            raise IndexError(i)
        value, level = 0, 0
        while True:
            chunks, bits, _ = self.at[level]
            value |= self.read(chunks + i, 1)[0] << 8 * level
            if not self.read(bits + i // 8, 1)[0] >> i % 8 & 1:
                return value
            i, level = self._rank(level, i), level + 1

    def slice(self, start: int, stop: int) -> np.ndarray:
        """ids[start:stop], reading those bytes of each level that they need."""
        values, where, level = np.zeros(stop - start, dtype=np.uint32), np.arange(stop - start), 0
        while start < stop:
            chunks, bits, _ = self.at[level]
            values[where] |= np.frombuffer(self.read(chunks + start, stop - start), np.uint8).astype(np.uint32) << np.uint32(8 * level)
            if level + 1 == len(self.sizes):
                break
            first = start // 8
            on = np.unpackbits(np.frombuffer(self.read(bits + first, -(-stop // 8) - first), np.uint8), bitorder="little")[start - 8 * first : stop - 8 * first].astype(bool)
            where, start = where[on], self._rank(level, start)
            stop, level = start + len(where), level + 1
        return values


class Writer:
    def __init__(self, sink, segment_ids: int = 1 << 20):
        self.sink, self.segment_ids = sink, segment_ids
        self.parts, self.held, self.at, self.total = [], 0, 0, 0
        self.segments, self.docs = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // 4
        self.docs.append((0 if doc_id is None else doc_id, doc_id is None, self.total, n))
        self.parts.append(ids)
        self.total, self.held = self.total + n, self.held + n
        if self.held >= self.segment_ids:
            self._flush()

    def _flush(self) -> None:
        if self.parts:
            block = encode(np.frombuffer(b"".join(self.parts), dtype="<u4"))
            self.sink.write(block)
            self.segments.append((self.at, len(block), self.total - self.held, self.held))
            self.at, self.parts, self.held = self.at + len(block), [], 0

    def close(self) -> int:
        self._flush()
        docs = np.array(self.docs, dtype=[("id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")])
        tail = struct.pack("<II", len(self.segments), len(docs)) + b"".join(struct.pack("<4Q", *s) for s in self.segments) + docs.tobytes()
        self.sink.write(tail + struct.pack("<Q", len(tail)) + MAGIC)
        self.sink.close()
        return self.at + len(tail) + 16


class TokenFile:
    """An open file: documents, ids by position, and the ids of documents in order."""

    def __init__(self, source, size: int):
        def read(offset: int, length: int) -> bytes:
            source.seek(offset)
            return source.read(length)

        end = read(size - 16, 16)
        if end[8:] != MAGIC:
            raise ValueError("not a token file, or cut short")
        tail = read(size - 16 - (n := struct.unpack("<Q", end[:8])[0]), n)
        segments, docs = struct.unpack("<II", tail[:8])
        self.read, self.segments = read, [struct.unpack_from("<4Q", tail, 8 + 32 * i) for i in range(segments)]
        self.docs = np.frombuffer(tail, dtype=[("id", "<i8"), ("null", "u1"), ("start", "<u8"), ("n", "<u8")], offset=8 + 32 * segments, count=docs)

    def _segment(self, i: int, whole: bool) -> Segment:
        offset, length, *_ = self.segments[i]
        if whole:
            block = self.read(offset, length)
            return Segment(lambda a, n: block[a : a + n])
        return Segment(lambda a, n: self.read(offset + a, n))

    def __getitem__(self, position: int) -> int:
        i = int(np.searchsorted([s[2] for s in self.segments], position, side="right")) - 1
        return self._segment(i, whole=False)[position - self.segments[i][2]]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, start in the file, ids), one segment decoded at a time."""
        at, open_segment = -1, None
        starts = np.array([s[2] for s in self.segments], dtype=np.int64)
        for doc in self.docs:
            i = int(np.searchsorted(starts, int(doc["start"]), side="right")) - 1
            if i != at:
                at, open_segment = i, self._segment(i, whole=True).slice(0, self.segments[i][3])
            a = int(doc["start"]) - self.segments[i][2]
            yield (None if doc["null"] else int(doc["id"])), int(doc["start"]), open_segment[a : a + int(doc["n"])]


def write(docs: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write ids of every text (null: empty), each with its end id, in ascending doc_id order (null ids first).

    Returns one row per file: file_no (ascending with the ids), file, n_docs, n_tokens, n_bytes. Repeated ids are kept
    as separate documents, in the order of their texts' hashes. Texts of any length are kept whole; other columns are not read. An empty table gives no file. A task that is run again writes a new file; the old one is
    in no row. Partitions are ranges of the id, so each file is written by one task with one segment in memory.
    """

    def to_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        encoder, end, writer = tokens.encoder(tokenizer), np.array([tokens.END_ID], "<u4").tobytes(), None
        system, root = common.byte_files(folder)
        no = TaskContext.get().partitionId()
        for batch in batches:
            if writer is None:
                system.create_dir(root, recursive=True)
                name = f"{root}/tokens-{no:06d}-{uuid.uuid4().hex}.dac"
                writer = Writer(system.open_output_stream(name, compression=None))
            ids = [None if pd.isna(i) else int(i) for i in batch["i"]]
            for i, b in zip(ids, encoder.encode([t if isinstance(t, str) else None for t in batch["t"]]), strict=True):
                writer.add(i, b + end)
        if writer is not None:
            size = writer.close()
            yield pd.DataFrame({"file_no": [no], "file": [name], "n_docs": [len(writer.docs)], "n_tokens": [writer.total], "n_bytes": [size]})

    ordered = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).repartitionByRange("i").sortWithinPartitions("i", F.xxhash64("t"), "t")
    return common.checkpointed(ordered.mapInPandas(to_files, "file_no long, file string, n_docs long, n_tokens long, n_bytes long"))


def read(files: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    first = F.coalesce(F.sum("n_tokens").over(W.orderBy("file_no").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))  # one row per file

    def to_docs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, _ = common.byte_files(folder)
        for batch in batches:
            for name, size, start in zip(batch["file"], batch["n_bytes"], batch["first"], strict=True):
                with system.open_input_file(name) as source:
                    rows = [(i, start + s, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, s, ids in TokenFile(source, size).documents()]
                out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32"])
                yield out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    placed = files.select("file", "n_bytes", first.alias("first"))
    return placed.repartition(common.partitions(files.sparkSession)).mapInPandas(to_docs, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op8_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = common.new_folder(spark, "tokens")
    files = write(common.read(spark, sf_dir, "documents"), folder, tokens.default_path())
    out = common.checkpointed(read(files, folder))
    common.remove(spark, folder)
    return out
