"""Document fingerprints that subtract (operator 7).

A text is cut into paragraphs, long ones into sentences and these into runs of words; each is a 64-bit digest, repeated
ones numbered. The fingerprint is an invertible Bloom lookup table of the digests: every digest falls into one cell of
each of three parts; a cell holds how many digests it got, their xor, and the xor of their check hashes. A larger table
folds to the size of a smaller one, so the cells of any two fingerprints subtract; what differs is then peeled: a cell
with a single digest gives it up, which frees others, until all differing digests of both sides are recovered. If that
gets stuck, both tables are made anew four times as large. Batches of documents are worked on together in numpy.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

PARTS = 3
_PARAGRAPH = re.compile(r"[^\n]+")
#: A stop ends a sentence where white space follows.
_SENTENCE = re.compile(r"(?<=[.!?])\s+")
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], dtype=np.uint64)


def units(text: str, long: int = 160, most_words: int = 16) -> list[str]:
    """Paragraphs of a text in order. A long one is cut into sentences, a long sentence after words chosen by their hash, or after `most_words`."""
    out = []
    for paragraph in _PARAGRAPH.findall(text):
        for u in [paragraph] if len(paragraph) <= long else _SENTENCE.split(paragraph):
            if len(u) <= long:
                if u := u.strip():
                    out.append(u)
                continue
            held: list[str] = []
            for word in u.split():
                held.append(word)
                if len(held) >= most_words or zlib.crc32(word.encode()) % 8 == 0:
                    out.append(" ".join(held))
                    held = []
            if held:
                out.append(" ".join(held))
    return out


def digests(text: str) -> np.ndarray:
    seen: dict[str, int] = {}
    out = []
    for u in units(text):
        n = seen[u] = seen.get(u, -1) + 1
        out.append(xxhash.xxh3_64_intdigest(b"%d %s" % (n, u.encode())))
    return np.unique(np.array(out, dtype=np.uint64))


def first_size(n: int) -> int:
    """Cells of one part: a power of two, at least a quarter of the digests."""
    return 1 << max(2, (max(n, 1) - 1).bit_length() - 2)


def _check(keys: np.ndarray) -> np.ndarray:
    return ((keys * _ODD[3]) >> np.uint64(33)).astype(np.uint32)


def _places(keys: np.ndarray, base: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The cell of each key in each part; base and size: of its table."""
    mixed = (keys[None, :] ^ (keys[None, :] >> np.uint64(29))) * _ODD[:PARTS, None]
    return base + np.arange(PARTS)[:, None] * size + ((mixed >> np.uint64(24)) & (size - 1).astype(np.uint64)).astype(np.int64)


class Tables:
    """The cells of many documents one after the other; document k has 3 * sizes[k] of them."""

    def __init__(self, sizes: np.ndarray):
        self.sizes = sizes.astype(np.int64)
        self.base = np.concatenate([[0], np.cumsum(PARTS * self.sizes)])
        self.count = np.zeros(self.base[-1], np.int64)
        self.key, self.check = np.zeros(self.base[-1], np.uint64), np.zeros(self.base[-1], np.uint32)

    @classmethod
    def of_sets(cls, sets: list[np.ndarray], sizes: np.ndarray) -> Tables:
        out = cls(sizes)
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        keys = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        at = _places(keys, out.base[owner], out.sizes[owner]).ravel()
        out.count += np.bincount(at, minlength=out.base[-1]).astype(np.int64)
        np.bitwise_xor.at(out.key, at, np.tile(keys, PARTS))
        np.bitwise_xor.at(out.check, at, np.tile(_check(keys), PARTS))
        return out

    @classmethod
    def of_fingerprints(cls, fingerprints: list[Fingerprint], sizes: np.ndarray) -> Tables:
        """Fingerprints folded to these sizes, none larger than their own."""
        out = cls(sizes)
        for k, f in enumerate(fingerprints):
            of = slice(out.base[k], out.base[k + 1])
            shape = PARTS, len(f.count) // PARTS // int(sizes[k]), int(sizes[k])
            out.count[of] = f.count.reshape(shape).sum(axis=1).ravel()
            out.key[of], out.check[of] = (np.bitwise_xor.reduce(x.reshape(shape), axis=1).ravel() for x in (f.key, f.check))
        return out

    def subtract(self, other: Tables) -> None:
        self.count -= other.count
        self.key ^= other.key
        self.check ^= other.check

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Recovered digests: table, digest, and side (1: the first, -1: the second); and per table whether all cells came out empty."""
        n = len(self.sizes)
        table = np.repeat(np.arange(n), PARTS * self.sizes)
        found = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        # Each pass takes digests from their cells; a digest that checks by chance could come back, so passes are bounded by the cells.
        for _ in range(len(self.count) + 1):
            pure = np.flatnonzero(np.abs(self.count) == 1)
            pure = pure[_check(self.key[pure]) == self.check[pure]]
            if not len(pure):
                break
            of, keys, sign = table[pure], self.key[pure], self.count[pure]
            once = np.unique(np.stack([of.astype(np.uint64), keys]), axis=1, return_index=True)[1]
            of, keys, sign = of[once], keys[once], sign[once]
            at = _places(keys, self.base[of], self.sizes[of]).ravel()
            np.subtract.at(self.count, at, np.tile(sign, PARTS))
            np.bitwise_xor.at(self.key, at, np.tile(keys, PARTS))
            np.bitwise_xor.at(self.check, at, np.tile(_check(keys), PARTS))
            found.append((of, keys, sign))
        stuck = (self.count != 0) | (self.key != 0) | (self.check != 0)
        return *(np.concatenate(x) for x in zip(*found, strict=True)), np.bincount(table, stuck, n) == 0


class Fingerprint:
    """How many digests, and the cells."""

    def __init__(self, n: int, count: np.ndarray, key: np.ndarray, check: np.ndarray):
        self.n, self.count, self.key, self.check = n, count, key, check

    @property
    def size(self) -> int:
        return len(self.count) // PARTS

    def __str__(self) -> str:
        head = np.array([self.n, self.size], "<u4").tobytes()
        return base64.b64encode(head + self.count.astype("<i4").tobytes() + self.key.astype("<u8").tobytes() + self.check.astype("<u4").tobytes()).decode()

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        raw = base64.b64decode(text)
        n, size = np.frombuffer(raw, "<u4", 2).tolist()
        cells = PARTS * size
        parts = np.split(np.frombuffer(raw, np.uint8, offset=8), [4 * cells, 12 * cells])
        return cls(n, parts[0].view("<i4").astype(np.int64), parts[1].view("<u8").astype(np.uint64), parts[2].view("<u4").astype(np.uint32))


def fingerprints(sets: list[np.ndarray]) -> list[Fingerprint]:
    t = Tables.of_sets(sets, np.array([first_size(len(s)) for s in sets], dtype=np.int64))
    cuts = list(zip(t.base[:-1], t.base[1:], strict=True))
    return [Fingerprint(len(s), t.count[a:b], t.key[a:b], t.check[a:b]) for s, (a, b) in zip(sets, cuts, strict=True)]


def difference(left: str, right: str) -> tuple[np.ndarray, np.ndarray] | None:
    """Digests on the first side only, and on the second only, from two fingerprints alone; None where peeling gets stuck, and larger tables are needed."""
    a, b = Fingerprint.read(left), Fingerprint.read(right)
    size = np.array([min(a.size, b.size)])
    t = Tables.of_fingerprints([a], size)
    t.subtract(Tables.of_fingerprints([b], size))
    _, keys, side, done = t.peel()
    return (np.sort(keys[side > 0]), np.sort(keys[side < 0])) if done[0] else None


def likeness(left: list[Fingerprint], right: list[Fingerprint], sets: list[tuple[np.ndarray, np.ndarray]], retries: int = 6) -> np.ndarray:
    """Common digests by all digests of each pair, from what peeling recovers; 1 for two empty ones.

    The fingerprints are subtracted first. Where that gets stuck, tables of the pair's digests are made four times as
    large, up to `retries` times; what is stuck even then is compared digest by digest.
    """
    out = np.ones(len(left))
    size = np.array([min(a.size, b.size) for a, b in zip(left, right, strict=True)], dtype=np.int64)
    n, m = (np.array([f.n for f in side], np.int64) for side in (left, right))
    todo = np.arange(len(left))
    for attempt in range(retries + 1):
        if not len(todo):
            break
        make = (lambda side: Tables.of_fingerprints([(left, right)[side][k] for k in todo], size[todo])) if not attempt else (lambda side: Tables.of_sets([sets[k][side] for k in todo], size[todo]))  # noqa: B023
        tables = make(0)
        tables.subtract(make(1))
        of, _, side, done = tables.peel()
        gained = np.bincount(of, side > 0, len(todo)).astype(np.int64)
        union = m[todo] + gained
        out[todo[done]] = np.where(union > 0, (n[todo] - gained) / np.maximum(union, 1), 1.0)[done]
        todo = todo[~done]
        size[todo] *= 4
    for k in todo:
        both = len(np.intersect1d(*sets[k], assume_unique=True))
        out[k] = both / (n[k] + m[k] - both)
    return out


def edited(text: str, following: str) -> str:
    """The last quarter of the characters replaced by the first as many of the following text, or all of it."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many bounds are at most the key: found among every k-th bound, then among those between."""
    k = max(1, int(len(bounds) ** 0.5))
    coarse, rows = bounds[k - 1 :: k], [bounds[i : i + k - 1] for i in range(0, len(bounds) + 1, k)]

    def at_most(among: Column) -> Column:
        return F.size(F.filter(among, lambda b: b <= key))

    longs = [F.array(*[F.lit(b).cast("long") for b in r]).cast("array<bigint>") for r in rows]
    step = at_most(F.array(*[F.lit(b).cast("long") for b in coarse]).cast("array<bigint>"))
    return (step * k + at_most(F.element_at(F.array(*longs), step + 1))).cast("int")


def with_neighbours(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """b, s, k, i, t dealt so that partition b has the b-th range of ids in order (s = 0) and after it the first row of the next (s = 1).

    Rows without an id come last; rows of one id are in the order of their texts' hashes.
    """
    n = common.partitions(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit((1 << 63) - 1)).alias("k"), F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    bounds = sorted({int(q) for q in rows.approxQuantile("k", [j / n for j in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    rows = rows.withColumn("b", _bucket(F.col("k"), bounds) if bounds else F.lit(0))
    firsts = sorted((r["b"], r["k"]) for r in rows.groupBy("b").agg(F.min("k").alias("k")).collect())  # one row per partition
    following = [(b, firsts[(j + 1) % len(firsts)][1]) for j, (b, _) in enumerate(firsts)]
    ends = docs.sparkSession.createDataFrame(following, "b int, k long")
    after = rows.drop("b").join(F.broadcast(ends), "k").select("k", "i", "t", "b", F.lit(1).alias("s"))  # ends: one row per partition
    return rows.withColumn("s", F.lit(0)).unionByName(after).repartitionById(n, "b").sortWithinPartitions("b", "s", "k", F.xxhash64("t"))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprint_versions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document the fingerprints of its text and of its edited text, and their likeness, and the next document's.

    Null texts count as empty; the one document of a table is its own next; an empty table gives no rows; repeated rows
    are documents of their own. Documents without an id come after all others; those of one id are in the order of their
    texts' hashes. Texts of any length are read whole; other columns are not read.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple] = []  # (bucket, id, text, digests): those whose next is not seen yet are at the end
        closed = None

        def out(upto: list[tuple]) -> pd.DataFrame:
            rows, nexts = upto[:-1], upto[1:]
            texts = [edited(r[2], f[2]) for r, f in zip(rows, nexts, strict=True)]
            own, changed = [r[3] for r in rows], [digests(t) for t in texts]
            frame = pd.DataFrame({"doc_id": pd.array([r[1] for r in rows], dtype="Int64"), "n_chars": [len(r[2]) for r in rows]})
            frame["edited_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
            mine, theirs = fingerprints([r[3] for r in upto]), fingerprints(changed)
            frame["fingerprint"], frame["edited_fingerprint"] = list(map(str, mine[:-1])), list(map(str, theirs))
            frame["near_edited"] = likeness(mine[:-1], theirs, list(zip(own, changed, strict=True)))
            frame["near_next"] = likeness(mine[:-1], mine[1:], list(zip(own, [f[3] for f in nexts], strict=True)))
            return frame

        for batch in batches:
            for b, s, i, t in zip(batch["b"], batch["s"], batch["i"], batch["t"], strict=True):
                if b == closed:
                    continue
                held.append((b, None if pd.isna(i) else int(i), t, digests(t)))
                if s or len(held) > 256:
                    if len(held) > 1:
                        yield out(held)
                    held, closed = ([], b) if s else (held[-1:], None)

    return with_neighbours(docs, id_col, text_col).mapInPandas(work, SCHEMA)


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_versions(common.read(spark, sf_dir, "documents"))
