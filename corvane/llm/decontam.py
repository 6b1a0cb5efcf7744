"""Benchmark decontamination (operator 1).

Test items form a BM25 inverted index. Every training text is cut into overlapping passages, each passage is a query,
and block-max WAND retrieves all items whose score reaches a share of their own greatest score. A retrieved item is
verified on the 5-word shingles of its question and of its answer (the last sentence) in the whole text.

A passage is traversed only if the summed list bounds of its words, and then the summed block bounds of some range of
items, can reach the threshold: block-max WAND's own tests, made first for all passages of a batch at once. The index is sent to the tasks; a benchmark of more than
`items_at_once` segments is worked off in several passes over the documents, so what is sent is bounded.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .shingles import Words, mix

K1, B = 1.2, 0.75
#: Postings of a block; and how many ranges of items at most the first test tells apart.
BLOCK = 64
RANGES = 512
PASSAGE = 128
SEGMENT = PASSAGE // 2
THRESHOLD = 0.5
OVERLAP = 0.75
#: What is no letter or digit counts as space, in items and texts alike; here for ASCII.
_PLAIN = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(256))


def plain_words(text: str | None) -> list[bytes]:
    """Maximal runs of letters and digits of any script, composed and case-folded."""
    if not text:
        return []
    if text.isascii():
        return text.lower().encode().translate(_PLAIN).split()
    text = unicodedata.normalize("NFC", unicodedata.normalize("NFC", text).casefold())
    for c in set(text):
        if c > "\x7f" and not c.isalnum():
            text = text.replace(c, " ")
    return text.encode().translate(_PLAIN).split()


def word_runs(words: list[bytes], known: Words, size: int = 5) -> np.ndarray:
    """Hashes of the distinct runs of `size` words, or of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64)
    for j in range(n):
        out = mix(out + h[j : len(h) - n + 1 + j])
    return np.unique(out)


def question_and_answer(text: str) -> tuple[str, str]:
    """An item's last sentence is its answer, what stands before it its question; an item of one sentence has no answer."""
    parts = [p for p in re.split(r"(?<=[.!?])\s+|\n+", text) if plain_words(p)]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, "")


class Index:
    """Postings of impacts. A segment's impacts sum to 1 over its own words, so one threshold holds for all."""

    def __init__(self, items: list[tuple[int, str]]):
        known = Words()
        self.items, segments = [], []
        for item_id, text in items:
            words = plain_words(text)
            if not words:
                continue
            q, a = (word_runs(plain_words(t), known) for t in question_and_answer(text))
            for at in range(0, max(1, len(words) - SEGMENT // 2), SEGMENT // 2) if len(words) > SEGMENT else [0]:
                segments.append((len(self.items), words[at : at + SEGMENT]))
            self.items.append((item_id, q, a))
        self.of_segment = np.array([i for i, _ in segments], np.int64)
        counts = []
        found: dict[bytes, list] = defaultdict(list)
        for d, (_, words) in enumerate(segments):
            tf = defaultdict(int)
            for w in words:
                tf[w] += 1
            counts.append(len(words))
            for w, n in tf.items():
                found[w].append((d, n))
        self.words = {w: t for t, w in enumerate(found)}
        mean, n = (sum(counts) / len(counts) if counts else 1.0), len(segments)
        own, raw = np.zeros(n), []
        for w in self.words:
            idf = np.log1p((n - len(found[w]) + 0.5) / (len(found[w]) + 0.5))
            post = [(d, idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * counts[d] / mean))) for d, tf in found[w]]
            raw.append(post)
            for d, x in post:
                own[d] += x
        self.docs = [[d for d, _ in post] for post in raw]
        self.impacts = [[x / own[d] for d, x in post] for post in raw]
        self.block_max = [[max(x[i : i + BLOCK]) for i in range(0, len(x), BLOCK)] for x in self.impacts]
        self.list_max = np.array([max(b) for b in self.block_max] or [0.0])
        # (range of items, bound) of each word one after the other.
        step, wide, each = max(2, -(-n // RANGES)), [], []
        for d, x in zip(self.docs, self.impacts, strict=True):
            most: dict[int, float] = {}
            for e, v in zip(d, x, strict=True):
                most[e // step] = max(v, most.get(e // step, 0.0))
            wide += most.items()
            each.append(len(most))
        self.range_of, self.range_max = np.array([b for b, _ in wide], np.int64), np.array([v for _, v in wide])
        self.ranges_each = np.array(each, np.int64)
        self.ranges_from = np.cumsum(self.ranges_each) - self.ranges_each
        self.ranges = -(-n // step)

    def search(self, terms, threshold: float = THRESHOLD) -> list[tuple[int, float]]:
        """All (segment, score) of at least the threshold: block-max WAND."""
        cursors = [[self.docs[t][0], 0, t] for t in terms]
        out, low = [], threshold - 1e-12
        while cursors:
            cursors.sort()
            bound, pivot = 0.0, -1
            for k, (_, _, t) in enumerate(cursors):
                bound += self.list_max[t]
                if bound >= low:
                    pivot = k
                    break
            if pivot < 0:
                break
            doc = cursors[pivot][0]
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == doc:
                pivot += 1
            # Bounds of the blocks in which the pivot's document would stand.
            bound, until = 0.0, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else 1 << 62
            for c in cursors[: pivot + 1]:
                docs = self.docs[c[2]]
                at = c[1] if c[0] >= doc else bisect_left(docs, doc, c[1])
                if at < len(docs):
                    block = at // BLOCK
                    bound += self.block_max[c[2]][block]
                    last = docs[min(len(docs), (block + 1) * BLOCK) - 1]
                    until = min(until, last + 1)
            if bound >= low and cursors[0][0] == doc:
                score = sum(self.impacts[t][at] for _, at, t in cursors[: pivot + 1])
                if score >= low:
                    out.append((doc, score))
            goal = doc if bound >= low and cursors[0][0] < doc else doc + 1 if bound >= low else max(doc + 1, until)
            kept = []
            for k, c in enumerate(cursors):
                if k <= pivot and c[0] < goal:
                    docs = self.docs[c[2]]
                    c[1] = bisect_left(docs, goal, c[1])
                    if c[1] >= len(docs):
                        continue
                    c[0] = docs[c[1]]
                kept.append(c)
            cursors = kept
        return out

    def candidates(self, texts: list[list[bytes]]) -> list[dict[int, float]]:
        """Per text: item and its best passage's score."""
        out: list[dict[int, float]] = [{} for _ in texts]
        if not self.items:
            return out
        ids = [np.fromiter(map(self.words.get, w, repeat(-1)), np.int32, len(w)) for w in texts]
        strides = np.array([max(1, -(-len(w) // SEGMENT) - 1) for w in texts])
        first = np.concatenate([[0], np.cumsum(strides)])
        keys = []
        for k, x in enumerate(ids):
            at = np.flatnonzero(x >= 0)
            step, word = at // SEGMENT, x[at].astype(np.int64)
            for back in (0, 1):
                p = step - back
                ok = (p >= 0) & (p < strides[k])
                keys.append((first[k] + p[ok]) * len(self.list_max) + word[ok])
        key = np.unique(np.concatenate(keys))
        passage, word = np.divmod(key, len(self.list_max))
        reach = np.bincount(passage, self.list_max[word], first[-1])[passage] >= THRESHOLD - 1e-9
        passage, word = passage[reach], word[reach]
        each = self.ranges_each[word]
        nth = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + np.repeat(self.ranges_from[word], each)
        bound = np.bincount(np.repeat(passage, each) * self.ranges + self.range_of[nth], self.range_max[nth])
        for p in np.unique(np.flatnonzero(bound >= THRESHOLD - 1e-9) // self.ranges):
            k = int(np.searchsorted(first, p, side="right")) - 1
            at = (p - first[k]) * SEGMENT
            passage = ids[k][at : at + PASSAGE]
            for segment, score in self.search(np.unique(passage[passage >= 0]).tolist()):
                item = int(self.of_segment[segment])
                out[k][item] = max(score, out[k].get(item, 0.0))
        return out

    def leaks(self, texts: list[str | None], known: Words) -> list[list[tuple[int, float, float, float | None]]]:
        """Per text the verified items: (item_id, score, question overlap, answer overlap or None)."""
        out = []
        for at in range(0, len(texts), 256):
            words = [plain_words(t) for t in texts[at : at + 256]]
            out += self._verified(words, self.candidates(words), known)
        return out

    def _verified(self, texts: list[list[bytes]], found_in: list[dict[int, float]], known: Words) -> list:
        out = []
        for w, found in zip(texts, found_in, strict=True):
            rows = []
            own = word_runs(w, known) if found else None
            for item, score in sorted(found.items()):
                item_id, q, a = self.items[item]
                hit_q, hit_a = _contained(q, w, own, known), _contained(a, w, own, known)
                if hit_q >= OVERLAP * len(q) and hit_a >= OVERLAP * len(a):
                    rows.append((item_id, score, hit_q / len(q), hit_a / len(a) if len(a) else None))
            out.append(rows)
        return out


def _contained(runs: np.ndarray, words: list[bytes], whole: np.ndarray, known: Words) -> int:
    """How many of a part's runs are in the text; a part of fewer than five words is one shorter run."""
    hit = len(np.intersect1d(runs, whole, assume_unique=True))
    if len(runs) == 1 and not hit:
        hit = int(any(np.isin(runs, word_runs(words, known, n)).any() for n in range(1, 5)))
    return hit


def indexes(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", items_at_once: int = 20_000) -> Iterator[Index]:
    """Indexes of all items, each of a bounded number of them.

    Items without words, or with a null text, match nothing; a null id is an id; repeated items are items of their own;
    an empty benchmark has no index; a very long item is many segments; other columns are not read.
    """
    items = benchmark.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).filter("t is not null")
    shards = -(-items.count() // items_at_once)
    for s in range(shards):
        part = items if shards == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(shards)) == s)
        yield Index(sorted((tuple(r) for r in part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1])))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", items_at_once: int = 20_000) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every verified pair.

    Null and empty texts have none; every row of a repeated document or item counts; empty tables give no rows; texts of
    any length are read whole, passage by passage; scores that equal the threshold count; other columns are not read.
    """
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double"
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, items_at_once=items_at_once):

        def work(batches: Iterator[pd.DataFrame], index: Index = index) -> Iterator[pd.DataFrame]:
            known = Words()
            for batch in batches:
                got = index.leaks([t if isinstance(t, str) else None for t in batch["t"]], known)
                rows = [(None if pd.isna(i) else int(i), *r) for i, found in zip(batch["i"], got, strict=True) for r in found]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "score", "question_overlap", "answer_overlap"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64", "score": float, "question_overlap": float, "answer_overlap": float})

        out = out.unionByName(docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(work, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", items_at_once: int = 20_000) -> DataFrame:
    """The rows of docs, with all their columns, in which no item is verified.

    Rows with a null or empty text stay; repeated rows stay or go alike; with an empty benchmark all stay, of an empty
    table none; columns of any name stay as they are; texts of any length are read whole.
    """
    at = docs.columns.index(text_col)
    for index in indexes(benchmark, items_at_once=items_at_once):

        def work(batches, index: Index = index):
            import pyarrow as pa

            known = Words()
            for batch in batches:
                keep = [not found for found in index.leaks(batch.column(at).to_pylist(), known)]
                yield batch.filter(pa.array(keep, pa.bool_()))

        docs = docs.mapInArrow(work, docs.schema)
    return docs


def op1_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
