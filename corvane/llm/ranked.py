"""Ranked lexical search (operator 12): Fagin's threshold algorithm over impact-sorted lists and a forward index.

Documents are gathered into blocks, each a file in the shared folder that holds a forward index: the query terms of each
document and how often they occur. Counts over all documents give weights and impacts. A block's postings, sorted by
impact, are then read list by list in turn; each document that comes up for the first time is looked up in the forward
index for its whole score; and a query is done with the block once the threshold, what a document not yet seen could
still reach, falls strictly below the k-th score, so no tie is lost. A task carries its k-th scores from block to block.

Queries are a stated set; they are sent to the tasks in batches of a bounded number and length, each with a pass over
the documents, so neither their number nor that of their terms is limited.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packed import packed, store, stored, unpacked

TOP = 50
BLOCK_TERMS = 4_000_000
QUERIES_AT_ONCE, BYTES_AT_ONCE = 20_000, 16 << 20
#: Depth of the lists that is read at first; it doubles from round to round.
DEPTH = 32
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))


def terms(text: str | None) -> list[bytes]:
    """Maximal runs of ASCII letters and digits and all beyond ASCII; only A-Z are lower-cased."""
    return text.encode().translate(_LOWER).split(b" ") if text else []


class Queries:
    """A batch: distinct terms, and of each query its number, its id and its terms' numbers."""

    def __init__(self, rows: list[tuple[int, int | None, str | None]]):
        self.words: dict[bytes, int] = {}
        self.each = []
        for number, item_id, text in rows:
            own = {self.words.setdefault(w, len(self.words)) for w in terms(text) if w}
            self.each.append((number, item_id, np.array(sorted(own), np.int64)))


def batches(queries: DataFrame, id_col: str, text_col: str) -> Iterator[Queries]:
    """All queries, numbered, in batches of a bounded number of rows and bytes."""
    rows = queries.select(F.monotonically_increasing_id().alias("q"), F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t"))
    rows = common.checkpointed(rows)
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()
    parts = max(-(-n // QUERIES_AT_ONCE), -(-size // BYTES_AT_ONCE))
    for p in range(parts):
        yield Queries([tuple(r) for r in (rows if parts == 1 else rows.filter(F.pmod(F.xxhash64("q"), F.lit(parts)) == p)).collect()])


BLOCKS = "file string, n_docs long, n_terms long, terms array<int>, df array<long>"


def blocks(docs: DataFrame, words: dict[bytes, int], folder: str, id_col: str, text_col: str) -> DataFrame:
    """Forward indexes of about BLOCK_TERMS terms, as files; a row of BLOCKS for each, with its share of all counts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, hits, size = [], [], [], 0

        def row() -> pd.DataFrame:
            n = np.array(lengths, np.int64)
            doc = np.repeat(np.arange(len(n)), [len(h) for h in hits])
            key, tf = np.unique(doc * len(words) + np.concatenate(hits), return_counts=True) if len(words) else (np.zeros(0, np.int64),) * 2
            doc, term = np.divmod(key, max(1, len(words)))
            known = np.array([[i is not None, i or 0] for i in ids], np.int64)
            name = store(folder, ids=known.tobytes(), lengths=packed(n), each=packed(np.bincount(doc, minlength=len(n)).astype(np.uint32)), term=packed(term.astype(np.uint32)), tf=packed(tf.astype(np.uint32)))
            df = np.bincount(term, minlength=len(words))
            some = np.flatnonzero(df)
            return pd.DataFrame({"file": [name], "n_docs": [int((n > 0).sum())], "n_terms": [int(n.sum())], "terms": [some.tolist()], "df": [df[some].tolist()]})

        for batch in batches:
            for i, t in zip(batch["i"], batch["t"], strict=True):
                got = [w for w in terms(t if isinstance(t, str) else None) if w]
                own = np.array([k for k in map(words.get, got) if k is not None], np.int64)
                ids.append(None if pd.isna(i) else int(i))
                lengths.append(len(got))
                hits.append(own)
                size += len(got) + 1
                if size >= BLOCK_TERMS:
                    yield row()
                    ids, lengths, hits, size = [], [], [], 0
        if ids:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(work, BLOCKS)


class Block:
    """A block's forward index, and its lists: the postings by term, greatest impact first."""

    def __init__(self, got: dict[str, bytes], n_docs: int, n_terms: int, n_words: int):
        ids = np.frombuffer(got["ids"], np.int64).reshape(-1, 2)
        self.none, self.ids = ids[:, 0] == 0, ids[:, 1]
        each, self.term, tf = unpacked(got["each"], np.uint32).astype(np.int64), unpacked(got["term"], np.uint32).astype(np.int64), unpacked(got["tf"], np.uint32).astype(np.int64)
        n, of = np.unique(unpacked(got["lengths"], np.int64), return_inverse=True)
        m = np.array([50 + 50 * int(x) * n_docs // max(1, n_terms) for x in n], np.int64)[of]
        self.doc = np.repeat(np.arange(len(each)), each)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc])
        self.until = np.cumsum(each)
        self.each = each
        order = np.lexsort((-self.impact, self.term))
        self.list_doc, self.list_impact = self.doc[order], self.impact[order]
        self.list_from = np.searchsorted(self.term[order], np.arange(n_words + 1))

    def scores(self, docs: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Whole scores of documents, by their entries in the forward index."""
        each = self.each[docs]
        at = np.arange(each.sum()) + np.repeat(self.until[docs] - np.cumsum(each), each)
        return np.add.reduceat(weights[self.term[at]] * self.impact[at], np.cumsum(each) - each)


class Best:
    """The k greatest scores above 0 so far; equal ones by ascending id, no id last."""

    def __init__(self, k: int):
        self.k, self.score, self.none, self.id = k, np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a score must reach to come in."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, none: np.ndarray, ids: np.ndarray) -> None:
        come = score >= self.least
        score, none, ids = np.concatenate([self.score, score[come]]), np.concatenate([self.none, none[come]]), np.concatenate([self.id, ids[come]])
        order = np.lexsort((ids, none, -score))[: self.k]
        self.score, self.none, self.id = score[order], none[order], ids[order]


def threshold(block: Block, own: np.ndarray, weights: np.ndarray, best: Best) -> int:
    """The threshold algorithm for one query in one block; best has what is known before, and gets what is found. Returns how many documents were looked up."""
    own = own[(weights[own] > 0) & (block.list_from[own + 1] > block.list_from[own])]
    begin, end, w = block.list_from[own], block.list_from[own + 1], weights[own]
    masked = np.zeros(len(weights), np.int64)
    masked[own] = w
    seen, depth, until, looked = np.zeros(len(block.ids), bool), 0, DEPTH, 0
    while len(own):
        come = np.concatenate([block.list_doc[a:b] for a, b in zip(np.minimum(begin + depth, end), np.minimum(begin + until, end), strict=True)])
        come = np.unique(come[~seen[come]])
        if len(come):
            seen[come] = True
            looked += len(come)
            best.add(block.scores(come, masked), block.none[come], block.ids[come])
        open_ = begin + until < end
        limit = int((w[open_] * block.list_impact[(begin + until)[open_] - 1]).sum())
        if limit < best.least:
            break
        depth, until = until, 2 * until
    return looked


FOUND = "q long, item_id long, doc_id long, score long"


def search(docs: DataFrame, queries: DataFrame, k: int = TOP, id_col: str = "doc_id", text_col: str = "text", query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score of the k best documents of every query, by score and then ascending id.

    Nulls: a null text has no terms, so such documents are found by nothing and such queries find nothing; a null id is
    kept, and stands last among equal scores. Every row is a document, and a query, of its own: repeated ones repeat, and
    which of rows alike in id and score stands first doesn't show. A very long text is read whole. Empty tables give no
    rows. Other columns are not read.
    """
    spark = docs.sparkSession
    found = spark.createDataFrame([], FOUND + ", part int")
    for batch in batches(queries, query_id, query_text):
        folder = common.new_folder(spark, "search")
        try:
            found = found.unionByName(_found(docs, batch, k, folder, id_col, text_col))
        finally:
            common.remove(spark, folder)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    few = found.withColumn("part", F.col("part") % 16).withColumn("rank", F.row_number().over(Window.partitionBy("q", "part").orderBy(*order))).filter(F.col("rank") <= k)
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order))).filter(F.col("rank") <= k)
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _found(docs: DataFrame, batch: Queries, k: int, folder: str, id_col: str, text_col: str) -> DataFrame:
    """FOUND and part: the k best of every query in each partition of blocks."""
    spark = docs.sparkSession
    held = common.checkpointed(blocks(docs, batch.words, folder, id_col, text_col))
    n_docs, n_terms = (int(x or 0) for x in held.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    df = np.zeros(len(batch.words), np.int64)
    for t, n in held.select(F.explode(F.arrays_zip("terms", "df")).alias("x")).groupBy("x.terms").agg(F.sum("x.df")).collect():  # at most a row for each term of the batch
        df[t] = n
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    each = batch.each

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        best = [Best(k) for _ in each]
        for part in batches:
            for name in part["file"]:
                block = Block(stored(folder, name), n_docs, n_terms, len(weights))
                for (_, _, own), b in zip(each, best, strict=True):
                    threshold(block, own, weights, b)
        for (q, item_id, _), b in zip(each, best, strict=True):
            if len(b.score):
                ids = pd.arrays.IntegerArray(b.id.copy(), b.none.copy())
                yield pd.DataFrame({"q": q, "item_id": pd.array([item_id] * len(b.score), "Int64"), "doc_id": ids, "score": b.score, "part": TaskContext.get().partitionId()})

    return common.checkpointed(held.select("file").repartition(common.partitions(spark)).mapInPandas(work, FOUND + ", part int"))


OP12_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS a FROM documents
),
whole AS (SELECT count(*) FILTER (len(a) > 0) AS n_docs, sum(len(a)) AS n_terms FROM d),
q AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')) AS term FROM benchmark
),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(a) AS n, unnest(a) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), whole),
scored AS (
  SELECT q.item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + CAST((50 * n * n_docs) // n_terms AS BIGINT))))) AS BIGINT) AS score
  FROM tf JOIN w USING (term) JOIN q USING (term) CROSS JOIN whole GROUP BY ALL
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
