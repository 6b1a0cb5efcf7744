"""Phrase collocations (operator 11): counts of frequent phrases by minimal perfect hashing, level by level.

Texts are gathered into blocks of a bounded number of words, each kept as a file in the shared folder. At level k a
block's candidates are its phrases of k words whose first k - 1 and last k - 1 words are frequent phrases themselves
(Apriori: no other phrase can be frequent). A candidate's key is exact: the number of the frequent phrase that its first
k - 1 words are, and the number of its last word. Keys are dealt by hash to segments, so many that each has a bounded
number of requests; they are shuffled once. A segment's mapper builds a minimal perfect hash over its distinct candidates,
which keeps the keys; looks the blocks' keys up, compares them with those stored, and bincounts what each share of the
blocks has seen into an array by slot; and sums the arrays in a tree. A slot that reaches the least count is a frequent
phrase; a second perfect hash over these gives numbers, which the blocks that asked are told. What no frequent phrase
covers any more is dropped from their files, so files shrink from level to level. The counts of the parts at each cut
are read by these numbers.

Nothing is anywhere whole: not the phrases, not their counts, not the vocabulary. Words are told apart by 104 bits of
hash; all counts are integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .packed import packed, sorted_packed, sorted_unpacked, store, stored, unpacked
from .perfect_hash import PerfectHash, hashed

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
BLOCK_WORDS = 2_000_000
#: Requests that a segment has on average at most; and blocks whose requests are counted into one array.
SEGMENT_KEYS, SHARE_BLOCKS = 1_000_000, 32
#: Languages whose word counts are broadcast; more are joined by a shuffle.
BROADCAST_LANGS = 10_000
_ROUTE = 1 << 20  # a level of hashes that no perfect hash comes to
#: Lower-cases A-Z, makes ends of pieces line ends and tabs spaces.
_PIECES = bytes(b + 32 if 65 <= b <= 90 else 10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b for b in range(256))


def pieces(text: str | None) -> list[list[bytes]]:
    return [p.split(b" ") for p in text.encode().translate(_PIECES).split(b"\n") if p] if text else []


class _Numbers(dict):
    """Numbers of words in the order in which they come, from 1; 0 is the empty word."""

    def __init__(self, lang: bytes, known: list[bytes]):
        super().__init__({b"": 0})
        self.lang, self.known = lang, known

    def __missing__(self, word: bytes) -> int:
        self.known.append(self.lang + b"\t" + word)
        value = self[word] = len(self.known)
        return value


BLOCKS = "block long, file string, langs array<string>, words array<long>, n_keys long"


def blocks(docs: DataFrame, folder: str, lang_col: str, text_col: str) -> DataFrame:
    """Write whole texts in files of about BLOCK_WORDS words; a row of BLOCKS for each, n_keys being its distinct words."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, no = TaskContext.get().partitionId(), 0
        known, numbers, counts, tokens, size = [], {}, {}, [], 0

        def row() -> pd.DataFrame:
            numbered = np.concatenate(tokens)
            often = np.bincount(numbered, minlength=len(known) + 1)[1:]
            order = np.argsort(-often, kind="stable")
            rank = np.zeros(len(known) + 1, np.uint32)  # frequent words get small numbers, which need little room
            rank[order + 1] = np.arange(1, len(known) + 1)
            words = [known[i] for i in order.tolist()]
            name = store(folder, tokens=packed(rank[numbered]), text=packed(np.frombuffer(b"".join(words), np.uint8)), lengths=packed(np.array([len(w) for w in words], np.uint32)))
            return pd.DataFrame({"block": [(part << 32) + no], "file": [name], "langs": [list(counts)], "words": [list(counts.values())], "n_keys": [len(known)]})

        for batch in batches:
            for lang, t in zip(batch["lang"], batch["t"], strict=True):
                lang = lang if isinstance(lang, str) else UNKNOWN
                if lang not in numbers:
                    numbers[lang], counts[lang] = _Numbers(lang.encode(), known), 0
                number, flat = numbers[lang].__getitem__, []
                for p in pieces(t if isinstance(t, str) else None):
                    flat += map(number, p)
                    flat.append(-1)
                got = np.array(flat, np.int64)
                got = got[got != 0]  # what stands between two spaces
                got[got < 0] = 0
                n = int(np.count_nonzero(got))
                counts[lang] += n
                if n:
                    tokens.append(got)
                    size += n
                if size >= BLOCK_WORDS:
                    yield row()
                    known, numbers, counts, tokens, size, no = [], {}, {}, [], 0, no + 1
        if size:
            yield row()

    return docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("t")).mapInPandas(work, BLOCKS)


def _texts(got: dict[str, bytes]) -> list[bytes]:
    ends = np.cumsum(unpacked(got["lengths"], np.uint32), dtype=np.int64).tolist()
    text = unpacked(got["text"], np.uint8).tobytes()
    return [text[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)] if ends else []


class Asked:
    """A block's distinct candidates of a level in the order of segment and key, how often each is seen, and which of them begins at each of the positions `at`."""

    def __init__(self, hi: np.ndarray, lo: np.ndarray, seen: np.ndarray, at: np.ndarray, which: np.ndarray, segments: int):
        segment = (hashed(hi, lo, _ROUTE) % np.uint64(segments)).astype(np.int64)
        order = np.lexsort((lo, hi, segment))
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.order, self.hi, self.lo, self.seen, self.segment, self.at, self.which = order, hi[order], lo[order], seen[order], segment[order], at, rank[which]


def asked_words(got: dict[str, bytes], segments: int) -> tuple[Asked, list[bytes]]:
    """Level 1: every word, its key the hash of language and word."""
    texts = _texts(got)
    keys = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), np.uint64).reshape(-1, 2) & np.array([(1 << 64) - 1, (1 << 40) - 1], np.uint64)
    tokens = unpacked(got["tokens"], np.uint32).astype(np.int64)
    at = np.flatnonzero(tokens)
    out = Asked(keys[:, 0], keys[:, 1], np.bincount(tokens[at] - 1, minlength=len(texts)), at, tokens[at] - 1, segments)
    return out, [texts[i] for i in out.order]


def _words(got: dict[str, bytes]) -> np.ndarray:
    """The numbers of the words at each place, -1 between stretches; after level 1 they stand as the block's own numbers and a table."""
    return unpacked(got["table"], np.int64)[unpacked(got["word"], np.uint32)] if "table" in got else unpacked(got["word"], np.int64)


def asked_phrases(got: dict[str, bytes], k: int, segments: int) -> Asked:
    """Level k: phrases of which both parts of k - 1 words are frequent."""
    word = _words(got)
    part = unpacked(got["part"], np.int64) if k > 2 else word
    at = np.flatnonzero((part[:-1] >= 0) & (part[1:] >= 0)) if len(part) else np.zeros(0, np.int64)
    parts, of_part = np.unique(part[at], return_inverse=True)
    words, of_word = np.unique(word[at + k - 1], return_inverse=True)
    pair, which, seen = np.unique(of_part * max(1, len(words)) + of_word, return_inverse=True, return_counts=True)
    left, right = np.divmod(pair, max(1, len(words)))
    return Asked(parts[left].astype(np.uint64), words[right].astype(np.uint64), seen, at, which, segments)


REQUESTS = "block long, file string, segment long, hi binary, lo binary, seen binary"


def requests(held: DataFrame, folder: str, k: int, segments: int) -> DataFrame:
    """A row for each block and segment that it has candidates in; a segment's rows are in one partition, one after the other."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for block, name in zip(batch["block"], batch["file"], strict=True):
                got = stored(folder, name)
                a = asked_words(got, segments)[0] if k == 1 else asked_phrases(got, k, segments)
                cut = np.concatenate([[0], np.flatnonzero(np.diff(a.segment)) + 1, [len(a.segment)]]) if len(a.segment) else [0]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    own = {"hi": [sorted_packed(a.hi[x:y])], "lo": [packed(a.lo[x:y])], "seen": [packed(a.seen[x:y].astype(np.uint32))]}
                    yield pd.DataFrame({"block": [block], "file": [name], "segment": [int(a.segment[x])], **own})

    asked = held.select("block", "file").repartition(common.partitions(held.sparkSession)).mapInPandas(work, REQUESTS)
    parts = max(common.partitions(held.sparkSession), -(-segments // 16))  # a task takes its segments one by one
    return asked.repartition(parts, "segment").sortWithinPartitions("segment", "block")


def _by_segment(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of each segment; they stand one after the other."""
    parts: list[pd.DataFrame] = []
    for batch in batches:
        for segment, rows in batch.groupby("segment", sort=False):
            if parts and parts[0]["segment"].iloc[0] != segment:
                yield pd.concat(parts)
                parts = []
            parts.append(rows)
    if parts:
        yield pd.concat(parts)


def _keys(group: pd.DataFrame) -> tuple[list[np.ndarray], list[np.ndarray]]:
    return [sorted_unpacked(b) for b in group["hi"]], [unpacked(b, np.uint64) for b in group["lo"]]


def counted(asked: DataFrame, folder: str, least: int) -> DataFrame:
    """segment: of its candidates, counted by the slots of a perfect hash over all of them, the frequent ones are written to
    a file of its number: a perfect hash over these, whose slots are their numbers, and their counts."""

    def total(arrays: list[np.ndarray]) -> np.ndarray:
        while len(arrays) > 1:
            arrays = [a + b for a, b in zip(arrays[::2], arrays[1::2], strict=False)] + arrays[len(arrays) & ~1 :]
        return arrays[0]

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_segment(batches):
            segment = int(group["segment"].iloc[0])
            hi, lo = _keys(group)
            model = _built(np.concatenate(hi), np.concatenate(lo))
            arrays = []
            for at in range(0, len(group), SHARE_BLOCKS):
                share = slice(at, at + SHARE_BLOCKS)
                slots = model.slots(np.concatenate(hi[share]), np.concatenate(lo[share]))
                if (slots < 0).any():
                    raise ValueError("a candidate is not in its segment's hash")
                arrays.append(np.bincount(slots, np.concatenate([unpacked(b, np.uint32) for b in group["seen"].iloc[share]]), len(model)).astype(np.int64))
            n = total(arrays)
            own = np.flatnonzero(n >= least)
            kept = PerfectHash(model.hi[own], model.lo[own])
            counts = np.zeros(len(own), np.int64)
            counts[kept.slots(model.hi[own], model.lo[own])] = n[own]
            store(folder, str(segment), **kept.dump(), counts=packed(counts))
            yield pd.DataFrame({"segment": [segment]})

    return asked.select("segment", "hi", "lo", "seen").mapInPandas(work, "segment long")


def _built(hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
    """The hash over the distinct keys."""
    order = np.lexsort((lo, hi))
    first = order[np.flatnonzero(np.concatenate([[True], (np.diff(hi[order]) != 0) | (np.diff(lo[order]) != 0)]))]
    return PerfectHash(hi[first], lo[first])


REPLIES = "block long, file string, segment long, numbers binary, tell binary"


def replies(asked: DataFrame, folder: str, segments: int) -> DataFrame:
    """To every request the numbers of its candidates that are frequent phrases (-1 for others), and of which of these the block is the first to ask."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_segment(batches):
            segment = int(group["segment"].iloc[0])
            hi, lo = _keys(group)
            ends = np.cumsum([len(h) for h in hi])[:-1]
            slots = PerfectHash.load(stored(folder, str(segment))).slots(np.concatenate(hi), np.concatenate(lo))
            told_ = np.where(slots >= 0, slots * segments + segment, -1)
            first = np.zeros(len(told_), bool)
            first[np.unique(told_, return_index=True)[1]] = True
            yield pd.DataFrame({
                "block": group["block"].array, "file": group["file"].array, "segment": group["segment"].array,
                "numbers": [packed(n) for n in np.split(told_, ends)], "tell": [packed(f.astype(np.uint8)) for f in np.split(first, ends)],
            })

    return asked.select("block", "file", "segment", "hi", "lo").mapInPandas(work, REPLIES)


TOLD = "block long, file string, n_keys long, numbers array<long>, texts array<binary>"


def told(answers: DataFrame, folder: str, new: str, k: int, segments: int) -> DataFrame:
    """TOLD: the blocks' next files, of what frequent phrases of k words cover; n_keys bounds the candidates to come; at level 1 the frequent words that the block is to tell, and their numbers."""

    def work(group: pd.DataFrame) -> pd.DataFrame:
        got, numbers, texts, group = stored(folder, group["file"].iloc[0]), [], [], group.sort_values("segment")
        told_ = np.concatenate([unpacked(b, np.int64) for b in group["numbers"]])
        if k == 1:
            a, words = asked_words(got, segments)
            own = np.flatnonzero((told_ >= 0) & np.concatenate([unpacked(b, np.uint8) for b in group["tell"]]).astype(bool))
            numbers, texts = told_[own].tolist(), [words[i] for i in own]
            tokens = unpacked(got["tokens"], np.uint32)
            n = len(tokens)
        else:
            a = asked_phrases(got, k, segments)
            word = _words(got)
            n = len(word)
        part = np.full(n, -1)
        part[a.at] = told_[a.which]
        begin = np.flatnonzero(part >= 0)
        step = np.bincount(begin, minlength=n + 1) - np.bincount(begin + k, minlength=n + 1)
        cover = np.cumsum(step)[:n] > 0
        keep = cover | np.concatenate([[False], cover[:-1]])  # one place between two stretches
        part = part[keep]
        left = int(np.count_nonzero((part[:-1] >= 0) & (part[1:] >= 0)))
        if k == 1:
            table = np.full(int(tokens.max(initial=0)) + 1, -1)
            table[tokens[a.at]] = told_[a.which]
            name = store(new, word=packed(np.where(cover, tokens, 0)[keep].astype(np.uint32)), table=packed(table))
        else:
            name = store(new, word=packed(np.where(cover, word, -1)[keep]), part=packed(part))
        return pd.DataFrame({"block": [group["block"].iloc[0]], "file": [name], "n_keys": [left], "numbers": [numbers], "texts": [texts]})

    return answers.repartition(common.partitions(answers.sparkSession), "block").groupBy("block").applyInPandas(work, TOLD)


def frequent(found: DataFrame, folder: str, segments: int) -> DataFrame:
    """number, part, word, a of every frequent phrase: the numbers of its first k - 1 words and of its last, or a word's hash in two parts."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for segment in batch["segment"]:
                got = stored(folder, str(segment))
                model, n = PerfectHash.load(got), unpacked(got["counts"], np.int64)
                yield pd.DataFrame({"number": np.arange(len(n)) * segments + segment, "part": model.hi.astype(np.int64), "word": model.lo.astype(np.int64), "a": n})

    return found.mapInPandas(work, "number long, part long, word long, a long")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, lang_col: str = "lang", text_col: str = "text") -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases of 2, 3, ... longest words, as frequent() has them, after those of one (number, lang, text, a); and lang, n: all words of each language."""
    spark, out = docs.sparkSession, []
    top = common.new_folder(spark, "phrases")
    try:
        held = common.checkpointed(blocks(docs, f"{top}/0", lang_col, text_col))
        n = common.checkpointed(held.select(F.explode(F.arrays_zip("langs", "words")).alias("x")).groupBy(F.col("x.langs").alias("lang")).agg(F.sum("x.words").alias("n")))
        for k in range(1, longest + 1):
            here, model_folder, new = f"{top}/{k - 1}", f"{top}/m{k}", f"{top}/{k}"
            keys = held.agg(F.sum("n_keys")).first()[0] or 0
            segments = max(common.partitions(spark), -(-keys // SEGMENT_KEYS))
            asked = common.checkpointed(requests(held, here, k, segments))
            common.free(spark)
            found = common.checkpointed(counted(asked, model_folder, least))
            level = common.checkpointed(frequent(found, model_folder, segments))
            if k < longest:
                held = common.checkpointed(told(replies(asked, model_folder, segments), here, new, k, segments))
            if k == 1:
                word = F.col("x.texts").cast("string")
                texts = held.select(F.explode(F.arrays_zip("numbers", "texts")).alias("x")).groupBy(F.col("x.numbers").alias("number")).agg(F.first(word).alias("t"))
                level = common.checkpointed(level.join(texts, "number").select("number", F.substring_index("t", "\t", -1).alias("text"), F.expr("substring(t, 1, length(t) - length(substring_index(t, '\t', -1)) - 1)").alias("lang"), "a"))
            out.append(level)
            del asked, found
            common.free(spark)
            common.remove(spark, here)
            common.remove(spark, model_folder)
    finally:
        common.remove(spark, top)
    return out, n


def candidates(levels: list[DataFrame]) -> list[DataFrame]:
    """number, part, word, a, lang, phrase, k, tail, lefts, rights of the phrases of each length: the number of their last
    k - 1 words, and the counts of their first 1, 2, ... and of what is left after these."""
    words = levels[0]
    none = F.array().cast("array<bigint>")
    out = [words.select("number", F.lit(None).cast("long").alias("part"), F.lit(None).cast("long").alias("word"), "a", "lang", F.col("text").alias("phrase"), F.lit(None).cast("long").alias("tail"), none.alias("lefts"), none.alias("rights"))]
    for k, level in enumerate(levels[1:], 2):
        shorter = out[-1]
        first = shorter.select(F.col("number").alias("part"), "lang", F.col("phrase").alias("begin"), F.concat("lefts", F.array("a")).alias("lefts"), F.col("tail").alias("middle"))
        last = words.select(F.col("number").alias("word"), "text")
        tail = shorter.select(F.col("number").alias("tail"), F.concat(F.array("a"), "rights").alias("rights"), *([] if k == 2 else [F.col("part").alias("middle"), "word"]))
        own = level.join(first, "part").join(last, "word")
        own = own.join(tail, F.col("word") == F.col("tail")) if k == 2 else own.join(tail, ["middle", "word"])
        out.append(common.checkpointed(own.select("number", "part", "word", "a", "lang", F.concat_ws(" ", "begin", "text").alias("phrase"), "tail", "lefts", "rights")))
    return out[1:]


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best `top` phrases of each language.

    Nulls: a null text is empty, a null language is `und`. Repeated rows count each time. Equal scores stand by
    descending count, then by the phrase's bytes; equal cuts go to the shortest first part. A very long text is a part
    of one block and read whole. An empty table gives no rows. Other columns, an id too, are not read.
    """
    levels, n = phrases(docs, least, longest, lang_col, text_col)
    found = candidates(levels)
    kept = []
    for own, longer in zip(found, [*found[1:], None], strict=True):
        if longer is not None:  # a phrase that holds one is as frequent as that at most; if any is as frequent, so is one that is a word longer
            inside = longer.select(F.explode(F.array("part", "tail")).alias("number"), F.col("a").alias("inside")).groupBy("number").agg(F.max("inside").alias("inside"))
            own = own.join(inside, "number", "left").filter("inside is null or inside < a").drop("inside")
        kept.append(own)
    every = kept[0]
    for own in kept[1:]:
        every = every.unionByName(own)
    cut = "transform(sequence(1, size(lefts)), i -> named_struct('score', (cast(1000 * a as decimal(19, 0)) * cast(n as decimal(19, 0))) div (cast(lefts[i - 1] as decimal(19, 0)) * cast(rights[i - 1] as decimal(19, 0))), 'k', i, 'l', lefts[i - 1], 'r', rights[i - 1]))"
    few = F.broadcast(n) if n.limit(BROADCAST_LANGS + 1).count() <= BROADCAST_LANGS else n
    scored = every.join(few, "lang").withColumn("cut", F.expr(f"array_min({cut})")).select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score", F.pmod("number", F.lit(common.partitions(docs.sparkSession))).alias("deal"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    first = scored.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).filter(F.col("rank") <= top)
    best = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP11_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents
),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces),
total AS (SELECT lang, sum(len(w)) AS n FROM w GROUP BY lang),
starts AS (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, range(1, 6) AS t(k) WHERE len(w) >= k),
f AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase, count(*) AS a FROM starts GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2),
dropped AS (
  SELECT DISTINCT c.lang, c.phrase FROM c JOIN c AS longer ON longer.lang = c.lang AND longer.k > c.k AND 100 * longer.a >= 100 * c.a AND contains(' ' || longer.phrase || ' ', ' ' || c.phrase || ' ')
),
cuts AS (SELECT lang, phrase, a, j, array_to_string(w[1 : j], ' ') AS first_, array_to_string(w[j + 1 : k], ' ') AS rest FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.a, x.a AS l, y.a AS r, n, j, CAST((1000::HUGEINT * cuts.a * n) // (x.a::HUGEINT * y.a) AS BIGINT) AS score
  FROM cuts JOIN f AS x ON x.lang = cuts.lang AND x.phrase = first_ JOIN f AS y ON y.lang = cuts.lang AND y.phrase = rest JOIN total ON total.lang = cuts.lang
),
least AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM least ANTI JOIN dropped USING (lang, phrase))
SELECT lang, rank, phrase, a, l, r, CAST(n AS BIGINT) AS n, score FROM ranked WHERE rank <= 2000
"""


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(common.read(spark, sf_dir, "documents"))
