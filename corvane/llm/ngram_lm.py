"""Language-model scores by a weighted backoff automaton (operator 4).

The model is an n-gram model with Dirichlet-smoothed backoff: p(w | h) = (c(hw) + mu p(w | h')) / (c(h) + mu), h' being h
without its first word. Contexts are states: every training word, and every longer n-gram that was seen at least
`least` times, by default once (above that, a context seen less often backs off at once). A seen n-gram is an arc from the state of its context with
its smoothed weight; a state's failure arc costs log10(mu / (c(h) + mu)) and leads to the state of h'. Texts are walked
from left to right: the state is carried, failure arcs are followed until an arc of the next word is found, and the
weights add up.

The model grows with the corpus and is nowhere in one place. Texts are gathered into blocks of a bounded number of
tokens, each kept as a file in the shared folder. Order by order a block asks for its own distinct n-grams whose context
is a state; the keys are (number of the state, number of the word), so they are exact, and are permuted and dealt by
range: one number of up to 64 bits where that tells all pairs apart, else two. A bucket adds up the training counts of all blocks, numbers its states, and answers. A block then has the part
of the automaton that its texts can reach, and walks it. Requests and answers are sorted keys and counts in packed
columns, one row per block and bucket; the number of buckets follows from the keys counted, so that a bucket is bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .packed import packed, sorted_packed, sorted_unpacked, store, stored, unpacked
from .shingles import Words, mix, words

BLOCK_TOKENS = 1_000_000
BUCKET_KEYS = 2_000_000
#: How often an n-gram of two or more words must be seen to be a state of its own.
LEAST = 1
#: Bits of a key of one number; pairs that need more are keys of two.
NARROW = 64
#: Tokens that are walked in one lane; longer texts are cut, the words before a cut leading to its state.
LANE = 1024
#: Words that are hashed at once, but for longer texts; every distinct one of them is looked up once.
STRETCH = 1 << 18
_END = np.uint64(0x5851F42D4C957F2D)
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def scramble(codes: np.ndarray, width: int) -> np.ndarray:
    """A permutation of the numbers of `width` bits, so that ranges of the result are even."""
    mask, x = np.uint64((1 << width) - 1), codes.astype(np.uint64)
    for odd in _ODD:
        x = (x * np.uint64(odd)) & mask
        x ^= x >> np.uint64(max(1, width // 2))
    return x


def keyed(states: np.ndarray, words: np.ndarray, base: int, width: int, narrow: int = NARROW) -> list[np.ndarray]:
    """The keys of pairs, even in the highest bits of the first column; an exact permutation of the pairs either way."""
    states, words = states.astype(np.uint64), words.astype(np.uint64)
    return [scramble(states * np.uint64(base) + words, width)] if width <= narrow else [mix(states + mix(words)), words]


def ordered(keys: list[np.ndarray]) -> np.ndarray:
    return np.argsort(keys[0], kind="stable") if len(keys) == 1 else np.lexsort(keys[::-1])


def distinct(keys: list[np.ndarray]) -> tuple[int, np.ndarray]:
    """How many different keys, and the number of each in their order."""
    if len(keys) == 1:
        own, where = np.unique(keys[0], return_inverse=True)
        return len(own), where
    order, where = ordered(keys), np.zeros(len(keys[0]), np.int64)
    new = np.any([np.diff(k[order], prepend=k[order][:1]) != 0 for k in keys], axis=0)
    where[order] = np.cumsum(new)
    return int(new.sum()) + (len(order) > 0), where


def hashed(tokens: list[bytes | None], known: Words) -> np.ndarray:
    """Hashes of words; None is an end."""
    coded = pa.array(tokens, pa.large_binary()).dictionary_encode()
    own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    return np.fromiter([*map(known.__getitem__, own), _END], np.uint64, len(own) + 1)[coded.indices.fill_null(len(own)).to_numpy(zero_copy_only=False)]


def n_distinct(numbers: np.ndarray) -> int:
    numbers = np.sort(numbers)
    return int(np.count_nonzero(numbers[1:] != numbers[:-1])) + (len(numbers) > 0)


BLOCKS = "block long, files string, n_train_docs long, n_train long, n_tokens long, n_words long, n_pairs long"


def blocks(docs: DataFrame, folder: str, id_col: str, text_col: str, fold: int) -> DataFrame:
    """Write whole texts in files of about BLOCK_TOKENS tokens; a row of BLOCKS for each.

    The vocabulary of a block is sorted by the words' hashes; its tokens are numbers by descending frequency.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        known, part, no = Words(), TaskContext.get().partitionId(), 0
        ids, train, lengths, hashes, held, size = [], [], [], [], [], 0

        def row() -> pd.DataFrame:
            nonlocal ids, train, lengths, hashes, held, size, no
            hashes.append(hashed(held, known))
            vocabulary, tokens, often = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
            n, t = np.array(lengths, np.uint32), np.array(train, bool)
            rank = np.empty(len(vocabulary), np.uint32)
            rank[np.argsort(-often, kind="stable")] = np.arange(len(vocabulary))
            name = store(
                folder, vocabulary=sorted_packed(vocabulary), often=packed(often.astype(np.uint32)), tokens=packed(rank[tokens]), lengths=packed(n), train=t.tobytes(),
                ids=np.array([[i is not None, i or 0] for i in ids], np.int64).tobytes(),
            )
            pairs = n_distinct(tokens[:-1] * len(vocabulary) + tokens[1:]) + len(n)
            frame = pd.DataFrame([((part << 32) + no, name, int(t.sum()), int(n[t].sum()), len(tokens), len(vocabulary), pairs)], columns=[c.split()[0] for c in BLOCKS.split(", ")])
            ids, train, lengths, hashes, held, size, no = [], [], [], [], [], 0, no + 1
            return frame

        for batch in batches:
            for i, t in zip(batch["i"], batch["t"], strict=True):
                i, w = None if pd.isna(i) else int(i), words(t if isinstance(t, str) else None)
                ids.append(i)
                train.append(i is None or zlib.crc32(str(i).encode()) % 10 != fold)
                lengths.append(len(w) + 1)
                held += w
                held.append(None)
                if len(held) >= STRETCH:
                    hashes.append(hashed(held, known))
                    held = []
                size += len(w) + 1
                if size >= BLOCK_TOKENS:
                    yield row()
        if size:
            yield row()

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(work, BLOCKS)


class Level:
    """The n-grams of one order in a block, in the order of their keys: how often each is seen in the block's training
    texts, the number of the one that ends at each position (-1: none), and at one position of each its place."""

    def __init__(self, keys: list[np.ndarray], seen: np.ndarray, mine: np.ndarray):
        self.keys, self.seen, self.mine = keys, seen, mine
        self.place = np.zeros(len(seen), np.int64)
        self.place[mine[mine >= 0]] = np.flatnonzero(mine >= 0)
        #: From the answers: training counts in the whole corpus, and numbers of those that are states (-1: no state).
        self.total = self.state = None


class Block:
    """A block's texts, and its n-grams order by order as answers come."""

    def __init__(self, stored: dict[str, bytes]):
        often = unpacked(stored["often"], np.uint32)
        of_rank = np.argsort(-often.astype(np.int64), kind="stable")
        self.tokens = of_rank[unpacked(stored["tokens"], np.uint32)]
        self.lengths = unpacked(stored["lengths"], np.uint32).astype(np.int64)
        self.train = np.frombuffer(stored["train"], bool)
        self.ids = np.frombuffer(stored["ids"], np.int64).reshape(-1, 2)
        self.learn = np.repeat(self.train, self.lengths)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.starts] = True
        vocabulary = sorted_unpacked(stored["vocabulary"])
        self.levels = [Level([vocabulary], np.bincount(self.tokens, self.learn, len(vocabulary)).astype(np.int64), self.tokens)]

    def answered(self, total: np.ndarray, state: np.ndarray) -> None:
        self.levels[-1].total, self.levels[-1].state = total, state

    def extend(self, base: int, width: int, narrow: int) -> Level:
        """The next order: n-grams of training words whose context is a state. The start of a text is the last word but one, `base` - 1."""
        word, last = self.levels[0], self.levels[-1]
        state, n_last = last.state, len(last.seen)
        before = np.concatenate([[-1], last.mine[:-1]])
        context = np.where(self.first, n_last if len(self.levels) == 1 else -1, before)
        states = np.concatenate([state, [base - 1, -1]])  # of the start, and of none
        at = np.flatnonzero((states[context] >= 0) & (word.total[self.tokens] > 0))
        v = len(word.seen)
        pairs, inverse = np.unique(context[at] * v + self.tokens[at], return_inverse=True)
        left, right = np.divmod(pairs, v)
        keys = keyed(states[left], word.state[right], base, width, narrow)
        order = ordered(keys)
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order))
        mine = np.full(len(self.tokens), -1)
        mine[at] = number[inverse]
        self.levels.append(Level([k[order] for k in keys], np.bincount(mine[at], self.learn[at], len(order)).astype(np.int64), mine))
        return self.levels[-1]


def _requests(block: int, files: str, level: Level, width: int, bits: int) -> pd.DataFrame:
    """One row for each bucket, a range of the keys, that has any; at least one row."""
    first = level.keys[0]
    bucket = (first >> np.uint64(min(width, 64) - bits if len(level.keys) == 1 else 64 - bits)).astype(np.int64) if bits else np.zeros(len(first), np.int64)
    at = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else np.array([0, 0])
    some = bucket[at[:-1]] if len(bucket) else np.array([block % (1 << bits)])
    cut = list(zip(at[:-1], at[1:], strict=True))
    return pd.DataFrame({
        "block": block, "files": files, "bucket": some, "keys": [sorted_packed(first[a:b]) for a, b in cut], "more": [packed(level.keys[1][a:b]) if len(level.keys) > 1 else b"" for a, b in cut], "seen": [packed(level.seen[a:b].astype(np.uint32)) for a, b in cut],
    })


REQUESTS = "block long, files string, bucket long, keys binary, more binary, seen binary"
ANSWERS = "block long, files string, bucket long, totals binary, states binary, types long, n_states long"


def _answers(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of one bucket: training counts of all keys of each block, and the numbers, within the bucket, of those that are states."""

    def answer(group: pd.DataFrame) -> pd.DataFrame:
        parts = [sorted_unpacked(k) for k in group["keys"]]
        more = [unpacked(m, np.uint64) for m in group["more"] if m]
        n, where = distinct([np.concatenate(parts), *([np.concatenate(more)] if more else [])])
        total = np.bincount(where, np.concatenate([unpacked(s, np.uint32) for s in group["seen"]]), n).astype(np.int64)
        is_state = total >= least
        number = np.cumsum(is_state) - 1
        ends = np.cumsum([len(p) for p in parts])
        mine = [where[e - len(p) : e] for p, e in zip(parts, ends, strict=True)]
        types, n_states = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        types[0], n_states[0] = np.count_nonzero(total), is_state.sum()
        return pd.DataFrame({
            "block": group["block"].array, "files": group["files"].array, "bucket": group["bucket"].array, "totals": [packed(total[m].astype(np.uint64)) for m in mine],
            "states": [sorted_packed(number[m][is_state[m]]) for m in mine], "types": types, "n_states": n_states,
        })

    return answer


def _states_packed(state: np.ndarray, bits: int) -> bytes:
    """Numbers of states in the order of keys: by bucket, and within it by number, they only rise."""
    own = state[state >= 0]
    return sorted_packed(((own & ((1 << bits) - 1)) << 44) + (own >> bits))


def _states_unpacked(b: bytes, is_state: np.ndarray, bits: int) -> np.ndarray:
    own, out = sorted_unpacked(b).astype(np.int64), np.full(len(is_state), -1)
    out[is_state] = ((own & ((1 << 44) - 1)) << bits) + (own >> 44)
    return out


def _read_answers(own: pd.DataFrame, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and numbers of states of a block's n-grams, in the order of their keys. A state's number is that in its bucket times the buckets, plus the bucket."""
    totals, states = [], []
    for _, row in own.sort_values("bucket").iterrows():
        total = unpacked(row["totals"], np.uint64).astype(np.int64)
        state = np.full(len(total), -1)
        state[total >= least] = (sorted_unpacked(row["states"]).astype(np.int64) << bits) + row["bucket"]
        totals.append(total)
        states.append(state)
    return np.concatenate(totals), np.concatenate(states)


def automaton(block: Block, n_docs: int, n_tokens: int, n_types: int, mu: float) -> dict[str, np.ndarray]:
    """States and arcs that the block's texts can reach.

    State 0 is the root, then the words and the start of a text, then longer n-grams. Per state: depth (words of
    context), failure state and weight. Per arc: weight and target. arc[k]: the arc of each position from the state of
    the k words before it, -1 where there is none.
    """
    order = len(block.levels)
    sizes = [len(x.seen) for x in block.levels]
    offset = np.cumsum([0, 1, sizes[0] + 1, *sizes[1:]])  # states of depth k begin at offset[k]
    n_states = offset[order]
    depth, fail, fail_weight = np.zeros(n_states, np.int64), np.zeros(n_states, np.int64), np.zeros(n_states)
    weights, targets, arcs, first_arc = [], [], [], 0
    weight = target = None
    for k, level in enumerate(block.levels, 1):
        if k == 1:
            weight = np.log10((level.total + 0.1) / (n_tokens + 0.1 * (n_types + 1)))
            target = np.where((level.total > 0) & (order > 1), 1 + np.arange(sizes[0]), 0)
        else:
            lower = block.levels[k - 2].mine[level.place]
            before = block.levels[k - 2]
            counts = np.append(before.total, n_docs) if k == 2 else before.total
            context = np.where(block.first[level.place], len(before.seen), before.mine[level.place - 1]) if k == 2 else before.mine[level.place - 1]
            weight = np.log10((level.total + mu * 10.0 ** weight[lower]) / (counts[context] + mu))
            target = target[lower]
            if k < order:
                target = np.where(level.state >= 0, offset[k] + np.arange(sizes[k - 1]), target)
        if k < order:
            of = slice(offset[k], offset[k] + sizes[k - 1])
            depth[of] = k
            fail_weight[of] = np.log10(mu / (level.total + mu))
            if k > 1:
                fail[of] = offset[k - 1] + lower
        arcs.append(np.where((level.mine >= 0) & ((k == 1) | (level.total[level.mine] > 0) if sizes[k - 1] else False), first_arc + level.mine, -1))
        first_arc += sizes[k - 1]
        weights.append(weight)
        targets.append(target)
    start = sizes[0] + 1
    if order > 1:
        depth[start], fail_weight[start] = 1, np.log10(mu / (n_docs + mu))
    return {"depth": depth, "fail": fail, "fail_weight": fail_weight, "weight": np.concatenate(weights), "target": np.concatenate(targets), "arc": np.stack(arcs), "start": np.array(start if order > 1 else 0)}


def traverse(block: Block, machine: dict[str, np.ndarray]) -> np.ndarray:
    """log10 weight of each token: all lanes are walked from left to right at once, each carrying its state."""
    depth, fail, fail_weight, weight, target, arc = (machine[k] for k in ("depth", "fail", "fail_weight", "weight", "target", "arc"))
    lead = len(arc) - 1
    cuts = [np.arange(a, a + n, LANE) for a, n in zip(block.starts, block.lengths, strict=True)]
    begin = np.concatenate(cuts)
    until = np.concatenate([np.append(c[1:], a + n) for c, a, n in zip(cuts, block.starts, block.lengths, strict=True)])
    at = np.where(block.first[begin], begin, begin - lead)
    state = np.where(block.first[begin], machine["start"], 0)
    longest = np.argsort(at - until, kind="stable")
    begin, until, at, state = begin[longest], until[longest], at[longest], state[longest]
    out, steps = np.zeros(len(block.tokens)), until - at
    for step in range(int(steps[0])):
        live = int(np.searchsorted(-steps, -step, side="left"))  # lanes are sorted by their steps, the longest first
        where, s = at[:live] + step, state[:live]
        cost, a = np.zeros(live), arc[depth[s], where]
        while len(missing := np.flatnonzero(a < 0)):
            cost[missing] += fail_weight[s[missing]]
            s[missing] = fail[s[missing]]
            a[missing] = arc[depth[s[missing]], where[missing]]
        state[:live] = target[a]
        counted = where >= begin[:live]
        out[where[counted]] = (cost + weight[a])[counted]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def lm_scores(docs: DataFrame, order: int = 3, mu: float = 2.0, least: int = LEAST, fold: int = 0, id_col: str = "doc_id", text_col: str = "text", narrow: int = NARROW) -> DataFrame:
    """SCORES of every row. Null text: only the end token. Rows without an id are learned from. Repeated rows count each
    time; ties cannot occur. A very long text is a block of its own. An empty table gives no rows; with no training text
    at all every token is unknown. Other columns are not read."""
    folder = common.new_folder(docs.sparkSession, "lm")
    try:
        return _scored(docs, folder, order, mu, least, fold, id_col, text_col, narrow)
    finally:
        common.remove(docs.sparkSession, folder)


def _scored(docs: DataFrame, folder: str, order: int, mu: float, least: int, fold: int, id_col: str, text_col: str, narrow: int) -> DataFrame:
    spark = docs.sparkSession
    held = common.checkpointed(blocks(docs, folder, id_col, text_col, fold))
    whole = held.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_train_docs", "n_train", "n_tokens", "n_words", "n_pairs")]).first()
    if not whole["n_tokens"]:
        return spark.createDataFrame([], SCORES)
    n_docs, n_train = int(whole["n_train_docs"]), int(whole["n_train"])
    leasts = [1] + [least] * (order - 2) + [1 << 62] * (order > 1)  # n-grams of the last order are arcs only
    bits = [max(int(np.ceil(np.log2(max(1, whole[c] / BUCKET_KEYS)))), int(np.ceil(np.log2(common.partitions(spark))))) for c in ["n_words", "n_pairs", *["n_tokens"] * order][:order]]

    def ask_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, i in zip(batch["files"], batch["block"], strict=True):
                yield _requests(i, name, Block(stored(folder, name)).levels[0], 64, bits[0])

    def answered(asked: DataFrame, k: int) -> tuple[DataFrame, int, int]:
        """The answers, how many n-grams training texts have, and above which number no state is: the most states of a bucket, times the buckets."""
        out = common.checkpointed(asked.groupBy("bucket").applyInPandas(_answers(leasts[k - 1]), ANSWERS))
        common.free(spark)
        sums = out.agg(F.sum("types").alias("types"), F.max("n_states").alias("most")).first()
        return out, int(sums["types"] or 0), int(sums["most"] or 0) << bits[k - 1]

    replies, n_types, bound = answered(held.select("block", "files").repartition(common.partitions(spark)).mapInPandas(ask_words, REQUESTS), 1)
    base = bound + 2  # words have numbers below base - 1, which is the start's
    widths = [64, max((base * base).bit_length(), *bits)]

    def opened(own: pd.DataFrame, k: int) -> tuple[Block, list[str]]:
        """The block of a group of answers of order k, with the answers of all orders up to it."""
        names = own["files"].iloc[0].split("|")
        block = Block(stored(folder, names[0]))
        for j in range(1, k + 1):
            if j > 1:
                block.extend(base, widths[j - 1], narrow)
            if j == k:
                block.answered(*_read_answers(own, bits[k - 1], leasts[k - 1]))
            else:
                got = stored(folder, names[j])
                total = unpacked(got["total"], np.int64)
                block.answered(total, _states_unpacked(got["state"], total >= leasts[j - 1], bits[j - 1]))
        return block, names

    def asker(k: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """From answers of order k - 1 to requests of order k."""

        def ask(own: pd.DataFrame) -> pd.DataFrame:
            block, names = opened(own, k - 1)
            level = block.levels[-1]
            names.append(store(folder, total=packed(level.total), state=_states_packed(level.state, bits[k - 2])))
            return _requests(int(own["block"].iloc[0]), "|".join(names), block.extend(base, widths[k - 1], narrow), widths[k - 1], bits[k - 1])

        return ask

    def by_block(replies: DataFrame):
        """Few bytes but much work: as many tasks as the session has partitions, whatever the size."""
        return replies.repartition(common.partitions(spark), "block").groupBy("block")

    for k in range(2, order + 1):
        replies, _, bound = answered(by_block(replies).applyInPandas(asker(k), REQUESTS), k)
        widths.append(max((max(1, bound) * base).bit_length(), *bits))

    def score(own: pd.DataFrame) -> pd.DataFrame:
        block, _ = opened(own, order)
        machine = automaton(block, n_docs, n_train, n_types, mu)
        logp = traverse(block, machine)
        known, root = block.levels[0].total[block.tokens] > 0, machine["weight"][block.tokens]
        return pd.DataFrame({
            "doc_id": pd.arrays.IntegerArray(block.ids[:, 1].copy(), block.ids[:, 0] == 0), "held_out": ~block.train, "n_tokens": block.lengths,
            "n_known": np.add.reduceat(known.astype(np.int64), block.starts), "train_tokens": n_train,
            "base_score": np.add.reduceat(root, block.starts), "score": np.add.reduceat(logp, block.starts),
        })

    return common.checkpointed(by_block(replies).applyInPandas(score, SCORES))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(common.read(spark, sf_dir, "documents"))
