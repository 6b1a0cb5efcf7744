"""Best-fit packing by a configuration linear program (operator 2).

Pieces of at most `capacity` ids are counted by length. A configuration is a multiset of lengths that fits a sequence.
The linear program (fewest configurations that cover the histogram) is solved by multiplicative weights: a length
that is covered less than the others gains weight; a knapsack dynamic program over the weighted lengths finds the
configurations of greatest weight, which are taken in small steps. The solution is rounded down, the program is solved
again for the pieces that are left, and what then remains is filled by best fit on the histogram.
The histogram has at most `capacity` entries whatever the corpus, so this part runs on the driver; pieces are then
dealt to their places by their rank within their length, in Spark.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common, tokens

Configuration = tuple[tuple[int, int], ...]  # (length, how many), longest first


def knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """best[c]: greatest value of lengths that sum to at most c; pick[c]: index of a length in it, -1 if c is better left."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1, dtype=np.int64)
    for c in range(int(lengths[0]), capacity + 1):
        k = int(np.searchsorted(lengths, c, side="right"))
        gain = best[c - lengths[:k]] + value[:k]
        i = int(gain.argmax())
        best[c], pick[c] = (gain[i], i) if gain[i] > best[c - 1] else (best[c - 1], -1)
    return best, pick


def _trace(lengths: np.ndarray, pick: np.ndarray, c: int) -> list[int]:
    out = []
    while c > 0:
        if pick[c] < 0:
            c -= 1
        else:
            out.append(int(pick[c]))
            c -= int(lengths[pick[c]])
    return out


def solve(counts: dict[int, int], capacity: int, rounds: int = 150, step: float = 0.04, gap: float = 0.001) -> list[tuple[Configuration, float]]:
    """Fractional configurations; stops when within `gap` of the dual bound that the weights give.

    The first weights are the lengths themselves, under which every full sequence is worth the same.
    """
    lengths = np.array(sorted(counts), dtype=np.int64)
    need = np.array([counts[int(n)] for n in lengths], dtype=float)
    cover, taken, total, bound = np.zeros(len(lengths)), defaultdict(float), 0.0, 0.0
    for _ in range(rounds):
        value = lengths * np.exp(np.clip((cover.mean() - cover) / (2 * step), -30, 30) / 8)
        best, pick = knapsack(lengths, value, capacity)
        bound = max(bound, float((value * need).sum() / best[capacity]))
        worth = value + best[capacity - lengths]
        behind = cover <= cover.mean() + 1e-9
        chosen = {}
        for i in np.flatnonzero((worth >= (1 - step) * best[capacity]) & behind | (worth >= worth.max() * (1 - 1e-9))):
            items = tuple(sorted([int(i), *_trace(lengths, pick, capacity - int(lengths[i]))], reverse=True))
            chosen[items] = min(need[j] / items.count(j) for j in set(items))
        gain = np.zeros(len(lengths))
        for items, x in chosen.items():
            np.add.at(gain, list(items), x)
        scale = step / float((gain / need).max())
        for items, x in chosen.items():
            taken[items] += x * scale
            total += x * scale
        cover += gain * scale / need
        if cover.min() > 0 and total / cover.min() <= (1 + gap) * bound:
            break
    out, share = [], float(np.quantile(cover, 0.9))
    for items, x in taken.items():
        of = defaultdict(int)
        for i in items:
            of[int(lengths[i])] += 1
        out.append((tuple(sorted(of.items(), reverse=True)), x / share))
    return out


def _fullest(left: dict[int, int], longest: int, capacity: int) -> Configuration:
    """The longest piece with the fullest completion by pieces that are left, found by subset sums as bit sets; of equally full ones that of the longest pieces."""
    room, bits, steps = capacity - longest, 1, []
    for n in sorted((n for n in left if n <= room), reverse=True):
        most, part = min(left[n] - (n == longest), room // n), 1
        while most > 0:
            m = min(part, most)
            steps.append((n, m, bits))
            bits |= (bits << n * m) & ((2 << room) - 1)
            most, part = most - m, 2 * part
        if bits >> room & 1:
            break
    of, at = defaultdict(int, {longest: 1}), bits.bit_length() - 1
    for n, m, before in reversed(steps):
        if not before >> at & 1:
            of[n] += m
            at -= n * m
    return tuple(sorted(of.items(), reverse=True))


def fullest_fill(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """The longest piece that is left, completed as full as can be, as often as its pieces allow; and so on."""
    left, out = dict(counts), []
    while left:
        config = _fullest(left, max(left), capacity)
        times = min(left[n] // m for n, m in config)
        out.append((config, times))
        for n, m in config:
            left[n] -= m * times
            if not left[n]:
                del left[n]
    return out


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Configuration, int]]:
    """Pieces by falling length, each into the sequence with the least room that holds it: all of one length and room at once."""
    open_ = defaultdict(lambda: defaultdict(int))  # room: configuration: how many
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = next((r for r in range(n, capacity) if open_.get(r)), None)
            if room is None:  # new sequences take as many as fit before the next one is begun
                each = min(left, capacity // n)
                open_[capacity - n * each][((n, each),)] += left // each
                left %= each
                continue
            config = next(iter(open_[room]))
            times = min(left, open_[room][config])
            open_[room][config] -= times
            if not open_[room][config]:
                del open_[room][config]
            open_[room - n][config[:-1] + ((n, config[-1][1] + 1),) if config[-1][0] == n else (*config, (n, 1))] += times
            left -= times
    return [(config, times) for of in open_.values() for config, times in of.items() if times]


def configurations(counts: dict[int, int], capacity: int, passes: int = 2) -> list[tuple[Configuration, int]]:
    """Whole configurations that hold exactly the counted pieces.

    The program's solution is rounded down, the most frequent configurations first, and the program is solved again for
    the pieces that are left. Those that then remain, fewer than one of each configuration, are filled by fullest
    completion and by best fit; the one with fewer sequences is taken.
    """
    left, out = {n: k for n, k in counts.items() if k > 0}, []
    for _ in range(passes):
        for config, x in sorted(solve(left, capacity), key=lambda c: (-c[1], c[0])) if left else ():
            times = min([int(x), *(left.get(n, 0) // m for n, m in config)])
            if times > 0:
                out.append((config, times))
                for n, m in config:
                    left[n] -= m * times
        left = {n: k for n, k in left.items() if k > 0}
    return out + min(fullest_fill(left, capacity), best_fit(left, capacity), key=lambda fill: sum(times for _, times in fill))


def plan(counts: dict[int, int], capacity: int) -> dict[int, np.ndarray]:
    """For each length the slots of its pieces by rank: columns first rank, first sequence, pieces a sequence, offset."""
    seats, used, sequence = defaultdict(list), defaultdict(int), 0
    for config, n in configurations(counts, capacity):
        offset = 0
        for length, m in config:
            seats[length].append((used[length], sequence, m, offset))
            used[length] += m * n
            offset += m * length
        sequence += n
    return {length: np.array(rows, dtype=np.int64) for length, rows in seats.items()}


def pieces(docs: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text (null: empty) with its end id. Of a longer one the first piece may be shorter."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, end = tokens.encoder(tokenizer), np.array([tokens.END_ID], "<u4").tobytes()
        for batch in batches:
            rows = []
            for i, ids in zip(batch["i"], encoder.encode([t if isinstance(t, str) else None for t in batch["t"]]), strict=True):
                ids += end
                n = len(ids) // 4
                at, piece = 0, 0
                while at < n:
                    length = (n - at - 1) % capacity + 1
                    rows.append((i, piece, at, length, zlib.crc32(ids[4 * at : 4 * (at + length)])))
                    at, piece = at + length, piece + 1
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add sequence_id and offset to rows (doc_id, piece, length and others) with a length between 1 and capacity.

    Ranks within a length come from counts by (length, salt): a length may hold any share of the rows. Every row gets a
    place, equal rows different ones; which of several rows of one length gets which place is not fixed. Columns named
    sequence_id or offset are replaced, all others stay. An empty table gives an empty result.
    """
    spark = pieces.sparkSession
    salts, kept = common.partitions(spark), pieces.drop("sequence_id", "offset")
    salt, each, before, within, rank = (common.fresh(kept.columns, c) for c in ("salt", "each", "before", "within", "rank"))
    held = common.checkpointed(kept.withColumn(salt, (F.rand(17) * salts).cast("int")))
    by_salt = held.groupBy("length", salt).agg(F.count("*").alias(each))
    counts = {int(r["length"]): int(r["n"]) for r in by_salt.groupBy("length").agg(F.sum(each).alias("n")).collect()}  # at most `capacity` rows
    seats = plan(counts, capacity)
    earlier = by_salt.withColumn(before, F.sum(each).over(W.partitionBy("length").orderBy(salt)) - F.col(each)).drop(each)
    ranked = (
        held.withColumn(within, F.row_number().over(W.partitionBy("length", salt).orderBy("doc_id", "piece")) - 1)
        .join(earlier, ["length", salt])
        .withColumn(rank, F.col(before) + F.col(within))
        .drop(before, within, salt)
    )

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, ranks = batch["length"].to_numpy(), batch[rank].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            for n in np.unique(length):
                at, rows = np.flatnonzero(length == n), seats[int(n)]
                row = rows[np.searchsorted(rows[:, 0], ranks[at], side="right") - 1]
                nth = ranks[at] - row[:, 0]
                sequence[at], offset[at] = row[:, 1] + nth // row[:, 2], row[:, 3] + nth % row[:, 2] * n
            yield batch.drop(columns=rank).assign(sequence_id=sequence, offset=offset)

    kinds = dict(kept.dtypes)
    columns = [c for c in ranked.columns if c != rank]
    return ranked.mapInPandas(place, ", ".join(f"`{c}` {kinds[c]}" for c in columns) + ", sequence_id long, offset long").select(*[F.col(f"`{c}`") for c in kept.columns], "sequence_id", "offset")


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024) -> DataFrame:
    """The pieces of all texts with their places in sequences: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty and has its end id only; a null id stays null; a text of any length is encoded whole and cut to
    pieces; repeated rows are packed each; which of several pieces of one length gets which place is not fixed; an empty
    table gives no rows; other columns are not read.
    """
    return pack(pieces(docs, tokenizer, capacity), capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.read(spark, sf_dir, "documents"), tokens.default_path())
