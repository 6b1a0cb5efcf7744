"""Mixing sources to target weights (operator 13), in DataFrame and SQL expressions only.

Every source is one stream of words, its documents in a keyed order, and is cut into blocks of one length. Weights give
each source a target of words, and so an exact quota of blocks; a quota above the source's blocks draws all of them,
once more with each pass. The quotas are dealt to output shards down a tree: a node's shards are halved, and what its
left half gets of each source is one multivariate hypergeometric draw, so a shard's content is as if all drawn blocks
had been shuffled and cut, and no shuffle of blocks is made. A shard's share of a source is then a range of the source's
draws; draw j of a pass is the block that a keyed permutation has at place j, so ranges are disjoint. Within a shard the
blocks are in a keyed order.

Everything is a function of the seed and the rows: reruns agree, whatever the partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (1, 2, 3)
#: A source gives at most so many times its words.
MOST = 3
#: Blocks of a source at least, if it has as many words; and words of a block at most.
BLOCKS, BLOCK_WORDS = 8192, 1 << 20
#: Words of an output shard, where the number of shards isn't given.
SHARD_WORDS = 1 << 28
LEAST_SHARDS = 64
#: Sources that are broadcast; more are joined by a shuffle.
BROADCAST_SOURCES = 10_000
ROUNDS = 48


def sized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size of every row: the words of its text."""
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(common.WORD)).cast("long")
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), words.alias("size"))


def targets(rows: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, k (its number by code point, null last), source_size, target of every source of sized rows.

    A target is the smaller of `most` times the source's words and its weight times one level, at which the targets add
    up to all words: what remains when the excess of capped sources has been shared again until there is none.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy("room", "k")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("k") - 1, F.lit(len(weights))) + 1).cast("int"))
    before = F.coalesce(F.sum(most * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - before) / left  # were all sources with less room capped
    out = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("k", F.row_number().over(ordered))
    out = out.withColumn("weight", weight).withColumn("room", most * F.col("source_size") / F.col("weight")).withColumn("level", level)
    level = F.max(F.when(F.col("level") <= F.col("room"), F.col("level"))).over(Window.partitionBy())
    return out.select("source", "k", "source_size", F.least(most * F.col("source_size").cast("double"), level * F.col("weight")).alias("target"))


def with_blocks(sources: DataFrame, most: int = MOST) -> DataFrame:
    """Adds block_words, n_blocks (the last block has what is left over, too) and quota, the blocks to be drawn."""
    size, block = F.col("source_size"), F.expr(f"greatest(1, least({BLOCK_WORDS}, source_size div {BLOCKS}))")
    out = sources.withColumn("block_words", block).withColumn("n_blocks", F.expr("source_size div block_words"))
    quota = F.round(F.col("target") * F.col("n_blocks") / size).cast("long")
    return out.withColumn("quota", F.when(size > 0, F.least(quota, most * F.col("n_blocks"))).otherwise(0))


def _hypergeometric(whole: str, marked: str, drawn: str, u: str) -> str:
    """SQL: how many of `drawn` out of `whole` are marked, by inversion at u in [0, 1).

    Weights follow from one to the next by their ratio, over 12 standard deviations to either side of the mean: what is
    beyond is less than a double can tell.
    """
    mean = f"({drawn} * ({marked} / cast({whole} as double)))"
    spread = f"ceil(12 * sqrt({mean} * (1 - {marked} / cast({whole} as double)) * ({whole} - {drawn}) / greatest(1, {whole} - 1)) + 12)"
    low = f"greatest(0, {drawn} + {marked} - {whole}, cast(floor({mean}) - {spread} as bigint))"
    high = f"least({drawn}, {marked}, cast(ceil({mean}) + {spread} as bigint))"
    ratio = f"(({marked} - x) * cast({drawn} - x as double) / ((x + 1) * cast({whole} - {marked} - {drawn} + x + 1 as double)))"
    mass = f"aggregate(sequence(r.low, r.high), named_struct('w', 1D, 't', 0D), (s, x) -> named_struct('w', s.w * {ratio}, 't', s.t + s.w), s -> s.t)"
    found = (
        f"aggregate(sequence(m.low, m.high), named_struct('w', 1D, 't', 0D, 'at', m.low), (s, x) -> named_struct("
        f"'w', s.w * {ratio}, 't', s.t + s.w, 'at', if(s.t + s.w <= m.goal, x + 1, s.at)), s -> least(s.at, m.high))"
    )
    bounds = f"transform(array(named_struct('low', {low}, 'high', {high})), r -> named_struct('low', r.low, 'high', r.high, 'goal', {u} * {mass}))"
    return f"if({whole} = 0, 0L, transform({bounds}, m -> {found})[0])"


def dealt(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """k, shard, n: how many of the blocks drawn of each source go to each shard. Shards get equally many blocks, but for one."""
    quotas = F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda x: x["quota"])
    nodes = sources.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "quota"))), lambda x: x["k"]).alias("ks"), quotas.alias("has"))
    nodes = nodes.select("ks", "has", F.lit(0).alias("first"), F.lit(shards).alias("n_shards"))
    unit = f"(shiftrightunsigned(xxhash64({seed}L, first, n_shards, size(a.out)), 11) * {2.0**-53!r}D)"
    drawn = _hypergeometric("a.whole", "q", "a.wanted", unit)
    step = (
        "aggregate(has, named_struct('whole', whole, 'wanted', whole * half div n_shards, 'out', cast(array() as array<bigint>)), (a, q) -> "
        f"transform(array({drawn}), d -> named_struct('whole', a.whole - q, 'wanted', a.wanted - d, 'out', array_append(a.out, d)))[0], a -> a.out)"
    )
    for level in range((shards - 1).bit_length()):
        if level % 5 == 4:
            nodes = nodes.repartition("first")
        nodes = nodes.withColumn("whole", F.expr("aggregate(has, 0L, (s, q) -> s + q)")).withColumn("half", F.expr("n_shards div 2")).withColumn("left", F.expr(step))
        halves = "array(named_struct('first', first, 'n_shards', half, 'has', left), named_struct('first', cast(first + half as int), 'n_shards', n_shards - half, 'has', zip_with(has, left, (q, d) -> q - d)))"
        whole = "array(named_struct('first', first, 'n_shards', cast(n_shards as bigint), 'has', has))"
        nodes = nodes.select("ks", F.explode(F.expr(f"if(n_shards > 1, {halves}, {whole})")).alias("x")).select("ks", "x.has", "x.first", "x.n_shards")
    return nodes.select(F.col("first").alias("shard"), F.explode(F.arrays_zip("ks", "has")).alias("x")).select(F.col("x.ks").alias("k"), "shard", F.col("x.has").alias("n"))


def permuted(place: str, size: str, key: str) -> Column:
    """SQL: a keyed permutation of 0 ... size - 1, of any size: in each round a number and its mirror image swap, or not."""
    mirror = f"pmod(pmod(xxhash64(i, {key}), {size}) - x, {size})"
    swap = f"pmod(xxhash64(i, greatest(x, y), {key}, 1), 2) = 1"
    return F.expr(f"aggregate(sequence(1, {ROUNDS}), {place}, (x, i) -> transform(array({mirror}), y -> if({swap}, y, x))[0])")


def draws(sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """k, block, pass, shard of every block drawn."""
    upto = Window.partitionBy("k").orderBy("shard")
    ranges = dealt(sources, shards, seed).withColumn("until", F.sum("n").over(upto)).filter("n > 0")
    each = ranges.repartition(common.partitions(sources.sparkSession), "k", "shard").select("k", "shard", F.explode(F.expr("sequence(until - n, until - 1)")).alias("j"))
    each = _with_sources(each, sources.select("k", "n_blocks"), "k").select("k", "shard", F.expr("j div n_blocks").alias("pass"), F.expr("j % n_blocks").alias("place"), "n_blocks")
    return each.select("k", permuted("place", "n_blocks", f"{seed}L, k, pass").alias("block"), "pass", "shard")


def _with_sources(rows: DataFrame, sources: DataFrame, on: str) -> DataFrame:
    few = sources.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    own = sources.withColumnRenamed(on, "_corvane_on")
    return rows.join(F.broadcast(own) if few else own, rows[on].eqNullSafe(own["_corvane_on"])).drop("_corvane_on")


def streams(rows: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Sized rows with their source's columns and `at`: the words of the source's stream before the row's own.

    The order is a hash's. Sums before a bucket of hashes and sums within it add up, so no source is one task's.
    """
    out = _with_sources(rows, sources, "source").withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))
    buckets = min(max(1, -(-rows.count() // 256)), 1 << 16)
    out = out.withColumn("bucket", F.pmod(F.xxhash64("h"), F.lit(buckets)))
    before = Window.partitionBy("k").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = out.groupBy("k", "bucket").agg(F.sum("size").alias("n")).select("k", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    within = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    out = out.withColumn("within", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return out.join(sums, ["k", "bucket"]).withColumn("at", F.col("before") + F.col("within")).drop("h", "bucket", "before", "within")


def pieces(rows: DataFrame, sources: DataFrame, shards: int, seed: int) -> DataFrame:
    """shard, turn, k, at, doc_id, start, words: every part of a document that the mix takes, once for each time.

    rows: of streams(). A shard is read in the order of turn, at, start.
    """
    some = rows.filter("size > 0").withColumn("block", F.explode(F.expr("sequence(least(at div block_words, n_blocks - 1), least((at + size - 1) div block_words, n_blocks - 1))")))
    begin = F.expr("greatest(at, block * block_words)")
    until = F.expr("least(at + size, if(block = n_blocks - 1, source_size, (block + 1) * block_words))")
    parts = some.select("k", "block", "at", "doc_id", (begin - F.col("at")).alias("start"), (until - begin).alias("words"))
    turn = F.xxhash64(F.lit(seed), "shard", "k", "pass", "block")
    return parts.join(draws(sources, shards, seed), ["k", "block"]).select("shard", turn.alias("turn"), "k", "at", "doc_id", "start", "words")


class Mix:
    """A mix of the rows of docs. Nulls: a null text has no words, null sources are one source, the last; a null id is
    an id. Texts without words are in no piece. Repeated rows are documents of their own; rows with equal id and size
    are alike, so which of them stands first doesn't show. A very long text is cut at the ends of blocks. An empty table,
    or one without words, gives no pieces and targets of 0. Columns of other names are not read."""

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, shards: int | None = None, seed: int = 13, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        rows = common.checkpointed(sized(docs, id_col, text_col, source_col))
        self.sources = common.checkpointed(with_blocks(targets(rows, weights, most), most))
        words = self.sources.agg(F.sum("source_size")).first()[0] or 0
        self.shards = shards or max(LEAST_SHARDS, -(-words // SHARD_WORDS))
        self.rows = common.checkpointed(streams(rows, self.sources, seed))
        self.pieces = pieces(self.rows, self.sources, self.shards, seed)

    def shuffled(self) -> DataFrame:
        """The pieces, a partition or more for each shard, in the order of the shard."""
        return self.pieces.repartition(self.shards, "shard").sortWithinPartitions("shard", "turn", "at", "start")

    def documents(self) -> DataFrame:
        """doc_id, source, size, source_size, target, taken of every row: the words that the mix takes of it, repeats counted."""
        taken = self.pieces.groupBy(F.col("k").alias("k_"), F.col("at").alias("at_")).agg(F.sum("words").alias("taken"))
        same = (F.col("k") == F.col("k_")) & (F.col("at") == F.col("at_")) & (F.col("size") > 0)
        return self.rows.join(taken, same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def op13_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Mix(common.read(spark, sf_dir, "documents")).documents().select("doc_id", "size", "source_size", "target", "taken", "source")
