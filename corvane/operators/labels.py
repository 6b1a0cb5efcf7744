"""Checks and indexes of labelled intervals. Every window is partitioned by file and episode."""

from __future__ import annotations

from pyspark.sql import DataFrame, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EPISODE = ["file", "episode"]


def _by_start() -> WindowSpec:
    return W.partitionBy(*EPISODE).orderBy("start_frame", "end_frame", "event_id")


def overlaps(segments: DataFrame) -> DataFrame:
    """Neighbours in order of their starts of which the later begins before the earlier ends."""
    before = segments.withColumn("previous_end", F.lag("end_frame").over(_by_start()))
    return before.filter("start_frame < previous_end").select(*EPISODE, "event_id", "start_frame", "previous_end")


def gaps(segments: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Frames that no segment covers: before each, counted from 0 and from what the segments before it reach, and after the last up to the video's frames (videos: file, episode, frames)."""
    reached = F.coalesce(F.max(F.col("end_frame") + 1).over(_by_start().rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = segments.withColumn("lo", reached).filter("start_frame > lo").select(*EPISODE, "lo", (F.col("start_frame") - 1).alias("hi"))
    if videos is None:
        return before
    ends = segments.groupBy(*EPISODE).agg((F.max("end_frame") + 1).alias("reached"))
    after = videos.select(*EPISODE, "frames").join(ends, EPISODE, "left").withColumn("lo", F.greatest(F.coalesce("reached", F.lit(0)), F.lit(0)))
    return before.unionByName(after.filter("frames > lo").select(*EPISODE, "lo", (F.col("frames") - 1).alias("hi")))


def coverage(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """Per episode, against the video's frames: the stretch from the first start to the last end in order of the starts, and the segments' lengths, overlaps counted twice."""
    first = F.min("start_frame")
    last = F.max(F.struct("start_frame", "end_frame", "event_id"))["end_frame"]
    out = segments.groupBy(*EPISODE).agg(F.count("*").alias("n_segments"), (last - first + 1).alias("span_frames"), F.sum(F.col("end_frame") - F.col("start_frame") + 1).alias("labelled_frames"))
    share = lambda c: F.when(F.col("frames") > 0, F.round(F.col(c) / F.col("frames"), 3)).otherwise(F.lit(0.0))
    return out.join(videos.select(*EPISODE, "frames"), EPISODE).withColumn("span_coverage", share("span_frames")).withColumn("labelled_fraction", share("labelled_frames")).drop("frames")


def repeats(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*EPISODE, "subtask").agg(F.count("*").alias("n")).filter("n > 1")


def same_starts(segments: DataFrame) -> DataFrame:
    return segments.groupBy(*EPISODE, "start_frame").agg(F.count("*").alias("n"), F.min("event_id").alias("first_event")).filter("n > 1")


def holding(segments: DataFrame, texts: DataFrame) -> DataFrame:
    """Takes of what is held, puts and uses of what is not; texts: subtask, text of the vocabulary.

    Only objects that the vocabulary can take are followed. An object's state is that of the last take or put before.
    Per use all objects that are missing are named, in the order of their names.
    """
    from ..functions.words import DROP, PREPOSITIONS, TAKE, parsed

    words = texts.select("subtask", parsed(F.col("text")).alias("w"))
    verb, object_ = F.col("w.verb"), F.col("w.object")
    kind = F.when(verb.isin(*TAKE), "take").when(verb.isin(*DROP), "put").otherwise("use")
    others = F.filter(F.split("w.modifier", " "), lambda x: (x != "") & ~x.isin(*PREPOSITIONS))
    needs = F.when(kind == "use", F.concat(F.array(object_), others)).otherwise(F.array(object_))
    acts = words.select("subtask", kind.alias("kind"), F.explode(F.array_distinct(needs)).alias("object"))
    takeable = words.filter(verb.isin(*TAKE)).select(object_.alias("object")).distinct()
    acts = acts.join(takeable, "object", "left_semi")
    rows = segments.join(acts, "subtask")
    by = W.partitionBy(*EPISODE, "object").orderBy("start_frame", "end_frame", "event_id").rowsBetween(W.unboundedPreceding, -1)
    state = F.when(F.col("kind") == "take", 1).when(F.col("kind") == "put", 0)
    held = F.coalesce(F.last(state, ignorenulls=True).over(by), F.lit(0))
    fault = F.when((F.col("kind") == "take") & (held == 1), "take twice").when((F.col("kind") == "put") & (held == 0), "put without take").when((F.col("kind") == "use") & (held == 0), "use without holding")
    found = rows.withColumn("fault", fault).filter("fault is not null")
    return found.groupBy(*EPISODE, "event_id", "fault").agg(F.concat_ws(",", F.sort_array(F.collect_set("object"))).alias("objects"))


def unique_ids(segments: DataFrame) -> DataFrame:
    """Ids by family, file and start; the second and later ones of an id get -2, -3 in order."""
    ids = segments.withColumn("id", F.format_string("%s_%d@f%06d", "family", "file", "start_frame"))
    n = F.row_number().over(W.partitionBy("id").orderBy("event_id"))
    return ids.select("event_id", F.when(n > 1, F.concat_ws("-", "id", n.cast("string"))).otherwise(F.col("id")).alias("id"))


def transitions(segments: DataFrame) -> DataFrame:
    """How often an action follows another in an episode, and the share among all that follow it."""
    steps = segments.withColumn("following", F.lead("subtask").over(_by_start())).filter("following is not null")
    pairs = steps.groupBy("subtask", "following").agg(F.count("*").alias("n"))
    whole = F.sum("n").over(W.partitionBy("subtask"))
    return pairs.withColumn("share", F.round(F.col("n") / whole, 6))


def episode_of(segments: DataFrame, bounds: DataFrame, slack: int) -> DataFrame:
    """Each segment with `bound`: the first of the file's (file, bound, lo, hi) whose bounds, with slack, hold the start; 0 if none does.

    A file's bounds are one sorted array, so segments meet their file once and are neither multiplied nor grouped.
    """
    of_file = bounds.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("bound", "lo", "hi"))).alias("_bounds"))
    near = lambda b: (F.col("start_frame") >= b["lo"] - slack) & (F.col("start_frame") <= b["hi"] + slack)
    hit = F.get(F.filter("_bounds", near), F.lit(0))["bound"]
    return segments.join(of_file, "file", "left").withColumn("bound", F.coalesce(hit, F.lit(0))).drop("_bounds")


def unlabelled(segments: DataFrame, bounds: DataFrame, slack: int) -> DataFrame:
    """Bounds (file, bound, lo, hi) of files with several that hold no whole segment.

    Segments and bounds of a file are walked once from its end: what a bound needs is the least end of all segments that
    begin at its own beginning or later.
    """
    several = bounds.withColumn("_n", F.count("*").over(W.partitionBy("file"))).filter("_n > 1")
    own = segments.select("file", F.col("start_frame").cast("double").alias("at"), F.lit(1).alias("kind"), F.col("end_frame").alias("end"), F.lit(None).cast("long").alias("bound"), F.lit(None).cast("double").alias("hi"))
    asked = several.select("file", (F.col("lo") - slack).cast("double").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("end"), "bound", (F.col("hi") + slack).cast("double").alias("hi"))
    back = W.partitionBy("file").orderBy(F.col("at").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, 0)
    rows = own.unionByName(asked).withColumn("_least", F.min("end").over(back))
    return rows.filter("kind = 0 and (_least is null or _least > hi)").select("file", "bound")


def undefined(segments: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Segments whose subtask is not in the vocabulary (subtask), or is null."""
    return segments.join(vocabulary.select("subtask").distinct(), "subtask", "left_anti")


def underived(segments: DataFrame, fps: float) -> DataFrame:
    """Segments whose start and end seconds are not those of their frames, within two thousandths."""
    from ..functions import frame_time

    off = lambda c, frame: F.abs(F.col(c) - frame_time(frame, F.lit(fps))) > 0.002
    return segments.filter(off("start", F.col("start_frame")) | off("end", F.col("end_frame") + 1))


def suspicious(segments: DataFrame) -> DataFrame:
    """file, episode, start_frame, kind, n: segments without length, and starts that several share."""
    short = segments.filter("end_frame <= start_frame").groupBy(*EPISODE, "start_frame").agg(F.count("*").alias("n")).withColumn("kind", F.lit("zero length"))
    return short.unionByName(same_starts(segments).drop("first_event").withColumn("kind", F.lit("same start")))


def ambiguous(segments: DataFrame) -> DataFrame:
    """Per file the first episode, in order of appearance, in which a subtask comes twice."""
    seen = segments.groupBy(*EPISODE, "subtask").agg(F.count("*").alias("n"), F.min(F.struct("start_frame", "end_frame", "event_id")).alias("at"))
    episodes = seen.groupBy(*EPISODE).agg(F.max("n").alias("n"), F.min("at").alias("at")).filter("n > 1")
    return episodes.groupBy("file").agg(F.min_by("episode", "at").alias("episode"))


def polluted(documents: DataFrame, allowed: list[str]) -> DataFrame:
    """file and the keys of its segments that are not allowed; documents: file, keys (an array for each segment)."""
    extra = F.array_except(F.array_distinct(F.flatten(F.collect_list("keys"))), F.array(*map(F.lit, allowed)))
    return documents.groupBy("file").agg(F.array_join(F.sort_array(extra), ",").alias("extra")).filter("extra <> ''")


def broken(segments: DataFrame) -> DataFrame:
    """Segments that break the record's types: event_id and the first rule broken."""
    rule = (
        F.when(F.col("subtask").isNull(), "subtask missing").when(F.col("start_frame").isNull() | (F.col("start_frame") < 0), "start_frame not natural")
        .when(F.col("end_frame").isNull() | (F.col("end_frame") < F.col("start_frame")), "end_frame before start_frame").when(F.col("end") <= F.col("start"), "end not after start")
    )
    return segments.withColumn("rule", rule).filter("rule is not null").select("event_id", "rule")


def against_videos(segments: DataFrame, videos: DataFrame) -> DataFrame:
    """file, episode, kind; videos: file, episode, declared_fps, frames, duration. Frame rates off by more than 0.5, ends more than two frames beyond, spans of under a tenth."""
    own = segments.groupBy(*EPISODE).agg(F.max("end_frame").alias("last"), F.max("end").alias("hi"), F.min("start").alias("lo"))
    rows = own.join(videos, EPISODE)
    unread = (F.coalesce("frames", F.lit(0)) == 0) | (F.coalesce("duration", F.lit(0.0)) == 0)
    kinds = F.when(unread, F.array(F.lit("unreadable"))).otherwise(
        F.array_compact(F.array(
            F.when(F.abs(F.col("declared_fps") - F.col("frames") / F.col("duration")) > 0.5, "frame rate"), F.when(F.col("last") > F.col("frames") + 2, "beyond the end"),
            F.when((F.col("hi") - F.col("lo")) / F.col("duration") < 0.1, "little covered"),
        ))
    )
    return rows.select(*EPISODE, F.explode(kinds).alias("kind"))


#: Kinds of findings that block a release.
BLOCKING = ("pollution", "overlap", "derivation", "reference", "sequence", "structure")


def reviewed(findings: DataFrame, documents: DataFrame) -> DataFrame:
    """Per document (file): block if it has a blocking finding or no segment (n_segments 0), warn if it has others, else ok."""
    worst = findings.groupBy("file").agg(F.max(F.col("kind").isin(*BLOCKING)).alias("blocks"))
    level = F.when((F.col("n_segments") == 0) | F.coalesce("blocks", F.lit(False)), "block").when(F.col("blocks").isNotNull(), "warn").otherwise("ok")
    return documents.join(worst, "file", "left").select("file", level.alias("level"))


def addable(candidates: DataFrame, segments: DataFrame) -> DataFrame:
    """Candidates (file, episode, id, start_frame, end_frame) with ok: no true overlap with any segment of the episode; a shared boundary is none.

    Both are walked once in order: of the segments that begin before a candidate's end, the greatest end tells.
    """
    own = segments.select(*EPISODE, F.col("start_frame").alias("at"), F.lit(1).alias("kind"), F.col("end_frame").alias("end"), F.lit(None).cast("long").alias("id"), F.lit(None).cast("long").alias("start"))
    asked = candidates.select(*EPISODE, F.col("end_frame").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("long").alias("end"), F.col("id").cast("long").alias("id"), F.col("start_frame").alias("start"))
    before = W.partitionBy(*EPISODE).orderBy("at", "kind").rowsBetween(W.unboundedPreceding, 0)
    rows = own.unionByName(asked).withColumn("_most", F.max("end").over(before)).filter("kind = 0")
    return rows.select("id", ((F.col("at") >= F.col("start")) & ~F.coalesce(F.col("_most") > F.col("start"), F.lit(False))).alias("ok"))


def report(findings: DataFrame, kinds: list[str]) -> DataFrame:
    """Findings (family, kind) counted per family, a column for each kind."""
    return findings.groupBy("family").agg(*[F.count_if(F.col("kind") == k).alias(k.replace(" ", "_")) for k in kinds])


def examples(findings: DataFrame, most: int = 4, caps: dict[str, int] | None = None) -> DataFrame:
    """The first findings (family, kind, detail) of each kind that differ in family or in the first 40 characters, as many as caps has for the kind, else `most`; one row per such difference is kept before the ranking."""
    distinct = findings.groupBy("kind", "family", F.substring("detail", 1, 40).alias("head")).agg(F.min("detail").alias("detail"))
    cap = F.coalesce(*[F.when(F.col("kind") == k, n) for k, n in (caps or {}).items()], F.lit(most))
    return distinct.withColumn("n", F.row_number().over(W.partitionBy("kind").orderBy("family", "detail"))).filter(F.col("n") <= cap).select("kind", "n", "family", "detail")


def successors(segments: DataFrame) -> DataFrame:
    """event_id and the subtask of the next segment of the episode, null at its end."""
    return segments.select("event_id", F.lead("subtask").over(_by_start()).alias("next_subtask"))


def usage(segments: DataFrame) -> DataFrame:
    """Per family and subtask: in how many files it occurs."""
    return segments.groupBy("family", "subtask").agg(F.count_distinct("file").alias("files"))
