"""Column functions: hashes, labels, clocks, interval metrics. All are SQL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, body) -> Column:
    """body(value) with the value worked out once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strict_json(text: Column) -> Column:
    """The variant of a text that is one JSON value and nothing else, else null.

    try_parse_json reads the first value and leaves what follows. As the one element of a list, and as the one field of
    an object, the text is followed by a bracket and by a brace; what follows its first value can close only one of them.
    """
    both = F.struct(F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit("]"))), "$", "array<variant>").alias("l"), F.try_parse_json(F.concat(F.lit('{"x":'), text, F.lit("}"))).alias("o"))
    return bound(both, lambda b: F.when((F.size(b["l"]) == 1) & b["o"].isNotNull(), F.get(b["l"], F.lit(0))))


def md5_mod(text: Column, n: int) -> Column:
    """The 128-bit md5 modulo n (n below 2**31), folded in from chunks of eight hexadecimal digits."""
    h = F.md5(text.cast("binary"))
    out = F.lit(0).cast("bigint")
    for i in range(4):
        out = (out * F.lit((1 << 32) % n) + F.conv(F.substring(h, 8 * i + 1, 8), 16, 10).cast("bigint")) % n
    return out


def label_id(text: Column) -> Column:
    """Words of letters and digits joined by `_`, without articles unless there is nothing else."""
    words = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    kept = F.filter(words, lambda w: ~w.isin("the", "a", "an"))
    return F.concat_ws("_", F.when(F.size(kept) > 0, kept).otherwise(words))


def family_name(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def clock(milliseconds: Column) -> Column:
    """HH:MM:SS.mmm of whole milliseconds, with full carry."""
    ms = milliseconds.cast("bigint")
    part = lambda div, mod: (F.floor(ms / div) % mod).cast("bigint")
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(ms / 3_600_000).cast("bigint"), part(60_000, 60), part(1000, 60), ms % 1000)


def seconds_of(text: Column) -> Column:
    """Seconds of `h:m:s`, `m:s` or `s`; null for anything else."""
    ok = text.rlike(r"^\d+(:\d+){0,2}(\.\d+)?$")
    return F.when(ok, F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double")))


def rotated(items: Column, by: Column) -> Column:
    """items[by:] + items[:by]"""
    k = by.cast("int")
    return F.concat(F.slice(items, k + 1, F.size(items)), F.slice(items, F.lit(1), k))


def z_score(hits: Column, n: Column, p: float) -> Column:
    """Of a proportion; 0 where there is nothing."""
    return F.when(n > 0, (hits / n - p) / F.sqrt(F.lit(p * (1 - p)) / n)).otherwise(F.lit(0.0))


def interval_metrics(pred_start: Column, pred_end: Column, start: Column, end: Column) -> dict[str, Column]:
    """Of a predicted and a true interval; a reversed prediction is turned round, the union is the hull."""
    a, b = F.least(pred_start, pred_end), F.greatest(pred_start, pred_end)
    both = F.greatest(F.lit(0.0), F.least(b, end) - F.greatest(a, start))
    hull = F.greatest(b, end) - F.least(a, start)
    middle = (a + b) / 2
    return {
        "tiou": F.when(hull > 0, both / hull).otherwise(F.lit(0.0)),
        "center_inside": (middle >= start) & (middle <= end),
        "overlap_recall": F.when(end > start, both / (end - start)).otherwise(F.lit(0.0)),
        "pointing": both > 0,
        "start_error": a - start,
        "end_error": b - end,
        "abs_start_error": F.abs(a - start),
        "abs_end_error": F.abs(b - end),
        "pred_center": middle,
        "intersection": both,
    }


def clock_of_seconds(seconds: Column) -> Column:
    """HH:MM:SS.mmm; a fraction that rounds up to a second is carried to the seconds field only, so 59.9996 reads 00:00:60.000."""
    total = F.greatest(F.lit(0.0), seconds.cast("double"))
    whole = F.floor(total).cast("bigint")
    millis = F.bround((total - whole) * 1000, 0).cast("bigint")
    carry = (millis == 1000).cast("bigint")
    part = lambda div, mod: F.pmod(F.floor(whole / div).cast("bigint"), F.lit(mod).cast("bigint"))
    return F.format_string("%02d:%02d:%02d.%03d", F.floor(whole / 3600).cast("bigint"), part(60, 60), part(1, 60) + carry, F.when(carry == 1, 0).otherwise(millis))


def clock_of_remainder(seconds: Column) -> Column:
    """HH:MM:SS.mmm with the seconds as a rounded fraction."""
    seconds = seconds.cast("double")
    minute = F.floor(seconds / 60)
    return F.format_string("%02d:%02d:%06.3f", F.floor(seconds / 3600).cast("bigint"), F.pmod(minute.cast("bigint"), F.lit(60).cast("bigint")), seconds - minute * 60)


def frame_time(frame: Column, fps: Column) -> Column:
    return F.when(fps > 0, F.round(frame / fps, 3)).otherwise(F.lit(0.0))


def phase_frame(start: Column, end: Column, phase: Column) -> Column:
    """The frame at a share of a segment, halves to the even number."""
    return start + F.bround((end - start) * phase, 0).cast("bigint")


def loose_seconds(text: Column) -> Column:
    """Seconds of a number or of any count of fields apart by colons, an s at the end allowed; null for anything else."""
    bare = F.trim(F.regexp_replace(F.lower(F.trim(text)), "s+$", ""))
    ok = bare.rlike(r"^[-+]?\d*\.?\d+(:\d*\.?\d+)*$")
    return F.when(ok, F.aggregate(F.split(bare, ":"), F.lit(0.0), lambda a, p: a * 60 + p.cast("double")))


_NUMBER = r"(\d{1,2}:\d{2}:\d{2}(?:\.\d+)?|\d{1,2}:\d{2}(?:\.\d+)?|\d+(?:\.\d+)?)"
#: Two times with a dash, comma or `to` between.
INTERVAL = rf"(?i){_NUMBER}\s*(?:-|,|to)\s*{_NUMBER}"


def times_apart(text: Column) -> Column:
    """struct(start, end) in seconds of the first two times apart by a dash, comma or `to`; null fields if there are none."""
    time = lambda g: seconds_of(F.nullif(F.regexp_extract(text, INTERVAL, g), F.lit("")))
    return F.struct(time(1).alias("start"), time(2).alias("end"))


def interval_of_text(text: Column) -> Column:
    """struct(start, end) in seconds of a JSON object's fields, or of the first two times apart by a dash, comma or `to`; null fields if there are none."""
    from .answers import as_object, without_fence

    get = lambda v, k: F.try_variant_get(v, f"$.{k}", "string")
    seconds = lambda a, b: F.struct(seconds_of(a).alias("start"), seconds_of(b).alias("end"))
    said = times_apart

    def of_object(value: Column, bare: Column) -> Column:
        fields = F.struct(F.coalesce(get(value, "start"), get(value, "start_time")).alias("a"), F.coalesce(get(value, "end"), get(value, "end_time")).alias("b"), F.coalesce(get(value, "answer"), bare).alias("t"))
        return bound(fields, lambda f: F.when(f["a"].isNotNull() & f["b"].isNotNull(), seconds(f["a"], f["b"])).otherwise(said(f["t"])))

    def of_text(bare: Column) -> Column:
        # Only what begins as an object is parsed as one.
        return F.when(bare.startswith("{"), bound(as_object(bare), lambda v: of_object(v, bare))).otherwise(said(bare))

    return bound(F.translate(text, "–—到", "---"), lambda t: bound(without_fence(t), of_text))


def evenly(n: Column, frames: Column) -> Column:
    """n frame numbers in the middles of n even stretches; the middle frame for one."""
    last = frames - 1
    step = last / n
    many = F.transform(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1), lambda i: F.least(last, F.floor(step / 2 + F.bround(step * i, 0)).cast("bigint")))
    return F.when(n <= 1, F.array(F.floor(last / 2).cast("bigint"))).otherwise(many)


def at_rate(rate: Column, fps: Column, frames: Column) -> Column:
    """Frame numbers at a rate per second, at least one."""
    count = F.greatest(F.lit(1).cast("bigint"), F.floor(frames / fps * rate).cast("bigint"))
    return F.transform(F.sequence(F.lit(0).cast("bigint"), count - 1), lambda i: F.least(frames - 1, F.bround(i * fps / rate, 0).cast("bigint")))


def stride_walk(items: Column, k: Column, stride: int = 7919) -> Column:
    """All items, begun at k and taken at a stride (a prime, so each comes once where their number is no multiple of it)."""
    n = F.size(items)
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(items, F.pmod(k.cast("bigint") + i * stride, n).cast("int")))


def shift_within(duration: Column, tiou: float = 0.5) -> Column:
    """How far an interval of the right length may be shifted and still reach an overlap: a third of its length for one half."""
    return duration * ((1 - tiou) / (1 + tiou))
