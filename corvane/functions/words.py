"""Words of labels: verb, object and modifier, narration, swaps, gates. Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound

# Fixed values of the label vocabulary.
ARTICLES = ("the", "a", "an")
PARTICLES = ("up", "down", "off", "out", "in", "on", "over", "back", "away")
NARRATION_PARTICLES = ("up", "down", "in", "on", "out", "off", "over", "away", "aside", "into", "onto", "back", "together", "apart")
PREPOSITIONS = ("with", "in", "on", "into", "onto", "to", "from", "at")
TAKE = ("pick", "pick up", "take", "grasp")
DROP = ("put", "place", "put down")
SET_VERBS = ("pick", "put", "take", "set", "lift")
PREFIX = r"^\s*[A-Za-z]*\d+\s*[:：.\-]\s*"


def key(text: Column) -> Column:
    """Lower case, no final stops, no articles, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), r"\.+$", ""), r"\b(the|a|an)\b", " ")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def n_words(text: Column) -> Column:
    return bound(key(text), lambda k: F.when(k == "", 0).otherwise(F.size(F.split(k, " "))))


def parsed(text: Column) -> Column:
    """struct(verb, object, modifier): the first word and a particle after it; the rest up to the first preposition; and from it on."""
    words = F.filter(F.split(key(text), " "), lambda w: w != "")
    has_particle = F.coalesce(F.get(words, F.lit(1)).isin(*PARTICLES), F.lit(False))
    n_verb = F.when(has_particle, 2).otherwise(1)
    rest = F.when(F.size(words) > 0, F.slice(words, n_verb + 1, F.greatest(F.size(words), F.lit(1)))).otherwise(words)
    cut = F.coalesce(F.nullif(F.array_position(F.transform(rest, lambda w: w.isin(*PREPOSITIONS)), True).cast("int"), F.lit(0)), F.size(rest) + 1)
    part = lambda a, b: F.concat_ws(" ", F.slice(rest, a, b))
    return F.struct(F.concat_ws(" ", F.slice(words, F.lit(1), n_verb)).alias("verb"), part(F.lit(1), cut - 1).alias("object"), part(cut, F.size(rest) + 1).alias("modifier"))


def class_text(line: Column) -> Column:
    """Without the number before a class, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(line, PREFIX, ""), r"\s+", " "))


def described(line: Column) -> Column:
    """struct(object, verb, narration) of a class whose first word is its verb: an article goes in after the particles, if there is none."""
    words = F.filter(F.split(F.regexp_replace(class_text(line), r"\.+$", ""), r"\s+"), lambda w: w != "")
    rest = F.slice(words, F.lit(2), F.greatest(F.size(words), F.lit(1)))
    out = F.transform(rest, lambda w: ~F.lower(w).isin(*NARRATION_PARTICLES))
    lead = F.coalesce(F.nullif(F.array_position(out, True).cast("int"), F.lit(0)), F.size(rest) + 1) - 1
    tail = F.slice(rest, lead + 1, F.size(rest) + 1)
    given = F.coalesce(F.lower(F.get(tail, F.lit(0))).isin(*ARTICLES), F.lit(False))
    object_ = F.when(given, F.slice(tail, F.lit(2), F.size(tail) + 1)).otherwise(tail)
    article = F.when(F.size(object_) == 0, F.array().cast("array<string>")).when(given, F.slice(tail, F.lit(1), F.lit(1))).otherwise(F.array(F.lit("the")))
    body = F.concat_ws(" ", F.slice(words, F.lit(1), F.lit(1)), F.slice(rest, F.lit(1), lead), article, object_)
    text = F.when(F.size(words) > 0, F.concat(F.lit(" "), F.upper(F.substring(body, 1, 1)), F.substring(body, 2, 1 << 30), F.lit("."))).otherwise(F.lit(""))
    return F.struct(F.concat_ws(" ", object_).alias("object"), F.lower(F.coalesce(F.get(words, F.lit(0)), F.lit(""))).alias("verb"), text.alias("narration"))


def swapped(text: Column, old: Column, new: Column) -> Column:
    """The first whole occurrence of old, whatever its case, replaced by new, the first letter upper-cased; null if there is none or nothing to swap."""
    at = F.regexp_instr(text, F.concat(F.lit(r"(?i)\b"), F.regexp_replace(old, r"([^A-Za-z0-9 ])", r"\\$1"), F.lit(r"\b")))
    out = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    good = (at > 0) & (old != "") & (new != "") & (old != new)
    return F.when(good, F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, 2, 1 << 30)))


def refusal(text: Column, correct: Column, family_keys: Column, taken: Column) -> Column:
    """The first rule that a distractor breaks, null if none: form, wellformed, not_correct, unique, length, parses."""
    got = parsed(text)
    malformed = rf"\b({'|'.join(SET_VERBS)})\s+the\s+({'|'.join(PARTICLES)})\b"
    return (
        F.when(~text.rlike(r"^[A-Z][a-z]+(?: [a-z]+)*\.$"), "form").when(F.lower(text).rlike(malformed), "wellformed").when(F.array_contains(family_keys, key(text)), "not_correct")
        .when(F.array_contains(taken, key(text)), "unique").when(F.abs(n_words(text) - n_words(correct)) > 1, "length").when((got["verb"] == "") | (got["object"] == ""), "parses")
    )
