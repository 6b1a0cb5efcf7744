"""Ways to choose the options of a question that is asked without its media."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import bound, rotated
from ..functions.words import n_words
from .questions import md5_mod_of


def _turned(texts: Column, by: Column) -> Column:
    """The texts begun at the md5 of `by` modulo their number."""
    turn = lambda t: bound(md5_mod_of(by, F.size(t)).cast("int"), lambda k: rotated(t, k))
    return bound(texts, lambda t: F.when(F.size(t) > 0, turn(t)).otherwise(t))


def _nearest(texts: Column, answer: Column) -> Column:
    """The texts by how near their number of words is to the answer's, equal ones in their order."""
    ranked = lambda n: F.array_sort(F.transform(texts, lambda t, i: F.struct(F.abs(n_words(t) - n).alias("d"), i.alias("i"), t.alias("t"))))
    return bound(n_words(answer), lambda n: F.transform(ranked(n), lambda x: x["t"]))


def options(policy: str, item: Column, answer: Column, distractors: Column, actions: Column, outside: Column, pool: Column) -> Column:
    """The answer and the other options of a policy.

    as_built: the distractors of the item. allreal, three: four or two of the family's other actions, sorted, from the
    md5 of the item on. pool: four of these, not sorted, and of the pool, the nearest in words first. cross, four: four
    or three of the family's other actions from the md5 of the item on, and then of those outside.
    """
    others = F.filter(actions, lambda a: a != answer)
    if policy == "as_built":
        more = distractors
    elif policy in ("allreal", "three"):
        more = F.slice(_turned(F.array_sort(others), item), 1, 4 if policy == "allreal" else 2)
    elif policy == "pool":
        more = F.slice(_nearest(F.concat(_turned(others, item), F.filter(pool, lambda t: t != answer)), answer), 1, 4)
    elif policy in ("cross", "four"):
        borrowed = _nearest(_turned(outside, F.concat(item, F.lit("|x"))), answer)
        more = F.slice(F.concat(_turned(others, item), borrowed), 1, 4 if policy == "cross" else 3)
    else:
        raise ValueError(f"no policy {policy}")
    return F.concat(F.array(answer), more)
