"""Curves of points (arrays of coordinates) and vectors: distances, scores, alignment. Column expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import bound


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _mean(values: Column) -> Column:
    return F.when(F.size(values) > 0, _sum(values) / F.size(values))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))))


def rms(a: Column, b: Column) -> Column:
    """Root of the mean squared difference; infinite where a vector is missing."""
    return F.when(a.isNull() | b.isNull(), F.lit(float("inf"))).otherwise(F.sqrt(_sum(F.zip_with(a, b, lambda x, y: (x - y) * (x - y))) / F.size(a)))


def mean_absolute(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: F.abs(x - y))) / F.size(a)


def _nearest(a: Column, b: Column) -> Column:
    return F.transform(a, lambda x: F.array_min(F.transform(b, lambda y: euclidean(x, y))))


def _both(a: Column, b: Column, value: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), value)


def directed_hausdorff(a: Column, b: Column) -> Column:
    return _both(a, b, F.array_max(_nearest(a, b)))


def hausdorff(a: Column, b: Column) -> Column:
    return _both(a, b, F.greatest(F.array_max(_nearest(a, b)), F.array_max(_nearest(b, a))))


def chamfer(a: Column, b: Column) -> Column:
    """The two directed means added up."""
    return _both(a, b, _mean(_nearest(a, b)) + _mean(_nearest(b, a)))


def frechet(a: Column, b: Column) -> Column:
    """Discrete Frechet distance: one row of the table is carried over the points of a."""
    none = F.array().cast("array<double>")

    def row(before: Column, x: Column) -> Column:
        def cell(now: Column, j: Column) -> Column:
            reach = F.least(F.get(before, j), F.get(before, j - 1), F.get(now, j - 1))  # nulls do not count
            return F.array_append(now, F.greatest(reach, euclidean(x, F.get(b, j))))

        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), none, cell)

    return _both(a, b, F.element_at(F.aggregate(a, none, row), -1))


def steps(points: Column) -> Column:
    """Distances of neighbours; none for fewer than two points."""
    return F.when(F.size(points) > 1, F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: euclidean(F.get(points, i), F.get(points, i + 1)))).otherwise(F.array().cast("array<double>"))


def path_length(points: Column) -> Column:
    return _sum(steps(points))


def deltas(points: Column) -> Column:
    return F.when(F.size(points) > 1, F.transform(F.sequence(F.lit(0), F.size(points) - 2), lambda i: F.zip_with(F.get(points, i + 1), F.get(points, i), lambda x, y: x - y))).otherwise(F.array().cast("array<array<double>>"))


def extent(points: Column) -> Column:
    """Diagonal of the box around the points, null without any."""
    axis = lambda d: F.transform(points, lambda p: F.get(p, d))
    sides = F.transform(F.sequence(F.lit(0), F.size(F.get(points, F.lit(0))) - 1), lambda d: F.array_max(axis(d)) - F.array_min(axis(d)))
    return F.when(F.size(points) > 0, F.sqrt(_sum(F.transform(sides, lambda s: s * s))))


def tolerance(points: Column, dimension: int, width: Column | None = None, height: Column | None = None) -> Column:
    """In two dimensions a twentieth of the image's diagonal if that is known, else a tenth of the extent, at least 10, or 50 without points; in three a tenth of the extent, at least 0.02, or 0.05."""
    least, without = (10.0, 50.0) if dimension == 2 else (0.02, 0.05)
    own = F.coalesce(F.greatest(F.lit(least), 0.1 * extent(points)), F.lit(without)) if dimension else None
    own = F.when(F.size(points) > 0, own).otherwise(F.lit(without))
    return own if dimension == 3 or width is None else F.when(width.isNotNull() & height.isNotNull(), 0.05 * F.hypot(width, height)).otherwise(own)


def score_of_distance(distance: Column, tolerance: Column) -> Column:
    """100 / (1 + (d / tolerance)^2); null without a distance or a positive tolerance."""
    return F.when(distance.isNotNull() & (tolerance > 0), 100 / (1 + (distance / tolerance) * (distance / tolerance)))


METRICS = {"hausdorff": hausdorff, "frechet": frechet, "chamfer": chamfer}


def mean_available(*values: Column) -> Column:
    """Of those that are not null; null without any."""
    return _mean(F.array_compact(F.array(*values)))


def curve_score(expected: Column, predicted: Column, tolerance: Column, zero_unscored: bool = True) -> Column:
    """struct of the three distances, their scores, their mean, and whether a prediction is missing where there is a truth, which scores 0 if so wanted."""

    def scored(c: Column) -> Column:
        failed = (F.size(c["e"]) > 0) & (F.size(c["p"]) == 0)
        distances = F.struct(*[f(c["e"], c["p"]).alias(k) for k, f in METRICS.items()], failed.alias("failed"), c["t"].alias("t"))

        def finished(d: Column) -> Column:
            score = lambda k: F.round(score_of_distance(d[k], d["t"]), 6)
            scores = {k: F.when(d["failed"], F.lit(0.0)).otherwise(score(k)) if zero_unscored else score(k) for k in METRICS}
            fields = [F.round(d[k], 6).alias(k) for k in METRICS] + [v.alias(f"{k}_score") for k, v in scores.items()]
            return F.struct(*fields, F.round(mean_available(*scores.values()), 6).alias("score"), (d["failed"] if zero_unscored else F.lit(False)).alias("format_failure"))

        return bound(distances, finished)

    return bound(F.struct(expected.alias("e"), predicted.alias("p"), tolerance.alias("t")), scored)


def active_gripper(left: Column, right: Column, dimension: int, given: Column | None = None) -> Column:
    """The side given, else the one whose path is at least twice the other's; unknown if both stand still, both otherwise."""
    still = 1.0 if dimension == 2 else 0.01
    a, b = path_length(left), path_length(right)
    found = F.when((a < still) & (b < still), "unknown").when((a >= still) & (a >= 2 * b), "left_gripper").when((b >= still) & (b >= 2 * a), "right_gripper").otherwise("both")
    return found if given is None else F.when(given.isin("left_gripper", "right_gripper", "both", "unknown"), given).otherwise(found)


def out_of_bounds(points: Column, width: Column, height: Column) -> Column:
    """Points outside of the image, none where its size is not known."""
    outside = F.filter(points, lambda p: (F.get(p, F.lit(0)) < 0) | (F.get(p, F.lit(0)) >= width) | (F.get(p, F.lit(1)) < 0) | (F.get(p, F.lit(1)) >= height))
    return F.when(width.isNotNull() & height.isNotNull(), outside).otherwise(F.slice(points, F.lit(1), F.lit(0)))


def refusal(points: Column, dimension: int, expected: Column, width: Column | None = None, height: Column | None = None) -> Column:
    """Why a trajectory is none: too few points, wrong width, far more or fewer than expected, or coordinates of another unit; null if it is one."""
    n, most = F.size(points), F.array_max(F.transform(F.flatten(points), F.abs))
    out = F.when(n < 2, "too few").when(F.exists(points, lambda p: F.size(p) != dimension), "dimension").when((expected > 0) & ((n < expected / 4) | (n > expected * 4)), "count")
    if dimension == 3:
        return out.when(most > 3.0, "not metres")
    return out if width is None else out.when(most <= 1.5, "normalised").when(most > 4 * F.greatest(width, height), "beyond the canvas")


def centroid(points: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(F.get(points, F.lit(0))) - 1), lambda d: _mean(F.transform(points, lambda p: F.get(p, d))))


def recentred(points: Column, target: Column) -> Column:
    c = centroid(points)
    return F.transform(points, lambda p: F.zip_with(F.zip_with(p, c, lambda x, y: x - y), target, lambda x, y: x + y))


def spread(points: Column) -> Column:
    c = centroid(points)
    return F.sqrt(_mean(F.transform(points, lambda p: _sum(F.zip_with(p, c, lambda x, y: (x - y) * (x - y))))))


def rescaled(points: Column, factor: Column) -> Column:
    c = centroid(points)
    return F.transform(points, lambda p: F.zip_with(p, c, lambda x, y: y + (x - y) * factor))


def rotated_onto(points: Column, target: Column, dimension: int) -> Column:
    """The points turned about their middle towards the target, and moved to the target's middle; as they are if they are not as many.

    The turn is the basis that Gram-Schmidt makes of the columns of the covariance of both; where a column has nothing
    left, the unit vector of its place stands.
    """
    axes = F.sequence(F.lit(0), F.lit(dimension - 1))
    less = lambda ps, c: F.transform(ps, lambda p: F.zip_with(p, c, lambda x, y: x - y))
    dot = lambda a, b: _sum(F.zip_with(a, b, lambda x, y: x * y))
    column = lambda s, j: F.transform(axes, lambda i: _sum(F.zip_with(s["p"], s["q"], lambda x, y: F.get(x, i) * F.get(y, j))))
    apart = lambda basis, v: F.aggregate(basis, v, lambda left, b: bound(dot(left, b), lambda d: F.zip_with(left, b, lambda x, y: x - d * y)))
    unit = lambda basis: F.transform(axes, lambda i: F.when(i == F.size(basis), 1.0).otherwise(0.0))
    scaled = lambda basis, v: bound(F.sqrt(dot(v, v)), lambda n: F.when(n > 1e-9, F.transform(v, lambda x: x / n)).otherwise(unit(basis)))
    grown = lambda basis, v: F.array_append(basis, bound(apart(basis, v), lambda left: scaled(basis, left)))
    bases = lambda s: F.aggregate(F.transform(axes, lambda j: column(s, j)), F.array().cast("array<array<double>>"), grown)
    turned = lambda s: bound(bases(s), lambda b: F.transform(s["p"], lambda x: F.transform(b, lambda v: dot(x, v))))
    middle = centroid(target)
    centred = F.struct(less(points, centroid(points)).alias("p"), less(target, middle).alias("q"))
    moved = bound(centred, lambda s: F.transform(turned(s), lambda p: F.zip_with(p, middle, lambda x, y: x + y)))
    return F.when(F.size(points) == F.size(target), moved).otherwise(points)


def dual_score(truth: Column, predicted: Column, dimension: int) -> Column:
    """struct(position, displacement): scores of the points after the first, and of the steps between points, whose tolerance is half the median step; 0 for fewer than three true or two predicted points."""
    least = 10.0 if dimension == 2 else 0.02
    tail = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p), F.lit(1)))
    long = (F.size(truth) >= 3) & (F.size(predicted) >= 2)
    sizes = F.array_sort(steps(truth))
    half = F.floor(F.size(sizes) / 2).cast("int")
    median = F.when(F.size(sizes) % 2 == 1, F.get(sizes, half)).otherwise((F.get(sizes, half - 1) + F.get(sizes, half)) / 2)
    near = curve_score(tail(truth), tail(predicted), F.greatest(F.lit(least), 0.1 * F.coalesce(extent(truth), F.lit(0.0))))["score"]
    moves = curve_score(deltas(truth), deltas(predicted), F.greatest(F.coalesce(F.nullif(median, F.lit(0.0)), F.lit(1e-6)) * 0.5, F.lit(1e-6)))["score"]
    return F.struct(F.when(long, F.coalesce(near, F.lit(0.0))).otherwise(0.0).alias("position"), F.when(long, F.coalesce(moves, F.lit(0.0))).otherwise(0.0).alias("displacement"))


def is_echo(points: Column, example: Column) -> Column:
    return (F.size(points) > 0) & F.forall(points, lambda p: p == example)


def baselines(truth: Column) -> dict[str, Column]:
    """Answers that know nothing of the way: the first point repeated, the straight line, the way back."""
    first, last, n = F.get(truth, F.lit(0)), F.element_at(truth, -1), F.size(truth)
    line = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.zip_with(first, last, lambda a, b: a + (b - a) * (k / F.greatest(n - 1, F.lit(1)))))
    return {"repeated": F.transform(truth, lambda _: first), "straight": line, "reversed": F.reverse(truth)}
