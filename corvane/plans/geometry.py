"""Trajectories and vectors: queries over embeddings, cut into points or taken whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry as g
from ..operators import trajectories, vectors
from ..sources import table
from .registry import query


def _points(first: int, n: int, dimension: int, scale: str = "100") -> str:
    """Spark: n points from the first-th value on (from 0)."""
    return f"transform(sequence(0, {n - 1}), i -> transform(sequence(1, {dimension}), k -> element_at(e, {first} + i * {dimension} + k) * {scale}))"


def _sql_points(first: int, n: int, dimension: int, scale: str = "100") -> str:
    return f"list_transform(range({n}), lambda i: list_transform(range(1, {dimension + 1}), lambda k: e[CAST({first} + i * {dimension} + k AS INT)] * {scale}))"


# In every sixth row the left prediction is missing; in every fourth the right hand stands still.
_CURVES = {"el": _points(0, 5, 2), "er": f"transform({_points(10, 4, 2)}, p -> if(vec_id % 4 = 0, array(1.0D, 2.0D), p))", "pl": f"if(vec_id % 6 = 0, cast(array() as array<array<double>>), {_points(20, 4, 2)})", "pr": _points(30, 5, 2)}
_SQL_CURVES = {"el": _sql_points(0, 5, 2), "er": f"list_transform({_sql_points(10, 4, 2)}, lambda p: CASE WHEN vec_id % 4 = 0 THEN [1.0, 2.0]::DOUBLE[] ELSE p END)", "pl": f"CASE WHEN vec_id % 6 = 0 THEN []::DOUBLE[][] ELSE {_sql_points(20, 4, 2)} END", "pr": _sql_points(30, 5, 2)}
_BASE = "b AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings), c AS (SELECT vec_id, label, " + ", ".join(f"{v} AS {k}" for k, v in _SQL_CURVES.items()) + " FROM b)"


def curves(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").selectExpr("vec_id", "label", "cast(embedding as array<double>) as e")
    return rows.selectExpr("vec_id", "label", "e", *[f"{v} as {k}" for k, v in _CURVES.items()])


_D = "sqrt(list_sum(list_transform(range(1, len({0}) + 1), lambda q: ({0}[q] - {1}[q]) ** 2)))"


def _mins(a: str, b: str) -> str:
    return f"list_transform({a}, lambda x: list_min(list_transform({b}, lambda y: {_D.format('x', 'y')})))"


def _sql_frechet(a: str, b: str, n: int, m: int, name: str) -> str:
    """Columns of the table of an n by m Frechet distance, each made of those before it; the last has the name."""
    out = []
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            before = [f"{name}{x}_{y}" for x, y in ((i - 1, j), (i - 1, j - 1), (i, j - 1)) if x and y]
            dist = _D.format(f"{a}[{i}]", f"{b}[{j}]")
            out.append(f"greatest(least({', '.join(before)}), {dist}) AS {name}{i}_{j}" if before else f"{dist} AS {name}{i}_{j}")
    return ", ".join([*out, f"{name}{n}_{m} AS {name}"])


def _sql_metrics(tag: str, a: str, b: str, n: int, m: int) -> str:
    return f"greatest(list_max({_mins(a, b)}), list_max({_mins(b, a)})) AS h{tag}, list_avg({_mins(a, b)}) + list_avg({_mins(b, a)}) AS c{tag}, {_sql_frechet(a, b, n, m, 'f' + tag)}"


_LENGTH = "coalesce(list_sum(list_transform(range(1, len({0})), lambda i: " + _D.format("{0}[i]", "{0}[i + 1]") + ")), 0)"
_BOX = "sqrt(list_sum(list_transform([1, 2], lambda d: (list_max(list_transform({0}, lambda p: p[d])) - list_min(list_transform({0}, lambda p: p[d]))) ** 2)))"


@query(
    "v9_v14_curves",
    f"""WITH {_BASE}, m AS (SELECT *, {_sql_metrics('l', 'el', 'pl', 5, 4)} FROM c)
    SELECT vec_id, round(list_max(CASE WHEN len(pl) > 0 THEN {_mins('el', 'pl')} END), 6) AS directed, CASE WHEN len(pl) > 0 THEN round(hl, 6) END AS hausdorff, CASE WHEN len(pl) > 0 THEN round(cl, 6) END AS chamfer, CASE WHEN len(pl) > 0 THEN round(fl, 6) END AS frechet,
      round({_LENGTH.format('el')}, 6) AS length, round({_BOX.format('el')}, 6) AS extent, round({_D.format('el[1]', 'el[2]')}, 6) AS first_step FROM m""",
)
def v9(spark, d):
    a, b = F.col("el"), F.col("pl")
    named = {"directed": g.directed_hausdorff(a, b), "hausdorff": g.hausdorff(a, b), "chamfer": g.chamfer(a, b), "frechet": g.frechet(a, b), "length": g.path_length(a), "extent": g.extent(a), "first_step": g.euclidean(a[0], a[1])}
    return curves(spark, d).select("vec_id", *[F.round(v, 6).alias(k) for k, v in named.items()])


_SIDE = """CASE WHEN {len_l} < 1 AND {len_r} < 1 THEN 'unknown' WHEN {len_l} >= 1 AND {len_l} >= 2 * {len_r} THEN 'left_gripper' WHEN {len_r} >= 1 AND {len_r} >= 2 * {len_l} THEN 'right_gripper' ELSE 'both' END""".format(len_l=_LENGTH.format("el"), len_r=_LENGTH.format("er"))
_SCORED = f"""m AS (SELECT *, {_sql_metrics('l', 'el', 'pl', 5, 4)}, {_sql_metrics('r', 'er', 'pr', 4, 5)}, {_SIDE} AS active, 0.05 * sqrt(640.0 ** 2 + 480.0 ** 2) AS tol FROM c),
    s AS (SELECT *, {', '.join(f"CASE WHEN active IN ('{side}', 'both') THEN {f'CASE WHEN len(pl) > 0 THEN round({k}{t}, 6) END' if t == 'l' else f'round({k}{t}, 6)'} END AS d_{k}{t}, CASE WHEN active IN ('{side}', 'both') THEN {f'CASE WHEN len(pl) = 0 THEN 0.0 ELSE round(100 / (1 + ({k}{t} / tol) ** 2), 6) END' if t == 'l' else f'round(100 / (1 + ({k}{t} / tol) ** 2), 6)'} END AS s_{k}{t}" for k in 'hfc' for side, t in (('left_gripper', 'l'), ('right_gripper', 'r')))} FROM m),
    a AS (SELECT *, {', '.join(f"round(list_avg([d_{k}l, d_{k}r]), 6) AS m_{k}, round(list_avg([s_{k}l, s_{k}r]), 6) AS q_{k}" for k in 'hfc')}, active IN ('left_gripper', 'both') AND len(pl) = 0 AS failed FROM s),
    z AS (SELECT *, round(list_avg([q_h, q_f, q_c]), 6) AS score, CAST(CASE WHEN active IN ('left_gripper', 'both') THEN len(list_filter(pl, lambda p: p[1] < 0 OR p[1] >= 640 OR p[2] < 0 OR p[2] >= 480)) ELSE 0 END + CASE WHEN active IN ('right_gripper', 'both') THEN len(list_filter(pr, lambda p: p[1] < 0 OR p[1] >= 640 OR p[2] < 0 OR p[2] >= 480)) ELSE 0 END AS INT) AS outside FROM a)"""


def _scored(spark: SparkSession, d: str) -> DataFrame:
    rows = curves(spark, d).selectExpr("vec_id", "label", "named_struct('left_gripper', el, 'right_gripper', er) as expected", "named_struct('left_gripper', pl, 'right_gripper', pr) as predicted", "640 as width", "480 as height")
    return trajectories.scored(rows, 2)


@query("v15_v20_scored", f"WITH {_BASE}, {_SCORED} SELECT vec_id, active, round(m_h, 2) AS hausdorff, round(m_f, 2) AS frechet, round(m_c, 2) AS chamfer, round(q_h, 2) AS hausdorff_score, round(q_f, 2) AS frechet_score, round(q_c, 2) AS chamfer_score, round(score, 2) AS score, outside AS out_of_bounds, failed AS format_failure, outside > 0 AND vec_id % 2 < 1 AS retry FROM z")
def v15(spark, d):
    out = trajectories.retries(_scored(spark, d).withColumn("attempt", F.col("vec_id") % 2))
    return out.select("vec_id", "active", *[F.round(c, 2).alias(c) for c in (*g.METRICS, *[f"{k}_score" for k in g.METRICS], "score")], "out_of_bounds", "format_failure", "retry")


@query(
    "a6_a7_trajectory_summary",
    f"""WITH {_BASE}, {_SCORED}, r AS (SELECT *, vec_id % 7 <> 0 AS answered, vec_id % 7 = 0 AND vec_id % 2 = 0 AS err FROM z)
    SELECT label, count(*) AS total, count_if(answered) AS answered, count_if(err) AS errors, {', '.join(f"round(avg(CASE WHEN answered THEN m_{k[0]} END), 6) AS mean_{k}, round(avg(CASE WHEN answered THEN q_{k[0]} END), 6) AS mean_{k}_score" for k in g.METRICS)},
      round(avg(CASE WHEN NOT err THEN coalesce(score, 0.0) END), 6) AS mean_score, count_if(answered AND score IS NOT NULL) AS scored, count_if(NOT err AND (failed OR NOT answered)) AS format_failures, round(count_if(NOT err AND score IS NULL) / count(*), 6) AS unscored_rate FROM r GROUP BY label""",
)
def a6(spark, d):
    rows = _scored(spark, d).withColumn("answered", F.expr("vec_id % 7 <> 0")).withColumn("failed", F.expr("vec_id % 7 = 0 and vec_id % 2 = 0"))
    return trajectories.summary(rows, "label")


@query(
    "v15_tolerances",
    f"""WITH {_BASE}, t AS (SELECT *, list_transform(el, lambda p: [p[1] / 1000, p[2] / 1000, 0]) AS e3 FROM c) SELECT vec_id, round(greatest(10.0, 0.1 * {_BOX.format('el')}), 6) AS two, round(greatest(0.02, 0.1 * sqrt(list_sum(list_transform([1, 2, 3], lambda d: (list_max(list_transform(e3, lambda p: p[d])) - list_min(list_transform(e3, lambda p: p[d]))) ** 2)))), 6) AS three,
      CASE WHEN len(pl) = 0 THEN 50.0 ELSE round(greatest(10.0, 0.1 * {_BOX.format('pl')}), 6) END AS perhaps, round(0.05 * sqrt(300.0 ** 2 + 400.0 ** 2), 6) AS of_image FROM t""",
)
def v15b(spark, d):
    e3 = F.transform("el", lambda p: F.array(p[0] / 1000, p[1] / 1000, F.lit(0.0)))
    named = {"two": g.tolerance(F.col("el"), 2), "three": g.tolerance(e3, 3), "perhaps": g.tolerance(F.col("pl"), 2), "of_image": g.tolerance(F.col("el"), 2, F.lit(300), F.lit(400))}
    return curves(spark, d).select("vec_id", *[F.round(v, 6).alias(k) for k, v in named.items()])


@query(
    "v21_v24_validity",
    f"""WITH {_BASE}, r AS (SELECT vec_id, CASE vec_id % 6 WHEN 0 THEN [] WHEN 1 THEN pr WHEN 2 THEN list_transform(pr, lambda p: [p[1]]) WHEN 3 THEN list_transform(pr, lambda p: [p[1] / 1000, p[2] / 1000]) WHEN 4 THEN list_transform(pr, lambda p: [p[1] * 1000, p[2]]) ELSE list_transform(pr, lambda p: [5.0, 6.0]) END AS p, CASE WHEN vec_id % 12 = 1 THEN 40 ELSE 5 END AS n FROM c),
    m AS (SELECT *, list_max(list_transform(flatten(p), lambda x: abs(x))) AS most FROM r)
    SELECT vec_id, CASE WHEN len(p) < 2 THEN 'too few' WHEN vec_id % 6 = 2 THEN 'dimension' WHEN n = 40 THEN 'count' WHEN most <= 1.5 THEN 'normalised' WHEN most > 2560 THEN 'beyond the canvas' END AS reason, vec_id % 6 = 5 AS echo FROM m""",
)
def v21(spark, d):
    p = "case vec_id % 6 when 0 then cast(array() as array<array<double>>) when 1 then pr when 2 then transform(pr, p -> array(p[0])) when 3 then transform(pr, p -> array(p[0] / 1000, p[1] / 1000)) when 4 then transform(pr, p -> array(p[0] * 1000, p[1])) else transform(pr, p -> array(5.0D, 6.0D)) end"
    rows = curves(spark, d).selectExpr("vec_id", f"{p} as p", "if(vec_id % 12 = 1, 40, 5) as n")
    return rows.select("vec_id", g.refusal(F.col("p"), 2, F.col("n"), F.lit(640), F.lit(480)).alias("reason"), g.is_echo(F.col("p"), F.array(F.lit(5.0), F.lit(6.0))).alias("echo"))


_MID = "list_transform([1, 2], lambda d: list_avg(list_transform({0}, lambda p: p[d])))"
_SPREAD = "sqrt(list_avg(list_transform({0}, lambda p: (p[1] - {1}[1]) ** 2 + (p[2] - {1}[2]) ** 2)))"


@query(
    "v22_alignment",
    f"""WITH {_BASE}, k AS (SELECT *, {_MID.format('el')} AS ce, {_MID.format('pr')} AS cp FROM c), s AS (SELECT *, {_SPREAD.format('el', 'ce')} AS se, {_SPREAD.format('pr', 'cp')} AS sp FROM k)
    SELECT vec_id, round(se, 6) AS spread, round(pr[1][1] - cp[1] + ce[1], 6) AS centred_x, round(pr[5][2] - cp[2] + ce[2], 6) AS centred_y, round(cp[1] + (pr[1][1] - cp[1]) * se / sp, 6) AS scaled_x FROM s""",
)
def v22(spark, d):
    a, b = F.col("el"), F.col("pr")
    centred = g.recentred(b, g.centroid(a))
    named = {"spread": g.spread(a), "centred_x": centred[0][0], "centred_y": centred[4][1], "scaled_x": g.rescaled(b, g.spread(a) / g.spread(b))[0][0]}
    return curves(spark, d).select("vec_id", *[F.round(v, 6).alias(k) for k, v in named.items()])


_H = "list_sum(list_transform(range(1, 6), lambda k: (pr[k][{0}] - cp[{0}]) * (el[k][{1}] - ce[{1}])))"


@query(
    "v22_rotation",
    f"""WITH {_BASE}, k AS (SELECT *, {_MID.format('el')} AS ce, {_MID.format('pr')} AS cp FROM c), h AS (SELECT *, {_H.format(1, 1)} AS a, {_H.format(2, 1)} AS b, {_H.format(1, 2)} AS c_, {_H.format(2, 2)} AS d FROM k), u AS (SELECT *, CASE WHEN sqrt(a * a + b * b) > 1e-9 THEN a / sqrt(a * a + b * b) ELSE 1.0 END AS ux, CASE WHEN sqrt(a * a + b * b) > 1e-9 THEN b / sqrt(a * a + b * b) ELSE 0.0 END AS uy FROM h),
    w AS (SELECT *, c_ - (c_ * ux + d * uy) * ux AS vx, d - (c_ * ux + d * uy) * uy AS vy FROM u), n AS (SELECT *, CASE WHEN sqrt(vx * vx + vy * vy) > 1e-9 THEN vx / sqrt(vx * vx + vy * vy) ELSE 0.0 END AS wx, CASE WHEN sqrt(vx * vx + vy * vy) > 1e-9 THEN vy / sqrt(vx * vx + vy * vy) ELSE 1.0 END AS wy FROM w)
    SELECT vec_id, round((pr[1][1] - cp[1]) * ux + (pr[1][2] - cp[2]) * uy + ce[1], 6) AS x, round((pr[4][1] - cp[1]) * wx + (pr[4][2] - cp[2]) * wy + ce[2], 6) AS y FROM n""",
)
def v22_rotation(spark, d):
    turned = g.rotated_onto(F.col("pr"), F.col("el"), 2)
    rows = curves(spark, d).withColumn("t", turned)
    return rows.select("vec_id", F.round(F.col("t")[0][0], 6).alias("x"), F.round(F.col("t")[3][1], 6).alias("y"))


def _sql_curve_score(a: str, b: str, tol: str) -> str:
    return f"""(round(100 / (1 + (greatest(list_max({_mins(a, b)}), list_max({_mins(b, a)})) / {tol}) ** 2), 6) + round(100 / (1 + ((list_avg({_mins(a, b)}) + list_avg({_mins(b, a)})) / {tol}) ** 2), 6) + round(100 / (1 + (f{a}{b} / {tol}) ** 2), 6)) / 3"""


_STEPS = "list_transform(range(1, len({0})), lambda i: " + _D.format("{0}[i]", "{0}[i + 1]") + ")"
_DELTAS = "list_transform(range(1, len({0})), lambda i: [{0}[i + 1][1] - {0}[i][1], {0}[i + 1][2] - {0}[i][2]])"


@query(
    "v23_v25_dual",
    f"""WITH {_BASE}, t AS (SELECT vec_id, el, pr, el[2 :] AS a, pr[2 :] AS b, {_DELTAS.format('el')} AS da, {_DELTAS.format('pr')} AS db, list_reverse(el) AS back, greatest(10.0, 0.1 * {_BOX.format('el')}) AS tol, greatest(list_median({_STEPS.format('el')}) * 0.5, 0.000001) AS stp FROM c),
    r AS (SELECT *, back[2 :] AS rb FROM t), f AS (SELECT *, {_sql_frechet('a', 'b', 4, 4, 'fab')}, {_sql_frechet('da', 'db', 4, 4, 'fdadb')}, {_sql_frechet('a', 'rb', 4, 4, 'farb')} FROM r)
    SELECT vec_id, round({_sql_curve_score('a', 'b', 'tol')}, 2) AS position, round({_sql_curve_score('da', 'db', 'stp')}, 2) AS displacement, round({_sql_curve_score('a', 'rb', 'tol')}, 2) AS reversed_position, round((el[1][1] + el[5][1]) / 2, 6) AS half_way FROM f""",
)
def v23(spark, d):
    a = F.col("el")
    rows = curves(spark, d).withColumn("s", g.dual_score(a, F.col("pr"), 2)).withColumn("r", g.dual_score(a, g.baselines(a)["reversed"], 2))
    return rows.select("vec_id", F.round("s.position", 2).alias("position"), F.round("s.displacement", 2).alias("displacement"), F.round("r.position", 2).alias("reversed_position"), F.round(g.baselines(a)["straight"][2][0], 6).alias("half_way"))


# Vectors: pictures of two views of three families; ten neighbours are an item, the first its anchor.
_FRAMES = "SELECT vec_id AS key, 'f' || (vec_id % 3) AS family, 'v' || (vec_id % 2) AS view, label AS subtask, {e} AS vector FROM embeddings"
_RMS = "sqrt(list_sum(list_transform(range(1, len({0}) + 1), lambda i: ({0}[i] - {1}[i]) ** 2)) / len({0}))"


def frames(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").selectExpr("vec_id as key", "concat('f', vec_id % 3) as family", "concat('v', vec_id % 2) as view", "label as subtask", "cast(embedding as array<double>) as vector")


_F = f"f AS ({_FRAMES.format(e='CAST(embedding AS DOUBLE[])')})"


@query("a15_j9_floors", f"WITH {_F}, p AS (SELECT a.family, a.view, {_RMS.format('a.vector', 'b.vector')} AS d FROM f a JOIN f b ON a.family = b.family AND a.view = b.view AND a.key < b.key AND a.subtask <> b.subtask) SELECT family, view, round(quantile_cont(d, 0.25), 6) AS floor FROM p GROUP BY 1, 2 HAVING count(*) >= 10")
def a15(spark, d):
    return vectors.floors(frames(spark, d)).withColumn("floor", F.round("floor", 6))


@query("v1_v2_v4_distances", f"WITH {_F} SELECT a.key, round({_RMS.format('a.vector', 'b.vector')}, 6) AS rms, round(list_avg(list_transform(range(1, 65), lambda i: abs(a.vector[i] - b.vector[i]))), 6) AS mean_absolute, coalesce({_RMS.format('a.vector', 'b.vector')} >= 0.15, true) AS far FROM f a LEFT JOIN f b ON b.key = a.key + 7")
def v1(spark, d):
    a = frames(spark, d).select("key", "vector")
    both = a.join(a.select((F.col("key") - 7).alias("key"), F.col("vector").alias("other")), "key", "left")
    x, y = F.col("vector"), F.col("other")
    return both.select("key", F.round(F.when(y.isNotNull(), g.rms(x, y)), 6).alias("rms"), F.round(g.mean_absolute(x, y), 6).alias("mean_absolute"), (g.rms(x, y) >= 0.15).alias("far"))


@query("v3_floor_of", "WITH i AS (SELECT p_partkey, 'f' || (p_partkey % 4) AS family, p_partkey % 3 AS w FROM part) SELECT p_partkey, CASE WHEN family = 'f3' OR w = 2 THEN 0.0 WHEN w = 0 THEN CAST(substr(family, 2) AS INT) + 0.25 ELSE CAST(substr(family, 2) AS INT) + 0.125 END AS floor FROM i")
def v3(spark, d):
    items = table(spark, d, "part").selectExpr("p_partkey", "concat('f', p_partkey % 4) as family", "case p_partkey % 3 when 0 then array('a') when 1 then array('a', 'b', 'x') else array('x') end as views")
    floors = spark.createDataFrame([(f"f{k}", v, k + w) for k in range(3) for v, w in (("a", 0.25), ("b", 0.125))], "family string, view string, floor double")
    return vectors.floor_of(items, floors).select("p_partkey", "floor")


_ITEMS = f"i AS (SELECT key // 10 AS item, list({{'key': key, 'block': key % 3, 'subtask': subtask, 'vector': vector}} ORDER BY key) AS all_ FROM f GROUP BY 1 HAVING count(*) = 10)"


def items(spark: SparkSession, d: str) -> DataFrame:
    one = F.struct("key", (F.col("key") % 3).alias("block"), "subtask", "vector")
    return frames(spark, d).groupBy(F.expr("key div 10").alias("item")).agg(F.sort_array(F.collect_list(one)).alias("all")).filter("size(all) = 10")


def _sql_pick(n: int, floor: str, distinct: str | None) -> str:
    """Common tables that add one choice after the other to p0 (item, all_, c: the chosen)."""
    out = []
    for k in range(n):
        same = f" OR p.{distinct} = x.{distinct}" if distinct else ""
        free = f"list_filter(all_, lambda x: len(list_filter(c, lambda p: p.key = x.key{same})) = 0)"
        ranked = f"list_filter(list_transform({free}, lambda x: {{'gap': list_min(list_transform(c, lambda p: {_RMS.format('x.vector', 'p.vector')})), 'key': x.key, 'x': x}}), lambda r: r.gap >= {floor})"
        out.append(f"q{k} AS (SELECT item, all_, c, list_reverse_sort({ranked}) AS r FROM p{k}), p{k + 1} AS (SELECT item, all_, CASE WHEN len(r) > 0 THEN list_append(c, r[1].x) ELSE c END AS c FROM q{k})")
    return ", ".join(out)


@query(
    "v5_o4_spread",
    f"""WITH {_F}, {_ITEMS}, p0 AS (SELECT item, all_, [all_[1]] AS c FROM i), {_sql_pick(3, '0.13', None)}
    SELECT item, array_to_string(list_transform(c, lambda x: x.key), ',') AS chosen, len(c) = 4 AND len(list_distinct(list_transform(c[2 :], lambda x: x.block))) > 1 AS usable FROM p3""",
)
def v5(spark, d):
    chosen = vectors.spread_choice(F.col("all")[0], F.col("all"), F.lit(0.13), 3)
    rows = items(spark, d).withColumn("c", chosen)
    blocks = F.array_distinct(F.transform(F.slice("c", 2, 3), lambda x: x["block"]))
    return rows.select("item", F.concat_ws(",", F.transform("c", lambda x: x["key"].cast("string"))).alias("chosen"), ((F.size("c") == 4) & (F.size(blocks) > 1)).alias("usable"))


@query("v6_chain", f"WITH {_F}, {_ITEMS}, p0 AS (SELECT item, all_, [all_[1]] AS c FROM i), {_sql_pick(2, '0.1', 'subtask')} SELECT item, array_to_string(list_transform(c, lambda x: x.key), ',') AS chosen, len(c) = 3 AS usable FROM p2")
def v6(spark, d):
    rows = items(spark, d).withColumn("c", vectors.spread_choice(F.col("all")[0], F.col("all"), F.lit(0.1), 2, "subtask"))
    return rows.select("item", F.concat_ws(",", F.transform("c", lambda x: x["key"].cast("string"))).alias("chosen"), (F.size("c") == 3).alias("usable"))


@query(
    "v7_v8_blocks",
    f"""WITH {_F}, {_ITEMS}, t AS (SELECT item, all_, list_filter([3, 5, 7, 9], lambda k: list_min(list_transform([1, 2], lambda a: least({_RMS.format('all_[a].vector', 'all_[k].vector')}, {_RMS.format('all_[a].vector', 'all_[k + 1].vector')}))) >= 0.17) AS far FROM i)
    SELECT item, CAST(CASE WHEN len(far) > 0 THEN all_[far[1]].key END AS BIGINT) AS block, list_min(list_transform([1, 3, 4], lambda k: {_RMS.format('all_[2].vector', 'all_[k].vector')})) < 0.17 - 1e-6 AS answer_near,
      list_min([{', '.join(_RMS.format(f'all_[{a}].vector', f'all_[{b}].vector') for a in range(1, 5) for b in range(a + 1, 5))}]) < 0.17 - 1e-6 AS any_near FROM t""",
)
def v7(spark, d):
    vector = lambda k: F.col("all")[k]["vector"]
    blocks = F.array(*[F.struct(F.col("all")[k]["key"].alias("key"), F.array(vector(k), vector(k + 1)).alias("vectors")) for k in (2, 4, 6, 8)])
    options = F.array(*map(vector, range(4)))
    return items(spark, d).select(
        "item", vectors.first_far(F.array(vector(0), vector(1)), blocks, F.lit(0.17))["key"].alias("block"),
        vectors.too_near(options, F.lit(1), F.lit(0.17), False).alias("answer_near"), vectors.too_near(options, F.lit(1), F.lit(0.17), True).alias("any_near"),
    )
