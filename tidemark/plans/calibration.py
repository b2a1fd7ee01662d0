"""Calibration of each signal on cases that went through the whole pipeline.

The cases are the posts. What a post is made of says what is true of it, whatever the signals say: phrases that provoke, false
claims, calls for help, denials, and whether its picture is shown as the index has it. Half of the cases fits a curve for each
signal, the other half measures it; all signals are fitted by one grouped job over counts by score.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dialect import DUCKDB, SPARK, Dialect, interpolated, names_in, number, stepped_sql
from ..operators.isotonic import bends, calibrated, calibration_error, counted
from ..scratch import materialize
from . import evaluation, posts, provenance
from .portable import duckdb_sql, spark_query

#: Cases a signal needs, and knots that are kept of its curve.
LEAST_CASES, KNOTS, GRID_POINTS = 30, 12, 8
#: Phrases, by their places, that make it true that a post provokes, spreads a false claim, calls for help, denies.
PROVOKING, FALSE, HELP, DENYING = (1, 2, 3, 5, 6, 9, 13, 15), (0, 1, 2, 8), (4, 15), (4, 12)
#: What a calibrated score must be able to reach: to decide, else the curve isn't used; to raise the level, else it is only noted.
DECIDES = {"synthetic.video": lx.SYNTHETIC, "multimodal.scene_claim": lx.SCENE, "knowledge.verdict": lx.CONTRADICTED, "text.manipulative": lx.PROVOCATIVE, "provenance.match": lx.CONTEXT}
RAISES = {"knowledge.verdict": lx.HIGH_CONFIDENCE, "synthetic.video": lx.HIGH_CONFIDENCE, "provenance.match": lx.HIGH_CONFIDENCE}
FITS = "substr(md5(cast(id as varchar(20))), 1, 1) < '8'"


def truths(d: Dialect) -> dict[str, str]:
    """By signal: what is true of a post."""
    opener, middle, closer = (f"({d.div(f'post_id * {a}', str(b))} % 16)" for a, b in ((1, 3), (5, 7), (11, 13)))
    return {
        "text.manipulative": f"{closer} in {PROVOKING}", "text.help_call": f"{opener} in {HELP}", "text.debunk": f"({closer} in {DENYING} or {opener} = 8)", "knowledge.verdict": f"{middle} in {FALSE}",
        "provenance.match": f"post_id % {len(provenance.SHOWN)} <> 3",
    }


def case_rows(d: Dialect) -> str:
    """``(id, key, s, y)`` of all posts and signals that don't abstain."""
    items = [{"key": f"'{k}'", "s": f"cast({posts.SIGNALS[k]} as double)", "y": f"case when {t} then 1 else 0 end"} for k, t in truths(d).items()]
    return d.several("post_id as id", items, "posts", "s is not null").replace("select post_id as id, item", "select id, item")


def signal_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The posts' signals with what is true, each post run through the pipeline once, and which half it is of."""
    sql = case_rows(SPARK)
    rows = spark.sql(sql.replace(" posts", " {posts}"), posts=posts.posts(spark, sf_dir, "fusion", names_in(sql)))
    return rows.withColumn("fit", F.expr(FITS.replace("varchar(20)", "string")))


def detector_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of a detector over labelled documents, as cases of one signal."""
    sql = evaluation.eval_rows(SPARK) + " select doc_id as id, 'synthetic.video' as key, every_s as s, y from t"
    return spark_query(sql)(spark, sf_dir).withColumn("fit", F.expr(FITS.replace("varchar(20)", "string")))


def usable(counts: DataFrame) -> DataFrame:
    """The counts of signals with enough cases, of both kinds, also in the half that fits."""
    both = counts.groupBy("key").agg(F.sum("n").alias("all"), F.sum("y").alias("true"), F.sum(F.when(F.col("fit"), F.col("n"))).alias("fits")).where((F.col("all") >= LEAST_CASES) & (F.col("true") > 0) & (F.col("true") < F.col("all")) & (F.col("fits") > 0))
    return counts.join(both.select("key"), "key", "left_semi")


def set_score(d: Dialect) -> str:
    """What the knots that are set make of a score."""
    whens = " ".join(f"when key = '{k}' then {interpolated('s', knots)}" for k, knots in lx.KNOTS.items())
    return f"(case {whens} else s end)"


def measured(cases: DataFrame) -> DataFrame:
    """A row a signal: cases, those that fit and measure, errors before and after, the curve's top, and whether it can be used."""
    rows = materialize(calibrated(usable(counted(cases))).withColumn("before", F.expr(set_score(SPARK))))
    halves = rows.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("fit"), F.col("n"))).alias("n_fit"), F.coalesce(F.sum(F.when(~F.col("fit"), F.col("n"))), F.lit(0)).alias("n_measure"), F.max(F.when(F.col("fit"), F.col("p"))).alias("top"))
    rest = rows.where("not fit")
    out = halves.join(calibration_error(rest, "before").withColumnRenamed("ece", "ece_before"), "key", "left").join(calibration_error(rest, "p").withColumnRenamed("ece", "ece_after"), "key", "left")
    reach = lambda bounds: F.expr("case " + " ".join(f"when key = '{k}' then top >= {number(v)}" for k, v in bounds.items()) + " else true end")
    return out.withColumns({"used": reach(DECIDES), "raises": reach(RAISES)})


def signal_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measured(signal_cases(spark, sf_dir))


def signal_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each signal's curve at the scores that fitted it."""
    return calibrated(usable(counted(signal_cases(spark, sf_dir)))).where("fit").select("key", "s", "n", "p")


def signal_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What would be set: the knots of the curves."""
    return bends(signal_curves(spark, sf_dir), KNOTS)


def detector_calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One detector, measured on its own cases; nothing is set by it."""
    return measured(detector_cases(spark, sf_dir))


def detector_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The detector's curve at ``GRID_POINTS`` even places between its least and greatest score."""
    rows = materialize(counted(detector_cases(spark, sf_dir)))
    ends = rows.groupBy("key").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    k = F.explode(F.sequence(F.lit(0), F.lit(GRID_POINTS - 1)))
    asked = ends.select("key", k.alias("k"), "lo", "hi").select("key", F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("k") / (GRID_POINTS - 1), 4).alias("s"), F.lit(False).alias("fit"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("y"))
    return calibrated(rows.where("fit").union(asked)).where("n = 0").select("s", F.round("p", 4).alias("p"))


QUERIES = {q.__name__: q for q in (signal_calibration, signal_curves, signal_knots, detector_calibration, detector_grid)}


def _curve_sql(cases: str) -> str:
    """Counts, and the curve by its definition: the largest, over starts, of the least, over ends, of the means of what lies between."""
    return f"""cs as (select key, round(s * 10000) / 10000.0::double as s, {FITS} as fit, y from ({cases}) q where s is not null),
ct as (select key, s, fit, count(*) as n, sum(y)::bigint as y from cs group by key, s, fit),
us as (select key from ct group by key having sum(n) >= {LEAST_CASES} and sum(y) > 0 and sum(y) < sum(n) and count_if(fit) > 0), cu as (select ct.* from ct join us using (key)),
o as (select key, s, n as own, row_number() over w as i, sum(n) over w as n, sum(y) over w as y from cu where fit window w as (partition by key order by s)),
m as (select a.key, a.i as a, b.i as b, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0)) as mean from o a join o b on b.key = a.key and b.i >= a.i left join o z on z.key = a.key and z.i = a.i - 1),
l as (select m.key, m.a, o.i, min(m.mean) as low from m join o on o.key = m.key and o.i >= m.a and m.b >= o.i group by m.key, m.a, o.i),
curve as (select o.key, o.s, o.own as n, max(l.low) as p from l join o on o.key = l.key and o.i = l.i group by o.key, o.s, o.own)"""


def _at_sql(asked: str) -> str:
    """``drawn``: each of ``asked(key, s, ..)`` with ``p``, straight between the curve's scores."""
    return f"""drawn as (select x.*, round(case when lo.s is null then hi.p when hi.s is null or hi.s = lo.s then lo.p else lo.p + (hi.p - lo.p) * (x.s - lo.s) / (hi.s - lo.s) end, 6) as p from {asked} x
    asof left join curve lo on lo.key = x.key and lo.s <= x.s asof left join curve hi on hi.key = x.key and hi.s >= x.s)"""


def _measured_sql(cases: str) -> str:
    error = lambda score: f"select key, round(sum(abs(c - y)) / sum(n), 4) as ece from (select key, greatest(ceil(round({score} * 10, 6)), 1) as bin, sum(n) as n, sum(n * {score}) as c, sum(y) as y from dr where not fit group by 1, 2) q group by key"
    reach = lambda bounds: "case " + " ".join(f"when key = '{k}' then top >= {number(v)}" for k, v in bounds.items()) + " else true end"
    return f"""{_curve_sql(cases)}, {_at_sql('cu')}, dr as (select *, {set_score(DUCKDB)} as before from drawn), h as (select key, sum(n)::bigint as n, sum(case when fit then n end)::bigint as n_fit, coalesce(sum(case when not fit then n end), 0)::bigint as n_measure, max(case when fit then p end) as top from dr group by key),
eb as ({error('before')}), ea as ({error('p')})
select h.key, n, n_fit, n_measure, top, eb.ece as ece_before, ea.ece as ece_after, {reach(DECIDES).replace('key =', 'h.key =')} as used, {reach(RAISES).replace('key =', 'h.key =')} as raises from h left join eb on eb.key = h.key left join ea on ea.key = h.key"""


_POSTS = stepped_sql(posts.BASE, posts.steps(DUCKDB, "fusion"))
_CASES = case_rows(DUCKDB)
_DETECTOR = duckdb_sql(evaluation.eval_rows(DUCKDB))
_SCORES = "select doc_id as id, 'synthetic.video' as key, every_s as s, y from t"
SQL = {
    "signal_calibration": f"{_POSTS}, {_measured_sql(_CASES)}",
    "signal_curves": f"{_POSTS}, {_curve_sql(_CASES)} select key, s, n, round(p, 6) as p from curve",
    "detector_calibration": f"{_DETECTOR}, {_measured_sql(_SCORES)}",
    "detector_grid": f"""{_DETECTOR}, {_curve_sql(_SCORES)}, e as (select key, min(s) as lo, max(s) as hi from ct group by key), a as (select key, round(lo + (hi - lo) * k / {GRID_POINTS - 1}::double, 4) as s from e cross join range({GRID_POINTS}) r(k)), {_at_sql('a')}
select s, round(p, 4) as p from drawn""",
}
