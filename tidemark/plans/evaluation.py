"""Evaluation of detectors over labelled documents: calibration, thresholds, transforms, outcomes, latency, clusterings.

A document's score stands for a detector's output, its quality label for the truth; every seventeenth document is one on which
the detector abstains. Rates are worked out from counts by distinct score, so that no task sees all rows.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import DUCKDB, SPARK, Dialect
from .portable import SCORED, duckdb_sql, spark_query
from .posts import quoted

#: Knots that are kept of a calibration curve.
KNOTS = 12
REASONS = ["too small (edge)", "too small (area)", "no signal", "unreadable", "too long", "wrong kind"]


def eval_rows(d: Dialect) -> str:
    """``t(doc_id, lang, source, y, s, ms, reason, truth, guess)``; ``s`` is null where the detector abstains."""
    scored = SCORED.replace("4000.0", "4000e0").replace("1000.0", "1000e0")
    reason = d.at(d.array(*map(quoted, REASONS)), "doc_id % 6")
    return f"""with q as ({scored}), t as (select doc_id, lang, source, y, toxic, s as every_s, case when doc_id % 17 = 0 then null else s end as s, (doc_id * 37 % 500) / 10e0 as ms, case when doc_id % 17 = 0 then trim({d.at(d.split(reason, '[(]'), '0')}) end as reason,
        y + toxic as truth, case when s < 0.1e0 then 0 when s < 0.5e0 then 1 else 2 end as guess from q)"""


def queries(d: Dialect) -> dict[str, str]:
    t = eval_rows(d)
    # per class: hits, truths, guesses
    f1 = "k as (select distinct truth as c from t), f as (select k.c, sum(case when t.truth = k.c and t.guess = k.c then 1 else 0 end) as tp, sum(case when t.truth = k.c then 1 else 0 end) as truths, sum(case when t.guess = k.c then 1 else 0 end) as guesses from t join k on t.truth = k.c or t.guess = k.c group by k.c)"
    transforms = " union all ".join(f"select '{n}' as transform, doc_id, y, {e} as s from t" for n, e in {"none": "s", "crop": "s * 0.9e0", "blur": "case when doc_id % 5 = 0 then null else s * 0.8e0 end", "noise": "least(1e0, s + 0.1e0)", "recompress": "s * s"}.items())
    grid = "select (k + 5) / 20e0 as temperature from (" + " union all ".join(f"select {k} as k" for k in range(196)) + ") g"
    logit = "ln((0.005e0 + 0.99e0 * every_s) / (1 - (0.005e0 + 0.99e0 * every_s)))"
    upper = lambda group: f"select {group} v.ms, sum(v.n) over ({'partition by ' + group.rstrip(', ') if group else ''} order by v.ms rows between unbounded preceding and current row) as upto, sum(v.n) over ({'partition by ' + group.rstrip(', ') if group else ''}) as n from v"
    linear = "percentile(ms, {q})" if d.spark else "quantile_cont(ms, {q})"
    pair = "sum(n * (n - 1)) / 2e0"
    clustering = lambda name, c: f"select '{name}' as method, md5(text) as truth, {c} as cluster, count(*) as n from {{documents}} group by md5(text), {c}"
    return {
        "ece_left_closed": f"{t}, b as (select least(cast(floor(every_s * 10 + 1e-9) as bigint), 10) as bin, every_s as s, y from t), g as (select bin, count(*) as n, avg(s) as conf, avg(y) as acc from b where bin < 10 group by bin) select cast(sum(n) as bigint) as n, round(sum(n * abs(conf - acc)) / sum(n), 4) as ece from g",
        "macro_f1_seen": f"{t}, {f1} select count(*) as classes, round(avg(2e0 * tp / (truths + guesses)), 6) as macro_f1 from f where guesses > 0",
        "class_f1": f"{t}, {f1} select c as class, truths as n, round(2e0 * tp / (truths + guesses), 6) as f1, round(tp * 1e0 / truths, 6) as recall, round(coalesce(tp * 1e0 / nullif(guesses, 0), 0), 6) as precision_ from f",
        "evaluation_summary": f"""{t}, v as (select ms, count(*) as n from t where s is not null group by ms), c as ({upper('')})
            select count(*) as n, count(s) as decided, round(sum(case when s is null then 1 else 0 end) * 1e0 / count(*), 4) as abstention, (select min(ms) from c where upto > floor(c.n / 2)) as p50_ms,
            round(sum(case when y = 1 and s >= 0.3e0 then 1 else 0 end) * 1e0 / sum(case when y = 1 and s is not null then 1 else 0 end), 4) as recall, round(sum(case when y = 0 and s >= 0.3e0 then 1 else 0 end) * 1e0 / sum(case when y = 0 and s is not null then 1 else 0 end), 4) as fpr from t""",
        "abstention_reasons": f"{t} select reason, count(*) as n from t where reason is not null group by reason order by n desc, reason limit 5",
        "rates_of_decided": f"{t} select source, max(y) as label, count(*) as n, round(avg(case when s >= 0.3e0 then 1e0 else 0e0 end), 4) as share, round(avg(s), 4) as mean_score from t where s is not null group by source",
        "type_distribution": f"{t} select lang, guess, count(*) as n, round(avg(every_s), 6) as mean_score from t group by lang, guess",
        "robustness": f"{t}, x as ({transforms}) select transform, count(*) as n, round(sum(case when y = 1 and s >= 0.3e0 then 1 else 0 end) * 1e0 / sum(case when y = 1 then 1 else 0 end), 6) as recall, round(avg(case when s is null then 1e0 else 0e0 end), 6) as abstention, round(avg(s), 6) as mean_score from x group by transform",
        "video_summary": f"{t} select source, round(avg(case when y = 0 then case when every_s <= 0.3e0 then 1e0 else 0e0 end end), 6) as specificity, round(avg(case when y = 1 then case when every_s > 0.3e0 then 1e0 else 0e0 end end), 6) as recall, sum(case when y = 0 and every_s > 0.3e0 then 1 else 0 end) as misfires from t group by source",
        "misfires": f"{t} select doc_id, source, every_s as s from t where y = 0 and every_s > 0.3e0 order by s desc, doc_id limit 20",
        "population_sweep": f"""{t}, p as (select 'real' as population, every_s as s from t where y = 1 union all select 'junk', every_s from t where y = 0 union all select 'toxic', every_s from t where toxic = 1),
            th as (select k / 10e0 as threshold from (select 1 as k union all select 2 union all select 3 union all select 5 union all select 7 union all select 9) z)
            select population, threshold, round(avg(case when s >= threshold then 1e0 else 0e0 end), 6) as share from p cross join th group by population, threshold""",
        "decision_outcomes": f"""{t}, c as (select 'lexicon' as config, 0.34e0 as least union all select 'verified', 0.25e0 union all select 'strict', 0.60e0)
            select config, case when every_s < least then 'silent' when y = 1 then 'correct' else 'harmful' end as outcome, count(*) as n from t cross join c group by 1, 2""",
        "pairwise_accuracy": f"{t} select lang, count(*) as n, round(avg(case when truth = 0 then case when every_s < 0.25e0 then 1e0 else 0e0 end else case when every_s > 0.25e0 then 1e0 else 0e0 end end), 6) as accuracy from t group by lang",
        "latency_percentiles": f"{t} select lang, count(*) as n, round({linear.format(q='0.5')}, 4) as p50, round({linear.format(q='0.95')}, 4) as p95, round({linear.format(q='0.99')}, 4) as p99, round(60000 / avg(ms), 1) as per_minute from t group by lang having count(*) >= 10",
        "temperature_scaling": f"""{t}, g as ({grid}), b as (select every_s, y, count(*) as n from t group by every_s, y), l as (select temperature, sum(-n * ln(case when y = 1 then 1 / (1 + exp(-{logit} / temperature)) else 1 - 1 / (1 + exp(-{logit} / temperature)) end)) / sum(n) as loss from b cross join g group by temperature),
            r as (select temperature, loss, row_number() over (order by round(loss, 9), temperature) as k from l) select temperature, round(loss, 6) as loss from r where k = 1""",
        "cluster_methods": f"""with c as ({clustering('source', 'source')} union all {clustering('language', 'lang')}), j as (select method, {pair} as together from c group by method),
            r as (select method, {pair} as same_truth from (select method, truth, sum(n) as n from c group by method, truth) a group by method), k as (select method, {pair} as same_cluster from (select method, cluster, sum(n) as n from c group by method, cluster) b group by method),
            m as (select method, sum(n) * (sum(n) - 1) / 2e0 as every_pair from c group by method)
            select j.method, round(together / same_truth, 6) as together_rate, round(1 - (same_cluster - together) / (every_pair - same_truth), 6) as apart_rate,
            round((together - same_truth * same_cluster / every_pair) / ((same_truth + same_cluster) / 2e0 - same_truth * same_cluster / every_pair), 6) as ari from j join r on r.method = j.method join k on k.method = j.method join m on m.method = j.method""",
        "benchmark_sentences": f"""with b as (select distinct item_id, md5(p) as h from ({d.exploded('item_id', d.split('text', '[.!?]\\s+|\\n'), 'p', '{benchmark}')}) x where length(p) >= 30),
            s as (select distinct doc_id, md5(p) as h from ({d.exploded('doc_id', d.split('text', '[.!?]\\s+|\\n'), 'p', '{documents}')}) y where length(p) >= 30)
            select b.item_id, s.doc_id, count(*) as shared from b join s on s.h = b.h group by b.item_id, s.doc_id""",
        "signal_fusion": f"{t} select doc_id, greatest(coalesce(s, 0e0), coalesce((doc_id * 71 % 100) / 100e0, 0e0), case when doc_id % 19 = 0 then 0e0 else (doc_id * 13 % 50) / 100e0 end) as strongest from t",
    }


_SPARK, _DUCK = queries(SPARK), queries(DUCKDB)
QUERIES = {k: spark_query(v) for k, v in _SPARK.items()}
SQL = {k: duckdb_sql(v) for k, v in _DUCK.items()}


def fit_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and positives by score of the half of the documents that calibrations are fitted on."""
    sql = eval_rows(SPARK) + " select every_s as s, count(*) as n, avg(y) as y from t where substr(md5(cast(doc_id as varchar(20))), 1, 1) < '8' group by every_s"
    return spark_query(sql)(spark, sf_dir)


def isotonic_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(s, p)`` for every score of the fitting half: the non-decreasing curve of least squares."""
    rows = VectorAssembler(inputCols=["s"], outputCol="features").transform(fit_half(spark, sf_dir).withColumn("n", F.col("n").cast("double")))
    model = IsotonicRegression(labelCol="y", weightCol="n", featuresCol="features", predictionCol="p").fit(rows)
    return model.transform(rows).select("s", F.round("p", 6).alias("p"))


def isotonic_knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most ``KNOTS`` break points of the curve, evenly spaced by rank; the curve has one row for each distinct score."""
    curve = isotonic_curve(spark, sf_dir)
    return spark.sql(_knots("{curve}"), curve=curve)


def _knots(curve: str) -> str:
    marked = f"""select s, p, row_number() over (order by s) as k from (select s, p, lag(p) over (order by s) as before, lead(p) over (order by s) as after from {curve}) a where before is null or after is null or before <> p or after <> p"""
    at = f"select distinct cast(floor(k.i * (m.n - 1) / {KNOTS - 1}e0 + 1e-9) as bigint) + 1 as k from (" + " union all ".join(f"select {i} as i" for i in range(KNOTS)) + ") k cross join (select max(k) as n from b) m"
    return f"with b as ({marked}), w as ({at}) select b.s, b.p from b join w on w.k = b.k"


def calibrated_ece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The expected calibration error of the other half before and after the curve; scores between two of the curve's are
    interpolated by the model."""
    fit = VectorAssembler(inputCols=["s"], outputCol="features").transform(fit_half(spark, sf_dir).withColumn("n", F.col("n").cast("double")))
    model = IsotonicRegression(labelCol="y", weightCol="n", featuresCol="features", predictionCol="p").fit(fit)
    sql = eval_rows(SPARK) + " select every_s as s, y from t where substr(md5(cast(doc_id as varchar(20))), 1, 1) >= '8'"
    rest = model.transform(VectorAssembler(inputCols=["s"], outputCol="features").transform(spark_query(sql)(spark, sf_dir)))

    def error(score: str):
        bins = rest.groupBy(F.greatest(F.ceil(F.round(F.col(score) * 10, 6)), F.lit(1)).alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("c"), F.avg("y").alias("a"))
        return bins.agg(F.lit(score).alias("score"), F.round(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n"), 4).alias("ece"))

    return error("s").union(error("p"))


QUERIES |= {"isotonic_curve": isotonic_curve, "isotonic_knots": isotonic_knots, "calibrated_ece": calibrated_ece}
#: Least squares under monotony: the largest, over starts, of the least, over ends, of the means of what lies between.
_curve = duckdb_sql(eval_rows(DUCKDB)) + """, c as (select every_s as s, count(*) as n, sum(y) as y from t where substr(md5(cast(doc_id as varchar)), 1, 1) < '8' group by every_s),
    o as (select s, row_number() over (order by s) as i, sum(n) over (order by s) as n, sum(y) over (order by s) as y from c),
    m as (select a.i as a, b.i as b, (b.y - coalesce(z.y, 0)) / (b.n - coalesce(z.n, 0)) as mean from o a join o b on b.i >= a.i left join o z on z.i = a.i - 1),
    l as (select m.a, o.i, min(m.mean) as low from m join o on o.i >= m.a and m.b >= o.i group by m.a, o.i), curve as (select o.s, round(max(l.low), 6) as p from l join o on o.i = l.i group by o.s) """
SQL["isotonic_curve"] = _curve + "select s, p from curve"
SQL["isotonic_knots"] = _curve + ", " + _knots("curve")[5:]
