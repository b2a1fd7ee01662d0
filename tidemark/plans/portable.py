"""Queries whose SQL both Spark and DuckDB read: one text, tables in braces."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


TABLE = re.compile(r"\{([a-z]\w{3,})\}")  # patterns have other braces


def spark_query(sql: str) -> Callable[[SparkSession, str], DataFrame]:
    tables = sorted(set(TABLE.findall(sql)))
    sql = re.sub(r"\{\{([a-z]\w{3,})\}\}", r"{\1}", sql.replace("{", "{{").replace("}", "}}"))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables})

    return run


def duckdb_sql(sql: str) -> str:
    return TABLE.sub(r"\1", sql)


#: Labelled documents with a score in [0, 1]; stands for a detector's output in the evaluation queries.
SCORED = "select d.doc_id, d.lang, d.source, l.quality as y, l.toxic, floor((least(d.n_chars, 4000) * 1000 + 2000) / 4000.0) / 1000.0 as s from {documents} d join {labels} l on d.doc_id = l.doc_id"

PORTABLE = {
    # Exact Mann-Whitney area with ties at one half, from average ranks.
    "auc_rank": f"""with t as ({SCORED}), g as (select s, count(*) as n, sum(y) as p from t group by s),
        c as (select s, n, p, sum(n) over (order by s rows between unbounded preceding and current row) - n as below from g)
        select count(*) as n_scores, cast(sum(p) as bigint) as n_pos, cast(sum(n - p) as bigint) as n_neg,
        round((sum(p * (below + (n + 1) / 2.0)) - sum(p) * (sum(p) + 1) / 2.0) / (sum(p) * sum(n - p)), 6) as auc from c""",
    "eer": f"""with t as ({SCORED}), g as (select s, count(*) as n, sum(y) as p from t group by s),
        c as (select s, sum(n - p) over (order by s desc rows between unbounded preceding and current row) * 1.0 / sum(n - p) over () as fpr,
        1 - sum(p) over (order by s desc rows between unbounded preceding and current row) * 1.0 / sum(p) over () as fnr from g),
        r as (select s, fpr, fnr, row_number() over (order by round(abs(fpr - fnr), 9), s) as k from c)
        select s as threshold, round((fpr + fnr) / 2, 6) as eer from r where k = 1""",
    "ece": f"""with t as ({SCORED}), b as (select case when s = 0 then 1 else cast(ceil(round(s * 10, 6)) as bigint) end as bin, s, y from t),
        g as (select bin, count(*) as n, avg(s) as conf, avg(y) as acc from b group by bin)
        select cast(sum(n) as bigint) as n, round(sum(n * abs(conf - acc)) / sum(n), 4) as ece from g""",
    "reliability_bins": f"""with t as ({SCORED}), b as (select case when s = 0 then 1 else cast(ceil(round(s * 10, 6)) as bigint) end as bin, s, y from t)
        select bin, count(*) as n, round(avg(s), 6) as confidence, round(avg(y), 6) as accuracy from b group by bin""",
    "confusion": f"""with t as ({SCORED}) select y as truth, case when s >= 0.3 then 1 else 0 end as predicted, count(*) as n
        from t group by y, case when s >= 0.3 then 1 else 0 end""",
    "macro_f1": f"""with t as (select y, case when s >= 0.3 then 1 else 0 end as p from ({SCORED}) q),
        k as (select distinct y as c from t),
        f as (select k.c, sum(case when t.y = k.c and t.p = k.c then 1 else 0 end) as tp, sum(case when t.y = k.c then 1 else 0 end) as truth,
        sum(case when t.p = k.c then 1 else 0 end) as pred, count(*) as n from t join k on t.y = k.c or t.p = k.c group by k.c)
        select count(*) as classes, round(avg(2.0 * tp / (truth + pred)), 6) as macro_f1, round(sum(tp) * 1.0 / sum(truth), 6) as accuracy from f""",
    "threshold_sweep": f"""with t as ({SCORED}), th as (select k / 20.0 as threshold from (select 1 as k union all select 2 union all select 4 union all select 6 union all select 10 union all select 14 union all select 19) x)
        select cast(threshold as double) as threshold, round(sum(case when s >= threshold and y = 1 then 1 else 0 end) * 1.0 / sum(y), 6) as recall,
        round(sum(case when s >= threshold and y = 0 then 1 else 0 end) * 1.0 / sum(1 - y), 6) as fpr,
        round(coalesce(sum(case when s >= threshold and y = 1 then 1 else 0 end) * 1.0 / nullif(sum(case when s >= threshold then 1 else 0 end), 0), 0), 6) as precision_,
        cast(sum(case when s >= threshold then 1 else 0 end) as bigint) as flagged from t cross join th group by threshold""",
    "recall_targets": f"""with t as ({SCORED}), g as (select s, sum(y) as p, count(*) as n from t group by s),
        c as (select s, sum(p) over (order by s desc rows between unbounded preceding and current row) * 1.0 / sum(p) over () as recall from g),
        k as (select 0.5 as target union all select 0.8 union all select 0.85 union all select 0.9 union all select 0.95 union all select 0.98)
        select cast(target as double) as target, max(s) as threshold from k join c on c.recall >= k.target group by target""",
    "best_under_fpr_cap": f"""with t as ({SCORED}), g as (select s, sum(y) as p, count(*) as n from t group by s),
        c as (select s, sum(p) over (order by s desc rows between unbounded preceding and current row) * 1.0 / sum(p) over () as recall,
        sum(n - p) over (order by s desc rows between unbounded preceding and current row) * 1.0 / sum(n - p) over () as fpr from g),
        r as (select s, recall, fpr, row_number() over (order by recall desc, s) as k from c where fpr <= 0.20)
        select s as threshold, round(recall, 6) as recall, round(fpr, 6) as fpr from r where k = 1""",
    "fairness_gap": f"""with t as ({SCORED}), g as (select lang, sum(1 - y) as n, sum(case when y = 0 and s >= 0.3 then 1 else 0 end) * 1.0 / sum(1 - y) as fpr, sum(case when y = 1 and s >= 0.3 then 1 else 0 end) * 1.0 / sum(y) as detected,
        avg(case when s >= 0.95 then 1.0 else 0.0 end) as rule_zero from t group by lang)
        select lang, cast(n as bigint) as n, round(fpr, 6) as fpr, round(detected, 6) as detected, round(rule_zero, 6) as rule_zero, round(max(fpr) over () - min(fpr) over (), 6) as gap, max(fpr) over () - min(fpr) over () <= 0.05 as within_target,
        round(max(detected) over () - min(detected) over (), 6) as detection_gap, max(detected) over () - min(detected) over () <= 0.05 as detection_within_target from g""",
    "positives_by_language": """select d.lang, count(*) as n from {documents} d join {labels} l on d.doc_id = l.doc_id where l.toxic = 1 group by d.lang""",
    "per_source_rates": f"""with t as ({SCORED}) select source, count(*) as n, round(avg(case when s >= 0.3 then 1.0 else 0.0 end), 6) as share, round(avg(s), 6) as mean_score from t group by source""",
    # Texts are told by a hash, so that they are not shuffled.
    "dedupe_keep_first": """select min(doc_id) as doc_id, min_by(source, doc_id) as source, min_by(n_chars, doc_id) as n_chars from {documents} where length(text) >= 15 group by md5(text)""",
    "exact_duplicate_groups": """select md5(text) as text_md5, count(*) as n, min(doc_id) as first_doc, max(doc_id) as last_doc from {documents} group by md5(text) having count(*) > 1""",
    "hash_collision_count": """select cast(coalesce(sum(n - 1), 0) as bigint) as surplus from (select count(*) as n from {documents} group by md5(text)) q where n > 1""",
    "leak_audit": """select md5(text) as text_md5, count(distinct source) as n_sources, count(*) as n from {documents} group by md5(text) having count(distinct source) > 1""",
    "crosstab_lang_source": """select source, cast(sum(case when lang = 'en' then 1 else 0 end) as bigint) as en, cast(sum(case when lang = 'de' then 1 else 0 end) as bigint) as de, cast(sum(case when lang = 'fr' then 1 else 0 end) as bigint) as fr, cast(sum(case when lang = 'es' then 1 else 0 end) as bigint) as es from {documents} group by source""",
    "value_counts": """select lang, source, count(*) as n from {documents} group by grouping sets ((lang), (source), (lang, source))""",
    "balanced_sample": """select doc_id, toxic from (select doc_id, toxic, row_number() over (partition by toxic order by md5(concat('42:', cast(doc_id as varchar(20)))), doc_id) as k from {labels}) q where k <= 20""",
    "round_robin_sample": """select source, doc_id, k from (select source, doc_id, k, row_number() over (order by k, source) as r from (select source, doc_id, row_number() over (partition by source order by md5(concat('7:', cast(doc_id as varchar(20)))), doc_id) as k from {documents}) q where k <= 10) w where r <= 100""",
    "roles_disjoint": """select source, count(distinct lang) as roles, count(distinct lang) > 1 as mixed from {documents} group by source""",
    "split_by_hash": """select doc_id, case when substr(md5(cast(doc_id as varchar(20))), 1, 1) in ('0', '1', '2') then 'held' else 'fit' end as part from {documents}""",
    "duplicate_pairs_rates": """with t as (select md5(text) as truth, source as cluster from {documents}), c as (select truth, cluster, count(*) as n from t group by truth, cluster),
        j as (select sum(n * (n - 1) / 2) as together from c), r as (select sum(n * (n - 1) / 2) as same_truth from (select truth, sum(n) as n from c group by truth) a),
        k as (select sum(n * (n - 1) / 2) as same_cluster from (select cluster, sum(n) as n from c group by cluster) b), m as (select sum(n) * (sum(n) - 1) / 2 as every_pair from c)
        select round(together * 1.0 / same_truth, 6) as together_rate, round(1 - (same_cluster - together) * 1.0 / (every_pair - same_truth), 6) as apart_rate,
        round((together - same_truth * 1.0 * same_cluster / every_pair) / ((same_truth + same_cluster) / 2.0 - same_truth * 1.0 * same_cluster / every_pair), 6) as ari from j cross join r cross join k cross join m""",
    # Counts by distinct value, then running sums; ranks that end in one half go to the even one.
    "nearest_rank_percentiles": """with v as (select event_type, value, count(*) as k from {events} group by event_type, value),
        c as (select event_type, value, sum(k) over (partition by event_type order by value rows between unbounded preceding and current row) as upto, sum(k) over (partition by event_type) as n from v),
        x as (select *, (n - 1) * 0.5 as a, (n - 1) * 0.95 as b from c),
        r as (select *, floor(a + 0.5) - case when floor(a + 0.5) = a + 0.5 and floor(a + 0.5) % 2 = 1 then 1 else 0 end as i, floor(b + 0.5) - case when floor(b + 0.5) = b + 0.5 and floor(b + 0.5) % 2 = 1 then 1 else 0 end as j from x)
        select event_type, round(min(case when upto > i then value end), 2) as p50, round(min(case when upto > j then value end), 2) as p95 from r group by event_type""",
    "latency_by_type": """select event_type, count(*) as n, round(60000.0 / avg(value), 1) as per_minute, round(max(value), 2) as worst from {events} group by event_type having count(*) >= 10""",
    "fpr_budget_threshold": """with v as (select value, count(*) as k from {events} where event_type = 'error' group by value),
        c as (select value, sum(k) over (order by value rows between unbounded preceding and current row) as upto, sum(k) over () as n from v)
        select min(value) as threshold, cast(max(n) as bigint) as n from c where upto > floor(0.95 * (n - 1))""",
    "system_metrics": """select count(*) as total, cast(sum(case when event_type = 'error' then 1 else 0 end) as bigint) as errors, round(sum(case when event_type = 'error' then 1 else 0 end) * 1.0 / count(*), 4) as error_rate, round(60000.0 / avg(value), 1) as throughput from {events}""",
    "spread_rates": """select event_type, user_id, count(*) as n, round(count(*) / 30.0 * 60, 1) as spread, round((count(*) - greatest(floor(count(*) / 2), 1)) * 1.0 / greatest(floor(count(*) / 2), 1), 2) as acceleration from {events} group by event_type, user_id""",
    "audit_tail": """select event_id, user_id, event_type from {events} order by event_id desc limit 50""",
    "dominant_event": """select user_id, event_type, n from (select user_id, event_type, n, row_number() over (partition by user_id order by n desc, first_id) as k from (select user_id, event_type, count(*) as n, min(event_id) as first_id from {events} group by user_id, event_type) a) b where k = 1""",
    "pending_appeals": """with a as (select user_id, event_id, row_number() over (partition by user_id order by event_id) as k from {events} where event_type = 'error')
        select e.user_id, count(*) as events, min(a.event_id) as first_pending, coalesce(round(max(case when a.user_id is null then 0.0 else e.value end), 2), 0) as spread from {events} e left join a on e.user_id = a.user_id and a.k = 1 group by e.user_id""",
    "events_tumbling_30m": """select to_timestamp_s as window_start, event_type, count(*) as n, round(sum(value), 4) as total from (select cast(floor(epoch_s / 1800) * 1800 as bigint) as to_timestamp_s, event_type, value from (select cast(floor(date_part('epoch', ts)) as bigint) as epoch_s, event_type, value from {events}) a) b group by to_timestamp_s, event_type""",
    "union_all_texts": """select kind, count(*) as n, cast(sum(length(text)) as bigint) as chars from (select 'document' as kind, text from {documents} union all select 'benchmark', text from {benchmark} union all select 'conversation', text from {conversations}) q group by kind""",
    "sources_without_labels": """select source from {documents} except select d.source from {documents} d join {labels} l on d.doc_id = l.doc_id where l.toxic = 1""",
    "feed_merge": """select doc_id, 'fresh' as origin from {labels} union all select d.doc_id, 'stored' from {documents} d where not exists (select 1 from {labels} l where l.doc_id = d.doc_id)""",
    "benchmark_in_documents": """select b.item_id, d.doc_id from {benchmark} b join {documents} d on md5(b.text) = md5(d.text)""",
    "dataset_inventory": """select 'documents' as name, count(*) as n, count(text) as n_text from {documents} union all select 'pages', count(*), count(html) from {pages} union all select 'conversations', count(*), count(text) from {conversations}""",
}
#: Both engines read numbers with an exponent as doubles, and plain ones as decimals.
PORTABLE = {k: re.sub(r"(?<![\w.])(\d+\.\d+)(?![\w.])", r"\1e0", v) for k, v in PORTABLE.items()}
PORTABLE["events_tumbling_30m"] = PORTABLE["events_tumbling_30m"].replace("date_part('epoch', ts)", "{epoch}")
EPOCH = {"spark": "unix_micros(cast(ts as timestamp)) / 1000000.0", "duckdb": "epoch(ts)"}
_SPARK = {k: v.replace("{epoch}", EPOCH["spark"]) for k, v in PORTABLE.items()}
QUERIES = {k: spark_query(v) for k, v in _SPARK.items()}
SQL = {k: duckdb_sql(v.replace("{epoch}", EPOCH["duckdb"])) for k, v in PORTABLE.items()}
