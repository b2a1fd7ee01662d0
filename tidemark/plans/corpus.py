"""Corpus preparation: three kinds of sources in one schema, deduplicated, split by event, sampled and audited.

Even documents stand for labelled crisis messages, odd ones for messages with a verdict, items of ``benchmark`` for bulletins
that hold a claim and its refutation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions import unicode
from ..functions.dialect import DUCKDB, SPARK, Dialect, number
from ..operators.order import numbered
from ..scratch import materialize, shared_dir
from ..sources import commits
from ..sources.commits import Contract
from .portable import duckdb_sql, spark_query
from .posts import SPACE, URL, normalized, quoted

HELP_CORE = ["requests_or_urgent_needs", "missing_or_found_people"]
HELP_BROAD = [*HELP_CORE, "rescue_volunteering_or_donation_effort"]
#: Sources in the order in which they are put together, of which the first has a text; bulletins come last. Shorter texts are left out.
ORDER, SHORTEST = ("D10", "D2"), 15
SPLITS = {"train": 0.70, "val": 0.15, "test": 0.15}


def masked(d: Dialect, x: str) -> str:
    """Links, names, phone numbers and long numbers give way to marks; other numbers stay."""
    n, s = "\\d", "[\\s.-]?"
    for p, by in [(URL, "<bağlantı>"), ("@[\\p{L}\\p{N}_]+", "<kullanıcı>"), (f"\\b0?{n * 3}{s}{n * 3}{s}{n * 2}{s}{n * 2}\\b", "<telefon>"), (f"\\b{n * 7}\\d*\\b", "<sayı>"), (SPACE, " ")]:
        x = d.replace(x, p, by)
    return f"trim({x})"


def topic(d: Dialect, x: str) -> str:
    """The first group of key words of which one is there."""
    return "case " + " ".join(f"when {' or '.join(d.contains(x, quoted(w)) for w in words)} then 'mide_{name}'" for name, words in lx.TOPICS.items()) + " else 'mide_diger' end"


def disaster(d: Dialect, x: str) -> str:
    return f"case when {d.contains(x, quoted('deprem'))} then 'deprem' when {d.contains(x, quoted('yangin'))} then 'yangin' when {d.contains(x, quoted('sel'))} then 'sel' end"


def harmonised(d: Dialect) -> str:
    """``h``: the common schema; labels that a source lacks are null."""
    names = list(lx.HUMANITARIAN)
    claim = "case " + " ".join(f"when class_label = '{k}' then '{v}'" for k, v in lx.HUMANITARIAN.items()) + " else 'belirsiz' end"
    inside = lambda some: "cast(class_label in (" + ", ".join(map(quoted, some)) + ") as int)"
    words = d.array(*map(quoted, [w for ws in lx.TOPICS.values() for w in ws]), "''")
    label = "case when l.toxic = 1 then 'False' when l.toxic = 0 then 'True' else 'Other' end"
    null = {c: f"cast(null as {t})" for c, t in (("s", "varchar(20)"), ("i", "int"))}
    return f"""a as (select doc_id, text, lang, source, {d.at(d.array(*map(quoted, [*names, 'unlisted'])), d.div('doc_id', '2') + ' % 11')} as class_label from {{documents}} where doc_id % 2 = 0 and text is not null),
        b as (select d.doc_id, concat(d.text, ' ', {d.at(words, 'd.doc_id % 17')}) as tweet, {label} as label from {{documents}} d left join {{labels}} l on d.doc_id = l.doc_id where d.doc_id % 2 = 1 and d.text is not null),
        c as (select item_id, item_id % 7 as bulletin, text as claim, concat('Tekzip: ', text) as fact_check from {{benchmark}}),
        h as (select doc_id as row_id, {masked(d, 'text')} as metin, 'D10' as kaynak, lang as dil, source as olay, {claim} as claim_type, {inside(HELP_CORE)} as yardim_cagrisi, {inside(HELP_BROAD)} as yardim_ilgili, {null['s']} as yanlis_bilgi from a
        union all select doc_id, {masked(d, 'tweet')}, 'D2', 'tr', {topic(d, 'lower(tweet)')}, {null['s']}, {null['i']}, {null['i']}, case label when 'True' then 'dogru' when 'False' then 'yanlis' else 'diger' end from b
        union all select item_id, {masked(d, 'claim')}, 'D1_iddia', 'tr', concat('dmm_b', cast(bulletin as varchar(5))), {null['s']}, {null['i']}, {null['i']}, 'yanlis' from c
        union all select item_id, {masked(d, 'fact_check')}, 'D1_tekzip', 'tr', concat('dmm_b', cast(bulletin as varchar(5))), {null['s']}, {null['i']}, {null['i']}, 'dogru' from c),
        f as (select *, case when kaynak in ('D1_iddia', 'D1_tekzip') then 'D1' else kaynak end as aile from h)"""


def queries(d: Dialect) -> dict[str, str]:
    h = "with " + harmonised(d)
    nation = lambda x: f"trim({d.at(d.split(x, '/'), '0')})"
    slug = d.replace(d.replace(normalized(d, "n_name"), "[^a-z0-9]+", "-"), "^-|-$", "")
    title = d.extract("html", "<title>([^<]*)</title>", 1)
    stop = ", ".join(map(quoted, ["that", "with", "from", "this", "have", "para", "como", "dans", "pour", "nicht", "und", "eine"]))
    terms = d.kept(d.every("lower(text)", "[a-z0-9]+"), "t", f"length(t) > 3 and t not in ({stop})")
    dirty = d.array("claim", "concat(claim, chr(34), ' İddiası', chr(34), ' İddiası')", "concat(claim, repeat('˿', 3))", "concat('Dezenformasyon Bülteni', claim)")
    return {
        "harmonised_corpus": f"{h} select row_id, md5(metin) as metin_md5, length(metin) as n, kaynak, dil, olay, claim_type, yardim_cagrisi, yardim_ilgili, yanlis_bilgi from h",
        "harmonised_counts": f"{h} select kaynak, olay, claim_type, yanlis_bilgi, count(*) as n, cast(sum(yardim_cagrisi) as bigint) as narrow, cast(sum(yardim_ilgili) as bigint) as broad from f group by kaynak, olay, claim_type, yanlis_bilgi",
        "training_normalize": f"select doc_id, {masked(d, 'text')} as metin from {{documents}} where text is not null",
        "topics": f"{h} select olay as topic, count(*) as n from h where kaynak = 'D2' group by olay",
        "bulletin_rows": f"{h} select item_id, kind, md5(text) as text_md5 from (select item_id, 'iddia' as kind, claim as text from c union all select item_id, 'tekzip', fact_check from c) q",
        "dirty_records": f"""{h}, r as (select item_id, {d.at(dirty, 'item_id % 4')} as claim from c)
            select item_id, ({d.size(d.every('claim', chr(34) + ' İddias[ıi]'))} >= 2 or length(claim) - length(replace(claim, '˿', '')) > 2 or {d.like('claim', 'Dezenformasyon[ \\t\\n]*Bülteni')}) as dirty, md5(trim({d.replace("replace(claim, '˿', ' ')", SPACE, ' ')})) as cleaned from r""",
        "knowledge_pool": f"{h} select concat('KRP-', lpad(cast(row_number() over (order by item_id) as varchar(10)), 5, '0')) as record_id, item_id, md5(claim) as claim_md5, case when item_id % 2 = 0 then 'Yanlış' else 'Doğru' end as rating from c",
        "index_terms": f"select term, count(*) as n, count(distinct doc_id) as df from ({d.exploded('doc_id', terms, 'term', '{documents}')}) q group by term having count(*) >= 3",
        "idf_without_stop_words": f"""with t as ({d.exploded('item_id', d.distinct(terms), 'term', '{benchmark}')}), n as (select count(*) as n from {{benchmark}})
            select term, count(*) as df, round(ln(max(n.n) / (1e0 + count(*))), 6) as idf from t cross join n group by term""",
        "disaster_types": f"select doc_id, {disaster(d, 'lower(text)')} as from_text, {disaster(d, 'lower(source)')} as from_event, case when source like 'src1%' then 'deprem' when source like 'src2%' then 'sel' end as from_prefix from {{documents}}",
        "scene_mismatch_label": f"with t as (select doc_id, {disaster(d, 'lower(text)')} as a, case doc_id % 4 when 0 then 'deprem' when 1 then 'sel' when 2 then 'yangin' end as b from {{documents}}) select doc_id, case when a is not null and b is not null then cast(a <> b as int) end as mismatch from t",
        "place_parts": f"select n_nationkey, {nation('concat(n_name, chr(47), cast(n_regionkey as varchar(3)))')} as city, {slug} as slug from {{nation}}",
        "orientation": "select vec_id, case when h > w then 'dikey' when h = w then 'kare' else 'yatay' end as orientation, w, h from (select vec_id, (vec_id * 7 % 5) * 320 + 320 as w, (vec_id * 11 % 5) * 320 + 320 as h from {embeddings}) q",
        "media_files": f"select page_id, lower({d.extract('url', '[.][a-z0-9]+$')}) as suffix, {d.like('lower(url)', '[.](mp4|mov|avi|mkv|webm)$')} as is_video, {d.like('lower(url)', '[.](jpg|jpeg|png|webp)$')} as is_image from {{pages}}",
        "html_residue": f"select page_id, nullif(trim({d.at(d.split('x', '<'), '0')}), '') as text from (select page_id, case when page_id % 3 = 0 then concat(' ', {title}, '<div class=x>', html) when page_id % 3 = 1 then html else {title} end as x from {{pages}}) q",
        "distinct_titles": f"select title, min(page_id) as first_page, count(*) as n from (select page_id, {title} as title from {{pages}}) q where title <> '' group by title",
        "page_records": f"select page_id, {d.extract('url', '^https?://([^/?#]+)', 1)} as host, {title} as title, length(html) as n_chars, md5(html) as content_md5 from {{pages}}",
        "content_sha256": f"select page_id, {'sha2(html, 256)' if d.spark else 'sha256(html)'} as digest from {{pages}}",
        "noise_templates": f"""with t as (select 0 as k, '%s' as form union all select 1, 'Duydum ki %s' union all select 2, '%s diyorlar, yayalım!') select item_id, k, md5(replace(form, '%s', text)) as noisy_md5 from {{benchmark}} cross join t""",
        "rephrase_set": "select item_id as group_id, 0 as member, md5(substring(text, 1, 160)) as text_md5 from {benchmark} union all select item_id, 1, md5(concat('Sorgu: ', text)) from {benchmark}",
        "replay_mix": f"""{h}, r as (select row_id, kaynak, row_number() over (order by md5(concat('11:', cast(row_id as varchar(20)))), row_id) as k from h where kaynak = 'D10') select row_id, kaynak, 'replay' as origin from r where k <= 50 union all select row_id, kaynak, 'stage2' from h where kaynak <> 'D10'""",
        "stage_filter": f"{h} select row_id, kaynak from h where kaynak = 'D10' and claim_type <> 'belirsiz'",
        "gold_labels": "select doc_id, quality from (select doc_id, case when doc_id % 9 = 0 then -1 else quality end as quality from {labels}) q where quality <> -1",
        "held_back": "select doc_id, k <= 100 as held from (select doc_id, row_number() over (order by md5(concat('42:', cast(doc_id as varchar(20)))), doc_id) as k from {labels}) q",
        "type_plan": f"""with w as (select 0 as ord, 'deprem' as kind, 0.5e0 as weight union all select 1, 'sel', 0.3e0 union all select 2, 'yangin', 0.2e0), t as (select count(*) as total from {{labels}}),
            p as (select ord, kind, cast(floor(total * weight + 0.5e0) as bigint) as n, total from w cross join t), s as (select *, sum(n) over (order by ord rows between unbounded preceding and current row) as upto, sum(n) over () as planned from p)
            select kind, cast(greatest(least(upto, total) - least(upto - n, total), 0) + case when ord = 0 then greatest(total - planned, 0) else 0 end as bigint) as n from s""",
        "target_pick": f"""with p as (select item_id, row_number() over (order by item_id) - 1 as k, count(*) over () as n from {{benchmark}}) select d.doc_id, p.item_id from (select doc_id, doc_id * 2654435761 % 1000003 as h from {{documents}}) d join p on p.k = d.h % p.n""",
        "other_city": f"select vec_id, {d.at(d.array(*map(quoted, lx.CITIES)), 'vec_id % 81')} as own, {d.at(d.array(*map(quoted, lx.CITIES)), '(vec_id + 1 + vec_id * 31 % 80) % 81')} as other from {{embeddings}}",
        "sample_per_class": "select vec_id, label from (select vec_id, label, row_number() over (partition by label order by md5(concat('3:', cast(vec_id as varchar(20)))), vec_id) as k from {embeddings}) q where k <= 12",
        "case_set": " union all ".join(
            f"select doc_id, '{name}' as stratum, md5({text}) as text_md5 from (select doc_id, text, row_number() over (order by md5(concat('{k}:', cast(doc_id as varchar(20)))), doc_id) as r from {{documents}} where text is not null) q where r <= 40"
            for k, (name, text) in enumerate([("temiz", "text"), ("provokatif", "concat('Sokağa dökülelim! ', text)"), ("yardim", "concat(text, ' Enkaz altında')"), ("tekzip", "concat(text, ' iddiası asılsızdır')"), ("iddia", "concat('AFAD açıkladı: ', text)"), ("uzak_sehir", "concat(text, ' Van')"), ("sentetik", "concat('[grid] ', text)"), ("kisa", "substring(text, 1, 20)")])
        ),
        "label_axes": f"{h} select claim_type as label from h where claim_type is not null union select 'tahliye' union select 'yardım_çağrısı'",
        "missing_classes": f"{h} select label from (select 'tahliye' as label union all select 'deneme' union all select 'can_kaybı') x except select claim_type from h where claim_type is not null",
        "contract_report": "select name, expected, actual, expected = actual as satisfied from (select 'labels' as name, 400 as expected, count(*) as actual from {labels} union all select 'benchmark', 40, count(*) from {benchmark} union all select 'pages', 250, count(*) from {pages}) q",
        "usable_datasets": "select name, actual from (select 'labels' as name, count(*) as actual, true as licensed from {labels} union all select 'benchmark', count(*), false from {benchmark} union all select 'pages', count(*), true from {pages}) q where licensed and actual > 0",
        "appended_rows": "select d.doc_id, 'new' as state from {documents} d left join {labels} l on d.doc_id = l.doc_id where l.doc_id is null union all select doc_id, 'known' from {labels}",
        "held_event_rows": f"with held as (select source from {{documents}} group by source having count(*) % 5 <> 1 and min(doc_id) % 4 = 0) select d.doc_id, d.source from {{documents}} d where d.source in (select source from held)",
        "role_rows": "select doc_id, role from (select doc_id, case doc_id % 5 when 0 then 'tutulan' when 1 then 'dogrulama' else 'egitim' end as role from {documents}) q where role = 'tutulan'",
        "deciles": f"""with v as (select n_chars as x, count(*) as n from {{documents}} group by n_chars), c as (select x, sum(n) over (order by x rows between unbounded preceding and current row) as upto, sum(n) over () as total from v),
            q as (select k from (select 1 as k union all select 2 union all select 3 union all select 4 union all select 5 union all select 6 union all select 7 union all select 8 union all select 9) z),
            p as (select q.k, least(greatest(cast(floor((t.total + 1) * q.k / 10e0) as bigint), 1), t.total - 1) as j, (t.total + 1) * q.k / 10e0 as place from q cross join (select max(total) as total from c) t),
            e as (select p.k, p.place - p.j as share, min(case when c.upto >= p.j then c.x end) as lo, min(case when c.upto >= p.j + 1 then c.x end) as hi from p cross join c group by p.k, p.j, p.place)
            select k, round(lo + (hi - lo) * share, 4) as value from e""",
        "softmax": f"""with v as (select doc_id, (n_chars % 97) / 10e0 as a, (n_chars % 89) / 10e0 as b, (n_chars % 83) / 10e0 as c from {{documents}}), m as (select *, greatest(a, b, c) as top from v), e as (select doc_id, exp(a - top) as a, exp(b - top) as b, exp(c - top) as c from m)
            select doc_id, round(a / (a + b + c), 6) as p0, round(b / (a + b + c), 6) as p1, round(c / (a + b + c), 6) as p2 from e""",
        "event_order": f"{h} select olay, n from (select olay, count(*) as n from h group by olay) q order by n desc, olay limit 25",
        "manifest_counters": f"{h} select kaynak, dil, count(*) as n from h group by grouping sets ((kaynak), (dil), (kaynak, dil))",
    }


_SPARK, _DUCK = queries(SPARK), queries(DUCKDB)
QUERIES = {k: spark_query(v) for k, v in _SPARK.items()}
SQL = {k: duckdb_sql(v) for k, v in _DUCK.items()}


def greedy_parts(sizes: DataFrame, shares: dict[str, float] = SPLITS) -> DataFrame:
    """``(aile, olay, n, bolum)``: within each family, events from the largest down go to the part that is least full.

    ``sizes(aile, olay, n)`` has one row an event; a family's events, a few hundred, are folded in one expression.
    """
    item = F.struct((-F.col("n")).alias("o"), "olay", "n")
    groups = sizes.groupBy("aile").agg(F.sort_array(F.collect_list(item)).alias("items"), F.sum("n").alias("total"))
    names = list(shares)
    aims = {p: F.greatest(F.col("total") * F.lit(shares[p]), F.lit(1.0)) for p in names}
    groups = groups.withColumn("aims", F.struct(*[aims[p].alias(p) for p in names]))
    start = F.struct(*[F.lit(0).cast("long").alias(p) for p in names], F.array().cast("array<struct<olay:string,n:bigint,bolum:string>>").alias("done"))

    def step(state: Column, i: Column) -> Column:
        fill = {p: state[p] / F.col("aims")[p] for p in names}
        least = F.least(*fill.values())
        part = F.when(fill[names[0]] == least, names[0])
        for p in names[1:]:
            part = part.when(fill[p] == least, p)
        took = F.struct(i["olay"].alias("olay"), i["n"].alias("n"), part.alias("bolum"))
        return F.struct(*[(state[p] + F.when(part == p, i["n"]).otherwise(0)).alias(p) for p in names], F.concat(state["done"], F.array(took)).alias("done"))

    return groups.select("aile", F.explode(F.aggregate("items", start, step)["done"]).alias("d")).select("aile", "d.olay", "d.n", "d.bolum")


def harmonised_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark_query(f"with {harmonised(SPARK)} select * from f")(spark, sf_dir)


def deduplicated(rows: DataFrame) -> DataFrame:
    """Of equal texts of at least ``SHORTEST`` characters the first, with ``copies``: sources come in the order of ``ORDER``, rows of a source
    by id. Texts meet as 128-bit hashes; copies leave where they are read."""
    place = F.when(F.col("kaynak") == ORDER[0], 0).when(F.col("kaynak") == ORDER[1], 1).otherwise(2)
    own = [c for c in rows.columns if c != "metin"]
    first = F.min(F.struct(place.alias("_p"), F.col("row_id").alias("_r"), F.col("kaynak").alias("_k"), F.struct(*own, "metin").alias("row"))).alias("f")
    long_enough = rows.where(F.length("metin") >= SHORTEST)
    return long_enough.groupBy(F.md5("metin").alias("_h")).agg(first, F.count("*").alias("copies")).select("f.row.*", "copies")


def harmonised_kept_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = harmonised_rows(spark, sf_dir).select("row_id", "kaynak", "metin")
    return deduplicated(rows).groupBy("kaynak").agg(F.count("*").alias("n"), F.sum("copies").alias("rows_before"))


def event_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the corpus without its repeated and short texts."""
    rows = harmonised_rows(spark, sf_dir).select("row_id", "kaynak", "aile", "olay", "metin")
    return deduplicated(rows).groupBy("aile", "olay").agg(F.count("*").alias("n"))


def event_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return greedy_parts(event_families(spark, sf_dir))


def corpus_contract() -> Contract:
    columns = [("row_id", "bigint"), ("metin", "string"), ("kaynak", "string"), ("dil", "string"), ("olay", "string"), ("claim_type", "string"), ("yardim_cagrisi", "int"), ("yardim_ilgili", "int"), ("yanlis_bilgi", "string"), ("aile", "string"), ("bolum", "string")]
    return Contract(tuple(columns), required=("metin", "kaynak", "olay", "bolum"), conditions={"short text": f"length(metin) >= {SHORTEST}", "unknown part": "bolum in (" + ", ".join(map(quoted, SPLITS)) + ")"})


def save_corpus(spark: SparkSession, sf_dir: str, path: str, version: str) -> dict:
    """The harmonised corpus, deduplicated and split by events, as a table with a folder for each part; gives its manifest."""
    rows = materialize(deduplicated(harmonised_rows(spark, sf_dir)).drop("copies"))
    parts = greedy_parts(rows.groupBy("aile", "olay").agg(F.count("*").alias("n"))).select("aile", "olay", "bolum")
    columns = [c for c, _ in corpus_contract().columns]
    return commits.commit(rows.join(parts, ["aile", "olay"]).select(*columns), path, version, corpus_contract(), ["bolum"])


def saved_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus as it is read after it was committed twice: rows and texts of each part and source."""
    path = shared_dir(spark)
    save_corpus(spark, sf_dir, path, "v1")
    save_corpus(spark, sf_dir, path, "v1")  # changes nothing
    return commits.read(spark, path).groupBy("bolum", "kaynak").agg(F.count("*").alias("n"), F.count_distinct("olay").alias("events"), F.sum(F.length("metin")).alias("chars"))


#: Contracts of the tables that come from elsewhere: key columns, and what must hold.
CONTRACTS = {
    "labels": (["doc_id", "quality", "toxic"], ["doc_id"], {"label": "quality in (0, 1) and toxic in (0, 1)"}),
    "benchmark": (["item_id", "text"], ["item_id"], {"text": "length(text) > 0"}),
    "pages": (["page_id", "url", "html"], ["page_id"], {"url": "url rlike '^https?://'"}),
    "conversations": (["conv_id", "turn", "text"], ["conv_id"], {"text": "length(text) > 0"}),
}


def contract_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each table held against its contract and kept where it satisfies it; a table that doesn't has no rows there."""
    out = []
    for name, (columns, unique, conditions) in CONTRACTS.items():
        path, rows = shared_dir(spark), spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)
        try:
            contract = Contract(tuple(rows.dtypes), required=tuple(columns), unique=tuple(unique), conditions=conditions)
            out.append((name, commits.commit(rows, path, "v1", contract)["rows"], True))
        except commits.ContractError:
            out.append((name, 0, False))
    return spark.createDataFrame(out, "name string, kept long, satisfied boolean")


def knowledge_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = numbered(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"), ["item_id"], "k")
    rating = F.when(F.col("item_id") % 2 == 0, "Yanlış").otherwise("Doğru")
    return rows.select(F.concat(F.lit("KRP-"), F.lpad((F.col("k") + 1).cast("string"), 5, "0")).alias("record_id"), "item_id", F.md5("text").alias("claim_md5"), rating.alias("rating"))


def comparable_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as they are compared: case folded, decomposed, without marks; only their hash and length are kept."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return rows.select("conv_id", "turn", unicode.comparable(F.col("text")).alias("t")).select("conv_id", "turn", F.length("t").cast("long").alias("n"), F.md5("t").alias("md5"))


def held_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred rows by the order of hashes; the others are never sorted."""
    rows = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id")
    held = rows.orderBy(F.md5(F.concat(F.lit("42:"), F.col("doc_id").cast("string"))), "doc_id").limit(100).select("doc_id", F.lit(True).alias("held"))
    return rows.join(F.broadcast(held), "doc_id", "left").select("doc_id", F.coalesce("held", F.lit(False)).alias("held"))


def target_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    pool = numbered(spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id"), ["item_id"], "k")
    hashed = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", (F.col("doc_id") * 2654435761 % 1000003 % F.lit(max(pool.count(), 1))).alias("k"))
    return hashed.join(pool, "k").select("doc_id", "item_id")


def split_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each part and family, and how many events are in several parts of it: none."""
    parts = event_split(spark, sf_dir)
    leaks = parts.groupBy("aile", "olay").agg(F.count_distinct("bolum").alias("k")).groupBy("aile").agg(F.count_if(F.col("k") > 1).alias("leaking"))
    return parts.groupBy("aile", "bolum").agg(F.sum("n").alias("rows"), F.count("*").alias("events")).join(leaks, "aile")


_aim = {p: f"greatest(g.total * {number(x)}, 1e0)" for p, x in SPLITS.items()}
_fill = {p: f"s.{p} / {a}" for p, a in _aim.items()}
_least = "least(" + ", ".join(_fill.values()) + ")"
_part = "case " + " ".join(f"when {f} = {_least} then '{p}'" for p, f in _fill.items()) + " end"
#: Texts one by one: of equal ones the first row stays, sources in their order.
_unique = f"""u0 as (select *, row_number() over (partition by metin order by case when kaynak = '{ORDER[0]}' then 0 when kaynak = '{ORDER[1]}' then 1 else 2 end, row_id, kaynak) as copy, count(*) over (partition by metin) as copies from f where length(metin) >= {SHORTEST}),
u as (select * from u0 where copy = 1)"""
_greedy = f"""with recursive {harmonised(DUCKDB)}, {_unique}, e as (select aile, olay, count(*) as n from u group by aile, olay),
g as (select *, sum(n) over (partition by aile) as total, row_number() over (partition by aile order by n desc, olay) as k from e),
w as (select aile, olay, n, total, k, 'train' as bolum, n::double as train, 0::double as val, 0::double as test from g where k = 1
union all select aile, olay, n, total, k, bolum, train + case when bolum = 'train' then n else 0 end, val + case when bolum = 'val' then n else 0 end, test + case when bolum = 'test' then n else 0 end
from (select g.aile, g.olay, g.n, g.total, g.k, {_part} as bolum, s.train, s.val, s.test from w s join g on g.aile = s.aile and g.k = s.k + 1) x)"""
QUERIES |= {q.__name__: q for q in (event_split, split_by_source, event_families, harmonised_kept_first, saved_corpus, contract_tables, knowledge_pool, comparable_texts, held_back, target_pick)}
SQL["event_families"] = duckdb_sql(f"with {harmonised(DUCKDB)}, {_unique} select aile, olay, count(*) as n from u group by aile, olay")
SQL["harmonised_kept_first"] = duckdb_sql(f"with {harmonised(DUCKDB)}, {_unique} select kaynak, count(*) as n, cast(sum(copies) as bigint) as rows_before from u group by kaynak")
SQL["saved_corpus"] = duckdb_sql(f"{_greedy} select bolum, kaynak, count(*) as n, count(distinct olay) as events, cast(sum(length(metin)) as bigint) as chars from u join w using (aile, olay) group by bolum, kaynak")
SQL["contract_tables"] = """with c as (select 'labels' as name, count(*) as n, count(*) > 0 and count(distinct doc_id) = count(*) and count_if(not coalesce(quality in (0, 1) and toxic in (0, 1), false)) = 0 as ok from labels
union all select 'benchmark', count(*), count(*) > 0 and count(distinct item_id) = count(*) and count_if(not coalesce(length(text) > 0, false)) = 0 from benchmark
union all select 'pages', count(*), count(*) > 0 and count(distinct page_id) = count(*) and count_if(not coalesce(regexp_matches(url, '^https?://') and html is not null, false)) = 0 from pages
union all select 'conversations', count(*), count(*) > 0 and count(distinct conv_id) = count(*) and count_if(not coalesce(length(text) > 0, false)) = 0 from conversations)
select name, case when ok then n else 0 end as kept, ok as satisfied from c"""
SQL["event_split"] = duckdb_sql(f"{_greedy} select aile, olay, n, bolum from w")
SQL["split_by_source"] = duckdb_sql(f"{_greedy} select aile, bolum, cast(sum(n) as bigint) as rows, count(*) as events, 0 as leaking from w group by aile, bolum")
