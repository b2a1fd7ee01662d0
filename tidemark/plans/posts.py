"""Crisis posts: texts of a table with what people add to them, scored by lexicon, judged by rules, queued and clustered.

Each turn of ``conversations`` is the text of a post; a phrase before it, one after it and one at the end depend on its id.
Every expression is written once (see ``functions.dialect``) and evaluated for every post.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as lx
from ..functions.dialect import DUCKDB, SPARK, Dialect, Lookup, Steps, interpolated, names_in, necessary, needed, number, rounded, stepped, stepped_sql
from ..scratch import kept, materialize
from . import knowledge, provenance

URL, MENTION, SPACE = "https?://[^ \\t\\n\\x0B\\f\\r]+|www\\.[^ \\t\\n\\x0B\\f\\r]+", "@[\\p{L}\\p{N}_]+", "[ \\t\\n\\x0B\\f\\r]+"
ACCENTS = lx.accents()


def quoted(s: str) -> str:
    return "'" + s + "'"


def normalized(d: Dialect, x: str) -> str:
    """Fold case and accents, mask links and mentions, drop what marks are left, collapse white space."""
    t = f"lower(translate(replace({x}, 'ß', 'ss'), 'İI', 'ii'))"
    t = d.replace(d.replace(t, URL, " <url> "), MENTION, " <kullanici> ")
    t = d.replace(f"translate({t}, '{ACCENTS[0]}', '{ACCENTS[1]}')", "\\p{Mn}+", "")
    return f"trim({d.replace(t, SPACE, ' ')})"


def aligned(x: str) -> str:
    """Fold letter by letter, so that places in the result are places in the text."""
    return f"lower(translate({x}, '{lx.FOLD_FROM}', '{lx.FOLD_TO}'))"


def standard_suffixes(d: Dialect, norm: str) -> str:
    """Spoken endings in their written form; the present tense follows the last vowel of the root."""
    stem, rest = "([a-z0-9_]*[aiou][b-df-hj-np-tv-z0-9_]*)", "([a-z0-9_]+)"
    for p, by in [(stem + "[ae]yr(?:ler|lar)\\b", "$1uyorlar"), (stem + "[ae]yr\\b", "$1uyor"), (rest + "[ae]yr(?:ler|lar)\\b", "$1iyorlar"), (rest + "[ae]yr\\b", "$1iyor"), *lx.SUFFIXES]:
        norm = d.replace(norm, p, by)
    return norm


def match_score(d: Dialect, norm: str, patterns: list[tuple[str, float]]) -> str:
    """One minus the product of (1 - weight) over the patterns that match; literals settle most texts."""
    left = " * ".join(f"(case when {d.like(norm, p)} then {number(round(1 - w, 6))} else 1e0 end)" for p, w in patterns)
    return f"(case when {any_of(d, norm, [p for p, _ in patterns])} then {rounded('1e0 - ' + left)} else 0e0 end)"


def first_of(d: Dialect, norm: str, patterns: list[tuple[str, str]]) -> str:
    """The name beside the first pattern that matches; ``{0}`` in it is the pattern's group."""
    whens = [f"when {d.like(norm, p)} then " + (f"concat({d.extract(norm, p, 1)}, '{name[3:]}')" if name.startswith("{0}") else quoted(name)) for p, name in patterns]
    return f"case {' '.join(whens)} end"


def any_of(d: Dialect, norm: str, patterns: list[str]) -> str:
    """Whether a pattern matches. Where each has literals that its matches need, only texts with one of these are looked at closer."""
    whole = d.like(norm, "|".join(f"(?:{p})" for p in patterns))
    needs = [necessary(p) for p in patterns]
    if not all(needs):
        return whole
    literals = sorted(frozenset().union(*needs))
    shortest = [x for x in literals if not any(y != x and y in x for y in literals)]
    return f"(({' or '.join(d.contains(norm, quoted(x)) for x in shortest)}) and {whole})"


def claim_text(d: Dialect, patterns: list[str]) -> str:
    """What the first pattern that matches covers, in the spelling of the text."""
    whens = []
    for p in patterns:
        m = d.extract("aligned", p)
        whens.append(f"when {m} <> '' then trim(substring(body, cast(instr(aligned, {m}) as int), cast(length({m}) as int)))")
    return f"(case when {any_of(d, 'aligned', patterns)} then case {' '.join(whens)} end end)"


BASE = "select cast(conv_id * 100 + turn as bigint) as post_id, cast(conv_id % 37 as bigint) as author_id, cast(conv_id * 60 + turn as bigint) as minute, text from conversations"
CLAIM_COLUMNS = {t: f"claim_{k}" for k, t in enumerate(lx.CLAIMS)}


def body_steps(d: Dialect) -> Steps:
    def phrase(phrases: list[str], index: str) -> str:
        return f"nullif({d.at(d.array(*map(quoted, phrases)), index)}, '')"

    kinds = d.array(*map(quoted, ("yok", "image", "video", "grid", "image")))
    return [
        {
            "body": f"concat_ws(' ', {phrase(lx.OPENERS, d.div('post_id', '3') + ' % 16')}, text, {phrase(lx.MIDDLES, d.div('post_id * 5', '7') + ' % 16')}, {phrase(lx.CLOSERS, d.div('post_id * 11', '13') + ' % 16')})",
            "media_kind": d.at(kinds, d.div("post_id", "2") + " % 5"), "spread": "(post_id * 37 % 1000) / 10e0",
        },
        {"fingerprint": "case when media_kind = 'yok' then null when post_id % 6 = 0 then concat('sessiz-', cast(post_id as varchar(20))) else concat('ses-', cast(post_id as varchar(20))) end"},
    ]


def text_steps(d: Dialect) -> Steps:
    slugs = d.array(*map(quoted, lx.CITIES))
    names = d.array(*[quoted(lx.CITY_NAMES.get(c, c.capitalize())) for c in lx.CITIES])
    found = d.every("norm", "\\b(" + "|".join(lx.CITIES) + ")", 1)
    at = d.lowest(d.each(found, "c", d.place(slugs, "c")))
    best = "greatest(" + ", ".join(lx.LABELS) + ")"
    dominant = f"case when {best} <= 0 then 'notr_bilgilendirme' " + " ".join(f"when {k} = {best} then '{k}'" for k in lx.LABELS) + " end"
    first = "trim(" + d.extract("trim(body)", "^[^.!?\\n]*") + ")"
    claims = list(CLAIM_COLUMNS.values())
    fallback = f"case when city is not null or magnitude is not null or source is not null then substring(coalesce(nullif({first}, ''), trim(body)), 1, 110) end"
    return [
        {"norm": normalized(d, "body"), "aligned": aligned("body")},
        {"spoken": standard_suffixes(d, "norm")},
        {k: f"greatest({match_score(d, 'norm', p)}, case when spoken = norm then 0e0 else {match_score(d, 'spoken', p)} end)" for k, p in lx.LABELS.items()}
        | {"help_raw": match_score(d, "norm", lx.HELP_CALL), "help_doubt": match_score(d, "norm", lx.HELP_CALL_NEGATIVES), "debunk": match_score(d, "norm", lx.DEBUNK)},
        {
            "help": rounded("greatest(help_raw - help_doubt * help_raw, 0.55e0 * help_raw)"), "manipulative": best, "dominant": dominant,
            "city": f"case when {d.size(found)} > 0 then {d.at(names, f'({at} - 1)')} end", "magnitude": f"nullif(replace({d.extract('norm', lx.MAGNITUDE, 1)}, '.', ','), '')",
            "time_expr": first_of(d, "norm", lx.TIMES), "source": first_of(d, "norm", lx.SOURCES),
            "certainty": f"case when {any_of(d, 'norm', lx.ABSOLUTE)} then 'mutlak' when {any_of(d, 'norm', lx.RUMOUR)} then 'söylenti' else 'olasılıksal' end",
        } | {CLAIM_COLUMNS[t]: claim_text(d, p) for t, p in lx.CLAIMS.items()},
        {"typed_claims": f"concat_ws(' ', {', '.join(claims)})", "unclear_claim": f"case when coalesce({', '.join(claims)}) is null then {fallback} end"},
        {
            "claims": "coalesce(nullif(typed_claims, ''), unclear_claim)",
            "claim_type": "case " + " ".join(f"when {c} is not null then '{t}'" for t, c in CLAIM_COLUMNS.items()) + " when unclear_claim is not null then 'belirsiz' end",
            "claim": f"coalesce({', '.join(claims)}, unclear_claim)",
        },
        {"claims_norm": normalized(d, "claims")},
    ]


MATCH, VERIFIED = 0.34, 0.25


def knowledge_steps(d: Dialect, least: float = MATCH, allowed: str = "true") -> Steps:
    """What official sources say, from the best record of the pool and its likeness. ``allowed`` may name a condition on the record."""
    verdict = f"case when claims is null then null when record is null then '{lx.SILENT}' when rating_norm = 'yanlis' then '{lx.CONTRADICTS}' when rating_norm = 'dogru' then '{lx.SUPPORTS}' else '{lx.UNRELATED}' end"
    return [
        {"record": f"case when claims is not null and similarity >= {number(least)} and ({allowed}) then best_record end"},
        {"rating_norm": normalized(d, "rating")}, {"knowledge": verdict},
        {"knowledge_raw": "case " + " ".join(f"when knowledge = '{k}' then {number(v)}" for k, v in lx.KNOWLEDGE_SCORES.items()) + " end"},
    ]


def answered(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` with the columns of ``found(post_id, ..)``, which is written first.

    Spark plans a query anew after each of its stages. A look-up has a dozen, and the steps after it have the longest expressions of
    all; in one query the driver would hold and translate these a dozen times. An answer is many times its file, so it isn't broadcast.
    """
    return rows.join(materialize(found).hint("merge"), "post_id", "left")


def pool_lookup(pool: DataFrame | None) -> Lookup:
    """The best record of the pool; its likeness is 0 where there is none."""

    def joined(df: DataFrame) -> DataFrame:
        rows = materialize(df)  # asked and joined to the answer
        claims = rows.where("claims_norm is not null").select(F.col("post_id").alias("id"), F.col("claims_norm").alias("text"))
        best = knowledge.best_records(claims, pool).withColumnRenamed("id", "post_id")
        return answered(rows, best).withColumn("similarity", F.coalesce("similarity", F.lit(0.0)))

    columns = ("best_record", "best_ord", "similarity", "rating")
    picked = "b.best_record, b.best_ord, coalesce(b.similarity, 0.0::double) as similarity, b.rating"
    return Lookup(columns, ("post_id", "claims_norm"), joined, lambda p: f"{knowledge.pool_sql(p)}, {knowledge.best_sql(p)}", lambda p: f"select x.*, {picked} from {p} x left join best b on b.post_id = x.post_id")


def located_conflict(d: Dialect, claimed: str, place: str) -> str:
    """Whether no part of a recorded place holds the claimed one or is held by it."""
    parts = d.kept(d.each(d.split(place, "[/,]"), "p", normalized(d, "p")), "p", "p <> ''")
    own = normalized(d, claimed)
    return f"coalesce({claimed} is not null and {place} is not null and not {d.some(parts, 'p', f'({d.contains(own, chr(112))} or {d.contains(chr(112), own)})')}, false)"


CONCLUSIVE = 0.88


def provenance_steps(d: Dialect) -> Steps:
    """Where a post's picture was seen first, by the entry of the index that is nearest, if one is near."""
    return [
        {"matched": "distance is not null", "likeness": f"round(1 - distance / {number(float(provenance.BITS))}, 4)", "place": "original"},
        {"conflict": located_conflict(d, "city", "place")},
        {"provenance_raw": "case when media_kind = 'yok' then null when matched then likeness else 0e0 end", "conclusive": f"coalesce(likeness >= {number(CONCLUSIVE)}, false)"},
    ]


def index_lookup(found) -> Lookup:
    """What ``found(posts)`` says of the posts' pictures."""

    def joined(df: DataFrame) -> DataFrame:
        rows = materialize(df)
        return answered(rows, found(rows))

    return Lookup(
        ("distance", "record_id", "original"), ("post_id", "media_kind"), joined, lambda p: f"{provenance.INDEX_SQL}, {provenance.posts_sql(p)}",
        lambda p: f"select x.*, i.distance, i.record_id, i.original from {p} x left join seen i on i.post_id = x.post_id",
    )


def media_steps(d: Dialect) -> Steps:
    """Scores of media models come as columns; they are not asked for without media or after a conclusive match."""

    def draw(factor: int) -> str:
        return f"(post_id * {factor} % 1000) / 1000e0"

    return [
        {"has_audio": "media_kind in ('video', 'grid') and fingerprint is not null and not " + d.contains("lower(fingerprint)", "'sessiz'"), "runs_media": "media_kind <> 'yok' and not conclusive"},
        {
            "video_abstains": "runs_media and post_id % 9 = 4",
            "video_raw": f"case when runs_media and media_kind <> 'video' and post_id % 9 <> 4 then {draw(331)} end", "clip_raw": f"case when runs_media and media_kind = 'video' and post_id % 9 <> 4 then {draw(577)} end",
            "audio_raw": f"case when runs_media and has_audio then {draw(719)} end", "c2pa_raw": "case when runs_media and post_id % 29 = 3 then 1e0 end", "metadata_raw": "case when runs_media and post_id % 31 = 5 then 1e0 end",
            "sync_raw": f"case when runs_media and has_audio then {draw(883)} end", "face_raw": f"case when runs_media and has_audio then {draw(97)} end",
            "scene_raw": f"case when runs_media and claims is not null then {draw(613)} end",
        },
    ]


#: Signals in the order in which they come: key, raw column, knots by key or as they are.
SIGNALS = {
    "text.manipulative": "case when length(norm) >= 12 then manipulative end", "text.help_call": "help", "text.debunk": "case when debunk > 0 then debunk end", "text.claim": "case when claims is not null then case when certainty = 'mutlak' then 1e0 else 0.6e0 end end",
    "provenance.match": "provenance_raw", "knowledge.verdict": "knowledge_raw", "multimodal.av_sync": "sync_raw", "multimodal.speaker_face": "face_raw", "multimodal.scene_claim": "scene_raw",
    "synthetic.video": "video_raw", "synthetic.video_clip": "clip_raw", "synthetic.audio": "audio_raw", "synthetic.c2pa": "c2pa_raw", "synthetic.metadata": "metadata_raw",
}
COLUMN = {k: k.replace(".", "_") for k in SIGNALS}
#: By branch: verdict, confidence, keys of the signals that decide; no keys: all that don't abstain.
BRANCHES = {
    1: (lx.OUT_OF_CONTEXT, "least(0.97e0, provenance_match)", ["provenance.match", "text.manipulative", "knowledge.verdict"]),
    2: (lx.SYNTHETIC_MEDIA, "least(0.96e0, synthetic)", ["synthetic.video", "synthetic.video_clip", "synthetic.audio", "synthetic.c2pa", "synthetic.metadata", "multimodal.av_sync"]),
    3: (lx.MANIPULATED_MEDIA, "least(0.95e0, changed + case when agreeing >= 0.45e0 then 0.06e0 else 0e0 end)", ["multimodal.av_sync", "multimodal.speaker_face", "synthetic.audio"]),
    4: (lx.OUT_OF_CONTEXT, "least(0.90e0, multimodal_scene_claim)", ["multimodal.scene_claim", "text.manipulative", "knowledge.verdict"]),
    5: (lx.UNVERIFIED, "least(0.94e0, knowledge_verdict)", ["knowledge.verdict", "text.claim", "text.manipulative"]),
    6: (lx.UNVERIFIED, "least(0.88e0, 0.45e0 + 0.30e0 * greatest(text_manipulative, multimodal_scene_claim))", ["knowledge.verdict", "text.claim", "text.manipulative", "multimodal.scene_claim"]),
    7: (lx.PROVOKING, "least(0.92e0, text_manipulative)", ["text.manipulative", "text.claim"]),
    8: (lx.UNKNOWN, "0e0", []), 9: (lx.UNKNOWN, "1 - strongest", []), 10: (lx.UNKNOWN, "1 - strongest", []), 11: (lx.CLEAN, "1 - strongest", []),
}


def fusion_steps(d: Dialect) -> Steps:
    scores = {c: f"coalesce({interpolated(f'({SIGNALS[k]})', lx.KNOTS.get(k, lx.IDENTITY))}, 0e0)" for k, c in COLUMN.items()}
    live = {f"has_{c}": f"({SIGNALS[k]}) is not null" for k, c in COLUMN.items()}
    keys = {b: d.kept(d.array(*[f"case when has_{COLUMN[k]} then '{k}' end" for k in (ks or SIGNALS)]), "k", "k is not null") for b, (*_, ks) in BRANCHES.items()}
    branch = f"""case when matched and provenance_match >= {number(lx.CONTEXT)} and conflict then 1 when synthetic >= {number(lx.SYNTHETIC)} then 2 when changed >= {number(lx.MANIPULATED)} then 3
        when multimodal_scene_claim >= {number(lx.SCENE)} and not (matched and not conflict) then 4 when not debunking and coalesce(knowledge = '{lx.CONTRADICTS}', false) and knowledge_verdict >= {number(lx.CONTRADICTED)} then 5
        when claims is not null and not debunking and coalesce(knowledge = '{lx.SILENT}', false) and (text_manipulative >= 0.35e0 or multimodal_scene_claim >= 0.50e0) then 6 when text_manipulative >= {number(lx.PROVOCATIVE)} then 7
        when informative = 0 then 8 when video_abstains and strongest < {number(lx.ABSTENTION_FLOOR)} then 9
        when strongest >= {number(lx.ABSTENTION_FLOOR)} and strongest < {number(lx.ABSTENTION)} and informative < 3 then 10 else 11 end"""
    return [
        live | {"bounded": "true"}, {k: v.replace("case when length(norm) >= 12 then manipulative end", "case when has_text_manipulative then manipulative end") for k, v in scores.items()},
        {
            "synthetic": "greatest(synthetic_video, synthetic_video_clip, synthetic_audio, synthetic_c2pa, synthetic_metadata)", "changed": "greatest(multimodal_av_sync, multimodal_speaker_face)",
            "agreeing": "least(multimodal_av_sync, multimodal_speaker_face)", "debunking": f"debunk >= {number(lx.DEBUNKED)}", "informative": " + ".join(f"cast(has_{c} as int)" for c in COLUMN.values()),
        },
        {"strongest": "greatest(provenance_match, synthetic, changed, text_manipulative, multimodal_scene_claim, case when debunking then 0e0 else knowledge_verdict end)"},
        {"branch": branch},
        {
            "fused": "case branch " + " ".join(f"when {b} then '{v}'" for b, (v, *_) in BRANCHES.items()) + " end", "fused_confidence": rounded("case branch " + " ".join(f"when {b} then {c}" for b, (_, c, _) in BRANCHES.items()) + " end"),
            "contributors": d.joined("case branch " + " ".join(f"when {b} then {k}" for b, k in keys.items()) + " end", ","),
        },
        {"rule_zero": f"help > {number(lx.RULE_ZERO)}"},
        {"verdict": f"case when rule_zero then '{lx.CLEAN}' else fused end", "confidence": "case when rule_zero then greatest(fused_confidence, help) else fused_confidence end"},
        {
            "level": f"""case when rule_zero then 0 when spread >= {number(lx.REVIEW_SPREAD)} and fused_confidence >= {number(lx.HIGH_CONFIDENCE)} and fused not in ('{lx.CLEAN}', '{lx.UNKNOWN}') then 4
                else case fused {' '.join(f"when '{v}' then " + (f"case when fused_confidence < {number(lx.HIGH_CONFIDENCE)} then 2 else 3 end" if n == 3 else str(n)) for v, n in lx.LADDER.items())} end end""",
            "confidence_label": "case when confidence >= 0.75e0 then 'yüksek' when confidence >= 0.50e0 then 'orta' else 'düşük' end",
        },
    ]


STAGES = {"body": body_steps, "text": text_steps, "knowledge": knowledge_steps, "provenance": provenance_steps, "media": media_steps, "fusion": fusion_steps}


def steps(d: Dialect, until: str, pool: DataFrame | None = None, found=None) -> Steps:
    """All steps up to a stage. Spark's need the ``pool`` and what an index says of pictures, ``found(posts)``, if these are asked."""
    lookups = {"knowledge": [pool_lookup(pool)], "provenance": [index_lookup(found)]}
    names = list(STAGES)
    return [s for name in names[: names.index(until) + 1] for s in [*lookups.get(name, []), *STAGES[name](d)]]


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of a small table in as many partitions as there are cores: expressions are dear, rows are few."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)


def base_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(BASE.replace("conversations", "{conversations}"), conversations=spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def pool_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pool of records, with bulletins on claims of some of the posts; it is made once."""

    def make() -> DataFrame:
        rows = stepped(dealt(base_rows(spark, sf_dir).where(knowledge.OF)), steps(SPARK, "text"), ["post_id", "claims_norm"])
        pool = knowledge.saved_pool(spark, rows.where("claims_norm is not null").select("post_id", "claims_norm"))
        return knowledge.spread(pool, "ord")  # so that all tasks read a part of it

    return kept(spark, "pool", sf_dir, make)


def posts(spark: SparkSession, sf_dir: str, until: str = "fusion", wanted: list[str] | set[str] | None = None) -> DataFrame:
    """The posts with the columns of all stages up to one, or with those that are ``wanted`` of them."""
    plan = steps(SPARK, until)
    asks = wanted is None or any(isinstance(s, Lookup) and "best_record" in s.columns for s, _ in needed(plan, wanted))
    pool = pool_of(spark, sf_dir) if asks and until not in ("body", "text") else None
    return stepped(dealt(base_rows(spark, sf_dir)), steps(SPARK, until, pool, lambda rows: provenance.looked_up_posts(rows, spark, sf_dir)), wanted)


def queries(d: Dialect) -> dict[str, tuple[str, str]]:
    """By name: the stage that the query needs and the query over ``posts``."""
    labels = ", ".join(lx.LABELS)
    signal_rows = d.several("post_id", [{"key": f"'{k}'", "raw_score": f"cast({SIGNALS[k]} as double)", "abstained": f"({SIGNALS[k]}) is null"} for k in list(SIGNALS)[:4]], "posts", "key in ('text.manipulative', 'text.help_call') or not abstained")
    fields = {c: c for c in ("city", "magnitude", "time_expr", "source", "certainty")}
    claim_rows = d.several("post_id", [{"claim_type": f"'{t}'", "claim": c, **fields} for t, c in {**CLAIM_COLUMNS, "belirsiz": "unclear_claim"}.items()], "posts", "claim is not null")
    calibrated = d.several("post_id", [{"key": f"'{k}'", "score": c, "abstained": f"not has_{c}"} for k, c in COLUMN.items()], "posts")
    shown_rows = d.several("post_id", [{"key": f"'{k}'", "part": f"case when not has_{c} then 'abstains' when {d.contains('concat(contributors, chr(44))', quoted(k + ','))} then 'decides' end"} for k, c in COLUMN.items()], "posts", "part is not null")

    def hits(patterns: list[tuple[str, float]], most: int) -> str:
        found = d.kept(d.array(*[f"nullif(trim({d.extract('norm', p)}), '')" for p, _ in patterns]), "h", "h is not null")
        return f"slice({found}, 1, {most})" if d.spark else f"({found})[1:{most}]"

    both = " || ".join(f"(case when {k} > 0 then {hits(p, 2)} else {d.array()}{' ' if d.spark else '::varchar[]'} end)" for k, p in lx.LABELS.items())
    shown = f"slice(concat({both.replace(' || ', ', ')}), 1, 4)" if d.spark else f"({both})[1:4]"
    first_help = f"{hits(lx.HELP_CALL, 3)}"
    begin = "instr(lower(translate(body, 'İ', 'i')), lower(translate(claim, 'İ', 'i')))"
    span = f"case when {begin} > 0 then concat(cast({begin} - 1 as varchar(10)), '–', cast({begin} - 1 + length(claim) as varchar(10))) end"
    flagged = f"verdict not in ('{lx.CLEAN}', '{lx.UNKNOWN}') and not rule_zero"
    return {
        "crisis_posts_scan": ("body", "select post_id, author_id, minute, body, media_kind, fingerprint, spread from posts"),
        "text_normalize": ("text", "select post_id, norm, aligned from posts"),
        "dialect_normalize": ("text", "select post_id, spoken, spoken <> norm as changed from posts"),
        "label_scores": ("text", f"select post_id, {labels}, case when manipulative > 0 then 0e0 else 1e0 end as notr_bilgilendirme from posts"),
        "dominant_label": ("text", "select dominant as label, count(*) as n from posts group by dominant"),
        "help_call_score": ("text", "select post_id, help_raw, help_doubt, help from posts"),
        "debunk_score": ("text", "select post_id, debunk, debunk >= 0.55e0 as debunking from posts"),
        "claim_extraction": ("text", claim_rows),
        "primary_claims": ("text", f"select post_id, claim_type, claim, {span} as place from posts where claims is not null"),
        "evidence_caps": ("text", f"select post_id, {d.joined(shown, '|')} as evidence, {d.joined(first_help, '|')} as help_evidence, {d.joined(hits(lx.DEBUNK, 2), '|')} as debunk_evidence from posts"),
        "text_signals": ("text", signal_rows),
        "knowledge_match": ("knowledge", "select post_id, best_record, record, similarity, knowledge, knowledge_raw from posts where claims is not null"),
        "knowledge_counts": ("knowledge", "select coalesce(knowledge, 'yok') as knowledge, count(*) as n, round(avg(similarity), 6) as mean_similarity from posts group by coalesce(knowledge, 'yok')"),
        "provenance_context": ("provenance", "select post_id, matched, record_id, distance, likeness, city, place, conflict, provenance_raw, conclusive from posts where media_kind <> 'yok'"),
        "media_cascade": ("media", "select post_id, has_audio, runs_media, case when conclusive then 'conclusive' when media_kind = 'yok' then 'no media' end as skipped from posts"),
        "modalities": ("media", "select post_id, concat_ws(',', case when trim(body) <> '' then 'text' end, case when media_kind in ('image', 'grid') then 'image' end, case when media_kind = 'video' then 'video' end, case when has_audio then 'audio' end) as modalities from posts"),
        "calibrated_signals": ("fusion", calibrated),
        "shown_signals": ("fusion", shown_rows),
        "fused_verdicts": ("fusion", "select post_id, branch, fused, fused_confidence, contributors, informative from posts"),
        "text_verdicts": ("fusion", "select post_id, manipulative, help, rule_zero, verdict, confidence, confidence_label, level from posts"),
        "policy_ladder": ("fusion", "select post_id, level, level <> 4 as automatic, rule_zero as protected, false as content_removed, case when rule_zero or level <> 0 then concat(cast(cast(round(confidence * 100 + 1e-7) as int) as varchar(5)), '%') end as card from posts"),
        "labelled_posts": ("fusion", f"select post_id, verdict, level from posts where {flagged}"),
        "radar_counters": ("fusion", f"""select verdict, count(*) as n, count_if(rule_zero) as protected, count_if(level = 4) as reviews, round(avg(case when level = 4 then 1e0 else 0e0 end), 6) as review_rate from posts group by verdict"""),
        "radar_snapshot": ("fusion", f"""select count(*) as analyzed, count_if({flagged}) as labelled, count_if({flagged} and verdict in ('{lx.SYNTHETIC_MEDIA}', '{lx.MANIPULATED_MEDIA}') and confidence >= 0.70e0) as high_confidence_synthetic,
            count_if({flagged} and verdict = '{lx.OUT_OF_CONTEXT}') as wrong_context, count_if({flagged} and verdict = '{lx.UNVERIFIED}') as unverified, count_if(rule_zero) as protected_help_calls, 0 as removed from posts"""),
        "posts_newest": ("body", "select post_id, author_id, minute from posts order by minute desc, post_id desc limit 50"),
        "publish_audit": ("fusion", "select post_id, 'published' as action, level, level = 3 as shared_despite_warning from posts union all select post_id, 'koruma_kurali_uygulandi', level, false from posts where rule_zero"),
        "result_cache": ("body", "select sha2(concat(body, '|', media_kind, '|', coalesce(fingerprint, '')), 256) as cache_key, count(*) as n, min(post_id) as first_post from posts group by 1".replace("sha2(", "sha2(" if d.spark else "sha256(").replace(", 256)", ", 256)" if d.spark else ")")),
    }


def query_of(name: str, stage: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        sql = _SPARK[name][1].replace(" posts", " {posts}").replace("{posts}.", "posts.")
        return spark.sql(sql, posts=posts(spark, sf_dir, stage, names_in(_SPARK[name][1])))

    query.__name__ = name
    return query


_SPARK, _DUCK = queries(SPARK), queries(DUCKDB)
QUERIES = {name: query_of(name, stage) for name, (stage, _) in _SPARK.items()}
SQL = {name: stepped_sql(BASE, steps(DUCKDB, stage)) + sql for name, (stage, sql) in _DUCK.items()}


def label_scores_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicons over whole documents: how many match each label. Literals settle the texts without any."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("lang", f"{normalized(SPARK, 'text')} as norm")
    rows = stepped(rows, [{k: v for k, v in _matches(SPARK).items()}])
    return rows.groupBy("lang").agg(F.count("*").alias("n"), *[F.count_if(c).alias(c) for c in _matches(SPARK)])


def _matches(d: Dialect) -> dict[str, str]:
    names = {"magnitude": [lx.MAGNITUDE], "help": [p for p, _ in lx.HELP_CALL], "debunked": [p for p, _ in lx.DEBUNK]} | {k: [p for p, _ in v] for k, v in lx.LABELS.items()}
    return {k: any_of(d, "norm", p) for k, p in names.items()}


QUERIES["label_scores_documents"] = label_scores_documents
SQL["label_scores_documents"] = f"with d as (select lang, {normalized(DUCKDB, 'text')} as norm from documents) select lang, count(*) as n, " + ", ".join(f"count_if({e}) as {k}" for k, e in _matches(DUCKDB).items()) + " from d group by lang"
