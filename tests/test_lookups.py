"""Look-ups in tables: terms in texts, records of claims, pictures in an index; and steps without what nobody reads."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions.dialect import SPARK, stepped
from tidemark.operators import similarity
from tidemark.operators.containment import contained
from tidemark.plans import knowledge, posts, provenance


def test_terms_inside_texts(spark):
    """Short terms, terms that overlap, other scripts, nulls, repeated rows and terms that are nowhere."""
    r = random.Random(4)
    texts = [(k, "".join(r.choice("abcçğ 東") for _ in range(r.randrange(40)))) for k in range(300)] + [(900, None), (901, ""), (902, "abc" * 5000 + "zq")]
    terms = sorted({"".join(r.choice("abcçğ東 ") for _ in range(r.randrange(1, 5))) for _ in range(200)} | {"zq", "nowhere"})
    got = [tuple(x) for x in contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(t,) for t in [*terms, terms[0], None, ""]], "term string")).collect()]
    want = [(k, t) for k, x in texts if x for t in terms if t and t in x]
    assert sorted(got) == sorted(want) and len(want) > 500
    assert contained(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([], "term string")).count() == 0


def plain_best(text, pool):
    """One record after another: anchors, share of key terms, the first of equals."""
    best = (0.0, None)
    for r in sorted(pool, key=lambda r: r.ord):
        if any(a in text for a in r.anchors) and r.keywords:
            share = round(sum(k in text for k in r.keywords) / len(r.keywords) + 1e-9, 4)
            if share > best[0]:
                best = (share, r.record_id)
    return best


def test_records_of_claims(spark):
    r = random.Random(5)
    words = ["baraj", "barajlar", "yikildi", "izmir", "sel", "selale", "deprem", "ikinci", "kopru", "yol", "kapandi", "van", "bina coktu", "tahliye"]
    claims = [(k, " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for k in range(200)] + [(500, ""), (501, None)]
    rows = spark.createDataFrame(claims, "id long, text string")
    more = [(100 + k, f"B{k}", w, "Karma", [w, "izmir"], [w]) for k, w in enumerate(words)] + [(200, "no anchor", "x", "Karma", ["izmir"], []), (201, "no terms", "x", "Karma", [], ["sel"]), (202, "same again", "x", "Karma", ["baraj", "izmir"], ["baraj"])]
    pool = knowledge.seeds(spark).union(spark.createDataFrame(more, knowledge.RECORD))
    got = {x.id: (x.similarity, x.best_record) for x in knowledge.best_records(rows, pool).collect()}
    told = pool.collect()
    want = {k: plain_best(t, told) for k, t in claims if t}
    assert got == {k: v for k, v in want.items() if v[1]} and len(got) > 100


def test_pairs_are_told_apart_without_holding_them(spark):
    """A record meets a text once, whichever of its anchors are there; empty and repeated anchors count for nothing."""
    pool = spark.createDataFrame([(1, "A", "x", "Karma", ["sel"], ["sel", "van", "sel"]), (2, "B", "x", "Karma", ["van", "yol"], ["", "yol", "van"]), (3, "C", "x", "Karma", ["sel"], [""])], knowledge.RECORD)
    claims = spark.createDataFrame([(7, "van sel"), (8, "van yol"), (9, "yok")], "id long, text string")
    found = knowledge.scored_records(claims, pool)
    assert sorted((r.id, r.ord, r.similarity) for r in found.collect()) == [(7, 1, 1.0), (7, 2, 0.5), (8, 1, 0.0), (8, 2, 1.0)]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and not re.search(r"keys=\[id#\d+L, ord#", plan)


def test_records_are_never_broadcast(spark):
    """Records with their terms outgrow what Spark judges them by; a frequent anchor's records are dealt, and pairs aren't sorted."""
    more = [(100 + k, f"B{k}", f"sel {k}", "Karma", ["sel", f"yer{k}x"], ["sel"]) for k in range(3 * knowledge.MET)]
    pool = spark.createDataFrame(more, knowledge.RECORD)
    claims = spark.createDataFrame([(7, "sel yer600x"), (8, "sel"), (9, "yok")], "id long, text string")
    scored, best = knowledge.scored_records(claims, pool), knowledge.best_records(claims, pool)
    assert scored.count() == 2 * len(more)
    assert sorted(map(tuple, best.collect())) == [(7, "B600", 700, 1.0, "Karma"), (8, "B0", 100, 0.5, "Karma")]
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (scored, best)]
    assert all("SortMergeJoin" in p and "Broadcast" not in p for p in plans)
    assert not re.search(r"SortAggregate\(key=\[id#", plans[1])


def test_records_with_the_same_claim_meet_once(spark):
    """Of records with one claim only the first k can be among the nearest k; vectors are worked out in many tasks."""
    pool = spark.createDataFrame([(k, f"R{k}", "baraj yikildi" if k < 40 else f"sel {k}", "Karma", [], []) for k in range(60)], knowledge.RECORD)
    kept = knowledge.pool_vectors(pool, 3)
    assert sorted(r.vec_id for r in kept.collect()) == [0, 1, 2, *range(40, 60)]
    claims = spark.createDataFrame([(7, "baraj yikildi"), (8, "baraj yikildi"), (9, "sel 45")], "id long, text string")
    near = {r.id: set(r.near) for r in knowledge.near_records(claims, pool, 3).collect()}
    assert near[7] == near[8] == {0, 1, 2} and 45 in near[9] and len(near[9]) == 3


def test_bulletins_have_rare_anchors(spark):
    rows = [(100 * k, f"ortak kelime{k} ve {'nadir' if k == 7 else 'bilinen'}") for k in range(100)] + [(9000000, "...")]
    got = {x.record_id: x for x in knowledge.bulletins(spark.createDataFrame(rows, "post_id long, claims_norm string")).collect()}
    assert len(got) == 100  # the claim without words gives no record
    assert got["B700"].keywords == ["kelime7", "nadir", "ortak"] and got["B700"].anchors == ["kelime7", "nadir"] and got["B800"].anchors == ["kelime8"]


def test_pool_lines_that_cannot_be_read(spark, tmp_path):
    claims = spark.createDataFrame([(100 * k, f"kelime{k}") for k in range(60)], "post_id long, claims_norm string")
    pool = knowledge.saved_pool(spark, claims)
    assert pool.count() == 60 + len(knowledge.SEEDS)
    assert [tuple(r) for r in pool.where("record_id = 'K1'").collect()] == [tuple(r) for r in knowledge.seeds(spark).where("record_id = 'K1'").collect()]


def plain_hashes(x):
    n = len(x)
    return sum((x[(i + 1) % n] > x[i]) << (63 - i) for i in range(n)), sum((v > 0) << (63 - i) for i, v in enumerate(x))


def test_pictures_are_found_by_the_better_hash(spark):
    r = random.Random(6)
    rows = [(k, [r.gauss(0, 1) for _ in range(64)], "olay", f"yer{k}", "01.01.2023") for k in range(120)]
    rows.append((500, rows[3][1], "olay", "copy", "01.01.2023"))  # an equal picture: the lesser id is found
    df = spark.createDataFrame(rows, "record_id long, v array<double>, event string, place string, first_seen string")
    held = spark.createDataFrame([(k,) for k in range(100, 120)], "record_id long")
    index = provenance.index_rows(df, held).withColumns({"d": provenance.long_of(F.col("dhash")), "p": provenance.long_of(F.col("phash"))}).cache()
    assert index.count() == 3 * 101 and index.where("record_id between 100 and 119").count() == 0
    shown = [(k, [v + 0.3 * r.gauss(0, 1) * (k % 2) for v in x]) for k, x, *_ in rows] + [(900, [0.0] * 64)]
    cut = [(k, x if k % 3 else [x[(32 * 20 + i * 80) // 100] for i in range(64)]) for k, x in shown]
    d, p = provenance.hashes(F.col("x"))
    asked = spark.createDataFrame(cut, "id long, x array<double>").select("id", d.alias("d"), p.alias("p"))
    got = {x.id: (x.record_id, x.view, x.kind, x.distance) for x in provenance.looked_up(asked, index).collect()}
    entries = [(x.record_id, k, x.view, x.d % 2**64, x.p % 2**64) for x in index.collect() for k, (n, _) in enumerate(provenance.VIEWS) if n == x.view]
    want = {}
    for k, x in cut:
        a, b = plain_hashes(x)
        near = min((min(((a ^ e[3]).bit_count(), 0), ((b ^ e[4]).bit_count(), 1)), e[0], e[1], e[2]) for e in entries)
        if near[0][0] <= 10 and a.bit_count() >= provenance.FEWEST:
            want[k] = (near[1], near[3], ("dHash", "pHash")[near[0][1]], near[0][0])
    assert got == want and want[500][0] == 3 and 900 not in got
    assert {v for _, v, *_ in want.values()} >= {"tam", "merkez_%80"} and {k for *_, k, _ in want.values()} == {"dHash", "pHash"}


def test_keys_of_hashes_are_never_broadcast(spark):
    """The driver would hold hundreds of keys for each hash; Spark judges them by the size of the hashes."""
    rows = spark.range(50).select(F.col("id").alias("vec_id"), F.xxhash64("id").alias("h"))
    queries = rows.select(F.col("vec_id").alias("query_id"), F.lit("v").alias("view"), F.col("h").bitwiseXOR(F.lit(3)).alias("h"))
    found = similarity.hamming_near(rows, queries)
    assert {(r.query_id, r.vec_id, r.distance) for r in found.collect()} >= {(k, k, 2) for k in range(50)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_hexadecimal_hashes_keep_their_highest_bit(spark):
    rows = spark.createDataFrame([(x,) for x in (0, 1, -1, -(2**63), 2**63 - 1, 0x1234_5678_9ABC_DEF0)], "h long")
    assert all(r.h == r.back for r in rows.withColumn("back", provenance.long_of(provenance.hex_of(F.col("h")))).collect())


def test_steps_that_nobody_reads_are_left_out(spark):
    df = spark.createDataFrame([(1, "Baraj yıkıldı iddiası asılsız", "yok", None, 1.0)], "post_id long, body string, media_kind string, fingerprint string, spread double")
    plan = stepped(df, posts.text_steps(SPARK), ["post_id", "debunk"])
    assert plan.columns == ["post_id", "debunk"]
    optimized = plan._jdf.queryExecution().optimizedPlan().toString()
    assert "istanbul" not in optimized and "aligned" not in optimized
    assert plan.first().debunk == stepped(df, posts.text_steps(SPARK)).first().debunk > 0


@pytest.mark.parametrize("stage", ["knowledge", "provenance"])
def test_lookups_that_nobody_reads_are_not_asked(spark, stage):
    """Neither the pool nor the index is there, and neither is needed."""
    df = spark.createDataFrame([(1, "Merhaba", "image", None, 1.0)], "post_id long, body string, media_kind string, fingerprint string, spread double")
    assert stepped(df, posts.steps(SPARK, stage)[len(posts.body_steps(SPARK)) :], ["post_id", "norm"]).count() == 1


def test_answers_of_lookups_are_written_before_rows_meet_them(spark):
    rows = posts.posts(spark, "/root/testdata/sf0.001", "fusion", ["post_id", "verdict"])
    joins = re.findall(r"\w*Join\b", rows._jdf.queryExecution().executedPlan().toString())
    assert set(joins) == {"SortMergeJoin"} and len(joins) == 1  # of the pictures' answers; those of the claims were joined and written before


def test_isotonic_curves_of_several_signals(spark):
    """Against the definition: the largest of the least of the means; scores beyond the grid, nulls, signals without a fitting half."""
    import numpy as np

    from tidemark.operators import isotonic

    r = random.Random(8)
    rows = [(k, round(r.random(), 2), r.random() < 0.5, int(r.random() < 0.2 + 0.6 * (j % 7 > 3))) for k in ("a", "b") for j in range(400)]
    rows += [("a", None, True, 1), ("a", float("nan"), True, 1), ("a", -3.0, True, 0), ("a", 9.0, True, 1), ("c", 0.5, False, 1)]
    counts = isotonic.counted(spark.createDataFrame(rows, "key string, s double, fit boolean, y int"))
    got = isotonic.calibrated(counts).toPandas()
    assert counts.agg(F.sum("n")).first()[0] == len(rows) - 2 and got[got.key == "c"].p.isna().all()
    for key in ("a", "b"):
        mine = got[got.key == key]
        fit = mine[mine.fit].sort_values("s")
        n, y, s = fit.n.to_numpy(), fit.y.to_numpy(), fit.s.to_numpy()
        want = [max(min(y[a : b + 1].sum() / n[a : b + 1].sum() for b in range(i, len(n))) for a in range(i + 1)) for i in range(len(n))]
        assert np.allclose(fit.p, want, atol=1e-6) and len(n) > 50
        rest = mine[~mine.fit]
        assert np.allclose(rest.p, np.interp(rest.s, s, want), atol=1e-6)
        knots = isotonic.bends(isotonic.calibrated(counts).where(f"fit and key = '{key}'"), 5).orderBy("x").collect()
        assert len(knots) <= 7 and (knots[0].x, knots[-1].x) == (0.0, 1.0) and all(p.y <= q.y for p, q in zip(knots, knots[1:]))
