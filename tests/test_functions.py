"""Expected outcomes of the text, fusion and policy rules, and readers that meet what they should not."""

import math
import os
import re
import subprocess
import sys
import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark import sources
from tidemark.functions import dialect
from tidemark.functions import lexicon as lx
from tidemark.functions.dialect import SPARK, interpolated, stepped
from tidemark.operators import graph, similarity
from tidemark.plans import corpus, knowledge, posts


@pytest.fixture(scope="module")
def judged(spark):
    def run(bodies, **more):
        rows = [(i, b, more.get("media_kind", "yok"), more.get("fingerprint"), more.get("spread", 1.0)) for i, b in enumerate(bodies, more.get("first", 0))]
        df = spark.createDataFrame(rows, "post_id long, body string, media_kind string, fingerprint string, spread double")
        nothing = lambda rows: rows.selectExpr("post_id", "cast(null as long) distance", "cast(null as long) record_id", "cast(null as string) original").where("false")
        steps = posts.steps(SPARK, "fusion", knowledge.seeds(spark), nothing)[len(posts.body_steps(SPARK)) :]
        return sorted(stepped(df, steps).collect(), key=lambda r: r.post_id)

    return run


def test_help_calls_are_protected(judged):
    for r in judged(["ACİL! Kardeşim enkaz altında, hâlâ ses geliyor. Adres: Gül Mah. Yardım edin, ekip gönderin!", "YARDIM EDİN!! Enkaz altındayız, acilen ekip gönderin!"], spread=90.0):
        assert r.rule_zero and r.verdict == lx.CLEAN and r.level == 0 and r.confidence >= r.help > 0.35


def test_verdicts_of_texts(judged):
    clean, provoking, debunk, unverified = judged([
        "Merhaba, bugün hava çok güzel.", "Sorumlular hesap versin, hepimiz sokağa dökülelim! Gerçekleri saklıyorlar.",
        "Baraj yıkıldı iddiası gerçeği yansıtmamaktadır. Hasar bulunmadığını bildirmiştir.", "İzmir için baraj yıkıldı dediler.",
    ])
    assert clean.verdict in (lx.CLEAN, lx.UNKNOWN) and clean.level == 0
    assert provoking.verdict == lx.PROVOKING and provoking.level in (1, 2)
    assert debunk.verdict != lx.UNVERIFIED and debunk.level == 0
    assert unverified.knowledge == lx.CONTRADICTS and unverified.verdict == lx.UNVERIFIED and unverified.level == 1


PATTERNS = sorted({p for some in [*lx.LABELS.values(), lx.HELP_CALL, lx.HELP_CALL_NEGATIVES, lx.DEBUNK] for p, _ in some} | {p for some in lx.CLAIMS.values() for p in some} | {*lx.ABSOLUTE, *lx.RUMOUR, lx.MAGNITUDE})


@given(st.sampled_from(PATTERNS).flatmap(lambda p: st.tuples(st.just(p), st.from_regex(re.compile(p, re.ASCII)))))
@settings(max_examples=1500, deadline=None)
def test_matches_hold_a_literal_that_they_need(case):
    pattern, match = case
    needs = dialect.necessary(pattern)
    assert needs is None or any(x in match for x in needs)


def test_literals_of_patterns():
    known = {"herkes\\s+kac": {"herkes"}, "kacin\\b|kaciniz\\b": {"kacin"}, "a+b": None, "(?:abc)?def": {"def"}, "(?:abc|x)def": {"def"}, "(?:abc)+": {"abc"}, "abcd?": {"abc"}, "[abc]def|gh": None}
    assert {p: (set(n) if (n := dialect.necessary(p)) else None) for p in known} == known
    assert sum(dialect.necessary(p) is not None for p in PATTERNS) > 0.8 * len(PATTERNS)


def test_claim_fields(judged):
    (r,) = judged(["AFAD açıkladı: İstanbul'da 7.4 büyüklüğünde İKİNCİ Büyük Deprem bekleniyor, 6 saat içinde! Kesin bilgi."])
    assert (r.city, r.magnitude, r.time_expr, r.source, r.certainty) == ("İstanbul", "7,4", "6 saat içinde", "AFAD", "mutlak")
    assert (r.claim_1, r.claim_4, r.claim_type) == ("İKİNCİ Büyük Deprem", "AFAD açıklad", "ikincil_afet_uyarısı")
    (r,) = judged(["Muş yolunda trafik var. Sonra bakarız."])
    assert (r.city, r.claim_type, r.claim) == ("Muş", "belirsiz", "Muş yolunda trafik var")


def test_normal_forms(judged):
    bodies = ["İZMİR Çok GÜZEL Öğle ŞİİR âlâ  naïve\tÉté ñ Straße https://a.b/c?d @ali_1 x", "konuşmayrlar geleyr gideyrlar yapayr biliyo"]
    a, b = judged(bodies)
    plain = "".join(c for c in unicodedata.normalize("NFKD", bodies[0].replace("İ", "i").casefold()) if not unicodedata.combining(c)).replace("ı", "i")
    assert a.norm == " ".join(plain.replace("https://a.b/c?d", "<url>").replace("@ali_1", "<kullanici>").split())
    assert b.spoken == "konusmuyorlar geliyor giduyorlar yapuyor biliyor"
    assert len(a.aligned) == len(bodies[0])


def test_saturating_score(judged):
    (r,) = judged(["Hemen paylaşın, silinmeden önce hızlıca yayın!"])
    assert r.aciliyet_baskisi == pytest.approx(1 - 0.3 * 0.4 * 0.45, abs=1e-4) and r.dominant == "aciliyet_baskisi"


def test_branches_in_order(spark):
    base = dict(matched=False, conflict=False, claims=None, knowledge=None, debunk=0.0, norm="bir iki uc dort", manipulative=0.0, help=0.0, certainty="olasılıksal", video_abstains=False, spread=1.0)
    raw = ("provenance_raw", "knowledge_raw", "sync_raw", "face_raw", "scene_raw", "video_raw", "clip_raw", "audio_raw", "c2pa_raw", "metadata_raw")
    cases = {
        1: dict(matched=True, conflict=True, provenance_raw=0.95, clip_raw=1.0), 2: dict(clip_raw=0.9, scene_raw=1.0), 3: dict(sync_raw=0.95, face_raw=0.7, scene_raw=1.0), 4: dict(scene_raw=0.9),
        5: dict(claims="x", knowledge=lx.CONTRADICTS, knowledge_raw=0.92), 6: dict(claims="x", knowledge=lx.SILENT, knowledge_raw=0.45, manipulative=0.5), 7: dict(manipulative=0.7), 9: dict(video_abstains=True), 10: dict(manipulative=0.45, debunk=0.0), 11: dict(),
    }
    rows = [{**base, **{c: None for c in raw}, **c, "post_id": k} for k, c in cases.items()] + [{**base, **{c: None for c in raw}, "matched": True, "provenance_raw": 0.95, "scene_raw": 0.95, "post_id": 100}]
    kinds = {bool: "boolean", int: "long", float: "double", str: "string"}
    schema = ", ".join(f"{c} {'double' if c in raw else kinds[type(v)] if v is not None else 'string'}" for c, v in rows[0].items())
    got = {r.post_id: r for r in stepped(spark.createDataFrame([tuple(r[c] for c in rows[0]) for r in rows], schema), posts.fusion_steps(SPARK)).collect()}
    assert {k: r.branch for k, r in got.items() if k < 100} == {k: k for k in cases}
    assert got[100].fused != lx.OUT_OF_CONTEXT  # the record confirms the context, so the scene does not count
    assert got[1].contributors.split(",")[0] == "provenance.match" and got[2].level == 3 and got[3].fused_confidence == pytest.approx(0.928, abs=0.02)


def test_full_scores_reach_their_thresholds(spark):
    for key, least in (("provenance.match", lx.CONTEXT), ("synthetic.video", lx.SYNTHETIC), ("synthetic.video_clip", lx.SYNTHETIC), ("multimodal.av_sync", lx.MANIPULATED), ("multimodal.scene_claim", lx.SCENE), ("text.manipulative", lx.PROVOCATIVE)):
        assert spark.sql(f"select {interpolated('1e0', lx.KNOTS[key])} as v").first().v >= least


def test_place_conflicts(spark):
    cases = [("İZMİR", "İzmir", False), ("izmir", "İZMİR", False), ("Şanlıurfa", "Adıyaman/Şanlıurfa", False), (None, "Hatay", False), ("İzmir", "Hatay", True), ("Van", None, False)]
    rows = spark.createDataFrame([(a, b) for a, b, _ in cases], "a string, b string").selectExpr(f"{posts.located_conflict(SPARK, 'a', 'b')} as c").collect()
    assert [r.c for r in rows] == [c for *_, c in cases]


def test_masks(spark):
    (r,) = spark.createDataFrame([("Ara 0532 123 45 67, 12345678 no, 7,8 ve @ben www.x.y",)], "t string").selectExpr(f"{corpus.masked(SPARK, 't')} as m").collect()
    assert r.m == "Ara <telefon>, <sayı> no, 7,8 ve <kullanıcı> <bağlantı>"


def test_greedy_parts(spark):
    sizes = [("A", f"e{k}", n) for k, n in enumerate([50, 30, 10, 5, 5])] + [("B", "x", 1)]
    got = {(r.aile, r.olay): r.bolum for r in corpus.greedy_parts(spark.createDataFrame(sizes, "aile string, olay string, n long")).collect()}
    # from the largest down to the least full: 50 -> train; 30 -> val; 10 -> test; then train is fuller than test
    assert got[("A", "e0")] == "train" and got[("A", "e1")] == "val" and got[("A", "e2")] == "test" and got[("B", "x")] == "train"


def test_hamming_finds_all_near(spark):
    base = 0x0F0F3C3C5A5A9999 - (1 << 63)
    flips = [sum(1 << b for b in range(0, 5 * n, 5)) for n in range(13)]
    rows = [(k, (base ^ f) if (base ^ f) < 1 << 63 else (base ^ f) - (1 << 64)) for k, f in enumerate(flips)] * 2
    got = similarity.hamming_near(spark.createDataFrame(rows, "vec_id long, h long"), spark.createDataFrame([(0, "none", base)], "query_id long, view string, h long"))
    assert sorted((r.vec_id, r.distance) for r in got.collect()) == sorted([(k, k) for k in range(11)] * 2)


def test_components(spark):
    got = dict(graph.components(spark.createDataFrame([(1, 2), (3, 2), (7, 8), (9, 9)], "a long, b long")).collect())
    assert got == {1: 1, 2: 1, 3: 1, 7: 7, 8: 7}


def test_readers(spark, tmp_path):
    schema = StructType.fromDDL("a string, b long")
    (tmp_path / "x.jsonl").write_text('{"a": "1", "b": 2}\n\nnot json\n{"b": 3}\n{"a": "4"}\n')
    got = sources.read_jsonl(spark, str(tmp_path / "x.jsonl"), schema, ["a"], {"b": F.lit(0).cast("long")}).collect()
    assert sorted(map(tuple, got)) == [("1", 2), ("4", 0)]
    with pytest.raises(ValueError):
        sources.read_table(spark, "x.doc", schema)
    with pytest.raises(ValueError):
        sources.not_empty(spark.createDataFrame([], schema), "x")
    with pytest.raises(ValueError):
        sources.with_vectors(spark.range(3), spark.range(2), "id")
    assert math.isclose(spark.sql(f"select {interpolated('0.5e0', [(0.0, 0.0), (1.0, 1.0)])} as v").first().v, 0.5)


def test_name_hashes(spark):
    import hashlib

    from tidemark.plans import media

    names = ["a", "kare-é", ""]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", media.name_hash("n").alias("h"), media.demo_score("video", F.col("n"), 0.0, 1.0).alias("s")).collect()
    for r in rows:
        assert r.h % (1 << 64) == int.from_bytes(hashlib.blake2b(r.n.encode(), digest_size=8).digest(), "big")
        assert r.s == int.from_bytes(hashlib.blake2b(f"video:{r.n}".encode(), digest_size=8).digest(), "big") % 1000 / 1000


@pytest.mark.parametrize("missing", ["xxhash", "tidemark.llm", "corpus_pipeline"])
def test_entry_without_optional_parts(missing):
    """The other queries stay where the subpackage, or what it imports, isn't there."""
    code = f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as e; assert len(e.queries()) > 100 and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
