"""Unicode forms against the standard library, for all code points of 16 bits."""

import random
import re
import time
import unicodedata

from pyspark.sql import functions as F

from tidemark.functions import unicode

POINTS = [chr(c) for c in range(1, 0x10000) if c not in unicode.SURROGATES and unicodedata.category(chr(c)) != "Cn"]


def rows_of(spark, texts):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string")


def test_all_code_points(spark):
    texts = ["|".join(POINTS[i : i + 200]) for i in range(0, len(POINTS), 200)]
    got = rows_of(spark, texts).select("k", unicode.nfkd(F.col("t")).alias("d"), unicode.casefold(F.col("t")).alias("c"), unicode.without_marks(F.col("t")).alias("m")).collect()
    for r in got:
        assert r.d == unicodedata.normalize("NFKD", texts[r.k])
        assert r.c == texts[r.k].casefold()
        assert r.m == "".join(c for c in texts[r.k] if not unicodedata.combining(c))


def test_order_of_marks(spark):
    """Runs of marks of all orders, also at the beginning and after characters that bring marks of their own; others stay."""
    r = random.Random(2)
    marks = [c for c in POINTS if unicodedata.combining(c)]
    texts = ["".join(r.choice(marks) if r.random() < 0.6 else r.choice("aé한ﬁ½ạ̣😀 ") for _ in range(r.randrange(30))) for _ in range(300)] + ["", None, "plain", "a" * 5000 + "é" * 5000]
    got = {x.k: x.d for x in rows_of(spark, texts).select("k", unicode.nfkd(F.col("t")).alias("d")).collect()}
    assert all(got[k] == (None if t is None else unicodedata.normalize("NFKD", t)) for k, t in enumerate(texts))


def plain(text):
    t = re.sub(r"https?://\S+|www\.\S+", " <url> ", text.casefold())
    t = re.sub(r"@\w+", " <kullanici> ", t)
    t = "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)).replace("ı", "i")
    return re.sub(r"\s+", " ", t).strip()


def test_comparable_texts(spark):
    texts = ["İZMİR Çok GÜZEL Straße ﬁnal ½ ㎏ Ⅷ ｆｕｌｌ", "Bak: https://a.b/c?d ve @ali_1  \t　son ", "한국어 Ελλάς ΣΑΣ", "Iğdır ıslak", "  "]
    got = {r.k: r.n for r in rows_of(spark, texts).select("k", unicode.comparable(F.col("t")).alias("n")).collect()}
    assert [got[k] for k in range(len(texts))] == [plain(t) for t in texts]


def test_beyond_16_bits_and_odd_spaces(spark):
    """Letters beyond 16 bits are folded and taken apart, too; links end and names go on as in the library; letters from signs are dotted."""
    texts = ["𝐃𝐞𝐩𝐫𝐞𝐦 𝟙𝟚 𐐀𐐁 a𝅥", "https://a.b/c son www.x.y　z", "ℐ ℹ 🄸", "e" + "\U0001e8d0́" * 2]
    got = {r.k: r for r in rows_of(spark, texts).select("k", unicode.comparable(F.col("t")).alias("n"), unicode.nfkd(F.col("t")).alias("d"), unicode.casefold(F.col("t")).alias("c")).collect()}
    for k, t in enumerate(texts):
        assert got[k].n == plain(t).replace("I", "i") and got[k].d == unicodedata.normalize("NFKD", t) and got[k].c == t.casefold()


def test_long_texts_are_not_taken_apart(spark):
    """Eight million letters; as expressions over single letters they took minutes."""
    rows = spark.range(0, 4000, 1, 4).select(F.concat(F.lit("Çığ düştü, yardım! " * 105), F.col("id").cast("string")).alias("t"))
    began = time.time()
    got = rows.select(F.length(unicode.comparable(F.col("t"))).alias("n")).agg(F.sum("n")).first()[0]
    took = time.time() - began
    assert got == sum(len(plain("Çığ düştü, yardım! " * 105 + str(k))) for k in range(4000)) and took < 40
