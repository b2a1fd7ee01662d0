"""Tables that are replaced as a whole: what a failed, a repeated and a half done commit leave."""

import pytest
from pyspark.sql import functions as F

from tidemark.plans import corpus
from tidemark.scratch import shared_dir
from tidemark.sources import commits
from tidemark.sources.commits import Contract, ContractError

COLUMNS = (("id", "bigint"), ("part", "string"), ("x", "double"))


def table(spark, n, x=1.0):
    return spark.range(n).select("id", F.when(F.col("id") % 2 == 0, "even").otherwise("odd").alias("part"), F.lit(x).alias("x"))


def test_commits(spark):
    path, contract = shared_dir(spark), Contract(COLUMNS, least_rows=5, required=("id",), unique=("id",), conditions={"negative": "x >= 0"})
    assert commits.manifest(spark, path) is None
    with pytest.raises(FileNotFoundError):
        commits.read(spark, path)
    first = commits.commit(table(spark, 10), path, "a", contract, ["part"])
    assert first["rows"] == 10 and commits.read(spark, path).columns == ["id", "part", "x"]
    for wrong, what in (
        (table(spark, 3), "fewer than 5"), (table(spark, 10, -1.0), "negative: 10 rows"), (table(spark, 10).withColumn("x", F.lit(None).cast("double")), "negative: 10"), (table(spark, 10).union(table(spark, 1)), "1 repeated"),
        (table(spark, 10).withColumn("id", F.when(F.col("id") > 0, F.col("id"))), "null in id"), (table(spark, 10).drop("x"), "columns"), (table(spark, 10).withColumn("x", F.lit("1")), "columns"),
    ):
        with pytest.raises(ContractError, match=what):
            commits.commit(wrong, path, "b", contract)
        assert commits.manifest(spark, path) == first and commits.read(spark, path).count() == 10  # the old table stays
    before = commits.read(spark, path)
    table(spark, 2).write.parquet(f"{path}/b")  # a lost run left half a version
    second = commits.commit(table(spark, 20), path, "b", contract)
    assert second["before"] == "a" and commits.read(spark, path).count() == 20 and before.count() == 10  # who reads the old version still can
    assert commits.commit(table(spark, 99), path, "b", contract) == second and commits.read(spark, path).count() == 20  # a retry changes nothing


def test_partitions_with_nulls_and_clashing_names(spark):
    path = shared_dir(spark)
    df = spark.createDataFrame([(1, None, "a.b"), (2, "p", None)], "id int, part string, `x.y` string")
    commits.commit(df, path, "v", Contract(tuple(df.dtypes)), ["part"])
    assert sorted(map(tuple, commits.read(spark, path).collect())) == [(1, None, "a.b"), (2, "p", None)]


def test_first_of_equal_texts(spark):
    rows = [(9, "bir metin ki uzun", "D1_iddia"), (5, "bir metin ki uzun", "D2"), (3, "bir metin ki uzun", "D2"), (7, "yalnız bültende var", "D1_tekzip"), (1, "kısa", "D10"), (8, "üç kaynakta birden", "D10"), (2, "üç kaynakta birden", "D2")]
    got = corpus.deduplicated(spark.createDataFrame(rows, "row_id long, metin string, kaynak string")).collect()
    assert sorted((r.kaynak, r.row_id, r.copies) for r in got) == [("D10", 8, 2), ("D1_tekzip", 7, 1), ("D2", 3, 3)]
