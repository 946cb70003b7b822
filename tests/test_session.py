import shutil

from pyspark.sql import Window
from pyspark.sql import functions as F

from barfold.session import keep_table, kept_table


def test_kept_tables_follow_their_source(spark, tmp_path):
    source, built = tmp_path / "in", []

    def kept():
        def build():
            built.append(1)
            return spark.read.parquet(str(source / "t")).selectExpr("max(id) AS top")
        return keep_table(f"{source}/top", spark, build, str(source)).first().top

    spark.range(5).write.parquet(str(source / "t"))
    assert [kept(), kept()] == [4, 4] and len(built) == 1
    spark.range(9).write.mode("overwrite").parquet(str(source / "t"))
    assert [kept(), kept()] == [8, 8] and len(built) == 2
    spark.range(3).write.mode("append").parquet(str(source / "t"))
    assert kept() == 8 and len(built) == 3


def test_a_table_kept_by_a_key_is_read_dealt_by_it(spark, tmp_path):
    source, built = tmp_path / "in", []
    spark.range(40).write.parquet(str(source / "t"))

    def kept():
        def build():
            built.append(1)
            return spark.read.parquet(str(source / "t")).selectExpr("concat('k', id % 7) AS k", "id").repartition(3, "k")
        return keep_table(f"{source}/by-key", spark, build, str(source), by="k", buckets=3)

    assert kept_table(f"{source}/by-key", spark, str(source)) is None
    last = Window.partitionBy("k").orderBy("id")
    first, again = (kept().withColumn("n", F.row_number().over(last)) for _ in range(2))
    assert len(built) == 1 and "Exchange" not in again._jdf.queryExecution().executedPlan().toString()
    want = {(f"k{i % 7}", i, i // 7 + 1) for i in range(40)}
    assert {tuple(r) for r in first.collect()} == want == {tuple(r) for r in again.collect()}
    assert kept_table(f"{source}/by-key", spark, str(source)).count() == 40
    spark.range(9).write.mode("overwrite").parquet(str(source / "t"))
    assert kept_table(f"{source}/by-key", spark, str(source)) is None
    assert kept().count() == 9 and len(built) == 2
    shutil.rmtree(kept().inputFiles()[0].removeprefix("file:").rsplit("/", 1)[0])
    assert kept().count() == 9 and len(built) == 3
