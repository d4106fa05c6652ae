"""op5 returns the rows in ranges of position, the last step of its method."""

from pyspark.sql import functions as F

from votelake.llm import mixing


def test_query_is_ranged_by_position(spark, tmp_path):
    rows = [(i, " ".join(["w"] * (i % 23)), "en", ["a", "b", None, "hot", "hot"][i % 5], 1) for i in range(600)] + [(None, None, None, None, None)] * 3
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    out = mixing.query(spark, str(tmp_path))
    got = out.withColumn("part", F.spark_partition_id()).collect()
    due, never = [r for r in got if r["position"] is not None], [r for r in got if r["position"] is None]
    assert [r["position"] for r in due] == sorted(r["position"] for r in due)
    assert len({r["part"] for r in due}) > 1 and len({r["part"] for r in never}) > 1
    assert max(r["part"] for r in due) < min(r["part"] for r in never)
    key = lambda x: sorted(str((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"], r["position"])) for r in x)
    assert len(got) == len(rows) and key(got) == key(mixing.plan(spark.read.parquet(f"{tmp_path}/documents.parquet")).collect())
