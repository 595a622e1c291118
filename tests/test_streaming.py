from churnlake.queries.common import mart_df
from churnlake.session import new_table_path
from churnlake.streaming import score_mart_stream

SF = "/root/testdata/sf0.001"


def test_stream_scoring_matches_batch(spark):
    src = new_table_path(spark, "stream_src")
    mart_df(spark, SF).write.parquet(src)
    out, ck = new_table_path(spark, "stream_out"), new_table_path(spark, "stream_ck")
    q = score_mart_stream(spark, src, out, ck, scored_at="2024-06-30 12:00:00")
    q.awaitTermination(120)
    got = spark.read.parquet(out)
    assert got.count() == 150
    assert got.filter("risk_band = 'High'").count() == got.filter("churn_prediction = 1").count()
