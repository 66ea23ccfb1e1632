import duckdb
from pyspark.sql import functions as F

from lumenfold.operators import retrieval


def test_a_score_under_a_half_by_less_than_its_decimals_show(spark):
    score = 0.0640625
    assert score * 1e6 < 64062.5
    found = spark.createDataFrame([(score,), (None,), (0.5,)], "s double").select(retrieval.rounded(F.col("s"), 6)).collect()
    want = duckdb.execute("SELECT round(0.0640625::DOUBLE, 6)").fetchall()[0][0]
    assert [r[0] for r in found] == [want, None, 0.5]
