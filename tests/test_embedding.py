from compare import compared


def test_blank_and_cancelling_texts(spark, tmp_path):
    """Spaces aren't embedded; tabs are text, and get a unit vector like words that cancel out."""
    texts = ["", None, "  ", "  　", "\t\n", "w3 w18", "some words"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[0] for r in compared(spark, tmp_path, "udf_embed")} == {4, 5, 6}
