from compare import compared


def test_odd_texts_of_attachments(spark, tmp_path):
    """Blank texts have one window and no words, null ones neither; white space is RE2's, without the vertical tab."""
    texts = ["", None, "  ", "\t\n\f\r", "\x0b", "a\x0bb", " a\x0b b\fc ", "a b\u0085c d", "é " * 2500, "w " * 121, " ".join(["w"] * 91), "x" * 3999 + " y z"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r[0]: r[1:] for r in compared(spark, tmp_path, "src_attach_extract")}
    assert rows[0] == (1, 0) and rows[1] == (0, 0) and rows[5] == (1, 1)
