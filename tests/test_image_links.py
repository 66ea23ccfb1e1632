from compare import compared

from lumenfold.operators import pages


def test_images_of_different_documents_are_linked(spark, tmp_path):
    spark.createDataFrame([(k, "text") for k in (0, 1, 37, 38, 74, 300, 337, 740)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert {r[1]: r[2] for r in compared(spark, tmp_path, "theta_hamming")}[337] == 300
    rows = [("d", 1, 1, 5), ("e", 2, 1, 5), ("f", 3, 1, 4), ("f", 4, 1, 1 << 40 | 0x3FF), ("g", 5, 1, None)]
    images = spark.createDataFrame(rows, "document_id string, image_id long, page_number long, phash long")
    assert {r["image_id"]: (r["class_id"], r["n_links"], r["first_linked"]) for r in pages.linked_images(images).collect()} == {1: (1, 2, 1), 2: (1, 2, 1), 3: (3, 2, 1), 4: (4, 0, 4), 5: (5, 0, 5)}
