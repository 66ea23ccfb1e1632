import pytest
from compare import compared

from lumenfold.plans import catalog


@pytest.mark.parametrize("name", ["fn_nfkc", "fold_pack_sentences", "win_child_index"])
def test_texts_reach_python_in_batches_of_few_bytes(spark, tmp_path, name):
    """What runs in Python runs while a table is written, which bounds its batches' bytes."""
    texts = ["One sentence. " * 60, "Zwei Sätze.\n\nUnd noch einer! " * 40, "short"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    plan = catalog.QUERIES[name](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan and "Scan parquet" in plan
    compared(spark, tmp_path, name)
