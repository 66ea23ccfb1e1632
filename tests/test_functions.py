"""Column expressions against values worked out by hand."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import text as T
from lumenfold.functions import web as W


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values())], ", ".join(f"{k} {'string' if not isinstance(v, (int, float)) or isinstance(v, bool) else 'double' if isinstance(v, float) else 'long'}" for k, v in inputs.items()))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("function", "text", "expected"),
    [
        (T.strip_glyph_tokens, "a(cid:12)b /gid0012 c", "ab  c"),
        (T.dehyphenate, "infor-\nmation", "information"),
        (T.dehyphenate, "well-\nknown", "well-known"),
        (T.dehyphenate, "Long-\nTerm plan", "Long-Term plan"),
        (T.dehyphenate, "Meta-\nVerse", "Meta-Verse"),
        (T.dehyphenate_count, "infor-\nmation Meta-\nVerse well-\nknown", 2),
        (T.drop_duplicate_lines, "A\n\nA\nB", "A\n\nB"),
        (T.drop_duplicate_lines, "", ""),
        (T.drop_page_numbers, "Page 3 of 10\n12/40\n2025\n2025 plan", "2025 plan"),
        (T.collapse_whitespace, "  a \t b  \n\n\n\nc ", "a b\n\nc"),
        (T.effective_body_length, "Long-term implications\nTechnology", 0),
        (T.fix_mojibake, "cafÃ© ok", "café ok"),
        (T.fix_mojibake, "café Ã", "café Ã"),
        (T.nfkc, "ﬁne", "fine"),
        (T.memory_key_norm, " Key Name-1 ", "key_name_1"),
        (T.memory_key_norm, "1st", None),
        (T.json_object, 'so:\n```json\n{"a": 1}\n```', '{"a": 1}'),
        (T.json_object, "{bad", None),
        (T.bounded_score, "0.75", 0.75),
        (T.bounded_score, "2", 1.0),
        (T.bounded_score, "-1", 0.0),
        (T.bounded_score, "x", None),
        (T.retry_delay, "quota: retry in 12.5s", 12.5),
        (T.rate_limited, "HTTP 429", True),
        (T.scope_valid, "a/b", False),
        (T.content_hash, "too short", None),
        (T.text_acceptable, "plain words", True),
        (T.text_acceptable, "a /gid0001 b", False),
        (T.text_acceptable, "  ", False),
        (T.meaningful_ratio, "", 0.0),
        (W.safety_key, "https://www.Example.com./a", "domain:example.com"),
        (W.safety_key, "https://u:p@example.com/", None),
        (W.safety_key, "ftp://example.com/", None),
        (W.url_id, "http://a.b/?c", "aHR0cDovL2EuYi8_Yw"),
    ],
)
def test_text(spark, function, text, expected):
    assert value(spark, function(F.col("x")), x=text) == expected


def test_units(spark):
    text = 'He said "go." Then left.'
    assert value(spark, T.semantic_units(F.col("x"), 10), x=text) == ['He said "go.', "Then left."]
    assert value(spark, T.semantic_units(F.col("x"), 100), x="a  b\n\n \n\nc") == ["a b", "c"]
    assert value(spark, T.semantic_units(F.col("x")), x="  ") == []


def test_tokens(spark):
    assert sorted(value(spark, T.lexical_tokens(F.col("x")), x="What is the Café-bar, bar?")) == ["bar", "caf"]
    assert value(spark, T.lexical_tokens(F.col("x")), x="") == []
    assert value(spark, T.lexical_overlap(T.lexical_tokens(F.col("x")), T.lexical_tokens(F.col("y"))), x="long term short term", y="long-term") == pytest.approx(2 / 3)


def test_compatibility_forms(spark):
    """Ligatures, full-width and raised characters, and letters with marks of their own."""
    assert set(value(spark, T.lexical_tokens(F.col("x")), x="ﬁne ＡＢＣ１２ x² cafe\u0301 ㎞")) == {"fine", "abc12", "x2", "caf", "km"}
    assert value(spark, T.normalized(F.col("x")), x="ﬁ ½ ①") == "fi 1⁄2 1" and value(spark, T.normalized(F.col("x")), x="plain") == "plain"
    frame = spark.createDataFrame([("ﬁne ＡＢＣ\n12\ninfor-\nmation", 1), ("plain", 2), (None, 3), ("", 4)], "x string, k int")
    got = {r["k"]: r["cleaned"] for r in T.clean_text(frame, F.col("x")).collect()}
    assert got[1]["text"] == "fine ABC\ninformation" and list(got[1]["applied_fixes"]) == ["normalized_unicode", "dehyphenated", "removed_page_numbers", "collapsed_whitespace"]
    assert got[2]["text"] == "plain" and list(got[2]["applied_fixes"]) == ["collapsed_whitespace"] and got[3]["text"] is None and got[4]["text"] == ""
    assert T.clean_text(frame.where("k = 1"), F.col("x"), normalize=False).first()["cleaned"]["text"] == "ﬁne ＡＢＣ\ninformation"


MISREAD_TWICE = "größe – “so”".encode().decode("latin-1").encode().decode("latin-1")
MISREAD_THRICE = "naïve".encode().decode("cp1252").encode().decode("cp1252").encode().decode("cp1252")


@pytest.mark.parametrize(("broken", "fixed"), [("grÃ¶Ã\x9fe", "größe"), ("grÃ¶ÃŸe", "größe"), ("itâ€™s", "it’s"), ("größe – it’s", "größe – it’s"), ("Ã", "Ã"), ("plain", "plain"), (MISREAD_TWICE, "größe – “so”"), (MISREAD_THRICE, "naïve"), ("größe\ngrÃ¶ÃŸe Ã\nitâ€™s “it”", "größe\ngröße Ã\nit’s “it”"), ("größe grÃ¶ÃŸe", "größe größe"), ("ÂÃ TÃO ÇÃO", "ÂÃ TÃO ÇÃO"), (None, None)])
def test_mojibake(spark, broken, fixed):
    assert value(spark, T.fix_mojibake(F.col("x")), x=broken) == fixed


@pytest.mark.parametrize(("error", "limited"), [("HTTP 429", True), ("RESOURCE EXHAUSTED", True), ("quota exceeded", True), ("Daily Limit", True), ("too many requests", False), ("rate-limit", False), ("reset", False)])
def test_rate_limits(spark, error, limited):
    assert value(spark, T.rate_limited(F.col("x")), x=error) is limited


def test_clean(spark):
    got = T.clean_text(spark.createDataFrame([("a (cid:3)b\nA\nA\nPage 3\n",)], "x string"), F.col("x")).first()["cleaned"]
    assert got["text"] == "a b\nA" and list(got["applied_fixes"]) == ["stripped_glyph_tokens", "removed_duplicate_lines", "removed_page_numbers", "collapsed_whitespace"]


@pytest.mark.parametrize(("bad", "odd", "code", "status"), [(1, 0, 200, "blocked"), (0, 2, 200, "blocked"), (0, 1, 200, "safe"), (None, 0, 200, "error"), (0, 0, 404, "unknown"), (0, 0, 429, "rate_limited")])
def test_status(spark, bad, odd, code, status):
    row = spark.createDataFrame([(bad, odd, code)], "a int, b int, c int")
    assert row.select(W.url_status(F.col("a"), F.col("b"), F.col("c"))).first()[0] == status


def test_recency(spark):
    rows = spark.createDataFrame([("2024-01-02T10:00",), ("2024-01-01",), ("soon",), (None,)], "d string")
    today = F.lit("2024-01-31").cast("date")
    assert [r[0] for r in rows.select(W.recency(F.col("d"), F.date_sub(today, 29), today)).collect()] == ["recent", "not_recent", "unknown", "unknown"]
