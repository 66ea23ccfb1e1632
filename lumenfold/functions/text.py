"""Text cleaning, validation and normalisation as column expressions.

All stay in the JVM but for the two Unicode foldings Spark has no built-in for, which are
Arrow-batched pandas UDFs; of texts in ASCII alone nothing is sent to them.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from lumenfold.scratch import spread

# Words that carry no topic.
STOPWORDS = (
    "what", "are", "is", "was", "were", "a", "an", "the", "of", "in", "on",
    "for", "to", "and", "or", "with", "as", "by", "at", "from", "be", "been",
    "it", "its", "do", "does", "did", "have", "has", "had", "can", "could",
    "will", "would", "should", "this", "that", "these", "those",
)

# Compounds that keep their hyphen when a line break is undone.
COMPOUNDS = (
    "well-known", "long-term", "short-term", "self-esteem", "follow-up",
    "state-of-the-art", "up-to-date", "cost-effective", "high-level",
    "low-level", "real-time", "end-to-end", "one-time", "in-depth",
    "co-founder", "pre-existing", "re-evaluate", "non-negotiable",
    "cross-functional", "decision-making", "risk-averse", "data-driven",
    "user-friendly", "open-source", "third-party", "full-time", "part-time",
)

# Patterns.
GLYPH = r"(?i)\(cid:\d+\)|/(?:gid|glyph|g)\d{2,}"
PAGE_NUMBER = r"(?i)^\s*(page\s*)?\d{1,4}(\s*(of|/)\s*\d{1,4})?\s*$"
NOT_MEANINGFUL = r"[^A-Za-z0-9\s.,;:!?'\"()\-]"
HEADING_LINE = r"^[A-Z][\w\s\-&]{0,40}$"
SENTENCE_END = r"(?<=[.!?…])(?:[\"')\]]+)?\s+"

_EDGE = r"(?U)^\s+|\s+$"


def let(value: Column, body) -> Column:
    """``body`` of a value that is evaluated once a row."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(text: Column) -> Column:
    """Trim all Unicode white space, not only blanks."""
    return F.regexp_replace(text, _EDGE, "")


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility normalisation; null stays null."""
    return text.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Full Unicode case folding; null stays null."""
    return text.map(lambda x: None if x is None else x.casefold())


def normalized(text: Column) -> Column:
    """Compatibility normalisation of the texts that aren't ASCII, and so may need it."""
    return F.coalesce(nfkc(F.when(text.rlike("[^\\x00-\\x7F]"), text)), text)


# What Windows-1252 has in place of the control characters of Latin-1.
WINDOWS = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
CONTROLS = "\x80\x82\x83\x84\x85\x86\x87\x88\x89\x8a\x8b\x8c\x8e\x91\x92\x93\x94\x95\x96\x97\x98\x99\x9a\x9b\x9c\x9e\x9f"


#: A lead byte's character and that of a byte that goes on, as Latin-1 shows them.
_MISREAD = "[Â-ô][\u0080-¿]"
#: How often a text may have been misread on top of itself.
MISREADINGS = 3


def _badness(text: Column) -> Column:
    """How many pairs look like bytes of UTF-8, and how many characters no text has."""
    return F.regexp_count(text, F.lit(_MISREAD)) * 2 + F.regexp_count(text, F.lit("[\u0080-\u009f\ufffd]"))


def _read_again(piece: Column) -> Column:
    """A piece's bytes, by Latin-1 or Windows-1252 or both, read as UTF-8; as it is, if they
    aren't that, or what comes out is no better."""

    def of(wide: Column) -> Column:
        suspect = wide.rlike(_MISREAD) & ~wide.rlike("[^\u0000-ÿ]")
        again = F.try_validate_utf8(F.encode(F.when(suspect, wide), "ISO-8859-1").cast("string"))
        return F.when(suspect & ~F.contains(again, F.lit("\ufffd")), again)

    found = let(F.struct(piece.alias("old"), of(F.translate(piece, WINDOWS, CONTROLS)).alias("new")), lambda x: F.when(_badness(x["new"]) < _badness(F.translate(x["old"], WINDOWS, CONTROLS)), x["new"]))
    return F.coalesce(found, piece)


def _line_again(line: Column) -> Column:
    """A line as a whole, or else, if only some of it was misread, word by word."""
    whole = lambda old, new: F.when(new != old, new).otherwise(F.array_join(F.transform(F.split(old, " ", -1), _read_again), " "))
    return let(F.struct(line.alias("old"), _read_again(line).alias("new")), lambda x: whole(x["old"], x["new"]))


def fix_mojibake(text: Column) -> Column:
    """Text whose UTF-8 was misread as Latin-1 or Windows-1252, up to ``MISREADINGS`` times on
    top of itself. Each line is judged alone, then each word of a line that isn't misread as a
    whole; a piece changes only if its bytes are UTF-8 and it then looks less misread. Texts
    without a sign of it are passed by."""
    signs = text.rlike(f"{_MISREAD[:-1]}{WINDOWS}]")
    lines = F.split(text, "\n", -1)
    for _ in range(MISREADINGS):
        lines = F.transform(lines, _line_again)
    return F.when(signs, F.array_join(lines, "\n")).otherwise(text)


def strip_glyph_tokens(text: Column) -> Column:
    return F.regexp_replace(text, GLYPH, "")


def glyph_token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(GLYPH))


def dehyphenate(text: Column) -> Column:
    """Undo a hyphen at a line's end: compounds and capitalised second parts keep it."""
    pairs = sorted({tuple(c.rsplit("-", 1)) for c in COMPOUNDS if c.count("-") == 1})
    known = "|".join(f"{a}-\\n{b}" for a, b in pairs)
    kept = F.regexp_replace(text, rf"(?i)(?<![A-Za-z])((?:{known}))(?![A-Za-z])", "$1\u0001")
    kept = F.regexp_replace(kept, "([A-Za-z]+)-\n([A-Za-z]+)\u0001", "$1-$2")
    capital = F.regexp_replace(kept, "([A-Za-z]+)-\n([A-Z][A-Za-z]*)", "$1-$2")
    # no pattern fits a text without such a break, and most have none
    return F.when(F.contains(text, F.lit("-\n")), F.regexp_replace(capital, "([A-Za-z]+)-\n([a-z][A-Za-z]*)", "$1$2")).otherwise(text)


def dehyphenate_count(text: Column) -> Column:
    """Joined breaks, without those before a capital."""
    return F.regexp_count(text, F.lit("[A-Za-z]+-\n[a-z]"))


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def drop_duplicate_lines(text: Column) -> Column:
    """Drop a line that equals, stripped, the last line before it that isn't blank."""
    placed = F.transform(lines(text), lambda x, i: F.struct(i.alias("i"), strip(x).alias("s"), x.alias("line")))

    def kept(every: Column) -> Column:
        def fresh(full: Column) -> Column:
            first = F.filter(full, lambda x, k: (k == 0) | (F.get(full, k - 1)["s"] != x["s"]))
            return F.sort_array(F.concat(first, F.filter(every, lambda x: x["s"] == "")))

        return let(F.filter(every, lambda x: x["s"] != ""), fresh)

    return F.array_join(F.transform(let(placed, kept), lambda x: x["line"]), "\n")


def drop_page_numbers(text: Column) -> Column:
    return F.array_join(F.filter(lines(text), lambda x: ~x.rlike(PAGE_NUMBER)), "\n")


def collapse_whitespace(text: Column) -> Column:
    """One blank for blanks and tabs, bare line ends, at most one blank line, stripped."""
    flat = F.regexp_replace(text, r"[ \t]{2,}|\t", " ")
    bare = F.regexp_replace(flat, r"(?m)[ \t\r\f\x0b]+$", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


def _cleaned(text: Column, steps: list, fixes: list[Column]) -> Column:
    """struct(text, applied_fixes) after the steps; every step's result is bound once."""
    if not steps:
        return F.struct(text.alias("text"), F.array_compact(F.array(*fixes)).alias("applied_fixes"))
    (name, step), rest = steps[0], steps[1:]
    mark = F.lit(name)
    if name == "collapsed_whitespace":
        return let(step(text), lambda new: _cleaned(new, rest, [*fixes, mark]))
    return let(step(text), lambda new: _cleaned(new, rest, [*fixes, F.when(~new.eqNullSafe(text), mark)]))


def clean_text(rows: DataFrame, text: Column, out: str = "cleaned", normalize: bool = True) -> DataFrame:
    """Adds struct(text, applied_fixes): the seven steps in their fixed order. ``normalize`` is
    the NFKC step between glyphs and hyphens, for the texts that aren't ASCII alone."""
    first = [("fixed_mojibake", fix_mojibake), ("stripped_glyph_tokens", strip_glyph_tokens)]
    last = [
        ("dehyphenated", dehyphenate),
        ("removed_duplicate_lines", drop_duplicate_lines),
        ("removed_page_numbers", drop_page_numbers),
        ("collapsed_whitespace", collapse_whitespace),
    ]
    if not normalize:
        return rows.withColumn(out, _cleaned(text, first + last, []))
    own = spread(rows).withColumn("_before", _cleaned(text, first, []))
    before = F.col("_before.text")
    # a function of Python's is a column of its own, as it can't stand inside the steps
    own = own.withColumn("_folded", normalized(before))
    mark = F.when(~F.col("_folded").eqNullSafe(before), F.lit("normalized_unicode"))
    own = own.withColumn("_after", _cleaned(F.col("_folded"), last, []))
    fixes = F.array_compact(F.concat("_before.applied_fixes", F.array(mark), "_after.applied_fixes"))
    return own.withColumn(out, F.struct(F.col("_after.text").alias("text"), fixes.alias("applied_fixes"))).drop("_before", "_folded", "_after")


def meaningful_ratio(text: Column) -> Column:
    """Share of letters, digits, white space and common punctuation; 0 for empty text."""
    kept = F.length(F.regexp_replace(text, NOT_MEANINGFUL, ""))
    return F.when(F.length(text) > 0, kept / F.length(text)).otherwise(F.lit(0.0))


def text_acceptable(text: Column, least: float = 0.4) -> Column:
    """Not blank, no broken glyph token, and enough meaningful characters."""
    return F.coalesce((strip(text) != "") & ~text.rlike(GLYPH) & (meaningful_ratio(text) >= least), F.lit(False))


def table_garbage(rows: Column, least: float = 0.4) -> Column:
    """True if a table's joined cells aren't acceptable text."""
    return ~text_acceptable(F.array_join(F.flatten(rows), " "), least)


def cid_suspect(text: Column, share: float = 0.05) -> Column:
    """Glyph names, or over ``share`` replacement and private-use characters."""
    odd = F.regexp_count(text, F.lit("[�-]"))
    return F.contains(text, F.lit("(cid:")) | text.rlike(r"(?i)/(?:gid|glyph|g)\d{2,}") | (odd > share * F.length(text))


def lexical_text(text: Column) -> Column:
    """Compatibility forms folded, lower case, all but ASCII letters and digits as blanks."""
    return F.regexp_replace(F.lower(normalized(F.coalesce(text, F.lit("")))), "[^a-z0-9]+", " ")


def lexical_tokens(text: Column) -> Column:
    """Distinct ASCII tokens without stop words; accented letters separate."""
    words = F.filter(F.split(lexical_text(text), " "), lambda x: x != "")
    return F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in STOPWORDS]))


def lexical_overlap(query: Column, tokens: Column) -> Column:
    """Share of the query's tokens that the text has; 0 for a query without any."""
    return F.when(F.size(query) > 0, F.size(F.array_intersect(query, tokens)) / F.size(query)).otherwise(F.lit(0.0))


def effective_body_length(text: Column) -> Column:
    """Length without lines that look like headings."""
    def heading(x: Column) -> Column:
        s = strip(x)
        words = F.size(F.filter(F.split(s, r"\s+"), lambda w: w != ""))
        return s.rlike(HEADING_LINE) & (words <= 6) & ~s.rlike(r"[.!?:;,]$")

    return F.length(strip(F.array_join(F.filter(lines(text), lambda x: ~heading(x)), " ")))


def markdown_lines(rows: Column) -> Column:
    """Header, rule and body of a pipe table, a line each; none of no rows."""
    line = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = line(F.transform(F.element_at(rows, 1), lambda _: F.lit("---")))
    body = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), line)
    return F.when(F.size(rows) > 0, F.concat(F.array(line(F.element_at(rows, 1)), rule), body)).otherwise(F.array().cast("array<string>"))


def rows_to_markdown(rows: Column) -> Column:
    """Header, rule and body of a pipe table."""
    return F.array_join(markdown_lines(rows), "\n")


def semantic_units(text: Column, most: int = 450) -> Column:
    """Paragraphs with collapsed white space; longer ones as whole sentences."""
    squeeze = lambda x: strip(F.regexp_replace(x, r"(?U)\s+", " "))
    paragraphs = F.filter(F.transform(F.split(strip(text), r"\n\s*\n+", -1), squeeze), lambda x: x != "")

    def pieces(x: Column) -> Column:
        sentences = F.filter(F.transform(F.split(x, SENTENCE_END, -1), strip), lambda s: s != "")
        return F.when(F.length(x) <= most, F.array(x)).when(F.size(sentences) > 0, sentences).otherwise(F.array(x))

    return F.flatten(F.transform(paragraphs, pieces))


def value_norm(text: Column) -> Column:
    """Lower case and single blanks: equality of remembered values."""
    return strip(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))


def memory_key_norm(key: Column) -> Column:
    """Lower case with underscores; null unless a letter and up to 63 more characters."""
    new = F.translate(F.lower(strip(key)), " -", "__")
    return F.when(new.rlike("^[a-z][a-z0-9_]{0,63}$"), new)


def json_object(text: Column) -> Column:
    """From the first brace to the last, code fences aside; null if that isn't JSON."""
    found = F.regexp_extract(F.regexp_replace(text, r"```(?:json)?", ""), r"(?s)(\{.*\})", 1)
    return F.when((found != "") & F.try_parse_json(found).isNotNull(), found)


def bounded_score(value: Column) -> Column:
    """A number in 0..1, or null where it can't be read."""
    number = value.try_cast("double")
    return F.when(number.isNull() | F.isnan(number), None).otherwise(F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def finite(value: Column) -> Column:
    """Null for not-a-number and infinities."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


# What must not be stored or logged.
SENSITIVE = r"(?i)(?:password|passphrase|api[ _-]?key|secret|access[ _-]?token|auth(?:entication)?[ _-]?token|bearer)\b"
CREDENTIAL = r"(?:sk-|AIza|ghp_|xox[baprs]-)[A-Za-z0-9_=-]{8,}"
SECRET_KEY = r"(?i)(?:^|_)(?:api[_-]?key|authorization|cookie|database[_-]?url|password|secret|session|token)(?:$|_)"


def storable(key: Column, value: Column) -> Column:
    return ~(F.concat_ws(" ", key, value).rlike(SENSITIVE) | value.rlike(CREDENTIAL))


def redact(entries: Column, mask: str = "[redacted]") -> Column:
    """A map with the values of secret keys masked."""
    return F.transform_values(entries, lambda k, v: F.when(k.rlike(SECRET_KEY), F.lit(mask)).otherwise(v))


def scope_valid(identifier: Column) -> Column:
    return F.coalesce(identifier.rlike(r"^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"), F.lit(False))


def normalized_hash(text: Column) -> Column:
    """Stripped, lower-cased, white space collapsed: equality of chunks."""
    return F.sha2(F.regexp_replace(F.lower(strip(text)), r"(?U)\s+", " "), 256)


def content_hash(text: Column, least: int = 32) -> Column:
    """Words joined by blanks, case kept: equality of documents; null if too short."""
    words = strip(F.regexp_replace(text, r"(?U)\s{2,}|[^\S ]", " "))
    return let(words, lambda x: F.when(F.length(x) >= least, F.sha2(x, 256)))


def public_label(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def blank_to_null(text: Column) -> Column:
    return F.nullif(strip(text), F.lit(""))


def section_title(stack: Column) -> Column:
    return F.nullif(F.array_join(stack, " > "), F.lit(""))


def retry_delay(error: Column) -> Column:
    """Seconds that an error asks to wait, or null."""
    return F.nullif(F.regexp_extract(error, r"(?i)retry in ([0-9]+(?:\.[0-9]+)?)\s*s", 1), F.lit("")).try_cast("double")


# What an error of an exhausted quota says.
RATE_LIMITED = r"(?i)(?:429|resource[_ ]exhausted|rate limit|quota(?: exceeded| exhausted)?|daily limit)"


def rate_limited(error: Column) -> Column:
    return F.coalesce(error.rlike(RATE_LIMITED), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def format_exchange(number: Column, question: Column, answer: Column, most: int = 800) -> Column:
    return F.concat(number.cast("string"), F.lit(". Q: "), question, F.lit("\nA: "), F.substring(answer, 1, most))
