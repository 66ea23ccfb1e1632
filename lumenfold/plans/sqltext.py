"""Pieces of DuckDB SQL that several equivalents share."""

from __future__ import annotations

from lumenfold.functions.text import STOPWORDS

STOP = "[" + ", ".join(f"'{w}'" for w in STOPWORDS) + "]"


def tokens(text: str) -> str:
    """Distinct lexical tokens of a text expression."""
    return f"list_filter(list_distinct(string_split(regexp_replace(lower(nfc_normalize(coalesce({text}, ''))), '[^a-z0-9]+', ' ', 'g'), ' ')), lambda x: x <> '' AND NOT list_contains({STOP}, x))"


QUERIES = f"queries AS (SELECT b.item_id AS query_id, b.text AS query_text, {tokens('b.text')} AS q, CAST(e.embedding AS DOUBLE[]) AS query_vector FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id)"

BM25 = f"""{QUERIES}, tok AS (SELECT doc_id AS chunk_id, {tokens('text')} AS t FROM documents),
stats AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok), wanted AS (SELECT query_id, unnest(q) AS token FROM queries),
post AS (SELECT chunk_id, len(t) AS dl, unnest(t) AS token FROM tok), df AS (SELECT token, count(*) AS df FROM post GROUP BY token),
bm25 AS (SELECT query_id, chunk_id, sum(ln(1.0 + (n - df + 0.5) / (df + 0.5)) * 2.5 / (1.0 + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS bm25_score FROM post JOIN df USING (token) JOIN wanted USING (token), stats GROUP BY query_id, chunk_id)"""

DENSE = """dense AS (SELECT query_id, vec_id AS chunk_id, list_dot_product(CAST(embedding AS DOUBLE[]), query_vector) AS dense_score FROM embeddings, queries WHERE vec_id IN (SELECT doc_id FROM documents))"""

POOLS = f"""{BM25}, {DENSE}, dpool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dense_score DESC, chunk_id) AS dense_rank FROM dense QUALIFY dense_rank <= 40),
spool AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, chunk_id) AS sparse_rank FROM bm25 QUALIFY sparse_rank <= 40)"""

OVERLAP = "(CASE WHEN len(q) > 0 THEN len(list_intersect(q, t)) / len(q) ELSE 0.0 END)"

QRELS = f"qrels AS (SELECT query_id, chunk_id FROM queries, tok WHERE len(q) > 0 AND len(list_intersect(q, t)) / len(q) >= 0.5)"

RUN = "run AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(bm25_score, 9) DESC, chunk_id) AS rank FROM bm25 QUALIFY rank <= 8)"

_SPLIT = r"""list_filter(list_transform(string_split(regexp_replace(p, '([.!?…])["'')\]]*\s+', '\1' || chr(1), 'g'), chr(1)), lambda s: trim(s)), lambda s: s <> '')"""

#: Paragraphs, longer ones as sentences, of each document.
UNITS = rf"""units AS (SELECT doc_id, flatten(list_transform(list_filter(list_transform(string_split_regex(trim(text, ' ' || chr(9) || chr(10) || chr(13)), '\n\s*\n+'), lambda p: trim(regexp_replace(p, '\s+', ' ', 'g'))), lambda p: p <> ''), lambda p: CASE WHEN length(p) <= 450 THEN [p] WHEN len({_SPLIT}) > 0 THEN {_SPLIT} ELSE [p] END)) AS u FROM documents)"""

_JOIN = "array_to_string({}, chr(10) || chr(10))"


def _suffix(units: str, most: str) -> str:
    """The longest tail of a list that is short enough when joined."""
    return f"{units}[list_min(list_filter(range(1, len({units}) + 2), lambda k: k > len({units}) OR length({_JOIN.format(units + '[k:]')}) <= {most})):]"


#: Children of each document, packed unit by unit.
CHILDREN = f"""{UNITS}, o AS (SELECT doc_id, u[i] AS unit, i AS rn, len(u) AS n FROM units, range(1, len(u) + 1) r(i)),
f AS (SELECT doc_id, rn, n, [unit] AS now, CAST(NULL AS VARCHAR) AS closed FROM o WHERE rn = 1
UNION ALL SELECT doc_id, rn, n, CASE WHEN fits THEN list_append(now, unit) ELSE list_append({_suffix("t", "448 - length(unit)")}, unit) END, CASE WHEN NOT fits THEN {_JOIN.format("now")} END
FROM (SELECT *, CASE WHEN len(short) > 0 THEN short ELSE now[len(now):] END AS t FROM (SELECT o.doc_id, o.rn, o.n, o.unit, f.now, length({_JOIN.format("list_append(f.now, o.unit)")}) <= 450 AS fits, {_suffix("f.now", "75")} AS short FROM f JOIN o ON o.doc_id = f.doc_id AND o.rn = f.rn + 1))),
children AS (SELECT doc_id, part, row_number() OVER (PARTITION BY doc_id ORDER BY rn) - 1 AS child_index, count(*) OVER (PARTITION BY doc_id) AS child_count FROM (SELECT doc_id, rn, closed AS part FROM f WHERE closed IS NOT NULL UNION ALL SELECT doc_id, rn + 1, {_JOIN.format("now")} FROM f WHERE rn = n))"""
