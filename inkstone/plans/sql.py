"""Pieces of DuckDB SQL that mirror the Column functions of inkstone.functions.text and the chunking operator."""

from __future__ import annotations

UP, LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lower(x: str) -> str:
    return f"translate({x}, '{UP}', '{LOW}')"


def tokens(x: str) -> str:
    return f"CAST(greatest(1, ceil(length({x}) / 4.0)) AS BIGINT)"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '\\s+'), lambda w: w <> '')"


def trim(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def terms(x: str) -> str:
    return f"list_filter(regexp_split_to_array({lower(x)}, '[^\\p{{L}}\\p{{N}}]'), lambda w: strlen(w) >= 2)"


def lines(x: str) -> str:
    """Lines of a text without carriage returns that may end with a line end."""
    return f"CASE WHEN {x} = '' THEN [] WHEN ends_with({x}, chr(10)) THEN string_split({x}, chr(10))[:-2] ELSE string_split({x}, chr(10)) END"


def chunks(table: str = "documents", text: str = "text") -> str:
    """A CTE body: doc_key, digest, display_name, lang, source, ordinal, chunk_id, token_count, text, terms."""
    pieces = f"""flatten(list_transform(
        list_filter(list_transform(string_split({text}, chr(10) || chr(10)), lambda p: {trim("p")}), lambda p: p <> ''),
        lambda p: CASE WHEN {tokens("p")} <= 512 THEN [p] ELSE list_transform(
            range(CASE WHEN len({words("p")}) <= 384 THEN 1 ELSE CAST(ceil((len({words("p")}) - 384) / 336.0) AS BIGINT) + 1 END),
            lambda i: array_to_string(list_slice({words("p")}, i * 336 + 1, i * 336 + 384), ' ')) END))"""
    return f"""
    SELECT doc_key, digest, display_name, lang, source, CAST(ordinal AS BIGINT) AS ordinal,
           substr(digest, 1, 8) || ':c' || ordinal AS chunk_id, {tokens("text")} AS token_count, text, {terms("text")} AS terms
    FROM (SELECT doc_id AS doc_key, sha256({text}) AS digest, 'doc-' || doc_id || '.txt' AS display_name, lang, source,
                 unnest(pieces) AS text, unnest(range(len(pieces))) AS ordinal
          FROM (SELECT *, {pieces} AS pieces FROM {table}))"""


LABEL = "'[source: ' || chunk_id || ', \"' || display_name || '\"]'"
COST = f"(token_count + {tokens(LABEL)} + 10)"


def bm25(query: str, limit: int, where: str = "true") -> str:
    q = query.replace("'", "''")
    return f"""
    WITH c AS ({chunks()}),
    q AS (SELECT term, count(*) AS qtf FROM (SELECT unnest({terms(f"'{q}'")}) AS term) GROUP BY term),
    p AS (SELECT doc_key, ordinal, term, len(terms) AS dl, count(*) AS tf
          FROM (SELECT doc_key, ordinal, terms, unnest(terms) AS term FROM c) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    s AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM c),
    ok AS (SELECT doc_key, ordinal FROM c WHERE {where})
    SELECT doc_key, ordinal, round(sum(qtf * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM p JOIN d USING (term) JOIN q USING (term) CROSS JOIN s JOIN ok USING (doc_key, ordinal)
    GROUP BY doc_key, ordinal ORDER BY score DESC, ordinal, doc_key LIMIT {limit}"""
