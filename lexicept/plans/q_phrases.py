"""Queries: rule tokens with offsets and phrase patterns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import phrases as P
from ..sources import fixtures as fx
from .registry import query

# The test phrase lexicon (category, ord, pattern).
PHRASE_ROWS = [
    ("article", 0, "the"),
    ("article", 0, "de la"),
    ("link", 1, "of the"),
    ("link", 1, "and of"),
    ("link", 1, "of the in*"),
    ("opening", 2, "in the"),
    ("opening", 2, "th* the"),
    ("opening", 2, "the th* of"),
    ("gap", 3, "to * the"),
    ("mark", 4, ", the"),
    ("mark", 4, "."),
    ("absent", 5, "zzz qqq"),
]
PHRASE_CATEGORIES = ["article", "link", "opening", "gap", "mark", "absent"]
LONGEST_PATTERN = 3

_MARK = chr(0xE000)  # private-use character: where a clitic begins
_LETTERS = r"\p{L}\p{M}"
_CLITIC = "[''’](?:[rR][eE]|[vV][eE]|[lL][lL]|[sSdDmM])"
_NEGATION = "[nN][''’][tT]"

# The clitics are marked first; then one list of all pieces, white space included, whose lengths add up to the offsets.
SPANS_SQL = (
    f"marked AS (SELECT doc_id, regexp_replace(regexp_replace(text, '({_NEGATION})($|[^{_LETTERS}])', '{_MARK}\\1\\2', 'g'), "
    f"'({_CLITIC})($|[^{_LETTERS}])', '{_MARK}\\1\\2', 'g') AS t FROM documents),\n"
    f"pieces AS (SELECT doc_id, regexp_extract_all(t, '{_MARK}{_NEGATION}|{_MARK}{_CLITIC}|[0-9]+(?:[.,:][0-9]+)*|[{_LETTERS}]+|"
    f"\\.{{2,}}|[\\x09-\\x0D\\x20\\x{{A0}}\\x{{3000}}]+|[^{_MARK}]') AS ps FROM marked),\n"
    f"piece AS (SELECT doc_id, i, replace(ps[i], '{_MARK}', '') AS token FROM "
    "(SELECT doc_id, ps, unnest(generate_series(1, len(ps))) AS i FROM pieces)),\n"
    "placed AS (SELECT doc_id, i, token, CAST(sum(length(token)) OVER (PARTITION BY doc_id ORDER BY i) AS BIGINT) AS end_char FROM piece),\n"
    "spans AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS BIGINT) AS pos, "
    "CAST(end_char - length(token) AS BIGINT) AS start_char, end_char, token FROM placed "
    "WHERE NOT regexp_full_match(token, '[\\x09-\\x0D\\x20\\x{A0}\\x{3000}]+'))"
)

_PHRASES_SQL = "phrases AS (SELECT category, ord, string_split(pattern, ' ') AS p FROM (VALUES " + ", ".join(
    f"('{c}', {o}, '{p}')" for c, o, p in PHRASE_ROWS
) + ") t(category, ord, pattern))"


def _word_matches(i: int) -> str:
    return (f"(len(p) < {i} OR (CASE WHEN p[{i}] LIKE '%*' THEN starts_with(w{i}, rtrim(p[{i}], '*')) "
            f"ELSE w{i} = p[{i}] END))")


_LEAD = "lead({}, {}) OVER (PARTITION BY doc_id ORDER BY pos)"
MATCHES_SQL = (
    "tri AS (SELECT doc_id, pos, start_char, lower(token) AS w1, "
    + ", ".join(_LEAD.format("lower(token)", i - 1) + f" AS w{i}" for i in range(2, LONGEST_PATTERN + 1))
    + ", end_char AS e1, " + ", ".join(_LEAD.format("end_char", i - 1) + f" AS e{i}" for i in range(2, LONGEST_PATTERN + 1))
    + " FROM spans),\n"
    "matches AS (SELECT DISTINCT doc_id, pos, CAST(len(p) AS BIGINT) AS n_tokens, start_char, "
    "CASE len(p) WHEN 1 THEN e1 WHEN 2 THEN e2 ELSE e3 END AS end_char, category FROM tri JOIN phrases ON "
    + " AND ".join(_word_matches(i) for i in range(1, LONGEST_PATTERN + 1)) + ")"
)

# Left to right, longest first: matches that overlap in a chain form a cluster, whose walk starts at its first match.
LONGEST_SQL = (
    "best AS (SELECT doc_id, pos, max(n_tokens) AS n FROM matches GROUP BY doc_id, pos),\n"
    "reach AS (SELECT *, coalesce(pos >= max(pos + n) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING "
    "AND 1 PRECEDING), true) AS head FROM best),\n"
    "cluster AS (SELECT *, sum(CAST(head AS INT)) OVER (PARTITION BY doc_id ORDER BY pos) AS c FROM reach),\n"
    "step AS (SELECT a.doc_id, a.c, a.pos, min(b.pos) AS nxt FROM cluster a JOIN cluster b ON a.doc_id = b.doc_id AND a.c = b.c "
    "AND b.pos >= a.pos + a.n GROUP BY a.doc_id, a.c, a.pos),\n"
    "walk AS (SELECT doc_id, pos FROM cluster WHERE head UNION ALL SELECT s.doc_id, s.nxt FROM walk w JOIN step s "
    "ON s.doc_id = w.doc_id AND s.pos = w.pos),\n"
    "taken AS (SELECT m.* FROM matches m JOIN best b USING (doc_id, pos) JOIN walk w USING (doc_id, pos) WHERE m.n_tokens = b.n)"
)


def _with(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(ctes) + "\n"


def fx_phrases(spark):
    return spark.createDataFrame(PHRASE_ROWS, "category string, ord int, pattern string")


@query("token_spans", _with(SPANS_SQL) + "SELECT doc_id, pos, start_char, end_char, token FROM spans")
def q_token_spans(spark, sf):
    return P.token_spans(fx.documents(spark, sf), "doc_id", "text")


@query("phrase_hits_all", _with(SPANS_SQL, _PHRASES_SQL, MATCHES_SQL) + "SELECT * FROM matches")
def q_phrase_hits_all(spark, sf):
    return P.phrase_hits(fx.documents(spark, sf), fx_phrases(spark), mode="all")


@query("phrase_hits", _with(SPANS_SQL, _PHRASES_SQL, MATCHES_SQL, LONGEST_SQL) + "SELECT * FROM taken")
def q_phrase_hits(spark, sf):
    return P.phrase_hits(fx.documents(spark, sf), fx_phrases(spark))


@query(
    "phrase_counts",
    _with(SPANS_SQL, _PHRASES_SQL, MATCHES_SQL, LONGEST_SQL)
    + "SELECT d.doc_id, c.category, CAST(count(t.pos) AS BIGINT) AS n FROM documents d "
    "CROSS JOIN (SELECT DISTINCT category FROM phrases) c LEFT JOIN taken t ON t.doc_id = d.doc_id AND t.category = c.category "
    "GROUP BY d.doc_id, c.category",
)
def q_phrase_counts(spark, sf):
    return P.phrase_counts(fx.documents(spark, sf), fx_phrases(spark), PHRASE_CATEGORIES).select(
        "doc_id", "category", F.col("n").cast("long").alias("n")
    )
