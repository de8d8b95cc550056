"""The registered queries in SQL, written from their definitions, not from the Spark plans.

Sequences are self-joins on token positions, step functions are sums over elementary segments.
"""

from __future__ import annotations

ORACLE: dict[str, str] = {}

# Texts, sentences and tokens of the text corpora.
TEXT = r"""
docs AS (
  SELECT upper(d.source) AS corpus, d.doc_id AS text_id, d.lang AS text_lang,
         CAST(l.quality AS VARCHAR) AS text_quality, CAST(l.toxic AS VARCHAR) AS text_toxic, d.text
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
pieces AS (
  SELECT corpus, text_id, text_lang, text_quality, text_toxic, p.ord,
         regexp_extract_all(p.piece, '[\p{L}\p{N}]+') AS words
  FROM docs, unnest(regexp_extract_all(docs.text, '[^.!?\n]+')) WITH ORDINALITY AS p(piece, ord)),
sents AS (
  SELECT *, len(words) AS n, row_number() OVER (PARTITION BY corpus, text_id ORDER BY ord) - 1 AS sent_no
  FROM pieces WHERE len(words) > 0),
raw AS (
  SELECT corpus, text_id, text_lang, text_quality, text_toxic, sent_no, n, w.i - 1 AS i, w.word, lower(w.word) AS lemma,
         CASE WHEN regexp_matches(w.word, '^\p{N}+$') THEN 'NUM' WHEN regexp_matches(w.word, '^\p{Lu}') THEN 'CAP' ELSE 'LOW' END AS pos
  FROM sents, unnest(sents.words) WITH ORDINALITY AS w(word, i)),
tok AS MATERIALIZED (
  SELECT *, CASE pos WHEN 'CAP' THEN lemma || ':' || length(lemma) WHEN 'LOW' THEN lemma END AS sense,
         CASE WHEN pos = 'NUM' THEN CAST([] AS VARCHAR[]) WHEN lemma = lemma[1:3] THEN [lemma] ELSE [lemma, lemma[1:3]] END AS lex,
         row_number() OVER (PARTITION BY corpus, text_id ORDER BY sent_no, i) - 1 AS off,
         row_number() OVER (PARTITION BY corpus ORDER BY text_id, sent_no, i) - 1 AS position
  FROM raw),
sizes AS (SELECT corpus, count(*) AS size FROM tok GROUP BY corpus),
total AS (SELECT count(*) AS size FROM tok)
"""

# Tokens of the conversations; a text per turn, numbered by conversation and turn.
CONV_TOKENS = r"""
turns AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY conv_id NULLS FIRST, turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS text_id FROM conversations),
cpieces AS (
  SELECT text_id, conv_id, turn, role, l.ord AS line, p.ord, regexp_extract_all(p.piece, '[\p{L}\p{N}]+') AS words
  FROM turns, unnest(string_split(text, chr(10))) WITH ORDINALITY AS l(body, ord),
       unnest(regexp_extract_all(l.body, '[^.!?\n]+')) WITH ORDINALITY AS p(piece, ord)),
csents AS (
  SELECT *, row_number() OVER t - 1 AS sent_no, dense_rank() OVER (PARTITION BY text_id ORDER BY line) - 1 AS line_no
  FROM cpieces WHERE len(words) > 0 WINDOW t AS (PARTITION BY text_id ORDER BY line, ord)),
ctok AS MATERIALIZED (
  SELECT 'CONV-' || upper(role) AS corpus, text_id, conv_id, turn, role, line_no, sent_no, w.i - 1 AS i, w.word,
         regexp_matches(w.word, '^\p{Lu}') AND NOT regexp_matches(w.word, '^\p{N}+$') AS cap, regexp_matches(w.word, '^\p{N}+$') AS num,
         row_number() OVER (PARTITION BY text_id ORDER BY sent_no, w.i) - 1 AS off,
         row_number() OVER (PARTITION BY role ORDER BY text_id, sent_no, w.i) - 1 AS position
  FROM csents, unnest(words) WITH ORDINALITY AS w(word, i)),
cnext AS MATERIALIZED (SELECT *, lead(cap OR num) OVER (PARTITION BY text_id, sent_no ORDER BY i) AS not_low FROM ctok)
"""

# Links between sentences of a user's turn and of the assistant's next one.
LINKS = """
csizes AS (
  SELECT text_id, conv_id, turn, role, min(position) AS start_pos, max(position) AS end_pos, count(DISTINCT sent_no) AS n_sents FROM ctok GROUP BY ALL),
cspans AS (SELECT text_id, sent_no, min(position) AS first, max(position) AS last FROM ctok GROUP BY ALL),
cpairs AS (
  SELECT a.text_id AS a_text, b.text_id AS b_text, a.end_pos AS a_end, b.end_pos AS b_end, least(a.n_sents, b.n_sents) AS n
  FROM csizes a JOIN csizes b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 AND a.role = 'user' AND b.role = 'assistant'),
links AS MATERIALIZED (
  SELECT x.first, CASE WHEN x.sent_no = n - 1 THEN a_end ELSE x.last END AS last, y.first AS p_first, CASE WHEN x.sent_no = n - 1 THEN b_end ELSE y.last END AS p_last
  FROM cpairs JOIN cspans x ON x.text_id = a_text AND x.sent_no < n JOIN cspans y ON y.text_id = b_text AND y.sent_no = x.sent_no)
"""

# The tokens with the line they stand in.
LINES = r"""
lpieces AS (
  SELECT corpus, text_id, l.ord AS line, p.ord, len(regexp_extract_all(p.piece, '[\p{L}\p{N}]+')) AS words
  FROM docs, unnest(string_split(text, chr(10))) WITH ORDINALITY AS l(body, ord),
       unnest(regexp_extract_all(l.body, '[^.!?\n]+')) WITH ORDINALITY AS p(piece, ord)),
lsents AS (
  SELECT corpus, text_id, dense_rank() OVER (PARTITION BY corpus, text_id ORDER BY line) - 1 AS line,
         row_number() OVER (PARTITION BY corpus, text_id ORDER BY line, ord) - 1 AS sent_no
  FROM lpieces WHERE words > 0),
ltok AS MATERIALIZED (SELECT tok.*, line FROM tok JOIN lsents USING (corpus, text_id, sent_no))
"""

# Tokens with what follows them in their text.
NEXT = """
next AS MATERIALIZED (
  SELECT *, lead(word) OVER t AS w1, lead(pos) OVER t AS p1, lead(lemma) OVER t AS lemma1, max(off) OVER (PARTITION BY corpus, text_id) AS last
  FROM tok WINDOW t AS (PARTITION BY corpus, text_id ORDER BY off))
"""

# A token with the three tokens that follow it in its sentence.
AHEAD = r"""
ahead AS MATERIALIZED (
  SELECT *, lead(word, 1) OVER s AS w1, lead(word, 2) OVER s AS w2, lead(word, 3) OVER s AS w3,
         lead(pos, 1) OVER s AS p1, lead(pos, 2) OVER s AS p2, lead(pos, 3) OVER s AS p3,
         lead(lex, 1) OVER s AS lex1, lead(sense, 1) OVER s AS sense1, lead(lemma, 1) OVER s AS lemma1
  FROM tok WINDOW s AS (PARTITION BY corpus, text_id, sent_no ORDER BY i))
"""

SAME = "a.corpus = b.corpus AND a.text_id = b.text_id AND a.sent_no = b.sent_no"
PLACE = "corpus, text_id, off AS \"offset\""


def _text(name: str, select: str, *ctes: str) -> None:
    ORACLE[name] = "WITH " + ",".join([TEXT, *ctes]) + select


def _ahead(name: str, select: str, *ctes: str) -> None:
    _text(name, select, AHEAD, *ctes)


# --------------------------------------------------------------------------------------
# sources and derived tables

_text(
    "corpus_positions",
    """
    SELECT d.corpus, d.text_id, CAST(coalesce(t.n_tokens, 0) AS BIGINT) AS n_tokens, CAST(coalesce(t.n_sents, 0) AS BIGINT) AS n_sents,
           CAST(coalesce(sum(t.n_tokens) OVER (PARTITION BY d.corpus ORDER BY d.text_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_pos
    FROM docs d LEFT JOIN (SELECT corpus, text_id, count(*) AS n_tokens, count(DISTINCT sent_no) AS n_sents FROM tok GROUP BY ALL) t
      ON d.corpus = t.corpus AND d.text_id = t.text_id""",
)
_text("sentence_positions", " SELECT corpus, text_id, sent_no, min(position) AS start_pos, count(*) AS n FROM tok GROUP BY corpus, text_id, sent_no")
_text("attribute_scan", " SELECT corpus, lemma, pos, text_lang, count(*) AS absolute FROM tok GROUP BY ALL")

PAIRS = f"""
pairs AS MATERIALIZED (
  SELECT a.corpus, a.text_id, a.sent_no, 'R' || (b.i - a.i) AS rel, a.word AS hw, a.lemma AS hb, a.pos AS headpos,
         b.word AS dw, b.lemma AS db, b.pos AS deppos, a.i + 1 AS "start", b.i + 1 AS "end"
  FROM tok a JOIN tok b ON {SAME} AND b.i - a.i IN (1, 2)),
triples AS MATERIALIZED (
  SELECT corpus, hb AS head, headpos, rel, db AS dep, deppos, TRUE AS bfhead, TRUE AS bfdep, FALSE AS wfhead, FALSE AS wfdep, count(*) AS freq FROM pairs GROUP BY ALL
  UNION ALL
  SELECT corpus, hw, headpos, rel, db, deppos, FALSE, TRUE, TRUE, FALSE, count(*) FROM pairs GROUP BY ALL
  UNION ALL
  SELECT corpus, hb, headpos, rel, dw, deppos, TRUE, FALSE, FALSE, TRUE, count(*) FROM pairs GROUP BY ALL)
"""
_text(
    "relation_table",
    """
    SELECT corpus, rel, bfhead, bfdep, wfhead, wfdep, count(*) AS entries, CAST(sum(freq) AS BIGINT) AS freq, max(freq) AS highest
    FROM triples GROUP BY ALL""",
    PAIRS,
)
_text(
    "relation_table_rows",
    """
    SELECT * FROM triples
    WHERE (head LIKE '%ing' AND ((bfhead AND bfdep) OR wfhead)) OR (dep LIKE '%ing' AND ((bfhead AND bfdep) OR wfdep))""",
    PAIRS,
)
_text(
    "relation_marginals",
    """
    , m AS (
      SELECT 'rel' AS kind, 'base' AS form, corpus, rel, count(*) AS freq FROM pairs GROUP BY ALL
      UNION ALL SELECT kind, form, corpus, rel, freq FROM (SELECT 'head' AS kind, 'base' AS form, corpus, rel, hb, headpos, count(*) AS freq FROM pairs GROUP BY ALL)
      UNION ALL SELECT kind, form, corpus, rel, freq FROM (SELECT 'head' AS kind, 'word' AS form, corpus, rel, hw, headpos, count(*) AS freq FROM pairs GROUP BY ALL)
      UNION ALL SELECT kind, form, corpus, rel, freq FROM (SELECT 'dep' AS kind, 'base' AS form, corpus, rel, db, deppos, count(*) AS freq FROM pairs GROUP BY ALL)
      UNION ALL SELECT kind, form, corpus, rel, freq FROM (SELECT 'dep' AS kind, 'word' AS form, corpus, rel, dw, deppos, count(*) AS freq FROM pairs GROUP BY ALL))
    SELECT corpus, kind, form, rel, count(*) AS entries, CAST(sum(freq) AS BIGINT) AS freq, max(freq) AS highest FROM m GROUP BY ALL""",
    PAIRS,
)

INDEX = """
entries AS (
  SELECT corpus, unnest(lex) AS lemgram, 'lemgram' AS kind FROM tok
  UNION ALL SELECT corpus, lemma[1:3], 'prefix' FROM tok WHERE pos <> 'NUM' AND length(lemma) > 3
  UNION ALL SELECT corpus, right(lemma, 3), 'suffix' FROM tok WHERE pos <> 'NUM' AND length(lemma) > 3),
lemgram_index AS (
  SELECT corpus, lemgram, count(*) FILTER (kind = 'lemgram') AS freq, count(*) FILTER (kind = 'prefix') AS freq_prefix,
         count(*) FILTER (kind = 'suffix') AS freq_suffix
  FROM entries GROUP BY corpus, lemgram)
"""
_text("lemgram_index", " SELECT * FROM lemgram_index", INDEX)
_text(
    "lemgram_count",
    """
    SELECT lemgram, CAST(sum(freq + freq_prefix + freq_suffix) AS BIGINT) AS freq FROM lemgram_index
    WHERE lemgram IN ('the', 'ion', 'ing', 'of', 'Of', 'not-there') GROUP BY lemgram HAVING sum(freq + freq_prefix + freq_suffix) > 0""",
    INDEX,
)

# --------------------------------------------------------------------------------------
# catalogue

_text(
    "corpora_list",
    " SELECT DISTINCT corpus, corpus IN (SELECT corpus FROM docs WHERE text_toxic = '1') AS protected FROM docs",
)
_text(
    "access_denied",
    """
    SELECT DISTINCT corpus FROM docs WHERE text_toxic = '1' AND regexp_full_match(corpus, 'SRC[0-9]') AND CAST(substr(corpus, 4) AS INT) % 2 = 1""",
)
_text("corpus_info_totals", " SELECT count(*) AS total_size, count(DISTINCT (corpus, text_id, sent_no)) AS total_sentences FROM tok")
_text(
    "corpus_attributes",
    """
    , has AS (
      SELECT corpus, 'p' AS kind, unnest(['word', 'lemma', 'pos', 'lex']) AS attr, TRUE AS has FROM tok
      UNION ALL SELECT corpus, 'p', 'sense', sense IS NOT NULL FROM tok
      UNION ALL SELECT corpus, 's', 'text_lang', text_lang IS NOT NULL FROM docs
      UNION ALL SELECT corpus, 's', 'text_quality', text_quality IS NOT NULL FROM docs
      UNION ALL SELECT corpus, 's', 'text_toxic', text_toxic IS NOT NULL FROM docs)
    SELECT DISTINCT corpus, kind, attr FROM has WHERE has""",
)

# --------------------------------------------------------------------------------------
# token conditions

_ONE = f' SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM tok WHERE '
_text("pred_eq", _ONE + "word = 'the'")
_text("pred_regex", _ONE + "regexp_full_match(word, '(un|in).*tion')")
_text("pred_contains", _ONE + "list_contains(lex, 'ion') OR len(list_filter(lex, lambda v: regexp_full_match(v, 're.*nd'))) > 0")
_text("pred_any", " SELECT corpus, size AS hits FROM sizes")
_text("pred_ignore_case", _ONE + "lower(word) = 'the'")
_text("pred_bool", _ONE + "(pos = 'CAP' AND word NOT LIKE '%ing' AND sense <> 'the:3') OR word IN ('of', 'la')")
_text("pred_struct", _ONE + "word = 'the' AND text_lang = 'en' AND text_quality = '1'")
_ahead("pred_assert", f' SELECT {PLACE}, CAST(2 AS BIGINT) AS "length" FROM ahead WHERE word = \'the\' AND regexp_full_match(w1, \'[a-m].*\')')

# --------------------------------------------------------------------------------------
# sequences

_ahead("match_sequence", " SELECT corpus, position FROM ahead WHERE word = 'the' AND w1 LIKE '%ing'")


def _nearest(lo: int, hi: int | None, same: str = SAME, at: str = "i", source: str = "tok") -> str:
    """'the' and the nearest word in -ing, lo to hi places on."""
    upper = f" AND b.{at} <= a.{at} + {hi}" if hi is not None else ""
    return f"""
    nearest AS MATERIALIZED (
      SELECT a.corpus, a.text_id, a.text_lang, a.sent_no, a.i, a.off, a.position, min(b.{at}) - a.{at} + 1 AS len
      FROM {source} a JOIN {source} b ON {same} AND b.{at} >= a.{at} + {lo}{upper}
      WHERE a.word = 'the' AND b.word LIKE '%ing'
      GROUP BY a.corpus, a.text_id, a.text_lang, a.sent_no, a.i, a.off, a.position)
    """


_FOUND = f' SELECT {PLACE}, CAST(len AS BIGINT) AS "length" FROM nearest'
SAME_TEXT = "a.corpus = b.corpus AND a.text_id = b.text_id"
_text("match_gap", _FOUND, _nearest(1, 4))
_text("match_open_gap", _FOUND, _nearest(2, None))
_text("match_within_text", _FOUND, _nearest(1, 6, SAME_TEXT, "off"))
_text("match_unbounded_region", ' SELECT corpus, position, len AS "length" FROM nearest', _nearest(1, 6, "a.corpus = b.corpus", "position"))
_ahead(
    "match_gap_chain",
    f"""
    SELECT a.corpus, a.text_id, a.off AS "offset", min(b.i) + 1 - a.i + 1 AS "length"
    FROM tok a JOIN ahead b ON {SAME} AND b.i BETWEEN a.i + 1 AND a.i + 3
    WHERE a.word = 'the' AND b.pos = 'LOW' AND b.w1 LIKE '%ing' GROUP BY a.corpus, a.text_id, a.off, a.i""",
)
_text(
    "match_edge_wildcards",
    f"""
    SELECT a.corpus, a.text_id, a.off AS "offset", min(b.i) + 1 - a.i + 1 AS "length"
    FROM tok a JOIN tok b ON {SAME} AND b.i BETWEEN a.i AND a.i + 2
    WHERE b.word = 'the' AND b.i + 1 < b.n GROUP BY a.corpus, a.text_id, a.off, a.i""",
)
_ahead(
    "match_repetition",
    f"""
    SELECT {PLACE}, CAST(CASE WHEN w1 LIKE '%n' THEN 2 WHEN p1 = 'CAP' AND w2 LIKE '%n' THEN 3 ELSE 4 END AS BIGINT) AS "length" FROM ahead
    WHERE pos = 'CAP' AND (w1 LIKE '%n' OR (p1 = 'CAP' AND w2 LIKE '%n') OR (p1 = 'CAP' AND p2 = 'CAP' AND w3 LIKE '%n'))""",
)
_ahead(
    "match_alternation",
    f"""
    , options AS (
      SELECT *, 3 AS len FROM ahead WHERE word = 'the' AND w1 LIKE '%ing' AND regexp_full_match(w2, '[a-h].*')
      UNION ALL SELECT *, 3 FROM ahead WHERE word = 'of' AND p1 = 'LOW' AND regexp_full_match(w2, '[a-h].*')
      UNION ALL SELECT *, 4 FROM ahead WHERE word = 'of' AND p2 = 'LOW' AND regexp_full_match(w3, '[a-h].*')
      UNION ALL SELECT *, 2 FROM ahead WHERE pos = 'CAP' AND regexp_full_match(w1, '[a-h].*'))
    SELECT {PLACE}, CAST(min(len) AS BIGINT) AS "length" FROM options GROUP BY corpus, text_id, off""",
)
_ahead(
    "match_within_text_open",
    """
    , heads AS (SELECT corpus, text_id, off FROM tok a WHERE pos = 'CAP' AND EXISTS (
        SELECT 1 FROM tok b WHERE b.corpus = a.corpus AND b.text_id = a.text_id AND b.off = a.off + 1 AND b.word = 'the'))
    SELECT a.corpus, a.text_id, a.off AS "offset", min(b.off) - a.off + 1 AS "length"
    FROM heads a JOIN tok b ON a.corpus = b.corpus AND a.text_id = b.text_id AND b.off >= a.off + 4 AND b.word LIKE '%ing'
    GROUP BY a.corpus, a.text_id, a.off""",
)
_text(
    "match_free_order",
    """
    SELECT corpus, text_id, sent_no FROM tok GROUP BY corpus, text_id, sent_no
    HAVING count(*) FILTER (word = 'the') > 0 AND count(*) FILTER (word LIKE '%ing') > 0 AND count(*) FILTER (word = 'of') > 0""",
)
_text(
    "match_chain_expand",
    f"""
    SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM tok SEMI JOIN held USING (corpus, text_id, sent_no) WHERE word = 'of'""",
    NEXT.replace("PARTITION BY corpus, text_id ORDER BY off", "PARTITION BY corpus, text_id, sent_no ORDER BY off"),
    "held AS MATERIALIZED (SELECT DISTINCT corpus, text_id, sent_no FROM next WHERE word = 'the' AND w1 LIKE '%ing')",
)
_text(
    "match_within_by_corpus",
    f"""
    SELECT a.corpus, a.text_id, a.off AS "offset", min(b.off) - a.off + 1 AS "length"
    FROM tok a JOIN tok b ON {SAME_TEXT} AND b.off BETWEEN a.off + 1 AND a.off + 6 AND (a.corpus = 'SRC3' OR a.sent_no = b.sent_no)
    WHERE a.word = 'the' AND b.word LIKE '%ing' GROUP BY a.corpus, a.text_id, a.off""",
)
_text(
    "match_free_order_text",
    f"""
    , slots AS (SELECT *, word = 'the' AS s1, regexp_full_match(word, 'i.*ing') AS s2, word = 'of' AS s3 FROM tok)
    SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM slots WHERE s1 OR s2 OR s3
    WINDOW t AS (PARTITION BY corpus, text_id) QUALIFY bool_or(s1) OVER t AND bool_or(s2) OVER t AND bool_or(s3) OVER t""",
)
_text(
    "match_chain_expand_text",
    f"""
    SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM tok SEMI JOIN held USING (corpus, text_id) WHERE pos = 'CAP' AND word LIKE '%ing'""",
    NEXT,
    "held AS MATERIALIZED (SELECT DISTINCT corpus, text_id FROM next WHERE word = 'the' AND regexp_full_match(w1, 'i.*ing'))",
)
SAME_LINE = "a.corpus = b.corpus AND a.text_id = b.text_id AND a.line = b.line"
_text("match_within_line", _FOUND, LINES, _nearest(1, 9, SAME_LINE, "off", "ltok"))
_text(
    "match_chain_expand_line",
    f"""
    , held AS (
      SELECT DISTINCT corpus, text_id, line FROM (SELECT *, lead(word) OVER (PARTITION BY corpus, text_id, line ORDER BY off) AS w1 FROM ltok)
      WHERE word = 'the' AND w1 LIKE '%ing')
    SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM ltok SEMI JOIN held USING (corpus, text_id, line) WHERE word = 'of'""",
    LINES,
)
_text(
    "match_repetition_text",
    f"""
    , ends AS (
      SELECT *, min(CASE WHEN pos <> 'LOW' THEN off END) OVER (PARTITION BY corpus, text_id ORDER BY off ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop
      FROM tok)
    SELECT a.corpus, a.text_id, a.off AS "offset", a.stop - a.off + 1 AS "length" FROM ends a
    JOIN tok b ON {SAME_TEXT} AND b.off = a.stop WHERE a.word = 'the' AND b.pos = 'CAP' AND a.stop >= a.off + 2""",
)
_text(
    "match_edge_open_text",
    """
    , found AS (
      SELECT *, min(CASE WHEN word = 'the' AND w1 LIKE '%ing' AND off + 3 <= last THEN off END)
                  OVER (PARTITION BY corpus, text_id ORDER BY off ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS there FROM next)
    SELECT corpus, text_id, off AS "offset", there + 3 - off + 1 AS "length" FROM found WHERE there IS NOT NULL""",
    NEXT,
)
_text(
    "match_chain_spans_text",
    """
    , reach AS (
      SELECT *, min(CASE WHEN word LIKE '%ing' THEN off END) OVER (PARTITION BY corpus, text_id ORDER BY off ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop
      FROM next),
    spans AS (SELECT *, max(CASE WHEN word = 'the' THEN stop END) OVER (PARTITION BY corpus, text_id ORDER BY off) AS farthest FROM reach)
    SELECT corpus, text_id, off AS "offset", CAST(2 AS BIGINT) AS "length" FROM spans WHERE pos = 'CAP' AND p1 = 'LOW' AND farthest >= off + 1""",
    NEXT,
)
_text(
    "match_chain_spans_unbounded",
    """
    , pairs AS (SELECT *, lead(pos) OVER (PARTITION BY corpus ORDER BY position) AS p1 FROM tok)
    SELECT DISTINCT b.corpus, b.text_id, b.off AS "offset", CAST(2 AS BIGINT) AS "length"
    FROM nearest a JOIN pairs b ON a.corpus = b.corpus AND b.position BETWEEN a.position AND a.position + a.len - 2 WHERE b.pos = 'CAP' AND b.p1 = 'LOW'""",
    _nearest(1, 13, "a.corpus = b.corpus", "position"),
)
_text(
    "match_chain_spans",
    f"""
    SELECT DISTINCT b.corpus, b.text_id, b.off AS "offset", CAST(1 AS BIGINT) AS "length"
    FROM nearest a JOIN tok b ON {SAME} AND b.i BETWEEN a.i AND a.i + a.len - 1
    WHERE regexp_full_match(b.word, '[a-m].*')""",
    _nearest(1, 7),
)
_text(
    "match_cut",
    f""" SELECT {PLACE}, CAST(1 AS BIGINT) AS "length" FROM tok WHERE word = 'the'
    QUALIFY row_number() OVER (PARTITION BY corpus ORDER BY position) <= 25""",
)
_text("match_cut_deep", _ONE + "position < 12000")
_ahead(
    "corpus_hits",
    """
    SELECT s.corpus, count(a.corpus) AS hits FROM sizes s LEFT JOIN ahead a
      ON s.corpus = a.corpus AND a.pos = 'CAP' AND regexp_full_match(a.w1, 'th.*ing') GROUP BY s.corpus""",
)



def _conversation(name: str, select: str, *ctes: str) -> None:
    ORACLE[name] = "WITH " + ",".join([CONV_TOKENS, *ctes]) + select


_conversation(
    "match_aligned",
    """
    SELECT 'CONV-USER' AS corpus, text_id, off AS "offset", CAST(1 AS BIGINT) AS "length" FROM ctok a
    WHERE role = 'user' AND word = 'the' AND EXISTS (
      SELECT 1 FROM ctok b WHERE b.conv_id = a.conv_id AND b.turn = a.turn + 1 AND b.role = 'assistant' AND b.word LIKE '%ing')""",
)
_conversation(
    "match_within_conversation",
    """
    , found AS (
      SELECT *, min(CASE WHEN regexp_full_match(word, '[xyz].*') THEN position END)
                  OVER (PARTITION BY role, conv_id ORDER BY position ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS stop FROM ctok WHERE conv_id IS NOT NULL)
    SELECT corpus, text_id, off AS "offset", stop - position + 1 AS "length" FROM found WHERE cap AND stop IS NOT NULL""",
)
_conversation("alignment_links", " SELECT 'CONV-USER' AS corpus, first, last, 'CONV-ASSISTANT' AS partner, p_first, p_last FROM links", LINKS)
_conversation(
    "match_aligned_segments",
    """
    SELECT DISTINCT a.corpus, a.text_id, a.off AS "offset", CAST(2 AS BIGINT) AS "length"
    FROM cnext a JOIN links l ON a.position BETWEEN l.first AND l.last JOIN ctok b ON b.role = 'assistant' AND b.position BETWEEN l.p_first AND l.p_last
    WHERE a.role = 'user' AND a.cap AND a.not_low = FALSE AND b.cap""",
    LINKS,
)

# --------------------------------------------------------------------------------------
# concordance


def _hits(where: str, n: int, start: int, end: int, order: str = "corpus, position", source: str = "ahead") -> str:
    return f"""
    hits AS MATERIALIZED (
      SELECT *, row_number() OVER (ORDER BY {order}) - 1 AS "row", {n} AS len FROM {source} WHERE {where}
      QUALIFY "row" BETWEEN {start} AND {end})
    """


_THE_ING = "word = 'the' AND w1 LIKE '%ing'"
_LINE = """
    SELECT h."row", h.corpus, h.position,
           count(*) FILTER (t.position < h.position) AS "start", count(*) FILTER (t.position < h.position + h.len) AS "end",
           coalesce(string_agg(t.word, ' ' ORDER BY t.position) FILTER (t.position < h.position), '') AS "left",
           string_agg(t.word, ' ' ORDER BY t.position) FILTER (t.position >= h.position AND t.position < h.position + h.len) AS keyword,
           coalesce(string_agg(t.word, ' ' ORDER BY t.position) FILTER (t.position >= h.position + h.len), '') AS "right"
    FROM hits h JOIN tok t ON h.corpus = t.corpus AND {around}
    GROUP BY h."row", h.corpus, h.position, h.len"""
_ahead("kwic_words", _LINE.format(around="t.position BETWEEN h.position - 10 AND h.position + h.len + 9"), _hits(_THE_ING, 2, 0, 24))
_ahead(
    "kwic_context_sides",
    _LINE.format(
        around="""t.position BETWEEN h.position - CASE h.corpus WHEN 'SRC0' THEN 3 ELSE 5 END
                  AND h.position + h.len - 1 + CASE h.corpus WHEN 'SRC0' THEN 8 ELSE 5 END"""
    ),
    _hits(_THE_ING, 2, 0, 49),
)
_ahead("kwic_sentence", _LINE.format(around="t.text_id = h.text_id AND t.sent_no = h.sent_no"), _hits(_THE_ING, 2, 0, 24))
_ahead(
    "kwic_sentences_around",
    _LINE.format(around="t.text_id = h.text_id AND t.sent_no BETWEEN h.sent_no - 1 AND h.sent_no + 1"),
    _hits(_THE_ING, 2, 0, 24),
)
_ahead(
    "kwic_context_lines",
    _LINE.replace("FROM hits h JOIN tok t", "FROM placed h JOIN ltok t").format(around="t.text_id = h.text_id AND t.line BETWEEN h.line - 1 AND h.line + 1"),
    LINES,
    _hits(_THE_ING, 2, 0, 24),
    "placed AS (SELECT h.*, line FROM hits h JOIN lsents USING (corpus, text_id, sent_no))",
)
_ahead(
    "kwic_show",
    """
    SELECT h."row", string_agg(t.word, ' ' ORDER BY t.position) AS word, string_agg(t.lemma, ' ' ORDER BY t.position) AS lemma,
           string_agg(t.pos, ' ' ORDER BY t.position) AS pos
    FROM hits h JOIN tok t ON h.corpus = t.corpus AND t.position BETWEEN h.position - 2 AND h.position + 3 GROUP BY h."row" """,
    _hits(_THE_ING, 2, 0, 24),
)
_ahead("kwic_structs", ' SELECT "row", corpus, position, text_lang, text_quality FROM hits', _hits(_THE_ING, 2, 0, 99))
_ahead(
    "kwic_open_close",
    """
    , ends AS (SELECT corpus, text_id, max(off) AS last FROM tok GROUP BY corpus, text_id)
    SELECT h."row", t.corpus, t.i, t.word, t.i BETWEEN h.i AND h.i + 1 AS in_match,
           concat_ws(' ', CASE WHEN t.off = 0 THEN 'text' END, CASE WHEN t.i = 0 THEN 'sentence' END) AS "open",
           concat_ws(' ', CASE WHEN t.i = t.n - 1 THEN 'sentence' END, CASE WHEN t.off = e.last THEN 'text' END) AS "close"
    FROM hits h JOIN tok t ON h.corpus = t.corpus AND h.text_id = t.text_id AND h.sent_no = t.sent_no
    JOIN ends e ON e.corpus = t.corpus AND e.text_id = t.text_id""",
    _hits("pos = 'CAP' AND p1 = 'LOW'", 2, 0, 199),
)

_AROUND = """
around AS MATERIALIZED (
  SELECT *, coalesce(lag(word, 1) OVER c, '') AS l1, coalesce(lag(word, 2) OVER c, '') AS l2, coalesce(lag(word, 3) OVER c, '') AS l3,
         coalesce(lead(word, 1) OVER c, '') AS r1, coalesce(lead(word, 2) OVER c, '') AS r2, coalesce(lead(word, 3) OVER c, '') AS r3
  FROM tok WINDOW c AS (PARTITION BY corpus ORDER BY position))
"""
_ROWS = ' SELECT "row", corpus, position FROM hits'
_text("kwic_sort_left", _ROWS, _AROUND, _hits("word = 'the'", 1, 5, 64, "corpus, l1, l2, l3, position", "around"))
_text("kwic_sort_right", _ROWS, _AROUND, _hits("word = 'the'", 1, 5, 64, "corpus, r1, r2, r3, position", "around"))
# Swedish order: letters first, whatever their accents, then accents.  Fixed values: which accents come first.
_ACCENTS = """
accents AS MATERIALIZED (
  SELECT *, array_to_string(list_transform(string_split(word, ''), lambda c:
    CASE WHEN c = 'é' THEN '01' WHEN c IN ('è', 'à', 'ù') THEN '02' WHEN c IN ('ê', 'â', 'î', 'ô', 'û') THEN '03' WHEN c IN ('ë', 'ï') THEN '04' WHEN c = 'ç' THEN '05' ELSE '0' END), '') AS marks
  FROM tok WHERE word LIKE 'é%')
"""
_text("kwic_sort_collated", _ROWS, _ACCENTS, _hits("TRUE", 1, 5, 64, "corpus, strip_accents(lower(word)), marks, word, position", "accents"))
_ahead("kwic_sort_keyword", _ROWS, _hits("word = 'the' AND w1 IS NOT NULL", 2, 5, 64, "corpus, w1, position"))
_ahead("kwic_sort_attr", _ROWS, _hits("w1 = 'the' AND w2 IS NOT NULL", 3, 5, 64, "corpus, pos, p1, p2, position"))
for _within, _same, _at, _source in (
    ("text", SAME_TEXT, "off", "tok"),
    ("line", SAME_LINE, "off", "ltok"),
    ("unbounded", "a.corpus = b.corpus", "position", "tok"),
):
    for _side, _words, _end in (("left", "x.l1, x.l2, x.l3", ""), ("right", "x.r1, x.r2, x.r3", " + n.len - 1")):
        _text(
            f"kwic_sort_{_side}_{_within}",
            f"""
            SELECT row_number() OVER (ORDER BY n.corpus, {_words}, n.position) - 1 AS "row", n.corpus, n.position
            FROM nearest n JOIN around x ON n.corpus = x.corpus AND x.position = n.position{_end} QUALIFY "row" BETWEEN 5 AND 64""",
            LINES,
            _AROUND,
            _nearest(1, 6, _same, _at, _source),
        )
_text("kwic_sort_random", _ROWS, _hits("word = 'the'", 1, 5, 64, "corpus, md5(concat_ws('|', '42', corpus, text_id, off)), position", "tok"))
_text("kwic_page", _ROWS, _hits("word = 'the'", 1, 700, 899, source="tok"))
_text("kwic_page_by_hits", _ROWS, _hits("word = 'the'", 1, 700, 899, source="tok"))
_text("kwic_page_deep", _ROWS, _hits("TRUE", 1, 123_000, 123_499, source="tok"))
_text(
    "kwic_free_order",
    """
    , found AS (
      SELECT corpus, text_id, sent_no, string_agg(i, ' ' ORDER BY i) AS hits FROM tok WHERE word = 'the' OR word LIKE '%ing'
      GROUP BY corpus, text_id, sent_no HAVING count(*) FILTER (word = 'the') > 0 AND count(*) FILTER (word LIKE '%ing') > 0)
    SELECT row_number() OVER (ORDER BY corpus, text_id, sent_no) - 1 AS "row", * FROM found QUALIFY "row" < 50""",
)
_conversation(
    "kwic_aligned",
    """
    , hits AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS "row" FROM ctok WHERE role = 'user' AND cap QUALIFY "row" < 100)
    SELECT h."row", h.position, string_agg(t.word, ' ' ORDER BY t.off) AS aligned
    FROM hits h LEFT JOIN ctok t ON t.conv_id = h.conv_id AND t.turn = h.turn + 1 AND t.role = 'assistant' GROUP BY h."row", h.position""",
)
_conversation(
    "kwic_aligned_segments",
    """
    , hits AS (SELECT *, row_number() OVER (ORDER BY position) - 1 AS "row" FROM ctok WHERE role = 'user' AND cap QUALIFY "row" < 100)
    SELECT h."row", h.position, string_agg(t.word, ' ' ORDER BY t.position) AS aligned
    FROM hits h LEFT JOIN links l ON h.position BETWEEN l.first AND l.last
    LEFT JOIN ctok t ON t.role = 'assistant' AND t.position BETWEEN l.p_first AND l.p_last GROUP BY h."row", h.position""",
    LINKS,
)
_CONV_HITS = """
chits AS MATERIALIZED (
  SELECT *, 2 AS len, row_number() OVER (ORDER BY corpus, position) - 1 AS "row" FROM cnext WHERE cap AND not_low = FALSE QUALIFY "row" < {n})
"""
_conversation(
    "kwic_context_conversation",
    _LINE.replace("FROM hits h JOIN tok t", "FROM chits h JOIN ctok t").format(around="(t.conv_id = h.conv_id OR t.position BETWEEN h.position AND h.position + 1)"),
    _CONV_HITS.format(n=10),
)
_conversation(
    "kwic_open_close_regions",
    """
    , edges AS (
      SELECT *, i = 0 AS s1, i = max(i) OVER (PARTITION BY text_id, sent_no) AS s2,
             off = min(off) OVER (PARTITION BY text_id, line_no) AS l1, off = max(off) OVER (PARTITION BY text_id, line_no) AS l2,
             off = 0 AS t1, off = max(off) OVER (PARTITION BY text_id) AS t2,
             conv_id IS NOT NULL AND position = min(position) OVER (PARTITION BY role, conv_id) AS c1,
             conv_id IS NOT NULL AND position = max(position) OVER (PARTITION BY role, conv_id) AS c2 FROM ctok)
    SELECT h."row", e.corpus, e.i, e.word, e.i BETWEEN h.i AND h.i + 1 AS in_match,
           concat_ws(' ', CASE WHEN c1 THEN 'conversation' END, CASE WHEN t1 THEN 'text' END, CASE WHEN l1 THEN 'line' END, CASE WHEN s1 THEN 'sentence' END) AS "open",
           concat_ws(' ', CASE WHEN s2 THEN 'sentence' END, CASE WHEN l2 THEN 'line' END, CASE WHEN t2 THEN 'text' END, CASE WHEN c2 THEN 'conversation' END) AS "close"
    FROM chits h JOIN edges e ON e.text_id = h.text_id AND e.sent_no = h.sent_no""",
    _CONV_HITS.format(n=200),
)
_text("kwic_row_cap", " SELECT s.corpus, count(t.word) AS hits, count(t.word) > 100 AS refused FROM sizes s LEFT JOIN tok t ON s.corpus = t.corpus AND t.word = 'the' GROUP BY s.corpus")
_ahead(
    "kwic_sample",
    """
    , found AS (SELECT * FROM ahead WHERE word = 'the' AND w1 LIKE '%ing')
    SELECT corpus, position FROM found WHERE corpus = (SELECT corpus FROM found ORDER BY md5('7|' || corpus) LIMIT 1)
    ORDER BY md5(concat_ws('|', '7', corpus, text_id, off)) LIMIT 10""",
)

# --------------------------------------------------------------------------------------
# statistics

_ING = "word LIKE '%ing'"
_text("count_word", f" SELECT corpus, word, count(*) AS absolute FROM tok WHERE {_ING} GROUP BY ALL")
_text(
    "count_ngram",
    f"""
    , grams AS (
      SELECT a.corpus, a.position, string_agg(b.word, ' ' ORDER BY b.i) AS word
      FROM nearest a JOIN tok b ON {SAME} AND b.i BETWEEN a.i AND a.i + a.len - 1 GROUP BY a.corpus, a.position)
    SELECT corpus, word, count(*) AS absolute FROM grams GROUP BY corpus, word""",
    _nearest(1, 2),
)
_text("count_struct", f" SELECT corpus, text_lang, count(*) AS absolute FROM tok WHERE {_ING} GROUP BY ALL")
_THE_ANY = "word = 'the' AND w1 IS NOT NULL"
_ahead(
    "count_multi",
    f"""
    SELECT corpus, 'the ' || w1 AS word, 'LOW ' || p1 AS pos, text_lang, text_quality, count(*) AS absolute
    FROM ahead WHERE {_THE_ANY} GROUP BY ALL""",
)
_ahead(
    "count_ignore_case",
    " SELECT corpus, lower(word || ' ' || w1) AS word, count(*) AS absolute FROM ahead WHERE pos = 'CAP' AND w1 LIKE '%ing' GROUP BY ALL",
)
_ahead(
    "count_split",
    f"""
    SELECT corpus, 'the ' || v AS lex, count(*) AS absolute
    FROM (SELECT corpus, unnest(CASE WHEN len(lex1) = 0 THEN [''] ELSE lex1 END) AS v FROM ahead WHERE {_THE_ANY}) GROUP BY ALL""",
)
_text(
    "count_split_ngram",
    """
    , sets AS (SELECT *, CASE WHEN len(lex) = 0 THEN [''] ELSE lex END AS v FROM tok),
    four AS (SELECT *, lead(v, 1) OVER s AS v1, lead(v, 2) OVER s AS v2, lead(v, 3) OVER s AS v3 FROM sets WINDOW s AS (PARTITION BY corpus, text_id, sent_no ORDER BY i)),
    found AS (SELECT corpus, v, v1, v2, v3 FROM four WHERE word = 'the' AND v3 IS NOT NULL)
    SELECT corpus, concat_ws(' ', a, b, c, d) AS lex, count(*) AS absolute
    FROM found, unnest(v) AS q(a), unnest(v1) AS x(b), unnest(v2) AS y(c), unnest(v3) AS z(d) GROUP BY ALL""",
)
_ahead(
    "count_split_top",
    f" SELECT corpus, 'the ' || coalesce(lex1[1], '') AS lex, 'LOW ' || p1 AS pos, count(*) AS absolute FROM ahead WHERE {_THE_ANY} GROUP BY ALL",
)
_ahead(
    "count_set_text",
    f"""
    SELECT corpus, '|the| ' || CASE WHEN len(lex1) = 0 THEN '|' ELSE '|' || array_to_string(lex1, '|') || '|' END AS lex, count(*) AS absolute
    FROM ahead WHERE {_THE_ANY} GROUP BY ALL""",
)
_ahead(
    "count_strip_pointer",
    """
    SELECT corpus, lemma || ' ' || CASE p1 WHEN 'NUM' THEN '' ELSE lemma1 END AS sense, count(*) AS absolute
    FROM ahead WHERE pos = 'CAP' AND w1 IS NOT NULL GROUP BY ALL""",
)
_text(
    "count_relative",
    f"""
    SELECT corpus, word, count(*) AS absolute, round(count(*) / any_value(size) * 1000000.0, 6) AS relative
    FROM tok JOIN sizes USING (corpus) WHERE {_ING} GROUP BY corpus, word""",
)
_ahead(
    "count_combined",
    """
    SELECT 'the ' || w1 AS word, count(*) AS absolute, round(count(*) / (SELECT size FROM total) * 1000000.0, 6) AS relative
    FROM ahead WHERE word = 'the' AND regexp_full_match(w1, 'i.*ing') GROUP BY ALL""",
)
_text(
    "count_relative_to",
    f"""
    , part AS (SELECT corpus, text_lang, count(*) AS size FROM tok GROUP BY ALL)
    SELECT t.corpus, t.pos, t.text_lang, t.text_quality, count(*) AS absolute, round(count(*) / any_value(p.size) * 1000000.0, 6) AS relative
    FROM tok t JOIN part p ON p.corpus = t.corpus AND p.text_lang = t.text_lang WHERE {_ING} GROUP BY ALL""",
)
_text(
    "count_relative_to_combined",
    f"""
    , part AS (SELECT text_lang, text_quality, count(*) AS size FROM tok GROUP BY ALL)
    SELECT t.pos, t.text_lang, t.text_quality, count(*) AS absolute, round(count(*) / any_value(p.size) * 1000000.0, 6) AS relative
    FROM tok t JOIN part p ON p.text_lang = t.text_lang AND p.text_quality IS NOT DISTINCT FROM t.text_quality WHERE {_ING} GROUP BY ALL""",
)
_ahead(
    "count_sums",
    """
    , each AS (
      SELECT s.corpus, any_value(s.size) AS size, count(a.corpus) AS absolute FROM sizes s LEFT JOIN ahead a
        ON s.corpus = a.corpus AND a.pos = 'CAP' AND regexp_full_match(a.w1, 'th.*ing') GROUP BY s.corpus)
    SELECT corpus, absolute, round(absolute / size * 1000000.0, 6) AS relative FROM each
    UNION ALL SELECT NULL, CAST(sum(absolute) AS BIGINT), round(sum(absolute) / sum(size) * 1000000.0, 6) FROM each""",
)
_text(
    "count_statistics",
    f"""
    , hit AS (SELECT corpus, word FROM tok WHERE {_ING})
    SELECT 'corpus value' AS level, corpus, word, count(*) AS absolute, round(count(*) / any_value(size) * 1000000.0, 6) AS relative FROM hit JOIN sizes USING (corpus) GROUP BY corpus, word
    UNION ALL SELECT 'combined value', NULL, word, count(*), round(count(*) / (SELECT size FROM total) * 1000000.0, 6) FROM hit GROUP BY word
    UNION ALL SELECT 'corpus sum', corpus, NULL, count(*), round(count(*) / any_value(size) * 1000000.0, 6) FROM hit JOIN sizes USING (corpus) GROUP BY corpus
    UNION ALL SELECT 'combined sum', NULL, NULL, count(*), round(count(*) / (SELECT size FROM total) * 1000000.0, 6) FROM hit""",
)
_ahead("count_distinct_values", f' SELECT count(DISTINCT w1) AS "count" FROM ahead WHERE {_THE_ANY}')
_PAGE = f"""
counts AS (SELECT corpus, 'the ' || w1 AS word, count(*) AS absolute FROM ahead WHERE {_THE_ANY} GROUP BY ALL),
page AS (SELECT word, CAST(sum(absolute) AS BIGINT) AS absolute FROM counts GROUP BY word ORDER BY absolute DESC, word LIMIT 20 OFFSET 10)
"""
_ahead("count_page", " SELECT * FROM counts WHERE word IN (SELECT word FROM page)", _PAGE)
_ahead(
    "count_page_combined",
    " SELECT word, absolute, round(absolute / (SELECT size FROM total) * 1000000.0, 6) AS relative FROM page",
    _PAGE,
)
_ahead(
    "count_target",
    f"""
    , best AS (
      SELECT a.corpus, a.position, arg_min(b.word, b.i) AS word FROM tok a JOIN ahead b ON {SAME} AND b.i BETWEEN a.i + 1 AND a.i + 3
      WHERE a.word = 'the' AND b.pos = 'CAP' AND b.p1 = 'LOW' GROUP BY a.corpus, a.position)
    SELECT corpus, word, count(*) AS absolute FROM best GROUP BY corpus, word""",
)
_SUBQUERIES = f"""
main AS (
  SELECT 0 AS query_no, a.corpus, a.text_lang, a.position, string_agg(b.lemma, ' ' ORDER BY b.i) AS lemma
  FROM nearest a JOIN tok b ON {SAME} AND b.i BETWEEN a.i AND a.i + a.len - 1 GROUP BY a.corpus, a.text_lang, a.position),
caps AS (
  SELECT DISTINCT 1 AS query_no, b.corpus, b.text_lang, b.position, b.lemma
  FROM nearest a JOIN tok b ON {SAME} AND b.i BETWEEN a.i AND a.i + a.len - 1 WHERE b.pos = 'CAP'),
lows AS (
  SELECT DISTINCT 2 AS query_no, b.corpus, b.text_lang, b.position, b.lemma || ' ' || b.lemma1 AS lemma
  FROM nearest a JOIN ahead b ON {SAME} AND b.i BETWEEN a.i AND a.i + a.len - 2 WHERE b.pos = 'LOW' AND b.w1 LIKE '%ing'),
every AS (SELECT * FROM main UNION ALL SELECT * FROM caps UNION ALL SELECT * FROM lows)
"""
_ahead(
    "count_subqueries",
    " SELECT query_no, corpus, lemma, text_lang, count(*) AS absolute FROM every GROUP BY ALL",
    _nearest(1, 5),
    _SUBQUERIES,
)
_ahead(
    "count_subquery_sums",
    """
    , grid AS (SELECT corpus, size, q.no AS query_no FROM sizes, (SELECT unnest([0, 1, 2]) AS no) q),
    each AS (
      SELECT g.corpus, g.query_no, any_value(g.size) AS size, count(e.corpus) AS absolute
      FROM grid g LEFT JOIN every e ON g.corpus = e.corpus AND g.query_no = e.query_no GROUP BY g.corpus, g.query_no)
    SELECT corpus, query_no, absolute, round(absolute / size * 1000000.0, 6) AS relative FROM each
    UNION ALL SELECT NULL, query_no, CAST(sum(absolute) AS BIGINT), round(sum(absolute) / sum(size) * 1000000.0, 6) FROM each GROUP BY query_no""",
    _nearest(1, 5),
    _SUBQUERIES,
)
_ahead(
    "count_page_subqueries",
    """
    , totals AS (SELECT query_no, lemma, count(*) AS absolute FROM every GROUP BY ALL)
    SELECT query_no, lemma, absolute, round(absolute / (SELECT size FROM total) * 1000000.0, 6) AS relative FROM totals
    QUALIFY row_number() OVER (PARTITION BY query_no ORDER BY absolute DESC, lemma) <= 1500""",
    _nearest(1, 5),
    _SUBQUERIES,
)
_text(
    "count_subqueries_text",
    """
    , main AS (
      SELECT 0 AS query_no, a.corpus, a.text_lang, a.position, string_agg(b.lemma, ' ' ORDER BY b.off) AS lemma
      FROM nearest a JOIN tok b ON a.corpus = b.corpus AND a.text_id = b.text_id AND b.off BETWEEN a.off AND a.off + a.len - 1 GROUP BY a.corpus, a.text_lang, a.position),
    inside AS (
      SELECT DISTINCT b.corpus, b.text_lang, b.position, b.pos, b.lemma, b.lemma1, b.w1, max(b.off <= a.off + a.len - 2) AS two
      FROM nearest a JOIN next b ON a.corpus = b.corpus AND a.text_id = b.text_id AND b.off BETWEEN a.off AND a.off + a.len - 1 GROUP BY ALL),
    every AS (
      SELECT query_no, corpus, lemma, text_lang FROM main
      UNION ALL SELECT 1, corpus, lemma, text_lang FROM inside WHERE pos = 'CAP'
      UNION ALL SELECT 2, corpus, lemma || ' ' || lemma1, text_lang FROM inside WHERE two AND pos = 'LOW' AND w1 LIKE '%ing')
    SELECT query_no, corpus, lemma, text_lang, count(*) AS absolute FROM every GROUP BY ALL""",
    NEXT,
    _nearest(1, 10, SAME_TEXT, "off"),
)
_text(
    "count_union",
    r"""
    SELECT corpus, pos, text_lang, CAST(NULL AS VARCHAR) AS text_role, count(*) AS absolute FROM tok GROUP BY ALL
    UNION ALL
    SELECT corpus, CASE WHEN num THEN 'NUM' WHEN cap THEN 'CAP' ELSE 'LOW' END, NULL, role, count(*)
    FROM ctok GROUP BY ALL
    UNION ALL
    SELECT 'EVT', CASE WHEN value > 10 THEN 'POS' WHEN value < 10 THEN 'NEG' ELSE 'ZERO' END, NULL, NULL, count(*) FROM events GROUP BY ALL""",
    CONV_TOKENS,
)
_text("count_all", " SELECT corpus, lemma AS word, count(*) AS absolute FROM tok GROUP BY ALL")
_text("count_all_struct", " SELECT corpus, text_lang, text_toxic, count(*) AS absolute FROM tok GROUP BY ALL")

# --------------------------------------------------------------------------------------
# attribute values

_text("attr_values", " SELECT DISTINCT corpus, coalesce(text_quality, '') AS text_quality FROM tok")
_text("attr_values_count", ' SELECT corpus, coalesce(sense, \'\') AS sense, count(*) AS "count" FROM tok GROUP BY ALL')
_text("attr_values_split", ' SELECT corpus, lex, count(*) AS "count" FROM (SELECT corpus, unnest(lex) AS lex FROM tok) GROUP BY ALL')
_text(
    "attr_values_tree",
    ' SELECT corpus, text_lang, coalesce(text_quality, \'\') AS text_quality, pos, count(*) AS "count" FROM tok GROUP BY ALL',
)
_text("attr_values_combined", ' SELECT text_lang, pos, count(*) AS "count" FROM tok GROUP BY ALL')
_text("attr_values_combined_list", " SELECT DISTINCT text_lang, coalesce(text_toxic, '') AS text_toxic FROM tok")

# --------------------------------------------------------------------------------------
# time

ORDERS = """
texts AS MATERIALIZED (
  SELECT upper(o.o_orderpriority) AS corpus, o.o_orderkey AS text_id,
         CASE WHEN o.o_orderkey % 50 <> 0 THEN CAST(min(l.l_shipdate) AS TIMESTAMP) END AS df,
         CASE WHEN o.o_orderkey % 50 <> 0 THEN CAST(max(l.l_shipdate) AS TIMESTAMP) END AS dt, count(*) AS n
  FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey GROUP BY o.o_orderpriority, o.o_orderkey),
rings AS MATERIALIZED (
  SELECT t.corpus, t.df, t.dt, count(*) AS n
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN texts t ON t.text_id = l.l_orderkey
  WHERE p.p_name LIKE '% ring' AND l.l_returnflag = 'R' GROUP BY t.corpus, t.df, t.dt)
"""
EVENTS = """
texts AS MATERIALIZED (SELECT 'EVT' AS corpus, date_trunc('second', ts) AS df, date_trunc('second', ts) AS dt, count(*) AS n FROM events GROUP BY ALL),
errors AS MATERIALIZED (
  SELECT 'EVT' AS corpus, date_trunc('second', ts) AS df, date_trunc('second', ts) AS dt, count(*) AS n
  FROM events WHERE event_type = 'error' AND value > 10 GROUP BY ALL)
"""
_FORMAT = {"year": "%Y", "month": "%Y%m", "day": "%Y%m%d", "hour": "%Y%m%d%H", "minute": "%Y%m%d%H%M", "second": "%Y%m%d%H%M%S"}


def _steps(name: str, source: str, unit: str, strategy: int = 1, where: str = "TRUE", edge: str | None = None, by: str = "") -> str:
    """Elementary segments: at every point where something may change, the sum of what covers it."""
    small = "day" if unit in ("year", "month", "day") else "second"
    trunc = f"CAST(date_trunc('{unit}', {{}}) AS TIMESTAMP)"
    f, t = trunc.format("df"), trunc.format("dt")
    last = edge or f"dt = {t} + INTERVAL 1 {unit} - INTERVAL 1 {small}"
    g = f", {by}" if by else ""
    same = f"s.corpus = p.corpus{f' AND s.{by} = p.{by}' if by else ''}"
    if strategy == 1:
        spans = f"""
        SELECT corpus{g}, CASE WHEN {f} = {t} OR df = {f} THEN {f} ELSE {f} + INTERVAL 1 {unit} END AS f,
               CASE WHEN {f} = {t} OR {last} THEN {t} ELSE {t} - INTERVAL 1 {unit} END AS t, n
        FROM {source} WHERE df IS NOT NULL AND ({f} = {t} OR df < dt) AND {where}"""
    else:
        only = f"{f} = {t}" if strategy == 3 else "TRUE"
        spans = f"SELECT corpus{g}, {f} AS f, {t} AS t, n FROM {source} WHERE df IS NOT NULL AND {only} AND {where}"
    return f"""
    {name}_raw AS ({spans}),
    {name}_spans AS MATERIALIZED (SELECT corpus{g}, f, t, sum(n) AS n FROM {name}_raw GROUP BY ALL),
    {name}_points AS (SELECT corpus{g}, f AS bucket FROM {name}_spans UNION SELECT corpus{g}, t + INTERVAL 1 {unit} FROM {name}_spans),
    {name} AS MATERIALIZED (
      SELECT p.corpus{f', p.{by}' if by else ''}, strftime(p.bucket, '{_FORMAT[unit]}') AS "time", CAST(coalesce(sum(s.n), 0) AS BIGINT) AS n
      FROM {name}_points p LEFT JOIN {name}_spans s ON {same} AND s.f <= p.bucket AND p.bucket <= s.t GROUP BY p.corpus{f', p.{by}' if by else ''}, p.bucket
      UNION ALL SELECT corpus{g}, '', CAST(sum(n) AS BIGINT) FROM {source} WHERE df IS NULL AND {where} GROUP BY corpus{g})
    """


def _time(name: str, base: str, steps: str, select: str) -> None:
    ORACLE[name] = "WITH " + base + "," + steps + select


_TOKENS = ' SELECT corpus, "time", n AS tokens FROM steps'
_time("timespan_year", ORDERS, _steps("steps", "texts", "year"), _TOKENS)
_time("timespan_month", ORDERS, _steps("steps", "texts", "month"), _TOKENS)
_time("timespan_month_edge", ORDERS, _steps("steps", "texts", "month", edge="day(dt) = 31"), _TOKENS)
_time("timespan_day", ORDERS, _steps("steps", "texts", "day"), _TOKENS)
_time("timespan_hour", EVENTS, _steps("steps", "texts", "hour"), _TOKENS)
_time("timespan_minute", EVENTS, _steps("steps", "texts", "minute"), _TOKENS)
_time("timespan_second", EVENTS, _steps("steps", "texts", "second"), _TOKENS)
_time("timespan_s2", ORDERS, _steps("steps", "texts", "month", 2), _TOKENS)
_time("timespan_s3", ORDERS, _steps("steps", "texts", "year", 3), _TOKENS)


def _nested(lo: str, hi: str) -> str:
    return f"((df >= TIMESTAMP '{lo}' AND dt <= TIMESTAMP '{hi}') OR (df <= TIMESTAMP '{lo}' AND dt >= TIMESTAMP '{hi}'))"


_time("timespan_range", ORDERS, _steps("steps", "texts", "month", 1, _nested("1996-01-01 00:00:00", "1999-12-31 00:00:00")), _TOKENS)
_time(
    "timespan_range_s2",
    ORDERS,
    _steps("steps", "texts", "year", 2, "df <= TIMESTAMP '1998-06-30 00:00:00' AND dt >= TIMESTAMP '1997-01-01 00:00:00'"),
    _TOKENS,
)
_time("timespan_undated", ORDERS, _steps("steps", "texts", "year"), _TOKENS + " WHERE \"time\" = ''")
_ALL = "every AS (SELECT '' AS corpus, df, dt, n FROM texts),"
_time("timespan_combined", ORDERS, _ALL + _steps("steps", "every", "year"), _TOKENS)

ORACLE["timedata"] = f"WITH {ORDERS}" + """
    SELECT corpus, coalesce(strftime(df, '%Y%m%d%H%M%S'), '') AS datefrom, coalesce(strftime(dt, '%Y%m%d%H%M%S'), '') AS dateto,
           CAST(sum(n) AS BIGINT) AS tokens FROM texts GROUP BY ALL"""
ORACLE["timedata_date"] = f"WITH {ORDERS}" + """
    SELECT corpus, coalesce(strftime(df, '%Y%m%d'), '') AS datefrom, coalesce(strftime(dt, '%Y%m%d'), '') AS dateto,
           CAST(sum(n) AS BIGINT) AS tokens FROM texts GROUP BY ALL"""
ORACLE["timedata_seconds"] = f"WITH {EVENTS}" + """
    SELECT corpus, strftime(df, '%Y%m%d%H%M%S') AS datefrom, strftime(dt, '%Y%m%d%H%M%S') AS dateto, CAST(sum(n) AS BIGINT) AS tokens
    FROM texts GROUP BY ALL"""
ORACLE["corpus_info"] = f"WITH {ORDERS}" + """
    , places AS (SELECT upper(o_orderpriority) AS corpus, count(*) AS texts FROM orders GROUP BY ALL)
    SELECT corpus, CAST(sum(n) AS BIGINT) AS size, CAST(sum(n) AS BIGINT) AS sentences, any_value(p.texts) AS texts,
           strftime(min(df), '%Y-%m-%d %H:%M:%S') AS first_date, strftime(max(dt), '%Y-%m-%d %H:%M:%S') AS last_date
    FROM texts JOIN places p USING (corpus) GROUP BY corpus"""

ORACLE["count_time_refused"] = "WITH ends AS (SELECT min(ts) AS a, max(ts) AS b FROM events)" + " UNION ALL ".join(
    f" SELECT 'EVT' AS corpus, '{g}' AS granularity, b > a + INTERVAL 3600 {unit} AS refused FROM ends"
    for g, unit in (("y", "YEAR"), ("m", "MONTH"), ("d", "DAY"), ("h", "HOUR"), ("n", "MINUTE"), ("s", "SECOND"))
)

_TREND = """
    SELECT h.corpus, h."time", h.n AS absolute, round(h.n / t.n * 1000000.0, 6) AS relative
    FROM hits h JOIN steps t ON h.corpus = t.corpus AND h."time" = t."time" AND t.n > 0"""
_time("count_time", ORDERS, _steps("steps", "texts", "year", 2) + "," + _steps("hits", "rings", "year", 2), _TREND)
_time("count_time_month", ORDERS, _steps("steps", "texts", "month") + "," + _steps("hits", "rings", "month"), _TREND)
_time("count_time_hour", EVENTS, _steps("steps", "texts", "hour") + "," + _steps("hits", "errors", "hour"), _TREND)
_time(
    "count_time_marks",
    EVENTS,
    _steps("steps", "texts", "hour") + "," + _steps("hits", "errors", "hour"),
    f"""
    , trend AS ({_TREND}),
    flags AS (SELECT corpus, "time", n > 0 AS has, coalesce(lag(n > 0) OVER (PARTITION BY corpus ORDER BY "time"), FALSE) AS before FROM steps),
    marks AS (SELECT corpus, "time", CASE WHEN has THEN 0 END AS mark FROM flags WHERE has <> before)
    SELECT coalesce(t.corpus, m.corpus) AS corpus, coalesce(t."time", m."time") AS "time", coalesce(t.absolute, m.mark) AS absolute,
           coalesce(t.relative, CAST(m.mark AS DOUBLE)) AS relative
    FROM trend t FULL JOIN marks m ON t.corpus = m.corpus AND t."time" = m."time" """,
)
_time(
    "count_time_range",
    ORDERS,
    _steps("steps", "texts", "year", 1, _nested("1996-01-01 00:00:00", "1997-12-31 23:59:59")) + "," + _steps("hits", "rings", "year"),
    f"""
    , trend AS ({_TREND.replace('round(h.n / t.n * 1000000.0, 6)', 'h.n / t.n * 1000000.0')})
    SELECT c.corpus, CAST(coalesce(sum(t.absolute), 0) AS BIGINT) AS absolute, round(coalesce(sum(t.relative), 0), 6) AS relative
    FROM (SELECT DISTINCT corpus FROM texts) c LEFT JOIN trend t ON c.corpus = t.corpus GROUP BY c.corpus""",
)
_ALL_RINGS = _ALL + "all_rings AS (SELECT '' AS corpus, df, dt, n FROM rings),"
_ALL_STEPS = _ALL_RINGS + _steps("steps", "every", "year", 2) + "," + _steps("hits", "all_rings", "year", 2)
_time("count_time_combined", ORDERS, _ALL_STEPS, _TREND)
_time(
    "count_time_combined_sums",
    ORDERS,
    _ALL_STEPS,
    f"""
    , trend AS ({_TREND})
    SELECT CAST(sum(absolute) AS BIGINT) AS absolute, round(sum(absolute) / (SELECT sum(n) FROM texts) * 1000000.0, 6) AS relative FROM trend""",
)
_time(
    "count_time_subqueries",
    ORDERS,
    """
    named AS (
      SELECT t.corpus, t.df, t.dt, l.l_returnflag AS flag FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
      JOIN texts t ON t.text_id = l.l_orderkey WHERE p.p_name LIKE '% ring'),
    both_queries AS (
      SELECT 0 AS query_no, corpus, df, dt, count(*) AS n FROM named GROUP BY ALL
      UNION ALL SELECT 1, corpus, df, dt, count(*) FROM named WHERE flag = 'R' GROUP BY ALL),"""
    + _steps("steps", "texts", "year", 2)
    + ","
    + _steps("hits", "both_queries", "year", 2, by="query_no"),
    _TREND.replace("h.corpus, h.\"time\",", "h.corpus, h.query_no, h.\"time\",", 1),
)

# --------------------------------------------------------------------------------------
# comparison


def _compared(freqs: str) -> str:
    return f"""
    freqs AS ({freqs}),
    sums AS (SELECT CAST(sum(freq1) AS DOUBLE) AS t1, CAST(sum(freq2) AS DOUBLE) AS t2 FROM freqs),
    expected AS (SELECT *, (freq1 + freq2) * (t1 / (t1 + t2)) AS e1, (freq1 + freq2) * (t2 / (t1 + t2)) AS e2 FROM freqs, sums),
    scored AS (
      SELECT *, round(2 * (CASE WHEN freq1 > 0 THEN freq1 * ln(freq1 / e1) ELSE 0 END + CASE WHEN freq2 > 0 THEN freq2 * ln(freq2 / e2) ELSE 0 END), 2) AS ll,
             CASE WHEN freq1 > 0 AND (freq2 = 0 OR freq1 / t1 > freq2 / t2) THEN 1 ELSE 2 END AS side
      FROM expected)
    """


_SETS = _compared(
    f"""
    SELECT 'the ' || w1 AS word, 'LOW ' || p1 AS pos,
           count(*) FILTER (CAST(substr(corpus, 4) AS INT) % 2 = 0) AS freq1, count(*) FILTER (CAST(substr(corpus, 4) AS INT) % 2 = 1) AS freq2
    FROM ahead WHERE {_THE_ANY} GROUP BY ALL"""
)
_SIGNED = "side, CASE side WHEN 1 THEN -ll ELSE ll END AS loglike FROM scored"
_ahead("loglike", f" SELECT word, pos, freq1, freq2, {_SIGNED}", _SETS)
_ahead(
    "loglike_top",
    f" SELECT word, pos, freq1, freq2, {_SIGNED} QUALIFY row_number() OVER (PARTITION BY side ORDER BY abs(ll) DESC, pos DESC, word DESC) <= 15",
    _SETS,
)
_ahead(
    "loglike_top_many",
    f" SELECT word, pos, freq1, freq2, {_SIGNED} QUALIFY row_number() OVER (PARTITION BY side ORDER BY abs(ll) DESC, pos DESC, word DESC) <= 1500",
    _SETS,
)
_ahead("loglike_average", " SELECT round(avg(ll), 2) AS average FROM scored", _SETS)
_ahead(
    "loglike_two_queries",
    f" SELECT pos, text_lang, freq1, freq2, {_SIGNED}",
    _compared(
        f"""
        SELECT pos || ' ' || p1 AS pos, text_lang, count(*) FILTER (word = 'the') AS freq1, count(*) FILTER (word LIKE '%ing') AS freq2
        FROM ahead WHERE w1 IS NOT NULL AND (word = 'the' OR {_ING}) GROUP BY ALL"""
    ),
)

# --------------------------------------------------------------------------------------
# word picture


def _picture(lemgram: bool, least: int = 0) -> str:
    one = "bfhead AND bfdep" if lemgram else "wfhead"
    two = "bfhead AND bfdep" if lemgram else "wfdep"
    h1, d2 = ("hb", "db") if lemgram else ("hw", "dw")
    return f"""
    found AS MATERIALIZED (
      SELECT 1 AS side, * FROM triples WHERE head = 'the' AND {one} AND freq >= {least}
      UNION ALL SELECT 2, * FROM triples WHERE dep = 'the' AND {two} AND freq >= {least}),
    f_rel AS (SELECT rel, sum(f) AS f_rel FROM (SELECT corpus, rel, count(*) AS f FROM pairs GROUP BY ALL) JOIN (SELECT DISTINCT corpus, rel FROM found) USING (corpus, rel) GROUP BY rel),
    head_freq AS (
      SELECT 1 AS side, corpus, rel, {h1} AS head, headpos, count(*) AS f FROM pairs GROUP BY ALL
      UNION ALL SELECT 2, corpus, rel, hb, headpos, count(*) FROM pairs GROUP BY ALL),
    dep_freq AS (
      SELECT 1 AS side, corpus, rel, db AS dep, deppos, count(*) AS f FROM pairs GROUP BY ALL
      UNION ALL SELECT 2, corpus, rel, {d2}, deppos, count(*) FROM pairs GROUP BY ALL),
    f_head AS (
      SELECT rel, head, headpos, sum(f) AS f_head FROM head_freq
      JOIN (SELECT corpus, rel, head, headpos, max(side) AS side FROM found GROUP BY ALL) USING (side, corpus, rel, head, headpos) GROUP BY ALL),
    f_dep AS (
      SELECT rel, dep, deppos, sum(f) AS f_dep FROM dep_freq
      JOIN (SELECT corpus, rel, dep, deppos, max(side) AS side FROM found GROUP BY ALL) USING (side, corpus, rel, dep, deppos) GROUP BY ALL),
    merged AS (
      SELECT head, headpos, rel, dep, deppos, '' AS depextra, CAST(sum(freq) AS BIGINT) AS freq,
             count(DISTINCT (corpus, bfhead, bfdep, wfhead, wfdep)) AS n_sources
      FROM found GROUP BY ALL),
    picture AS MATERIALIZED (
      SELECT m.*, freq * log2(CAST(f_rel AS DOUBLE) * freq / (CAST(f_head AS DOUBLE) * f_dep)) AS raw_mi
      FROM merged m JOIN f_rel USING (rel) JOIN f_head USING (rel, head, headpos) JOIN f_dep USING (rel, dep, deppos))
    """


_TRIPLE = "head, headpos, rel, dep, deppos, depextra, freq"
_SCORED = f" SELECT {_TRIPLE}, round(raw_mi, 6) AS mi FROM picture"
_TIES = "head, headpos, dep, deppos, depextra"
_text("relations", f" SELECT {_TRIPLE}, n_sources FROM picture", PAIRS, _picture(False))
_text("relations_lemgram", _SCORED, PAIRS, _picture(True))
_text("relations_min", _SCORED, PAIRS, _picture(False, 3))
_text("relations_mi", _SCORED, PAIRS, _picture(False))
_text(
    "relations_top",
    _SCORED + f" QUALIFY row_number() OVER (PARTITION BY rel, head = 'the' ORDER BY round(raw_mi, 9) DESC, {_TIES}) <= 15",
    PAIRS,
    _picture(True),
)
_text(
    "relations_top_freq",
    _SCORED + f" QUALIFY row_number() OVER (PARTITION BY rel ORDER BY freq DESC, {_TIES}) <= 10",
    PAIRS,
    _picture(False),
)
_PLACES = """
places AS (SELECT corpus, text_id, sent_no, "start", "end" FROM pairs WHERE hb = 'the' AND db IN ('of', 'and') AND rel = 'R1')
"""
_text("relation_sentences", " SELECT * FROM places", PAIRS, _PLACES)
_text("relation_sentence_hits", " SELECT corpus, count(*) AS hits FROM places GROUP BY corpus", PAIRS, _PLACES)
_text(
    "relation_kwic",
    """
    , page AS (SELECT * FROM places ORDER BY corpus, text_id, sent_no, "start", "end" LIMIT 50 OFFSET 10)
    SELECT p.corpus, p.text_id, p.sent_no, least(p."start", p."end") - 1 AS match_start, greatest(p."start", p."end") AS match_end,
           array_to_string(s.words, ' ') AS line, array_to_string(s.words[least(p."start", p."end"):greatest(p."start", p."end")], ' ') AS "match"
    FROM page p JOIN sents s ON s.corpus = p.corpus AND s.text_id = p.text_id AND s.sent_no = p.sent_no""",
    PAIRS,
    _PLACES,
)
