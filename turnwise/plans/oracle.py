"""The registered queries as SQL for DuckDB, over the same tables and written independently.

Conversational results are computed the long way round here: all pairs of windows' terms, all pairs
of turns.
"""

from __future__ import annotations

from turnwise.plans.catalog import DIGITS, KEY_TERMS, KEYWORDS, SENTENCE_WINDOW, STOP_WORDS

ORACLE: dict[str, str] = {}

STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
# DuckDB's \b knows ASCII letters only: turn all other letters into one before searching.
ASCII = r"regexp_replace({0}, '[^\x00-\x7F\p{{P}}\p{{S}}\p{{Z}}\p{{C}}]', 'z', 'g')"


def rnd(expression: str, name: str) -> str:
    return f"round({expression}, {DIGITS}) + 0.0 AS {name}"


# ---------------------------------------------------------------- sources and preparation

LINES = """lines AS (
  SELECT doc_id AS text_id, i AS line_no, parts[i + 1] AS text
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), unnest(range(len(parts))) u(i))"""
ROWS = """rows_ AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS "row" FROM documents)"""
PLAIN = f"SELECT text_id, line_no, {STRIP.format('text')} AS text FROM lines"

ORACLE["load_csv"] = "SELECT doc_id, text, lang, source FROM documents"
ORACLE["load_dataframe"] = "SELECT doc_id AS text_id, text, lang FROM documents"
ORACLE["load_plain_lines"] = f"WITH {LINES} SELECT * FROM ({PLAIN}) WHERE length(text) > 1"
ORACLE["load_text_files"] = f"""WITH {LINES}
SELECT text, count(*) AS n FROM ({PLAIN}) WHERE length(text) > 1 GROUP BY text"""
ORACLE["load_text_files_numbering"] = f"""WITH {LINES}
SELECT count(*) AS n_lines, count(*) AS n_row_numbers, count(*) AS n_expected
FROM ({PLAIN}) WHERE length(text) > 1"""
KEYED = f"""SELECT text_id, line_no, substring(text, instr(text, ',') + 1) AS text,
  split_part(text, ',', 1) AS key FROM ({PLAIN}) WHERE contains(text, ',')"""
ORACLE["load_keyed_lines"] = f"WITH {LINES} {KEYED}"
ORACLE["load_keyed_files"] = f"""WITH {LINES}
SELECT key, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM ({KEYED}) GROUP BY key"""
ORACLE["load_encoding_fallback"] = ORACLE["load_text_files"]
ORACLE["load_text_files_order"] = f"""WITH {LINES}
SELECT row_number() OVER (ORDER BY text_id, line_no) - 1 AS "row", text FROM ({PLAIN}) WHERE length(text) > 1"""
ORACLE["column_display_width"] = " UNION ALL ".join(
    f"""SELECT '{c}' AS column_name,
  CAST(least(greatest(max(length(CAST({c} AS VARCHAR))), {len(c)}), 100) AS BIGINT) AS width FROM documents"""
    for c in ("doc_id", "text", "lang", "source", "n_chars")
)
ORACLE["prepare_texts"] = f"""
SELECT doc_id AS text_id, lang, text, array_to_string({WORDS.format('text')}, ' ') AS tokens FROM documents"""
ORACLE["assign_text_id"] = """
SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS text_id FROM documents"""
ORACLE["assign_text_id_sparse"] = """
SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS text_id FROM documents"""
ORACLE["prepare_turns"] = """
SELECT conv_id, t AS turn, t AS text_id, role AS speaker, text
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS t FROM conversations)"""
ORACLE["chunk_rows"] = f"""WITH {ROWS} SELECT doc_id, "row", "row" // 7 AS chunk FROM rows_"""
TAGGED = """SELECT "row", "row" // 5 AS chunk, CAST("row" AS VARCHAR) || '--' || text AS text FROM rows_"""
ORACLE["tag_rows"] = f"""WITH {ROWS} SELECT "row", text FROM ({TAGGED})"""
CHUNKS = f"""chunks AS (
  SELECT chunk, string_agg(text, '' ORDER BY "row") AS text FROM ({TAGGED}) GROUP BY chunk)"""
ORACLE["chunk_concat"] = f"WITH {ROWS}, {CHUNKS} SELECT chunk, text FROM chunks"
ORACLE["largest_text_length"] = f"""WITH {ROWS}, {CHUNKS}
SELECT max(length(text)) AS largest_text_length FROM chunks"""
ORACLE["metadata_columns"] = "SELECT doc_id, text, lang, source, n_chars FROM documents"
ORACLE["stacked_chunks"] = """
SELECT doc_id AS text_id, text, lang FROM documents
UNION ALL SELECT item_id, text, NULL FROM benchmark"""


# ---------------------------------------------------------------- concordance


def hits(pattern: str, source: str, key: str, masked: bool = False) -> str:
    """CTE ``hits(<key>, text, match_no, n_found, st, len)``: position of every match."""
    searched = ASCII.format("text") if masked else "text"
    return f"""cut AS (
  SELECT {key}, text, string_split_regex(m, '{pattern}') AS ps, regexp_extract_all(m, '{pattern}') AS ms
  FROM (SELECT {key}, text, {searched} AS m FROM {source}) WHERE regexp_matches(m, '{pattern}')),
hits AS (
  SELECT {key}, text, i AS match_no, length(ms[i + 1]) AS len,
    CAST(list_sum(list_transform(ps[1:i + 1], lambda x: length(x)))
      + coalesce(list_sum(list_transform(ms[1:i], lambda x: length(x))), 0) AS BIGINT) AS st
  FROM cut, unnest(range(len(ms))) u(i))"""


def contexts(width: int) -> str:
    return f"""substring(text, greatest(st - {width}, 0) + 1, least({width}, st)) AS left_context,
  substring(text, st + 1, len) AS match, substring(text, st + len + 1, {width}) AS right_context"""


DOCS = "(SELECT doc_id AS text_id, text FROM documents)"


def found(pattern: str, width: int = 50, masked: bool = False) -> str:
    return f"WITH {hits(pattern, DOCS, 'text_id', masked)} SELECT text_id, match_no, {contexts(width)} FROM hits"


THE = r"(?i)\bthe\b"
ORACLE["kwic_literal"] = found("(?i)tion")
ORACLE["kwic_regex"] = found("(?i)[aeiou]{2}n")
ORACLE["kwic_regex_words"] = found(r"(?i)[\p{L}\p{N}_]+ing", 20)
ORACLE["kwic_case_sensitive"] = found("The")
ORACLE["kwic_whole_word"] = found(THE, masked=True)
ORACLE["context_window"] = found("(?i)tion", 500)
ORACLE["export_results"] = found("(?i)tion", 20)
# A pattern that may match nothing matches at every position that is not inside a run of x, and each run.
ORACLE["kwic_regex_empty_match"] = """
SELECT doc_id AS text_id,
  length(regexp_replace(text, '(?i)x+', '', 'g')) + 1
    + len(regexp_extract_all(text, '(?i)x+')) AS n,
  length(text) - length(regexp_replace(text, '(?i)x+', '', 'g')) AS n_chars
FROM documents"""
LINE_TABLE = f"""tagged AS (SELECT "row", chunk, text AS line FROM ({TAGGED})),
bare AS (SELECT "row", "row" // 5 AS chunk, text AS line FROM rows_),
offsets_tagged AS (SELECT "row", chunk,
  sum(length(line)) OVER (PARTITION BY chunk ORDER BY "row") - length(line) AS pos FROM tagged),
offsets_bare AS (SELECT "row", chunk,
  sum(length(line)) OVER (PARTITION BY chunk ORDER BY "row") - length(line) AS pos FROM bare),
bare_chunks AS (SELECT chunk, string_agg(line, '' ORDER BY "row") AS text FROM bare GROUP BY chunk)"""


def located(offsets: str) -> str:
    """CTE ``placed``: hits of chunks with the row they start in."""
    return f"""placed AS (
  SELECT h.*, o."row" FROM hits h JOIN (
    SELECT *, lead(pos) OVER (PARTITION BY chunk ORDER BY "row") AS until FROM {offsets}) o
  ON o.chunk = h.chunk AND h.st >= o.pos AND (o.until IS NULL OR h.st < o.until))"""


UNTAG = r"regexp_replace({0}, '[0-9]+--', '', 'g')"
ORACLE["kwic_chunked"] = f"""WITH {ROWS}, {CHUNKS}, {LINE_TABLE},
{hits(THE, 'chunks', 'chunk', masked=True)}, {located('offsets_tagged')}
SELECT chunk, match_no, {UNTAG.format('left_context')} AS left_context, match,
  {UNTAG.format('right_context')} AS right_context, "row" AS text_id
FROM (SELECT chunk, match_no, "row", {contexts(50)} FROM placed)"""
ORACLE["match_source_row"] = f"""WITH {ROWS}, {LINE_TABLE},
{hits('(?i)tion', 'bare_chunks', 'chunk')}, {located('offsets_bare')}
SELECT chunk, match_no, st AS start, "row" FROM placed"""
ORACLE["kwic_with_metadata"] = f"""WITH {ROWS}, {CHUNKS}, {LINE_TABLE},
{hits(THE, 'chunks', 'chunk', masked=True)}, {located('offsets_tagged')}
SELECT p.chunk, match_no, p."row", p."row" AS text_id, substring(p.text, st + 1, len) AS match, r.lang, l.quality
FROM placed p LEFT JOIN rows_ r ON r."row" = p."row" LEFT JOIN labels l ON l.doc_id = r.doc_id"""
ORACLE["dedup_metadata"] = "SELECT DISTINCT lang, source FROM documents"
ORACLE["kwic_sort_text_id"] = f"""
SELECT *, row_number() OVER (ORDER BY text_id, match_no) - 1 AS position FROM ({found(THE, 20, masked=True)})"""
LEFT_WORDS = rf"list_reverse(string_split_regex(lower({STRIP.format('left_context')}), '\s'))"
RIGHT_KEY = f"lower({STRIP.format('right_context')})"
ORACLE["kwic_sort_left"] = f"""
SELECT row_number() OVER (ORDER BY {LEFT_WORDS}, text_id, match_no) - 1 AS position, text_id, match_no, left_context, array_to_string({LEFT_WORDS}, '|') AS sort_key
FROM ({found(THE, 20, masked=True)})"""
ORACLE["kwic_sort_right"] = f"""
SELECT row_number() OVER (ORDER BY {RIGHT_KEY}, text_id, match_no) - 1 AS position, text_id, match_no, right_context, {RIGHT_KEY} AS sort_key FROM ({found(THE, 20, masked=True)})"""
ORACLE["strip_row_tags"] = f"""WITH {ROWS} SELECT "row", {UNTAG.format('text')} AS text FROM ({TAGGED})"""
COUNTS = rf"""SELECT text_id, n AS n_matches FROM (
  SELECT doc_id AS text_id, len(regexp_extract_all({ASCII.format('text')}, '{THE}')) AS n FROM documents)
WHERE n > 0"""
ORACLE["kwic_count"] = COUNTS
ORACLE["kwic_total_pages"] = f"""
SELECT CAST(sum(n_matches) AS BIGINT) AS n_results,
  CAST(greatest(ceil(sum(n_matches) / 20), 1) AS BIGINT) AS n_pages FROM ({COUNTS})"""
ORACLE["kwic_page"] = f"""SELECT * FROM ({found(THE, masked=True)})
ORDER BY {RIGHT_KEY}, text_id, match_no LIMIT 20 OFFSET 40"""
ORACLE["kwic_page_left"] = f"""SELECT * FROM ({found(THE, masked=True)})
ORDER BY {LEFT_WORDS}, text_id, match_no LIMIT 50 OFFSET 50"""
ORACLE["kwic_page_far"] = f"""
SELECT *, row_number() OVER (ORDER BY {RIGHT_KEY}, text_id, match_no) - 1 AS position FROM (
  SELECT * FROM ({found("(?i)e", 20)}) ORDER BY {RIGHT_KEY}, text_id, match_no LIMIT 20 OFFSET 39980)"""


def around(word: str, n: int) -> str:
    return f"""WITH {LINES}
SELECT text_id, line_no, before, line, after FROM (
  SELECT text_id, line_no, text AS line,
    coalesce(string_agg(text, chr(10)) OVER (PARTITION BY text_id ORDER BY line_no
      ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING), '') AS before,
    coalesce(string_agg(text, chr(10)) OVER (PARTITION BY text_id ORDER BY line_no
      ROWS BETWEEN 1 FOLLOWING AND {n} FOLLOWING), '') AS after
  FROM lines) WHERE contains(line, '{word}')"""


ORACLE["line_context"] = around("the", 2)
ORACLE["line_context_rare"] = around("license", 3)
ORACLE["kwic_many"] = " UNION ALL ".join(
    rf"SELECT text_id, '{k}' AS keyword, match_no, left_context, match, right_context"
    rf" FROM ({found(rf'(?i)\b{k}\b', 20, masked=True)})"
    for k in KEYWORDS
)
ORACLE["kwic_many_thousands"] = f"""
SELECT keyword, count(*) AS n, count(DISTINCT text_id) AS n_texts FROM (
  SELECT doc_id AS text_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS keyword FROM documents)
WHERE keyword IN (
  SELECT a || b || c || d FROM unnest({list('etaoinsrhl')}) w(a), unnest({list('etaoinsrhl')}) x(b),
    unnest({['', *'etaoi']}) y(c), unnest({['', *'etaoinsr']}) z(d)) GROUP BY keyword"""
ORACLE["kwic_many_regex"] = f"""
SELECT 'x*' AS keyword, * FROM ({ORACLE["kwic_regex_empty_match"]})
UNION ALL
SELECT '[aeiou]{{2}}n' AS keyword, text_id, count(*) AS n, CAST(sum(length(match)) AS BIGINT) AS n_chars
FROM ({found("(?i)[aeiou]{2}n", 5)}) GROUP BY text_id"""


# ---------------------------------------------------------------- tokens, terms, descriptors


def term_rows(words: str = "text", stop: str = STOP, table: str = "conversations", keys: str = "conv_id, turn") -> str:
    return f"""(SELECT * FROM (SELECT {keys}, unnest({WORDS.format(words)}) AS term FROM {table})
  WHERE term NOT IN ({stop}))"""


ORACLE["tokenize"] = f"""
SELECT term, count(*) AS n FROM (SELECT unnest({WORDS.format('text')}) AS term FROM documents) GROUP BY term"""
MARKS = r"regexp_extract_all(text, '[\p{L}\p{N}]+|[^\s\p{L}\p{N}]')"
ORACLE["token_counts"] = f"SELECT conv_id, turn, len({MARKS}) AS n_words FROM conversations"
ORACLE["filter_tokens"] = f"""
SELECT conv_id, turn, array_to_string(
  list_filter({WORDS.format('text')}, lambda w: w NOT IN ({STOP})), ' ') AS tokens FROM conversations"""
ORACLE["add_stopword"] = f"""
SELECT conv_id, term, count(*) AS frequency FROM {term_rows(stop=STOP + ", 'th', 'tion'")} GROUP BY ALL"""
SENTENCES = "regexp_extract_all(text, '[^.!?]+[.!?]*')"
ORACLE["split_sentences"] = f"""
SELECT conv_id, turn, i AS n, ss[i + 1] AS sentence
FROM (SELECT conv_id, turn, {SENTENCES} AS ss FROM conversations), unnest(range(len(ss))) u(i)"""
ORACLE["term_freq_overall"] = f"""
SELECT conv_id, term, count(*) AS frequency FROM {term_rows()} GROUP BY ALL"""
ORACLE["term_freq_turns"] = f"""
SELECT conv_id, term, count(DISTINCT turn) AS frequency FROM {term_rows()} GROUP BY ALL"""
ORACLE["all_terms"] = f"SELECT DISTINCT conv_id, term FROM {term_rows()}"
ORACLE["top_terms"] = f"""
SELECT conv_id, term, frequency, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY frequency DESC, term) AS rank
  FROM ({ORACLE['term_freq_overall']})) WHERE rank <= 10"""
ORACLE["top_terms_by_source"] = f"""
SELECT source, term, frequency, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY frequency DESC, term) AS rank
  FROM (SELECT source, term, count(*) AS frequency
    FROM {term_rows(table='documents', keys='source')} GROUP BY ALL)) WHERE rank <= 25"""
ORACLE["key_terms"] = f"""
SELECT conv_id, term FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY frequency DESC, term) AS rank
  FROM ({ORACLE['term_freq_turns']})) WHERE rank <= {KEY_TERMS}"""
ORACLE["doc_term"] = f"SELECT DISTINCT conv_id, turn, term FROM {term_rows()}"
ORACLE["n_utterances"] = "SELECT conv_id, count(*) AS n_utterances FROM conversations GROUP BY conv_id"
ORACLE["n_speakers"] = "SELECT conv_id, count(DISTINCT role) AS n_speakers FROM conversations GROUP BY conv_id"
ORACLE["speaker_names"] = """
SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY first_turn) - 1 AS position
FROM (SELECT conv_id, role AS speaker, min(turn) AS first_turn FROM conversations GROUP BY ALL)"""

# ---------------------------------------------------------------- concept model

WINDOWS = f"""sent AS (
  SELECT conv_id, turn, CASE WHEN len(ss) = 0 THEN [''] ELSE ss END AS ss
  FROM (SELECT conv_id, turn, {SENTENCES} AS ss FROM conversations)),
win AS (
  SELECT conv_id, turn, i AS window_no, ss[i + 1:i + {SENTENCE_WINDOW}] AS ws
  FROM sent, unnest(range(greatest(len(ss) - {SENTENCE_WINDOW - 1}, 1))) u(i))"""
CHAIN = f"""{WINDOWS},
wt AS (
  SELECT DISTINCT conv_id, turn, window_no, term
  FROM (SELECT conv_id, turn, window_no, unnest({WORDS.format("array_to_string(ws, ' ')")}) AS term FROM win)
  WHERE term NOT IN ({STOP})),
total AS (SELECT conv_id, count(*) AS n FROM win GROUP BY conv_id),
occ AS (SELECT conv_id, term, count(*) AS o, count(DISTINCT turn) AS nt FROM wt GROUP BY ALL),
kt AS (
  SELECT conv_id, term FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY nt DESC, term) AS r FROM occ)
  WHERE r <= {KEY_TERMS}),
dt AS (SELECT DISTINCT conv_id, turn, term FROM wt),
cooc AS (
  SELECT a.conv_id, a.term AS ti, b.term AS tj, count(*) AS c
  FROM wt a JOIN wt b ON a.conv_id = b.conv_id AND a.turn = b.turn AND a.window_no = b.window_no
  WHERE a.term <> b.term GROUP BY ALL),
cells AS (
  SELECT cooc.conv_id, ti, tj, c, a.o - c AS i_not_j, b.o - c AS not_i_j, n - (a.o + b.o - c) AS neither, n
  FROM cooc JOIN total ON total.conv_id = cooc.conv_id
  JOIN occ a ON a.conv_id = cooc.conv_id AND a.term = ti
  JOIN occ b ON b.conv_id = cooc.conv_id AND b.term = tj),
tsim AS (
  SELECT conv_id, ti, tj,
    (c / n) * (CASE WHEN neither = 0 THEN 1.0::DOUBLE ELSE neither / n END)
    / ((CASE WHEN not_i_j = 0 THEN 1.0::DOUBLE ELSE not_i_j / n END)
      * (CASE WHEN i_not_j = 0 THEN 1.0::DOUBLE ELSE i_not_j / n END)) AS s
  FROM cells)"""


def vector_chain(keys: str) -> str:
    """Unit vectors ``u(conv_id, turn, k, x)`` over the given key terms, and pair similarities ``sim``."""
    return f"""v AS (
  SELECT dt.conv_id, dt.turn, tsim.ti AS k, sum(s) AS x
  FROM dt JOIN tsim ON tsim.conv_id = dt.conv_id AND tsim.tj = dt.term
  JOIN {keys} kk ON kk.conv_id = dt.conv_id AND kk.term = tsim.ti GROUP BY ALL),
{UNITS}"""


UNITS = """u AS (
  SELECT conv_id, turn, k, x / sqrt(sum(x * x) OVER (PARTITION BY conv_id, turn)) AS x FROM v),
sim AS (
  SELECT a.conv_id, a.turn AS i, b.turn AS j, sum(a.x * b.x) AS s
  FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.k = b.k AND a.turn < b.turn GROUP BY ALL)"""
MODEL = f"{CHAIN}, {vector_chain('kt')}"

ORACLE["sentence_windows"] = f"""WITH {WINDOWS}
SELECT conv_id, turn, window_no, array_to_string(ws, '|') AS sentences FROM win"""
ORACLE["total_windows"] = f"WITH {CHAIN} SELECT conv_id, n AS n_windows FROM total"
ORACLE["term_occurrence"] = f"WITH {CHAIN} SELECT conv_id, term, o AS occurrence FROM occ"
ORACLE["term_cooccurrence"] = f"WITH {CHAIN} SELECT conv_id, ti AS term_i, tj AS term_j, c AS n FROM cooc"
ORACLE["term_contingency"] = f"""WITH {CHAIN}
SELECT conv_id, ti AS term_i, tj AS term_j, c AS i_j, i_not_j, not_i_j, neither AS not_i_not_j FROM cells"""
ORACLE["term_similarity_concept"] = f"""WITH {CHAIN}
SELECT conv_id, ti AS term_i, tj AS term_j, {rnd('s', 'similarity')} FROM tsim"""
ORACLE["concept_vectors"] = f"WITH {MODEL} SELECT conv_id, turn, k AS term, {rnd('x', 'value')} FROM v"
PAIRS = f"SELECT conv_id, i AS row_turn, j AS col_turn, {rnd('s', 'similarity')} FROM sim"
ORACLE["similarity_concept"] = f"WITH {MODEL} {PAIRS}"
ORACLE["similarity_concept_all_terms"] = f"""WITH {CHAIN}, {vector_chain('occ')} {PAIRS}"""
ORACLE["term_overlap"] = f"""WITH {CHAIN}, kd AS (SELECT dt.* FROM dt JOIN kt USING (conv_id, term))
SELECT a.conv_id, a.turn AS row_turn, b.turn AS col_turn, count(*) AS n_terms
FROM kd a JOIN kd b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL"""
COMMON = """common AS (
  SELECT conv_id, i, j, string_agg(k, ', ' ORDER BY r) AS concepts FROM (
    SELECT *, row_number() OVER (PARTITION BY conv_id, i, j ORDER BY round(p, 9) DESC, k) AS r FROM (
      SELECT a.conv_id, a.turn AS i, b.turn AS j, a.k, a.x * b.x AS p
      FROM u a JOIN u b ON a.conv_id = b.conv_id AND a.k = b.k AND a.turn < b.turn
      WHERE a.x * b.x > 0)) WHERE r <= 5 GROUP BY ALL)"""
ORACLE["common_concepts"] = f"""WITH {MODEL}, {COMMON}
SELECT conv_id, i AS row_turn, j AS col_turn, concepts FROM common"""
ORACLE["term_overlap_all_terms"] = f"""WITH {CHAIN}
SELECT a.conv_id, a.turn AS row_turn, b.turn AS col_turn, count(*) AS n_terms
FROM dt a JOIN dt b ON a.conv_id = b.conv_id AND a.term = b.term AND a.turn < b.turn GROUP BY ALL"""
ORACLE["common_concepts_all_terms"] = f"""WITH {CHAIN}, {vector_chain('occ')}, {COMMON}
SELECT conv_id, i AS row_turn, j AS col_turn, concepts FROM common"""

# ---------------------------------------------------------------- vector models

VECTORS = f"""wv AS (
  SELECT term, CAST(embedding AS DOUBLE[]) AS vec FROM (
    SELECT DISTINCT unnest({WORDS.format('text')}) AS term FROM conversations) w
  JOIN embeddings e ON e.vec_id
    = CAST('0x' || substr(md5(term), 1, 6) AS BIGINT) % (SELECT max(vec_id) + 1 FROM embeddings)),
vs AS (
  SELECT DISTINCT kt.conv_id, kt.term AS ti, occ.term AS tj, list_cosine_similarity(a.vec, b.vec) AS s
  FROM kt JOIN occ ON occ.conv_id = kt.conv_id JOIN wv a ON a.term = kt.term JOIN wv b ON b.term = occ.term),
v AS (
  SELECT dt.conv_id, dt.turn, vs.ti AS k, sum(s) AS x
  FROM dt JOIN vs ON vs.conv_id = dt.conv_id AND vs.tj = dt.term GROUP BY ALL),
{UNITS}"""
ORACLE["term_similarity_vector"] = f"""WITH {CHAIN}, {VECTORS}
SELECT conv_id, ti AS key, tj AS term, {rnd('s', 'similarity')} FROM vs"""
ORACLE["feature_vectors"] = f"""WITH {CHAIN}, {VECTORS}
SELECT conv_id, turn, k AS term, {rnd('x', 'value')} FROM v"""
ORACLE["similarity_vector"] = f"WITH {CHAIN}, {VECTORS} {PAIRS}"
ALL_VECTORS = VECTORS.replace("FROM kt JOIN occ ON occ.conv_id = kt.conv_id", "FROM occ kt JOIN occ ON occ.conv_id = kt.conv_id")
ORACLE["feature_vectors_all_terms"] = f"""WITH {CHAIN}, {ALL_VECTORS}
SELECT conv_id, turn, k AS term, {rnd('x', 'value')} FROM v"""
ORACLE["similarity_vector_all_terms"] = f"WITH {CHAIN}, {ALL_VECTORS} {PAIRS}"
ORACLE["similarity_mean_vector"] = f"""WITH {CHAIN}, {VECTORS},
long AS (
  SELECT conv_id, turn, d, avg(vec[d + 1]) AS m
  FROM (SELECT conv_id, turn, unnest({WORDS.format('text')}) AS term FROM conversations) t
  JOIN wv USING (term), unnest(range(64)) x(d) GROUP BY ALL),
means AS (SELECT conv_id, turn, list(m ORDER BY d) AS vec FROM long GROUP BY ALL)
SELECT a.conv_id, a.turn AS row_turn, b.turn AS col_turn,
  {rnd('CASE WHEN a.turn = b.turn THEN 1.0::DOUBLE ELSE list_cosine_similarity(a.vec, b.vec) END', 'similarity')}
FROM means a JOIN means b ON a.conv_id = b.conv_id AND a.turn <= b.turn"""
EMBEDDED = """et AS (
  SELECT vec_id // 10 AS conv_id, vec_id % 10 AS turn, CAST(label AS VARCHAR) AS speaker,
    CAST(embedding AS DOUBLE[]) AS vec FROM embeddings),
sim AS (
  SELECT a.conv_id, a.turn AS i, b.turn AS j, list_cosine_similarity(a.vec, b.vec) AS s
  FROM et a JOIN et b ON a.conv_id = b.conv_id AND a.turn < b.turn)"""
ORACLE["similarity_embedding"] = f"WITH {EMBEDDED} {PAIRS}"
ORACLE["similarity_embedding_renumbered"] = ORACLE["similarity_embedding"]
ORACLE["similarity_embedding_above"] = f"WITH {EMBEDDED.replace('10', '1000')} {PAIRS} WHERE s >= 0.3"
ORACLE["similarity_concept_above"] = f"WITH {MODEL} {PAIRS} WHERE s >= 0.4567"

# ---------------------------------------------------------------- recurrence

TURNS = "tt AS (SELECT conv_id, turn, role AS speaker, text FROM conversations)"


def recurrences(turns: str, t_medium: int = 10) -> str:
    """CTE ``rec``: score and number of eligible turns for every turn and kind, from all pairs."""
    return f"""cells2 AS (SELECT conv_id, i, j, s FROM sim UNION ALL SELECT conv_id, j, i, s FROM sim),
facts AS (
  SELECT conv_id, count(DISTINCT speaker) AS t_short, {t_medium} AS t_medium, count(*) AS t_long
  FROM {turns} GROUP BY conv_id),
scales AS (
  SELECT conv_id, 'short' AS time_scale, t_short AS reach FROM facts
  UNION ALL SELECT conv_id, 'medium', t_medium FROM facts
  UNION ALL SELECT conv_id, 'long', t_long FROM facts),
kinds AS (
  SELECT * FROM scales, (VALUES ('forward'), ('backward')) d(direction), (VALUES ('self'), ('other')) w(who)),
rec AS (
  SELECT a.conv_id, a.turn, k.time_scale, k.direction, k.who AS speaker,
    coalesce(sum(c.s) FILTER (o.turn IS NOT NULL), 0) AS total, count(o.turn) AS eligible
  FROM {turns} a JOIN kinds k ON k.conv_id = a.conv_id
  LEFT JOIN {turns} o ON o.conv_id = a.conv_id
    AND (CASE WHEN k.direction = 'forward' THEN o.turn - a.turn ELSE a.turn - o.turn END) BETWEEN 1 AND k.reach
    AND coalesce(o.speaker = a.speaker, false) = (k.who = 'self')
  LEFT JOIN cells2 c ON c.conv_id = a.conv_id AND c.i = a.turn AND c.j = o.turn
  GROUP BY ALL)"""


AVERAGE = "total / nullif(eligible, 0)"
KIND = "time_scale = '{0}' AND direction = '{1}' AND speaker = '{2}'"
ORACLE["recurrence_embedding"] = f"""WITH {EMBEDDED}, {recurrences('et')}
SELECT conv_id, turn, time_scale, direction, speaker, {rnd('total', 'score')} FROM rec"""
ORACLE["topic_recurrence"] = f"""WITH {MODEL}, {TURNS}, {recurrences('tt', 4)}
SELECT conv_id, turn, {rnd('total', 'score')} FROM rec WHERE {KIND.format('medium', 'backward', 'other')}"""
ORACLE["topic_recurrence_normalized"] = f"""WITH {MODEL}, {TURNS}, {recurrences('tt')}
SELECT conv_id, turn, {rnd(AVERAGE, 'score')} FROM rec WHERE {KIND.format('short', 'forward', 'self')}"""
ORACLE["topic_recurrence_of_similarity"] = f"""WITH {MODEL}, {TURNS}, {recurrences('tt')}
SELECT conv_id, turn, {rnd(AVERAGE, 'score')} FROM rec WHERE {KIND.format('long', 'forward', 'other')}"""
ORACLE["all_topic_recurrences"] = f"""WITH {MODEL}, {TURNS}, {recurrences('tt')}
SELECT conv_id, turn, time_scale, direction, speaker, {rnd('total', 'score')} FROM rec"""
ORACLE["all_topic_recurrences_long_path"] = f"""WITH {MODEL}, {TURNS}, {recurrences('tt')}
SELECT conv_id, turn, time_scale, direction, speaker, {rnd(AVERAGE, 'score')} FROM rec"""
ORACLE["conceptual_recurrence_rate"] = f"""WITH {MODEL},
n AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id HAVING count(*) >= 2)
SELECT n.conv_id, {rnd('coalesce(sum(s), 0) * 2 / (any_value(n.n) * (any_value(n.n) - 1))', 'recurrence_rate')}
FROM n LEFT JOIN sim ON sim.conv_id = n.conv_id GROUP BY n.conv_id"""


def grouped(turns: str, normalize: bool) -> str:
    score = "sum(coalesce(s, 0)) / count(*)" if normalize else "sum(coalesce(s, 0))"
    return f"""groups_ AS (SELECT DISTINCT conv_id, speaker FROM {turns} WHERE speaker IS NOT NULL),
scores AS (
  SELECT a.conv_id, a.speaker AS ga, b.speaker AS gb, {score} AS score
  FROM {turns} a JOIN {turns} b ON a.conv_id = b.conv_id AND a.turn < b.turn
  LEFT JOIN sim ON sim.conv_id = a.conv_id AND sim.i = a.turn AND sim.j = b.turn
  GROUP BY ALL)
SELECT a.conv_id, a.speaker AS initiated_by, b.speaker AS repeated_by, {rnd('coalesce(score, 0)', 'score')}
FROM groups_ a JOIN groups_ b ON a.conv_id = b.conv_id
LEFT JOIN scores s ON s.conv_id = a.conv_id AND s.ga = a.speaker AND s.gb = b.speaker"""


ORACLE["grouped_recurrence"] = f"WITH {MODEL}, {TURNS}, {grouped('tt', True)}"
ORACLE["grouped_recurrence_raw"] = f"WITH {MODEL}, {TURNS}, {grouped('tt', False)}"
ORACLE["grouped_recurrence_by_column"] = f"WITH {EMBEDDED}, {grouped('et', True)}"
ORACLE["grouped_recurrence_sparse_turns"] = ORACLE["grouped_recurrence_by_column"]

# ---------------------------------------------------------------- plot tables

PLOT = f"""{MODEL}, {TURNS},
long AS (
  SELECT conv_id, i AS x_index, j AS y_index, s AS similarity FROM sim
  UNION ALL SELECT DISTINCT conv_id, turn, turn, 1.0::DOUBLE FROM u),
shown AS (
  SELECT tt.* FROM tt WHERE EXISTS (
    SELECT 1 FROM long l WHERE l.conv_id = tt.conv_id AND tt.turn IN (l.x_index, l.y_index)))"""


def tiles(turns: str) -> str:
    return f"""sized AS (
  SELECT conv_id, turn, speaker AS "group", n_words, CASE WHEN n_words > 0 THEN ln(n_words) END AS size
  FROM (SELECT conv_id, turn, speaker, len({MARKS}) AS n_words FROM {turns})),
tiles AS (
  SELECT *, size / 2 + coalesce(sum(size) OVER (
      PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
    + row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS position FROM sized)"""


FULL = f"""{PLOT}, {tiles('shown')},
cells3 AS (
  SELECT l.conv_id, l.x_index, l.y_index, l.similarity, x.size AS width, x.position AS x_position,
    x."group" AS x_group, x.n_words, y.size AS height, y.position AS y_position, y."group" AS y_group
  FROM long l LEFT JOIN tiles x ON x.conv_id = l.conv_id AND x.turn = l.x_index
  LEFT JOIN tiles y ON y.conv_id = l.conv_id AND y.turn = l.y_index)"""
ORACLE["similarity_long"] = f"""WITH {PLOT}
SELECT conv_id, x_index, y_index, {rnd('similarity', 'similarity')} FROM long"""
ORACLE["turns_in_similarity"] = f"WITH {PLOT} SELECT conv_id, turn, speaker FROM shown"
ORACLE["tile_layout"] = f"""WITH {TURNS}, {tiles('tt')}
SELECT conv_id, turn, "group", n_words, {rnd('size', 'size')}, {rnd('position', 'position')} FROM tiles"""
ORACLE["tile_attributes"] = f"""WITH {FULL}
SELECT conv_id, x_index, y_index, {rnd('similarity', 'similarity')}, {rnd('width', 'width')},
  {rnd('x_position', 'x_position')}, x_group, n_words, {rnd('height', 'height')},
  {rnd('y_position', 'y_position')}, y_group FROM cells3"""
ORACLE["diagonal_tiles"] = f"""WITH {FULL}
SELECT c.conv_id, x_index, x_group, {rnd('width', 'width')}, {rnd('x_position', 'x_position')}, tt.text
FROM cells3 c JOIN tt ON tt.conv_id = c.conv_id AND tt.turn = x_index WHERE x_index = y_index"""


def corners(*points: str) -> str:
    return " || ' ' || ".join(f"printf('%.4f', round({p}, 4) + 0.0)" for p in points)


L, R = "(x_position - width / 2)", "(x_position + width / 2)"
T, B = "(y_position - height / 2)", "(y_position + height / 2)"
ORACLE["similarity_triangles"] = f"""WITH {FULL}
SELECT conv_id, x_index, y_index, x_group, y_group, {rnd('similarity', 'similarity')},
  {corners(L, L, R)} AS upper_triangle_x, {corners(B, T, T)} AS upper_triangle_y,
  {corners(L, R, R)} AS lower_triangle_x, {corners(B, T, B)} AS lower_triangle_y
FROM cells3 WHERE x_index < y_index"""
ORACLE["similarity_threshold"] = f"""WITH {PLOT}
SELECT conv_id, x_index, y_index, {rnd('similarity', 'similarity')} FROM long WHERE similarity >= 0.4567"""
ORACLE["cells_with_concepts"] = f"""WITH {PLOT}, {COMMON}
SELECT long.conv_id, x_index, y_index, {rnd('similarity', 'similarity')}, coalesce(concepts, '') AS concepts
FROM long LEFT JOIN common ON common.conv_id = long.conv_id AND i = x_index AND j = y_index
WHERE x_index < y_index"""
ORACLE["texts_for_cells"] = f"""WITH {PLOT}
SELECT conv_id, turn, speaker, text FROM tt WHERE EXISTS (
  SELECT 1 FROM long l WHERE l.conv_id = tt.conv_id AND tt.turn IN (l.x_index, l.y_index)
    AND l.x_index < l.y_index AND l.similarity >= 0.8765)"""
ORACLE["texts_above_threshold"] = ORACLE["texts_for_cells"]
ORACLE["plot_groups"] = f"""WITH {FULL}, g AS (SELECT DISTINCT conv_id, "group" FROM tiles)
SELECT conv_id, "group", count(*) OVER (PARTITION BY conv_id) AS n_groups FROM g"""
