"""The registered queries once more, as SQL for a second engine to check."""

from __future__ import annotations

from quire.functions import prompts
from quire.workload import expected as o
from quire.workload.expected import (
    KEYWORDS,
    LONG_COPIES,
    PAGE_CHARS,
    REASON_ALPHANUMERIC,
    REASON_EMPTY,
    REASON_FEW_CHARACTERS,
    REASON_FEW_WORDS,
    REASON_LONG_TOKENS,
    REASON_ODD_WORDS,
    REASON_REPETITION,
    REASON_SHORT_WORDS,
    REASON_SINGLES,
    REASON_SUSPICIOUS,
    REASON_UNPRINTABLE,
    REASON_UNREADABLE,
    REASON_VOWELS,
    SAMPLE_GAP,
    STOP_WORDS,
)


def lit(text: str) -> str:
    """SQL string literal; line breaks become chr(10)."""
    parts = ["'" + p.replace("'", "''") + "'" for p in text.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


_WS_CODES = [9, 10, 11, 12, 13, 32, 160, 5760, *range(8192, 8203), 8232, 8233, 8239, 8287, 12288, 65279]
WS = "(" + " || ".join(f"chr({c})" for c in _WS_CODES) + ")"
WS_CLASS = "".join(rf"\x{{{c:04X}}}" for c in _WS_CODES)
WS_INLINE = "".join(rf"\x{{{c:04X}}}" for c in _WS_CODES if c != 10)


def trim(x: str) -> str:
    return f"trim({x}, {WS})"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS_CLASS}]+', ' ', 'g'))"


def words(x: str) -> str:
    return f"(CASE WHEN {trim(x)} = '' THEN 0 ELSE length({collapse(x)}) - length(replace({collapse(x)}, ' ', '')) + 1 END)"


# --- derived inputs ---------------------------------------------------------

PARAGRAPHS = "SELECT doc_id, CASE WHEN lang = 'en' THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents"
LONG = f"""SELECT doc_id, repeat(replace(text, chr(10), chr(10) || chr(10)) || ' ', {LONG_COPIES}) AS text,
  CASE WHEN lang = 'en' THEN 'long' WHEN lang = 'fr' THEN 'short' ELSE 'any' END AS length FROM documents"""
WRAPPED = r"""SELECT doc_id, CASE WHEN lang = 'en'
    THEN regexp_replace(text, '([a-z]{4})([a-z]{3})', '\1-' || chr(10) || '\2', 'g')
    ELSE chr(13) || chr(10) || ' ' || chr(9) ||
      replace(text, ', ', ' ,' || chr(9) || ' ' || chr(13) || chr(10) || '  ') END AS text FROM documents"""
PAGES = f"""SELECT doc_id, CAST(i + 1 AS INTEGER) AS page_number, substr(text, CAST(i * {PAGE_CHARS} + 1 AS BIGINT), {PAGE_CHARS}) AS text
  FROM documents, unnest(range(CAST(ceil(length(text) / {PAGE_CHARS}.0) AS BIGINT))) AS t(i)"""
OCR = "SELECT doc_id, page_number, replace(text, 'e', 'c') AS text FROM pages_cut WHERE page_number <> 7"
QUESTIONS = "SELECT d.doc_id, d.doc_id AS question_id, b.text AS question FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)"
USER_QUESTIONS = "SELECT conv_id * 1000 + turn AS question_id, conv_id AS doc_id, text AS question FROM conversations WHERE role = 'user'"
UPLOADS = """SELECT doc_id, CASE WHEN doc_id % 31 <> 7
    THEN 'f' || doc_id || (['.pdf', '.PNG', '.jpg', '.jpeg', '.docx', ''])[doc_id % 6 + 1] END AS file_name,
  (['application/pdf', 'image/png', 'image/jpeg', '', 'text/html'])[doc_id % 5 + 1] AS mime_type,
  CAST(length(text) * 1000 AS BIGINT) AS size_bytes FROM documents"""
SUMMARIES = """SELECT doc_id, string_split(text, chr(10))[1] AS title, source AS document_type, text AS summary,
  string_split(text, '. ') AS key_points, list_reverse(string_split(text, '. ')) AS main_ideas,
  [lang, source] AS entities, CASE WHEN lang = 'en' THEN ['read ' || source] ELSE []::VARCHAR[] END AS action_items,
  CASE WHEN lang = 'fr' THEN NULL ELSE source || '*.pdf' END AS file_name,
  CASE WHEN lang = 'de' THEN 'long' ELSE 'short' END AS length,
  'Jan ' || (doc_id % 9 + 1) || ', 2024, 03:04 PM' AS generated, lang FROM documents"""
WRITES = """SELECT 'u' || user_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS created_at,
  CASE WHEN event_type <> 'signup' THEN event_type || '.pdf' END AS file_name,
  CASE event_type WHEN 'view' THEN 'short' WHEN 'click' THEN 'medium' ELSE 'long' END AS length,
  event_id AS seq, event_type FROM events"""


def normalized(source: str, name: str = "norm") -> str:
    """CTEs name_tidy and name: source(doc_id, page_number?, text) normalised.

    The rejoin folds over the lines; the paragraph so far is the last line.
    """
    w = f"[{WS_INLINE}]"
    tidy = "replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), chr(160), ' ')"
    tidy = f"regexp_replace({tidy}, '{w}+(\\n|$)', '\\1', 'g')"
    tidy = f"regexp_replace({tidy}, '([A-Za-z])-\\n([a-z])', '\\1\\2', 'g')"
    tidy = f"regexp_replace({tidy}, '[ \\t]+', ' ', 'g')"
    tidy = f"regexp_replace({tidy}, '(^|\\n){w}+', '\\1', 'g')"
    last = "regexp_extract(acc, '[^\\n]*$')"
    heading = (
        f"(regexp_matches({last}, '^#{{1,6}}{w}') OR regexp_matches({last}, '^\\d+(\\.\\d+)*\\.?{w}+[A-Z]')"
        f" OR (length({last}) <= 100 AND regexp_full_match({last}, '[A-Z0-9][A-Z0-9{WS_INLINE}\\-:&,.]+')))"
    )
    item = (
        f"(regexp_matches(x, '^[-•▪◦*]{w}+') OR regexp_matches(x, '^\\(?[a-zA-Z0-9]+\\){w}+')"
        f" OR regexp_matches(x, '^\\d+[A-Za-z]?[.)]{w}+'))"
    )
    joins = (
        f"{last} <> '' AND x <> '' AND NOT {heading} AND NOT {item}"
        f" AND NOT regexp_matches({last}, '[.!?:;]$') AND NOT regexp_matches(x, '^[A-Z][a-z]')"
    )
    fold = (
        f"list_reduce(string_split(text, chr(10)), lambda acc, x: acc || CASE WHEN {joins} THEN ' ' ELSE chr(10) END || x)"
    )
    return f"""{name}_tidy AS (SELECT * REPLACE ({tidy} AS text) FROM ({source})),
{name} AS (SELECT * REPLACE ({trim(f"regexp_replace({fold}, '\\n{{3,}}', chr(10) || chr(10), 'g')")} AS text) FROM {name}_tidy)"""


def cuts(source: str, limit: int, back: int, overlap: int, name: str = "cut") -> str:
    """Recursive CTE of raw chunks: doc_id, n (step), s, e (0-based, end exclusive)."""
    window = f"substr(t, s + {limit - back} + 1, {back} + 2)"

    def last(pattern: str) -> str:
        back_pattern = f"reverse({pattern})"
        return (
            f"CASE WHEN strpos(reverse({window}), {back_pattern}) = 0 THEN -1 "
            f"ELSE s + {limit - back} + length({window}) - strpos(reverse({window}), {back_pattern}) - 1 END"
        )

    para = last("chr(10) || chr(10)")
    sentence = f"greatest({last(lit('. '))}, {last(lit('? '))}, {last(lit('! '))})"
    end = (
        f"CASE WHEN s + {limit} >= len THEN len WHEN {para} >= 0 THEN {para} "
        f"WHEN {sentence} >= 0 THEN {sentence} + 1 ELSE s + {limit} END"
    )
    return f"""{name}_src AS (SELECT *, {trim('text')} AS t, length({trim('text')}) AS len FROM ({source})),
{name} AS (
  SELECT doc_id, 0 AS n, s, {end} AS e, len, t FROM (SELECT *, CAST(0 AS BIGINT) AS s FROM {name}_src WHERE len > 0)
  UNION ALL
  SELECT doc_id, n, s, {end} AS e, len, t FROM
    (SELECT doc_id, n + 1 AS n, e - {overlap} AS s, len, t FROM {name} WHERE e < len)
)"""


def retrieval_cte(source: str) -> str:
    return f"""{cuts(source, 1200, 600, 200)},
kept AS (SELECT doc_id, n, {trim('substr(t, s + 1, e - s)')} AS text FROM cut),
numbered AS (SELECT doc_id, text, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index
  FROM kept WHERE length(text) > 40 OR n = 0),
chunks AS (SELECT doc_id, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks, chunk_index, text
  FROM numbered)"""


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)


def tokens(text: str) -> str:
    return (
        f"list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), "
        f"lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
    )


INDEX = f"""tf AS (SELECT doc_id, chunk_index, any_value(n_chunks) AS n_chunks, term, count(*) AS occurrences FROM
  (SELECT doc_id, chunk_index, n_chunks, unnest({tokens('text')}) AS term FROM chunks) GROUP BY doc_id, chunk_index, term),
idf AS (SELECT doc_id, term, count(*) AS df, ln((any_value(n_chunks) + 1) / (count(*) + 0.5)) AS idf FROM tf GROUP BY doc_id, term),
weights AS (SELECT tf.doc_id, chunk_index, tf.term, (1 + ln(occurrences)) * idf AS weight
  FROM tf JOIN idf ON tf.doc_id = idf.doc_id AND tf.term = idf.term),
norms AS (SELECT doc_id, chunk_index, count(*) AS n_terms, sqrt(sum(weight * weight)) AS norm FROM weights GROUP BY ALL)"""


def search_cte(questions: str, source: str = "SELECT doc_id, text FROM documents") -> str:
    return f"""{retrieval_cte(source)},
{INDEX},
asked AS ({questions}),
terms AS (SELECT doc_id, question_id, term, count(*) AS occurrences FROM
  (SELECT doc_id, question_id, unnest({tokens('question')}) AS term FROM asked) GROUP BY ALL),
asked_weights AS (SELECT t.doc_id, question_id, t.term, (1 + ln(occurrences)) * idf AS weight
  FROM terms t JOIN idf i ON t.doc_id = i.doc_id AND t.term = i.term),
asked_norms AS (SELECT doc_id, question_id, sqrt(sum(weight * weight)) AS norm FROM asked_weights GROUP BY ALL),
dots AS (SELECT a.doc_id, question_id, chunk_index, sum(a.weight * w.weight) AS dot
  FROM asked_weights a JOIN weights w ON a.doc_id = w.doc_id AND a.term = w.term GROUP BY ALL),
scored AS (SELECT q.doc_id, q.question_id, {trim('q.question')} AS question, c.chunk_index, c.n_chunks, c.text,
    coalesce(round(d.dot / (an.norm * n.norm), 12), 0.0) AS similarity
  FROM asked q JOIN chunks c ON c.doc_id = q.doc_id
  LEFT JOIN asked_norms an ON an.doc_id = q.doc_id AND an.question_id = q.question_id
  LEFT JOIN norms n ON n.doc_id = c.doc_id AND n.chunk_index = c.chunk_index
  LEFT JOIN dots d ON d.doc_id = q.doc_id AND d.question_id = q.question_id AND d.chunk_index = c.chunk_index
  WHERE {trim('q.question')} <> ''),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id, question_id ORDER BY similarity DESC, chunk_index) AS INTEGER) AS rank FROM scored)"""


_TOP = "SELECT doc_id, question_id, rank, chunk_index, round(similarity, 6) AS similarity, n_chunks, text FROM ranked WHERE rank <= 4"

_KW = "|".join(KEYWORDS)
_MULTI = r"^[\p{L}\p{N}]+([''’-][\p{L}\p{N}]+)*[.,;:!?)]?$"
_ALPHA = r"^\p{L}+([''’-]\p{L}+)*[.,;:!?)]?$"


def _hits(text: str, pattern: str) -> str:
    return f"len(regexp_extract_all({text}, '{pattern}'))"


def _share(predicate: str, of: str = "ws") -> str:
    return f"CASE WHEN len({of}) = 0 THEN 0.0 ELSE len(list_filter({of}, lambda w: {predicate})) / len({of}) END"


def quality(source: str) -> str:
    """CTE q with every metric of source(keys, text)."""
    return rf"""q0 AS (SELECT * EXCLUDE (text), {collapse('text')} AS t FROM ({source})),
q1 AS (SELECT *, length(t) AS chars, CASE WHEN t = '' THEN []::VARCHAR[] ELSE string_split(t, ' ') END AS ws FROM q0),
q2 AS (SELECT *, list_filter(ws, lambda w: regexp_full_match(w, '\p{{L}}+')) AS lex,
    list_transform(ws, lambda w: lower(w)) AS low,
    {_hits('t', r'\p{L}')} AS letters FROM q1),
q3 AS (SELECT *, chars AS character_count, len(ws) AS word_count,
    CASE WHEN chars = 0 THEN 0.0 ELSE {_hits('t', r'[\p{L}\p{N}]')} / chars END AS alphanumeric_ratio,
    CASE WHEN chars = 0 THEN 0.0 ELSE (chars - {_hits('t', r'[\x00-\x1F\x7F]')}) / chars END AS printable_ratio,
    CASE WHEN chars = 0 THEN 0.0 ELSE {_hits('t', r'[\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F]')} / chars END AS suspicious_character_ratio,
    CASE WHEN len(ws) = 0 THEN 0.0 ELSE (chars - len(ws) + 1) / len(ws) END AS average_word_length,
    {_share(f"regexp_matches(w, '{_MULTI}')")} AS word_like_ratio,
    {_share("length(w) = 1")} AS single_character_token_ratio,
    least(({_hits('t', r'[{}\[\]();]')} + {_hits('t', '=>')} + {_hits('t', '::')}
      + {_hits('t', rf'(?i)\b({_KW})\b')} + {_hits('t', r'\.\w+\(')}) / 8, 1.0) AS technical_structure_ratio,
    {_share("length(w) >= 4 AND (regexp_matches(lower(w), '[^aeiou]{5,}') OR regexp_matches(lower(w), '^[^aeiou]{4,}'))", "lex")} AS suspicious_word_ratio,
    {_share("length(w) > 30")} AS long_token_ratio,
    CASE WHEN len(ws) < 2 THEN 0.0 ELSE (len(ws) - len(list_filter(map_values(list_histogram(low)), lambda n: n = 1))) / len(ws) END AS repeated_token_ratio,
    CASE WHEN letters = 0 THEN 0.0 ELSE {_hits('t', '[aeiouAEIOU]')} / letters END AS vowel_ratio,
    {_share(f"regexp_matches(w, '{_ALPHA}')")} AS alphabetic_word_ratio FROM q2),
q4 AS (SELECT *, CASE WHEN chars = 0 THEN 0.0 ELSE greatest(0.0, least(1.0,
      least(printable_ratio, 1.0) * 0.20::DOUBLE + least(alphanumeric_ratio / 0.50::DOUBLE, 1.0) * 0.15::DOUBLE + least(word_like_ratio, 1.0) * 0.10::DOUBLE
      + CASE WHEN average_word_length BETWEEN 2 AND 20 THEN 0.10 WHEN average_word_length BETWEEN 1 AND 30 THEN 0.05 ELSE 0 END::DOUBLE
      + CASE WHEN word_count >= 10 THEN 0.10 WHEN word_count >= 3 THEN 0.07 WHEN word_count >= 1 THEN 0.04 ELSE 0 END::DOUBLE
      + CASE WHEN chars >= 50 THEN 0.05 WHEN chars >= 10 THEN 0.03 ELSE 0 END::DOUBLE
      + technical_structure_ratio * 0.10::DOUBLE
      - CASE WHEN single_character_token_ratio > 0.35 AND technical_structure_ratio < 0.15 THEN 0.10 ELSE 0 END::DOUBLE
      - least(suspicious_word_ratio * 0.30::DOUBLE, 0.20::DOUBLE) - least(long_token_ratio * 0.20::DOUBLE, 0.10::DOUBLE)
      - CASE WHEN repeated_token_ratio > 0.60 THEN 0.10 ELSE 0 END::DOUBLE
      - CASE WHEN vowel_ratio < 0.08 AND alphabetic_word_ratio > 0.50 THEN 0.10 ELSE 0 END::DOUBLE
      - least(suspicious_character_ratio * 2, 0.30::DOUBLE))) END AS quality_score FROM q3),
q AS (SELECT *, (chars < 3 OR word_count < 1) AS is_empty, (chars < 3 OR word_count < 1 OR quality_score < 0.55) AS is_suspicious FROM q4)"""


def _r6(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _quality_query(columns: str) -> str:
    return f"WITH {quality('SELECT doc_id, text FROM documents')} SELECT doc_id, {columns} FROM q"


_REASONS = [
    ("chars < 3", REASON_FEW_CHARACTERS), ("word_count < 1", REASON_FEW_WORDS),
    ("printable_ratio < 0.85", REASON_UNPRINTABLE), ("alphanumeric_ratio < 0.20", REASON_ALPHANUMERIC),
    ("suspicious_character_ratio > 0.05", REASON_SUSPICIOUS),
    ("word_count >= 2 AND word_like_ratio < 0.40 AND plain", REASON_UNREADABLE),
    ("single_character_token_ratio > 0.35 AND plain", REASON_SINGLES),
    ("suspicious_word_ratio > 0.25 AND plain", REASON_ODD_WORDS),
    ("word_count >= 3 AND average_word_length < 1.5", REASON_SHORT_WORDS),
    ("long_token_ratio > 0.20", REASON_LONG_TOKENS), ("repeated_token_ratio > 0.60", REASON_REPETITION),
    ("vowel_ratio < 0.08 AND alphabetic_word_ratio > 0.50 AND plain", REASON_VOWELS),
]
_REASON_LIST = ", ".join(
    f"CASE WHEN {cond.replace('plain', 'technical_structure_ratio < 0.15')} THEN {lit(text)} END" for cond, text in _REASONS
)
QUALITY_REASONS = _quality_query(
    f"CASE WHEN chars = 0 THEN {lit(REASON_EMPTY)} ELSE array_to_string(list_filter([{_REASON_LIST}, "
    "CASE WHEN quality_score < 0.55 THEN 'Text quality score is low (' || printf('%.2f', quality_score) || ')' END], "
    "lambda r: r IS NOT NULL), '|') END AS reasons"
)

# Pages: normalised, scored, routed.
_PAGE_CTE = f"""pages_cut AS ({PAGES}),
{normalized('SELECT doc_id, page_number, text FROM pages_cut', 'native')},
{normalized(OCR, 'ocr')},
{quality('SELECT doc_id, page_number, text FROM native')},
routed AS (SELECT n.doc_id, n.page_number,
    CASE WHEN q.is_suspicious THEN coalesce(ocr.text, '') ELSE n.text END AS text,
    CASE WHEN q.is_suspicious THEN 'ocr' ELSE 'pdf' END AS method
  FROM native n JOIN q ON q.doc_id = n.doc_id AND q.page_number = n.page_number
  LEFT JOIN ocr ON ocr.doc_id = n.doc_id AND ocr.page_number = n.page_number),
counted AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total FROM routed),
combined AS (SELECT doc_id, CAST(any_value(total) AS INTEGER) AS page_count,
    coalesce(string_agg('-- ' || page_number || ' of ' || total || ' --' || chr(10) || {trim('text')}, chr(10) || chr(10) ORDER BY page_number)
      FILTER ({trim('text')} <> ''), '') AS text,
    CASE WHEN bool_or(method = 'ocr') THEN 'ocr' ELSE 'pdf' END AS method FROM counted GROUP BY doc_id)"""
_COUNTS = f"CAST({words('text')} AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS character_count"

# Uploads.
_VALID = f"""checked AS (SELECT *, CASE
    WHEN file_name IS NULL THEN 'No file was provided.'
    WHEN size_bytes > 10485760 THEN {lit('File is too large. Please upload a file smaller than 10 MB.')}
    WHEN ext NOT IN ('pdf', 'png', 'jpg', 'jpeg') THEN {lit('Unsupported file type. Please upload a PDF, PNG, JPG, or JPEG file.')}
    WHEN mime_type = '' THEN NULL
    WHEN mime_type = 'text/html' THEN {lit('Unsupported file type. Please upload a PDF, PNG, JPG, or JPEG file.')}
    WHEN mime_type <> CASE ext WHEN 'pdf' THEN 'application/pdf' WHEN 'png' THEN 'image/png' ELSE 'image/jpeg' END
    THEN {lit('The file extension and file type do not match. Please choose a valid PDF, PNG, JPG, or JPEG file.')} END AS error
  FROM (SELECT *, CASE WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) ELSE '' END AS ext FROM ({UPLOADS}))),
valid AS (SELECT *, CASE WHEN file_name IS NULL THEN 'NO_FILE' WHEN error LIKE '%too large%' THEN 'FILE_TOO_LARGE' WHEN error IS NOT NULL THEN 'INVALID_FILE' END AS error_code,
    CASE WHEN error LIKE '%too large%' THEN 413 WHEN error IS NOT NULL THEN 400 ELSE 200 END AS status,
    CASE WHEN error IS NULL THEN CASE WHEN ext = 'pdf' THEN 'pdf' ELSE 'image' END END AS source_type FROM checked)"""
_EXTRACTED = f"""{_PAGE_CTE}, {_VALID},
texts AS (SELECT doc_id, 'pdf' AS source_type, text, page_count, {_COUNTS}, method FROM combined
  UNION ALL SELECT doc_id, 'image', {trim('text')}, NULL, CAST({words('text')} AS BIGINT), CAST(length({trim('text')}) AS BIGINT), 'ocr' FROM documents),
extracted AS (SELECT v.doc_id, v.file_name, v.source_type, t.text, t.page_count, t.word_count, t.character_count, t.method,
    v.error IS NULL AND coalesce(t.text, '') <> '' AS success,
    CASE WHEN v.error IS NOT NULL THEN v.status WHEN t.text IS NULL THEN 500 WHEN t.text = '' THEN 422 ELSE 200 END AS status,
    CASE WHEN v.error IS NOT NULL THEN v.error_code WHEN t.text IS NULL THEN 'EXTRACTION_FAILED' WHEN t.text = '' THEN 'EMPTY_EXTRACTION' END AS error_code,
    CASE WHEN v.error IS NOT NULL THEN v.error
      WHEN t.text IS NULL THEN CASE WHEN v.source_type = 'pdf' THEN {lit(o.MESSAGE_BROKEN_PDF)} ELSE {lit(o.MESSAGE_BROKEN_IMAGE)} END
      WHEN t.text = '' THEN CASE WHEN v.source_type = 'pdf' THEN {lit(o.MESSAGE_EMPTY_PDF)} ELSE {lit(o.MESSAGE_EMPTY_IMAGE)} END END AS error_message
  FROM valid v LEFT JOIN texts t ON t.doc_id = v.doc_id AND t.source_type = v.source_type)"""

# Long documents in summary chunks.
_LONG_CHUNKS = f"""{cuts(LONG, 30000, 2000, 0)},
pieces AS (SELECT doc_id, n, s, e, {trim('substr(t, s + 1, e - s)')} AS text FROM cut),
sections AS (SELECT p.doc_id, CAST(row_number() OVER (PARTITION BY p.doc_id ORDER BY n) - 1 AS INTEGER) AS chunk_index,
    CAST(count(*) OVER (PARTITION BY p.doc_id) AS INTEGER) AS n_chunks, p.text, CAST(s AS INTEGER) AS start_character,
    CAST(e AS INTEGER) AS end_character, c.length
  FROM pieces p JOIN cut_src c ON c.doc_id = p.doc_id WHERE p.text <> '')"""

_GUIDE = "CASE {0} " + " ".join(f"WHEN '{k}' THEN {lit(v)}" for k, v in prompts.LENGTH_GUIDE.items()) + " END"
_KNOWN = "CASE WHEN {0} IN ('short', 'medium', 'long') THEN {0} ELSE 'medium' END"




def _section_prompt(text: str, part: str, parts: str) -> str:
    return (
        f"'This is part ' || {part} || ' of ' || {parts} || "
        + lit(
            " of one document. Note its facts, arguments, names, dates, figures, decisions and "
            "requirements in 150 to 250 words, keep technical terms, add nothing that is not here.\n\nPart "
        )
        + f" || {part} || {lit(':\n\"\"\"\n')} || {text} || {lit('\n\"\"\"')}"
    )


def _direct_prompt(text: str, length: str) -> str:
    contract = prompts._contract("the document")
    return (
        f"'Summarise the document below. Length of the summary: ' || {_GUIDE.format(length)} || "
        f"{lit('.\n\n' + contract + '\n\nDocument:\n\"\"\"\n')} || {text} || {lit('\n\"\"\"')}"
    )


def _final_prompt(sections: str, length: str) -> str:
    contract = prompts._contract("the section notes")
    return (
        "'Merge these section notes of one document into its summary. Length of the summary: ' || "
        f"{_GUIDE.format(length)} || {lit('.\n\n' + contract + '\n\nSection notes:\n\n')} || {sections}"
    )


def _questions_prompt(sample: str) -> str:
    return (
        lit(
            "Write exactly 7 specific questions that the text below answers, each one sentence "
            "with a question mark, covering different parts of it. Reply with one JSON object: "
            '{"questions": ["...", "..."]}.\n\nText:\n"""\n'
        )
        + f" || {sample} || {lit('\n\"\"\"')}"
    )


def _answer_prompt(question: str, excerpts: str) -> str:
    return (
        lit(
            "Answer from these excerpts of a document only, in two to six sentences; say so if "
            "they do not contain the answer.\n\nQuestion: "
        )
        + f" || {question} || {lit('\n\nExcerpts:\n\n')} || {excerpts}"
    )


_SAMPLE = (
    f"CASE WHEN length({trim('text')}) <= 6000 THEN {trim('text')} ELSE substr({trim('text')}, 1, 3000) || {lit(SAMPLE_GAP)} || "
    f"substr({trim('text')}, CAST(floor(length({trim('text')}) / 2) AS BIGINT) - 1500 + 1, 1500) || {lit(SAMPLE_GAP)} || right({trim('text')}, 1500) END"
)
_FIT = f"length({trim('text')}) >= 80"
_NOTES = f"""{_LONG_CHUNKS},
noted AS (SELECT doc_id, length, chunk_index, md5(text) AS content, length = 'any' AND chunk_index = 1 AS broken FROM sections WHERE n_chunks > 1),
notes AS (SELECT doc_id, length, count(*) AS n_sections, bool_or(broken) AS broken,
  string_agg('--- Section ' || (chunk_index + 1) || ' ---' || chr(10) || content, chr(10) || chr(10) ORDER BY chunk_index) AS sections FROM noted GROUP BY doc_id, length)"""

# Completions: bodies are made as text, and everything that is said of them is read from it.
def _text_or(key: str, default: str) -> str:
    value = trim(f"json_extract_string(j, '$.{key}')")
    return f"CASE WHEN json_type(j, '$.{key}') = 'VARCHAR' AND {value} <> '' THEN {value} ELSE '{default}' END"


def _texts_at(key: str) -> str:
    items = f"list_filter(CAST(json_extract(j, '$.{key}') AS JSON[]), lambda x: json_type(x) = 'VARCHAR' AND {trim("(x ->> '$')")} <> '')"
    return f"CASE WHEN json_type(j, '$.{key}') = 'ARRAY' THEN coalesce(array_to_string(list_transform({items}, lambda x: x ->> '$'), '|'), '') ELSE '' END"


_FENCE = "chr(96) || chr(96) || chr(96)"
_PLAIN = (
    "json_object('title', '  A title ', 'documentType', source, 'summary', text, 'keyPoints', [lang, ' ', source], 'mainIdeas', [lang])::VARCHAR"
)
_ATTEMPTS = f"""made AS (SELECT doc_id, attempt, CASE WHEN attempt = 2 AND lang = 'en' THEN 0 ELSE doc_id % 8 END AS kind, {_PLAIN} AS plain,
    json_object('summary', text)::VARCHAR AS short FROM documents, unnest([1, 2]) AS a(attempt)),
told AS (SELECT CAST(doc_id AS VARCHAR) AS request_id, CAST(attempt AS INTEGER) AS attempt, CASE WHEN kind = 7 THEN 500 ELSE 200 END AS status,
    kind = 4 AS cut_off, CASE kind WHEN 0 THEN plain WHEN 1 THEN {_FENCE} || 'json' || chr(10) || plain || chr(10) || {_FENCE}
    WHEN 2 THEN '<think>{{"a": 1}} hm</think>' || chr(10) || plain WHEN 3 THEN 'Here {{you}} are: {{"bad": }} then ' || plain || ' Enjoy!'
    WHEN 4 THEN plain[:-2] WHEN 5 THEN '{{"title": "no summary here"}}'
    WHEN 6 THEN short[:-2] || ',"title":5,"keyPoints":["k",1,null,{{"x":1}},true],"entities":"none"}}' END AS content FROM made),
bare AS (SELECT * EXCLUDE (content), {trim(f"regexp_replace(regexp_replace({trim("regexp_replace(coalesce(content, ''), '(?is)<think>.*?</think>', '', 'g')")}, '(?i)^`{{3}}(?:json)?', ''), '`{{3}}$', '')")} AS t FROM told),
tried AS (SELECT *, TRY_CAST(t AS JSON) AS j FROM bare),
-- The first opening brace from which a closing one makes it JSON.
opened AS (SELECT request_id, attempt, t, string_split(t, '{{') AS a, string_split(t, '}}') AS z FROM tried WHERE j IS NULL AND status = 200 AND NOT cut_off),
braces AS (SELECT request_id, attempt, t, list_transform(range(1, len(a)), lambda i: length(array_to_string(a[1:i], '{{')) + 1) AS starts,
    list_transform(range(1, len(z)), lambda i: length(array_to_string(z[1:i], '}}')) + 1) AS ends FROM opened),
started AS (SELECT request_id, attempt, t, ends, unnest(starts) AS s FROM braces),
spans AS (SELECT request_id, attempt, s, TRY_CAST(t[s:e] AS JSON) AS j FROM (SELECT request_id, attempt, t, s, unnest(ends) AS e FROM started) WHERE e > s),
inner_json AS (SELECT request_id, attempt, arg_min(j, s) AS j FROM spans WHERE j IS NOT NULL GROUP BY ALL),
read AS (SELECT o.request_id, o.attempt, o.status, o.cut_off, o.t, coalesce(o.j, i.j) AS j FROM tried o LEFT JOIN inner_json i USING (request_id, attempt)),
judged AS (SELECT *, CASE WHEN status <> 200 THEN 'HTTP_ERROR' WHEN cut_off THEN 'TRUNCATED' WHEN t = '' THEN 'EMPTY_COMPLETION'
    WHEN j IS NULL THEN 'UNPARSEABLE' WHEN json_type(j) NOT IN ('OBJECT', 'ARRAY') THEN 'BAD_SHAPE'
    WHEN coalesce(json_type(j, '$.summary'), '') <> 'VARCHAR' OR {trim("json_extract_string(j, '$.summary')")} = '' THEN 'NO_SUMMARY' END AS completion_error FROM read),
shown AS (SELECT request_id, attempt, completion_error, CASE WHEN ok THEN {_text_or('title', 'Untitled document')} END AS title,
    CASE WHEN ok THEN {_text_or('documentType', 'Document')} END AS document_type, CASE WHEN ok THEN {trim("json_extract_string(j, '$.summary')")} END AS summary,
    {", ".join(f"CASE WHEN ok THEN {_texts_at(k)} END AS {n}" for k, n in (('keyPoints', 'key_points'), ('mainIdeas', 'main_ideas'), ('entities', 'entities'), ('actionItems', 'action_items')))}
  FROM (SELECT *, completion_error IS NULL AS ok FROM judged))"""


# Exports.
def _meta(prefix: str, star: bool) -> str:
    name = "replace(file_name, '*', '\\*')" if star else "file_name"
    kind = "replace(document_type, '*', '\\*')" if star else "document_type"
    return (
        f"'{prefix}Document Type: ' || {kind} || chr(10) || coalesce('{prefix}Source File: ' || {name} || chr(10), '') || "
        f"'{prefix}Summary Length: ' || upper(length[1]) || length[2:] || chr(10) || '{prefix}Generated: ' || generated || chr(10)"
    )


def _block(items: str, head: str, line: str) -> str:
    return f"CASE WHEN len({items}) > 0 THEN {head} || array_to_string(list_transform({items}, lambda i: {line}), chr(10)) || chr(10) ELSE '' END"


_RULE = "repeat('-', 60) || chr(10)"
_PLAIN_BLOCKS = " || ".join(
    _block(c, f"chr(10) || '{h}' || chr(10) || {_RULE}", "'• ' || i")
    for h, c in (("KEY POINTS", "key_points"), ("MAIN IDEAS", "main_ideas"), ("ACTION ITEMS", "action_items"))
)
EXPORT_TEXT = f"""SELECT doc_id, title || chr(10) || repeat('=', least(60, greatest(16, length(title)))) || chr(10) || chr(10)
  || {_meta('', False)} || chr(10) || 'SUMMARY' || chr(10) || {_RULE} || summary || chr(10) || {_PLAIN_BLOCKS}
  || chr(10) || 'MENTIONED' || chr(10) || {_RULE} || array_to_string(entities, ', ') || chr(10) AS content FROM ({SUMMARIES})"""
_MD_BLOCKS = " || ".join(
    _block(c, f"chr(10) || '## {h}' || chr(10) || chr(10)", "'- ' || replace(i, chr(10), chr(10) || '  ')")
    for h, c in (("Key Points", "key_points"), ("Main Ideas", "main_ideas"), ("Action Items", "action_items"))
)
EXPORT_MARKDOWN = f"""SELECT doc_id, '# ' || title || chr(10) || chr(10) || {_meta('- ', True)} || chr(10) || '## Summary' || chr(10) || chr(10)
  || array_to_string(list_transform(regexp_split_to_array({trim('summary')}, '\\n{{2,}}'), lambda b: replace({trim('b')}, chr(10), '  ' || chr(10))), chr(10) || chr(10)) || chr(10)
  || {_MD_BLOCKS} || chr(10) || '## Mentioned' || chr(10) || chr(10)
  || array_to_string(list_transform(entities, lambda e: '`' || e || '`'), ' · ') || chr(10) AS content FROM ({SUMMARIES})"""
_CLIP_BLOCKS = " || ".join(
    f"CASE WHEN len({c}) > 0 THEN chr(10) || chr(10) || '{h}' || chr(10) || array_to_string(list_transform({c}, lambda i: '• ' || i), chr(10)) ELSE '' END"
    for h, c in (("Key Points", "key_points"), ("Main Ideas", "main_ideas"), ("Action Items", "action_items"))
)
CLIPBOARD = f"""SELECT doc_id, title || chr(10) || 'Document Type: ' || document_type || chr(10) || chr(10) || 'Summary' || chr(10) || summary
  || {_CLIP_BLOCKS} || chr(10) || chr(10) || 'Mentioned' || chr(10) || array_to_string(entities, ', ') AS content FROM ({SUMMARIES})"""
_JSON = (
    "replace(json_object('title', title, 'documentType', document_type, 'summary', summary, 'keyPoints', key_points, "
    "'mainIdeas', main_ideas, 'entities', entities, 'actionItems', action_items)::VARCHAR, '\\u007f', chr(127))"
)

SQL: dict[str, str] = {
    "doc_word_stats": f"SELECT doc_id, CAST({words('text')} AS BIGINT) AS word_count, CAST(length(text) AS BIGINT) AS character_count FROM documents",
    "quality_char_ratios": _quality_query(
        "CAST(character_count AS BIGINT) AS character_count, " + _r6("alphanumeric_ratio", "printable_ratio", "suspicious_character_ratio", "vowel_ratio")
    ),
    "quality_word_ratios": _quality_query(
        "CAST(word_count AS BIGINT) AS word_count, "
        + _r6("average_word_length", "word_like_ratio", "single_character_token_ratio")
        + ", round(single_character_token_ratio, 6) AS single_character_ratio, "
        + _r6("long_token_ratio", "suspicious_word_ratio", "alphabetic_word_ratio")
    ),
    "quality_technical": _quality_query(_r6("technical_structure_ratio")),
    "quality_repeated": _quality_query(_r6("repeated_token_ratio")),
    "quality_score": _quality_query(_r6("quality_score") + ", is_empty, is_suspicious"),
    "quality_reasons": QUALITY_REASONS,
    "suspicious_pages": f"WITH {_PAGE_CTE} SELECT doc_id, page_number, {_r6('quality_score')} FROM q WHERE is_suspicious",
    "rejected_questions": f"""WITH asked AS (SELECT CASE WHEN question_id % 7 = 0 THEN -1 ELSE doc_id END AS doc_id, question_id, question_id % 3 = 0 AS blank FROM ({QUESTIONS})),
seen AS (SELECT a.doc_id, question_id, blank, length({trim('text')}) AS n FROM asked a LEFT JOIN documents d ON d.doc_id = a.doc_id)
SELECT doc_id, question_id, false AS success, CASE WHEN blank THEN 400 ELSE 502 END AS status,
  CASE WHEN blank THEN 'INVALID_INPUT' ELSE 'QA_FAILED' END AS error_code,
  CASE WHEN blank THEN 'No question was provided.' WHEN coalesce(n, 0) = 0 THEN 'There is no document text to work with.'
    ELSE 'The extracted text is too short to ask questions about.' END AS error_message
FROM seen WHERE blank OR coalesce(n, 0) < 80""",
    "ocr_work_list": f"WITH {_PAGE_CTE} SELECT doc_id, page_number FROM q WHERE is_suspicious",
    "page_routing": f"WITH {_PAGE_CTE} SELECT doc_id, page_number, text, method FROM routed",
    "page_statistics": f"WITH {_PAGE_CTE} SELECT doc_id, count(*) AS page_count, CAST(sum({words('text')}) AS BIGINT) AS total_word_count, round(avg({words('text')}), 6) AS average_words_per_page FROM routed GROUP BY doc_id",
    "combined_documents": f"WITH {_PAGE_CTE} SELECT doc_id, text, page_count, {_COUNTS}, method FROM combined",
    "extract_uploads": f"WITH {_EXTRACTED} SELECT * FROM extracted",
    "trimmed_pages": f"WITH pages_cut AS ({PAGES}) SELECT doc_id, page_number, {trim('text')} AS text FROM pages_cut",
    "normalize_lines": f"WITH {normalized(WRAPPED)} SELECT doc_id, text FROM norm_tidy",
    "normalize_text": f"WITH {normalized(WRAPPED)} SELECT doc_id, text FROM norm",
    "summary_chunks": f"WITH RECURSIVE {_LONG_CHUNKS} SELECT doc_id, chunk_index, n_chunks, start_character, end_character, md5(text) AS text_md5 FROM sections",
    "retrieval_chunks": f"WITH RECURSIVE {retrieval_cte(PARAGRAPHS)} SELECT doc_id, n_chunks, chunk_index, text FROM chunks",
    "question_sample": f"SELECT doc_id, {_SAMPLE} AS sample FROM documents",
    "chunk_term_freq": f"WITH RECURSIVE {retrieval_cte('SELECT doc_id, text FROM documents')}, {INDEX} SELECT doc_id, chunk_index, term, occurrences, round(1 + ln(occurrences), 6) AS tf FROM tf",
    "chunk_idf": f"WITH RECURSIVE {retrieval_cte('SELECT doc_id, text FROM documents')}, {INDEX} SELECT doc_id, term, df, round(idf, 6) AS idf FROM idf",
    "chunk_norms": f"WITH RECURSIVE {retrieval_cte('SELECT doc_id, text FROM documents')}, {INDEX} SELECT doc_id, chunk_index, n_terms, round(norm, 6) AS norm FROM norms",
    "retrieve_top4": f"WITH RECURSIVE {search_cte(QUESTIONS)} {_TOP}",
    "retrieve_unknown_terms": f"WITH RECURSIVE {search_cte('SELECT doc_id, doc_id AS question_id, ' + lit('zzzzqq qqqqzz') + ' AS question FROM documents')} {_TOP}",
    "retrieve_user_questions": f"WITH RECURSIVE {search_cte(USER_QUESTIONS)} {_TOP}",
    "section_requests": f"""WITH RECURSIVE {_LONG_CHUNKS}, known AS (SELECT *, {_KNOWN.format('length')} AS l FROM sections)
SELECT doc_id || ':' || l || ':' || CASE WHEN n_chunks = 1 THEN 'direct' ELSE 'section' END || ':' || (chunk_index + 1) AS request_id, doc_id, l AS length, chunk_index, n_chunks,
  CASE WHEN n_chunks = 1 THEN 2000 ELSE 500 END AS max_tokens, n_chunks = 1 AS json_mode,
  md5(CASE WHEN n_chunks = 1 THEN {_direct_prompt('text', 'l')} ELSE {_section_prompt('text', '(chunk_index + 1)', 'n_chunks')} END) AS prompt_md5 FROM known""",
    "final_requests": f"""WITH RECURSIVE {_NOTES} SELECT doc_id || ':' || length || ':final' AS request_id, doc_id, length, CAST(n_sections AS INTEGER) AS n_sections,
  {_final_prompt('sections', _KNOWN.format('length'))} AS prompt, 5000 AS max_tokens, true AS json_mode FROM notes WHERE NOT broken""",
    "failed_sections": f"WITH RECURSIVE {_NOTES} SELECT doc_id, 'HTTP_ERROR' AS section_error, false AS success, 502 AS status, 'SUMMARIZATION_FAILED' AS error_code, 'The AI service returned an error (status 503). Please try again.' AS error_message FROM notes WHERE broken",
    "summary_inputs": f"""SELECT doc_id, false AS success, 502 AS status, 'QA_FAILED' AS error_code,
  CASE WHEN {trim('text')} = '' THEN {lit(o.MESSAGE_NO_DOCUMENT)} ELSE {lit(o.MESSAGE_SHORT_DOCUMENT)} END AS error_message FROM documents WHERE NOT {_FIT}
  UNION ALL SELECT doc_id, false, 502, 'SUMMARIZATION_FAILED', {lit(o.MESSAGE_NOTHING_TO_SUMMARIZE)} FROM documents WHERE {trim('text')} = ''""",
    "question_requests": f"SELECT doc_id || ':questions' AS request_id, doc_id, {_questions_prompt(_SAMPLE)} AS prompt, 2000 AS max_tokens, true AS json_mode FROM documents WHERE {_FIT}",
    "completion_bodies": f"SELECT doc_id || ':questions' AS request_id, 'any-chat-model' AS model, 2000 AS max_tokens, {lit(prompts.SYSTEM_JSON)} AS system, {_questions_prompt(_SAMPLE)} AS user, 'json_object' AS response_format FROM documents WHERE {_FIT}",
    "answer_requests": f"""WITH RECURSIVE {search_cte(QUESTIONS, f'SELECT doc_id, text FROM documents WHERE {_FIT}')},
picked AS (SELECT doc_id, question_id, any_value(question) AS question, count(*) AS n,
  string_agg('--- Relevant excerpt ' || (chunk_index + 1) || ' ---' || chr(10) || text, chr(10) || chr(10) ORDER BY rank) AS excerpts
  FROM ranked WHERE rank <= 4 GROUP BY doc_id, question_id)
SELECT doc_id || ':answer:' || question_id AS request_id, doc_id, question_id, {_answer_prompt('question', 'excerpts')} AS prompt,
  CAST(n AS INTEGER) AS sources_used, 1200 AS max_tokens, false AS json_mode FROM picked""",
    "parse_completions": f"WITH {_ATTEMPTS} SELECT * FROM shown",
    "normalized_summaries": f"""WITH {_ATTEMPTS}, best AS (SELECT request_id, min(attempt) FILTER (completion_error IS NULL) AS attempt,
  max(completion_error) FILTER (attempt = 2) AS last_error FROM shown GROUP BY request_id)
SELECT b.request_id, b.attempt, b.attempt IS NOT NULL AS success, CASE WHEN b.attempt IS NOT NULL THEN 200 WHEN last_error = 'NO_SUMMARY' THEN 502 ELSE 500 END AS status,
  CASE WHEN b.attempt IS NULL THEN 'SUMMARIZATION_FAILED' END AS error_code,
  CASE WHEN b.attempt IS NULL THEN CASE WHEN last_error = 'NO_SUMMARY' THEN {lit(o.MESSAGE_NO_SUMMARY)} ELSE {lit(o.MESSAGE_SUMMARY_FAILED)} END END AS error_message,
  title, document_type, summary, key_points, main_ideas, entities, action_items
FROM best b LEFT JOIN shown s ON s.request_id = b.request_id AND s.attempt = b.attempt""",
    "suggested_questions": f"""WITH cleaned AS (SELECT doc_id, lang, list_transform(list_filter(string_split(text, chr(10)), lambda x: {trim('x')} <> ''),
    lambda x: {trim('x')} || CASE WHEN ends_with({trim('x')}, '?') THEN '' ELSE '?' END) AS qs FROM documents)
SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE WHEN lang <> 'es' THEN array_to_string(list_slice(list_concat(['Why?'], qs), 1, 7), '|') END AS questions,
  lang <> 'es' AS success, CASE WHEN lang = 'es' THEN 502 ELSE 200 END AS status, CASE WHEN lang = 'es' THEN 'QA_FAILED' END AS error_code,
  CASE WHEN lang = 'es' THEN {lit(o.MESSAGE_QUESTIONS_FAILED)} END AS error_message FROM cleaned""",
    "answers": f"""SELECT CAST(doc_id AS VARCHAR) AS request_id, CASE WHEN lang IN ('en', 'es') THEN {trim('text')} END AS answer, lang IN ('en', 'es') AS success,
  CASE WHEN lang IN ('en', 'es') THEN 200 ELSE 500 END AS status, CASE WHEN lang NOT IN ('en', 'es') THEN 'QA_FAILED' END AS error_code,
  CASE WHEN lang NOT IN ('en', 'es') THEN {lit(o.MESSAGE_ANSWER_FAILED)} END AS error_message FROM documents""",
    "upload_validation": f"WITH {_VALID} SELECT doc_id, error, error_code, status, source_type FROM valid",
    "upload_labels": f"""SELECT doc_id, CASE WHEN file_name IS NULL THEN NULL WHEN contains(file_name, '.') THEN lower(string_split(file_name, '.')[-1]) ELSE '' END AS extension,
  CASE WHEN file_name LIKE '%.pdf' THEN 'PDF' WHEN file_name LIKE '%.PNG' THEN 'PNG' ELSE 'JPG' END AS label,
  CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN (size_bytes * 20 + 1024) // 2048 // 10 || '.' || (size_bytes * 20 + 1024) // 2048 % 10 || ' KB'
    ELSE (size_bytes * 20 + 1048576) // 2097152 // 10 || '.' || (size_bytes * 20 + 1048576) // 2097152 % 10 || ' MB' END AS size FROM ({UPLOADS})""",
    "history_latest": f"WITH latest AS (SELECT * FROM ({WRITES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1) SELECT * EXCLUDE (event_type) FROM latest QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY created_at DESC, seq DESC) <= 100",
    "history_upsert": f"""WITH w AS ({WRITES}), latest AS (SELECT *, event_type = 'error' AS fresh FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_type = 'error' DESC, seq DESC) = 1)
SELECT * EXCLUDE (event_type, fresh) FROM latest QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY fresh AND seq = (SELECT max(seq) FROM w WHERE event_type = 'error') DESC, created_at DESC, seq DESC) <= 100""",
    "history_delete": f"""WITH w AS ({WRITES}), latest AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT * EXCLUDE (event_type) FROM latest WHERE id NOT IN (SELECT id FROM w WHERE event_type = 'signup' GROUP BY id HAVING count(*) > 12)""",
    "history_stats": f"""WITH latest AS (SELECT * FROM ({WRITES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT count(*) AS total, count(DISTINCT coalesce(file_name, id)) AS documents, max(created_at) AS last_activity,
  strftime(CAST(max(created_at)[:19] AS TIMESTAMP), '%b %-d, %Y, %I:%M %p') AS last_label FROM latest""",
    "export_text": EXPORT_TEXT,
    "export_markdown": EXPORT_MARKDOWN,
    "clipboard_text": CLIPBOARD,
    "slugs": f"""SELECT doc_id, CASE WHEN slug = '' THEN 'summary' ELSE slug END || '.md' AS file_name FROM
  (SELECT doc_id, substr(trim(regexp_replace(strip_accents(lower(title)), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug FROM ({SUMMARIES}))""",
    "share_links": f"SELECT doc_id, 'https://example.org/s#d=' || rtrim(translate(base64(encode({_JSON})), '+/', '-_'), '=') AS link FROM ({SUMMARIES})",
    "share_roundtrip": f"""SELECT doc_id, CASE WHEN ok THEN title END AS title, CASE WHEN ok THEN document_type END AS document_type, CASE WHEN ok THEN summary END AS summary,
  CASE WHEN ok THEN array_to_string(key_points, '|') END AS key_points, CASE WHEN ok THEN array_to_string(main_ideas, '|') END AS main_ideas,
  CASE WHEN ok THEN array_to_string(entities, '|') END AS entities, CASE WHEN ok THEN array_to_string(action_items, '|') END AS action_items
FROM (SELECT *, file_name IS NOT NULL AND length <> 'long' AS ok FROM ({SUMMARIES}))""",
    "conversation_answers": f"""SELECT q.question_id, q.doc_id, {trim('q.question')} AS question, a.text AS answer FROM ({USER_QUESTIONS}) q
LEFT JOIN conversations a ON a.role = 'assistant' AND a.conv_id * 1000 + a.turn - 1 = q.question_id WHERE {trim('q.question')} <> '' AND coalesce(length(a.text) >= 60, true)""",
    "asked_questions": f"""SELECT c.conv_id AS doc_id, c.turn, EXISTS (SELECT 1 FROM conversations u WHERE u.role = 'user' AND u.conv_id = c.conv_id AND {trim('u.text')} <> ''
  AND {trim('u.text')} = trim(c.text)) AS was_asked FROM conversations c""",
    "saved_history": f"""WITH {_EXTRACTED} SELECT e.file_name, '2024-01-05T15:04:00.000Z' AS created_at,
  CASE WHEN e.file_name LIKE '%.pdf' THEN 'PDF' WHEN e.file_name LIKE '%.PNG' THEN 'PNG' ELSE 'JPG' END AS source_type_label,
  s.length, e.word_count AS source_word_count, s.title FROM extracted e JOIN ({SUMMARIES}) s ON s.doc_id = e.doc_id WHERE e.success""",
    "resummarize_lengths": f"""WITH RECURSIVE {cuts('SELECT doc_id, text FROM documents', 30000, 2000, 0)},
sections AS (SELECT doc_id, {trim('substr(t, s + 1, e - s)')} AS text, n AS chunk_index, CAST(count(*) OVER (PARTITION BY doc_id) AS INTEGER) AS n_chunks FROM cut)
SELECT doc_id || ':' || l || ':' || CASE WHEN n_chunks = 1 THEN 'direct' ELSE 'section' END || ':' || (chunk_index + 1) AS request_id, doc_id, l AS length, n_chunks,
  CASE WHEN n_chunks = 1 THEN 2000 ELSE 500 END AS max_tokens,
  CASE WHEN n_chunks = 1 THEN {_direct_prompt('text', 'l')} ELSE {_section_prompt('text', '(chunk_index + 1)', 'n_chunks')} END AS prompt
FROM sections, unnest(['short', 'medium', 'long']) AS x(l)""",
}
# What comes back from a store, a sink or a stream is what the plain query gives.
SQL["search_stored_index"] = SQL["retrieve_user_questions"]
SQL["history_store"] = SQL["history_delete"].replace(
    "ORDER BY seq DESC", "ORDER BY event_type = 'error' DESC, seq DESC"
)
SQL["streamed_pages"] = SQL["ocr_work_list"]
SQL["written_exports"] = SQL["export_text"]
SQL["sql_retrieval_chunks"] = f"SELECT doc_id, chunk_index, text FROM ({SQL['retrieval_chunks']})"
SQL["sql_summary_chunks"] = f"SELECT doc_id, chunk_index, start_character, end_character, text_md5 FROM ({SQL['summary_chunks']})"


def _requests(configured: bool) -> str:
    """Bodies made as text and parsed again here; the first rule that holds decides."""
    good = "CAST(json_object('text', text, 'question', source, 'length', 'short') AS VARCHAR)"
    last = "" if configured else "WHEN true THEN [500, 'CONFIG_ERROR', 'The AI service is not configured.']"

    def rules(no_text: str, more: str) -> str:
        return f"""CASE WHEN j IS NULL THEN ['400', 'INVALID_INPUT', {lit(o.MESSAGE_NOT_JSON)}]
          WHEN coalesce({trim('text')}, '') = '' THEN ['400', 'INVALID_INPUT', {lit(no_text)}] {more} {last.replace('500', "'500'")} END"""

    def field(name: str) -> str:
        return f"CASE WHEN json_type(j, '$.{name}') = 'VARCHAR' THEN json_extract_string(j, '$.{name}') END AS {name}"

    blank = f"WHEN coalesce({trim('question')}, '') = '' THEN ['400', 'INVALID_INPUT', {lit(o.MESSAGE_NO_QUESTION)}]"
    shown = "text, detail, r IS NULL AS success, coalesce(CAST(r[1] AS INTEGER), 200) AS status, r[2] AS error_code, r[3] AS error_message"
    return f"""WITH bodies AS (SELECT doc_id, CASE lang WHEN 'fr' THEN {good} || ' trailing' WHEN 'de' THEN CAST(json_object('text', doc_id) AS VARCHAR)
    WHEN 'es' THEN CAST(json_object('text', text, 'question', ' ', 'length', 'gigantic') AS VARCHAR) ELSE {good} END AS body FROM documents),
read AS (SELECT doc_id, {field('text')}, {field('question')}, {field('length')}, j FROM (SELECT doc_id, TRY_CAST(body AS JSON) AS j FROM bodies)),
ruled AS (SELECT doc_id, 'answer' AS kind, text, question AS detail, {rules(o.MESSAGE_NO_TEXT, blank)} AS r FROM read
  UNION ALL SELECT doc_id, 'summarize', text, {_KNOWN.format("coalesce(length, '')")}, {rules(o.MESSAGE_NO_TEXT_TO_SUMMARIZE, '')} FROM read)
SELECT doc_id, kind, {shown} FROM ruled"""


SQL["request_checks"], SQL["unconfigured_requests"] = _requests(True), _requests(False)
SQL["written_requests"] = f"""SELECT doc_id || ':questions' AS request_id, CAST(0.2 AS DOUBLE) AS temperature, 'false' AS reasoning, 2000 AS max_tokens,
  md5({_questions_prompt(_SAMPLE)}) AS prompt_md5 FROM documents WHERE {_FIT}"""
SQL["scanned_responses"] = f"SELECT request_id, answer, success, status FROM ({SQL['answers']})"
_STORED = """stored AS (SELECT event_id, '[{"id":"' || CASE event_type WHEN 'signup' THEN '' ELSE 'u' || user_id END || '","createdAt":'
    || CASE event_type WHEN 'error' THEN '7' ELSE '"2024-01-01T00:00:00.000Z"' END || CASE event_type WHEN 'click' THEN '' ELSE ',"fileName":null' END
    || ',"sourceTypeLabel":"PDF","length":"' || CASE event_type WHEN 'purchase' THEN 'huge' ELSE 'short' END || '","sourceWordCount":' || user_id || ',"summary":'
    || json_object('title', 't', 'documentType', 'd', 'summary', event_type, 'keyPoints', [event_type], 'mainIdeas', [props],
      'entities', []::VARCHAR[], 'actionItems', []::VARCHAR[])::VARCHAR || '},3,null]' AS value FROM events),
items AS (SELECT event_id, i - 1 AS position, list[i] AS x FROM (SELECT event_id, CAST(CAST(value AS JSON) AS JSON[]) AS list FROM stored),
  unnest(range(1, len(list) + 1)) AS u(i)),
entries AS (SELECT event_id, CAST(position AS INTEGER) AS position, x ->> '$.id' AS id, x ->> '$.createdAt' AS created_at, x ->> '$.fileName' AS file_name,
    x ->> '$.sourceTypeLabel' AS source_type_label, x ->> '$.length' AS length, CAST(x ->> '$.sourceWordCount' AS BIGINT) AS words,
    x ->> '$.summary.summary' AS summary, array_to_string(CAST(json_extract(x, '$.summary.keyPoints') AS VARCHAR[]), '|') AS key_points
  FROM items WHERE json_type(x, '$.id') = 'VARCHAR' AND x ->> '$.id' <> '' AND json_type(x, '$.createdAt') = 'VARCHAR'
    AND json_type(x, '$.fileName') IN ('VARCHAR', 'NULL') AND json_type(x, '$.sourceTypeLabel') IN ('VARCHAR', 'NULL')
    AND json_type(x, '$.length') = 'VARCHAR' AND x ->> '$.length' IN ('short', 'medium', 'long')
    AND json_type(x, '$.sourceWordCount') IN ('BIGINT', 'UBIGINT', 'DOUBLE', 'NULL')
    AND json_type(x, '$.summary.title') = 'VARCHAR' AND json_type(x, '$.summary.documentType') = 'VARCHAR' AND json_type(x, '$.summary.summary') = 'VARCHAR'
    AND json_type(x, '$.summary.keyPoints') = 'ARRAY' AND json_type(x, '$.summary.mainIdeas') = 'ARRAY'
    AND json_type(x, '$.summary.entities') = 'ARRAY' AND json_type(x, '$.summary.actionItems') = 'ARRAY')"""
SQL["history_valid_entries"] = f"""WITH {_STORED} SELECT event_id, position, id, created_at, file_name, source_type_label,
  upper(length[1]) || length[2:] AS length_label, format('{{:,}}', words) || ' words' AS words_label, summary, key_points FROM entries"""
SQL["imported_history"] = f"""WITH {_STORED} SELECT id, created_at, file_name, length, CAST(-position AS BIGINT) AS seq, count(*) AS entries
FROM entries GROUP BY ALL"""
SQL["history_order"] = f"""WITH last AS (SELECT * FROM ({WRITES}) QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT id, created_at, seq, CAST(row_number() OVER (ORDER BY created_at DESC, seq DESC, id) - 1 AS BIGINT) AS position FROM last"""
SQL["history_cleared"] = f"""SELECT id, created_at, file_name, length, seq FROM ({WRITES}) WHERE event_type = 'error'
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""
SQL["streamed_documents"] = SQL["combined_documents"]
SQL["streamed_history"] = f"""SELECT id, created_at, file_name, length, seq FROM ({WRITES})
QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1"""

_ROUNDS = f"""{_ATTEMPTS},
came AS (SELECT s.* REPLACE (CASE WHEN lost THEN 'UNREACHABLE' ELSE completion_error END AS completion_error),
    CASE WHEN lost OR completion_error IS NOT NULL THEN NULL ELSE s.attempt END AS good
  FROM (SELECT *, attempt = 1 AND CAST(request_id AS BIGINT) % 13 = 0 AS lost FROM shown) s),
asked AS (SELECT * FROM came t WHERE attempt = 1
  OR EXISTS (SELECT 1 FROM came f WHERE f.request_id = t.request_id AND f.attempt = 1 AND f.good IS NULL))"""
SQL["attempt_rounds"] = f"""WITH {_ROUNDS} SELECT attempt, count(*) AS asked, count(completion_error) AS failed FROM asked GROUP BY attempt"""
SQL["second_attempts"] = f"""WITH {_ROUNDS},
last AS (SELECT * FROM asked QUALIFY row_number() OVER (PARTITION BY request_id ORDER BY attempt DESC) = 1)
SELECT request_id, good AS attempt, completion_error, good IS NOT NULL AS success,
  CASE WHEN good IS NOT NULL THEN 200 WHEN completion_error = 'NO_SUMMARY' THEN 502 ELSE 500 END AS status,
  CASE WHEN good IS NULL THEN 'SUMMARIZATION_FAILED' END AS error_code,
  CASE WHEN good IS NULL THEN CASE WHEN completion_error = 'NO_SUMMARY' THEN {lit(o.MESSAGE_NO_SUMMARY)} ELSE {lit(o.MESSAGE_SUMMARY_FAILED)} END END AS error_message,
  CASE WHEN good IS NOT NULL THEN title END AS title, CASE WHEN good IS NOT NULL THEN document_type END AS document_type,
  CASE WHEN good IS NOT NULL THEN summary END AS summary, CASE WHEN good IS NOT NULL THEN key_points END AS key_points,
  CASE WHEN good IS NOT NULL THEN main_ideas END AS main_ideas, CASE WHEN good IS NOT NULL THEN entities END AS entities,
  CASE WHEN good IS NOT NULL THEN action_items END AS action_items FROM last"""

_FLOW_TEXTS = "SELECT doc_id, text FROM extracted WHERE success"
SQL["panel_flow"] = f"""WITH RECURSIVE {_EXTRACTED}, {cuts(_FLOW_TEXTS, 30000, 2000, 0)},
flow_pieces AS (SELECT doc_id, n, {trim('substr(t, s + 1, e - s)')} AS text FROM cut),
parts AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n) AS INTEGER) AS part,
    count(*) OVER (PARTITION BY doc_id) AS parts, text FROM flow_pieces WHERE text <> ''),
wanted AS (SELECT * FROM parts, unnest(['short', 'long']) AS l(length)),
noted AS (SELECT doc_id, length, string_agg('--- Section ' || part || ' ---' || chr(10) || md5({_section_prompt('text', 'part', 'parts')}),
    chr(10) || chr(10) ORDER BY part) AS sections, bool_or(doc_id % 2 = 0) AS refused FROM wanted WHERE parts > 1 GROUP BY doc_id, length),
made AS (
  SELECT doc_id, length, doc_id || ':' || length || ':direct:1' AS request, md5({_direct_prompt('text', 'length')}) AS summary FROM wanted WHERE parts = 1
  UNION ALL
  SELECT doc_id, length, doc_id || ':' || length || ':final', md5({_final_prompt('sections', 'length')}) FROM noted WHERE NOT refused)
SELECT sha256(m.doc_id || '|' || m.length || '|' || '{{"title":"On ' || request || '","document_type":"Document","summary":"' || summary
    || '","key_points":[],"main_ideas":[],"entities":[],"action_items":[]}}') AS id,
  CASE m.length WHEN 'short' THEN '2024-01-01T00:00:00.000Z' ELSE '2024-01-02T00:00:00.000Z' END AS created_at, file_name,
  CASE WHEN file_name LIKE '%.pdf' THEN 'PDF' WHEN file_name LIKE '%.PNG' THEN 'PNG' ELSE 'JPG' END AS source_type_label,
  m.length, word_count AS source_word_count, 'On ' || request AS title, summary FROM made m JOIN extracted e ON e.doc_id = m.doc_id"""
