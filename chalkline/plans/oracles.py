"""Check SQL: for each query the same result in plain ANSI-style SQL, written the direct way."""

from __future__ import annotations

from chalkline import fixed_values as V
from chalkline.plans.fixtures import check_sql
from chalkline.plans.queries import CHANGE_THRESHOLD, PROMPT_WORDS, SCENE_THRESHOLD

SP = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)
LETTER = r"\p{L}\p{N}_"


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"trim({x}, {lit(CHARS)})"


def words(x: str) -> str:
    return f"list_filter(regexp_split_to_array({x}, '{SP}+'), lambda w: w <> '')"


def word_set(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[{LETTER}]+'))"


def similarity(a: str, b: str) -> str:
    return (
        f"CASE WHEN least(len({a}), len({b})) = 0 THEN 0.0 "
        f"ELSE len(list_intersect({a}, {b}))::DOUBLE / least(len({a}), len({b})) END"
    )


def windows(source: str, text: str, keep: str, size: int, step: int) -> str:
    return f"""SELECT {keep}, n_words, CAST(start / {step} AS INT) AS pos, CAST(start AS INT) AS start,
        array_to_string(w[start + 1:start + {size}], ' ') AS chunk
        FROM (SELECT *, len(w) AS n_words, unnest(range(0, len(w), {step})) AS start
              FROM (SELECT *, {words(text)} AS w FROM {source}) a) b"""


def clock(t: str) -> str:
    return f"printf('%02d:%02d', CAST(floor({t} / 60) AS BIGINT), CAST(floor({t} % 60) AS BIGINT))"


def minute(t: str) -> str:
    return f"printf('[%02dmin]', CAST(floor({t} / 60) AS BIGINT))"


def split_lines(x: str) -> str:
    cut = rf"regexp_replace({x}, '\]{SP}', ']' || chr(10), 'g')"
    return f"list_filter(list_transform(string_split({cut}, chr(10)), lambda s: {strip('s')}), lambda s: s <> '')"


def clean_line(x: str) -> str:
    return strip(rf"regexp_replace({x}, '^\[\p{{Nd}}+min\]{SP}*', '')")


def math_test(x: str) -> str:
    """The fixed patterns with Unicode word edges and digits spelled out for this engine."""
    left, right = f"(^|[^{LETTER}])", f"($|[^{LETTER}])"
    nd, sp = r"\p{Nd}", SP
    tests = [
        r"[=\+\-\*/\^]",
        r"[α-ωΑ-Ω]",
        f"{nd}+{sp}*[/]{sp}*{nd}+",
        r"[A-Z]\([a-z]\)",
        f"{left}(lim|inf|sup|max|min|sum|prod){right}",
        f"{left}(dB|Hz|rad|omega|sigma|delta|mu){right}",
        "[<>≤≥≈≠∞∂∫∑∏√]",
        f"{left}{nd}+{sp}*(dB|Hz|rad/s){right}",
        rf"[A-Za-z]+{sp}*[=]{sp}*[A-Za-z0-9\(\)\+\-\*/\^]+",
    ]
    return "(" + " OR ".join(f"regexp_matches({x}, '{t}')" for t in tests) + ")"


def collection(x: str) -> str:
    name = f"substr(regexp_replace(translate(lower({x}), ' -', '__'), '[^{LETTER}]', '', 'g'), 1, 63)"
    return f"CASE WHEN length({name}) < 3 THEN {name} || '_course' ELSE {name} END"


def file_safe(x: str) -> str:
    return strip(f"regexp_replace({x}, '[<>:\"/\\\\|?*]', '', 'g')")


def title_date(x: str) -> str:
    d = f"nullif(regexp_extract({x}, '(\\p{{Nd}}{{8}})', 1), '')"
    return f"substr({d}, 1, 4) || '-' || substr({d}, 5, 2) || '-' || substr({d}, 7, 2)"


def stem_date(x: str) -> str:
    head = f"split_part({x}, '_', 1)"
    return f"CASE WHEN length({head}) = 10 THEN {head} ELSE 'unknown' END"


def notes_file(course: str, date: str, suffix: str) -> str:
    parts = f"string_split({date}, '-')"
    day = f"CASE WHEN len({parts}) = 3 THEN {parts}[3] || '-' || {parts}[2] || '-' || {parts}[1] ELSE {date} END"
    tail = f"CASE WHEN coalesce({suffix}, '') <> '' THEN ' - ' || {file_safe(suffix)} ELSE '' END"
    return f"({day}) || '_' || {file_safe(course)} || ({tail}) || '.pdf'"


MEDIA = "(" + " OR ".join(
    [f"contains(url, '{e}')" for e in V.MEDIA_EXTENSIONS] + [f"contains(lower(url), '{k}')" for k in V.MEDIA_KEYWORDS]
) + ")"

FENCES = strip(
    f"regexp_replace(regexp_replace(raw, '(?m)^```(?:latex|tex)?{SP}*', '', 'g'), '(?m)```{SP}*$', '', 'g')"
)
VERDICT = strip(f"replace(replace({strip('raw')}, '```json', ''), '```', '')")
FRAME_TYPE = """CASE WHEN gray_mean > 180 AND gray_std < 60 THEN 'slide'
    WHEN gray_mean < 80 THEN 'blackboard' ELSE 'tablet' END"""
INDEX_COLUMNS = "id, collection, course, lecture_date, source, chunk_index, document"


def index_rows(source: str) -> str:
    size, overlap = V.INDEX_CHUNK_WORDS, V.INDEX_OVERLAP_WORDS
    cut = windows(source, "transcript", "lecture_id, course, lecture_date, source", size, size - overlap)
    return f"""SELECT lecture_id, concat_ws('_', course, lecture_date, source, CAST(pos AS VARCHAR)) AS id,
        {collection('course')} AS collection, course, lecture_date, source, pos AS chunk_index, chunk AS document
        FROM ({cut}) c"""


def last_by(source: str, keys: str, order: str) -> str:
    return f"SELECT * FROM {source} QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY {order} DESC) = 1"


def hashed(source: str, key: str, text: str, dim: int = 64) -> str:
    return f"""SELECT {key}, dim, n / sqrt(sum(n * n) OVER (PARTITION BY {key})) AS x
        FROM (SELECT {key}, dim, CAST(count(*) AS DOUBLE) AS n
              FROM (SELECT {key}, CAST(CAST('0x' || substr(md5(word), 1, 8) AS BIGINT) % {dim} AS INT) AS dim
                    FROM (SELECT {key}, unnest(regexp_extract_all(lower({text}), '[{LETTER}]+')) AS word FROM {source}) a) b
              GROUP BY {key}, dim) c"""


def with_sums(rows: str) -> str:
    """Index rows with the position-weighted sum of their hashed vectors."""
    return f"""SELECT {INDEX_COLUMNS}, round(coalesce(total, 0.0), 4) AS embedding_sum FROM {rows}
        LEFT JOIN (SELECT id AS vid, sum(x * (dim + 1)) AS total FROM ({hashed(rows, 'id', 'document')}) h GROUP BY id) v
        ON vid = id"""


def distance(a: str, b: str) -> str:
    return (
        f"round(list_sum(list_transform(list_zip({a}::DOUBLE[], {b}::DOUBLE[]), "
        "lambda p: (p[1] - p[2]) * (p[1] - p[2]))), 6)"
    )


EXTRA: dict[str, str] = {
    "noted_lectures": """SELECT lecture_id, course, lecture_date, transcript FROM lectures
        UNION ALL SELECT lecture_id, course, lecture_date, transcript FROM untranscribed""",
    "noted_aligned": """SELECT CASE WHEN lecture_id % 2 = 1 THEN -1 - lecture_id ELSE lecture_id END AS lecture_id,
        frame_index, timestamp_sec, speech, ocr_text FROM aligned""",
    "aligned": """SELECT f.lecture_id, f.frame_index, f.timestamp_sec,
        coalesce(string_agg(s.text, ' ' ORDER BY s.id), '') AS speech, f.raw_text AS ocr_text, f.is_slide, f.image_path
        FROM ocr_frames f LEFT JOIN segments s ON s.lecture_id = f.lecture_id
        AND (abs(s.start_sec - f.timestamp_sec) < 30 OR (s.start_sec <= f.timestamp_sec AND f.timestamp_sec <= s.end_sec))
        GROUP BY f.lecture_id, f.frame_index, f.timestamp_sec, f.raw_text, f.is_slide, f.image_path""",
    "blocks": f"""SELECT lecture_id, frame_index, w[i + 1] AS text, i,
        CAST((frame_index * 31 + i * 37) % 100 AS DOUBLE) / 100.0 AS confidence
        FROM (SELECT *, unnest(range(0, len(w))) AS i FROM (SELECT *, {words('raw_text')} AS w FROM ocr_frames) a) b""",
    "kept_blocks": f"""SELECT * FROM blocks WHERE confidence > 0.3 AND length({strip('text')}) > 1""",
    "sourced": "SELECT *, 'transcript' AS source FROM lectures",
    "index_base": last_by(f"({index_rows('sourced')}) q", "id", "lecture_id"),
    "resourced": """SELECT lecture_id, course, lecture_date, source, 'Second reading: ' || transcript AS transcript
        FROM sourced WHERE language <> 'en'""",
    "index_again": last_by(f"({index_rows('resourced')}) q", "id", "lecture_id"),
    "index_upserted": f"""SELECT {INDEX_COLUMNS} FROM index_again UNION ALL
        SELECT {INDEX_COLUMNS} FROM index_base WHERE id NOT IN (SELECT id FROM index_again)""",
    "page_joined": """SELECT file_id, string_agg(text, chr(10) || chr(10) ORDER BY page_no) AS transcript
        FROM page_text WHERE text <> '' GROUP BY file_id""",
    "page_lectures": f"""SELECT p.file_id AS lecture_id, f.course, {stem_date('f.stem')} AS lecture_date, 'pdf' AS source,
        p.transcript FROM page_joined p JOIN files f ON f.id = p.file_id WHERE contains(lower(f.stem), lower(f.course))""",
    "page_index": last_by(f"({index_rows('page_lectures')}) q", "id", "lecture_id"),
    "slide_lines": f"""SELECT lecture_id, frame_index, CAST(generate_subscripts(p, 1) - 1 AS INT) AS line_no, unnest(p) AS line
        FROM (SELECT lecture_id, frame_index, {split_lines('raw_text')} AS p FROM ocr_frames) a""",
    "spoken": """SELECT lecture_id, string_agg(text, ' ' ORDER BY id) AS transcript
        FROM spoken_turns GROUP BY lecture_id""",
    "spoken_windows": f"""SELECT lecture_id, {word_set('chunk')} AS ws
        FROM ({windows('spoken', 'transcript', 'lecture_id', 50, 25)}) x""",
    "verdict_rows": f"""SELECT *, CASE WHEN json_valid({VERDICT}) THEN {VERDICT} END AS js FROM verdicts""",
    "accepted": """SELECT lecture_id, ord, timestamp_sec, coalesce(json_extract_string(js, '$.caption'), '') AS caption,
        coalesce(json_extract_string(js, '$.reason'), '') AS reason
        FROM verdict_rows WHERE json_extract_string(js, '$.include') = 'true'""",
    "cleaned": f"SELECT lecture_id, chunk_idx, {FENCES} AS document FROM responses",
    "hists": """SELECT i.id, b.bin, count(s.v) AS n FROM (SELECT DISTINCT id FROM samples) i
        CROSS JOIN (SELECT CAST(unnest(range(0, 64)) AS INT) AS bin) b
        LEFT JOIN samples s ON s.id = i.id AND CAST(floor(s.v / 4) AS INT) = b.bin GROUP BY i.id, b.bin""",
    "vq": "SELECT * FROM vectors",
    "vtop": f"""SELECT q.id AS query_id, v.collection, v.id, {distance('q.embedding', 'v.embedding')} AS distance
        FROM vq q JOIN vectors v ON v.collection = q.collection
        QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, v.id) <= 5""",
    "told_vectors": "SELECT v.*, l.lecture_date, l.transcript FROM vectors v JOIN lectures l ON l.lecture_id = v.id",
    "told_top": f"""SELECT q.id AS query_id, v.id, v.lecture_date, v.transcript,
        {distance('q.embedding', 'v.embedding')} AS distance FROM vq q JOIN told_vectors v ON v.collection = q.collection
        QUALIFY row_number() OVER (PARTITION BY q.id ORDER BY distance, v.id) <= 5""",
    "ask_texts": f"SELECT lecture_id, course, array_to_string({words('transcript')}[1:200], ' ') AS ask FROM lectures",
    "ask_vectors": hashed("ask_texts", "lecture_id", "ask"),
    "doc_vectors": hashed("index_base", "id", "document"),
    "ask_norms": "SELECT lecture_id, sum(x * x) AS nn FROM ask_vectors GROUP BY lecture_id",
    "doc_norms": "SELECT id, sum(x * x) AS nn FROM doc_vectors GROUP BY id",
    "ask_dots": """SELECT a.lecture_id, d.id, sum(a.x * d.x) AS dot FROM ask_vectors a
        JOIN ask_texts t ON t.lecture_id = a.lecture_id JOIN index_base b ON b.course = t.course
        JOIN doc_vectors d ON d.id = b.id AND d.dim = a.dim GROUP BY a.lecture_id, d.id""",
    "ask_top": """SELECT t.lecture_id, b.id, b.lecture_date, b.document,
        round(greatest(coalesce(an.nn, 0) + coalesce(dn.nn, 0) - 2 * coalesce(p.dot, 0), 0), 6) AS distance
        FROM ask_texts t JOIN index_base b ON b.course = t.course
        LEFT JOIN ask_norms an ON an.lecture_id = t.lecture_id LEFT JOIN doc_norms dn ON dn.id = b.id
        LEFT JOIN ask_dots p ON p.lecture_id = t.lecture_id AND p.id = b.id
        QUALIFY row_number() OVER (PARTITION BY t.lecture_id ORDER BY distance, b.id) <= 5""",
    "prompt_context": f"""SELECT lecture_id, string_agg('[Lecture ' || lecture_date || ', transcript]' || chr(10) || document,
        {lit(V.BLOCK_SEPARATOR)} ORDER BY distance, id) AS context FROM ask_top GROUP BY lecture_id""",
    "ocr_first": f"""SELECT lecture_id, ocr_text, timestamp_sec, frame_index FROM (
        SELECT lecture_id, {strip('ocr_text')} AS ocr_text, timestamp_sec, frame_index FROM aligned) a
        WHERE ocr_text <> ''
        QUALIFY row_number() OVER (PARTITION BY lecture_id, ocr_text ORDER BY timestamp_sec, frame_index) = 1""",
    "noted_ocr_first": f"""SELECT lecture_id, ocr_text, timestamp_sec, frame_index FROM (
        SELECT lecture_id, {strip('ocr_text')} AS ocr_text, timestamp_sec, frame_index FROM noted_aligned) a
        WHERE ocr_text <> ''
        QUALIFY row_number() OVER (PARTITION BY lecture_id, ocr_text ORDER BY timestamp_sec, frame_index) = 1""",
    "ocr_answer": f"""SELECT l.call_id, count(a.frame_index) AS near,
        string_agg(CASE WHEN {strip('a.ocr_text')} <> '' THEN '[' || {clock('a.timestamp_sec')} || '] ' || {strip('a.ocr_text')} END,
          chr(10) ORDER BY a.timestamp_sec, a.frame_index) AS lines
        FROM lookups l LEFT JOIN aligned a
        ON a.lecture_id = l.lecture_id AND abs(a.timestamp_sec - coalesce(l.timestamp_seconds, 0)) <= coalesce(l.window_seconds, 60)
        GROUP BY l.call_id""",
    "ocr_result": """SELECT l.call_id, CASE WHEN near = 0 THEN 'No OCR data found within ' || coalesce(CAST(window_seconds AS VARCHAR), '60')
          || 's of timestamp ' || coalesce(CAST(timestamp_seconds AS VARCHAR), '0') || 's.'
        WHEN lines IS NULL THEN 'Frames found near ' || coalesce(CAST(timestamp_seconds AS VARCHAR), '0') || 's but no OCR text extracted.'
        ELSE lines END AS result FROM lookups l JOIN ocr_answer a ON a.call_id = l.call_id""",
    "figure_near": """SELECT l.call_id, coalesce(l.timestamp_seconds, 0) AS at,
        arg_min(f, (abs(f.timestamp_sec - coalesce(l.timestamp_seconds, 0)), f.ord)) AS f
        FROM lookups l JOIN figures f ON f.lecture_id = l.lecture_id GROUP BY l.call_id, l.timestamp_seconds""",
    "figure_result": f"""SELECT l.call_id, CASE WHEN n.f IS NULL THEN '{V.NO_FIGURES}' ELSE
        'Closest figure (' || CAST(CAST(round_even(abs(n.f.timestamp_sec - n.at), 0) AS BIGINT) AS VARCHAR)
        || 's away):' || chr(10) || '  latex_path: ' || n.f.latex_path || chr(10) || '  caption: ' || n.f.caption
        || chr(10) || '  timestamp: ' || printf('%.1f', n.f.timestamp_sec) || 's' END AS result
        FROM lookups l LEFT JOIN figure_near n ON n.call_id = l.call_id""",
    "search_windows": f"""SELECT *, lower(chunk) AS low
        FROM ({windows('lectures', 'transcript', 'lecture_id', 100, 50)}) x""",
    "search_calls": f"""SELECT DISTINCT lecture_id, query, unnest({words('lower(query)')}) AS term
        FROM lookups WHERE tool = 'search_transcript'""",
    "search_hits": """SELECT c.lecture_id, c.query, w.start, w.n_words, w.chunk, count(*) AS score
        FROM search_calls c JOIN search_windows w ON w.lecture_id = c.lecture_id AND contains(w.low, c.term)
        GROUP BY c.lecture_id, c.query, w.start, w.n_words, w.chunk
        QUALIFY row_number() OVER (PARTITION BY c.lecture_id, c.query ORDER BY score DESC, w.start) <= 3""",
    "search_text": f"""SELECT lecture_id, query, string_agg('[Position: ~'
        || CAST(CAST(round_even(100.0 * start / n_words, 0) AS INT) AS VARCHAR) || '% through lecture]' || chr(10) || chunk,
        {lit(V.BLOCK_SEPARATOR)} ORDER BY score DESC, start) AS result FROM search_hits GROUP BY lecture_id, query""",
    "asked_terms": f"""SELECT query_id, lecture_id, unnest({words('lower(query)')}) AS term FROM queries""",
    "told": "SELECT lecture_id, string_agg(text, ' ' ORDER BY id) AS transcript FROM segments GROUP BY lecture_id",
    "told_window_rows": f"""SELECT lecture_id, start, {word_set('chunk')} AS ws
        FROM ({windows('told', 'transcript', 'lecture_id', 50, 25)}) x""",
    "slide_sets": f"""SELECT lecture_id, CAST(frame_index AS INT) * 4096 + line_no AS line_id, {word_set('line')} AS ls
        FROM slide_lines""",
    "numbered": "SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) AS n FROM frame_scores",
    "walk": f"""SELECT lecture_id, ord, score, n, score AS kept, true AS keep FROM numbered WHERE n = 1
        UNION ALL SELECT r.lecture_id, r.ord, r.score, r.n,
          CASE WHEN abs(r.score - w.kept) > {CHANGE_THRESHOLD} THEN r.score ELSE w.kept END,
          abs(r.score - w.kept) > {CHANGE_THRESHOLD}
        FROM walk w JOIN numbered r ON r.lecture_id = w.lecture_id AND r.n = w.n + 1""",
    "scenes": """SELECT id % 10 AS lecture_id, id AS ord, list(CAST(n AS DOUBLE) ORDER BY bin) AS h,
        row_number() OVER (PARTITION BY id % 10 ORDER BY id) AS n FROM hists GROUP BY id""",
    "scene_walk": f"""SELECT lecture_id, ord, n, h AS kept, true AS keep FROM scenes WHERE n = 1
        UNION ALL SELECT lecture_id, ord, n, CASE WHEN d > {SCENE_THRESHOLD} THEN h ELSE kept END, d > {SCENE_THRESHOLD}
        FROM (SELECT r.lecture_id, r.ord, r.n, r.h, w.kept, CASE WHEN list_sum(r.h) * list_sum(w.kept) = 0 THEN 1.0 ELSE sqrt(greatest(0.0, 1
          - list_sum(list_transform(list_zip(r.h, w.kept), lambda p: sqrt(p[1] * p[2]))) / sqrt(list_sum(r.h) * list_sum(w.kept)))) END AS d
          FROM scene_walk w JOIN scenes r ON r.lecture_id = w.lecture_id AND r.n = w.n + 1) x""",
    "prompt_transcripts": """SELECT l.lecture_id, coalesce(l.transcript,
          (SELECT string_agg(a.speech, ' ' ORDER BY a.timestamp_sec, a.frame_index) FROM noted_aligned a
           WHERE a.lecture_id = l.lecture_id AND a.speech <> ''), '') AS transcript FROM noted_lectures l""",
    "prompt_parts": f"""SELECT lecture_id, CAST(0 AS INT) AS chunk_idx, transcript AS chunk
        FROM (SELECT *, {words('transcript')} AS w FROM prompt_transcripts) a WHERE len(w) <= {PROMPT_WORDS}
        UNION ALL SELECT lecture_id, pos, chunk
        FROM ({windows('prompt_transcripts', 'transcript', 'lecture_id', PROMPT_WORDS, PROMPT_WORDS)}) b WHERE n_words > {PROMPT_WORDS}""",
    "prompt_parts_whole": f"""SELECT lecture_id, CAST(0 AS INT) AS chunk_idx, transcript AS chunk
        FROM (SELECT *, {words('transcript')} AS w FROM prompt_transcripts) a WHERE len(w) <= {V.PROMPT_CHUNK_WORDS}
        UNION ALL SELECT lecture_id, pos, chunk FROM ({windows('prompt_transcripts', 'transcript', 'lecture_id', V.PROMPT_CHUNK_WORDS, V.PROMPT_CHUNK_WORDS)}) b
        WHERE n_words > {V.PROMPT_CHUNK_WORDS}""",
    "prompt_lines": f"""SELECT lecture_id, timestamp_sec, frame_index, generate_subscripts(p, 1) AS line_no, unnest(p) AS line
        FROM (SELECT *, {split_lines(minute('timestamp_sec') + " || ' ' || ocr_text")} AS p FROM noted_ocr_first) a""",
    "prompt_windows": f"""SELECT lecture_id, {word_set('chunk')} AS ws
        FROM ({windows('prompt_transcripts', 'transcript', 'lecture_id', 50, 25)}) x""",
    "prompt_kept": f"""SELECT * FROM (SELECT lecture_id, timestamp_sec, frame_index, line_no, {clean_line('line')} AS line FROM prompt_lines) c
        WHERE length(line) >= 3 AND NOT EXISTS (SELECT 1 FROM prompt_windows w WHERE w.lecture_id = c.lecture_id
          AND {similarity(word_set('c.line'), 'w.ws')} > 0.7)
        QUALIFY row_number() OVER (PARTITION BY lecture_id, regexp_replace(lower(line), '{SP}+', ' ', 'g')
          ORDER BY timestamp_sec, frame_index, line_no) = 1""",
    "prompt_ocr": """SELECT lecture_id, string_agg(line, chr(10) ORDER BY timestamp_sec, frame_index, line_no) AS ocr
        FROM prompt_kept GROUP BY lecture_id""",
    "prompt_figures": f"""SELECT lecture_id, string_agg('[' || {clock('timestamp_sec')} || '] latex_path=' || latex_path
        || ' caption=' || caption || chr(10), '' ORDER BY ord) AS figs FROM figures GROUP BY lecture_id""",
    "notes_runs": f"""SELECT 1 AS run, lecture_id, {notes_file('course', 'lecture_date', "''")} AS notes_key, transcript AS document FROM lectures
        UNION ALL SELECT 2, lecture_id, {notes_file('course', 'lecture_date', "''")}, 'Revised. ' || transcript FROM lectures WHERE language = 'fr'
        UNION ALL SELECT 2, lecture_id, {notes_file('course', 'lecture_date', "'Part 2'")}, 'Continued. ' || transcript FROM lectures WHERE language = 'de'""",
}

NOT_SPOKEN = f"""NOT EXISTS (SELECT 1 FROM spoken_windows w WHERE w.lecture_id = c.lecture_id
    AND {similarity(word_set('c.line'), 'w.ws')} > 0.7)"""


def filtered(extra_test: str) -> str:
    return f"""SELECT e.lecture_id, coalesce(k.t, '') AS ocr_filtered
        FROM (SELECT DISTINCT lecture_id FROM ocr_frames) e LEFT JOIN (
          SELECT lecture_id, string_agg(line, chr(10) ORDER BY frame_index, line_no) AS t FROM ({kept_lines(extra_test)}) x
          GROUP BY lecture_id) k ON k.lecture_id = e.lecture_id"""


def kept_lines(extra_test: str) -> str:
    return f"""SELECT * FROM (SELECT lecture_id, frame_index, line_no, {clean_line('line')} AS line FROM slide_lines) c
        WHERE length(line) >= 3 AND {extra_test} AND {NOT_SPOKEN}
        QUALIFY row_number() OVER (PARTITION BY lecture_id, regexp_replace(lower(line), '{SP}+', ' ', 'g')
          ORDER BY frame_index, line_no) = 1"""


def image_route(vision: str) -> str:
    return f"""SELECT lecture_id, {vision} AS vision, frame_type,
        CASE WHEN frame_type <> 'slide' AND {vision} THEN 'vision' ELSE 'standard' END AS engine,
        CASE WHEN frame_type = 'slide' THEN 'none' WHEN NOT {vision} THEN 'equalise'
          WHEN frame_type = 'blackboard' THEN 'contrast' ELSE 'none' END AS preprocess
        FROM (SELECT lecture_id, {FRAME_TYPE} AS frame_type FROM frame_stats) a"""


def prompts(context: bool, parts: str = "prompt_parts") -> str:
    def section(cond: str, *parts: str) -> str:
        return f"CASE WHEN p.chunk_idx = 0 AND {cond} THEN {' || '.join(parts)} ELSE '' END"

    ocr = section(f"coalesce({strip('o.ocr')}, '') <> ''", lit(V.PROMPT_OCR_HEAD), "o.ocr", "chr(10)")
    figs = section("f.figs IS NOT NULL", lit(V.PROMPT_FIGURES_HEAD), "f.figs", lit(V.PROMPT_FIGURES_TAIL))
    told, told_join = "''", ""
    if context:
        told = section("coalesce(c.context, '') <> ''", lit(V.PROMPT_CONTEXT_HEAD), "c.context", "chr(10)")
        told_join = "LEFT JOIN prompt_context c ON c.lecture_id = p.lecture_id"
    return f"""SELECT p.lecture_id, p.chunk_idx, {lit(V.PROMPT_HEAD)} || l.course || {lit(V.PROMPT_DATE)} || l.lecture_date
        || {lit(V.PROMPT_TRANSCRIPT)} || p.chunk || chr(10) || {ocr} || {figs} || {told}
        || {lit(V.PROMPT_TAIL)} AS prompt
        FROM {parts} p JOIN noted_lectures l ON l.lecture_id = p.lecture_id
        LEFT JOIN prompt_ocr o ON o.lecture_id = p.lecture_id LEFT JOIN prompt_figures f ON f.lecture_id = p.lecture_id
        {told_join}"""


BODY = r"regexp_extract(document, '(?s)\\begin\{document\}(.*?)\\end\{document\}', 1)"
HEAD = r"regexp_extract(document, '(?s)^(.*?\\begin\{document\})', 1)"

SQL: dict[str, str] = {
    "segments_scan": f"""SELECT s.lecture_id, l.language, 'lecture_' || CAST(s.lecture_id AS VARCHAR) || '.mp4' AS source,
        s.id, s.start_sec, s.end_sec, {strip('s.text')} AS text FROM segments s JOIN lectures l ON l.lecture_id = s.lecture_id""",
    "transcripts_scan": f"SELECT lecture_id, {strip('transcript')} AS transcript FROM spoken",
    "ocr_frames_file": f"""SELECT k.lecture_id, k.frame_index, f.timestamp_sec, f.image_path, k.raw_text, f.is_slide, k.n_blocks
        FROM (SELECT lecture_id, frame_index, string_agg(text, ' ' ORDER BY i) AS raw_text, CAST(count(*) AS INT) AS n_blocks
          FROM kept_blocks GROUP BY lecture_id, frame_index) k
        JOIN ocr_frames f ON f.lecture_id = k.lecture_id AND f.frame_index = k.frame_index WHERE {strip('k.raw_text')} <> ''""",
    "figures_manifest": f"""SELECT lecture_id, timestamp_sec AS timestamp, filename, caption, reason, 'figures/' || filename AS latex_path
        FROM (SELECT *, printf('fig_%02d_%02dm%02ds.jpg', row_number() OVER (PARTITION BY lecture_id ORDER BY ord),
          CAST(floor(timestamp_sec / 60) AS BIGINT), CAST(floor(timestamp_sec % 60) AS BIGINT)) AS filename FROM accepted) a""",
    "segments_or_whole": """SELECT s.lecture_id, s.id, s.start_sec, s.end_sec, s.text FROM segments s
        WHERE s.lecture_id IN (SELECT lecture_id FROM lectures)
        UNION ALL SELECT lecture_id, CAST(0 AS INT), CAST(0 AS DOUBLE), CAST(9999 AS DOUBLE), transcript FROM lectures
        WHERE lecture_id NOT IN (SELECT lecture_id FROM segments)""",
    "segments_clean": f"SELECT lecture_id, id, start_sec, end_sec, {strip('text')} AS text FROM segments",
    "catalogue_match": "SELECT id, stem FROM files WHERE contains(lower(stem), 'high')",
    "notes_upsert": """SELECT notes_key, lecture_id, document FROM notes_runs
        QUALIFY row_number() OVER (PARTITION BY notes_key ORDER BY run DESC, lecture_id DESC) = 1""",
    "index_upsert": with_sums("index_upserted"),
    "ocr_block_filter": """SELECT lecture_id, frame_index,
        CAST(row_number() OVER (PARTITION BY lecture_id, frame_index ORDER BY i) - 1 AS INT) AS kept_no, text, confidence
        FROM kept_blocks""",
    "ocr_frame_text": f"""SELECT lecture_id, frame_index, raw_text, n_blocks FROM (
        SELECT lecture_id, frame_index, string_agg(text, ' ' ORDER BY i) AS raw_text, CAST(count(*) AS INT) AS n_blocks
        FROM kept_blocks GROUP BY lecture_id, frame_index) a WHERE {strip('raw_text')} <> ''""",
    "frame_type": f"""SELECT lecture_id, {FRAME_TYPE} AS frame_type, {FRAME_TYPE} = 'slide' AS is_slide,
        gray_mean > 128 AS is_bright, round(gray_mean, 4) AS gray_mean, round(gray_std, 4) AS gray_std FROM frame_stats""",
    "ocr_route": f"{image_route('false')} UNION ALL {image_route('true')}",
    "media_requests": f"SELECT session_id, seq, url FROM requests WHERE {MEDIA}",
    "math_lines": f"""SELECT lecture_id, line_no, line FROM (
        SELECT lecture_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS line_no, unnest(p) AS line
        FROM (SELECT lecture_id, {split_lines('transcript')} AS p FROM lectures) a) b WHERE {math_test('line')}""",
    "aligned_no_ocr": """SELECT lecture_id, start_sec AS timestamp_sec, text AS speech, '' AS ocr_text, false AS is_slide
        FROM segments""",
    "resolve_date": f"""SELECT id, CASE WHEN given_date = default_date AND {title_date('title')} IS NOT NULL
        THEN {title_date('title')} ELSE given_date END AS lecture_date FROM titles""",
    "log_errors": f"""SELECT build_id, coalesce(string_agg(value, chr(10) ORDER BY line_no) FILTER (starts_with(value, '!')),
        '{V.UNKNOWN_BUILD_ERROR}') AS errors FROM log_lines GROUP BY build_id""",
    "align": "SELECT * FROM aligned",
    "first_context": """SELECT f.lecture_id, f.ord, f.timestamp_sec,
        coalesce(arg_min(a.speech, (a.timestamp_sec, a.frame_index)), '') AS speech
        FROM frame_scores f LEFT JOIN aligned a ON a.lecture_id = f.lecture_id AND abs(a.timestamp_sec - f.timestamp_sec) < 30
        GROUP BY f.lecture_id, f.ord, f.timestamp_sec""",
    "ocr_at": "SELECT call_id, result FROM ocr_result",
    "nearest_figure": "SELECT call_id, result FROM figure_result",
    "frames_present": """SELECT lecture_id, frame_index, image_path FROM ocr_frames
        WHERE image_path IN (SELECT image_path FROM image_files)""",
    "lookup_dispatch": f"""SELECT l.call_id, l.tool, CASE l.tool
          WHEN 'search_transcript' THEN coalesce(s.result, '{V.NO_PASSAGES}')
          WHEN 'get_ocr_at_timestamp' THEN o.result WHEN 'get_figure_at_timestamp' THEN f.result
          ELSE 'Unknown tool: ' || coalesce(l.tool, 'None') END AS result
        FROM lookups l LEFT JOIN search_text s ON s.lecture_id = l.lecture_id AND s.query = l.query
        JOIN ocr_result o ON o.call_id = l.call_id JOIN figure_result f ON f.call_id = l.call_id""",
    "rebuild_transcript": """SELECT lecture_id, string_agg(speech, ' ' ORDER BY timestamp_sec, frame_index) AS transcript
        FROM aligned WHERE speech <> '' GROUP BY lecture_id""",
    "stride_sample": """SELECT lecture_id, frame_idx, frame_idx / fps AS timestamp_sec,
        printf('frame_%07d_%.1fs.jpg', frame_idx, frame_idx / fps) AS image_name
        FROM (SELECT *, min(CASE WHEN NOT readable THEN frame_idx END) OVER (PARTITION BY lecture_id) AS stop
              FROM frame_series WHERE frame_idx % greatest(1, CAST(trunc(fps * 10) AS BIGINT)) = 0) a
        WHERE stop IS NULL OR frame_idx < stop""",
    "dup_pairs": f"""SELECT l.lecture_id, l.line_id, w.start, round({similarity('l.ls', 'w.ws')}, 6) AS similarity
        FROM slide_sets l JOIN told_window_rows w ON w.lecture_id = l.lecture_id WHERE {similarity('l.ls', 'w.ws')} > 0.7""",
    "novel_lines": f"SELECT lecture_id, frame_index, line_no, line FROM slide_lines c WHERE {NOT_SPOKEN}",
    "ocr_filter": filtered("true"),
    "ocr_filter_math": filtered(math_test("line")),
    "filter_summary": f"""SELECT s.lecture_id, count(*) AS lines_in, coalesce(max(k.n), 0) AS lines_out FROM slide_lines s
        LEFT JOIN (SELECT lecture_id, count(*) AS n FROM ({kept_lines('true')}) x GROUP BY lecture_id) k
        ON k.lecture_id = s.lecture_id GROUP BY s.lecture_id""",
    "ocr_distinct": f"""SELECT lecture_id, string_agg({minute('timestamp_sec')} || ' ' || ocr_text, chr(10)
        ORDER BY timestamp_sec, frame_index) AS ocr_text FROM ocr_first GROUP BY lecture_id""",
    "ocr_split": f"""SELECT lecture_id, CAST(generate_subscripts(p, 1) - 1 AS INT) AS line_no, unnest(p) AS line
        FROM (SELECT lecture_id, {split_lines('transcript')} AS p FROM lectures) a""",
    "overlap_coeff": f"""SELECT f.lecture_id, f.frame_index,
        round({similarity(word_set('f.raw_text'), word_set('s.text'))}, 6) AS similarity
        FROM ocr_frames f JOIN segments s ON s.lecture_id = f.lecture_id AND s.id + 1 = f.frame_index""",
    "page_concat": "SELECT file_id, transcript FROM page_joined",
    "collection_counts": "SELECT collection, count(*) AS chunks FROM index_base GROUP BY collection",
    "collection_exists": f"""SELECT lecture_id, course FROM (SELECT lecture_id, course FROM lectures
          UNION ALL SELECT id, course FROM titles) c
        WHERE {collection('course')} IN (SELECT {collection('course')} FROM lectures
          WHERE lecture_id % 2 = 0 AND len({words('transcript')}) > 0)""",
    "corpus_summary": f"""SELECT l.lecture_id, l.language, len({words('l.transcript')}) AS n_words,
        (SELECT count(*) FROM segments s WHERE s.lecture_id = l.lecture_id) AS segments FROM lectures l""",
    "frame_summary": """SELECT f.lecture_id, count(k.frame_index) AS frames_with_text, count(*) AS frames FROM ocr_frames f
        LEFT JOIN (SELECT DISTINCT lecture_id, frame_index FROM kept_blocks) k
        ON k.lecture_id = f.lecture_id AND k.frame_index = f.frame_index GROUP BY f.lecture_id""",
    "figure_summary": """SELECT lecture_id, count(*) FILTER (json_extract_string(js, '$.include') = 'true') AS selected,
        count(*) AS candidates FROM verdict_rows GROUP BY lecture_id""",
    "index_summary": f"""SELECT lecture_id, count(*) AS chunks FROM ({index_rows('sourced')}) q GROUP BY lecture_id
        UNION ALL SELECT CAST(-1 AS BIGINT), count(*) FROM ({index_rows('sourced')}) q""",
    "histogram64": "SELECT id, bin, n FROM hists",
    "hist_distance": """SELECT a.id, round(CASE WHEN sum(a.n) * sum(b.n) = 0 THEN 1.0 ELSE sqrt(greatest(0.0, 1 - sum(sqrt(a.n * b.n)) / sqrt(sum(a.n) * sum(b.n)))) END, 6) AS distance
        FROM hists a JOIN hists b ON b.id = a.id + 1 AND b.bin = a.bin GROUP BY a.id""",
    "density_score": "SELECT id, round(avg(mask) / 255.0, 6) AS score FROM samples GROUP BY id",
    "merge_responses": f"""SELECT lecture_id, CASE WHEN count(*) = 1 THEN min(document) ELSE
        arg_min(CASE WHEN {HEAD} <> '' THEN {HEAD} ELSE {lit(V.DEFAULT_PREAMBLE)} END, chunk_idx) || chr(10) || chr(10)
        || string_agg(CASE WHEN {BODY} <> '' THEN {strip(BODY)} ELSE document END, {lit(V.BODY_SEPARATOR)} ORDER BY chunk_idx)
        || {lit(V.DOCUMENT_END)} END AS document FROM cleaned GROUP BY lecture_id""",
    "clean_response": "SELECT lecture_id, chunk_idx, document FROM cleaned",
    "chunks_index": index_rows("sourced"),
    "chunks_dedup": f"""SELECT lecture_id, start, chunk
        FROM ({windows('lectures', 'transcript', 'lecture_id', 50, 25)}) x""",
    "chunks_prompt": f"""SELECT lecture_id, CAST(len(w) AS INT) AS n_words, CAST(0 AS INT) AS chunk_idx, transcript AS chunk
        FROM (SELECT *, {words('transcript')} AS w FROM lectures) a WHERE len(w) <= {PROMPT_WORDS}
        UNION ALL SELECT lecture_id, CAST(n_words AS INT), pos, chunk
        FROM ({windows('lectures', 'transcript', 'lecture_id', PROMPT_WORDS, PROMPT_WORDS)}) b WHERE n_words > {PROMPT_WORDS}""",
    "passage_search": """SELECT query_id, lecture_id, CAST(rank AS INT) AS rank, start, score,
        CAST(round_even(100.0 * start / n_words, 0) AS INT) AS position_pct, chunk AS passage
        FROM (SELECT t.query_id, w.lecture_id, w.start, w.n_words, w.chunk, count(*) AS score,
                row_number() OVER (PARTITION BY t.query_id ORDER BY count(*) DESC, w.start) AS rank
              FROM asked_terms t JOIN search_windows w ON w.lecture_id = t.lecture_id AND contains(w.low, t.term)
              GROUP BY t.query_id, w.lecture_id, w.start, w.n_words, w.chunk) s WHERE rank <= 3""",
    "change_points": "SELECT lecture_id, ord, score FROM walk WHERE keep",
    "scene_changes": "SELECT lecture_id, ord FROM scene_walk WHERE keep",
    "figure_names": """SELECT lecture_id, ord, timestamp_sec, caption, reason, figure_no, filename,
        'figures/' || filename AS latex_path FROM (SELECT *, printf('fig_%02d_%02dm%02ds.jpg', figure_no,
          CAST(floor(timestamp_sec / 60) AS BIGINT), CAST(floor(timestamp_sec % 60) AS BIGINT)) AS filename
        FROM (SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY ord) AS figure_no FROM accepted) a) b""",
    "accepted_figures": "SELECT * FROM accepted",
    "top_candidates": """SELECT lecture_id, CAST(rank AS INT) AS rank, score, timestamp_sec, image_path FROM (
        SELECT *, row_number() OVER (PARTITION BY lecture_id ORDER BY score DESC, timestamp_sec DESC, image_path DESC) AS rank
        FROM frame_scores) a WHERE rank <= 30""",
    "query_prefix": f"""SELECT lecture_id, array_to_string({words('transcript')}[1:200], ' ') AS query,
        substr(transcript, 1, 200) AS shown FROM lectures""",
    "first_media": f"SELECT session_id, arg_min(url, seq) AS url FROM requests WHERE {MEDIA} GROUP BY session_id",
    "vector_topk": """SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, id) AS INT) AS rank
        FROM vtop""",
    "lecture_context": f"""SELECT q.id AS query_id, coalesce(string_agg('[Lecture ' || v.lecture_date || ', transcript]' || chr(10)
        || v.transcript, {lit(V.BLOCK_SEPARATOR)} ORDER BY v.distance, v.id), '') AS context
        FROM vq q LEFT JOIN told_top v ON v.query_id = q.id GROUP BY q.id""",
    "hashed_vectors": f"SELECT lecture_id, dim, round(x, 6) AS x FROM ({hashed('lectures', 'lecture_id', 'transcript')}) h",
    "index_lectures": with_sums("index_base"),
    "index_pages": with_sums("page_index"),
    "title_date": f"SELECT id, {title_date('title')} AS lecture_date FROM titles",
    "stem_date": f"SELECT id, {stem_date('stem')} AS lecture_date FROM files",
    "notes_name": f"""SELECT id, {notes_file('course', 'given_date', "(CASE id % 3 WHEN 0 THEN 'Part: 1' WHEN 1 THEN '' END)")}
        AS file_name FROM titles""",
    "collection_name": f"SELECT id, {collection('course')} AS collection FROM titles",
    "clock_label": f"SELECT ord, {clock('timestamp_sec')} AS clock, {minute('timestamp_sec')} AS minute FROM frame_scores",
    "prompt_table": prompts(context=False),
    "prompt_table_whole": prompts(context=False, parts="prompt_parts_whole"),
    "prompt_table_context": prompts(context=True),
    "align_stream": """SELECT f.lecture_id, f.frame_index, f.timestamp_sec,
        coalesce(string_agg(s.text, ' ' ORDER BY s.id), '') AS speech, f.raw_text AS ocr_text, f.is_slide, f.image_path
        FROM ocr_frames f LEFT JOIN long_segments s ON s.lecture_id = f.lecture_id
        AND (abs(s.start_sec - f.timestamp_sec) < 30 OR (s.start_sec <= f.timestamp_sec AND f.timestamp_sec <= s.end_sec))
        GROUP BY f.lecture_id, f.frame_index, f.timestamp_sec, f.raw_text, f.is_slide, f.image_path""",
}
SQL["change_points_stream"] = SQL["change_points_batches"] = SQL["change_points"]
SQL["index_upsert_stream"] = with_sums("index_base")

ORACLES: dict[str, str] = {name: check_sql(body, EXTRA) for name, body in SQL.items()}
