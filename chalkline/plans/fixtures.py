"""The driver's tables in the shapes the operators take.

Each view is one SQL text for both engines: ``@name`` stands for a driver table. Spark reads the
Parquet file in place; the check SQL puts the views it uses in front as common table expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "lectures": """SELECT doc_id AS lecture_id, source AS course,
        CAST(DATE '2024-01-01' + CAST(doc_id % 365 AS INT) AS STRING) AS lecture_date,
        lang AS language, text AS transcript FROM @documents""",
    "segments": """SELECT conv_id AS lecture_id, CAST(turn AS INT) AS id, CAST(turn * 20 AS DOUBLE) AS start_sec,
        CAST(turn * 20 + 18 AS DOUBLE) AS end_sec, text FROM @conversations""",
    "untranscribed": """SELECT DISTINCT -1 - conv_id AS lecture_id, 'Rebuilt' AS course, '2024-02-02' AS lecture_date,
        CAST(NULL AS STRING) AS transcript FROM @conversations WHERE conv_id % 2 = 1""",
    "long_segments": """SELECT conv_id AS lecture_id, CAST(turn AS INT) AS id, CAST(turn * 20 AS DOUBLE) AS start_sec,
        CAST(CASE WHEN turn = 1 AND conv_id % 2 = 0 THEN 9999 ELSE turn * 20 + 18 END AS DOUBLE) AS end_sec, text
        FROM @conversations WHERE coalesce(conv_id, 1) % 5 <> 0
        UNION ALL SELECT conv_id, CAST(turn AS INT), CAST(turn * 20 + 100000 AS DOUBLE), CAST(turn * 20 + 100018 AS DOUBLE), text
        FROM @conversations WHERE coalesce(conv_id, 1) % 5 = 0""",
    "ocr_frames": """SELECT conv_id AS lecture_id, CAST(turn AS INT) AS frame_index,
        CAST(turn * 20 + 7 AS DOUBLE) AS timestamp_sec,
        concat('frame_', CAST(turn AS STRING), '.jpg') AS image_path, text AS raw_text, turn % 2 = 0 AS is_slide
        FROM @conversations WHERE role = 'assistant'""",
    "spoken_turns": """SELECT conv_id AS lecture_id, CAST(turn AS INT) AS id, text
        FROM @conversations WHERE role = 'user'""",
    "queries": """SELECT d.doc_id AS query_id, d.doc_id AS lecture_id, b.text AS query
        FROM (SELECT doc_id, coalesce(doc_id, 0) % (SELECT count(*) FROM @benchmark) AS item FROM @documents) d
        JOIN @benchmark b ON b.item_id = d.item""",
    "frame_scores": """SELECT user_id AS lecture_id, event_id AS ord,
        CAST((event_id * 7) % 5400 AS DOUBLE) AS timestamp_sec, event_type,
        concat('frame_', CAST(event_id AS STRING), '.jpg') AS image_path, value AS score FROM @events""",
    "figures": """SELECT user_id AS lecture_id, event_id AS ord, CAST((event_id * 7) % 5400 AS DOUBLE) AS timestamp_sec,
        concat('figures/fig_', CAST(event_id AS STRING), '.jpg') AS latex_path,
        concat('caption ', CAST(event_id AS STRING)) AS caption
        FROM @events WHERE event_type = 'purchase'""",
    "frame_series": """SELECT user_id % 10 AS lecture_id, event_id AS frame_idx, value, value < 200 AS readable,
        CAST(0.35 + 0.2 * (user_id % 10) AS DOUBLE) AS fps FROM @events""",
    "frame_stats": """SELECT user_id AS lecture_id, avg(value * (user_id % 7)) AS gray_mean,
        stddev_pop(value) AS gray_std FROM @events GROUP BY user_id""",
    "samples": """SELECT l_suppkey AS id, CASE WHEN l_suppkey % 10 = 7 THEN 999 ELSE CAST(l_quantity * 5 AS INT) END AS v,
        CASE WHEN l_returnflag = 'R' THEN 255 ELSE 0 END AS mask FROM @lineitem""",
    "vectors": "SELECT label AS collection, vec_id AS id, embedding FROM @embeddings",
    "page_text": """SELECT conv_id AS file_id, turn AS page_no, CASE WHEN turn % 5 = 4 THEN '' ELSE text END AS text
        FROM @conversations""",
    "titles": """SELECT o_orderkey AS id,
        concat('Room-', replace(CAST(CAST(o_orderdate AS DATE) AS STRING), '-', ''), ' 0805-1') AS title,
        CASE WHEN o_orderkey % 4 = 0 THEN '2026-01-01' ELSE '1999-09-09' END AS given_date, '2026-01-01' AS default_date,
        concat('Course/', o_orderpriority, ': ', o_orderstatus) AS course FROM @orders""",
    "files": """SELECT o_orderkey AS id, o_orderpriority AS course,
        concat(CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE
          substr(d, 9, 2) || '-' || substr(d, 6, 2) || '-' || substr(d, 1, 4) || '_' END, o_orderpriority) AS stem
        FROM (SELECT o_orderkey, o_orderpriority, CAST(CAST(o_orderdate AS DATE) AS STRING) AS d FROM @orders) t""",
    "image_files": """SELECT DISTINCT concat('frame_', CAST(event_id AS STRING), '.jpg') AS image_path
        FROM @events WHERE event_type <> 'error'""",
    "requests": """SELECT page_id % 10 AS session_id, page_id AS seq,
        concat(url, CASE page_id % 7 WHEN 3 THEN '/a.m3u8' WHEN 4 THEN '/StreamURL' WHEN 5 THEN '/x.MP4' ELSE '' END) AS url
        FROM @pages""",
    "lookups": """SELECT event_id AS call_id, user_id AS lecture_id,
        CASE event_id % 4 WHEN 0 THEN 'search_transcript' WHEN 1 THEN 'get_ocr_at_timestamp'
        WHEN 2 THEN 'get_figure_at_timestamp' ELSE CASE WHEN event_id % 8 = 3 THEN 'other' END END AS tool, event_type AS query,
        CASE WHEN event_id % 23 > 0 THEN CAST(event_id % 160 AS DOUBLE) END AS timestamp_seconds,
        CASE WHEN event_id % 3 > 0 THEN CAST(45 AS DOUBLE) END AS window_seconds FROM @events""",
    "lookup_calls": """SELECT call_id, lecture_id, tool, concat('{"query": "', query, '"',
        CASE WHEN timestamp_seconds IS NOT NULL THEN concat(', "timestamp_seconds": ', CAST(CAST(timestamp_seconds AS INT) AS STRING))
        WHEN call_id % 2 = 0 THEN ', "timestamp_seconds": "soon"' ELSE '' END,
        CASE WHEN window_seconds IS NOT NULL THEN ', "window_seconds": "45"' ELSE '' END, '}') AS input FROM lookups""",
    "verdicts": """SELECT user_id AS lecture_id, event_id AS ord, CAST((event_id * 7) % 5400 AS DOUBLE) AS timestamp_sec,
        CASE WHEN event_id % 10 = 7 THEN 'nope' ELSE concat('```json', chr(10), '{"include": ',
        CASE WHEN event_id % 3 = 0 THEN 'true' ELSE 'false' END,
        ', "caption": "c', CAST(event_id AS STRING), '", "reason": "r"}', chr(10), '```') END AS raw FROM @events""",
    "responses": """SELECT conv_id AS lecture_id, turn AS chunk_idx, concat('```latex', chr(10), chr(92),
        'documentclass{article}', chr(10), chr(92), 'begin{document}', chr(10), text,
        chr(10), chr(92), 'end{document}', chr(10), '```', chr(10)) AS raw FROM @conversations""",
    "log_lines": """SELECT o_custkey AS build_id, o_orderkey AS line_no,
        CASE WHEN o_orderkey % 7 = 0 THEN concat('! ', o_orderpriority) ELSE o_orderpriority END AS value FROM @orders""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    body = re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} ({VIEWS[m[2]]}) {m[2]}" if m[2] in VIEWS else m[0], VIEWS[name])
    return spark.sql(re.sub(r"@(\w+)", lambda m: f"parquet.`{sf_dir}/{m[1]}.parquet`", body))


def check_sql(body: str, extra: dict[str, str] | None = None) -> str:
    """``body`` with the views it uses, directly or through ``extra`` ones, as a WITH clause."""
    known = {**VIEWS, **(extra or {})}
    seen: set[str] = set()
    used: list[str] = []

    def visit(sql: str) -> None:
        for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", sql):
            if name in known and name not in seen:
                seen.add(name)
                visit(known[name])
                used.append(name)

    visit(body)
    if not used:
        return re.sub(r"@(\w+)", r"\1", body)
    ctes = ",\n".join(f"{name} AS ({known[name]})" for name in used)
    return re.sub(r"@(\w+)", r"\1", f"WITH RECURSIVE {ctes}\n{body}")
