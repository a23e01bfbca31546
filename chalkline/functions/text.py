"""Text column functions.

One definition of whitespace and of "word" serves the whole package: the Unicode whitespace
set of ``str.split`` / ``str.strip`` and letters, numbers and the underscore.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from chalkline import fixed_values as V

SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u2028\u2029\u202f\u205f\u3000"
)
SPACE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
NO_WORD = r"[^\p{L}\p{N}_]+"


def spaced(pattern: str) -> str:
    """A fixed pattern with the package's whitespace and Unicode digits."""
    return pattern.replace(r"\s", SPACE).replace(r"\d", r"\p{Nd}")


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    return F.btrim(col(c), F.lit(SPACE_CHARS))


def words(c: str | Column) -> Column:
    """Whitespace-separated words; the empty or blank text has none."""
    text = strip(c)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, SPACE + "+"))


def word_tokens(c: str | Column) -> Column:
    """Lower-cased words in order, punctuation dropped."""
    return F.array_remove(F.split(F.lower(col(c)), NO_WORD), "")


def word_set(c: str | Column) -> Column:
    """Distinct lower-cased words, punctuation dropped, in sorted order."""
    return F.sort_array(F.array_distinct(word_tokens(c)))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """|A ∩ B| / min(|A|, |B|) of two word sets, 0 if either is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))


def word_prefix(c: str | Column, n: int = V.QUERY_PREFIX_WORDS) -> Column:
    return F.array_join(F.slice(words(c), 1, n), " ")


def char_prefix(c: str | Column, n: int = V.CONTEXT_PREFIX_CHARS) -> Column:
    return F.substring(col(c), 1, n)


# --- lines ----------------------------------------------------------------------------

def split_lines(c: str | Column) -> Column:
    """Trimmed non-empty pieces, cut at newlines and at whitespace that follows a ``]``."""
    pieces = F.split(col(c), spaced(V.LINE_CUT))
    return F.filter(F.transform(pieces, strip), lambda s: s != "")


def clean_line(c: str | Column) -> Column:
    """The line without a leading ``[NNmin]`` tag."""
    return strip(F.regexp_replace(col(c), spaced(V.LINE_TAG), ""))


def is_mathematical(c: str | Column) -> Column:
    """True if any of the fixed patterns is found; ``(?U)`` makes the classes Unicode-aware."""
    return col(c).rlike("(?U)" + "|".join(V.MATH_PATTERNS))


def normalised(c: str | Column) -> Column:
    return F.regexp_replace(F.lower(col(c)), SPACE + "+", " ")


# --- numbers as text ------------------------------------------------------------------

def one_decimal(c: str | Column) -> Column:
    """``x`` with one decimal, rounded half-even on its exact binary value.

    ``10 x`` is kept as a rounded product and its exact error, so that values such as 10.35,
    which lie just below the tie in binary, do not round up.
    """
    x = F.abs(col(c).cast("double"))
    x8, x2 = x * 8.0, x * 2.0
    p = x8 + x2
    head = p - x8
    err = (x8 - (p - head)) + (x2 - head)
    base = F.floor(p)
    frac = p - base
    up = (
        (frac > 0.5)
        | ((frac == 0.5) & (err > 0))
        | ((frac == 0.5) & (err == 0) & (base % 2 == 1))
    )
    tenths = base + F.when(up, 1).otherwise(0)
    sign = F.when(col(c) < 0, "-").otherwise("")
    return F.concat(sign, (tenths / 10).cast("decimal(20,1)").cast("string"))


def whole_number(c: str | Column) -> Column:
    return F.bround(col(c), 0).cast("bigint").cast("string")


def _minutes_seconds(t: Column) -> tuple[Column, Column]:
    return F.floor(t / 60), F.floor(F.pmod(t, F.lit(60.0)))


def clock(c: str | Column) -> Column:
    """``mm:ss``; minutes do not roll over into hours."""
    return F.format_string(V.CLOCK, *_minutes_seconds(col(c)))


def minute_tag(c: str | Column) -> Column:
    return F.format_string(V.MINUTE_TAG, F.floor(col(c) / 60))


def figure_name(number: Column, timestamp: Column) -> Column:
    return F.format_string(V.FIGURE_NAME, number, *_minutes_seconds(timestamp))


def frame_name(frame_idx: Column, timestamp: Column) -> Column:
    return F.format_string(V.FRAME_NAME, frame_idx, one_decimal(timestamp))


# --- dates and names ------------------------------------------------------------------

def title_date(c: str | Column) -> Column:
    """First eight consecutive digits as YYYY-MM-DD, unchecked; null if there are none."""
    digits = F.nullif(F.regexp_extract(col(c), spaced(V.TITLE_DIGITS), 1), F.lit(""))
    return F.concat(digits.substr(1, 4), F.lit("-"), digits.substr(5, 2), F.lit("-"), digits.substr(7, 2))


def stem_date(c: str | Column) -> Column:
    """What precedes the first underscore, if it is ten characters long."""
    head = F.substring_index(col(c), "_", 1)
    return F.when(F.length(head) == 10, head).otherwise("unknown")


def resolve_date(given: Column, default: Column, found: Column) -> Column:
    """An explicit date wins; the default (or a missing one) gives way to a found date."""
    return F.when((given.isNull() | (given == default)) & found.isNotNull(), found).otherwise(
        F.coalesce(given, default)
    )


def _file_safe(c: Column) -> Column:
    return strip(F.translate(c, V.UNSAFE_FILE_CHARS, ""))


def notes_name(course: Column, date: Column, suffix: Column | None = None) -> Column:
    """``DD-MM-YYYY_COURSE[ - SUFFIX].pdf`` without characters that file systems reject."""
    parts = F.split(date, "-")
    day_first = F.when(F.size(parts) == 3, F.array_join(F.reverse(parts), "-")).otherwise(date)
    tail = F.lit("")
    if suffix is not None:
        tail = F.when(F.coalesce(suffix, F.lit("")) != "", F.concat(F.lit(" - "), _file_safe(suffix))).otherwise("")
    return F.concat(day_first, F.lit("_"), _file_safe(course), tail, F.lit(".pdf"))


def collection_name(course: str | Column) -> Column:
    """Lower case, blanks and hyphens to underscores, other signs dropped, 3 to 63 characters."""
    name = F.regexp_replace(F.translate(F.lower(col(course)), " -", "__"), r"[^\p{L}\p{N}_]", "")
    name = F.substring(name, 1, 63)
    return F.when(F.length(name) < 3, F.concat(name, F.lit("_course"))).otherwise(name)


def lecture_day(c: str | Column) -> Column:
    """DATE from either date notation in use (YYYY-MM-DD or DD-MM-YYYY), else null."""
    c = col(c)
    return F.coalesce(
        F.try_to_timestamp(c, F.lit("yyyy-MM-dd")), F.try_to_timestamp(c, F.lit("dd-MM-yyyy"))
    ).cast("date")


# --- requests, logs, model responses --------------------------------------------------

def is_media_request(url: str | Column) -> Column:
    url = col(url)
    tests = [url.contains(e) for e in V.MEDIA_EXTENSIONS]
    tests += [F.lower(url).contains(k) for k in V.MEDIA_KEYWORDS]
    return reduce(lambda a, b: a | b, tests)


def strip_fences(c: str | Column) -> Column:
    """Response text without opening and closing code fences."""
    opened = F.regexp_replace(col(c), "(?md)" + spaced(V.FENCE_OPEN), "")
    return strip(F.regexp_replace(opened, "(?md)" + spaced(V.FENCE_CLOSE), ""))


def parse_verdict(c: str | Column) -> Column:
    """The JSON verdict inside optional code fences; null fields if it does not parse."""
    text = strip(F.replace(F.replace(strip(c), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    return F.from_json(text, "include BOOLEAN, caption STRING, reason STRING")


_BODY, _PREAMBLE = "(?s)" + V.DOCUMENT_BODY, "(?s)" + V.DOCUMENT_PREAMBLE


def document_body(c: str | Column) -> Column:
    """What stands inside the document environment, or the whole text without one."""
    c = col(c)
    return F.when(c.rlike(_BODY), strip(F.regexp_extract(c, _BODY, 1))).otherwise(c)


def document_preamble(c: str | Column) -> Column:
    c = col(c)
    return F.when(c.rlike(_PREAMBLE), F.regexp_extract(c, _PREAMBLE, 1)).otherwise(V.DEFAULT_PREAMBLE)
