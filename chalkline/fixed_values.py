"""Fixed values.

Everything in this file must equal the values the original note pipeline uses, otherwise
results differ: patterns, keyword lists, message texts, prompt texts and default settings.
They are data, stated as text and in their natural order; the logic lives elsewhere.
"""

# --- default settings -----------------------------------------------------------------
FRAME_INTERVAL_SEC = 10.0
SCENE_THRESHOLD = 0.35
OCR_MIN_CONFIDENCE = 0.3
ALIGN_WINDOW_SEC = 30.0
LOOKUP_WINDOW_SEC = 60
SIMILARITY_THRESHOLD = 0.7
DEDUP_WINDOW, DEDUP_STEP = 50, 25
SEARCH_WINDOW, SEARCH_STEP, SEARCH_TOP = 100, 50, 3
PROMPT_CHUNK_WORDS = 18000
INDEX_CHUNK_WORDS, INDEX_OVERLAP_WORDS = 500, 50
RETRIEVAL_TOP = 5
QUERY_PREFIX_WORDS = 200
CONTEXT_PREFIX_CHARS = 200
MAX_CANDIDATES = 30
HISTOGRAM_BINS = 64
WHOLE_LECTURE_END_SEC = 9999.0

# --- frame brightness classes ---------------------------------------------------------
SLIDE_MIN_MEAN, SLIDE_MAX_STD = 180.0, 60.0
BLACKBOARD_MAX_MEAN = 80.0
LEGACY_SLIDE_MIN_MEAN = 128.0

# --- mathematical-line patterns (a line is mathematical if any of them is found) ------
MATH_PATTERNS = [
    r"[=\+\-\*/\^]",
    r"[α-ωΑ-Ω]",
    r"\d+\s*[/]\s*\d+",
    r"[A-Z]\([a-z]\)",
    r"\b(lim|inf|sup|max|min|sum|prod)\b",
    r"\b(dB|Hz|rad|omega|sigma|delta|mu)\b",
    r"[<>≤≥≈≠∞∂∫∑∏√]",
    r"\b\d+\s*(dB|Hz|rad/s)\b",
    r"[A-Za-z]+\s*[=]\s*[A-Za-z0-9\(\)\+\-\*/\^]+",
]

# --- other patterns -------------------------------------------------------------------
LINE_CUT = r"\n|(?<=\])\s"
LINE_TAG = r"^\[\d+min\]\s*"
TITLE_DIGITS = r"(\d{8})"
FENCE_OPEN = r"^```(?:latex|tex)?\s*"
FENCE_CLOSE = r"```\s*$"
DOCUMENT_BODY = r"\\begin\{document\}(.*?)\\end\{document\}"
DOCUMENT_PREAMBLE = r"^(.*?\\begin\{document\})"

# --- labels and names -----------------------------------------------------------------
CLOCK = "%02d:%02d"
MINUTE_TAG = "[%02dmin]"
FIGURE_NAME = "fig_%02d_%02dm%02ds.jpg"
FIGURE_PATH = "figures/%s"
FRAME_NAME = "frame_%07d_%ss.jpg"

# --- media requests -------------------------------------------------------------------
MEDIA_EXTENSIONS = [".mp4", ".m3u8", ".ts"]
MEDIA_KEYWORDS = ["nln1.wbx.com", "ciscospark", "recording/play", "streamurl"]

# --- characters removed from file names -----------------------------------------------
UNSAFE_FILE_CHARS = '<>:"/\\|?*'

# --- lookup answers -------------------------------------------------------------------
NO_PASSAGES = "No matching passages found for the query."
PASSAGE = "[Position: ~%d%% through lecture]\n%s"
NO_OCR_NEAR = "No OCR data found within %ss of timestamp %ss."
NO_OCR_TEXT = "Frames found near %ss but no OCR text extracted."
OCR_LINE = "[%s] %s"
NO_FIGURES = "No figures available."
NEAREST_FIGURE = "Closest figure (%ss away):\n  latex_path: %s\n  caption: %s\n  timestamp: %ss"
UNKNOWN_TOOL = "Unknown tool: %s"
UNKNOWN_BUILD_ERROR = "Unknown compilation error"
CONTEXT_PASSAGE = "[Lecture %s, %s]\n%s"
BLOCK_SEPARATOR = "\n\n---\n\n"

# --- merged documents -----------------------------------------------------------------
DEFAULT_PREAMBLE = "\\documentclass{article}\n\\begin{document}"
BODY_SEPARATOR = "\n\n% --- continued ---\n\n"
DOCUMENT_END = "\n\n\\end{document}"

# --- prompt texts ---------------------------------------------------------------------
PROMPT_HEAD = (
    "Convert the following lecture transcript into complete, comprehensive LaTeX notes.\n"
    "Write with a bookish, refined academic style — not a transcript dump, but polished notes a student would enjoy reading.\n"
    "Cover EVERY topic discussed — do not skip or summarise any part of the lecture.\n"
    "\nCourse: "
)
PROMPT_DATE = "\nDate: "
PROMPT_TRANSCRIPT = "\n\n--- FULL TRANSCRIPT ---\n"
PROMPT_OCR_HEAD = (
    "\n--- ADDITIONAL MATHEMATICAL CONTENT FROM SLIDES/BLACKBOARD ---\n"
    "(These are formulas and equations written by the professor that were NOT spoken aloud.\n"
    "Integrate them naturally into the notes where contextually appropriate.)\n"
)
PROMPT_FIGURES_HEAD = (
    "\n--- FIGURES TO INCLUDE ---\n"
    "The following figures have been extracted from the lecture slides/video.\n"
    "For each figure, insert it at the appropriate point in the notes using this LaTeX template:\n"
    "\n\\begin{{figure}}[h]\n"
    "\\centering\n"
    "\\includegraphics[width=0.6\\textwidth]{{LATEX_PATH}}\n"
    "\\caption{{CAPTION}}\n"
    "\\end{{figure}}\n"
    "\nReplace LATEX_PATH and CAPTION with the values below.\n"
    "Insert each figure near the section where the corresponding topic is discussed (use the timestamp as a guide).\n\n"
)
PROMPT_FIGURE = "[%s] latex_path=%s caption=%s\n"
PROMPT_FIGURES_TAIL = (
    "\nCRITICAL: Use ONLY the exact latex_path values listed above. "
    "Never invent or modify figure filenames.\n"
)
PROMPT_CONTEXT_HEAD = (
    "\n--- CONTEXT FROM PREVIOUS LECTURES IN THIS COURSE ---\n"
    "(Use this context to maintain consistency with terminology, notation, and concepts\n"
    "introduced in previous lectures. Reference prior material where appropriate.)\n"
)
PROMPT_TAIL = "\nProduce the complete .tex file now, covering the entire lecture:"
