"""Small tables with the awkward rows every operator has to take."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long, words string, sig string, n int, size string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
PROSE = "The river runs past four old mills and a stone bridge before it meets the sea near the harbour wall"


def documents(spark, rows=None):
    """Rows of (doc_id, text[, source]); the extra columns clash with names the operators use inside."""
    if rows is None:
        rows = [(1, PROSE), (2, PROSE), (2, PROSE), (3, None), (4, ""), (5, " \n\t "), (6, LONG), (None, PROSE), (None, None),
                (7, "one two"), (8, PROSE + " today", None), (9, "ünï çödé ß Straße " * 30)]
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src1", len(r[1] or ""), "x", "y", 7, "z") for r in rows]
    return spark.createDataFrame(full, DOCS)


def tokens(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def lowered(text):
    return re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
