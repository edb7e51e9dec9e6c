"""Documents with every awkward case, and plain helpers."""

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"w{i}" for i in range(30_000))


def awkward():
    """Nulls in every column, empty, blank and very long texts, copies, near copies, repeated rows."""
    base = " ".join(f"word{i}" for i in range(120))
    rows = [
        (1, base, "en", "a", 1),
        (2, base, "en", "a", 1),
        (3, base + " more", "en", None, None),
        (4, "", "en", "b", 0),
        (5, None, None, "b", None),
        (6, " \n\t ", "de", "a", 5),
        (7, "one", "xx", "a", 3),
        (8, "ONE", "xx", "c", 3),
        (9, "a b c", "fr", "a", 5),
        (10, LONG, "en", "a", len(LONG)),
        (11, LONG + " end", "en", None, len(LONG)),
        (12, "x" * 5000, "en", "a", 5000),
        (13, "Ünïcode 漢字 ▁mark <|endoftext|> &amp; 😀\x00 tab\tline\nline\nline", None, "d", 9),
        (14, "go go go go go go go go go go go go", "en", "a", 9),
        (14, "go go go go go go go go go go go go", "en", "a", 9),
        (15, "same id " + base, "en", "a", 9),
        (15, "other text under one number", "en", "b", 9),
        (None, "no number at all here", "en", "a", 9),
        (None, "nor here, it seems", "en", "a", 9),
    ]
    return rows


def documents(spark, rows=None):
    return spark.createDataFrame(awkward() if rows is None else rows, SCHEMA)


def words(text):
    return WORD.findall(text or "")
