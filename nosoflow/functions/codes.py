"""Code grammar: ``root&ext1&ext2``, ICD-10 spelling, segments."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nosoflow.functions.text import strip

# Grammar of a code part and of a full code, endings of residual codes.
CODE_PART = r"[A-Z0-9]{2,10}(?:\.[A-Z0-9]+)?"
CODE = CODE_PART + "(?:&" + CODE_PART + ")*"
RESIDUAL_ENDINGS = ("Y", "Z")

# "label (code)": a label runs from the last match, or the last open bracket, to the bracket of its code.
# Starting only there, and never giving characters back, keeps the scan linear on long texts.
LABELLED_CODE = r"(?:\G|(?<=\())([^(]++)\((" + CODE + r")\)"

# A post-coordinated code in free text; it never starts inside a word, so words are read once.
FREE_TEXT_CODE = r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9.]*+(?:&[A-Za-z0-9=.]++)++"


def root_code(code: Column) -> Column:
    """Part before the first ``&``, trimmed, upper case; empty for null."""
    return F.upper(strip(F.substring_index(F.coalesce(code, F.lit("")), "&", 1)))


def is_code(code: Column) -> Column:
    return code.rlike("^(?:" + CODE + ")$")


def is_residual(code: Column) -> Column:
    """Codes that end in Y (other specified) or Z (unspecified)."""
    endings = [F.endswith(code, F.lit(e)) for e in RESIDUAL_ENDINGS]
    return endings[0] | endings[1]


def normalize_icd10(code: Column) -> Column:
    """Trim; insert a dot after three characters when there is none and more follow."""
    trimmed = strip(code)
    dotted = F.concat(F.substring(trimmed, 1, 3), F.lit("."), trimmed.substr(F.lit(4), F.length(trimmed)))
    return F.when(F.contains(trimmed, F.lit(".")) | (F.length(trimmed) < 4), trimmed).otherwise(dotted)


def backoff_candidates(code: Column) -> list[Column]:
    """Keys tried in order: exact, last character dropped, part before the dot.

    The two shorter keys exist only for dotted codes.
    """
    exact = normalize_icd10(code)
    dotted = F.contains(exact, F.lit("."))
    shorter = F.when(dotted, F.substring(exact, F.lit(1), F.length(exact) - 1))
    stem = F.when(dotted, F.substring_index(exact, ".", 1))
    return [exact, shorter, stem]


def segments(code: Column) -> Column:
    return F.split(strip(code), "&")


def scan_codes(text: Column) -> Column:
    """All post-coordinated codes written in a free text, in order."""
    return F.regexp_extract_all(text, F.lit(FREE_TEXT_CODE), F.lit(0))
