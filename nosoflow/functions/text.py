"""Text expressions. All run inside the JVM except entity decoding."""

from __future__ import annotations

import html
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The whitespace that a Unicode-aware strip removes, as a trim set and as a regex class.
WHITESPACE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace())
SPACE_CLASS = r"[\s\x1c-\x1f\x85\p{Z}]"

# Blocks of combining marks, dropped by the label normaliser.
COMBINING_CLASS = r"[̀-ͯ᪰-᫿᷀-᷿⃐-⃰︠-︯]"

# The wrapper put around a stored report, and the spelling of its two prompts.
WRAPPER_PATTERNS = (
    r"(?s)^.*?compte rendu d'hospitalisation à coder en CIM-11\s*:\s*\n+-*\n?",
    r"(?s)\n-+\n*\s*Propose le codage CIM-11.*$",
    r"(?s)^Le compte rendu suivant respecte.*?-{10,}\n",
)
USER_TEMPLATE = (
    "Voici le compte rendu d'hospitalisation à coder en CIM-11 :\n\n---\n",
    "\n---\n\nPropose le codage CIM-11 (DP et DAS).",
)


def strip(text: Column) -> Column:
    """Trim Unicode whitespace on both ends (``trim`` alone removes spaces only)."""
    return F.btrim(text, F.lit(WHITESPACE))


def collapse_spaces(text: Column) -> Column:
    """Every whitespace run becomes one space; ends trimmed."""
    return strip(F.regexp_replace(text, SPACE_CLASS + "+", " "))


def _folding() -> tuple[str, str, dict[str, str]]:
    """Accent folding derived from Unicode NFKD over the Latin blocks."""
    one_from, one_to, many = [], [], {}
    blocks = (range(0x80, 0x250), range(0x1E00, 0x1F00), range(0x2070, 0x20A0), range(0xFB00, 0xFB07), range(0xFF01, 0xFF5F))
    for block in blocks:
        for point in block:
            char = chr(point)
            folded = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c))
            if folded == char or not any(c.isascii() and c.isalnum() for c in folded):
                continue
            if len(folded) == 1:
                one_from.append(char)
                one_to.append(folded)
            else:
                many[char] = folded
    return "".join(one_from), "".join(one_to), many


_FOLD_FROM, _FOLD_TO, _FOLD_MANY = _folding()
_MANY_CLASS = "[" + "".join(_FOLD_MANY) + "]"


def normalize_label(label: Column) -> Column:
    """Lower case, no accents, every run outside ``[a-z0-9]`` as one space."""
    text = F.coalesce(label, F.lit(""))
    expanded = text
    for char, folded in _FOLD_MANY.items():
        expanded = F.replace(expanded, F.lit(char), F.lit(folded))
    text = F.when(text.rlike(_MANY_CLASS), expanded).otherwise(text)
    text = F.translate(F.regexp_replace(text, COMBINING_CLASS, ""), _FOLD_FROM, _FOLD_TO)
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "))


def label_matches(predicted: Column, expected: Column) -> Column:
    """Normalised equality or containment; an empty expected label never matches."""
    wanted = F.coalesce(expected, F.lit(""))
    return (wanted != "") & F.contains(normalize_label(predicted), normalize_label(expected))


def unwrap_report(text: Column) -> Column:
    """Remove the prompt wrapper stored around a report, then strip."""
    for pattern in WRAPPER_PATTERNS:
        text = F.regexp_replace(text, pattern, "")
    return strip(text)


def wrap_report(text: Column) -> Column:
    """User prompt: fixed template around the stripped report."""
    head, tail = USER_TEMPLATE
    return F.concat(F.lit(head), strip(text), F.lit(tail))


def fingerprint(text: Column, length: int = 16) -> Column:
    """First hex characters of SHA-256: correlates records without keeping text."""
    return F.substring(F.sha2(text, 256), 1, length)


@F.pandas_udf(T.StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


def html_text(fragment: Column) -> Column:
    """Drop tags, decode entities once, collapse whitespace, in that order.

    The entity table lives in the Python standard library, so decoding is one
    Arrow call; rows without ``&`` are passed to it as null.
    """
    bare = F.regexp_replace(fragment, "<[^>]+>", "")
    encoded = F.when(F.contains(bare, F.lit("&")), bare)
    return collapse_spaces(F.coalesce(_unescape(encoded), bare))


def absolute_link(link: Column, base: str) -> Column:
    return F.when(F.startswith(link, F.lit("http")), link).otherwise(F.concat(F.lit(base), link))


def https(uri: Column) -> Column:
    return F.replace(uri, F.lit("http://"), F.lit("https://"))


def last_segment(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def to_new_revision(template: Column, marker: str, additions: str) -> Column:
    """Rewrite a prompt template for the newer revision and add instructions after a marker."""
    text = F.replace(template, F.lit("CIM-10"), F.lit("CIM-11"))
    text = F.replace(text, F.lit("CIM10"), F.lit("CIM-11"))
    return F.replace(text, F.lit(marker), F.lit(marker + additions))
