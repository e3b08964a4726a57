"""Coded replies (``DP : label (CODE) / DAS : label (CODE), ...``) and JSON answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from nosoflow.functions.codes import LABELLED_CODE
from nosoflow.functions.text import strip

# Section markers of a coded reply and the word that voids the second section.
MAIN_MARK = "DP :"
OTHERS_MARK = "DAS :"
NONE_WORD = "aucun"

MESSAGES_TYPE = "array<struct<role:string,content:string>>"


def main_diagnosis(reply: Column) -> Column:
    """``struct<libelle, code>`` of the main diagnosis, null when none parses."""
    head = F.split(reply, OTHERS_MARK, 2)[0]
    after = F.get(F.split(head, MAIN_MARK, 2), F.lit(1))
    text = F.coalesce(F.nullif(after, F.lit("")), head)
    code = F.regexp_extract(text, LABELLED_CODE, 2)
    label = strip(F.regexp_extract(text, LABELLED_CODE, 1))
    return F.when(code != "", F.struct(label.alias("libelle"), strip(code).alias("code")))


def other_diagnoses(reply: Column) -> Column:
    """``array<struct<libelle, code>>`` of the associated diagnoses, in order.

    Any "none" word in the section, even inside a label, voids the whole section.
    """
    tail = F.get(F.split(reply, OTHERS_MARK, 2), F.lit(1))
    voided = tail.isNull() | F.contains(F.lower(tail), F.lit(NONE_WORD))
    labels = F.regexp_extract_all(tail, F.lit(LABELLED_CODE), F.lit(1))
    codes = F.regexp_extract_all(tail, F.lit(LABELLED_CODE), F.lit(2))
    pairs = F.zip_with(
        labels,
        codes,
        lambda label, code: F.struct(
            strip(F.regexp_replace(strip(label), "^,+", "")).alias("libelle"), strip(code).alias("code")
        ),
    )
    return F.when(voided, F.array().cast("array<struct<libelle:string,code:string>>")).otherwise(pairs)


def parse_reply(reply: Column) -> Column:
    """``struct<dp, das>`` of a reply."""
    return F.struct(main_diagnosis(reply).alias("dp"), other_diagnoses(reply).alias("das"))


def diagnosis_rows(reply: Column) -> Column:
    """Main and associated diagnoses as one array of ``struct<type_diag, libelle, code>``."""
    main = main_diagnosis(reply)

    def tagged(kind: str, diag: Column) -> Column:
        return F.struct(F.lit(kind).alias("type_diag"), diag["libelle"].alias("libelle"), diag["code"].alias("code"))

    first = F.filter(F.array(F.when(main.isNotNull(), tagged("DP", main))), lambda d: d.isNotNull())
    return F.concat(first, F.transform(other_diagnoses(reply), lambda d: tagged("DAS", d)))


def message_of(messages: Column, role: str) -> Column:
    """Content of the first message with a role, null when there is none."""
    return F.get(F.filter(messages, lambda m: m["role"] == role), F.lit(0))["content"]


def answer_content(response: Column) -> Column:
    """Text of the first choice of a response object, null when the path is missing."""
    return F.get_json_object(response, "$.body.choices[0].message.content")


def answer_document(content: Column) -> Column:
    """VARIANT of a fenced or plain JSON answer, null when it does not parse."""
    fenced = F.regexp_extract(content, r"(?s)```json\s*(.*?)\s*```", 1)
    return F.try_parse_json(F.when(content.rlike(r"(?s)```json\s*.*?\s*```"), fenced).otherwise(content))
