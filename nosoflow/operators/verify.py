"""Generated codes: responses, segments, accepted and rejected codes, labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.functions.codes import scan_codes, segments
from nosoflow.functions.replies import answer_content, answer_document
from nosoflow.operators.relational import top_counts
from nosoflow.operators.scaling import cut_lineage, lookup_join, rows_fit_broadcast

# Reason given for a response that yields nothing.
EMPTY_RESPONSE = "réponse vide ou malformée"
NO_CODE = "aucun code extrait"
ALL_REJECTED = "tous les codes hallucinés"

# Fixed value: shortest answer that is kept.
MIN_ANSWER = 40


def read_responses(lines: DataFrame) -> DataFrame:
    """Batch response lines (``brut``) as ``custom_id``, ``contenu``; lines that are not JSON are dropped.

    One pass over the line gives both fields; the full validity test runs only where both are missing.
    """
    rest = [c for c in lines.columns if c != "brut"]
    fields = lines.select(*rest, "brut", F.json_tuple("brut", "custom_id", "response").alias("custom_id", "_response"))
    valid = F.col("custom_id").isNotNull() | F.col("_response").isNotNull() | F.try_parse_json("brut").isNotNull()
    return fields.where(valid).select(
        *rest, F.coalesce("custom_id", F.lit("")).alias("custom_id"), answer_content(F.col("_response")).alias("contenu"))


def check_codes(
    responses: DataFrame, key: Sequence[str], roots: DataFrame, extensions: DataFrame, with_labels: bool = False
) -> DataFrame:
    """One row per code written in a response, with its unknown segments and, if asked, its extension labels.

    The first segment must be a root; later ones an extension or a root. ``roots`` and
    ``extensions`` have ``code``. Columns: key, ``custom_id``, ``rang``, ``code_postcoord``,
    ``inconnus`` (array, empty when valid), ``libelles_extensions``. Responses are read once, their codes are stored. What a code yields depends on its root
    and, apart from it, on what follows; both recur in many codes, so the distinct ones are checked, and only those with unknown segments or labels are
    joined back. The segments of a piece are regrouped by the piece, so a list never exceeds its length.
    """
    # the outer form keeps Spark from scanning each text a second time for a filter on the number of its codes
    scanned = responses.select(*key, "custom_id", F.posexplode_outer(scan_codes(F.col("contenu"))).alias("rang", "code_postcoord"))
    codes = cut_lineage(scanned.where(F.col("code_postcoord").isNotNull()))
    root, rest = F.substring_index("code_postcoord", "&", 1), F.expr("substring(code_postcoord, locate('&', code_postcoord) + 1)")
    later = F.contains(F.col("code_postcoord"), F.lit("&"))
    found = codes.select(root.alias("_piece"), F.lit(0).alias("_from")).distinct().unionByName(
        codes.where(later).select(rest.alias("_piece"), F.lit(1).alias("_from")).distinct())
    parts = found.select("_piece", "_from", F.posexplode(segments(F.col("_piece"))).alias("_p", "segment")).withColumn("_pos", F.col("_p") + F.col("_from"))
    known = roots.select(F.col("code").alias("segment")).withColumn("_root", F.lit(True)).unionByName(
        extensions.select(F.col("code").alias("segment")).withColumn("_root", F.lit(False)))
    known = known.groupBy("segment").agg(F.max("_root").alias("_root"))
    looked = lookup_join(parts, known, "segment", "left")
    valid = F.when(F.col("_pos") == 0, F.coalesce(F.col("_root"), F.lit(False))).otherwise(F.col("_root").isNotNull())
    unknown = F.when(~valid, F.struct("_pos", "segment"))
    lists = [F.transform(F.array_sort(F.collect_list(unknown)), lambda s: s["segment"]).alias("_unknown")]
    if with_labels:
        looked = _with_segment_label(looked, "segment", extensions)
        lists.append(_label_list("segment").alias("_labels"))
    told = F.size("_unknown") > 0
    plain = F.replace(F.col("_piece"), F.lit("&"), F.lit(" | "))
    if with_labels:
        told |= (F.col("_from") == 1) & (F.col("_labels") != plain)
    outcomes = cut_lineage(looked.groupBy("_piece", "_from").agg(*lists).where(told))
    small = rows_fit_broadcast(codes.sparkSession, outcomes.count())

    def outcome(start: int, *names: str) -> DataFrame:
        rows = outcomes.where(F.col("_from") == start).select(F.col("_piece").alias(f"_piece{start}"), *[F.col(n).alias(f"{n}{start}") for n in names])
        return F.broadcast(rows) if small else rows

    rows = codes.withColumns({"_piece0": root, "_piece1": F.when(later, rest)})
    rows = rows.join(outcome(0, "_unknown"), "_piece0", "left").join(outcome(1, "_unknown", *(["_labels"] if with_labels else [])), "_piece1", "left")
    none = F.array().cast("array<string>")
    added = {"inconnus": F.concat(F.coalesce("_unknown0", none), F.coalesce("_unknown1", none))}
    if with_labels:
        shown = F.replace(F.col("_piece1"), F.lit("&"), F.lit(" | "))
        added["libelles_extensions"] = F.coalesce("_labels1", shown, F.lit(""))
    return rows.select("code_postcoord", *key, "custom_id", "rang", *[c.alias(n) for n, c in added.items()])


def _with_segment_label(parts: DataFrame, segment: str, labels: DataFrame) -> DataFrame:
    """Label of a segment, looked up on the part before ``=``."""
    keyed = parts.withColumn("_code", F.substring_index(segment, "=", 1))
    return lookup_join(keyed, labels.select(F.col("code").alias("_code"), F.col("libelle").alias("_label")), "_code", "left")


def _label_list(segment: str) -> Column:
    """``ext : label`` of the segments after the first, joined by `` | ``; the bare extension when unlabelled."""
    shown = F.when(F.coalesce("_label", F.lit("")) == "", F.col(segment)).otherwise(F.concat_ws(" : ", segment, "_label"))
    ordered = F.array_sort(F.collect_list(F.when(F.col("_pos") > 0, F.struct("_pos", shown.alias("_shown")))))
    return F.array_join(F.transform(ordered, lambda s: s["_shown"]), " | ")


def accepted_codes(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("inconnus") == 0).drop("inconnus")


def rejected_codes(checked: DataFrame) -> DataFrame:
    """Rejection log: root, code, unknown segments joined by ``|``."""
    return checked.where(F.size("inconnus") > 0).select(
        F.col("custom_id").alias("code_racine"), "code_postcoord", F.array_join("inconnus", "|").alias("codes_inconnus"))


def response_errors(responses: DataFrame, checked: DataFrame, key: Sequence[str]) -> DataFrame:
    """Responses that yield no code, with the reason."""
    tally = checked.groupBy(*key).agg(F.count_if(F.size("inconnus") == 0).alias("_valid"))
    joined = responses.select(*key, "custom_id", F.col("contenu").isNull().alias("_empty")).join(tally, list(key), "left")
    reason: Column = (
        F.when(F.col("_empty"), F.lit(EMPTY_RESPONSE))
        .when(F.col("_valid").isNull(), F.lit(NO_CODE))
        .when(F.col("_valid") == 0, F.lit(ALL_REJECTED))
    )
    return joined.withColumn("erreur", reason).where(F.col("erreur").isNotNull()).select(
        *key, F.col("custom_id").alias("code_racine"), "erreur")


def extension_labels(codes: DataFrame, key: Sequence[str], labels: DataFrame) -> DataFrame:
    """Add ``libelles_extensions`` to codes that are already accepted; ``key`` identifies the row."""
    parts = codes.select(*codes.columns, F.posexplode(F.split("code_postcoord", "&")).alias("_pos", "_segment"))
    named = _with_segment_label(parts, "_segment", labels)
    kept = [c for c in codes.columns if c not in key]
    return named.groupBy(*key).agg(
        *[F.any_value(c).alias(c) for c in kept], _label_list("_segment").alias("libelles_extensions"))


def labelled_codes(accepted: DataFrame, roots: DataFrame) -> DataFrame:
    """Accepted codes, checked with their labels, and the label of their root; ``custom_id`` is the root."""
    root_labels = roots.select(F.col("code").alias("custom_id"), F.col("libelle").alias("libelle_racine"))
    named = lookup_join(accepted, root_labels, "custom_id", "left")
    return named.select(
        F.col("custom_id").alias("code_racine"), F.coalesce("libelle_racine", F.lit("")).alias("libelle_racine"),
        "code_postcoord", "libelles_extensions")


def full_labels(codes: DataFrame, order: Sequence[str]) -> DataFrame:
    """Label of a post-coordinated code: ``root - extensions``, or the root; first row of a code wins."""
    ext = F.coalesce(F.col("libelles_extensions"), F.lit(""))
    label = F.when(F.trim(ext) != "", F.concat_ws(" - ", "libelle_racine", "libelles_extensions")).otherwise(F.col("libelle_racine"))
    first = codes.groupBy("code_postcoord").agg(F.min_by(label, F.struct(*order)).alias("libelle"))
    return first.select("code_postcoord", "libelle")


def top_unknown(rejected: DataFrame, top: int = 15) -> DataFrame:
    """Most frequent unknown segments."""
    segments_of = rejected.select(F.explode(F.split("codes_inconnus", r"\|")).alias("segment"))
    return top_counts(segments_of, "segment", top)


def rejection_rate(checked: DataFrame) -> DataFrame:
    """Accepted, rejected, percentage rejected, and accepted codes per covered root."""
    ok = F.size("inconnus") == 0
    per_root = checked.groupBy("custom_id").agg(
        F.count_if(ok).alias("_ok"), F.count_if(~ok).alias("_ko"))
    totals = per_root.agg(
        F.sum("_ok").alias("n_valides"), F.sum("_ko").alias("n_rejetes"), F.count_if(F.col("_ok") > 0).alias("n_racines"))
    return totals.withColumns({
        "pct_rejetes": F.round(F.lit(100.0) * F.col("n_rejetes") / (F.col("n_valides") + F.col("n_rejetes")), 2),
        "moyenne_par_racine": F.round(F.col("n_valides") / F.nullif(F.col("n_racines"), F.lit(0)), 1),
    })


def long_answers(responses: DataFrame, minimum: int = MIN_ANSWER) -> DataFrame:
    return responses.where(F.length("contenu") >= minimum)


def generated_reports(responses: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Report text and formulations of each answer, joined to its request on the integer id.

    An answer that is not JSON, or has no report, keeps its raw text and empty formulations.
    """
    doc = answer_document(F.col("contenu"))
    rows = long_answers(responses).select(
        F.col("custom_id").try_cast("bigint").alias(key), "contenu", doc.alias("_doc"))
    report = F.try_variant_get("_doc", "$.CR", "string")
    forms = F.coalesce(F.to_json(F.try_variant_get("_doc", "$.formulations", "variant")), F.lit("{}"))
    parsed = rows.select(
        key,
        F.coalesce(report, F.col("contenu")).alias("crh"),
        F.when(report.isNull(), F.lit("{}")).otherwise(forms).alias("formulations"))
    return requests.join(parsed, key, "inner")


def unmatched_answers(responses: DataFrame, requests: DataFrame, key: str) -> DataFrame:
    """Answers that ``generated_reports`` leaves out, with the reason."""
    rows = responses.select("custom_id", F.col("custom_id").try_cast("bigint").alias(key), F.length("contenu").alias("_n"))
    known = requests.select(key).distinct().withColumn("_known", F.lit(True))
    reason = (
        F.when(F.col(key).isNull(), F.lit("identifiant illisible")).when(F.col("_known").isNull(), F.lit("demande inconnue"))
        .when(F.coalesce(F.col("_n"), F.lit(0)) < MIN_ANSWER, F.lit("réponse trop courte")))
    return lookup_join(rows, known, key, "left").withColumn("motif", reason).where(F.col("motif").isNotNull()).select("custom_id", "motif")
