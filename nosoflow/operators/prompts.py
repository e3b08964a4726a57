"""Prompt tables: axis prompts, diagnosis texts, one row per prompt, batches, documents."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nosoflow.operators.lookup import apply_group_verdicts, apply_verdicts
from nosoflow.operators.relational import first_per_key
from nosoflow.operators.sampling import draw_for_rows
from nosoflow.operators.scaling import cut_lineage, lookup_join, ordinals

# Sizes and wording of the prompts.
LISTED_VALUES = 100
BATCH_ROWS = 100
SINGLE_RULE = "NotAllowed = une seule valeur autorisée"
MULTIPLE_RULE = "AllowAlways = plusieurs valeurs autorisées simultanément"
PROMPT_HEAD = "CODE RACINE À POST-COORDONNER\nCode    : %s\nLibellé : %s\n\nAXES DE POST-COORDINATION DISPONIBLES (%s) :\n\n"
AXIS_HEAD, AXIS_RULE, AXIS_LIST, AXIS_REST = "AXE ", "\n  Règle : ", "\n  Codes d'extension autorisés (%s) :\n", "    ... (%s autres codes non listés)\n"
PROMPT_TAIL = (
    "TÂCHE : génère jusqu'à 100 codes post-coordonnés RÉALISTES pour ce code racine.\n"
    "CONTRAINTE : utilise UNIQUEMENT les codes d'extension listés ci-dessus.\n"
    "Format de sortie : un JSON avec une clé 'codes_postcoord' contenant la liste des codes."
)


def axis_prompts(values: DataFrame, sizes: DataFrame, labels: DataFrame, listed: int = LISTED_VALUES) -> DataFrame:
    """User prompt of each root: its axes, their rule, at most ``listed`` values each and the count of the rest.

    ``values`` has ``root``, ``axe``, ``id``, ``code``, ``libelle``; ``sizes`` the number of values of each axis;
    ``labels`` the ``root`` with its ``code_racine`` and ``libelle_racine``. Values are cut to ``listed`` on the
    map side, before any list is built.
    """
    shown = first_per_key(values, ["root", "axe"], ["id"], listed)
    line = F.concat(F.lit("    - "), F.col("code"), F.lit(" : "), F.col("libelle"))
    lists = shown.groupBy("root", "axe").agg(F.array_sort(F.collect_list(F.struct("id", line.alias("line")))).alias("_lines"))
    axes = sizes.where(F.col("n") > 0).join(lists, ["root", "axe"])
    per_root = axes.groupBy("root").agg(
        F.array_sort(F.collect_list(F.struct("axe", "allow_multiple", "n", "_lines"))).alias("_axes"))

    def block(axis: Column, index: Column) -> Column:
        rule = F.when(axis["allow_multiple"] == "NotAllowed", F.lit(SINGLE_RULE)).otherwise(F.lit(MULTIPLE_RULE))
        rest = F.when(
            axis["n"] > listed,
            F.format_string(AXIS_REST, (axis["n"] - listed).cast("string")),
        ).otherwise(F.lit(""))
        return F.concat(
            F.lit(AXIS_HEAD), (index + 1).cast("string"), F.lit(" — "), axis["axe"], F.lit(AXIS_RULE), rule,
            F.format_string(AXIS_LIST, axis["n"].cast("string")),
            F.array_join(F.transform(axis["_lines"], lambda v: v["line"]), "\n"), F.lit("\n"), rest, F.lit("\n"))

    named = per_root.join(labels, "root")
    head = F.format_string(PROMPT_HEAD, "code_racine", "libelle_racine", F.size("_axes").cast("string"))
    return named.select(
        F.col("code_racine").alias("code"),
        F.concat(head, F.array_join(F.transform("_axes", block), ""), F.lit(PROMPT_TAIL)).alias("user_prompt"))


def diagnosis_text(items: Column) -> Column:
    """``- label (CIM-11 : code)`` per line, from an array of ``struct<code, libelle>``."""
    return F.array_join(
        F.transform(items, lambda d: F.concat(F.lit("- "), d["libelle"], F.lit(" (CIM-11 : "), d["code"], F.lit(")"))), "\n")


def prompt_rows(
    profiles: DataFrame, key: str, root: str, kept: DataFrame, labels: DataFrame, titles: DataFrame
) -> DataFrame:
    """One row per prompt: the j-th kept code with its label; the root itself when none is left.

    ``kept`` holds the few drawn codes of each profile after verdicts.
    """
    named = lookup_join(kept.select(key, "code"), labels.select(F.col("code_postcoord").alias("code"), "libelle"), "code", "left")
    lists = named.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("code", "libelle"))).alias("_codes"))
    rooted = lookup_join(
        profiles.select(key, root), titles.select(F.col("code").alias(root), F.col("libelle").alias("_title")), root, "left")
    title = F.coalesce("_title", F.lit(""))
    alone = F.array(F.struct(F.col(root).alias("code"), title.alias("libelle")))
    rows = rooted.join(lists, key, "left").select(
        key, title.alias("_root_title"), F.posexplode(F.coalesce("_codes", alone)).alias("_pos", "c"))
    return rows.select(
        key, (F.col("_pos") + 1).cast("bigint").alias("prompt_num"), F.col("c.code").alias("code"),
        F.coalesce("c.libelle", "_root_title").alias("libelle"))


def report_prompts(
    profiles: DataFrame, postcoord: DataFrame, labels: DataFrame, titles: DataFrame, patient_verdicts: DataFrame,
    pair_verdicts: DataFrame, judge_group: Callable[[DataFrame], DataFrame], drawn: int = 5, seed: int = 5,
) -> DataFrame:
    """One row per prompt of each profile: ``id``, ``prompt_num``, ``code``, ``libelle``, ``texte_das``.

    ``profiles`` has ``id``, the main code ``code_dp`` and the associated codes ``das`` (array). Every associated code draws one post-coordinated code, or
    stays the root where there is none; it is dropped if the verdict on (``code_dp``, ``code``) refuses it, then if the verdict that ``judge_group`` gives on the
    rest of the profile's codes (rows of ``id``, ``code``; result ``id``, ``verdict``) lists it. The main code draws up to ``drawn`` codes, less those that the verdict on (``id``, ``code``) refuses; without any left the root serves.
    A missing verdict keeps the code.
    """
    roots = titles.select(F.col("code").alias("racine"), F.col("libelle").alias("_titre"))
    named = labels.select(F.col("code_postcoord").alias("code"), "libelle")
    das = profiles.select("id", "code_dp", F.posexplode("das").alias("rang", "racine"))
    das = das.withColumn("_cle", F.concat_ws("-", "id", "rang"))
    one = draw_for_rows(das, "_cle", "racine", postcoord.select(F.col("code_racine").alias("racine"), "code_postcoord"), "code_postcoord", 1, seed)
    das = lookup_join(das, one.select("_cle", "code_postcoord"), "_cle", "left")
    das = das.select("id", "code_dp", "rang", "racine", F.coalesce("code_postcoord", "racine").alias("code"))
    das = cut_lineage(apply_verdicts(das, pair_verdicts, ["code_dp", "code"]))
    das = apply_group_verdicts(das, judge_group(das.select("id", "code")), "id", "code")
    das = lookup_join(lookup_join(das, named, "code", "left"), roots, "racine", "left")
    item = F.struct("rang", "code", F.coalesce("libelle", "_titre", F.lit("")).alias("libelle"))
    lists = das.groupBy("id").agg(F.array_sort(F.collect_list(item)).alias("_das"))

    chosen = draw_for_rows(profiles, "id", "code_dp", postcoord.select(F.col("code_racine").alias("code_dp"), "code_postcoord"), "code_postcoord", drawn, seed)
    kept = apply_verdicts(chosen.select("id", F.col("code_postcoord").alias("code")), patient_verdicts, ["id", "code"])
    rows = prompt_rows(profiles, "id", "code_dp", kept, labels, titles)
    text = F.coalesce(diagnosis_text(F.transform("_das", lambda d: F.struct(d["code"].alias("code"), d["libelle"].alias("libelle")))), F.lit(""))
    return lookup_join(rows, lists, "id", "left").select("id", "prompt_num", "code", "libelle", text.alias("texte_das"))


def batches(rows: DataFrame, order: Sequence[str], bucket: Column, size: int = BATCH_ROWS) -> DataFrame:
    """Batch number of each row in order, ``size`` rows per batch."""
    numbered = ordinals(rows, order, bucket, name="_pos")
    return numbered.withColumn("lot", F.floor((F.col("_pos") - 1) / size)).drop("_pos")


def request_lines(prompts: DataFrame, system: Column, prefix: Column, max_tokens: int = 8000) -> DataFrame:
    """One JSON request per prompt: ``custom_id`` and a body with three messages."""

    def message(role: str, content: Column, *more: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"), *more)

    messages = [message("system", system, F.lit(None).cast("boolean").alias("prefix")),
                message("user", F.col("user_prompt"), F.lit(None).cast("boolean").alias("prefix")),
                message("assistant", prefix, F.lit(True).alias("prefix"))]
    body = F.struct(F.lit(max_tokens).alias("max_tokens"), F.array(*messages).alias("messages"))
    return prompts.select(F.to_json(F.struct(F.col("code").alias("custom_id"), body.alias("body"))).alias("value"))


def capped_list(items: Column, cap: int, note: str = "... (%s autres codes non listés)") -> Column:
    """First ``cap`` strings of a list and a note with the count of the others."""
    rest = F.size(items) - cap
    return F.when(rest > 0, F.concat(F.slice(items, 1, cap), F.array(F.format_string(note, rest.cast("string"))))).otherwise(items)


def formulation_text(formulations: Column, section: str, title: str) -> Column:
    """Markdown list of the expressions of each entry of one formulations section, empty when absent."""
    entries = F.map_entries(F.try_variant_get(formulations, f"$.{section}", "map<string,array<string>>"))
    ordered = F.array_sort(entries)
    body = F.array_join(
        F.transform(
            ordered,
            lambda e: F.concat(
                F.lit("\n\n**"), e["key"], F.lit("**"),
                F.array_join(F.transform(e["value"], lambda x: F.concat(F.lit("\n- "), x)), "")),
        ), "")
    return F.when(F.size(entries) > 0, F.concat(F.lit("\n\n### " + title), body)).otherwise(F.lit(""))


def report_document(reports: DataFrame) -> DataFrame:
    """Whole report as one text: scenario, codes, report, formulations.

    ``reports`` has ``id``, ``user_prompt``, ``code_dp``, ``libelle_dp``, ``das`` (array of
    ``struct<code, libelle>``), ``crh``, ``formulations`` (JSON text).
    """
    forms = F.try_parse_json(F.coalesce("formulations", F.lit("{}")))
    shown = F.when(F.coalesce("libelle_dp", F.lit("")) == "", F.lit("")).otherwise(F.concat("libelle_dp", F.lit(" ")))
    main = F.when(
        F.coalesce("code_dp", F.lit("")) != "",
        F.concat(F.lit("\n**Diagnostic principal :** "), shown, F.lit("("), F.col("code_dp"), F.lit(")")),
    ).otherwise(F.lit(""))
    others = F.when(
        F.size("das") > 0,
        F.concat(
            F.lit("\n\n**Diagnostics associés :**"),
            F.array_join(F.transform("das", lambda d: F.concat(
                F.lit("\n- "),
                F.when(F.coalesce(d["libelle"], F.lit("")) == "", F.lit("")).otherwise(F.concat(d["libelle"], F.lit(" "))),
                F.lit("("), d["code"], F.lit(")"))), "")),
    ).otherwise(F.lit(""))
    sections = F.concat(
        formulation_text(forms, "diagnostics", "Diagnostics"), formulation_text(forms, "informations", "Informations"))
    dictionary = F.when(
        forms.isNotNull() & (F.to_json(forms) != "{}"),
        F.concat(F.lit("\n\n---\n\n## Dictionnaire de formulations"), sections),
    ).otherwise(F.lit(""))
    text = F.concat(
        F.lit("## Scénario de départ\n\n"), F.col("user_prompt"), F.lit("\n\n---\n\n## Codes CIM-11\n"), main, others,
        F.lit("\n\n---\n\n"), F.col("crh"), dictionary)
    return reports.select("id", text.alias("document")).where(F.length("document") >= 10)
