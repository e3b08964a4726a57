"""Jobs from files to tables: what a user runs. Each one chains operators and writes its result."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nosoflow.operators import evaluate, hierarchy, lookup, pages, prompts, quality, relational, reports, sampling, terminology, verify
from nosoflow.operators.scaling import Rounds, checkpointed, cut_lineage, lookup_join
from nosoflow.sources import readers, writers

ORD = ["ord"]


@dataclass(frozen=True)
class TerminologyFiles:
    """Paths of the input files of a load.

    ``quoted_newlines`` names those with line breaks inside quotes, which are put together from their lines.
    """

    terms: str
    synonyms: str
    icd_map: str
    postcoord: str
    axes: str
    examples: str | None = None
    quoted_newlines: frozenset[str] = frozenset({"synonyms"})


def _ordered(spark: SparkSession, files: TerminologyFiles, name: str, schema, delimiter: str = ",") -> DataFrame:
    path = getattr(files, name)
    if name in files.quoted_newlines:
        return readers.read_quoted_csv(spark, path, schema, delimiter)
    return readers.with_file_order(readers.read_csv(spark, path, schema, delimiter, multiline=False))


def load_tables(spark: SparkSession, files: TerminologyFiles, out: str, limit: int = 0) -> dict[str, int]:
    """Load the terminology and the training reports as Parquet tables; ``limit`` rows per reference table, 0 for all.

    The code table is written first and read back: the other loads filter on it. Returns how many rows a limit left out of each table.
    """
    left_out = {}

    terms = _ordered(spark, files, "terms", readers.TERMS_CSV)
    terminology.load_codes(terms, ORD, limit).write.mode("overwrite").parquet(f"{out}/code_cim11")
    codes = spark.read.parquet(f"{out}/code_cim11")
    if limit:
        left_out["code_cim11"] = terminology.load_codes(terms, ORD).count() - codes.count()

    mapping = _ordered(spark, files, "icd_map", readers.ICD_MAP_CSV).withColumnsRenamed({"icd10Code": "icd10", "icd11Code": "icd11"})
    synonyms = _ordered(spark, files, "synonyms", readers.SYNONYMS_CSV, ";")
    postcoord, axes = _ordered(spark, files, "postcoord", readers.POSTCOORD_CSV), _ordered(spark, files, "axes", readers.AXES_CSV)
    icd = terminology.icd_map(mapping, ORD)

    def references(rows: int) -> dict[str, DataFrame]:
        return {
            "synonyme": terminology.load_synonyms(synonyms, icd, codes, ORD, rows).drop("ord"),
            "code_postcoord": terminology.load_postcoord(postcoord, codes, ORD, rows),
            "axe_postcoord": terminology.load_axes(axes, codes, ORD, rows)}

    tables = references(limit)
    if files.examples:
        lines = readers.number_lines(readers.read_lines(spark, files.examples))
        rows = reports.example_reports(reports.parse_examples(lines))
        tables |= {
            "patient_fictif": reports.synthetic_patients(rows), "sejour": reports.synthetic_stays(rows),
            "crh": reports.report_table(rows), "diagnostic": reports.load_diagnostics(rows, codes)}
    for name, table in tables.items():
        table.write.mode("overwrite").parquet(f"{out}/{name}")
    if limit:
        left_out |= {name: table.count() - spark.read.parquet(f"{out}/{name}").count() for name, table in references(0).items()}
    return left_out


def extract_documented_codes(spark: SparkSession, base: str, out: str, limit: int = 50) -> None:
    """Well documented codes of loaded tables, as one CSV file of at most ``limit`` rows."""
    table = {n: spark.read.parquet(f"{base}/{n}") for n in ("code_cim11", "diagnostic", "crh", "synonyme", "code_postcoord")}
    found = terminology.well_documented_codes(
        table["code_cim11"], table["diagnostic"], table["crh"], table["synonyme"], table["code_postcoord"], limit)
    writers.write_small_csv(found, out, [F.desc("nb_postcoord"), "code_cim11"], limit)


def extract_top_roots(spark: SparkSession, csv: str, out: str, top: int = 20) -> None:
    """Roots with the most post-coordinated codes, from the large CSV, in one pass over it."""
    rows = readers.read_csv(spark, csv, readers.POSTCOORD_CSV, multiline=False)
    ranked = terminology.top_roots(rows, top)
    writers.write_small_csv(ranked, out, [F.desc("nb_combinaisons_realistes"), "code_racine"], top)


def extract_items(spark: SparkSession, stored: str, out: str, base: str, patterns: pages.ItemPatterns = pages.NEWS) -> None:
    """Items of stored pages as CSV; fails when none is found. Pages without a complete item are listed, with the reason, in ``out`` followed by ``_ecarts``."""
    read = readers.read_pages(spark, stored)
    writers.write_csv(pages.unrecognised_pages(read, "page", "html", patterns), f"{out.rstrip('/')}_ecarts")
    found = pages.page_items(read, "page", "html", patterns, base)
    checked = quality.non_empty(found, "structure de page non reconnue")
    writers.write_csv(checked.drop("page", "rang"), out)


def build_dictionary(sources: Mapping[str, DataFrame], out: str) -> None:
    """Synonym dictionary of aligned sources (``code``, ``synonyme``, ``ord``) without the Z chapter, as ``;`` CSV."""
    rows = readers.union_parts(sources, ["code", "synonyme", "ord"])
    kept = terminology.without_chapter(terminology.synonym_dictionary(rows, ["_part", "ord"]))
    writers.write_csv(kept.select("code", "synonyme", "source"), out, ";", bom=True)


def verify_responses(spark: SparkSession, batches: str, roots: DataFrame, extensions: DataFrame, out: str) -> None:
    """Accepted codes with labels, and the rejection log, from a folder of batch responses."""
    lines = readers.number_lines(readers.read_lines(spark, batches))
    checked = verify.check_codes(verify.read_responses(lines), ["num"], roots, extensions, with_labels=True)
    # written once, read twice: the two outputs do not parse the responses again
    checked.write.mode("overwrite").parquet(f"{out}/controle")
    checked = spark.read.parquet(f"{out}/controle")
    writers.write_csv(verify.labelled_codes(verify.accepted_codes(checked), roots), f"{out}/codes")
    writers.write_csv(verify.rejected_codes(checked), f"{out}/rejets")


def count_postcoordination(
    spark: SparkSession, nodes_path: str, titles: DataFrame, root_uri: str, out: str, max_values: int = hierarchy.MAX_AXIS_VALUES, run: str | None = None
) -> None:
    """Pairs and combinations of every leaf code, per code and per chapter, and the roots with an oversize axis.

    ``titles`` has ``code``, ``uri`` of the official titles. ``run`` names a folder for the rounds of the walks: started again with it after a failure, the job goes on
    at the last finished round.
    """
    keep = Rounds(spark, run) if run else checkpointed
    documents = readers.read_nodes(spark, nodes_path)
    nodes = documents.select(
        readers.https(F.col("uri")).alias("id"), "code", F.col("title").getField("@value").alias("title"))
    edges = readers.node_edges(documents)
    coded = titles.select("code", readers.https(F.col("uri")).alias("id")).distinct()
    childless = nodes.select("id").join(edges.select(F.col("parent").alias("id")).distinct(), "id", "left_anti")
    leaves = coded.join(childless, "id", "left_semi")

    axes = hierarchy.axes_of_nodes(documents).join(leaves.select(F.col("id").alias("uri")), "uri", "left_semi").select(
        F.col("uri").alias("root"), F.col("axe_nom").alias("axe"), "allow_multiple", F.col("start_uri").alias("start_id"))
    kept = hierarchy.countable_axes(axes, nodes, edges, max_values, keep)
    values, impossible = hierarchy.axis_values(kept.axes, kept.reached), kept.impossible
    labels = hierarchy.chapter_labels(readers.ranked_children(documents, root_uri), nodes)
    chapter = hierarchy.chapters(nodes, readers.first_parents(documents), labels, keep=keep)
    roots = leaves.select(F.col("id").alias("root")).join(impossible, "root", "left_anti")
    summary = hierarchy.root_summary(roots, hierarchy.root_pairs(values), hierarchy.combinations(kept.sizes), chapter)
    summary = summary.join(leaves.select(F.col("id").alias("root"), "code"), "root").drop("root")
    summary.write.mode("overwrite").parquet(f"{out}/par_code")
    written = spark.read.parquet(f"{out}/par_code")
    hierarchy.chapter_rollup(written).write.mode("overwrite").parquet(f"{out}/par_chapitre")
    impossible.join(leaves.withColumnRenamed("id", "root"), "root").select("code").write.mode("overwrite").parquet(f"{out}/impossibles")


def generate_prompts(
    profiles: DataFrame, mapping: DataFrame, postcoord: DataFrame, labels: DataFrame, titles: DataFrame, patient_verdicts: DataFrame,
    pair_verdicts: DataFrame, judge_group: Callable[[DataFrame], DataFrame], out: str, n: int = 500, drawn: int = 5, batch_rows: int = prompts.BATCH_ROWS, seed: int = 7,
) -> str:
    """Prompts of a weighted sample of profiles, numbered in batches, as Parquet in a folder of this run; returns the folder.

    ``profiles`` has ``id``, ``icd10_raw``, ``icd10_sec`` (separated by commas) and the weight ``nb``; ``mapping`` is a translation map (``lookup.translation_map``). Profiles whose main
    code does not translate to a specific one give no prompt. Verdicts are those of ``prompts.report_prompts``.
    """
    sample = cut_lineage(sampling.weighted_sample(profiles, n, "nb", "id", seed))
    lists = lookup.translate_lists(sample.withColumn("codes", F.split("icd10_sec", ",")), "id", "codes", mapping, "das")
    usable = cut_lineage(lookup.specific_profiles(lists, "icd10_raw", mapping).select("id", F.col("icd11").alias("code_dp"), "das"))
    rows = prompts.report_prompts(usable, postcoord, labels, titles, patient_verdicts, pair_verdicts, judge_group, drawn, seed)
    numbered = prompts.batches(cut_lineage(rows), ["id", "prompt_num"], F.floor(F.col("id") / 1_000_000), batch_rows)
    return writers.write_run(numbered, out)


def validate_corpus(spark: SparkSession, path: str, min_examples: int = 10) -> DataFrame:
    """Broken rules of a JSONL corpus, numbered from line one; no row means valid."""
    lines = readers.number_lines(readers.read_lines(spark, path), 1)
    return quality.corpus_errors(reports.parse_examples(lines), min_examples)


def evaluate_answers(base: Mapping[str, DataFrame], answers: DataFrame, limit: int = 15) -> DataFrame:
    """Agreement counts over the evaluation set; ``answers`` has ``id_crh``, ``code_predit``, ``libelle_predit``."""
    cases = evaluate.evaluation_set(base["crh"], base["diagnostic"], base["code_cim11"], limit)
    judged = evaluate.agreement(lookup_join(cases.drop("texte_crh"), answers, "id_crh", "left"))
    return evaluate.agreement_counts(judged)


def table_report(base: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of each loaded table."""
    return relational.table_counts(base)
