"""Tables through files: written by the writers, read back by the readers."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nosoflow.operators import relational
from nosoflow.operators.scaling import work_folder
from nosoflow.plans import jobs
from nosoflow.plans.registry import query
from nosoflow.plans.views import Inputs
from nosoflow.sources import manifests, readers, writers
from nosoflow.streaming.jobs import batch_folder, read_files, run_batches

# Values with a line break, a separator, doubled quotes, or nothing.
SYNONYM = "CASE WHEN ord2 % 5 = 0 THEN NULL ELSE synonyme || chr(10) || '\"' || source || '\"; ' || chr(10) || chr(10) || code END"


@query(f"SELECT code, {SYNONYM} AS synonyme, source FROM v_syn")
def quoted_csv(i: Inputs) -> DataFrame:
    """Synonyms with line breaks inside quotes, as CSV and back, split over tasks."""
    path = work_folder(i.spark, "csv")
    rows = i("v_syn").select("code", F.expr(SYNONYM.replace("chr(", "char(")).alias("synonyme"), "source")
    writers.write_csv(rows, path, ";", bom=True)
    return readers.read_quoted_csv(i.spark, path, readers.SYNONYMS_CSV, ";").drop("ord")


@query("""SELECT code_racine, CAST(count(*) AS VARCHAR) AS nb_combinaisons_realistes FROM v_pc
    GROUP BY code_racine ORDER BY count(*) DESC, 1 LIMIT 20""")
def csv_top_roots(i: Inputs) -> DataFrame:
    """The job over the large CSV, its report read back."""
    base = work_folder(i.spark, "racines")
    rows = i("v_pc").select("code_racine", F.lit("").alias("libelle_racine"), "code_postcoord", "libelles_extensions")
    writers.write_csv(rows, f"{base}/csv")
    jobs.extract_top_roots(i.spark, f"{base}/csv", f"{base}/rapport", 20)
    return readers.read_csv(i.spark, f"{base}/rapport", "code_racine string, nb_combinaisons_realistes string")


@query("SELECT row_number() OVER (ORDER BY id) AS num, id || ' ' || coalesce(code, '') || ' ' || title AS brut FROM v_node")
def numbered_lines(i: Inputs) -> DataFrame:
    """Lines of several files, numbered through all of them in the files' order."""
    path = work_folder(i.spark, "lignes")
    lines = i("v_node").orderBy("id").select(F.concat_ws(" ", "id", F.coalesce("code", F.lit("")), "title").alias("brut"))
    writers.write_lines(lines, path)
    return readers.number_lines(readers.read_lines(i.spark, path), 1)


@query("""SELECT 'https://h/' || parent AS parent, 'https://h/' || id AS child FROM v_node WHERE parent IS NOT NULL""")
def node_files(i: Inputs) -> DataFrame:
    """Node documents as JSON lines, and the edges that they hold."""
    path = work_folder(i.spark, "noeuds")
    uri = lambda c: F.concat(F.lit("http://h/"), c.cast("string"))
    nodes = i("v_node")
    children = nodes.where("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.array_sort(F.collect_list(uri(F.col("id")))).alias("child"))
    written = nodes.join(children, "id", "left").select(
        uri(F.col("id")).alias("uri"), "code", F.struct(F.col("title").alias("@value")).alias("title"), F.coalesce("child", F.array().cast("array<string>")).alias("child"))
    written.write.json(path)
    return readers.node_edges(readers.read_nodes(i.spark, path))


@query("""SELECT id, '20250102_030405' AS run_id FROM v_node WHERE id % 2 = 0
    UNION ALL SELECT id, '20250102_030406' FROM v_node WHERE id % 2 = 1""")
def run_folders(i: Inputs) -> DataFrame:
    """Two runs, each in a folder of its own, read together."""
    base = work_folder(i.spark, "passages")
    for second, odd in ((5, 0), (6, 1)):
        writers.write_run(i("v_node").where(F.col("id") % 2 == odd).select("id"), base, datetime(2025, 1, 2, 3, 4, second))
    return i.spark.read.schema("id bigint, run_id string").parquet(base)


@query("SELECT event_id, user_id, 1 AS lot FROM events")
def resumed_batches(i: Inputs) -> DataFrame:
    """A stream started twice: the second start finds every file done, so each event is there once."""
    out, state = work_folder(i.spark, "lots"), work_folder(i.spark, "etat")
    schema = i.table("events").schema
    for _ in range(2):
        rows = read_files(i.spark, f"{i.folder}/events*.parquet", schema).select("event_id", "user_id")
        run_batches(rows, state, lambda batch, number: batch.write.mode("overwrite").parquet(batch_folder(out, number)))
    return i.spark.read.parquet(out).select("event_id", "user_id", F.lit(1).alias("lot"))


@query("""SELECT page_id, left(regexp_extract(html, '[0-9]{4}-[0-9]{2}-[0-9]{2}T?[0-9:]*'), 10) AS date FROM pages""")
def page_dates(i: Inputs) -> DataFrame:
    """The date part of the first timestamp of each page."""
    return i.table("pages").select("page_id", F.substring(F.regexp_extract("html", "[0-9]{4}-[0-9]{2}-[0-9]{2}T?[0-9:]*", 0), 1, 10).alias("date"))


@query("""SELECT 'patient_fictif' AS table_name, (SELECT count(*) FROM customer WHERE c_custkey % 50 <> 7) AS n
    UNION ALL SELECT 'sejour', (SELECT count(*) FROM orders WHERE o_custkey % 50 <> 7)
    UNION ALL SELECT 'crh', (SELECT count(*) FROM orders WHERE o_custkey % 50 <> 7)
    UNION ALL SELECT 'diagnostic', (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 7))""")
def file_erase(i: Inputs) -> DataFrame:
    """Patients erased from tables of files; only the files that hold them or their stays, reports and diagnoses are rewritten."""
    base = work_folder(i.spark, "base")
    orders = i.table("orders")
    tables = {
        "patient_fictif": i.table("customer").select(F.col("c_custkey").alias("id_patient")),
        "sejour": orders.select(F.col("o_orderkey").alias("id_sejour"), F.col("o_custkey").alias("id_patient")),
        "crh": orders.select(F.col("o_orderkey").alias("id_crh"), F.col("o_orderkey").alias("id_sejour")),
        "diagnostic": i.table("lineitem").select(F.col("l_orderkey").alias("id_crh"), F.col("l_linenumber").alias("rang"))}
    schemas = {name: table.schema for name, table in tables.items()}
    manifests.create(tables, base)
    manifests.erase_patients(i.spark, base, tables["patient_fictif"].where("id_patient % 50 = 7"), schemas)
    left = {name: manifests.read(i.spark, base, name, schema) for name, schema in schemas.items()}
    return relational.table_counts(left).withColumnRenamed("n_rows", "n")
