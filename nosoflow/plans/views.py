"""Inputs derived from the given tables, in SQL that Spark and DuckDB share.

Every view is a projection of one table (codes are computed from the row's own keys, so
no view needs a join), except ``v_answer``, which reads ``v_diag`` and ``part``. Operators are written
separately on each side; only their inputs come from here.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from nosoflow.operators.scaling import spread_small

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def _code(key: str) -> str:
    """ICD-11 style code of a part key; every fifth key repeats the previous code, some end in Y or Z."""
    base = f"({key} - CASE WHEN {key} % 5 = 4 THEN 1 ELSE 0 END)"
    return (
        f"'C' || lpad(CAST({base} AS STRING), 5, '0') || CASE WHEN {base} % 7 = 0 THEN 'Z' WHEN {base} % 11 = 0 THEN 'Y' ELSE '' END"
    )


def _icd10(key: str, short: str) -> str:
    return (
        f"chr(CAST(65 + {key} % 26 AS INT)) || lpad(CAST({key} % 100 AS STRING), 2, '0')"
        f" || CASE WHEN {key} % 3 = 0 THEN '' ELSE '{short}' || CAST({key} % 10 AS STRING) END"
    )


_ROOT = _code("l_partkey")
_EXTENSIONS = (
    "'&X' || lpad(CAST(l_suppkey % 100 AS STRING), 2, '0') || CASE WHEN l_linenumber % 2 = 0"
    " THEN '&X' || lpad(CAST(CAST(l_quantity AS INT) AS STRING), 2, '0') ELSE '' END"
)
_ORD = "l_orderkey AS ord1, l_linenumber AS ord2, l_partkey AS ord3, l_suppkey AS ord4, l_extendedprice AS ord5"
_QUOTE = "chr(92) || chr(34)"

VIEWS = {
    "v_term": f"""
        SELECT p_partkey AS ord, {_code('p_partkey')} AS code, p_name AS texte,
          CASE WHEN p_partkey % 5 = 4 THEN 'indexTerm' ELSE 'title' END AS type FROM part""",
    "v_map10": f"SELECT p_partkey AS ord, {_icd10('p_partkey', '.')} AS icd10, {_code('p_partkey')} AS icd11 FROM part",
    "v_profile": """
        SELECT o_orderkey AS id, chr(CAST(65 + o_orderkey % 26 AS INT)) || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0')
          || CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE CAST(o_orderkey % 10 AS STRING) END
          || CASE WHEN o_orderkey % 9 = 0 THEN '0' ELSE '' END AS icd10_raw,
          CASE WHEN o_orderkey % 8 = 0 THEN NULL WHEN o_orderkey % 8 = 1 THEN '' ELSE
            chr(CAST(65 + o_custkey % 26 AS INT)) || lpad(CAST(o_custkey % 100 AS STRING), 2, '0') || CAST(o_custkey % 10 AS STRING)
            || ',' || chr(CAST(65 + o_orderkey % 26 AS INT)) || lpad(CAST(o_orderkey % 100 AS STRING), 2, '0') || ', ,'
            || chr(CAST(65 + o_custkey % 7 AS INT)) || lpad(CAST(o_orderkey % 50 AS STRING), 2, '0') || '.1' END AS icd10_sec,
          CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderkey % 30 END AS los, 1 + o_orderkey % 50 AS nb,
          o_orderstatus AS admission_type FROM orders""",
    "v_syn": f"""
        SELECT {_ORD}, CASE WHEN l_linenumber = 7 THEN NULL ELSE {_icd10('l_partkey', '.')} END AS code,
          'terme ' || CAST((l_partkey * 7 + l_suppkey) % 5000 AS STRING) AS synonyme,
          'source ' || CAST(l_suppkey % 4 AS STRING) AS source FROM lineitem""",
    "v_pc": f"""
        SELECT {_ORD}, {_ROOT} AS code_racine, {_ROOT} || {_EXTENSIONS} AS code_postcoord,
          CASE WHEN l_suppkey % 3 = 0 THEN NULL ELSE 'extension ' || CAST(l_suppkey % 100 AS STRING) END AS libelles_extensions
        FROM lineitem""",
    "v_diag": f"""
        SELECT l_orderkey % (SELECT count(*) FROM documents) AS id_crh,
          CASE WHEN l_linenumber = 1 THEN 'DP' ELSE 'DAS' END AS type_diag, {_ROOT} AS code_cim11,
          l_orderkey AS ord1, l_linenumber AS ord2, l_suppkey AS ord3, l_partkey AS ord4 FROM lineitem""",
    "v_crh": "SELECT doc_id AS id_crh, doc_id % 97 AS id_sejour, text AS texte_crh FROM documents",
    "v_reply": f"""
        SELECT p_partkey AS id, CASE WHEN p_partkey % 13 = 0 THEN 'Aucun code fourni'
          ELSE 'DP : ' || p_name || ', sans précision (' || {_code('p_partkey')} || ')' || chr(10) ||
            CASE WHEN p_partkey % 3 = 0 THEN 'DAS : aucun' ELSE 'DAS : ' || CASE WHEN p_partkey % 5 = 4 THEN 'indexTerm' ELSE 'title' END
              || ', suite (' || {_code('p_partkey')} || '&XA1), autre (5B7Z)' END END AS reply FROM part""",
    "v_node": """
        SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor((p_partkey - 1) / 3) AS BIGINT) END AS parent,
          CASE WHEN p_partkey % 10 = 0 THEN NULL WHEN p_partkey % 2 = 0 THEN 'X' || lpad(CAST(p_partkey AS STRING), 5, '0')
            ELSE 'C' || lpad(CAST(p_partkey AS STRING), 5, '0') END AS code, p_name AS title FROM part""",
    "v_axis": """
        SELECT root, a AS axe, (root * (a + 1)) % (SELECT count(*) FROM part) AS start_id,
          CASE WHEN a = 1 THEN 'AllowAlways' ELSE 'NotAllowed' END AS allow_multiple
        FROM (SELECT p_partkey AS root, {one_two_three} AS a FROM part WHERE p_partkey % 20 = 1) axes""",
    "v_axis_csv": f"""
        SELECT p_partkey AS ord, {_code('p_partkey')} AS code, 'axe ' || CAST(p_partkey % 4 AS STRING) AS axe_nom,
          CASE WHEN p_partkey % 4 = 1 THEN 'AllowAlways' ELSE 'NotAllowed' END AS allow_multiple,
          CASE WHEN p_partkey % 6 = 0 THEN '' ELSE CAST(p_size * 10 AS STRING) END AS taille_axe,
          CASE WHEN p_size > 40 THEN 'trop gros' ELSE '' END AS raison_arret FROM part""",
    "v_pred": """
        SELECT event_id, ts, user_id AS model_id, value AS latence_ms, event_type = 'error' AS is_error,
          (event_type = 'view' AND value < 10) AS dp_missing, 'texte ' || props AS texte FROM events""",
    "v_message": "SELECT conv_id, turn, role, text AS content FROM conversations",
    "v_resp": f"""
        SELECT ord1, ord2, ord3, ord4, ord5, CASE
          WHEN k % 97 = 0 THEN '{{"custom_id": "' || root || '", coupé'
          WHEN k % 89 = 0 THEN '{{"custom_id": "' || root || '", "response": {{"body": {{"choices": []}}}}}}'
          WHEN k % 83 = 0 THEN '{{"custom_id": "' || root || '", "response": {{"body": {{"choices": [{{"message": {{"content": "rien à proposer"}}}}]}}}}}}'
          ELSE '{{"custom_id": "' || root || '", "response": {{"body": {{"choices": [{{"message": {{"content": "codes_postcoord: ['
            || {_QUOTE} || root || ext || {_QUOTE} || CASE WHEN k % 3 = 0 THEN ', ' || {_QUOTE} || root || '&X1' || CAST(k % 10 AS STRING)
              || '=3' || {_QUOTE} WHEN k % 3 = 1 THEN ', ' || {_QUOTE} || root || '&' || root || {_QUOTE} ELSE '' END
            || ']"}}}}]}}}}}}' END AS brut
        FROM (SELECT {_ORD}, l_orderkey * 7 + l_partkey AS k, {_ROOT} AS root, {_EXTENSIONS} AS ext FROM lineitem) r""",
    "v_answer": f"""
        SELECT d.id_crh, CASE d.id_crh % 4
          WHEN 0 THEN 'DP : ' || p.p_name || ' (' || d.code || ')'
          WHEN 1 THEN 'DP : Ô ' || upper(p.p_name) || ', précisé (' || d.code || '&XA1)'
          WHEN 2 THEN 'DP : autre chose (AA00.1)' || chr(10) || 'DAS : aucun'
          ELSE 'Aucun code fourni' END AS reply
        FROM (SELECT id_crh, min(code_cim11) AS code FROM v_diag WHERE type_diag = 'DP' GROUP BY id_crh) d
        JOIN (SELECT min(p_partkey) AS k, {_code('p_partkey')} AS code FROM part GROUP BY 2) t ON t.code = d.code
        JOIN part p ON p.p_partkey = t.k""",
    "v_codes_base": "SELECT id_crh AS id, code_cim11 || CASE WHEN ord3 % 2 = 0 THEN '&XB2' ELSE '' END AS code FROM v_diag WHERE ord1 % 10 < 5",
    "v_codes_fine": "SELECT id_crh AS id, code_cim11 || CASE WHEN ord3 % 5 = 0 THEN '&XA1' ELSE '' END AS code FROM v_diag WHERE ord1 % 10 < 9",
}
DEPENDS = {
    name: [other for other in VIEWS if re.search(rf"\b{other}\b", text)] for name, text in VIEWS.items()
}


def _ordered(names: list[str]) -> list[str]:
    done: list[str] = []
    for name in names:
        for needed in [*_ordered([d for d in DEPENDS[name] if d != name]), name]:
            if needed not in done:
                done.append(needed)
    return done


def with_clause(sql: str) -> str:
    """The query with the views it names as a WITH prefix, in DuckDB's dialect."""
    named = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
    parts = [f"{v} AS ({VIEWS[v].replace('{one_two_three}', 'unnest([1, 2, 3])').strip()})" for v in _ordered(named)]
    body = sql.strip()
    if not parts:
        return body
    recursive = ""
    if body.upper().startswith("WITH RECURSIVE"):
        recursive, body = "RECURSIVE ", body[len("WITH RECURSIVE"):].strip()
    elif body.upper().startswith("WITH"):
        body = body[len("WITH"):].strip()
    else:
        return "WITH " + ",\n".join(parts) + "\n" + body
    return f"WITH {recursive}" + ",\n".join(parts) + ",\n" + body


class Inputs:
    """Tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        return self.sql(VIEWS[name].replace("{one_two_three}", "explode(array(1, 2, 3))"), [n for n in DEPENDS[name] if n != name])

    def sql(self, text: str, views: Iterable[str] = tuple(VIEWS)) -> DataFrame:
        """A statement over the tables and the views."""
        frames = {}
        for needed in [*TABLES, *views]:
            if re.search(rf"\b{needed}\b", text):
                frames[needed] = self.table(needed) if needed in TABLES else self.view(needed)
        for needed in frames:
            text = re.sub(rf"\b(FROM|JOIN) {needed}\b", lambda m, n=needed: f"{m.group(1)} <<{n}>>", text)
        text = text.replace("{", "{{").replace("}", "}}").replace("<<", "{").replace(">>", "}")
        return self.spark.sql(text, **frames)

    def spread(self, name: str) -> DataFrame:
        """A view for heavy work per row: a small file is spread over all cores."""
        return spread_small(self.view(name))

    def spread_table(self, name: str) -> DataFrame:
        return spread_small(self.table(name))

    __call__ = view
