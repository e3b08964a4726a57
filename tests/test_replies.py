import time

import pytest
from pyspark.sql import functions as F

from nosoflow.functions.replies import diagnosis_rows, message_of, parse_reply

CASES = [
    ("DP : Entorse du genou, sans précision (NC93.6Z)\nDAS : aucun", ("Entorse du genou, sans précision", "NC93.6Z"), []),
    ("DP : Infection tardive (1A62.2&XA6GV0)\nDAS : aucun", ("Infection tardive", "1A62.2&XA6GV0"), []),
    ("DP : Chute (1A62.2&XA6GV0&XA3KX0)\nDAS : aucun", ("Chute", "1A62.2&XA6GV0&XA3KX0"), []),
    ("DP : Asthme (CA23)\nDAS : Anémie, sans précision (3A9Z), Carence, autre (5B57.Z),Candidose (1F23.0&XA1)",
     ("Asthme", "CA23"), [("Anémie, sans précision", "3A9Z"), ("Carence, autre", "5B57.Z"), ("Candidose", "1F23.0&XA1")]),
    # no marker: the whole head is searched; nothing after the marker: likewise
    ("Asthme (CA23)", ("Asthme", "CA23"), []),
    ("Asthme (CA23) DP :", ("Asthme", "CA23"), []),
    # the "none" word anywhere voids the section, even inside a label
    ("DP : Asthme (CA23)\nDAS : Aucune lésion (AB12), Anémie (3A9Z)", ("Asthme", "CA23"), []),
    # a capital acronym in brackets reads as a code; a lower-case bracket cuts the label
    ("DP : Bronchite (BPCO) chronique (CA22)", ("Bronchite", "BPCO"), []),
    ("DP : Forme (rare) de lupus (4A40)", ("rare) de lupus", "4A40"), []),
    ("Aucun code fourni", None, []),
    ("", None, []),
    ("DAS : Anémie (3A9Z)", None, [("Anémie", "3A9Z")]),
]


@pytest.mark.parametrize("reply,main,others", CASES)
def test_parse(spark, reply, main, others):
    row = spark.createDataFrame([(reply,)], "reply string").select(parse_reply(F.col("reply")).alias("r")).first().r
    assert (tuple(row.dp) if row.dp else None) == main
    assert [tuple(d) for d in row.das] == others


def test_rows_tell_main_from_others(spark):
    df = spark.createDataFrame([("DP : Toux, sèche (MD12&XT5R)\nDAS : Fièvre (MG26)",)], "r string")
    rows = df.select(F.explode(diagnosis_rows(F.col("r"))).alias("d")).select("d.*").collect()
    assert [tuple(r) for r in rows] == [("DP", "Toux, sèche", "MD12&XT5R"), ("DAS", "Fièvre", "MG26")]


def test_long_text_without_code_is_linear(spark):
    df = spark.createDataFrame([("mot " * 50_000,), ("a(" * 50_000,)], "r string")
    start = time.time()
    assert all(r.x.dp is None for r in df.select(parse_reply(F.col("r")).alias("x")).collect())
    assert time.time() - start < 20


def test_first_message_of_a_role(spark):
    messages = [("user", "un"), ("user", "deux")]
    df = spark.createDataFrame([(messages,)], "m array<struct<role:string,content:string>>")
    assert df.select(message_of(F.col("m"), "user"), message_of(F.col("m"), "system")).first()[:] == ("un", None)
