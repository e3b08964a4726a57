import json

from pyspark.sql import functions as F

from nosoflow.operators import prompts, sampling, verify


def line(root, content):
    return json.dumps({"custom_id": root, "response": {"body": {"choices": [{"message": {"content": content}}]}}}, ensure_ascii=False)


def setup(spark):
    lines = [
        line("A1", '{"codes_postcoord": ["A1&X1", "A1&XA13Z", "A1&B2"]}'), line("A1", "ZZ&X1&Q9"), line("B2", "rien"),
        json.dumps({"custom_id": "B2", "response": None}), "{corrompu", "{}", line("A1", "A1&X1=3")]
    raw = spark.createDataFrame(list(enumerate(lines)), "num int, brut string")
    roots = spark.createDataFrame([("A1", "un"), ("B2", "deux")], "code string, libelle string")
    ext = spark.createDataFrame([("X1", "gauche"), ("X2", "")], "code string, libelle string")
    responses = verify.read_responses(raw)
    return responses, verify.check_codes(responses, ["num"], roots, ext), roots, ext


def test_checks(spark):
    responses, checked, roots, ext = setup(spark)
    assert responses.count() == 6
    rejected = {r.code_postcoord: r.codes_inconnus for r in verify.rejected_codes(checked).collect()}
    assert rejected == {"A1&XA13Z": "XA13Z", "ZZ&X1&Q9": "ZZ|Q9", "A1&X1=3": "X1=3"}
    errors = {r.num: r.erreur for r in verify.response_errors(responses, checked, ["num"]).collect()}
    assert errors == {1: verify.ALL_REJECTED, 2: verify.NO_CODE, 3: verify.EMPTY_RESPONSE, 5: verify.EMPTY_RESPONSE, 6: verify.ALL_REJECTED}
    labelled = verify.check_codes(responses, ["num"], roots, ext, with_labels=True)
    named = verify.labelled_codes(verify.accepted_codes(labelled), roots)
    assert sorted(tuple(r) for r in named.collect()) == [("A1", "un", "A1&B2", "B2"), ("A1", "un", "A1&X1", "X1 : gauche")]
    assert tuple(verify.rejection_rate(checked).first()) == (2, 3, 1, 60.0, 2.0)
    assert [tuple(r) for r in verify.top_unknown(verify.rejected_codes(checked), 2).collect()] == [("Q9", 1), ("X1=3", 1)]


def test_label_lookup_ignores_the_value(spark):
    codes = spark.createDataFrame([(1, "A1&X1=3&X2&Q"), (2, "A1")], "num int, code_postcoord string")
    ext = spark.createDataFrame([("X1", "gauche"), ("X2", "")], "code string, libelle string")
    got = {r.num: r.libelles_extensions for r in verify.extension_labels(codes, ["num"], ext).collect()}
    assert got == {1: "X1=3 : gauche | X2 | Q", 2: ""}


def test_full_labels(spark):
    df = spark.createDataFrame([(0, "A&X", "un", "ext"), (1, "A&X", "autre", None), (2, "A", "un", " ")],
                               "o int, code_postcoord string, libelle_racine string, libelles_extensions string")
    assert {r.code_postcoord: r.libelle for r in verify.full_labels(df, ["o"]).collect()} == {"A&X": "un - ext", "A": "un"}


def test_generated_reports(spark):
    long = "texte " * 10
    good = json.dumps({"CR": long, "formulations": {"diagnostics": {"A": ["x"]}}})
    lines = [line("0", "```json\n" + good + "\n```"), line("1", good), line("2", long), line("3", "court"),
             line("4", json.dumps({"autre": long})), line("5", json.dumps({"CR": long}))]
    raw = spark.createDataFrame([(b,) for b in lines], "brut string")
    requests = spark.createDataFrame([(i, f"p{i}") for i in range(5)], "k bigint, prompt string")
    got = {r.k: (r.crh, r.formulations) for r in verify.generated_reports(verify.read_responses(raw), requests, "k").collect()}
    assert got == {0: (long, '{"diagnostics":{"A":["x"]}}'), 1: (long, '{"diagnostics":{"A":["x"]}}'), 2: (long, "{}"),
                   4: (json.dumps({"autre": long}), "{}")}


def test_samples(spark):
    df = spark.createDataFrame([(i, 1 + i % 5, f"r{i % 3}") for i in range(300)], "id int, nb int, root string")
    drawn = [r.id for r in sampling.weighted_sample(df, 50, "nb", "id", 1).collect()]
    assert len(set(drawn)) == 50 and drawn == [r.id for r in sampling.weighted_sample(df.repartition(3), 50, "nb", "id", 1).collect()]
    assert drawn != [r.id for r in sampling.weighted_sample(df, 50, "nb", "id", 2).collect()]
    assert sampling.weighted_sample(df.withColumn("nb", F.col("id") % 2), 300, "nb", "id", 1).count() == 150
    per_root = sampling.draw_per_key(df, ["root"], "id", 4, 1).groupBy("root").count().collect()
    assert [r["count"] for r in per_root] == [4, 4, 4]


def test_heavier_rows_are_drawn_more_often(spark):
    df = spark.range(20_000).selectExpr("id", "IF(id % 2 = 0, 3, 1) AS nb")
    even = sampling.weighted_sample(df, 1000, "nb", "id", 9).where("id % 2 = 0").count()
    assert 690 < even < 810


def test_each_row_draws_distinct_items_evenly(spark, monkeypatch):
    monkeypatch.setattr(sampling, "LARGE_ROOT_ITEMS", 5)  # number the items in slices
    rows = spark.range(2000).selectExpr("id", "'r' AS root")
    items = spark.range(17).selectExpr("'r' AS root", "concat('i', id) AS item").unionByName(spark.range(5).selectExpr("'r' AS root", "'i0' AS item"))
    got = sampling.draw_for_rows(rows, "id", "root", items, "item", 3, 4)
    assert got.distinct().count() == got.count() == 6000
    counts = [r["count"] for r in got.groupBy("item").count().collect()]
    assert len(counts) == 17 and max(counts) < 1.3 * min(counts)
    few = sampling.draw_for_rows(rows, "id", "root", items.where("item in ('i1', 'i2')"), "item", 3, 4)
    assert few.distinct().count() == 4000


def test_prompts(spark):
    profiles = spark.createDataFrame([(1, "A"), (2, "B"), (3, "Q")], "id int, root string")
    kept = spark.createDataFrame([(1, "A&X2"), (1, "A&X1")], "id int, code string")
    labels = spark.createDataFrame([("A&X1", "un - x")], "code_postcoord string, libelle string")
    titles = spark.createDataFrame([("A", "un"), ("B", "deux")], "code string, libelle string")
    rows = prompts.prompt_rows(profiles, "id", "root", kept, labels, titles).orderBy("id", "prompt_num").collect()
    assert [tuple(r) for r in rows] == [(1, 1, "A&X1", "un - x"), (1, 2, "A&X2", "un"), (2, 1, "B", "deux"), (3, 1, "Q", "")]
    lots = prompts.batches(spark.range(250), ["id"], F.floor(F.col("id") / 60)).groupBy("lot").count().orderBy("lot").collect()
    assert [tuple(r) for r in lots] == [(0, 100), (1, 100), (2, 50)]


def test_document_and_lists(spark):
    df = spark.createDataFrame(
        [(1, "scénario", "A", "un", [("B", "deux"), ("C", "")], "texte", '{"informations": {"age": ["dix ans"]}}'),
         (2, "s", None, None, [], "t", None)],
        "id int, user_prompt string, code_dp string, libelle_dp string, das array<struct<code:string,libelle:string>>, crh string, formulations string")
    docs = {r.id: r.document for r in prompts.report_document(df).collect()}
    assert "**Diagnostic principal :** un (A)" in docs[1] and "\n- deux (B)\n- (C)" in docs[1] and "**age**\n- dix ans" in docs[1]
    assert "Diagnostic" not in docs[2] and "Dictionnaire" not in docs[2]
    text = df.select(prompts.diagnosis_text(F.col("das")).alias("x")).first().x
    assert text == "- deux (CIM-11 : B)\n-  (CIM-11 : C)"
    capped = spark.createDataFrame([(["a", "b", "c"],), (["a"],)], "l array<string>").select(prompts.capped_list(F.col("l"), 2).alias("x")).collect()
    assert [r.x for r in capped] == [["a", "b", "... (1 autres codes non listés)"], ["a"]]
    body = prompts.request_lines(spark.createDataFrame([("A", 'dire "é"\n')], "code string, user_prompt string"), F.lit("s"), F.lit("{")).first().value
    assert json.loads(body) == {"custom_id": "A", "body": {"max_tokens": 8000, "messages": [
        {"role": "system", "content": "s"}, {"role": "user", "content": 'dire "é"\n'}, {"role": "assistant", "content": "{", "prefix": True}]}}


def test_answers_keep_long_ids_and_name_the_rest(spark):
    answers = spark.createDataFrame([("1234567890123456789", "x" * 50), ("-3", "y" * 50), ("abc", "z" * 50), ("7", "court"), ("8", "w" * 50)], "custom_id string, contenu string")
    requests = spark.createDataFrame([(1234567890123456789,), (-3,), (7,)], "id bigint")
    assert {r.id for r in verify.generated_reports(answers, requests, "id").collect()} == {1234567890123456789, -3}
    left = {r.custom_id: r.motif for r in verify.unmatched_answers(answers, requests, "id").collect()}
    assert left == {"abc": "identifiant illisible", "7": "réponse trop courte", "8": "demande inconnue"}


def test_a_failing_report_does_not_end_the_scoring(spark):
    from nosoflow.operators.scoring import score_reports

    def make():
        def reply(text):
            if text == "b":
                raise ValueError("refus")
            return "DP : x (AA00)"
        return lambda texts: texts.map(reply)

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, t string")
    got = {r.id: (r.reponse, r.erreur) for r in score_reports(df, "id", "t", make, "m").collect()}
    assert got == {1: ("DP : x (AA00)", None), 2: (None, "refus"), 3: ("DP : x (AA00)", None)}


def test_codes_are_scanned_once_and_pieces_checked_alone(spark):
    """A text's codes are not counted by a second scan, and no step goes by the whole code: distinct roots and rests are checked."""
    lines = [line("A1", "A1&X1&X2 A1&Q9&X1=3 ZZ&X2&X1"), line("B2", "B2&A1&B2 A1&X1&X2"), line("A1", "rien")]
    responses = verify.read_responses(spark.createDataFrame(list(enumerate(lines)), "num int, brut string"))
    roots = spark.createDataFrame([("A1", "un"), ("B2", "deux")], "code string, libelle string")
    ext = spark.createDataFrame([("X1", "gauche"), ("X2", "")], "code string, libelle string")
    checked = verify.check_codes(responses, ["num"], roots, ext, with_labels=True)
    plan = checked._jdf.queryExecution().executedPlan().toString()
    assert "code_postcoord" not in "".join(x for x in plan.splitlines() if "Exchange" in x or "Aggregate" in x)
    got = sorted((r.num, r.rang, r.code_postcoord, r.inconnus, r.libelles_extensions) for r in checked.collect())
    assert got == [(0, 0, "A1&X1&X2", [], "X1 : gauche | X2"), (0, 1, "A1&Q9&X1=3", ["Q9", "X1=3"], "Q9 | X1=3 : gauche"),
                   (0, 2, "ZZ&X2&X1", ["ZZ"], "X2 | X1 : gauche"), (1, 0, "B2&A1&B2", [], "A1 | B2"), (1, 1, "A1&X1&X2", [], "X1 : gauche | X2")]
