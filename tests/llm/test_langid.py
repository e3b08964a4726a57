import base64
import math
import random
import string
import zlib

import numpy as np

from nosoflow.llm import langid

LETTERS = {"aa": "abcdefg", "bb": "ghijklm", "cc": "mnopqrs"}


def text(lang, seed, n=40):
    rnd = random.Random(f"{lang}{seed}")
    return " ".join("".join(rnd.choices(LETTERS[lang], k=5)) for _ in range(n)).title()


def labelled(make_docs, n=90):
    return make_docs([(i, text(("aa", "bb", "cc")[i % 3], i), ("aa", "bb", "cc")[i % 3], "s") for i in range(n)])


def test_held_out_texts_are_recognised(make_docs):
    docs = labelled(make_docs)
    rows = langid.identify(docs).collect()
    truth = {r.doc_id: r.lang for r in docs.collect()}
    assert {r.doc_id for r in rows if r.held_out} == {i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0}
    assert all(r.lang_pred == truth[r.doc_id] and 0 < r.score <= 1 for r in rows)


def test_labels_of_held_out_texts_are_not_learned(make_docs):
    docs = labelled(make_docs)
    other = make_docs([(r.doc_id, r.text, "zz" if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 else r.lang, "other") for r in docs.collect()])
    assert sorted(map(tuple, langid.identify(docs).collect())) == sorted(map(tuple, langid.identify(other).collect()))


def test_vectors_are_bound_and_bundled():
    bundler = langid.Bundler(64, 3, seed=1)
    table, letters = langid._symbol_table(), langid._rotated_letters(64, 3, 1)
    total = np.zeros(64)
    for word in ("ab", "c"):
        pass
    symbols = [0, *(table[ord(c)] for c in "ab"), 0, table[ord("c")], 0, 0]
    for i in range(len(symbols) - 2):
        total += letters[0][symbols[i]].astype(int) * letters[1][symbols[i + 1]] * letters[2][symbols[i + 2]]
    assert (bundler.vector("AB--c") == total).all() and (letters[0] == np.roll(letters[2], 2, axis=1)).all()
    assert bundler.vector("123 !") is None


def test_remembered_vectors_don_t_change_the_result():
    small, large = langid.Bundler(128, limit=50), langid.Bundler(128, limit=100_000)
    for seed in range(6):
        t = text("aa", seed, 30) + text("cc", seed, 30)
        assert (small.vector(t) == large.vector(t)).all()


def test_awkward_rows(make_docs, awkward, empty):
    model = langid.fit(langid.training_rows(labelled(make_docs)))
    rows = langid.identify(awkward, model).collect()
    assert len(rows) == awkward.count()
    for r, d in zip(sorted(rows, key=lambda r: str(r.doc_id)), sorted(awkward.collect(), key=lambda r: str(r.doc_id))):
        if r.doc_id not in (6, 7, None):
            assert (r.lang_pred == "und") == (not any(c.isalpha() for c in d.text or "")) and 0 <= r.score <= 1
        assert r.held_out or r.doc_id is not None
    assert langid.identify(empty).collect() == []
    nothing = langid.identify(make_docs([(1, "abc", None, "s"), (2, None, None, "s")])).collect()
    assert [(r.lang_pred, r.score) for r in nothing] == [("und", 0.0)] * 2
    kept = langid.keep_identified(awkward, model)
    assert kept.columns == awkward.columns and {11, 1, 2, 3}.isdisjoint(r.doc_id for r in kept.collect())


def test_the_most_frequent_languages_are_learned(make_docs, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGUAGES", 2)
    docs = make_docs([(i, text(lang, i), lang, "s") for i, lang in enumerate(["aa"] * 40 + ["bb"] * 30 + ["cc"] * 20)])
    found = langid.identify(docs).collect()
    assert {r.lang_pred for r in found if r.doc_id < 70} == {"aa", "bb"} and len(found) == 90
    assert langid.fit(langid.training_rows(docs))[0] == ["aa", "bb"]


def test_predictions_equal_cosines_with_prototypes_by_plain_arithmetic(make_docs):
    docs = labelled(make_docs, 60)
    bundler, sums = langid.Bundler(), {}
    vectors = {r.doc_id: bundler.vector(r.text).astype(float) for r in docs.collect()}
    for r in docs.collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5:
            v = vectors[r.doc_id]
            sums[r.lang] = sums.get(r.lang, 0) + v / math.sqrt(sum(x * x for x in v))
    for r in langid.identify(docs).collect():
        v = vectors[r.doc_id]
        cosines = {lang: sum(x * y for x, y in zip(v, p)) / math.sqrt(sum(x * x for x in v) * sum(y * y for y in p)) for lang, p in sums.items()}
        best = max(sorted(cosines), key=cosines.get)
        assert r.lang_pred == best and abs(r.score - cosines[best]) < 1e-5


OTHER_LANGUAGES = [
    "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "Bütün insanlar hür, haysiyet ve haklar bakımından eşit doğarlar. Akıl ve vicdana sahiptirler ve birbirlerine karşı kardeşlik zihniyeti ile hareket etmelidirler."]


def test_what_is_no_learned_language_goes_and_texts_of_it_stay(spark):
    """On the tables' documents: gibberish, encoded data and other languages go, held-out texts stay."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    model = langid.fit(langid.training_rows(docs, fit_rows=400))
    bounds = langid.floors(model, langid.training_rows(docs))
    assert bounds.shape == (4, langid.LONGEST + 1)
    rnd = random.Random(2)
    junk = [" ".join("".join(rnd.choices(string.ascii_lowercase, k=rnd.randrange(2, 9))) for _ in range(n)) for n in (60, 100, 200, 400) for _ in range(25)]
    junk += [base64.b64encode(rnd.randbytes(n)).decode() for n in (300, 900) for _ in range(25)]
    junk += [rnd.randbytes(n).hex() for n in (200, 600) for _ in range(25)] + OTHER_LANGUAGES
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(junk)], docs.schema)
    kept = [r.text for r in langid.keep_identified(rows, model, bounds).collect()]
    assert len(kept) <= 0.1 * len(junk) and not set(kept) & set(OTHER_LANGUAGES)
    held = docs.where("crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 AND lang IS NOT NULL")
    assert langid.keep_identified(held, model, bounds).count() >= 0.995 * held.count()
    assert langid.keep_identified(docs, model).columns == docs.columns


def test_a_rare_language_keeps_all_its_texts(make_docs):
    """Two languages with many texts and one with four: the bound holds for each language alone."""
    docs = make_docs([(i, text("cc" if i % 100 == 1 else ("aa", "bb")[i % 2], i), "cc" if i % 100 == 1 else ("aa", "bb")[i % 2], "s") for i in range(400)])
    used = [r.lang for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    rows = langid.training_rows(docs, fit_rows=20)
    drawn = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    assert drawn["cc"] == used.count("cc") <= 4 and all(5 < drawn[x] < 45 < used.count(x) for x in ("aa", "bb"))
    assert langid.fit(rows)[0] == ["aa", "bb", "cc"]


def test_prototypes_and_bounds_come_from_all_texts(spark, make_docs):
    """More texts of a language than any draw ever took: all are learned from, and all count for the bounds."""
    many = spark.range(60_000).selectExpr("id AS doc_id", "'x' AS text", "'aa' AS lang")
    assert langid.training_rows(many).count() == sum(zlib.crc32(str(i).encode()) % 5 > 0 for i in range(60_000))
    model = langid.fit(langid.training_rows(labelled(make_docs)))
    rows = spark.createDataFrame([(i, text("aa", i, 8 + i % 16), "aa") for i in range(9_000)], "doc_id bigint, text string, lang string")
    own, bundler, place = {}, langid.Bundler(), model[0].index("aa")
    for r in rows.withColumn("answer", langid.predictor(model)("text")).where("answer.lang_pred = 'aa'").collect():
        own.setdefault(langid._length_class(r.text), []).append(r.answer.score)
    bounds = langid.floors(model, rows)[place]
    assert sum(map(len, own.values())) > 4_500
    for kind, scores in own.items():
        vectors = [bundler.vector(langid._random_letters(3 << kind >> 2, i)) for i in range(langid.NOISE_TEXTS)]
        noise = max(float(model[1][place] @ v / np.linalg.norm(v)) for v in vectors if v is not None)
        low = max(min(scores), float(np.mean(scores) - 3 * np.std(scores)))
        assert abs(bounds[kind] - (noise + (low - noise) / 4 if low > noise else min(*scores, noise))) < 1e-6


def test_a_text_is_scored_once_by_one_worker_of_a_task(make_docs):
    """Each pass over the texts has one Python step; a second one would hold another worker, and be sent every text again."""
    docs = labelled(make_docs)
    model = langid.fit(langid.training_rows(docs))
    bounds = langid.floors(model, langid.training_rows(docs))
    for rows in (lambda: langid.keep_identified(docs, model, bounds), lambda: langid._own_scores(model, docs)):
        assert rows()._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    answers = {r.doc_id: r for r in langid.identify(docs, model).collect()}
    kept = {r.doc_id for r in langid.keep_identified(docs, model, bounds).collect()}
    assert kept == {
        r.doc_id for r in docs.collect() if answers[r.doc_id].score >= bounds[model[0].index(answers[r.doc_id].lang_pred), langid._length_class(r.text)]}
