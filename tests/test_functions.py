import html
import re
import unicodedata

from pyspark.sql import functions as F

from nosoflow.functions import codes, numbers, text


def one(spark, values, fn, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.x for r in df.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_normalize_label_equals_unicode_definition(spark):
    def expected(s):
        s = "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
        return re.sub(r"[^a-z0-9]+", " ", s.lower()).strip()

    samples = ["Œdème aigu", "Épilepsie, État de mal", "été", "ﬁèvre ﬂeur", "½ dose", "Ǆ İstanbul", "ﾃ Ｆｕｌｌ", "x²", "Straße", "", "  a--b "]
    samples += [chr(i) for i in range(0x20, 0x250)]
    assert one(spark, samples, text.normalize_label) == [expected(s) for s in samples]
    assert one(spark, [None], text.normalize_label) == [""]


def test_label_matches(spark):
    df = spark.createDataFrame([("Fièvre jaune, sévère", "fievre JAUNE"), ("Toux", ""), ("Toux", None), ("Toux", "Fièvre")], "p string, e string")
    assert [r.x for r in df.select(text.label_matches(F.col("p"), F.col("e")).alias("x")).collect()] == [True, False, False, False]


def test_strip_and_collapse_follow_unicode_whitespace(spark):
    samples = ["  a  b\t\n", "\x1c x \x85", "", "​x"]
    assert one(spark, samples, text.strip) == [s.strip() for s in samples]
    assert one(spark, samples, text.collapse_spaces) == [re.sub(r"\s+", " ", s).strip() for s in samples]


def test_html_text_decodes_once_after_dropping_tags(spark):
    samples = ["<b>A&amp;lt;</b>  18&amp;19", "d&#x27;accord&nbsp;!", "a <i>b</i>\n c", "&lt;p&gt;", None]
    expected = [None if s is None else re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", "", s))).strip() for s in samples]
    assert one(spark, samples, text.html_text) == expected


def test_unwrap_removes_what_wrap_adds(spark):
    body = "Patient de 70 ans.\n\n---\nSuite."
    wrapped = one(spark, [body], text.wrap_report)
    assert wrapped[0].endswith("Propose le codage CIM-11 (DP et DAS).")
    assert one(spark, wrapped, text.unwrap_report) == [body]
    head = "Le compte rendu suivant respecte les règles\n" + "-" * 12 + "\nTexte"
    assert one(spark, [head], text.unwrap_report) == ["Texte"]


def test_fingerprint(spark):
    assert one(spark, ["abc"], text.fingerprint) == ["ba7816bf8f01cfea"]


def test_links(spark):
    assert one(spark, ["/a", "http://x/b"], lambda c: text.absolute_link(c, "https://h")) == ["https://h/a", "http://x/b"]
    assert one(spark, ["http://x/y/z"], lambda c: text.last_segment(text.https(c))) == ["z"]


def test_icd10_spelling_and_candidates(spark):
    assert one(spark, ["C180", "S7200", "M23", "C18.0", " B20 "], codes.normalize_icd10) == ["C18.0", "S72.00", "M23", "C18.0", "B20"]
    got = one(spark, ["S7200", "S720", "M23"], lambda c: F.array(*codes.backoff_candidates(c)))
    assert got == [["S72.00", "S72.0", "S72"], ["S72.0", "S72.", "S72"], ["M23", None, None]]


def test_code_grammar(spark):
    assert one(spark, ["1A00", "1A62.2&XA6GV0", "a1", "X", "1A00&"], codes.is_code) == [True, True, False, False, False]
    assert one(spark, [" 1a00 &xa", None, "BD10"], codes.root_code) == ["1A00", "", "BD10"]
    assert one(spark, ["BD10Y", "BD1Z", "BD10"], codes.is_residual) == [True, True, False]
    found = one(spark, ['["BD10&XS9F", "1A.0&X=3&XB", "BD10"] x&y'], codes.scan_codes)
    assert found == [["BD10&XS9F", "1A.0&X=3&XB", "x&y"]]


def test_free_text_scan_equals_plain_pattern(spark):
    plain = r"[A-Za-z0-9][A-Za-z0-9.]*(?:&[A-Za-z0-9=.]+)+"
    samples = ["a..b&c&d", ".A&B", "A&&B", "A&B&", "é1&2é3&4", "a&b.c=d e.f&g", "&x&y", "long" * 200 + "&", "a.b.c"]
    assert one(spark, samples, codes.scan_codes) == [re.findall(plain, s) for s in samples]


def test_numbers(spark):
    shown = one(spark, [0, 999_999, 1_000_000, 12_809_008_742_399], numbers.format_big, "bigint")
    assert shown == ["0", "999,999", "1.00000 × 10^6 (~10^6.0)", "1.28090 × 10^13 (~10^13.1)"]
    assert one(spark, ["7", "999999", "1000000", "9" * 60], numbers.format_big, "string") == ["7", "999,999", "1.00000 × 10^6 (~10^6.0)", "9.99999 × 10^59 (~10^60.0)"]
    ranks = one(spark, [[4.0, 1.0, 2.0, 3.0], [5.0, 4.0, 1.0, 2.0, 3.0]], lambda c: numbers.nearest_rank(c, 0.95, 5), "array<double>")
    assert ranks == [None, 4.0]
