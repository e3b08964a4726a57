from pyspark.sql import functions as F

from nosoflow.operators import pages
from nosoflow.sources.readers import read_pages

BASE = "https://news.example.org"


def item(n, title="Titre &amp; suite", href="/a", extra=""):
    return (
        f'<li class="item-news">\n <a class="link-news" href="{href}">\n<p class="date-news"><span class="date-display-single" '
        f'property="dc:date" content="2025-03-{n:02d}T00:00:00+02:00">{n:02d}/03/2025</span></p>\n'
        f'<h4 class="title-news">{title}</h4>\n<p>Chapô  d&#x27;essai {extra}</p></a></li>')


def test_items(spark):
    page = "<ul>" + item(1) + item(2, "<b>Gras</b> 18&amp;19", "https://ailleurs/x") + "</ul>"
    rows = pages.page_items(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h", pages.NEWS, BASE).orderBy("rang").collect()
    assert rows[0][1:] == (1, "2025-03-01", "01/03/2025", "Titre & suite", "Chapô d'essai", BASE + "/a")
    assert rows[1].titre == "Gras 18&19" and rows[1].url == "https://ailleurs/x"


def test_incomplete_items_are_skipped_and_optional_fields_empty(spark):
    page = (
        '<li class="item-news"><a class="link-news" href="/a"><h4 class="title-news">Seul</h4></a></li>'
        '<li class="item-news"><a class="link-news" href="/b"></a></li><li class="item-news"><h4 class="title-news">X</h4></li>')
    rows = pages.page_items(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h", pages.NEWS, BASE).collect()
    assert [r[2:] for r in rows] == [("", "", "Seul", "", BASE + "/a")]


def test_cap_counts_blocks(spark):
    page = "".join(item(1 + i % 28) for i in range(60))
    df = spark.createDataFrame([(1, page)], "id int, h string")
    assert pages.page_items(df, "id", "h", pages.NEWS, BASE).count() == pages.MAX_ITEMS
    assert pages.items_per_page(df, "id", "h", pages.NEWS).first().n_blocs == 60


def test_stored_pages(spark, tmp_path):
    (tmp_path / "p.html").write_text(item(3) + "\n" + item(4), encoding="utf-8")
    stored = read_pages(spark, str(tmp_path / "p.html"))
    assert stored.count() == 1
    got = pages.page_items(stored, "page", "html", pages.NEWS, BASE)
    assert sorted(r.date_iso for r in got.select(F.col("date_iso")).collect()) == ["2025-03-03", "2025-03-04"]


def test_a_stray_bracket_or_null_character_stays_in_its_field(spark):
    page = (
        '<li class="item-news"><a class="link-news" href="/a"><h4 class="title-news">CRP < 5 mg</h4>\n<p>suite > fin</p></a></li>'
        '<li class="item-news"><a class="link-news" href="/b"><h4 class="title-news">A\u0000B</h4>\n<p>C</p></a></li>')
    rows = pages.page_items(spark.createDataFrame([(1, page)], "id int, h string"), "id", "h", pages.NEWS, BASE).orderBy("rang").collect()
    assert [(r.titre, r.chapo) for r in rows] == [("CRP < 5 mg", "suite > fin"), ("A\u0000B", "C")]


def test_pages_without_items_are_named(spark):
    df = spark.createDataFrame([(1, item(1)), (2, "<p>refondu</p>"), (3, '<li class="item-news"></li>'), (4, None)], "id int, h string")
    got = {r.id: r.erreur for r in pages.unrecognised_pages(df, "id", "h", pages.NEWS).collect()}
    assert got == {2: "structure de page non reconnue", 3: "blocs incomplets", 4: "structure de page non reconnue"}
