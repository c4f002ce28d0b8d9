from __future__ import annotations

from pyspark.sql import functions as F

from larkspan.operators import pages

TOP = '<a href="#x">日本語</a><a href="https://other.example/index_jp.html">日本語</a><a href="/s/">日本語</a><a href="news.html">news</a><a href="INDEX_JP.html">Top</a><a href="later.html">日本 語</a>'


def site(spark, rows):
    return spark.createDataFrame(rows, "url string, html string")


def test_the_entry_is_the_first_link_that_fits(spark):
    found = pages.entry_links(site(spark, [("https://h.example/s/", TOP), ("https://h.example/t/", '<a href="a.html">x</a>'), ("https://h.example/u/", '<a href="../v/"> 日 本語 </a>'), ("https://h.example/w/", None)]), ("日本語",), ("index_jp", "japanese"))
    assert {tuple(r) for r in found.collect()} == {("https://h.example/s/", "https://h.example/s/INDEX_JP.html"), ("https://h.example/u/", "https://h.example/v/")}


def test_circles_end_and_hops_are_bounded(spark):
    link = lambda to: f'<a href="{to}">go</a>'
    fetched = site(spark, [("https://h.example/a", link("b")), ("https://h.example/b", link("c")), ("https://h.example/c", link("a")), ("https://h.example/d", link("a"))])
    starts = spark.createDataFrame([("https://h.example/a",), ("https://h.example/d",), ("https://h.example/none",)], "start string")

    def reached(hops):
        found = pages.follow(fetched, starts, lambda here: pages.entry_links(here, ("go",), ()), hops=hops)
        return sorted((r.start[-1], r.hop, r.url[-1]) for r in found.collect())

    whole = [("a", 0, "a"), ("a", 1, "b"), ("a", 2, "c"), ("d", 0, "d"), ("d", 1, "a"), ("d", 2, "b"), ("d", 3, "c"), ("e", 0, "e")]
    assert reached(9) == whole and reached(1) == [r for r in whole if r[1] <= 1]
    assert pages.follow(fetched, starts.limit(0), lambda here: pages.entry_links(here, ("go",), ()), hops=3).count() == 0


INDEX = """<p>第 66 回東京都高等学校吹奏楽コンクール</p><b>【Ａ組】</b><a href="../a.pdf">Ａ <i>一日目</i></a><!-- <a href="no.pdf">no</a> --><b>【Ｂ組】</b>
<a href='/b.pdf#2'>Ｂ</a><a href="c.html">c</a><p>第65回東京都高等学校吹奏楽コンクール</p><a href="https://o.example/d.pdf">d</a>"""


def test_links_carry_what_stands_before_them(spark):
    rows = spark.createDataFrame([(1, "https://h.example/x/y/", INDEX), (2, "https://h.example/", '<a href="e.pdf">e</a>'), (3, "https://h.example/", None)], "page_id int, url string, html string")
    marks = {"contest": r"第\s*(\d+)\s*回東京都高等学校吹奏楽コンクール", "section": r"【\s*([ＡＢＣ東日本A-C]+組)\s*】"}
    found = pages.headed_links(rows, marks, link=r"""(?is)<a\b[^>]*href=["'][^"']+\.pdf[^"']*["'][^>]*>.*?</a>""")
    got = [(r.page_id, r.url, r.label.split(), r.contest, r.section) for r in found.where("label <> 'no'").orderBy("page_id", "pos").collect()]
    assert got == [
        (1, "https://h.example/x/a.pdf", ["Ａ", "一日目"], "66", "Ａ組"), (1, "https://h.example/b.pdf", ["Ｂ"], "66", "Ｂ組"), (1, "https://o.example/d.pdf", ["d"], "65", "Ｂ組"), (2, "https://h.example/e.pdf", ["e"], None, None),
    ]
    recent = found.where(F.col("contest").cast("int") >= 66)
    assert [r.url for r in recent.where("label <> 'no'").orderBy("pos").collect()] == ["https://h.example/x/a.pdf", "https://h.example/b.pdf"]
