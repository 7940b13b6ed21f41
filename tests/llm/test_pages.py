"""Main text of pages: structure, template deduction, and the pages of the test tables."""

import re

from tariffloom.llm.html_extraction import extract_main_text, main_text, op9_html_extraction

SF = "/root/testdata/sf0.001"


def test_structure():
    html = ('<!DOCTYPE html><head><title>t</title></head><body class="page"><header>top</header><nav>m</nav><div id="sidebar">s</div>'
            '<article><header><h1>A &amp; B</h1></header><p>one <b>two</b>&nbsp;three<br>four<p>five<ul><li>x<li>y</ul>'
            '<aside>no</aside><form>no</form><script>if (a < b) "</p>"</script><!-- <p>no</p> --><pre>a\n  b</pre></article>'
            '<section class="reader-comments"><p>no</p></section><footer>end</footer>')
    assert main_text(html, set()) == "A & B\none two three four\nfive\nx\ny\na b"
    assert main_text("plain <p>text</p> 1 < 2", set()) == "plain\ntext\n1 < 2"
    assert main_text('<div hidden>a</div><div style="display: none">b</div><div role="navigation">c</div>', set()) == ""
    assert main_text('<p title="a>b">c</p><p x=\'</p>\'>d', set()) == "c\nd"
    assert main_text("<p>open <b>tags <i>never <p>closed", set()) == "open tags never\nclosed"


def test_template_texts_are_dropped_and_copies_are_not(spark):
    page = lambda body: f"<body><div class=x><span>Brought to you by us</span></div><div class=y><p>{body}</p></div></body>"
    rows = [(i, f"https://u@Host.example:8080/{i}", page(f"own text {i}")) for i in range(6)]
    rows += [(10 + i, f"http://copies.example/{i}", page("the same article")) for i in range(4)]
    rows += [(20, "http://single.example/", page("alone")), (21, None, None), (22, "x", ""), (0, "https://host.example/0", page("own text 0"))]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    for shipped in (500_000, -1):
        got = extract_main_text(frame, shipped=shipped).collect()
        by_id = {r.page_id: r.text for r in got}
        assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
        assert [by_id[i] for i in range(6)] == [f"own text {i}" for i in range(6)]
        assert by_id[10] == by_id[13] == "Brought to you by us\nthe same article"
        assert by_id[20] == "Brought to you by us\nalone" and by_id[21] == by_id[22] == ""
    assert extract_main_text(frame.limit(0)).count() == 0


def test_pages_hold_their_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op9_html_extraction(spark, SF).collect()
    assert len(got) == spark.read.parquet(f"{SF}/pages.parquet").count()
    for r in got:
        want = [" ".join(x.split()) for x in texts[int(re.search(r"/(\d+)", r.url.split("://")[1])[1])].split("\n")]
        assert r.text.split("\n")[1:] == [x for x in want if x]


def test_unmarked_adverts_in_articles_are_template(spark):
    page = lambda i, body: f"<body><p>{'menu ' * (i % 3)}</p><article><h1>title {i}</h1><p>{body}<div><p>Buy our lamps</p></div></article></body>"
    rows = [(i, f"http://adverts.example/{i}", page(i, f"own text {i}")) for i in range(6)]
    # one article on pages that differ in their menus only is no template
    rows += [(10 + i, f"http://copies.example/{i}", f"<nav>{i}</nav><article><p>the same article</p></article>") for i in range(4)]
    got = {r.page_id: r.text for r in extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in range(6)] == [f"title {i}\nown text {i}" for i in range(6)]
    assert [got[10 + i] for i in range(4)] == ["the same article"] * 4


def test_main_text_beside_a_small_article_stays():
    assert main_text(f"<div><p>{'long ' * 9}</p></div><article><p>teaser</p></article>", set()) == " ".join(["long"] * 9) + "\nteaser"
    assert main_text(f"<div><p>teaser</p></div><main><p>{'long ' * 9}</p></main>", set()) == " ".join(["long"] * 9)


def test_classes_nest_and_need_no_share_of_the_host(spark):
    def page(i):
        kind = "<section><p>Only in this kind</p></section><p>Beside, not under it</p>" if i < 4 else ""
        return f"<body>{kind}<p>own text {i}</p></body>"

    frame = spark.createDataFrame([(i, f"http://large.example/{i}", page(i)) for i in range(60)], "page_id long, url string, html string")
    for shipped in (500_000, -1):
        got = {r.page_id: r.text for r in extract_main_text(frame, shipped=shipped).collect()}
        # four pages of sixty are enough for the section's text; the other text has no element of its class above it
        assert [got[i] for i in range(60)] == ["Beside, not under it\n" * (i < 4) + f"own text {i}" for i in range(60)]
