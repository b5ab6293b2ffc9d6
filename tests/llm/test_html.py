"""HTML extraction: hand-made pages, the given pages against their article element, awkward rows."""

import html as entities
import re

from fieldmarch.llm import html

PROSE = "This is the first paragraph of the article and it has what a reader would look for in the text of a page. "


def test_semantic_page():
    page = f"""<html><head><title>t</title><style>p{{}}</style></head><body><header>Site of the day</header><nav><a href=/>Home</a></nav>
    <main><article><h1>A &amp; B</h1><p>{PROSE}<a href=x>a link</a> in it.<p>Short.</p><aside>See also the other</aside>
    <div class="ad">Buy the thing of the year and be happy with it</div><ul><li>one of the items</ul>
    <section id="comments"><p>{PROSE}</p></section></article></main><form>Name <input name=q> of the reader</form>
    <script>if (a < b) document.write("<p>no</p>")</script><footer>&copy; the owner</footer></body></html>"""
    assert html.main_text(page) == f"A & B\n\n{PROSE}a link in it.\n\nShort.\n\none of the items"


def test_plain_divs_and_second_pass():
    page = f"""<body><div class=menu><a href=1>One</a> <a href=2>Two</a></div><div><h2>Heading</h2>{PROSE * 3}</div><div>Short one.</div>
    <div>{PROSE * 3}</div><div class="cookie-notice">We use the cookies of a partner and so on</div><div><a href=3>Next page of the site</a></div></body>"""
    assert html.main_text(page) == "\n\n".join(["Heading", (PROSE * 3).strip(), "Short one.", (PROSE * 3).strip()])


def test_broken_markup():
    assert html.main_text("") == "" and html.main_text("<") == "" and html.main_text("<<<>>><p") == ""
    assert html.main_text("<article>a < b &lt; c &#x41;&nbsp;d<!-- no --> e<br>f<script>x") == "a < b < c A d e f"
    assert html.main_text("<article><p>one<p>two</article><p>out") == "one\n\ntwo"
    assert html.main_text(f"<article><h1>t<p>{PROSE}" + "<b>" * 5000) == f"t\n\n{PROSE.strip()}"


def plain(page):
    """The given pages keep their text in one article of headings and paragraphs."""
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return "\n\n".join(t for x in re.split(r"</?(?:p|h1)>", body) if (t := " ".join(entities.unescape(re.sub(r"<[^>]*>", " " if "<br" in x else "", x)).split())))


def test_given_pages_and_awkward_rows(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = df.collect()
    got = {r.page_id: r for r in html.extract(df).collect()}
    assert len(got) == len(rows)
    for r in rows:
        assert got[r.page_id].text == plain(r.html), r.page_id
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    odd = spark.createDataFrame([(None, None, None, 1), (1, "u", "", 2), (1, "u", "", 2), (2, "u", "<article><p>" + "é w " * 300_000, 3)], "page_id long, url string, html string, text int")
    assert sorted((r.page_id or -1, r.n_chars) for r in html.extract(odd).collect()) == [(-1, 0), (1, 0), (1, 0), (2, 1_199_999)]
    assert html.extract(df.limit(0)).collect() == []


def test_names_of_wrappers_do_not_reject_the_article():
    side = f'<div class="sidebar"><p>{PROSE * 2}</p></div><section id="comments"><article><p>{PROSE}</p></article></section>'
    want = f"Title\n\n{(PROSE * 3).strip()}"
    for names in ("layout has-sidebar", "no-sidebar", "post has-comments", "page sticky-nav", "content legal", "with-related", "row without_ads"):
        for at in ("class", "id"):
            assert html.main_text(f'<body><div {at}="{names}"><h1>Title</h1><p>{PROSE * 3}</p>{side.split("<section")[0]}</div></body>') == want, names
            assert html.main_text(f'<body><section {at}="{names}"><article><h1>Title</h1><p>{PROSE * 3}</p></article></section>{"" if names == "content legal" else side}</body>') == want, names
    # without a heading or article, the wrapper of most of the text stays
    assert html.main_text(f'<body><div class="legal"><p>{PROSE * 3}</p></div><div class="tags"><p>{PROSE * 2}</p></div></body>') == (PROSE * 3).strip()
    # what stands beside the article stays unwanted, however long
    assert html.main_text(f"<body><main><h1>Title</h1><p>{PROSE * 3}</p></main>{side * 5}</body>") == want
    # hidden or navigation stays unwanted inside such a wrapper
    assert html.main_text(f'<body><div class="legal"><nav>{PROSE}</nav><article><h1>Title</h1><p>{PROSE * 3}</p><div hidden>{PROSE}</div></article></div></body>') == want


POLISH = "Dawno temu wysoko ponad doliną stała samotna chata, której mieszkańcy każdego ranka schodzili wąską ścieżką ku rzece po świeżą wodę. "
KOREAN = "산길을 걷는 사람들은 해가 지기 전에 대피소에 도착해야 한다고 안내판에 적혀 있었고 우리는 발걸음을 재촉했다. "


def test_text_without_known_stop_words():
    menu = "<div><a href=1>Pierwsza strona serwisu i wszystkie inne strony tego samego serwisu, razem z archiwum</a></div>"
    for text in (POLISH, KOREAN):
        body = (text * 4).strip()
        assert html.main_text(f"<body>{menu}<div><p>{body}</p><p>{text.strip()}</p><p>{body}</p></div>{menu}</body>") == "\n\n".join([body, text.strip(), body])
        # between good blocks a block in another language follows them
        assert html.main_text(f"<body><p>{PROSE * 3}</p><p>{text * 2}</p><p>{PROSE * 3}</p></body>") == "\n\n".join([(PROSE * 3).strip(), (text * 2).strip(), (PROSE * 3).strip()])
    assert html.main_text("<body>" + "<div class=sidebar>" * 3000 + PROSE * 3 + "</div>" * 3000) == (PROSE * 3).strip()


def test_names_and_links_inside_the_article_do_not_cost_text():
    pages = {
        "<body><h1>T</h1><p>Short story.</p><p>It ends.</p></body>": "T\n\nShort story.\n\nIt ends.",
        "<article><h1>Big</h1><p>The story of the man and the sea is that it was good.</p><p><a href=x>A linked paragraph</a></p><p>Final.</p></article><footer>f</footer>":
            "Big\n\nThe story of the man and the sea is that it was good.\n\nA linked paragraph\n\nFinal.",
        "<article><p class='related-work'>Earlier work is not enough.</p><blockquote class='share-quote'>Quote me.</blockquote><p>Use the <code>a</code> form.</p>"
        "<ul><li><a>one</a></li><li><a>two</a></li><li><a>three</a></li></ul><div class='comments'><p>I hate it</p></div></article>":
            "Earlier work is not enough.\n\nQuote me.\n\nUse the a form.",
        "<main><p>Hello there.</p><figure><img><figcaption>A caption</figcaption></figure></main>": "Hello there.\n\nA caption",
        "<article><div class='widget-body'><p>All of it is here.</p><p>And here.</p></div><p>End.</p></article>": "All of it is here.\n\nAnd here.\n\nEnd.",
        "<nav><a>x</a></nav><p><a>only</a> <a>links</a></p>": "",
        "<p title='a > b'>x < y</p><![CDATA[a<b]]><p>Half <a b": "x < y\n\na<b\n\nHalf",
    }
    for page, text in pages.items():
        assert html.main_text(page) == text, page


def test_time_grows_with_the_page_only():
    import time

    hostile = ["<a b=", '<a "', '<a b=">" ', "<![CDATA[", "<!--", "<script>", "<a b='", "</p>", "<p class=x ", "<div hidden>"]
    start = time.process_time()
    for piece in hostile:
        html.main_text(piece * (400_000 // len(piece)))
    html.main_text("<div hidden>" * 30_000 + "</div>" * 30_000)
    assert time.process_time() - start < 30
