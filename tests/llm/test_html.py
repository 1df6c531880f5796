import html as stdlib_html
import re

from lexicept.llm import htmltext, queries

NOISE = [
    '<nav><ul><li><a href="/a">Home, sweet home.</a></li></ul></nav>', '<header class="top"><p>Site name, and a motto. Long enough, too.</p></header>',
    '<div class="ad">Buy this, now. It is cheap, very cheap, and good.</div>', '<aside><p>Side story, with words. Many, many words.</p></aside>',
    '<div class="sidebar"><p>More, and more. Links, too.</p></div>', '<div class="cookie-notice">We use cookies, as all do. Accept, please.</div>',
    '<form action="/s"><label>Name, please.</label><input name=q></form>', '<script>var t="</p><p>not, text.</p>";</script>', "<style>p{margin:0}</style>",
    '<section id="comments"><p>First, as ever. I agree, fully, with all of it.</p><p>Me too, and more. Yes.</p></section>',
    '<div class="comment-list"><div class="comment">Nice, thanks.</div></div>', "<footer>&copy; example, all rights. Contact, terms.</footer>",
    '<div role="navigation">Go here, go there.</div>', "<!-- <p>hidden, text.</p> -->", "<noscript>Enable it, please.</noscript>",
]
BODY = "<h1>A &amp; B</h1><p>First paragraph, with   several\nwords. It goes on, and on, as paragraphs do.</p><p>Short.</p><p><b>Bold, then <i>more</i> text.<br>next<p>Un&#233;closed one, here. Also fine.</p>"
TEXT = "A & B\nFirst paragraph, with several words. It goes on, and on, as paragraphs do.\nShort.\nBold, then more text. next\nUnéclosed one, here. Also fine."


def test_article_with_noise():
    for i, noise in enumerate(NOISE):
        for page in (f"<html><body>{noise}<article>{BODY}</article></body></html>", f"<body><article>{BODY}</article>{noise}", f"<body><article>{BODY}{noise}</article>"):
            if "<header" in noise and page.endswith(f"{noise}</article>"):
                continue  # a header inside the article is its title block
            assert htmltext.extract_text(page) == TEXT, (i, page)
    assert htmltext.extract_text("<!DOCTYPE html><head><title>T, t.</title></head><body>" + "".join(NOISE) + f"<main><div>{BODY}</div></main>" + "".join(NOISE)) == TEXT


def test_without_article_tags():
    page = "<body>" + "".join(NOISE) + f'<div id="content"><div class="post">{BODY}</div></div>' + "".join(NOISE) + "</body>"
    assert htmltext.extract_text(page) == TEXT


def test_names():
    assert htmltext.extract_text(f'<div class="layout has-sidebar no-header"><article class="post with-comments">{BODY}</article></div>') == TEXT
    page = f'<article>{BODY}</article><article class="comment">Well, I think so, too. And more, much more.</article><p style="display: none">Hidden, text.</p>'
    assert htmltext.extract_text(page) == TEXT
    assert htmltext.extract_text(page.replace("article", "div")) == TEXT


def test_names_do_not_outweigh_the_page():
    h1, rest = BODY.split("</h1>")
    pages = [
        f'<article><header class="entry-header">{h1}</h1></header>{rest}</article>',
        f'<div class="post"><div class="post-header">{h1}</h1></div>{rest}</div>',
        f'<article class="post category-social">{BODY}</article>',
        f'<div class="post tag-login-help">{BODY}</div>',
        f'<div class="elementor-widget">{h1}</h1></div><div class="elementor-widget elementor-widget-text">{rest}</div>',
        f'<form id="aspnetForm">{"".join(NOISE)}<div>{BODY}</div></form>',
        f'<form id="aspnetForm"><article>{BODY}</article><div class="comments"><p>Nice, thanks.</p></div></form>',
        f'<div class="promo-layout">{BODY}</div>',
    ]
    for i, page in enumerate(pages):
        for around in ("", "".join(NOISE)):
            assert htmltext.extract_text(f"<body>{around if i != 7 else ''}{page}{around if i != 7 else ''}</body>") == TEXT, (i, page)
    talk = "<p>I agree, fully, with all of it; and more, much more.</p>" * 200
    for noise in (f'<section id="comments">{talk}</section>', f'<div class="comments"><article class="comment">{talk}</article></div>',
                  f'<form class="newsletter"><p>{"Join us, now. " * 300}</p></form>', f'<div class="header"><h1>Site, name.</h1></div><div class="menu">{talk}</div>'):
        assert htmltext.extract_text(f"<body><article>{BODY}</article>{noise}</body>") == TEXT


def test_content_outside_the_region_is_kept():
    long = "".join(f"<p>Paragraph {i}, with words. It goes on, and on, as paragraphs do; and then, it ends.</p>" for i in range(20))
    text = re.sub("</p><p>", "\n", long)[3:-4]
    lead = "A lead, with words. It comes first, and is short."
    menu = '<ul><li><a href="/a">Home</a></li><li><a href="/b">More</a></li></ul>'
    # the title beside the body container, directly or wrapped
    for title in ("<h1>Title</h1>", "<div><h1>Title</h1></div>", '<h1><a href="/t">Title</a></h1>'):
        assert htmltext.extract_text(f'<body>{menu}<div class="post">{title}<div class="entry">{long}</div></div>{menu}') == "Title\n" + text
    # up to a tenth of the content in a sibling container, before and after
    page = f'<body>{menu}<div class="a"><p>{lead}</p></div>{menu}<div class="b"><h2>Part</h2>{long}</div>{menu}<div class="c"><h2>End</h2><p>{lead}</p></div>{menu}'
    assert htmltext.extract_text(page) == f"{lead}\nPart\n{text}\nEnd\n{lead}"
    # several articles, and a lead before the article
    parts = long.split("<p>Paragraph 12,")
    page = f"<body>{menu}<article><h2>One</h2>{parts[0]}</article>{menu}<article><h2>Two</h2><p>Paragraph 12,{parts[1]}</article>{menu}"
    assert htmltext.extract_text(page) == "One\n" + text.replace("Paragraph 12,", "Two\nParagraph 12,")
    page = f"<main><h1>Title</h1><div><p>{lead}</p></div>{menu}<article>{long}</article></main>"
    assert htmltext.extract_text(page) == f"Title\n{lead}\n{text}"
    deep = "<div>" * 3000 + f"<p>{lead}</p>" + "</div>" * 3000
    assert htmltext.extract_text(f"<article>{long}</article>{deep * 3}") == "\n".join([text] + [lead] * 3)


def test_edges():
    assert htmltext.extract_text(None) == htmltext.extract_text("") == htmltext.extract_text("<nav>only, menus.</nav>") == ""
    assert htmltext.extract_text("<p>a < b, and c > d.") == "a < b, and c > d."
    assert htmltext.extract_text('<p title="x>y">Fine, text.</p><!-- open') == "Fine, text."
    assert htmltext.extract_text("<article><ul><li>one, 1.<li>two, 2.</ul><table><tr><td>c, 1<td>c, 2</table></article>") == "one, 1.\ntwo, 2.\nc, 1\nc, 2"
    assert htmltext.extract_text("<article>" + "<div>" * 50_000 + "deep, text." + "</div>" * 50_000 + "</article>") == "deep, text."
    assert htmltext.extract_text("<article><p>x, y." + "</li></b>" * 100_000 + "<p>" * 50_000 + "z, z.") == "x, y.\nz, z."
    long = "<article>" + "<p>word, word.</p>" * 20_000 + "</article>"
    assert htmltext.extract_text(long).count("\n") == 19_999


def test_query_matches_articles(spark, sf_small):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf_small}/pages.parquet").collect()}
    rows = queries.op10_html(spark, sf_small).collect()
    assert len(rows) == len(pages)
    for r in rows:
        article = re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.DOTALL)[1]
        blocks = (re.sub(r"\s+", " ", stdlib_html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " ")))).strip() for b in re.split(r"</?(?:p|h1)>", article))
        assert r["text"] == "\n".join(b for b in blocks if b)
        assert r["n_chars"] == len(r["text"])


def test_edge_rows(spark):
    pages = spark.createDataFrame([(1, "u", None, "old"), (1, "u", "", "old"), (None, None, "<article><p>Yes, text.</p></article>", "old")],
                                  "page_id long, url string, html string, Text string")
    assert [r["text"] for r in htmltext.extract(pages).collect()] == ["", "", "Yes, text."]
    assert htmltext.extract(pages.limit(0)).count() == 0
