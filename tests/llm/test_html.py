import html
import re

from tessera.llm import html_text as H
from tests.llm.conftest import SF


def test_articles_of_the_table(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r["page_id"]: r for r in H.extract_all(pages).collect()}
    for page_id, _, page in pages.collect():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b)))).strip() for b in re.split(r"</?p>|</?h1>", article)]
        assert got[page_id]["text"] == "\n".join(b for b in blocks if b) and got[page_id]["n_chars"] == len(got[page_id]["text"])


LONG = "This is a long paragraph of the article, with quite a few words in it, as articles have."


def page(*parts):
    return f"<html><head><title>T</title><style>p{{}}</style></head><body>{''.join(parts)}</body></html>"


def test_what_surrounds_an_article():
    around = ['<div id="header">Head <a href=x>a</a></div>', '<ul class="menu"><li><a href=1>One</a><li><a href=2>Two</a></ul>', '<div class="cookie-notice">We use cookies to make it all much better for everyone</div>', '<form><label>Mail</label><input></form>', "<script>var p = '<p>no</p>'</script>", '<div class="sidebar"><p>Other things to read</p></div>', '<div id="comments"><p>I like this very much, it is so good</p></div>', "<footer>Imprint</footer>", "<!-- <p>hidden</p> -->"]
    for box in ("article", "main", "section", 'div class="content"'):
        text = H.extract(page(*around[:4], f"<{box}><h2>Title</h2><p>{LONG}<p>{LONG} <a href=y>more</a></{box.split()[0]}>", *around[4:]))
        assert text == f"Title\n{LONG}\n{LONG} more"


def test_broken_markup_and_references():
    assert H.extract("just text &amp; more &eacute;&#33;") == "just text & more é!"
    assert H.extract("<p>a<p>b") == "a\nb" and H.extract("<p>four < five &lt; six</p>") == "four < five < six"
    assert H.extract('<p>cut <a href="') == "cut" and H.extract("<script>x") == "" and H.extract("<p>a <!-- b") == "a"
    assert H.extract("<p>one<br>two\n\n three&nbsp;</p>") == "one two three"
    assert H.extract("<div>" * 5000 + "deep" + "</div>" * 5000) == "deep"


def test_odd_tables(spark):
    pages = spark.createDataFrame([(1, "u", None), (2, None, ""), (None, "u", "<p>x</p>"), (3, "u", "<nav>only</nav>")], "page_id long, url string, html string")
    got = H.extract_all(pages.selectExpr("*", "'x' AS text", "1 AS n_chars"))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted([(1, "u", "", 0), (2, None, "", 0), (None, "u", "x", 1), (3, "u", "", 0)], key=repr)
    assert H.extract_all(pages.filter("false")).count() == 0


def test_split_content_is_kept_whole():
    long = [f"Paragraph {i} of the text. " + "Words and more words follow it. " * 9 for i in range(12)]
    long = [x.strip() for x in long]
    paragraphs = "".join(f"<p>{x}</p>" for x in long)
    first, second = "".join(f"<p>{x}</p>" for x in long[:6]), "".join(f"<p>{x}</p>" for x in long[6:])
    advert = '<div class="ad"><p>Buy this now</p></div>'
    assert H.extract(page(f"<h1>Title</h1><div>{first}</div>{advert}<div>{second}</div>")) == "\n".join(["Title", *long])
    assert H.extract(f"<h1>Title</h1><div>{first}</div>{advert}<div>{second}</div>") == "\n".join(["Title", *long])
    assert H.extract(page(f"<div><div>{first}</div>{advert}<h2>Next</h2><div>{second}</div></div><p>Short</p>")) == "\n".join([*long[:6], "Next", *long[6:]])
    assert H.extract(page(f"<article>{first}</article>{advert}<article>{second}</article>")) == "\n".join(long)
    assert H.extract(page(f"<article><p>{long[0]}</p></article><div><article><p>{long[1]}</p></article></div>")) == "\n".join(long[:2])
    assert H.extract(page(f"<div>{paragraphs}</div>")) == "\n".join(long)


def test_names_that_do_not_name_a_part():
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    for attrs in ("class='container has-sidebar'", "id='page' class='no-sidebar'", "class='layout--with-sidebar'", "class='social-science'", "class='hidden-print'", "class='client-side'", "class='sidebar-left'", "class='commentary'", "id=header"):
        assert H.extract(page(f"<div {attrs}><article>{text}</article></div>")) == f"{LONG}\n{LONG}"
        assert H.extract(page(f"<section {attrs}>{text}</section>")) == f"{LONG}\n{LONG}"
    for attrs in ("class=social-science", "class=hidden-print", "class='wide commentary'", "class=has-comments"):
        assert H.extract(page(f"<div><p>{LONG}</p><div {attrs}><p>{LONG}</p></div><p>{LONG}</p></div>")) == "\n".join([LONG] * 3)
    comment = f"<div id=comments><article class=comment-body>{text}</article><article>{text * 4}</article></div>"
    assert H.extract(page(f"<article>{text}</article>{comment}")) == f"{LONG}\n{LONG}"
    for name in ("ad", "ad-slot", "site-footer", "post-comments", "cookie-banner", "nav-menu", "left-sidebar", "share-buttons", "top_nav", "related-posts", "newsletter-box", "cookiebanner"):
        assert H.extract(page(f"<div><p>{LONG}</p><div class='x {name}'><p>Not of it</p></div><p>{LONG}</p></div>")) == f"{LONG}\n{LONG}"


def test_names_within_an_article_drop_no_content():
    text = f"<p>{LONG}</p><p>{LONG}</p>"
    got = H.extract(page(f'<article><h1 class="entry-header">Title</h1>{text}<p class="share-price">The price rose</p><section id="legal-history"><p>{LONG}</p></section><div class="legal"><p>{LONG}</p></div><label>So it is</label><menu><li>One</li></menu></article>'))
    assert got == "\n".join(["Title", LONG, LONG, "The price rose", LONG, LONG, "So it is", "One"])
    assert H.extract(page(f'<main><div class="article-header"><h1>Title</h1></div>{text}</main>')) == f"Title\n{LONG}\n{LONG}"
    assert H.extract(page(f"<article><header><h1>Title</h1><p>By someone</p></header>{text}</article>")) == f"Title\nBy someone\n{LONG}\n{LONG}"
    assert H.extract(page(f"<header><h1>Site</h1></header><main>{text}<menu><li><a href=1>One</a><li><a href=2>Two</a></menu></main>")) == f"{LONG}\n{LONG}"
    several = "".join(f"<div class=comment><p>{LONG}</p></div>" for _ in range(5))
    for box in ("main", "div class=content", "article"):
        assert H.extract(page(f"<{box}>{text}<section id=comments><h2>Comments</h2>{several}</section></{box.split()[0]}>")) == f"{LONG}\n{LONG}"
    menu = "".join(f"<a href={i}>link {i}</a>" for i in range(9))
    assert H.extract(page(f"<table><tr><td>{menu}</td><td><table><tr><td><h1>Title</h1>{text}</td></tr></table></td></tr></table>")) == f"Title\n{LONG}\n{LONG}"


def test_density_decides_without_article_elements(spark):
    """The same pages with their article elements renamed give the same text, if that is most of the page's."""
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for page_id, _, p in pages.collect():
        for tag in ("div", "section", "main") if len(H.extract(p)) > 300 else ("main",):
            assert H.extract(re.sub(r"(</?)article>", rf"\1{tag}>", p)) == H.extract(p), (page_id, tag)
