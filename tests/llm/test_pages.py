import time

import pytest

from parley.llm import pages

PROSE = "A paragraph of running text, long enough to matter, with marks. And a second sentence of it."
CASES = [
    (None, ""),
    ("", ""),
    ("plain &lt;text&gt;\n only", "plain <text> only"),
    (f"<nav><a href=x>Home</a></nav><article><h1>T</h1><p>{PROSE}<p>b&amp;c<br>d</article><footer>{PROSE}</footer>", f"T\n{PROSE}\nb&c d"),
    (f"<body><div class='side-bar sidebar'>{PROSE}</div><div id='content'><p>{PROSE}</p><form>send</form><p>end</p></div><div class=ad>{PROSE}</div>", f"{PROSE}\nend"),
    (f"<main><article class=post><header><h2>Head</h2><a>by me</a></header><p>{PROSE}</p><section id=comments><p>{PROSE}</p></section></article></main>", f"Head\n{PROSE}"),
    (f"<body><ul><li><a>one</a><li><a>two</a></ul><p>{PROSE}</p><script>var a='<p>no</p>'</script><p>{PROSE}</p><p><a>more</a></p></body>", f"{PROSE}\n{PROSE}"),
    (f"<article><p><b>open <i>tags</p><p>{PROSE}</b></p><!-- gone <p>x</p> --><p>e&eacute;&nbsp;&#x41;</article>", f"open tags\n{PROSE}\neé A"),
    (f"<article><p>{PROSE}</p><style>p{{}}", PROSE),
    (f"<article><p>{PROSE}<!-- never closed <p>x", PROSE),
    (f"<article><div class='cookie-notice'>We use cookies</div><p>{PROSE}</p><div class='comment'>{PROSE}</div></article>", PROSE),
    ('<article><p title="a > b">x</p></article>', "x"),
]


@pytest.mark.parametrize("page, text", CASES)
def test_pages_by_hand(page, text):
    assert pages.extract(page) == text


@pytest.mark.parametrize(
    "page",
    [
        f"<article class='post has-comments'><p>{PROSE}</p></article>",
        f"<article class='post social'><p>{PROSE}</p></article>",
        f"<main class='main no-sidebar'><p>{PROSE}</p></main>",
        f"<body><div class='content with-sidebar'><p>{PROSE}</p></div></body>",
        f"<body><div class='post category-legal-notice'><p>{PROSE}</p></div><div class=sidebar><p>{PROSE}</p></div></body>",
        f"<body><div class='page sidebar'><div><p>{PROSE}</p></div><div class=widget><p>see</p></div></div></body>",
        f"<body><div id=search><article><p>{PROSE}</p><div class=comments><p>{PROSE}</p></div></article></div></body>",
    ],
)
def test_a_class_word_alone_drops_no_article(page):
    assert pages.extract(page) == PROSE


def test_link_lists_in_the_article_are_below_the_threshold():
    links = "".join(f"<li><a href=/{i}>Another story number {i}</a></li>" for i in range(8))
    items = "".join(f"<li>{c}</li>" for c in "abcdefghij")
    for mark in ("article", "div id=content"):
        page = f"<{mark}><h1>T</h1><p>{PROSE}</p><p>{PROSE} <a href=x>link</a></p><div class=most-read><ul>{links}</ul></div><ol class=parts>{items}</ol><p>end</p></{mark.split()[0]}>"
        assert pages.extract(page).split("\n") == ["T", PROSE, f"{PROSE} link", *"abcdefghij", "end"]


@pytest.mark.parametrize("size", [100, 5_000, 300_000])
def test_long_values_with_tag_ends(size):
    value = "b" * size + "> <p>not text</p>" + "b" * size
    many = " ".join(f'data-{i}="a>b"' for i in range(2_000))
    assert pages.extract(f'<article><p data-x="{value}" {many}>{PROSE}</p></article>') == PROSE
    assert pages.extract(f"<article><p data-x='{value}'>{PROSE}</p></article>") == PROSE


def test_hostile_quotes_take_linear_time():
    start = time.time()
    for page in ('<a "' * 100_000, "<a '\"" * 100_000, "<a \"''" * 100_000, '<a b="' + "<a b='" * 100_000, "<a" + " b='c'" * 100_000, "<a" + ' b="c' * 99_999):
        pages.extract(page)
    assert time.time() - start < 20


def test_given_pages_keep_the_whole_article(spark, folder):
    import html
    import re

    rows = pages.extract_pages(spark.read.parquet(f"{folder}/pages.parquet")).collect()
    given = {r.page_id: r.html for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    assert len(rows) == len(given)
    for r in rows:
        inner = given[r.page_id].split("<article>")[1].split("</article>")[0]
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", b.replace("<br>", " "))).split()) for b in re.split("</?(?:p|h1)>", inner)]
        assert r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)


def test_hostile_pages_take_linear_time():
    start = time.time()
    for page in ("<a '" * 50_000, "<div>" * 50_000 + "x", "<p>" * 50_000, "<!--" * 50_000, "<b>x" * 50_000, "&amp;" * 100_000, "</p>" * 50_000):
        pages.extract(page)
    assert time.time() - start < 60


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (None, "u", "<p>x"), (1, None, None)], "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    assert sorted(map(str, (tuple(r) for r in pages.extract_pages(df).collect()))) == sorted(map(str, [(1, None, "", 0), (None, "u", "x", 1), (1, None, "", 0)]))
    assert pages.extract_pages(df.where("false")).count() == 0


RUNNING = "A long sentence of running text, with commas, and a full stop at its end. " * 3


@pytest.mark.parametrize(
    "tag",
    [
        '<article class="card overflow-hidden">', '<div class="content overflow-hidden">', '<main style="overflow: hidden">', '<article data-title="hidden gem">',
        '<article class="post" aria-hidden="false">', "<main id=main data-visibility='visibility: hidden'>", '<article title="display: none">',
    ],
)
def test_a_word_in_another_attribute_hides_nothing(tag):
    name = tag[1:].split()[0]
    assert pages.extract(f"<html><body><nav><a href=/>Home</a></nav>{tag}<p>{RUNNING}</p><p>{RUNNING}</p></{name}></body></html>").startswith("A long sentence")


@pytest.mark.parametrize("attrs", ["hidden", 'class=x hidden=""', 'aria-hidden="true"', 'style="color: red; display:none"', "style='visibility: hidden'", "style=display:none"])
def test_hidden_elements_are_left_out(attrs):
    got = pages.extract(f"<article><p>{RUNNING}</p><div {attrs}><p>Unseen. {RUNNING}</p></div><p>{RUNNING}</p></article>")
    assert "Unseen" not in got and got.count("\n") == 1


def test_a_slash_closes_no_script():
    got = pages.extract(f"<article><p>{RUNNING}</p><script src=https://x.com/>code(1, 2); more.code();</script><p>{RUNNING}</p></article>")
    assert "code" not in got and got.count("\n") == 1
