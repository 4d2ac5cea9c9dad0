import time

import pytest

from portvigil.llm import page_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no</p>";</script></head>
<body class="with-sidebar"><header><a href="/">Home</a></header><nav><ul><li><a href="/a">Alpha</a></li><li><a href="/b">Beta</a></ul></nav>
<!-- <p>hidden</p> --><div class="ad">Buy the very best things that money can get for you today.</div>
<article><header><h1>The &amp; title</h1></header><p>First   <b>bold</b>&nbsp;text
of the <a href="/x">linked</a> story.<p>Second.<br>Third &lt;one&gt;.</p><aside>Read this as well.</aside>
<div class="cookie-notice">We use cookies on this page.</div><form><p>Your mail</p><input></form><ul><li>One<li>Two</ul></article>
<section id="comments"><p>Great article, I have enjoyed reading every word of it very much.</p></section>
<footer><p>&copy; 2024 somebody with a long line of legal text</p></footer></body>"""


def extracted(spark, pages):
    df = spark.createDataFrame([(i, f"u{i}", h, "clash") for i, h in enumerate(pages)], "page_id long, url string, html string, text string")
    return [r for r in page_text.extract(df).orderBy("page_id").collect()]


def test_article_only(spark):
    (row,) = extracted(spark, [PAGE])
    assert row.text == "The & title\nFirst bold text of the linked story.\nSecond.\nThird <one>.\nOne\nTwo"
    assert row.n_chars == len(row.text) and row.url == "u0"


def test_odd_pages(spark):
    long = "<article>" + "<p>word and more words here</p>" * 20_000 + "</article>"
    rows = extracted(spark, [None, "", "<p", "<article><p>x", "<nav>a</nav>", "<article><script>never closed", long, "<article>" + "<div>" * 5000 + "deep", "<article>é🙂</article>"])
    texts = [r.text for r in rows]
    assert texts[:6] == ["", "", "", "x", "", ""]
    assert texts[6].count("\n") == 19_999 and texts[7] == "deep"
    assert (texts[8], rows[8].n_chars) == ("é🙂", 2)
    assert extracted(spark, []) == []


def test_without_an_article_element(spark):
    text = " ".join(["word"] * 60)
    menu = "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(9))
    (row,) = extracted(spark, [f"<body><ul>{menu}</ul><div>{text}</div><div>{text}</div></body>"])
    assert row.text == f"{text}\n{text}"


def test_tree_fits_its_table():
    tree = page_text.train_tree()

    def label(node, row):
        while node.low is not None:
            node = node.low if row[node.feature] <= node.limit else node.high
        return node.label

    assert all(label(tree, row[:-1]) == row[-1] for row in page_text.LABELLED)


@pytest.mark.parametrize("page", ["<p>a<p>b", "<ul><li>a<li>b</ul>", "<div>a<div>b</div></div>", "a<br/>b", "<td>a<td>b"])
def test_blocks_are_flat(page):
    assert [b[0] for b in page_text.blocks(page)] == ["a", "b"]


@pytest.mark.parametrize(
    "page",
    [
        '<article><div aria-hidden="false">kept</div></article>',
        '<article><div class="overflow-hidden">kept</div></article>',
        '<article><div style="overflow:hidden">kept</div></article>',
        '<article><div hidden="until-found" data-x="display:none">kept</div></article>',
        '<article class="post has-sidebar"><p>kept</article>',
        '<main id="comments"><p>kept</main>',
        '<article><div class="entry-header"><h1>kept</h1></div></article>',
        '<article><div id="legal-text">kept</div></article>',
        '<article><div class="header">kept</div></article>',
        '<div class="sidebar"><div id="menu content"><article>kept</article></div></div>',
        '<div class="sidebar"><p>kept</p><main></main></div>',
    ],
)
def test_attributes_that_close_nothing(page):
    assert [(b[0], b[3]) for b in page_text.blocks(page)] == [("kept", False)]


@pytest.mark.parametrize("mark", ['hidden', 'hidden=""', 'HIDDEN class=x', 'aria-hidden="true"', "style='color:red; display : none'", 'style="display:none"'])
def test_hidden_attributes(mark):
    assert page_text.blocks(f"<article><div {mark}>gone</div></article>") == []


@pytest.mark.parametrize("mark", ['class="x cookie-notice"', 'id=sidebar', 'class="site-footer"', 'role="navigation"', 'class="ad-slot"'])
def test_marks_of_other_parts(mark):
    assert [b[3] for b in page_text.blocks(f"<div {mark}>other</div><article><p>x</p><div {mark}>other</div></article>")] == [True, False, True]


def test_comments_as_articles_stay_apart():
    page = '<article>x</article><div id="comments"><article class="comment">y</article></div>'
    assert [b[3] for b in page_text.blocks(page)] == [False, True]


MEGABYTE = 1_000_000


@pytest.mark.parametrize(
    "page",
    [
        "<a x" * (MEGABYTE // 4) + '"',
        "<div>" * (MEGABYTE // 10) + "</p>" * (MEGABYTE // 8),
        "<div class=menu>" * (MEGABYTE // 32) + "<article></article>" * (MEGABYTE // 40) + "x",
        "<script>" + "</script " * (MEGABYTE // 9),
        ("<a \"'" + "<b '\"") * (MEGABYTE // 12) + '"',
    ],
    ids=["tags without end", "end tags without start", "marks in marks", "raw text without end", "quotes in quotes"],
)
def test_hostile_pages_of_a_megabyte_take_seconds(page):
    start = time.monotonic()
    page_text.blocks(page)
    assert time.monotonic() - start < 20


def test_text_behind_an_endless_quote_is_text():
    assert [b[0] for b in page_text.blocks("a <b c=\"x <i>y</i> 'z")] == ["a <b c=\"x y 'z"]


def test_repeated_rows(spark):
    rows = extracted(spark, [PAGE, PAGE])
    assert rows[0].text == rows[1].text and spark.createDataFrame(rows).count() == 2
