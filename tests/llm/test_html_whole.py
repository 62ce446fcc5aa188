"""Articles of hosts with mixed templates, and of pages that are not as tidy as the tables."""

from tidewatch.llm import html_extract


def texts(spark, pages, host="h.example"):
    rows = [(i, f"http://{host}/{i}", p) for i, p in enumerate(pages)]
    return [r.text for r in html_extract.extract_articles(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_host_mixes_templates(spark):
    pages = ["<body><article class=teaser><p>a</p></article>out</body>", "<body><main><p>b</p></main><p>out</p></body>", "<body><div class=content><p>c</p></div></body>", "<body><div><p>d</p></div></body>"]
    assert texts(spark, pages) == ["a", "b", "c", "d"]


def test_skipped_elements_end(spark):
    pages = ["<article><p>a<svg viewBox='0 0 1 1'/>b</p><svg><title/><path d='M0'/></svg><p>c</article>"]
    pages += [f"<article><p>a<{t}>skipped</p><p>b</p></article><p>out" for t in ("button", "select", "object", "noscript", "svg", "template")]
    pages += [f"<article><p>a</p><{t}><div>skipped</{t}><p>b</p></article>" for t in ("button", "object", "noscript")]
    pages += ["<article><p>a</p><script>'<p>x</p>'</script><textarea><p>y</textarea><p>b</p></article>"]
    assert texts(spark, pages) == ["a\nb\nc"] + ["a\nb"] * 10


def test_names_of_page_and_article(spark):
    pages = [
        "<html class=no-ads><body class='single-post no-sidebar'><header>h</header><article class='post has-comments'><p>a</p></article><div class=comments><article class=comment>c</article></div></body></html>",
        "<body class='sidebar-right menu'><div id=content class='with-menu'><p>a</p></div><div class=sidebar>s</div></body>",
        "<body><div class='sidebar'><article>s</article></div><div class='page social'><article class='post sponsored'><p>a</p><div class=share>x</div></article></div></body>",
        "<body><main class='menu widget'><p>a</p><div class=related-content>r</div></main></body>",
    ]
    assert texts(spark, pages) == ["a"] * 4


def test_shared_blocks_are_template(spark):
    notice = "we use many words for consent " * 20
    pages = [f"<body><div>{notice}</div><div>story {i}</div><div>short</div></body>" for i in range(12)]
    assert texts(spark, pages) == [f"story {i}" for i in range(12)]
    copied = ["<body><div>one long story</div></body>"] * 12
    assert texts(spark, copied) == ["one long story"] * 12


def test_names_of_each_page_align(spark):
    pages = [f"<body><article id=post-{i} class='post-{i} post tag-t{chr(97 + i % 26)}'><p class=css-{i}x{i}>{i}</p></article></body>" for i in range(60)]
    rows = [(f"http://h.example/{i}", p) for i, p in enumerate(pages)]
    frame = spark.createDataFrame(rows, "url string, html string")
    one, all_ = (html_extract.infer_wrappers(f).first() for f in (frame.limit(1), frame))
    assert all_.n_pages == 60 and all_.expression == one.expression and all_.template == one.template
    assert texts(spark, pages) == [str(i) for i in range(60)]


def test_shared_blocks_under_own_ids(spark):
    pages = [f"<body><div id=p{i}x><p>shared words</p><p>story {i}</p></div></body>" for i in range(12)]
    assert texts(spark, pages) == [f"story {i}" for i in range(12)]


def test_wrapper_decides_inside_articles(spark):
    """The same block on all pages, where the layout has a slot of its own for it, is template even inside the article."""
    pages = [f"<body><article><h1>title {i}</h1><div class=x9><b>Read our guide</b></div><p>story {i} {'word ' * 9}</p></article></body>" for i in range(6)]
    assert texts(spark, pages) == [f"title {i}\nstory {i}{' word' * 9}" for i in range(6)]
    assert texts(spark, pages[:2])[0] == f"title 0\nRead our guide\nstory 0{' word' * 9}"
    near = [f"<article><h1>same title</h1><div class=x9>same lead of many words</div><p>{i}</p></article>" for i in range(6)]
    assert texts(spark, near) == [f"same title\nsame lead of many words\n{i}" for i in range(6)]


def test_fragments(spark):
    pages = [
        "<body class='has-sidebar'><article><p>a</p></article></body>", "<body><article class='post share-enabled'><p>a</p></article></body>",
        "<article><h1 class='entry-header'>a</h1><div class='post-comments'>c</div></article>", "<article><p title=it's>a</p><p class=sidebar>s</p></article>",
    ]
    assert texts(spark, pages) == ["a"] * 4


def test_pages_of_any_shape():
    import time

    n = 10_000
    cases = {
        "<div>" * n + "<article><p>x<p>y</article>" + "</div>" * n: "x\ny",
        "<article>" + "<div>a" * n + "</div>" * n: "\n".join("a" * n),
        "<article>" + "<section>a" * 100 + "</section>b" * 100: "\n".join("a" * 100 + "b" * 100),
        "<nav>" + "<div>" * 100 + "menu" + "</div>" * 100 + "</nav><article>x</article>": "x",
        "<article>x</article>" + "<a b" * 250_000: "x",
        "<article>x</article>" + "<a b=\"" * 200_000: "x",
        "<article>x</article>" + "<a b='\"" * 200_000 + ">": "x",
        "<article>x</article>" + "<" * 1_000_000: "x",
        "<article>" + "<p>word</p>" * 90_000 + "</article>": "\n".join(["word"] * 90_000),
        "<dl>" * 200_000: "",
        "<article>x" + "<!--" * 100_000: "x",
    }
    for page, text in cases.items():
        began = time.time()
        assert html_extract.article_text(page) == text, page[:60]
        html_extract.bounded(html_extract.wrapper_of(html_extract.page_tree(page)))
        assert time.time() - began < 20, page[:60]


def test_wrappers_stay_bounded(spark):
    import random

    rng = random.Random(2)
    word = lambda: "".join(rng.choice("bcdfghjk") for _ in range(6))
    tags = ["div", "section", "ul", "p", "h2", "table"]

    def tree(depth):
        return "".join(f"<{(t := rng.choice(tags))} class={word()}>{word()}{tree(depth - 1) if depth else ''}</{t}>" for _ in range(3))

    whole = html_extract.wrapper_of(html_extract.page_tree(""))
    for _ in range(60):
        whole = html_extract.bounded(html_extract.merge(whole, html_extract.bounded(html_extract.wrapper_of(html_extract.page_tree(tree(4))))))
    assert html_extract._count(whole) <= html_extract.NODES + 1
    pages = [f"<body><div id=own-{i} class='c{i} card'><h2>t{i}</h2><p id=p{i}>story {i}</p></div><div class=foot9>the same words</div></body>" for i in range(1500)]
    assert texts(spark, pages) == [f"t{i}\nstory {i}" for i in range(1500)]
