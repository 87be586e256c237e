from pyspark.sql import functions as F

from tessera.llm import html as H

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{{}}</style><script>var t="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li><li>More</li></ul></nav><!-- ad <p>no</p> -->
<div class="ad">Buy</div><div id="cookie-notice">We use cookies</div>
<article><header><h1>Head&eacute;r {n}</h1></header><p>One <b>b</b>old &lt;tag&gt;&nbsp;x
 y<br>z</p><aside>Beside</aside><p class="lead">Two {n}<ul><li>li 1<li>li 2</ul><form><input value="q"><button>Go</button></form>
<div class='comments'><p>Reader says</p></div></article>
<div class="sidebar"><p>Side</p></div><footer>&copy; Foot</footer></body></html>"""


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_article(spark):
    rows = [(k, f"http://h.example/{k}", PAGE.format(n=k)) for k in range(5)]
    found = {r.page_id: r for r in H.extract(pages(spark, rows).withColumn("text", F.lit("clash"))).collect()}
    assert found[3].text == "Headér 3 One bold <tag> x y z Two 3 li 1 li 2"
    assert found[3].n_chars == len(found[3].text) and found[3].url == "http://h.example/3"


def test_without_an_article(spark):
    page = '<body><div class="menu">Home</div><div class="story"><h1>Title {n}</h1><p>Text {n} of the story goes on.</p></div><div>Same line</div><div class="footer">F</div>'
    rows = [(k, "https://x.example/a", page.format(n=k)) for k in range(4)]
    assert [r.text for r in H.extract(pages(spark, rows)).orderBy("page_id").collect()][1] == "Title 1 Text 1 of the story goes on."


def test_a_host_of_several_templates(spark):
    plain = '<body><div class="menu">Home</div><div><h1>Title {n}</h1><section><p>Plain text {n} goes on.</p></section></div></body>'
    marked = '<body><div class="menu">Home</div><div class="story"><p>MANY</p></div><div class="x"><p>Beside {n}.</p></div></body>'.replace("MANY", "Marked text {n} " * 9)
    main = "<body><nav>Menu</nav><main><p>Main {n}</p></main></body>"
    for url in ("http://h.example/a", None):
        rows = [(k, url, x.format(n=k)) for k, x in enumerate([PAGE, plain, main, plain, marked, plain, marked])]
        found = [r.text for r in H.extract(pages(spark, rows)).orderBy("page_id").collect()]
        assert found[0] == "Headér 0 One bold <tag> x y z Two 0 li 1 li 2" and found[2] == "Main 2"
        assert [found[k] for k in (1, 3, 5)] == [f"Title {k} Plain text {k} goes on." for k in (1, 3, 5)]
        assert [found[k] for k in (4, 6)] == [("Marked text %d " % k * 9).strip() for k in (4, 6)]


def test_class_words_that_mark_no_sidebar(spark):
    text = "<p>A text that goes on for a while, and then some more of it.</p>"
    rows = [
        (0, "http://a.x/", f"<body><div class='content has-sidebar'><article><h1>T</h1>{text}</article></div><div class='sidebar'>S</div>"),
        (1, "http://b.x/", f"<body><div class='site-header'>H</div><div class='article-header'><h1>T</h1></div><div class='entry share-enabled comments-open'>{text}</div><div class='cookie-notice'>C</div>"),
        (2, "http://c.x/", f"<body><div class='sidebar right'><nav>N</nav><article><h1>T</h1>{text}</article></div>"),
        (3, "http://d.x/", f"<body><div id='widget'><div class='menu'>M</div><h1>T</h1>{text}</div><div class='main-menu'>M</div>"),
        (4, "http://e.x/", f"<body><div class='story'><h1>T</h1>{text}</div><div class='comments'>{text * 3}</div>"),
        (5, "http://f.x/", f"<body><div role='navigation'>{text * 3}</div><div class='related'><article>R</article></div><div class='story'><h1>T</h1>{text}</div>"),
    ]
    found = [r.text for r in H.extract(pages(spark, rows)).orderBy("page_id").collect()]
    assert found == ["T A text that goes on for a while, and then some more of it."] * 6


def test_common_sequences(monkeypatch):
    import random

    rng = random.Random(3)
    for cells in (4 << 20, 6):
        monkeypatch.setattr(H, "CELLS", cells)
        for _ in range(300):
            x, y = ([rng.choice("abcd") for _ in range(rng.randint(0, 14))] for _ in range(2))
            table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
            for i, a in enumerate(x):
                for j, b in enumerate(y):
                    table[i + 1][j + 1] = table[i][j] + 1 if a == b else max(table[i][j + 1], table[i + 1][j])
            pairs = H.common(x, y)
            assert len(pairs) == table[-1][-1] and all(x[i] == y[j] for i, j in pairs)
            assert all(a < c and b < d for (a, b), (c, d) in zip(pairs, pairs[1:], strict=False))


def test_trees_as_text():
    for html in (PAGE, "", "x", "<div>a<p>b</div>c" * 3):
        assert H.loaded(H.dumped(H.tree(html))) == H.tree(html)


def site(rng, article, blocks, beside):
    """A page of a made-up site: its html and the text that should come out."""
    inner, text = "", []
    for name, n in blocks:
        words = " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))
        inner += f"<{name}>{words}</{name}>"
        text.append(words)
    for k, extra in enumerate(beside):
        inner = extra + inner if k % 2 else inner + extra
    return f"<html><body><header>Site</header><nav><ul><li>A<li>B</ul></nav>{article.format(inner)}<footer>F</footer></body></html>", " ".join(text)


def test_generated_sites(spark):
    import random

    rng = random.Random(11)
    frames = ["<article>{}</article>", "<div class='wrap has-sidebar'><article>{}</article><div class='sidebar'>S</div></div>", "<main><div>{}</div></main>", "<div class='entry-content'>{}</div><div class='related'>R</div>", "<div id='story'>{}</div><div class='comments'><p>c</p></div>", "<div>" * 1200 + "{}" + "</div>" * 1200]
    extras = ["<aside>x</aside>", "<form><p>q</p></form>", "<div class='share'>x</div>", "<script>var a='<p>';</script>"]
    rows, want = [], {}
    for host in range(12):
        frame = rng.choice(frames) if host else frames[-1]
        for _ in range(rng.randint(1, 8)):
            blocks = [("h1", 5)] + [(rng.choice(["p", "p", "h2", "blockquote", "pre"]), rng.randint(8, 40)) for _ in range(rng.randint(1, 12))]
            html, text = site(rng, frame if rng.random() < 0.8 or not host else rng.choice(frames[:3]), blocks, rng.sample(extras, rng.randint(0, 3)))
            rows.append((len(rows), f"http://h{host}.example/", html))
            want[len(want)] = text
    found = {r.page_id: r.text for r in H.extract(pages(spark, rows).repartition(3)).collect()}
    assert found == want


def test_many_trees_of_a_host(spark, monkeypatch):
    monkeypatch.setattr(H, "FOLD", 3)
    rows = [(k, "http://a.x/", "<body><div class='menu'>M</div><div class='story'>" + "".join(f"<{t}>t {k}</{t}>" for n, t in enumerate(("h1", "p", "h2", "ul", "h3", "ol")) if k >> n & 1) + f"<p>end {k}</p></div></body>") for k in range(64)]
    found = {r.page_id: r.text for r in H.extract(pages(spark, rows).repartition(5)).collect()}
    assert found == {k: " ".join([f"t {k}"] * bin(k).count("1") + [f"end {k}"]) for k in range(64)}
    wrapper = H.wrappers(pages(spark, rows).selectExpr("'a.x' as host", "html")).collect()
    assert len(wrapper) == 1 and all(t in wrapper[0].wrapper for t in ("h1", "h2", "h3", "ol"))


def test_deep_and_long_pages(spark):
    rows = [
        (0, "http://a.x/", "<div>" * 5000 + "deep" + "</div>" * 5000), (1, "http://a.x/", "".join(f"<x{k % 7}>t{k} " for k in range(20_000))), (2, "http://b.x/", "<article>" + "<section><p>a" * 3000),
        (3, "http://c.x/", "<article>" + "".join(f"<h2>t{k}</h2><p>b{k}</p>" for k in range(4000)) + "</article>"), (4, "http://c.x/", "<article>" + "".join(f"<p>b{k}</p><ul><li>l</ul>" for k in range(3000)) + "</article>"),
    ]
    found = {r.page_id: r.text for r in H.extract(pages(spark, rows)).collect()}
    assert found[0] == "deep" and found[1] == " ".join(f"t{k}" for k in range(20_000)) and found[2] == " ".join("a" * 3000)
    assert found[3] == " ".join(f"t{k} b{k}" for k in range(4000)) and found[4] == " ".join(f"b{k} l" for k in range(3000))


def test_odd_pages(spark):
    rows = [
        (1, "u", None), (2, None, ""), (3, "http://a.b", "plain text, 1 < 2 & more"), (4, "http://a.b", "<p>unclosed <b>bold<p>next"), (5, "http://a.c", "<<<>>> &am &#x41; <p"),
        (6, "http://a.d", "<p>" * 3000 + "deep"), (7, "http://a.e", "<div>" * 300 + "deep" + "</div>" * 300), (8, "http://a.f", "<p title=\"a>b\">q</p><p title='x>y>r</p>"), (9, "http://a.f", "<script>never closed"), (9, "http://a.f", "<script>never closed"),
    ]
    found = [(r.page_id, r.text) for r in H.extract(pages(spark, rows)).orderBy("page_id").collect()]
    assert len(found) == len(rows)
    texts = dict(found)
    assert texts[1] == texts[2] == texts[9] == "" and texts[4] == "unclosed bold next" and texts[3] == "plain text, 1 < 2 & more" and texts[6] == texts[7] == "deep"
    assert H.extract(pages(spark, [])).count() == 0


def test_wrapper_is_a_regular_expression_without_unions():
    a, b = (H.tree(x) for x in ("<body><nav><a>x</a></nav><article><h1>t</h1><p>a</p><p>b</p></article></body>", "<body><article><h1>t</h1><p>a</p><ul><li>x</li></ul></article><footer>f</footer></body>"))
    assert H.expression(H.aligned(a, b)) == "body(nav!(#)?article(h1(#)p(#)+ul(li(#))?)footer!(#)?)"
    assert H.expression(H.aligned(b, a)) == H.expression(H.aligned(a, b))
    assert H.aligned(a, a)[2] == a[2]
