import html
import re

from pyspark.sql import functions as F

from termweave.llm import dom, pages


def words(text):
    return " ".join(text.split())


def page(article, nav="Home News", ad="Buy now", extra=""):
    return f"<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href='/'>{nav}</a></li></ul></nav><!-- ad --><div class=\"ad\">{ad}</div><article>{article}</article>{extra}<footer>&copy; x</footer></body></html>"


def test_matching_is_largest():
    a = dom.read_page("<div><p>1</p><ul><li>x</li></ul><p class=z>2</p></div>").structure
    b = dom.read_page("<div><ul><li>x</li><b>y</b></ul><p class=z>2</p></div>").structure
    m = dom.simple_tree_matching(a, b)
    assert {(a[x][1], b[y][1]) for x, y in m.items()} == {("", ""), ("div", "div"), ("ul", "ul"), ("li", "li"), ("p.z", "p.z")}
    tree = dom.merged(a, b)
    assert tree[: len(a)] == a and len(tree) == len(a) + 1


def test_tag_soup():
    p = dom.read_page("<p><b>one<br>two<p>three <i>f</i>our<ul><li>a<li>b &amp; &#x63;</ul><script>if (a<b) '</p>'</script>x < y<div>z")
    assert [b[1] for b in p.blocks] == ["one two", "three four", "a", "b & c", "x < y", "z"]
    assert dom.read_page("").blocks == [] and dom.read_page("<!-- open").blocks == [] and dom.read_page("<").blocks[0][1] == "<"
    assert dom.read_page("<script>never ends").blocks == []


def test_article_without_what_stands_beside_it(spark):
    rows = []
    for i in range(12):
        inner = f"<h1>Title {i}</h1><p><b>Title {i}<br><p>Text {i} &amp; more\n of  it.<p>Read our terms.</p><aside>side {i}</aside><div class='comments'><p>c {i}</p></div><form><label>Name</label></form>"
        rows.append((i, f"https://h.example/{i}", page(inner, nav=f"N {i}", ad=f"A {i}", extra=f"<div id='sidebar-left'>s {i}</div>")))
    rows += [(50, "http://only.example/1", page("<p>One &lt;page&gt;</p>")), (51, None, None), (52, "::", ""), (53, "http://plain.example", "<body><div class=top>Our site</div><div class=box><p>long text here that goes on</p><p>and more of it, too</p></div></body>"), (50, "http://only.example/1", page("<p>One &lt;page&gt;</p>"))]
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = pages.extract(df).collect()
    assert len(got) == len(rows)
    text = {r.page_id: r.text for r in got}
    for i in range(12):
        assert text[i] == f"Title {i} Title {i} Text {i} & more of it."
    assert text[50] == "One <page>" and text[51] == "" and text[52] == ""
    assert text[53] == "long text here that goes on and more of it, too"
    assert all(r.n_chars == len(r.text) for r in got)
    assert pages.extract(df.limit(0)).count() == 0


def many(spark, groups):
    """The texts of each group's pages; a group is a host."""
    rows = [(100_000 * n + i, f"http://h{n}.example/{i}", body) for n, bodies in enumerate(groups) for i, body in enumerate(bodies)]
    out = [{} for _ in groups]
    for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        out[r.page_id // 100_000][r.page_id % 100_000] = r.text
    return out


def extracted(spark, bodies):
    return many(spark, [bodies])[0]


LISTS = (
    "<body><div class=page><h1>Title {0}</h1><p class=lead>Lead {0}</p><div class=body><h2>Part {0}</h2><p>Long text {0} that goes on "
    "<a href=/>and on {0}</a> for quite some while, as paragraphs do</p><ul><li>point {0}</ul><table><tr><td>cell {0}</table>"
    "<blockquote>quote {0}</blockquote></div></div><div class=low>Imprint</div></body>"
)
LISTS_TEXT = "Title {0} Lead {0} Part {0} Long text {0} that goes on and on {0} for quite some while, as paragraphs do point {0} cell {0} quote {0}"
NAMED = "<article class='post social'><h1>Title {0}</h1><p>text {0}</p><div class=comments>no {0}</div><article class=comment>no</article></article><div class='comment-list'><p>a much longer comment {0} than the text</p></div>"
CONTAINERS = [
    "<body class='right-sidebar'><h1>Title {0}</h1><p>text {0}</p>",
    "<body class='cookie-notice nav-open'><main class=widget><h1>Title {0}</h1><p>text {0}</p></main>",
    "<body><div id=content class='has-comments'><h1>Title {0}</h1><p>text {0}</p><div class=ad>no {0}</div></div>",
    f"<body><div class='with-sidebar'>{NAMED}</div>",
    NAMED,
]
STORY = "<body><div class='top'><p>Our site</p></div><div class='box'><p>story {0} begins here and goes on</p><p>until {0} ends somewhere</p></div><div class='low'>Imprint</div></body>"


def test_hosts_of_many_kinds(spark):
    copies = [page("<p>Same text.</p>")] * 9
    groups = [copies, [STORY.format(i) for i in range(8)], [LISTS.format(i) for i in range(8)], [LISTS.format(3)]]
    groups += [[c.format(i) for i in range(6)] for c in CONTAINERS] + [[c.format(0)] for c in CONTAINERS]
    main = [
        "<body><h1 class='main-title'>Title {0}</h1><div class=content><p>text {0} goes on</p></div>",
        "<body><div id=main><h1>Title {0}</h1></div><div class=content><p>text {0} goes on</p></div>",
        "<body><div class='main'><h1>Title {0}</h1><p>text {0} goes on</p></div><div>see {0}</div>",
    ]
    groups += [[m.format(i) for i in range(6)] for m in main]
    got = many(spark, groups)
    assert set(got[0].values()) == {"Same text."}
    assert got[1] == {i: f"story {i} begins here and goes on until {i} ends somewhere" for i in range(8)}
    # What stands beside paragraphs stays: titles, lists, links. One page has no template.
    assert got[2] == {i: LISTS_TEXT.format(i) for i in range(8)} and got[3] == {0: LISTS_TEXT.format(3) + " Imprint"}
    # Names of what holds the page don't drop it.
    assert got[4:9] == [{i: f"Title {i} text {i}" for i in range(6)}] * 5 and got[9:14] == [{0: "Title 0 text 0"}] * 5
    # Main elements are the page only if they hold the text.
    assert got[14:17] == [{i: f"Title {i} text {i} goes on" for i in range(6)}] * 3


def test_near_copies_and_passages_of_articles_stay(spark):
    shared = [f"paragraph {k} of a text that is on many pages of this host" for k in range(6)]
    near = [[*shared[:2], f"edited {i}", *shared[3:]] for i in range(8)]
    others = [[f"own text {i} {k} that is nowhere else" for k in range(5)] for i in range(4)]
    # One passage at another place of each page.
    passing = [[f"own {i} {k} and more" for k in range(i)] + ["A passage."] + [f"own {i} {k} and more" for k in range(i, 9)] for i in range(9)]
    groups = [near + others, near, passing, 3 * near[:2] + others]
    bodies = [[page("".join(f"<p>{t}</p>" for t in ts)) for ts in texts] for texts in groups]
    # Of copies without main elements only one counts; what is on the other pages too is template.
    groups.append(9 * near[:1] + others)
    bodies.append(["<body><div class=low>Imprint</div>" + "".join(f"<p>{t}</p>" for t in ts) for ts in groups[-1]])
    assert many(spark, bodies) == [{i: " ".join(ts) for i, ts in enumerate(texts)} for texts in groups]


ARTICLE = "<article><h1>Title {0}</h1><p>text {0} goes on and on</p></article>"
LEGAL = [
    "<html><head><title>x</title><meta a><body><nav>home</nav>" + ARTICLE,
    "<html><head><title>x</title><link rel=a>" + ARTICLE,
    "<body class='post no-sidebar'><nav>home</nav>" + ARTICLE,
    "<body><nav>home</nav>" + ARTICLE.replace("<article>", "<article class='post category-social'>"),
    "<body><form action=x><nav>home</nav>" + ARTICLE + "</form>",
    "<body><form action=x><div><h1>Title {0}</h1><p>text {0} goes on and on</p></div></form><p>{0}</p>",
    "<body><nav>home</nav><article><h1 title=it's>Title {0}</h1><p class=it's>text {0} goes on and on</p></article>",
    "<body><nav>home</nav>" + ARTICLE.replace("</article>", "<div class='recommended'>See {0}</div><div class='signup-box'>Sign up</div></article>"),
    "<body><nav>home</nav>" + ARTICLE.replace("<p>", "<p class='lead share-price'>"),
]


def test_legal_pages_give_their_article(spark):
    rows = []
    for n, body in enumerate(LEGAL):
        rows += [(100 * n + i, f"http://h{n}.example/{i}", body.format(i)) for i in range(8)]
        rows += [(100 * n + 50, f"http://alone{n}.example", body.format(50))]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k, text in got.items():
        more = f" {k % 100}" if LEGAL[k // 100].startswith("<body><form action=x><div>") else ""
        assert text == f"Title {k % 100} text {k % 100} goes on and on{more}", LEGAL[k // 100]


def nothing_learned(host):
    return (host, '{"tree": "0 ", "constants": [], "overruled": [], "main": false, "outside": []}')


UNNAMED = (
    "<body><div><a href=/>Our site</a></div><div class=q{2}>Buy {1} now</div><div class=w><h1>Title {0}</h1><p>story {0} that goes on for long enough</p>"
    "<p>and has <a href=/>an end</a> that differs {0}</p></div><div><a href=/>next to {0} and {0}</a></div><div>Imprint</div>"
)


def test_wrappers_decide(spark, monkeypatch):
    """Of a host without a telling name: constants go, and so do what is filled from a stock of texts and lists of links."""
    bodies = [UNNAMED.format(i, i % 4, "x") for i in range(40)]
    want = {i: f"Title {i} story {i} that goes on for long enough and has an end that differs {i}" for i in range(40)}
    whole, two, one = many(spark, [bodies, bodies[:2], bodies[:1]])
    assert whole == want
    # Two pages are enough for what both have at one place; one isn't.
    assert two == {i: f"Buy {i} now {t}" for i, t in list(want.items())[:2]}
    assert one[0].startswith("Our site Buy 0 now Title 0 story 0")
    monkeypatch.setattr(pages, "induce", lambda p, marks: spark.createDataFrame([nothing_learned("h0.example")], "host string, wrapper string").coalesce(1))
    without = extracted(spark, bodies)
    assert without != want and without[7] == f"Our site Buy 3 now {want[7]} next to 7 and 7 Imprint"


def test_large_hosts_go_by_parts_and_rounds(spark, monkeypatch):
    bodies = [UNNAMED.format(i, i % 4, "x" if i % 3 else f"x y{i}") + f"<p class=own{chr(97 + i % 26)}>" for i in range(40)]
    want = extracted(spark, bodies)
    assert want[9] == "Title 9 story 9 that goes on for long enough and has an end that differs 9"
    for name, value in (("MERGE", 2), ("WRAPPER_BYTES", 0), ("HOST_ROWS", 3)):
        monkeypatch.setattr(pages, name, value)
    monkeypatch.setattr(pages, "fits", lambda df, limit=0: False)
    assert extracted(spark, bodies) == want


def test_trees_dont_grow_with_the_pages(spark):
    def wrapper(n):
        letters = lambda i: "".join(chr(97 + int(c)) for c in str(i))
        rows = [("h", f"<body><div id='post-{letters(i)}'><p class='k{letters(i)}'>text {i}</p><{letters(i)}>x</{letters(i)}></div>") for i in range(n)]
        return len(pages.induce(spark.createDataFrame(rows, "host string, html string")).head().wrapper)

    assert wrapper(400) < 1.2 * wrapper(120)


def test_deep_and_very_long_pages(spark):
    deep = "<div class=ad>" * 3000 + "</div>" * 3000 + "<div>" * 3000 + "<p>low {0}</p>"
    long = "<article><h1>T {0}</h1>" + "<p>many words in it {0}, again and again</p>" * 20_000 + "</article>"
    got = extracted(spark, [deep.format(0), deep.format(1), deep.format(2), long.replace("{0}", "3"), "<a href='" * 2000, None])
    assert [got[i] for i in range(3)] == ["low 0", "low 1", "low 2"] and len(got[3]) == len("T 3") + 20_000 * len(" many words in it 3, again and again")
    assert got[5] == ""


def articles(df):
    out = {}
    for r in df.collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        out[r.page_id] = words(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br|div|li|ul)\b[^>]*>", " ", article))))
    return out


def test_prepared_pages_match_their_articles(spark):
    """As they are, and, on hosts of their own, with a div in place of each article."""
    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html")
    plain = df.selectExpr("page_id + 1000000", "replace(url, 'example', 'plain')", "regexp_replace(html, '<(/?)article>', '<$1div>')")
    got = {r.page_id: r.text for r in pages.extract(df.union(plain).withColumn("text", F.lit("x"))).collect()}
    want = articles(df)
    assert got == want | {k + 1_000_000: t for k, t in want.items()}


def test_alignment_alone_finds_the_articles_of_large_hosts(spark):
    """Neither tags nor names: the adverts, menus and footers of the prepared pages are filled from a stock of forty texts."""
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").withColumn("host", pages.host_of())
    large = df.groupBy("host").count().where("count >= 70").select("host")
    df = df.join(large, "host", "left_semi")
    got, want = {r.page_id: r.text for r in pages.extract(df, marks=False).collect()}, articles(df)
    assert len(want) > 500 and sum(got[k] == want[k] for k in want) > 0.99 * len(want)
