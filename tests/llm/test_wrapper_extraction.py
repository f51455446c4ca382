import pytest

from voltaic.llm import wrapper_extraction as w


def text_of(html):
    return w.main_text(w.parse(html))


@pytest.mark.parametrize(
    "html,want",
    [
        ("<article><h1>T</h1><p>a  b\n c</p><p>d<br>e</p></article>", "T\n\na b c\n\nd e"),
        ("<p>one<p>two<b>x<p>three", "one\n\ntwox\n\nthree"),
        ("<nav><ul><li>menu</ul></nav><article><p>x &amp; y &eacute; &#x41;&nbsp;z</p><aside>no</aside></article><footer>f</footer>", "x & y é A z"),
        ("<header>site</header><article><header><h1>Title</h1></header><p>body</p><div class='comments'><p>first!</p></div><form>q</form></article>", "Title\n\nbody"),
        ("<div id=sidebar>s</div><div class='ad'>buy</div><main><p>text</p><section class='newsletter-signup'>mail</section></main>", "text"),
        ("<body><div class='cookie-notice'>ok?</div><p>plain</p><script>var t='</p>'</script><style>p{}</style></body>", "plain"),
        ("<article><ul><li>a<li>b</ul><table><tr><td>c<td>d</table><!-- <p>no</p> --><pre> e\n f </pre></article>", "a\n\nb\n\nc\n\nd\n\ne f"),
        ("<article>a<div>b</div>c</article><article class='comment'>no</article>", "a\n\nb\n\nc"),
        ("<article><p hidden>no</p><p style='display: none'>no</p><span class='ads'>no</span><p>yes</p></article>", "yes"),
        ("<article><p>I like banner ads and menus</p></article>", "I like banner ads and menus"),
        ("", ""),
        ("no tags at all &lt;b&gt;", "no tags at all <b>"),
        ("<article><p>open", "open"),
        ("<div><div><p>x</div></article></div><p>y <unknown>z</unknown>", "x\n\ny z"),
        ('<p title="a > b">q</p>', "q"),
        ("<article><p>1 < 2 and 3 > 2</p></article>", "1 < 2 and 3 > 2"),
    ],
)
def test_main_text(html, want):
    assert text_of(html) == want


def test_matching_aligns_in_order():
    a = w.skeleton(w.parse("<article><h1>x</h1><p>a</p><table><tr><td>1</table></article>"))
    b = w.skeleton(w.parse("<article><h1>y</h1><blockquote>q</blockquote><p>b</p><table><tr><td>2</table></article>"))
    tree, slots = w.induce([(1, 1, a.packed()), (2, 1, b.packed())])
    assert [s.label for s in tree.preorder()] == ["html", "article", "h1", "blockquote", "p", "table", "tr", "td"]
    assert slots == [[0, 1, 2, 4, 5, 6, 7], [0, 1, 2, 3, 4, 5, 6, 7]]
    assert w.Slot.unpacked(tree.packed()).packed() == tree.packed()


def deep(n, inner):
    return "<div>" * n + inner + "</div>" * n


def test_deep_pages_do_not_recurse(spark):
    assert text_of(deep(3000, "deep")) == "deep"
    rows = [(i, "http://h.example/", deep(5000, f"<p>one {i}</p><p>always</p>")) for i in range(6)]
    got = {r.page_id: r.text for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"one {i}" for i in range(6)}


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a "\'>', "<", "<p", "</p", "<!--", "</section>", "<td><blockquote>", "<p><td><blockquote>", "<script>", "&", "<a<", "<!"])
def test_a_megabyte_of_odd_markup_takes_linear_time(piece):
    import time

    took = []
    for n in (250_000, 1_000_000):
        html = "<p>x</p>" + piece * (n // len(piece)) + ("" if piece.startswith("<!") else "<p>y")
        start = time.process_time()
        text_of(html)
        took.append(time.process_time() - start)
    assert took[1] < 12 * took[0] + 1


@pytest.mark.parametrize("html", ["<p>x</p><div " + "a-" * 500_000 + "><p>y", "<p>x</p><textarea>" + "</textarea " * 90_000 + "<p>y", "<p>x</p><div " + "a = " * 250_000 + "><p>y", "<p>x</p><div " + "b" + " " * 1_000_000 + "><p>y"])
def test_a_megabyte_in_one_tag(html):
    import time

    start = time.process_time()
    text_of(html)
    assert time.process_time() - start < 2


PLAIN_PAGE = """<html><body><div><ul><li><a href=x>{nav1}</a></li><li><a href=y>{nav2}</a></li></ul></div><div>{ad}</div><div><h1>{title}</h1><p>{a}</p><p>{b}</p><p>{c}</p></div>
<div><ul><li>{side}</li></ul></div><div>{foot}</div></body></html>"""


def plain_pages(n):
    """Pages without any tag or class that tells; menu, advert, side and foot vary from page to page."""
    own = [{k: " ".join(f"{k}{i}w{j}" for j in range(m)) for k, m in (("nav1", 1), ("nav2", 1), ("ad", 9), ("title", 6), ("a", 40), ("b", 30), ("c", 20), ("side", 5), ("foot", 7))} for i in range(n)]
    return [(i, f"http://plain.example/{i}", PLAIN_PAGE.format(**x)) for i, x in enumerate(own)], [f"{x['title']}\n\n{x['a']}\n\n{x['b']}\n\n{x['c']}" for x in own]


@pytest.mark.parametrize("partitions,sent", [(1, w.SENT), (7, w.SENT), (40, 0)])
def test_the_template_alone_finds_the_article(spark, monkeypatch, partitions, sent):
    rows, want = plain_pages(60)
    monkeypatch.setattr(w, "SENT", sent)  # 0: pages go to their host's template
    monkeypatch.setattr(w, "TOGETHER", 10)
    got = {r.page_id: r.text for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(partitions)).collect()}
    assert got == dict(enumerate(want))
    assert all(text_of(html) != want[i] for i, _, html in rows)  # the marks alone don't


def test_pages_of_other_shape_fall_back_to_marks(spark):
    rows, want = plain_pages(20)
    rows.append((99, "http://plain.example/about", "<main><section><p>About us</p></section></main><nav>no</nav>"))
    got = {r.page_id: r.text for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want)) | {99: "About us"}


def test_weak_marks_need_the_pages_to_agree(spark):
    """A block called social is content on the one page that has it; one that every page has, or one of links, is not."""
    base = "<article><h1>T{0}</h1><p>{1}</p>{2}<div class='related'>see {0}</div></article>"
    rows = []
    for i in range(20):
        extra = "<div class='social-science'><p>A study of society</p></div>" if i == 3 else "<div class='search'><p><a href=z>more like this</a></p></div>" if i == 4 else ""
        rows.append((i, "http://weak.example/", base.format(i, " ".join(f"w{i}x{j}" for j in range(30)), extra)))
    got = {r.page_id: r.text.split("\n\n") for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(len(got[i]) == (3 if i == 3 else 2) for i in range(20)) and got[3][2] == "A study of society"


def test_a_form_around_the_page_and_a_long_comment_section(spark):
    rows, want = [], []
    for i in range(12):
        words = [f"w{i}x{j}" for j in range(40)]
        comments = "".join(f"<li><p>comment {i} {k} {' '.join(words[:9])}</p></li>" for k in range(30))
        rows.append((i, "http://form.example/", f"<form id=page><div class=top>{i} menu</div><div class=text><h2>t{i}</h2><p>{' '.join(words)}</p></div><div class=comments><ol>{comments}</ol></div></form>"))
        want.append(f"t{i}\n\n{' '.join(words)}")
    got = {r.page_id: r.text for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict(enumerate(want))


def test_constant_texts_are_template(spark, odd):
    page = "<html><body><article><p>Read our terms</p><h1>T{0}</h1><p>Body {0} text</p><p>More {0}</p></article></body></html>"
    rows = [(i, "http://h.example/1", page.format(i)) for i in range(12)] + [(20 + i, "http://copies.example/1", page.format("same")) for i in range(6)]
    rows += [(30, None, None), (31, "http://h.example/2", ""), (None, "http://solo.example/", page.format("s")), (0, "http://h.example/1", page.format(0))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as salt", "'y' as template", "2 as shape").repartition(3)
    got = {(r.page_id, r.url): r for r in w.query(spark, pages).collect()}
    assert w.query(spark, pages).count() == len(rows)
    assert got[3, "http://h.example/1"].text == "T3\n\nBody 3 text\n\nMore 3"
    assert got[22, "http://copies.example/1"].text == "Read our terms\n\nTsame\n\nBody same text\n\nMore same"  # copies of one page are no template
    assert got[None, "http://solo.example/"].text.startswith("Read our terms")
    assert got[30, None].text == "" and got[30, None].n_chars == 0
    assert w.query(spark, pages.limit(0)).count() == 0


@pytest.mark.parametrize("varying,fixed", [(10, 1), (30, 1), (2, 25)])
def test_every_text_of_a_node_is_counted(spark, varying, fixed):
    """One node holds texts of all pages, one that is on 58 %, one that is on 62 %, and many that vary."""
    rows = []
    for i in range(100):
        own = [f"constant {k}" for k in range(fixed)] + [f"page {i} text {k}" for k in range(varying)] + ["less"] * (i < 58) + ["more"] * (i >= 38)
        rows.append((i, f"http://h.example/{i}", "<article>" + "".join(f"<p>{x}</p>" for x in own) + "</article>"))
    got = {r.page_id: r.text.split("\n\n") for r in w.query(spark, spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    for i in range(100):
        assert got[i] == [f"page {i} text {k}" for k in range(varying)] + ["less"] * (i < 58)


def table(a, b):
    """Size of the largest matching by the square table."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, (x, p) in enumerate(a):
        for j, (y, q) in enumerate(b):
            size[i + 1][j + 1] = max(size[i][j + 1], size[i + 1][j], size[i][j] + 1 + table(p, q) if x == y else 0)
    return size[-1][-1]


def slot(kids, label="html"):
    out = w.Slot(label)
    out.kids = [slot(own, name) for name, own in kids]
    return out


def test_matching_is_the_largest_at_every_size():
    import random

    rng = random.Random(3)

    def tree(n, depth):
        return [(rng.choice("abcd"), tree(rng.randrange(3), depth - 1) if depth else []) for _ in range(n)]

    for _ in range(60):
        a, b = tree(rng.randrange(12), 2), tree(rng.randrange(12), 2)
        matching, x, y = w.Matching(), slot(a), slot(b)
        pairs = matching.pairs(x, y)
        assert matching.size(x, y) == table(a, b) == sum(1 + table(a[i][1], b[j][1]) for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:])) and all(a[i][0] == b[j][0] for i, j in pairs)
    # One optional element whose label comes again only at the end; and a difference 100 levels down.
    long = [("p", []), ("ul", [])] * 300
    assert w.Matching().size(slot([("h2", []), *long]), slot([*long, ("h2", [])])) == 600
    a, b = [("q", []), ("p", [])], [("p", []), ("q", []), ("p", [])]
    for _ in range(100):
        a, b = [("div", a)], [("div", b)]
    assert w.Matching().size(slot(a), slot(b)) == 102
