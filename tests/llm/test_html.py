import html
import math
import re

from kmerloom.llm import html_text


def test_generated_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r["page_id"]: r["html"] for r in pages.collect()}
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.main_text(pages).collect()}
    assert set(got) == set(source)
    for i, h in source.items():
        article = re.search(r"<article>(.*?)</article>", h, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[i] == ("\n".join(w for w in want if w), len(got[i][0]))


P = "Some sentences of running text that tell a story, one after the other, without any links at all. " * 3
CLUTTER = '<header>Site</header><nav><ul><li><a href=/>Home</a></li></ul></nav><div class="cookie-notice">We use cookies to make this site work for everyone</div><form><p>Search here</p><input></form><aside>Other stories that are long enough to look like text, but are not</aside>'


def test_article_without_landmarks():
    page = f"<html><head><title>T</title><style>p {{}}</style></head><body>{CLUTTER}<div id=main><h1>Title</h1><p>{P}<p>Tom &amp;amp; Ann&nbsp;<b>said</b>\n so<br>twice</p><script>if (a < b) {{ document.write('</p>') }}</script><ul><li>one<li>two</ul></div><div class='comments'><p>{P}</p></div><footer>&copy; me</footer>"
    assert html_text.extract(page) == "\n".join(["Title", " ".join(P.split()), "Tom &amp; Ann said so twice", "one", "two"])


def test_landmark_and_comments():
    page = f"<body>{CLUTTER}<main><article><header><h1>T</h1></header><p>Short.</p></article><section id=comments><p>{P}</p></section></main></body>"
    assert html_text.extract(page) == "T\nShort."


def test_odd_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>"), (4, "u", "just text"), (5, "u", "<div>a<div>b</div>c"), (6, "u", "<p>a<!-- open"), (None, "u", "<p>x &#233; &lt;b&gt; &bogus;</p></p></div>"), (7, "u", "<nav>only a menu</nav>"), (8, "u", "<table><tr><td>a<td>b</table>"), (9, "u", "a < b <c"), (10, "u", "<div>" * 3000 + "deep"), (1, "u", None)]
    pages = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r["page_id"] or 0), r["text"]) for r in html_text.main_text(pages).collect())
    assert got == sorted([(1, ""), (1, ""), (2, ""), (3, ""), (4, "just text"), (5, "a\nb\nc"), (6, "a"), (0, "x é <b> &bogus;"), (7, ""), (8, "a\nb"), (9, "a < b <c"), (10, "deep")])
    assert html_text.main_text(pages.limit(0)).count() == 0


def test_density_sums_choose_whatever_the_landmarks():
    text = " ".join(P.split())
    card = "<article><h2><a href=/x>Other story</a></h2><p>A teaser of <a href=/y>two lines</a></p></article>"
    assert html_text.extract(f"<body>{card}<div><h1>Title</h1>{f'<p>{P}</p>' * 4}</div></body>") == "\n".join(["Title"] + [text] * 4)
    assert html_text.extract(f"<main>{card}</main><div>{f'<p>{P}</p>' * 4}</div>") == "\n".join([text] * 4)
    two = f"<body><div><div><p>{P}</p><p>{P}</p></div><div><p>{P}</p><p>{P}</p><p>{P}</p></div></div>{card}</body>"
    assert html_text.extract(two) == "\n".join([text] * 5)
    assert html_text.extract(f"<body>{P}<div><p>{P}</p><p>{P}</p></div>the <b>end</b> of it. {P}") == "\n".join([text] * 3 + [f"the end of it. {text}"])
    assert html_text.extract(f"<article><section><p>Short one.</p></section><section>{f'<p>{P}</p>' * 8}</section></article>") == "\n".join(["Short one."] + [text] * 8)


def test_attributes_and_names_in_real_text():
    text = " ".join(P.split())
    for attributes in ('style="overflow:hidden"', 'title="a hidden gem"', 'data-x="hidden"', "data-class='ad'", 'data-id=ad', 'title="class=ad"', 'class="legal"', 'id="social"', "class='page has-sidebar'"):
        assert html_text.extract(f"<body><div {attributes}><p>{P}</p><p {attributes}>{P}</p></div><p>(c) me</p></body>").startswith(f"{text}\n{text}"), attributes
    for attributes in ("hidden", 'HIDDEN=""', "aria-hidden=true", 'role="navigation"', 'class="big ad"', 'title="x" id="ad"'):
        assert html_text.extract(f"<body><div {attributes}><p>{P}</p></div><div><p>Short.</p><p>Text.</p></div></body>") == "Short.\nText.", attributes
    parts = "".join(f'<section id="{n}"><h2 id="{n}-work">{n}</h2><p>{P}</p><p>{P}</p></section>' for n in ("related", "discussion", "responses", "cookies"))
    more = '<div class="tags"><a href=/a>one</a> <a href=/b>two</a></div><div class="rating">4 of 5</div><div class="comments"><p>' + P + "</p></div>"
    for page in (f"<article><h1>T</h1>{f'<p>{P}</p>' * 4}{parts}{more}</article>", f"<body><div class='legal social'><h1>T</h1>{f'<p>{P}</p>' * 4}{parts}{more}</div></body>"):
        assert html_text.extract(page).split("\n") == ["T"] + [text] * 4 + [x for n in ("related", "discussion", "responses", "cookies") for x in (n, text, text)], page
    assert html_text.extract(f"<div class='ad'><p>{P}</p></div>") == text


def naive(node):
    """chars, tags, link chars and link tags of a node, by walking all below it anew; cut and weightless parts don't count."""
    chars = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
    below = [naive(x) for x in node.items if not isinstance(x, str) and not x.cut and x.weight]
    c, t, lc, lt = (sum(b[i] for b in below) for i in range(4))
    if node.tag == "a":
        return c + chars, t + len(below), c + chars, t + len(below) + 1
    return c + chars, t + len(below), lc, lt


def holds(node):
    return any(not isinstance(x, str) and not x.cut and (x.tag in html_text.BLOCK or holds(x)) for x in node.items)


def naive_density(counts, share):
    c, t, lc, lt = counts
    if not c:
        return 0.0
    base = math.log(c / max(1, c - lc) * lc + share * c + math.e)
    of = max(c / (lc or 1) * (t or 1) / (lt or 1), 1.0)
    return c / (t or 1) * (math.log(of) / math.log(base) if base > 1 + 1e-9 else math.log(of + 1e-9))  # without links there is nothing to scale by


def test_densities_against_naive_tree(spark):
    """Every node's density, and the node with the largest sum of its children's densities, on pages whose articles are plain blocks."""
    pages = [re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"]) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").limit(60).collect()]
    for page in [*pages, f"<body>{CLUTTER}<div><h1>T</h1><p>{P}<a href=/x>linked words</a></p><ul><li><a href=/a>a</a></li></ul></div><div><p>{P}</p><p>{P}</p></div></body>"]:
        body = html_text.measure(html_text.parse(page))
        total = naive(body)
        share = total[2] / total[0]
        best, most = None, -1.0
        stack = [body]
        while stack:
            node = stack.pop()
            inside = [x for x in node.items if not isinstance(x, str) and not x.cut]
            assert math.isclose(node.density, naive_density(naive(node), share), rel_tol=1e-9), node.tag
            if holds(node) or node.tag in html_text.HOLDS:
                blocks = sum(naive_density(naive(x), share) * x.weight for x in inside if x.tag in html_text.BLOCK or holds(x))
                inline = [naive(x) for x in inside if not (x.tag in html_text.BLOCK or holds(x))]
                own = sum(len("".join(x.split())) for x in node.items if isinstance(x, str))
                run = (own + sum(n[0] for n in inline), sum(n[1] + 1 for n in inline), sum(n[2] for n in inline), sum(n[3] for n in inline))
                if (s := blocks + naive_density(run, share)) > most:
                    best, most = node, s
            stack += [x for x in inside if x.weight]
        assert body.peak is best


def test_renamed_landmarks_give_the_same_text(spark):
    for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect():
        assert html_text.extract(re.sub(r"<(/?)(article|main)\b", r"<\1div", r["html"])) == html_text.extract(r["html"])
