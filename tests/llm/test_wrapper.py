import html
import re

import pytest

from threadloom.llm.wrapper import align, extract, grow, induce, main_text, matched, op9_wrapper_induction, parse, walk

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{{}}</style><script>var x="</p><article>no</article>";</script></head>
<body class="home"><header><a href=/>Site</a></header><nav><ul><li>Menu {n}<li>Two</ul></nav>
<div class="cookie-notice">We use cookies {n}</div><div class="ad">Buy {n}</div>
<main><article><header><h1>Title&nbsp;{n} &amp; more</h1></header><p>First <b>bold</b>
 para&#233; {n}<br>line<p>Second &lt;tag&gt; {n}
<form><input name=q> Search {n}</form><ul><li>One {n}</li><li>Two</li></ul>
<section id="comments"><p>Reader says {n}</p></section></article></main>
<aside>Side {n}</aside><footer>&copy; {n}</footer></body></html>"""


def test_parts_of_a_page():
    want = "Title {n} & more\nFirst bold paraé {n} line\nSecond <tag> {n}\nOne {n}\nTwo"
    assert extract(parse(PAGE.format(n=1))) == want.format(n=1)
    assert extract(parse("")) == extract(parse("<!-- only -->")) == extract(parse("<script>x")) == ""
    assert extract(parse("a < b <p>x</i></div>y")) == "a < b\nx\ny"
    assert extract(parse("plain text")) == "plain text"
    assert extract(parse("<div class='page has-sidebar'><div class=sidebar>x</div><article><p>y</p><div class=share>z</div></article></div>")) == "y"
    assert extract(parse("<div hidden><p>x</p></div><div role=navigation>n</div><p>y")) == "y"


def test_matching_is_the_largest():
    a, b = parse("<div><p>1</p><h2>x</h2><p>2</p></div>"), parse("<div><h2>y</h2><p>3</p><table></table></div>")
    size, pairs = matched(a, b)
    assert size == 4
    assert [x.label for x, _ in pairs] == [y.label for _, y in pairs]
    grow(a, b)
    assert [n.label for n in walk(a)] == ["#", "div", "p", "h2", "p", "table"]
    data = induce(["<div><p>1</p></div>", "<div><p>1</p><table></table></div>"])
    assert [n.at for n in walk(align(data, "<div><p>x</p><hr></div>"))] == [0, 1, 2, -1]


def unlike(rng, n, depth=2):
    """Blocks of many shapes, so that none melts into another."""
    inner = lambda: unlike(rng, rng.randint(0, 4), depth - 1) if depth else "x"
    return "".join(f"<{t} class=c{rng.randint(0, 3)}>{inner()}</{t}>" for t in rng.choices(["div", "section", "h2", "blockquote"], k=n))


@pytest.mark.parametrize("known", [3, 1 << 18])
def test_a_match_is_the_same_at_any_number_of_pairs(monkeypatch, known):
    import random

    from threadloom.llm import wrapper

    rng = random.Random(7)
    pages = [(parse(unlike(rng, n)), parse(unlike(rng, m))) for n, m in [(1, 9), (7, 5), (30, 40), (90, 60)] * 4]
    pages.append((parse("<div>" * 190 + "<p>x</p><h2>y</h2>"), parse("<div>" * 190 + "<h2>z</h2><p>x</p>")))
    monkeypatch.setattr(wrapper, "KNOWN_SIZES", known)
    found = {}
    for many in (0, 20, 100_000):
        monkeypatch.setattr(wrapper, "MANY_PAIRS", many)
        found[many] = [(size, [(id(a), id(b)) for a, b in pairs]) for size, pairs in (matched(a, b) for a, b in pages)]
    assert found[0] == found[20] == found[100_000]
    assert all(size == len(pairs) for size, pairs in found[0])


def test_matching_of_very_many_children_is_the_largest():
    # 60 headings before the paragraphs that both pages have: no child's twin is near
    rows = [f"<p class=r{i}>x</p>" for i in range(400)]
    a, b = parse("".join(rows)), parse("".join(f"<h2 class=n{i}>y</h2>" for i in range(60)) + "".join(rows))
    assert matched(a, b)[0] == matched(b, a)[0] == 401


def test_constant_nodes_without_telling_names_are_template(spark):
    page = "<html><body><div class=top><p>Our site, since 1999</p></div><div class=x7><h2>Story {n}</h2><p>Text {n}</p></div><div class=y9><p>All rights</p></div></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(8)] + [(20, "http://one.example/", page.format(n=20)), (21, None, None), (22, "bad url", ""), (5, "http://h.example/5", page.format(n=5))]
    df = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, host int")
    got = {r.page_id: r for r in main_text(df).collect()}
    assert main_text(df).count() == len(rows)
    assert all(got[i].text == f"Story {i}\nText {i}" for i in range(8))
    assert got[20].text == "Our site, since 1999\nStory 20\nText 20\nAll rights"  # one page tells no template
    assert (got[21].text, got[22].text, got[3].n_chars) == ("", "", len("Story 3\nText 3"))
    assert main_text(df.limit(0)).count() == 0
    assert {r.page_id: r.text for r in main_text(df, broadcast_bytes=0).collect()} == {i: r.text for i, r in got.items()}


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 9))) for _ in range(n)).capitalize() + "."


def unnamed(rng, i, site):
    """A page without <article>, <main> and telling names, of which only other pages tell what is what; and its main text."""
    menu = "".join(f'<li><a href="/{k}">{words(rng, 1)}</a></li>' for k in range(rng.randint(3, 7)))
    blocks = [("h1", words(rng, 5))] + [("p", words(rng, rng.randint(3, 60))) for _ in range(rng.randint(1, 8))]
    if i % 3 == 0:
        blocks += [("h2", words(rng, 3)), ("p", words(rng, 30)), ("h2", words(rng, 3)), ("p", words(rng, 20))]
    if i % 5 == 0:
        blocks.insert(2, ("blockquote", words(rng, 12)))
    body = "".join(f"<{t}>{x}</{t}>" for t, x in blocks)
    page = f"""<html><body><div class=q1><p>{site}</p><ul>{menu}</ul></div><div class=q2><p>{words(rng, 12)}</p></div>
<div class=q3><div class=q4>{body}</div><div class=q5><p>Part of {site}</p><p>{words(rng, 2)}</p></div></div>
<div class=q6>&copy; {site} {words(rng, 6)}</div></body></html>"""
    return page, "\n".join(x for _, x in blocks)


def test_pages_without_telling_names(spark):
    import random

    rng = random.Random(4)
    pages = [(h * 100 + i, f"http://{h}.example/{i}", *unnamed(rng, i, f"Site number {h}")) for h in range(6) for i in range(20)]
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    got = {r.page_id: r for r in main_text(df).collect()}
    assert {r.decided_by for r in got.values()} == {"wrapper"}
    assert [i for i, _, _, want in pages if got[i].text != want] == []
    alone = main_text(df.where("page_id % 100 < 2")).collect()
    assert {r.decided_by for r in alone} == {"names"}  # two pages show no template


def test_deep_and_long_pages(spark):
    deep = "<div>" * 3000 + "<p>at the bottom" + "</div>" * 3000
    formed = "<div>" * 250 + "<form><div><p>hidden</p></div></form><p>shown"
    long = "<article>" + "".join(f"<h2>t{i}</h2><p>x{i}</p><ul><li>y{i}</li></ul>" for i in range(3000)) + "</article>"
    df = spark.createDataFrame([(i, f"http://d.example/{i}", h) for i, h in enumerate([deep, formed, long, long.replace("x", "z")])], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in main_text(df).collect()}
    assert (got[0], got[1]) == ("at the bottom", "shown")
    assert got[2].split("\n") == [f"{c}{i}" for i in range(3000) for c in "txy"]


def test_patterns_of_siblings_fold():
    assert [n.label for n in walk(parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p><p>e</p><h2>f</h2>"))] == ["#", "h2", "p", "h2"]
    assert extract(parse("<h2>a</h2><p>b</p><h2>c</h2><p>d</p>")) == "a\nb\nc\nd"


def test_copies_of_an_article_are_no_template(spark):
    df = spark.createDataFrame([(i, "http://h.example/x", PAGE.format(n=0)) for i in range(6)], "page_id long, url string, html string")
    assert {r.text for r in main_text(df).collect()} == {extract(parse(PAGE.format(n=0)))}


COPY = """<html><body><nav><p>Menu {n}</p></nav><div class="ad">Buy {n}</div>{open}<p>Printed on day {n}</p><h2>A story told again</h2>
<p>This is the body of an article that a host carries many times over, each time beside another menu.</p>
<table><tr><td>Only this article has a table of results</td></tr></table>{close}<footer>{n}</footer></body></html>"""
BODY = "A story told again\nThis is the body of an article that a host carries many times over, each time beside another menu.\nOnly this article has a table of results"


@pytest.mark.parametrize("copies", [3, 20, 1000])
def test_near_copies_with_other_menus_keep_their_article(spark, copies):
    rows = []
    for host, start, end in (("in", "<article>", "</article>"), ("out", "<div class=x>", "</div>")):
        rows += [(len(rows) + i, f"http://{host}.example/{i}", COPY.format(n=i, open=start, close=end)) for i in range(copies)]
        # two thirds of this host's pages are other articles, without the table
        rows += [(len(rows) + i, f"http://mixed-{host}.example/{i}", COPY.format(n=i, open=start, close=end)) for i in range(copies)]
        other = f"<html><body><nav><p>Menu</p></nav>{start}<p>Printed on day {{n}}</p><h2>Title {{n}}</h2><p>{'Another text ' * 20}{{n}}</p>{end}<footer>f</footer></body></html>"
        rows += [(len(rows) + i, f"http://mixed-{host}.example/o{i}", other.format(n=i)) for i in range(2 * copies)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for r in main_text(df).collect():
        if "/o" not in r.url:
            assert r.text == f"Printed on day {r.url.rsplit('/', 1)[1]}\n{BODY}", r.url


def about(rng, i, host):
    return f"{words(rng, 30)} {host} {i}"


def ordinary(rng, i, host):
    """Pages that the plain look of an article makes hard, by name; and their main text."""
    lead, one, two, end, title = about(rng, i, host), about(rng, i, host), about(rng, i, host), about(rng, i, host), words(rng, 5)
    frame = "<html><body><div class=menu><a href=/>Home</a></div>{}<div class=foot><p>Page made in {}</p></div></body></html>"
    foot = words(rng, 3)
    return {
        "lead": (frame.format(f"<article><h1>{title}</h1><p class=lead>{lead}</p><div class=body><p>{one}</p><p>{two}</p></div><p class=end>{end}</p></article>", foot), [title, lead, one, two, end]),
        "refs": (frame.format(f"<article><h1>{title}</h1><p>{one}</p><ul><li>See <a href=/x>{lead}</a></li><li>See <a href=/y>{end}</a></li></ul></article>", foot), [title, one, f"See {lead}", f"See {end}"]),
        "flat": (f"<html><body><ul><li><a href=/>Home</a></li></ul><h1>{title}</h1><p>{one}</p><p>{two}</p><div class=x1><p>{words(rng, 9)}</p></div><div class=x2><p>{words(rng, 6)}</p></div></body></html>", [title, one, two]),
        "attributes": (frame.format(f'<article><h1>{title}</h1><p title="hidden gems">{one}</p><p data-id="comment-5" aria-hidden="false">{two}</p><section class="social-history"><p>{end}</p></section><div class="share-buttons">Tweet</div></article>', foot), [title, one, two, end]),
        "constant": (frame.format(f"<article><h1>{title}</h1><p>All figures are in euros.</p><p>{one}</p></article>", foot), [title, "All figures are in euros.", one]),
        "post": (frame.format(f"<div class=post><h1>{title}</h1><p class=lead>{lead}</p><div class=body><p>{one}</p><p>{two}</p><p>{two}</p></div><p>{end}</p></div>", foot), [title, lead, one, two, two, end]),
    }


@pytest.mark.parametrize("n", [3, 6, 25, 300])
def test_articles_stay_whole_at_any_number_of_pages(spark, n):
    import random

    rng = random.Random(n)
    rows, want = [], {}
    for i in range(n):
        for name, (page, texts) in ordinary(rng, i, "site").items():
            want[len(rows)] = name, "\n".join(texts)
            rows.append((len(rows), f"http://{name}.example/{i}", page))
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [(want[r.page_id][0], r.text, want[r.page_id][1]) for r in got if r.text != want[r.page_id][1]] == []


def test_boilerplate_outside_of_articles_goes_and_what_is_inside_stays(spark):
    page = "<html><body><nav>Menu {n}</nav><div class=z>Read us daily</div><article><h1>Title {n}</h1><p>The text of page {n} is like no other text here.</p><p>By our staff</p></article></body></html>"
    rows = [(i, f"http://h.example/{i}", page.format(n=i)) for i in range(30)]
    rows += [(100 + i, "http://h.example/copy", page.format(n=7).replace("Menu 7", f"Menu {i}")) for i in range(15)]  # a third of the pages
    got = main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == 45
    assert all("Read us" not in r.text and "like no other" in r.text and r.text.endswith("By our staff") for r in got)


def brute(page):
    body = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", b))).split()) for b in re.split(r"</?(?:p|h1|div)\b[^>]*>", body))
    return "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("folder", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_op9_gives_the_articles(spark, folder):
    pages = {r.page_id: r for r in spark.read.parquet(f"{folder}/pages.parquet").collect()}
    rows = op9_wrapper_induction(spark, folder).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, brute(pages[r.page_id].html), len(r.text))
