import random

import numpy as np

from tests.llm.helpers import prose
from weft.llm import html as html_module
from weft.llm.html import blocks_of, longest_elsewhere, main_text, repeated_across_pages, suffix_array

PAGES = "page_id long, url string, html string"


def text_of(spark, html, url="http://a.example.com/x"):
    return main_text(spark.createDataFrame([(1, url, html)], PAGES)).first()["text"]


def test_article_without_what_surrounds_it(spark):
    page = """<!DOCTYPE html><html><head><title>T &amp; U</title><style>p{x:1}</style><script>var t="</p>";f("<p>no</p>");</script></head>
    <body class="has-sidebar menu"><header><h1>Site</h1></header><nav><ul><li><a href="/x">x</a></li></ul></nav><!-- <p>no</p> -->
    <div class="ad">buy</div><article><h1>T &amp; U</h1><p>One <b>two</b>&nbsp; three<br>four<p>Five &lt;six&gt; &#233;&#x1F642;
    <aside>by the way</aside><div class="cookie-notice"><p>We use cookies</p></div><form><input value=a>Mail</form>
    <ul><li>a<li>b</ul><pre>x
      y</pre><section class="comments"><p>first!</p></section></article>
    <div id="sidebar">side</div><footer>&copy; 2020</footer></body></html>"""
    assert text_of(spark, page) == "T & U\nOne two three four\nFive <six> é🙂\na\nb\nx y"


def test_marks_around_and_inside_an_article():
    page = """<div class="layout with-sidebar"><main><p>in</p><div class="sidebar">no</div></main></div>
    <section id="comments"><article>first!</article></section><article class="comment">second!</article>"""
    assert [t for t, a, o in blocks_of(page) if a and not o] == ["in"]


def test_broken_pages(spark):
    for html, text in [(None, ""), ("", ""), ("<", "<"), ("plain", "plain"), ("<article><p>a<p>b", "a\nb"), ("<article>a</p>b</div>c</article>x", "a\nb\nc"), ("<p>a<scr", "a"), ("<article><p>cut &am", "cut &am"), ("<p>5 < 6 and 7 > 3</p>", "5 < 6 and 7 > 3"), ("<article><script>never ends", "")]:
        assert text_of(spark, html) == text, html


def brute_repeated(tokens, page, depth):
    n, out = len(tokens), [False] * len(tokens)
    where = {}
    for i in range(n - depth + 1):
        where.setdefault(tuple(tokens[i : i + depth]), []).append(i)
    for places in where.values():
        if len({page[i] for i in places}) > 1:
            for i in places:
                out[i : i + depth] = [True] * depth
    return out


def test_suffix_array_against_brute_force():
    rng = random.Random(3)
    for _ in range(40):
        tokens, page = [], []
        for p in range(rng.randint(1, 6)):
            body = [rng.randint(1, 3) for _ in range(rng.randint(0, 40))]
            tokens += [*body, 100 + p]
            page += [p] * (len(body) + 1)
        t, p = np.array(tokens, np.uint64), np.array(page)
        for depth in (1, 2, 3, 5, 8):
            assert repeated_across_pages(t, p, depth).tolist() == brute_repeated(tokens, page, depth)
        suffixes, common = suffix_array(t)
        assert suffixes.tolist() == sorted(range(len(tokens)), key=lambda i: tokens[i:])
        share = lambda i, j: next((k for k, (x, y) in enumerate(zip(tokens[i:], tokens[j:])) if x != y), min(len(tokens) - i, len(tokens) - j))
        assert common.tolist() == [0] + [share(i, j) for i, j in zip(suffixes, suffixes[1:])]
        runs = longest_elsewhere(suffixes, common, p)
        assert runs.tolist() == [max((share(i, j) for j in range(len(tokens)) if page[j] != page[i]), default=0) for i in range(len(tokens))]


def test_host_boilerplate_goes_where_no_article_is_marked(spark):
    rng = random.Random(4)
    line = prose(rng, 30)
    body = [prose(rng, 40) for _ in range(12)]
    rows = [(i, f"https://www.host{i % 2}.example.com:80/{i}", f"<div>{line}</div><div>{b}</div>") for i, b in enumerate(body)]
    rows += [(50, "https://alone.example.com/", f"<div>{line}</div>"), (51, None, f"<div>{line}</div>")]
    # the same article on two pages of a host stays
    rows += [(i, "https://c.example.com/" + str(i), f"<article><p>{body[0]}</p></article>") for i in (60, 61)]
    found = {r["id"]: r for r in main_text(spark.createDataFrame(rows, PAGES)).collect()}
    assert len(found) == len(rows)
    assert all(found[i]["text"] == body[i] for i in range(12))
    assert found[50]["text"] == found[51]["text"] == line
    assert found[60]["text"] == found[61]["text"] == body[0]
    assert found[60]["n_repeated"] == 40 and found[0]["n_repeated"] == 30 and found[50]["n_repeated"] == 0


def test_odd_rows(spark):
    rows = [(None, "u", "<p>a</p>"), (1, None, None), (1, "u", "<p>b</p>"), (1, "u", "<p>b</p>")]
    out = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(r["text"] for r in out) == ["", "a", "b", "b"]
    assert main_text(spark.createDataFrame([], PAGES)).count() == 0
    assert blocks_of("<p>" + "y " * 200_000) == [("y " * 199_999 + "y", False, False)]


def test_copies_of_a_page_without_an_article_stay(spark):
    rng = random.Random(5)
    line, body, other = prose(rng, 30), prose(rng, 60), prose(rng, 60)
    page = f"<div>{line}</div><div>{body}</div>"
    rows = [(1, "https://a.example.com/x", page), (1, "https://a.example.com/x", page), (2, "https://a.example.com/x?utm_source=m", page.replace("<div>", "<div class='y'>"))]
    rows += [(4, "https://b.example.com/4", f"<div>{body}</div>"), (5, "https://b.example.com/5", f"<nav>{other}</nav><div>{body}</div>")]
    found = main_text(spark.createDataFrame(rows, PAGES)).collect()
    assert [r["text"] for r in found if r["id"] < 4] == [line + "\n" + body] * 3
    assert [r["text"] for r in found if r["id"] > 3] == [body] * 2
    # next to a page of other content, what both kinds share goes
    rows.append((3, "https://a.example.com/z", f"<div>{line}</div><div>{other}</div>"))
    found = main_text(spark.createDataFrame(rows, PAGES)).where("id < 4").collect()
    assert sorted(r["text"] for r in found) == sorted([body] * 3 + [other])


def test_parts_of_a_host_give_what_the_whole_host_gives(spark, monkeypatch):
    rng = random.Random(6)
    lines = [prose(rng, 30) for _ in range(6)]
    rows = []
    for i in range(40):
        # each line is on two or three of 40 pages
        some = "".join(f"<div>{line}</div>" for k, line in enumerate(lines) if i % 16 == k)
        rows.append((i, f"https://big.example.com/{i}", f"{some}<div>{prose(rng, 25)}</div>"))
    rows += [(40, "https://big.example.com/0?copy", rows[0][2]), (41, "https://other.example.com/", f"<div>{lines[5]}</div>"), (42, "https://big.example.com/n", None)]
    pages = spark.createDataFrame(rows, PAGES)
    whole = sorted(map(tuple, main_text(pages).collect()))
    monkeypatch.setattr(html_module, "HOST_PAGES", 2)
    assert sorted(map(tuple, main_text(pages).collect())) == whole
    assert all(not any(line in text for line in lines) for i, _, text, _ in whole if i < 41)


def test_attributes_as_a_browser_reads_them():
    kept = lambda page: [t for t, _, out in blocks_of(page) if not out]
    assert kept("<article><p title=it's>Hello..</p>..<p>don't stop</p></article>") == ["Hello..", "..", "don't stop"]
    assert kept('<p title="a > b">x</p><p title=\'c > "d"\'>y</p><p a\'b>z</p>') == ["x", "y", "z"]
    assert kept('<div CLASS = ad>x</div><div class=a/ad>y</div><div data-class="ad">z</div><div class="p" class="ad">v</div>') == ["z", "v"]
    assert kept("<article><div class='share-price'>12</div><div class=share-bar>no</div><div class=authorComments>no</div></article>") == ["12"]
    assert kept("<div role='main'>in</div><div>out</div>")[0] == "in" and blocks_of("<div role='main'>in</div>")[0][1]
    assert kept("<p>a b　c d</p>") == ["a b c d"]
    assert kept("<p>a<b class='>x</p><p>y'>z</p>") == ["az"]
    # many tags that never end
    assert kept("x" + "<a title='" * 50_000) == ["x"] and kept("<" * 50_000) == ["<" * 50_000]


def test_names_of_comments_notices_and_hidden_elements(spark):
    page = """<main><p>in</p><ol class="commentlist"><li>no</ol><div class="user-feedback">no</div><div class=cookiebar>no</div><div class=disclaimer>no</div>
    <ul class="toc"><li>no</ul><div style="color:red; display: none">no</div><p style="display:block">yes</p></main>
    <section class="more-stories"><article><p>no</p></article></section><section class="commentary"><article>too</article></section>"""
    assert [t for t, a, o in blocks_of(page) if a and not o] == ["in", "yes", "too"]
    assert blocks_of("<p>&am<b>p;</b> &lt;</p>")[0][0] == "&amp; <"


def edge_pages(rng, n, copies=0):
    """Pages of articles between a notice and a tail that no name gives away, a table and a classed box of their own, and their texts."""
    notice, tail = prose(rng, 20), prose(rng, 26)
    rows, texts = [], []
    for i in range(n):
        title, table, box = prose(rng, 4), prose(rng, 15), prose(rng, 15)
        body = [prose(rng, 50) for _ in range(4)]
        html = f"<article><div class='q{i}'>{notice}</div><h1>{title}</h1>" + "".join(f"<p>{b}</p>" for b in body) + f"<table><tr><td>{table}</table><div class=k>{box}</div><div><span>{tail}</span></div></article>"
        rows.append((i, f"https://edge.example.com/{i}", f"<nav>{notice} {tail}</nav>{html}"))
        texts.append("\n".join([title, *body, table, box]))
    return rows, texts, notice, tail


def brute_edges(pages):
    """The texts of pages of one host by holding every run of 12 words at the edges of an article against those of all others."""
    def runs(blocks, zone, which):
        out, stretch = [], []
        for (text, *_), z in [*zip(blocks, zone), (("",), None)]:
            if z == which:
                stretch += text.split(" ")
            elif stretch:
                out.append(stretch)
                stretch = []
        return [tuple(x[i : i + 12]) for x in out for i in range(len(x) - 11)]

    parsed = [html_module.placed_blocks(p or "") for p in pages]
    zoned = [html_module.zones(x) for x in parsed]
    content = ["\n".join(b[0] for b, good in zip(x, html_module._wanted(x)) if good) for x in parsed]
    out = []
    for i, (blocks, zone) in enumerate(zip(parsed, zoned)):
        others = [j for j in range(len(pages)) if content[j] != content[i]]
        edge, body = ({r for j in others for r in runs(parsed[j], zoned[j], z)} for z in (html_module.EDGE, html_module.BODY))
        mine = runs(blocks, zone, html_module.BODY)
        own_body = len(mine) > 0 and 2 * sum(r in body for r in mine) < len(mine)
        words = [(w, k) for k, (b, z) in enumerate(zip(blocks, zone)) if z == html_module.EDGE for w in b[0].split(" ")]
        hit = [False] * len(words)
        for a in range(len(words) - 11):
            if tuple(w for w, _ in words[a : a + 12]) in edge:
                hit[a : a + 12] = [True] * 12
        share = lambda k: sum(x for x, (_, b) in zip(hit, words) if b == k) / max(1, sum(b == k for _, b in words))
        out.append("\n".join(b[0] for k, (b, good) in enumerate(zip(blocks, html_module._wanted(blocks))) if good and not (own_body and share(k) >= 0.5)))
    return out


def test_only_the_array_tells_the_edges_of_articles(spark, monkeypatch):
    rng = random.Random(8)
    rows, texts, notice, tail = edge_pages(rng, 10)
    # near copies of an article without boilerplate keep what they share, whatever its place
    base = [prose(rng, 50) for _ in range(5)]
    quote = prose(rng, 30)
    for i in range(20, 24):
        body = [*base[:2], prose(rng, 50), *base[3:]]
        rows.append((i, f"https://edge.example.com/{i}", f"<article><h1>same</h1><blockquote class=b>{quote}</blockquote>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"))
        texts.append("\n".join(["same", quote, *body]))
    # a line that articles share in their body stays, and so does what is at the edge of one article alone
    line = prose(rng, 25)
    for i in range(30, 33):
        body = [prose(rng, 60), line, prose(rng, 60)]
        rows.append((i, f"https://edge.example.com/{i}", "<article>" + "".join(f"<p>{b}</p>" for b in body) + "</article>"))
        texts.append("\n".join(body))
    rows.append((40, "https://other.example.com/", rows[0][2]))
    texts.append(notice + "\n" + texts[0] + "\n" + tail)
    pages = spark.createDataFrame(rows, PAGES)
    result = lambda: [r["text"] for r in main_text(pages).orderBy("id").collect()]
    assert result() == texts
    assert brute_edges([r[2] for r in rows[:-1]]) == texts[:-1]
    monkeypatch.setattr(html_module, "HOST_PAGES", 3)
    assert result() == texts


def test_every_run_of_a_body_counts(spark, monkeypatch):
    rng = random.Random(10)
    notice, tail = prose(rng, 13), prose(rng, 12)
    shared = prose(rng, 120).split(" ")
    rows, short = [], []
    for i in range(40):
        # short bodies, and those that share a little less or more than half of their runs with others
        own = prose(rng, rng.randint(16, 40) if i % 2 else rng.randint(105, 120)).split(" ")
        body = " ".join(own if i % 2 else own + shared)
        # what stands at the edge of one article is the body of another one, which makes it no edge of others
        edge = " ".join(shared[:15]) if i == 7 else notice
        rows.append((i, f"https://runs.example.com/{i}", f"<article><div class=n>{edge}</div><h1>t{i}</h1><p>{body}</p><ul><li>{tail}</ul></article>"))
        if i % 2 and i != 7:
            short.append((i, f"t{i}\n{body}"))
    expected = brute_edges([r[2] for r in rows])
    assert all(expected[i] == text for i, text in short) and any(notice in x for x in expected)
    pages = spark.createDataFrame(rows, PAGES)
    for n in (512, 3):
        monkeypatch.setattr(html_module, "HOST_PAGES", n)
        assert [r["text"] for r in main_text(pages).orderBy("id").collect()] == expected


def test_repeated_runs_count_over_the_whole_host(spark, monkeypatch):
    rng = random.Random(11)
    lines = [prose(rng, 30) for _ in range(5)]
    rows = []
    for i in range(30):
        # each line is on six pages; every third page has no article, and copies of a page are one content
        own, line = prose(rng, 40), lines[i % 5]
        html = f"<div>{line}</div><div>{own}</div>" if i % 3 == 0 else f"<nav>{line}</nav><article><p>{own}</p></article>"
        rows += [(i, f"https://host.example.com/{i}", html)] + [(100 + i, f"https://host.example.com/{i}?copy", html)] * (i % 7 == 0)
    # a line that only a page without an article and one with an article have
    last = prose(rng, 20)
    rows += [(200, "https://host.example.com/200", f"<div>{last}</div><div>{lines[0]} {prose(rng, 30)}</div>"), (201, "https://host.example.com/201", f"<article><p>{prose(rng, 30)}</p></article><footer>{last}</footer>")]
    streams = [[*" ".join(b[0] for b in blocks_of(html)).split(" "), f"page {k}"] for k, (*_, html) in enumerate(rows)]
    hit = iter(brute_repeated([w for x in streams for w in x], [k for k, x in enumerate(streams) for _ in x], 12))
    repeated = [sum([next(hit) for _ in x]) for x in streams]
    pages = spark.createDataFrame(rows, PAGES)
    monkeypatch.setattr(html_module, "BUCKET_PAGES", 5)
    monkeypatch.setattr(html_module, "HELD_RUNS", 300, raising=False)
    whole = None
    for n in (512, 3):
        monkeypatch.setattr(html_module, "HOST_PAGES", n)
        found = sorted(map(tuple, main_text(pages).collect()))
        assert [r[3] for r in found] == [k for _, k in sorted(zip([r[0] for r in rows], repeated))]
        assert not any(line in text for line in [*lines[1:], last] for _, _, text, _ in found)
        whole = whole or found
        assert found == whole
