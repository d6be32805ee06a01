import random
import time

import pytest

from millrace.llm import html_text as H


def longest(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return table[-1][-1]


@pytest.mark.parametrize("bits", [1 << 28, 6])
def test_alignment_is_a_longest_common_subsequence(bits):
    rng = random.Random(1)
    for _ in range(1500):
        k = rng.randrange(1, 8)
        a, b = ([rng.randrange(k) for _ in range(rng.randrange(14))] for _ in range(2))
        places = H.common_lines(a, b, bits)
        rest = iter(b)
        assert places == sorted(set(places)) and len(places) == longest(a, b) and all(a[i] in rest for i in places)


def test_long_alignment():
    a = [i % 7919 for i in range(20_000)]
    assert len(H.common_lines(a, [-1, *a[1:10_000], -2, *a[10_000:]])) == 19_999


def text(page, shared=()):
    return H.main_text(H.lines(page), list(shared))[0]


def test_markup_that_is_plain():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head>
    <body><header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></ul></nav><div class="cookie-notice">We use <b>cookies</b></div>
    <article><header><h1>A &amp; B</h1></header><p>One<br>two  <b>three</b>&nbsp;four &lt;x&gt; &#233;<p>Five <!-- no --> six<div class="ad"><p>Buy</p></div>
    <form><input name=a><button>Go</button></form><ul><li>i</li><li>j</li></ul><script>1<2</script><section class="comments"><article><p>Nice!</p></article></section>
    <p>Last &am</article><aside>More</aside><footer>&copy; x</footer></body></html>"""
    assert text(page).split("\n") == ["A & B", "One two three four <x> é", "Five six", "i", "j", "Last &am"]


def test_odd_markup():
    assert text(None) == text("") == text("<p>") == ""
    assert text("plain") == "plain"
    assert text("a < b <p>c") == "a < b\nc"
    assert text('<article><p title="a>b">x</p>') == "x"
    assert text("<article><p class='y>x</p><p>z</p></article>") == "x\nz"
    assert text("<script>never closed") == ""
    assert text("<nav>menu <article><p>x</p></article>") == "x"
    assert text("<article><p>x</p><svg/><p hidden>no</p><p>y</p></article>") == "x\ny"
    long = "w " * 200_000
    assert text(f"<article><p>{long}</p></article>") == long.strip()


@pytest.mark.parametrize("unit", ['<a "', "<a '", '<a ">" ', "<a x=\"y>", "<", "<!--", "<a b", "<a a=", "</", "<script>", "<p hidden ", "&#", "<a \"'", "<![CDATA[", "<p class=a id=b ", "x "])
@pytest.mark.parametrize("end", ["", ">", "'>", '">'])
def test_time_in_proportion_to_the_page(unit, end):
    began = time.process_time()
    H.lines(unit * (1_000_000 // len(unit)) + end)
    assert time.process_time() - began < 5


def test_script_texts_are_no_markup():
    assert text('<article><script>var t="<a ";</script><p>x</p><SCRIPT>"</p>\'</Script ><p>"y"</p><style>a>b{}</style></article>') == 'x\n"y"'
    assert text('<article><p title="a > b" data-x=\'"\'>x</p><p hidden=until-found>y</p><p data-hidden="1">z</p></article>') == "x\ny\nz"


def test_names_of_whole_pages_and_titles():
    assert text('<div class="page no-sidebar"><p>x</p><div class="right sidebar-box">y</div></div>') == "x"
    assert text('<article><div class="post-header"><h1>t</h1></div><p>x</p><div class="share-links">s</div></article>') == "t\nx"


def page(body):
    return f"<html><body><div>Template head</div>{body}<div>Template foot</div></body></html>"


def test_alignment_decides_where_markup_does_not(spark):
    rows = [(k, f"http://h.example/{d}/{k}?q=1", page(f"<div>Own {k}</div><p>Also {k}</p>")) for k, d in ((1, "a"), (2, "a"), (3, "b"))]
    rows += [(4, "http://other.example/a/1", page("<div>Alone</div>")), (5, None, None), (6, "odd", ""), (None, "http://h.example/a/1", page("<p>No id</p>"))]
    rows += [(7, "http://h.example/c/7", page("<article><p>Template head</p><p>mine</p></article>"))]
    got = H.extract(spark, spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    assert [by[k].text for k in (1, 2, 3)] == [f"Own {k}\nAlso {k}" for k in (1, 2, 3)]
    assert by[4].text == "Template head\nAlone\nTemplate foot" and by[5].text == by[6].text == ""
    assert by[7].text == "Template head\nmine" and by[None].text == "No id"


def test_repeated_rows_and_empty(spark):
    same = [(1, "http://h/a", page("<p>x</p>"))] * 3 + [(2, "http://h/b", page("<p>y</p>"))]
    got = H.extract(spark, spark.createDataFrame(same, "page_id long, url string, html string").coalesce(1)).collect()
    assert len(got) == 4
    assert H.extract(spark, spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_runs_of_equal_pages_have_the_same_neighbours():
    rows = [{"host": h, "path": p, "marks": m, "page_id": k, "url": "", "states": b"", "body": b""} for k, (h, p, m) in enumerate([("a", "/1", b"x"), ("a", "/1", b"y"), ("a", "/2", b"y"), ("a", "/3", b"y"), ("a", "/4", b"z"), ("b", "/", b"z"), ("b", "/", b"z")])]
    got = [([p[0] for p in run["pages"]], run["first"], run["last"], before, after) for run, before, after in H.runs(rows)]
    assert got == [([0], "/1", "/1", None, ("/1", b"y")), ([1, 2, 3], "/1", "/3", ("/1", b"x"), ("/4", b"z")), ([4], "/4", "/4", ("/3", b"y"), None), ([5, 6], "/", "/", None, None)]


def test_copies_side_by_side_have_equal_texts(spark):
    rows = [(k, f"http://h.example/a/list?page={k}", page("<p>Copy</p>")) for k in range(1, 6)] + [(3, "http://h.example/a/list?page=3", page("<p>Copy</p>"))]
    rows += [(9, "http://h.example/a/other", page("<p>Other</p>"))]
    rows += [(20 + k, "http://lone.example/", page("<p>Alone</p>")) for k in range(3)]
    got = H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r.text for r in sorted(got, key=lambda r: r.page_id)] == ["Copy"] * 6 + ["Other"] + ["Template head\nAlone\nTemplate foot"] * 3


def by_order(rows):
    """The texts by the order of all pages, in plain Python."""
    rows = sorted(((u.split("/")[2], "/" + u.split("/", 3)[3].split("?")[0], k, u, H.lines(h)) for k, u, h in rows), key=lambda r: (r[:4], [t for t, _ in r[4]]))
    out = []
    for i, (host, path, k, _, own) in enumerate(rows):
        same = lambda j: 0 <= j < len(rows) and rows[j][0] == host and [t for t, _ in rows[j][4]] == [t for t, _ in own]
        a = next(j for j in range(i, -2, -1) if not same(j))
        b = next(j for j in range(i, len(rows) + 1) if not same(j))
        near = [(len(H.commonprefix([rows[j][1], rows[e][1]])), rows[j][4]) for j, e in ((a, a + 1), (b, b - 1)) if 0 <= j < len(rows) and rows[j][0] == host]
        other = max(near, key=lambda n: n[0])[1] if near else []
        out.append((k, H.main_text(own, H.common_lines([t for t, _ in own], [t for t, _ in other]))[0]))
    return sorted(out)


def test_texts_do_not_depend_on_the_ranges(spark):
    rng = random.Random(5)
    rows = []
    for k in range(300):
        host = rng.choice(["a.example"] * 6 + ["b.example", "c.example"])
        body = "<p>Copy</p>" if host == "b.example" or 100 <= k < 180 else "".join(f"<p>{rng.choice('uvwxyz')}</p>" for _ in range(rng.randrange(4)))
        rows.append((k, f"http://{host}/{k // 20}/{rng.choice(['list', 'item', k % 7])}?page={k}", page(body)))
    want, conf, old = by_order(rows), "spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in (1, 40):
            spark.conf.set(conf, parts)
            got = H.extract(spark, spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
            assert sorted((r.page_id, r.text) for r in got) == want
    finally:
        spark.conf.set(conf, old)
