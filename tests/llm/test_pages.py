import base64
import hashlib
import io
import random

import numpy as np
import pytest

from tramline.llm import base, pagediff, urldigest, warc

from .conftest import PAGES

ODD = [
    (1, "http://a.example/x/1", "<p>one<p>two", "t", "b"),
    (2, "http://a.example/x/1", "<p>one<p>two", None, None),
    (3, None, None, None, None),
    (4, "not a url", "", None, None),
    (None, "http://B.Example", "plain &amp; simple \x00 text", None, None),
    (5, "http://a.example/x/2\n", "<article><p>" + "long " * 50000 + "</article>", None, None),
    (5, "http://a.example/x/2\n", "<article><p>" + "long " * 50000 + "</article>", None, None),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, "u", None, None) for r in ODD], f"{PAGES}, _uid string, _digest string, host string")


def lcs_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def test_shared_lines_are_a_longest_common_subsequence(monkeypatch):
    rng = random.Random(3)
    for bits in (1 << 24, 20, 1):
        monkeypatch.setattr(pagediff, "TABLE_BITS", bits)
        for _ in range(300):
            a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 14))] for _ in range(2))
            shared = [x for x, s in zip(a, pagediff.lcs_shared(a, b)) if s]
            assert len(shared) == lcs_length(a, b) == lcs_length(shared, b)


def test_long_pages_are_aligned_in_linear_memory():
    import tracemalloc

    rng = random.Random(1)
    a = [str(i) for i in range(12_000)]
    b = a[:]
    for i in range(0, 12_000, 400):  # blocks moved about, so that ends don't match
        b[i : i + 400] = rng.sample(b[i : i + 400], 400)
    tracemalloc.start()
    shared = pagediff.lcs_shared(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 12_000_000 and 500 < sum(shared) < 12_000


def test_lines_of_a_page():
    page = """<html><body class="has-sidebar"><header><h1>Site</h1><nav><ul><li>a</ul></nav></header><div id=cookie-notice>ok?</div>
    <main><article class="post"><h1>T &amp; x</h1><p>One
     two<p>Three <b>four</b><br>five <button>no</button>six<ul><li>a<li>b</ul><form><p>mail</form><aside>q</aside><div class="comments"><article><p>nice</article></div></article>
    <section class="related">more</section></main><footer>f</footer><script>if(a<b)"</p>"</script></body></html>"""
    lines = pagediff.page_lines(page)
    assert [t for t, f in lines if not f & pagediff.MARKED] == ["T & x", "One two", "Three four", "five six", "a", "b"]
    assert [t for t, f in lines if f & pagediff.MARKED] == ["ok?", "nice", "more"]
    assert [t for t, _ in pagediff.page_lines('a < b & c &#65;&nbsp;d<div>x</div>tail<u title="a>b">z<!-- <p>no -->')] == ["a < b & c A d", "x", "tailz"]
    assert pagediff.page_lines("") == [] and pagediff.page_lines("<script>never closed") == []
    assert pagediff.page_lines("<span class=ad>x<span>y</span>z</span>w") == [("xyz", 2), ("w", 0)]


def test_deep_pages_take_linear_time():
    import time

    for html in ("<div>" * 110_000 + "</p>" * 110_000 + "end", "<b><i>" * 100_000 + "</u></b>" * 100_000, "<p>" * 300_000, "<div class='x y'>" * 60_000 + "</div>" * 60_000, "<a href='" * 200_000, "<" * 1_000_000):
        began = time.process_time()
        pagediff.page_lines(html)
        assert time.process_time() - began < 4


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<article class="post comment-open"><p>one</article>', "one"),
        ('<article class="post has-sidebar"><p>one</article>', "one"),
        ('<article class="ad"><p>one</article>', "one"),
        ('<article><p class="share-price">one<p id="ad-hoc">two<p><math>x</math> three</article>', "one\ntwo\nx three"),
        ('<article><div class="notice"><p>all there is</div></article>', "all there is"),
        ('<div class="content sidebar"><p>all there is</div>', "all there is"),
        ('<article><p>one<div class="share-buttons">tweet</div><ul class="commentList"><li>nice</ul><p>two</article><div class="ad">buy</div>', "one\ntwo"),
        ('<div class="site-header">name</div><div class="story"><p>one</div><div class="cookie-banner">ok</div>', "one"),
    ],
)
def test_class_words_only_break_ties(spark, html, text):
    df = spark.createDataFrame([(1, "http://h.example/1", html, None, None)], PAGES)
    assert pagediff.extract(df).first().text == text


def own_lines(i, n=6):
    rng = random.Random(i)
    return [" ".join(f"w{rng.randrange(10**6)}" for _ in range(8)) for _ in range(n)]


def test_template_lines_go_by_differencing(spark):
    """Pages without any helpful markup: what neighbours share is the template."""
    def page(i):
        own = "".join(f"<div>{x}</div>" for x in own_lines(i))
        return f"<div>Welcome to the site</div><div>Home | News</div>{own}<div>All rights reserved</div>"

    rows = [(i, f"http://h.example/news/{i:04d}", page(i), None, None) for i in range(40)] + [(99, "http://other.example/", page(99), None, None)]
    df = spark.createDataFrame(rows, PAGES)
    for n in (1, 7):
        got = {r.page_id: r.text for r in pagediff.extract(df, partitions=n).collect()}
        assert all(got[i] == "\n".join(own_lines(i)) for i in range(40))
        assert "Home | News" in got[99]  # it has no neighbour on its host


def test_templates_larger_than_their_pages_and_runs_of_copies(spark):
    """A template of nine tenths of a page goes, and so it does for each of several copies in a row."""
    template = [f"menu entry number {j} of the whole site" for j in range(60)]

    def page(i):
        return "".join(f"<div>{x}</div>" for x in [*template, *own_lines(i // 5), f"copy {i} of the page", *template[::-1]])

    df = spark.createDataFrame([(i, f"http://h.example/{i:04d}", page(i), None, None) for i in range(60)], PAGES)
    for n in (1, 9):
        got = {r.page_id: r.text for r in pagediff.extract(df, partitions=n).collect()}
        assert all(got[i] == "\n".join([*own_lines(i // 5), f"copy {i} of the page"]) for i in range(60))


def test_lines_on_every_article_go_and_shared_passages_stay(spark):
    def page(i):
        own = own_lines(i)
        if i % 3 < 2:
            own[2:2] = ["A passage that several articles quote."]
        return f"<article><h1>Title {i}</h1><p>Subscribe to our letter</p>{''.join(f'<p>{x}</p>' for x in own)}<p>Share this story</p></article>", [f"Title {i}", *own]

    df = spark.createDataFrame([(i, f"http://h.example/news/{i:04d}", page(i)[0], None, None) for i in range(20)], PAGES)
    for n in (1, 5):
        got = {r.page_id: r.text for r in pagediff.extract(df, partitions=n).collect()}
        assert all(got[i] == "\n".join(page(i)[1]) for i in range(20))


def test_copies_of_an_article_stay_whole(spark):
    html = "<article><h1>A</h1><p>same words</p></article>"
    df = spark.createDataFrame([(i, f"http://h.example/{i}", html, None, None) for i in range(25)], PAGES)
    assert {r.text for r in pagediff.extract(df).collect()} == {"A\nsame words"}


def brute_extract(rows):
    """The rule of the operator over plain lists, each page against the whole order of its host."""
    def runs(lines):
        return {tuple(w[i : i + 3]) for w in (x.split() for x in lines) for i in range(max(1, len(w) - 2))}

    def copies(a, b, most):
        if not set(a) & set(b):
            return not a and not b
        size = lambda lines: sum(len(x) for x in lines if x not in most)
        if size(set(a) & set(b)) >= 0.5 * min(size(set(a)), size(set(b))):
            return True
        mine, its = runs([x for x in a if x not in b]), runs([x for x in b if x not in a])
        return len(mine & its) >= 0.5 * min(len(mine), len(its))

    def aligned(a, b):  # all lines of the fixture differ within a page
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i in range(len(a)):
            for j in range(len(b)):
                table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                out.add(a[i - 1])
                i, j = i - 1, j - 1
            elif table[i - 1][j] >= table[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    pages = sorted((*urldigest.split_url(u), i, pagediff.page_lines(h)) for i, u, h in rows)
    out = {}
    for at, (host, path, i, lines) in enumerate(pages):
        near = []
        for side in (-1, 1):
            for k in range(1, 9):
                if 0 <= at + side * k < len(pages) and pages[at + side * k][0] == host:
                    other = pages[at + side * k]
                    same = len([1 for n in range(1, len(path) + 1) if other[1].startswith(path[:n])])
                    near.append((-same, k, side, [t for t, _ in other[3]]))
        texts = [t for t, _ in lines]
        most = {t for x in near for t in x[3] if sum(t in y[3] for y in near) >= 0.75 * len(near)}
        near = [x[3] for x in sorted(near, key=lambda x: x[:3]) if not copies(texts, x[3], most)]
        flow = [t for t, f in lines if f == 1] or [t for t, f in lines if f & 1]
        if flow:
            gone = set.intersection(*(aligned(texts, x) for x in near)) if len(near) >= 3 else set()
            kept = [t for t in flow if t not in gone]
        else:
            gone = aligned(texts, near[0]) if near else set()
            kept = [t for t, f in lines if t not in gone and not f & 2] or [t for t in texts if t not in gone]
        out[i] = "\n".join(kept)
    return out


@pytest.mark.parametrize("rooted", [False, True])
def test_extract_equals_brute_force(spark, rooted):
    rng = random.Random(8)
    rows, bodies = [], []
    for i in range(140):
        host = rng.choice(["a.example", "b.example", "b.example", "c.example"])
        lines = own_lines(i, rng.randint(0, 5)) if rng.random() < 0.7 or not bodies else [*rng.choice(bodies), f"more {i}"]
        bodies.append(lines)
        lines = list(dict.fromkeys([f"{host} menu one", f"{host} menu two", *lines, *rng.sample(["shared a b", "shared c d", "shared e f"], rng.randint(0, 2)), f"{host} end"]))
        if rng.random() < 0.2:
            rng.shuffle(lines)
        body = "".join(f"<p>{x}</p>" if rng.random() < 0.9 else f"<p class=notice>{x}</p>" for x in lines)
        rows.append((i, f"http://{host}/{rng.choice(['', 'x/', 'x/y/'])}{rng.randrange(300)}", f"<article>{body}</article>" if rooted else body))
    df = spark.createDataFrame([(*r, None, None) for r in rows], PAGES).repartition(4)
    want = brute_extract(rows)
    assert len(set(want.values())) > 50
    for n in (1, 13, 60):
        assert {r.page_id: r.text for r in pagediff.extract(df, partitions=n).collect()} == want


def test_extract_odd_rows(pages, no_pages):
    rows = pagediff.extract(pages).collect()
    assert len(rows) == len(ODD) and all(r.n_chars == len(r.text) for r in rows)
    got = {r.page_id: r.text for r in rows}
    assert got[3] == got[4] == "" and got[None] == "plain & simple \x00 text" and len(got[5]) == 249999
    assert pagediff.extract(no_pages).collect() == []


RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]


def judged(url, rules):
    host, path = urldigest.split_url(url)
    fits = [((len(r), r.find("/")), r, a) for r, a in rules if f".{host}".endswith("." + r.partition("/")[0]) and path.startswith(r[r.find("/") :])]
    return (max(fits)[1], max(fits)[2]) if fits else (None, "allow")


def test_verdicts_equal_brute_force(spark):
    rng = random.Random(1)
    hosts = ["example.com", "www.example.com", "Sub.WWW.example.COM", "badexample.com", "a.net", "net", "com", "", "x.org:80", "É.com"]
    paths = ["", "/", "/en/", "/en", "/es/1", "/fr/", "/en/a?b#c", "?/en/", "#/en/"]
    urls = [f"http{rng.choice(['', 's'])}://{h}{p}" for h in hosts for p in paths] + [None, "", "example.com/en/", "a://b://c/en/"]
    rules = RULES + [(f"{rng.choice(hosts).lower() or 'q'}/{rng.choice(['', 'e', 'en/a', 'fr'])}", rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list(dict(rules).items())
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    for r in urldigest.filter_urls(df, rules).collect():
        assert (r.rule, r.verdict) == judged(urls[r.page_id], rules), urls[r.page_id]


def test_digest_array_confirms_strings(monkeypatch):
    monkeypatch.setattr(urldigest, "digest", lambda text: len(text) % 3)
    array = urldigest.DigestArray(np.frombuffer(urldigest.DigestArray.build([(f"k{i}", i) for i in range(50)]), np.uint8))
    assert array.probe([f"k{i}" for i in range(50)]).tolist() == list(range(50))
    assert array.probe(["kx", "", "k500"]).tolist() == [-1, -1, -1]


def test_filter_odd_rows(pages, no_pages):
    rows = urldigest.filter_urls(pages, RULES).collect()
    assert len(rows) == len(ODD) and {r.host for r in rows} == {"a.example", "", "b.example"}
    assert urldigest.filter_urls(no_pages, RULES).collect() == []


def test_warc_round_trip(spark, pages, no_pages):
    more = spark.createDataFrame([(100 + i, f"http://c.example/{i}", "<p>one<p>two", None, None) for i in range(30)], PAGES)
    path = base.scratch_path(spark, "warc")
    files = warc.write_warc(pages.unionByName(more, allowMissingColumns=True), path)
    rows = warc.read_warc(spark, path, [f["file"] for f in files]).collect()
    want = [(r[0], r[2] or "") for r in ODD] + [(100 + i, "<p>one<p>two") for i in range(30)]
    assert len(rows) == len(want)
    by = {}
    for i, t in want:
        by.setdefault(t, []).append(i)
    for r in rows:
        text = dict(want)[r.page_id].encode()
        assert r.payload_bytes == len(text) and r.payload_digest == base64.b32encode(hashlib.sha1(text).digest()).decode()
        if r.record_type == "response":
            assert bytes(r.payload) == text and r.refers_to is None
        else:
            assert r.refers_to == max(x for x in by[text.decode()] if x is not None)
    assert sum(r.record_type == "response" for r in rows) == len(by)
    assert all(r.record_type == "response" for r in rows if r.page_id == 129)
    path = base.scratch_path(spark, "warc")
    assert warc.read_warc(spark, path, [f["file"] for f in warc.write_warc(no_pages, path)]).collect() == []


@pytest.mark.parametrize("hot_share", [0.0, 0.4, 1.0])
def test_warc_groups_hot_and_cold(spark, hot_share):
    """Large and small groups of equal payloads; those under the least size are all responses."""
    bodies = ["same " * 20] * 40 + ["other"] * 3 + ["x" * i for i in range(10)] + [None, ""]
    df = spark.createDataFrame([(i, "u", t) for i, t in enumerate(bodies)], "page_id long, url string, html string").repartition(4)
    for least in (0, 50):
        path = base.scratch_path(spark, "warc")
        files = warc.write_warc(df, path, min_bytes=least, hot_share=hot_share)
        last = {t or "": i for i, t in enumerate(bodies)}
        rows = warc.read_warc(spark, path, [f["file"] for f in files if f["records"]], ("page_id", "record_type", "refers_to")).collect()
        assert len(rows) == len(bodies)
        for r in rows:
            body = bodies[r.page_id] or ""
            first = last[body] if len(body) >= least else r.page_id
            assert (r.record_type, r.refers_to) == (("response", None) if first == r.page_id else ("revisit", first))


def test_warc_reader_is_incremental_and_strict():
    data = b"".join(warc.encode_record("response", f"urn:page:{i}:{i}", f"http://x/{i}", "2000-01-01T00:00:00Z", b"<p>%d" % i * (i * 50), None) for i in range(20))
    for chunk in (1, 7, 1 << 16):
        got = list(warc.WarcReader(io.BytesIO(data), chunk))
        assert [r.payload for r in got] == [b"<p>%d" % i * (i * 50) for i in range(20)]
    for cut in (1, 200, len(data) - 1):
        with pytest.raises(warc.WarcError):
            list(warc.WarcReader(io.BytesIO(data[:cut])))
    bad = bytearray(data)
    bad[150] ^= 4
    with pytest.raises((warc.WarcError, ValueError, KeyError)):
        list(warc.WarcReader(io.BytesIO(bytes(bad))))
