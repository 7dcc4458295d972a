"""Page differencing against brute force, and hand-made pages."""

import random
import tracemalloc

import numpy as np

from skylattice.llm import html_extraction as hx


def kept(page):
    return [t for t, bad in zip(*hx.lines(page)[::2]) if not bad]


def lcs(a, b):
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return t[-1, -1]


def test_common_is_longest():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(0, 15)) for _ in range(2))
        got = hx.common(a, b)
        kept = iter(b.tolist())
        assert all(any(x == y for y in kept) for x in a[got].tolist())  # a subsequence of b
        assert got.sum() == lcs(a, b)


def test_long_pages_in_little_memory(monkeypatch):
    """Halving the table changes nothing, and a page of many lines needs no table of its square."""
    rng = np.random.default_rng(1)
    pairs = [[rng.integers(0, 5, rng.integers(0, 40)) for _ in range(2)] for _ in range(60)]
    want = [hx.common(a, b).sum() for a, b in pairs]
    monkeypatch.setattr(hx, "_CELLS", 20)
    for (a, b), n in zip(pairs, want):
        got = hx.common(a, b)
        left = iter(b.tolist())
        assert got.sum() == n == lcs(a, b) and all(any(x == y for y in left) for x in a[got].tolist())
    monkeypatch.setattr(hx, "_CELLS", 1 << 18)
    a, b = np.arange(6000), np.arange(6000)
    a[::3] += 10_000
    b[::5] += 20_000
    tracemalloc.start()
    assert hx.common(a, b).sum() == sum(i % 3 != 0 and i % 5 != 0 for i in range(6000))
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()


def test_differencing_takes_the_template():
    """Menus and footers are lines too, and differencing deletes them before structure is asked."""
    page = lambda k: f"<nav><a>Home</a><a>About</a></nav><div>text {k}</div><p>in <span class='ad'>Buy</span> line {k}</p><footer>Site</footer><div class='comments'>said {k}</div>"
    text, _, bad = hx.lines(page(1))
    assert list(zip(text, bad)) == [("HomeAbout", True), ("text 1", False), ("in line 1", False), ("Site", True), ("said 1", True)]
    both = [(f"/{k}", np.array([hx._hash(t) for t in hx.lines(page(k))[0]]), np.array([0, 6, 9, 0, 0]), np.zeros(5, bool)) for k in (1, 2)]
    assert hx.shared_lines(both[0], [both[1][:2]]).tolist() == [True, False, False, True, False]


def test_structure():
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var x="<p>no</p>";</script></head><body>
    <header>Site</header><nav><ul><li><a href="/a">Home</a></li></ul></nav><div class="ad">Buy</div><div id="cookie-notice">Cookies</div>
    <article><header><h1>Title &amp; more</h1></header><p>One  <b>two</b><br>three &lt;b&gt; &eacute;<p>Four<!-- no --> five</p><form><input value="x">Send</form><aside>Side</aside></article>
    <div class="comments"><p>First!</p></div><footer>&copy; me</footer></body></html>"""
    assert kept(page) == ["Title & more", "One two", "three <b> é", "Four five"]
    for odd in (None, "", "plain", "<", "<p", "a < b", "<div><p>x</div>y", "<script>never closed", "</p></p>", "<p>" * 3000 + "deep"):
        hx.lines(odd)
    assert kept('<div class="wide no-sidebar">x<div class="post-sidebar">y</div></div>') == ["x"]
    assert kept("a < b<p>c") == ["a < b", "c"]
    assert kept("<ul><li>x<li>y</ul>") == ["x", "y"]


def test_paths():
    assert hx.host_path("https://WWW.Example.org:80/A/b.html?x=1#y") == ("example.org", "/a/b.html")
    assert hx.host_path(None) == ("", "") and hx.host_path("no url") == ("", "no url")


def site(rng, host, i, n=6):
    text = [f"{host} page {i} line {k} {rng.random()}" for k in range(n)]
    boiler = [f"{host} welcome", "Terms of use", f"More from {host}"]
    return text, "<html><body>" + "".join(f"<div>{x}</div>" for x in [boiler[0], *text, *boiler[1:]]) + "</body></html>"


def test_template_lines_go(spark):
    rng = random.Random(0)
    rows, want = [], {}
    for h in range(5):
        for i in range(30 if h == 0 else 3):
            text, html = site(rng, f"h{h}.com", i)
            want[len(rows)] = "\n\n".join(text)
            rows.append((len(rows), f"http://h{h}.com/p/{i:03d}.html", html, "clash", 1))
    article = "<html><body><article><p>kept</p><p>shared line</p></article></body></html>"
    rows += [(900, "http://x.com/1", article, "c", 1), (901, "http://x.com/2", article.replace("kept", "other"), "c", 1), (902, None, None, "c", 1), (903, "http://solo.com/a", "<p>alone</p>", "c", 1)]
    rows += [(904, "http://h1.com/p/000.html", "", "c", 1), rows[0], (None, "http://h2.com/p/000.html", rows[34][2], "c", 1)]
    want |= {900: "kept\n\nshared line", 901: "other\n\nshared line", 902: "", 903: "alone", 904: "", None: want[34] if rows[34][1].startswith("http://h2") else None}
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int").repartition(4)
    got = hx.extract(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if want[r.page_id] is not None:
            assert r.text == want[r.page_id], r.page_id
    assert hx.extract(df.limit(0)).count() == 0


def test_copies_tell_nothing():
    a = np.arange(10)
    own = ("/a", a, np.full(10, 5), np.zeros(10, bool))
    assert not hx.shared_lines(own, [("/a", a)]).any()
    assert hx.shared_lines(own, [("/a", a), ("/b", np.array([0, 99, 9]))]).sum() == 2


def test_runs_of_copies_and_heavy_templates(spark):
    rng = random.Random(1)
    rows, want = [], {}

    def add(url, lines, own):
        want[len(rows)] = "\n\n".join(own)
        rows.append((len(rows), url, "".join(f"<div>{x}</div>" for x in lines)))

    fill = lambda n: " ".join(str(rng.random()) for _ in range(n))
    top, end = fill(4), fill(4)
    same = [fill(6), fill(6)]
    for i in range(5):  # equal pages, and pages that differ in a line
        add(f"http://a.com/m?page={i}", [top, *same, end], same)
        own = [*same, f"seen {i} times"]
        add(f"http://a.com/m{i}", [top, *own, end], own)
    for i in range(9):
        own = [fill(6)]
        add(f"http://a.com/z{i}", [top, *own, end], own)
    menu = [fill(9) for _ in range(4)]  # most of the text
    for i in range(6):
        own = [fill(6)]
        add(f"http://b.com/{i}", [*menu, *own], own)
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got == want


def test_article_text_stays():
    text = lambda page: " ".join(kept(page))
    assert text("<article><p>Let <math><mi>x</mi></math> be</p></article>") == "Let x be"
    assert text("<div><figure><img src=a><figcaption>A caption</figcaption></figure></div>") == "A caption"
    long = "word " * 60
    for name in ("elementor-widget elementor-widget-text-editor", "side-by-side", "content-with-sidebar", "page_without_menu", "menu-open"):
        assert text(f'<div class="{name}"><p>kept</p></div>') == "kept", name
        assert text(f'<article><div class="{name}"><p>kept</p></div></article>') == "kept", name
    for name in ("related", "share", "tags", "sidebar"):
        assert text(f'<div class="{name}"><p>{long}</p></div>') == long.strip(), name
        assert text(f'<div class="{name}"><article>kept</article></div>') == "kept", name
        assert text(f'<div class="{name}-links"><a href=x>{long}</a></div>') == "", name
    assert text(f'<div class="entry-header"><h1>Title</h1></div><div id="cookie-notice"><p>{long}</p></div><div class="comment-list"><article>{long}</article></div>') == "Title"


def longest(a, b):
    """Places in ``a`` of a longest common subsequence, by the whole table."""
    t = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            t[i + 1, j + 1] = t[i, j] + 1 if a[i] == b[j] else max(t[i, j + 1], t[i + 1, j])
    return int(t[-1, -1])


def by_hand(rows):
    """Pages of plain lines, each on its own: distinct pages of a host in URL order, neighbours at doubling distance, copies passed over."""
    pages = {}
    for _, url, lines in rows:
        pages.setdefault(hx.host_path(url)[0], {}).setdefault(tuple(lines), []).append(hx.host_path(url)[1])
    gone = {}
    for host, group in pages.items():
        order = sorted((min(paths), lines) for lines, paths in group.items())
        seen = [line for _, lines in order for line in set(lines)]
        template = {x for x in seen if len(order) > 2 and 2 * seen.count(x) > len(order)}
        for at, (path, lines) in enumerate(order):
            own = [x for x in lines if x not in template]
            if len(order) < 3 or sum(map(len, own)) < 0.1 * sum(map(len, lines)):
                own = list(lines)
            far, found = 1, None
            while found is None and len(order) > 1:
                near = [k for k in (max(0, at - far), min(len(order) - 1, at + far)) if k != at]
                for k in sorted(near, key=lambda k: -hx.prefix_length(path, order[k][0])):
                    other = order[k][1]
                    shared = [x for x in lines if x in other]
                    assert len(shared) == longest(lines, other)  # lines of a page differ and keep their order here
                    if sum(len(x) for x in shared if x in own) <= 0.5 * sum(map(len, own)):
                        found = set(shared)
                        break
                if at - far <= 0 and at + far >= len(order) - 1:
                    break
                far *= 2
            gone[host, lines] = found or set()
    return {i: "\n\n".join(x for x in lines if x not in gone[hx.host_path(url)[0], tuple(lines)]) for i, url, lines in rows}


def test_pairing_and_deletion_by_hand(spark):
    rng = random.Random(7)
    rows = []
    for h in range(6):
        top, end = f"top of {h} {rng.random()}", f"end of {h} {rng.random()}"
        section = {k: f"section {k} of {h} {rng.random()}" for k in range(3)}
        old = None
        for i in range(rng.randrange(1, 25)):
            k = i // 8
            body = [f"{h} {i} line {n} {rng.random()}" for n in range(rng.randrange(1, 5))]
            if old and rng.random() < 0.3:  # a copy, with a line changed or not
                body = old[:-1] + [rng.choice([old[-1], f"changed {rng.random()}"])]
            old = body
            rows.append((len(rows), f"http://host{h}.com/{k}/p{rng.randrange(100):02d}-{i}", [top, section[k], *body, end]))
    df = spark.createDataFrame([(i, u, "".join(f"<div>{x}</div>" for x in lines)) for i, u, lines in rows], "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in hx.extract(df).collect()}
    assert got == by_hand(rows)
