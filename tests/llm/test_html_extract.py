import random
import re
import time
from os.path import commonprefix

import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loglens.llm import html_extract as hx

SCHEMA = "page_id long, url string, html string, text string"


def text_of(html):
    return hx.main_text(hx.Page(1, "", "", "", hx.blocks(html)), None, None)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<p>a&amp;b &lt;i&gt; &#233;</p>", "a&b <i> é"),
        ("<div>one\n\t two</div><p>three<br>four", "one two three four"),
        ("a<b>b</b>c", "abc"),
        ("<script>var t='</p>';</script><style>p{}</style>x<!-- no <p>no</p> -->y", "xy"),
        ("<nav><p>menu</nav>text<footer>foot", "text"),
        ("<p>keep<div class='ad'>buy</div><p>this", "keep this"),
        ("<p class=ad>buy<p>keep", "keep"),
        ("<ul class=menu><li>a<li>b</ul>c", "c"),
        ("<body class='nav-open'><article class='post comments-on'><p>x</article><p>y", "x"),
        ("<article><h1>T</h1><p>a<aside>b</aside><form>c</form><section id=comments><p>d</section><p>e</article>f", "T a e"),
        ("<main>m</main><p>out", "m"),
        ("<div itemprop=articleBody>m</div><p>out", "m"),
        ("<p title='a > b'>x</p>", "x"),
        ("<p title='open>x</p>", "x"),
        ("1 < 2 and <3", "1 < 2 and <3"),
        ("<p>cut <a href=", "cut"),
        ("<article><p>cut off in <b>the mid", "cut off in the mid"),
        ("<div hidden>no</div><div style='display: none'>no</div>yes", "yes"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"),
        ("<textarea>no</textarea><title>no</title>x", "x"),
        ("<article><nav>n</nav></nav></div>x</article>", "x"),
        ("", ""),
        # articles that are comments or teasers, by name and by size
        ("<main><p>Body</p></main><article class='comment'>Nice post, thank you!</article>", "Body"),
        ("<main><p>The whole long body<article><p>Teaser</article><p>goes on</main>", "The whole long body goes on"),
        ("<article><p>Body</article><article class='teaser related'>More</article>", "Body"),
        ("<article><p>The body<article>I agree</article></article>", "The body"),
        ("<article><h1>T</h1><article><p>The body</article></article>", "T The body"),
        ("<main><h1>T</h1><article><p>The body</article></main>", "The body"),
        ("<div><p>The body is in plain blocks.</div><article>Short</article>", "The body is in plain blocks."),
        ("<article><p>one</article><article><p>two</article>", "one two"),
        ("<article><p>x<div itemtype='http://schema.org/Comment'>no</div></article>", "x"),
        ("<article><p>x<section aria-label='Reader comments'>no</section></article>", "x"),
        # names of parts are whole names
        ("<div class='share-price-analysis'><p>x</div>", "x"),
        ("<div class='content-with-sidebar'>x</div><div class='left sidebar-2'>no</div>", "x"),
        ("<div id='siteHeader'>no</div><p class='comment_list'>no<p class='commentary'>x", "x"),
        # quotes that hold markup or never close
        ("<p title='<b>no</b>'>x</p>", "x"),
        ("<p title='a > b\">x<p id=\"c > d'>y", "y"),
        ("<!-->x<!-- > no -->y", "xy"),
        ("a <b c < d", "a <b c < d"),
        ("<script >if (a</script x) no</script>x", "x"),
        ("<p>" + "<b>" * 2000 + "<nav>no</nav>x" + "</b>" * 2000 + "</p><p class=ad>no", "x"),
    ],
)
def test_markup(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("piece", ["<a ", "<a '", '<a ">', "<a '>\"", "<!", "</", "</script ", "<div></x>", "<b><li></li>", "<li><ul><b>", "<article>x"])
def test_time_is_linear(piece):
    """A megabyte of malformed markup takes about as long as any other."""
    start = time.perf_counter()
    text_of(piece * ((1 << 20) // len(piece)))
    assert time.perf_counter() - start < 8


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<a ", "<p", " b='", "'", '"', ">", "/", "<", " x ", "</p>", "<!--", "-->", "=", "<b>"]), max_size=25))
def test_tags_end_where_a_plain_reader_ends_them(parts):
    html = "".join(parts)
    for start, end, closing, name, _ in hx.markup(html):
        if not name:
            continue
        at = start + 1 + closing + len(name)
        quote, close = "", -1
        for i in range(at, len(html)):
            if quote:
                quote = "" if html[i] == quote else quote
            elif html[i] in "'\"":
                quote = html[i]
            elif html[i] == ">":
                close = i
                break
        close = close if close >= 0 else html.find(">", at)
        assert end == (close + 1 or len(html))


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(400):
        a, b = ([rng.choice("abcdef") for _ in range(rng.randint(0, 25))] for _ in range(2))
        found = sorted(hx.shared_lines(a, b))
        assert len(found) == common_length(a, b)
        rest = iter(b)
        assert all(any(a[i] == y for y in rest) for i in found)


def test_template_lines_are_deleted(spark):
    page = lambda n: f"<div>Site name</div><div>Home of things</div><p>Article {n} says {n * 7}.</p><p>More {n}.</p><div>All rights</div>"
    rows = [(n, f"http://h{n % 2}.example/a/{n:03}?x=1", page(n), "t") for n in range(40)]
    rows += [(100, "http://lone.example/", page(100), "t"), (101, None, None, None), (102, "http://h1.example/a/001", page(1), "t")]
    rows += [(None, "x", "<p>y", "t"), (3, rows[3][1], rows[3][2], "t")]
    got = hx.extract_text(spark.createDataFrame(rows, SCHEMA)).coalesce(1).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        if r.page_id is not None and r.page_id < 40:
            assert r.text == f"Article {r.page_id} says {r.page_id * 7}. More {r.page_id}.", r
    texts = {r.page_id: r.text for r in got}
    assert texts[100].startswith("Site name Home") and texts[101] == "" and texts[None] == "y"
    assert hx.extract_text(spark.createDataFrame([], SCHEMA)).collect() == []


def brute_extract(rows):
    """Pages without regions: lines that the nearest page of the host does not share, by a
    plain table of common subsequences (any one of them: only their total is compared)."""
    parted = sorted((re.sub("^[a-z]+://", "", u).partition("/")[0], "/" + u.split("/", 3)[3].partition("?")[0], i, h) for i, u, h in rows)
    lines = [re.findall(r"<p>([^<]*)", x[3]) for x in parted]
    want = {}
    for n, (host, path, page_id, _) in enumerate(parted):
        def nearness(m, path=path):
            a, b = path.split("/"), parted[m][1].split("/")
            return len(commonprefix([a, b])), len(commonprefix([path, parted[m][1]]))

        near = sorted((m for m in (n - 1, n + 1) if 0 <= m < len(parted) and parted[m][0] == host), key=nearness, reverse=True)
        size = len(lines[n])
        kept = next((c for c in (size - common_length(lines[n], lines[m]) for m in near) if c >= 0.1 * size), size)
        want[page_id] = kept
    return want


def test_differencing_against_a_plain_table(spark):
    """Every line has three characters, so the number of lines left is the contract."""
    rng = random.Random(5)
    rows = []
    for n in range(60):
        own = [f"{n:02}{c}" for c in "abcdefg"[: rng.randint(1, 7)]]
        shared = [f"-{c}-" for c in "uvwxyz" if rng.random() < 0.7]
        mixed = own + shared
        rng.shuffle(mixed)
        url = f"http://h{n % 3}.example/{'ab'[n % 2]}/{rng.choice('pq')}/{n:03}?x"
        rows.append((n, url, "".join(f"<p>{x}</p>" for x in mixed)))
    want = brute_extract(rows)
    got = hx.extract_text(spark.createDataFrame([(*r, "t") for r in rows], SCHEMA).coalesce(1)).collect()
    assert {r.page_id: len(r.text.split()) for r in got} == want
    assert all(f"{r.page_id:02}a" in r.text for r in got)


def test_articles_of_pages(spark):
    """Whole articles of the given pages, against the markup between the article's tags."""
    import html
    import re

    from loglens.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf}/pages.parquet").to_pylist()}
    got = QUERIES["op2_html_extract"](spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|$)", pages[r.page_id]["html"], re.S)[1]
        want = " ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: "" if m[0] in ("<b>", "</b>") else " ", body)).split())
        assert r.text == want


def test_every_page_is_differenced():
    """A marked body that is the site's template gives way to the page's own lines; a passage
    that two pages carry stays with the body around it."""

    def page(path, html):
        return hx.Page(1, "", "h", path, hx.blocks(html))

    frame = "<main><p>Welcome to our site</main><div><p>%s is the news of the day, at length</div>"
    a, b = page("/a", frame % "Rain"), page("/b", frame % "Sun")
    assert hx.main_text(a, None, b) == "Rain is the news of the day, at length"
    assert hx.main_text(a, None, None) == "Welcome to our site"
    kept = "<main><p>%s<p>A passage of both</main><div><p>Something long that stands outside the body, by %s</div>"
    a, b = page("/a", kept % ("One", "Ann")), page("/b", kept % ("Two", "Bob"))
    assert hx.main_text(a, None, b) == "One A passage of both"


def test_regions_of_the_template_give_way():
    """The regions of a page are differenced before they are weighed: one that both neighbours
    carry whole is the site's, one that a single neighbour carries may be an article on two pages."""

    def texts(html, words=("Rain", "Sun", "Wind")):
        pages = [hx.Page(1, "", "h", f"/{w}", hx.blocks(html.replace("%s", w))) for w in words]
        return hx.main_text(pages[1], pages[0], pages[2])

    news = "%s is the news of the day, told here in full"
    promo = "<article><p>What we ourselves are about, as on every page of this site</article>"
    want = news.replace("%s", "Sun")
    assert texts(f"{promo}<article><p>{news}</article>") == want
    assert texts(f"{promo}<div><p>{news}</div>") == want
    assert texts(f"<main><p>{news}{promo}</main>") == want
    assert texts(f"<article><p>{news}<p>A passage of all</article>{promo}") == f"{want} A passage of all"
    both = hx.Page(1, "", "h", "/b", hx.blocks(f"{promo}<article><p>{news}</article>"))
    near = hx.Page(2, "", "h", "/a", hx.blocks(f"{promo}<article><p>Another text of about that length</article>"))
    far = hx.Page(3, "", "h", "/c", hx.blocks("<article><p>Nothing of it is here</article>"))
    for neighbours in ((near, far), (far, near), (near, None)):
        assert hx.main_text(both, *neighbours) == f"What we ourselves are about, as on every page of this site {news}"
