import html
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import pages
from ledgerloom.llm.pages import Reader

from .conftest import WORDS, ordered, prose

LONG = "This sentence is long enough to count as running text of an article, it really is. "


def own(text):
    """A page read by its own best container alone."""
    return Reader(text).text(None)


@pytest.mark.parametrize(
    "page,want",
    [
        ("", ""),
        ("<p></p>  ", ""),
        ("plain &amp; simple", "plain & simple"),
        (f"<article><h1>T &lt; U</h1><p>{LONG}<b>bold\n\t word</b><br>next</article>", f"T < U\n{LONG}bold word next"),
        (f"<article><p><b>one {LONG}<br><p>two&nbsp;&nbsp;three</b> four</article>", f"one {LONG.strip()}\ntwo three four"),
        (f"<nav>menu</nav><!-- <p>no</p> --><script>var t='</p>';</script><style>p{{}}</style><div class='ad'>buy this now. {LONG}</div><article><p>{LONG}</p></article><footer>end</footer>", LONG.strip()),
        (f"<article><p>{LONG}</p><div id='comments'><p>I disagree. {LONG * 9}</p></div><form><input><label>name</label></form></article>", LONG.strip()),
        (f"<form id='page'><div><h1>T</h1><p>{LONG * 3}</p></div><div class='side-bar menu'>x</div></form>", f"T\n{(LONG * 3).strip()}"),
        (f"<div class='content with-sidebar'><article><p>{LONG}</p></article><aside>{LONG}</aside></div>", LONG.strip()),
        (f"<article><ul><li>{LONG}<li>two<ul><li>three</ul></ul><table><tr><td>a<td>b<tr><td>c</table></article>", f"{LONG.strip()}\ntwo\nthree\na\nb\nc"),
        (f"<div class='story'><h1>Title</h1><div class='text'><p>{LONG}</p></div></div>", f"Title\n{LONG.strip()}"),
        (f"<article><p hidden>gone</p><p style='DISPLAY : none'>gone</p><p>a < b and 3<4 {LONG}</p><p>x<a href=b>l</a>y</p></article>", f"a < b and 3<4 {LONG.strip()}\nxly"),
        (f"<article><p>{LONG}<span class='sponsored'>buy</span>kept</p></article>", f"{LONG}kept"),
        (f"<article><p title='a > b'>{LONG}</p></article><p", LONG.strip()),
        (f"<article><p>&#x1F600; &eacute &copy 2 &am {LONG}</p>", f"\U0001f600 é © 2 &am {LONG.strip()}"),
    ],
)
def test_pages_by_hand(page, want):
    assert own(page) == want


def test_given_pages_keep_their_article(spark):
    """Every page of the table, by the marks of its template."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    for r in rows:
        inner = re.sub(r"<br[^>]*>", " ", re.search(r"<article>(.*?)</article>", r.html, re.S).group(1))
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", b)).split()) for b in re.split(r"</?(?:p|h1)\b[^>]*>", inner)]
        assert own(r.html) == "\n".join(b for b in blocks if b)


@pytest.mark.parametrize("bad", ["<a ", "<div>", "<b>", "<p><b>", "<!--", '<a href="', "<div class=a><i>", "<li>", "<table><tr><td>", "</", "<", "<script>", "&#", "<b></i>", "<div></p>"])
def test_broken_pages_take_time_in_proportion(bad):
    import time

    began = time.perf_counter()
    assert own(bad * 20_000 + "x" if bad != "<script>" else bad) is not None
    assert time.perf_counter() - began < 10


@pytest.fixture(scope="module")
def web():
    """Hosts whose templates tell nothing by name; on some pages something longer than the article misleads."""
    rng = random.Random(3)
    text = lambda n: ". ".join(prose(rng, 12, WORDS["aa"]).capitalize() for _ in range(n)) + "."
    rows, want = [], {}
    for i in range(120):
        host = ["a.example", "b.example", "hot.example", "hot.example"][i % 4]
        title, body, extra = f"Title {i}", [text(4), text(3), text(5)], text(40) if i % 11 == 0 else "Short"
        if host == "a.example":
            page = f"<html><body><div class='x{i}'>top</div><div class='c7'><h1>{title}</h1>{''.join(f'<p>{b}</p>' for b in body)}</div><div class='d'>{extra}</div></body></html>"
        elif host == "b.example":
            page = f"<body><table><tr><td><a href=x>menu</a></td><td class=m><h1>{title}</h1>{''.join(f'<div>{b}</div>' for b in body)}</td><td class=q>{extra}</td></tr></table></body>"
        else:
            page = f"<body class='p{i}'><div><section class='k'><h1>{title}</h1>{'<br><br>'.join(body)}</section></div><section class='also'><div>{extra}</div></section>"
        rows.append((i, f"http{'s' * (i % 2)}://{'u@' * (i % 3 == 0)}{host.upper() if i % 5 == 0 else host}:80/{i}?q#x", page))
        want[i] = "\n".join([title, *(body if host != "hot.example" else [" ".join(body)])])
    return rows, want


PAGES = "page_id long, url string, html string"


@pytest.mark.parametrize("most_broadcast,hot_pages", [(100_000, 50_000), (0, 50), (0, 10**9)])
def test_hosts_agree_on_their_article(spark, web, most_broadcast, hot_pages):
    rows, want = web
    assert any(own(p) != want[i] for i, _, p in rows), "some pages mislead"
    df = spark.createDataFrame(rows, PAGES).withColumn("path", F.lit("mine")).withColumn("host", F.lit(1)).repartition(4)
    got = {r.page_id: r.text for r in pages.extract(df, most_broadcast=most_broadcast, hot_pages=hot_pages).collect()}
    assert got == want


def test_winners_equal_a_count_by_hand(spark, web):
    rows, _ = web
    votes, n = {}, Counter()
    for _, url, page in rows:
        host = re.sub(r".*//(?:.*@)?([^:/]*).*", r"\1", url).lower()
        path, score = Reader(page).vote()
        s, k = votes.setdefault(host, {}).get(path, (0, 0))
        votes[host][path] = (s + score, k + 1)
        n[host] += 1
    best = {h: max((s, k, p) for p, (s, k) in own.items())[2] for h, own in votes.items()}
    got = {r.host: (r.path, r.pages) for r in pages.winning_paths(spark.createDataFrame(rows, PAGES)).collect()}
    assert got == {h: (p, n[h]) for h, p in best.items()}


def test_awkward_rows(spark):
    rows = [(1, None, f"<article><p>{LONG}</p></article>"), (2, "http://h.example/", None), (3, "", ""), (None, "no host", f"<p>{LONG}</p>"), (4, "//h.example/x", f"<div><p>{LONG}</p></div>"), (4, "//h.example/x", f"<div><p>{LONG}</p></div>"), (5, "http://h.example", "<p>" + LONG * 20_000)]
    got = pages.extract(spark.createDataFrame(rows, PAGES).withColumn("text", F.lit(0)))
    text = LONG.strip()
    assert ordered([(r.page_id, r.url, r.text, r.n_chars) for r in got.collect()]) == ordered([(i, u, t, len(t)) for (i, u, _), t in zip(rows, [text, "", "", text, text, text, (LONG * 20_000).strip()], strict=True)])
    assert pages.extract(spark.createDataFrame([], PAGES)).collect() == []
