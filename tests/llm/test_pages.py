import base64
import gzip
import hashlib
import time
from random import Random

import pytest

from gavel.llm import htmltext as H
from gavel.llm import urls as U
from gavel.llm import warc as W

PAGES = "page_id long, url string, html string"
LONG = "<p>" + "word " * 40 + "</p>"
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p {{}}</style><script>var a = "</p><p>no";</script></head><body>
<header>Site <a href="/">Home</a></header><nav><ul><li>One<li>Two</ul></nav><div class="cookie-notice"><p>We use cookies</p></div>
<div id="sidebar">{LONG}</div><article class="post"><header><h1>Caf&eacute; &amp;
 bar</h1></header>{LONG}<p>Short.<p>With <b>bold</b>er<br>text&nbsp;and <i>more<div class="ad">{LONG}</div>
<table><tr><td>a<td>b</tr></table><form><input><p>Search</p></form><aside>Also</aside><!-- <p>no</p> -->
<section class="comments">{LONG}</section><p>End</article><footer><p>Foot</p></footer></body></html>"""
WORDS = ("word " * 40).strip()
LINKS = "<div><a>m</a></div>" * 6


def test_article():
    assert H.main_text(PAGE).split("\n") == ["Café & bar", WORDS, "Short.", "With bolder text and more", "a", "b", "End"]


@pytest.mark.parametrize(
    "html, text",
    [
        (None, ""), ("", ""), ("plain & simple", "plain & simple"), ("<p></p>", ""), ("<script>x</script>", ""),
        (f"<div>{LONG}<p>tail</p></div><div><a>m</a></div><div><a>n</a></div><div><a>o</a></div>", WORDS + "\ntail"),
        ("<article><p>tiny</p></article><p>" + "other " * 30, "tiny"),
        (f"<article>{LONG}</article><article>{LONG}</article>", f"{WORDS}\n{WORDS}"),
        ("<article><p>open <b>tags <p>close</article><footer>f</footer>", "open tags\nclose"),
        ("<main><ul><li>a<li>b</ul><nav>n</nav></main>", "a\nb"),
        ("<article>x &lt;b&gt; &#233; &unknown; y</article>", "x <b> é &unknown; y"),
    ],
)
def test_shapes(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class='content-sidebar-wrap'><article>{LONG}</article></div>", WORDS),
        (f"<main><div class='content-sidebar-wrap'><article>{LONG}</article></div></main>", WORDS),
        (f"<div id='page' class='site no-sidebar'><h1>T</h1>{LONG}<div class='ad'><p>buy</p></div></div><p>tail</p>", f"T\n{WORDS}\ntail"),
        (f"<div class='header-fixed menu-open'><main>{LONG}</main></div>", WORDS),
        (f"<div class='header-fixed menu-open'>{LONG}</div>", WORDS),
        (f"<form id='aspnetForm'><article>{LONG}<form><p>Search</p></form></article></form>", WORDS),
        (f"<article><header class='entry-header'><h1>T</h1></header>{LONG}</article>", "T\n" + WORDS),
        (f"<article>{LONG}</article><div class='comments'><article>{LONG}</article></div>", WORDS),
        (f"<main>{LONG}</main><div class='related'><article>{LONG}</article></div>", WORDS),
        (f"<article>{LONG}<p>one <span class='ad'>two </span>three</article>", WORDS + "\none three"),
    ],
)
def test_marked_elements_around_the_page(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize(
    "html, text",
    [
        (f"<div class='menu-layout'>{LONG}</div><p>ten letter</p>", WORDS + "\nten letter"),
        (f"<div class='post-header'><h1>T</h1></div><div>{LONG}{LONG}</div>", f"T\n{WORDS}\n{WORDS}"),
        (f"<main>{LONG}<p class='social-history'>kept</p><p class='social'>gone</p></main>", WORDS + "\nkept"),
        (f"<main>{LONG}<div class='cookieNotice'>a</div><div id='ad-1'>b</div><div class='x related_posts'>c</div></main>", WORDS),
        (f"<div class='site-header'><p>Site</p></div><div>{LONG}</div>", WORDS),
        (f"<body><div><h1>T</h1></div>{LINKS}<div>{LONG * 4}</div>{LINKS}<p>Closing.</p><p><a>one link</a></p><div>other</div></body>", "\n".join(["T", *[WORDS] * 4, "Closing."])),
    ],
)
def test_names_of_classes(html, text):
    assert H.main_text(html) == text


@pytest.mark.parametrize("piece", ["<div>x", "<b>x", "<div class='ad'>x", "<main>x", "<div class='ad'><main>x", "<article>x", "<li>x", "<ul><li>x", "<p>x<b>", "<table><td>x", "</b><i>x", "<a><h1>x"])
def test_deep_pages_take_linear_time(piece):
    page, started = piece * 50_000, time.process_time()
    kept = 1 if "ad" in piece else 50_000  # of adverts in adverts, what the fewest are around
    assert H.main_text(page + "</nothing>").count("x") == kept
    assert time.process_time() - started < 10


def made_page(random: Random) -> tuple[str, str]:
    """A page of random parts around and inside an article, and the article's text."""
    letters = ["plain", "caf&eacute;|café", "a&amp;b|a&b", "<b>bold</b>|bold", "<a href='#'>link</a>|link", "x<i>y</i>z|xyz", "&lt;tag&gt;|<tag>"]

    def words(n: int) -> tuple[str, str]:
        chosen = [(w.split("|")[0], w.split("|")[-1]) for w in random.choices(letters, weights=[12, 1, 1, 1, 1, 1, 1], k=n)]
        return random.choice((" ", "\n", " \t ")).join(c[0] for c in chosen), " ".join(c[1] for c in chosen)

    def noise() -> str:
        text = words(random.choice((1, 5, 60)))[0]
        return random.choice((
            "<nav><ul><li>{}<li>{}</ul></nav>", "<aside><p>{}</p></aside>", "<div class='ad'><p>{}</p></div>", "<footer>{}</footer>",
            "<div class='cookie-notice'>{}</div>", "<form><label>{}</label><input></form>", "<script>if (a < b) {{ '<p>' }}</script>",
            "<style>p {{}}</style>", "<!-- <p>{}</p> -->", "<section id='comments'><article><p>{}</p></article></section>", "<div role='navigation'>{}</div>",
        )).format(text, text)

    parts, wanted = [], []
    for at in range(random.randint(1, 8)):
        html, text = words(random.choice((1, 4, 30, 120)))
        shape = random.choice(("<p>{}</p>", "<p>{}", "<h2>{}</h2>", "<blockquote><p>{}</p></blockquote>", "<ul><li>{}</ul>", "<table><tr><td>{}</table>"))
        parts.append(shape.format(html))
        wanted.append(text)
        if random.random() < 0.4:
            parts.append(noise())
    frame = random.choice((
        "<article>{}</article>", "<main>{}</main>", "<main><article class='post'>{}</article></main>", "<div class='header-fixed'><article>{}</article></div>",
        "<div id='sidebar-left'><main>{}</main></div>", "<div class='site'><div><article>{}</article></div></div>",
    ))
    before, after = ("".join(noise() for _ in range(random.randint(0, 3))) for _ in range(2))
    return f"<html><head><title>t</title></head><body>{before}{frame.format(''.join(parts))}{after}</body></html>", "\n".join(wanted)


def test_made_pages():
    random = Random(7)
    for _ in range(500):
        page, text = made_page(random)
        assert H.main_text(page) == text, page


def test_chunks_do_not_matter(monkeypatch):
    whole = H.main_text(PAGE)
    monkeypatch.setattr(H, "CHUNK", 7)
    assert H.main_text(PAGE) == whole


def test_extract(spark):
    big = "<article>" + LONG * 5000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (None, "v", big)]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "1 AS text", "2 AS n_chars")
    got = {(r.page_id, r.url): r for r in H.extract(table).collect()}
    assert got[2, None].text == "" and got[2, None].n_chars == 0
    assert got[None, "v"].text == "\n".join([WORDS] * 5000) and got[1, "u"].n_chars == len(H.main_text(PAGE))
    assert H.extract(table).count() == 4 and H.extract(table.limit(0)).count() == 0


URLS = {
    "http://WWW.Example.com/en/1?x=1": ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
    "https://a.b.example.com/en/#t": ("a.b.example.com", "/en/", "example.com/en/", "block"),
    "https://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
    "https://com/": ("com", "/", "com/", "allow"),
    "ftp://x.net/es/a://b": ("x.net", "/es/a://b", "net/es/", "block"),
    "https://x.net/fr": ("x.net", "/fr", None, None),
    "https://x.com?q=/en/": ("x.com", "", None, None),
    "https://ÄX.NET/fr/": ("Äx.net", "/fr/", "net/fr/", "block"),
    "://": ("", "", None, None), "no scheme": ("", "", None, None), "": ("", "", None, None),
    "https://free-casino-bets.org/en/2": ("free-casino-bets.org", "/en/2", None, "block"),
    "https://the-library.org/en/2": ("the-library.org", "/en/2", None, "allow"),
}


def test_urls(spark):
    rows = [(i, u, "") for i, u in enumerate(URLS)] + [(100, None, ""), (None, "http://a.com/", ""), (101, "http://a.com/" + "x" * 10**6, "")]
    table = spark.createDataFrame(rows + rows[:1], PAGES).selectExpr("*", "'x' AS host", "'y' AS features", "'z' AS verdict")
    got = U.judge(table).collect()
    assert len(got) == len(rows) + 1
    by_id = {r.page_id: r for r in got}
    for i, (host, path, rule, verdict) in enumerate(URLS.values()):
        r = by_id[i]
        assert (r.host, r.path, r.rule) == (host, path, rule) and r.verdict == (verdict or r.verdict)
    assert all(r.verdict in ("allow", "block") and 0 <= r.score <= 1 for r in got)
    assert (by_id[100].host, by_id[100].path, by_id[100].rule) == ("", "", None) and by_id[None].rule == "com/"
    assert U.judge(table.limit(0)).count() == 0


def test_model_learns_its_table(spark):
    labelled = U.labelled_urls(spark)
    pages = labelled.selectExpr("monotonically_increasing_id() AS page_id", "url", "verdict AS want")
    want = {r.page_id: r.want for r in pages.collect()}
    got = {r.page_id: "block" if r.score >= 0.5 else "allow" for r in U.judge(pages, rules=()).collect()}
    assert got == want


def expected(rows):
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    return first


def test_warc_round_trip(spark, tmp_path):
    rows = [(5, "http://a/\r\nb", "x"), (3, None, "x"), (9, "u", None), (7, "u", ""), (None, "n", "x"), (1, "u", "é" * 10), (2, "u", "y"), (2, "u", "y")]
    rows += [(100 + i, f"http://h/{i}", f"<p>{i % 40}</p>" * 50) for i in range(200)]
    table = spark.createDataFrame(rows, PAGES).selectExpr("*", "0 AS digest", "1 AS refers_to").repartition(3)
    path = str(tmp_path / "warc")
    W.write_archives(table, path, archive_bytes=4000)
    got = W.read_archives(spark, path, payloads=True).collect()
    assert len(got) == len(rows)
    first, again = expected(rows), 0
    for r in got:
        html = {(i, h or "") for i, _, h in rows if i == r.page_id}
        digest = {base64.b32encode(hashlib.sha1(h.encode()).digest()).decode(): h for _, h in html}
        assert r.payload_digest in digest and r.payload_bytes == len(digest[r.payload_digest].encode())
        if r.record_type == "response":
            assert r.payload.decode() == digest[r.payload_digest] and r.refers_to is None
            assert r.page_id == first[r.payload.decode()]
        else:
            again += 1
            assert r.payload is None and r.refers_to == first[digest[r.payload_digest]]
    assert again == len(rows) - len(first)
    assert {r.url for r in got if r.page_id == 5} == {"http://a/%0D%0Ab"}
    files = [f for f in (tmp_path / "warc").rglob("part-*") if not f.name.startswith(".")]
    assert len(files) > 3
    for file in files:  # real gzip files, one member for each record
        data = file.read_bytes()
        assert b"".join(W.members(data)) == gzip.decompress(data)


def test_warc_of_nothing(spark):
    empty = spark.createDataFrame([], PAGES)
    assert W.round_trip(empty).count() == 0


def test_large_members_end_in_zero():
    import random

    noise = random.Random(1).randbytes(17 << 20)
    packed = W.member(noise)
    assert packed[-1] == 0 and list(W.members(packed + W.member(b"z"))) == [noise, b"z"]


def test_damage_is_found():
    data = W.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), 7, None, False)
    good = W.member(data)
    assert [r["payload"] for r in W.read_archive(good * 2)] == [b"payload"] * 2
    for bad in (W.member(data.replace(b"payload\r", b"paXload\r")), W.member(data[:-3]), good[:-9], W.member(b"HTTP/1.1\r\n\r\n")):
        with pytest.raises(ValueError):
            list(W.read_archive(bad))
