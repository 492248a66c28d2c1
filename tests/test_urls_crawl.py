import random
from collections import deque
from urllib.parse import urljoin

import pytest
from pyspark.sql import functions as F

from glyphmill.functions import urls
from glyphmill.operators import crawl
from glyphmill.sources.pages import HttpFetcher, PageStore


def _each(spark, function, rows):
    schema = ", ".join(f"c{i} string" for i in range(len(rows[0])))
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i")
    return [r[0] for r in df.select(function(*[F.col(f"c{i}") for i in range(len(rows[0]))])).collect()]


def test_url_functions(spark):
    assert _each(spark, urls.same_host, [("http://H.com:80/a", "http://h.com/a"), ("http://h/", "mailto:a@b"), ("http://u@h:1/x", "https://u@h:1/y z")]) == [False, False, True]
    assert _each(spark, urls.is_downloadable, [("x/A.PNG?x=1",), ("a.png#f",), ("a.gif",)]) == [True, False, False]
    names = ["http://h/", "http://h/a/", "http://h/a/..", "http://h/.", "http://h/a.png;v=1", "http://h/한 글.png", "http://h/한 a%20b(1).png", "http://h"]
    assert _each(spark, urls.safe_filename, [(n,) for n in names]) == ["download", "a", "..", "download", "a.png", "_.png", "_a_20b_1_.png", "download"]
    assert _each(spark, urls.resolve_link, [("http://h/a/b", "../c?x#y"), ("http://h/a/b", "mailto:q"), ("http://h/a/b", "//o/z"), ("http://h", "http://[bad")]) == ["http://h/c?x#y", "mailto:q", "http://o/z", None]
    assert _each(spark, urls.is_html, [(None, ""), ("text/plain", " <HTML"), ("text/plain", "x"), ("Text/HTML; x", "")]) == [True, True, False, True]


def test_links():
    html = '<img src="i.png"><A HREF=\'x?a&amp;b\'>t</a><a name="n"><a href>e</a><img alt="no"><a\nhref=y>'
    assert crawl.links_of(html) == [(0, 0, "x?a&b"), (0, 1, ""), (0, 2, "y"), (1, 0, "i.png")]
    assert crawl.links_of(None) == []


def plain(site, seed, max_pages, max_downloads, same_host):
    """The crawl by a plain queue."""
    queue, visited, events, pages, downloads = deque([seed]), [], [], 0, 0
    while queue and pages < max_pages and downloads < max_downloads:
        url = queue.popleft()
        if url in visited:
            continue
        visited.append(url)
        if url not in site:
            events.append(("page_error", url))
            continue
        kind, body = site[url]
        pages += 1
        if url.endswith((".png", ".pdf")) or kind.startswith("image/"):
            downloads += 1
            events.append(("download", url))
        elif kind in ("", "text/html"):
            for _, _, link in crawl.links_of(body):
                to = urljoin(url, link)
                if not same_host or to.startswith("http://h/"):
                    queue.append(to)
    return visited, events, pages, downloads


def _check(spark, site, seed="http://h/0", **options):
    table = spark.createDataFrame([(u, k, b) for u, (k, b) in site.items()], "url string, content_type string, body string")
    full = {"max_pages": 50, "max_downloads": 200, "same_host_only": True} | options
    got = crawl.crawl(spark, seed, PageStore(table), **full)
    visited, events, pages, downloads = plain(site, seed, full["max_pages"], full["max_downloads"], full["same_host_only"])
    assert {r.url for r in got.visited.collect()} == set(visited)
    assert [(r.type, r.url) for r in got.events.orderBy("level", "ord").collect()] == events
    assert (got.pages, got.downloads) == (pages, downloads)
    return got


def test_small_sites(spark):
    page = lambda *links: ("text/html", "".join(f'<img src="{x}">' if x.endswith("png") else f'<a href="{x}">' for x in links))
    site = {"http://h/0": page("i.png", "1", "1", "gone", "http://o/x", "1#x"), "http://h/1": page("0", "2"), "http://h/2": page("i.png"), "http://h/i.png": ("image/png", ""), "http://h/1#x": page(), "http://o/x": page("y")}
    got = _check(spark, site)
    assert [r.path for r in got.events.filter("type = 'download'").collect()] == ["out/downloads/i.png"]
    _check(spark, site, same_host_only=False)
    _check(spark, site, max_pages=2)
    _check(spark, site, max_downloads=1)
    _check(spark, site, max_pages=0)


@pytest.mark.parametrize("seed", range(3))
def test_random_sites(spark, seed):
    rng = random.Random(seed)
    names = [f"http://h/{i}{rng.choice(['', '', '.png'])}" for i in range(14)] + ["http://o/1"]
    site = {n: (rng.choice(["text/html", "", "image/x"]) if i else "text/html", "".join(f"<a href='{rng.choice(names)}'>" if rng.random() < 0.7 else f"<img src='{rng.choice(names)}'>" for _ in range(5))) for i, n in enumerate(names) if i == 0 or rng.random() < 0.8}
    _check(spark, site, names[0], max_pages=rng.randint(2, 12), max_downloads=rng.randint(1, 5), same_host_only=rng.random() < 0.5)


def test_writes(spark, tmp_path):
    table = spark.createDataFrame([("http://h/0", "text/html", '<a href="a/x.png"><a href="b/x.png"><a href="/a/..">', None), ("http://h/a/x.png", "image/png", None, bytearray(b"1")), ("http://h/b/x.png", "image/png", None, bytearray(b"2")), ("http://h/a/..", "image/png", None, bytearray(b"3")), ("http://h/", "image/png", None, bytearray(b"4"))], "url string, content_type string, body string, content binary")
    folder = str(tmp_path / "downloads")
    got = crawl.crawl(spark, "http://h/0", PageStore(table), str(tmp_path), write=crawl.file_writer(folder))
    events = {(r.type, r.url) for r in got.events.collect()}
    assert ("download", "http://h/a/x.png") in events and ("download", "http://h/b/x.png") in events
    assert got.pages == 4 and (tmp_path / "downloads" / "x.png").exists()
    crawl.append_events(got, str(tmp_path / "meta"))
    crawl.append_events(got, str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 2 * got.events.count()


@pytest.mark.parametrize("most", [1, 2, 3, 9])
def test_files_on_disk_are_the_downloads(spark, tmp_path, most):
    rows = [("http://h/0", "text/html", '<a href="a/x.png"><a href="a/..png/"><a href="b/y.png"><a href="c/x.png"><a href="d/z.png">', None)]
    rows += [(f"http://h/{p}", "image/png", None, bytearray(p.encode())) for p in ("a/x.png", "b/y.png", "c/x.png", "d/z.png")] + [("http://h/a/..png/", "image/png", None, bytearray(b"?"))]
    table = spark.createDataFrame(rows, "url string, content_type string, body string, content binary")
    folder = tmp_path / "downloads"
    folder.mkdir()
    (folder / "y.png").mkdir()  # cannot be written
    got = crawl.crawl(spark, "http://h/0", PageStore(table), str(tmp_path), max_downloads=most, write=crawl.file_writer(str(folder)))
    events = [(r.type, r.url.removeprefix("http://h/")) for r in got.events.orderBy("level", "ord").collect()]
    every = [("download", "a/x.png"), ("download", "a/..png/"), ("download_error", "b/y.png"), ("download", "c/x.png"), ("download", "d/z.png")]
    want = every[: {1: 1, 2: 2, 3: 4, 9: 5}[most]]
    assert events == want and got.downloads == sum(k == "download" for k, _ in want)
    files = {f.name: f.read_bytes().decode() for f in folder.iterdir() if f.is_file()}
    assert files == {urls_name: p for urls_name, p in (("x.png", "c/x.png" if most > 2 else "a/x.png"), ("..png", "?"), ("z.png", "d/z.png")) if any(k == "download" and u.rstrip("/").endswith(urls_name) for k, u in want)}


def test_one_page_for_each_url(spark):
    rows = [("u", "text/html", "b"), ("u", "text/html", "a"), ("u", "x", "a")]
    for order in (rows, rows[::-1]):
        pages = PageStore(spark.createDataFrame(order, "url string, content_type string, body string").repartition(3, "body"))
        assert [(r.url, r.content_type, r.body) for r in pages.fetch(spark.createDataFrame([("u",)], "url string")).collect()] == [("u", "text/html", "a")]


def test_budget_over_many_ranges(spark):
    rng = random.Random(8)
    rows = [([i // 7, i], i, rng.random() < 0.7, rng.random() < 0.3) for i in range(200)]
    level = spark.createDataFrame([(o, i, ok, ok and d) for o, i, ok, d in rows], "ord array<bigint>, i int, ok boolean, downloaded boolean").repartition(5)
    for most_pages, most_downloads in ((50, 1000), (1000, 11), (0, 5), (1000, 1000)):
        want, p, d = [], 3, 2
        for _, i, ok, hit in rows:
            if p >= most_pages or d >= most_downloads:
                break
            want.append(i)
            p, d = p + ok, d + (ok and hit)
        got = crawl.within_budget(level, most_pages, most_downloads, 3, 2)
        assert sorted(r.i for r in got.collect()) == want and got.columns == level.columns


def test_http_errors_are_rows(spark):
    rows = spark.createDataFrame([("http://127.0.0.1:9/x",)], "url string")
    got = HttpFetcher(timeout=1.0).fetch(rows).first()
    assert not got.ok and got.error
