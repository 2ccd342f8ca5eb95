"""Paged listings, sitemaps and pages on small inputs."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pandas as pd
import pytest
from pyspark.sql import functions as F

from loomscore.sources import details, markup, paged, xmlmap

ITEMS = [(k, f"item-{k}", f"Title {k}", None if k % 3 else "2024-02-03", None if k % 10 == 9 else 100 - k) for k in range(100)]


@pytest.fixture(scope="module")
def listing(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('listing')}/pages"
    rows = spark.createDataFrame(ITEMS, "source_id long, slug string, title string, release_date string, score int").withColumn("release_date", F.col("release_date").cast("date"))
    paged.write_pages(rows, path, [F.desc_nulls_last("score"), F.col("source_id")], 7)
    return path


def test_a_listing_comes_back_whole_and_in_order(spark, listing):
    got = paged.read_listing(spark, listing, pages_per_task=2).collect()
    order = sorted(got, key=lambda r: (r.page_offset, r.position))
    assert [r.source_id for r in order] == [x[0] for x in sorted(ITEMS, key=lambda x: (x[4] is None, -(x[4] or 0), x[0]))]
    assert all(r.page_offset % 7 == 0 and r.position < 7 for r in got)
    assert {r.source_id: (r.slug, r.title, r.release_date and str(r.release_date), r.score) for r in got} == {x[0]: x[1:] for x in ITEMS}


def test_one_frame_asked_in_two_ways(spark, listing):
    """A condition of one query is none of another's."""
    rows = paged.read_listing(spark, listing, sort="-score")
    assert rows.filter("score >= 90").union(rows).count() == len([x for x in ITEMS if (x[4] or 0) >= 90]) + 100
    best = paged.read_listing(spark, listing, sort="-score", least_score=90)
    assert best.count() == len([x for x in ITEMS if (x[4] or 0) >= 90]) and rows.count() == 100


def opened(monkeypatch, **options):
    """The offsets that a read opens when it is planned, and those that its tasks open."""
    seen = []
    plain = paged.FilePages.open
    monkeypatch.setattr(paged.FilePages, "open", lambda self, offset: seen.append(offset) or plain(self, offset))
    reader = paged.ListingReader({k: str(v) for k, v in options.items()})
    runs = reader.partitions()
    planned, seen[:] = list(seen), []
    rows = sum(batch.num_rows for run in runs for batch in reader.read(run))
    return planned, sorted(seen), rows, len(runs)


def test_pages_opened(monkeypatch, listing):
    planned, read, rows, runs = opened(monkeypatch, path=listing, pages_per_task=4)
    assert planned == [0] and read == list(range(0, 100, 7)) and (rows, runs) == (100, 4)
    planned, read, rows, _ = opened(monkeypatch, path=listing, sort="-score", least_score=80)
    assert read == [0, 7, 14] and len(planned) <= 5  # 18 items have it; the first page that begins below is not read
    assert opened(monkeypatch, path=listing, sort="-score", least_score=1000)[1:] == ([], 0, 1)
    assert opened(monkeypatch, path=listing, cap=10)[1:] == ([0, 7], 14, 1)
    assert opened(monkeypatch, path=listing, max_pages=3)[1:] == ([0, 7, 14], 21, 1)
    with pytest.raises(ValueError):
        paged.ListingReader({"path": listing, "limit": "0"})


def test_an_empty_listing(spark, tmp_path):
    none = spark.createDataFrame([], "source_id long, slug string, title string, release_date date, score int")
    paged.write_pages(none, f"file://{tmp_path}/none", [F.col("source_id")], 7)
    assert paged.read_listing(spark, f"file://{tmp_path}/none").collect() == []


@pytest.fixture
def address():
    """A source that gives 5 rows a page whatever is asked, and an error past its end."""
    asked = []

    class Answer(BaseHTTPRequestHandler):
        def do_GET(self):
            q = {k: v[0] for k, v in parse_qs(urlparse(self.path).query).items()}
            asked.append(q)
            rows = [x for x in ITEMS if (x[4] or 0) >= int(q["metaScoreMin"])]
            at = int(q["offset"])
            self.send_response(500 if at >= len(rows) else 200)
            self.end_headers()
            items = [{"id": x[0], "slug": x[1], "title": x[2], "releaseDate": "", "criticScoreSummary": {"score": x[4]}} for x in rows[at : at + 5]]
            self.wfile.write(json.dumps({"data": {"totalResults": len(rows), "items": items}}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/finder", asked
    server.shutdown()


def test_an_address_is_asked_for_what_is_wanted(spark, address):
    url, asked = address
    got = paged.read_listing(spark, url, sort="-metaScore", least_score=90, limit=50, pages_per_task=1).collect()
    assert sorted(r.source_id for r in got) == [x[0] for x in ITEMS if (x[4] or 0) >= 90]
    assert {q["metaScoreMin"] for q in asked} == {"90"} and {q["sortBy"] for q in asked} == {"-metaScore"} and {q["limit"] for q in asked} == {"50"}
    assert {int(q["offset"]) for q in asked} == {0, 5}  # the length of pages is measured, nothing past the end is asked for


SHARD = (
    '<?xml version="1.0"?><s:urlset xmlns:s="http://x" xmlns:i="http://i"><s:url><s:loc><![CDATA[https://x/game/a&b/]]></s:loc><i:image><i:loc>https://x/game/no/</i:loc></i:image></s:url>'
    "<s:url><s:loc>\n https://x/game/c&amp;d?x=1/y \n</s:loc></s:url><s:url><s:loc>https://x/movie/e</s:loc></s:url><s:url><s:loc> </s:loc></s:url></s:urlset>"
)


def test_sitemaps(spark, tmp_path):
    index = '<sitemapindex xmlns="http://z"><sitemap><loc>one</loc><lastmod>2024-01-01</lastmod></sitemap><sitemap><loc>one</loc></sitemap><sitemap><loc>none</loc></sitemap></sitemapindex>'
    rows = spark.createDataFrame([(1, SHARD), (2, index), (3, "no <xml"), (4, None), (5, "<urlset/>")], "k int, body string")
    got = sorted(tuple(r) for r in xmlmap.sitemap_places(rows, "k").select("k", "position", "loc").collect())
    assert got == [(1, 0, "https://x/game/a&b/"), (1, 1, "https://x/game/c&d?x=1/y"), (1, 2, "https://x/movie/e"), (2, 0, "one"), (2, 1, "one"), (2, 2, "none")]
    assert sorted(r.slug for r in xmlmap.sitemap_slugs(rows).collect()) == ["a&b", "c&d"]
    shards = spark.createDataFrame([("one", SHARD), ("other", SHARD.replace("/game/", "/game/z"))], "address string, body string")
    assert sorted(tuple(r) for r in xmlmap.indexed_slugs(rows.filter("k = 2"), shards).collect()) == [("one", "a&b"), ("one", "c&d")]
    (tmp_path / "a.xml").write_text("<urlset>" + "".join(f"<url><loc><![CDATA[https://x/game/a&{k}]]></loc></url>" for k in range(500)) + "</urlset>")
    assert sorted(r.loc for r in xmlmap.read_shard_files(spark, f"file://{tmp_path}").collect()) == sorted(f"https://x/game/a&{k}" for k in range(500))


PAGE = (
    '<html><head><meta property="og:title" content="T &amp; U"><meta NAME="x" content="1"><meta name="x" content="2"><meta charset="utf-8">'
    '<script type="application/ld+json">bad{</script><script type="application/ld+json">[1, {"@type":"Other"}, {"@type":"Product","name":"P"}]</script>'
    '<script type="application/ld+json">{"@graph":[{"@type":"Game","name":"late"}]}</script></head>'
    '<div data-testid="a"><div>1</div> tail <span data-testid="b">x<br>y</span></div><p data-testid="c">one<p data-testid="d">two</i></div><img data-testid="e"/><b data-testid="f">open <i>end'
)


def test_elements(spark):
    rows = spark.createDataFrame([(1, PAGE), (2, None), (3, ""), (4, "<p>no ids")], "k int, html string")
    found = markup.page_elements(rows, "k")
    got = [(r.testid, r.tag, r.text) for r in sorted(found.collect(), key=lambda r: r.position) if r.testid]
    assert got == [("a", "div", "1 tail xy"), ("b", "span", "xy"), ("c", "p", "one"), ("d", "p", "twoopen end"), ("e", "img", ""), ("f", "b", "open end")]
    parents = {r.testid: r.parent for r in found.collect() if r.testid}
    places = {r.testid: r.position for r in found.collect() if r.testid}
    assert parents["b"] == places["a"] and parents["c"] == parents["d"] == parents["a"]
    assert {(r.name, r.content) for r in markup.meta_tags(found, "k").collect()} == {("og:title", "T & U"), ("x", "2")}
    assert [(r.position, r.place) for r in markup.json_ld(found, "k").orderBy("position", "place").collect()] == [(7, 1), (7, 2), (8, 0)]
    assert [tuple(r)[1:3] for r in markup.found_items(found, "k").collect()] == [("Product", "P")]
    assert markup.page_elements(rows, "k", every=True).filter("k = 4").count() == 1
    assert markup.page_elements(rows.limit(0), "k").collect() == []
    assert [r[0] for r in spark.createDataFrame([("Score 8.5 of 10",), ("none",), (None,)], "x string").select(markup.testid_score("x")).collect()] == [8.5, None, None]


def test_large_files_of_lines(spark, tmp_path):
    (tmp_path / "lines.json").write_text("".join(f'{{"x": {k}}}\n' for k in range(300)))
    (tmp_path / "whole.json").write_text('{"x":\n\n 1000}\n')
    got = details.read_payloads(spark, str(tmp_path))
    assert sorted(json.loads(r.body)["x"] for r in got.collect()) == [*range(300), 1000]


def test_references_without_a_semicolon_stand_as_they_are(spark):
    """Text that was cut within a reference; other ampersands, in attributes and scripts too."""
    html = '<h1>a &amp;&amp;&amp</h1><p data-testid="x" title="?a=1&copy=2&amp;b">&ampere; &#65; &#66 &notit;  R&D</p><script>a &amp;&& b</script>&lt'
    rows = markup.page_elements(spark.createDataFrame([(1, html)], "k long, html string"), "k", every=True).orderBy("position").collect()
    assert [r.text for r in rows] == ["a &&&amp", "&ampere; A &#66 &notit;  R&D", ""]
    assert rows[1].attributes["title"] == "?a=1&copy=2&b" and rows[2].raw == "a &amp;&& b"


def test_elements_are_handed_on_in_small_frames():
    pages = pd.DataFrame({"key": range(6_000), "html": ["<p data-testid='a'>" + "x" * 1_000 + "</p><p data-testid='b'>"] * 6_000})
    columns = ["key", *(x.split(" ")[0] for x in markup._SHAPE.split(", "))]
    frames = list(markup._walked(iter([pages, pages.iloc[:1]]), columns, False))
    assert [k for f in frames for k in f["key"]] == [k for k in [*range(6_000), 0] for _ in "ab"]
    assert max(map(len, frames)) < 2_000  # before, all elements of a frame of pages were one
