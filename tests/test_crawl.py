"""Best-first crawls against one plain queue a site."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from dossier.operators import crawl

LINK = "src string, ord int, dst string, priority long, strong boolean, weak boolean, skip boolean"


def plain(site, seeds, pages, links, most, depth):
    """The queue as one would write it for one site."""
    heap, tie, seen, got, fetched = [], 0, set(), [], 0

    def push(url, d, p):
        nonlocal tie
        tie += 1
        heapq.heappush(heap, (-p, tie, url, d))

    for url, p in seeds:
        push(url, 0, p)
    while heap and fetched < most:
        rank, _, url, d = heapq.heappop(heap)
        host = url.split("://")[1].split("/")[0]
        if url in seen or not (host == site or host.endswith("." + site)) or "/careers" in url:
            continue
        seen.add(url)
        if url not in pages:
            continue
        fetched += 1
        got.append((site, fetched, url, d, -rank))
        for dst, p, strong, weak in links.get(url, []):
            if d < depth and dst not in seen and "/careers" not in dst and (strong or (weak and d <= 1)):
                push(dst, d + 1, p + 5 * strong)
    return got


def graph(n, seed):
    rng = random.Random(seed)
    urls = [f"http://{rng.choice(['', 'www.'])}{rng.choice('ab')}.org/{'careers/' if rng.random() < 0.1 else ''}p{i}" for i in range(n)]
    links = {u: [(rng.choice(urls), rng.randrange(4), rng.random() < 0.5, rng.random() < 0.5) for _ in range(rng.randrange(8))] for u in urls}
    return urls, links


@pytest.mark.parametrize(("most", "depth", "ahead"), [(250, 3, 32), (20, 9, 6)])
def test_equals_a_plain_queue(spark, most, depth, ahead):
    urls, links = graph(120, most)
    pages = set(urls[:100])
    seeds = [(s, u, 100 - i // 2, i) for s in ("a.org", "b.org") for i, u in enumerate(urls[:6])] + [("none.org", "http://none.org/x", 1, 0)]
    rows = [(u, i, d, p, s, w, "/careers" in d) for u, ls in links.items() for i, (d, p, s, w) in enumerate(ls)]
    got = crawl.best_first(spark.createDataFrame(seeds, "site string, url string, priority long, ord int"), spark.createDataFrame([(u,) for u in pages], "url string"), spark.createDataFrame(rows, LINK), most, depth, ahead)
    want = [r for s in ("a.org", "b.org") for r in plain(s, [(u, p) for t, u, p, _ in seeds if t == s], pages, links, most, depth)]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) > 5


def test_links_are_weighed_by_their_terms(spark):
    rows = [("s", 1, "http://a.org/project/wind", "Permit"), ("s", 2, "http://a.org/careers/project", None), ("s", 3, "http://a.org/about", "x"), ("s", 4, "http://a.org/zzz", "x")]
    got = {r.ord: (r.priority, r.strong, r.weak, r.skip) for r in crawl.weigh(spark.createDataFrame(rows, "src string, ord int, dst string, label string")).collect()}
    assert got[1] == (3 + 2 + 1, True, True, False) and got[2][3] and got[3][1:] == (False, True, False) and got[4][1:] == (False, False, False)


def test_sitemaps_and_their_index(spark):
    loc = lambda *u: "".join(f"<url><loc> {x} </loc></url>" for x in u)
    rows = [("a.org", 1, loc("http://a.org/projects", "http://a.org/zzz", "http://a.org/news/projects"), None), ("a.org", 2, "<sitemapindex>" + loc("c1", "c2"), [loc("http://a.org/wind"), loc("http://a.org/mine"), loc("http://a.org/permits")])]
    df = spark.createDataFrame(rows, "site string, ord int, body string, children array<string>")
    got = [r.url for r in crawl.sitemap_seeds(df, children=2).orderBy("ord").collect()]
    assert got == ["http://a.org/projects", "http://a.org/wind", "http://a.org/mine"]
    assert crawl.sitemap_seeds(df, most=1).count() == 1


def test_waves_cut_their_lineage(spark):
    e = spark.range(50).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(1).alias("priority"), F.lit(True).alias("strong"))
    seeds = spark.createDataFrame([("s", 0)], "site string, url long")
    deep = crawl.frontier(seeds, e, depth=8)
    assert deep.count() == 9 and deep._jdf.queryExecution().analyzed().toString().count("Join") == 0
