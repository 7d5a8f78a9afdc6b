"""Bounded, best-first crawls over a static graph of links: one wave a level, or a
priority queue for each site."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text, web
from ..plans.cut import cut

# Pages a site, depth of links, what a seed, a home page and a strong term add to a priority.
PAGES, DEPTH = 250, 3
SEED, HOME, STRONG_MORE = 100, 50, 5


def frontier(seeds: DataFrame, links: DataFrame, depth: int = 3, pages: int = 250, weak_depth: int = 1) -> DataFrame:
    """Pages reached from seeds (site, url): site, url, depth, priority.

    links: src, dst, priority, strong (weak links count up to ``weak_depth``).
    Each wave takes the unseen targets of the last, best priority first, then by
    url, while the site's budget of ``pages`` lasts.  What has been seen is cut from
    its lineage after every wave."""
    seen = seeds.select("site", "url", F.lit(0).alias("depth"), F.lit(0).cast("long").alias("priority")).distinct()
    wave = seen
    for d in range(1, depth + 1):
        edges = links.select("src", "dst", F.col("priority").alias("weight"), "strong")
        found = wave.select("site", F.col("url").alias("src")).join(edges.where("strong") if d > weak_depth else edges, "src")
        found = found.groupBy("site", F.col("dst").alias("url")).agg(F.max("weight").cast("long").alias("priority"))
        found = found.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        used = seen.groupBy("site").agg(F.count("*").alias("used"))
        rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("priority"), "url"))
        wave = found.withColumn("rn", rank).join(used, "site").where(F.col("rn") + F.col("used") <= pages).select("site", "url", F.lit(d).alias("depth"), "priority")
        both = cut(seen.withColumn("new", F.lit(False)).unionByName(wave.withColumn("new", F.lit(True))))
        seen, wave = both.drop("new"), both.where("new").drop("new")
    return seen


def weigh(links: DataFrame) -> DataFrame:
    """Links (src, ord, dst, label) with priority, strong, weak and skip, as their terms
    say."""
    url, label = F.col("dst"), F.coalesce("label", F.lit(""))
    both = F.concat_ws(" ", url, label)
    has = lambda c, pattern: F.coalesce(c.rlike(f"(?i){pattern}"), F.lit(False))
    return links.select("src", "ord", "dst", web.priority(url, label).cast("long").alias("priority"), has(both, web.STRONG).alias("strong"), has(both, web.WEAK).alias("weak"), has(url, web.SKIP).alias("skip"))


STATE = "site string, state string, asks array<string>"


class Queue:
    """A site's queue: best priority first, first come first among equals.  Pages whose
    links aren't known yet are asked for, ``ahead`` of them at once."""

    def __init__(self, state: str | None, pages: int, depth: int, ahead: int):
        self.pages, self.depth, self.ahead = pages, depth, ahead
        kept = json.loads(state) if state else {"heap": [], "tie": 0, "seen": [], "got": [], "known": {}}
        self.heap = [tuple(x) for x in kept["heap"]]
        self.tie, self.got, self.known = kept["tie"], kept["got"], kept["known"]
        self.seen = set(kept["seen"])
        self.fetched = sum(g[3] for g in self.got)

    def push(self, url: str, depth: int, priority: int, skip: bool, inside: bool) -> None:
        self.tie += 1
        if url not in self.seen and inside and not skip:  # what would be passed over anyway
            heapq.heappush(self.heap, (-priority, self.tie, url, depth))

    def run(self) -> list[str]:
        """Goes on as far as pages are known; returns what to ask for."""
        while self.heap and self.fetched < self.pages:
            rank, _, url, depth = self.heap[0]
            if url not in self.seen:
                if url not in self.known:
                    break
                links = self.known.pop(url)
                self.seen.add(url)
                # a page that isn't there takes no part of the budget
                self.got.append((url, depth, -rank, links is not None))
                self.fetched += links is not None
            else:
                links = []
            heapq.heappop(self.heap)
            for dst, priority, strong, weak, skip, inside in links or []:
                if depth < self.depth and (strong or (weak and depth <= 1)):
                    self.push(dst, depth + 1, priority + STRONG_MORE * strong, skip, inside)
        if self.fetched >= self.pages:
            return []
        asks: dict[str, None] = {}
        for _, _, url, _ in heapq.nsmallest(self.ahead * 2, self.heap):
            if url not in self.seen and url not in self.known and len(asks) < self.ahead:
                asks[url] = None
        return list(asks)

    def state(self) -> str:
        return json.dumps({"heap": self.heap, "tie": self.tie, "seen": sorted(self.seen), "got": self.got, "known": self.known})


def best_first(seeds: DataFrame, pages: DataFrame, links: DataFrame, most: int = PAGES, depth: int = DEPTH, ahead: int = 32) -> DataFrame:
    """The pages that a queue for each site fetches: site, place (from 1), url, depth and
    priority, as a plain queue would, for all sites at once.

    seeds: site (a host's apex), url, priority, ord (the order in which they are put
    in); pages: url of those that are there; links: src, ord, dst, priority, strong, weak
    and skip (see ``weigh``).  Links out of the site or to skipped paths are not taken,
    weak ones down to depth 1, strong ones with more weight and to ``depth``.  A site
    fetches ``most`` pages; pages that aren't there don't count and aren't returned.

    A round takes every site's queue as far as the links of its pages are known and asks
    for the next ``ahead`` best pages; their links come by a join, so a task holds the
    queue of one site, which its budget bounds, and never the graph.  Nothing but the
    question whether anybody asks reaches the driver.
    """
    link = F.struct("ord", "dst", "priority", "strong", "weak", "skip")
    out = links.groupBy(F.col("src").alias("url")).agg(F.array_sort(F.collect_list(link)).alias("links"))
    there = cut(pages.select("url").distinct().join(out, "url", "left").select("url", F.coalesce("links", F.array().cast(out.schema["links"].dataType)).alias("links")))

    def begin(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        queue = Queue(None, most, depth, ahead)
        for url, priority, skip, inside in frame.sort_values("ord")[["url", "priority", "skip", "inside"]].itertuples(index=False, name=None):
            queue.push(url, 0, int(priority), bool(skip), bool(inside))
        return pd.DataFrame([(key[0], queue.state(), queue.run())], columns=["site", "state", "asks"])

    def step(key: tuple, states: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(states):
            return pd.DataFrame(columns=["site", "state", "asks"])
        queue = Queue(states["state"].iloc[0], most, depth, ahead)
        for url, there_, rows in found[["url", "there", "links"]].itertuples(index=False, name=None):
            queue.known[url] = [(r["dst"], int(r["priority"]), bool(r["strong"]), bool(r["weak"]), bool(r["skip"]), bool(r["inside"])) for r in rows] if there_ else None
        asks = queue.run()
        return pd.DataFrame([(key[0], queue.state(), asks)], columns=["site", "state", "asks"])

    inside = lambda url, site="site": F.coalesce(text.same_site(url, F.col(site)), F.lit(False))
    first = seeds.select("site", "url", "priority", "ord", F.coalesce(F.col("url").rlike(f"(?i){web.SKIP}"), F.lit(False)).alias("skip"), inside(F.col("url")).alias("inside"))
    state = cut(first.groupBy("site").applyInPandas(begin, STATE))
    while state.where(F.size("asks") > 0).first() is not None:
        asked = state.select(F.col("site").alias("owner"), F.explode("asks").alias("url"))
        found = asked.join(there, "url", "left").select("owner", "url", F.col("links").isNotNull().alias("there"), F.transform(F.coalesce("links", F.array().cast(out.schema["links"].dataType)), lambda x: F.struct(x["dst"].alias("dst"), x["priority"].alias("priority"), x["strong"].alias("strong"), x["weak"].alias("weak"), x["skip"].alias("skip"), inside(x["dst"], "owner").alias("inside"))).alias("links"))
        state = cut(state.groupBy("site").cogroup(found.groupBy("owner")).applyInPandas(step, STATE))

    def told(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for site, kept in frame[["site", "state"]].itertuples(index=False, name=None):
                got = [g for g in json.loads(kept)["got"] if g[3]]
                rows += [(site, i, url, depth_, priority) for i, (url, depth_, priority, _) in enumerate(got, 1)]
            yield pd.DataFrame(rows, columns=["site", "place", "url", "depth", "priority"])

    return state.mapInPandas(told, "site string, place long, url string, depth int, priority long")


def sitemap_seeds(sitemaps: DataFrame, children: int = 15, most: int = 4 * PAGES) -> DataFrame:
    """Seeds (site, url, priority, ord) of sitemaps (site, ord, body, children
    array<string>): the bodies of an index's first ``children`` sitemaps are given with
    it.  Topical urls that aren't skipped count, the first ``most`` of a site, by their
    terms."""
    loc = lambda body: F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))
    below = F.flatten(F.transform(F.slice(F.coalesce("children", F.array().cast("array<string>")), 1, children), loc))
    urls = F.when(F.contains("body", F.lit("<sitemapindex")), below).otherwise(loc(F.col("body")))
    rows = sitemaps.select("site", F.col("ord").alias("map"), F.posexplode(urls).alias("at", "url"))
    topical = F.col("url").rlike(f"(?i){web.STRONG}|{web.WEAK}") & ~F.col("url").rlike(f"(?i){web.SKIP}")
    place = F.row_number().over(Window.partitionBy("site").orderBy("map", "at"))
    return rows.where(topical).withColumn("ord", place).where(F.col("ord") <= most).select("site", "url", web.priority(F.col("url"), F.lit("")).cast("long").alias("priority"), "ord")
