"""Best-first search against a priority queue."""

import heapq
import random

import pytest

from spindrift.operators import search


def heap(pages, links, seeds, turns, per_host, depth, candidates, relay):
    """One search: pages {id: (host, own)}, links {id: [(target, score)]} in order, seeds {id: score}."""
    queue = [(-s, p, 0) for p, s in seeds.items()]
    heapq.heapify(queue)
    best, found, seen, hosts, out = dict(seeds), set(seeds), set(), {}, []
    while queue and len(out) < turns:
        score, page, d = heapq.heappop(queue)
        if page in seen or -score < best.get(page, -1):
            continue
        host, own = pages[page]
        if hosts.get(host, 0) >= per_host:
            continue
        seen.add(page)
        hosts[host] = hosts.get(host, 0) + 1
        out.append((len(out), page, round(-score, 9), d))
        if d >= depth:
            continue
        told = {}
        for target, s in links.get(page, []):
            told[target] = max(told.get(target, 0.0), s)
        for target, s in told.items():
            worth = min(1.0, s + relay * own)
            if target in seen or target not in pages:
                continue
            if target not in found:
                if len(found) >= candidates:
                    continue
                found.add(target)
            elif best.get(target, -1) >= worth:
                continue
            best[target] = worth
            heapq.heappush(queue, (-worth, target, d + 1))
    return out


@pytest.mark.parametrize("seed,candidates", [(1, 1000), (2, 9)])
def test_equals_a_heap_on_random_graphs(spark, seed, candidates):
    rng = random.Random(seed)
    n = 40
    pages = {i: (f"h{rng.randrange(8)}", rng.random()) for i in range(n)}
    links = {i: [(rng.randrange(n), rng.choice([0.1, 0.5, rng.random()])) for _ in range(5)] for i in range(n)}
    searches = {f"s{k}": {rng.randrange(n): rng.random() for _ in range(2)} for k in range(4)}
    p = spark.createDataFrame([(i, h, o) for i, (h, o) in pages.items()], "page_id long, host string, own double")
    rows = [(i, t, i * 100 + k, s) for i, ts in links.items() for k, (t, s) in enumerate(ts)]
    e = spark.createDataFrame(rows, "source_page_id long, target_page_id long, position long, score double")
    s = spark.createDataFrame([(k, i, v) for k, ss in searches.items() for i, v in ss.items()], "search string, page_id long, score double")
    got = {}
    for r in search.best_first(p, e, s, 6, 2, 3, candidates, 0.4).orderBy("search", "turn").collect():
        got.setdefault(r.search, []).append((r.turn, r.page_id, round(r.score, 9), r.depth))
    assert got == {k: heap(pages, links, ss, 6, 2, 3, candidates, 0.4) for k, ss in searches.items()}


def test_a_better_score_moves_a_page_up_and_voids_the_older_entry(spark):
    p = spark.createDataFrame([(i, f"h{i}", o) for i, o in ((1, 0.0), (2, 1.0), (3, 0.5), (4, 0.0))], "page_id long, host string, own double")
    e = spark.createDataFrame([(1, 3, 0, 0.2), (1, 2, 1, 0.9), (1, 4, 2, 0.3), (2, 3, 3, 0.4)], "source_page_id long, target_page_id long, position long, score double")
    s = spark.createDataFrame([("q", 1, 0.1)], "search string, page_id long, score double")
    got = [(r.page_id, round(r.score, 2), r.depth) for r in search.best_first(p, e, s, 9).orderBy("turn").collect()]
    assert got == [(1, 0.1, 0), (2, 0.9, 1), (3, 0.7, 2), (4, 0.3, 1)]
    assert search.best_first(p, e, s.limit(0), 3).collect() == []
