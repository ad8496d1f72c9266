"""Components with hubs, and the join that sets hot keys apart."""

import random

from marketlake.llm import components as comp
from marketlake.llm import simhash


def test_join_hot_is_the_plain_join(llm):
    rows = llm.createDataFrame([(1, i) for i in range(5000)] + [(i, i) for i in range(2, 3000)], "a long, x long")
    known = rows.groupBy("a").count().where("a % 7 <> 0").selectExpr("a", "a * 10 AS m", "count AS n")
    got = comp.join_hot(rows, known, "a", rows.count())
    want = rows.join(known.drop("n"), "a")
    assert sorted(map(tuple, got.select("a", "x", "m").collect())) == sorted(map(tuple, want.select("a", "x", "m").collect()))
    assert known.where(f"n * {comp.HOT} >= {rows.count()}").count() == 1
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()
    assert comp.join_hot(rows.limit(0), known.limit(0), "a", 0).count() == 0


def test_hubs_and_chains(llm):
    rng = random.Random(4)
    links = [(50_000, i) for i in range(4000)]  # a hub that is not the smallest of its links
    links += [(100_000 + i, 100_001 + i) for i in range(300)]  # a chain
    links += [(rng.randrange(200_000, 200_400), rng.randrange(200_000, 200_400)) for _ in range(300)]
    links += links[:50] + [(7, 7)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    for a, b in links:
        if a != b:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    got = comp.components(llm.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.root for r in got} == {x: find(x) for x in parent} and len(got) == len(parent)
    assert comp.components(llm.createDataFrame([], "a long, b long")).count() == 0


def test_one_text_in_most_rows(llm):
    rows = [(i, "the same text in very many rows") for i in range(3000)] + [(5000 + i, None) for i in range(1000)]
    rows += [(9000 + i, f"alone {i} with other words {i * i} here") for i in range(200)]
    got = {r.doc_id: r.component_id for r in simhash.near_duplicates(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows) and all(got[i] == 0 for i in range(3000)) and all(got[5000 + i] == 5000 for i in range(1000))
