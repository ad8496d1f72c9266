"""URL rules over many ranges: brute force, hot hosts, rules that span ranges."""

import random

import pytest

from marketlake.llm import url_rules


def brute(host, path, rules):
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return (best[3], best[2]) if best else (None, "allow")


@pytest.mark.parametrize("ranges", ["1", "7", "40"])
def test_many_rules_and_a_hot_host(llm, ranges):
    rng = random.Random(int(ranges))
    labels = ["a", "b", "c", "a-b", "x1", "net", "com"]
    name = lambda k: ".".join(rng.choice(labels) for _ in range(k))
    rules = {(name(rng.randint(1, 4)), rng.choice(["/", "/a", "/a/b", ""])): rng.choice(["allow", "block"]) for _ in range(150)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [(i, f"http://{name(rng.randint(1, 5)).title()}{rng.choice(['/', '/a/b/c', '/ab', '?q', ''])}") for i in range(1500)]
    urls += [(i, f"https://hot.b.a/{'a/' * (i % 3)}{i}") for i in range(1500, 3000)]
    urls += [(5000, None), (5001, "no address"), (5002, "x://"), (None, "s://a.com/"), (1, urls[1][1]), (5003, "h://a.b/" + "z" * 200_000)]
    before = llm.conf.get("spark.sql.shuffle.partitions")
    llm.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        pages = llm.createDataFrame([(*u, 1, "k") for u in urls], "page_id long, url string, depth int, key string")
        frame = llm.createDataFrame(rules + rules[:9] + [(None, "/", "block"), ("a", None, "allow")], "host string, path string, verdict string")
        got = url_rules.judge(pages, frame).collect()
        assert url_rules.judge(pages, frame.limit(0)).where("rule IS NULL AND verdict = 'allow'").count() == len(urls)
        assert url_rules.judge(pages.limit(0), frame).count() == 0
    finally:
        llm.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(r.page_id or -1 for r in got) == sorted(u[0] or -1 for u in urls)
    for r in got:
        assert (r.rule, r.verdict) == brute(r.host, r.path, rules), r.host


def test_a_rule_is_carried_only_into_ranges_that_it_spans(llm):
    pages = llm.range(4000).selectExpr("id AS page_id", "concat('h://s', id, '.com/') AS url")
    rules = llm.createDataFrame([("com", "/", "block")] + [(f"s{i}.com", "/", "allow") for i in range(0, 4000, 2)],
                                "host string, path string, verdict string")
    seen = []
    carried = url_rules._carried
    url_rules._carried = lambda both, deepest: seen.append(carried(both, deepest)) or seen[-1]
    try:
        got = url_rules.judge(pages, rules).groupBy("verdict").count().collect()
    finally:
        url_rules._carried = carried
    assert {r.verdict: r["count"] for r in got} == {"allow": 2000, "block": 2000}
    ranges = int(llm.conf.get("spark.sql.shuffle.partitions"))
    assert 0 < seen[0].count() <= 2 * ranges  # not one row per rule and range
