"""Partition overwrite, observed loads, rules by their beginnings, silent jobs."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from staygrid.plans import crawl
from staygrid.sources import sinks


def files(path):
    return {os.path.join(d, n) for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_replaced_partitions(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = [(k, i) for i in range(60) for k in [*range(12), None]]
    sinks.store_by_key(spark.createDataFrame(rows, "k int, v int"), path, "k", 8)
    before = files(path)
    batch = spark.createDataFrame([(3, 100), (3, 101), (99, 7), (None, 8)], "k int, v int")
    sinks.replace_partitions(batch, path, "k", 8)
    want = sorted([(k, v) for k, v in rows if k not in (3, None)] + [(3, 100), (3, 101), (99, 7), (None, 8)], key=str)
    read = lambda: sorted([(r.k, r.v) for r in spark.read.parquet(path).collect()], key=str)
    assert read() == want
    touched = {r.b for r in spark.createDataFrame([(3,), (99,), (None,)], "k int").select(F.pmod(F.xxhash64("k"), F.lit(8)).alias("b")).collect()}
    kept = {f for f in before if int(re.search(r"_bucket=(\d+)", f)[1]) not in touched}
    assert kept and kept <= files(path)  # partitions without a key of the batch keep their files
    sinks.replace_partitions(batch, path, "k", 8)
    assert read() == want
    # A partition that loses all its rows.
    only = str(tmp_path / "one")
    sinks.store_by_key(spark.createDataFrame([(1, 1), (2, 2)], "k int, v int"), only, "k", 64)
    sinks.replace_partitions(spark.createDataFrame([], "k int, v int"), only, "k", 64, spark.createDataFrame([(1,)], "k int"))
    assert [(r.k, r.v) for r in spark.read.parquet(only).collect()] == [(2, 2)]


def test_observed_load(spark, tmp_path):
    df = spark.createDataFrame([("a",), ("",), (" b",), (None,)], "k string")
    report = sinks.load_observed({"t": df}, str(tmp_path), {"t": "k"}).collect()
    assert [tuple(r) for r in report] == [("t", 4, 1, 2)] and spark.read.parquet(f"{tmp_path}/t").count() == 4
    with pytest.raises(AssertionError):
        sinks.load_observed({"t": df.limit(1)}, str(tmp_path), {"t": "k"}, {"t": 9})
    assert spark.read.parquet(f"{tmp_path}/t").count() == 4  # the old table is still there


def allowed(rules, target):
    """Longest matching rule, allow wins a tie."""
    best = (-1, True)
    for allow, value in rules:
        pattern = "".join(".*" if c == "*" else "$" if c == "$" and i == len(value) - 1 else re.escape(c) for i, c in enumerate(value))
        if value and re.match(pattern, target):
            best = max(best, (len(value), allow))
    return best[1]


def test_robots_rules_against_trying_all(spark):
    rng = random.Random(2)
    parts = ["/", "/a", "/b/", "/a*", "*b", "/a/b$", "/*.html$", "$x", "/a.b", "/a?q=*", "*"]
    hosts, robots, rules = [f"h{i}.example" for i in range(6)], [], {}
    for h in hosts:
        text = ""
        for agent in ("*", "stay"):
            rules[h, agent] = [(rng.random() < 0.5, "".join(rng.choices(parts, k=rng.randint(1, 2)))) for _ in range(8)]
            text += f"User-agent: {agent}\n" + "".join(f"{'Allow' if a else 'Disallow'}: {v}\n" for a, v in rules[h, agent]) + "\n"
        robots.append((h, text))
    many = [(True, "/keep")] + [(False, f"/p{i}/") for i in range(2000)]
    rules["hot.example", "*"] = many
    robots.append(("hot.example", "User-agent: *\n" + "".join(f"{'Allow' if a else 'Disallow'}: {v}\n" for a, v in many)))
    links = [(f"https://{h}{p}",) for h in hosts for p in ("/", "/a", "/a/b", "/b/x.html", "/a.b", "/a?q=1", "/ab/$x", "/c")]
    links += [(f"https://hot.example/p{i}/x",) for i in range(0, 3000, 100)] + [("https://hot.example/keep",), ("https://none.example/a",), (None,)]
    df = spark.createDataFrame(links, "link string")
    table = crawl.robots_rules(spark.createDataFrame(robots, "host string, robots_txt string"))
    for agents in (["stay"], ["other", "stay"], ["Nobody"]):
        got = {r.link: r.robots_allowed for r in crawl.with_robots(df, table, agents).collect()}
        for link, in links:
            if link is None or "none.example" in link:
                assert got[link]
                continue
            host, target = re.match(r"https://([^/]+)(.*)", link).groups()
            sets = [rules.get((host, a.lower())) or rules[host, "*"] for a in agents]
            forms = {target, target if link.endswith("/") else target + "/"}
            assert got[link] == any(all(allowed(s, f) for f in forms) for s in sets), (link, agents)
