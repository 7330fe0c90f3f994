from __future__ import annotations

import random

import duckdb
import pytest

from sievelight.llm import queries, urlfilter


def fits(rule, host, path):
    h, p = urlfilter.split_rule(rule)
    return (host == h or host.endswith("." + h)) and path.startswith(p)


def test_rules_against_every_rule(tmp_path):
    r = random.Random(1)
    hosts = ["org", "example.org", "a.example.org", "b.a.example.org", "com", "x.com", "org.com"]
    paths = ["", "/", "/a", "/a/", "/a/b", "/ab", "/é"]
    rules = {r.choice(hosts) + r.choice(paths): r.choice(["allow", "block"]) for _ in range(30)}
    urlfilter.write_array(rules.items(), f"{tmp_path}/x")
    array = urlfilter.DigestArray(f"{tmp_path}/x")
    asked = [(h, p + tail) for h in [*hosts, "", "notorg", "c.b.a.example.org"] for p in paths for tail in ("", "x", "/1")]
    got = array.longest(*map(list, zip(*asked, strict=True)))
    for (h, p), k in zip(asked, got.tolist(), strict=True):
        best = max((len(x) for x in rules if fits(x, h, p)), default=0)
        assert (len(array.rule(k)) == best and fits(array.rule(k), h, p) and bool(array.allow[k]) == (rules[array.rule(k)] == "allow")) if best else k == -1


def test_colliding_digests_are_told_apart(tmp_path, monkeypatch):
    monkeypatch.setattr(urlfilter.xxhash, "xxh64_intdigest", lambda s: len(s))
    urlfilter.write_array([("ab.c/", "allow"), ("xy.z/", "block")], f"{tmp_path}/x")
    assert urlfilter.DigestArray(f"{tmp_path}/x").find(["xy.z/", "ab.c/", "no.o/", ""]).tolist() == [1, 0, -1, -1]


URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.ORG/es/x?q=/en/1#f", "https://a.example.org/en/12", "x://example.org", "x://example.org?/en/1", "ftp://x.com/de/#y", "http://xcom/fr/", "http://É.ORG/fr\n/a?b", "http://a.com/fr/1", "http://a://b.com/fr/x", "http://" + "a." * 2000 + "com/fr/z"]


def test_odd_urls_equal_the_sql(spark):
    rows = [(i, u, "h", "p") for i, u in enumerate(URLS)] + [(None, URLS[5], "h", "p"), (4, URLS[4], "h", "p")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, rule string")
    got = urlfilter.judge(pages, queries.URL_RULES).toPandas()
    db = duckdb.connect()
    db.register("pages", pages.toPandas().astype({"page_id": "Int64"}))
    want = db.sql(queries.URL_SQL).df()
    show = lambda f: sorted(repr(tuple("~" if v is None or v != v else v for v in r)) for r in f[["page_id", "host", "path", "rule", "verdict"]].itertuples(index=False))
    assert show(got.astype({"page_id": "float"})) == show(want.astype({"page_id": "float"}))
    assert urlfilter.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_query_equals_its_sql(spark, sf):
    db = duckdb.connect()
    db.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    got, want = queries.op2_digest_array_urls(spark, sf).toPandas(), db.sql(queries.URL_SQL).df()
    assert got.sort_values("page_id", ignore_index=True).fillna("~").equals(want[list(got.columns)].sort_values("page_id", ignore_index=True).fillna("~"))


def test_too_many_rules(monkeypatch, tmp_path):
    monkeypatch.setattr(urlfilter, "MAX_RULES", 2)
    with pytest.raises(ValueError):
        urlfilter.write_array([(str(i), "allow") for i in range(3)], f"{tmp_path}/x")
