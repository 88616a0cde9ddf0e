import datetime as dt

from reelspark.llm import queries, sql, urlfilter
from tests.compare import DATA, by_spark, by_sql, tables
from tests.llm.fixtures import rng

DAY = dt.datetime(2024, 1, 1)


def test_same_as_sql(spark):
    assert by_spark(queries.op8_url_filters(spark, DATA)) == by_sql(tables(), sql.URL_FILTERS)


def plain(url, at, entries):
    import re

    m = re.match(urlfilter._URL, url or "")
    host, path = (re.sub(r"\.$", "", m[1].lower()), m[2]) if m else ("", "")
    if not host or at is None:
        return None
    keys = [("path", host + "/".join(path.rstrip("/").split("/")[:i])) for i in range(len(path.rstrip("/").split("/")), 0, -1)]
    parts = host.split(".")
    keys += [("host", host)] + [("domain", ".".join(parts[i:])) for i in range(len(parts))]
    for k in keys:
        held = [(s, a) for kind, v, a, s in entries if (kind, v) == k and s <= at]
        if held and max(held)[1] != "remove":
            return (*k, max(held)[1])
    return None


def test_against_brute_force(spark):
    r = rng(6)
    hosts = ["a.b.c", "b.c", "c", "x.y", "A.B.c.", ""]
    day = lambda: DAY + dt.timedelta(days=r.randrange(200))
    entries = {(r.choice(["domain", "host"]), r.choice(["a.b.c", "b.c", "c", "x.y"]), r.choice(["block", "allow", "remove"]), day()) for _ in range(60)}
    entries |= {("path", r.choice(["b.c/en", "b.c/en/1", "x.y/en", "c"]), r.choice(["block", "allow", "remove"]), day()) for _ in range(30)}
    entries |= {("host", "b.c", "block", DAY + dt.timedelta(days=i)) for i in range(0, 200, 2)}
    urls = [(i, f"http://u@{r.choice(hosts)}:80{r.choice(['', '/', '/en', '/en/1?q', '/english', '/en/1/2/#x'])}", day()) for i in range(400)]
    urls += [(1, None, DAY), (2, "", DAY), (3, "no url", DAY), (4, "http://b.c", None), (1, urls[1][1], urls[1][2]), (5, "http://b.c/" + "a/" * 3000, DAY)]
    cap = spark.createDataFrame([(*u, 1, "x") for u in urls], "page_id long, url string, fetched timestamp, at int, host string")
    ent = spark.createDataFrame([*entries, ("host", None, "block", DAY), ("odd", "b.c", "block", DAY)], "kind string, value string, action string, since timestamp")
    got = sorted((x.page_id, x.url or "", str(x.fetched), x.blocked, (x.rule_kind, x.rule_value, x.rule_action) if x.rule_kind else None) for x in urlfilter.evaluate(cap, ent).collect())
    want = sorted((i, u or "", str(at), bool(b and b[2] == "block"), b) for i, u, at in urls for b in [plain(u, at, entries)])
    assert got == want
    assert {x[4][0] for x in got if x[4]} == {"domain", "host", "path"}


def test_empty(spark):
    cap = spark.createDataFrame([(1, "http://a.b/", DAY)], "page_id long, url string, fetched timestamp")
    ent = spark.createDataFrame([("host", "a.b", "block", DAY)], "kind string, value string, action string, since timestamp")
    assert urlfilter.evaluate(cap.limit(0), ent).count() == 0
    assert [x.blocked for x in urlfilter.evaluate(cap, ent.limit(0)).collect()] == [False]
