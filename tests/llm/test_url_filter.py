import collections
import hashlib
import math

from pyspark.sql import functions as F

from folium.llm import url_filter as U

PAGE = "page_id long, url string, html string, host string, rule string"


def test_parts_rules_and_odd_urls(spark):
    urls = [
        ("http://A.Example.COM/en/x?q#f", "a.example.com", "/en/x", "example.com/en/"),
        ("https://www.example.com/en/", "www.example.com", "/en/", "www.example.com/en/"),
        ("https://m.www.example.com/en/1", "m.www.example.com", "/en/1", "www.example.com/en/"),
        ("http://notexample.com/en/", "notexample.com", "/en/", "com/"),
        ("http://com", "com", "", None),
        ("x://a.net/es/q", "a.net", "/es/q", "net/es/"),
        ("x://net/fr", "net", "/fr", None),
        ("no scheme", "", "", None),
        ("", "", "", None),
        (None, "", "", None),
        ("a://b?://c/d", "b", "", None),
        ("a\nb://h\n/p", "h\n", "/p", None),
        ("http://a.org/" + "x/" * 20000, "a.org", "/" + "x/" * 20000, None),
    ]
    rows = [(i, u, None, "clash", "clash") for i, (u, *_) in enumerate(urls)] * 2
    got = U.judge(spark.createDataFrame(rows, PAGE)).orderBy("page_id").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["host"], r["path"], r["rule"]) == urls[r["page_id"]][1:]
        assert r["verdict"] in ("allow", "block")
        if r["rule"]:
            assert r["verdict"] == dict((rule, v) for v, rule in U.RULES)[r["rule"]]


def brute_bins(rows):
    """(url, ruled) to the url's score_bin, by counting every context anew."""
    size = U.CONTEXT
    held = lambda u: hashlib.md5(u.encode()).hexdigest()[0] in "012"
    padded = lambda u: U.START * size + u
    counts = {k: collections.Counter() for k in U.KINDS}
    for url, ruled in rows:
        if url and ruled and not held(url):
            s = padded(url)
            for i in range(size, len(s)):
                for order in range(size + 1):
                    counts[ruled][s[i - order : i + 1]] += 1
    characters = len({c for url, _ in rows for c in url or ""})
    followers = {k: collections.defaultdict(list) for k in U.KINDS}
    for k in U.KINDS:
        for gram, n in counts[k].items():
            followers[k][gram[:-1]].append(n)

    def p(gram, k):
        below = p(gram[1:], k) if len(gram) > 1 else 1 / characters
        after = followers[k].get(gram[:-1], [])
        return (counts[k][gram] + len(after) * below) / (sum(after) + len(after)) if after else below

    def ratio(gram):
        return round(1e6 * math.log(p(gram, "allow") / p(gram, "block")))

    bins = {}
    for url, _ in rows:
        s = padded(url or "")
        found = [ratio(s[i - size : i + 1]) for i in range(size, len(s))]
        bins[url] = math.floor(sum(found) / len(found) / U.BIN) if found else 0
    return bins


def test_scores_equal_brute_force_by_either_way(spark):
    rows = [(u, "allow") for u in ("http://a.com/?q=1", "https://blog.a.com/Ünï/ß?x=9#top", "http://a.com/?q=1")]
    rows += [(f"https://good{i}.com/read/{i * i}?ref=x", "allow") for i in range(12)]
    rows += [(f"http://win{i}.example.com/en/{i}#casino", "block") for i in range(12)]
    rows += [(u, None) for u in ("no scheme \U0001f600 日本", "", None, "http://a.org/?casino", "http://b.org/read/7", "日本")]
    want = brute_bins(rows)
    urls = U.parsed(spark.createDataFrame([(i, u) for i, (u, _) in enumerate(rows)], "page_id long, url string"))
    assert [r["ruled"] for r in urls.orderBy("page_id").collect()] == [k for _, k in rows]
    model = U.train(urls)
    for common in (0, 40, U.COMMON):
        got = U.scored(urls, model, common).collect()
        assert len(got) == len(rows)
        assert {r["page_id"]: r["score_bin"] for r in got} == {i: want[u] for i, (u, _) in enumerate(rows)}


def test_the_model_grows_with_the_urls_and_reads_query_and_fragment(spark):
    def learned(n):
        rows = [(i, f"http://a{i}.com/x?session={i * 7919}#part{i}") for i in range(n)]
        return U.train(U.parsed(spark.createDataFrame(rows, "page_id long, url string")))

    few, many = learned(20), learned(400)
    assert many.count() > 4 * few.count()
    assert few.where("gram = 'session'").first()["n"] == 20
    assert few.where(F.col("gram") == "1#part1").count() == 1


def test_one_host_and_one_long_url_hold_most_stretches(spark):
    rows = [(i, f"https://www.hot.com/en/{i}") for i in range(60)] + [(None, "x://net/" + "ab" * 30000)] * 2
    got = U.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
    assert len(got) == 62
    assert len({r["score_bin"] for r in got if r["page_id"] is None}) == 1


def test_empty_table(spark):
    assert U.judge(spark.createDataFrame([], PAGE)).collect() == []


def test_model_tells_learned_kinds_apart(spark):
    rows = [(i, f"http://{w}{i}.example.com/{p}/{i}", None, "", "") for i in range(300) for w, p in (("good", "fr"), ("spam", "en"))]
    rows += [(1000 + i, f"http://{w}{i}.example.org/{p}/{i}", None, "", "") for i in range(20) for w, p in (("good", "fr"), ("spam", "en"))]
    got = U.judge(spark.createDataFrame(rows, PAGE)).where("page_id >= 1000").collect()
    assert all(r["verdict"] == ("block" if r["host"].startswith("spam") else "allow") for r in got)
