from pyspark.sql import functions as F

from shopgrain.llm import url_trees as u


def judged(spark, urls, **options):
    df = spark.createDataFrame([(i, x, "h") for i, x in enumerate(urls)], "page_id long, url string, host string")
    return {r.page_id: r for r in u.filter_urls(df, **options).collect()}


def test_rules(spark):
    urls = ["http://Example.ORG/es/1", "https://sub.example.org/en/148", "http://example.org/de/1", "http://notexample.org/es/x",
            "http://a.com/fr/2?x#y", "http://a.com/de/2", "http://a.net/de/2", None, "no scheme", "http://example.org", "x://org/?a=://b.com/fr/"]
    got = judged(spark, urls)
    rules = [got[i].rule for i in range(len(urls))]
    assert rules == ["example.org/es/", "example.org/en/1", "org/", "org/", "com/fr/", "com/de/", None, None, None, None, "org/"]
    assert [got[i].verdict for i in range(6)] == ["block", "block", "allow", "allow", "allow", "block"]
    assert (got[0].host, got[0].path) == ("example.org", "/es/1")
    assert (got[7].host, got[7].path, got[8].host) == ("", "", "")
    assert (got[4].host, got[4].path) == ("a.com", "/fr/2")
    assert got[9].path == ""
    assert all(r.verdict in ("allow", "block") for r in got.values())


def test_features_equal_plain_ones(spark):
    import math
    from collections import Counter

    url = "https://a-b.c1.example.com/x/12/y.html?k=1&m=&n#f"
    df = spark.createDataFrame([(url,)], "u string")
    df = df.withColumns(u.host_and_path(F.col("u")))
    r = u.with_features(df).first()
    bits = -sum(n / len(url) * math.log2(n / len(url)) for n in Counter(url).values())
    assert (r.url_length, r.host_depth, r.path_depth, r.n_parameters, r.host_hyphens, r.host_digits) == (len(url), 4, 3, 3, 1, 1)
    assert abs(r.entropy - bits) < 1e-9 and abs(r.digit_ratio - 4 / len(url)) < 1e-12
    assert (r.last_label, r.last_two) == ("com", "example.com")


def test_unlabelled_urls_follow_the_learned_pattern(spark):
    """Held out: hosts without seed word that look like those with one."""
    good = [f"http://www.news{i % 7}.example.com/fr/{i}" for i in range(200)]
    bad = [f"http://free-bets-{i}{i}.example.net/p?a={i}&b=1&c=2" for i in range(200)]
    unseen = [f"http://big-wins-{i}{i}.example.net/p?a={i}&b=1&c=2" for i in range(40)]
    fine = [f"http://www.news{i % 7}.example.net/en/{i}" for i in range(40)]
    got = judged(spark, good + bad + unseen + fine)
    assert sum(got[i].verdict == "block" for i in range(400, 440)) >= 36
    assert sum(got[i].verdict == "allow" for i in range(440, 480)) >= 36


def test_no_labels_and_empty_table(spark):
    assert {r.verdict for r in judged(spark, ["http://x.net/1", "http://x.net/1"], rules={}).values()} == {"allow"}
    assert judged(spark, []) == {}
