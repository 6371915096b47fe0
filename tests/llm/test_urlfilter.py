import itertools
import math
import re

import pytest
from latticelu.llm import urlfilter
from latticelu.llm.queries import RULES
from pyspark.sql import functions as F


@pytest.mark.parametrize(
    "url, want",
    [
        (None, ("", "")), ("", ("", "")), ("no-scheme.org/x", ("", "")), ("http://A.B/c?d#e", ("a.b", "/c")), ("http://a.b?x/y", ("a.b", "")), ("http://a.b#x", ("a.b", "")), ("://H", ("h", "")),
        ("http://a://b/c", ("a:", "//b/c")), ("x://É.ORG/Ä", ("É.org", "/Ä")), ("http:///p", ("", "/p")), ("http://a.b", ("a.b", "")),
    ],
)
def test_host_and_path(url, want):
    assert urlfilter.host_and_path(url) == want


@pytest.mark.parametrize(
    "host, path, want",
    [
        ("x.net", "/a", "net/"), ("net", "/", "net/"), ("x.net", "", None), ("example.net", "/en/1", "example.net/en/"), ("m.example.net", "/en/", "example.net/en/"), ("myexample.net", "/en/", "net/"), ("example.net", "/en", "net/"),
        ("a.example.com", "/de/x", "example.com/de/"), ("a.example.com", "/fr/x", None), ("x.org", "/fr/", "org/fr/"), ("borg", "/fr/", None), ("", "", None),
    ],
)
def test_rules(host, path, want):
    got = urlfilter.match(host, path, urlfilter.parse_rules(RULES))
    assert (got and got[1] + got[2]) == want


WORDS = {"free": 50, "bets": 5, "the": 900, "news": 40, "cheap": 9, "pills": 3, "pill": 3, "sfree": 1, "ap": 2, "a": 300}


@pytest.mark.parametrize("run", ["freebets", "cheappills", "thenews", "xqzthe", "a", "pillsfree", "theapnews"])
def test_segmentation_is_the_most_probable(run):
    model, total = urlfilter.UrlModel(WORDS, {}), sum(WORDS.values())
    cost = lambda w: -math.log(WORDS[w] / total) if w in WORDS else math.log(10 * total * 10 ** len(w))
    best = math.inf
    for cuts in itertools.product([0, 1], repeat=len(run) - 1):
        at = [0, *[k + 1 for k, c in enumerate(cuts) if c], len(run)]
        best = min(best, sum(cost(run[a:b]) for a, b in itertools.pairwise(at)))
    parts = model.segment(run)
    assert "".join(parts) == run and math.isclose(sum(map(cost, parts)), best)


def test_scores_are_those_of_plain_bayes(spark):
    texts = [("free bets free", 1), ("the news the free", 0), ("news bets", None), ("cheap pills!", 1), ("Cheap PILLS", 0), (None, 1), ("", 0), ("the " * 30_000, None)]
    model = urlfilter.fit(spark.createDataFrame(texts, "text string, label int"), examples=[(1, "spam farm"), (0, "farm")], min_count=1)
    rows = [(t.lower().replace("!", "").split(), k) for t, k in texts if t] + [(["spam", "farm"], 1), (["farm"], 0)]
    words = [w for ws, _ in rows for w in ws]
    p = lambda w, k: (sum(ws.count(w) for ws, c in rows if c == k) + 0.02 * words.count(w)) / (sum(len(ws) for ws, c in rows if c == k) + 0.02 * len(words))
    for tokens in (["free", "bets"], ["news"], ["spam", "farm", "zzz"], []):
        block, allow = 0.1, 0.9
        for t in tokens:
            if t != "zzz":  # unknown words tell nothing
                block, allow = block * p(t, 1), allow * p(t, 0)
        assert math.isclose(model.score_tokens(tokens), block / (block + allow))
    small = urlfilter.fit(spark.createDataFrame(texts, "text string, label int"), examples=[], vocabulary=2)
    assert set(small.cost) == {"the", "free"} and urlfilter.fit(spark.createDataFrame([], "text string, label int"), examples=[]).score_tokens(["a"]) == pytest.approx(0.1)


def test_held_out_documents_are_told_apart(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").join(labels, "doc_id")
    model = urlfilter.fit(docs.filter("doc_id % 5 <> 0"), prior=0.5)
    held = docs.filter("doc_id % 5 = 0 and text is not null").collect()
    right = [(model.score_tokens(re.findall("[a-z]+", r.text.lower())) > 0.5) == bool(r.label) for r in held]
    assert len(right) > 40 and sum(right) / len(right) >= 0.9


def test_query(spark, sf_dir):
    from latticelu.llm import queries

    rows = queries.op6_url_filter(spark, sf_dir).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    rules = urlfilter.parse_rules(RULES)
    assert {r.page_id for r in rows} == set(pages)
    for r in rows:
        host, path = urlfilter.host_and_path(pages[r.page_id])
        rule = urlfilter.match(host, path, rules)
        assert (r.host, r.path) == (host, path) and r.rule == (rule and rule[1] + rule[2])
        assert r.verdict == (rule[0] if rule else "block" if r.score > 0.5 else "allow")
        if not rule:
            assert (r.verdict == "block") == any(w in host for w in ("casino", "pills", "bets", "spam", "adult", "ads-track")), r


def test_unseen_combinations(spark, sf_dir):
    from latticelu.llm.queries import url_model

    model = url_model(spark, sf_dir)
    score = lambda url: model.score_tokens(model.tokens(*urlfilter.host_and_path(url)))
    assert all(score(u) > 0.5 for u in ("http://blackjackparadise.com/roulette", "http://hotgirlsnow.com/nude"))
    assert all(score(u) < 0.5 for u in ("http://citylibrary.org/books", "http://therunning.org/track", "http://x.com/"))


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    model = urlfilter.UrlModel({"free": 3, "the": 9}, {"free": (0, 3), "the": (9, 0)}, prior=0.5)
    df = spark.createDataFrame([(1, None, "h"), (1, None, "h"), (None, "http://" + "free" * 500 + ".com/" + "x" * 5000, None)], "page_id bigint, url string, host string")
    got = urlfilter.filter_urls(df, RULES, model).collect()
    assert len(got) == 3 and sorted(r.verdict for r in got) == ["allow", "allow", "block"]
    assert urlfilter.filter_urls(df.limit(0), RULES, model).count() == 0
    with pytest.raises(ValueError):
        urlfilter.parse_rules([("deny", "a/")])
    # of equally long rules allow goes first
    assert urlfilter.match("a.b", "/x", urlfilter.parse_rules([("block", "a.b/x"), ("allow", "a.b/x")]))[0] == "allow"
