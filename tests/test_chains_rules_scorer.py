"""Redirect chains, phrase tables and the scorer hook against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from rolefunnel.functions.text import tokens
from rolefunnel.operators import external as ex
from rolefunnel.operators.phrases import phrase_hits
from rolefunnel.operators.redirects import follow, resolve_redirects
from rolefunnel.operators.rule_join import phrase_hits_joined
from rolefunnel.operators.rules import Negation


def walk(hops, url):
    seen, at = [], url
    while at in hops:
        if at in seen:
            return None, None, True
        seen.append(at)
        at = hops[at]
    return at, len(seen), False


def test_chains_of_any_length_and_circles(spark):
    hops = {}
    for n in range(1, 21):
        hops |= {f"c{n}-{k}": f"c{n}-{k + 1}" for k in range(n)}
    for n in (1, 2, 3, 8, 13):  # circles, the first of one address; a tail leads into each
        hops |= {f"o{n}-{k}": f"o{n}-{(k + 1) % n}" for k in range(n)}
        hops |= {f"t{n}-{k}": f"t{n}-{k + 1}" for k in range(5)} | {f"t{n}-5": f"o{n}-0"}
    hops |= {f"star{k}": "c20-0" for k in range(300)}
    rows = list(hops.items()) + [("c1-0", "z later"), (None, "x"), ("y", None)]
    got = {r.url: (r.target, r.hops, r.looped) for r in resolve_redirects(spark.createDataFrame(rows, "url string, final_url string")).collect()}
    real = {u: v for u, v in hops.items() if u != v}
    assert got == {u: walk(real, u) for u in real}


def test_no_redirects(spark):
    empty = spark.createDataFrame([], "url string, final_url string")
    assert resolve_redirects(empty).count() == 0
    pages = spark.createDataFrame([("a", "a", "x")], "url string, final_url string, html string")
    assert follow(pages, empty).collect() == pages.collect()
    led = follow(pages, spark.createDataFrame([("c", "b"), ("b", "a"), ("d", "nowhere")], "url string, final_url string"))
    assert sorted(r.url for r in led.collect()) == ["a", "b", "c"]


@pytest.mark.parametrize("window", [0, 2, 5])
def test_joined_phrases_are_those_of_the_literal_path(spark, window):
    rng = random.Random(window)
    words = [f"w{k}" for k in range(12)] + ["not", "No", "été", "x_y"]
    texts = [None, "", "!!!"] + [" ".join(rng.choice(words) + rng.choice(["", ".", ",", "-"]) for _ in range(rng.randint(0, 40))) for _ in range(80)]
    phrases = sorted({" ".join(rng.choice(words) for _ in range(rng.randint(1, 4))) for _ in range(600)} | {"", "--"})
    negation = Negation(words=("not", "w3"), window=window)
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rules = spark.createDataFrame([(p, k) for k, p in enumerate(phrases)], "phrase string, n int")
    found = phrase_hits_joined(docs, "id", F.col("text"), rules, negation)
    assert found.columns == ["id", "phrase", "n"]
    literal = docs.select("id", F.explode(phrase_hits(tokens(F.col("text")), phrases, negation)).alias("phrase"))
    from rolefunnel.operators.rules import norm_phrase

    want = {(r.id, p) for r in literal.collect() for p in phrases if norm_phrase(p) == r.phrase}
    assert {(r.id, r.phrase) for r in found.collect()} == want and found.count() == len(want) > 100
    assert phrase_hits_joined(docs, "id", F.col("text"), rules.limit(0), negation).count() == 0


def test_scorer_is_set_up_once_per_partition_and_fails_by_row(spark, tmp_path):
    folder = str(tmp_path)

    def make():
        import uuid

        open(f"{folder}/{uuid.uuid4().hex}", "w").close()

        def score(request):
            if request.endswith("3"):
                raise KeyError("three")
            return request.upper()

        return score

    requests = spark.createDataFrame([(f"k{n}", f"r{n}") for n in range(40)], "dedup_key string, request string").repartition(4)
    got = {r.dedup_key: (r.response, r.error) for r in ex.score_requests(requests, make).collect()}
    assert got == {f"k{n}": (None, "KeyError: 'three'") if str(n).endswith("3") else (f"R{n}", None) for n in range(40)}
    assert len(list(tmp_path.iterdir())) == 4
    none = ex.score_requests(requests)
    assert none.count() == 0 and none.columns == ["dedup_key", "response", "error"]
    valid, bad = ex.validate_responses(ex.score_requests(requests, make))
    assert valid.count() == 0 and {r.error for r in bad.collect()} == {"KeyError: 'three'", "response does not match the schema"}


def test_scored_rows_stay_few_at_a_time(spark):
    """A worker holds the answers to some hundred requests, not to a whole batch of ten thousand."""
    requests = spark.range(3000).repartition(1).selectExpr("cast(id AS string) AS dedup_key", "repeat('x', cast(id AS int)) AS request")
    found = ex.score_requests(requests, lambda: lambda request: str(len(request)))
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert all(r.response == r.dedup_key and r.error is None for r in found.collect())
