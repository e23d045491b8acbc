import random

import numpy as np

from graphweir.llm import url_filter


def test_suffix_rates_count_all_labelled_urls(spark, monkeypatch):
    seen, real = [], url_filter.suffix_rates
    monkeypatch.setattr(url_filter, "suffix_rates", lambda train, k: (seen.append(train.count()), real(train, k))[1])
    rows = [(i, f"http://{'a.com/en' if i % 2 else 'a.net/de'}/{i}") for i in range(300)]
    url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string"), train_rows=50)
    assert seen == [300, 300, 300]


def test_copies_do_not_empty_the_sample(spark):
    rows = [(i, f"http://{'a.com/en' if i % 2 else 'a.net/de'}/{i % 8}") for i in range(4000)] + [(9000, "http://b.com/en1")]
    out = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string"), train_rows=10).collect()
    assert len(out) == 4001 and all(0 <= r["score"] <= 1 for r in out)


def test_urls_that_no_rule_decides_are_judged_by_their_features(spark):
    """Rules cover two thirds of the hosts; on the others the trees must tell junk from clean urls by what they look like."""
    rng, rows, truth = random.Random(25), [], {}
    hosts = [(f"{'x' if bad else 'y'}{rng.randrange(10**6)}.{rng.choice(['com', 'net', 'org'])}", bad) for k in range(120) for bad in [k % 2]]
    rules = tuple(("block" if bad else "allow", host + "/") for host, bad in hosts[:80])
    for k in range(3000):
        host, bad = hosts[rng.randrange(120)]
        path = "".join(rng.choice("0123456789abcdef") for _ in range(24)) + f"?id={rng.randrange(10**6)}&s=1" if bad else rng.choice(["about", "news/today", "garden/plants", "recipes/soup"])
        rows.append((k, f"http://{host}/{path}"))
        truth[k] = "block" if bad else "allow"
    out = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string").repartition(5), rules).collect()
    assert np.mean([r["verdict"] == truth[r["page_id"]] for r in out if r["rule"] is None]) > 0.95
    again = url_filter.verdicts(spark.createDataFrame(rows, "page_id long, url string").repartition(2), rules).collect()
    assert {r["page_id"]: r["score"] for r in out} == {r["page_id"]: r["score"] for r in again}
