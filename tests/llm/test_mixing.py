"""Mixes: shares, caps, disjoint blocks and the splitting tree."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm.mixing import coprime, leaves, mix, mix_shares, split_quotas

DOCS = "doc_id bigint, source string, n bigint, copy int, shard string"


def test_tree_keeps_totals():
    rng = np.random.default_rng(3)
    quotas = np.array([0, 1, 17, 400])
    out = split_quotas(quotas, 7, rng)
    assert (out.sum(0) == quotas).all() and out.sum(1).max() - out.sum(1).min() <= 2 and (out >= 0).all()


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(k, "abc"[min(2, k % 10 // 4)], 5 + k * 7 % 40, 1, "x") for k in range(3000)]
    docs = spark.createDataFrame([*rows, (9001, None, 10, 1, "x"), (9002, "other", 10, 1, "x"), (9003, "a", None, 1, "x"), rows[0]], DOCS)
    targets = spark.createDataFrame([("a", 0.5, 3), ("b", 0.3, 1), ("c", 0.15, 2), ("none", 0.05, 4), ("zero", 0.0, 4), (None, 0.1, 1)], "source string, target_share double, max_repeats bigint")
    return docs, targets


def test_shares_and_caps(spark, corpus):
    docs, targets = corpus
    mixed = mix(docs, targets, size="n", shard_tokens=9000)
    rows = mixed.collect()
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)
    shares = {r.source: r for r in mix_shares(mixed, targets).collect()}
    for s, want in (("a", 0.5), ("b", 0.3), ("c", 0.15)):
        assert abs(shares[s].actual_share - want / 0.95) < 0.002 and shares[s].most_times <= shares[s].max_repeats
    assert shares["none"].tokens == 0 and "other" not in shares
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert len(by) > 3
    for part in by.values():
        assert sorted(r.position for r in part) == list(range(1, len(part) + 1))
    assert mixed.exceptAll(mix(docs.repartition(5), targets, size="n", shard_tokens=9000)).count() == 0


def test_total_and_empty(spark, corpus):
    docs, targets = corpus
    got = mix(docs, targets, total_tokens=2000, size="n").agg(F.sum("tokens")).first()[0]
    assert 1950 <= got <= 2000
    assert mix(docs.limit(0), targets, size="n").count() == 0 and mix(docs, targets.limit(0), size="n").count() == 0


def test_any_part_of_the_tree_is_the_same():
    quotas = np.array([3, 170, 41, 0])
    whole = [(s, a.tolist(), q.tolist()) for s, a, q in leaves(quotas, 37, 5, 0, 37)]
    parts = [(s, a.tolist(), q.tolist()) for lo in range(0, 37, 10) for s, a, q in leaves(quotas, 37, 5, lo, lo + 10)]
    assert whole == parts and [s for s, _, _ in whole] == list(range(37))
    at = np.zeros(4, int)
    for _, start, own in whole:
        assert start == at.tolist()
        at += own
    assert at.tolist() == quotas.tolist()
    for n in range(1, 300):
        assert len({k * coprime(n, 11) % n for k in range(n)}) == n
