"""Containers: nothing lost, no overflow, nearly as few as possible."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from utterlake.llm.packing import best_fit, containers, fill, pack_items
from utterlake.llm.tokens import token_count


def test_best_fit_takes_the_fullest_bin():
    sizes = np.array([6, 5, 4, 3, 2])
    own = best_fit(sizes, 10)
    assert own[0] == own[2] and own[1] == own[3] == own[4]
    rng = np.random.default_rng(2)
    for _ in range(20):
        sizes = rng.integers(1, 101, 300)
        own = best_fit(sizes, 100)
        used = np.bincount(own, weights=sizes)
        assert used.max() <= 100 and len(used) <= sizes.sum() / 100 * 11 / 9 + 1


@pytest.mark.parametrize("most_items", [20, 100_000])
def test_pack_items(spark, most_items):
    rng = random.Random(5)
    items = [(f"i{k}", rng.choice([1, 5, 30, 49, 51, 60, 99, 100])) for k in range(700)]
    got = pack_items(spark.createDataFrame(items, "name string, size bigint").repartition(7), 100, most_items=most_items).collect()
    assert sorted((r.name, r["size"]) for r in got) == sorted(items)
    used = {}
    for r in got:
        used[r.bin] = used.get(r.bin, 0) + r["size"]
    assert max(used.values()) <= 100
    one = best_fit(np.array([s for _, s in items]), 100).max() + 1
    assert len(used) <= one * (1.25 if most_items == 20 else 1.02) + 1


def test_containers(spark):
    rng = random.Random(6)
    rows = [(k, "x" * rng.choice([0, 1, 40, 99, 100, 101, 250, 1000])) for k in range(200)] + [(500, None), (None, "x")]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id bigint, text string").withColumn("name", F.lit(1))
    got = containers(docs, 100, size=F.length("text")).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    for k, text in rows[:-2]:
        ps = sorted(by.get(k, []), key=lambda r: r.piece)
        assert sum(p.tokens for p in ps) == len(text)
        assert len(ps) == -(-len(text) // 100) and all(p.tokens == 100 for p in ps[:-1]) and [p.start_token for p in ps] == [100 * j for j in range(len(ps))]
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert max(used.values()) <= 100
    assert containers(docs.limit(0), 100, size=F.length("text")).count() == 0


def test_tokens_and_fill(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    f = fill(containers(docs)).first()
    assert f.most <= 2048 and f.filled > 0.97 and f.containers <= f.least * 1.03 + 1
    got = spark.createDataFrame([("hello world",), (None,), ("",)], "t string").select(*[token_count("t", v) for v in ("piece_bpe_32k.model", "byte_bpe_50k.tiktoken", "byte_bpe_50k.json")]).collect()
    assert got[0][1] == got[0][2] == 2 and tuple(got[1]) == (None, None, None) and tuple(got[2]) == (0, 0, 0)


def test_rows_of_one_name_and_several_sizes(spark):
    docs = spark.createDataFrame([(1, 100), (1, 1900), (2, 1940), (3, 90)], "doc_id bigint, n int")
    got = containers(docs.withColumn("text", F.lit("x")), 2048, size=F.col("n")).collect()
    used = {}
    for r in got:
        used[r.container] = used.get(r.container, 0) + r.tokens
    assert {(r.doc_id, r.tokens) for r in got} == {(1, 1900), (2, 1940), (3, 90)} and max(used.values()) <= 2048


def test_missing_vocabulary():
    from utterlake.llm.tokens import counter

    with pytest.raises(FileNotFoundError, match="no vocabulary file"):
        counter("/nowhere/x.model")
