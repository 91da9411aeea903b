"""Groups against union-find, and shares of the splits."""

import random

from pyspark.sql import functions as F

from utterlake.llm.group_split import assign_splits, components, torn_groups

U = "source_id string, speaker_id string, split string, component string"
R = "source_id string, speaker_id string, audio_sha256 string, text_sha256 string, label string"


def union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return find


def test_components(spark):
    rng = random.Random(8)
    pairs = [(rng.randrange(200), 1000 + rng.randrange(150)) for _ in range(220)] + [(300 + k, 2000 + k) for k in range(60)] + [(301 + k, 2000 + k) for k in range(60)] + [(500 + k, 3000) for k in range(80)]
    edges = spark.createDataFrame(pairs + pairs[:5] + [(None, 1), (1, None)], "node bigint, key bigint")
    find = union_find([(("n", a), ("k", b)) for a, b in pairs])
    sets = {}
    for a, _ in pairs:
        sets.setdefault(find(("n", a)), set()).add(a)
    for small in (100_000, 0):
        got = {r.node: r.component for r in components(edges, small).collect()}
        assert set(got) == {a for s in sets.values() for a in s if len(s) > 1}
        # One component for each set, named by one of its nodes.
        assert all(len({got[a] for a in s}) == 1 and got[min(s)] in s for s in sets.values() if len(s) > 1)
    assert components(spark.createDataFrame([], "node bigint, key bigint")).count() == 0


def fixture(n, seed):
    rng = random.Random(seed)
    sid = lambda: rng.choice([f"r{rng.randrange(n)}"] * 20 + [None])
    who = lambda: rng.choice([None, "", " ", "unknown", "Unknown ", "نامشخص", "-", f"علي  {rng.randrange(n)}", f"علی {rng.randrange(n)}", f"SPK{rng.randrange(n)}", f"spk{rng.randrange(n)}"])
    u = [(sid(), who(), rng.choice(["train"] * 12 + ["Test ", "dev", "validation", None, ""]), "x") for _ in range(n * 2)]
    r = [(sid(), who(), rng.choice([None, "", f"A{rng.randrange(n * 2)}", f"a{rng.randrange(n * 2)}"]), rng.choice([None, f"T{rng.randrange(n * 2)}"]), "y") for _ in range(n)]
    return u, r


def test_torn_groups(spark):
    u, r = fixture(150, 2)
    form = lambda s: " ".join((s or "").replace("ي", "ی").split()).lower()
    pairs = [(("s", a), ("p", form(b))) for a, b, *_ in [x[:2] for x in u] + [x[:2] for x in r] if a and form(b) not in ("", "unknown", "نامشخص", "-")]
    pairs += [(("s", x[0]), (k, x[k].lower())) for x in r for k in (2, 3) if x[0] and x[k]]
    find = union_find(pairs)
    names = {"dev": "validation", "valid": "validation"}
    splits = {}
    for a, _, s, _ in u:
        if a and (s or "").strip():
            s = s.strip().lower()
            splits.setdefault(find(("s", a)), set()).add(names.get(s, s))
    every = {x[0] for x in u + r} - {None}
    want = {a for a in every if len(splits.get(find(("s", a)), ())) > 1}
    got = torn_groups(spark.createDataFrame(u, U), spark.createDataFrame(r, R))
    assert {x.source_id for x in got.collect()} == want and want


def test_assign_splits(spark):
    u = [(f"r{k}", None, None, "x") for k in range(3000)] + [(f"r{k % 300}", "hot", None, "x") for k in range(1500)] + [(None, "a", None, "x")]
    utterances, recordings = spark.createDataFrame(u, U), spark.createDataFrame([("only", None, None, None, "y")], R)
    out = assign_splits(utterances, recordings)
    assert out.groupBy("component").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    assert out.count() == out.select("source_id").distinct().count() == 3001
    rows = {r.split: r["count"] for r in out.join(utterances.drop("split", "component"), "source_id").groupBy("split").count().collect()}
    assert abs(rows["train"] / 4500 - 0.8) < 0.01 and abs(rows["test"] / 4500 - 0.1) < 0.01 and abs(rows["validation"] / 4500 - 0.1) < 0.01
    again = assign_splits(utterances.repartition(3), recordings)
    assert again.exceptAll(out).count() == 0
    assert assign_splits(utterances.limit(0), recordings.limit(0)).count() == 0
