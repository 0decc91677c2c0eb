from __future__ import annotations

import hashlib
import random
import re

import pytest

from sluice.llm import mixing


def brute(docs):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    h = lambda i, t: int(hashlib.md5(f"{'' if i is None else i}:{t or ''}".encode()).hexdigest()[:15], 16)
    sources = sorted({s for _, _, s in docs}, key=lambda s: (s is None, s or ""))
    total = {s: sum(size(t) for _, t, x in docs if x == s) for s in sources}
    weight = {s: 1 + k % 3 for k, s in enumerate(sources)}
    goal = {s: sum(total.values()) * weight[s] / sum(weight.values()) for s in sources}
    stopped: set = set()
    while over := {s for s in sources if s not in stopped and goal[s] > 3 * total[s] + 1e-9}:
        stopped |= over
        excess = sum(goal[s] - 3 * total[s] for s in over)
        goal |= {s: 3 * total[s] for s in over}
        rest = [s for s in sources if s not in stopped]
        for s in rest:
            goal[s] += excess * weight[s] / sum(weight[x] for x in rest)
    found = {}
    for s in sources:
        if not total[s]:
            continue
        whole = min(3, int(goal[s] / total[s] + 1e-12))
        before, budget = 0, goal[s] - whole * total[s]
        by_hash: dict = {}
        for i, t, x in docs:
            if x == s:
                by_hash[h(i, t)] = by_hash.get(h(i, t), 0) + size(t)
        for value in sorted(by_hash):
            found[s, value] = whole + (whole < 3 and before + by_hash[value] / 2 <= budget)
            before += by_hash[value]
    return sorted(((i, size(t), total[s], round(goal[s], 6), size(t) * found.get((s, h(i, t)), 0)) for i, t, s in docs), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_mix_is_brute_force(spark, seed):
    draw = random.Random(seed)
    words = lambda: draw.choice([None, "", " ", "a", "a b\tc\n d", "w " * draw.randint(1, 60)])
    docs = [(i, words(), draw.choice(["a", "a", "a", "b", "é", "Z", None])) for i in range(120)]
    docs += [(None, "x y", "a"), (7, "r " * 30, "a"), (7, "r " * 30, "a"), (999, None, "empty")]
    df = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, source string, size int, target int")
    mixed = mixing.mix(df)
    found = [(r.id, r.size, r.source_size, round(r.target, 6), r.size * r.copies) for r in mixed.collect()]
    assert sorted(found, key=repr) == brute(docs)
    repeated = mixing.repeated(df)
    assert repeated.columns == df.columns
    assert repeated.count() == sum(r.copies for r in mixed.collect())


def test_rows_that_share_an_id_are_taken_one_by_one(spark):
    docs = [(None if i % 2 else 5, f"w{i} " * 10, "a") for i in range(30)] + [(100 + i, f"v{i} " * 10, "b") for i in range(60)]
    mixed = mixing.mix(spark.createDataFrame(docs, "doc_id long, text string, source string")).where("source = 'a'").collect()
    assert {r.target for r in mixed} == {300.0}
    again = mixing.mix(spark.createDataFrame(docs + [(7, "x " * 150, "b")], "doc_id long, text string, source string")).where("source = 'a'").collect()
    assert {r.target for r in again} == {350.0}
    assert abs(sum(r.size * r.copies for r in again) - 350) <= 5


def test_no_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert mixing.mix(empty).count() == 0
    assert mixing.repeated(empty).count() == 0


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, source string")
    plan = mixing.mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
