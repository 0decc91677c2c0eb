from __future__ import annotations

import random
import re

import pytest

from sluice.llm import line_runs


def brute(docs, least):
    """Every pair of places, as the words of the module say."""
    lines = [None if t is None else t.split("\n") for _, t in docs]
    order = sorted((i for i in range(len(docs)) if lines[i] is not None), key=lambda i: (docs[i][0] is not None, docs[i][0] or 0, i))
    places = [(i, k) for i in order for k in range(len(lines[i]))]
    removed = [set() for _ in docs]
    for at, (i, k) in enumerate(places):
        longest = 0
        for j, m in places[:at]:
            n = 0
            while k + n < len(lines[i]) and m + n < len(lines[j]) and lines[i][k + n] == lines[j][m + n]:
                n += 1
            longest = max(longest, n)
        if longest and sum(len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines[i][k : k + longest]) >= least:
            removed[i].update(range(k, k + longest))
    return [
        (d, None if t is None else "\n".join(x for k, x in enumerate(lines[i]) if k not in removed[i]), len(lines[i] or ()), len(removed[i]))
        for i, (d, t) in enumerate(docs)
    ]


def some(seed):
    draw = random.Random(seed)
    base = [draw.choice(["a", "b b", "c", "d d d", "", "e"]) for _ in range(60)]
    docs = []
    for d in range(14):
        n, i = draw.choice([0, 1, 3, 8, 25]), draw.randrange(50)
        lines = base[i : i + n] if draw.random() < 0.5 else [draw.choice(["a", "b b", "c"]) for _ in range(n)]
        docs.append((d, "\n".join(lines * 2 if draw.random() < 0.3 else lines)))
    return [*docs, (3, docs[3][1]), (None, docs[5][1]), (50, None), (51, ""), (52, "\n\n"), (53, "\n\n"), (54, docs[5][1] + "\n")]


@pytest.mark.parametrize(("seed", "least", "broadcast"), [(1, 1, 0), (2, 4, 1000)])
def test_is_brute_force(spark, monkeypatch, seed, least, broadcast):
    monkeypatch.setattr(line_runs, "BROADCAST_RUNS", broadcast)
    docs = some(seed)
    rows = [(*d, k, "x") for k, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _file int, runs string").coalesce(1)
    found = line_runs.without_repeats(df, least, report=("n", "gone"))
    assert found.columns == [*df.columns, "n", "gone"]
    assert [(r.doc_id, r.text, r.n, r.gone) for r in sorted(found.collect(), key=lambda r: r._file)] == brute(docs, least)


def test_long_repeat_and_nothing(spark):
    passage = "\n".join(f"line {i} of a passage" for i in range(37))
    df = spark.createDataFrame([(1, "own\n" + passage), (2, passage + "\nmine"), (3, "short\ntext"), (4, "short\ntext")], "doc_id long, text string")
    found = {r.doc_id: r.text for r in line_runs.without_repeats(df).collect()}
    assert found == {1: "own\n" + passage, 2: "mine", 3: "short\ntext", 4: "short\ntext"}
    assert line_runs.without_repeats(df.limit(0)).count() == 0


def test_no_python_on_the_way(spark):
    df = spark.createDataFrame([(1, "a b\na b")], "doc_id long, text string")
    plan = line_runs.without_repeats(df, 1)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
