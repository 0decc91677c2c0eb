from __future__ import annotations

import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sluice.llm import neighbours, quality, suffix_model
from sluice.workspace import workspace

SF = "/root/testdata/sf0.001"


def recall(found, vectors, every, k):
    ids = np.array(sorted(vectors))
    data = np.array([vectors[i] for i in ids], float)
    hits = wanted = 0
    for q in ids[ids % every == 0]:
        score = data @ np.array(vectors[q], float)
        score[ids == q] = -np.inf
        best = [i for i in ids[np.lexsort((ids, -score))][:k] if i != q]
        mine = sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, len(best) + 1))
        assert sorted(mine, key=lambda r: (-r.score, r.vec_id)) == mine
        assert all(math.isclose(r.score, float(np.dot(vectors[r.vec_id], vectors[q])), abs_tol=1e-9) for r in mine)
        hits += len({r.vec_id for r in mine} & set(best))
        wanted += len(best)
    return hits / wanted


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_nearest_recall(spark, sf):
    df = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet")
    vectors = {r.vec_id: r.embedding for r in df.collect()}
    assert recall(neighbours.nearest(df).collect(), vectors, 20, 20) >= 0.9


def test_nearest_by_blocks_norms_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 150)
    draw = np.random.default_rng(3)
    vectors = {i: (draw.standard_normal(8) * draw.uniform(0.1, 5)).tolist() for i in range(600)}
    vectors |= {i: vectors[20] for i in range(600, 700)}  # one very common vector
    rows = [(i, v, "x", 1.0) for i, v in vectors.items()]
    rows += [rows[0], (None, vectors[1], "x", 1.0), (2000, None, "x", 1.0), (2001, [0.0] * 8, "x", 1.0), (2002, [float("nan")] * 8, "x", 1.0)]
    rows += [(2003, [1.0] * 7 + [float("inf")], "x", 1.0), (2004, [1.0] * 7 + [None], "x", 1.0), (2020, [1.0, 2.0], "x", 1.0), (2040, [2.0, 1.0], "x", 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id string, score double")
    found = neighbours.nearest(df).collect()
    assert [(r.vec_id, r.score) for r in found if r.query_id == 2020] == [(2040, 4.0)]
    main = [r for r in found if r.query_id < 2000]
    assert recall(main, vectors, 20, 20) >= 0.9
    assert [r.vec_id for r in sorted((r for r in main if r.query_id == 20), key=lambda r: r.rank)][-20:] != []
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0]), (0, [-1.0, 0.0]), (0, [-1.0, 0.0]), (1, [1.0, 0.0]), (1, [3.0, 0.0]), (2, [0.0, 1.0])]
    found = neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.query_id for r in found} == {0}
    answers = sorted((r.rank, r.vec_id, r.score) for r in found)
    assert answers == sorted([(1, 1, 3.0), (2, 1, 1.0), (3, 2, 0.0), (4, 0, -1.0), (1, 2, 0.0), (2, 0, -1.0), (3, 1, -1.0), (4, 1, -3.0)])


def split(text):
    return (text or "").encode().lower().split()


def test_base_scores_are_brute_force(spark):
    rows = [(r.doc_id, r.text, 1.0) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    rows += [(None, None, 1.0), (None, "the the", 1.0), (3, "", 1.0), (3, "A A unheardof", 1.0), (4, "w " * 3000, 1.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score double").repartition(3)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    counts = Counter()
    for i, t, _ in rows:
        if not out(i):
            counts.update(split(t))
            counts[b""] += 1
    n, v = sum(counts.values()), len(counts)
    want = []
    for i, t, _ in rows:
        tokens = [*split(t), b""]
        want.append((i, out(i), len(tokens), sum(counts[w] > 0 for w in tokens), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens), 6)))
    found = suffix_model.score(df).collect()
    key = lambda r: tuple(map(repr, r))
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in found), key=key) == sorted(want, key=key)
    held = [r for r in suffix_model.score(df).collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert suffix_model.score(df.limit(0)).count() == 0
    assert [r.score for r in suffix_model.score(df.where("doc_id = 5").withColumn("text", df.text)).collect()] != []


def test_next_symbol_distributions_sum_to_one(spark):
    """Held-out texts ask for every word after a context, and for one that nobody has heard of."""
    draw = random.Random(2)
    texts = [" ".join(draw.choice(["a b c", "a b d", "b c", "x", "rare%d" % draw.randrange(50)]) for _ in range(40)) for _ in range(60)]
    every = [*sorted({w for t in texts for w in t.split()}), "unheard", ""]
    rows = [(t, False) for t in texts] + [(f"{before} {x}".strip(), True) for before in ("a b", "b", "x") for x in every]
    table = spark.createDataFrame(rows, "text string, held_out boolean")
    words, seed = suffix_model._numbered(table)
    total, distinct = words.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first()
    assert distinct == len(every) - 1
    levels, _ = suffix_model._levels(table, words, seed, total, distinct, suffix_model.Shape(divergence=5))
    assert math.isclose(levels[0].agg(F.sum("p")).first()[0], 1, rel_tol=1e-9)  # "unheard" is the one other word
    for level in levels[1:3]:
        whole = level.groupBy("k", "w").agg(F.sum("p").alias("p"), F.count(F.lit(1)).alias("n"), F.max("p").alias("most")).where(F.col("n") == len(every)).collect()
        assert whole and all(math.isclose(r.p, 1, rel_tol=1e-9) for r in whole)
        assert max(r.most for r in whole) > 0.3  # after "a b" comes c or d


def test_scores_use_every_context_and_successor(spark):
    """Brute force; contexts that training texts have five times count in a corpus of any size."""
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["a b c", "a b d", "b c", "x y", "w%d" % draw.randrange(3000)]) for _ in range(60)) for _ in range(500)]
    texts = [t + (" seldom seen pair%d" % (i % 3) if i % 71 == 0 else "") for i, t in enumerate(texts)] + [None, "seldom seen pair1 unheardof"]
    grams, n, follow = Counter(), Counter(), {}
    for i, t in enumerate(texts):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            words = [b"", *split(t), b""]
            for at in range(1, len(words)):
                for d in range(min(at, 3) + 1):
                    context = tuple(words[at - d : at])
                    grams[context, words[at]] += 1
                    n[context] += 1
                    follow.setdefault(context, set()).add(words[at])
    places = n[()] + len(follow[()]) + 1
    retained = {}

    def probability(context, word):
        if not context:
            return (grams[(), word] + 1) / places
        q = probability(context[1:], word)
        if n[context] < 5:
            return q
        total, free = n[context], len(follow[context]) + 5
        if context not in retained:
            gain = 0
            for x in follow[context]:
                c, short = grams[context, x], probability(context[1:], x)
                other = free - (c == 1)
                gain += c * math.log((c - 1 + other * short) / (total - 1 + other) / short)
            retained[context] = gain >= 10
        return (grams[context, word] + free * q) / (total + free) if retained[context] else q

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r.id: r.score for r in suffix_model.score(df).collect()}
    for i, t in enumerate(texts):
        words = [b"", *split(t), b""]
        want = sum(math.log10(probability(tuple(words[max(0, at - 3) : at]), words[at])) for at in range(1, len(words)))
        assert math.isclose(found[i], want, rel_tol=1e-9), i
    assert retained[b"seldom",] and n[b"seldom",] < 10  # however large the corpus


def test_no_row_is_written_for_each_pair_of_context_and_next_word(spark):
    """All pairs of rarer contexts are counted where their tokens are; frequent ones in tables give the same scores."""
    draw = random.Random(9)
    texts = [" ".join("w%d" % int(draw.paretovariate(0.7)) for _ in range(300)) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    folder = Path(workspace(spark).removeprefix("file:"))
    size = lambda: sum(f.stat().st_size for f in folder.rglob("*.parquet"))
    before = size()
    plain = {r.id: r.score for r in suffix_model.score(df).collect()}
    assert size() - before < sum(map(len, texts)) / 2
    tables = {r.id: r.score for r in suffix_model.score(df, often=400).collect()}
    assert plain.keys() == tables.keys()
    assert all(math.isclose(plain[i], tables[i], rel_tol=1e-9) for i in plain)


def test_words_and_their_numbers():
    texts = ["", " \t\n\x0b\x0c\r", "A b  \u00c9A\u00a0z\x1cq \u2003 B", " x" * 3, "y" * 300 + " " + "y" * 301 + " abcdefgh abcdefghi abcdefg\0", "\0 \0\0"]
    words, at, lengths = suffix_model._split(pa.chunked_array([pa.array(texts, pa.large_string())]))
    assert [words[i].as_py() for i in at] == [w for t in texts for w in split(t)]
    assert lengths.tolist() == [len(split(t)) for t in texts]
    assert words.to_pylist() == list(dict.fromkeys(w for t in texts for w in split(t)))
    for seed in (0, 1):
        found = suffix_model._hashed(words, seed)
        assert len(set(found.tolist())) == len(words)
        assert [suffix_model._hashed(words.slice(i, 1), seed)[0] for i in range(len(words))] == found.tolist()


def labelled(draw, i):
    kind = i % 5
    words = [draw.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(draw.randint(20, 60))]
    if kind == 0:
        words = [w.upper() + "!!" for w in words]
    if kind == 1:
        words[3], words[7] = "nastyword", "horridness"
    return (i, " ".join(words), "host%d" % (i % 3), "en"), (i, int(kind != 0), int(kind == 1))


def test_quality(spark):
    draw = random.Random(4)
    both = [labelled(draw, i) for i in range(400)]
    rows = [(*d, 1.0, 2.0) for d, _ in both] + [(None, "alpha beta", None, None, 1.0, 2.0), (900, None, "host0", None, 1.0, 2.0), (901, "", "new", "fr", 1.0, 2.0), (5, both[5][0][1], "host1", "en", 1.0, 2.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p_poor double, odds_toxic double")
    labels = spark.createDataFrame([x for _, x in both[:200]] + [(None, 0, 1), (3, None, None), (7, 1, 0)], "doc_id long, quality int, toxic int")
    judged = quality.judge(df, labels).collect()
    assert len(judged) == len(rows)
    by_id = {r.id: r for r in judged}
    for (i, *_), (_, good, toxic) in both[200:]:  # not seen by the fit
        assert by_id[i].rejected == (not good or bool(toxic))
    assert all(0 <= r.poor <= 1 and 0 <= r.toxic <= 1 for r in judged)
    kept = quality.accepted(df, labels)
    assert kept.columns == df.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(r.id) for r in judged if not r.rejected)
    none = labels.limit(0)
    assert quality.judge(df, none).where("rejected").count() == 0
    assert quality.accepted(df.limit(0), labels).count() == 0
    assert quality.judge(df, labels.where("quality = 1 and toxic = 0")).where("rejected").count() == 0


def test_sites_shrink_toward_their_host_and_the_whole(spark):
    rows = [("good", "a", -4.0, -4.0)] * 300 + [("bad", "a", 2.0, -4.0)] * 300 + [("bad", "b", 0.0, -4.0)] + [("new", None, 0.0, -4.0)]
    evidence = spark.createDataFrame(rows, "host string, path string, poor double, toxic double")
    rates = quality.path_rates(evidence)
    found = quality.with_posteriors(evidence, rates, evidence["host"], evidence["path"], quality.HEADS, ("p", "t"))
    p = {(r.host, r.path): r.p for r in found.collect()}
    assert p["bad", "b"] > p["new", None] > p["good", "a"]  # equal evidence at first, but the host is bad
    assert p["new", None] == pytest.approx(0.5, abs=0.15)  # nothing is known of it


@pytest.mark.parametrize("text", [None, "", "!!! ...", " \n\t"])
def test_labelled_rows_without_words(spark, text):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    known = [r.doc_id for r in labels.orderBy("doc_id").limit(3).collect()]
    docs = docs.withColumn("text", F.when(F.col("doc_id").isin(known), F.lit(text)).otherwise(F.col("text")))
    assert quality.judge(docs, labels).count() == docs.count()


def plain_posteriors(rows):
    """rows: host, path, log-odds of each head. The posterior of each, by the method's formulas."""
    p = lambda x: 1 / (1 + math.exp(-x))
    held = lambda r: math.log(min(max(r, 1e-6), 1 - 1e-6) / (1 - min(max(r, 1e-6), 1 - 1e-6)))
    found = []
    for head in (2, 3):
        sites, paths = {}, {}
        for r in rows:
            for table, key in ((sites, r[0]), (paths, r[:2])):
                n, total = table.get(key, (0, 0.0))
                table[key] = n + 1, total + p(r[head])
        mean = sum(p(r[head]) for r in rows) / len(rows)
        prior = lambda squares, count: max(min(mean * (1 - mean) / max((squares - count * mean * (1 - mean)) / len(rows), 1e-9) - 1, 1e6), 2.0)  # noqa: E731, B023
        k = prior(sum(n * (x / n - mean) ** 2 for n, x in sites.values()), len(sites))
        rate = {h: (k * mean + x) / (k + n) for h, (n, x) in sites.items()}
        within = prior(sum(n * (x / n - rate[key[0]]) ** 2 for key, (n, x) in paths.items()), len(paths))
        column = []
        for r in rows:
            n, x = paths[r[:2]]
            own = (within * rate[r[0]] + x - p(r[head])) / (within + n - 1)
            column.append(p(r[head] + held(own) - held(mean)))
        found.append(column)
    return list(zip(*found, strict=True))


def test_posteriors_are_the_plain_ones(spark):
    draw = random.Random(5)
    rows = [(draw.choice(["a", "b", None]), draw.choice(["x", "y", None]), draw.gauss(-1, 3), draw.gauss(-3, 2)) for _ in range(300)]
    rows += [("lonely", "x", 4.0, -1.0), ("hot", "x", 2.0, -30.0)] + [("hot", "x", -2.0, 1.0)] * 200
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, host string, path string, poor double, toxic double").repartition(4)
    rates = quality.path_rates(df)
    found = quality.with_posteriors(df, rates, df["host"], df["path"], quality.HEADS, ("p", "t")).orderBy("n").collect()
    for row, want in zip(found, plain_posteriors(rows), strict=True):
        assert (row.p, row.t) == pytest.approx(want, rel=1e-9)


def test_accepted_keeps_columns_of_any_name(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    plain = {r.doc_id for r in quality.accepted(docs, labels).collect()}
    odd = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["site", "Odds_poor", "__host", "host", "path", "n", "p_toxic", "evidence"])))
    found = quality.accepted(odd, labels)
    assert found.columns == odd.columns
    assert {r.doc_id for r in found.collect()} == plain
