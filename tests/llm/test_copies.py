from __future__ import annotations

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sluice.llm import components, exact_dedup, simhash


def print_of(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    bits = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))
    return bits - (1 << 64) if bits >> 63 else bits


def joined(prints, most):
    """The smallest place of each place's component."""
    root = list(range(len(prints)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if ((prints[i] ^ prints[j]) & ((1 << 64) - 1)).bit_count() <= most:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(prints))]


def test_fingerprint(monkeypatch):
    texts = [None, "", " \n", "One", "one two", "A b C", "É é x y z", "w " * 3000 + "x y z", "a b c\x1fd e f"]
    want = [print_of(t) for t in texts]
    assert [simhash.fingerprint(t) for t in texts] == want
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert [simhash.fingerprint(t) for t in texts] == want


@pytest.mark.parametrize("bucket", [1, 2, 32])
def test_links_join_what_brute_force_joins(spark, bucket):
    draw = random.Random(bucket)
    prints = [0, -1]
    for _ in range(12):
        centre = draw.getrandbits(64)
        for _ in range(draw.randint(1, 25)):
            value = centre
            for b in draw.sample(range(64), draw.randint(0, 3)):
                value ^= 1 << b
            prints.append(value - (1 << 64) if value >> 63 else value)
    prints = sorted(set(prints))
    links = simhash.links(spark.createDataFrame([(p,) for p in prints], "fingerprint long"), bucket=bucket)
    found = {r.node: r.component for r in components.components(links).collect()}
    assert [found.get(p, p) for p in prints] == [prints[i] for i in joined(prints, 2)]


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_near_copies(spark, monkeypatch, broadcast):
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    draw = random.Random(5)
    base = [" ".join(draw.choice("abcdefgh") for _ in range(60)) for _ in range(6)]
    rows = [(i, b) for i, b in enumerate(base)] + [(20 + i, b.upper() + " z") for i, b in enumerate(base)]
    rows += [(40, None), (41, ""), (42, " \n"), (43, "one"), (44, "ONE"), (0, base[0]), (None, base[1]), (None, "alone here")]
    df = spark.createDataFrame([(*r, 3, "k") for r in rows], "doc_id long, text string, fingerprint int, key string")
    prints = [print_of(t) for _, t in rows]
    roots = joined(prints, 2)
    least = {r: min((i for (i, _), x in zip(rows, roots, strict=True) if x == r and i is not None), default=None) for r in roots}
    want = sorted(((i, p, least[r]) for (i, _), p, r in zip(rows, prints, roots, strict=True)), key=repr)
    assert sorted((tuple(r) for r in simhash.near_copies(df).collect()), key=repr) == want
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(v) for v in least.values())
    assert simhash.near_copies(df.limit(0)).count() == 0


def test_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(300)]
    random.Random(1).shuffle(chain)
    found = {r.node: r.component for r in components.components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(1, 301)} | {1000 + i: 1000 for i in range(1, 300)}


DOCS = [(1, "same"), (2, "same"), (3, None), (4, ""), (5, "Same"), (6, "same "), (2, "same"), (None, "same"), (None, "alone"), (9, "é" * 50_000), (8, "é" * 50_000)]


def documents(spark, path, rows=DOCS):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, digest int, file string")
    df.repartition(3).write.parquet(path)


@pytest.mark.parametrize(("digest", "salt_rows"), [(exact_dedup.sha256, 512), (lambda t: F.lit("one"), 2), (lambda t: F.length(t).cast("string"), 512)])
def test_exact_copies(spark, tmp_path, monkeypatch, digest, salt_rows):
    """Also with digests that meet: the full bytes decide."""
    monkeypatch.setattr(exact_dedup, "SALT_ROWS", salt_rows)
    path = f"{tmp_path}/documents.parquet"
    documents(spark, path)
    found = exact_dedup.exact_copies(spark, path, digest=digest, files_per_batch=1).collect()
    groups: dict = {}
    for i, t in DOCS:
        groups.setdefault(t or "", []).append(i)
    want = sorted(((i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""])) for i, t in DOCS), key=repr)
    assert sorted(((r.id, r.keep_id, r.group_size) for r in found), key=repr) == want
    assert sorted(str(r.id) for r in found if r.kept) == sorted(str(max((x for x in g if x is not None), default=None)) for g in groups.values())


def test_exact_copies_of_nothing_and_by_join(spark, tmp_path, monkeypatch):
    documents(spark, f"{tmp_path}/empty.parquet", [])
    assert exact_dedup.exact_copies(spark, f"{tmp_path}/empty.parquet").count() == 0
    monkeypatch.setattr(exact_dedup, "BROADCAST_DIGESTS", 0)
    documents(spark, f"{tmp_path}/d.parquet")
    assert exact_dedup.exact_copies(spark, f"{tmp_path}/d.parquet").where("kept").count() == len({t or "" for _, t in DOCS})
