"""Source divergence, fill-in-middle and line rules beside plain versions."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sluice.llm import divergence, line_rules, middle

SCHEMA = "doc_id long, text string, lang string, source string, term string, h1 int, words string, output string, place int"
LONG = "verylongword" * 9


def frame(spark, rows, parts=3):
    """Documents with other columns whose names the operators use inside."""
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 2) for r in rows], SCHEMA).repartition(parts)


# ---- source divergence


def plain_divergence(rows, least, top):
    terms = lambda t: [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms(text))
        docs[lang].update(set(terms(text)))
    found = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        share = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        whole = share(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        mine = {s: share(counts[lang, s]) for k, s in groups if k == lang}
        for s, p in mine.items():
            apart = lambda p, q: (p - q) ** 2 // q
            pairs = [(o, sum(apart(p[t], q[t]) for t in kept)) for o, q in mine.items() if o != s]
            more = [(t, apart(p[t], whole[t])) for t in kept if counts[lang, s][t] and p[t] > whole[t]]
            for part, items in (("pair", pairs), ("term", more)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                found |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(items[: top if part == "term" else None], 1)}
    return found


ROWS = [
    (1, "The cat, the CAT and the dog's", "en", "a"), (1, "The cat, the CAT and the dog's", "en", "a"), (2, "the dog " + LONG, "en", "b"),
    (3, LONG + "x the cat " + LONG, "en", "b"), (4, f"{LONG} {LONG}x dog", "en", None), (None, "the é Éa ÉA éa cat", "en", "c"), (5, "éa éa 漢字 dog cat", "en", "c"),
    (6, "", "en", "empty"), (7, None, "fr", "a"), (8, "un deux", "fr", "b"), (9, "un", None, None), (10, "un un", None, None), (11, "UN trois", None, "a"),
    (12, "...", None, "a"), (13, "word " * 3000 + "tail " * 50, "en", "d"), (14, "tail word verylon verylongwo", "en", "a"), (15, "tail verylongw", "en", "d"),
]


@pytest.mark.parametrize(("slice_bytes", "block_rows", "tile"), [(1 << 20, 10_000, 128), (64, 3, 2), (1000, 5, 1)])
def test_divergence_is_the_plain_one(spark, slice_bytes, block_rows, tile):
    for least, top in ((1, 4), (3, 200)):
        found = divergence.source_divergence(frame(spark, ROWS), least_docs=least, top=top, slice_bytes=slice_bytes, block_rows=block_rows, tile=tile)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        rows = [tuple(r) for r in found.collect()]
        assert len(rows) == len(set(rows))
        assert set(rows) == plain_divergence(ROWS, least, top)


def test_divergence_of_nothing(spark):
    assert divergence.source_divergence(frame(spark, ROWS).limit(0)).count() == 0
    alone = divergence.source_divergence(frame(spark, [(1, None, None, None), (2, "", "x", "y"), (3, "", "x", "z")]))
    assert {tuple(r) for r in alone.collect()} == {("x", "y", "pair", "z", 0, 1), ("x", "z", "pair", "y", 0, 1)}


def test_divergence_of_sources_larger_than_a_tile(spark):
    rows = [(i, " ".join(f"{c * (1 + (i * k) % 5)}" for k, c in enumerate("abcdefgh")), "en", f"s{i % 40}") for i in range(200)]
    found = divergence.source_divergence(frame(spark, rows), tile=16, block_rows=20)
    assert {tuple(r) for r in found.collect()} == plain_divergence(rows, 3, 200)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=40) | st.sampled_from([LONG, LONG + "a", LONG + "b"]), max_size=30))
def test_pointers_are_sorted(words):
    data = b"\0".join(w.encode() for w in words) + bytes(8)
    ends = np.cumsum([len(w) + 1 for w in words], dtype=np.int64) - 1
    lengths = np.array([len(w) for w in words], np.int64)
    order, new = divergence.sorted_pointers(data, ends - lengths, lengths)
    assert [words[i] for i in order] == sorted(words)
    assert [bool(x) for x in new] == [i == 0 or sorted(words)[i] != sorted(words)[i - 1] for i in range(len(words))]


# ---- fill-in-middle


def plain_middle(doc, text):
    text, n = text or "", len(text or "")
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if h[3] % 100 < 20:
        return doc, n, "spm", a, b - a, f"<S>{text[b:]}<P>{text[:a]}<M>{text[a:b]}"
    return doc, n, "psm", a, b - a, f"<P>{text[:a]}<S>{text[b:]}<M>{text[a:b]}"


TEXTS = [None, "", "a", "é", "漢字 kana 😀 mixed é text\n", "<P", "P><S", "has <M> inside", "<", "😀" * 300, "plain words " * 40, "x" * 100_000, "\0\x01 \x85"]


def test_middle_is_the_plain_one(spark, monkeypatch):
    rows = [(i, TEXTS[i % len(TEXTS)], "x", "y") for i in range(400)] + [(None, "no id", "x", "y"), (3, "é", "x", "y"), (3, "é", "x", "y")]
    found = middle.fill_in_middle(frame(spark, rows))
    back = found.select("id", middle.rebuilt(found["output"], found["form"]).alias("text"))
    want = sorted((plain_middle(r[0], r[1]) for r in rows), key=repr)
    assert sorted((tuple(r) for r in found.collect()), key=repr) == want
    assert sorted(map(repr, back.collect())) == sorted(f"Row(id={r[0]!r}, text={r[1] or ''!r})" for r in rows)
    assert {"plain", "psm", "spm"} == {w[2] for w in want}
    assert middle.fill_in_middle(frame(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError, match="markers"):
        middle.fill_in_middle(frame(spark, rows), markers=("<P>", "<S>", "<<M>"))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 5), max_size=300), st.integers(0, 300))
def test_ranks(codes, at):
    matrix = middle.WaveletMatrix(np.array(codes, np.uint8))
    at = min(at, len(codes))
    for code in range(6):
        assert matrix.rank(code, np.array([at])).tolist() == [codes[:at].count(code)]


def test_small_slices_change_nothing(monkeypatch):
    import pyarrow as pa

    texts = [t or "" for t in TEXTS]
    columns = [pa.array(range(len(texts))), pa.array(texts), *(pa.array([7 * k + 3] * len(texts)) for k in range(4))]
    batch = pa.RecordBatch.from_arrays(columns, names=["id", "text", "h1", "h2", "h3", "h4"])
    run = middle._moved(90, 20, ("<P>", "<S>", "<M>"))
    whole = [r for b in run([batch]) for r in b.to_pylist()]
    monkeypatch.setattr(middle, "SLICE_BYTES", 7)
    assert [r for b in run([batch]) for r in b.to_pylist()] == whole


# ---- line rules


def plain_rules(doc, text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(words, words[1:], words[2:]))
    again = {i + k for i, w in enumerate(zip(words, words[1:], words[2:])) if windows[w] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    base_failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
    return doc, len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(again), base_failed


def test_base_is_the_plain_one(spark):
    texts = [None, "", " \n\t", "a b c a b c", "a a a a", "one two\none two\n\nthree", "é 漢字 | # <x>\n漢字", "w " * 30_000, " ".join(f"w{i}" for i in range(20_000)), "a\x0bb\x85c\x1cd\n"]
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)] + [(None, "a b", "x", "y"), (1, "", "x", "y")]
    found = line_rules.clean_lines(frame(spark, rows))
    names = ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert sorted((tuple(r) for r in found.select(names).collect()), key=repr) == sorted((plain_rules(r[0], r[1]) for r in rows), key=repr)
    assert line_rules.clean_lines(frame(spark, rows).limit(0)).count() == 0


PROSE = "\n".join(f"This{i} is{i} sentence number {i} of plain{i} text, and{i} it says thing {i * i}." for i in range(12))


@pytest.mark.parametrize(
    "line",
    ["Home", "Page 3 of 10", "News | Sport | Weather", "a > b > c", "We use cookies on this site", "### *** $$$", "Wow!! Great!!", "Copyright 2020, all rights reserved.", " ".join(f"tag{i}" for i in range(30))],
)
def test_failing_lines_go(spark, line):
    row = line_rules.clean_lines(frame(spark, [(1, f"{PROSE}\n{line}\n\nEnd of it.", "x", "y")])).first()
    assert row.kept
    assert row.n_failed_lines == 1
    assert row.text == f"{PROSE}\n\nEnd of it."
    assert row.n_words - row.n_words_left == len(line.split())


def test_documents_that_lose_too_much_go(spark):
    junk = "\n".join(f"Item{i} | Price{i} | Buy{i} now{i}" for i in range(60))
    kept = {r.id: r.kept for r in line_rules.clean_lines(frame(spark, [(1, PROSE, "x", "y"), (2, f"{PROSE}\n{junk}", "x", "y"), (3, "short text.", "x", "y")])).collect()}
    assert kept == {1: True, 2: False, 3: False}


def test_labelled_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = line_rules.clean_lines(spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {(r.quality, r.base_failed, r.kept): r["count"] for r in found.withColumnRenamed("id", "doc_id").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").groupBy("quality", "base_failed", "kept").count().collect()}
    passed = {k: n for k, n in rows.items() if not k[1]}
    assert sum(n for (q, _, kept), n in passed.items() if q == 1 and kept) >= 0.99 * sum(n for (q, *_), n in passed.items() if q == 1)
    assert sum(n for (q, _, kept), n in passed.items() if q == 0 and kept) <= 0.1 * sum(n for (q, *_), n in passed.items() if q == 0)

