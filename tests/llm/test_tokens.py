from __future__ import annotations

import uuid
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sluice.llm import packing, pretokens, token_counts, token_files

NAME = "byte_bpe_50k.json"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path(NAME))
TEXTS = [
    None, "", " ", "\n", "the cat", "  two  spaces \n\n and lines\t ", "it's we'll <|endoftext|> end", "x" * 5000, "é ß ǆ 漢字 😀 ²³ ٣",
    "a\x1cb \x85 c d e", "word, word. word!! %%% 12 3.4", "the cat", "lorem ipsum " * 4000, "<|endoftext|>", "é ﻿​",
]


def ids(text: str | None) -> list[int]:
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 4 else None, t, "x", 7, "y") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], "x", 7, "y")] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, id string, part int, members string").repartition(3)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from([*" \n\t '’s.é%7漢\x1c\x85\xa0_-Aaz", "  ", " the", "<|endoftext|>", "\r\n", "²", "́", " word", "'ll"]), max_size=14))
def test_encoder_is_the_library(parts):
    text = "".join(parts)
    encoder = pretokens.ids_encoder(NAME)
    assert np.frombuffer(encoder(text), "<u4").tolist() == ids(text)
    assert pretokens.Encoder(public_tokenizers.path(NAME), lengths=True)(text) == len(ids(text))


def test_cache_bound_changes_nothing(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_BYTES", 600)
    encoder = pretokens.Encoder(public_tokenizers.path(NAME), lengths=True, frequent={"the": 1})
    for text in [*TEXTS, *TEXTS]:
        assert encoder(text) == len(ids(text))
    assert len(encoder._spaced) <= 6


def test_counts(spark, docs):
    found = sorted(token_counts.token_counts(docs, NAME, table_size=3).collect(), key=repr)
    want = sorted(((r.doc_id, len((r.text or "").encode()), len(ids(r.text))) for r in docs.collect()), key=repr)
    assert sorted(map(tuple, found), key=repr) == want
    assert token_counts.token_counts(docs.limit(0), NAME).count() == 0


def test_frequent_pretokens_cover_all_tasks(spark):
    texts = spark.createDataFrame([(" rare" + " often" * 3 + " common" * 2,)] * 70, "text string").repartition(40)
    assert token_counts.frequent_pretokens(texts, 2) == ["common", "often"]


def test_token_files(spark, docs, tmp_path):
    path = f"{tmp_path}/{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, NAME, 0, files=4)
    read = token_files.read_token_files(spark, path)
    found = sorted(read.collect(), key=lambda r: r.start)
    order = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text or ""))
    start = 0
    for row, doc in zip(found, order, strict=True):
        assert (row.doc_id, row.start, row.ids) == (doc.doc_id, start, [*ids(doc.text), 0])
        start += row.n_tokens
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_files.digests(read).collect()}
    for row in found:
        assert crc[row.doc_id, row.start] == zlib.crc32(np.array(row.ids, "<u4").tobytes())
    token_files.write_token_files(docs.limit(0), path + "-empty", NAME, 0, files=2)
    assert token_files.digests(token_files.read_token_files(spark, path + "-empty")).count() == 0


def packed_well(rows, docs, capacity):
    """Checks the contract; the number of sequences."""
    texts = {}
    for doc in docs.collect():
        texts.setdefault(doc.doc_id, []).append([*ids(doc.text), 0])
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert by_doc.keys() == texts.keys()
    for doc, pieces in by_doc.items():
        want = sorted(
            (k, a, b - a, zlib.crc32(np.array(full[a:b], "<u4").tobytes()))
            for full in texts[doc]
            for cuts in [[0, *range(len(full) % capacity or capacity, len(full) + 1, capacity)]]
            for k, (a, b) in enumerate(zip(cuts, cuts[1:]))
        )
        assert sorted((p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    for members in by_sequence.values():
        at = 0
        for member in sorted(members, key=lambda m: m.offset):
            assert member.offset == at
            at += member.length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, docs):
    rows = packing.pack(docs, NAME, 0, capacity=64, slack=2).collect()
    packed_well(rows, docs, 64)
    assert packing.pack(docs.limit(0), NAME, 0).count() == 0


def test_packing_is_near_the_bound(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(16)
    rows = packing.pack(docs, NAME, 0).collect()
    sequences = packed_well(rows, docs, 2048)
    big = sum(r.length for r in rows)
    assert sequences <= 1.02 * -(-big // 2048) + 1


def test_best_fit_takes_the_fullest_bin():
    bins = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert [[int(i) for i in b] for b in bins] == [[0, 2], [1, 3, 4]]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from([*" \n\t '’s.é%7漢\x1c\x85\xa0_-Aaz", "  ", " the", "<|endoftext|>", "\r\n", "²", "́", " word", "'ll"]), max_size=9).map("".join) | st.none(), max_size=7), st.integers(1, 40))
def test_many_texts_at_a_time_are_the_library(texts, size):
    encoder = pretokens.ids_encoder(NAME)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(pretokens, "SLICE_BYTES", size)
        patch.setattr(pretokens, "_GATHERED", 3)
        found = [(b - a, *pretokens.with_end(i, e, 0)) for a, b, i, e in encoder.ids_of(pa.array([*TEXTS, *texts], pa.string()).slice(len(TEXTS)))]
    assert sum(n for n, _, _ in found) == len(texts)
    got = [i[x:y].tolist() for _, i, e in found for x, y in zip(e[:-1], e[1:], strict=True)]
    assert got == [[*ids(t), 0] for t in texts]


def test_words_used_once_do_not_fill_the_cache(monkeypatch):
    monkeypatch.setattr(pretokens, "CACHE_BYTES", 80_000)
    encoder = pretokens.Encoder(public_tokenizers.path(NAME), lengths=False)
    asked = []
    tokenize = encoder._tokenize
    monkeypatch.setattr(encoder, "_tokenize", lambda letters: asked.append(letters) or tokenize(letters))
    letters = "abcdefghij"
    for i in range(100):  # 150 words twice in each slice, among 1,000 that never come again
        once = ["x" + "".join(letters[int(d)] for d in f"{i * 1000 + j:06}") for j in range(1000)]
        often = ["y" + "".join(letters[int(d)] for d in str(j)) for j in range(150)]
        list(encoder.ids_of(pa.array([" ".join(["", *once[:500], *often, *often, *once[500:]]) + ","])))
    assert sum(w.startswith("Ġy") for w in asked) < 5000  # 15,000 without it
