"""Whole texts to ids of a byte-level BPE tokenizer file, one space-led chunk at a time.

The tokenizer first cuts a text with a pattern in which a space always starts a new piece when
a non-space follows it, and never merges across pieces. So a text may be cut at every such
space and each chunk encoded alone. Chunks repeat, so a worker keeps what it has encoded in a
bounded cache; the ids themselves always come from the ``tokenizers`` library:

* a chunk of Latin letters is one piece and goes straight to the library's BPE model;
* a chunk with other Latin signs is cut with the tokenizer's pattern first;
* any other chunk, and any text with special strings or control separators, is encoded whole.

Many texts at a time (``ids_of``) are cut by Arrow, which also finds their distinct chunks: each of
these is looked up once, and only words found twice go to the cache, so that rare ones do not fill it.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from tokenizers import Tokenizer

from sluice.llm.slices import ranges

#: Bytes of texts that are cut at once.
SLICE_BYTES = 8 << 20
#: Bytes that a worker's cache may take, about; bounds memory, not results.
CACHE_BYTES = 48 << 20
#: Bytes of an entry, about: chunks and values are short, and those of CACHE_CHARS are rare.
ENTRY_BYTES = 200
#: Longer chunks are encoded anew each time.
CACHE_CHARS = 64

_PIECES = regex.compile(public_tokenizers.PATTERN)
_GAP = re.compile(r" (?=\S)")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_WORD = re.compile(f"[{_LETTERS}]+").fullmatch
_WORD_AND_SIGNS = re.compile(rf"([{_LETTERS}]+)([!-/:-@\[-`{{-~]+)").fullmatch
_LATIN = re.compile("[\x00-ɏ]+").fullmatch
#: Chunks whose ids are put together at once, about.
_GATHERED = 1 << 18
#: Letters that byte-level BPE writes for a space.
_SPACE = "Ġ"


@cache
def _byte_letters() -> str:
    """The letter that byte-level BPE writes for each byte: itself if printable, else one above 255."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in printable else chr(next(others)) for b in range(256))


def _as_letters(text: str) -> str:
    return text.encode().decode("latin-1").translate(_byte_letters())


class _NotInChunks(Exception):
    """A chunk that shows that its text cannot be cut at every space. It is never cached, so every such text has one."""


class _Chunks(dict):
    """Encoded chunks in two generations of equal numbers. What is used again moves to the young one; when that
    is full, it becomes the old one and the old one goes. Pinned chunks stay."""

    def __init__(self, encode, most: int, pinned=()):
        super().__init__(pinned)
        self.encode, self.pinned, self.old = encode, dict(pinned), {}
        self.most = len(self.pinned) + most // 2 // ENTRY_BYTES

    def __missing__(self, chunk):
        value = self.old.get(chunk)
        if value is None:
            value = self.encode(chunk)
            if len(chunk) > CACHE_CHARS:
                return value
        if len(self) > self.most:
            self.old = dict(self)
            self.clear()
            self.update(self.pinned)
        self[chunk] = value
        return value

    def once(self, chunk):
        """What is not among the young, without keeping what is encoded."""
        value = self.old.get(chunk)
        return self.encode(chunk) if value is None else value


class Encoder:
    """Either lengths or ids (as little-endian unsigned 32-bit integers) of whole texts."""

    def __init__(self, path: str, lengths: bool, frequent: dict[str, int] | None = None):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenize = self._tokenizer.model.tokenize
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        self._spaced_special = any(" " in s for s in self._special)
        self._lengths = lengths
        self._join = sum if lengths else b"".join
        self._spaced = _Chunks(self._after_space, CACHE_BYTES * 3 // 4, frequent or ())
        self._bare = _Chunks(self._chunk, CACHE_BYTES // 4)

    def _after_space(self, chunk: str):
        """``chunk`` with the space before it."""
        if chunk.isascii() and chunk.isalpha():
            return self._piece(_SPACE + chunk)
        if not chunk or chunk[0].isspace():
            raise _NotInChunks
        if _WORD(chunk):
            return self._piece(_SPACE + _as_letters(chunk))
        if two := _WORD_AND_SIGNS(chunk):
            return self._spaced[two[1]] + self._bare[two[2]]
        return self._chunk(" " + chunk)

    def _chunk(self, chunk: str):
        if _SEPARATORS.search(chunk) or any(s in chunk for s in self._special):
            raise _NotInChunks
        if not _LATIN(chunk):
            return self._whole(chunk)
        pieces = _PIECES.findall(chunk)
        if len(pieces) == 1:
            return self._piece(_as_letters(chunk))
        return self._join([self._spaced[p[1:]] if p[0] == " " and _WORD(p[1:]) else self._bare[p] for p in pieces])

    def _piece(self, letters: str):
        found = self._tokenize(letters)
        return len(found) if self._lengths else array("I", [t.id for t in found]).tobytes()

    def _whole(self, text: str):
        found = self._tokenizer.encode(text, add_special_tokens=False).ids
        return len(found) if self._lengths else array("I", found).tobytes()

    def __call__(self, text: str | None):
        """The number of ids of ``text``, or the bytes of its ids; null is an empty text."""
        if not text:
            return 0 if self._lengths else b""
        if not self._spaced_special:
            try:
                return self._joined(text.split(" "))
            except _NotInChunks:
                pass
        if _SEPARATORS.search(text) or any(s in text for s in self._special):
            return self._whole(text)
        return self._joined(_GAP.split(text))

    def ids_of(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Ranges of ``texts``, all ids of a range one after another, and where those of each text begin and end."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        for a, b in ranges(edges, SLICE_BYTES):
            for first, last, ids, ends in self._ids_of(texts.slice(a, b - a)):
                yield a + first, a + last, ids, ends

    def _ids_of(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        lists = pc.split_pattern(texts, " ")
        chunks, bounds = lists.flatten().dictionary_encode(), lists.offsets.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        distinct, at = chunks.dictionary.to_numpy(zero_copy_only=False).tolist(), chunks.indices.to_numpy().copy()
        del lists, chunks
        values = self._spaced_values(distinct, np.bincount(at, minlength=len(distinct)).tolist())
        # a text's first chunk has no space before it, so it has an entry of its own
        first = at[bounds[:-1]].tolist()
        at[bounds[:-1]] = len(values) + np.arange(len(texts))
        values += [self._bare_value(distinct[i]) for i in first]
        uncut = np.fromiter((v is None for v in values), bool, len(values))
        if uncut.any() or self._spaced_special:
            whole = np.logical_or.reduceat(uncut[at], bounds[:-1]) | self._spaced_special
            nothing, values = len(values), [v or b"" for v in [*values, b""]]
            for text in np.nonzero(whole)[0].tolist():
                at[bounds[text] : bounds[text + 1]] = nothing
                at[bounds[text]] = len(values)
                values.append(self(texts[text].as_py()))
        sizes = np.fromiter(map(len, values), np.int64, len(values)) // 4
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(values), "<u4")
        del distinct, values
        for a, b in ranges(bounds, _GATHERED):
            entries = at[bounds[a] : bounds[b]]
            counts = sizes[entries]
            ends = np.cumsum(counts)
            source = np.repeat(starts[entries] - (ends - counts), counts)
            source += np.arange(len(source))
            yield a, b, pool[source], np.concatenate([[0], ends[bounds[a + 1 : b + 1] - bounds[a] - 1]])

    def _spaced_values(self, chunks: list[str], counts: list[int]) -> list[bytes | None]:
        """The ids of each chunk after a space, or None if its text cannot be cut there."""
        spaced, bare, values = self._spaced, self._bare, []
        for chunk, n in zip(chunks, counts, strict=True):
            try:
                if chunk.isalpha():
                    word, signs = chunk, b""
                elif two := _WORD_AND_SIGNS(chunk):
                    word, signs = two[1], bare[two[2]]
                else:
                    values.append(self._after_space(chunk))
                    continue
                values.append((spaced[word] if n > 1 or word in spaced else spaced.once(word)) + signs)
            except _NotInChunks:
                values.append(None)
        return values

    def _bare_value(self, chunk: str):
        try:
            return self._bare[chunk] if chunk else b""
        except _NotInChunks:
            return None

    def _joined(self, chunks: list[str]):
        first = self._bare[chunks[0]] if chunks[0] else (0 if self._lengths else b"")
        return first + self._join(map(self._spaced.__getitem__, chunks[1:]))


def with_end(ids: np.ndarray, edges: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with ``end_id`` after each text."""
    return np.insert(ids, edges[1:], np.uint32(end_id)), edges + np.arange(len(edges))


@cache
def ids_encoder(name: str) -> Encoder:
    """One encoder for each worker process and tokenizer file, so that its cache outlives a task."""
    return Encoder(public_tokenizers.path(name), lengths=False)
