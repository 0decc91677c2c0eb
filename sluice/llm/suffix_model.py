"""Scoring texts with a probabilistic suffix tree over words.

Tokens are words (runs without ASCII white space, A-Z in lower case) and one end a text. The
tree is learned from all training texts, level by level:

* root: add-one counts over all V distinct tokens and one place for any other;
* a context of d words, up to ``depth``, is a candidate if training texts have it ``least`` times or
  more, whatever the size of the corpus; all that follows it are its successors, rare words too;
* a distribution with T distinct successors gives T + ``discount`` counts more to that of its suffix:
  P(x | s) = (c(s, x) + (T(s) + discount) P(x | suffix)) / (N(s) + T(s) + discount);
* a context is retained if its distribution diverges from that of its suffix: the sum of
  ln(P(x | s) / P(x | suffix)) over all its occurrences, each judged by the others alone (so that
  what was seen once is no evidence), reaches ``divergence`` nats.

A token is scored in the longest retained suffix of what precedes it. Counts cover all training texts.

Where the counting runs: the root and what is very frequent (``often`` occurrences or more) are tables, level by
level: grouped counts and a join with the level before. The subtree of any rarer context is counted in one group:
the tokens go there, packed many to a row, with the words before them and the number of their text, meet what the
tables say of them, and come back as sums by text. So the tokens of all texts are shuffled once, in some eight
bytes each, no group holds more than a share of bounded size and one such subtree, and no table of pairs of
context and next word is written for contexts that are not very frequent.

A word goes by 64 bits of its digest, under a seed by which no two words of the texts are alike
(checked). A context goes by a 64-bit hash. Only bitmaps of bounded size, which tell contexts that are surely not
very frequent (what they let through by chance is in the tables too) and words that no context can have, and the most frequent words (half a
million at most) are broadcast.

Null text is empty: its end is its only token. A null id is in the training part or not by the
checksum of empty text. Repeated rows and ids are scored row by row. Without training texts every
probability is that of the one other place. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.registry import importable
from sluice.llm.slices import ranges, text_bytes
from sluice.workspace import written

END = ""
_END = pa.array([END.encode()], pa.large_binary())
_BITS = 26  # of the bitmap's places, at most
_TEXT = 6_000_000  # bytes of texts at a time
_LONG = 256  # bytes of a word that is hashed by itself
_FREQUENT = 1 << 19  # words whose counts are broadcast, at most
_OFTEN = 2_000_000  # times, and a context is no longer counted in one group
_GROUP = 1_000_000  # tokens counted in one group, on average
_GROUPS = 64  # at least


@dataclass(frozen=True)
class Shape:
    depth: int = 3
    divergence: float = 10.0
    discount: float = 5.0
    least: int = 5


def held_out(identifier: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(identifier.cast("string"), F.lit(""))) % parts == part


def _hashed(words: pa.Array, seed: int) -> np.ndarray:
    """64 bits for each word, eight of its bytes at a time."""
    words = words.cast(pa.large_binary())
    edges, data = text_bytes(words)
    data = np.concatenate([np.frombuffer(data or b"", np.uint8), np.zeros(8, np.uint8)])
    eights = np.lib.stride_tricks.sliding_window_view(data, 8)
    starts, lengths = edges[:-1], np.diff(edges)
    found = _mix(np.full(len(words), seed, np.uint64), lengths.astype(np.uint64))
    left = np.nonzero((lengths > 0) & (lengths <= _LONG))[0]
    for done in range(0, _LONG, 8):
        left = left[lengths[left] > done]
        if not len(left):
            break
        part = eights[starts[left] + done].view(np.uint64)[:, 0]
        beyond = np.maximum(done + 8 - lengths[left], 0).astype(np.uint64) * np.uint64(8)
        found[left] = _mix(found[left], part & (np.uint64(0xFFFFFFFFFFFFFFFF) >> beyond))
    for i in np.nonzero(lengths > _LONG)[0]:
        digest = blake2b(data[starts[i] : edges[i + 1]], digest_size=8, key=seed.to_bytes(8, "little")).digest()
        found[i] = int.from_bytes(digest, "little")
    return found


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows, with null texts empty and a bounded size of texts at a time."""

    def cut(held: list[pa.RecordBatch]) -> Iterator[pa.Table]:
        table = pa.Table.from_batches(held).combine_chunks()
        text = pc.fill_null(table.column("text").cast(pa.large_string()), "").combine_chunks()
        table = table.set_column(table.schema.get_field_index("text"), "text", text)
        for a, b in ranges(text_bytes(text)[0], _TEXT):
            yield table.slice(a, b - a)
            pa.default_memory_pool().release_unused()

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.nbytes
        if size > _TEXT:
            yield from cut(held)
            held, size = [], 0
    if held:
        yield from cut(held)


def _split(text: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words, all words as places in them, and how many each text has."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(text.combine_chunks()))
    words, ends = parts.flatten(), np.cumsum(pc.list_value_length(parts).to_numpy())
    blank = pc.equal(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    if blank.any():
        ends = np.concatenate([[0], np.cumsum(~blank)])[ends]
        words = words.filter(pa.array(~blank))
    words = words.dictionary_encode()
    return words.dictionary.cast(pa.large_binary()), words.indices.to_numpy(), np.diff(ends, prepend=0)


def _word_counts(seed: int):
    """All words with their numbers and how often training texts have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches):
            words, at, lengths = _split(table.column("text"))
            train = ~table.column("held_out").to_numpy()
            counts = np.bincount(at[np.repeat(train, lengths)], minlength=len(words))
            words = pa.concat_arrays([words, _END])
            columns = [words.cast(pa.large_string()).cast(pa.string()), _signed(_hashed(words, seed)), pa.array(np.append(counts, train.sum()))]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "x", "n"])

    return run


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of both; for a given ``a`` no two ``b`` meet."""
    z = a * np.uint64(0x9E3779B97F4A7C15) + b
    z = (z ^ (z >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return z ^ (z >> np.uint64(32))


def _places(before: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
    return (_mix(before, last) >> np.uint64(64 - bits)).astype(np.int64)


def _unsigned(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).view(np.uint64)


def _marks(size: int):
    """The bitmap's words of 64 bits for contexts (words before, last word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            places = np.unique(_places(_unsigned(batch.column(0)), _unsigned(batch.column(1)), size))
            word, start = np.unique(places >> 6, return_index=True)
            bits = np.bitwise_or.reduceat(np.uint64(1) << (places & 63).astype(np.uint64), start)
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    return run


def _extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(words before, last word, next word) to (words before the next, next)."""
    for batch in batches:
        before = _mix(_unsigned(batch.column(0)), _unsigned(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(before.view(np.int64)), batch.column(2)], names=["k", "w"])


def _bitmap(contexts: DataFrame, n: int) -> np.ndarray:
    """16 places for each of ``n`` contexts, as far as they fit."""
    size = min(_BITS, max(16, (16 * n).bit_length()))
    marks = contexts.mapInArrow(_marks(size), "word long, bits long").groupBy("word").agg(F.expr("bit_or(bits)").alias("bits"))
    word, bits = _collected(marks, "word", "bits")  # 2 ** (_BITS - 6) rows at most
    found = np.zeros(1 << (size - 6), np.uint64)
    found[word] = bits.view(np.uint64)
    return found


def _in_bitmap(before: np.ndarray, last: np.ndarray, bits: np.ndarray) -> np.ndarray:
    place = _places(before, last, len(bits).bit_length() + 5)
    return (bits[place >> 6] >> (place & 63).astype(np.uint64)) & np.uint64(1) != 0


def _candidates(ids: np.ndarray, offsets: np.ndarray, maps: list[np.ndarray]):
    """For each depth: the words before the last as a hash, and where the context that ends there may be a candidate."""
    before, ok = np.zeros(len(ids), np.uint64), np.ones(len(ids), bool)
    for d, bits in enumerate(maps):
        if d:
            before = np.concatenate([before[:1], _mix(before[:-1], ids[:-1])])
            ok = ok & (offsets >= d)
        at = np.nonzero(ok)[0]
        ok = ok.copy()
        ok[at] = _in_bitmap(before[at], ids[at], bits)
        yield before, ok


def _sequences(table: pa.Table, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words, the end last; all words of the texts between ends, as places in them; each one's place in
    its text and the row's number."""
    words, at, lengths = _split(table.column("text"))
    lengths = lengths + 2
    starts = np.cumsum(lengths) - lengths
    offsets = np.arange(lengths.sum()) - np.repeat(starts, lengths)
    inner = np.ones(len(offsets), bool)
    inner[starts] = inner[starts + lengths - 1] = False
    found = np.full(len(offsets), len(words), np.int32)
    found[inner] = at
    return _hashed(pa.concat_arrays([words, _END]), seed), found, offsets, np.repeat(np.arange(len(lengths)), lengths)


def _signed(array: np.ndarray) -> pa.Array:
    return pa.array(array.view(np.int64))


def _places_of(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Equal keys get equal places, from 0; and how many there are."""
    found = pa.array(keys).dictionary_encode()
    return found.indices.to_numpy(), len(found.dictionary)


def _grams(seed: int, maps):
    """(words before, the same of the suffix, last word, next word, times in training) at the deepest level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches):
            distinct, places, offsets, numbers = _sequences(table, seed)
            words = distinct[places]
            last, shorter = None, np.zeros(len(words), np.uint64)
            for before, ok in _candidates(words, offsets, [m.value for m in maps]):
                shorter, last = (last[0] if last else shorter), (before, ok)
            at = np.nonzero(last[1][:-1] & (offsets[1:] > 0))[0]
            place, n = _places_of(_mix(_mix(last[0][at], words[at]), words[at + 1]))
            times = np.bincount(place[~table.column("held_out").to_numpy()[numbers[at]]], minlength=n)
            first = np.empty(n, np.int64)
            first[place] = at
            columns = [_signed(last[0][first]), _signed(shorter[first]), _signed(words[first]), _signed(words[first + 1]), pa.array(times)]
            yield pa.RecordBatch.from_arrays(columns, names=["k", "s", "w", "x", "n"])

    return run


def _asked(d, context: np.ndarray, x: np.ndarray) -> np.ndarray:
    """What names ``x`` after a context of ``d`` words in the tables; without a context the word itself."""
    return np.where(d > 0, _mix(context + np.uint64(d), x), x)


def _named(d: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, w, x = (_unsigned(batch.column(i)) for i in range(3))
            yield pa.RecordBatch.from_arrays([_signed(_asked(np.uint64(d), _mix(k, w), x)), *batch.columns[3:]], names=["g", "c", "p"])

    return run


def _context(words: list[np.ndarray]) -> np.ndarray:
    """The hash of the context of the last word, the one before, and so on."""
    return reduce(_mix, reversed(words), np.zeros(len(words[0]), np.uint64))


@dataclass
class _Tokens:
    """Tokens with what precedes them: their rows, the distinct words, the places in them of the token, the last
    word before it and so on, how many of those before it can be in a context, how many of them the tables cover,
    the name in the tables, the group that counts them."""

    row: np.ndarray
    distinct: np.ndarray
    places: list[np.ndarray]
    there: np.ndarray
    covered: np.ndarray
    asked: np.ndarray
    group: np.ndarray


def _tokens(table: pa.Table, seed: int, able, maps, depth: int, groups: int) -> _Tokens:
    distinct, places, offsets, numbers = _sequences(table, seed)
    at = np.nonzero(offsets[1:] > 0)[0]
    covered, context = np.zeros(len(at), np.uint8), np.zeros(len(at), np.uint64)
    if maps:
        words = distinct[places]
        for d, (before, ok) in enumerate(_candidates(words, offsets, [m.value for m in maps]), 1):
            here = np.nonzero(ok[at])[0]
            covered[here], context[here] = d, _mix(before[at[here]], words[at[here]])
    may = _in_bitmap(np.zeros(len(distinct), np.uint64), distinct, able.value)[places]
    there, run = covered.copy(), np.ones(len(at), bool)
    for d in range(depth):
        run = run & (offsets[at] >= d) & may[at - d]
        there[run & (there == d)] = d + 1
    before = [np.where(there > d, places[at - d], np.int32(len(distinct) - 1)) for d in range(depth)]
    asked = distinct[places[at + 1]]
    if maps:
        asked = _asked(covered.astype(np.uint64), context, asked)
    group = asked.copy()  # where no longer context is left to count
    for d in range(min(len(maps) + 1, depth)):
        here = np.nonzero((covered == d) & (there > d))[0]
        group[here] = _context([distinct[b[here]] for b in before[: d + 1]])
    group = ((_mix(np.uint64(0), group) >> np.uint64(32)) % np.uint64(groups)).astype(np.int32)
    return _Tokens(numbers[at], distinct, [places[at + 1], *before], there, covered, asked, group)


@dataclass(frozen=True)
class _Frequent:
    """Words by falling count, their counts, the words by rising number and their places in the first."""

    words: np.ndarray
    counts: np.ndarray
    rising: np.ndarray
    order: np.ndarray

    def places(self, words: np.ndarray) -> np.ndarray:
        """Where each word is, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1, np.int32)
        at = np.minimum(np.searchsorted(self.rising, words), len(self.rising) - 1)
        return np.where(self.rising[at] == words, self.order[at], -1).astype(np.int32)


def _packed(columns: list[np.ndarray]) -> bytes:
    """Columns of 32 bits, compressed byte by byte."""
    planes = b"".join(c.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)
    return pa.compress(planes, codec="zstd", asbytes=True)


def _unpacked(packed: bytes, n: int, count: int) -> list[np.ndarray]:
    planes = np.frombuffer(pa.decompress(packed, count * n * 4, codec="zstd", asbytes=True), np.uint8)
    return [np.ascontiguousarray(c.T).view(np.uint32).ravel() for c in planes.reshape(count, 4, n)]


def _dealt(seed: int, able, maps, frequent, depth: int, groups: int):
    """For each group the tokens it counts, many to a row: the first text's number, how many tokens, the words that
    are not frequent, and packed columns; and the texts themselves, many to a row of any group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, known = TaskContext.get().partitionId() << 33, frequent.value
        for table in _slices(batches):
            found = _tokens(table, seed, able, maps, depth, groups)
            order = np.argsort(found.group, kind="stable")
            held, rows = table.column("held_out").to_numpy(), found.row[order]
            state = found.covered[order] + (found.there[order].astype(np.int32) << 8) + (held[rows].astype(np.int32) << 16)
            places = [p[order] for p in found.places]
            code_of = known.places(found.distinct)
            edges = np.searchsorted(found.group[order], np.arange(groups + 1))
            out = []
            for group in np.nonzero(np.diff(edges))[0]:
                here = slice(edges[group], edges[group + 1])
                place = np.stack([p[here] for p in places])
                code = code_of[place]
                rare = code < 0
                others, inverse = np.unique(place[rare], return_inverse=True)
                code[rare] = len(known.words) + inverse
                columns = [np.diff(rows[here], prepend=0), state[here], *code]
                out.append((int(group), row, code.shape[1], found.distinct[others].tobytes(), _packed(columns)))
            yield pa.RecordBatch.from_pylist([dict(zip(_DEALT.names, r, strict=True)) for r in out], _DEALT)
            texts = pa.record_batch([table.column("id").combine_chunks(), table.column("held_out").combine_chunks(), pa.array(np.bincount(found.row))], names=["id", "held_out", "n"])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, texts.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write(texts)
            whole = {"part": (row >> 33) % groups, "row": row, "n": 0, "others": b"", "packed": sink.getvalue().to_pybytes()}
            yield pa.RecordBatch.from_pylist([whole], _DEALT)
            row += table.num_rows

    return run


_DEALT = pa.schema({"part": pa.int64(), "row": pa.int64(), "n": pa.int64(), "others": pa.binary(), "packed": pa.binary()})
_DEALT_SQL = "part long, row long, n long, others binary, packed binary"


def _questions(seed: int, able, maps, frequent, depth: int, groups: int):
    """What each group has to ask the tables, beside the frequent words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _slices(batches):
            found = _tokens(table, seed, able, maps, depth, groups)
            rare = frequent.value.places(found.distinct) < 0
            at = np.nonzero((found.covered > 0) | rare[found.places[0]])[0]
            asked = found.asked[at]
            place, n = _places_of(_mix(found.group[at].astype(np.uint64), asked))
            first = np.empty(n, np.int64)
            first[place] = at
            yield pa.RecordBatch.from_arrays([pa.array(found.group[first].astype(np.int64)), _signed(found.asked[first])], names=["part", "g"])

    return run


def _counted(frequent, depth: int, shape: Shape, root: float):
    """The sums of one group's tokens by text, and the texts that are dealt to it."""

    def read(dealt: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The rows, the state, the codes of the token, the last word and so on, and the words they stand for."""
        known, total, done, more = frequent.value.words, pc.sum(dealt.column("n")).as_py(), 0, 0
        rows, state, codes, others = np.empty(total, np.int64), np.empty(total, np.uint32), np.empty((depth + 1, total), np.uint32), [known]
        for r in dealt.to_batches(max_chunksize=1):
            row, n, rare, packed = (r.column(c)[0].as_py() for c in _DEALT.names[1:])
            delta, state[done : done + n], *words = _unpacked(packed, n, depth + 3)
            rows[done : done + n] = np.cumsum(delta.astype(np.int64)) + row
            for line, code in zip(codes, words, strict=True):
                line[done : done + n] = np.where(code < len(known), code, code + np.uint32(more))
            others.append(np.frombuffer(rare, np.uint64))
            done, more = done + n, more + len(others[-1])
        return rows, state, codes, np.concatenate(others)

    def grown(p: np.ndarray, words: np.ndarray, codes: np.ndarray, there: np.ndarray, covered: np.ndarray, train: np.ndarray) -> None:
        """``p`` by each token's longest retained context, given that by the longest one of the tables."""
        fewer = np.zeros(len(p), bool)  # a shorter context here has too few occurrences
        for d in range(1, depth + 1):
            at = np.nonzero((covered < d) & (there >= d) & ~fewer)[0]
            context = _context([words[c[at]] for c in codes[1 : d + 1]])
            place, n = _places_of(context)
            held = np.bincount(place[train[at]], minlength=n)
            enough = held[place] >= shape.least
            fewer[at[~enough]] = True
            at, place, context = at[enough], place[enough], context[enough]
            pair, m = _places_of(_mix(context, words[codes[0][at]]))
            c = np.bincount(pair[train[at]], minlength=m)
            of, q = np.empty(m, np.int64), np.empty(m)
            of[pair], q[pair] = place, p[at]
            seen = c > 0
            free = np.bincount(of[seen], minlength=n) + shape.discount
            others = free[of] - (c == 1)
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = c * np.log(((c - 1) / q + others) / (held[of] - 1 + others))
            retained = np.bincount(of[seen], gain[seen], minlength=n) >= shape.divergence
            p[at] = np.where(retained[of], (c + free[of] * q) / (held[of] + free[of]), q)[pair]

    def run(dealt: pa.Table, answers: pa.Table) -> pa.Table:
        size, found = dealt.column("n").to_numpy(), []
        if (size > 0).any():
            row, state, codes, words = read(dealt.filter(pa.array(size > 0)))
            covered, there, train = (state & 255).astype(np.uint8), (state >> 8).astype(np.uint8), state >> 16 == 0
            plain = (covered == 0) & (codes[0] < len(frequent.value.words))
            c, p = np.zeros(len(row), np.int64), np.zeros(len(row))
            c[plain] = frequent.value.counts[codes[0][plain]]
            p[plain] = (c[plain] + 1) / root
            rest = np.nonzero(~plain)[0]
            if len(rest):
                context = np.zeros(len(rest), np.uint64)
                for d in range(1, int(covered.max()) + 1):
                    here = np.nonzero(covered[rest] == d)[0]
                    context[here] = _context([words[line[rest[here]]] for line in codes[1 : d + 1]])
                asked, g = _asked(covered[rest].astype(np.uint64), context, words[codes[0][rest]]), _unsigned(answers.column("g").combine_chunks())
                order = np.argsort(g)
                place = order[np.searchsorted(g, asked, sorter=order)]
                c[rest], p[rest] = answers.column("c").to_numpy()[place], answers.column("p").to_numpy()[place]
            grown(p, words, codes, there, covered, train)
            place, n = _places_of(row)
            rows = np.empty(n, np.int64)
            rows[place] = row
            sums = [np.bincount(place, c > 0, n).astype(np.int64), np.bincount(place, np.log10(c + 1), n), np.bincount(place, np.log10(p), n)]
            found.append(pa.table([pa.array(rows), pa.nulls(n, pa.int64()), pa.nulls(n, pa.bool_()), pa.nulls(n, pa.int64()), *map(pa.array, sums)], _SUMS))
        for r in dealt.filter(pa.array(size == 0)).to_pylist():
            texts = pa.ipc.open_stream(r["packed"]).read_all()
            n, lacks = texts.num_rows, [pa.nulls(texts.num_rows, kind) for kind in _SUMS.types[4:]]
            found.append(pa.table([pa.array(np.arange(n) + r["row"]), *texts.columns, *lacks], _SUMS))
        pa.default_memory_pool().release_unused()
        return pa.concat_tables(found) if found else _SUMS.empty_table()

    return run


_SUMS = pa.schema({"row": pa.int64(), "id": pa.int64(), "held_out": pa.bool_(), "n": pa.int64(), "n_known": pa.int64(), "counts": pa.float64(), "score": pa.float64()})
_SUMS_SQL = "row long, id long, held_out boolean, n long, n_known long, counts double, score double"


def _collected(rows: DataFrame, *columns: str) -> list[np.ndarray]:
    table = rows.select(*columns).toArrow()
    return [table.column(c).to_numpy() for c in columns]


def _numbered(texts: DataFrame) -> tuple[DataFrame, int]:
    """word, x, n of all words, and the seed by which their numbers differ."""
    seed = 0
    while True:
        words = texts.mapInArrow(_word_counts(seed), "word string, x long, n long").groupBy("word", "x").agg(F.sum("n").alias("n"))
        words = written(words, "words")
        if not words.groupBy("x").count().where("count > 1").head(1):
            return words, seed
        seed += 1


def _levels(texts: DataFrame, words: DataFrame, seed: int, total: int, distinct: int, shape: Shape, often: int | None = None) -> tuple[list[DataFrame], list[Broadcast]]:
    """For each level, the root first: k, w, x, c, p with the probability p of x and its count c in training; and the
    bitmaps of the contexts there. Only contexts with ``often`` occurrences and what the bitmaps let through besides."""
    spark, often = texts.sparkSession, often or shape.least
    zero = F.lit(0).cast("long")
    levels = [words.select(zero.alias("k"), zero.alias("w"), "x", F.col("n").alias("c"), ((F.col("n") + 1) / (total + distinct + 1)).alias("p"))]
    maps, end = [], words.where(F.col("word") == END).select("x").first()
    longer = words.where(F.col("n") >= often).select(zero.alias("k"), F.col("x").alias("w"))
    while len(maps) < shape.depth and (n := longer.count()):
        maps.append(spark.sparkContext.broadcast(_bitmap(longer, n)))
        on = ["x"] if len(levels) == 1 else ["s", "w", "x"]
        shorter = levels[-1].select(F.col("k").alias("s"), "w", "x", "c", F.col("p").alias("q")).select(*on, "c", "q")
        grams = texts.mapInArrow(_grams(seed, list(maps)), "k long, s long, w long, x long, n long")
        grams = grams.groupBy("k", "s", "w", "x").agg(F.sum("n").alias("n"))
        pairs = written(grams.join(shorter, on).select("k", "w", "x", "n", "c", "q"), "pairs")
        counts = pairs.where("n > 0").groupBy("k", "w").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
        counts = written(counts.where(F.col("total") >= shape.least), "contexts")
        c, q, held, free = F.col("n"), F.col("q"), F.col("total"), F.col("kinds") + shape.discount
        others = free - F.when(c == 1, 1).otherwise(0)
        gain = F.sum(c * F.ln(((c - 1) / q + others) / (held - 1 + others)))
        retained = pairs.where("n > 0").join(counts, ["k", "w"]).groupBy("k", "w").agg(gain.alias("gain"), F.first("total").alias("total"), F.first("kinds").alias("kinds"))
        retained = written(retained.where(F.col("gain") >= shape.divergence).drop("gain"), "retained")
        p = F.coalesce((c + free * q) / (held + free), q)
        levels.append(written(pairs.join(retained, ["k", "w"], "left").select("k", "w", "x", "c", p.alias("p")), "level"))
        longer = pairs.where((F.col("n") >= often) & (F.col("x") != end.x)).select("k", "w", "x").mapInArrow(_extended, "k long, w long")
    return levels, maps


def _most_frequent(words: DataFrame) -> _Frequent:
    """The words of at least so many occurrences, a power of two, that no more than the bound are left."""
    counted = words.where("n > 0").withColumn("power", F.floor(F.log2("n")).cast("int"))
    sizes = {r.power: r["count"] for r in counted.groupBy("power").count().collect()}
    least, held = max(sizes, default=0) + 1, 0
    while sizes and least and held + sizes.get(least - 1, 0) <= _FREQUENT:
        least -= 1
        held += sizes.get(least, 0)
    x, n = _collected(counted.where(F.col("power") >= least), "x", "n")
    order = np.argsort(-n, kind="stable")
    found = x[order].view(np.uint64)
    order, rising = np.argsort(found), np.sort(found)
    return _Frequent(found, n[np.argsort(-n, kind="stable")], rising, order)


def score(docs: DataFrame, shape: Shape | None = None, id_column: str = "doc_id", text_column: str = "text", often: int = _OFTEN) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark, shape = docs.sparkSession, shape or Shape()
    importable(spark)
    chosen = docs.select(F.col(id_column).cast("long").alias("id"), held_out(F.col(id_column)).alias("held_out"), F.col(text_column).cast("string").alias("text"))
    texts = chosen.select("held_out", "text")
    words, seed = _numbered(texts)
    total, distinct = (x or 0 for x in words.where("n > 0").agg(F.sum("n"), F.count(F.lit(1))).first())
    levels, maps = _levels(texts, words, seed, total, distinct, shape, max(often, shape.least))
    known = [level.mapInArrow(_named(d), "g long, c long, p double") for d, level in enumerate(levels) if d]
    known = reduce(DataFrame.unionByName, known, levels[0].select(F.col("x").alias("g"), "c", "p"))
    groups, frequent = max(_GROUPS, total // _GROUP), spark.sparkContext.broadcast(_most_frequent(words))
    last = words.where(F.col("n") >= shape.least).select(F.lit(0).cast("long").alias("k"), F.col("x").alias("w"))
    able = spark.sparkContext.broadcast(_bitmap(last, last.count()))
    asked = texts.mapInArrow(_questions(seed, able, maps, frequent, shape.depth, groups), "part long, g long")
    answers = asked.join(known, "g").select("part", "g", "c", "p")
    dealt = chosen.mapInArrow(_dealt(seed, able, maps, frequent, shape.depth, groups), _DEALT_SQL)
    counted = dealt.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_counted(frequent, shape.depth, shape, float(total + distinct + 1)), _SUMS_SQL)
    rows = counted.groupBy("row").agg(
        F.max("id").alias("id"),
        F.max("held_out").alias("held_out"),
        F.max("n").alias("n_tokens"),
        F.coalesce(F.sum("n_known"), F.lit(0)).alias("n_known"),
        F.sum("counts").alias("counts"),
        F.sum("score").alias("score"),
    )
    other = -F.log10(F.lit(float(total + distinct + 1)))
    return rows.select(
        "id", "held_out", "n_tokens", "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("counts") + F.col("n_tokens") * other).alias("base_score"),
        "score",
    )
