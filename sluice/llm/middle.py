"""Fill-in-middle: cut a text in three and move the middle to the end.

A slice of documents is one sequence of bytes in UTF-8, and every byte has a class: it goes on a
character, or begins one of one to four bytes. A wavelet matrix over the classes (three rows of bits
with counts of ones) answers how many bytes of a class come before any place. The ranks of the
classes that begin a character add up to the characters before a place; the number of characters
of a document is a difference of two such counts, and bisection on them finds the byte at which a
cut after so many characters falls. All documents of a slice are searched at once, and no text is
decoded.

Where a text is cut and in which form it is written follow from the SHA-256 of a seed and the
document's id alone, so reruns agree. ``rebuilt`` gives the text back from an output and its form.

Null text is empty, and an empty text or one that contains a marker stays as it is (form plain). A null
id hashes like an empty one. Repeated rows give one row each, an empty table gives an empty result,
and other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluice.llm.registry import importable
from sluice.llm.slices import ranges, text_bytes

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Documents of a hundred that are cut, and of those the ones that begin with the suffix.
CUT, SUFFIX_FIRST = 90, 20
#: Bytes of text under one wavelet matrix; a longer document has one of its own.
SLICE_BYTES = 8 << 20

#: Classes of bytes: 0 goes on a character; the others begin one: 1 a blank, 2 another of one byte, 3 to 5 of two to four.
_BEGIN = (1, 2, 3, 4, 5)
_CLASS = np.array(
    [1 if b in b"\t\n\v\f\r " else 2 if b < 0x80 else 0 if b < 0xC0 else 3 if b < 0xE0 else 4 if b < 0xF0 else 5 for b in range(256)], np.uint8
)


class WaveletMatrix:
    """Ranks over a sequence of small numbers."""

    def __init__(self, codes: np.ndarray, bits: int = 3):
        self.length, self.rows = len(codes), []
        for shift in range(bits - 1, -1, -1):
            ones = (codes >> shift) & 1 == 1
            packed = np.packbits(ones, bitorder="little")
            words = np.zeros(len(codes) // 64 + 1, np.uint64)
            words.view(np.uint8)[: len(packed)] = packed
            before = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
            self.rows.append((words, before, self.length - int(before[-1])))
            codes = np.concatenate([codes[~ones], codes[ones]])

    @staticmethod
    def _ones(words: np.ndarray, before: np.ndarray, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return before[word] + np.bitwise_count(words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, code: int, at: np.ndarray) -> np.ndarray:
        """How many of the first ``at`` numbers are ``code``."""
        begin = np.zeros(1, np.int64)
        for level, (words, before, zeros) in enumerate(self.rows):
            ones = self._ones(words, before, at), self._ones(words, before, begin)
            if code >> (len(self.rows) - 1 - level) & 1:
                at, begin = zeros + ones[0], zeros + ones[1]
            else:
                at, begin = at - ones[0], begin - ones[1]
        return at - begin


def characters_before(classes: WaveletMatrix, at: np.ndarray) -> np.ndarray:
    return sum(classes.rank(code, at) for code in _BEGIN)


def cut_at(classes: WaveletMatrix, start: np.ndarray, end: np.ndarray, characters: np.ndarray) -> np.ndarray:
    """The byte in each [start, end] after which come all but the first ``characters`` characters."""
    low, high, base = start.copy(), end.copy(), characters_before(classes, start) + characters
    while (low < high).any():  # the last place with at most that many before it
        middle = (low + high + 1) >> 1
        fits = characters_before(classes, middle) <= base
        low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
    return low


def _moved(cut: int, suffix_first: int, markers: tuple[str, str, str]):
    p, s, m = (x.encode() for x in markers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            every, content = text_bytes(batch.column(1))
            draws = [batch.column(c).to_numpy() for c in (2, 3, 4, 5)]
            for a, b in ranges(every, SLICE_BYTES):
                edges = every[a : b + 1] - every[a]
                data = content[int(every[a]) : int(every[b])].to_pybytes() if edges[-1] else b""
                classes = WaveletMatrix(_CLASS[np.frombuffer(data, np.uint8)])
                start, end = edges[:-1], edges[1:]
                n = np.diff(characters_before(classes, edges))
                h1, h2, h3, h4 = (d[a:b] for d in draws)
                one, two = h1 % (n + 1), h2 % (n + 1)
                first, second = np.minimum(one, two), np.maximum(one, two)
                x, y = (cut_at(classes, start, end, k) for k in (first, second))
                outputs, forms, plain = [], [], (n == 0) | (h3 % 100 >= cut)
                for i, (u, v, w, z) in enumerate(zip(start.tolist(), x.tolist(), y.tolist(), end.tolist(), strict=True)):
                    text = data[u:z]
                    if plain[i] or p in text or s in text or m in text:
                        plain[i] = True
                        outputs.append(text)
                        forms.append("plain")
                    elif h4[i] % 100 < suffix_first:
                        outputs.append(b"".join((s, data[w:z], p, data[u:v], m, data[v:w])))
                        forms.append("spm")
                    else:
                        outputs.append(b"".join((p, data[u:v], s, data[w:z], m, data[v:w])))
                        forms.append("psm")
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(a, b - a), pa.array(n, pa.int64()), pa.array(forms), pa.array(first, pa.int64(), mask=plain),
                        pa.array(second - first, pa.int64(), mask=plain), pa.array(outputs, pa.binary()),
                    ],
                    names=["id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def draws(identifier: Column, seed: int) -> list[Column]:
    """Four numbers of 32 bits from the id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(identifier.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(
    docs: DataFrame, seed: int = 1, cut: int = CUT, suffix_first: int = SUFFIX_FIRST,
    markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE), id_column: str = "doc_id", text_column: str = "text",
) -> DataFrame:
    """id, n (characters), form, prefix_chars, middle_chars and output of every row.

    ``markers`` (prefix, suffix, middle) must begin with a sign that none of them has elsewhere, so that
    no marker can arise across a cut.
    """
    if len(set(markers)) < 3 or any(not x or x[0] in y[1:] for x in markers for y in markers):
        raise ValueError("markers need first signs that occur nowhere else in them")
    importable(docs.sparkSession)
    chosen = docs.select(F.col(id_column).alias("id"), F.coalesce(F.col(text_column).cast("string"), F.lit("")).alias("text"), *draws(F.col(id_column), seed))
    kind = chosen.schema["id"].dataType.simpleString()
    found = chosen.mapInArrow(_moved(cut, suffix_first, markers), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output binary")
    return found.withColumn("output", F.col("output").cast("string"))


def rebuilt(output: Column, form: Column, markers: tuple[str, str, str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that ``output`` was made from."""
    p, s, m = map(F.lit, markers)
    head, middle = F.split_part(output, m, F.lit(1)), F.split_part(output, m, F.lit(2))
    psm = F.concat(F.split_part(F.split_part(head, s, F.lit(1)), p, F.lit(2)), middle, F.split_part(head, s, F.lit(2)))
    spm = F.concat(F.split_part(head, p, F.lit(2)), middle, F.split_part(F.split_part(head, p, F.lit(1)), s, F.lit(2)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS x FROM documents),
h AS (
  SELECT doc_id, t, n, ('0x' || substr(x, 1, 8))::BIGINT % (n + 1) AS u, ('0x' || substr(x, 9, 8))::BIGINT % (n + 1) AS v,
         ('0x' || substr(x, 17, 8))::BIGINT % 100 AS h3, ('0x' || substr(x, 25, 8))::BIGINT % 100 AS h4
  FROM d),
f AS (
  SELECT doc_id, t, n, least(u, v) AS a, greatest(u, v) AS b,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain'
              WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h),
c AS (
  SELECT *, substring(t, 1, a) AS p, substring(t, a + 1, b - a) AS m, substring(t, b + 1) AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM c
"""
