"""Where sources differ in their words: an audit by sorting pointers to term starts.

Each task takes slices of its Arrow text buffer of a bounded size, lower-cases A-Z, and makes a
pointer to every term start. The pointers are sorted by the bytes they point at, eight at a time:
pointers with equal first eight bytes form a run, runs whose terms go on are sorted by the next
eight, and so on (a multikey quicksort with words for letters). A run of equal terms gives the
term's occurrences and documents by group, a group being a language and a source. Spark sums the
runs of all slices, and only sums are shuffled: no term, however common, brings a row per place.

A term counts in a language if ``least_docs`` of its documents have it. Relative frequencies are
whole billionths, with one added to every count, so all arithmetic is exact. A pair of sources is
compared over all kept terms: blocks of terms meet tiles of sources, and a term that a pair lacks
adds what any such term adds, so the work follows the counts and not sources times terms.

Null text, language and source are empty strings. Every row is a document, repeated ones too. A
group without terms has frequencies from the added ones alone; a language without kept terms has
only pairs, with value 0. An empty table gives an empty result, and other columns are not read. A
text longer than a slice is taken in pieces cut between terms, and still is one document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluice.llm.registry import importable
from sluice.llm.slices import ranges, text_bytes
from sluice.workspace import written

LEAST_DOCS = 3
TOP = 200
#: Bytes of text whose pointers are sorted at once.
SLICE_BYTES = 4 << 20
#: Slices of eight bytes compared by number; what is still equal then is compared as bytes.
WORD_DEPTH = 4
#: Rows of one block of terms, about, and sources of one tile.
BLOCK_ROWS, TILE = 20_000, 128
UNIT = 1_000_000_000

#: Every byte of a term to its lower case, every other byte to zero.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 0 for b in range(256))
_KEEP = np.array([0, *(((1 << 64) - 1) ^ ((1 << (64 - 8 * k)) - 1) for k in range(1, 9))], np.uint64)


def _words_at(data: bytes, starts: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes at each pointer as a big-endian number, zero beyond the term's end."""
    every = np.ndarray((len(data) - 7,), ">u8", buffer=data, strides=(1,))
    inside = np.minimum(starts, len(every) - 1)  # a finished term may point at the end
    return every[inside].astype(np.uint64) & _KEEP[left.clip(0, 8)]


def sorted_pointers(data: bytes, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pointers in the order of their terms, and which of them differ from the one before.

    ``data`` ends with eight bytes that belong to no term.
    """
    keys = _words_at(data, starts, lengths)
    order = np.argsort(keys)
    keys = keys[order]
    new = np.ones(len(order), bool)
    new[1:] = keys[1:] != keys[:-1]
    places = np.arange(len(order))  # where runs may go on
    for depth in range(1, WORD_DEPTH + 1):
        run = np.cumsum(new[places])
        goes_on = lengths[order[places]] > 8 * depth
        size, longer = np.bincount(run), np.bincount(run, goes_on)
        open_ = ((size > 1) & (longer > 0))[run]
        places, run = places[open_], run[open_]
        if not len(places):
            return order, new
        at = order[places]
        if depth == WORD_DEPTH:
            rest = [data[s : s + n] for s, n in zip((starts[at] + 8 * depth).tolist(), (lengths[at] - 8 * depth).tolist(), strict=True)]
            # a term that has ended has nothing left and comes first
            moved = np.array(sorted(range(len(rest)), key=lambda i: (run[i], rest[i])), np.int64)
            apart = np.array([rest[a] != rest[b] for a, b in zip(moved[1:], moved[:-1])], bool)
        else:
            keys = _words_at(data, starts[at] + 8 * depth, lengths[at] - 8 * depth)
            moved = np.lexsort((keys, run))
            apart = np.diff(keys[moved]) != 0
        order[places] = at[moved]
        new[places[1:]] |= apart
    return order, new


def _runs(data: bytes, edges: np.ndarray, groups: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents data[edges[i]:edges[i+1]] with ascending ``groups``: the distinct terms, and for each term and
    group that has it, their places, the occurrences and the documents."""
    signs = np.frombuffer(data, np.uint8)[: edges[-1]] != 0
    first = signs.copy()
    first[1:] &= ~signs[:-1]
    last = signs.copy()
    last[:-1] &= ~signs[1:]
    cuts = edges[(edges > 0) & (edges < edges[-1])]
    first[cuts] = signs[cuts]
    last[cuts - 1] = signs[cuts - 1]
    starts = np.flatnonzero(first)
    lengths = np.flatnonzero(last) + 1 - starts
    if not len(starts):
        none = np.zeros(0, np.int64)
        return [], none, none, none, none
    order, new = sorted_pointers(data, starts, lengths)
    run = np.cumsum(new) - 1
    docs = np.searchsorted(edges, starts, "right") - 1
    places, times = np.unique(run * len(groups) + docs[order], return_counts=True)
    term, doc = np.divmod(places, len(groups))
    group = groups[doc]
    begin = np.ones(len(term), bool)
    begin[1:] = (np.diff(term) != 0) | (np.diff(group) != 0)
    begin = np.flatnonzero(begin)
    heads = order[new]
    terms = [data[s : s + n] for s, n in zip(starts[heads].tolist(), lengths[heads].tolist(), strict=True)]
    return terms, term[begin], group[begin], np.add.reduceat(times, begin), np.diff(np.append(begin, len(term)))


def _pieces(text: bytes, size: int) -> Iterator[bytes]:
    """A folded text in pieces of about ``size`` bytes, none of which ends inside a term."""
    at = 0
    while at < len(text):
        end = text.find(b"\0", at + size)
        end = len(text) if end < 0 else end
        yield text[at:end]
        at = end


def _term_counts(size: int):
    def rows(keys, terms, term, group, times, docs) -> pa.RecordBatch:
        at, of = pa.array(term, pa.int64()), pa.array(group, pa.int64())
        columns = [keys.field(0).take(of), keys.field(1).take(of), pa.array(terms, pa.binary()).take(at), pa.array(times, pa.int64()), pa.array(docs, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])

    def sliced(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        frame = pd.DataFrame({"lang": batch.column(0).to_pandas(), "source": batch.column(1).to_pandas()})
        group = frame.groupby(["lang", "source"], sort=False).ngroup().to_numpy()
        _, at = np.unique(group, return_index=True)
        keys = pa.StructArray.from_arrays([batch.column(c).take(pa.array(at)) for c in (0, 1)], ["lang", "source"])
        order = np.argsort(group, kind="stable")
        groups = group[order]
        edges, content = text_bytes(batch.column(2).take(pa.array(order)))
        if edges[0] == edges[-1]:
            return None
        data = content[int(edges[0]) : int(edges[-1])].to_pybytes().translate(_FOLD)
        if len(data) <= size or len(groups) > 1:
            return rows(keys, *_runs(data + bytes(8), edges - edges[0], groups))
        seen: Counter = Counter()  # one long document
        for piece in _pieces(data, size):
            terms, _, _, times, _ = _runs(piece + bytes(8), np.array([0, len(piece)]), groups)
            seen.update(dict(zip(terms, times.tolist(), strict=True)))
        one = np.ones(len(seen), np.int64)
        return rows(keys, list(seen), np.arange(len(seen)), 0 * one, np.fromiter(seen.values(), np.int64, len(seen)), one)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in ranges(text_bytes(batch.column(2))[0], size):
                if (found := sliced(batch.slice(a, b - a))) is not None:
                    yield found

    return run


def term_counts(docs: DataFrame, lang_column: str, source_column: str, text_column: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents with it), summed over all rows."""
    importable(docs.sparkSession)
    named = ((lang_column, "lang"), (source_column, "source"), (text_column, "text"))
    chosen = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in named))
    found = chosen.mapInArrow(_term_counts(slice_bytes), "lang string, source string, term binary, n long, docs long")
    found = found.withColumn("term", F.col("term").cast("string"))
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(n: Column, total: Column, terms: Column) -> Column:
    """Whole billionths of ``n`` plus one in ``total`` plus one a term, and one."""
    whole = F.call_function("div", (n + 1).cast("decimal(20,0)") * F.lit(UNIT).cast("decimal(10,0)"), F.nullif((total + terms).cast("decimal(20,0)"), F.lit(0)))
    return whole + 1


def _apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _differences(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _add_rows(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add every row of ``values`` to the row of ``total`` that ``at`` names."""
    if len(at):
        order = np.argsort(at, kind="stable")
        at = at[order]
        begin = np.flatnonzero(np.diff(at, prepend=-1))
        total[at[begin]] += np.add.reduceat(values[order], begin, axis=0)


def _pair_block(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
    """Of one block of terms and two tiles of sources, what the terms add to each pair beyond a term that both lack.

    Rows without a term bring a source and its share for a term that it lacks.
    """
    lang, bucket, left, right = key
    known = block.term.notna().to_numpy()
    heads, rows = block[~known], block[known]
    tiles = []
    for tile in (left, right):
        of = heads[heads.tile == tile].drop_duplicates("place").sort_values("place")
        tiles.append((of.place.to_numpy(), of.share.to_numpy(np.int64)))
    (rows_at, zero_g), (columns_at, zero_h) = tiles
    none = _differences(zero_g[:, None], zero_h[None, :])
    total = none * int(heads.terms.iloc[0]) if bucket == 0 else np.zeros_like(none)
    place, share, of_tile = rows.place.to_numpy(), rows.share.to_numpy(np.int64), rows.tile.to_numpy()
    term = pd.factorize(rows.term)[0]
    order = np.argsort(term, kind="stable")
    term, place, share, of_tile = term[order], place[order], share[order], of_tile[order]
    for a in range(0, term[-1] + 1 if len(term) else 0, 2048):  # terms at a time
        x, y = np.searchsorted(term, [a, a + 2048])
        t, s, p, tile = term[x:y] - a, place[x:y], share[x:y], of_tile[x:y]
        n = int(t[-1]) + 1
        in_g, in_h = tile == left, tile == right
        g, h = np.searchsorted(rows_at, s[in_g]), np.searchsorted(columns_at, s[in_h])
        against = np.tile(zero_h, (n, 1))
        against[t[in_h], h] = p[in_h]
        _add_rows(total, g, _differences(p[in_g][:, None], against[t[in_g]]) - none[g])
        lacks = np.ones((n, len(rows_at)), bool)
        lacks[t[in_g], g] = False
        alone = _differences(zero_g[None, :], p[in_h][:, None]) - none[:, h].T
        _add_rows(total.T, h, np.where(lacks[t[in_h]], alone, 0))
    g, h = np.indices(total.shape).reshape(2, -1)
    found = pd.DataFrame({"lang": lang, "place": rows_at[g], "other": columns_at[h], "value": total.ravel()})
    return found[found.place != found.other]


def source_divergence(
    docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text",
    least_docs: int = LEAST_DOCS, top: int = TOP, slice_bytes: int = SLICE_BYTES, block_rows: int = BLOCK_ROWS, tile: int = TILE,
) -> DataFrame:
    """lang, source, part, item, value, rank.

    Part ``pair``: for each other source of the language, the summed squared distance of shares over the other's share.
    Part ``term``: the ``top`` terms that the source has more of than its language.
    """
    counts = written(term_counts(docs, lang_column, source_column, text_column, slice_bytes), "term-counts")
    kept = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    kept = written(counts.drop("docs").join(kept.drop("docs"), ["lang", "term"]), "kept-terms")

    groups = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(a) for c, a in ((lang_column, "lang"), (source_column, "source")))).distinct()
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("rows"))
    of_lang = kept.groupBy("lang", "term").agg(F.max("lang_n").alias("lang_n")).groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = groups.join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left").fillna(0)
    in_lang = Window.partitionBy("lang")
    place = F.row_number().over(in_lang.orderBy("source")) - 1
    groups = groups.select(
        "*", place.alias("place"), F.floor(place / tile).cast("int").alias("tile"),
        F.floor((F.count(F.lit(1)).over(in_lang) - 1) / tile).cast("int").alias("last_tile"),
        F.greatest(F.ceil(F.sum("rows").over(in_lang) / block_rows), F.lit(1)).cast("int").alias("buckets"),
    )
    groups = written(groups, "groups")

    rows = kept.join(groups, ["lang", "source"]).withColumn("share", _share(F.col("n"), F.col("total"), F.col("terms")))
    in_whole = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    more = rows.withColumn("in_lang", in_whole).where(F.col("share") > F.col("in_lang"))
    more = more.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _apart(F.col("share"), F.col("in_lang")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    more = more.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top)

    zero = F.coalesce(_share(F.lit(0), F.col("total"), F.col("terms")), F.lit(1).cast("long"))  # without terms: no difference
    heads = groups.select("lang", "place", "tile", "last_tile", "terms", zero.alias("share"), F.lit(None).cast("string").alias("term"), F.explode(F.sequence(F.lit(0), F.col("buckets") - 1)).alias("bucket"))
    members = rows.select("lang", "place", "tile", "last_tile", "terms", "share", "term", F.pmod(F.xxhash64("term"), F.col("buckets")).cast("int").alias("bucket"))
    # a row meets every tile, from both sides
    every = heads.unionByName(members).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("last_tile"))))
    sides = F.when(F.col("with") == F.col("tile"), F.array(F.struct(F.col("tile").alias("left"), F.col("tile").alias("right")))).otherwise(
        F.array(F.struct(F.col("tile").alias("left"), F.col("with").alias("right")), F.struct(F.col("with").alias("left"), F.col("tile").alias("right")))
    )
    every = every.select("lang", "bucket", F.explode(sides).alias("side"), "place", "tile", "share", "terms", "term").select("*", "side.left", "side.right").drop("side")
    parts = every.groupBy("lang", "bucket", "left", "right").applyInPandas(_pair_block, "lang string, place long, other long, value long")
    sums = parts.groupBy("lang", "place", "other").agg(F.sum("value").alias("value"))
    names = groups.select("lang", "place", "source")
    others = names.select("lang", F.col("place").alias("other"), F.col("source").alias("item"))
    pairs = sums.join(names, ["lang", "place"]).join(others, ["lang", "other"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    pairs = pairs.withColumn("rank", F.row_number().over(by_value))
    return pairs.unionByName(more)


SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text
  FROM documents),
w AS (
  SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*) AS lang_n FROM w GROUP BY ALL HAVING count(DISTINCT r) >= 3),
l AS (SELECT lang, sum(lang_n) AS lang_total, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
a AS (
  SELECT g.lang, g.source, k.term, k.lang_n, coalesce(c.n, 0) AS n,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total
  FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (
  SELECT a.lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 1)) // (total + v)::HUGEINT AS p,
         1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_total + v)::HUGEINT AS whole
  FROM a JOIN l USING (lang)),
pairs AS (
  SELECT x.lang, x.source, 'pair' AS part, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // y.p) AS value
  FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  UNION ALL
  SELECT x.lang, x.source, 'pair', y.source, 0 FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source
  WHERE x.lang NOT IN (SELECT lang FROM l)),
terms AS (
  SELECT lang, source, 'term' AS part, term AS item, ((p - whole) * (p - whole)) // whole AS value FROM p WHERE n > 0 AND p > whole)
SELECT lang, source, part, item, value::BIGINT AS value,
       row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
QUALIFY part = 'pair' OR rank <= 200
"""
