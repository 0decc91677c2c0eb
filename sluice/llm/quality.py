"""Rejecting poor and toxic documents by hierarchical empirical Bayes.

A classifier, fitted here on labelled rows, gives each document its own evidence: a logistic
regression on a few measures of the text and on words and word beginnings that tell the classes
apart. Sites differ in how often they are poor, so the evidence is combined with what is known of
the document's host and path. The expected number of poor documents is summed by host and by path
over all documents; a host's rate is shrunk toward the global rate, and a path's toward its host's, by
prior counts found from the spread between sites (method of moments). A path's rate for a document
leaves that document out. The posterior odds are the evidence's, times the odds of the path's
rate over those of the global rate.

The only sample is of labelled rows for the fit, at most ``sample`` of them, chosen by a hash of
the id. Everything else covers all rows. Groups are combined before any shuffle, so one host may hold
any share of the rows; Spark broadcasts the written table of paths if its size allows, else joins it.

Null text is empty. Null hosts and paths are sites of their own. A null id has no label. Repeated
rows are judged one by one; of several labels for an id, the worst holds; null labels are left
out. Without labels of both kinds every document has the rate of the kind that there is. An empty
table gives an empty result. Other columns pass through, whatever their names.
"""

from __future__ import annotations

import operator
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sluice.llm.registry import importable, unused
from sluice.workspace import written

#: Labelled rows that the classifier is fitted on, at most.
SAMPLE = 10_000
#: Words and word beginnings that the classifier looks for, for each head.
WORDS = 192
#: Lengths of word beginnings, in bytes.
BEGINNINGS = (6, 8, 10)
#: Deviations of a word's share in one class from the other, and rows with it, to be looked for.
LEAST_DEVIATION, LEAST_ROWS = 5.0, 5
#: Posterior probability of being poor, or toxic, with which a document goes.
REJECT = 0.5

HEADS = ("poor", "toxic")
_PLAIN = bytes(b if chr(b).isalnum() or b >= 0x80 else 0x20 for b in range(256))
_SIGNS, _STOPS, _DIGITS = "%&*$#!|~^<>{}=+_@\\", ".,;:?'\"()-", "0123456789"
_RIDGE = 1.0


def signs_of(text: str) -> list[bytes]:
    """Each distinct word once, and its beginnings (marked ``*``) once for each."""
    words = set(text.encode().lower().translate(_PLAIN).split())
    found = list(words)
    for n in BEGINNINGS:
        found += [w[:n] + b"*" for w in words if len(w) > n]
    return found


def measures(text: str) -> list[float]:
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * 10
    distinct = len(set(words))
    count = lambda signs: sum(map(text.count, signs)) / chars
    return [
        np.log1p(n),
        sum(map(operator.eq, words, words[1:])) / n,
        np.log1p(distinct) / np.log1p(n),
        distinct / n,
        sum(map(str.isupper, words)) / n,
        count(_SIGNS),
        count(_STOPS),
        count(_DIGITS),
        min(chars / n, 40.0),
        (text.count("\n") + 1) / n,
    ]


@dataclass(frozen=True)
class Classifier:
    """For each head: weights of the standardized measures, then of the words, then a constant."""

    words: dict[bytes, int]
    centre: np.ndarray
    spread: np.ndarray
    weights: np.ndarray  # heads x (measures + words + 1)

    def row(self, text: str | None) -> np.ndarray:
        text = text or ""
        k = len(self.centre)
        found = np.zeros(self.weights.shape[1])
        found[:k] = (np.array(measures(text)) - self.centre) / self.spread
        for word, n in Counter(filter(self.words.__contains__, signs_of(text))).items():
            found[k + self.words[word]] = np.log1p(n)
        found[-1] = 1
        return found

    def log_odds(self, texts: list[str | None]) -> np.ndarray:
        return np.array([self.weights @ self.row(t) for t in texts]).reshape(-1, len(self.weights)).clip(-30, 30)


def _fitted(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton's steps; the last column of ``x`` is the constant."""
    w = np.zeros(x.shape[1])
    rate = y.mean() if len(y) else 0.0
    if rate in (0.0, 1.0):
        w[-1] = 30.0 if rate else -30.0
        return w
    penalty = np.full(x.shape[1], _RIDGE)
    penalty[-1] = 1e-6
    for _ in range(25):
        p = 1 / (1 + np.exp(-(x @ w).clip(-30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for poor, toxic, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = list(set(signs_of(text or "")))
            flags = [pa.array([float(v)] * len(words), pa.float64()) for v in (poor, toxic)]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), *flags], names=["word", *HEADS])


def _telling(labelled: DataFrame) -> list[bytes]:
    """Words whose share among the rows of a class is far from that among the others; bounded."""
    total, *ones = labelled.agg(F.count(F.lit(1)), *(F.sum(h) for h in HEADS)).first()
    seen = labelled.select(*HEADS, "text").mapInArrow(_present, "word binary, poor double, toxic double")
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"), *(F.sum(h).alias(h) for h in HEADS)).where(F.col("n") >= LEAST_ROWS)
    chosen: dict[bytes, None] = {}
    for head, one in zip(HEADS, ones, strict=True):
        if not one or one == total:
            continue
        share = F.col("n") / total
        apart = (F.col(head) / one - (F.col("n") - F.col(head)) / (total - one)) / F.sqrt(share * (1 - share) * (1 / one + 1 / (total - one)) + 1e-12)
        best = seen.select("word", F.abs(apart).alias("z")).where(F.col("z") >= LEAST_DEVIATION).orderBy(F.desc("z"), "word").limit(WORDS)
        chosen |= dict.fromkeys(bytes(r["word"]) for r in best.collect())
    return list(chosen)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> Classifier:
    """``labels``: id_column, quality (1 good, 0 poor), toxic (1 or 0)."""
    importable(docs.sparkSession)
    known = labels.where(F.col(id_column).isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    worst = known.groupBy(F.col(id_column).cast("long").alias("id")).agg((1 - F.min("quality")).cast("double").alias("poor"), F.max("toxic").cast("double").alias("toxic"))
    worst = worst.orderBy(F.xxhash64("id"), "id").limit(sample)
    texts = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).cast("string").alias("text"))
    labelled = texts.join(F.broadcast(worst), "id").orderBy(F.xxhash64("id"), "id", "text").limit(sample)  # repeated ids too
    labelled = written(labelled, "labelled")
    words = _telling(labelled)
    kind = ", ".join(f"{h} double" for h in HEADS) + ", measures array<double>, words array<int>"
    place = {w: i for i, w in enumerate(words)}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            found = [[place[w] for w in filter(place.__contains__, signs_of(t))] for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([measures(t) for t in texts], pa.list_(pa.float64())), pa.array(found, pa.list_(pa.int32()))],
                names=[*HEADS, "measures", "words"],
            )

    table = labelled.select(*HEADS, "text").mapInArrow(rows, kind).toArrow()  # at most ``sample`` rows
    k = len(measures(""))
    x = np.zeros((table.num_rows, k + len(words) + 1))
    x[:, -1] = 1
    if table.num_rows:
        x[:, :k] = np.stack(table.column("measures").to_numpy())
    centre, spread = x[:, :k].mean(0) if len(x) else np.zeros(k), (x[:, :k].std(0) if len(x) else np.zeros(k)) + 1e-9
    x[:, :k] = ((x[:, :k] - centre) / spread).clip(-20, 20)
    for i, places in enumerate(table.column("words").to_pylist()):
        np.add.at(x[i], np.array(places, np.int64) + k, 1)
    x[:, k:-1] = np.log1p(x[:, k:-1])
    weights = np.stack([_fitted(x, table.column(h).to_numpy()) for h in HEADS])
    return Classifier(place, centre, spread, weights)


#: Texts judged at once; bounds a worker's memory.
_AT_ONCE = 512


def with_evidence(docs: DataFrame, classifier: Classifier, names: tuple[str, str], text_column: str = "text", keep_text: bool = True) -> DataFrame:
    """``docs`` with the log-odds of each head by the text alone, in columns ``names``, written out."""
    importable(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(classifier)
    at = docs.columns.index(text_column)
    passed = [i for i in range(len(docs.columns)) if keep_text or i != at]
    schema = T.StructType([*(docs.schema.fields[i] for i in passed), *(T.StructField(n, T.DoubleType()) for n in names)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, _AT_ONCE):
                piece = batch.slice(first, _AT_ONCE)
                odds = model.value.log_odds(piece.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*(piece.column(i) for i in passed), pa.array(odds[:, 0]), pa.array(odds[:, 1])], names=schema.names)

    found = written(docs.mapInArrow(run, schema), "evidence")
    model.destroy()
    return found


def _probability(odds: Column) -> Column:
    return 1 / (1 + F.exp(-odds))


def _odds(rate: Column) -> Column:
    held = F.greatest(F.least(rate, F.lit(1 - 1e-6)), F.lit(1e-6))
    return F.ln(held / (1 - held))


def path_rates(evidence: DataFrame) -> DataFrame:
    """``evidence``: host, path and the log-odds of each head, for all documents. Returns, for each path, what its
    documents' posteriors need: n and, by head, expected number, prior count, host's rate and global rate."""
    sums = [F.sum(_probability(F.col(h))).alias(h) for h in HEADS]
    paths = written(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).cast("double").alias("n"), *sums), "paths")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), *(F.sum(h).alias(f"host_{h}") for h in HEADS))
    total = hosts.agg(F.count(F.lit(1)).alias("sites"), F.sum("host_n").alias("n"), *(F.sum(f"host_{h}").alias(h) for h in HEADS)).first()
    means = {h: (total[h] or 0.0) / (total["n"] or 1.0) for h in HEADS}
    apart = lambda rate, mean, n: F.sum(n * (rate - mean) * (rate - mean))
    spread = hosts.agg(*(apart(F.col(f"host_{h}") / F.col("host_n"), F.lit(means[h]), F.col("host_n")).alias(h) for h in HEADS)).first()
    columns = []
    for h in HEADS:
        count = _prior_count(means[h], spread[h], total["sites"], total["n"])
        rate = (count * means[h] + F.col(f"host_{h}")) / (count + F.col("host_n"))
        columns += [F.lit(means[h]).alias(f"global_{h}"), rate.alias(f"rate_{h}")]
    hosts = hosts.select(F.col("host").alias("of_host"), *columns)
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("of_host"))).drop("of_host")
    inside = [apart(F.col(h) / F.col("n"), F.col(f"rate_{h}"), F.col("n")).alias(h) for h in HEADS]
    within = paths.agg(F.count(F.lit(1)).alias("sites"), F.sum("n").alias("n"), *inside).first()
    for h in HEADS:
        paths = paths.withColumn(f"count_{h}", F.lit(_prior_count(means[h], within[h], within["sites"], within["n"])))
    return paths.select("host", "path", "n", *HEADS, *(f"{x}_{h}" for h in HEADS for x in ("count", "rate", "global")))


def _prior_count(rate: float, squares: float | None, sites: int, documents: float | None) -> float:
    """Documents that a Beta prior with this mean counts as much as: the less sites differ beyond chance, the more."""
    chance = rate * (1 - rate)
    beyond = max(((squares or 0.0) - sites * chance) / (documents or 1.0), 1e-9)
    return max(min(chance / beyond - 1, 1e6), 2.0)


def with_posteriors(rows: DataFrame, rates: DataFrame, host: Column, path: Column, evidence: tuple[str, str], names: tuple[str, str]) -> DataFrame:
    """``rows`` with the posterior probability of each head in columns ``names``."""
    site = unused("site", rows.columns)  # one column, so that no name of the rates meets one of the rows
    rates = rates.select(F.struct(*rates.columns).alias(site))
    of = lambda name: F.col(site)[name]
    joined = rows.join(rates, host.eqNullSafe(of("host")) & path.eqNullSafe(of("path")))
    found = []
    for head, odds, name in zip(HEADS, evidence, names, strict=True):
        own = _probability(F.col(odds))
        count = of(f"count_{head}")
        rate = (count * of(f"rate_{head}") + of(head) - own) / (count + of("n") - 1)
        found.append(_probability(F.col(odds) + _odds(rate) - _odds(of(f"global_{head}"))).alias(name))
    return joined.select(*(rows[c] for c in rows.columns), *found)


def judge(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", path_column: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """id, host, path, poor, toxic (posterior probabilities), rejected for every row."""
    classifier = fit(docs, labels, sample, id_column, text_column)
    chosen = docs.select(F.col(id_column).alias("id"), F.col(host_column).alias("host"), F.col(path_column).alias("path"), F.col(text_column).cast("string").alias("text"))
    evidence = with_evidence(chosen, classifier, HEADS, keep_text=False)
    rates = written(path_rates(evidence), "rates")
    found = with_posteriors(evidence, rates, evidence["host"], evidence["path"], HEADS, ("p_poor", "p_toxic"))
    return found.select("id", "host", "path", F.col("p_poor").alias("poor"), F.col("p_toxic").alias("toxic"), (F.greatest("p_poor", "p_toxic") >= REJECT).alias("rejected"))


def accepted(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source", path_column: str = "lang", sample: int = SAMPLE
) -> DataFrame:
    """The rows of ``docs`` that are not rejected. Rows are written once with their evidence, so that texts are
    neither judged twice nor shuffled."""
    classifier = fit(docs, labels, sample, id_column, text_column)
    odds = unused("odds_poor", docs.columns), unused("odds_toxic", docs.columns)
    posterior = unused("p_poor", docs.columns), unused("p_toxic", docs.columns)
    rows = with_evidence(docs, classifier, odds, text_column)
    rates = path_rates(rows.select(F.col(host_column).alias("host"), F.col(path_column).alias("path"), *(F.col(o).alias(h) for o, h in zip(odds, HEADS, strict=True))))
    found = with_posteriors(rows, written(rates, "rates"), rows[host_column], rows[path_column], odds, posterior)
    return found.where(F.greatest(*posterior) < REJECT).select(*docs.columns)
