"""Toxic spans and document scores by a linear-chain CRF.

Only documents carry labels, so words are labelled first: over a bounded sample
of training documents, features (words and word prefixes) whose documents are
nearly all toxic are collected, and the words of toxic documents that have one
are labelled toxic.  The CRF learns from sequences of labelled words, and tags
every word of every text with its forward-backward marginal.  A document's
score is a calibrated function of its marginals, and its spans are the runs of
words that are more likely toxic than not, with their offsets.

Sample bounds (documented parameters): SAMPLE_DOCS training documents, in an
order by hash of the id; SEQUENCES sequences of SEQUENCE words; LEXICON features.
Scoring reads all texts whole.  Labels, language, source and id are never inputs
of a score.  Training is seeded and sorted, so reruns agree.

Defined results: null text is empty; texts without words have no marginals and
the calibrated score of none; without labels every score is 0.5; with labels of
one class only it is that class's smoothed share; labels that repeat for a
document are averaged; rows that repeat get equal scores; empty tables give no
rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lurescope.llm import common as C
from lurescope.llm import crf
from lurescope.llm.rule_ensemble import held_out

SAMPLE_DOCS = 20_000
SEQUENCES = 12_000
SEQUENCE = 48
LEXICON = 5_000
#: Smoothed shares of toxic documents that a feature needs (8, or 4 of the unexplained, if all are toxic).
STRONG, WEAK = 0.8, 0.66
#: Share of training words known by their prefixes only.
DROP, DROP_SEED = 0.25, 11
_FLUSH = 400_000
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_FOLD = str.maketrans(C.UPPER, C.LOWER)


def _words(batch):
    """The word lists of a batch, one at a time."""
    for raw in batch.column("words"):
        raw = raw.as_py()
        yield raw.split(b" ") if raw else []


def _marginals(batch, emissions: crf.Emissions) -> list[np.ndarray]:
    return crf.tag([emissions.of(w) for w in _words(batch)], emissions.model.transitions)


def _count_features(batches):
    """(feature, toxic documents, clean documents), summed within the task."""
    counts = (Counter(), Counter())

    def flush():
        keys = sorted(set(counts[0]) | set(counts[1]))
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([counts[1][k] for k in keys], pa.int64()),
                                          pa.array([counts[0][k] for k in keys], pa.int64())], ["feature", "toxic", "clean"])
        counts[0].clear()
        counts[1].clear()
        return out

    for batch in batches:
        for words, label in zip(_words(batch), batch.column("label").to_pylist()):
            counts[label].update({f for w in set(words) for f in crf.word_features(w)})
            if len(counts[0]) + len(counts[1]) > _FLUSH:
                yield flush()
    yield flush()


def _sequences(lexicon: frozenset):
    """Pieces of SEQUENCE words with the 0/1 label of each word."""
    def rows(batches):
        known: dict[bytes, bool] = {}
        for batch in batches:
            out: list[tuple] = []
            for doc, words, label in zip(batch.column("doc_id").to_pylist(), _words(batch), batch.column("label").to_pylist()):
                for at in range(0, len(words), SEQUENCE):
                    piece = words[at:at + SEQUENCE]
                    for w in piece:
                        if w not in known:
                            if len(known) > _FLUSH:
                                known.clear()
                            known[w] = not lexicon.isdisjoint(crf.word_features(w))
                    marks = bytes(int(label and known.get(w, False)) for w in piece)
                    out.append((doc, at, b" ".join(piece), marks, any(marks)))
            cols = list(zip(*out)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "at", "piece", "marks", "hit"])
    return rows


def _totals(marginal: np.ndarray) -> tuple[float, float]:
    """Aggregates of a document's marginals: expected toxic words (log scale) and the largest marginal."""
    return (float(np.log1p(marginal.sum())), float(marginal.max())) if len(marginal) else (0.0, 0.0)


def _aggregates(model: crf.Model):
    def rows(batches):
        emissions = crf.Emissions(model)
        for batch in batches:
            totals = [_totals(p) for p in _marginals(batch, emissions)]
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.array([t[0] for t in totals], pa.float64()),
                                              pa.array([t[1] for t in totals], pa.float64())], ["label", "expected", "largest"])
    return rows


def spans(text: str, marginal: np.ndarray) -> list[dict]:
    """Runs of words with a marginal of at least 0.5: character offsets and the largest marginal."""
    out: list[dict] = []
    for i, m in enumerate(_WORD.finditer(text.translate(_FOLD))):
        if marginal[i] >= 0.5:
            if out and out[-1]["last"] == i - 1:
                out[-1].update(last=i, end=m.end(), p=max(out[-1]["p"], float(marginal[i])))
            else:
                out.append({"start": m.start(), "end": m.end(), "p": float(marginal[i]), "last": i})
    return [{k: s[k] for k in ("start", "end", "p")} for s in out]


TAGGED = "doc_id long, score double, toxic_words long, spans array<struct<start:int,end:int,p:double>>"


def _score_rows(model: crf.Model, calibration: np.ndarray):
    def rows(batches):
        emissions = crf.Emissions(model)
        for batch in batches:
            tagged = _marginals(batch, emissions)
            x = np.array([(1.0, *_totals(p)) for p in tagged]).reshape(-1, 3)
            score = 1 / (1 + np.exp(-np.clip(x @ calibration, -30, 30)))
            texts = batch.column("text")
            found = [spans(texts[i].as_py(), p) if len(p) and p.max() >= 0.5 else [] for i, p in enumerate(tagged)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array([int((p >= 0.5).sum()) for p in tagged], pa.int64()),
                 pa.array(found, kind)], ["doc_id", "score", "toxic_words", "spans"])
    return rows


def _word_column(text: Column) -> Column:
    return C.normal_words(text).cast("binary")


def labelled_sample(docs: DataFrame, labels: DataFrame, folds: int, fold: int) -> DataFrame:
    """(doc_id, label, words) of at most SAMPLE_DOCS labelled documents that are not held out."""
    marked = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"), folds, fold)) \
                   .groupBy(F.col("doc_id").cast("long").alias("l_id")).agg((F.avg("toxic") >= 0.5).cast("int").alias("label"))
    chosen = C.materialize(marked.orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE_DOCS), "crf_labels")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return C.materialize(d.join(chosen, F.col("doc_id") == F.col("l_id"))
                         .select("doc_id", "label", _word_column(F.col("text")).alias("words")), "crf_sample")


def _unexplained(known: frozenset):
    """Clean documents, and the toxic ones without a known feature."""
    def rows(batches):
        for batch in batches:
            keep = [not label or all(known.isdisjoint(crf.word_features(w)) for w in set(words))
                    for words, label in zip(_words(batch), batch.column("label").to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_()))
    return rows


def _pure_features(sample: DataFrame, purity: float) -> frozenset:
    counts = sample.select("label", "words").mapInArrow(_count_features, "feature binary, toxic long, clean long")
    total = counts.groupBy("feature").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    pure = total.filter(F.col("t") / (F.col("t") + F.col("c") + 2) >= purity)
    return frozenset(bytes(r.feature) for r in pure.orderBy(F.col("t").desc(), "feature").limit(LEXICON).collect())


def lexicon(sample: DataFrame) -> frozenset:
    """Features that occur in toxic documents nearly only (the count of other documents is smoothed).

    First the ones with much evidence; then those with less, counted over the
    toxic documents that the first leave unexplained, so that words which merely
    stand beside a toxic one don't pass.
    """
    strong = _pure_features(sample, STRONG)
    rest = sample.select("label", "words").mapInArrow(_unexplained(strong), "label int, words binary")
    return strong | _pure_features(rest, WEAK)


def fit_tagger(sample: DataFrame, words: frozenset) -> crf.Model:
    """The CRF, from at most SEQUENCES labelled sequences, half of them with toxic words if there are that many."""
    pieces = C.materialize(sample.select("doc_id", "label", "words").mapInArrow(
        _sequences(words), "doc_id long, at int, piece binary, marks binary, hit boolean"), "crf_pieces")
    order = [F.xxhash64("doc_id", "at"), "doc_id", "at", "piece"]
    rows = [r for hit in (True, False) for r in pieces.filter(F.col("hit") == hit).orderBy(*order).limit(SEQUENCES // 2)
            .select("piece", "marks").collect()]
    ids = np.full((SEQUENCE, len(rows), crf.FEATURES), 1 << crf.TABLE_BITS, np.int32)
    marks = np.zeros((SEQUENCE, len(rows)))
    inside = np.zeros((SEQUENCE, len(rows)), bool)
    cache: dict[bytes, list[int]] = {}
    for k, r in enumerate(rows):
        for i, w in enumerate(bytes(r.piece).split(b" ")):
            if w not in cache:
                cache[w] = crf.feature_ids(w)
            ids[i, k], marks[i, k], inside[i, k] = cache[w], r.marks[i], True
    # words are left out at random, so that their prefixes learn to stand in for words never seen
    ids[np.random.RandomState(DROP_SEED).rand(*ids.shape[:2]) < DROP, 0] = 1 << crf.TABLE_BITS
    return crf.train(ids, marks, inside)


def calibrate(x: np.ndarray, y: np.ndarray, steps: int = 50, ridge: float = 1e-3) -> np.ndarray:
    """Logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + ridge * len(y) * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (y - p) - ridge * len(y) * w)
        w = w + step
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn(docs: DataFrame, labels: DataFrame, folds: int, fold: int) -> tuple[crf.Model, np.ndarray]:
    """(tagger, calibration weights for 1, expected toxic words, largest marginal)."""
    sample = labelled_sample(docs, labels, folds, fold)
    seen = {r.label: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    zeros, ones = seen.get(0, 0), seen.get(1, 0)
    if not zeros or not ones:
        return crf.Model(), np.array([np.log((ones + 1) / (zeros + 1)), 0.0, 0.0])
    model = fit_tagger(sample, lexicon(sample))
    totals = sample.select("label", "words").mapInArrow(_aggregates(model), "label int, expected double, largest double") \
                   .groupBy("label", "expected", "largest").agg(F.count(F.lit(1)).alias("n")) \
                   .orderBy("label", "expected", "largest").toPandas()  # at most SAMPLE_DOCS rows
    totals = totals.loc[totals.index.repeat(totals["n"])]
    x = np.column_stack([np.ones(len(totals)), totals["expected"], totals["largest"]])
    return model, calibrate(x, totals["label"].to_numpy(float))


def tag_documents(docs: DataFrame, model: crf.Model, calibration: np.ndarray) -> DataFrame:
    """doc_id, score, number of toxic words, and the toxic spans of every document."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), C.text_or_empty(F.col("text")).alias("text"),
                    _word_column(F.col("text")).alias("words"))
    return d.mapInArrow(_score_rows(model, calibration), TAGGED)


def classify(docs: DataFrame, labels: DataFrame, folds: int, fold: int) -> DataFrame:
    """doc_id, held_out, score, predicted, toxic_words, spans per document."""
    model, calibration = learn(docs, labels, folds, fold)
    out = tag_documents(docs, model, calibration)
    return out.select("doc_id", held_out(F.col("doc_id"), folds, fold).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"), "toxic_words", "spans")


def op3_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(C.read(spark, sf_dir, "documents"), C.read(spark, sf_dir, "labels"), 5, 0)
