"""Toxicity by two class-conditional character models with shared lower orders."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kn
from cadenza.session import stage

ORDER = 5
#: N-grams times classes that a task looks up at a time; the model itself has no bound.
CELLS = 1_600_000
#: Labelled rows, kept out of the counts, that calibrate the score.
CALIBRATION_ROWS = 6_000
#: A word speaks for toxicity by what its log likelihood ratio has beyond this.
STRONG = 2.0


def _repeats(found: kn.Positions, first: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places in ``chosen`` whose word stood earlier in the same text."""
    ends = np.append(first[1:], len(found.units))
    text = np.searchsorted(found.starts, first, side="right")
    seen, out = set(), []
    for at, k in enumerate(chosen):
        key = (text[k], found.units[first[k] : ends[k]].tobytes().rstrip(b"\x20\x00"))
        if key in seen:
            out.append(at)
        seen.add(key)
    return np.array(out, int)


class ToxicityModel:
    """Character model of the classes 0 and 1 and the weights of a logistic calibration."""

    def __init__(self, model: kn.KneserNey):
        self.model = model
        self.centre, self.scale, self.weights = np.zeros(3), np.ones(3), np.array([-2.0, 1.0, 0.0, 0.0])

    def evidence(self, texts: list[str], owner: np.ndarray, rows: int, known: kn.Known) -> np.ndarray:
        """By row: mean log likelihood ratio, and what strong words add, a word and in all."""
        found = kn.positions(texts, self.model.order - 1)
        inside = found.scored()
        at = np.flatnonzero(inside)
        log_p = known.log_p(found, at)
        ratio = np.zeros(len(inside))
        if len(self.model.classes) == 2:
            ratio[at] = log_p[:, 1] - log_p[:, 0]
        # a word is what follows a space, up to the next one
        first = np.flatnonzero((found.units != kn.SPACE) & np.append(True, found.units[:-1] == kn.SPACE))
        strong = np.zeros(len(ratio))
        if first.size:
            speaks = np.clip(np.add.reduceat(ratio, first) - STRONG, 0, STRONG)
            # a word counts once in a text, however often it is repeated
            for k in np.flatnonzero(speaks)[_repeats(found, first, np.flatnonzero(speaks))]:
                speaks[k] = 0
            strong[first] = speaks
        n, words, total, beyond = np.zeros(rows), np.zeros(rows), np.zeros(rows), np.zeros(rows)
        starts = np.zeros(len(ratio))
        starts[first] = 1
        np.add.at(n, owner, found.sums(inside.astype(float)))
        np.add.at(words, owner, found.sums(starts))
        np.add.at(total, owner, found.sums(ratio))
        np.add.at(beyond, owner, found.sums(strong))
        return np.stack([total / np.maximum(n, 1), beyond / np.maximum(words, 1), np.log1p(beyond)], axis=1)

    def calibrate(self, label: np.ndarray, evidence: np.ndarray) -> None:
        """Logistic regression by Newton steps with a small ridge."""
        if len(np.unique(label)) < 2:
            self.weights = np.array([4.0 if len(label) and label[0] else -4.0, 0, 0, 0])
            return
        self.centre, self.scale = evidence.mean(axis=0), np.maximum(evidence.std(axis=0), 1e-9)
        x = np.column_stack([np.ones(len(label)), (evidence - self.centre) / self.scale])
        w, ridge = np.zeros(4), np.diag([1e-6, 0.1, 0.1, 0.1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
            w = w + np.clip(step, -3, 3)
        self.weights = w

    def score(self, evidence: np.ndarray) -> np.ndarray:
        x = np.column_stack([np.ones(len(evidence)), (evidence - self.centre) / self.scale])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def fit_toxicity(training: DataFrame, labels: DataFrame) -> ToxicityModel | None:
    """Learn from (doc_id, text) and (doc_id, toxic); null text or label is left out.

    A document with several labels counts as toxic if one of them says so.  At most a fifth
    of the labelled documents and ``CALIBRATION_ROWS`` of them, chosen by a hash of their id,
    calibrate the score; all others are counted.
    """
    marked = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        .select("doc_id", (F.col("toxic") > 0).cast("int").alias("toxic"))
    )
    # labels of documents that are not learnt from choose nothing either
    marked = stage(marked.join(training.select("doc_id").hint("merge"), "doc_id", "left_semi"), "marked")
    apart = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    rows = training.select("doc_id", "text").where(F.col("text").isNotNull())
    # labels grow with the corpus: never broadcast, whatever their size here
    some = marked.where(apart).orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id").limit(CALIBRATION_ROWS)
    some = stage(some, "calibration")
    counted = rows.join(F.broadcast(some), "doc_id", "left_anti").join(marked.hint("merge"), "doc_id")
    model = kn.fit(counted.select(F.col("toxic").cast("string").alias("class"), "text"), ORDER, CELLS, shared=True)
    if model is None:
        return None
    out = ToxicityModel(model)
    shared = rows.sparkSession.sparkContext.broadcast(out)
    got = _evidence_rows(rows.join(F.broadcast(some), "doc_id"), shared).toArrow()
    out.calibrate(got["toxic"].to_numpy().astype(float), np.array(got["evidence"].to_pylist()).reshape(len(got), 3))
    return out


def _evidence_rows(rows: DataFrame, shared) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, parts, owner, known in kn.known_chunks(batches, shared.value.model):
            found = shared.value.evidence(parts, owner, len(batch), known)
            yield pa.RecordBatch.from_arrays(
                [batch.column("toxic"), pa.array(found.tolist(), pa.list_(pa.float64()))], ["toxic", "evidence"]
            )

    return rows.select("toxic", "text").mapInArrow(run, "toxic int, evidence array<double>")


def score_toxicity(docs: DataFrame, model: ToxicityModel | None) -> DataFrame:
    """(doc_id, score, predicted, ratio) of each row of ``docs``; only text decides.

    A null text counts as empty; without any training row every score is 0.  Texts of any
    length are scored whole; repeated rows are scored alike.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chunks = kn.known_chunks(batches, model.model) if model else ((*c, None) for c in kn.text_chunks(batches))
        for batch, parts, owner, known in chunks:
            if model is None:
                evidence, score = np.zeros((len(batch), 3)), np.zeros(len(batch))
            else:
                evidence = model.evidence(parts, owner, len(batch), known)
                score = model.score(evidence)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(evidence[:, 0])],
                ["doc_id", "score", "predicted", "ratio"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double, predicted int, ratio double")
