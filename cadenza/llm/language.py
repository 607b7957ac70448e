"""Language identification by character models."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm import kn
from cadenza.session import stage

ORDER = 4
#: N-grams times languages that a task looks up at a time; the model itself has no bound.
CELLS = 1_600_000
#: Rows that calibrate the temperature.
CALIBRATION_ROWS = 3_000
#: One of so many texts is kept out of the counts of the model that calibrates.
HELD_OUT = 10
#: Rows below which a language's limit is at least that of all languages together.
FEW_ROWS = 1_000
#: Share of the held-out rows of a language beyond which rejection begins, and the room
#: left beyond that.
REJECT_QUANTILE, REJECT_ROOM = 0.999, 4.0
#: Length from which the spread of cross-entropies is taken not to shrink any more.
STEADY_CHARS = 400


class LanguageModel:
    """Character model, temperature of the score and limit of the cross-entropy."""

    def __init__(self, model: kn.KneserNey):
        self.model = model
        self.temperature = 10.0
        self.mean = np.full(len(model.classes), np.inf)
        self.limit = np.zeros(len(model.classes))

    def entropies(
        self, texts: list[str], owner: np.ndarray, rows: int, known: kn.Known
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions, letters and mean negative log probability by language of each row."""
        found = kn.positions(texts, self.model.order - 1)
        inside = found.scored()
        at = np.flatnonzero(inside)
        values = np.zeros((len(inside), len(self.model.classes)))
        values[at] = known.log_p(found, at)
        n, letters = np.zeros(rows), np.zeros(rows)
        total = np.zeros((rows, values.shape[1]))
        np.add.at(n, owner, found.sums(inside.astype(float)))
        np.add.at(letters, owner, found.sums((inside & (found.units != kn.SPACE)).astype(float)))
        np.add.at(total, owner, found.sums(values))
        return n, letters, -total / np.maximum(n, 1)[:, None]

    def calibrate(self, truth: np.ndarray, entropy: np.ndarray) -> None:
        """Temperature with the least log loss."""
        if not len(truth):
            return
        own = entropy[np.arange(len(truth)), truth]

        def loss(t: float) -> float:
            x = -t * (entropy - entropy.min(axis=1, keepdims=True))
            return float(np.mean(np.log(np.exp(x).sum(axis=1)) + t * (own - entropy.min(axis=1))))

        self.temperature = min(np.geomspace(0.5, 100, 60), key=loss)

    def limits(self, held: DataFrame) -> None:
        """Mean and limit of each language from all rows of (lang, n, own cross-entropy).

        A language with few rows is judged from the mean of all rows, if that is higher, and
        with their limit, if that is wider; so is one without any.
        """
        length = F.sqrt(F.least("n", F.lit(float(STEADY_CHARS))))

        def quantile(mean):
            return F.percentile_approx((F.col("own") - mean) * length, REJECT_QUANTILE, 1_000_000)

        pooled = held.agg(F.avg("own").alias("mean")).first()["mean"]
        if pooled is None:
            return
        wide = max(1.0, REJECT_ROOM * held.agg(quantile(F.lit(pooled)).alias("far")).first()["far"])
        rows = {r["lang"]: r for r in held.groupBy("lang").agg(F.avg("own").alias("mean"), F.count("*").alias("rows")).collect()}
        means = F.create_map(*[x for k, r in rows.items() for x in (F.lit(k), F.lit(r["mean"]))])
        far = {r["lang"]: r["far"] for r in held.groupBy("lang").agg(quantile(means[F.col("lang")]).alias("far")).collect()}
        for k, lang in enumerate(self.model.classes):
            self.mean[k], self.limit[k] = pooled, wide
            if lang in rows:
                mean, limit = rows[lang]["mean"], max(1.0, REJECT_ROOM * far[lang])
                few = rows[lang]["rows"] < FEW_ROWS
                self.mean[k] = max(mean, pooled) if few else mean
                self.limit[k] = max(limit, wide) if few else limit

    def decide(self, n: np.ndarray, entropy: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best language, score, and whether the best is still too unlikely."""
        best = entropy.argmin(axis=1)
        least = entropy[np.arange(len(best)), best]
        score = 1 / np.exp(-self.temperature * (entropy - least[:, None])).sum(axis=1)
        far = (least - self.mean[best]) * np.sqrt(np.minimum(np.maximum(n, 1), STEADY_CHARS))
        return best, score, far > self.limit[best]


def _entropy_rows(docs: DataFrame, shared) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, parts, owner, known in kn.known_chunks(batches, model.model):
            n, letters, entropy = model.entropies(parts, owner, len(batch), known)
            keep = letters > 0
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang").filter(pa.array(keep)), pa.array(n[keep]),
                 pa.array(entropy[keep].tolist(), pa.list_(pa.float64()))],
                ["lang", "n", "entropy"],
            )

    return docs.select("lang", "text").mapInArrow(run, "lang string, n double, entropy array<double>")


def fit_language(training: DataFrame) -> LanguageModel | None:
    """Learn from (text, lang); rows without text or language are left out.

    Counts come from all rows.  Score and rejection are calibrated on one of ``HELD_OUT``
    texts, chosen by a hash, as a second model sees them that was learnt from the others.
    """
    rows = training.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text")
    counted = rows.withColumnRenamed("lang", "class")
    model = kn.fit(counted, ORDER, CELLS)
    if model is None:
        return None
    out = LanguageModel(model)
    apart = F.pmod(F.xxhash64("text"), F.lit(HELD_OUT)) == 0
    part = kn.fit(counted.where(~apart), ORDER, CELLS)
    held = _held_rows(rows.where(apart), part) if part else None
    if held is None or held.isEmpty():
        # too few texts to keep some apart
        part, held = model, _held_rows(rows, model)
    out.limits(held)
    some = held.orderBy("place", "lang", "n").limit(CALIBRATION_ROWS).select("truth", "entropy").toArrow()
    out.calibrate(some["truth"].to_numpy(), np.array(some["entropy"].to_pylist()).reshape(len(some), len(part.classes)))
    return out


def _held_rows(rows: DataFrame, part: kn.KneserNey) -> DataFrame:
    """(lang, n, place, entropy, truth, own): cross-entropies of rows in a language of ``part``."""
    shared = rows.sparkSession.sparkContext.broadcast(LanguageModel(part))
    truth = F.create_map(*[x for k, c in enumerate(part.classes) for x in (F.lit(c), F.lit(k))])[F.col("lang")]
    found = _entropy_rows(rows.where(truth.isNotNull()), shared).withColumn("truth", truth)
    return stage(found.withColumn("own", F.get("entropy", F.col("truth"))).withColumn("place", F.xxhash64("own")), "held")


def identify(docs: DataFrame, model: LanguageModel | None, prefix: str = "") -> DataFrame:
    """Add lang_pred, score, n_chars, entropy and rejected to ``docs``, after ``prefix``.

    Only ``text`` is read; columns of the same names are replaced.  Texts that are null or
    without a letter are ``und`` with score 0 and rejected, as is everything where no
    training row existed.  Rejected otherwise means: the best language's cross-entropy lies
    far beyond that of its own documents; lang_pred still names it.  Texts of any length are
    read whole, repeated rows are treated alike.
    """
    added = {"lang_pred": "string", "score": "double", "n_chars": "long", "entropy": "double", "rejected": "boolean"}
    added = {prefix + k: v for k, v in added.items()}
    docs = docs.drop(*added)
    # mapInArrow takes no names with dots, so columns pass through it under plain ones
    names = [c if c == "text" else f"c{k}" for k, c in enumerate(docs.columns)] + [f"a{k}" for k in range(len(added))]
    kinds_of = [f.dataType.simpleString() for f in docs.schema.fields] + list(added.values())
    schema = ", ".join(f"{n} {kind}" for n, kind in zip(names, kinds_of))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        chunks = kn.known_chunks(batches, model.model) if model else ((*c, None) for c in kn.text_chunks(batches))
        for batch, parts, owner, known in chunks:
            rows = len(batch)
            if model is None:
                new = [["und"] * rows, [0.0] * rows, [0] * rows, [None] * rows, [True] * rows]
            else:
                n, letters, entropy = model.entropies(parts, owner, rows, known)
                best, score, far = model.decide(n, entropy)
                some = letters > 0
                new = [
                    [model.model.classes[b] if s else "und" for b, s in zip(best, some)],
                    np.where(some, score, 0.0),
                    n.astype(np.int64),
                    [e if s else None for e, s in zip(entropy.min(axis=1).tolist(), some)],
                    far | ~some,
                ]
            kinds = [pa.string(), pa.float64(), pa.int64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *(pa.array(v, k) for v, k in zip(new, kinds))], names
            )

    plain = docs.toDF(*names[: len(docs.columns)])
    return plain.mapInArrow(run, schema).toDF(*docs.columns, *added)
