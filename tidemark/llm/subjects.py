"""The subject areas that a patent's claims are directed to.

1. Features of the claims alone (a mention in the description is passing) are hashed and written once to the shared folder.
2. Complement naive Bayes is trained on the reviewed documents: a feature's weight for a subject compares its rate in the
   subject with its rate in all the others together, for and against.
3. Expectation-maximisation over the documents without review, until the counts settle: every document is divided among the
   subjects in proportion to posterior times share of evidence, and the counts and weights are taken again. The reviewed
   documents are held out from these counts.
4. In every round each subject is calibrated on the held-out reviews by a logistic regression of its own, drawn to the one
   that all subjects share where its reviews are few. The loss on them ends the rounds if it rises. This gives independent posteriors, so a document may have several
   subjects or none.

Counts are whole thousandths, so sums do not depend on the order of tasks. What a pass sends to the driver is at most one row
per hash bucket, and three numbers per subject and reviewed document, whatever the corpus; the model is as large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.claims import claims_of, features_of
from tidemark.llm.tokenizer import text_slices
from tidemark.session import cut_lineage

FEATURE_BITS = 18  # hash buckets of the features, hence the bound of the model
REVIEWED_LIMIT = 20_000  # reviewed documents used for training, those with the least hash of the id
MOST_ROUNDS = 8
SETTLED = 0.01  # the rounds end when less than this share of the counts has moved
WORSE = 1.05  # a round that raises the loss on the held-out reviews beyond this factor, as in a small corpus, is undone and is the last
LEAST_COUNT = 3  # features in fewer documents have no weight; among the reviewed documents alone, which are few, one is enough
STRONG = 1.0  # log ratio from which a feature counts to a document's share of evidence
LEAST_SHARE = 0.12  # in the first round, which has no held-out reviews, a smaller share does not count
POOLING = 30.0  # how strongly a subject's calibration is drawn to the common one
SMOOTHING = 0.5
UNIT = 1000


def reviewed(labels: DataFrame, subjects: list[str], limit: int = REVIEWED_LIMIT) -> DataFrame:
    """``(doc_id, marks)``: the reviewed subjects of at most ``limit`` documents as an array of 0 and 1."""
    marks = F.array(*[F.max((F.col("subject") == s).cast("int")) for s in subjects])
    known = labels.where(F.col("doc_id").isNotNull() & F.col("subject").isin(*subjects))
    return known.groupBy("doc_id").agg(marks.alias("marks")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def claim_features(documents: DataFrame, bits: int = FEATURE_BITS) -> DataFrame:
    """``(doc_id, features)``: distinct hash buckets; documents without claims have no row."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: dict[str, int] = {}
        for part in text_slices(batches):
            found = [sorted(features_of(claims_of(t), memory, bits)) for t in part.column(1).to_pylist()]
            keep = [i for i, f in enumerate(found) if f]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.list_(pa.int32()))], names=["doc_id", "features"])

    return documents.where("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(extract, "doc_id long, features array<int>")


def weigh(counts: np.ndarray, least: float = LEAST_COUNT) -> np.ndarray:
    """Complement naive Bayes: log rate in the subject less log rate in all others; 0 for rare features."""
    rest = counts.sum(axis=1, keepdims=True) - counts
    n = max(1, int((counts.sum(axis=1) > 0).sum()))
    inside = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * n))
    outside = np.log((rest + SMOOTHING) / (rest.sum(axis=0) + SMOOTHING * n))
    weights = inside - outside
    weights[counts.sum(axis=1) < least] = 0
    return weights.astype(np.float32)


def evidence(features: pa.ListArray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each document's mean evidence for and against each subject, and each subject's share of the strong evidence."""
    bounds = features.offsets.to_numpy()
    flat = weights[features.values.to_numpy()[bounds[0] : bounds[-1]]] if bounds[-1] > bounds[0] else np.zeros((0, weights.shape[1]), np.float32)
    bounds = bounds - bounds[0]

    def by_document(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([np.zeros((1, values.shape[1])), np.cumsum(values, axis=0, dtype=np.float64)])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    strong = by_document(np.where(flat >= STRONG, flat, 0))
    return by_document(flat) / np.maximum(np.diff(bounds), 1)[:, None], strong / np.maximum(strong.sum(axis=1, keepdims=True), 1e-9)


def _marks(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    column = batch.column(2)
    has = ~np.asarray(column.is_null())
    marks = np.zeros((batch.num_rows, width))
    marks[has] = np.array(column.drop_null().to_pylist(), dtype=float).reshape(-1, width)
    return has, marks


def _inputs(mean: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.stack([np.ones_like(share), np.log(share + 0.01), share, mean], axis=-1)


def posteriors(mean: np.ndarray, share: np.ndarray, curves: np.ndarray) -> np.ndarray:
    """Every subject's posterior from its own curve."""
    return 1 / (1 + np.exp(-np.clip((_inputs(mean, share) * curves).sum(axis=-1), -30, 30)))


def _regression(x: np.ndarray, y: np.ndarray, prior: np.ndarray, ridge: float) -> np.ndarray:
    """Logistic regression by Newton's method, drawn to ``prior``."""
    beta = prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (y - p) - ridge * (beta - prior))
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return beta


def calibrate(mean: np.ndarray, share: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """One curve per subject from the reviews ``marks``."""
    x = _inputs(mean, share)
    common = _regression(x.reshape(-1, x.shape[-1]), marks.reshape(-1), np.array([0.0, 1.0, 0.0, 0.0]), 0.1)
    return np.stack([_regression(x[:, s], marks[:, s], common, POOLING) for s in range(marks.shape[1])])


def _counted(table: DataFrame, width: int, bits: int, model=None) -> np.ndarray:
    """Counts of every bucket and subject over all documents of ``table``: divided by their reviews, or by the current ``model``.

    The model is a broadcast (weights, curves); without curves documents are divided by their shares of evidence alone.
    """

    def parts_of(batch: pa.RecordBatch) -> np.ndarray:
        if model is None:
            parts = _marks(batch, width)[1]
        else:
            weights, curves = model.value
            mean, share = evidence(batch.column(1), weights)
            parts = np.where(share >= LEAST_SHARE, share, 0) if curves is None else share * posteriors(mean, share, curves)
        return parts / np.maximum(parts.sum(axis=1, keepdims=True), 1e-9)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, touched = np.zeros((1 << bits, width), dtype=np.int64), False
        for batch in batches:
            if not batch.num_rows:
                continue
            touched = True
            whole = np.rint(parts_of(batch) * UNIT).astype(np.int64)
            bounds = batch.column(1).offsets.to_numpy()
            flat, owner = batch.column(1).values.to_numpy()[bounds[0] : bounds[-1]], np.repeat(np.arange(batch.num_rows), np.diff(bounds))
            for s in range(width):
                use = whole[owner, s] > 0
                total[:, s] += np.bincount(flat[use], weights=whole[owner[use], s], minlength=1 << bits).astype(np.int64)
        if touched:
            rows = np.flatnonzero(total.any(axis=1))
            for some in np.array_split(rows, max(1, len(rows) // 20_000)):
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *[pa.array(total[some, s]) for s in range(width)]], names=["bucket", *(f"s{s}" for s in range(width))])

    shape = ", ".join(["bucket long", *(f"s{s} long" for s in range(width))])
    # Every task sends at most one row a bucket, so few and large tasks keep what is sent small, however large the corpus.
    few = 4 * table.sparkSession.sparkContext.defaultParallelism
    sums = table.coalesce(few).mapInArrow(count, shape).groupBy("bucket").agg(*[F.sum(f"s{s}").alias(f"s{s}") for s in range(width)]).toArrow()
    counts = np.zeros((1 << bits, width))
    counts[sums.column("bucket").to_numpy()] = np.column_stack([sums.column(f"s{s}").to_numpy() for s in range(width)]) / UNIT if sums.num_rows else 0
    return counts


def _curves(known: DataFrame, width: int, weights) -> tuple[np.ndarray, float]:
    """The calibration of the current weights on the reviewed documents, of which only the evidence comes to the driver, and its loss."""

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mean, share = evidence(batch.column(1), weights.value)
            rows = np.concatenate([mean, share, _marks(batch, width)[1]], axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.list_(pa.float64()))], names=["row"])

    rows = np.array(known.mapInArrow(judge, "row array<double>").toArrow().column("row").to_pylist()).reshape(-1, 3 * width)
    rows = rows[np.lexsort(rows.T)]  # sums in one order, whatever the order of tasks
    mean, share, marks = np.split(rows, 3, axis=1)
    curves = calibrate(mean, share, marks)
    p = np.clip(posteriors(mean, share, curves), 1e-6, 1 - 1e-6)
    return curves, float(-(marks * np.log(p) + (1 - marks) * np.log(1 - p)).mean())


def subject_posteriors(documents: DataFrame, labels: DataFrame, subjects: list[str], *, bits: int = FEATURE_BITS, rounds: int = MOST_ROUNDS) -> DataFrame:
    """``(doc_id, subject, posterior, n_subjects)``: every subject's posterior of 0.5 or more for every document with claims.

    Null, blank and claimless texts have no row. Labels of unknown subjects or documents are ignored; without any label
    there is no model and the result is empty. Repeated documents give repeated rows.
    """
    subjects, spark = sorted(subjects), documents.sparkSession
    width, context = len(subjects), spark.sparkContext
    shape = "doc_id long, subject string, posterior double, n_subjects int"
    marks = reviewed(labels, subjects).select("doc_id", F.col("marks"))
    table = cut_lineage(claim_features(documents, bits).join(F.broadcast(marks), "doc_id", "left").select("doc_id", "features", "marks"))
    known, rest = cut_lineage(table.where("marks IS NOT NULL")), table.where("marks IS NULL")
    counts = _counted(known, width, bits)
    if not counts.any():
        return spark.createDataFrame([], shape)
    weights, curves, loss = weigh(counts, least=1), None, np.inf
    for _ in range(rounds):
        again = _counted(rest, width, bits, context.broadcast((weights, curves)))
        if not again.any():  # every document is reviewed
            break
        moved, counts, new = np.abs(again - counts).sum() / again.sum(), again, weigh(again)
        fitted, now = _curves(known, width, context.broadcast(new))
        if now > WORSE * loss:
            break
        weights, curves, loss = new, fitted, now
        if moved < SETTLED:
            break
    if curves is None:
        curves, _ = _curves(known, width, context.broadcast(weights))
    model = context.broadcast((weights, curves))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(subjects)
        for batch in batches:
            mean, share = evidence(batch.column(1), model.value[0])
            posterior = posteriors(mean, share, model.value[1])
            has = (posterior >= 0.5) & (share > 0)
            row, subject = np.nonzero(has)
            columns = [batch.column(0).take(pa.array(row)), names.take(pa.array(subject)), pa.array(posterior[row, subject]), pa.array(has.sum(axis=1)[row], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "subject", "posterior", "n_subjects"])

    return table.select("doc_id", "features").mapInArrow(judge, shape)
