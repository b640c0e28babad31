"""Quality classifier by co-training of a text view and a metadata view.

Both views are logistic regressions on sparse binary features. The text view sees which words
a text has (hashed) and the shape of its words and characters; the metadata view sees source,
language, both together and the recorded size, and nothing that is read from the text. In each
round each view labels the documents of an unlabelled pool it is most sure of, and those go into
the other view's training set; every round has a pool of its own. Each view is calibrated on
labelled rows that were held back, and at last the calibrated log-odds are combined with weights
learned on those rows, none below 0.

A row is good if its quality is 1 and it is not marked toxic. Fitting uses at most about
LABELLED labelled rows and POOL others a round, all drawn by hash from the whole tables; every
document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, SPACED, Words, hashes, mix, slices, strings

LABELLED = 12_000
POOL = 6_000
ROUNDS = 4
#: Share of its pool that a view may label good, or bad, in a round.
EXCHANGE = 0.1
SURE = 0.95
WORD_BITS = 15
BINS = 32
TEXT_SIZE = (1 << WORD_BITS) + 5 * BINS
META_PART = 512
META_SIZE = BINS + 3 * META_PART


def features(batch: pa.RecordBatch) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """For each view (row of each feature, feature), rows ascending. Columns: text, source, lang, size."""
    n = batch.num_rows
    words = Words(batch.column("text"), ALNUM)
    row = np.repeat(np.arange(n), np.diff(words.first))
    place = (words.hash >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    pairs = np.unique(row * (1 << WORD_BITS) + place)
    raw, offsets = strings(batch.column("text"))
    size = np.maximum(np.diff(offsets), 1)
    sums = lambda mask: np.diff(np.concatenate([[0], np.cumsum(mask)])[offsets])
    count = np.maximum(np.diff(words.first), 1)
    distinct = np.bincount(np.unique(row.astype(np.uint64) << np.uint64(40) | words.hash >> np.uint64(24)).astype(np.uint64) >> np.uint64(40), minlength=n)
    mark = (raw < 0x80) & ~ALNUM[raw] & SPACED[raw] & ~((raw >= 0x41) & (raw <= 0x5A))
    shape = [
        sums(mark) / size * 4 * BINS,
        sums((raw >= 0x41) & (raw <= 0x5A)) / size * 2 * BINS,
        distinct / count * BINS,
        np.bincount(row, words.end - words.start, n) / count * 2,
        sums((raw >= 0x30) & (raw <= 0x39)) / size * 4 * BINS,
    ]
    bins = np.stack([np.clip(s, 0, BINS - 1).astype(np.int64) + k * BINS for k, s in enumerate(shape)], axis=1) + (1 << WORD_BITS)
    text_row = np.concatenate([pairs >> WORD_BITS, np.repeat(np.arange(n), bins.shape[1])])
    text = np.concatenate([pairs & ((1 << WORD_BITS) - 1), bins.ravel()])
    order = np.argsort(text_row, kind="stable")

    recorded = batch.column("size").to_numpy(zero_copy_only=False).astype(np.float64)
    named = [np.where(np.isnan(recorded), BINS - 1, np.clip(np.log2(np.maximum(recorded, 0) + 1) * 2, 0, BINS - 2)).astype(np.int64)]
    hashed = []
    for column in ("source", "lang"):
        buf, at = strings(batch.column(column))
        own = hashes(buf, at[:-1], at[1:]) if len(buf) else np.zeros(n, np.uint64)
        hashed.append(np.where(np.diff(at) > 0, own, np.uint64(0)))
    for k, own in enumerate((*hashed, mix(hashed[0] + hashed[1] * np.uint64(3)))):
        named.append((own % np.uint64(META_PART)).astype(np.int64) + BINS + k * META_PART)
    meta_rows = np.repeat(np.arange(n), len(named))
    return (text_row[order], text[order]), (meta_rows, np.stack(named, axis=1).ravel())


class Sparse:
    """Rows of features, worth the less each the more a row has."""

    def __init__(self, row: np.ndarray, feature: np.ndarray, n: int):
        self.row, self.feature, self.n = row, feature, n
        self.value = (np.maximum(np.bincount(row, minlength=n), 1.0) ** -0.25)[row]

    def odds(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights[self.feature] * self.value, self.n) + weights[-1]

    def take(self, rows: np.ndarray) -> Sparse:
        at = np.full(self.n, -1)
        at[rows] = np.arange(len(rows))
        new = at[self.row]
        keep = new >= 0
        return Sparse(new[keep], self.feature[keep], len(rows))


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: Sparse, y: np.ndarray, size: int, start: np.ndarray | None = None, penalty: float = 5e-5) -> np.ndarray:
    """Logistic regression by Adam on all rows at once, the two classes weighing alike; the
    last weight is the intercept. From earlier weights fewer steps are taken."""
    w, m, v = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1)
    steps = 300 if start is None else 60
    w = w if start is None else start.copy()
    good = y.mean()
    importance = np.where(y > 0.5, 0.5 / max(good, 1e-9), 0.5 / max(1 - good, 1e-9)) / len(y)
    for t in range(1, steps + 1):
        error = (_sigmoid(x.odds(w)) - y) * importance
        g = np.append(np.bincount(x.feature, error[x.row] * x.value, size), error.sum()) + penalty * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-7)
    return w


def calibrate(odds: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Slopes, none below 0, and shift of a logistic curve from ``odds`` [rows, kinds] to labels, by
    Newton steps. A slope that would fall below 0 is 0."""
    kinds = odds.shape[1]
    x = np.concatenate([np.clip(odds, -20, 20), np.ones((len(odds), 1))], axis=1)
    target = np.where(y > 0.5, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    pull = np.append(np.full(kinds, 0.1), 1e-3)
    w, open_ = np.append(np.ones(kinds), 0.0), np.ones(kinds + 1, bool)
    for _ in range(60):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - target) + pull * np.append(w[:kinds] - 0.5, 0)
        hess = (x * (p * (1 - p) + 1e-6)[:, None]).T @ x + np.diag(pull)
        step = np.zeros(kinds + 1)
        step[open_] = np.clip(np.linalg.solve(hess[np.ix_(open_, open_)], grad[open_]), -1, 1)
        w -= step
        below = w[:kinds] < 0
        w[:kinds][below] = 0
        open_[:kinds] &= ~below
    return w


@dataclass
class Model:
    text: np.ndarray
    meta: np.ndarray
    text_curve: np.ndarray
    meta_curve: np.ndarray
    #: Weights of both views' odds, and a shift.
    both: np.ndarray
    #: Pseudo-labels that each view had received after each round.
    exchanged: list[tuple[int, int]]

    def score(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Combined, text and metadata probability that a row is good."""
        (tr, tf), (mr, mf) = features(batch)
        n = batch.num_rows
        text, meta = Sparse(tr, tf, n).odds(self.text), Sparse(mr, mf, n).odds(self.meta)
        curve = lambda c, *odds: _sigmoid(sum(a * np.clip(x, -20, 20) for a, x in zip(c, odds)) + c[-1])
        return curve(self.both, text, meta), curve(self.text_curve, text), curve(self.meta_curve, meta)


def _rows(docs: DataFrame, text_col: str, source_col: str, lang_col: str, size_col: str) -> list:
    size = F.col(size_col).cast("double") if size_col in docs.columns else F.lit(None).cast("double")
    return [*(F.col(c).cast("string").alias(n) for c, n in ((text_col, "text"), (source_col, "source"), (lang_col, "lang"))), size.alias("size")]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars") -> Model | None:
    """Co-trained model, or None where the labels don't hold both classes.

    Labels with a null id or quality teach nothing, of several for an id the worst counts, and each
    row of a repeated id is a row of its own. A null text has no words; a null source, language or
    size is a value of its own, and so is a size column that is not there.
    """
    known = labels.select(F.col(id_col).alias("id"), ((F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)).cast("int").alias("y")).where("id is not null and y is not null")
    known = known.groupBy("id").agg(F.min("y").alias("y"))
    n_known, n_docs = known.count(), docs.count()
    known = known.where(F.pmod(F.xxhash64("id"), F.lit(n_known // LABELLED + 1)) == 0)
    rows = docs.select(F.col(id_col).alias("id"), *_rows(docs, text_col, source_col, lang_col, size_col))
    # Not more than about LABELLED rows of two numbers.
    labelled = rows.join(F.broadcast(known), "id")
    turn = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(max(ROUNDS, n_docs // POOL + 1)))
    pool = rows.withColumn("y", (-1 - turn).cast("int")).where(turn < ROUNDS).join(F.broadcast(known.select("id")), "id", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            out = [batch.column("y")]
            for row, feature in features(batch):
                cuts = np.searchsorted(row, np.arange(batch.num_rows + 1))
                out.append(pa.array([feature[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["y", "text", "meta"])

    got = labelled.unionByName(pool).select("y", "text", "source", "lang", "size").mapInArrow(run, "y int, text binary, meta binary").toArrow().sort_by([("y", "ascending"), ("text", "ascending"), ("meta", "ascending")])
    y = got.column("y").to_numpy()
    views = []
    for name in ("text", "meta"):
        sets = [np.frombuffer(x, "<u4") for x in got.column(name).to_pylist()]
        views.append(Sparse(np.repeat(np.arange(len(sets)), [len(s) for s in sets]), np.concatenate(sets).astype(np.int64) if sets else np.zeros(0, np.int64), len(sets)))
    del got
    mine = np.flatnonzero(y >= 0)
    if len(set(y[mine].tolist())) < 2:
        return None
    return cotrain(views, y)


def cotrain(views: list[Sparse], y: np.ndarray) -> Model:
    """``views``: text and metadata of the same rows; ``y``: 1 or 0, and -1 - k for the pool of round
    k. Every fifth labelled row is held back for the curves; where that leaves a class out
    on either side, all labelled rows serve both ends."""
    sizes = (TEXT_SIZE, META_SIZE)
    mine = np.flatnonzero(y >= 0)
    held, base = mine[::5], np.setdiff1d(mine, mine[::5])
    if len(set(y[base].tolist())) < 2 or len(set(y[held].tolist())) < 2:
        base = held = mine
    gained: list[dict[int, int]] = [{}, {}]
    exchanged = []
    weights, curves = [None, None], [None, None]
    for turn in range(ROUNDS + 1):
        for k in (0, 1):
            rows = np.concatenate([base, np.array(sorted(gained[k]), np.int64)])
            target = np.concatenate([y[base], [gained[k][i] for i in sorted(gained[k])]]).astype(float)
            weights[k] = fit(views[k].take(rows), target, sizes[k], weights[k])
            curves[k] = calibrate(views[k].take(held).odds(weights[k])[:, None], y[held].astype(float))
        if turn == ROUNDS:
            break
        spare = np.flatnonzero(y == -1 - turn)
        most = int(np.ceil(EXCHANGE * len(spare)))
        for k in (0, 1):
            p = _sigmoid(curves[k][0] * np.clip(views[k].take(spare).odds(weights[k]), -20, 20) + curves[k][1])
            for label, order in ((1, np.argsort(-p, kind="stable")), (0, np.argsort(p, kind="stable"))):
                sure = p[order] >= SURE if label else p[order] <= 1 - SURE
                gained[1 - k].update((int(i), label) for i in spare[order[sure][:most]])
        exchanged.append((len(gained[0]), len(gained[1])))
    both = calibrate(np.stack([v.take(held).odds(w) for v, w in zip(views, weights)], axis=1), y[held].astype(float))
    return Model(weights[0], weights[1], curves[0], curves[1], both, exchanged)


def score(docs: DataFrame, model: Model | None, text_col: str = "text", source_col: str = "source", lang_col: str = "lang", size_col: str = "n_chars", threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``quality_score``, ``text_score``, ``meta_score`` (0 to 1) and ``keep``; columns of
    these names are replaced. Null texts have no words, null sources, languages and sizes are
    values of their own. Rows are scored one by one, repeated ones alike. Without a model all
    scores are 0.5 and all rows are kept."""
    fresh = ("quality_score", "text_score", "meta_score", "keep")
    kept = [c for c in docs.columns if c not in fresh]
    if model is None:
        return docs.select(*kept, *(F.lit(0.5).alias(c) for c in fresh[:3]), F.lit(True).alias("keep"))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text_col):
            size = batch.column(size_col).cast(pa.float64()) if size_col in kept else pa.nulls(batch.num_rows, pa.float64())
            seen = pa.RecordBatch.from_arrays([*(batch.column(c).cast(pa.string()) for c in (text_col, source_col, lang_col)), size], ["text", "source", "lang", "size"])
            both, text, meta = sent.value.score(seen)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(both), pa.array(text), pa.array(meta), pa.array(both >= threshold)], [*kept, *fresh])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, quality_score double, text_score double, meta_score double, keep boolean")
