"""Language identification by error-correcting output codes.

Each language has a codeword. For each bit a binary classifier tells the languages with a 1
from those with a 0: the log-odds of hashed byte n-grams (orders ORDERS; A-Z lower-cased,
other ASCII a space), learned from counts over all labelled rows. A text's bits are decoded to
the language with the least loss, where each bit's logistic loss is weighted by how often that
bit was right for that language on labelled rows. A narrow win is flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import slices, strings

ORDERS = (2, 4)
BUCKETS = 1 << 15
CHUNK = 1 << 12
#: Parts in which the tasks' counts are merged first.
SALTS = 64
#: Number of n-grams beyond which more of them add little certainty.
SATURATION = 60.0
#: Labelled rows on which the bits' accuracies are measured, about; the counts use all rows.
WEIGH_ROWS = 20_000
AMBIGUOUS = 0.6
UNKNOWN = "und"

_FOLD = np.full(256, 0x20, np.uint8)
_FOLD[0x80:] = np.arange(0x80, 0x100)
_FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
_FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def grams(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram at each byte (blank n-grams in bucket 0), and the
    rows' offsets. An n-gram that passes a row's end belongs to no row."""
    buf, offsets = strings(column)
    folded = _FOLD[buf].astype(np.uint32)
    out = []
    for n in ORDERS:
        size = max(len(folded) - n + 1, 0)
        key = np.zeros(size, np.uint32)
        for k in range(n):
            key |= folded[k : k + size] << np.uint32(8 * k)
        blank = key == np.uint32(int("20" * n, 16))
        index = ((key ^ np.uint32(n * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(17)
        index[index == 0] = 1
        index[blank] = 0
        out.append(index)
    return out, offsets


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n codewords of +1 and -1: all distinct splits for few languages, else the best of many
    random codes by its least distance."""
    if n <= 7:
        bits = max(2 ** (n - 1) - 1, 1)
        code = np.ones((n, bits), np.int8)
        for b in range(bits):
            for k in range(1, n):
                code[k, b] = 1 if (b >> (k - 1)) & 1 else -1
        return code
    rng = np.random.default_rng(seed)
    best, best_distance = None, -1
    for _ in range(200):
        code = rng.choice(np.array([-1, 1], np.int8), (n, 10 * math.ceil(math.log2(n))))
        distance = ((code[:, None] != code[None]).sum(axis=2) + code.shape[1] * np.eye(n, dtype=int)).min()
        if distance > best_distance:
            best, best_distance = code, distance
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # [order, bucket, bit]
    trust: np.ndarray  # [language, bit]

    def margins(self, column: pa.Array) -> np.ndarray:
        found, offsets = grams(column)
        out = np.zeros((len(column), self.code.shape[1]))
        for row, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist())):
            for order, index, weights in zip(ORDERS, found, self.weights):
                seen = index[a : max(b - order + 1, a)]
                n = int(np.count_nonzero(seen))
                if n:
                    total = sum(weights[seen[i : i + 65536]].sum(axis=0, dtype=np.float64) for i in range(0, len(seen), 65536))
                    out[row] += total / n * (SATURATION * n / (SATURATION + n))
        return out / len(ORDERS)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest language of each row and its share, a softmax over losses."""
        loss = np.logaddexp(0, -margins[:, None, :] * self.code[None])
        total = (loss * self.trust[None]).sum(axis=2)
        best = total.argmin(axis=1)
        share = np.exp(total.min(axis=1, keepdims=True) - total)
        return best, 1 / share.sum(axis=1)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def train(rows: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """A model of the languages in ``rows``; rows with a null text or language teach nothing, repeated
    rows teach once each, and without rows no language is known."""
    labelled = rows.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        tables: dict[str, np.ndarray] = {}
        for batch in slices(batches, "text"):
            found, offsets = grams(batch.column("text"))
            langs = np.array(batch.column("lang").to_pylist(), object)
            for lang in set(langs.tolist()):
                table = tables.setdefault(lang, np.zeros((len(ORDERS), BUCKETS), np.int64))
                spans = [(int(offsets[i]), int(offsets[i + 1])) for i in np.flatnonzero(langs == lang)]
                for k, (order, index) in enumerate(zip(ORDERS, found)):
                    own = [index[a : max(b - order + 1, a)] for a, b in spans]
                    table[k] += np.bincount(np.concatenate(own), minlength=BUCKETS)
        salt = TaskContext.get().partitionId() % SALTS
        for lang, table in tables.items():
            for chunk, part in enumerate(table.reshape(-1, CHUNK)):
                yield _counted((lang, chunk, salt), part)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, total = None, None
        for batch in batches:
            for lang, chunk, salt, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "chunk", "salt", "n"))):
                if key is None or key[:2] != (lang, chunk):
                    if key:
                        yield _counted(key, total)
                    key, total = (lang, chunk, salt), np.zeros(CHUNK, np.int64)
                total += np.frombuffer(n, "<i8")
        if key:
            yield _counted(key, total)

    # Every task has counts for the same few keys, so they meet in SALTS parts first.
    schema = "lang string, chunk long, salt long, n binary"
    summed = labelled.mapInArrow(count, schema)
    for keys in (("lang", "chunk", "salt"), ("lang", "chunk")):
        summed = summed.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(add, schema)
    tables: dict[str, np.ndarray] = {}
    for r in summed.collect():
        tables.setdefault(r["lang"], np.zeros((len(ORDERS) * BUCKETS // CHUNK, CHUNK)))[r["chunk"]] = np.frombuffer(bytes(r["n"]), "<i8")
    languages = sorted(tables)
    code = codewords(len(languages)) if languages else np.ones((0, 1), np.int8)
    weights = np.zeros((len(ORDERS), BUCKETS, code.shape[1]), np.float32)
    counts = np.array([tables[x].reshape(len(ORDERS), BUCKETS) for x in languages])
    for bit in range(code.shape[1] if len(languages) > 1 else 0):
        logs = []
        for side in (1, -1):
            own = counts[code[:, bit] == side].sum(axis=0) + 0.5
            own[:, 0] = 0
            logs.append(np.log(np.maximum(own, 0.5) / own.sum(axis=1, keepdims=True)))
        weights[:, :, bit] = logs[0] - logs[1]
    weights[:, 0] = 0
    model = Model(languages, code, weights, np.ones(code.shape))
    if len(languages) > 1:
        model.trust = _trust(model, labelled)
    return model


def _counted(key: tuple[str, int, int], total: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([key[0]]), pa.array([key[1]], pa.int64()), pa.array([key[2]], pa.int64()), pa.array([total.astype("<i8").tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["lang", "chunk", "salt", "n"])


def _trust(model: Model, labelled: DataFrame) -> np.ndarray:
    """Share of labelled rows of each language on which each bit is right; rows sum to one."""
    total = labelled.count()
    sample = labelled.where(F.pmod(F.xxhash64("text"), F.lit(max(1, total // WEIGH_ROWS))) == 0)
    sent = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        place = {x: k for k, x in enumerate(own.languages)}
        right, seen = np.zeros(own.code.shape, np.int64), np.zeros(len(own.languages), np.int64)
        for batch in slices(batches, "text"):
            which = np.array([place[x] for x in batch.column("lang").to_pylist()])
            np.add.at(right, which, (own.margins(batch.column("text")) * own.code[which] > 0).astype(np.int64))
            np.add.at(seen, which, 1)
        k = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(seen[k]), pa.array(right[k].tolist(), pa.list_(pa.int64()))], ["k", "seen", "good"])

    bits = model.code.shape[1]
    sums = [F.sum(F.col("good")[b]).alias(f"g{b}") for b in range(bits)]
    out = np.ones(model.code.shape)
    for r in sample.mapInArrow(run, "k long, seen long, good array<long>").groupBy("k").agg(F.sum("seen").alias("seen"), *sums).collect():
        out[r["k"]] = [(r[f"g{b}"] + 1) / (r["seen"] + 2) for b in range(bits)]
    return out / out.sum(axis=1, keepdims=True) * bits


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``lang_score`` (0 to 1) and ``lang_ambiguous``; columns of
    these names are replaced. A text that is null or has no letter is "und" with score 0, and so
    is every text if the model knows no language. Only the text is looked at; repeated rows are
    judged one by one, alike, and other columns are kept."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c not in ("lang_pred", "lang_score", "lang_ambiguous")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in slices(batches, text_col):
            texts = batch.column(text_col)
            spoken = np.array([_has_letter(t) for t in texts.to_pylist()], bool) & bool(own.languages)
            names, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if spoken.any():
                best, share = own.decode(own.margins(texts))
                score = np.where(spoken, share, 0.0)
                names = [own.languages[k] if s else UNKNOWN for k, s in zip(best.tolist(), spoken.tolist())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(names), pa.array(score), pa.array(spoken & (score < AMBIGUOUS))], [*kept, "lang_pred", "lang_score", "lang_ambiguous"])

    fields = ", ".join(f"`{c}` {kind}" for c, kind in docs.select(*kept).dtypes)
    return docs.select(*kept).mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_ambiguous boolean")


def remainder(id_col: str, n: int):
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(id_col).cast("string")) % n
