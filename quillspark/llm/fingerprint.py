"""Document fingerprints after I-Match.

Terms (runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased) are kept if
their inverse document frequency lies in a band (large groups of like texts weigh as one text where
a term could be too frequent); a text's distinct kept terms are sorted and
hashed once for each of SALTS x LEVELS randomised subsets of that lexicon. Level l of a salt
keeps each term with probability 2^-l, so that for a text of any length some subsets hold a
few of its terms and may survive an edit. A text without kept terms keeps all its terms. Likeness is the share of equal hashes among the
subsets that hold a term of either text.
"""

from __future__ import annotations

import base64
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import ALNUM, Words, mix, slices
from .token_files import partitions

SALTS, LEVELS = 16, 10
#: Terms in at least 1 in 4000 documents and at most 1 in 10: with an average of d distinct
#: terms a document the lexicon has at most 4000 d entries, whatever the number of documents.
IDF_BAND = (math.log(10), math.log(4000))
#: Minima of a text's terms that like texts share, and the share of rows from which a group of them
#: weighs as one text: there are at most 1 / LARGE of these groups.
MINIMA, LARGE = 4, 1e-3
_ONE = 1 << 30
#: Ranges of ids at most, whose bounds the driver holds; a larger corpus has larger ranges.
MOST_RANGES = 16_384


def _distinct(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each row's distinct words, sorted by both."""
    row = np.repeat(np.arange(len(words.first) - 1), np.diff(words.first))
    order = np.argsort(words.hash, kind="stable")
    order = order[np.argsort(row[order], kind="stable")]
    row, term = row[order], words.hash[order]
    keep = np.ones(len(term), bool)
    keep[1:] = (term[1:] != term[:-1]) | (row[1:] != row[:-1])
    return row[keep], term[keep]


def _signs(row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
    """A hash of the MINIMA of each row's distinct terms (0: none)."""
    out = np.zeros(rows, np.uint64)
    if len(row):
        starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        own = np.zeros(len(starts), np.uint64)
        for k in range(MINIMA):
            own = mix(own + np.minimum.reduceat(mix(term ^ np.uint64(0xD1B54A32D192ED03 * (k + 1) & (1 << 64) - 1)), starts))
        out[row[starts]] = own
    return out


def _large(texts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted signs of the large groups of like texts, and what each of their rows weighs of _ONE."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            signs = _signs(*_distinct(Words(batch.column("text"), ALNUM)), batch.num_rows)
            yield pa.RecordBatch.from_arrays([pa.array(signs.view(np.int64))], ["sign"])

    sizes = texts.mapInArrow(run, "sign long").groupBy("sign").agg(F.count("*").alias("n")).where(F.col("n") >= max(2, total * LARGE)).toArrow()
    signs = sizes.column("sign").to_numpy().view(np.uint64)
    order = np.argsort(signs)
    return signs[order], np.maximum(_ONE // sizes.column("n").to_numpy()[order], 1)


def lexicon(docs: DataFrame, text_col: str, band: tuple[float, float] = IDF_BAND, copies: bool = True) -> np.ndarray:
    """Sorted hashes of the terms in the band, counted over all rows (null: no terms). Without
    ``copies`` also those that leave it only because of large groups of like texts."""
    texts = docs.select(F.col(text_col).cast("string").alias("text"))
    total = docs.count()
    signs, weights = (np.zeros(0, np.uint64), np.zeros(0, np.int64)) if copies else _large(texts, total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts, parts, held, every = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), [], 0, 0

        def merged() -> tuple[np.ndarray, np.ndarray]:
            found, at = np.unique(np.concatenate([names, *(t for t, _ in parts)]), return_inverse=True)
            out = np.zeros((2, len(found)), np.int64)
            out[:, at[: len(names)]] = counts
            np.add.at(out[1], at[len(names) :], np.concatenate([w for _, w in parts] or [np.zeros(0, np.int64)]))
            out[0] += np.bincount(at[len(names) :], minlength=len(found))
            return found, out

        for batch in slices(batches, "text"):
            row, term = _distinct(Words(batch.column("text"), ALNUM))
            weight = np.full(batch.num_rows, _ONE)
            if len(signs):
                own = _signs(row, term, batch.num_rows)
                at = np.minimum(np.searchsorted(signs, own), len(signs) - 1)
                weight = np.where(signs[at] == own, weights[at], _ONE)
            every += int(weight.sum())
            parts.append((term, weight[row]))
            held += len(term)
            if held > 2_000_000:
                (names, counts), parts, held = merged(), [], 0
        names, counts = merged()
        for i in range(0, len(names), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(names[part].view(np.int64)), pa.array(counts[0, part]), pa.array(counts[1, part]), pa.nulls(len(names[part]), pa.int64())], ["term", "n", "w", "every"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([0]), pa.array([0]), pa.array([every])], ["term", "n", "w", "every"])

    low, high = total * math.exp(-band[1]), total * math.exp(-band[0])
    counted = texts.mapInArrow(run, "term long, n long, w long, every long").groupBy("term").agg(*(F.sum(c).alias(c) for c in ("n", "w", "every")))
    # The sum of all weights stands in the row without a term.
    found = counted.where(F.col("term").isNull() | (F.col("n") >= low)).toArrow()
    n, w = (found.column(c).to_numpy() for c in ("n", "w"))
    real = found.column("term").is_valid().to_numpy()
    every = sum(x or 0 for x in found.column("every").to_pylist())
    keep = real & ((n <= max(high, 1)) | (not copies) & (w <= every * math.exp(-band[0])))
    return np.sort(found.column("term").combine_chunks().fill_null(0).to_numpy()[keep].view(np.uint64))


def prints(texts: list[str], known: np.ndarray) -> np.ndarray:
    """Hashes of each text, [texts, SALTS * LEVELS], 0 where a subset holds none of its terms.
    A text without known terms has all its terms; one of which no subset holds a term has hashes of
    its whole self instead."""
    words = Words(pa.array(texts, pa.large_string()), ALNUM)
    row, term = _distinct(words)
    if len(known):
        at = np.minimum(np.searchsorted(known, term), len(known) - 1)
        keep = known[at] == term
        none = np.bincount(row[keep], minlength=len(texts)) == 0
        keep |= none[row]
        row, term = row[keep], term[keep]
    out = np.zeros((len(texts), SALTS, LEVELS), np.uint64)
    for salt in range(SALTS):
        draw = mix(term ^ np.uint64(0x9E3779B97F4A7C15 * (salt + 1) & (1 << 64) - 1))
        level = np.minimum(np.floor(-np.log2((draw >> np.uint64(11)).astype(np.float64) / (1 << 53) + 2.0**-53)), LEVELS).astype(np.int64)
        sums = np.zeros((len(texts), LEVELS + 1), np.uint64)
        np.add.at(sums, (row, level), mix(term + np.uint64(salt)))
        out[:, salt] = np.cumsum(sums[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1][:, 1:]
    flat = out.reshape(len(texts), -1)
    flat = np.where(flat == 0, np.uint64(0), (mix(flat) >> np.uint64(40)) | np.uint64(1))
    for i in np.flatnonzero(~flat.any(axis=1)).tolist():
        seed = int.from_bytes(hashlib.blake2b(texts[i].encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")
        flat[i] = (mix(np.arange(1, SALTS * LEVELS + 1, dtype=np.uint64) * np.uint64(seed | 1)) >> np.uint64(40)) | np.uint64(1)
    return flat


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    either = ((a != 0) | (b != 0)).sum(axis=1)
    return ((a == b) & (a != 0)).sum(axis=1) / np.maximum(either, 1)


def as_text(flat: np.ndarray) -> list[str]:
    """Three bytes of each hash, in base 64."""
    data = flat.astype("<u4").view(np.uint8).reshape(len(flat), -1, 4)[:, :, :3].tobytes()
    size = SALTS * LEVELS * 3
    return [base64.b64encode(data[i * size : (i + 1) * size]).decode() for i in range(len(flat))]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", known: np.ndarray | None = None) -> DataFrame:
    """``(id_col, fingerprint)`` of each row; a null text counts as empty. The lexicon is that of
    ``docs`` unless given. Equal texts have equal fingerprints."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(lexicon(docs, text_col, copies=False) if known is None else known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = prints([x or "" for x in batch.column("text").to_pylist()], sent.value)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(as_text(found))], ["id", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, fingerprint string").withColumnRenamed("id", id_col)


def edited_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its text edited with the next document.

    The last half of the text (rounded down, in code points) is replaced by as many first code
    points of the next row in descending id (after the last: the first), or all if it has
    fewer. Null texts are empty. Rows with a null id are left out; rows that share an id stand
    in the order of their texts. Rows are dealt to ranges of ids; the first row of each range
    is sent to the range before it as well, so no order over all rows is needed.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).where("id is not null")
    sent = spark.sparkContext.broadcast(lexicon(rows, "text", copies=False))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = min(partitions(spark, total), MOST_RANGES)
    cuts = sorted(set(rows.stat.approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(np.array(cuts), ids.to_numpy(), side="right"))

    dealt = rows.withColumn("bucket", bucket("id"))
    heads = dict(dealt.groupBy("bucket").agg(F.max("id")).collect())
    order = sorted(heads)
    donors = [(heads[b], order[(k + 1) % len(order)]) for k, b in enumerate(order)]
    schema = "id long, bucket long"
    extra = rows.join(F.broadcast(spark.createDataFrame(donors, schema)), "id").select("id", "text", "bucket", F.lit(1).alias("donor"))
    both = dealt.select("id", "text", "bucket", F.lit(0).alias("donor")).unionByName(extra)
    sorted_ = both.repartitionById(parts, F.col("bucket").cast("int")).sortWithinPartitions("bucket", "donor", F.desc("id"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in slices(batches, "text"):
            new = list(zip(*(batch.column(c).to_pylist() for c in ("bucket", "donor", "id", "text"))))
            new = [held, *new] if held else new
            yield _edited(new, sent.value)
            held = new[-1]

    out = sorted_.select("bucket", "donor", "id", "text").mapInArrow(
        run, "id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    )
    return out.withColumnRenamed("id", id_col)


def _edited(rows: list[tuple], known: np.ndarray) -> pa.RecordBatch:
    """Rows (bucket, donor, id, text) but for the last, which is only the next of the one before."""
    texts = [r[3] for r in rows]
    at = [i for i, (a, b) in enumerate(zip(rows, rows[1:])) if not a[1] and a[0] == b[0]]
    edited = [texts[i][: len(texts[i]) - len(texts[i]) // 2] + texts[i + 1][: len(texts[i]) // 2] for i in at]
    own, new = prints(texts, known), prints(edited, known)
    here = np.array(at, np.int64)
    columns = [
        pa.array([rows[i][2] for i in at], pa.int64()), pa.array([len(texts[i]) for i in at], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited], pa.string()),
        pa.array(as_text(own[here]), pa.string()), pa.array(as_text(new), pa.string()),
        pa.array(likeness(own[here], new)), pa.array(likeness(own[here], own[here + 1]) if at else np.zeros(0)),
    ]
    return pa.RecordBatch.from_arrays(columns, ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
