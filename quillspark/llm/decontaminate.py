"""Benchmark decontamination: windows of benchmark words looked up in training texts.

Words are runs of ASCII digits, letters (A-Z lower-cased) and non-ASCII characters. A window
is ``n`` consecutive words of an item; an item of fewer, but not none, is one window. The
windows' hashes go to every task as one broadcast set; a hash found in a text is verified
word by word. Benchmarks of more than ``SHARD_BYTES`` of text (repeated items count once) are
taken in shards of that size, one broadcast and one pass after another. A shard takes about
four times its text in memory, so what is sent out stays bounded.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import _Q, ALNUM, Words, mix, powers, slices, windows

SHARD_BYTES = 16 << 20
FRESH = ("bench_words", "bench_hits", "bench_items", "bench_spans")


class WindowSet:
    """Windows of benchmark items as sorted arrays: the hash of each, and where its first word
    begins in the items' words, which stand in one buffer with a blank after each."""

    def __init__(self, items: list[tuple[str, str]], n: int):
        words = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        self.items = [item for item, _ in items]
        self.text, place = words.joined()
        self.first = words.first
        self.place = place.astype(np.uint32 if len(self.text) < 1 << 32 else np.int64)
        counts = np.diff(words.first)
        row = np.repeat(np.arange(len(items)), counts)
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for size in np.unique(np.minimum(counts[counts > 0], n)).tolist():
            every = windows(words.hash, size)
            own = row[: len(every)]
            right = np.flatnonzero((row[size - 1 :] == own) & (np.minimum(counts[own], n) == size)).astype(np.uint32)
            order = np.argsort(every[right], kind="stable")
            known = every[right][order]
            coarse = np.zeros(1 << 20, bool)
            coarse[known >> np.uint64(44)] = True
            self.lengths[size] = known, right[order], coarse

    def words(self, i: int, size: int) -> bytes:
        return self.text[self.place[i] : int(self.place[i + size]) - 1].tobytes()

    def scan(self, words: Words) -> Iterator[tuple[int, int, int, set[str]]]:
        """Verified occurrences: row, first word, number of words, items."""
        total = len(words.hash)
        last = np.repeat(words.first[1:], np.diff(words.first))
        running = np.zeros(total, np.uint64)
        most = max(self.lengths, default=0)
        text, place = words.joined() if most else (words.buf, words.first)
        told: dict[tuple[int, bytes], set[str]] = {}
        for k, p in enumerate(powers(_Q, most + 1)[:most]):
            running[: max(total - k, 0)] += words.hash[k:] * p
            size = k + 1
            if size not in self.lengths or total < size:
                continue
            known, window, coarse = self.lengths[size]
            own = mix(running[: total - k] + np.uint64(size))
            maybe = np.flatnonzero(coarse[own >> np.uint64(44)])
            maybe = maybe[maybe + size <= last[maybe]]
            low = np.searchsorted(known, own[maybe])
            there = known[np.minimum(low, len(known) - 1)] == own[maybe]
            hits, low = maybe[there], low[there]
            high = np.searchsorted(known, own[hits], side="right")
            rows = np.searchsorted(words.first, hits, side="right") - 1
            for i, row, a, b in zip(hits.tolist(), rows.tolist(), low.tolist(), high.tolist()):
                found = text[place[i] : place[i + size] - 1].tobytes()
                owners = told.get((a, found))
                if owners is None:
                    same = [j for j in window[a:b].tolist() if self.words(j, size) == found]
                    owners = told[a, found] = {self.items[j] for j in (np.searchsorted(self.first, same, side="right") - 1).tolist()}
                if owners:
                    yield row, i, size, owners


def _shards(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[str, str]]]:
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).where("item is not null and text is not null").distinct()
    size = rows.agg(F.sum(F.octet_length("text") + F.octet_length("item"))).first()[0] or 0
    shards = size // SHARD_BYTES + 1
    for k in range(shards):
        part = rows if shards == 1 else rows.where(F.pmod(F.xxhash64("item", "text"), F.lit(shards)) == k)
        yield [tuple(r) for r in part.collect()]


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", bench_text: str = "text", n: int = 13) -> DataFrame:
    """``docs`` with ``bench_words`` (long), ``bench_hits`` (long: words inside an occurrence),
    ``bench_items`` (sorted array of item ids as strings) and ``bench_spans`` (array of
    struct(start, end): byte ranges of the UTF-8 text, disjoint, ascending).

    Null texts have no words. Benchmark rows with a null id or text, or without words, have
    no windows; an empty benchmark hits nothing. Columns of ``docs`` with these four names
    are replaced, all others are kept. Repeated rows are rows like any others; a repeated
    benchmark row counts once, and items with equal texts are all named.
    """
    out = docs.drop(*FRESH)
    first = True
    for items in _shards(benchmark, item_col, bench_text):
        sent = docs.sparkSession.sparkContext.broadcast(WindowSet(items, n))
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name not in FRESH)
        schema = f"{fields}, bench_words bigint, bench_hits bigint, bench_items array<string>, bench_spans array<struct<start:bigint,end:bigint>>"
        out = out.mapInArrow(_pass(sent, text_col, first), schema)
        first = False
    return out


def _pass(sent, text_col: str, first: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sent.value
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches, text_col):
            words = Words(batch.column(text_col), ALNUM)
            items = [set() for _ in range(batch.num_rows)]
            hit = np.zeros(len(words.start) + 1, np.int64)
            if not first:
                for row, (old_items, old_spans) in enumerate(zip(batch.column("bench_items").to_pylist(), batch.column("bench_spans").to_pylist())):
                    items[row].update(old_items)
                    for span in old_spans:
                        a, b = np.searchsorted(words.start, [span["start"] + words.offsets[row], span["end"] + words.offsets[row]])
                        hit[a] += 1
                        hit[b] -= 1
            for row, i, size, owners in found.scan(words):
                items[row] |= owners
                hit[i] += 1
                hit[i + size] -= 1
            inside = np.cumsum(hit[:-1]) > 0
            counts = np.diff(np.concatenate([[0], np.cumsum(inside)])[words.first])
            spans = [_spans(words, row, inside) if counts[row] else [] for row in range(batch.num_rows)]
            kept = [name for name in batch.schema.names if name not in FRESH]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in kept), pa.array(np.diff(words.first)), pa.array(counts), pa.array([sorted(x) for x in items], pa.list_(pa.string())), pa.array(spans, spans_type)],
                [*kept, *FRESH],
            )

    return run


def _spans(words: Words, row: int, inside: np.ndarray) -> list[dict[str, int]]:
    a, b = words.first[row], words.first[row + 1]
    own = np.concatenate([[False], inside[a:b], [False]])
    edges = np.flatnonzero(own[1:] != own[:-1]) + a
    base = words.offsets[row]
    return [{"start": int(words.start[i] - base), "end": int(words.end[j - 1] - base)} for i, j in zip(edges[::2], edges[1::2])]


#: A document goes where hit words are at least 1 / this of its words.
SHARE = 20


def decontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", remove: str = "documents", share: int = SHARE, **args) -> DataFrame:
    """``docs`` without what it shares with the benchmark, columns as they are, whatever their names.

    ``remove="documents"`` drops rows where ``share * hits`` is ``words`` or more; ``"spans"`` cuts
    the hit spans out of all texts; ``"both"`` drops those rows and cuts the spans of the others.
    Rows without hits (null and empty texts among them) are untouched; n_chars, if there,
    follows a cut text.
    """
    if remove not in ("documents", "spans", "both"):
        raise ValueError(f"remove is 'documents', 'spans' or 'both', not {remove!r}")
    own = [f"own_{k}" for k in range(len(docs.columns))]
    text = own[docs.columns.index(text_col)]
    found = scan(docs.toDF(*own), benchmark, text, **args)
    if remove != "spans":
        found = found.where(~((F.col("bench_hits") > 0) & (share * F.col("bench_hits") >= F.col("bench_words"))))
    changed = {}
    if remove != "documents":
        bytes_ = F.encode(text, "utf-8")
        starts = F.concat(F.array(F.lit(0).cast("long")), F.col("bench_spans.end"))
        ends = F.concat(F.col("bench_spans.start"), F.array(F.octet_length(text).cast("long")))
        pieces = F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda x: F.decode(bytes_.substr((x["a"] + 1).cast("int"), (x["b"] - x["a"]).cast("int")), "utf-8"))
        cut, hit = F.array_join(pieces, ""), F.size("bench_spans") > 0
        changed[text_col] = F.when(hit, cut).otherwise(F.col(text))
        if "n_chars" in docs.columns:
            old = own[docs.columns.index("n_chars")]
            changed["n_chars"] = F.when(hit, F.char_length(cut).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(old))
    return found.select(*(changed.get(name, F.col(o)).alias(name) for name, o in zip(docs.columns, own)))
