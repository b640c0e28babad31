"""Token ids of documents in ascending id order, as files of entropy-coded blocks.

Documents are range-partitioned and sorted by id, tokenised once, and their ids and the
frequencies of all ids written to the shared folder; then every group of documents becomes
one token file. A token file is::

    magic, version, index of its first token in the corpus, sizes            (header)
    document ids, tokens of each document, first document and token of each block (zlib)
    the shared frequency table                                               (zlib)
    blocks as in :mod:`.rans`, each with checkpoints and a checksum

so any file, and any checkpoint of a block, can be decoded without another. Token files are
written and read through Spark, on any store that Spark knows: a Parquet table ``(start,
n_tokens, content)`` has one file's bytes in each row, and Spark's committer makes each task's
output appear whole or not at all.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import rans
from .store import release, scratch, written
from .textkit import binaries, hashes, pieces_of, same_bytes, slices, strings

MAGIC = b"QTOK1\0\0\0"
_HEAD = struct.Struct("<8sQQQIIII")
FILE_TOKENS = 2 << 20
BLOCK_TOKENS = 256 << 10
#: Bytes of text a partition where all cores have work, and at most (rows stream through Python
#: in slices, and the sort may spill).
PARTITION_BYTES, MOST_BYTES = 16 << 20, 256 << 20
#: Pieces that are remembered at most, and bytes of them.
CACHE_PIECES, CACHE_BYTES = 1_000_000, 32 << 20


#: Classes of bytes for :func:`pieces`.
_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_KIND = np.full(256, _ODD, np.uint8)
_KIND[[0x20, *range(0x09, 0x0E)]] = _SPACE
_KIND[0x21:0x7F] = _MARK
_KIND[0x30:0x3A] = _DIGIT
_KIND[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = _LETTER
_KIND[[0x27, 0x3C]] = _ODD


def pieces(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of the pieces of texts that the tokenizer treats one by one, and whether
    each is a run of letters.

    Texts are split at ASCII white space. A chunk of ASCII (without ' and <, which begin
    contractions and special tokens) and Latin-1 letters is split further, into runs of
    letters, single digits and runs of other characters. Any other chunk is one piece.
    """
    kind = _KIND[buf]
    lead = buf == 0xC3
    if lead.any():
        at = np.flatnonzero(lead[:-1])
        follow = buf[at + 1]
        at = at[(follow >= 0x80) & (follow != 0x97) & (follow != 0xB7)]
        kind[at] = kind[at + 1] = _LETTER
    n = len(kind)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    space = kind == _SPACE
    chunk = ~space
    chunk[1:] &= space[:-1] | edge[1:n]
    start = np.flatnonzero(chunk)
    odd = np.zeros(len(start) + 1, bool)
    odd[np.searchsorted(start, np.flatnonzero(kind == _ODD), side="right") - 1] = True
    number = np.cumsum(chunk) - 1
    split = np.zeros(n, bool)
    split[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
    begin = chunk | (split & ~space & ~odd[number])
    starts = np.flatnonzero(begin)
    if not len(starts):
        return starts, starts, np.zeros(0, bool)
    stop = np.zeros(n + 1, bool)
    stop[starts] = stop[n] = True
    stop[:n] |= space
    stop |= edge
    stops = np.flatnonzero(stop)
    ends = stops[np.searchsorted(stops, starts, side="right")]
    return starts, ends, (kind[starts] == _LETTER) & ~odd[number[starts]]


class Encoder:
    """Ids of whole texts by a library tokenizer whose pre-tokens follow :func:`pieces`.

    Each distinct piece goes through the library once, until CACHE_PIECES or CACHE_BYTES of them
    are known; then the memory is cleared. Runs of letters, lower-cased, skip the library's normalizer
    and its splitting, which leave them as they are.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.steps = (self.tokenizer.normalizer, self.tokenizer.pre_tokenizer)
        self.plain = (None, ByteLevel(add_prefix_space=False, use_regex=False))
        self._reset()

    def _batch(self, texts: list[str], letters: bool) -> list[list[int]]:
        """Ids of each text. One tokenizer serves both kinds, its steps are exchanged."""
        self.tokenizer.normalizer, self.tokenizer.pre_tokenizer = self.plain if letters else self.steps
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _reset(self) -> None:
        #: Sorted hashes of known pieces and their numbers; by number their bytes and ids.
        self.names, self.number = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.text, self.text_at = _Pool(np.uint8), _Pool(np.int64, 0)
        self.ids, self.ids_at = _Pool(np.uint32), _Pool(np.int64, 0)

    def _encoded(self, words: list[bytes], letters: np.ndarray) -> list[list[int]]:
        texts = [w.decode("utf-8", "replace") for w in words]
        ids: list[list[int]] = [[]] * len(texts)
        for kind in (True, False):
            which = np.flatnonzero(letters == kind).tolist()
            for k in range(0, len(which), 8192):
                part = which[k : k + 8192]
                for i, found in zip(part, self._batch([texts[i].lower() if kind else texts[i] for i in part], kind)):
                    ids[i] = found
        return ids

    def _find(self, names: np.ndarray, buf: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Numbers of these pieces, -1 where not known; bytes are compared."""
        out = np.full(len(names), -1)
        if not len(self.names):
            return out
        place = np.minimum(np.searchsorted(self.names, names), len(self.names) - 1)
        hit = np.flatnonzero(self.names[place] == names)
        number, size = self.number[place[hit]], np.diff(at)[hit]
        known = self.text_at.data[number]
        same = self.text_at.data[number + 1] - known == size
        hit, number, known, size = hit[same], number[same], known[same], size[same]
        right = same_bytes(buf, at[:-1][hit], self.text.data, known, size)
        out[hit[right]] = number[right]
        return out

    def _learn(self, names: np.ndarray, words: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Their new numbers. Of pieces with one hash only the first is found again later."""
        buf, at = pieces_of(words)
        ids = self._encoded(words.to_pylist(), letters)
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        number = np.arange(len(self.ids_at) - 1, len(self.ids_at) - 1 + len(ids))
        self.text_at.add(len(self.text) + at[1:] - at[0])
        self.text.add(buf[at[0] : at[-1]])
        self.ids_at.add(len(self.ids) + np.cumsum(size))
        self.ids.add(np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum())))
        fresh, first = np.unique(names, return_index=True)
        place = np.searchsorted(self.names, fresh)
        new = np.ones(len(fresh), bool)
        if len(self.names):
            new = self.names[np.minimum(place, len(self.names) - 1)] != fresh
        self.names, self.number = np.insert(self.names, place[new], fresh[new]), np.insert(self.number, place[new], number[first[new]])
        return number

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows, and how many each row has. Pieces are told apart by their bytes."""
        buf, offsets = strings(texts)
        starts, ends, letters = pieces(buf, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(texts), np.int64)
        coded = binaries(buf[_KIND[buf] != _SPACE], ends - starts).dictionary_encode()
        at, words = coded.indices.to_numpy(), coded.dictionary
        if len(self.ids_at) > CACHE_PIECES or len(self.text) > CACHE_BYTES:
            self._reset()
        data, places = pieces_of(words)
        names = hashes(data, places[:-1], places[1:])
        number = self._find(names, data, places)
        fresh = np.flatnonzero(number < 0)
        if len(fresh):
            first = np.empty(len(words), np.int64)
            first[at[::-1]] = np.arange(len(at))[::-1]
            number[fresh] = self._learn(names[fresh], words.take(pa.array(fresh)), letters[first[fresh]])
        place = number[at]
        start = self.ids_at.data[place]
        size = self.ids_at.data[place + 1] - start
        stops = np.cumsum(size)
        spots = np.arange(stops[-1]) + np.repeat(start - (stops - size), size)
        bounds = np.concatenate([[0], stops])[np.searchsorted(starts, offsets)]
        return self.ids.data[spots], np.diff(bounds)


class _Pool:
    """An array that grows at its end; ``data`` has room behind its ``len``."""

    def __init__(self, kind: type, *first: int):
        self.data, self.used = np.zeros(1 << 16, kind), len(first)
        self.data[: len(first)] = first

    def __len__(self) -> int:
        return self.used

    def add(self, more: np.ndarray) -> None:
        if self.used + len(more) > len(self.data):
            self.data = np.concatenate([self.data[: self.used], np.zeros(max(len(more), self.used), self.data.dtype)])
        self.data[self.used : self.used + len(more)] = more
        self.used += len(more)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def _tokenised(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, end_id: int) -> DataFrame:
    """``(part, seq, first, doc_ids, sizes, ids, n)``: groups of documents in order, and at
    the end of each partition a row with seq = -1 whose ``doc_ids`` and ``ids`` are the
    frequencies of its ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part = encoder(tokenizer), TaskContext.get().partitionId()
        counts = np.zeros(1 << 16, np.int64)
        held_docs, held_sizes, held_ids, held, seq, before = [], [], [], 0, 0, 0

        def row(seq: int, first: int, docs: bytes, sizes: bytes, ids: bytes, n: int) -> pa.RecordBatch:
            columns = [[part], [seq], [first], [docs], [sizes], [ids], [n]]
            types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["part", "seq", "first", "doc_ids", "sizes", "ids", "n"])

        def group() -> pa.RecordBatch:
            ids = np.concatenate(held_ids)
            return row(seq, before, np.concatenate(held_docs).astype("<i8").tobytes(), np.concatenate(held_sizes).astype("<u4").tobytes(), ids.astype("<u2" if ids.max() < 1 << 16 else "<u4").tobytes(), len(ids))

        for batch in slices(batches, "text", 2 << 20):
            ids, sizes = coder.encode(batch.column("text"))
            ends = np.cumsum(sizes)
            all_ids = np.insert(ids, ends, end_id)
            got = np.bincount(all_ids, minlength=len(counts))
            counts = got + np.pad(counts, (0, len(got) - len(counts)))
            held_docs.append(batch.column("id").to_numpy())
            held_sizes.append(sizes + 1)
            held_ids.append(all_ids)
            held += len(all_ids)
            if held >= FILE_TOKENS:
                yield group()
                seq, before = seq + 1, before + held
                held_docs, held_sizes, held_ids, held = [], [], [], 0
        if held:
            yield group()
        used = np.flatnonzero(counts)
        if len(used):
            yield row(-1, 0, used.astype("<i8").tobytes(), b"", counts[used].astype("<i8").tobytes(), before + held)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).where("id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = partitions(docs.sparkSession, total)
    ordered = rows.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    return ordered.mapInArrow(run, "part long, seq long, first long, doc_ids binary, sizes binary, ids binary, n long")


def partitions(spark: SparkSession, total: int) -> int:
    """Ranges for so many bytes of text: their number follows the cores, then the bytes."""
    return int(max(total // MOST_BYTES, min(total // PARTITION_BYTES, 4 * spark.sparkContext.defaultParallelism))) + 1


def _frequencies(groups: DataFrame) -> np.ndarray:
    """Counts by id over the corpus: as many rows as the vocabulary has come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, np.int64)
        for batch in batches:
            for ids, counts in zip(batch.column("doc_ids").to_pylist(), batch.column("ids").to_pylist()):
                at = np.frombuffer(ids, "<i8")
                total = np.pad(total, (0, max(0, int(at[-1]) + 1 - len(total))))
                total[at] += np.frombuffer(counts, "<i8")
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = groups.where("seq = -1").select("doc_ids", "ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(max((r["id"] for r in rows), default=0) + 1, np.int64)
    for r in rows:
        out[r["id"]] = r["n"]
    return out


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2) -> None:
    """Writes token files to ``path``: the ids of each text (null: none) and ``end_id`` after it.

    Rows with a null id are left out. Rows that share an id, equal ones too, follow one another
    in the order of their texts. An empty table writes a table without rows. Other columns are
    not read. ``path`` must be one that all executors share.
    """
    spark = docs.sparkSession
    groups = written(_tokenised(docs, id_col, text_col, tokenizer, end_id), "tokens")
    table = spark.sparkContext.broadcast(rans.Table(_frequencies(groups)).to_bytes())
    # One row for each partition: some 400,000 for 100 TB, so one task can add them up and their
    # sums, two numbers each, can be sent to all.
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = groups.where("seq = -1").select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, model = table.value, rans.Table.from_bytes(table.value)
        for batch in batches:
            for at in range(batch.num_rows):
                r = batch.slice(at, 1).to_pylist()[0]
                data = pack(r["doc_ids"], r["sizes"], r["ids"], r["start"], shared, model)
                yield pa.RecordBatch.from_arrays([pa.array([r["start"]]), pa.array([r["n"]]), pa.array([data], pa.binary())], ["start", "n_tokens", "content"])

    placed = groups.where("seq >= 0").join(F.broadcast(starts), "part").select((F.col("before") + F.col("first")).alias("start"), "n", "doc_ids", "sizes", "ids")
    files = placed.mapInArrow(run, "start long, n_tokens long, content binary")
    files.write.option("compression", "none").option("parquet.block.size", str(8 << 20)).parquet(path)
    release(groups)


def pack(doc_ids: bytes, sizes: bytes, raw: bytes, start: int, shared: bytes, model: rans.Table) -> bytes:
    ends = np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)
    ids = np.frombuffer(raw, "<u2" if len(raw) == 2 * ends[-1] else "<u4")
    cuts, at = [0], 0
    while at < len(ids):
        at = int(ends[min(np.searchsorted(ends, at + BLOCK_TOKENS), len(ends) - 1)])
        cuts.append(at)
    blocks = [rans.encode(ids[a:b], model) for a, b in zip(cuts, cuts[1:])]
    index = zlib.compress(doc_ids + sizes + np.array([len(b) for b in blocks], "<u4").tobytes())
    head = _HEAD.pack(MAGIC, start, len(ids), len(ends), len(blocks), len(index), len(shared), zlib.crc32(index + shared))
    return b"".join([head, index, shared, *blocks])


_models: dict[int, rans.Table] = {}


def _opened(data: bytes) -> tuple[int, np.ndarray, np.ndarray, list[bytes], rans.Table]:
    """Index of the first token, document ids, tokens of each document, the blocks and their table."""
    magic, start, n, docs, blocks, index_size, shared_size, crc = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token file")
    index, shared = data[_HEAD.size : (a := _HEAD.size + index_size)], data[a : a + shared_size]
    if zlib.crc32(index + shared) != crc:
        raise ValueError("header checksum does not match")
    if (crc_shared := zlib.crc32(shared)) not in _models:
        _models.clear()
        _models[crc_shared] = rans.Table.from_bytes(shared)
    index = zlib.decompress(index)
    doc_ids, sizes = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "<u4", docs, 8 * docs)
    if sizes.sum(dtype=np.int64) != n:
        raise ValueError("number of tokens does not match")
    cuts = a + shared_size + np.cumsum(np.append(0, np.frombuffer(index, "<u4", blocks, 12 * docs).astype(np.int64)))
    return start, doc_ids, sizes, [data[x:y] for x, y in zip(cuts.tolist(), cuts[1:].tolist())], _models[crc_shared]


def unpack(data: bytes) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Index of the first token, document ids, tokens of each document, and all ids."""
    start, doc_ids, sizes, blocks, model = _opened(data)
    ids = [rans.decode(block, model) for block in blocks]
    out = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    if len(out) != sizes.sum(dtype=np.int64):
        raise ValueError("number of tokens does not match")
    return start, doc_ids, sizes, out


def between(data: bytes, first: int, last: int) -> tuple[int, np.ndarray]:
    """Of a token file the ids of the corpus's tokens [first, last), and the index of the first of
    them: blocks outside are skipped, and decoding begins at the checkpoint before ``first``."""
    start, _, _, blocks, model = _opened(data)
    unit = rans.CHECKPOINT * rans.LANES
    at, begin, parts = start, max(first, start), []
    for block in blocks:
        n = rans.length(block)
        a, b = max(first - at, 0), min(last - at, n)
        if a < b:
            parts.append(rans.decode(block, model, a // unit, -(-b // unit))[a % unit : b - a // unit * unit])
        at += n
    return begin, np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def read_tokens(spark: SparkSession, path: str, each: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of every document in the files of ``path``; with
    ``each``, its value for a document's ids (``value``) in place of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                start, docs, sizes, ids = unpack(data.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                if each is not None:
                    values = pa.array([each(ids[e - s : e]) for s, e in zip(sizes.tolist(), ends.tolist())], pa.int64())
                else:
                    values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(start + ends - sizes), pa.array(sizes.astype(np.int64)), values], ["doc_id", "start", "n_tokens", last])

    last = "value" if each is not None else "ids"
    files = spark.read.schema(FILES).parquet(path).select("content")
    return files.mapInArrow(run, f"doc_id long, start long, n_tokens long, {last} {'long' if each is not None else 'array<int>'}")


FILES = "start long, n_tokens long, content binary"


def read_range(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """``(start, ids)``: the corpus's tokens [first, last), a row for each token file that holds
    some. Only those files are read, and of them only from the checkpoint before on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("content"):
                start, ids = between(data.as_py(), first, last)
                yield pa.RecordBatch.from_arrays([pa.array([start]), pa.array([ids.astype(np.int32)], pa.list_(pa.int32()))], ["start", "ids"])

    files = spark.read.schema(FILES).parquet(path).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    return files.select("content").mapInArrow(run, "start long, ids array<int>")


def crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def token_files(docs: DataFrame, tokenizer: str, **args) -> DataFrame:
    """Writes ``docs`` to a fresh shared folder and reads the files back."""
    path = scratch(docs.sparkSession, "qtok")
    write_tokens(docs, path, tokenizer, **args)
    return read_tokens(docs.sparkSession, path, each=crc32)
