"""Near-duplicate documents: MinHash signatures joined by a multi-index Hamming search.

A document's set is the distinct ``shingle``-word windows of its text. A signature has
``hashes`` symbols of 16 bits (b-bit MinHash); two sets of likeness J differ in a symbol
with probability (1 - J)(1 - 2^-16). Signatures are cut into ``chunks`` runs of symbols.
By the pigeonhole principle two signatures that differ in at most ``max_distance`` symbols
have a chunk with at most ``max_distance // chunks`` differences; all ways to blank so many
symbols of a chunk are enumerated as keys, so every such pair shares a key for certain.
Pairs are then confirmed on the full sets, whose shingles are compared word by word.

With 80 symbols, 16 chunks and a distance of 31 a pair at J = 0.8 exactly lies beyond the
distance with a probability near 2e-5 (binomial with mean 16 and deviation 3.6), and less
above.

Buckets (keys with their members) may be large. A bucket of two is one candidate pair.
A larger one is first tied to one leader, the member that meets most others over all
buckets; what is then in one component needs no more pairs. All pairs of a bucket that
still lie in different components are compared block against block; no row is made for a
pair unless it is linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .store import release, written
from .textkit import SPACED, Words, mix, shingle_hashes, shingle_sets, slices, window_numbers


@dataclass(frozen=True)
class Params:
    shingle: int = 5
    #: Likeness of at least num / den.
    num: int = 4
    den: int = 5
    hashes: int = 80
    chunks: int = 16
    max_distance: int = 31
    seed: int = 20_240_601


def _symbols(own: np.ndarray, xor: np.ndarray, mul: np.ndarray) -> np.ndarray:
    x = (own >> np.uint64(32)).astype(np.uint32)
    best = np.full(len(xor), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 1024):
        y = x[None, i : i + 1024] ^ xor[:, None]
        y *= mul[:, None]
        y ^= y >> np.uint32(15)
        y *= np.uint32(0x2C1B3C6D)
        np.minimum(best, y.min(axis=1), out=best)
    best ^= best >> np.uint32(12)
    best *= np.uint32(0x297A2D39)
    return (best >> np.uint32(16)).astype(np.uint16)


def _family(p: Params) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(p.seed)
    return rng.integers(0, 1 << 32, p.hashes, np.uint32), rng.integers(0, 1 << 31, p.hashes, np.uint32) * np.uint32(2) + np.uint32(1)


def signatures(docs: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """``(id, n_shingles, digest, sig)`` of each row. digest names the sequence of words (128
    bits), null without words; sig is the set's signature, two bytes a symbol."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xor, mul = _family(p)
        for batch in slices(batches, "text"):
            words = Words(batch.column("text"), SPACED)
            sig = [_symbols(own, xor, mul).tobytes() if len(own) else None for own in shingle_hashes(words, p.shingle)]
            size = [len(own) for own in shingle_sets(words, p.shingle)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(size, pa.int64()), pa.array(words.digests(), pa.binary()), pa.array(sig, pa.binary())],
                ["id", "n_shingles", "digest", "sig"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, n_shingles long, digest binary, sig binary")


def _matrix(column: pa.Array, p: Params) -> np.ndarray:
    data = b"".join(column.to_pylist())
    return np.frombuffer(data, np.uint16).reshape(-1, p.hashes)


def keys(sets: DataFrame, p: Params) -> DataFrame:
    """``(key, sid)``: for each chunk of each signature, one key for each choice of symbols
    that may differ in it."""
    edges = np.linspace(0, p.hashes, p.chunks + 1).astype(int)
    blanks = p.max_distance // p.chunks
    plan = [(a, b, c) for a, b in zip(edges, edges[1:]) for c in combinations(range(a, b), blanks)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                batch = whole.slice(at, 4096)
                terms = mix(_matrix(batch.column("sig"), p).astype(np.uint64) + (np.arange(p.hashes, dtype=np.uint64) << np.uint64(20)))
                out = np.empty((batch.num_rows, len(plan)), np.uint64)
                for k, (a, b, blank) in enumerate(plan):
                    out[:, k] = mix(terms[:, a:b].sum(axis=1) - terms[:, list(blank)].sum(axis=1) + np.uint64(k))
                sid = np.repeat(batch.column("sid").to_numpy(), len(plan))
                yield pa.RecordBatch.from_arrays([pa.array(out.ravel().view(np.int64)), pa.array(sid)], ["key", "sid"])

    return sets.select("sid", "sig").mapInArrow(run, "key long, sid long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _close(pairs: DataFrame, sets: DataFrame, p: Params) -> DataFrame:
    """Pairs whose set sizes and signature distance allow a link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                far = (_matrix(batch.column("sig_a"), p) != _matrix(batch.column("sig_b"), p)).sum(axis=1)
                yield batch.select(["a", "b"]).filter(pa.array(far <= p.max_distance))

    side = lambda s: sets.select(F.col("sid").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("sig").alias(f"sig_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = both.where(f"{p.den} * least(n_a, n_b) >= {p.num} * greatest(n_a, n_b)")
    return fits.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, p: Params) -> DataFrame:
    """Pairs linked by the likeness of their full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(slices(batches, "text_a"), "text_b"):
            both = shingle_sets(Words(pa.chunked_array([batch.column("text_a"), batch.column("text_b")]), SPACED), p.shingle)
            left, right = both[: batch.num_rows], both[batch.num_rows :]
            keep = []
            for x, y in zip(left, right):
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(p.den * shared >= p.num * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: texts.select(F.col("sid").alias(s), F.col("text").alias(f"text_{s}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", params: Params = Params()) -> DataFrame:
    """Classes of near-duplicate documents: ``(id_col, n_shingles, component_id, kept)``, one
    row for each row of ``docs``.

    A null or empty text (or one without words) has an empty set and is linked with nothing;
    a row with a null id is linked with nothing and has a null component_id and kept = true.
    Rows that share an id are one node: it has the links of all its texts. component_id is
    the least id that links reach, kept marks the row(s) with that id. Other columns of
    ``docs`` are not read, whatever their names.
    """
    p = params
    rows = written(signatures(docs, id_col, text_col, p), "nd-rows")
    once = rows.where("id is not null and digest is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig"))
    # sid numbers the distinct texts; it holds from here on, as the table is stored.
    sets = written(once.withColumn("sid", F.monotonically_increasing_id()), "nd-sets")

    buckets = written(keys(sets, p).groupBy("key").agg(F.count("*").alias("c"), F.min("sid").alias("x"), F.max("sid").alias("y")).where("c > 1"), "nd-buckets")
    large = keys(sets, p).join(buckets.where("c > 2").select("key", "c"), "key")
    members = written(large, "nd-members")
    weight = members.groupBy("sid").agg(F.sum("c").alias("w"))
    leaders = members.join(weight, "sid").groupBy("key").agg(F.max(F.struct("w", "sid")).alias("top")).select("key", F.col("top.sid").alias("y"))
    pairs = _ordered(buckets.where("c = 2").select("x", "y").unionByName(members.join(leaders, "key").select(F.col("sid").alias("x"), "y")))

    close = written(_close(pairs, sets, p), "nd-close")
    need = close.select(F.explode(F.array("a", "b")).alias("sid")).unionByName(members.select("sid")).distinct()
    texts = written(_texts(need, docs, sets, id_col, text_col, p), "nd-texts")
    links = written(_confirmed(close, texts, p), "nd-links")
    shared = _shared_ids(rows, sets)
    release(buckets)

    labels = components(links.unionByName(shared))
    at = members.join(labels, F.col("sid") == F.col("node"), "left").select("key", "sid", "c", F.coalesce("label", "sid").alias("label"))
    apart = written(at.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.max("c").alias("c")).where("lo < hi").select("key", "c"), "nd-apart")
    few, work = apart.agg(F.count("*"), F.sum(F.col("c").cast("double") * F.col("c"))).first()
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), int((work or 0) // PAIRS))
    open_ = apart.select("key")
    tasks = written(_open_pairs(at.join(F.broadcast(open_) if few <= BROADCAST_KEYS else open_, "key"), sets, p, parts), "nd-tasks")
    more = written(_confirmed_tasks(tasks, texts, p, parts), "nd-links")
    if not more.isEmpty():
        labels = components(links.unionByName(more).unionByName(shared))
    release(members, apart, tasks, texts, close)

    named = sets.select("digest", "sid", "id").join(labels, F.col("sid") == F.col("node"), "left").select("digest", "id", F.coalesce("label", "sid").alias("label"))
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "label").select("digest", "component_id")
    out = rows.select("id", "n_shingles", "digest").join(classes, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(
        F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept")
    )


def _shared_ids(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges between texts of rows that share an id."""
    own = rows.where("id is not null and digest is not null").select("id", "digest")
    several = own.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id", "lo")
    pairs = own.join(several, "id").where("digest <> lo").select("digest", "lo").distinct()
    number = lambda name, out: sets.select(F.col("digest").alias(name), F.col("sid").alias(out))
    return pairs.join(number("digest", "a"), "digest").join(number("lo", "b"), "lo").select("a", "b")


def _texts(need: DataFrame, docs: DataFrame, sets: DataFrame, id_col: str, text_col: str, p: Params) -> DataFrame:
    """``(sid, text)`` of the sets in ``need``; of a repeated id the rows with that text."""
    need = need.join(sets.select("sid", "id", "digest"), "sid")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            found = Words(batch.column("text"), SPACED, hashed=False).digests()
            same = pa.array([x == y for x, y in zip(found, batch.column("digest").to_pylist())], pa.bool_())
            yield batch.select(["sid", "text"]).filter(same)

    return rows.join(need, "id").select("sid", "text", "digest").mapInArrow(own, "sid long, text string").dropDuplicates(["sid"])


#: Members of a bucket that are compared in one step, on average.
BLOCK = 2048
#: Pairs that a task compares, on average: tasks follow the work, which bytes don't tell.
PAIRS = 100_000_000
#: Keys of eight bytes up to this many are sent to all tasks; they are counted first.
BROADCAST_KEYS = 200_000


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """The rows of each value of ``column`` (the input is sorted by it), one run at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(column).to_numpy()
        cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        for a, b in zip(cuts, cuts[1:]):
            if held and held[0].column(column)[0].as_py() != ids[a]:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _open_pairs(rest: DataFrame, sets: DataFrame, p: Params, parts: int) -> DataFrame:
    """Pairs that a key holds, lie in different components and may be linked: ``(task, sids,
    pairs)``, a row for each block of a bucket against another. A bucket of c members is dealt
    to c / BLOCK blocks by hash, and each two of them meet once. A pair that shares several
    keys is listed under the first of them only."""
    edges = np.linspace(0, p.hashes, p.chunks + 1).astype(int)
    blanks = p.max_distance // p.chunks
    plan = [(a, b, c) for a, b in zip(edges, edges[1:]) for c in combinations(range(a, b), blanks)]
    salts = np.arange(p.hashes, dtype=np.uint64) << np.uint64(20)

    def first_shared(x: np.ndarray, y: np.ndarray, key: int) -> np.ndarray:
        """Whether ``key`` is the first key that the signatures share, row by row."""
        differ = x != y
        inside = [differ[:, a:b].sum(axis=1) for a, b in zip(edges, edges[1:])]
        open_, own = np.ones(len(x), bool), np.zeros(len(x), bool)
        for k, (a, b, blank) in enumerate(plan):
            shares = open_ & (inside[int(np.searchsorted(edges, a, side="right")) - 1] - differ[:, list(blank)].sum(axis=1) == 0)
            if shares.any():
                at = np.flatnonzero(shares)
                terms = mix(x[at, a:b].astype(np.uint64) + salts[a:b])
                skip = mix(x[at][:, list(blank)].astype(np.uint64) + salts[list(blank)]).sum(axis=1)
                own[at] = mix(terms.sum(axis=1) - skip + np.uint64(k)).view(np.int64) == key
                open_[at] = False
        return own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "task"):
            sig, label, n, block, sid = (_matrix(rows.column("sig").combine_chunks(), p), *(rows.column(c).to_numpy() for c in ("label", "n", "block", "sid")))
            key, low = rows.column("key")[0].as_py(), rows.column("low")[0].as_py()
            left = np.flatnonzero(block == low)
            right = np.flatnonzero(block != low) if (block != low).any() or rows.column("high")[0].as_py() != low else left
            found_a, found_b = [], []
            for i in left.tolist():
                j = right[(label[right] != label[i]) & ((sid[right] > sid[i]) | (block[right] != low))]
                j = j[p.den * np.minimum(n[i], n[j]) >= p.num * np.maximum(n[i], n[j])]
                if len(j):
                    j = j[(sig[j] != sig[i]).sum(axis=1) <= p.max_distance]
                if len(j):
                    found_a.append(np.full(len(j), i))
                    found_b.append(j)
            if found_a:
                every_a, every_b = np.concatenate(found_a), np.concatenate(found_b)
                first = np.concatenate([first_shared(sig[every_a[k : k + 8192]], sig[every_b[k : k + 8192]], key) for k in range(0, len(every_a), 8192)])
                found_a, found_b = [every_a[first]], [every_b[first]]
            if found_a and sum(map(len, found_a)):
                both = np.concatenate([*found_a, *found_b])
                used, at = np.unique(both, return_inverse=True)
                yield pa.RecordBatch.from_arrays(
                    [rows.column("task").slice(0, 1).combine_chunks(), pa.array([sid[used].tolist()], pa.list_(pa.int64())), pa.array([at.astype(np.int32).tobytes()], pa.binary())],
                    ["task", "sids", "pairs"],
                )

    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    dealt = rest.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    dealt = dealt.withColumn("task", F.xxhash64("key", "low", "high"))
    dealt = dealt.join(sets.select("sid", F.col("n_shingles").alias("n"), "sig"), "sid")
    by_task = dealt.select("task", "key", "low", "high", "block", "sid", "label", "n", "sig").repartition(parts, "task").sortWithinPartitions("task")
    return by_task.mapInArrow(run, "task long, sids array<long>, pairs binary")


def _confirmed_tasks(tasks: DataFrame, texts: DataFrame, p: Params, parts: int) -> DataFrame:
    """Links among the pairs of ``tasks``; each text is read once for each task it is in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _runs(batches, "task"):
            texts_at = rows.filter(rows.column("pairs").is_null())
            sets = dict(zip(texts_at.column("sid").to_pylist(), _task_sets(texts_at, p.shingle)))
            links_a, links_b = [], []
            for row in rows.filter(rows.column("pairs").is_valid()).select(["sids", "pairs"]).to_pylist():
                at = np.frombuffer(row["pairs"], np.int32)
                left, right = at[: len(at) // 2], at[len(at) // 2 :]
                own = [sets[s] for s in row["sids"]]
                size = np.array([len(x) for x in own])
                shared = _shared(own, left, right)
                linked = p.den * shared >= p.num * (size[left] + size[right] - shared)
                names = np.array(row["sids"])
                links_a.append(names[left[linked]])
                links_b.append(names[right[linked]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(links_a)), pa.array(np.concatenate(links_b))], ["a", "b"])

    wanted = tasks.select("task", F.explode("sids").alias("sid")).join(texts, "sid").select("task", "sid", "text", F.lit(None).cast("binary").alias("pairs"), F.lit(None).cast("array<long>").alias("sids"))
    lists = tasks.select("task", F.lit(None).cast("long").alias("sid"), F.lit(None).cast("string").alias("text"), "pairs", "sids")
    return wanted.unionByName(lists).repartition(parts, "task").sortWithinPartitions("task").mapInArrow(run, "a long, b long")


def _task_sets(texts: pa.Table, n: int) -> list[np.ndarray]:
    """The rows' sets, comparable over all slices of the rows."""
    parts, bounds = [], [np.zeros(1, np.int64)]
    for part in slices(iter(texts.to_batches()), "text"):
        words = Words(part.column("text"), SPACED, hashed=False)
        parts.append(words.encoded())
        bounds.append(bounds[-1][-1] + words.first[1:])
    coded = pa.chunked_array(parts).unify_dictionaries()
    code = np.concatenate([c.indices.to_numpy() for c in coded.chunks])
    key, cuts = window_numbers(code, np.concatenate(bounds), n, len(coded.chunk(0).dictionary))
    return [np.unique(key[a:b]) for a, b in zip(cuts.tolist(), cuts[1:].tolist())]


def _shared(own: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of own[left] and own[right]; work by ranges of hashes keeps
    the incidence matrix small however long the sets are."""
    values = np.concatenate(own)
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    names, column, count = np.unique(values, return_inverse=True, return_counts=True)
    dense = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    row, column = row[keep], dense[column[keep]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(own), len(own)), np.float32)
    step = max(1, (16 << 20) // max(len(own), 1) // 4)
    for a in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        i, j = np.searchsorted(column, [a, a + step])
        m = np.zeros((len(own), min(step, int(column[-1]) + 1 - a)), np.float32)
        m[row[i:j], column[i:j] - a] = 1
        out += m @ m.T
    return np.rint(out[left, right]).astype(np.int64)
