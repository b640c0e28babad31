"""A stored index: records, links and the covering table that queries read.

On disk each build has a folder of its own; ``manifest.json`` names the current one, is
written last and put in place by a rename, so readers see a whole build or the one before.
Older builds than these two are removed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..adapters import geo
from ..functions.order import to_unsigned
from ..operators import links as L
from ..operators import suggest as S
from ..schema import DEFAULT_LIMIT, LINK, RECORD, IndexFormatError

VERSION = 2


class SuggestIndex:
    """``records(record_id, group, rank, payload, ...)`` and distinct ``links(key, record_id)``.
    Further columns of records are kept beside the payload and may be asked for."""

    def __init__(self, records: DataFrame, links: DataFrame, covering: DataFrame | None = None, keys: DataFrame | None = None, counts: dict | None = None, build_id: str | None = None):
        self.records, self.links = records, links
        self.extra = [c for c in records.columns if c not in RECORD.names]
        self.covering = covering if covering is not None else links.join(records, "record_id")
        #: ``(ordinal, key, n)`` of a stored index: keys in order and their numbers of links.
        self.keys = keys
        self._counts, self.build_id = counts, build_id

    @classmethod
    def from_frames(cls, records: DataFrame, links: DataFrame, validate: bool = True) -> SuggestIndex:
        """Keys are taken as they are; links are made distinct. A link to a record that does not
        exist raises IndexFormatError (with ``validate`` off queries hide it and write() raises)."""
        if validate and not L.dangling(links, records).isEmpty():
            raise IndexFormatError("a link names a record that does not exist")
        return cls(records, L.distinct_links(links))

    @classmethod
    def empty(cls, spark: SparkSession) -> SuggestIndex:
        return cls(spark.createDataFrame([], RECORD), spark.createDataFrame([], LINK))

    @property
    def spark(self) -> SparkSession:
        return self.records.sparkSession

    def write(self, path: str) -> dict:
        """Stores the index and returns its manifest. The covering table and the links are
        range-partitioned and sorted by key: a prefix touches few files and row groups. Records,
        links and the covering table are each computed once and read back for the next step, as
        dealing out by range reads its input twice."""
        build = uuid.uuid4().hex
        top = path.rstrip("/")
        base = f"{top}/{build}"
        read = self.spark.read
        self.records.write.parquet(f"{base}/records")
        self.links.write.parquet(f"{base}/stage-links")
        records, links = read.parquet(f"{base}/records"), read.parquet(f"{base}/stage-links")
        links.repartitionByRange("key").sortWithinPartitions("key", "record_id").write.parquet(f"{base}/links")
        links.join(records, "record_id").write.parquet(f"{base}/stage-covering")
        read.parquet(f"{base}/stage-covering").repartitionByRange("key").sortWithinPartitions("key").write.parquet(f"{base}/covering")
        _number_keys(read.parquet(f"{base}/links")).write.parquet(f"{base}/keys")
        _delete(self.spark, f"{base}/stage-links", f"{base}/stage-covering")
        stored = _load(self.spark, base)
        manifest = {"version": VERSION, "build": build, **_sizes(stored)}
        if manifest["covering"] != manifest["links"]:
            _delete(self.spark, base)
            raise IndexFormatError("a link names a record that does not exist, or a record id is not unique")
        before = _manifest(self.spark, top)
        _put(self.spark, f"{top}/manifest.json", json.dumps(manifest))
        _keep(self.spark, top, {build, before and before.get("build")})
        return manifest

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> SuggestIndex:
        """Opens the current build; IndexFormatError if it is missing or not whole: the numbers of
        records, links, keys and covering rows are held against the manifest."""
        manifest = _manifest(spark, path.rstrip("/"))
        if not manifest or "build" not in manifest:
            raise IndexFormatError(f"no index at {path}")
        if manifest.get("version") != VERSION:
            raise IndexFormatError(f"format version {manifest.get('version')}, expected {VERSION}")
        try:
            out = _load(spark, f"{path.rstrip('/')}/{manifest['build']}")
            found = _sizes(out)
        except Exception as error:
            raise IndexFormatError(f"no whole index at {path}: {error}") from error
        for name, n in found.items():
            if n != manifest.get(name):
                raise IndexFormatError(f"{n} {name}, {manifest.get(name)} in the manifest")
        out._counts = {k: manifest[k] for k in ("records", "links", "keys")}
        out.build_id = manifest["build"]
        return out

    def counts(self) -> dict:
        """Numbers of records, distinct links and keys."""
        if self._counts is None:
            n = self.links.agg(F.count("*"), F.count_distinct("key")).first()
            self._counts = {"records": self.records.count(), "links": n[0], "keys": n[1]}
        return self._counts

    def __len__(self) -> int:
        """Records, those without any key included."""
        return self.counts()["records"]

    @property
    def is_empty(self) -> bool:
        return len(self) == 0

    def record(self, record_id: int):
        found = self.records.where(F.col("record_id") == record_id).head(1)
        if not found:
            raise IndexFormatError(f"no record {record_id}")
        return found[0]

    def posting(self, ordinal: int) -> list[int]:
        """Sorted ids of the key at this place in the order of keys. A stored index looks the key
        up by its number."""
        if self.keys is not None:
            found = self.keys.where(F.col("ordinal") == ordinal).head(1)
            key = found[0]["key"] if found else None
        else:
            key = L.key_at(self.links.select("key").distinct(), ordinal) if ordinal >= 0 else None
        if key is None:
            raise IndexFormatError(f"no posting {ordinal}")
        return sorted(r[0] for r in self.links.where(F.col("key") == key).select("record_id").collect())

    def suggest(self, prefix: str, limit: int = DEFAULT_LIMIT, max_edits: int = 0, extra: Sequence[str] = ()) -> DataFrame:
        return S.suggest(self.covering, prefix, limit, max_edits, extra)

    def suggest_rows(self, prefix: str, limit: int = DEFAULT_LIMIT, max_edits: int = 0) -> list[tuple[int, int, bytes]]:
        """(rank, group, payload) tuples; group as an unsigned number."""
        return [(r["rank"], to_unsigned(r["group"]), bytes(r["payload"])) for r in self.suggest(prefix, limit, max_edits).collect()]

    def suggest_batch(self, queries: DataFrame, query_col: str = "prefix", limit: int = DEFAULT_LIMIT, max_edits: int = 0, extra: Sequence[str] = ()) -> DataFrame:
        return S.suggest_batch(self.covering, queries, query_col, limit, max_edits, extra)

    def suggest_geo(self, prefix: str, limit: int = DEFAULT_LIMIT, max_edits: int = 0) -> DataFrame:
        """Places (gid, name, lat, lon, country, population, feature_code), best first."""
        typed = geo.TYPED if set(geo.TYPED) <= set(self.extra) else ()
        return geo.places(self.suggest(prefix, limit, max_edits, typed))


def _load(spark: SparkSession, base: str) -> SuggestIndex:
    return SuggestIndex(*(spark.read.parquet(f"{base}/{name}") for name in ("records", "links", "covering", "keys")))


def _sizes(index: SuggestIndex) -> dict:
    """Rows of the stored tables, by their file footers."""
    return {name: getattr(index, name).count() for name in ("records", "links", "keys", "covering")}


def _number_keys(links: DataFrame) -> DataFrame:
    """``(ordinal, key, n)`` of links stored by ranges of keys: keys are numbered within their file,
    which is one of many like parts, and shifted by the keys of the files before."""
    keys = links.groupBy(F.col("_metadata.file_name").alias("file"), "key").agg(F.count("*").alias("n"))
    files = keys.groupBy("file").agg(F.min("key").alias("least"), F.count("*").alias("size"))
    before = W.orderBy("least").rowsBetween(W.unboundedPreceding, -1)
    shifts = files.select("file", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("shift"))
    inside = F.row_number().over(W.partitionBy("file").orderBy("key")) - 1
    return keys.withColumn("inside", inside).join(shifts, "file").select((F.col("shift") + F.col("inside")).cast("long").alias("ordinal"), "key", "n").sortWithinPartitions("ordinal")


def _files(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def _manifest(spark: SparkSession, top: str) -> dict | None:
    files, target = _files(spark, f"{top}/manifest.json")
    if not files.exists(target):
        return None
    text = spark.read.text(f"{top}/manifest.json", wholetext=True).first()[0]
    try:
        found = json.loads(text)
    except ValueError as error:
        raise IndexFormatError(f"the manifest at {top} cannot be read: {error}") from error
    return found if isinstance(found, dict) else {}


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Writes a file aside and renames it over the one of that name."""
    aside = f"{path}.{uuid.uuid4().hex}"
    files, source = _files(spark, aside)
    out = files.create(source, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()
    hadoop = spark._jvm.org.apache.hadoop.fs
    how = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
    how[0] = hadoop.Options.Rename.OVERWRITE
    target = files.makeQualified(hadoop.Path(path))
    hadoop.FileContext.getFileContext(target.toUri(), spark._jsc.hadoopConfiguration()).rename(files.makeQualified(source), target, how)


def _delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        files, target = _files(spark, path)
        files.delete(target, True)


def _keep(spark: SparkSession, top: str, builds: set) -> None:
    """Removes builds but these."""
    files, target = _files(spark, top)
    for status in files.listStatus(target):
        name = status.getPath().getName()
        if status.isDirectory() and len(name) == 32 and name not in builds:
            files.delete(status.getPath(), True)


class IndexBuilder:
    """Collects records and links in any number of frames or single rows, then builds."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self._rows: list[tuple[int, int, int, bytes]] = []
        self._links: list[tuple[str, int]] = []

    def add_record(self, group: int, rank: int, payload: bytes) -> int:
        """Adds a record (unsigned group) and returns its id; ids count from 0."""
        from ..functions.order import to_signed

        self._rows.append((len(self._rows), to_signed(group), rank, bytes(payload)))
        return len(self._rows) - 1

    def add_key(self, key: str, record_id: int) -> None:
        """Links a key, which is not folded, to a record, which is not looked up before build()."""
        self._links.append((key, record_id))

    def build(self) -> SuggestIndex:
        return SuggestIndex.from_frames(self.spark.createDataFrame(self._rows, RECORD), self.spark.createDataFrame(self._links, LINK))


def build_places(spark: SparkSession, source: str, target: str) -> dict:
    """Reads places from ``source`` and stores their index at ``target``. Returns the manifest, with
    the number of links before duplicates were dropped as ``all_links``."""
    from ..sources.tsv import read_places

    rows = read_places(spark, source)
    links = L.alias_links(rows, "aliases", "name")
    manifest = SuggestIndex.from_frames(geo.records(rows), links, validate=False).write(target)
    return {**manifest, "all_links": links.count()}
