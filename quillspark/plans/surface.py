"""Queries on building, storing, opening and looking up, on errors, and on the plain functions.

Importing this module adds them to :data:`.queries.QUERIES` and :data:`.queries.ORACLE`.
"""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import quillspark

from ..adapters import geo
from ..functions.fold import normalize, normalize_col
from ..functions.order import to_unsigned
from ..operators import links as L
from ..operators import suggest as S
from ..runtime import scratch
from ..schema import EditBoundError, IndexFormatError
from ..sources import tsv
from ..streaming.prefixes import suggest_stream
from . import queries as Q
from .index import IndexBuilder, SuggestIndex, build_places
from .queries import ORACLE, QUERIES, _fold, _near_sql, query, shown, table

__all__ = ["ORACLE", "QUERIES"]


def outcome(call) -> str:
    """The number of rows that a call gives, or the kind of its error."""
    try:
        found = call()
        return f"{found.count()} rows" if isinstance(found, DataFrame) else str(found)
    except Exception as error:
        return type(error).__name__


def told(spark: SparkSession, rows: list[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, "name string, value string")


def _values(rows: list[tuple[str, str]]) -> str:
    text = ", ".join("(" + ", ".join("'" + v.replace("'", "''") + "'" for v in row) + ")" for row in rows)
    return f"SELECT * FROM (VALUES {text}) t(name, value)"


# Places as tab-separated text, made from customers: a third with aliases, a third without, a third
# with aliases that fold to nothing.
_ALIASES = "CASE c_custkey % 3 WHEN 0 THEN concat(c_mktsegment, '|', c_name) WHEN 1 THEN '' ELSE '---|.' END"
_POPULATION = "CAST(round(c_acctbal * 100) AS BIGINT)"


def customer_places(spark: SparkSession, sf_dir: str) -> str:
    """Path of the text."""
    cells = ["c_custkey", "c_name", "concat(c_nationkey, '.25')", "concat('-', c_nationkey, '.5')", "left(c_mktsegment, 2)", _POPULATION, "'PPL'", _ALIASES]
    path = scratch(spark, "customers-tsv")
    table(spark, sf_dir, "customer").select(F.concat_ws("\t", *(F.expr(c).cast("string") for c in cells)).alias("value")).write.text(path)
    return path


def customer_index(spark: SparkSession, sf_dir: str) -> SuggestIndex:
    path = scratch(spark, "customers-index")
    build_places(spark, customer_places(spark, sf_dir), path)
    return SuggestIndex.open(spark, path)


_PLACES = f"""SELECT c_custkey AS gid, c_name AS name, c_nationkey + 0.25::DOUBLE AS lat, -(c_nationkey + 0.5::DOUBLE) AS lon, left(c_mktsegment, 2) AS country,
{_POPULATION} AS population, 'PPL' AS feature_code, CASE c_custkey % 3 WHEN 0 THEN [lower(c_mktsegment), {_fold('c_name')}] ELSE [{_fold('c_name')}] END AS keys FROM customer"""
_KEYS = f"SELECT gid, unnest(keys) AS k FROM ({_PLACES})"
_PLACE_COLUMNS = "gid, name, lat, lon, country, population, feature_code"


@query("tsv_places_suggest", f"SELECT {_PLACE_COLUMNS} FROM ({_PLACES}) WHERE gid IN (SELECT gid FROM ({_KEYS}) WHERE starts_with(k, 'build'))")
def tsv_places_suggest(spark, sf_dir):
    return customer_index(spark, sf_dir).suggest_geo("Build", 1 << 20)


@query("tsv_places_fuzzy", f"SELECT {_PLACE_COLUMNS} FROM ({_PLACES}) WHERE gid IN (SELECT gid FROM ({_KEYS}) WHERE starts_with(k, 'm') AND {_near_sql('k', "'mashinery'", 2)})")
def tsv_places_fuzzy(spark, sf_dir):
    return customer_index(spark, sf_dir).suggest_geo("mashinery", 1 << 20, 2)


_COUNTS = f"""SELECT name, CAST(value AS VARCHAR) AS value FROM (SELECT count(DISTINCT gid) AS records, count(*) AS links, count(DISTINCT k) AS keys, count(*) AS all_links
FROM ({_KEYS})) UNPIVOT (value FOR name IN (records, links, keys, all_links))"""


@query("tsv_build_counts", _COUNTS)
def tsv_build_counts(spark, sf_dir):
    made = build_places(spark, customer_places(spark, sf_dir), scratch(spark, "customers-index"))
    return told(spark, [(k, str(made[k])) for k in ("records", "links", "keys", "all_links")])


@query("command_line_build", f"""SELECT 'returned' AS name, '0' AS value UNION ALL SELECT 'usage', '2' UNION ALL SELECT 'missing', '1' UNION ALL SELECT 'length', CAST(count(*) AS VARCHAR) FROM customer""")
def command_line_build(spark, sf_dir):
    from ..__main__ import main

    path = scratch(spark, "command-index")
    with contextlib.redirect_stdout(io.StringIO()), contextlib.redirect_stderr(io.StringIO()):
        codes = [("returned", main([customer_places(spark, sf_dir), path])), ("usage", main([])), ("missing", main([scratch(spark, "no"), path]))]
    return told(spark, [*((k, str(v)) for k, v in codes), ("length", str(len(SuggestIndex.open(spark, path))))])


# Lines with one fault by the number of the customer.
_LINE = """CASE c_custkey % 8 WHEN 1 THEN concat('x', c_custkey, t, 'a', t, 0, t, 0, t, t, 1, t) WHEN 2 THEN concat(c_custkey, t, 'a', t, 'north', t, 0, t, t, 1, t)
WHEN 3 THEN concat(c_custkey, t, 'a', t, 0) WHEN 4 THEN concat(c_custkey, t, 'a', t, 0, t, 0, t, t, 'many', t) WHEN 5 THEN concat(c_custkey, t, 'a', t, 0, t, ' 1', t, t, 1, t)
WHEN 6 THEN concat('#', c_custkey) WHEN 7 THEN '' ELSE concat('+', c_custkey, t, 'a', t, '.5', t, '-1e3', t, t, '-', c_custkey, t, 'PPL', t, 'b|c', t, 'more') END"""
_FAULTS = "CASE c_custkey % 8 WHEN 1 THEN 'bad gid' WHEN 2 THEN 'bad lat' WHEN 3 THEN 'expected at least 7 columns, found 3' WHEN 4 THEN 'bad population' WHEN 5 THEN 'bad lon' END"


@query("tsv_errors", f"""SELECT {_LINE} AS line, {_FAULTS} AS error, CASE WHEN c_custkey % 8 = 0 THEN c_custkey END AS gid, CASE WHEN c_custkey % 8 = 0 THEN -1000.0::DOUBLE END AS lon
FROM (SELECT c_custkey, chr(9) AS t FROM customer) WHERE c_custkey % 8 NOT IN (6, 7)""")
def tsv_errors(spark, sf_dir):
    path = scratch(spark, "faulty-tsv")
    table(spark, sf_dir, "customer").withColumn("t", F.lit("\t")).select(F.expr(_LINE).alias("value")).write.text(path)
    good = F.col("error").isNull()
    return tsv.parse(tsv.scan(spark, path)).select(F.col("value").alias("line"), "error", F.when(good, F.col("gid")).alias("gid"), F.when(good, F.col("lon")).alias("lon"))


@query("tsv_first_error", "SELECT 'bad line' AS name, 'LineError' AS value UNION ALL SELECT 'no file', 'AnalysisException'")
def tsv_first_error(spark, sf_dir):
    path = scratch(spark, "faulty-tsv")
    table(spark, sf_dir, "customer").withColumn("t", F.lit("\t")).select(F.expr(_LINE).alias("value")).write.text(path)
    return told(spark, [("bad line", outcome(lambda: tsv.read_places(spark, path))), ("no file", outcome(lambda: tsv.read_places(spark, scratch(spark, "none"))))])


def document_index(spark: SparkSession, sf_dir: str) -> SuggestIndex:
    """The words of documents, stored and opened again."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("group"), F.col("n_chars").alias("rank"), F.encode("lang", "utf-8").alias("payload"))
    path = scratch(spark, "documents-index")
    SuggestIndex.from_frames(docs, Q.terms(spark, sf_dir)).write(path)
    return SuggestIndex.open(spark, path)


PLACES = (0, 7, 1000)


@query("stored_postings", f"""SELECT ordinal, record_id FROM (SELECT dense_rank() OVER (ORDER BY key) - 1 AS ordinal, doc_id AS record_id FROM ({Q.TERM_SQL}) WHERE key <> '') WHERE ordinal IN {PLACES}""")
def stored_postings(spark, sf_dir):
    index = document_index(spark, sf_dir)
    return spark.createDataFrame([(n, i) for n in PLACES for i in index.posting(n)], "ordinal long, record_id long")


@query("stored_records", """SELECT doc_id AS record_id, n_chars AS rank, lang AS payload FROM documents WHERE doc_id IN (SELECT doc_id FROM documents ORDER BY doc_id LIMIT 3)
UNION ALL SELECT NULL, (SELECT count(*) FROM documents), 'records' UNION ALL SELECT NULL, count(DISTINCT key), 'keys' FROM (""" + Q.TERM_SQL + ") WHERE key <> ''")
def stored_records(spark, sf_dir):
    index = document_index(spark, sf_dir)
    ids = [r[0] for r in table(spark, sf_dir, "documents").select("doc_id").orderBy("doc_id").limit(3).collect()]
    rows = [(i, index.record(i)["rank"], bytes(index.record(i)["payload"]).decode()) for i in ids]
    return spark.createDataFrame([*rows, (None, len(index), "records"), (None, index.counts()["keys"], "keys")], "record_id long, rank long, payload string")


@query("builder_regions", """SELECT CAST(n_nationkey AS BIGINT) AS rank, CAST(n_regionkey AS BIGINT) AS "group", n_name AS payload FROM (
SELECT *, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey DESC, n_name) AS rn FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE starts_with(lower(n_name), 'a') OR starts_with(lower(r_name), 'a')) WHERE rn = 1""")
def builder_regions(spark, sf_dir):
    """Records and keys one by one; several keys a record, one twice; the best record of a region."""
    builder = IndexBuilder(spark)
    for r in table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).collect():
        record = builder.add_record(r["n_regionkey"], r["n_nationkey"], r["n_name"].encode())
        for key in (r["n_name"], r["r_name"], r["r_name"]):
            builder.add_key(normalize(key), record)
    return shown(builder.build().suggest("A", 100))


_TOP = 1 << 63
#: (group, rank, payload): groups from 2 ** 63 on stand after all others, ranks at both ends.
_EXTREMES = [(2 * _TOP - 1, -_TOP, "p"), (_TOP, -_TOP, "p"), (5, -_TOP, "p"), (9, _TOP - 1, ""), (_TOP + 1, 0, "z"), (3, 0, "z"), (4, 0, "a"), (2 * _TOP - 1, -_TOP, "q")]


@query("unsigned_extremes", f"""SELECT rank, CAST(g AS VARCHAR) AS grp, payload, row_number() OVER (ORDER BY rank DESC, payload, g) AS pos FROM (
SELECT *, row_number() OVER (PARTITION BY g ORDER BY rank DESC, payload) AS rn FROM (VALUES {", ".join(f"({g}::UBIGINT, ({r})::BIGINT, '{p}')" for g, r, p in _EXTREMES)}) t(g, rank, payload)) WHERE rn = 1 ORDER BY pos LIMIT 6""")
def unsigned_extremes(spark, sf_dir):
    builder = IndexBuilder(spark)
    for g, r, p in _EXTREMES:
        builder.add_key("x", builder.add_record(g, r, p.encode()))
    rows = builder.build().suggest_rows("X", 6)
    return spark.createDataFrame([(r, str(g), p.decode(), k + 1) for k, (r, g, p) in enumerate(rows)], "rank long, grp string, payload string, pos long")


@query("suggest_geo_fuzzy_nation", f"""WITH best AS (SELECT DISTINCT grp, rank, payload FROM ({Q._NATION}) WHERE starts_with(key, 'a') AND {_near_sql('key', "'amrrica'", 1)})
SELECT grp AS gid, payload AS name, CAST(grp AS DOUBLE) AS lat, 0.0::DOUBLE AS lon, '' AS country, rank AS population, 'PCLI' AS feature_code FROM best""")
def suggest_geo_fuzzy_nation(spark, sf_dir):
    return Q.nation_index(spark, sf_dir).suggest_geo("Amrrica", 1000, 1)


@query("geo_unpacked_rows", """SELECT CAST(c_custkey AS VARCHAR) AS name, concat_ws('|', c_custkey, c_name, c_mktsegment) AS value FROM customer WHERE c_custkey <= 50""")
def geo_unpacked_rows(spark, sf_dir):
    """Payloads of single hits, unpacked in the driver."""
    rows = table(spark, sf_dir, "customer").where("c_custkey <= 50").select(F.col("c_custkey").alias("group"), F.col("c_custkey").alias("rank"), F.lit(1.5).alias("lat"), F.lit(-2.5).alias("lon"), F.col("c_mktsegment").alias("country"), F.lit("PPL").alias("feature_code"), F.col("c_name").alias("name"))
    found = [geo.geo_unpack(r["rank"], r["group"], bytes(r["payload"])) for r in rows.select("group", "rank", geo.encode().alias("payload")).collect()]
    return told(spark, [(str(gid), f"{gid}|{name}|{country}") for gid, name, lat, lon, country, rank, code in found if (lat, lon, rank, code) == (1.5, -2.5, gid, "PPL")])


_GUARDS = [("empty fold, 99 edits", "0 rows"), ("limit 0, 99 edits", "0 rows"), ("dash", "0 rows"), ("3 edits", "EditBoundError"), ("limit -1", "ValueError"), ("edits -1", "ValueError"), ("batch of 3 edits", "EditBoundError")]


@query("guards_and_bounds", _values(_GUARDS))
def guards_and_bounds(spark, sf_dir):
    cover = Q.parts(spark, sf_dir)
    asked = spark.createDataFrame([("b",)], "prefix string")
    calls = [lambda: S.suggest(cover, " ", 8, 99), lambda: S.suggest(cover, "b", 0, 99), lambda: S.suggest(cover, " - "), lambda: S.suggest(cover, "b", 8, 3), lambda: S.suggest(cover, "b", -1), lambda: S.suggest(cover, "b", 8, -1), lambda: S.suggest_batch(cover, asked, max_edits=3)]
    return told(spark, [(name, outcome(call)) for (name, _), call in zip(_GUARDS, calls)])


_ERRORS = [("dangling link", "IndexFormatError"), ("no index", "IndexFormatError"), ("no record", "IndexFormatError"), ("no posting", "IndexFormatError"), ("short payload", "IndexFormatError"), ("empty index", "0"), ("format errors are", "OSError"), ("bound errors are", "OSError ValueError")]


@query("error_kinds", _values(_ERRORS))
def error_kinds(spark, sf_dir):
    builder = IndexBuilder(spark)
    builder.add_key("a", builder.add_record(1, 2, b"x"))
    index = builder.build()
    builder.add_key("b", 9)
    kinds = lambda error: " ".join(sorted(k.__name__ for k in (OSError, ValueError) if issubclass(error, k)))
    calls = [builder.build, lambda: SuggestIndex.open(spark, scratch(spark, "none")), lambda: index.record(5), lambda: index.posting(5), lambda: geo.unpack(b"abc"), lambda: len(SuggestIndex.empty(spark)), lambda: kinds(IndexFormatError), lambda: kinds(EditBoundError)]
    return told(spark, [(name, outcome(call)) for (name, _), call in zip(_ERRORS, calls)])


# Texts and their folds.
FOLDS = [
    ("Berlin", "berlin"), ("NEW YORK", "new york"), ("Café", "cafe"), ("Zürich", "zurich"), ("São Paulo", "sao paulo"), ("Đà Nẵng", "đa nang"), ("New---York", "new york"), ("a_b/c,d.e", "ab c d e"),
    ("O'Brien", "obrien"), ("St. John's", "st johns"), ("Val-d'Or", "val dor"), ("a  -_/,. b", "a b"), ("(New) York", "new york"), ("ﬁnd", "find"), ("m²", "m2"), ("ＦＵＬＬ", "full"),
    ("", ""), ("---", ""), (" - _ / ", ""), ("́", ""), ("Солнечногорск", "солнечногорск"), ("МОСКВА", "москва"), ("ΟΔΟΣ", "οδος"),
]


@query("fold_fixed_texts", _values(FOLDS))
def fold_fixed_texts(spark, sf_dir):
    return told(spark, FOLDS).select("name", normalize_col("name").alias("value"))


@query("fold_scalar", f"SELECT DISTINCT p_name AS name, {_fold('p_name')} AS value FROM part UNION SELECT DISTINCT url, {_fold('url')} FROM pages")
def fold_scalar(spark, sf_dir):
    """The plain function on texts in the driver: some dozens of part names, and urls."""
    texts = table(spark, sf_dir, "part").select(F.col("p_name").alias("t")).union(table(spark, sf_dir, "pages").select("url")).distinct().collect()
    return told(spark, [(r["t"], normalize(r["t"])) for r in texts])


_SURFACE = ["EditBoundError", "IndexBuilder", "IndexFormatError", "SuggestIndex", "geo_unpack", "normalize"]


@query("python_surface", _values([(n, "there") for n in _SURFACE]))
def python_surface(spark, sf_dir):
    return told(spark, [(n, "there" if getattr(quillspark, n, None) is not None else "missing") for n in quillspark.__all__])


@query("topk_prefix_terms", f"""WITH c AS (SELECT key, doc_id AS grp, n_chars AS rank, lang AS payload FROM ({Q.TERM_SQL}) JOIN documents USING (doc_id) WHERE key <> ''),
p AS (SELECT DISTINCT left(key, n) AS prefix, grp, rank, payload FROM c, range(1, 5) r(n)),
top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, payload, grp) AS pos FROM p)
SELECT prefix, pos, rank, grp AS "group", payload FROM top WHERE pos <= 5""")
def topk_prefix_terms(spark, sf_dir):
    """The materialised suggestions of every prefix of up to four letters of the documents' words."""
    return shown(S.materialized(Q.term_cover(spark, sf_dir), 4, 5), "prefix", "pos")


@query("suggest_stream_brands", f"""WITH q AS (SELECT DISTINCT left({_fold('p_name')}, 2) AS prefix FROM part), c AS ({Q.BRAND_SQL}),
best AS (SELECT prefix, c.*, row_number() OVER (PARTITION BY prefix, grp ORDER BY rank DESC, payload) AS rn FROM q JOIN c ON starts_with(c.key, prefix)),
top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, payload, grp) AS pos FROM best WHERE rn = 1)
SELECT prefix, pos, rank, grp AS "group", payload FROM top WHERE pos <= 8""")
def suggest_stream_brands(spark, sf_dir):
    """A stream of prefixes; each micro-batch's answers are a folder of their own."""
    came, out = scratch(spark, "stream-in"), scratch(spark, "stream-out")
    table(spark, sf_dir, "part").select(F.substring(normalize_col("p_name"), 1, 2).alias("prefix")).distinct().write.parquet(came)
    stream = suggest_stream(Q.parts(spark, sf_dir, "p_brand"), spark.readStream.schema("prefix string").parquet(came), lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), checkpoint=scratch(spark, "stream-state"))
    stream.awaitTermination()
    return shown(spark.read.parquet(out).drop("batch"), "prefix", "pos")
