"""Queries over the driver's tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapters import delimited, geo, variants
from ..functions.distance import prefix_within
from ..functions.fold import normalize_col
from ..operators import links as L
from ..operators import suggest as S
from .index import SuggestIndex

LIMIT = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def domain(rows: DataFrame, key: Column, group: Column, rank: Column, payload: Column) -> DataFrame:
    """A covering table of one key a row."""
    folded = rows.select(normalize_col(key).alias("key"), group.cast("long").alias("group"), rank.cast("long").alias("rank"), F.encode(payload, "utf-8").alias("payload"))
    return folded.where("key <> ''")


def shown(hits: DataFrame, *first: str) -> DataFrame:
    return hits.select(*first, "rank", "group", F.decode("payload", "utf-8").alias("payload"))


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links from the words of each document's folded text."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), normalize_col("text").alias("t"))
    return docs.select(F.explode(F.split("t", " ")).alias("key"), "record_id").where("key <> ''").distinct()


def term_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("record_id"), F.col("doc_id").alias("group"), F.col("n_chars").alias("rank"), F.encode("lang", "utf-8").alias("payload"))
    return SuggestIndex(docs, terms(spark, sf_dir)).covering


def parts(spark: SparkSession, sf_dir: str, group: str = "p_partkey", rank: Column | None = None) -> DataFrame:
    column = F.regexp_extract(group, "([0-9]+)$", 1) if group == "p_brand" else F.col(group)
    return domain(table(spark, sf_dir, "part"), F.col("p_name"), column, F.col("p_size") if rank is None else rank, F.col("p_name"))


# What DuckDB runs. The fold in SQL holds for the accented Latin text of these tables only.
def _fold(text: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(strip_accents({text})), '[^\p{{L}}\p{{N}}\s.,()/-]+', '', 'g'), '[\s.,()/-]+', ' ', 'g'))"


def _suggest_sql(cover: str, where: str, limit: int = LIMIT) -> str:
    return f"""WITH c AS ({cover}),
best AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY rank DESC, payload) AS rn FROM c WHERE {where})
SELECT rank, grp AS "group", payload FROM best WHERE rn = 1 ORDER BY rank DESC, payload, grp LIMIT {limit}"""


def _cover_sql(source: str, key: str, group: str, rank: str, payload: str) -> str:
    return f"SELECT {_fold(key)} AS key, CAST({group} AS BIGINT) AS grp, CAST({rank} AS BIGINT) AS rank, {payload} AS payload FROM {source}"


PART_SQL = _cover_sql("part", "p_name", "p_partkey", "p_size", "p_name")
BRAND_SQL = _cover_sql("part", "p_name", "regexp_extract(p_brand, '([0-9]+)$', 1)", "p_size", "p_name")
TERM_SQL = f"SELECT DISTINCT unnest(string_split({_fold('text')}, ' ')) AS key, doc_id FROM documents"


def _near_sql(key: str, query: str, most: int) -> str:
    return "(" + " OR ".join(f"levenshtein(left({key}, greatest(length({query}) + {d}, 0)), {query}) <= {most}" for d in range(-most, most + 1)) + ")"


QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("fold_documents", f"SELECT doc_id, {_fold('text')} AS folded FROM documents")
def fold_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", normalize_col("text").alias("folded"))


@query("fold_conversations", f"SELECT conv_id, turn, {_fold('text')} AS folded FROM conversations")
def fold_conversations(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", normalize_col("text").alias("folded"))


@query("fold_pages_url", f"SELECT page_id, {_fold('url')} AS folded FROM pages")
def fold_pages_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", normalize_col("url").alias("folded"))


@query("links_terms", f"SELECT key, doc_id AS record_id FROM ({TERM_SQL}) WHERE key <> ''")
def links_terms(spark, sf_dir):
    return terms(spark, sf_dir)


@query("postings_terms", f"""SELECT key, row_number() OVER (ORDER BY key) - 1 AS ordinal, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS record_ids
FROM ({TERM_SQL}) WHERE key <> '' GROUP BY key""")
def postings_terms(spark, sf_dir):
    return L.numbered_postings(terms(spark, sf_dir)).select("key", "ordinal", F.concat_ws(",", F.col("record_ids").cast("array<string>")).alias("record_ids"))


@query("index_counts", f"""SELECT (SELECT count(*) FROM documents) AS records, count(*) AS links, count(DISTINCT key) AS keys FROM ({TERM_SQL}) WHERE key <> ''""")
def index_counts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").agg(F.count("*").alias("records"))
    return docs.crossJoin(terms(spark, sf_dir).agg(F.count("*").alias("links"), F.count_distinct("key").alias("keys")))


_ALIAS = "CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN '---|' WHEN 2 THEN p_brand || '|' || p_type ELSE '|' || p_type || '||(' || p_brand || ')' END"


@query("alias_fallback_name", f"""WITH a AS (SELECT p_partkey, p_name, unnest(CASE WHEN alias = '' THEN [p_name] ELSE string_split(alias, '|') END) AS x FROM (SELECT *, {_ALIAS} AS alias FROM part)),
f AS (SELECT p_partkey, p_name, {_fold('x')} AS key FROM a WHERE x <> '')
SELECT key, p_partkey AS record_id FROM f WHERE key <> ''
UNION ALL SELECT {_fold('p_name')}, p_partkey FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM f WHERE key <> '') AND {_fold('p_name')} <> ''""")
def alias_fallback_name(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), "p_name", F.expr(_ALIAS).alias("alias"))
    return L.alias_links(rows, L.split_aliases("alias", "p_name"), "p_name")


@query("prefix_scan_part", f"SELECT key, grp AS \"group\" FROM ({PART_SQL}) WHERE starts_with(key, 'b')")
def prefix_scan_part(spark, sf_dir):
    return S.matches(parts(spark, sf_dir), "b").select("key", "group")


def _suggest(name: str, cover, cover_sql: str, prefix: str, limit: int = LIMIT, edits: int = 0) -> None:
    folded = prefix.strip().lower()
    near = f"starts_with(key, '{folded}')" if not edits else f"starts_with(key, '{folded[0]}') AND {_near_sql('key', f"'{folded}'", edits)}"
    query(name, _suggest_sql(cover_sql, near, limit))(lambda spark, sf_dir: shown(S.suggest(cover(spark, sf_dir), prefix, limit, edits)))


_suggest("suggest_part", parts, PART_SQL, " B")
_suggest("suggest_limit", parts, PART_SQL, "s", 3)
_suggest("suggest_miss", parts, PART_SQL, "zzzz")
_suggest("suggest_group_dedup", lambda s, d: parts(s, d, "p_brand"), BRAND_SQL, "s", 50)
_suggest("suggest_tiebreak", lambda s, d: parts(s, d, rank=F.lit(1)), _cover_sql("part", "p_name", "p_partkey", "1", "p_name"), "s", 20)
_suggest("suggest_negative_rank", lambda s, d: domain(table(s, d, "customer"), F.col("c_name"), F.col("c_custkey"), -F.col("c_custkey"), F.col("c_mktsegment")), _cover_sql("customer", "c_name", "c_custkey", "-c_custkey", "c_mktsegment"), "customer", 20)
_suggest("fuzzy_1", parts, PART_SQL, "blua", 20, 1)
_suggest("fuzzy_2", lambda s, d: parts(s, d, "p_brand"), BRAND_SQL, "cild amvil", 20, 2)
_suggest("fuzzy_short_query", parts, PART_SQL, "bl", 20, 2)
_suggest("fuzzy_zero_equals_exact", parts, PART_SQL, "cold", 20, 0)
_suggest("topk_documents_terms", term_cover, f"SELECT key, doc_id AS grp, n_chars AS rank, lang AS payload FROM ({TERM_SQL}) JOIN documents USING (doc_id) WHERE key <> ''", "th", 20)

_BATCH_SQL = f"""WITH q AS (SELECT DISTINCT left({_fold('text')}, n) AS prefix FROM benchmark, (VALUES (1), (2), (3)) v(n) WHERE text IS NOT NULL),
c AS (SELECT key, doc_id AS grp, n_chars AS rank, lang AS payload FROM ({TERM_SQL}) JOIN documents USING (doc_id) WHERE key <> ''),
hit AS (SELECT DISTINCT prefix, grp, rank, payload FROM q JOIN c ON starts_with(c.key, trim(q.prefix)) WHERE trim(prefix) <> ''),
top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, payload, grp) AS pos FROM hit)
SELECT prefix, pos, rank, grp AS "group", payload FROM top WHERE pos <= {LIMIT}"""


@query("suggest_batch_terms", _BATCH_SQL)
def suggest_batch_terms(spark, sf_dir):
    folded = table(spark, sf_dir, "benchmark").where("text is not null").select(normalize_col("text").alias("t"))
    asked = folded.select(F.explode(F.array(*(F.substring("t", 1, n) for n in (1, 2, 3)))).alias("prefix"))
    return shown(S.suggest_batch(term_cover(spark, sf_dir), asked), "prefix", "pos")


@query("suggest_batch_fuzzy", f"""WITH q AS (SELECT DISTINCT left({_fold('p_name')}, 4) AS prefix FROM part),
c AS ({BRAND_SQL}), hit AS (SELECT prefix, c.* FROM q JOIN c ON left(c.key, 1) = left(prefix, 1) AND {_near_sql('c.key', 'prefix', 1)}),
best AS (SELECT *, row_number() OVER (PARTITION BY prefix, grp ORDER BY rank DESC, payload) AS rn FROM hit),
top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, payload, grp) AS pos FROM best WHERE rn = 1)
SELECT prefix, pos, rank, grp AS "group", payload FROM top WHERE pos <= {LIMIT}""")
def suggest_batch_fuzzy(spark, sf_dir):
    asked = table(spark, sf_dir, "part").select(F.substring(normalize_col("p_name"), 1, 4).alias("prefix"))
    return shown(S.suggest_batch(parts(spark, sf_dir, "p_brand"), asked, max_edits=1), "prefix", "pos")


@query("topk_prefix_materialized", f"""WITH c AS ({BRAND_SQL}), p AS (SELECT DISTINCT left(key, n) AS prefix, grp, rank, payload FROM c, range(1, 5) r(n)),
best AS (SELECT *, row_number() OVER (PARTITION BY prefix, grp ORDER BY rank DESC, payload) AS rn FROM p),
top AS (SELECT *, row_number() OVER (PARTITION BY prefix ORDER BY rank DESC, payload, grp) AS pos FROM best WHERE rn = 1)
SELECT prefix, pos, rank, grp AS "group", payload FROM top WHERE pos <= 5""")
def topk_prefix_materialized(spark, sf_dir):
    return shown(S.materialized(parts(spark, sf_dir, "p_brand"), 4, 5), "prefix", "pos")


@query("prefix_edit_distance", f"""SELECT DISTINCT p_name, q AS query, {_near_sql('key', 'q', 1)} AS within_1, {_near_sql('key', 'q', 2)} AS within_2
FROM (SELECT p_name, {_fold('p_name')} AS key FROM part), (VALUES ('bleu'), ('cold ani'), ('blue widgte'), ('x')) v(q)""")
def prefix_edit_distance(spark, sf_dir):
    names = table(spark, sf_dir, "part").select("p_name", normalize_col("p_name").alias("key")).distinct()
    asked = names.select("p_name", "key", F.explode(F.array(*map(F.lit, ("bleu", "cold ani", "blue widgte", "x")))).alias("query"))
    return asked.select("p_name", "query", prefix_within(F.col("key"), F.col("query"), 1).alias("within_1"), prefix_within(F.col("key"), F.col("query"), 2).alias("within_2"))


_PEOPLE = " UNION ALL ".join(_cover_sql(t, f"{k}_name", f"{k}_{key}", f"{k}_{key}", f"{k}_name || '|' || '{t}'") for t, k, key in (("customer", "c", "custkey"), ("supplier", "s", "suppkey")))


@query("suggest_people", _suggest_sql(_PEOPLE, "starts_with(key, 'supplier')", 12))
def suggest_people(spark, sf_dir):
    rows = [table(spark, sf_dir, t).select(F.col(f"{k}_name").alias("name"), F.col(f"{k}_{key}").alias("id"), F.lit(t).alias("dept")) for t, k, key in (("customer", "c", "custkey"), ("supplier", "s", "suppkey"))]
    people = rows[0].unionByName(rows[1])
    cover = people.select(normalize_col("name").alias("key"), F.col("id").alias("group"), F.col("id").alias("rank"), delimited.encode("name", "dept").alias("payload"))
    hits = S.suggest(cover, "Supplier", 12).withColumn("who", delimited.decode("payload", "name", "dept"))
    return hits.select("rank", "group", F.concat_ws("|", "who.name", "who.dept").alias("payload"))


_NATION = f"""SELECT unnest([{_fold('n_name')}, {_fold('r_name')}]) AS key, CAST(n_nationkey AS BIGINT) AS grp, coalesce(c, 0) AS rank, n_name AS payload
FROM nation JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT c_nationkey, count(*) AS c FROM customer GROUP BY 1) ON c_nationkey = n_nationkey"""


@query("suggest_geo_nation", f"""WITH best AS (SELECT DISTINCT grp, rank, payload FROM ({_NATION}) WHERE starts_with(key, 'a'))
SELECT grp AS gid, payload AS name, CAST(grp AS DOUBLE) AS lat, 0.0::DOUBLE AS lon, '' AS country, rank AS population, 'PCLI' AS feature_code FROM best""")
def suggest_geo_nation(spark, sf_dir):
    return nation_index(spark, sf_dir).suggest_geo("A", 1000)


def nation_index(spark: SparkSession, sf_dir: str) -> SuggestIndex:
    customers = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("population"))
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).join(customers, "n_nationkey", "left")
    places = nations.select(F.col("n_nationkey").cast("long").alias("record_id"), F.col("n_nationkey").cast("long").alias("gid"), F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("lat"), F.lit(0.0).alias("lon"), F.lit("").alias("country"), F.coalesce("population", F.lit(0)).alias("population"), F.lit("PCLI").alias("feature_code"), F.array("n_name", "r_name").alias("aliases"))
    return SuggestIndex.from_frames(geo.records(places), L.alias_links(places, "aliases", "name"))


_PRODUCT = f"SELECT unnest([{_fold('p_name')}, {_fold('''p_name || ' ' || p_brand''')}]) AS key, p_partkey AS grp, CAST(p_size AS BIGINT) AS rank, p_name AS payload FROM part"


@query("suggest_products_variants", f"""SELECT rank, "group", payload AS name FROM ({_suggest_sql(_PRODUCT, "starts_with(key, 'small')", 15)})""")
def suggest_products_variants(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_partkey").alias("group"), F.col("p_size").cast("long").alias("rank"), variants.encode(name="p_name").alias("payload"), "p_name", variants.keys("p_name", F.array("p_brand")).alias("aliases"))
    index = SuggestIndex.from_frames(rows.select("record_id", "group", "rank", "payload"), L.alias_links(rows, "aliases", "p_name"))
    hits = index.suggest("small", 15)
    return hits.select("rank", "group", variants.decode("payload", "name string")["name"].alias("name"))


@query("geo_payload_roundtrip", """SELECT c_custkey AS gid, c_name AS name, c_acctbal / 100 AS lat, -c_acctbal AS lon, c_mktsegment AS country, c_custkey AS population, 'PPL' AS feature_code FROM customer""")
def geo_payload_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("group"), F.col("c_custkey").alias("rank"), (F.col("c_acctbal") / 100).alias("lat"), (-F.col("c_acctbal")).alias("lon"), F.col("c_mktsegment").alias("country"), F.lit("PPL").alias("feature_code"), F.col("c_name").alias("name"))
    packed = rows.select("group", "rank", geo.encode().alias("payload"))
    return geo.places(packed)
