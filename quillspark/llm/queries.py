"""Queries of this subpackage's operators: ``QUERIES`` and, where SQL can express them, ``ORACLE``.

Each takes (spark, sf_dir) and runs over the whole of its tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import archive, decontaminate, fingerprint, language, licenses, mixing_lm, mixture, near_dups, quality, token_files
from .store import table


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents that share 80 % of their two-word shingles. Null and empty texts are
    alone; equal rows are one node, see :func:`.near_dups.near_duplicates`."""
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"), params=near_dups.Params(shingle=2))


QUERIES = {"op10_minhash_near_dedup": op10_minhash_near_dedup}

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE: dict[str, str] = {
    "op10_minhash_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS sh FROM d, unnest(range(1, greatest(len(w), 2))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n_both FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * n_both >= 80 * (a.n + b.n - n_both)),
ways AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT x, y FROM ways UNION SELECT reach.x, ways.y FROM reach JOIN ways ON reach.y = ways.x),
least AS (SELECT x, min(y) AS y FROM reach GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(y, doc_id)) AS component_id, doc_id <= coalesce(y, doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least ON x = doc_id
""",
}


def op1_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of every document. Null and empty texts have no words and no hits; repeated
    rows are rows like any others; an empty benchmark hits nothing."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("bench_words").alias("n_words"),
        F.col("bench_hits").alias("n_hit"),
        F.size("bench_items").cast("long").alias("n_items"),
        F.sha2(F.array_join("bench_items", ","), 256).alias("items_sha256"),
        ((F.col("bench_hits") > 0) & (20 * F.col("bench_hits") >= F.col("bench_words"))).alias("contaminated"),
    )


_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE["op1_benchmark_decontamination"] = f"""
WITH d AS (SELECT doc_id, coalesce({_ALNUM.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_ALNUM.format("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM b, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS r(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS r(i) WHERE len(w) >= n),
hit AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.win = bw.win),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hit, unnest(range(i, i + n)) AS r(p) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
QUERIES["op1_benchmark_decontamination"] = op1_benchmark_decontamination


TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op6_token_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files of all documents, written and read back. Null and empty texts have the end id
    alone; rows that share an id follow one another by text; rows with a null id are left out."""
    read = token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path())
    return read.withColumnRenamed("value", "ids_crc32")


QUERIES["op6_token_binary_output"] = op6_token_binary_output


def op7_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive of all pages, written and put together again. Null payloads are empty; of equal
    rows one is the response."""
    return archive.archived(table(spark, sf_dir, "pages"))


QUERIES["op7_warc_archive"] = op7_warc_archive
ORACLE["op7_warc_archive"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, html, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, sha1(html) AS hex,
  max(page_id) OVER (PARTITION BY sha256(html)) AS owner FROM p)
SELECT page_id, payload_bytes,
  translate(concat(""" + ", ".join(f"to_base(CAST('0x' || substr(hex, {5 * k + 1}, 5) AS BIGINT), 32, 4)" for k in range(8)) + """),
    '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM h
"""


#: The production mixture: domains from the number of a source, then language, then source.
def mixture_levels() -> dict:
    number = F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS int)")
    domain = F.when(number < 5, "web").when(number < 10, "books").when(number < 15, "code").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


MIXTURE_WEIGHTS = {
    "domain": {"web": 0.4, "books": 0.3, "code": 0.2, "forum": 0.1},
    "lang": {"en": 0.4, "de": 0.2, "fr": 0.2, "es": 0.2},
    "source": {"src0": 2.0, "src7": 0.5},
}
MIXTURE_SHARE, MIXTURE_EPOCHS = 0.6, 2


def op2_source_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that meet the production mixture's budgets. Null sources and languages are nodes of
    their own; null and empty texts have no tokens and are never taken."""
    return mixture.mix(table(spark, sf_dir, "documents"), mixture_levels(), MIXTURE_WEIGHTS, MIXTURE_SHARE, MIXTURE_EPOCHS)


QUERIES["op2_source_mixture"] = op2_source_mixture


def op3_imatch_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts. Null texts are empty; rows that
    share an id stand in the order of their texts."""
    return fingerprint.edited_fingerprints(table(spark, sf_dir, "documents"))


QUERIES["op3_imatch_fingerprints"] = op3_imatch_fingerprints


def language_model(docs: DataFrame) -> language.Model:
    """Learned from the labelled two thirds of the documents."""
    return language.train(docs.where(language.remainder("doc_id", 3) != 1), "text", "lang")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from the labelled ones that are not held out. Null texts
    and texts without a letter are ``und``; a null id is not held out."""
    docs = table(spark, sf_dir, "documents")
    found = language.predict(docs.select("doc_id", "text"), language_model(docs))
    held_out = F.coalesce(language.remainder("doc_id", 3) == 1, F.lit(False))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.col("lang_ambiguous").alias("ambiguous"))


QUERIES["op4_language_id"] = op4_language_id


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out. Null texts are empty; a
    null id is held out, as it has no remainder."""
    docs = table(spark, sf_dir, "documents")
    return mixing_lm.score(docs, language.remainder("doc_id", 7) != 2)


QUERIES["op9_lm_scoring"] = op9_lm_scoring


def op5_quality_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents, learned from the labels. Null texts, sources and languages
    are values like any others; without labels of both kinds all scores are 0.5."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).drop("text", "source", "lang", "n_chars")


def document_path():
    """Where a document lies: source, language, and for two thirds a folder more."""
    folder = F.when(F.pmod("doc_id", F.lit(3)) != 0, F.concat(F.lit("d"), F.pmod("doc_id", F.lit(10)).cast("string")))
    return F.concat_ws("/", F.coalesce("source", F.lit("unknown")), F.coalesce("lang", F.lit("xx")), folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all documents by notice, text or folder. Null and empty texts have none of their
    own; a null source or language is a folder of its own."""
    return licenses.licensed(table(spark, sf_dir, "documents"), document_path())


QUERIES["op5_quality_cotraining"] = op5_quality_cotraining
QUERIES["op8_license_scan"] = op8_license_scan
