"""Queries of the operators over the whole tables, with their SQL where it exists."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listloom.llm.bpe import round_trip
from listloom.llm.classlm import class_scores
from listloom.llm.jaccard import similar_classes
from listloom.llm.leaks import leak_report
from listloom.llm.licenses import license_report
from listloom.llm.merkle import leaf_digest, manifest_report
from listloom.llm.passages import remove_passages
from listloom.llm.redirects import judge
from listloom.llm.repetition import repetition_report
from listloom.llm.search import search
from listloom.llm.suffixes import remove_earlier
from listloom.llm.secrets import secret_report
from listloom.llm.toxicity import toxicity_scores

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Texts are long: rows and bytes that travel to Python at a time.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    "spark.sql.session.timeZone": "UTC",
}


def prepare(spark: SparkSession) -> None:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)


def query(sql: str | None = None):
    def register(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            prepare(spark)
            return function(spark, sf_dir)

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@query()
def op1_divide_skip_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_classes(table(spark, sf_dir, "documents")).drop("row", "component")


@query()
def op2_suffix_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition_report(table(spark, sf_dir, "documents"))


def tokenizer_path() -> str:
    """The tokenizer file of the contract; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query()
def op3_streaming_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


@query()
def op4_redirect_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


@query()
def op5_crf_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_report(table(spark, sf_dir, "documents"))


@query()
def op6_attention_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op7_license_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))


@query()
def op8_cover_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(table(spark, sf_dir, "documents"))


@query()
def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = leak_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return report.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).drop("items")


@query()
def op10_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_scores(table(spark, sf_dir, "documents"))


@query(
    """
    WITH RECURSIVE bits(i, c, k) AS (
        SELECT i, i, 0 FROM range(256) t(i)
        UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8
    ), crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
    fields AS (
        SELECT doc_id, lang, n_chars, text, source, xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT)),
            lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 7 = 0 AS tampered FROM documents, crc
    ), leaves AS (
        SELECT doc_id, lang, tampered, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx,
            sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
            sha256(head || coalesce(strlen(CAST(n_chars + CAST(tampered AS INTEGER) AS VARCHAR)) || ':' || (n_chars + CAST(tampered AS INTEGER)), '-') || tail) AS shown
        FROM (SELECT *, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
                || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail FROM fields) f
    ), nodes(level, lang, idx, digest) AS (
        SELECT 0, lang, idx, leaf FROM leaves
        UNION ALL SELECT level + 1, lang, idx // 2, sha256(string_agg(digest, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER (PARTITION BY lang) AS n FROM nodes) m WHERE n > 1 GROUP BY level, lang, idx // 2
    ), tops AS (SELECT lang, max(level) AS height, arg_max(digest, level) AS subroot FROM nodes GROUP BY lang),
    ranked AS (SELECT *, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM tops),
    upper_(level, idx, digest) AS (
        SELECT 0, t, subroot FROM ranked
        UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(digest, '' ORDER BY idx))
        FROM (SELECT *, count(*) OVER () AS n FROM upper_) m WHERE n > 1 GROUP BY level, idx // 2
    ), root AS (SELECT max(level) AS height, arg_max(digest, level) AS root FROM upper_),
    steps AS (
        SELECT l.doc_id, k AS step, (l.idx >> k) & 1 AS place, n.digest AS sibling
        FROM leaves l JOIN ranked r ON l.lang IS NOT DISTINCT FROM r.lang, unnest(range(r.height)) u(k)
        LEFT JOIN nodes n ON n.lang IS NOT DISTINCT FROM l.lang AND n.level = k AND n.idx = xor(l.idx >> k, 1)
        UNION ALL
        SELECT l.doc_id, r.height + k, (r.t >> k) & 1, n.digest
        FROM leaves l JOIN ranked r ON l.lang IS NOT DISTINCT FROM r.lang, root o, unnest(range(o.height)) u(k)
        LEFT JOIN upper_ n ON n.level = k AND n.idx = xor(r.t >> k, 1)
    ), folded(doc_id, step, digest) AS (
        SELECT doc_id, 0, shown FROM leaves
        UNION ALL SELECT f.doc_id, f.step + 1, sha256(CASE place WHEN 0 THEN f.digest || coalesce(sibling, '') ELSE sibling || f.digest END)
        FROM folded f JOIN steps s ON s.doc_id = f.doc_id AND s.step = f.step
    ), proofs AS (SELECT doc_id, sha256(coalesce(string_agg(sibling, '' ORDER BY step), '')) AS proof_sha256 FROM steps GROUP BY doc_id)
    SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
    FROM leaves l JOIN ranked r ON l.lang IS NOT DISTINCT FROM r.lang
    JOIN (SELECT doc_id, arg_max(digest, step) AS folded_root FROM folded GROUP BY doc_id) f USING (doc_id)
    LEFT JOIN proofs USING (doc_id), root
    """
)
def op11_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = leaf_digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text"))
    return manifest_report(docs, tampered, changed)


@query(
    r"""
    WITH terms AS (
        SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents
    ), asked AS (
        SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark
    ), counts AS (SELECT doc_id, term, count(*) AS tf FROM terms GROUP BY ALL),
    lengths AS (SELECT doc_id, count(*) AS n FROM terms GROUP BY ALL),
    totals AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM lengths),
    weighted AS (
        SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
        FROM counts, totals GROUP BY term, docs
    ), gains AS (
        SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // len))) AS gain
        FROM counts JOIN lengths USING (doc_id) JOIN weighted USING (term), totals
    ), scores AS (
        SELECT item_id, doc_id, CAST(sum(gain) AS BIGINT) AS score FROM asked JOIN gains USING (term) GROUP BY ALL
    )
    SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scores WHERE score > 0 QUALIFY rank <= 20
    """
)
def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    """
    WITH raw_ AS (SELECT doc_id, coalesce(hex(encode(text)), '') AS h, coalesce(strlen(text), 0) AS n FROM documents),
    parts AS (SELECT doc_id, n, c, substr(h, 2 * c + 1, 1122) AS part FROM raw_, unnest(range(0, n, 512)) u(c)),
    windows AS (
        SELECT doc_id, c + i AS pos, substr(part, 2 * i + 1, 100) AS w FROM parts, range(512) r(i) WHERE c + i + 50 <= n
    ), seen AS (SELECT w, min(doc_id) AS first FROM windows GROUP BY w HAVING count(*) > 1),
    hits AS (SELECT doc_id, pos FROM windows JOIN seen USING (w) WHERE doc_id > first),
    marked AS (SELECT doc_id, pos, pos > coalesce(lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) + 50, -1) AS opens FROM hits),
    islands AS (SELECT doc_id, pos, sum(CAST(opens AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM marked),
    spans AS (SELECT doc_id, k, min(pos) AS a, max(pos) + 50 AS b FROM islands GROUP BY doc_id, k),
    gone AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans FROM spans GROUP BY doc_id),
    kept AS (
        SELECT doc_id, h, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS low, a AS high
        FROM (SELECT doc_id, h, a, b FROM spans JOIN raw_ USING (doc_id) UNION ALL SELECT doc_id, h, n, n FROM raw_) s
    ), texts AS (SELECT doc_id, string_agg(substr(h, CAST(2 * low + 1 AS BIGINT), CAST(2 * (high - low) AS BIGINT)), '' ORDER BY low, high) AS t FROM kept GROUP BY doc_id)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans,
        sha256(unhex(t)) AS kept_sha256
    FROM raw_ JOIN texts USING (doc_id) LEFT JOIN gone USING (doc_id)
    """
)
def op13_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_earlier(table(spark, sf_dir, "documents"))
