"""One query for each operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlens.llm import html_text, jaccard_join, language_id, merkle, packing, quality_rules, sentencepiece_codec, sharding, suffix_dedup, topk, toxicity, url_filter, whitening
from fieldlens.plans.tables import table


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def fold(n: int) -> Column:
    """crc32 of the id as text, modulo n; rows without an id count as 0."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % n, F.lit(0))


def op1_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.kd_shards(table(spark, folder, "documents"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(4) == 2)
    model = language_id.train(docs.filter(~F.col("held_out")), "text", "lang", id_col="doc_id")
    return language_id.predict(docs, model, ["doc_id", "held_out"])


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    rules = quality_rules.train(docs, table(spark, folder, "labels"))
    stats = quality_rules.with_statistics(docs, ["doc_id"])
    return quality_rules.apply(stats, rules).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, folder, "documents"), ["doc_id"], length=200)


def op5_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_join.components(table(spark, folder, "documents"), n=5, similarity=(80, 100))


def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op7_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn("held_out", fold(5) == 0)
    model = toxicity.train(docs, table(spark, folder, "labels").filter(fold(5) != 0))
    return toxicity.score(docs, model, ["doc_id", "held_out"])


def op8_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(table(spark, folder, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op9_topk(spark: SparkSession, folder: str) -> DataFrame:
    return topk.top_k(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


def op10_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return html_text.extract(table(spark, folder, "pages"), ["page_id", "url"])


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"), most=16)


def op12_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    altered = merkle.leaf([*fields[:3], F.col("n_chars") + 1, fields[4]])
    return merkle.manifest(docs, fields, ["doc_id"], altered=F.when(tampered, altered))


#: Fixed values of the contract.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def op13_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    outcomes = table(spark, folder, "labels").select(F.col("doc_id").alias("id"), F.coalesce(bad, F.lit(False)).alias("bad"))
    return url_filter.judge(table(spark, folder, "pages"), outcomes, URL_RULES)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_language_id": op2_language_id,
    "op3_quality_rules": op3_quality_rules,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_jaccard_join": op5_jaccard_join,
    "op6_packing": op6_packing,
    "op7_toxicity": op7_toxicity,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_topk": op9_topk,
    "op10_html_text": op10_html_text,
    "op11_whitening": op11_whitening,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_url_filter": op13_url_filter,
}

ORACLE_SQL: dict[str, str] = {
    "op9_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, v.vec_id, CAST(list_sum(list_transform(list_zip(q.e, v.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
            FROM v AS q JOIN v ON q.vec_id <> v.vec_id
            WHERE q.vec_id % 100 = 0
        ), r AS (
            SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 10
    """,
    "op12_merkle_manifest": """
        WITH RECURSIVE fields AS (
            SELECT doc_id, lang, text, n_chars, CAST(doc_id AS VARCHAR) AS id_text,
                   coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-') || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                   coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail
            FROM documents
        ), leaves AS (
            SELECT doc_id, lang, sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                   CASE WHEN xor(list_reduce(
                            list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(id_text, ''), lambda c: CAST(ascii(c) AS BIGINT))),
                            lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), list_transform(range(8), lambda i: CAST(i AS BIGINT))), lambda v, i: xor(v >> 1, 3988292384 * (v & 1)))
                        ), 4294967295) % 7 = 0
                        THEN sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS altered
            FROM fields
        ), placed AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place FROM leaves
        ), grown(lang, level, nodes) AS (
            SELECT lang, 0, list(leaf ORDER BY place) FROM placed GROUP BY lang
            UNION ALL
            SELECT lang, level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM grown WHERE len(nodes) > 1
        ), subroots AS (
            SELECT lang, nodes[1] AS subroot, level AS height, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS tree FROM grown WHERE len(nodes) = 1
        ), whole(level, nodes) AS (
            SELECT 0, list(subroot ORDER BY tree) FROM subroots
            UNION ALL
            SELECT level + 1, list_transform(range(0, len(nodes), 2), lambda i: sha256(nodes[i + 1] || coalesce(nodes[i + 2], ''))) FROM whole WHERE len(nodes) > 1
        ), steps AS (
            SELECT p.lang, p.place, g.level, (p.place >> g.level) & 1 AS odd, coalesce(g.nodes[xor(p.place >> g.level, 1) + 1], '') AS sibling
            FROM placed AS p JOIN grown AS g ON g.lang IS NOT DISTINCT FROM p.lang
            WHERE len(g.nodes) > 1
            UNION ALL
            SELECT p.lang, p.place, s.height + w.level, (s.tree >> w.level) & 1, coalesce(w.nodes[xor(s.tree >> w.level, 1) + 1], '')
            FROM placed AS p JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang CROSS JOIN whole AS w
            WHERE len(w.nodes) > 1
        ), proofs AS (
            SELECT lang, place, sha256(string_agg(sibling, '' ORDER BY level)) AS proof, list(CASE odd WHEN 1 THEN 'L' ELSE 'R' END || sibling ORDER BY level) AS way
            FROM steps GROUP BY lang, place
        )
        SELECT p.doc_id, p.leaf, s.subroot, w.nodes[1] AS root, coalesce(f.proof, sha256('')) AS proof_sha256,
               coalesce(list_reduce(list_prepend(coalesce(p.altered, p.leaf), f.way), lambda node, step: sha256(CASE step[1] WHEN 'L' THEN step[2:] || node ELSE node || step[2:] END)), coalesce(p.altered, p.leaf)) AS folded_root,
               coalesce(list_reduce(list_prepend(coalesce(p.altered, p.leaf), f.way), lambda node, step: sha256(CASE step[1] WHEN 'L' THEN step[2:] || node ELSE node || step[2:] END)), coalesce(p.altered, p.leaf)) = w.nodes[1] AS verified
        FROM placed AS p
        JOIN subroots AS s ON s.lang IS NOT DISTINCT FROM p.lang
        CROSS JOIN (SELECT nodes FROM whole WHERE len(nodes) = 1) AS w
        LEFT JOIN proofs AS f ON f.lang IS NOT DISTINCT FROM p.lang AND f.place = p.place
    """,
    "op13_url_filter": """
        WITH parts AS (
            SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) AS path
            FROM pages
        ), outcome AS (
            SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id
        ), hosts AS (
            SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, NOT contains(host, '.') OR regexp_full_match(host, '[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+') AS own,
                   CASE WHEN own THEN host ELSE array_to_string(string_split(host, '.')[-2:], '.') END AS domain, CASE WHEN own THEN host ELSE string_split(host, '.')[-1] END AS suffix
            FROM parts LEFT JOIN outcome ON doc_id = page_id GROUP BY host
        ), domains AS (
            SELECT domain, suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY domain, suffix
        ), suffixes AS (
            SELECT suffix, sum(n) AS n, sum(k) AS k, (sum(sum(k)) OVER () + 1) / CAST(sum(sum(n)) OVER () + 2 AS DOUBLE) AS prior FROM domains GROUP BY suffix
        ), c1 AS (
            SELECT sum(CASE WHEN n > 0 THEN pow(k - n * prior, 2) / n - prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) END), 0) AS rho FROM suffixes
        ), s1 AS (
            SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2), 1000) ELSE 1000 END AS strength FROM c1
        ), d AS (
            SELECT d.*, (s.k + strength * s.prior) / (s.n + strength) AS prior FROM domains AS d JOIN suffixes AS s USING (suffix), s1
        ), c2 AS (
            SELECT sum(CASE WHEN n > 0 THEN pow(k - n * prior, 2) / n - prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) END), 0) AS rho FROM d
        ), s2 AS (
            SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2), 1000) ELSE 1000 END AS strength FROM c2
        ), h AS (
            SELECT h.host, h.n, h.k, (d.k + strength * d.prior) / (d.n + strength) AS prior FROM hosts AS h JOIN d USING (domain), s2
        ), c3 AS (
            SELECT sum(CASE WHEN n > 0 THEN pow(k - n * prior, 2) / n - prior * (1 - prior) END) / nullif(sum(CASE WHEN n > 0 THEN prior * (1 - prior) * (n - 1) END), 0) AS rho FROM h
        ), s3 AS (
            SELECT CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 2), 1000) ELSE 1000 END AS strength FROM c3
        ), beta AS (
            SELECT host, n, k, k + strength * prior AS a, n - k + strength * (1 - prior) AS b FROM h, s3
        ), bounds AS (
            SELECT host, n, k, greatest(a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))), 0) AS bound FROM beta
        ), ruled AS (
            SELECT p.*, n, k, bound,
                   CASE WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
                        WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
                        WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
                        WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
            FROM parts AS p JOIN bounds USING (host)
        )
        SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict,
               CAST(n AS BIGINT) AS host_labelled, CAST(k AS BIGINT) AS host_bad, round(bound, 6) AS host_bound
        FROM ruled
    """,
}
