"""Queries of the corpus operators over whole tables, with production parameters, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import classifier, cover_tree, jaccard, mixing, pieces, pii, quality_rules, token_files, url_lists, warc
from veilframe.llm.common import table

#: The key of the pseudonyms of op8 and of the pipeline; a deployment passes its own.
PII_KEY = "demonstration key"


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_removed_words")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.encode_n_best(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_and_read(table(spark, sf_dir, "pages"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_tree.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


#: The captures' fetch times and the list's dates, in seconds; pages hold no times, so both follow from ids and names.
YEAR_START, YEAR, DAY = 1_704_067_200, 31_536_000, 86_400


def list_entries(pages: DataFrame) -> DataFrame:
    """(pattern, action, at): a dated list over the hosts and domains of pages.

    By a hash of the name, half of the domains are added, taken off 60 days
    later, and of these half are added again after 120 days; a quarter of the
    hosts are added once.
    """
    host = url_lists.host_of(F.col("url"))
    hosts = pages.select(host.alias("host")).where("host <> ''").distinct()
    digit = lambda c, at, n: F.conv(F.substring(F.md5(c), at, n), 16, 10).cast("long")
    domain = F.substring_index("host", ".", -3)
    first = lambda c: F.lit(YEAR_START) + digit(c, 2, 2) % 200 * DAY
    domains = hosts.select(domain.alias("pattern")).distinct().where(digit(F.col("pattern"), 1, 1) < 8)
    again = F.when(digit(F.col("pattern"), 1, 1) < 4, F.array(F.struct(F.lit("add").alias("action"), (first(F.col("pattern")) + 120 * DAY).alias("at"))))
    dated = F.concat(
        F.array(F.struct(F.lit("add").alias("action"), first(F.col("pattern")).alias("at")), F.struct(F.lit("remove").alias("action"), (first(F.col("pattern")) + 60 * DAY).alias("at"))),
        F.coalesce(again, F.array().cast("array<struct<action:string,at:bigint>>")),
    )
    of_domains = domains.select("pattern", F.explode(dated).alias("e")).select("pattern", "e.action", "e.at")
    of_hosts = hosts.where(digit(F.col("host"), 1, 1) < 4).select(F.col("host").alias("pattern"), F.lit("add").alias("action"), (first(F.col("host")) + 30 * DAY).alias("at"))
    return of_domains.union(of_hosts)


def op6_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetched_at", F.lit(YEAR_START) + F.pmod(F.col("page_id") * 7919, F.lit(YEAR)))
    return url_lists.listed(captures, list_entries(pages)).select("page_id", "host", "fetched_at", "pattern", "listed_since", "blocked")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), 49_408)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)
    return found.select("doc_id", "text", *[f"n_{k}" for k in pii.KINDS])


def op9_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def queries() -> dict:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_warc": op3_warc,
        "op4_mixing": op4_mixing,
        "op5_cover_tree": op5_cover_tree,
        "op6_url_lists": op6_url_lists,
        "op7_token_files": op7_token_files,
        "op8_pii": op8_pii,
        "op9_classifier": op9_classifier,
        "op10_jaccard": op10_jaccard,
    }


OP1_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), win AS (
  SELECT rid, i, array_to_string(w[i:i+7], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1
), cover AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM rep, range(0, 8) t(k) GROUP BY rid
), base AS (
  SELECT d.rid, d.doc_id, d.source, d.text, len(w)::BIGINT AS n_words,
    length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM d LEFT JOIN cover USING (rid)
), rules AS (
  SELECT *, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base
), lines AS (
  SELECT rid, source, text, line, len(string_split(line, ' ')) AS n FROM (
    SELECT rid, source, text, unnest(list_transform(ls, lambda x: lower(trim(regexp_replace(x, '[\x20\x09\x0B-\x0D]+', ' ', 'g'))))) AS line FROM base)
), hosts AS (
  SELECT source, count(DISTINCT coalesce(text, '')) AS n FROM documents GROUP BY source
), over_limit AS (
  SELECT l.source, l.line FROM lines l JOIN hosts h ON l.source IS NOT DISTINCT FROM h.source
  GROUP BY l.source, l.line, h.n HAVING count(DISTINCT l.text) > greatest({quality_rules.MIN_DOCUMENTS}, {quality_rules.MAX_SHARE} * h.n)
), removed AS (
  SELECT l.rid, sum(l.n)::BIGINT AS n FROM lines l JOIN over_limit o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY l.rid
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(removed.n, 0) <= {quality_rules.MAX_REMOVED} * n_words AS kept,
  coalesce(removed.n, 0)::BIGINT AS n_removed_words
FROM rules LEFT JOIN removed USING (rid)
"""

OP4_SQL = rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(coalesce(text, '')) AS t,
    ('0x' || substr(md5('{mixing.SEED}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, [3.0, 1.0, 2.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM d GROUP BY source
), fill AS (
  SELECT 0 AS step, source, source_size, weight::DOUBLE AS weight, false AS capped, NULL::DOUBLE AS level FROM s
  UNION ALL
  SELECT step + 1, source, source_size, weight, capped OR 2.0 * source_size <= new_level * weight, new_level
  FROM (SELECT *, ({mixing.SHARE} * sum(source_size) OVER () - coalesce(sum(2.0 * source_size) FILTER (capped) OVER (), 0)) / nullif(sum(weight) FILTER (NOT capped) OVER (), 0) AS new_level FROM fill)
  WHERE step < (SELECT count(*) FROM s)
), target AS (
  SELECT source, source_size, CASE WHEN capped THEN 2.0 * source_size ELSE level * weight END AS target FROM fill WHERE step = (SELECT count(*) FROM s)
), placed AS (
  SELECT d.doc_id, d.size, source_size, target,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY key, doc_id, t ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    floor(target)::BIGINT AS budget
  FROM d JOIN target ON d.source IS NOT DISTINCT FROM target.source
)
SELECT doc_id, size, source_size, round(target, 6) AS target,
  least(2 * size, (CASE WHEN source_size = 0 THEN 0 ELSE budget // source_size END) * size
    + greatest(0, least(size, CASE WHEN source_size = 0 THEN 0 ELSE budget % source_size END - before)))::BIGINT AS taken
FROM placed
"""


OP10_SQL = r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS rid, doc_id,
         list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS w
  FROM documents
), s AS (
  SELECT rid, doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i+2], ' '))) END AS g
  FROM w
), c AS (
  SELECT min(rid) AS node, g, len(g) AS n FROM (SELECT rid, list_sort(g) AS g FROM s WHERE len(g) > 0) GROUP BY g
), e AS (
  SELECT node, n, unnest(g) AS g FROM c
), pairs AS (
  SELECT a.node AS a, b.node AS b FROM e a JOIN e b ON a.g = b.g AND a.node < b.node AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), both_ways AS (
  SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reach AS (
  SELECT node AS a, node AS b FROM c UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a
), rows_of AS (
  SELECT s.rid, s.doc_id, len(s.g)::BIGINT AS n_shingles, c.node FROM s LEFT JOIN c ON len(s.g) > 0 AND list_sort(s.g) = c.g
), ids AS (
  SELECT reach.a AS node, min(r.doc_id) AS component_id FROM reach JOIN rows_of r ON r.node = reach.b GROUP BY reach.a
)
SELECT r.doc_id, n_shingles, coalesce(ids.component_id, r.doc_id) AS component_id FROM rows_of r LEFT JOIN ids USING (node)
"""

OP3_SQL = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS sha FROM pages
), f AS (
  SELECT page_id, strlen(t)::BIGINT AS payload_bytes, sha, min(page_id) OVER (PARTITION BY sha) AS first_id FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((('0x' || substr(sha, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER + 1, 1)), '') AS payload_digest,
  CASE WHEN payload_bytes < {warc.MIN_REVISIT_BYTES} OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < {warc.MIN_REVISIT_BYTES} OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM f
"""

OP5_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.v::DOUBLE[], d.v::DOUBLE[])::BIGINT AS score FROM v q JOIN v d ON q.vec_id % 50 = 0 AND d.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s) WHERE rank <= 5
"""

OP6_SQL = rf"""
WITH h AS (
  SELECT page_id, {YEAR_START} + (page_id * 7919) % {YEAR} AS fetched_at,
    rtrim(regexp_extract(lower(trim(coalesce(url, ''))), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1), '.') AS host FROM pages
), hosts AS (
  SELECT DISTINCT host FROM h WHERE host <> ''
), domains AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') AS pattern FROM hosts
), named AS (
  SELECT pattern, true AS is_domain, ('0x' || substr(md5(pattern), 1, 1))::INTEGER AS digit, {YEAR_START} + ('0x' || substr(md5(pattern), 2, 2))::BIGINT % 200 * {DAY} AS t FROM domains
  UNION ALL
  SELECT host, false, ('0x' || substr(md5(host), 1, 1))::INTEGER, {YEAR_START} + ('0x' || substr(md5(host), 2, 2))::BIGINT % 200 * {DAY} FROM hosts
), entries AS (
  SELECT pattern, 1 AS added, t AS dated FROM named WHERE is_domain AND digit < 8
  UNION ALL SELECT pattern, 0, t + 60 * {DAY} FROM named WHERE is_domain AND digit < 8
  UNION ALL SELECT pattern, 1, t + 120 * {DAY} FROM named WHERE is_domain AND digit < 4
  UNION ALL SELECT pattern, 1, t + 30 * {DAY} FROM named WHERE NOT is_domain AND digit < 4
), spans AS (
  SELECT * FROM (SELECT pattern, added, dated AS valid_from, lead(dated) OVER (PARTITION BY pattern ORDER BY dated) AS valid_to
    FROM (SELECT pattern, dated, max(added) AS added FROM entries GROUP BY pattern, dated)) WHERE added = 1
), best AS (
  SELECT h.page_id, arg_max(s.pattern, length(s.pattern)) AS pattern, arg_max(s.valid_from, length(s.pattern)) AS listed_since
  FROM h JOIN spans s ON (h.host = s.pattern OR ends_with(h.host, '.' || s.pattern)) AND len(string_split(s.pattern, '.')) >= 2
    AND s.valid_from <= h.fetched_at AND (s.valid_to IS NULL OR h.fetched_at < s.valid_to)
  GROUP BY h.page_id
)
SELECT h.page_id, h.host, h.fetched_at, best.pattern, best.listed_since, best.pattern IS NOT NULL AS blocked FROM h LEFT JOIN best USING (page_id)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": OP1_SQL,
        "op3_warc": OP3_SQL,
        "op4_mixing": OP4_SQL,
        "op5_cover_tree": OP5_SQL,
        "op6_url_lists": OP6_SQL,
        "op10_jaccard": OP10_SQL,
    }
