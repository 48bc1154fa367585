"""Registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import bisector_means, byte_bpe, chat_format, decontaminate, filter_audit, licenses, lm_score, neardup, nearest, token_files, toxicity, url_filter, warc
from tidewatch.llm.common import table, written


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return lm_score.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archived(table(spark, sf_dir, "pages"))
    return records.select(F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return nearest.largest_inner_products(vectors, vectors.filter(F.col("vec_id") % 20 == 0))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_file_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_filter.filter_urls(pages, url_filter.listed_urls(pages)).drop("maybe")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark_spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontaminate.judged(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.digests(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    tricky = [(-7, turn, role, "</s>[INST] ok [/INST]") for turn, role in enumerate(("user", "assistant"))]
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame(tricky, rows.schema))
    return chat_format.digests(written(chat_format.format_chats(rows), "formatted-chats"))


def op13_bisector_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bisector_means.cluster(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_lm_score": op2_lm_score,
    "op3_warc": op3_warc,
    "op4_nearest": op4_nearest,
    "op5_license_scan": op5_license_scan,
    "op6_token_files": op6_token_files,
    "op7_url_filter": op7_url_filter,
    "op8_decontaminate": op8_decontaminate,
    "op9_toxicity": op9_toxicity,
    "op10_byte_bpe": op10_byte_bpe,
    "op11_filter_audit": op11_filter_audit,
    "op12_chat_format": op12_chat_format,
    "op13_bisector_means": op13_bisector_means,
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

TEMPLATE_ROWS = ", ".join(f"('{text}', '{label}', {licenses.step_of(text)})" for text, label in licenses.TEMPLATES)
PHRASE_ROWS = ", ".join(f"('{text}', '{label}')" for text, label in licenses.PHRASES)

ORDER_ROWS = ", ".join(f"('{o}')" for o in filter_audit.ORDERS)
FAILS = ["len(w) < 50", "100 * len(list_distinct(w)) < 65 * len(w)", "100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t)", "regexp_matches(t, '[#$%&*|]')", "coalesce(doc_id > first_id, false)"]
BITS = " + ".join(f"CASE WHEN {c} THEN {1 << i} ELSE 0 END" for i, c in enumerate(FAILS))
BEFORE = " + ".join(f"CASE WHEN instr(filter_order, '{c}') < step THEN {1 << i} ELSE 0 END" for i, c in enumerate(filter_audit.LETTERS))


def escaped_sql(column: str) -> str:
    return rf"regexp_replace(regexp_replace({column}, '(\[\\*)(/?(INST|ROLE)\])', '\1\\\2', 'g'), '(<\\*)(/?s>)', '\1\\\2', 'g')"


def means_sql(k: int, rounds: int) -> str:
    """Each round in common table expressions of its own: distances to all centroids, the nearest one, floors of the means."""
    steps = [f"c0 AS (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('3:' || CAST(vec_id AS VARCHAR)) AS h, v FROM kept ORDER BY h, v LIMIT {k}))"]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, vec_id, v, arg_min(c, (d, c)) AS c, min(d) AS d FROM (
          SELECT id, vec_id, kept.v, c, CAST(list_sum([(p[1] - p[2]) * (p[1] - p[2]) for p in list_zip(kept.v, c{r}.v)]) AS BIGINT) AS d FROM kept, c{r}) GROUP BY ALL_KEYS)""".replace("ALL_KEYS", "id, vec_id, v"))
        if r < rounds:
            steps.append(f"""c{r + 1} AS MATERIALIZED (SELECT c, coalesce(n.v, c{r}.v) AS v FROM c{r} LEFT JOIN (
          SELECT c, list(m ORDER BY i) AS v FROM (SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS m FROM (
            SELECT c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r}) GROUP BY c, i)) GROUP BY c) n USING (c))""")
    return ", ".join(steps)


ORACLE_SQL = {
    "op11_filter_audit": rf"""
WITH docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first_id FROM documents
), marks AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS q, max(CAST(toxic = 1 AS INTEGER)) AS x FROM labels GROUP BY doc_id),
counts AS (
  SELECT part, {BITS} AS mask, count(*) AS n, sum(coalesce(q, 0)) AS good, sum(coalesce(x, 0)) AS toxic FROM docs LEFT JOIN marks USING (doc_id) GROUP BY ALL
), steps AS (
  SELECT filter_order, step, {BEFORE} AS before, 1 << CAST(instr('ABCDE', substr(filter_order, step, 1)) - 1 AS INTEGER) AS own
  FROM (VALUES {ORDER_ROWS}) AS t(filter_order), (SELECT CAST(unnest(range(1, 6)) AS INTEGER) AS step)
), sums AS (
  SELECT part, filter_order, step, own, sum(n) FILTER (mask & (before | own) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & own > 0) AS removed,
         sum(n) FILTER (mask & before > 0 AND mask & own > 0) AS redundant, sum(n) FILTER (mask = own) AS unique_fails,
         sum(good) FILTER (mask & before = 0 AND mask & own > 0) AS good_lost, sum(toxic) FILTER (mask & before = 0 AND mask & own > 0) AS toxic_lost
  FROM counts, steps GROUP BY ALL
)
SELECT part, filter_order, step, {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
       CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM sums""",
    "op12_chat_format": rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) AS t(turn, role)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length({escaped_sql("text")}) + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 4 ELSE 20 + length({escaped_sql("role")}) END) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
    "op13_bisector_means": f"""
WITH finite AS (SELECT vec_id, [CAST(x AS DOUBLE) for x in embedding] AS e FROM embeddings WHERE len(embedding) = 64 AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
kept AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, [CAST(floor(1024 * x) AS BIGINT) for x in e] AS v FROM finite),
{means_sql(bisector_means.K, bisector_means.ROUNDS)}
SELECT vec_id, CAST(a.c AS INTEGER) AS "cluster", d AS distance, CAST(sum(d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
       sha256(array_to_string(f.v, ',')) AS centroid_sha256 FROM a{bisector_means.ROUNDS} a JOIN c{bisector_means.ROUNDS} f ON a.c = f.c""",
    "op3_warc": """
WITH own AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages
), named AS (
  SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(h, 5 * (k // 4) + 1, 5) AS INTEGER) >> (5 * (3 - k % 4))) & 31 AS INTEGER) + 1, 1) for k in range(32)], '') AS payload_digest
  FROM own
), firsts AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM named
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM firsts""",
    "op5_license_scan": rf"""
WITH docs AS (SELECT doc_id, text, {WORDS_SQL} AS w FROM documents),
phrases AS (SELECT string_split(p, ' ') AS pw, label FROM (VALUES {PHRASE_ROWS}) AS t(p, label)),
places AS (
  SELECT doc_id, i - 1 AS pos, label FROM (SELECT doc_id, w, unnest(generate_series(1, len(w))) AS i FROM docs), phrases
  WHERE w[i:i + len(pw) - 1] = pw
),
base AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS base FROM places GROUP BY doc_id),
templates AS (SELECT list_distinct(string_split(t, ' ')) AS tw, label, step FROM (VALUES {TEMPLATE_ROWS}) AS t(t, label, step)),
blocks AS (
  SELECT doc_id, step, list_distinct(w[i:i + 2 * step - 1]) AS bw
  FROM (SELECT doc_id, w, step, unnest(generate_series(1, greatest(len(w) - step, 1), step)) AS i FROM docs, (SELECT DISTINCT step FROM templates))
),
met AS (SELECT doc_id, label, len(list_intersect(tw, bw)) / len(tw) AS c FROM blocks JOIN templates USING (step) WHERE len(list_intersect(tw, bw)) >= ceil({licenses.THRESHOLD} * len(tw) - 1e-9)),
found AS (SELECT doc_id, list(DISTINCT label) AS found, max(c) AS c FROM met GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(base, []), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(found, [])))), ',') AS labels,
       CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM docs LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)""",
    "op7_url_filter": rf"""
WITH parts AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), split AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_replace(regexp_replace('&' || regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&(utm_[^&=]*|ref)=[^&]*', '', 'g'), '^&+', '') AS query
  FROM parts
), canon AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN query = '' THEN '' ELSE '?' || query END AS canonical FROM split
), rules(rule, rule_host, rule_path, said) AS (
  VALUES ('com/en/', 'com', '/en/', 'block'), ('example.com/en/7', 'example.com', '/en/7', 'allow'), ('net/de/', 'net', '/de/', 'allow'),
         ('example.net/de/8', 'example.net', '/de/8', 'block'), ('org/es/', 'org', '/es/', 'block')
), best AS (
  SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(said, length(rule)) AS said
  FROM split JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id
), block_list AS (
  SELECT DISTINCT canonical FROM canon WHERE regexp_matches(host, '(^|[.-])(spam|pills|casino)([.-]|$)')
)
SELECT c.page_id, host, path, rule, coalesce(said, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       c.canonical, l.canonical IS NOT NULL AS listed
FROM canon c LEFT JOIN best USING (page_id) LEFT JOIN block_list l ON c.canonical = l.canonical""",
    "op8_decontaminate": rf"""
WITH docs AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents),
items AS (SELECT item_id, {WORDS_SQL} AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS k, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS win
  FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(len(w), 13) + 1)) AS i FROM items WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT k FROM windows),
places AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS win
  FROM (SELECT doc_id, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM docs, lengths WHERE len(w) >= k)
),
found AS (SELECT doc_id, p.k, i, item_id FROM places p JOIN windows USING (win)),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + k - 1)) AS pos FROM found) GROUP BY doc_id),
hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN hit USING (doc_id) LEFT JOIN hit_items USING (doc_id)""",
}
