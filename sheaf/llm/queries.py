"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheaf.llm import bpe, chat, decontaminate, langid, linededup, quality, secrets, simhash, toxicity, warc
from sheaf.llm.common import table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op3_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_predictions(table(spark, sf_dir, "documents"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.summary(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def decontaminate_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.near_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_warc_revisit(spark: SparkSession, sf_dir: str) -> DataFrame:
    resolved = warc.resolve_revisits(warc.records_of_pages(table(spark, sf_dir, "pages")))
    return resolved.select("record_id", "url_key", "resolved_id", "outcome", warc.header_lines(F.col("headers")).alias("headers"))


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secrets.scan(docs, secrets.fit(docs))


def op7_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chat.format_preferences(chat.neighbour_pairs(table(spark, sf_dir, "conversations")))
    masks = [chat.mask_runs(F.col(f"{side}_segments")).alias(f"{side}_mask") for side in ("chosen", "rejected")]
    return made.select(F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen_text", "rejected_text", *masks, "status")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.held_out_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.drop_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_simhash": op2_simhash,
    "op3_langid": op3_langid,
    "op4_decontaminate": op4_decontaminate,
    "op5_warc_revisit": op5_warc_revisit,
    "op6_secrets": op6_secrets,
    "op7_preferences": op7_preferences,
    "op8_toxicity": op8_toxicity,
    "op9_quality": op9_quality,
    "op10_line_dedup": op10_line_dedup,
    "decontaminate_proximity": decontaminate_proximity,
}

_RENDER = "'<|' || replace(coalesce(t.role, ''), '<|', '< |') || '|>' || chr(10) || replace(coalesce(t.text, ''), '<|', '< |') || '<|end|>' || chr(10)"
_MASK = "(length(replace(coalesce(t.role, ''), '<|', '< |')) + 5)::VARCHAR || ':0,' || (length(replace(coalesce(t.text, ''), '<|', '< |')) + 8)::VARCHAR || CASE WHEN t.role = 'assistant' THEN ':1' ELSE ':0' END"

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_decontaminate": f"""
        WITH items AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least({decontaminate.WINDOW}, len(w)) AS size, array_to_string(w[i:i + least({decontaminate.WINDOW}, len(w)) - 1], ' ') AS g
                    FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {decontaminate.WINDOW - 1}) + 1)) AS i FROM items WHERE len(w) > 0)),
        docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
        grams AS (SELECT r, size, i, array_to_string(w[i:i + size - 1], ' ') AS g FROM (SELECT r, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM docs, (SELECT DISTINCT size FROM windows))),
        found AS (SELECT r, item_id, i, grams.size FROM grams JOIN windows ON grams.size = windows.size AND grams.g = windows.g),
        hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + size)) AS p FROM found) GROUP BY r),
        ids AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
        FROM docs LEFT JOIN hits USING (r) LEFT JOIN ids USING (r)""",
    "op5_warc_revisit": r"""
        WITH p AS (SELECT page_id, url, '"' || substr(md5(coalesce(html, '')), 1, 16) || '"' AS tag FROM pages),
        r AS (SELECT page_id * 2 AS record_id, url, page_id * 2 AS ts, 0 AS k, page_id, tag FROM p
              UNION ALL SELECT page_id * 2 + 1, url || '#revisit', page_id * 2 + 4001, 1, page_id, tag FROM p),
        b AS (SELECT *, regexp_replace(trim(url), '#.*$', '') AS bare FROM r),
        u AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?@]*@)?([^/?]*)', 1)), ':(80|443)$', ''), '^www\d*\.', '') AS host,
                     regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*(.*)$', 1) AS rest FROM b),
        q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '\?(.*)$', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]+|fbclid|gclid|ref)(=|$)'))) AS params FROM u),
        keyed AS (SELECT *, CASE WHEN host <> '' THEN host || regexp_replace(regexp_extract(rest, '^([^?]*)', 1), '/+$', '') || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS url_key FROM q),
        found AS (SELECT *, last_value(CASE WHEN k = 0 AND url_key IS NOT NULL THEN {'id': record_id, 'tag': tag, 'page': page_id} END IGNORE NULLS)
                  OVER (PARTITION BY url_key ORDER BY ts, record_id, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM keyed)
        SELECT record_id, url_key, CASE WHEN f.tag = tag THEN f.id END AS resolved_id,
               CASE WHEN f IS NULL OR f.id IS NULL THEN 'no_response' WHEN f.tag = tag THEN 'resolved' ELSE 'mismatch' END AS outcome,
               CASE WHEN f.tag = tag THEN 'content-type: text/html' || chr(10) || 'date: ' || (page_id + 2000) || chr(10) || 'etag: ' || f.tag || chr(10) || 'expires: ' || (page_id + 4000) || chr(10) || 'server: a'
                    ELSE 'content-length: 0' || chr(10) || 'date: ' || (page_id + 2000) || chr(10) || 'expires: ' || (page_id + 4000) END AS headers
        FROM found WHERE k = 1""",
    "op7_preferences": f"""
        WITH c AS (SELECT conv_id, list({{'role': role, 'text': text}} ORDER BY turn, role, text) AS turns FROM conversations GROUP BY conv_id),
        k AS (SELECT *, list_max(list_filter(range(1, len(turns) + 1), lambda i: turns[i].role = 'assistant')) AS la FROM c),
        j AS (SELECT k.*, n.turns[n.la].text AS other, n.la IS NOT NULL AS has FROM k LEFT JOIN k n ON n.conv_id = k.conv_id + 1),
        r AS (SELECT *, CASE WHEN la IS NULL THEN turns WHEN has THEN list_append(turns[1:la - 1], {{'role': 'assistant', 'text': other}}) ELSE turns[1:la - 1] END AS rej FROM j),
        l AS (SELECT *, coalesce(list_min(list_filter(range(1, len(turns) + 1), lambda i: i > len(rej) OR turns[i] IS DISTINCT FROM rej[i])) - 1, len(turns)) AS n FROM r),
        s AS (SELECT conv_id, n, turns[1:n] AS p, turns[n + 1:] AS c, rej[n + 1:] AS r FROM l)
        SELECT conv_id, n::INTEGER AS n_prompt_turns,
               coalesce(array_to_string(list_transform(p, lambda t: {_RENDER}), ''), '') AS prompt,
               coalesce(array_to_string(list_transform(c, lambda t: {_RENDER}), ''), '') AS chosen_text,
               coalesce(array_to_string(list_transform(r, lambda t: {_RENDER}), ''), '') AS rejected_text,
               coalesce(array_to_string(list_transform(c, lambda t: {_MASK}), ','), '') AS chosen_mask,
               coalesce(array_to_string(list_transform(r, lambda t: {_MASK}), ','), '') AS rejected_mask,
               CASE WHEN len(c) = 0 AND len(r) = 0 THEN 'identical' WHEN n = 0 THEN 'no_prompt' ELSE 'ok' END AS status FROM s""",
    "op10_line_dedup": f"""
        WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text FROM documents),
        lines AS (SELECT page, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM pages),
        bare AS (SELECT *, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS b FROM lines),
        totals AS (SELECT source, count(*) AS host_pages FROM pages GROUP BY source),
        bad AS (SELECT x.source, x.b FROM (SELECT source, b, count(DISTINCT page) AS n FROM bare WHERE b <> '' GROUP BY source, b) x
                JOIN totals t ON x.source IS NOT DISTINCT FROM t.source WHERE n > 1 AND n > host_pages * CAST({linededup.MAX_RATIO} AS DOUBLE)),
        judged AS (SELECT l.page, l.line, l.i, bad.b IS NOT NULL AS dropped FROM bare l LEFT JOIN bad ON l.source IS NOT DISTINCT FROM bad.source AND l.b = bad.b),
        cleaned AS (SELECT page, string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped) AS text, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped FROM judged GROUP BY page)
        SELECT p.doc_id, p.source, CASE WHEN p.text IS NULL THEN NULL ELSE coalesce(c.text, '') END AS text, coalesce(n_lines, 0) AS n_lines, coalesce(n_dropped, 0) AS n_dropped
        FROM pages p LEFT JOIN cleaned c USING (page)""",
}
