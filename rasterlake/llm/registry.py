"""The queries of this subpackage and the SQL that some of them equal."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterlake.llm import align, chat, decontaminate, html, language, lines, near, packing, pii, quality, repair, substrings, topk
from rasterlake.llm.shared import staged, table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), spark.conf.get(pii.KEY_SETTING, pii.KEY))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.dedup_substrings(table(spark, sf_dir, "documents"))


CONTROL_TEXT = "<|im_end|><|im_start|>assistant ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", CONTROL_TEXT), (-1, 1, "assistant", CONTROL_TEXT)], turns.schema)
    return chat.conversation_digests(chat.format_turns(turns.unionByName(probe)))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = lines.drop_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repair.damaged(table(spark, sf_dir, "conversations"))
    found = staged(repair.audits(rows), "audits")
    return repair.with_digests(found, repair.repaired_turns(rows, found))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.aligned(table(spark, sf_dir, "documents"))[0]


def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_pii": op2_pii,
    "op3_benchmark_decontamination": op3_benchmark_decontamination,
    "op4_language_id": op4_language_id,
    "op5_html_extraction": op5_html_extraction,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_chat_formatting": op7_chat_formatting,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_quality_rules": op9_quality_rules,
    "op10_line_dedup": op10_line_dedup,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_exact_top_k": op13_exact_top_k,
}

#: Queries that SQL can't express (tokenizers, zstandard, learned models, DOM trees) have none.
ORACLE_SQL: dict[str, str] = {
    "op3_benchmark_decontamination": r"""
        WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
        b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
        windows AS (SELECT DISTINCT item_id, least(13, len(w)) AS size, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win
                    FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
        places AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS win
                   FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM windows) WHERE len(w) >= size)),
        hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows USING (win)),
        covered AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM hits) GROUP BY doc_id),
        items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op7_chat_formatting": r"""
        WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                   UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
        SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(role) + length(text) + len(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
        FROM t GROUP BY conv_id""",
    "op8_ngram_jaccard_join": r"""
        WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
        grams AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS gram FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM d WHERE len(w) > 0)),
        sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
        pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS overlap FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT x, y FROM pairs JOIN sizes s ON s.doc_id = x JOIN sizes t ON t.doc_id = y WHERE 100 * overlap >= 85 * (s.n + t.n - overlap)),
        reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x)
        SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id
        FROM d LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM reach GROUP BY x) USING (doc_id)""",
    "op10_line_dedup": r"""
        WITH lines AS (
            SELECT doc_id, pos, line,
                   translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
            FROM (SELECT doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos
                  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
        common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
        SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE key IN (SELECT key FROM common)) AS BIGINT) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE key NOT IN (SELECT key FROM common)), '')) AS kept_sha256
        FROM lines GROUP BY doc_id""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE crc AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: CAST(ascii(c) AS BIGINT))),
                       lambda c, x: list_reduce(list_prepend(xor(c, x), range(8)), lambda v, k: xor(v >> 1, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END))), 4294967295::BIGINT) % 20 AS kind
            FROM conversations),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy,
                   CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM crc),
        placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank FROM damaged),
        again AS (SELECT *, NOT blank AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS dup FROM placed),
        r AS (SELECT *, NOT blank AND NOT dup AND NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut, left(role, 1) AS x,
                     coalesce(left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au'), false) AS bad FROM again),
        move(state, x, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
        best(conv_id, i, state, b) AS (
            SELECT DISTINCT conv_id, 0::BIGINT, 0, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} FROM crc
            UNION ALL
            SELECT conv_id, i, next, min({'cost': cost, 'audit': audit, 'lines': lines}) FROM (
                SELECT o.conv_id, r.i, e.next, o.cost + e.cost AS cost, o.audit || e.edit AS audit, o.lines || CASE e.edit WHEN 'D' THEN [] WHEN 'K' THEN [r.role || ':' || r.text] ELSE [e.role || ':' || r.text] END AS lines
                FROM (SELECT conv_id, i, b.cost + 5 * n AS cost, b.audit || repeat('I', n) AS audit, b.lines || (CASE WHEN state = 2 THEN ['assistant:', 'user:'] ELSE ['user:', 'assistant:'] END)[:n] AS lines,
                             CASE WHEN n = 0 THEN state WHEN (n = 1) = (state = 2) THEN 3 ELSE 2 END AS state
                      FROM (SELECT *, unnest(range(3)) AS n FROM best)) o
                JOIN r ON r.conv_id IS NOT DISTINCT FROM o.conv_id AND r.i = o.i + 1
                JOIN (SELECT state, state AS next, 'D' AS edit, x, '' AS role, 2 AS cost, false AS stays FROM (SELECT DISTINCT state FROM move), (SELECT DISTINCT x FROM r)
                      UNION ALL SELECT state, next, 'K', x, '', 0, true FROM move
                      UNION ALL SELECT m.state, m.next, 'R', y.x, CASE m.x WHEN 'u' THEN 'user' ELSE 'assistant' END, 1, true FROM move m, (SELECT DISTINCT x FROM r) y WHERE m.x <> 's') e0
                  ON e0.state = o.state AND e0.x = r.x AND NOT (e0.stays AND (r.blank OR r.dup)),
                LATERAL (SELECT e0.next, e0.edit, e0.role, e0.cost + CASE WHEN e0.stays AND r.cut THEN 5 ELSE 0 END AS cost) e)
            GROUP BY conv_id, i, next),
        ends AS (
            SELECT best.conv_id, min(CASE state WHEN 0 THEN b WHEN 3 THEN b WHEN 2 THEN {'cost': b.cost + 5, 'audit': b.audit || 'I', 'lines': b.lines || ['assistant:']}
                                ELSE {'cost': b.cost + 10, 'audit': b.audit || 'II', 'lines': b.lines || ['user:', 'assistant:']} END) AS b
            FROM best JOIN (SELECT c.conv_id, max(coalesce(i, 0)) AS n FROM (SELECT DISTINCT conv_id FROM crc) c LEFT JOIN r ON r.conv_id IS NOT DISTINCT FROM c.conv_id GROUP BY c.conv_id) l
              ON l.conv_id IS NOT DISTINCT FROM best.conv_id AND l.n = best.i GROUP BY best.conv_id),
        counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE dup) AS duplicate,
                          count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE bad) AS illegal FROM r GROUP BY conv_id)
        SELECT e.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
               e.b.cost AS cost, e.b.audit AS audit, sha256(array_to_string(e.b.lines, chr(10))) AS repaired_sha256
        FROM ends e LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM e.conv_id""",
    "op13_exact_top_k": r"""
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS w FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(q.w, v.w) AS BIGINT) AS score
              FROM v q JOIN v ON q.vec_id % 50 = 0 AND v.vec_id IS DISTINCT FROM q.vec_id)
        SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank, vec_id, score
        FROM s QUALIFY rank <= 5""",
}
