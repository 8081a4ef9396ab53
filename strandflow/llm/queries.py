"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, chat, ctw, decontamination, exact, infill, langid, lines, media, near_duplicates, quality, substrings

VOCABULARY = "word_bpe_49k.json"
#: The two tokenizers that op11 aligns.
BYTE_LEVEL, PIECES = "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.link_documents(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "lang", "n_tokens", "log_ppl", "spread", "ppl_high", "spread_high", "keep")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"), with_text=False)


def op4_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(table(spark, sf_dir, "documents"))


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "documents"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", both), (-7, 1, "assistant", both)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_conversations(rows.unionByName(extra)))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digests(table(spark, sf_dir, "documents"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctw.score_documents(table(spark, sf_dir, "documents"))


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_LEVEL), public_tokenizers.path(PIECES))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_digests(table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.mark_copies(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_media_columns": op4_media_columns,
    "op5_bpe": op5_bpe,
    "op6_decontamination": op6_decontamination,
    "op7_language_id": op7_language_id,
    "op8_chat_formatting": op8_chat_formatting,
    "op9_line_dedup": op9_line_dedup,
    "op10_lm_scoring": op10_lm_scoring,
    "op11_cross_tokenizer_alignment": op11_cross_tokenizer_alignment,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": r"""
        WITH RECURSIVE words AS (
          SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), shingles AS (
          SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i + 4], ' ') END AS s
          FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS i FROM words WHERE len(ws) > 0)
        ), sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
        met AS (
          SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
        ), links AS (
          SELECT a, b FROM met JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE common * 10 >= 8 * (x.n + y.n - common)
        ), reach AS (
          SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a
        ), classes AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
        same AS (
          SELECT doc_id, count(*) OVER (PARTITION BY sig) AS k FROM (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS sig FROM shingles GROUP BY doc_id)
        )
        SELECT c.doc_id, c.class_id, coalesce(n_links, 0) AS n_links, coalesce(k, 1) AS n_copies
        FROM classes c LEFT JOIN (SELECT a AS doc_id, count(*) AS n_links FROM links GROUP BY a) USING (doc_id) LEFT JOIN same USING (doc_id)
    """,
    "op3_substring_dedup": r"""
        WITH words AS (
          SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
        ), windows AS (
          SELECT row, i, sha256(array_to_string(ws[i:i + 34], ' ')) AS w FROM (SELECT row, ws, unnest(range(1, len(ws) - 33)) AS i FROM words WHERE len(ws) >= 35)
        ), again AS (SELECT w FROM windows GROUP BY w HAVING count(*) > 1),
        gone AS (SELECT DISTINCT row, i + k AS place FROM windows JOIN again USING (w), (SELECT unnest(range(0, 35)) AS k) ks),
        places AS (SELECT row, list(place) AS places FROM gone GROUP BY row),
        left_ AS (
          SELECT doc_id, len(ws) AS n, coalesce(len(places), 0) AS out,
                 CASE WHEN places IS NULL THEN ws ELSE (SELECT list(w ORDER BY i) FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i) WHERE i NOT IN (SELECT unnest(places))) END AS kept
          FROM words LEFT JOIN places USING (row)
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n_words, CAST(out AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM left_
    """,
    "op9_line_dedup": r"""
        WITH docs AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
        spots AS (
          SELECT doc_id, i, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM docs) WHERE length(ls[i]) >= 1
        ), firsts AS (
          SELECT line, min((doc_id, i)) AS first, length(line) AS n,
                 length(line) - length(replace(line, 'e', '')) AS ne, length(line) - length(replace(line, 'n', '')) AS nn
          FROM spots GROUP BY line
        ), plain AS (  -- edit distance is taken over bytes here, so each letter gets one
          SELECT *, translate(line, 'éèêçàùâîôûëïñóíáúüöäßÉÈÊÇÑÓÍÁÚÜÖÄ', chr(1)||chr(2)||chr(3)||chr(4)||chr(5)||chr(6)||chr(7)||chr(8)||chr(11)||chr(12)||chr(14)||chr(15)||chr(16)||chr(17)||chr(18)||chr(19)||chr(20)||chr(21)||chr(22)||chr(23)||chr(24)||chr(25)||chr(26)||chr(27)||chr(28)||chr(29)||chr(30)||chr(31)||chr(127)||'@^~`') AS p FROM firsts WHERE n >= 24
        ), near AS (
          SELECT a.line, min(b.first) AS beside
          FROM plain a JOIN plain b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND abs(a.ne - b.ne) <= 2 AND abs(a.nn - b.nn) <= 2 AND a.line <> b.line
          WHERE levenshtein(a.p, b.p) <= 2 GROUP BY a.line
        ), gone AS (
          SELECT s.doc_id, s.i FROM spots s JOIN firsts f USING (line) LEFT JOIN near USING (line)
          WHERE (s.doc_id, s.i) > least(f.first, coalesce(near.beside, f.first))
        ), flagged AS (
          SELECT d.doc_id, u.i, d.ls[u.i] AS line, g.i IS NOT NULL AS out
          FROM docs d, LATERAL (SELECT unnest(range(1, len(d.ls) + 1)) AS i) u LEFT JOIN gone g ON g.doc_id = d.doc_id AND g.i = u.i
        )
        SELECT doc_id, count(*) AS n_lines, CAST(coalesce(sum(CASE WHEN out THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
               CAST(length(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS BIGINT) AS kept_chars,
               md5(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT out), '')) AS kept_md5
        FROM flagged GROUP BY doc_id
    """,
    "op8_chat_formatting": r"""
        WITH rows AS (
          SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
          UNION ALL SELECT -7, t.turn, t.role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) t(turn, role)
        ), seen AS (
          SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS prev,
                 row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back,
                 length(replace(replace(role, '\', '\\'), '<|', '<\|')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 23 AS chars
          FROM rows
        )
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars,
               bool_and(CASE role WHEN 'system' THEN prev IS NULL WHEN 'user' THEN prev IS NULL OR prev IN ('system', 'assistant')
                        WHEN 'assistant' THEN coalesce(prev = 'user', false) ELSE false END)
                 AND bool_or(back = 1 AND role IN ('user', 'assistant')) AS valid
        FROM seen GROUP BY conv_id
    """,
    "op12_fill_in_middle": r"""
        WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
        units AS (
          SELECT doc_id, t, regexp_extract_all(t, '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
                 CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
                 CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4
          FROM docs
        ), cuts AS (
          SELECT *, len(u) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b,
                 CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
                      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
          FROM units
        ), parts AS (
          SELECT doc_id, t, n, form, coalesce(array_to_string(u[1:a], ''), '') AS p, coalesce(array_to_string(u[a + 1:b], ''), '') AS m, coalesce(array_to_string(u[b + 1:n], ''), '') AS s FROM cuts
        )
        SELECT doc_id, CAST(n AS BIGINT) AS n, form,
               CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'spm' THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM parts
    """,
    "op13_exact_dedup": r"""
        WITH docs AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               row_number() OVER (PARTITION BY t ORDER BY doc_id NULLS LAST) = 1 AS kept, sha256(t) AS text_sha256
        FROM docs
    """,
}
