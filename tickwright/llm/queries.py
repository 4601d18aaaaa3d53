"""One query per operator over the test tables; SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwright.llm import toxicity
from tickwright.llm.common import documents
from tickwright.llm.fill_middle import fill_in_middle, restored
from tickwright.llm.language_id import identify_documents
from tickwright.llm.line_dedup import dedup_lines
from tickwright.llm.minhash import near_duplicates
from tickwright.llm.mixing import mixing_plan
from tickwright.llm.ngram_join import ngram_join
from tickwright.llm.packing import pack_documents
from tickwright.llm.posting_lists import nearest
from tickwright.llm.repair import repair_damaged
from tickwright.llm.secret_scan import scan_secrets
from tickwright.llm.token_counts import token_counts
from tickwright.llm.winnowing import SHORT, edited_fingerprints


def op1_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir), short=SHORT)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the fixed patterns, a digest of their spans, and all spans with the entropy ones."""
    found = scan_secrets(documents(spark, sf_dir))
    base = F.filter("findings", lambda s: s.kind.isin("assign", "access", "hex"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("findings", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("findings")).alias("spans"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels.filter(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs, model)
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "terms")


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest(vectors, F.col("vec_id") % 20 == 0)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = identify_documents(documents(spark, sf_dir))
    return found.select("doc_id", "held_out", "lang_pred", "score", "noise", "languages")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    deduped = dedup_lines(documents(spark, sf_dir))
    return deduped.select("doc_id", "n_lines", F.size("removed").alias("n_removed"),
                          F.array_join(F.transform("removed", lambda line: line.cast("string")), ",").alias("removed"),
                          F.char_length("kept_text").cast("long").alias("kept_chars"), F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document over 1024 ids is cut so that its first piece may be shorter."""
    return pack_documents(documents(spark, sf_dir))


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), "taken")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = fill_in_middle(documents(spark, sf_dir))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def op13_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(documents(spark, sf_dir))


QUERIES = {
    "op1_winnowing": op1_winnowing,
    "op2_secret_scan": op2_secret_scan,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_toxicity": op4_toxicity,
    "op5_posting_lists": op5_posting_lists,
    "op6_language_id": op6_language_id,
    "op7_line_dedup": op7_line_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_source_mixing": op9_source_mixing,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_ngram_join": op13_ngram_join,
}

#: Components of all pairs with enough shingles in common, each text merged with its equals.
_COMPONENTS = r"""
        WITH RECURSIVE worded AS (
            SELECT doc_id, regexp_extract_all(
                translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
            FROM documents),
        sets AS (
            SELECT doc_id, CASE WHEN len(words) < {width} THEN list_slice([array_to_string(words, ' ')], 1, len(words)) ELSE list_sort(list_distinct(
                list_transform(range(1, len(words) - {width} + 2), lambda i: array_to_string(words[i:i + {width} - 1], ' ')))) END AS shingles
            FROM worded),
        classes AS (
            SELECT min(doc_id) AS id, shingles, len(shingles) AS n FROM sets WHERE len(shingles) > 0 GROUP BY shingles),
        entries AS (SELECT id, n, unnest(shingles) AS shingle FROM classes),
        links AS (
            SELECT a.id AS a, b.id AS b
            FROM entries a JOIN entries b ON a.shingle = b.shingle AND a.id < b.id
                 AND 100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)
            GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))),
        reach AS (
            SELECT id AS a, id AS b FROM classes
            UNION SELECT r.a, l.b FROM reach r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON r.b = l.a),
        labels AS (SELECT a AS id, min(b) AS component FROM reach GROUP BY a),
        found AS (
            SELECT s.doc_id, len(s.shingles)::BIGINT AS n_shingles, coalesce(l.component, s.doc_id) AS component_id
            FROM sets s LEFT JOIN classes c ON s.shingles = c.shingles LEFT JOIN labels l ON c.id = l.id)
        """


def _components_sql(width: int, percent: int) -> str:
    return _COMPONENTS.replace("{width}", str(width)).replace("{percent}", str(percent))


ORACLE = {
    "op3_near_duplicates": _components_sql(2, 80) + "SELECT *, doc_id = component_id AS kept FROM found",
    "op13_ngram_join": _components_sql(4, 85) + "SELECT * FROM found",
    "op9_source_mixing": r"""
        WITH sized AS (
            SELECT doc_id, source,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
                   md5('mix' || coalesce(doc_id::VARCHAR, '')) AS mix_key
            FROM documents),
        weighed AS (
            SELECT source, sum(size)::BIGINT AS source_size, 3.0::DOUBLE * sum(size) AS most,
                   CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3
                       WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
            FROM sized GROUP BY source),
        filled AS (
            SELECT *, sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY most / weight, source NULLS LAST
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS left_over,
                   sum(weight) OVER (ORDER BY most / weight, source NULLS LAST
                       ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights
            FROM weighed),
        levels AS (
            SELECT *, most * weights <= left_over * weight AS is_full,
                   first_value(CASE WHEN most * weights > left_over * weight THEN left_over END IGNORE NULLS)
                       OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level,
                   first_value(CASE WHEN most * weights > left_over * weight THEN weights END IGNORE NULLS)
                       OVER (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS level_weights
            FROM filled),
        targets AS (
            SELECT source, source_size, CASE WHEN is_full THEN most ELSE level * weight / level_weights END AS target
            FROM levels),
        budgets AS (
            SELECT *, round(target)::BIGINT AS budget,
                   CASE WHEN source_size > 0 THEN round(target)::BIGINT // source_size ELSE 0 END AS epochs
            FROM targets),
        placed AS (
            SELECT s.*, b.source_size, b.target, b.epochs, b.budget - b.epochs * b.source_size AS rest,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.mix_key, s.doc_id, s.size
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
            FROM sized s JOIN budgets b ON s.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, size, source_size, round(target, 6) AS target,
               (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken
        FROM placed""",
    "op11_conversation_repair": r"""
        WITH RECURSIVE fated AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS id
            FROM conversations),
        bytes AS (SELECT *, list_transform(range(octet_length(id)), lambda i: ('0x' || substr(hex(id), (2 * i + 1)::BIGINT, 2))::BIGINT) AS b FROM fated),
        crc AS (
            SELECT *, list_reduce(b, lambda h, x: list_reduce([xor(h, x), 1, 1, 1, 1, 1, 1, 1, 1],
                       lambda v, one: CASE WHEN v % 2 = one THEN xor(v >> 1, 3988292384) ELSE v >> 1 END), 4294967295::BIGINT) AS h
            FROM bytes),
        damaged AS (
            SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
                   CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                   unnest(range(CASE fate WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy
            FROM (SELECT *, xor(h, 4294967295) % 20 AS fate FROM crc)),
        seen AS (
            SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS i,
                   row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS again,
                   regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) AS last
            FROM damaged),
        faulty AS (
            SELECT *, left(role, 1) AS initial, CASE WHEN last = '' THEN 'blank' WHEN again > 1 THEN 'duplicate'
                   WHEN last NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
                   lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
            FROM seen),
        inserts(place, cost, edits, lines, upto) AS (VALUES
            (0, 0, '', '', 0), (0, 5, 'I', 'user:', 2), (0, 10, 'II', 'user:' || chr(10) || 'assistant:', 3),
            (1, 0, '', '', 1), (1, 5, 'I', 'user:', 2), (1, 10, 'II', 'user:' || chr(10) || 'assistant:', 3),
            (2, 0, '', '', 2), (2, 5, 'I', 'assistant:', 3), (2, 10, 'II', 'assistant:' || chr(10) || 'user:', 2),
            (3, 0, '', '', 3), (3, 5, 'I', 'user:', 2), (3, 10, 'II', 'user:' || chr(10) || 'assistant:', 3)),
        follows(place, initial, next) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        edits(edit, cost) AS (VALUES ('K', 0), ('R', 1), ('D', 2)),
        best(c, i, place, cost, audit, lines) AS (
            SELECT DISTINCT c, 0::BIGINT, 0, 0, '', '' FROM faulty
            UNION ALL
            SELECT c, i, place, least.cost, least.audit, least.lines FROM (
                SELECT c, i, place, min({'cost': cost, 'audit': audit, 'lines': lines}) AS least FROM (
                    SELECT b.c, f.i, CASE WHEN e.edit = 'D' THEN n.upto ELSE w.next END AS place,
                           (b.cost + n.cost + e.cost + CASE WHEN e.edit <> 'D' AND f.fault = 'truncated' THEN 5 ELSE 0 END)::INTEGER AS cost,
                           b.audit || n.edits || e.edit AS audit,
                           array_to_string(list_filter([b.lines, n.lines, CASE e.edit WHEN 'K' THEN f.role || ':' || f.text
                               WHEN 'R' THEN CASE w.initial WHEN 'u' THEN 'user:' ELSE 'assistant:' END || f.text ELSE '' END], lambda x: x <> ''), chr(10)) AS lines
                    FROM best b JOIN faulty f ON f.c = b.c AND f.i = b.i + 1 JOIN inserts n ON n.place = b.place CROSS JOIN edits e
                         LEFT JOIN follows w ON w.place = n.upto AND (e.edit = 'K' AND w.initial = f.initial OR e.edit = 'R' AND w.initial <> 's')
                    WHERE e.edit = 'D' OR (w.next IS NOT NULL AND f.fault NOT IN ('blank', 'duplicate'))) AS ways
                GROUP BY c, i, place) AS chosen),
        ended AS (
            SELECT c, min({'cost': b.cost + n.cost, 'audit': b.audit || n.edits,
                           'lines': array_to_string(list_filter([b.lines, n.lines], lambda x: x <> ''), chr(10))}) AS least
            FROM best b JOIN (SELECT c AS d, max(i) AS n FROM faulty GROUP BY c) m ON m.d = b.c AND m.n = b.i
                 JOIN inserts n ON n.place = b.place AND n.upto IN (0, 3)
            GROUP BY c),
        counted AS (
            SELECT c, any_value(conv_id) AS conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
                   count_if(fault = 'blank') AS blank, count_if(fault = 'duplicate') AS duplicate, count_if(fault = 'truncated') AS truncated,
                   count_if(i > 1 AND before || initial NOT IN ('su', 'ua', 'au')) AS illegal
            FROM faulty GROUP BY c)
        SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
               coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(least.cost, 0)::BIGINT AS cost,
               coalesce(least.audit, '') AS audit, sha256(coalesce(least.lines, '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counted t ON o.conv_id IS NOT DISTINCT FROM t.conv_id
             LEFT JOIN ended USING (c)""",
    "op12_fill_in_middle": r"""
        WITH drawn AS (
            SELECT doc_id, coalesce(text, '') AS text, list_transform(range(4), lambda g: list_reduce(
                list_transform(range(8), lambda d: (instr('0123456789abcdef', substr(sha256('7:' || coalesce(doc_id::VARCHAR, '')), (8 * g + d + 1)::BIGINT, 1)) - 1)::BIGINT),
                lambda x, y: 16 * x + y)) AS h
            FROM documents),
        units AS (SELECT *, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u FROM drawn),
        cut AS (
            SELECT *, len(u)::BIGINT AS n, least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS low,
                   greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS high,
                   CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h[3] % 100 >= 100 THEN 'plain'
                        WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
            FROM units),
        parts AS (
            SELECT *, array_to_string(u[1:low], '') AS p, array_to_string(u[low + 1:high], '') AS m, array_to_string(u[high + 1:], '') AS s FROM cut)
        SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars,
               CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
                      ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(CASE form WHEN 'plain' THEN text ELSE p || m || s END) AS restored_sha256
        FROM parts""",
}
