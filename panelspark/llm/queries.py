"""The registered queries of this subpackage and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelspark.llm import bpe, embedding_dedup, exact_dedup, language_id, mixing, periodic_runs, pii, quality, records, simhash, substring_dedup, toxicity, whitening
from panelspark.llm.common import table


def op8_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op1_embedding_dedup(spark, sf_dir):
    return embedding_dedup.near_groups(table(spark, sf_dir, "embeddings"))


def op2_bpe(spark, sf_dir):
    return bpe.digest(table(spark, sf_dir, "documents"))


def op3_language_id(spark, sf_dir):
    return language_id.identify(table(spark, sf_dir, "documents"))


def op4_pii(spark, sf_dir):
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op5_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op6_simhash(spark, sf_dir):
    return simhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op7_substring_dedup(spark, sf_dir):
    return substring_dedup.digest(substring_dedup.remove_repeats(table(spark, sf_dir, "documents")))


def op9_toxicity(spark, sf_dir):
    return toxicity.assess(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_records(spark, sf_dir):
    return records.read(records.write(table(spark, sf_dir, "documents")))


def op11_quality(spark, sf_dir):
    return quality.assess(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_periodic_runs(spark, sf_dir):
    return periodic_runs.digest(periodic_runs.find_runs(table(spark, sf_dir, "documents"), plant=True))


QUERIES = {f.__name__: f for f in (op1_embedding_dedup, op2_bpe, op3_language_id, op4_pii, op5_mixing, op6_simhash, op7_substring_dedup, op8_exact_dedup, op9_toxicity, op10_token_records, op11_quality, op12_whitening, op13_periodic_runs)}

ORACLE_SQL = {
    "op8_exact_dedup": r"""
        WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
        SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
        FROM t""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(CAST(doc_id AS VARCHAR)) AS place FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
        o AS (SELECT *, row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS k FROM s),
        l AS (SELECT *, (SELECT sum(source_size) FROM s) - coalesce(3 * sum(source_size) OVER b, 0) AS open_size,
                     (SELECT sum(w) FROM s) - coalesce(sum(w) OVER b, 0) AS open_w
              FROM o WINDOW b AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        f AS (SELECT min_by(open_size, k) AS open_size, min_by(open_w, k) AS open_w, min(k) AS k FROM l WHERE 3 * source_size * open_w > open_size * w),
        t AS (SELECT o.source, o.source_size,
                     CASE WHEN o.k < f.k OR f.k IS NULL THEN CAST(3 * o.source_size AS DOUBLE) ELSE CAST(f.open_size * o.w AS DOUBLE) / CAST(f.open_w AS DOUBLE) END AS target,
                     CAST(CASE WHEN o.k < f.k OR f.k IS NULL THEN 3 * o.source_size ELSE (f.open_size * o.w) // f.open_w END AS BIGINT) AS whole
              FROM o, f),
        p AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, t.whole,
                     coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.place, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first_word
              FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
        e AS (SELECT source, source_size, whole, CAST(ceil(source_size / 1024) AS BIGINT) AS blocks, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no FROM t),
        q AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(whole // greatest(source_size, 1) * blocks + ceil((whole % greatest(source_size, 1)) / 1024) AS BIGINT) ELSE 0 END AS quota FROM e),
        u AS (SELECT *, CAST(sum(quota) OVER (ORDER BY no) AS HUGEINT) AS cum, CAST(sum(quota) OVER () AS HUGEINT) AS total, count(*) OVER () AS n_sources FROM q),
        g AS (SELECT *, CASE WHEN cum < total THEN cum * 18446744073709551616 // total ELSE 18446744073709551615 END AS edge FROM u),
        i AS (SELECT slot, (CAST(slot AS HUGEINT) * 11400714819323198485) % 18446744073709551616 AS point FROM (SELECT unnest(range((SELECT CAST(max(total) AS BIGINT) FROM g))) AS slot)),
        j AS (SELECT slot, least((SELECT count(*) FROM g WHERE edge <= point), (SELECT count(*) - 1 FROM g)) AS no FROM i),
        k AS (SELECT slot, no, row_number() OVER (PARTITION BY no ORDER BY slot) - 1 AS rank FROM j),
        n AS (SELECT g.no, g.quota, g.total, g.n_sources, count(k.slot) AS golden FROM g LEFT JOIN k ON k.no = g.no GROUP BY ALL),
        z AS (SELECT k.slot, k.no, k.rank FROM k JOIN g ON g.no = k.no AND k.rank < g.quota
              UNION ALL SELECT CAST(total AS BIGINT) + r * n_sources + no, no, r FROM (SELECT *, unnest(range(golden, quota)) AS r FROM n)),
        x AS (SELECT p.doc_id, p.size, p.source_size, p.target, p.whole, p.first_word, q.no, p.first_word // 1024 AS b0, (p.first_word + p.size - 1) // 1024 AS b1, row_number() OVER () AS row_no
              FROM p JOIN q ON q.source IS NOT DISTINCT FROM p.source),
        y AS (SELECT row_no, min(slot) FILTER (WHERE turn = 0) AS first_slot, count(*) AS n_slots
              FROM (SELECT x.row_no, z.slot, c.turn FROM (SELECT *, unnest(range(CAST(b0 AS BIGINT), CAST(b1 AS BIGINT) + 1)) AS b FROM x WHERE size > 0) x, (VALUES (0), (1), (2)) c(turn), z
                    WHERE c.turn * x.source_size + greatest(x.first_word, x.b * 1024) < x.whole AND z.no = x.no AND z.rank = c.turn * CAST(ceil(x.source_size / 1024) AS BIGINT) + x.b) GROUP BY row_no)
        SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
               CAST(CASE WHEN source_size = 0 THEN 0 ELSE (whole // greatest(source_size, 1)) * size + greatest(0, least(first_word + size, whole % greatest(source_size, 1)) - first_word) END AS BIGINT) AS taken,
               CAST(y.first_slot AS BIGINT) AS first_slot, CAST(coalesce(y.n_slots, 0) AS BIGINT) AS n_slots
        FROM x LEFT JOIN y USING (row_no)""",
}
