"""Queries of this package and, where SQL can express them, their SQL."""

from __future__ import annotations

from sievework.llm.byte_bpe import op2_byte_bpe
from sievework.llm.embed_dedup import op5_embed_dedup
from sievework.llm.html_text import op8_html_text
from sievework.llm.lm_score import op1_lm_score
from sievework.llm.packing import op6_packing
from sievework.llm.pii import op7_pii
from sievework.llm.simhash import op3_simhash
from sievework.llm.topk import op4_topk
from sievework.llm.toxicity import op9_toxicity
from sievework.llm.warc import op10_warc

QUERIES = {f.__name__: f for f in (op1_lm_score, op2_byte_bpe, op3_simhash, op4_topk, op5_embed_dedup, op6_packing, op7_pii, op8_html_text, op9_toxicity, op10_warc)}
ORACLES = {
    "op4_topk": """
        WITH v AS (
            SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), pairs AS (
            SELECT q.r AS r, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.r <> c.r
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM pairs
        ) SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 20""",
    "op10_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        ) SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first IS NULL OR first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
            CASE WHEN first <> page_id THEN first END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)""",
}
