"""The query of each numbered operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .exact_dedup import exact_dedup
from .fingerprints import fingerprints
from .mixing import mix
from .near_dedup import near_dedup
from .prefix_trie import branched, conversation_trie, turns
from .quality import fit_quality, quality_scores
from .repair import damaged, repair
from .shared import table
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .top_k import exact_top_k
from .toxicity import fit_severity, severity
from .unigram import encode
from .warc import read_warc, write_warc

PIECES = "piece_bpe_32k.model"


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES), with_prefixes=True)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), public_tokenizers.path(PIECES))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    model = fit_severity(documents, table(spark, sf_dir, "labels"))
    return severity(documents.select("doc_id", "text"), model).drop("text")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return quality_scores(documents, fit_quality(documents, table(spark, sf_dir, "labels")))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_warc(write_warc(table(spark, sf_dir, "pages")))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), size=4)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


def op12_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(branched(turns(table(spark, sf_dir, "conversations"))))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


#: crc32 in SQL: its table, and the value of a string of ASCII characters.
_CRC_TABLE = "SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END), i)) AS tab"


def _crc(text: str) -> str:
    return f"xor(list_reduce(list_transform(string_split({text}, ''), lambda x: CAST(ascii(x) AS BIGINT)), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_sentencepiece": op2_sentencepiece,
    "op3_mix_sources": op3_mix_sources,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_quality": op7_quality,
    "op8_fingerprints": op8_fingerprints,
    "op9_warc": op9_warc,
    "op10_near_dedup": op10_near_dedup,
    "op11_repair": op11_repair,
    "op12_top_k": op12_top_k,
    "op13_prefix_trie": op13_prefix_trie,
    "pipeline": pipeline,
}
SQL: dict[str, str] = {
    "op5_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op9_warc": r"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS t, CAST(strlen(coalesce(html, '')) AS BIGINT) AS n FROM pages),
        m AS (SELECT *, CASE WHEN n >= 1000 THEN nullif(max(page_id) OVER (PARTITION BY t), page_id) END AS r FROM p)
        SELECT page_id, n AS payload_bytes, sha1(t) AS payload_digest, CASE WHEN r IS NULL THEN 'response' ELSE 'revisit' END AS record_type, r AS refers_to FROM m""",
    "op10_near_dedup": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
        g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 3), ' ') AS g
              FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 2))) AS i FROM w WHERE len(ws) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
        pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
        links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
        both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
        reach(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN both_ways l ON l.a = r.other)
        SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
        FROM documents d JOIN (SELECT doc_id, min(other) AS c FROM reach GROUP BY 1) r USING (doc_id) LEFT JOIN n USING (doc_id)""",
    "op11_repair": rf"""
        WITH RECURSIVE crc AS ({_CRC_TABLE}),
        x AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS tag FROM conversations),
        y AS (SELECT x.*, {_crc("tag")} % 20 AS f FROM x, crc),
        d AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), '~') AS c, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
                     unnest(CASE WHEN f = 3 THEN [0, 1] ELSE [0] END) AS copy FROM y WHERE f <> 0),
        o AS (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i FROM d),
        n AS (SELECT *, row_number() OVER (PARTITION BY c, role, text ORDER BY i) AS nth, left(role, 1) AS ini, lag(left(role, 1)) OVER (PARTITION BY c ORDER BY i) AS prev FROM o),
        t AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^ 	-]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][ 	-]*$') THEN 't' ELSE 'k' END AS fault FROM n),
        stats AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
                         count(*) FILTER (i > 1 AND prev || ini NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM t GROUP BY c),
        fits(st, ini, nx) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
        ins(st, mid, added, lines) AS (VALUES (0, 0, '', CAST([] AS VARCHAR[])), (1, 1, '', []), (2, 2, '', []), (3, 3, '', []), (0, 2, 'I', ['user:']), (1, 2, 'I', ['user:']), (2, 3, 'I', ['assistant:']), (3, 2, 'I', ['user:']),
                                       (0, 3, 'II', ['user:', 'assistant:']), (1, 3, 'II', ['user:', 'assistant:']), (2, 2, 'II', ['assistant:', 'user:']), (3, 3, 'II', ['user:', 'assistant:'])),
        ops(st, ini, nx, op, cost, role) AS (SELECT st, ini, nx, 'K', 0, NULL FROM fits UNION ALL SELECT st, NULL, nx, 'R', 2, CASE ini WHEN 'u' THEN 'user' ELSE 'assistant' END FROM fits WHERE ini <> 's' UNION ALL SELECT unnest([0, 1, 2, 3]), NULL, -1, 'D', 3, NULL),
        w AS (SELECT c, CAST(0 AS BIGINT) AS i, 0 AS st, 0 AS cost, '' AS audit, CAST([] AS VARCHAR[]) AS lines FROM stats
              UNION ALL
              SELECT c, i, st, min(cost), arg_min(audit, {{'c': cost, 'a': audit}}), arg_min(lines, {{'c': cost, 'a': audit}})
              FROM (SELECT w.c, t.i, CASE WHEN op = 'D' THEN mid ELSE nx END AS st, w.cost + ops.cost + 2 * len(added) + CASE WHEN fault = 't' AND op <> 'D' THEN 1 ELSE 0 END AS cost, w.audit || added || op AS audit,
                           list_concat(list_concat(w.lines, ins.lines), CASE op WHEN 'D' THEN CAST([] AS VARCHAR[]) ELSE [coalesce(ops.role, t.role) || ':' || t.text] END) AS lines
                    FROM w JOIN t ON t.c = w.c AND t.i = w.i + 1 JOIN ins ON ins.st = w.st JOIN ops ON ops.st = ins.mid AND (ops.ini IS NULL OR ops.ini = t.ini) AND (op = 'D' OR fault IN ('t', 'k'))) q GROUP BY c, i, st),
        e AS (SELECT w.c, w.cost + 2 * len(added) AS cost, w.audit || added AS audit, list_concat(w.lines, ins.lines) AS lines FROM w JOIN stats s ON s.c = w.c AND s.n = w.i JOIN ins ON ins.st = w.st WHERE ins.mid IN (0, 3)),
        b AS (SELECT c, min(cost) AS cost, arg_min(audit, {{'c': cost, 'a': audit}}) AS audit, arg_min(lines, {{'c': cost, 'a': audit}}) AS lines FROM e GROUP BY c)
        SELECT p.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(cost, 0) AS BIGINT) AS cost,
               coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id, coalesce(CAST(conv_id AS VARCHAR), '~') AS c FROM conversations) p LEFT JOIN stats USING (c) LEFT JOIN b USING (c)""",
    "op12_top_k": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
                   WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0),
        r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
    "op13_prefix_trie": f"""
        WITH crc AS ({_CRC_TABLE}),
        o AS (SELECT conv_id AS c, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS t
              FROM conversations WHERE conv_id IS NOT NULL GROUP BY 1),
        h AS (SELECT c, t, CAST({_crc("CAST(c AS VARCHAR)")} % 9 AS INTEGER) AS h FROM o, crc),
        r AS (SELECT h.c, list_concat(coalesce(list_slice(b.t, 1, h.h), []), list_slice(h.t, h.h + 1, len(h.t))) AS t FROM h LEFT JOIN o b ON b.c = h.c - h.c % 5),
        p AS (SELECT c, len(t) AS n, t, unnest(range(len(t) + 1)) AS d FROM r),
        k AS (SELECT c, n, d, list_slice(t, 1, d) AS k, CASE WHEN d > 0 THEN list_slice(t, 1, d - 1) END AS up, CASE WHEN d > 0 THEN strlen(t[d].text) ELSE 0 END AS b FROM p),
        v AS (SELECT d, k, any_value(up) AS up, any_value(b) AS b, min(c) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (n = d), '')) AS ends FROM k GROUP BY d, k),
        ch AS (SELECT up AS k, count(*) AS n FROM v WHERE d > 0 GROUP BY 1),
        w AS (SELECT v.*, coalesce(ch.n, 0) AS n_children FROM v LEFT JOIN ch ON ch.k = v.k),
        s AS (SELECT x.k, CAST(sum((w.n_convs - 1) * w.b) AS BIGINT) AS saved, count(*) FILTER (w.n_children = 0) AS leaves
              FROM w, (SELECT DISTINCT k FROM w) x WHERE list_slice(w.k, 1, len(x.k)) = x.k AND len(w.k) >= len(x.k) GROUP BY 1)
        SELECT w.conv_id, w.d AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.leaves AS n_leaves, s.saved AS saved_tokens, w.ends AS ends_sha256
        FROM w JOIN s ON s.k = w.k LEFT JOIN w u ON u.k = w.up AND w.d > 0""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
