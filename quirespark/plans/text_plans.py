"""Queries over paragraphs and other text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import text as T
from ..sources.tables import paragraphs, table

PARAGRAPHS = "(SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS ord FROM documents)"


def docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def paras(spark, sf_dir):
    return paragraphs(docs(spark, sf_dir))


def document_info(spark, sf_dir):
    return T.counts(docs(spark, sf_dir))


def document_text(spark, sf_dir):
    return T.joined_text(paras(spark, sf_dir), ["doc_id"], "ord", "text", "\n", "body")


def paragraph_list(spark, sf_dir):
    return paras(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("ord"), "text")


def nth_text_match(spark, sf_dir):
    return T.nth_match(paras(spark, sf_dir), "the", 2).withColumn("ord", F.col("ord").cast("long"))


def folded_text_search(spark, sf_dir):
    return paras(spark, sf_dir).where(F.contains(T.folded("text"), F.lit("etre"))).groupBy("doc_id").agg(F.count("*").alias("hits"))


def contains_per_block(spark, sf_dir):
    return T.any_match(table(spark, sf_dir, "conversations"), ["conv_id"], "tion")


def replace_text_count(spark, sf_dir):
    return T.replace_literal(docs(spark, sf_dir), "the", "THE")


def replace_text_regex(spark, sf_dir):
    return T.replace_pattern(docs(spark, sf_dir), "([a-z]+)tion", "$1cion")


def replace_boundary_refused(spark, sf_dir):
    p = paras(spark, sf_dir)
    spans = p.select("doc_id", "ord", F.explode(F.sequence(F.lit(0), F.length("text"), F.lit(50))).alias("lo")).select("doc_id", "ord", F.col("lo").cast("long").alias("lo"), (F.col("lo") + 10).cast("long").alias("hi"))
    found = T.flagged(T.literal_matches(p, "the"), spans, 50)
    return found.groupBy("doc_id").agg(F.count_if(~F.col("hit")).alias("replaced"), F.count_if("hit").alias("refused"))


def caption_number_extract(spark, sf_dir):
    n = F.regexp_extract("text", "version ([0-9]+)", 1)
    return paras(spark, sf_dir).where(n != "").select("doc_id", F.col("ord").cast("long").alias("ord"), n.cast("long").alias("number"))


def flatten_run_offsets(spark, sf_dir):
    return T.run_offsets(table(spark, sf_dir, "conversations"), ["conv_id", "turn"], "text")


def toc_entries(spark, sf_dir):
    p = paras(spark, sf_dir)
    return p.where((F.length("text") > 0) & (F.length("text") <= 60)).select("doc_id", F.col("ord").cast("long").alias("ord"), "text", F.when(F.col("ord") == 0, 1).otherwise(2).cast("long").alias("level"))


def semantic_annotation(spark, sf_dir):
    t = F.col("text")
    kind = (
        F.when((F.col("ord") == 0) & (F.length(t) <= 60), "heading")
        .when(F.contains(F.lower(t), F.lit("title")), "title")
        .when(F.contains(t, F.lit(" | ")), "list")
        .when(t == "", "pageBreak")
        .when(F.contains(t, F.lit("$$$")), "formula")
        .otherwise("paragraph")
    )
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("double").alias("confidence"))
    rows = paras(spark, sf_dir).select("doc_id", kind.alias("kind")).groupBy("doc_id", "kind").agg(F.count("*").alias("n"))
    return rows.join(labels, "doc_id", "left")


def escape_xml(spark, sf_dir):
    return docs(spark, sf_dir).select("doc_id", F.md5(T.escape_xml(F.col("text"))).alias("escaped_md5"))


def bookmark_normalize(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.bookmark_name(F.concat_ws("-", F.col("p_size"), "p_name", "p_brand", "p_type")).alias("name"))


def hyperlink_list(spark, sf_dir):
    found = F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), 1)).alias("ord", "target")
    return table(spark, sf_dir, "pages").select("page_id", found).select("page_id", F.col("ord").cast("long").alias("ord"), "target")


def safe_path(spark, sf_dir):
    links = hyperlink_list(spark, sf_dir).select("target").distinct()
    return links.select("target", T.safe_relative_path(F.col("target")).alias("safe"), T.safe_relative_path(F.substring("target", 2, 300)).alias("safe_below_root"))


QUERIES = {
    f.__name__: f
    for f in (
        document_info, document_text, paragraph_list, nth_text_match, folded_text_search, contains_per_block, replace_text_count, replace_text_regex, replace_boundary_refused, caption_number_extract,
        flatten_run_offsets, toc_entries, semantic_annotation, escape_xml, bookmark_normalize, hyperlink_list, safe_path,
    )
}

SAFE = "length({0}) > 0 AND length({0}) <= 256 AND NOT starts_with({0}, '/') AND NOT contains({0}, '..') AND NOT regexp_matches({0}, '[\\\\%\\x00-\\x1f]')"
SQL = {
    "document_info": r"""
        SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS paragraphs, CAST(length(text) AS BIGINT) AS characters,
               CAST(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS BIGINT) AS words
        FROM documents""",
    "document_text": "SELECT doc_id, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents",
    "paragraph_list": f"SELECT doc_id, ord, text FROM {PARAGRAPHS}",
    "nth_text_match": f"SELECT doc_id, ord FROM (SELECT doc_id, ord, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS rn FROM {PARAGRAPHS} WHERE contains(text, 'the')) WHERE rn = 2",
    "folded_text_search": f"SELECT doc_id, count(*) AS hits FROM {PARAGRAPHS} WHERE contains(strip_accents(text), 'etre') GROUP BY doc_id",
    "contains_per_block": "SELECT conv_id, bool_or(contains(text, 'tion')) AS found FROM conversations GROUP BY conv_id",
    "replace_text_count": "SELECT doc_id, CAST(len(string_split(text, 'the')) - 1 AS BIGINT) AS replaced, md5(replace(text, 'the', 'THE')) AS text_md5 FROM documents",
    "replace_text_regex": r"SELECT doc_id, CAST(len(regexp_extract_all(text, '([a-z]+)tion')) AS BIGINT) AS replaced, md5(regexp_replace(text, '([a-z]+)tion', '\1cion', 'g')) AS text_md5 FROM documents",
    "replace_boundary_refused": f"""
        WITH parts AS (SELECT doc_id, ord, unnest(string_split(text, 'the')) AS part, unnest(range(len(string_split(text, 'the')))) AS k, len(string_split(text, 'the')) AS n FROM {PARAGRAPHS}),
        m AS (SELECT doc_id, k, n, CAST(sum(length(part)) OVER (PARTITION BY doc_id, ord ORDER BY k) + 3 * k AS BIGINT) AS lo FROM parts),
        r AS (SELECT doc_id, (lo % 50 < 10 OR lo % 50 > 47) AS refused FROM m WHERE k < n - 1)
        SELECT doc_id, count(*) FILTER (NOT refused) AS replaced, count(*) FILTER (refused) AS refused FROM r GROUP BY doc_id""",
    "caption_number_extract": f"SELECT doc_id, ord, CAST(regexp_extract(text, 'version ([0-9]+)', 1) AS BIGINT) AS number FROM {PARAGRAPHS} WHERE regexp_extract(text, 'version ([0-9]+)', 1) <> ''",
    "flatten_run_offsets": """
        WITH r AS (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS run, unnest(range(len(string_split(text, ' ')))) AS run_idx FROM conversations)
        SELECT conv_id, turn, run_idx, CAST(coalesce(sum(length(run) + 1) OVER (PARTITION BY conv_id, turn ORDER BY run_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start,
               CAST(length(run) AS BIGINT) AS length FROM r""",
    "toc_entries": f"SELECT doc_id, ord, text, CAST(CASE WHEN ord = 0 THEN 1 ELSE 2 END AS BIGINT) AS level FROM {PARAGRAPHS} WHERE length(text) BETWEEN 1 AND 60",
    "semantic_annotation": f"""
        SELECT p.doc_id, p.kind, p.n, CAST(l.quality AS DOUBLE) AS confidence FROM (
            SELECT doc_id, CASE WHEN ord = 0 AND length(text) <= 60 THEN 'heading' WHEN contains(lower(text), 'title') THEN 'title' WHEN contains(text, ' | ') THEN 'list'
                                WHEN text = '' THEN 'pageBreak' WHEN contains(text, '$$$') THEN 'formula' ELSE 'paragraph' END AS kind, count(*) AS n
            FROM {PARAGRAPHS} GROUP BY 1, 2) p LEFT JOIN labels l USING (doc_id)""",
    "escape_xml": "SELECT doc_id, md5(replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&apos;')) AS escaped_md5 FROM documents",
    "bookmark_normalize": """
        SELECT p_partkey, substr(CASE WHEN regexp_matches(n, '^[0-9]') THEN '_' || n ELSE n END, 1, 40) AS name
        FROM (SELECT p_partkey, regexp_replace(concat_ws('-', p_size, p_name, p_brand, p_type), '[^A-Za-z0-9_]', '_', 'g') AS n FROM part)""",
    "hyperlink_list": """
        SELECT page_id, unnest(range(len(regexp_extract_all(html, 'href="([^"]*)"', 1)))) AS ord, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages""",
    "safe_path": f"""
        SELECT target, {SAFE.format('target')} AS safe, {SAFE.format('substr(target, 2, 300)')} AS safe_below_root
        FROM (SELECT DISTINCT unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS target FROM pages)""",
}
