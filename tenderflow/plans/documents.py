"""Queries on intake, blocks, structure, chunks and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import blocks, chunks, evidence, ledger, model, quotes, structure
from ..shared import shared_path
from ..sinks import stages
from ..sources import files
from .registry import query, read


def turns(spark, sf_dir):
    """Conversations as blocks: a conversation is a document, a turn a block; roles are levels."""
    level = F.when(F.col("role") == "system", 1).when(F.col("role") == "user", 2).otherwise(3)
    return read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), "role", "text", level.alias("level"))


@query("""
SELECT sha256(text) AS sha256, count(*)::BIGINT AS n_docs, min(doc_id) AS first_doc, substr(sha256(sha256(text)), 1, 12) AS doc_key
FROM documents GROUP BY text""")
def intake_content_dedupe(spark, sf_dir):
    """SRC-1, SRC-4, AG-14."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    return docs.groupBy("sha256").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc")).withColumn("doc_key", files.combined_id(F.array("sha256")))


@query(r"""
WITH x AS (SELECT page_id, lower(regexp_extract(regexp_extract(url, '([^/?#\\]*)(?:[?#].*)?$', 1), '\.([A-Za-z0-9]+)$', 1)) AS ext FROM pages)
SELECT page_id, ext, CASE WHEN ext IN ('html', 'htm') THEN 'html' WHEN ext = 'pdf' THEN 'pdf_text' WHEN ext = 'docx' THEN 'docx' WHEN ext = 'xlsx' THEN 'xlsx'
  WHEN ext IN ('png', 'jpg', 'jpeg', 'tif', 'tiff', 'bmp') THEN 'pdf_scan' ELSE 'unsupported' END AS route FROM x""")
def type_routing(spark, sf_dir):
    """SRC-2, SRC-14, SF-55."""
    ext = text.extension(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", ext.alias("ext"), files.route(ext).alias("route"))


@query("""
SELECT conv_id AS doc_id, round(coalesce(avg(length(text)) FILTER (length(text) > 0), 0), 3) AS avg_chars, (count(*) FILTER (length(text) = 0))::BIGINT AS n_empty,
  coalesce(avg(length(text)) FILTER (length(text) > 0), 0) >= 30 AS has_text_layer FROM conversations GROUP BY conv_id""")
def text_layer_probe(spark, sf_dir):
    """SRC-3."""
    return files.text_layer(turns(spark, sf_dir).select("doc_id", F.col("ord").alias("page_no"), "text")).select("doc_id", F.round("avg_chars", 3).alias("avg_chars"), F.size("empty_pages").cast("long").alias("n_empty"), "has_text_layer")


@query("""
WITH e AS (SELECT user_id, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED_REVIEW' WHEN 'view' THEN 'EXCLUDED_WITH_REASON' ELSE 'PENDING' END AS status FROM events)
SELECT user_id, count(*)::BIGINT AS total, (count(*) FILTER (status = 'DONE'))::BIGINT AS done, (count(*) FILTER (status = 'EXCLUDED_WITH_REASON'))::BIGINT AS excluded,
  (count(*) FILTER (status = 'FAILED_REVIEW'))::BIGINT AS failed, (count(*) FILTER (status = 'PENDING'))::BIGINT AS pending, coalesce(bool_and(status <> 'PENDING'), true) AS gate FROM e GROUP BY user_id""")
def ledger_gate(spark, sf_dir):
    """AG-5."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "DONE").when(kind == "error", "FAILED_REVIEW").when(kind == "view", "EXCLUDED_WITH_REASON").otherwise("PENDING")
    return ledger.summary(read(spark, sf_dir, "events").select("user_id", status.alias("status")), "user_id")


@query("""
WITH e AS (SELECT user_id, event_id, CASE event_type WHEN 'purchase' THEN 'DONE' WHEN 'error' THEN 'FAILED_REVIEW' ELSE 'PENDING' END AS status, CASE WHEN event_type = 'error' THEN props END AS reason FROM events)
SELECT user_id, coalesce(arg_max(status, event_id) FILTER (status <> 'PENDING'), 'PENDING') AS status, arg_max(reason, event_id) FILTER (reason IS NOT NULL) AS reason FROM e GROUP BY user_id""")
def ledger_state(spark, sf_dir):
    """DM-1."""
    kind = F.col("event_type")
    status = F.when(kind == "purchase", "DONE").when(kind == "error", "FAILED_REVIEW").otherwise("PENDING")
    return ledger.state(read(spark, sf_dir, "events").select("user_id", "event_id", status.alias("status"), F.when(kind == "error", F.col("props")).alias("reason")), ["user_id"], "event_id")


@query("""
SELECT conv_id AS doc_id, turn::INTEGER AS ord, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start,
  (coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text))::BIGINT AS char_end,
  'b-' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 5, '0') AS block_id FROM conversations""")
def block_offsets(spark, sf_dir):
    """WN-1, WN-2."""
    return blocks.numbered(blocks.char_offsets(turns(spark, sf_dir)), "block_id", "b-%05d", ["doc_id"], ["ord"]).select("doc_id", "ord", "char_start", "char_end", "block_id")


@query("""
SELECT conv_id AS doc_id, sha256(string_agg(text, chr(10) ORDER BY turn)) AS text_sha256, length(string_agg(text, chr(10) ORDER BY turn))::BIGINT AS n_chars FROM conversations GROUP BY conv_id""")
def document_full_text(spark, sf_dir):
    """AG-13."""
    return blocks.full_texts(turns(spark, sf_dir)).select("doc_id", F.sha2("full_text", 256).alias("text_sha256"), F.length("full_text").cast("long").alias("n_chars"))


@query("""
WITH c AS (SELECT conv_id // 4 AS doc_id, (conv_id % 4)::INTEGER AS file_no, turn, 'f' || (conv_id % 4) AS source_file, text FROM conversations),
b AS (SELECT doc_id, file_no, turn, source_file, 'paragraph' AS type, text FROM c UNION ALL SELECT DISTINCT doc_id, file_no, -1, source_file, 'marker', source_file FROM c),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY file_no, turn) - 1 AS ord FROM b)
SELECT doc_id, file_no, ord::INTEGER AS ord, source_file, type,
  coalesce(sum(length(text) + 1) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM o""")
def merged_files(spark, sf_dir):
    """SO-2, DM-7: four conversations are the files of a document."""
    c = turns(spark, sf_dir)
    named = c.select((F.floor(F.col("doc_id") / 4)).alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("file_no"), "ord", F.concat(F.lit("f"), F.col("doc_id") % 4).alias("source_file"), "text")
    return blocks.merge_files(named).select("doc_id", "file_no", "ord", "source_file", "type", "char_start")


@query("""
WITH c AS (SELECT DISTINCT conv_id // 4 AS doc_id, conv_id % 4 AS file_no, count(*) OVER (PARTITION BY conv_id) + 1 AS n FROM conversations),
r AS (SELECT doc_id, file_no, n, coalesce(sum(n) OVER (PARTITION BY doc_id ORDER BY file_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM c)
SELECT doc_id, 'f' || file_no AS source_file, s::INTEGER AS block_start, (s + n)::INTEGER AS block_end FROM r""")
def file_block_ranges(spark, sf_dir):
    """WN-15."""
    c = turns(spark, sf_dir)
    named = c.select((F.floor(F.col("doc_id") / 4)).alias("doc_id"), (F.col("doc_id") % 4).cast("int").alias("file_no"), "ord", F.concat(F.lit("f"), F.col("doc_id") % 4).alias("source_file"), "text")
    return blocks.file_ranges(blocks.merge_files(named)).select("doc_id", "source_file", F.col("block_start").cast("int").alias("block_start"), F.col("block_end").cast("int").alias("block_end"))


@query("""
WITH c AS (SELECT conv_id AS doc_id, turn::INTEGER AS ord, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level FROM conversations)
SELECT doc_id, ord, level, coalesce((SELECT min(n.ord) FROM c n WHERE n.doc_id = c.doc_id AND n.ord > c.ord AND n.level <= c.level), (SELECT max(n.ord) + 1 FROM c n WHERE n.doc_id = c.doc_id)) AS block_end,
  (SELECT max(n.ord) FROM c n WHERE n.doc_id = c.doc_id AND n.ord < c.ord AND n.level < c.level) AS parent FROM c""")
def section_intervals(spark, sf_dir):
    """WN-4, SF-14."""
    return structure.sections(turns(spark, sf_dir)).select("doc_id", "ord", "level", "block_end", "parent")


@query("""
SELECT r_regionkey::BIGINT AS doc_id, r_name AS path, 1 AS depth FROM region
UNION ALL SELECT r_regionkey, r_name || ' > ' || n_name, 2 FROM region JOIN nation ON n_regionkey = r_regionkey
UNION ALL SELECT r_regionkey, r_name || ' > ' || n_name || ' > ' || s_name, 3 FROM region JOIN nation ON n_regionkey = r_regionkey JOIN supplier ON s_nationkey = n_nationkey""")
def section_paths(spark, sf_dir):
    """WN-5, WN-6: regions, nations and suppliers as headings of three levels."""
    region, nation, supplier = (read(spark, sf_dir, t) for t in ("region", "nation", "supplier"))
    heads = region.select("r_regionkey", F.lit(-1).alias("n"), F.lit(-1).cast("long").alias("s"), F.lit(1).alias("level"), F.col("r_name").alias("text"))
    heads = heads.union(nation.select("n_regionkey", "n_nationkey", F.lit(-1).cast("long"), F.lit(2), "n_name"))
    heads = heads.union(supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_regionkey", "n_nationkey", "s_suppkey", F.lit(3), "s_name"))
    from pyspark.sql import Window

    ordered = heads.select(F.col("r_regionkey").cast("long").alias("doc_id"), (F.row_number().over(Window.partitionBy("r_regionkey").orderBy("n", "s")) - 1).alias("ord"), "level", "text")
    return structure.section_paths(structure.sections(ordered), 3).select("doc_id", "path", "depth")


def zone_rows(spark, sf_dir):
    ids = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id")).distinct()
    a = ids.filter("doc_id % 3 = 0").selectExpr("doc_id", "0 block_start", "2 block_end")
    return a.union(ids.filter("doc_id % 2 = 0").selectExpr("doc_id", "1 block_start", "4 block_end"))


@query("""
WITH z AS (SELECT DISTINCT conv_id, 0 AS s, 2 AS e FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT conv_id, 1, 4 FROM conversations WHERE conv_id % 2 = 0)
SELECT c.conv_id AS doc_id, c.turn::INTEGER AS ord, z.s AS block_start, z.e AS block_end FROM conversations c JOIN z ON z.conv_id = c.conv_id AND c.turn >= z.s AND c.turn < z.e""")
def zone_blocks(spark, sf_dir):
    """PF-1, JN-2."""
    return structure.within(turns(spark, sf_dir), zone_rows(spark, sf_dir)).select("doc_id", "ord", "block_start", "block_end")


@query("""
WITH z AS (SELECT DISTINCT conv_id, 0 AS s, 2 AS e FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT conv_id, 1, 4 FROM conversations WHERE conv_id % 2 = 0)
SELECT c.conv_id AS doc_id, z.s AS block_start, z.e AS block_end, (min(c.turn // 2) FILTER (c.turn // 2 > 0))::BIGINT AS page_start, (max(c.turn // 2) FILTER (c.turn // 2 > 0))::BIGINT AS page_end
FROM conversations c JOIN z ON z.conv_id = c.conv_id AND c.turn >= z.s AND c.turn < z.e GROUP BY 1, 2, 3""")
def zone_pages(spark, sf_dir):
    """AG-17: two turns a page, the first page without a number."""
    return structure.zone_pages(zone_rows(spark, sf_dir), turns(spark, sf_dir).withColumn("page_no", F.floor(F.col("ord") / 2)))


@query("""
WITH z AS (SELECT DISTINCT conv_id, 0 AS s, 2 AS e FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT conv_id, 1, 4 FROM conversations WHERE conv_id % 2 = 0),
t AS (SELECT conv_id, turn, EXISTS (SELECT 1 FROM z WHERE z.conv_id = c.conv_id AND c.turn >= z.s AND c.turn < z.e) AS near FROM conversations c WHERE role <> 'user')
SELECT conv_id AS doc_id, turn::INTEGER AS ord, row_number() OVER (PARTITION BY conv_id ORDER BY NOT near, turn)::INTEGER AS place FROM t""")
def zone_tables_first(spark, sf_dir):
    """TK-10: turns of others than users as tables."""
    tables = turns(spark, sf_dir).filter("role <> 'user'").select("doc_id", "ord")
    return structure.zone_first(tables, zone_rows(spark, sf_dir)).select("doc_id", "ord", "place")


@query("""
WITH z AS (SELECT DISTINCT conv_id, 0 AS s, 2 AS e FROM conversations WHERE conv_id % 3 = 0 UNION ALL SELECT DISTINCT conv_id, 1, 4 FROM conversations WHERE conv_id % 2 = 0),
h AS (SELECT DISTINCT c.conv_id, c.turn FROM conversations c JOIN z ON z.conv_id = c.conv_id AND c.turn >= z.s AND c.turn < z.e)
SELECT conv_id AS doc_id, turn::INTEGER AS ord FROM h
UNION ALL SELECT conv_id, turn::INTEGER FROM conversations WHERE conv_id NOT IN (SELECT conv_id FROM h)""")
def zone_blocks_fallback(spark, sf_dir):
    """JN-3."""
    return structure.within_or_all(turns(spark, sf_dir), zone_rows(spark, sf_dir)).select("doc_id", "ord")


def tender_blocks(spark, sf_dir):
    """R-5: six blocks a customer, three chapters; even customers have a scoring paragraph."""
    rows = F.array(
        *(
            F.struct(F.lit(i).alias("ord"), F.lit(level).alias("level"), said.alias("text"))
            for i, (level, said) in enumerate(
                (
                    (1, F.lit("第一章 招标公告")), (0, F.concat(F.lit("项目名称："), F.col("c_name"))), (1, F.lit("第二章 投标人须知")),
                    (0, F.lit("正文")), (1, F.lit("第三章 评标办法")), (0, F.when(F.col("c_custkey") % 2 == 0, "评分标准如下").otherwise("正文")),
                )
            )
        )
    )
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.explode(rows).alias("b")).select("doc_id", "b.*")


@query("""
SELECT c_custkey AS doc_id, zone, s AS block_start, e AS block_end, title FROM customer, (VALUES ('notice', 0, 2, '第一章 招标公告'), ('instructions', 2, 4, '第二章 投标人须知'), ('evaluation_method', 4, 6, '第三章 评标办法')) v(zone, s, e, title)
UNION ALL SELECT c_custkey, 'scoring', 5, 6, '评分标准如下' FROM customer WHERE c_custkey % 2 = 0""")
def anchor_zones(spark, sf_dir):
    """JN-4, WN-3."""
    return structure.zones(tender_blocks(spark, sf_dir)).select("doc_id", "zone", "block_start", "block_end", "title")


@query("""
SELECT c_custkey AS doc_id, ord, title, 1 AS level FROM customer, (VALUES (1, '第一章 招标公告'), (3, '第二章 投标人须知'), (5, '第三章 评标办法')) v(ord, title)""")
def innermost_sections(spark, sf_dir):
    """JN-1: the section around each block of text."""
    found = tender_blocks(spark, sf_dir)
    return structure.deepest_section(found.filter("level = 0").select("doc_id", "ord"), structure.sections(found))


@query(r"""
WITH RECURSIVE l AS (
  SELECT doc_id, line, row_number() OVER (PARTITION BY doc_id ORDER BY k) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents) WHERE trim(line) <> ''
), f AS (
  SELECT doc_id, n, 0 AS chunk, length(line) AS size FROM l WHERE n = 1
  UNION ALL
  SELECT l.doc_id, l.n, CASE WHEN f.size + 1 + length(l.line) <= 480 THEN f.chunk ELSE f.chunk + 1 END, CASE WHEN f.size + 1 + length(l.line) <= 480 THEN f.size + 1 + length(l.line) ELSE length(l.line) END
  FROM f JOIN l ON l.doc_id = f.doc_id AND l.n = f.n + 1
)
SELECT f.doc_id, f.chunk AS chunk_no, count(*)::BIGINT AS n_lines, md5(string_agg(l.line, chr(10) ORDER BY f.n)) AS text_md5 FROM f JOIN l USING (doc_id, n) GROUP BY f.doc_id, f.chunk""")
def chunk_budget(spark, sf_dir):
    """WN-7."""
    return chunks.pack_lines(read(spark, sf_dir, "documents")).select("doc_id", "chunk_no", "n_lines", F.md5("text").alias("text_md5"))


@query("""
WITH RECURSIVE c AS (SELECT conv_id AS doc_id, turn::INTEGER AS ord, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level, text FROM conversations),
s AS (SELECT doc_id, ord AS section, coalesce((SELECT min(n.ord) FROM c n WHERE n.doc_id = c.doc_id AND n.ord > c.ord AND n.level <= c.level), (SELECT max(n.ord) + 1 FROM c n WHERE n.doc_id = c.doc_id)) AS block_end FROM c),
b AS (SELECT s.doc_id, section, c.ord, c.text, row_number() OVER (PARTITION BY s.doc_id, section ORDER BY c.ord) AS n FROM s JOIN c ON c.doc_id = s.doc_id AND c.ord >= section AND c.ord < block_end WHERE c.text <> ''),
f AS (SELECT doc_id, section, ord, text, n, 0 AS child, length(text) AS size FROM b WHERE n = 1
  UNION ALL SELECT b.doc_id, b.section, b.ord, b.text, b.n, CASE WHEN f.size + length(b.text) > 480 THEN f.child + 1 ELSE f.child END, CASE WHEN f.size + length(b.text) > 480 THEN length(b.text) ELSE f.size + length(b.text) END
  FROM f JOIN b ON b.doc_id = f.doc_id AND b.section = f.section AND b.n = f.n + 1),
p AS (SELECT doc_id, section, -1 AS child, substr(string_agg(text, chr(10) ORDER BY ord), 1, 4400) AS text, min(ord) AS first_ord, max(ord) AS last_ord FROM b GROUP BY 1, 2
  UNION ALL SELECT doc_id, section, child, string_agg(text, chr(10) ORDER BY ord), min(ord), max(ord) FROM f GROUP BY 1, 2, 3)
SELECT doc_id, section, child, md5(text) AS text_md5, first_ord, last_ord,
  'c-' || lpad((row_number() OVER (PARTITION BY doc_id ORDER BY section, child))::VARCHAR, 5, '0') AS chunk_id FROM p""")
def section_chunks(spark, sf_dir):
    """WN-7: a parent and its children for each section, nested ones too."""
    b = turns(spark, sf_dir)
    made = chunks.section_chunks(b, structure.sections(b))
    return made.select("doc_id", "section", "child", F.md5("text").alias("text_md5"), "first_ord", "last_ord", "chunk_id")


@query("""
SELECT conv_id AS doc_id, (turn // 4)::INTEGER AS chunk_no, md5(string_agg(text, chr(10) ORDER BY turn)) AS text_md5, count(*)::BIGINT AS n_blocks FROM conversations GROUP BY 1, 2""")
def window_chunks(spark, sf_dir):
    """WN-7: documents without sections: windows of blocks."""
    return chunks.block_windows(turns(spark, sf_dir), 4).select("doc_id", "chunk_no", F.md5("text").alias("text_md5"), "n_blocks")


@query("""
WITH c AS (SELECT DISTINCT conv_id, k AS chunk_no FROM conversations, (VALUES (0), (1)) v(k))
SELECT c.conv_id AS doc_id, chunk_no, string_agg(DISTINCT (t.turn // 2)::VARCHAR, ',' ORDER BY (t.turn // 2)::VARCHAR) AS page_nos FROM c JOIN conversations t ON t.conv_id = c.conv_id AND t.turn >= chunk_no * 3 AND t.turn < chunk_no * 3 + 3 GROUP BY ALL""")
def chunk_pages(spark, sf_dir):
    """AG-12."""
    b = turns(spark, sf_dir).withColumn("page_no", F.floor(F.col("ord") / 2))
    c = b.select("doc_id").distinct().withColumn("chunk_no", F.explode(F.array(F.lit(0), F.lit(1)))).selectExpr("*", "chunk_no * 3 block_start", "chunk_no * 3 + 3 block_end")
    return chunks.pages_of(c, b).select("doc_id", "chunk_no", F.array_join("page_nos", ",").alias("page_nos"))


@query("""
SELECT conv_id, turn, string_agg(role, '|') OVER w AS context, count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)::BIGINT AS at_row
FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)""")
def evidence_context(spark, sf_dir):
    """WN-12."""
    return evidence.row_context(read(spark, sf_dir, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "context", F.col("at").alias("at_row"))


def held_quotes(spark, sf_dir):
    """Benchmark passages met with the documents that hold them, white space aside."""
    items, docs = read(spark, sf_dir, "benchmark"), read(spark, sf_dir, "documents")
    found = quotes.held(docs.select(F.col("doc_id").alias("id"), F.col("text").alias("said")), items.select(F.col("item_id").alias("id"), F.col("text").alias("said")))
    return found.select(F.col("text_id").alias("doc_id"), F.col("quote_id").alias("item_id"), "dense_at")


QUOTES_SQL = r"FROM documents d JOIN benchmark b ON instr(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) > 0"


@query(rf"SELECT d.doc_id, b.item_id, instr(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g'))::BIGINT AS dense_at {QUOTES_SQL}")
def quote_verify(spark, sf_dir):
    """SF-53, and the first half of SF-49: the text has the quote."""
    return held_quotes(spark, sf_dir).select("doc_id", "item_id", F.col("dense_at").cast("long").alias("dense_at"))


@query("""
SELECT d.doc_id, b.item_id, md5(substr(d.text, greatest(instr(d.text, b.text) - 120, 1), instr(d.text, b.text) - greatest(instr(d.text, b.text) - 120, 1) + length(b.text) + 120)) AS context_md5,
  (instr(d.text, b.text) - greatest(instr(d.text, b.text) - 120, 1))::BIGINT AS offset_in FROM documents d JOIN benchmark b ON contains(d.text, b.text)""")
def quote_context(spark, sf_dir):
    """WN-13."""
    pairs = held_quotes(spark, sf_dir).select("doc_id", "item_id")
    said = read(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote"))
    met = read(spark, sf_dir, "documents").select("doc_id", "text").join(pairs, "doc_id").join(said, "item_id").filter(F.contains("text", F.col("quote")))
    near = text.around(F.col("text"), F.instr("text", F.col("quote")), F.length("quote"))
    return met.select("doc_id", "item_id", near.alias("n")).select("doc_id", "item_id", F.md5("n.context").alias("context_md5"), F.col("n.offset").cast("long").alias("offset_in"))


@query(r"""
WITH p AS (SELECT item_id, substr(regexp_replace(text, '\s+', '', 'g'), 1, 24) AS probe FROM benchmark)
SELECT d.doc_id % 10 AS doc_id, p.item_id AS block_id, min(d.doc_id)::BIGINT AS page_no FROM documents d JOIN p ON contains(regexp_replace(d.text, '\s+', '', 'g'), p.probe) GROUP BY 1, 2""")
def page_anchor(spark, sf_dir):
    """JN-11: documents are the pages of ten documents, passages the probes of each."""
    items = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("block_id"), "text")
    pages = read(spark, sf_dir, "documents").select((F.col("doc_id") % 10).alias("doc_id"), F.col("doc_id").alias("page_no"), "text")
    return evidence.first_pages(items, pages)


@query("""
SELECT conv_id AS doc_id, turn, 'e-' || conv_id || '-' || lpad((row_number() OVER (PARTITION BY conv_id ORDER BY turn))::VARCHAR, 5, '0') AS evidence_id, md5(substr(text, 1, 200)) AS snippet_md5 FROM conversations""")
def evidence_registry(spark, sf_dir):
    """DM-3, TK-7, HL-4."""
    rows = turns(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("turn"), F.col("text").alias("snippet"))
    return evidence.register(rows, ["turn"]).select("doc_id", "turn", "evidence_id", F.md5("snippet").alias("snippet_md5"))


@query("""
SELECT o_custkey AS doc_id, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN 'b' || o_orderstatus WHEN o_orderkey % 3 = 1 THEN 't' || o_orderpriority END AS source_file FROM orders""")
def evidence_sources(spark, sf_dir):
    """JN-10, JN-12: sources by block, else by table, else none."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("n"), "o_orderstatus", "o_orderpriority")
    key = F.concat_ws("-", "doc_id", "n")
    found = orders.select("doc_id", "n", F.when(F.col("n") % 3 == 0, key).alias("block_id"), F.when(F.col("n") % 3 == 1, key).alias("table_id"))
    b = orders.filter("n % 3 = 0").select("doc_id", key.alias("block_id"), F.concat(F.lit("b"), "o_orderstatus").alias("source_file"))
    t = orders.filter("n % 3 = 1").select("doc_id", key.alias("table_id"), F.concat(F.lit("t"), "o_orderpriority").alias("source_file"))
    return evidence.with_sources(found, b, t).select("doc_id", "n", "source_file")


@query("""
SELECT conv_id AS doc_id, turn, (turn * 10)::BIGINT AS char_start, (turn * 10 % 20 + (turn * 10 // 20) * 100)::BIGINT AS main_char_start FROM conversations""")
def main_offsets(spark, sf_dir):
    """JN-22: spans of 20 characters that lie 100 apart in the main text."""
    c = turns(spark, sf_dir).select("doc_id", F.col("ord").cast("long").alias("turn"), (F.col("ord") * 10).cast("long").alias("char_start"))
    spans = c.groupBy("doc_id").agg(F.max("char_start").alias("m")).selectExpr("doc_id", "explode(sequence(0L, m div 20)) k").selectExpr("doc_id", "k * 20 start", "k * 20 + 20 end", "k * 100 main_start")
    return evidence.to_main(c, spans).select("doc_id", "turn", "char_start", "main_char_start")


@query(r"SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(text, '[。；;\n]'), lambda s: trim(s)), lambda s: length(s) >= 4)) AS sentence FROM documents")
def sentence_explode(spark, sf_dir):
    """SF-15."""
    return read(spark, sf_dir, "documents").select("doc_id", F.explode(text.sentences(F.col("text"))).alias("sentence"))


KEYWORDS = ("License", "token", "idiot", "Public", "the")


@query(f"SELECT doc_id, array_to_string(list_filter({list(KEYWORDS)}, lambda k: contains(text, k)), ',') AS found FROM documents")
def proof_keywords(spark, sf_dir):
    """SF-26."""
    return read(spark, sf_dir, "documents").select("doc_id", F.array_join(text.contained(KEYWORDS, F.col("text")), ",").alias("found"))


@query(r"""
SELECT doc_id, round(CASE WHEN length(regexp_replace(text, '\s', '', 'g')) = 0 THEN 0 ELSE len(list_distinct(string_split(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g'), ''))) / length(regexp_replace(text, '[ \t\n\r\f\v]', '', 'g')) END, 6) AS diversity FROM documents""")
def diversity_ratio(spark, sf_dir):
    """PF-3."""
    return read(spark, sf_dir, "documents").select("doc_id", F.round(text.diversity(F.col("text")), 6).alias("diversity"))


@query("""
SELECT p_partkey, 3::BIGINT AS n_rows, 'Name|' || p_name || ';Brand|' || p_brand || ';Size|' || p_size AS shown FROM part""")
def html_rows(spark, sf_dir):
    """SF-17, R-14."""
    row = lambda label, c: F.concat(F.lit(f"<tr class='r'><th>{label}</th>\n<td><b>"), F.col(c).cast("string"), F.lit("</b> </td></tr>"))
    html = F.concat(F.lit("<table>"), row("Name", "p_name"), row("Brand", "p_brand"), row("Size", "p_size"), F.lit("</table>"))
    rows = text.html_rows(html)
    return read(spark, sf_dir, "part").select("p_partkey", F.size(rows).cast("long").alias("n_rows"), F.array_join(F.transform(rows, lambda r: F.array_join(r, "|")), ";").alias("shown"))


@query("""
SELECT event_id, json_extract_string(props, '$.k') AS k FROM events""")
def loose_json(spark, sf_dir):
    """SF-48, R-13: JSON in prose and code fences."""
    noisy = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("Here it is:\n```json\n"), "props", F.lit("\n```\nDone."))).otherwise(F.col("props"))
    return read(spark, sf_dir, "events").select("event_id", F.get_json_object(text.loose_json(noisy), "$.k").alias("k"))


@query(r"""
SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE contains(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')))""")
def coverage_audit(spark, sf_dir):
    """Documents that hold no passage whole: anti join by the hash join of quotes."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    return docs.join(held_quotes(spark, sf_dir).select("doc_id").distinct(), "doc_id", "left_anti")


@query(r"""
WITH u AS (SELECT page_id, url FROM pages UNION ALL SELECT page_id, 'http://' || (page_id % 256) || '.' || (page_id * 7 % 256) || '.0.1:80/' FROM pages UNION ALL SELECT page_id, 'ftp://x.example/' || page_id FROM pages UNION ALL SELECT page_id, 'http://localhost/' || page_id FROM pages),
o AS (SELECT *, TRY_CAST(regexp_extract(url, '^http://(\d+)\.(\d+)\.', 1) AS INTEGER) AS a, TRY_CAST(regexp_extract(url, '^http://(\d+)\.(\d+)\.', 2) AS INTEGER) AS b FROM u)
SELECT page_id, url, NOT (url LIKE 'ftp%' OR url LIKE 'http://localhost/%' OR coalesce(a IN (0, 10, 127) OR (a = 172 AND b BETWEEN 16 AND 31) OR (a = 192 AND b = 168) OR (a = 169 AND b = 254) OR (a = 100 AND b BETWEEN 64 AND 127)
  OR (a = 192 AND b = 0) OR (a = 198 AND b IN (18, 19)) OR a >= 224, false)) AS public FROM o""")
def url_guard(spark, sf_dir):
    """PF-22."""
    from ..functions.validators import is_public_url

    pages = read(spark, sf_dir, "pages").select("page_id", "url")
    ip = pages.select("page_id", F.concat(F.lit("http://"), F.col("page_id") % 256, F.lit("."), F.col("page_id") * 7 % 256, F.lit(".0.1:80/")))
    more = pages.select("page_id", F.concat(F.lit("ftp://x.example/"), "page_id")).union(pages.select("page_id", F.concat(F.lit("http://localhost/"), "page_id")))
    return pages.union(ip).union(more).withColumn("public", is_public_url(F.col("url")))


@query("SELECT o_orderkey, o_orderdate::DATE::VARCHAR AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def recent_reports(spark, sf_dir):
    """SRC-16, TK-9: a top-100 report."""
    return read(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), "o_orderkey").limit(100).select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("SELECT p_partkey, p_name, (SELECT count(*) FROM part WHERE p_size >= 20)::BIGINT AS total FROM part WHERE p_size >= 20 ORDER BY p_partkey LIMIT 50 OFFSET 100")
def report_page(spark, sf_dir):
    """TK-6: the third page of 50 and the total before paging."""
    return files.page(read(spark, sf_dir, "part").filter("p_size >= 20").select("p_partkey", "p_name"), ["p_partkey"], page=3, size=50)


@query(r"""
SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END::INTEGER AS version, (len(string_split(text, chr(10))) + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END)::BIGINT AS n_lines FROM documents""")
def incremental_stage(spark, sf_dir):
    """SNK-1, SRC-15, DM-4, AP-9: lines by document; a third of the texts then gets one more, and only these are done again."""
    path = shared_path(spark, "stage")
    lines = lambda docs: docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    hashed = lambda docs: docs.withColumn("content_hash", F.sha2("text", 256))
    docs = hashed(read(spark, sf_dir, "documents").select("doc_id", "text"))
    later = hashed(docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\nmore"))).otherwise(F.col("text")).alias("text")))
    for now in (docs, later):
        stages.run(now, path, "1", lines)
    return stages.rows(later, path, "1").groupBy("doc_id", "version").agg(F.count(F.lit(1)).alias("n_lines"))


@query(r"""
WITH m AS (SELECT d.doc_id, b.item_id, string_split(d.text, '') AS c, instr(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) AS pos, length(regexp_replace(b.text, '\s+', '', 'g')) AS n FROM documents d JOIN benchmark b ON instr(regexp_replace(d.text, '\s+', '', 'g'), regexp_replace(b.text, '\s+', '', 'g')) > 0),
v AS (SELECT doc_id, item_id, pos, n, list_filter(range(1, len(c) + 1), lambda i: NOT regexp_matches(c[i], '\s')) AS p FROM m)
SELECT doc_id, item_id, (p[pos] - 1)::BIGINT AS char_start, p[pos + n - 1]::BIGINT AS char_end FROM v""")
def quote_spans(spark, sf_dir):
    """SF-49: where the passages that documents hold, white space aside, stand in their texts as they are."""
    said = read(spark, sf_dir, "benchmark").select("item_id", F.length(text.dense(F.col("text"))).alias("n"))
    met = held_quotes(spark, sf_dir).join(said, "item_id").join(read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return model.raw_spans(met.select("doc_id", "item_id", "text", F.col("dense_at").cast("int").alias("dense_at"), "n"))


def stub_answers(asked):
    """What stands for a model: by document a good answer, a quote that is not there, a value that its
    quote has not, and no answer at all."""
    out = []
    for r in asked:
        number, case = f"139{r['doc_id']:08d}", r["doc_id"] % 4
        if case == 3:
            raise TimeoutError("no answer")
        quote = ("致电" if case == 1 else "联系") + ("另行通知" if case == 2 else number)
        out.append("answer: " + model.as_json({"contact_phone": (number, quote), "site": ("nowhere", "nothing")}))
    return out


@query(r"""
SELECT doc_id, 'contact_phone' AS field_key, CASE WHEN doc_id % 4 = 0 THEN '139' || lpad(doc_id::VARCHAR, 8, '0') END AS value_normalized,
  CASE WHEN doc_id % 4 = 0 THEN length(text) + 1 END::BIGINT AS char_start, CASE WHEN doc_id % 4 = 0 THEN length(text) + 16 END::BIGINT AS char_end, CASE WHEN doc_id % 4 = 0 THEN 0.72 END::DOUBLE AS confidence,
  CASE doc_id % 4 WHEN 1 THEN 'quote is not in the text' WHEN 2 THEN 'value is not in the quote' WHEN 3 THEN 'TimeoutError: no answer' END AS reason FROM documents""")
def model_fields(spark, sf_dir):
    """FX-7, SF-48, SF-49, UX-5, UX-6: a phone number that the rules do not find, asked of a model that a plain function stands for."""
    number = F.concat(F.lit("139"), F.lpad(F.col("doc_id").cast("string"), 8, "0"))
    tail = F.when(F.col("doc_id") % 4 == 2, F.lit("\n联 系\n另行通知")).otherwise(F.concat(F.lit("\n联 系\n"), number))
    docs = read(spark, sf_dir, "documents").select("doc_id", F.concat("text", tail).alias("text"))
    none = spark.createDataFrame([], "doc_id long, field_key string, status string")
    asked = model.requests(docs.withColumn("ord", F.lit(0)), none, keys=["contact_phone"])
    checked = model.quoted(model.answers(asked, stub_answers), docs, asked)
    return checked.select("doc_id", "field_key", "value_normalized", "char_start", "char_end", "confidence", "reason")


@query("SELECT n_nationkey::BIGINT AS doc_id, n_name AS file_name FROM nation WHERE n_nationkey % 5 <> 0")
def stored_reports(spark, sf_dir):
    """SRC-16: reports stored as JSON files, a fifth of them cut off; the listing passes those over."""
    path = shared_path(spark, "reports")
    whole = F.to_json(F.struct(F.col("n_nationkey").alias("doc_id"), F.col("n_name").alias("file_name")))
    said = F.when(F.col("n_nationkey") % 5 == 0, F.substring(whole, 1, 20)).otherwise(whole)
    read(spark, sf_dir, "nation").select("n_nationkey", said.alias("value")).write.partitionBy("n_nationkey").text(path)
    return files.recent(spark, path, "doc_id long, file_name string", "*.txt").select("doc_id", "file_name")
