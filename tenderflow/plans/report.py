"""The corpus plan: blocks and tables to all frames of a report, all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring
from ..operators import blocks as block_ops
from ..operators import chunks, evidence, fields, lots, outline, requirements, review, score_items, scores, structure
from ..operators import ledger as ledgers
from ..operators.rules import BUILT_IN, Rules
from ..settings import Settings

#: A place after all blocks, for tables of which none is known.
LAST = 1 << 30
# Fields that a report must have.
REQUIRED = ("project_name", "tender_no", "tenderer", "bid_deadline")
SHOWN_LOT_FIELDS = ("package_name", "apply_no", "scope", "site", "duration", "price_limit", "unit_price_limit", "lot_price_limit", "project_name")
MOST_REQUIREMENTS, CONSTRAINT_SHOWN = 60, 160


def field_zones(blocks: DataFrame, zones: DataFrame, rules: Rules = BUILT_IN) -> DataFrame:
    """UX-3: doc_id, ord and field_key of the blocks in each field's preferred zones."""
    near = structure.within(blocks.select("doc_id", "ord"), zones).select("doc_id", "ord", "zone")
    wanted = fields.listed([*rules.packs], [F.col("zone").isin(*p.zones) for p in rules.packs.values()])
    return near.select("doc_id", "ord", F.explode(wanted).alias("field_key")).filter("field_key <> ''")


def statistics(blocks: DataFrame, fields_total: int, **parts: DataFrame) -> DataFrame:
    """AG-6: counts of what a report holds, one row a document; each part is counted before they meet."""
    count = lambda frame, name: frame.groupBy("doc_id").agg(F.count(F.lit(1)).alias(name))
    out = count(blocks, "blocks")
    for name, frame in parts.items():
        out = out.join(count(frame, name), "doc_id", "left")
    return out.select("doc_id", "blocks", *(F.coalesce(name, F.lit(0).cast("long")).alias(name) for name in parts), F.lit(fields_total).cast("long").alias("fields_total"))


def table_cells(rows: DataFrame) -> DataFrame:
    """A row for each cell; ord is the table's block where the rows have it."""
    ord_ = F.col("ord").cast("int") if "ord" in rows.columns else F.lit(LAST)
    return rows.select("doc_id", ord_.alias("ord"), "table_id", "row", F.posexplode("cells").alias("col", "text"))


def rejection_rows(rows: DataFrame) -> DataFrame:
    """PF-17: the rows of rejection tables, the first one marked."""
    facts = rows.groupBy("doc_id", "table_id").agg(F.array_join(F.max(F.when(F.col("row") == 0, F.col("cells"))), "").alias("header"), F.count(F.lit(1)).alias("n"))
    chosen = facts.filter(scoring.is_rejection_table(F.coalesce("header", F.lit("")), F.col("n"))).select("doc_id", "table_id")
    return rows.join(chosen, ["doc_id", "table_id"], "left_semi").withColumn("is_header", F.col("row") == 0)


def lot_frames(blocks: DataFrame, rows: DataFrame, files: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Fields of lots under their canonical names, and the lots with their projects.

    Lot tables come first; what the files of a lot say, and the project in their titles, comes with
    them. files has doc_id, file_no and source_file, and blocks then file_no and table_ref.
    """
    tables = lots.lot_tables(rows)
    if files is None:
        names = tables.groupBy("doc_id", "lot").agg(F.min("ord").alias("ord"))
        values = lots.merged_lots(tables, names)
        return values, values.groupBy("doc_id", "lot").agg(F.max(F.when(F.col("field_key") == "project_name", F.col("value"))).alias("project"))
    scopes = lots.file_scopes(files, blocks)
    known = scopes.filter("lot is not null").select("doc_id", "lot", "project", F.col("file_no").alias("ord"))
    own = lots.file_fields(blocks, table_cells(rows), scopes).select("doc_id", F.struct(F.lit("").alias("table_id"), F.col("file_no").cast("int").alias("row")).alias("ord"), "lot", "field_key", "value", "confidence")
    values = lots.merged_lots(tables.withColumn("ord", F.struct(F.col("ord.table_id").alias("table_id"), F.col("ord.row").cast("int").alias("row"))).unionByName(own), known)
    titled = known.groupBy("doc_id", "lot").agg(F.min_by("project", "ord").alias("title"))
    info = values.groupBy("doc_id", "lot").agg(F.max(F.when(F.col("field_key") == "project_name", F.col("value"))).alias("found")).join(titled, ["doc_id", "lot"], "full")
    return values, info.select("doc_id", "lot", F.coalesce(F.nullif("title", F.lit("")), "found").alias("project"))


def issues(missing: DataFrame, found: DataFrame, checks: DataFrame, summary: DataFrame | None, threshold: float) -> DataFrame:
    """What a reader must know, a row for each: missing fields, doubtful ones, sums, an open ledger."""
    low = found.filter(F.col("confidence") < threshold)
    out = missing.select("doc_id", F.lit("required_missing").alias("issue"), F.col("field_key").alias("about"))
    out = out.unionByName(low.select("doc_id", F.lit("low_confidence").alias("issue"), F.col("field_key").alias("about")))
    out = out.unionByName(checks.filter("state = 'failed'").select("doc_id", F.lit("sum_failed").alias("issue"), F.concat_ws("/", "category", "lot").alias("about")))
    return out if summary is None else out.unionByName(summary.filter("not gate").select("doc_id", F.lit("ledger_open").alias("issue"), F.col("pending").cast("string").alias("about")))


def analyse(blocks: DataFrame, rows: DataFrame, files: DataFrame | None = None, ledger: DataFrame | None = None, rules: Rules = BUILT_IN, as_of: Column | None = None, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """AP-9: lazy frames by name. Nothing runs until a frame is read or written.

    blocks has doc_id, ord, level and text, rows the tables' doc_id, table_id, row and cells. Where
    blocks have type and table_id, tables get lots, sections and an order from their places; where they
    have source_file, evidence gets its files. files (doc_id, file_no, source_file) adds the fields
    of lots' own files, ledger (doc_id and status) its summary, answers (`model.candidates`) what a
    model found. Dates must lie in the window around as_of, by default the settings' or today.
    """
    settings = Settings.of(blocks.sparkSession)
    today = as_of if as_of is not None else F.lit(settings.as_of).cast("date") if settings.as_of else F.current_date()
    placed = block_ops.char_offsets(blocks)
    tree = structure.sections(blocks)
    zones = structure.zones(blocks, rules.zones, window=settings.zone_window)
    candidates = fields.all_candidates(blocks, field_zones(blocks, zones, rules), table_cells(rows), rules)
    if answers is not None:
        candidates = candidates.unionByName(answers.select(*candidates.columns))
    found = fields.merged(candidates, today)
    conflicts = fields.conflicts(candidates, ["doc_id", "field_key"], "value_normalized", "confidence")
    where = blocks if {"type", "table_id"} <= set(blocks.columns) else None
    items, totals = score_items.extract(rows, where, tree, zones)
    checks = score_items.checks(items, totals)
    asked = requirements.build(blocks, items, rows, zones)
    stars, rejected = requirements.star_clauses(blocks), requirements.rejections(rejection_rows(rows))
    lot_values, lot_info = lot_frames(blocks, rows, files)
    targets = lots.target(lot_info)
    scoped = items.join(targets, "doc_id", "left").withColumn("kept", F.coalesce(lots.lots.applies(F.col("lot"), F.col("target_lot")) != "other", F.lit(True)))
    named = scoped.filter("kept and category in ('technical', 'commercial')").select("doc_id", F.col("category").alias("bucket"), F.col("score_id").alias("ord"), "name")
    titles, added = outline.bid_outline(tree, named)
    proof = candidates.select("doc_id", "ord", "field_key", F.col("value_raw").alias("snippet")).unionByName(items.select("doc_id", F.lit(LAST).alias("ord"), F.col("score_id").alias("field_key"), "snippet"))
    registered = evidence.register(proof, ["ord", "field_key"])
    if {"source_file", "block_id"} <= set(blocks.columns):
        by_place = blocks.select("doc_id", "ord", "block_id")
        no_tables = blocks.select("doc_id", F.lit(None).cast("string").alias("table_id"), "source_file").limit(0)
        registered = evidence.with_sources(registered.join(by_place, ["doc_id", "ord"], "left").withColumn("table_id", F.lit(None).cast("string")), blocks, no_tables)
    choices = candidates.groupBy("doc_id", "field_key").agg(F.array_sort(F.collect_set("value_normalized")).alias("candidate_values"))
    doubtful = found.join(choices, ["doc_id", "field_key"]).withColumnRenamed("value_normalized", "value")
    missing = fields.required_missing(found, blocks, REQUIRED)
    summary = None if ledger is None else ledgers.summary(ledger, "doc_id")
    out = {
        "blocks": placed,
        "sections": tree,
        "section_paths": structure.section_paths(tree, 3),
        "zones": zones,
        "chunks": chunks.section_chunks(blocks, tree, settings.child_chars),
        "block_windows": chunks.block_windows(blocks.join(tree.select("doc_id").distinct(), "doc_id", "left_anti")),
        "candidates": candidates,
        "fields": found,
        "all_fields": fields.with_defaults(found, blocks, tuple(rules.packs)),
        "conflicts": conflicts,
        "evidence": registered,
        "scores": items,
        "declared_totals": totals,
        "score_checks": checks,
        "requirements": asked.withColumn("label", scoring.usage_label(F.col("for_scoring"), F.col("for_document"), F.col("type"))),
        "performances": requirements.performances(blocks),
        "star_clauses": stars,
        "rejections": rejected,
        "lot_fields": lot_values,
        "lots": lot_info,
        "targets": targets,
        "outline": titles,
        "outline_added": added,
        "review": review.open_items(doubtful, conflicts, settings.review_threshold),
        "missing": missing,
        "issues": issues(missing, found, checks, summary, settings.review_threshold),
        "statistics": statistics(blocks, len(rules.packs), tables=rows.select("doc_id", "table_id").distinct(), fields_found=found, score_items=items, requirements=asked, star_clauses=stars, lots=lot_info),
    }
    return out if summary is None else out | {"ledger": summary}


def selected(frames: dict[str, DataFrame], doc_id=None, lot: str | None = None, category: str | None = None, sections: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """PF-19: the named frames of a report (all without names), of a document, with the scores of a
    category, and scores and fields of a lot or of what may apply to it."""
    out = {}
    for name, frame in frames.items():
        if sections and name not in sections:
            continue
        if doc_id is not None:
            frame = frame.filter(F.col("doc_id") == doc_id)
        if name == "scores":
            frame = scores.selected(frame, category, lot)
        elif lot is not None and name in ("lot_fields", "lots"):
            frame = frame.filter(F.col("lot") == lot)
        out[name] = frame
    return out


def summary(frames: dict[str, DataFrame], lot: str | None = None) -> dict[str, DataFrame]:
    """AP-4: the four basic fields and target of each document, its lots with their fields as columns,
    and its first requirements with their label, cut; of one lot, or of the target's where none is named."""
    wide = frames["lot_fields"].groupBy("doc_id", "lot").pivot("field_key", [*SHOWN_LOT_FIELDS]).agg(F.first("value"))
    every = frames["lots"].join(wide, ["doc_id", "lot"], "left").join(frames["targets"], "doc_id", "left")
    chosen = every.filter(F.col("lot") == (F.col("target_lot") if lot is None else F.lit(lot)))
    basic = fields.with_defaults(frames["fields"], frames["blocks"], REQUIRED).groupBy("doc_id").pivot("field_key", [*REQUIRED]).agg(F.first("value_normalized")).na.fill("", [*REQUIRED])
    first = frames["requirements"].withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy("req_id"))).filter(F.col("_n") <= MOST_REQUIREMENTS)
    return {
        "basic": basic.join(frames["targets"], "doc_id", "left"),
        "lots": chosen.drop("target_lot"),
        "requirements": first.select("doc_id", "req_id", "type", "label", F.substring("constraint", 1, CONSTRAINT_SHOWN).alias("constraint")),
    }
