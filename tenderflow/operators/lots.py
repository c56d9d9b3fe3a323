"""Lots: fields per lot, canonical names, target lot and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lots
from . import fields

# The form of a lot's name in file names and titles, the words that name the columns of
# lot tables (better ones first), and the confidence of the fields that such tables give.
LOT_NAME = r"(?:结算审核|竣工决算审核|监造|监理|系统调试|科研|工程保险|施工|设计)?包\d{1,2}(?:-\d{1,2})?"

SHORT_NAME = "[A-Z一二三四五六七八九十]{1,2}包"
MONTH = r"(\d{4})\s*年\s*(\d{1,2})\s*月"
COLUMNS = {
    "package_name": (("标包名称", "包名称"), ("标包划分", "分标名称")),
    "package_no": (("包号", "标段号", "包件号"),),
    "fenbiao": (("分标名称", "分标"),),
    "apply_no": (("采购申请号", "申请编号"),),
    "scope": (("招标范围", "服务范围", "工作内容"),),
    "project_name": (("项目名称",),),
    "price_limit": (("最高限价",), ("分项限价",)),
    "unit_price_limit": (("单项最高限价", "单项限价"),),
    "lot_price_limit": (("包最高限价", "包限价"),),
    "start": (("开始时间", "计划开工日期", "计划开始"),),
    "end": (("完成时间", "计划竣工日期", "计划完成"),),
}
TEXT_FIELDS = {"package_no": 0.9, "fenbiao": 0.9, "package_name": 0.9, "apply_no": 0.9, "scope": 0.85, "project_name": 0.9}
PRICE_FIELDS = {"price_limit": 0.95, "unit_price_limit": 0.95, "lot_price_limit": 0.95}
DURATION_CONFIDENCE = 0.9
BLANK = ("", "/", "—", "-", "无")


def header_column(header: Column, primary: tuple[str, ...], secondary: tuple[str, ...] = ()) -> Column:
    """SF-42: the first column whose heading has a primary word, else a secondary one, else null."""
    at = lambda words: F.get(F.filter(F.sequence(F.lit(0), F.size(header) - 1), lambda i: F.rlike(F.get(header, i), F.lit("|".join(words)))), F.lit(0))
    return F.coalesce(at(primary), at(secondary)) if secondary else at(primary)


def file_scopes(files: DataFrame, blocks: DataFrame) -> DataFrame:
    """SF-41: lot and project of each file: the lot in its name, else in its first six filled
    blocks of twelve; the project stands before the lot in such a block. General files give null.

    files has doc_id, file_no, source_file; blocks doc_id, file_no, ord and text, without markers.
    """
    named = files.withColumn("from_name", F.nullif(F.regexp_extract("source_file", LOT_NAME, 0), F.lit("")))
    order = Window.partitionBy("doc_id", "file_no").orderBy("ord")
    head = blocks.withColumn("_n", F.row_number().over(order)).filter("_n <= 12").filter(F.trim("text") != "").withColumn("_k", F.row_number().over(order)).filter("_k <= 6")
    seen = head.select("doc_id", "file_no", "ord", F.nullif(F.regexp_extract("text", LOT_NAME, 0), F.lit("")).alias("lot"), F.regexp_replace(F.regexp_extract("text", f"^(.*?){LOT_NAME}", 1), "^[ 　—-]+|[ 　—-]+$", "").alias("project")).filter("lot is not null")
    both = named.join(seen, ["doc_id", "file_no"], "left")
    fits = F.col("lot").isNotNull() & (F.col("from_name").isNull() | (F.col("from_name") == F.col("lot")))
    best = F.min_by(F.struct("lot", "project"), F.when(fits, F.col("ord")))
    out = both.groupBy("doc_id", "file_no", "source_file", "from_name").agg(best.alias("b"))
    return out.select("doc_id", "file_no", "source_file", F.coalesce("from_name", "b.lot").alias("lot"), F.when(F.length("b.project") >= 6, F.col("b.project")).otherwise("").alias("project"))


def best_values(values: DataFrame, keys: list[str]) -> DataFrame:
    """AG-16: per key the value of the highest confidence, the later one on ties."""
    return values.groupBy(*keys).agg(F.max_by(F.struct("value", "confidence"), F.struct("confidence", "ord")).alias("b")).select(*keys, "b.*")


def table_fields(rows: DataFrame, columns: dict[str, float]) -> DataFrame:
    """SF-43: wide lot table rows to long values: columns gives each field's confidence.

    The lot is `sub-bid::package` where there is a sub-bid, the package otherwise.
    """
    lot = F.when(F.coalesce("fenbiao", F.lit("")) != "", F.concat_ws("::", "fenbiao", "package_no")).otherwise(F.col("package_no"))
    pairs = F.array(*(F.struct(F.lit(k).alias("field_key"), F.col(k).cast("string").alias("value"), F.lit(c).alias("confidence")) for k, c in columns.items()))
    long = rows.select("doc_id", "ord", lot.alias("lot"), F.explode(pairs).alias("p")).select("doc_id", "ord", "lot", "p.*")
    return long.filter("value is not null and value not in ('', '/', '—', '-', '无')")


def lot_tables(rows: DataFrame) -> DataFrame:
    """SF-42, SF-43: doc_id, ord, lot, field_key, value and confidence of all lot tables.

    rows has doc_id, table_id, row and cells, the header row first. A table counts if its header
    names lots and one thing more. The lot is `sub-bid::package number` as far as there are such
    columns, else the name in the lot column. Prices whose header says 万 are in ten thousands.
    """
    by_row = Window.partitionBy("doc_id", "table_id").orderBy("row")
    headed = rows.withColumn("header", F.first("cells").over(by_row)).withColumn("n", F.row_number().over(by_row)).filter("n > 1")
    at = headed.select("*", *(header_column(F.col("header"), *words).alias(f"at_{k}") for k, words in COLUMNS.items()))
    more = [f"at_{k} is not null" for k in ("package_no", "apply_no", "scope", "unit_price_limit", "lot_price_limit", "project_name", "price_limit")]
    kept = at.filter(f"at_package_name is not null and ({' or '.join(more)} or (at_start is not null and at_end is not null))")
    cell = lambda k: F.coalesce(F.trim(F.get("cells", F.col(f"at_{k}"))), F.lit(""))
    read = kept.select("doc_id", "table_id", "row", *(cell(k).alias(k) for k in COLUMNS), *(F.contains(F.get("header", F.col(f"at_{k}")), F.lit("万")).alias(f"wan_{k}") for k in PRICE_FIELDS))

    named = F.coalesce(F.nullif(F.regexp_extract("package_name", LOT_NAME, 0), F.lit("")), F.regexp_extract("package_name", SHORT_NAME, 0))
    by_name = F.when(F.length(named) >= 4, named).otherwise(F.substring("package_name", 1, 40))
    by_number = F.when(F.col("fenbiao") != "", F.concat_ws("::", "fenbiao", "package_no")).otherwise(F.col("package_no"))
    lot = F.regexp_replace(F.when(F.col("package_no") != "", by_number).otherwise(by_name), "[ \t]", "")

    def price(k: str) -> Column:
        raw = F.concat(F.col(k), F.when(F.col(f"wan_{k}") & ~F.contains(k, F.lit("万")), "万元").otherwise(""))
        return F.when(F.rlike(k, F.lit(r"^\d")), fields.cleaned(F.lit("amount"), F.trim(raw)))

    month = lambda k: F.concat(F.regexp_extract(k, MONTH, 1), F.lit("年"), F.regexp_extract(k, MONTH, 2).try_cast("int"), F.lit("月"))
    span = F.when(F.rlike("start", F.lit(MONTH)) & F.rlike("end", F.lit(MONTH)), F.concat(month("start"), F.lit("至"), month("end")))
    value = lambda k, v, c: F.struct(F.lit(k).alias("field_key"), v.alias("value"), F.lit(c).alias("confidence"))
    texts = [value(k, F.substring(k, 1, 60) if k == "package_name" else F.col(k), c) for k, c in TEXT_FIELDS.items()]
    values = F.array(*texts, *(value(k, price(k), c) for k, c in PRICE_FIELDS.items()), value("duration", span, DURATION_CONFIDENCE))
    good = F.filter(values, lambda v: v["value"].isNotNull() & ~v["value"].isin(*BLANK))
    long = read.filter("package_name <> ''").select("doc_id", F.struct("table_id", "row").alias("ord"), lot.alias("lot"), F.explode(good).alias("v"))
    return long.select("doc_id", "ord", "lot", "v.*")


def file_fields(blocks: DataFrame, cells: DataFrame, scopes: DataFrame) -> DataFrame:
    """FX-8, JN-5, JN-21: fields of each lot's own files: candidates of the file's blocks and of the
    tables that they refer to, no others. A project that the file's title names wins.

    blocks has doc_id, file_no, ord, level, text and table_ref; cells is what
    `fields.table_candidates` reads, scopes what `file_scopes` returns.
    """
    lotted = scopes.filter("lot is not null").select("doc_id", "file_no", "lot", "project")
    own = blocks.join(lotted.drop("project"), ["doc_id", "file_no"]).withColumn("part", F.struct("doc_id", "file_no", "lot"))
    referred = own.filter("table_ref is not null").select("doc_id", "part", F.col("table_ref").alias("table_id")).distinct()
    own_cells = cells.join(referred, ["doc_id", "table_id"]).drop("doc_id").withColumnRenamed("part", "doc_id")
    own_blocks = own.select(F.col("part").alias("doc_id"), "ord", "level", "text")
    found = fields.merged(fields.all_candidates(own_blocks, None, own_cells)).select("doc_id.*", "field_key", F.col("value_normalized").alias("value"), "confidence")
    titled = lotted.filter("project <> ''").select("doc_id", "file_no", "lot", F.lit("project_name").alias("field_key"), F.col("project").alias("value"), F.lit(0.9).alias("confidence"))
    return found.join(titled, ["doc_id", "file_no", "lot", "field_key"], "left_anti").unionByName(titled)


def canonical(names: DataFrame, known: DataFrame) -> DataFrame:
    """JN-15: each lot name with the first known name, by `ord` where known has it, of equal
    sub-bid and package number, or itself."""
    keyed = lambda df, name: df.withColumn("_f", lots.sub_bid(F.col(name))["fenbiao"]).withColumn("_n", lots.identity(lots.sub_bid(F.col(name))["bare"]))
    rank = F.col("ord") if "ord" in known.columns else F.col("lot")
    best = keyed(known.select("doc_id", F.col("lot").alias("known"), rank.alias("rank")), "known").groupBy("doc_id", "_f", "_n").agg(F.min_by("known", "rank").alias("known"))
    return keyed(names, "lot").join(best, ["doc_id", "_f", "_n"], "left").withColumn("canonical", F.coalesce("known", "lot")).drop("_f", "_n", "known")


def merged_lots(values: DataFrame, known: DataFrame) -> DataFrame:
    """JN-15: values of lots under their canonical names; what the canonical name has already
    stays, other names only fill its gaps, first ones first."""
    named = canonical(values, known)
    rank = F.struct(F.col("lot") != F.col("canonical"), "ord", "lot")
    best = named.groupBy("doc_id", "canonical", "field_key").agg(F.min_by(F.struct("value", "confidence"), rank).alias("b"))
    return best.select("doc_id", F.col("canonical").alias("lot"), "field_key", "b.*")


def target(names: DataFrame) -> DataFrame:
    """TK-4: the lot of each document to work on."""
    return names.groupBy("doc_id").agg(F.min_by("lot", lots.lot_order(F.col("lot"))).alias("target_lot"))


def for_target(items: DataFrame, targets: DataFrame) -> DataFrame:
    """JN-20: items with applicability to the document's target lot; `other` may be dropped."""
    return items.join(targets, "doc_id").withColumn("scope", lots.applies(F.col("lot"), F.col("target_lot"))).withColumn("kept", F.col("scope") != "other")


def roll_up(items: DataFrame, lot: str, score: str, category: str) -> DataFrame:
    """AG-4: items, total and categories of each lot."""
    return items.groupBy(lot).agg(F.count(F.lit(1)).alias("n_items"), F.round(F.sum(score), 2).alias("total"), F.array_join(F.array_sort(F.collect_set(category)), ",").alias("categories"))
