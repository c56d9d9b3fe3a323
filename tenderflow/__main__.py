"""AP-8, SNK-7: the command line.

    python -m tenderflow query NAME FOLDER [ROWS]        show a named query's rows; without NAME list them
    python -m tenderflow report BLOCKS TABLES OUT        all frames of the reports, Parquet under OUT
    python -m tenderflow listing FOLDER                  the newest stored report files
    python -m tenderflow review list QUEUE               open review items
    python -m tenderflow review resolve QUEUE DECISIONS OUT
    python -m tenderflow review export QUEUE OUT         gold rows, a JSON line a document
    python -m tenderflow evaluate FIELDS GOLD [LEAST]    precision, recall, F1; exit 1 below LEAST

Paths are Parquet but for stored reports; local ones must lie in the folders that
spark.tenderflow.allowed_folders lists, separated by commas, where it is set. A report does only the
documents whose blocks or code version changed since the last one under OUT.
"""

from __future__ import annotations

import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import review
from .plans import catalog, report
from .settings import Settings
from .sinks import stages, tables
from .sources import files

#: Frames of a report that are kept by document; the others are read from their rows.
STORED = ("all_fields", "conflicts", "scores", "score_checks", "requirements", "rejections", "lot_fields", "lots", "outline", "review", "issues", "statistics")


def place(spark: SparkSession, path: str) -> str:
    """The path, if it is allowed."""
    folders = [f for f in Settings.of(spark).allowed_folders.split(",") if f]
    return files.allowed_path(path, folders) if folders else path


def query(spark: SparkSession, name: str = "", folder: str = "", n: str = "20") -> int:
    if name not in catalog.QUERIES or not folder:
        print(*sorted(catalog.QUERIES), sep="\n")
        return 2
    catalog.QUERIES[name](spark, place(spark, folder)).show(int(n), truncate=60)
    return 0


def hashed(blocks: DataFrame) -> DataFrame:
    """doc_id and the hash of its blocks, whatever their order in the table."""
    each = F.sha2(F.to_json(F.struct(*sorted(blocks.columns))), 256)
    return blocks.select("doc_id", each.alias("h")).groupBy("doc_id").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("content_hash"))


def make_report(spark: SparkSession, blocks: str, rows: str, out: str) -> int:
    """Each stored frame is a stage of its own; what is unchanged is not made again."""
    b, r = (spark.read.parquet(place(spark, x)) for x in (blocks, rows))
    docs = hashed(b).withColumn("doc_id", F.col("doc_id").cast("long"))

    def maker(name: str) -> Callable[[DataFrame], DataFrame]:
        def make(todo: DataFrame) -> DataFrame:
            own = todo.select("doc_id")
            return report.analyse(b.join(own, "doc_id", "left_semi"), r.join(own, "doc_id", "left_semi"))[name]

        return make

    for name in STORED:
        version = stages.run(docs, f"{place(spark, out)}/{name}", Settings.of(spark).code_version, maker(name))
        print(f"{name}: {f'version {version}' if version else 'nothing new'}")
    return 0


def listing(spark: SparkSession, folder: str) -> int:
    files.recent(spark, place(spark, folder), "doc_id string, file_name string, generated_at string").show(100, truncate=60)
    return 0


def reviewed(spark: SparkSession, verb: str, queue: str, *more: str) -> int:
    items = spark.read.parquet(place(spark, queue))
    if verb == "list":
        items.filter("status <> 'resolved'").orderBy("doc_id", "field_key").show(100, truncate=60)
    elif verb == "resolve":
        done = review.resolve(items, spark.read.parquet(place(spark, more[0])))
        done.filter("error is null").drop("error").write.parquet(place(spark, more[1]))
        wrong = done.filter("error is not null")
        wrong.select("item_id", "action", "error").show(100, truncate=60)
        return 1 if not wrong.isEmpty() else 0
    elif verb == "export":
        tables.write_gold(review.gold(items), place(spark, more[0]))
    else:
        print(__doc__)
        return 2
    return 0


def evaluate(spark: SparkSession, fields: str, gold: str, least: str = "0") -> int:
    """HL-9: field values against gold ones; both have doc_id, field_key and value."""
    ours, theirs = (spark.read.parquet(place(spark, x)).select("doc_id", "field_key", F.col("value").alias(name)) for x, name in ((fields, "found"), (gold, "wanted")))
    asked = theirs.select("doc_id", "field_key", "wanted").join(ours, ["doc_id", "field_key"], "left")
    same = F.coalesce(F.col("found") == F.col("wanted"), F.lit(False))
    counts = asked.agg(F.count_if(same).alias("tp"), F.count_if(~same & F.col("found").isNotNull()).alias("fp"), F.count_if(~same).alias("fn")).first()
    precision, recall = (counts.tp / n if (n := counts.tp + x) else 0.0 for x in (counts.fp, counts.fn))
    f1 = round(2 * precision * recall / (precision + recall), 3) if precision + recall else 0.0
    good = f1 >= float(least)
    print(f"precision {precision:.3f} recall {recall:.3f} f1 {f1:.3f}: {'pass' if good else 'fail'} at {float(least):.3f}")
    return 0 if good else 1


VERBS: dict[str, tuple[Callable[..., int], range]] = {"query": (query, range(0, 4)), "report": (make_report, range(3, 4)), "listing": (listing, range(1, 2)), "review": (reviewed, range(2, 5)), "evaluate": (evaluate, range(2, 4))}


def main(args: list[str], spark: SparkSession | None = None) -> int:
    verb, numbers = VERBS.get(args[0] if args else "", (None, ()))
    if verb is None or len(args) - 1 not in numbers:
        print(__doc__)
        return 2
    return verb(spark or SparkSession.builder.appName("tenderflow").getOrCreate(), *args[1:])


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
