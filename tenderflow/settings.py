"""AP-10: settings of a run, from session configuration `spark.tenderflow.*`."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    min_page_chars: int = 30
    child_chars: int = 480
    zone_window: int = 150
    review_threshold: float = 0.7
    code_version: str = "1"
    allowed_folders: str = ""
    as_of: str = ""

    @classmethod
    def of(cls, spark: SparkSession) -> Settings:
        given = {f.name: spark.conf.get(f"spark.tenderflow.{f.name}", None) for f in fields(cls)}
        kinds = {"int": int, "float": float, "str": str}
        return cls(**{f.name: kinds[f.type](given[f.name]) for f in fields(cls) if given[f.name] is not None})
