"""Which parser reads which file: the longest fitting suffix, then priority, then what is available."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Format:
    name: str
    suffix: str
    priority: int = 0
    available: bool = True
    reason: str = ""


FORMATS = [
    Format("html", ".html"), Format("html", ".htm"), Format("text", ".txt"), Format("snapshot", ".document.json", 60), Format("layout", "_middle.json", 50),
    Format("analysis", ".azure.json"), Format("pandoc", ".docx", available=False, reason="needs pandoc"), Format("pandoc", ".doc", available=False, reason="needs pandoc"),
    Format("spreadsheet", ".xlsx", available=False, reason="needs openpyxl"), Format("pdf", ".pdf", 10, False, "needs a PDF library"), Format("pdf-service", ".pdf", 40, False, "needs a service key"),
]


class Registry:
    def __init__(self, formats: list[Format] | None = None) -> None:
        self.formats = list(FORMATS if formats is None else formats)

    def register(self, fmt: Format) -> None:
        self.unregister(fmt.suffix, fmt.name, missing_ok=True)
        self.formats.append(fmt)

    def unregister(self, suffix: str, name: str, missing_ok: bool = False) -> None:
        left = [f for f in self.formats if (f.suffix, f.name) != (suffix, name)]
        if len(left) == len(self.formats) and not missing_ok:
            raise KeyError(f"no parser {name} for {suffix}")
        self.formats = left

    def get(self, name: str) -> list[Format]:
        found = [f for f in self.formats if f.name == name]
        if not found:
            raise KeyError(f"{name} is none of {sorted({f.name for f in self.formats})}")
        return found

    def describe(self) -> str:
        return "\n".join(f"{f.suffix:18} {f.name:12} {f.priority:4} {'' if f.available else f.reason}".rstrip() for f in sorted(self.formats, key=lambda f: (f.suffix, -f.priority)))

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(f.name, f.suffix, f.priority, f.available, f.reason) for f in self.formats], "parser string, suffix string, priority int, available boolean, reason string")

    def route(self, files: DataFrame, path: str = "path") -> DataFrame:
        """Each file with its parser, or with the reason why none reads it. The table of formats is a
        few rows of configuration, so it is broadcast."""
        fits = F.lower(F.col(path)).endswith(F.col("suffix"))
        both = files.join(F.broadcast(self.frame(files.sparkSession)), fits, "left")
        best = Window.partitionBy(path).orderBy(F.col("available").desc_nulls_last(), F.length("suffix").desc(), F.col("priority").desc(), "parser")
        reason = F.when(F.col("parser").isNull(), "no parser for this suffix").when(~F.col("available"), F.col("reason"))
        return both.withColumn("__n", F.row_number().over(best)).where("__n = 1").select(*files.columns, F.when(F.col("available"), F.col("parser")).alias("parser"), reason.alias("error"))


def stamp(docs: DataFrame, parser: str, path: str) -> DataFrame:
    """Parser, path and file name, only where unset."""
    have = set(docs.columns)
    old = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    return docs.withColumns({"parser": F.coalesce(old("parser"), F.lit(parser)), "source_path": F.coalesce(old("source_path"), F.col(path)), "filename": F.coalesce(old("filename"), F.element_at(F.split(path, "/"), -1))})
