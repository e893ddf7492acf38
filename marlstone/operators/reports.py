"""Text reports: sections from several results, in order, as one file a report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def report_lines(names: DataFrame, sections: Sequence[tuple[str, DataFrame | str]]) -> DataFrame:
    """(report, section, at, line) for each report of names (report): a head line with its name and a rule of '=', then the sections, each after an empty line and with its title.

    A section is a table (report, order, line), whose lines come in that order (ties by line), or a text that all reports have. A
    report without lines in a section says so, so that what is missing is not taken for nothing.
    """
    head = names.select("report", F.lit(0).alias("section"), F.inline(F.array(F.struct(F.lit(-1).alias("at"), F.col("report").alias("line")), F.struct(F.lit(0).alias("at"), F.repeat(F.lit("="), F.length("report")).alias("line")))))
    out = head
    for k, (title, body) in enumerate(sections, 1):
        top = names.select("report", F.lit(k).alias("section"), F.inline(F.array(F.struct(F.lit(-1).alias("at"), F.lit("").alias("line")), F.struct(F.lit(0).alias("at"), F.lit(title).alias("line")))))
        if isinstance(body, str):
            lines = names.select("report", F.lit(k).alias("section"), F.posexplode(F.split(F.lit(body), "\n")).alias("at", "line")).withColumn("at", F.col("at") + 1)
        else:
            at = F.row_number().over(Window.partitionBy("report").orderBy("order", "line"))
            lines = body.select("report", F.lit(k).alias("section"), at.alias("at"), "line")
            none = names.join(body.select("report").distinct(), "report", "left_anti")
            lines = lines.unionByName(none.select("report", F.lit(k).alias("section"), F.lit(1).alias("at"), F.lit("- no data").alias("line")))
        out = out.unionByName(top).unionByName(lines)
    return out


def write_reports(lines: DataFrame, path: str) -> None:
    """Writes report_lines as one text file a report, in a folder named like it. A report is a text for people, so it is one row once its lines are sorted."""
    whole = lines.groupBy("report").agg(F.array_sort(F.collect_list(F.struct("section", "at", "line"))).alias("x"))
    whole.select("report", F.array_join("x.line", "\n").alias("line")).write.mode("overwrite").partitionBy("report").text(path)


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(report, number, line) of the files that write_reports wrote, by line from 1."""
    text = F.regexp_replace("value", "\n$", "")
    whole = spark.read.text(path, wholetext=True).select("report", F.posexplode(F.split(text, "\n", -1)).alias("number", "line"))
    return whole.select(F.col("report").cast("string").alias("report"), (F.col("number") + 1).alias("number"), "line")
