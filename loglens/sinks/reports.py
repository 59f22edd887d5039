"""Per-workgroup CSV, report text and log lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .. import functions as fn


def csv_rows(stats: DataFrame, guard: str = "") -> DataFrame:
    """CSV columns; GB to four decimals. ``guard`` is put before names that a
    spreadsheet would run as a formula; quoting alone does not stop it."""
    name = F.col("workgroup")
    if guard:
        name = F.when(name.rlike(r"^[=+\-@]"), F.concat(F.lit(guard), name)).otherwise(name)
    return stats.select(
        name.alias("workgroup"),
        "query_count",
        "unique_users",
        fn.gigabytes("total_data_scanned", 4).alias("data_scanned_gb"),
    )


def write_workgroup_csv(stats: DataFrame, path: str, guard: str = "") -> None:
    csv_rows(stats, guard).write.mode("overwrite").csv(
        path, header=True, quoteAll=True, quote='"', escape='"'
    )


def workgroup_report_lines(stats: DataFrame, type_maps: DataFrame) -> DataFrame:
    """One text block per workgroup: queries, users, GB and statement types."""
    pairs = F.transform(
        F.map_entries("query_types"), lambda e: F.format_string("'%s': %d", e["key"], e["value"])
    )
    types = F.concat(F.lit("{"), F.array_join(pairs, ", "), F.lit("}"))
    return stats.join(type_maps, "workgroup", "left").select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Workgroup: "), "workgroup"),
            F.format_string("  Queries: %d", "query_count"),
            F.format_string("  Users: %d", "unique_users"),
            F.concat(
                F.lit("  Data Scanned: "), fn.gigabytes("total_data_scanned", 2), F.lit(" GB")
            ),
            F.concat(F.lit("  Query Types: "), F.coalesce(types, F.lit("{}"))),
        ).alias("line")
    )


def metric_log_lines(overview: DataFrame, stats: DataFrame) -> DataFrame:
    """One SUMMARY line and one WORKGROUP line per workgroup, as JSON."""
    data = F.struct(*overview.columns)
    summary = overview.select(
        F.to_json(F.struct(F.lit("SUMMARY").alias("type"), data.alias("data"))).alias("line")
    )
    groups = stats.select(
        F.to_json(
            F.struct(F.lit("WORKGROUP").alias("type"), "workgroup", "query_count", "unique_users")
        ).alias("line")
    )
    return summary.unionByName(groups)


def write_lines(lines: DataFrame, path: str) -> None:
    lines.select("line").write.mode("overwrite").text(path)
