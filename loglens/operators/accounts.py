"""Account tables: active members, account lists from text, coverage, outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exclude_local_account(accounts: DataFrame, local_id: str) -> DataFrame:
    return accounts.filter(F.col("account_id") != local_id)


def active_member_accounts(accounts: DataFrame, local_id: str) -> DataFrame:
    return exclude_local_account(accounts.filter(F.col("status") == "ACTIVE"), local_id)


def valid_account_ids(lists: DataFrame, local_id: str, text: str = "text") -> DataFrame:
    """One row per id listed in the text, with ``valid``; the local id is left out.

    Lines are split first, comment lines dropped, then commas split the rest.
    """
    def pieces(column: str, separator: str) -> Column:
        return F.explode(F.transform(F.split(column, separator), lambda piece: F.trim(piece)))

    lines = lists.select(pieces(text, r"\r?\n").alias("line")).filter(~F.col("line").startswith("#"))
    ids = lines.select(pieces("line", ",").alias("account_id"))
    kept = ids.filter((F.col("account_id") != "") & (F.col("account_id") != local_id))
    return kept.withColumn("valid", F.col("account_id").rlike(r"^\d{12}$"))


def account_status(error: Column | str, events: Column | str) -> Column:
    """The error text, else 'No events', else 'OK'."""
    error = F.col(error) if isinstance(error, str) else error
    events = F.col(events) if isinstance(events, str) else events
    return (
        F.when(error.isNotNull() & (error != ""), error)
        .when(F.coalesce(events, F.lit(0)) == 0, "No events")
        .otherwise("OK")
    )


def account_coverage(accounts: DataFrame, overviews: DataFrame, errors: DataFrame) -> DataFrame:
    """Every expected account with its counts (0 where it has none) and status."""
    counts = [c for c in overviews.columns if c != "account_id"]
    joined = accounts.join(overviews, "account_id", "left").join(
        errors.select("account_id", "error"), "account_id", "left"
    )
    return joined.select(
        "account_id",
        *(F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in counts),
        "error",
        account_status("error", "total_athena_events").alias("status"),
    )


def run_outcome(coverage: DataFrame) -> DataFrame:
    """Accounts analysed and succeeded."""
    failed = F.col("error").isNotNull()
    return coverage.agg(
        F.count(F.lit(1)).alias("accounts_analysed"),
        F.count_if(~failed).alias("accounts_succeeded"),
        F.count_if(failed).alias("accounts_failed"),
    )


def run_errors(coverage: DataFrame) -> DataFrame:
    return coverage.filter(F.col("error").isNotNull()).select("account_id", "error")
