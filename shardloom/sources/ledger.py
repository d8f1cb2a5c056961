"""Conversion ledger: what was converted from which input, and whether it still holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..operators.sets import multiset_difference


def ledger_rows(inputs: DataFrame, shards: DataFrame, before: DataFrame, after: DataFrame, completed_at: Column):
    """One record per input: status, rows, shard count, fingerprints before and after.

    ``inputs`` is ``name, rows``; ``shards`` is ``name, url, nsamples``; fingerprints are ``name, fp``.
    An input that changed while it was read is not complete.
    """
    made = shards.groupBy("name").agg(F.count("url").alias("shards"), F.sum("nsamples").alias("shard_rows"))
    joined = (
        inputs.join(made, "name", "left")
        .join(before.select("name", F.col("fp").alias("source_before")), "name", "left")
        .join(after.select("name", F.col("fp").alias("source_after")), "name", "left")
    )
    status = F.when(~F.col("source_before").eqNullSafe(F.col("source_after")), "changed").when(
        ~F.col("rows").eqNullSafe(F.col("shard_rows")), "incomplete"
    ).otherwise("complete")
    return joined.select(
        "name", status.alias("status"), "rows", F.coalesce("shards", F.lit(0).cast("bigint")).alias("shards"),
        "source_before", "source_after", completed_at.alias("completed_at"),
    )


def upsert_ledger(old: DataFrame, new: DataFrame) -> DataFrame:
    """Newest record per input."""
    both = old.withColumn("__gen", F.lit(0)).unionByName(new.withColumn("__gen", F.lit(1)))
    columns = [c for c in old.columns if c != "name"]
    newest = F.max_by(F.struct(*columns), F.struct("__gen", "completed_at")).alias("r")
    return both.groupBy("name").agg(newest).select("name", "r.*").select(*old.columns)


def input_state(current: DataFrame, ledger: DataFrame, missing_shards: DataFrame | None = None) -> DataFrame:
    """State of every current input: ``todo``, ``done``, ``fingerprint changed``, ``no shards`` or ``shard missing``.

    ``current`` is ``name, fp``; ``missing_shards`` lists ``name`` of inputs with a lost shard file.
    """
    joined = current.join(ledger, "name", "left")
    if missing_shards is not None:
        joined = joined.join(missing_shards.select("name").distinct().withColumn("__lost", F.lit(True)), "name", "left")
    else:
        joined = joined.withColumn("__lost", F.lit(None).cast("boolean"))
    same = F.col("source_before").eqNullSafe(F.col("fp")) & F.col("source_after").eqNullSafe(F.col("fp"))
    state = (
        F.when(~F.col("status").eqNullSafe(F.lit("complete")), "todo")
        .when(~same, "fingerprint changed")
        .when(F.coalesce("shards", F.lit(0)) == 0, "no shards")
        .when(F.col("__lost"), "shard missing")
        .otherwise("done")
    )
    return joined.select("name", state.alias("state"))


def pending_inputs(current: DataFrame, ledger: DataFrame, missing_shards: DataFrame | None = None) -> DataFrame:
    """Inputs still to convert; a completed input that no longer matches stops the job."""
    states = input_state(current, ledger, missing_shards)
    broken = F.raise_error(F.concat(F.col("name"), F.lit(": "), F.col("state"))).cast("boolean")
    sound = F.when(F.col("state").isin("todo", "done"), True).otherwise(broken)
    return states.where(sound).where("state = 'todo'").select("name")


def reconcile(before: DataFrame, after: DataFrame, descriptor: DataFrame, recorded: DataFrame) -> DataFrame:
    """Mismatch lines between fingerprints and between shard lists; empty means all agree."""
    prints = before.select("name", F.col("fp").alias("b")).join(
        after.select("name", F.col("fp").alias("a")), "name", "full_outer"
    ).where(~F.col("b").eqNullSafe(F.col("a")))
    lists = multiset_difference(descriptor.select("url", "nsamples"), recorded.select("url", "nsamples"))
    return prints.select(F.lit("fingerprint").alias("kind"), "name").unionByName(
        lists.select(F.lit("shard list").alias("kind"), F.col("url").alias("name"))
    )


def output_report(descriptor: DataFrame, ledger: DataFrame, recorded: DataFrame, current: DataFrame) -> DataFrame:
    """One line of totals: shard-list differences, samples found and expected, inputs not complete."""
    lists = multiset_difference(descriptor.select("url", "nsamples"), recorded.select("url", "nsamples"))
    open_inputs = input_state(current, ledger).where("state <> 'done'")
    return descriptor.agg(F.count("url").alias("shards"), F.coalesce(F.sum("nsamples"), F.lit(0)).alias("samples")).select(
        "shards",
        "samples",
        ledger.where("status = 'complete'").select(F.coalesce(F.sum("rows"), F.lit(0))).scalar().alias("expected"),
        lists.select(F.count(F.lit(1))).scalar().alias("list_differences"),
        open_inputs.select(F.count(F.lit(1))).scalar().alias("inputs_not_done"),
    ).withColumn(
        "verified",
        (F.col("samples") == F.col("expected")) & (F.col("list_differences") == 0) & (F.col("inputs_not_done") == 0),
    )


def rows_declared(read: DataFrame, declared: DataFrame) -> DataFrame:
    """Rows read against rows declared, per input."""
    return declared.join(read, "name", "full_outer").select(
        "name",
        F.coalesce("declared", F.lit(0).cast("bigint")).alias("declared"),
        F.coalesce("rows", F.lit(0).cast("bigint")).alias("rows"),
        F.col("declared").eqNullSafe(F.col("rows")).alias("matches"),
    )
