"""Inventories, plans and outputs: completeness, portable paths, collisions and relations."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Actions of a plan: needs approval, relation of the output, losses, target, may be executed (fixed values).
ACTIONS = {
    "copy_unchanged": (True, "byte_identical", "", "same", True),
    "strip_ooxml_metadata": (True, "metadata_reduced_format_preserved", "document_metadata_removed", "same", True),
    "strip_png_metadata": (True, "metadata_reduced_format_preserved", "image_metadata_removed", "same", True),
    "strip_jpeg_metadata": (True, "metadata_reduced_format_preserved", "image_metadata_removed", "same", True),
    "omit_from_boundary": (True, "absent_from_output", "file_omitted", "none", True),
    "rename_in_bundle": (True, "byte_identical", "bundle_path_changed", "different", True),
    "manual_or_external_required": (False, "not_applicable", "", "none", False),
    "block": (False, "not_applicable", "", "none", False),
}
#: Names that Windows keeps for devices (fixed values).
RESERVED = ["con", "prn", "aux", "nul", "clock$", *(f"com{n}" for n in range(1, 10)), *(f"lpt{n}" for n in range(1, 10))]


def portable(path: Column, max_name: int = 255) -> Column:
    """Whether a relative path is fine on every system."""
    bad = lambda p: (p.isin("", ".", "..")) | (F.octet_length(p) > max_name) | F.rlike(p, F.lit(r'[ .]$|[<>:"\\|?*\x00-\x1f\x7f]')) | F.lower(F.substring_index(p, ".", 1)).isin(*RESERVED)
    return F.coalesce((path != "") & (F.octet_length(path) <= 4096) & ~F.rlike(path, F.lit(r"^[/\\]|^[A-Za-z]:|\\")) & ~F.exists(F.split(path, "/"), bad), F.lit(False))


def _composed(path: Column, fold: bool = False) -> Column:
    """A string in Unicode's composed form (NFC), if asked for with its case folded: Spark has functions for neither."""

    def normal(paths: pd.Series) -> pd.Series:
        form = lambda p: unicodedata.normalize("NFC", p)
        return paths.map(lambda p: None if p is None else form(form(p).casefold()) if fold else form(p))

    return F.pandas_udf(normal, StringType())(path)


def path_key(df: DataFrame, path: str, key: str) -> DataFrame:
    """Add what two paths have in common if a system can't tell them apart: composed form, folded case.

    Only paths beyond ASCII go through Python, in a pass of their own.
    """
    plain = F.coalesce(F.rlike(path, F.lit(r"^[\x00-\x7f]*$")), F.lit(True))
    return df.where(plain).withColumn(key, F.lower(path)).unionByName(df.where(~plain).withColumn(key, _composed(F.col(path), True)))


def sort_key(df: DataFrame, path: str, key: str) -> DataFrame:
    """Add the order of a path on every system: folded parts, then composed parts, then the path as it is."""
    folded = path_key(df, path, "_folded")
    return folded.withColumn(key, F.struct(F.split("_folded", "/"), F.split(F.coalesce(F.when(F.rlike(path, F.lit(r"^[\x00-\x7f]*$")), F.col(path)), _composed(F.col(path))), "/"), F.col(path))).drop("_folded")


def plan(decisions: DataFrame, inventory: DataFrame) -> DataFrame:
    """Each source path with its place in the plan, action id and state.

    decisions has source_path, target_path, action; inventory has path. The state
    is ok, missing (no decision), unknown (no file), duplicate (two decisions),
    unsupported (action), bad_target (against the action's contract) or
    not_portable. Action ids number the files of the inventory in path order.
    """
    contract = F.create_map(*[F.lit(x) for k, v in ACTIONS.items() for x in (k, v[3])])
    each = decisions.groupBy("source_path").agg(F.count("*").alias("n"), F.min("action").alias("action"), F.min("target_path").alias("target_path"))
    files = inventory.select(F.col("path").alias("source_path"), F.lit(True).alias("there")).distinct()
    numbered = path_key(files, "source_path", "_key").withColumn("number", F.row_number().over(Window.orderBy("_key", "source_path"))).drop("_key")
    both = numbered.join(each, "source_path", "full_outer")
    wants = F.try_element_at(contract, F.col("action"))
    target = F.col("target_path")
    wrong = ((wants == "same") & ~target.eqNullSafe(F.col("source_path"))) | ((wants == "none") & target.isNotNull()) | ((wants == "different") & (target.isNull() | (target == F.col("source_path"))))
    state = (
        F.when(~portable(F.col("source_path")) | (target.isNotNull() & ~portable(target)), "not_portable")
        .when(F.col("there").isNull(), "unknown").when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "duplicate")
        .when(wants.isNull(), "unsupported").when(wrong, "bad_target").otherwise("ok")
    )
    return both.select("source_path", "target_path", "action", F.when(F.col("there"), F.format_string("action-%06d", F.col("number"))).alias("action_id"), state.alias("state"))


def ancestors(path: Column) -> Column:
    """The folders above a path, from the top."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def _above(files: DataFrame) -> DataFrame:
    """A row for each folder above each path."""
    return files.where(F.contains("path", F.lit("/"))).select("path", F.explode(ancestors(F.col("path"))).alias("folder"))


def collisions(files: DataFrame) -> DataFrame:
    """Paths (path) that collide: key and kind (same_file, file_is_folder, folder_spelling), a row for each key and kind."""
    named = path_key(files.select("path"), "path", "key")
    folders = path_key(_above(files).select("folder"), "folder", "key")
    same = named.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("same_file").alias("kind"))
    above = named.join(folders, "key", "left_semi").select("key", F.lit("file_is_folder").alias("kind")).distinct()
    spelling = folders.groupBy("key").agg(F.count_distinct("folder").alias("n")).where("n > 1").select("key", F.lit("folder_spelling").alias("kind"))
    return same.unionByName(above).unionByName(spelling)


def aliases(actions: DataFrame) -> DataFrame:
    """Source paths that are omitted or renamed away, though some target still has them or lies below them."""
    targets = actions.where("target_path IS NOT NULL").select(F.col("target_path").alias("path"))
    taken = path_key(targets, "path", "key").select("key").union(path_key(_above(targets).select("folder"), "folder", "key").select("key"))
    gone = actions.where(F.col("action").isin("omit_from_boundary", "rename_in_bundle"))
    return path_key(gone.select("source_path"), "source_path", "key").join(taken, "key", "left_semi").select("source_path")


def approved(actions: DataFrame, approvals: DataFrame) -> DataFrame:
    """Action ids (action_id) that only the plan has (unapproved) or only the approval (unknown); none if they are equal sets."""
    a, b = actions.select("action_id").distinct(), approvals.select("action_id").distinct()
    return a.join(b, "action_id", "left_anti").withColumn("state", F.lit("unapproved")).unionByName(b.join(a, "action_id", "left_anti").withColumn("state", F.lit("unknown")))


def outputs(expected: DataFrame, observed: DataFrame) -> DataFrame:
    """Files (path, size, digest, media_type) that should be there against those that are: ok, missing, unexpected or what differs."""
    e, o = expected.alias("e"), observed.alias("o")
    differs = F.array_compact(F.array(*[F.when(~F.col(f"e.{c}").eqNullSafe(F.col(f"o.{c}")), c) for c in ("size", "digest", "media_type")]))
    state = F.when(F.col("o.path").isNull(), "missing").when(F.col("e.path").isNull(), "unexpected").when(F.size(differs) > 0, F.concat(F.lit("changed:"), F.array_join(differs, ","))).otherwise("ok")
    return e.join(o, F.col("e.path") == F.col("o.path"), "full_outer").select(F.coalesce("e.path", "o.path").alias("path"), state.alias("state"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of two enumerations that are not in both."""
    return before.exceptAll(after).withColumn("side", F.lit("before")).unionByName(after.exceptAll(before).withColumn("side", F.lit("after")))


def running_budget(rows: DataFrame, order: str, size: str, budget: int, rows_of_a_bucket: int = 500_000) -> DataFrame:
    """Rows in the order of a numeric column with their running total and whether it is within the budget.

    Totals come from two levels: sums of buckets (between quantiles of the order
    column) and running sums within each, so no task orders all rows. Rows of
    one order value stay together; their order among themselves is by size.
    """
    n = rows.count()
    parts = max(4, -(-n // rows_of_a_bucket))
    cuts = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.2 / parts))) if n else []
    bucket = F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<double>"), lambda c: c < F.col(order).cast("double"))) if cuts else F.lit(0)
    dealt = rows.withColumn("_bucket", bucket)
    sums = dealt.groupBy("_bucket").agg(F.sum(size).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_bucket", "_before")
    w = Window.partitionBy("_bucket").orderBy(order, size).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = dealt.join(F.broadcast(before), "_bucket")  # `parts` rows
    return out.withColumn("running", F.sum(size).over(w) + F.col("_before")).withColumn("within", F.col("running") <= budget).drop("_bucket", "_before")


def fitting_prefix(rows: DataFrame, order: str, budget: int) -> DataFrame:
    """The longest beginning of rows, in the order of a numeric column, whose JSON comes to at most `budget` bytes."""
    sized = rows.withColumn("_size", F.octet_length(F.to_json(F.struct(*rows.columns))) + 1)
    return running_budget(sized, order, "_size", budget).where("within").drop("_size", "running", "within")


def merge_issues(*relations: DataFrame) -> DataFrame:
    """Issues (code, action_id, path, and others) of several relations, each once: of equal ones that of the first relation."""
    key = ["code", "action_id", "path"]
    every = None
    for k, df in enumerate(relations):
        own = df.withColumn("_turn", F.lit(k))
        every = own if every is None else every.unionByName(own)
    others = [c for c in every.columns if c not in (*key, "_turn")]
    first = every.groupBy(*key).agg(F.min_by(F.struct(*others, "_turn"), "_turn").alias("_f"))
    return first.select(*key, *[F.col(f"_f.{c}").alias(c) for c in others])
