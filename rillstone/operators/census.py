"""File census: a listing classified by prefix rules, counted and checked."""

from __future__ import annotations

import datetime as dt
import os
import subprocess
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions.text import blank, filled, norm_path, strip, top_level

# What a rule may decide.
DISPOSITIONS = ["keep-in-place", "move", "archive", "junk-disposal", "gated", "excluded-by-policy"]
CENSUS = "path string, type string, size bigint, mtime string"


def list_tree(spark: SparkSession, root: str, excluded: Iterable[str] = ()) -> tuple[DataFrame, DataFrame]:
    """``(rows, warnings)``: directories and files of a tree, the root as ``.``; excluded names get one row with their child count and are not entered.

    A directory cannot be listed by executors that do not share the disk, so the driver walks it.
    """
    skip, rows, warnings = set(excluded), [], []
    stack = ["."]
    while stack:
        rel = stack.pop()
        full = os.path.join(root, rel)
        try:
            entries = sorted(os.scandir(full), key=lambda e: e.name)
            st = os.stat(full)
        except OSError as e:
            warnings.append(("walk", rel, f"{type(e).__name__}", str(e)))
            continue
        rows.append((rel, "directory", None, _iso(st.st_mtime), None))
        below = []
        for e in entries:
            path = e.name if rel == "." else f"{rel}/{e.name}"
            try:
                info = e.stat(follow_symlinks=False)
            except OSError as x:
                warnings.append(("stat", path, type(x).__name__, str(x)))
                continue
            if e.name in skip:
                rows.append((path, "excluded", None if e.is_dir() else info.st_size, _iso(info.st_mtime), len(os.listdir(e.path)) if e.is_dir() else None))
            elif e.is_dir(follow_symlinks=False):
                below.append(path)
            elif not e.is_dir():
                rows.append((path, "file", info.st_size, _iso(info.st_mtime), None))
        stack += reversed(below)
    return spark.createDataFrame(rows, f"{CENSUS}, child_count int"), spark.createDataFrame(warnings, "source string, path string, warning string, detail string")


def _iso(seconds: float) -> str:
    return dt.datetime.fromtimestamp(seconds, dt.timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")


def tracked_files(spark: SparkSession, root: str, timeout: int = 120) -> DataFrame:
    """``path`` of the files under version control; none if there is no repository."""
    try:
        said = subprocess.run(["git", "-C", root, "ls-files", "-z"], capture_output=True, timeout=timeout)
        names = said.stdout.decode("utf-8", "replace").split("\0") if said.returncode == 0 else []
    except (OSError, subprocess.SubprocessError):
        names = []
    return spark.createDataFrame([(n,) for n in names if n], "path string").select(norm_path(F.col("path")).alias("path"))


def load_rules(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(rules, warnings)`` of ``pattern, disposition, reason, line_no``; moves and archives must name a destination in their reason."""
    d, r = strip(blank(F.col("disposition"))), strip(blank(F.col("reason")))
    bad = F.when(strip(blank(F.col("pattern"))) == "", "missing-pattern").when(~d.isin(DISPOSITIONS), "invalid-disposition").when(d.isin("move", "archive") & ~r.contains("dest="), "missing-dest-in-reason")
    checked = rows.select(norm_path(F.col("pattern")).alias("pattern"), d.alias("disposition"), r.alias("reason"), "line_no", bad.alias("warning"))
    return checked.filter("warning IS NULL").drop("warning"), checked.filter("warning IS NOT NULL").select(F.lit("dispositions").alias("source"), F.col("pattern").alias("path"), "warning", F.col("line_no").cast("string").alias("detail"))


def apply_rules(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds ``disposition`` and ``reason`` to rows ``path, type``: of the rules whose pattern is the path or a folder above it, an exact match of a file
    wins, then the longest pattern, then the later line. Excluded rows obey no rule; without a rule both are empty.

    Each path is joined with its own ancestors by equality, so no path is compared with every rule.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    open_ = paths.filter("type <> 'excluded'").select("path", "type").distinct().withColumn("pattern", F.explode(F.array_distinct(prefixes)))
    rank = F.struct(((F.col("pattern") == F.col("path")) & (F.col("type") == "file")).cast("int").alias("exact"), F.length("pattern").alias("l"), F.col("line_no").alias("n"))
    best = open_.join(rules, "pattern").groupBy("path").agg(F.max_by(F.struct("disposition", "reason"), rank).alias("b")).select("path", "b.disposition", "b.reason")
    joined = paths.join(best, "path", "left")
    own = F.col("type") == "excluded"
    return joined.withColumns({"disposition": F.when(own, "excluded-by-policy").otherwise(F.coalesce("disposition", F.lit(""))), "reason": F.when(own, F.lit("excluded by policy")).otherwise(F.coalesce("reason", F.lit("")))})


def flag_tracked(rows: DataFrame, tracked: DataFrame) -> DataFrame:
    """Adds ``git_tracked`` (0 or 1; folders 0) and ``top_level``."""
    flagged = rows.join(tracked.select("path").distinct().withColumn("__t", F.lit(1)), "path", "left")
    return flagged.withColumns({"git_tracked": F.when(F.col("type") == "file", F.coalesce("__t", F.lit(0))).otherwise(0), "top_level": top_level(F.col("path"))}).drop("__t")


def crosstab(rows: DataFrame) -> DataFrame:
    """Rows per top level and disposition, empty ones as UNASSIGNED."""
    named = rows.withColumn("d", F.coalesce(filled(F.col("disposition")), F.lit("UNASSIGNED")))
    return named.groupBy("top_level").pivot("d", [*DISPOSITIONS, "UNASSIGNED"]).count().fillna(0)


def unassigned(rows: DataFrame, first: int = 50) -> tuple[int, list[str]]:
    """How many rows no rule decided, and the first of their paths."""
    open_ = rows.filter("disposition = ''")
    return open_.count(), [r[0] for r in open_.select("path").orderBy("path").limit(first).collect()]


def count_mismatches(a: DataFrame, b: DataFrame) -> DataFrame:
    """``top_level, n_a, n_b`` where two listings (``path``) hold different numbers of files."""
    per = lambda df, n: df.groupBy(top_level(F.col("path")).alias("top_level")).agg(F.count("*").alias(n))
    return per(a, "n_a").join(per(b, "n_b"), "top_level", "full_outer").fillna(0).filter("n_a <> n_b")
