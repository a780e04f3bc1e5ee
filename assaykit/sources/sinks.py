"""Sinks: exclusive tables, ordered manifests, JSON, plot-ready frames."""

from __future__ import annotations

import hashlib
import json
import os
import shutil
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exclusive_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One CSV file with header, CRLF ends and blanks for NULL, in order; an existing path is an error."""
    df.orderBy(*order).coalesce(1).write.mode("errorifexists").option("header", True).option("lineSep", "\r\n").option("emptyValue", "").csv(path)


def exclusive_parquet(df: DataFrame, path: str, partition: list[str] | None = None) -> None:
    w = df.write.mode("errorifexists")
    (w.partitionBy(*partition) if partition else w).parquet(path)


def ordered_manifest(df: DataFrame, path: str, order: str = "pos", name: str = "image") -> None:
    df.orderBy(order).select(F.col(name).cast("string").alias("value")).coalesce(1).write.mode("errorifexists").text(path)


def sorted_json(df: DataFrame, path: str) -> None:
    """JSON lines with keys in name order; NaN and infinities become null."""
    cols = [F.when(~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in sorted(df.dtypes)]
    df.select(F.to_json(F.struct(*cols), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


def strict_json(value: object, path: str, exclusive: bool = True) -> None:
    """One JSON file with sorted keys, written beside its place and moved there; NaN and infinities are an error."""
    text = json.dumps(value, sort_keys=True, indent=2, allow_nan=False)
    _place(path, lambda temporary: Path(temporary).write_text(text + "\n", encoding="utf-8"), exclusive)


def replaced_csv(df: DataFrame, path: str, order: list[str]) -> None:
    """One small CSV file that replaces an older one in a single move; readers see the old table or the new one."""
    rows = df.orderBy(*order).toPandas()
    _place(path, lambda temporary: rows.to_csv(temporary, index=False, lineterminator="\r\n"), False)


def _place(path: str, write: Callable[[str], object], exclusive: bool) -> None:
    target = Path(path)
    if exclusive and target.exists():
        raise FileExistsError(path)
    temporary = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
    try:
        write(str(temporary))
        if exclusive:
            os.link(temporary, target)  # fails if another run was faster
        else:
            os.replace(temporary, target)
    finally:
        temporary.unlink(missing_ok=True)


def runtime_files(settings: dict, lists: dict[str, list[str]], root: str, folder: str) -> dict[str, str]:
    """The files that a training run reads: lists of absolute paths and ``runtime.yaml`` that names them.

    Entries of the lists are relative to ``root`` and may not leave it. A file that is there already has to hold the same.
    """
    import yaml

    base, made = Path(root).resolve(), {}
    for name, entries in lists.items():
        full = [(base / e).resolve() for e in entries]
        if outside := [str(p) for p in full if not p.is_relative_to(base)]:
            raise ValueError(f"{outside[0]} is outside {base}")
        made[f"{name}.txt"] = "".join(f"{p}\n" for p in full)
    named = {name: str(Path(folder).resolve() / f"{name}.txt") for name in lists}
    made["runtime.yaml"] = yaml.safe_dump(settings | named | {"path": str(base)}, sort_keys=True)
    for name, text in made.items():
        target = Path(folder) / name
        if target.exists() and target.read_text(encoding="utf-8") != text:
            raise FileExistsError(f"{target} holds something else")
        if not target.exists():
            _place(str(target), lambda temporary: Path(temporary).write_text(text, encoding="utf-8"), True)  # noqa: B023
    return {name: str(Path(folder) / name) for name in made}


def reporting_copies(files: list[str], folder: str, recipes: dict[str, str] | None = None) -> str:
    """Copies of result files beside ``manifest.json``, which has each one's digest, origin and how it was made."""
    target, entries = Path(folder), {}
    target.mkdir(parents=True, exist_ok=False)
    for f in sorted(files):
        source = Path(f)
        if source.name in entries:
            raise ValueError(f"two files are named {source.name}")
        shutil.copyfile(source, target / source.name)
        entries[source.name] = {"sha256": file_digest(str(source)), "origin": str(source), "recipe": (recipes or {}).get(source.name)}
    strict_json(entries, str(target / "manifest.json"))
    return str(target / "manifest.json")


def reporting_problems(folder: str, origins: bool = False) -> list[str]:
    """What is wrong with a folder of copies: files missing, not listed or changed, and (if asked) origins that differ."""
    target = Path(folder)
    entries = json.loads((target / "manifest.json").read_text(encoding="utf-8"))
    there = {p.name for p in target.iterdir()} - {"manifest.json"}
    found = [f"missing: {n}" for n in sorted(set(entries) - there)] + [f"not listed: {n}" for n in sorted(there - set(entries))]
    for name in sorted(there & set(entries)):
        if file_digest(str(target / name)) != entries[name]["sha256"]:
            found.append(f"changed: {name}")
        elif origins and file_digest(entries[name]["origin"]) != entries[name]["sha256"]:
            found.append(f"origin differs: {name}")
    return found


def file_digest(path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file, read block by block."""
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(block):
            h.update(part)
    return h.hexdigest()


def histogram_frame(df: DataFrame, column: str, bins: int = 100) -> DataFrame:
    """``bin, n``: equal-width counts on [0, 1], ready to plot."""
    at = F.least(F.floor(F.col(column) * bins), F.lit(bins - 1))
    return df.where(F.col(column).between(0, 1)).groupBy(at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def curve_frame(curve: DataFrame, by: list[str], x: str, y: str, points: int = 200) -> DataFrame:
    """``by, x, y`` of a step curve at even places along ``x``, ready to plot: the last value up to each place.

    A curve of any length becomes at most ``points`` rows for each group.
    """
    at = F.least(F.floor(F.col(x) * points), F.lit(points - 1))
    last = curve.groupBy(*by, at.alias("_at")).agg(F.max(F.struct(F.col(x), F.col(y))).alias("p"))
    return last.select(*by, F.col(f"p.{x}").alias(x), F.col(f"p.{y}").alias(y))


def reliability_frame(bins: DataFrame, by: list[str]) -> DataFrame:
    """``by, bin, mean_confidence, accuracy, gap, share`` of reliability bins, ready to plot."""
    whole = F.sum("n").over(Window.partitionBy(*by))
    return bins.select(*by, "bin", "mean_confidence", "accuracy", (F.col("accuracy") - F.col("mean_confidence")).alias("gap"), (F.col("n") / whole).alias("share"))


def interval_frame(table: DataFrame, by: list[str]) -> DataFrame:
    """``by, observed, below, above``: error bars of an evaluation table."""
    return table.select(*by, "observed", (F.col("observed") - F.col("lower_95")).alias("below"), (F.col("upper_95") - F.col("observed")).alias("above"))
