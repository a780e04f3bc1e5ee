"""Run ledger: what ran on which inputs, and whether inputs stayed the same meanwhile."""

from __future__ import annotations

import datetime
import json
import os
import platform
import random
import subprocess
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict, is_dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaykit.sources.sinks import file_digest

_SCHEMA = "experiment string, started string, ended string, status string, protocol string, inputs map<string,string>, outputs map<string,string>, versions map<string,string>"


def fingerprint(df: DataFrame) -> str:
    """Order-free content digest: rows, and two sums of their hashes."""
    h = F.xxhash64(*df.columns)
    r = df.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("x"), F.sum(h.bitwiseAND(0xFFFFFFFF)).alias("s")).first()
    return f"{r['n']}:{(r['x'] or 0) & (1 << 64) - 1:016x}:{r['s'] or 0:x}"


def environment(spark: SparkSession) -> dict[str, str]:
    return {"spark": spark.version, "python": platform.python_version()}


def plan_of(df: DataFrame, protocol: object) -> dict[str, str]:
    """What would run, without running it."""
    return {"protocol": json.dumps(asdict(protocol) if is_dataclass(protocol) else protocol, sort_keys=True), "plan": df._jdf.queryExecution().toString()}


def recorded(spark: SparkSession, ledger: str, experiment: str, protocol: object, inputs: dict[str, DataFrame], stage: Callable[[], dict[str, DataFrame]]) -> dict[str, DataFrame]:
    """Run ``stage`` once between two ledger rows; a run that began but never completed blocks another.

    Inputs are fingerprinted before and after, and a change fails the run. The result's tables are fingerprinted too.
    """
    try:
        past = spark.read.schema(_SCHEMA).parquet(ledger).where(F.col("experiment") == experiment)
        states = {r["status"] for r in past.select("status").distinct().collect()}
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        states = set()
    if states:
        raise RuntimeError(f"{experiment} is in the ledger already: {', '.join(sorted(states))}")
    now = lambda: datetime.datetime.now(datetime.UTC).isoformat()
    began, before = now(), {k: fingerprint(v) for k, v in inputs.items()}
    text = json.dumps(asdict(protocol) if is_dataclass(protocol) else protocol, sort_keys=True)

    def note(status: str, outputs: dict[str, str]) -> None:
        row = (experiment, began, None if status == "running" else now(), status, text, before, outputs, environment(spark))
        spark.createDataFrame([row], _SCHEMA).write.mode("append").parquet(ledger)

    note("running", {})
    try:
        out = stage()
        prints = {k: fingerprint(v) for k, v in out.items()}
        if {k: fingerprint(v) for k, v in inputs.items()} != before:
            raise RuntimeError("inputs changed while the run read them")
    except BaseException:
        note("incomplete", {})
        raise
    note("complete", prints)
    return out


def git_state(root: str) -> dict[str, object]:
    """Commit, branch and whether anything under ``root`` differs from the commit."""

    def git(*words: str) -> str:
        return subprocess.run(["git", "-C", root, *words], check=True, capture_output=True, text=True).stdout.strip()

    return {"commit": git("rev-parse", "HEAD"), "branch": git("rev-parse", "--abbrev-ref", "HEAD"), "dirty": bool(git("status", "--porcelain"))}


def require_clean(root: str) -> dict[str, object]:
    """``git_state`` of a tree without changes; any change is an error."""
    state = git_state(root)
    if state["dirty"]:
        raise RuntimeError("commit or put away changes before the run")
    return state


def bound_artifacts(provenance: dict, folder: str, wanted: list[str], inputs: dict[str, str] | None = None) -> dict[str, str]:
    """Digests of an earlier stage's files, after its record has been found complete, made from ``inputs``, and true.

    ``provenance`` has ``status``, ``input_sha256`` and ``output_sha256``; names with folders in them are an error.
    """
    if provenance.get("status") != "complete":
        raise ValueError("the earlier stage is not complete")
    if inputs is not None and provenance.get("input_sha256") != inputs:
        raise ValueError("the earlier stage had other inputs")
    told = provenance.get("output_sha256") or {}
    found = {}
    for name in wanted:
        if "/" in name or "\\" in name or name in ("", ".", ".."):
            raise ValueError(f"{name!r} is no file name")
        if name not in told:
            raise ValueError(f"the earlier stage made no {name}")
        found[name] = file_digest(f"{folder}/{name}")
        if found[name] != told[name]:
            raise ValueError(f"{name} has changed since")
    return found


def resolved(name: str, places: dict[str, list[str]], exists: Callable[[str], bool]) -> str:
    """The one place where an artifact with historical locations is; none or several are an error."""
    there = [p for p in places[name] if exists(p)]
    if len(there) != 1:
        raise FileNotFoundError(f"{name} is in none of its places") if not there else ValueError(f"{name} is in several places: {', '.join(there)}")
    return there[0]


def refuse_historical(path: str, places: dict[str, list[str]]) -> None:
    """New results may not go where old ones are kept: every place but the first of each artifact is one."""
    old = {p.rstrip("/") for locations in places.values() for p in locations[1:]}
    if path.rstrip("/") in old:
        raise ValueError(f"{path} is a historical place")


def model_identity(path: str, expected: str | None = None) -> dict[str, object]:
    """Digest and size of a checkpoint; another digest than expected is an error."""
    found = {"sha256": file_digest(path), "bytes": os.path.getsize(path)}
    if expected is not None and found["sha256"] != expected:
        raise ValueError(f"{path} is not the model that was frozen")
    return found


def completion(record: dict | None, outputs: list[str], exists: Callable[[str], bool]) -> str:
    """``new``, ``complete`` or ``blocked``: what may be done about a run with this record and these outputs."""
    made = [exists(p) for p in outputs]
    if record is None:
        return "blocked" if any(made) else "new"
    return "complete" if record.get("status") == "complete" and all(made) else "blocked"


def same_draws(before: dict, now: dict, keys: tuple[str, ...] = ("seed", "replicates", "draw_indices_sha256")) -> None:
    """An extension of finished evidence has to rest on its draws."""
    if other := [k for k in keys if before.get(k) != now.get(k)]:
        raise ValueError(f"the draws differ in {', '.join(other)}")


@contextmanager
def locked(path: str) -> Iterator[None]:
    """Hold a lock file that no other run may hold; it names the process and goes at the end."""
    try:
        handle = os.open(path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
    except FileExistsError:
        raise RuntimeError(f"another run holds {path}") from None
    try:
        os.write(handle, str(os.getpid()).encode())
        yield
    finally:
        os.close(handle)
        os.unlink(path)


def run_in_turn(commands: list[list[str]], lock: str, environment: dict[str, str] | None = None, log: str | None = None) -> list[int]:
    """Run commands one after the other under a lock, and stop at the first that fails; their exit codes."""
    codes = []
    with locked(lock):
        for c in commands:
            done = subprocess.run(c, check=False, env=os.environ | (environment or {}), capture_output=True, text=True)
            if log:
                with open(log, "a", encoding="utf-8") as f:
                    f.write(f"$ {' '.join(c)}\n{done.stdout}{done.stderr}")
            codes.append(done.returncode)
            if done.returncode:
                break
    return codes


def seeded(seed: int) -> dict[str, str]:
    """Seed the generators of this process; returns what to set for processes it starts."""
    random.seed(seed)
    np.random.seed(seed % 2**32)
    return {"PYTHONHASHSEED": str(seed % 2**32), "OMP_NUM_THREADS": "1"}
