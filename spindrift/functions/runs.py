"""What names and documents a run: ids, the versions behind it, and which options a backend takes."""

from __future__ import annotations

import importlib.metadata
import inspect
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_run_id(model: str, dataset: str, split: str, transcript: bool = True, question_first: bool = False, condition: str | None = None, limit: int | None = None) -> str:
    """Runs that could differ in any answer differ in their id, so that none resumes another."""
    parts = [model, dataset, split, "tx" if transcript else "notx", "qfirst" if question_first else "", condition or "", f"n{limit}" if limit else ""]
    return "_".join(p for p in parts if p)


def adapter_run_id(adapter: str, query_form: str, freeze_chunks: bool = False, answer_weight: float = 0.0) -> str:
    parts = [adapter, query_form.replace("+", "-"), "queryonly" if freeze_chunks else "", f"ans{answer_weight:g}" if answer_weight else ""]
    return "_".join(p for p in parts if p)


def revision(folder: str = ".") -> str:
    """The commit as git describes it, marked where the tree has changes; ``unknown`` outside a repository."""
    describe = ["git", "-C", folder, "describe", "--always", "--dirty", "--exclude=*"]
    try:
        return subprocess.check_output(describe, text=True, stderr=subprocess.DEVNULL, timeout=30).strip()
    except (subprocess.SubprocessError, OSError):
        return "unknown"


def versions(names: tuple[str, ...] = ("pyspark", "pandas", "pyarrow", "numpy")) -> dict[str, str]:
    out = {}
    for name in names:
        try:
            out[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            out[name] = "-"
    return out


def with_provenance(rows: DataFrame, run_id: str, folder: str = ".") -> DataFrame:
    """``rows`` with run_id, revision and versions."""
    said = [F.lit(x) for pair in versions().items() for x in pair]
    return rows.withColumns({"run_id": F.lit(run_id), "revision": F.lit(revision(folder)), "versions": F.create_map(*said)})


def options(backend: Callable, wanted: dict) -> tuple[dict, list[str]]:
    """What ``backend`` declares of the ``wanted`` options, and the names of those that it refuses; nulls aren't wanted."""
    asked = {k: v for k, v in wanted.items() if v is not None}
    taken = {k: asked.pop(k) for k in inspect.signature(backend).parameters if k in asked}
    return taken, sorted(asked)


def accepted(backend: Callable, wanted: dict) -> dict:
    return options(backend, wanted)[0]
