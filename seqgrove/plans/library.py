"""The runtime library: a folder of tables, complete or absent; freshness of what is built."""

from __future__ import annotations

import json
import os
import shutil
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Tables that a library must hold. Fixed values.
CORE = ("terms", "profiles", "motifs", "clusters_meta", "scoreboard", "calibration")


class MissingLibrary(FileNotFoundError):
    pass


def packaged_dir() -> str:
    return str(Path(__file__).parent.parent / "library_default")


def absent(folder: str) -> list[str]:
    return [t for t in CORE if not os.path.isdir(os.path.join(folder, t))]


#: What a scan can't do without; it goes on without terms, profiles and calibration. Fixed values.
SCAN = ("motifs", "clusters_meta", "scoreboard")


def resolve(explicit: str | None = None, cwd: str = ".", packaged: str | None = None, need: tuple[str, ...] = CORE) -> tuple[str, str]:
    """(folder, source): the one asked for, the current one if it holds any table, or the packaged one."""
    if explicit is not None:
        folder, source = explicit, "explicit"
    elif len(absent(cwd)) < len(CORE):
        folder, source = os.path.abspath(cwd), "current-directory"
    else:
        folder, source = packaged or packaged_dir(), "packaged"
    if gone := [t for t in absent(folder) if t in need]:
        raise MissingLibrary(f"{folder} lacks {', '.join(gone)}")
    return folder, source


def fingerprint(path: str) -> dict:
    """Name, size and time of a source file: what was read is what is there, as long as these are the same."""
    s = os.stat(path)
    return {"name": os.path.basename(path), "size": s.st_size, "modified": s.st_mtime}


def sequence_of(spark: SparkSession, folder: str, accession: str, source: str | None = None) -> str | None:
    """One sequence of a built library, None if unknown. source: the knowledge base that it must have been built from."""
    from seqgrove.sources.flatfiles import lookup

    if source is not None and (read_params(os.path.join(folder, "records")) or {}).get("source") != json.loads(json.dumps(fingerprint(source))):
        raise ValueError(f"the sequences in {folder} are not those of {source}")
    return lookup(load(spark, folder, "sequences"), accession)


def package(source: str, target: str) -> None:
    """Copy all core tables, or none."""
    if gone := absent(source):
        raise MissingLibrary(f"{source} lacks {', '.join(gone)}")
    for t in CORE:
        shutil.copytree(os.path.join(source, t), os.path.join(target, t), dirs_exist_ok=True)


def has(folder: str, name: str) -> bool:
    return os.path.isdir(os.path.join(folder, name))


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}")


def save(df: DataFrame, folder: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{folder}/{name}")


def modified(path: str) -> float:
    """A folder is as old as its completion marker."""
    marker = os.path.join(path, "_SUCCESS")
    return os.path.getmtime(marker if os.path.exists(marker) else path)


def is_stale(output: str, needs: list[str], force: bool = False, params: dict | None = None) -> bool:
    """Rebuild if forced, missing, incomplete, older than what it needs, or built with other parameters."""
    if gone := [n for n in needs if not os.path.exists(n)]:
        raise FileNotFoundError(f"missing: {', '.join(gone)}")
    if force or not os.path.exists(output) or os.path.isdir(output) and not os.path.exists(os.path.join(output, "_SUCCESS")):
        return True
    if params is not None and read_params(output) != json.loads(json.dumps(params)):
        return True
    return any(modified(n) > modified(output) for n in needs)


def _params_file(output: str) -> str:
    return os.path.join(os.path.dirname(output.rstrip("/")), f".{os.path.basename(output.rstrip('/'))}.json")


def read_params(output: str) -> dict | None:
    p = _params_file(output)
    return json.loads(Path(p).read_text()) if os.path.exists(p) else None


def write_params(output: str, params: dict) -> None:
    Path(_params_file(output)).write_text(json.dumps(params, sort_keys=True))
