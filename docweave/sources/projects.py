"""Where a project keeps its dependency files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

# The files that name dependencies, and the folders of a project of many packages.
DEPENDENCY_FILES = ("package.json", "requirements.txt", "pyproject.toml")
PACKAGE_FOLDERS = ("apps", "packages", "services", "libs")


def dependency_files(start: str | Path, name: str, levels: int = 5, top: str | Path | None = None) -> list[Path]:
    """The nearest file of that name in start or the folders above it, then those one level down in PACKAGE_FOLDERS.

    levels counts start itself; the search ends at top (the user's home by default) and at the root.
    """
    start = Path(start).resolve()
    top = Path(top).resolve() if top else Path.home().resolve()
    found: list[Path] = []
    for folder in [start, *start.parents][:levels]:
        if (folder / name).is_file():
            found.append(folder / name)
            break
        if folder == top:
            break
    for group in PACKAGE_FOLDERS:
        if (start / group).is_dir():
            found += [child / name for child in sorted((start / group).iterdir()) if (child / name).is_file()]
    return found


def project_files(spark: SparkSession, start: str | Path, top: str | Path | None = None) -> DataFrame:
    """project, file, path and text of a project's dependency files, in the order in which they count."""
    rows = [(str(start), name, str(p), p.read_text(encoding="utf-8", errors="replace")) for name in DEPENDENCY_FILES for p in dependency_files(start, name, top=top)]
    return spark.createDataFrame(rows, "project string, file string, path string, text string")
