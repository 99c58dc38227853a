"""Path columns: relative path, extension, base name, directory and extension filters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's behaviour.
# Extensions indexed by default, in the reference's order, plus the YAML
# short form that has a handler (decision: index it too).
DEFAULT_EXTENSIONS = [".java", ".py", ".xml", ".yaml", ".properties", ".sql", ".md"]
INDEXED_EXTENSIONS = DEFAULT_EXTENSIONS + [".yml"]
# Directory names skipped during a walk; any directory starting with "." is skipped too.
SKIPPED_DIRS = ["node_modules", "dist", "build", "target"]

# A directory component (something followed by "/") that is hidden or skipped.
SKIPPED_DIR_PATTERN = r"(^|/)(\.[^/]*|" + "|".join(SKIPPED_DIRS) + r")/"
# os.path.splitext: the last dot of the base name, ignoring leading dots.
EXT_PATTERN = r"^\.*[^.].*(\.[^.]*)$"


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Extension with its dot, '' when none (``os.path.splitext``)."""
    return F.regexp_extract(basename(path), EXT_PATTERN, 1)


def relative_path(path: Column, root: str) -> Column:
    """Path relative to ``root`` (a prefix), without a leading slash."""
    prefix = root.rstrip("/") + "/"
    return F.when(path.startswith(prefix), F.substring(path, len(prefix) + 1, 1 << 30)).otherwise(path)


def not_in_skipped_dir(rel_path: Column) -> Column:
    """no directory component is hidden or a build/dependency folder.

    File names are not tested, only directories (the reference walk prunes
    directories, never files).
    """
    return ~rel_path.rlike(SKIPPED_DIR_PATTERN)


def ext_in(ext: Column, exts: list[str] | None = None) -> Column:
    """extension whitelist (a project's own list, or the default with ``.yml``)."""
    return ext.isin(exts or INDEXED_EXTENSIONS)
