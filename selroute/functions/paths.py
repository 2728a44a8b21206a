"""Facts that live in file paths: time stamps, tasks, models and run keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the time stamp that ends a sample file name.
STAMP = r"20\d{2}-\d{2}-\d{2}T\d{2}-\d{2}-\d{2}(?:\.\d+)?"


def decoded(file_path: Column) -> Column:
    """Plain path of a ``_metadata.file_path`` URI; a plus sign in it is literal."""
    return F.url_decode(F.replace(file_path, F.lit("+"), F.lit("%2B")))


def stamp(path: Column) -> Column:
    """First time stamp in the path, NULL when there is none."""
    return F.nullif(F.regexp_extract(path, STAMP, 0), F.lit(""))


def stampless(path: Column) -> Column:
    """The path without its first time stamp and without one separator right before it."""
    return F.regexp_replace(path, rf"^((?s:.*?))[_\-.]?{STAMP}", "$1")


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def parent_folder(path: Column) -> Column:
    return F.get(F.reverse(F.split(path, "/")), 1)


def sample_file_task(path: Column) -> Column:
    """Middle part of ``samples_<task>_<stamp>.<ext>``; the task may hold underscores itself."""
    parts = F.split(file_name(path), "_")
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def sample_file_stamp(path: Column) -> Column:
    """Last underscore part of the file name without its extension."""
    tail = F.element_at(F.split(file_name(path), "_"), -1)
    return F.regexp_replace(tail, r"\.[^.]*$", "")


def run_folder_task(folder: Column) -> Column:
    """Text before the first colon of the last folder name."""
    return F.substring_index(F.element_at(F.split(folder, "/"), -1), ":", 1)
