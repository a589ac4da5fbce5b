"""What a library path says about a file."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.fixed import DOMAIN_FOLDERS, FILE_TYPES, IGNORED_FOLDER_PART, SCAN_FOLDERS, SCAN_NAME_HINTS


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, "([^/]*)$", 1)


def looks_scanned(path: Column) -> Column:
    stem = F.lower(F.regexp_replace(file_name(path), r"\.[^.]*$", ""))
    folders = F.transform(F.split(path, "/"), lambda p: F.lower(p))
    return stem.rlike("|".join(SCAN_NAME_HINTS)) | F.arrays_overlap(folders, F.array(*[F.lit(f) for f in SCAN_FOLDERS]))


def file_type(path: Column) -> Column:
    """Type by extension; an image whose path says so is a scanned document."""
    ext = extension(path)
    kind = F.lit("unknown")
    for name, endings in FILE_TYPES.items():
        kind = F.when(ext.isin(*endings), name).otherwise(kind)
    return F.when((kind == "image") & looks_scanned(path), "scanned_document").otherwise(kind)


def in_ignored_folder(path: Column) -> Column:
    return F.lower(F.regexp_replace(path, "[^/]*$", "")).contains(IGNORED_FOLDER_PART)


def supported(path: Column, ignored_extensions: tuple[str, ...] = ()) -> Column:
    ext = extension(path)
    known = [e for endings in FILE_TYPES.values() for e in endings]
    keep = ext.isin(*known) & ~in_ignored_folder(path)
    return keep & ~ext.isin(*ignored_extensions) if ignored_extensions else keep


def extension_list(values: list[str]) -> tuple[str, ...]:
    """Configured extensions without dots, blanks or case."""
    return tuple(dict.fromkeys(v.strip().lower().lstrip(".") for v in values if v and v.strip()))


def domain(relative: Column, enabled: tuple[str, ...] = DOMAIN_FOLDERS) -> Column:
    top = F.lower(F.get(F.split(relative, "/"), F.lit(0)))
    return F.when(top.isin(*enabled), top).otherwise("")


def collection(relative: Column, enabled: tuple[str, ...] = DOMAIN_FOLDERS) -> Column:
    """Folder below the domain, else the first folder; '_general' without one."""
    parts = F.split(relative, "/")
    inside = F.lower(F.get(parts, F.lit(0))).isin(*enabled)
    at = F.when(inside, 1).otherwise(0)
    return F.when(F.size(parts) <= at + 1, "_general").otherwise(F.get(parts, at))
