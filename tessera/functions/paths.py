"""Path rules: base and directory names, normalised keys, containment, media kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extensions by media kind.
IMAGE_EXTENSIONS = ["jpg", "jpeg", "png", "bmp", "heic", "heif", "tif", "tiff"]
ANIMATED_EXTENSIONS = ["gif", "webp"]
VIDEO_EXTENSIONS = ["mp4", "mov", "m4v", "wmv", "webm"]


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def dir_name(path: Column) -> Column:
    """Text before the last separator, '' without one."""
    return F.regexp_extract(path, r"^(.*)[/\\][^/\\]*$", 1)


def path_key(path: Column) -> Column:
    """Separators unified, trailing ones gone, lower case."""
    return F.lower(F.regexp_replace(F.replace(F.trim(path), F.lit("/"), F.lit("\\")), r"\\+$", ""))


def is_under(path: Column, root: Column) -> Column:
    """Whether ``path`` is the root or lies below it, without regard to case or separator."""
    p, r = path_key(path), path_key(root)
    return (p == r) | F.startswith(p, F.concat(r, F.lit("\\")))


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))


def media_kind(path: Column) -> Column:
    ext = extension(path)
    return F.when(ext.isin(IMAGE_EXTENSIONS), "image").when(ext.isin(ANIMATED_EXTENSIONS), "animated").when(ext.isin(VIDEO_EXTENSIONS), "video")


def ancestors(path: Column, separator: str = "/") -> Column:
    """All prefixes of a path that end before a separator, longest first: the keys under which a root can own it."""
    parts = F.split(path, separator)  # a pattern
    lengths = F.sequence(F.size(parts), F.lit(1), F.lit(-1))
    return F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator.replace("\\\\", "\\")))
