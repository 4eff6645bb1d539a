"""Counting lines, guarding blobs, and recognising languages and tests by path."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BLOB, SNIFFED = 2 * 1024 * 1024, 8 * 1024

#: Languages by lower-case extension (fixed values).
LANGUAGES = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript", "ts": "TypeScript", "tsx": "TSX",
    "go": "Go", "c": "C", "h": "C", "cpp": "C++", "cc": "C++", "cxx": "C++", "hpp": "C++", "hh": "C++", "hxx": "C++", "lua": "Lua", "vim": "Vim Script",
    "java": "Java", "rb": "Ruby", "sh": "Bash", "bash": "Bash", "html": "HTML", "htm": "HTML", "css": "CSS", "json": "JSON", "php": "PHP",
    "ml": "OCaml", "mli": "OCaml", "scala": "Scala", "sc": "Scala", "hs": "Haskell", "md": "Markdown", "markdown": "Markdown",
}


def count_lines(text: Column) -> Column:
    """Newlines, and one more for a last line that has none."""
    newlines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return (newlines + F.when((text != "") & ~F.endswith(text, F.lit("\n")), 1).otherwise(0)).cast("int")


def readable(content: Column, most: int = MAX_BLOB, sniffed: int = SNIFFED) -> Column:
    """Whether a blob has `most` bytes at most and no zero byte among its first `sniffed`."""
    return (F.length(content) <= most) & (F.position(F.lit(b"\x00"), F.substring(content, 1, sniffed)) == 0)


def language_of(path: Column) -> Column:
    """The language of a path's extension; null for others."""
    extension = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(LANGUAGES.items())])[extension]


def is_test_path(path: Column) -> Column:
    lower = F.lower(path)
    name = F.substring_index(lower, "/", -1)
    folders = F.rlike(lower, F.lit(r"(^|/)(tests|__tests__)/"))
    names = F.rlike(name, F.lit(r"\.spec\.|\.test\.(js|ts|jsx|tsx)$|_test\.(c|cc|cpp|cxx)$|^test_.*\.(py|c|cc|cpp|cxx)$"))
    return folders | names


def module_of(path: Column, depth: int = 1) -> Column:
    """The first `depth` segments of a path; a shorter path is its own module."""
    if depth < 1:
        raise ValueError("depth must be 1 or more")
    return F.substring_index(path, "/", depth)
