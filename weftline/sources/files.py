"""Scanning source trees, ignore rules, hashes and change detection."""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.vocabulary import EXTENSIONS, SKIPPED_FOLDERS


FILES = "file string, relative string, language string, module string, content binary, sha256 string"
#: What ends a line of text: all line boundaries of Unicode text.
LINE_ENDS = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085\u2028\u2029]"


def language_of(path: Column) -> Column:
    """The language of a path by its extension in any case, or null."""
    names = F.create_map(*(F.lit(v) for kv in EXTENSIONS.items() for v in kv))
    return F.try_element_at(names, F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)))


def module_of(relative: Column) -> Column:
    """Dotted module name of a relative path; a package's __init__ is the package, that of the root is ''."""
    stem = F.regexp_replace(relative, r"\.[^./]+$", "")
    return F.translate(F.regexp_replace(stem, r"(^|/)__init__$", ""), "/", ".")


def relative_to(path: Column, root: str) -> Column:
    """A file URI or path without the root in front."""
    plain = F.regexp_replace(path, r"^file:/*", "/")
    return F.substring(plain, F.lit(len(root.rstrip("/")) + 2), F.char_length(plain))


def _system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path in it."""
    made = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), made


def _content(spark: SparkSession, system, path) -> bytes:
    stream = system.open(path)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def ignore_patterns(spark: SparkSession, root: str) -> list[str]:
    """Lines of the root's .gitignore but blanks and comments; an ignore file is one small file."""
    system, path = _system(spark, f"{root.rstrip('/')}/.gitignore")
    lines = [x.strip() for x in _content(spark, system, path).decode("utf-8", "replace").splitlines()] if system.exists(path) else []
    return [x for x in lines if x and not x.startswith("#")]


def ignored(relative: Column, patterns: list[str]) -> Column:
    """Whether a glob matches the path, all below it, its name or any folder on it; no negation, no anchoring."""
    out = F.lit(False)
    for p in patterns:
        glob = p.rstrip("/")
        whole = fnmatch.translate(glob).replace(r"\z", r"\Z")
        below = fnmatch.translate(f"{glob}/*").replace(r"\z", r"\Z")
        out = out | relative.rlike(f"^{whole}") | relative.rlike(f"^{below}") | F.exists(F.split(relative, "/"), _part_matches(f"^{whole}"))
    return out


def _part_matches(pattern: str):
    return lambda part: part.rlike(pattern)


def skipped(relative: Column) -> Column:
    """Whether the path lies in a folder that scans never enter."""
    folders = F.split(F.regexp_replace(relative, r"[^/]*$", ""), "/")
    return F.arrays_overlap(folders, F.array(*(F.lit(x) for x in SKIPPED_FOLDERS)))


#: How Hadoop shows what it knows of a file; one text for a folder costs the driver one call.
_SHOWN = re.compile(r"Status\{path=(?P<path>.*?); isDirectory=(?P<folder>true|false)(?:; length=(?P<length>\d+))?.*?; modification_time=(?P<time>\d+);", re.S)


def walk(spark: SparkSession, root: str) -> Iterator[tuple[str, int, int]]:
    """(path, modification time in ms, length) of all files below root but in skipped folders.  Spark's own listing leaves out names that begin with an underscore or a point, and with them the __init__.py of packages."""
    system, top = _system(spark, root)
    shown = spark.sparkContext._jvm.org.apache.commons.lang3.ArrayUtils.toString
    make = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    todo = [top]
    while todo:
        for m in _SHOWN.finditer(shown(system.listStatus(todo.pop()))):
            if m["folder"] == "false":
                yield m["path"], int(m["time"]), int(m["length"] or 0)
            elif m["path"].rpartition("/")[2] not in SKIPPED_FOLDERS:
                todo.append(make(m["path"]))


def listing(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """(path, relative, language, modified, length) of every known source file under root: names, times and sizes only, no content is read."""
    patterns = ignore_patterns(spark, root) if patterns is None else patterns
    known = tuple({*EXTENSIONS, ".py"})
    found = [(p, t, n) for p, t, n in walk(spark, root) if p.lower().endswith(known)]
    rows = spark.createDataFrame(found, "path string, ms long, length long").select("path", relative_to(F.col("path"), root).alias("relative"), F.timestamp_millis("ms").alias("modified"), "length").withColumn("language", language_of(F.col("relative")))
    return rows.where(F.col("language").isNotNull() & ~skipped(F.col("relative")) & ~ignored(F.col("relative"), patterns))


def _literal(path: str) -> str:
    """A path in which signs of globs stand for themselves."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def read(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """(file, relative, language, module, content, sha256) of the files at the given paths.  Executors read them; the few whose names Spark's reader passes over come through the driver."""
    passed_over = [p for p in paths if any(x[:1] in "_." for x in p.rpartition("/")[2:])]
    plain = [p for p in paths if p not in set(passed_over)]
    rows = []
    for p in passed_over:
        system, path = _system(spark, p)
        rows.append((p, bytearray(_content(spark, system, path))))
    found = spark.createDataFrame(rows, "path string, content binary")
    if plain:
        found = found.unionByName(spark.read.format("binaryFile").load([_literal(p) for p in plain]).select("path", "content"))
    found = found.select(relative_to(F.col("path"), root).alias("relative"), "content").withColumns({"language": language_of(F.col("relative")), "file": F.col("relative")})
    return found.where(F.col("language").isNotNull()).select("file", "relative", "language", module_of(F.col("relative")).alias("module"), "content", F.sha2("content", 256).alias("sha256"))


def scan(spark: SparkSession, root: str, patterns: list[str] | None = None) -> DataFrame:
    """Every known source file under root with its content.  Names decide first, so that content of skipped and ignored files is never read; the driver holds the names, as it does for any listing."""
    return read(spark, root, [r["path"] for r in listing(spark, root, patterns).select("path").toLocalIterator()])


def pick(spark: SparkSession, root: str, files: list[str]) -> DataFrame:
    """The named files only, without a scan or a look at hashes; unknown languages and missing files are left out."""
    found = [_system(spark, f"{root.rstrip('/')}/{f}") for f in dict.fromkeys(files)]
    return read(spark, root, [system.getFileStatus(p).getPath().toString() for system, p in found if system.exists(p) and system.getFileStatus(p).isFile()])


def changes(files: DataFrame, hashes: DataFrame) -> DataFrame:
    """files with ``changed``: new, or with another hash than the stored one."""
    old = hashes.select("file", F.col("sha256").alias("old_sha"))
    return files.join(old, "file", "left").withColumn("changed", ~F.col("sha256").eqNullSafe(F.col("old_sha"))).drop("old_sha")


def source_lines(content: Column, start: Column, end: Column) -> Column:
    """Lines start to end (from 1, both inclusive) of a text."""
    lines = F.split(content, LINE_ENDS)
    return F.array_join(F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - F.greatest(start, F.lit(1)) + 1, F.lit(0))), "\n")
