"""Partition directories of plain Parquet tables: list, drop, swap."""

from __future__ import annotations

import json
import re
from functools import lru_cache

from py4j.java_gateway import JavaClass, JavaObject, JVMView
from pyspark.sql import SparkSession

PLAN_FILE = "_swap.json"


@lru_cache(maxsize=8)
def _java(jvm: JVMView, name: str) -> JavaClass:
    """A class of the JVM; every part of its name would be a call of its own."""
    for part in name.split("."):
        jvm = getattr(jvm, part)
    return jvm


def _path(spark: SparkSession, path: str) -> JavaObject:
    return _java(spark.sparkContext._jvm, "org.apache.hadoop.fs.Path")(path)


def _at(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    """A path and its file system."""
    where = _path(spark, path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def _fs(spark: SparkSession, path: str) -> JavaObject:
    return _at(spark, path)[0]


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def _ends(spark: SparkSession, found: JavaObject, pattern: str) -> list[tuple[str, ...]]:
    """What a pattern finds at the end of each listed path; the listing comes over as one text."""
    jvm = spark.sparkContext._jvm
    paths = _java(jvm, "org.apache.hadoop.fs.FileUtil").stat2Paths(found)
    text = _java(jvm, "scala.runtime.ScalaRunTime").stringOf(paths)
    return [m.groups() for m in re.finditer(rf"{pattern}(?=, |\)$)", text)]


def _below(path: str) -> str:
    return f"/{re.escape(path.rstrip('/').rsplit('/', 1)[-1])}/([^/]+?)"


def subdirs(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the directories directly below a path. A prefix must be one that only directories have."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    found = fs.listStatus(where)
    if prefix:
        return sorted(n for n, in _ends(spark, found, _below(path)) if n.startswith(prefix))
    return sorted(s.getPath().getName() for s in found if s.isDirectory())


def partitions(spark: SparkSession, path: str, *keys: str, **only: str) -> list[tuple[str, ...]]:
    """Values of the partition directories ``k1=v1/k2=v2`` below a path, ``only`` those with a given value of a key."""
    plain = re.sub(r"([*?\[\]{}\\])", r"\\\1", path)
    fs, where = _at(spark, "/".join([plain, *(f"{key}={only.get(key, '*')}" for key in keys)]))
    found = fs.globStatus(where)
    return sorted(_ends(spark, found, "".join(f"/{key}=([^/]*?)" for key in keys))) if found else []


def marks(spark: SparkSession, path: str) -> list[str]:
    """Names of what marks a folder."""
    fs, where = _at(spark, path)
    return [n for n, in _ends(spark, fs.listStatus(where), _below(path))] if fs.exists(where) else []


def add_mark(spark: SparkSession, path: str) -> None:
    """An empty folder: a local file would cost a process that sets its rights. Older stores have empty files."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        fs.mkdirs(where)


def add_note(spark: SparkSession, path: str, found: object) -> None:
    """A file that holds something; it is there as a whole or not at all."""
    folder, name = path.rsplit("/", 1)
    _write_text(spark, f"{folder}/.{name}", json.dumps(found))
    if not _fs(spark, path).rename(_path(spark, f"{folder}/.{name}"), _path(spark, path)):
        raise OSError(f"cannot write {path}")


def note(spark: SparkSession, path: str) -> object:
    return json.loads(_read_text(spark, path))


def size(spark: SparkSession, path: str) -> int:
    """Bytes of all files below a path."""
    if not exists(spark, path):
        return 0
    return _fs(spark, path).getContentSummary(_path(spark, path)).getLength()


def latest_mark(spark: SparkSession, path: str) -> int | None:
    """The highest number a folder was marked with."""
    if not exists(spark, path):
        return None
    found = _fs(spark, path).listStatus(_path(spark, path))
    return max((int(status.getPath().getName()) for status in found), default=None)


def mark(spark: SparkSession, path: str, number: int) -> None:
    """Mark a folder with a number: one empty file, so the step is atomic."""
    fs = _fs(spark, path)
    fs.create(_path(spark, f"{path}/{number}"), True).close()
    for status in fs.listStatus(_path(spark, path)):
        if int(status.getPath().getName()) < number:
            fs.delete(status.getPath(), False)


def drop(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)


def _write_text(spark: SparkSession, path: str, text: str) -> None:
    out = _fs(spark, path).create(_path(spark, path), True)
    out.write(bytearray(text.encode()))
    out.close()


def _read_text(spark: SparkSession, path: str) -> str:
    stream = _fs(spark, path).open(_path(spark, path))
    try:
        reader = spark.sparkContext._jvm.org.apache.commons.io.IOUtils
        return reader.toString(stream, "UTF-8")
    finally:
        stream.close()


def swap(spark: SparkSession, staged: str, target: str, replaced: list[str], new: list[str]) -> None:
    """Replace partition directories of a table by staged ones.

    The plan is written down before anything is touched, so a job that dies
    half-way is completed by ``resume_swaps``: every step can be repeated.
    """
    plan = {"target": target, "replaced": replaced, "new": new}
    _write_text(spark, f"{staged}/{PLAN_FILE}", json.dumps(plan))
    _carry_out(spark, staged, plan, new)


def _carry_out(spark: SparkSession, staged: str, plan: dict, waiting: list[str]) -> None:
    """``waiting`` are the new directories that have not moved in yet."""
    fs, target = _fs(spark, plan["target"]), plan["target"]
    moved = set(plan["new"]) - set(waiting)
    for name in plan["replaced"]:
        # A directory that is replaced by one of the same name stays once the
        # new one has moved in.
        if name not in moved:
            fs.delete(_path(spark, f"{target}/{name}"), True)
    for parent in sorted({f"{target}/{name}".rsplit("/", 1)[0] for name in waiting}):
        fs.mkdirs(_path(spark, parent))
    for name in waiting:
        if not fs.rename(_path(spark, f"{staged}/{name}"), _path(spark, f"{target}/{name}")):
            raise OSError(f"cannot move {staged}/{name} to {target}/{name}")
    drop(spark, staged)


def resume_swaps(spark: SparkSession, staging_root: str) -> None:
    """Finish swaps a dead job left behind; unfinished stagings are discarded."""
    for name in subdirs(spark, staging_root):
        staged = f"{staging_root}/{name}"
        if exists(spark, f"{staged}/{PLAN_FILE}"):
            plan = json.loads(_read_text(spark, f"{staged}/{PLAN_FILE}"))
            _carry_out(spark, staged, plan, [new for new in plan["new"] if exists(spark, f"{staged}/{new}")])
        else:
            drop(spark, staged)
