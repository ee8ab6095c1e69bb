"""Load-or-compute: reuse a saved result when it exists, else compute it once,
write it to the shared folder and read it back (cutting the lineage)."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession

from topicspace.session import shared_dir


def _fs_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def input_fingerprint(spark: SparkSession, inputs: Sequence[str]) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of every file at or below the input paths."""
    conf, found = spark.sparkContext._jsc.hadoopConfiguration(), []
    for name in inputs:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        fs = p.getFileSystem(conf)
        if not fs.exists(p):
            continue
        if fs.getFileStatus(p).isFile():
            s = fs.getFileStatus(p)
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
            continue
        files = fs.listFiles(p, True)
        while files.hasNext():
            s = files.next()
            found.append((s.getPath().toString(), s.getLen(), s.getModificationTime()))
    return sorted(found)


def result_path(spark: SparkSession, name: str, params: dict | None = None,
                base: str | None = None, inputs: Sequence[str] = ()) -> str:
    key = hashlib.sha1(json.dumps([params or {}, input_fingerprint(spark, inputs)],
                                  sort_keys=True, default=str).encode()).hexdigest()[:12]
    return f"{(base or shared_dir(spark)).rstrip('/')}/{name}-{key}"


def saved(spark: SparkSession, path: str) -> bool:
    """Whether a whole result lies at ``path``."""
    return _fs_exists(spark, f"{path}/_SUCCESS")


def commit(spark: SparkSession, made: str, path: str) -> bool:
    """Move the whole result ``made`` to ``path`` in one rename that fails if something
    whole is there already; then ``made`` is removed and the other run's result stays. What an
    interrupted writer left at ``path`` gives way. Returns whether ``made`` is it now."""
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    source, target = fs.Path(made), fs.Path(path)
    files = target.getFileSystem(conf)
    if files.exists(target) and not saved(spark, path):
        files.delete(target, True)
    if not files.exists(target):
        files.mkdirs(target.getParent())
        context = fs.FileContext.getFileContext(target.toUri(), conf)
        none = spark.sparkContext._gateway.new_array(
            getattr(spark.sparkContext._jvm, "org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(context.makeQualified(source), context.makeQualified(target), none)
            return True
        except Exception:
            if not saved(spark, path):
                raise
    files.delete(source, True)
    return False


def materialize(spark: SparkSession, name: str, compute: Callable[[], DataFrame],
                params: dict | None = None, base: str | None = None,
                text_copy: bool = False, inputs: Sequence[str] = ()) -> DataFrame:
    """Return the saved result ``name`` (keyed by a hash of ``params`` and of the files
    at the paths ``inputs``, so changed input is computed anew) or compute, save as Parquet
    and return the saved copy. With ``text_copy`` a CSV dump is written next to it from the
    saved copy (no recomputation).

    A result is written aside and moved to its name when it is whole. Of runs that
    compute the same result at a time, the first to end gives it its name, and all read
    that one."""
    path = result_path(spark, name, params, base, inputs)
    if not saved(spark, path):
        made = f"{path}.{uuid.uuid4().hex}"
        compute().write.parquet(made)
        if commit(spark, made, path) and text_copy:
            spark.read.parquet(path).write.mode("overwrite").csv(f"{path}-txt")
    return spark.read.parquet(path)
