"""A log of commits in a folder: what belongs to a table that several writers append to.

Each commit is one small file with a number of its own, written beside and renamed to its place; a rename fails where the
name is taken, so of two writers one loses and starts over from the newer state. Folders that no commit names don't
count: whatever a failed writer left behind is never read.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

FOLDER = "_commits"
#: Commits are numbered in so many digits, so that names sort as numbers.
DIGITS = 12


def _hadoop(spark: SparkSession, folder: str) -> tuple[Any, Any, Any]:
    """(the folder of commits, its file system, its file context)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder, FOLDER)
    system = path.getFileSystem(conf)
    path = path.makeQualified(system.getUri(), system.getWorkingDirectory())
    return path, system, jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf)


def last(spark: SparkSession, folder: str) -> tuple[int, dict]:
    """(number, content) of the last commit; (0, {}) if there is none. Each commit tells the whole state, so older ones aren't read."""
    path, system, _ = _hadoop(spark, folder)
    if not system.exists(path):
        return 0, {}
    numbers = [int(name) for f in system.listStatus(path) if (name := f.getPath().getName()).isdigit()]
    if not numbers:
        return 0, {}
    number = max(numbers)
    stream = system.open(spark._jvm.org.apache.hadoop.fs.Path(path, f"{number:0{DIGITS}}"))
    try:
        return number, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Write commit ``number``; False if another writer has taken that number."""
    jvm = spark._jvm
    path, system, context = _hadoop(spark, folder)
    beside = jvm.org.apache.hadoop.fs.Path(path, f".{uuid.uuid4().hex}")
    stream = system.create(beside, False)
    try:
        stream.write(json.dumps(content).encode())
    finally:
        stream.close()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(beside, jvm.org.apache.hadoop.fs.Path(path, f"{number:0{DIGITS}}"), options)
    except Py4JJavaError as e:
        system.delete(beside, False)
        if "FileAlreadyExistsException" in str(e.java_exception):
            return False
        raise
    return True


def new_part(name: str) -> str:
    return f"{name}-{uuid.uuid4().hex}"
