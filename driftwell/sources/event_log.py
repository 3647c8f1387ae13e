"""A log of numbered JSON events that concurrent writers can append to.

An event is written to a file of its own and then given the next number by one step that fails if the number is taken:
a hard link on a local file system, a rename that doesn't overwrite on others, which HDFS does atomically. A writer that
loses reads the log again and tries the next number. Readers see whole events only. A store whose rename isn't atomic
doesn't keep this promise.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from typing import Any
from urllib.parse import urlparse

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType, _parse_datatype_string

DIGITS = 12


class EventLog:
    """Events under ``root``, one file each, named by their number; ``schema`` has their fields and begins with ``seq long``."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema: StructType = _parse_datatype_string(schema)

    def events(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.schema).json(f"{self.root}/*.json")
        except AnalysisException:
            return self.spark.createDataFrame([], self.schema)

    def append(self, make: Callable[[int, DataFrame], dict[str, Any]], attempts: int = 100) -> dict[str, Any]:
        """Add the event that ``make(number, events so far)`` gives, and return it; made anew when another writer takes the number."""
        for _ in range(attempts):
            seq = self._last() + 1
            event = {**make(seq, self.events()), "seq": seq}
            if self._claim(seq, json.dumps(event)):
                return event
        raise RuntimeError(f"no number was free in {attempts} attempts")

    def _hadoop(self, path: str):
        jvm = self.spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where, where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _last(self) -> int:
        folder, files = self._hadoop(self.root)
        if not files.exists(folder):
            return 0
        names = [f.getPath().getName() for f in files.listStatus(folder)]
        return max((int(n[:DIGITS]) for n in names if n.endswith(".json") and n[:DIGITS].isdigit()), default=0)

    def _claim(self, seq: int, text: str) -> bool:
        # Names that begin with a dot are not read as events.
        draft, files = self._hadoop(f"{self.root}/.{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(text.encode()))
        out.close()
        target, _ = self._hadoop(f"{self.root}/{seq:0{DIGITS}d}.json")
        try:
            if files.getScheme() == "file":
                os.link(urlparse(draft.toString()).path, urlparse(target.toString()).path)
                return True
            return self._renamed(draft, target)
        except FileExistsError:
            return False
        finally:
            if files.exists(draft):
                files.delete(draft, False)

    def _renamed(self, draft, target) -> bool:
        jvm = self.spark.sparkContext._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        kind = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        options = self.spark.sparkContext._gateway.new_array(kind, 1)
        options[0] = kind.NONE
        try:
            context.rename(draft, target, options)
        except Py4JJavaError as error:
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True
