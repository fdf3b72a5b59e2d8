"""A versioned pointer in a shared folder: what it names counts, everything else in the folder doesn't."""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import SparkSession


class Manifest:
    """Publishes one JSON object at a time. A version becomes visible by renaming one file, so a writer that breaks off changes nothing."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self._paths = spark._jvm.org.apache.hadoop.fs.Path
        root = self._paths(self.folder)
        self._fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(root)

    def version(self) -> int:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._paths(self.folder))]
        return max((int(n[9:17]) for n in names if n.startswith("manifest-")), default=0)

    def read(self) -> Any:
        """The object published last, or None."""
        n = self.version()
        return json.loads(self.spark.sparkContext.wholeTextFiles(f"{self.folder}/manifest-{n:08d}").first()[1]) if n else None

    def publish(self, value: Any, after: int) -> None:
        """Publish value as the version after ``after``; fails if another writer was first."""
        draft, final = self._paths(f"{self.folder}/.draft-{uuid.uuid4().hex}"), self._paths(f"{self.folder}/manifest-{after + 1:08d}")
        out = self._fs.create(draft, True)
        out.write(bytearray(json.dumps(value).encode()))
        out.close()
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            raise RuntimeError(f"{final} was published by another writer")
