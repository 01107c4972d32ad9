"""Small files and renames through Hadoop's file systems, so that a store can live wherever Spark can write."""

from __future__ import annotations

import json
import os
import uuid
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.gateway = spark.sparkContext._gateway
        self.conf = spark._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")
        self.system = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def read_json(self, name: str) -> Any:
        stream = self.system.open(self.path(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def create_json(self, name: str, value: Any) -> bool:
        """Write beside the file, then put in its place in one step; False, and nothing changed, if there is a file of that name."""
        temporary = f".{name}.{uuid.uuid4().hex}"
        stream = self.system.create(self.path(temporary), True)
        try:
            stream.write(bytearray(json.dumps(value, sort_keys=True).encode()))
        finally:
            stream.close()
        source, target = (self.system.makeQualified(self.path(n)) for n in (temporary, name))
        try:
            if target.toUri().getScheme() == "file":  # Hadoop's rename on local disks looks first and moves then
                os.link(source.toUri().getPath(), target.toUri().getPath())
                return True
            contexts, options = self.jvm.org.apache.hadoop.fs.FileContext, self.jvm.org.apache.hadoop.fs.Options.Rename
            how = self.gateway.new_array(options, 1)
            how[0] = options.NONE
            contexts.getFileContext(target.toUri(), self.conf).rename(source, target, how)
            return True
        except FileExistsError:
            return False
        except Py4JJavaError:
            if self.exists(name):
                return False
            raise
        finally:
            self.delete(temporary)

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def folders(self, name: str) -> list[str]:
        if not self.exists(name):
            return []
        return [f.getPath().getName() for f in self.system.listStatus(self.path(name)) if f.isDirectory()]

    def names(self, pattern: str) -> list[str]:
        """Files right under the root that match a pattern, in order."""
        found = self.system.globStatus(self.path(pattern))
        return sorted(f.getPath().getName() for f in found or ())
