"""Small files of a shared folder, through the Hadoop file system: made whole in one step, never replaced."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    """Files below `root`, which driver and executors share."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def at(self, path: str):
        """The file system and Hadoop path of `path`."""
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def exists(self, path: str) -> bool:
        fs, p = self.at(path)
        return fs.exists(p)

    def delete(self, path: str) -> None:
        fs, p = self.at(path)
        fs.delete(p, True)

    def names(self, folder: str) -> list[str]:
        """Names of what a folder holds; none without the folder."""
        fs, p = self.at(folder)
        return [f.getPath().getName() for f in fs.listStatus(p)] if fs.exists(p) else []

    def text(self, path: str) -> str:
        return self.spark.read.text(path, wholetext=True).first()[0]

    def put_once(self, path: str, content: str) -> bool:
        """Makes a file with its whole content in one step; False, without doing anything, if there is one.

        A rename does it where it doesn't replace, as on HDFS. A local rename replaces, so there a hard link is made."""
        fs, p = self.at(path)
        _, draft = self.at(f"{self.root}/_drafts/{uuid.uuid4().hex}")
        out = fs.create(draft, False)
        out.write(bytearray(content.encode()))
        out.close()
        fs.mkdirs(p.getParent())
        try:
            if fs.getScheme() != "file":
                return bool(fs.rename(draft, p))
            local = self.spark._jvm.java.io.File
            self.spark._jvm.java.nio.file.Files.createLink(local(p.toUri().getPath()).toPath(), local(draft.toUri().getPath()).toPath())
            return True
        except Py4JJavaError as e:
            if "AlreadyExists" not in e.java_exception.getClass().getName():
                raise
            return False
        finally:
            if fs.exists(draft):
                fs.delete(draft, False)
