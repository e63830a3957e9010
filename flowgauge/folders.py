"""Folders on whatever file system a path names, through Hadoop's own client."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Folder:
    """A folder that may exist. Listing goes one level deep and reads no data."""

    spark: SparkSession
    path: str

    def _place(self, path: str | None = None):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path or self.path)

    def _files(self):
        return self._place().getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def __truediv__(self, name: str) -> Folder:
        return Folder(self.spark, f"{self.path}/{name}")

    @property
    def name(self) -> str:
        return self.path.rsplit("/", 1)[-1]

    def exists(self) -> bool:
        return self._files().exists(self._place())

    def names(self) -> list[str]:
        """Names of what lies in the folder, in order; none when it does not exist."""
        if not self.exists():
            return []
        return sorted(s.getPath().getName() for s in self._files().listStatus(self._place()))

    def values(self, column: str) -> list[str]:
        """Values of a partition column whose folders lie here."""
        head = f"{column}="
        return [n.removeprefix(head) for n in self.names() if n.startswith(head)]

    def delete(self) -> None:
        self._files().delete(self._place(), True)

    def age_seconds(self) -> float:
        """Seconds since the folder or file was last changed, by the file system's clock."""
        changed = self._files().getFileStatus(self._place()).getModificationTime()
        return self.spark.sparkContext._jvm.System.currentTimeMillis() / 1000 - changed / 1000

    def text(self, name: str) -> str | None:
        """What a small file holds; None if there is none of that name."""
        place = self._place(f"{self.path}/{name}")
        try:
            stream = self._files().open(place)
        except Py4JJavaError as error:
            if not _is(error, "FileNotFoundException"):
                raise
            return None
        try:
            return self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a small file, which appears whole or not at all; False if there is one of that name
        already, which stays as it is."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        target = self._place(f"{self.path}/{name}")
        hidden = self._place(f"{self.path}/.{name}.{uuid.uuid4().hex}")
        files = target.getFileSystem(conf)
        files.mkdirs(target.getParent())
        stream = files.create(hidden)
        jvm.org.apache.commons.io.IOUtils.write(text, stream, "UTF-8")
        stream.close()
        # Renamed as Spark's own checkpoints are: a plain rename may replace an earlier file. File
        # systems without such a rename get the plain one, after a look.
        try:
            context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
        except Py4JJavaError as error:
            if not _is(error, "UnsupportedFileSystemException"):
                raise
            if not files.exists(target) and files.rename(hidden, target):
                return True
            files.delete(hidden, False)
            return False
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        no_options = self.spark.sparkContext._gateway.new_array(rename, 0)
        try:
            context.rename(files.makeQualified(hidden), files.makeQualified(target), no_options)
        except Py4JJavaError as error:
            files.delete(hidden, False)
            if not _is(error, "FileAlreadyExistsException"):
                raise
            return False
        return True


def _is(error: Py4JJavaError, name: str) -> bool:
    return error.java_exception.getClass().getSimpleName() == name
