"""File sinks.

Directory sinks write each group of chunks to a folder of its own, named by its first chunk, and
replace it when the group is committed again: a restart neither loses nor repeats output.
Single-file sinks stream rows through the driver, in order; they are for files that a person reads.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame, DataFrameWriter
from pyspark.sql import functions as F


class Sink:
    """Gets groups of whole chunks (``_seq`` and ``_chunk`` columns) in order; an error fails the step."""

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        raise NotImplementedError

    def open(self, restart: bool) -> None:
        """Before the first group; a restart goes on behind what an earlier run has committed."""

    def prepare(self, rows: DataFrame, step: str) -> Callable[[int], None] | None:
        """Writes many groups (``_group`` holds each row's first chunk) aside in one job and returns what commits one of them.

        None: the sink takes groups one by one.
        """
        return None

    def close(self) -> None:
        """After the last group, also after a failure."""


def bare(rows: DataFrame) -> DataFrame:
    return rows.drop("_seq", "_chunk")


def staged(rows: DataFrame, path: str, save: Callable[[DataFrameWriter, str], None]) -> Callable[[int], None]:
    """Saves ``rows`` aside, a folder for each group; a group is committed by renaming its folder, in place of an older one."""
    aside, session = f"{path}/_staged-{uuid.uuid4().hex}", rows.sparkSession
    save(rows.write.partitionBy("_group"), aside)
    to_path = session.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to_path(aside).getFileSystem(session.sparkContext._jsc.hadoopConfiguration())

    def commit(first_chunk: int | None) -> None:
        if first_chunk is None:  # all done
            files.delete(to_path(aside), True)
            return
        target = to_path(f"{path}/group={first_chunk:012d}")
        files.delete(target, True)
        if not files.rename(to_path(f"{aside}/_group={first_chunk}"), target):
            raise OSError(f"group {first_chunk} could not be committed")

    return commit


class ParquetSink(Sink):
    """Folders ``group=<first chunk>`` below ``path``."""

    def __init__(self, path: str):
        self.path = path

    def prepare(self, rows: DataFrame, step: str) -> Callable[[int], None]:
        return staged(rows, self.path, lambda w, p: w.parquet(p))

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        rows.write.mode("overwrite").parquet(f"{self.path}/group={first_chunk:012d}")


class TextSink(Sink):
    """Lines made by ``formatter``: Spark text folders, one for each group."""

    def __init__(self, path: str, formatter: Callable[[], Column]):
        self.path, self.formatter = path, formatter

    def prepare(self, rows: DataFrame, step: str) -> Callable[[int], None]:
        # one file for a group keeps its order
        return staged(rows.repartition("_group").sortWithinPartitions("_group", "_seq").select(self.formatter().alias("value"), "_group"), self.path, lambda w, p: w.text(p))

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        rows.orderBy("_seq").select(self.formatter().alias("value")).write.mode("overwrite").text(f"{self.path}/group={first_chunk:012d}")


class LineFileSink(Sink):
    """One text file; opened with the first row, truncated unless ``append``."""

    def __init__(self, path: str, formatter: Callable[[], Column], append: bool = False):
        self.path, self.formatter, self.mode = path, formatter, "a" if append else "w"
        self.file = None

    def open(self, restart: bool) -> None:
        if restart:
            self.mode = "a"

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        for row in rows.orderBy("_seq").select(self.formatter().alias("value")).toLocalIterator():
            if self.file is None:
                self.file = open(self.path, self.mode, encoding="utf-8")
            self.file.write(row[0] + "\n")
        if self.file is not None:
            self.file.flush()

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
        self.file = None
        self.mode = "a"


class JsonArraySink(Sink):
    """One JSON array in one file; ``[]`` without rows."""

    def __init__(self, path: str, indent: int | None = None):
        self.path, self.indent, self.any, self.file = path, indent, False, None

    def open(self, restart: bool) -> None:
        """On a restart the array is opened again where its end was."""
        if restart and self.file is None and os.path.exists(self.path):
            with open(self.path, encoding="utf-8") as f:
                text = f.read().rstrip().removesuffix("]").rstrip()
            self.file, self.any = open(self.path, "w", encoding="utf-8"), text not in ("", "[")
            self.file.write(text or "[")

    def _open(self) -> None:
        if self.file is None:
            self.file = open(self.path, "w", encoding="utf-8")
            self.file.write("[")

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        self._open()
        names = [c for c in rows.columns if c not in ("_seq", "_chunk")]
        for row in rows.orderBy("_seq").select(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}).alias("value")).toLocalIterator():
            text = row[0] if self.indent is None else json.dumps(json.loads(row[0]), indent=self.indent, ensure_ascii=False)
            self.file.write(("," if self.any else "") + ("\n" if self.indent is not None else "") + text)
            self.any = True
        self.file.flush()

    def close(self) -> None:
        self._open()
        self.file.write(("\n" if self.indent is not None and self.any else "") + "]")
        self.file.close()
        self.file, self.any = None, False


class XmlSink(Sink):
    """Elements appended under the root of one document, which is made where it is missing."""

    def __init__(self, path: str, root: str, element: str):
        self.path, self.root, self.element = path, root, element

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        tree = ElementTree.parse(self.path) if os.path.exists(self.path) else ElementTree.ElementTree(ElementTree.Element(self.root))
        for row in bare(rows.orderBy("_seq")).toLocalIterator():
            e = ElementTree.SubElement(tree.getroot(), self.element)
            for name, value in row.asDict().items():
                if value is not None:
                    ElementTree.SubElement(e, name).text = str(value)
        temporary = f"{self.path}.tmp"
        tree.write(temporary, encoding="utf-8", xml_declaration=True)
        os.replace(temporary, self.path)


class XmlFolderSink(Sink):
    """Spark's XML writer, for large output: a folder for each group."""

    def __init__(self, path: str, root: str, element: str):
        self.path, self.root, self.element = path, root, element

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        bare(rows).write.format("xml").option("rootTag", self.root).option("rowTag", self.element).mode("overwrite").save(f"{self.path}/group={first_chunk:012d}")
