"""Relational, composite, memory and dead-letter sinks."""

from __future__ import annotations

import json
import sqlite3
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame

from millrace.sinks.files import Sink, bare


class MemorySink(Sink):
    """Keeps chunks on the driver; for tests and small results."""

    def __init__(self) -> None:
        self.chunks: list[list[tuple]] = []

    @property
    def rows(self) -> list[tuple]:
        return [r for c in self.chunks for r in c]

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        at = None
        for row in rows.orderBy("_seq").toLocalIterator():
            d = row.asDict()
            chunk = d.pop("_chunk")
            d.pop("_seq")
            if chunk != at:
                self.chunks.append([])
                at = chunk
            self.chunks[-1].append(tuple(d.values()))


class SqliteSink(Sink):
    """Inserts a group in one transaction: all of it or nothing. Values as sqlite knows them."""

    def __init__(self, path: str, table: str):
        self.path, self.table = path, table

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        out = bare(rows.orderBy("_seq"))
        marks = ",".join("?" for _ in out.columns)
        with sqlite3.connect(self.path) as db:
            values = ([v if v is None or isinstance(v, int | float | str | bytes) else str(v) for v in r] for r in out.toLocalIterator())
            db.executemany(f"insert into {self.table} ({', '.join(out.columns)}) values ({marks})", values)
        db.close()


class JdbcSink(Sink):
    """JDBC append; a task's rows are one transaction. Needs the driver's jar."""

    def __init__(self, url: str, table: str, options: dict[str, str] | None = None, batch: int = 10_000):
        self.url, self.table, self.options = url, table, {"batchsize": str(batch), **(options or {})}

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        bare(rows).write.jdbc(self.url, self.table, mode="append", properties=self.options)


class CompositeSink(Sink):
    """The same rows to several sinks in turn; the first failure stops the rest."""

    def __init__(self, sinks: Iterable[Sink]):
        self.sinks = list(sinks)
        if not self.sinks:
            raise ValueError("a composite needs a sink")

    def open(self, restart: bool) -> None:
        for s in self.sinks:
            s.open(restart)

    def prepare(self, rows: DataFrame, step: str) -> Callable[[int | None], None] | None:
        if any(type(s).prepare is Sink.prepare for s in self.sinks):
            return None
        commits = [s.prepare(rows, step) for s in self.sinks]

        def commit(first_chunk: int | None) -> None:
            for c in commits:
                c(first_chunk)

        return commit

    def write(self, rows: DataFrame, step: str, first_chunk: int) -> None:
        for s in self.sinks:
            s.write(rows, step, first_chunk)

    def close(self) -> None:
        for s in self.sinks:
            s.close()


class MemoryDeadLetters:
    """Dead letters on the driver."""

    def __init__(self) -> None:
        self.entries: list[dict] = []

    def write(self, letters: DataFrame) -> None:
        self.entries += [r.asDict() for r in letters.orderBy("_seq").toLocalIterator()]


class JsonLinesDeadLetters:
    """One JSON object a line, appended to a file."""

    def __init__(self, path: str):
        self.path = path

    def write(self, letters: DataFrame) -> None:
        with open(self.path, "a", encoding="utf-8") as out:
            for r in letters.orderBy("_seq").drop("_seq").toLocalIterator():
                out.write(json.dumps({"".join(w.title() for w in k.split("_")): v for k, v in r.asDict().items()}, default=str, ensure_ascii=False) + "\n")


class JsonFolderDeadLetters:
    """JSON lines written by executors, appended to a folder."""

    def __init__(self, path: str):
        self.path = path

    def write(self, letters: DataFrame) -> None:
        letters.drop("_seq").write.mode("append").json(self.path)


class RepositoryDeadLetters:
    """Rows of the job repository's table."""

    def __init__(self, repository) -> None:
        self.repository = repository

    def write(self, letters: DataFrame) -> None:
        self.repository.add_dead_letters(r.asDict() for r in letters.orderBy("_seq").toLocalIterator())
