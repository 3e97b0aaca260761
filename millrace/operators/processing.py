"""Processors: row-level dataflow from DataFrame to DataFrame.

A processor maps and filters with column expressions where it can; Python functions run in
batches on executors. A row that fails keeps its columns and gets ``_err``; a row that a
function maps to None is gone.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable, Iterable, Sequence
from decimal import Decimal

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.policies import RetryPolicy

#: types: the error's class and its bases by name, so that a policy can match subclasses.
ERROR = T.StructType([T.StructField("types", T.ArrayType(T.StringType())), T.StructField("message", T.StringType()), T.StructField("stack", T.StringType()), T.StructField("attempts", T.IntegerType())])


class Processor:
    """Maps a DataFrame to a DataFrame; ``_seq`` and ``_err`` pass through."""

    def apply(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError

    def with_retry(self, policy: RetryPolicy) -> Processor:
        """The same with a step's retry policy; column expressions have nothing to repeat."""
        return self


class Identity(Processor):
    def apply(self, df: DataFrame) -> DataFrame:
        return df


class Transform(Processor):
    """Any DataFrame function."""

    def __init__(self, function: Callable[[DataFrame], DataFrame]):
        self.function = function

    def apply(self, df: DataFrame) -> DataFrame:
        return self.function(df)


class Project(Processor):
    """Column expressions by name; ``keep`` is a condition that rows must meet (null: they do not)."""

    def __init__(self, keep: Column | None = None, **columns: Column):
        self.keep, self.columns = keep, columns

    def apply(self, df: DataFrame) -> DataFrame:
        out = df if self.keep is None else df.where(self.keep)
        if not self.columns:
            return out
        carried = [c for c in ("_seq", "_err") if c in df.columns and c not in self.columns]
        return out.select(*carried, *[c.alias(n) for n, c in self.columns.items()])


class Checked(Processor):
    """Adds ``_err`` where ``failed`` holds: the way an expression reports a bad row."""

    def __init__(self, failed: Column, error: str = "ValueError", message: Column | None = None, bases: Sequence[str] = ("Exception",)):
        self.failed, self.types, self.message = failed, [error, *bases], message

    def apply(self, df: DataFrame) -> DataFrame:
        message = F.lit("") if self.message is None else self.message
        err = F.struct(F.array(*[F.lit(t) for t in self.types]).alias("types"), message.cast("string").alias("message"), F.lit(None).cast("string").alias("stack"), F.lit(1).alias("attempts"))
        now = F.when(F.coalesce(self.failed, F.lit(False)), err)
        return df.withColumn("_err", F.coalesce(F.col("_err"), now) if "_err" in df.columns else now)


class Composite(Processor):
    """Processors of one item type in turn; a dropped row stays dropped."""

    def __init__(self, parts: Iterable[Processor]):
        self.parts = list(parts)
        if not self.parts:
            raise ValueError("a composite needs a processor")

    def apply(self, df: DataFrame) -> DataFrame:
        for p in self.parts:
            df = p.apply(df)
        return df

    def with_retry(self, policy: RetryPolicy) -> Composite:
        return Composite([p.with_retry(policy) for p in self.parts])


class Chain(Composite):
    """Two processors of different item types."""

    def __init__(self, first: Processor, second: Processor):
        super().__init__([first, second])


class PythonMap(Processor):
    """A Python function from a dict of a row's columns to a dict of ``schema``'s columns, or None.

    ``attempts`` calls, or those of a retry policy, are made before a failure stands. Failed rows keep ``_seq``, their
    input as JSON in ``_item`` and the last attempt's error in ``_err``.
    """

    def __init__(self, function: Callable[[dict], dict | None], schema: str | T.StructType, attempts: int | RetryPolicy = 1):
        self.function, self.schema, self.retry = function, schema, attempts if isinstance(attempts, RetryPolicy) else RetryPolicy(attempts)

    def with_retry(self, policy: RetryPolicy) -> PythonMap:
        return PythonMap(self.function, self.schema, policy)

    def apply(self, df: DataFrame) -> DataFrame:
        kind = self.schema if isinstance(self.schema, T.StructType) else T._parse_datatype_string(self.schema)
        has_seq, function, retry = "_seq" in df.columns, self.function, self.retry
        had_err = "_err" in df.columns
        own = [c for c in df.columns if c not in ("_seq", "_err", "_item")]
        out = T.StructType(([T.StructField("_seq", T.LongType())] if has_seq else []) + list(kind.fields) + [T.StructField("_item", T.StringType()), T.StructField("_err", ERROR)])
        names = kind.fieldNames()

        arrow = to_arrow_schema(out)

        def run(batches):
            for batch in batches:
                rows = []
                for item in batch.to_pylist():
                    seq, before = item.pop("_seq", None), item.pop("_err", None) if had_err else None
                    result, err = None, before
                    for n in range(1, retry.attempts + 1) if err is None else ():
                        try:
                            result, err = function(dict(item)), None
                            break
                        except Exception as e:  # the policy decides
                            err = {"types": [c.__name__ for c in type(e).__mro__[:-1]], "message": str(e), "stack": traceback.format_exc(), "attempts": n}
                            if not retry.again(e, n):
                                break
                    if result is None and err is None:
                        continue
                    row = {"_seq": seq, **{c: (result or {}).get(c) for c in names}, "_item": as_json(item) if err is not None else None, "_err": err}
                    rows.append({f: row[f] for f in arrow.names})
                yield pa.RecordBatch.from_pylist(rows, schema=arrow)

        carried = [c for c in ("_seq", "_err") if c in df.columns]
        return df.select(*carried, *own).mapInArrow(run, out)


def as_json(item: dict) -> str:
    """A row as JSON, for dead letters; numbers stay numbers."""
    plain = lambda v: float(v) if isinstance(v, Decimal) else v.hex() if isinstance(v, bytes) else str(v)
    return json.dumps(item, default=plain, ensure_ascii=False, separators=(",", ":"))


class ArrowMap(Processor):
    """A function from an Arrow record batch of the input's columns to one of ``schema``'s: vectorised, and all or nothing (an error fails the step).

    The function keeps ``_seq`` and drops rows as it likes.
    """

    def __init__(self, function: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str | T.StructType):
        self.function, self.schema = function, schema

    def apply(self, df: DataFrame) -> DataFrame:
        function, kind = self.function, self.schema if isinstance(self.schema, T.StructType) else T._parse_datatype_string(self.schema)
        arrow = to_arrow_schema(kind)
        return df.mapInArrow(lambda batches: (function(b).cast(arrow) for b in batches), kind)
