"""Skip and retry policies, and what they leave of a processed table.

Decisions are set-based: the first row that a policy does not let pass ends the step there, and
everything after it is as if never read.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.sequence import chunk_of, numbered


def _name(error: str | type[BaseException]) -> str:
    return error if isinstance(error, str) else error.__name__


@dataclass
class Classifier:
    """Which errors may be skipped or retried; subclasses of a named class match too."""

    skippable: set[str] = field(default_factory=set)
    retryable: set[str] = field(default_factory=set)

    def skip(self, *errors: str | type[BaseException]) -> Classifier:
        self.skippable |= {_name(e) for e in errors}
        return self

    def retry(self, *errors: str | type[BaseException]) -> Classifier:
        self.retryable |= {_name(e) for e in errors}
        return self

    def is_skippable(self, error: BaseException) -> bool:
        return any(c.__name__ in self.skippable for c in type(error).__mro__)

    def is_retryable(self, error: BaseException) -> bool:
        return any(c.__name__ in self.retryable for c in type(error).__mro__)

    def matches(self, types: Column) -> Column:
        return F.arrays_overlap(types, F.array(*[F.lit(n) for n in sorted(self.skippable)])) if self.skippable else F.lit(False)


@dataclass(frozen=True)
class SkipPolicy:
    """Skips errors of ``classifier`` (None: all), at most ``limit`` of them (None: any number)."""

    classifier: Classifier | None = None
    limit: int | None = None

    def allows(self, types: Column) -> Column:
        return F.lit(True) if self.classifier is None else F.coalesce(self.classifier.matches(types), F.lit(False))

    def should_skip(self, error: BaseException, skipped: int) -> bool:
        return (self.classifier is None or self.classifier.is_skippable(error)) and (self.limit is None or skipped < self.limit)


ALWAYS, NEVER = SkipPolicy(), SkipPolicy(limit=0)


def classified(classifier: Classifier) -> SkipPolicy:
    return SkipPolicy(classifier)


def limited(limit: int, classifier: Classifier | None = None) -> SkipPolicy:
    return SkipPolicy(classifier, limit)


@dataclass(frozen=True)
class RetryPolicy:
    """So many calls at most before a failure stands; errors that ``classifier`` (None: all) does not name stand at once."""

    attempts: int = 1
    classifier: Classifier | None = None

    def __post_init__(self) -> None:
        if self.attempts < 1:
            raise ValueError("one call at least")

    def again(self, error: BaseException, made: int) -> bool:
        """Whether another call follows the ``made``-th, which failed."""
        return made < self.attempts and (self.classifier is None or self.classifier.is_retryable(error))

    def made(self, needed: Column) -> Column:
        """Calls made for an item that succeeds at call ``needed``."""
        return F.least(needed, F.lit(self.attempts))

    def succeeds(self, needed: Column) -> Column:
        return needed <= self.attempts


def abort_position(rows: DataFrame, policy: SkipPolicy, err: str = "_err", seq: str = "_seq") -> int | None:
    """The position of the row that ends the step, if one does: a small sorted read, no window."""
    bad = rows.where(F.col(err).isNotNull())
    stops = [bad.where(~policy.allows(F.col(err)["types"])).agg(F.min(seq)).first()[0]]
    if policy.limit is not None:
        over = bad.where(policy.allows(F.col(err)["types"])).select(seq).orderBy(seq).limit(policy.limit + 1).collect()
        if len(over) > policy.limit:
            stops.append(over[-1][0])
    return min((s for s in stops if s is not None), default=None)


@dataclass
class Outcome:
    """What a policy makes of processed rows."""

    survivors: DataFrame
    skipped: DataFrame
    aborted_at: int | None

    def committed(self, size: int, name: str = "_chunk") -> DataFrame:
        """Survivors with their chunk; after an abort only full chunks."""
        rows = numbered(self.survivors, ["_seq"], "__at").withColumn(name, chunk_of(F.col("__at"), size)).drop("__at")
        if self.aborted_at is None:
            return rows
        return rows.where(F.col(name) < self.survivors.count() // size)


def apply_policy(rows: DataFrame, policy: SkipPolicy) -> Outcome:
    """``rows`` have ``_seq`` and ``_err``; filtered rows are gone already."""
    stop = abort_position(rows, policy)
    kept = rows if stop is None else rows.where(F.col("_seq") < stop)
    return Outcome(kept.where("_err is null").drop("_err", "_item"), kept.where("_err is not null"), stop)
