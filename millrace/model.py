"""What the job repository holds: statuses, parameters, checkpoints, executions, dead letters."""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import UTC, datetime
from enum import StrEnum

from pyspark.sql import types as T


class Status(StrEnum):
    """States of executions; the repository stores the names."""

    STARTING = "Starting"
    STARTED = "Started"
    STOPPING = "Stopping"
    STOPPED = "Stopped"
    COMPLETED = "Completed"
    ABANDONED = "Abandoned"
    FAILED = "Failed"
    RESTARTED = "Restarted"


def now() -> datetime:
    return datetime.now(UTC)


class Parameters(dict[str, str]):
    """Job parameters; equal whatever their order."""

    def canonical(self) -> str:
        """JSON with sorted keys: the key by which runs of a job are told apart."""
        return json.dumps(dict(sorted(self.items())), separators=(",", ":"), ensure_ascii=False)

    def __hash__(self) -> int:  # type: ignore[override]
        return hash(self.canonical())

    @classmethod
    def parse(cls, text: str | None) -> Parameters:
        return cls(json.loads(text) if text else {})


class Context:
    """A checkpoint: values kept as JSON under string keys; a missing key reads as the default."""

    def __init__(self, values: Mapping[str, str] | None = None):
        self._values = dict(values or {})

    def put(self, key: str, value: object) -> None:
        self._values[key] = json.dumps(value)

    def get(self, key: str, default: object = None) -> object:
        return json.loads(self._values[key]) if key in self._values else default

    def __contains__(self, key: str) -> bool:
        return key in self._values

    def to_dict(self) -> dict[str, str]:
        return dict(self._values)

    def copy(self) -> Context:
        return Context(self._values)

    def dump(self) -> str:
        return json.dumps(self._values)

    @classmethod
    def load(cls, text: str | None) -> Context:
        return cls(json.loads(text) if text else {})


@dataclass
class JobInstance:
    id: int
    job_name: str
    parameters: Parameters


@dataclass
class JobExecution:
    id: int
    instance: JobInstance
    parameters: Parameters
    status: Status = Status.STARTING
    start_time: datetime = field(default_factory=now)
    end_time: datetime | None = None
    failure_message: str | None = None
    last_heartbeat: datetime | None = None
    # of this process only
    failure: BaseException | None = None
    restarted_from: int | None = None
    context: Context = field(default_factory=Context)
    steps: list[StepExecution] = field(default_factory=list)


@dataclass
class StepExecution:
    id: int
    step_name: str
    job_execution: JobExecution
    status: Status = Status.STARTING
    start_time: datetime = field(default_factory=now)
    end_time: datetime | None = None
    read_count: int = 0
    write_count: int = 0
    skip_count: int = 0
    rollback_count: int = 0
    failure_message: str | None = None
    context: Context = field(default_factory=Context)
    failure: BaseException | None = None
    is_restart: bool = False

    def copy_counts(self, other: StepExecution) -> None:
        self.read_count, self.write_count, self.skip_count, self.rollback_count = other.read_count, other.write_count, other.skip_count, other.rollback_count


def _table(spec: str) -> T.StructType:
    kinds = {"l": T.LongType(), "s": T.StringType(), "t": T.TimestampType()}
    return T.StructType([T.StructField(name.rstrip("?"), kinds[kind], name.endswith("?")) for name, kind in (c.split(":") for c in spec.split())])


TABLES: dict[str, T.StructType] = {
    "job_instances": _table("id:l job_name:s parameters_json:s"),
    "job_executions": _table("id:l job_instance_id:l parameters_json:s status:s start_time:t end_time?:t failure_message?:s last_heartbeat_at?:t"),
    "step_executions": _table("id:l step_name:s job_execution_id:l status:s start_time:t end_time?:t read_count:l write_count:l skip_count:l rollback_count:l failure_message?:s execution_context_json?:s"),
    "job_locks": _table("id:l job_name:s parameters_json:s lock_token:s acquired_at:t expires_at:t"),
    "dead_letters": _table("id:l job_name:s step_name:s item_json:s item_type_name:s exception_type:s exception_message:s stack_trace?:s skip_count_at_time:l occurred_at:t"),
}
