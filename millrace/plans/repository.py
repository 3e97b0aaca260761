"""The job repository: small transactional state in SQLite on the driver, queryable as DataFrames."""

from __future__ import annotations

import sqlite3
import threading
import uuid
from collections.abc import Iterable
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.scalars import format_duration, format_parameters, format_time
from millrace.model import TABLES, Context, JobExecution, JobInstance, Parameters, Status, StepExecution, now

LOCK_TTL = timedelta(minutes=30)

#: The schema's versions in order; a database is brought from its own (``pragma user_version``) to the last. Never change one that was released.
MIGRATIONS = ("""
create table if not exists job_instances (id integer primary key, job_name text not null check (length(job_name) <= 100), parameters_json text not null, unique (job_name, parameters_json));
create table if not exists job_executions (id integer primary key, job_instance_id integer not null references job_instances on delete cascade, parameters_json text not null, status text not null, start_time text not null, end_time text, failure_message text, last_heartbeat_at text);
create index if not exists job_executions_instance on job_executions (job_instance_id);
create table if not exists step_executions (id integer primary key, step_name text not null check (length(step_name) <= 100), job_execution_id integer not null references job_executions on delete cascade, status text not null, start_time text not null, end_time text, read_count integer not null default 0, write_count integer not null default 0, skip_count integer not null default 0, rollback_count integer not null default 0, failure_message text, execution_context_json text);
create index if not exists step_executions_job on step_executions (job_execution_id);
create table if not exists job_locks (id integer primary key, job_name text not null, parameters_json text not null, lock_token text not null, acquired_at text not null, expires_at text not null, unique (job_name, parameters_json));
create table if not exists dead_letters (id integer primary key, job_name text not null, step_name text not null, item_json text not null, item_type_name text not null, exception_type text not null, exception_message text not null, stack_trace text, skip_count_at_time integer not null, occurred_at text not null);
create index if not exists dead_letters_step on dead_letters (job_name, step_name);
""", """
create index if not exists job_executions_status on job_executions (job_instance_id, status);
create index if not exists step_executions_name on step_executions (job_execution_id, step_name);
""")


def _out(at: datetime | None) -> str | None:
    return None if at is None else at.astimezone(UTC).isoformat(timespec="microseconds")


def _in(text: str | None) -> datetime | None:
    return None if text is None else datetime.fromisoformat(text)


class Repository:
    """Thread-safe; ``:memory:`` lives as long as the object."""

    def __init__(self, path: str = ":memory:"):
        self._db = sqlite3.connect(path, check_same_thread=False, isolation_level=None)
        self._db.row_factory = sqlite3.Row
        self._lock = threading.RLock()
        with self._lock:
            self._db.execute("pragma foreign_keys = on")
            version = self._db.execute("pragma user_version").fetchone()[0]
            if version > len(MIGRATIONS):
                raise ValueError(f"the repository has schema version {version}, this program knows {len(MIGRATIONS)}")
            for i in range(version, len(MIGRATIONS)):
                self._db.executescript(f"begin immediate; {MIGRATIONS[i]} pragma user_version = {i + 1}; commit;")

    def close(self) -> None:
        self._db.close()

    def _run(self, sql: str, *values: object) -> sqlite3.Cursor:
        with self._lock:
            return self._db.execute(sql, values)

    # executions

    def instance(self, name: str, parameters: Parameters) -> JobInstance:
        """The one instance of a job and its parameters."""
        self._run("insert or ignore into job_instances (job_name, parameters_json) values (?, ?)", name, parameters.canonical())
        row = self._run("select id from job_instances where job_name = ? and parameters_json = ?", name, parameters.canonical()).fetchone()
        return JobInstance(row["id"], name, parameters)

    def create_job_execution(self, instance: JobInstance, parameters: Parameters) -> JobExecution:
        at = now()
        made = self._run("insert into job_executions (job_instance_id, parameters_json, status, start_time) values (?, ?, ?, ?)", instance.id, parameters.canonical(), Status.STARTING, _out(at))
        return JobExecution(made.lastrowid, instance, parameters, start_time=at)

    def create_step_execution(self, job: JobExecution, step: str) -> StepExecution:
        at = now()
        made = self._run("insert into step_executions (step_name, job_execution_id, status, start_time) values (?, ?, ?, ?)", step, job.id, Status.STARTING, _out(at))
        out = StepExecution(made.lastrowid, step, job, start_time=at)
        job.steps.append(out)
        return out

    def update_job(self, e: JobExecution) -> None:
        n = self._run("update job_executions set status = ?, end_time = ?, failure_message = ?, last_heartbeat_at = ? where id = ?", e.status, _out(e.end_time), e.failure_message, _out(e.last_heartbeat), e.id).rowcount
        if not n:
            raise LookupError(f"job execution {e.id} does not exist")

    def heartbeat(self, execution_id: int) -> None:
        self._run("update job_executions set last_heartbeat_at = ? where id = ?", _out(now()), execution_id)

    def update_step(self, e: StepExecution) -> None:
        n = self._run("update step_executions set status = ?, end_time = ?, read_count = ?, write_count = ?, skip_count = ?, rollback_count = ?, failure_message = ?, execution_context_json = ? where id = ?", e.status, _out(e.end_time), e.read_count, e.write_count, e.skip_count, e.rollback_count, e.failure_message, e.context.dump(), e.id).rowcount
        if not n:
            raise LookupError(f"step execution {e.id} does not exist")

    def _job(self, row: sqlite3.Row | None) -> JobExecution | None:
        if row is None:
            return None
        parameters = Parameters.parse(row["parameters_json"])
        instance = JobInstance(row["job_instance_id"], row["job_name"], parameters)
        return JobExecution(row["id"], instance, parameters, Status(row["status"]), _in(row["start_time"]), _in(row["end_time"]), row["failure_message"], _in(row["last_heartbeat_at"]))

    _JOBS = "select e.*, i.job_name from job_executions e join job_instances i on i.id = e.job_instance_id "

    def job_execution(self, execution_id: int) -> JobExecution | None:
        return self._job(self._run(self._JOBS + "where e.id = ?", execution_id).fetchone())

    def last_job_execution(self, name: str, parameters: Parameters) -> JobExecution | None:
        return self._job(self._run(self._JOBS + "where i.job_name = ? and i.parameters_json = ? order by e.id desc limit 1", name, parameters.canonical()).fetchone())

    def running_job_execution(self, name: str, parameters: Parameters) -> JobExecution | None:
        """The latest that is Started; a Restarted one that has begun is Started as well."""
        return self._job(self._run(self._JOBS + "where i.job_name = ? and i.parameters_json = ? and e.status = 'Started' order by e.id desc limit 1", name, parameters.canonical()).fetchone())

    def job_executions(self, instance: JobInstance) -> list[JobExecution]:
        return [self._job(r) for r in self._run(self._JOBS + "where i.id = ? order by e.id", instance.id)]

    def last_step_execution(self, job_execution_id: int, step: str) -> StepExecution | None:
        row = self._run("select * from step_executions where job_execution_id = ? and step_name = ? order by id desc limit 1", job_execution_id, step).fetchone()
        if row is None:
            return None
        return StepExecution(row["id"], row["step_name"], self.job_execution(job_execution_id), Status(row["status"]), _in(row["start_time"]), _in(row["end_time"]), row["read_count"], row["write_count"], row["skip_count"], row["rollback_count"], row["failure_message"], Context.load(row["execution_context_json"]))

    def abandon(self, execution_id: int) -> bool:
        """Failed to Abandoned; False where the execution is not (or no longer) Failed."""
        return self._run("update job_executions set status = 'Abandoned' where id = ? and status = 'Failed'", execution_id).rowcount == 1

    def recover(self, name: str, parameters: Parameters, silent: timedelta) -> int:
        """Fails executions that a crash left running: no heartbeat (or start) for so long."""
        limit = _out(now() - silent)
        return self._run("update job_executions set status = 'Failed', end_time = ?, failure_message = 'no heartbeat' where status in ('Starting', 'Started', 'Restarted') and coalesce(last_heartbeat_at, start_time) < ? and job_instance_id in (select id from job_instances where job_name = ? and parameters_json = ?)", _out(now()), limit, name, parameters.canonical()).rowcount

    # locks

    def acquire_lock(self, name: str, parameters: Parameters, ttl: timedelta = LOCK_TTL, at: datetime | None = None) -> Lock | None:
        """The lock, or None while another holds it. An expired lock is taken over."""
        at, key = at or now(), parameters.canonical()
        with self._lock:
            self._db.execute("begin immediate")
            try:
                self._db.execute("delete from job_locks where job_name = ? and parameters_json = ? and expires_at <= ?", (name, key, _out(at)))
                token = uuid.uuid4().hex
                made = self._db.execute("insert or ignore into job_locks (job_name, parameters_json, lock_token, acquired_at, expires_at) values (?, ?, ?, ?, ?)", (name, key, token, _out(at), _out(at + ttl)))
                self._db.execute("commit")
            except BaseException:
                self._db.execute("rollback")
                raise
        return Lock(self, token, ttl) if made.rowcount == 1 else None

    def dead_letter_rows(self) -> list[dict]:
        return [dict(r) for r in self._run("select * from dead_letters order by id")]

    def add_dead_letters(self, entries: Iterable[dict]) -> None:
        names = TABLES["dead_letters"].fieldNames()[1:]
        with self._lock:
            self._db.execute("begin")
            self._db.executemany(f"insert into dead_letters ({', '.join(names)}) values ({', '.join('?' for _ in names)})", [[_out(e[n]) if isinstance(e[n], datetime) else e[n] for n in names] for e in entries])
            self._db.execute("commit")

    # DataFrames

    def frame(self, spark: SparkSession, table: str) -> DataFrame:
        schema = TABLES[table]
        times = {f.name for f in schema.fields if f.dataType.typeName() == "timestamp"}
        rows = [tuple(_in(r[n]) if n in times else r[n] for n in schema.fieldNames()) for r in self._run(f"select {', '.join(schema.fieldNames())} from {table} order by id")]
        return spark.createDataFrame(rows, schema)


class Lock:
    """Held until released; renewed by the launcher's heartbeat."""

    def __init__(self, repository: Repository, token: str, ttl: timedelta):
        self.repository, self.token, self.ttl = repository, token, ttl

    def renew(self) -> bool:
        return self.repository._run("update job_locks set expires_at = ? where lock_token = ?", _out(now() + self.ttl), self.token).rowcount == 1

    def release(self) -> None:
        self.repository._run("delete from job_locks where lock_token = ?", self.token)

    def __enter__(self) -> Lock:
        return self

    def __exit__(self, *_: object) -> None:
        self.release()


class NoLock:
    """For jobs that may run at the same time."""

    def acquire_lock(self, name: str, parameters: Parameters) -> NoLock:
        return self

    def renew(self) -> bool:
        return True

    def release(self) -> None:
        pass


# the same lookups over DataFrames of these tables, at any size


def latest_by(executions: DataFrame, instance: str, order: str) -> DataFrame:
    """The last execution of each instance, without a sort: a partial maximum."""
    return executions.groupBy(instance).agg(F.max_by(F.struct(*executions.columns), order).alias("__e")).select("__e.*")


def jobs_view(instances: DataFrame, executions: DataFrame) -> DataFrame:
    """Every instance with its latest execution, ``-`` where there is none."""
    last = executions.groupBy(F.col("job_instance_id").alias("id")).agg(F.max_by(F.struct("status", "start_time", "end_time"), "id").alias("e"))
    dash = lambda c: F.coalesce(c, F.lit("-"))
    return instances.join(last, "id", "left").select("id", "job_name", "parameters_json", dash(F.col("e.status")).alias("last_status"), format_time(F.col("e.start_time")).alias("started"), format_time(F.col("e.end_time")).alias("ended"))


def executions_view(instances: DataFrame, executions: DataFrame, job: str) -> DataFrame:
    mine = instances.where(F.col("job_name") == job).select(F.col("id").alias("job_instance_id"))
    return executions.join(mine, "job_instance_id").select("id", "status", format_time(F.col("start_time")).alias("started"), format_time(F.col("end_time")).alias("ended"), format_duration(F.col("start_time"), F.col("end_time")).alias("duration"), "failure_message")


def steps_view(steps: DataFrame, execution_id: int) -> DataFrame:
    return steps.where(F.col("job_execution_id") == execution_id).select("id", "step_name", "status", "read_count", "write_count", "skip_count", "rollback_count", format_duration(F.col("start_time"), F.col("end_time")).alias("duration"))


def abandoned(executions: DataFrame, execution_id: Column) -> DataFrame:
    """The table after the conditional update of one execution."""
    hit = (F.col("id") == execution_id) & (F.col("status") == "Failed")
    return executions.withColumn("status", F.when(hit, "Abandoned").otherwise(F.col("status")))


def stale(beats: DataFrame, key: str, at: str, silent: timedelta) -> DataFrame:
    """Keys whose last beat is more than ``silent`` before the last of all."""
    last = beats.groupBy(key).agg(F.max(at).alias("last_beat"))
    newest = F.max("last_beat").over(Window.partitionBy())
    return last.withColumn("__newest", newest).where(F.col("last_beat") < F.col("__newest") - F.lit(silent)).drop("__newest")


def canonical(parameters: Column) -> Column:
    return format_parameters(parameters)
