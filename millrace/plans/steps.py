"""Steps: chunk-oriented, tasklet and partitioned.

A chunk step is one declarative plan (source, processors, policies, chunk numbers). In commit mode
the driver walks over groups of chunks: each group is written to the sinks and then checkpointed, so
a failure costs one group, and a restart begins behind the last committed row. Sinks that can stage (folders) get
BATCH groups in one Spark job, and each is then committed by a rename. The processed rows
are computed once and kept on disk while the groups are written.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager, nullcontext
from datetime import timedelta
from enum import Enum

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from millrace.model import Context, JobExecution, Status, StepExecution, now
from millrace.operators.deadletter import dead_letters
from millrace.operators.policies import NEVER, Outcome, RetryPolicy, SkipPolicy, apply_policy
from millrace.operators.processing import Composite, Identity, Processor
from millrace.operators.ranges import RangePartitioner
from millrace.plans.repository import Repository
from millrace.plans.telemetry import TELEMETRY
from millrace.sinks.files import Sink
from millrace.sinks.others import CompositeSink


class StepAborted(RuntimeError):
    """A row failed that no policy lets pass."""


class ChunkListener:
    """Called on the driver around each group of chunks; override what is wanted."""

    def before_chunk(self, step: StepExecution, chunk: int) -> None: ...

    def before_write(self, step: StepExecution, chunk: int, rows: int) -> None: ...

    def after_write(self, step: StepExecution, chunk: int, rows: int) -> None: ...

    def after_chunk(self, step: StepExecution, chunk: int) -> None: ...

    def on_error(self, step: StepExecution, chunk: int, error: BaseException) -> None: ...

    def on_skip(self, step: StepExecution, skipped: DataFrame, before: int) -> None: ...


class StepListener:
    """Called on the driver around a chunk step; override what is wanted."""

    def before_step(self, step: StepExecution) -> None: ...

    def after_step(self, step: StepExecution) -> None: ...


#: Groups of chunks that are staged in one job.
BATCH = 256


class DeadLetterListener(ChunkListener):
    """Writes skipped rows to a dead-letter sink."""

    def __init__(self, sink, item_type: str = "Row"):
        self.sink, self.item_type = sink, item_type

    def on_skip(self, step: StepExecution, skipped: DataFrame, before: int) -> None:
        items = [c for c in skipped.columns if c not in ("_seq", "_err", "_item")]
        self.sink.write(dead_letters(skipped, step.job_execution.instance.job_name, step.step_name, items, self.item_type, before))


class Stop:
    """Asks running steps to end after the group at hand; one that takes longer than ``drain`` is cancelled and fails."""

    def __init__(self, drain: timedelta = timedelta(seconds=30)):
        self.drain, self._event = drain, threading.Event()

    def request(self) -> None:
        self._event.set()

    @property
    def requested(self) -> bool:
        return self._event.is_set()

    @contextmanager
    def watching(self, spark: SparkSession):
        """Cancels this thread's Spark jobs ``drain`` after a request, unless the block has ended."""
        group, done = f"millrace-{uuid.uuid4().hex}", threading.Event()
        spark.sparkContext.setJobGroup(group, "chunk step", True)

        def watch() -> None:
            while not done.is_set():
                if self._event.wait(0.05):
                    if not done.wait(self.drain.total_seconds()):
                        spark.sparkContext.cancelJobGroup(group)
                    return

        thread = threading.Thread(target=watch, daemon=True)
        thread.start()
        try:
            yield
        finally:
            done.set()
            thread.join()
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


class Step:
    name: str

    def execute(self, job: JobExecution) -> StepExecution:
        raise NotImplementedError


class ChunkStep(Step):
    def __init__(self, repository: Repository, name: str, source, processor: Processor, sink: Sink, chunk_size: int, group: int, skip: SkipPolicy, listeners: Sequence[ChunkListener | StepListener], stop: Stop | None, parallelism: int):
        self.repository, self.name, self.source, self.processor, self.sink = repository, name, source, processor, sink
        self.chunk_size, self.group, self.skip, self.listeners, self.stop, self.parallelism = chunk_size, group, skip, list(listeners), stop, parallelism

    def plan(self, context: Context) -> DataFrame:
        """Source and processors as one DataFrame with ``_seq`` and ``_err``."""
        rows = self.source.open(context)
        if self.parallelism > 1:
            rows = rows.repartition(self.parallelism)
        rows = self.processor.apply(rows)
        return rows if "_err" in rows.columns else rows.withColumn("_err", F.lit(None).cast("struct<types:array<string>,message:string,stack:string,attempts:int>"))

    def execute(self, job: JobExecution) -> StepExecution:
        step = self.repository.create_step_execution(job, self.name)
        if job.restarted_from is not None:
            last = self.repository.last_step_execution(job.restarted_from, self.name)
            if last is not None:
                step.context, step.is_restart = last.context.copy(), True
        for key, value in job.context.to_dict().items():
            if key not in step.context:
                step.context._values[key] = value
        step.status = Status.STARTED
        self.repository.update_step(step)
        around = [x for x in self.listeners if isinstance(x, StepListener)]
        try:
            for x in around:
                x.before_step(step)
            with TELEMETRY.span("step", step=self.name):
                stopped = self._run(step)
            step.status = Status.STOPPED if stopped else Status.COMPLETED
        except Exception as e:  # kept, the job decides
            step.status, step.failure, step.failure_message = Status.FAILED, e, str(e)[:4000]
        step.end_time = now()
        for x in around:
            x.after_step(step)
        self.repository.update_step(step)
        return step

    def _run(self, step: StepExecution) -> bool:
        source_rows = self.source.open(step.context)
        with self.stop.watching(source_rows.sparkSession) if self.stop is not None else nullcontext():
            return self._work(step, source_rows)

    def _work(self, step: StepExecution, source_rows: DataFrame) -> bool:
        rows = self.plan(step.context).persist(StorageLevel.DISK_ONLY)
        try:
            self.sink.open(step.is_restart)
            outcome = apply_policy(rows, self.skip)
            return self._commit(step, outcome, source_rows)
        finally:
            rows.unpersist()
            self.sink.close()

    def _commit(self, step: StepExecution, outcome: Outcome, source_rows: DataFrame) -> bool:
        chunks = outcome.committed(self.chunk_size).persist(StorageLevel.DISK_ONLY)
        commit = None
        try:
            sizes = chunks.withColumn("__g", F.expr(f"_chunk div {self.group}")).groupBy("__g").agg(F.max("_seq").alias("last"), F.count("*").alias("n")).orderBy("__g").collect()  # a row for each commit
            skips = outcome.skipped.count()
            skipped_to, staged_to, listeners = 0, -1, [x for x in self.listeners if isinstance(x, ChunkListener)]
            for i, g in enumerate(sizes):
                if self.stop is not None and self.stop.requested:
                    self._count_read(step, source_rows, sizes[i - 1]["last"] if i else None)
                    return True
                first = g["__g"] * self.group
                for x in listeners:
                    x.before_chunk(step, first)
                last_group = i == len(sizes) - 1 and outcome.aborted_at is None
                high = g["last"]
                if skips:
                    upto = outcome.skipped.where(F.col("_seq") > skipped_to) if last_group else outcome.skipped.where(F.col("_seq").between(skipped_to + 1, high))
                    self._report_skips(step, upto)
                    skipped_to = high
                try:
                    for x in listeners:
                        x.before_write(step, first, g["n"])
                    with TELEMETRY.span("chunk", step=self.name, chunk=first):
                        if i > staged_to and len(sizes) > 1:
                            if commit is not None:
                                commit(None)
                            staged_to = min(i + BATCH, len(sizes)) - 1
                            some = chunks.where(F.col("_chunk").between(first, (sizes[staged_to]["__g"] + 1) * self.group - 1))
                            commit = self.sink.prepare(some.withColumn("_group", F.expr(f"_chunk div {self.group} * {self.group}")), self.name)
                        if commit is not None:
                            commit(first)
                        else:
                            self.sink.write(chunks.where(F.col("_chunk").between(first, first + self.group - 1)), self.name, first)
                    for x in listeners:
                        x.after_write(step, first, g["n"])
                except Exception as e:
                    step.rollback_count += 1
                    for x in listeners:
                        x.on_error(step, first, e)
                    raise
                step.write_count += g["n"]
                self.source.save(step.context, high)
                self.repository.update_step(step)
                TELEMETRY.add("items.written", g["n"])
                TELEMETRY.add("chunks.committed", -(-g["n"] // self.chunk_size))
                TELEMETRY.record("chunk.size", g["n"])
                for x in listeners:
                    x.after_chunk(step, first)
            if skips and not sizes:
                self._report_skips(step, outcome.skipped)
            elif skips and outcome.aborted_at is not None:
                self._report_skips(step, outcome.skipped.where(F.col("_seq") > skipped_to))
            self._count_read(step, source_rows, outcome.aborted_at)
            if outcome.aborted_at is None:
                end = source_rows.agg(F.max("_seq")).first()[0]
                if end is not None:
                    self.source.save(step.context, end)  # filtered and skipped rows behind the last chunk count as done
            else:
                raise StepAborted(f"row {outcome.aborted_at} failed")
            return False
        finally:
            if commit is not None:
                commit(None)
            chunks.unpersist()

    def _report_skips(self, step: StepExecution, skipped: DataFrame) -> None:
        n = skipped.count()
        if n:
            for x in [x for x in self.listeners if isinstance(x, ChunkListener)]:
                x.on_skip(step, skipped, step.skip_count)
            step.skip_count += n
            TELEMETRY.add("items.skipped", n)

    def _count_read(self, step: StepExecution, rows: DataFrame, upto: int | None) -> None:
        n = (rows if upto is None else rows.where(F.col("_seq") <= upto)).count()
        step.read_count += n
        TELEMETRY.add("items.read", n)


class StepBuilder:
    """Puts a chunk step together; source, sink and a name are needed."""

    def __init__(self, repository: Repository | None = None):
        self._repository, self._source, self._processors, self._sinks = repository or Repository(), None, [], []
        self._size, self._group, self._skip, self._retry, self._listeners, self._stop, self._parallelism = 10, 1, NEVER, None, [], None, 1

    def source(self, source) -> StepBuilder:
        self._source = source
        return self

    def processor(self, *processors: Processor) -> StepBuilder:
        self._processors += processors
        return self

    def sink(self, *sinks: Sink) -> StepBuilder:
        self._sinks += sinks
        return self

    def chunk_size(self, n: int) -> StepBuilder:
        if n < 1:
            raise ValueError("a chunk has one row at least")
        self._size = n
        return self

    def chunks_per_commit(self, n: int) -> StepBuilder:
        """Chunks written and checkpointed together; more means fewer Spark jobs."""
        if n < 1:
            raise ValueError("a commit has one chunk at least")
        self._group = n
        return self

    def parallelism(self, n: int) -> StepBuilder:
        if n < 1:
            raise ValueError("one task at least")
        self._parallelism = n
        return self

    def skip_policy(self, policy: SkipPolicy) -> StepBuilder:
        self._skip = policy
        return self

    def retry_policy(self, policy: RetryPolicy) -> StepBuilder:
        """How often a row's function is called again; what still fails goes to the skip policy."""
        self._retry = policy
        return self

    def listener(self, *listeners: ChunkListener | StepListener) -> StepBuilder:
        self._listeners += listeners
        return self

    def dead_letters(self, sink, item_type: str = "Row") -> StepBuilder:
        self._listeners.insert(0, DeadLetterListener(sink, item_type))
        return self

    def graceful_stop(self, stop: Stop) -> StepBuilder:
        self._stop = stop
        return self

    def build(self, name: str) -> ChunkStep:
        if not name.strip():
            raise ValueError("a step needs a name")
        if self._source is None or not self._sinks:
            raise ValueError("a step needs a source and a sink")
        processor = Composite(self._processors) if self._processors else Identity()
        if self._retry is not None:
            processor = processor.with_retry(self._retry)
        sink = self._sinks[0] if len(self._sinks) == 1 else CompositeSink(self._sinks)
        return ChunkStep(self._repository, name, self._source, processor, sink, self._size, self._group, self._skip, self._listeners, self._stop, self._parallelism)


class Repeat(Enum):
    CONTINUABLE = "Continuable"
    FINISHED = "Finished"


class TaskletStep(Step):
    """Calls a function until it is finished; between calls a stop request ends the step."""

    def __init__(self, repository: Repository, name: str, tasklet: Callable[[StepExecution], Repeat], stop: Stop | None = None):
        self.repository, self.name, self.tasklet, self.stop = repository, name, tasklet, stop

    def execute(self, job: JobExecution) -> StepExecution:
        step = self.repository.create_step_execution(job, self.name)
        step.status = Status.STARTED
        self.repository.update_step(step)
        try:
            step.status = Status.COMPLETED
            while True:
                if self.stop is not None and self.stop.requested:
                    step.status = Status.STOPPED
                    break
                if self.tasklet(step) is not Repeat.CONTINUABLE:
                    break
        except Exception as e:
            step.status, step.failure, step.failure_message = Status.FAILED, e, str(e)[:4000]
        step.end_time = now()
        self.repository.update_step(step)
        return step


class PartitionHandler:
    """Runs ``run`` for each part and returns the parts' step executions in order; here side by side in threads of the driver."""

    def handle(self, run: Callable[[tuple[str, Context]], StepExecution], parts: dict[str, Context], parallel: int) -> list[StepExecution]:
        with ThreadPoolExecutor(len(parts) if parallel == -1 else parallel) as pool:
            return list(pool.map(run, parts.items()))


class PartitionedStep(Step):
    """Runs a worker step for each part of a grid, each with its own range in its context.

    ``worker`` makes a fresh step for a part, so parts share no state; Spark runs their jobs side by
    side. One failed part does not stop the others. On a restart, parts that have completed are
    not run again, and the others resume behind their checkpoints.
    """

    def __init__(self, repository: Repository, name: str, worker: Callable[[str, Context], Step], partitioner: RangePartitioner, grid: int = 4, parallel: int = -1, handler: PartitionHandler | None = None):
        if grid < 1 or (parallel < 1 and parallel != -1):
            raise ValueError("a grid and a parallelism of one at least (-1: all)")
        self.repository, self.name, self.worker, self.partitioner, self.grid, self.parallel = repository, name, worker, partitioner, grid, parallel
        self.handler = handler or PartitionHandler()

    def execute(self, job: JobExecution) -> StepExecution:
        manager = self.repository.create_step_execution(job, self.name)
        manager.status = Status.STARTED
        self.repository.update_step(manager)
        parts = self.partitioner.partition(self.grid)

        def run(item: tuple[str, Context]) -> StepExecution:
            name, context = item
            full = f"{self.name}:{name}"
            if job.restarted_from is not None:
                last = self.repository.last_step_execution(job.restarted_from, full)
                if last is not None and last.status == Status.COMPLETED:
                    return last
            step = self.worker(name, context)
            step.name = full
            own = JobExecution(job.id, job.instance, job.parameters, job.status, restarted_from=job.restarted_from, context=context)
            return step.execute(own)

        try:
            done = self.handler.handle(run, parts, self.parallel)
            bad = [s for s in done if s.status == Status.FAILED]
            stopped = any(s.status == Status.STOPPED for s in done)
            manager.status = Status.FAILED if bad else Status.STOPPED if stopped else Status.COMPLETED
            if bad:
                manager.failure, manager.failure_message = bad[0].failure, bad[0].failure_message
            for s in done:
                manager.read_count += s.read_count
                manager.write_count += s.write_count
                manager.skip_count += s.skip_count
                manager.rollback_count += s.rollback_count
        except Exception as e:
            manager.status, manager.failure, manager.failure_message = Status.FAILED, e, str(e)[:4000]
        manager.end_time = now()
        self.repository.update_step(manager)
        return manager
