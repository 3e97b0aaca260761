import json
import sqlite3
import threading
import time
from datetime import timedelta
from pathlib import Path

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

from millrace.model import Context, Parameters, Status, now
from millrace.operators.policies import ALWAYS, NEVER, Classifier, RetryPolicy, SkipPolicy, classified, limited
from millrace.operators.processing import ArrowMap, Chain, Composite, Identity, Project, PythonMap, Transform
from millrace.operators.ranges import RangePartitioner
from millrace.plans import cli
from millrace.plans.jobs import AlreadyRunning, FlowBuilder, FlowError, Host, JobBuilder, Launcher
from millrace.plans.repository import MIGRATIONS, Repository
from millrace.plans.steps import ChunkListener, PartitionedStep, PartitionHandler, Repeat, Step, StepAborted, StepBuilder, StepListener, Stop, TaskletStep
from millrace.sinks.files import JsonArraySink, LineFileSink, ParquetSink, Sink, TextSink, XmlSink
from millrace.sinks.others import CompositeSink, JsonLinesDeadLetters, MemoryDeadLetters, MemorySink, RepositoryDeadLetters, SqliteSink
from millrace.sources.files import JsonArraySource, LineSource, XmlSource
from millrace.sources.memory import FrameSource, MemorySource
from millrace.sources.relational import KeysetSource


def run(repository, step, parameters=None):
    return JobBuilder("job", repository).step(step).build().execute(parameters or Parameters())


def ints(spark, low, high, key="memory.last"):
    return MemorySource(spark, [(i,) for i in range(low, high + 1)], "value int", key)


def bad(values, error=ValueError):
    def f(row):
        if row["value"] in values:
            raise error(f"bad {row['value']}")
        return row

    return PythonMap(f, "value int")


@pytest.fixture
def repo():
    return Repository()


@pytest.mark.parametrize(("n", "size", "sizes"), [(10, 3, [3, 3, 3, 1]), (7, 3, [3, 3, 1]), (0, 3, []), (6, 3, [3, 3])])
def test_chunks_keep_order_and_sizes(spark, repo, n, size, sizes):
    sink, seen = MemorySink(), []

    class Watch(ChunkListener):
        def before_chunk(self, step, chunk):
            seen.append(("before", chunk))

        def after_chunk(self, step, chunk):
            seen.append(("after", chunk))

    job = run(repo, StepBuilder(repo).source(ints(spark, 1, n)).sink(sink).chunk_size(size).listener(Watch()).build("s"))
    assert job.status == Status.COMPLETED
    assert [len(c) for c in sink.chunks] == sizes
    assert [r[0] for r in sink.rows] == list(range(1, n + 1))
    assert seen == [(w, i) for i in range(len(sizes)) for w in ("before", "after")]
    assert (job.steps[0].read_count, job.steps[0].write_count, job.steps[0].skip_count) == (n, n, 0)


def test_chunks_per_commit_group(spark, repo):
    sink = MemorySink()
    run(repo, StepBuilder(repo).source(ints(spark, 1, 10)).sink(sink).chunk_size(2).chunks_per_commit(3).build("s"))
    assert [len(c) for c in sink.chunks] == [2] * 5


def test_always_skip(spark, repo):
    sink, letters = MemorySink(), MemoryDeadLetters()
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 3)).processor(bad({1, 2, 3})).sink(sink).chunk_size(2).skip_policy(ALWAYS).dead_letters(letters).build("s"))
    assert job.status == Status.COMPLETED
    assert job.steps[0].skip_count == 3 and sink.chunks == []
    assert [e["skip_count_at_time"] for e in letters.entries] == [0, 1, 2]
    assert letters.entries[0]["exception_type"] == "ValueError" and json.loads(letters.entries[0]["item_json"]) == {"value": 1}


def test_skip_limit_aborts(spark, repo):
    sink = MemorySink()
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 3)).processor(bad({1, 2, 3})).sink(sink).skip_policy(limited(2)).build("s"))
    assert job.status == Status.FAILED and isinstance(job.failure, StepAborted)
    assert job.steps[0].skip_count == 2 and sink.chunks == []


def test_abort_keeps_full_chunks_only(spark, repo):
    sink = MemorySink()
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 10)).processor(bad({6})).sink(sink).chunk_size(2).build("s"))
    assert job.status == Status.FAILED
    assert [r[0] for r in sink.rows] == [1, 2, 3, 4]


def test_skips_among_many(spark, repo):
    sink = MemorySink()
    job = run(repo, StepBuilder(repo).source(ints(spark, 0, 99)).processor(bad({0, 20, 40, 60, 80})).sink(sink).chunk_size(10).chunks_per_commit(4).skip_policy(classified(Classifier().skip(Exception))).build("s"))
    assert (job.steps[0].read_count, job.steps[0].write_count, job.steps[0].skip_count) == (100, 95, 5)


def test_classifier_matches_subclasses(spark, repo):
    c = Classifier().skip(ArithmeticError).retry("TimeoutError")
    assert c.is_skippable(ZeroDivisionError()) and not c.is_skippable(ValueError()) and c.is_retryable(TimeoutError())
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 3)).processor(bad({2}, ZeroDivisionError)).sink(MemorySink()).skip_policy(classified(c)).build("s"))
    assert job.status == Status.COMPLETED and job.steps[0].skip_count == 1
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 3)).processor(bad({2})).sink(MemorySink()).skip_policy(classified(c)).build("t"), Parameters(a="1"))
    assert job.status == Status.FAILED
    assert SkipPolicy(c, 1).should_skip(ZeroDivisionError(), 0) and not SkipPolicy(c, 1).should_skip(ZeroDivisionError(), 1)


def test_retry_counts_attempts(spark):
    def flaky(row):
        raise OSError("always")

    rows = PythonMap(flaky, "value int", attempts=3).apply(ints(spark, 1, 2).open()).select("_err.attempts", "_err.message").collect()
    assert [tuple(r) for r in rows] == [(3, "always")] * 2


def test_processors(spark):
    rows = MemorySource(spark, [(x,) for x in ("ab", "c", "de", "f", "gh")], "value string").open()
    assert [r["value"] for r in Project(F.length("value") % 2 == 0).apply(rows).orderBy("_seq").collect()] == ["ab", "de", "gh"]
    suffix = lambda s: Transform(lambda df: df.withColumn("value", F.concat("value", F.lit(s))))
    assert Composite([suffix("-p1"), suffix("-p2"), Identity(), suffix("-p3")]).apply(rows).where("_seq = 1").first()["value"] == "ab-p1-p2-p3"
    numbers = MemorySource(spark, [(str(i),) for i in range(1, 11)], "value string").open()
    chain = Chain(Project(n=F.col("value").cast("int")), Project(F.col("n") > 1, shown=F.concat(F.lit("Value:"), F.col("n").cast("string"))))
    assert [r["shown"] for r in chain.apply(numbers).orderBy("_seq").collect()] == [f"Value:{i}" for i in range(2, 11)]
    with pytest.raises(ValueError):
        Composite([])
    with pytest.raises(ValueError):
        CompositeSink([])


def test_getting_started_example(spark, repo):
    rows = [(i, f"p{i}", -1.0 if i == 42 else i * 9.99) for i in range(1, 101)]
    sink = MemorySink()
    amount = F.col("amount").cast("decimal(18,2)")
    step = StepBuilder(repo).source(MemorySource(spark, rows, "id int, product string, amount double")).processor(Project(F.col("amount") > 0, id=F.col("id"), tax=F.bround(amount * F.lit("0.08").cast("decimal(3,2)"), 2))).sink(sink).chunk_size(10).build("s")
    job = run(repo, step)
    assert (job.steps[0].write_count, job.steps[0].skip_count) == (99, 0)


class FailsOn(Sink):
    def __init__(self, inner, call):
        self.inner, self.call, self.calls = inner, call, 0

    def write(self, rows, step, first_chunk):
        self.calls += 1
        if self.calls == self.call:
            raise OSError("disk full")
        self.inner.write(rows, step, first_chunk)


def test_writer_failure_rolls_back_and_restart_resumes(spark, repo):
    first, second = MemorySink(), MemorySink()
    errors = []

    class Watch(ChunkListener):
        def on_error(self, step, chunk, error):
            errors.append((chunk, str(error)))

    def job(sink2):
        one = StepBuilder(repo).source(ints(spark, 1, 4)).sink(first).chunk_size(3).build("one")
        two = StepBuilder(repo).source(ints(spark, 1, 6)).sink(sink2).chunk_size(3).listener(Watch()).build("two")
        return JobBuilder("two-steps", repo).step(one).step(two).build()

    failed = job(FailsOn(second, 2)).execute()
    assert failed.status == Status.FAILED and errors == [(1, "disk full")]
    assert failed.steps[1].rollback_count == 1 and failed.steps[1].write_count == 3
    again = job(second).execute()
    assert again.status == Status.COMPLETED and again.restarted_from == failed.id
    assert [r[0] for r in second.rows] == [1, 2, 3, 4, 5, 6]
    assert [r[0] for r in first.rows] == [1, 2, 3, 4]  # a completed step is not run again
    assert again.steps[1].is_restart and again.steps[1].write_count == 3


def test_later_step_does_not_run_after_failure(spark, repo):
    sink = MemorySink()
    one = StepBuilder(repo).source(ints(spark, 1, 2)).sink(FailsOn(sink, 1)).build("one")
    two = StepBuilder(repo).source(ints(spark, 1, 2)).sink(sink).build("two")
    assert JobBuilder("j", repo).step(one).step(two).build().execute().status == Status.FAILED
    assert sink.chunks == []


def test_graceful_stop_then_resume(spark, repo):
    stop, sink = Stop(), MemorySink()

    class StopAfterFirst(ChunkListener):
        def after_chunk(self, step, chunk):
            stop.request()

    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 10)).sink(sink).chunk_size(5).listener(StopAfterFirst()).graceful_stop(stop).build("s"))
    assert job.status == Status.STOPPED and [r[0] for r in sink.rows] == [1, 2, 3, 4, 5]
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 10)).sink(sink).chunk_size(5).build("s"))
    assert job.status == Status.COMPLETED and [r[0] for r in sink.rows] == list(range(1, 11))


def test_builder_validation(spark, repo):
    with pytest.raises(ValueError):
        StepBuilder(repo).chunk_size(0)
    with pytest.raises(ValueError):
        StepBuilder(repo).parallelism(0)
    with pytest.raises(ValueError):
        StepBuilder(repo).source(ints(spark, 1, 2)).build("s")
    with pytest.raises(ValueError):
        StepBuilder(repo).source(ints(spark, 1, 2)).sink(MemorySink()).build(" ")


def test_parallel_step_keeps_everything(spark, repo):
    sink = MemorySink()
    run(repo, StepBuilder(repo).source(ints(spark, 1, 50)).processor(bad(set())).sink(sink).chunk_size(8).chunks_per_commit(10).parallelism(4).build("s"))
    assert sorted(r[0] for r in sink.rows) == list(range(1, 51)) and [len(c) for c in sink.chunks] == [8] * 6 + [2]


# ranges


@pytest.mark.parametrize(("low", "high", "grid", "want"), [(1, 100, 4, [(1, 25), (26, 50), (51, 75), (76, 100)]), (1, 10, 3, [(1, 3), (4, 6), (7, 10)]), (5, 50, 1, [(5, 50)]), (0, 4, 8, [(0, -1)] * 7 + [(0, 4)])])
def test_range_bounds(low, high, grid, want):
    assert [(a, b) for _, a, b in RangePartitioner(low, high).bounds(grid)] == want


def test_range_errors():
    with pytest.raises(ValueError):
        RangePartitioner(2, 1)
    with pytest.raises(ValueError):
        RangePartitioner(1, 2).bounds(0)


def worker(spark, repo, sink, fail=None):
    def make(name, context):
        low, high = context.get("partition.minValue"), context.get("partition.maxValue")
        target = FailsOn(sink, 1) if name == fail else sink
        return StepBuilder(repo).source(KeysetSource(spark.range(low, high + 1), "id", key="keyset.last")).sink(target).chunk_size(10).chunks_per_commit(5).build(name)

    return make


def test_partitioned_step(spark, repo, tmp_path):
    class Counting(MemorySink):
        lock = threading.Lock()

        def write(self, rows, step, first_chunk):
            got = [r["id"] for r in rows.collect()]
            with self.lock:
                self.chunks.append([(x,) for x in got])

    sink = Counting()
    job = JobBuilder("p", repo).step(PartitionedStep(repo, "load", worker(spark, repo, sink), RangePartitioner(1, 40), 4)).build().execute()
    assert job.status == Status.COMPLETED and sorted(r[0] for r in sink.rows) == list(range(1, 41))
    assert repo.last_step_execution(job.id, "load").write_count == 40
    other = Counting()
    job = JobBuilder("q", repo).step(PartitionedStep(repo, "load", worker(spark, repo, other, "partition2"), RangePartitioner(1, 40), 4)).build().execute()
    assert job.status == Status.FAILED and sorted(r[0] for r in other.rows) == [*range(1, 21), *range(31, 41)]
    job = JobBuilder("q", repo).step(PartitionedStep(repo, "load", worker(spark, repo, other), RangePartitioner(1, 40), 4)).build().execute()
    assert job.status == Status.COMPLETED and sorted(r[0] for r in other.rows) == list(range(1, 41))


# tasklets and flows


def test_tasklet(repo):
    calls = []

    def work(_):
        calls.append(1)
        return Repeat.CONTINUABLE if len(calls) < 4 else Repeat.FINISHED

    assert run(repo, TaskletStep(repo, "t", work)).status == Status.COMPLETED and len(calls) == 4

    def fails(_):
        raise RuntimeError("no")

    job = run(repo, TaskletStep(repo, "u", fails), Parameters(x="1"))
    assert job.status == Status.FAILED and job.failure_message == "no"


class Fixed(Step):
    def __init__(self, repo, name, *statuses):
        self.repo, self.name, self.statuses, self.runs = repo, name, list(statuses), 0

    def execute(self, job):
        step = self.repo.create_step_execution(job, self.name)
        step.status = self.statuses[min(self.runs, len(self.statuses) - 1)]
        self.runs += 1
        self.repo.update_step(step)
        return step


def test_flow_linear_branch_wildcard(repo):
    ok, failed = Status.COMPLETED, Status.FAILED
    a, b, c = Fixed(repo, "a", ok), Fixed(repo, "b", ok), Fixed(repo, "c", ok)
    flow = FlowBuilder("f", repo).start(a).on("COMPLETED").to(b).on("*").to(c).from_(b).on("*").end().from_(c).on("*").end().build()
    assert flow.execute().status == Status.COMPLETED and (b.runs, c.runs) == (1, 0)
    a = Fixed(repo, "a", failed)
    flow = FlowBuilder("g", repo).start(a).on("*").to(c).on("COMPLETED").to(b).from_(b).on("*").end().from_(c).on("*").end().build()
    assert flow.execute().status == Status.COMPLETED and c.runs == 1


def test_flow_ends(repo):
    a = Fixed(repo, "a", Status.COMPLETED)
    assert FlowBuilder("f1", repo).start(a).on("*").fail().build().execute().status == Status.FAILED
    assert FlowBuilder("f2", repo).start(a).on("*").stop().build().execute().status == Status.STOPPED
    assert FlowBuilder("f3", repo).start(Fixed(repo, "b", Status.FAILED)).on("*").end().build().execute().status == Status.FAILED
    none = FlowBuilder("f4", repo).start(a).on("FAILED").end().build().execute()
    assert none.status == Status.FAILED and isinstance(none.failure, FlowError)


def test_flow_retry_loop_and_validation(repo):
    a, b, c = Fixed(repo, "a", Status.FAILED, Status.FAILED, Status.COMPLETED), Fixed(repo, "b", Status.COMPLETED), Fixed(repo, "c", Status.COMPLETED)
    flow = FlowBuilder("loop", repo).start(a).on("FAILED").to(b).on("COMPLETED").end().from_(b).on("*").to(a).build()
    assert flow.execute().status == Status.COMPLETED and a.runs == 3
    with pytest.raises(FlowError, match="not reachable"):
        FlowBuilder("x", repo).start(a).on("*").end().from_(c).on("*").end().build()
    with pytest.raises(FlowError, match="ends"):
        FlowBuilder("x", repo).start(a).on("*").to(b).from_(b).on("*").to(a).build()
    with pytest.raises(FlowError, match="no transitions"):
        FlowBuilder("x", repo).start(a).on("*").to(b).build()
    with pytest.raises(FlowError):
        FlowBuilder("x", repo).build()


# repository, launcher, host, command line


def test_parameters():
    assert Parameters(a="1", b="2") == Parameters(b="2", a="1") and hash(Parameters(a="1", b="2")) == hash(Parameters(b="2", a="1"))
    assert Parameters() == Parameters({}) != Parameters(a="1")
    c = Context()
    c.put("x", {"y": [1]})
    assert Context.load(c.dump()).get("x") == {"y": [1]} and c.get("none", 0) == 0 and "x" in c


def test_repository_lookups(repo):
    p = Parameters(b="2", a="1")
    i = repo.instance("j", p)
    assert repo.instance("j", Parameters(a="1", b="2")).id == i.id
    first, second = repo.create_job_execution(i, p), repo.create_job_execution(i, p)
    assert repo.last_job_execution("j", Parameters(a="1", b="2")).id == second.id
    assert repo.last_job_execution("j", Parameters()) is None and repo.running_job_execution("j", p) is None
    second.status = Status.STARTED
    repo.update_job(second)
    assert repo.running_job_execution("j", p).id == second.id and [e.id for e in repo.job_executions(i)] == [first.id, second.id]
    s = repo.create_step_execution(second, "s")
    s.read_count, s.write_count, s.skip_count = 5, 4, 1
    s.context.put("k", 7)
    repo.update_step(s)
    back = repo.last_step_execution(second.id, "s")
    assert (back.read_count, back.write_count, back.skip_count, back.context.get("k")) == (5, 4, 1, 7)
    second.id = 99
    with pytest.raises(LookupError):
        repo.update_job(second)


def test_locks(repo):
    p, at = Parameters(a="1", b="2"), now()
    lock = repo.acquire_lock("j", p, timedelta(minutes=30), at)
    assert lock is not None and repo.acquire_lock("j", Parameters(b="2", a="1"), at=at) is None
    assert repo.acquire_lock("j", Parameters(), at=at) is not None
    assert lock.renew()
    lock.release()
    expired = repo.acquire_lock("j", p, timedelta(minutes=1), at - timedelta(hours=1))
    assert expired is not None and repo.acquire_lock("j", p, at=at) is not None and not expired.renew()
    got = []
    threads = [threading.Thread(target=lambda: got.append(repo.acquire_lock("race", p))) for _ in range(8)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sum(x is not None for x in got) == 1


def test_launcher(repo):
    release, started = threading.Event(), threading.Event()

    def work(_):
        started.set()
        release.wait(10)
        return Repeat.FINISHED

    job = JobBuilder("long", repo).step(TaskletStep(repo, "t", work)).build()
    stop = Stop()
    launcher = Launcher(repo, repo, heartbeat=timedelta(milliseconds=30), silent=timedelta(minutes=5))
    host = Host(launcher, job, stop, timedelta(seconds=5))
    host.start()
    assert started.wait(5)
    with pytest.raises(AlreadyRunning, match="execution"):
        launcher.launch(job)
    time.sleep(0.2)
    release.set()
    assert host.join(timedelta(seconds=5)) and host.result.status == Status.COMPLETED
    assert repo.job_execution(host.result.id).last_heartbeat is not None or host.result.last_heartbeat is not None
    assert repo.acquire_lock("long", Parameters()) is not None


def test_crashed_execution_is_recovered(repo):
    p = Parameters()
    crashed = repo.create_job_execution(repo.instance("j", p), p)
    crashed.status, crashed.last_heartbeat = Status.STARTED, now() - timedelta(hours=1)
    repo.update_job(crashed)
    job = JobBuilder("j", repo).step(Fixed(repo, "s", Status.COMPLETED)).build()
    with pytest.raises(AlreadyRunning):
        Launcher(repo).launch(job)
    done = Launcher(repo, silent=timedelta(minutes=5)).launch(job)
    assert done.status == Status.COMPLETED and done.restarted_from == crashed.id


def test_command_line(tmp_path, capsys):
    path = str(tmp_path / "r.db")
    repo = Repository(path)
    repo.instance("idle", Parameters())
    i = repo.instance("busy", Parameters(day="1"))
    e = repo.create_job_execution(i, i.parameters)
    e.status, e.failure_message = Status.FAILED, "late"
    e.end_time = e.start_time + timedelta(hours=30, seconds=5)
    repo.update_job(e)
    repo.create_step_execution(e, "s")
    assert cli.main(["--repository", path, "jobs"]) == 0
    out = capsys.readouterr().out
    assert "idle" in out and "(none)" in out and " - " in out and "day=1" in out
    assert cli.main(["--repository", path, "executions", "busy"]) == 0 and "30:00:05" in capsys.readouterr().out
    assert cli.main(["--repository", path, "steps", str(e.id)]) == 0 and "Starting" in capsys.readouterr().out
    assert cli.main(["--repository", path, "rerun", str(e.id), "--yes"]) == 0
    assert repo.job_execution(e.id).status == Status.ABANDONED
    assert cli.main(["--repository", path, "rerun", str(e.id), "--yes"]) == 1 and cli.main(["--repository", path, "rerun", "77"]) == 1


def test_repository_frames(spark, repo):
    p = Parameters(a="1")
    e = repo.create_job_execution(repo.instance("j", p), p)
    repo.create_step_execution(e, "s")
    assert repo.frame(spark, "job_executions").first()["status"] == "Starting" and repo.frame(spark, "step_executions").count() == 1


# files


def test_lines(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes(b"Id,P\nA,1\n\n   \nB,2\r\nC\n")
    source = LineSource(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in source.open(Context()).orderBy("_seq").collect()] == [(2, "A,1"), (5, "B,2"), (6, "C")]
    c = Context()
    source.save(c, 2)
    assert [r["_seq"] for r in source.open(c).orderBy("_seq").collect()] == [5, 6]


def test_line_sink_truncates_and_appends(spark, tmp_path):
    path = tmp_path / "out.txt"
    path.write_text("old\n")
    rows = ints(spark, 1, 3).open().withColumn("_chunk", F.lit(0))
    for append, want in ((False, "1\n2\n3\n"), (True, "1\n2\n3\n1\n2\n3\n")):
        sink = LineFileSink(str(path), lambda: F.col("value").cast("string"), append)
        sink.write(rows, "s", 0)
        sink.close()
        assert path.read_text() == want


def test_json_sink(spark, tmp_path):
    path = tmp_path / "o.json"
    sink = JsonArraySink(str(path))
    sink.close()
    assert path.read_text() == "[]"
    rows = ints(spark, 1, 2).open().withColumn("_chunk", F.lit(0))
    sink.write(rows, "s", 0)
    sink.write(rows, "s", 1)
    sink.close()
    assert json.loads(path.read_text()) == [{"value": 1}, {"value": 2}] * 2


def test_xml(spark, tmp_path):
    path = tmp_path / "o.xml"
    rows = MemorySource(spark, [(1, "a"), (2, "b")], "id int, name string").open().withColumn("_chunk", F.lit(0))
    sink = XmlSink(str(path), "orders", "order")
    sink.write(rows, "s", 0)
    sink.write(rows, "s", 1)
    source = XmlSource(spark, str(path), "order", "id int, name string")
    assert [tuple(r) for r in source.open(Context()).orderBy("_seq").collect()] == [(1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (4, 2, "b")]
    c = Context()
    source.save(c, 3)
    assert source.open(c).count() == 1
    native = XmlSource(spark, str(path), "order", "id int, name string", native=True).open(Context()).select("_seq", "id", "name")
    assert [tuple(r) for r in native.orderBy("_seq").collect()] == [(1, 1, "a"), (2, 2, "b"), (3, 1, "a"), (4, 2, "b")]
    (tmp_path / "n.xml").write_text("<r><o><id>1</id><o><id>2</id></o></o></r>")
    assert [r["id"] for r in XmlSource(spark, str(tmp_path / "n.xml"), "o", "id int").open(Context()).orderBy("_seq").collect()] == [1, 2]
    (tmp_path / "e.xml").write_text("<r/>")
    assert XmlSource(spark, str(tmp_path / "e.xml"), "o", "id int").open(Context()).count() == 0


def test_sqlite_sink_is_atomic(spark, repo, tmp_path):
    path = str(tmp_path / "t.db")
    with sqlite3.connect(path) as db:
        db.execute("create table t (value integer primary key)")
        db.execute("insert into t values (5)")
    job = run(repo, StepBuilder(repo).source(ints(spark, 1, 10)).sink(SqliteSink(path, "t")).chunk_size(10).build("s"))
    assert job.status == Status.FAILED
    with sqlite3.connect(path) as db:
        assert db.execute("select count(*) from t").fetchone() == (1,)


def test_composite_sink_stops_at_first_failure(spark):
    a, b, c = MemorySink(), FailsOn(MemorySink(), 1), MemorySink()
    rows = ints(spark, 1, 2).open().withColumn("_chunk", F.lit(0))
    with pytest.raises(OSError):
        CompositeSink([a, b, c]).write(rows, "s", 0)
    assert len(a.rows) == 2 and c.rows == []


def test_parquet_sink_replaces_its_group(spark, tmp_path):
    rows = ints(spark, 1, 4).open().withColumn("_chunk", F.lit(0))
    for _ in range(2):
        ParquetSink(str(tmp_path / "p")).write(rows, "s", 0)
    assert spark.read.parquet(str(tmp_path / "p")).count() == 4


def test_dead_letter_sinks(spark, repo, tmp_path):
    path = tmp_path / "dead.jsonl"
    step = StepBuilder(repo).source(ints(spark, 1, 5)).processor(bad({2, 4})).sink(MemorySink()).skip_policy(ALWAYS).dead_letters(JsonLinesDeadLetters(str(path))).dead_letters(RepositoryDeadLetters(repo)).build("s")
    run(repo, step)
    lines = [json.loads(x) for x in path.read_text().splitlines()]
    assert [x["SkipCountAtTime"] for x in lines] == [0, 1] and lines[0]["ExceptionMessage"] == "bad 2" and lines[0]["StepName"] == "s"
    assert [e["skip_count_at_time"] for e in repo.dead_letter_rows()] == [0, 1]


def test_frame_source_resumes(spark):
    source, c = FrameSource(spark.createDataFrame([("b",), ("a",), ("c",)], "k string"), ["k"]), Context()
    assert [r["k"] for r in source.open(c).orderBy("_seq").collect()] == ["a", "b", "c"]
    source.save(c, 2)
    assert [r["k"] for r in source.open(c).collect()] == ["c"]


def test_stream_resumes_without_repeats(spark, tmp_path):
    from millrace.streaming.chunks import file_stream, run_stream

    data, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ckpt")
    spark.range(0, 10).coalesce(1).write.parquet(data)
    spark.range(10, 20).coalesce(1).write.mode("append").parquet(data)
    for _ in range(2):
        q = run_stream(file_stream(spark, data, "id long"), Project(F.col("id") % 2 == 0), ParquetSink(out), check, ["id"], 3)
        q.awaitTermination(60)
    rows = spark.read.parquet(out).collect()
    assert sorted(r["id"] for r in rows) == list(range(0, 20, 2)) and sorted({r["_chunk"] for r in rows}) == [0, 1, 1 << 32, (1 << 32) + 1]


def test_positions_of_uneven_keys(spark):
    from millrace.operators.sequence import chunk_sizes, chunked, numbered, size_histogram

    rows = spark.range(200_000).select(F.when(F.col("id") % 3 == 0, 10**15).otherwise(F.col("id") % 7).alias("k"), "id")
    got = numbered(rows, ["k", "id"]).select(F.min("_seq"), F.max("_seq"), F.countDistinct("_seq"), F.min(F.when(F.col("k") == 10**15, F.col("_seq")))).first()
    assert tuple(got) == (0, 199_999, 200_000, 200_000 - 66_667)
    few = spark.createDataFrame([(3,), (None,), (1,), (None,)], "k long")
    assert sorted((r["k"] is not None, r["_chunk"]) for r in chunked(few, ["k"], 2).collect()) == [(False, 0), (False, 0), (True, 1), (True, 1)]
    assert numbered(few.limit(0), ["k"]).count() == 0 and chunk_sizes(few.limit(0), 3).count() == 0
    assert [tuple(r) for r in chunk_sizes(few, 3).orderBy("chunk").collect()] == [(0, 3), (1, 1)] and sorted(tuple(r) for r in size_histogram(few, 3).collect()) == [(1, 1), (3, 1)]


def test_drain_timeout_cancels(spark, repo):
    stop = Stop(timedelta(seconds=0.5))

    def slow(row):
        time.sleep(20)
        return row

    step = StepBuilder(repo).source(ints(spark, 1, 4)).processor(PythonMap(slow, "value int")).sink(MemorySink()).graceful_stop(stop).build("s")
    threading.Timer(2, stop.request).start()
    at = time.time()
    assert run(repo, step).status == Status.FAILED and time.time() - at < 20
    assert spark.range(3).count() == 3


def test_job_listener_and_telemetry(repo):
    from millrace.plans.jobs import JobListener
    from millrace.plans.telemetry import TELEMETRY

    seen, heard = [], []

    class Watch(JobListener):
        def before_job(self, execution):
            seen.append(execution.status)

        def after_job(self, execution):
            seen.append(execution.status)

    TELEMETRY.listen(lambda kind, name, value, tags: heard.append((kind, name)))
    JobBuilder("watched", repo).step(Fixed(repo, "a", Status.COMPLETED)).listener(Watch()).build().execute()
    assert seen == [Status.STARTED, Status.COMPLETED] and ("counter", "jobs.completed") in heard and ("span", "job") in heard


def test_python_functions_see_nulls_and_whole_numbers(spark):
    rows = MemorySource(spark, [(1, None), (None, "x"), (2**53 + 1, "y")], "n long, s string").open()
    got = PythonMap(lambda r: {"n": r["n"], "shown": repr((r["n"], r["s"]))}, "n long, shown string").apply(rows).orderBy("_seq").collect()
    assert [(r["n"], r["shown"]) for r in got] == [(1, "(1, None)"), (None, "(None, 'x')"), (2**53 + 1, f"({2**53 + 1}, 'y')")]


def test_retry_policy_of_a_step(spark, repo, tmp_path):
    """Named errors are tried again, others fail at once; what still fails is skipped or ends the step."""
    calls: dict[int, int] = {}

    def flaky(row):
        n = calls[row["value"]] = calls.get(row["value"], 0) + 1
        if row["value"] == 4:
            raise ValueError("no number")
        if n < row["value"]:
            raise ConnectionResetError("busy")
        return {"value": row["value"], "calls": n}

    def step(skip, sink):
        policy = RetryPolicy(3, Classifier().retry(ConnectionError))
        return StepBuilder(repo).source(ints(spark, 1, 5)).processor(Composite([Identity(), PythonMap(flaky, "value int, calls int")])).retry_policy(policy).skip_policy(skip).sink(sink).chunk_size(2)

    letters, sink = MemoryDeadLetters(), MemorySink()
    done = run(repo, step(ALWAYS, sink).dead_letters(letters).build("a"))
    assert done.status == Status.COMPLETED and sink.rows == [(1, 1), (2, 2), (3, 3)]
    assert [(e["exception_type"], e["item_json"]) for e in letters.entries] == [("ValueError", '{"value":4}'), ("ConnectionResetError", '{"value":5}')]
    assert repo.last_step_execution(done.id, "a").skip_count == 2
    assert run(repo, step(NEVER, MemorySink()).build("b"), Parameters(k="other")).status == Status.FAILED
    with pytest.raises(ValueError):
        RetryPolicy(0)


def test_groups_are_staged_and_committed_by_rename(spark, repo, tmp_path):
    path = str(tmp_path / "out")

    class Seen(ChunkListener, StepListener):
        events: list = []

        def before_step(self, step):
            self.events.append("before")

        def after_write(self, step, chunk, rows):
            self.events.append((chunk, rows, sorted(x.name for x in Path(path).glob("group=*"))[-1]))

        def after_step(self, step):
            self.events.append(step.write_count)

    assert run(repo, StepBuilder(repo).source(ints(spark, 1, 23)).sink(ParquetSink(path)).chunk_size(5).chunks_per_commit(2).listener(Seen()).build("s")).status == Status.COMPLETED
    assert Seen.events == ["before", (0, 10, "group=000000000000"), (2, 10, "group=000000000002"), (4, 3, "group=000000000004"), 23]
    assert sorted(r["value"] for r in spark.read.parquet(path).collect()) == list(range(1, 24)) and not list(Path(path).glob("_staged*"))
    text = str(tmp_path / "text")
    run(repo, StepBuilder(repo).source(ints(spark, 1, 7)).sink(CompositeSink([TextSink(text, lambda: F.col("value").cast("string"))])).chunk_size(3).build("t"), Parameters(k="text"))
    assert [[x for f in sorted(g.glob("part-*")) for x in f.read_text().split()] for g in sorted(Path(text).glob("group=*"))] == [["1", "2", "3"], ["4", "5", "6"], ["7"]]


def test_files_follow_each_other(spark, tmp_path):
    for name, ids in (("a", (1, 2, 3)), ("b", (4, 5))):
        (tmp_path / f"{name}.xml").write_text("<r>" + "".join(f'<o id="{i}"><in><o id="{10 * i}"/></in></o>' for i in ids) + "</r>")
        (tmp_path / f"{name}.json").write_text("[" + ", null, ".join(f'{{"id": {i}}}' for i in ids) + "]")
    source, context = XmlSource(spark, str(tmp_path / "*.xml"), "o", "id int"), Context()
    assert [tuple(r) for r in source.open(context).orderBy("_seq").collect()] == list(enumerate([1, 10, 2, 20, 3, 30, 4, 40, 5, 50], 1))
    source.save(context, 7)
    assert [r["id"] for r in source.open(context).orderBy("_seq").collect()] == [40, 5, 50]
    assert [tuple(r) for r in JsonArraySource(spark, str(tmp_path / "*.json"), "id int").open().orderBy("_seq").collect()] == [(0, 1), (2, 2), (4, 3), (5, 4), (7, 5)]


def test_files_of_a_restarted_step_go_on(spark, tmp_path):
    rows = ints(spark, 1, 2).open().withColumn("_chunk", F.lit(0))
    for make in (lambda: JsonArraySink(str(tmp_path / "x.json")), lambda: LineFileSink(str(tmp_path / "x.txt"), lambda: F.col("value").cast("string"))):
        for restart in (False, False, True):
            sink = make()
            sink.open(restart)
            sink.write(rows, "s", 0)
            sink.close()
    assert json.loads((tmp_path / "x.json").read_text()) == [{"value": 1}, {"value": 2}] * 2 and (tmp_path / "x.txt").read_text().split() == ["1", "2"] * 2


def test_arrow_map_and_partition_handler(spark, repo):
    double = ArrowMap(lambda b: pa.RecordBatch.from_arrays([b.column("_seq"), pc.multiply(b.column("value"), 2)], ["_seq", "value"]), "_seq long, value int")
    assert [r["value"] for r in double.apply(ints(spark, 1, 3).open()).orderBy("_seq").collect()] == [2, 4, 6]

    class Backwards(PartitionHandler):
        def handle(self, run, parts, parallel):
            return [run(x) for x in reversed(list(parts.items()))]

    seen: list[str] = []

    def worker(name, context):
        return TaskletStep(repo, name, lambda step: seen.append(step.step_name) or Repeat.FINISHED)

    assert run(repo, PartitionedStep(repo, "p", worker, RangePartitioner(1, 9), 3, handler=Backwards())).status == Status.COMPLETED
    assert seen == ["p:partition2", "p:partition1", "p:partition0"]


def test_schema_versions(tmp_path):
    path = str(tmp_path / "jobs.db")
    old = sqlite3.connect(path)
    old.executescript(MIGRATIONS[0] + "insert into job_instances (job_name, parameters_json) values ('j', '{}');")  # made before versions were kept
    old.close()
    for _ in range(2):
        repository = Repository(path)
        assert repository.instance("j", Parameters()).id == 1
        repository.close()
    db = sqlite3.connect(path)
    assert db.execute("pragma user_version").fetchone()[0] == len(MIGRATIONS)
    db.execute("pragma user_version = 99")
    db.close()
    with pytest.raises(ValueError):
        Repository(path)
