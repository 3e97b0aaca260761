"""Jobs: steps in sequence, or a validated flow with transitions; launcher and host."""

from __future__ import annotations

import logging
import signal
import threading
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import timedelta
from enum import Enum

from millrace.model import JobExecution, Parameters, Status, now
from millrace.plans.repository import Lock, NoLock, Repository
from millrace.plans.steps import Step, Stop
from millrace.plans.telemetry import TELEMETRY

log = logging.getLogger("millrace")


class JobListener:
    """Called around a job; override what is wanted."""

    def before_job(self, execution: JobExecution) -> None: ...

    def after_job(self, execution: JobExecution) -> None: ...


class Job:
    """``execute`` makes an execution of its own, or goes on with the launcher's."""

    name: str
    repository: Repository
    listeners: Sequence[JobListener] = ()

    def execute(self, parameters: Parameters | None = None, execution: JobExecution | None = None) -> JobExecution:
        parameters = parameters or Parameters()
        if execution is None:
            previous = self.repository.last_job_execution(self.name, parameters)
            execution = self.repository.create_job_execution(self.repository.instance(self.name, parameters), parameters)
            self.restart(execution, previous)
        execution.status = Status.STARTED
        self.repository.update_job(execution)
        try:
            for x in self.listeners:
                x.before_job(execution)
            with TELEMETRY.span("job", job=self.name):
                self.run(execution)
        except Exception as e:
            execution.status, execution.failure, execution.failure_message = Status.FAILED, e, str(e)[:4000]
        execution.end_time = now()
        self.repository.update_job(execution)
        for x in self.listeners:
            x.after_job(execution)
        TELEMETRY.add("jobs.failed" if execution.status == Status.FAILED else "jobs.completed" if execution.status == Status.COMPLETED else "jobs.stopped")
        return execution

    def restart(self, execution: JobExecution, previous: JobExecution | None) -> None:
        """A run after a failed or stopped one goes on where that ended."""
        if previous is not None and previous.status in (Status.FAILED, Status.STOPPED):
            execution.restarted_from, execution.status = previous.id, Status.RESTARTED
            self.repository.update_job(execution)

    def run(self, execution: JobExecution) -> None:
        raise NotImplementedError


class SequentialJob(Job):
    def __init__(self, name: str, repository: Repository, steps: list[Step], listeners: Sequence[JobListener] = ()):
        self.name, self.repository, self.steps, self.listeners = name, repository, steps, listeners

    def run(self, execution: JobExecution) -> None:
        for step in self.steps:
            if execution.restarted_from is not None:
                last = self.repository.last_step_execution(execution.restarted_from, step.name)
                if last is not None and last.status == Status.COMPLETED:
                    done = self.repository.create_step_execution(execution, step.name)  # stays on record for the next restart
                    done.copy_counts(last)
                    done.context, done.status, done.end_time = last.context, Status.COMPLETED, now()
                    self.repository.update_step(done)
                    continue
            result = step.execute(execution)
            if result.status == Status.FAILED:
                execution.status, execution.failure, execution.failure_message = Status.FAILED, result.failure, result.failure_message
                return
            if result.status == Status.STOPPED:
                execution.status = Status.STOPPED
                return
        execution.status = Status.COMPLETED


class JobBuilder:
    def __init__(self, name: str, repository: Repository):
        self._name, self._repository, self._steps, self._listeners = name, repository, [], []

    def step(self, step: Step) -> JobBuilder:
        self._steps.append(step)
        return self

    def listener(self, *listeners: JobListener) -> JobBuilder:
        self._listeners += listeners
        return self

    def build(self) -> SequentialJob:
        return SequentialJob(self._name, self._repository, list(self._steps), list(self._listeners))


class Action(Enum):
    CONTINUE = "Continue"
    END = "End"
    FAIL = "Fail"
    STOP = "Stop"


@dataclass
class Rule:
    on: str
    action: Action
    to: Step | None = None


@dataclass
class Transitions:
    rules: list[Rule] = field(default_factory=list)

    def match(self, exit_status: str) -> Rule | None:
        """An exact status before ``*``, then the first."""
        return next((r for want in (exit_status, "*") for r in self.rules if r.on == want), None)


def exit_status(status: Status) -> str:
    return status.value.upper()


class FlowError(RuntimeError):
    """A flow that cannot work, or has no rule for what happened."""


class FlowJob(Job):
    def __init__(self, name: str, repository: Repository, start: Step, rules: dict[Step, Transitions], stop: Stop | None = None, most: int | None = None):
        self.name, self.repository, self.start, self.rules, self.stop, self.most = name, repository, start, rules, stop, most

    def run(self, execution: JobExecution) -> None:
        step, turns = self.start, 0
        while True:
            if self.stop is not None and self.stop.requested:
                execution.status = Status.STOPPED
                return
            turns += 1
            if self.most is not None and turns > self.most:
                raise FlowError(f"more than {self.most} steps")
            result = step.execute(execution)
            rule = self.rules[step].match(exit_status(result.status))
            if rule is None:
                raise FlowError(f"no transition from {step.name} on {exit_status(result.status)}")
            if rule.action is Action.CONTINUE:
                step = rule.to
                continue
            execution.status = {Action.END: result.status, Action.FAIL: Status.FAILED, Action.STOP: Status.STOPPED}[rule.action]
            if execution.status == Status.FAILED:
                execution.failure, execution.failure_message = result.failure, result.failure_message
            return


class FlowBuilder:
    """``start(a)``, then ``from_(a).on("COMPLETED").to(b)``, ``.end()``, ``.fail()`` or ``.stop()``."""

    def __init__(self, name: str, repository: Repository):
        self._name, self._repository, self._start, self._rules, self._at, self._on = name, repository, None, {}, None, None

    def start(self, step: Step) -> FlowBuilder:
        if self._start is not None:
            raise FlowError("the start is set already")
        self._start = step
        return self.from_(step)

    def from_(self, step: Step) -> FlowBuilder:
        self._rules.setdefault(step, Transitions())
        self._at, self._on = step, None
        return self

    def on(self, status: str) -> FlowBuilder:
        if self._at is None:
            raise FlowError("on() needs a step")
        self._on = status
        return self

    def _rule(self, action: Action, to: Step | None = None) -> FlowBuilder:
        if self._on is None:
            raise FlowError("a transition needs a status")
        self._rules[self._at].rules.append(Rule(self._on, action, to))
        self._on = None
        return self

    def to(self, step: Step) -> FlowBuilder:
        return self._rule(Action.CONTINUE, step)

    def end(self) -> FlowBuilder:
        return self._rule(Action.END)

    def fail(self) -> FlowBuilder:
        return self._rule(Action.FAIL)

    def stop(self) -> FlowBuilder:
        return self._rule(Action.STOP)

    def transitions(self, step: Step) -> Transitions:
        return self._rules[step]

    def reachable(self) -> set[Step]:
        """Steps that a path of transitions leads to from the start."""
        reached, todo = set(), [self._start]
        while todo:
            step = todo.pop()
            if step not in reached:
                reached.add(step)
                todo += [r.to for r in self._rules[step].rules if r.to is not None]
        return reached

    def build(self, stop: Stop | None = None, most: int | None = None) -> FlowJob:
        if self._start is None:
            raise FlowError("a flow needs a start")
        for step, t in self._rules.items():
            if not t.rules:
                raise FlowError(f"{step.name} has no transitions")
            for r in t.rules:
                if r.to is not None and r.to not in self._rules:
                    raise FlowError(f"{r.to.name} has no transitions")
        reached = self.reachable()
        ends = any(r.to is None for step in reached for r in self._rules[step].rules)
        if lost := [s.name for s in self._rules if s not in reached]:
            raise FlowError(f"not reachable: {', '.join(lost)}")
        if not ends:
            raise FlowError("no reachable transition ends the flow")
        return FlowJob(self._name, self._repository, self._start, dict(self._rules), stop, most)


class AlreadyRunning(RuntimeError):
    """The job runs with these parameters, or its lock is held."""


class Launcher:
    """Guards against a second run, holds the lock, beats, runs, records."""

    def __init__(self, repository: Repository, locks: Repository | NoLock | None = None, heartbeat: timedelta | None = None, silent: timedelta | None = None):
        self.repository, self.locks, self.heartbeat = repository, locks or NoLock(), heartbeat
        self.silent = silent or (heartbeat * 10 if heartbeat else None)

    def launch(self, job: Job, parameters: Parameters | None = None) -> JobExecution:
        parameters = parameters or Parameters()
        if self.silent is not None:
            self.repository.recover(job.name, parameters, self.silent)
        running = self.repository.running_job_execution(job.name, parameters)
        if running is not None:
            raise AlreadyRunning(f"{job.name} runs already: execution {running.id}")
        lock = self.locks.acquire_lock(job.name, parameters)
        if lock is None:
            raise AlreadyRunning(f"{job.name} is locked")
        done = threading.Event()
        beat = None
        try:
            previous = self.repository.last_job_execution(job.name, parameters)
            execution = self.repository.create_job_execution(self.repository.instance(job.name, parameters), parameters)
            job.restart(execution, previous)
            if self.heartbeat is not None:
                beat = threading.Thread(target=self._beat, args=(execution, lock, done), daemon=True)
                beat.start()
            return job.execute(parameters, execution)
        finally:
            done.set()
            if beat is not None:
                beat.join()
            lock.release()

    def _beat(self, execution: JobExecution, lock: Lock | NoLock, done: threading.Event) -> None:
        while not done.wait(self.heartbeat.total_seconds()):
            try:
                execution.last_heartbeat = now()
                self.repository.heartbeat(execution.id)
                lock.renew()
            except Exception:  # a missed beat must not end the job
                log.warning("heartbeat failed", exc_info=True)


class Host:
    """Runs a job in the background; stopping asks its steps to end and waits."""

    def __init__(self, launcher: Launcher, job: Job, stop: Stop, timeout: timedelta = timedelta(seconds=30), cancel: Callable[[], None] | None = None):
        self.launcher, self.job, self.stop_flag, self.timeout, self.cancel = launcher, job, stop, timeout, cancel
        self.result: JobExecution | None = None
        self.error: BaseException | None = None
        self._thread: threading.Thread | None = None

    def start(self) -> None:
        self._thread = threading.Thread(target=self._run, daemon=True)
        self._thread.start()

    def _run(self) -> None:
        try:
            self.result = self.launcher.launch(self.job)
            log.info("%s ended: %s", self.job.name, self.result.status)
        except BaseException as e:
            self.error = e
            log.exception("%s failed", self.job.name)

    def stop(self) -> bool:
        """Whether the job has ended in time; after the timeout ``cancel`` is called."""
        self.stop_flag.request()
        return self.join(self.timeout)

    def join(self, timeout: timedelta | None = None) -> bool:
        if self._thread is None:
            return True
        self._thread.join(None if timeout is None else timeout.total_seconds())
        ended = not self._thread.is_alive()
        if not ended and self.cancel is not None:
            self.cancel()
        return ended

    def on_signals(self) -> None:
        """SIGTERM and SIGINT stop the job."""
        for s in (signal.SIGTERM, signal.SIGINT):
            signal.signal(s, lambda *_: self.stop_flag.request())
