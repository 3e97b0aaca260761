"""``python -m millrace.plans.cli --repository FILE jobs | executions JOB | steps ID | rerun ID``."""

from __future__ import annotations

import argparse
import sys
from datetime import datetime

from millrace.model import Parameters, Status
from millrace.plans.repository import Repository


def duration(start: str, end: str | None) -> str:
    if end is None:
        return "-"
    s = int((datetime.fromisoformat(end) - datetime.fromisoformat(start)).total_seconds())
    return f"{s // 3600:02d}:{s % 3600 // 60:02d}:{s % 60:02d}"


def stamp(at: str | None) -> str:
    return "-" if at is None else datetime.fromisoformat(at).strftime("%Y-%m-%d %H:%M:%S")


def shown(parameters: str) -> str:
    return ", ".join(f"{k}={v}" for k, v in sorted(Parameters.parse(parameters).items())) or "(none)"


def table(head: list[str], rows: list[list[object]]) -> str:
    cells = [head, *[["" if v is None else str(v) for v in r] for r in rows]]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, width, strict=True)).rstrip() for r in cells)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="millrace")
    parser.add_argument("--repository", required=True, help="the SQLite file of the job repository")
    commands = parser.add_subparsers(dest="command", required=True)
    commands.add_parser("jobs")
    commands.add_parser("executions").add_argument("job")
    commands.add_parser("steps").add_argument("execution", type=int)
    rerun = commands.add_parser("rerun")
    rerun.add_argument("execution", type=int)
    rerun.add_argument("--yes", action="store_true", help="do not ask")
    a = parser.parse_args(argv)
    repository = Repository(a.repository)
    run = lambda sql, *v: repository._run(sql, *v).fetchall()
    if a.command == "jobs":
        rows = run("select i.id, i.job_name, i.parameters_json, e.status, e.start_time, e.end_time from job_instances i left join job_executions e on e.id = (select max(id) from job_executions where job_instance_id = i.id) order by i.id")
        print(table(["Id", "Job", "Parameters", "Status", "Started", "Ended"], [[r[0], r[1], shown(r[2]), r[3] or "-", stamp(r[4]), stamp(r[5])] for r in rows]))
    elif a.command == "executions":
        rows = run("select e.* from job_executions e join job_instances i on i.id = e.job_instance_id where i.job_name = ? order by e.id desc", a.job)
        print(table(["Id", "Status", "Started", "Ended", "Duration", "Failure"], [[r["id"], r["status"], stamp(r["start_time"]), stamp(r["end_time"]), duration(r["start_time"], r["end_time"]), r["failure_message"]] for r in rows]))
    elif a.command == "steps":
        rows = run("select * from step_executions where job_execution_id = ? order by id", a.execution)
        print(table(["Id", "Step", "Status", "Read", "Written", "Skipped", "Rolled back", "Duration"], [[r["id"], r["step_name"], r["status"], r["read_count"], r["write_count"], r["skip_count"], r["rollback_count"], duration(r["start_time"], r["end_time"])] for r in rows]))
    else:
        found = repository.job_execution(a.execution)
        if found is None or found.status != Status.FAILED:
            print(f"execution {a.execution} " + ("does not exist" if found is None else f"is {found.status}, not Failed"), file=sys.stderr)
            return 1
        if not a.yes and input(f"Abandon execution {a.execution} of {found.instance.job_name}? [y/N] ").strip().lower() != "y":
            return 1
        if not repository.abandon(a.execution):
            print("the execution has changed meanwhile", file=sys.stderr)
            return 1
        print(f"execution {a.execution} is abandoned; the next launch starts afresh")
    return 0


if __name__ == "__main__":
    sys.exit(main())
