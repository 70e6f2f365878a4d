"""Workflows: tasks that make DataFrames, run once for each set of inputs.

A job is a task with inputs and the jobs it depends on. Its digest names its result; a result that exists
is read, not made again. Results are Parquet (DataFrames) or JSON (anything else), with a record
of status, inputs and times beside them. Paths go through Spark's file systems, so they may be
on any store.
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from graphlib import TopologicalSorter

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Input:
    name: str
    kind: Callable = str
    default: object = None
    required: bool = False


@dataclass
class Task:
    name: str
    run: Callable
    inputs: Sequence[Input] = ()
    deps: Sequence[tuple[str, dict]] = ()
    lazy: bool = False
    may_fail: frozenset[str] = frozenset()


class MissingInput(ValueError):
    """A required input was not given."""


class Failed(RuntimeError):
    """A job ended with an error, which its record holds."""


@dataclass
class Workflow:
    name: str
    tasks: dict[str, Task] = field(default_factory=dict)

    def task(self, inputs: Sequence[Input] = (), deps: Sequence[str | tuple[str, dict]] = (), lazy: bool = False, may_fail: Sequence[str] = ()) -> Callable:
        """Registers run(spark, inputs, *results of deps). A dep may fix inputs of its task; lazy
        results are not written; a dep that may fail has the result None if it does."""
        def add(run: Callable) -> Callable:
            pairs = [(d, {}) if isinstance(d, str) else d for d in deps]
            self.tasks[run.__name__] = Task(run.__name__, run, list(inputs), pairs, lazy, frozenset(may_fail))
            return run

        return add

    def all_inputs(self, name: str) -> dict[str, Input]:
        """Inputs of a task and of all that it depends on, without those that are fixed on the way."""
        task = self.tasks[name]
        found = {i.name: i for i in task.inputs}
        for dep, fixed in task.deps:
            found = {k: v for k, v in self.all_inputs(dep).items() if k not in fixed} | found
        return found

    def job(self, spark: SparkSession, folder: str, task: str, overrides: dict[str, Job] | None = None, **given) -> Job:
        known = self.all_inputs(task)
        if unknown := set(given) - set(known):
            raise ValueError(f"{task} has no inputs {sorted(unknown)}")
        values = {}
        for i in known.values():
            if i.name in given:
                values[i.name] = i.kind(given[i.name])
            elif i.required:
                raise MissingInput(f"{task} needs {i.name}")
            else:
                values[i.name] = i.default
        return self._job(spark, folder.rstrip("/"), task, values, overrides or {}, {})

    def from_json(self, spark: SparkSession, folder: str, saved: str) -> Job:
        x = json.loads(saved)
        return self.job(spark, folder, x["task"], **{k: v for k, v in x["inputs"].items() if k in self.all_inputs(x["task"])})

    def _job(self, spark: SparkSession, folder: str, name: str, values: dict, overrides: dict, made: dict) -> Job:
        if name in overrides:
            return overrides[name]
        task = self.tasks[name]
        own = {i.name: values.get(i.name, i.default) for i in task.inputs}
        deps = [self._job(spark, folder, d, values | fixed, overrides, made) for d, fixed in task.deps]
        job = Job(spark, folder, self.name, task, own, deps)
        return made.setdefault(job.digest, job)


@dataclass
class Job:
    spark: SparkSession
    folder: str
    workflow: str
    task: Task
    inputs: dict
    deps: list[Job]
    result: object = None

    @property
    def digest(self) -> str:
        parts = {"workflow": self.workflow, "task": self.task.name, "inputs": self.inputs, "deps": [d.digest for d in self.deps]}
        return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]

    @property
    def path(self) -> str:
        return f"{self.folder}/{self.workflow}/{self.task.name}-{self.digest}"

    def _fs(self, path: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _write_text(self, path: str, text: str) -> None:
        at, fs = self._fs(path)
        out = fs.create(at, True)
        out.write(bytearray(text.encode()))
        out.close()

    def _read_text(self, path: str) -> str | None:
        at, fs = self._fs(path)
        if not fs.exists(at):
            return None
        rows = self.spark.read.text(path, wholetext=True).collect()  # one small file
        return rows[0][0] if rows else ""

    @property
    def info(self) -> dict:
        return json.loads(self._read_text(f"{self.path}.info") or "{}")

    @property
    def status(self) -> str:
        return self.info.get("status", "waiting")

    @property
    def done(self) -> bool:
        return self.status == "done"

    @property
    def updated(self) -> bool:
        """Done, and no job it depends on ended later."""
        end = self.info.get("end", 0)
        return self.done and all(d.task.lazy or d.task.name in self.task.may_fail or (d.updated and d.info.get("end", 0) <= end) for d in self.deps)

    def clean(self) -> None:
        for p in (self.path, f"{self.path}.json", f"{self.path}.info"):
            at, fs = self._fs(p)
            fs.delete(at, True)
        self.result = None

    def recursive_clean(self) -> None:
        for j in self.order():
            j.clean()

    def step(self, task: str) -> Job:
        return next(j for j in self.order() if j.task.name == task)

    def order(self) -> list[Job]:
        """All jobs this one needs and itself, each after what it depends on."""
        jobs, graph = {}, {}

        def add(job: Job) -> None:
            if job.digest not in jobs:
                jobs[job.digest], graph[job.digest] = job, [d.digest for d in job.deps]
                for d in job.deps:
                    add(d)

        add(self)
        return [jobs[d] for d in TopologicalSorter(graph).static_order()]

    def provenance(self, depth: int = 0) -> str:
        lines = ["  " * depth + f"{self.task.name} {self.digest} {json.dumps(self.inputs, sort_keys=True, default=str)}"]
        return "\n".join(lines + [d.provenance(depth + 1) for d in self.deps])

    def run(self, parallel: int = 1):
        """The result. Jobs that are ready run together, `parallel` at a time."""
        sorter = TopologicalSorter({j.digest: [d.digest for d in j.deps] for j in self.order()})
        jobs = {j.digest: j for j in self.order()}
        users = {d: [j for j in jobs.values() if d in {x.digest for x in j.deps}] for d in jobs}

        def make(digest: str) -> None:
            job = jobs[digest]
            try:
                job._make([jobs[x.digest] for x in job.deps])
            except Failed:
                if not users[digest] or any(job.task.name not in u.task.may_fail for u in users[digest]):
                    raise

        sorter.prepare()
        with ThreadPoolExecutor(parallel) as pool:
            while sorter.is_active():
                ready = sorter.get_ready()
                for digest, _ in zip(ready, pool.map(make, ready), strict=True):
                    sorter.done(digest)
        return jobs[self.digest].result

    def _load(self):
        text = self._read_text(f"{self.path}.json")
        return json.loads(text) if text is not None else self.spark.read.parquet(self.path)

    def _make(self, deps: list[Job]) -> None:
        if not self.task.lazy and self.updated:
            self.result = self._load()
            return
        record = {"task": self.task.name, "inputs": self.inputs, "deps": [d.digest for d in deps], "start": time.time()}
        try:
            result = self.task.run(self.spark, self.inputs, *[d.result for d in deps])
            if self.task.lazy:
                self.result = result
                return
            if isinstance(result, DataFrame):
                result.write.mode("overwrite").parquet(self.path)
            else:
                self._write_text(f"{self.path}.json", json.dumps(result))
            self._write_text(f"{self.path}.info", json.dumps(record | {"status": "done", "end": time.time()}, default=str))
        except Exception as e:
            self._write_text(f"{self.path}.info", json.dumps(record | {"status": "error", "end": time.time(), "error": str(e)[:2000]}, default=str))
            raise Failed(f"{self.task.name}: {e}") from e
        self.result = self._load()

    def to_json(self) -> str:
        """The task and all inputs, from which Workflow.from_json makes an equal job."""
        given = {}
        for j in self.order():
            given |= {k: v for k, v in j.inputs.items() if v is not None}
        return json.dumps({"task": self.task.name, "inputs": given}, sort_keys=True, default=str)

    def trace(self) -> DataFrame:
        """task, start and end of all jobs that were made, for aggregate.trace_summary."""
        infos = [i for j in self.order() if (i := j.info)]
        df = self.spark.createDataFrame([(i["task"], float(i["start"]), float(i["end"])) for i in infos], "task string, s double, e double")
        return df.selectExpr("task", "timestamp_micros(bigint(s * 1e6)) as start", "timestamp_micros(bigint(e * 1e6)) as end")
