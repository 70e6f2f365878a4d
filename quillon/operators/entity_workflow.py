"""Workflows whose tasks are properties of entities.

A task is run for the distinct entities of a column, as a job of a workflow: its result is saved under a digest of the
entities and inputs, and read when the same is asked again. Kinds: `entity` gives a Column from the entity's Column;
`multiple` a table of entity and value from the table of entities, for all at once; `list` whatever it makes of the
list as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import quoted
from .entity import Entity
from .workflow import Input, Job, Workflow

KINDS = ("entity", "multiple", "list")


@dataclass
class EntityWorkflow:
    """annotations: inputs that every task has, as they belong to the entities (a namespace, an organism)."""

    entity: Entity
    folder: str
    annotations: Sequence[Input] = ()
    kinds: dict[str, str] = field(default_factory=dict)
    lists: dict[str, DataFrame] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.workflow = Workflow(self.entity.name)

    def task(self, kind: str = "entity", inputs: Sequence[Input] = (), alias: str | None = None) -> Callable:
        """Registers run(entities, **inputs), entities being a Column (kind entity) or a DataFrame of a column `entity`. A property
        of the entity may be used in it by Entity.with_property."""
        if kind not in KINDS:
            raise ValueError(f"{kind!r} is none of {KINDS}")

        def add(run: Callable) -> Callable:
            def job(spark: SparkSession, given: dict):
                values = {k: v for k, v in given.items() if k != "entities"}
                listed = self.lists[given["entities"]]
                if kind == "entity":
                    return listed.select("entity", run(F.col("entity"), **values).alias("value"))
                return run(listed, **values)

            job.__name__ = alias or run.__name__
            self.kinds[job.__name__] = kind
            self.workflow.task([Input("entities", str, required=True), *self.annotations, *inputs])(job)
            return run

        return add

    def job(self, entities: DataFrame | Sequence[str], task: str, **inputs) -> Job:
        """The job of a task for the distinct entities; a DataFrame's first column holds them."""
        spark = SparkSession.active()
        df = entities if isinstance(entities, DataFrame) else spark.createDataFrame([(e,) for e in entities], "entity string")
        df = df.select(quoted(df.columns[0]).cast("string").alias("entity")).filter("entity is not null").distinct()
        mark = df.agg(F.count("*"), F.sum(F.xxhash64("entity").cast("decimal(38,0)")), F.bit_xor(F.crc32("entity"))).first()
        name = "-".join(str(x) for x in mark)
        self.lists[name] = df
        return self.workflow.job(spark, self.folder, task, entities=name, **inputs)

    def of_list(self, entities: DataFrame | Sequence[str], task: str, **inputs):
        return self.job(entities, task, **inputs).run()

    def with_property(self, df: DataFrame, column: str, task: str, name: str | None = None, **inputs) -> DataFrame:
        """df with the value of an `entity` or `multiple` task for each entity of a column."""
        if self.kinds[task] == "list":
            raise ValueError(f"{task} is about whole lists")
        found = self.job(df.select(quoted(column)), task, **inputs).run().select(F.col("entity").alias("__e"), F.col("value").alias(name or task))
        return df.join(found, quoted(column).cast("string") == F.col("__e"), "left").drop("__e")
