"""A registry of relations and its query language.

Rules are lines like

    Miki parents ?p - 'Type of parent=father'
    ?who =people 001, 002
    ?x = a, b
    ?set{
      ?set brothers Miki
    }

A match rule reads `source relation target [- conditions]`; ends are entities, variables (?v) or saved lists
(:name). The relation may be a variable, which goes over all relations, and may name a knowledge base that this one includes:
`relation@base`, `relation@?base` (all that have it), `?relation@base`, `?relation@?base`; variables mean the names. Each rule keeps the edges that fit what its variables may be so far; a variable then means the
ends it met. Earlier rules are not narrowed again: assignments are those sets, and paths are the
combinations that agree in all rules. Rules without a variable in common combine freely, so each connected group of
rules has a table of paths of its own, and their product is never made.
"""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import KeyedTable, in_namespace, quoted
from ..sources.store import delete, exists, load, names_in, save, write_text
from . import graph
from .enrichment import enrichment
from .entity import typed
from .filters import info_condition
from .joins import join_in_cells
from .translate import NoPath, translate_column, translation_index

Source = KeyedTable | Callable[[], KeyedTable] | str


@dataclass
class Relation:
    source: Source
    options: dict
    table: KeyedTable | None = None
    edges: DataFrame | None = None
    stored: graph.EdgeStore | None = None


@dataclass
class Answer:
    """assignments: a one-column DataFrame (entity) a variable. groups: for each connected group of rules a table
    with a column a variable; paths: that table if there is one group, else None."""

    assignments: dict[str, DataFrame]
    groups: list[DataFrame]
    paths = property(lambda self: self.groups[0] if len(self.groups) == 1 else None)


@dataclass
class KnowledgeBase:
    spark: SparkSession
    namespace: str | None = None
    relations: dict[str, Relation] = field(default_factory=dict)
    identifiers: dict[str, list[KeyedTable]] = field(default_factory=dict)
    lists: dict[str, DataFrame] = field(default_factory=dict)
    #: Where lists are written; without it they last as long as this object.
    folder: str | None = None
    #: Options of the entities of an end, by its name; see typed_edges().
    entity_options: dict[str, dict] = field(default_factory=dict)
    others: dict[str, KnowledgeBase] = field(default_factory=dict)

    def include(self, name: str, other: KnowledgeBase) -> None:
        """Another knowledge base whose relations rules may name as relation@name."""
        self.others[name] = other

    def typed_edges(self, name: str) -> DataFrame:
        """The edges of a relation, its ends typed as entities of what they are, with the namespace and the options of that entity."""
        out, info = self.index(name), self.info(name)
        for end in ("source", "target"):
            spec = graph.field_spec(self.relations[name].options.get(end))
            entity = spec[2] or spec[1] or info[end]
            out = typed(out, end, entity, **({"namespace": self.namespace} if self.namespace else {}) | self.entity_options.get(entity, {}))
        return out

    def register(self, name: str, table: Source, identifiers: Sequence[KeyedTable] = (), description: str = "", **options) -> None:
        """A relation from a table, a function that makes one when first asked for, or the path of a saved one, in which
        NAMESPACE stands for the namespace. options go to graph.edges."""
        if isinstance(table, str):
            path = in_namespace(table, self.namespace)
            table = lambda: load(self.spark, path)
        self.relations[name] = Relation(table, options | {"description": description})
        self.identifiers[name] = list(identifiers)

    def table(self, name: str) -> KeyedTable:
        r = self.relations[name]
        if r.table is None:
            r.table = r.source() if callable(r.source) else r.source
        return r.table

    def index(self, name: str) -> DataFrame:
        """The edges of a relation."""
        r = self.relations[name]
        if r.edges is None:
            r.edges = graph.edges(self.table(name), identifiers=self.identifiers[name], **{k: v for k, v in r.options.items() if k != "description"})
        return r.edges

    def info(self, name: str) -> dict:
        r, t = self.relations[name], self.table(name)
        first, second = graph.end_fields(t, graph.field_spec(r.options.get("source"))[0], graph.field_spec(r.options.get("target"))[0])
        return {"source": first, "target": second, "undirected": bool(r.options.get("undirected", first == second)), "fields": [c for c in self.index(name).columns if c not in ("source", "target")], "description": r.options["description"]}

    def describe(self) -> str:
        """The registry as Markdown."""
        lines = [f"# {self.namespace or 'Knowledge base'}", ""]
        for name in self.relations:
            i = self.info(name)
            lines += [f"## {name}", "", f"{i['source']} to {i['target']}" + (", undirected" if i["undirected"] else ""), *([i["description"]] if i["description"] else []), ""]
        return "\n".join(lines)

    def take_descriptions(self, readme: str) -> str:
        """Describes relations from a README: `# Relation` heads a section, in any case. The text before the first section,
        which describes the whole, is returned. Descriptions given at registration stay."""
        head, *sections = re.split(r"^# *", readme, flags=re.MULTILINE)
        found = {title.strip().lower(): text.strip() for title, _, text in (s.partition("\n") for s in sections)}
        for name, r in self.relations.items():
            r.options["description"] = r.options["description"] or found.get(name.lower(), "")
        return head.strip()

    def _list_path(self, name: str) -> str:
        return f"{self.folder.rstrip('/')}/lists/{name}"

    def save_list(self, name: str, entities: DataFrame | Sequence[str], entity: str | None = None) -> None:
        """entity: what the members are, kept as the column's metadata."""
        df = entities if isinstance(entities, DataFrame) else self.spark.createDataFrame([(e,) for e in entities], "entity string")
        df = df.select(F.col(df.columns[0]).cast("string").alias("entity"))
        df = df.withMetadata("entity", {"entity": entity}) if entity else df
        if self.folder:
            df.write.mode("overwrite").parquet(self._list_path(name))
            df = self.spark.read.parquet(self._list_path(name))
        self.lists[name] = df

    def load_list(self, name: str) -> DataFrame:
        if name not in self.lists:
            if name not in self.list_names():
                raise KeyError(f"no list {name!r}")
            self.lists[name] = self.spark.read.parquet(self._list_path(name))
        return self.lists[name]

    def list_names(self) -> list[str]:
        saved = names_in(self.spark, f"{self.folder.rstrip('/')}/lists") if self.folder else []
        return sorted({*self.lists, *saved})

    def delete_list(self, name: str) -> None:
        self.lists.pop(name, None)
        if self.folder:
            delete(self.spark, self._list_path(name))

    def identify(self, name: str, entities: DataFrame, end: str) -> DataFrame:
        """entities in the naming that a relation's end uses; unresolved ones stay as they are."""
        r = self.relations[name]
        wanted = graph.field_spec(r.options.get(end))[2]
        wanted = wanted or self.info(name)[end]
        try:
            found = translation_index(self.identifiers[name], None, wanted)
        except NoPath:
            return entities
        return translate_column(entities, "entity", found, fallback=True)

    def all(self, name: str) -> DataFrame:
        return self.index(name)

    def subset(self, name: str, source: DataFrame | Sequence[str] | None = None, target: DataFrame | Sequence[str] | None = None) -> DataFrame:
        return graph.subset(self.index(name), source, target, self.info(name)["undirected"])

    def keep_edges(self, name: str, path: str, files: int | None = None) -> graph.EdgeStore:
        """Save a relation's edges by both ends, or open them if they are there; look-ups read them from then on."""
        there = exists(self.spark, f"{path}/edges.json")
        stored = graph.EdgeStore(self.spark, path) if there else graph.EdgeStore.save(self.index(name), path, self.info(name)["undirected"], files)
        self.relations[name].stored = stored
        return stored

    def children(self, name: str, entities: Sequence[str] | str | DataFrame) -> DataFrame:
        stored = self.relations[name].stored
        return stored.children(entities) if stored else graph.children(self.index(name), entities)

    def parents(self, name: str, entities: Sequence[str] | str | DataFrame) -> DataFrame:
        stored = self.relations[name].stored
        return stored.parents(entities) if stored else graph.parents(self.index(name), entities)

    def neighbours(self, name: str, entities: Sequence[str] | str | DataFrame) -> DataFrame:
        stored = self.relations[name].stored
        return stored.neighbours(entities) if stored else graph.neighbours(self.index(name), entities, self.info(name)["undirected"])

    def enrichment(self, name: str, entities: Sequence[str] | DataFrame) -> DataFrame:
        """How surprisingly often the targets of a relation go with entities, which are first put in the naming of its sources."""
        df = entities if isinstance(entities, DataFrame) else self.spark.createDataFrame([(str(e),) for e in entities], "entity string")
        return enrichment(self.index(name), self.identify(name, df.select(F.col(df.columns[0]).cast("string").alias("entity")), "source"))

    def query(self, name: str, text: str) -> DataFrame:
        """'e' all edges at e, 'e~' its children, '~e' its parents, 's~t' one pair."""
        source, tilde, target = text.partition("~")
        if not tilde:
            return self.neighbours(name, source)
        if not target:
            return self.children(name, source)
        return self.parents(name, target) if not source else self.subset(name, [source], [target])

    def traverse(self, rules: Sequence[str] | str, with_paths: bool = True) -> Answer:
        lines = [r.strip() for r in (rules.splitlines() if isinstance(rules, str) else rules) if r.strip()]
        return _Traversal(self).run(lines, with_paths)

    def to_json(self) -> str:
        """The registry's names and options."""
        return json.dumps({"namespace": self.namespace, "relations": {n: r.options for n, r in self.relations.items()}, "lists": self.list_names(), "entities": self.entity_options}, sort_keys=True)

    def save(self, folder: str) -> None:
        """All tables, lists and options, for open_knowledge()."""
        folder = folder.rstrip("/")
        for name in self.relations:
            save(self.table(name), f"{folder}/tables/{name}", "overwrite")
            for i, t in enumerate(self.identifiers[name]):
                save(t, f"{folder}/identifiers/{name}/{i}", "overwrite")
        for name in self.list_names():
            if self.folder != folder:
                self.load_list(name).write.mode("overwrite").parquet(f"{folder}/lists/{name}")
        registry = json.loads(self.to_json()) | {"identifiers": {n: len(ts) for n, ts in self.identifiers.items()}}
        write_text(self.spark, f"{folder}/registry.json", json.dumps(registry, sort_keys=True))


def open_knowledge(spark: SparkSession, folder: str) -> KnowledgeBase:
    """What save() wrote; its lists stay in that folder."""
    folder = folder.rstrip("/")
    registry = json.loads(spark.read.text(f"{folder}/registry.json", wholetext=True).first()[0])
    kb = KnowledgeBase(spark, registry["namespace"], folder=folder, entity_options=registry.get("entities", {}))
    for name, options in registry["relations"].items():
        kb.register(name, partial(load, spark, f"{folder}/tables/{name}"), [load(spark, f"{folder}/identifiers/{name}/{i}") for i in range(registry["identifiers"][name])], **options)
    return kb


ASSIGN = re.compile(r"(\?\w+)\s*=(\S*)\s+(.+)")
BLOCK = re.compile(r"(\?\w+)\s*\{")
MATCH = re.compile(r"(\S+)\s+(\S+)\s+(\S+)(?:\s+-\s+(.+))?")


class _Traversal:
    def __init__(self, kb: KnowledgeBase):
        self.kb, self.bound, self.steps = kb, {}, []

    def _one(self, entities: Sequence[str]) -> DataFrame:
        return self.kb.spark.createDataFrame([(e,) for e in entities], "entity string")

    def _assign(self, name: str, relation: str, values: str) -> None:
        parts = []
        for v in (x.strip() for x in values.split(",")):
            parts.append(self.bound[v] if v in self.bound else self.kb.load_list(v[1:]) if v.startswith(":") else self._one([v]))
        found = reduce(lambda a, b: a.unionByName(b), parts)
        if relation:
            found = self.kb.identify(relation, found, "source").unionByName(self.kb.identify(relation, found, "target"))
        self.bound[name] = found.distinct()

    def _end(self, kb: KnowledgeBase, e: DataFrame, relation: str, end: str, term: str) -> DataFrame:
        if term.startswith("?"):
            if term not in self.bound:
                return e
            wanted = self.bound[term]
        elif term.startswith(":"):
            wanted = kb.identify(relation, self.kb.load_list(term[1:]), end)
        else:
            wanted = kb.identify(relation, self._one([term]), end)
        wanted = wanted.select(F.col("entity").alias("__e")).distinct()
        return e.join(wanted, F.col(end) == F.col("__e"), "left_semi")

    def _named(self, relation: str) -> list[tuple[str, str, KnowledgeBase]]:
        """Name, base and knowledge base of all relations that a term means."""
        wanted, _, base = relation.partition("@")
        bases = {"": self.kb} if not base else self.kb.others if base.startswith("?") else {base: self.kb.others[base]}
        found = [(n, b, kb) for b, kb in sorted(bases.items()) for n in kb.relations if wanted.startswith("?") or n == wanted]
        if not found:
            raise KeyError(f"no relation {relation!r}")
        return found

    def _match(self, source: str, relation: str, target: str, conditions: str | None) -> None:
        parts, named = [], self._named(relation)
        asked = [c.partition("=") for c in shlex.split(conditions or "")]
        for name, base, kb in named:
            e = kb.index(name)
            if missing := [f for f, *_ in asked if f not in e.columns]:
                if len(named) > 1:
                    continue  # some other relation may have the field
                raise KeyError(f"{relation!r} has no field {missing[0]!r}")
            for fname, equals, value in asked:
                e = e.filter(info_condition(fname, value if equals else None))
            e = self._end(kb, self._end(kb, e, name, "source", source), name, "target", target)
            parts.append(e.select("source", "target", F.lit(name).alias("relation"), F.lit(base).alias("base")))
        if not parts:
            raise KeyError(f"{relation!r} has none of the fields {[f for f, *_ in asked]}")
        found = reduce(lambda a, b: a.unionByName(b), parts).distinct()
        if source == target and source.startswith("?"):
            found = found.filter("source = target")
        wanted, _, base = relation.partition("@")
        columns = {t: c for c, t in (("source", source), ("target", target), ("relation", wanted), ("base", base)) if t.startswith("?")}
        for term, c in columns.items():
            if c in ("relation", "base") and term in self.bound:
                found = found.join(self.bound[term].select(F.col("entity").alias("__e")).distinct(), F.col(c) == F.col("__e"), "left_semi")
        for term, c in columns.items():
            self.bound[term] = found.select(F.col(c).alias("entity")).distinct()
        self.steps.append(found.select(*[F.col(c).alias(t) for t, c in columns.items()] or [F.lit(True).alias("__met")]).distinct())

    def run(self, lines: list[str], with_paths: bool) -> Answer:
        i = 0
        while i < len(lines):
            line = lines[i]
            if m := BLOCK.fullmatch(line):
                depth, start = 1, i + 1
                while depth:
                    i += 1
                    depth += bool(BLOCK.fullmatch(lines[i])) - (lines[i] == "}")
                inner = _Traversal(self.kb)
                inner.bound = dict(self.bound)
                self.bound[m[1]] = inner.run(lines[start:i], False).assignments[m[1]]
            elif m := ASSIGN.fullmatch(line):
                self._assign(m[1], m[2], m[3])
            elif m := MATCH.fullmatch(line):
                self._match(*m.groups())
            else:
                raise ValueError(f"{line!r} is no rule")
            i += 1
        return Answer(self.bound, self._groups() if with_paths else [])

    def _groups(self) -> list[DataFrame]:
        """The natural join of each connected group of rules, columns in the order in which rules name them. A rule without variables is a condition on all groups: it has
        one row or none. A rule whose variables another one has, too, is a condition on that one. The others are joined from the last, as each has been
        narrowed to what earlier ones left. They are sets, so their join is one without a look at its rows."""
        facts = [s for s in self.steps if s.columns == ["__met"]]
        todo, groups = [s for s in self.steps if s.columns != ["__met"]], []
        columns = list(dict.fromkeys(c for s in todo for c in s.columns))
        for i in sorted(range(len(todo)), key=lambda i: len(todo[i].columns)):
            wider = [k for k, s in enumerate(todo) if k != i and s is not None and set(todo[i].columns) <= set(s.columns)]
            for k in wider:
                todo[k] = todo[k].join(todo[i], todo[i].columns, "left_semi")
            todo[i] = None if wider else todo[i]
        todo = [s for s in todo if s is not None]
        while todo:
            joined = [left := todo.pop()]
            while (nth := next((k for k in reversed(range(len(todo))) if set(todo[k].columns) & set(left.columns)), None)) is not None:
                step = todo.pop(nth)
                on = [c for c in step.columns if c in left.columns]
                left = join_in_cells(left, step, on, _counts(joined, on))
                joined.append(step)
            for fact in facts:
                left = left.join(F.broadcast(fact), F.col("__met"), "left_semi")
            groups.append(left.select(*[quoted(c) for c in columns if c in left.columns]))
        return sorted(groups, key=lambda g: columns.index(g.columns[0])) or facts[:1]


def _counts(tables: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """keys, __n: the rows of the natural join of tables for each key, from counts of each table instead of that join. Each table shares a column with those before."""
    found = None
    for i, t in enumerate(tables):
        wanted = {*keys, *(c for later in tables[i + 1 :] for c in later.columns)}
        shared = [c for c in t.columns if i and c in found.columns]
        t = t.groupBy(*[quoted(c) for c in t.columns if c in wanted or c in shared]).agg(F.count("*").cast("double").alias("__m"))
        found = found.join(t, shared) if i else t.withColumn("__n", F.lit(1.0))
        found = found.groupBy(*[quoted(c) for c in found.columns if c in wanted]).agg(F.sum(F.col("__n") * F.col("__m")).alias("__n"))
    return found


def edge_table(kb: KnowledgeBase, name: str) -> DataFrame:
    return graph.pair_names(kb.index(name))
