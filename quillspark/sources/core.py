"""A core: document tables in immutable generations, with pending writes, commits, deletes and snapshots."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
import threading
import time
import uuid
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import RequestError
from ..functions.analysis import tokens_column
from ..plans.compile import Index, compile_query
from ..plans.grammar import parse_query
from .schema import Field, Schema, build


_folders: dict[str, str] = {}


def work_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``; where that is unset, a temporary one for a local session alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    app = spark.sparkContext.applicationId
    if app not in _folders:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        _folders[app] = "file://" + tempfile.mkdtemp(prefix="quillspark-")
    return _folders[app]


def overwrite(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Old rows whose key is not in the new ones, and the new: the last of each key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def last_of_each(batch: DataFrame, key: str, order: Column) -> DataFrame:
    w = Window.partitionBy(key).orderBy(order)
    return batch.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def delete_keys(old: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return old.join(keys.select(key), key, "left_anti")


def delete_where(old: DataFrame, match: Column) -> DataFrame:
    return old.where(~F.coalesce(match, F.lit(False)))


def copy_fields(df: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """Raw values of each source appended to its destination, an array."""
    for source, dest in rules:
        have = F.coalesce(F.col(dest), F.array().cast("array<string>")) if dest in df.columns else F.array().cast("array<string>")
        df = df.withColumn(dest, F.concat(have, F.when(F.col(source).isNotNull(), F.array(F.col(source))).otherwise(F.array().cast("array<string>"))))
    return df


@dataclass
class Core:
    """Writes wait until ``commit``, which writes a generation and then replaces the pointer to it in one step."""

    spark: SparkSession
    path: Path
    schema: Schema
    auto_docs: int | None = None
    auto_ms: int | None = None
    background: bool = False
    pending: list[tuple[str, object]] = field(default_factory=list)
    waiting: int = 0
    due: float | None = None
    lock: threading.RLock = field(default_factory=threading.RLock)

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: Schema, auto_docs: int | None = None, auto_ms: int | None = None, background: bool = False) -> Core:
        """Commits come after ``auto_docs`` documents or ``auto_ms``; with ``background`` a timer keeps deadlines, else ``tick`` does."""
        core = cls(spark, Path(path), schema, auto_docs, auto_ms, background)
        core.path.mkdir(parents=True, exist_ok=True)
        if core.manifest() is None:
            core._write(core._empty(), 0)
        elif core.manifest()["schema"] != schema.fingerprint():
            raise RequestError("the stored tables were written with another schema")
        return core

    # -------------------------------------------------------------- tables

    def manifest(self) -> dict | None:
        pointer = self.path / "CURRENT"
        return json.loads(pointer.read_text()) if pointer.exists() else None

    def docs(self) -> DataFrame:
        """The committed documents; this frame stays on its generation."""
        return self.spark.read.parquet(str(self.path / self.manifest()["generation"]))

    def index(self, default: str | None = None) -> Index:
        return Index(self.docs(), self.schema, default, self.synonyms())

    def synonyms(self) -> list[list[str]]:
        file = self.path / "synonyms.txt"
        if not file.exists():
            return []
        return [[w.strip() for w in line.split(",")] for line in file.read_text().splitlines() if line.strip() and not line.startswith("#")]

    def set_synonyms(self, groups: list[list[str]]) -> None:
        for g in groups:
            if len(g) < 2 or any(not w.strip() or re.search(r"[\s,]", w) for w in g):
                raise RequestError(f"bad synonym group {g}")
        part = self.path / f".synonyms-{uuid.uuid4().hex}"
        part.write_text("".join(", ".join(g) + "\n" for g in groups))
        os.replace(part, self.path / "synonyms.txt")

    def _struct(self, names: list[str]) -> T.StructType:
        out = [T.StructField("doc_ord", T.LongType()), T.StructField("_version_", T.LongType())]
        return T.StructType([*out, *[T.StructField(n, self.schema.find(n).type) for n in names]])

    def _empty(self) -> DataFrame:
        return self._analyzed(self.spark.createDataFrame([], self._struct(list(self.schema.fields))))

    def _analyzed(self, df: DataFrame) -> DataFrame:
        for name in [c for c in df.columns if not c.endswith("__tokens") and c not in ("doc_ord", "_version_")]:
            f = self.schema.find(name)
            if f.kind == "text":
                c = F.col(f"`{name}`")
                df = df.withColumn(f.tokens, tokens_column(c if f.array else F.when(c.isNotNull(), F.array(c)), f.chain))
            elif f.kind == "payload":
                df = df.withColumn(f.tokens, F.transform(F.col(f"`{name}`"), lambda p: F.struct(p["term"].alias("term"), F.lit(0).alias("pos"))))
        return df

    def _write(self, df: DataFrame, rows: int) -> None:
        name = f"generation-{int(time.time() * 1000)}-{uuid.uuid4().hex[:8]}"
        df.write.parquet(str(self.path / name))
        part = self.path / f".current-{uuid.uuid4().hex}"
        part.write_text(json.dumps({"generation": name, "schema": self.schema.fingerprint(), "written": rows}))
        os.replace(part, self.path / "CURRENT")

    # -------------------------------------------------------------- writes

    def add(self, docs: list[dict], overwrite: bool = True) -> None:
        """Documents before one that is refused stay pending."""
        with self.lock:
            for doc in docs:
                row = build(self.schema, doc)
                if overwrite:
                    self.pending.append(("drop", row[self.schema.unique_key]))
                self.pending.append(("add", row))
                self.waiting += 1
        self._added()

    def add_frame(self, df: DataFrame) -> None:
        """All rows of a frame whose columns are fields, without passing through the driver; of one key any row stays."""
        key = self.schema.unique_key
        unknown = [c for c in df.columns if self.schema.find(c) is None]
        if unknown or key not in df.columns:
            raise RequestError(f"undefined field {unknown[0]}" if unknown else f"{key} is missing")
        rows = df.select(*[F.col(f"`{c}`").cast(self.schema.find(c).type).alias(c) for c in df.columns]).dropDuplicates([key])
        for source, dest in self.schema.copies:
            if source in rows.columns:
                value = F.col(f"`{source}`") if dest not in rows.columns else F.coalesce(F.col(f"`{dest}`"), F.col(f"`{source}`"))
                kind = self.schema.find(dest).type
                rows = rows.withColumn(dest, value.cast(kind) if kind == rows.schema[source].dataType else F.array(value).cast(kind))
        with self.lock:
            self.pending.append(("frame", rows))
            self.waiting += 1
        self._added()

    def _added(self) -> None:
        if self.auto_docs and self.waiting >= self.auto_docs:
            self.commit()
        elif self.auto_ms is not None and self.pending:
            self.commit_within(self.auto_ms)

    def delete_ids(self, ids: list[str]) -> None:
        self.pending += [("drop", i) for i in ids]

    def delete_query(self, text: str, default: str | None = None) -> None:
        self.pending.append(("query", (parse_query(text), default)))

    def commit_within(self, ms: int) -> None:
        """A deadline, which only ever moves forward in time to an earlier one; ``tick`` keeps it."""
        due = time.time() + ms / 1000
        self.due = due if self.due is None else min(self.due, due)
        if self.background:
            timer = threading.Timer(max(0.0, self.due - time.time()) + 0.01, self.tick)
            timer.daemon = True
            timer.start()

    def tick(self) -> bool:
        with self.lock:
            if self.due is not None and time.time() >= self.due:
                self.commit()
                return True
        return False

    def commit(self) -> None:
        """Apply pending writes in their order, as few table operations as that allows, and publish the result."""
        with self.lock:
            self._commit()

    def _commit(self) -> None:
        if not self.pending:
            self.due = None
            return
        key, df = self.schema.unique_key, self.docs()
        top = df.agg(F.max("doc_ord"), F.max("_version_")).first()
        order, version = (top[0] if top[0] is not None else -1) + 1, max(top[1] or 0, int(time.time() * 1000) << 20) + 1
        drops: set[str] = set()
        adds: list[dict] = []

        def settle() -> None:
            nonlocal df, drops, adds
            if drops:
                gone = self.spark.createDataFrame([(d,) for d in sorted(drops)], f"`{key}` string")
                df = delete_keys(df, gone, key)
            if adds:
                names = sorted({n for a in adds for n in a if n not in ("doc_ord", "_version_")} | set(self.schema.fields))
                new = self._analyzed(self.spark.createDataFrame([tuple(a.get(n) for n in ("doc_ord", "_version_", *names)) for a in adds], self._struct(names)))
                df = df.unionByName(new, allowMissingColumns=True)
            drops, adds = set(), []

        for what, value in self.pending:
            if what == "drop":
                adds = [a for a in adds if a[key] != value]
                drops.add(value)
            elif what == "add":
                adds.append(value | {"doc_ord": order, "_version_": version})
                order, version = order + 1, version + 1
            elif what == "frame":
                settle()
                df = delete_keys(df, value.select(key), key)
                at = F.monotonically_increasing_id()
                df = df.unionByName(self._analyzed(value.withColumns({"doc_ord": at + order, "_version_": at + version})), allowMissingColumns=True)
                order, version = order + (value.rdd.getNumPartitions() << 33), version + (value.rdd.getNumPartitions() << 33)
            else:
                settle()
                index = Index(df, self.schema, value[1])
                df = delete_where(df, compile_query(index, value[0]).match)
        settle()
        self._write(df, self.waiting)
        self.pending, self.waiting, self.due = [], 0, None

    def update(self, body: str, params: dict | None = None) -> None:
        """An update message: an array of documents, or an object of commands whose keys may repeat, in their order."""
        params = params or {}
        try:
            commands = json.loads(body, object_pairs_hook=lambda pairs: pairs)
        except ValueError as e:
            raise RequestError(f"bad JSON: {e}") from None
        plain = lambda x: {k: plain(v) for k, v in x} if isinstance(x, list) and x and all(isinstance(p, tuple) for p in x) else [plain(v) for v in x] if isinstance(x, list) else x
        steps = []
        if body.lstrip().startswith("["):
            steps = [("add", [plain(d) for d in commands], True)]
        else:
            for name, value in commands:
                value = plain(value)
                if name == "add":
                    if not isinstance(value, dict) or not isinstance(value.get("doc"), dict):
                        raise RequestError("add needs a doc")
                    steps.append(("add", [value["doc"]], value.get("overwrite", True)))
                elif name == "delete":
                    if isinstance(value, dict) and "query" in value:
                        steps.append(("query", value["query"], None))
                    elif isinstance(value, dict) and "id" in value:
                        steps.append(("ids", [value["id"]], None))
                    elif isinstance(value, (list, str)):
                        steps.append(("ids", value if isinstance(value, list) else [value], None))
                    else:
                        raise RequestError("delete needs an id or a query")
                elif name == "commit":
                    steps.append(("commit", None, None))
                else:
                    raise RequestError(f"unknown command {name}")
        for what, value, extra in steps:
            if what == "add":
                self.add(value, extra and params.get("overwrite", "true") != "false")
            elif what == "ids":
                self.delete_ids([str(v) for v in value])
            elif what == "query":
                self.delete_query(value)
            else:
                self.commit()
        if params.get("commit") == "true" or params.get("softCommit") == "true":
            self.commit()
        elif "commitWithin" in params:
            self.commit_within(int(params["commitWithin"]))

    # -------------------------------------------------------------- upkeep

    def snapshot(self, to: str) -> None:
        """One committed generation, copied to a fresh folder and published there last."""
        target, manifest = Path(to), self.manifest()
        if target.exists() and any(target.iterdir()):
            raise RequestError("a snapshot needs a fresh folder")
        target.mkdir(parents=True, exist_ok=True)
        shutil.copytree(self.path / manifest["generation"], target / manifest["generation"])
        part = target / ".current"
        part.write_text(json.dumps(manifest))
        os.replace(part, target / "CURRENT")

    def compact(self, files: int = 1) -> None:
        """Rewrite the current generation in fewer files, in document order."""
        self._write(self.docs().repartitionByRange(files, "doc_ord").sortWithinPartitions("doc_ord"), 0)

    def info(self) -> dict:
        return {"name": self.schema.name, "numDocs": self.docs().count(), "generation": self.manifest()["generation"], "fields": sorted(self.schema.fields)}


@dataclass
class TableCore:
    """A read-only core over a table that has the fields' columns, their terms (``field__terms``) and doc_ord."""

    schema: Schema
    table: DataFrame

    def index(self, default: str | None = None) -> Index:
        return Index(self.table, self.schema, default)


def stored(schema: Schema, columns: list[str], wanted: str | None) -> list[Field]:
    """Stored fields that the list of names and patterns asks for, in the schema's order, dynamic ones last."""
    names = [n for n in re.split(r"[,\s]+", wanted) if n and "(" not in n] if wanted else ["*"]
    known = [f for n, f in schema.fields.items() if n in columns] + sorted((schema.find(c) for c in columns if c not in schema.fields and not c.endswith(("__tokens", "__terms")) and c not in ("doc_ord", "_version_")), key=lambda f: f.name)
    patterns = [re.compile("".join(".*" if c == "*" else re.escape(c) for c in n)) for n in names]
    return [f for f in known if f.stored and f.kind != "location" and any(p.fullmatch(f.name) for p in patterns)]
