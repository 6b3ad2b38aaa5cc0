"""Tables by name: registered frames, databases, files by extension or prefix, and the tables of the documentation."""

from __future__ import annotations

import itertools
import os
import sys
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as S

from tessera.errors import QueryError
from tessera.functions.aggregates import AGGREGATES
from tessera.functions.scalar import FUNCTIONS, Function
from tessera.plans.scope import Relation, from_frame
from tessera.sources.infer import SAMPLE, csv_types, has_union, json_types
from tessera.sources.shared import spool
from tessera.sources.tail import GrowingFile
from tessera.types import KINDS, NULL, TAG, Type, required, to_spark, type_sum

FORMATS = {"csv": "csv", "tsv": "tsv", "json": "json", "jsonl": "json", "parquet": "parquet", "lines": "lines", "txt": "lines"}


def alias_of(name: str) -> str:
    """What a table is called without an alias."""
    for ext in (".csv", ".json", ".parquet"):
        name = name.removesuffix(ext)
    name = name.split("/")[-1] if "/" in name else name.partition(".")[2] or name
    return name.partition(".")[2] or name


def variant_value(v: Column, t: Type) -> Column:
    """A parsed JSON value as its declared type; NULL where it does not fit."""
    kind = F.schema_of_variant(v)
    number = kind.rlike("^(TINYINT|SMALLINT|INT|BIGINT|DECIMAL|FLOAT|DOUBLE)")
    get = lambda as_: F.try_variant_get(v, "$", as_)
    if t.kind == "Union":
        out = F.lit(None).cast(to_spark(t))
        tests = {"Float": number, "String": kind == "STRING", "Boolean": kind == "BOOLEAN", "Time": (kind == "STRING") & get("timestamp").isNotNull(), "List": kind.startswith("ARRAY"), "Struct": kind.startswith("OBJECT")}
        for a in reversed(t.alts):
            slots = [(variant_value(v, a) if b.kind == a.kind else F.lit(None).cast(to_spark(b))).alias(b.kind) for b in t.alts]
            out = F.when(tests.get(a.kind, F.lit(False)), F.struct(F.lit(KINDS.index(a.kind)).cast("tinyint").alias(TAG), *slots)).otherwise(out)
        return out
    if t.kind == "Float":
        return F.when(number, get("double"))
    if t.kind == "String":
        return F.when(kind == "STRING", get("string"))
    if t.kind == "Boolean":
        return F.when(kind == "BOOLEAN", get("boolean"))
    if t.kind == "Time":
        return F.when(kind == "STRING", get("timestamp"))
    if t.kind == "List":
        return F.when(kind.startswith("ARRAY"), F.transform(get("array<variant>"), lambda x: variant_value(x, t.elem or NULL)))
    if t.kind == "Struct":
        parts = [variant_value(F.try_variant_get(v, f"$['{n}']", "variant"), f).alias(n) for n, f in t.fields]
        return F.when(kind.startswith("OBJECT"), F.struct(*parts))
    return F.lit(None).cast(to_spark(t))


@dataclass
class Catalog:
    spark: SparkSession
    databases: dict[str, dict[str, str]] = field(default_factory=dict)
    readers: dict[str, Callable[[SparkSession, str, dict[str, str]], DataFrame]] = field(default_factory=dict)
    frames: dict[str, DataFrame] = field(default_factory=dict)
    #: Of registered frames: the time field and the column of arrival.
    fields: dict[str, tuple[str | None, str | None]] = field(default_factory=dict)
    folder: str | None = None
    #: Functions that this engine has registered, beside or instead of the built-in ones.
    functions: dict[str, Function] = field(default_factory=dict)
    #: Whether a single growing file has been read.
    followed: bool = False
    stdin: object = None
    spooled: str | None = None

    def relation(self, name: str, options: dict[str, str], alias: str | None) -> Relation:
        alias = alias or alias_of(name)
        seq, time = options.get("seq"), options.get("time")
        if name in self.frames:
            own = self.fields.get(name, (None, None))
            seq, time = seq or own[1], time or own[0]
            return from_frame(self.frames[name], alias, seq=seq, time=time)
        if name == "dual":
            return from_frame(self.spark.range(1).select(F.lit("X").alias("dummy")), alias)
        prefix, _, rest = name.partition(".")
        if prefix in ("docs", "plugins") and rest:
            return from_frame(self.documentation(prefix, rest), alias)
        if prefix in self.databases and rest:
            own = dict(self.databases[prefix])
            kind = own.pop("type", "jdbc")
            if kind in self.readers:
                return from_frame(self.readers[kind](self.spark, rest, {**own, **options}), alias, seq=seq, time=time)
            return from_frame(self.spark.read.format(kind).options(**own).option("dbtable", rest).load(), alias, seq=seq, time=time)
        if prefix in FORMATS and rest and "/" not in prefix:
            kind, path = FORMATS[prefix], rest
        else:
            ext = name.rpartition(".")[2]
            if ext in self.readers:
                return from_frame(self.readers[ext](self.spark, self.place(name), options), alias, seq=seq, time=time)
            if ext not in FORMATS or ext == name:
                raise QueryError(f"unknown table: {name}")
            kind, path = FORMATS[ext], name
        path = self.from_stdin() if path.rpartition("/")[2] in ("stdin", f"stdin.{kind}") else self.place(path)
        tail = options.get("tail", "false") == "true"
        df, types = {"csv": self.csv, "tsv": self.csv, "json": self.json, "parquet": self.parquet, "lines": self.lines}[kind](path, {"kind": kind, **options}, tail)
        return from_frame(df, alias, types, seq, time)

    def place(self, path: str) -> str:
        if self.folder and "://" not in path and not os.path.isabs(path):
            return os.path.join(self.folder, path)
        return os.path.expanduser(path) if path.startswith("~") else path

    def from_stdin(self) -> str:
        """Standard input, once, as a file in the folder that all executors share."""
        if self.spooled is None:
            self.spooled = spool(self.spark, self.stdin or sys.stdin.buffer, "stdin")
        return self.spooled

    @staticmethod
    def whole_lines(path: str) -> list[str]:
        """The first lines of a growing file, without one that is still being written."""
        with open(path, encoding="utf-8", errors="replace") as f:
            return [line for line in itertools.islice(f, SAMPLE) if line.endswith("\n")]

    def growing(self, path: str, tail: bool) -> DataFrame | None:
        """number and value of the lines of a single growing file that can be opened; None for all else."""
        own = path.removeprefix("file://")
        if not tail or not os.path.isfile(own):
            return None
        self.spark.dataSource.register(GrowingFile)
        self.followed = True
        return self.spark.readStream.format(GrowingFile.name()).option("path", own).load()

    def scan(self, reader: Callable, path: str, tail: bool) -> DataFrame:
        """reader makes a frame of a reader of files or of a stream of files; a stream watches the file's folder."""
        if not tail:
            return reader(self.spark.read).load(path)
        folder, _, name = path.rpartition("/")
        if os.path.isdir(path):
            return reader(self.spark.readStream).load(path)
        return reader(self.spark.readStream).option("pathGlobFilter", name).load(folder or ".")

    def csv(self, path: str, options: dict[str, str], tail: bool) -> tuple[DataFrame, dict[str, Type]]:
        header = options.get("header", "true") != "false"
        sep = "\t" if options["kind"] == "tsv" else options.get("sep", ",")
        settings = {"header": str(header).lower(), "sep": sep, "quote": '"', "escape": '"', "multiLine": options.get("multiline", "false")}
        first = self.spark.read.options(**settings).csv(path).limit(SAMPLE)
        names = first.columns if header else [f"column_{i}" for i in range(len(first.columns))]
        types = csv_types(names, [tuple(r) for r in first.collect()])
        # a value that does not fit its column fails the query, unless it is to be NULL
        mode = {"fail": "FAILFAST", "null": "PERMISSIVE"}[options.get("misfit", "fail")]
        schema = S.StructType([S.StructField(n, to_spark(types[n])) for n in names])
        lines = self.growing(path, tail)
        if lines is not None:
            # a line is a record here
            row = F.from_csv("value", schema.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {"sep": sep, "quote": '"', "escape": '"', "nullValue": "", "mode": mode})
            return lines.filter(f"number > 0 OR {str(not header).lower()}").select(row.alias("r")).select("r.*"), {n: Type(t.kind, True) for n, t in types.items()}
        df = self.scan(lambda r: r.format("csv").schema(schema).options(**settings, mode=mode, nullValue="", enforceSchema="true"), path, tail)
        return df, {n: Type(t.kind, True) for n, t in types.items()}

    def json(self, path: str, options: dict[str, str], tail: bool) -> tuple[DataFrame, dict[str, Type]]:
        types = json_types(self.whole_lines(path) if tail and os.path.isfile(path) else (r[0] for r in self.spark.read.text(path).limit(SAMPLE).collect()))
        types = {n: Type("String", True) if t.kind == "Null" else t for n, t in types.items()}
        if any(has_union(t) for t in types.values()):
            lines = self.growing(path, tail)
            text = (self.scan(lambda r: r.format("text"), path, tail) if lines is None else lines).filter(F.trim("value") != "")
            row = text.select(F.parse_json("value").alias("v"))
            cols = [variant_value(F.try_variant_get("v", f"$['{n}']", "variant"), t).alias(n) for n, t in types.items()]
            return row.select(*cols), {n: type_sum(t, NULL) if t.nullable else t for n, t in types.items()}
        schema = S.StructType([S.StructField(n, to_spark(t)) for n, t in types.items()])
        lines = self.growing(path, tail)
        if lines is not None:
            return lines.filter(F.trim("value") != "").select(F.from_json("value", schema, {"mode": "FAILFAST"}).alias("r")).select("r.*"), types
        df = self.scan(lambda r: r.format("json").schema(schema).option("mode", "FAILFAST"), path, tail)
        return df, types

    def parquet(self, path: str, options: dict[str, str], tail: bool) -> tuple[DataFrame, dict[str, Type]]:
        if tail:
            schema = self.spark.read.parquet(path).schema
            return self.scan(lambda r: r.format("parquet").schema(schema), path, True), {}
        return self.spark.read.parquet(path), {}

    def lines(self, path: str, options: dict[str, str], tail: bool) -> tuple[DataFrame, dict[str, Type]]:
        """number (from 0) and text; the number of a line is its place in its partition and the lines before that."""
        sep = options.get("sep", "\n").encode().decode("unicode_escape")
        lines = self.growing(path, tail) if sep == "\n" else None
        if lines is not None:
            return lines.select("number", F.col("value").alias("text")), {"number": Type("Int"), "text": Type("String")}
        text = self.scan(lambda r: r.format("text").option("lineSep", sep), path, tail)
        if tail:
            return text.select(F.lit(None).cast("bigint").alias("number"), F.col("value").alias("text")), {}
        at = text.withColumn("__id", F.monotonically_increasing_id()).withColumn("__part", F.shiftright("__id", 33))
        parts = at.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))
        before = parts.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
        number = F.col("__before") + F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
        return at.join(before, "__part").select(number.alias("number"), F.col("value").alias("text")), {"number": Type("Int"), "text": Type("String")}

    def documentation(self, kind: str, table: str) -> DataFrame:
        make = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        if kind == "plugins":
            own = [(f, "format", "built in") for f in sorted(FORMATS)] + [(r, "reader", "registered") for r in sorted(self.readers)] + [(d, "database", o.get("type", "jdbc")) for d, o in sorted(self.databases.items())]
            if table in ("available_plugins", "installed_plugins"):
                return make([(n, k, o) for n, k, o in own], "name string, kind string, origin string")
            if table in ("available_versions", "installed_versions"):
                return make([(n, self.spark.version) for n, *_ in own], "plugin_name string, version string")
            if table == "repositories":
                return make([("core", "built in")], "slug string, description string")
        elif table == "functions":
            return make([(n, f.description) for n, f in (FUNCTIONS | self.functions).items() if f.description], "name string, description string")
        elif table == "function_signatures":
            rows = [(n, list(o.args), "" if callable(o.result) else str(o.result), not f.whole) for n, f in (FUNCTIONS | self.functions).items() for o in f.overloads]
            return make(rows, "name string, argument_types array<string>, output_type string, strict boolean")
        elif table == "aggregates":
            return make([(n, a.description) for n, a in AGGREGATES.items()], "name string, description string")
        elif table == "aggregate_signatures":
            rows = [(n, k, str(required(a.result(Type(k))))) for n, a in AGGREGATES.items() for k in KINDS[1:7] if a.accepts(k)]
            return make(rows, "name string, argument_type string, output_type string")
        raise QueryError(f"unknown table: {kind}.{table}")


