"""The engine: dialect text in, DataFrames out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource

from tessera.functions.scalar import FUNCTIONS, Function, Overload
from tessera.operators import replay
from tessera.plans.analyzer import Analyzer, output
from tessera.plans.parser import parse
from tessera.plans.scope import Relation, Scope
from tessera.sources.catalog import Catalog
from tessera.types import Type


class Query:
    """An analysed query: its frame, its types, and what sinks need beside them."""

    def __init__(self, engine: Engine, text: str) -> None:
        self.tree = parse(text)
        analyzer = Analyzer(engine.catalog, engine.compat)
        self.relation: Relation = analyzer.query(self.tree, Scope())
        self.frame, self.columns = output(self.relation)
        self.poll_us = analyzer.poll_us

    @property
    def time_field(self) -> str | None:
        return next((n for (n, _), c in zip(self.columns, self.relation.cols, strict=True) if c.internal == self.relation.time), None)

    def changelog(self) -> DataFrame:
        """The result as a change stream: its columns, __retraction, and __at and __step to order by."""
        e = self.relation.emission
        if e is None:
            return self.frame.withColumns({"__retraction": F.lit(False), "__at": F.lit(0).cast("bigint"), "__step": F.lit(0)})
        log = replay.changelog(e)
        names = [n for n, _ in self.columns]
        return log.select(*[F.col(p).alias(n) for (p, _), n in zip(self.relation.emission_picks, names, strict=True)], "__retraction", "__at", "__step")


class Engine:
    """compat: where the dialect and ordinary SQL differ, do as the dialect does (NULL keys join, no promotion, quoted string())."""

    def __init__(self, spark: SparkSession, compat: bool = False, databases: dict[str, dict[str, str]] | None = None, folder: str | None = None) -> None:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        self.spark, self.compat = spark, compat
        self.catalog = Catalog(spark, databases or {}, folder=folder)

    def register(self, name: str, frame: DataFrame, time: str | None = None, seq: str | None = None) -> None:
        """A table by name; time: its time field, seq: the column that gives the order of arrival. A streaming frame that
        has a watermark keeps it."""
        self.catalog.frames[name] = frame
        self.catalog.fields[name] = (time, seq)

    def register_reader(self, extension: str, reader: Callable[[SparkSession, str, dict[str, str]], DataFrame]) -> None:
        """What reads files of an extension, or the tables of databases of this type."""
        self.catalog.readers[extension] = reader

    def register_source(self, source: type[DataSource]) -> None:
        """A Python data source: its name is then an extension, or the type of a database (option `table`)."""
        self.spark.dataSource.register(source)
        self.catalog.readers[source.name()] = lambda spark, table, options: spark.read.format(source.name()).options(**options).option("table", table).load()

    def register_function(self, name: str, arguments: str, result: Type, build: Callable[..., Column], description: str = "") -> None:
        """One more overload of a scalar function, for this engine: arguments are kinds such as `String Int`, build makes a
        Column of theirs. It comes before older ones, so of equal arguments the last registered wins."""
        name = name.lower()
        old = self.catalog.functions.get(name) or FUNCTIONS.get(name) or Function(description)
        new = Overload(tuple(arguments.split()), result, build)
        self.catalog.functions[name] = Function(description or old.description, [new, *old.overloads], old.whole)

    def query(self, text: str) -> Query:
        return Query(self, text)

    def sql(self, text: str) -> DataFrame:
        return Query(self, text).frame

    def describe(self, text: str) -> list[tuple[str, str, bool]]:
        q = Query(self, text)
        return [(n, str(t), n == q.time_field) for n, t in q.columns]

    def types(self, text: str) -> dict[str, Type]:
        return dict(Query(self, text).columns)
