"""Layers of attributes: compound predicates, point lookups, addresses and exports."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from geoloom.functions.columns import NOT_ATTRIBUTES, is_forced_text
from geoloom.operators.lineage import written

#: Rows of one chunk of the row address space.
CHUNK_ROWS = 100_000

_COMPARE = {
    ">": lambda c, v: c > v,
    "<": lambda c, v: c < v,
    "==": lambda c, v: c == v,
    ">=": lambda c, v: c >= v,
    "<=": lambda c, v: c <= v,
}


@dataclass(frozen=True)
class Layer:
    """A named table. gid, if given, is the column of row ids; text and number columns are told by their types.

    trimmed says that texts are stored without white space around them, so that
    tests on them reach the files.
    """

    name: str
    rows: DataFrame
    gid: str | None = None
    trimmed: bool = False

    def _attributes(self) -> list[T.StructField]:
        return [f for f in self.rows.schema.fields if f.name.lower() not in NOT_ATTRIBUTES and f.name != self.gid]

    @property
    def numbers(self) -> dict[str, str]:
        """Lower-case name to column name, of numeric and boolean columns that are not forced to be text."""
        return {f.name.lower(): f.name for f in self._attributes() if isinstance(f.dataType, (T.NumericType, T.BooleanType)) and not is_forced_text(f.name)}

    @property
    def texts(self) -> dict[str, str]:
        return {f.name.lower(): f.name for f in self._attributes() if f.name.lower() not in self.numbers}

    def id_column(self) -> Column:
        return F.col(self.gid).cast("bigint") if self.gid else F.lit(None).cast("bigint")


@dataclass(frozen=True)
class Request:
    """What rows must have: texts as {field: values}, of which one must match, and numbers as (field, operator, value)."""

    texts: dict[str, list[str]] = field(default_factory=dict)
    numbers: list[tuple[str, str, float]] = field(default_factory=list)

    def __post_init__(self):
        for _, op, _ in self.numbers:
            if op not in _COMPARE:
                raise ValueError(f"unknown operator {op!r}")


class Store:
    """A set of layers that are asked together."""

    def __init__(self, layers: list[Layer]):
        self.layers = layers

    def catalog(self) -> DataFrame:
        """One row for each layer with its columns."""
        spark = self.layers[0].rows.sparkSession
        rows = [(x.name, list(x.numbers.values()), list(x.texts.values())) for x in self.layers]
        return spark.createDataFrame(rows, "layer string, number_columns array<string>, text_columns array<string>")

    def having(self, request: Request) -> list[Layer]:
        """The layers that have every requested field; no data is read for this."""
        return [x for x in self.layers if all(f.lower() in x.texts for f in request.texts) and all(f.lower() in x.numbers for f, _, _ in request.numbers)]

    def _text_test(self, layer: Layer, name: str, values: list[str], any_cell: bool) -> Column:
        if any_cell:
            return reduce(lambda a, b: a | b, [F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")).isin(values) for c in layer.texts.values()])
        column = layer.texts[name.lower()]
        if layer.trimmed and "" not in values and isinstance(layer.rows.schema[column].dataType, T.StringType):
            return F.col(column).isin(values)
        return F.coalesce(F.trim(F.col(column).cast("string")), F.lit("")).isin(values)

    def _number_test(self, layer: Layer, request: Request) -> Column:
        """Null and NaN count as 0. Where 0 does not pass, they need no place in the test, and it stays one that files can be pruned by."""
        tests = []
        for f, op, v in request.numbers:
            column = F.col(layer.numbers[f.lower()])
            kind, value = layer.rows.schema[layer.numbers[f.lower()]].dataType, F.lit(float(v))
            if isinstance(kind, T.BooleanType) or _COMPARE[op](0.0, float(v)):
                tests.append(_COMPARE[op](F.coalesce(F.nanvl(column.cast("double"), F.lit(0.0)), F.lit(0.0)), value))
                continue
            tests.append(_COMPARE[op](column, value))
            if isinstance(kind, (T.DoubleType, T.FloatType)):
                tests.append(~F.isnan(column))
        return reduce(lambda a, b: a & b, tests, F.lit(True))

    def query(self, request: Request, any_cell: bool = False) -> DataFrame:
        """Rows of all layers that match: layer, gid and the requested fields, in lower case.

        Each layer is its own filtered scan. Number tests that 0 does not pass,
        and text tests on trimmed layers, reach the files.
        any_cell lets a text value stand in any text column of the row.
        """
        fields = [*request.texts, *(f for f, _, _ in request.numbers)]
        fields = list(dict.fromkeys(f.lower() for f in fields))
        parts = []
        for x in self.having(request):
            texts = reduce(lambda a, b: a & b, [self._text_test(x, f, v, any_cell) for f, v in request.texts.items()], F.lit(True))
            shown = [F.col(x.texts[f]).cast("string").alias(f) if f in x.texts else F.col(x.numbers[f]).cast("double").alias(f) for f in fields]
            parts.append(x.rows.where(self._number_test(x, request) & texts).select(F.lit(x.name).alias("layer"), x.id_column().alias("gid"), *shown))
        if not parts:
            raise LookupError("no layer has all the requested fields")
        return reduce(DataFrame.unionByName, parts)

    def funnel(self, request: Request, any_cell: bool = False, independent: bool = False) -> DataFrame:
        """For each requested text value the rows that have it: step, field, value, hits.

        Counted among the rows left by the number tests and the text fields
        before it; independent counts each among the rows of the number tests.
        """
        parts = []
        for x in self.having(request):
            left, aggs, names = F.lit(True), [], []
            for step, (f, values) in enumerate(request.texts.items()):
                for v in values:
                    aggs.append(F.count_if(left & self._text_test(x, f, [v], any_cell)).alias(f"n{len(names)}"))
                    names.append((step, f.lower(), v))
                if not independent:
                    left = left & self._text_test(x, f, values, any_cell)
            cells = [F.struct(F.lit(s).alias("step"), F.lit(f).alias("field"), F.lit(v).alias("value"), F.col(f"n{i}").alias("hits")) for i, (s, f, v) in enumerate(names)]
            # Number tests hold for all counts, so they reach the files.
            parts.append(x.rows.where(self._number_test(x, request)).agg(*aggs).select(F.explode(F.array(*cells)).alias("c")).select("c.*"))
        return reduce(DataFrame.unionByName, parts).groupBy("step", "field", "value").agg(F.sum("hits").alias("hits"))


def fetch(rows: DataFrame, requests: DataFrame, gid: str = "gid") -> DataFrame:
    """rows for each of requests(pos, gid), repeated ones as often as asked for, missing ones left out; order by pos to show them.

    Where rows hold a gid more than once, order them by `latest` first.
    """
    return requests.join(rows, requests["gid"] == rows[gid]).drop(rows[gid]) if gid == "gid" else requests.join(rows, requests["gid"] == rows[gid])


def latest(rows: DataFrame, gid: str, order: str) -> DataFrame:
    """Of each gid the row with the greatest `order`, by a partial and a final aggregate."""
    return rows.groupBy(gid).agg(F.max(F.struct(F.col(order), *[F.col(c) for c in rows.columns if c not in (gid, order)])).alias("r")).select(gid, "r.*")


def duplicate_ids(rows: DataFrame, gid: str) -> DataFrame:
    """Ids that more than one row has: gid, n."""
    return rows.groupBy(F.col(gid).alias("gid")).agg(F.count("*").alias("n")).where("n > 1")


def missing_ids(rows: DataFrame, requests: DataFrame, gid: str) -> DataFrame:
    return requests.join(rows.select(F.col(gid).alias("gid")), "gid", "left_anti")


def resolve(rows: DataFrame, requests: DataFrame, gid: str) -> DataFrame:
    """For each distinct requested gid: found, and outcome (one, missing or ambiguous)."""
    asked = requests.select("gid").distinct()
    found = asked.join(rows.select(F.col(gid).alias("gid"), F.lit(1).alias("hit")), "gid", "left").groupBy("gid").agg(F.count("hit").alias("found"))
    return found.withColumn("outcome", F.when(F.col("found") == 0, "missing").when(F.col("found") == 1, "one").otherwise("ambiguous"))


def running(rows: DataFrame, order: list[str], total: str | None = None, pieces: int | None = None) -> DataFrame:
    """rows with __before, how many rows come before each in `order`, or with total the sum of that column over them.

    Rows are dealt into ranges and written; each range is added up on its own
    and starts where the sums of the ranges before it end. What one window sees
    is one row for each range. Equal rows share no place: they get places one
    after another.
    """
    pieces = pieces or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = rows.withColumn("__tie", F.monotonically_increasing_id())
    ranged = written(tied.repartitionByRange(pieces, *order, "__tie").withColumn("__piece", F.spark_partition_id()), "running-ranges")
    size = F.col(total) if total else F.lit(1)
    sums = ranged.groupBy("__piece").agg(F.sum(size).alias("__sum"))
    starts = sums.select(F.col("__piece").alias("__p"), (F.sum("__sum").over(Window.orderBy("__piece")) - F.col("__sum")).alias("__start"))
    inside = Window.partitionBy("__piece").orderBy(*order, "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.withColumn("__upto", F.sum(size).over(inside)).join(F.broadcast(starts), F.col("__piece") == F.col("__p"))
    return placed.withColumn("__before", F.col("__start") + F.col("__upto") - size).drop("__piece", "__p", "__start", "__upto", "__tie")


def dense_index(rows: DataFrame, key: str, name: str = "global_idx", pieces: int | None = None) -> DataFrame:
    """Rows numbered from 0 without gaps in the order of a unique key, without one task that sorts all."""
    return running(rows, [key], None, pieces).withColumnRenamed("__before", name).withColumn(name, F.col(name).cast("bigint"))


def with_address(rows: DataFrame, index: str = "global_idx", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    return rows.withColumns({"chunk_id": F.floor(F.col(index) / chunk_rows).cast("bigint"), "local_idx": F.pmod(F.col(index), F.lit(chunk_rows)).cast("bigint")})


def layer_ranges(store: Store) -> list[tuple[str, int, int]]:
    """(layer, start_idx, end_idx) of each layer by running sums of their row counts; one row a layer reaches the driver."""
    counts = [x.rows.agg(F.count("*").alias("n")).select(F.lit(x.name).alias("layer"), "n") for x in store.layers]
    n_of = {r["layer"]: r["n"] for r in reduce(DataFrame.unionByName, counts).collect()}
    ranges, start = [], 0
    for x in store.layers:
        ranges.append((x.name, start, start + n_of[x.name]))
        start += n_of[x.name]
    return ranges


def layers_of(index: DataFrame, ranges: DataFrame) -> DataFrame:
    """index(global_idx) with the layer whose [start_idx, end_idx) holds it; ranges has one row for each layer."""
    return index.join(F.broadcast(ranges), (F.col("global_idx") >= F.col("start_idx")) & (F.col("global_idx") < F.col("end_idx"))).drop("start_idx", "end_idx")


def row_widths(layer: Layer) -> DataFrame:
    """The width of each row of a layer: three limbs a number, and a place for each character of its texts, parted by blanks."""
    texts = F.length(F.concat_ws(" ", *[F.col(c).cast("string") for c in layer.texts.values()])) if layer.texts else F.lit(0)
    return layer.rows.select(F.lit(layer.name).alias("layer"), (F.lit(3 * len(layer.numbers)) + texts).alias("width"))


def used_columns(layer: Layer) -> DataFrame:
    """The layer's columns that hold anything but blanks: layer, columns, n_rows; layers with equal columns share an export."""
    names = list(layer.rows.columns)
    flags = [F.max(F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.lit(c))).alias(f"c{i}") for i, c in enumerate(names)]
    kept = F.array_compact(F.array(*[F.col(f"c{i}") for i in range(len(names))]))
    return layer.rows.agg(*flags, F.count("*").alias("n_rows")).select(F.lit(layer.name).alias("layer"), F.array_join(kept, ",").alias("columns"), "n_rows")


def export_groups(store: Store, folder: str) -> dict[tuple[str, ...], list[str]]:
    """Writes the layers as CSV, those with equal used columns together; the columns of each group and its layers."""
    groups: dict[tuple[str, ...], list[Layer]] = {}
    for x in store.layers:
        groups.setdefault(tuple(used_columns(x).first()["columns"].split(",")), []).append(x)
    for i, (columns, members) in enumerate(groups.items()):
        parts = [m.rows.select(F.lit(m.name).alias("layer"), *[F.col(c).cast("string").alias(c) for c in columns]) for m in members]
        reduce(DataFrame.unionByName, parts).write.mode("errorifexists").option("header", True).csv(f"{folder}/group={i + 1}")
    return {c: [m.name for m in ms] for c, ms in groups.items()}


def export_matches(rows: DataFrame, folder: str, index: str = "global_idx", gid: str | None = None) -> None:
    """Writes matches in the order of their index, their indices and ids apart from them, and a line of how many there are, where and when."""
    rows.repartitionByRange(F.col(index)).sortWithinPartitions(index).write.mode("errorifexists").parquet(f"{folder}/rows")
    written_rows = rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/rows")
    written_rows.select(F.col(index).alias("index"), (F.col(gid) if gid else F.lit(None)).cast("bigint").alias("gid")).write.json(f"{folder}/indices")
    counts = written_rows.agg(F.count("*").alias("match_count"), F.min(index).alias("first_index"), F.max(index).alias("last_index"))
    counts.withColumn("timestamp", F.current_timestamp()).write.parquet(f"{folder}/meta")


def concatenated(parts: list[DataFrame]) -> DataFrame:
    """Rows of tables with different columns one below another; a column that a table lacks is null there. Equal names need types that go together."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
