"""Attribute layers: predicates, lookups, addresses, codec and audit."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.columns import aligned, from_limbs, has_window, is_forced_text, limbs, row_cells, row_text, valid_gid
from geoloom.operators import audit
from geoloom.operators import store as stores
from geoloom.operators.store import Request
from geoloom.plans.tables import store, table

STATUS = Request({"status": ["F", "O"]}, [("amount", ">=", 50_000.0)])


def layer_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers, how many rows and ids they have, and which of them have all the fields of a request."""
    s = store(spark, sf_dir)
    kept = {x.name for x in s.having(STATUS)}
    counts = reduce(DataFrame.unionByName, [x.rows.agg(F.count("*").alias("rows"), F.count_distinct(x.id_column()).alias("ids")).withColumn("name", F.lit(x.name)) for x in s.layers])
    named = s.catalog().select("layer", F.array_join("number_columns", ",").alias("numbers"), F.array_join("text_columns", ",").alias("texts"), F.col("layer").isin(kept).alias("kept"))
    return named.join(counts, F.col("layer") == F.col("name")).drop("name")


def compound_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).query(STATUS)


def compound_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compound_query(spark, sf_dir).groupBy("layer", "status").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


def number_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).query(Request({}, [("amount", ">=", 1000.0), ("amount", "<=", 2500.0)]))


def any_cell_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wanted values may stand in any text column of layers that have the field."""
    return store(spark, sf_dir).query(Request({"status": ["R", "1-URGENT", "P"]}), any_cell=True).groupBy("layer").agg(F.count("*").alias("n"), F.sum("gid").alias("gids"))


FUNNEL = Request({"status": ["F", "O", "X"], "flag": ["R", "A", "N"]}, [("amount", ">", 20_000.0)])


def funnel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).funnel(FUNNEL)


def independent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store(spark, sf_dir).funnel(FUNNEL, independent=True)


def funnel_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of each field: values asked for, and those without a hit."""
    return store(spark, sf_dir).funnel(FUNNEL).groupBy("field").agg(F.count("*").alias("asked"), F.count_if(F.col("hits") == 0).alias("without_hit"), F.max("hits").alias("most"))


def token_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by language in which the words 'of the' stand in a row."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang").agg(F.count_if(has_window(F.split(F.lower("text"), " "), ["of", "the"])).alias("n"))


def _hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order key that 100 divides; of these every tenth again, and for every fifth a negative id that no row has."""
    key = F.col("o_orderkey")
    asked = F.array_compact(F.array(key, F.when(key % 1000 == 0, key), F.when(key % 500 == 0, -1 - key)))
    each = table(spark, sf_dir, "orders").where(key % 100 == 0).select(key, F.posexplode(asked).alias("at", "gid"))
    return each.select((3 * key + F.col("at")).alias("pos"), "gid")


def gid_fetch_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("gid"), "o_totalprice")
    return stores.fetch(orders, _hundredths(spark, sf_dir))


def gid_latest_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("gid"), "l_extendedprice").agg(F.max("l_quantity").alias("l_quantity"))
    return stores.fetch(stores.latest(items, "gid", "l_extendedprice"), _hundredths(spark, sf_dir))


def gid_missing_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.missing_ids(table(spark, sf_dir, "orders"), _hundredths(spark, sf_dir), "o_orderkey")


def gid_resolve_hundredths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.resolve(table(spark, sf_dir, "lineitem"), _hundredths(spark, sf_dir), "l_orderkey")


def gid_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stores.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


def row_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey")
    return stores.with_address(stores.dense_index(orders, "o_orderkey"), chunk_rows=1000)


def gid_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of a query with their addresses, in the order of which an export writes them."""
    orders = stores.dense_index(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice"), "o_orderkey")
    return stores.with_address(orders.where("o_orderstatus = 'F' AND o_totalprice > 300000"), chunk_rows=1000)


def layer_of_every_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The global row numbers of all rows of all layers back to their layers, by ranges from the layers' row counts."""
    ranges = stores.layer_ranges(store(spark, sf_dir))
    index = spark.range(ranges[-1][2]).select(F.col("id").alias("global_idx"))
    found = stores.layers_of(index, spark.createDataFrame(ranges, "layer string, start_idx long, end_idx long"))
    return found.groupBy("layer").agg(F.count("*").alias("n"), F.min("global_idx").alias("first_idx"), F.max("global_idx").alias("last_idx"))


def used_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that hold anything, by layer; one layer gets a column that never does."""
    from geoloom.operators.store import Layer

    layers = [Layer(x.name, x.rows.withColumn("note", F.lit("  ")) if x.name == "orders" else x.rows, x.gid) for x in store(spark, sf_dir).layers]
    return reduce(DataFrame.unionByName, [stores.used_columns(x) for x in layers])


def distinct_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    each = part.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(F.col(c)).alias("value")) for c in ("p_brand", "p_type")])).alias("s")).select("s.*")
    return each.where("value != ''").distinct()


def distinct_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return part.select(row_text(F.lit("part"), [F.col("p_brand"), F.col("p_type"), F.when(F.col("p_size") > 10, F.col("p_size"))]).alias("line")).distinct()


def row_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The widest row of all six layers, in steps of 64."""
    widths = reduce(DataFrame.unionByName, [stores.row_widths(x) for x in store(spark, sf_dir).layers])
    return widths.agg(F.max("width").alias("widest")).select("widest", aligned(F.col("widest")).alias("width"))


def decoded_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = row_text(F.lit("customer"), [F.col("c_name"), F.concat(F.lit(" "), "c_mktsegment", F.lit("  x ")), F.lit(None)])
    cells = table(spark, sf_dir, "customer").select("c_custkey", row_cells(line).alias("cells"))
    return cells.select("c_custkey", F.array_join("cells", "|").alias("cells"), F.size("cells").alias("n"))


def limb_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", limbs(F.col("o_totalprice")).alias("l"))
    return coded.select("o_orderkey", F.col("l.ip").cast("double").alias("ip"), F.col("l.hi").cast("double").alias("hi"), F.col("l.lo").cast("double").alias("lo"), from_limbs(F.col("l")).alias("back"))


def audit_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two layers encoded and decoded again; one of them damaged in every 100th key."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    damaged = customer.withColumn("c_acctbal", F.when(F.col("c_custkey") % 100 == 0, F.col("c_acctbal") + 0.5).otherwise(F.col("c_acctbal")))
    parts = []
    for layer, rows, source, key, numbers, texts in (
        ("orders", orders, orders, "o_orderkey", ["o_totalprice", "o_custkey"], ["o_orderstatus", "o_orderpriority"]),
        ("customer", customer, damaged, "c_custkey", ["c_acctbal"], ["c_name", "c_mktsegment"]),
    ):
        parts.append(audit.compared(rows, audit.encoded(source, layer, key, numbers, texts), layer, key, numbers, texts))
    return audit.totals(parts)


def gid_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    raw = F.when(F.col("event_id") % 5 == 0, F.lit(None)).when(F.col("event_id") % 5 == 1, F.concat(F.lit("-"), F.col("event_id").cast("string"))).when(F.col("event_id") % 5 == 2, F.concat(F.col("event_id").cast("string"), F.lit(".5"))).when(F.col("event_id") % 5 == 3, F.col("event_type")).otherwise(F.col("event_id").cast("string"))
    return events.select(F.coalesce(valid_gid(raw), F.lit("ok")).alias("verdict")).groupBy("verdict").agg(F.count("*").alias("n"))


def field_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of all layers by whether their names force them to be text, and how many rows fill them."""
    parts = []
    for x in store(spark, sf_dir).layers:
        fields = [f.name for f in x.rows.schema.fields if f.name != x.gid]
        each = F.array(*[F.struct(F.lit(f).alias("column"), F.lit(is_forced_text(f)).alias("forced_text"), F.lit(f.lower() in x.numbers).alias("is_number"), F.col(f"`{f}`").alias("filled")) for f in fields])
        parts.append(x.rows.agg(*[F.count(f).alias(f) for f in fields]).select(F.lit(x.name).alias("layer"), F.explode(each).alias("c")).select("layer", "c.*"))
    return reduce(DataFrame.unionByName, parts)


QUERIES = {
    f.__name__: f
    for f in (
        layer_catalog, compound_query, compound_counts, number_range, any_cell_query, funnel_counts, independent_counts, funnel_report, token_window,
        gid_duplicates, row_addresses, gid_export, layer_of_every_row, used_columns, distinct_texts, distinct_rows, row_width, decoded_cells, limb_codec,
        audit_totals, gid_validation, field_kinds, gid_fetch_hundredths, gid_latest_hundredths, gid_missing_hundredths, gid_resolve_hundredths,
    )
}

_STATUS_SQL = """SELECT 'lineitem' AS layer, l_orderkey AS gid, l_linestatus AS status, l_extendedprice AS amount FROM lineitem WHERE l_linestatus IN ('F', 'O') AND l_extendedprice >= 50000
UNION ALL SELECT 'orders', o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus IN ('F', 'O') AND o_totalprice >= 50000"""
_HUNDREDTHS = """(SELECT 3 * o_orderkey AS pos, o_orderkey AS gid FROM orders WHERE o_orderkey % 100 = 0 UNION ALL SELECT 3 * o_orderkey + 1, o_orderkey FROM orders WHERE o_orderkey % 1000 = 0
        UNION ALL SELECT 3 * o_orderkey + CASE WHEN o_orderkey % 1000 = 0 THEN 2 ELSE 1 END, -1 - o_orderkey FROM orders WHERE o_orderkey % 500 = 0)"""


def _counts(independent: bool) -> str:
    second = "l_extendedprice > 20000" + ("" if independent else " AND l_linestatus IN ('F', 'O', 'X')")
    rows = [(0, "status", "l_linestatus", v, "l_extendedprice > 20000") for v in "FOX"] + [(1, "flag", "l_returnflag", v, second) for v in "RAN"]
    return " UNION ALL ".join(f"SELECT {s} AS step, '{f}' AS field, '{v}' AS value, CAST(count(*) FILTER (WHERE {w} AND {c} = '{v}') AS BIGINT) AS hits FROM lineitem" for s, f, c, v, w in rows)


_CELL = "regexp_replace({0}, '\\s+', '', 'g')"
_LIMBS = """limb AS (
  SELECT {key} AS key, {value} AS x, CAST(trunc({value}) AS FLOAT) AS ip FROM {table}
), limb2 AS (SELECT *, (x - CAST(ip AS DOUBLE)) * 1e4 AS rest FROM limb
), limb3 AS (SELECT *, CAST(trunc(rest) AS FLOAT) AS hi FROM limb2
), limb4 AS (SELECT *, CAST(trunc((rest - CAST(hi AS DOUBLE)) * 1e4) AS FLOAT) AS lo FROM limb3
), coded AS (SELECT key, x, CAST(ip AS DOUBLE) AS ip, CAST(hi AS DOUBLE) AS hi, CAST(lo AS DOUBLE) AS lo,
  round(round(CAST(ip AS DOUBLE)) + round(CAST(hi AS DOUBLE)) / 1e4 + round(CAST(lo AS DOUBLE)) / 1e8, 6) AS back FROM limb4)"""

#: Layer, table, id, numbers, texts.
_LAYERS = (
    ("lineitem", "l_orderkey", {"amount": "l_extendedprice"}, {"status": "l_linestatus", "flag": "l_returnflag"}), ("orders", "o_orderkey", {"amount": "o_totalprice"}, {"status": "o_orderstatus", "priority": "o_orderpriority"}),
    ("customer", "c_custkey", {"amount": "c_acctbal"}, {"segment": "c_mktsegment"}), ("supplier", "s_suppkey", {"amount": "s_acctbal"}, {}),
    ("part", "p_partkey", {"price": "p_retailprice"}, {"brand": "p_brand", "type": "p_type"}), ("events", "event_id", {"amount": "value"}, {"type": "event_type"}),
)

ORACLE_SQL = {
    "layer_catalog": " UNION ALL ".join(
        f"SELECT '{t}' AS layer, '{','.join(n)}' AS numbers, '{','.join(x)}' AS texts, {str('status' in x and 'amount' in n).lower()} AS kept, count(*) AS rows, count(DISTINCT {i}) AS ids FROM {t}" for t, i, n, x in _LAYERS
    ),
    "field_kinds": " UNION ALL ".join(
        f"SELECT '{t}' AS layer, '{f}' AS \"column\", false AS forced_text, {str(f in n).lower()} AS is_number, count({c}) AS filled FROM {t}" for t, _, n, x in _LAYERS for f, c in {**x, **n}.items()
    ),
    "row_width": "SELECT CAST(max(w) AS INTEGER) AS widest, CAST(ceil(max(w) / 64.0) * 64 AS BIGINT) AS width FROM ("
    + " UNION ALL ".join(f"SELECT {3 * len(n)} + {'length(concat_ws(' + repr(' ') + ', ' + ', '.join(x.values()) + '))' if x else 0} AS w FROM {t}" for t, _, n, x in _LAYERS)
    + ")",
    "compound_query": _STATUS_SQL,
    "compound_counts": f"SELECT layer, status, count(*) AS n, round(sum(amount), 2) AS total FROM ({_STATUS_SQL}) GROUP BY ALL",
    "number_range": """SELECT 'lineitem' AS layer, l_orderkey AS gid, l_extendedprice AS amount FROM lineitem WHERE l_extendedprice BETWEEN 1000 AND 2500
        UNION ALL SELECT 'orders', o_orderkey, o_totalprice FROM orders WHERE o_totalprice BETWEEN 1000 AND 2500
        UNION ALL SELECT 'customer', c_custkey, c_acctbal FROM customer WHERE c_acctbal BETWEEN 1000 AND 2500
        UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier WHERE s_acctbal BETWEEN 1000 AND 2500
        UNION ALL SELECT 'events', event_id, value FROM events WHERE value BETWEEN 1000 AND 2500""",
    "any_cell_query": """SELECT * FROM (SELECT 'lineitem' AS layer, count(*) AS n, CAST(sum(l_orderkey) AS BIGINT) AS gids FROM lineitem WHERE l_linestatus IN ('R', '1-URGENT', 'P') OR l_returnflag IN ('R', '1-URGENT', 'P')
        UNION ALL SELECT 'orders', count(*), CAST(sum(o_orderkey) AS BIGINT) FROM orders WHERE o_orderstatus IN ('R', '1-URGENT', 'P') OR o_orderpriority IN ('R', '1-URGENT', 'P')) WHERE n > 0""",
    "funnel_counts": _counts(False),
    "independent_counts": _counts(True),
    "funnel_report": f"SELECT field, count(*) AS asked, count(*) FILTER (WHERE hits = 0) AS without_hit, max(hits) AS most FROM ({_counts(False)}) GROUP BY field",
    "token_window": "SELECT lang, count(*) FILTER (WHERE ' ' || lower(text) || ' ' LIKE '% of the %') AS n FROM documents GROUP BY lang",
    "gid_duplicates": "SELECT l_orderkey AS gid, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1",
    "gid_fetch_hundredths": f"SELECT pos, gid, o_totalprice FROM {_HUNDREDTHS} q JOIN orders ON o_orderkey = gid",
    "gid_latest_hundredths": f"""SELECT pos, gid, l_extendedprice, l_quantity FROM {_HUNDREDTHS} q JOIN
        (SELECT l_orderkey, max((l_extendedprice, l_quantity)) AS b, b[1] AS l_extendedprice, b[2] AS l_quantity FROM lineitem GROUP BY l_orderkey) ON l_orderkey = gid""",
    "gid_missing_hundredths": f"SELECT gid, pos FROM {_HUNDREDTHS} q WHERE gid NOT IN (SELECT o_orderkey FROM orders)",
    "gid_resolve_hundredths": f"""SELECT gid, found, CASE WHEN found = 0 THEN 'missing' WHEN found = 1 THEN 'one' ELSE 'ambiguous' END AS outcome FROM
        (SELECT gid, count(l_orderkey) AS found FROM (SELECT DISTINCT gid FROM {_HUNDREDTHS} r) q LEFT JOIN lineitem ON l_orderkey = gid GROUP BY gid)""",
    "row_addresses": "SELECT o_orderkey, g AS global_idx, g // 1000 AS chunk_id, g % 1000 AS local_idx FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS g FROM orders)",
    "gid_export": """SELECT o_orderkey, o_orderstatus, o_totalprice, g AS global_idx, g // 1000 AS chunk_id, g % 1000 AS local_idx FROM
        (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS g FROM orders) WHERE o_orderstatus = 'F' AND o_totalprice > 300000""",
    "layer_of_every_row": "WITH c AS ("
    + " UNION ALL ".join(f"SELECT {i} AS k, '{t}' AS layer, count(*) AS n FROM {t}" for i, t in enumerate(("lineitem", "orders", "customer", "supplier", "part", "events")))
    + "), r AS (SELECT layer, n, CAST(sum(n) OVER (ORDER BY k) AS BIGINT) AS stop FROM c) SELECT layer, n, stop - n AS first_idx, stop - 1 AS last_idx FROM r WHERE n > 0",
    "used_columns": " UNION ALL ".join(
        f"SELECT '{t}' AS layer, '{c}' AS columns, count(*) AS n_rows FROM {t}"
        for t, c in (("lineitem", "gid,status,flag,amount"), ("orders", "gid,status,priority,amount"), ("customer", "gid,segment,amount"), ("supplier", "gid,amount"), ("part", "gid,brand,type,price"), ("events", "gid,type,amount"))
    ),
    "distinct_texts": "SELECT DISTINCT 'p_brand' AS \"column\", trim(p_brand) AS value FROM part UNION SELECT DISTINCT 'p_type', trim(p_type) FROM part",
    "distinct_rows": "SELECT DISTINCT '[TABLE] part [DATA] ' || trim(p_brand) || ' [SEP] ' || trim(p_type) || ' [SEP] ' || CASE WHEN p_size > 10 THEN CAST(p_size AS VARCHAR) ELSE '' END AS line FROM part",
    "decoded_cells": f"SELECT c_custkey, {_CELL.format('c_name')} || '|' || {_CELL.format('c_mktsegment')} || 'x|' AS cells, 3 AS n FROM customer",
    "limb_codec": "WITH " + _LIMBS.format(key="o_orderkey", value="o_totalprice", table="orders") + " SELECT key AS o_orderkey, ip, hi, lo, back FROM coded",
    "audit_totals": """SELECT 'orders' AS layer, 2 * count(*) AS number_hits, 0 AS number_misses, 2 * count(*) AS text_hits, 0 AS text_misses, count(*) AS row_hits, 0 AS row_misses, '' AS bad_columns FROM orders
        UNION ALL SELECT 'customer', count(*) FILTER (WHERE c_custkey % 100 != 0), count(*) FILTER (WHERE c_custkey % 100 = 0), 2 * count(*), 0,
        count(*) FILTER (WHERE c_custkey % 100 != 0), count(*) FILTER (WHERE c_custkey % 100 = 0), 'c_acctbal' FROM customer""",
    "gid_validation": """SELECT CASE event_id % 5 WHEN 0 THEN 'missing' WHEN 1 THEN 'negative' WHEN 2 THEN 'not whole' WHEN 3 THEN 'not a number' ELSE 'ok' END AS verdict, count(*) AS n FROM events GROUP BY 1""",
}
