"""Column functions that stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Columns that are text whatever they hold, by whole name (any case) and by ending.
TEXT_NAMES = ("BSM", "YSDM", "PAC", "OBJECTID", "DLBM", "QSDWDM", "ZLDWDM", "TBYBH", "PZYWH")
TEXT_ENDINGS = ("代码", "编码", "编号", "ID", "id", "Id", "CODE", "code", "Code", "bm", "BM", "dm", "DM")
#: Columns that are no attributes.
NOT_ATTRIBUTES = ("gid", "geometry", "shape")


def is_forced_text(name: str) -> bool:
    return name.upper() in TEXT_NAMES or name.endswith(TEXT_ENDINGS)


def limbs(x: Column) -> Column:
    """A double as three floats: whole part, then four and four more decimals. Null and NaN give zeros."""
    clean = F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double"))
    whole = clean.cast("bigint").cast("float")
    rest = (clean - whole.cast("double")) * F.lit(1e4)
    high = rest.cast("bigint").cast("float")
    low = ((rest - high.cast("double")) * F.lit(1e4)).cast("bigint").cast("float")
    return F.struct(whole.alias("ip"), high.alias("hi"), low.alias("lo"))


def from_limbs(limb: Column, digits: int | None = 6) -> Column:
    """The double that three limbs stand for, rounded to `digits` unless None."""
    value = F.round(limb["ip"].cast("double")) + F.round(limb["hi"].cast("double")) / F.lit(1e4) + F.round(limb["lo"].cast("double")) / F.lit(1e8)
    return value if digits is None else F.round(value, digits)


def aligned(width: Column, step: int = 64) -> Column:
    """width rounded up to a multiple of step."""
    return (F.ceil(width / F.lit(step)) * step).cast("bigint")


def row_text(layer: Column, cells: list[Column]) -> Column:
    """A row as one line: table name, then its trimmed cells between separators; null is an empty cell."""
    return F.concat(F.lit("[TABLE] "), layer, F.lit(" [DATA] "), F.concat_ws(" [SEP] ", *[F.trim(F.coalesce(c.cast("string"), F.lit(""))) for c in cells]))


def row_cells(line: Column) -> Column:
    """The cells of a row_text line, without any white space."""
    data = F.regexp_replace(F.regexp_extract(line, r"(?s)\[DATA\] (.*)$", 1), r"\[PAD\]|\[CLS\]", "")
    return F.transform(F.split(data, r"\[SEP\]"), lambda c: F.regexp_replace(c, r"\s+", ""))


def has_window(tokens: Column, wanted: list[str]) -> Column:
    """Whether the wanted tokens stand in a row somewhere in tokens."""
    k = len(wanted)
    target = F.array(*map(F.lit, wanted))
    # The inner array holds the tokens once, so that each start does not make them again.
    starts = lambda t: F.exists(F.sequence(F.lit(1), F.greatest(F.size(t) - k + 1, F.lit(1))), lambda i: F.slice(t, i, k) == target)
    return F.element_at(F.transform(F.array(tokens), lambda t: F.when(F.size(t) < k, F.lit(False)).otherwise(starts(t))), 1)


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences in doubles; never negative."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def overlaps(q: list[Column], b: list[Column]) -> Column:
    """Whether two boxes (x0, y0, x1, y1) share inner points; touching ones do not."""
    return (q[0] < b[2]) & (q[2] > b[0]) & (q[1] < b[3]) & (q[3] > b[1])


def complex_product(a: Column, b: Column) -> Column:
    return F.struct((a["re"] * b["re"] - a["im"] * b["im"]).alias("re"), (a["re"] * b["im"] + a["im"] * b["re"]).alias("im"))


def to_channels(re: Column, im: Column) -> Column:
    """Log magnitude, and cosine and sine of the phase."""
    phase = F.atan2(im, re)
    return F.struct(F.log1p(F.hypot(re, im)).alias("mag"), F.cos(phase).alias("cos"), F.sin(phase).alias("sin"))


def from_channels(mag: Column, cos: Column, sin: Column) -> Column:
    return F.struct((F.expm1(mag) * cos).alias("re"), (F.expm1(mag) * sin).alias("im"))


def image_size(length: Column, resolution: Column, metres: float = 118_000.0) -> Column:
    """Pixels along a side of `length` degrees at `resolution` metres."""
    return F.ceil(length * F.lit(metres) / resolution).cast("int")


def position_code(index: Column, dim: int) -> Column:
    """The sine and cosine code of a position: dim / 2 sines, then as many cosines."""
    half = dim // 2
    rate = lambda k: F.lit(1.0) / F.pow(F.lit(10_000.0), k.cast("double") / F.lit(float(half)))
    steps = F.sequence(F.lit(0), F.lit(half - 1))
    return F.concat(F.transform(steps, lambda k: F.sin(index * rate(k))), F.transform(steps, lambda k: F.cos(index * rate(k))))


def grid_position_code(row: Column, column: Column, dim: int) -> Column:
    """The code of a place in a grid: dim / 2 elements for its column, then as many for its row."""
    if dim % 4:
        raise ValueError("sines and cosines of two axes need a multiple of four")
    return F.concat(position_code(column, dim // 2), position_code(row, dim // 2))


def warm_cosine(epoch: Column, warmup: int, epochs: int, least: float) -> Column:
    """A rate's factor: straight up from `least` to 1 while epoch <= warmup, then half a cosine back."""
    up = F.lit(least) + F.lit(1.0 - least) * epoch / F.lit(float(max(1, warmup)))
    share = (epoch - F.lit(warmup)) / F.lit(float(max(1, epochs - warmup)))
    return F.when(epoch <= warmup, up).otherwise(F.lit(least) + F.lit(0.5 * (1.0 - least)) * (1 + F.cos(F.lit(math.pi) * share)))


def ramp(epoch: Column, top: float, warmup: int, length: int) -> Column:
    """0 before warmup, then straight up to top over `length` epochs."""
    return F.when(epoch < warmup, F.lit(0.0)).otherwise(F.lit(top) * F.least(F.lit(1.0), (epoch - F.lit(warmup)) / F.lit(float(max(1, length)))))


def valid_gid(raw: Column) -> Column:
    """Why a value is no row id, or null if it is one: whole, not negative, below 2**64."""
    number = raw.try_cast("decimal(38,10)")
    return (
        F.when(raw.isNull(), F.lit("missing"))
        .when(number.isNull(), F.lit("not a number"))
        .when(number != F.floor(number), F.lit("not whole"))
        .when(number < 0, F.lit("negative"))
        .when(number > F.lit("18446744073709551615").cast("decimal(38,10)"), F.lit("too large"))
    )
