"""Per-packet features and generated feature columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import network as N
from flowlens.operators.flows import running_flows
from flowlens.schemas import ALL_FEATURES


def optional(df: DataFrame, name: str, default: object = None) -> Column:
    """The named column, or a literal where the table has no such column."""
    return F.col(name) if name in df.columns else F.lit(default)


def packet_size(df: DataFrame) -> Column:
    """Size in bytes: ``packet_size``, else ``length``, else 0."""
    sizes = [F.col(c).cast("bigint") for c in ("packet_size", "length") if c in df.columns]
    return F.coalesce(*sizes, F.lit(0).cast("bigint"))


def with_event_time(df: DataFrame) -> DataFrame:
    """Add ``t_us``, the event time in whole microseconds, from ``timestamp``."""
    kind = df.schema["timestamp"].dataType
    if isinstance(kind, T.TimestampType | T.TimestampNTZType):
        return df.withColumn("t_us", F.unix_micros(F.col("timestamp").cast("timestamp")))
    micros = F.round(F.col("timestamp").cast("double") * 1000000)
    return df.withColumn("t_us", micros.cast("bigint"))


def with_flow_key(df: DataFrame) -> DataFrame:
    """Add ``flow_key``, shared by both directions of a conversation."""
    key = N.flow_key(
        optional(df, "src_ip").cast("string"),
        optional(df, "dst_ip").cast("string"),
        optional(df, "src_port", 0),
        optional(df, "dst_port", 0),
        optional(df, "protocol", "").cast("string"),
    )
    return df.withColumn("flow_key", key)


def basic_features(df: DataFrame) -> DataFrame:
    """Address numbers, ports, protocol flags, size and payload flag."""
    name = F.lower(F.coalesce(optional(df, "protocol", "").cast("string"), F.lit("")))
    flags = {f"protocol_{p}": F.when(name == p, 1).otherwise(0) for p in ("tcp", "udp", "icmp")}
    has_payload = (
        F.when(F.octet_length("data") > 0, 1).otherwise(0) if "data" in df.columns else F.lit(0)
    )
    return df.withColumns(
        {
            "src_ip_num": N.ip_number(optional(df, "src_ip", "").cast("string")),
            "dst_ip_num": N.ip_number(optional(df, "dst_ip", "").cast("string")),
            "src_port": F.coalesce(optional(df, "src_port", 0), F.lit(0)),
            "dst_port": F.coalesce(optional(df, "dst_port", 0), F.lit(0)),
            **flags,
            "packet_size": packet_size(df),
            "has_payload": has_payload,
        }
    )


def time_features(df: DataFrame, timestamp: str = "timestamp") -> DataFrame:
    """Hour, minute, second, weekday (Monday = 0) and weekend flag, in the session zone."""
    ts = F.col(timestamp)
    day = F.weekday(ts)
    return df.withColumns(
        {
            "time_hour": F.hour(ts),
            "time_minute": F.minute(ts),
            "time_second": F.second(ts),
            "time_day_of_week": day,
            "time_is_weekend": F.when(day >= 5, 1).otherwise(0),
        }
    )


def extract_features(
    packets: DataFrame, keep: tuple[str, ...] = ("packet_id",), timestamp: str = "timestamp",
    **flow_options,
) -> DataFrame:
    """All 23 features per packet, next to the ``keep`` columns."""
    df = packets if "t_us" in packets.columns else with_event_time(packets)
    df = running_flows(with_flow_key(df), size=packet_size(df), **flow_options)
    df = time_features(basic_features(df), timestamp)
    return df.select(*keep, *ALL_FEATURES)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def polynomial_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``{c}_squared`` for all columns, then ``{c}_cubed`` for all columns, as DOUBLE."""
    columns = numeric_columns(df) if columns is None else columns
    value = {c: F.col(c).cast("double") for c in columns}
    squares = [(value[c] * value[c]).alias(f"{c}_squared") for c in columns]
    cubes = [(value[c] * value[c] * value[c]).alias(f"{c}_cubed") for c in columns]
    return df.select("*", *squares, *cubes)


def interaction_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``{a}_x_{b}`` for every pair of columns, as DOUBLE, in one projection."""
    columns = numeric_columns(df) if columns is None else columns
    products = [
        (F.col(a).cast("double") * F.col(b).cast("double")).alias(f"{a}_x_{b}")
        for a, b in combinations(columns, 2)
    ]
    return df.select("*", *products)


def time_bins(df: DataFrame) -> DataFrame:
    """Quarter of day and third of day from ``time_hour``; a no-op without that column."""
    if "time_hour" not in df.columns:
        return df
    hour = F.col("time_hour")
    quarter = (
        F.when(hour.between(0, 5), 0).when(hour.between(6, 11), 1).when(hour.between(12, 17), 2)
    )
    third = F.when(hour.between(0, 7), 0).when(hour.between(8, 15), 1)
    return df.withColumns({"time_of_day": quarter.otherwise(3), "time_period": third.otherwise(2)})


def generate_features(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Polynomials, then interactions (over the polynomials too), then time bins.

    ``columns`` limits the inputs; n inputs give 3n + C(3n, 2) numeric columns.
    """
    columns = numeric_columns(df) if columns is None else columns
    widened = columns + [f"{c}_squared" for c in columns] + [f"{c}_cubed" for c in columns]
    df = polynomial_features(df, columns)
    return time_bins(interaction_features(df, widened))


def generated_names(columns: list[str]) -> list[str]:
    """Names of the entries of :func:`generated_vector`."""
    powers = columns + [f"{c}_squared" for c in columns] + [f"{c}_cubed" for c in columns]
    return powers + [f"{a}_x_{b}" for a, b in combinations(powers, 2)]


def generated_vector(columns: list[str]) -> Column:
    """The numeric columns of :func:`generate_features` as one array, in the same order.

    The plan stays small however many inputs there are, while thousands of separate
    columns take longer to plan and compile than to compute. NULLs stay NULL.
    """
    values = F.array(*[F.col(c).cast("double") for c in columns])
    powers = F.concat(
        values, F.transform(values, lambda v: v * v), F.transform(values, lambda v: v * v * v)
    )
    n = 3 * len(columns)

    def products(i: Column, all_powers: Column) -> Column:
        first = F.get(all_powers, i)
        return F.transform(F.slice(all_powers, i + 2, F.lit(n)), lambda v: first * v)

    # A one-element array binds the powers, so that they are computed once per row.
    return F.transform(
        F.array(powers),
        lambda p: F.concat(
            p, F.flatten(F.transform(F.sequence(F.lit(0), F.lit(n - 2)), lambda i: products(i, p)))
        ),
    )[0]


#: Rows whose generated vectors are made at a time.
VECTOR_ROWS = 256


def with_generated(df: DataFrame, columns: list[str], found: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]]) -> DataFrame:
    """Add DOUBLE columns computed from every row's :func:`generated_vector`, made by blocks of rows.

    For many inputs, where a product at a time on the row takes most of a job, and moving the vectors
    the rest. Each function gets a block's vectors as the columns of a matrix, and
    which of its entries are NULL.
    """
    made = df.select("*", F.array(*[F.col(c).cast("double") for c in columns]).alias("_given"))
    out = T.StructType([*df.schema.fields, *[T.StructField(name, T.DoubleType()) for name in found]])
    wide = 3 * len(columns)

    def widened(powers: np.ndarray, join: np.ufunc) -> np.ndarray:
        """A row per power, then one per pair of them."""
        values, at = np.empty((wide + wide * (wide - 1) // 2, powers.shape[1]), dtype=powers.dtype), wide
        values[:wide] = powers
        for i in range(wide - 1):
            join(powers[i], powers[i + 1 :], out=values[at : at + wide - 1 - i])
            at += wide - 1 - i
        return values

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_ROWS):
                batch = whole.slice(start, VECTOR_ROWS)
                flat = batch.column("_given").flatten()
                given = flat.fill_null(0.0).to_numpy(zero_copy_only=False).reshape(-1, len(columns)).T
                with np.errstate(all="ignore"):
                    values = widened(np.concatenate([given, given * given, given * given * given]), np.multiply)
                if flat.null_count:
                    gaps = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, len(columns)).T
                    none = widened(np.concatenate([gaps, gaps, gaps]), np.logical_or)
                else:
                    none = np.zeros(values.shape, dtype=bool)
                more = [pa.array(np.asarray(f(values, none), dtype=float)) for f in found.values()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], names=out.names)

    return made.mapInArrow(blocks, out)
