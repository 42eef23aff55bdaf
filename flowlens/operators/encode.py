"""Category codes: modes, label encoding and one-hot columns."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import broadcast_if_small, checkpointed

# One-hot encoding makes a column per category, so no list may be longer than this.
MAX_CATEGORIES = 10_000
# Label lists up to this length are written into the plan and searched in order; longer
# ones are joined by hash.
LITERAL_CATEGORIES = 256
CODES_BROADCAST_ROWS = 100_000


def unpivoted(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows ``(column, value)`` with the values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
             for c in columns]
    return df.select(F.inline(F.array(*pairs)))


def modes(df: DataFrame, columns: list[str]) -> dict[str, str | None]:
    """Most frequent value per column, the smallest on ties; None where all are NULL.

    Counts are combined before the shuffle and each value is counted in its own group,
    so neither a dominant value nor a long list of values sits in one task.
    """
    if not columns:
        return {}
    counts = unpivoted(df, columns).where(F.col("value").isNotNull())
    counts = counts.groupBy("column", "value").agg((-F.count(F.lit(1))).alias("_minus_n"))
    best = counts.groupBy("column").agg(F.min(F.struct("_minus_n", "value")).alias("best"))
    found = {r["column"]: r["best"]["value"] for r in best.collect()}  # one row per column
    return {c: found.get(c) for c in columns}


def category_lists(
    df: DataFrame,
    columns: list[str],
    limit: int = MAX_CATEGORIES,
    sizes: dict[str, int] | None = None,
) -> dict[str, list | None]:
    """Sorted distinct non-NULL values per column; None where there are more than ``limit``.

    Two jobs for all columns together: sketches tell the long lists, the values of the
    others are fetched. ``sizes`` are sketches the caller has taken already.
    """
    if not columns:
        return {}
    if sizes is None:
        sizes = df.agg(*[F.approx_count_distinct(c).alias(c) for c in columns]).first().asDict()
    short = [c for c in columns if sizes[c] <= limit]
    lists: dict[str, list | None] = dict.fromkeys(columns)
    if short:  # short by the sketches, so each set fits an aggregation buffer
        row = df.agg(*[F.collect_set(c).alias(str(i)) for i, c in enumerate(short)]).first()
        lists |= {c: sorted(row[i]) for i, c in enumerate(short)}
    return lists


def one_hot(df: DataFrame, categories: dict[str, list]) -> DataFrame:
    """Replace each column by ``{column}_{j}`` flags at the end; unseen values give zeros."""
    flags = [
        F.when(F.col(c) == F.lit(value), 1.0).otherwise(0.0).alias(f"{c}_{j}")
        for c, values in categories.items()
        for j, value in enumerate(values)
    ]
    return df.select(*[c for c in df.columns if c not in categories], *flags)


def label_encode(
    df: DataFrame, columns: list[str], limit: int = LITERAL_CATEGORIES
) -> DataFrame:
    """Replace text columns by the rank of their value among the sorted distinct values.

    Short lists become literals (no shuffle). A longer list stays a table of codes, built
    by a distributed sort and joined on the value.
    """
    texts = df.withColumns({c: F.col(c).cast("string") for c in columns})
    lists = category_lists(texts, columns, limit)
    short = {c: v for c, v in lists.items() if v is not None}
    coded = texts.withColumns({c: _position(F.col(c), v) for c, v in short.items()})
    for c in columns:
        if lists[c] is None:
            codes = distributed_codes(texts.select(F.col(c).alias("_value")), "_value")
            codes = broadcast_if_small(codes, CODES_BROADCAST_ROWS)
            joined = coded.join(codes, F.col(c) == F.col("_value"), "left")
            coded = joined.withColumn(c, F.col("_code")).select(*df.columns)
    return coded


def _position(c: Column, values: list[str]) -> Column:
    found = F.array_position(F.array(*[F.lit(v) for v in values]), c) - 1
    return F.when(found >= 0, found)


def distributed_codes(df: DataFrame, column: str) -> DataFrame:
    """``(column, _code)``: 0-based rank of every distinct value, without a global window.

    The distinct values are range-partitioned and sorted; a row's running id then holds
    its partition and its place in it, and the partition sizes (one row per partition)
    give each partition's first code. The sorted table is checkpointed so that a retried
    task cannot see other partition bounds.
    """
    place = F.monotonically_increasing_id()
    ordered = df.where(F.col(column).isNotNull()).select(column).distinct()
    ordered = ordered.repartitionByRange(column).sortWithinPartitions(column)
    ordered = checkpointed(ordered.withColumn("_id", place))
    part = F.shiftright("_id", 33)
    sizes = ordered.groupBy(part.alias("part")).count().collect()  # one row per partition
    counts = {row["part"]: row["count"] for row in sizes}
    firsts = list(accumulate((counts.get(i, 0) for i in range(max(counts, default=0) + 1)), initial=0))
    offset = F.get(F.array(*[F.lit(n).cast("bigint") for n in firsts]), part.cast("int"))
    within = F.col("_id").bitwiseAND((1 << 33) - 1)
    return ordered.select(column, (offset + within).cast("bigint").alias("_code"))
