"""Fitting and applying data preparation.

Fitting is one aggregate that yields a small set of parameters; applying is a projection
with those parameters as literals, so it never shuffles and works on streams too.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions.numeric import INFINITY, finite, min_max_scaled, standardized
from flowlens.operators.encode import category_lists, modes, one_hot
from flowlens.operators.quantiles import exact_quantiles
from flowlens.schemas import CATEGORICAL_FEATURES, IP_FEATURES, NUMERIC_FEATURES

# Label column names, exact ones in order of preference, then name parts.
LABEL_NAMES = ["Label", "label", "CLASS", "class", "target", "Target"]
LABEL_PARTS = ["label", "class", "target", "attack"]
CLIP_QUANTILES = [0.001, 0.999]


@dataclass
class Preprocessor:
    """Impute, scale addresses, one-hot and standardise the packet features."""

    means: dict[str, float] = field(default_factory=dict)
    deviations: dict[str, float] = field(default_factory=dict)
    lows: dict[str, float] = field(default_factory=dict)
    highs: dict[str, float] = field(default_factory=dict)
    categories: dict[str, list] = field(default_factory=dict)
    fitted: bool = False

    @classmethod
    def fit(cls, df: DataFrame) -> Preprocessor:
        """Statistics of the table as it is (NULLs are ignored, not imputed first)."""
        numeric = [c for c in df.columns if c in NUMERIC_FEATURES]
        address = [c for c in df.columns if c in IP_FEATURES]
        flags = [c for c in df.columns if c in CATEGORICAL_FEATURES]
        wanted = [F.avg(finite(F.col(c))).alias(f"mean_{c}") for c in numeric]
        wanted += [F.stddev_pop(finite(F.col(c))).alias(f"sd_{c}") for c in numeric]
        wanted += [F.min(c).alias(f"low_{c}") for c in address]
        wanted += [F.max(c).alias(f"high_{c}") for c in address]
        wanted += [F.approx_count_distinct(c).alias(f"size_{c}") for c in flags]
        row = df.agg(*wanted).first().asDict() if wanted else {}
        categories = category_lists(df, flags, sizes={c: row[f"size_{c}"] for c in flags})
        for c, values in categories.items():
            if values is None:
                raise ValueError(f"{c} has too many values for one column each")
        return cls(
            means={c: row[f"mean_{c}"] for c in numeric},
            deviations={c: row[f"sd_{c}"] for c in numeric},
            lows={c: row[f"low_{c}"] for c in address},
            highs={c: row[f"high_{c}"] for c in address},
            categories=categories,
            fitted=True,
        )

    def _check(self) -> None:
        if not self.fitted:
            raise ValueError("fit the preprocessor before using it")

    def impute(self, df: DataFrame) -> DataFrame:
        """Numeric columns get their mean; flags and addresses get 0."""
        self._check()
        filled = {
            c: F.coalesce(finite(F.col(c)), F.lit(mean))
            for c, mean in self.means.items()
            if c in df.columns
        }
        zeros = [c for c in [*self.lows, *self.categories] if c in df.columns]
        filled |= {c: F.coalesce(F.col(c), F.lit(0)) for c in zeros}
        return df.withColumns(filled)

    def scale_addresses(self, df: DataFrame) -> DataFrame:
        self._check()
        present = [c for c in self.lows if c in df.columns]
        return df.withColumns(
            {c: min_max_scaled(F.col(c), self.lows[c], self.highs[c]) for c in present}
        )

    def encode(self, df: DataFrame) -> DataFrame:
        self._check()
        return one_hot(df, {c: v for c, v in self.categories.items() if c in df.columns})

    def standardize(self, df: DataFrame) -> DataFrame:
        self._check()
        present = [c for c in self.means if c in df.columns]
        return df.withColumns(
            {c: standardized(F.col(c), self.means[c], self.deviations[c]) for c in present}
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Impute, scale addresses, one-hot, standardise; encoded columns come last."""
        df = self.scale_addresses(self.impute(df))
        return self.standardize(self.encode(df))

    def output_columns(self) -> list[str]:
        flags = [f"{c}_{j}" for c, values in self.categories.items() for j in range(len(values))]
        return [*self.lows, *self.means, *flags]

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON row."""
        state = spark.range(1).select(F.lit(json.dumps(asdict(self))).alias("state"))
        state.coalesce(1).write.mode("overwrite").json(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Preprocessor:
        row = spark.read.schema("state string").json(path).first()
        return cls(**json.loads(row["state"]))


def drop_address_columns(df: DataFrame) -> DataFrame:
    """Drop the columns whose name contains ``IP`` (as written, in capitals)."""
    return df.drop(*[c for c in df.columns if "IP" in c])


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def floating_names(df: DataFrame) -> list[str]:
    kinds = T.DoubleType | T.FloatType
    return [f.name for f in df.schema.fields if isinstance(f.dataType, kinds)]


def null_nonfinite(df: DataFrame) -> DataFrame:
    """NaN and infinities in floating columns become NULL."""
    return df.withColumns({c: finite(F.col(_quoted(c))) for c in floating_names(df)})


def _quoted(name: str) -> str:
    return f"`{name.replace('`', '``')}`"


def fill_median(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill numeric columns with their median, or 0 where all rows are NULL."""
    columns = numeric_names(df) if columns is None else columns
    medians = exact_quantiles(df, {c: [0.5] for c in columns})
    values = {c: F.lit(m[0] if m[0] is not None else 0.0) for c, m in medians.items()}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), v) for c, v in values.items()})


def fill_mode(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fill the other columns with their most frequent value, or ``unknown``."""
    numeric = set(numeric_names(df))
    columns = [c for c in df.columns if c not in numeric] if columns is None else columns
    found = modes(df, columns)
    return df.withColumns(
        {
            c: F.coalesce(
                F.col(c),
                F.lit("unknown" if found[c] is None else found[c]).cast(df.schema[c].dataType),
            )
            for c in columns
        }
    )


def find_label(columns: list[str]) -> str:
    """The label column by exact name, else by part of the name, else the last column."""
    for name in LABEL_NAMES:
        if name in columns:
            return name
    for name in columns:
        if any(part in name.strip().lower() for part in LABEL_PARTS):
            return name
    return columns[-1]


def clip_bounds(df: DataFrame, columns: list[str]) -> dict[str, list[float | None]]:
    return exact_quantiles(df, {c: CLIP_QUANTILES for c in columns})


def clip(df: DataFrame, bounds: dict[str, list[float | None]]) -> DataFrame:
    """Limit each column to its bounds."""
    return df.withColumns(
        {
            c: F.when(
                F.col(c).isNotNull(),
                F.least(F.greatest(F.col(c).cast("double"), F.lit(low)), F.lit(high)),
            )
            for c, (low, high) in bounds.items()
            if low is not None
        }
    )


def clip_to_quantiles(df: DataFrame, columns: list[str]) -> DataFrame:
    return clip(df, clip_bounds(df, columns))


def infinite_to_mean(df: DataFrame, columns: list[str]) -> DataFrame:
    """Replace infinities by the mean of the finite values."""
    means = df.agg(*[F.avg(finite(F.col(c))).alias(c) for c in columns]).first()
    return df.withColumns(
        {
            c: F.when(F.abs(F.col(c)) == INFINITY, F.lit(means[c])).otherwise(F.col(c))
            for c in columns
        }
    )


def fit_standard(df: DataFrame, columns: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column, in one aggregate."""
    wanted = [F.avg(F.col(c)).alias(f"m_{c}") for c in columns]
    wanted += [F.stddev_pop(F.col(c)).alias(f"s_{c}") for c in columns]
    row = df.agg(*wanted).first()
    return {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}


def standardize(df: DataFrame, params: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({c: standardized(F.col(c), *p) for c, p in params.items()})
