"""Cleaning, encoding, scaling, selection and split queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import encode, nearest, oversample, prep, quantiles, selection, split, stats
from flowlens.plans.catalogue import query
from flowlens.plans.catalogue.features import (
    EXTRACT_SQL,
    extracted,
    rounded,
)
from flowlens.plans.views import table
from flowlens.schemas import CATEGORICAL_FEATURES, IP_FEATURES, NUMERIC_FEATURES
from flowlens.session import materialized, work_path

KEY = ["l_orderkey", "l_linenumber", "l_partkey"]
KEY_SQL = ", ".join(KEY)
VALUES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
# Every fourth line loses its values, so that there is something to fill.
GAPS_SQL = f"""gaps as (select {KEY_SQL}, {", ".join(
    f"case when l_linenumber % 4 = 0 then null else {c} end as {c}" for c in VALUES)},
  case when l_linenumber % 3 = 0 then null else l_returnflag end as l_returnflag
  from lineitem)"""


def gaps(spark, folder):
    hole = F.col("l_linenumber") % 4 == 0
    return table(spark, folder, "lineitem").select(
        *KEY,
        *[F.when(~hole, F.col(c)).alias(c) for c in VALUES],
        F.when(F.col("l_linenumber") % 3 != 0, F.col("l_returnflag")).alias("l_returnflag"),
    )


# --- packet feature preparation ---------------------------------------------------------

# The features with NULLs put in, as the input of the preprocessor queries.
def _with_feats() -> str:
    body = EXTRACT_SQL.removeprefix("with ")
    head, tail = body.rsplit("select packet_id,", 1)
    return (
        f"with {head.rstrip()}, raw as (select packet_id,{tail}), feats as (select * replace ("
        "case when packet_id % 7 = 0 then null else packet_size end as packet_size, "
        "case when packet_id % 11 = 0 then null else has_payload end as has_payload, "
        "case when packet_id % 13 = 0 then null else src_ip_num end as src_ip_num) from raw)"
    )


WITH_FEATS = _with_feats()


def features(spark, folder):
    df = rounded(extracted(spark, folder), [c for c in NUMERIC_FEATURES if c.startswith("flow_")
                                            and c.endswith(("duration", "pps", "bps", "mean",
                                                            "std"))])
    pid = F.col("packet_id")
    return df.withColumns(
        {
            "packet_size": F.when(pid % 7 != 0, F.col("packet_size")),
            "has_payload": F.when(pid % 11 != 0, F.col("has_payload")),
            "src_ip_num": F.when(pid % 13 != 0, F.col("src_ip_num")),
        }
    )


_IMPUTED = {c: f"coalesce({c}, avg_{c})" for c in NUMERIC_FEATURES} | {
    c: f"coalesce({c}, 0)" for c in IP_FEATURES + CATEGORICAL_FEATURES
}
_SCALED = {c: f"({e} - avg_{c}) / coalesce(nullif(sd_{c}, 0), 1)"
           for c, e in _IMPUTED.items() if c in NUMERIC_FEATURES}
_MINMAX = {c: f"(coalesce({c}, 0) - lo_{c}) / coalesce(nullif(hi_{c} - lo_{c}, 0), 1)"
           for c in IP_FEATURES}
FIT_SQL = "fit as (select " + ", ".join(
    [f"avg({c}) as avg_{c}, stddev_pop({c}) as sd_{c}" for c in NUMERIC_FEATURES]
    + [f"min({c}) as lo_{c}, max({c}) as hi_{c}" for c in IP_FEATURES]
) + " from feats)"
_FLAGS = {f"{c}_{j}": f"cast(coalesce({c}, 0) = {j} as double)"
          for c in CATEGORICAL_FEATURES for j in (0, 1) if (c, j) != ("has_payload", 1)}


def _select(expressions: dict[str, str]) -> str:
    """Rounded to six places; adding 0 makes -0.0 a plain zero."""
    return ", ".join(f"round(cast({e} as double), 6) + 0 as {c}" for c, e in expressions.items())


def _plain(df, columns):
    """The same in Spark, for the columns the SQL computes."""
    return df.select(
        "packet_id", *[(F.round(F.col(c).cast("double"), 6) + 0.0).alias(c) for c in columns]
    )


@query("impute_mean", f"{WITH_FEATS}, {FIT_SQL} select packet_id, {_select(_IMPUTED)} "
       "from feats cross join fit")  # fmt: skip
def impute_mean(spark, folder):
    df = materialized(features(spark, folder), "features")
    return _plain(prep.Preprocessor.fit(df).impute(df), _IMPUTED)


@query("minmax_ip", f"{WITH_FEATS}, {FIT_SQL} select packet_id, {_select(_MINMAX)} "
       "from feats cross join fit")  # fmt: skip
def minmax_ip(spark, folder):
    df = materialized(features(spark, folder), "features")
    fitted = prep.Preprocessor.fit(df)
    return _plain(fitted.scale_addresses(fitted.impute(df)), _MINMAX)


@query("one_hot", f"{WITH_FEATS} select packet_id, {_select(_FLAGS)} from feats")
def one_hot(spark, folder):
    df = materialized(features(spark, folder), "features")
    fitted = prep.Preprocessor.fit(df)
    return _plain(fitted.encode(fitted.impute(df)), _FLAGS)


@query("standardize", f"{WITH_FEATS}, {FIT_SQL} select packet_id, {_select(_SCALED)} "
       "from feats cross join fit")  # fmt: skip
def standardize(spark, folder):
    df = materialized(features(spark, folder), "features")
    fitted = prep.Preprocessor.fit(df)
    return _plain(fitted.standardize(fitted.impute(df)), _SCALED)


_ALL = _MINMAX | _SCALED | _FLAGS
PREPROCESS_SQL = f"{WITH_FEATS}, {FIT_SQL} select packet_id, {_select(_ALL)} from feats cross join fit"


@query("preprocess", PREPROCESS_SQL)
def preprocess(spark, folder):
    df = materialized(features(spark, folder), "features")
    fitted = prep.Preprocessor.fit(df)
    return _plain(fitted.transform(df), fitted.output_columns())


@query("preprocessor_saved", PREPROCESS_SQL)
def preprocessor_saved(spark, folder):
    """The same through a saved and reloaded preprocessor."""
    df = materialized(features(spark, folder), "features")
    path = work_path(spark, "preprocessor")
    prep.Preprocessor.fit(df).save(spark, path)
    loaded = prep.Preprocessor.load(spark, path)
    return _plain(loaded.transform(df), loaded.output_columns())


# --- corpus preparation -----------------------------------------------------------------


@query("drop_address_columns", "select l_orderkey, l_linenumber, l_quantity, "
       "l_partkey as src_ip from lineitem")  # fmt: skip
def drop_address_columns(spark, folder):
    df = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity",
        F.col("l_partkey").alias("Source IP"), F.col("l_partkey").alias("src_ip"),
    )
    return prep.drop_address_columns(df)


RATIO_SQL = """select l_orderkey, l_linenumber, l_partkey,
  case when l_linenumber = 1 then 'infinity'::double when l_linenumber = 2 then
  '-infinity'::double when l_linenumber = 3 then 'nan'::double else l_quantity end as ratio
  from lineitem"""


def ratios(spark, folder):
    line = F.col("l_linenumber")
    ratio = (
        F.when(line == 1, float("inf"))
        .when(line == 2, float("-inf"))
        .when(line == 3, float("nan"))
        .otherwise(F.col("l_quantity"))
    )
    return table(spark, folder, "lineitem").select(*KEY, ratio.alias("ratio"))


@query("null_nonfinite", f"select {KEY_SQL}, case when isfinite(ratio) then ratio end as ratio "
       f"from ({RATIO_SQL}) r")  # fmt: skip
def null_nonfinite(spark, folder):
    return prep.null_nonfinite(ratios(spark, folder))


@query("inf_to_mean", f"""with r as ({RATIO_SQL}) select {KEY_SQL},
  round(case when isinf(ratio) then m when isnan(ratio) then null else ratio end, 6) as ratio, isnan(ratio) as is_nan
  from r cross join (select avg(ratio) as m from r where isfinite(ratio)) a""")
def inf_to_mean(spark, folder):
    """NaN rows stay NaN; they are shown as such."""
    df = prep.infinite_to_mean(ratios(spark, folder), ["ratio"]).withColumn("is_nan", F.isnan("ratio"))
    return rounded(df.withColumn("ratio", F.nanvl("ratio", F.lit(None).cast("double"))), ["ratio"])


@query("fill_median", f"with {GAPS_SQL} select {KEY_SQL}, " + ", ".join(
    f"round(coalesce({c}, med_{c}), 6) as {c}" for c in VALUES)
    + " from gaps cross join (select " + ", ".join(
    f"median({c}) as med_{c}" for c in VALUES) + " from gaps) m")
def fill_median(spark, folder):
    df = prep.fill_median(gaps(spark, folder).drop("l_returnflag"), VALUES)
    return rounded(df, VALUES)


MODE_SQL = """(select l_returnflag as flag from gaps where l_returnflag is not null
  group by l_returnflag order by count(*) desc, l_returnflag limit 1)"""


@query("fill_mode", f"with {GAPS_SQL} select {KEY_SQL}, coalesce(l_returnflag, {MODE_SQL}) "
       "as l_returnflag, 'unknown' as empty from gaps")  # fmt: skip
def fill_mode(spark, folder):
    df = gaps(spark, folder).select(*KEY, "l_returnflag", F.lit(None).cast("string").alias("empty"))
    return prep.fill_mode(df)


@query("drop_nulls", f"with {GAPS_SQL} select * from gaps where l_quantity is not null "
       "and l_returnflag is not null")  # fmt: skip
def drop_nulls(spark, folder):
    return gaps(spark, folder).dropna()


@query("find_label", "select 'o_orderpriority' as label, count(distinct o_orderpriority) as classes "
       "from orders")  # fmt: skip
def find_label(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderpriority", " Attack Type ")
    label = prep.find_label(orders.columns)
    name = F.lit("o_orderpriority" if label == " Attack Type " else label)
    return orders.agg(F.count_distinct(F.col(f"`{label}`")).alias("classes")).select(
        name.alias("label"), "classes"
    )


CODES_SQL = """select l_orderkey, l_linenumber, l_partkey,
  dense_rank() over (order by l_returnflag) - 1 as l_returnflag,
  dense_rank() over (order by l_linestatus) - 1 as l_linestatus from lineitem"""


@query("label_encode", CODES_SQL)
def label_encode(spark, folder):
    df = table(spark, folder, "lineitem").select(*KEY, "l_returnflag", "l_linestatus")
    coded = encode.label_encode(df, ["l_returnflag", "l_linestatus"])
    return coded.withColumns({c: F.col(c).cast("bigint") for c in coded.columns[3:]})


@query("label_encode_many", "select page_id, url, dense_rank() over (order by url) - 1 as code "
       "from pages")  # fmt: skip
def label_encode_many(spark, folder):
    """Encoding by the table of codes, as used for long category lists."""
    pages = table(spark, folder, "pages").select("page_id", "url", F.col("url").alias("code"))
    return encode.label_encode(pages, ["code"], limit=10)


@query("encode_target", "select event_id, dense_rank() over (order by event_type) - 1 as target "
       "from events")  # fmt: skip
def encode_target(spark, folder):
    events = table(spark, folder, "events").select("event_id", F.col("event_type").alias("target"))
    return encode.label_encode(events, ["target"]).withColumn("target", F.col("target").cast("bigint"))


_BOUNDS = ", ".join(
    f"quantile_cont({c}, 0.001) as lo_{c}, quantile_cont({c}, 0.999) as hi_{c}" for c in VALUES
)
_CLIPPED = ", ".join(
    f"round(least(greatest({c}, lo_{c}), hi_{c}), 6) + 0 as {c}" for c in VALUES
)
CLIP_SQL = f"""select {KEY_SQL}, {_CLIPPED} from lineitem cross join
  (select {_BOUNDS} from lineitem) b"""


def lines(spark, folder):
    return table(spark, folder, "lineitem").select(*KEY, *VALUES)


def _rounded_values(df):
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in VALUES})


@query("clip_quantiles", CLIP_SQL)
def clip_quantiles(spark, folder):
    return _rounded_values(prep.clip_to_quantiles(lines(spark, folder), VALUES))


QUANTILES = [0.001, 0.25, 0.5, 0.999]
QUANTILES_SQL = "\nunion all\n".join(
    f"select '{c}' as name, cast({p} as double) as p, round(quantile_cont({c}, {p}), 6) + 0 "
    "as value from lineitem" for c in VALUES for p in QUANTILES
)


def _quantile_rows(spark, folder, **options):
    found = quantiles.exact_quantiles(
        lines(spark, folder), {c: QUANTILES for c in VALUES}, **options
    )
    rows = [(c, p, round(v, 6) + 0.0) for c, vs in found.items()
            for p, v in zip(QUANTILES, vs, strict=True)]
    return spark.createDataFrame(rows, "name string, p double, value double")


@query("column_quantiles", QUANTILES_SQL)
def column_quantiles(spark, folder):
    return _quantile_rows(spark, folder)


@query("column_quantiles_narrowed", QUANTILES_SQL)
def column_quantiles_narrowed(spark, folder):
    """The same by narrowing, as used on tables too large for one task per column."""
    return _quantile_rows(spark, folder, single_task_values=1000)


@query("column_modes", "select 'l_returnflag' as name, (select l_returnflag from lineitem group by "
       "l_returnflag order by count(*) desc, l_returnflag limit 1) as value union all "
       "select 'l_linestatus', (select l_linestatus from lineitem group by l_linestatus "
       "order by count(*) desc, l_linestatus limit 1)")  # fmt: skip
def column_modes(spark, folder):
    found = encode.modes(table(spark, folder, "lineitem"), ["l_returnflag", "l_linestatus"])
    return spark.createDataFrame(list(found.items()), "name string, value string")


_STATS = "\nunion all\n".join(
    f"""select '{c}' as "column", count({c}) as n, round(avg({c}), 4) as mean, min({c}) + 0 as min,
    max({c}) as max, round(stddev_pop({c}), 4) as sd_pop, round(var_samp({c}), 2) as var_samp,
    round(corr({c}, l_quantity), 6) as corr from lineitem""" for c in VALUES
)


@query("column_stats", _STATS)
def column_stats(spark, folder):
    rows = quantiles.column_stats(table(spark, folder, "lineitem"), VALUES, "l_quantity")
    return rounded(rounded(rounded(rows, ["mean", "sd_pop"], 4), ["var_samp"], 2), ["corr"]).withColumn(
        "min", F.col("min") + 0.0
    )


@query("standardize_matrix", f"""with c as ({CLIP_SQL}) select {KEY_SQL}, {", ".join(
    f"round(({c} - m_{c}) / s_{c}, 6) + 0 as {c}" for c in VALUES)} from c cross join (select
    {", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in VALUES)} from c) f""")
def standardize_matrix(spark, folder):
    df = _rounded_values(prep.clip_to_quantiles(lines(spark, folder), VALUES))
    return _rounded_values(prep.standardize(df, prep.fit_standard(df, VALUES)))


# --- split, balance, selection ----------------------------------------------------------

SIZES_SQL = """with sizes as (select event_type, count(*) as n from events group by event_type),
 total as (select cast(sum(n) as bigint) as n from sizes),
 held as (select event_type, s.n, floor(s.n * h / t.n) as base, s.n * h / t.n - floor(s.n * h / t.n)
          as part, h from sizes s, (select n, ceil(n * 0.2) as h from total) t),
 held2 as (select event_type, n, h, cast(base + case when row_number() over
          (order by part desc, event_type) <= h - (select sum(base) from held) then 1 else 0 end
          as bigint) as held from held),
 test as (select *, held * k / h as exact, k from held2, (select ceil(max(h) * 0.5) as k from held2) x),
 test2 as (select event_type, n, held, cast(floor(exact) + case when row_number() over
          (order by exact - floor(exact) desc, event_type)
          <= k - (select sum(floor(exact)) from test) then 1 else 0 end as bigint) as tested
          from test)
select event_type, 'train' as split, n - held as n from test2
union all select event_type, 'validation', held - tested from test2
union all select event_type, 'test', tested from test2"""


@query("split_sizes", SIZES_SQL)
def split_sizes(spark, folder):
    parts = split.stratified_split(table(spark, folder, "events"), "event_type", "event_id")
    return parts.groupBy("event_type", "split").agg(F.count(F.lit(1)).alias("n"))


@query("split_rows", """select event_id, event_type, true as in_one_part from events""")
def split_rows(spark, folder):
    """Every row once, in one of the three parts (their sizes: ``split_sizes``)."""
    parts = split.stratified_split(table(spark, folder, "events"), "event_type", "event_id")
    return parts.select("event_id", "event_type", F.col("split").isin(*split.PARTS).alias("in_one_part"))


@query("oversample_counts", """select label, max(n) over () as n from
  (select label, count(*) as n from embeddings group by label) c""")
def oversample_counts(spark, folder):
    return stats.class_balance(oversampled(spark, folder), "label")


def oversampled(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return oversample.balance_classes(vectors, "label", "embedding", "vec_id")


@query("oversample_toxic_counts", """select toxic, max(n) over () as n from
  (select toxic, count(*) as n from labels group by toxic) c""")
def oversample_toxic_counts(spark, folder):
    """A strongly imbalanced label over short vectors with many copies."""
    docs = table(spark, folder, "documents").select("doc_id", "n_chars")
    rows = table(spark, folder, "labels").join(docs, "doc_id")
    vector = F.array(F.log1p(F.col("n_chars").cast("double")), F.col("quality").cast("double"))
    rows = rows.withColumn("features", vector)
    balanced = oversample.balance_classes(rows, "toxic", "features", "doc_id", cell_rows=64)
    return stats.class_balance(balanced, "toxic")


@query("class_neighbours", """with d as (select a.label, a.vec_id, list_distance(a.embedding::double[], b.embedding::double[]) as d
  from embeddings a join embeddings b on a.label = b.label and a.vec_id <> b.vec_id)
  select label, vec_id, rank, round(d, 6) as distance from (select *, row_number() over
    (partition by vec_id order by d) as rank from d) r where rank <= 5""")
def class_neighbours(spark, folder):
    """The distances of every vector's five nearest ones of its class, by cells of at most 256 vectors."""
    found, rows = vector_neighbours(spark, folder)
    lines = found.join(rows, ["label", "embedding"]).select("label", "vec_id", F.posexplode("near").alias("at", "x"))
    distance = F.round(F.sqrt(F.col("x")["d"]), 6)
    return lines.select("label", "vec_id", (F.col("at") + 1).cast("bigint").alias("rank"), distance.alias("distance"))


def vector_neighbours(spark, folder):
    """Each vector's neighbours, a vector of several rows as often as it has rows; and all rows."""
    rows = table(spark, folder, "embeddings").where(F.col("label").isNotNull() & F.col("embedding").isNotNull())
    rows = rows.select("label", "vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    points = rows.groupBy("label", "embedding").agg(F.count(F.lit(1)).alias("_rows"), F.lit(1).cast("bigint").alias("_copies"))
    found = nearest.nearest_in_class(points, "label", "embedding", k=5, cell_rows=256)
    one_each = F.flatten(F.transform("near", lambda x: F.array_repeat(x, F.least(x["n"], F.lit(5)).cast("int"))))
    return found.withColumn("near", F.slice(one_each, 1, 5)), rows


@query("oversample_rows", """with n as (select label, count(*) as n from embeddings group by label)
  select label, max(n) over () - n as n_synthetic, true as of_its_width, true as between_neighbours from n""")
def oversample_rows(spark, folder):
    """Synthetic rows per class; each lies between a row of its class and one of its five nearest.

    What the nearest ones are is compared with SQL by ``class_neighbours``.
    """
    vectors = table(spark, folder, "embeddings")
    rows = oversample.balance_classes(vectors, "label", "embedding", "vec_id", traced=True)
    found, _ = vector_neighbours(spark, folder)
    found = found.select("label", F.col("embedding").alias("base"), F.transform("near", lambda x: x["v"]).alias("near"))
    rows = rows.join(found, ["label", "base"], "left")
    length = lambda a, b: F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))
    detour = length("base", "embedding") + length("embedding", "other") - length("base", "other")
    between = F.array_contains("near", F.col("other")) & (detour <= 1e-6)
    return rows.groupBy("label").agg(
        F.count_if("synthetic").alias("n_synthetic"),
        F.every(F.size("embedding") == 64).alias("of_its_width"),
        F.coalesce(F.every(F.when(F.col("synthetic"), F.coalesce(between, F.lit(False)))), F.lit(True)).alias("between_neighbours"),
    )


def _score_sql(expression: str, digits: int) -> str:
    return "\nunion all\n".join(
        f"select '{c}' as feature, round({expression.format(c=c)}, {digits}) as score from lineitem"
        for c in ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    )


SELECTED = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


@query("select_by_corr", f"select * from ({_score_sql('abs(corr({c}, l_extendedprice))', 6)}) s "
       "order by score desc, feature limit 3")  # fmt: skip
def select_by_corr(spark, folder):
    scores = selection.correlation_scores(
        table(spark, folder, "lineitem"), SELECTED, "l_extendedprice"
    )
    return selection.top(rounded(scores, ["score"]), 3)


@query("select_by_variance", f"select * from ({_score_sql('var_samp({c})', 6)}) s "
       "order by score desc, feature limit 3")  # fmt: skip
def select_by_variance(spark, folder):
    scores = selection.variance_scores(table(spark, folder, "lineitem"), SELECTED)
    return selection.top(rounded(scores, ["score"]), 3)


@query("select_dispatch", f"""select 'correlation' as method, feature from (select * from
 ({_score_sql("abs(corr({c}, l_extendedprice))", 9)}) s order by score desc, feature limit 2) a
 union all select 'variance', feature from (select * from
 ({_score_sql("var_samp({c})", 9)}) s order by score desc, feature limit 2) b
 union all select 'unknown', unnest({SELECTED})""")
def select_dispatch(spark, folder):
    df = table(spark, folder, "lineitem")
    chosen = []
    for method, n in (("correlation", 2), ("variance", 2), ("unknown", None)):
        names, _ = selection.select_features(df, SELECTED, "l_extendedprice", method, n)
        chosen += [(method, name) for name in names]
    return spark.createDataFrame(chosen, "method string, feature string")


