"""Flow, packet, time and generated features, and text checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import network as N
from flowlens.operators import features as X
from flowlens.operators import flows
from flowlens.plans.catalogue import query
from flowlens.plans.views import WITH_PACKETS, packets, table
from flowlens.schemas import ALL_FEATURES, FLOW_FEATURES

# --- SQL of the derived tables ----------------------------------------------------------

KEYED = """keyed as (
select *, case when a < b then a || '-' || b else b || '-' || a end || '-' || lower(protocol)
          as flow_key
from (select *, src_ip || ':' || coalesce(src_port, 0) as a,
                dst_ip || ':' || coalesce(dst_port, 0) as b from packets) k)"""
SESSIONS = """sessions as (
select *, cast(1 + sum(brk) over (partition by flow_key order by t_us, packet_id
               rows between unbounded preceding and current row) as bigint) as flow_session
from (select *, case when t_us - lag(t_us) over (partition by flow_key order by t_us, packet_id)
                     > 60000000 then 1 else 0 end as brk from keyed) g)"""
_RUN = """(partition by flow_key, flow_session order by t_us, packet_id
           rows between unbounded preceding and current row)"""
RUNNING = f"""running as (
select *, greatest(0.001e0, (t_us - start_us) / 1e6) as flow_duration from (
select *, count(*) over {_RUN} as flow_packets, sum(packet_size) over {_RUN} as s,
  sum(packet_size * packet_size) over {_RUN} as ss, min(packet_size) over {_RUN} as lo,
  max(packet_size) over {_RUN} as hi, min(t_us) over {_RUN} as start_us from sessions) r)"""
WITH_RUNNING = f"{WITH_PACKETS}, {KEYED}, {SESSIONS}, {RUNNING}"
FLOW_COLUMNS = """round(flow_duration, 6) as flow_duration, flow_packets,
  cast(s as bigint) as flow_bytes, round(flow_packets / flow_duration, 6) as flow_rate_pps,
  round(cast(s as double) / flow_duration, 6) as flow_rate_bps,
  round(cast(s as double) / flow_packets, 6) as flow_packet_size_mean,
  round(sqrt(cast(flow_packets * ss - s * s as double)) / flow_packets, 6)
    as flow_packet_size_std,
  lo as flow_packet_size_min, hi as flow_packet_size_max"""


def _ip_sql(c: str) -> str:
    parts = [f"cast(split_part({c}, '.', {i}) as double)" for i in range(1, 5)]
    return f"(({parts[0]} * 256 + {parts[1]}) * 256 + {parts[2]}) * 256 + {parts[3]}"


BASIC_COLUMNS = f"""{_ip_sql("src_ip")} as src_ip_num, {_ip_sql("dst_ip")} as dst_ip_num,
  coalesce(src_port, 0) as src_port, coalesce(dst_port, 0) as dst_port,
  cast(protocol = 'tcp' as integer) as protocol_tcp,
  cast(protocol = 'udp' as integer) as protocol_udp,
  cast(protocol = 'icmp' as integer) as protocol_icmp, packet_size, 0 as has_payload"""
TIME_COLUMNS = """cast(hour(ts) as integer) as time_hour, cast(minute(ts) as integer) as time_minute,
  cast(second(ts) as integer) as time_second, cast(isodow(ts) - 1 as integer)
  as time_day_of_week, cast(isodow(ts) >= 6 as integer) as time_is_weekend"""


def rounded(df, columns, digits=6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


REAL_FLOW = [c for c in FLOW_FEATURES if c.endswith(("duration", "pps", "bps", "mean", "std"))]


def keyed(spark, folder):
    return X.with_flow_key(packets(spark, folder))


# --- flows ------------------------------------------------------------------------------


@query("flow_key", f"{WITH_PACKETS}, {KEYED} select packet_id, flow_key from keyed")
def flow_key(spark, folder):
    return keyed(spark, folder).select("packet_id", "flow_key")


@query("flow_sessions",
       f"{WITH_PACKETS}, {KEYED}, {SESSIONS} select packet_id, flow_key, flow_session "
       "from sessions")  # fmt: skip
def flow_sessions(spark, folder):
    sessions = flows.flow_sessions(keyed(spark, folder))
    return sessions.select("packet_id", "flow_key", "flow_session")


RUNNING_SQL = f"{WITH_RUNNING} select packet_id, flow_key, flow_session, {FLOW_COLUMNS} from running"


def running(spark, folder, **options):
    df = flows.running_flows(keyed(spark, folder), **options)
    df = df.select("packet_id", "flow_key", "flow_session", *FLOW_FEATURES)
    return rounded(df, REAL_FLOW)


@query("flow_running", RUNNING_SQL)
def flow_running(spark, folder):
    return running(spark, folder)


@query("flow_running_sliced", RUNNING_SQL)
def flow_running_sliced(spark, folder):
    """The same, with every flow of more than 3 packets treated as a hot one."""
    return running(spark, folder, hot_rows=3, slice_s=50.0)


@query("flow_running_by_rows", RUNNING_SQL)
def flow_running_by_rows(spark, folder):
    """The same, with flows of more than 3 packets cut into slices of about 4 rows."""
    return running(spark, folder, hot_rows=3, slice_rows=4)


SUMMARY_COLUMNS = """min(t_us) as start_us, max(t_us) as end_us, count(*) as flow_packets,
  cast(sum(packet_size) as bigint) as flow_bytes,
  greatest(0.001e0, (max(t_us) - min(t_us)) / 1e6) as flow_duration,
  round(avg(packet_size), 6) as flow_packet_size_mean,
  round(stddev_pop(packet_size), 6) as flow_packet_size_std,
  min(packet_size) as flow_packet_size_min, max(packet_size) as flow_packet_size_max"""
SUMMARY_SQL = f"""{WITH_PACKETS}, {KEYED}, {SESSIONS}
select flow_key, flow_session, start_us, end_us, flow_packets, flow_bytes, flow_packet_size_mean,
  flow_packet_size_std, flow_packet_size_min, flow_packet_size_max,
  round(flow_duration, 6) as flow_duration,
  round(flow_packets / flow_duration, 6) as flow_rate_pps,
  round(flow_bytes / flow_duration, 6) as flow_rate_bps
from (select flow_key, flow_session, {SUMMARY_COLUMNS} from sessions
      group by flow_key, flow_session) s"""


@query("flow_summary", SUMMARY_SQL)
def flow_summary(spark, folder):
    return rounded(flows.flow_summary(keyed(spark, folder)), REAL_FLOW)


# --- packet and time features -----------------------------------------------------------


@query("basic_features", f"{WITH_PACKETS} select packet_id, {BASIC_COLUMNS} from packets")
def basic_features(spark, folder):
    from flowlens.schemas import BASIC_FEATURES

    return X.basic_features(packets(spark, folder)).select("packet_id", *BASIC_FEATURES)


@query("payload_features", f"""{WITH_PACKETS} select packet_id, cast(packet_id % 5 not in (0, 1) and length(event_type) > 0 as integer) as has_payload
  from packets""")
def payload_features(spark, folder):
    """Packets with bytes, without any, and with an empty payload."""
    which = F.col("packet_id") % 5
    data = F.when(which == 0, None).when(which == 1, F.lit(b"")).otherwise(F.col("event_type").cast("binary"))
    return X.basic_features(packets(spark, folder).withColumn("data", data)).select("packet_id", "has_payload")


@query("time_features", f"{WITH_PACKETS} select packet_id, {TIME_COLUMNS} from packets")
def time_features(spark, folder):
    from flowlens.schemas import TIME_FEATURES

    return X.time_features(packets(spark, folder), "ts").select("packet_id", *TIME_FEATURES)


BINS = """case when time_hour < 6 then 0 when time_hour < 12 then 1 when time_hour < 18 then 2
  else 3 end as time_of_day,
  case when time_hour < 8 then 0 when time_hour < 16 then 1 else 2 end as time_period"""


@query("time_bins", f"select event_id, time_hour, {BINS} from "
       "(select event_id, cast(hour(ts) as integer) as time_hour from events) e")  # fmt: skip
def time_bins(spark, folder):
    hours = table(spark, folder, "events").select("event_id", F.hour("ts").alias("time_hour"))
    return X.time_bins(hours)


EXTRACT_SQL = (
    f"{WITH_RUNNING} select packet_id, {BASIC_COLUMNS}, {FLOW_COLUMNS}, {TIME_COLUMNS} from running"
)


def extracted(spark, folder):
    return X.extract_features(packets(spark, folder), timestamp="ts")


@query("extract_features", EXTRACT_SQL)
def extract_features(spark, folder):
    return rounded(extracted(spark, folder), REAL_FLOW)


LINE = "select l_orderkey, l_linenumber, l_quantity, l_tax, l_discount from lineitem"


def line_values(spark, folder):
    return table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_quantity", "l_tax", "l_discount"
    )


POLY_INPUTS = ["l_quantity", "l_tax"]
POLY = ", ".join(
    [f"round({c} * {c}, 6) as {c}_squared" for c in POLY_INPUTS]
    + [f"round({c} * {c} * {c}, 6) as {c}_cubed" for c in POLY_INPUTS]
)


@query("poly_features", f"select l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, {POLY} "
       "from lineitem")  # fmt: skip
def poly_features(spark, folder):
    made = X.polynomial_features(line_values(spark, folder), POLY_INPUTS)
    return rounded(made, [c for c in made.columns if c.endswith(("_squared", "_cubed"))])


@query(
    "interactions",
    "select l_orderkey, l_linenumber, l_quantity, l_tax, l_discount, "
    "round(l_quantity * l_tax, 6) as l_quantity_x_l_tax, "
    "round(l_quantity * l_discount, 6) + 0 as l_quantity_x_l_discount, "
    "round(l_tax * l_discount, 6) + 0 as l_tax_x_l_discount from lineitem",
)
def interactions(spark, folder):
    made = X.interaction_features(line_values(spark, folder), ["l_quantity", "l_tax", "l_discount"])
    new = [c for c in made.columns if "_x_" in c]
    return rounded(made, new).withColumns({c: F.round(c, 6) + F.lit(0.0) for c in new})


GEN = ["packet_size", "time_hour"]
GEN_WIDE = GEN + [f"{c}_squared" for c in GEN] + [f"{c}_cubed" for c in GEN]
_GEN_PAIRS = [(a, b) for i, a in enumerate(GEN_WIDE) for b in GEN_WIDE[i + 1 :]]


@query(
    "generate_features",
    f"""{WITH_PACKETS}, base as (select packet_id, packet_size, cast(hour(ts) as integer) as time_hour
        from packets), powers as (select *, {", ".join(
        [f"cast({c} as double) * {c} as {c}_squared" for c in GEN]
        + [f"cast({c} as double) * {c} * {c} as {c}_cubed" for c in GEN])} from base)
    select *, {", ".join(f"cast({a} as double) * {b} as {a}_x_{b}" for a, b in _GEN_PAIRS)},
    {BINS} from powers""",
)
def generate_features(spark, folder):
    base = packets(spark, folder).select("packet_id", "packet_size", F.hour("ts").alias("time_hour"))
    return X.generate_features(base, GEN)


# Small whole numbers, whose sums of products are exact in any order.
SMALL = ["protocol_tcp", "protocol_udp", "time_hour", "time_minute", "time_day_of_week",
         "time_is_weekend"]
_POWERS = " + ".join(f"{c}**{k}" for c in SMALL for k in (1, 2, 3))
_SQUARES = " + ".join(f"{c}**{k}" for c in SMALL for k in (2, 4, 6))


@query("generate_all_features", f"""{WITH_PACKETS}, f as (select packet_id, {BASIC_COLUMNS},
  {TIME_COLUMNS} from packets), p as (select packet_id, {_POWERS} as s, {_SQUARES} as q from f)
 select packet_id, s + (s * s - q) / 2 as small_sum, 2415 as n_columns from p""")
def generate_all_features(spark, folder):
    """All 23 features to 2,415 numbers, and the sum over the small ones' 171.

    The sum of all products of pairs is half of (sum squared minus sum of squares).
    """
    made = X.with_generated(extracted(spark, folder), ALL_FEATURES, {"n": lambda values, none: (~none).sum(axis=0)})
    return made.select(
        "packet_id",
        F.aggregate(X.generated_vector(SMALL), F.lit(0.0), lambda t, v: t + v).alias("small_sum"),
        F.col("n").cast("int").alias("n_columns"),
    )


_WHOLE_SQL = ", ".join(f"cast(floor(round({c}, 6)) as bigint) % 97" for c in ALL_FEATURES)
_WIDE = ALL_FEATURES + [f"{c}_squared" for c in ALL_FEATURES] + [f"{c}_cubed" for c in ALL_FEATURES]
_WIDE_SQL = ", ".join(f"'{c}'" for c in _WIDE)


@query("generate_all_wide", f"""with f as ({EXTRACT_SQL}), v as (select [{_WHOLE_SQL}] as x from f),
  w as (select list_concat(x, [i * i for i in x], [i * i * i for i in x]) as p from v),
  names as (select [{_WIDE_SQL}] as n),
  places as (select unnest(range(1, {len(_WIDE) + 1})) as i),
  totals as (select n[i] as name, sum(p[i]) as total from w cross join places cross join names group by all
    union all select n[a.i] || '_x_' || n[b.i], sum(p[a.i] * p[b.i]) from w cross join places a join places b on a.i < b.i
    cross join names group by all)
  select name, total::bigint as total from totals""")
def generate_all_wide(spark, folder):
    """Sums of all 2,415 generated columns, over features made whole numbers below 97, so that they are exact."""
    whole = [F.pmod(F.floor(F.round(F.col(c), 6)).cast("bigint"), F.lit(97)).cast("double").alias(c) for c in ALL_FEATURES]
    made = extracted(spark, folder).select(*whole).select(F.posexplode(X.generated_vector(ALL_FEATURES)).alias("place", "value"))
    totals = made.groupBy("place").agg(F.sum(F.col("value").cast("bigint")).alias("total"))
    names = F.array(*[F.lit(n) for n in X.generated_names(ALL_FEATURES)])
    return totals.select(F.get(names, F.col("place")).alias("name"), "total")


# --- text checks ------------------------------------------------------------------------

HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#:]*)', 1)"
HOST_OK = N.HOSTNAME.replace("'", "''")


@query("valid_ip", f"""{WITH_PACKETS}, texts as (
  select packet_id, src_ip as text from packets union all
  select packet_id, replace(src_ip, '10.0.', '010.0.') from packets union all
  select packet_id, concat(dst_ip, cast(packet_size as varchar)) from packets)
select packet_id, text, regexp_full_match(text, '{N.IPV4}') as valid from texts""")
def valid_ip(spark, folder):
    df = packets(spark, folder)
    texts = [
        F.col("src_ip"),
        F.replace(F.col("src_ip"), F.lit("10.0."), F.lit("010.0.")),
        F.concat("dst_ip", F.col("packet_size").cast("string")),
    ]
    rows = df.select("packet_id", F.explode(F.array(*texts)).alias("text"))
    return rows.withColumn("valid", N.is_valid_ip(F.col("text")))


@query("valid_hostname", f"select page_id, host, regexp_matches(host, '{HOST_OK}') "
       f"and length(host) <= 255 as valid from (select page_id, {HOST_SQL} as host from pages "
       "union all select page_id, url from pages) p")  # fmt: skip
def valid_hostname(spark, folder):
    pages = table(spark, folder, "pages")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#:]*)", 1)
    rows = pages.select("page_id", F.explode(F.array(host, F.col("url"))).alias("host"))
    return rows.withColumn("valid", N.is_valid_hostname(F.col("host")))


@query("valid_port", f"{WITH_PACKETS} select packet_id, port, port between 1 and 65535 as valid "
       "from (select packet_id, src_port * 2 - 2048 as port from packets) p")  # fmt: skip
def valid_port(spark, folder):
    ports = packets(spark, folder).select("packet_id", (F.col("src_port") * 2 - 2048).alias("port"))
    return ports.withColumn("valid", N.is_valid_port(F.col("port")))


_LISTED = " or ".join(
    "contains(command, '{}')".format(text.replace("'", "''")) for text in N.DANGEROUS_COMMANDS
)


@query("suspicious_command", f"""select conv_id, turn, command,
  not regexp_full_match(command, '[a-zA-Z0-9_\\-\\./\\s\\p{{Z}}]+') or {_LISTED} as suspicious
from (select conv_id, turn, concat(role, case when turn % 3 = 0 then ' rm -rf /tmp'
      when turn % 3 = 1 then ' ls -la /' else ' | sh' end) as command from conversations
      union all select conv_id, turn, text from conversations) c""")
def suspicious_command(spark, folder):
    turns = table(spark, folder, "conversations")
    third = F.col("turn") % 3
    end = F.when(third == 0, " rm -rf /tmp").when(third == 1, " ls -la /").otherwise(" | sh")
    texts = F.array(F.concat("role", end), F.col("text"))
    rows = turns.select("conv_id", "turn", F.explode(texts).alias("command"))
    return rows.withColumn("suspicious", N.is_suspicious_command(F.col("command")))


@query("scrub_text", "select page_id, translate(html, ';<>&|', '') as clean from pages union all "
       "select doc_id, translate(text, ';<>&|', '') from documents")  # fmt: skip
def scrub_text(spark, folder):
    pages = table(spark, folder, "pages").select("page_id", N.scrub(F.col("html")).alias("clean"))
    docs = table(spark, folder, "documents")
    return pages.union(docs.select("doc_id", N.scrub(F.col("text"))))
