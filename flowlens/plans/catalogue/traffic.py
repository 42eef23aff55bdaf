"""Statistics, scans, filters and latest-n queries over packets."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import filters, stats
from flowlens.operators.filters import Rule
from flowlens.plans.catalogue import query
from flowlens.plans.views import WITH_PACKETS, packets, table
from flowlens.session import materialized

RULES = [Rule("ip", "src_ip", "192.168.1.1"), Rule("port", "dst_port", 53)]
PACKET_COLUMNS = (
    "packet_id", "t_us", "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "packet_size",
)
COLUMNS_SQL = ", ".join(PACKET_COLUMNS)
LAST_N = 1000

STATS_SQL = f"{WITH_PACKETS}\n" + "\nunion all\n".join(
    f"select '{d}' as dimension, cast({d} as varchar) as value, count(*) as n, "
    f"min(packet_id) as first_seen from packets where {d} is not null and {skip} group by {d}"
    for d, skip in [
        ("protocol", "protocol <> ''"),
        ("src_ip", "src_ip <> ''"),
        ("dst_ip", "dst_ip <> ''"),
        ("src_port", "src_port <> 0"),
        ("dst_port", "dst_port <> 0"),
    ]
) + (
    "\nunion all select 'total', cast(null as varchar), count(*), min(packet_id) from packets"
)


@query("packet_stats", STATS_SQL)
def packet_stats(spark, folder):
    return stats.packet_stats(packets(spark, folder))


SYN_SCAN = """select src_ip, count(*) as n from packets
where protocol = 'tcp' and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0 and src_ip <> ''
group by src_ip"""


@query("syn_scan", f"{WITH_PACKETS} {SYN_SCAN}")
def syn_scan(spark, folder):
    return stats.syn_scan(packets(spark, folder))


def _port_scan_sql(protocol: str) -> str:
    return (
        "select src_ip, dst_ip, count(distinct dst_port) as n_ports, "
        "array_to_string(list_sort(list(distinct dst_port)), ',') as ports from packets "
        f"where protocol = '{protocol}' and src_ip <> '' and dst_ip <> '' and dst_port <> 0 "
        "group by src_ip, dst_ip"
    )


def _ports_as_text(df):
    return df.withColumn("ports", F.array_join("ports", ","))


@query("port_scan_tcp", f"{WITH_PACKETS} {_port_scan_sql('tcp')}")
def port_scan_tcp(spark, folder):
    return _ports_as_text(stats.port_scan(packets(spark, folder), "tcp"))


@query("port_scan_udp", f"{WITH_PACKETS} {_port_scan_sql('udp')}")
def port_scan_udp(spark, folder):
    return _ports_as_text(stats.port_scan(packets(spark, folder), "udp"))


@query(
    "scan_union",
    f"""{WITH_PACKETS}
select 'syn_scan' as kind, src_ip, cast(null as varchar) as dst_ip, n,
       cast(null as varchar) as ports from ({SYN_SCAN}) s
union all select 'port_scan', src_ip, dst_ip, n_ports, ports from ({_port_scan_sql("tcp")}) t
union all select 'udp_scan', src_ip, dst_ip, n_ports, ports from ({_port_scan_sql("udp")}) u""",
)
def scan_union(spark, folder):
    return _ports_as_text(stats.scan_report(packets(spark, folder)))


@query("scan_suspects", f"""{WITH_PACKETS} select src_ip, dst_ip from packets
  where protocol = 'tcp' and dst_port <> 0 group by src_ip, dst_ip
  having count(distinct dst_port) >= 10""")
def scan_suspects(spark, folder):
    """Pairs of 10 ports and more; those within the sketch's error are counted again."""
    return stats.scan_suspects(packets(spark, folder), threshold=10).select("src_ip", "dst_ip")


def _rolled_sql(name, length_us):
    return f"""select '{name}' as span, make_timestamp(t_us // {length_us} * {length_us}) as window_start, protocol,
  src_ip, dst_ip, count(*) as packets, count(distinct nullif(dst_port, 0)) as n_ports from packets group by all"""


@query("scan_sketches", f"""{WITH_PACKETS} {_rolled_sql("hour", 3_600_000_000)}
  union all {_rolled_sql("day", 86_400_000_000)}""")
def scan_sketches(spark, folder):
    """Ports per hour and day, from stored sketches per minute: hours from minutes, days from hours."""
    timed = packets(spark, folder).withColumn("timestamp", F.timestamp_micros("t_us"))
    minutes = materialized(stats.port_sketches(timed), "minute-sketches")
    hours = materialized(stats.rolled_up(minutes, "1 hour"), "hour-sketches")
    spans = [hours.withColumn("span", F.lit("hour")), stats.rolled_up(hours, "1 day").withColumn("span", F.lit("day"))]
    counted = stats.port_counts(spans[0].unionByName(spans[1])).drop("ports")
    return counted.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("distinct_ports",
       f"{WITH_PACKETS} select distinct dst_port from packets where dst_port <> 0")
def distinct_ports(spark, folder):
    return stats.distinct_ports(packets(spark, folder))


RULES_SQL = "src_ip = '192.168.1.1' or dst_port = 53"


@query("rule_filter", f"{WITH_PACKETS} select {COLUMNS_SQL} from packets where {RULES_SQL}")
def rule_filter(spark, folder):
    return filters.rule_filter(packets(spark, folder), RULES).select(*PACKET_COLUMNS)


@query(
    "rule_edit",
    f"{WITH_PACKETS} select {COLUMNS_SQL} from packets where dst_port = 53 or protocol = 'icmp'",
)
def rule_edit(spark, folder):
    rules = filters.add_rule(RULES, Rule("protocol", "", "icmp"))
    rules = filters.remove_rule(rules, RULES[0])
    rules = filters.remove_rule(rules, Rule("ip", "src_ip", "not listed"))
    return filters.rule_filter(packets(spark, folder), rules).select(*PACKET_COLUMNS)


RULE_TABLE_SQL = f"""{WITH_PACKETS}, rules as (
      select 'ip' as type, 'src_ip' as field, src_ip as value from packets
      where protocol = 'udp' and src_ip like '10.%' group by src_ip having count(*) > 11
      union all select 'port', 'dst_port', '80'),
    facts as (select packet_id, unnest(['src_ip', 'dst_ip', 'src_port', 'dst_port', 'protocol']) as field,
      unnest([src_ip, dst_ip, cast(src_port as varchar), cast(dst_port as varchar), protocol])
      as value from packets)
    select {COLUMNS_SQL} from packets where packet_id in
      (select packet_id from facts join rules using (field, value))"""


def busy_rules(spark, folder):
    """Packets and a rule table made of them."""
    df = packets(spark, folder)
    busy = df.where((F.col("protocol") == "udp") & F.col("src_ip").like("10.%"))
    busy = busy.groupBy("src_ip").count().where(F.col("count") > 11)
    rules = busy.select(F.lit("ip").alias("type"), F.lit("src_ip").alias("field"),
                        F.col("src_ip").alias("value"))
    return df, rules.union(spark.createDataFrame([("port", "dst_port", "80")], rules.schema))


@query("rule_semi_join", RULE_TABLE_SQL)
def rule_semi_join(spark, folder):
    return filters.rule_table_filter(*busy_rules(spark, folder)).select(*PACKET_COLUMNS)


@query("rule_semi_join_large", RULE_TABLE_SQL)
def rule_semi_join_large(spark, folder):
    """As for a rule table too large to be broadcast."""
    return filters.rule_table_filter(*busy_rules(spark, folder), broadcast_rows=0).select(*PACKET_COLUMNS)


@query(
    "syn_only",
    f"{WITH_PACKETS} select {COLUMNS_SQL} from packets "
    "where protocol = 'tcp' and tcp_flags & 2 <> 0 and tcp_flags & 16 = 0",
)
def syn_only(spark, folder):
    df = packets(spark, folder)
    return df.where(filters.syn_only(df)).select(*PACKET_COLUMNS)


IP_NUMBER_SQL = "case protocol when 'tcp' then 6 when 'udp' then 17 else 1 end"


@query(
    "ui_filter",
    f"{WITH_PACKETS} select {COLUMNS_SQL} from packets where {IP_NUMBER_SQL} = 17 and "
    "contains(lower(concat_ws(' ', src_ip, dst_ip, protocol)), '1.3')",
)
def ui_filter(spark, folder):
    df = packets(spark, folder)
    number = F.when(F.col("protocol") == "tcp", 6).when(F.col("protocol") == "udp", 17)
    df = df.withColumn("ip_protocol", number.otherwise(1))
    return filters.display_filter(df, text="1.3", ip_protocol=17).select(*PACKET_COLUMNS)


@query("last_packets", f"{WITH_PACKETS} select {COLUMNS_SQL} from packets "
       f"order by t_us desc, packet_id desc limit {LAST_N}")  # fmt: skip
def last_packets(spark, folder):
    return stats.latest(packets(spark, folder), LAST_N).select(*PACKET_COLUMNS)


@query("last_filtered", f"{WITH_PACKETS} select {COLUMNS_SQL} from packets where {RULES_SQL} "
       f"order by t_us desc, packet_id desc limit {LAST_N}")  # fmt: skip
def last_filtered(spark, folder):
    matching = filters.rule_filter(packets(spark, folder), RULES)
    return stats.latest(matching, LAST_N).select(*PACKET_COLUMNS)


@query(
    "latest_per_source",
    f"""{WITH_PACKETS} select src_ip, packet_id, t_us, rank from (
      select *, cast(row_number() over (partition by src_ip order by t_us desc, packet_id desc)
                     as integer) as rank from packets) r where rank <= 5""",
)
def latest_per_source(spark, folder):
    recent = stats.latest_per_key(packets(spark, folder), "src_ip", 5)
    return recent.select("src_ip", "packet_id", "t_us", "rank")


@query(
    "append_packets",
    f"""{WITH_PACKETS} select packet_id, src_ip, dst_ip, label from packets where protocol = 'tcp'
    union all select packet_id, src_ip, cast(null as varchar), cast(null as varchar)
    from packets where protocol <> 'tcp'""",
)
def append_packets(spark, folder):
    df = packets(spark, folder)
    first = df.where("protocol = 'tcp'").select("packet_id", "src_ip", "dst_ip", "label")
    return stats.append(first, df.where("protocol <> 'tcp'").select("packet_id", "src_ip"))


RESET_US = 1_704_067_200_000_000 + 1_000_000_000


@query("packets_since",
       f"{WITH_PACKETS} select {COLUMNS_SQL} from packets where t_us >= {RESET_US}")
def packets_since(spark, folder):
    return stats.since(packets(spark, folder), RESET_US).select(*PACKET_COLUMNS)


@query(
    "packet_table",
    f"""{WITH_PACKETS} select packet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time, src_ip, dst_ip,
    protocol, cast(packet_size as varchar) as size from packets""",
)
def packet_table(spark, folder):
    return stats.packet_table(packets(spark, folder), "ts")


@query(
    "op_timing",
    """select event_type as name, count(*) as count, round(sum(value), 4) as total_duration,
    min(value) as min_duration, max(value) as max_duration, round(avg(value), 6) as avg_duration
    from events group by event_type""",
)
def op_timing(spark, folder):
    timings = table(spark, folder, "events").select(
        F.col("event_type").alias("name"), F.col("value").alias("duration")
    )
    rollup = stats.operation_timing(timings)
    return rollup.withColumns(
        {
            "total_duration": F.round("total_duration", 4),
            "avg_duration": F.round("avg_duration", 6),
        }
    )


@query("log_tail", "select conv_id, turn, role, text from conversations "
       "order by conv_id desc, turn desc limit 100")  # fmt: skip
def log_tail(spark, folder):
    log = table(spark, folder, "conversations")
    return stats.latest(log, 100, time="conv_id", tie="turn")


@query("traffic_distribution",
       f"{WITH_PACKETS} select protocol, count(*) as n from packets group by protocol")
def traffic_distribution(spark, folder):
    return stats.distribution(packets(spark, folder), "protocol")


@query("class_balance",
       f"{WITH_PACKETS} select label, count(*) as n from packets group by label")
def class_balance(spark, folder):
    return stats.class_balance(packets(spark, folder), "label")
