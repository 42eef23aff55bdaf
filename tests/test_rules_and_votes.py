import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluation, feedback, filters, scoring, stats
from flowlens.operators.filters import Rule

PACKETS = "packet_id bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol string"


@pytest.fixture(scope="module")
def packets(spark):
    rows = [
        (1, "192.168.1.1", "192.168.1.2", 12345, 80, "tcp"),
        (2, "10.0.0.1", "192.168.1.1", 5, 53, "udp"),
        (3, None, "", 0, 0, None),
        (4, "10.0.0.1", "192.168.1.1", 6, 53, "udp"),
    ]
    return spark.createDataFrame(rows, PACKETS)


def ids(df):
    return sorted(r["packet_id"] for r in df.select("packet_id").collect())


@pytest.mark.parametrize(
    "rules, kept",
    [
        ([], [1, 2, 3, 4]),
        ([Rule("ip", "src_ip", "192.168.1.1")], [1]),
        ([Rule("port", "dst_port", 80)], [1]),
        ([Rule("port", "dst_port", "80")], []),
        ([Rule("protocol", "ignored", "udp")], [2, 4]),
        ([Rule("mac", "src_ip", "192.168.1.1")], []),
        ([Rule("ip", "no_such", "192.168.1.1")], []),
        ([Rule("ip", "src_ip", "192.168.1.1"), Rule("protocol", "", "tcp")], [1]),
    ],
)
def test_rule_filter(packets, rules, kept):
    assert ids(filters.rule_filter(packets, rules)) == kept


def test_rule_table(spark, packets):
    schema = "type string, field string, value string"
    rules = [("port", "dst_port", "53"), ("port", "dst_port", "53"), ("protocol", "x", "udp"),
             ("other", "src_ip", "192.168.1.1")]
    table = spark.createDataFrame(rules, schema)
    assert ids(filters.rule_table_filter(packets, table)) == [2, 4]
    assert ids(filters.rule_table_filter(packets, table, broadcast_rows=0)) == [2, 4]
    assert ids(filters.rule_table_filter(packets, table.limit(0))) == [1, 2, 3, 4]


def rule_cases(spark):
    """Packets with gaps, copies and a third of the rows alike, and rules on every field."""
    def row(i):
        if i % 3 == 0:
            return (i, "10.0.0.1", "10.0.0.2", 1000, 80, "tcp")
        return (i, None if i % 7 == 0 else f"10.1.0.{i % 40}", f"10.2.0.{i % 9}", i % 50, None if i % 5 == 0 else i % 30, "udp" if i % 2 else None)

    schema = "packet_id int, src_ip string, dst_ip string, src_port int, dst_port int, protocol string"
    packets = spark.createDataFrame([row(i) for i in range(600)], schema)
    rules = [("ip", "src_ip", f"10.1.0.{i}") for i in range(12)] + [("port", "dst_port", str(p)) for p in (3, 17, 80)]
    rules += [("port", "src_port", None), ("mac", "dst_ip", "10.2.0.1"), ("ip", "no_such", "10.2.0.1"), ("ip", "dst_ip", "10.2.0.8")]
    return packets, rules


@pytest.mark.parametrize("broadcast_rows", [100_000, 14, 3, 1, 0])
def test_rule_table_joins_agree(spark, broadcast_rows):
    packets, rules = rule_cases(spark)
    table = spark.createDataFrame(rules * 2, "type string, field string, value string")
    known = {(field, value) for kind, field, value in rules if kind != "mac" and value is not None}
    want = [r["packet_id"] for r in packets.collect()
            if any((f, str(r[f])) in known for f in filters.RULE_FIELDS if r[f] is not None)]
    twice = packets.union(packets.where("packet_id < 30"))
    got = filters.rule_table_filter(twice, table, broadcast_rows=broadcast_rows)
    assert got.columns == packets.columns
    assert ids(got) == sorted(want + [i for i in want if i < 30])


def test_rules_that_cannot_match_let_nothing_pass(spark):
    packets, _ = rule_cases(spark)
    table = spark.createDataFrame([("mac", "src_ip", "10.0.0.1"), ("ip", "src_ip", None)], "type string, field string, value string")
    for rows in (100, 0):
        assert ids(filters.rule_table_filter(packets, table, broadcast_rows=rows)) == []


def test_large_rule_tables_join_packets_once(spark, tmp_path):
    packets, rules = rule_cases(spark)
    packets.write.parquet(str(tmp_path / "packets"))
    spark.createDataFrame(rules, "type string, field string, value string").write.parquet(str(tmp_path / "rules"))
    packets, rules = spark.read.parquet(str(tmp_path / "packets")), spark.read.parquet(str(tmp_path / "rules"))
    plan = filters.rule_table_filter(packets, rules, broadcast_rows=0)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftSemi") == 1 and plan.count("Join ") == 2
    small = filters.rule_table_filter(packets, rules)
    assert "Exchange hashpartitioning" not in small._jdf.queryExecution().executedPlan().toString()


def test_rule_lists():
    rule = Rule("ip", "src_ip", "a")
    assert filters.add_rule([], rule) == [rule]
    assert filters.remove_rule([rule, rule], rule) == [rule]
    assert filters.remove_rule([], rule) == [] and filters.clear_rules([rule]) == []


def test_rules_reach_the_scan(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    rules = [Rule("ip", "event_type", "error"), Rule("port", "user_id", 5)]
    plan = filters.rule_filter(events, rules)._jdf.queryExecution().toString()
    assert "PushedFilters: [Or(EqualTo(event_type,error),EqualTo(user_id,5))]" in plan


def test_stats_skip_missing_values(packets):
    got = {(r["dimension"], r["value"]): (r["n"], r["first_seen"])
           for r in stats.packet_stats(packets).collect()}
    assert got["total", None] == (4, 1)
    assert got["src_ip", "10.0.0.1"] == (2, 2) and got["dst_port", "53"] == (2, 2)
    assert all(value not in ("", "0") for _, value in got)
    assert ("src_port", "0") not in got and ("dst_ip", "") not in got
    first = stats.ranked(stats.packet_stats(packets).where("dimension = 'src_port'")).collect()
    assert [r["value"] for r in first] == ["12345", "5", "6"]


def test_syn_packet(spark):
    row = [(1, "192.168.1.1", "192.168.1.2", 12345, 80, "tcp", True, False)]
    df = spark.createDataFrame(row, PACKETS + ", tcp_syn boolean, tcp_ack_flag boolean")
    assert stats.syn_scan(df).collect()[0].asDict() == {"src_ip": "192.168.1.1", "n": 1}
    assert stats.port_scan(df).first()["ports"] == [80]
    assert {r["kind"] for r in stats.scan_report(df).collect()} == {"syn_scan", "port_scan"}


def test_latest(packets):
    df = packets.withColumn("t_us", F.lit(7))
    assert ids(stats.latest(df, 2)) == [3, 4]
    assert ids(stats.latest(df, 0)) == [] and ids(stats.latest(df, None)) == [1, 2, 3, 4]
    for n in (1, 5000):
        assert len(stats.latest_per_key(df, "src_ip", n).collect()) == (3 if n == 1 else 4)


def vote(spark, entries, mode="reference"):
    """The same entries through the wide and the long vote."""
    one = spark.range(1).select(F.col("id").alias("packet_id"))
    wide = [scoring.Score(F.lit(p).cast("double"), w, c) for p, w, c in entries]
    a = scoring.vote_wide(one, wide, mode).first()
    rows = [(0, f"m{i}", i, float(w), p, c) for i, (p, w, c) in enumerate(entries)]
    schema = ("packet_id bigint, model string, model_order int, weight double, p_attack double, "
              "classes int")  # fmt: skip
    b = scoring.vote_long(spark.createDataFrame(rows, schema), mode).first()
    assert (a["prediction"], a["confidence"]) == (b["prediction"], b["confidence"])
    return a["prediction"], a["confidence"]


@pytest.mark.parametrize(
    "entries, want",
    [
        ([(0.75, 1, 2)], ("attack", 0.75)),
        ([(0.5, 1, 2)], ("normal", 0.5)),  # exactly one half is normal
        ([(0.9, 1, 2), (0.25, 1, 2), (0.25, 1, 2)], ("attack", 0.3)),  # one outvotes two
        ([(0.25, 0.5, 2), (0.75, 1, 2), (0.5, 1, 2)], ("attack", 0.3)),
        ([(0.5, 1, 2), (0.75, 2 / 3, 2)], ("normal", 0.3)),  # equal scores: first model's label
        ([(0.75, 2 / 3, 2), (0.5, 1, 2)], ("attack", 0.3)),
        ([(0.75, 0, 2), (0.5, 0, 2)], ("unknown", 0.0)),
        ([(None, 1, 2)], ("unknown", 0.0)),
        ([(1.0, 1, 1), (0.5, 1, 2)], ("unknown", 0.5)),  # a one-class model votes unknown
        ([(None, 1, 2), (0.75, 1, 2)], ("attack", 0.75)),
    ],
)
def test_vote(spark, entries, want):
    prediction, confidence = vote(spark, entries)
    assert prediction == want[0] and confidence == pytest.approx(want[1])


def test_mean_vote(spark):
    entries = [(0.9, 1, 2), (0.25, 1, 2), (0.25, 1, 2)]
    prediction, confidence = vote(spark, entries, "mean")
    assert prediction == "normal" and confidence == pytest.approx(1 - 1.4 / 3)


def test_registry(spark):
    known = scoring.registry(spark, [("a", "made", 1.0), ("b", "made", 0.5)])
    known = scoring.add_model(scoring.add_model(known, "c", "made"), "a", "made")
    known = scoring.set_weight(scoring.remove_model(known, "b"), "c", 7)
    got = {r["model"]: (r["weight"], r["model_order"]) for r in known.collect()}
    assert got == {"a": (1.0, 0), "c": (1.0, 2)}
    with pytest.raises(ValueError):
        scoring.make_scorer("no such kind")


def test_detection_defaults(spark):
    one = spark.createDataFrame([(1, None, None, None)], "packet_id bigint, src_ip string, "
                                "dst_ip string, protocol string")  # fmt: skip
    found = scoring.detect(one, [scoring.Score(F.lit(None).cast("double"))], F.lit(1.0)).first()
    assert found["src_ip"] == "N/A" and found["prediction"] == "unknown" and found["is_alert"]


def test_evaluation_with_an_absent_class(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")]
    got = evaluation.evaluate(spark.createDataFrame(rows, "label string, prediction string")).first()
    assert got["accuracy"] == 0.5 and got["recall"] == 0.5
    assert got["precision"] == pytest.approx((2 * 0.5 + 1 * 0.5) / 4)
    assert got["f1"] == pytest.approx((2 * 0.5 + 1 * 2 / 3) / 4)


def test_retrain_gate(spark):
    rows = [("a", i) for i in range(10)] + [("b", i) for i in range(9)] + [("c", i) for i in range(20)]
    entries = spark.createDataFrame(rows, "model_name string, packet_id bigint")
    trained = spark.createDataFrame([("c", 1000.0)], "model_name string, trained_at double")

    def due(now):
        return {r["model_name"] for r in feedback.retrain_due(entries, trained, now).collect() if r["due"]}

    assert due(1000.0 + 3599) == {"a"} and due(1000.0 + 3600) == {"a", "c"}
