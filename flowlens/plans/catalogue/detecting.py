"""Vote, detection, evaluation and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.network import ip_number
from flowlens.operators import evaluation, feedback, filters, scoring, stats
from flowlens.plans.catalogue import query
from flowlens.plans.catalogue.features import rounded
from flowlens.plans.views import (
    MODEL_SCORES_SQL,
    MODELS,
    VOTE_SQL,
    WITH_PACKETS,
    WITH_VOTES,
    model_p,
    model_scores,
    packets,
    table,
)

WITH_SCORES = f"with model_scores as ({MODEL_SCORES_SQL})"
ENSEMBLE_SQL = (
    f"{WITH_SCORES} select packet_id, prediction, round(confidence, 6) as confidence "
    f"from ({VOTE_SQL}) v"
)


def models(spark):
    return scoring.registry(spark, [(name, "made", weight) for name, _, weight, _, _ in MODELS])


def wide_scores():
    return [scoring.Score(model_p(a, b), weight) for _, _, weight, a, b in MODELS]


@query("ensemble_vote", ENSEMBLE_SQL)
def ensemble_vote(spark, folder):
    """Long scores: the registry joined on, then one aggregation per packet."""
    scores = model_scores(spark, folder).drop("model_order", "weight")
    votes = scoring.vote_long(scoring.with_weights(scores, models(spark)))
    return rounded(votes, ["confidence"])


@query("ensemble_vote_wide", ENSEMBLE_SQL)
def ensemble_vote_wide(spark, folder):
    """Wide scores: the vote is a projection."""
    events = table(spark, folder, "events").select(F.col("event_id").alias("packet_id"))
    return rounded(scoring.vote_wide(events, wide_scores()), ["confidence"])


@query("ensemble_vote_mean", f"""{WITH_SCORES} select packet_id,
  case when m > 0.5 then 'attack' else 'normal' end as prediction,
  round(greatest(m, 1 - m), 6) as confidence from (select packet_id,
  sum(p_attack * weight) / sum(weight) as m from model_scores group by packet_id) v""")
def ensemble_vote_mean(spark, folder):
    return rounded(scoring.vote_long(model_scores(spark, folder), mode="mean"), ["confidence"])


@query("model_weights", f"""{WITH_SCORES} select packet_id, model,
  least(greatest(case when model = 'm2' then 3e0 when model = 'm3' then -1e0 else weight end, 0), 1)
  as weight from model_scores""")
def model_weights(spark, folder):
    known = scoring.set_weight(scoring.set_weight(models(spark), "m2", 3.0), "m3", -1.0)
    scores = model_scores(spark, folder).select("packet_id", "model")
    return scoring.with_weights(scores, known).select("packet_id", "model", "weight")


@query("model_registry", f"""{WITH_SCORES} select t.model, t.model_order, t.weight, count(s.model)
  as n from (values ('m1', 0, 1e0), ('m3', 2, 0.25e0), ('m4', 3, 1e0)) t(model, model_order, weight)
  left join model_scores s on s.model = t.model group by all""")
def model_registry(spark, folder):
    """Models after an addition, a refused addition and a removal, with their score counts."""
    known = scoring.add_model(models(spark), "m4", "made")
    known = scoring.remove_model(scoring.add_model(known, "m1", "made"), "m2")
    counts = model_scores(spark, folder).groupBy("model").agg(F.count(F.lit(1)).alias("n"))
    listed = known.select("model", "model_order", "weight").join(counts, "model", "left")
    return listed.withColumn("n", F.coalesce("n", F.lit(0)))


@query("best_class", f"""{WITH_PACKETS} select packet_id,
  case when p1 >= p2 and p1 >= p3 then 'normal' when p2 >= p3 then 'attack' else '2' end as label,
  round(greatest(p1, p2, p3), 6) as confidence from (select packet_id,
  (packet_id * 7 % 64) / 64e0 as p1, (packet_id * 11 % 64) / 64e0 as p2,
  (packet_id * 13 % 64) / 64e0 as p3 from packets) p""")
def best_class(spark, folder):
    p = [((F.col("packet_id") * k) % 64) / F.lit(64.0) for k in (7, 11, 13)]
    label, top = scoring.best_class(F.array(*p), ["normal", "attack"])
    return packets(spark, folder).select(
        "packet_id", label.alias("label"), F.round(top, 6).alias("confidence")
    )


def detections(spark, folder):
    df = packets(spark, folder)
    at = F.col("t_us") / 1e6
    return scoring.detect(df, wide_scores(), at)


DETECTION_SQL = """packet_id, round(t_us / 1e6, 6) as timestamp, src_ip, dst_ip, protocol,
  prediction, round(confidence, 6) as confidence, is_alert"""


def _shown(df):
    return rounded(df, ["timestamp", "confidence"])


@query("detections", f"{WITH_VOTES} select {DETECTION_SQL} from detections")
def detections_query(spark, folder):
    return _shown(detections(spark, folder))


@query("alerts", f"{WITH_VOTES} select {DETECTION_SQL} from detections where is_alert")
def alerts(spark, folder):
    return _shown(filters.alerts(detections(spark, folder)))


@query("last_detections", f"{WITH_VOTES} select {DETECTION_SQL} from detections "
       "order by t_us desc, packet_id desc limit 1000")  # fmt: skip
def last_detections(spark, folder):
    return _shown(stats.latest(detections(spark, folder), 1000, time="timestamp"))


@query("recent_alerts", f"{WITH_VOTES} select {DETECTION_SQL} from detections where is_alert "
       "order by t_us desc, packet_id desc limit 100")  # fmt: skip
def recent_alerts(spark, folder):
    found = filters.alerts(detections(spark, folder))
    return _shown(stats.latest(found, 100, time="timestamp"))


@query("alert_table", f"""{WITH_VOTES} select packet_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as time,
  src_ip, dst_ip, protocol, prediction, round(confidence, 4) as confidence,
  case when is_alert then 'alert' else 'normal' end as status from detections""")
def alert_table(spark, folder):
    return stats.alert_table(voted(spark, folder), "ts")


@query("alert_severity", f"""{WITH_VOTES} select packet_id, round(confidence, 6) as confidence
  from detections where is_alert and confidence >= 0.4 and confidence < 0.7""")
def alert_severity(spark, folder):
    found = filters.alerts(detections(spark, folder))
    medium = filters.display_filter(found, severity="medium", cutoffs=(0.4, 0.7))
    return rounded(medium.select("packet_id", "confidence"), ["confidence"])


@query("attack_distribution",
       f"{WITH_VOTES} select prediction, count(*) as n from detections group by prediction")
def attack_distribution(spark, folder):
    return stats.distribution(detections(spark, folder), "prediction")


def voted(spark, folder):
    """Packets with their vote, all columns kept."""
    df = scoring.vote_wide(packets(spark, folder), wide_scores())
    return df.withColumn("is_alert", F.col("prediction") != "normal")


@query("eval_metrics", f"""{WITH_VOTES}, c as (select label, prediction, count(*) as n
  from detections group by label, prediction),
 per as (select k, sum(case when label = k then n else 0 end) as support,
   sum(case when prediction = k then n else 0 end) as predicted,
   sum(case when label = k and prediction = k then n else 0 end) as hits
   from c, (select label as k from c union select prediction from c) ks group by k)
 select round(sum(hits) / sum(support), 6) as accuracy,
  round(sum(case when predicted > 0 then hits / predicted else 0 end * support) / sum(support), 6)
    as precision,
  round(sum(case when support > 0 then hits / support else 0 end * support) / sum(support), 6) as recall,
  round(sum(case when support + predicted > 0 then 2 * hits / (support + predicted) else 0 end
    * support) / sum(support), 6) as f1 from per""")
def eval_metrics(spark, folder):
    metrics = evaluation.evaluate(voted(spark, folder))
    return rounded(metrics, metrics.columns)


def truths(spark, folder):
    """Analysts have looked at the error and click packets."""
    df = packets(spark, folder).where(F.col("event_type").isin("error", "click"))
    return df.select("packet_id", F.col("label").alias("actual"))


SEEN = "event_type in ('error', 'click')"


@query("feedback_join", f"""{WITH_VOTES} select packet_id, prediction,
  case when {SEEN} then label end as actual from detections""")
def feedback_join(spark, folder):
    labelled = feedback.with_feedback(detections(spark, folder), truths(spark, folder))
    return labelled.select("packet_id", "prediction", "actual")


@query("awaiting_feedback", f"{WITH_VOTES} select packet_id, prediction from detections "
       f"where not {SEEN}")  # fmt: skip
def awaiting_feedback(spark, folder):
    waiting = feedback.awaiting_feedback(detections(spark, folder), truths(spark, folder))
    return waiting.select("packet_id", "prediction")


@query("fp_fn", f"""{WITH_VOTES} select count(*) as labelled,
  count(*) filter (is_alert and label = 'normal') as false_positives,
  count(*) filter (not is_alert and label <> 'normal') as false_negatives
  from detections where {SEEN}""")
def fp_fn(spark, folder):
    labelled = feedback.with_feedback(detections(spark, folder), truths(spark, folder))
    return feedback.error_counts(labelled)


def feedback_entries(spark, folder):
    """Feedback for two models: one on all labelled packets, one on the UDP ones."""
    found = feedback.with_feedback(detections(spark, folder), truths(spark, folder))
    vector = F.array(ip_number(F.col("src_ip")), F.col("confidence"))
    first = feedback.feedback_rows(found, "m1", vector, F.col("actual"))
    second = feedback.feedback_rows(
        found.where("protocol = 'udp'"), "m2", vector, F.col("actual")
    )
    return first.unionByName(second)


WITH_FEEDBACK = (
    f"{WITH_VOTES}, feedback as (select 'm1' as model_name, packet_id, t_us, prediction, "
    f"label as actual from detections where {SEEN} union all select 'm2', packet_id, "
    f"t_us, prediction, label from detections where {SEEN} and protocol = 'udp')"
)


@query("predict_with_feedback",
       f"{WITH_FEEDBACK} select model_name, packet_id, prediction, actual from feedback")
def predict_with_feedback(spark, folder):
    entries = feedback_entries(spark, folder)
    return entries.select("model_name", "packet_id", "prediction", "actual")


@query("usable_feedback", f"{WITH_FEEDBACK} select model_name, packet_id, actual from feedback "
       "where prediction = 'attack' and actual <> 'attack'")  # fmt: skip
def usable_feedback(spark, folder):
    """Entries that lost their features or their truth drop out."""
    entries = feedback_entries(spark, folder).withColumns(
        {
            "features": F.when(F.col("prediction") == "attack", F.col("features")),
            "actual": F.nullif(F.col("actual"), F.lit("attack")),
        }
    )
    return feedback.usable(entries).select("model_name", "packet_id", "actual")


@query("feedback_counts",
       f"{WITH_FEEDBACK} select model_name, count(*) as n from feedback group by model_name")
def feedback_counts(spark, folder):
    return feedback.feedback_counts(feedback_entries(spark, folder))


@query("last_feedback", f"""{WITH_FEEDBACK} select model_name, packet_id, actual from feedback
  qualify row_number() over (partition by model_name order by t_us desc, packet_id desc) <= 25""")
def last_feedback(spark, folder):
    recent = feedback.latest_feedback(feedback_entries(spark, folder), 25)
    return recent.select("model_name", "packet_id", "actual")


NOW_S = 1_704_153_600


@query("retrain_due", f"""{WITH_FEEDBACK} select model_name, count(*) as n,
  count(*) >= 10 and model_name <> 'm2' as due from feedback group by model_name""")
def retrain_due(spark, folder):
    trained = spark.createDataFrame([("m2", NOW_S - 100.0)], "model_name string, trained_at double")
    return feedback.retrain_due(feedback_entries(spark, folder), trained, NOW_S)


@query("route_feedback", f"{WITH_FEEDBACK} select distinct model_name from feedback "
       "where model_name <> 'm1'")  # fmt: skip
def route_feedback(spark, folder):
    known = scoring.registry(spark, [("m1", "made", 1.0)])
    return feedback.route_feedback(feedback_entries(spark, folder), known)[1]


@query("counters", f"""{WITH_VOTES} select count(*) as total_packets_processed,
  count(*) filter (is_alert) as total_alerts_generated, least(count(*), 1000) as history_length
  from detections""")
def counters(spark, folder):
    return stats.counters(detections(spark, folder))


@query("dashboard_tiles", f"""{WITH_VOTES}, d as (select count(*) as n,
  count(*) filter (is_alert) as a, (max(t_us) - min(t_us)) / 1e6 as s,
  sum(packet_size) / 1024e0 as kb from detections)
 select n as total_packets, a as total_alerts, round(100e0 * a / n, 6) as attack_rate_pct,
  round(n / s, 6) as packets_per_second, round(kb, 6) as total_kb,
  round(kb / s, 6) as kb_per_second, round(100e0 * a / n, 6) as alert_rate_pct from d""")
def dashboard_tiles(spark, folder):
    tiles = stats.dashboard_tiles(voted(spark, folder))
    return rounded(tiles, [c for c in tiles.columns if not c.endswith(("packets", "alerts"))])


def _traffic_sql(width_us: int) -> str:
    return (
        f"{WITH_VOTES} select make_timestamp(t_us // {width_us} * {width_us}) as window_start, "
        "count(*) as packets, cast(sum(packet_size) as bigint) as bytes, "
        "count(*) filter (is_alert) as alerts from detections group by 1"
    )


def _timed(spark, folder):
    return voted(spark, folder).withColumn("timestamp", F.timestamp_micros("t_us"))


@query("traffic_over_time", _traffic_sql(60_000_000))
def traffic_over_time(spark, folder):
    out = stats.traffic_over_time(_timed(spark, folder))
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("traffic_sliding", f"""{WITH_VOTES} select make_timestamp(
  (t_us // 30000000 - k) * 30000000) as window_start, count(*) as packets,
  cast(sum(packet_size) as bigint) as bytes, count(*) filter (is_alert) as alerts
  from detections, (values (0), (1)) s(k) group by 1""")
def traffic_sliding(spark, folder):
    out = stats.traffic_over_time(_timed(spark, folder), "1 minute", "30 seconds")
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("custom_scorer", f"""{WITH_PACKETS} select packet_id,
  round((packet_id * 7 + 1) % 1025 / 1024e0, 6) as p_attack from packets""")
def custom_scorer(spark, folder):
    """A foreign model called on Arrow batches."""

    def predict(frame):
        return (frame["packet_id"] * 7 + 1) % 1025 / 1024.0

    score = scoring.make_scorer("python", predict, "packet_id bigint")
    return rounded(score(packets(spark, folder).select("packet_id")), ["p_attack"])


@query("processor_chain", f"""{WITH_VOTES} select protocol, count(*) as n from detections
  where (src_ip = '192.168.1.1' or protocol = 'udp') and is_alert group by protocol""")
def processor_chain(spark, folder):
    """Packet plug-ins in order: filter, detect, keep alerts, count."""
    rules = [filters.Rule("ip", "src_ip", "192.168.1.1"), filters.Rule("protocol", "", "udp")]
    return scoring.apply_processors(
        packets(spark, folder),
        [
            lambda df: filters.rule_filter(df, rules),
            lambda df: scoring.detect(df, wide_scores(), F.col("t_us") / 1e6),
            filters.alerts,
            lambda df: stats.distribution(df, "protocol"),
        ],
    )
