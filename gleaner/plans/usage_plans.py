"""Usage, cost, request limits, feedback."""

from __future__ import annotations

from pyspark.sql import functions as F

from gleaner import dims
from gleaner.operators import feedback as FB
from gleaner.operators import usage as U
from gleaner.plans.registry import Source, query
from gleaner.streaming import limiter_stream, usage_stream

PRICES_SQL = "(VALUES " + ", ".join(
    "(" + ", ".join("NULL" if v is None else f"'{v}'" if isinstance(v, str) else f"{v!r}::DOUBLE" for v in row) + ")" for row in dims.PRICES
) + ") pr(version, provider, model, operation, metric, unit, per_1k, in_1k, out_1k, thoughts_1k)"

_PICK = ", ".join(f"coalesce(CASE WHEN m.operation IS NOT NULL THEN m.{c} ELSE p.{c} END, {z}) AS {c}" for c, z in (
    ("metric", "'io_tokens'"), ("unit", "0"), ("per_1k", "0"), ("in_1k", "0"), ("out_1k", "0"), ("thoughts_1k", "0")))
PRICED_SQL = f"""(SELECT e.*, {_PICK}, CASE WHEN m.operation IS NOT NULL THEN 'model' WHEN p.operation IS NOT NULL THEN 'provider' ELSE 'fallback_zero' END AS pricing_source,
 'USD' AS currency FROM @f_cost e
 LEFT JOIN (SELECT * FROM {PRICES_SQL} WHERE model IS NOT NULL) m ON m.provider = e.provider AND m.model = e.model AND m.operation = e.operation
 LEFT JOIN (SELECT * FROM {PRICES_SQL} WHERE model IS NULL) p ON p.provider = e.provider AND p.operation = e.operation)"""
COST_SQL = f"""(SELECT x.*, CASE metric WHEN 'search_units' THEN coalesce(qty, 0) * unit WHEN 'total_tokens' THEN coalesce(qty, units_in + units_out) / 1000 * per_1k
 ELSE units_in / 1000 * in_1k + units_out / 1000 * out_1k END AS estimated_cost FROM {PRICED_SQL} x)"""


def costed(src: Source):
    return U.estimate_cost(U.resolve_prices(src.f_cost, dims.prices(src.spark)))


@query("resolve_prices", f"SELECT event_id, metric, unit, per_1k, in_1k, out_1k, thoughts_1k, pricing_source, currency FROM {PRICED_SQL} x")
def _(src: Source):
    return U.resolve_prices(src.f_cost, dims.prices(src.spark)).select("event_id", *U.PRICE_FIELDS, "pricing_source", "currency")


@query("estimate_cost", f"SELECT event_id, round(estimated_cost, 9) AS estimated_cost FROM {COST_SQL} x")
def _(src: Source):
    return costed(src).select("event_id", F.round("estimated_cost", 9).alias("estimated_cost"))


@query("usage_totals", f"""SELECT round(sum(estimated_cost), 6) AS total_cost, count(*) AS total_events, CAST(sum(units_in) AS BIGINT) AS total_units_in,
 CAST(sum(units_out) AS BIGINT) AS total_units_out, 'USD' AS currency FROM {COST_SQL} x""")
def _(src: Source):
    return U.usage_totals(costed(src))


@query("usage_by_model", f"""SELECT coalesce(nullif(model, ''), 'unknown') AS model, arg_max(provider, event_id) AS provider, round(sum(estimated_cost), 9) AS cost, count(*) AS events,
 sum(units_in) AS units_in, sum(units_out) AS units_out FROM {COST_SQL} x GROUP BY 1""")
def _(src: Source):
    return U.usage_by_model(costed(src)).withColumn("cost", F.round("cost", 9))


BY_DAY_SQL = f"SELECT coalesce(nullif(substring(ts, 1, 10), ''), 'unknown') AS date, round(sum(estimated_cost), 9) AS cost, count(*) AS events FROM {COST_SQL} x GROUP BY 1"


@query("usage_by_day", BY_DAY_SQL)
def _(src: Source):
    return U.usage_by_day(costed(src)).withColumn("cost", F.round("cost", 9))


@query("usage_recent", f"SELECT event_id, ts, model, round(estimated_cost, 9) AS estimated_cost FROM {COST_SQL} x ORDER BY event_id DESC LIMIT 50")
def _(src: Source):
    return U.usage_recent(costed(src)).select("event_id", "ts", "model", F.round("estimated_cost", 9).alias("estimated_cost"))


@query("usage_by_day_stream", BY_DAY_SQL)
def _(src: Source):
    return usage_stream.replay_usage_by_day(costed(src)).withColumn("cost", F.round("cost", 9))


@query("request_demand", """SELECT event_id, client, heavy, count(*) OVER (PARTITION BY client, heavy ORDER BY ts RANGE BETWEEN INTERVAL 6 HOURS PRECEDING AND CURRENT ROW) AS demand
 FROM @f_requests""")
def _(src: Source):
    return U.request_demand(src.f_requests, 21600).select("event_id", "client", "heavy", "demand")


# One request at a time, with the accepted ones still in the window.
LIMIT_SQL = """WITH RECURSIVE n AS MATERIALIZED (SELECT *, epoch_us(ts) AS t, row_number() OVER (PARTITION BY client, heavy ORDER BY ts, event_id) AS i FROM @f_requests),
 walk AS (SELECT event_id, client, heavy, i, false AS denied, [t] AS accepted FROM n WHERE i = 1
  UNION ALL SELECT event_id, client, heavy, i, full_now, CASE WHEN full_now THEN recent ELSE list_append(recent, t) END FROM (
   SELECT *, len(recent) >= CASE WHEN heavy THEN 1 ELSE 2 END AS full_now FROM (
    SELECT q.event_id, q.client, q.heavy, q.i, q.t, list_filter(w.accepted, lambda a: a >= q.t - 21600000000) AS recent FROM walk w JOIN n q ON q.client = w.client AND q.heavy = w.heavy AND q.i = w.i + 1) r) s)
 SELECT event_id, client, heavy, denied FROM walk"""


@query("rate_limit_flags", LIMIT_SQL)
def _(src: Source):
    return U.rate_limit_flags(src.f_requests, limit=2, heavy_limit=1, window_s=21600).select("event_id", "client", "heavy", "denied")


@query("rate_limit_stream", LIMIT_SQL)
def _(src: Source):
    return limiter_stream.replay_rate_limit(src.f_requests, limit=2, heavy_limit=1, window_s=21600)


# --- feedback ----------------------------------------------------------------

LATEST_SQL = """(SELECT trim(feedback_id) AS feedback_id, arg_max(action, line_no) AS action, arg_max(timestamp_text, line_no) AS timestamp_text, max(line_no) AS line_no
 FROM @f_reviews WHERE trim(coalesce(feedback_id, '')) <> '' GROUP BY 1)"""
ENRICHED_SQL = f"""(SELECT x.*, coalesce(r.action, 'open') AS review_status, r.timestamp_text AS reviewed_at FROM (
 SELECT coalesce(nullif(feedback_id, ''), concat(query_id, ':', timestamp_text, ':', CAST(line_no AS VARCHAR))) AS feedback_id, line_no, query_id, timestamp_text, rating, stars
 FROM @f_feedback) x LEFT JOIN {LATEST_SQL} r USING (feedback_id))"""


@query("latest_review", f"SELECT * FROM {LATEST_SQL} x")
def _(src: Source):
    return FB.latest_review(src.f_reviews)


@query("feedback_with_reviews", f"SELECT * FROM {ENRICHED_SQL} x")
def _(src: Source):
    return FB.feedback_with_reviews(src.f_feedback, src.f_reviews)


@query("feedback_page", f"""SELECT *, count(*) OVER () AS total FROM {ENRICHED_SQL} x WHERE rating = 'ok' AND review_status = 'open'
 ORDER BY timestamp_text DESC, line_no LIMIT 20 OFFSET 40""")
def _(src: Source):
    return FB.feedback_page(FB.feedback_with_reviews(src.f_feedback, src.f_reviews), "ok", "open", 40, 20)


@query("validate_reviews", """SELECT line_no, lower(trim(action)) AS action, lower(trim(action)) IN ('open', 'acknowledged', 'resolved', 'dismissed') AS accepted FROM @f_reviews""")
def _(src: Source):
    good, bad = FB.validate_reviews(src.f_reviews)
    return (good.select("line_no", "action", F.lit(True).alias("accepted"))
            .unionByName(bad.select("line_no", "action", F.lit(False).alias("accepted"))))
