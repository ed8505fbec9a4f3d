"""Price resolution, cost and usage roll-ups, request limits."""

from __future__ import annotations

from collections import deque

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleaner.dims import CURRENCY
from gleaner.functions.text import or_blank
from gleaner.operators.sequence import carry_last, with_halo

# Requests per window and its length in seconds.
DEFAULT_LIMIT = 120
HEAVY_LIMIT = 20
WINDOW_S = 60
HEAVY_PREFIXES = ("/benchmark/generate", "/benchmark/run", "/benchmark/analyze", "/ingest/upload", "/ingest/start", "/calls/upload")

PRICE_FIELDS = ("metric", "unit", "per_1k", "in_1k", "out_1k", "thoughts_1k")


def resolve_prices(events: DataFrame, prices: DataFrame) -> DataFrame:
    """Price of the model's operation, else the provider's, else zero; the source is named.

    A model's price row replaces the provider's as a whole.
    """
    row = F.struct(*PRICE_FIELDS)
    by_model = prices.where("model IS NOT NULL").select("provider", "model", "operation", row.alias("_m"))
    by_provider = prices.where("model IS NULL").select("provider", "operation", row.alias("_p"))
    joined = (events.join(by_model, ["provider", "model", "operation"], "left")
              .join(by_provider, ["provider", "operation"], "left"))
    price = F.coalesce("_m", "_p")
    zero = {"metric": F.lit("io_tokens")}
    return joined.select(
        *events.columns, *[F.coalesce(price[f], zero.get(f, F.lit(0.0))).alias(f) for f in PRICE_FIELDS],
        F.when(F.col("_m").isNotNull(), "model").when(F.col("_p").isNotNull(), "provider").otherwise("fallback_zero").alias("pricing_source"),
        F.lit(CURRENCY).alias("currency"))


def estimate_cost(priced: DataFrame) -> DataFrame:
    """Cost per event from its units and price; thoughts and quantity may be absent."""
    names = priced.columns
    zero = F.lit(0.0)
    thoughts = F.coalesce("units_thoughts", zero) if "units_thoughts" in names else zero
    qty = F.col("qty") if "qty" in names else F.lit(None).cast("double")
    units_in, units_out = F.coalesce("units_in", zero), F.coalesce("units_out", zero)
    cost = (F.when(F.col("metric") == "search_units", F.coalesce(qty, zero) * F.col("unit"))
            .when(F.col("metric") == "total_tokens", F.coalesce(qty, units_in + units_out + thoughts) / 1000 * F.col("per_1k"))
            .otherwise(units_in / 1000 * F.col("in_1k") + units_out / 1000 * F.col("out_1k") + thoughts / 1000 * F.col("thoughts_1k")))
    return priced.withColumn("estimated_cost", cost)


def _sum(name: str) -> Column:
    return F.sum(F.coalesce(name, F.lit(0.0)))


def usage_totals(events: DataFrame, order: str = "event_id") -> DataFrame:
    """One row: cost, events, whole units, the currency named last."""
    named = F.when(or_blank(F.col("currency")) != "", F.col("currency"))
    return events.agg(
        F.bround(F.coalesce(_sum("estimated_cost"), F.lit(0.0)), 6).alias("total_cost"), F.count("*").alias("total_events"),
        F.coalesce(_sum("units_in"), F.lit(0.0)).cast("bigint").alias("total_units_in"),
        F.coalesce(_sum("units_out"), F.lit(0.0)).cast("bigint").alias("total_units_out"),
        F.coalesce(F.max_by(named, F.when(named.isNotNull(), F.col(order))), F.lit(CURRENCY)).alias("currency"))


def usage_by_model(events: DataFrame, order: str = "event_id") -> DataFrame:
    """Per model, dearest first: cost, events, units, the provider named last."""
    named = F.when(or_blank(F.col("provider")) != "", F.col("provider"))
    model = F.coalesce(F.nullif("model", F.lit("")), F.lit("unknown"))
    return (events.groupBy(model.alias("model")).agg(
        or_blank(F.max_by(named, F.when(named.isNotNull(), F.col(order)))).alias("provider"), _sum("estimated_cost").alias("cost"),
        F.count("*").alias("events"), _sum("units_in").alias("units_in"), _sum("units_out").alias("units_out"))
        .orderBy(F.desc("cost"), "model"))


def usage_by_day(events: DataFrame) -> DataFrame:
    """Cost and events per day of the time stamp text."""
    day = F.coalesce(F.nullif(F.substring("ts", 1, 10), F.lit("")), F.lit("unknown"))
    return events.groupBy(day.alias("date")).agg(_sum("estimated_cost").alias("cost"), F.count("*").alias("events")).orderBy("date")


def usage_recent(events: DataFrame, n: int = 50, order: str = "event_id") -> DataFrame:
    """Newest ``n`` events in log order (top-k per task, then merged)."""
    return events.orderBy(F.desc(order)).limit(max(0, n))


# --- request limits -------------------------------------------------------------

def _micros(c: Column) -> Column:
    return F.unix_micros(c.cast("timestamp"))


def heavy_path(path: Column) -> Column:
    hit = F.lit(False)
    for prefix in HEAVY_PREFIXES:
        hit = hit | F.startswith(path, F.lit(prefix))
    return hit


SLOT_WINDOWS = 16  # windows per time slot


def request_demand(requests: DataFrame, window_s: int = WINDOW_S, keys: tuple[str, ...] = ("client", "heavy")) -> DataFrame:
    """Requests of the same client and class within the window up to each request (``demand``).

    The count runs per (client, class, time slot), each slot with a copy of the rows one
    window before it, so that a client sending a third of all requests is still spread over
    as many tasks as there are slots.
    """
    width = window_s * 1_000_000
    spread = with_halo(requests.withColumn("_t", _micros(F.col("ts"))), "_t", width * SLOT_WINDOWS, back=width)
    w = Window.partitionBy(*keys, "_slot").orderBy("_t").rangeBetween(-width, 0)
    return (spread.withColumn("demand", F.count("*").over(w))
            .where(F.col("_slot") == F.col("_own")).drop("_own", "_slot", "_t"))


def rate_limit_flags(requests: DataFrame, limit: int = DEFAULT_LIMIT, heavy_limit: int = HEAVY_LIMIT,
                     window_s: int = WINDOW_S, order: str = "event_id") -> DataFrame:
    """Whether each request is ``denied``: as many *accepted* ones lie in its window as allowed.

    A request whose plain demand is within the limit is accepted whatever came before. Only
    the others depend on earlier decisions. They form episodes - runs of such requests no
    more than a window apart - and everything an episode depends on lies within the window
    before it. Episodes are therefore independent, also within one client; tasks walk them
    in time order holding no more than ``limit`` time stamps.
    """
    keys = ["client", "heavy"]
    width = window_s * 1_000_000
    names = requests.columns
    allowed = F.when(F.col("heavy"), F.lit(heavy_limit)).otherwise(F.lit(limit))
    rows = (request_demand(requests, window_s).withColumn("_t", _micros(F.col("ts")))
            .withColumn("_unsure", F.when(F.col("demand") > allowed, F.col("_t"))).drop("demand"))
    spread = with_halo(rows, "_t", width * SLOT_WINDOWS, back=2 * width, ahead=width)
    w = Window.partitionBy(*keys, "_slot").orderBy("_t")
    start = spread.withColumn("_start", F.when(
        F.col("_unsure").isNotNull() & F.max("_unsure").over(w.rangeBetween(-width, -1)).isNull(), F.col("_t")))
    ahead = start.withColumn("_next", F.min(F.when(F.col("_unsure").isNotNull(), F.struct("_unsure", "_start"))).over(w.rangeBetween(0, width)))
    own = ahead.where(F.col("_slot") == F.col("_own")).drop("_own")
    tagged = carry_last(own, keys, "_slot", ["_t", order], "_start", "_last_start")
    episode = F.when(F.col("_next").isNotNull(), F.coalesce("_next._start", "_last_start"))
    tagged = tagged.withColumn("_episode", episode).select(*names, "_t", "_episode")
    easy = tagged.where(F.col("_episode").isNull()).select(*names, F.lit(False).alias("denied"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields), "denied boolean"])

    def walk(batches):
        key, accepted = None, deque()
        for pdf in batches:
            denied = []
            for client, heavy, part, t in zip(pdf["client"], pdf["heavy"], pdf["_episode"], pdf["_t"]):
                if (client, heavy, part) != key:
                    key, accepted = (client, heavy, part), deque()
                while accepted and accepted[0] < t - width:
                    accepted.popleft()
                full = len(accepted) >= (heavy_limit if heavy else limit)
                if not full:
                    accepted.append(t)
                denied.append(full)
            yield pdf[names].assign(denied=denied)

    hard = (tagged.where(F.col("_episode").isNotNull()).repartition(*keys, "_episode")
            .sortWithinPartitions(*keys, "_episode", "_t", order))
    return easy.unionByName(hard.mapInPandas(walk, schema))
