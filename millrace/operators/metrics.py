"""Telemetry: counters, means, percentiles, rates, histories, scores and chart geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions import scalars as S
from millrace.schema import HISTORY_TICKS
from millrace.storage import durable, small


def request_counters(requests: DataFrame) -> DataFrame:
    """requests (type, ok, n_bytes, n_records) by type and outcome; bytes and records count where they are positive."""
    positive = lambda c: F.coalesce(F.sum(F.when(F.col(c) > 0, F.col(c))), F.lit(0)).cast("long")
    return requests.groupBy("type", "ok").agg(F.count(F.lit(1)).alias("n_requests"), positive("n_bytes").alias("n_bytes"), positive("n_records").alias("n_records"))


def mean_latency(requests: DataFrame, value: str = "value") -> DataFrame:
    return requests.groupBy("type").agg(S.round4(F.coalesce(F.avg(value), F.lit(0.0))).alias("mean"))


def throughput(requests: DataFrame, elapsed_s: Column, n_bytes: str = "n_bytes") -> DataFrame:
    """Records and MiB a second over a run; a run of no length counts as one second."""
    seconds = F.when(elapsed_s <= 0, F.lit(1.0)).otherwise(elapsed_s)
    sums = requests.agg(F.count(F.lit(1)).alias("n_records"), F.coalesce(F.sum(n_bytes), F.lit(0)).cast("long").alias("n_bytes"), seconds.alias("_s"))
    return sums.select("n_records", "n_bytes", S.round4(F.col("n_records") / F.col("_s")).alias("records_s"), S.round4(S.mib(F.col("n_bytes")) / F.col("_s")).alias("mib_s"))


def latency_percentiles(requests: DataFrame, value: str = "value") -> DataFrame:
    """Nearest-rank percentiles, mean and maximum of each type; exact, nulls left out.

    Different values are counted and dealt by range; the counts a range tell in which one a rank lies, and
    only such ranges, four a type at most, are run through. No task holds all values of a type.
    """
    ranks = {"p50": "0.5", "p95": "0.95", "p99": "0.99", "p999": "0.999"}
    sums = durable(requests.groupBy("type").agg(F.count(value).alias("_all"), S.round4(F.avg(value)).alias("mean"), F.max(value).alias("max")))
    counts = requests.where(F.col(value).isNotNull()).groupBy("type", F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    dealt = durable(counts.repartitionByRange("type", "_value").withColumn("_range", F.spark_partition_id()))
    before = Window.partitionBy("type").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = dealt.groupBy("type", "_range").agg(F.sum("_n").alias("_held")).withColumn("_before", F.coalesce(F.sum("_held").over(before), F.lit(0)))
    wanted = sums.select("type", F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.ceil(F.col("_all") * F.lit(q).cast("decimal(4,3)")).cast("long").alias("rank")) for p, q in ranks.items()])).alias("_w"))
    found = held.join(wanted, "type").where("_w.rank > _before and _w.rank <= _before + _held")
    found = found.groupBy("type", "_range").agg(F.collect_list(F.struct("_w.p", (F.col("_w.rank") - F.col("_before")).alias("rank"))).alias("_ranks"))
    upto = F.sum("_n").over(Window.partitionBy("type", "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    run = dealt.join(small(durable(found)), ["type", "_range"]).withColumn("_upto", upto)
    of = lambda p: F.min(F.when(F.exists("_ranks", lambda w: (w["p"] == p) & (w["rank"] <= F.col("_upto"))), F.col("_value"))).alias(p)
    picked = run.groupBy("type").agg(*[of(p) for p in ranks])
    return sums.join(picked, "type", "left").select("type", *ranks, "mean", "max")


def rates(ticks: DataFrame, counter: str, by: list[str], tick: str = "tick") -> DataFrame:
    """ticks with rate: what a cumulative counter gained since the tick before, at least 0; 0 at the first."""
    before = F.lag(counter).over(Window.partitionBy(*by).orderBy(tick))
    return ticks.withColumn("rate", F.coalesce(F.greatest(F.lit(0), F.col(counter) - before), F.lit(0)).cast("long"))


def ring_history(ticks: DataFrame, value: str, by: list[str], size: int = HISTORY_TICKS, tick: str = "tick") -> DataFrame:
    """ticks with the sum and number of the last `size` values at each, as a ring of them would hold; a short ring is filled up with zeros."""
    last = Window.partitionBy(*by).orderBy(tick).rowsBetween(1 - size, 0)
    return ticks.withColumn("ring_sum", F.sum(value).over(last)).withColumn("ring_filled", F.count(F.lit(1)).over(last))


def history_slice(ticks: DataFrame, by: list[str], n: int = 30, tick: str = "tick") -> DataFrame:
    """The last n ticks of each series."""
    newest = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(tick)))
    return ticks.withColumn("_n", newest).where(F.col("_n") <= n).drop("_n")


def recent_events(events: DataFrame, n: int = 50, order: tuple[str, ...] = ("ts", "event_id")) -> DataFrame:
    """The newest n events, newest first: each task keeps n."""
    return events.orderBy(*[F.desc(c) for c in order]).limit(n)


def merge_events(events: DataFrame, seen: str = "seq") -> DataFrame:
    """Events of all nodes, one for each (node_id, id), the last seen."""
    columns = [c for c in events.columns if c not in ("node_id", "id")]
    return events.groupBy("node_id", "id").agg(F.max_by(F.struct(*columns), seen).alias("_row")).select("node_id", "id", "_row.*")


def connection_split(totals: DataFrame) -> DataFrame:
    """totals (connections, produced, consumed) with producers and consumers: by share of traffic, at least 1 where there is any."""
    traffic = F.col("produced") + F.col("consumed")
    share = F.when(traffic > 0, F.col("produced") / traffic).otherwise(0.5)
    producers = F.round(F.col("connections") * share).cast("long")
    producers = F.when((F.col("produced") > 0) & (F.col("connections") > 0), F.greatest(F.lit(1), producers)).otherwise(producers)
    out = totals.withColumn("producers", producers)
    rest = F.col("connections") - F.col("producers")
    return out.withColumn("consumers", F.when((F.col("consumed") > 0) & (F.col("connections") > 0), F.greatest(F.lit(1), rest)).otherwise(F.greatest(F.lit(0), rest)).cast("long"))


def radar_scores(stats: DataFrame) -> DataFrame:
    """stats (type, n_messages, mean_ms) with two scores of 0 to 100."""
    return stats.select("type", S.round4(S.log_score(F.col("n_messages"))).alias("volume_score"), S.round4(S.latency_score(F.col("mean_ms"))).alias("latency_score"))


def stack_bands(values: DataFrame, x: str, series: str, value: str, percent: bool = False) -> DataFrame:
    """values with y0 and y1: the band of each series at x, one on the other in order of name; as shares of the whole if percent."""
    at = Window.partitionBy(x)
    below = F.sum(value).over(at.orderBy(series).rowsBetween(Window.unboundedPreceding, 0))
    whole = F.sum(value).over(at)
    unit = F.when(whole == 0, F.lit(1.0)).otherwise(whole) if percent else F.lit(1.0)
    return values.withColumn("y0", S.round4((below - F.col(value)) / unit)).withColumn("y1", S.round4(below / unit))


def domain(bands: DataFrame) -> DataFrame:
    """One row: the range of all bands, [0, 1] where it is flat."""
    d = bands.agg(F.min("y0").alias("low"), F.max("y1").alias("high"))
    flat = F.col("low") >= F.col("high")
    return d.select(F.when(flat, F.lit(0.0)).otherwise(F.col("low")).alias("low"), F.when(flat, F.lit(1.0)).otherwise(F.col("high")).alias("high"))


def pie(shares: DataFrame, name: str, value: str) -> DataFrame:
    """Slices in order of name: share of the whole (negative values as 0), and angles from the top, clockwise. Few rows."""
    v = F.greatest(F.lit(0.0), F.col(value).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    total = F.sum(v).over(everything)
    share = v / F.when(total == 0, F.lit(1.0)).otherwise(total)
    upto = F.sum("_share").over(everything.orderBy(name).rowsBetween(Window.unboundedPreceding, 0))
    out = shares.select(name, share.alias("_share")).withColumn("_upto", upto)
    angle = lambda x: S.round4(x * (2 * math.pi) - math.pi / 2)
    return out.select(name, S.round4(F.col("_share")).alias("share"), angle(F.col("_upto") - F.col("_share")).alias("start_angle"), angle(F.col("_upto") - F.col("_share") / 2).alias("mid_angle"), angle(F.col("_upto")).alias("end_angle"))


def resample(series: DataFrame, values: str, n: int) -> DataFrame:
    """Each array of values as n points, linear between its own; an empty array gives zeros."""
    v = F.col(values)
    place = lambda i: i * (F.size(v) - 1) / F.lit(float(max(1, n - 1)))

    def point(i: Column) -> Column:
        low = F.floor(place(i)).cast("int")
        a, b = F.get(v, low), F.get(v, F.least(low + 1, F.size(v) - 1))
        return F.coalesce(S.round4(a + (b - a) * (place(i) - low)), F.lit(0.0))

    return series.withColumn("points", F.transform(F.sequence(F.lit(0), F.lit(n - 1)), point))


def frame(metrics: DataFrame) -> DataFrame:
    """One row of JSON a row of metrics, as a dashboard takes it."""
    return metrics.select(F.to_json(F.struct(*[F.col(c) for c in metrics.columns])).alias("frame"))


def telemetry(topics: DataFrame, groups: DataFrame, node: str) -> DataFrame:
    """One row of JSON: the node with its topics and groups, each an array ordered by its first column; both are a row a topic or group."""
    listed = lambda df, name: df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))
    both = listed(topics, "topics").withColumn("node", F.lit(node)).join(listed(groups, "groups").withColumn("node", F.lit(node)), "node")
    return both.select(F.to_json(F.struct("node", "topics", "groups")).alias("frame"))


def scrape(gauges: DataFrame) -> DataFrame:
    """Gauges (name, labels as a map, value) as lines of scrape text, labels by name; values that are null have no line."""
    quoted = lambda v: F.concat(F.lit('"'), F.replace(F.replace(F.replace(v, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\n"), F.lit("\\n")), F.lit('"'))
    pairs = F.transform(F.sort_array(F.map_entries("labels")), lambda e: F.concat(e["key"], F.lit("="), quoted(e["value"])))
    labels = F.when(F.size("labels") > 0, F.concat(F.lit("{"), F.array_join(pairs, ","), F.lit("}"))).otherwise("")
    return gauges.where("value is not null").select(F.concat("name", labels, F.lit(" "), F.col("value").cast("string")).alias("line"))


def zip_histories(produced: DataFrame, consumed: DataFrame, by: list[str], tick: str = "tick") -> DataFrame:
    """Two series (n at each tick) side by side, by their place from the newest tick on; a place that produced lacks is what consumed leaves of total."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(tick)))
    left = produced.withColumn("place", place).select(*by, "place", F.col("n").alias("produced"))
    right = consumed.withColumn("place", place).select(*by, "place", F.col("n").alias("consumed"), F.col("total").alias("_total"))
    rest = F.greatest(F.lit(0), F.col("_total") - F.col("consumed"))
    return right.join(left, [*by, "place"], "left").select(*by, "place", F.coalesce("produced", rest).cast("long").alias("produced"), "consumed")


def worst_mean(requests: DataFrame, kinds: tuple[str, ...], value: str = "value") -> DataFrame:
    """One row: the greatest mean latency of some types, 0 without samples."""
    means = mean_latency(requests.where(F.col("type").isin(*kinds)), value)
    return means.agg(F.coalesce(F.max("mean"), F.lit(0.0)).alias("worst_mean"))
