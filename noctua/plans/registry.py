"""Registered queries of the recording operators and their DuckDB equivalents.

Each query binds an operator to stand-ins derived from the driver's tables (plans/bindings.py).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from noctua.functions import trees
from noctua.functions.config import Config
from noctua.operators import bedtime, checks, epochs, majority, signals, sinks, sleepstats
from noctua.plans import bindings as b
from noctua.plans import jobs
from noctua.sources import nights, recordings, scores

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Two events of under 60 in a row make a bedtime in the stand-in.
RUN = 2


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def each(rows: DataFrame, column: str) -> DataFrame:
    """The elements of an array as rows: pos, value."""
    return rows.select(*(c for c in rows.columns if c != column), F.posexplode(column).alias("pos", "value"))


def shared(spark: SparkSession, name: str) -> str:
    """A new folder that executors and driver share: below spark.checkpoint.dir as Spark resolves it, or, where that is unset, below the warehouse."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        own = context.getConf().get("spark.checkpoint.dir") or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/noctua-checkpoints"
        context.setCheckpointDir(own)
    return f"{context.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


U, S, M = "WITH " + b.USABILITY, "WITH " + b.USABILITY + "," + b.STAGES, "WITH " + b.NUMBERED + "," + b.MOBILITY
BAD = """,
c AS (SELECT night_id, epoch_idx // 3 AS g, epoch_idx, CAST(2 * sum(CAST(label <> 0 AS INT)) > count(*) AS INT) AS bad FROM u GROUP BY ALL),
g AS (SELECT night_id, g AS epoch_idx, 2 * sum(bad) > count(*) AS unusable FROM c GROUP BY ALL HAVING count(*) = 3)"""
OVERLAY = S + BAD + """,
o AS (SELECT s.night_id, s.epoch_idx, CASE WHEN unusable THEN -1 ELSE stage END AS stage FROM s JOIN g USING (night_id, epoch_idx))"""
LIGHTS = """,
r AS (SELECT night_id, epoch_idx, epoch_idx - row_number() OVER (PARTITION BY night_id ORDER BY epoch_idx) AS run FROM m WHERE label = 1),
i AS (SELECT night_id, min(epoch_idx) AS start, max(epoch_idx) AS stop, count(*) AS n FROM r GROUP BY night_id, run HAVING count(*) >= 2),
l AS (SELECT night_id, CAST(min(start) AS INTEGER) AS lo, CAST(max(stop) + 1 AS INTEGER) AS li FROM i GROUP BY night_id HAVING min(start) <> max(stop))"""
NIGHTS = OVERLAY + "," + b.MOBILITY + LIGHTS + """,
cb AS (SELECT night_id, lo // 3 AS start, (li - 1) // 3 + 1 AS stop FROM l)"""


@query(U + " SELECT night_id, epoch_idx, channel, CASE WHEN label = 4 THEN 0 ELSE label END AS label FROM u")
def p5_ignore_m_shaped(spark, sf_dir):
    return majority.ignore_m_shaped(b.usability(spark, sf_dir))


@query(U + " SELECT night_id, epoch_idx, channel, label, CAST(label <> 0 AS INT) AS unusable FROM u")
def p6_unusable_flags(spark, sf_dir):
    return majority.unusable_flags(b.usability(spark, sf_dir))


@query(U + " SELECT night_id, epoch_idx, 2 * sum(CAST(label <> 0 AS INT)) > count(*) AS unusable FROM u GROUP BY ALL")
def a1_channel_majority(spark, sf_dir):
    return majority.channel_majority(b.usability(spark, sf_dir))


@query(U + BAD + " SELECT night_id, epoch_idx, unusable FROM g")
def a2_epoch_majority(spark, sf_dir):
    return majority.epoch_majority(b.usability(spark, sf_dir))


@query(OVERLAY + " SELECT night_id, epoch_idx, stage FROM o")
def a3_overlay(spark, sf_dir):
    return majority.overlay(b.usability(spark, sf_dir), b.stages(spark, sf_dir))


@query(S + BAD + " SELECT night_id, epoch_idx, stage, unusable FROM s JOIN g USING (night_id, epoch_idx)")
def j2_usability_with_stages(spark, sf_dir):
    return b.stages(spark, sf_dir).join(majority.epoch_majority(b.usability(spark, sf_dir)), ["night_id", "epoch_idx"])


@query(S + """ SELECT night_id, a.n AS n_usability, t.n AS n_stages FROM (SELECT night_id, CAST(max(epoch_idx) + 1 AS BIGINT) AS n FROM u GROUP BY 1) a
JOIN (SELECT night_id, count(*) + CAST(CAST(night_id AS BIGINT) % 3 = 0 AS BIGINT) AS n FROM s GROUP BY 1) t USING (night_id) WHERE a.n // 3 <> t.n""")
def j3_length_mismatch(spark, sf_dir):
    """Every third night has a stage too many."""
    stages = b.stages(spark, sf_dir)
    last = stages.groupBy("night_id").agg((F.max("epoch_idx") + 1).alias("epoch_idx"), F.lit(0).alias("stage"))
    return majority.length_mismatch(b.usability(spark, sf_dir), stages.unionByName(last.where(F.col("night_id").cast("long") % 3 == 0)))


@query(U + """ SELECT night_id, p AS usable_percent, CASE WHEN p < 50 THEN 'low' WHEN p < 80 THEN 'fair' ELSE 'good' END AS band
FROM (SELECT night_id, avg(CAST(label = 0 AS INT)) * 100 AS p FROM u GROUP BY 1)""")
def a4_usable_percent(spark, sf_dir):
    return majority.usable_percent(b.usability(spark, sf_dir))


@query(U + " SELECT night_id, CAST(unnest(range(n)) AS INTEGER) AS epoch_idx, 9 AS stage FROM (SELECT night_id, (max(epoch_idx) + 1) // 3 AS n FROM u GROUP BY 1)")
def a9_pseudo_scores(spark, sf_dir):
    return majority.pseudo_scores(b.usability(spark, sf_dir))


@query(U + """, n AS (SELECT *, CASE WHEN label = 3 AND epoch_idx % 2 = 0 THEN 0 ELSE label END AS now FROM u)
SELECT night_id, count(*) FILTER (label = 3) AS n_spiky, count(*) FILTER (label = 3 AND now = 0) AS n_recovered,
round(count_if(label = 3 AND now = 0) / nullif(count_if(label = 3), 0) * 100, 2) AS recovered_percent FROM n GROUP BY 1""")
def a5_recovery(spark, sf_dir):
    before = b.usability(spark, sf_dir)
    after = before.withColumn("label", F.when((F.col("label") == 3) & (F.col("epoch_idx") % 2 == 0), 0).otherwise(F.col("label")))
    return majority.recovery(before, after)


@query(U + " SELECT night_id, channel, epoch_idx, label, CASE WHEN label = 3 AND epoch_idx % 2 = 0 THEN 0 ELSE label END AS now FROM u")
def j7_before_and_after(spark, sf_dir):
    before = b.usability(spark, sf_dir)
    after = before.withColumn("now", F.when((F.col("label") == 3) & (F.col("epoch_idx") % 2 == 0), 0).otherwise(F.col("label"))).drop("label")
    return before.join(after, epochs.KEY).select(*epochs.KEY, "label", "now")


@query(M + LIGHTS + """ SELECT night_id, lo AS lights_out_epoch, li AS lights_on_epoch, lo * 10 AS lights_out_second, li * 10 AS lights_on_second,
CAST(lo AS BIGINT) * 2560 AS lights_out_data_index, CAST(li AS BIGINT) * 2560 AS lights_on_data_index FROM l""")
def w1_lights(spark, sf_dir):
    return bedtime.lights(b.mobility(spark, sf_dir), least_run=RUN)


@query(M + LIGHTS.replace(">= 2", ">= 12") + " SELECT DISTINCT night_id FROM m WHERE night_id NOT IN (SELECT night_id FROM l)")
def w1_without_lights(spark, sf_dir):
    mobility = b.mobility(spark, sf_dir)
    return bedtime.without_lights(mobility, bedtime.lights(mobility))


@query(M + LIGHTS + " SELECT night_id, lo // 3 AS start, (li - 1) // 3 + 1 AS stop FROM l")
def a6_crop_bounds(spark, sf_dir):
    return bedtime.crop_bounds(bedtime.lights(b.mobility(spark, sf_dir), least_run=RUN), 30)


@query(NIGHTS + " SELECT night_id, epoch_idx, stage FROM o JOIN cb USING (night_id) WHERE epoch_idx >= start AND epoch_idx < stop")
def j4_crop(spark, sf_dir):
    rejected = majority.overlay(b.usability(spark, sf_dir), b.stages(spark, sf_dir))
    return bedtime.crop(rejected, bedtime.lights(b.mobility(spark, sf_dir), least_run=RUN), 30)


STATISTICS = NIGHTS + """,
t AS (SELECT o.*, coalesce(epoch_idx - start, epoch_idx) AS pos, start IS NULL OR (epoch_idx >= start AND epoch_idx < stop) AS inside, lo, li
  FROM o LEFT JOIN cb USING (night_id) LEFT JOIN l USING (night_id)),
f AS (SELECT *, min(pos) FILTER (inside AND stage > 0) OVER w AS first, max(pos) FILTER (inside AND stage > 0) OVER w AS last FROM t WINDOW w AS (PARTITION BY night_id)),
k AS (SELECT night_id, count(*) AS total, any_value(lo) * 10 AS lo, any_value(li) * 10 AS li, count_if(inside) AS n, count_if(inside AND stage <> -1) AS ok, count_if(inside AND stage > 0) AS sl,
  any_value(first) AS first, any_value(last) AS last, max(pos) FILTER (inside) AS fin, count_if(inside AND stage = 0 AND pos > first AND pos < last) AS wake,
  count_if(inside AND stage = 1) AS n1, count_if(inside AND stage = 2) AS n2, count_if(inside AND stage = 3) AS n3, count_if(inside AND stage = 4) AS n4,
  min(pos) FILTER (inside AND stage = 1) AS f1, min(pos) FILTER (inside AND stage = 2) AS f2, min(pos) FILTER (inside AND stage = 3) AS f3, min(pos) FILTER (inside AND stage = 4) AS f4
  FROM f GROUP BY night_id),
st AS (SELECT night_id, total * 0.5::DOUBLE AS Scores_duration_min, lo::DOUBLE AS Lights_out_sec, li::DOUBLE AS Lights_on_sec, n * 0.5::DOUBLE AS TIB_min, round(ok / n * 100, 2) AS Scorable_pct,
  CASE WHEN sl = 0 THEN 0 ELSE (last - first + 1) * 0.5::DOUBLE END AS SPT_min, sl * 0.5::DOUBLE AS TST_min,
  n1 * 0.5::DOUBLE AS N1_min, round(n1 / nullif(sl, 0) * 100, 2) AS N1_pct, n2 * 0.5::DOUBLE AS N2_min, round(n2 / nullif(sl, 0) * 100, 2) AS N2_pct,
  n3 * 0.5::DOUBLE AS N3_min, round(n3 / nullif(sl, 0) * 100, 2) AS N3_pct, n4 * 0.5::DOUBLE AS REM_min, round(n4 / nullif(sl, 0) * 100, 2) AS REM_pct,
  (n1 + n2 + n3) * 0.5::DOUBLE AS NREM_min, round((n1 + n2 + n3) / nullif(sl, 0) * 100, 2) AS NREM_pct, CASE WHEN sl > 0 THEN wake * 0.5::DOUBLE END AS WASO_min, first * 0.5::DOUBLE AS SOL_min,
  f1 * 0.5::DOUBLE AS N1_latency_min, f2 * 0.5::DOUBLE AS N2_latency_min, f3 * 0.5::DOUBLE AS N3_latency_min, f4 * 0.5::DOUBLE AS REM_latency_min,
  (fin - last) * 0.5::DOUBLE AS PSW_min, CASE WHEN sl = 0 THEN 0 ELSE round(sl / n * 100, 2) END AS SE_pct, CASE WHEN sl > 0 THEN round(sl / (last - first + 1) * 100, 2) END AS SME_pct
  FROM k WHERE n * 0.5 > 1)"""


@query(STATISTICS + " SELECT * FROM st")
def a7_sleep_statistics(spark, sf_dir):
    rejected = majority.overlay(b.usability(spark, sf_dir), b.stages(spark, sf_dir))
    return sleepstats.sleep_statistics(rejected, bedtime.lights(b.mobility(spark, sf_dir), least_run=RUN))


@query(S + """ SELECT night_id, min(epoch_idx) FILTER (stage > 0) AS first_sleep, max(epoch_idx) FILTER (stage > 0) AS last_sleep FROM s GROUP BY 1""")
def w2_sleep_bounds(spark, sf_dir):
    asleep = F.when(F.col("stage") > 0, F.col("epoch_idx"))
    return b.stages(spark, sf_dir).groupBy("night_id").agg(F.min(asleep).alias("first_sleep"), F.max(asleep).alias("last_sleep"))


@query("WITH " + b.NUMBERED + " SELECT night_id, rn AS epoch_idx, value FROM e")
def w3_positions(spark, sf_dir):
    return b.numbered(spark, sf_dir).select("night_id", F.col("rn").alias("epoch_idx"), "value")


@query(OVERLAY + """, h AS (SELECT night_id, epoch_idx, stage, 0 AS origin FROM o WHERE CAST(night_id AS BIGINT) % 2 = 0)
SELECT * FROM h UNION ALL SELECT night_id, epoch_idx, stage, 1 FROM s WHERE night_id NOT IN (SELECT night_id FROM h)""")
def a8_best_scores(spark, sf_dir):
    stages = b.stages(spark, sf_dir)
    fresh = majority.overlay(b.usability(spark, sf_dir), stages).where(F.col("night_id").cast("long") % 2 == 0)
    return sleepstats.best_scores([fresh, stages], stages)[0]


SOURCES = ("rejected", "rejected_saved", "stages", "stages_saved")


@query(OVERLAY + """, o2 AS (SELECT *, CAST(night_id AS BIGINT) % 5 AS kind FROM o), s2 AS (SELECT *, CAST(night_id AS BIGINT) % 5 AS kind FROM s),
cand AS (SELECT night_id, stage, kind FROM o2 WHERE kind IN (0, 1) UNION ALL SELECT night_id, stage, kind FROM s2 WHERE kind IN (2, 3))
SELECT night_id, ['rejected', 'rejected_saved', 'stages', 'stages_saved'][CAST(kind AS INTEGER) + 1] AS source, count(*) AS n, CAST(sum(stage) AS BIGINT) AS total, CAST(NULL AS INTEGER) AS code FROM cand GROUP BY night_id, kind
UNION ALL SELECT DISTINCT night_id, NULL, 0, NULL, 10 FROM s2 WHERE kind = 4""")
def a8_four_sources(spark, sf_dir):
    """Each fifth of the nights has its scores from another of the four sources, in their order; the last has none (error 10)."""
    stages = b.stages(spark, sf_dir)
    kind = F.col("night_id").cast("long") % 5
    rejected, folder = majority.overlay(b.usability(spark, sf_dir), stages), shared(spark, "saved")
    sinks.write_nights(sinks.rejected_scores(rejected.where(kind == 1)), f"{folder}/rejected")
    sinks.write_nights(stages.where(kind == 3), f"{folder}/stages")
    saved = [spark.read.parquet(f"{folder}/{n}").withColumn("night_id", F.col("night_id").cast("string")).select("night_id", "epoch_idx", "stage") for n in ("rejected", "stages")]
    chosen, none = sleepstats.best_scores([rejected.where(kind == 0), saved[0], stages.where(kind == 2), saved[1]], stages)
    found = chosen.groupBy("night_id", "origin").agg(F.count("*").alias("n"), F.sum("stage").alias("total"))
    found = found.select("night_id", F.array(*map(F.lit, SOURCES))[F.col("origin")].alias("source"), "n", "total", F.lit(None).cast("int").alias("code"))
    return found.unionByName(none.select("night_id", F.lit(None).cast("string").alias("source"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("total"), F.lit(10).alias("code")))


@query(STATISTICS + """, h AS (SELECT night_id, '/raw/' || night_id AS src, CASE WHEN CAST(night_id AS BIGINT) % 2 = 0 THEN 'rejected' ELSE 'stages' END AS origin FROM st)
SELECT night_id, unnest(['Data_source', 'Sleep_score_source', 'TIB_min', 'Reference']) AS key, unnest([src, origin, CAST(TIB_min AS VARCHAR), 'noctua']) AS value FROM st JOIN h USING (night_id)""")
def s11_statistics_with_sources(spark, sf_dir):
    """Statistics as pairs, with where the night lies, which scores they are of, and what made them."""
    found = a7_sleep_statistics(spark, sf_dir).select("night_id", "TIB_min")
    facts = found.select("night_id", F.concat(F.lit("/raw/"), "night_id").alias("src_path"), (F.col("night_id").cast("long") % 2 * 2).cast("int").alias("origin"))
    return sleepstats.to_pairs(sleepstats.with_sources(found, facts, SOURCES, "noctua"))


@query(STATISTICS + """ SELECT night_id, TIB_min, SPT_min, TST_min, SOL_min FROM st""")
def s11_s12_statistics_as_pairs(spark, sf_dir):
    """To key and value, and back."""
    keys = ["TIB_min", "SPT_min", "TST_min", "SOL_min"]
    pairs = sleepstats.to_pairs(a7_sleep_statistics(spark, sf_dir).select("night_id", *keys))
    return sleepstats.from_pairs(pairs, keys).select("night_id", *(F.col(k).cast("double").alias(k) for k in keys))


@query("WITH " + b.NUMBERED + """ SELECT night_id, CAST(count(*) AS DOUBLE) AS seconds, CASE WHEN count(*) < 60 THEN 2 END AS code FROM e GROUP BY 1""")
def p1_durations(spark, sf_dir):
    return checks.durations(b.samples(spark, sf_dir))


@query("WITH " + b.AXES + " SELECT night_id, min(value) AS low, max(value) AS high, CASE WHEN min(value) < -2 OR max(value) > 1 THEN 12 END AS code FROM a GROUP BY 1")
def p2_acceleration_range(spark, sf_dir):
    return checks.acceleration_in_range(b.axes(spark, sf_dir), high=1.0)


@query("SELECT CAST(l_orderkey AS VARCHAR) AS night_id, count(*) AS n FROM lineitem GROUP BY 1 HAVING max(l_quantity / 25 - 1) <= 0.5 AND min(l_quantity / 25 - 1) >= -0.9")
def p2_passing(spark, sf_dir):
    """The lines of an order as a night of one axis: some nights leave the range, some do not."""
    rows = b.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("night_id"), F.lit("dX").alias("channel"), (F.col("l_quantity") / 25 - 1).alias("value"))
    return checks.passing(rows, checks.acceleration_in_range(rows, -0.9, 0.5)).groupBy("night_id").agg(F.count("*").alias("n"))


@query(S + """, q AS (SELECT night_id, CASE WHEN CAST(night_id AS BIGINT) % 7 = 0 AND epoch_idx = 0 THEN NULL WHEN CAST(night_id AS BIGINT) % 5 = 0 THEN stage + 3 ELSE stage END AS stage FROM s),
n AS (SELECT night_id, count(*) AS n, count_if(stage IS NULL) AS bad, min(stage) AS low, max(stage) AS high FROM q GROUP BY 1),
d AS (SELECT night_id, max(epoch_idx) + 1 AS u FROM u GROUP BY 1)
SELECT night_id, CASE WHEN bad > 0 THEN 4 WHEN u * 10 // 30 <> n THEN 5 WHEN (u - CAST(night_id AS BIGINT) % 3) // 3 <> n THEN 7 WHEN low < 0 OR high > 5 THEN 6 END AS code FROM n JOIN d USING (night_id)""")
def p3_stage_faults(spark, sf_dir):
    night = F.col("night_id").cast("long")
    stage = F.when((night % 7 == 0) & (F.col("epoch_idx") == 0), None).when(night % 5 == 0, F.col("stage") + 3).otherwise(F.col("stage"))
    facts = b.usability(spark, sf_dir).groupBy("night_id").agg((F.max("epoch_idx") + 1).alias("n"))
    facts = facts.select("night_id", (F.col("n") * 10).alias("seconds"), (F.col("n") - night % 3).alias("n_usability"))
    return checks.stage_faults(b.stages(spark, sf_dir).withColumn("stage", stage), facts)


@query(S + """, q AS (SELECT night_id, epoch_idx, stage + CAST(CAST(night_id AS BIGINT) % 2 AS INTEGER) AS stage FROM s)
SELECT night_id, epoch_idx, CASE WHEN stage = 5 AND max(CAST(stage = 4 AS INT)) OVER (PARTITION BY night_id) = 1 THEN 4 ELSE stage END AS stage FROM q""")
def p4_unify_rem(spark, sf_dir):
    shifted = F.col("stage") + (F.col("night_id").cast("long") % 2).cast("int")
    return checks.unify_rem(b.stages(spark, sf_dir).withColumn("stage", shifted), only_if_both=True)


@query(U + " SELECT night_id, channel, count(*) AS n_spiky, string_agg(CAST(epoch_idx AS VARCHAR), ',' ORDER BY epoch_idx) AS epochs FROM u WHERE label = 3 GROUP BY 1, 2")
def p7_spiky_epochs(spark, sf_dir):
    return checks.spiky_epochs(b.usability(spark, sf_dir)).withColumn("epochs", F.array_join(F.col("epochs").cast("array<string>"), ","))


@query("SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width FROM embeddings WHERE len(embedding) <> 63")
def p8_wrong_width(spark, sf_dir):
    return checks.wrong_width(b.vectors(spark, sf_dir), 63, "samples").select("vec_id", "width")


@query(U + """, p AS (SELECT DISTINCT night_id, channel FROM u WHERE label = 2)
SELECT night_id, CASE WHEN max(channel) = 'C0' THEN 'C1,C2' WHEN min(channel) = 'C1' THEN 'C0,C2' ELSE 'C2' END AS missing FROM p GROUP BY 1""")
def s3_missing_channels(spark, sf_dir):
    return checks.missing_channels(b.usability(spark, sf_dir).where("label = 2"), ["C0", "C1", "C2"]).withColumn("missing", F.array_join("missing", ","))


@query("WITH " + b.NUMBERED + "," + b.MOBILITY + LIGHTS.replace(">= 2", ">= 12") + """
SELECT night_id, 2 AS code, 'the recording is shorter than a minute' AS reason, true AS fatal FROM e GROUP BY 1 HAVING count(*) < 60
UNION ALL SELECT DISTINCT night_id, 9, 'no lights-out or lights-on moment', false FROM m WHERE night_id NOT IN (SELECT night_id FROM l)""")
def s14_error_report(spark, sf_dir):
    return checks.error_report([checks.durations(b.samples(spark, sf_dir)), w1_without_lights(spark, sf_dir).withColumn("code", F.lit(9))])


@query("WITH " + b.NUMBERED + """, n AS (SELECT night_id, count(*) < 60 AS failed FROM e GROUP BY 1)
SELECT count(*) AS n_nights, count(*) FILTER (failed) AS n_failed, count(*) FILTER (NOT failed) AS n_passed FROM n""")
def s14_success_count(spark, sf_dir):
    return checks.success_count(b.samples(spark, sf_dir), s14_error_report(spark, sf_dir))


@query("WITH " + b.NUMBERED + "," + b.SAMPLES + """ SELECT night_id, channel, sample_idx, value, fs FROM x JOIN (SELECT night_id, count(*) // 10 * 10 AS n FROM x GROUP BY 1) USING (night_id) WHERE sample_idx < n""")
def g2_crop_to_epochs(spark, sf_dir):
    return epochs.crop_to_epochs(b.samples(spark, sf_dir))


@query("WITH " + b.NUMBERED + "," + b.SAMPLES + """ SELECT night_id, channel, sample_idx, value, fs FROM x JOIN (SELECT night_id, count(*) // 10 * 10 AS n FROM x GROUP BY 1) USING (night_id) WHERE sample_idx >= n""")
def f2_tail(spark, sf_dir):
    return epochs.tail(b.samples(spark, sf_dir))


NORM = "WITH " + b.AXES + ", nm AS (SELECT night_id, sample_idx, dX * dX + dY * dY + dZ * dZ AS sq FROM w)"


@query(NORM + " SELECT night_id, sample_idx, round(sqrt(sq), 6) AS value FROM nm")
def g3_norm(spark, sf_dir):
    return epochs.norm(b.axes(spark, sf_dir)).select("night_id", "sample_idx", F.round("value", 6).alias("value"))


@query(NORM + """, x AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, list(round(sqrt(sq), 6) ORDER BY sample_idx) AS samples FROM nm GROUP BY ALL HAVING count(*) = 160)
SELECT night_id, 'ACCagg' AS channel, epoch_idx, CAST(unnest(range(160)) AS INTEGER) AS pos, unnest(samples) AS value FROM x""")
def g3_norm_of_epochs(spark, sf_dir):
    """From epochs of the axes, as recordings are decoded."""
    made = epochs.norm_of_epochs(epochs.to_epochs(b.axes(spark, sf_dir)))
    return each(made.select(*epochs.KEY, "samples"), "samples").withColumn("value", F.round("value", 6))


def acceleration(spark, sf_dir):
    """Whole epochs of the norm of axes that come as columns."""
    return epochs.to_epochs(epochs.norm_of_columns(b.wide_axes(spark, sf_dir)))


EPOCHS = "WITH " + b.NUMBERED + "," + b.SAMPLES + ", ep AS (SELECT night_id, channel, CAST(sample_idx // 10 AS INTEGER) AS epoch_idx, 1 AS fs, list(value ORDER BY sample_idx) AS samples FROM x GROUP BY 1, 2, 3 HAVING count(*) = 10)"


@query(EPOCHS + " SELECT night_id, channel, epoch_idx, fs, CAST(unnest(range(10)) AS INTEGER) AS pos, unnest(samples) AS value FROM ep")
def g4_epochs(spark, sf_dir):
    return each(epochs.to_epochs(b.samples(spark, sf_dir)), "samples")


@query(EPOCHS + " SELECT night_id, channel, CAST(epoch_idx AS BIGINT) * 10 + unnest(range(10)) AS sample_idx, unnest(samples) AS value, 1 AS fs FROM ep")
def f2_stitched(spark, sf_dir):
    return epochs.to_samples(epochs.to_epochs(b.samples(spark, sf_dir)))


@query(S + " SELECT night_id, epoch_idx, epoch_idx * 30 + 1.0::DOUBLE / 256 AS start_time_sec, CAST((epoch_idx + 1) * 30 AS DOUBLE) AS end_time_sec FROM s")
def g5_timestamps(spark, sf_dir):
    return epochs.timestamps(b.stages(spark, sf_dir).drop("stage"), 30)


@query(S + " SELECT night_id, epoch_idx, CAST(epoch_idx AS BIGINT) * 7680 AS start_data_index, (CAST(epoch_idx AS BIGINT) + 1) * 7680 - 1 AS end_data_index FROM s")
def g6_data_indices(spark, sf_dir):
    return epochs.data_indices(b.stages(spark, sf_dir).drop("stage"), 30)


@query(EPOCHS + " SELECT night_id, 'ACCagg' AS channel, epoch_idx, 1 AS fs, CAST(unnest(range(10)) AS INTEGER) AS pos, 1.0::DOUBLE AS value FROM ep")
def g7_pseudo_acceleration(spark, sf_dir):
    return each(epochs.pseudo_acceleration(epochs.to_epochs(b.samples(spark, sf_dir))), "samples")


@query("WITH " + b.AXES + " SELECT night_id, 16 AS fs, count(*) / 3 / 16 AS seconds, CAST(3 AS BIGINT) AS n_channels FROM a GROUP BY 1")
def g8_night_facts(spark, sf_dir):
    return epochs.night_facts(b.axes(spark, sf_dir))


def resampled(rate: int) -> str:
    """SQL of the not-a-knot spline through a night's samples (of one a second), by elimination from sample to sample."""
    return "WITH RECURSIVE " + b.NUMBERED + "," + b.SAMPLES + f""",
k AS (SELECT night_id, channel, list(value ORDER BY sample_idx) AS y, CAST(count(*) AS INTEGER) AS n FROM x GROUP BY 1, 2),
q AS (SELECT *, list_transform(range(1, n - 1), lambda i: 6 * (y[i] - 2 * y[i + 1] + y[i + 2])) AS e FROM k),
f AS (SELECT night_id, channel, y, n, e, 2 AS i, [0.25::DOUBLE] AS c, [(e[2] - e[1] / 6 - CASE WHEN n = 5 THEN e[n - 2] / 6 ELSE 0 END) / 4] AS d FROM q
  UNION ALL SELECT night_id, channel, y, n, e, i + 1, list_append(c, 1 / (4 - c[-1])), list_append(d, (e[i + 1] - d[-1] - CASE WHEN i + 1 = n - 3 THEN e[n - 2] / 6 ELSE 0 END) / (4 - c[-1])) FROM f WHERE i < n - 3),
g AS (SELECT night_id, channel, y, n, e, c, d, len(d) AS i, [d[-1]] AS m FROM f WHERE i = n - 3
  UNION ALL SELECT night_id, channel, y, n, e, c, d, i - 1, list_prepend(d[i - 1] - c[i - 1] * m[1], m) FROM g WHERE i > 1),
h AS (SELECT night_id, channel, y, n, [2 * e[1] / 6 - m[1], e[1] / 6] || m || [e[n - 2] / 6, 2 * e[n - 2] / 6 - m[-1]] AS m FROM g WHERE i = 1),
o AS (SELECT *, unnest(range({rate} * n)) AS p FROM h),
r AS (SELECT night_id, channel, y, m, p, least(p // {rate}, n - 2) AS i, p / {rate} - least(p // {rate}, n - 2) AS b FROM o)
SELECT night_id, channel, p AS sample_idx, round((1 - b) * y[i + 1] + b * y[i + 2] + ((power(1 - b, 3) - (1 - b)) * m[i + 1] + (power(b, 3) - b) * m[i + 2]) / 6, 6) AS value FROM r"""


@query(resampled(2))
def g1_resample(spark, sf_dir):
    """From 1 to 2 samples a second, in blocks of 32."""
    doubled = signals.resample(b.samples(spark, sf_dir), target=2, block=32)
    return doubled.select("night_id", "channel", "sample_idx", F.round("value", 6).alias("value"))


@query(resampled(3))
def g1_resample_between(spark, sf_dir):
    """From 1 to 3 samples a second, in one block for each night."""
    tripled = signals.resample(b.samples(spark, sf_dir), target=3)
    return tripled.select("night_id", "channel", "sample_idx", F.round("value", 6).alias("value"))


@query(resampled(3))
def g1_resample_blocks(spark, sf_dir):
    """The same from blocks of 64 seconds, which send their edges to their neighbours."""
    part = F.floor(F.col("sample_idx") / 64).cast("int").alias("epoch_idx")
    blocks = b.samples(spark, sf_dir).groupBy("night_id", "channel", part).agg(F.first("fs").alias("fs"), F.sort_array(F.collect_list(F.struct("sample_idx", "value"))).alias("s"))
    made = signals.resample_blocks(blocks.withColumn("samples", F.transform("s", lambda x: x["value"])), 3, 64)
    rows = each(made, "samples")
    return rows.select("night_id", "channel", (F.col("epoch_idx").cast("long") * 192 + F.col("pos")).alias("sample_idx"), F.round("value", 6).alias("value"))


PAIRED = "WITH " + b.AXES + """, x AS (SELECT night_id, channel, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, count(*) AS n, round(sum(value), 6) AS total FROM a GROUP BY ALL HAVING count(*) = 160)
SELECT p.night_id, p.channel, p.epoch_idx, p.total, q.total AS acc_total FROM x p JOIN x q ON q.channel = 'dZ' AND p.channel <> 'dZ' AND p.night_id = q.night_id AND p.epoch_idx = q.epoch_idx"""


def saved_totals(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Totals of epochs of dX and dY, and of dZ, as two tables of buckets."""
    names = [f"features_{part}_{uuid.uuid4().hex}" for part in ("eeg", "acc")]
    whole = epochs.to_epochs(b.axes(spark, sf_dir)).withColumn("total", F.round(F.aggregate("samples", F.lit(0.0), lambda t, v: t + v), 6)).drop("samples", "fs")
    for name, part in zip(names, (whole.where("channel <> 'dZ'"), whole.where("channel = 'dZ'"))):
        sinks.save_features(part, name, 8)
    return tuple(spark.table(n) for n in names)


@query(PAIRED)
def s8_j1_from_saved_features(spark, sf_dir):
    """Channels paired with the acceleration from saved features, without a shuffle."""
    return epochs.pair_with_acceleration(*saved_totals(spark, sf_dir), ["total"]).select(*epochs.KEY, "total", "acc_total")


@query(PAIRED)
def j1_pair_with_acceleration(spark, sf_dir):
    whole = epochs.to_epochs(b.axes(spark, sf_dir)).withColumn("total", F.round(F.aggregate("samples", F.lit(0.0), lambda t, v: t + v), 6)).drop("samples")
    return epochs.pair_with_acceleration(whole.where("channel <> 'dZ'"), whole.where("channel = 'dZ'"), ["total"]).select(*epochs.KEY, "total", "acc_total")


def vector_parts(spark, sf_dir):
    part = lambda i: F.slice("samples", i, 4)
    return b.vectors(spark, sf_dir).select("night_id", "channel", "epoch_idx", *(part(1 + 4 * i).alias(n) for i, n in enumerate(("spec", "acc_spec", "stat", "acc_stat"))))


@query("WITH " + b.VECTORS + " SELECT night_id, 'EEG' AS channel, epoch_idx, CAST(unnest(range(16)) AS INTEGER) AS pos, unnest(samples[1:16]) AS value FROM v")
def x6_usability_vector(spark, sf_dir):
    return each(epochs.usability_vector(vector_parts(spark, sf_dir)), "features")


@query("WITH " + b.VECTORS + " SELECT night_id, 'EEG' AS channel, epoch_idx, CAST(unnest(range(8)) AS INTEGER) AS pos, unnest(samples[1:8]) AS value FROM v")
def x7_lite_vector(spark, sf_dir):
    return each(epochs.lite_vector(vector_parts(spark, sf_dir)), "features")


@query("WITH " + b.AXES + """, x AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, round(min(dX), 6) AS a, round(max(dX), 6) AS b, round(min(dY), 6) AS c, round(max(dY), 6) AS d, round(min(dZ), 6) AS e, round(max(dZ), 6) AS f
FROM w GROUP BY ALL HAVING count(*) = 160) SELECT night_id, epoch_idx, CAST(unnest(range(6)) AS INTEGER) AS pos, unnest([a, b, c, d, e, f]) AS value FROM x""")
def x8_mobility_vector(spark, sf_dir):
    axes = epochs.to_epochs(b.axes(spark, sf_dir)).withColumn("stat", F.array(F.round(F.array_min("samples"), 6), F.round(F.array_max("samples"), 6)))
    return each(epochs.mobility_vector(axes, "stat"), "features")


@query(U + """, f AS (SELECT night_id, channel, epoch_idx, label + 10 AS label FROM u WHERE label = 3)
SELECT u.night_id, u.channel, u.epoch_idx, coalesce(f.label, u.label) AS label FROM u LEFT JOIN f USING (night_id, channel, epoch_idx)""")
def j5_put_back(spark, sf_dir):
    usability = b.usability(spark, sf_dir)
    changed = usability.where("label = 3").withColumn("label", F.col("label") + 10)
    return epochs.put_back(usability, changed, "label").select(*epochs.KEY, "label")


@query("WITH " + b.VECTORS + " SELECT night_id, 'EEG' AS channel, epoch_idx, CAST(unnest(range(8)) AS INTEGER) AS pos, unnest(CASE WHEN vec_id % 3 = 0 THEN list_reverse(samples[1:8]) ELSE samples[1:8] END) AS value FROM v")
def j6_replace_features(spark, sf_dir):
    rows = b.vectors(spark, sf_dir).select(*epochs.KEY, F.slice("samples", 1, 8).alias("features"), "vec_id")
    return each(epochs.put_back(rows, rows.where("vec_id % 3 = 0").withColumn("features", F.reverse("features")), "features").select(*epochs.KEY, "features"), "features")


@query("SELECT url AS path FROM pages WHERE page_id % 3 <> 0 UNION SELECT url FROM pages WHERE page_id % 2 = 0")
def j8_merge_listings(spark, sf_dir):
    pages = b.table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return epochs.merge_listings(pages.where("page_id % 3 <> 0").select("path"), pages.where("page_id % 2 = 0").select("path"))


@query("WITH " + b.VECTORS + """, m AS (SELECT night_id, epoch_idx, samples, list_avg(samples) AS mean FROM v),
z AS (SELECT night_id, epoch_idx, j, (samples[j + 1] - mean) * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS d FROM m, (SELECT CAST(unnest(range(64)) AS INTEGER) AS j)),
h AS (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 64), 2)) AS w FROM (SELECT unnest(range(64)) AS j)),
y AS (SELECT night_id, epoch_idx, k, (power(sum(d * cos(2 * pi() * k * j / 64)), 2) + power(sum(d * sin(2 * pi() * k * j / 64)), 2)) * CASE WHEN k IN (0, 32) THEN 1 ELSE 2 END / (64 * any_value(w)) AS x
  FROM z, h, (SELECT unnest(range(33)) AS k) GROUP BY 1, 2, 3)
SELECT night_id, 'EEG' AS channel, epoch_idx, k, round(x, 4) AS density FROM y""")
def x2_power_features(spark, sf_dir):
    found = signals.power_features(b.vectors(spark, sf_dir))
    return found.select(*epochs.KEY, F.posexplode("pow").alias("k", "density")).withColumn("density", F.round(F.col("density") + 0.0, 4)).withColumn("k", F.col("k").cast("long"))


@query("WITH " + b.RECORDING + """,
ep AS (SELECT night_id, CAST(sample_idx // 2560 AS INTEGER) AS epoch_idx, list(value ORDER BY sample_idx) AS y FROM rec GROUP BY 1, 2 HAVING count(*) = 2560),
w AS (SELECT j, CASE WHEN j < 32 THEN 0.5 * (1 - cos(pi() * j / 32)) WHEN j > 224 THEN 0.5 * (1 - cos(pi() * (256 - j) / 32)) ELSE 1 END AS w FROM (SELECT CAST(unnest(range(256)) AS INTEGER) AS j)),
g AS (SELECT night_id, epoch_idx, t, y[t * 224 + 1 : t * 224 + 256] AS y FROM ep, (SELECT CAST(unnest(range(11)) AS INTEGER) AS t)),
d AS (SELECT night_id, epoch_idx, t, j, (y[j + 1] - list_avg(y)) * w AS v FROM g, w),
z AS (SELECT night_id, epoch_idx, t, k, (power(sum(v * cos(2 * pi() * (k * j % 256) / 256)), 2) + power(sum(v * sin(2 * pi() * (k * j % 256) / 256)), 2)) * CASE WHEN k IN (0, 128) THEN 1 ELSE 2 END / (256 * any_value(h)) AS x
  FROM d, (SELECT sum(w * w) AS h FROM w), (SELECT CAST(unnest(range(129)) AS INTEGER) AS k) GROUP BY night_id, epoch_idx, t, k)
SELECT night_id, 'EEG' AS channel, epoch_idx, t * 129 + k AS pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 9) AS density FROM z""")
def x1_spectrogram_features(spark, sf_dir):
    """Of epochs of 2560 points, as recordings have them at 256 samples a second."""
    found = signals.spectrogram_features(epochs.to_epochs(b.recording(spark, sf_dir)))
    return found.select(*epochs.KEY, F.posexplode("spec").alias("pos", "density")).withColumn("density", F.round("density", 9))


@query()
def x1_stretched_features(spark, sf_dir):
    """Of whole epochs of the acceleration norm, of 160 points, brought to 2560."""
    return signals.spectrogram_features(acceleration(spark, sf_dir)).select(*epochs.KEY, "spec")


@query(NORM + """, x AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, channel, list(value ORDER BY sample_idx) AS y FROM a GROUP BY ALL HAVING count(*) = 160),
m AS (SELECT *, list_avg(y) AS mean FROM x), js AS (SELECT CAST(unnest(range(160)) AS INTEGER) AS j),
d AS (SELECT night_id, epoch_idx, channel, j, (y[j + 1] - mean) * (0.5 - 0.5 * cos(2 * pi() * j / 160)) AS v FROM m, js), h AS (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 160), 2)) AS h FROM js),
z AS (SELECT night_id, epoch_idx, channel, k, (power(sum(v * cos(2 * pi() * (k * j % 160) / 160)), 2) + power(sum(v * sin(2 * pi() * (k * j % 160) / 160)), 2)) * CASE WHEN k IN (0, 80) THEN 1 ELSE 2 END / (16 * any_value(h)) AS x
  FROM d, h, (SELECT CAST(unnest(range(81)) AS INTEGER) AS k) GROUP BY night_id, epoch_idx, channel, k)
SELECT night_id, epoch_idx, CAST(CASE channel WHEN 'dX' THEN 0 WHEN 'dY' THEN 81 ELSE 162 END + k AS INTEGER) AS pos, round(CAST(CAST(x AS FLOAT) AS DOUBLE), 5) AS density FROM z""")
def x8_mobility_power_vector(spark, sf_dir):
    """The Welch densities of the three axes, one after another."""
    found = signals.power_features(epochs.to_epochs(b.axes(spark, sf_dir)))
    return each(epochs.mobility_vector(found, "pow"), "features").select("night_id", "epoch_idx", "pos", F.round("value", 5).alias("density"))


@query("WITH " + b.VECTORS + """ SELECT night_id, 'EEG' AS channel, epoch_idx, round(list_max(samples), 6) AS max, round(list_avg(samples), 6) AS mean, round(list_min(samples), 6) AS min,
round(list_median(samples), 6) AS median, round(sqrt(list_avg(list_transform(samples, lambda x: x * x))), 6) AS rms, round(list_var_pop(samples), 6) AS variance,
round(list_sum(list_transform(samples, lambda x: x * x)), 6) AS energy, round(list_max(samples) - list_min(samples), 6) AS peak_to_peak,
round(list_sum(list_transform(range(1, 64), lambda i: abs(samples[i + 1] - samples[i]))), 6) AS sum_abs_diff,
len(list_filter(range(1, 64), lambda i: (samples[i + 1] < 0) <> (samples[i] < 0))) AS zero_crossings FROM v""")
def x3_x4_features(spark, sf_dir):
    """Those of the statistical and temporal features that SQL can state."""
    from noctua.functions.features import STATISTICAL, TEMPORAL

    found = signals.statistical_features(b.vectors(spark, sf_dir))
    at = {n: i for i, n in enumerate(STATISTICAL + TEMPORAL)}
    names = {"max": "max", "mean": "mean", "min": "min", "median": "median", "rms": "rms", "variance": "variance", "energy": "absolute_energy", "peak_to_peak": "peak_to_peak", "sum_abs_diff": "sum_abs_diff"}
    crossings = F.col("stat")[at["zero_crossings"]].cast("long").alias("zero_crossings")
    return found.select(*epochs.KEY, *(F.round(F.col("stat")[at[n]], 6).alias(k) for k, n in names.items()), crossings)


@query()
def x5_all_features(spark, sf_dir):
    """All 390 features of epochs of 2560 points."""
    return signals.statistical_features(epochs.to_epochs(b.recording(spark, sf_dir))).select(*epochs.KEY, "stat")


def statistics_in_sql() -> str:
    """All statistical and temporal features of the vectors (64 points, 64 a second) as name and value, each by its own formula."""
    total = lambda f, over="range(1, 65)": f"list_sum([{f} FOR i IN {over}])"
    middle = lambda f, over: f"list_median([{f} FOR i IN {over}])"
    d = "range(1, 64)"
    named = [(f"ecdf_{i}", f"{i + 1} / 64") for i in range(10)]
    named += [("ecdf_percentile_0.2", "s[13]"), ("ecdf_percentile_0.8", "s[52]"), ("ecdf_count_0.2", "13"), ("ecdf_count_0.8", "52")]
    named += [(f"histogram_{k}", f"len([1 FOR i IN range(1, 65) IF least(CAST(floor((x[i] - lo) / ((hi - lo) / 10)) AS INTEGER), 9) = {k}]) / (64 * ((hi - lo) / 10))") for k in range(10)]
    named += [
        ("interquartile_range", "list_aggregate(x, 'quantile_cont', 0.75) - list_aggregate(x, 'quantile_cont', 0.25)"), ("kurtosis", total("power(x[i] - mu, 4)") + " / 64 / power(va, 2) - 3"), ("max", "hi"), ("mean", "mu"),
        ("mean_abs_deviation", total("abs(x[i] - mu)") + " / 64"), ("median", "me"), ("median_abs_deviation", middle("abs(x[i] - me)", "range(1, 65)")), ("min", "lo"), ("rms", "sqrt(en / 64)"),
        ("skewness", total("power(x[i] - mu, 3)") + " / 64 / power(va, 1.5)"), ("std", "sqrt(va)"), ("variance", "va"), ("absolute_energy", "en"), ("area_under_curve", total("abs(x[i] + x[i + 1])", d) + " / 128"),
        ("autocorrelation", "coalesce(list_min([k FOR k IN range(0, 64) IF list_sum([(x[i] - mu) * (x[i + k] - mu) FOR i IN range(1, 65 - k)]) / (64 * va) <= exp(-1)]), 0)"),
        ("centroid", total("(i - 1) / 64 * x[i] * x[i]") + " / en"), ("entropy", "-" + total("CASE WHEN x[i] = 0 THEN 0 ELSE x[i] * x[i] / en * log2(x[i] * x[i] / en) END") + " / 6"),
        ("mean_abs_diff", total("abs(x[i + 1] - x[i])", d) + " / 63"), ("mean_diff", "(x[64] - x[1]) / 63"), ("median_abs_diff", middle("abs(x[i + 1] - x[i])", d)), ("median_diff", middle("x[i + 1] - x[i]", d)),
        ("negative_turning", "len([1 FOR i IN range(2, 64) IF x[i] < x[i - 1] AND x[i + 1] > x[i]])"), ("neighbourhood_peaks", "len([1 FOR i IN range(11, 55) IF x[i] > list_max(x[i - 10 : i - 1]) AND x[i] > list_max(x[i + 1 : i + 10])])"),
        ("peak_to_peak", "hi - lo"), ("positive_turning", "len([1 FOR i IN range(2, 64) IF x[i] > x[i - 1] AND x[i + 1] < x[i]])"), ("distance", total("sqrt(1 + power(x[i + 1] - x[i], 2))", d)),
        ("slope", total("(x[i] - mu) * (i - 32.5)") + " / " + total("power(i - 32.5, 2)")), ("sum_abs_diff", total("abs(x[i + 1] - x[i])", d)), ("total_energy", "en / (63 / 64)"), ("zero_crossings", f"len([1 FOR i IN {d} IF (x[i] < 0) <> (x[i + 1] < 0)])"),
    ]
    names, values = ", ".join(f"'{n}'" for n, _ in named), ", ".join(f"CAST({f} AS DOUBLE)" for _, f in named)
    return "WITH " + b.VECTORS + f""", w AS (SELECT night_id, epoch_idx, samples AS x, list_sort(samples) AS s, list_min(samples) AS lo, list_max(samples) AS hi, list_avg(samples) AS mu, list_median(samples) AS me, list_var_pop(samples) AS va,
  list_sum([y * y FOR y IN samples]) AS en FROM v),
f AS (SELECT night_id, 'EEG' AS channel, epoch_idx, unnest([{names}]) AS name, unnest([{values}]) AS value FROM w)
SELECT night_id, channel, epoch_idx, name, CASE WHEN round(value, 5) = 0 THEN 0 ELSE round(value, 5) END AS value FROM f"""


@query(statistics_in_sql())
def x3_x4_all_features(spark, sf_dir):
    """All 54 statistical and temporal features by name."""
    from noctua.functions.features import STATISTICAL, TEMPORAL

    names = F.array(*map(F.lit, STATISTICAL + TEMPORAL))
    found = signals.statistical_features(b.vectors(spark, sf_dir)).select(*epochs.KEY, F.posexplode(F.slice("stat", 1, 54)).alias("at", "value"))
    return found.select(*epochs.KEY, F.get(names, F.col("at")).alias("name"), (F.round("value", 5) + 0.0).alias("value"))


#: A small model in the text format of tree ensembles: three trees of a binary score.
TREES = """tree
version=v4
num_class=1
num_tree_per_iteration=1
objective=binary sigmoid:1

Tree=0
num_leaves=3
split_feature=0 5
threshold=0 0.05
decision_type=2 2
left_child=1 -2
right_child=-1 -3
leaf_value=0.4 -0.3 0.1

Tree=1
num_leaves=4
split_feature=63 10 2
threshold=0.02 -0.01 0.1
decision_type=2 2 2
left_child=1 -1 -2
right_child=2 -3 -4
leaf_value=0.25 -0.15 -0.35 0.05

Tree=2
num_leaves=2
split_feature=31
threshold=-0.03
decision_type=2
left_child=-1
right_child=-2
leaf_value=-0.2 0.3

end of trees
"""


@query("WITH " + b.VECTORS + """, z AS (SELECT night_id, epoch_idx,
CASE WHEN samples[1] <= 0 THEN CASE WHEN samples[6] <= 0.05 THEN -0.3 ELSE 0.1 END ELSE 0.4 END
+ CASE WHEN samples[64] <= 0.02 THEN CASE WHEN samples[11] <= -0.01 THEN 0.25 ELSE -0.35 END ELSE CASE WHEN samples[3] <= 0.1 THEN -0.15 ELSE 0.05 END END
+ CASE WHEN samples[32] <= -0.03 THEN -0.2 ELSE 0.3 END AS z FROM v)
SELECT night_id, 'EEG' AS channel, epoch_idx, CAST(z > 0 AS INTEGER) AS label, round(100 / (1 + exp(-CAST(z AS DOUBLE))), 5) AS percent FROM z""")
def m1_tree_ensemble(spark, sf_dir):
    """Scored by a model read from its text."""
    found = signals.predict(b.vectors(spark, sf_dir), trees.parse(TREES), "samples")
    return found.select(*epochs.KEY, "label", F.round(F.get("probs", F.lit(1)), 5).alias("percent"))


def slepian_in_sql() -> str:
    """The display with Slepian tapers, which here come from the dense eigenproblem of the sinc kernel."""
    n, w = 64, signals.HALF_BANDWIDTH / 64
    lag = np.arange(n)[:, None] - np.arange(n)
    share, tapers = np.linalg.eigh(2 * w * np.sinc(2 * w * lag))
    share, tapers = share[::-1][: signals.TAPERS], tapers[:, ::-1][:, : signals.TAPERS]
    values = ", ".join(f"({k}, {j}, CAST({float(tapers[j, k])!r} AS DOUBLE), CAST({float(share[k] / share.sum())!r} AS DOUBLE))" for k in range(signals.TAPERS) for j in range(n))
    return "WITH " + b.VECTORS + f""", tp AS (SELECT * FROM (VALUES {values}) AS q(t, j, a, share)),
z AS (SELECT night_id, epoch_idx, t, j, share, samples[j + 1] * a AS d FROM v, tp),
y AS (SELECT night_id, epoch_idx, k, t, any_value(share) * (power(sum(d * cos(2 * pi() * k * j / 64)), 2) + power(sum(d * sin(2 * pi() * k * j / 64)), 2)) / 64 AS x FROM z, (SELECT unnest(range(3, 33)) AS k) GROUP BY ALL),
yy AS (SELECT night_id, epoch_idx, k, sum(x) AS x FROM y GROUP BY ALL),
r AS (SELECT night_id, 'EEG' AS channel, epoch_idx, k - 3 AS bin, round(10 * log10(greatest((x - min(x) OVER n) / (max(x) OVER n - min(x) OVER n) * 10, 1e-10)), 3) AS db FROM yy WINDOW n AS (PARTITION BY night_id))
SELECT night_id, channel, epoch_idx, bin, CASE WHEN db = 0 THEN 0 ELSE db END AS db FROM r"""


@query(slepian_in_sql())
def d1_slepian_spectra(spark, sf_dir):
    found = signals.display_spectra(b.vectors(spark, sf_dir), tapers="slepian")
    return found.select(*epochs.KEY, F.posexplode("db").alias("bin", "db")).select(*epochs.KEY, F.col("bin").cast("long").alias("bin"), (F.round("db", 3) + 0.0).alias("db"))


def linear_model(x: np.ndarray) -> np.ndarray:
    """A fixed stand-in for a trained model: the softmax of the first five values."""
    z = np.exp(x[:, :5] - x[:, :5].max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


ARGMAX = "CAST(list_position(samples[1:5], list_max(samples[1:5])) - 1 AS INTEGER)"


@query("WITH " + b.VECTORS + f""", p AS (SELECT night_id, epoch_idx, {ARGMAX} AS label, list_transform(samples[1:5], lambda x: exp(x)) AS z FROM v)
SELECT night_id, 'EEG' AS channel, epoch_idx, label, round(list_max(z) / list_sum(z) * 100, 4) AS percent FROM p""")
def m1_predict(spark, sf_dir):
    found = signals.predict(b.vectors(spark, sf_dir), linear_model, "samples")
    return found.select(*epochs.KEY, "label", F.round(F.array_max("probs"), 4).alias("percent"))


@query("WITH " + b.AXES + """, x AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, round(max(dX), 6) AS a, round(max(dY), 6) AS b, round(max(dZ), 6) AS c FROM w GROUP BY ALL HAVING count(*) = 160)
SELECT night_id, epoch_idx, CASE WHEN a >= b AND a >= c THEN 0 WHEN b >= c THEN 1 ELSE 2 END AS label FROM x""")
def m2_predict_mobility(spark, sf_dir):
    whole = epochs.to_epochs(b.axes(spark, sf_dir)).withColumn("top", F.array(F.round(F.array_max("samples"), 6)))
    return signals.predict(epochs.mobility_vector(whole, "top"), linear_model).select("night_id", "epoch_idx", "label")


@query("WITH " + b.VECTORS + f" SELECT night_id, 'EEG' AS channel, epoch_idx, CASE WHEN vec_id % 3 = 0 THEN {ARGMAX.replace('samples', 'r')} ELSE {ARGMAX} END AS label FROM (SELECT *, list_reverse(samples) AS r FROM v)")
def m3_rescore(spark, sf_dir):
    rows = b.vectors(spark, sf_dir)
    labelled = signals.predict(rows, linear_model, "samples").select(*epochs.KEY, "label")
    changed = rows.where("vec_id % 3 = 0").withColumn("samples", F.reverse("samples"))
    return signals.rescore(labelled, changed, linear_model, "samples")


@query("WITH " + b.VECTORS + f""", p AS (SELECT night_id, epoch_idx, list_transform(samples[1:5], lambda x: exp(x)) AS z FROM v)
SELECT night_id, 'EEG' AS channel, epoch_idx, CAST(unnest(range(5)) AS INTEGER) AS class, unnest(list_transform(z, lambda x: round(x / list_sum(z) * 100, 4))) AS percent FROM p""")
def s9_probability_rows(spark, sf_dir):
    return sinks.probability_rows(signals.predict(b.vectors(spark, sf_dir), linear_model, "samples")).withColumn("percent", F.round("percent", 4))


@query()
def f1_filter_spiky(spark, sf_dir):
    """Epochs of the acceleration norm, every third of them called spiky, filtered at 5 Hz."""
    return signals.filter_spiky(acceleration(spark, sf_dir).withColumn("label", F.when(F.col("epoch_idx") % 3 == 0, 3).otherwise(0)), cutoff=5.0)


def low_pass_in_sql(cutoff: float, rate: int) -> str:
    """Both passes of the fourth-order low-pass as recursions over the samples; coefficients are those of two second-order sections."""
    k, b_, a_ = float(np.tan(np.pi * cutoff / rate)), np.ones(1), np.ones(1)
    for i in range(2):
        q = 1 / (2 * np.cos(np.pi * (2 * i + 1) / 8))
        scale = 1 + k / q + k * k
        b_ = np.convolve(b_, np.array([1, 2, 1]) * k * k / scale)
        a_ = np.convolve(a_, np.array([scale, 2 * (k * k - 1), 1 - k / q + k * k]) / scale)
    z = np.zeros(5)  # the delays under a constant input of 1, whose output is 1
    for i in range(3, -1, -1):
        z[i] = b_[i + 1] - a_[i + 1] + z[i + 1]
    n = lambda v: f"CAST({float(v)!r} AS DOUBLE)"
    y = f"{n(b_[0])} * x[t + 1] + z1"
    states = ", ".join(f"{n(b_[i])} * x[t + 1] + {f'z{i + 1}' if i < 4 else '0'} - {n(a_[i])} * ({y})" for i in range(1, 5))
    begin = ", ".join(f"{n(z[i])} * x[1] AS z{i + 1}" for i in range(4))
    turn = lambda name, source: f"{name} AS (SELECT night_id, epoch_idx, 0 AS t, x, CAST([] AS DOUBLE[]) AS y, {begin} FROM {source} UNION ALL SELECT night_id, epoch_idx, t + 1, x, list_append(y, {y}), {states} FROM {name} WHERE t < len(x))"
    first = "WITH RECURSIVE " + b.AXES + """, ep AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, list(sqrt(dX * dX + dY * dY + dZ * dZ) ORDER BY sample_idx) AS s FROM w GROUP BY ALL HAVING count(*) = 160),
sp AS (SELECT night_id, epoch_idx, list_concat([2 * s[1] - v FOR v IN list_reverse(s[2:16])], s, [2 * s[160] - v FOR v IN list_reverse(s[145:159])]) AS x FROM ep WHERE epoch_idx % 3 = 0)"""
    return f"""{first}, {turn('fo', 'sp')}, mi AS (SELECT night_id, epoch_idx, list_reverse(y) AS x FROM fo WHERE t = len(x)), {turn('ba', 'mi')},
o AS (SELECT night_id, epoch_idx, list_reverse(y)[16:175] AS y FROM ba WHERE t = len(x))
SELECT night_id, 'ACCagg' AS channel, epoch_idx, CAST(unnest(range(160)) AS INTEGER) AS pos, unnest([round(v, 6) FOR v IN y]) AS value FROM o"""


@query(low_pass_in_sql(5.0, 16))
def f1_filtered_samples(spark, sf_dir):
    """The samples of the epochs that are filtered."""
    changed = f1_filter_spiky(spark, sf_dir).where("label = 3")
    return each(changed.select(*epochs.KEY, "samples"), "samples").withColumn("value", F.round("value", 6))


@query("WITH " + b.AXES + """, x AS (SELECT night_id, CAST(sample_idx // 160 AS INTEGER) AS epoch_idx, list(round(sqrt(dX * dX + dY * dY + dZ * dZ), 6) ORDER BY sample_idx) AS samples FROM w GROUP BY ALL HAVING count(*) = 160)
SELECT night_id, 'ACCagg' AS channel, epoch_idx, CAST(unnest(range(160)) AS INTEGER) AS pos, unnest(samples) AS value FROM x WHERE epoch_idx % 3 <> 0""")
def f1_untouched(spark, sf_dir):
    """Epochs that the filter leaves as they are."""
    kept = f1_filter_spiky(spark, sf_dir).where("label <> 3")
    return each(kept.select(*epochs.KEY, "samples"), "samples").withColumn("value", F.round("value", 6))


@query("WITH " + b.VECTORS + """, z AS (SELECT night_id, epoch_idx, j, samples[j + 1] * (0.5 - 0.5 * cos(2 * pi() * j / 64)) AS d FROM v, (SELECT CAST(unnest(range(64)) AS INTEGER) AS j)),
h AS (SELECT sum(power(0.5 - 0.5 * cos(2 * pi() * j / 64), 2)) AS w FROM (SELECT unnest(range(64)) AS j)),
y AS (SELECT night_id, epoch_idx, k, (power(sum(d * cos(2 * pi() * k * j / 64)), 2) + power(sum(d * sin(2 * pi() * k * j / 64)), 2)) / (64 * any_value(w)) AS x
  FROM z, h, (SELECT unnest(range(3, 33)) AS k) GROUP BY 1, 2, 3),
r AS (SELECT night_id, 'EEG' AS channel, epoch_idx, k - 3 AS bin, round(10 * log10(greatest((x - min(x) OVER n) / (max(x) OVER n - min(x) OVER n) * 10, 1e-10)), 3) AS db FROM y WINDOW n AS (PARTITION BY night_id))
SELECT night_id, channel, epoch_idx, bin, CASE WHEN db = 0 THEN 0 ELSE db END AS db FROM r""")
def d1_display_spectra(spark, sf_dir):
    found = signals.display_spectra(b.vectors(spark, sf_dir))
    return found.select(*epochs.KEY, F.posexplode("db").alias("bin", "db")).select(*epochs.KEY, F.col("bin").cast("long").alias("bin"), (F.round("db", 3) + 0.0).alias("db"))


@query(S + """ SELECT night_id, epoch_idx, stage, CAST(epoch_idx * 30 // 60 AS VARCHAR) || ':' || lpad(CAST(epoch_idx * 30 % 60 AS VARCHAR), 2, '0') AS elapsed FROM s""")
def d2_hypnogram(spark, sf_dir):
    return signals.hypnogram(b.stages(spark, sf_dir))


@query(NORM + " SELECT night_id, sample_idx, (sample_idx + 1) / 16 AS time_sec FROM nm")
def d3_trace(spark, sf_dir):
    return signals.trace(epochs.norm_of_columns(b.wide_axes(spark, sf_dir))).select("night_id", "sample_idx", "time_sec")


@query(U + " SELECT night_id, epoch_idx, max(label) FILTER (channel = 'C0') AS C0, max(label) FILTER (channel = 'C1') AS C1, epoch_idx * 10 + 1.0::DOUBLE / 256 AS start_time_sec, CAST((epoch_idx + 1) * 10 AS DOUBLE) AS end_time_sec FROM u GROUP BY night_id, epoch_idx")
def s6_wide_usability(spark, sf_dir):
    return sinks.wide_usability(b.usability(spark, sf_dir), ["C0", "C1"])


@query(U + " SELECT night_id, epoch_idx, channel, label FROM u")
def s5_scores_from_files(spark, sf_dir):
    """The wide scores written by night as CSV with a comment, and read back."""
    folder = shared(spark, "usability")
    wide = s6_wide_usability(spark, sf_dir)
    lines = wide.select(F.col("night_id").alias("n"), F.col("epoch_idx").alias("at"), F.concat_ws(",", "night_id", "epoch_idx", "C0", "C1", "start_time_sec", "end_time_sec").alias("value"))
    head = {-2: "# usability scores", -1: "night_id,epoch_idx,C0,C1,Start_time_sec,End_time_sec"}
    write_lines(lines, head, folder)
    read = scores.read_wide_scores(spark, f"{folder}/n=*", ["night_id", "epoch_idx", "C0", "C1"])
    return scores.to_long(read.withColumn("epoch_idx", F.col("epoch_idx").cast("int")), ["C0", "C1"])


@query(U + " SELECT night_id, epoch_idx, channel, label FROM u WHERE channel = 'C0' OR CAST(night_id AS BIGINT) % 3 <> 2")
def s5_scores_of_differing_channels(spark, sf_dir):
    """Of three nights one has its columns in the other order, and one lacks the second channel: each file's own header counts."""
    folder = shared(spark, "differing")
    wide, kind = s6_wide_usability(spark, sf_dir), F.col("night_id").cast("long") % 3
    columns = [("C0", "C1"), ("C1", "C0"), ("C0",)]
    choose = lambda f: F.when(kind == 0, f(columns[0])).when(kind == 1, f(columns[1])).otherwise(f(columns[2]))
    line = choose(lambda c: F.concat_ws(",", *c, "start_time_sec", "end_time_sec"))
    head = choose(lambda c: F.lit(",".join([*c, "Start_time_sec", "End_time_sec"])))
    rows = wide.select(F.col("night_id").alias("n"), F.col("epoch_idx").alias("at"), line.alias("value"))
    heads = wide.select(F.col("night_id").alias("n"), F.lit(-1).alias("at"), head.alias("value")).distinct()
    write_texts(rows.unionByName(heads), folder)
    read = scores.read_scores(spark, f"{folder}/n=*")
    return read.select(F.regexp_extract("path", r"/n=(\d+)", 1).alias("night_id"), "epoch_idx", "channel", "label")


def write_lines(lines: DataFrame, head: dict[int, str], folder: str) -> None:
    """A text file of each n, its lines in the order of ``at``, those of head first."""
    first = lines.select("n").distinct().select("n", F.explode(F.create_map(*(F.lit(x) for kv in head.items() for x in kv))).alias("at", "value"))
    write_texts(lines.unionByName(first), folder)


def write_texts(lines: DataFrame, folder: str) -> None:
    """A text file of each n, written from one row, so that no plan can put its lines into two files or another order: parts of a
    union are coalesced apart, and a shuffle by n after it is left out. A night has about a thousand lines. Tasks write the files
    themselves: Spark's writer takes many calls for a folder of one file."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n", "")
    texts = lines.groupBy("n").agg(text.alias("value"))

    def put(batches):
        for batch in batches:
            for n, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out = sinks.NightFile(f"{folder}/n={sinks.escaped(n)}/lines.txt", n, f"{value}\n".encode())
                yield out.close().select(["night_id"])

    sinks.dealt(texts, "n").mapInArrow(put, "night_id string").write.format("noop").mode("overwrite").save()


@query(S + " SELECT night_id, epoch_idx, stage FROM s")
def s4_stages_from_files(spark, sf_dir):
    """The stages written as one text file for each night, with five lines before them, and read back."""
    folder = shared(spark, "stages")
    lines = b.stages(spark, sf_dir).select(F.col("night_id").alias("n"), F.col("epoch_idx").alias("at"), F.concat(F.col("stage").cast("string"), F.lit("\tx")).alias("value"))
    write_lines(lines, dict.fromkeys(range(-5, 0), "head"), folder)
    read = scores.read_stages(spark, f"{folder}/n=*")
    return read.select(F.regexp_extract("path", r"/n=(\d+)", 1).alias("night_id"), "epoch_idx", "stage")


@query(OVERLAY + " SELECT night_id, epoch_idx, stage, epoch_idx * 30 + 1.0::DOUBLE / 256 AS start_time_sec, CAST((epoch_idx + 1) * 30 AS DOUBLE) AS end_time_sec FROM o")
def s7_w4_rejected_scores(spark, sf_dir):
    """Written by night in the order of epochs, and read back."""
    folder = shared(spark, "rejected")
    sinks.write_nights(sinks.rejected_scores(a3_overlay(spark, sf_dir)), folder)
    return spark.read.parquet(folder).withColumn("night_id", F.col("night_id").cast("string"))


@query(EPOCHS + ", n AS (SELECT night_id, max(epoch_idx) + 1 AS n FROM ep GROUP BY 1) SELECT night_id, n FROM n WHERE n < 6")
def s8_features_to_compute(spark, sf_dir):
    """Saved features hold six epochs of each night, so longer nights fit only their first six; others are computed."""
    signal = epochs.to_epochs(b.samples(spark, sf_dir)).drop("samples")
    size = signal.groupBy("night_id").agg((F.max("epoch_idx") + 1).alias("n"))
    return sinks.to_compute(signal, signal.join(size.where("n >= 6"), "night_id").drop("n")).join(size, "night_id").select("night_id", "n").distinct()


@query(M + LIGHTS + " SELECT night_id, lo * 10 AS lights_out_second, li * 10 AS lights_on_second FROM l")
def s10_lights_table(spark, sf_dir):
    folder = shared(spark, "lights")
    w1_lights(spark, sf_dir).select("night_id", "lights_out_second", "lights_on_second").write.parquet(folder)
    return spark.read.parquet(folder)


@query("WITH " + b.NUMBERED + " SELECT DISTINCT night_id FROM e WHERE CAST(night_id AS BIGINT) % 3 <> 0")
def s13_nights_to_do(spark, sf_dir):
    found = b.numbered(spark, sf_dir).select("night_id").distinct()
    done = found.where(F.col("night_id").cast("long") % 3 == 0).withColumns({"step": F.lit("usability"), "config_hash": F.lit(sinks.config_hash(Config()))})
    return nights.to_do(found, done, "usability", sinks.config_hash(Config()))


@query("WITH " + b.NUMBERED + """, p AS (SELECT DISTINCT night_id, '/raw/' || night_id AS src FROM e)
SELECT night_id, CASE WHEN CAST(night_id AS BIGINT) % 2 = 0 THEN src ELSE replace(src, '/raw', '/out') END AS path FROM p""")
def s13_locate_outputs(spark, sf_dir):
    found = b.numbered(spark, sf_dir).select("night_id", F.concat(F.lit("/raw/"), "night_id").alias("src_path")).distinct()
    placed = nights.with_destination(found, "/raw", "/out")
    return nights.locate(placed.where("night_id % 2 = 0").select("night_id", F.col("src_path").alias("path")), placed.select("night_id", F.col("dest_path").alias("path")))


@query("SELECT DISTINCT regexp_replace(url, '/[^/]*$', '') AS src_path, replace(regexp_replace(url, '/[^/]*$', ''), 'http', 'out') AS dest_path FROM pages")
def s1_s15_nights(spark, sf_dir):
    """Folders of the addresses of pages, as if each were a recording."""
    files = b.table(spark, sf_dir, "pages").select(F.concat("url", F.lit(".EDF")).alias("path"))
    return nights.with_destination(nights.nights(files), "http", "out")


WRITTEN: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """A folder of files that are written at the first call in an application; later calls read them."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in WRITTEN:
        folder = shared(spark, name)
        write(folder)
        WRITTEN[key] = folder
    return WRITTEN[key]


def vector_samples(spark, sf_dir) -> DataFrame:
    """night_id, epoch_idx, X, Y: 60 whole numbers of each vector, and their negatives."""
    x = F.transform(F.slice("samples", 1, 60), lambda v: F.round(v * 100))
    return b.vectors(spark, sf_dir).select("night_id", "epoch_idx", x.alias("X"), F.transform(x, lambda v: -v).alias("Y"))


WHOLE = ({"X": -32768.0, "Y": -32768.0}, {"X": 32767.0, "Y": 32767.0})


def combined_folder(spark, sf_dir) -> str:
    """A folder with an EDF file of two channels at 6 samples a second for each night of vectors."""
    return once(spark, sf_dir, "combined", lambda f: sinks.write_edf(vector_samples(spark, sf_dir), f, ["X", "Y"], 6, *WHOLE).count())


def combined_files(spark, sf_dir) -> DataFrame:
    """path, length of the files of combined_folder()."""
    return recordings.listing(spark, combined_folder(spark, sf_dir))


def night_of(path: str):
    return F.regexp_extract(path, r"([^/]+)$", 1).alias("night_id")


@query("WITH " + b.VECTORS + """ SELECT night_id, channel, CAST(epoch_idx // 1 AS INTEGER) AS epoch_idx, round(total, 3) AS total FROM (
SELECT night_id, 'X' AS channel, epoch_idx, list_sum(list_transform(samples[1:60], lambda v: round(v * 100))) AS total FROM v
UNION ALL SELECT night_id, 'Y', epoch_idx, list_sum(list_transform(samples[1:60], lambda v: -round(v * 100))) FROM v)""")
def s2_s3_combined_edf(spark, sf_dir):
    """Vectors of a label as two channels of an EDF file, ten seconds of 6 Hz a vector, read in ranges of a few kilobytes."""
    chosen, _ = recordings.combined(recordings.catalog(combined_files(spark, sf_dir)), ["X", "Y"])
    return totals(recordings.blocks(chosen, ["X", "Y"], range_bytes=4096))


@query("WITH " + b.VECTORS + """ SELECT night_id, channel, CAST(epoch_idx // 1 AS INTEGER) AS epoch_idx, round(total, 3) AS total FROM (
SELECT night_id, 'X' AS channel, epoch_idx, list_sum(list_transform(samples[1:60], lambda v: round(v * 100))) AS total FROM v
UNION ALL SELECT night_id, 'Y', epoch_idx, list_sum(list_transform(samples[1:60], lambda v: -round(v * 100))) FROM v)""")
def s3_edf_format(spark, sf_dir):
    """The same files through spark.read.format("edf")."""
    recordings.register(spark)
    return totals(spark.read.format("edf").option("rangeBytes", 4096).load(combined_folder(spark, sf_dir)))


def totals(blocks: DataFrame) -> DataFrame:
    return blocks.select(night_of("src_path"), "channel", "epoch_idx", F.round(F.aggregate("samples", F.lit(0.0), lambda t, v: t + v), 3).alias("total"))


def damage(files: DataFrame, size: int = 600) -> None:
    """Copies the first bytes of each file: path, target."""

    def run(batches):
        for batch in batches:
            for path, target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with recordings.open_file(path) as file:
                    out = sinks.NightFile(target, "", file.read(size))
                yield out.close().select(["night_id"])

    files.select("path", "target").mapInArrow(run, "night_id string").count()


def channel_files(spark, sf_dir) -> DataFrame:
    """A file for each of two channels of a night. Of four nights the second has a damaged file of Y, the third besides
    that a good one of another ending, the fourth none."""

    def write(folder: str) -> None:
        rows = vector_samples(spark, sf_dir)
        kind = F.split_part("night_id", F.lit("-"), F.lit(2)).cast("int") % 4
        sinks.write_edf(rows.select("night_id", "epoch_idx", "X"), folder, ["X"], 6, *WHOLE, file="X.edf").count()
        for wanted, name, root in ((kind == 0, "Y.edf", folder), (kind == 2, "Y.EDF", folder), (kind.isin(1, 2), "Y.edf", folder + "-whole")):
            sinks.write_edf(rows.where(wanted).select("night_id", "epoch_idx", "Y"), root, ["Y"], 6, *WHOLE, file=name).count()
        damage(recordings.listing(spark, folder + "-whole").withColumn("target", F.replace("path", F.lit("-whole/"), F.lit("/"))))

    return recordings.listing(spark, once(spark, sf_dir, "channels", write))


KIND = "CAST(split_part(night_id, '-', 2) AS INTEGER) % 4"


@query("WITH " + b.VECTORS + f""" SELECT night_id, channel, epoch_idx, round(total, 3) AS total FROM (
SELECT night_id, 'X' AS channel, epoch_idx, list_sum(list_transform(samples[1:60], lambda v: round(v * 100))) AS total FROM v
UNION ALL SELECT night_id, 'Y', epoch_idx, list_sum(list_transform(samples[1:60], lambda v: -round(v * 100))) FROM v) WHERE {KIND} IN (0, 2)""")
def s2_per_channel_edf(spark, sf_dir):
    """Nights of which each channel has a file that can be read."""
    chosen, _ = recordings.per_channel(recordings.catalog(channel_files(spark, sf_dir)), ["X", "Y"])
    return totals(recordings.blocks(chosen, None))


@query("WITH " + b.VECTORS + f", n AS (SELECT DISTINCT night_id FROM v) SELECT night_id, 1 AS code, 'Y' AS channels FROM n WHERE {KIND} IN (1, 3) UNION ALL SELECT night_id, 13, 'Y' FROM n WHERE {KIND} = 3")
def s2_per_channel_faults(spark, sf_dir):
    _, found = recordings.per_channel(recordings.catalog(channel_files(spark, sf_dir)), ["X", "Y"])
    return found.select(night_of("src_path"), "code", F.array_join("channels", ",").alias("channels"))


@query("WITH " + b.VECTORS + f", n AS (SELECT DISTINCT night_id FROM v) SELECT night_id, CASE {KIND} WHEN 0 THEN 13 ELSE 3 END AS code FROM n WHERE {KIND} <> 3 UNION ALL SELECT night_id, 13 FROM n WHERE {KIND} = 3")
def s3_combined_faults(spark, sf_dir):
    """The same files, where the whole night should be in one: there are several, or the one lacks a channel."""
    files = channel_files(spark, sf_dir)
    first = F.regexp_extract("path", r"-(\d+)/[^/]*$", 1).cast("int") % 4 == 0
    _, found = recordings.combined(recordings.catalog(files.where(~first | F.col("path").endswith("X.edf"))), ["X", "Y"])
    return found.select(night_of("src_path"), "code")


#: Lines of an epoch of the jobs' recordings; each line stands for so many samples.
LINES, EACH = 160, 16


def job_lines(spark, sf_dir) -> DataFrame:
    """night_id, the numbers of each line of whole epochs, and how many epochs a night has: EEG stands for prices, axes for the other
    numbers. A night's lines come together and in order.

    The lines of 8192 order keys are a night, so nights do not grow with the data. Amplitudes change from epoch to epoch
    (EEG) and every twenty epochs (axes), so that all labels come. One shuffle, of the lines.
    """
    columns = ["l_orderkey", "l_linenumber", "l_partkey", "l_shipdate", "l_extendedprice"]
    night = Window.partitionBy("night")
    lines = b.table(spark, sf_dir, "lineitem").select(*columns, "l_quantity", "l_discount", "l_tax", F.floor(F.col("l_orderkey") / 8192).alias("night")).where("night IS NOT NULL")
    numbered = lines.withColumns({"rn": F.row_number().over(night.orderBy(*columns)) - 1, "n": F.count("*").over(night)})
    e = F.floor(F.col("rn") / LINES).cast("int")
    loud = F.when(F.floor(e / 20) % 2 == 0, 0.02).otherwise(1.0)
    axes = {"dX": F.col("l_quantity") / 25 - 1, "dY": F.col("l_discount") * 10, "dZ": F.col("l_tax") * 20 - 1}
    price = F.round((F.col("l_extendedprice") % 2000 - 1000) / (1 + e % 4))
    epochs_ = F.floor(F.col("n") / LINES).cast("int")
    return numbered.where(e < epochs_).select(F.col("night").cast("string").alias("night_id"), price.alias("EEG"), *((v * loud).alias(k) for k, v in axes.items()), epochs_.alias("epochs"))


def line_samples(channel: str, lines: np.ndarray) -> np.ndarray:
    """The samples of lines at 256 Hz: a number stands for EACH samples; those of the EEG go up and down about it."""
    wave = np.arange(EACH) * 7 % 16 - 8 if channel == "EEG" else np.zeros(EACH)
    return (lines[:, :, None] + wave).reshape(len(lines), -1)


def job_files(spark, sf_dir) -> DataFrame:
    """path, length of an EDF file of four channels for each night of job_lines()."""
    axes = epochs.AXES
    low, high = {"EEG": -32768.0} | dict.fromkeys(axes, -2.0), {"EEG": 32767.0} | dict.fromkeys(axes, 2.0)

    def write(folder: str) -> None:
        with sinks.shuffles_removed(spark):
            sinks.write_edf_of_lines(job_lines(spark, sf_dir), LINES, folder, ["EEG", *axes], 256, low, high, make=line_samples).count()

    return recordings.listing(spark, once(spark, sf_dir, "nights", write))


def parity(first: int, second: int, least: float):
    """A stand-in for a model: one of two labels by whether the mean of the vector is over a limit, with probability 0.9."""

    def model(x: np.ndarray) -> np.ndarray:
        out = np.full((len(x), 4), 0.1 / 3)
        out[np.arange(len(x)), np.where(x.mean(axis=1) > least, first, second)] = 0.9
        return out

    return model


def job_setup() -> jobs.Setup:
    return jobs.Setup(["EEG"], parity(0, 3, 215.0), parity(3, 1, 1e-4), least_run=2, lite=True)


def job_stages(spark, sf_dir) -> DataFrame:
    """A stage for each whole sleep epoch of the jobs' recordings: its number modulo 5. By path of the night."""
    found = recordings.catalog(job_files(spark, sf_dir)).select(F.col("src_path").alias("night_id"), F.expr("CAST(records div 30 AS INT)").alias("n")).where("n > 0")
    return found.select("night_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("epoch_idx")).withColumn("stage", F.col("epoch_idx") % 5)


#: The mean of a spectrogram is that of the squared windowed samples (Parseval), so labels need no Fourier transform.
JOB = """WITH li AS (SELECT CAST(l_orderkey // 8192 AS VARCHAR) AS night_id, row_number() OVER (PARTITION BY l_orderkey // 8192 ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice) - 1 AS rn, * FROM lineitem),
le AS (SELECT *, CAST(rn // 160 AS INTEGER) AS epoch_idx, CASE WHEN rn // 160 // 20 % 2 = 0 THEN 0.02::DOUBLE ELSE 1 END AS loud FROM li QUALIFY count(*) OVER (PARTITION BY night_id, rn // 160) = 160),
lo AS (SELECT * FROM le QUALIFY max(epoch_idx) OVER (PARTITION BY night_id) >= 5),
sa AS (SELECT night_id, epoch_idx, (rn % 160) * 16 + j AS i, round((l_extendedprice % 2000 - 1000) / (1 + epoch_idx % 4)) + (j * 7) % 16 - 8 AS eeg,
  (l_quantity / 25 - 1) * loud AS x, l_discount * 10 * loud AS y, (l_tax * 20 - 1) * loud AS z FROM lo, (SELECT CAST(unnest(range(16)) AS INTEGER) AS j)),
ch AS (SELECT night_id, epoch_idx, i, unnest(['eeg', 'norm', 'x', 'y', 'z']) AS c, unnest([eeg, sqrt(x * x + y * y + z * z), x, y, z]) AS v FROM sa),
tw AS (SELECT k, CASE WHEN k < 32 THEN 0.5 * (1 - cos(pi() * k / 32)) WHEN k > 224 THEN 0.5 * (1 - cos(pi() * (256 - k) / 32)) ELSE 1 END AS w, 0.5 - 0.5 * cos(2 * pi() * k / 256) AS h FROM (SELECT CAST(unnest(range(256)) AS INTEGER) AS k)),
sg AS (SELECT night_id, epoch_idx, c, t, i - t * 224 AS k, v FROM ch, (SELECT CAST(unnest(range(11)) AS INTEGER) AS t) WHERE c IN ('eeg', 'norm') AND i >= t * 224 AND i < t * 224 + 256
  UNION ALL SELECT night_id, epoch_idx, c, t, i - t * 128, v FROM ch, (SELECT CAST(unnest(range(19)) AS INTEGER) AS t) WHERE c IN ('x', 'y', 'z') AND i >= t * 128 AND i < t * 128 + 256),
sd AS (SELECT night_id, epoch_idx, c, k, v - avg(v) OVER (PARTITION BY night_id, epoch_idx, c, t) AS d FROM sg),
en AS (SELECT night_id, epoch_idx, sum(CASE WHEN c IN ('eeg', 'norm') THEN power(d * w, 2) END) / (SELECT sum(w * w) FROM tw) / 2838 AS usable, sum(CASE WHEN c IN ('x', 'y', 'z') THEN power(d * h, 2) END) / (SELECT sum(h * h) FROM tw) / 19 / 387 AS moving
  FROM sd JOIN tw USING (k) GROUP BY 1, 2),
u AS (SELECT night_id, epoch_idx, 'EEG' AS channel, CASE WHEN usable > 215 THEN 0 ELSE 3 END AS label FROM en),
m AS (SELECT night_id, epoch_idx, CASE WHEN moving > 1e-4 THEN 3 ELSE 1 END AS label FROM en),
s AS (SELECT night_id, CAST(unnest(range(n)) AS INTEGER) AS epoch_idx, unnest(range(n)) % 5 AS stage FROM (SELECT night_id, (max(epoch_idx) + 1) // 3 AS n FROM u GROUP BY 1))"""
JOB_STATISTICS = JOB + STATISTICS.removeprefix(S).replace("," + b.MOBILITY, "", 1)


def job_results(spark, sf_dir) -> jobs.Results:
    found = jobs.night_statistics(job_files(spark, sf_dir), job_stages(spark, sf_dir), job_setup(), shared(spark, "job"))
    return found


@query(JOB_STATISTICS + " SELECT * FROM st")
def job_night_statistics(spark, sf_dir):
    """From files to statistics: decode once, epochs, features, labels, both majorities, lights, statistics."""
    found = job_results(spark, sf_dir).statistics
    return found.withColumn("night_id", night_of("night_id"))


@query(JOB + """, r AS (SELECT * FROM u WHERE label = 3 AND epoch_idx % 4 <> 0)
SELECT night_id, epoch_idx, 'EEG' AS channel, u.label AS usability, m.label AS mobility FROM u JOIN m USING (night_id, epoch_idx)""")
def job_labels(spark, sf_dir):
    """Usability and mobility of each epoch, as the job labels them."""
    found = job_results(spark, sf_dir)
    both = found.usability.select(*epochs.KEY, F.col("label").alias("usability")).join(found.mobility.select("night_id", "epoch_idx", F.col("label").alias("mobility")), ["night_id", "epoch_idx"])
    return both.withColumn("night_id", night_of("night_id"))


@query(JOB_STATISTICS + """, pa AS (UNPIVOT (SELECT * FROM st) ON COLUMNS(* EXCLUDE (night_id)) INTO NAME key VALUE value)
SELECT night_id, count(*) AS measures, round(sum(value), 4) AS total FROM pa GROUP BY 1""")
def job_written_outputs(spark, sf_dir):
    """The whole job with its outputs, ledger and a second run that finds nothing to do; statistics read back from their files."""
    setup, files, out = job_setup(), job_files(spark, sf_dir), shared(spark, "outputs")
    for k in range(2):
        jobs.run(files, job_stages(spark, sf_dir), setup, shared(spark, "job"), out)
    read = spark.read.parquet(f"{out}/statistics").where("value IS NOT NULL")
    return read.groupBy(night_of("night_id")).agg(F.count("*").alias("measures"), F.round(F.sum(F.col("value").cast("double")), 4).alias("total"))


@query()
def job_filter_spiky(spark, sf_dir):
    """The recovery of each night: spiky epochs filtered, their features and labels made anew."""
    setup, work = job_setup(), shared(spark, "job")
    found = jobs.recovered(jobs.signal_epochs(job_files(spark, sf_dir), setup, work), setup, work, cutoff=2.0)[2]
    return found.withColumn("night_id", night_of("night_id"))


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)
