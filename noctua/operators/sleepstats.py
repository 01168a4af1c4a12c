"""Sleep statistics of each night, in one aggregate over its scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noctua.functions.config import N1, N2, N3, REM, WAKE, Config
from noctua.operators.bedtime import crop_bounds

STAGES = {"N1": N1, "N2": N2, "N3": N3, "REM": REM}


def percent(n: Column, d: Column) -> Column:
    """Percent with two digits; null unless the whole is positive."""
    return F.round(n / F.when(d > 0, d) * 100, 2)


def sleep_statistics(scores: DataFrame, lights: DataFrame | None = None, config: Config = Config()) -> DataFrame:
    """One row per night; minutes, except the two moments in seconds.

    Where lights are known the scores are first cropped to the time in bed, and positions count from its start. The
    unusable label is neither sleep nor wake. Nights with a minute in bed or less are left out (error 11).
    Without sleep, sleep times are 0 and what depends on its position is null. One shuffle, by night, for the scores.
    """
    e = config.sleep_len / 60
    if lights is not None:
        bounds = crop_bounds(lights, config.sleep_len, config)
        moments = bounds.join(lights.select("night_id", "lights_out_second", "lights_on_second"), "night_id")
        scores = scores.join(moments, "night_id", "left")
    else:
        null = F.lit(None).cast("int")
        scores = scores.withColumns({"start": null, "stop": null, "lights_out_second": null, "lights_on_second": null})
    inside = F.col("start").isNull() | ((F.col("epoch_idx") >= F.col("start")) & (F.col("epoch_idx") < F.col("stop")))
    s = F.col("stage")
    sleep = inside & (s > WAKE) & (s != config.unusable)
    at = F.col("epoch_idx") - F.coalesce("start", F.lit(0))
    some = scores.groupBy("night_id").agg(
        F.count("*").alias("all"),
        F.first("lights_out_second").alias("out"),
        F.first("lights_on_second").alias("on"),
        F.count_if(inside).alias("n"),
        F.count_if(inside & (s != config.unusable)).alias("scorable"),
        F.count_if(sleep).alias("sleep"),
        F.min(F.when(sleep, at)).alias("first"),
        F.max(F.when(sleep, at)).alias("last"),
        F.max(F.when(inside, at)).alias("end"),
        F.sort_array(F.collect_list(F.when(inside & (s == WAKE), at))).alias("wake"),
        *(F.count_if(inside & (s == label)).alias(f"n_{name}") for name, label in STAGES.items()),
        *(F.min(F.when(inside & (s == label), at)).alias(f"first_{name}") for name, label in STAGES.items()),
    )
    waking = F.size(F.filter("wake", lambda w: (w > F.col("first")) & (w < F.col("last"))))
    none = F.col("sleep") == 0
    spt = F.when(none, 0.0).otherwise((F.col("last") - F.col("first") + 1) * e)
    nrem = reduce(lambda a, b: a + b, (F.col(f"n_{name}") for name in ("N1", "N2", "N3")))
    columns = {
        "Scores_duration_min": F.col("all") * e,
        "Lights_out_sec": F.col("out").cast("double"),
        "Lights_on_sec": F.col("on").cast("double"),
        "TIB_min": F.col("n") * e,
        "Scorable_pct": percent(F.col("scorable"), F.col("n")),
        "SPT_min": spt,
        "TST_min": F.col("sleep") * e,
    }
    for name in STAGES:
        columns[f"{name}_min"] = F.col(f"n_{name}") * e
        columns[f"{name}_pct"] = percent(F.col(f"n_{name}"), F.col("sleep"))
    columns |= {"NREM_min": nrem * e, "NREM_pct": percent(nrem, F.col("sleep")), "WASO_min": F.when(~none, waking * e), "SOL_min": F.col("first") * e}
    columns |= {f"{name}_latency_min": F.col(f"first_{name}") * e for name in STAGES}
    columns |= {
        "PSW_min": (F.col("end") - F.col("last")) * e,
        "SE_pct": F.when(none, 0.0).otherwise(percent(F.col("sleep"), F.col("n"))),
        "SME_pct": percent(F.col("sleep") * e, spt),
    }
    return some.where(F.col("n") * e > 1).select("night_id", *(c.alias(k) for k, c in columns.items()))


def best_scores(candidates: list[DataFrame], nights: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For each night the scores of the first candidate that has any, and the nights without (error 10)."""
    ranked = reduce(DataFrame.unionByName, (c.select("night_id", "epoch_idx", "stage", F.lit(i).alias("rank")) for i, c in enumerate(candidates)))
    best = ranked.groupBy("night_id").agg(F.min("rank").alias("best"))
    chosen = ranked.join(best, "night_id").where("rank = best").select("night_id", "epoch_idx", "stage", F.col("rank").alias("origin"))
    return chosen, nights.select("night_id").distinct().join(best, "night_id", "left_anti")


def with_sources(statistics: DataFrame, facts: DataFrame, names: tuple[str, ...], reference: str) -> DataFrame:
    """Puts Data_source and Sleep_score_source before the measures and Reference after them.

    facts: night_id, src_path, and origin, the place in ``names`` of the scores that were used (from best_scores()).
    """
    measures = [c for c in statistics.columns if c != "night_id"]
    source = F.array(*map(F.lit, names))[F.col("origin")]
    joined = statistics.join(facts.select("night_id", F.col("src_path").alias("Data_source"), source.alias("Sleep_score_source")), "night_id")
    return joined.select("night_id", "Data_source", "Sleep_score_source", *measures, F.lit(reference).alias("Reference"))


def to_pairs(statistics: DataFrame) -> DataFrame:
    """night_id, key, value: the measures as text, absent ones included."""
    keys = [c for c in statistics.columns if c != "night_id"]
    text = statistics.select("night_id", *(F.col(c).cast("string").alias(c) for c in keys))
    return text.unpivot("night_id", keys, "key", "value")


def from_pairs(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """One row per night again, with the keys as columns. The keys are given, so no job looks for them."""
    return pairs.groupBy("night_id").pivot("key", keys).agg(F.first("value"))
