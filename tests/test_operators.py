"""Edge cases of the recording operators on small tables written here."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from noctua.functions.config import Config
from noctua.operators import bedtime, checks, epochs, majority, signals, sinks, sleepstats
from noctua.sources import edf, nights, scores

USABILITY = "night_id string, epoch_idx int, channel string, label int"
SCORES = "night_id string, epoch_idx int, stage int"
MOBILITY = "night_id string, epoch_idx int, label int"


def usability(spark, labels: dict[str, list[list[int]]]):
    """night -> a list of labels for each channel."""
    data = [(n, i, f"C{c}", x) for n, channels in labels.items() for c, own in enumerate(channels) for i, x in enumerate(own)]
    return spark.createDataFrame(data, USABILITY)


def numbered(spark, values: dict[str, list[int]], schema: str):
    return spark.createDataFrame([(n, i, x) for n, own in values.items() for i, x in enumerate(own)], schema)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_majorities(spark):
    u = usability(spark, {"one": [[1, 1, 0, 0, 0, 1, 1]], "two": [[2, 2, 2, 0, 0, 0], [0, 3, 3, 0, 0, 0]]})
    assert rows(majority.channel_majority(u).where("night_id = 'two'").select("epoch_idx", "unusable")) == [(0, False), (1, True), (2, True), (3, False), (4, False), (5, False)]
    # the last epoch of night one is a partial group and dropped
    assert rows(majority.epoch_majority(u)) == [("one", 0, True), ("one", 1, False), ("two", 0, True), ("two", 1, False)]
    s = numbered(spark, {"one": [2, 3], "two": [4, 0]}, SCORES)
    assert rows(majority.overlay(u, s)) == [("one", 0, -1), ("one", 1, 3), ("two", 0, -1), ("two", 1, 0)]
    assert rows(majority.overlay(u, numbered(spark, {"one": [2, 3, 3], "two": [4, 0]}, SCORES)).select("night_id").distinct()) == [("two",)]


@pytest.mark.parametrize("parts", [1, 7, 64])
def test_results_do_not_depend_on_partitions(spark, parts):
    rng = np.random.default_rng(1)
    u = usability(spark, {str(n): rng.integers(0, 5, (2, 61)).tolist() for n in range(4)})
    s = numbered(spark, {str(n): rng.integers(0, 5, 20).tolist() for n in range(4)}, SCORES)
    expected = rows(majority.overlay(u.coalesce(1), s.coalesce(1)))
    assert rows(majority.overlay(u.repartition(parts), s.repartition(parts))) == expected and len(expected) == 80


def test_pseudo_scores_and_percent(spark):
    u = usability(spark, {"a": [[0] * 7], "b": [[4, 4]]})
    assert rows(majority.pseudo_scores(u)) == [("a", 0, 9), ("a", 1, 9)]
    assert rows(majority.usable_percent(u)) == [("a", 100.0, "good"), ("b", 0.0, "low")]
    assert rows(majority.usable_percent(majority.ignore_m_shaped(u)))[1] == ("b", 100.0, "good")


def test_recovery_without_spiky_epochs_is_null(spark):
    u = usability(spark, {"a": [[0, 1]], "b": [[3, 3, 3]]})
    after = u.withColumn("label", F.when(F.col("epoch_idx") == 0, 0).otherwise(F.col("label")))
    assert rows(majority.recovery(u, after)) == [("a", 0, 0, None), ("b", 3, 1, 33.33)]


def test_lights(spark):
    m = numbered(spark, {"none": [3, 1, 3, 0], "whole": [1] * 5, "ends": [1, 1, 1, 3, 3, 1, 1, 1], "below": [1, 1, 3, 1, 1], "all": [3] * 4}, MOBILITY)
    found = bedtime.lights(m, least_run=3)
    assert rows(found.select("night_id", "lights_out_epoch", "lights_on_epoch")) == [("ends", 0, 8), ("whole", 0, 5)]
    assert rows(bedtime.without_lights(m, found)) == [("all",), ("below",), ("none",)]
    # a run of one epoch is one moment, not two
    assert rows(bedtime.lights(m, least_run=1).select("night_id")) == [("below",), ("ends",), ("whole",)]


def test_crop_bounds_overlap_the_time_in_bed(spark):
    found = spark.createDataFrame([("a", 17, 2889)], "night_id string, lights_out_epoch int, lights_on_epoch int")
    assert rows(bedtime.crop_bounds(found, 30)) == [("a", 5, 963)]
    with pytest.raises(ValueError):
        bedtime.crop_bounds(found, 25)


def test_statistics_by_hand(spark):
    s = numbered(spark, {"a": [0, 0, 1, 2, -1, 0, 3, 4, 0, -1], "awake": [0] * 6, "unusable": [-1] * 4, "short": [2, 2]}, SCORES)
    found = {r.night_id: r.asDict() for r in sleepstats.sleep_statistics(s).collect()}
    assert set(found) == {"a", "awake", "unusable"}  # a minute or less is left out
    a = found["a"]
    assert (a["TIB_min"], a["SPT_min"], a["TST_min"], a["WASO_min"], a["SOL_min"], a["PSW_min"]) == (5, 3, 2, 0.5, 1, 1)
    assert (a["Scorable_pct"], a["SE_pct"], a["SME_pct"], a["NREM_min"], a["NREM_pct"], a["REM_latency_min"]) == (80, 40, 66.67, 1.5, 75, 3.5)
    w = found["awake"]
    assert (w["SPT_min"], w["TST_min"], w["SE_pct"], w["WASO_min"], w["SOL_min"], w["SME_pct"], w["N1_latency_min"]) == (0, 0, 0, None, None, None, None)
    assert found["unusable"]["TST_min"] == 0 and found["unusable"]["Scorable_pct"] == 0


def test_statistics_count_from_the_crop(spark):
    s = numbered(spark, {"a": [2, 0, 0, 2, 2, 0, 2]}, SCORES)
    moments = spark.createDataFrame([("a", 3, 18, 30, 180)], "night_id string, lights_out_epoch int, lights_on_epoch int, lights_out_second int, lights_on_second int")
    r = sleepstats.sleep_statistics(s, moments).first()
    assert (r.Scores_duration_min, r.TIB_min, r.SOL_min, r.SPT_min, r.PSW_min, r.Lights_on_sec) == (3.5, 2.5, 1.0, 1.0, 0.5, 180)


def test_unusable_label_above_the_stages_is_not_sleep(spark):
    s = numbered(spark, {"a": [0, 7, 2, 7, 0]}, SCORES)
    r = sleepstats.sleep_statistics(s, config=Config(unusable=7)).first()
    assert (r.TST_min, r.SPT_min, r.Scorable_pct) == (0.5, 0.5, 60)


def test_best_scores_and_pairs(spark):
    a, b = numbered(spark, {"x": [1]}, SCORES), numbered(spark, {"x": [2], "y": [3, 3]}, SCORES)
    all_nights = spark.createDataFrame([("x",), ("y",), ("z",)], "night_id string")
    chosen, none = sleepstats.best_scores([a, b], all_nights)
    assert rows(chosen) == [("x", 0, 1, 0), ("y", 0, 3, 1), ("y", 1, 3, 1)] and rows(none) == [("z",)]
    s = spark.createDataFrame([("x", 1.5, None)], "night_id string, p double, q double")
    assert rows(sleepstats.to_pairs(s)) == [("x", "p", "1.5"), ("x", "q", None)]
    assert rows(sleepstats.from_pairs(sleepstats.to_pairs(s), ["p", "q"])) == [("x", "1.5", None)]


def test_first_fault_of_stages(spark):
    s = numbered(spark, {"ok": [0] * 4, "read": [0, None, 9, 0], "long": [0] * 5, "use": [0] * 4, "range": [0, 6, 0, 0]}, SCORES)
    facts = spark.createDataFrame([(n, 120.0, 9 if n == "use" else 13) for n in ("ok", "read", "long", "use", "range")], "night_id string, seconds double, n_usability int")
    assert dict(rows(checks.stage_faults(s, facts))) == {"ok": None, "read": 4, "long": 5, "use": 7, "range": 6}


def test_rem_labels(spark):
    s = numbered(spark, {"both": [4, 5], "five": [5, 0]}, SCORES)
    assert rows(checks.unify_rem(s, only_if_both=True)) == [("both", 0, 4), ("both", 1, 4), ("five", 0, 5), ("five", 1, 0)]
    assert rows(checks.unify_rem(s))[2] == ("five", 0, 4)


def test_reports(spark):
    a = spark.createDataFrame([("x", 2), ("y", None)], "night_id string, code int")
    b = spark.createDataFrame([("x", 12), ("y", 9), ("x", 2)], "night_id string, code int")
    report = checks.error_report([a, b])
    assert [r[:2] + (r[3],) for r in rows(report)] == [("x", 2, True), ("x", 12, True), ("y", 9, False)]
    every = spark.createDataFrame([("x",), ("y",), ("z",)], "night_id string")
    assert rows(checks.success_count(every, report)) == [(3, 1, 2)]


def signal(spark, n=25, fs=2, night="a", channel="C"):
    return spark.createDataFrame([(night, channel, i, float(i), fs) for i in range(n)], "night_id string, channel string, sample_idx long, value double, fs int")


def test_epochs_drop_the_tail_and_keep_the_order(spark):
    x = signal(spark).repartition(5)
    assert [r.samples for r in epochs.to_epochs(x).collect()] == [[float(i) for i in range(20)]]
    assert epochs.tail(x).count() == 5 and epochs.crop_to_epochs(x).count() == 20
    other = signal(spark, n=39, channel="D")
    assert epochs.crop_to_epochs(x.union(other)).groupBy("channel").count().select("count").distinct().collect()[0][0] == 20


def test_spectra_of_pseudo_acceleration_are_zero(spark):
    e = epochs.pseudo_acceleration(epochs.to_epochs(signal(spark, n=2560, fs=256)))
    row = signals.spectrogram_features(e).first()
    assert row.channel == "ACCagg" and len(row.spec) == 1419 and max(map(abs, row.spec)) == 0


@pytest.mark.parametrize("block", [50, 64, 4096])
def test_resampling_in_blocks_is_that_of_the_whole(spark, block):
    x = np.sin(np.arange(300) / 7)
    data = [("a", "C", i, float(v), 100) for i, v in enumerate(x)] + [("a", "D", i, 1.0, 256) for i in range(9)]
    df = spark.createDataFrame(data, "night_id string, channel string, sample_idx long, value double, fs int")
    found = [r.value for r in signals.resample(df, block=block).where("channel = 'C'").orderBy("sample_idx").collect()]
    from noctua.functions.spectral import spline

    assert len(found) == 768
    assert found == pytest.approx(spline(x[None], np.arange(768) * 100 / 256)[0], abs=1e-6)
    assert signals.resample(df).where("channel = 'D'").count() == 9


def test_argmax_takes_the_first_of_equals(spark):
    rows_ = spark.createDataFrame([(1, [0.0, 1.0, 1.0]), (2, [5.0, 1.0, 1.0])], "i int, features array<double>")
    found = signals.predict(rows_, lambda x: x / x.sum(axis=1, keepdims=True))
    assert [r.label for r in found.orderBy("i").collect()] == [1, 0]


def test_filter_touches_only_spiky_epochs(spark):
    e = epochs.to_epochs(signal(spark, n=5120, fs=256)).withColumn("label", F.when(F.col("epoch_idx") == 1, 3).otherwise(0))
    before, after = ({r.epoch_idx: r.samples for r in d.collect()} for d in (e, signals.filter_spiky(e)))
    assert before[0] == after[0] and before[1] != after[1] and len(after[1]) == 2560
    none = e.withColumn("label", F.lit(0))
    assert rows(signals.filter_spiky(none)) == rows(none)


def test_feature_tables_are_reused_only_if_they_fit(spark):
    s = spark.createDataFrame([("a", "C", 0), ("a", "C", 1), ("b", "C", 0), ("b", "D", 0)], "night_id string, channel string, epoch_idx int")
    saved = s.where("NOT (night_id = 'b' AND channel = 'D')")
    assert rows(sinks.reusable(saved, s)) == [("a",)]
    assert rows(sinks.to_compute(s, saved).select("night_id").distinct()) == [("b",)]


def test_run_facts(spark):
    info = dict(map(tuple, sinks.run_info(spark, Config()).collect()))
    assert info["rate"] == "256" and info["config_hash"] != sinks.config_hash(Config(rate=128))


def test_nights_are_found(spark):
    files = spark.createDataFrame([("/r/a/C3.EDF",), ("/r/a/C4.edf",), ("/r/b/c3.bdf",), ("/r/c/C4.edf",), ("/r/d/x.txt",)], "path string")
    assert rows(nights.nights(files, "C3")) == [("/r/a",), ("/r/b",)]
    assert rows(nights.nights(files)) == [("/r/a",), ("/r/b",), ("/r/c",)]


def edf_bytes(signals_, seconds=1, records=2, wide=False):
    """A tiny file: label -> digital samples."""
    def field(values, width):
        return "".join(str(v).ljust(width) for v in values)

    n, labels = len(signals_), list(signals_)
    per = [len(signals_[x]) // records for x in labels]
    low, high = (-8388608, 8388607) if wide else (-32768, 32767)
    head = field([""], 8) + " " * 160 + " " * 16 + field([256 * (n + 1)], 8) + " " * 44 + field([records, seconds], 8) + field([n], 4)
    body = field(labels, 16) + field([""] * n, 80) + field(["uV"] * n, 8) + field([low if wide else low / 2] * n, 8) + field([high if wide else high / 2] * n, 8) + field([low] * n, 8) + field([high] * n, 8) + field([""] * n, 80) + field(per, 8) + field([""] * n, 32)
    width = 3 if wide else 2
    data = b"".join(int(v).to_bytes(width, "little", signed=True) for r in range(records) for x, p in zip(labels, per) for v in signals_[x][r * p : (r + 1) * p])
    return (b"\xffBIOSEMI" if wide else b"0       ") + (head[8:] + body).encode("latin-1") + data


@pytest.mark.parametrize("wide", [False, True])
def test_edf_and_bdf_samples(wide):
    found = list(edf.signals(edf_bytes({"A": [1, -2, 300, -4], "B": [-32768, 8]}, wide=wide)))
    assert [(label, fs) for label, fs, _ in found] == [("A", 2), ("B", 1)]
    unit = 1 if wide else 0.5
    assert found[0][2] == pytest.approx([unit * x for x in (1, -2, 300, -4)]) and found[1][2] == pytest.approx([unit * -32768, unit * 8])


def test_combined_files_and_their_faults(spark):
    good, other = edf_bytes({"A": [1, 2, 3, 4], "B": [5, 6, 7, 8], "C": [0] * 4}), edf_bytes({"A": [1] * 4})
    data = [("/a", "x.edf", good), ("/b", "x.edf", good), ("/b", "y.EDF", good), ("/c", "x.bdf", b"junk"), ("/d", "x.edf", other)]
    files = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in data], "src_path string, file string, content binary")
    found = edf.read_combined(files, ["A", "B"])
    assert sorted((r.src_path, r.channel, [round(v, 2) for v in r.samples]) for r in found.collect()) == [("/a", "A", [0.5, 1, 1.5, 2]), ("/a", "B", [2.5, 3, 3.5, 4])]
    assert rows(edf.combined_faults(files, ["A", "B"])) == [("/b", 3), ("/c", 1), ("/d", 13)]


def test_per_channel_files(spark):
    one, two = edf_bytes({"s": [2, 2]}), edf_bytes({"s": [4, 4], "t": [6, 6]})
    data = [("/a", "C3.bdf", two), ("/a", "C3.edf", one), ("/a", "C4.EDF", two), ("/b", "C3.edf", one), ("/c", "C3.edf", one[:-1]), ("/c", "C3.BDF", one), ("/c", "C4.edf", one), ("/d", "C3.edf", b"junk"), ("/d", "C4.edf", one), ("/e", "other.edf", one)]
    files = spark.createDataFrame([(a, b, bytearray(c)) for a, b, c in data], "src_path string, file string, content binary")
    found = edf.read_per_channel(files, ["C3", "C4"]).collect()
    wanted = [("/a", "C3", [1, 1]), ("/a", "C4", [2, 2, 3, 3]), ("/c", "C3", [1, 1]), ("/c", "C4", [1, 1])]
    assert sorted((r.src_path, r.channel, [round(v, 2) for v in r.samples]) for r in found) == wanted
    faults = {(r.src_path, r.code): r.channels for r in edf.per_channel_faults(files, ["C3", "C4"]).collect()}
    assert faults == {("/b", 1): ["C4"], ("/b", 13): ["C4"], ("/d", 1): ["C3"], ("/e", 1): ["C3", "C4"], ("/e", 13): ["C3", "C4"]}
    nights = spark.createDataFrame([("/a",), ("/f",)], "src_path string")
    assert sorted((r.src_path, r.code) for r in edf.per_channel_faults(files, ["C3"], nights).collect()) == [("/f", 1), ("/f", 13)]


def test_stage_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("h\n" * 5 + "0\tx\n3\ty\nbad\tz\n\n")
    found = scores.read_stages(spark, str(tmp_path / "a.txt"))
    assert [(r.epoch_idx, r.stage) for r in found.orderBy("epoch_idx").collect()] == [(0, 0), (1, 3), (2, None)]
    (tmp_path / "c.txt").write_text("2,1\n1,1\n")
    assert [r.stage for r in scores.read_stages(spark, str(tmp_path / "c.txt"), 0, ",").orderBy("epoch_idx").collect()] == [2, 1]


def test_score_tables(spark, tmp_path):
    (tmp_path / "u.csv").write_text("# made by a test\n# twice\nC3,C4,Start_time_sec,End_time_sec\n0,3,0.1,10\n1,0,10.1,20\n")
    wide = scores.read_wide_scores(spark, str(tmp_path / "u.csv"))
    assert wide.columns == ["C3", "C4", "path"] and wide.count() == 2
    assert sorted(r.comment for r in scores.read_comments(spark, str(tmp_path / "u.csv")).collect()) == ["made by a test", "twice"]


def test_golden_night(spark):
    """The published sample night: lights, the crop to the time in bed, and all statistics."""
    order = [2] * 31 + [0] * 100 + [-1] * 251 + [0] * 119 + [3] * 151 + [1, 4]  # between the first and last sleep; late stages last
    bed = [0] * 43 + [-1] * 36 + [None] * 659 + [-1] * 176 + [0] * 44
    for place, stage in ((79, 2), (87, 3), (197, 4), (200, 1), (737, 3)):
        bed[place] = stage
    rest = iter(order)
    bed = [next(rest) if s is None else s for s in bed]
    assert Counter(bed) == {-1: 463, 0: 306, 1: 2, 2: 32, 3: 153, 4: 2} and len(bed) == 958
    night = [0] * 5 + bed + [-1] * 6  # 969 epochs
    stages = spark.createDataFrame([("n", i, s) for i, s in enumerate(night)], "night_id string, epoch_idx int, stage int")
    mobility = spark.createDataFrame([("n", i, 1 if 17 <= i < 2889 else 3) for i in range(2907)], "night_id string, epoch_idx int, label int")
    lights = bedtime.lights(mobility)
    assert [tuple(r)[1:] for r in lights.select("night_id", "lights_out_epoch", "lights_on_epoch", "lights_out_second", "lights_on_second", "lights_out_data_index", "lights_on_data_index").collect()] == [(17, 2889, 170, 28890, 43520, 7395840)]
    cropped = bedtime.crop(stages, lights, 30)
    assert cropped.agg({"epoch_idx": "min"}).first()[0] == 5 and cropped.agg({"epoch_idx": "max"}).first()[0] == 962
    found = sleepstats.sleep_statistics(stages, lights).first().asDict()
    wanted = {
        "Scores_duration_min": 484.5, "Lights_out_sec": 170, "Lights_on_sec": 28890, "TIB_min": 479.0, "Scorable_pct": 51.67, "SPT_min": 329.5, "TST_min": 94.5, "N1_min": 1.0, "N1_pct": 1.06,
        "N2_min": 16.0, "N2_pct": 16.93, "N3_min": 76.5, "N3_pct": 80.95, "REM_min": 1.0, "REM_pct": 1.06, "NREM_min": 93.5, "NREM_pct": 98.94, "WASO_min": 109.5, "SOL_min": 39.5,
        "N1_latency_min": 100.0, "N2_latency_min": 39.5, "N3_latency_min": 43.5, "REM_latency_min": 98.5, "PSW_min": 110.0, "SE_pct": 19.73, "SME_pct": 28.68,
    }
    assert {k: found[k] for k in wanted} == wanted


def test_filtered_epochs_against_the_difference_equation(spark, sf_dir):
    """The registered filter query, sample by sample in plain Python."""
    from noctua.functions import filters
    from noctua.plans import registry

    found = {(r.night_id, r.epoch_idx): r.samples for r in registry.f1_filter_spiky(spark, sf_dir).collect()}
    plain = {(r.night_id, r.epoch_idx): list(r.samples) for r in registry.acceleration(spark, sf_dir).collect()}
    b, a = (x.tolist() for x in filters.butter_low(4, 5.0, 16))
    start = filters.steady(np.array(b), np.array(a)).tolist()

    def once(x):
        # y[t] = b0 x[t] + ... + b4 x[t-4] - a1 y[t-1] - ... - a4 y[t-4], begun in the steady state of the first sample
        z = [s * x[0] for s in start] + [0.0]
        out = []
        for v in x:
            y = b[0] * v + z[0]
            z = [z[k + 1] + b[k + 1] * v - a[k + 1] * y for k in range(4)] + [0.0]
            out.append(y)
        return out

    spiky = [k for k in plain if k[1] % 3 == 0]
    assert spiky and set(found) == set(plain)
    for k in plain:
        x = plain[k]
        if k in spiky:
            pad = 3 * len(a)
            x = [2 * x[0] - v for v in x[pad:0:-1]] + x + [2 * x[-1] - v for v in x[-2 : -pad - 2 : -1]]
            x = once(once(x)[::-1])[::-1][pad:-pad]
        assert found[k] == pytest.approx(x, abs=1e-9)


def test_stretched_epochs_against_one_spline_each(spark, sf_dir):
    from noctua.functions import spectral
    from noctua.plans import registry

    found = {(r.night_id, r.epoch_idx): r.spec for r in registry.x1_stretched_features(spark, sf_dir).collect()}
    for r in registry.acceleration(spark, sf_dir).collect():
        x = spectral.spline(np.array([r.samples]), np.linspace(0, 159, 2560))[0]
        window, step = spectral.tukey(256), 224
        for t in (0, 5, 10):
            part = x[t * step : t * step + 256]
            power = np.abs(np.fft.fft((part - part.mean()) * window)[:129]) ** 2 / (256 * (window**2).sum())
            power[1:-1] *= 2
            assert found[r.night_id, r.epoch_idx][t * 129 : (t + 1) * 129] == pytest.approx(power, rel=1e-4, abs=1e-9)


def plain_features(x: list, fs: float) -> dict[str, float]:
    """The spectral features that are not FFT means, each from its own formula: sums, direct transforms, normal equations."""
    n = len(x)
    out: dict[str, float] = {}
    # linear prediction: the normal equations solved directly; cepstra from the sums of powers of the poles
    r = [sum(x[i] * x[i + k] for i in range(n - k)) for k in range(13)]
    a = np.linalg.solve([[r[abs(i - j)] for j in range(12)] for i in range(12)], [-v for v in r[1:]])
    error = r[0] + sum(v * w for v, w in zip(a, r[1:]))
    poles = np.roots([1.0, *a])
    out |= {f"lpcc_{k}": float(np.log(error)) if k == 0 else float((poles**k).sum().real / k) for k in range(13)}
    # mel cepstra
    y = [x[0], *(x[i] - 0.97 * x[i - 1] for i in range(1, n))]
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = [700 * (10 ** (mel(fs / 2) * k / 41 / 2595) - 1) for k in range(42)]
    window = [0.54 - 0.46 * np.cos(2 * np.pi * i / 511) for i in range(512)]
    turn = np.exp(-2j * np.pi * np.outer(np.arange(257), np.arange(512)) / 512)
    logs, frames = np.zeros(40), 0
    for start in range(0, n - 511, 256):
        power = np.abs(turn @ (np.array(y[start : start + 512]) * window)) ** 2 / 512
        for m in range(40):
            low, mid, high = edges[m : m + 3]
            total = 0.0
            for k in range(257):
                f = k * fs / 512
                total += power[k] * max(0.0, min((f - low) / (mid - low), (high - f) / (high - mid)))
            logs[m] += np.log(max(total, 1e-12))
        frames += 1
    out |= {f"mfcc_{c}": sum(logs[m] / frames * np.cos(np.pi * c * (m + 0.5) / 40) for m in range(40)) for c in range(1, 13)}
    # wavelets: plain convolutions
    energies = []
    for scale in range(1, 10):
        t = [k / scale for k in range(-5 * scale, 5 * scale + 1)]
        kernel = [2 / (np.sqrt(3 * scale) * np.pi**0.25) * (1 - v * v) * np.exp(-v * v / 2) for v in t]
        w = np.convolve(x, kernel)[5 * scale : 5 * scale + n]
        energies.append((w * w).sum())
        out |= {f"wavelet_abs_{scale}": np.abs(w).mean(), f"wavelet_energy_{scale}": energies[-1], f"wavelet_std_{scale}": np.sqrt(((w - w.mean()) ** 2).mean()), f"wavelet_var_{scale}": ((w - w.mean()) ** 2).mean()}
    p = [v / sum(energies) for v in energies]
    out["wavelet_entropy"] = -sum(v * np.log2(v) for v in p if v > 0)
    # shape of the amplitude spectrum, by the direct transform
    half = n // 2 + 1
    amp = np.abs(np.array([np.exp(-2j * np.pi * k * np.arange(n) / n) @ np.array(x) for k in range(half)]))
    f, power = [k * fs / n for k in range(half)], amp**2
    level = lambda s: next(f[k] for k in range(half) if power[: k + 1].sum() >= s * power.sum() * (1 - 1e-12))
    mass = amp.sum()
    centre = sum(v * w for v, w in zip(f, amp)) / mass
    moment = lambda k: sum(w * (v - centre) ** k for v, w in zip(f, amp)) / mass
    width = np.sqrt(moment(2))
    out |= {"fundamental": f[1 + int(amp[1:].argmax())], "human": sum(w for v, w in zip(f, power) if 0.6 <= v <= 2.5) / power.sum(), "max_power": power.max() / (fs * n), "max_frequency": level(0.95), "median_frequency": level(0.5), "bandwidth": level(0.975) - level(0.025)}
    out["centroid"] = centre
    out["decrease"] = sum((amp[k] - amp[0]) / k for k in range(1, half)) / amp[1:].sum()
    out["distance"] = sum(mass * k / (half - 1) - amp[: k + 1].sum() for k in range(half))
    share = power / power.sum()
    out["entropy"] = -sum(v * np.log2(v) for v in share if v > 0) / np.log2(half)
    out["kurtosis"] = moment(4) / width**4
    out["turning"] = sum(amp[k] > amp[k - 1] and amp[k] > amp[k + 1] for k in range(1, half - 1))
    out |= {"roll_off": level(0.95), "roll_on": level(0.05), "skewness": moment(3) / width**3}
    middle = sum(f) / half
    out["slope"] = sum(w * (v - middle) for v, w in zip(f, amp)) / sum((v - middle) ** 2 for v in f)
    out["spread"] = width
    out["variation"] = 1 - sum(amp[k] * amp[k + 1] for k in range(half - 1)) / np.sqrt((amp[:-1] ** 2).sum() * (amp[1:] ** 2).sum())
    return out


#: The names in the order of the vector: four measures of nine scales, measure by measure.
SPECTRAL = [f"lpcc_{k}" for k in range(13)] + [f"mfcc_{k}" for k in range(1, 13)] + [f"wavelet_{m}_{s}" for m in ("abs", "energy", "std", "var") for s in range(1, 10)] + ["wavelet_entropy"] + [
    "fundamental", "human", "max_power", "max_frequency", "median_frequency", "bandwidth", "centroid", "decrease", "distance", "entropy", "kurtosis", "turning", "roll_off", "roll_on", "skewness", "slope", "spread", "variation",
]


def test_all_features_of_the_query(spark, sf_dir):
    """Every spectral feature by its own formula; statistical and temporal ones have a query with SQL."""
    from noctua.functions import features
    from noctua.plans import bindings, registry

    found = {(r.night_id, r.epoch_idx): r.stat for r in registry.x5_all_features(spark, sf_dir).collect()}
    whole = epochs.to_epochs(bindings.recording(spark, sf_dir)).collect()
    assert len(found) == len(whole) > 0 and 54 + 256 + len(SPECTRAL) == 390
    at = {n: i for i, n in enumerate(features.STATISTICAL + features.TEMPORAL)}
    for r in whole:
        x, own = np.array(r.samples), found[r.night_id, r.epoch_idx]
        assert (own[at["variance"]], own[at["skewness"]]) == pytest.approx((x.var(), ((x - x.mean()) ** 3).mean() / x.std() ** 3))
        frames = [x[i : i + 510] - x[i : i + 510].mean() for i in range(0, 2560 - 509, 255)]
        k = np.exp(-2j * np.pi * np.outer(np.arange(256), np.arange(510)) / 510)
        assert own[54 : 54 + 256] == pytest.approx(np.mean([np.abs(k @ f) ** 2 / (256 * 510) for f in frames], axis=0), rel=1e-6, abs=1e-12)
        wanted = plain_features(x.tolist(), 256.0)
        for i, name in enumerate(SPECTRAL):
            assert own[310 + i] == pytest.approx(wanted[name], rel=1e-5, abs=1e-9), name


def test_job_against_its_steps(spark, sf_dir):
    """The whole job against one night after another in plain numpy."""
    from noctua.functions import spectral
    from noctua.plans import jobs, registry

    files, setup = registry.job_files(spark, sf_dir), registry.job_setup()
    found = registry.job_results(spark, sf_dir)
    name = lambda path: path.rpartition("/")[2]
    usability = {(name(r.night_id), r.epoch_idx): r.label for r in found.usability.collect()}
    mobility = {(name(r.night_id), r.epoch_idx): r.label for r in found.mobility.collect()}
    rejected = {(name(r.night_id), r.epoch_idx): r.stage for r in found.rejected.collect()}
    statistics = {r.night_id: r for r in registry.job_night_statistics(spark, sf_dir).collect()}
    recovered = {r.night_id: r for r in registry.job_filter_spiky(spark, sf_dir).collect()}
    nights_seen = 0
    for f in files.collect():
        with open("/" + f.path[5:].lstrip("/"), "rb") as content:
            x = {label: s.astype(float)[: len(s) // 2560 * 2560].reshape(-1, 2560) for label, _, s in edf.signals(content.read())}
        night, n = name(f.path.rpartition("/")[0]), len(x["EEG"])
        if n < 6:
            continue
        nights_seen += 1
        norm = np.sqrt(x["dX"] ** 2 + x["dY"] ** 2 + x["dZ"] ** 2)
        lite = np.concatenate([spectral.spectrogram(x["EEG"], 256), spectral.spectrogram(norm, 256)], axis=1)
        labels = setup.usability(lite).argmax(axis=1)
        power = np.concatenate([spectral.welch(x[a], 256) for a in ("dX", "dY", "dZ")], axis=1)
        assert [usability[night, i] for i in range(n)] == labels.tolist() and len(set(labels.tolist())) == 2
        assert [mobility[night, i] for i in range(n)] == setup.mobility(power).argmax(axis=1).tolist()
        wanted = [-1 if 2 * sum(labels[3 * i : 3 * i + 3] != 0) > 3 else i % 5 for i in range(n // 3)]
        assert [rejected[night, i] for i in range(n // 3)] == [4 if w == 5 else w for w in wanted]
        assert statistics[night].Scores_duration_min == n // 3 / 2
        assert recovered[night].n_spiky == (labels == 3).sum()
    assert nights_seen


def test_job_passes_over_finished_and_broken_nights(spark, tmp_path):
    from noctua.plans import jobs
    from noctua.sources import recordings

    good = edf_bytes({"A": [1, 2, 3, 4], "B": [5, 6, 7, 8]})
    for name, content in (("a", good), ("b", good), ("c", b"junk")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.edf").write_bytes(content)
    files, config = recordings.listing(spark, f"file://{tmp_path}"), Config(rate=2)
    path = lambda n: f"file:{tmp_path}/{n}"
    done = spark.createDataFrame([(path("a"), "usability", sinks.config_hash(config)), (path("b"), "usability", "other")], "night_id string, step string, config_hash string")
    left = jobs.nights_to_do(files, done, "usability", config)
    assert sorted(r.path for r in left.collect()) == [path("b/x.edf"), path("c/x.edf")]
    setup = jobs.Setup(["A"], None, None, axes=("B",), config=config)
    found = jobs.signal_epochs(left, setup, f"file://{tmp_path}/work")
    assert found.epochs.count() == 0 and rows(found.faults) == [(path("b"), 2), (path("c"), 1)]


def test_helpers_get_few_values_at_once(monkeypatch):
    """However many rows a batch has; rows keep their places, and rows without samples or a rate are null."""
    seen = []

    def helper(x, fs):
        seen.append(x.size)
        return x[:, :2] * fs

    monkeypatch.setattr(signals, "CHUNK", 40)
    values = [[float(i), 1.0, 2.0, 3.0] if i % 3 else [float(i)] * 5 for i in range(100)] + [None, [], [7.0] * 60]
    found = signals.by_chunks(helper, pa.array(values), np.array([2.0] * 50 + [0.0] + [2.0] * 52)).to_pylist()
    assert max(seen) == 60 and sorted(set(seen)) != [60]
    assert found == [[2 * x for x in v[:2]] if v and i != 50 else None for i, v in enumerate(values)]
