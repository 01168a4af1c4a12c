"""Recordings in parts, score tables, whole jobs: gates, outputs, what is left after a stop; saved features; tree ensembles."""

import os
import shutil

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from noctua.functions import spectral, trees
from noctua.functions.config import Config
from noctua.operators import epochs, signals, sinks
from noctua.plans import jobs, registry
from noctua.sources import edf, recordings, scores
from tests.test_operators import edf_bytes, rows


def put(folder, name: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(f"{folder}/{name}"), exist_ok=True)
    with open(f"{folder}/{name}", "wb") as out:
        out.write(data)


def cells(df):
    return sorted((r.src_path.rpartition("/")[2], r.channel, r.fs, r.epoch_idx, tuple(r.samples)) for r in df.collect())


def night(seconds=100, fs=4, labels=("A", "B"), wide=False, rng=None, per=1, span=1):
    rng = rng or np.random.default_rng(1)
    return edf_bytes({x: rng.integers(-900, 900, fs * seconds * (1 + i % 2)).tolist() for i, x in enumerate(labels)}, seconds=span, records=seconds // span, wide=wide)


@pytest.mark.parametrize("wide", [False, True])
@pytest.mark.parametrize("span", [1, 5])
def test_ranges_are_the_whole(spark, tmp_path, wide, span):
    """One range or many, records of one or five seconds: the blocks that the whole content gives."""
    data = {f"n{k}": night(70 + 25 * k, 4 + k, wide=wide, rng=np.random.default_rng(k), span=span) for k in range(3)}
    for name, content in data.items():
        put(tmp_path, f"{name}/x.{'bdf' if wide else 'edf'}", content)
    found = recordings.catalog(recordings.listing(spark, f"file://{tmp_path}")).cache()
    wanted = sorted((n, label, fs, i, tuple(x[j : j + 10 * fs].tolist())) for n, c in data.items() for label, fs, x in edf.signals(c) for i, j in enumerate(range(0, len(x), 10 * fs)))
    for size in (1 << 20, 700, 150):
        chosen, faults = recordings.combined(found, ["A", "B"])
        assert faults.count() == 0 and cells(recordings.blocks(chosen, ["A", "B"], size)) == wanted
    recordings.register(spark)
    assert cells(spark.read.format("edf").option("rangeBytes", 500).load(f"file://{tmp_path}")) == wanted
    block = recordings.blocks(found, ["B"], 300).where("epoch_idx = 1").orderBy("src_path").first()
    assert (block.n, block.least, block.most) == (len(block.samples), min(block.samples), max(block.samples))


def test_signals_of_a_file_one_after_another_in_ranges(spark, tmp_path):
    put(tmp_path, "a/C3.edf", night(55, 3, ("s", "t", "u")))
    put(tmp_path, "a/C4.EDF", night(55, 3, ("s",)))
    found = recordings.catalog(recordings.listing(spark, f"file://{tmp_path}"))
    chosen, faults = recordings.per_channel(found, ["C3", "C4"])
    whole = np.concatenate([x for _, _, x in edf.signals(night(55, 3, ("s", "t", "u")))])
    for size in (1 << 20, 90):
        got = [r for r in cells(recordings.blocks(chosen, None, size)) if r[1] == "C3"]
        assert np.concatenate([r[4] for r in got]).tolist() == whole.tolist() and [r[3] for r in got] == list(range(len(got)))
    assert faults.count() == 0


def test_faults_come_from_headers(spark, tmp_path):
    good = night()
    for name, data in {"ok/x.edf": good, "two/x.edf": good, "two/y.edf": good, "cut/x.edf": good[:-1], "junk/x.bdf": b"junk", "lack/x.edf": night(labels=("A",)), "zero/x.edf": good.replace(b"100     1       ", b"0       1       ")}.items():
        put(tmp_path, name, data)
    found = recordings.catalog(recordings.listing(spark, f"file://{tmp_path}"))
    chosen, faults = recordings.combined(found, ["A", "B"])
    assert {r.src_path.rpartition("/")[2]: r.code for r in faults.collect()} == {"two": 3, "cut": 1, "junk": 1, "lack": 13}
    assert {r[0] for r in cells(recordings.blocks(chosen, ["A", "B"]))} == {"ok"}


def test_no_content_is_shuffled(spark, tmp_path):
    put(tmp_path, "a/x.edf", night())
    chosen, _ = recordings.combined(recordings.catalog(recordings.listing(spark, f"file://{tmp_path}")), ["A", "B"])
    plan = recordings.blocks(chosen, ["A", "B"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "content#" not in plan
    lines = plan.splitlines()
    exchanges = [i for i, x in enumerate(lines) if "Exchange" in x]
    assert all("samples" not in x for i in exchanges for x in lines[i:])  # blocks leave the last stage


def test_written_files_are_read_back(spark, tmp_path):
    rng = np.random.default_rng(5)
    data = [(n, e, rng.uniform(-1, 1, 80).tolist(), rng.uniform(-3, 3, 80).tolist()) for n in ("a", "b") for e in range(7)]
    frame = spark.createDataFrame(data, "night_id string, epoch_idx int, `C 3` array<double>, dX array<double>").repartition(5)
    done = sinks.write_edf(frame, f"file://{tmp_path}/out", ["C 3", "dX"], 8, {"C 3": -1.0, "dX": -2.0}, {"C 3": 1.0, "dX": 2.0})
    assert sorted((r.night_id, r.records) for r in done.collect()) == [("a", 70), ("b", 70)]
    found = cells(recordings.blocks(recordings.catalog(recordings.listing(spark, f"file://{tmp_path}/out")), ["C 3", "dX"]))
    for n, e, x, y in data:
        own = {r[1]: r[4] for r in found if r[0] == n and r[3] == e}
        assert own["C 3"] == pytest.approx(x, abs=2e-5) and own["dX"] == pytest.approx(np.clip(y, -2, 2).tolist(), abs=4e-5)


def test_tables_of_differing_columns(spark, tmp_path):
    head = "# made by a test\n"
    for name, text in {"1": head + "EEG L,EEG R,Start_time_sec,End_time_sec\n1,2,0,10\n3,4,10,20\n", "2": "EEG R,EEG L\r\n5,6\r\n\r\n", "3": '"EEG L","odd, name"\n7,\n', "4": "# nothing\n"}.items():
        put(tmp_path, f"{name}.csv", text.encode())
    found = scores.read_scores(spark, str(tmp_path / "*.csv"))
    got = sorted((r.path[-5], r.epoch_idx, r.channel, r.label) for r in found.collect())
    assert got == [("1", 0, "EEG L", 1), ("1", 0, "EEG R", 2), ("1", 1, "EEG L", 3), ("1", 1, "EEG R", 4), ("2", 0, "EEG L", 6), ("2", 0, "EEG R", 5), ("3", 0, "EEG L", 7), ("3", 0, "odd, name", None)]
    wide = scores.read_wide_scores(spark, str(tmp_path / "*.csv"), ["EEG R", "EEG L"])
    assert sorted((r.path[-5], r["EEG L"], r["EEG R"]) for r in wide.collect()) == [("1", "1", "2"), ("1", "3", "4"), ("2", "6", "5"), ("3", "7", None)]
    assert scores.read_wide_scores(spark, str(tmp_path / "1.csv")).columns == ["EEG L", "EEG R", "path"]


def test_blocks_at_other_rates(spark):
    """Blocks with edges give what one spline through the whole signal gives; no sample becomes a row."""
    rng = np.random.default_rng(2)
    data = []
    for name, fs, n in (("p", 100, 3470), ("q", 7, 7 * 41), ("r", 256, 5000), ("s", 50, 500), ("t", 9, 93)):
        x = rng.standard_normal(n)
        data += [("n", name, fs, i // (10 * fs), x[i : i + 10 * fs].tolist()) for i in range(0, n, 10 * fs)]
    blocks = spark.createDataFrame(data, "night_id string, channel string, fs int, epoch_idx int, samples array<double>").repartition(4)
    made = signals.resample_blocks(blocks)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    found: dict = {}
    for r in made.orderBy("channel", "epoch_idx").collect():
        assert r.fs == 256 and r.epoch_idx * 2560 == len(found.setdefault(r.channel, []))
        found[r.channel] += r.samples
    for name, fs in (("p", 100), ("q", 7), ("s", 50), ("t", 9)):
        x = np.concatenate([d[4] for d in sorted(data) if d[1] == name])
        count = int(len(x) * (256 / fs))
        assert found[name] == pytest.approx(spectral.spline(x[None], np.arange(count) * (fs / 256))[0].tolist(), abs=1e-6)
    assert len(found["r"]) == 5000


def test_saved_features_need_no_shuffle(spark):
    data = [("n", c, i, float(i)) for c in ("A", "B", "Z") for i in range(40)]
    frame = spark.createDataFrame(data, "night_id string, channel string, epoch_idx int, total double")
    for name, part in (("saved_eeg", frame.where("channel <> 'Z'")), ("saved_acc", frame.where("channel = 'Z'")), ("saved_new", frame.where("channel = 'A' AND epoch_idx % 2 = 0").withColumn("total", F.lit(-1.0)))):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        sinks.save_features(part, name, 4)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.requireAllClusterKeysForCoPartition")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
        paired = epochs.pair_with_acceleration(spark.table("saved_eeg"), spark.table("saved_acc"), ["total"])
        laid = epochs.put_back(spark.table("saved_eeg"), spark.table("saved_new"), "total")
        for found in (paired, laid):
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert paired.count() == 80 and laid.where("total = -1").count() == 20
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


# ----- whole jobs


def model(first, second):
    """Label by the sign of the vector's first value, with probability 0.9."""

    def run(x):
        out = np.full((len(x), 4), 0.1 / 3)
        out[np.arange(len(x)), np.where(x[:, 0] >= 0, first, second)] = 0.9
        return out

    return run


def setup(**changed) -> jobs.Setup:
    return jobs.Setup(**({"channels": ["A", "B"], "usability": model(0, 3), "mobility": model(1, 3), "axes": ("X",), "config": Config(rate=8), "least_run": 2, "lite": True} | changed))


def signal_file(seconds=190, labels=("A", "B", "X"), top=100, rates=None, axis=3):
    """Digital values of which the physical range is half: an axis within -2 to 2 has at most 4."""
    rng = np.random.default_rng(7)
    rates = rates or dict.fromkeys(labels, 8)
    return edf_bytes({x: rng.integers(-axis if x == "X" else -3, axis if x == "X" else top, rates[x] * seconds).tolist() for x in labels}, records=seconds)


@pytest.fixture()
def recorded(tmp_path):
    """Nights of all sorts; stages of most."""
    put(tmp_path, "raw/good/x.edf", signal_file())
    put(tmp_path, "raw/slow/x.edf", signal_file(rates={"A": 4, "B": 8, "X": 2}, axis=1))  # splines reach beyond their samples
    put(tmp_path, "raw/short/x.edf", signal_file(50))
    put(tmp_path, "raw/two/x.edf", signal_file())
    put(tmp_path, "raw/two/y.edf", signal_file())
    put(tmp_path, "raw/junk/x.edf", b"junk")
    put(tmp_path, "raw/lack/x.edf", signal_file(labels=("A", "X")))
    put(tmp_path, "raw/loud/x.edf", edf_bytes({"A": [1] * 1560, "B": [2] * 1560, "X": [3] * 1559 + [5]}, records=195))  # beyond the whole epochs
    put(tmp_path, "raw/wild/x.edf", edf_bytes({"A": [1] * 1520, "B": [2] * 1520, "X": [5] + [3] * 1519}, records=190))
    for name in ("unread", "long", "range", "unscored", "minute"):
        put(tmp_path, f"raw/{name}/x.edf", signal_file(70 if name == "minute" else 190))
    return tmp_path


def stages_of(spark, folder):
    own = {"good": [0, 2, 2, 3, 5, 0], "slow": [1] * 6, "unread": [0, None, 9, 0, 0, 0], "long": [0] * 7, "range": [0, 6, 0, 0, 0, 0], "minute": [1, 1], "loud": [0] * 6, "wild": [0] * 6}
    return spark.createDataFrame([(f"file:{folder}/raw/{n}", i, s) for n, x in own.items() for i, s in enumerate(x)], "night_id string, epoch_idx int, stage int")


def by_name(df):
    return sorted((r.night_id.rpartition("/")[2], r.code) for r in df.collect())


def test_every_gate_of_the_job(spark, recorded):
    """Each fault comes once, its night goes no farther than that, and other nights are not touched by it."""
    files = recordings.listing(spark, f"file://{recorded}/raw")
    found = jobs.night_statistics(files, stages_of(spark, recorded), setup(mobility=model(3, 3)), f"file://{recorded}/work")
    dark = [(n, 9) for n in ("good", "long", "loud", "minute", "range", "slow", "unread", "unscored")]  # no mobility says laying
    wanted = [("junk", 1), ("lack", 13), ("long", 5), ("minute", 11), ("range", 6), ("short", 2), ("two", 3), ("unread", 4), ("unscored", 10), ("wild", 12)]
    assert by_name(found.faults) == sorted(wanted + dark)
    assert {r.night_id.rpartition("/")[2] for r in found.statistics.collect()} == {"good", "loud", "slow"}
    assert {r.night_id.rpartition("/")[2] for r in found.usability.select("night_id").distinct().collect()} == {"good", "long", "loud", "minute", "range", "slow", "unread", "unscored"}
    assert found.usability.where("night_id LIKE '%/slow'").count() == 2 * 19  # at the configured rate, 190 seconds


def test_files_are_decoded_once(spark, recorded):
    """With the recordings gone after the one pass, all results are still there, as often as they are asked for."""
    own = setup()
    found = jobs.signal_epochs(recordings.listing(spark, f"file://{recorded}/raw"), own, f"file://{recorded}/work")
    shutil.rmtree(recorded / "raw")
    results = jobs.labelled(found, stages_of(spark, recorded), own, f"file://{recorded}/work")
    for _ in range(2):
        assert results.statistics.count() == 3 and results.usability.count() > 0 and results.mobility.count() > 0 and results.faults.count() > 0


def test_stopped_and_repeated_jobs(spark, recorded, monkeypatch):
    """A job that dies between two steps, run again, gives the tables of one run; finished nights are not read again."""
    raw, own, stages = f"file://{recorded}/raw", setup(), stages_of(spark, recorded)
    files = recordings.listing(spark, raw)
    once = jobs.run(files, stages, own, f"file://{recorded}/w1", f"file://{recorded}/one")
    assert once["n_nights"] == 13 and once["n_failed"] == 8 and 0 < once["usable_percent"] <= 100
    enter = sinks.enter

    def dies(nights, out, step, config):
        if step == "lights":
            raise RuntimeError("stopped")
        enter(nights, out, step, config)

    monkeypatch.setattr(sinks, "enter", dies)
    with pytest.raises(RuntimeError):
        jobs.run(files, stages, own, f"file://{recorded}/w2", f"file://{recorded}/two")
    monkeypatch.setattr(sinks, "enter", enter)
    assert {r.step for r in sinks.ledger(spark, f"file://{recorded}/two").collect()} == {"usability", "rejected", "mobility"}
    jobs.run(files, stages, own, f"file://{recorded}/w3", f"file://{recorded}/two")
    for step in (*jobs.STEPS, "nights", "usability_probabilities"):
        a, b = (sorted(map(str, spark.read.parquet(f"file://{recorded}/{x}/{step}").collect())) for x in ("one", "two"))
        assert a == b and a, step
    put(recorded, "raw/later/x.edf", signal_file(130))
    shutil.rmtree(recorded / "raw/good")  # a finished night is not needed any more
    again = jobs.run(recordings.listing(spark, raw), stages, own, f"file://{recorded}/w4", f"file://{recorded}/two")
    assert again["n_nights"] == 1
    assert {r.night_id.rpartition("/")[2] for r in spark.read.parquet(f"file://{recorded}/two/usability").select("night_id").distinct().collect()} >= {"good", "later"}
    assert jobs.run(recordings.listing(spark, raw), stages, own, f"file://{recorded}/w5", f"file://{recorded}/two")["n_nights"] == 0
    assert jobs.nights_to_do(recordings.listing(spark, raw), sinks.ledger(spark, f"file://{recorded}/two"), "nights", Config(rate=16)).count() > 0  # other settings


def test_counts_on_the_way_are_those_of_the_report(spark, recorded):
    from noctua.operators import checks

    own = setup()
    results = jobs.night_statistics(recordings.listing(spark, f"file://{recorded}/raw"), stages_of(spark, recorded), own, f"file://{recorded}/work")
    counts = jobs.write_results(results, own, f"file://{recorded}/out")
    report = checks.error_report([results.faults])
    every = results.facts.select("night_id").unionByName(report.select("night_id"))
    n = checks.success_count(every, report).first()
    assert (counts["n_nights"], counts["n_failed"]) == (n.n_nights, n.n_failed)
    share = results.usability.agg((100 * F.count_if(F.col("label") == 0) / F.count("*")).alias("p")).first().p
    assert counts["usable_percent"] == pytest.approx(share)


def test_files_of_channels_and_no_accelerometer(spark, tmp_path):
    one = signal_file(labels=("s",))
    for n in ("a", "b"):
        put(tmp_path, f"raw/{n}/A.edf", one)
        put(tmp_path, f"raw/{n}/B.EDF", one if n == "a" else b"junk")
    own = setup(axes=(), per_channel=True, lite=False)
    stages = spark.createDataFrame([(f"file:{tmp_path}/raw/a", i, 2) for i in range(6)], "night_id string, epoch_idx int, stage int")
    found = jobs.night_statistics(recordings.listing(spark, f"file://{tmp_path}/raw"), stages, own, f"file://{tmp_path}/work")
    assert by_name(found.faults) == [("b", 1)]
    assert found.usability.count() == 38 and found.mobility.count() == 0
    assert [r.Lights_out_sec for r in found.statistics.collect()] == [None]
    vector = jobs.features_of(*[x for x in jobs.split_signals(jobs.signal_epochs(recordings.listing(spark, f"file://{tmp_path}/raw"), own, f"file://{tmp_path}/w2").epochs, own) if x is not None], own).first().features
    assert len(vector) == 3618 and max(map(abs, vector[1419:2838])) < 1e-25  # the spectrogram of the constant acceleration


def test_statistics_of_axes_for_mobility(spark, recorded):
    seen = []

    def wide(x):
        out = np.zeros((len(x), 4))
        out[:, 1] = x.shape[1] == 390
        return out

    found = jobs.night_statistics(recordings.listing(spark, f"file://{recorded}/raw/good"), stages_of(spark, recorded), setup(lite_mobility=False, mobility=wide), f"file://{recorded}/work")
    seen = found.mobility.where("probs[1] = 100").count()
    assert seen == 19


def test_kept_features_are_used_again(spark, recorded):
    """Features of a night that fit its signal are not computed again; others are, and are kept too."""
    raw, kept = f"file://{recorded}/raw", f"file://{recorded}/kept"
    own = setup(lite=False, lite_mobility=False, saved=kept)
    stages = stages_of(spark, recorded)
    plain = jobs.night_statistics(recordings.listing(spark, f"{raw}/good"), stages, setup(lite=False, lite_mobility=False), f"file://{recorded}/w0")
    first = jobs.night_statistics(recordings.listing(spark, f"{raw}/good"), stages, own, f"file://{recorded}/w1")
    assert rows(first.usability.select("channel", "epoch_idx", "probs")) == rows(plain.usability.select("channel", "epoch_idx", "probs"))
    assert rows(first.mobility.select("epoch_idx", "probs")) == rows(plain.mobility.select("epoch_idx", "probs"))
    folder = f"{kept}/EEG-{sinks.config_hash(own.config)}"
    saved = spark.read.parquet(folder)
    assert saved.count() == 38 and {f.rpartition("/")[2].split("-")[0] for f in os.listdir(f"{recorded}/kept")} == {"EEG", "ACCagg", "ACC"}
    marked = spark.createDataFrame([(r.channel, r.epoch_idx, [7.5] * 390, r.night_id) for r in saved.collect()], "channel string, epoch_idx int, stat array<double>, night_id string")
    sinks.write_nights(marked, folder, only_these=True)
    put(recorded, "raw/later/x.edf", signal_file(130))
    jobs.night_statistics(recordings.listing(spark, raw).where("path LIKE '%/good/%' OR path LIKE '%/later/%'"), stages, own, f"file://{recorded}/w2")
    now = spark.read.parquet(folder)
    assert {r.night_id.rpartition("/")[2]: r.n for r in now.groupBy("night_id").agg(F.count_if(F.col("stat")[5] == 7.5).alias("n")).collect()} == {"good": 38, "later": 0}
    sinks.write_nights(spark.createDataFrame([tuple(r) for r in now.where("night_id LIKE '%good' AND epoch_idx < 5").collect()], now.schema), folder, only_these=True)
    jobs.night_statistics(recordings.listing(spark, f"{raw}/good"), stages, own, f"file://{recorded}/w3")
    again = spark.read.parquet(folder).where("night_id LIKE '%good'")
    assert again.count() == 38 and again.where("stat[5] = 7.5").count() == 0  # those that did not fit were made anew


def test_filtered_signal_as_files(spark, recorded):
    own = setup()
    work = f"file://{recorded}/work"
    signal = jobs.signal_epochs(recordings.listing(spark, f"file://{recorded}/raw/good"), own, work)
    usability = jobs.labelled(signal, stages_of(spark, recorded), own, work).usability
    eeg, _, acc = jobs.split_signals(signal.epochs, own)
    named = lambda df: df.withColumn("night_id", F.element_at(F.split("night_id", "/"), -1))
    filtered, rescored, recovery = jobs.filter_spiky_epochs(named(eeg), named(acc), named(usability), own, cutoff=2.0)
    done = jobs.write_filtered(filtered, f"file://{recorded}/filtered", own, -100, 100).collect()
    assert [(r.night_id, r.records) for r in done] == [("good", 190)] and rescored.count() == 38 and recovery.count() == 1
    back = {(r[1], r[3]): r[4] for r in cells(recordings.blocks(recordings.catalog(recordings.listing(spark, f"file://{recorded}/filtered")), ["A", "B"]))}
    for r in filtered.collect():
        assert back[r.channel, r.epoch_idx] == pytest.approx(np.clip(r.samples, -100, 100).tolist(), abs=0.01)


# ----- models


def grown(rng, features, depth):
    """A random tree as nested tuples, and its text."""
    lists: dict = {k: [] for k in ("split_feature", "threshold", "decision_type", "left_child", "right_child")}
    leaves: list = []

    def grow(d):
        if d == 0 or rng.random() < 0.2:
            leaves.append(float(np.round(rng.standard_normal(), 3)))
            return -len(leaves), leaves[-1]
        i = len(lists["threshold"])
        f, t, kind = int(rng.integers(features)), float(np.round(rng.standard_normal(), 2)), int(rng.choice([0, 2, 4, 6, 8, 10]))
        for k, v in (("split_feature", f), ("threshold", t), ("decision_type", kind), ("left_child", 0), ("right_child", 0)):
            lists[k].append(v)
        (a, left), (b, right) = grow(d - 1), grow(d - 1)
        lists["left_child"][i], lists["right_child"][i] = a, b
        return i, (f, t, kind, left, right)

    _, tree = grow(depth)
    text = f"num_leaves={len(leaves)}\n" + "".join(f"{k}={' '.join(map(str, v))}\n" for k, v in lists.items()) + f"leaf_value={' '.join(map(str, leaves))}\n"
    return tree, text


def walk(tree, x):
    while isinstance(tree, tuple):
        f, t, kind, left, right = tree
        v, missing = x[f], kind >> 2
        if np.isnan(v) and missing != 2:
            v = 0.0
        absent = (missing == 2 and np.isnan(v)) or (missing == 1 and v == 0)
        tree = (left if kind & 2 else right) if absent else left if v <= t else right
    return tree


@pytest.mark.parametrize("classes", [1, 3])
def test_trees_against_a_recursive_walk(classes):
    rng = np.random.default_rng(classes)
    made = [grown(rng, 6, 5) for _ in range(4 * classes)] + [(0.25, "num_leaves=1\nsplit_feature=\nthreshold=\ndecision_type=\nleft_child=\nright_child=\nleaf_value=0.25\n")] * classes
    objective = "binary sigmoid:2" if classes == 1 else "multiclass num_class:3"
    text = f"tree\nversion=v4\nnum_class={classes}\nnum_tree_per_iteration={classes}\nobjective={objective}\n" + "".join(f"\nTree={i}\n{t}\n" for i, (_, t) in enumerate(made)) + "\nend of trees\n\nparameters:\n[x: 1]\n"
    model_ = trees.parse(text)
    x = np.round(rng.standard_normal((300, 6)), 1)
    x[rng.random(x.shape) < 0.1] = np.nan
    raw = np.array([[sum(walk(t, row) for t, _ in made[k::classes]) for k in range(classes)] for row in x])
    assert model_.raw(x, 64) == pytest.approx(raw)
    p = model_(x)
    wanted = 1 / (1 + np.exp(-2 * raw[:, 0])) if classes == 1 else (np.exp(raw) / np.exp(raw).sum(axis=1, keepdims=True))[:, 1]
    assert p.sum(axis=1) == pytest.approx(1) and p[:, 1] == pytest.approx(wanted)


def test_unknown_models_are_refused():
    with pytest.raises(ValueError):
        trees.parse("tree\nobjective=regression\n\nend of trees")
    with pytest.raises(ValueError):
        trees.parse(registry.TREES.replace("decision_type=2 2\n", "decision_type=1 2\n"))


@pytest.mark.parametrize("n, half, count", [(64, 3.0, 5), (160, 4.0, 7), (16, 2.0, 3)])
def test_slepian_tapers(n, half, count):
    """Orthonormal, and concentrated as the sinc kernel's own eigenvalues say."""
    v, share = spectral.slepian(n, half, count)
    w, lag = half / n, np.arange(n)[:, None] - np.arange(n)
    kernel = 2 * w * np.sinc(2 * w * lag)
    assert np.abs(v @ v.T - np.eye(count)).max() < 1e-10
    assert share == pytest.approx(np.linalg.eigvalsh(kernel)[::-1][:count], abs=1e-10)
    assert np.abs(kernel @ v.T - v.T * share).max() < 1e-10


def test_a_night_is_one_text_file_whatever_is_coalesced(spark, tmp_path):
    """Parts of a union are coalesced apart, so a shuffle by night that is left out splits nights over files."""
    settings = {
        "spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k",
        "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    }
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 4_000, 1, 4).select((F.col("id") % 100).cast("string").alias("n"), F.floor(F.col("id") / 100).cast("int").alias("at"))
        lines = rows.withColumn("m", F.count("*").over(Window.partitionBy("n"))).where("m > 0").select("n", "at", F.col("at").cast("string").alias("value"))
        registry.write_lines(lines, dict.fromkeys(range(-5, 0), "head"), f"file://{tmp_path}/lines")
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    files = list(tmp_path.glob("lines/n=*/*.txt"))
    assert len(files) == 100
    assert all(f.read_text() == "head\n" * 5 + "".join(f"{i}\n" for i in range(40)) for f in files)


def test_nights_are_written_whole_and_alone(spark, tmp_path):
    """One file for each night in its order, whatever its name; other nights stay, files of another writer do not."""
    names = ["plain", "file:/a b/[x]=1%", "", None, "n'\u00e4"]
    out = f"file://{tmp_path}/out"
    frame = lambda nights, n, v: spark.createDataFrame([(x, i, [v] * i) for x in nights for i in range(n)][::-1], "night_id string, epoch_idx int, v array<double>")
    frame(names, 3, 1.0).write.partitionBy("night_id").parquet(out)  # by Spark's writer, in several files
    folders = {f.name for f in (tmp_path / "out").glob("night_id=*")}
    sinks.write_nights(frame(names[1:], 5, 2.0), out, only_these=True)
    assert {f.name for f in (tmp_path / "out").glob("night_id=*")} == folders
    read = lambda: sorted(((r.night_id or "", r.epoch_idx, r.v) for r in spark.read.schema("epoch_idx int, v array<double>, night_id string").parquet(out).collect()))
    assert read() == sorted([(x or "", i, [2.0] * i) for x in names[1:] for i in range(5)] + [("plain", i, [1.0] * i) for i in range(3)])
    for folder in folders - {"night_id=plain"}:
        assert [f.name for f in (tmp_path / "out" / folder).iterdir() if f.suffix == ".parquet"] == ["night.parquet"]
    again = spark.read.schema("epoch_idx int, v array<double>, night_id string").parquet(out).where("epoch_idx < 2")
    sinks.write_nights(again.select("night_id", "epoch_idx", "v"), out)  # read from what it replaces
    assert [r[:2] for r in read()] == sorted((x or "", i) for x in names for i in range(2))


def test_shorter_arrays_are_made_longer_where_files_are_written(spark, tmp_path):
    frame = spark.createDataFrame([("a", e, [float(e), -1.0]) for e in range(40)], "night_id string, epoch_idx int, X array<double>")
    done = sinks.write_edf(frame, f"file://{tmp_path}/out", ["X"], 2, {"X": -32768.0}, {"X": 32767.0}, make=lambda _, x: np.repeat(x, 10, axis=1)).collect()
    assert [(r.night_id, r.records) for r in done] == [("a", 400)]
    found = cells(recordings.blocks(recordings.catalog(recordings.listing(spark, f"file://{tmp_path}/out")), ["X"]))
    assert [list(r[4]) for r in sorted(found, key=lambda r: r[3])] == [[float(e)] * 10 + [-1.0] * 10 for e in range(40)]


def test_samples_do_not_meet_lengths_by_a_shuffle(spark, recorded):
    """Facts of a night are small tables; blocks stay where they were decoded, though they are larger than what is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20k")
        found = jobs.signal_epochs(recordings.listing(spark, f"file://{recorded}/raw/good"), setup(), f"file://{recorded}/work")
        plan = found.epochs._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Exchange hashpartitioning" not in plan


def test_norm_of_axes_of_differing_lengths(spark):
    data = [("n", c, 0, 1, v) for c, v in (("dX", [3.0, 1.0]), ("dY", [4.0, None]), ("dZ", [0.0, 2.0, 5.0]))] + [("n", c, 1, 1, [2.0, 6.0]) for c in ("dX", "dY", "dZ")]
    made = epochs.norm_of_epochs(spark.createDataFrame(data, "night_id string, channel string, epoch_idx int, fs int, samples array<double>"))
    assert {r.epoch_idx: r.samples for r in made.collect()} == {0: [5.0, None, None], 1: [12.0**0.5, 108.0**0.5]}


def test_small_ranges_share_a_task(spark, tmp_path):
    """150 files are read in no more tasks than there are slots, by both readers, with the rows of single ranges."""
    for i in range(150):
        put(tmp_path, f"n{i}/x.edf", night(30))
    found = recordings.catalog(recordings.listing(spark, f"file://{tmp_path}"))
    own = recordings.blocks(found, ["A", "B"], 300)
    recordings.register(spark)
    read = spark.read.format("edf").option("rangeBytes", 300).load(f"file://{tmp_path}")
    assert own.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism and read.rdd.getNumPartitions() <= 64
    one = cells(recordings.blocks(found.where("src_path LIKE '%/n0'"), ["A", "B"]))
    wanted = sorted((f"n{i}", *r[1:]) for i in range(150) for r in one)
    assert cells(own) == cells(read) == wanted


def shuffled(spark) -> int:
    """Bytes that all stages so far have written to shuffles."""
    spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = spark._jsc.sc().statusStore().stageList(None, False, False, spark._sc._gateway.new_array(spark._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


@pytest.fixture()
def long_night(spark, tmp_path):
    """A night of 600 epochs whose samples take 0.9 MB; tables are not broadcast by themselves."""
    put(tmp_path, "raw/n/x.edf", signal_file(6000, rates=dict.fromkeys(("A", "B", "X"), 16)))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield tmp_path
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


LONG = {"config": Config(rate=16)}


def test_recovery_shuffles_labels_only(spark, sf_dir):
    """job_filter_spiky: neither samples nor features are shuffled (a feature vector has 23 KB)."""
    registry.job_files(spark, sf_dir)
    before = shuffled(spark)
    n = sum(r.n_spiky for r in registry.job_filter_spiky(spark, sf_dir).collect())
    assert n and shuffled(spark) - before < 150_000


def test_recovery_is_that_of_separate_tables(spark, recorded):
    """In one pass over all channels of an epoch, or by tables that meet by night and epoch; also of resampled nights."""

    def by_digits(x):
        out = np.full((len(x), 4), 0.1)
        out[np.arange(len(x)), np.where(np.floor(x.sum(axis=1) * 100) % 2, 3, 0)] = 0.7
        return out

    own, work = setup(usability=by_digits), f"file://{recorded}/work"
    signal = jobs.signal_epochs(recordings.listing(spark, f"file://{recorded}/raw"), own, work)
    usability, rescored, recovery = jobs.recovered(signal, own, work, cutoff=2.0)
    eeg, _, acc = jobs.split_signals(signal.epochs, own)
    plain = signals.predict(jobs.features_of(eeg, acc, own), own.usability).select(*epochs.KEY, "label", "probs").cache()
    wanted = jobs.filter_spiky_epochs(eeg, acc, plain, own, cutoff=2.0)
    columns = (*epochs.KEY, "label")
    for found, other in ((usability.select(*columns, "probs"), plain.select(*columns, "probs")), (rescored.select(*columns), wanted[1].select(*columns)), (recovery, wanted[2])):
        assert rows(found) == rows(other) and found.count()
    assert sum(r.n_spiky for r in recovery.collect()) and rows(rescored.select(*columns)) != rows(usability.select(*columns))
    plain.unpersist()


def test_labels_shuffle_no_features(spark, long_night):
    """job_labels: 1,200 vectors of two spectrograms would be 27 MB; what is shuffled are labels."""
    own, work = setup(**LONG), f"file://{long_night}/work"
    before = shuffled(spark)
    found = jobs.signal_epochs(recordings.listing(spark, f"file://{long_night}/raw"), own, work)
    results = jobs.labelled(found, spark.createDataFrame([], "night_id string, epoch_idx int, stage int"), own, work)
    assert results.usability.count() == 1200 and results.mobility.count() == 600
    assert shuffled(spark) - before < 900_000


def test_samples_are_read_in_small_groups(spark, long_night):
    """job_written_outputs: a reader holds a group of rows at once, so groups are few rows."""
    import pyarrow.parquet as pq

    jobs.signal_epochs(recordings.listing(spark, f"file://{long_night}/raw"), setup(**LONG), f"file://{long_night}/work")
    files = [pq.ParquetFile(f).metadata for f in (long_night / "work/blocks").glob("*.parquet")]
    groups = [f.row_group(i).num_rows for f in files for i in range(f.num_row_groups)]
    assert max(groups) <= 256 and sum(groups) >= 600


def test_steps_of_a_job_leave_no_shuffle_files(spark, long_night):
    """job_night_statistics: shuffle files of a step are gone after it."""

    def names():
        found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size())}

    files, stages = recordings.listing(spark, f"file://{long_night}/raw"), spark.range(200).selectExpr(f"'file:{long_night}/raw/n' night_id", "int(id) epoch_idx", "int(id % 5) stage")
    before = names()
    found = jobs.night_statistics(files, stages, setup(**LONG), f"file://{long_night}/work")
    left = [n for n in names() - before if n.startswith("shuffle_") and n.endswith(".data")]
    assert found.statistics.count() == 1 and not left


def test_lines_become_files_without_a_shuffle(spark, tmp_path):
    """Lines that come by night and in order give the files that epochs give; a night that lies in two parts fails."""
    lines = spark.createDataFrame([(n, float(v), e) for n, e in (("a", 3), ("b", 1)) for v in range(e * 4)], "night_id string, X double, epochs int").coalesce(1)
    made = lambda _, x: np.repeat(x, 5, axis=1)
    frame = spark.createDataFrame([(n, i, [4.0 * i + k for k in range(4)]) for n, e in (("a", 3), ("b", 1)) for i in range(e)], "night_id string, epoch_idx int, X array<double>")
    range_ = {"X": -32768.0}, {"X": 32767.0}
    done = sinks.write_edf_of_lines(lines, 4, f"file://{tmp_path}/lines", ["X"], 2, *range_, make=made)
    assert "Exchange hash" not in done._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.night_id, r.records) for r in done.collect()) == [("a", 30), ("b", 10)]
    sinks.write_edf(frame, f"file://{tmp_path}/epochs", ["X"], 2, *range_, make=made).count()
    for n in "ab":
        assert (tmp_path / "lines" / n / "night.edf").read_bytes() == (tmp_path / "epochs" / n / "night.edf").read_bytes()
    with pytest.raises(Exception, match="of 30 records"):
        sinks.write_edf_of_lines(lines.where("night_id = 'a' AND X < 4"), 4, f"file://{tmp_path}/part", ["X"], 2, *range_, make=made).count()
