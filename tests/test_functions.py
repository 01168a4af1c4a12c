"""The numpy helpers against analytic expectations."""

import numpy as np
import pytest

from noctua.functions import features, filters, spectral
from noctua.functions.config import Config

T = np.arange(2560) / 256


def sine(f):
    return np.sin(2 * np.pi * f * T)[None]


@pytest.mark.parametrize("f", [2, 8, 31, 100])
def test_spectra_peak_at_the_sine(f):
    assert spectral.welch(sine(f), 256).argmax() == f
    spec = spectral.spectrogram(sine(f), 256).reshape(11, 129)
    assert (spec.argmax(axis=1) == f).all()


def test_power_is_that_of_the_sine():
    assert spectral.welch(3 * sine(20), 256).sum() == pytest.approx(4.5, rel=1e-3)


def test_constant_signal_has_no_spectrum():
    assert np.abs(spectral.spectrogram(np.ones((2, 2560)), 256)).max() == 0
    assert spectral.spectrogram(np.ones((2, 640)), 64).shape == (2, 1419)


def test_windows_are_periodic():
    assert spectral.hann(4) == pytest.approx([0, 0.5, 1, 0.5])
    assert spectral.tukey(256)[0] == 0 and spectral.tukey(256)[128] == 1
    assert spectral.tukey(256)[1:] == pytest.approx(spectral.tukey(256)[:0:-1])


@pytest.mark.parametrize("n", [2, 3, 4, 5, 6, 7, 40])
def test_splines_reproduce_polynomials(n):
    def p(u):
        return sum(c * u**k for k, c in enumerate((1, 2, -0.3, 0.01)[: min(n, 4)]))

    at = np.linspace(0, n - 0.5, 33)  # past the last sample too
    assert spectral.spline(p(np.arange(float(n)))[None], at)[0] == pytest.approx(p(at))


def test_low_pass():
    slow, fast = sine(2), sine(60)
    assert np.abs(filters.remove_spikes(slow, 256) - slow).max() < 0.01
    assert np.abs(filters.remove_spikes(fast, 256)[:, 50:-50]).max() < 0.01
    b, a = filters.butter_low(4, 30, 256)
    at = np.exp(-2j * np.pi * 30 / 256 * np.arange(5))
    assert abs(b @ at / (a @ at)) == pytest.approx(0.5**0.5) and b.sum() / a.sum() == pytest.approx(1)


def test_notch_acts_only_in_its_own_mode():
    x = sine(8)
    assert np.abs(filters.remove_spikes(x, 256) - x).max() < 0.02
    assert np.abs(filters.remove_spikes(x, 256, mode="bandwidth")[:, 400:-400]).max() < 0.01


def test_filter_keeps_constants_and_short_epochs():
    assert filters.remove_spikes(np.ones((2, 300)), 256) == pytest.approx(np.ones((2, 300)))
    assert (filters.remove_spikes(np.arange(5.0)[None], 256) == np.arange(5)).all()


def test_statistical_features_by_hand():
    x = np.array([[1.0, 3, 2, 2, 2]])
    f = dict(zip(features.STATISTICAL, features.statistical(x, 1)[0]))
    assert (f["max"], f["min"], f["mean"], f["median"]) == (3, 1, 2, 2)
    assert f["variance"] == pytest.approx(0.4) and f["rms"] == pytest.approx(4.4**0.5)
    assert f["skewness"] == 0 and f["kurtosis"] == pytest.approx(0.4 / 0.16 - 3)
    assert f["interquartile_range"] == 0 and f["mean_abs_deviation"] == pytest.approx(0.4)
    assert f["ecdf_0"] == 0.2 and f["ecdf_percentile_0.2"] == 1 and f["ecdf_percentile_0.8"] == 2
    assert [f[f"histogram_{i}"] for i in (0, 5, 9)] == pytest.approx([1, 3, 1])


def test_temporal_features_by_hand():
    x = np.array([[1.0, 3, 2, -2, 2]])
    f = dict(zip(features.TEMPORAL, features.temporal(x, 1)[0]))
    assert f["absolute_energy"] == 22 and f["peak_to_peak"] == 5 and f["sum_abs_diff"] == 11
    assert f["mean_diff"] == 0.25 and f["median_diff"] == 0.5 and f["zero_crossings"] == 2
    assert f["positive_turning"] == 1 and f["negative_turning"] == 1
    assert f["slope"] == pytest.approx(np.polyfit(range(5), x[0], 1)[0])


def test_widths_and_finite_values():
    assert len(features.STATISTICAL) == 36 and len(features.TEMPORAL) == 18
    for x, fs in ((np.random.default_rng(0).standard_normal((3, 2560)), 256), (np.ones((2, 640)), 64), (np.zeros((1, 100)), 10)):
        found = features.all_features(x, fs)
        assert found.shape == (len(x), 390) and np.isfinite(found).all()


def test_fundamental_frequency():
    assert features.spectral(sine(7), 256)[0, 256 + 25 + 37] == pytest.approx(7)


def test_settings_are_checked():
    with pytest.raises(ValueError):
        Config(sleep_len=25)
    assert Config().per_sleep == 3 and Config().least_run == 12
