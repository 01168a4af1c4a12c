"""Statistical (36), temporal (18) and spectral (336) features of many epochs at once: rows of a matrix are epochs.

The set follows the public description of a common time-series feature library; formulas are stated here, and
bit-equality with that library is not claimed.
"""

from __future__ import annotations

import numpy as np

STATISTICAL = (
    [f"ecdf_{i}" for i in range(10)] + ["ecdf_percentile_0.2", "ecdf_percentile_0.8", "ecdf_count_0.2", "ecdf_count_0.8"] + [f"histogram_{i}" for i in range(10)]
    + ["interquartile_range", "kurtosis", "max", "mean", "mean_abs_deviation", "median", "median_abs_deviation", "min", "rms", "skewness", "std", "variance"]
)
TEMPORAL = ["absolute_energy", "area_under_curve", "autocorrelation", "centroid", "entropy", "mean_abs_diff", "mean_diff", "median_abs_diff", "median_diff", "negative_turning", "neighbourhood_peaks", "peak_to_peak", "positive_turning", "distance", "slope", "sum_abs_diff", "total_energy", "zero_crossings"]


def divided(a, b):
    """a / b, and 0 where b is 0."""
    return np.divide(a, b, out=np.zeros(np.broadcast(a, b).shape), where=b != 0)


def statistical(x: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, 36], in the order of STATISTICAL.

    ECDF: the steps 1/n to 10/n. Percentile p: the sorted value of place ceil(p n); count p: that place. Histogram:
    ten equal bins between minimum and maximum, as counts over n times the bin's width. Moments are of the population.
    """
    n = x.shape[1]
    s = np.sort(x, axis=1)
    mean, low, high = x.mean(axis=1), s[:, 0], s[:, -1]
    c = x - mean[:, None]
    var = (c**2).mean(axis=1)
    std = np.sqrt(var)
    places = [max(int(np.ceil(p * n)) - 1, 0) for p in (0.2, 0.8)]
    q25, median, q75 = np.percentile(x, [25, 50, 75], axis=1)
    width = (high - low) / 10
    bin_ = np.clip(divided(x - low[:, None], width[:, None]).astype(int), 0, 9)
    counts = np.stack([(bin_ == i).sum(axis=1) for i in range(10)], axis=1)
    return np.column_stack([
        np.repeat([(np.minimum(np.arange(10), n - 1) + 1) / n], len(x), axis=0), s[:, places[0]], s[:, places[1]], np.repeat([[p + 1.0 for p in places]], len(x), axis=0),
        divided(counts, n * width[:, None]), q75 - q25, divided((c**4).mean(axis=1), var**2) - 3 * (var != 0), high, mean, np.abs(c).mean(axis=1), median,
        np.median(np.abs(x - median[:, None]), axis=1), low, np.sqrt((x**2).mean(axis=1)), divided((c**3).mean(axis=1), std**3), std, var,
    ])


def temporal(x: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, 18], in the order of TEMPORAL.

    Autocorrelation: the first lag at which it falls to 1/e. Centroid: the energy-weighted mean time. Entropy: of the
    energy's shares, over its largest value. Neighbourhood peaks: larger than ten samples on either side. Turning
    points: changes of the sign of the slope. Slope: least squares over the sample number.
    """
    n = x.shape[1]
    d, t = np.diff(x, axis=1), np.arange(n) / fs
    energy = x**2
    total = energy.sum(axis=1)
    p = divided(energy, total[:, None])
    entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1) / np.log2(n)
    c = x - x.mean(axis=1, keepdims=True)
    spectrum = np.fft.rfft(c, 2 * n, axis=1)
    ac = np.fft.irfft(np.abs(spectrum) ** 2, axis=1)[:, :n]
    fallen = divided(ac, ac[:, :1]) <= np.exp(-1)
    lag = np.where(fallen.any(axis=1), fallen.argmax(axis=1), 0)
    up, down = d[:, :-1] > 0, d[:, 1:] > 0
    peaks = np.zeros(len(x))
    if n > 20:
        w = np.lib.stride_tricks.sliding_window_view(x, 21, axis=1)
        peaks = ((w[:, :, 10:11] > w[:, :, :10]).all(axis=2) & (w[:, :, 10:11] > w[:, :, 11:]).all(axis=2)).sum(axis=1)
    k = np.arange(n) - (n - 1) / 2
    sign = np.signbit(x)
    return np.column_stack([
        total, np.abs(x[:, :-1] + x[:, 1:]).sum(axis=1) / (2 * fs), lag, divided((t * energy).sum(axis=1), total), entropy, np.abs(d).mean(axis=1), d.mean(axis=1),
        np.median(np.abs(d), axis=1), np.median(d, axis=1), (~up & down & (d[:, :-1] < 0)).sum(axis=1), peaks, np.ptp(x, axis=1), (up & (d[:, 1:] < 0)).sum(axis=1),
        np.sqrt(1 + d**2).sum(axis=1), (c @ k) / (k @ k), np.abs(d).sum(axis=1), total / (t[-1] if n > 1 else 1), (sign[:, 1:] != sign[:, :-1]).sum(axis=1),
    ])


def _mel(fs: float, bins: int, filters: int = 40) -> np.ndarray:
    """Triangular filters at equal steps of the mel scale, over bins of a spectrum up to fs / 2."""
    top = 2595 * np.log10(1 + fs / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, filters + 2) / 2595) - 1)
    f = np.linspace(0, fs / 2, bins)
    a, b, c = edges[:-2, None], edges[1:-1, None], edges[2:, None]
    return np.maximum(0, np.minimum((f - a) / (b - a), (c - f) / (c - b)))


def _cepstra(x: np.ndarray, fs: float, count: int = 12) -> np.ndarray:
    """Mel cepstra of pre-emphasised 512-point frames, averaged over frames: the DCT of log filter energies, 1 to count."""
    y = np.concatenate([x[:, :1], x[:, 1:] - 0.97 * x[:, :-1]], axis=1)
    size = min(512, y.shape[1])
    frames = np.lib.stride_tricks.sliding_window_view(y, size, axis=1)[:, :: max(size // 2, 1)] * np.hamming(size)
    power = np.abs(np.fft.rfft(frames, 512, axis=2)) ** 2 / 512
    logs = np.log(np.maximum(power @ _mel(fs, power.shape[2]).T, 1e-12)).mean(axis=1)
    k = np.arange(1, count + 1)[:, None] * (np.arange(40) + 0.5)
    return logs @ np.cos(np.pi * k / 40).T


def _linear_prediction(x: np.ndarray, order: int = 12) -> np.ndarray:
    """Cepstra 0 to order of the all-pole model, by the Levinson recursion on the autocorrelation."""
    r = np.stack([(x[:, : x.shape[1] - k] * x[:, k:]).sum(axis=1) for k in range(order + 1)], axis=1)
    a, error = np.zeros((len(x), order + 1)), r[:, 0].copy()
    a[:, 0] = 1
    for i in range(1, order + 1):
        k = -divided((a[:, :i] * r[:, i:0:-1]).sum(axis=1), error)
        before = a.copy()
        for j in range(1, i + 1):
            a[:, j] = before[:, j] + k * before[:, i - j]
        error = error * (1 - k**2)
    c = np.zeros((len(x), order + 1))
    c[:, 0] = np.log(np.maximum(error, 1e-12))
    for n in range(1, order + 1):
        c[:, n] = -a[:, n] - sum(j / n * c[:, j] * a[:, n - j] for j in range(1, n))
    return c


def _wavelets(x: np.ndarray) -> np.ndarray:
    """Convolutions with the second derivative of a Gaussian (Ricker) at scales 1 to 9: mean of magnitudes, energy,
    deviation, variance of each scale, and the entropy of the energies' shares."""
    n = x.shape[1]
    out = []
    size = 1 << int(np.ceil(np.log2(n + 90)))
    spectrum = np.fft.rfft(x, size, axis=1)
    for scale in range(1, 10):
        t = np.arange(-5 * scale, 5 * scale + 1) / scale
        kernel = 2 / (np.sqrt(3 * scale) * np.pi**0.25) * (1 - t**2) * np.exp(-(t**2) / 2)
        out.append(np.fft.irfft(spectrum * np.fft.rfft(kernel, size), size, axis=1)[:, 5 * scale : 5 * scale + n])
    w = np.stack(out, axis=1)
    energy = (w**2).sum(axis=2)
    p = divided(energy, energy.sum(axis=1, keepdims=True))
    entropy = -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1)
    return np.column_stack([np.abs(w).mean(axis=2), energy, w.std(axis=2), w.var(axis=2), entropy])


def spectral(x: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, 336]: 256 mean FFT coefficients, 13 + 12 cepstra, 37 wavelet, 6 fundamental and 12 shape features.

    FFT means: densities of 256-bin spectra over half-overlapping segments of 510 points. Of the amplitude spectrum: the
    fundamental (largest, without 0 Hz), the share of energy in 0.6 to 2.5 Hz, the largest density, the frequencies
    below which 95 % and 50 % of it lie, and the width between 2.5 % and 97.5 %; then centroid, decrease, distance
    (from a straight cumulative sum), entropy, kurtosis, turning points, roll-off (95 %), roll-on (5 %), skewness,
    slope, spread and variation (1 - correlation of neighbouring bins).
    """
    n = x.shape[1]
    size = min(510, n)
    frames = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, :: max(size // 2, 1)]
    means = (np.abs(np.fft.rfft(frames - frames.mean(axis=2, keepdims=True), 510, axis=2)) ** 2 / (fs * size)).mean(axis=1)
    amplitude, f = np.abs(np.fft.rfft(x, axis=1)), np.fft.rfftfreq(n, 1 / fs)
    power = amplitude**2
    total, mass = power.sum(axis=1), amplitude.sum(axis=1)
    cumulative = divided(np.cumsum(power, axis=1), total[:, None])
    level = lambda share: f[np.minimum((cumulative < share).sum(axis=1), len(f) - 1)]
    share = divided(amplitude, mass[:, None])
    centroid = share @ f
    off = f - centroid[:, None]
    spread = np.sqrt((share * off**2).sum(axis=1))
    human = divided(power[:, (f >= 0.6) & (f <= 2.5)].sum(axis=1), total)
    p = divided(power, total[:, None])
    steps = np.diff(amplitude, axis=1)
    sums = np.cumsum(amplitude, axis=1)
    straight = np.linspace(0, 1, amplitude.shape[1]) * sums[:, -1:]
    fc = f - f.mean()
    a, b = amplitude[:, :-1], amplitude[:, 1:]
    rest = amplitude[:, 1:].sum(axis=1)
    fundamental = [f[amplitude[:, 1:].argmax(axis=1) + 1], human, power.max(axis=1) / (fs * n), level(0.95), level(0.5), level(0.975) - level(0.025)]
    shape = [
        centroid, divided((steps.cumsum(axis=1) / np.arange(1, steps.shape[1] + 1)).sum(axis=1), rest), (straight - sums).sum(axis=1),
        -np.where(p > 0, p * np.log2(np.where(p > 0, p, 1)), 0).sum(axis=1) / np.log2(len(f)), divided((share * off**4).sum(axis=1), spread**4),
        ((steps[:, :-1] > 0) & (steps[:, 1:] < 0)).sum(axis=1), level(0.95), level(0.05), divided((share * off**3).sum(axis=1), spread**3), (amplitude @ fc) / (fc @ fc), spread,
        1 - divided((a * b).sum(axis=1), np.sqrt((a**2).sum(axis=1) * (b**2).sum(axis=1))),
    ]
    return np.column_stack([means, _linear_prediction(x), _cepstra(x, fs), _wavelets(x), *fundamental, *shape])


def all_features(x: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, 390]: statistical, temporal, spectral."""
    return np.column_stack([statistical(x, fs), temporal(x, fs), spectral(x, fs)])
