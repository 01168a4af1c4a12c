"""Spectra of many epochs at once: rows of a matrix are epochs."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Points of an epoch that spectrogram features are made from.
POINTS = 2560
SEGMENT = 256


def tukey(n: int, share: float = 0.25) -> np.ndarray:
    """The periodic Tukey window: cosine flanks over a share of n, flat between."""
    x = np.arange(n) / n
    flank = share / 2
    rise = 0.5 * (1 - np.cos(np.pi * x / flank))
    fall = 0.5 * (1 - np.cos(np.pi * (1 - x) / flank))
    return np.where(x < flank, rise, np.where(x > 1 - flank, fall, 1.0))


def hann(n: int) -> np.ndarray:
    """The periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / n)


def densities(epochs: np.ndarray, fs: float, window: np.ndarray, step: int) -> np.ndarray:
    """[epoch, segment, frequency]: one-sided power density of mean-free windowed segments."""
    n = len(window)
    segments = np.lib.stride_tricks.sliding_window_view(epochs, n, axis=1)[:, ::step]
    segments = segments - segments.mean(axis=2, keepdims=True)
    power = np.abs(np.fft.rfft(segments * window, axis=2)) ** 2 / (fs * (window**2).sum())
    power[..., 1 : -1 if n % 2 == 0 else None] *= 2
    return power


def spectrogram(epochs: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, time * frequency] of epochs brought to POINTS points; 11 times of 129 frequencies, time-major."""
    points = epochs.shape[1]
    if points != POINTS:
        epochs = stretch(epochs, POINTS)
        fs = fs * POINTS / points
    power = densities(epochs, fs, tukey(SEGMENT), SEGMENT - SEGMENT // 8)
    return power.reshape(len(epochs), -1).astype(np.float32)


def welch(epochs: np.ndarray, fs: float) -> np.ndarray:
    """[epoch, frequency]: mean density over half-overlapping Hann segments, of 256 points or of all if there are fewer."""
    n = min(SEGMENT, epochs.shape[1])
    return densities(epochs, fs, hann(n), n - n // 2).mean(axis=1).astype(np.float32)


def stretch(rows: np.ndarray, points: int) -> np.ndarray:
    """Each row at so many equally spaced places between its first and last sample, by the cubic spline through it.

    A spline is linear in its samples: short rows are multiplied by the splines of single samples, worked out once.
    """
    n = rows.shape[1]
    return np.asarray(rows, float) @ _single(n, points) if n <= 512 else spline(rows, np.linspace(0, n - 1, points))


@lru_cache(8)
def _single(n: int, points: int) -> np.ndarray:
    return spline(np.eye(n), np.linspace(0, n - 1, points))


def spline(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Cubic not-a-knot splines through equally spaced samples, at given places; beyond the ends the last piece goes on.

    Second derivatives m solve m[i-1] + 4 m[i] + m[i+1] = 6 (y[i-1] - 2 y[i] + y[i+1]); not-a-knot ends make the third
    derivative pass the second and last but one sample unchanged, so m[0] = 2 m[1] - m[2], which leaves 6 m[1] alone.
    """
    rows = np.asarray(rows, float)
    n = rows.shape[1]
    if n == 1:
        return np.repeat(rows, len(at), axis=1)
    if n < 4:  # the polynomial through all points
        return np.stack([np.polyval(np.polyfit(np.arange(n), r, n - 1), at) for r in rows])
    bend = 6 * (rows[:, :-2] - 2 * rows[:, 1:-1] + rows[:, 2:])
    m = np.empty_like(rows)
    m[:, 1], m[:, -2] = bend[:, 0] / 6, bend[:, -1] / 6
    inner = bend[:, 1:-1].copy()
    if n > 4:
        inner[:, 0] -= m[:, 1]
        inner[:, -1] -= m[:, -2]
        ratio = np.empty(n - 4)
        ratio[0] = 1 / 4
        for i in range(1, n - 4):
            ratio[i] = 1 / (4 - ratio[i - 1])
            inner[:, i] -= ratio[i - 1] * inner[:, i - 1]
        inner[:, -1] *= ratio[-1]
        for i in range(n - 6, -1, -1):
            inner[:, i] = (inner[:, i] - inner[:, i + 1]) * ratio[i]
        m[:, 2:-2] = inner
    m[:, 0], m[:, -1] = 2 * m[:, 1] - m[:, 2], 2 * m[:, -2] - m[:, -3]
    i = np.clip(np.floor(at).astype(int), 0, n - 2)
    b = at - i
    a = 1 - b
    return a * rows[:, i] + b * rows[:, i + 1] + ((a**3 - a) * m[:, i] + (b**3 - b) * m[:, i + 1]) / 6


def display_power(epochs: np.ndarray, fs: float, tapers: np.ndarray | None = None, weights: np.ndarray | None = None, low: int = 3, high: int = 303) -> np.ndarray:
    """[epoch, bin]: power of whole epochs, as the weighted mean over tapers (default: one Hann taper), bins low to high - 1."""
    n = epochs.shape[1]
    tapers = hann(n)[None] if tapers is None else tapers
    weights = np.full(len(tapers), 1 / len(tapers)) if weights is None else weights
    power = sum(w * np.abs(np.fft.rfft(epochs * t, axis=1)) ** 2 / (fs * (t**2).sum()) for w, t in zip(weights, tapers))
    return power[:, low:high]


@lru_cache(8)
def slepian(n: int, half_bandwidth: float, count: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``count`` discrete prolate spheroidal sequences of n points, of length one, and their concentrations.

    Among sequences of n points these hold most of their energy within half_bandwidth / n of frequency zero. They are the
    eigenvectors of largest eigenvalues of a symmetric tridiagonal matrix that commutes with the problem's own: d[i] =
    ((n - 1 - 2 i) / 2)^2 cos(2 pi w), e[i] = i (n - i) / 2, w = half_bandwidth / n. Eigenvalues come from counting sign
    changes (bisection), eigenvectors from inverse iteration, concentrations from the sinc kernel by autocorrelation.
    """
    w = half_bandwidth / n
    d = ((n - 1 - 2 * np.arange(n)) / 2) ** 2 * np.cos(2 * np.pi * w)
    e = np.arange(1, n) * (n - np.arange(1, n)) / 2
    reach = np.abs(np.append(e, 0)) + np.abs(np.append(0, e))
    low, high = np.full(count, (d - reach).min()), np.full(count, (d + reach).max())
    rank = np.arange(count)  # the rank-th largest has that many above it
    squares, tiny = np.append(0, e**2), np.finfo(float).tiny
    for _ in range(80):
        middle = (low + high) / 2
        above, q = np.zeros(count, int), np.ones(count)
        for i in range(n):
            q = d[i] - middle - squares[i] / np.where(q == 0, tiny, q)
            above += q > 0
        more = above > rank
        low, high = np.where(more, middle, low), np.where(more, high, middle)
    out = np.empty((count, n))
    for k in range(count):
        x = np.sin(np.pi * (k + 1) * (np.arange(n) + 0.5) / n)  # of the symmetry that the k-th has
        shift = (low[k] + high[k]) / 2
        for _ in range(4):
            x = tridiagonal(d - shift, e, x)
            for other in out[:k]:
                x -= (other @ x) * other
            x /= np.sqrt(x @ x)
        out[k] = x * (np.sign(x.sum()) if k % 2 == 0 else np.sign(x @ ((n - 1) / 2 - np.arange(n))))
    size = 1 << (2 * n - 1).bit_length()
    kernel = np.append(2 * w, np.sin(2 * np.pi * w * np.arange(1, n)) / (np.pi * np.arange(1, n)))
    lags = np.fft.irfft(np.abs(np.fft.rfft(out, size)) ** 2, size)[:, :n]
    return out, lags[:, 0] * kernel[0] + 2 * lags[:, 1:] @ kernel[1:]


def tridiagonal(d: np.ndarray, e: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Solves the symmetric tridiagonal system by elimination with exchange of rows, so it may be nearly singular."""
    n = len(d)
    a, b, c, x = d.astype(float).copy(), np.append(e, 0.0), np.zeros(n), y.astype(float).copy()
    for i in range(n - 1):
        below, first, second = e[i], a[i + 1], b[i + 1]
        if abs(below) > abs(a[i]):
            a[i], below = below, a[i]
            b[i], first = first, b[i]
            c[i], second = second, 0.0
            x[i], x[i + 1] = x[i + 1], x[i]
        ratio = below / (a[i] or np.finfo(float).tiny)
        a[i + 1], b[i + 1] = first - ratio * b[i], second - ratio * c[i]
        x[i + 1] -= ratio * x[i]
    for i in range(n - 1, -1, -1):
        rest = (b[i] * x[i + 1] if i + 1 < n else 0.0) + (c[i] * x[i + 2] if i + 2 < n else 0.0)
        x[i] = (x[i] - rest) / (a[i] or np.finfo(float).eps * abs(d).max())
    return x
