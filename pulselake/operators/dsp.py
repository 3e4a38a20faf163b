"""Filters as numpy functions of one stretch of signal, applied to all stretches by Spark.

Zero-phase filters act in the frequency domain: a filter run forwards and backwards multiplies the spectrum by its
squared magnitude, which has a closed form after the bilinear transform, so no recursion over samples is needed.
Ends are extended by odd reflection.
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort

import numpy as np


def below_nyquist(fs: float, hz: float) -> float:
    hz = min(hz, 0.99 * fs / 2)
    if hz <= 0:
        raise ValueError("a cut-off has to be above zero")
    return hz


def zero_phase(x: np.ndarray, fs: float, gain, pad_s: float = 2.0) -> np.ndarray:
    """``x`` with each frequency multiplied by ``gain(f)``."""
    n = len(x)
    if n < 4:
        return x - x.mean() if n else x
    pad = min(n - 1, int(pad_s * fs))
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    size = 1 << (len(wide) - 1).bit_length()
    spectrum = np.fft.rfft(wide, size) * gain(np.fft.rfftfreq(size, 1 / fs))
    return np.fft.irfft(spectrum, size)[pad : pad + n]


def _warp(f: np.ndarray, fs: float) -> np.ndarray:
    return np.tan(np.pi * np.minimum(f, fs / 2 * (1 - 1e-9)) / fs)


def lowpass_gain(fs: float, cut: float, order: int):
    edge = np.tan(np.pi * below_nyquist(fs, cut) / fs)
    return lambda f: 1 / (1 + (_warp(f, fs) / edge) ** (2 * order))


def highpass_gain(fs: float, cut: float, order: int):
    edge = np.tan(np.pi * below_nyquist(fs, cut) / fs)
    return lambda f: 1 - 1 / (1 + (_warp(f, fs) / edge) ** (2 * order))


def bandpass_gain(fs: float, low: float, high: float, order: int):
    low, high = below_nyquist(fs, low), below_nyquist(fs, high)
    if low >= high:
        raise ValueError("the lower edge has to be below the upper one")
    a, b = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)

    def gain(f):
        w = np.maximum(_warp(f, fs), 1e-12)
        return 1 / (1 + ((w * w - a * b) / (w * (b - a))) ** (2 * order))

    return gain


def notch_gain(fs: float, hz: float, q: float):
    centre = np.tan(np.pi * hz / fs)

    def gain(f):
        w = _warp(f, fs)
        stop = (w * w - centre * centre) ** 2
        return stop / np.maximum(stop + (w * centre / q) ** 2, 1e-300)

    return gain


def bandpass(x, fs, low=0.5, high=40.0, order=4):
    return zero_phase(x, fs, bandpass_gain(fs, low, high, order))


def highpass(x, fs, cut=0.5, order=4):
    return zero_phase(x, fs, highpass_gain(fs, cut, order))


def notch(x, fs, hz=60.0, q=30.0, harmonics=1):
    for k in range(1, harmonics + 1):
        if hz * k < 0.99 * fs / 2:
            x = zero_phase(x, fs, notch_gain(fs, hz * k, q))
    return x


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Median of ``size`` (odd) samples around each, zeros beyond the ends. The window is kept in order: a step takes one
    sample out and puts one in, both found by bisection."""
    half = size // 2
    values = np.pad(np.asarray(x, float), half).tolist()
    window = sorted(values[:size])
    out = np.empty(len(x))
    for i in range(len(x)):
        out[i] = window[half]
        if i + size < len(values):
            del window[bisect_left(window, values[i])]
            insort(window, values[i + size])
    return out


def odd(n: float) -> int:
    n = max(3, int(n))
    return n + 1 - n % 2


def remove_baseline(x, fs):
    return x - running_median(running_median(x, odd(0.2 * fs)), odd(0.6 * fs))


def preprocess(x, fs, low=0.5, high=40.0, powerline=60.0, baseline="highpass"):
    if baseline not in ("highpass", "median"):
        raise ValueError(f"unknown baseline method {baseline!r}")
    x = remove_baseline(x, fs) if baseline == "median" else highpass(x, fs, low)
    return zero_phase(notch(x, fs, powerline), fs, lowpass_gain(fs, high, 4))


def ratio_of(fs: float, target: float) -> tuple[int, int]:
    """Whole factors up and down between two rates, which are rounded to whole Hertz."""
    up, down = max(1, round(target)), max(1, round(fs))
    shared = math.gcd(up, down)
    return up // shared, down // shared


def polyphase(x: np.ndarray, first: int, at: np.ndarray, up: int, down: int) -> np.ndarray:
    """Samples ``at`` (numbered at the new rate) of a signal whose part from sample ``first`` on is ``x``, zero elsewhere:
    a Kaiser-windowed sinc of ten periods to each side, read where the wanted sample lies between the given ones."""
    wide = max(up, down)
    half = 10 * wide
    kernel = np.sinc(np.arange(-half, half + 1) / wide) * np.kaiser(2 * half + 1, 5.0)
    kernel *= up / kernel.sum()
    fine = at * down
    source = -((half - fine) // up)[:, None] + np.arange(2 * half // up + 1)
    tap = fine[:, None] - source * up + half
    inside = (tap >= 0) & (tap <= 2 * half) & (source >= first) & (source < first + len(x))
    taken = np.where(inside, x[np.clip(source - first, 0, len(x) - 1)], 0.0) * kernel[np.clip(tap, 0, 2 * half)]
    return taken.sum(axis=1)


def resample(x: np.ndarray, fs: float, target: float) -> np.ndarray:
    """``x`` at another rate, rounded to whole Hertz, as many samples as the ratio of the rates asks for."""
    if fs == target or len(x) < 2:
        return x
    up, down = ratio_of(fs, target)
    return polyphase(x, 0, np.arange(round(len(x) * target / fs)), up, down)


def stages(x: np.ndarray, fs: float) -> dict[str, np.ndarray]:
    """Band-passed signal, its slope, the slope's square and its moving average over 150 ms."""
    banded = bandpass(x, fs, 5.0, 15.0, 3) if len(x) >= 4 else x - x.mean()
    slope = np.gradient(banded) * fs if len(x) > 1 else np.zeros_like(x)
    squared = slope * slope
    width = max(1, int(round(0.15 * fs)))
    return {"bandpassed": banded, "slope": slope, "squared": squared, "integrated": np.convolve(squared, np.full(width, 1 / width), "same")[: len(x)]}
