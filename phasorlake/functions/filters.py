"""Filters of one channel's samples: Butterworth band-pass, zero-phase filtering, the analytic signal."""

from __future__ import annotations

import numpy as np


def butter_bandpass(order: int, low: float, high: float, rate: float) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of the digital filter, by the bilinear transform of the analog prototype."""
    warp = 2 * rate * np.tan(np.pi * np.array([low, high]) / rate)
    width, centre = warp[1] - warp[0], np.sqrt(warp[0] * warp[1])
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    half = proto * width / 2
    root = np.sqrt(half**2 - centre**2)
    poles = np.concatenate([half + root, half - root])
    gain = width**order
    zeros = np.zeros(order)
    fs2 = 2 * rate
    digital_poles = (fs2 + poles) / (fs2 - poles)
    digital_zeros = np.concatenate([(fs2 + zeros) / (fs2 - zeros), -np.ones(order)])
    gain = gain * np.real(np.prod(fs2 - zeros) / np.prod(fs2 - poles))
    return np.real(gain * np.poly(digital_zeros)), np.real(np.poly(digital_poles))


def _steady(b: np.ndarray, a: np.ndarray) -> np.ndarray:
    """The filter's state after a long constant input of 1."""
    n = len(a) - 1
    companion = np.zeros((n, n))
    companion[:, 0] = -a[1:]
    companion[:-1, 1:] = np.eye(n - 1)
    return np.linalg.solve(np.eye(n) - companion, b[1:] - a[1:] * b[0])


def _run(b: np.ndarray, a: np.ndarray, x: np.ndarray, z: np.ndarray) -> np.ndarray:
    out, z = np.empty_like(x), z.copy()
    for i, v in enumerate(x):
        y = b[0] * v + z[0]
        z[:-1] = z[1:]
        z[-1] = 0
        z += b[1:] * v - a[1:] * y
        out[i] = y
    return out


def filtfilt(b: np.ndarray, a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Forward and backward over an oddly reflected signal, so phases stay."""
    pad = 3 * max(len(a), len(b))
    if len(x) <= pad:
        raise ValueError(f"a signal of more than {pad} samples is needed")
    z = _steady(b, a)
    ext = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]])
    once = _run(b, a, ext, z * ext[0])
    twice = _run(b, a, once[::-1], z * once[-1])[::-1]
    return twice[pad:-pad]


def reflected(x: np.ndarray, pad: int) -> np.ndarray:
    return np.pad(x, pad, mode="reflect")


def analytic(x: np.ndarray) -> np.ndarray:
    n = len(x)
    weight = np.zeros(n)
    weight[0] = 1
    weight[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        weight[n // 2] = 1
    return np.fft.ifft(np.fft.fft(x) * weight)
