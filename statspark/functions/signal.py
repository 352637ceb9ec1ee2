"""Low-pass filters for decimation: Chebyshev type I sections and Hamming-windowed FIR."""

from __future__ import annotations

import math

import numpy as np

ORDER, RIPPLE_DB, CUT = 8, 0.05, 0.8


def chebyshev_sections(cut: float, order: int = ORDER, ripple_db: float = RIPPLE_DB) -> np.ndarray:
    """Second-order sections [b0 b1 b2 1 a1 a2] of a digital type I low-pass; ``cut`` is relative to half the rate."""
    ripple = math.sqrt(10 ** (0.1 * ripple_db) - 1)
    spread = math.asinh(1 / ripple) / order
    angle = math.pi * np.arange(-order + 1, order, 2) / (2 * order)
    poles = -np.sinh(spread + 1j * angle)
    gain = np.prod(-poles).real / (math.sqrt(1 + ripple**2) if order % 2 == 0 else 1.0)
    warped = 4 * math.tan(math.pi * cut / 2)
    poles, gain = poles * warped, gain * warped**order
    gain *= (1 / np.prod(4 - poles)).real
    digital = (4 + poles) / (4 - poles)
    upper = sorted(digital[digital.imag > 1e-12], key=abs)
    sections = np.array([[1.0, 2.0, 1.0, 1.0, -2 * p.real, abs(p) ** 2] for p in upper])
    sections[0, :3] *= gain
    return sections


def steady_state(sections: np.ndarray) -> np.ndarray:
    """States that keep a constant unit input constant."""
    out, level = np.zeros((len(sections), 2)), 1.0
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections):
        y = (b0 + b1 + b2) / (1 + a1 + a2)
        z2 = b2 - a2 * y
        out[i] = level * (b1 - a1 * y + z2), level * z2
        level *= y
    return out


def run_sections(sections: np.ndarray, x: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
    values = x.tolist()
    for i, (b0, b1, b2, _, a1, a2) in enumerate(sections.tolist()):
        z1, z2 = (0.0, 0.0) if state is None else state[i]
        for n, v in enumerate(values):
            y = b0 * v + z1
            z1, z2 = b1 * v - a1 * y + z2, b2 * v - a2 * y
            values[n] = y
    return np.array(values)


def forward_backward(sections: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Zero-phase filtering with odd extensions at both ends."""
    pad = min(3 * (2 * len(sections) + 1), len(x) - 1)
    wide = np.concatenate([2 * x[0] - x[pad:0:-1], x, 2 * x[-1] - x[-2 : -pad - 2 : -1]]) if pad else x
    start = steady_state(sections)
    y = run_sections(sections, wide, start * wide[0])
    y = run_sections(sections, y[::-1], start * y[-1])[::-1]
    return y[pad : len(y) - pad] if pad else y


def fir_taps(factor: int) -> np.ndarray:
    half = 10 * factor
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / factor) / factor * (0.54 + 0.46 * np.cos(np.pi * n / half))
    return taps / taps.sum()


def filtered(x: np.ndarray, factor: int, kind: str, zero_phase: bool) -> np.ndarray:
    """The low-passed series at full rate."""
    if kind == "fir":
        taps = fir_taps(factor)
        whole = np.convolve(x, taps)
        return whole[10 * factor : 10 * factor + len(x)] if zero_phase else whole[: len(x)]
    sections = chebyshev_sections(CUT / factor)
    return forward_backward(sections, x) if zero_phase else run_sections(sections, x)
