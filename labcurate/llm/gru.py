"""A bidirectional gated recurrent network in numpy: forward, backward through time, Adam.

Arrays are laid out (time, units, batch).  For each direction: z and r are the update and reset gates, n the candidate,
h = n + z * (h - n).  The gates use the piecewise linear sigmoid and the candidate the softsign, which cost a few vector
operations where exponentials would dominate the time of a scan over a large corpus.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

Params = dict[str, np.ndarray]


def gate(x: np.ndarray) -> np.ndarray:
    return np.clip(0.25 * x + 0.5, 0, 1)


def softsign(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def init(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale if scale is not None else 1 / np.sqrt(shape[-1]))).astype(np.float32)


def forward(pre: np.ndarray, u: np.ndarray, backwards: bool, keep: bool = True) -> tuple[np.ndarray, list]:
    """pre: (T, 3H, B), what the inputs add to z, r and n; u: (3H, H).  Returns the states (T, H, B) and what backward() needs."""
    steps, units, batch = pre.shape
    size = units // 3
    h = np.zeros((size, batch), np.float32)
    states, cache = np.empty((steps, size, batch), np.float32), [None] * steps
    for t in reversed(range(steps)) if backwards else range(steps):
        a = u @ h
        zr = gate(pre[t, : 2 * size] + a[: 2 * size])
        n = softsign(pre[t, 2 * size :] + zr[size:] * a[2 * size :])
        before = h
        h = n + zr[:size] * (h - n)
        states[t] = h
        if keep:
            cache[t] = (zr, n, a[2 * size :], before)
    return states, cache


def backward(grad: np.ndarray, cache: list, u: np.ndarray, backwards: bool) -> tuple[np.ndarray, np.ndarray]:
    """grad: of the loss by the states.  Returns the gradients by pre and by u."""
    steps, size, batch = grad.shape
    d_pre, d_u = np.empty((steps, 3 * size, batch), np.float32), np.zeros_like(u)
    d_h = np.zeros((size, batch), np.float32)
    for t in range(steps) if backwards else reversed(range(steps)):
        zr, n, an, before = cache[t]
        z, r = zr[:size], zr[size:]
        d_h = d_h + grad[t]
        open_gate = 0.25 * ((zr > 0) & (zr < 1))
        d_n = d_h * (1 - z) * (1 - np.abs(n)) ** 2
        d_z = d_h * (before - n) * open_gate[:size]
        d_r = d_n * an * open_gate[size:]
        d_pre[t, :size], d_pre[t, size : 2 * size], d_pre[t, 2 * size :] = d_z, d_r, d_n
        d_a = np.concatenate([d_z, d_r, d_n * r])
        d_u += d_a @ before.T
        d_h = d_h * z + u.T @ d_a
    return d_pre, d_u


def run(pre_of: Callable[[int, np.ndarray], object], steps: int, batch: int, u: np.ndarray, backwards: bool) -> np.ndarray:
    """forward() without what training needs.  pre_of(t, out) fills out, (3H, B).  Returns the states as (H, T, B)."""
    size = u.shape[1]
    u = u.copy()
    u[: 2 * size] *= 0.25  # the callers scale their inputs to the gates by as much
    h = np.zeros((size, batch), np.float32)
    states = np.empty((size, steps, batch), np.float32)
    pre, a, m = np.empty((3 * size, batch), np.float32), np.empty((3 * size, batch), np.float32), np.empty((size, batch), np.float32)
    zr, n = pre[: 2 * size], pre[2 * size :]
    for t in reversed(range(steps)) if backwards else range(steps):
        pre_of(t, pre)
        np.matmul(u, h, out=a)
        zr += a[: 2 * size]
        zr += 0.5
        np.clip(zr, 0, 1, out=zr)
        a[2 * size :] *= zr[size:]
        n += a[2 * size :]
        np.abs(n, out=m)
        m += 1
        n /= m
        h -= n
        h *= zr[:size]
        h += n
        states[:, t] = h
    return states


class Adam:
    def __init__(self, params: Params, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: Params, clip: float = 5.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = min(1.0, clip / (norm + 1e-9))
        for k, g in grads.items():
            g = g * scale
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            rate = self.rate * np.sqrt(1 - 0.999**self.t) / (1 - 0.9**self.t)
            self.params[k] -= rate * self.m[k] / (np.sqrt(self.v[k]) + 1e-7)
