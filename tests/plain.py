"""Estimators of one cell in plain numpy, written out row by row: what the engine's relations must reproduce."""

from __future__ import annotations

import numpy as np


def wls(y, x, w):
    return np.linalg.solve(x.T @ (x * w[:, None]), x.T @ (w * y))


def logit(d, x, w):
    g = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-x @ g))
        g = g + np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]), x.T @ (w * (d - p)))
    return 1 / (1 + np.exp(-x @ g))


def tilt(d, x, w):
    p = logit(d, x, w)
    g = np.linalg.lstsq(x, np.log(p / (1 - p)), rcond=None)[0]
    for _ in range(100):
        e = np.exp(x @ g)
        g = g + np.linalg.solve(x.T @ (x * (w * (1 - d) * e)[:, None]), x.T @ (w * (d - (1 - d) * e)))
    return 1 / (1 + np.exp(-x @ g))


def linear(y, x, w, fit):
    """Asymptotic linear representation of a weighted regression."""
    n = len(y)
    return (w * (y - fit))[:, None] * x @ np.linalg.inv(x.T @ (x * w[:, None]) / n)


def linear_logit(d, x, w, p):
    n = len(d)
    return (w * (d - p))[:, None] * x @ np.linalg.inv(x.T @ (x * (w * p * (1 - p))[:, None]) / n)


def hajek(w, r):
    return np.mean(w * r) / np.mean(w)


def panel(method, y, x, d, w):
    if method == "reg":
        m = x @ wls(y, x, w * (1 - d))
        a, w1 = linear(y, x, w * (1 - d), m), w * d
        e1, e0 = hajek(w1, y), hajek(w1, m)
        return e1 - e0, (w1 * (y - e1) - w1 * (m - e0) - a @ np.mean(w1[:, None] * x, axis=0)) / w1.mean()
    p = tilt(d, x, w) if method == "dr-ipt" else logit(d, x, w)
    odds = p / (1 - p)
    w1, w0 = w * d, w * (1 - d) * odds
    if method == "dr-ipt":
        m = x @ wls(y, x, w0)
        s = (1 - (1 - d) / (1 - p)) * (y - m)
        att = np.mean(w * s) / w1.mean()
        return att, w * (s - d * att) / w1.mean()
    g = linear_logit(d, x, w, p)
    if method == "ipw":
        att = (np.mean(w1 * y) - np.mean(w0 * y)) / w1.mean()
        return att, (w1 * y - w0 * y - g @ np.mean((w0 * y)[:, None] * x, axis=0) - w1 * att) / w1.mean()
    m = x @ wls(y, x, w * (1 - d)) if method == "dr" else np.zeros(len(y))
    r = y - m
    e1, e0 = hajek(w1, r), hajek(w0, r)
    one, two = w1 * (r - e1), w0 * (r - e0) + g @ np.mean((w0 * (r - e0))[:, None] * x, axis=0)
    if method == "dr":
        a = linear(y, x, w * (1 - d), m)
        one, two = one - a @ np.mean(w1[:, None] * x, axis=0), two - a @ np.mean(w0[:, None] * x, axis=0)
    return e1 - e0, one / w1.mean() - two / w0.mean()


def cross(method, y, x, d, w, t):
    on = {1: t, 0: 1 - t}
    mean = lambda v: np.mean(v[:, None] * x, axis=0)
    w1 = {s: w * d * on[s] for s in on}
    wd = w * d
    if method == "reg":
        att, psi, fit = 0.0, 0.0, {}
        for s, plus in ((1, 1), (0, -1)):
            c = w * (1 - d) * on[s]
            fit[s] = x @ wls(y, x, c)
            e = hajek(w1[s], y)
            att, psi = att + plus * e, psi + plus * (w1[s] * (y - e) / w1[s].mean() - linear(y, x, c, fit[s]) @ mean(wd) / wd.mean())
        e = hajek(wd, fit[1] - fit[0])
        return att - e, psi - wd * (fit[1] - fit[0] - e) / wd.mean()
    p = tilt(d, x, w) if method == "dr-ipt" else logit(d, x, w)
    w0 = {s: w * (1 - d) * p / (1 - p) * on[s] for s in on}
    g = linear_logit(d, x, w, p)
    if method == "ipw":
        lam = {s: np.mean(w * on[s]) for s in on}
        att, psi = 0.0, 0.0
        for s, plus in ((1, 1), (0, -1)):
            for arm, side in ((w1[s], 1), (w0[s], -1)):
                e = arm * y / (wd.mean() * lam[s])
                a = e.mean()
                att += plus * side * a
                psi = psi + plus * side * (e - a - (wd - wd.mean()) * a / wd.mean() - (w * on[s] - lam[s]) * a / lam[s])
            psi = psi + plus * (g @ -mean(w0[s] * y / (wd.mean() * lam[s])))
        return att, psi
    if method == "std_ipw":
        att, psi = 0.0, 0.0
        for s, plus in ((1, 1), (0, -1)):
            a, b = hajek(w1[s], y), hajek(w0[s], y)
            att += plus * (a - b)
            psi = psi + plus * (w1[s] * (y - a) / w1[s].mean() - w0[s] * (y - b) / w0[s].mean() - g @ mean(w0[s] * (y - b)) / w0[s].mean())
        return att, psi
    ipt = method == "dr-ipt"
    att, psi = 0.0, 0.0
    for s, plus in ((1, 1), (0, -1)):
        c = w * (1 - d) * on[s]
        m, h = x @ wls(y, x, w0[s] if ipt else c), x @ wls(y, x, w1[s])
        r = y - m
        a, b, all_, own = hajek(w1[s], r), hajek(w0[s], r), hajek(wd, h - m), hajek(w1[s], h - m)
        att += plus * (a - b + all_ - own)
        psi = psi + plus * (w1[s] * (r - a) / w1[s].mean() - w0[s] * (r - b) / w0[s].mean())
        psi = psi + plus * (wd * (h - m - all_) / wd.mean() - w1[s] * (h - m - own) / w1[s].mean())
        if not ipt:
            psi = psi - plus * (g @ mean(w0[s] * (r - b)) / w0[s].mean())
            ac, at = linear(y, x, c, m), linear(y, x, w1[s], h)
            # the regression's share in the means has one sign at both times
            psi = psi - ac @ (mean(w1[s]) / w1[s].mean() - mean(w0[s]) / w0[s].mean())
            psi = psi + plus * ((at - ac) @ (mean(wd) / wd.mean() - mean(w1[s]) / w1[s].mean()))
    return att, psi
