"""Training by adaptive-moment gradient steps on the whole data's log-likelihood.

The gradient of every parameter follows from the sums of one expectation-maximisation pass: posteriors' weights and
weighted second moments. With G the gradient by a component's covariance C (or what stands for it),

    G = -u B C^-1 + v C^-1 S C^-1,   B the weight, S the moment, u and v constants of the family,

low-rank factors get 2 G M and noise levels the trace of G. So a step is one pass, as cheap as one of EM, and fits
share passes in the same way.

Steps are taken in free parameters: logarithms of pi, softplus of gamma, directions of any length; kappa and M are free
as they are. Of complex numbers both parts have moments of their own. Starts are natural parameters and so are results.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from .families import Family, Params
from .kernels import Fit, Sums
from .mixture import Mixture, em_ask, em_sums, growing

BETA1, BETA2, EPS = 0.9, 0.999, 1e-8


def softplus(v: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, v)


def unsoftplus(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    return v + np.log(-np.expm1(-v))


def soft(logits: np.ndarray) -> np.ndarray:
    """Distributions from logits, along the last axis."""
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def logits(p: np.ndarray) -> np.ndarray:
    return np.log(np.maximum(p, 1e-300))


def to_free(family: Family, theta: Params) -> Params:
    if family.rank == 0 and family.name != "Watson":
        raise ValueError("gradient training takes low-rank covariances")
    free = {n: np.array(v, complex if family.is_complex and n in ("mu", "M") else float) for n, v in theta.items()}
    free["pi"] = logits(free["pi"])
    if "gamma" in free:
        free["gamma"] = unsoftplus(free["gamma"].mean(keepdims=True) if family.tied_gamma else free["gamma"])
    return free


def to_natural(family: Family, free: Params) -> Params:
    theta = dict(free) | {"pi": soft(free["pi"])}
    if "mu" in free:
        theta["mu"] = free["mu"] / np.linalg.norm(free["mu"], axis=1, keepdims=True)
    if "gamma" in free:
        theta["gamma"] = np.broadcast_to(softplus(free["gamma"]), (len(free["M"]),)).copy()
    return theta


def emission(family: Family, free: Params, theta: Params, weight: np.ndarray, moment: np.ndarray) -> Params:
    """The gradients of a family's free parameters but pi, from the weights and moments under ``theta``."""
    if family.name == "Watson":
        out = {"mu": np.zeros_like(free["mu"]), "kappa": np.zeros_like(free["kappa"])}
        for k, (mu, kappa) in enumerate(zip(theta["mu"], theta["kappa"], strict=True)):
            pull = moment[k] @ mu
            along = float((mu.conj() @ pull).real)
            out["kappa"][k] = along - weight[k] * family.ratio(float(kappa))
            out["mu"][k] = 2 * kappa * (pull - mu * along) / np.linalg.norm(free["mu"][k])
        return out
    p, q, a, c = family.p, family.q, family.a, family.c
    u, v = {"ACG": (a, c), "MACG": (q / 2, p / 2), "SingularWishart": (q / 2, 0.5), "Normal": (a, a)}[family.name]
    out = {"M": np.zeros_like(free["M"])}
    level = np.zeros(len(weight))
    for k, m in enumerate(theta["M"]):
        gamma = theta["gamma"][k] if "gamma" in theta else 1.0
        inverse = np.linalg.inv(gamma * np.eye(p) + m @ m.conj().T)
        g = -u * weight[k] * inverse + v * inverse @ moment[k] @ inverse
        out["M"][k] = 2 * g @ m
        level[k] = float(np.trace(g).real)
    if "gamma" in free:
        slope = -np.expm1(-softplus(free["gamma"]))
        out["gamma"] = slope * (level.sum(keepdims=True) if family.tied_gamma else level)
    return out


class Adam:
    """Upward steps."""

    def __init__(self, lr: float):
        self.lr, self.t = lr, 0
        self.first: Params = {}
        self.second: Params = {}

    def step(self, free: Params, gradient: Params) -> Params:
        self.t += 1
        out = {}
        for name, value in free.items():
            if name not in gradient:
                out[name] = value
                continue
            g = np.ascontiguousarray(gradient[name], value.dtype).view(float)
            self.first[name] = BETA1 * self.first.get(name, 0.0) + (1 - BETA1) * g
            self.second[name] = BETA2 * self.second.get(name, 0.0) + (1 - BETA2) * g * g
            up = self.first[name] / (1 - BETA1**self.t) / (np.sqrt(self.second[name] / (1 - BETA2**self.t)) + EPS)
            out[name] = (np.ascontiguousarray(value).view(float) + self.lr * up).view(value.dtype)
        return out


class Plateau:
    """Whether to stop: as EM does, but that with ``decrease_lr_on_plateau`` the first time cuts the rate to a tenth."""

    def __init__(self, adam: Adam, tol: float, num_comparison: int, decrease_lr_on_plateau: bool):
        self.adam, self.tol, self.n, self.cut = adam, tol, num_comparison, decrease_lr_on_plateau

    def reached(self, curve: list[float]) -> bool:
        if len(curve) <= self.n:
            return False
        recent = curve[-self.n :]
        top = sorted(set(recent), reverse=True)
        if len(top) > 1 and (top[0] - top[1]) / abs(top[0]) >= self.tol and recent[-1] != min(recent):
            return False
        if self.cut:
            self.adam.lr, self.cut = self.adam.lr / 10, False
            return False
        return True


def climb(free: Params, natural: Callable[[Params], Params], sums: Callable[[Params], Fit], slope: Callable[[Params, Params, Sums], Params], lr: float, tol: float, max_iter: int, num_comparison: int, decrease_lr_on_plateau: bool) -> Fit:
    """The best natural parameters met, and the curve. ``sums``: a part of a fit that gives a pass's sums."""
    adam = Adam(lr)
    plateau = Plateau(adam, tol, num_comparison, decrease_lr_on_plateau)
    curve, best = [], natural(free)
    for _ in range(max_iter):
        theta = natural(free)
        got = yield from sums(theta)
        curve.append(float(np.ravel(got["loglik"])[0]))
        if np.isnan(curve[-1]):
            raise FloatingPointError("the log-likelihood is not a number")
        if curve[-1] == max(curve):
            best = theta
        free = adam.step(free, slope(free, theta, got))
        if plateau.reached(curve):
            break
    return best, curve


def training(family: Family, theta: Params, lr: float = 0.1, tol: float = 1e-8, max_iter: int = 100_000, num_comparison: int = 50, decrease_lr_on_plateau: bool = False) -> Fit:
    """A mixture trained by gradient steps from parameters, of lower rank too."""
    if family.rank and "M" in theta:
        theta = yield from growing(family, theta)

    def sums(theta: Params) -> Fit:
        return em_sums((yield em_ask(family, theta)), family)

    def slope(free: Params, theta: Params, got: Sums) -> Params:
        up = emission(family, free, theta, got["weight"], got["moment"])
        if len(theta["pi"]) > 1:
            up["pi"] = got["weight"] - got["weight"].sum() * theta["pi"]
        return up

    best, curve = yield from climb(to_free(family, theta), lambda free: to_natural(family, free), sums, slope, lr, tol, max_iter, num_comparison, decrease_lr_on_plateau)
    return Mixture(family, best, curve)
