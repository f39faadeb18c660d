"""Densities of the mixture families and the updates of their parameters.

A family sees data as sums: log densities of a batch for the E-step, weighted second moments for the
M-step. ACG and MACG weight each row by its current quadratic form: replacing ln of that form by its
tangent bounds the likelihood from below, the bound is a Gaussian one, and its best low-rank covariance
is known in closed form (leading eigenvectors, the mean of the other eigenvalues as noise), so each pass
raises the likelihood. Wishart and Normal families need one such step only.

Parameters of component k: Watson ``mu`` (p), ``kappa``; ACG, MACG ``M`` (p x r, covariance I + M M^H) or
``Psi`` (p x p, trace p); SingularWishart, Normal ``M`` and ``gamma`` (covariance gamma I + M M^H) or ``Psi``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from ..functions.special import kummer_ratio, log_kummer, log_sphere, solve_kummer

Params = dict[str, np.ndarray]


def low_rank(moment: np.ndarray, rank: int) -> tuple[np.ndarray, float]:
    """M and gamma of the best gamma I + M M^H for a second moment."""
    p = len(moment)
    values, vectors = np.linalg.eigh(moment)
    values, vectors = np.clip(values[::-1], 0, None), vectors[:, ::-1]
    gamma = float(values[rank:].mean()) if rank < p else float(values[-1]) * 0.5
    gamma = max(gamma, 1e-12 * max(values[0], 1e-300))
    return vectors[:, :rank] * np.sqrt(np.clip(values[:rank] - gamma, 0, None)), gamma


def seeded_low_rank(gram: np.ndarray, n: float, rank: int) -> tuple[np.ndarray, float]:
    """M and gamma from the singular values of a cluster's data: the mean of those left out is the noise."""
    p = len(gram)
    values, vectors = np.linalg.eigh(gram)
    s, u = np.sqrt(np.clip(values[::-1], 0, None)), vectors[:, ::-1]
    if rank >= p:
        return u * np.sqrt(s), 1.0
    noise = max(float(s[rank:].mean()), 1e-12)
    return u[:, :rank] * np.sqrt(np.clip(s[:rank] - noise, 0, None) / noise), noise / max(n, 1.0)


def covariance(theta: Params, k: int) -> np.ndarray:
    """The covariance that a component's parameters stand for; ACG families to trace p."""
    if "Psi" in theta:
        return theta["Psi"][k]
    m = theta["M"][k]
    if "gamma" in theta:
        return m @ m.conj().T + theta["gamma"][k] * np.eye(len(m))
    full = m @ m.conj().T + np.eye(len(m))
    return full * (len(m) / np.trace(full).real)


def squared(y: np.ndarray) -> np.ndarray:
    """The squares of absolute values."""
    return y.real**2 + y.imag**2 if np.iscomplexobj(y) else y**2


def gram(x: np.ndarray) -> np.ndarray:
    """The sum of x x^H over rows, as a symmetric product of real numbers: of the real and imaginary parts in turn."""
    if not np.iscomplexobj(x):
        return x.T @ x
    parts = np.ascontiguousarray(x).view(float)
    both = parts.T @ parts
    re, im = both[::2], both[1::2]
    return re[:, ::2] + im[:, 1::2] + 1j * (im[:, ::2] - re[:, 1::2])


def _turned(x: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    """The frames' columns in the coordinates w."""
    return [x[:, :, a] @ w for a in range(x.shape[2])]


def _grams(columns: list[np.ndarray]) -> np.ndarray:
    """(n, q, q): inner products of columns."""
    out = np.empty((len(columns[0]), len(columns), len(columns)))
    for a, one in enumerate(columns):
        for b in range(a, len(columns)):
            out[:, a, b] = out[:, b, a] = np.einsum("np,np->n", one, columns[b])
    return out


def _upright(columns: list[np.ndarray], form: np.ndarray, scale: np.ndarray) -> list[np.ndarray]:
    """Scaled combinations y of each row's columns whose sum of y y^H is that of x form^-1 x^H, by the triangle of the form."""
    low, out = np.linalg.cholesky(form), []
    for a, column in enumerate(columns):
        y = column * (scale / low[:, a, a])[:, None]
        for b, before in enumerate(out):
            y -= before * (low[:, a, b] / low[:, a, a])[:, None]
        out.append(y)
    return out


@dataclass
class Family:
    """``rank`` 0 is full rank. ``shape``: (p,) or (p, q)."""

    name: str
    shape: tuple[int, ...]
    is_complex: bool = False
    rank: int = 0
    tied_gamma: bool = False
    a: float = field(init=False)
    c: float = field(init=False)

    def __post_init__(self):
        if self.name not in ("Watson", "ACG", "MACG", "SingularWishart", "Normal"):
            raise ValueError(f"no such family: {self.name}")
        if (len(self.shape) == 2) != (self.name in ("MACG", "SingularWishart")):
            raise ValueError(f"{self.name} does not take observations of shape {self.shape}")
        if self.rank > self.p:
            raise ValueError("the rank exceeds the dimension")
        self.a, self.c = (1.0, float(self.p)) if self.is_complex else (0.5, self.p / 2)

    @property
    def p(self) -> int:
        return self.shape[0]

    @property
    def q(self) -> int:
        return self.shape[1] if len(self.shape) == 2 else 1

    # -- data ---------------------------------------------------------------------------------

    def check(self, x: np.ndarray) -> int:
        """Rows that aren't on the family's space."""
        if self.name in ("Watson", "ACG"):
            return int((~np.isclose((np.abs(x) ** 2).sum(1), 1)).sum())
        if self.name == "MACG":
            return int((~np.isclose((x[:, :, 0] ** 2).sum(1), 1)).sum())
        if self.name == "SingularWishart":
            return int((~np.isclose((x**2).sum((1, 2)), self.p)).sum())
        return 0

    # -- densities ----------------------------------------------------------------------------

    def _inverse(self, theta: Params, k: int) -> tuple[np.ndarray, float]:
        """W with covariance^-1 = W W^H, and the log determinant of the covariance. Low rank by the
        determinant and inversion lemmas, as a pair (M D^-1/2, gamma)."""
        values, vectors = np.linalg.eigh(theta["Psi"][k])
        return vectors / np.sqrt(values), float(np.log(values).sum())

    def _small(self, theta: Params, k: int) -> tuple[np.ndarray, float, float]:
        """M D^-1/2 / sqrt(gamma) with D = gamma I + M^H M, gamma, and the log determinant."""
        m = theta["M"][k]
        gamma = float(theta["gamma"][k]) if "gamma" in theta else 1.0
        values, vectors = np.linalg.eigh(gamma * np.eye(m.shape[1]) + m.conj().T @ m)
        return m @ (vectors / np.sqrt(values)), gamma, float((self.p - m.shape[1]) * math.log(gamma) + np.log(values).sum())

    def form(self, x: np.ndarray, theta: Params, k: int) -> tuple[np.ndarray, float]:
        """x^H covariance^-1 x of each row (for frames the q x q matrix), and the log determinant."""
        if "Psi" in theta:
            w, log_det = self._inverse(theta, k)
            if x.ndim == 3:
                return _grams(_turned(x, w)), log_det
            y = x @ w.conj()
            return (np.abs(y) ** 2).sum(1), log_det
        w, gamma, log_det = self._small(theta, k)
        if x.ndim == 2:
            y = x @ w.conj()
            return ((np.abs(x) ** 2).sum(1) - (np.abs(y) ** 2).sum(1)) / gamma, log_det
        return (_grams([x[:, :, a] for a in range(x.shape[2])]) - _grams(_turned(x, w))) / gamma, log_det

    def forms(self, x: np.ndarray, theta: Params) -> list[tuple[np.ndarray, float]] | None:
        """``form`` under each component; Watson has none."""
        return None if self.name == "Watson" else [self.form(x, theta, k) for k in range(len(theta["pi"]))]

    def log_pdf(self, x: np.ndarray, theta: Params, forms: list[tuple[np.ndarray, float]] | None = None) -> np.ndarray:
        """(n, K). ``forms``: those of the rows, where they are known."""
        forms = self.forms(x, theta) if forms is None else forms
        return np.stack([self._log_pdf(x, theta, k, forms and forms[k]) for k in range(len(theta["pi"]))], 1)

    def _log_pdf(self, x: np.ndarray, theta: Params, k: int, known: tuple[np.ndarray, float] | None) -> np.ndarray:
        p, q, a, c = self.p, self.q, self.a, self.c
        if self.name == "Watson":
            kappa = float(theta["kappa"][k])
            return log_sphere(p, self.is_complex) - log_kummer(a, c, kappa) + kappa * squared(x @ theta["mu"][k].conj())
        form, log_det = known
        if self.name == "ACG":
            return log_sphere(p, self.is_complex) - a * log_det - c * np.log(form)
        if self.name == "MACG":
            return -q / 2 * log_det - p / 2 * np.linalg.slogdet(form)[1]
        if self.name == "Normal":
            return -c * math.log(math.pi / a) - a * log_det - a * form
        out = self.wishart_constant() - q / 2 * log_det - np.trace(form, axis1=1, axis2=2) / 2
        if "Psi" in theta:  # at full rank the data's own factor is left out, the same for all components
            return out
        head = x[:, :q]
        return out + (q - p - 1) / 2 * np.linalg.slogdet(np.einsum("npq,nps->nqs", head, head))[1]

    def wishart_constant(self) -> float:
        p, q = self.p, self.q
        gammas = q * (q - 1) / 4 * math.log(math.pi) + sum(math.lgamma(q - j / 2) for j in range(q))
        return q * (q - p) / 2 * math.log(math.pi) - p * q / 2 * math.log(2) - gammas

    # -- sums ---------------------------------------------------------------------------------

    def moments(self, x: np.ndarray, beta: np.ndarray, inner: Params | None, forms: list[tuple[np.ndarray, float]] | None = None) -> np.ndarray:
        """(K, p, p): sums of beta x W x^H, where W is the inverse of the row's form for ACG and MACG (with
        ``inner``), the unit elsewhere. ``forms``: those under ``inner``, where they are known."""
        form = lambda k: (forms[k] if forms else self.form(x, inner, k))[0]
        out = []
        for k in range(beta.shape[1]):
            if x.ndim == 2:
                w = beta[:, k]
                if inner is not None and self.name == "ACG":
                    w = w / form(k)
                out.append(gram(x * np.sqrt(w)[:, None]))
                continue
            columns, root = [x[:, :, a] for a in range(x.shape[2])], np.sqrt(beta[:, k])
            if inner is None or self.name != "MACG":
                out.append(sum(gram(c * root[:, None]) for c in columns))
                continue
            try:
                out.append(sum(gram(y) for y in _upright(columns, form(k), root)))
            except np.linalg.LinAlgError:  # rounding has left a form that is not definite
                inverse = np.linalg.inv(form(k))
                left = [sum(c * inverse[:, a, b, None] for a, c in enumerate(columns)) for b in range(len(columns))]
                out.append(sum((one * beta[:, k, None]).T @ c for one, c in zip(left, columns, strict=True)))
        return np.stack(out)

    def finish(self, moment: np.ndarray, weight: np.ndarray, old: Params | None) -> Params:
        """Parameters but pi from the moments and the sums of beta; a component without weight keeps its
        own."""
        k = len(weight)
        out: dict[str, list] = {}
        for j in range(k):
            if weight[j] <= 1e-12 and old is not None:
                one = {name: value[j] for name, value in old.items() if name != "pi"}
            else:
                one = self._finish(moment[j] / weight[j], old["kappa"][j] if old is not None and "kappa" in old else None)
            for name, value in one.items():
                out.setdefault(name, []).append(value)
        theta = {name: np.stack(values) for name, values in out.items()}
        if self.tied_gamma and "gamma" in theta:
            theta["gamma"] = np.full(k, (theta["gamma"] * weight).sum() / weight.sum())
        return theta

    def _finish(self, moment: np.ndarray, _kappa: float | None) -> Params:
        if self.name == "Watson":
            return self._watson(moment)
        scale = {"ACG": self.p, "MACG": self.p / self.q, "SingularWishart": 1 / self.q, "Normal": 1.0}[self.name]
        moment = (moment + moment.conj().T) / 2 * scale
        if self.rank == 0:
            if self.name in ("ACG", "MACG"):
                moment = moment * (self.p / np.trace(moment).real)
            return {"Psi": moment}
        m, gamma = low_rank(moment, self.rank)
        if self.name in ("ACG", "MACG"):
            return {"M": m / math.sqrt(gamma)}
        return {"M": m, "gamma": np.array(gamma)}

    def _watson(self, moment: np.ndarray) -> Params:
        """The leading or the trailing direction, whichever its best concentration makes likelier."""
        values, vectors = np.linalg.eigh(moment)
        best = None
        for at in (-1, 0):
            r = float(values[at])
            kappa = solve_kummer(self.a, self.c, r)
            gain = kappa * r - log_kummer(self.a, self.c, kappa)
            if (kappa >= 0) == (at == -1) and (best is None or gain > best[0]):
                best = (gain, vectors[:, at], kappa)
        if best is None:
            return {"mu": vectors[:, -1], "kappa": np.array(0.0)}
        return {"mu": best[1], "kappa": np.array(best[2])}

    def ratio(self, kappa: float) -> float:
        return kummer_ratio(self.a, self.c, kappa)

    # -- starts -------------------------------------------------------------------------------

    def uniform(self, k: int, seed: int) -> Params:
        """Random parameters of the family."""
        rng = np.random.default_rng(seed)
        draw = lambda *s: rng.uniform(size=s) + (1j * rng.uniform(size=s) if self.is_complex else 0)
        pi = np.full(k, 1 / k)
        if self.name == "Watson":
            mu = draw(k, self.p)
            return {"pi": pi, "mu": mu / np.linalg.norm(mu, axis=1, keepdims=True), "kappa": np.ones(k)}
        m = draw(k, self.p, self.rank or self.p)
        if self.rank:
            return {"pi": pi, "M": m} | ({"gamma": np.ones(k)} if self.name in ("SingularWishart", "Normal") else {})
        psi = np.einsum("kpr,ksr->kps", m, m.conj()) + np.eye(self.p)
        return {"pi": pi, "Psi": psi * (self.p / np.trace(psi, axis1=1, axis2=2).real)[:, None, None]}

    def from_parts(self, gram: np.ndarray, size: np.ndarray, centres: np.ndarray | None = None) -> Params:
        """Parameters from the second moments of a hard partition."""
        k = len(size)
        pi = size / size.sum()
        if self.name == "Watson":
            parts = [self._watson(gram[j] / max(size[j], 1)) for j in range(k)]
            return {"pi": pi, "mu": np.stack([t["mu"] for t in parts]), "kappa": np.array([float(t["kappa"]) for t in parts])}
        if self.rank:
            parts = [seeded_low_rank(gram[j], size[j], self.rank) for j in range(k)]
            theta = {"pi": pi, "M": np.stack([m for m, _ in parts])}
            if self.name in ("SingularWishart", "Normal"):
                gamma = np.array([g for _, g in parts])
                theta["gamma"] = gamma
                theta["M"] = theta["M"] * np.sqrt(gamma)[:, None, None]
            return theta
        psi = []
        for j in range(k):
            lead = np.linalg.eigh(gram[j])[1][:, -1] if centres is None or centres.ndim != 2 else centres[j]
            full = np.outer(lead, lead.conj()) + np.eye(self.p)
            psi.append(full * (self.p / np.trace(full).real) if self.name in ("ACG", "MACG") else full)
        return {"pi": pi, "Psi": np.stack(psi)}


def weights(log_density: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-sum-exp of each row, and the posterior."""
    top = log_density.max(1, keepdims=True)
    total = top[:, 0] + np.log(np.exp(log_density - top).sum(1))
    return total, np.exp(log_density - total[:, None])
