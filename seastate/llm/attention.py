"""The causal self-attention model of operator 7, in numpy: one masked head and one hidden layer over subword classes.

Tokens are ``CLASSES`` classes: the most frequent subword ids and one for all others. Classes lie in ``GROUPS`` groups of equal size, and
the output is a softmax over groups times one within the group, so a prediction costs two short rows. The model corrects
add-smoothed pair statistics of the whole training corpus: its output is added to their logarithms. It starts at zero, so an
untrained model scores as the statistics do.
"""

from __future__ import annotations

import numpy as np

GROUPS, MEMBERS = 32, 32
MEMBER_BITS = 5
CLASSES = GROUPS * MEMBERS
OTHER = CLASSES - 1
WIDTH, HIDDEN = 16, 32
WINDOW, CONTEXT = 32, 8
STEP = WINDOW - CONTEXT
LOT = 128
PAIR_PRIOR = 20.0
_F = np.float32
SCALE = _F(1 / np.sqrt(WIDTH))
_SHAPES = {"e": (CLASSES, WIDTH), "p": (WINDOW, WIDTH), "qkv": (WIDTH, 3 * WIDTH), "o": (WIDTH, WIDTH), "w1": (WIDTH, HIDDEN), "b1": (HIDDEN,),
           "w2": (HIDDEN, WIDTH), "b2": (WIDTH,), "g": (WIDTH, GROUPS), "m": (GROUPS, WIDTH, MEMBERS)}
SIZE = sum(int(np.prod(s)) for s in _SHAPES.values())
_ASK = slice(CONTEXT, WINDOW)
_CAUSAL = np.where(np.tril(np.ones((WINDOW, WINDOW), bool)), _F(0), _F(-1e9))


def split(flat: np.ndarray) -> dict[str, np.ndarray]:
    """Named views into one vector of all weights."""
    out, at = {}, 0
    for k, s in _SHAPES.items():
        n = int(np.prod(s))
        out[k] = flat[at : at + n].reshape(s)
        at += n
    return out


def initial(seed: int = 7) -> np.ndarray:
    flat = (np.random.default_rng(seed).standard_normal(SIZE) * 0.3).astype(_F)
    w = split(flat)
    for k in ("qkv", "o", "w1", "w2"):
        w[k] *= _F(1 / 0.3 / np.sqrt(w[k].shape[0]) * 0.7)
    for k in ("b1", "b2", "g", "m"):
        w[k][...] = 0
    return flat


class PairTable:
    """log p(group | last class) and log p(member | group, last class) from pair counts over all training texts."""

    def __init__(self, pairs: np.ndarray):
        single = pairs.sum(0) + 1.0
        p = (pairs + PAIR_PRIOR * single / single.sum()) / (pairs.sum(1, keepdims=True) + PAIR_PRIOR)
        p = p.reshape(CLASSES, GROUPS, MEMBERS)
        group = p.sum(2)
        self.group = np.log(group).astype(_F)
        self.member = np.log(p / group[:, :, None]).astype(_F)


def windows(n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For texts of n tokens on end: first scored position, begin and end of the text, one row per window."""
    count = -(-n // STEP)
    stop = np.cumsum(n)
    begin, end = np.repeat(stop - n, count), np.repeat(stop, count)
    return begin + STEP * (np.arange(len(begin)) - np.repeat(np.cumsum(count) - count, count)), begin, end


def _log_sum(z: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Log of the summed exponentials; shifted only where that is needed. ``room`` is written over."""
    with np.errstate(over="ignore", divide="ignore"):
        out = np.log(np.exp(z, out=room) @ np.ones(z.shape[-1], _F))
    if np.isfinite(out).all():
        return out
    top = z.max(-1, keepdims=True)
    return (np.log(np.exp(z - top).sum(-1, keepdims=True)) + top)[..., 0]


class Model:
    def __init__(self, flat: np.ndarray, pairs: PairTable):
        self.flat, self.w, self.pairs = flat, split(flat), pairs

    def _attend(self, cls: np.ndarray, there: np.ndarray, ask: slice):
        """Inputs, queries, keys, values, attention, its mix and the states at the asked positions."""
        w, n = self.w, len(cls)
        X = np.take(w["e"], cls, axis=0) + w["p"]
        qkv = (X.reshape(-1, WIDTH) @ w["qkv"]).reshape(n, WINDOW, 3 * WIDTH)
        Q, K, V = qkv[..., :WIDTH], qkv[..., WIDTH : 2 * WIDTH], qkv[..., 2 * WIDTH :]
        A = np.matmul(Q[:, ask] * SCALE, K.transpose(0, 2, 1))
        A += _CAUSAL[ask]
        cut = np.flatnonzero(~there.all(1))  # windows over a text's begin or end
        if len(cut):
            A[cut] += np.where(there[cut], _F(0), _F(-1e8))[:, None, :]
        top = A.max()
        if top > 60:  # else the exponentials are safe as they are
            A -= A.max(-1, keepdims=True)
        np.exp(A, out=A)
        whole = A @ np.ones((WINDOW, 1), _F) + _F(1e-30)
        O = np.matmul(A, np.ascontiguousarray(V)) / whole
        return X, Q, K, V, A, whole, O, X[:, ask] + O.reshape(-1, WIDTH).dot(w["o"]).reshape(O.shape)

    def run(self, x: np.ndarray, y: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], learn: bool = False):
        """Log probability of every scored token (0 beyond a text's end), and the gradient of the mean loss if wanted.

        ``x`` holds the classes before, ``y`` the classes to predict, position by position; ``at`` comes from ``windows``.
        """
        w = self.w
        first, begin, end = at
        pos = first[:, None] - CONTEXT + np.arange(WINDOW)
        there = (pos >= begin[:, None]) & (pos < end[:, None])
        pos = np.clip(pos, 0, len(x) - 1)
        cls = x[pos]
        n = len(first)
        if learn:
            X, Q, K, V, A, whole, O, H = self._attend(cls, there, _ASK)
            A /= whole
        else:  # only scored positions need an answer; small lots stay in the processor's cache
            H = np.concatenate([self._attend(cls[i : i + LOT], there[i : i + LOT], _ASK)[-1] for i in range(0, n, LOT)])
        H = H.reshape(-1, WIDTH)
        R = np.maximum(H @ w["w1"] + w["b1"], 0)
        Z = H + R @ w["w2"] + w["b2"]
        live = there[:, -STEP:].reshape(-1)
        last, want = cls[:, -STEP:].reshape(-1), y[pos[:, -STEP:]].reshape(-1)
        group, member = want >> MEMBER_BITS, want & (MEMBERS - 1)
        G = np.take(self.pairs.group, last, axis=0)
        G += Z @ w["g"]
        room = np.empty((len(want), max(GROUPS, MEMBERS)), _F)
        lse = _log_sum(G, room[:, :GROUPS])
        rows = np.arange(len(want))
        score = G[rows, group] - lse
        order = np.argsort(group.astype(np.uint8), kind="stable")  # one byte: sorted by counting
        cut = np.searchsorted(group[order], np.arange(GROUPS + 1))
        sorted_z = np.take(Z, order, axis=0)
        L = np.take(self.pairs.member.reshape(-1, MEMBERS), (last * GROUPS + group)[order], axis=0)
        for k in range(GROUPS):
            L[cut[k] : cut[k + 1]] += sorted_z[cut[k] : cut[k + 1]] @ w["m"][k]
        inner = _log_sum(L, room[:, :MEMBERS])
        score[order] += L[rows, member[order]] - inner
        score = np.where(live, score, _F(0))
        if not learn:
            return score.reshape(n, STEP)

        flat = np.zeros(SIZE, _F)
        d = split(flat)
        ones = np.ones(len(want), _F)
        weight = (live / max(1, live.sum())).astype(_F)[:, None]
        G -= lse[:, None]
        D = np.exp(G, out=G)
        D[rows, group] -= 1
        D *= weight
        d["g"][...] = Z.T @ D
        dZ = D @ w["g"].T
        L -= inner[:, None]
        P = np.exp(L, out=L)
        P[rows, member[order]] -= 1
        P *= weight[order]
        back = np.empty_like(sorted_z)
        for k in range(GROUPS):
            part = slice(cut[k], cut[k + 1])
            d["m"][k] = sorted_z[part].T @ P[part]
            back[part] = P[part] @ w["m"][k].T
        dZ[order] += back
        d["w2"][...], d["b2"][...] = R.T @ dZ, ones @ dZ
        dR = dZ @ w["w2"].T
        dR *= R > 0
        d["w1"][...], d["b1"][...] = H.T @ dR, ones @ dR
        dH = dZ + dR @ w["w1"].T
        d["o"][...] = O.reshape(-1, WIDTH).T @ dH
        dO = (dH @ w["o"].T).reshape(n, STEP, WIDTH)
        dS = np.matmul(dO, V.transpose(0, 2, 1))
        dS -= (dO * O) @ np.ones((WIDTH, 1), _F)  # the mean of a row under its attention
        dS *= A
        dQKV = np.zeros((n, WINDOW, 3 * WIDTH), _F)
        dQKV[:, _ASK, :WIDTH] = np.matmul(dS, K * SCALE)
        dQKV[..., WIDTH : 2 * WIDTH] = np.matmul(dS.transpose(0, 2, 1), Q[:, _ASK] * SCALE)
        dQKV[..., 2 * WIDTH :] = np.matmul(A.transpose(0, 2, 1), dO)
        dQKV = dQKV.reshape(-1, 3 * WIDTH)
        d["qkv"][...] = X.reshape(-1, WIDTH).T @ dQKV
        dX = (dQKV @ w["qkv"].T).reshape(n, WINDOW, WIDTH)
        dX[:, _ASK] += dH.reshape(n, STEP, WIDTH)
        if not there.all():
            dX[~there] = 0
        d["p"][...] = (ones[:n] @ dX.reshape(n, -1)).reshape(WINDOW, WIDTH)
        cls = cls.reshape(-1).astype(np.uint16)
        order = np.argsort(cls, kind="stable")  # two bytes: sorted by counting
        cls = cls[order]
        head = np.flatnonzero(np.append(True, cls[1:] != cls[:-1]))
        d["e"][cls[head]] = np.add.reduceat(np.take(dX.reshape(-1, WIDTH), order, axis=0), head, axis=0)
        return -float((score * weight[:, 0]).sum()), flat


class Adam:
    """Adaptive steps on one weight vector, changed in place."""

    def __init__(self, rate: float = 0.005):
        self.rate, self.t, self.m, self.v = rate, 0, np.zeros(SIZE, _F), np.zeros(SIZE, _F)

    def step(self, flat: np.ndarray, grad: np.ndarray) -> None:
        self.t += 1
        norm = float(np.sqrt((grad * grad).sum()))
        if norm > 1:
            grad = grad / _F(norm)
        self.m += _F(0.1) * (grad - self.m)
        self.v += _F(0.01) * (grad * grad - self.v)
        flat -= _F(self.rate / (1 - 0.9**self.t)) * self.m / (np.sqrt(self.v / _F(1 - 0.99**self.t)) + _F(1e-8))
