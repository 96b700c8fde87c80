"""A bidirectional gated recurrent network over bytes in numpy: training by backpropagation through time, and inference."""

from __future__ import annotations

import numpy as np

H = 12


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (np.tanh(0.5 * x) + 1)


class BiGRU:
    """Labels every position of equally long byte sequences. Gates are z (update), r (reset) and n (candidate)."""

    def __init__(self, labels: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        f = np.float32
        self.p = {}
        for d in "fb":
            self.p[d + "x"] = (rng.standard_normal((256, 3 * H)) * 0.3).astype(f)  # input weights times one-hot bytes
            self.p[d + "u"] = (rng.standard_normal((H, 2 * H)) / np.sqrt(H)).astype(f)
            self.p[d + "n"] = (rng.standard_normal((H, H)) / np.sqrt(H)).astype(f)
            self.p[d + "b"] = np.zeros(3 * H, f)
        self.p["w"] = (rng.standard_normal((2 * H, labels)) / np.sqrt(2 * H)).astype(f)
        self.p["c"] = np.zeros(labels, f)

    def _run(self, seq: np.ndarray, d: str, keep: bool) -> tuple[np.ndarray, list]:
        """States at every position of one direction."""
        n, length = seq.shape
        x, u, un = self.p[d + "x"] + self.p[d + "b"], self.p[d + "u"], self.p[d + "n"]
        out = np.empty((length, n, H), np.float32)
        h, saved = np.zeros((n, H), np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = x[seq[:, t]]
            zr = _sigmoid(a[:, : 2 * H] + h @ u)
            z, r = zr[:, :H], zr[:, H:]
            rh = r * h
            c = np.tanh(a[:, 2 * H :] + rh @ un)
            if keep:
                saved.append((t, h, zr, rh, c))
            h = c + z * (h - c)
            out[t] = h
        return out, saved

    def probabilities(self, seq: np.ndarray) -> np.ndarray:
        """(position, sequence, label)."""
        w = self.p["w"]
        logits = self._run(seq, "f", False)[0] @ w[:H] + self._run(seq, "b", False)[0] @ w[H:] + self.p["c"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        return e / e.sum(-1, keepdims=True)

    def gradients(self, seq: np.ndarray, label: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over positions, and its gradients."""
        runs = {d: self._run(seq, d, True) for d in "fb"}
        h = np.concatenate([runs["f"][0], runs["b"][0]], -1)
        logits = h @ self.p["w"] + self.p["c"]
        e = np.exp(logits - logits.max(-1, keepdims=True))
        prob = e / e.sum(-1, keepdims=True)
        n, length = seq.shape
        rows = np.arange(n)
        loss = -float(np.log(prob[:, rows, label] + 1e-9).mean())
        prob[:, rows, label] -= 1
        prob /= n * length
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        g["w"], g["c"] = h.reshape(-1, 2 * H).T @ prob.reshape(-1, prob.shape[-1]), prob.sum((0, 1))
        dh_out = prob @ self.p["w"].T
        for k, d in enumerate("fb"):
            u, un = self.p[d + "u"], self.p[d + "n"]
            dh = np.zeros((n, H), np.float32)
            for t, before, zr, rh, c in reversed(runs[d][1]):
                z, r = zr[:, :H], zr[:, H:]
                dh = dh + dh_out[t][:, k * H : (k + 1) * H]
                dc = dh * (1 - z) * (1 - c * c)
                drh = dc @ un.T
                da = np.concatenate([dh * (before - c) * z * (1 - z), drh * before * r * (1 - r)], 1)
                g[d + "n"] += rh.T @ dc
                g[d + "u"] += before.T @ da
                dx = np.concatenate([da, dc], 1)
                np.add.at(g[d + "x"], seq[:, t], dx)
                g[d + "b"] += dx.sum(0)
                dh = dh * z + drh * r + da @ u.T
        return loss, g

    def fit(self, words: list[bytes], labels: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 2) -> list[float]:
        """Adam on batches of words of one length each."""
        rng = np.random.default_rng(seed)
        size = np.array([len(w) for w in words])
        by = {int(n): np.flatnonzero(size == n) for n in np.unique(size)}
        lengths = np.array(list(by))
        share = np.array([len(v) * n for n, v in by.items()], float)
        data = {n: np.frombuffer(b"".join(words[i] for i in v), np.uint8).reshape(-1, n) for n, v in by.items()}
        m1 = {k: np.zeros_like(v) for k, v in self.p.items()}
        m2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        losses = []
        for step in range(1, steps + 1):
            n = int(rng.choice(lengths, p=share / share.sum()))
            i = rng.integers(0, len(by[n]), batch)
            loss, g = self.gradients(data[n][i], labels[by[n][i]])
            losses.append(loss)
            lr = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k in self.p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.99 * m2[k] + 0.01 * g[k] ** 2
                self.p[k] -= (lr * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
        return losses
