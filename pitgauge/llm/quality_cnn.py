"""Text quality by a byte-level convolutional network in numpy.

Bytes are embedded and convolved with learned filters (width 8, stride 4). Responses are max-pooled over chunks of two halves that
overlap by one, from the first byte to the last. A small layer turns a chunk's pooled responses into a logit of poor
quality; the poorest chunk of a text decides, so its length doesn't matter. Only the places that won a maximum get gradients.
"""

from __future__ import annotations

from dataclasses import dataclass, field as plain

import numpy as np
from pyspark.sql import DataFrame

from pitgauge.llm.common import append_columns, field
from pitgauge.llm.labelled import constant

EMBED, FILTERS, HIDDEN = 8, 32, 16
WIDTH, STRIDE, HALF = 8, 4, 256
PLACES = HALF // STRIDE


@dataclass
class Network:
    """Parameters, all float32; ``always`` is set where there was nothing to tell apart."""

    weights: dict[str, np.ndarray] = plain(default_factory=dict)
    always: float | None = None


def lay_out(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts' bytes in whole halves, each text followed by at least one window of zeros; first half and bytes of each text."""
    data = [t.encode() for t in texts]
    sizes = np.array([len(d) for d in data], dtype=np.int64)
    halves = np.maximum(1, -(-(sizes + WIDTH) // HALF))
    first = np.concatenate([[0], np.cumsum(halves)])
    flat = np.zeros(first[-1] * HALF + WIDTH, dtype=np.uint8)
    for d, f in zip(data, first):
        flat[f * HALF:f * HALF + len(d)] = np.frombuffer(d, dtype=np.uint8)
    return flat, first, sizes


def responses(flat: np.ndarray, w: dict[str, np.ndarray]) -> np.ndarray:
    """Rectified filter responses at every place, as two products over the halves of each window."""
    steps = w["embed"][flat].reshape(-1, STRIDE * EMBED)
    n = STRIDE * EMBED
    out = steps[:-1] @ w["filter"][:n]
    out += steps[1:] @ w["filter"][n:]
    out += w["filter_bias"]
    return np.maximum(out, 0, out=out)[:(len(flat) - WIDTH) // STRIDE]


def chunks(first: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every chunk: its text, its two halves (the same one twice in a text of one half), and how full it is."""
    halves = np.diff(first)
    n = np.maximum(1, halves - 1)
    owner = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    a = first[owner] + at
    b = np.where(halves[owner] > 1, a + 1, a)
    fill = np.clip(sizes[owner] - at * HALF, 0, 2 * HALF)
    return owner, a, b, (np.log2(1 + fill) / 9).astype(np.float32)


def logits(pooled: np.ndarray, fill: np.ndarray, w: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(pooled @ w["hidden"] + fill[:, None] * w["fill"] + w["hidden_bias"])
    return hidden @ w["out"] + w["out_bias"], hidden


def forward(texts: list[str], w: dict[str, np.ndarray], block: int = 1 << 18) -> tuple:
    """Chunk logits of whole texts; responses exist for one block of bytes at a time."""
    flat, first, sizes = lay_out(texts)
    last = first[1:] * PLACES - 1  # these windows reach into the next text
    tops = []
    for k in range(0, len(flat) - WIDTH, block):
        r = responses(flat[k:min(k + block, len(flat) - WIDTH) + WIDTH], w)
        r[last[np.searchsorted(last, k // STRIDE):np.searchsorted(last, k // STRIDE + len(r))] - k // STRIDE] = 0
        tops.append(r.reshape(-1, PLACES, FILTERS).max(axis=1))
    top = np.concatenate(tops) if tops else np.zeros((0, FILTERS), np.float32)
    owner, a, b, fill = chunks(first, sizes)
    pooled = np.maximum(top[a], top[b])
    z, hidden = logits(pooled, fill, w)
    return flat, owner, a, b, fill, pooled, z, hidden, last


def poorest(owner: np.ndarray, z: np.ndarray, n: int) -> np.ndarray:
    """Index of the chunk with the largest logit of each text (the first of equal ones)."""
    order = np.lexsort((np.arange(len(z)), -z, owner))
    return order[np.searchsorted(owner[order], np.arange(n))]


def score(texts: list[str], network: Network) -> np.ndarray:
    """Probability of good quality; of a text's own bytes alone."""
    if network.always is not None or not texts:
        return np.full(len(texts), network.always or 0.0)
    _, owner, _, _, _, _, z, _, _ = forward(texts, network.weights)
    worst = np.full(len(texts), -np.inf)
    np.maximum.at(worst, owner, z.astype(np.float64))
    return 1 / (1 + np.exp(np.clip(worst, -30, 30)))


def learn(texts: list[str], labels: list[int], epochs: int = 14, batch: int = 32, rate: float = 4e-3, seed: int = 7) -> Network:
    """Fit by Adam on the log loss of whole texts; classes weigh the same. Deterministic for the same texts in the same order."""
    if (always := constant(labels)) is not None:
        return Network(always=always)
    rng = np.random.default_rng(seed)
    w = {"embed": rng.normal(0, 1, (256, EMBED)), "filter": rng.normal(0, 0.15, (WIDTH * EMBED, FILTERS)), "filter_bias": np.zeros(FILTERS),
         "hidden": rng.normal(0, 0.2, (FILTERS, HIDDEN)), "fill": rng.normal(0, 0.2, HIDDEN), "hidden_bias": np.zeros(HIDDEN),
         "out": rng.normal(0, 0.3, HIDDEN), "out_bias": np.zeros(1)}
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["embed"][0] = 0
    first, second, step = {k: np.zeros_like(v) for k, v in w.items()}, {k: np.zeros_like(v) for k, v in w.items()}, 0
    y = np.array([1 - v for v in labels], dtype=np.float32)
    share = {v: 0.5 / max(1e-9, float((y == v).mean())) for v in (0.0, 1.0)}
    for epoch in range(epochs):
        order = rng.permutation(len(texts))
        for k in range(0, len(order), batch):
            ids = order[k:k + batch]
            flat, owner, a, b, fill, pooled, z, hidden, last = forward([texts[i] for i in ids], w)
            pick = poorest(owner, z, len(ids))
            p = 1 / (1 + np.exp(-np.clip(z[pick], -30, 30)))
            dz = ((p - y[ids]) * np.array([share[float(v)] for v in y[ids]], dtype=np.float32) / len(ids)).astype(np.float32)
            dh = dz[:, None] * w["out"] * (1 - hidden[pick] ** 2)
            dp = dh @ w["hidden"].T
            grad = {"out": hidden[pick].T @ dz, "out_bias": np.array([dz.sum()]), "hidden": pooled[pick].T @ dh,
                    "fill": fill[pick] @ dh, "hidden_bias": dh.sum(axis=0)}
            d_filter, d_bias, d_embed = np.zeros_like(w["filter"]), np.zeros(FILTERS, np.float32), np.zeros_like(w["embed"])
            for i, c in enumerate(pick):  # back to the windows that won
                places = np.concatenate([np.arange(PLACES) + h * PLACES for h in dict.fromkeys((a[c], b[c]))])
                windows = flat[(places * STRIDE)[:, None] + np.arange(WIDTH)]
                x = w["embed"][windows].reshape(len(places), -1)
                r = x @ w["filter"] + w["filter_bias"]
                r[places == last[i]] = 0
                win = r.argmax(axis=0)
                g = np.where(r[win, np.arange(FILTERS)] > 0, dp[i], 0)
                d_filter += x[win].T * g
                d_bias += g
                np.add.at(d_embed, windows[win], (w["filter"] * g).T.reshape(FILTERS, WIDTH, EMBED))
            d_embed[0] = 0
            grad |= {"filter": d_filter, "filter_bias": d_bias, "embed": d_embed}
            step += 1
            now = rate * 0.5 * (1 + np.cos(np.pi * step / (epochs * -(-len(order) // batch))))
            for name, g in grad.items():
                first[name] += 0.1 * (g - first[name])
                second[name] += 0.01 * (g * g - second[name])
                w[name] -= (now * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.99 ** step)) + 1e-6)).astype(np.float32)
    return Network(w)


def score_quality(docs: DataFrame, network: Network, text: str = "text", keep=None) -> DataFrame:
    """``docs`` with ``score`` (probability of good quality) and ``predicted``, over every byte of the texts.

    A null or empty text is one empty chunk. Repeated rows repeat their score. Columns of ``docs`` with the new names are replaced.
    """

    def make():
        def run(texts):
            out = score(texts, network)
            return out.tolist(), (out >= 0.5).astype(int).tolist()

        return run

    return append_columns(docs, text, [field("score", "double"), field("predicted", "int")], make, keep=keep)
