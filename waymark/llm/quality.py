"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words, all of them. A passage is described by how its bytes and words are
made up, encoded by a small layer h = tanh(W x), and weighed by gated attention, softmax(w (tanh(V h) * sigmoid(U h)));
the weighted sum of the encodings gives the score. Only document labels are known; the attention learns which passages
show them. The model is fitted in numpy on a bounded sample: MOST_LEARN documents of each class and all passages of
each, of a longer text than FIT_PASSAGES passages a seeded sample over the whole of it. Scoring reads every passage of
every text; long texts are described in blocks.

Defined cases: a null or empty text is one empty passage; without labels of both classes every score is the share of
label 1 (1.0 if there are no labels); repeated rows get equal scores, and one of them is learned from; other columns
are not touched.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .learning import Adam, class_counts, fold, labelled_sample, sigmoid

PASSAGE = 48
HIDDEN, GATE = 12, 8
#: Bounds of the sample that the model is fitted on: documents of each class, and passages of one document.
MOST_LEARN, FIT_PASSAGES = 2000, 1024
EPOCHS = 250
THRESHOLD = 0.3
FOLDS, HELD_OUT = 5, 0

_KINDS = [
    range(0x41, 0x5B), range(0x61, 0x7B), range(0x30, 0x3A), range(0x80, 0x100), b".,;:", b"!?", b"|", b"$%#&*@^~", b"\n", b"\"'()[]{}<>/\\=+-_`",
]
_OF_KIND = np.zeros((len(_KINDS), 256), np.float32)
for _i, _kind in enumerate(_KINDS):
    _OF_KIND[_i, list(_kind)] = 1
WIDTH = len(_KINDS) + 5


def passages(text: bytes, block: int = 1 << 20) -> np.ndarray:
    """One row of numbers for each passage of a text; bytes are looked at in blocks, so memory is the text's and a block's."""
    out, at = [], 0
    while at < len(text) or not out:
        made, used = _described(text[at : at + block], at + block >= len(text))
        if not used:  # a block holds no whole passage
            block *= 2
            continue
        out.append(made)
        at += used
    out = [x for x in out if len(x)] or [np.zeros((1, WIDTH), np.float32)]
    every = np.concatenate(out)
    every[:, -1] = np.log1p(len(every)) / 10 if text.strip() else 0
    return every


def _described(text: bytes, last: bool) -> tuple[np.ndarray, int]:
    """Rows of the whole passages of a block (of all of them in the last block), and the bytes that they take."""
    data = np.frombuffer(text, np.uint8)
    blank = _BLANK[data]
    word_starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    starts = word_starts[::PASSAGE]
    used = len(data)
    if not last:
        if len(starts) < 2:
            return np.zeros((0, WIDTH), np.float32), 0
        used = int(starts[-1])
        starts, word_starts, data = starts[:-1], word_starts[: (len(starts) - 1) * PASSAGE], data[:used]
    n, count = len(word_starts), len(starts)
    if not n:
        return np.zeros((0, WIDTH), np.float32), max(1, used)
    words = text[:used].split()
    size = np.diff(np.append(starts, used)).astype(np.float32)
    in_passage = np.minimum(PASSAGE, n - PASSAGE * np.arange(count)).astype(np.float32)
    out = np.empty((count, WIDTH), np.float32)
    owner = np.repeat(np.arange(count), np.diff(np.append(starts, used))) * (len(_KINDS) + 1)
    kinds = np.bincount(owner + _CODE[data[starts[0] :]], minlength=count * (len(_KINDS) + 1)).reshape(count, -1)
    out[:, : len(_KINDS)] = kinds[:, : len(_KINDS)] / size[:, None]
    hashes = np.fromiter(map(crc32, words), np.int64, n)
    filled = np.concatenate([hashes, -1 - np.arange(count * PASSAGE - n)]).reshape(count, PASSAGE)
    ordered = np.sort(filled, axis=1)
    out[:, -5] = (np.diff(ordered, axis=1) == 0).sum(axis=1) / in_passage  # words that the passage has already
    out[:, -4] = (np.diff(filled, axis=1) == 0).sum(axis=1) / in_passage  # words equal to the one before
    out[:, -3] = np.minimum(size / in_passage, 40) / 20
    out[:, -2] = in_passage / PASSAGE
    return out, used


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_CODE = np.where(_OF_KIND.any(axis=0), _OF_KIND.argmax(axis=0), len(_KINDS)).astype(np.int64)


class Model:
    """Encoder, gated attention and score; bags are given as stacked passages and the start of each bag."""

    def __init__(self, width: int = WIDTH, seed: int = 5):
        draw = np.random.default_rng(seed)
        give = lambda a, b: (draw.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.mean, self.scale = np.zeros(width, np.float32), np.ones(width, np.float32)
        self.w = {
            "W": give(width, HIDDEN), "b": np.zeros(HIDDEN, np.float32), "V": give(HIDDEN, GATE), "U": give(HIDDEN, GATE),
            "a": give(GATE, 1), "o": give(HIDDEN, 1), "c": np.zeros(1, np.float32),
        }
        self.constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        w = self.w
        bags = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(x))))
        h = np.tanh(((x - self.mean) / self.scale) @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), sigmoid(h @ w["U"])
        e = ((t * g) @ w["a"])[:, 0]
        e = np.exp(e - np.maximum.reduceat(e, starts)[bags])
        alpha = e / np.add.reduceat(e, starts)[bags]
        z = np.add.reduceat(alpha[:, None] * h, starts, axis=0)
        return {"bags": bags, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "p": sigmoid((z @ w["o"])[:, 0] + w["c"])}

    def gradients(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        """Of the weighted log loss."""
        w, f = self.w, self.forward(x, starts)
        d = ((f["p"] - y) * weight / weight.sum()).astype(x.dtype)[:, None]
        dz = (d @ w["o"].T)[f["bags"]]
        alpha = f["alpha"][:, None]
        da = (dz * f["h"]).sum(axis=1, keepdims=True)
        de = alpha * (da - np.add.reduceat(alpha * da, starts, axis=0)[f["bags"]])
        dtg = de @ w["a"].T
        dt, dg = dtg * f["g"] * (1 - f["t"] ** 2), dtg * f["t"] * f["g"] * (1 - f["g"])
        dh = alpha * dz + dt @ w["V"].T + dg @ w["U"].T
        dx = dh * (1 - f["h"] ** 2)
        xs = (x - self.mean) / self.scale
        return {"W": xs.T @ dx, "b": dx.sum(axis=0), "V": f["h"].T @ dt, "U": f["h"].T @ dg, "a": (f["t"] * f["g"]).T @ de, "o": f["z"].T @ d, "c": d.sum(axis=0)}

    def fit(self, x: np.ndarray, starts: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-3
        step = Adam(self.w)
        for _ in range(EPOCHS):
            step(self.gradients(x, starts, y, weight))

    def score(self, bags: list[np.ndarray]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(bags), self.constant)
        starts = np.cumsum([0, *map(len, bags[:-1])])
        return self.forward(np.concatenate(bags), starts)["p"].astype(np.float64)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    learn = fold(key, FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, label, learn, MOST_LEARN, key, text)

    def rows(texts: list[bytes]) -> list[tuple]:
        out = []
        for t in texts:
            found = passages(t)
            if len(found) > FIT_PASSAGES:
                found = found[np.sort(np.random.default_rng(crc32(t)).choice(len(found), FIT_PASSAGES, replace=False))]
            out.append((found.tobytes(),))
        return out

    got = sorted(map_texts(sample, rows, "x binary", key, text, ("_label",)).collect(), key=lambda r: r[key])
    model = Model()
    y = np.array([r["_label"] for r in got], np.float32)
    counts = class_counts(labels, label, learn)
    if len(set(y.tolist())) < 2:
        model.constant = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 1.0
        return model
    x = [np.frombuffer(r["x"], np.float32).reshape(-1, WIDTH) for r in got]
    weight = np.where(y == 1, counts[1] / (y == 1).sum(), counts[0] / (y == 0).sum())  # the classes' true shares
    model.fit(np.concatenate(x), np.cumsum([0, *map(len, x[:-1])]), y, weight)
    return model


def score_quality(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the `keep` columns, held_out, score and predicted of every whole text."""

    def rows(texts: list[bytes]) -> list[tuple]:
        return [(s, int(s >= THRESHOLD)) for s in model.score([passages(t) for t in texts]).tolist()]

    scored = map_texts(docs, rows, "score double, predicted int", key, text, keep)
    return scored.select(key, *keep, (fold(key, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
