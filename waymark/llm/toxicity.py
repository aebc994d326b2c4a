"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A text is read in overlapping windows of WINDOW words, each STEP words on, all of them. A word enters by its characters
and as a word. Characters: learned embeddings of its bytes go through learned filters over each three neighbours (the
word's edges are characters too), and each filter's greatest answer along the word is an input, so evidence counts
wherever in a word it stands. Word: for a hash of the whole word and of its first 3 to 6 bytes, how much more often
documents of the sample that hold it are toxic than others; and its length and case. Two gated recurrent layers run
over a window in both directions, attention pools their states, and the most toxic window gives the score.

The model is fitted on a bounded sample: MOST_LEARN documents of each class and all of their words, of a longer text
than FIT_WORDS words a seeded sample of runs over the whole of it. Evidence of words for a document of the sample comes
from the other parts of it, so that the network learns what evidence is worth on new texts. Every sample gets STEPS
steps. Scoring reads every window of every text; long texts go through in blocks.

Defined cases: a null or empty text is one empty window; without labels of both classes every score is the share of
label 1 (0.0 if there are no labels); repeated rows get equal scores, and one of them is learned from; other columns
are not touched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts
from .learning import Adam, class_counts, fold, labelled_sample, sigmoid

WINDOW, STEP = 32, 16
HIDDEN, POOL = 6, 6
PREFIXES = (3, 4, 5, 6)
SLOTS = 1 << 17
#: Size of a byte's embedding, and filters over three of them.
EMBED, FILTERS = 4, 8
WORD_INPUTS = len(PREFIXES) + 1 + 3
INPUTS = WORD_INPUTS + FILTERS
#: Bounds of the sample that the model is fitted on: documents of each class, and words of one document, in runs.
MOST_LEARN, FIT_WORDS, RUN = 1200, 16_384, 512
PARTS, ROUNDS, STEPS, BATCH = 4, 3, 360, 256
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2
#: Words that a worker remembers, windows that it scores together, and bytes of a text that it takes apart together.
MOST_WORDS, BLOCK, BYTES = 50_000, 1024, 1 << 20

_WORD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x41 <= c <= 0x5A or 0x61 <= c <= 0x7A else 0x20 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def hashes(word: bytes) -> tuple[int, ...]:
    """Slots of the whole word and of its first bytes (all of a shorter word, marked by its length)."""
    low = word.lower()
    return (crc32(low) % SLOTS, *[crc32(low[:n], n) % SLOTS for n in PREFIXES])


def shape(word: bytes) -> tuple[float, float, float]:
    n = len(word)
    return min(n, 20) / 20, float(word.isupper()), 0.0 if word.isascii() else 1.0


def windows(n: int) -> np.ndarray:
    """Word numbers of the overlapping windows of a text of n words; n stands for no word."""
    starts = np.arange(0, max(1, n - WINDOW + STEP), STEP)
    at = starts[:, None] + np.arange(WINDOW)
    return np.where(at < n, at, n)


def stretches(text: bytes, block: int = BYTES) -> Iterator[list[bytes]]:
    """Words of a text in stretches of about a block, whose windows together are the text's."""
    at, held, given = 0, [], False
    while at < len(text):
        end = at + block
        if end < len(text):
            cut = text[at:end].translate(_WORD).rfind(b" ") + 1  # no word is cut
            if not cut:
                block *= 2
                continue
            end = at + cut
        held += words(text[at:end])
        at = end
        whole = (len(held) - WINDOW) // STEP + 1  # windows that end in what is held
        if at < len(text) and whole > 0:
            yield held[: (whole - 1) * STEP + WINDOW]
            held, given = held[whole * STEP :], True
    if not given or len(held) > WINDOW - STEP:
        yield held


class Spelling:
    """The three neighbouring bytes at each byte of each of some words, in lower case; a blank stands at their edges."""

    def __init__(self, of: list[bytes]):
        data = np.frombuffer(b" " + b" ".join(of).lower() + b" ", np.uint8)
        middle = np.flatnonzero(data != 32)
        self.near = [data[middle - 1], data[middle], data[middle + 1]]
        self.lengths = np.fromiter(map(len, of), np.int64, len(of))
        self.starts = np.cumsum(self.lengths) - self.lengths

    def __len__(self) -> int:
        return len(self.lengths)


class Model:
    """Evidence tables and network. Inputs of padding are zero, and padding leaves states as they are."""

    def __init__(self, seed: int = 9):
        draw = np.random.default_rng(seed)
        give = lambda a, b: (draw.normal(size=(a, b)) / np.sqrt(a)).astype(np.float32)
        self.evidence = np.zeros((1 + len(PREFIXES), SLOTS), np.float32)
        self.w: dict[str, np.ndarray] = {}
        for d in "fb":
            self.w |= {f"X{d}": give(INPUTS, 3 * HIDDEN), f"H{d}": give(HIDDEN, 3 * HIDDEN), f"c{d}": np.zeros(3 * HIDDEN, np.float32)}
        self.w |= {"A": give(2 * HIDDEN, POOL), "v": give(POOL, 1), "o": give(2 * HIDDEN, 1), "k": np.zeros(1, np.float32)}
        self.w |= {"E": give(256, EMBED) * 8, "F": give(3 * EMBED, FILTERS), "e": np.zeros(FILTERS, np.float32)}
        self.shift, self.constant = 0.0, None
        self._forget()

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("known", "projected", "used")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.projected: np.ndarray | None = None
        self.used = 0

    def word_inputs(self, slots: np.ndarray, shapes: np.ndarray, evidence: np.ndarray | None = None) -> np.ndarray:
        table = self.evidence if evidence is None else evidence
        found = [table[k, slots[:, k]] for k in range(slots.shape[1])]
        return np.concatenate([np.stack(found, axis=1), shapes], axis=1).astype(np.float32)

    def character_inputs(self, of: Spelling) -> tuple[np.ndarray, np.ndarray]:
        """The greatest answer of each filter along each word, and the answers at every byte."""
        E, F = self.w["E"], self.w["F"]
        if not len(of):
            return np.zeros((0, FILTERS), E.dtype), np.zeros((0, FILTERS), E.dtype)
        answers = sum((E @ F[k * EMBED : (k + 1) * EMBED])[of.near[k]] for k in range(3))
        return np.tanh(np.maximum.reduceat(answers, of.starts, axis=0) + self.w["e"]), answers

    def _character_gradients(self, of: Spelling, answers: np.ndarray, found: np.ndarray, d_found: np.ndarray) -> dict[str, np.ndarray]:
        """A word's gradient goes to the bytes where a filter's answer is greatest."""
        E, F = self.w["E"], self.w["F"]
        d_most = d_found * (1 - found * found)
        owner = np.repeat(np.arange(len(of)), of.lengths)
        most = (answers == np.maximum.reduceat(answers, of.starts, axis=0)[owner]).astype(E.dtype)
        d_answers = most / np.add.reduceat(most, of.starts, axis=0)[owner] * d_most[owner]
        d_E, d_F = np.zeros_like(E), np.zeros_like(F)
        for k in range(3):
            d_table = np.stack([np.bincount(of.near[k], d_answers[:, f], 256) for f in range(FILTERS)], axis=1).astype(E.dtype)
            d_E += d_table @ F[k * EMBED : (k + 1) * EMBED].T
            d_F[k * EMBED : (k + 1) * EMBED] = E.T @ d_table
        return {"E": d_E, "F": d_F, "e": d_most.sum(axis=0)}

    def _run(self, gates: np.ndarray, held: np.ndarray, d: str, keep: bool = False):
        """States after each word, in reading order of direction d. gates: (time, windows, 3 x hidden)."""
        w, n = self.w[f"H{d}"], HIDDEN
        h = np.zeros((gates.shape[1], n), gates.dtype)
        states, memo = np.empty((*gates.shape[:2], n), gates.dtype), []
        times = range(len(gates)) if d == "f" else range(len(gates) - 1, -1, -1)
        for t in times:
            u = h @ w
            zr = sigmoid(gates[t, :, : 2 * n] + u[:, : 2 * n])
            z = np.where(held[t][:, None], zr[:, :n], 1)
            new = np.tanh(gates[t, :, 2 * n :] + zr[:, n:] * u[:, 2 * n :])
            if keep:
                memo.append((t, h, u, z, zr[:, n:], new))
            h = new + z * (h - new)
            states[t] = h
        return states, memo

    def _pool(self, states: np.ndarray, held: np.ndarray):
        t = np.tanh(states @ self.w["A"])
        e = np.where(held, (t @ self.w["v"])[..., 0], -30)
        e = np.exp(e - e.max(axis=0))
        alpha = e / e.sum(axis=0)
        pooled = (alpha[..., None] * states).sum(axis=0)
        return t, alpha, pooled, (pooled @ self.w["o"])[:, 0] + self.w["k"]

    def logits(self, gates_f: np.ndarray, gates_b: np.ndarray, held: np.ndarray) -> np.ndarray:
        states = np.concatenate([self._run(gates_f, held, "f")[0], self._run(gates_b, held, "b")[0]], axis=2)
        return self._pool(states, held)[3]

    def step(self, x: np.ndarray, held: np.ndarray, y: np.ndarray, weight: np.ndarray, adam: Callable[[dict], None], of: Spelling, at: np.ndarray) -> None:
        """One step down the gradient of the weighted log loss.

        x: (time, windows, word inputs); at: (time, windows), which word of the spelling stands there, len(of) for none.
        """
        found, answers = self.character_inputs(of)
        x = np.concatenate([x, np.concatenate([found, np.zeros((1, FILTERS), found.dtype)])[at]], axis=2)
        w, n = self.w, HIDDEN
        runs = {d: self._run(x @ w[f"X{d}"] + w[f"c{d}"], held, d, True) for d in "fb"}
        states = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        t, alpha, pooled, logit = self._pool(states, held)
        d_logit = ((sigmoid(logit) - y) * weight / weight.sum()).astype(x.dtype)[:, None]
        grad = {"o": pooled.T @ d_logit, "k": d_logit.sum(axis=0)}
        d_pool = d_logit @ w["o"].T
        d_alpha = (d_pool * states).sum(axis=2)
        d_e = alpha * (d_alpha - (alpha * d_alpha).sum(axis=0))
        grad["v"] = np.einsum("tbp,tb->p", t, d_e)[:, None]
        d_t = d_e[..., None] * w["v"][:, 0] * (1 - t * t)
        grad["A"] = np.einsum("tbs,tbp->sp", states, d_t)
        d_states = alpha[..., None] * d_pool + d_t @ w["A"].T
        d_x = np.zeros_like(x)
        for i, d in enumerate("fb"):
            d_h = np.zeros((x.shape[1], n), x.dtype)
            grad |= {f"X{d}": np.zeros_like(w[f"X{d}"]), f"H{d}": np.zeros_like(w[f"H{d}"]), f"c{d}": np.zeros_like(w[f"c{d}"])}
            for time, h, u, z, r, new in reversed(runs[d][1]):
                d_h = d_h + d_states[time, :, i * n : (i + 1) * n]
                live = held[time][:, None]
                d_new = d_h * (1 - z) * (1 - new * new)
                d_z = np.where(live, d_h * (h - new) * z * (1 - z), 0)
                d_r = d_new * u[:, 2 * n :] * r * (1 - r)
                d_gate = np.concatenate([d_z, d_r, d_new], axis=1)
                d_u = np.concatenate([d_z, d_r, d_new * r], axis=1)
                grad[f"X{d}"] += x[time].T @ d_gate
                grad[f"c{d}"] += d_gate.sum(axis=0)
                d_x[time] += d_gate @ w[f"X{d}"].T
                grad[f"H{d}"] += h.T @ d_u
                d_h = d_h * z + d_u @ w[f"H{d}"].T
        flat, d_flat = at.ravel(), d_x[..., WORD_INPUTS:].reshape(-1, FILTERS)
        d_found = np.stack([np.bincount(flat, d_flat[:, f], len(of) + 1)[: len(of)] for f in range(FILTERS)], axis=1).astype(x.dtype)
        adam(grad | self._character_gradients(of, answers, found, d_found))

    def score(self, texts: list[bytes]) -> np.ndarray:
        """The score of each whole text, from its most toxic window."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        best, rows, owners, held = np.full(len(texts), -np.inf), [], [], 0

        def run() -> None:
            every = np.concatenate(rows)
            logit = np.empty(len(every), np.float32)
            for lo in range(0, len(every), BLOCK):
                at = every[lo : lo + BLOCK].T
                gates = self.projected[at]
                logit[lo : lo + BLOCK] = self.logits(gates[..., : 3 * HIDDEN], gates[..., 3 * HIDDEN :], at > 0)
            starts = np.cumsum([0, *map(len, rows[:-1])])
            np.maximum.at(best, owners, np.maximum.reduceat(logit, starts).astype(np.float64))

        for k, text in enumerate(texts):
            for found in stretches(text):
                numbers = self._numbers(found)
                rows.append(np.append(numbers, 0)[windows(len(numbers))])  # row 0 is the padding
                owners.append(k)
                held += len(rows[-1])
                if held > 4 * BLOCK:
                    run()
                    rows, owners, held = [], [], 0
                    self.tidy()
        if rows:
            run()
        return sigmoid(best + self.shift)

    def _numbers(self, found: list[bytes]) -> np.ndarray:
        """Rows of the words' projected inputs; new words get theirs first."""
        if self.projected is None:
            self.projected = np.zeros((1024, 6 * HIDDEN), np.float32)
            self.used = 1
        known = self.known
        fresh = [w for w in dict.fromkeys(found) if w not in known]
        if fresh:
            x = self.word_inputs(np.array([hashes(w) for w in fresh]), np.array([shape(w) for w in fresh], np.float32))
            x = np.concatenate([x, self.character_inputs(Spelling(fresh))[0]], axis=1)
            p = np.concatenate([x @ self.w["Xf"] + self.w["cf"], x @ self.w["Xb"] + self.w["cb"]], axis=1)
            while self.used + len(fresh) > len(self.projected):
                self.projected = np.concatenate([self.projected, np.zeros_like(self.projected)])
            self.projected[self.used : self.used + len(fresh)] = p
            known.update(zip(fresh, range(self.used, self.used + len(fresh)), strict=True))
            self.used += len(fresh)
        return np.fromiter(map(known.__getitem__, found), np.int64, len(found))

    def tidy(self) -> None:
        """Forget words between chunks once there are too many."""
        if self.used > MOST_WORDS:
            self._forget()


def evidence_of(docs: list[np.ndarray], y: np.ndarray, share: float) -> np.ndarray:
    """For each slot: log of how much likelier than `share` a document that holds it is toxic, held back by 4 others."""
    toxic, every = np.zeros((1 + len(PREFIXES), SLOTS)), np.zeros((1 + len(PREFIXES), SLOTS))
    for slots, label in zip(docs, y, strict=True):
        for k in range(1 + len(PREFIXES)):
            own = np.unique(slots[:, k])
            every[k, own] += 1
            toxic[k, own] += label
    return np.log((toxic + 4 * share) / (every + 4) / share).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Fit on the bounded sample of labelled rows that are not held out."""
    learn = fold(key, FOLDS) != HELD_OUT
    sample = labelled_sample(docs, labels, label, learn, MOST_LEARN, key, text)

    def rows(texts: list[bytes]) -> list[tuple]:
        out = []
        for t in texts:
            found = words(t)
            if len(found) > FIT_WORDS:
                runs = -(-len(found) // RUN)
                some = np.sort(np.random.default_rng(crc32(t)).choice(runs, FIT_WORDS // RUN, replace=False))
                found = [w for r in some for w in found[r * RUN : (r + 1) * RUN]]
            out.append((b" ".join(found),))
        return out

    got = sorted(map_texts(sample, rows, "words binary", key, text, ("_label",)).collect(), key=lambda r: r[key])
    model = Model()
    counts = class_counts(labels, label, learn)
    y = np.array([r["_label"] for r in got], np.float32)
    if len(set(y.tolist())) < 2:
        model.constant = counts.get(1, 0) / max(1, sum(counts.values())) if counts else 0.0
        return model
    return fit(model, [r["words"].split(b" ") if r["words"] else [] for r in got], y, counts[1] / (counts[0] + counts[1]))


def fit(model: Model, texts: list[list[bytes]], y: np.ndarray, true_share: float, steps: int = STEPS) -> Model:
    """Fit on the words of each document and its label."""
    draw = np.random.default_rng(3)
    share = float(y.mean())
    known: dict[bytes, int] = {}
    numbers = [np.array([known.setdefault(w, len(known)) for w in t], np.int64) for t in texts]
    vocabulary = list(known)
    slots = np.array([hashes(w) for w in vocabulary], np.int64).reshape(-1, 1 + len(PREFIXES))
    shapes = np.array([shape(w) for w in vocabulary], np.float32).reshape(-1, 3)
    part = draw.permutation(len(y)) % PARTS
    none = len(vocabulary)
    # word inputs of the whole vocabulary by part; the row behind the last word is the padding
    inputs = []
    for k in range(PARTS):
        table = evidence_of([slots[n] for n, p in zip(numbers, part, strict=True) if p != k], y[part != k], share)
        inputs.append(np.concatenate([model.word_inputs(slots, shapes, table), np.zeros((1, WORD_INPUTS), np.float32)]))
    at = [np.append(n, none)[windows(len(n))] for n in numbers]  # (windows, time) by document
    # of a toxic document the most telling window is toxic; of a clean one any window is clean
    best = [int(inputs[p][a][:, :, : 1 + len(PREFIXES)].max(axis=2).sum(axis=1).argmax()) for a, p in zip(at, part, strict=True)]
    adam = Adam(model.w, 0.01)
    for turn in range(ROUNDS):
        left = steps // ROUNDS
        while left > 0:
            picked = [(i, best[i]) for i in range(len(y))]
            picked += [(i, int(draw.integers(len(at[i])))) for i in range(len(y)) if y[i] == 0]
            order = draw.permutation(len(picked))
            for lo in range(0, len(order), BATCH)[:left]:
                some = [picked[j] for j in order[lo : lo + BATCH]]
                where = np.stack([at[i][k] for i, k in some], axis=1)
                x = np.stack([inputs[part[i]][at[i][k]] for i, k in some], axis=1)
                own, local = np.unique(where, return_inverse=True)
                own = own[own < none]  # the padding is the greatest number, so others keep their place
                model.step(x, where < none, np.array([y[i] for i, _ in some]), np.ones(len(some), np.float32), adam, Spelling([vocabulary[i] for i in own]), np.minimum(local.reshape(where.shape), len(own)))
                left -= 1
        if turn + 1 < ROUNDS:
            best = _most_toxic(model, at, part, inputs, vocabulary)
    model.evidence = evidence_of([slots[n] for n in numbers], y, share)
    model.shift = float(np.log(true_share / (1 - true_share)) - np.log(share / (1 - share)))
    model._forget()
    return model


def _most_toxic(model: Model, at: list[np.ndarray], part: np.ndarray, inputs: list[np.ndarray], vocabulary: list[bytes]) -> list[int]:
    """The window of each document that the network finds most toxic."""
    found = np.concatenate([model.character_inputs(Spelling(vocabulary))[0], np.zeros((1, FILTERS), np.float32)])
    best = [0] * len(at)
    for k in range(PARTS):
        x = np.concatenate([inputs[k], found], axis=1)
        forth, back = x @ model.w["Xf"] + model.w["cf"], x @ model.w["Xb"] + model.w["cb"]
        own = [i for i in range(len(at)) if part[i] == k]
        if not own:
            continue
        every = np.concatenate([at[i] for i in own])
        logit = np.concatenate([model.logits(forth[every[lo : lo + BLOCK].T], back[every[lo : lo + BLOCK].T], every[lo : lo + BLOCK].T < len(vocabulary)) for lo in range(0, len(every), BLOCK)])
        start = 0
        for i in own:
            best[i] = int(logit[start : start + len(at[i])].argmax())
            start += len(at[i])
    return best


def score_toxicity(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """key, the `keep` columns, held_out, score and predicted of every whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def rows(texts: list[bytes]) -> list[tuple]:
        found = shared.value.score(texts).tolist()
        shared.value.tidy()
        return [(s, int(s >= THRESHOLD)) for s in found]

    scored = map_texts(docs, rows, "score double, predicted int", key, text, keep)
    return scored.select(key, *keep, (fold(key, FOLDS) == HELD_OUT).alias("held_out"), "score", "predicted")
