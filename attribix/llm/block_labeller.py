"""Recurrent block labeller: a bidirectional LSTM in numpy over the leaf blocks of a page.

A block is read as the sum of learned vectors of its hashed path tokens and of its nearest element's, the mean of learned
vectors of its hashed words, and a few numbers on its shape. One LSTM reads the blocks of the page from the first to the
last, the other from the last to the first; the score of a block is a logistic function of both states there, so it rests
on the whole page. Nothing is cut: a page of any number of blocks is one sequence.

The model is fitted on ``TRAIN_PAGES`` composed pages (:mod:`page_templates`), by Adam over padded batches. The seed is
fixed, so every session fits the same model.
"""

from __future__ import annotations

import zlib
from functools import lru_cache
from itertools import chain

import numpy as np

from .html_blocks import Block, blocks
from .page_templates import composed

PATH_BUCKETS, WORD_BUCKETS = 2048, 4096
PATH_SIZE, WORD_SIZE, STATE = 24, 12, 20
SHAPE = 7
TRAIN_PAGES, EPOCHS, BATCH, RATE, SEED = 2400, 4, 16, 0.01, 11
#: Share of path tokens and of words left out at random while fitting.
DROPPED = 0.1
#: Blocks of one padded batch when scoring, besides one page.
HELD = 1 << 14
REMEMBERED = 200_000

_buckets: dict[str, int] = {}


def _word_bucket(word: str) -> int:
    found = zlib.crc32(word.encode(errors="replace")) % WORD_BUCKETS
    if len(_buckets) < REMEMBERED:
        _buckets[word] = found
    return found


def _word_buckets(text: str) -> list[int]:
    """Bucket of each distinct word."""
    words = set(text.lower().split())
    found = list(map(_buckets.get, words))
    return [_word_bucket(w) if k is None else k for k, w in zip(found, words, strict=True)] if None in found else found


@lru_cache(1 << 14)
def _path_buckets(path: tuple[str, ...], leaf: tuple[str, ...]) -> tuple[int, ...]:
    of = lambda t: zlib.crc32(t.encode(errors="replace")) % PATH_BUCKETS
    return tuple(dict.fromkeys([*(of("above " + t) for t in path), *(of("leaf " + t) for t in leaf)])) or (of("none"),)


def forget() -> None:
    _buckets.clear()
    _path_buckets.cache_clear()


def features(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Path buckets and how many of each block, word buckets and how many, and the shape numbers."""
    paths = [_path_buckets(b.path, b.leaf) for b in page]
    words = [sorted(_word_buckets(b.text)) for b in page]  # sorted, as sums of floats depend on the order
    size = np.array([len(b.text) for b in page], float)
    n_words = np.array([b.text.count(" ") + 1 for b in page], float)
    linked = np.array([b.linked for b in page], float)
    ends = np.array([b.text[-1] in ".!?" for b in page], float)
    digits = np.array([sum(map(b.text.count, "0123456789")) if len(b.text) < 200 else 0 for b in page], float)
    commas = np.array([b.text.count(",") + b.text.count(".") for b in page], float)
    place = np.arange(len(page)) / max(1, len(page) - 1)
    shape = np.stack([np.log1p(size) / 5, np.log1p(n_words) / 4, linked / size, ends, digits / size, commas / n_words, place], 1)
    flat = lambda x: np.fromiter(chain.from_iterable(x), np.int64)
    lengths = lambda x: np.array([len(row) for row in x], np.int64)
    return flat(paths), lengths(paths), flat(words), lengths(words), shape.astype(np.float32)


def _sums(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Sum of the table rows of each block; no block is without one. Long lists go in steps, so memory is bounded."""
    out = np.empty((len(sizes), table.shape[1]), np.float32)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] - sizes[lo] + step, "right")))
        a = int(ends[lo] - sizes[lo])
        out[lo:hi] = np.add.reduceat(table[rows[a : int(ends[hi - 1])]], ends[lo:hi] - sizes[lo:hi] - a, axis=0)
        lo = hi
    return out


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _run(x: np.ndarray, recurrent: np.ndarray, kept: list | None = None) -> np.ndarray:
    """States (steps, pages, STATE) from the gates' inputs (steps, pages, 4 STATE)."""
    steps, pages, _ = x.shape
    h = np.zeros((pages, STATE), np.float32)
    c = np.zeros((pages, STATE), np.float32)
    out = np.empty((steps, pages, STATE), np.float32)
    for t in range(steps):
        z = x[t] + h @ recurrent
        gate = _sigmoid(z[:, : 3 * STATE])
        new = np.tanh(z[:, 3 * STATE :])
        before = c
        c = gate[:, STATE : 2 * STATE] * before + gate[:, :STATE] * new
        shown = np.tanh(c)
        if kept is not None:
            kept.append((gate, new, before, shown, h))
        h = gate[:, 2 * STATE :] * shown
        out[t] = h
    return out


def _back(dh_out: np.ndarray, kept: list, recurrent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gates' inputs and of the recurrent weights."""
    steps, pages, _ = dh_out.shape
    dx = np.empty((steps, pages, 4 * STATE), np.float32)
    grad = np.zeros_like(recurrent)
    dh = np.zeros((pages, STATE), np.float32)
    dc = np.zeros((pages, STATE), np.float32)
    for t in range(steps - 1, -1, -1):
        gate, new, before, shown, h = kept[t]
        into, keep, show = gate[:, :STATE], gate[:, STATE : 2 * STATE], gate[:, 2 * STATE :]
        dh = dh + dh_out[t]
        dc = dc + dh * show * (1 - shown * shown)
        dz = np.concatenate(
            [dc * new * into * (1 - into), dc * before * keep * (1 - keep), dh * shown * show * (1 - show), dc * into * (1 - new * new)], 1)
        dx[t] = dz
        grad += h.T @ dz
        dh = dz @ recurrent.T
        dc = dc * keep
    return dx, grad


class Labeller:
    """Weights of the model: vectors of path tokens and words, input and recurrent weights of both readers, and the score."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def new(cls, seed: int) -> Labeller:
        rng = np.random.default_rng(seed)
        size = PATH_SIZE + WORD_SIZE + SHAPE
        make = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        weights = {"path": make(PATH_BUCKETS, PATH_SIZE, scale=0.1), "word": make(WORD_BUCKETS, WORD_SIZE, scale=0.1)}
        for way in ("on", "back"):
            bias = np.zeros(4 * STATE, np.float32)
            bias[STATE : 2 * STATE] = 1  # remember at first
            weights |= {f"in_{way}": make(size, 4 * STATE, scale=size**-0.5), f"bias_{way}": bias, f"again_{way}": make(STATE, 4 * STATE, scale=STATE**-0.5)}
        return cls(weights | {"score": make(2 * STATE, 1, scale=STATE**-0.5), "score_bias": np.zeros(1, np.float32)})

    def vectors(self, made) -> np.ndarray:
        paths, n_paths, words, n_words, shape = made
        return np.concatenate([
            _sums(self.weights["path"], paths, n_paths),
            _sums(self.weights["word"], words, n_words) / n_words[:, None].astype(np.float32), shape], 1)

    def forward(self, vectors: np.ndarray, lengths: np.ndarray, kept: dict | None = None) -> np.ndarray:
        """Score of every block, all pages in a row."""
        pages, steps = len(lengths), int(lengths.max())
        page = np.repeat(np.arange(pages), lengths)
        at = np.arange(len(vectors)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        turned = np.repeat(lengths, lengths) - 1 - at
        states = []
        for way, place in (("on", at), ("back", turned)):
            x = np.zeros((steps, pages, 4 * STATE), np.float32)
            x[place, page] = vectors @ self.weights[f"in_{way}"] + self.weights[f"bias_{way}"]
            steps_kept = [] if kept is not None else None
            states.append(_run(x, self.weights[f"again_{way}"], steps_kept)[place, page])
            if kept is not None:
                kept[way] = (place, page, steps_kept)
        both = np.concatenate(states, 1)
        if kept is not None:
            kept["both"], kept["shape"] = both, (steps, pages)
        return _sigmoid(both @ self.weights["score"] + self.weights["score_bias"])[:, 0]

    def gradients(self, made, lengths: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean log loss."""
        w, kept = self.weights, {}
        vectors = self.vectors(made)
        off = ((self.forward(vectors, lengths, kept) - wanted) / len(wanted)).astype(np.float32)[:, None]
        grad = {"score": kept["both"].T @ off, "score_bias": off.sum(0)}
        d_both = off @ w["score"].T
        d_vectors = np.zeros_like(vectors)
        for k, way in enumerate(("on", "back")):
            place, page, steps_kept = kept[way]
            dh = np.zeros((*kept["shape"], STATE), np.float32)
            dh[place, page] = d_both[:, k * STATE : (k + 1) * STATE]
            dx, grad[f"again_{way}"] = _back(dh, steps_kept, w[f"again_{way}"])
            dx = dx[place, page]
            grad[f"in_{way}"], grad[f"bias_{way}"] = vectors.T @ dx, dx.sum(0)
            d_vectors += dx @ w[f"in_{way}"].T
        paths, n_paths, words, n_words, _ = made
        grad["path"], grad["word"] = np.zeros_like(w["path"]), np.zeros_like(w["word"])
        np.add.at(grad["path"], paths, np.repeat(d_vectors[:, :PATH_SIZE], n_paths, 0))
        d_words = d_vectors[:, PATH_SIZE : PATH_SIZE + WORD_SIZE] / n_words[:, None].astype(np.float32)
        np.add.at(grad["word"], words, np.repeat(d_words, n_words, 0))
        return grad

    def scores(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Probability that each block belongs to the article. Pages of like lengths run together, so little is padding."""
        out: list[np.ndarray] = [np.zeros(0, np.float32)] * len(pages)
        order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
        while order:
            n = 1
            while n < len(order) and (n + 1) * len(pages[order[n]]) <= HELD:
                n += 1
            batch, order = order[:n], order[n:]
            lengths = np.array([len(pages[i]) for i in batch])
            found = self.forward(self.vectors(_joined([features(pages[i]) for i in batch])), lengths)
            for i, part in zip(batch, np.split(found, np.cumsum(lengths)[:-1]), strict=True):
                out[i] = part
        return out


def _joined(parts) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def labelled(page: list[tuple[str, bool]]) -> tuple[list[Block], np.ndarray]:
    """Blocks of a composed page and their labels: a private mark in the text says which piece a block comes from."""
    marked = "".join(_mark(text, good) for text, good in page)
    found = blocks(marked)
    good = np.array([YES in b.text for b in found], np.float32)
    clean = [b._replace(text=" ".join(b.text.replace(YES, "").split()) or "x") for b in found]
    return clean, good


#: A character of private use; texts of composed pages hold none.
YES = "\ue000"


def _mark(text: str, good: bool) -> str:
    """The piece with a mark after each tag that text follows, if it belongs to the article."""
    if not good:
        return text
    out, at = [], 0
    while (stop := text.find(">", at)) >= 0:
        out.append(text[at : stop + 1])
        if stop + 1 < len(text) and text[stop + 1] not in "<\n":
            out.append(YES)
        at = stop + 1
    return "".join(out) + text[at:]


def _thinned(made, rng: np.random.Generator):
    """Features with some path tokens and words left out; each block keeps at least one of both."""
    paths, n_paths, words, n_words, shape = made

    def thin(values, sizes):
        keep = rng.random(len(values)) >= DROPPED
        keep[np.cumsum(sizes) - sizes] = True
        left = np.add.reduceat(keep.astype(np.int64), np.cumsum(sizes) - sizes)
        return values[keep], left

    return (*thin(paths, n_paths), *thin(words, n_words), shape)


def fitted(pages: int = TRAIN_PAGES, epochs: int = EPOCHS, seed: int = SEED) -> Labeller:
    """A labeller fitted on composed pages."""
    rng = np.random.default_rng(seed)
    examples = []
    for page in composed(pages, seed):
        found, good = labelled(page)
        examples.append((features(found), len(found), good))
    model = Labeller.new(seed)
    first = {k: np.zeros_like(v) for k, v in model.weights.items()}
    second = {k: np.zeros_like(v) for k, v in model.weights.items()}
    steps = epochs * -(-len(examples) // BATCH)
    done = 0
    for _ in range(epochs):
        # Batches of like lengths, in random order.
        order = np.argsort([n + rng.random() * 8 for _, n, _ in examples])
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for k in rng.permutation(len(batches)):
            part = [examples[i] for i in batches[k]]
            made = _thinned(_joined([f for f, _, _ in part]), rng)
            grad = model.gradients(made, np.array([n for _, n, _ in part]), np.concatenate([g for _, _, g in part]))
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grad.values())))
            rate, done = RATE * (1 - done / steps), done + 1
            for name, g in grad.items():
                g = g * min(1.0, 1.0 / max(norm, 1e-9))
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.99 * second[name] + 0.01 * g * g
                step = first[name] / (1 - 0.9**done) / (np.sqrt(second[name] / (1 - 0.99**done)) + 1e-8)
                model.weights[name] = (model.weights[name] - rate * step).astype(np.float32)
    return model


@lru_cache(1)
def labeller() -> Labeller:
    """The session's model."""
    return fitted()
