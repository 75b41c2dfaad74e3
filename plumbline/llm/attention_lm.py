"""A small causal self-attention language model over subword ids, in numpy.

Words (A-Z lower-cased, split at white space) are cut greedily into the longest entries of a public byte-level
vocabulary of at most PIECE_BYTES bytes; the first piece of a word has an id of its own, so the ids of a text give its
words back. A text is its pieces and one end.

The model: embedding and place, one attention head over a window of WINDOW ids, a feed-forward layer, and a softmax over
CLASSES classes; the most frequent ids are classes of their own, the others share classes by frequency, in which an id
has its share of the training counts. The softmax scales by what attention says the classes' shares behind the
id before; both kinds of counts are those of all training texts. Windows overlap by half: each id is scored once, in
the window that gives it the longer context. All windows of a batch go through the masked attention together.
"""

from __future__ import annotations

import base64
import ctypes
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np

from plumbline.llm.bytescan import LOWER, SPACE, word_hashes

WINDOW, WIDTH, HIDDEN, CLASSES, PIECE_BYTES = 32, 16, 32, 128, 4
_SHARED = 32  # of the classes
STEPS, BATCH, RATE = 300, 192, 4e-3
PASS_BATCH = 1024  # windows of a step of the pass over all texts
_AT_ONCE = 32  # windows that go through the layers together


class Pieces:
    """Dense ids of the vocabulary's short entries; id = 2 * entry + (1 if it starts a word); the last id is the end."""

    def __init__(self, tiktoken_file: str):
        with open(tiktoken_file, "rb") as f:
            entries = {base64.b64decode(a) for a, _ in (line.split() for line in f)}
        short = [e for e in entries if len(e) <= PIECE_BYTES and not any(SPACE[b] or 65 <= b <= 90 for b in e)]
        short = sorted({*short, *(bytes([b]) for b in range(256))})
        self.size = 2 * len(short) + 1
        self.end = self.size - 1
        self.tables = []
        for n in range(1, PIECE_BYTES + 1):
            own = [(int.from_bytes(e, "big"), i) for i, e in enumerate(short) if len(e) == n]
            codes, ids = zip(*sorted(own), strict=True) if own else ((), ())
            self.tables.append((np.array(codes, dtype=np.int64), np.array(ids, dtype=np.int32)))

    def cut(self, chars: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words chars[start:end] one after another, and the number of each word's ids."""
        n = len(starts)
        padded = np.concatenate([chars, np.zeros(PIECE_BYTES, dtype=np.uint8)])
        at, active = starts.astype(np.int64).copy(), np.arange(n)
        steps: list[tuple[np.ndarray, np.ndarray]] = []
        while len(active):
            here, left = at[active], ends[active] - at[active]
            code = padded[here].astype(np.int64)
            codes = [code]
            for k in range(1, PIECE_BYTES):
                code = code << 8 | padded[here + k]
                codes.append(code)
            ids, took = np.empty(len(active), dtype=np.int32), np.zeros(len(active), dtype=np.int64)
            for k in range(PIECE_BYTES, 0, -1):
                table, of = self.tables[k - 1]
                try_ = np.flatnonzero((took == 0) & (left >= k))
                if not len(try_) or not len(table):
                    continue
                want = codes[k - 1][try_]
                slot = np.minimum(np.searchsorted(table, want), len(table) - 1)
                hit = table[slot] == want
                ids[try_[hit]], took[try_[hit]] = of[slot[hit]], k
            steps.append((active, 2 * ids + (1 if not steps else 0)))
            at[active] += took
            active = active[at[active] < ends[active]]
        counts = np.zeros(n, dtype=np.int64)
        for a, _ in steps:
            counts[a] += 1
        first = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), dtype=np.int32)
        for k, (a, ids) in enumerate(steps):
            out[first[a] + k] = ids
        return out, counts


def distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct hashes in order, a place of each, and the number of each hash's own."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = ordered[1:] != ordered[:-1]
    of = np.empty(len(hashes), dtype=np.int64)
    of[order] = np.cumsum(new) - 1
    return ordered[new], order[new], of


def tokenized(texts: list[bytes], pieces: Pieces) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(word hashes, words of each text, ids with an end behind each text, ids of each text) of whole texts."""
    hashes, n_words = word_hashes(texts)
    return hashes, n_words, *cut_words(texts, pieces, n_words, *distinct(hashes)[1:])


def cut_words(texts: list[bytes], pieces: Pieces, n_words: np.ndarray, first: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of ``tokenized``, and their number in each text, from a place of each distinct word and each word's distinct one."""
    joined = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    flags = np.ones(len(joined) + 1, dtype=np.int8)
    flags[1:] = SPACE[joined]
    step = np.diff(flags)
    starts, ends = np.flatnonzero(step == -1), np.flatnonzero(step == 1)
    ids, n_ids = pieces.cut(joined, starts[first], ends[first])
    begin = np.cumsum(n_ids) - n_ids
    n = n_ids[of]
    text_of = np.repeat(np.arange(len(texts)), n_words)
    per_text = np.bincount(text_of, weights=n, minlength=len(texts)).astype(np.int64) + 1
    out = np.full(int(per_text.sum()), pieces.end, dtype=np.int32)
    place = np.arange(int(n.sum())) + np.repeat(text_of, n)  # one end behind each text before
    out[place] = ids[np.repeat(begin[of] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
    return out, per_text


@dataclass
class Classes:
    """Class of each id and the log share of the id in its class, from counts of all training texts."""

    of: np.ndarray
    log_share: np.ndarray

    @staticmethod
    def fit(counts: np.ndarray) -> "Classes":
        """The rarer ids share classes by frequency; ids that start words (odd) and others do not mix."""
        order = np.argsort(-counts, kind="stable")
        single = min(CLASSES - _SHARED, len(counts))
        of = np.empty(len(counts), dtype=np.int32)
        of[order[:single]] = np.arange(single)
        rest = order[single:]
        for odd in (0, 1):
            part = rest[rest % 2 == odd]
            mass = np.cumsum(counts[part] + 1.0)
            if len(part):
                of[part] = single + odd * (_SHARED // 2) + np.minimum((mass / mass[-1] * (_SHARED // 2)).astype(np.int32), _SHARED // 2 - 1)
        weight = counts + 1.0
        total = np.bincount(of, weights=weight, minlength=CLASSES)
        return Classes(of, np.log(weight / total[of]))


def pair_counts(classes: Classes, inputs: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """How often each class stood behind each id: (ids, CLASSES)."""
    size = len(classes.of)
    return np.bincount(inputs.astype(np.int64) * CLASSES + classes.of[ids], minlength=size * CLASSES).reshape(size, CLASSES)


def follow_table(classes: Classes, id_counts: np.ndarray, pairs: np.ndarray, prior: float = 20.0) -> np.ndarray:
    """Share of each class behind an id, smoothed by the classes' own shares."""
    own = np.bincount(classes.of, weights=id_counts + 1.0, minlength=CLASSES) + 1e-3
    own /= own.sum()
    out = np.empty(pairs.shape, dtype=np.float32)
    for s in range(0, len(pairs), 1024):
        part = pairs[s : s + 1024] + prior * own
        out[s : s + 1024] = part / part.sum(axis=1, keepdims=True)
    return out


def first_weights(size: int, seed: int = 5) -> dict[str, np.ndarray]:
    r = np.random.default_rng(seed)
    m = lambda a, b, s=1.0: (r.standard_normal((a, b)) * s / np.sqrt(a)).astype(np.float32)
    return {
        "emb": (r.standard_normal((size, WIDTH)) * 0.3).astype(np.float32),
        "pos": (r.standard_normal((WINDOW, WIDTH)) * 0.1).astype(np.float32),
        "q": m(WIDTH, WIDTH), "k": m(WIDTH, WIDTH), "v": m(WIDTH, WIDTH), "o": m(WIDTH, WIDTH, 0.5),
        "w1": m(WIDTH, HIDDEN), "w2": m(HIDDEN, WIDTH, 0.5), "out": m(WIDTH, CLASSES, 0.1),
    }


_CAUSAL = np.tril(np.ones((WINDOW, WINDOW), dtype=np.float32))


def _times(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w for many small matrices x, as one product."""
    return (x.reshape(-1, x.shape[-1]) @ w).reshape(*x.shape[:-1], w.shape[1])


def _back(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """x @ w.T, as ``_times``; the copy is small, and products with it are faster."""
    return _times(x, np.ascontiguousarray(w.T))


def _row_sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis, kept; a product is faster than a sum of short rows."""
    return _times(x, np.ones((x.shape[-1], 1), dtype=x.dtype))


def _hidden(w: dict[str, np.ndarray], ids: np.ndarray, first: int) -> tuple[np.ndarray, ...]:
    """What the gradients need of the layers below the softmax at places first.. of windows ``ids``; the last is its input."""
    x = w["emb"].take(ids, axis=0)
    x += w["pos"]
    xq = np.ascontiguousarray(x[:, first:])
    q, kv = _times(xq, w["q"] * np.asarray(WIDTH**-0.5, dtype=w["q"].dtype)), _times(x, np.concatenate([w["k"], w["v"]], axis=1))
    k, v = kv[..., :WIDTH], kv[..., WIDTH:]
    s = np.matmul(q, k.transpose(0, 2, 1))
    np.minimum(s, 60, out=s)
    np.exp(s, out=s)
    s *= _CAUSAL[first:]
    s /= _row_sums(s)
    a = np.matmul(s, v)
    h = _times(a, w["o"])
    h += xq
    z = _times(h, w["w1"])
    np.maximum(z, 0, out=z)
    y = _times(z, w["w2"])
    y += h
    return x, q, k, v, s, a, h, z, y


def forward(w: dict[str, np.ndarray], follow: np.ndarray, ids: np.ndarray, first: int, keep: bool = False):
    """Unnormalised class weights behind places first.. of windows ``ids`` (windows, WINDOW), and their sums.

    ``follow`` (ids, CLASSES) is the share of each class behind an id in the training counts; attention scales it.
    With ``keep`` also what the gradients need.
    """
    kept = _hidden(w, ids, first)
    p = _times(kept[-1], w["out"])
    np.exp(p, out=p)
    p *= follow.take(ids[:, first:], axis=0)
    total = _row_sums(p)[..., 0]
    return (p, total, kept) if keep else (p, total)


def log_shares(w: dict[str, np.ndarray], follow: np.ndarray, ids: np.ndarray, first: int, target: np.ndarray) -> np.ndarray:
    """Log probability of the class ``target`` behind each of the places first.. of windows ``ids``."""
    p = _times(_hidden(w, ids, first)[-1], w["out"]).reshape(-1, CLASSES)
    np.exp(p, out=p)
    share = follow.take(ids[:, first:].ravel(), axis=0)
    at = np.arange(target.size) * CLASSES + target.ravel()
    return np.log(p.ravel()[at] * share.ravel()[at] / np.vecdot(p, share)).reshape(target.shape)


def gradients(w: dict[str, np.ndarray], follow: np.ndarray, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Loss (mean over weights) and gradients for windows and their targets' classes.

    The windows are taken a few at a time, so that what lies between the layers stays in the processor's cache.
    """
    total = max(float(weight.sum()), 1.0)
    loss, g, dx = 0.0, {}, np.empty((*ids.shape, WIDTH), dtype=w["emb"].dtype)
    for s in range(0, len(ids), _AT_ONCE):
        own = slice(s, s + _AT_ONCE)
        part, more, dx[own] = _part_gradients(w, follow, ids[own], target[own], weight[own] / total)
        loss += part
        for name, t in more.items():
            if name in g:
                g[name] += t
            else:
                g[name] = t
    g["emb"] = np.zeros_like(w["emb"])
    order = np.argsort(ids.ravel().astype(np.uint16 if len(w["emb"]) <= 1 << 16 else np.uint32), kind="stable")
    sorted_ids = ids.ravel()[order]
    head = np.flatnonzero(np.concatenate([[True], sorted_ids[1:] != sorted_ids[:-1]]))
    g["emb"][sorted_ids[head]] = np.add.reduceat(dx.reshape(-1, WIDTH).take(order, axis=0), head, axis=0)
    return loss, g


def _part_gradients(w: dict[str, np.ndarray], follow: np.ndarray, ids: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray], np.ndarray]:
    """Loss and gradients of some windows, weighted; last that of the windows' embeddings, place by place."""
    p, sums, (x, q, k, v, s, a, h, z, y) = forward(w, follow, ids, 0, keep=True)
    flat = lambda t: t.reshape(-1, t.shape[-1])
    at = np.arange(target.size) * CLASSES + target.ravel()
    got = p.ravel()[at] / sums.ravel()
    loss = float(-(np.log(np.maximum(got, 1e-30)) * weight.ravel()).sum(dtype=np.float64))
    p.ravel()[at] -= sums.ravel()  # the gradient of the logits is scale * p
    scale = (weight.astype(p.dtype) / sums)[..., None]
    g = {"out": flat(y * scale).T @ flat(p)}
    dy = _times(p, w["out"].T)
    dy *= scale
    g["w2"] = flat(z).T @ flat(dy)
    dz = _back(dy, w["w2"])
    dz *= z > 0
    g["w1"] = flat(h).T @ flat(dz)
    dh = _back(dz, w["w1"])
    dh += dy
    g["o"] = flat(a).T @ flat(dh)
    da = _back(dh, w["o"])
    dqkv = np.empty((*ids.shape, 3 * WIDTH), dtype=p.dtype)
    dq, dk, dv = (dqkv[..., i * WIDTH : (i + 1) * WIDTH] for i in range(3))
    np.matmul(s.transpose(0, 2, 1), da, out=dv)
    ds = np.matmul(da, v.transpose(0, 2, 1))
    ds -= _row_sums(da * a)
    ds *= s
    np.matmul(ds, k, out=dq)
    np.matmul(ds.transpose(0, 2, 1), q, out=dk)
    by_weight, scaled = flat(x).T @ flat(dqkv), np.asarray(WIDTH**-0.5, dtype=p.dtype)
    for i, name in enumerate("qkv"):
        g[name] = by_weight[:, i * WIDTH : (i + 1) * WIDTH]
    g["q"] *= scaled
    dx = _back(dqkv, np.concatenate([w["q"] * scaled, w["k"], w["v"]], axis=1))
    dx += dh
    g["pos"] = dx.sum(axis=0)
    return loss, g, dx


def windows(n_ids: np.ndarray, overlap: int = WINDOW // 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, whether it is the text's first) of the windows over texts of so many ids."""
    step = WINDOW - overlap
    n = np.maximum(-(-(n_ids - WINDOW) // step), 0) + 1
    text = np.repeat(np.arange(len(n_ids)), n)
    k = np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)
    return text, k * step, k == 0


def shifted(ids: np.ndarray, n_ids: np.ndarray, end: int) -> np.ndarray:
    """The ids shifted by one: each text's start is an end."""
    out = np.empty_like(ids)
    out[1:] = ids[:-1]
    if len(ids):
        out[np.cumsum(n_ids) - n_ids] = end
    return out


@contextmanager
def one_thread():
    """NumPy's OpenBLAS works in the calling thread alone meanwhile; another library keeps its own number of threads.

    Spark allows a worker as many threads as its executor has cores. On matrices as small as these the others mostly
    wait, at full load, for the next one.
    """
    before = []
    try:
        with open("/proc/self/maps") as f:
            paths = {line.split(maxsplit=5)[-1].strip() for line in f if "openblas" in line}
        for path in sorted(paths):
            lib = ctypes.CDLL(path)
            for name in ("scipy_openblas_%s_num_threads64_", "scipy_openblas_%s_num_threads", "openblas_%s_num_threads64_", "openblas_%s_num_threads"):
                if hasattr(lib, name % "set"):
                    put = getattr(lib, name % "set")
                    before.append((put, getattr(lib, name % "get")()))
                    put(1)
                    break
    except OSError:  # no such table of the process, or a library that cannot be opened by its path
        pass
    try:
        yield
    finally:
        for put, n in before:
            put(n)


class Adam:
    """Steps of Adam on the weights ``w``, in place."""

    def __init__(self, w: dict[str, np.ndarray]):
        self.w, self.t = w, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in w.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], rate: float) -> None:
        self.t += 1
        m, v, t = self.m, self.v, self.t
        for k, x in g.items():
            m[k] += (x - m[k]) * np.float32(0.1)
            v[k] += (x * x - v[k]) * np.float32(0.01)
            self.w[k] -= np.float32(rate) * (m[k] / np.float32(1 - 0.9**t)) / (np.sqrt(v[k] / np.float32(1 - 0.99**t)) + np.float32(1e-8))


def train(ids: np.ndarray, n_ids: np.ndarray, classes: Classes, follow: np.ndarray, size: int, steps: int = STEPS, seed: int = 11) -> dict[str, np.ndarray]:
    """Weights after so many steps of Adam over windows of the given texts."""
    w = first_weights(size)
    if not len(ids):
        return w
    inputs, base = shifted(ids, n_ids, size - 1), np.cumsum(n_ids) - n_ids
    text, start, _ = windows(n_ids, overlap=0)
    r = np.random.default_rng(seed)
    adam = Adam(w)
    for t in range(1, steps + 1):
        pick = r.integers(0, len(text), BATCH)
        at = start[pick][:, None] + np.arange(WINDOW)
        inside = at < n_ids[text[pick]][:, None]
        at = np.minimum(at, n_ids[text[pick]][:, None] - 1) + base[text[pick]][:, None]
        _, g = gradients(w, follow, inputs[at], classes.of[ids[at]], inside.astype(np.float32))
        adam.step(g, RATE * min(1.0, 2 * (1 - t / (steps + 1))))
    return w


@one_thread()
def train_on_all(adam: Adam, ids: np.ndarray, n_ids: np.ndarray, classes: Classes, follow: np.ndarray, r: np.random.Generator) -> int:
    """Takes every window of the texts once, in a random order; returns how many there were."""
    if not len(ids):
        return 0
    inputs, base, targets = shifted(ids, n_ids, len(classes.of) - 1).astype(np.intp), np.cumsum(n_ids) - n_ids, classes.of[ids]
    text, start, _ = windows(n_ids, overlap=0)
    some = n_ids[text] > 0
    text, start = text[some], start[some]
    order = r.permutation(len(text))
    for s in range(0, len(order), PASS_BATCH):
        own = order[s : s + PASS_BATCH]
        at = start[own][:, None] + np.arange(WINDOW)
        length = n_ids[text[own]][:, None]
        inside = at < length
        at = np.minimum(at, length - 1) + base[text[own]][:, None]
        _, g = gradients(adam.w, follow, inputs[at], targets[at], inside.astype(np.float32))
        adam.step(g, RATE / 4)
    return len(order)


@one_thread()
def score(w: dict[str, np.ndarray], classes: Classes, follow: np.ndarray, ids: np.ndarray, n_ids: np.ndarray) -> np.ndarray:
    """Log probability of each text (natural), every id scored once."""
    out = np.zeros(len(n_ids))
    if not len(ids):
        return out
    inputs, base, targets = shifted(ids, n_ids, len(classes.of) - 1).astype(np.intp), np.cumsum(n_ids) - n_ids, classes.of[ids]
    share = np.bincount(np.repeat(np.arange(len(n_ids)), n_ids), weights=classes.log_share[ids], minlength=len(n_ids))
    text, start, head = windows(n_ids)
    got = np.zeros(len(text))
    for first, chosen in ((0, np.flatnonzero(head)), (WINDOW // 2, np.flatnonzero(~head))):
        at_once = _AT_ONCE * WINDOW // (WINDOW - first)
        for s in range(0, len(chosen), at_once):
            own = chosen[s : s + at_once]
            at = start[own][:, None] + np.arange(WINDOW)
            length = n_ids[text[own]][:, None]
            scored = at[:, first:] < length
            np.minimum(at, length - 1, out=at)
            at += base[text[own]][:, None]
            value = log_shares(w, follow, inputs[at], first, targets[at[:, first:]])
            got[own] = (value * scored).sum(axis=1, dtype=np.float64)
    return np.bincount(text, weights=got, minlength=len(n_ids)) + share
