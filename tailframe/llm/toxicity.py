"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained and run in numpy.

Each word is read as a sequence of bytes by a small convolution, beside a vector of its own; both are trained with the recurrent part.
"""

from __future__ import annotations

import pickle
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import loaded, text_batches

#: Words in a window, and words between the starts of windows that are scored and that are learnt from; the last window ends with the text. Every run of
#: WINDOW - STRIDE + 1 words lies whole in a window, wherever it stands.
WINDOW, STRIDE, FIT_STRIDE = 32, 16, 24
#: Labelled texts that the fit may use, of each label, and the longest of them in code points. The sample is taken by a hash of the id.
FIT_TOXIC, FIT_CLEAN, FIT_CHARS = 900, 1800, 30_000
HIDDEN, WORD_DIM, ATTEND = 8, 6, 4
#: The character reader: size of a byte's vector, bytes that a filter sees, filters.
BYTE_DIM, WIDTH, FILTERS = 8, 8, 32
#: Batches of words for the reader's start and their size; passes over the texts' windows after it and the size of their batches.
WORD_STEPS, WORD_BATCH, EPOCHS, BATCH, SEED = 1200, 1024, 12, 64, 11
#: Rates of the start, of the recurrent part and of the reader under it; weight of words that one text has.
WORD_RATE, RATE, READER_RATE, ONCE = 0.003, 0.005, 0.003, 0.3
#: Word logit from which the recurrent part begins to take notice, and how steeply.
FLOOR, GAIN = 3.0, 0.7
#: Words in fewer texts have no vector of their own; a longer run without white space is read as several words.
WORD_TEXTS, WORD_CHARS = 4, 40
#: Where between the largest logits of clean and toxic texts that were learnt from the threshold lies at least.
TOXIC_SIDE = 0.7
#: Windows of a text that the fit looks at, of the highest word logits and at random.
TOP_WINDOWS, SOME_WINDOWS = 6, 6
#: Distinct words that the reader's start takes at most; words whose projected inputs a worker keeps; words that it takes at once (a multiple of
#: STRIDE), and windows that it runs at once. Memory follows from these, whatever the texts' number, length and variety.
FIT_WORDS, CACHE, SEGMENT, WINDOWS = 120_000, 60_000, 16_000, 1024
#: From so many code points a text's words are taken one after the other instead of all at once.
LONG = 1 << 20
#: Characters of words that are read at once, about; what every filter says of each takes 130 bytes twice.
READ_BYTES = 50_000
THRESHOLD = 0.5
STRIP = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def words_of(text: str | None) -> list[str]:
    """Lower-case runs without white space, longer ones in pieces of WORD_CHARS, so that a text without spaces is many words too."""
    words = (text or "").lower().split()
    if words and max(map(len, words)) > WORD_CHARS:
        words = [w[i : i + WORD_CHARS] for w in words for i in range(0, len(w), WORD_CHARS)]
    return words


def runs_of(text: str | None) -> Iterator[list[str]]:
    """The words in runs of SEGMENT to twice as many and some more, so that the windows of the runs are the windows of the text."""
    if text is None or len(text) < LONG:
        words = words_of(text)
        if len(words) <= SEGMENT:
            yield words
            return
        stream = iter(words)
    else:
        stream = (w for m in re.finditer(r"\S+", text) for w in words_of(m.group()))
    more = WINDOW - STRIDE
    run = list(islice(stream, SEGMENT + more))
    while True:
        ahead = list(islice(stream, SEGMENT))
        if len(ahead) < SEGMENT:
            yield run + ahead
            return
        yield run
        run = run[SEGMENT:] + ahead


def byte_codes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of all words' bytes (0 padding, 1 a word's begin, 2 its end, a byte plus 3), where each filter's look
    begins (as many for a word as it has bytes), and the number of each word's first look."""
    raw = [w.encode() for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    owner = np.repeat(np.arange(len(raw)), size)
    at = np.arange(int(size.sum())) + (WIDTH - 1) * owner
    codes = np.zeros(int(size.sum()) + (WIDTH - 1) * len(raw), dtype=np.int64)
    codes[at + 1] = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.int64) + 3
    begin = first + (WIDTH - 1) * np.arange(len(raw))
    codes[begin] = 1
    codes[begin + size + 1] = 2
    return codes, at, first


def looks(p: dict, codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """What every filter says at every place: a convolution over byte vectors, by a table for each byte and offset."""
    out = np.repeat(p["fb"][None, :], len(at), axis=0)
    for k in range(WIDTH):
        out += (p["bytes"] @ p["filters"][k])[codes[at + k]]
    return out


def read_words(p: dict, words: list[str]) -> np.ndarray:
    """The reader: of each word, every filter's largest value over its bytes, not below 0."""
    out = np.zeros((len(words), FILTERS), dtype=np.float32)
    i = 0
    while i < len(words):
        j, size = i, 0
        while j < len(words) and size < READ_BYTES:
            size += len(words[j])
            j += 1
        codes, at, first = byte_codes(words[i:j])
        out[i:j] = np.maximum(np.maximum.reduceat(looks(p, codes, at), first, axis=0), 0)
        i = j
    return out


def reader_gradients(p: dict, words: list[str], dtop: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the reader's parameters from those of its output."""
    codes, at, first = byte_codes(words)
    value = looks(p, codes, at)
    top = np.maximum.reduceat(value, first, axis=0)
    size = np.diff(np.append(first, len(at)))
    place, f = np.nonzero((value == np.repeat(top, size, axis=0)) & (value > 0))
    d = np.repeat(dtop, size, axis=0)[place, f]
    g = {"fb": np.bincount(f, d, FILTERS).astype(np.float32), "bytes": np.zeros_like(p["bytes"]), "filters": np.zeros_like(p["filters"])}
    for k in range(WIDTH):
        table = np.bincount(codes[at[place] + k] * FILTERS + f, d, len(p["bytes"]) * FILTERS).reshape(-1, FILTERS).astype(np.float32)
        g["filters"][k] = p["bytes"].T @ table
        g["bytes"] += table @ p["filters"][k].T
    return g


@dataclass
class Network:
    """Parameters. Word rows: 0 is padding, 1 any word without a row."""

    vocabulary: dict[str, int]
    p: dict[str, np.ndarray]
    scale: tuple[float, float] = (1.0, 0.0)
    known: dict[str, int] = field(default_factory=dict)
    inputs: np.ndarray | None = None
    used: int = 0

    def project(self, words: list[str]) -> np.ndarray:
        """Inputs of both directions' gates for distinct words: word vector and what the reader says, times the weights."""
        own = self.p["words"][[self.vocabulary.get(w, 1) for w in words]]
        return np.concatenate([own, read_words(self.p, words)], axis=1) @ self.p["W"] + self.p["b"][:, None]

    def forget(self) -> None:
        self.known, self.used = {}, 1
        if self.inputs is None:
            self.inputs = np.zeros((2, CACHE + 1, 3 * HIDDEN), dtype=np.float32)

    def learn(self, new: set[str]) -> None:
        """Projects new words and gives them rows of ``inputs``. Words that differ in the punctuation around them share a row."""
        forms: dict[str, int] = {}
        bare = [w.strip(STRIP) or w for w in new]
        for w in bare:
            forms.setdefault(w, len(forms))
        self.inputs[:, self.used : self.used + len(forms)] = self.project(list(forms))
        self.known.update((u, self.used + forms[w]) for u, w in zip(new, bare, strict=True))
        self.used += len(forms)

    def logits(self, texts: Iterable[str | None]) -> np.ndarray:
        """The largest logit of any window of each text. Runs of words are gathered until they are SEGMENT, read together, and run."""
        if self.inputs is None:
            self.forget()
        top: list[float] = []
        held: list[tuple[int, list[str]]] = []
        count = 0

        def flush() -> None:
            new = set().union(*(words for _, words in held)).difference(self.known)
            if self.used + len(new) > CACHE:
                self.forget()
                new = set().union(*(words for _, words in held))
            if new:
                self.learn(new)
            get = self.known.__getitem__
            owner, windows = windows_of([np.fromiter(map(get, words), dtype=np.int32, count=len(words)) for _, words in held])
            owner, best = np.array([n for n, _ in held])[owner], np.array(top)
            for k in range(0, len(windows), WINDOWS):
                np.maximum.at(best, owner[k : k + WINDOWS], run(self.p, self.inputs, windows[k : k + WINDOWS])[0])
            top[:] = best.tolist()
            held.clear()

        for n, text in enumerate(texts):
            top.append(-np.inf)
            for words in runs_of(text):
                held.append((n, words))
                count += len(words) + WINDOW
                if count >= SEGMENT:
                    flush()
                    count = 0
        if held:
            flush()
        return np.array(top)

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        a, b = self.scale
        return sigmoid(a * self.logits(texts) + b)


def windows_of(rows: list[np.ndarray], stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """(text number, rows) of all windows; texts shorter than a window are padded with row 0."""
    flat, owner, starts, at = [], [], [], 0
    for n, r in enumerate(rows):
        size = max(len(r), WINDOW)
        s = np.arange(0, size - WINDOW + 1, stride)
        if s[-1] + WINDOW < size:
            s = np.append(s, size - WINDOW)
        flat.append(r if len(r) == size else np.concatenate([r, np.zeros(size - len(r), dtype=np.int32)]))
        starts.append(s + at)
        owner.append(np.full(len(s), n))
        at += size
    place = np.concatenate(starts)[:, None] + np.arange(WINDOW)
    return np.concatenate(owner), np.concatenate(flat)[place]


def run(p: dict, inputs: np.ndarray, windows: np.ndarray, keep: bool = False) -> tuple:
    """Logits of windows (rows of ``inputs``); with ``keep`` also what training needs."""
    n, size = windows.shape
    here = windows > 0
    h = np.zeros((2, n, HIDDEN), dtype=np.float32)
    hs = np.empty((size, n, 2, HIDDEN), dtype=np.float32)
    trace = []
    full = bool(here.all())
    g = np.empty((2, n, 3 * HIDDEN), dtype=np.float32)
    for t in range(size):
        np.take(inputs[0], windows[:, t], axis=0, out=g[0], mode="clip")
        np.take(inputs[1], windows[:, size - 1 - t], axis=0, out=g[1], mode="clip")
        u = h @ p["U"]
        zr = sigmoid(g[:, :, : 2 * HIDDEN] + u[:, :, : 2 * HIDDEN])
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        c = np.tanh(g[:, :, 2 * HIDDEN :] + r * u[:, :, 2 * HIDDEN :])
        new = c + z * (h - c)
        if not full:
            m = np.stack([here[:, t], here[:, size - 1 - t]])[:, :, None]
            new = np.where(m, new, h)
        if keep:
            trace.append((h, z, r, c, u[:, :, 2 * HIDDEN :]))
        h = new
        hs[t, :, 0], hs[size - 1 - t, :, 1] = h[0], h[1]
    states = hs.transpose(1, 0, 2, 3).reshape(n, size, 2 * HIDDEN)
    e = np.tanh(states @ p["A"])
    s = e @ p["v"]
    if not full:
        s = np.where(here, s, -1e4)
    s = np.exp(s - s.max(axis=1, keepdims=True))
    s /= s.sum(axis=1, keepdims=True)
    pooled = np.einsum("nt,ntd->nd", s, states)
    out = pooled @ p["o"] + p["c"][0]
    return (out, here, states, e, s, pooled, trace) if keep else (out,)


def gradients(p: dict, inputs: np.ndarray, windows: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[dict, np.ndarray]:
    """Gradients of the weighted log loss for the dense parameters and for ``inputs``."""
    out, here, states, e, s, pooled, trace = run(p, inputs, windows, keep=True)
    n, size = windows.shape
    d = ((sigmoid(out) - y) * weight / n).astype(np.float32)
    g = {"o": pooled.T @ d, "c": np.array([d.sum()])}
    dp = d[:, None] * p["o"]
    ds = np.einsum("nd,ntd->nt", dp, states)
    dstates = s[:, :, None] * dp[:, None, :]
    ds = s * (ds - (ds * s).sum(axis=1, keepdims=True))
    de = ds[:, :, None] * p["v"] * (1 - e * e)
    g["v"] = np.einsum("nt,nta->a", ds, e)
    g["A"] = np.einsum("ntd,nta->da", states, de)
    dstates += de @ p["A"].T
    dhs = dstates.reshape(n, size, 2, HIDDEN)
    dU = np.zeros_like(p["U"])
    dinputs = np.zeros_like(inputs)
    dh = np.zeros((2, n, HIDDEN), dtype=np.float32)
    for t in range(size - 1, -1, -1):
        h, z, r, c, un = trace[t]
        dh = dh + np.stack([dhs[:, t, 0], dhs[:, size - 1 - t, 1]])
        m = np.stack([here[:, t], here[:, size - 1 - t]])[:, :, None]
        da = dh * m
        dc = da * (1 - z) * (1 - c * c)
        dz = da * (h - c) * z * (1 - z)
        dr = dc * un * r * (1 - r)
        du = np.concatenate([dz, dr, dc * r], axis=2)
        dU += h.transpose(0, 2, 1) @ du
        dg = np.concatenate([dz, dr, dc], axis=2)
        np.add.at(dinputs[0], windows[:, t], dg[0])
        np.add.at(dinputs[1], windows[:, size - 1 - t], dg[1])
        dh = da * z + dh * ~m + du @ p["U"].transpose(0, 2, 1)
    g["U"] = dU
    dinputs[:, 0] = 0
    return g, dinputs


def one_of_each(texts: list[str]) -> list[int]:
    """One text of each group of copies and near copies: texts that agree in three smallest word hashes are one.

    Copies of a toxic text would make its harmless words look telling.
    """
    seen: dict[tuple, int] = {}
    for n, t in enumerate(texts):
        h = np.array([zlib.crc32(w.encode()) for w in set(words_of(t))] or [0], dtype=np.uint64)
        seen.setdefault(tuple(int(((h * np.uint64(k) + np.uint64(k >> 7)) & np.uint64(0xFFFFFFFF)).min()) for k in (2654435761, 2246822519, 3266489917)), n)
    return list(seen.values())


class Adam:
    """Moments of every parameter, and one step for the gradients that are given."""

    def __init__(self, p: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.steps = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def step(self, g: dict[str, np.ndarray], decay: dict[str, float] | None = None) -> None:
        self.steps += 1
        for k, d in g.items():
            d = d + (decay or {}).get(k, 0.0) * self.p[k]
            self.m[k] += 0.1 * (d - self.m[k])
            self.v[k] += 0.01 * (d * d - self.v[k])
            self.p[k] -= (self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.99**self.steps)) + 1e-7)).astype(np.float32)


def start_reader(p: dict, words: list[str], rows: np.ndarray, counts: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, float]:
    """Fits byte vectors, filters and word vectors to tell, of single words, toxic texts from clean ones, through a linear
    head; gives the head and every word's logit. ``counts``: texts of each label that hold the word.

    Both labels weigh the same in sum. Most words occur in both kinds alike and learn nothing; what a toxic word's relatives share
    is learnt by the filters.
    """
    head = {"u": (rng.standard_normal(WORD_DIM + FILTERS) * 0.3).astype(np.float32), "u0": np.zeros(1, dtype=np.float32)}
    names = ("bytes", "filters", "fb", "words")
    adam = Adam({**{k: p[k] for k in names}, **head}, WORD_RATE)
    total = np.maximum(counts.sum(axis=1), 1)
    weight = counts / total[:, None] * np.where(counts.sum(axis=0) == 1, ONCE, 1.0)
    at = np.flatnonzero(counts[:, 0] + counts[:, 1] > 1)
    rest = np.setdiff1d(np.arange(len(words)), at)
    some = np.concatenate([at, rng.permutation(rest)[: max(0, FIT_WORDS - len(at))]])[:FIT_WORDS]
    chance = np.minimum(counts.sum(axis=0)[some], 60.0)
    chance[chance == 1] = ONCE
    chance /= chance.sum()
    for _ in range(WORD_STEPS):
        b = some[np.searchsorted(np.cumsum(chance), rng.random(WORD_BATCH)).clip(0, len(some) - 1)]
        b = np.unique(b)
        own = [words[i] for i in b]
        x = np.concatenate([p["words"][rows[b]], read_words(p, own)], axis=1)
        q = sigmoid(x @ head["u"] + head["u0"][0])
        share = (weight[:, b] / np.maximum(weight[:, b].sum(axis=0), 1e-9))
        d = ((q * share[0] - (1 - q) * share[1]) / len(b)).astype(np.float32)
        dx = d[:, None] * head["u"]
        g = reader_gradients(p, own, dx[:, WORD_DIM:])
        g["u"], g["u0"] = x.T @ d, np.array([d.sum()], dtype=np.float32)
        g["words"] = np.zeros_like(p["words"])
        np.add.at(g["words"], rows[b], dx[:, :WORD_DIM])
        g["words"][:2] = 0
        adam.step(g, {"words": 2e-5, "u": 1e-4, "filters": 1e-3})
        p["words"][:2] = 0
    out = np.empty(len(words), dtype=np.float32)
    for i in range(0, len(words), 20_000):
        x = np.concatenate([p["words"][rows[i : i + 20_000]], read_words(p, words[i : i + 20_000])], axis=1)
        out[i : i + 20_000] = x @ head["u"] + head["u0"][0]
    return out, head["u"], float(head["u0"][0])


def gate_start(p: dict, head: np.ndarray, u0: float) -> None:
    """Lets one unit of each direction begin as the start's head: it is above 0 at words whose logit exceeds FLOOR, and attention
    begins where it is high. All of it is trained on."""
    for side in (0, 1):
        at = side * HIDDEN
        p["W"][side, :, 2 * HIDDEN] = head * GAIN
        p["b"][side, 2 * HIDDEN] = (u0 - FLOOR) * GAIN
        p["b"][side, 0] = -2.0  # the unit forgets at once
        p["W"][side, :, 0] *= 0.1
        p["U"][side, :, 2 * HIDDEN] *= 0.1
        p["A"][:, 0] *= 0.1
        p["o"][at] = 2.0
    p["A"][[0, HIDDEN], 0] = 1.0
    p["v"][0] = 3.0


def fit(texts: list[str], labels: np.ndarray, seed: int = SEED) -> Network:
    """Learns from whole texts of which only the label is known, by multiple instances.

    The reader and the word vectors start from single words (``start_reader``); then everything is trained together: a toxic text teaches with
    its most toxic window, a clean one with its most toxic and a random one, out of those whose words looked most toxic at the start and some others. At
    last the texts' largest logits, over all their windows, are scaled to probabilities.
    """
    rng = np.random.default_rng(seed)
    one = one_of_each(texts)
    none = 1 + len(one) // 40  # texts without words are clean
    texts, y = [*(texts[i] for i in one), *[""] * none], np.append(np.asarray(labels, dtype=np.float64)[one], np.zeros(none))
    names: dict[str, int] = {}
    docs = [np.array([names.setdefault(w.strip(STRIP) or w, len(names)) for w in words_of(t)], dtype=np.int64) for t in texts]
    words = list(names) or ["-"]
    counts = np.zeros((2, len(words)))
    for d, label in zip(docs, y.astype(int), strict=True):
        counts[label, np.unique(d)] += 1
    often = np.flatnonzero(counts.sum(axis=0) >= WORD_TEXTS)
    f = lambda *s: (rng.standard_normal(s) / np.sqrt(s[-2])).astype(np.float32)
    vectors = (rng.standard_normal((len(often) + 2, WORD_DIM)) * 0.05).astype(np.float32)
    vectors[:2] = 0
    p = {
        "words": vectors, "bytes": (rng.standard_normal((259, BYTE_DIM)) * 0.5).astype(np.float32), "filters": (rng.standard_normal((WIDTH, BYTE_DIM, FILTERS)) * 0.3).astype(np.float32), "fb": np.zeros(FILTERS, dtype=np.float32),
        "W": f(2, WORD_DIM + FILTERS, 3 * HIDDEN), "b": np.zeros((2, 3 * HIDDEN), dtype=np.float32), "U": f(2, HIDDEN, 3 * HIDDEN), "A": f(2 * HIDDEN, ATTEND), "v": (rng.standard_normal(ATTEND) * 0.1).astype(np.float32), "o": (rng.standard_normal(2 * HIDDEN) * 0.3).astype(np.float32), "c": np.zeros(1, dtype=np.float32),
    }
    net = Network({words[i]: n + 2 for n, i in enumerate(often)}, p)
    rows = np.array([net.vocabulary.get(w, 1) for w in words])
    logit, head, u0 = start_reader(p, words, rows, counts, rng)
    first = np.append(-9.0, logit)  # by row: 0 is padding
    gate_start(p, head, u0)

    owner, windows = windows_of([d.astype(np.int32) + 1 for d in docs], FIT_STRIDE)  # row n + 1 is distinct word n
    best = first[windows].max(axis=1)
    edges = np.searchsorted(owner, np.arange(len(docs) + 1))
    chosen = []
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        top = a + np.argsort(-best[a:b], kind="stable")[:TOP_WINDOWS]
        chosen.append(np.union1d(top, rng.permutation(np.arange(a, b))[:SOME_WINDOWS]))
    edges = np.concatenate([[0], np.cumsum([len(c) for c in chosen])])
    chosen = np.concatenate(chosen)
    owner, windows, best = owner[chosen], windows[chosen], best[chosen]

    slow = ("bytes", "filters", "fb", "words")
    adam, reader = Adam({k: v for k, v in p.items() if k not in slow}, RATE), Adam({k: p[k] for k in slow}, READER_RATE)
    for epoch in range(EPOCHS):
        adam.rate, reader.rate = (r * (1 - epoch / EPOCHS) for r in (RATE, READER_RATE))  # ends in small steps, so that seeds differ less
        if epoch:
            used, local = np.unique(windows, return_inverse=True)
            inputs = inputs_of(net, [words[i - 1] for i in used if i])
            local = local.reshape(windows.shape) + (used[0] != 0)
            best = np.concatenate([run(p, inputs, local[i : i + 1024])[0] for i in range(0, len(local), 1024)])
        lesson = []
        for n, (a, b) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)):
            lesson.append(a + int(np.argmax(best[a:b])))
            if not y[n]:
                lesson.append(int(rng.integers(a, b)))
        lesson = rng.permutation(np.array(lesson))
        toxic = max(1.0, y[owner[lesson]].sum())
        weight = {1: len(lesson) / (2 * toxic), 0: len(lesson) / (2 * max(1.0, len(lesson) - toxic))}
        for i in range(0, len(lesson), BATCH):
            own = lesson[i : i + BATCH]
            used, local = np.unique(windows[own], return_inverse=True)
            w = used[used > 0] - 1
            some = [words[k] for k in w]
            x = np.concatenate([p["words"][rows[w]], read_words(p, some)], axis=1)
            inputs = np.zeros((2, len(w) + 1, 3 * HIDDEN), dtype=np.float32)
            inputs[:, 1:] = x @ p["W"] + p["b"][:, None]
            g, di = gradients(p, inputs, local.reshape(-1, WINDOW) + (used[0] != 0), y[owner[own]], np.where(y[owner[own]] == 1, weight[1], weight[0]))
            di = di[:, 1:]
            g["W"], g["b"] = x.T @ di, di.sum(axis=1)
            dx = (di @ p["W"].transpose(0, 2, 1)).sum(axis=0)
            g |= reader_gradients(p, some, dx[:, WORD_DIM:])
            g["words"] = np.zeros_like(p["words"])
            np.add.at(g["words"], rows[w], dx[:, :WORD_DIM])
            g["words"][:2] = 0
            adam.step({k: v for k, v in g.items() if k not in slow}, {"W": 1e-4, "U": 1e-4, "o": 1e-4})
            reader.step({k: v for k, v in g.items() if k in slow})
            p["words"][:2] = 0
    top = net.logits(texts)
    net.known, net.inputs, net.used = {}, None, 0
    net.scale = scaled(top, y)
    return net


def inputs_of(net: Network, words: list[str]) -> np.ndarray:
    """Gate inputs of distinct words, row 0 for padding first."""
    out = np.zeros((2, len(words) + 1, 3 * HIDDEN), dtype=np.float32)
    out[:, 1:] = net.project(words)
    return out


def scaled(top: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """One-dimensional logistic regression of the labels on the largest logits, with its threshold moved towards the toxic side:
    windows of clean texts that were not learnt from come out higher than those that were, toxic ones do not come out lower."""
    a, b = 1.0, 0.0
    for _ in range(2000):
        q = sigmoid(a * top + b) - y
        a -= 0.05 * ((q * top).mean() + 1e-3 * (a - 1))
        b -= 0.2 * q.mean()
    a = float(max(a, 0.05))
    between = (1 - TOXIC_SIDE) * np.quantile(top[y == 0], 0.99) + TOXIC_SIDE * np.quantile(top[y == 1], 0.05)
    return a, -a * max(-float(b) / a, float(between))


def held_out(key: Column) -> Column:
    """Rows whose labels are never learnt from: crc32 of the id as text divides by 5."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit(""))), F.lit(5)) == 0


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Network | None:
    """Fits on at most FIT_TOXIC and FIT_CLEAN labelled texts of up to FIT_CHARS code points; None if a class has no text.

    An id with both labels is toxic. Of rows that repeat an id the smallest text is learnt from, once. Null texts and null ids are left out.
    """
    mark = labels.select(labels[key].alias("k"), labels[label].alias("y")).where("k is not null and y in (0, 1)").groupBy("k").agg(F.max("y").alias("y"))
    mark = mark.where(~held_out(F.col("k")))
    d = docs.select(docs[key].alias("k"), docs[text].alias("x")).where(F.length("x") <= FIT_CHARS)
    parts = []
    for y, most in ((1, FIT_TOXIC), (0, FIT_CLEAN)):
        ids = mark.where(F.col("y") == y).orderBy(F.xxhash64("k"), "k").limit(most)
        parts.append(ids)
    ids = F.broadcast(parts[0].union(parts[1]))  # FIT_TOXIC + FIT_CLEAN ids at most
    rows = d.join(ids, "k").groupBy("k", "y").agg(F.min("x").alias("x")).toPandas().sort_values("k", kind="stable")  # a text for each
    if rows["y"].nunique() < 2:
        return None
    return fit(rows["x"].tolist(), rows["y"].to_numpy())


def probability(docs: DataFrame, model: Network | None, text: str = "text") -> Column:
    """The largest probability of any window of each whole text, as a column of docs; 0 without a model."""
    if model is None:
        return F.lit(0.0)
    model.known, model.inputs, model.used = {}, None, 0
    text_batches(docs.sparkSession)
    blob = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # some MB: the sample is bounded

    @F.arrow_udf("double")
    def value_of(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = loaded(blob, pickle.loads)
        for x in parts:
            yield pa.array(model.scores(t.as_py() for t in x), pa.float64())

    return value_of(docs[text])


def score(docs: DataFrame, model: Network | None, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """key, held_out, score, predicted for every row.

    Null and empty texts are one window of padding. All words are read byte by byte, those of the vocabulary also have a vector of their own. A run
    of over WORD_CHARS characters without white space is read as several words.
    Without a model (no labels of both kinds) all rows score 0. Rows are independent: repeated rows score alike, an empty table gives no
    rows, other columns (labels, lang, source among them) are not looked at; the key is only carried.
    """
    out = docs.select(docs[key], held_out(docs[key]).alias("held_out"), probability(docs, model, text).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject(docs: DataFrame, model: Network | None, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score ``threshold`` or more; all columns stay as they are."""
    return docs.where(probability(docs, model, text) < threshold)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return score(docs, train(docs, labels))
