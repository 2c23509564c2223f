"""Order-preserving packing into fixed windows, by dynamic programming with a monotone queue."""

from __future__ import annotations

import gc
import os
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_letters, vocabulary
from .common import loaded, text_batches

WINDOW, END_ID = 4096, 2
#: Tokens that are planned together; the rest of a plan is carried into the next.
RUN = 1 << 20
#: Padding tokens that a cut inside a document, or inside a sentence, is worth.
INSIDE_DOCUMENT, INSIDE_SENTENCE = 32, 64
#: A sentence of more tokens may be cut within, every so many tokens.
LONG_SENTENCE = 1024
#: Units that a worker remembers, beside other stages and where packing is all that runs, and texts that it holds as Python strings at once.
CACHE, ALONE, TEXTS = 120_000, 500_000, 256

#: Letters that the vocabulary's normalizer leaves alone, and marks that may follow a word. The vocabulary's own split has an edge between such a word and such marks, and drops white space.
LETTERS = "a-z\xdf-\xf6\xf8-\xff"
PLAIN, MARKS = re.compile(f"[{LETTERS}]+"), "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
LATIN = re.compile(f"[{LETTERS}\xc0-\xd6\xd8-\xde]+")  # capitals that each have one small letter
ODD_SPACE = re.compile("[\x1c-\x1f]")  # white space to Python, not to the vocabulary


class WordTokens:
    """Ids of whole texts from a ``tokenizers`` file, remembered unit by unit.

    Lower-case Latin words go to the library's model many at a time (its normalizer and split would leave
    them as they are), all other units through the whole library pipeline.
    """

    def __init__(self, spec: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_str(spec.decode())
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = Tokenizer(self.full.model)
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.letters = {b: c for c, b in byte_letters().items() if b > 127}
        self.added = sorted({a.content.encode().lower() for a in self.full.get_added_tokens_decoder().values()})
        self.known: dict[str, bytes] = {}
        self.most = CACHE
        suffix = self.full.model.end_of_word_suffix
        if not suffix:
            raise ValueError("a vocabulary whose words end in a suffix is needed")
        n = self.full.get_vocab_size(with_added_tokens=True)
        self.closes = np.array([(self.full.id_to_token(i) or "").endswith(suffix) for i in range(n)])  # tokens that end a word

    def learn(self, units: list[list[str]]) -> None:
        known = self.known
        if len(known) > self.most:
            known.clear()
        words, ended, rest = set(), [], []
        for u in set().union(*units).difference(known):
            w = u.rstrip(MARKS)
            mark = u[len(w) :]
            if not (w.isascii() and w.isalpha()) and not PLAIN.fullmatch(w):
                if not LATIN.fullmatch(w):
                    rest.append(u)
                    continue
                w = w.lower()
            words.add(w)
            if w != u:
                ended.append((u, w, mark))
        plain = list(words.difference(known))
        plain.sort(key=str.isascii)  # so that few lines need their bytes spelt out
        groups = [plain[i : i + 200] for i in range(0, len(plain), 200)]
        lines = [x if x.isascii() else x.encode().decode("latin-1").translate(self.letters) for x in map(" ".join, groups)]
        for some, e in zip(groups, self.bare.encode_batch_fast(lines, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, dtype="<u4")
            data, ends = ids.tobytes(), ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            known.update(zip(some, [data[x:y] for x, y in zip([0, *ends], ends, strict=False)], strict=True))
        known[""] = b""
        rest += {mark for _, _, mark in ended}.difference(known)
        for u, e in zip(rest, self.full.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            known[u] = np.array(e.ids, dtype="<u4").tobytes()
        for u, w, mark in ended:
            known[u] = known[w] + known[mark]

    def odd(self, text: str) -> bool:
        """Whether small letters would change more than words: odd white space, or an added token's content in another case,
        which the library matches on the text as it is."""
        raw = text.encode()
        small = raw.lower()
        return bool(ODD_SPACE.search(text)) or any((n := small.count(a)) and n != raw.count(a) for a in self.added)

    def texts(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        for i in range(0, len(texts), TEXTS):
            some = [t or "" for t in texts[i : i + TEXTS]]
            odd = [self.odd(t) for t in some]
            units = [[] if o else t.encode().lower().decode().split() for t, o in zip(some, odd, strict=True)]  # A-Z alone; the library does the rest
            self.learn(units)
            for t, o, us in zip(some, odd, units, strict=True):
                if o:
                    yield np.array(self.full.encode(t, add_special_tokens=False).ids, dtype="<u4")
                else:
                    yield np.frombuffer(b"".join(map(self.known.__getitem__, us)), dtype="<u4")

    def sentence_ends(self) -> np.ndarray:
        """For each id, whether its token ends in a mark that ends a sentence."""
        n = self.full.get_vocab_size(with_added_tokens=True)
        return np.array([(self.full.id_to_token(i) or "").removesuffix("</w>").endswith((".", "!", "?")) for i in range(n)])


def boundaries(docs: list[np.ndarray], ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows may be cut, and what a cut there costs. Documents' ends cost nothing."""
    ids = np.concatenate(docs)
    total = len(ids)
    doc_ends = np.cumsum([len(d) for d in docs])
    cost = np.full(total + 1, -1, dtype=np.int64)
    cost[1:][ends[ids]] = INSIDE_DOCUMENT
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    step = min(LONG_SENTENCE, window)
    for i in np.flatnonzero(np.diff(at) > step):
        cost[at[i] + step : at[i + 1] : step] = INSIDE_SENTENCE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def cuts(at: np.ndarray, cost: np.ndarray, window: int, last: bool) -> list[int]:
    """Cuts of least padding plus penalties, in order, from ``at[0]`` = 0.

    f(j) = min over i, at[j] - at[i] <= window, of f(i) + window - (at[j] - at[i]) + cost[j]. As f(i) + at[i] is all that
    depends on i, the candidates form a queue with rising values whose head is the best one in reach. If ``last``
    the plan runs to the last boundary; else it stops at the best of those within a window of it.
    """
    place, price = at.tolist(), cost.tolist()
    back = [0] * len(place)
    value = [0] * len(place)
    queue: deque[tuple[int, int, int]] = deque([(0, 0, 0)])  # f(i) + at[i], at[i], i
    for j in range(1, len(place)):
        here = place[j]
        while queue[0][1] < here - window:
            queue.popleft()
        key, _, i = queue[0]
        f = key + window - here + price[j]
        value[j], back[j] = f, i
        key = f + here
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, here, j))
    j = len(place) - 1
    if not last:
        near = [i for i in range(len(place)) if place[i] >= place[-1] - window and i]
        j = min(near, key=lambda i: (value[i] + (place[-1] - place[i]) % window, -i))
    out = []
    while j:
        out.append(place[j])
        j = back[j]
    return out[::-1]


def tail(length: int, window: int) -> list[int]:
    """Lengths that a last window is dealt to: powers of two need no padding."""
    parts = [1 << b for b in range(length.bit_length() - 1, -1, -1) if length >> b & 1]
    return parts if INSIDE_SENTENCE * (len(parts) - 1) < window - length else [length]


class Packer:
    """Takes documents in order and gives back pieces: (document number, start, length, sequence, offset)."""

    def __init__(self, ends: np.ndarray, window: int, run: int):
        self.ends, self.window, self.run = ends, window, run
        self.docs: list[tuple] = []  # (own fields, ids, tokens already placed)
        self.waiting = self.sequence = 0

    def add(self, fields: tuple, ids: np.ndarray) -> Iterator[tuple]:
        self.docs.append((fields, ids, 0))
        self.waiting += len(ids)
        if self.waiting >= self.run:
            yield from self.plan(False)

    def plan(self, last: bool) -> Iterator[tuple]:
        if not self.docs:
            return
        at, cost = boundaries([ids[done:] for _, ids, done in self.docs], self.ends, self.window)
        where = cuts(at, cost, self.window, last)
        lengths = [b - a for a, b in zip([0, *where], where, strict=False)]
        if last:
            lengths[-1:] = tail(lengths[-1], self.window)
        docs = deque(self.docs)
        for length in lengths:
            offset = 0
            while offset < length:
                fields, ids, done = docs.popleft()
                n = min(len(ids) - done, length - offset)
                yield fields, done, ids[done : done + n], len(ids), self.sequence, offset
                offset += n
                if done + n < len(ids):
                    docs.appendleft((fields, ids, done + n))
            self.sequence += 1
        self.docs = list(docs)
        self.waiting = sum(len(ids) - done for _, ids, done in docs)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, run: int = RUN, key: str = "doc_id", text: str = "text", remember: int = CACHE) -> DataFrame:
    """Cuts the token stream, in key order, into sequences of at most ``window`` tokens.

    A document is its text's ids and ``end_id``. Cuts lie at ends of documents or sentences (within a sentence only where it has more
    than LONG_SENTENCE tokens) so that padding plus penalties for cut documents are least. Each partition of the key
    order is packed by its own task, which plans ``run`` tokens at a time and carries the rest on; its last window is dealt to powers of two
    where that saves padding. So nothing is gathered but one range shuffle of the texts.

    Columns: key, start, length, ids (binary, little-endian uint32), doc_tokens, sequence_id, offset; one row per piece. Null
    and empty texts are documents of ``end_id`` alone. Null keys come first, repeated rows are packed each, an empty table
    gives no rows; other columns are ignored.
    """
    spec = vocabulary(docs.sparkSession, path)
    kind = docs.schema[key].dataType
    out = T.StructType([T.StructField(key, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])
    d = docs.select(docs[key].alias("k"), docs[text].alias("x")).withColumn("_tie", F.monotonically_increasing_id())
    d = d.repartitionByRange("k", "_tie").sortWithinPartitions("k", "_tie").select("k", "x")

    def run_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(spec, WordTokens)
        tokens.most = remember
        ends = tokens.sentence_ends()
        packer = Packer(ends, window, run)
        base = TaskContext.get().partitionId() << 33
        stop = np.array([end_id], dtype="<u4")
        key_type = None

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = [pa.array([r[0] for r in rows], key_type), *(pa.array([x(r) for r in rows], pa.int64()) for x in (lambda r: r[1], lambda r: len(r[2])))]
            cols += [pa.array([r[2].tobytes() for r in rows], pa.binary()), *(pa.array([x(r) for r in rows], pa.int64()) for x in (lambda r: r[3], lambda r: base + r[4], lambda r: r[5]))]
            return pa.RecordBatch.from_arrays(cols, names=out.names)

        gc.disable()  # the loop makes no cycles
        try:
            for b in batches:
                key_type = b.schema.field(0).type
                rows: list[tuple] = []
                for part in (b.slice(i, TEXTS) for i in range(0, b.num_rows, TEXTS)):
                    for k, ids in zip(part.column(0).to_pylist(), tokens.texts(part.column(1).to_pylist()), strict=True):
                        rows += packer.add(k, np.concatenate([ids, stop]))
                        if len(rows) > 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)
            rows = list(packer.plan(True))
        finally:
            gc.enable()  # the worker is used again, also after an error
        if rows:
            yield batch(rows)

    text_batches(docs.sparkSession)
    return d.mapInArrow(run_partition, out)


def op3_packing(spark, sf_dir: str) -> DataFrame:
    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), remember=ALONE)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
