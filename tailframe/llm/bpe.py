"""Byte-level BPE by per-prefix dynamic programming, and the way back."""

from __future__ import annotations

import gc
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import ahocorasick
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import loaded

#: Units kept in each of a worker's two cache generations.
CACHE = 250_000
#: Unicode White_Space, which the vocabulary's split pattern calls white space.
SPACES = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
LETTERS = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
#: A word that punctuation, white space or the end follows; punctuation after such a word; else all up to white space; white space. No piece of the split pattern crosses the edge of such a unit.
UNIT = re.compile(f" ?[{LETTERS}]+(?=[{SPACES}.,!?;:]|\\Z)|(?<=[{LETTERS}])[.,!?;:]+(?=[{SPACES}]|\\Z)| ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
PIECE = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACES}\p{{L}}\p{{N}}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabulary files."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("\xa1"), ord("\xac") + 1), *range(ord("\xae"), ord("\xff") + 1)]
    out = {chr(b): b for b in plain}
    out |= {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in plain)}
    return out


class Bpe:
    """Encoder and decoder for one vocabulary.

    Tokens are numbered in the order in which merges make them: 0-255 the bytes, then the merges.
    For every prefix of a piece exactly one token can come last. It is found among the vocabulary
    tokens that are suffixes of the prefix (the automaton's matches) as the one that is compatible with
    the last token of the prefix before it; back-pointers from the end give the encoding.
    """

    def __init__(self, spec: str | bytes):
        data = json.loads(spec)
        model, letters = data["model"], byte_letters()
        if model["type"] != "BPE" or data["normalizer"] is not None or model.get("end_of_word_suffix"):
            raise ValueError("a byte-level BPE vocabulary without normalizer is needed")
        raw = lambda t: bytes(letters[c] for c in t)
        vocab = {raw(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.bytes_of = {i: b for b, i in vocab.items()} | {i: t.encode() for t, i in self.special.items()}
        number = {bytes([b]): b for b in range(256)}
        self.public = [vocab.get(bytes([b]), -1) for b in range(256)]
        self.length, self.left, self.right = [1] * 256, list(range(256)), list(range(256))
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            a, b = (raw(t) for t in (merge.split(" ") if isinstance(merge, str) else merge))
            new = len(self.length)
            self.pairs.setdefault((number[a], number[b]), new)
            number.setdefault(a + b, new)
            self.length.append(len(a + b))
            self.left.append(number[a])
            self.right.append(number[b])
            self.public.append(vocab[a + b])
        self.words = list(map(str, self.public))
        self.suffixes = ahocorasick.Automaton()
        sound = [True] * 256
        for t in range(256, len(self.length)):  # tokens that encode to themselves
            sound.append(sound[self.left[t]] and sound[self.right[t]] and self.apart(self.left[t], self.right[t], t))
        self.whole = {b.decode("latin-1"): t for b, t in number.items() if sound[t]}
        for word, t in self.whole.items():
            self.suffixes.add_word(word, (len(word), t, {}))  # the last: which tokens can stand before t
        self.suffixes.make_automaton()
        self.young: dict[str, tuple[str, tuple[int, ...]]] = {}
        self.old: dict[str, tuple[str, tuple[int, ...]]] = {}

    def apart(self, a: int, b: int, limit: int = 1 << 60) -> bool:
        """Whether tokens a, b side by side stay two tokens: undoing their merges from the latest on, no
        merge across the gap would have come first."""
        pairs, left, right = self.pairs, self.left, self.right
        while True:
            if pairs.get((a, b), limit) < limit:
                return False
            if a > b:
                if a < 256:
                    return True
                limit, a = a, right[a]
            else:
                if b < 256:
                    return True
                limit, b = b + 1, left[b]

    def piece(self, data: str) -> list[int]:
        """Tokens (own numbers) of one piece of the split pattern, whose bytes are given as Latin-1."""
        whole = self.whole.get(data)
        if whole is not None:
            return [whole]
        last, lengths = [-1] * len(data), self.length
        done = -1
        for end, (length, t, met) in self.suffixes.iter(data):
            if end == done:
                continue
            start = end - length
            if start >= 0:
                before = last[start]
                fits = met.get(before)
                if fits is None:
                    fits = met[before] = before >= 0 and self.apart(before, t)
                if not fits:
                    continue
            last[end] = t
            done = end
        out, at = [], len(data) - 1
        while at >= 0:
            t = last[at]
            out.append(t)
            at -= lengths[t]
        out.reverse()
        return out

    def unit(self, text: str) -> tuple[str, tuple[int, ...]]:
        found = self.old.get(text)
        if found is None:
            word = text[1:] if text[0] == " " else text
            if word.isalpha():
                tokens = self.piece(text.encode().decode("latin-1"))
            else:
                tokens = [t for p in PIECE.findall(text) for t in self.piece(p.encode().decode("latin-1"))]
            found = ",".join([self.words[t] for t in tokens]), tuple([self.public[t] for t in tokens])
        if len(text) < 64:
            if len(self.young) >= CACHE:
                self.old, self.young = self.young, {}
            self.young[text] = found
        return found

    def runs(self, text: str) -> Iterator[tuple[str, tuple[int, ...]]]:
        """The ids of the text, a unit at a time: joined by commas, and as numbers."""
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                yield str(self.special[part]), (self.special[part],)
            elif part:
                for u in UNIT.findall(part):
                    yield self.young.get(u) or self.unit(u)

    def encode(self, text: str) -> list[int]:
        return [i for _, ids in self.runs(text) for i in ids]

    def decode(self, ids: Iterable[int]) -> str:
        """Text of the ids, special tokens included; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


def vocabulary(spark: SparkSession, path: str):
    """The vocabulary file's bytes (some 1.5 MB), broadcast: executors need no copy of the file."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Adds nothing but the ids: columns key, ids array<int>. Null text is empty, which has no ids."""
    spec = vocabulary(docs.sparkSession, path)

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = loaded(spec, Bpe)
        for x in parts:
            yield pd.Series([b.encode(t or "") for t in x])

    return docs.select(docs[key], run(docs[text]).alias("ids"))


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """key, text of each row's ids; null ids give empty text."""
    spec = vocabulary(tokens.sparkSession, path)

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = loaded(spec, Bpe)
        for x in parts:
            yield pd.Series([b.decode(() if i is None else i) for i in x], dtype=object)

    return tokens.select(tokens[key], run(tokens[ids]).alias("text"))


def round_trip(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each whole text in one pass and returns digests of both.

    Columns: key, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256. Null and empty
    texts have no ids. Special tokens in a text are encoded as such. Rows are independent: repeated rows give
    repeated results, an empty table none; other columns are ignored.
    """
    spec = vocabulary(docs.sparkSession, path)
    sha = lambda x: hashlib.sha256(x).hexdigest()

    @F.pandas_udf("n_tokens long, ids_sha256 string, decoded_sha256 string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        b = loaded(spec, Bpe)
        for x in parts:
            out = []
            gc.disable()  # what is made here has no cycles
            try:
                for t in x:
                    found = list(b.runs(t or ""))
                    ids = list(chain.from_iterable([f[1] for f in found]))
                    out.append((len(ids), sha(",".join([f[0] for f in found]).encode()), sha(b.decode(ids).encode())))
            finally:
                gc.enable()
            yield pd.DataFrame(out, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs[key], run(docs[text]).alias("r")).select(key, "r.*")


def op5_bpe(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
