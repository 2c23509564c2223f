"""Spelling variants: words that one edit tells apart, found by pivotal grams, and the common form of each."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_batches
from .sharding import crc_table

#: Shortest word, and rarest one that counts.
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A form is so many times as frequent as the word.
RATIO = 10
#: One in so many runs loses a code point.
DROP = 31
#: Letters of a run. A bigram of lower-cased ones is one of at most 90 * 90, so a table of all grams is bounded.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EDITS, GRAM = 1, 2
#: Into how many parts the edited side of a gram is cut, to meet by all but one.
PARTS = 3
#: Words that a task turns into keys at once, and distinct ones that it counts before it gives them out.
ROWS, HELD = 20_000, 200_000


def words_in(key: str, text: str, least: int = LEAST_LENGTH) -> Iterator[tuple[str, int]]:
    """(word, times) of one text's distinct runs of letters, with the code point that the hash names deleted; shorter runs can be no word."""
    for run, times in Counter(re.findall(f"[{LETTERS}]{{{least},}}", text.encode().lower().decode())).items():  # bytes: only A-Z
        h = crc32(f"{key}:{run}".encode())
        if h % DROP == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
        if len(run) >= least:
            yield run, times


def vocabulary(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH, count: int = LEAST_COUNT) -> DataFrame:
    """word and its number of occurrences n, of those with ``count`` or more.

    Whole texts are read; a task adds up its words until it holds HELD of them. A null key hashes as an empty one, null texts have no words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])
            found.clear()
            return batch

        for batch in batches:
            for k, x in zip(batch.column(0), batch.column(1), strict=True):
                for word, times in words_in(k.as_py(), x.as_py(), least):
                    found[word] += times
                if len(found) > HELD:
                    yield out()
        yield out()

    rows = docs.select(F.coalesce(docs[key].cast("string"), F.lit("")).alias("k"), docs[text].alias("x")).where("x is not null")
    text_batches(docs.sparkSession)
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= count)


def grams_of(word: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.char_length(word) - 1), lambda i: F.substr(word, i, F.lit(GRAM)))


def gram_ranks(words: DataFrame) -> list[tuple[str, int]]:
    """Bigrams of the words with their frequency, rare first: at most one row for each pair of letters."""
    grams = words.select(F.explode(grams_of(F.col("word"))).alias("g")).groupBy("g").agg(F.count("*").alias("f"))
    return [(r["g"], r["f"]) for r in grams.orderBy("f", "g").collect()]


class Grams:
    """Order and frequency of the bigrams, as arrays over pairs of letter numbers."""

    def __init__(self, ranks: list[tuple[str, int]]):
        letters = sorted({c for g, _ in ranks for c in g})
        self.number = np.full(0x10000, -1, dtype=np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(len(letters))
        self.letters = max(1, len(letters))
        self.rank = np.full((self.letters, self.letters), len(ranks), dtype=np.int32)
        self.freq = np.ones((self.letters, self.letters))
        for n, (g, f) in enumerate(ranks):
            a, b = self.number[ord(g[0])], self.number[ord(g[1])]
            self.rank[a, b], self.freq[a, b] = n, f


def prefixes(rank: np.ndarray) -> np.ndarray:
    """Which occurrences (words by positions) are in a word's gram prefix: the GRAM * EDITS + 1 rarest, and all others of
    the last one's gram, so that a gram is in the prefix wholly or not at all."""
    need = GRAM * EDITS + 1
    last = np.partition(rank, need - 1, axis=1)[:, need - 1]
    return rank <= last[:, None]


def pivots(freq: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    """Two disjoint grams of each word's prefix of the smallest summed frequency, as (words, 2) positions.

    Dynamic programming over positions: best[j] is the lightest single gram that ends where a gram at j + GRAM may begin; a pair
    ending in j adds its own weight. The prefix has three occurrences or more, so the outer two are disjoint and a pair exists.
    """
    n, size = freq.shape
    weight = np.where(prefix, freq, np.inf)
    best, at = np.full(n, np.inf), np.zeros(n, dtype=np.int64)
    total, out = np.full(n, np.inf), np.zeros((n, EDITS + 1), dtype=np.int64)
    for j in range(GRAM, size):
        better = weight[:, j - GRAM] < best
        best, at = np.where(better, weight[:, j - GRAM], best), np.where(better, j - GRAM, at)
        pair = best + weight[:, j]
        better = pair < total
        total = np.where(better, pair, total)
        out[better, 0], out[better, 1] = at[better], j
    return out


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Bits of a key that travel; keys that agree by chance only cost a check.
KEY_BITS = np.uint64(2**48 - 1)


def mixed(*parts: np.ndarray | int) -> np.ndarray:
    """64-bit hash of numbers, element by element."""
    h: np.ndarray | np.uint64 = np.uint64(0x243F6A8885A308D3)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * MULTIPLIER
        h = h ^ (h >> np.uint64(29))
    return np.asarray(h)


class Substrings:
    """64-bit hashes of any stretches of words of one length: the words' code numbers as polynomials modulo 2^64."""

    def __init__(self, codes: np.ndarray):
        n, size = codes.shape
        self.power = np.cumprod(np.where(np.arange(size + 1) == 0, np.uint64(1), MULTIPLIER), dtype=np.uint64)
        self.upto = np.zeros((n, size + 1), dtype=np.uint64)
        value = mixed(codes)
        for p in range(size):
            self.upto[:, p + 1] = self.upto[:, p] * MULTIPLIER + value[:, p]

    def __call__(self, row: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.upto[row, stop] - self.upto[row, start] * self.power[stop - start]


LEFT, RIGHT = 1, 2


def parts_of(hashes: Substrings, row: np.ndarray, gram: np.ndarray, p: np.ndarray, size: int, side: int, d: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, key) of grams at p whose ``side`` stays, in a word of ``size`` + d: the gram and its place there, the length, the
    side that stays, and all but one of the PARTS of the other side, as an edit lies in one of them."""
    rest = size - GRAM - p if side == LEFT else p  # code points on the edited side of this word, and of the other
    other = rest + d
    begin = p + GRAM if side == LEFT else np.zeros_like(p)
    stays = hashes(row, np.zeros_like(p), p) if side == LEFT else hashes(row, p + GRAM, np.full_like(p, size))
    base = mixed(gram, p if side == LEFT else p + d, size + d, side, stays)
    for k in range(PARTS):
        first, last = other * k // PARTS, other - other * (k + 1) // PARTS
        ok = (other >= 0) & (first + last <= rest) & ((first + last < other) | ((other == 0) & (k == 0)))
        r, s, e, m, n = row[ok], begin[ok], (begin + rest)[ok], first[ok], last[ok]
        yield r, mixed(base[ok], k, hashes(r, s, s + m), hashes(r, e - n, e))


def keys_of(codes: np.ndarray, grams: Grams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, key) of the index entries and (row, key) of the probes of words of one length, given as letter numbers.

    A gram that an edit does not touch keeps its place, or moves by the difference of the lengths if the edit is on its left;
    what lies on the other side of the gram stays as it is, and so do all but one of PARTS of the edited side. An index entry has a prefix gram with
    its place, the word's length, and what may stay; a probe has what a pivot would have in a word that is one edit away: replaced on the right
    or left (same length), or with one more or one fewer.
    """
    n, size = codes.shape
    a, b = codes[:, :-1], codes[:, 1:]
    rank, freq = grams.rank[a, b], grams.freq[a, b]
    prefix, hashes = prefixes(rank), Substrings(codes)
    row, at = np.nonzero(prefix)
    name = lambda r, p: a[r, p].astype(np.int64) * grams.letters + b[r, p]
    index = [x for side in (LEFT, RIGHT) for x in parts_of(hashes, row, name(row, at), at, size, side, 0)]
    own = np.arange(n)
    probe = [x for p in pivots(freq, prefix).T for side in (LEFT, RIGHT) for d in (-1, 0, 1) for x in parts_of(hashes, own, name(own, p), p, size, side, d)]
    return *map(np.concatenate, zip(*index, strict=True)), *map(np.concatenate, zip(*probe, strict=True))


def keyed(words: DataFrame, ranks: list[tuple[str, int]], probes: bool) -> DataFrame:
    """key, id of each word's probes (up to 36) or, without ``probes``, of its index entries (up to six for each gram of its prefix). Words stay in
    their table, as a long one that repeats a gram has many entries."""
    grams = Grams(ranks)  # at most 90 * 90 numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                ids, words = (batch.column(c).slice(start, ROWS) for c in (0, 1))
                words = words.to_pylist()
                size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
                for length in np.unique(size).tolist():
                    own = np.flatnonzero(size == length)
                    step = max(1, ROWS * 16 // length)  # a long word's grams are as many as many short ones'
                    for i in range(0, len(own), step):
                        some = own[i : i + step]
                        text = "".join(words[k] for k in some)
                        codes = grams.number[np.frombuffer(text.encode("utf-32-le"), dtype="<u4")].reshape(len(some), length)
                        ir, ik, pr, pk = keys_of(codes, grams)
                        rows, keys = (some[pr], pk) if probes else (some[ir], ik)
                        yield pa.RecordBatch.from_arrays([pa.array((keys & KEY_BITS).view(np.int64)), ids.take(pa.array(rows))], names=["key", "id"])

    return words.select("id", "word").mapInArrow(run, "key long, id long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, b and their words wa, wb: all pairs of distinct words that differ by one inserted, deleted or replaced code point, once.

    If one edit tells r from s, it leaves one of r's two disjoint pivots whole; where r's last prefix gram is no more frequent than s's, that
    pivot is in s's prefix. So the pair meets by r's pivots or by s's. Pairs that meet are verified. ``words`` is a stored table (id, word) of
    distinct words of four code points or more.
    """
    ranks = gram_ranks(words)
    met = keyed(words, ranks, True).toDF("key", "x").join(keyed(words, ranks, False).toDF("key", "y"), "key").where("x <> y")
    pair = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).repartition("a").distinct()  # dealt as the join with a's words needs it
    one, two = (words.select(F.col("id").alias(c), F.col("word").alias(f"w{c}")) for c in "ab")
    return pair.join(one, "a").join(two, "b").where(F.levenshtein("wa", "wb", EDITS) == EDITS)


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the last of the forms that follow each word; ``forms`` (word, form) is a stored table without nulls.

    Each step doubles how far a word looks, and a form is RATIO times as frequent as its word, so a handful of steps end it.
    """
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = materialize(now.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, n, n_near, form, form_n, root of every word of the vocabulary.

    A word's form is its near word of the largest n, ties to the smallest in code-point order, if that n is ``ratio`` times the word's or more; else
    null. root follows the forms to the last; a word without a form is its own. n_near counts near words, 0 if none. Null texts have no
    runs, a null key hashes as an empty one; repeated rows count each time; an empty table gives no rows; other columns are ignored. Words have any length.
    """
    words = materialize(vocabulary(docs, key, text).withColumn("id", F.monotonically_increasing_id()), "vocabulary")
    pair = near_pairs(words)
    both = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other"), F.col("wb").alias("near")), F.struct(F.col("b").alias("id"), F.col("a").alias("other"), F.col("wa").alias("near")))
    pair = pair.select(F.explode(both).alias("p")).select("p.*").join(words.select(F.col("id").alias("other"), F.col("n").alias("m")), "other")
    best = pair.groupBy("id").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("near").alias("near"))).alias("best"))
    found = words.join(best, "id", "left")
    good = -F.col("best.m") >= F.col("n") * ratio
    found = found.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.m")).alias("form_n"))
    found = materialize(found, "variants")
    roots = roots_of(found.where("form is not null").select("word", "form"))
    return found.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE_SQL = f"""
WITH RECURSIVE crc AS (SELECT CAST({crc_table()} AS BIGINT[]) AS t),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS k, translate(unnest(regexp_extract_all(text, '[{LETTERS}]{{7,}}')), '{UPPER}', '{LOWER}') AS run FROM documents),
pairs AS (SELECT k || ':' || run AS s, run, count(*) AS times FROM runs GROUP BY ALL),
hashed AS (
  SELECT run, times, xor(list_reduce(list_transform(regexp_extract_all(hex(s), '..'), lambda h: CAST('0x' || h AS BIGINT)), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h
  FROM pairs, crc),
cut AS (SELECT times, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM hashed),
v AS (SELECT word, CAST(sum(times) AS BIGINT) AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
places AS (SELECT *, unnest(range(1, length(word) + 1)) AS i FROM v),
stars AS (SELECT word, n, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS star FROM places),
gone AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM places),
near AS (
  SELECT a.word, b.word AS near, b.n AS m FROM stars a JOIN stars b ON a.star = b.star AND a.word <> b.word
  UNION ALL SELECT a.word, b.word, b.n FROM gone a JOIN v b ON a.rest = b.word
  UNION ALL SELECT b.word, a.word, a.n FROM gone a JOIN v b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(m) AS m FROM near GROUP BY word),
top AS (SELECT best.word, n_near, best.m, min(near.near) AS near FROM best JOIN near ON near.word = best.word AND near.m = best.m GROUP BY ALL),
found AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * v.n THEN near END AS form, CASE WHEN m >= 10 * v.n THEN m END AS form_n FROM v LEFT JOIN top ON top.word = v.word),
walk AS (
  SELECT word, word AS here, form AS next FROM found
  UNION ALL SELECT walk.word, found.word, found.form FROM walk JOIN found ON found.word = walk.next)
SELECT found.word, n, CAST(n_near AS BIGINT) AS n_near, found.form, form_n, walk.here AS root FROM found JOIN walk ON walk.word = found.word AND walk.next IS NULL
"""
