"""Conversation trie, spelling variants and personal data against brute force and SQL; memory and shifts of the toxicity windows; rows that stay."""

import hashlib
import math
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from .test_operators import rows, same_as_sql

SF = "/root/testdata/sf0.001"


# Conversation trie


def brute_trie(turns):
    convs = {}
    order = lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or "")
    for t in sorted((t for t in turns if t[0] is not None), key=order):
        convs.setdefault(t[0], []).append((t[2] or "", t[3] or ""))
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        made[c] = tuple(convs.get(c - c % 100, [])[:h] + own[h:])
    nodes = {}
    for c, path in made.items():
        for d in range(len(path) + 1):
            nodes.setdefault(path[:d], []).append(c)
    children = Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        ends = sorted(c for c in members if made[c] == p)
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(children[q] == 0 for q in below), sum((len(nodes[q]) - 1) * len(q[-1][1]) for q in below if q), hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
TURN_SCHEMA = "conv_id long, turn long, role string, text string, c long, i long, rep long, size int"


def trie_of(spark, turns):
    from tailframe.llm.conv_trie import prefix_trie

    return sorted((tuple(r[c] for c in TRIE) for r in prefix_trie(spark.createDataFrame([(*t, 0, 0, 0, 0) for t in turns], TURN_SCHEMA)).collect()), key=repr)


def test_trie_against_brute_force(spark):
    rng = np.random.default_rng(5)
    turns = []
    for c in [*range(0, 12), *range(100, 108), *range(207, 214), 399]:  # 200 and 300 are absent: their conversations lose their heads
        for t in range(int(rng.integers(1, 9))):
            turns.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bb", "ccc", "é🙂"])))
    turns += [(3, None, "user", "first of all"), (3, 2, None, None), (3, 2, None, None), (None, 1, "user", "nobody's"), (900, 1, None, "x" * 20000)]
    turns += [(c, t, "user", "same") for c in (1000, 1001, 1002, 1003, 1004) for t in range(40)]  # long common paths
    assert trie_of(spark, turns) == brute_trie(turns)


def test_trie_of_nothing(spark):
    assert trie_of(spark, []) == []
    assert trie_of(spark, [(None, 1, "user", "x")]) == []


def test_trie_of_one_huge_conversation_and_of_many_copies(spark):
    """A conversation of half of all turns, and a node in which more conversations end than a piece of its digest holds."""
    turns = [(7, t, "user", f"turn {t % 7}") for t in range(1500)] + [(100 * c + 100, 0, "user", "hello") for c in range(1200)]
    got, want = trie_of(spark, turns), brute_trie([t for t in turns if t[0] != 7])
    root = next(r for r in got if r[1] == 0)
    assert root[:4] == (7, 0, None, 1201) and root[4] == 2 and root[5] == 2
    shared = next(r for r in want if r[1] == 1)
    assert next(r for r in got if r[1] == 1 and r[0] != 7)[3:] == shared[3:]
    deepest = max(r[1] for r in got)
    assert sum(r[0] == 7 for r in got) == deepest + 1 and deepest >= 1490


def test_equal_fingerprints_of_unlike_turns_are_seen(spark, monkeypatch):
    from tailframe.llm import conv_trie

    seen, hashed = [], conv_trie.prefix_prints

    def weak(turns, attempt):  # the first fingerprints tell nothing apart
        seen.append(attempt)
        out = hashed(turns, attempt)
        return out if attempt else out.withColumns({f"q{n}": F.lit(1).cast("long") for n in conv_trie.LANES})

    monkeypatch.setattr(conv_trie, "prefix_prints", weak)
    turns = [(c, t, "user", f"{c} {t}") for c in (1, 2, 3) for t in range(3)]
    assert trie_of(spark, turns) == brute_trie(turns) and seen == [0, 1]


def test_new_sql(spark):
    from tailframe.llm import conv_trie, spelling

    same_as_sql(spark, "op11_conversation_trie", conv_trie)
    same_as_sql(spark, "op12_spelling_variants", spelling)


# Spelling variants


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(docs):
    n = Counter()
    for k, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if k is None else k}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: m for w, m in n.items() if m >= 2}
    forms, out = {}, {}
    for w in n:
        others = [v for v in n if near(w, v)]
        best = min(others, key=lambda v: (-n[v], v), default=None)
        forms[w] = best if best and n[best] >= 10 * n[w] else None
        out[w] = len(others)
    def root(w):
        return root(forms[w]) if forms[w] else w
    return {(w, n[w], out[w], forms[w], n.get(forms[w]), root(w)) for w in n}


def test_variants_against_brute_force(spark):
    from tailframe.llm.spelling import variants

    base = ["letters", "lettters", "leters", "lattice", "aaaaaaaa", "aaaaaaa", "aaaaaaab", "ébénisme", "ébéniste", "ÉBÉNISTE", "bébéniste", "colours", "colors", "colour", "xcolours", "coloursx", "abababab", "babababa"]
    rng = np.random.default_rng(3)
    docs = [(i, " ".join(rng.choice(base, 40))) for i in range(30)]
    docs += [(100, "Weather " * 1500 + "weathr1 " * 3), (101, "weathers " * 140), (102, "weathersx " * 13), (103, "wweathersx-wweathersx"), (None, "weathery weathery"), (104, None), (105, ""), (106, "z" * 5000 + " " + "z" * 5000), (107, "z" * 5001 + " " + "z" * 5001)]
    df = spark.createDataFrame([(i, t, 0, 0, "clash") for i, t in docs], "doc_id long, text string, n long, id long, word string")
    got = variants(df)
    assert {tuple(r[c] for c in ("word", "n", "n_near", "form", "form_n", "root")) for r in got.collect()} == brute_variants(docs)
    assert rows(variants(df.where("false"))) == []


def test_pivots_lose_no_pair():
    """Of random words over few letters and with many repeats, every near pair has a key in common."""
    from tailframe.llm import spelling as S

    rng = np.random.default_rng(1)
    base = {"".join(rng.choice(list("abé"), int(rng.integers(7, 12)))) for _ in range(120)}
    words = set(base)
    for w in base:
        i = int(rng.integers(len(w)))
        words |= {w[:i] + w[i + 1 :], w[:i] + "b" + w[i:], w[:i] + "é" + w[i + 1 :]}
    words = sorted(w for w in words if len(w) >= 7)
    freq = Counter(w[i : i + 2] for w in words for i in range(len(w) - 1))
    grams, index, probes = S.Grams(sorted(freq.items(), key=lambda x: (x[1], x[0]))), {}, {}
    for size in {len(w) for w in words}:
        own = [w for w in words if len(w) == size]
        codes = grams.number[np.array([[ord(c) for c in w] for w in own])]
        prefix = S.prefixes(grams.rank[codes[:, :-1], codes[:, 1:]])
        two = S.pivots(grams.freq[codes[:, :-1], codes[:, 1:]], prefix)
        assert (two[:, 1] - two[:, 0] >= 2).all() and np.take_along_axis(prefix, two, 1).all()
        for i, w in enumerate(own[:40]):  # the pair is the lightest of all disjoint ones
            f = [freq[w[p : p + 2]] for p in range(size - 1)]
            at = np.flatnonzero(prefix[i])
            assert f[two[i, 0]] + f[two[i, 1]] == min(f[a] + f[b] for a in at for b in at if b >= a + 2)
        ir, ik, pr, pk = S.keys_of(codes, grams)
        for store, r, k in ((index, ir, ik), (probes, pr, pk)):
            for a, b in zip(r.tolist(), k.tolist(), strict=True):
                store.setdefault(b, set()).add(own[a])
    met = {frozenset((a, b)) for k, x in probes.items() for a in x for b in index.get(k, ()) if a != b}
    assert {frozenset((a, b)) for i, a in enumerate(words) for b in words[:i] if near(a, b)} <= met


# Personal data

KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", lambda m: all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m.split("."))),
    ("card", r"[0-9](?:[\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(digits):
    doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in doubled) % 10 == 0


def base_spans(text):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, text or "") if ok(m.group())] for k, p, ok in KINDS]


PII = [
    (1, "é🙂 mail a.b%c@d-e.fr, c@d or x@y.z@q.w.. 1.2.3.4.5 300.1.1.1 1.2.3.004 +49 (30) 1234-5678 +1 2"), (2, None), (3, ""), (4, "4111 1111-1111 1111 and 4111111111111112 4111111111111111111 0000000000000000"),
    (5, "a" * 30000), (6, "1" * 30000 + "." + "1." * 9000), (7, "a@" + "b." * 9000 + "c"), (8, "@@ a@@b.c d@e.f%g@h.i.j"), (9, "+" * 3000 + "+12345678"), (10, "1 " * 9000), (None, "k@l.mn"), (4, "twice@two.org"), (4, "twice@two.org"),
    (11, "line\n+12 345\n678 90 x@y.com\u0000\u0001 \\G $1"), (12, "-1-2-3.4-5-6-7-8-9-0-1-2-3-4-5-6"),
]


def test_base_spans(spark):
    from tailframe.llm.pii import find

    df = spark.createDataFrame([(i, t, 0, 0, "clash") for i, t in PII], "doc_id long, text string, rid long, k long, spans string")
    got = Counter((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in rows(find(df)))
    want = Counter()
    for i, t in PII:
        found = base_spans(t)
        want[(i, *map(len, found), hashlib.sha256(",".join(sum(found, [])).encode()).hexdigest())] += 1
    assert got == want
    assert all(set(sum(base_spans(t), [])) <= {x for r in rows(find(df.where(F.col("doc_id") == i))) for x in r["spans"].split(",")} for i, t in PII[3:4])
    assert rows(find(df.where("false"))) == []


def planted(seed=4):
    """Texts with strict, written-out and false spans: what the method may add and what it must leave."""
    rng, out, true, false = np.random.default_rng(seed), [], set(), set()
    n = lambda k: "".join(rng.choice(list("23456789"), k))
    def card():
        body = "4" + n(14)
        return next(body + c for c in "0123456789" if luhn(body + c))
    for i in range(400):
        c = card()
        say, kind = [
            (f"mail me: {n(3)}u@host{n(2)}.com today", None), (f"call tel: +49 {n(3)} {n(4)} {n(3)} now", None), (f"card no {c} ok", None), (f"the host 10.{n(2)}.{n(2)}.{n(2)} answered", None),
            (f"contact jo{n(2)} (at) host{n(2)} (dot) org please", "email"), (f"call phone: {n(3)} {n(3)} {n(4)} today", "phone"), (f"visa card: {c[:4]}.{c[4:8]}.{c[8:12]}.{c[12:]} thanks", "card"),
            (f"order {n(3)} {n(3)} {n(4)}x shipped", "order"), (f"version {n(4)}/{n(4)}/{n(4)}/{n(4)} built", "version"), ("nothing to see", None),
        ][i % 10]
        out.append((i, say))
        if kind in ("email", "phone", "card"):
            true.add(i)
        elif kind:
            false.add(i)
    return out, true, false


def test_added_spans(spark):
    """Written-out forms with their cues are found, look-alikes are not, and base spans stay."""
    from tailframe.llm.pii import find

    docs, true, false = planted()
    got = {r["doc_id"]: r for r in rows(find(spark.createDataFrame(docs, "doc_id long, text string")))}
    for i, t in docs:
        base = sum(base_spans(t), [])
        assert set(base) <= set(got[i]["spans"].split(",")) | {""}
        added = set(got[i]["spans"].split(",")) - set(base) - {""}
        assert not added or i in true, (t, added)
    assert sum(len(set(got[i]["spans"].split(",")) - {""}) == 1 for i in true) >= 0.9 * len(true)


def test_expectation_maximisation(spark):
    """Estimated probabilities are those of the same recursion in numpy, and labelers of known reliability are told apart."""
    from tailframe.llm import pii

    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.3
    good = np.array([0.95, 0.9, 0.85, 0.8, 0.6, 0.55, 0.5])
    votes = np.where(rng.random((4000, 7)) < good, truth[:, None], ~truth[:, None]) * 2 - 1
    votes[rng.random((4000, 7)) < 0.2] = 0
    counts = Counter(map(tuple, votes.tolist()))
    schema = "kind_no int, " + ", ".join(f"{v} int" for v in pii.VOTES) + ", many int, parted int, times long"
    df = spark.createDataFrame([(0, *v, 0, 0, n) for v, n in counts.items()], schema).coalesce(1)
    got = {tuple(r[v] for v in pii.VOTES): r["p"] for r in pii.weighed(df).collect()}
    v, n = np.array(list(counts)), np.array(list(counts.values()), dtype=float)
    total = v.sum(axis=1)
    p = np.where(total > 1, 0.9, np.where(total < 1, 0.1, 0.5))
    for _ in range(pii.ROUNDS):
        share = ((n * p).sum() + 1) / (n.sum() + 2)
        odds = np.full(len(v), math.log(share / (1 - share)))
        for j in range(7):
            yes, no = v[:, j] == 1, v[:, j] == -1
            right = ((n * p)[yes].sum() + (n * (1 - p))[no].sum() + 4) / (n[yes | no].sum() + 5)
            right = min(max(right, 0.5), 0.99)
            odds += v[:, j] * math.log(right / (1 - right))
        p = 1 / (1 + np.exp(-odds))
    assert max(abs(got[tuple(x)] - y) for x, y in zip(v.tolist(), p, strict=True)) < 1e-9
    right = sum((got[tuple(x)] > 0.5) == t for x, t in zip(votes.tolist(), truth, strict=True)) / len(truth)
    assert right > 0.93  # the majority is right in some 85 of 100
    soft = pii.weighed(df)
    x = np.array([[1.0, *(float(c == a) for c in r for a in (1, -1)), 0.0, 0.0] for r in v.tolist()])
    w = np.zeros(x.shape[1])
    for _ in range(pii.STEPS):
        q = 1 / (1 + np.exp(-x @ w))
        w = w + pii.RATE * ((x * ((p - q) * n)[:, None]).sum(axis=0) / n.sum() - pii.DECAY * w)
    assert np.abs(np.array(pii.classifier(soft)[0]) - w).max() < 1e-8


def test_pii_runs_no_python(spark):
    from tailframe.llm import pii

    plan = pii.op13_pii(spark, SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


# Toxicity


def network(words=("bad",)):
    from tailframe.llm import toxicity as T

    rng = np.random.default_rng(2)
    f = lambda *s: rng.standard_normal(s).astype(np.float32) * 0.5
    p = {"words": f(len(words) + 2, T.WORD_DIM), "bytes": f(259, T.BYTE_DIM), "filters": f(T.WIDTH, T.BYTE_DIM, T.FILTERS), "fb": f(T.FILTERS), "W": f(2, T.WORD_DIM + T.FILTERS, 3 * T.HIDDEN), "b": f(2, 3 * T.HIDDEN), "U": f(2, T.HIDDEN, 3 * T.HIDDEN), "A": f(2 * T.HIDDEN, T.ATTEND), "v": f(T.ATTEND), "o": f(2 * T.HIDDEN), "c": f(1)}
    return T.Network({w: n + 2 for n, w in enumerate(words)}, p)


def test_words_bound_the_memory():
    """Many texts of distinct words, and one text of a great many, take no more than the store and one run of words."""
    net = network()
    texts = [" ".join(f"w{n}x{k}" for k in range(12000)) for n in range(24)] + [" ".join(f"v{k}" for k in range(250_000))]
    net.forget()
    tracemalloc.start()
    net.logits(iter(texts))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 90e6, peak


def test_runs_have_the_windows_of_the_text(monkeypatch):
    from tailframe.llm import toxicity as T

    text = " ".join(f"w{k}" for k in range(700)) + " " + "y" * 95
    words = T.words_of(text)
    number = {w: n for n, w in enumerate(words)}
    whole = T.windows_of([np.array([number[w] for w in words])])[1]
    monkeypatch.setattr(T, "SEGMENT", 6 * T.STRIDE)
    for long in (1 << 20, 100):
        monkeypatch.setattr(T, "LONG", long)
        parts = []
        for run in T.runs_of(text):
            assert len(run) <= 2 * T.SEGMENT + T.WINDOW
            parts.append(T.windows_of([np.array([number[w] for w in run])])[1])
        assert {tuple(w) for w in np.concatenate(parts).tolist()} >= {tuple(w) for w in whole.tolist()}


def test_every_short_passage_lies_whole_in_a_window():
    from tailframe.llm import toxicity as T

    size = T.WINDOW - T.STRIDE + 1
    for n in (size, 40, 100, 101, 117):
        windows = T.windows_of([np.arange(n)])[1]
        for at in range(n - size + 1):
            assert any(w[0] <= at and at + size - 1 <= max(w) for w in windows.tolist()) or n < T.WINDOW


# Rows that stay


def test_longest_spelling_of_an_id_stays(spark):
    from tailframe.llm.exact_dedup import keep_one

    data = [(i, "a b c" if k else "a  b  c  d".replace("d", ""), k) for i in range(20) for k in (0, 1)] + [(None, "n u l l", 0), (None, "null", 1), (50, "x y", 0), (50, "x y", 1)]
    kept = rows(keep_one(spark.createDataFrame(data, "doc_id long, text string, k int").repartition(7)))
    assert sorted((r["text"], r["doc_id"]) for r in kept) == [("a  b  c  ", 0), ("n u l l", None), ("x y", 50)]
    many = [(i, f"t {i}  x" if k else f"t {i} x", k) for i in range(30) for k in (0, 1)]
    kept = rows(keep_one(spark.createDataFrame(many, "doc_id long, text string, k int").repartition(5)))
    assert len(kept) == 30 and all(r["k"] == 1 for r in kept)


def test_extreme_vectors(spark):
    from tailframe.llm.embed_dedup import near_dedup

    big, unlike = [1e200, 2e200, -1e200, 3e200], [1e-200, -1e-200, 1e-200, 0.0]
    data = [(1, big, 0), (2, [x * 1.0000001 for x in big], 0), (3, unlike, 1), (4, [0.0, 1e-200, 1e-200, 1e-200], 1), (5, [5e-324, 5e-324], 2), (6, [1.0, 1.0], 2), (7, [1.7e308, 1.7e308], 2)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in rows(near_dedup(spark.createDataFrame(data, "vec_id long, embedding array<double>, label int")))}
    assert got == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (0, 4), 5: (2, 5), 6: (2, 5), 7: (2, 5)}


@pytest.mark.parametrize("kind", ["email", "ip", "card", "phone"])
def test_base_patterns_read_long_runs_once(spark, kind):
    """A run that could be tried from each of its characters is not: 300,000 of them end at once."""
    from tailframe.llm.pii import find

    run = {"email": "a" * 300_000, "ip": "1" * 300_000, "card": "1 " * 150_000, "phone": "+1" + "(" * 300_000}[kind]
    out = rows(find(spark.createDataFrame([(1, run)], "doc_id long, text string")))
    assert [out[0][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [0, 0, 0, 0]
