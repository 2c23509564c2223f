"""Prefix trie of rebuilt conversations, from composable fingerprints of their turns."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_groups, materialize, prefix_sums
from .sharding import crc_table

#: A conversation's base is the first of its hundred; its head has fewer than HEADS turns.
FAMILY, HEADS = 100, 6
#: Fingerprints are sums modulo the prime, one for each base: 124 bits in all.
PRIME = 2**31 - 1
BASES = (1103515245, 1664525, 134775813, 214013)
LANES = range(len(BASES))
#: Fingerprints that are tried before unlike turns in one node are an error.
ATTEMPTS = 3
#: Ids in a piece of the list of conversations that end in a node.
PIECE = 512


def power(base: int, exponent: Column) -> Column:
    """base ** exponent modulo the prime, for exponents below 2^31: the product of the squares that its bits name."""
    squares = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(pow(base, 1 << k, PRIME)).cast("long").alias("v")) for k in range(31)))
    return F.aggregate(squares, F.lit(1).cast("long"), lambda acc, s: F.when(F.getbit(exponent, s["k"]) == 1, acc * s["v"] % PRIME).otherwise(acc))


def numbered_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """c, i (from 1), role, text: the stored turns that references (c, i) name."""
    empty = F.lit("")
    said = turns.select(turns[conv].cast("long").alias("c"), turns[turn].alias("t"), F.coalesce(turns[role], empty).alias("role"), F.coalesce(turns[text], empty).alias("text")).where("c is not null")
    placed = prefix_sums(said, ["t", "role", "text"], {}, ["c"])
    return materialize(placed.select("c", (F.col("pos") + 1).alias("i"), "role", "text"), "turns")


def prefix_prints(turns: DataFrame, attempt: int) -> DataFrame:
    """c, i, size (code points) and q0..q3, the fingerprint of the first i turns: sum of hash(turn j) * base^j.

    A sequence's print is (length, sum); prints compose as (m, s) (n, t) = (m + n, s + base^m t), so the print of any run of
    turns, wherever it is put, follows from two prefixes.
    """
    hashed = [F.pmod(F.xxhash64("role", "text", F.lit(attempt * len(BASES) + n)), F.lit(PRIME)) for n in LANES]
    terms = turns.select("c", "i", F.char_length("text").alias("size"), *((hashed[n] * power(b, F.col("i")) % PRIME).alias(f"e{n}") for n, b in enumerate(BASES)))
    sums = prefix_sums(terms, ["i"], {f"s{n}": f"e{n}" for n in LANES}, ["c"])
    return materialize(sums.select("c", "i", "size", *(((F.col(f"s{n}") + F.col(f"e{n}")) % PRIME).alias(f"q{n}") for n in LANES)), "prefixes")


def conversations_of(prefixes: DataFrame) -> DataFrame:
    """c, n (own turns), h, base, k (turns of its head), a0.. (the head's print) and b0.. (that of its own first h turns)."""
    first = prefixes.where(F.col("i") < HEADS).select("c", "i", *(f"q{n}" for n in LANES))
    convs = prefixes.groupBy("c").agg(F.count("*").alias("n"))
    sizes = convs.select(F.col("c").alias("base"), F.col("n").alias("there"))
    convs = convs.withColumns({"h": F.crc32(F.col("c").cast("string")) % HEADS, "base": F.col("c") - F.col("c") % FAMILY})
    convs = convs.join(sizes, "base", "left").withColumn("k", F.least("h", F.coalesce("there", F.lit(0))))
    head = first.select(F.col("c").alias("base"), F.col("i").alias("k"), *(F.col(f"q{n}").alias(f"a{n}") for n in LANES))
    own = first.select("c", F.col("i").alias("h"), *(F.col(f"q{n}").alias(f"b{n}") for n in LANES))
    out = convs.join(head, ["base", "k"], "left").join(own, ["c", "h"], "left")
    zero = F.lit(0).cast("long")
    return materialize(out.select("c", "n", "h", "base", "k", *(F.coalesce(f"{x}{n}", zero).alias(f"{x}{n}") for x in "ab" for n in LANES)), "conversations")


def packed(lanes: list[Column]) -> tuple[Column, Column]:
    return tuple((F.shiftleft(lanes[n], 31) + lanes[n + 1]).alias(f"f{n // 2}") for n in (0, 2))  # type: ignore[return-value]


def paths_of(prefixes: DataFrame, convs: DataFrame) -> DataFrame:
    """c, d, f0, f1 (print of the first d rebuilt turns), rc, ri (the stored turn that is the last of them) and its size.

    No text is put together: a head's prints are the base's own, and behind a head of k turns the print of turn i is
    a + (q(i) - b) base^(k - h).
    """
    none = F.lit(None).cast("long")
    zero = [F.lit(0).cast("long") for _ in LANES]
    root = convs.select("c", F.lit(0).cast("long").alias("d"), *packed(zero), none.alias("rc"), none.alias("ri"), F.lit(0).alias("size"))
    first = prefixes.where(F.col("i") < HEADS).withColumnRenamed("c", "base")
    heads = convs.select("c", "base", "k").join(first, "base").where("i <= k")
    heads = heads.select("c", F.col("i").alias("d"), *packed([F.col(f"q{n}") for n in LANES]), F.col("base").alias("rc"), F.col("i").alias("ri"), "size")
    total = prefixes.count()
    tail = join_groups(prefixes, convs.withColumn("_n", F.col("n")), ["c"], "_n", total).where("i > h")
    back = [F.get(F.array(*(F.lit(pow(pow(b, -1, PRIME), s, PRIME)).cast("long") for s in range(HEADS))), (F.col("h") - F.col("k")).cast("int")) for b in BASES]
    prints = [(F.col(f"a{n}") + F.pmod(F.col(f"q{n}") - F.col(f"b{n}"), F.lit(PRIME)) * back[n]) % PRIME for n in LANES]
    tail = tail.select("c", (F.col("i") - F.col("h") + F.col("k")).alias("d"), *packed(prints), F.col("c").alias("rc"), F.col("i").alias("ri"), "size")
    return materialize(root.unionByName(heads).unionByName(tail), "paths")


def unlike(members: DataFrame, turns: DataFrame) -> bool:
    """Whether some node's last turns are not all the same bytes. Each stored turn is the last of one node, so texts meet once, and combine before the shuffle."""
    named = members.where("twins").select(F.col("rc").alias("c"), F.col("ri").alias("i"), "rep", "d").distinct()
    met = named.join(turns, ["c", "i"]).groupBy("rep", "d").agg(*(f(x).alias(f"{f.__name__}_{x}") for x in ("role", "text") for f in (F.min, F.max)))
    return not met.where("min_role <> max_role or min_text <> max_text").isEmpty()


def digests_of(ends: DataFrame) -> DataFrame:
    """rep, d, ends: SHA-256 of the ids c that end in each node, ascending and comma-joined.

    Ids are ordered and joined in pieces by many tasks. A digest reads its bytes one after the other, so a node of more than one piece streams
    its pieces through one task, which holds none of them.
    """
    placed = prefix_sums(ends, ["c"], {}, ["rep", "d"]).withColumn("piece", F.expr(f"pos div {PIECE}"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list("c")), lambda x: x.cast("string")), ",")
    pieces = materialize(placed.groupBy("rep", "d", "piece").agg(joined.alias("ids")), "pieces")
    groups = pieces.groupBy("rep", "d").agg(F.max("piece").alias("last"), F.min(F.when(F.col("piece") == 0, F.col("ids"))).alias("ids"))
    single = groups.where("last = 0").select("rep", "d", F.sha2("ids", 256).alias("ends"))
    several = pieces.join(pieces.where("piece = 1").select("rep", "d"), ["rep", "d"], "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state = None, None
        out: list[tuple[int, int, str]] = []
        for batch in batches:
            for r, d, ids in zip(*(batch.column(n).to_pylist() for n in (0, 1)), batch.column(3), strict=True):
                if (r, d) != at:
                    if state is not None:
                        out.append((*at, state.hexdigest()))
                    at, state = (r, d), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(ids.as_py().encode())
        if state is not None:
            out.append((*at, state.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([x[n] for x in out], k) for n, k in enumerate((pa.int64(), pa.int64(), pa.string()))], names=["rep", "d", "ends"])

    several = several.select("rep", "d", "piece", "ids").repartition("rep", "d").sortWithinPartitions("rep", "d", "piece")
    return single.unionByName(several.mapInArrow(run, "rep long, d long, ends string"))


def members_of(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, members): rep, d, n_convs, size of every node, and c, d, rep, rc, ri, twins of every rebuilt conversation at every depth.

    A node is named by its smallest member rep and its depth. Fingerprints group members; that the grouped turns are equal is checked on
    their texts, and should two unlike ones meet, other fingerprints are taken.
    """
    for attempt in range(ATTEMPTS):
        prefixes = prefix_prints(turns, attempt)
        convs = conversations_of(prefixes)
        paths = paths_of(prefixes, convs)
        ref = F.struct("rc", "ri")
        nodes = paths.groupBy("d", "f0", "f1").agg(F.min("c").alias("rep"), F.count("*").alias("n_convs"), F.max("size").alias("size"), (F.min(ref) != F.max(ref)).alias("twins"))
        nodes = materialize(nodes, "nodes")
        members = join_groups(paths, nodes.select("d", "f0", "f1", "rep", "twins", "n_convs"), ["d", "f0", "f1"], "n_convs", paths.count())
        members = materialize(members.select("c", "d", "rep", "rc", "ri", (F.col("twins") & (F.col("d") > 0)).alias("twins")), "members")
        if not unlike(members, turns):
            return nodes.select("rep", "d", "n_convs", "size"), members
    raise RuntimeError("unlike turns have equal fingerprints")


def prefix_trie(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each node of the trie of rebuilt conversations: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Turns are ordered by turn, role and text, nulls first; null role and text are empty. Conversation c begins with the first h turns of
    c - c % FAMILY and goes on with its own behind the first h, h being crc32(c) % HEADS. A conversation of no turns is a member of the root.

    Members of a node at greater depth are fewer, so a conversation that names a node (its smallest member) names all that follow on its path: a
    chain. A node's subtree is the rest of its own chain and, whole, the chains of its other members, so subtree sums are one grouped
    sum over members, however deep the trie is. Huge conversations and nodes of many members are spread over tasks.

    Rows with a null conversation id belong to none and are left out. Repeated rows are repeated turns. An empty table gives no rows, other columns are ignored.
    """
    stored = numbered_turns(turns, conv, turn, role, text)
    nodes, members = members_of(stored)
    away = F.col("rep") != F.col("c")
    chains = members.groupBy("c").agg(F.max(F.struct("d", "rep")).alias("end"), F.max(F.when(away, F.struct("d", "rep"))).alias("joint"))
    chains = materialize(chains.select("c", F.col("end.d").alias("length"), F.col("end.rep").alias("end_rep"), F.col("joint.d").alias("joint_d"), F.col("joint.rep").alias("joint_rep")), "chains")
    own = chains.where("joint_d is null or length > joint_d")  # conversations that name nodes
    children = own.where("joint_d is not null").groupBy(F.col("joint_rep").alias("rep"), F.col("joint_d").alias("d")).agg(F.count("*").alias("others"))
    total = nodes.count()
    full = join_groups(nodes, own.select(F.col("c").alias("rep"), "length", "joint_d", "joint_rep", F.col("length").alias("_n")), ["rep"], "_n", total).join(children, ["rep", "d"], "left")
    n_children = F.coalesce("others", F.lit(0)) + (F.col("d") < F.col("length")).cast("long")
    parent = F.when(F.col("d") == 0, F.lit(None)).when(F.col("d") == F.col("joint_d") + 1, F.col("joint_rep")).otherwise(F.col("rep"))
    full = full.select("rep", "d", parent.alias("parent"), "n_convs", n_children.alias("n_children"), (-F.col("d")).alias("up"), ((F.col("n_convs") - 1) * F.col("size")).alias("saved"))
    full = materialize(full.withColumn("leaf", (F.col("n_children") == 0).cast("long")), "chained")
    below = prefix_sums(full, ["up"], {"leaves": "leaf", "tokens": "saved"}, ["rep"])
    whole = full.groupBy(F.col("rep").alias("c")).agg(F.sum("leaf").alias("l"), F.sum("saved").alias("s"), F.count("*").alias("k"))
    whole = materialize(whole.join(chains.select("c", "length"), "c").drop("k"), "whole")
    aside = join_groups(members.where(away).select("c", "rep", "d"), whole, ["c"], "length", members.count())
    aside = aside.where("l is not null").groupBy("rep", "d").agg(F.sum("l").alias("l"), F.sum("s").alias("s"))
    ends = digests_of(materialize(chains.select(F.col("end_rep").alias("rep"), F.col("length").alias("d"), "c"), "ends"))
    out = below.join(aside, ["rep", "d"], "left").join(ends, ["rep", "d"], "left")
    zero = F.lit(0)
    return out.select(
        F.col("rep").alias("conv_id"), F.col("d").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + F.col("leaf") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("tokens") + F.col("saved") + F.coalesce("s", zero)).alias("saved_tokens"),
        F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op11_conversation_trie(spark, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE_SQL = f"""
WITH crc AS (SELECT CAST({crc_table()} AS BIGINT[]) AS tab),
t AS (SELECT conv_id AS c, coalesce(role, '') AS r, coalesce(text, '') AS x, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n FROM t GROUP BY c),
h AS (SELECT c, n, c - c % 100 AS base,
  xor(list_reduce(list_transform(regexp_extract_all(hex(CAST(c AS VARCHAR)), '..'), lambda v: CAST('0x' || v AS BIGINT)), lambda a, b: xor(a >> 8, tab[(xor(a, b) & 255) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h FROM n, crc),
k AS (SELECT h.*, least(h.h, coalesce(n.n, 0)) AS k FROM h LEFT JOIN n ON n.c = h.base),
made AS (
  SELECT k.c, t.i AS d, r, x FROM k JOIN t ON t.c = k.base AND t.i <= k.k
  UNION ALL SELECT k.c, t.i - h + k AS d, r, x FROM k JOIN t ON t.c = k.c AND t.i > h),
path AS (SELECT k.c, coalesce(p, []) AS p FROM k LEFT JOIN (SELECT c, list({{'r': r, 'x': x}} ORDER BY d) AS p FROM made GROUP BY c) m ON m.c = k.c),
step AS (SELECT c, d, p[1:d] AS pre, len(p) = d AS ends FROM (SELECT *, unnest(range(0, len(p) + 1)) AS d FROM path)),
node AS (SELECT pre, d, min(c) AS rep, count(*) AS n_convs, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends) AS ids FROM step GROUP BY pre, d),
child AS (SELECT pre[1:d - 1] AS pre, d - 1 AS d, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
val AS (SELECT node.*, coalesce(child.n, 0) AS n_children, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * length(node.pre[node.d].x) END AS saved FROM node LEFT JOIN child ON child.pre = node.pre AND child.d = node.d),
up AS (SELECT pre[1:e] AS pre, e AS d, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS e FROM val) GROUP BY ALL)
SELECT val.rep AS conv_id, val.d AS depth, parent.rep AS parent_conv_id, val.n_convs, val.n_children, CAST(leaves AS BIGINT) AS n_leaves, CAST(up.saved AS BIGINT) AS saved_tokens, sha256(coalesce(val.ids, '')) AS ends_sha256
FROM val JOIN up ON up.pre = val.pre AND up.d = val.d LEFT JOIN node parent ON val.d > 0 AND parent.d = val.d - 1 AND parent.pre = val.pre[1:val.d - 1]
"""
