"""Prefix tree of conversations: double-array tries a shard, upper nodes merged globally.

A turn is known by a 128-bit hash of its role and text, a prefix by the exclusive
or of its turns' hashes salted with their places; so the prefixes of a
conversation of any length come from running sums over bounded chunks, and texts
are read once and never shuffled.

A conversation's *stem* is its longest prefix that another one shares. Beyond it
every node has one member, one child and one leaf: those tails are rows by
themselves, as a double-array trie keeps single suffixes outside its arrays.
Different stems (with the number of their conversations) are dealt into shards.
Nodes with more than ``SHARD`` stem turns under them are upper nodes; a shard takes
some children of one upper node, or the whole tree if there is none. A task packs a
shard's stems into BASE and CHECK arrays over dense numbers of its turns and
traverses them for the nodes. Upper nodes are few; each shard's totals are added to
all of them by grouping.

A prefix with any number of copies is one stem, so copies are counted, not
gathered. The members that end at a node are hashed as one ordered stream, which
SHA-256 asks for; the stream holds ids only and is never held in memory.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docket.llm.groups import key_groups
from docket.operators.ordering import in_order
from docket.session import cut, ship_package

#: Stem turns in a shard at most.
SHARD = 50_000
#: Turns of a conversation over which a running sum goes at a time.
RUN = 1024
OPENING = 4
FAMILY = 20
NOTHING = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "p1", "p2"]


def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, k1, k2, words): each conversation's turns in order, from 1, by hash and number of words.

    Null turns come first, null roles and texts are empty. Equal turn numbers go
    by role, the text's first 64 characters and its hash; repeated rows are turns
    each. Rows without a conversation are left out.
    """
    said = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    by = F.coalesce(F.col(f"`{role}`").cast("string"), F.lit(""))
    whole = F.concat(F.length(by).cast("string"), F.lit(":"), by, said)
    rows = conversations.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("long").alias("conv_id"),
        F.col(f"`{turn}`").alias("turn"),
        F.md5(whole).alias("key"),
        F.regexp_count(said, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words"),
        by.alias("role"),
        F.substring(said, 1, 64).alias("start"),
    )
    placed = in_order(rows, "conv_id", F.col("turn").asc_nulls_first(), "role", "start", "key", pos="place")
    first = placed.groupBy("conv_id").agg(F.min("place").alias("first"))
    half = lambda at: F.conv(F.substring("key", at, 16), 16, -10).cast("long")
    return placed.join(first, "conv_id").select("conv_id", (F.col("place") - F.col("first") + 1).cast("long").alias("pos"), half(1).alias("k1"), half(17).alias("k2"), "words")


def rebuilt(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, k1, k2, words): the opening of the family's first conversation, then the own turns.

    Conversation c takes the first h turns of c - c % 20, h being the CRC-32 of
    its decimal number modulo 4, and its own turns after its first h. Every
    conversation also has a row of depth 0, whose other columns are null.
    """
    opens = F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(OPENING)).cast("long")
    convs = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    convs = convs.select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), opens.alias("h"))
    openings = rows.where(F.col("pos") < OPENING).select(F.col("conv_id").alias("family"), "pos", "k1", "k2", "words")
    heads = openings.groupBy("family").agg(F.max("pos").alias("there"))
    convs = cut(convs.join(heads, "family", "left").select("conv_id", "family", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken")))
    lent = convs.join(openings, "family").where(F.col("pos") <= F.col("h")).select("conv_id", F.col("pos").alias("depth"), "k1", "k2", "words")
    kept = rows.join(convs.select("conv_id", "h", "taken"), "conv_id").where(F.col("pos") > F.col("h"))
    kept = kept.select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "k1", "k2", "words")
    none = F.lit(None).cast("long")
    roots = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), none.alias("k1"), none.alias("k2"), F.lit(0).cast("long").alias("words"))
    return roots.unionAll(lent).unionAll(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """``rows`` (conv_id, depth, k1, k2, ...) with p1, p2: the 128 bits that name the prefix; zero at the root."""
    salted = rows.withColumn("p1", F.coalesce(F.xxhash64("k1", "k2", "depth"), F.lit(0)))
    salted = salted.withColumn("p2", F.xxhash64("depth", "k2", "k1", F.lit(11)))
    zero = F.col("depth") == 0
    salted = salted.withColumns({p: F.when(zero, 0).otherwise(F.col(p)).cast("long") for p in ("p1", "p2")})
    chunked = salted.withColumn("_run", F.floor(F.col("depth") / RUN))
    inside = W.partitionBy("conv_id", "_run").orderBy("depth").rowsBetween(W.unboundedPreceding, 0)
    before = W.partitionBy("conv_id").orderBy("_run").rowsBetween(W.unboundedPreceding, -1)
    totals = chunked.groupBy("conv_id", "_run").agg(F.bit_xor("p1").alias("q1"), F.bit_xor("p2").alias("q2"))
    totals = totals.select("conv_id", "_run", *[F.coalesce(F.bit_xor(q).over(before), F.lit(0)).alias(q) for q in ("q1", "q2")])
    summed = chunked.withColumns({p: F.bit_xor(p).over(inside) for p in ("p1", "p2")})
    out = summed.join(totals, ["conv_id", "_run"])
    return out.select(*[c for c in rows.columns], F.col("p1").bitwiseXOR(F.col("q1")).alias("p1"), F.col("p2").bitwiseXOR(F.col("q2")).alias("p2"))


def double_array(parent: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """BASE, CHECK and each node's slot, for nodes given by their parent (an earlier node) and turn code (from 1).

    Node 0 is the root, at slot 0. The child of slot s by code c lies at
    BASE[s] + c, and CHECK there is s; free slots have CHECK -1.
    """
    n, codes = len(parent), int(code.max(initial=0))
    order = 1 + np.argsort(parent[1:], kind="stable")
    starts = np.searchsorted(parent[order], np.arange(n + 1))
    base, check, slot = np.zeros(2 * n + codes + 2, np.int64), np.full(2 * n + codes + 2, -1, np.int64), np.zeros(n, np.int64)
    check[0], low = 0, 1  # slot 0 is the root's; every slot under low is taken
    for node in range(n):
        children = order[starts[node] : starts[node + 1]]
        if not len(children):
            continue
        wanted = np.sort(code[children])
        while check[low] >= 0:
            low += 1
        at = low
        while True:
            b = at - wanted[0]
            top = b + wanted[-1]
            if top >= len(check):
                more = max(len(check), int(top) + 1 - len(check))
                base, check = np.concatenate([base, np.zeros(more, np.int64)]), np.concatenate([check, np.full(more, -1, np.int64)])
            if len(wanted) == 1 or (check[b + wanted] < 0).all():
                break
            at += 1
            while at < len(check) and check[at] >= 0:
                at += 1
        base[slot[node]] = b
        check[b + wanted] = slot[node]
        slot[children] = b + code[children]
    return base, check, slot


def shard_nodes(g: pd.DataFrame) -> pd.DataFrame:
    """The nodes of one shard, from its stems' rows (stem, depth, k1, k2, p1, p2, words, members, tails, above).

    Rows are sorted by stem and depth. All stems begin at one node: the upper node
    that the shard hangs from, which isn't given, or the tree's root if no node
    is above the shards. members and tails are those of the stem.
    """
    stem = g["stem"].to_numpy()
    hangs = int(g["above"].iloc[0]) >= 0
    depth = g["depth"].to_numpy() - g["depth"].iloc[0]
    first = np.nonzero(np.concatenate([[True], stem[1:] != stem[:-1]]))[0]
    length = np.diff(np.concatenate([first, [len(g)]])) - 1
    keys = np.stack([g["k1"].to_numpy(), g["k2"].to_numpy()], axis=1)
    names = np.stack([g["p1"].to_numpy(), g["p2"].to_numpy()], axis=1)
    below = depth > 0
    codes = np.zeros(len(g), np.int64)
    if below.any():
        codes[below] = np.unique(keys[below], axis=0, return_inverse=True)[1].ravel() + 1
    # different nodes in order of depth; the row before a node's first row is its parent's
    _, one, node = np.unique(np.column_stack([depth, names]), axis=0, return_index=True, return_inverse=True)
    node = node.ravel()
    parent = np.where(depth[one] > 0, node[one - 1], 0)
    base, check, slot = double_array(parent, codes[one])
    # every stem walks the arrays; its members count at each slot it passes
    size = len(base)
    members, least, children = np.zeros(size, np.int64), np.full(size, np.iinfo(np.int64).max), np.zeros(size, np.int64)
    m, tails = g["members"].to_numpy()[first], g["tails"].to_numpy()[first]
    state = np.zeros(len(first), np.int64)
    for step in range(int(length.max()) + 1):
        on = np.nonzero(length >= step)[0]
        if step:
            went = base[state[on]] + codes[first[on] + step]
            if (check[went] != state[on]).any():
                raise AssertionError("a stem left the trie")
            state[on] = went
        np.add.at(members, state[on], m[on])
        np.minimum.at(least, state[on], stem[first[on]])
        done = on[length[on] == step]
        np.add.at(children, state[done], tails[done])
    leaves = children.copy()
    np.add.at(children, check[slot[1:]], 1)
    leaves += children == 0
    level, saved = depth[one], np.zeros(size, np.int64)
    saved[slot] = (members[slot] - 1) * g["words"].to_numpy()[one]
    for d in range(int(level.max()), 0, -1):
        at = slot[level == d]
        np.add.at(leaves, check[at], leaves[at])
        np.add.at(saved, check[at], saved[at])
    top = level == hangs
    parents = pd.array(least[check[slot]], dtype="Int64")
    parents[top] = pd.NA
    out = pd.DataFrame({"depth": g["depth"].to_numpy()[one], "p1": names[one, 0], "p2": names[one, 1], "conv_id": least[slot], "parent_conv_id": parents})
    out = out.assign(n_convs=members[slot], n_children=children[slot], n_leaves=leaves[slot], saved_tokens=saved[slot], top=top)
    return out[level >= hangs]


def ends_digest(ends: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of the ids (conv_id) that end at each node, ascending, as one stream a node."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, digest = None, None
        for b in batches:
            fresh = np.ones(len(b), bool)
            fresh[1:] = (b[NODE].to_numpy()[1:] != b[NODE].to_numpy()[:-1]).any(axis=1)
            marks = [*np.nonzero(fresh)[0], len(b)]
            for i, j in zip(marks[:-1], marks[1:], strict=True):
                key = tuple(int(x) for x in b[NODE].iloc[i])
                text = ",".join(map(str, b["conv_id"].iloc[i:j])).encode()
                if key == at:
                    digest.update(b"," + text)
                    continue
                if at is not None:
                    yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*NODE, "ends_sha256"])
                at, digest = key, hashlib.sha256(text)
        if at is not None:
            yield pd.DataFrame([(*at, digest.hexdigest())], columns=[*NODE, "ends_sha256"])

    dealt = ends.select(*NODE, "conv_id").repartition(*NODE).sortWithinPartitions(*NODE, "conv_id")
    return dealt.mapInPandas(run, "depth long, p1 long, p2 long, ends_sha256 string")


def _sha(text: Column) -> Column:
    return F.sha2(text.cast("string").cast("binary"), 256)


def trie(rows: DataFrame) -> DataFrame:
    """The nodes of the prefix tree of ``rows`` (conv_id, depth, k1, k2, words), which has a row of depth 0 for each conversation.

    (depth, p1, p2, conv_id, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256). No conversations, no nodes.
    """
    named = cut(prefixes(rows))
    shared = named.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n")).where((F.col("n") > 1) | (F.col("depth") == 0)).select(*NODE)
    in_stem = cut(named.join(shared, NODE, "left_semi"))
    lengths = named.groupBy("conv_id").agg(F.max("depth").alias("length"))
    stems_of = in_stem.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("at"))
    convs = cut(lengths.join(stems_of, "conv_id").select("conv_id", "length", "at.*"))
    tail = F.col("length") > F.col("depth")
    stems = convs.groupBy(*NODE).agg(F.min("conv_id").alias("stem"), F.count(F.lit(1)).alias("members"), F.sum(tail.cast("long")).alias("tails"))
    about = stems.select("stem", F.col("depth").alias("length"), "members", "tails")
    # one row a different stem and depth, with the turns that lie below it in the stem
    paths = cut(in_stem.join(about, F.col("conv_id") == F.col("stem")).where(F.col("depth") <= F.col("length")).drop("conv_id"))
    under = paths.groupBy(*NODE).agg(F.sum(F.col("length") - F.col("depth") + 1).alias("under"))
    deep = under.where(F.col("under") > SHARD).select(*NODE)
    upper = paths.join(deep, NODE, "left_semi").groupBy("stem").agg(F.max("depth").alias("above"))
    marked = cut(paths.join(upper, "stem", "left").withColumn("above", F.coalesce("above", F.lit(-1))))
    # a shard hangs from the last upper node of its stems and takes some of that node's children
    place = F.struct(*NODE)
    hung = marked.groupBy("stem").agg(
        F.max(F.when(F.col("depth") == F.col("above"), place)).alias("root"),
        F.max(F.when(F.col("depth") == F.col("above") + 1, F.xxhash64("p1", "p2"))).alias("child"),
        F.max(F.col("length") - F.col("above")).alias("below"),
    )
    hung = hung.where("below > 0").join(under.select(place.alias("root"), F.ceil(F.col("under") / SHARD).alias("parts")), "root", "left")
    part = F.pmod("child", F.coalesce("parts", F.lit(1)))
    hung = hung.select("stem", F.coalesce("root.depth", F.lit(-1)).alias("s0"), F.coalesce("root.p1", F.lit(0)).alias("s1"), F.coalesce("root.p2", F.lit(0)).alias("s2"), part.alias("s3"))
    shard = ["s0", "s1", "s2", "s3"]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in key_groups(batches, shard):
            yield shard_nodes(g)

    fields = "depth long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, top boolean"
    dealt = marked.where(F.col("depth") >= F.col("above")).join(hung, "stem").fillna(0, ["k1", "k2"])
    dealt = dealt.select(*shard, "stem", *NODE, "k1", "k2", "words", "members", "tails", "above").repartition(*shard).sortWithinPartitions(*shard, "stem", "depth")
    local = cut(dealt.mapInPandas(run, fields))
    upper, hangs = _upper(marked, local)
    nodes = upper.unionByName(local.drop("top")).join(hangs, NODE, "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "hangs_from")).drop("hangs_from")
    digests = ends_digest(convs.where(~tail))
    nodes = cut(nodes.join(digests, NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOTHING))))
    return nodes.unionByName(_tails(named, convs, nodes))


def _upper(marked: DataFrame, local: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes above the shards, and (depth, p1, p2, hangs_from): the smallest member of the parent of each child of them.

    Totals of the shards and stems below an upper node, and of upper nodes
    themselves, are added to all nodes above: one stem for each of them stands for
    its path.
    """
    above = marked.where(F.col("depth") <= F.col("above"))
    paths = cut(above.select("stem", *NODE, "words", "members", "tails", (F.col("length") == F.col("depth")).alias("ends")))
    own = paths.groupBy(*NODE).agg(
        F.min("stem").alias("conv_id"),
        F.sum("members").alias("n_convs"),
        F.max("words").alias("words"),
        F.sum(F.when(F.col("ends"), F.col("tails")).otherwise(0)).alias("tails"),
    )
    tops = marked.where(F.col("depth") == F.col("above") + 1).groupBy(*NODE).agg(F.min("stem").alias("stem"))
    tops = local.where("top AND depth > 0").select(*NODE, "n_leaves", "saved_tokens").join(tops, NODE)
    given = tops.groupBy("stem", F.col("depth").alias("from")).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    given = given.unionAll(own.select(F.col("conv_id").alias("stem"), F.col("depth").alias("from"), F.col("tails"), (F.col("n_convs") - 1) * F.col("words")))
    sums = paths.join(given, "stem").where(F.col("depth") <= F.col("from")).groupBy(*NODE).agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"))
    children = own.select("depth", "p1", "p2", F.col("conv_id").alias("stem")).unionAll(tops.select("depth", "p1", "p2", "stem"))
    children = children.select(*[F.col(c).alias(f"c_{c}") for c in NODE], "stem", (F.col("depth") - 1).alias("depth"))
    children = cut(children.join(paths.select("stem", *NODE), ["stem", "depth"]))
    counted = children.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n"))
    hangs = children.join(own.select(*NODE, F.col("conv_id").alias("hangs_from")), NODE).select(*[F.col(f"c_{c}").alias(c) for c in NODE], "hangs_from")
    nodes = own.join(sums, NODE).join(counted, NODE, "left")
    n_children = (F.coalesce("n", F.lit(0)) + F.col("tails")).alias("n_children")
    return nodes.select(*NODE, "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs", n_children, "n_leaves", "saved_tokens"), hangs


def _tails(named: DataFrame, convs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The nodes of one member: each conversation's turns beyond its stem."""
    ends = convs.where(F.col("length") > F.col("depth")).join(nodes.select(*NODE, F.col("conv_id").alias("stem_id")), NODE)
    ends = ends.select("conv_id", F.col("depth").alias("stem_depth"), "length", "stem_id")
    rows = named.join(ends, "conv_id").where(F.col("depth") > F.col("stem_depth"))
    last, one = F.col("depth") == F.col("length"), F.lit(1).cast("long")
    return rows.select(
        *NODE,
        "conv_id",
        F.when(F.col("depth") == F.col("stem_depth") + 1, F.col("stem_id")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        one.alias("n_convs"),
        F.when(last, 0).otherwise(one).cast("long").alias("n_children"),
        one.alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"),
        F.when(last, _sha(F.col("conv_id"))).otherwise(F.lit(NOTHING)).alias("ends_sha256"),
    )


def conversation_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the prefix tree of all rebuilt conversations; see ``turns``, ``rebuilt`` and ``trie``."""
    ship_package(conversations.sparkSession)
    return trie(rebuilt(cut(turns(conversations))))
