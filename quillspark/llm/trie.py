"""The trie of conversation prefixes: which conversations share how many first turns, and what sharing them saves.

Each conversation is a chain of digests: a prefix's is the SHA-256 of the digest before it and of its last turn, so two
prefixes are the same node if depth and digest are the same. Every prefix of every conversation is a row; nodes are the
groups of equal (depth, digest). A node is named by its smallest member. The nodes that a conversation names are a
stretch of its own path, from some depth down to its end, since who is smallest in a node is smallest in every node
below it on its path. So sums over subtrees need no row for every pair of node and ancestor: they run up along each
stretch, and each stretch's total is exploded to the ancestors above its top. That is at most one row for each prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillspark.llm.common import crc_mod, cut, ship

#: Fixed values of the recipe that rebuilds conversations: conversations in a family, and the modulus of the number of borrowed turns.
FAMILY = 5
BORROWED = 9
#: Conversation ids that are written together as one piece of a node's list.
PIECE = 8192
_PREFIX = "conv_id long, depth int, digest binary, parent binary, n_bytes long, ends boolean"


def turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, turn_digest, n_bytes): the turns of each conversation, numbered from 1 in order of turn, null first, ties by role, then by the digest (so that texts aren't shuffled).

    Null roles and texts are empty. Rows without a conv_id belong to no conversation and are left out. The digest is of
    the role's length, the role and the text, so different turns never give the same bytes.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), role.alias("role"), text.alias("text"))
    digest = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary"), 256))
    rows = rows.select("conv_id", "turn", "role", digest.alias("turn_digest"), F.octet_length("text").cast("long").alias("n_bytes"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "turn_digest")
    return rows.select("conv_id", F.row_number().over(order).alias("place"), "turn_digest", "n_bytes")


def borrowed(conv_id: Column) -> Column:
    """How many first turns a conversation takes from the first of its family."""
    return crc_mod(conv_id, BORROWED).cast("int")


def rebuilt(conversations: DataFrame) -> DataFrame:
    """(conv_id, part, place, turn_digest, n_bytes): each conversation with its first turns replaced by as many of its family's first conversation (conv_id less its remainder by FAMILY, with the sign of conv_id); one without any turn has a row whose digest is null.

    Turns in order of (part, place). What a conversation borrows is less than BORROWED turns, so a family's first
    conversation, however long, sends a few rows to each of FAMILY members.
    """
    own = cut(turns(conversations), "turns")
    every = own.groupBy("conv_id").agg(F.count("*").alias("n")).select("conv_id", borrowed(F.col("conv_id")).alias("h"), (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("first"))
    kept = own.where(F.col("place") > borrowed(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "place", "turn_digest", "n_bytes")
    lent = own.where((F.col("conv_id") % FAMILY == 0) & (F.col("place") < BORROWED)).withColumnRenamed("conv_id", "first")
    taken = every.join(lent, "first").where("place <= h").select("conv_id", F.lit(0).alias("part"), "place", "turn_digest", "n_bytes")
    bare = every.select("conv_id", F.lit(0).alias("part"), F.lit(0).alias("place"), F.lit(None).cast("binary").alias("turn_digest"), F.lit(0).cast("long").alias("n_bytes"))
    return bare.union(taken).union(kept)


def prefixes(rows: DataFrame) -> DataFrame:
    """(conv_id, depth, digest, parent, n_bytes, ends): every prefix of each conversation, the empty one included; parent is the digest of the prefix before it, n_bytes the size of its last turn, and `ends` marks the whole conversation.

    rows: see rebuilt. Digests form a chain, so a conversation is read in order as a stream of 32 bytes a turn; a task holds one turn at a time.
    """
    ship(rows.sparkSession)
    names = [x.split()[0] for x in _PREFIX.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]

    def batch(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), kinds, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        for b in batches:
            out = []
            for conv_id, turn, n_bytes in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if turn is None:  # a conversation begins
                    if last is not None:
                        out.append((*last, True))
                    last = (conv_id, 0, hashlib.sha256().digest(), b"", 0)
                else:
                    out.append((*last, False))
                    last = (conv_id, last[1] + 1, hashlib.sha256(last[2] + turn).digest(), last[2], n_bytes)
            if out:
                yield batch(out)
        if last is not None:
            yield batch([(*last, True)])

    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "part", "place").select("conv_id", "turn_digest", "n_bytes")
    return dealt.mapInArrow(run, _PREFIX)


def _digests(ends: DataFrame) -> DataFrame:
    """(depth, digest, ends_sha256): SHA-256 of the ascending conv_ids of each group, written with commas between.

    Ids are dealt by ranges, so a group that holds a third of all is many ranges; each range writes its ids as pieces of
    at most PIECE, and only the pieces of a group meet, as a stream in order.
    """
    order = [F.col("depth"), F.col("digest"), F.col("conv_id")]
    dealt = ends.select("depth", "digest", "conv_id").repartitionByRange(*order).sortWithinPartitions(*order)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            depths, digests, ids = (c.to_pylist() for c in b.columns)
            out, at = [], 0
            while at < len(ids):
                to = at + 1
                while to < len(ids) and to - at < PIECE and digests[to] == digests[at] and depths[to] == depths[at]:
                    to += 1
                out.append((depths[at], digests[at], ids[at], ",".join(map(str, ids[at:to]))))
                at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.int32(), pa.binary(), pa.int64(), pa.string()), strict=True)], ["depth", "digest", "first", "ids"])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, sha = None, None
        kinds, names = (pa.int32(), pa.binary(), pa.string()), ["depth", "digest", "ends_sha256"]
        for b in batches:
            out = []
            for depth, digest, ids in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if last != (depth, digest):
                    if last:
                        out.append((*last, sha.hexdigest()))
                    last, sha = (depth, digest), hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
        if last:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((*last, sha.hexdigest()), kinds, strict=True)], names)

    pieces = dealt.mapInArrow(join, "depth int, digest binary, first long, ids string")
    ordered = pieces.repartition("depth", "digest").sortWithinPartitions("depth", "digest", "first").select("depth", "digest", "ids")
    return ordered.mapInArrow(finish, "depth int, digest binary, ends_sha256 string")


def trie(rows: DataFrame) -> DataFrame:
    """One row for each node of the trie of conversations (rows: see rebuilt).

    conv_id       smallest member of the node: the conversations that begin with it
    depth         number of its turns; 0 is the root
    parent_conv_id  the parent's conv_id; null for the root
    n_convs       members
    n_children    children
    n_leaves      childless nodes in its subtree, itself included
    saved_tokens  over its subtree, (n_convs - 1) times the bytes of the node's last text
    ends_sha256   SHA-256 of the ascending ids of the members that have no further turn
    digest        SHA-256 of the chain to here
    All counts are long. A table without conversations has no nodes.
    """
    every = cut(prefixes(rows), "prefixes")
    node = ["depth", "digest", "parent", "n_bytes"]
    nodes = every.groupBy(*node).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"))
    # the nodes that a conversation names follow one another: each but the top one has its parent in the stretch
    path = W.partitionBy("conv_id").orderBy("depth")
    nodes = cut(nodes.withColumn("top", F.lag("depth").over(path).isNull()).withColumn("below", F.lead("depth").over(path).isNotNull()), "nodes")
    # tops of other stretches are the children that a node has besides the one on its own
    tops = nodes.where("top and depth > 0").select("conv_id", (F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest"))
    more = tops.groupBy("depth", "digest").agg(F.count("*").alias("n"))
    valued = nodes.join(more, ["depth", "digest"], "left").withColumn("n_children", F.coalesce("n", F.lit(0).cast("long")) + F.col("below").cast("long"))
    valued = valued.withColumn("leaf", (F.col("n_children") == 0).cast("long")).withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes"))
    down = W.partitionBy("conv_id").orderBy(F.col("depth").desc()).rowsBetween(W.unboundedPreceding, 0)
    valued = cut(valued.withColumn("leaves", F.sum("leaf").over(down)).withColumn("saves", F.sum("saved").over(down)).drop("n"), "valued")
    totals = valued.where("top and depth > 0").select("conv_id", F.col("depth").alias("top_depth"), "leaves", "saves")
    above = every.select("conv_id", "depth", "digest").join(totals, "conv_id").where("depth < top_depth")
    sums = above.groupBy("depth", "digest").agg(F.sum("leaves").alias("more_leaves"), F.sum("saves").alias("more_saves"))
    parents = _join_hot(tops, nodes.select("depth", "digest", F.col("conv_id").alias("parent_name"))).select("conv_id", (F.col("depth") + 1).alias("depth"), "parent_name")
    ends = _digests(every.where("ends"))
    found = valued.join(sums, ["depth", "digest"], "left").join(ends, ["depth", "digest"], "left").join(parents, ["conv_id", "depth"], "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return found.select(
        "conv_id", F.col("depth").cast("long").alias("depth"), F.when(~F.col("top"), F.col("conv_id")).otherwise(F.col("parent_name")).alias("parent_conv_id"), "n_convs", "n_children",
        (F.col("leaves") + zero("more_leaves")).alias("n_leaves"), (F.col("saves") + zero("more_saves")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"), F.lower(F.hex("digest")).alias("digest"),
    )


#: A node whose children are more than one in so many of all nodes is hot; there are fewer such nodes than this.
HOT = 1000


def _join_hot(tops: DataFrame, named: DataFrame) -> DataFrame:
    """tops (conv_id, and the parent's depth and digest) with the parent's name; parents with very many children, fewer than HOT, are met by broadcast, so no parent is a hot key of the shuffle."""
    key = ["depth", "digest"]
    counts = tops.groupBy(*key).agg(F.count("*").alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    hot = counts.where(F.col("n") * HOT > total).select(*key)
    near = F.broadcast(named.join(F.broadcast(hot), key))
    return tops.join(near, key).unionByName(tops.join(F.broadcast(hot), key, "left_anti").join(named, key))


def shared_prefixes(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations of a table (conv_id, turn, role, text); see turns, rebuilt and trie."""
    return trie(rebuilt(conversations))
