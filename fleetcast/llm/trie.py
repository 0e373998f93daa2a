"""The prefix trie of conversations, from vertical bitmaps.

Conversations are cut into shards of neighbouring ids. In a shard, each (position, turn) has a bitset of the conversations with that turn
there. A node's children are the intersections of its own bitset with the postings of the next position, depth first; their
popcounts are the members. Nodes of several shards meet by their path's 128-bit hash. Figures of subtrees are sums a shard
knows, less what other shards count as well: only nodes that several shards hold are looked at again.

Turns are ordered by turn, null first, and equal turns by the hash of role and text; null role and text are empty; rows without
conv_id are left out; rows that repeat are turns each. No conversations give no nodes, not even the root.
A conversation is rebuilt in one task, which holds about 200 bytes a turn of one shard, never texts.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetcast.llm.common import column
from fleetcast.llm.mixing import size_of
from fleetcast.session import written

#: Conversations of a family share their first one's head of up to SHARED - 1 turns.
FAMILY, SHARED = 20, 4
#: Turns after which a shard is closed, at the end of a family.
SHARD_TURNS = 16_384
ROOT = b"\0" * 16
NODES = (
    "shard long, pre long, last long, path binary, parent binary, depth long, n long, least long, words long, "
    "weighted long, own long, leaves long, ended long, ends string"
)
KINDS = [pa.int64()] * 3 + [pa.binary()] * 2 + [pa.int64()] * 8 + [pa.string()]

Turn = tuple[bytes, int]


def turns(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, family, head (turns it takes from the family's first), turn, key (hash of role and text), words."""
    conv, text = column(conv_col).cast("long"), F.coalesce(column(text_col).cast("string"), F.lit(""))
    role = F.coalesce(column(role_col).cast("string"), F.lit(""))
    key = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    return conversations.filter(conv.isNotNull()).select(
        conv.alias("conv_id"), (conv - conv % FAMILY).alias("family"), (F.crc32(conv.cast("string").cast("binary")) % SHARED).alias("head"),
        column(turn_col).cast("long").alias("turn"), key.alias("key"), size_of(text).alias("words"),
    )


def shard_nodes(ids: list[int], sequences: list[list[Turn]]) -> Iterator[tuple]:
    """The nodes of one shard, in preorder: a row of NODES each. `ids` ascend; bit k stands for ids[k]."""
    postings: list[dict[bytes, int]] = []
    ending: dict[int, int] = defaultdict(int)
    for k, own in enumerate(sequences):
        ending[len(own)] |= 1 << k
        while len(postings) < len(own):
            postings.append(defaultdict(int))
        for at, (key, _) in enumerate(own):
            postings[at][key] |= 1 << k
    rows, parents, last = [], [], []
    stack = [((1 << len(ids)) - 1, 0, 0, ROOT, None, -1)]
    while stack:
        members, depth, words, path, above, parent = stack.pop()
        at = len(rows)
        ended = members & ending.get(depth, 0)
        first = (members & -members).bit_length() - 1
        rows.append((path, above, depth, members.bit_count(), ids[first], words, ended))
        parents.append(parent)
        last.append(at)
        rest = members ^ ended
        while rest:
            key, more = sequences[(rest & -rest).bit_length() - 1][depth]
            child = rest & postings[depth][key]
            rest ^= child
            stack.append((child, depth + 1, more, hashlib.md5(path + key).digest(), path, at))
    weighted, own, leaves = [r[3] * r[5] for r in rows], [r[5] for r in rows], [0] * len(rows)
    for at in range(len(rows) - 1, -1, -1):
        leaves[at] = leaves[at] or 1
        if (parent := parents[at]) >= 0:
            last[parent] = max(last[parent], last[at])
            for figures in (weighted, own, leaves):
                figures[parent] += figures[at]
    for at, (path, above, depth, n, least, words, ended) in enumerate(rows):
        ends = []
        while ended:
            ends.append(str(ids[(ended & -ended).bit_length() - 1]))
            ended &= ended - 1
        yield ids[0], at, last[at], path, above, depth, n, least, words, weighted[at], own[at], leaves[at], len(ends), ",".join(ends) or None


def local_nodes(slim: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """The nodes of all shards, written. Families are dealt out by ranges of ids and streamed in order; a shard holds whole families."""

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[int], list[list[Turn]]]]:
        shard: dict[int, list[Turn]] = {}
        size, family, head = 0, None, []
        conv, own, taken = None, [], 0

        def close() -> None:
            nonlocal size
            shard[conv] = own if conv == family else head[:taken] + own[taken:]
            size += len(shard[conv])

        for batch in batches:
            for c, f, h, key, words in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "family", "head", "key", "words")), strict=True):
                if c != conv:
                    if conv is not None:
                        close()
                        if conv == family:
                            head = own[: SHARED - 1]
                    if f != family:
                        if size >= shard_turns:
                            yield sorted(shard), [shard[k] for k in sorted(shard)]
                            shard, size = {}, 0
                        family, head = f, []
                    conv, own, taken = c, [], h
                own.append((key, words))
        if conv is not None:
            close()
            yield sorted(shard), [shard[k] for k in sorted(shard)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = []
        for ids, sequences in shards(batches):
            for row in shard_nodes(ids, sequences):
                held.append(row)
                if len(held) >= 8192:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], names=names)
                    held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), KINDS)], names=names)

    names = [part.split()[0] for part in NODES.split(", ")]
    # the family's first conversation comes first
    order = ["family", (F.col("conv_id") != F.col("family")).alias("later"), "conv_id", F.col("turn").asc_nulls_first(), "key"]
    dealt = slim.repartitionByRange("family").sortWithinPartitions(*order)
    return written(dealt.mapInArrow(run, NODES), "trie-local")


def _digests(pieces: DataFrame) -> DataFrame:
    """path, ends_sha256 of the end lists (path, shard, ends): those of several shards are hashed one after another, as a stream."""
    counted = pieces.groupBy("path").agg(F.count("*").alias("parts"), F.first("ends").alias("ends"))
    alone = counted.filter("parts = 1").select("path", F.sha2("ends", 256).alias("ends_sha256"))
    several = pieces.join(counted.filter("parts > 1").select("path"), "path", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        for batch in batches:
            done = []
            for path, ends in zip(batch.column("path").to_pylist(), batch.column("ends").to_pylist(), strict=True):
                if path != at:
                    if at is not None:
                        done.append((at, digest.hexdigest()))
                    at, digest = path, hashlib.sha256(ends.encode())
                else:
                    digest.update(b"," + ends.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["path", "ends_sha256"])
        if at is not None:
            yield pa.RecordBatch.from_arrays([pa.array([at]), pa.array([digest.hexdigest()])], names=["path", "ends_sha256"])

    streamed = several.repartition("path").sortWithinPartitions("path", "shard").select("path", "ends")
    return alone.unionByName(streamed.mapInArrow(run, "path binary, ends_sha256 string"))


def _less(shared: DataFrame) -> DataFrame:
    """path, own, leaves: what the shards' sums under nodes of several shards count too often.

    In a shard, the nodes of several shards that another shard owns lie between a node's place in the order and the last below it.
    """
    below = F.struct(F.col("pre").alias("at"), F.lit(-1).alias("sign"), "twice", "twice_leaf")
    behind = F.struct(F.col("last").alias("at"), F.lit(1).alias("sign"), F.lit(0).cast("long").alias("twice"), F.lit(0).cast("long").alias("twice_leaf"))
    events = shared.select("shard", "path", F.explode(F.array(below, behind)).alias("e")).select("shard", "path", "e.*")
    so_far = Window.partitionBy("shard").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    sums = events.select(
        "path", "sign", "twice", "twice_leaf", F.sum("twice").over(so_far).alias("own"), F.sum("twice_leaf").over(so_far).alias("leaf")
    )
    return sums.groupBy("path").agg(
        F.sum(F.col("sign") * F.col("own") + F.col("twice")).alias("own_twice"), F.sum(F.col("sign") * F.col("leaf") + F.col("twice_leaf")).alias("leaves_twice")
    )


def prefix_trie(
    conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    shard_turns: int = SHARD_TURNS,
) -> DataFrame:
    """A row per node: path (hash), depth, conv_id (smallest member), parent_path, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, n_ends, ends_sha256."""
    local = local_nodes(turns(conversations, conv_col, turn_col, role_col, text_col), shard_turns)
    inner = F.col("last") > F.col("pre")
    merged = written(
        local.groupBy("path").agg(
            F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.sum("n").alias("n"),
            F.min("least").alias("least"), F.count("*").alias("shards"), F.min("shard").alias("owner"), F.max(inner).alias("inner"),
            F.sum("weighted").alias("weighted"), F.sum("own").alias("own"), F.sum("leaves").alias("leaves"), F.sum("ended").alias("ended"),
        ),
        "trie-merged",
    )
    several = merged.filter("shards > 1").select("path", "owner", F.col("inner").alias("inner_somewhere"))
    shared = local.select("shard", "pre", "last", "path", "words", inner.alias("inner_here")).join(several, "path")
    shared = shared.withColumns({
        "twice": F.when(F.col("shard") != F.col("owner"), F.col("words")).otherwise(0).cast("long"),
        "twice_leaf": F.when(~F.col("inner_here") & (F.col("inner_somewhere") | (F.col("shard") != F.col("owner"))), 1).otherwise(0).cast("long"),
    })
    less = _less(shared)
    digests = _digests(local.filter("ends IS NOT NULL").select("path", "shard", "ends"))
    children = merged.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("n_children"))
    # a node may have a third of all nodes as children; adaptive execution splits such a partition of this join
    parents = merged.filter("inner").select(F.col("path").alias("parent"), F.col("least").alias("parent_conv_id"))
    zero = F.lit(0).cast("long")
    return (
        merged.join(parents, "parent", "left").join(children, "path", "left").join(less, "path", "left").join(digests, "path", "left")
        .select(
            "path", "depth", F.col("least").alias("conv_id"), F.col("parent").alias("parent_path"), "parent_conv_id", F.col("n").alias("n_convs"),
            F.coalesce("n_children", zero).alias("n_children"), (F.col("leaves") - F.coalesce("leaves_twice", zero)).alias("n_leaves"),
            (F.col("weighted") - F.col("own") + F.coalesce("own_twice", zero)).alias("saved_tokens"), F.col("ended").alias("n_ends"),
            F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
        )
    )


def op11(spark, sf_dir: str) -> DataFrame:
    found = prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


OP11_SQL = r"""
WITH c AS (SELECT conv_id, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS k,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS words,
                  row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(strlen(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS rn
           FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT conv_id, conv_id - conv_id % 20 AS family, count(*) AS own,
               xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
                   lambda a, x: list_reduce(list_prepend(xor(a, x), [CAST(0 AS BIGINT) FOR i IN range(8)]), lambda b, y: xor(b >> 1, CAST(3988292384 AS BIGINT) * (b & 1)))),
                   CAST(4294967295 AS BIGINT)) % 4 AS h
        FROM c GROUP BY conv_id),
heads AS (SELECT i.conv_id, c.rn AS pos, c.k, c.words FROM ids i JOIN c ON c.conv_id = i.family AND c.rn <= i.h),
r AS (SELECT * FROM heads UNION ALL
      SELECT i.conv_id, coalesce(m.n, 0) + c.rn - i.h, c.k, c.words FROM ids i JOIN c ON c.conv_id = i.conv_id AND c.rn > i.h
      LEFT JOIN (SELECT conv_id, count(*) AS n FROM heads GROUP BY conv_id) m ON m.conv_id = i.conv_id),
steps AS (SELECT conv_id, pos AS depth, words, string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r
          UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
tops AS (SELECT conv_id, max(depth) AS depth FROM steps GROUP BY conv_id),
nodes AS (SELECT s.path, s.depth, any_value(s.words) AS words, min(s.conv_id) AS conv_id, count(*) AS n_convs,
                 coalesce(string_agg(CASE WHEN t.depth = s.depth THEN CAST(s.conv_id AS VARCHAR) END, ',' ORDER BY s.conv_id), '') AS ends
          FROM steps s JOIN tops t ON s.conv_id = t.conv_id GROUP BY s.path, s.depth),
kids AS (SELECT left(path, 32 * (depth - 1)) AS path, count(*) AS n FROM (SELECT path, CAST(depth AS INT) AS depth FROM nodes WHERE depth > 0) x GROUP BY 1),
under AS (SELECT left(u.path, 32 * CAST(a AS INT)) AS path, sum((u.n_convs - 1) * u.words) AS saved, count(*) FILTER (k.path IS NULL) AS leaves
          FROM (SELECT path, n_convs, words, unnest(range(0, depth + 1)) AS a FROM nodes) u LEFT JOIN kids k ON k.path = u.path GROUP BY 1)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(coalesce(k.n, 0) AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(n.ends) AS ends_sha256
FROM nodes n LEFT JOIN nodes p ON n.depth > 0 AND p.path = left(n.path, 32 * (CAST(n.depth AS INT) - 1)) AND p.depth = n.depth - 1
LEFT JOIN kids k ON k.path = n.path JOIN under u ON u.path = n.path
"""
