"""Prefix trie of conversations: balanced parentheses per shard, shared spines merged.

A turn becomes a token of 40 hex digits, half the SHA-256 of role and text and the text's UTF-8 length; a
conversation's tokens in order are its path. Sorted paths visit the trie depth first, so a range partition of them is a
consecutive part of it, and a hot first turn or a conversation with many copies spans as many partitions as it needs.
Each task cuts its part into shards of bounded size and encodes one as balanced parentheses:

* findclose by a min-max tree over blocks of excess values delimits all subtrees;
* rank over the pairs "()" counts the leaves between a parenthesis and its partner;
* cumulative arrays of copies and of savings, in preorder, give members and savings of a subtree as a difference.

A node that a shard shares with the one before or behind it lies on the spine: the path to their common prefix. Spine
nodes leave a shard as partial counts under a chained digest of their tokens. Merging adds these up, finds which of
them have no child, and gives every ancestor the savings and leaves of the spine nodes below it. All other nodes are
final in their shard. The ids of conversations that end at one node are hashed in ascending order; where they are
spread over shards, joined blocks of ids are sorted and streamed, one block in memory.

Texts are read once and never shuffled. A conversation's tokens, 40 bytes a turn, must fit into one row.

Turns are ordered by turn, null first, equal ones by token. A null role or text is an empty one. Rows with a null
conv_id belong to no conversation. Repeated rows are turns of their own. A conversation may have no turn (an empty path);
it ends at the root. Without any conversation there is no node, not even the root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskmill.lineage import cut_lineage
from riskmill.llm.common import small_side, whole_text

TOKEN = 40
LENGTH_DIGITS = 8
SHARD_NODES = 1 << 18
SHARD_IDS = 1 << 20
IDS_AT_ONCE = 1 << 16
BLOCK = 64
ROOT = bytes(16)
NOTHING = hashlib.sha256(b"").hexdigest()

NODE, SPINE, ENDS = 0, 1, 2
PARTS = pa.schema([
    ("kind", pa.int8()), ("key", pa.binary()), ("parent_key", pa.binary()), ("ancestors", pa.list_(pa.binary())),
    ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
    ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("n_bytes", pa.int64()),
    ("ends_sha256", pa.string()), ("ids", pa.string())])
PARTS_DDL = ("kind tinyint, key binary, parent_key binary, ancestors array<binary>, conv_id bigint, depth bigint, "
             "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, "
             "n_bytes bigint, ends_sha256 string, ids string")


def turn_token(role: Column, text: Column) -> Column:
    size = F.octet_length(text)
    named = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(named, 256), 1, TOKEN - LENGTH_DIGITS),
                    F.lpad(F.lower(F.hex(size.cast("bigint"))), LENGTH_DIGITS, "0"))


def token_sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, tokens) of each conversation, tokens in the order of its turns."""
    tokens = turns.where("conv_id is not null").select(
        "conv_id", F.struct("turn", turn_token(whole_text("role"), whole_text()).alias("token")).alias("row"))
    return tokens.groupBy("conv_id").agg(F.sort_array(F.collect_list("row"))["token"].alias("tokens"))


def trie_nodes(sequences: DataFrame, shard_nodes: int = SHARD_NODES, shard_ids: int = SHARD_IDS) -> DataFrame:
    """One row per trie node for rows (conv_id, tokens): conv_id (smallest member), depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    paths = sequences.select(F.concat_ws("", "tokens").alias("path"), "conv_id")
    placed = cut_lineage(paths.repartitionByRange("path", "conv_id").sortWithinPartitions("path", "conv_id"))
    parts = cut_lineage(placed.mapInArrow(_Shards(_borders(placed), shard_nodes, shard_ids), PARTS_DDL))
    spine = _merged_spine(parts)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = parts.where(F.col("kind") == NODE)
    parents = small_side(spine.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("found")))
    below_spine = nodes.where("parent_key is not null").join(parents, "parent_key") \
        .withColumn("parent_conv_id", F.col("found"))
    # The root alone has no parent; an inner join would lose it.
    top = spine.where("parent_key is null").withColumn("parent_conv_id", F.lit(None).cast("bigint"))
    on_spine = spine.join(parents, "parent_key").withColumn("parent_conv_id", F.col("found"))
    result = nodes.where("parent_key is null").select(*columns)
    for more in (below_spine, on_spine, top):
        result = result.unionByName(more.select(*columns))
    return result


def _borders(placed: DataFrame) -> dict[int, tuple[int, int]]:
    """For each partition with rows, how many turns its first and last path share with the neighbours' (-1: none)."""
    ends = placed.groupBy(F.spark_partition_id().alias("part")).agg(F.min("path").alias("low"), F.max("path").alias("high"))
    return dict(_shared(ends.orderBy("part").toLocalIterator()))


def _shared(ends: Iterator) -> Iterator[tuple[int, tuple[int, int]]]:
    before, held = None, None
    for row in ends:
        meeting = -1 if before is None else common_turns(before.high, row.low)
        if held is not None:
            yield before.part, (held, meeting)
        held, before = meeting, row
    if before is not None:
        yield before.part, (held, -1)


def common_turns(a: str, b: str) -> int:
    """Number of leading tokens that two paths share."""
    low, high = 0, min(len(a), len(b)) // TOKEN
    if a[:high * TOKEN] == b[:high * TOKEN]:
        return high
    while low + 1 < high:
        middle = (low + high) // 2
        if a[low * TOKEN:middle * TOKEN] == b[low * TOKEN:middle * TOKEN]:
            low = middle
        else:
            high = middle
    return low


def chained_keys(path: str, depth: int) -> list[bytes]:
    """Keys of the nodes on a path down to a depth, the root's first."""
    keys = [ROOT]
    for d in range(depth):
        keys.append(hashlib.sha256(keys[-1] + path[d * TOKEN:(d + 1) * TOKEN].encode()).digest()[:16])
    return keys


class _Shards:
    """Streams the sorted rows of a partition and cuts them into shards of bounded numbers of nodes and ids."""

    def __init__(self, borders: dict[int, tuple[int, int]], shard_nodes: int, shard_ids: int):
        self.borders, self.shard_nodes, self.shard_ids = borders, shard_nodes, shard_ids

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, right = self.borders.get(TaskContext.get().partitionId(), (-1, -1))
        paths: list[str] = []
        ids: list[list[int]] = []
        nodes = held = 0
        for batch in batches:
            for path, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                same = bool(paths) and paths[-1] == path
                if nodes >= self.shard_nodes or held >= self.shard_ids:
                    meeting = common_turns(paths[-1], path)
                    yield from shard_rows(paths, ids, left, meeting)
                    paths, ids, left, nodes, held, same = [], [], meeting, 0, 0, False
                if same:
                    ids[-1].append(conv_id)
                else:
                    nodes += len(path) // TOKEN - (common_turns(paths[-1], path) if paths else 0)
                    paths.append(path)
                    ids.append([conv_id])
                held += 1
        if paths:
            yield from shard_rows(paths, ids, left, right)


class Parentheses:
    """A trie's balanced parentheses with a min-max tree over blocks of excess, from the depths in preorder."""

    def __init__(self, depths: np.ndarray):
        nodes = np.arange(len(depths))
        # Of the parentheses before the j-th opening one, j open and j - depth close.
        self.opens = 2 * nodes - depths
        self.bits = np.zeros(2 * len(depths), np.int8)
        self.bits[self.opens] = 1
        self.excess = np.cumsum(2 * self.bits - 1, dtype=np.int32)
        self.opened = np.cumsum(self.bits, dtype=np.int64)
        blocks = -(-len(self.bits) // BLOCK)
        padded = np.full(blocks * BLOCK, np.iinfo(np.int32).max, np.int32)
        padded[:len(self.bits)] = self.excess
        self.rows = padded.reshape(blocks, BLOCK)
        self.width = 1 << max(blocks - 1, 0).bit_length()
        # Level by level, root at 1: the lowest excess of the blocks below; the highest needs no tree, as a close is
        # the first place below its opening excess.
        self.tree = np.full(2 * self.width, np.iinfo(np.int32).max, np.int32)
        self.tree[self.width:self.width + blocks] = self.rows.min(axis=1)
        for level in range(self.width.bit_length() - 2, -1, -1):
            low = 1 << level
            self.tree[low:2 * low] = np.minimum(self.tree[2 * low:4 * low:2], self.tree[2 * low + 1:4 * low:2])

    def find_close(self) -> np.ndarray:
        """Position of each node's closing parenthesis."""
        closes = np.empty(len(self.opens), np.int64)
        for at in range(0, len(self.opens), 1 << 14):
            closes[at:at + (1 << 14)] = self._find_close(self.opens[at:at + (1 << 14)])
        return closes

    def _find_close(self, opens: np.ndarray) -> np.ndarray:
        wanted = self.excess[opens] - 1
        block = opens // BLOCK
        hits = (self.rows[block] <= wanted[:, None]) & (np.arange(BLOCK) > (opens % BLOCK)[:, None])
        inside = hits.any(axis=1)
        found = np.where(inside, block * BLOCK + hits.argmax(axis=1), -1)
        left = np.flatnonzero(~inside)
        if len(left):
            target = wanted[left]
            node = block[left] + self.width
            # Up until a right sibling holds an excess low enough, then down to the first block that does.
            climbing = np.ones(len(left), bool)
            while climbing.any():
                sibling = node + 1
                ready = climbing & (node % 2 == 0)
                ready[ready] = self.tree[sibling[ready]] <= target[ready]
                node = np.where(ready, sibling, np.where(climbing, node // 2, node))
                climbing &= ~ready
            while (node < self.width).any():
                deeper = node < self.width
                first = np.where(deeper, 2 * node, node)
                low = self.tree[first] <= target
                node = np.where(deeper, np.where(low, first, first + 1), node)
            block = node - self.width
            found[left] = block * BLOCK + (self.rows[block] <= target[:, None]).argmax(axis=1)
        return found

    def leaf_pairs(self, counted: np.ndarray) -> np.ndarray:
        """Number of pairs "()" of counted nodes before each position, with one more position at the end."""
        pair = np.zeros(len(self.bits), np.int64)
        pair[self.opens] = counted
        pair[:-1] *= 1 - self.bits[1:]
        return np.concatenate([[0], np.cumsum(pair)])


def before(values: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(values)])


def shard_rows(paths: list[str], ids: list[list[int]], left: int, right: int) -> Iterator[pa.RecordBatch]:
    """Rows of the shard over distinct sorted paths: nodes, spine parts and blocks of ids that end on the spine.

    ``left`` and ``right`` say how many turns the first and the last path share with the shards beside this one.
    """
    depths, sizes, parents, ends = [0], [0], [-1], []
    stack, old = [0], ""
    first_nodes = 1
    for number, path in enumerate(paths):
        shared, long = common_turns(old, path), len(path) // TOKEN
        del stack[shared + 1:]
        for depth in range(shared + 1, long + 1):
            parents.append(stack[-1])
            stack.append(len(depths))
            depths.append(depth)
            sizes.append(int(path[depth * TOKEN - LENGTH_DIGITS:depth * TOKEN], 16))
        ends.append(stack[-1])
        old = path
        if number == 0:
            first_nodes = len(depths)
    depth, size, parent, end = (np.array(v, np.int64) for v in (depths, sizes, parents, ends))
    nodes = len(depth)
    spine = np.zeros(nodes, bool)
    spine[:min(first_nodes, max(left, 0) + 1)] = True
    spine[stack[:max(right, 0) + 1]] = True

    tree = Parentheses(depth)
    close = tree.find_close()
    last = tree.opened[close]
    here = np.arange(nodes)
    copies = np.zeros(nodes, np.int64)
    copies[end] = [len(i) for i in ids]
    members = before(copies)
    n_convs = members[last] - members[here]
    weight = np.where(spine, 0, (n_convs - 1) * size)
    savings = before(weight)
    saved = savings[last] - savings[here]
    pairs = tree.leaf_pairs(~spine)
    leaves = pairs[close + 1] - pairs[tree.opens]
    inner = here[~spine]
    children = np.bincount(parent[inner], minlength=nodes)
    smallest = np.full(nodes, np.iinfo(np.int64).max, np.int64)
    smallest[end] = [i[0] for i in ids]
    order = np.argsort(depth, kind="stable")
    levels = np.searchsorted(depth[order], np.arange(depth.max() + 2))
    for level in range(int(depth.max()), 0, -1):
        some = order[levels[level]:levels[level + 1]]
        np.minimum.at(smallest, parent[some], smallest[some])

    keys: dict[int, bytes] = {}
    above: dict[int, list[bytes]] = {}
    for path, limit in ((paths[0], left), (paths[-1], right)):
        line = stack if path is paths[-1] else range(first_nodes)
        chain = chained_keys(path, max(limit, 0))
        for d, key in enumerate(chain):
            keys[line[d]], above[line[d]] = key, chain[:d + 1]
    digests = {}
    for node, some in zip(ends, ids):
        if not spine[node]:
            digests[node] = hashlib.sha256(",".join(map(str, some)).encode()).hexdigest()
    under = spine[parent[inner]]
    yield _batch(len(inner), kind=NODE, conv_id=smallest[inner], depth=depth[inner], n_convs=n_convs[inner],
                 parent_conv_id=pa.array(smallest[parent[inner]], mask=under),
                 parent_key=[keys[p] if u else None for p, u in zip(parent[inner].tolist(), under.tolist())],
                 n_children=children[inner], n_leaves=leaves[inner], saved_tokens=saved[inner],
                 ends_sha256=[digests.get(n, NOTHING) for n in inner.tolist()])
    shared = here[spine]
    yield _batch(len(shared), kind=SPINE, key=[keys[n] for n in shared.tolist()],
                 parent_key=[above[n][-2] if len(above[n]) > 1 else None for n in shared.tolist()],
                 ancestors=[above[n] for n in shared.tolist()], conv_id=smallest[shared], depth=depth[shared],
                 n_convs=n_convs[shared], n_children=children[shared], n_leaves=leaves[shared],
                 saved_tokens=saved[shared], n_bytes=size[shared])
    blocks = [(keys[node], some[at:at + IDS_AT_ONCE]) for node, some in zip(ends, ids) if spine[node]
              for at in range(0, len(some), IDS_AT_ONCE)]
    yield _batch(len(blocks), kind=ENDS, key=[k for k, _ in blocks], conv_id=[some[0] for _, some in blocks],
                 ids=[",".join(map(str, some)) for _, some in blocks])


def _batch(rows: int, kind: int, **columns) -> pa.RecordBatch:
    filled = [pa.array(np.full(rows, kind, np.int8))]
    for field in list(PARTS)[1:]:
        values = columns.get(field.name)
        if values is None:
            values = pa.nulls(rows, field.type)
        filled.append(values if isinstance(values, pa.Array) else pa.array(values, field.type))
    return pa.RecordBatch.from_arrays(filled, schema=PARTS)


class _EndDigests:
    """Streams blocks of ids sorted by key and first id; one digest per key."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            found = []
            for next_key, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if next_key != key:
                    if key is not None:
                        found.append((key, digest.hexdigest()))
                    key, digest = next_key, hashlib.sha256()
                    digest.update(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            yield self._rows(found)
        if key is not None:
            yield self._rows([(key, digest.hexdigest())])

    @staticmethod
    def _rows(found: list[tuple[bytes, str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in found], pa.binary()),
                                           pa.array([d for _, d in found], pa.string())], ["key", "ends"])


def _merged_spine(parts: DataFrame) -> DataFrame:
    """Spine nodes with the sums over all shards: (key, parent_key, columns of a node)."""
    spine = cut_lineage(parts.where(F.col("kind") == SPINE).groupBy("key").agg(
        F.first("parent_key").alias("parent_key"), F.first("ancestors").alias("ancestors"),
        F.first("depth").alias("depth"), F.first("n_bytes").alias("n_bytes"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens")))
    below = spine.where("parent_key is not null").groupBy(F.col("parent_key").alias("key")).agg(F.count("*").alias("more"))
    whole = spine.join(below, "key", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more", F.lit(0)))
    given = whole.select(F.explode("ancestors").alias("key"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("own"),
                         (F.col("n_children") == 0).cast("bigint").alias("leaf"))
    sums = given.groupBy("key").agg(F.sum("own").alias("own"), F.sum("leaf").alias("leaf"))
    blocks = parts.where(F.col("kind") == ENDS).select("key", "conv_id", "ids")
    ends = blocks.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(_EndDigests(), "key binary, ends string")
    return cut_lineage(whole.join(sums, "key").join(ends, "key", "left").select(
        "key", "parent_key", "conv_id", "depth", "n_convs", "n_children",
        (F.col("n_leaves") + F.col("leaf")).alias("n_leaves"),
        (F.col("saved_tokens") + F.col("own")).alias("saved_tokens"),
        F.coalesce("ends", F.lit(NOTHING)).alias("ends_sha256")))
