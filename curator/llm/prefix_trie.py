"""A trie of conversations by their prefixes, with totals of every subtree.

Built by halving depths. The deepest conversation gives the first cut: every sequence is cut at half depth, equal front
halves that begin at the same node get one name (the smallest member's id, which with the depth is the node), and the upper trie and
the forest of lower ones, which begin at the named nodes, are cut again at their own half depths, all subproblems of a
size in one job. Equal halves are told by digests of whole blocks of turns, made bottom-up by pairs. A sequence that is
alone behind a cut needs no more names: it is its own node from there on. Then totals go up by the same cuts, smallest first:
what a lower trie holds is grafted on each node above its root within the upper one.

So there are as many rounds as the depth has binary digits, whatever the number of conversations; no conversation and no
node's members are gathered anywhere. Turns are numbered by ranges of (conversation, turn) and counts of the ranges in
front. Texts are read once and only their digests move. The digest of a node's ends, which must read ids in order,
is taken where a range of sorted ids holds a whole node; of nodes that span ranges, ids are joined into blocks first, and
one stream reads those (it holds a block at a time).

Edge cases: rows without a conversation are left out; turns without a number come first; rows that agree in
conversation and turn (repeated ones too) are ordered by the digest of role and text; null role or text is empty; a conversation
that is left without turns ends at the root; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, scratch_scope, written

#: Ids in a block of a node's ends that is handed on.
BLOCK = 4096
#: Turns of another conversation that one can begin with, at most.
MOST_HEAD = 5

NODE = ["depth", "conv_id"]


def _digest(*parts: Column) -> Column:
    """128 bits of SHA-256."""
    return F.substring(F.unhex(F.sha2(F.concat(*parts), 256)), 1, 16)


# -------------------------------------------------------------------- turns
def numbered(rows: DataFrame) -> DataFrame:
    """(conv_id, pos, digest, chars): the turns of each conversation, numbered from 1."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    turn = _digest(F.length(role).cast("string").cast("binary"), F.lit(":").cast("binary"), role.cast("binary"), text.cast("binary"))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("bigint"), "turn", turn.alias("digest"), F.length(text).cast("bigint").alias("chars"))
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc()]
    # where rows agree in all of these, only their running number can split them
    dealt = written(turns).withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row").sortWithinPartitions(*order)
    rows = written(dealt.select("conv_id", "digest", "chars", F.monotonically_increasing_id().alias("_at")).withColumn("_task", F.shiftright("_at", 33)))
    pieces = rows.groupBy("conv_id", "_task").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("conv_id").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    pieces = pieces.select("conv_id", "_task", (F.coalesce(before, F.lit(0)) - F.col("_first") + 1).alias("_shift"))
    return rows.join(pieces, ["conv_id", "_task"]).select("conv_id", (F.col("_at") + F.col("_shift")).alias("pos"), "digest", "chars")


def rebuilt(turns: DataFrame, group: int = 100, kinds: int = 6) -> tuple[DataFrame, DataFrame]:
    """Sequences (conv_id, depth, digest, chars) and lengths (conv_id, len).

    A conversation c begins with the first crc32(c) mod kinds turns of the conversation c - c mod group, and goes on with
    its own behind as many.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % kinds
    lengths = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    firsts = turns.where((F.col("conv_id") % group == 0) & (F.col("pos") < kinds))
    firsts = firsts.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("pos", "digest", "chars"))).alias("firsts"))
    firsts = firsts.withColumnRenamed("conv_id", "base")
    convs = lengths.withColumn("h", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % group).join(firsts, "base", "left")
    begin = F.coalesce(F.slice("firsts", F.lit(1), F.col("h").cast("int")), F.array().cast("array<struct<pos:bigint,digest:binary,chars:bigint>>"))
    convs = written(convs.select("conv_id", "own", "h", begin.alias("begin")))
    front = convs.select("conv_id", F.explode("begin").alias("t")).select("conv_id", F.col("t.pos").alias("depth"), "t.digest", "t.chars")
    shift = convs.select("conv_id", "h", (F.size("begin") - F.col("h")).alias("shift"))
    behind = turns.join(shift, "conv_id").where("pos > h").select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "digest", "chars")
    length = F.size("begin") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return front.unionByName(behind), convs.select("conv_id", length.cast("bigint").alias("len"))


# -------------------------------------------------------------------- names
def _blocks(turns: DataFrame, levels: int) -> list[DataFrame]:
    """For each j below levels, (conv_id, block, digest, chars) of all whole blocks of 2^j turns; chars are those of the last turn."""
    out = [turns.select("conv_id", (F.col("depth") - 1).alias("block"), "digest", "chars")]
    for _ in range(1, levels):
        even = F.col("block") % 2 == 0
        pair = out[-1].groupBy("conv_id", F.shiftright("block", 1).alias("block")).agg(
            F.max(F.when(even, F.col("digest"))).alias("_a"), F.max(F.when(~even, F.col("digest"))).alias("_b"), F.max(F.when(~even, F.col("chars"))).alias("chars")
        )
        out.append(written(pair.where("_a IS NOT NULL AND _b IS NOT NULL").select("conv_id", "block", _digest(F.col("_a"), F.col("_b")).alias("digest"), "chars")))
    return out


def _named(turns: DataFrame, lengths: DataFrame, root: int, shared: bool, levels: int) -> tuple[DataFrame, DataFrame]:
    """Nodes (depth, conv_id, n_convs, chars) at all depths from 1 and paths (member, len, depth, conv_id, n_convs), as far as not alone before."""
    open_ = lengths.where("len > 0").select(F.col("conv_id").alias("member"), F.lit(0).cast("bigint").alias("block"), F.lit(root).cast("bigint").alias("root"), "len").where(F.lit(shared))
    blocks = _blocks(turns, levels)
    nodes, paths = [], []
    for level in range(levels - 1, -1, -1):  # blocks of 2^(level + 1) turns are cut in halves of 2^level
        half = 1 << level
        fronts = blocks[level].where("block % 2 = 0").select(F.col("conv_id").alias("member"), F.shiftright("block", 1).alias("block"), "digest", "chars")
        cut = written(open_.join(fronts, ["member", "block"]))
        key = ["block", "root", "digest"]
        names = cut.groupBy(*key).agg(F.min("member").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"))
        names = written(names.withColumn("depth", F.col("block") * (2 * half) + half))
        nodes.append(names.select("depth", "conv_id", "n_convs", "chars"))
        named = written(cut.select("member", "len", *key).join(names.drop("chars"), key).select("member", "len", "block", "depth", "conv_id", "n_convs"))
        paths.append(named.select("member", "len", "depth", "conv_id", "n_convs"))
        if level:
            upper = open_.select("member", (F.col("block") * 2).alias("block"), "root", "len")
            lower = named.where("n_convs > 1 AND depth < len").select("member", (F.col("block") * 2 + 1).alias("block"), F.col("conv_id").alias("root"), "len")
            open_ = written(upper.unionByName(lower).where(F.col("block") * half < F.col("len")))
    return _all(nodes), _all(paths)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


# ------------------------------------------------------------------- totals
def _totals(nodes: DataFrame, paths: DataFrame, levels: int) -> DataFrame:
    """nodes (depth, conv_id, leaves, saved) with both summed over subtrees: lower tries' totals are grafted on what is above their roots.

    After the step for blocks of 2^(j+1) depths, a node's totals hold all below it in its block, so a root of a lower half has its whole lower trie.
    """
    totals = written(nodes)
    for level in range(levels):
        half = 1 << level
        roots = totals.where(F.col("depth") % (2 * half) == half).select(F.col("conv_id").alias("member"), (F.floor(F.col("depth") / half) - 1).alias("block"), "leaves", "saved")
        above = paths.withColumn("block", F.floor(F.col("depth") / half))
        grafts = roots.join(above, ["member", "block"]).select(*NODE, "leaves", "saved")
        totals = written(totals.unionByName(grafts).groupBy(*NODE).agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved")))
    return totals


# --------------------------------------------------------------------- ends
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, conv_id, member) in order: the digests of nodes that lie in this task, or else their ids in blocks.

    Its first and last node may go on in other tasks, and one of more than a block is left to the stream behind.
    """
    key, ids, rows, open_ = None, [], [], True

    def block() -> tuple:
        row = (*key, ids[0], ",".join(map(str, ids)), None)
        ids.clear()
        return row

    def out() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
        columns = list(zip(*rows)) if rows else [()] * 5
        rows.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "first", "ids", "ends_sha256"])

    for batch in batches:
        for depth, conv, member in zip(*(c.to_pylist() for c in batch.columns)):
            if (depth, conv) != key:
                if ids:
                    if open_:
                        rows.append(block())
                    else:
                        rows.append((*key, None, None, hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()))
                        ids.clear()
                    open_ = False
                elif key is not None:
                    open_ = False
                key = (depth, conv)
            ids.append(member)
            if len(ids) == BLOCK:
                rows.append(block())
                open_ = True
            if len(rows) >= 1024:
                yield out()
    if ids:
        rows.append(block())
    yield out()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (depth, conv_id, first, ids) in order: the digest of each node's blocks."""
    key, sha, rows = None, None, []
    for batch in batches:
        columns = [batch.column(i) for i in (0, 1, 3)]
        for depth, conv, ids in zip(*(c.to_pylist() for c in columns)):
            if (depth, conv) != key:
                if key is not None:
                    rows.append((*key, sha.hexdigest()))
                key, sha = (depth, conv), hashlib.sha256(ids.encode())
            else:
                sha.update(f",{ids}".encode())
    if key is not None:
        rows.append((*key, sha.hexdigest()))
    columns = list(zip(*rows)) if rows else [()] * 3
    kinds = (pa.int64(), pa.int64(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=[*NODE, "ends_sha256"])


def _ends(members: DataFrame) -> DataFrame:
    """(depth, conv_id, ends_sha256) of (depth, conv_id, member): SHA-256 of the ids in ascending order, joined by commas."""
    order = [*NODE, "member"]
    sorted_ = written(members.select(*order)).repartitionByRange(*order).sortWithinPartitions(*order)
    parts = written(sorted_.mapInArrow(_joined, "depth bigint, conv_id bigint, first bigint, ids string, ends_sha256 string"))
    blocks = parts.where("ends_sha256 IS NULL").select(*NODE, "first", "ids").repartition(*NODE).sortWithinPartitions(*NODE, "first")
    return parts.where("ends_sha256 IS NOT NULL").select(*NODE, "ends_sha256").unionByName(blocks.mapInArrow(_streamed, "depth bigint, conv_id bigint, ends_sha256 string"))


# --------------------------------------------------------------------- trie
RESULT = [*NODE, "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row per node of the trie of sequences (conv_id, depth, digest, chars), of which lengths has every (conv_id, len)."""
    with scratch_scope():
        turns, lengths = written(turns), written(lengths)
        root, members, deepest = lengths.agg(F.min("conv_id"), F.count(F.lit(1)), F.max("len")).first()
        root, levels = root or 0, (deepest or 0).bit_length()
        top = lengths.agg(F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("conv_id"), "n_convs", F.lit(0).cast("bigint").alias("chars"))
        at_top = lengths.where("len = 0").select(F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("conv_id"), F.col("conv_id").alias("member"))
        if not levels:  # no turns at all
            digests = _ends(at_top)
            none = F.lit(0).cast("bigint")
            return kept(top.join(digests, NODE).select(*NODE, F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", none.alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), none.alias("saved_tokens"), "ends_sha256"))
        names, paths = _named(turns, lengths, root, members > 1, levels)
        shared_paths = paths.where("n_convs > 1")
        lone = paths.where("n_convs = 1").groupBy(F.col("member").alias("conv_id")).agg(F.min("depth").alias("from"))
        if members == 1:
            lone = lengths.select("conv_id", F.lit(1).cast("bigint").alias("from"))
        lone = written(lone.join(lengths, "conv_id").where("len >= from"))
        shared = names.where("n_convs > 1")

        # parents of the nodes that stand first in their conversation, and what these add to them
        heads = shared.select(*NODE, F.lit(0).alias("alone")).unionByName(lone.select(F.col("from").alias("depth"), "conv_id", F.lit(1).alias("alone")))
        above = shared_paths.select(F.col("member").alias("conv_id"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("_up"))
        heads = written(heads.join(above, NODE, "left").select(*NODE, "alone", F.when(F.col("depth") == 1, F.lit(root)).otherwise(F.col("_up")).alias("parent_conv_id")))
        children = heads.groupBy((F.col("depth") - 1).alias("depth"), F.col("parent_conv_id").alias("conv_id")).agg(F.count(F.lit(1)).alias("n_children"), F.sum("alone").alias("n_alone"))
        known = shared.join(heads.where("alone = 0").drop("alone"), NODE).unionByName(top.withColumn("parent_conv_id", F.lit(None).cast("bigint")))
        known = written(known.join(children, NODE, "left").fillna(0, ["n_children", "n_alone"]))

        own = known.select(*NODE, (F.col("n_alone") + (F.col("n_children") == 0).cast("bigint")).alias("leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
        owners = known.select(F.col("conv_id").alias("member")).distinct()
        owned = shared_paths.select("member", *NODE).join(owners, "member", "left_semi")
        owned = written(owned.unionByName(owners.select("member", F.lit(0).cast("bigint").alias("depth"), F.lit(root).cast("bigint").alias("conv_id"))))
        totals = _totals(own, owned, levels)
        digests = _ends(shared_paths.where("depth = len").select(*NODE, "member").unionByName(at_top))
        several = known.join(totals, NODE).join(digests, NODE, "left")

        chain = turns.select("conv_id", "depth").join(lone, "conv_id").where("depth >= from")
        chain = chain.join(heads.where("alone = 1").select(*NODE, F.col("parent_conv_id").alias("_up")), NODE, "left")
        end = F.col("depth") == F.col("len")
        no_one = F.sha2(F.lit("").cast("binary"), 256)
        single = chain.select(
            *NODE, F.when(F.col("depth") == F.col("from"), F.col("_up")).otherwise(F.col("conv_id")).alias("parent_conv_id"), F.lit(1).cast("bigint").alias("n_convs"),
            F.when(end, 0).otherwise(1).cast("bigint").alias("n_children"), F.lit(1).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved_tokens"),
            F.when(end, F.sha2(F.col("conv_id").cast("string").cast("binary"), 256)).otherwise(no_one).alias("ends_sha256"),
        )
        several = several.select(*NODE, "parent_conv_id", "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends_sha256", no_one).alias("ends_sha256"))
        return kept(several.unionByName(single).select(*RESULT))


def conversation_trie(rows: DataFrame, group: int = 100, kinds: int = MOST_HEAD + 1) -> DataFrame:
    """The trie of the conversations (conv_id, turn, role, text), rebuilt with common beginnings (see rebuilt)."""
    with scratch_scope():
        turns = written(numbered(rows))
        sequences, lengths = rebuilt(turns, group, kinds)
        return kept(prefix_trie(sequences, lengths))


# --------------------------------------------------------------------- SQL
#: The same in SQL, with each prefix as the list of its turns. crc32 goes bit by bit, in the same way for every byte of an id.
ORACLE_SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, hex(encode(conv_id::VARCHAR)) AS h FROM conversations WHERE conv_id IS NOT NULL),
crc(conv_id, h, place, c, k) AS (
  SELECT conv_id, h, 1, xor(4294967295, ('0x' || substr(h, 1, 2))::BIGINT), 0 FROM ids
  UNION ALL
  SELECT conv_id, h, CASE WHEN k = 8 THEN place + 2 ELSE place END,
         CASE WHEN k = 8 THEN xor(c, ('0x' || substr(h, place + 2, 2))::BIGINT) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, CASE WHEN k = 8 THEN 0 ELSE k + 1 END
  FROM crc WHERE k < 8 OR place + 2 < length(h)
), heads AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, xor(c, 4294967295) % 6 AS h FROM crc WHERE k = 8 AND place + 2 > length(h)
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS pos, {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS t
  FROM conversations WHERE conv_id IS NOT NULL
), parts AS (
  SELECT h.conv_id, 0 AS part, pos, t FROM heads h JOIN turns ON turns.conv_id = base WHERE pos <= h
  UNION ALL SELECT h.conv_id, 1, pos, t FROM heads h JOIN turns USING (conv_id) WHERE pos > h
), whole AS (
  SELECT conv_id, coalesce(list(t ORDER BY part, pos) FILTER (WHERE t IS NOT NULL), []) AS seq FROM heads LEFT JOIN parts USING (conv_id) GROUP BY conv_id
), prefixes AS (
  SELECT conv_id, len(seq) AS n, d, seq[1:d] AS p FROM (SELECT conv_id, seq, unnest(range(len(seq) + 1)) AS d FROM whole)
), nodes AS (
  SELECT d, p, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM prefixes GROUP BY d, p
), linked AS (
  SELECT c.*, u.conv_id AS parent_conv_id FROM nodes c LEFT JOIN nodes u ON u.d = c.d - 1 AND u.p = c.p[1:c.d - 1]
), counted AS (
  SELECT l.*, (SELECT count(*) FROM linked k WHERE k.d = l.d + 1 AND k.parent_conv_id = l.conv_id) AS n_children FROM linked l
)
SELECT a.conv_id::BIGINT AS conv_id, a.d::BIGINT AS depth, a.parent_conv_id::BIGINT AS parent_conv_id, a.n_convs::BIGINT AS n_convs, a.n_children::BIGINT AS n_children,
       sum((b.n_children = 0)::INT)::BIGINT AS n_leaves, sum(CASE WHEN b.d = 0 THEN 0 ELSE (b.n_convs - 1) * length(b.p[b.d].text) END)::BIGINT AS saved_tokens, sha256(a.ends) AS ends_sha256
FROM counted a JOIN counted b ON b.d >= a.d AND b.p[1:a.d] = a.p
GROUP BY ALL
"""
