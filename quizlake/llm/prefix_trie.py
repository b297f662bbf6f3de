"""Trie of the prefixes that conversations share, screened by a count-min sketch.

1. A turn becomes two 64-bit hashes of its role and text. Turns are sorted by ranges of (conversation,
   turn); running sums of hash times B**position give every prefix of a conversation its digest, and
   the same sequence the same digest, wherever its turns come from. A conversation that lies in
   several ranges is put together from one row of totals per range.
2. All digests are counted in a count-min sketch of two rows. Only the bit "two or more" of a cell is
   sent to the tasks. A prefix with a cell below two belongs to one conversation: such nodes, the tails
   of conversations, are finished where they are.
3. The other prefixes, shared or taken for it, are shuffled and grouped exactly. Sums over subtrees are
   running sums from the end of each conversation: a node's own share is laid on the row of its
   smallest member, and what passes a row is added up over the members.

Defined results: rows without a conversation id are left out; null role or text counts as empty; turns
are ordered null first, and equal turns by role, then by text; equal rows are turns of their own; a conversation without turns after rebuilding is a member of the root alone; an empty table has
no node. Order and layout of the input do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.operators.joins import attach
from quizlake.session import materialise

#: Turns taken over from another conversation at most, and the group of ids that share one.
MOST_HEAD, FAMILY = 5, 100
#: Cells of a sketch row: eight per prefix, up to these (a bit each, two rows, 64 MB). Beyond, cells are
#: shared by more prefixes, of which more are grouped exactly.
MOST_CELLS = 2**28
_BLOCK = 2**16
#: Cells a task gathers before it sends them, and characters of an id list in one row.
_GATHER, _CHUNK = 2_000_000, 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_EMPTY = hashlib.sha256(b"").hexdigest()


def _powers(base: int, exponents: np.ndarray) -> np.ndarray:
    """base**exponent modulo 2**64 for every exponent."""
    out, square, left = np.ones(len(exponents), np.uint64), base, exponents.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * np.uint64(square), out)
        square, left = square * square % 2**64, left >> np.uint64(1)
    return out


def _local_sums(batches: Iterator[pa.RecordBatch], key: str, values: list[str], base: int) -> Iterator[pa.RecordBatch]:
    """Position and running sums of a sorted partition's rows within their key, as far as they lie here."""
    pid, last, seen = TaskContext.get().partitionId(), None, [0] * (1 + len(values))
    held = None

    def sent(batch: pa.RecordBatch, final: bool) -> pa.RecordBatch:
        mark = np.zeros(batch.num_rows, bool)
        mark[-1] = final
        return batch.append_column("final", pa.array(mark)).append_column("pid", pa.array(np.full(batch.num_rows, pid)))

    for batch in batches:
        if not batch.num_rows:
            continue
        if held is not None:
            yield sent(held, False)
        keys = batch.column(key).to_numpy()
        new = np.append(last is None or keys[0] != last, keys[1:] != keys[:-1])
        starts = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        # Group -1, if any, goes on with the last key of the batch before.
        first = np.where(group < 0, 0, starts[group] if len(starts) else 0)
        position = np.arange(batch.num_rows) - first + 1 + np.where(group < 0, seen[0], 0)
        held = batch.append_column("pos", pa.array(position))
        power = _powers(base, position) if base != 1 else np.ones(len(position), np.uint64)
        after = [int(position[-1])]
        for i, name in enumerate(values):
            term = batch.column(name).to_numpy().view(np.uint64) * power
            total = np.append(np.zeros(1, np.uint64), np.cumsum(term))
            before = np.where(group < 0, np.uint64(seen[1 + i]), np.uint64(0)) - total[first]
            held = held.append_column(f"to_{name}", pa.array((total[1:] + before).view(np.int64)))
            held = held.append_column(f"before_{name}", pa.array((total[:-1] + before).view(np.int64)))
            after.append(int((total[-1:] + before[-1:])[0]))
        last, seen = keys[-1], after
    if held is not None:
        yield sent(held, True)


def _whole_sums(batches: Iterator[pa.RecordBatch], key: str, values: list[str], base: int, offsets: dict) -> Iterator[pa.RecordBatch]:
    """The same over whole keys: each range's first key takes over what lies in the ranges before."""
    for batch in batches:
        pids, keys, position = (batch.column(n).to_numpy() for n in ("pid", key, "pos"))
        columns = {n: batch.column(n) for n in batch.schema.names if n not in ("pid", "final")}
        for pid in np.unique(pids).tolist():
            if pid not in offsets:
                continue
            owner, count, *sums = offsets[pid]
            mine = (pids == pid) & (keys == owner)
            scale = np.where(mine, np.uint64(pow(base, count, 2**64)), np.uint64(1))
            position = position + np.where(mine, count, 0)
            for name, total in zip(values, sums):
                for column in (f"to_{name}", f"before_{name}"):
                    here = np.asarray(columns[column]).view(np.uint64) * scale + np.where(mine, np.uint64(total), np.uint64(0))
                    columns[column] = pa.array(here.view(np.int64))
        columns["pos"] = pa.array(position)
        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))


def running_sums(rows: DataFrame, key: str, order: list, values: list[str], base: int = 1, name: str = "sums") -> DataFrame:
    """``rows`` with ``pos``, from 1 within their long ``key`` by ``order``, and for each long value
    column v the sums to_v and before_v of v * base**pos, modulo 2**64, with and without the row.

    Rows are sorted in ranges of (key, order), so no key fills one task. The driver sees one row per range.
    """
    dealt = rows.repartitionByRange(F.col(key), *order).sortWithinPartitions(F.col(key), *order)
    plain = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    sums = ", pos long" + "".join(f", to_{v} long, before_{v} long" for v in values)
    local = dealt.mapInArrow(lambda b: _local_sums(b, key, values, base), f"{plain}{sums}, final boolean, pid long")
    local = materialise(local, name)
    offsets, current = {}, None
    for row in sorted(local.where("final").select("pid", key, "pos", *[f"to_{v}" for v in values]).collect()):
        pid, owner, count, *totals = row
        totals = [t % 2**64 for t in totals]
        if current is not None and current[0] == owner:
            offsets[pid] = current
            scale = pow(base, current[1], 2**64)
            totals = [(old + scale * t) % 2**64 for old, t in zip(current[2:], totals)]
            count += current[1]
        elif current is not None:
            offsets[pid] = current
        current = (owner, count, *totals)
    return local.mapInArrow(lambda b: _whole_sums(b, key, values, base, offsets), f"{plain}{sums}")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the prefixes that end in a conversation's own turns, and of those one turn shorter."""
    for batch in batches:
        col = {n: batch.column(n).to_numpy() for n in batch.schema.names}
        shift = _powers(_INVERSE, col["h"] - col["m"])
        out = [batch.column("conv"), pa.array(col["m"] + col["pos"] - col["h"])]
        for end in ("to", "before"):
            for i in "12":
                own = col[f"{end}_t{i}"].view(np.uint64) - col[f"skip{i}"].view(np.uint64)
                out.append(pa.array((col[f"head{i}"].view(np.uint64) + shift * own).view(np.int64)))
        yield pa.RecordBatch.from_arrays([*out, batch.column("len"), batch.column("total")], _PREFIX)


_PREFIX = ["conv", "depth", "d1", "d2", "p1", "p2", "len", "total"]
_PREFIX_TYPE = ", ".join(f"{n} long" for n in _PREFIX)


def _cells(digest: np.ndarray, width: int) -> np.ndarray:
    mixed = digest.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    return ((mixed ^ (mixed >> np.uint64(32))) & np.uint64(width - 1)).astype(np.int64)


def _touched(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Per sketch row and block, the cells touched once here and those touched again."""
    held: list[list[np.ndarray]] = [[], []]
    size = 0

    def packed() -> pa.RecordBatch:
        rows = []
        for r in (0, 1):
            cells, counts = np.unique(np.concatenate(held[r]), return_counts=True)
            cuts = np.searchsorted(cells, np.arange(0, width + _BLOCK, _BLOCK))
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                part = slice(cuts[b], cuts[b + 1])
                place = (cells[part] % _BLOCK).astype(np.uint16)
                rows.append((r, b, place.tobytes(), place[counts[part] > 1].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.int32(), pa.binary(), pa.binary()])], ["r", "block", "once", "again"])

    for batch in batches:
        if batch.num_rows:
            for r in (0, 1):
                held[r].append(_cells(batch.column(r).to_numpy(), width))
            size += 2 * batch.num_rows
        if size > _GATHER:
            yield packed()
            held, size = [[], []], 0
    if size:
        yield packed()


def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of bits "two or more" from rows that are sorted by sketch row and block."""
    name, count = None, np.zeros(_BLOCK, np.uint8)

    def block() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([name[0]], pa.int32()), pa.array([name[1]], pa.int32()), pa.array([np.packbits(count > 1).tobytes()], pa.binary())], ["r", "block", "bits"]
        )

    for batch in batches:
        for r, b, once, again in zip(*(batch.column(n).to_pylist() for n in ("r", "block", "once", "again"))):
            if name != (r, b):
                if name is not None:
                    yield block()
                name, count = (r, b), np.zeros(_BLOCK, np.uint8)
            for part in (once, again):
                place = np.frombuffer(part, np.uint16)
                count[place] = np.minimum(count[place] + 1, 2)
    if name is not None:
        yield block()


def shared_bits(prefixes: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the columns (d1, d2), one row of cells each, as bits "two or more"."""
    touched = prefixes.select("d1", "d2").mapInArrow(lambda b: _touched(b, width), "r int, block int, once binary, again binary")
    merged = touched.repartition("r", "block").sortWithinPartitions("r", "block").mapInArrow(_bits, "r int, block int, bits binary")
    out = np.zeros((2, width // 8), np.uint8)
    for r, block, bits in merged.toLocalIterator():
        out[r, block * _BLOCK // 8 : (block + 1) * _BLOCK // 8] = np.frombuffer(bits, np.uint8)
    return out


def _screened(batches: Iterator[pa.RecordBatch], sketch, width: int) -> Iterator[pa.RecordBatch]:
    """Whether a prefix, and the one a turn shorter, may have a second member; the root is always taken to."""
    bits = sketch.value

    def several(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        found = np.ones(len(one), bool)
        for r, digest in enumerate((one, two)):
            cell = _cells(digest, width)
            found &= (bits[r][cell >> 3] >> (7 - (cell & 7)).astype(np.uint8)) & 1 > 0
        return found

    for batch in batches:
        col = {n: batch.column(n).to_numpy() for n in ("depth", "d1", "d2", "p1", "p2")}
        shared = several(col["d1"], col["d2"])
        parent = (col["depth"] == 1) | several(col["p1"], col["p2"])
        yield batch.append_column("shared", pa.array(shared)).append_column("parent_shared", pa.array(parent))


def rebuilt_prefixes(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefixes of all rebuilt conversations (without the empty one), and (conv, total) of each."""
    named = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")]
    )
    hashes = [F.xxhash64(F.lit(i), "role", "text").alias(f"t{i}") for i in (1, 2)] + [F.length("text").cast("long").alias("len")]
    hashed, order = named.select("conv", "turn", *hashes), [F.col("turn").asc_nulls_first()]
    # Texts are sorted along only where turns repeat.
    place = F.struct("conv", "turn").alias("place")
    tied = materialise(named.groupBy(place).agg(F.count("*").alias("c")).where("c > 1").select("place", F.lit(True).alias("tied")), "tied")
    if not tied.isEmpty():
        marked = attach(named.withColumn("place", place), tied, "place", "left")
        hashed = marked.select("conv", "turn", *hashes, *[F.when(F.col("tied"), F.col(c)).alias(c) for c in ("role", "text")])
        order += ["role", "text"]
    own = running_sums(hashed, "conv", order, ["t1", "t2"], _BASE, "turns").select("conv", "pos", "len", *[f"{e}_t{i}" for e in ("to", "before") for i in (1, 2)])
    first = F.collect_list(F.when(F.col("pos") <= MOST_HEAD, F.struct("pos", "to_t1", "to_t2", "len")))
    heads = materialise(own.groupBy("conv").agg(F.max("pos").alias("n"), F.sort_array(first).alias("head")), "heads")
    bases = heads.select(F.col("conv").alias("base"), F.col("head").alias("base_head"))
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % (MOST_HEAD + 1)
    info = heads.withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % FAMILY).join(bases, "base", "left")
    info = info.withColumn("m", F.least("h", F.coalesce(F.size("base_head"), F.lit(0))).cast("long"))
    info = info.withColumn("total", F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))

    def at(array: str, place: str, field: str):
        return F.coalesce(F.get(array, F.col(place).cast("int") - 1)[field], F.lit(0).cast("long"))

    info = materialise(
        info.select(
            "conv", "h", "m", "total", F.slice("base_head", 1, F.col("m").cast("int")).alias("taken"),
            *[at("base_head", "m", f"to_t{i}").alias(f"head{i}") for i in (1, 2)], *[at("head", "h", f"to_t{i}").alias(f"skip{i}") for i in (1, 2)],
        ),
        "conversations",
    )
    later = attach(own.where(F.col("pos") > h), info.drop("taken"), "conv")
    taken = info.select("conv", "total", "taken", F.posexplode("taken").alias("i", "x")).select(
        "conv", F.col("x.pos").alias("depth"), F.col("x.to_t1").alias("d1"), F.col("x.to_t2").alias("d2"),
        *[F.coalesce(F.get("taken", F.col("i") - 1)[f"to_t{i}"], F.lit(0).cast("long")).alias(f"p{i}") for i in (1, 2)], F.col("x.len").alias("len"), "total",
    )
    return materialise(later.mapInArrow(_digests, _PREFIX_TYPE).union(taken), "prefixes"), info.select("conv", "total")


def _id_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows (d1, d2, depth, conv) as lists of ids of one node, each of bounded length."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(n).to_numpy() for n in ("d1", "d2", "depth")]
        convs = batch.column("conv").to_pylist()
        new = np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys]))
        starts = np.flatnonzero(new)
        starts = np.unique(np.concatenate([starts, np.arange(0, len(convs), _CHUNK // 20)]))
        lists = [",".join(map(str, convs[a:b])) for a, b in zip(starts, np.append(starts[1:], len(convs)))]
        yield pa.RecordBatch.from_arrays([*[pa.array(k[starts]) for k in keys], pa.array([convs[a] for a in starts], pa.int64()), pa.array(lists)], ["d1", "d2", "depth", "least", "ids"])


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's whole id list, fed from its sorted parts."""
    name, digest = None, None

    def node() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*[pa.array([k], pa.int64()) for k in name], pa.array([digest.hexdigest()])], ["d1", "d2", "depth", "ends"])

    for batch in batches:
        for *key, ids in zip(*(batch.column(n).to_pylist() for n in ("d1", "d2", "depth", "ids"))):
            if key == name:
                digest.update(b",")
            else:
                if name is not None:
                    yield node()
                name, digest = key, hashlib.sha256()
            digest.update(ids.encode())
    if name is not None:
        yield node()


def prefix_trie(turns: DataFrame, most_cells: int = MOST_CELLS) -> DataFrame:
    """One row per node of the trie over (conv_id, turn, role, text): conv_id, depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = turns.sparkSession
    prefixes, conversations = rebuilt_prefixes(turns)
    width = _BLOCK
    while width < min(8 * prefixes.count(), most_cells):
        width *= 2
    sketch = spark.sparkContext.broadcast(shared_bits(prefixes, width))
    screened = materialise(prefixes.mapInArrow(lambda b: _screened(b, sketch, width), _PREFIX_TYPE + ", shared boolean, parent_shared boolean"), "screened")
    zero = F.lit(0).cast("long")
    root = conversations.select("conv", *[zero.alias(n) for n in _PREFIX[1:-1]], "total")
    members = screened.where("shared").select(*_PREFIX).union(root)

    # Exact groups; a tail that begins below a group is one child of it.
    key = ["d1", "d2", "depth"]
    ends = F.col("depth") == F.col("total")
    rows = members.withColumn("tail", zero).union(
        screened.where("not shared and parent_shared").select(
            F.lit(None).cast("long"), F.col("depth") - 1, "p1", "p2", *[F.lit(None).cast("long") for _ in range(4)], F.lit(1).cast("long")
        )
    )
    nodes = materialise(
        rows.groupBy(*key).agg(
            F.min("conv").alias("conv_id"), F.count("conv").alias("n_convs"), F.max("p1").alias("p1"), F.max("p2").alias("p2"), F.max("len").alias("len"),
            F.sum("tail").alias("tails"), F.count(F.when(ends, 1)).alias("n_ends"),
        ),
        "nodes",
    )
    below = nodes.where("depth > 0").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("groups"))
    nodes = nodes.join(below, key, "left").withColumn("n_children", F.col("tails") + F.coalesce("groups", zero))

    # Subtrees: shares of nodes and of ends of tails, summed from the end of each conversation.
    blank = [F.lit(None).cast("long").alias(n) for n in ("d1", "d2")]
    shares = nodes.select(
        F.col("conv_id").alias("conv"), "depth", *blank, F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("len")).alias("saved")
    ).where("leaf > 0 or saved > 0")
    tail_ends = screened.where(~F.col("shared") & ends).select("conv", "depth", *blank, F.lit(1).cast("long"), zero)
    passed = members.select("conv", "depth", "d1", "d2", zero.alias("leaf"), zero.alias("saved"))
    order = [F.col("depth").desc(), F.col("d1").asc_nulls_first()]
    summed = running_sums(passed.union(shares).union(tail_ends), "conv", order, ["leaf", "saved"], name="subtrees")
    totals = summed.where("d1 is not null").groupBy(*key).agg(F.sum("to_leaf").alias("n_leaves"), F.sum("to_saved").alias("saved_tokens"))

    # Ids of the conversations that end in a group, in order and in parts.
    ended = members.where(ends).select(*key, "conv").repartitionByRange(*key, "conv").sortWithinPartitions(*key, "conv")
    lists = ended.mapInArrow(_id_lists, "d1 long, d2 long, depth long, least long, ids string")
    lists = lists.repartition(*key).sortWithinPartitions(*key, "least").mapInArrow(_digested, "d1 long, d2 long, depth long, ends string")

    parent = F.struct(F.col("p1").alias("d1"), F.col("p2").alias("d2"), (F.col("depth") - 1).alias("depth")).alias("node")
    done = materialise(nodes.join(totals, key).join(lists, key, "left"), "exact")
    columns = ["conv_id", "depth", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    exact = done.withColumn("ends_sha256", F.coalesce("ends", F.lit(_EMPTY)))
    last = F.when(ends, 0).otherwise(1).cast("long")
    tails = screened.where("not shared").select(
        F.col("conv").alias("conv_id"), "depth", F.lit(1).cast("long").alias("n_convs"), last.alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.when(ends, F.sha2(F.col("conv").cast("string").cast("binary"), 256)).otherwise(F.lit(_EMPTY)).alias("ends_sha256"), "p1", "p2", "parent_shared",
    )
    asking = exact.where("depth > 0").select(*columns, parent).union(tails.where("parent_shared").select(*columns, parent))
    parents = done.where("n_children > 0").select(F.struct(*key).alias("node"), F.col("conv_id").alias("parent_conv_id"))
    # A group without its parent here stands below a tail: it has one member, and its parent the same.
    named = attach(asking, parents, "node", "left").select(*columns, F.coalesce("parent_conv_id", "conv_id").alias("parent_conv_id"))
    top = exact.where("depth = 0").select(*columns, F.lit(None).cast("long").alias("parent_conv_id"))
    inner = tails.where("not parent_shared").select(*columns, F.col("conv_id").alias("parent_conv_id"))
    return named.union(top).union(inner).select("conv_id", "depth", "parent_conv_id", *columns[2:])


#: The query over ``conversations`` in SQL. The checksum is worked out bit by bit.
ORACLE = """
    WITH t AS (
        SELECT conv_id, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS k, length(coalesce(text, '')) AS len,
            row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos
        FROM conversations WHERE conv_id IS NOT NULL
    ), c AS (
        SELECT conv_id, conv_id - conv_id % 100 AS base, xor(4294967295, list_reduce(
            list_concat([4294967295::BIGINT], list_transform(range(1, length(conv_id::VARCHAR) + 1), lambda i: ord(substr(conv_id::VARCHAR, i, 1))::BIGINT)),
            lambda a, b: list_reduce(list_concat([xor(a, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, 3988292384 * (x & 1)))
        )) % 6 AS h
        FROM (SELECT DISTINCT conv_id FROM t)
    ), head AS (
        SELECT c.conv_id, t.pos AS depth, t.k, t.len FROM c JOIN t ON t.conv_id = c.base AND t.pos <= c.h
    ), own AS (
        SELECT c.conv_id, coalesce(m.m, 0) + t.pos - c.h AS depth, t.k, t.len
        FROM c JOIN t ON t.conv_id = c.conv_id AND t.pos > c.h LEFT JOIN (SELECT conv_id, count(*) AS m FROM head GROUP BY 1) m ON m.conv_id = c.conv_id
    ), chained AS (
        SELECT conv_id, depth, len, md5(string_agg(k, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS d
        FROM (SELECT * FROM head UNION ALL SELECT * FROM own)
    ), prefixes AS (
        SELECT conv_id, depth, d, len, coalesce(lag(d) OVER (PARTITION BY conv_id ORDER BY depth), '') AS p FROM chained
        UNION ALL SELECT conv_id, 0, '', 0, NULL FROM c
    ), ended AS (
        SELECT d, depth, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) AS ids
        FROM (SELECT *, max(depth) OVER (PARTITION BY conv_id) AS total FROM prefixes) WHERE depth = total GROUP BY ALL
    ), nodes AS (
        SELECT d, depth, min(conv_id) AS conv_id, count(*) AS n_convs, min(p) AS p, max(len) AS len FROM prefixes GROUP BY ALL
    ), kids AS (
        SELECT p AS d, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL
    ), sums AS (
        SELECT r.d, r.depth, count(*) FILTER (k.d IS NULL) AS n_leaves, sum((u.n_convs - 1) * u.len) AS saved_tokens
        FROM nodes u JOIN prefixes r ON r.conv_id = u.conv_id AND r.depth <= u.depth LEFT JOIN kids k ON k.d = u.d AND k.depth = u.depth GROUP BY ALL
    )
    SELECT n.conv_id, n.depth::BIGINT AS depth, q.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
        s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
    FROM nodes n JOIN sums s ON s.d = n.d AND s.depth = n.depth LEFT JOIN nodes q ON q.d = n.p AND q.depth = n.depth - 1
    LEFT JOIN kids k ON k.d = n.d AND k.depth = n.depth LEFT JOIN ended e ON e.d = n.d AND e.depth = n.depth
"""
