"""Similarity join of documents on the Jaccard similarity of their word shingles.

1. Every text becomes the set of its shingles' hashes. Texts with equal sets form a class, of which
   one document stands for all.
2. A class can only have a partner if enough of its shingles occur in another class too. Half of all
   shingles, chosen by their hash, are counted for that; what a task can tell from its own documents
   is settled there, so a shingle of very many documents is sent once per task. All but a few classes
   end here.
3. Of the classes left, shingles are ordered from rare to frequent. Two similar classes share one of
   their rarest quarter, whatever the data (the prefix rule); classes are met there.
4. Blocks of classes that meet are searched by T-occurrence: a query's inverted lists are divided,
   the short ones merged by a heap and the long ones probed by binary search for the documents found
   (DivideSkip), until the overlap that the threshold asks for is reached or out of reach.

Groups beyond a block are split. First every class is searched in one block only, with a class that
all blocks of its group share; this already links nearly all of a group of near copies. Then a class
visits every block that holds a class of another component with which it shares a rare shingle. No
pair that could link is left out, and none that is linked by others already is searched again.

Defined results: null, empty and blank texts have no shingles and link with nothing; a text of fewer
words than a shingle is one shingle; rows that repeat a key share its component, and each is
returned; a row without a key is returned with its shingle count and no component; order and layout of the input do
not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quizlake.llm.components import connected_components
from quizlake.llm.shingles import mix, sets
from quizlake.llm.tables import small_batches
from quizlake.session import materialise

#: Bytes of text that are hashed at once, and texts' bytes gathered before their shingles are sent.
SLICE, GATHER = 500_000, 4_000_000
#: Classes in a block of the search.
BLOCK = 64
#: Classes left (32 bytes each) up to which they are sent to the texts; beyond, both are shuffled.
BROADCAST = 500_000
#: Rows handed to Python at once: texts, or sets of as many shingles as a text has words.
BATCH = 250
_SAMPLED = np.uint64(2**63)


def slices(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most SLICE bytes of text each, a longer text alone."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    total, start = 0, 0
    for i, size in enumerate(sizes.tolist()):
        if i > start and total + size > SLICE:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def _prints(tokens: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each row's set: equal for equal sets, and for no others in practice."""
    out = []
    for salt in (0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(tokens ^ np.uint64(salt)))])
        out.append((sums[bounds[1:]] - sums[bounds[:-1]]).view(np.int64))
    return out[0], out[1]


def _describe(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Per document: size of its set, prints, and how many of its shingles are counted in step 2."""
    for batch in batches:
        for part in slices(batch, "text_"):
            tokens, bounds = sets(part.column("text_"), k)
            one, two = _prints(tokens, bounds)
            counted = np.concatenate([[0], np.cumsum(mix(tokens) < _SAMPLED)])
            counted = counted[bounds[1:]] - counted[bounds[:-1]]
            yield pa.RecordBatch.from_arrays(
                [part.column("key_"), pa.array(np.diff(bounds)), pa.array(one), pa.array(two), pa.array(counted.astype(np.int64))],
                ["key_", "n", "one", "two", "counted"],
            )


def _occurrences(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counted shingles as packed columns per bucket; shingles that repeat here are settled here.

    Beside its bucket a shingle is sent as half of its hash: two that agree there can only let classes
    through that the search then parts.

    A row with a negative bucket carries, for classes in ``prints``, how many shingles others here share.
    """
    held: list[tuple[np.ndarray, np.ndarray]] = []
    size, seen = 0, set()

    def packed() -> Iterator[pa.RecordBatch]:
        tokens = np.concatenate([t for t, _ in held])
        owners = np.concatenate([o for _, o in held])
        if not len(tokens):
            return
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        first = np.append(True, tokens[1:] != tokens[:-1])
        alone = first & np.append(first[1:], True)
        classes, shared = np.unique(owners[~alone], return_counts=True)
        settled = -1 - int(tokens[0] % np.uint64(buckets))  # any partition will do
        rows = [(settled, classes.tobytes(), shared.astype(np.uint32).tobytes(), b"")]
        # What occurs once goes with its class, what repeats goes once with class 0.
        owners = np.where(alone, owners, 0)[first]
        tokens = tokens[first]
        names, places = np.unique(owners, return_inverse=True)
        wide = np.uint16 if len(names) < 2**16 else np.uint32
        places = places.astype(wide)
        bucket = (tokens % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            mine = order[cuts[b] : cuts[b + 1]]
            if len(mine):
                used, local = np.unique(places[mine], return_inverse=True)
                rows.append((b, names[used].tobytes(), (tokens[mine] >> np.uint64(32)).astype(np.uint32).tobytes(), local.astype(wide).tobytes()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary(), pa.binary()])],
            ["bucket", "prints", "tokens", "places"],
        )

    for batch in batches:
        for part in slices(batch, "text_"):
            tokens, bounds = sets(part.column("text_"), k)
            one, _ = _prints(tokens, bounds)
            fresh = np.array([p not in seen and not seen.add(p) for p in one.tolist()], bool)
            owners = np.repeat(one, np.diff(bounds))
            keep = np.repeat(fresh, np.diff(bounds)) & (mix(tokens) < _SAMPLED)
            held.append((tokens[keep], owners[keep]))
            size += tokens.nbytes
            if size > GATHER:
                yield from packed()
                held, size = [], 0
                seen.clear()
    if held:
        yield from packed()


def _shared(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """How many of this partition's shingles each class shares with another, packed per bucket of classes."""
    tokens, owners, settled, counts = [], [], [], []
    for batch in batches:
        for bucket, prints, a, b in zip(*(batch.column(n).to_pylist() for n in ("bucket", "prints", "tokens", "places"))):
            prints = np.frombuffer(prints, np.int64)
            if bucket < 0:
                settled.append(prints)
                counts.append(np.frombuffer(a, np.uint32).astype(np.int64))
                continue
            a = np.frombuffer(a, np.uint32)
            tokens.append(a)
            owners.append(prints[np.frombuffer(b, np.uint16 if len(b) == 2 * len(a) else np.uint32)])
    if tokens:
        tokens, owners = np.concatenate(tokens), np.concatenate(owners)
        order = np.lexsort((owners, tokens))
        tokens, owners = tokens[order], owners[order]
        new = np.ones(len(tokens), bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
        tokens, owners = tokens[new], owners[new]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        many = np.diff(np.append(starts, len(tokens))) > 1
        # Class 0 stands for at least two classes of some task.
        many |= np.maximum.reduceat(owners == 0, starts)
        owners = owners[np.repeat(many, np.diff(np.append(starts, len(tokens))))]
        settled.append(owners)
        counts.append(np.ones(len(owners), np.int64))
    if settled:
        names, places = np.unique(np.concatenate(settled), return_inverse=True)
        total = np.bincount(places, np.concatenate(counts)).astype(np.int64)
        bucket = names.view(np.uint64) % np.uint64(buckets)
        if not len(names):
            return
        rows = [(int(b), names[bucket == b].tobytes(), total[bucket == b].tobytes()) for b in np.unique(bucket)]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int32(), pa.binary(), pa.binary()])], ["classes", "prints", "hits"]
        )


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sum of its packed counts for every class."""
    found = [(np.frombuffer(p, np.int64), np.frombuffer(h, np.int64)) for b in batches for p, h in zip(b.column("prints").to_pylist(), b.column("hits").to_pylist())]
    if found:
        names, places = np.unique(np.concatenate([p for p, _ in found]), return_inverse=True)
        total = np.bincount(places, np.concatenate([h for _, h in found])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(total)], ["one", "hits"])


def _token_rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The sorted sets of the classes left, each from the text of its document."""
    for batch in batches:
        for part in slices(batch, "text_"):
            tokens, bounds = sets(part.column("text_"), k)
            one, two = _prints(tokens, bounds)
            right = (one == part.column("one").to_numpy()) & (two == part.column("two").to_numpy())
            flat = tokens.view(np.int64)
            rows = np.flatnonzero(right)
            yield pa.RecordBatch.from_arrays(
                [part.column("key_").take(pa.array(rows)), pa.array(one[rows]), pa.array(np.diff(bounds)[rows]), pa.array([flat[bounds[i] : bounds[i + 1]] for i in rows], pa.list_(pa.int64()))],
                ["rep", "one", "n", "tokens"],
            )


class Links:
    """Union-find over the classes of a block."""

    def __init__(self, labels: list[int]):
        first: dict[int, int] = {}
        self.parent = [first.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        self.parent[self.find(i)] = self.find(j)


class InvertedLists:
    """Inverted lists over the sets of a block."""

    def __init__(self, held: list[np.ndarray]):
        self.sizes = [len(s) for s in held]
        tokens = np.concatenate(held)
        owners = np.repeat(np.arange(len(held)), self.sizes)
        order = np.lexsort((owners, tokens))
        tokens, self.owners = tokens[order], owners[order]
        starts = np.flatnonzero(np.append(True, tokens[1:] != tokens[:-1]))
        self.keys, self.bounds = tokens[starts], np.append(starts, len(tokens))
        # One ascending array of (list, member), so that one call probes many lists.
        self.entries = np.repeat(np.arange(len(starts)), np.diff(self.bounds)) * len(held) + self.owners

    def search(self, query: np.ndarray, percent: int, wanted) -> Iterator[int]:
        """Members that ``wanted`` admits and whose similarity reaches the threshold."""
        n = len(query)
        least = -(-percent * n // 100)
        at = np.minimum(np.searchsorted(self.keys, query), len(self.keys) - 1)
        lists = at[self.keys[at] == query]
        if len(lists) < least or not least:
            return
        lengths = self.bounds[lists + 1] - self.bounds[lists]
        order = np.argsort(-lengths, kind="stable")
        longest = int(lengths[order[0]])
        aside = min(least - 1, int(least / (0.01 * np.log2(max(longest, 2)) + 1)))
        long, short = lists[order[:aside]], lists[order[aside:]]
        merged = heapq.merge(*(self.owners[self.bounds[x] : self.bounds[x + 1]].tolist() for x in short))
        for member, run in groupby(merged):
            count = sum(1 for _ in run)
            if count < least - aside or not wanted(member):
                continue
            needed = -(-percent * (n + self.sizes[member]) // (100 + percent))
            if count + aside < needed:
                continue
            probes = long * len(self.sizes) + member
            found = np.minimum(np.searchsorted(self.entries, probes), len(self.entries) - 1)
            if count + int((self.entries[found] == probes).sum()) >= needed:
                yield member


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys, for input that is sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        columns = [batch.column(k).to_pylist() for k in keys]
        start = 0
        rows = list(zip(*columns))
        for i in range(len(rows) + 1):
            if i == len(rows) or rows[i] != last:
                if i > start:
                    held.append(batch.slice(start, i - start))
                if i == len(rows):
                    break
                if held:
                    yield pa.Table.from_batches(held)
                held, start, last = [], i, rows[i]
    if held:
        yield pa.Table.from_batches(held)


def number_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The rows of a list column without nulls as arrays."""
    out = []
    for part in column.chunks:
        values = part.flatten().to_numpy(zero_copy_only=False)
        bounds = np.append(0, np.cumsum(pc.list_value_length(part).to_numpy(zero_copy_only=False)))
        out += [values[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def _search_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Links found in each block, at most one for each class and component it meets."""
    for group in _groups(batches, ["route", "chunk", "part"]):
        found = search_block(
            group.column("rep").to_pylist(),
            number_lists(group.column("tokens")),
            group.column("label").to_pylist(),
            group.column("visitor").to_pylist(),
            percent,
        )
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])


def search_block(reps: list[int], held: list[np.ndarray], labels: list[int], visitor: list[bool], percent: int) -> list[tuple[int, int]]:
    """Links of a block's members among themselves, or of its visitors with its members."""
    members = [i for i, v in enumerate(visitor) if not v]
    queries = [i for i, v in enumerate(visitor) if v] or members
    if not members or len(held) < 2:
        return []
    index, links, found = InvertedLists([held[i] for i in members]), Links(labels), []
    for q in queries:
        mine = reps[q]
        for m in index.search(held[q], percent, lambda m: reps[members[m]] != mine and links.find(members[m]) != links.find(q)):
            links.join(members[m], q)
            found.append((mine, reps[members[m]]))
    return found


def _blocks(placed: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Search blocks of rows (route, chunk, part, rep, label, visitor)."""
    rows = placed.join(held.select(F.col("rep").alias("rep_"), "tokens"), F.col("rep") == F.col("rep_")).drop("rep_")
    keys = ["route", "chunk", "part"]
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, "visitor", "rep")
    return dealt.mapInArrow(lambda b: _search_blocks(b, percent), "a long, b long")


def _links(held: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect all similar classes among (rep, one, n, tokens). Classes whose key is
    the same, from rows that repeat a key with other texts, go as two members of one name."""
    # Shingles that one class alone holds say how many of its rarest cannot be met.
    spread = held.select("one", F.explode("tokens").alias("token"))
    counts = spread.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    common = spread.join(counts, "token")
    ranked = common.groupBy("one").agg(F.sort_array(F.collect_list(F.struct("df", "token"))).alias("common"), F.sum("df").alias("known"))
    ranked = held.select("rep", "one", "n").join(ranked, "one")
    # Prefix: of n shingles from rare to frequent, all but the last ceil(threshold n) and one more.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100.0) + 1 - (F.col("n") - F.size("common"))
    rare = ranked.select(
        "rep", "n", (F.col("known") / F.col("n")).alias("weight"), (F.col("n") - F.size("common")).alias("own"),
        F.posexplode(F.slice("common", 1, F.greatest(prefix, F.lit(0)).cast("int"))).alias("pos", "x"),
    )
    # A pair meets first at its rarest common shingle, and all its other common ones come later: from
    # there, a class can reach the threshold only with partners of at most this size.
    reach = F.floor((F.col("n") - F.col("own") - F.col("pos")) * (100 + percent) / percent) - F.col("n")
    rare = rare.select("rep", "n", "weight", F.col("x.token").alias("token"), reach.alias("reach"))
    met = materialise(rare, "prefixes")
    # The pivot is the class whose shingles are the most common ones: what edited copies come from.
    groups = met.groupBy("token").agg(F.count("*").alias("m"), F.max_by("rep", F.struct("weight", "rep")).alias("pivot")).where("m > 1")
    rows = met.join(groups, "token")
    # Every class goes to the group of its most frequent rare shingle.
    route = rows.groupBy("rep").agg(F.max_by(F.struct("token", "m", "pivot"), F.struct("m", "token")).alias("r"))
    chunks = F.ceil(F.col("r.m") / BLOCK)
    home = materialise(
        route.select("rep", F.col("r.token").alias("route"), F.col("r.pivot").alias("pivot"), F.pmod(F.xxhash64("rep"), chunks).alias("chunk"), (F.col("r.m") > BLOCK).alias("large")),
        "blocks",
    )
    pivots = home.where("large").select("route", "chunk", F.col("pivot").alias("rep")).distinct()
    first = home.select("route", "chunk", "rep").union(pivots).distinct()
    one = materialise(
        _blocks(first.select("route", "chunk", F.lit(0).cast("long").alias("part"), "rep", F.col("rep").alias("label"), F.lit(False).alias("visitor")), held, percent),
        "links",
    )
    labels = connected_components(one).select(F.col("node").alias("rep"), "component")
    placed = materialise(
        home.select("rep", "route", "chunk").join(labels, "rep", "left").withColumn("component", F.coalesce("component", "rep")), "placed"
    )
    # Shingles whose classes are of several components still: these may hide a link.
    seats = met.join(placed, "rep").select("token", "rep", "n", "reach", "route", "chunk", "component")
    per = seats.groupBy("token", "component").agg(F.count("*").alias("c"))
    split = per.groupBy("token").agg(F.count("*").alias("components"), F.max_by("component", "c").alias("major")).where("components > 1")
    here = materialise(seats.join(split.select("token", "major"), "token"), "split")
    visitors = here.where("component != major").select("token", F.col("rep").alias("guest"), F.col("component").alias("own"), "n", "reach")
    # A block counts once for a shingle, whatever the number of components it holds.
    blocks = here.groupBy("token", "route", "chunk").agg(
        F.min("component").alias("low"), F.max("component").alias("high"), F.min("n").alias("shortest"), F.max("n").alias("longest"), F.max("reach").alias("farthest")
    )
    other = (F.col("own") != F.col("low")) | (F.col("own") != F.col("high"))
    sized = (F.col("shortest") <= F.col("reach")) & (F.col("n") <= F.col("farthest")) & (F.col("longest") * 100 >= F.col("n") * percent)
    visits = visitors.join(blocks, "token").where(other & sized).select("guest", "own", "route", "chunk").distinct()
    visits = materialise(visits, "visits")
    parts = visits.groupBy("route", "chunk").agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    guests = visits.join(parts, ["route", "chunk"]).select(
        "route", "chunk", F.pmod(F.xxhash64("guest"), F.col("parts")).alias("part"), F.col("guest").alias("rep"), F.col("own").alias("label"), F.lit(True).alias("visitor")
    )
    hosts = placed.join(parts, ["route", "chunk"]).select(
        "route", "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "rep", F.col("component").alias("label"), F.lit(False).alias("visitor")
    )
    return one.union(_blocks(guests.union(hosts), held, percent))


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = 5, percent: int = 75) -> DataFrame:
    """Per row of ``docs``: key, n_shingles, component_id (least key reachable by links) and class_id
    (least key with the same set of shingles)."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must lie between 50 and 100")
    # Texts and sets reach Python within this call: what it returns is a join of written tables.
    with small_batches(docs.sparkSession, BATCH):
        return _components(docs, key, text, words, percent)


def _components(docs: DataFrame, key: str, text: str, words: int, percent: int) -> DataFrame:
    spark = docs.sparkSession
    source = docs.select(F.col(key).cast("long").alias("key_"), F.col(text).alias("text_"))
    described = materialise(source.mapInArrow(lambda b: _describe(b, words), "key_ long, n long, one long, two long, counted long"), "sets")
    keyed = described.where("key_ is not null and n > 0")
    classes = keyed.groupBy("one", "two").agg(F.min("key_").alias("rep"), F.first("n").alias("n"), F.first("counted").alias("counted"))
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packed = source.where("key_ is not null").mapInArrow(lambda b: _occurrences(b, words, buckets), "bucket int, prints binary, tokens binary, places binary")
    shared = packed.repartition("bucket").mapInArrow(lambda b: _shared(b, buckets), "classes int, prints binary, hits binary")
    hits = shared.repartition("classes").mapInArrow(_summed, "one long, hits long")
    # Of n shingles at most n - ceil(threshold n) may be missing from a partner.
    may_miss = F.col("n") - F.ceil(F.col("n") * percent / 100.0)
    # A set can only be similar to another if one shingle more or less leaves it so.
    left = classes.where(F.col("n") * 100 >= (F.col("n") + 1) * percent).join(hits, "one", "left").where(F.coalesce("hits", F.lit(0)) >= F.col("counted") - may_miss)
    left = materialise(left.select("rep", "one", "two"), "left")
    texts = source.join(F.broadcast(left) if left.count() <= BROADCAST else left, F.col("key_") == F.col("rep")).select("key_", "text_", "one", "two")
    held = texts.mapInArrow(lambda b: _token_rows(b, words), "rep long, one long, n long, tokens array<long>").dropDuplicates(["rep", "one"])
    held = materialise(held, "held")
    links = materialise(_links(held, percent), "links")
    # Rows that repeat a key tie their classes together.
    doubled = keyed.groupBy("key_").agg(F.min(F.struct("one", "two")).alias("x"), F.max(F.struct("one", "two")).alias("y"), F.count("*").alias("c")).where("c > 1 and x != y")
    ties = doubled.select("key_").join(keyed, "key_").join(classes.select("one", "two", "rep"), ["one", "two"])
    ties = ties.select(F.col("key_").alias("a"), F.col("rep").alias("b")).where("a != b")
    labels = connected_components(links.union(ties)).select(F.col("node").alias("rep"), "component")
    named = classes.select("one", "two", "rep").join(labels, "rep", "left").select("one", "two", F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("component_id"))
    out = described.join(named, ["one", "two"], "left")
    alone = F.col("key_").isNull() | (F.col("n") == 0)
    return out.select(
        F.col("key_").alias(key),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("key_")).otherwise(F.col("component_id")).alias("component_id"),
        F.when(alone, F.col("key_")).otherwise(F.col("class_id")).alias("class_id"),
    )


#: The query over ``documents`` in SQL: shingle sets, their self-join, and labels by reach.
ORACLE = r"""
    WITH RECURSIVE d AS (
        SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
        FROM documents
    ), s AS (
        SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
            ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g
        FROM d
    ), sets AS (
        SELECT doc_id, count(*) AS n, md5(string_agg(md5(g), '' ORDER BY md5(g))) AS print FROM s GROUP BY doc_id
    ), links AS (
        SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL) p
        JOIN sets m ON m.doc_id = p.a JOIN sets n ON n.doc_id = p.b WHERE 100 * p.c >= 75 * (m.n + n.n - p.c)
    ), near AS (
        SELECT a, b FROM links UNION ALL SELECT b, a FROM links
    ), reach AS (
        SELECT doc_id AS node, doc_id AS root FROM d UNION SELECT near.b, reach.root FROM reach JOIN near ON near.a = reach.node
    )
    SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, least_reached AS component_id, CASE WHEN sets.n IS NULL THEN d.doc_id ELSE min(d.doc_id) OVER (PARTITION BY sets.print) END AS class_id
    FROM d JOIN (SELECT node, min(root) AS least_reached FROM reach GROUP BY node) r ON r.node = d.doc_id LEFT JOIN sets ON sets.doc_id = d.doc_id
"""
