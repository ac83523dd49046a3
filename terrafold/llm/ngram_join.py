"""N-gram Jaccard join: T-occurrence search by DivideSkip over sharded inverted lists.

A document is the set of its distinct word k-grams. Two documents link when their sets' Jaccard similarity reaches the threshold.

1. Classes: documents with equal sets are one class (64-bit digest and size); the smallest id stands for it.
2. Prefixes: with any global order of the shingles, linked sets share l of them among their first ``n - ceil(t*n) + l``. The
   order is rarity in a sketch of counters over all documents (fixed size, so it may go to every task), then the hash. Only
   prefix postings are shuffled, as blocks of packed records, one block per task and target. A class that meets others in
   fewer than l of its prefix's lists links with nothing (l grows with the set: a shared passage is no near copy). Only partners
   whose size allows a link count, and they are told apart by 64 bits: l lists with different partners are no near copy either.
3. Shards: classes that meet in lists are gathered by the smallest class they meet (their home); a home of many shingles is
   salted into chunks, and a chunk never outgrows a task.
4. Search: the sets of a group are indexed one after another. A set asks for the earlier ones that share T of its shingles: the L
   longest lists are put aside, the short ones are merged (by a heap, or many postings by runs), and what the merge counts at least T - L times is looked up in
   the long lists by binary search. Sets that are already connected with the asking set are left out of the lists, so a
   group of thousands of near copies costs about one check a set.
5. Two rounds. The first searches every chunk by itself, together with one pivot of its home, which connects the chunks of a group of
   near copies. The second searches pairs of chunks, but only for classes in lists that still hold different components (each
   posting is sent to its list once, with its component and chunk); a
   component that fills chunks is there by itself and is never compared with itself. So a large group is not paired with itself.
6. Components of all links found, over the whole table.

Memory of a task is bounded by two chunks. Nothing that grows with the corpus is collected or broadcast.
"""

from __future__ import annotations

import heapq
import math
from array import array
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .shared import (SKETCH, arrow_batches, components, id_bitmap, id_value, partitions, perhaps, sketch_rows, sketch_slot,
                     sketch_sum, stored)

K = 5
THRESHOLD = 0.8
#: Shingles of a chunk; two chunks are in a task at once (8 bytes a shingle, and their lists).
CHUNK = 400_000


def least_overlap(n: int, threshold: float) -> int:
    """Smallest overlap that a set of n can have with a linked set (1e-9: 0.8 * 5 is 4, not 4.000000001)."""
    return max(1, math.ceil(threshold * n - 1e-9))


def wanted_meetings(n):
    """l for a set of n: prefixes of both sets hold at least the smaller l of the two in common."""
    return 1 + n // 20


def reaches(overlap: int, n: int, m: int, percent: int) -> bool:
    return 100 * overlap >= percent * (n + m - overlap)


def document_sets(ids: pa.Array, texts: pa.Array, k: int):
    """Per slice of a batch: ids, sorted distinct shingles, their bounds and the sets' digests."""
    value = id_value(ids)
    for a, b, data, bounds in W.slices(texts):
        found = W.words(data, bounds)
        shingle, unit, _ = W.unit_shingles(found, b - a, k)
        members, cut = W.unit_sets(shingle, unit, b - a)
        yield value[a:b], members, cut, W.set_digest(members, cut)


def classes(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n_shingles, digest), and as rows with a part the counters of the sketch of all shingles."""
    def read(batches):
        counts = np.zeros(SKETCH, np.uint64)
        for batch in batches:
            for ids, members, cut, digest in document_sets(batch.column(0), batch.column(1), k):
                counts += np.bincount(sketch_slot(members), minlength=SKETCH).astype(np.uint64)
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(ids), "n_shingles": pa.array(np.diff(cut).astype(np.int64)),
                    "digest": pa.array(digest.view(np.int64)), "part": pa.nulls(len(ids), pa.int32()),
                    "counts": pa.nulls(len(ids), pa.binary())})
        rows = sketch_rows(counts)
        none = pa.nulls(rows.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, *rows.columns], ["doc_id", "n_shingles", "digest", "part", "counts"])

    return docs.mapInArrow(read, "doc_id long, n_shingles long, digest long, part int, counts binary")


#: ``key`` has the lower half of a shingle; its upper half deals it to a target. Lists that share a key only loosen the filters.
POSTING = np.dtype([("key", "<u4"), ("digest", "<i8"), ("n", "<i4")])


def prefix_blocks(docs: DataFrame, k: int, threshold: float, rarity, targets: int) -> DataFrame:
    """(target, block): POSTING records of the prefixes of all classes, packed per target and task."""
    def read(batches):
        order = rarity.value
        seen: set[int] = set()
        for batch in batches:
            for _, members, cut, digest in document_sets(batch.column(0), batch.column(1), k):
                sizes = np.diff(cut)
                fresh = np.zeros(len(digest), bool)
                for i, d in enumerate(digest.tolist()):
                    if sizes[i] and d not in seen:
                        seen.add(d)
                        fresh[i] = True
                unit = np.repeat(np.arange(len(sizes)), sizes)
                pick = W.by_rarity(order[sketch_slot(members)], unit, len(sizes))
                place = np.arange(len(members)) - cut[unit]
                length = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + wanted_meetings(sizes)
                keep = (place < length[unit]) & fresh[unit]
                unit = unit[keep]
                posting = np.empty(len(unit), POSTING)
                token = members[pick][keep]
                posting["key"], posting["digest"], posting["n"] = token & np.uint64(0xFFFFFFFF), digest[unit].view(np.int64), sizes[unit]
                yield from blocks(posting, token, targets)

    return docs.mapInArrow(read, "target int, block binary")


def blocks(records: np.ndarray, key: np.ndarray, targets: int):
    """Records packed by target, a hash range of the key."""
    target = ((key >> np.uint64(32)) * np.uint64(targets) >> np.uint64(32)).astype(np.int32)
    order = np.argsort(target, kind="stable")
    records, target = records[order], target[order]
    edge = np.flatnonzero(np.diff(target, prepend=-1)) if len(target) else []
    if len(edge):
        yield pa.RecordBatch.from_pydict({
            "target": pa.array(target[edge], pa.int32()),
            "block": pa.array([x.tobytes() for x in np.split(records, edge[1:])], pa.binary())})


def unpacked(batches, kind: np.dtype) -> np.ndarray:
    """All records of a target partition: its share of the hash range."""
    found = [np.frombuffer(x, kind) for batch in batches for x in batch.column(1).to_pylist()]
    return np.concatenate(found) if found else np.zeros(0, kind)


def columns(batches) -> list[np.ndarray]:
    """The columns of a task's rows, of which no value is null; nothing if it has no row."""
    batches = [batch for batch in batches if batch.num_rows]
    return [c.to_numpy() for c in pa.Table.from_batches(batches).columns] if batches else []


def over_windows(of, value: np.ndarray, a: np.ndarray, b: np.ndarray, empty) -> np.ndarray:
    """``of`` (a ufunc like minimum or bitwise_or) over ``value[a:b]`` for each window, by runs of doubling length."""
    out = np.full(len(a), empty, value.dtype)
    length, run, step = b - a, value, 1
    while step <= length.max(initial=0):
        at = np.flatnonzero((length >= step) & (length < 2 * step))
        out[at] = of(run[a[at]], run[b[at] - step])
        run, step = of(run[:-step], run[step:]), 2 * step
    return out


def lists(blocks_of: DataFrame, threshold: float, targets: int) -> DataFrame:
    """(list, digest, n, leader, wide, partners): the postings of classes that meet another one of a fitting size in the list.

    A list is cut where neighbouring sizes do not fit; it is ``wide`` if its smallest and largest do not. The leader is the smallest
    of a class and those it meets, ``partners`` has the bits of these (digest mod 64).
    """
    def read(batches):
        rows = unpacked(batches, POSTING)
        key = np.sort(rows["key"])
        shared = key[1:][key[1:] == key[:-1]]
        at = np.minimum(np.searchsorted(shared, rows["key"]), max(len(shared) - 1, 0))
        rows = rows[shared[at] == rows["key"]] if len(shared) else rows[:0]
        rows = rows[np.lexsort((rows["digest"], rows["n"], rows["key"]))]
        again = (rows["key"][1:] == rows["key"][:-1]) & (rows["digest"][1:] == rows["digest"][:-1])
        rows = rows[np.concatenate((np.ones(min(1, len(rows)), bool), ~again))]
        if not len(rows):
            return
        key, digest, n, me = rows["key"].astype(np.int64), np.ascontiguousarray(rows["digest"]), rows["n"].astype(np.int64), np.arange(len(rows))
        smallest = np.ceil(threshold * n - 1e-9).astype(np.int64)
        listed = np.cumsum(np.concatenate(([0], (key[1:] != key[:-1]) | (n[:-1] < smallest[1:])))) << 32
        first = np.searchsorted(listed | n, listed | smallest)
        end = np.searchsorted(listed | n, listed | np.floor(n / threshold + 1e-9).astype(np.int64), "right")
        bit, none = np.uint64(1) << (digest.view(np.uint64) & np.uint64(63)), np.uint64(0)
        partners = over_windows(np.bitwise_or, bit, first, me, none) | over_windows(np.bitwise_or, bit, me + 1, end, none)
        leader = over_windows(np.minimum, digest, first, end, 0)
        begin, last = np.searchsorted(listed, listed), np.searchsorted(listed, listed, "right") - 1
        name = W.mix((listed >> 32 | TaskContext.get().partitionId() << 40).view(np.uint64)).view(np.int64)
        keep = last > begin
        yield pa.RecordBatch.from_pydict({
            "list": pa.array(name[keep]), "digest": pa.array(digest[keep]), "n": pa.array(n[keep]), "leader": pa.array(leader[keep]),
            "wide": pa.array((n[begin] < smallest[last])[keep]), "partners": pa.array(partners[keep].view(np.int64))})

    return (blocks_of.repartition(targets, "target")
            .mapInArrow(read, "list long, digest long, n long, leader long, wide boolean, partners long"))


def meeting_often(met: DataFrame, threshold: float, targets: int) -> DataFrame:
    """(list, digest, n, leader, wide): the postings by which a class meets others often enough.

    The smallest partner of a set of n has ceil(t*n) members, so a linked one stands in l of that many of its lists. Partners are
    counted by their 64 bits: a bit that is set in fewer lists belongs to no linked class, and a posting without another bit goes.
    """
    def read(batches):
        found = columns(batches)
        if not found:
            return
        order = np.argsort(found[1], kind="stable")
        listed, digest, n, leader, wide, partners = (x[order] for x in found)
        partners = partners.view(np.uint64)
        new = np.concatenate(([True], digest[1:] != digest[:-1]))
        edge, unit = np.flatnonzero(new), np.cumsum(new) - 1
        need = wanted_meetings(np.ceil(threshold * n[edge] - 1e-9).astype(np.int64))
        often = np.zeros(len(edge), np.uint64)
        for bit in range(64):
            times = np.add.reduceat((partners >> np.uint64(bit) & np.uint64(1)).astype(np.int64), edge)
            often |= (times >= need).astype(np.uint64) << np.uint64(bit)
        keep = partners & often[unit] > 0
        yield pa.RecordBatch.from_pydict({"list": pa.array(listed[keep]), "digest": pa.array(digest[keep]), "n": pa.array(n[keep]),
                                          "leader": pa.array(leader[keep]), "wide": pa.array(wide[keep])})

    return met.repartition(targets, "digest").mapInArrow(read, "list long, digest long, n long, leader long, wide boolean")


def class_homes(met: DataFrame) -> DataFrame:
    """(digest, n, home)."""
    return met.groupBy("digest").agg(F.first("n").alias("n"), F.min("leader").alias("home"))


def chunked(classes_of: DataFrame, key: str, chunk: int) -> DataFrame:
    """``classes_of`` with ``shard``: the chunk of its key that a class belongs to, cut by hash, and ``parts`` of the key."""
    weight = classes_of.groupBy(key).agg(F.ceil(F.sum("n") / F.lit(chunk)).alias("parts"))
    return (classes_of.join(weight, key)
            .withColumn("shard", F.xxhash64(key, F.pmod(F.xxhash64("digest"), F.col("parts")))))


def first_groups(homes: DataFrame, chunk: int) -> DataFrame:
    """(group, digest): every class in its chunk, and a pivot, the smallest class of a home, in all chunks of it."""
    placed = chunked(homes, "home", chunk)
    pivots = (placed.where("parts > 1").groupBy("home").agg(F.min("digest").alias("digest"), F.collect_set("shard").alias("shards"))
              .select(F.explode("shards").alias("group"), "digest"))
    return placed.select(F.col("shard").alias("group"), "digest").union(pivots)


#: Visits of a class to a chunk that are made at once in a task.
VISITS = 1 << 18


def visits(here: DataFrame, targets: int) -> DataFrame:
    """(group, digest, known) of (list, digest, known, large, shard): in lists with several components, every class with every chunk of its list.

    Classes of one ``large`` component do not meet each other.
    """
    def read(batches):
        found = columns(batches)
        if not found:
            return
        listed, _, known, large, shard = found
        order = np.lexsort((np.where(large, known, 0), large, shard, listed))
        listed, digest, known, large, shard = (x[order] for x in found)
        edge = np.flatnonzero(np.concatenate(([True], listed[1:] != listed[:-1])))
        mixed = np.repeat(np.minimum.reduceat(known, edge) != np.maximum.reduceat(known, edge), np.diff(np.append(edge, len(listed))))
        listed, digest, known, large, shard = (x[mixed] for x in (listed, digest, known, large, shard))
        component = np.where(large, known, 0)
        same = np.ones(max(0, len(listed) - 1), bool)
        for x in (listed, shard, large, component):
            same &= x[1:] == x[:-1]
        chunks = np.flatnonzero(np.concatenate((np.ones(min(1, len(listed)), bool), ~same)))
        first, end = np.searchsorted(listed[chunks], listed), np.searchsorted(listed[chunks], listed, "right")
        total = np.concatenate(([0], np.cumsum(end - first)))
        a = 0
        while a < len(listed):
            b = max(a + 1, int(np.searchsorted(total, total[a] + VISITS, "right")) - 1)
            me = np.repeat(np.arange(a, b), (end - first)[a:b])
            other = chunks[first[me] + total[a] + np.arange(len(me)) - total[me]]
            apart = ((shard[other] != shard[me]) | ~large[me]) & ~(large[other] & large[me] & (known[other] == known[me]))
            me, other = me[apart], other[apart]
            low, high = np.minimum(shard[me], shard[other]).view(np.uint64), np.maximum(shard[me], shard[other]).view(np.uint64)
            group = W.mix(W.mix(low) + high).view(np.int64)
            order = np.lexsort((digest[me], group))
            me, group = me[order], group[order]
            new = np.ones(len(me), bool)
            new[1:] = (group[1:] != group[:-1]) | (digest[me][1:] != digest[me][:-1])
            yield pa.RecordBatch.from_pydict({"group": pa.array(group[new]), "digest": pa.array(digest[me][new]), "known": pa.array(known[me][new])})
            a = b

    return here.repartition(targets, "list").mapInArrow(read, "group long, digest long, known long").distinct()


def second_groups(met: DataFrame, homes: DataFrame, components_of: DataFrame, chunk: int, threshold: float, targets: int) -> DataFrame:
    """(group, digest, known): pairs of chunks of classes that meet in a list but are not connected yet."""
    known = (homes.join(components_of.select(F.col("node").alias("digest"), "component"), "digest", "left")
             .withColumn("known", F.coalesce("component", "digest")).select("digest", "n", "home", "known"))
    large = known.groupBy("known").agg((F.sum("n") > chunk).alias("large"))
    placed = known.join(large, "known").withColumn("base", F.when(F.col("large"), F.col("known")).otherwise(F.col("home")))
    placed = chunked(placed, "base", chunk).select("digest", "known", "large", "shard")
    # Linked sizes differ by the threshold at most, so they fall into one or two neighbouring classes of size; a wide list is cut into these.
    size = F.floor(F.log(F.col("n").cast("double")) / F.lit(-math.log(threshold)) + F.lit(1e-9)).cast("int")
    cut = F.when(F.col("wide"), F.array(F.xxhash64("list", size), F.xxhash64("list", size + 1))).otherwise(F.array("list"))
    here = met.select(F.explode(cut).alias("list"), "digest").join(placed, "digest")
    return visits(here.select("list", "digest", "known", "large", "shard"), targets)


#: Postings up to which a heap merges the short lists; more are merged by one sort of their concatenation.
HEAP_POSTINGS = 256


def merged(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """Ids of sorted lists with their numbers of occurrences."""
    if sum(map(len, lists)) <= HEAP_POSTINGS:
        found = [(doc, sum(1 for _ in run)) for doc, run in groupby(heapq.merge(*lists))]
        return np.array([d for d, _ in found], np.int64), np.array([c for _, c in found], np.int64)
    return np.unique(np.concatenate([np.asarray(x, np.int64) for x in lists]), return_counts=True)


def divide_skip(lists: list, need: int, wanted=None) -> dict[int, int]:
    """Ids found in at least ``need`` of the sorted lists, with their counts; ``wanted`` maps ids to whether they matter."""
    lists = sorted((x for x in lists if len(x)), key=len)
    if len(lists) < need:
        return {}
    longest = len(lists[-1])
    aside = min(need - 1, int(need / (0.01 * math.log2(longest + 1) + 1))) if need > 1 else 0
    aside = max(0, min(aside, len(lists) - 1))
    doc, count = merged(lists[:len(lists) - aside])
    keep = count + aside >= need
    if wanted is not None:
        keep &= wanted(doc)
    doc, count = doc[keep], count[keep]
    for left, x in zip(range(aside - 1, -1, -1), lists[len(lists) - aside:]):
        if not len(doc):
            return {}
        x = np.asarray(x, np.int64)
        count = count + (x[np.minimum(np.searchsorted(x, doc), len(x) - 1)] == doc)
        keep = count + left >= need
        doc, count = doc[keep], count[keep]
    return dict(zip(doc.tolist(), count.tolist()))


class Shards:
    """Inverted lists of the sets of one group, searched and extended set by set."""

    def __init__(self, threshold: float):
        self.threshold, self.percent = threshold, round(100 * threshold)
        self.sets: list[np.ndarray] = []
        self.lists: dict[int, array] = {}
        self.label = np.zeros(1024, np.int64)  # component of each set: its first member
        self.known: dict[int, int] = {}

    def linked(self, a: np.ndarray, b: int) -> bool:
        other = self.sets[b]
        n, m = len(a), len(other)
        if 100 * min(n, m) < self.percent * max(n, m):
            return False
        return reaches(len(np.intersect1d(a, other, assume_unique=True)), n, m, self.percent)

    def join(self, me: int, other: int) -> None:
        x, y = sorted((int(self.label[me]), int(self.label[other])))
        label = self.label[:me + 1]
        label[label == y] = x

    def add(self, members: np.ndarray, known: int | None = None) -> list[int]:
        """Index a set; give the earlier sets by which it joins their components (one for each component).

        Sets of the same ``known`` component are connected from the start.
        """
        me = len(self.sets)
        if me == len(self.label):
            self.label = np.concatenate((self.label, np.zeros(me, np.int64)))
        self.label[me] = me
        if known is not None:
            if known in self.known:
                self.join(me, self.known[known])
            self.known.setdefault(known, me)
        keys = members.tolist()
        lists = [self.lists[x] for x in keys if x in self.lists]
        need = least_overlap(len(members), self.threshold)
        links: list[int] = []
        if len(lists) >= need:
            if self.label[me] == me:  # most sets of a group of near copies link with one of the first or last
                rare = min(lists, key=len)
                for x in sorted({rare[0], rare[len(rare) // 2], rare[-1], lists[0][0], lists[0][-1]}):
                    if self.label[x] != self.label[me] and self.linked(members, x):
                        links.append(x)
                        self.join(me, x)
            found = divide_skip(lists, need, lambda doc: self.label[doc] != self.label[me])
            for x, overlap in found.items():
                if self.label[x] != self.label[me] and reaches(overlap, len(members), len(self.sets[x]), self.percent):
                    links.append(x)
                    self.join(me, x)
        self.sets.append(members)
        for x in keys:
            if x in self.lists:
                self.lists[x].append(me)
            else:
                self.lists[x] = array("q", (me,))
        return links


def search(routed: DataFrame, threshold: float, targets: int) -> DataFrame:
    """(a, b) of classes: links that connect what is linked within each group of (group, digest, known, members) rows."""
    def read(batches):
        group, shards, names, out = None, None, [], []
        for batch in batches:
            for g, digest, known, blob in zip(*(c.to_pylist() for c in batch.columns)):
                if g != group:
                    group, shards, names = g, Shards(threshold), []
                elif digest == names[-1]:
                    continue
                links = shards.add(np.frombuffer(blob, "<u8"), known)
                out += [(digest, names[x]) for x in links]
                names.append(digest)
            if out:
                yield pa.RecordBatch.from_pydict({"a": pa.array([x[0] for x in out], pa.int64()),
                                                  "b": pa.array([x[1] for x in out], pa.int64())})
                out = []

    return (routed.select("group", "digest", "known", "members").repartition(targets, "group").sortWithinPartitions("group", "digest")
            .mapInArrow(read, "a long, b long"))


def sets_to_search(docs: DataFrame, heads: DataFrame, homes: DataFrame, k: int) -> DataFrame:
    """(digest, members): shingles of one document of each class in ``homes``."""
    spark = docs.sparkSession
    wanted = stored(heads.join(homes.select("digest"), "digest").select("head", F.col("digest").alias("wanted")))
    bits = spark.sparkContext.broadcast(id_bitmap(wanted.select("head")))  # spares most texts the shuffle

    def to_sets(batches):
        for batch in batches:
            asked, row = batch.column(2).to_pylist(), 0
            for _, members, cut, own in document_sets(batch.column(0), batch.column(1), k):
                own = own.view(np.int64).tolist()  # rows of one id may differ: only the class that is asked for
                out = [(own[i], members[cut[i]:cut[i + 1]].tobytes()) for i in range(len(own)) if asked[row + i] == own[i]]
                row += len(own)
                yield pa.RecordBatch.from_pydict({"digest": pa.array([x[0] for x in out], pa.int64()),
                                                  "members": pa.array([x[1] for x in out], pa.binary())})

    keyed = docs.withColumn("key", F.coalesce("doc_id", F.lit(int(np.iinfo(np.int64).max))))  # as in the heads
    once = keyed.where(perhaps("key", bits)).join(wanted.hint("merge"), F.col("key") == wanted["head"]).select("doc_id", "text", "wanted")
    return stored(once.mapInArrow(to_sets, "digest long, members binary"))


def linked_components(docs: DataFrame, text: str = "text", ids: str = "doc_id", k: int = K, threshold: float = THRESHOLD,
                      chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row.

    Null text or text without a word: no shingles, linked with nothing (component: its own id). A null id counts as the
    largest integer. Repeated rows are copies and give a row each. An empty table gives no row. Other columns are not read.
    """
    spark = docs.sparkSession
    arrow_batches(spark)
    targets = 2 * partitions(spark)
    docs = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = stored(classes(docs, k))
    rarity = spark.sparkContext.broadcast(sketch_sum(read.where("part is not null").select("part", "counts")))
    sets = read.where("part is null").select("doc_id", "n_shingles", "digest")
    postings = prefix_blocks(docs, k, threshold, rarity, targets)
    met = stored(meeting_often(lists(postings, threshold, targets), threshold, targets))
    homes = stored(class_homes(met))
    heads = sets.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("head"))
    members = sets_to_search(docs, heads, homes, k)
    none = F.lit(None).cast("long").alias("known")
    edges = stored(search(first_groups(homes, chunk).select("group", "digest", none).join(members, "digest"), threshold, targets))
    again = second_groups(met, homes, components(edges), chunk, threshold, targets)
    edges = edges.union(search(again.join(members, "digest"), threshold, targets))
    named = (edges.join(heads.select(F.col("digest").alias("a"), F.col("head").alias("u")), "a")
             .join(heads.select(F.col("digest").alias("b"), F.col("head").alias("v")), "b").select("u", "v"))
    reached = components(named, "u", "v")
    by_class = (heads.join(reached, heads["head"] == reached["node"], "left")
                .select("digest", F.coalesce("component", "head").alias("component")))
    return (sets.join(by_class, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")))
