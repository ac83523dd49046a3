"""Line dedup: exact set-similarity join of all lines, then removal of later matches.

A line (a text split at line feeds) is the set of its distinct words (PLAIN, A-Z lowered). Lines are ordered by document id,
then position. A line goes if an earlier line of the corpus, removed or not, has a Jaccard similarity of at least the
threshold. Lines of fewer than ``min_words`` words stay; with ``EVERY_LINE`` only lines without a word do.

1. One scan gives each line's set digest and place, and the counters of a token sketch (fixed size). Equal sets are one class.
2. Tokens are ordered by rarity in the sketch, then by hash: any order that is the same everywhere keeps the join
   exact. Each class sends its prefix of ``n - ceil(t*n) + 1`` tokens, as packed records; a set so small that only an equal
   one is similar enough (at 0.8: fewer than four words) sends none. In a token's list, pairs pass the
   length filter, the positional filter, and a bound from 128-bit parity signatures (sets that differ in d tokens
   differ in at most d bits). A task keeps a class's earliest candidates, up to ``SURE`` whose signatures are far within
   that bound and, where they would outnumber its postings, ``KEPT`` in all, so output is linear in the postings; where a
   class had more, the last one kept says so.
3. One scan cuts the lines of these pairs, and no others, into token sets, and Jaccard is verified: the earliest candidate
   first, the others if it fails. Classes of which no kept candidate holds though there were more are joined again, and
   checked against all their candidates.
4. A class's cutoff is the earliest match or its own first line; every later line of the class goes.

Rows of one id are told apart by their texts, and lines at one place of them by nothing, so neither of two equal ones goes for the other;
rows equal in both are treated alike. A null id comes last. A null text stays null with no line; an
empty text is one line that stays. An empty table gives no row. Other columns pass through unread.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .ngram_join import blocks, unpacked
from .quality_rules import value_of
from .shared import (SKETCH, arrow_batches, bitmap, id_bitmap, id_hash, id_value, in_bitmap, partitions, perhaps, sketch_rows, sketch_slot,
                     sketch_sum, stored)

THRESHOLD = 0.8
MIN_WORDS = 1
#: ``min_words`` with which every line that has a word takes part.
EVERY_LINE = 1
#: Pairs compared at once in a task.
PAIRS = 1 << 18
#: Tokens counted at once for the sketch.
COUNTED = 1 << 21
#: Candidates of a class that a task keeps: in all, if all of them would outnumber its postings, and of those that all but surely hold.
KEPT = 64
SURE = 2
#: Larger sets are one length in the order of a list.
LONG_SET = (1 << 12) - 1

POSTING = np.dtype([("key", "<u4"), ("n", "<i4"), ("digest", "<i8"), ("low", "<u8"), ("high", "<u8"), ("doc", "<i8"), ("line", "<i4"),
                    ("place", "<u2")])
CANDIDATE = np.dtype([("x", "<i8"), ("y", "<i8"), ("doc", "<i8"), ("line", "<i4"), ("x_doc", "<i8"), ("x_line", "<i4"), ("sure", "?"), ("cut", "?")])


def sure_bits(tokens: int, bits: int = 128) -> np.ndarray:
    """For each number of tokens up to ``tokens`` in which two sets may differ: how many differing signature bits leave six
    standard deviations to the sets that differ in one token more. Negative where no number does."""
    d = np.arange(1, tokens + 2)
    one, two = (1 - 2 / bits) ** d, (1 - 4 / bits) ** d
    odd = (1 - one) / 2
    variance = bits * odd * (1 - odd) + bits * (bits - 1) * ((1 - 2 * one + two) / 4 - odd ** 2)
    return np.floor(bits * odd - 6 * np.sqrt(np.maximum(variance, 0))).astype(np.int64)


SURE_BITS = sure_bits(1 << 10)

def place_hash(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return W.mix(id_hash(doc) + line.astype(np.uint64))


def place_bitmap(places: DataFrame) -> np.ndarray:
    """Bitmap of the places of lines, one (doc, line) after the other in a row's columns."""
    def hashed(batches):
        for batch in batches:
            at = [c.to_numpy() for c in batch.columns]
            value = np.unique(np.concatenate([place_hash(doc, line) for doc, line in zip(at[::2], at[1::2])]))
            yield pa.RecordBatch.from_pydict({"h": pa.array(value.view(np.int64))})

    return bitmap(places.mapInArrow(hashed, "h long"))


def digest_bitmap(digests: DataFrame) -> np.ndarray:
    """Bitmap of the digests in all columns."""
    def each(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"h": pa.array(np.unique(np.concatenate([c.to_numpy() for c in batch.columns])))})

    return bitmap(digests.mapInArrow(each, "h long"))


def line_sets(ids: pa.Array, texts: pa.Array, min_words: int, values: np.ndarray | None = None, places: np.ndarray | None = None):
    """Per slice: document ids (or other ``values`` of the rows), line numbers, token sets, bounds, digests of the lines that take part.

    With ``places``, a bitmap, only lines at these places are read.
    """
    value = id_value(ids) if values is None else values
    for a, b, data, bounds in W.slices(texts):
        edges, unit, number = W.line_bounds(data, bounds)
        if places is not None:
            asked = in_bitmap(places, place_hash(value[a:b][unit], number))
            size = np.diff(edges)
            data = data[np.repeat(asked, size)]
            edges, unit, number = np.concatenate(([0], np.cumsum(size[asked]))), unit[asked], number[asked]
        found = W.words(data, edges)
        count = np.bincount(found.unit, minlength=len(unit))
        keep = count >= min_words
        token = keep[found.unit]
        new = np.cumsum(keep) - 1
        members, cut = W.unit_sets(found.hash[token], new[found.unit[token]], int(keep.sum()))
        yield value[a:b][unit[keep]], number[keep], members, cut, W.set_digest(members, cut)


def occurrences(docs: DataFrame, min_words: int) -> DataFrame:
    """(digest, doc, text, line) of every line that takes part, and rows with a part: the token sketch. ``text`` is the hash of the
    row's text, which tells rows of one id apart."""
    def read(batches):
        counts, slots, waiting = np.zeros(SKETCH, np.uint64), [], 0

        def count():
            counts[:] += np.bincount(np.concatenate(slots), minlength=SKETCH).astype(np.uint64)
            slots.clear()

        for batch in batches:
            ids, hashes = id_value(batch.column(0)), batch.column(2).to_numpy(zero_copy_only=False)
            for row, line, members, _, digest in line_sets(batch.column(0), batch.column(1), min_words, np.arange(batch.num_rows)):
                slots.append(sketch_slot(members))
                waiting += len(members)
                if waiting >= COUNTED:
                    count()
                    waiting = 0
                yield pa.RecordBatch.from_pydict({
                    "digest": pa.array(digest.view(np.int64)), "doc": pa.array(ids[row]), "text": pa.array(hashes[row]),
                    "line": pa.array(line.astype(np.int32)), "part": pa.nulls(len(row), pa.int32()), "counts": pa.nulls(len(row), pa.binary())})
        if slots:
            count()
        rows = sketch_rows(counts)
        none = pa.nulls(rows.num_rows, pa.int64())
        yield pa.RecordBatch.from_arrays([none, none, none, none.cast(pa.int32()), *rows.columns], ["digest", "doc", "text", "line", "part", "counts"])

    return (docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
            .mapInArrow(read, "digest long, doc long, text long, line int, part int, counts binary"))


def may_link(sizes: np.ndarray, threshold: float) -> np.ndarray:
    """Which sizes allow a match with another set: the closest one has one member more, so n of n + 1 are shared."""
    return sizes >= threshold * (sizes + 1) - 1e-9


def prefixes(members: np.ndarray, cut: np.ndarray, rarity: np.ndarray, threshold: float):
    """(index of the set, place, token) of the prefix tokens, rarest first."""
    sizes = np.diff(cut)
    unit = np.repeat(np.arange(len(sizes)), sizes)
    order = W.by_rarity(rarity[sketch_slot(members)], unit, len(sizes))
    place = np.arange(len(members)) - cut[unit]
    length = np.where(may_link(sizes, threshold), sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1, 0)
    keep = place < length[unit]
    return unit[keep], place[keep], members[order][keep]


def signatures(members: np.ndarray, cut: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parity of each of 128 hash classes of a set's tokens, in two numbers."""
    one = np.uint64(1) << (members >> np.uint64(58))
    upper = (members >> np.uint64(57) & np.uint64(1)).astype(bool)
    return tuple(np.bitwise_xor.reduceat(np.where(upper == side, one, np.uint64(0)), cut[:-1]) for side in (False, True))


def posting_blocks(docs: DataFrame, min_words: int, threshold: float, rarity, targets: int, keys=None) -> DataFrame:
    """(target, block): prefix postings of the classes, each class once a task (its first line there).

    With ``keys``, a broadcast bitmap of tokens, only postings of these tokens.
    """
    def read(batches):
        seen: dict[int, tuple[int, int]] = {}
        for batch in batches:
            for doc, line, members, cut, digest in line_sets(batch.column(0), batch.column(1), min_words):
                if not len(digest):
                    continue
                fresh = np.zeros(len(digest), bool)
                able = np.flatnonzero(may_link(np.diff(cut), threshold))
                for i, d, at in zip(able.tolist(), digest[able].tolist(), zip(doc[able].tolist(), line[able].tolist())):
                    if d not in seen or at < seen[d]:
                        seen[d] = at
                        fresh[i] = True
                low, high = signatures(members, cut)
                unit, place, token = prefixes(members, cut, rarity.value, threshold)
                keep = fresh[unit] if keys is None else fresh[unit] & in_bitmap(keys.value, token)
                unit, place, token = unit[keep], place[keep], token[keep]
                out = np.empty(len(unit), POSTING)
                out["key"], out["place"] = token & np.uint64(0xFFFFFFFF), np.minimum(place, 0xFFFF)  # an earlier place only loosens the filter
                out["digest"], out["low"], out["high"] = digest[unit].view(np.int64), low[unit], high[unit]
                out["n"] = np.diff(cut)[unit]
                out["doc"], out["line"] = doc[unit], line[unit]
                yield from blocks(out, token, targets)

    return docs.mapInArrow(read, "target int, block binary")


def least_overlap(total: np.ndarray, threshold: float) -> np.ndarray:
    """Smallest overlap of two sets of ``total`` members together that link."""
    return np.ceil(threshold / (1 + threshold) * total - 1e-9).astype(np.int64)


def in_lists(rows: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Postings in order of (token, size), a class once a token at its first place, and what ``pairs`` takes: the positions of those that
    a set of their size or more can meet, and for each posting the first of them in reach of its length and how many there are.

    A pair of sets meets in a token that lies in the prefix of the smaller one for the overlap of two sets of its size.
    """
    listed = ((rows["key"].astype(np.uint64) << np.uint64(32)) | (np.minimum(rows["n"], LONG_SET).astype(np.uint64) << np.uint64(20))
              | (rows["digest"].view(np.uint64) >> np.uint64(44)))
    order = np.argsort(listed)
    rows, listed = rows[order], listed[order]
    again = np.zeros(len(rows), bool)
    again[1:] = (listed[1:] == listed[:-1]) & (rows["digest"][1:] == rows["digest"][:-1])
    if again.any():  # two classes that share the bits of ``listed`` may hide a copy, which ``matches`` then skips
        run = np.cumsum(~again)
        copies = np.flatnonzero(again | np.append(again[1:], False))
        copies = copies[np.lexsort((rows["line"][copies], rows["doc"][copies], run[copies]))]
        keep = np.append(~again[:-1] & ~again[1:], ~again[-1:])
        keep[copies[np.flatnonzero(np.diff(run[copies], prepend=0))]] = True
        rows, listed = rows[keep], listed[keep]
    listed >>= np.uint64(20)
    size = rows["n"].astype(np.int64)
    met = (rows["place"] <= size - least_overlap(2 * size, threshold)) | (size >= LONG_SET)
    before = np.cumsum(met) - met
    token = listed >> np.uint64(12) << np.uint64(12)
    shortest = np.minimum(np.ceil(threshold * size - 1e-9), LONG_SET).astype(np.uint64)
    first = np.append(before, met.sum())[np.searchsorted(listed, token | shortest)]
    return rows, np.flatnonzero(met), first, before - first


def matches(rows: np.ndarray, met: np.ndarray, first: np.ndarray, number: np.ndarray, threshold: float):
    """(later, earlier, sure) of the pairs of classes that pass the length, positional and signature filters, in portions of positions."""
    size, low, high = rows["n"].astype(np.int64), rows["low"].copy(), rows["high"].copy()
    left = size - rows["place"]
    for early, j in pairs(first, number):
        i = met[early]
        total = size[i] + size[j]
        need = least_overlap(total, threshold)
        near = np.flatnonzero(np.minimum(left[i], left[j]) >= need)
        i, j, most = i[near], j[near], total[near] - 2 * need[near]
        differ = np.bitwise_count(low[i] ^ low[j]).astype(np.int64) + np.bitwise_count(high[i] ^ high[j])
        ok = (differ <= most) & (rows["digest"][i] != rows["digest"][j])
        i, j, differ, most = i[ok], j[ok], differ[ok], most[ok]
        doc, line = rows["doc"], rows["line"]
        swap = (doc[i] > doc[j]) | ((doc[i] == doc[j]) & (line[i] > line[j]))
        sure = (most < len(SURE_BITS)) & (differ <= SURE_BITS[np.minimum(most, len(SURE_BITS) - 1)])
        yield np.where(swap, i, j), np.where(swap, j, i), sure


def pairs(first: np.ndarray, number: np.ndarray):
    """(earlier position, position) of all pairs within lists, in portions; only these arrays are held, nothing is emitted."""
    a = 0
    total = np.concatenate(([0], np.cumsum(number)))
    while a < len(number):
        b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
        late = np.repeat(np.arange(a, b), number[a:b])
        yield np.repeat(first[a:b] - (total[a:b] - total[a]), number[a:b]) + np.arange(len(late)), late
        a = b


def first_candidates(found: np.ndarray, most: int) -> np.ndarray:
    """Each class's earliest candidates, up to ``SURE`` sure ones and ``most`` in all. ``cut`` marks the last one kept if there were more."""
    found = found[np.lexsort((~found["cut"], found["y"], found["line"], found["doc"], found["x"]))]
    same = np.zeros(len(found), bool)
    same[1:] = np.logical_and.reduce([found[c][1:] == found[c][:-1] for c in ("x", "doc", "line", "y")])
    found = found[~same]
    begins = np.diff(found["x"], prepend=0) != 0
    begins[:1] = True
    start = np.flatnonzero(begins)
    length = np.diff(np.append(start, len(found)))

    def within(x: np.ndarray) -> np.ndarray:
        run = np.cumsum(x) - x
        return run - np.repeat(run[start], length)

    sure = found["sure"].astype(np.int64)
    full = (within(sure) + sure >= SURE) | (within(np.ones(len(found), np.int64)) >= most - 1) | found["cut"]
    keep = within(full.astype(np.int64)) == 0
    last = np.append(begins[1:], True)
    found["cut"] |= full & ~last
    return found[keep]


def earliest(blocks_of: DataFrame, threshold: float, targets: int) -> DataFrame:
    """(x, y, doc, line, x_doc, x_line, cut): for each class x with candidates in a task, its earliest ones y there, both places, and
    whether there were more after this one."""
    names = ["x", "y", "doc", "line", "x_doc", "x_line", "cut"]

    def read(batches):
        rows, *lists = in_lists(unpacked(batches, POSTING), threshold)
        kept, waiting, most = [], 0, max(1, len(rows))
        for late, early, sure in matches(rows, *lists, threshold):
            found = np.zeros(len(late), CANDIDATE)
            x, y = rows[late], rows[early]
            found["x"], found["x_doc"], found["x_line"] = x["digest"], x["doc"], x["line"]
            found["y"], found["doc"], found["line"] = y["digest"], y["doc"], y["line"]
            found["sure"] = sure
            kept.append(first_candidates(found, most))
            waiting += len(kept[-1])
            if waiting > PAIRS:
                kept = [first_candidates(np.concatenate(kept), most)]
                if len(kept[0]) > len(rows):
                    most = KEPT
                    kept = [first_candidates(kept[0], most)]
                waiting = 0
        out = first_candidates(np.concatenate(kept), most) if kept else np.zeros(0, CANDIDATE)
        if len(out) > len(rows):
            out = first_candidates(out, KEPT)
        if len(out):
            yield pa.RecordBatch.from_pydict({c: pa.array(out[c].copy()) for c in names})

    return blocks_of.repartition(targets, "target").mapInArrow(
        read, "x long, y long, doc long, line int, x_doc long, x_line int, cut boolean")


def token_sets(docs: DataFrame, min_words: int, wanted, places=None) -> DataFrame:
    """(digest, members): token sets of the lines whose digest is in a bitmap, once a task; with ``places`` only lines there are read."""
    def read(batches):
        seen: set[int] = set()
        for batch in batches:
            for _, _, members, cut, digest in line_sets(batch.column(0), batch.column(1), min_words, places=places and places.value):
                out = []
                for i in np.flatnonzero(in_bitmap(wanted.value, digest)).tolist():
                    d = int(digest[i].view(np.int64))
                    if d not in seen:
                        seen.add(d)
                        out.append((d, members[cut[i]:cut[i + 1]].tobytes()))
                if out:
                    yield pa.RecordBatch.from_pydict({"digest": pa.array([x[0] for x in out], pa.int64()),
                                                      "members": pa.array([x[1] for x in out], pa.binary())})

    return docs.mapInArrow(read, "digest long, members binary").groupBy("digest").agg(F.min("members").alias("members"))


def jaccard_holds(a: bytes, b: bytes, percent: int) -> bool:
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    overlap = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * overlap >= percent * (len(x) + len(y) - overlap)


def compared(both: DataFrame, percent: int) -> DataFrame:
    """Pairs (x, y, doc, line) of the sets a and b with ``holds``, from the exact sets; a stays as ``members``."""
    def read(batches):
        for batch in batches:
            a, b = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            holds = [jaccard_holds(x, y, percent) for x, y in zip(a, b)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(holds, pa.bool_())], ["x", "y", "doc", "line", "members", "holds"])

    return both.select("x", "y", "doc", "line", "a", "b").mapInArrow(
        read, "x long, y long, doc long, line int, members binary, holds boolean")


def verified(found: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs with ``holds``, from the exact sets of both sides."""
    return compared(found.join(sets.select(F.col("digest").alias("x"), F.col("members").alias("a")), "x")
                    .join(sets.select(F.col("digest").alias("y"), F.col("members").alias("b")), "y"), percent)


def candidates(blocks_of: DataFrame, threshold: float, targets: int, asked) -> DataFrame:
    """(x, y, doc, line): every earlier candidate of the classes in the bitmap ``asked``."""
    def read(batches):
        rows, *lists = in_lists(unpacked(batches, POSTING), threshold)
        open_ = in_bitmap(asked.value, rows["digest"].view(np.uint64))
        for late, early, _ in matches(rows, *lists, threshold):
            keep = open_[late]
            x, y = rows[late[keep]], rows[early[keep]]
            if len(x):
                yield pa.RecordBatch.from_pydict({"x": pa.array(x["digest"]), "y": pa.array(y["digest"]),
                                                  "doc": pa.array(y["doc"]), "line": pa.array(y["line"])})

    found = blocks_of.repartition(targets, "target").mapInArrow(read, "x long, y long, doc long, line int")
    return found.groupBy("x", "y").agg(F.min(F.struct("doc", "line")).alias("at")).select("x", "y", "at.doc", "at.line")


def searched(docs: DataFrame, open_sets: DataFrame, min_words: int, threshold: float, rarity, targets: int) -> DataFrame:
    """(x, doc, line): matches of the classes in ``open_sets`` (digest, members), each checked against every candidate.

    Only postings of these classes' prefix tokens are sent, and only sets of candidates are fetched.
    """
    def tokens(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                members = np.frombuffer(blob, "<u8")
                _, _, token = prefixes(members, np.array([0, len(members)]), rarity.value, threshold)
                yield pa.RecordBatch.from_pydict({"digest": pa.array(token.view(np.int64))})

    context = docs.sparkSession.sparkContext
    keys = context.broadcast(bitmap(open_sets.select("members").mapInArrow(tokens, "digest long")))
    asked = context.broadcast(bitmap(open_sets.select("digest")))
    found = stored(candidates(posting_blocks(docs, min_words, threshold, rarity, targets, keys), threshold, targets, asked))
    wanted = context.broadcast(digest_bitmap(found.select("y")))
    places = context.broadcast(place_bitmap(found.select("doc", "line")))
    both = (found.join(open_sets.select(F.col("digest").alias("x"), F.col("members").alias("a")), "x")
            .join(token_sets(docs, min_words, wanted, places).select(F.col("digest").alias("y"), F.col("members").alias("b")), "y"))
    return compared(both, round(100 * threshold)).where("holds").select("x", "doc", "line")


def matched(docs: DataFrame, min_words: int, threshold: float, rarity, targets: int) -> DataFrame:
    """(x, doc, line): matches of the classes, among them the earliest one of each class that has one."""
    context, percent = docs.sparkSession.sparkContext, round(100 * threshold)
    found = stored(earliest(posting_blocks(docs, min_words, threshold, rarity, targets), threshold, targets))
    wanted = context.broadcast(digest_bitmap(found.select("x", "y")))
    places = context.broadcast(place_bitmap(found.select("doc", "line", "x_doc", "x_line")))
    sets = stored(token_sets(docs, min_words, wanted, places))
    first = (found.groupBy("x").agg(F.min(F.struct("doc", "line", "y")).alias("best"), F.min(F.when(F.col("cut"), F.struct("doc", "line"))).alias("known"))
             .select("x", "best.y", "best.doc", "best.line", "known"))
    first = stored(first)
    checked = stored(verified(first, sets, percent))
    near = checked.where("holds").select("x", "doc", "line")
    failed = checked.where("not holds").select("x", F.col("y").alias("not_y"), F.col("members").alias("a"))
    if failed.isEmpty():
        return near
    # The others of a class whose earliest candidate fails; ``known`` is how far its candidates are complete.
    rest = found.join(failed, "x").where("y <> not_y").groupBy("x", "y").agg(F.min(F.struct("doc", "line")).alias("at"), F.min("a").alias("a"))
    rest = rest.select("x", "y", "at.doc", "at.line", "a").join(sets.select(F.col("digest").alias("y"), F.col("members").alias("b")), "y")
    more = stored(compared(rest, percent).where("holds").select("x", "doc", "line"))
    settled = more.join(first.select("x", "known"), "x").where(F.struct("doc", "line") <= F.col("known")).select("x")
    open_sets = (failed.join(first.where("known is not null").select("x"), "x", "left_semi").join(settled, "x", "left_anti")
                 .select(F.col("x").alias("digest"), F.col("a").alias("members")))
    open_sets = stored(open_sets)
    near = near.union(more)
    return near if open_sets.isEmpty() else near.union(searched(docs, open_sets, min_words, threshold, rarity, targets))


def removed_lines(docs: DataFrame, text: str, ids: str, threshold: float, min_words: int) -> DataFrame:
    """(doc, text, removed): sorted numbers of the lines of a row that have an earlier match; only rows with such lines."""
    spark = docs.sparkSession
    arrow_batches(spark)
    targets = 2 * partitions(spark)
    docs = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    read = stored(occurrences(docs, min_words))
    lines = read.where("part is null").select("digest", "doc", "text", "line")
    rarity = spark.sparkContext.broadcast(sketch_sum(read.where("part is not null").select("part", "counts")))
    near = matched(docs, min_words, threshold, rarity, targets)
    near = near.groupBy(F.col("x").alias("digest")).agg(F.min(F.struct("doc", "line")).alias("cutoff"))
    own = lines.groupBy("digest").agg(F.min(F.struct("doc", "line")).alias("first"), F.count(F.lit(1)).alias("n"))
    cutoff = (own.join(near, "digest", "left").where("n > 1 or cutoff is not null")
              .select("digest", F.least("first", F.coalesce("cutoff", "first")).alias("cutoff")))
    return (lines.join(cutoff, "digest").where(F.struct("doc", "line") > F.col("cutoff"))
            .groupBy("doc", "text").agg(F.array_sort(F.collect_set("line")).alias("removed")))


def dedup_lines(docs: DataFrame, text: str = "text", ids: str = "doc_id", threshold: float = THRESHOLD,
                min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text without its later matches, and n_lines, n_removed, removed_lines."""
    gone = removed_lines(docs, text, ids, threshold, min_words)
    key = "removed_lines"

    def fresh(name: str) -> str:
        while name in docs.columns:
            name = f"_{name}"
        return name

    doc, digest, lines = fresh("doc"), fresh("digest"), fresh("removed")
    gone = gone.toDF(doc, digest, lines)
    split: Column = F.split(F.col(text), "\n", -1)
    none = F.array().cast("array<int>")
    # Only documents that may lose a line are shuffled; the others pass by.
    gone = stored(gone)
    bits = docs.sparkSession.sparkContext.broadcast(id_bitmap(gone.select(doc)))
    key_of = F.coalesce(F.col(ids).cast("long"), F.lit(int(np.iinfo(np.int64).max)))
    place, hit = fresh("place"), fresh("hit")
    told = docs.withColumn(place, key_of).withColumn(hit, perhaps(place, bits))
    same = (F.col(place) == F.col(doc)) & (F.xxhash64(F.col(text).cast("string")) == F.col(digest))
    touched = told.where(F.col(hit)).join(gone.hint("merge"), same, "left")  # it grows with the corpus: no broadcast
    passed = told.where(~F.col(hit)).withColumns({doc: F.lit(None).cast("long"), digest: F.lit(None).cast("long"), lines: F.lit(None).cast("array<int>")})
    joined = touched.unionByName(passed)
    left = F.when(F.col(lines).isNull(), F.col(text)).otherwise(
        value_of(split, lambda s: F.array_join(
            F.transform(F.array_except(F.sequence(F.lit(0), F.size(s) - 1), F.col(lines)), lambda i: F.get(s, i)), "\n")))
    kept = [left.alias(c) if c == text else F.col(c) for c in docs.columns if c not in ("n_lines", "n_removed", key)]
    return joined.select(*kept, F.coalesce(F.size(split), F.lit(0)).cast("long").alias("n_lines"),
                         F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_removed"),
                         F.coalesce(F.col(lines), none).alias(key))
