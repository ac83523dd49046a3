"""Line dedup and the n-gram join against brute force."""

import random
from itertools import combinations

import pytest
from conftest_llm import document_rows, least_reachable, prose, shingles, words
from pyspark.sql import functions as F

from terrafold.llm import line_dedup, ngram_join


def edited(text, draw, n):
    w = text.split(" ")
    for _ in range(n):
        w[draw.randrange(len(w))] = f"e{draw.randrange(10 ** 6)}"
    return " ".join(w)


def random_lines(draw):
    base = [" ".join(f"w{int(draw.expovariate(0.05))}" for _ in range(draw.randrange(1, 30))) for _ in range(60)]
    return [edited(draw.choice(base), draw, draw.randrange(0, 4)) if draw.random() < 0.7 else " ".join(draw.sample(draw.choice(base).split(), 1)) for _ in range(12)]


def brute_removed(rows, threshold=0.8, min_words=5):
    lines = sorted((d, i, frozenset(words(x))) for d, t in rows if t is not None for i, x in enumerate(t.split("\n")) if len(words(x)) >= min_words)
    gone = {}
    for d, i, s in lines:
        for d2, i2, s2 in lines:
            if (d2, i2) >= (d, i):
                break
            o = len(s & s2)
            if 100 * o >= 100 * threshold * (len(s) + len(s2) - o) - 1e-9:
                gone.setdefault(d, []).append(i)
                break
    return gone


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup_random(spark, seed):
    draw = random.Random(seed)
    texts = ["\n".join(random_lines(draw)) for _ in range(40)]
    out = line_dedup.dedup_lines(document_rows(spark, texts)).collect()
    want = brute_removed(list(enumerate(texts, 1)))
    for r in out:
        lines = texts[r.doc_id - 1].split("\n")
        assert r.removed_lines == want.get(r.doc_id, [])
        assert r.text == "\n".join(x for i, x in enumerate(lines) if i not in r.removed_lines)
        assert (r.n_lines, r.n_removed) == (len(lines), len(r.removed_lines))


def test_line_dedup_searches_on_when_the_earliest_candidate_fails(spark):
    """The first candidate shares its signature with the line but is under the threshold; a later one holds."""
    line = " ".join(f"a{i}" for i in range(40))
    far = " ".join([f"a{i}" for i in range(35)] + [f"b{i}" for i in range(5)])     # 35 / 45
    near = " ".join([f"a{i}" for i in range(38)] + ["b0", "b1"])                    # 38 / 42
    texts = [far, near, line]
    assert brute_removed(list(enumerate(texts, 1))) == {r.doc_id: r.removed_lines for r in line_dedup.dedup_lines(document_rows(spark, texts)).collect()
                                                         if r.removed_lines}


def test_line_dedup_open_search(spark):
    """The exact second join alone finds the earliest match."""
    import numpy as np

    from terrafold.llm.line_dedup import line_sets, searched
    from terrafold.llm.shared import SKETCH
    import pyarrow as pa

    texts = [prose(0, 40), prose(1, 40), prose(30, 40), prose(2, 40)]
    docs = document_rows(spark, texts).select("doc_id", "text")
    _, _, members, cut, digest = next(iter(line_sets(pa.array([4], pa.int64()), pa.array([texts[3]]), 5)))
    sets = spark.createDataFrame([(int(digest.view(np.int64)[0]), bytearray(members.tobytes()))], "digest long, members binary")
    rarity = spark.sparkContext.broadcast(np.zeros(SKETCH, np.uint64))
    found = searched(docs, sets, 5, 0.8, rarity, 4).collect()
    assert {(r.doc, r.line) for r in found} == {(1, 0)} or min((r.doc, r.line) for r in found) == (1, 0)


def test_line_dedup_settles_a_failed_candidate_without_a_second_search(spark, monkeypatch):
    """The corpus is searched again only for classes that have more candidates than were kept."""
    def refused(*args):
        raise AssertionError("searched again")

    line = " ".join(f"a{i}" for i in range(40))
    far = " ".join([f"a{i}" for i in range(35)] + [f"b{i}" for i in range(5)])
    near = " ".join([f"a{i}" for i in range(38)] + ["b0", "b1"])
    wide = [" ".join(f"c{i}" for i in range(k, k + 300)) for k in (0, 45, 20)]          # of 300 words the signatures tell nothing
    texts = [far, near, line, *wide, "\n".join([" ".join(f"c{i}" for i in [*range(30), *range(315, 345)])] * 30)]
    monkeypatch.setattr(line_dedup, "searched", refused)
    out = line_dedup.dedup_lines(document_rows(spark, texts), min_words=1).collect()
    assert {r.doc_id: r.removed_lines for r in out if r.removed_lines} == brute_removed(list(enumerate(texts, 1)), min_words=1)


def test_line_dedup_searches_on_beyond_the_kept_candidates(spark, monkeypatch):
    """More lines than are kept pass the filters and fail; the match of the last line comes after them."""
    draw = random.Random(9)
    pool = [f"p{i}" for i in range(4000)]                                               # more frequent than the shared words
    texts = ["\n".join([" ".join(pool)] * 120)]
    texts += [" ".join([*(f"s{i}" for i in range(262)), *draw.sample(pool, 38)]) for _ in range(90)]
    texts.append(" ".join([*texts[-1].split()[:-5], *(f"z{i}" for i in range(5))]))
    searches = []
    search = line_dedup.searched
    monkeypatch.setattr(line_dedup, "searched", lambda docs, sets, *rest: searches.append(sets.count()) or search(docs, sets, *rest))
    out = line_dedup.dedup_lines(document_rows(spark, texts), min_words=1).collect()
    want = brute_removed(list(enumerate(texts, 1)), min_words=1)
    assert {r.doc_id: r.removed_lines for r in out if r.removed_lines} == want
    assert want[len(texts)] == [0] and searches and searches[0] > 1


@pytest.mark.parametrize("sizes", [(3, 12), (40, 60)])
def test_line_dedup_lists_lose_no_pair(sizes):
    """Lists and filters pass every pair of sets that are similar enough, and no class meets itself."""
    import numpy as np
    import pyarrow as pa

    from terrafold.llm.shared import SKETCH

    draw = random.Random(sizes[0])
    base = [[f"w{draw.randrange(90)}" for _ in range(draw.randrange(*sizes))] for _ in range(12)]
    texts = pa.array(["\n".join(edited(" ".join(draw.choice(base)), draw, draw.randrange(4)) for _ in range(60)) for _ in range(2)])
    doc, line, members, cut, digest = next(line_dedup.line_sets(pa.array([1, 2], pa.int64()), texts, 1))
    low, high = line_dedup.signatures(members, cut)
    unit, place, token = line_dedup.prefixes(members, cut, np.zeros(SKETCH, np.uint64), 0.8)
    rows = np.zeros(len(unit), line_dedup.POSTING)
    for name, value in {"key": token & np.uint64(0xFFFFFFFF), "n": np.diff(cut)[unit], "digest": digest[unit].view(np.int64), "low": low[unit],
                        "high": high[unit], "doc": doc[unit], "line": line[unit], "place": place}.items():
        rows[name] = value
    rows, *lists = line_dedup.in_lists(rows, 0.8)
    found = {(int(rows["digest"][a]), int(rows["digest"][b])) for late, early, _ in line_dedup.matches(rows, *lists, 0.8) for a, b in zip(late, early)}
    first = {}
    for i, d in enumerate(digest.view(np.int64).tolist()):
        first.setdefault(d, set(members[cut[i]:cut[i + 1]].tolist()))
    ids = list(first)
    want = {(b, a) for k, a in enumerate(ids) for b in ids[k + 1:] if 100 * len(first[a] & first[b]) >= 80 * len(first[a] | first[b])}
    assert want and want <= found and all(a != b for a, b in found)


def test_line_dedup_first_candidates():
    import numpy as np

    rows = [(1, 9, 5, 0, True, False), (1, 8, 4, 0, False, False), (1, 7, 6, 0, True, False), (1, 6, 7, 0, True, False), (1, 8, 4, 0, False, False),
            (2, 5, 3, 1, False, True), (2, 4, 3, 2, False, False), (3, 3, 1, 0, True, False)]
    found = np.zeros(len(rows), line_dedup.CANDIDATE)
    for i, row in enumerate(rows):
        found[["x", "y", "doc", "line", "sure", "cut"]][i] = row
    kept = line_dedup.first_candidates(found, 64)
    assert [(int(r["x"]), int(r["y"]), bool(r["cut"])) for r in kept] == [(1, 8, False), (1, 9, False), (1, 7, True), (2, 5, True), (3, 3, False)]
    assert [(int(r["x"]), int(r["y"]), bool(r["cut"])) for r in line_dedup.first_candidates(found, 1)] == [(1, 8, True), (2, 5, True), (3, 3, False)]
    assert len(line_dedup.first_candidates(found[:0], 64)) == 0


def test_line_sets_of_asked_places():
    """Only the asked lines are read; sets and digests are those of the whole read."""
    import numpy as np
    import pyarrow as pa

    from terrafold.llm.shared import BITS

    ids, texts = pa.array([5, None, 7], pa.int64()), pa.array(["a b\n\nc d e\nf", "g h\ni", None])
    every = [(int(d), int(n), int(g)) for doc, line, _, _, digest in line_dedup.line_sets(ids, texts, 1) for d, n, g in zip(doc, line, digest)]
    wanted = [every[1], every[4]]
    bits = np.zeros(BITS, bool)
    at = line_dedup.place_hash(np.array([w[0] for w in wanted]), np.array([w[1] for w in wanted]))
    bits[(at >> np.uint64(17)).astype(np.int64) & (BITS - 1)] = True
    some = [(int(d), int(n), int(g)) for doc, line, _, _, digest in line_dedup.line_sets(ids, texts, 1, places=np.packbits(bits))
            for d, n, g in zip(doc, line, digest)]
    assert len(every) == 5 and some == wanted
    assert [len(x[4]) for x in line_dedup.line_sets(ids, texts, 1, places=np.zeros(BITS // 8, np.uint8))] == [0]


def test_line_dedup_odd_rows(spark, odd, odd_texts, empty):
    out = line_dedup.dedup_lines(odd)
    assert out.columns == [*odd.columns, "n_lines", "n_removed", "removed_lines"]
    rows = out.collect()
    assert len(rows) == odd.count()
    assert {r.text for r in rows if r.doc_id == 1} == {None} and {r.n_lines for r in rows if r.doc_id == 1} == {0}
    assert [r.n_removed for r in rows if r.doc_id == 7] == [0, 0]          # one document given twice
    assert all(r.text == "" for r in rows if r.doc_id in (8, 9))            # copies of it
    assert next(r for r in rows if r.doc_id is None).n_removed == 0
    assert line_dedup.dedup_lines(empty).count() == 0


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup_lets_every_line_with_a_word_take_part(spark, seed):
    draw = random.Random(seed)
    texts = ["\n".join([*random_lines(draw), *(" ".join(draw.choices("abcdef", k=draw.randrange(0, 7))) for _ in range(8))]) for _ in range(25)]
    texts += ["four of five words", "Four of FIVE words here", "one two three", "one two three four", "\n \n"]  # 4 / 5 links, 3 / 4 does not
    rows = list(enumerate(texts, 1))
    out = line_dedup.dedup_lines(document_rows(spark, texts), min_words=line_dedup.EVERY_LINE).collect()
    want = brute_removed(rows, min_words=1)
    assert {r.doc_id: r.removed_lines for r in out if r.removed_lines} == want
    assert want[27] == [0] and 29 not in want and 30 not in want


def test_line_dedup_query_and_stage_remove_short_copies(spark, sf_dir, tmp_path):
    import corpus_pipeline
    from terrafold.llm import catalog

    texts = [f"Contents\n{prose(0)}\nThe end", f"Contents\n{prose(0)}\nThe end", "Contents\nother words than these"]
    document_rows(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    out = {r.doc_id: r.removed_lines for r in catalog.queries()["op1_line_dedup"](spark, str(tmp_path)).collect()}
    assert out == {1: "", 2: "0,1,2", 3: "0"}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id for r in corpus_pipeline.unique_lines(spark, docs, sf_dir).collect()} == {1, 3}


def test_line_dedup_query_equals_the_twin_without_its_filter(spark, sf_dir):
    from compare import connect, difference
    from terrafold.llm import catalog, twins

    every = twins.LINE_DEDUP.replace("len(w) >= 5", "len(w) >= 1")
    assert every != twins.LINE_DEDUP
    assert difference(catalog.queries()["op1_line_dedup"](spark, sf_dir), connect(sf_dir), every) is None


@pytest.mark.parametrize("chunk", [400_000, 150])
def test_ngram_join_random(spark, chunk):
    draw = random.Random(chunk)
    base = [" ".join(f"w{draw.randrange(4000)}" for _ in range(draw.randrange(1, 120))) for _ in range(25)]
    texts = [edited(t, draw, draw.randrange(0, 4)) for t in base for _ in range(draw.choice([1, 1, 4, 12]))]
    texts += [base[0] + " " + base[1], base[2][: len(base[2]) // 2], base[3], base[3]]
    draw.shuffle(texts)
    sets = {i: shingles(t) for i, t in enumerate(texts, 1)}
    links = [(a, b) for a, b in combinations(sets, 2) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = least_reachable(links, sets)
    out = ngram_join.linked_components(document_rows(spark, texts), chunk=chunk).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == {i: (len(sets[i]), want[i]) for i in sets}
    assert any(want[i] != i for i in sets)


def test_ngram_join_chain_of_near_copies(spark):
    """Each text links with its neighbours only; the chain is one component."""
    texts = [prose(4 * i, 80) for i in range(20)]
    out = ngram_join.linked_components(document_rows(spark, texts), chunk=100).collect()
    assert {r.component_id for r in out} == {1}


def test_ngram_join_odd_rows(spark, odd, empty):
    rows = ngram_join.linked_components(odd).collect()
    by = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert [by[i].n_shingles for i in (1, 2, 3, 4)] == [0, 0, 0, 1]
    assert [by[i].component_id for i in (1, 2, 3, 7, 8, 9)] == [1, 2, 3, 7, 7, 7]
    assert ngram_join.linked_components(empty).count() == 0


def test_ngram_join_links_near_copies_of_null_ids(spark):
    """The set of the null row is in no other row; an id above 2^53 stands beside it."""
    high = (1 << 53) + 1
    rows = [(high, prose(0, 80)), (None, prose(1, 80)), (5, prose(200, 80))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    out = {r.doc_id: r.component_id for r in ngram_join.linked_components(docs).collect()}
    assert out[high] == high and out[5] == 5
    assert high in {v for k, v in out.items() if k not in (high, 5)}


def test_lists_of_changing_partners_leave_no_candidate(spark):
    """A text that shares one shingle with each of many texts meets nothing often; its sizes would allow a link."""
    import numpy as np
    import pyarrow as pa

    from terrafold.llm.shared import SKETCH, sketch_slot

    own = [f"own{i}" for i in range(120)]
    texts = [" ".join(own)]
    places = range(0, 115, 5)
    for at in places:
        texts.append(" ".join([f"t{at}x{j}" for j in range(60)] + own[at:at + 5] + [f"t{at}y{j}" for j in range(55)]))
    texts += [" ".join([f"c{i}" for i in range(120)]), " ".join([f"c{i}" for i in range(118)] + ["d", "e"])]
    docs = document_rows(spark, texts).select("doc_id", "text")
    sizes = {r.doc_id: r.digest for r in ngram_join.classes(docs, 5).where("part is null").collect()}
    rarity = np.ones(SKETCH, np.uint64)  # the shared shingles come first in every prefix
    for _, members, _, _ in ngram_join.document_sets(pa.array(places, pa.int64()), pa.array([" ".join(own[at:at + 5]) for at in places]), 5):
        rarity[sketch_slot(members)] = 0
    blocks = ngram_join.prefix_blocks(docs, 5, 0.8, spark.sparkContext.broadcast(rarity), 4)
    listed = ngram_join.lists(blocks, 0.8, 4)
    assert listed.where(F.col("digest") == sizes[1]).count() == len(places)
    kept = {r.digest for r in ngram_join.meeting_often(listed, 0.8, 4).collect()}
    assert kept == {sizes[len(texts) - 1], sizes[len(texts)]}


def test_windows_and_visits(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    value = draw.integers(0, 1 << 60, 200)
    a = draw.integers(0, 200, 300)
    b = np.minimum(200, a + draw.integers(0, 40, 300))
    want = [min(value[x:y], default=-1) for x, y in zip(a, b)]
    assert ngram_join.over_windows(np.minimum, value, a, b, -1).tolist() == want

    rows = []  # (list, digest, known, large, shard)
    for _ in range(400):
        known = int(draw.integers(0, 6))
        large = known > 3
        rows.append((int(draw.integers(0, 60)), int(draw.integers(0, 1000)) * 6 + known, known, large, int(draw.integers(0, 3)) + (10 * known if large else 0)))
    rows = list({(r[0], r[1]): r for r in rows}.values())
    here = spark.createDataFrame(rows, "list long, digest long, known long, large boolean, shard long")
    found = {(r.group, r.digest, r.known) for r in ngram_join.visits(here, 3).collect()}
    names, pairs = {}, set()
    for i, digest, known, large, shard in rows:
        here_too = [r for r in rows if r[0] == i]
        if len({r[2] for r in here_too}) > 1:
            for _, _, k, big, other in here_too:
                if (other != shard or not large) and not (large and big and k == known):
                    pairs.add((min(shard, other), max(shard, other), digest, known))
    assert len(found) == len(pairs)
    by_digest = lambda rows_of: sorted((d, k) for *_, d, k in rows_of)
    assert by_digest(found) == by_digest(pairs)
    for low, high, digest, known in pairs:
        names.setdefault((low, high), set()).add(digest)
    groups = {}
    for group, digest, _ in found:
        groups.setdefault(group, set()).add(digest)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, names.values()))


def test_divide_skip_counts():
    draw = random.Random(3)
    for _ in range(50):
        lists = [sorted(draw.sample(range(60), draw.randrange(0, 40))) for _ in range(draw.randrange(1, 15))]
        need = draw.randrange(1, 10)
        want = {x: n for x in range(60) if (n := sum(x in y for y in lists)) >= need}
        assert ngram_join.divide_skip(lists, need) == want


def test_components_of_chains_and_stars(spark):
    from terrafold.llm.shared import components

    draw = random.Random(5)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [tuple(draw.sample(range(200, 260), 2)) for _ in range(40)]
    draw.shuffle(edges)
    want = least_reachable(edges, {x for e in edges for x in e})
    out = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r.node: r.component for r in out} == want


def test_rows_of_one_id_lose_only_their_own_lines(spark):
    rows = spark.createDataFrame([(1, "alpha beta gamma delta eps"), (2, "unique line one two three"), (2, "alpha beta gamma delta eps")], "doc_id long, text string")
    out = line_dedup.dedup_lines(rows).select("doc_id", "text", "n_removed").collect()
    assert sorted(map(tuple, out)) == [(1, "alpha beta gamma delta eps", 0), (2, "", 1), (2, "unique line one two three", 0)]
