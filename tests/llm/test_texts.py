"""Decontamination, language ID, packing, licences and quality rules against brute force."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest_llm import document_rows, prose, words

from terrafold.llm import decontaminate, language_id, license_scan, packing, quality_rules


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- decontamination

def weighted(w):
    return Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))


def brute_items(text, items):
    w, found = words(text), set()
    grams = {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    for item, v in items:
        a = weighted(v)
        # a window without a gram of the item has similarity 0; a document shorter than the item is one window
        for start in range(max(1, len(w) - len(v) + 1) if grams & set(a) else 0):
            b = weighted(w[start:start + len(v)])
            low = sum(min(a[g], b[g]) * sum(len(x.encode()) for x in g) for g in a)
            high = sum(max(a[g], b[g]) * sum(len(x.encode()) for x in g) for g in a | b)
            if low and low / high >= 0.8 - 1e-12:
                found.add(item)
                break
    return found


def test_decontamination_by_brute_force(spark, sf_dir):
    docs, benchmark = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").limit(40)
    text = benchmark.first().text
    changed = text.split(" ")
    changed[-1] = "other"
    more = [f"{prose(0)} {' '.join(changed)} {prose(60)}", f"{prose(0, 9)}\n{text.upper()}", text[: len(text) // 2], None, ""]
    docs = docs.select("doc_id", "text").union(document_rows(spark, more, 10 ** 6).select("doc_id", "text"))
    items = [(r.item_id, words(r.text)) for r in benchmark.collect()]
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = decontaminate.report(docs, benchmark).collect()
    want = {d: sorted(brute_items(t, items)) for d, t in texts.items()}
    assert {r.doc_id: r.item_ids for r in out} == want
    assert all(r.contaminated == bool(r.item_ids) for r in out)
    assert want[10 ** 6 + 1] and want[10 ** 6] and not want[10 ** 6 + 2]


def test_decontamination_of_documents_shorter_than_the_item(spark):
    item = prose(0, 40).split(" ")
    texts = [" ".join(item[:-1]), " ".join(item[1:]), " ".join(item[:20]), " ".join(item[:4]), " ".join(item)]
    benchmark = spark.createDataFrame([(7, " ".join(item)), (8, prose(200, 16))], "item_id long, text string")
    out = {r.doc_id: r for r in decontaminate.report(document_rows(spark, texts), benchmark).collect()}
    assert [out[i].item_ids for i in range(1, 6)] == [[7], [7], [], [], [7]]
    a = weighted(item)
    for i in (1, 2):
        b, size = weighted(words(texts[i - 1])), lambda g: sum(map(len, g))
        assert out[i].max_similarity == pytest.approx(sum(size(g) for g in b) / sum(size(g) for g in a))
        assert [(s.item_id, s.start, s.length) for s in out[i].spans] == [(7, 0, 39)]
    assert decontaminate.clean(document_rows(spark, texts), benchmark).count() == 2


def test_contamination_of_rows_that_share_an_id(spark):
    benchmark = spark.createDataFrame([(1, prose(0, 30))], "item_id long, text string")
    docs = spark.createDataFrame([(2, f"{prose(100, 9)} {prose(0, 30)}"), (2, prose(200)), (None, prose(0, 30)), (None, prose(300))], "doc_id long, text string")
    out = decontaminate.report(docs, benchmark).select("doc_id", "contaminated").collect()
    assert sorted(map(tuple, out), key=str) == sorted([(2, True), (2, False), (None, True), (None, False)], key=str)
    assert {r.text for r in decontaminate.clean(docs, benchmark).collect()} == {prose(200), prose(300)}


def test_items_shorter_than_a_shingle_match_their_whole_sequence(spark):
    benchmark = spark.createDataFrame([(1, "Alpha beta, gamma DELTA"), (2, "omega psi"), (3, "omega psi"), (4, " \n "), (5, prose(0, 30))], "item_id long, text string")
    texts = ["alpha beta, gamma delta", f"{prose(50)} ALPHA beta, gamma delta {prose(90)}", "alpha beta, gamma", "beta, gamma delta alpha", "omega\tpsi", "omega",
             f"omega psi {prose(0, 30)}", "psi omega", f"{prose(200)} omega", "psi"]
    out = {r.doc_id: r for r in decontaminate.report(document_rows(spark, texts), benchmark).collect()}
    assert [out[i].item_ids for i in range(1, 11)] == [[1], [1], [], [], [2, 3], [], [2, 3, 5], [], [], []]
    assert all(s.similarity == pytest.approx(1) for r in out.values() for s in r.spans or ())
    assert [(s.item_id, s.start, s.length) for s in out[2].spans] == [(1, len(prose(50).split()), 4)]


def test_hamming_blocks_find_all_within_radius():
    draw = np.random.default_rng(1)
    prints = draw.integers(0, 1 << 64, 300, dtype=np.uint64)
    index = decontaminate.HammingBlocks(prints, 20)
    for f in prints[:20].tolist():
        query = f ^ sum(1 << int(b) for b in draw.choice(64, int(draw.integers(0, 24)), replace=False))
        want = [(i, d) for i, p in enumerate(prints.tolist()) if (d := (p ^ query).bit_count()) <= 20]
        assert index.within(query) == want


def test_decontamination_odd_rows(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, prose(0)), (2, None), (3, ""), (4, "a b c d")], "item_id long, text string")
    rows = decontaminate.report(odd, benchmark).collect()
    assert len(rows) == odd.count() and {r.doc_id for r in rows if r.contaminated} == {7, 8, 9, 10}
    assert decontaminate.clean(odd, benchmark).columns == odd.columns
    assert decontaminate.clean(odd, benchmark).count() == odd.count() - 5
    assert decontaminate.report(empty, benchmark).count() == 0
    assert decontaminate.report(odd, benchmark.where("false")).where("contaminated").count() == 0


# ---- language ID

def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    lang = {r.doc_id: r.lang for r in docs.collect()}
    out = language_id.identify(docs).collect()
    assert len(out) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    held = [r for r in out if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def test_labels_of_held_out_rows_are_not_learned(spark):
    docs = document_rows(spark, [prose(i, 20) for i in range(60)])
    from pyspark.sql import functions as F

    known = docs.withColumn("lang", F.when(language_id.held_out(F.col("doc_id")), "xx").otherwise("en"))
    assert "xx" not in language_id.train(known).labels


def test_a_rare_language_is_learned_beside_many_rows_of_others(spark):
    rare = [f"żółć gęślą jaźń {'ąęś ' * (i % 4)}" for i in range(12)]
    docs = document_rows(spark, [prose(i, 20) for i in range(400)]).selectExpr("doc_id", "text", "'en' as lang").union(
        document_rows(spark, rare, 10_000).selectExpr("doc_id", "text", "'pl' as lang")).union(
        document_rows(spark, ["...", None], 20_000).selectExpr("doc_id", "text", "'none' as lang"))
    model = language_id.train(docs, max_train=20, per_label=6)
    assert model.labels == ["en", "pl"]
    found = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert all(found[10_000 + i] == "pl" for i in range(12)) and all(found[i + 1] == "en" for i in range(400))


def test_language_odd_rows(spark, odd, empty):
    rows = language_id.identify(odd).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (1, 2, 3, 5, 11)} == {"und"}
    assert all((r.score == 0) == (r.lang_pred == "und") for r in rows)
    assert language_id.identify(empty).count() == 0


def test_ftrl_weights_are_sparse_and_temperature_calibrates():
    draw = np.random.default_rng(0)
    rows = []
    for i in range(300):
        y = i % 3
        slot = np.unique(np.append(draw.integers(100, 5000, 30), [y, y + 10]))
        rows.append((slot, np.full(len(slot), 0.2), y))
    weight, bias = language_id.fit_ftrl(rows, 3, 0.5, 1.0, 0.05, 1e-4, 3, 1)
    assert (weight == 0).mean() > 0.9
    assert np.mean([(x @ weight[s] + bias).argmax() == y for s, x, y in rows]) > 0.98
    sharp = np.array([[8.0, 0.0], [8.0, 0.0], [0.0, 8.0], [8.0, 0.0]])
    assert language_id.calibrate(sharp, np.array([0, 0, 1, 1])) > 1


# ---- packing

def check_packing(out, texts, window=1024):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    tokenizer.encode_special_tokens = True
    spare = defaultdict(list)
    for doc, text in texts:
        spare[doc].append(tokenizer.encode(text or "", add_special_tokens=False).ids + [0])
    covered, windows = Counter(), defaultdict(list)
    for p in out:
        assert any(len(ids) == p.doc_tokens and zlib.crc32(np.array(ids[p.start:p.start + p.length], "<u4").tobytes()) == p.ids_crc32
                   for ids in spare[p.doc_id])
        covered[p.doc_id] += p.length
        windows[p.sequence_id].append((p.offset, p.length))
    assert covered == {d: sum(map(len, x)) for d, x in spare.items()}
    assert sorted(windows) == list(range(len(windows)))
    for number, found in windows.items():
        at = 0
        for offset, length in sorted(found):
            assert offset == at and length > 0
            at += length
        assert at == window or number == max(windows)


def test_packing_against_the_tokenizer(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    check_packing(packing.pack(docs).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_packing_odd_rows(spark, odd, empty):
    docs = odd.where("length(text) < 150000 or text is null")
    check_packing(packing.pack(docs, window=64).collect(), [(r.doc_id, r.text) for r in docs.collect()], 64)
    assert packing.pack(empty).count() == 0


def test_words_encoded_apart_give_the_ids_of_the_whole():
    from tokenizers import Tokenizer

    coder = packing.word_tokenizer(packing.byte_bpe_path())
    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    for text in ["don't  stop", " a b", "a b ", "a\nb c\n\n d", "x y z", "it's 's '", "I'll  we've\t'd o' clock", "é à 12 3.5 %% <|endoftext|> x", "a  b", "  a b"]:
        whole = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(coder.encode([text])[0], coder.kind).tolist() == whole, text


def test_packing_recognises_added_tokens(spark):
    """The ids of a Tokenizer in its default state."""
    from tokenizers import Tokenizer

    coder = packing.word_tokenizer(packing.byte_bpe_path())
    tokenizer = Tokenizer.from_file(packing.byte_bpe_path())
    end = "<|endoftext|>"
    texts = [end, f"a b {end} c d", f"one{end}{end} two", f"a  {end}  b\n{end}\n", f"{end}x", f"é {end[:-1]} {end}", "don't  stop", " a b", "a b ", "a\nb c\n\n d",
             "x y z", "it's 's '", "I'll  we've\t'd o' clock", "é à 12 3.5 %%", "  a b"]
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, coder.kind).tolist() for x in coder.encode(texts)] == want
    assert 50256 in want[1]
    out = packing.pack(document_rows(spark, texts), with_tokens=True).orderBy("doc_id").collect()
    assert [r.tokens for r in out] == [ids + [packing.SEPARATOR] for ids in want]


# ---- licences

def brute_licences(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in license_scan.PHRASES.items() for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in hits]
    return len(w), len(hits), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in hits}))


def test_licence_base_scan(spark, sf_dir, odd, empty):
    for docs in (table(spark, sf_dir, "documents"), odd):
        texts = defaultdict(list)
        for r in docs.collect():
            texts[r.doc_id].append(r.text)
        out = license_scan.scan_licenses(docs).collect()
        assert len(out) == docs.count()
        assert all((r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licences(texts[r.doc_id][0]) for r in out)
        assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1 for r in out)
    assert license_scan.scan_licenses(empty).count() == 0


def test_licence_spans_drift_and_versions(spark):
    notice = next(t for label, t in license_scan.TEMPLATES if label == "bsd")
    inserted = notice.split(" ")
    inserted.insert(9, "surely")
    texts = [f"{prose(0)} {notice} {prose(60)}", f"{prose(0)} {' '.join(inserted)}", " ".join(notice.split(" ")[:8]),
             "x\nThis work is licensed under the GNU General Public License, version 3.\ny", prose(0)]
    out = {r.doc_id: r for r in license_scan.scan_licenses(document_rows(spark, texts)).collect()}
    assert [out[i].labels for i in range(1, 6)] == ["bsd", "bsd", "", "gpl-3", ""]
    assert out[1].score == 1 and 0.8 <= out[2].score < 1 and out[5].score == 0
    assert out[1].spans[0].first_word == 60


# ---- quality rules

def brute_quality(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    repeated = {j for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeated)


def test_quality_measures(spark, sf_dir, odd, empty):
    for docs in (table(spark, sf_dir, "documents"), odd):
        texts = {r.doc_id: r.text for r in docs.collect()}
        out = quality_rules.judge(docs).collect()
        assert len(out) == docs.count()
        for r in out:
            want = brute_quality(texts[r.doc_id])
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
            assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (r.kept and r.base_failed)
    assert quality_rules.judge(empty).count() == 0


def test_wide_windows_equal_packed_ones(spark, sf_dir):
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").limit(60).withColumn("w", quality_rules.word_array(F.col("text")))
    both = docs.select(F.size(F.array_distinct(quality_rules.repeated_windows(F.col("w")))).alias("a"),
                       F.size(F.array_distinct(quality_rules.value_of(quality_rules.window_hashes(F.col("w")), lambda h: quality_rules.value_of(
                           F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))),
                           lambda s: quality_rules.neighbours(s, lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"]))))))).alias("b"))
    assert both.where("a <> b").count() == 0


def test_cascade_order_does_not_change_the_verdict(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rules = quality_rules.default_rules()
    measured = quality_rules.measured(docs, "text", "doc_id")
    forward = measured.select("doc_id", quality_rules.cascade(list(rules)).isNull().alias("kept")).collect()
    backward = measured.select("doc_id", quality_rules.cascade(list(rules)[::-1]).isNull().alias("kept")).collect()
    assert sorted(forward) == sorted(backward)
    found = quality_rules.ordered(measured, rules, 100)
    assert [r[1] / max(r[2], 1e-6) for r in found] == sorted((r[1] / max(r[2], 1e-6) for r in found), reverse=True)
    assert {r[0].name for r in found} == {r.name for r in rules}


@pytest.mark.parametrize("name", ["op6_chat_formatting", "op10_quality_rules"])
def test_native_plans(spark, sf_dir, name):
    from terrafold.llm import catalog

    plan = catalog.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
