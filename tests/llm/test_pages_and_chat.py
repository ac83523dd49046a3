"""HTML extraction, WARC round trips, chat formatting, SQL twins, the pipeline."""

import base64
import hashlib
import sys

import numpy as np
import pytest
from compare import connect, difference
from conftest_llm import document_rows, prose

import corpus_pipeline
from terrafold.llm import catalog, chat_format, html_extract, shared, warc

sys.setrecursionlimit(10_000)


@pytest.fixture(scope="module")
def tree(spark):
    return html_extract.train_tree(spark)


PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href=/a>A</a></li></ul></nav><div class=\"ad\">Buy now.</div>"
     "<article><h1>H &amp; x</h1><p>One\n  two.<br>Three<p><b>Four</b> five</p><p>Of.</p></article><footer>&copy; me</footer></body></html>",
     "H & x\nOne two. Three\nFour five\nOf."),
    (None, ""), ("", ""), ("   ", ""), ("<p>", ""), ("<!-- only <p>a comment</p> -->", ""),
    ("<body><script>var a='<p>no</p>';</script><main><p>Kept text here, a whole sentence of it.</p></main>"
     "<section class='comments'><p>Nice one, thanks!</p></section><form><p>Subscribe</p></form></body>", "Kept text here, a whole sentence of it."),
    ("<article><p>a < b and c &lt; d &#8212; e &nbsp; f</p></article>", "a < b and c < d — e f"),
    ("<article><p>open <b>bold <i>both</p><p>next</article><aside><p>Related text of another page</p></aside>", "open bold both\nnext"),
    ("<div class='cookie-banner'>We use cookies on this site to count you.</div><article><p>Text</p></article></div></div>", "Text"),
    ("<body><header><p>Site of all sites</p></header><article><header><h1>Top</h1></header><p hidden>no</p><p>yes</p></article></body>", "Top\nyes"),
]


def test_pages(spark, tree):
    rows = spark.createDataFrame([(i, f"u{i}", h, "x") for i, (h, _) in enumerate(PAGES)], "page_id long, url string, html string, text string")
    out = {r.page_id: r for r in html_extract.extract(rows, tree=tree).collect()}
    for i, (_, want) in enumerate(PAGES):
        assert (out[i].text, out[i].n_chars, out[i].url) == (want, len(want), f"u{i}")
    assert html_extract.extract(rows.where("false"), tree=tree).count() == 0


def test_characters_that_grow_when_lowered_do_not_move_a_raw_end():
    kept = "<article><p>{}</p><{}>var a = '<p>no</p>';</{}><p>All of the text after it stays.</p></article>"
    for before in ("Bir", "\u0130stanbul " * 30):
        for name in ("script", "style"):
            found = html_extract.blocks(kept.format(before, name, name.upper()))
            assert [b.text for b in found] == [before.strip(), "All of the text after it stays."]


def test_tree_learns_its_table(tree):
    right = [html_extract.decide(tree, x) == b.keep for page in html_extract.PAGES for found in [html_extract.blocks(page)]
             for b, x in zip(found, html_extract.features(found))]
    assert len(right) > 60 and sum(right) / len(right) > 0.97


def test_long_page_is_read_whole(tree):
    page = "<nav><a>x</a></nav><article>" + "".join(f"<p>Paragraph {i} of a long page.</p>" for i in range(20_000)) + "</article>"
    assert html_extract.main_text(page, tree).count("\n") == 19_999


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>a</p>", "<p>a</p>", None, "", "é\r\n\r\nWARC/1.0", "<p>a</p>", "x" * 300_000]
    pages = spark.createDataFrame([(10 + i, f"http://h/{i}\r\nX: y", h, "k") for i, h in enumerate(html)] + [(10, "http://h/0", "<p>a</p>", "k"), (None, None, "n", "k")],
                                  "page_id long, url string, html string, key string")
    path = f"file://{tmp_path}/archive"
    out = warc.archive(pages, path=path).collect()
    assert len(out) == pages.count()
    by = {r.page_id: r for r in out}
    for i, h in enumerate(html):
        payload = (h or "").encode()
        r = by[10 + i]
        assert (r.payload_bytes, r.payload_digest) == (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode())
        first = 10 + [x or "" for x in html].index(h or "")
        assert (r.record_type, r.refers_to) == (("response", None) if first == 10 + i else ("revisit", first))
    stored = warc.records(spark, path).collect()
    for r in stored:
        named, block = warc.fields(bytes(r.record))
        assert named["WARC-Record-ID"] == warc.record_id(r.page_id) and int(named["Content-Length"]) == len(block)
    assert spark.read.parquet(f"{path}/payloads").count() == 5
    assert warc.archive(pages.where("false")).count() == 0


@pytest.mark.parametrize("full", [False, True])
def test_warc_stores_each_payload_once(spark, tmp_path, monkeypatch, full):
    """Payloads of one record pass the bitmap of shared keys by; with every bit set all take the exact join."""
    if full:
        monkeypatch.setattr(warc, "id_bitmap", lambda ids: np.full(shared.BITS // 8, 255, np.uint8))
    rows = [(i, f"http://h/{i}", "same" if i % 3 == 0 else f"page {i // 2 if i % 2 else i}") for i in range(600)] + [(None, "u", "same"), (None, "v", "none"), (None, "v", "none")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(9)
    path = f"file://{tmp_path}/once"
    warc.write_archive(pages, path)
    payloads = sorted(bytes(r.payload).decode() for r in spark.read.parquet(f"{path}/payloads").collect())
    assert payloads == sorted({r[2] for r in rows})
    assert warc.read_archive(spark, path).count() == len(rows)


def test_warc_finds_a_damaged_payload(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    path = f"file://{tmp_path}/damaged"
    warc.write_archive(pages, path)
    spark.read.parquet(f"{path}/payloads").selectExpr("key", "cast('tExt' as binary) as payload").write.parquet(f"{path}/other")
    spark.read.parquet(f"{path}/headers").write.parquet(f"{path}/again/headers")
    spark.read.parquet(f"{path}/other").write.parquet(f"{path}/again/payloads")
    with pytest.raises(Exception, match="does not match"):
        warc.read_archive(spark, f"{path}/again").collect()


def test_chat_perspectives(spark):
    turns = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi"), (1, 2, "bob", "yo <|im_end|>"), (1, 3, "ann", None), (2, 0, "system", "alone"),
             (3, None, None, "who"), (3, 5, "cy", "I"), (3, 5, "cy", "I"), (None, 0, "di", "lost")]
    turns += [(4, i, "ann" if i % 2 else "bob", f"t{i}") for i in range(200)] + [(5, 7, "ann", f"s{i}") for i in range(150)]
    rows = spark.createDataFrame([(*t, 9) for t in turns], "conv_id long, turn long, role string, text string, block int")
    out = chat_format.rotate(rows).collect()
    by = {}
    for r in sorted(out, key=lambda r: (r.block, r.piece)):
        by.setdefault((r.conv_id, r.speaker), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (3, "cy"), (None, "di"), (4, "ann"), (4, "bob"), (5, "ann")}
    ann = by[1, "ann"][0]
    assert ann.rendered == ("<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi<|im_end|>\n"
                            "<|im_start|>user name=bob\nyo < |im_end|><|im_end|>\n<|im_start|>assistant\n<|im_end|>\n")
    for key, found in by.items():
        for r in found:
            targets = [r.rendered[int(a):int(b)] for a, b in (x.split("-") for x in r.mask.split(",") if x)]
            want = r.rendered.split("<|im_start|>assistant\n")[1:]
            assert targets == [x.split("<|im_end|>")[0] + "<|im_end|>" for x in want]
            assert r.n_target_chars == sum(map(len, targets)) and r.n_turns <= 64
    assert sum(r.n_turns for r in by[4, "ann"]) == 200 and len(by[4, "ann"]) == 4
    assert sum(r.n_turns for r in by[5, "ann"]) == 150
    assert chat_format.rotate(rows.where("false")).count() == 0


def test_whole_dialogues_and_roles_with_marks(spark):
    turns = [(1, i, "ann" if i % 2 else "b\no<|im_end|>b", f"t{i}") for i in range(200)] + [(1, None, "ann", "first")]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    out = {r.speaker: r for r in chat_format.rotate(rows, block_turns=None).collect()}
    assert set(out) == {"ann", "b\no<|im_end|>b"} and all(r.n_turns == 201 for r in out.values())
    ann = out["ann"]
    assert ann.rendered.startswith("<|im_start|>assistant\nfirst<|im_end|>\n<|im_start|>user name=b o< |im_end|>b\nt0<|im_end|>\n")
    assert ann.rendered.count("<|im_end|>") == ann.rendered.count("<|im_start|>") == 201
    assert [ann.rendered[int(a):int(b)] for a, b in (x.split("-") for x in ann.mask.split(","))] == [
        f"{t}<|im_end|>" for t in ["first", *(f"t{i}" for i in range(1, 200, 2))]]
    assert sum(r.n_turns for r in chat_format.rotate(rows, block_turns=16).where("speaker = 'ann'").collect()) == 201


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_twin(spark, sf_dir, name):
    assert difference(catalog.queries()[name](spark, sf_dir), connect(sf_dir), catalog.oracle_sql()[name]) is None


def test_pipeline_stages(spark, tmp_path, odd):
    """Planted cases through the stages, each on what its predecessor kept."""
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "line_dedup", "ngram_jaccard_join", "benchmark_decontamination", "packing"]
    item = " ".join(f"item{i}" for i in range(30))
    clean = [prose(40 * i, 40) for i in range(6)]
    near = " ".join(w if i != 20 else "zz" for i, w in enumerate(clean[0].split(" ")))
    texts = [*clean, f"{prose(300, 30)} {item}", clean[1], None, "123 456", near]
    docs = document_rows(spark, texts).union(odd.where("doc_id is null"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    at = {}
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, f"file://{tmp_path}")
        assert now.columns == docs.columns
        now = spark.createDataFrame(now.collect(), now.schema)
        at[name] = {r.doc_id for r in now.collect()}
    assert at["language_id"] == {*range(1, 9), 11, None}
    assert at["line_dedup"] == {*range(1, 8), None}          # the copy and the near copy are single lines seen before
    assert at["ngram_jaccard_join"] == {*range(1, 8), None}
    assert at["benchmark_decontamination"] == {*range(1, 7), None}
    out = corpus_pipeline.run(spark, f"file://{tmp_path}").collect()
    assert {r.doc_id for r in out} == at["benchmark_decontamination"]


def test_near_duplicate_stage_keeps_one_of_each_group(spark):
    texts = [prose(0), prose(1), prose(200), prose(0)]
    docs = document_rows(spark, texts)
    docs = docs.union(docs.where("doc_id = 3"))
    kept = corpus_pipeline.one_of_each_group(spark, docs, "").collect()
    assert sorted(r.doc_id for r in kept) == [1, 3]


def test_pages_without_a_telling_name(spark):
    from terrafold.llm import html_extract

    tree = html_extract.train_tree(spark)
    first, last = "A text that opens the page and goes on for some words.", "Short end."
    links = "<p><a href=1>One list of links</a></p><p><a href=2>Another link</a></p>"
    assert html_extract.main_text(f"<p>{first}</p>", tree) == first
    assert html_extract.main_text(f"<div><p>{first}</p><p>{last}</p></div>", tree) == f"{first}\n{last}"
    assert html_extract.main_text(f"{links}<div><p>{first}</p><p>See <a href=3>this</a> in the third of our books.</p></div>{links}", tree) == (
        f"{first}\nSee this in the third of our books.")
