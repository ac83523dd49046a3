"""Concatenate and cut: documents in id order form one stream of token ids, cut into windows of fixed size.

Two passes. The first range-partitions the documents by id, sorts each partition, tokenizes it and writes the ids with
the number of ids before each document *in its partition*. Partition totals (one row a partition) are summed to global
offsets; the second pass adds them and cuts every document at the window bounds it crosses. Each piece is one boundary
record. No text or id is in a window function, and a partition that is lost is made again from the written table.

Nulls and ties: a null or empty text is the separator alone; rows with equal ids are neighbours (ordered by text), and each
is packed; null ids come first. An empty table gives no piece. Other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import arrow_batches, partitions, stored

WINDOW = 1024
SEPARATOR = 0
#: Words whose ids a Python worker remembers (about 80 MB); the memory is emptied when it is full.
REMEMBERED = 400_000

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def byte_bpe_path() -> str:
    """The 50k byte-level BPE of the public tokenizer files, found on the machine that runs the task."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class WordTokenizer(dict):
    """Ids of whole texts by a byte-level BPE file, each distinct word encoded once and remembered.

    The tokenizer's splitting pattern begins a new piece at a space between two characters that are not white space, so a
    text may be cut before those spaces and its parts encoded apart; a text in which a space meets other white space is encoded
    whole. A part is encoded from the file's vocabulary by tiktoken, which gives the ids of the tokenizers library in a
    third of its time (``test_packing_recognises_added_tokens`` compares them). As in that library, the file's added tokens are
    recognised inside a text: it is cut at them, and the stretches between are encoded apart.
    """

    MEETS = re.compile(r"\s | \s|^ | \Z")

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)
        added = {t["content"]: t["id"] for t in vocabulary["added_tokens"]}
        if any(t[x] for t in vocabulary["added_tokens"] for x in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path}: added tokens that take white space or stand for whole words only are not supported")
        byte_of = printable_bytes()
        ranks = {bytes(byte_of[c] for c in word): rank for word, rank in vocabulary["model"]["vocab"].items() if word not in added}
        self.kind = np.dtype("<u2" if max([*vocabulary["model"]["vocab"].values(), *added.values()]) < 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.added = {content: array(self.code, [number]).tobytes() for content, number in added.items()}
        longest_first = sorted(filter(None, added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(map(re.escape, longest_first))})") if longest_first else None
        self.encode_part = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, part: str) -> bytes:
        found = array(self.code, self.encode_part(part)).tobytes()
        if len(part) <= 64:
            self[part] = found
        return found

    @classmethod
    def parts(cls, text: str) -> list[str]:
        if cls.MEETS.search(text):
            return [text]
        return text.replace(" ", "\0 ").split("\0") if "\0" not in text else [text]

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self) > REMEMBERED:
            self.clear()
        return [self.stretch(t) if self.cut is None or not self.cut.search(t) else
                b"".join(self.added[x] if i % 2 else self.stretch(x) for i, x in enumerate(self.cut.split(t))) for t in texts]

    def stretch(self, text: str) -> bytes:
        return b"".join(map(self.__getitem__, self.parts(text))) if text else b""


#: Fixed value: the splitting pattern of byte-level BPE, as in the tokenizer's file.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_coders: dict[str, WordTokenizer] = {}


def printable_bytes() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the rest from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer for a Python worker: its words stay remembered from task to task."""
    if path not in _coders:
        _coders[path] = WordTokenizer(path)
    return _coders[path]


def tokenized(docs: DataFrame, text: str, ids: str, tokenizer, separator: int = SEPARATOR) -> DataFrame:
    """(part, doc_id, before, tokens): ids of every document, and how many ids its partition holds before it."""
    arrow_batches(docs.sparkSession)

    def encode(batches):
        coder = word_tokenizer(tokenizer())
        end = np.array([separator], coder.kind).tobytes()
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = batch.column(1).fill_null("").to_pylist()
            for a in range(0, len(texts), 200):
                blobs = [x + end for x in coder.encode(texts[a:a + 200])]
                sizes = np.array([len(x) // coder.kind.itemsize for x in blobs], np.int64)
                starts = before + np.concatenate(([0], np.cumsum(sizes)[:-1]))
                before += int(sizes.sum())
                yield pa.RecordBatch.from_pydict({
                    "part": pa.array(np.full(len(blobs), part, np.int32)), "doc_id": batch.column(0).slice(a, len(blobs)),
                    "before": pa.array(starts), "n": pa.array(sizes), "width": pa.array(np.full(len(blobs), coder.kind.itemsize, np.int32)),
                    "tokens": pa.array(blobs, pa.binary())})

    rows = docs.select(F.col(ids).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    n = 2 * partitions(docs.sparkSession)
    return stored(rows.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
                  .mapInArrow(encode, "part int, doc_id long, before long, n long, width int, tokens binary"))


def pack(docs: DataFrame, text: str = "text", ids: str = "doc_id", tokenizer=byte_bpe_path, window: int = WINDOW,
         separator: int = SEPARATOR, with_tokens: bool = False) -> DataFrame:
    """One row per piece (PIECES): where each stretch of a document's ids lies in the windows.

    Every window but the last is full. ``with_tokens`` adds the ids themselves (array of int) as ``tokens``.
    """
    table = tokenized(docs, text, ids, tokenizer, separator)
    totals = table.groupBy("part").agg(F.sum("n").alias("total")).collect()  # one number a partition
    offset, base = 0, {}
    for part, total in sorted(totals):
        base[part], offset = offset, offset + total

    def cut(batches):
        for batch in batches:
            part, doc, before, n, width, blobs = (c.to_pylist() for c in batch.columns)
            rows = []
            for i in range(len(doc)):
                place, done, kind = base[part[i]] + before[i], 0, f"<u{width[i]}"
                tokens = np.frombuffer(blobs[i], kind).astype("<u4")
                while done < n[i]:
                    length = min(n[i] - done, window - (place + done) % window)
                    piece = tokens[done:done + length]
                    rows.append((doc[i], done, length, zlib.crc32(piece.tobytes()), n[i], (place + done) // window,
                                 (place + done) % window, *([piece.astype(np.int32)] * with_tokens)))
                    done += length
            if rows:
                columns = list(zip(*rows))
                kinds = [pa.int64()] * 7 + [pa.list_(pa.int32())] * with_tokens
                names = [x.split()[0] for x in PIECES.split(", ")] + ["tokens"] * with_tokens
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return table.mapInArrow(cut, PIECES + ", tokens array<int>" * with_tokens)
