"""Problem 7: evaluation texts leaking into training text.

A broadcast hash set of the normalised n-grams of all evaluation items; workers scan the token windows
of every document against it, verify each hit word by word, and report the pairs or remove the spans or
the documents. One narrow pass over the documents: nothing is shuffled.

A set is broadcast only for at most ``MOST_CHARS`` characters of items' text; more items are cut into chunks of
that size, each scanned for in a pass of its own, by the same code and with the same result.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions.words import TAG, ascii_of, ascii_words
from noticiario.operators.skew import skew_join
from noticiario.session import Scratch

WORDS = 12
#: Characters of items in a broadcast set (twice so many at most). It takes some 60 bytes a character, in each Python worker.
MOST_CHARS = 2_000_000
_STEP_CHARS = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: What html.unescape takes for a character reference.
_REFERENCE = re.compile(r"&(#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)")


def _roll(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n ids."""
    m = len(ids) - n + 1
    h = np.zeros(m, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(29))) * _BASE + ids[k : k + m]
    return h ^ (h >> np.uint64(32))


class Grams:
    """Every window of ``n`` words of the evaluation items."""

    def __init__(self, items: list[tuple[int, str | None]], n: int):
        self.n = n
        self.words: dict[bytes, int] = {}
        self.items: dict[bytes, set[int]] = {}
        hashes = []
        for item, text in items:
            words = ascii_words(text)
            if len(words) < n:
                continue
            ids = np.array([self.words.setdefault(w, len(self.words) + 1) for w in words], np.uint64)
            hashes.append(_roll(ids, n))
            for i in range(len(ids) - n + 1):
                self.items.setdefault(ids[i : i + n].tobytes(), set()).add(item)
        found = np.unique(np.concatenate(hashes)) if hashes else np.zeros(0, np.uint64)
        self.bits = max(16, int(len(found) * 64).bit_length())
        self.table = np.zeros(1 << self.bits, bool)
        self.table[(found & np.uint64((1 << self.bits) - 1)).astype(np.int64)] = True

    def scan(self, texts: list[str | None]) -> list[tuple[int, int, set[int]]]:
        """(place in ``texts``, place of the window's first word, items) of each verified window."""
        words: list[bytes] = []
        ends = []
        for t in texts:
            words += ascii_words(t)
            words.append(b"")  # in no item's text, so no window goes from one document into the next
            ends.append(len(words))
        if len(words) < self.n or not self.items:
            return []
        ids = np.fromiter(map(self.words.get, words, repeat(0)), np.uint64, len(words))
        known = np.concatenate(([0], np.cumsum(ids != 0)))
        full = np.flatnonzero(known[self.n :] - known[: -self.n] == self.n)
        if not len(full):
            return []
        h = _roll(ids, self.n)[full]
        out = []
        starts = [0, *ends[:-1]]
        for i in full[self.table[(h & np.uint64((1 << self.bits) - 1)).astype(np.int64)]]:
            items = self.items.get(ids[i : i + self.n].tobytes())
            if items:
                doc = int(np.searchsorted(ends, i, side="right"))
                out.append((doc, int(i) - starts[doc], items))
        return out


def word_spans(text: str) -> list[tuple[int, int]]:
    """Where each of ``ascii_words(text)`` lies in the text as it was given. Slow: for documents with hits only."""
    chars, at = text, list(range(len(text) + 1))
    for _ in range(2):
        if "&" not in chars:
            break
        parts, places, last = [], [], 0
        for m in _REFERENCE.finditer(chars):
            new = html.unescape(m.group())
            parts += [chars[last : m.start()], new]
            places += at[last : m.start()] + [at[m.start()]] * len(new)
            last = m.end()
        parts.append(chars[last:])
        places += at[last:]
        chars, at = "".join(parts), places
    chars = TAG.sub(lambda m: " " * len(m.group()), chars)
    kept = [(a, p, at[k + 1]) for k, (c, p) in enumerate(zip(chars, at)) for a in (c if c.isascii() else ascii_of(c))]
    flat = "".join(a for a, _, _ in kept)
    flat = flat.lower() if flat.isascii() else "".join(a.lower() if a.isascii() else " " for a in flat)
    return [(kept[m.start()][1], kept[m.end() - 1][2]) for m in re.finditer("[a-z0-9]+", flat)]


def without_spans(text: str, windows: list[int], n: int) -> str:
    """The text without the words of the windows (given by their first words); overlapping windows are one span."""
    spans, out, last = word_spans(text), [], 0
    for i in sorted(windows):
        lo, hi = spans[i][0], spans[i + n - 1][1]
        if lo > last:
            out.append(text[last:lo])
        last = max(last, hi)
    out.append(text[last:])
    return "".join(out)


def _pieces(batch: pa.RecordBatch, text: str) -> Iterator[tuple[int, list[str | None]]]:
    """The batch's texts, some megabyte at a time."""
    texts, first, size = [], 0, 0
    for i, t in enumerate(batch.column(batch.schema.get_field_index(text)).to_pylist()):
        texts.append(t)
        size += len(t or "")
        if size > _STEP_CHARS:
            yield first, texts
            texts, first, size = [], i + 1, 0
    if texts:
        yield first, texts


#: Items longer than this (in words) are cut into overlapping pieces, so that no chunk of items is large by one of them.
PIECE = 200_000


def _item_pieces(items: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(id, text, largo): the items as normalised words; long ones in pieces that share ``n`` - 1 words, so every window is in one piece."""

    def cut(batches):
        for batch in batches:
            ids, texts = [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = ascii_words(t)
                for k in range(0, max(0, len(words) - n + 1), PIECE):
                    ids.append(i)
                    texts.append(b" ".join(words[k : k + PIECE + n - 1]).decode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], ["id", "text"])

    known = items.where(F.col(item).isNotNull())
    return known.select(F.col(item).cast("bigint").alias("id"), F.col(text).alias("text")).mapInArrow(cut, "id bigint, text string").withColumn("largo", F.length("text"))


def _chunks(items: DataFrame, item: str, text: str, n: int, most: int) -> Iterator:
    """Broadcast sets of windows, each of at most twice ``most`` characters of items (or the longest piece); together all items."""
    spark = items.sparkSession
    pieces, seen = Scratch(spark, "items").save(_item_pieces(items, item, text, n), size=F.sum("largo"), longest=F.max("largo"))
    parts = max(1, -(-(seen["size"] or 0) // max(1, most)))
    part = lambda: F.pmod(F.xxhash64("id", "text"), F.lit(parts))
    while parts > 1 and pieces.groupBy(part()).agg(F.sum("largo").alias("s")).agg(F.max("s")).first()[0] > 2 * max(most, seen["longest"]):
        parts *= 2
    for k in range(parts):
        rows = [tuple(r) for r in pieces.where(part() == k).select("id", "text").collect()]  # at most twice ``most`` characters
        yield spark.sparkContext.broadcast(Grams(rows, n))


def _found(docs: DataFrame, grams) -> DataFrame:
    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in _pieces(batch, "text"):
                pairs = sorted({(first + d, i) for d, _, items in grams.value.scan(texts) for i in items})
                if pairs:
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([p[0] for p in pairs])), pa.array([p[1] for p in pairs], pa.int64())], ["doc_id", "item_id"])

    return docs.mapInArrow(scan, "doc_id bigint, item_id bigint")


def found(docs: DataFrame, items: DataFrame, doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WORDS, most: int = MOST_CHARS) -> DataFrame:
    """(doc_id, item_id), distinct, of each document that has at least ``n`` words in a row of an item's text.

    Null and empty texts, and items of fewer than ``n`` words or without an id, are in no pair. Items of more than ``most``
    characters together are scanned for in chunks: each chunk is one more pass over the documents, with the
    same set, the same check word by word and the same result.
    """
    base = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    out = None
    for grams in _chunks(items, item, item_text, n, most):
        part = _found(base, grams)
        out = part if out is None else out.unionByName(part)
    return out.distinct()


def _windows(docs: DataFrame, grams) -> DataFrame:
    """(doc_id, huella, ventana): first words of the windows found, with a digest of the document's text."""

    def scan(batches):
        for batch in batches:
            ids = batch.column(0)
            for first, texts in _pieces(batch, "text"):
                hits = sorted({(d, i) for d, i, _ in grams.value.scan(texts)})
                if hits:
                    marks = {d: hashlib.md5(texts[d].encode("utf-8", "surrogatepass")).hexdigest() for d, _ in hits}
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + d for d, _ in hits])), pa.array([marks[d] for d, _ in hits]), pa.array([i for _, i in hits], pa.int64())], ["doc_id", "huella", "ventana"])

    return docs.mapInArrow(scan, "doc_id bigint, huella string, ventana bigint")


def scrub(docs: DataFrame, items: DataFrame, remove: str = "spans", doc: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WORDS, most: int = MOST_CHARS) -> DataFrame:
    """(doc_id, ventanas, text): the documents without the leaked spans, or (``remove='documents'``) without the documents that have any.

    ``ventanas`` counts the windows of ``n`` words found. Documents without hits keep their text as it is.
    One chunk of items is one narrow pass; of more, the windows of all chunks are gathered for each document
    (its id and text) and removed together.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(remove)
    base = docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    chunks = list(_chunks(items, item, item_text, n, most))
    if len(chunks) > 1:
        hits = _windows(base, chunks[0])
        for grams in chunks[1:]:
            hits = hits.unionByName(_windows(base, grams))
        gathered, _ = Scratch(docs.sparkSession, "windows").save(hits.distinct().groupBy("doc_id", "huella").agg(F.collect_list("ventana").alias("lista")).withColumn("doc_id", F.coalesce("doc_id", F.lit(-1))))
        keyed = base.withColumn("huella", F.md5(F.col("text").cast("binary"))).withColumn("_d", F.coalesce("doc_id", F.lit(-1)))
        joined = skew_join(keyed, gathered.withColumnRenamed("doc_id", "_d"), ["_d", "huella"], how="left").select("doc_id", "text", "lista")
    else:
        joined = base
    one = chunks[0] if len(chunks) == 1 else None

    def clean(batches):
        for batch in batches:
            ids = batch.column(0)
            known = None if one else batch.column(2).to_pylist()
            for first, texts in _pieces(batch, "text"):
                hits: dict[int, list[int]] = {}
                if known is None:
                    for d, i, _ in one.value.scan(texts):
                        hits.setdefault(d, []).append(i)
                else:
                    hits = {k: known[first + k] for k in range(len(texts)) if known[first + k]}
                keep = [k for k in range(len(texts)) if remove == "spans" or k not in hits]
                clear = [without_spans(texts[k], hits[k], n) if k in hits else texts[k] for k in keep]
                yield pa.RecordBatch.from_arrays([ids.take(pa.array([first + k for k in keep], pa.int64())), pa.array([len(hits.get(k, ())) for k in keep], pa.int64()), pa.array(clear, pa.string())], ["doc_id", "ventanas", "text"])

    return joined.mapInArrow(clean, "doc_id bigint, ventanas bigint, text string")
