"""Problem 8: splitting oversized items at natural boundaries.

Recursive bisection: a text over the limit is cut at the strongest boundary near its middle (paragraph,
line, sentence, clause, space; inside a word only where there is nothing else), halves that still exceed
the limit minus the overlap are cut again, and then every piece but the first gets the tokens before it as
overlap. A text is one row and its pieces are made where it lies: a narrow pass without any shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.llm.tokens import VOCABULARY, Counter, counter

LIMIT, OVERLAP = 512, 64
#: A boundary counts as near the middle within this share of the part's tokens to either side.
NEAR = 0.25
#: A mark after which a text may pause, with closing quotes and the white space behind it.
_MARK = re.compile(r"[.!?…,;:—\n\r][\"'»”’)\]]*\s*")
#: Strengths: blank line, line end, end of a sentence, clause, any white space; 0 inside a word.
PARAGRAPH, LINE, SENTENCE, CLAUSE, SPACE = 5, 4, 3, 2, 1
SCHEMA = "doc_id bigint, pieza int, inicio int, fin int, nucleo int, n_tokens int, texto string"


def _atoms(text: str, c: Counter, limit: int) -> tuple[np.ndarray, np.ndarray, bool]:
    """Starts of the atoms (one more: the end) and tokens before each; whether chunks had to be cut into atoms."""
    chunks = c.chunks(text)
    counts = c.counts(chunks)
    most = max(1, limit // 8)
    cut = max(counts) > most
    if cut:
        lengths: list[int] = []
        tokens: list[int] = []
        for chunk, n in zip(chunks, counts):
            if n <= most:
                lengths.append(len(chunk))
                tokens.append(n)
                continue
            raw, sizes, done, k = chunk.encode("utf-8", "surrogatepass"), c.lengths(chunk), 0, 0
            start = 0
            for size in sizes:
                done += size
                k += 1
                if (k >= most // 2 or k >= 1 and most == 1) and (done == len(raw) or raw[done] & 0xC0 != 0x80):
                    lengths.append(len(raw[start:done].decode("utf-8", "surrogatepass")))
                    tokens.append(k)
                    start, k = done, 0
            if start < len(raw):
                lengths.append(len(raw[start:].decode("utf-8", "surrogatepass")))
                tokens.append(k)
    else:
        lengths, tokens = list(map(len, chunks)), counts
    return np.concatenate(([0], np.cumsum(lengths))), np.concatenate(([0], np.cumsum(tokens))), cut


def _strengths(text: str, starts: np.ndarray, cut: bool) -> np.ndarray:
    """Strength of the cut before each atom. Chunks meet at white space; only atoms of cut chunks may meet elsewhere."""
    out = np.full(len(starts), SPACE, np.int8)
    if cut:
        inner = starts[1:-1].tolist()
        out[1:-1] = np.fromiter((text[s].isspace() or text[s - 1].isspace() for s in inner), bool, len(inner))
    lo, hi, strength = [], [], []
    for m in _MARK.finditer(text):
        mark = m.group()
        if "\n" in mark or "\r" in mark:
            lines = mark.count("\n") or mark.count("\r")
            strength.append(PARAGRAPH if lines > 1 else LINE)
        elif len(mark) == 1 or not mark[-1].isspace():
            continue
        else:
            strength.append(SENTENCE if mark[0] in ".!?…" else CLAUSE)
        lo.append(m.start() + 1 if mark[0] not in "\n\r" else m.start())
        hi.append(m.end())
    if hi:
        ends, begins = np.array(hi), np.array(lo)
        at = np.searchsorted(starts, ends, side="right") - 1
        ok = (starts[at] >= begins) & (at > 0) & (at < len(starts) - 1)
        np.maximum.at(out, at[ok], np.array(strength, np.int8)[ok])
    return out


def _tokens(text: str, c: Counter, starts: np.ndarray, before: np.ndarray, start: int, hi: int, cut: bool) -> int:
    """Tokens of the text from character ``start`` to atom ``hi``.

    Whole chunks between white space count what they counted before; only a chunk that is cut, and white
    space at the end, which may now hold together, are counted again.
    """
    end = int(starts[hi])
    if cut:
        return c.count(text[start:end])
    j = int(np.searchsorted(starts, start))
    head = text[start : starts[j]]
    if head and head[-1].isspace():
        return c.count(text[start:end])
    k = hi
    while k > j and text[starts[k] - 1].isspace():
        k -= 1
    return c.count(head) + int(before[k] - before[j]) + (c.count(text[starts[k] : end]) if k < hi else 0)


def split(text: str | None, c: Counter, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int, int, int]]:
    """(start, end, core start, tokens) of each piece, in characters of the text.

    Cores lie side by side and cover the text; a piece is its core after the ``overlap`` tokens before it
    (fewer only where the text has no more, or where a token boundary lies inside a character). A text
    within the limit, and the empty text, is one piece; None is one empty piece.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    if not text:
        return [(0, 0, 0, 0)]
    if len(text.encode("utf-8", "surrogatepass")) <= limit:  # a token has a byte at least
        return [(0, len(text), 0, c.count(text))]
    starts, before, cut = _atoms(text, c, limit)
    total = int(before[-1])
    if total <= limit:
        return [(0, len(text), 0, c.count(text) if cut else total)]
    strength = _strengths(text, starts, cut)
    cores: list[tuple[int, int]] = []
    todo = [(0, len(starts) - 1)]
    budget = limit - overlap
    while todo:
        lo, hi = todo.pop()
        tokens = int(before[hi] - before[lo])
        if tokens <= budget or hi - lo == 1:
            cores.append((lo, hi))
            continue
        middle = (before[lo] + before[hi]) / 2
        a = max(lo + 1, int(np.searchsorted(before, middle - NEAR * tokens)))
        b = min(hi, int(np.searchsorted(before, middle + NEAR * tokens, side="right")))
        if a >= b:
            a, b = lo + 1, hi
        s = strength[a:b]
        best = a + np.flatnonzero(s == s.max())
        at = int(best[np.argmin(np.abs(before[best] - middle))])
        todo += [(at, hi), (lo, at)]
    out = []
    for lo, hi in cores:
        core, end = int(starts[lo]), int(starts[hi])
        start = _overlap_start(text, c, starts, before, lo, overlap) if lo else 0
        tokens = _tokens(text, c, starts, before, start, hi, cut)
        while tokens > limit and start < core:  # a cut token may need more tokens than it had
            start += 1
            tokens = c.count(text[start:end])
        out.append((start, end, core, tokens))
    return out


def _overlap_start(text: str, c: Counter, starts: np.ndarray, before: np.ndarray, lo: int, overlap: int) -> int:
    """Where the ``overlap`` tokens before atom ``lo`` begin."""
    target = int(before[lo]) - overlap
    if target <= 0:
        return 0
    j = int(np.searchsorted(before, target, side="right")) - 1
    inside = target - int(before[j])
    if not inside:
        return int(starts[j])
    atom = text[starts[j] : starts[j + 1]]
    raw, done = atom.encode("utf-8", "surrogatepass"), 0
    for k, size in enumerate(c.lengths(atom), 1):
        done += size
        if k >= inside and (done == len(raw) or raw[done] & 0xC0 != 0x80):
            return int(starts[j]) + len(raw[:done].decode("utf-8", "surrogatepass"))
    return int(starts[j + 1])


def pieces(docs: DataFrame, doc: str = "doc_id", text: str = "text", limit: int = LIMIT, overlap: int = OVERLAP, vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each piece, in order: (doc_id, pieza, inicio, fin, nucleo, n_tokens, texto).

    ``texto`` is the text from character ``inicio`` to ``fin``; from ``nucleo`` on it is the piece's own,
    before that the overlap. Joining the own parts gives the text back.
    """

    def cut(batches):
        c = counter(vocabulary)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, (start, end, core, n) in enumerate(split(t, c, limit, overlap)):
                    rows.append((i, k, start, end, core, n, (t or "")[start:end]))
                    size += end - start
                if size > 4_000_000:
                    yield _batch(rows)
                    rows, size = [], 0
            if rows:
                yield _batch(rows)

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), kinds)], ["doc_id", "pieza", "inicio", "fin", "nucleo", "n_tokens", "texto"])
