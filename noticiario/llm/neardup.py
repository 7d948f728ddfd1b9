"""Problem 2: near-duplicate records with small edits.

A token-group matrix over word sets. Equal sets are one class first. Every pair of classes at the threshold
has a word among the rarest few of both (prefix filter; the order of rarity only decides how fast it goes),
so candidates meet at such a word (at two such words where one has too many postings). There, the documents of the smaller side are partitioned into groups of
similar ones (in size, in the place the word has among their rarest, and in a min-hash), each group keeps the
union of its members' words as a row of hashed bits, and a query opens a group only if its overlap with the
union, and the words that both have behind the shared one, can still reach the threshold. Members of opened groups must pass
the same bound with their own bits. What is left is compared word by word. All bounds are upper bounds: no
pair at the threshold is lost.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions.words import ascii_words
from noticiario.operators.skew import HOT_ROWS, skew_join
from noticiario.session import Scratch

THRESHOLD = 0.7
#: Words in at least 1 / COMMON of the classes are ordered by frequency, rarer ones by hash; so at most COMMON * (mean words) are broadcast.
COMMON = 2000
#: Documents in a group of the matrix: few, so that the union of their words leaves most of the hashed bits free.
GROUP = 4
#: A word with more postings meets together with a second word; a pair of words with more is split into blocks, each for a task of its own.
POSTINGS = 20_000
_PAIRS = 1_500_000
#: Rows of one class in a part that meets the parts of its partners by itself.
COPIES = 1000
_BITS = 4  # 64-bit words of a row of hashed bits


def word_sets(df: DataFrame, row: str, texts: list[str]) -> DataFrame:
    """(row_id, clase, n, tokens): the distinct words of the texts together, hashed, and a digest of the set. Rows without any word are left out."""

    def sets(batches):
        memo: dict[bytes, int] = {}
        for batch in batches:
            ids, keys, sizes, tokens = [], [], [], []
            columns = [batch.column(k).to_pylist() for k in range(1, batch.num_columns)]
            for i, *parts in zip(batch.column(0).to_pylist(), *columns):
                words = sorted({w for p in parts for w in ascii_words(p)})
                if not words:
                    continue
                if len(memo) > 1_000_000:
                    memo.clear()
                for w in words:
                    if w not in memo:
                        memo[w] = xxhash.xxh64_intdigest(w) - (1 << 63)
                ids.append(i)
                keys.append(hashlib.blake2b(b" ".join(words), digest_size=16).hexdigest())
                sizes.append(len(words))
                tokens.append(sorted(memo[w] for w in words))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(sizes, pa.int32()), pa.array(tokens, pa.list_(pa.int64()))], ["row_id", "clase", "n", "tokens"])

    return df.select(F.col(row).cast("bigint").alias("row_id"), *[F.col(t).alias(f"_t{k}") for k, t in enumerate(texts)]).mapInArrow(sets, "row_id bigint, clase string, n int, tokens array<bigint>")


def _second(token: np.ndarray, other: np.ndarray) -> np.ndarray:
    """One 64-bit key of two words."""
    with np.errstate(over="ignore"):
        h = token.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + other.astype(np.uint64)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(32))).astype(np.int64)


def _prefixes(common: np.ndarray, ranks: np.ndarray, t: float, hot: np.ndarray | None = None):
    """Postings of a batch of classes: a row for each of the rarest words that a partner may share.

    With ``hot``, for these words only, and each together with every later word that a partner whose first
    shared word it is may share next: two different classes at the threshold have at least two words in common,
    the second one within a prefix that is longer by one.
    """

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            ids, n = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            flat = batch.column(2).flatten().to_numpy()
            doc = np.repeat(np.arange(m), n)
            u = (flat.astype(np.uint64) ^ np.uint64(1 << 63)) if flat.dtype != np.uint64 else flat
            at = np.minimum(np.searchsorted(common, flat), max(0, len(common) - 1))
            known = common[at] == flat if len(common) else np.zeros(len(flat), bool)
            key = np.where(known, np.uint64(1 << 63) + (ranks[at] if len(common) else np.uint64(0)).astype(np.uint64), u >> np.uint64(1))
            order = np.lexsort((key, doc))
            first = np.concatenate(([0], np.cumsum(n)[:-1]))
            bits = [np.bitwise_or.reduceat(np.where((u >> np.uint64(6)) & np.uint64(_BITS - 1) == np.uint64(k), np.uint64(1) << (u & np.uint64(63)), np.uint64(0)), first) for k in range(_BITS)]
            mixed = (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            low = np.minimum.reduceat(mixed, first)
            probe = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
            index = n - np.ceil(2 * t / (1 + t) * n - 1e-9).astype(np.int64) + 1
            place = np.arange(len(flat)) - np.repeat(first, n)  # within its document, rarest first
            words = flat[order]
            if hot is None:
                at = np.flatnonzero(place < probe[doc])
                d, token, spot, indexed = doc[at], words[at], place[at], place[at] < index[doc[at]]
            else:
                one = np.flatnonzero((place < probe[doc]) & np.isin(words, hot))
                more = np.maximum(np.minimum(probe[doc[one]] + 1, n[doc[one]]) - place[one] - 1, 0)  # words behind it in the longer prefix
                one = np.repeat(one, more)
                two = one + 1 + np.arange(len(one)) - np.repeat(np.cumsum(more) - more, more)
                d, token, spot = doc[one], _second(words[one], words[two]), place[two] - 1
                indexed = (place[one] < index[d]) & (place[two] < index[d] + 1)
            arrays = [token, ids[d], n[d].astype(np.int32), spot.astype(np.int32), indexed, low[d].view(np.int64), *[b[d].view(np.int64) for b in bits]]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["token", "id", "n", "puesto", "en_indice", "minimo", *[f"b{k}" for k in range(_BITS)]])

    return run


def _ranges(first: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(which, member) of the ranges [first, first + count), some million at a time."""
    ends = np.cumsum(count)
    lo = 0
    while lo < len(count):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + _PAIRS, side="right")))
        c = count[lo:hi]
        which = np.repeat(np.arange(lo, hi), c)
        yield which, np.repeat(first[lo:hi], c) + np.arange(len(which)) - np.repeat(np.cumsum(c) - c, c)
        lo = hi


def _candidates(t: float):
    """Pairs of classes that pass the matrix's bounds, from postings sorted by word and block."""

    share = t / (1 + t)

    def of(key: np.ndarray, ids: np.ndarray, n: np.ndarray, place: np.ndarray, indexed: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
        begin = np.concatenate(([0], np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1))
        segment = np.repeat(np.arange(len(begin)), np.diff(np.concatenate((begin, [len(ids)]))))
        rows = np.flatnonzero(indexed)  # sorted by word and block, then size, place and min-hash
        if not len(rows):
            return
        spot = (segment[rows] << 32) | n[rows]
        # what is left for a partner: an index row y fits queries x with share * n_x <= (1 - share) * n_y - place_y
        reach = (1 - share) * n[rows] - place[rows]
        # the matrix's groups: up to GROUP rows of one word and block, in order
        heads = np.concatenate(([True], segment[rows][1:] != segment[rows][:-1]))
        number = np.arange(len(rows))
        start = np.flatnonzero((number - np.maximum.accumulate(np.where(heads, number, 0))) % GROUP == 0)
        size = np.diff(np.concatenate((start, [len(rows)])))
        group = np.repeat(np.arange(len(start)), size)
        union = [np.bitwise_or.reduceat(b[rows], start) for b in bits]
        least, far = np.minimum.reduceat(n[rows], start), np.maximum.reduceat(reach, start)
        # a query's partners: sizes from t * n_x to n_x, and no more than its own place leaves
        upper = np.minimum(n, np.floor((n - place) / share - n + 1e-9).astype(np.int64))
        lower = np.ceil(t * n - 1e-9).astype(np.int64)
        first = np.searchsorted(spot, (segment << 32) | lower)
        last = np.searchsorted(spot, (segment << 32) | np.maximum(upper, 0), side="right")
        queries = np.flatnonzero((upper >= lower) & (last > first))
        g0, g1 = group[first[queries]], group[last[queries] - 1] + 1
        for k, g in _ranges(g0, g1 - g0):
            p = queries[k]
            ok = far[g] >= share * n[p] - 1e-9
            p, g = p[ok], g[ok]
            room = n[p] - np.ceil(share * (n[p] + np.maximum(least[g], lower[p])) - 1e-9).astype(np.int64)
            missing = np.bitwise_count(bits[0][p] & ~union[0][g]).astype(np.int16)
            for b, u in zip(bits[1:], union[1:]):
                missing += np.bitwise_count(b[p] & ~u[g])
            ok = missing <= room
            p, g = p[ok], g[ok]
            for w, r in _ranges(start[g], size[g]):
                x, y = p[w], rows[r]
                ok = (n[y] >= lower[x]) & ((n[y] < n[x]) | ((n[y] == n[x]) & (ids[y] < ids[x])))
                x, y = x[ok], y[ok]
                both = n[x] + n[y]
                need = np.ceil(share * both - 1e-9).astype(np.int64)
                differ = sum(np.bitwise_count(b[x] ^ b[y]).astype(np.int16) for b in bits)
                ok = (differ <= both - 2 * need) & (need <= n[y] - place[y]) & (need <= n[x] - place[x])
                a, b = np.minimum(ids[x[ok]], ids[y[ok]]), np.maximum(ids[x[ok]], ids[y[ok]])
                if len(a):
                    pairs = np.unique(np.stack((a, b)), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

    def run(batches):
        held: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            c = {f: batch.column(i).to_numpy(zero_copy_only=False) for i, f in enumerate(batch.schema.names)}
            part = (np.stack((c["token"], c["bloque"].astype(np.int64)), axis=1), c["id"], c["n"].astype(np.int64), c["puesto"].astype(np.int64), c["en_indice"], np.stack([c[f"b{k}"].view(np.uint64) for k in range(_BITS)]))
            held.append(part)
            last = part[0][-1]
            if not np.array_equal(held[0][0][0], last):  # the last key may go on in the next batch
                key, ids, n, place, indexed, bits = _joined(held)
                cut = int(np.flatnonzero(np.any(key != last, axis=1))[-1]) + 1
                yield from of(key[:cut], ids[:cut], n[:cut], place[:cut], indexed[:cut], bits[:, :cut])
                held = [(key[cut:], ids[cut:], n[cut:], place[cut:], indexed[cut:], bits[:, cut:])]
        if held:
            yield from of(*_joined(held))

    return run


def _joined(held: list[tuple]) -> tuple:
    return tuple(np.concatenate(x, axis=1 if k == 5 else 0) for k, x in enumerate(zip(*held))) if len(held) > 1 else held[0]


def classes(sets: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(id, n, tokens, copias) of each distinct word set, id being its smallest row; and how many there are."""
    heads = sets.groupBy("clase").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("copias"))
    reps, seen = scratch.save(sets.join(heads.select("row_id", "copias"), "row_id").select(F.col("row_id").alias("id"), "n", "tokens", "copias", "clase"))
    return reps, seen["rows"]


def _blocks(postings: DataFrame, floor: int) -> DataFrame:
    """``postings`` with ``bloque``: index rows of a key with more than ``floor`` postings are cut into blocks, which its queries all visit."""
    counts = {r[0]: r[1] for r in postings.groupBy("token").count().where(F.col("count") > floor).collect()}  # at most rows / floor keys
    if not counts:
        return postings.withColumn("bloque", F.lit(0))
    blocks = F.broadcast(postings.sparkSession.createDataFrame([(k, -(-v // floor)) for k, v in counts.items()], "token bigint, _blocks int"))
    wide = postings.join(blocks, "token", "left")
    own = F.pmod(F.xxhash64("id"), F.coalesce("_blocks", F.lit(1))).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.coalesce("_blocks", F.lit(1)) - 1))
    return wide.withColumn("bloque", every).withColumn("en_indice", F.col("en_indice") & (F.col("bloque") == own)).drop("_blocks")


def links(reps: DataFrame, count: int, scratch: Scratch, threshold: float = THRESHOLD, most: int | None = None) -> DataFrame:
    """(a, b), a < b: all pairs of classes whose words have a Jaccard similarity of at least ``threshold``.

    ``most``: postings from which a word is hot; by default ``POSTINGS``, or a thousandth of all. ``threshold``
    is above 0.5, so that different classes share at least two words.
    """
    if not 0.5 < threshold <= 1:
        raise ValueError(threshold)
    spark = reps.sparkSession
    often = reps.select(F.explode("tokens").alias("token")).groupBy("token").count().where(F.col("count") >= max(2, math.ceil(count / COMMON)))
    rows = sorted((r[0], r[1]) for r in often.collect())  # at most COMMON * mean words
    common = np.array([r[0] for r in rows], np.int64)
    ranks = np.zeros(len(rows), np.uint64)
    ranks[np.lexsort((common, [r[1] for r in rows]))] = np.arange(len(rows), dtype=np.uint64)
    schema = "token bigint, id bigint, n int, puesto int, en_indice boolean, minimo bigint, " + ", ".join(f"b{k} bigint" for k in range(_BITS))
    shared = spark.sparkContext.broadcast((common, ranks))
    sets = reps.select("id", "n", "tokens")
    postings, seen = scratch.save(sets.mapInArrow(lambda it: _prefixes(*shared.value, threshold)(it), schema))
    floor = most or max(POSTINGS, seen["rows"] // 1000)
    hot = np.array(sorted(r[0] for r in postings.groupBy("token").count().where(F.col("count") > floor).select("token").collect()), np.int64)  # at most rows / floor words
    parts = [postings]
    if len(hot):
        # a hot word meets together with a second one: each class gives a posting for each word of its prefix, however many classes share the hot one
        few = F.broadcast(spark.createDataFrame([(int(h),) for h in hot], "token bigint"))
        parts = [postings.join(few, "token", "left_anti"), scratch.save(sets.mapInArrow(lambda it: _prefixes(*shared.value, threshold, hot)(it), schema))[0]]
    split = None
    for part in parts:
        placed = _blocks(part, floor)
        split = placed if split is None else split.unionByName(placed)
    placed = split.repartition("token", "bloque").sortWithinPartitions("token", "bloque", "n", "puesto", "minimo", "id")
    near = placed.select("token", "bloque", "id", "n", "puesto", "en_indice", *[f"b{k}" for k in range(_BITS)]).mapInArrow(lambda it: _candidates(threshold)(it), "a bigint, b bigint")
    pairs = near.distinct()
    left, right = (reps.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("tokens").alias(f"t{x}")) for x in "ab")
    both = pairs.join(left, "a").join(right, "b")
    common_words = F.size(F.array_intersect("ta", "tb"))
    exact = both.where(common_words >= threshold * (F.col("na") + F.col("nb") - common_words) - 1e-9)
    found, _ = scratch.save(exact.select("a", "b"))
    scratch.drop(postings, *parts)
    return found


def near_pairs(df: DataFrame, row: str = "row_id", texts: tuple[str, ...] = ("titulo", "resumen_aclaracion"), threshold: float = THRESHOLD) -> DataFrame:
    """(row_id_a, row_id_b), smaller first: every pair of rows at the threshold, those with equal words included.

    The result has all pairs among copies, as asked for; :func:`near_classes` is the form that stays
    linear in the rows. Rows without any word are in no pair.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    sets, _ = scratch.save(word_sets(df, row, list(texts)))
    reps, count = classes(sets, scratch)
    found = links(reps, count, scratch, threshold)
    member = skew_join(sets.select("row_id", "clase"), reps.where("copias >= 2").select("clase", F.col("id")), ["clase"], hot=None).select("id", "row_id")
    member = member.unionByName(reps.where("copias = 1").select("id", F.col("id").alias("row_id")))
    member, _ = scratch.save(member)
    # the rows of a class are cut into parts of some COPIES by hash; every two parts meet by themselves
    sized, _ = scratch.save(skew_join(member, reps.select("id", F.ceil(F.col("copias") / COPIES).cast("int").alias("_c")), ["id"]).withColumn("_p", F.pmod(F.xxhash64("row_id"), F.col("_c")).cast("int")))
    own = sized.join(reps.where("copias >= 2").select("id"), "id", "left_semi")
    own = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).select("id", "row_id", "_p", F.least("_p", "_o").alias("_x"), F.greatest("_p", "_o").alias("_y"))
    x, y = (own.where(F.col("_p") == F.col(c)).select("id", "_x", "_y", F.col("row_id").alias(name)) for c, name in (("_x", "x"), ("_y", "y")))
    equal = x.join(y, ["id", "_x", "_y"]).where("_x < _y or x < y")
    ends = [reps.select(F.col("id").alias(e), F.sequence(F.lit(0), F.ceil(F.col("copias") / COPIES).cast("int") - 1).alias(f"_l{e}")) for e in "ab"]
    few = None if found.count() >= HOT_ROWS else []
    parted = skew_join(skew_join(found, ends[0], ["a"], hot=few), ends[1], ["b"], hot=few).withColumn("_pa", F.explode("_la")).select("a", "b", "_pa", F.explode("_lb").alias("_pb"))
    across = parted.join(sized.select(F.col("id").alias("a"), F.col("_p").alias("_pa"), F.col("row_id").alias("x")), ["a", "_pa"]).join(sized.select(F.col("id").alias("b"), F.col("_p").alias("_pb"), F.col("row_id").alias("y")), ["b", "_pb"])
    out = equal.select("x", "y").unionByName(across.select("x", "y"))
    return out.select(F.least("x", "y").alias("row_id_a"), F.greatest("x", "y").alias("row_id_b"))


def near_classes(df: DataFrame, row: str = "row_id", texts: tuple[str, ...] = ("titulo", "resumen_aclaracion"), threshold: float = THRESHOLD) -> DataFrame:
    """(row_id, clase, enlaces): for every row its class (the smallest row with equal words) and to how many other classes that is linked.

    A row without any word is its own class without links.
    """
    scratch = Scratch(df.sparkSession, "neardup")
    sets, _ = scratch.save(word_sets(df, row, list(texts)))
    reps, count = classes(sets, scratch)
    found = links(reps, count, scratch, threshold)
    degree = found.select(F.col("a").alias("id")).unionAll(found.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("enlaces"))
    table, _ = scratch.save(reps.join(degree, "id", "left").select("clase", "id", F.coalesce("enlaces", F.lit(0)).alias("enlaces")))
    known = skew_join(sets.select("row_id", "clase"), table, ["clase"]).select("row_id", F.col("id").alias("clase"), "enlaces")
    wordless = df.select(F.col(row).cast("bigint").alias("row_id")).join(sets.select("row_id"), "row_id", "left_anti")
    return known.unionByName(wordless.select("row_id", F.col("row_id").alias("clase"), F.lit(0).cast("bigint").alias("enlaces")))
