"""Problem 6: filling fixed-capacity containers with items.

How many items there are of each size is all that packing needs, and sizes are at most the capacity: so
the driver packs a histogram of at most ``capacity`` rows, however many documents there are, and the
documents get their containers in a distributed join.

First Martello and Toth's reduction: a set of at most three items that dominates every other set with its
largest item is fixed (there is an optimal packing that has it), for as many copies as there are, again and
again until nothing dominates. Then best fit in decreasing order over the remainder. Containers in the same
state are kept as ranges, so a step places a whole range; the plan has a row for each step.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from noticiario.llm.tokens import VOCABULARY, counter
from noticiario.session import Scratch

CAPACITY = 2048
#: Items of one size are matched with the plan in blocks of so many.
BLOCK = 4096
#: Items that one task numbers, on average.
RANKED = 500_000


class Plan:
    """Steps (size, first rank, items, first container, items a container); containers are numbered from 1."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {s: n for s, n in histogram.items() if n > 0 and 0 < s <= capacity}
        self.used = dict.fromkeys(self.left, 0)
        self.sizes = sorted(self.left)
        self.steps: list[tuple[int, int, int, int, int]] = []
        self.containers = 0
        self.fixed = 0
        while self._reduce():
            pass
        self.fixed = self.containers
        self._best_fit()
        zeros = histogram.get(0, 0)
        if zeros:
            self.containers = max(1, self.containers)
            self.steps.append((0, 0, zeros, 1, zeros))

    def _take(self, size: int, n: int, container: int, each: int = 1) -> None:
        self.steps.append((size, self.used[size], n, container, each))
        self.used[size] += n
        self.left[size] -= n
        if not self.left[size]:
            del self.left[size]
            self.sizes.pop(bisect_left(self.sizes, size))

    def _fix(self, items: list[int]) -> None:
        """As many containers with exactly these items as there are copies of them."""
        need = {s: items.count(s) for s in items}
        n = min(self.left[s] // k for s, k in need.items())
        for s, k in need.items():
            self._take(s, n * k, self.containers + 1, k)
        self.containers += n

    def _smallest(self, without: int, k: int) -> list[int]:
        out: list[int] = []
        for s in self.sizes:
            n = self.left[s] - (s == without)
            out += [s] * min(n, k - len(out))
            if len(out) == k:
                break
        return out

    def _largest(self, most: int, *without: int) -> int:
        """The largest size up to ``most`` of which a copy is left beside ``without``; 0 if none."""
        i = bisect_right(self.sizes, most) - 1
        while i >= 0 and self.left[self.sizes[i]] <= without.count(self.sizes[i]):
            i -= 1
        return self.sizes[i] if i >= 0 else 0

    def _dominating(self, j: int) -> list[int] | None:
        room = self.capacity - j
        small = self._smallest(j, 3)
        if not small or small[0] > room:
            return [j]
        star = self._largest(room, j)
        if star == room or len(small) < 2 or small[0] + small[1] > room:
            return [j, star]
        if len(small) == 3 and sum(small) <= room:
            return None  # four items fit together: the criterion looks at no more than three
        pairs = []
        for x in reversed(self.sizes[: bisect_right(self.sizes, room)]):
            if self.left[x] <= (x == j):
                continue
            y = self._largest(min(x, room - x), j, x)
            if y:
                pairs.append((x, y))
        top = max(x + y for x, y in pairs)
        if star >= top:
            return [j, star]
        a, b = max(p for p in pairs if sum(p) == top)
        if a == star and all(y <= b or x + y <= a for x, y in pairs):
            return [j, a, b]
        return None

    def _reduce(self) -> bool:
        """One pass from the largest size down; whether it fixed anything. Fixing leaves a set dominant for the copies that remain."""
        found = False
        for j in reversed(list(self.sizes)):
            while self.left.get(j):
                items = self._dominating(j)
                if not items:
                    break
                if len(items) == 2 and items[0] == items[1] and self.left[j] < 2:
                    break
                self._fix(items)
                found = True
        return found

    def _best_fit(self) -> None:
        open_: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first container, how many)
        rooms: list[int] = []

        def put(room: int, first: int, n: int) -> None:
            if room and n:
                if room not in open_:
                    open_[room] = []
                    insort(rooms, room)
                open_[room].append((first, n))

        for size in sorted(self.sizes, reverse=True):
            while n := self.left.get(size, 0):
                i = bisect_left(rooms, size)
                if i == len(rooms):
                    each = min(self.capacity // size, n)
                    first, many, room = self.containers + 1, n // each, self.capacity
                    self.containers += many
                else:
                    room = rooms[i]
                    first, many = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(i)
                    each = min(room // size, n)
                    full = min(many, n // each)
                    put(room, first + full, many - full)
                    many = full
                self._take(size, each * many, first, each)
                put(room - each * size, first, many)


def token_counts(docs: DataFrame, doc: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document; null and empty texts have 0."""

    def count(batches):
        c = counter(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c.count(t) for t in batch.column(1).to_pylist()], pa.int64())], ["doc_id", "n_tokens"])

    return docs.select(F.col(doc).cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(count, "doc_id bigint, n_tokens bigint")


def pack(docs: DataFrame, doc: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, pieza, desde, n_tokens, contenedor): a container for every text.

    A text within the capacity is one item (``pieza`` 0). A longer one is cut into items of exactly the
    capacity and one of what remains; ``desde`` is the item's first token. Texts without tokens, null
    ones too, lie in container 1. Equal rows are items of their own.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    sizes, _ = scratch.save(token_counts(docs, doc, text, vocabulary))
    parts = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / capacity)).cast("int")
    items = sizes.select("doc_id", F.col("n_tokens").alias("_all"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("pieza"))
    items = items.select("doc_id", "pieza", (F.col("pieza").cast("bigint") * capacity).alias("desde"), F.least(F.lit(capacity).cast("bigint"), F.col("_all") - F.col("pieza").cast("bigint") * capacity).alias("n_tokens"))
    histogram = {r[0]: r[1] for r in items.groupBy("n_tokens").count().collect()}  # at most capacity + 1 rows
    total = sum(histogram.values())
    plan = Plan(histogram, capacity)
    steps = spark.createDataFrame(plan.steps or [(0, 0, 0, 0, 1)], "n_tokens bigint, _first bigint, _n bigint, _container bigint, _each bigint").where("_n > 0")
    blocks = F.sequence(F.floor(F.col("_first") / BLOCK), F.floor((F.col("_first") + F.col("_n") - 1) / BLOCK))
    steps = steps.withColumn("_block", F.explode(blocks)).withColumnRenamed("n_tokens", "_size")
    # ranks within a size, numbered in salted parts so that a size with a third of all items isn't one task's
    salts = max(1, -(-total // RANKED))
    salted = items.withColumn("_salt", F.pmod(F.xxhash64("doc_id", "pieza"), F.lit(salts)))
    before = Window.partitionBy("n_tokens").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    offsets = salted.groupBy("n_tokens", "_salt").count().select("n_tokens", "_salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    ranked = salted.withColumn("_k", F.row_number().over(Window.partitionBy("n_tokens", "_salt").orderBy("doc_id", "pieza")) - 1)
    ranked = ranked.join(offsets, ["n_tokens", "_salt"]).withColumn("_rank", F.col("_k") + F.col("_offset")).withColumn("_b", F.floor(F.col("_rank") / BLOCK))
    within = (F.col("_rank") >= F.col("_first")) & (F.col("_rank") < F.col("_first") + F.col("_n"))
    joined = ranked.join(steps, (F.col("n_tokens") == F.col("_size")) & (F.col("_b") == F.col("_block")) & within)
    container = F.col("_container") + F.floor((F.col("_rank") - F.col("_first")) / F.col("_each"))
    return joined.select("doc_id", "pieza", "desde", "n_tokens", container.cast("bigint").alias("contenedor"))
