"""Problem 3: consolidating pairwise matches into groups.

Deterministic Borůvka hooking. In each round every component selects its smallest outgoing edge (edges
are ordered by their smaller, then their larger end, so all are different), hooks itself to the edge's
other end, trees collapse by pointer doubling, and the edges are relabelled with the smallest member of
their component and deduplicated; until no edge is left. Each round at least halves the components that
still have edges, so a path of n records takes log n rounds, not n.

A component's label is always its smallest record. Each round leaves a table of the labels it merged;
these shrink with the rounds and are composed from the last one back, so the full set of records is
joined once. Joins on an end of an edge treat ends with a large share of all edges apart.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions.numeric import parse_numeric, whole_number
from noticiario.functions.text import strip
from noticiario.operators.skew import HOT_ROWS, HOT_SHARE, skew_join
from noticiario.session import Scratch


def _hot(degrees: DataFrame, edges: int, key: str) -> list[tuple]:
    """Ends of at least HOT_SHARE of all edges; the degrees add up to twice the edges, so at most 2 / HOT_SHARE."""
    floor = max(int(edges * HOT_SHARE), HOT_ROWS)
    return [tuple(r) for r in degrees.where(F.col("n") >= floor).select(key).collect()] if edges >= floor else []


def _collapse(parents: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """(v, root) of a forest given as (v, p), roots pointing at themselves: pointers double until all point at roots."""
    while True:
        up = parents.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        # a parent may have many children, but pointers are few compared with edges; its own row is unique
        doubled = skew_join(parents, up, ["p"], hot=None if rows >= HOT_ROWS else []).select("v", F.col("pp").alias("p"), (F.col("p") != F.col("pp")).alias("moved"))
        longer, seen = scratch.save(doubled, moved=F.count_if("moved"))
        scratch.drop(parents)
        parents, rows = longer, seen["rows"]
        if not seen["moved"]:
            return parents


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, grupo) of every record in an edge with another record; grupo is the smallest linked id.

    ``edges`` has two columns of one orderable type. Null ends, self-links and repeated or reversed
    edges are allowed and link nothing more. Without edges the result is empty.
    """
    scratch = Scratch(edges.sparkSession, "boruvka")
    one = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("w")).where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
    live, seen = scratch.save(one.distinct())
    maps: list[DataFrame] = []
    small = seen["rows"] < HOT_ROWS
    while seen["rows"]:
        ends = live.select(F.col("u").alias("v"), F.col("w").alias("o")).unionByName(live.select(F.col("w").alias("v"), F.col("u").alias("o")))
        # the smallest incident edge: to the smallest neighbour, as (min, max) grows with the other end
        picked, count = scratch.save(ends.groupBy("v").agg(F.min("o").alias("p"), F.count(F.lit(1)).alias("n")))
        hot = _hot(picked, seen["rows"], "v")
        # two components that pick the same edge would point at each other: the smaller one is the root
        back = picked.select(F.col("v").alias("p"), F.col("p").alias("pp"))
        few = None if count["rows"] >= HOT_ROWS else []
        hooked = skew_join(picked.select("v", "p"), back, ["p"], hot=few)
        pointers, _ = scratch.save(hooked.select("v", F.when((F.col("pp") == F.col("v")) & (F.col("v") < F.col("p")), F.col("v")).otherwise(F.col("p")).alias("p")))
        roots = _collapse(pointers, count["rows"], scratch)
        low = roots.groupBy("p").agg(F.min("v").alias("l"))
        labels, _ = scratch.save(skew_join(roots, low, ["p"], hot=few).select("v", "l"))
        scratch.drop(picked, roots)
        maps.append(labels)
        near = skew_join(live, labels.select(F.col("v").alias("u"), F.col("l").alias("lu")), ["u"], hot=hot)
        both = skew_join(near, labels.select(F.col("v").alias("w"), F.col("l").alias("lw")), ["w"], hot=hot)
        again, seen = scratch.save(both.where("lu != lw").select(F.least("lu", "lw").alias("u"), F.greatest("lu", "lw").alias("w")).distinct())
        scratch.drop(live)
        live = again
    if not maps:
        return live.select(F.col("u").alias("id"), F.col("w").alias("grupo"))
    out = maps.pop()
    while maps:
        later = out.select(F.col("v").alias("l"), F.col("l").alias("ll"))
        first = maps.pop()
        out = skew_join(first, later, ["l"], how="left", hot=[] if small else None).select("v", F.coalesce("ll", "l").alias("l"))
        if maps:
            out, _ = scratch.save(out)
    return out.select(F.col("v").alias("id"), F.col("l").alias("grupo"))


def linked_records(pairs: DataFrame, records: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """(noticia_id, grupo) for match pairs whose ends are spelt as numbers and must be known records."""
    scratch = Scratch(pairs.sparkSession, "links")
    cells = pairs.select(strip(F.col(left)).alias("a"), strip(F.col(right)).alias("b"))
    numbers, _ = scratch.save(cells.select("a", "b", parse_numeric(F.col("a"), stripped=True).alias("x"), parse_numeric(F.col("b"), stripped=True).alias("y")))
    spelt = numbers.select(whole_number(F.col("a"), F.col("x")).alias("a"), whole_number(F.col("b"), F.col("y")).alias("b")).where("a is not null and b is not null and a != b")
    edges, seen = scratch.save(spelt.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    ends = edges.select(F.col("a").alias("v")).unionAll(edges.select(F.col("b").alias("v"))).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    known, _ = scratch.save(ends.join(records.select(F.col(key).cast("bigint").alias("v")), "v", "left_semi"))
    hot = _hot(known, seen["rows"], "v")
    real = skew_join(edges, known.select(F.col("v").alias("a")), ["a"], hot=hot)
    real = skew_join(real, known.select(F.col("v").alias("b")), ["b"], hot=hot)
    return components(real).select(F.col("id").alias("noticia_id"), "grupo")
