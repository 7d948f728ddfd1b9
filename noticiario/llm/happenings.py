"""Problem 4: grouping records into similarity clusters.

Parallel pivot correlation clustering. Titles are reduced to forms; a form has the proper names of its
title that aren't places (the parties) and its other content words (the matter). Two forms are similar if
two of their parties agree, misspellings allowed, and enough of their other words do.

Forms meet at a pair of parties. A party that is written differently beside the same other party is put right
first: of names within one or two edits of each other that occur with the same partner, the rarer takes the
commoner's place. In each round every form that comes first, in the order of hashes, at all its pairs is a
pivot and absorbs the similar ones it meets there; so nothing is compared pairwise, a pair elects its first
form in a partial aggregation. Then medoids are computed from the clusters' word counts, medoids that meet go
through the same rounds with large clusters first, every form is scored against all medoids it meets and goes
to the closest one, and medoids are computed again, until nothing moves. Only clusters that meet another one
at a pair of parties take part in that; the others can't change.

A title with fewer than two names (no capitals to tell them, or a party the corpus uses as a place) meets others
at pairs of its rarest words and is similar if enough of all words agree.

What is a name is read off the corpus: a word that, inside titles in mixed case, is written with a capital.
A place is a name that mostly follows a preposition of place.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from noticiario.functions.words import ascii_words, decode
from noticiario.operators.skew import HOT_ROWS, HOT_SHARE, skew_join
from noticiario.session import Scratch

#: An outlet's name that follows a title (fixed pattern of the data's domain).
OUTLET = re.compile(r"\s+[|–—-]\s+[^|–—-]+$")
#: Prepositions of place, and words that say nothing about the matter (fixed values).
OF_PLACE = {"en", "desde", "hacia", "hasta"}
EMPTY = set("a al ante con de del desde el en entre hacia hasta la las lo los para por sin sobre su sus tras un una unas unos y e o u que se es asi van".split())
#: Share of capitals that makes a name; share of uses after a preposition of place that makes a place.
NAME, PLACE = 0.8, 0.25
#: Share of the shorter title's other words that two similar titles have in common.
MATTER = 0.4
#: Partners of a name up to which they are compared with each other; beyond, they meet at what deletions leave of them.
PARTNERS = 64
#: Forms of one pair of names from which they meet at the pair and one more word, misspellings allowed.
CROWD = 1000
#: Rarest words of a title with fewer than two names at whose pairs it meets others.
RAREST = 3
#: Words longer than this meet at their lengths, not at what deletions leave of them.
LONGEST = 40
#: Passes of reassignment at most; it ends before if nothing moves.
PASSES = 4
WORD = re.compile(r"\w+")


def _typed(title: str, memo: dict[str, list[str]]) -> list[tuple[str, str]]:
    """(folded word, word as written) of a title without its outlet."""
    out = []
    for w in WORD.findall(OUTLET.sub("", decode(title))):
        folded = memo.get(w)
        if folded is None:
            if len(memo) > 1_000_000:
                memo.clear()
            folded = memo[w] = [f.decode() for f in ascii_words(w)]
        for f in folded:
            out.append((f, w))
    return out


def _mixed(words: list[tuple[str, str]]) -> bool:
    """Whether capitals tell names apart: some words begin with a capital, at least a third don't."""
    letters = [w for _, w in words if w[0].isalpha()]
    low = sum(w[0].islower() for w in letters)
    return len(letters) > low and 3 * low >= len(letters)


def _parsed(df: DataFrame, row: str, title: str) -> DataFrame:
    """One pass over the titles, two kinds of rows: (row_id, forma, letras, cifras) of each title with words, and
    (palabra, n, low, cap, place) counts of each batch's words.

    ``forma`` is a digest of the distinct words that say something (of all words if none does); ``letras`` are
    those without digits, ``cifras`` those with.
    """
    schema = "row_id bigint, forma string, letras array<string>, cifras array<string>, palabra string, n bigint, low bigint, cap bigint, place bigint"

    def run(batches):
        memo: dict[str, list[str]] = {}
        for batch in batches:
            ids, keys, letters, numbers = [], [], [], []
            seen, low, cap, place = Counter(), Counter(), Counter(), Counter()
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = _typed(t, memo) if t else []
                if not words:
                    continue
                mixed, before = _mixed(words), ""
                for k, (f, w) in enumerate(words):
                    if f not in EMPTY:
                        seen[f] += 1
                        place[f] += before in OF_PLACE
                        if mixed and k:
                            (cap if w[0].isupper() else low)[f] += 1
                    before = f
                distinct = sorted({f for f, _ in words})
                told = [f for f in distinct if f not in EMPTY and (len(f) > 1 or f.isdigit())]
                ids.append(i)
                keys.append(hashlib.blake2b(" ".join(told or ["", *distinct]).encode(), digest_size=16).hexdigest())
                letters.append([f for f in told if f.isalpha()])
                numbers.append([f for f in told if not f.isalpha()])
            known = [w for w in seen if w.isalpha() and len(w) > 1]
            none = lambda m, kind: pa.nulls(m, kind)
            texts = pa.list_(pa.string())
            first = [pa.array(ids, pa.int64()), pa.array(keys, pa.string()), pa.array(letters, texts), pa.array(numbers, texts), none(len(ids), pa.string()), *[none(len(ids), pa.int64())] * 4]
            second = [none(len(known), pa.int64()), none(len(known), pa.string()), none(len(known), texts), none(len(known), texts), pa.array(known, pa.string()), *[pa.array([c[w] for w in known], pa.int64()) for c in (seen, low, cap, place)]]
            names = "row_id forma letras cifras palabra n low cap place".split()
            yield pa.RecordBatch.from_arrays(first, names)
            yield pa.RecordBatch.from_arrays(second, names)

    return df.select(F.col(row).cast("bigint").alias("row_id"), F.col(title).alias("t")).where("row_id is not null").mapInArrow(run, schema)


def word_kinds(parsed: DataFrame) -> DataFrame:
    """(palabra, tipo, n): ``o`` ordinary, ``l`` place, ``p`` other name, ``u`` not seen where capitals tell."""
    counts = parsed.where("palabra is not null").groupBy("palabra").agg(*[F.sum(c).alias(c) for c in ("n", "low", "cap", "place")])
    name = F.col("cap") >= NAME * (F.col("cap") + F.col("low"))
    kind = F.when(F.col("cap") + F.col("low") == 0, F.when(F.col("place") >= PLACE * F.col("n"), "l").otherwise("u")).when(~name, "o").when(F.col("place") >= PLACE * F.col("n"), "l").otherwise("p")
    return counts.select("palabra", kind.alias("tipo"), "n")


def close(a: Column, b: Column) -> Column:
    """Equal up to a misspelling: one edit, or two in words of six letters on; swapped neighbours are one. Words under four letters must be equal."""
    least = F.least(F.length(a), F.length(b))
    edits = F.coalesce(F.levenshtein(a, b, 2), F.lit(9))
    edits = F.when(edits < 0, 9).otherwise(edits)
    letters = lambda c: F.sort_array(F.split(c, ""))
    swapped = (edits == 2) & (F.length(a) == F.length(b)) & (letters(a) == letters(b))
    return (a == b) | ((least >= 4) & (edits <= F.when(least < 6, 1).otherwise(2))) | ((least >= 4) & swapped)


def similarity(na: Column, oa: Column, nb: Column, ob: Column) -> Column:
    """Of two forms that meet: 0 unless enough of the matter agrees; else the share of all words that agree, up to 1.

    Misspelt words count where the equal ones are too few. Of forms with fewer than two names all words are matter.
    """
    few = (F.size(na) < 2) | (F.size(nb) < 2)
    oa, ob = (F.when(few, F.concat(n, o)).otherwise(o) for n, o in ((na, oa), (nb, ob)))
    same, least = F.size(F.array_intersect(oa, ob)), F.least(F.size(oa), F.size(ob))
    misspelt = F.size(F.filter(F.array_except(oa, ob), lambda x: F.exists(F.array_except(ob, oa), lambda y: close(x, y))))
    enough = (same >= MATTER * least) | (same + misspelt >= MATTER * least)
    names = F.when(few, 0).otherwise(F.size(F.array_intersect(na, nb)))
    union = F.size(oa) + F.size(ob) - same + F.when(few, 0).otherwise(F.size(F.array_union(na, nb)))
    return F.when(enough, F.greatest(F.lit(1e-6), (names + same) / F.greatest(union, F.lit(1)))).otherwise(0.0)


def _few(rows: int) -> list | None:
    return [] if rows < HOT_ROWS else None


def _forms(rows: DataFrame, kinds: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(forma, row_id, peso, nombres, otras, raras): raras, the words at whose pairs a form with fewer than two names meets others."""
    base, seen = scratch.save(rows.groupBy("forma").agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("peso"), F.first("letras").alias("letras"), F.first("cifras").alias("cifras")), words=F.sum(F.size("letras")))
    total = kinds.agg(F.sum("n")).first()[0] or 0
    floor = max(int(total * HOT_SHARE), HOT_ROWS)
    hot = [tuple(r) for r in kinds.where(F.col("n") >= floor).select("palabra").collect()]  # at most 1 / HOT_SHARE
    tagged = skew_join(base.select("forma", F.explode("letras").alias("palabra")), kinds, ["palabra"], hot=hot)
    is_name = F.col("tipo").isin("p", "u")
    parts = tagged.groupBy("forma").agg(F.sort_array(F.collect_list(F.when(is_name, F.col("palabra")))).alias("nombres"), F.sort_array(F.collect_list(F.when(~is_name, F.col("palabra")))).alias("otras"), F.sort_array(F.collect_list(F.struct("n", "palabra"))).alias("_n"))
    empty = F.array().cast("array<string>")
    wide = base.join(parts, "forma", "left").withColumns({c: F.coalesce(c, empty) for c in ("nombres", "otras")})
    rare = F.slice(F.concat("nombres", "cifras", F.array_except(F.transform(F.coalesce("_n", F.array().cast("array<struct<n:bigint,palabra:string>>")), lambda x: x["palabra"]), F.col("nombres"))), 1, RAREST)
    forms, seen = scratch.save(wide.select("forma", "row_id", "peso", "nombres", F.concat("otras", "cifras").alias("otras"), F.sort_array(F.when(F.size("nombres") < 2, rare).otherwise(empty)).alias("raras")))
    scratch.drop(base)
    return forms, seen["rows"]


def _pairs_of(c: str) -> Column:
    """Every two elements of a sorted array, as (a, b)."""
    x = F.col(c)
    return F.flatten(F.transform(x, lambda a, i: F.transform(F.slice(x, i + 2, F.size(x)), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _left_by_deletions(c: Column) -> Column:
    """At what two words that are :func:`close` meet: the word and, from four letters on, what one or two deletions leave of it. Long ones meet by length."""
    less = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substr(w, F.lit(1), i - 1), F.substr(w, i + 1)))
    one, n = less(c), F.length(c)
    lengths = F.when(n >= LONGEST - 1, F.transform(F.sequence(F.lit(0), F.lit(2)), lambda d: F.concat(F.lit("\x1f"), (n + d).cast("string")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(F.array(c), F.when(n.between(4, LONGEST), F.concat(one, F.flatten(F.transform(one, less)))).otherwise(F.array().cast("array<string>")), lengths))


def _put_right(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(a, b, a2, b2) of the pairs of names that are another, commoner pair misspelt. ``edges``: (a, b, w), a < b.

    Of an edge's names at most one is put right, in the company of the other one.
    """
    ends = edges.select(F.col("a").alias("de"), F.col("b").alias("x"), "w").unionAll(edges.select(F.col("b").alias("de"), F.col("a").alias("x"), "w")).where(F.length("x") >= 4)
    ends, _ = scratch.save(ends)
    degree = ends.groupBy("de").agg(F.count(F.lit(1)).alias("_d")).where("_d >= 2")
    sized, seen = scratch.save(skew_join(ends, degree, ["de"]), hot=F.count_if(F.col("_d") > PARTNERS))
    small = sized.where(F.col("_d") <= PARTNERS).select("de", F.lit(0).cast("bigint").alias("llave"), "x", "w")
    if seen["hot"]:
        small = small.unionByName(sized.where(F.col("_d") > PARTNERS).select("de", F.explode(_left_by_deletions(F.col("x"))).alias("_l"), "x", "w").select("de", F.xxhash64("_l").alias("llave"), "x", "w"))
    other = small.select("de", "llave", F.col("x").alias("y"), F.col("w").alias("v"))
    better = (F.struct("v", "y") > F.struct(F.col("w").alias("v"), F.col("x").alias("y")))
    near = small.join(other, ["de", "llave"]).where(better & (F.abs(F.length("x") - F.length("y")) <= 2)).where(close(F.col("x"), F.col("y")))
    best, _ = scratch.save(near.groupBy("de", "x").agg(F.max(F.struct("v", "y")).alias("m")).select("de", "x", F.col("m.v").alias("v"), F.col("m.y").alias("y")))
    again = best.select("de", F.col("x").alias("y"), F.col("y").alias("y2"))
    best = best.join(again, ["de", "y"], "left").select("de", "x", "v", F.coalesce("y2", "y").alias("y"))
    moved = best.select(F.least("de", "x").alias("a"), F.greatest("de", "x").alias("b"), "v", F.least("de", "y").alias("a2"), F.greatest("de", "y").alias("b2"))
    return moved.groupBy("a", "b").agg(F.max(F.struct("v", "a2", "b2")).alias("m")).select("a", "b", "m.a2", "m.b2")


def _keys(forms: DataFrame, scratch: Scratch) -> tuple[DataFrame, int]:
    """(clave, forma): the pairs of names (or of rarest words) at which each form meets others; crowded pairs of names with one more word.

    Two similar forms of a crowded pair have a word in common, up to a misspelling, or one of them has no other word, so
    they meet at what deletions leave of the word, or at the pair itself where a form without other words is among its own.
    Crowded pairs of rarest words stay: their forms have those words in common anyway.
    """
    named = forms.where(F.size("nombres") >= 2).select("forma", "peso", F.explode(_pairs_of("nombres")).alias("p")).select("forma", "peso", "p.a", "p.b")
    named, _ = scratch.save(named)
    edges, _ = scratch.save(named.groupBy("a", "b").agg(F.sum("peso").alias("w")))
    right, seen = scratch.save(_put_right(edges, scratch))
    to = skew_join(named, right, ["a", "b"], how="left", hot=None if seen["rows"] else [])
    keyed = to.select("forma", F.xxhash64(F.lit("n"), F.coalesce("a2", "a"), F.coalesce("b2", "b")).alias("clave"))
    rare = forms.where(F.size("raras") >= 2).select("forma", F.explode(_pairs_of("raras")).alias("p")).select("forma", F.xxhash64(F.lit("r"), F.col("p.a"), F.col("p.b")).alias("clave"))
    by_name, seen = scratch.save(keyed.distinct())
    crowded, many = scratch.save(by_name.groupBy("clave").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") > CROWD))
    if many["rows"]:
        hot = [tuple(r) for r in crowded.where(F.col("_c") >= max(HOT_ROWS, int(seen["rows"] * HOT_SHARE))).select("clave").collect()]  # at most 1 / HOT_SHARE
        flagged = skew_join(by_name, crowded, ["clave"], how="left", hot=hot)
        calm, busy = flagged.where("_c is null").select("clave", "forma"), flagged.where("_c is not null").select("clave", "forma")
        busy, _ = scratch.save(busy.join(forms.select("forma", "otras"), "forma"))
        bare = busy.where(F.size("otras") == 0).select("clave").distinct().withColumn("_x", F.lit(True))
        whole = skew_join(busy.select("clave", "forma"), bare, ["clave"], hot=hot).select("clave", "forma")
        split = busy.select("clave", "forma", F.explode("otras").alias("_w")).select("clave", "forma", F.explode(_left_by_deletions(F.col("_w"))).alias("_w")).select(F.xxhash64("clave", "_w").alias("clave"), "forma").distinct()
        split, parts = scratch.save(split)
        # where a form is alone it meets nothing
        alone = split.groupBy("clave").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1")
        split = skew_join(split, alone, ["clave"], hot=_few(parts["rows"])).select("clave", "forma")
        by_name = calm.unionByName(whole).unionByName(split)
    keys, seen = scratch.save(by_name.unionByName(rare).distinct())
    scratch.drop(named, edges)
    return keys, seen["rows"]


def _scored(pairs: DataFrame, forms: DataFrame) -> DataFrame:
    """``pairs`` (forma, pivote, ...) with ``s``, those above 0."""
    one = forms.select("forma", F.col("nombres").alias("na"), F.col("otras").alias("oa"))
    two = forms.select(F.col("forma").alias("pivote"), F.col("nombres").alias("nb"), F.col("otras").alias("ob"))
    both = pairs.join(one, "forma").join(two, "pivote").withColumn("s", similarity(F.col("na"), F.col("oa"), F.col("nb"), F.col("ob")))
    return both.drop("na", "oa", "nb", "ob").where("s > 0")


def _rounds(forms: DataFrame, keys: DataFrame, scratch: Scratch) -> DataFrame:
    """(forma, pivote) of every form with a key. ``keys``: (clave, forma, orden); the order (and forma) is total."""
    done: list[DataFrame] = []
    left, seen = scratch.save(keys)
    while seen["rows"]:
        few = _few(seen["rows"])
        first = left.groupBy("clave").agg(F.min(F.struct("orden", "forma")).alias("primera"))
        marked, _ = scratch.save(skew_join(left, first, ["clave"], hot=few).select("clave", "forma", F.col("primera.forma").alias("pivote"), F.col("primera.orden").alias("op")))
        pivots, _ = scratch.save(marked.groupBy("forma").agg(F.bool_and(F.col("pivote") == F.col("forma")).alias("es")).where("es").select(F.col("forma").alias("pivote")))
        pairs = skew_join(marked.where("forma != pivote").select("forma", "pivote", "op").distinct(), pivots, ["pivote"], hot=few)
        taken = _scored(pairs, forms).groupBy("forma").agg(F.min(F.struct((-F.col("s")).alias("s"), "op", "pivote")).alias("m")).select("forma", "m.pivote")
        took, _ = scratch.save(taken.unionByName(pivots.select(F.col("pivote").alias("forma"), "pivote")))
        done.append(took)
        rest, seen = scratch.save(left.join(took.select("forma"), "forma", "left_anti").select("clave", "forma", "orden"))
        scratch.drop(left, marked, pivots)
        left = rest
    out = forms.select("forma").where("false").withColumn("pivote", F.col("forma"))
    for d in done:
        out = out.unionByName(d)
    return out


def _typical(members: DataFrame, forms: DataFrame, scratch: Scratch) -> DataFrame:
    """(grupo, forma, tipico): how common a form's words are in its cluster, on average. ``members``: (forma, grupo)."""
    wide = members.join(forms.select("forma", "peso", F.concat("nombres", "otras").alias("_w")), "forma")
    words, seen = scratch.save(wide.select("grupo", "forma", "peso", F.size("_w").alias("k"), F.explode(F.when(F.size("_w") > 0, F.col("_w")).otherwise(F.array(F.lit("")))).alias("w")))
    counts = words.groupBy("grupo", "w").agg(F.sum("peso").alias("c"))
    return skew_join(words, counts, ["grupo", "w"], hot=_few(seen["rows"])).groupBy("grupo", "forma").agg((F.sum("c") / F.first("k")).alias("tipico"))


def _reassign(forms: DataFrame, keys: DataFrame, assigned: DataFrame, rows: int, scratch: Scratch) -> DataFrame:
    """(forma, grupo): after medoids are merged, every form goes to the closest one it meets; repeated until nothing moves."""
    few = _few(rows)
    placed, _ = scratch.save(keys.join(assigned, "forma"))
    contested, seen = scratch.save(placed.groupBy("clave").agg(F.min("grupo").alias("_a"), F.max("grupo").alias("_b")).where("_a != _b").select("clave"))
    if not seen["rows"]:
        return assigned
    meeting, _ = scratch.save(skew_join(placed, contested.withColumn("_x", F.lit(True)), ["clave"], hot=few).select("clave", "forma", "grupo"))
    groups = meeting.select("grupo").distinct()
    live, seen = scratch.save(skew_join(assigned, groups, ["grupo"], hot=few).select("forma", "grupo"))
    fixed = assigned.join(live.select("forma"), "forma", "left_anti")
    keys, _ = scratch.save(meeting.select("clave", "forma"))
    few = _few(seen["rows"])
    for _ in range(PASSES):
        best = _typical(live, forms, scratch).groupBy("grupo").agg(F.max(F.struct("tipico", "forma")).alias("m")).select("grupo", F.col("m.forma").alias("medoide"))
        weight = skew_join(live.join(forms.select("forma", "peso"), "forma"), best, ["grupo"], hot=few).groupBy("grupo", "medoide").agg(F.sum("peso").alias("peso"))
        heads, _ = scratch.save(weight)
        order = heads.select(F.col("medoide").alias("forma"), F.struct((-F.col("peso")).alias("p"), F.xxhash64("medoide").alias("h")).alias("orden"))
        merged = _rounds(forms, keys.join(order, "forma").select("clave", "forma", "orden"), scratch)
        to, _ = scratch.save(heads.join(merged.withColumnRenamed("forma", "medoide"), "medoide", "left").select("grupo", F.coalesce("pivote", "medoide").alias("mayor")))
        own, _ = scratch.save(skew_join(live, to, ["grupo"], hot=few).select("forma", F.col("mayor").alias("propio")))
        # every form against every medoid it meets; its own one wins ties, and keeps it where no other is similar
        heads_at = keys.join(to.select(F.col("mayor").alias("forma")).distinct(), "forma").select("clave", F.col("forma").alias("pivote"))
        near = keys.select("clave", F.col("forma")).join(heads_at, "clave").select("forma", "pivote").distinct()
        scored = _scored(near, forms).join(own, "forma")
        choice = scored.groupBy("forma").agg(F.max(F.struct("s", (F.col("pivote") == F.col("propio")).alias("e"), "pivote")).alias("m")).select("forma", "m.pivote")
        again, moved = scratch.save(own.join(choice, "forma", "left").select("forma", F.coalesce("pivote", "propio").alias("grupo"), "propio"), n=F.count_if(F.col("grupo") != F.col("propio")))
        joined = moved["n"] or heads.count() - to.select("mayor").distinct().count()
        live = again.select("forma", "grupo")
        if not joined:
            break
    return fixed.unionByName(live)


def clusters(df: DataFrame, row: str = "row_id", title: str = "titulo", typical: bool = False) -> tuple[DataFrame, DataFrame]:
    """(row_id, forma) of the rows with words, and (forma, cluster, tamano) of the forms, with ``typical`` also ``tipico``; cluster is the smallest row of it."""
    scratch = Scratch(df.sparkSession, "happenings")
    parsed, _ = scratch.save(_parsed(df, row, title))
    rows = parsed.where("forma is not null")
    kinds, _ = scratch.save(word_kinds(parsed))
    forms, count = _forms(rows, kinds, scratch)
    keys, size = _keys(forms, scratch)
    first = _rounds(forms, keys.select("clave", "forma", F.xxhash64("forma").alias("orden")), scratch)
    assigned, _ = scratch.save(forms.select("forma").join(first, "forma", "left").select("forma", F.coalesce("pivote", "forma").alias("grupo")))
    placed, _ = scratch.save(_reassign(forms, keys, assigned, size, scratch).join(forms.select("forma", "row_id", "peso"), "forma"))
    label = placed.groupBy("grupo").agg(F.min("row_id").alias("cluster"), F.sum("peso").alias("tamano"))
    out = skew_join(placed, label, ["grupo"], hot=_few(count))
    if typical:
        out = out.join(_typical(placed.select("forma", "grupo"), forms, scratch).select("forma", "tipico"), "forma")
    return rows.select("row_id", "forma"), scratch.save(out.select("forma", "cluster", "tamano", *(["tipico"] if typical else [])))[0]


def found(df: DataFrame, row: str = "row_id", title: str = "titulo", least: int = 3) -> DataFrame:
    """(row_id, cluster) of the rows in clusters of at least ``least`` rows; cluster is the smallest row. Titles without words are in none, nor are rows without an id."""
    rows, forms = clusters(df, row, title)
    return skew_join(rows, forms.where(F.col("tamano") >= least).select("forma", "cluster"), ["forma"]).select("row_id", "cluster")


def describe(df: DataFrame, row: str = "row_id", title: str = "titulo", least: int = 3, members: int = 3) -> DataFrame:
    """(cluster, tamano, puesto, row_id): each cluster's size and most typical members, ``puesto`` from 1 to ``members``.

    A member is typical when its words are common in its cluster; one row stands for all of the same
    wording. Places are found in two steps, so a cluster of any size is no single task's.
    """
    rows, forms = clusters(df, row, title, typical=True)
    heads = rows.groupBy("forma").agg(F.min("row_id").alias("row_id"))
    ranked = forms.where(F.col("tamano") >= least).join(heads, "forma").withColumn("_part", F.pmod(F.xxhash64("row_id"), F.lit(64)))
    order = [F.col("tipico").desc(), F.col("row_id")]
    near = ranked.withColumn("_k", F.row_number().over(Window.partitionBy("cluster", "_part").orderBy(*order))).where(F.col("_k") <= members)
    return near.withColumn("puesto", F.row_number().over(Window.partitionBy("cluster").orderBy(*order))).where(F.col("puesto") <= members).select("cluster", "tamano", "puesto", "row_id")
