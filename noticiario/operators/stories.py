"""Story groups: pairs that share words and pass tests, components, ids; and what vectors say about groups."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from noticiario.functions.labels import action_conflict, conflict_bits, distinctive, embedding_text, opposed_bits, overlap, title_norm
from noticiario.functions.text import fold
from noticiario.functions.vectors import centroids, cosine
from noticiario.functions import lexicon as L
from noticiario.operators.alike import best_matches, class_edges, class_pairs, ratio_pairs, vector_pairs
from noticiario.operators.graph import components
from noticiario.operators.numbering import numbered
from noticiario.operators.skew import HOT_ROWS, HOT_SHARE, skew_join
from noticiario.session import Scratch

#: Words in more rows than this make no pairs of ``token_pairs``, as its SQL says.
MOST_ROWS = 100
#: Up to ``WIDE_BLOCK`` rows of a word meet each other in one task; of a word in n rows, ``WORD_BLOCK * n`` pairs of rows do at least.
WORD_BLOCK, WIDE_BLOCK = 500, 20_000
#: Words that a row tells by bits, 63 in a number.
BITS, BIT_WORDS = 63, 252


def word_pairs(words: DataFrame, most: int | Column = MOST_ROWS, least: int = 2) -> DataFrame:
    """(i, j), i < j: rows that share a word which ``least`` to ``most`` rows have. ``words``: (id, palabra), distinct.

    The rarity is counted first, so a common word never gathers its rows. A pair is given at the commonest word that
    both rows have, so no pair is given twice and none travels: every posting tells which commoner words its row has, the
    ``BIT_WORDS`` commonest as bits. A word's rows are cut into blocks of ``WIDE_BLOCK``, at most as many as the root of their
    number, so the postings that travel stay near linear in the rows.
    """
    scratch = Scratch(words.sparkSession, "words")
    words, seen = scratch.save(words.select("id", "palabra"))
    counts = words.groupBy("palabra").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(least, most))
    # a word's place among all, the commonest first, stands for it
    df, _ = scratch.save(numbered(counts.withColumn("_m", -F.col("n")), ["_m", "palabra"], "_r").select("palabra", "n", F.col("_r").cast("int").alias("_r")))
    hot = [tuple(r) for r in df.where(F.col("n") >= max(HOT_ROWS, int(seen["rows"] * HOT_SHARE))).select("palabra").collect()]  # at most 1 / HOT_SHARE
    rare = skew_join(words, df, ["palabra"], hot=hot)
    masks = [f"_m{q}" for q in range(BIT_WORDS // BITS)]
    one, place = F.lit(1).cast("bigint"), lambda q: F.col("_r") - q * BITS
    bit = lambda n: F.call_function("shiftleft", one, n)
    rows = rare.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_r", "n"))).alias("_w"), *[F.coalesce(F.bit_or(F.when(place(q).between(0, BITS - 1), bit(place(q)))), F.lit(0).cast("bigint")).alias(m) for q, m in enumerate(masks)])
    blocks = F.ceil(F.least(F.sqrt(F.col("_p.n") / WORD_BLOCK), F.col("_p.n") / WIDE_BLOCK)).cast("int")
    each = rows.withColumns({"_a": F.col("_w._r"), "_t": sum(F.bit_count(m) for m in masks)}).select("id", "_a", "_t", *masks, F.posexplode("_w").alias("_k", "_p")).select("*", "_p._r", blocks.alias("_c"))
    # of the words that the row has, only those before this one
    before = {m: F.when(place(q) < 0, 0).when(place(q) < BITS, F.col(m).bitwiseAND(bit(place(q)) - 1)).otherwise(F.col(m)) for q, m in enumerate(masks)}
    told = each.withColumns(before | {"_s": F.when(F.col("_k") > F.col("_t"), F.slice("_a", F.col("_t") + 1, F.col("_k") - F.col("_t"))).otherwise(F.array().cast("array<int>"))})
    postings, _ = scratch.save(told.select("id", "_r", "_c", *masks, "_s"))
    scratch.drop(words, df)
    # the rows of a word are cut into blocks by hash; every two blocks meet by themselves, and travel once for both sides
    own = postings.withColumn("_b", F.pmod(F.xxhash64("id"), F.col("_c")).cast("int"))
    sides = own.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_c") - 1))).select("_r", F.least("_b", "_o").alias("_x"), F.greatest("_b", "_o").alias("_y"), "_b", "id", *masks, "_s")
    a, b = (sides.select(*[F.col(c).alias(f"{c}{x}") for c in sides.columns]) for x in "ij")
    apart = F.lit(True)
    for m in masks:
        apart = apart & (F.col(f"{m}i").bitwiseAND(F.col(f"{m}j")) == 0)
    apart = apart & ((F.size("_si") == 0) | (F.size("_sj") == 0) | ~F.arrays_overlap("_si", "_sj"))
    once = (F.col("_bi") < F.col("_bj")) | ((F.col("_bi") == F.col("_bj")) & (F.col("_xi") == F.col("_yj")) & (F.col("idi") < F.col("idj")))
    met = a.join(b.hint("merge"), (F.col("_ri") == F.col("_rj")) & (F.col("_xi") == F.col("_xj")) & (F.col("_yi") == F.col("_yj")) & once & apart)
    return met.select(F.least("idi", "idj").alias("i"), F.greatest("idi", "idj").alias("j"))


def title_words(df: DataFrame, row: str, title: str) -> DataFrame:
    """(id, palabra): the distinctive words of the titles as compared."""
    return df.select(F.col(row).alias("id"), F.explode(distinctive(title_norm(F.col(title)))).alias("palabra"))


def rare_words(df: DataFrame, row: str, title: str) -> DataFrame:
    """(id, palabra): the words of five letters on that the rare-word index takes."""
    w = F.filter(F.split(fold(F.coalesce(title, F.lit(""))), "[^a-z]+"), lambda t: (F.length(t) >= 5) & ~t.isin(L.RARE_STOP))
    return df.select(F.col(row).alias("id"), F.explode(F.array_distinct(w)).alias("palabra"))


def story_edges(df: DataFrame, row: str = "row_id", title: str = "titulo", summary: str = "resumen_aclaracion", vector: str | None = None, title_ratio: float = 0.92, similar: float = 0.94, shared: float = 0.45, block: int | None = None) -> DataFrame:
    """(i, j) with the components of all equivalent stories: two rows that share a distinctive title word, however many rows have it, and pass a test.

    Titles nearly equal pass; so do (with vectors) contents whose cosine and share of distinctive words reach ``similar``
    and ``shared``. Opposed actions are never alike. All different titles and all different contents are compared, in
    blocks; rows of one title with the same actions, or of one text, are one there.
    """
    scratch = Scratch(df.sparkSession, "stories")
    text = embedding_text(F.col(title), F.col(summary))
    told = F.when(F.col(vector).isNotNull(), F.xxhash64(vector)) if vector else F.lit(None).cast("bigint")
    base, _ = scratch.save(df.select(F.col(row).cast("bigint").alias("id"), title_norm(F.col(title)).alias("t"), F.md5(text.cast("binary")).alias("h"), conflict_bits(distinctive(text, 3)).alias("bits"), told.alias("u")).where(F.size(distinctive(F.col("t"))) > 0))
    own = ~opposed_bits(F.col("bits"), F.col("bits"))
    kinds, _ = scratch.save(base.groupBy("t", "bits").agg(F.min("id").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi")).withColumn("propia", own))
    titles, _ = scratch.save(kinds.groupBy("t").agg(F.min("k").alias("g")).withColumn("w", distinctive(F.col("t"))))
    near, _ = scratch.save(ratio_pairs(titles.select(F.col("g").alias("k"), "t"), title_ratio, block))
    sides = [titles.select(F.col("g").alias(x), F.col("w").alias(f"w{x}")) for x in "ab"]
    met = near.join(sides[0], "a").join(sides[1], "b").where(F.arrays_overlap("wa", "wb")).select("a", "b", "ab", "ba")
    every = met.unionByName(titles.select(F.col("g").alias("a"), F.col("g").alias("b"), F.lit(True).alias("ab"), F.lit(True).alias("ba")))
    known, _ = scratch.save(kinds.join(titles.select("t", "g"), "t").select("g", "k", "bits"))
    sides = [known.select(F.col("g").alias(x), F.col("k").alias(f"k{x}"), F.col("bits").alias(f"s{x}")) for x in "ab"]
    pairs = every.join(sides[0], "a").join(sides[1], "b").where((F.col("a") != F.col("b")) | (F.col("ka") < F.col("kb"))).where(~opposed_bits(F.col("sa"), F.col("sb")))
    pairs, _ = scratch.save(pairs.select(F.col("ka").alias("a"), F.col("kb").alias("b"), "ab", "ba"))
    edges = class_edges(skew_join(base.select("id", "t", "bits"), kinds, ["t", "bits"]).select("id", "k", "lo", "hi", "propia"), pairs)
    if not vector:
        return edges
    texts, _ = scratch.save(base.where("u is not null").groupBy("t", "h", "bits", "u").agg(F.min("id").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    heads, _ = scratch.save(df.select(F.col(row).cast("bigint").alias("k"), F.col(vector).alias("v"), distinctive(text).alias("w4")).join(texts.select("k", "t", "bits"), "k").withColumn("w", distinctive(F.col("t"))))
    sized, _ = scratch.save(heads.select("k", "v"))
    said, _ = scratch.save(heads.drop("v"))
    scratch.drop(heads)
    close, _ = scratch.save(vector_pairs(sized, similar, block).select("a", "b"))
    scratch.drop(sized)
    sides = [said.select(F.col("k").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("w", "w4", "bits")]) for x in "ab"]
    alike = close.join(sides[0], "a").join(sides[1], "b").where(F.arrays_overlap("w_a", "w_b") & ~opposed_bits(F.col("bits_a"), F.col("bits_b")) & (overlap(F.col("w4_a"), F.col("w4_b")) >= shared))
    alike, _ = scratch.save(alike.select("a", "b", F.lit(True).alias("ab"), F.lit(True).alias("ba")))
    scratch.drop(close)
    # copies of a text are linked by their title already, so their first row is enough; unless its actions oppose one another
    some = skew_join(base.where("u is not null").drop("bits"), texts, ["t", "h", "u"]).where(~own | (F.col("id") == F.col("k")))
    members = some.select("id", "k", "lo", F.when(own, F.col("k")).otherwise(F.col("hi")).alias("hi"), F.lit(False).alias("propia"))
    return edges.unionByName(class_edges(members, alike))


def title_classes(df: DataFrame, row: str = "row_id", title: str = "titulo", theta: float = 0.92, block: int | None = None, already: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows with the class (k, its first row) of their title as compared, and (a, b, ab, ba) of all classes nearly equal, in which order. Blank titles are in none.

    ``already``: the titles are as compared.
    """
    scratch = Scratch(df.sparkSession, "classes")
    base, _ = scratch.save(df.select(F.col(row).cast("bigint").alias("id"), (F.col(title) if already else title_norm(F.col(title))).alias("t")).where("t != ''"))
    classes, _ = scratch.save(base.groupBy("t").agg(F.min("id").alias("k"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    pairs, _ = scratch.save(ratio_pairs(classes.select("k", "t"), theta, block))
    members, _ = scratch.save(skew_join(base, classes, ["t"]).withColumn("propia", F.lit(True)))
    return members, pairs


def title_pairs(df: DataFrame, row: str = "row_id", title: str = "titulo", theta: float = 0.92, block: int | None = None) -> DataFrame:
    """(i, j), i < j, of all rows whose titles are nearly equal, identical ones too."""
    return class_pairs(*title_classes(df, row, title, theta, block))


def subject_edges(df: DataFrame, row: str = "row_id", title: str = "titulo", theta: float = 0.92, shared: float = 0.40, block: int | None = None) -> DataFrame:
    """(i, j) that connect the rows of one subject: titles nearly equal with distinctive words in common and no opposed actions. All pairs' components, fewer edges."""
    members, pairs = title_classes(df, row, title, theta, block)
    w4, w3 = distinctive(F.col("t")), distinctive(F.col("t"), 3)
    texts, _ = Scratch(df.sparkSession, "subjects").save(members.where("id = k").select("k", w4.alias("w4"), w3.alias("w3")))
    sides = [texts.select(F.col("k").alias(x), F.col("w4").alias(f"w4_{x}"), F.col("w3").alias(f"w3_{x}")) for x in "ab"]
    near = pairs.join(sides[0], "a").join(sides[1], "b").where((overlap(F.col("w4_a"), F.col("w4_b")) >= shared) & ~action_conflict(F.col("w3_a"), F.col("w3_b"))).select("a", "b", "ab", "ba")
    own = (F.size(w4) > 0) & ~action_conflict(w3, w3)
    return class_edges(members.withColumn("propia", own).drop("t"), near)


def group_ids(df: DataFrame, groups: DataFrame, row: str = "row_id", name: str = "grupo_noticia") -> DataFrame:
    """``df`` with ``G00001`` and so on, groups numbered in the order of their first rows, single rows too. ``groups``: (id, grupo), grupo the first row."""
    heads = df.join(groups.select(F.col("id").alias(row), F.col("grupo").alias("_g")), row, "left").withColumn("_g", F.coalesce("_g", row))
    scratch = Scratch(df.sparkSession, "groups")
    rows, _ = scratch.save(heads)
    order = numbered(rows.select("_g").distinct(), ["_g"], "_n", 1)
    text = F.col("_n").cast("string")
    return skew_join(rows, order, ["_g"]).withColumn(name, F.concat(F.lit("G"), F.lpad(text, F.greatest(F.lit(5), F.length(text)), F.lit("0")))).drop("_g", "_n")


def story_groups(df: DataFrame, row: str = "row_id", title: str = "titulo", summary: str = "resumen_aclaracion", vector: str | None = None) -> DataFrame:
    """``df`` with ``grupo_noticia``: an overlay, labels stay as they are."""
    groups, _ = Scratch(df.sparkSession, "storygroups").save(components(story_edges(df, row, title, summary, vector), "i", "j"))
    return group_ids(df.drop(vector) if vector else df, groups, row)


def exact_keys(df: DataFrame, row: str = "row_id", title: str = "titulo", summary: str = "resumen_aclaracion") -> DataFrame:
    """(id, grupo) edges: rows with equal first 40 title words, or equal first 120 summary words (of 25 at least), to the first such row."""

    def head(c: str, n: int) -> Column:
        w = F.filter(F.split(F.regexp_replace(fold(F.coalesce(c, F.lit(""))), "[^a-z0-9\\s]", ""), "\\s+"), lambda t: t != "")
        return F.slice(w, 1, n)

    wide = df.select(F.col(row).alias("id"), head(title, 40).alias("t"), head(summary, 120).alias("s"))
    keys = wide.select("id", F.when(F.size("t") > 0, F.md5(F.concat(F.lit("t"), F.array_join("t", " ")))).alias("k")).unionAll(wide.select("id", F.when(F.size("s") >= 25, F.md5(F.concat(F.lit("s"), F.array_join("s", " ")))).alias("k"))).where("k is not null")
    keys, _ = Scratch(df.sparkSession, "exact").save(keys)
    first = keys.groupBy("k").agg(F.min("id").alias("grupo"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return skew_join(keys, first.drop("n"), ["k"]).where("id != grupo").select("id", "grupo").distinct()


def medoids(df: DataFrame, key: str, row: str, vector: str) -> DataFrame:
    """(key, representante, similitud): of each key the row closest to the mean vector, the first one on ties."""
    with_center = skew_join(df.select(key, row, vector), centroids(df, key, vector), [key])
    return with_center.where(F.col(vector).isNotNull()).withColumn("_s", F.round(cosine(F.col(vector), F.col("centro")), 9)).groupBy(key).agg(F.min(F.struct((-F.col("_s")).alias("s"), F.col(row).alias("r"))).alias("m")).select(key, F.col("m.r").alias("representante"), (-F.col("m.s")).alias("similitud"))


def outliers(df: DataFrame, key: str, row: str, vector: str, least: float = 0.60, floor: float = 0.60) -> DataFrame:
    """(key, row, similitud, umbral, fuera): members below max(floor, mean - 2 population deviations) of the similarities to their key's mean; keys of three vectors on."""
    sims = skew_join(df.select(key, row, vector), centroids(df, key, vector), [key]).where(F.col(vector).isNotNull()).select(key, row, cosine(F.col(vector), F.col("centro")).alias("similitud"))
    stats = sims.groupBy(key).agg(F.avg("similitud").alias("_m"), F.stddev_pop("similitud").alias("_d"), F.count(F.lit(1)).alias("_n")).where("_n >= 3")
    limit = F.greatest(F.lit(floor), F.col("_m") - 2 * F.col("_d"))
    return skew_join(sims, stats.select(key, limit.alias("umbral")), [key]).withColumn("fuera", F.col("similitud") < F.col("umbral"))


def reassign(df: DataFrame, key: str, row: str, vector: str, jump: float = 0.75, floor: float = 0.60, block: int | None = None) -> DataFrame:
    """(row, similitud, key_nueva) of all outliers; key_nueva is the key whose mean fits best, better than its own and above ``jump``, else null. ``row`` is a number.

    Outliers are the stated query set: each is compared with every mean, in blocks.
    """
    scratch = Scratch(df.sparkSession, "reassign")
    out, seen = scratch.save(outliers(df, key, row, vector, floor=floor).where("fuera").select(row, "similitud"))
    if not seen["rows"]:
        return out.withColumn(f"{key}_nueva", F.lit(None).cast(df.schema[key].dataType))
    means, _ = scratch.save(numbered(centroids(df, key, vector).where("centro is not null"), [key], "_num"))
    lost = skew_join(df.join(out, row).select(row, key, vector, "similitud"), means.select(key, "_num"), [key])
    best = best_matches(lost.select(F.col(row).alias("q"), F.col("_num").alias("k0"), F.greatest(F.col("similitud"), F.lit(jump)).alias("piso"), F.col(vector).alias("v")), means.select(F.col("_num").alias("k"), F.col("centro").alias("v")), block)
    named = best.join(means.select(F.col("_num").alias("k"), F.col(key).alias(f"{key}_nueva")), "k").select(F.col("q").alias(row), f"{key}_nueva")
    return out.join(named, row, "left")


def membership(df: DataFrame, key: str, row: str, vector: str, least: float) -> DataFrame:
    """(row, key, pertenece): whether a row is at least ``least`` similar to its key's mean."""
    return skew_join(df.select(key, row, vector), centroids(df, key, vector), [key]).where(F.col(vector).isNotNull()).select(row, key, (cosine(F.col(vector), F.col("centro")) >= least).alias("pertenece"))


def rare_limit(rows: int) -> int:
    """In how many of ``rows`` rows a rare word is at most."""
    return max(2, int(rows * 0.03))


def rare_word_pairs(df: DataFrame, row: str, title: str, vector: str, rows: int, least: float = 0.86) -> DataFrame:
    """(i, j) of rows that share a rare title word, have close vectors and no opposed actions in their titles.

    Rare: in 2 to max(2, 3 % of ``rows``) rows.
    """
    scratch = Scratch(df.sparkSession, "rarewords")
    base = df.select(F.col(row).cast("bigint").alias("k"), F.col(vector).alias("v"), F.col(title).alias("t"))
    words, _ = scratch.save(rare_words(base, "k", "t"))
    rare = words.groupBy("palabra").agg(F.count(F.lit(1)).alias("n")).where(F.col("n").between(2, rare_limit(rows))).select("palabra")
    held = skew_join(words, rare, ["palabra"]).groupBy("id").agg(F.collect_list("palabra").alias("w"))
    told, _ = scratch.save(base.join(held.withColumnRenamed("id", "k"), "k").where("v is not null").select("k", "v", "w", distinctive(F.col("t"), 3).alias("w3")))
    # few rows have close vectors, many share a word: the vectors come first
    near, _ = scratch.save(vector_pairs(told, least).select("a", "b"))
    texts, _ = scratch.save(told.drop("v"))
    scratch.drop(told, words)
    sides = [texts.select(F.col("k").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("w", "w3")]) for x in "ab"]
    both = near.join(sides[0], "a").join(sides[1], "b").where(F.arrays_overlap("w_a", "w_b") & ~action_conflict(F.col("w3_a"), F.col("w3_b")))
    return both.select(F.least("a", "b").alias("i"), F.greatest("a", "b").alias("j"))


#: Pairs up to which one task plays leader clustering.
FEW_PAIRS = 400_000


def _lead(pdf: pd.DataFrame) -> pd.DataFrame:
    later: dict[int, list[int]] = {}
    for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist()):
        later.setdefault(a, []).append(b)
    leader: dict[int, int] = {}
    for i in sorted(set(pdf["a"].tolist()) | set(pdf["b"].tolist())):
        if i not in leader:
            leader[i] = i
            for j in later.get(i, ()):
                leader.setdefault(j, i)
    return pd.DataFrame(sorted(leader.items()), columns=["id", "lider"], dtype="int64")


def leaders(pairs: DataFrame, few: int = FEW_PAIRS) -> DataFrame:
    """(id, lider) of leader clustering in row order: a row not yet taken leads and takes its later partners. ``pairs``: (a, b); rows in no pair are left out.

    Up to ``few`` pairs are one task's. More of them in rounds: a row leads once all its earlier partners are known to be taken; a row is taken by its first
    leading partner once no earlier partner is undecided. No set of look-alikes is one task's.
    """
    scratch = Scratch(pairs.sparkSession, "leaders")
    edges, seen = scratch.save(pairs.select(F.least("a", "b").cast("bigint").alias("a"), F.greatest("a", "b").cast("bigint").alias("b")).where("a != b").distinct())
    if seen["rows"] <= few:
        return edges.groupBy(F.lit("all")).applyInPandas(_lead, "id bigint, lider bigint")
    ids = edges.select(F.col("a").alias("id")).unionAll(edges.select(F.col("b").alias("id"))).distinct()
    done: list[DataFrame] = []
    # open: edges to a row not yet decided; estado of the earlier end: null undecided, its own id leading, another id taken
    left, count = scratch.save(ids)
    live, _ = scratch.save(edges.withColumn("estado", F.lit(None).cast("bigint")))
    while count["rows"]:
        before = live.groupBy("b").agg(F.min(F.when(F.col("estado").isNull(), F.col("a"))).alias("abierto"), F.min(F.when(F.col("estado") == F.col("a"), F.col("a"))).alias("jefe"))
        judged = left.join(before.withColumnRenamed("b", "id"), "id", "left")
        verdict = F.when(F.col("jefe").isNotNull() & (F.col("abierto").isNull() | (F.col("jefe") < F.col("abierto"))), F.col("jefe")).when(F.col("abierto").isNull(), F.col("id"))
        marked, _ = scratch.save(judged.select("id", verdict.alias("lider")))
        took = marked.where("lider is not null")
        done.append(took)
        left, count = scratch.save(marked.where("lider is null").select("id"))
        known = skew_join(live, took.select(F.col("id").alias("a"), "lider"), ["a"], how="left").select("a", "b", F.coalesce("estado", "lider").alias("estado"))
        again, _ = scratch.save(known.join(left.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b", "estado"))
        scratch.drop(live)
        live = again
    out = ids.withColumn("lider", F.col("id")).where("false")
    for d in done:
        out = out.unionByName(d)
    return out


def leader_clusters(pairs: DataFrame) -> DataFrame:
    """(id, lider) of :func:`leaders` in clusters of two rows or more."""
    every, _ = Scratch(pairs.sparkSession, "clusters").save(leaders(pairs))
    many = every.groupBy("lider").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("lider")
    return skew_join(every, many, ["lider"]).select("id", "lider")


def title_leaders(df: DataFrame, row: str = "row_id", title: str = "titulo", theta: float = 0.92, block: int | None = None, already: bool = False) -> DataFrame:
    """(id, lider): leader clusters of nearly equal titles, of two rows or more. Rows of one title go where its first row goes, so only different titles are played."""
    members, pairs = title_classes(df, row, title, theta, block, already)
    ordered = pairs.where((F.col("ab") & (F.col("a") < F.col("b"))) | (F.col("ba") & (F.col("b") < F.col("a")))).select("a", "b")
    heads, _ = Scratch(df.sparkSession, "heads").save(leaders(ordered))
    every, _ = Scratch(df.sparkSession, "heads").save(skew_join(members, heads.withColumnRenamed("id", "k"), ["k"], how="left").select("id", F.coalesce("lider", "k").alias("lider")))
    many = every.groupBy("lider").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("lider")
    return skew_join(every, many, ["lider"]).select("id", "lider")
