"""Problem 5: duplicates hidden by formatting differences.

An incremental ledger: a written table in groups and buckets of the canonical key's hash holds, for each key,
the number of copies so far and the earliest representative. A batch is canonicalised, aggregated (before the
shuffle), and joined with the groups it touches in a full outer join: counts are added, the earlier
representative stays. Groups a batch doesn't touch are neither read nor written.
"""

from __future__ import annotations

import atexit
import json
import unicodedata
import uuid

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

from noticiario.functions.words import decode
from noticiario.operators.skew import HOT_ROWS, HOT_SHARE, skew_join
from noticiario.session import Scratch

_NOISE = regex.compile(r"[^\p{L}\p{N}]+")
#: Keys a group (what a batch reads and writes as a whole) and a bucket (a task of its join) should have; bounds of their numbers.
GROUP_KEYS, BUCKET_KEYS = 1_000_000, 100_000
LEAST_GROUPS, MOST_GROUPS, LEAST_BUCKETS, MOST_BUCKETS = 8, 4096, 4, 2048
#: So many times the keys make the ledger be rewritten with more groups and buckets.
GROW = 8


def canonical(title: str | None) -> str | None:
    """A key that formatting doesn't change; None for a title without letters or digits.

    Entities are decoded twice, accented letters composed, case folded. Only letters and digits count;
    parts between ``|`` count in any order, parts without a letter or digit not at all.
    """
    if not title:
        return None
    s = decode(title)
    if not s.isascii():
        s = unicodedata.normalize("NFC", unicodedata.normalize("NFC", s).casefold())
    else:
        s = s.lower()
    if "|" not in s:
        return _NOISE.sub("", s) or None
    return "|".join(sorted(filter(None, (_NOISE.sub("", p) for p in s.split("|"))))) or None


@pandas_udf(StringType())
def _canonical(s: pd.Series) -> pd.Series:
    return s.map(canonical)


def canonical_key(c: Column) -> Column:
    """128-bit digest of the canonical key; null for a title without letters or digits.

    ASCII titles without entities are done natively, the others in Arrow batches.
    """
    parts = F.transform(F.split(F.lower(c), "[|]"), lambda p: F.regexp_replace(p, "[^a-z0-9]+", ""))
    plain = F.array_join(F.sort_array(F.filter(parts, lambda p: p != "")), "|")
    simple = ~c.rlike("[^\\x00-\\x7f]|&")
    text = F.when(simple, F.nullif(plain, F.lit(""))).otherwise(_canonical(F.when(~simple, c)))
    return F.md5(text.cast("binary"))


class Ledger:
    """A ledger kept under ``path``; whoever opens the path again goes on with it.

    ``gen-*`` are tables partitioned by group (and the batch that wrote it) and bucketed by key, so a batch is
    shuffled to the old side's buckets and the old side isn't shuffled. ``_manifest`` has a file a batch, with
    the version each group has: a batch counts from the moment that file is there, created but never
    overwritten, so of two writers the later one fails. The number of groups and buckets follows the number of
    keys; where they have grown ``GROW`` times too many, the batch rewrites the ledger into a new table.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, group_keys: int = GROUP_KEYS, bucket_keys: int = BUCKET_KEYS):
        self.spark, self.group_keys, self.bucket_keys = spark, group_keys, bucket_keys
        self.scratch = Scratch(spark, "ledger")
        self.path = (path or self.scratch.root + "/ledger").rstrip("/")
        self.tables: dict[int, str] = {}
        self._refresh()

    # ---- the manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _refresh(self) -> None:
        """Reads the latest manifest; an empty ledger has step 0."""
        self.state = {"step": 0, "gen": 0, "groups": 0, "buckets": 0, "keys": 0, "live": {}}
        fs, p = self._fs(f"{self.path}/_manifest")
        if fs.exists(p):
            names = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName().endswith(".json"))
            if names:
                stream = fs.open(self._fs(f"{self.path}/_manifest/{names[-1]}")[1])
                try:
                    self.state = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
                finally:
                    stream.close()

    def _commit(self, state: dict) -> None:
        fs, p = self._fs(f"{self.path}/_manifest/{state['step']:08d}.json")
        out = fs.create(p, False)
        out.write(bytearray(json.dumps(state).encode()))
        out.close()
        self.state = state

    # ---- the tables

    def _table(self, state: dict) -> str:
        gen = state["gen"]
        if gen not in self.tables:
            name = f"ledger_{uuid.uuid4().hex[:12]}"
            key = "spark.sql.hive.manageFilesourcePartitions"
            before = self.spark.conf.get(key)
            self.spark.conf.set(key, "false")  # partitions are found by their folders
            try:
                at = f"{self.path}/gen-{gen}".replace("\\", "\\\\").replace("'", "\\'")
                self.spark.sql(f"create table {name} (clave string, copias bigint, primera bigint, parte string) using parquet options (path '{at}') partitioned by (parte) clustered by (clave) sorted by (clave) into {state['buckets']} buckets")
            finally:
                self.spark.conf.set(key, before)
            self.tables[gen] = name
            atexit.register(self._forget, name)
        self.spark.catalog.refreshTable(self.tables[gen])
        return self.tables[gen]

    def _forget(self, name: str) -> None:
        try:
            self.spark.sql(f"drop table if exists {name}")
        except Exception:  # the session may be gone already
            pass

    def read(self, groups: list[int] | None = None) -> DataFrame | None:
        """(clave, copias, primera) of the groups asked for, or of all; None where there are none yet."""
        live = self.state["live"]
        parts = [v for g, v in live.items() if groups is None or int(g) in groups]
        if not parts:
            return None
        return self.spark.table(self._table(self.state)).where(F.col("parte").isin(*parts)).select("clave", "copias", "primera")

    def add(self, batch: DataFrame, key: str, row: str) -> int:
        """Adds a batch of keyed rows; the number of rows with a key."""
        new = batch.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("clave")).agg(F.count(F.lit(1)).alias("copias"), F.min(row).cast("bigint").alias("primera"))
        new, seen = self.scratch.save(new, total=F.sum("copias"))
        if not seen["rows"]:
            return 0
        state = dict(self.state, live=dict(self.state["live"]), step=self.state["step"] + 1)
        most = state["keys"] + seen["rows"]
        anew = most > GROW * self.group_keys * max(1, state["groups"]) and state["groups"] < MOST_GROUPS
        if not state["groups"] or anew:
            state["groups"] = min(MOST_GROUPS, max(LEAST_GROUPS, -(-most // self.group_keys)))
            state["buckets"] = min(MOST_BUCKETS, max(LEAST_BUCKETS, -(-most // self.bucket_keys)))
            state["gen"] += 1
        group = F.pmod(F.xxhash64("clave"), F.lit(state["groups"])).cast("int")
        touched = range(state["groups"]) if anew else [r[0] for r in new.select(group).distinct().collect()]  # at most MOST_GROUPS
        old = self.read(None if anew else list(touched))
        placed = new.repartition(state["buckets"], "clave")
        if old is not None:
            met = placed.join(old.select("clave", F.col("copias").alias("_c"), F.col("primera").alias("_p")), "clave", "full_outer")
            merged = met.select("clave", (F.coalesce("copias", F.lit(0)) + F.coalesce("_c", F.lit(0))).alias("copias"), F.least("primera", "_p").alias("primera"), F.col("_c").isNull().alias("_nueva"))
        else:
            merged = placed.withColumn("_nueva", F.lit(True))
        tag, watch = f"{state['step']:08d}-{uuid.uuid4().hex[:8]}", Observation()
        out = merged.observe(watch, F.count_if("_nueva").alias("fresh")).select("clave", "copias", "primera", F.concat(group.cast("string"), F.lit(f"-{tag}")).alias("parte"))
        out.write.mode("append").format("parquet").partitionBy("parte").bucketBy(state["buckets"], "clave").sortBy("clave").saveAsTable(self._table(state))
        stale = {int(g): v for g, v in self.state["live"].items() if int(g) in touched or anew}
        gen = self.state["gen"]
        if anew:
            state["live"] = {}
        state["live"].update({str(g): f"{g}-{tag}" for g in touched})
        state["keys"] += watch.get["fresh"]
        self._commit(state)
        for v in stale.values():
            self.scratch._delete(f"{self.path}/gen-{gen}/parte={v}")
        self.scratch.drop(new)
        return seen["total"]


def keyed(df: DataFrame, title: str, row: str, *keep: str) -> DataFrame:
    """The rows with their canonical key (``clave``)."""
    return df.select(row, *keep, canonical_key(F.col(title)).alias("clave"))


def ledger_of(df: DataFrame, title: str, row: str, arrival: str, batches: int = 2) -> tuple[Ledger, DataFrame]:
    """A ledger fed with all rows of ``df`` in batches by order of arrival, and the keyed rows (a written table).

    Batches are bounded by quantiles of ``arrival``; rows without an arrival come in the first one.
    """
    ledger = Ledger(df.sparkSession)
    rows, seen = ledger.scratch.save(keyed(df, title, row, arrival))
    if not seen["rows"]:
        return ledger, rows
    at = F.unix_micros(F.col(arrival).cast("timestamp"))
    cuts = rows.agg(F.percentile_approx(at, [i / batches for i in range(1, batches)], 1000)).first()[0] or []
    bounds = [None, *sorted(set(cuts)), None]
    for lo, hi in zip(bounds, bounds[1:]):
        part = rows
        if lo is not None:
            part = part.where(at >= lo)
        if hi is not None:
            part = part.where((at < hi) | (at.isNull() & F.lit(lo is None)))
        ledger.add(part, "clave", row)
    return ledger, rows


def copies(df: DataFrame, title: str = "titulo", row: str = "row_id", arrival: str = "cargado") -> DataFrame:
    """(clave, primera_row_id, copias): one record for each distinct title, from the ledger."""
    ledger, rows = ledger_of(df, title, row, arrival)
    book = ledger.read()
    if book is None:
        return rows.where("false").select("clave", F.col(row).alias("primera_row_id"), F.lit(0).cast("bigint").alias("copias"))
    return book.select("clave", F.col("primera").alias("primera_row_id"), "copias")


def repeated_rows(df: DataFrame, title: str = "titulo", row: str = "row_id", arrival: str = "cargado") -> DataFrame:
    """(row_id, primera_row_id) of every row whose title at least one other row has."""
    ledger, rows = ledger_of(df, title, row, arrival)
    book = ledger.read()
    if book is None:
        return rows.where("false").select(row, F.col(row).alias("primera_row_id"))
    many, _ = ledger.scratch.save(book.where("copias >= 2").select("clave", "copias", F.col("primera").alias("primera_row_id")))
    total = many.agg(F.sum("copias")).first()[0] or 0
    floor = max(int(total * HOT_SHARE), HOT_ROWS)
    hot = [tuple(r) for r in many.where(F.col("copias") >= floor).select("clave").collect()]  # at most 1 / HOT_SHARE
    return skew_join(rows.select(row, "clave"), many.drop("copias"), ["clave"], hot=hot).select(row, "primera_row_id")
