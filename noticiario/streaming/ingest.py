"""Clippings as they arrive: the normalisation is a narrow projection, so it runs on a stream as it is.

The compared system has no streaming; this is what running its ingestion continuously takes here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noticiario.functions.labels import key_norm, url_norm
from noticiario.operators.dossier import explode_mentions, normalize


def normalize_stream(clippings: DataFrame, regions: DataFrame, outlets: DataFrame) -> DataFrame:
    """A stream of normalised rows, one a mentioned company."""
    return explode_mentions(normalize(clippings, regions, outlets))


def first_links(clippings: DataFrame, at: str = "cargado", delay: str = "30 days") -> DataFrame:
    """The first clipping of each (link, outlet) within the watermark; rows without a link pass. State is bounded by ``delay``."""
    key = F.concat_ws("\x1f", url_norm(F.col("url_nota")), key_norm(F.col("medio")))
    linked = F.coalesce(url_norm(F.col("url_nota")), F.lit("")) != ""
    keyed = clippings.withColumn("_k", F.when(linked, key).otherwise(F.concat(F.lit("row:"), F.col("row_id").cast("string"))))
    return keyed.withWatermark(at, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")
