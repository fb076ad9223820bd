"""Authoring: images and definitions to carriers with layers, marks and registry entries."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats as K
from ..sources import containers, images
from . import fingerprint, layers, watermark


def _pixels(rasters: DataFrame) -> DataFrame:
    """Canonical raster, mark, hash, region hash and PNG bytes of each image."""

    def run(frames):
        for pdf in frames:
            rows = []
            for r in pdf.itertuples():
                px = np.frombuffer(r.rgba, np.uint8).reshape(r.h, r.w, 4)
                if r.payload is not None:
                    px, _ = watermark.embed(images.canonical(px), r.payload)
                grey = watermark.luma(px)
                words = fingerprint.phash_words(fingerprint.shrunk(grey)[None])[0]
                region = None
                if r.region is not None:
                    a, b, c, d = fingerprint.region_box(r.region, px.shape[1], px.shape[0])
                    region = fingerprint.phash_words(fingerprint.shrunk(grey[b:d, a:c])[None])[0]
                rows.append((r.image_id, images.to_png(px), words, region))
            yield pd.DataFrame(rows, columns=["image_id", "content", "hash", "region_hash"])

    return rasters.mapInPandas(run, "image_id long, content binary, hash array<long>, region_hash array<long>")


def write(rasters: DataFrame, definitions: DataFrame, t1: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """rasters(image_id, w, h, rgba), definitions(image_id, contentId, permissions, textLayer).

    Gives carriers(image_id, content, status), registry entries(key, hash, region_hash,
    region, content_id, layer) and rejected(image_id, errors). An invalid definition is
    rejected whole.
    """
    d = rasters.select("image_id", "w", "h").join(definitions, "image_id")
    d = d.withColumn("textLayer", layers.in_percent(F.col("textLayer"), F.col("w"), F.col("h")))
    own = layers.validated(layers.exploded(d)).where(F.size("errors") > 0).groupBy("image_id").agg(F.array_sort(F.flatten(F.collect_list("errors"))).alias("of_objects"))
    d = d.withColumn("of_layer", layers.layer_errors(F.col("textLayer"), F.col("permissions"))).join(own, "image_id", "left")
    d = d.withColumn("errors", F.concat("of_layer", F.coalesce("of_objects", F.array().cast("array<string>"))))
    rejected = d.where(F.size("errors") > 0).select("image_id", "errors")
    d = d.where(F.size("errors") == 0)
    d = d.withColumn("content_id", F.coalesce("contentId", F.concat(F.lit(K.ID_PREFIX), F.lower(F.conv(F.col("image_id").cast("string"), 10, 36)))))
    d = d.withColumn("carry", layers.payload_choice(F.col("textLayer"), F.col("content_id")) if t1 else F.lit(None).cast("struct<text:string,mode:string>"))
    d = d.withColumn("region", layers.region_bounds(F.col("textLayer")))
    made = _pixels(rasters.join(d.select("image_id", layers.payload_bytes(F.col("carry.text")).alias("payload"), "region"), "image_id").select("image_id", "w", "h", "rgba", "payload", "region"))
    full = d.join(made, "image_id")
    layer = F.to_json(
        F.struct(
            F.lit(K.VERSION).alias(K.VERSION_FIELD),
            F.col("content_id").alias("contentId"),
            fingerprint.words_hex(F.col("hash")).alias("pixelDigest"),
            layers.binding(F.col("carry").isNotNull(), F.lit(True), F.col("carry.mode")).alias("binding"),
            F.struct(F.col("w").alias("width"), F.col("h").alias("height")).alias("image"),
            "permissions",
            "textLayer",
        )
    )
    full = full.withColumn("layer", layer)
    carriers = containers.write(full.select("image_id", "content", "layer")).select("image_id", "content", "status")
    entries = full.select(fingerprint.words_hex(F.col("hash")).alias("key"), "hash", "region_hash", "region", "content_id", "layer")
    return carriers, entries, rejected
