"""Resolution by tiers: container, content id, fingerprint, recovered value. Exact or nothing.

Tiers that read only the row itself cost nothing; those that join work on what earlier tiers
left open. All tiers' answers then meet once, and the earliest counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import formats as K
from ..functions import text as T
from . import fingerprint, registry

OUT = ["query_id", "tier", "key", "value", "value_type", "stale", "status"]


def _row(df: DataFrame, tier: str, key, value, kind, stale, status) -> DataFrame:
    return df.select("query_id", F.lit(tier).alias("tier"), key.cast("string").alias("key"), value.alias("value"), kind.alias("value_type"), stale.alias("stale"), status.alias("status"))


def resolve(images: DataFrame, entries: DataFrame, within: int = K.MATCH, count: int = 256, region=None, strict: bool = True, method: str = "auto", lookup=None, tier_order=("container", "content_id", "fingerprint", "value")) -> DataFrame:
    """images(query_id, layer_text, stored_digest, live_digest, t1_text, hash) and the registry to one row for each resolved image.

    layer_text: what the container holds, or null; query_id names one row. strict: a recovered value that looks like a
    content id, or like no known type, is reported as unverified and typed unknown.
    lookup: a function of the open rows that stands in for the registry search and gives
    query_id and key.
    """
    null = F.lit(None).cast("string")
    no = F.lit(False)

    def container(rest):
        hit = rest.where(F.col("layer_text").isNotNull())
        stale = fingerprint.stale(F.col("stored_digest"), F.col("live_digest"))
        return _row(hit, "container", null, F.col("layer_text"), null, stale, F.when(stale, "stale").otherwise("exact"))

    def content_id(rest):
        hit = registry.by_content_id(rest.where("t1_text is not null").select("query_id", "t1_text"), entries.drop("hash"))
        return _row(hit, "content_id", F.col("key"), null, null, no, F.lit("exact"))

    def search(rest):
        if lookup is not None:
            return _row(lookup(rest), "fingerprint", F.col("key"), null, null, no, F.lit("exact"))
        most = 2 if region is None else None  # the first two tell whether the first is in doubt
        known = entries if region is not None else entries.select("key", "reg_ord", "hash")
        found = fingerprint.candidates(rest.where("hash is not null").select("query_id", "hash"), known, within, count, method, most=most)
        hit = fingerprint.verified(found, region) if region is not None else fingerprint.unambiguous(found)
        return _row(hit, "fingerprint", F.col("key"), null, null, no, F.lit("verified"))

    def value(rest):
        hit = rest.where("t1_text is not null")
        text = F.col("t1_text")
        looks = T.infer_type(text) != "text"
        doubt = F.lit(strict) & (text.startswith(K.ID_PREFIX) | ~looks)
        return _row(hit, "value", null, text, F.when(doubt, "unknown").otherwise(T.sniff_value(text)), no, F.when(doubt, "unverified_id").otherwise("exact"))

    steps = {"container": container, "content_id": content_id, "fingerprint": search, "value": value}
    unanswered = {"container": F.col("layer_text").isNull(), "value": F.col("t1_text").isNull()}
    rest, hits = images, []
    for place, name in enumerate(tier_order):
        hit = steps[name](rest)
        hits.append(hit.withColumn("place", F.lit(place)))
        if name in unanswered:
            rest = rest.where(unanswered[name])
        elif any(later not in unanswered for later in tier_order[place + 1 :]):
            rest = rest.join(hit.select("query_id"), "query_id", "left_anti")
    found = reduce(DataFrame.unionByName, hits)
    return found.groupBy("query_id").agg(F.min_by(F.struct(*OUT[1:]), "place").alias("hit")).select("query_id", "hit.*")


def trace(layer, t1, content, candidates) -> "F.Column":
    """What each tier said, in order."""
    return F.array_compact(
        F.array(
            F.when(layer, "container: found").otherwise("container: none"),
            F.when(~layer, F.when(t1, "watermark: decoded").otherwise("watermark: none")),
            F.when(~layer & t1, F.when(content, "content id: known").otherwise("content id: unknown")),
            F.when(~layer & ~content, F.concat(F.lit("fingerprint: "), candidates.cast("string"), F.lit(" candidates"))),
        )
    )
