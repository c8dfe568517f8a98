"""A bounded, reproducible sample of labelled rows, for fitting a model on the driver."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import sized


def sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, longest: int, where: Column | None = None) -> list[tuple[str, int]]:
    """Up to about `rows` (text, label) pairs, as many of each class as there are, of texts up to `longest` characters, in order of a hash of their ids.

    A share of each class's ids is kept by hash, so that what reaches the driver is bounded by rows * longest whatever the table's size.
    Rows with null ids, texts or labels are left out.
    """
    lab = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col(label).cast("int").alias("_y")).dropna().dropDuplicates(["_id"])
    if where is not None:
        lab = lab.where(where)
    counts = {r[0]: r[1] for r in lab.groupBy("_y").count().collect()}
    if not counts:
        return []
    each = rows // len(counts)
    share = F.create_map(*[x for y, n in counts.items() for x in (F.lit(y), F.lit(int(min(1.0, each / n) * 1e9)))])
    kept = lab.where(F.pmod(F.xxhash64("_id", F.lit(3)), F.lit(10**9)) < F.try_element_at(share, F.col("_y")))
    text = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).dropna().where(F.char_length("_text") <= longest)
    got = text.join(sized(kept, 2 * rows + 1000), "_id").select("_text", "_y", F.xxhash64("_id", F.lit(5)).alias("h")).limit(2 * rows)
    found = sorted(got.collect(), key=lambda r: (r["h"], math.copysign(r["_y"], 1), r["_text"]))
    return [(r["_text"], r["_y"]) for r in found]
