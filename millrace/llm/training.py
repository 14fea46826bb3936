"""Bounded labelled samples, and models trained on them in one task."""

from __future__ import annotations

import io
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def id_text(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))


def labelled_sample(docs: DataFrame, labels: DataFrame, by: str, per_class: int, *more: str) -> DataFrame:
    """doc_id, text, ``by`` and ``more`` of at most ``per_class`` rows of each class (0, 1) of ``by``.

    The rows are those of smallest md5 of the id, so the sample doesn't depend on order or size of
    partitions; of several labels or texts of one id the least counts. Its size is bounded by
    ``per_class``, and so are what is broadcast and the training.
    """
    order = F.md5(F.concat(F.lit("sample:"), id_text()))
    rows = labels.where(f"doc_id is not null and {by} is not null").groupBy("doc_id").agg(F.min(F.struct(by, *more)).alias("l")).select("doc_id", "l.*")
    chosen = [rows.where(F.col(by) == c).orderBy(order).limit(per_class) for c in (0, 1)]
    text = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return text.join(F.broadcast(chosen[0].union(chosen[1])), "doc_id").groupBy("doc_id", by, *more).agg(F.min("text").alias("text"))


def fitted(sample: DataFrame, fit: Callable[[pd.DataFrame], dict[str, np.ndarray]]) -> dict[str, np.ndarray]:
    """The arrays that ``fit`` makes of a bounded sample, in one task; the driver gets the model alone."""

    def step(batches):
        rows = list(batches)
        if rows and sum(map(len, rows)):
            out = io.BytesIO()
            np.savez_compressed(out, **fit(pd.concat(rows).sort_values("doc_id").reset_index(drop=True)))
            yield pd.DataFrame({"model": [out.getvalue()]})

    # a shuffle of the bounded sample; coalesce(1) would make one task scan the table that it is drawn from
    got = sample.repartition(1).mapInPandas(step, "model binary").collect()
    if not got:
        return {}
    with np.load(io.BytesIO(bytes(got[0]["model"]))) as z:
        return {k: z[k] for k in z.files}
