"""Quality of a text by the dictionary that compresses it better."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, whole


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Weights, intercept last, of a logistic regression by Newton steps."""
    rows = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(rows.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-9
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        gradient = rows.T @ (p - y) + penalty * w
        curve = (rows * (p * (1 - p))[:, None]).T @ rows + np.diag(penalty + 1e-9)
        step = np.linalg.solve(curve, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


@dataclass
class CompressionModel:
    """Two dictionaries and the curve from their difference to a score."""

    good: bytes
    bad: bytes
    slope: float
    intercept: float
    level: int = 3

    def coders(self):
        """One compressor per dictionary; no header fields, so that only content counts."""
        import zstandard

        def coder(raw: bytes):
            known = zstandard.ZstdCompressionDict(raw) if raw else None
            if known is not None:
                known.precompute_compress(level=self.level)
            return zstandard.ZstdCompressor(
                level=self.level, dict_data=known, write_checksum=False,
                write_content_size=False, write_dict_id=False)

        return coder(self.good), coder(self.bad)

    @staticmethod
    def difference(coders, text: str | None) -> float:
        """(size under the bad dictionary - size under the good one) / bytes of text."""
        raw = (text or "").encode("utf-8", "replace")
        if not raw:
            return 0.0
        good, bad = coders
        return (len(bad.compress(raw)) - len(good.compress(raw))) / len(raw)

    def score(self, difference: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.slope * difference + self.intercept))))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int,
                    max_bytes: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """At most `max_rows` labelled rows for fitting: (id, body, y, order).

    Rows of the held-out fold, without label and with texts over `max_bytes` (for
    fitting only) are left out. Which rows are taken is fixed by a hash of the id.
    """
    chosen = (labels.where(~held_out(id_col)).where(F.col(label).isNotNull())
              .select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y"),
                      F.xxhash64(F.col(id_col).cast("string"), F.lit("fit")).alias("order"))
              .orderBy("order", "id", "y").limit(max_rows))
    texts = docs.select(F.col(id_col).alias("doc"), whole(text_col).alias("body")).where(
        F.octet_length("body") <= max_bytes)
    # The limit above bounds the rows of this side.
    return texts.join(F.broadcast(chosen), texts.doc == chosen.id).select(
        "id", "body", "y", "order")


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                label: str = "quality", max_rows: int = 6000, max_bytes: int = 16_384,
                dictionary_bytes: int = 112_640, level: int = 3) -> CompressionModel:
    """Fit on a bounded sample of labelled rows (`max_rows` of at most `max_bytes` each).

    Every other row of the sample builds the dictionaries, the others calibrate. With
    labels of one kind, or none, the dictionary of the missing kind is empty and the
    curve is flat at the share of good rows.
    """
    import zstandard

    rows = sorted(labelled_sample(docs, labels, label, max_rows, max_bytes, id_col, text_col)
                  .collect(), key=lambda r: (r["order"], r["id"], r["body"]))
    fit, rest = rows[::2], rows[1::2]

    def dictionary(kind: int) -> bytes:
        samples = [r["body"].encode("utf-8", "replace") for r in fit if r["y"] == kind]
        samples = [s for s in samples if s]
        if not samples:
            return b""
        try:
            return zstandard.train_dictionary(dictionary_bytes, samples, level=level).as_bytes()
        except zstandard.ZstdError:  # too few samples to choose from: they are the dictionary
            return b"".join(samples)[-dictionary_bytes:]

    model = CompressionModel(dictionary(1), dictionary(0), 0.0, 0.0, level)
    share = (sum(r["y"] for r in rows) + 1) / (len(rows) + 2)
    model.intercept = math.log(share / (1 - share))
    kinds = {r["y"] for r in rest}
    if len(kinds) == 2 and model.good and model.bad:
        coders = model.coders()
        x = np.array([[model.difference(coders, r["body"])] for r in rest if r["body"]])
        y = np.array([r["y"] for r in rest if r["body"]], dtype=float)
        w = logistic_fit(x, y)
        model.slope, model.intercept = float(w[0]), float(w[1])
    return model


def quality_scores(docs: DataFrame, model: CompressionModel, id_col: str = "doc_id",
                   text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, difference, score (0 to 1), predicted.

    Every text is compressed whole under both dictionaries in the task that reads it;
    there is no shuffle. NULL and empty texts have difference 0 and the score at that
    point. NULL ids count as held out; repeated rows get equal scores; other columns
    are not read.
    """
    def differences(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coders = model.coders()
        for batch in texts:
            yield batch.map(lambda t: model.difference(coders, t)).astype("float64")

    compare = F.pandas_udf(differences, "double", F.PandasUDFType.SCALAR_ITER)
    power = F.greatest(F.lit(-30.0), F.least(F.lit(30.0),
                       F.col("difference") * model.slope + model.intercept))
    return (docs.select(F.col(id_col), held_out(id_col).alias("held_out"),
                        compare(whole(text_col)).alias("difference"))
            .withColumn("score", 1 / (1 + F.exp(-power)))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
