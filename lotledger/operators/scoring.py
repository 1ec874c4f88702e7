"""Batch scoring gates over page statistics and class probabilities."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE_PIXEL = 235
PAGE_WHITE_MAX = 0.5
PAGE_COLOUR_MIN = 1.4
PHOTO_MIN_CONFIDENCE = 0.6


def page_statistics(pages: DataFrame) -> DataFrame:
    """``doc, page, white_fraction, colourfulness`` of page images (``doc, page,
    image``), decoded inside the tasks."""

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np
        from PIL import Image

        for batch in batches:
            rows = []
            for doc, page, blob in batch[["doc", "page", "image"]].itertuples(index=False):
                with Image.open(io.BytesIO(blob)) as picture:
                    grey = np.asarray(picture.convert("L"))
                    rgb = np.asarray(picture.convert("RGB")).astype("int16")
                spread = np.ptp(rgb, axis=2)
                rows.append((doc, page, float(np.mean(grey > WHITE_PIXEL)), float(np.mean(spread))))
            yield pd.DataFrame(rows, columns=["doc", "page", "white_fraction", "colourfulness"])

    return pages.select("doc", "page", "image").mapInPandas(
        measure, "doc string, page int, white_fraction double, colourfulness double"
    )


def is_photo_page(white_fraction: Column, colourfulness: Column) -> Column:
    return (white_fraction < PAGE_WHITE_MAX) & (colourfulness >= PAGE_COLOUR_MIN)


def spec_page_boundary(pages: DataFrame) -> DataFrame:
    """Pages to keep per document: up to the first pair of photo pages after page
    one, else all. ``pages``: ``doc, page`` (from 0, no gaps), ``photo``.

    The neighbour test is an equality join of a page with its successor, and the
    boundary a minimum, so long documents are not gathered.
    """
    photo = pages.filter("photo AND page >= 1").select("doc", "page")
    pair = photo.join(photo.select("doc", (F.col("page") - 1).alias("page")), ["doc", "page"]).groupBy("doc").agg(
        F.min("page").alias("first_pair")
    )
    return (
        pages.groupBy("doc").agg(F.count("*").alias("n_pages")).join(pair, "doc", "left")
        .select("doc", "n_pages", F.coalesce("first_pair", "n_pages").alias("boundary"))
    )


def gate_photos(
    photos: DataFrame, names: dict[int, str], probs: str = "probs", threshold: float = PHOTO_MIN_CONFIDENCE
) -> DataFrame:
    """Add ``confidence``, ``label`` (null below the threshold) and ``slot``."""
    p = F.col(probs)
    word = F.lit(None).cast("string")
    at = F.array_position(p, F.array_max(p)) - 1
    for index, name in names.items():
        word = F.when(at == index, F.lit(name.lower())).otherwise(word)
    confidence = F.array_max(p)
    return (
        photos.withColumn("confidence", confidence)
        .withColumn("label", F.when(confidence >= F.lit(threshold).cast("float"), word))
        .withColumn("slot", F.when(F.col("label").isin("exterior", "interior"), F.col("label")).otherwise("unclassified"))
    )


def photo_slots(gated: DataFrame) -> DataFrame:
    """Photo counts per car and slot; the photos themselves stay rows."""
    return gated.groupBy("car").agg(
        *[F.count_if(F.col("slot") == s).alias(s) for s in ("exterior", "interior", "unclassified")]
    )


def classify_images(images: DataFrame, load_model: Callable[[], Callable[[list[bytes]], list[list[float]]]]) -> DataFrame:
    """Class probabilities of ``car, photo, image`` with a model the caller supplies.
    ``load_model`` runs once per task and returns a batch scorer."""

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = load_model()
        for batch in batches:
            yield batch[["car", "photo"]].assign(probs=model(list(batch["image"])))

    return images.select("car", "photo", "image").mapInPandas(score, "car string, photo string, probs array<float>")
