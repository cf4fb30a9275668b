"""Recognition backends. Engines are pluggable; none is installed here."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.boxes import PAGE, merge_engines

#: polygon results of an engine: one row for each text found
RESULT_SCHEMA = "doc_id bigint, page_num bigint, polygon array<struct<x:double,y:double>>, text string, confidence double"
Engine = Callable[[bytes], list[tuple[list[tuple[float, float]], str, float]]]
ENGINES: dict[str, tuple[Callable[[str], Engine], float]] = {}


def register_engine(name: str, start: Callable[[str], Engine], least_confidence: float) -> None:
    """``start(language)`` builds the engine once for each task; results under ``least_confidence`` are dropped."""
    ENGINES[name] = (start, least_confidence)


def polygon_box(polygon: Column) -> list[Column]:
    """Box of a polygon, cut to whole numbers."""
    xs, ys = F.transform(polygon, lambda p: p["x"]), F.transform(polygon, lambda p: p["y"])
    return [c.cast("int").cast("double").alias(n) for n, c in (("x0", F.array_min(xs)), ("y0", F.array_min(ys)), ("x1", F.array_max(xs)), ("y1", F.array_max(ys)))]


def blocks_of(results: DataFrame, least_confidence: float) -> DataFrame:
    """Blocks from an engine's results: doc_id, page_num, block_idx, box, text, source, font_size."""
    rows = results.where(F.col("confidence") >= least_confidence)
    idx = F.row_number().over(_by_page().orderBy(F.monotonically_increasing_id())) - 1
    return rows.select(*PAGE, idx.alias("block_idx"), *polygon_box(F.col("polygon")), "text", F.lit("ocr").alias("source"), F.lit(0.0).alias("font_size"))


def _by_page():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy(*PAGE)


def recognise(pages: DataFrame, engine: str, language: str = "ja") -> DataFrame:
    """Results of one engine over page images (doc_id, page_num, image). An engine that fails on a page finds nothing there."""
    start, _ = ENGINES[engine]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        read = start(language)
        for batch in batches:
            rows = []
            for doc_id, page_num, image in batch.itertuples(index=False):
                try:
                    found = read(bytes(image)) if image is not None else []
                except Exception:  # noqa: BLE001  an engine's failure must not lose the other pages
                    found = []
                rows += [(doc_id, page_num, [{"x": float(x), "y": float(y)} for x, y in polygon], text, float(c)) for polygon, text, c in found]
            yield pd.DataFrame(rows, columns=["doc_id", "page_num", "polygon", "text", "confidence"])

    return pages.select(*PAGE, "image").mapInPandas(run, RESULT_SCHEMA)


def recognise_with(pages: DataFrame, engines: list[str], language: str = "ja") -> DataFrame:
    """Blocks of one engine, or of several without doubles."""
    parts = [blocks_of(recognise(pages, e, language), ENGINES[e][1]) for e in engines]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return merge_engines(union) if len(parts) > 1 else union


def recognise_as(pages: DataFrame, engine: str, language: str = "ja", first: str = "easyocr", second: str = "paddle") -> DataFrame:
    """Blocks by the option ``ocr_engine``: 'both' unites the two engines, the name of the second takes it alone, anything else the first."""
    return recognise_with(pages, [first, second] if engine == "both" else [second] if engine == second else [first], language)
