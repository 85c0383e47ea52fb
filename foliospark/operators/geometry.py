"""Boxes on pages: overlap, suppression, font sizes, columns, paragraphs."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from foliospark.session import ship_package


def box_of(g: Column) -> Column:
    """Box of a geometry: of a rectangle, or around its points; null without either."""
    xs, ys = F.transform(g["points"], lambda p: p["x"].cast("double")), F.transform(g["points"], lambda p: p["y"].cast("double"))
    around = F.struct(F.array_min(xs).alias("x0"), F.array_min(ys).alias("y0"), F.array_max(xs).alias("x1"), F.array_max(ys).alias("y1"))
    side = lambda a, b: (g[a] + g[b]).cast("double")
    plain = F.struct(g["left"].cast("double").alias("x0"), g["top"].cast("double").alias("y0"), side("left", "width").alias("x1"), side("top", "height").alias("y1"))
    return F.when(g["left"].isNotNull(), plain).when(F.size(g["points"]) > 0, around)


def area(b: Column) -> Column:
    return F.greatest(b["x1"] - b["x0"], F.lit(0.0)) * F.greatest(b["y1"] - b["y0"], F.lit(0.0))


def intersection(a: Column, b: Column) -> Column:
    w = F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"])
    h = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    return F.greatest(w, F.lit(0.0)) * F.greatest(h, F.lit(0.0))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    union = area(a) + area(b) - intersection(a, b)
    return F.when(union > 0, intersection(a, b) / union).otherwise(0.0)


def intersection_ratio(a: Column, b: Column) -> Column:
    """The part of ``a`` that ``b`` covers."""
    return F.when(area(a) > 0, intersection(a, b) / area(a)).otherwise(0.0)


def contains(a: Column, b: Column) -> Column:
    return (a["x0"] <= b["x0"]) & (a["y0"] <= b["y0"]) & (a["x1"] >= b["x1"]) & (a["y1"] >= b["y1"])


def weighted_distance(a: Column, b: Column) -> Column:
    """Distance of the centres, vertical steps counting less than horizontal ones."""
    dx = (a["x0"] + a["x1"]) / 2 - (b["x0"] + b["x1"]) / 2
    dy = (a["y0"] + a["y1"]) / 2 - (b["y0"] + b["y1"]) / 2
    return 5.0 * F.abs(dx) + F.abs(dy)


def merged(a: Column, b: Column) -> Column:
    return F.struct(
        F.least(a["x0"], b["x0"]).alias("x0"), F.least(a["y0"], b["y0"]).alias("y0"), F.greatest(a["x1"], b["x1"]).alias("x1"), F.greatest(a["y1"], b["y1"]).alias("y1")
    )


def box_iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    both = max(w, 0) * max(h, 0)
    union = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - both
    return both / union if union > 0 else 0.0


def suppress(boxes: list[tuple], scores: list[float], threshold: float = 0.5) -> list[int]:
    """Greedy non-maximum suppression: the places of the boxes that stay, the best first."""
    keep: list[int] = []
    for k in sorted(range(len(boxes)), key=lambda j: (-scores[j], j)):
        if all(box_iou(boxes[k], boxes[j]) <= threshold for j in keep):
            keep.append(k)
    return keep


def suppress_boxes(df: DataFrame, keys: list[str], id_col: str, box: Column, score: Column, threshold: float = 0.5) -> DataFrame:
    """Greedy non-maximum suppression inside each group of ``keys`` (a page): the keys, id and score of the boxes that stay.

    Null boxes are left out, null scores come last, ties go to the smaller id.
    """
    ship_package(df.sparkSession)
    rows = df.select(*keys, df[id_col].alias("id"), box.alias("box"), F.coalesce(score, F.lit(float("-inf"))).alias("score")).where(F.col("box").isNotNull())
    rows = rows.select(*keys, "id", "box.x0", "box.y0", "box.x1", "box.y1", "score")

    def run(page: pd.DataFrame) -> pd.DataFrame:
        page = page.sort_values("id")
        keep = suppress(list(page[["x0", "y0", "x1", "y1"]].itertuples(index=False, name=None)), list(page["score"]), threshold)
        return page.iloc[keep][[*keys, "id", "score"]]

    return rows.groupBy(*keys).applyInPandas(run, rows.select(*keys, "id", "score").schema)


def heading_levels_of(df: DataFrame, doc_col: str, id_col: str, size: Column, text: Column, k: int = 4) -> DataFrame:
    """Heading level of every block of a document by the cluster of its font size: doc, id, cluster, level. Null sizes are left out."""
    ship_package(df.sparkSession)
    rows = df.select(df[doc_col].alias("doc"), df[id_col].alias("id"), size.cast("double").alias("size"), F.coalesce(F.length(text), F.lit(0)).alias("n")).where("size IS NOT NULL")

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values("id")
        sizes = list(doc["size"])
        return pd.DataFrame({"doc": doc["doc"], "id": doc["id"], "cluster": font_clusters(sizes, k), "level": heading_levels(sizes, list(doc["n"]), k)})

    return rows.groupBy("doc").applyInPandas(run, "doc bigint, id bigint, cluster int, level int")


def nearest_band(df: DataFrame, keys: list[str], id_col: str, place: Column, width: float = 50.0) -> DataFrame:
    """The nearest band of each place within its group: bands are the smallest places of all stretches of ``width``.

    The keys, id, band, distance. Ties go to the smaller band; null places are left out. The bands of a group are few, so
    they are kept as one array beside each row instead of a join of rows with rows.
    """
    rows = df.select(*keys, df[id_col].alias("id"), place.cast("double").alias("place")).where("place IS NOT NULL")
    firsts = rows.groupBy(*keys, F.floor(F.col("place") / width).alias("stretch")).agg(F.min("place").alias("band"))
    bands = firsts.groupBy(*keys).agg(F.collect_list("band").alias("bands"))
    near = F.array_min(F.transform("bands", lambda b: F.struct(F.abs(b - F.col("place")).alias("distance"), b.alias("band"))))
    return rows.join(bands, keys).withColumn("n", near).select(*keys, "id", "n.band", "n.distance")


def font_clusters(sizes: list[float], k: int = 4, rounds: int = 100) -> list[int]:
    """Cluster number of each font size by k-means in one dimension, the largest size first."""
    distinct = sorted(set(sizes), reverse=True)
    k = min(k, len(distinct))
    if k == 0:
        return []
    centres = [distinct[round(j * (len(distinct) - 1) / max(1, k - 1))] for j in range(k)]
    for _ in range(rounds):
        groups: list[list[float]] = [[] for _ in centres]
        for s in sizes:
            groups[min(range(k), key=lambda j: (abs(centres[j] - s), j))].append(s)
        new = [sum(g) / len(g) if g else c for g, c in zip(groups, centres, strict=True)]
        if all(math.isclose(a, b) for a, b in zip(new, centres, strict=True)):
            break
        centres = new
    order = {j: r for r, j in enumerate(sorted(range(k), key=lambda j: -centres[j]))}
    return [order[min(range(k), key=lambda j: (abs(centres[j] - s), j))] for s in sizes]


def heading_levels(sizes: list[float], lengths: list[int], k: int = 4) -> list[int]:
    """Heading level of each block by font size: 0 for the cluster with most text and all below it, 1 for the largest above."""
    own = font_clusters(sizes, k)
    text: dict[int, int] = {}
    for c, n in zip(own, lengths, strict=True):
        text[c] = text.get(c, 0) + n
    body = max(text, key=lambda c: (text[c], -c)) if text else 0
    return [min(c + 1, 6) if c < body else 0 for c in own]


def column_breaks(lefts: list[float], rights: list[float], width: float, least: int = 10) -> list[float]:
    """Middles of vertical gaps of at least 4 % of the width with enough objects on both sides."""
    spans = sorted(zip(lefts, rights, strict=True))
    out, reach, seen = [], None, 0
    for a, b in spans:
        if reach is not None and a - reach >= 0.04 * width and seen >= least and len(spans) - seen >= least:
            out.append((a + reach) / 2)
        reach = b if reach is None else max(reach, b)
        seen += 1
    return out


def merge_paragraphs(df: DataFrame, doc_col: str, order_col: str, text_col: str) -> DataFrame:
    """Lines of each document joined to paragraphs: a line goes on where the one before ends no sentence and this starts small.

    doc, paragraph_no (from 0), text. Null lines are skipped.
    """
    w = Window.partitionBy("doc").orderBy("o")
    rows = df.select(df[doc_col].alias("doc"), df[order_col].alias("o"), df[text_col].alias("t")).where(F.trim("t") != "")
    before = F.lag("t").over(w)
    new = before.isNull() | before.rlike(r"[.!?:]\s*$") | ~F.col("t").rlike(r"^\s*\p{Ll}")
    rows = rows.withColumn("new", new.cast("int")).withColumn("paragraph_no", F.sum("new").over(w) - 1)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "t"))), lambda x: F.trim(x["t"])), " ")
    return rows.groupBy("doc", "paragraph_no").agg(text.alias("text"))


def dpi_for(width: Column, height: Column, target: int = 300, longest: int = 4096) -> Column:
    """Dots per inch for a page in points so that no side exceeds the longest; 72 at least, the target at most."""
    side = F.greatest(width, height) / 72.0
    return F.greatest(F.lit(72), F.least(F.lit(target), F.floor(longest / side).cast("int")))


def attach_to_pages(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Pages with their items (tables or images) as an array, joined by document and page number; pages without items have none."""
    lists = items.groupBy("id", "page_number").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return pages.join(lists, ["id", "page_number"], "left").withColumn("items", F.coalesce("items", F.array().cast(lists.schema["items"].dataType)))
