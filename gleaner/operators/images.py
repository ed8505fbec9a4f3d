"""Image records: geometry, logos, histograms, classes. No pixels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Limits on sizes and places, in pixels, points or shares of the page.
MIN_W, MIN_H, MAX_ASPECT = 15, 10, 22.0
FULL_PAGE = 0.88
HEADER_BAND, FOOTER_BAND = 0.11, 0.10
BAR_LONG, BAR_THIN = 0.68, 0.075
LOGO_AREA, LOGO_W, FOOTER_FACTOR = 0.06, 0.42, 1.2
SIDE_MARGIN, MARGIN_AREA, MARGIN_DIM = 0.075, 0.04, 0.12
SMALL_AREA, TEXT_PAD = 0.12, 40.0
LOGO_DISTANCE = 14
MIN_BYTES, STRIP_RATIO, MIN_SIDE, MIN_INK, MIN_ENTROPY, MIN_COLORS, BUTTON_SIDE = 2048, 8, 100, 0.05, 3.5, 8, 200

CELL = 128.0  # side of the cells that word boxes and images meet in, in points


def _aspect(a: Column, b: Column) -> Column:
    return F.greatest(a, b) / F.greatest(F.least(a, b), F.lit(1.0))


def image_skip_reason(images: DataFrame) -> DataFrame:
    """First reason to leave an image out; null keeps it. Without a placement rectangle only
    the aspect rules apply. The first page (0) is never taken."""
    rect = F.col("x0").isNotNull()
    measured = images.withColumns({
        "_w": F.col("w").cast("double"), "_h": F.col("h").cast("double"), "_pw": F.col("page_w").cast("double"), "_ph": F.col("page_h").cast("double"),
        "_rw": F.when(rect, F.greatest(F.col("x1") - F.col("x0"), F.lit(0.0))).otherwise(0.0),
        "_rh": F.when(rect, F.greatest(F.col("y1") - F.col("y0"), F.lit(0.0))).otherwise(0.0),
        "_cx": (F.col("x0") + F.col("x1")) / 2, "_cy": (F.col("y0") + F.col("y1")) / 2})
    w, h, pw, ph, rw, rh, cx, cy = (F.col(f"_{c}") for c in ("w", "h", "pw", "ph", "rw", "rh", "cx", "cy"))
    placed = rect & (rw > 0) & (rh > 0)
    measured = measured.withColumn("_area", F.when(placed, rw * rh / F.greatest(pw * ph, F.lit(1.0))).otherwise(0.0))
    area = F.col("_area")
    sized = (w > 0) & (h > 0)
    ew, eh = F.when(w > 0, w).otherwise(rw), F.when(h > 0, h).otherwise(rh)
    side = (cx < pw * SIDE_MARGIN) | (cx > pw * (1 - SIDE_MARGIN))
    reason = (
        F.when(F.col("page") == 0, "first_page")
        .when(sized & ((w < MIN_W) | (h < MIN_H)), "tiny_metadata")
        .when(sized & (_aspect(w, h) > MAX_ASPECT), "extreme_aspect_metadata")
        .when(placed & (area >= FULL_PAGE), "near_fullpage_background")
        .when(placed & (rw >= pw * BAR_LONG) & (rh <= ph * BAR_THIN), "full_width_thin_bar")
        .when(placed & (rh >= ph * BAR_LONG) & (rw <= pw * BAR_THIN), "full_height_thin_bar")
        .when((ew > 0) & (eh > 0) & (_aspect(ew, eh) > MAX_ASPECT), "extreme_aspect_effective")
        .when(rect & (cy < ph * HEADER_BAND) & (area <= LOGO_AREA) & (rw <= pw * LOGO_W), "header_band_small")
        .when(rect & (cy > ph * (1 - FOOTER_BAND)) & (area <= LOGO_AREA * FOOTER_FACTOR), "footer_band_small")
        .when(rect & side & (area <= MARGIN_AREA) & (rw <= pw * MARGIN_DIM) & (rh <= ph * MARGIN_DIM), "margin_decor"))
    return measured.select(*images.columns, reason.alias("skip_reason"))


def _cells(low: Column, high: Column) -> Column:
    return F.sequence(F.floor(low / CELL), F.floor(high / CELL))


def _in_cells(df: DataFrame, x0: Column, y0: Column, x1: Column, y1: Column) -> DataFrame:
    return (df.withColumn("_cx", F.explode(_cells(x0, x1))).withColumn("_cy", F.explode(_cells(y0, y1))))


def orphan_images(images: DataFrame, words: DataFrame, key: tuple[str, ...] = ("doc_id", "page", "image_no")) -> DataFrame:
    """Small images (of ``images``) with no word box near them on a page that has words.

    Boxes and padded images meet in page cells, so a crowded page is several groups, and equal
    boxes are merged first. A cell lying wholly inside a padded image settles the matter by
    its mere presence; only cells on the rim are compared box by box, as a semi join.
    """
    pw, ph = F.col("page_w").cast("double"), F.col("page_h").cast("double")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")) / F.greatest(pw * ph, F.lit(1.0))
    boxes = words.select("doc_id", "page", "x0", "y0", "x1", "y1").where("x1 > x0 AND y1 > y0").distinct()
    pages = words.select("doc_id", "page").distinct()
    padded = {"_ix0": F.col("x0") - TEXT_PAD, "_iy0": F.col("y0") - TEXT_PAD, "_ix1": F.col("x1") + TEXT_PAD, "_iy1": F.col("y1") + TEXT_PAD}
    small = images.where(F.col("x0").isNotNull() & (area < SMALL_AREA)).join(pages, ["doc_id", "page"], "left_semi")
    rects = small.withColumns(padded).select(*key, *padded).distinct()
    spread = _in_cells(rects, F.col("_ix0"), F.col("_iy0"), F.col("_ix1"), F.col("_iy1"))
    inside = ((F.col("_cx") * CELL >= F.col("_ix0")) & ((F.col("_cx") + 1) * CELL <= F.col("_ix1"))
              & (F.col("_cy") * CELL >= F.col("_iy0")) & ((F.col("_cy") + 1) * CELL <= F.col("_iy1")))
    spread = spread.withColumn("_inside", inside)
    placed = _in_cells(boxes, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"))
    # Parts of a box exactly on a cell border have no area in that cell.
    placed = placed.where((F.col("x1") > F.col("_cx") * CELL) & (F.col("y1") > F.col("_cy") * CELL))
    cell = ["doc_id", "page", "_cx", "_cy"]
    full = spread.where("_inside").join(placed.select(*cell).distinct(), cell, "left_semi").select(*key, *padded)
    a, b = spread.where("NOT _inside").alias("a"), placed.alias("b")
    touch = ((F.col("a._ix0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a._ix1")) & (F.col("a._iy0") < F.col("b.y1")) & (F.col("b.y0") < F.col("a._iy1")))
    rim = a.join(b, reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in cell]) & touch, "left_semi").select(*key, *padded)
    near = full.unionByName(rim).distinct()
    return small.withColumns(padded).join(near, [*key, *padded], "left_anti").select(*images.columns, F.lit("no_nearby_text").alias("skip_reason"))


def logo_matches(images: DataFrame, logos: list[tuple[str, int]], threshold: int = LOGO_DISTANCE) -> DataFrame:
    """Whether the perceptual hash of an image is close to a known logo's.

    ``logos`` is configuration, (name, 64-bit hash); without any nothing matches.
    """
    near = [F.bit_count(F.col("phash").bitwiseXOR(F.lit(h).cast("bigint"))) <= threshold for _name, h in logos]
    return images.withColumn("is_logo", reduce(lambda a, b: a | b, near, F.lit(False)))


def histogram_entropy(hist: DataFrame, key: str = "image_id") -> DataFrame:
    """Shannon entropy (bits) per histogram: log2(N) - sum(n log2 n) / N, one partial aggregate."""
    full = F.when(F.col("n") > 0, F.col("n").cast("double"))
    total = F.sum(full)
    return hist.groupBy(key).agg(F.coalesce(F.log2(total) - F.sum(full * F.log2(full)) / total, F.lit(0.0)).alias("entropy"))


def image_class(images: DataFrame) -> DataFrame:
    """skip, button or screenshot from measured columns."""
    w, h = F.col("w"), F.col("h")
    kind = (F.when(F.col("file_size") < MIN_BYTES, "skip").when(_aspect(w, h) > STRIP_RATIO, "skip")
            .when((w < MIN_SIDE) | (h < MIN_SIDE), "skip").when(F.col("ink") < MIN_INK, "skip")
            .when(F.col("entropy") < MIN_ENTROPY, "skip").when(F.col("colors") < MIN_COLORS, "skip")
            .when((w < BUTTON_SIDE) | (h < BUTTON_SIDE), "button").otherwise("screenshot"))
    return images.withColumn("image_class", kind)


def image_class_summary(classed: DataFrame) -> DataFrame:
    c = F.col("image_class")
    return classed.groupBy("doc_id").agg(
        F.count("*").alias("extracted"), F.count_if(c == "button").alias("buttons"),
        F.count_if(c == "screenshot").alias("screenshots"), F.count_if(c == "skip").alias("skipped"))
