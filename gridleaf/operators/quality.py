"""Quality scores of pages: five components, overall score, grade, issues, advice."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import with_geometry
from ..functions.text import grade

#: Components in report order, which also breaks ties of best and worst.
COMPONENTS = ("image", "checkbox_detection", "fill_analysis", "text_extraction", "correlations")


@dataclass(frozen=True)
class Thresholds:
    min_checkbox_size: int = 100
    max_checkbox_size: int = 2000
    min_text_confidence: float = 30
    min_correlation_confidence: float = 0.3
    max_correlation_distance: float = 200
    min_fill_confidence: float = 0.4


def detection_issues(boxes: DataFrame, width: int, height: int, t: Thresholds = Thresholds()) -> DataFrame:
    """boxes with flags too_small, too_large, odd_shape, out_of_bounds."""
    b = with_geometry(boxes)
    return b.withColumns({
        "too_small": F.col("area") < t.min_checkbox_size,
        "too_large": F.col("area") > t.max_checkbox_size,
        "odd_shape": ~F.col("aspect_ratio").between(0.5, 2.0),
        "out_of_bounds": (F.col("x") < 0) | (F.col("y") < 0) | (F.col("x") + F.col("w") > width) | (F.col("y") + F.col("h") > height),
    })


def issue_texts(flagged: DataFrame) -> DataFrame:
    """(page_id, box_id, issue): one row an issue, prefixed by its component."""
    name = F.concat(F.lit("[checkbox_detection] Checkbox "), F.col("box_id").cast("string"))
    size = F.concat(F.col("area").cast("string"), F.lit(" pixels"))
    parts = F.array(
        F.when(F.col("too_small"), F.concat(name, F.lit(" too small: "), size)).when(F.col("too_large"), F.concat(name, F.lit(" too large: "), size)),
        F.when(F.col("odd_shape"), F.concat(name, F.lit(" has unusual aspect ratio: "), F.format_string("%.2f", F.col("aspect_ratio")))),
        F.when(F.col("out_of_bounds"), F.concat(name, F.lit(" extends outside image bounds"))),
    )
    return flagged.select("page_id", "box_id", F.explode(F.array_compact(parts)).alias("issue"))


def _fixed(value: str, digits: int):
    """As '%.nf' on the exact binary value; Java's formats round its shortest decimal form."""
    return F.udf(lambda v: None if v is None else f"{v:.{digits}f}", "string")(F.col(value).cast("double"))


def all_issues(stats: DataFrame, flagged: DataFrame, analysed: DataFrame, regions: DataFrame, matches: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """(page_id, issue) of all five components; pages are those of any table.

    stats as of image(), flagged as of detection_issues(), the others as of fill(), text() and
    correlations(). A page without rows of a component has that component's one issue; for a
    page without an image there is none to say.
    """
    def said(df: DataFrame, component: str, *rules: tuple) -> DataFrame:
        parts = F.array(*(F.when(rule, F.concat(F.lit(f"[{component}] "), *(F.lit(x) if isinstance(x, str) else x for x in words))) for rule, *words in rules))
        return df.select("page_id", F.explode(F.array_compact(parts)).alias("issue"))

    c, b = F.col, F.col("box_id").cast("string")
    matched = c("text_id").isNotNull()
    found = [
        said(
            stats, "image",
            ((c("width") < 1000) | (c("height") < 1000), "Low resolution: ", c("width").cast("string"), "x", c("height").cast("string"), " (recommend >1000x1000)"),
            (c("contrast") < 20, "Low contrast: ", _fixed("contrast", 1), " (recommend >20)"),
            ((c("brightness") < 50) | (c("brightness") > 200), "Poor brightness: ", _fixed("brightness", 1), " (recommend 50-200)"),
            (c("blur_score") < 100, "Image appears blurry: ", _fixed("blur_score", 1), " (recommend >100)"),
        ),
        issue_texts(flagged).select("page_id", "issue"),
        said(
            analysed, "fill_analysis",
            (c("confidence").isNull(), "Checkbox ", b, " missing fill analysis"),
            (c("confidence") < t.min_fill_confidence, "Checkbox ", b, " has low fill confidence: ", _fixed("confidence", 3)),
        ),
        said(regions, "text_extraction", (c("confidence") < t.min_text_confidence, "Low confidence text: '", c("text"), "' (", c("confidence").cast("string"), ")")),
        said(
            matches, "correlations",
            (matched & (c("confidence") < t.min_correlation_confidence), "Low confidence correlation for checkbox ", b, ": ", _fixed("confidence", 3)),
            (matched & (c("distance") > t.max_correlation_distance), "Large correlation distance for checkbox ", b, ": ", _fixed("distance", 1), "px"),
            (~matched, "No text match found for checkbox ", b),
        ),
    ]
    tables = [stats, flagged, analysed, regions, matches]
    empty = (None, "[checkbox_detection] No checkboxes detected", "[fill_analysis] No analyzed checkboxes provided", "[text_extraction] No text extracted", "[correlations] No correlations provided")
    pages = tables[0].select("page_id", F.lit(0).alias("k"))
    for k, df in enumerate(tables[1:], 1):
        pages = pages.unionByName(df.select("page_id", F.lit(k).alias("k")))
    pages = pages.groupBy("page_id").agg(F.collect_set("k").alias("ks"))
    missing = F.array(*(F.when(~F.array_contains("ks", k), text) for k, text in enumerate(empty) if text))
    found.append(pages.select("page_id", F.explode(F.array_compact(missing)).alias("issue")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def detection(boxes: DataFrame, width: int, height: int, t: Thresholds = Thresholds()) -> DataFrame:
    f = detection_issues(boxes, width, height, t)
    n = F.count("*")
    out = f.groupBy("page_id").agg(
        n.alias("n"), F.count_if(~F.col("too_small") & ~F.col("too_large")).alias("n_valid"),
        F.sum(F.col("too_small").cast("int") + F.col("too_large").cast("int") + F.col("odd_shape").cast("int") + F.col("out_of_bounds").cast("int")).alias("n_issues"),
        F.avg("area").alias("avg_area"), F.stddev_pop("area").alias("std_area"), F.avg("aspect_ratio").alias("avg_aspect"), F.stddev_pop("aspect_ratio").alias("std_aspect"),
    )
    # the bonus for many boxes is full from four on
    score = F.col("n_valid") / F.col("n") - F.least(F.lit(0.5), F.col("n_issues") * 0.1) + F.least(F.lit(0.2), F.col("n") / 20)
    score = F.greatest(F.lit(0.0), F.least(F.lit(1.0), score))
    return out.withColumn("score", score).withColumn("valid", F.col("score") >= 0.6)


def fill(analysed: DataFrame, t: Thresholds = Thresholds(), order: str | None = None) -> DataFrame:
    """analysed: confidence, filled_score, is_filled of each box.

    With order, a column that tells a page's rows apart, means add up in its order, so that no
    partitioning changes their last digits.
    """
    means = [F.avg("confidence").alias("avg_confidence"), F.avg("filled_score").alias("avg_score")]
    if order:
        means = [F.array_sort(F.collect_list(F.struct(order, "confidence", "filled_score"))).alias("each"), F.count("confidence").alias("n_confidence"), F.count("filled_score").alias("n_score")]
    out = analysed.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") >= t.min_fill_confidence).alias("n_high"),
        F.min("confidence").alias("min_confidence"), F.max("confidence").alias("max_confidence"), F.count_if("is_filled").alias("n_filled"), *means,
    )
    if order:
        total = "aggregate(each, 0D, (a, e) -> a + coalesce(e.{}, 0D)) / nullif({}, 0)"
        out = out.withColumns({"avg_confidence": F.expr(total.format("confidence", "n_confidence")), "avg_score": F.expr(total.format("filled_score", "n_score"))})
    out = out.select("page_id", "n", "n_high", "avg_confidence", "min_confidence", "max_confidence", "avg_score", "n_filled")
    return out.withColumn("score", F.col("avg_confidence") * (F.col("n_high") / F.col("n"))).withColumn("valid", F.col("score") >= 0.5)


def text(regions: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    out = regions.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(F.col("confidence") >= t.min_text_confidence).alias("n_high"), F.avg("confidence").alias("avg_confidence"),
        F.min("confidence").cast("double").alias("min_confidence"), F.max("confidence").cast("double").alias("max_confidence"), F.avg(F.length("text")).alias("avg_length"),
    )
    return out.withColumn("score", (F.col("avg_confidence") / 100.0 + F.least(F.lit(1.0), F.col("n") / 10)) / 2).withColumn("valid", F.col("score") >= 0.4)


def correlations(matches: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Distances of unmatched boxes do not count; a page of none has null distances."""
    matched = F.col("text_id").isNotNull()
    near = F.when(matched, F.col("distance"))
    out = matches.groupBy("page_id").agg(
        F.count("*").alias("n"), F.count_if(matched).alias("n_matched"), F.count_if(matched & (F.col("confidence") >= t.min_correlation_confidence)).alias("n_high"),
        F.avg("confidence").alias("avg_confidence"), F.avg(near).alias("avg_distance"), F.max(near).alias("max_distance"), F.count_if(near > t.max_correlation_distance).alias("n_far"),
    )
    return out.withColumn("match_rate", F.col("n_matched") / F.col("n")).withColumn("score", (F.col("match_rate") + F.col("avg_confidence")) / 2).withColumn("valid", F.col("score") >= 0.5)


def image(stats: DataFrame) -> DataFrame:
    """stats: page_id, width, height, contrast, brightness, blur_score."""
    side = F.least("width", "height")
    bright = F.when(F.col("brightness").between(50, 200), 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - F.abs(F.col("brightness") - 125.0) / 125.0))
    score = (F.least(F.lit(1.0), side / 1000.0) + F.least(F.lit(1.0), F.col("contrast") / 50.0) + bright + F.least(F.lit(1.0), F.col("blur_score") / 200.0)) / 4
    return stats.withColumn("score", score).withColumn("valid", F.col("score") >= 0.6)


def overall(parts: dict[str, DataFrame], every_page: bool = False) -> DataFrame:
    """Pages that all five components have: scores, overall score, validity, grade, best and worst component.

    every_page: pages that any component has; a missing one scores 0 and is not valid.
    """
    out = None
    for name in COMPONENTS:
        one = parts[name].select("page_id", F.col("score").alias(f"{name}_score"), F.col("valid").alias(f"{name}_valid"))
        out = one if out is None else out.join(one, "page_id", "full" if every_page else "inner")
    if every_page:
        out = out.fillna(0.0, [f"{n}_score" for n in COMPONENTS]).fillna(False, [f"{n}_valid" for n in COMPONENTS])
    scores = [F.col(f"{n}_score") for n in COMPONENTS]
    best, worst = F.greatest(*scores), F.least(*scores)
    out = out.withColumn("score", sum(scores[1:], scores[0]) / len(COMPONENTS))
    valid = F.col(f"{COMPONENTS[0]}_valid")
    for n in COMPONENTS[1:]:
        valid = valid & F.col(f"{n}_valid")
    return out.withColumns({
        "valid": valid, "grade": grade(F.col("score")),
        "best": F.coalesce(*(F.when(s == best, n) for s, n in zip(scores, COMPONENTS, strict=True))),
        "worst": F.coalesce(*(F.when(s == worst, n) for s, n in zip(scores, COMPONENTS, strict=True))),
    })


def summary(pages: DataFrame) -> DataFrame:
    """The sentence of each page of overall()."""
    def value(which: str):
        return F.coalesce(*(F.when(F.col(which) == n, F.col(f"{n}_score")) for n in COMPONENTS))

    text_ = F.format_string("Overall quality grade: %s (score: %.3f). Best performing component: %s (%.3f). Needs improvement: %s (%.3f).", "grade", "score", "best", value("best"), "worst", value("worst"))
    return pages.select("page_id", text_.alias("summary"))


#: Advice by component, the score below which it is given, and an image statistic's own condition.
ADVICE = (
    ("image", 0.7, "contrast < 20", "Improve image contrast using image enhancement tools"),
    ("image", 0.7, "blur_score < 100", "Use higher quality scan or reduce motion blur"),
    ("image", 0.7, "least(width, height) < 1000", "Increase scan DPI for better resolution"),
    ("checkbox_detection", 0.7, "true", "Adjust checkbox size range parameters"),
    ("checkbox_detection", 0.7, "true", "Check if form layout is suitable for detection"),
    ("text_extraction", 0.6, "true", "Improve image quality for better OCR results"),
    ("text_extraction", 0.6, "true", "Consider using different OCR settings or preprocessing"),
    ("correlations", 0.6, "true", "Review form layout - checkboxes may be too far from labels"),
    ("correlations", 0.6, "true", "Consider manual verification of checkbox-label pairs"),
)


def recommendations(pages: DataFrame, stats: DataFrame) -> DataFrame:
    """(page_id, ord, recommendation) for pages of overall(); without image statistics none on the image."""
    joined = pages.join(stats.select("page_id", "width", "height", "contrast", "blur_score"), "page_id", "left")
    rows = F.array(*(F.when(F.expr(f"{c}_score < {limit}D and {rule}"), F.struct(F.lit(i).alias("ord"), F.lit(said).alias("recommendation"))) for i, (c, limit, rule, said) in enumerate(ADVICE)))
    return joined.select("page_id", F.explode(F.array_compact(rows)).alias("r")).select("page_id", "r.ord", "r.recommendation")
