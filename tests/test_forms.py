"""Form operators on hand-built rows, and greedy steps against plain loops on random boxes."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridleaf.functions import fill as fills
from gridleaf.functions import geometry as g
from gridleaf.functions.text import ANSWER_NAMES, answer_columns, category, clean, clean_name, grade
from gridleaf.operators import boxes as bx
from gridleaf.operators import correlate as co
from gridleaf.operators import mapping as mp
from gridleaf.operators import measure as ms
from gridleaf.operators import quality as qu
from gridleaf.operators import text as tx
from gridleaf.operators import vision as vi
from gridleaf.sources import readers, sinks

BOX = "page_id long, box_id long, x long, y long, w long, h long, fill_score double, is_filled boolean"


def make(spark, rows):
    return spark.createDataFrame([(p, b, x, y, w, h, s, s > 0.15) for p, b, x, y, w, h, s in rows], BOX)


def random_boxes(seed: int, pages: int = 6, n: int = 25):
    r = random.Random(seed)
    return [(p, b, r.randint(0, 120), r.randint(0, 120), r.randint(10, 40), r.randint(10, 40), r.randint(0, 5) / 10) for p in range(pages) for b in range(r.randint(1, n))]


def _ratio(a, b, union=False):
    w = max(0, min(a[2] + a[4], b[2] + b[4]) - max(a[2], b[2]))
    h = max(0, min(a[3] + a[5], b[3] + b[5]) - max(a[3], b[3]))
    under = a[4] * a[5] + b[4] * b[5] - w * h if union else min(a[4] * a[5], b[4] * b[5])
    return w * h / under


@pytest.mark.parametrize("seed", [1, 2])
def test_overlap_removal_is_greedy(spark, seed):
    rows = random_boxes(seed)
    want = {}
    for p in {r[0] for r in rows}:
        kept = []
        for b in sorted((r for r in rows if r[0] == p), key=lambda r: -r[6]):
            if not any(_ratio(b, k) > 0.5 for k in kept):
                kept.append(b)
        want |= {(p, k[1]): i + 1 for i, k in enumerate(kept)}
    got = {(r.page_id, r.box_id): r.seq for r in bx.remove_overlaps(make(spark, rows)).where("kept").collect()}
    assert got == want


def test_removed_box_removes_no_other(spark):
    rows = [(1, 0, 0, 0, 20, 20, 0.9), (1, 1, 8, 0, 20, 20, 0.5), (1, 2, 16, 0, 20, 20, 0.4)]
    assert {r.box_id for r in bx.without_overlaps(make(spark, rows)).collect()} == {0, 2}


@pytest.mark.parametrize("seed", [3, 4])
def test_merge_of_two_detectors(spark, seed):
    rows = random_boxes(seed)
    one, two = [r for r in rows if r[1] % 2 == 0], [r for r in rows if r[1] % 2]
    want = set()
    for p in {r[0] for r in rows}:
        a, b = ([r for r in x if r[0] == p] for x in (one, two))
        out = list(a)
        for c in b:
            if not a or not any(_ratio(c, k, True) > 0.5 for k in out):
                out.append(c)
        want |= {(p, k[1]) for k in out}
    got = bx.merge_detections(make(spark, one), make(spark, two))
    assert {(r.page_id, r.box_id) for r in got.collect()} == want


def test_rows_use_an_anchor_and_not_the_neighbour(spark):
    rows = [(1, i, 100 - i, y, 5, 5, 0.0) for i, y in enumerate([0, 10, 20, 30, 40, 41])]
    got = {r.box_id: (r.row_num, r.position) for r in bx.row_order(make(spark, rows)).collect()}
    assert [got[i][0] for i in range(6)] == [1, 1, 2, 2, 3, 3]
    assert [got[i][1] for i in range(6)] == [2, 1, 4, 3, 6, 5]


def test_answers_have_all_names_and_drop_the_rest(spark):
    rows = [(1, i, i * 30, 500, 20, 20, 0.2) for i in range(43)] + [(2, 0, 0, 10, 20, 20, 0.9)]
    got = bx.answers(make(spark, rows), 1700, 2200).collect()
    assert len(got) == 1 and got[0].page_id == 1 and len(got[0]) == 43
    assert sorted(answer_columns()) == sorted(ANSWER_NAMES) and len(set(ANSWER_NAMES)) == 42
    assert answer_columns()[:4] == ["1_yes", "1_no", "1b_1", "1b_2"] and answer_columns()[-1] == "7_5"


def test_wide_boxes_have_a_column_for_every_box(spark):
    b = make(spark, [(1, i, 40 * i, 10, 20, 20, 0.2) for i in range(53)] + [(2, 0, 10, 10, 20, 20, 0.0)])
    got = {r.page_id: r.asDict() for r in bx.wide_boxes(bx.row_order(b), 50).collect()}
    assert list(got[1]) == ["page_id", *(f"box{i}" for i in range(1, 54))] and all(got[1][f"box{i}"] for i in range(1, 54))
    assert got[2]["box1"] is False and got[2]["box53"] is None
    assert len(bx.wide_boxes(bx.row_order(b.where("page_id = 2")), 50).columns) == 51


def test_wide_boxes_of_every_position_match_their_sql(spark, tmp_path):
    import duckdb

    from gridleaf.plans import catalog, more  # noqa: F401  (registers its queries)

    con = duckdb.connect()
    con.sql("create table few as select * from '/root/testdata/sf0.001/lineitem.parquet' limit 60")
    con.sql(f"copy (select * replace (case when rowid < 53 then 1 else 2 end as l_partkey) from few) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.sql(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.sql(catalog.ORACLES["wide_boxes_every_position"])
    names = ["page_id", *(f"box{i}" for i in range(1, 54))]
    assert sorted(want.columns) == sorted(names)
    rows = sorted(want.select(*names).fetchall())
    for name in ("wide_boxes_every_position", "wide_boxes"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        assert df.columns == names and sorted(tuple(r) for r in df.collect()) == rows
    assert None not in rows[0] and rows[1][8:] == (None,) * 46


def test_exclusion_by_list_and_by_table(spark):
    b = make(spark, [(1, 0, 10, 209, 20, 22, 0.0), (1, 1, 10, 211, 20, 22, 0.0), (1, 2, 10, 2080, 20, 20, 0.0), (2, 0, 10, 0, 20, 20, 0.0)])
    kept, out = bx.split_excluded(b, bx.exclusion_bounds(1700, 2200))
    assert {(r.page_id, r.box_id) for r in kept.collect()} == {(1, 1)} and out.count() == 3
    regions = spark.createDataFrame([(1, 0, 0, 1700, 220)], "page_id long, x1 long, y1 long, x2 long, y2 long")
    assert {(r.page_id, r.box_id) for r in bx.split_excluded(b, regions)[1].collect()} == {(1, 0)}


def test_geometry_edges(spark):
    d = spark.createDataFrame([(0, 0), (5, 5), (-6, 5), (6, 5), (0, -3)], "dx long, dy long")
    got = [r[0] for r in d.select(g.direction(F.col("dx"), F.col("dy"))).collect()]
    assert got == ["above", "below", "left", "right", "above"]
    flat = make(spark, [(1, 0, 0, 0, 5, 0, 0.0)])
    assert flat.select(g.aspect_ratio()).first()[0] == 0.0
    conf = spark.createDataFrame([(250.0, "right"), (100.0, "left")], "d double, s string")
    assert [round(r[0], 6) for r in conf.select(g.proximity_confidence(F.col("d"), F.col("s"))).collect()] == [0.0, 0.35]


def test_rule_vote_edges(spark):
    f = spark.createDataFrame([(0.2, 0.0, 0.0, 2, 0.0), (0.0, 0.2, 0.0, 2, 0.1), (0.2, 0.2, 0.0, 0, 0.0)], "dark_ratio double, contour_area_ratio double, cross_pattern_score double, contour_count int, edge_density double")
    got = fills.rule_vote(f).collect()
    assert [r.is_filled for r in got] == [False, False, True]  # exactly 0.4, just under it, 0.55
    assert got[0].confidence == 0.2 + 0.1


def test_pixel_scores_match_numpy(spark):
    r = np.random.default_rng(0)
    px = r.integers(0, 256, (5, 64))
    df = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(px)], "i long, p array<long>").select("i", fills.interior(F.col("p"), 8, 8).alias("q"))
    for row in df.select("i", fills.pixel_fill(F.col("q")).alias("s"), fills.pixel_fill_older(F.col("q")).alias("o")).collect():
        q = px[row.i].reshape(8, 8)[2:6, 2:6]
        dark = (q < 200).mean()
        assert row.s == pytest.approx(0.5 * min(1, 5 * dark) + 0.3 * min(1, q.var() / 1000) + 0.2 * (1 - q.mean() / 255))
        assert row.o == pytest.approx(0.7 * dark + 0.3 * min(1, q.var() / 1000))
    tiny = spark.createDataFrame([([1, 2, 3, 4],)], "p array<long>").select(fills.pixel_fill(fills.interior(F.col("p"), 2, 2)))
    assert tiny.first()[0] == 0.0


def test_text_rules(spark):
    t = spark.createDataFrame([("Qué  es\testo", 90.0), ("Which one", 10.0), ("yes", 61.0), ("yes", 60.0), ("naïve § (ok) – a_b", 0.0)], "t string, c double")
    got = t.select(category(F.col("t"), F.col("c")).alias("k"), clean(F.col("t")).alias("x"), clean_name(F.lit("é a-b!")).alias("n")).collect()
    assert [r.k for r in got] == ["option", "question", "option", "other", "other"]
    assert got[0].x == "Qué es esto" and got[4].x == "naïve  (ok)  a_b" and got[0].n == "é_a_b"
    s = spark.createDataFrame([(0.9,), (0.8,), (0.7,), (0.6,), (0.59,)], "s double")
    assert [r[0] for r in s.select(grade(F.col("s"))).collect()] == list("ABCDF")


def test_lines_and_label_pool(spark):
    w = spark.createDataFrame([(1, 1, 2, "b", 120, 30, 10, 18, 80), (1, 1, 1, "a", 60, 30, 10, 18, 90), (1, 1, 3, " ", 180, 30, 10, 18, 99), (1, 1, 4, "c", 200, 30, 10, 18, 0), (2, 1, 1, "why", 0, 0, 9, 9, 50)],
                              "page_id long, line_num long, word_num long, text string, x long, y long, w long, h long, confidence long")
    lines = tx.assemble_lines(w)
    got = {r.page_id: r for r in lines.collect()}
    assert got[1].text == "a b" and got[1].confidence == 85.0 and (got[1].x, got[1].w, got[1].cx) == (60, 70, 95)
    assert {r.page_id for r in tx.label_pool(lines).collect()} == {1, 2}  # a page of questions only keeps them


TEXT = "page_id long, text_id long, x long, y long, w long, h long, text string, confidence long, cx long, cy long"


def test_proximity_is_exclusive_and_ordered(spark):
    b = make(spark, [(1, 0, 0, 100, 20, 20, 0.0), (1, 1, 0, 0, 20, 20, 0.0), (1, 2, 900, 900, 20, 20, 0.0)])
    t = spark.createDataFrame([(1, 0, 0, 0, 0, 0, "near", 50, 10, 60), (1, 1, 0, 0, 0, 0, "far", 50, 10, 150)], TEXT)
    got = {r.box_id: r for r in co.proximity_match(b, t).collect()}
    assert got[1].text_id == 0 and got[0].text_id == 1  # the upper box comes first
    assert got[2].text_id is None and got[2].distance == float("inf") and got[2].confidence == 0 and got[2].direction == "unknown"


def test_alignment_prefers_the_row_and_losers_keep_distance(spark):
    b = make(spark, [(1, 0, 0, 0, 20, 20, 0.0), (1, 1, 100, 0, 20, 20, 0.0)])
    t = spark.createDataFrame([(1, 0, 0, 0, 0, 0, "row", 50, 150, 12), (1, 1, 0, 0, 0, 0, "column", 50, 10, 60)], TEXT)
    raw = co.align_match(b, t)
    assert {r.box_id: (r.text_id, r.alignment, r.distance) for r in raw.collect()} == {0: (0, "horizontal", 140.0), 1: (0, "horizontal", 40.0)}
    got = {r.box_id: r for r in co.post_process(raw).collect()}
    assert got[1].text_id == 0 and got[0].text_id is None and got[0].confidence == 0 and got[0].distance == 140.0


def test_layout_of_pages_without_text_or_neighbours(spark):
    b = make(spark, [(1, 0, 0, 0, 20, 20, 0.0), (2, 0, 0, 0, 20, 20, 0.0), (3, 0, 0, 0, 20, 20, 0.0)])
    t = spark.createDataFrame([(2, 0, 0, 0, 0, 0, "x", 50, 900, 900), (3, 0, 0, 0, 0, 0, "x", 50, 90, 12)], TEXT)
    assert {r.page_id: (r.layout_type, r.dominant_direction) for r in co.layouts(b, t).collect()} == {1: ("unknown", None), 2: ("mixed", None), 3: ("right_labels", "right")}


def test_clusters_number_by_first_member(spark):
    b = make(spark, [(1, 0, 0, 0, 20, 20, 0.0), (1, 1, 900, 0, 20, 20, 0.0), (1, 2, 90, 0, 20, 20, 0.0), (1, 3, 900, 90, 20, 20, 0.0), (1, 4, 500, 500, 20, 20, 0.0), (2, 7, 0, 0, 1, 1, 0.0)])
    assert {(r.page_id, r.box_id): r.cluster for r in co.clusters(b).collect()} == {(1, 0): 0, (1, 1): 1, (1, 2): 0, (1, 3): 1, (1, 4): -1, (2, 7): 0}


def test_quality_rules(spark):
    one = make(spark, [(1, i, 10, 10, 20, 20, 0.0) for i in range(4)] + [(2, 0, 10, 10, 5, 5, 0.0)])
    got = {r.page_id: r for r in qu.detection(one, 100, 100).collect()}
    assert got[1].score == 1.0 and got[2].score == 0.0 and not got[2].valid  # no valid box, one issue, a small bonus
    m = spark.createDataFrame([(1, 0, None, 0.0, float("inf"), "unknown", "none")], "page_id long, box_id long, text_id long, confidence double, distance double, direction string, alignment string")
    c = qu.correlations(m).first()
    assert c.avg_distance is None and c.match_rate == 0.0
    stats = spark.createDataFrame([(1, 2000, 1000, 30.0, 220.0, 300.0)], "page_id long, width int, height int, contrast double, brightness double, blur_score double")
    assert qu.image(stats).first().score == pytest.approx((1 + 0.6 + 0.24 + 1) / 4)


def test_issues_and_scores_of_every_component(spark):
    stats = spark.createDataFrame([(1, 800, 1200, 12.25, 220.75, 90.0), (2, 2000, 2000, 60.0, 100.0, 300.0)], "page_id long, width int, height int, contrast double, brightness double, blur_score double")
    boxes = make(spark, [(1, 0, 10, 10, 20, 20, 0.0), (1, 1, 10, 50, 20, 20, 0.0), (1, 2, 10, 90, 20, 20, 0.0)])
    analysed = spark.createDataFrame([(1, 0, 0.25, 0.1, False), (1, 1, None, 0.1, False), (1, 2, 0.9, 0.9, True)], "page_id long, box_id long, confidence double, filled_score double, is_filled boolean")
    regions = spark.createDataFrame([(1, "Yes", 12), (3, "No", 80)], "page_id long, text string, confidence long")
    m = spark.createDataFrame([(1, 0, 5, 0.125, 250.5), (1, 1, None, 0.0, float("inf")), (1, 2, 6, 0.9, 10.0)], "page_id long, box_id long, text_id long, confidence double, distance double")
    flagged = qu.detection_issues(boxes, 1700, 2200)
    got = sorted((r.page_id, r.issue) for r in qu.all_issues(stats, flagged, analysed, regions, m).collect())
    none = ("[checkbox_detection] No checkboxes detected", "[correlations] No correlations provided", "[fill_analysis] No analyzed checkboxes provided")
    assert got == sorted([
        (1, "[image] Low resolution: 800x1200 (recommend >1000x1000)"), (1, "[image] Low contrast: 12.2 (recommend >20)"), (1, "[image] Poor brightness: 220.8 (recommend 50-200)"),
        (1, "[image] Image appears blurry: 90.0 (recommend >100)"), (1, "[fill_analysis] Checkbox 0 has low fill confidence: 0.250"), (1, "[fill_analysis] Checkbox 1 missing fill analysis"),
        (1, "[text_extraction] Low confidence text: 'Yes' (12)"), (1, "[correlations] Low confidence correlation for checkbox 0: 0.125"), (1, "[correlations] Large correlation distance for checkbox 0: 250.5px"),
        (1, "[correlations] No text match found for checkbox 1"), (2, "[text_extraction] No text extracted"), *((p, x) for p in (2, 3) for x in none),
    ])
    parts = {"image": qu.image(stats), "checkbox_detection": qu.detection(boxes, 1700, 2200), "fill_analysis": qu.fill(analysed), "text_extraction": qu.text(regions), "correlations": qu.correlations(m)}
    pages = qu.overall(parts, every_page=True)
    rows = {r.page_id: r for r in pages.collect()}
    assert sorted(rows) == [1, 2, 3] and [r.page_id for r in qu.overall(parts).collect()] == [1]
    assert rows[2].score == pytest.approx(rows[2].image_score / 5) and not rows[2].valid and rows[3].image_score == 0 and rows[3].worst == "image"
    assert {r.ord for r in qu.recommendations(pages, stats).collect() if r.page_id == 3} == {3, 4, 7, 8, 5, 6}


def test_quality_of_every_page_matches_its_sql(spark):
    import duckdb

    from gridleaf.plans import catalog

    d, con = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("lineitem", "orders", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    for name in ("quality_issues_all_components", "quality_overall_every_page", "recommendations_every_page"):
        df = catalog.QUERIES[name](spark, d)
        got = sorted(map(repr, (tuple(r) for r in df.collect())))
        assert got == sorted(map(repr, con.sql(f"select {', '.join(df.columns)} from ({catalog.ORACLES[name]})").fetchall())), name


def test_measures(spark):
    same = make(spark, [(1, i, 0, 0, 20, 20, 0.0) for i in range(5)])
    assert ms.suggest_range(same).first().n == 0  # no deviation: all are trimmed
    b = make(spark, [(1, i, 0, 0, w, w, 0.0) for i, w in enumerate([20, 20, 20, 30, 30, 31, 32, 33, 34])])
    assert [(r["size"], r.n) for r in ms.common_sizes(b, "w").orderBy("rank").collect()] == [(20, 3)]
    assert ms.broadened(b, 90, 99, (20, 40)).first()["pass"] == 2
    sweep = ms.grid_sweep(b, [100, 900], [1000, 2000]).collect()
    assert sum(r.best for r in sweep) == 1 and max(sweep, key=lambda r: r.n).best
    assert ms.clicked_size(spark.createDataFrame([(9, 5, 3, 8)], "x0 int, y0 int, x1 int, y1 int")).first()[4:] == (3, 5, 6, 3)


def test_mapping(spark, tmp_path):
    ordered = bx.row_order(make(spark, [(1, 0, 10, 10, 20, 20, 0.2), (1, 1, 60, 10, 20, 20, 0.0)]))
    m = mp.saved_mapping(ordered, shift=20)
    got = {r.box_id: r.column_name for r in mp.match_saved(ordered, m).collect()}
    assert got == {0: "q1", 1: "q2"}
    assert {r.column_name for r in mp.match_saved(ordered, mp.saved_mapping(ordered, shift=21)).collect()} == {"box1", "box2"}
    with pytest.raises(ValueError):
        mp.name_by_list(spark, ordered, ["a", "a"])
    mp.mapping_json(m).write.text(str(tmp_path / "m"))
    back = readers.saved_mapping(spark, str(tmp_path / "m" / "*.txt").replace("*.txt", next(p.name for p in (tmp_path / "m").glob("*.txt"))))
    assert {(r.ord, r.column_name, r.x) for r in back.collect()} == {(1, "q1", 30), (2, "q2", 80)}
    assert readers.saved_mapping(spark, str(tmp_path / "none")) is None
    files = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "seq long, path string")
    assert [r.page for r in mp.files_and_pages(files, None).collect()] == [0, 0, 0]
    assert [r.page for r in mp.files_and_pages(files, [4]).collect()] == [4, 4, 4]
    assert [r.page for r in mp.files_and_pages(files, [4, 5]).orderBy("seq").collect()] == [4, 5]


def test_scans_features_and_errors(spark, tmp_path):
    image = np.full((60, 60), 255, np.uint8)
    image[10:30, 10:30] = 0
    (tmp_path / "a.pgm").write_bytes(b"P5\n# note\n60 60\n255\n" + image.tobytes())
    (tmp_path / "b.pgm").write_bytes(b"P5\n60 60\n255\nshort")
    pages = readers.rasterise(readers.scans(spark, str(tmp_path), "*.pgm"))
    rows = {r.path[-5:]: r for r in pages.collect()}
    assert rows["a.pgm"].error is None and rows["b.pgm"].error.startswith("ValueError")
    good = pages.where("error is null").select(F.lit(1).cast("long").alias("page_id"), "height", "width", "channels", "data")
    found = vi.detect_boxes(good)
    assert [tuple(r)[2:] for r in found.collect()] == [(10, 10, 20, 20)]
    f = vi.box_features(found.join(good, "page_id")).first()
    assert f.dark_ratio == pytest.approx(400 / 576) and f.contour_count == 1
    s = vi.image_stats(good).first()
    assert s.brightness == pytest.approx(image.mean()) and s.contrast == pytest.approx(image.std())
    assert set(vi.preprocess(good).first().data) == {0, 255}
    assert vi.detect_boxes(good, lambda i: 1 / 0).count() == 0
    assert vi.is_diagonal(45) and vi.is_diagonal(135) and not vi.is_diagonal(90)


def test_sinks(spark, tmp_path):
    b = make(spark, [(1, 0, 0, 0, 20, 20, 0.2)])
    t = spark.createDataFrame([], TEXT)
    items = co.survey_items(b, t, co.adaptive_match(b, t))
    docs = sinks.page_documents(items, co.survey_metadata(items))
    assert '"distance":"Infinity"' in docs.first().json and "Checkbox 0" in docs.first().json
    sinks.write_json(docs, str(tmp_path / "j"))
    sinks.write_csv(items, str(tmp_path / "c"))
    assert sinks.draw_boxes(b).first().label == "box1"
    name = spark.range(1).select(sinks.output_name(F.lit("/x/form.v2.pdf"), F.lit(3), F.to_timestamp(F.lit("2024-01-02 03:04:05")))).first()[0]
    assert name == "form.v2_page3_20240102_030405"


def test_stream_of_boxes(spark, tmp_path):
    from gridleaf.streaming import pages

    rows = make(spark, [(1, i, 30 * i, 500, 20, 20, 0.2) for i in range(3)]).withColumn("seen_at", F.to_timestamp(F.lit("2024-01-01")))
    rows.write.parquet(str(tmp_path / "in"))
    q = pages.write_answers(pages.box_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"), 1700, 2200)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["1_yes"] is True


def test_all_form_queries_match_their_sql(spark):
    import duckdb

    from gridleaf.plans import catalog

    d = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "documents", "embeddings"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
    for name in ("wide_answers", "nms_removed", "adaptive_match", "line_assembly", "quality_overall", "saved_mapping_match"):
        df = catalog.QUERIES[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*cols).collect())))
        want = sorted(map(repr, con.sql(f"select {', '.join(f'{chr(34)}{c}{chr(34)}' for c in cols)} from ({catalog.ORACLES[name]})").fetchall()))
        assert got == want, name
