"""Pixels, files and whole pages; the queries of plans.more against DuckDB."""

from __future__ import annotations

import importlib.util
import logging
import os
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridleaf.functions.text import ANSWER_NAMES
from gridleaf.operators import boxes as bx
from gridleaf.operators import correlate as co
from gridleaf.operators import mapping as mp
from gridleaf.operators import vision as vi
from gridleaf.plans import catalog, forms, more
from gridleaf.sources import readers, sinks

SF = "/root/testdata/sf0.001"
MORE = [k for k, f in catalog.QUERIES.items() if f.__module__ == more.__name__]


def flood(mask):
    left, out = {(int(r), int(c)) for r, c in zip(*np.nonzero(mask), strict=True)}, []
    while left:
        stack, cells = [left.pop()], []
        while stack:
            r, c = stack.pop()
            cells.append((r, c))
            for q in ((r + i, c + j) for i in (-1, 0, 1) for j in (-1, 0, 1)):
                if q in left:
                    left.remove(q)
                    stack.append(q)
        out.append(cells)
    return out


@pytest.mark.parametrize("share", [0.0, 0.2, 0.4, 0.6, 1.0])
def test_labelling_equals_flood_fill(share):
    rng = np.random.default_rng(int(share * 10))
    for shape in ((1, 1), (7, 9), (30, 41), (1, 20), (20, 1)):
        mask = rng.random(shape) < share
        parts = flood(mask)
        assert vi.components(mask) == sorted(map(len, parts), reverse=True)
        want = sorted((min(c for _, c in p), min(r for r, _ in p), max(c for _, c in p) - min(c for _, c in p) + 1, max(r for r, _ in p) - min(r for r, _ in p) + 1) for p in parts)
        assert sorted(vi.frames(np.where(mask, 0, 255).astype(np.uint8))) == want == sorted(b for b, _, _ in vi.contours(mask))


def test_spirals_and_combs_are_one_part():
    mask = np.zeros((40, 81), bool)
    mask[:, ::2] = True  # teeth that only the last row joins
    mask[-1] = True
    assert vi.components(mask) == [int(mask.sum())]


def test_hull_area_and_vertices():
    r = random.Random(1)
    square = np.array([(x, y) for x in range(10) for y in range(10)])
    corners = vi.hull(square)
    assert len(corners) == 4 and vi.polygon_area(corners) == 81 and vi.vertices(corners) == 4
    for _ in range(20):
        points = np.array([(r.randrange(30), r.randrange(30)) for _ in range(12)])
        h = vi.hull(points)
        inside = [all((b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0]) >= 0 for a, b in zip(h.tolist(), np.roll(h, -1, 0).tolist(), strict=True)) for p in points.tolist()]
        assert all(inside)
    triangle = np.array([(0, 0), (20, 0), (10, 17)])
    assert vi.vertices(vi.hull(triangle)) == 3
    patch = np.full((20, 20), 255, np.uint8)
    patch[5:15, 5:15] = 0
    assert vi.contour_features(patch) == {"contour_count": 1, "largest_contour_area": 100.0, "hull_area": 100.0, "contour_area_ratio": 0.25, "convexity": 1.0}
    patch[5:10, 5:10] = 255  # an L has a hull that is larger than itself
    assert vi.contour_features(patch)["convexity"] < 0.9
    assert vi.contour_features(np.full((4, 4), 255, np.uint8))["contour_count"] == 0


def page(filled=(1, 3), size=(300, 400)):
    """A form with four 24-pixel frames in two rows, some crossed, and lines of text-like marks."""
    px = np.full(size, 255, np.uint8)
    places = [(40, 50), (200, 50), (40, 150), (200, 150)]
    for k, (x, y) in enumerate(places):
        px[y : y + 24, x : x + 24] = 0
        px[y + 1 : y + 23, x + 1 : x + 23] = 255
        if k in filled:
            for i in range(4, 20):
                px[y + i, x + i - 1 : x + i + 3] = 0
                px[y + i, x + 23 - i - 2 : x + 23 - i + 2] = 0
    px[240:244, 30:350:3] = 0  # marks that are no box
    return px, places


def pgm(px):
    return b"P5\n%d %d\n255\n" % (px.shape[1], px.shape[0]) + px.tobytes()


def test_png_round_trip_and_filters():
    rng = np.random.default_rng(3)
    for c in (1, 3):
        px = rng.integers(0, 256, (13, 17, c), dtype=np.uint8)
        content = sinks.png_bytes(13, 17, c, px.tobytes())
        assert readers.any_image(content) == (13, 17, c, px.tobytes())
    line, above = rng.integers(0, 256, 12, dtype=np.uint8), rng.integers(0, 256, 12, dtype=np.uint8)
    for kind in range(5):  # filtering by the definition, then back
        coded = []
        for i in range(12):
            a, b, c = (int(line[i - 3]) if i >= 3 else 0), int(above[i]), (int(above[i - 3]) if i >= 3 else 0)
            p = a + b - c
            guess = [0, a, b, (a + b) // 2, min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c))[2]][kind]
            coded.append((int(line[i]) - guess) % 256)
        assert (readers._unfiltered(kind, np.array(coded, np.uint8), above, 3) == line).all()
    with pytest.raises(ValueError, match="not"):
        readers.any_image(b"GIF89a")


def test_pages_from_files(spark, tmp_path):
    px, places = page()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgm").write_bytes(pgm(px))
    (tmp_path / "in" / "b.png").write_bytes(sinks.png_bytes(*px.shape, 1, px.tobytes()))
    (tmp_path / "in" / "broken.pgm").write_bytes(b"P5\n9 9\n255\nxx")
    files = readers.scans(spark, f"file://{tmp_path}/in", "*")
    names = ["one", "two", "three", "four"]
    words = [(name, 0, i, 1, names[i], x + 40, y, 60, 20, 90) for name in ("a.pgm", "b.png") for i, (x, y) in enumerate(places)]
    words = spark.createDataFrame(words, "name string, page int, line_num long, word_num long, text string, x long, y long, w long, h long, confidence int")
    words = files.select("path", F.element_at(F.split("path", "/"), -1).alias("name")).join(words, "name").drop("name")
    items, metadata, documents, errors = forms.from_files(files, words, f"file://{tmp_path}/rasters")
    got = {(r.page_id, r.x, r.y): (r.w, r.h, r.is_filled, r.label) for r in items.collect()}
    pages = {k[0] for k in got}
    assert len(pages) == 2 and {(k[1], k[2]) for k in got} == set(places)
    for k, (x, y) in enumerate(places):
        for p in pages:
            assert got[p, x, y] == (24, 24, k in (1, 3), names[k])
    bad = errors.collect()
    assert len(bad) == 1 and bad[0].path.endswith("broken.pgm") and "ValueError" in bad[0].error
    total = co.batch_summary(metadata, errors).first()
    assert (total.total_files_processed, total.failed, total.total_checkboxes_found, total.total_checkboxes_filled) == (3, 1, 8, 4)
    assert documents.count() == 2 and '"label":"one"' in documents.first().json
    png = sinks.as_png(readers.rasterise(files)).collect()
    assert len(png) == 2 and all(readers.png_image(r.png)[:2] == px.shape for r in png)


def test_contours_add_boxes_that_frames_miss(spark):
    px, _ = page(filled=())
    px[px == 0] = 140  # too light for a dark frame; the edges are there
    rows = spark.createDataFrame([(1, *px.shape, 1, px.tobytes())], "page_id long, height int, width int, channels int, data binary")
    got = vi.detect_checkboxes(rows).collect()
    assert len(got) == 4 and all(22 <= r.w <= 30 for r in got) and sorted(r.box_id for r in got) == [0, 1, 2, 3]
    assert vi.detect_checkboxes(rows.limit(0)).count() == 0


def test_words_by_an_engine(spark):
    px, _ = page()
    rows = spark.createDataFrame([(i, *px.shape, 1, px.tobytes()) for i in (1, 2)], "page_id long, height int, width int, channels int, data binary")

    def engine(data, height, width, channels, language, layout):
        if not data:
            raise ValueError("no page")
        return [(1, 1, 1, 1, 5, 6, 7, 8, 90, f"{language}{layout}{height}x{width}")]

    got = readers.recognised_words(rows, engine, "deu", 11).collect()
    assert [(r.page_id, r.text, r.confidence) for r in sorted(got)] == [(1, "deu11300x400", 90), (2, "deu11300x400", 90)]
    empty = rows.withColumn("data", F.lit(b"").cast("binary"))
    assert readers.recognised_words(empty, engine).count() == 0


def test_ocr_tables_and_requests(spark, tmp_path):
    head = "level\tpage_num\tblock_num\tpar_num\tline_num\tword_num\tleft\ttop\twidth\theight\tconf\ttext"
    (tmp_path / "p.tsv").write_text(f"{head}\n5\t1\t1\t1\t1\t1\t10\t20\t30\t12\t91.5\tsay \"yes\"\n5\t1\t1\t1\t1\t2\t50\t20\t30\t12\t-1\t\n")
    got = readers.ocr_words(spark, str(tmp_path / "p.tsv")).orderBy("word_num").collect()
    assert (got[0].text, got[0].x, got[0].confidence, got[0].page_id) == ('say "yes"', 10, 91, 1) and got[1].confidence == -1
    files = spark.createDataFrame([("file:/x/a.pdf", b"1")], "path string, content binary")
    found, missing = readers.requested_pages(files, spark.createDataFrame([("a.pdf", 2), ("b.pdf", 0)], "name string, page int"))
    assert [(r.name, r.page) for r in found.collect()] == [("a.pdf", 2)] and [r.name for r in missing.collect()] == ["b.pdf"]


def test_saved_mapping_beyond_the_broadcast_bound(spark, monkeypatch):
    boxes = spark.createDataFrame([(1, i, 100 + 50 * i, 80, 20, 20, 0.1, i + 1) for i in range(6)], "page_id long, box_id long, x long, y long, w long, h long, fill_score double, position long")
    mapping = mp.saved_mapping(boxes, 7)
    want = sorted(map(str, mp.match_saved(boxes, mapping).collect()))
    monkeypatch.setattr(mp, "MAPPING_ROWS", 0)
    assert sorted(map(str, mp.match_saved(boxes, mapping).collect())) == want and "q3" in want[2]


def test_custom_names_that_repeat_are_refused(spark):
    with pytest.raises(ValueError, match="repeat"):
        mp.custom_wide(spark.range(1), ["a", "a"])


@pytest.mark.parametrize("name", MORE)
def test_queries_equal_their_sql(spark, name):
    con = duckdb.connect()
    for t in ("lineitem", "orders", "part", "documents", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).df()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    lines = lambda df: sorted(tuple(f"{x:.9g}" if isinstance(x, float) else str(x) for x in r) for r in df[cols].itertuples(index=False))
    assert lines(got) == lines(want)


def test_answers_of_scans_by_command_line(spark, tmp_path, capsys):
    px, places = page()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgm").write_bytes(pgm(px))
    (tmp_path / "in" / "broken.pgm").write_bytes(b"P5\n9 9\n255\nxx")
    forms.main([f"file://{tmp_path}/in", f"file://{tmp_path}/out", "--scan", "--top", "0", "--bottom", "0"])
    assert "4 boxes, 2 filled" in capsys.readouterr().out
    rows = spark.read.option("header", "true").csv(f"file://{tmp_path}/out").collect()
    first = [rows[0][n] for n in ANSWER_NAMES[:4]]
    assert len(rows) == 1 and rows[0].path.endswith("a.pgm") and first == ["false", "true", "false", "true"]
    # half of the page's own height is left out
    wide, kept, errors = forms.answers_from_files(readers.scans(spark, f"file://{tmp_path}/in", "*"), f"file://{tmp_path}/again", top_percent=33, bottom_percent=0)
    assert kept.count() == 2 and errors.count() == 1 and [wide.first()[n] for n in ANSWER_NAMES[:3]] == [False, True, None]


def test_logger_has_one_handler():
    for debug in (True, False):
        log = forms.logger(debug, "gridleaf_test")
        assert len(log.handlers) == 1 and log.isEnabledFor(logging.DEBUG) == debug


def test_example_report(spark, tmp_path, caplog):
    path = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "examples", "survey_report.py")
    example = importlib.util.module_from_spec(importlib.util.spec_from_file_location("survey_report", path))
    example.__spec__.loader.exec_module(example)
    px, places = page()
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.pgm").write_bytes(pgm(px))
    source = readers.scans(spark, f"file://{tmp_path}/in", "*").first().path
    words = [(source, 0, i, 1, f"label{i}", x + 40, y, 60, 20, 90) for i, (x, y) in enumerate(places)]
    spark.createDataFrame(words, "path string, page int, line_num long, word_num long, text string, x long, y long, w long, h long, confidence int").write.parquet(f"file://{tmp_path}/words")
    example.main([f"file://{tmp_path}/in", f"file://{tmp_path}/words", f"file://{tmp_path}/out"])
    items = spark.read.parquet(f"file://{tmp_path}/out/items")
    assert {(r.label, r.is_filled) for r in items.collect()} == {(f"label{k}", k in (1, 3)) for k in range(4)}


@pytest.mark.parametrize("seed", range(4))
def test_clusters_equal_a_search_of_all_pairs(spark, seed):
    r = random.Random(seed)
    rows = [(p, b, r.randrange(900), r.randrange(900), 20, 20) for p in range(12) for b in r.sample(range(60), r.choice((0, 1, 2, 30, 45)))]
    boxes = spark.createDataFrame(rows, "page_id long, box_id long, x long, y long, w long, h long").repartition(3)
    want = {}
    for p in {row[0] for row in rows}:
        here = sorted(row[1:4] for row in rows if row[0] == p)
        links = {a: [b[0] for b in here if b[0] != a and (b[1] - x) ** 2 + (b[2] - y) ** 2 <= 100**2] for a, x, y in here}
        n = 0
        for a, _, _ in here:
            if (p, a) in want:
                continue
            if not links[a]:
                want[p, a] = 0 if len(here) == 1 else -1
                continue
            todo = [a]
            while todo:
                k = todo.pop()
                if (p, k) not in want:
                    want[p, k] = n
                    todo += links[k]
            n += 1
    assert {(c.page_id, c.box_id): c.cluster for c in co.clusters(boxes).collect()} == want


def test_clusters_of_no_box(spark):
    assert co.clusters(spark.createDataFrame([], "page_id long, box_id long, x long, y long, w long, h long")).collect() == []


@pytest.mark.parametrize("seed", range(3))
def test_answers_in_one_shuffle_equal_the_steps(spark, seed):
    r = random.Random(seed)
    rows = [(p, b, r.randrange(200), r.randrange(200), r.randrange(10, 40), r.randrange(10, 40), r.random(), r.choice((True, False, None))) for p in range(20) for b in range(r.randrange(1, 50))]
    boxes = spark.createDataFrame(rows, "page_id long, box_id long, x long, y long, w long, h long, fill_score double, is_filled boolean")
    steps = bx.wide_answers(bx.row_order(bx.without_overlaps(boxes), seq="seq"))
    assert sorted(map(repr, bx.answers_of(boxes).collect())) == sorted(map(repr, steps.collect()))


def test_rounding_is_that_of_sql(spark):
    halves = [k / 64 for k in range(-64, 128)] + [12.65 / 32, 16.15 / 32, 1e9 + 1 / 64, 0.0]
    values = [v for h in halves for v in (np.nextafter(h, -9e9), h, np.nextafter(h, 9e9))] + [float("inf"), float("-inf"), None]
    values = [None if v is None else float(v) for v in values]
    got = catalog.rounded(spark.createDataFrame(list(enumerate(values)), "i int, v double"), "v").orderBy("i").collect()
    con = duckdb.connect()
    want = con.execute("select round(v, 6) from (select unnest(range(len($1))) as i, unnest($1::double[]) as v) order by i", [values]).fetchall()
    assert [r.v for r in got] == [v for (v,) in want]


def test_fill_quality_of_many_pages_equals_its_sql(spark, tmp_path):
    """On one thread SQL adds a page's scores in file order; on more its averages, and so ties in the sixth digit, depend on their number."""
    con = duckdb.connect(config={"threads": 1})
    con.execute(f"copy (from '/root/testdata/sf0.1/lineitem.parquet') to '{tmp_path}/lineitem.parquet' (row_group_size 20480)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    want = con.execute(entry.oracle_sql()["quality_fill"])
    cols, want = [c[0] for c in want.description], sorted(want.fetchall())
    for d in ("/root/testdata/sf0.1", str(tmp_path)):  # one row group, and thirty read by several tasks
        assert sorted(map(tuple, entry.queries()["quality_fill"](spark, d).select(*cols).collect())) == want
