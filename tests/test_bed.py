"""BED text, the database on files, and joins of long intervals."""

import json

import pytest
from pyspark.sql import functions as F

from spanstat.operators import compare, embed, ontology, permute
from spanstat.operators.overlap import overlap_join
from spanstat.operators.sorting import natural_key, sort_bed
from spanstat.sources import bed, database, scores, split
from spanstat.sources.generate import generate, size_report, timings


def lines(spark, text):
    return spark.createDataFrame([(x,) for x in text.split("\n")], "value string")


@pytest.mark.parametrize(
    "line, want",
    [
        ("chr1\t100\t200\tpeak1\t500\t+", ("chr1", 100, 200, None)),
        ("100\t200", ("default", 100, 200, None)),
        ("chr1 +100 0200\r", ("chr1", 100, 200, None)),
        ("# x", None),
        (" \t ", None),
        ("100", ("default", 100, None, "InvalidFormat")),
        ("chr1 200 100", ("chr1", 200, 100, "InvalidRange")),
        ("4294967296 1 2", ("4294967296", 1, 2, None)),
    ],
)
def test_lines(spark, line, want):
    row = lines(spark, line).select(bed.parsed(F.col("value")).alias("p")).first().p
    assert (tuple(row) if row else None) == want


def test_strict(spark):
    text = "chr1 1 2\nchr1 5"
    assert bed.intervals(lines(spark, text), strict=False).count() == 1
    with pytest.raises(Exception, match="InvalidFormat"):
        bed.intervals(lines(spark, text)).collect()


def test_natural_order(spark):
    rows = ["s2", "s10", "s1b", "s1a", "t", "s" + "9" * 30, "s007"]
    names = spark.createDataFrame([(c,) for c in rows], "c string")
    assert [r.c for r in names.orderBy(natural_key(F.col("c"))).collect()] == ["s1a", "s1b", "s2", "s007", "s10", "s" + "9" * 30, "t"]


def test_long_intervals(spark):
    q = [(1, "c", 0, 90_000_000), (2, "c", 10, 20), (3, "c", 16384, 16385), (4, "d", 1, 2)]
    d = [(1, "c", 15, 17000), (2, "c", 50_000, 200_000_000), (3, "c", 20, 21), (4, "c", 15, 17000)]
    df = [spark.createDataFrame(x, "sid int, chrom string, start long, stop long") for x in (q, d)]
    got = sorted((r.q_sid, r.d_sid, r.bp) for r in overlap_join(*df).collect())
    assert got == sorted((a, b, min(t, v) - max(s, u)) for a, c, s, t in q for b, e, u, v in d if c == e and u < t and v > s)


def test_database(spark, tmp_path):
    src, qry, db = tmp_path / "src", tmp_path / "qry", str(tmp_path / "db")
    src.mkdir(), qry.mkdir()
    (src / "near.bed").write_text("chr20\t7000\t7600\nchr19\t50\t90\n")
    (src / "far.bed").write_text("".join(f"chr20\t{k * 100_000}\t{k * 100_000 + 30}\n" for k in range(20, 40)))
    (src / "none.bed").write_text("")
    (qry / "ask.bed").write_text("chr20\t7100\t7500\nchr20\t30000000\t30000010\n")
    database.add(spark, str(src), db, chroms=["chr20"])
    assert [tuple(r) for r in database.info(spark, db).collect()] == [(0, "far.bed"), (1, "near.bed"), (2, "none.bed")]
    assert [(r.chrom, r.layer, r.max_size, r.n) for r in database.layers(spark, db).collect()] == [("chr19", 0, 128, 1), ("chr20", 0, 128, 20), ("chr20", 2, 2048, 1)]
    assert [(r.query_name, r.db_name, r.overlap_count) for r in database.query(spark, db, str(qry)).collect()] == [("ask.bed", "near.bed", 1)]
    assert database.query(spark, db, str(qry), "stats").collect() == []
    database.add(spark, str(src), db, stats=True, chroms=["chr20"])
    assert database.info(spark, db).count() == 6
    got = database.query(spark, db, str(qry), "stats").collect()
    assert [(r.db_name, r.overlap_count, r.p_value < 0.05) for r in got] == [("near.bed", 1, True)]
    assert {r.intersection_bp for r in database.query(spark, db, str(qry), "intervals").collect()} == {400}
    (tmp_path / "one.txt").write_text("chr20\t7100\t7500\n")
    assert database.query(spark, db, str(tmp_path / "one.txt")).count() == 2
    with pytest.raises(database.AddError):
        (tmp_path / "empty").mkdir()
        database.add(spark, str(tmp_path / "empty"), db)
    report = size_report(spark, db).collect()
    assert {(r.layer, r.intervals) for r in report} == {(0, 42), (2, 2)} and all(r.bytes_per_interval > 0 for r in report)


def test_sorting(spark):
    text = ["chr10 5 9", "x", "  # note", "chr2 7 9 a", "9 2 chr2 b", "browser x", "track1 3 4", "", "5 6"]
    d = spark.createDataFrame([(x,) for x in text], "value string")
    assert [r.value for r in sort_bed(d, natural=True).collect()] == ["  # note", "browser x", "chr2 7 9 a", "9 2 chr2 b", "chr10 5 9", "track1 3 4"]


def test_errors_tell_the_file(spark, tmp_path):
    (tmp_path / "bad.bed").write_text("chr1\t1\t2\nchr1\t9\t3\n")
    with pytest.raises(Exception, match=r"InvalidRange in bad.bed: chr1\s9\s3"):
        bed.read_bed(spark, str(tmp_path)).collect()


def test_projection_of_own_sources(spark):
    rows = [(s, "c", 1000 * ((7 * s + k * k) % 23), 1000 * ((7 * s + k * k) % 23) + 150 * (s + 1)) for s in range(6) for k in range(8)]
    t = embed.tiles(spark.createDataFrame(rows, "sid int, chrom string, start long, stop long"))
    index = embed.svd_index(t, variance=0.9)
    for r in embed.svd_project(t, index, t).collect():
        assert r.n_tiles == r.n_hits
        assert abs(sum(a * b for a, b in zip(r.e, index[1][index[0].index(r.q_sid)])) - 1) < 1e-9


def test_repeated_rows_are_drawn_each(spark):
    q = spark.createDataFrame([(0, "chr20", 5, 9)] * 3, "sid int, chrom string, start long, stop long")
    got = permute.moved(q, 4, "shuffle", genome={"chr20": 10**7}).groupBy("trial").agg(F.count_distinct("start").alias("n")).collect()
    assert [r.n for r in got] == [3] * 4


def test_names_of_traits(spark):
    terms = spark.createDataFrame([("D1", "Crohn's disease", False), ("D2", "allergic diseases of skin", False), ("D3", "heart attack", True), ("D4", "bone density", False)], "term string, text string, synonym boolean")
    asked = spark.createDataFrame([("Crohns_Disease traits",), ("Heart attack",), ("skin disease",), ("bone",), ("what",)], "name string")
    got = {r.name: (r.term, r.kind) for r in ontology.match_names(asked, terms, skip=["bone"]).collect()}
    assert got == {"Crohns_Disease traits": ("D1", "exact_name"), "Heart attack": ("D3", "exact_synonym"), "skin disease": ("D2", "word_subset"), "bone": (None, None), "what": (None, None)}


def test_score_files(spark, tmp_path):
    (tmp_path / "a.tsv").write_text("#name\tp\nx\t1\ny\n\nz\t2\t3\n")
    assert [tuple(r) for r in scores.read_tsv(spark, str(tmp_path / "a.tsv")).orderBy("name").collect()] == [("x", "1"), ("z", "2")]
    d = spark.createDataFrame([("a", 1, None), ("b", 2, 0.5)], "db_name string, overlap_count int, p_value double")
    scores.write_results(d, str(tmp_path / "out.json"))
    assert json.loads((tmp_path / "out.json").read_text()) == {"results": [{"db_name": "a", "overlap_count": 1}, {"db_name": "b", "overlap_count": 2, "p_value": 0.5}]}
    assert scores.read_results(spark, str(tmp_path / "out.json")).count() == 2
    (tmp_path / "mc.tsv").write_text("# milestone=5 trials=5\ndb_name\tobserved\tp_value\nd/x.bed\t3\t0.2\n# milestone=9 trials=9\nd/x.bed\t3\t0.1\n")
    assert [(r.name, r.milestone, r.p) for r in scores.read_milestones(spark, str(tmp_path / "mc.tsv")).orderBy("milestone").collect()] == [("x", 5, 0.2), ("x", 9, 0.1)]


def test_unknown_states_fail(spark):
    rows = spark.createDataFrame([("E1", "c", 1, 2, "9")], "sample string, chrom string, start long, stop long, state string")
    cells, states = spark.createDataFrame([("E1", "lung")], "sample string, cell string"), spark.createDataFrame([("1", "Tss")], "state string, label string")
    with pytest.raises(Exception, match="unknown state 9"):
        split.by_state(rows, cells, states).collect()


def test_grid_and_generator(spark):
    s = spark.createDataFrame([(f"n{i}", 10.0**-i) for i in range(8)], "name string, p double")
    t = spark.createDataFrame([(f"n{i}", m, 0.9 / (i + m)) for i in range(8) for m in (5, 9)], "name string, milestone int, p double")
    got = {(r.milestone, r.threshold): (r.n, r.r and round(r.r, 6)) for r in compare.correlation_grid(s, t, [1.0, 1e-5]).collect()}
    assert got == {(5, 1.0): (8, 1.0), (9, 1.0): (8, 1.0), (5, 1e-5): (3, None), (9, 1e-5): (3, None)}
    g = generate(spark, 500, files=2)
    assert g.count() == 1000 and g.where("stop - start < 100 or stop - start > 10000 or start < 0").count() == 0
    assert sorted(map(tuple, g.collect())) == sorted(map(tuple, generate(spark, 500, files=2).repartition(3).collect()))
    assert timings({"x": lambda: None}, rows=5)[0]["best_s"] >= 0
