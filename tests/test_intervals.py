import random

import pytest
from pyspark.sql import functions as F

from quern.operators import advisor, intervals

SETS = [([(0, 3), (3, 4), (10, 2)], 9), ([(5, 1), (5, 1)], 1), ([(0, 10), (2, 3)], 10), ([], 0)]


def _df(spark, rows, names):
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], f"{names[0]} int, {names[1]} long, {names[2]} long")


@pytest.mark.parametrize("width", [1, 16, 64, 5000])
def test_overlap_join_equals_nested_loop(spark, width):
    r = random.Random(width)
    make = lambda n: [(s := r.randint(-500, 500), s + int(r.expovariate(1 / r.choice([3, 30, 900])))) for _ in range(n)]
    a, b = make(120), make(120)
    a += a[:10]
    got = intervals.overlap_join(_df(spark, a, "ius"), _df(spark, b, "jvt"), "u", "s", "v", "t", width)
    want = sorted((i, j) for i, (s, e) in enumerate(a) for j, (x, y) in enumerate(b) if s < e and x < y and e > x and y > s)
    assert sorted((r["i"], r["j"]) for r in got.collect()) == want
    hit = intervals.exists(_df(spark, a, "ius"), _df(spark, b, "jvt"), "u", "s", "v", "t", "i", width)
    assert sorted(r["i"] for r in hit.collect()) == sorted({i for i, _ in want})


def test_half_open_and_plan(spark):
    a, b = _df(spark, [(1, 2), (5, 5)], "ius"), _df(spark, [(2, 3), (0, 10)], "jvt")
    out = intervals.overlap_join(a, b, "u", "s", "v", "t")
    assert [(r["i"], r["j"]) for r in out.collect()] == [(0, 1)]
    assert "NestedLoop" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("lengths, want", SETS)
def test_covered_length(spark, lengths, want):
    df = spark.createDataFrame([(s, s + n) for s, n in lengths], "start long, limit long")
    assert intervals.covered_length(df, "start", "limit").first()["covered"] == want


def test_compact_over_stretches(spark):
    r = random.Random(5)
    rows = [(s := r.randint(0, 3000), s + r.randint(0, 40)) for _ in range(300)]
    covered = sorted({x for a, b in rows for x in range(a, b)})
    out = intervals.compact(spark.createDataFrame(rows, "start long, limit long"), "start", "limit").orderBy("start").collect()
    assert [x for r_ in out for x in range(r_["start"], r_["limit"])] == covered
    assert all(a["limit"] < b["start"] for a, b in zip(out, out[1:]))


def test_advice(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"ranges": [], "instance_types": {}, "spot_advisor": {"r": {"Linux": {"x": {"r": 0, "s": 1}, "y": {"r": 3, "s": 2}}, "Windows": {"x": {"r": 4, "s": 0}}}}}')
    advice = advisor.read_advice(spark, str(tmp_path / "a.json"))
    sets = {(r["os"], r["bucket"]): r["instances"] for r in advisor.cumulative_sets(advice, ["region", "os"]).collect()}
    assert sets[("Linux", 0)] == ["x"] and sets[("Linux", 2)] == ["x"] and sets[("Linux", 3)] == ["x", "y"] and sets[("Windows", 3)] == []
    some = spark.createDataFrame([("x",), ("y",), ("z",)], "instance string")
    assert advisor.filter_candidates(some, advice, F.col("os") == "Linux", advisor.ANY).count() == 3
    assert [r[0] for r in advisor.filter_candidates(some, advice, F.col("os") == "Linux", 2).collect()] == ["x"]
    wanted = spark.createDataFrame([("q", "Linux", "x"), ("r", "BSD", "x"), ("r", "Linux", "q"), ("r", "Linux", "y")], "region string, os string, instance string")
    assert sorted((r["problem"] or "", r["bucket"] or -1) for r in advisor.lookup(advice, wanted).collect()) == [("", 3), ("no such instance", -1), ("no such os", -1), ("no such region", -1)]


def test_compact_without_keys_equals_brute_force(spark):
    import random

    r = random.Random(5)
    rows = [(s, s + r.choice([0, 1, 3, 50, 4000])) for s in (r.randrange(10**6) for _ in range(3000))] + [(7, 7), (0, 2)]
    got = sorted(map(tuple, intervals.compact(spark.createDataFrame(rows, "s long, e long"), "s", "e").select("start", "limit").collect()))
    want = []
    for s, e in sorted(x for x in rows if x[0] < x[1]):
        if want and s <= want[-1][1]:
            want[-1][1] = max(want[-1][1], e)
        else:
            want.append([s, e])
    assert got == [tuple(x) for x in want]
    assert intervals.compact(spark.createDataFrame(rows, "s long, e long").where("false"), "s", "e").count() == 0


def test_very_long_intervals_take_few_buckets(spark):
    year = 366 * 24 * 3600 * 10**6
    a = spark.createDataFrame([(1, 0, year), (2, 5, 6)], "x long, a_s long, a_e long")
    b = spark.createDataFrame([(1, year - 1, 3 * year), (2, 5, 7)], "y long, b_s long, b_e long")
    got = {(r["x"], r["y"]) for r in intervals.overlap_join(a, b, "a_s", "a_e", "b_s", "b_e").collect()}
    assert got == {(1, 1), (1, 2), (2, 2)}


@pytest.mark.parametrize("rows", [40, 10**6])
def test_compact_with_keys_large_and_small(spark, monkeypatch, rows):
    """Large keys are cut into ranges; a null key is one too; equal rows, whose order nothing tells, don't matter."""
    monkeypatch.setattr(intervals, "ROWS", rows)
    r = random.Random(7)
    data = []
    for k, n in ((1, 500), (2, 30), (None, 300), (4, 1)):
        data += [(k, "x", s, s + r.choice([0, 1, 3, 20, 400])) for s in (r.randrange(6000) for _ in range(n))]
    data += r.choices(data, k=200)
    df = spark.createDataFrame(data, "k int, name string, s long, e long")
    out = intervals.compact(df, "s", "e", ["k", "name"])
    got = sorted((str(x["k"]), x["name"], x["start"], x["limit"]) for x in out.collect())
    assert out.columns == ["k", "name", "start", "limit"]
    want = []
    for k, name, s, e in sorted((str(k), name, s, e) for k, name, s, e in data if s < e):
        if want and want[-1][0] == k and s <= want[-1][3]:
            want[-1][3] = max(want[-1][3], e)
        else:
            want.append([k, name, s, e])
    assert got == sorted(map(tuple, want))


def test_tasks_of_a_compaction_grow_with_its_rows(spark, monkeypatch):
    monkeypatch.setattr(intervals, "ROWS", 100)
    df = spark.range(3000).selectExpr("id % 50 AS k", "id AS s", "id + 2 AS e")
    used = intervals.compact(df, "s", "e", ["k"]).select("k", F.spark_partition_id().alias("p")).distinct().collect()
    assert len({x["p"] for x in used}) > 10  # four shuffle partitions in these tests


@pytest.mark.parametrize("far", [500, 10**15])
def test_overlap_totals_equal_the_pairs(spark, far):
    r = random.Random(far)
    make = lambda n: [(s := r.randint(-far, far), s + int(r.expovariate(1 / r.choice([3, 30, far])))) for _ in range(n)]
    a, b = make(150), make(130)
    a, b = a + a[:10] + [(5, 5), (6, 2)], b + b[:10] + [(7, 7)]
    got = intervals.overlap_totals(_df(spark, a, "ius"), _df(spark, b, "jvt"), "u", "s", "v", "t")
    want = []
    for i, (s, e) in enumerate(a):
        both = [min(e, y) - max(s, x) for x, y in b if s < e and x < y and e > x and y > s]
        if both:
            want.append((i, len(both), sum(both)))
    assert sorted((x["i"], x["pairs"], x["shared"]) for x in got.collect()) == want
    assert intervals.overlap_totals(_df(spark, a, "ius"), _df(spark, [], "jvt"), "u", "s", "v", "t").count() == 0


def test_overlap_totals_never_make_pairs(spark):
    """A thousand equal intervals on both sides: a million pairs, few rows."""
    a = spark.range(1000).selectExpr("id AS i", "0L AS u", "id + 1 AS s")
    b = spark.range(1000).selectExpr("id AS j", "0L AS v", "id + 1 AS t")
    out = intervals.overlap_totals(a, b, "u", "s", "v", "t")
    x = out.agg(F.sum("pairs"), F.sum("shared")).first()
    assert tuple(x) == (10**6, sum(min(p, q) for p in range(1, 1001) for q in range(1, 1001)))
