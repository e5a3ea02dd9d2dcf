import random

import pytest
from pyspark.sql import functions as F

from quern.operators import usage

MINUTE = 60_000_000
NOW = 1_700_000_000_000_000
END = 400


def _prorated(entries, start, end, terminated):
    """(start, end, charge) in minutes, minute by minute; None without data."""
    own = {}
    for t, c in entries:
        own[t] = max(own.get(t, 0), c)
    times = sorted(own)
    first, last = times[0], times[-1]
    if start >= last or end < first:
        return None
    charge = sum(own[t] / (u - t) for t, u in zip(times, times[1:], strict=False) for m in range(t, u) if start <= m < end)
    over = terminated is not None and end >= terminated
    if end >= last:
        charge += own[last] if terminated is None or over else own[last] * (end - last) / (terminated - last)
    return max(start, first), terminated if over else end, charge


def test_cost_equals_minutes_added_up(spark):
    r = random.Random(5)
    feeds = {f"i-{k}": [(r.randrange(-100, 300), r.randrange(1, 90)) for _ in range(r.choice([1, 2, 6, 15]))] for k in range(8)}
    feeds["i-0"] += [(t, c + 1) for t, c in feeds["i-0"]]  # repeats of a time count by their greatest charge
    cases = []
    for name, entries in feeds.items():
        edges = [-200, *{t for t, _ in entries}, *(r.randrange(-150, 450) for _ in range(6)), 500]
        for _ in range(14):
            start, end = sorted(r.sample(edges, 2))
            cases.append((name, start, end, r.choice([None, END])))
    at = lambda m: None if m is None else NOW + m * MINUTE
    entries = spark.createDataFrame([(i, at(t), float(c)) for i, own in feeds.items() for t, c in own], "instance_id string, ts long, charge_usd double")
    rows = [(k, i, at(s), at(e), at(t)) for k, (i, s, e, t) in enumerate(cases)] + [(999, "other", NOW, NOW, None)]
    requests = spark.createDataFrame(rows, "request_id int, instance_id string, start long, end long, terminated long")
    got = {x["request_id"]: x for x in usage.cost(entries, requests).collect()}
    want = {k: w for k, (i, s, e, t) in enumerate(cases) if (w := _prorated(feeds[i], s, e, t)) is not None}
    assert got.keys() == want.keys() and 20 < len(want) < len(cases)
    for k, (start, end, charge) in want.items():
        assert (got[k]["cost_start"], got[k]["cost_end"]) == (at(start), at(end))
        assert got[k]["charge"] == pytest.approx(charge)


NAME = "123456789000.2021-02-20-18.002.cf3d1500"
LINE = "2021-02-20 18:52:50 UTC\tEU-SpotUsage:x1e.2xlarge\tRunInstances:SV002\ti-0053c2917e2afa2f0\tsir-yb3gavgp\t6.669 USD\t0.225 USD\t0.073 USD\t2"


def test_parse_lines(spark):
    lines = spark.createDataFrame([("#Version: 1.0", NAME), (LINE, NAME)], "value string, file_name string")
    row = usage.parse_lines(lines).first()
    assert (row["account_id"], row["instance"], row["charge_usd"], row["version"]) == ("123456789000", "x1e.2xlarge", 0.073, 2)
    bad = spark.createDataFrame([(LINE, "a." + NAME), (LINE, NAME), (LINE.replace(" USD", ""), NAME)], "value string, file_name string")
    with pytest.raises(Exception, match="bad feed line"):
        usage.parse_lines(bad).collect()
    assert usage.parse_lines(bad, tolerate=True).count() == 0  # all lines of a bad file go


def test_names_and_types(spark):
    df = spark.createDataFrame([(NAME, "SpotUsage"), (NAME + ".gz", "a:b"), ("x", "a:b:c")], "n string, u string")
    rows = df.select(usage.file_meta(F.col("n")).alias("m"), usage.instance_of(F.col("u")).alias("i")).collect()
    assert [r["i"] for r in rows] == ["m1.small", "b", None]
    assert rows[0]["m"]["version"] == 2 and not rows[0]["m"]["gzip"] and rows[1]["m"]["gzip"] and rows[2]["m"] is None


def test_read_feed_folder(spark, tmp_path):
    (tmp_path / NAME).write_text("#c\n" + LINE + "\n")
    other = NAME.replace("-18.", "-20.")
    (tmp_path / other).write_text(LINE.replace("18:52", "20:52") + "\n")
    assert usage.read_feed(spark, str(tmp_path), account="123456789000", start="2021-02-20 18:00:00", end="2021-02-20 20:00:00").count() == 1
    assert usage.read_feed(spark, str(tmp_path)).count() == 2
