import random

import pytest
from pyspark.sql import functions as F

from quern.functions import bytesfn as B
from quern.functions import digestfn as D


def test_all_bytes_round_trip(spark):
    raw = bytes(range(256))
    df = spark.createDataFrame([(raw,), (b"",)], "b binary")
    rows = df.select(B.unsigned_bytes(F.col("b")).alias("u"), B.pack(B.unsigned_bytes(F.col("b"))).alias("p"), B.reverse_bytes(F.col("b")).alias("r"), B.popcount(F.col("b")).alias("n")).collect()
    assert rows[0]["u"] == list(raw) and bytes(rows[0]["p"]) == raw and bytes(rows[0]["r"]) == raw[::-1] and rows[0]["n"] == 1024
    assert rows[1]["u"] == [] and bytes(rows[1]["p"]) == b"" and rows[1]["n"] == 0


def test_kernels_equal_naive(spark):
    r = random.Random(3)
    data = [(r.randbytes(n), r.randbytes(n)) for n in (r.randint(0, 40) for _ in range(60))]
    df = spark.createDataFrame(data, "a binary, b binary")
    a, b = F.col("a"), F.col("b")
    t = [r.randrange(2) for _ in range(16)]
    got = df.select("a", "b", B.bytes_xor(a, b).alias("x"), B.bytes_and_not(a, b).alias("n"), B.first_unequal(a, b, 2).alias("u"), B.first_greater(a, 200).alias("g"), B.first_at_most(a, 30).alias("l"), B.count_nibbles(a, t).alias("c"), B.sum_bytes_over(a, 99).alias("s"), B.bit_of_every_byte(a, 5).alias("bits"), B.bytes_subtract_from_const(a, 7).alias("m")).collect()
    for row in got:
        x, y = bytes(row["a"]), bytes(row["b"])
        assert bytes(row["x"]) == bytes(p ^ q for p, q in zip(x, y))
        assert bytes(row["n"]) == bytes(p & ~q for p, q in zip(x, y))
        assert row["u"] == next((i for i in range(2, len(x)) if x[i] != y[i]), len(x))
        assert row["g"] == next((i for i, p in enumerate(x) if p > 200), len(x))
        assert row["l"] == next((i for i, p in enumerate(x) if p <= 30), len(x))
        assert row["c"] == sum(t[p & 15] + t[p >> 4] for p in x)
        assert row["s"] == sum(p for p in x if p > 99)
        assert bytes(row["m"]) == bytes((7 - p) % 256 for p in x)
        assert bytes(row["bits"]) == bytes(sum(((x[g + k] >> 5) & 1) << k for k in range(8) if g + k < len(x)) for g in range(0, len(x), 8))


def test_length_mismatch_is_an_error(spark):
    with pytest.raises(Exception, match="differ in length"):
        spark.createDataFrame([(b"a", b"ab")], "a binary, b binary").select(B.bytes_and(F.col("a"), F.col("b"))).collect()


def test_nan_and_bits(spark):
    df = spark.createDataFrame([([1.0, float("nan")],), ([float("-inf")],), ([2.0],), ([],)], "a array<double>")
    assert [r[0] for r in df.select(B.first_nan_or_inf(F.col("a"))).collect()] == [1, 0, -1, -1]
    one = spark.range(1).select(B.set_interval(B.clear_bits(200), F.lit(3), F.lit(130)).alias("w"))
    w = F.col("w")
    row = one.select(B.bit_places(w).alias("p"), B.bit_places(B.clear_interval(w, F.lit(10), F.lit(129))).alias("q"), B.test_bit(w, F.lit(64)).alias("t"), B.bit_places(B.set_interval(w, F.lit(9), F.lit(2))).alias("same"), B.bit_places(B.clear_bits(64)).alias("none")).first()
    assert row["p"] == list(range(3, 130)) == row["same"] and row["q"] == [*range(3, 10), 129] and row["t"] and row["none"] == []


def test_digests_and_paths(spark):
    h = "ab" * 32
    df = spark.createDataFrame([("sha256:" + h,)], "d string")
    d = F.col("d")
    row = df.select(D.digest_truncate(d, 4).alias("t"), D.digest_is_short(D.digest_truncate(d, 4)).alias("s"), D.digest_expands(d, D.digest_truncate(d, 3)).alias("e"), D.digest_abbreviation(D.digest_truncate(d, 3)).alias("n"), D.parse_digest(F.lit("")).alias("z")).first()
    assert row["t"] == "sha256:" + "ab" * 4 + "00" * 28 and row["s"] and row["e"] and row["n"] == 3 and row["z"] == ""
    with pytest.raises(Exception, match="invalid digest"):
        df.select(D.parse_digest(F.lit("nohash:00"))).collect()
    paths = spark.createDataFrame([(p,) for p in ("s3:/b/k", "s3://b/k", "s3//b", "s:/b", "/local/x.gz", "fam-rpk-gz.x-rpk-gz")], "p string")
    assert [r[0] for r in paths.select(D.spell_correct_store(F.col("p"))).collect()] == ["s3://b/k", "s3://b/k", "s3://b", "s3://b", "/local/x.gz", "fam-rpk-gz.x-rpk-gz"]
    assert [r[0] for r in paths.select(D.file_type(F.col("p"))).collect()][4:] == ["gzip", "record-packed-compressed"]
    names = spark.createDataFrame([("s3://b/c/d/",), ("a",), ("/x",)], "p string").select(D.path_base(F.col("p")).alias("b"), D.path_dir(F.col("p")).alias("d"), D.path_is_absolute(F.col("p")).alias("a")).collect()
    assert [r["b"] for r in names] == ["d", "a", "x"] and [r["a"] for r in names] == [True, False, True] and names[1]["d"] == "."


def test_little_endian_and_sizes(spark):
    row = spark.range(1).select(D.little_endian(F.lit(-2), 8).alias("a"), D.little_endian(F.lit(258), 2).alias("b"), D.format_size(F.lit(1536)).alias("s"), D.format_size(F.lit(5)).alias("t"), D.coarse_time(F.lit(-1)).alias("w")).first()
    assert bytes(row["a"]) == (-2).to_bytes(8, "little", signed=True) and bytes(row["b"]) == b"\x02\x01" and (row["s"], row["t"], row["w"]) == ("1.5KiB", "5B", 0)


def test_sizes_below_zero_and_first_unequal_from_a_start(spark):
    from quern.functions import bytesfn, digestfn

    row = spark.createDataFrame([(-2048, bytearray(b"abcdef"), bytearray(b"axcdeg"))], "n long, a binary, b binary").select(
        digestfn.format_size(F.col("n")).alias("size"), bytesfn.first_unequal(F.col("a"), F.col("b")).alias("x"), bytesfn.first_unequal(F.col("a"), F.col("b"), 2).alias("y"), bytesfn.first_unequal(F.col("a"), F.col("b"), 9).alias("z")
    ).first()
    assert tuple(row) == ("-2.0KiB", 1, 5, 6)
