import bz2
import gzip
import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import sortedkv
from quern.sources import files, logfile, recordfile, tsv
from quern.streaming import state


@pytest.mark.parametrize("transform", [None, "zstd 3", "flate"])
def test_record_files_round_trip(spark, tmp_path, transform):
    recordfile.register(spark)
    r = random.Random(1)
    items = [r.randbytes(r.choice([0, 3, 200, 50_000])) for _ in range(60)]
    df = spark.createDataFrame([(i,) for i in items], "value binary").coalesce(1)
    out = str(tmp_path / "rec")
    w = df.write.format("recordfile").mode("append").option("maxItems", 4).option("trailer", "the end").option("header", json.dumps([["k", 7], ["k", "x"], ["b", True]]))
    (w.option("transform", transform) if transform else w).save(out)
    for shard in (1, 100_000, 1 << 30):
        got = spark.read.format("recordfile").option("shardBytes", shard).load(out).orderBy("path", "block", "item").collect()
        assert [bytes(x["value"]) for x in got] == items
        assert max(x["item"] for x in got) == 4  # a full block holds one more
    header = [(x["key"], x["type"], x["value"]) for x in spark.read.format("recordfile").option("part", "header").load(out).collect()]
    assert header[:3] == [("k", "int", "7"), ("k", "string", "x"), ("b", "bool", "true")]
    assert [bytes(x["value"]) for x in spark.read.format("recordfile").option("part", "trailer").load(out).collect()] == [b"the end"]
    block = got[-1]["block"]
    assert spark.read.format("recordfile").load(out).where(F.col("block") == block).count() >= 1


def test_corrupt_record_file_is_an_error(spark, tmp_path):
    recordfile.register(spark)
    data = bytearray(recordfile.chunks_of(recordfile.HEADER_MAGIC, recordfile.pack_items([recordfile.encode_header([])])) + recordfile.chunks_of(recordfile.BODY_MAGIC, recordfile.pack_items([b"abc"])))
    data[recordfile.CHUNK + 30] ^= 1
    (tmp_path / "f").write_bytes(data)
    with pytest.raises(Exception, match="checksum"):
        spark.read.format("recordfile").load(str(tmp_path / "f")).collect()


def _saved(spark, out, values, **options):
    df = spark.createDataFrame([(f"k{i}".encode(), v) for i, v in enumerate(values)], "key binary, value binary").coalesce(1)
    df.write.format("recordfile").mode(options.pop("mode", "append")).options(**options).save(str(out))
    return spark.read.format("recordfile").option("shardBytes", 1).load(str(out))


def test_record_filters_reach_the_reader(spark, tmp_path):
    recordfile.register(spark)
    read = _saved(spark, tmp_path / "rec", [bytes([i]) * 40_000 for i in range(12)], maxItems=1)
    blocks = sorted({r["block"] for r in read.select("block").collect()})
    assert len(blocks) == 6
    got = read.where(F.col("block").isin(blocks[1], blocks[4], 7)).select("item", "value")
    assert sorted(bytes(r["value"])[0] for r in got.collect()) == [2, 3, 8, 9]
    assert got.rdd.getNumPartitions() == 3  # the two blocks' shards and the file's first
    path = read.first()["path"]
    assert read.where((F.col("path") == path) & (F.col("block") == blocks[5])).count() == 2
    assert read.where(F.col("path") == "elsewhere").count() == 0


def test_record_overwrite_leaves_the_new_files_alone(spark, tmp_path):
    recordfile.register(spark)
    _saved(spark, tmp_path / "rec", [b"old"])
    assert [bytes(r["value"]) for r in _saved(spark, tmp_path / "rec", [b"new"], mode="overwrite").collect()] == [b"new"]
    assert _saved(spark, tmp_path / "rec", [b"more"]).count() == 2
    assert not [p for p in (tmp_path / "rec").iterdir() if p.name.startswith("_job")]


def test_record_transformers_of_ones_own(spark, tmp_path):
    swap = lambda config: lambda data: bytes(b ^ int(config or 1) for b in data)
    recordfile.register(spark, {"swap": (swap, swap)})
    read = _saved(spark, tmp_path / "rec", [b"abc", b""], transform=json.dumps(["flate", "swap 7"]))
    assert [bytes(r["value"]) for r in read.orderBy("item").collect()] == [b"abc", b""]
    recordfile.register(spark)
    with pytest.raises(Exception, match="unknown transformer swap"):
        read = spark.read.format("recordfile").load(str(tmp_path / "rec")).collect()
    with pytest.raises(ValueError, match="registered already"):
        recordfile.register(spark, {"zstd": (swap, swap)})


def test_record_index_finds_items(spark, tmp_path):
    recordfile.register(spark)
    values = [f"value {i}".encode() * 3000 for i in range(9)]
    _saved(spark, tmp_path / "rec", values, maxItems=3, transform="zstd", index=str(tmp_path / "idx"))
    index = spark.read.parquet(str(tmp_path / "idx"))
    assert index.count() == 9
    chosen = index.where(F.col("key").isin(b"k1", b"k6", b"k8"))
    got = recordfile.read_items(chosen.union(chosen)).join(index, ["path", "block", "item"])
    assert sorted((bytes(r["key"]), bytes(r["value"])) for r in got.collect()) == [(f"k{i}".encode(), values[i]) for i in (1, 6, 8)]
    with pytest.raises(Exception, match="no item 99"):
        recordfile.read_items(chosen.withColumn("item", F.lit(99))).collect()


def _old(magic, data):
    size = struct.pack("<Q", len(data))
    return magic + size + struct.pack("<I", zlib.crc32(size)) + data


def _old_packed(items, change=lambda b: b):
    sizes = recordfile.put_varint(len(items)) + b"".join(recordfile.put_varint(len(i)) for i in items)
    return _old(recordfile.BODY_MAGIC, struct.pack("<I", zlib.crc32(sizes)) + sizes + change(b"".join(items)))


def test_record_files_of_the_first_version(spark, tmp_path):
    recordfile.register(spark)
    flate = recordfile.TRANSFORMERS["flate"][0]("")
    (tmp_path / "a.rio").write_bytes(_old(recordfile.PLAIN_MAGIC, b"one") + _old(recordfile.PLAIN_MAGIC, b"") + _old(recordfile.PLAIN_MAGIC, b"x" * 90_000))
    (tmp_path / "b.rpk").write_bytes(_old_packed([b"two", b"", b"three"]) + _old_packed([b"four"]))
    (tmp_path / "c.x-rpk-gz").write_bytes(_old_packed([b"five" * 50, b"six"], flate))
    read = spark.read.format("recordfile").option("shardBytes", 1).load(str(tmp_path))
    got = [bytes(r["value"]) for r in read.orderBy("path", "block", "item").collect()]
    assert got == [b"one", b"", b"x" * 90_000, b"two", b"", b"three", b"four", b"five" * 50, b"six"]
    at = read.where(F.col("value") == b"four").first()
    assert (at["block"] > 0, at["item"]) == (True, 0)
    assert [bytes(r["value"]) for r in recordfile.read_items(read.where(F.col("value") == b"four")).collect()] == [b"four"]
    assert [bytes(r["value"]) for r in read.where((F.col("path") == at["path"]) & (F.col("block") == at["block"])).collect()] == [b"four"]
    assert spark.read.format("recordfile").option("part", "header").load(str(tmp_path)).count() == 0
    (tmp_path / "d.rio").write_bytes(_old(recordfile.PLAIN_MAGIC, b"cut")[:-1])
    with pytest.raises(Exception, match="cut off"):
        read.where(F.col("path").endswith("d.rio")).collect()
        spark.read.format("recordfile").load(str(tmp_path / "d.rio")).collect()


SCHEMA = T.StructType([T.StructField("key",T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("ok", T.BooleanType()), T.StructField("x", T.DoubleType())])


def test_tsv(spark, tmp_path):
    p = tmp_path / "a.tsv"
    p.write_text("key\tok\tn\tx\textra\na\tY\t0x1f\t1.5\tz\n\tno\t010\t-2\tz\n")
    rows = tsv.read_tsv(spark, str(p), SCHEMA, use_header_names=True).collect()
    assert [tuple(r) for r in rows] == [("a", 31, True, 1.5), ("", 8, False, -2.0)]
    with pytest.raises(ValueError, match="no field takes"):
        tsv.read_tsv(spark, str(p), SCHEMA, use_header_names=True, require_all_columns=True)
    more = T.StructType([*SCHEMA.fields, T.StructField("gone", T.LongType())])
    with pytest.raises(ValueError, match="no column for gone"):
        tsv.read_tsv(spark, str(p), more, use_header_names=True)
    assert tsv.read_tsv(spark, str(p), more, use_header_names=True, ignore_missing_columns=True).first()["gone"] == 0
    q = tmp_path / "b.tsv"
    q.write_text("a\t1\ty\t1\n")
    with pytest.raises(Exception, match="bad value in column ok"):
        tsv.read_tsv(spark, str(q), SCHEMA).collect()


def test_tsv_numbers(spark):
    words = ["1_000", "0b11", "0o17", "017", "-0x10", "128", "", "1__0", "08", "1.0", "_1"]
    df = spark.createDataFrame([(w,) for w in words], "s string")
    assert [r[0] for r in df.select(tsv.parse_value(F.col("s"), T.ByteType())).collect()] == [None, 3, 15, 15, -16, None, None, None, None, None, None]


def test_tsv_write(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.0, 2.5, [1, 2])], "s string, x double, y double, l array<int>").coalesce(1)
    tsv.write_tsv(df, str(tmp_path / "o"), formats={"y": "%.2f"})
    text = next((tmp_path / "o").glob("part-*")).read_text()
    assert text == "s\tx\ty\tl\na\t1\t2.50\t1,2\n"


def test_files(spark, tmp_path):
    (tmp_path / "a").write_bytes(gzip.compress(b"one"))
    (tmp_path / "b").write_bytes(bz2.compress(b"two"))
    (tmp_path / "c").write_bytes(b"three")
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("in/x", b"xx")
    (tmp_path / "d").write_bytes(z.getvalue())
    whole = files.read_whole(spark, str(tmp_path))
    plain = {r["path"][-1]: (r["compression"], bytes(r["content"])) for r in files.decompressed(whole).where("path not like '%d'").collect()}
    assert plain == {"a": ("gzip", b"one"), "b": ("bzip2", b"two"), "c": ("none", b"three")}
    entries = files.zip_entries(whole.where("path like '%/d'")).collect()
    assert [(e["path"].rsplit("/d/", 1)[1], bytes(e["content"])) for e in entries] == [("in/x", b"xx")]
    assert files.list_files(spark, str(tmp_path)).count() == 4
    assert bytes(whole.where("path like '%c'").select(files.read_at(F.col("content"), 2, 3).alias("x")).first()["x"]) == b"ree"
    with pytest.raises(ValueError):
        files.write_compressed(spark.createDataFrame([("x",)], "value string"), str(tmp_path / "o"), "bzip2")


def test_sorted_tables(spark, tmp_path):
    rows = [(bytes([255]), b"z"), (bytes([0, 1]), b"a"), (bytes([127]), b"m"), (bytes([127]), b"n")]
    df = spark.createDataFrame(rows, "key binary, value binary")
    sortedkv.write_sorted(df, str(tmp_path / "kv"), files=2)
    again = spark.read.parquet(str(tmp_path / "kv"))
    assert [bytes(r["key"]) for r in sortedkv.seek(again, F.lit(bytes([127]))).collect()] == [bytes([127])] * 2 + [bytes([255])]
    assert sortedkv.merge([df, df]).count() == 8


def test_feed_stream_and_event_sink(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    name = "123456789000.2021-02-20-18.002.cf3d1500"
    line = "2021-02-20 18:52:50 UTC\tU:x\top\ti-1\tsir\t6.669 USD\t0.225 USD\t0.073 USD\t2\n"
    (src / name).write_text("#c\n" + line)
    entries = state.stream_feed(spark, str(src))
    events = entries.select(state.event_json(F.lit("usage"), {"id": F.col("instance_id"), "charge": F.col("charge_usd")}).alias("value"))
    for n in (1, 2):
        query = state.write_events(events, str(tmp_path / "out"), str(tmp_path / "ck"), {"availableNow": True})
        query.awaitTermination()
        got = [r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()]
        assert got == ['{"charge":0.073,"event_type":"usage","id":"i-1"}'] * n
        (src / name.replace("-18.", "-19.")).write_text(line)


def test_restore_wants_the_snapshots_epoch(spark):
    U, S = state.UPDATE, state.SNAPSHOT
    log = spark.createDataFrame([(1, S, 0, b"a"), (2, U, 1, b"b"), (3, S, 1, b"c"), (4, U, 3, b"d")], "off long, typ int, epoch long, data binary")
    assert sorted(r["off"] for r in state.restore(log).collect()) == [3, 4]
    assert [r["epoch"] for r in state.epochs(log.drop("epoch")).orderBy("off").collect()] == [0, 1, 1, 3]
    assert sorted(r["off"] for r in state.restore(state.epochs(log.where(f"typ = {U}"))).collect()) == [2, 4]
    bad = log.union(spark.createDataFrame([(5, U, 1, b"e")], log.schema))
    with pytest.raises(Exception, match="epoch"):
        state.restore(bad).collect()


def _log(spark, path, **options):
    return spark.read.format("logfile").options(**options).load(str(path))


def test_logs_round_trip(spark, tmp_path):
    logfile.register(spark)
    r = random.Random(2)
    room = logfile.BLOCK - logfile.HEAD.size
    values = [r.randbytes(n) for n in [1, room - 16, 5, 100_000, 3, room, room + 1, 70_000, 1] + [r.choice([7, 900, 40_000]) for _ in range(40)]]
    df = spark.createDataFrame([(v,) for v in [*values, b"", None]], "data binary").coalesce(1)
    df.write.format("logfile").mode("append").save(str(tmp_path / "log"))
    for shard in (1, 100_000, 1 << 30):
        rows = _log(spark, tmp_path / "log", shardBytes=shard).orderBy("off").collect()
        assert [bytes(x["data"]) for x in rows] == values
    df.limit(1).write.format("logfile").mode("overwrite").save(str(tmp_path / "log"))
    assert _log(spark, tmp_path / "log").count() == 1


def test_damaged_logs_resync(spark, tmp_path):
    logfile.register(spark)
    data, starts = b"", []
    values = [bytes([i]) * 20_000 for i in range(12)]
    for v in values:
        at, more = logfile.put_entry(len(data), v)
        starts.append(at)
        data += more
    hurt = next(i for i, at in enumerate(starts) if at > 2 * logfile.BLOCK)
    bad = bytearray(data)
    bad[starts[hurt] + 100] ^= 1
    (tmp_path / "bad").write_bytes(bad)
    (tmp_path / "cut").write_bytes(data[:-1000])
    # Of the damaged record's block, what follows is lost; the next entry read begins in a later block.
    end = (starts[hurt] // logfile.BLOCK + 1) * logfile.BLOCK
    left = [i for i, at in enumerate(starts) if at < starts[hurt] or at >= end]
    for shard in (1, 1 << 30):
        got = _log(spark, tmp_path / "bad", resync="true", shardBytes=shard).orderBy("off").collect()
        assert [bytes(x["data"])[0] for x in got] == left
        assert [bytes(x["data"])[0] for x in _log(spark, tmp_path / "cut", resync="true", shardBytes=shard).orderBy("off").collect()] == list(range(11))
        for name in ("bad", "cut"):
            with pytest.raises(Exception, match="damaged"):
                _log(spark, tmp_path / name, shardBytes=shard).collect()


def test_state_logs_restore(spark, tmp_path):
    logfile.register(spark)
    U, S = state.UPDATE, state.SNAPSHOT
    rows = [(U, b"0"), (S, b"one"), (U, b"1"), (S, b"x" * 50_000), (U, b"2"), (U, b"")]
    spark.createDataFrame(rows, "typ int, data binary").coalesce(1).write.format("logfile").mode("append").option("state", "true").save(str(tmp_path / "log"))
    log = _log(spark, tmp_path / "log", state="true")
    assert [(r["typ"], bytes(r["data"])) for r in log.orderBy("off").collect()] == rows
    assert [(r["typ"], bytes(r["data"])) for r in state.restore(log, ["path"]).orderBy("off").collect()] == rows[3:]
