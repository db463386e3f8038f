"""Case tables of the key-value model, the store's life cycle, streams."""

import hashlib
import os
import random

import pytest
from pyspark.sql import functions as F

from kvlake.__main__ import main
from kvlake.functions.scalar import common_prefix, key_status, value_status
from kvlake.operators import log, manifest, read, runs, workload
from kvlake.plans.engine import Engine, InvalidArgument, NotFound
from kvlake.schema import Options
from kvlake.sources import tables
from kvlake.streaming import upsert

CASES = [
    ([], "abcd", None),
    ([("abc", 1, b"123")], "abc", (b"123", 1)),
    ([("abc", 1, b"123")], "ab", None),
    ([("abc", 1, b"123")], "abcd", None),
    ([("a", 3, b"1"), ("b", 2, b"2"), ("c", 1, b"3")], "b", (b"2", 2)),
    ([("a", 1, b"1"), ("a", 20, b"2"), ("a", 3, b"3")], "a", (b"2", 20)),
    ([("a", 1, b"1"), ("b", 2, None), ("c", 3, b"3")], "b", (None, 2)),
    ([("abaa", 1, b"1"), ("abbb", 10, b"2"), ("abbbd", 1, b"3"), ("abc", 1, b"4"), ("e", 1, b"5")], "abbbd", (b"3", 1)),
    ([(k, 13, v) for k, v in zip("abcde", (b"1", b"2", b"3", b"4", b"5"))], "ee", None),
]


@pytest.mark.parametrize("rows,key,want", CASES)
def test_latest(spark, rows, key, want):
    got = read.latest_version(tables.rows(spark, rows).where(F.col("key") == key)).collect()
    assert [(bytes(r.value) if r.value is not None else None, r.ts) for r in got] == ([want] if want else [])


def test_scan_and_merge(spark):
    rows = [("b", 1, b"1"), ("b", 5, b"2"), ("a", 300, b"3"), ("é", 1, b""), ("Z", 2, None)]
    assert [(r.key, r.ts) for r in read.scan(tables.rows(spark, rows)).collect()] == [("Z", 2), ("a", 300), ("b", 5), ("b", 1), ("é", 1)]
    left, right = [("abc", 0, b"1"), ("abe", 0, b"1")], [("abd", 0, b"1"), ("abe", 1, b"1")]
    got = runs.kway_merge([tables.rows(spark, left), tables.rows(spark, right)]).collect()
    assert [(r.key, r.ts) for r in got] == [("abc", 0), ("abd", 0), ("abe", 1), ("abe", 0)]
    assert runs.kway_merge([tables.rows(spark, [])]).count() == 0


def test_run_round_trip(spark, tmp_path):
    rows = [(str(i), i + 1, None if i % 7 == 0 else bytes([i % 256])) for i in range(1000)]
    runs.write_run(tables.rows(spark, rows), str(tmp_path / "run"), files=3)
    back = spark.read.parquet(str(tmp_path / "run"))
    assert sorted((r.key, r.ts, bytes(r.value) if r.value is not None else None) for r in back.collect()) == sorted(rows, key=lambda r: r[0])
    plan = back.where(F.col("key") == "77")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(key), EqualTo(key,77)]" in plan


def test_random_model(spark):
    r = random.Random(7)
    rows, model = [], {}
    for seq, ts in enumerate(r.sample(range(10**6), 4000), 1):
        key = "".join(r.choice("abc") for _ in range(r.randrange(1, 8)))
        rows.append((key, ts, None if r.random() < 0.1 else str(seq).encode()))
        if key not in model or ts > model[key][0]:
            model[key] = (ts, rows[-1][2])
    df = tables.rows(spark, rows).repartition(5)
    assert {x.key: (x.ts, bytes(x.value) if x.value is not None else None) for x in read.latest_version(df).collect()} == model
    probes = spark.createDataFrame([(k,) for k in [*list(model)[:50], "zzz", "", "x" * 4097, "é" * 2049]], "key string")
    got = {x.key: x.status for x in read.multi_get(df, probes).collect()}
    for k, status in got.items():
        assert status == ("InvalidArgument" if not 0 < len(k.encode()) <= 4096 else "OK" if model.get(k, (0, None))[1] is not None else "NotFound")


def test_limits(spark):
    keys = ["", "a", "a" * 4096, "a" * 4097, "é" * 2048, "é" * 2049, None]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    assert [r[0] for r in df.select(key_status(F.col("k"))).collect()] == ["InvalidArgument", "OK", "OK", "InvalidArgument", "OK", "InvalidArgument", "InvalidArgument"]
    df = spark.createDataFrame([(bytearray(524_288),), (bytearray(524_289),), (None,), (bytearray(),)], "v binary")
    assert [r[0] for r in df.select(value_status(F.col("v"))).collect()] == ["OK", "InvalidArgument", "OK", "OK"]


def test_replay_and_guard(spark):
    rows = [(1, 5, "a"), (2, 5, "b"), (3, 4, "c"), (4, 7, None), (5, 6, "d"), (6, 8, "e"), (7, 9, "f")]
    df = spark.createDataFrame([(p, s, k, "PUT", "v") for p, s, k in rows], "pos long, seq long, key string, type string, value string").repartition(3)
    for block in (1, 2, 100):
        assert [(r.seq, r.key) for r in log.replay(df, 0, block=block).orderBy("pos").collect()] == [(5, "a"), (8, "e"), (9, "f")]
        assert [r.key for r in log.replay(df, 8, block=block).collect()] == ["f"]
        assert sorted(r.pos for r in log.seq_violations(df, block=block).collect()) == [3, 5]
    bad = df.withColumn("type", F.lit("UNSPECIFIED"))
    with pytest.raises(Exception, match="unknown mutation type"):
        log.replay(bad, 0).collect()


def test_rollover(spark):
    r = random.Random(1)
    rows = [(s, "k" * r.randrange(1, 30), None, lg) for lg in range(3) for s in range(1, 60)]
    df = spark.createDataFrame(rows, "seq long, key string, value string, log int").repartition(4)
    want, held, start, last = {}, 0, 0, None
    for s, k, _, lg in sorted(rows, key=lambda x: (x[3], x[0])):
        if lg != last or held > 100:
            last, held, start = lg, 0, s
        held += len(k) + 8
        want[lg, s] = start
    assert {(x.log, x.seq): x.segment for x in log.rollover(df, 100, "log").collect()} == want


def test_append_is_gapless(spark):
    df = spark.createDataFrame([(i % 37, str(i)) for i in range(500)], "ts long, key string").repartition(6)
    got = log.append(10, df, ["ts", "key"]).orderBy("seq").collect()
    assert [x.seq for x in got] == list(range(11, 511)) and [(x.ts, x.key) for x in got] == sorted((i % 37, str(i)) for i in range(500))
    assert log.append(10, df.limit(0), ["ts"]).count() == 0


def test_names_and_manifests(spark):
    names = ["wal-10.log", "wal-9.log", "other", "wal-3.logs", "descriptor.9", "descriptor.57", "descriptor.58.tmp"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    assert [r.name for r in log.list_segments(df).collect()] == ["wal-9.log", "wal-10.log"]
    assert manifest.latest_manifest(df).first().name == "descriptor.57"
    for bad, listed in (("wal-x.log", log.list_segments), ("wal-.log", log.list_segments), ("descriptor.x", manifest.latest_manifest)):
        with pytest.raises(Exception, match="no number in the name"):
            listed(df.union(spark.createDataFrame([(bad,)], "name string"))).collect()
    seg = spark.createDataFrame([(1,), (10,), (20,)], "start_seq long")
    assert [r.start_seq for r in log.truncatable(seg, 10).collect()] == [] and [r.start_seq for r in log.truncatable(seg, 11).collect()] == [1]


def test_sparse_index_and_prefix(spark):
    r = random.Random(2)
    words = sorted({"".join(r.choice("abé") for _ in range(r.randrange(1, 6))) for _ in range(300)})
    blocks, probes = words[::7], [*words, "zzz", ""]
    got = read.sparse_index_find(spark.createDataFrame([(w,) for w in probes], "key string"), spark.createDataFrame([(w,) for w in blocks], "last_key string"))
    order = lambda w: w.encode()
    assert {x.key: x.last_key for x in got.collect()} == {p: min((b for b in blocks if order(b) >= order(p)), key=order, default=None) for p in probes}
    df = spark.createDataFrame([(i % 3, w) for i, w in enumerate(words)], "run int, key string")
    coded = runs.prefix_encode(df)
    assert sorted((x.run, x.key) for x in runs.prefix_decode(coded).collect()) == sorted((i % 3, w) for i, w in enumerate(words))
    assert coded.where("(n - 1) % 16 = 0 and shared > 0").count() == 0
    with pytest.raises(Exception, match="the coded keys are damaged"):
        runs.prefix_decode(coded.withColumn("shared", F.when(F.col("n") == 5, 99).otherwise(F.col("shared")))).collect()
    pair = spark.createDataFrame([("abc", "abd"), ("", "a"), ("ab", "ab"), ("é", "éa"), ("x" * 4096, "x" * 4095 + "y"), ("x" * 4096, "x" * 4096)], "a string, b string")
    assert [x[0] for x in pair.select(common_prefix(F.col("a"), F.col("b"))).collect()] == [2, 0, 2, 1, 4095, 4096]
    assert read.sparse_index_find(spark.createDataFrame([("a",)], "key string"), spark.createDataFrame([], "last_key string")).collect() == [("a", None)]


def test_workload(spark):
    df = spark.createDataFrame([(0, 500, False), (0, 2000, False), (1, 3500, True)], "worker int, latency_us long, error boolean")
    assert sorted(x.latency_us for x in workload.corrected(df, 1000).collect()) == [500, 1000, 1500, 2000, 2500, 3500]
    assert workload.count_and_rate(df, 2).first() == (3, 1.5, 1)
    load = tables.load_data(spark, 200)
    first = load.first()
    assert len(first.key) == 10 and len(first.value) == 800 and load.select("key").distinct().count() == 200
    paced = workload.paced_requests(load, 100, 10.0, 5)
    assert paced.count() == 100 and paced.where("at_us < 0").count() == 0
    assert paced.select("key").distinct().count() > 60 and workload.paced_requests(load.limit(0), 100, 10.0, 5).count() == 0


def test_bloom_filter_false_positives(spark, tmp_path):
    """The filter in the written file has every key and at most 2 % of 5,000 others, and a lookup reads no row group without it."""
    df = spark.range(16_000).select(F.sha2(F.col("id").cast("string"), 256).alias("key"), F.col("id").alias("ts"), F.lit(None).cast("binary").alias("value"))
    runs.write_run(df, str(tmp_path / "r"), bloom_keys=16_000)
    parquet, file = spark._jvm.org.apache.parquet, next((tmp_path / "r").glob("part-*.parquet"))
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    reader = parquet.hadoop.ParquetFileReader.open(parquet.hadoop.util.HadoopInputFile.fromPath(spark._jvm.org.apache.hadoop.fs.Path(str(file)), conf))
    blocks = reader.getFooter().getBlocks()
    assert blocks.size() == 1
    bloom = reader.readBloomFilter(blocks.get(0).getColumns().get(0))
    has = lambda key: bloom.findHash(bloom.hash(parquet.io.api.Binary.fromString(key)))
    key = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    assert all(has(key(i)) for i in range(0, 16_000, 20))
    absent = [i for i in range(20_000, 25_000) if has(key(i))]
    assert len(absent) <= 0.02 * 5_000
    reader.close()
    back = spark.read.parquet(str(tmp_path / "r"))
    assert back.where(F.col("key") == key(77)).count() == 1

    def read_rows(k):
        found = back.where(F.col("key") == k)
        assert found.collect() == []
        return found._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value()

    assert sum(read_rows(key(i)) for i in range(20_000, 20_020) if i not in absent) == 0
    there = back.where(F.col("key") == key(77))
    assert there.count() == 1 and len(there.collect()) == 1
    assert there._jdf.queryExecution().executedPlan().collectLeaves().head().metrics().apply("numOutputRows").value() <= 2_000, "a page or two of 16,000 rows"


def test_layers_of_runs_with_equal_times(spark):
    """Among runs the first wins, whatever the sequences; above them, and within a run, the later sequence."""
    rows = [("a", 5, 2, 0, 1, "old"), ("a", 5, 2, 1, 2, "new"), ("b", 5, 0, 0, 1, "old"), ("b", 5, 0, 1, 2, "new"), ("c", 5, 2, 3, 8, "late"), ("c", 5, 2, 3, 7, "early"), ("c", 4, 2, 0, 9, "older")]
    df = spark.createDataFrame(rows, "key string, ts long, layer int, run int, seq long, value string")
    assert {r.key: r.value for r in read.layered(df).collect()} == {"a": "old", "b": "new", "c": "late"}


def test_a_get_reads_little(spark, tmp_path):
    """The key reaches the scans of the log and of the runs; applied segments are not read; nothing is sorted beforehand."""
    db = Engine(spark, str(tmp_path / "db"))
    for i in range(3):
        db.set(f"k{i}", b"x")
        if i == 1:
            db.flush(force=True)
    rows = db.versions().where(F.col("key") == "k2")
    plan = rows._jdf.queryExecution().toString()
    physical = plan.split("== Physical Plan ==")[1]
    assert physical.count("EqualTo(key,k2)") == 2 and physical.count("FileScan parquet") == 2 and "GreaterThan(seq,2)" in physical
    assert "Exchange" not in physical and "Window" not in physical
    assert {f.split("/")[-2] for f in db.delta().inputFiles()} == {"wal-3.log"}
    assert db.get("k2")[1] == b"x" and db.get("k0")[1] == b"x"


def test_writes_flush_and_compact(spark, tmp_path):
    """300 keys in small batches with tiny limits: every earlier key stays readable, runs and segments stay few."""
    db = Engine(spark, Options(str(tmp_path / "db"), flush_bytes=2_000, segment_bytes=400, compact_above=3, orphan_age_s=0))
    want = {}
    for i in range(0, 300, 30):
        rows = [(str(j), "PUT", j, bytearray(bytes([j % 256]) + b"x" * 99)) for j in range(i, i + 30)]
        db.write(spark.createDataFrame(rows, "key string, type string, ts long, value binary"))
        want |= {str(j): j % 256 for j in range(i, i + 30)}
        assert {r.key: r.value[0] for r in db.view().collect()} == want
        assert len(db.manifest.runs) <= 3
    assert db.manifest.applied_until == db.seq == 300 and db.unflushed == 0
    assert len(db._segments()) <= 2 and len(os.listdir(tmp_path / "db" / "runs")) <= 8
    last = tmp_path / "db" / "log" / db._segments()[-1][1]
    assert len(list(last.glob("part-*.parquet"))) >= 8, "files of some 400 bytes of records"
    again = Engine(spark, str(tmp_path / "db"))
    assert again.seq == 300 and again.unflushed == 0
    again.set("more", b"1")
    assert Engine(spark, str(tmp_path / "db")).unflushed == 13


def test_a_batch_is_checked_as_written(spark, tmp_path):
    """A source that turns bad between two readings doesn't get in; a bad row fails the whole batch."""
    db = Engine(spark, str(tmp_path / "db"))
    rows = spark.createDataFrame([("a", "PUT", 1, bytearray(b"1")), ("", "PUT", 2, bytearray(b"2"))], "key string, type string, ts long, value binary")
    with pytest.raises(InvalidArgument):
        db.write(rows)
    assert db.seq == 0 and not db._segments()
    assert db.write(rows, strict=False) == 1 and db.view().count() == 1
    assert db.write(rows.limit(0)) == 1
    db.files.commit(f"{db.options.log}/wal-2.log/x", "")  # another writer was faster
    with pytest.raises(FileExistsError):
        db.write(rows.where("key = 'a'"))
    stage = f"{tmp_path}/db/stage"
    db.files.commit(f"{stage}/y", "")
    with pytest.raises(FileExistsError):
        db.files.move(stage, f"{db.options.log}/wal-2.log")
    assert os.listdir(tmp_path / "db" / "log" / "wal-2.log") in (["x"], [".x.crc", "x"], ["x", ".x.crc"])


def test_holds_keep_files(spark, tmp_path):
    db = Engine(spark, Options(str(tmp_path / "db"), orphan_age_s=0))
    for i in range(2):
        db.set("k", bytes([i]), ts=i)
        db.flush(force=True)
    with db.hold():
        view = db.runs()
        db.compact(force=True)
        db.clean()
        assert view.count() == 2
    assert len(db.clean()) >= 2
    with pytest.raises(Exception, match="(?i)exist|found"):
        view.count()


def test_a_damaged_manifest_is_an_error(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    db.set("k", b"1")
    db.flush(force=True)
    path = tmp_path / "db" / "manifest" / "descriptor.1"
    (path.parent / ".descriptor.1.crc").unlink(missing_ok=True)
    whole = path.read_text()
    for bad in (whole.replace('"applied_until": 1', '"applied_until": 9'), whole[:-3], whole.partition("\n")[2], ""):
        path.write_text(bad)
        with pytest.raises(ValueError, match="damaged"):
            Engine(spark, str(tmp_path / "db"))
    path.write_text(whole)
    assert Engine(spark, str(tmp_path / "db")).get("k")[1] == b"1"
    path.rename(path.parent / "descriptor.x")
    with pytest.raises(ValueError):
        Engine(spark, str(tmp_path / "db"))


def test_life_cycle(spark, tmp_path):
    base = str(tmp_path / "db")
    db = Engine(spark, base)
    db.set("first", b"\x01\x02")
    assert db.get("first")[1] == b"\x01\x02"
    db = Engine(spark, base)
    assert db.get("first")[1] == b"\x01\x02", "the first record survives a restart"
    db.set("second", b"")
    db = Engine(spark, base)
    assert db.get("second")[1] == b"" and db.seq == 2
    with pytest.raises(NotFound):
        db.get("blah")
    for bad in ("", "a" * 4097):
        with pytest.raises(InvalidArgument):
            db.get(bad)
        with pytest.raises(InvalidArgument):
            db.set(bad, b"1")
    with pytest.raises(InvalidArgument):
        db.set("a", bytes(524_289))
    assert db.flush(force=True) and not db.flush(force=True)
    assert db.delta().count() == 0 and db.get("first")[1] == b"\x01\x02"
    db.delete("first")
    with pytest.raises(NotFound):
        db.get("first")
    db.set("second", b"old clock", ts=5)
    assert db.get("second")[1] == b"old clock" and db.get("second", layered=False)[1] == b""
    db.flush(force=True)
    db.set("third", b"3")
    db.flush(force=True)
    assert len(db.manifest.runs) == 3 and db.compact(force=True) and len(db.manifest.runs) == 1
    assert db.runs().count() == 5 and db.manifest.version == 4
    assert len(db.clean(age_s=0)) >= 3
    db = Engine(spark, base)
    assert db.manifest.version == 4 and db.seq == 5 and db.get("third")[1] == b"3"
    got = {r.key: r.status for r in db.multi_get(spark.createDataFrame([("third",), ("first",), ("",)], "key string")).collect()}
    assert got == {"third": "OK", "first": "NotFound", "": "InvalidArgument"}
    assert {r.key for r in db.view().collect()} >= {"third"}
    assert db.set("fourth", b"4") and Engine(spark, base).get("fourth")[1] == b"4"


def test_verify(spark, tmp_path):
    base = str(tmp_path / "db")
    db = Engine(spark, base)
    assert db.verify().count() == 0
    for i in range(3):
        db.set(f"k{i}", b"x" * 500)
    assert [tuple(r) for r in db.verify().orderBy("start_seq").collect()] == [(1, 1, 1), (2, 1, 2), (3, 1, 3)]
    part = next((tmp_path / "db" / "log" / "wal-2.log").glob("part-*.parquet"))
    whole = part.read_bytes()
    (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    at = whole.index(b"k1")  # a key's byte on its page
    part.write_bytes(whole[:at] + b"z" + whole[at + 1 :])
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        db.log().collect()
    part.write_bytes(whole)
    os.rename(tmp_path / "db" / "log" / "wal-2.log", tmp_path / "wal-2.log")
    with pytest.raises(Exception, match="the log is broken at 1"):
        Engine(spark, base).verify().collect()


def test_snapshots_and_layers(spark, tmp_path):
    db = Engine(spark, str(tmp_path / "db"))
    for i in range(2):
        db.set("k", bytes([i]), ts=100 - i)
        db.flush(force=True)
    assert db.runs(version=1).count() == 1 and db.runs().count() == 2
    with pytest.raises(FileNotFoundError):
        db.runs(version=7)
    db.set("k", b"new", ts=5)
    probes = spark.createDataFrame([("k",)], "key string")
    assert bytes(db.multi_get(probes).first().value) == db.get("k")[1] == b"new"
    assert {r.records for r in db.blocks().collect()} == {1} and db.blocks().count() == 2
    assert [(r.place, r.applied_until) for r in db.manifest.rows(spark).collect()] == [(0, 1), (1, 2)]


def test_command_line(spark, tmp_path, capsys):
    base = ["--base_dir", str(tmp_path / "db")]
    assert main([*base, "set", "abc", "é1"], spark) == 0
    assert main([*base, "get", "abc"], spark) == 0 and capsys.readouterr().out.strip().endswith("é1")
    assert main([*base, "get", "no"], spark) == 1 and "NotFound" in capsys.readouterr().err
    assert main([*base, "set", "", "v"], spark) == 1 and "InvalidArgument" in capsys.readouterr().err
    assert main([*base, "delete", "abc"], spark) == 0 and main([*base, "get", "abc"], spark) == 1
    assert main([*base, "loaddata", "--n", "50", "--value_size", "20"], spark) == 0
    assert main([*base, "flush"], spark) == 0 and main([*base, "compact"], spark) == 0
    capsys.readouterr()
    assert main([*base, "printdescriptor"], spark) == 0 and "applied_until" in capsys.readouterr().out
    assert main([*base, "bench", "--requests", "8"], spark) == 0 and "p99" in capsys.readouterr().out


def test_stream_batch_is_applied_once(spark, tmp_path):
    """The driver dies after the segment is committed and before the batch's number is kept."""
    rows = spark.createDataFrame([("a", "PUT", 1, bytearray(b"1")), ("b", "PUT", 2, bytearray(b"2"))], "key string, type string, ts long, value binary")
    rows.write.parquet(str(tmp_path / "in"))
    db = Engine(spark, str(tmp_path / "db"))
    commit = db.files.commit

    def dies(path, text):
        if "/applied/" in path:
            raise RuntimeError("lost")
        commit(path, text)

    db.files.commit = dies
    start = lambda e: upsert.upsert(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), e, str(tmp_path / "ck"))
    with pytest.raises(Exception, match="lost"):
        start(db).awaitTermination()
    db = Engine(spark, str(tmp_path / "db"))
    assert db.log().count() == 2
    start(db).awaitTermination()
    assert db.log().count() == 2 and db.seq == 2 and db.verify().count() == 1
    more = rows.withColumn("ts", F.col("ts") + 10)
    more.write.mode("append").parquet(str(tmp_path / "in"))
    start(db).awaitTermination()
    assert db.log().count() == 4 and {r.ts for r in db.view().collect()} == {11, 12}


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    m = tables.mutations(events).select("key", "type", "ts", F.col("value").cast("binary").alias("value"))
    m.repartition(3).write.parquet(str(tmp_path / "in"))
    db = Engine(spark, Options(str(tmp_path / "db"), flush_bytes=1))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    upsert.upsert(stream, db, str(tmp_path / "ck")).awaitTermination(120)
    v = db.versions()
    want = {(r.key, r.ts) for r in read.live_view(tables.mutations(events)).collect()}
    assert {(r.key, r.ts) for r in read.live_view(v).collect()} == want
    assert v.count() == events.count()
    with_seq = tables.mutations(events).select("key", "ts", "seq", "value")
    with_seq.write.parquet(str(tmp_path / "in2"))
    q = upsert.newest(spark.readStream.schema(with_seq.schema).parquet(str(tmp_path / "in2"))).writeStream.outputMode("complete").format("memory").queryName("newest").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.key, r.ts) for r in spark.table("newest").where("value is not null").collect()} == want
