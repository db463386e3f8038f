"""One query per operator over the test tables, and the SQL that DuckDB answers alike."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import INVALID, applied, key_status, value_status
from ..operators import log, manifest, read, runs, workload
from ..operators.manifest import Manifest
from ..schema import DELETE, Options
from ..sources.shared import new_folder
from ..sources.tables import mutations
from .engine import Engine

MUT = """with mut as (select event_id + 1 as seq, cast(user_id as varchar) as key, epoch_us(ts) as ts,
    case when event_type = 'error' then 'DELETE' else 'PUT' end as type, case when event_type = 'error' then null else props end as value,
    cast(case when event_id % 10 = 9 then 0 when event_id % 10 = 8 then 1 else 2 end as int) as layer, event_id % 8 as run from events)"""
T = 1_705_000_000_000_000

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mutations(table(spark, sf_dir, "events"))


def stored(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """rows as a run: range-partitioned and sorted, with Bloom filters."""
    path = new_folder(spark, "run")
    runs.write_run(rows, path, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return spark.read.schema(rows.schema).parquet(path)


RANK = "row_number() over (partition by key order by ts desc, seq desc) as rn"


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut) where rn = 1 and value is not null")
def live_view(spark, sf):
    return read.live_view(mut(spark, sf)).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut) where rn = 1")
def latest_version(spark, sf):
    return read.latest_version(mut(spark, sf)).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from (select *, row_number() over (partition by key order by layer, ts desc, case when layer >= 2 then run end, seq desc) as rn from mut) where rn = 1 and value is not null")
def layered_get(spark, sf):
    return read.live(read.layered(mut(spark, sf))).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut where ts <= {T}) where rn = 1")
def as_of_get(spark, sf):
    return read.as_of(mut(spark, sf), T).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut where key = '42') where rn = 1 and value is not null")
def point_get(spark, sf):
    """Against a written run, whose scan gets the key as a filter."""
    return read.point_get(stored(spark, mut(spark, sf)), "42").select("key", "ts", "value")


@query(f"""{MUT}, probes as (select distinct cast(c_custkey % 400 as varchar) as key from customer union all select ''),
    latest as (select key, ts, value from (select *, {RANK} from mut) where rn = 1 and value is not null)
    select p.key, l.ts, l.value, case when strlen(p.key) = 0 or strlen(p.key) > 4096 then 'InvalidArgument' when l.value is null then 'NotFound' else 'OK' end as status
    from probes p left join latest l using (key)""")
def multi_get(spark, sf):
    probes = table(spark, sf, "customer").select((F.col("c_custkey") % 400).cast("string").alias("key")).distinct()
    return read.multi_get(mut(spark, sf), probes.union(spark.range(1).select(F.lit("").alias("key"))))


@query(f"""{MUT}, probes as (select distinct cast(c_custkey as varchar) as key from customer union all select ''),
    latest as (select key, ts, value from (select *, {RANK} from mut) where rn = 1 and value is not null)
    select p.key, l.ts, l.value, case when strlen(p.key) = 0 or strlen(p.key) > 4096 then 'InvalidArgument' when l.value is null then 'NotFound' else 'OK' end as status
    from probes p left join latest l using (key)""")
def multi_get_all(spark, sf):
    """Probed with every customer's key."""
    probes = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    return read.multi_get(mut(spark, sf), probes.union(spark.range(1).select(F.lit("").alias("key"))))


@query(f"{MUT} select key, ts, value from mut where key > '12' or (key = '12' and ts <= {T}) order by key, ts desc limit 1")
def seek_ge(spark, sf):
    return read.seek_ge(mut(spark, sf), "12", T).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value, layer from mut where layer = 0")
def memtable_scan(spark, sf):
    return read.scan(mut(spark, sf).where("layer = 0")).select("key", "ts", "value", "layer")


@query(f"{MUT} select key, ts, value from mut where run = 3")
def run_scan(spark, sf):
    return read.scan(mut(spark, sf).where("run = 3")).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut where run = 3 and key = '7') where rn = 1")
def run_get(spark, sf):
    """Against run 3 as written."""
    return read.latest_version(stored(spark, mut(spark, sf).where("run = 3")).where("key = '7'")).select("key", "ts", "value")


@query(f"""{MUT}, keys as (select distinct key, row_number() over (order by key) as n from (select distinct key from mut)),
    blocks as (select key as last_key from keys where n % 16 = 0), probes as (select distinct key || 'a' as key from mut)
    select p.key, min(b.last_key) as last_key from probes p left join blocks b on p.key <= b.last_key group by 1""")
def sparse_index_find(spark, sf):
    keys = mut(spark, sf).select("key").distinct()
    numbered = log.append(0, keys, ["key"])
    return read.sparse_index_find(keys.select(F.concat("key", F.lit("a")).alias("key")), numbered.where("seq % 16 = 0").select(F.col("key").alias("last_key")))


@query(f"{MUT} select key, ts, value from mut where run in (1, 2) union all select key, ts, value from mut where run = 2")
def kway_merge(spark, sf):
    m = mut(spark, sf)
    return runs.kway_merge([m.where("run = 1"), m.where("run = 2"), m.where("run = 2")]).select("key", "ts", "value")


@query(f"{MUT} select key, ts, value from mut union all select key, ts, value from mut where run = 2")
def kway_merge_all(spark, sf):
    """All eight runs, and one of them again: a merge keeps what repeats."""
    m = mut(spark, sf)
    return runs.kway_merge([m.where(F.col("run") == r) for r in (*range(8), 2)]).select("key", "ts", "value")


@query(f"{MUT} select key, ts, seq, value from mut")
def compact(spark, sf):
    m = mut(spark, sf)
    return runs.compact([m.where(F.col("run") == r) for r in range(8)], 4).select("key", "ts", "seq", "value")


@query(f"{MUT} select key, ts, seq, value from (select *, {RANK} from mut) where rn = 1 and value is not null")
def compact_with_gc(spark, sf):
    m = mut(spark, sf)
    return runs.compact([m.where(F.col("run") == r) for r in range(8)], 4, drop_old=True).select("key", "ts", "seq", "value")


@query(f"{MUT} select run, max(seq) as applied_until, count(*) as records, min(key) as first_key, max(key) as last_key from mut group by run")
def run_stats(spark, sf):
    return runs.run_stats(mut(spark, sf))


@query(f"{MUT} select count(distinct run) as runs, count(distinct run) > 8 as due from mut")
def compaction_trigger(spark, sf):
    return runs.run_stats(mut(spark, sf)).agg(F.count("*").alias("runs")).withColumn("due", F.col("runs") > 8)


@query(f"""{MUT}, r as (select run, max(seq) as applied_until from mut group by run)
    select run, applied_until from r where run not in (0, 2, 4) union all select 99, max(applied_until) from r where run in (0, 2, 4)""")
def manifest_rewrite(spark, sf):
    r = runs.run_stats(mut(spark, sf))
    return manifest.rewrite(r.select("run", "applied_until"), spark.createDataFrame([(0,), (2,), (4,)], "run long"), 99)


@query(f"{MUT} select coalesce(max(seq), 0) as applied_until from mut")
def max_applied(spark, sf):
    return manifest.max_applied(runs.run_stats(mut(spark, sf)))


@query("select distinct cast(user_id as varchar) as filename from events where cast(user_id as varchar) not in (select cast(user_id as varchar) from events where event_id % 97 = 0)")
def orphan_runs(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("filename"))
    return manifest.orphans(e, e.where("event_id % 97 = 0"))


@query("select arg_max('descriptor.' || user_id, user_id) as name, max(user_id) as version from events")
def latest_manifest(spark, sf):
    return manifest.latest_manifest(table(spark, sf, "events").select(F.concat(F.lit("descriptor."), "user_id").alias("name")))


SEGMENTS = "select distinct case when event_id % 3 = 0 then 'wal-' || (event_id // 100) || '.log' else 'other-' || event_id end as name from events"


@query(f"with n as ({SEGMENTS}) select name, cast(regexp_extract(name, '^wal-([0-9]+)\\.log$', 1) as bigint) as start_seq from n where name like 'wal-%'")
def log_list(spark, sf):
    e = table(spark, sf, "events")
    name = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("wal-"), F.floor(F.col("event_id") / 100), F.lit(".log"))).otherwise(F.concat(F.lit("other-"), "event_id"))
    return log.list_segments(e.select(name.alias("name")).distinct())


@query("""with s as (select distinct (event_id // 1000) * 1000 + 1 as start_seq from events),
    n as (select start_seq, lead(start_seq) over (order by start_seq) as next_seq from s) select * from n where next_seq < 5500""")
def log_truncate(spark, sf):
    s = table(spark, sf, "events").select((F.floor(F.col("event_id") / 1000) * 1000 + 1).alias("start_seq")).distinct()
    return log.truncatable(s, 5500)


JUMPY = "select * replace (seq - case when seq % 10 = 0 then 3 else 0 end as seq), seq as pos from mut"


def jumpy(spark, sf):
    m = mut(spark, sf).withColumn("pos", F.col("seq"))
    return m.withColumn("seq", F.col("seq") - F.when(F.col("seq") % 10 == 0, 3).otherwise(0))


@query(f"""{MUT}, j as ({JUMPY}), p as (select *, max(seq) over (order by pos rows between unbounded preceding and 1 preceding) as prev from j)
    select seq, key, ts, value from p where seq > greatest(coalesce(prev, 100), 100)""")
def log_replay(spark, sf):
    return log.replay(jumpy(spark, sf), 100, block=1000).select("seq", "key", "ts", "value")


@query(f"""{MUT}, j as ({JUMPY}), p as (select *, max(seq) over (order by pos rows between unbounded preceding and 1 preceding) as prev from j)
    select pos, seq, prev from p where seq < prev""")
def seq_guard(spark, sf):
    return log.seq_violations(jumpy(spark, sf), block=1000).select("pos", "seq", "prev")


@query(f"{MUT} select key, ts, row_number() over (order by ts, key) + 500 as seq from mut")
def log_append(spark, sf):
    return log.append(500, mut(spark, sf).select("key", "ts"), ["ts", "key"])


@query(f"""{MUT.replace("with mut", "with recursive mut", 1)}, s as (select run, seq, strlen(key) + coalesce(strlen(value), 0) + 8 as size, row_number() over (partition by run order by seq) as n from mut),
    f as (select run, n, seq, size, size as held, seq as segment from s where n = 1 union all
        select s.run, s.n, s.seq, s.size, case when f.held > 2000 then s.size else f.held + s.size end, case when f.held > 2000 then s.seq else f.segment end from f join s on s.run = f.run and s.n = f.n + 1)
    select run, seq, size, segment from f""")
def log_rollover(spark, sf):
    return log.rollover(mut(spark, sf), 2000, "run")


@query(f"{MUT} select max(seq) as seq from mut")
def sequence_upper(spark, sf):
    return mut(spark, sf).agg(F.max("seq").alias("seq"))


@query(f"{MUT} select run, cast(sum(strlen(key) + coalesce(strlen(value), 0) + 8) as bigint) as bytes, count(*) as records from mut group by run")
def size_estimate(spark, sf):
    return log.size_estimate(mut(spark, sf), "run")


@query(f"{MUT} select seq, key, case when type = 'PUT' then value end as value from mut")
def apply_mutation(spark, sf):
    return mut(spark, sf).select("seq", "key", applied(F.col("type"), F.col("value")).alias("value"))


@query("select doc_id, case when text is null or strlen(text) = 0 or strlen(text) > 4096 then 'InvalidArgument' else 'OK' end as status from documents")
def validate_key(spark, sf):
    return table(spark, sf, "documents").select("doc_id", key_status(F.col("text")).alias("status"))


@query("select page_id, case when strlen(html) > 524288 then 'InvalidArgument' else 'OK' end as status from pages")
def validate_value(spark, sf):
    return table(spark, sf, "pages").select("page_id", value_status(F.col("html")).alias("status"))


@query(f"""{MUT}, k as (select run, key, row_number() over w as n, lag(key) over w as prev from (select distinct run, key from mut) window w as (partition by run order by key)),
    s as (select run, key, n, case when (n - 1) % 16 = 0 then 0 else len(list_filter(range(1, least(length(prev), length(key)) + 1), lambda i: prev[1:i] = key[1:i])) end as shared from k)
    select run, key, n, cast(shared as bigint) as shared, substr(key, shared + 1) as suffix from s""")
def prefix_encode(spark, sf):
    return runs.prefix_encode(mut(spark, sf))


@query(f"{MUT} select distinct run, key from mut")
def prefix_decode(spark, sf):
    return runs.prefix_decode(runs.prefix_encode(mut(spark, sf)))


def samples(spark, sf):
    return table(spark, sf, "events").select(F.round(F.col("value") * 100).cast("long").alias("latency_us"), (F.col("event_type") == "error").alias("error"))


@query("select count(*) as requests, cast(count(*) as double) / 30 as per_second, cast(count(*) filter (event_type = 'error') as bigint) as errors from events")
def bench_count(spark, sf):
    return workload.count_and_rate(samples(spark, sf), 30)


SAMPLES = "with s as (select cast(round(value * 100) as bigint) as latency_us from events)"


@query(f"{SAMPLES} select quantile_disc(latency_us, 0.5) as p50, quantile_disc(latency_us, 0.95) as p95, quantile_disc(latency_us, 0.99) as p99 from s")
def bench_quantiles(spark, sf):
    return workload.quantiles(samples(spark, sf))


@query(f"""{SAMPLES}, c as (select unnest(case when latency_us >= 2000 then list_concat([latency_us], range(latency_us - 1000, 999, -1000)) else [latency_us] end) as latency_us from s)
    select latency_us, count(*) as n from c group by 1""")
def co_correction(spark, sf):
    return workload.corrected(samples(spark, sf), 1000).groupBy("latency_us").agg(F.count("*").alias("n"))


@query(f"{MUT} select avg(cast(key in (select key from mut where layer = 0) as double)) as rate from mut where run = 1")
def false_positive_rate(spark, sf):
    m = mut(spark, sf)
    there = m.where("layer = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return workload.false_positive_rate(m.where("run = 1").join(there, "key", "left").select(F.coalesce("hit", F.lit(False)).alias("hit")))


@query(f"{MUT} select avg(cast(key in (select key from mut where layer = 0) as double)) as rate from mut where layer <> 0")
def false_positive_rate_all(spark, sf):
    """Probed with every row outside the layer that answers."""
    m = mut(spark, sf)
    there = m.where("layer = 0").select("key").distinct().withColumn("hit", F.lit(True))
    return workload.false_positive_rate(m.where("layer <> 0").join(there, "key", "left").select(F.coalesce("hit", F.lit(False)).alias("hit")))


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut) where rn = 1 and value is not null and key >= '1' and key < '2'")
def key_range(spark, sf):
    return read.key_range(mut(spark, sf), "1", "2").select("key", "ts", "value")


# --- the store itself, in a folder of its own ------------------------------------------------


def store(spark: SparkSession, sf_dir: str) -> Engine:
    """Even events are written and flushed, odd ones stay in the log, however large they are."""
    db, m = Engine(spark, Options(new_folder(spark, "store"), flush_bytes=1 << 62)), mut(spark, sf_dir)
    db.write(m.where("seq % 2 = 1").select("key", "type", "ts", "value"))
    db.flush(force=True)
    db.write(m.where("seq % 2 = 0").select("key", "type", "ts", "value"))
    return db


STORED = f"""{MUT}, stored as (select key, type, ts, value, seq % 2 = 0 as logged, row_number() over (order by seq % 2 = 0, ts, key) as seq from mut),
    picked as (select *, row_number() over (partition by key order by logged desc, ts desc, seq desc) as rn from stored)"""


@query(f"{STORED} select key, ts, value from picked where rn = 1 and value is not null")
def store_view(spark, sf):
    return store(spark, sf).view().select("key", "ts", F.col("value").cast("string").alias("value"))


@query(f"{STORED} select seq, key, type, ts, value from stored")
def upsert(spark, sf):
    """The log after two batches: what log_scan reads."""
    return store(spark, sf).log().select("seq", "key", "type", "ts", F.col("value").cast("string").alias("value"))


@query(f"""{STORED}, gone as (select distinct key from stored where cast(key as bigint) % 7 = 0)
    select key, ts, value from picked where rn = 1 and value is not null and key not in (select key from gone)""")
def delete(spark, sf):
    db = store(spark, sf)
    gone = mut(spark, sf).select("key").distinct().where("cast(key as bigint) % 7 = 0")
    db.write(gone.select("key", F.lit(DELETE).alias("type"), F.lit(2 * T).alias("ts"), F.lit(None).cast("binary").alias("value")))
    return db.view().select("key", "ts", F.col("value").cast("string").alias("value"))


@query(f"{STORED} select key, ts, seq, value from stored where not logged")
def flush(spark, sf):
    return store(spark, sf).runs().select("key", "ts", "seq", F.col("value").cast("string").alias("value"))


@query(f"{STORED} select key, ts, seq, value from stored where not logged")
def snapshot_read(spark, sf):
    """The first version of the manifest, after a second was committed."""
    db = store(spark, sf)
    db.flush(force=True)
    return db.runs(version=1).select("key", "ts", "seq", F.col("value").cast("string").alias("value"))


@query(f"{STORED} select row_number() over (order by logged) as place, max(seq) as applied_until from stored group by logged")
def print_manifest(spark, sf):
    """The manifest as loaded from its file, after two flushes."""
    db = store(spark, sf)
    db.flush(force=True)
    loaded = Manifest.load(db.files, db.options.manifests)
    return loaded.rows(spark).select((F.col("place") + 1).cast("long").alias("place"), "applied_until")


@query(f"{STORED} select min(seq) as start_seq, count(*) as records, max(seq) as last_seq from stored group by logged")
def log_verify(spark, sf):
    return store(spark, sf).verify()


@query(f"{STORED} select count(*) as records, min(key) as first_key, max(key) as last_key from stored where not logged")
def list_blocks(spark, sf):
    return store(spark, sf).blocks().agg(F.sum("records").alias("records"), F.min("first_key").alias("first_key"), F.max("last_key").alias("last_key"))


@query(f"""{STORED}, probes as (select distinct cast(c_custkey % 400 as varchar) as key from customer)
    select p.key, l.ts, l.value, case when l.value is null then 'NotFound' else 'OK' end as status
    from probes p left join (select * from picked where rn = 1 and value is not null) l using (key)""")
def store_multi_get(spark, sf):
    probes = table(spark, sf, "customer").select((F.col("c_custkey") % 400).cast("string").alias("key")).distinct()
    return store(spark, sf).multi_get(probes).select("key", "ts", F.col("value").cast("string").alias("value"), "status")


@query(f"""{STORED}, probes as (select distinct cast(c_custkey as varchar) as key from customer)
    select p.key, l.ts, l.value, case when l.value is null then 'NotFound' else 'OK' end as status
    from probes p left join (select * from picked where rn = 1 and value is not null) l using (key)""")
def store_multi_get_all(spark, sf):
    """Probed with every customer's key."""
    probes = table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("key")).distinct()
    return store(spark, sf).multi_get(probes).select("key", "ts", F.col("value").cast("string").alias("value"), "status")


@query(f"{MUT} select key, ts, value from (select *, {RANK} from mut) where rn = 1 and value is not null")
def stream_upsert(spark, sf):
    """The events as a stream into the store."""
    from ..streaming import upsert as streams

    events = table(spark, sf, "events")
    stream = mutations(spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf))
    folder = new_folder(spark, "stream")
    db = Engine(spark, f"{folder}/db")
    streams.upsert(stream, db, f"{folder}/checkpoint").awaitTermination()
    return db.view().select("key", "ts", F.col("value").cast("string").alias("value"))


@query("select 1000::bigint as records, 1000::bigint as keys, 10 as key_size, 800 as value_size")
def loaddata(spark, sf):
    db = Engine(spark, new_folder(spark, "load"))
    db.load_data(1000)
    size = lambda c: F.max(F.octet_length(c))
    return db.view().agg(F.count("*").alias("records"), F.count_distinct("key").alias("keys"), size("key").alias("key_size"), size("value").alias("value_size"))


@query("select i % 5 as worker, count(*) as requests, 500000 * (count(*) - 1) as span_us from range(3000) t(i) group by 1")
def paced_requests(spark, sf):
    asked = workload.paced_requests(mut(spark, sf), 3000, 10.0, 5)
    return asked.groupBy("worker").agg(F.count("*").alias("requests"), (F.max("at_us") - F.min("at_us")).alias("span_us"))


__all__ = ["INVALID", "ORACLES", "QUERIES"]
