"""Streams: tumbling, sliding and session windows, deduplication, ledgers and leases."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.ordered import running_sum
from ..sources.shared import shared_path
from ..streaming.jobs import event_stream, follow_leases, in_parts, reject_late, run, run_parts
from ..streaming.journal import Journal
from ..streaming.ledger import STORE, admit
from .registry import CELL_TICKS, query

PARTS = 3  # of a table, fed to a stream one after another
CELL_ROWS = 1000  # event ids that one cell of a key spans


def _events(t):
    return event_stream(t.spark, f"{t.folder}/events.parquet")


@query("select epoch_us(time_bucket(interval '1 day', ts))::bigint s, event_type k, count(*) n, sum(floor(value))::bigint total from events group by 1, 2")
def stream_tumbling(t):
    x = _events(t).groupBy(F.window("ts", "1 day"), F.col("event_type").alias("k")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))
    return run(x.select(F.unix_micros("window.start").alias("s"), "k", "n", "total"), ["s", "k"], "tumbling")


@query("with x as (select unnest([epoch_us(time_bucket(interval '12 hours', ts)), epoch_us(time_bucket(interval '12 hours', ts)) - 43200000000])::bigint s, value from events) select s, count(*) n from x group by 1")
def stream_sliding(t):
    x = _events(t).groupBy(F.window("ts", "1 day", "12 hours")).agg(F.count("*").alias("n"))
    return run(x.select(F.unix_micros("window.start").alias("s"), "n"), ["s"], "sliding")


@query("with c0 as (select user_id u, epoch_us(ts)::bigint s, event_id, case when epoch_us(ts) - lag(epoch_us(ts)) over (partition by user_id order by ts, event_id) < 21600000000 then 0 else 1 end c from events), g as (select *, sum(c) over (partition by u order by s, event_id rows unbounded preceding) g from c0) select u, min(s) s, count(*) n from g group by u, g.g")
def stream_session(t):
    x = _events(t).groupBy(F.col("user_id").alias("u"), F.session_window("ts", "6 hours").alias("w")).agg(F.count("*").alias("n"))
    return run(x.select("u", F.unix_micros("w.start").alias("s"), "n"), ["u", "s"], "session", "complete")


@query("select distinct user_id u, event_type k from events")
def stream_dedup(t):
    """First of each key. Its state holds every key for good: right for a bounded set of keys such as this one."""
    x = _events(t).select(F.col("user_id").alias("u"), F.col("event_type").alias("k")).dropDuplicates(["u", "k"])
    return run(x, ["u", "k"], "dedup", "append")


@query("select event_id, user_id u, epoch_us(ts)::bigint s, epoch_us(ts) > coalesce(max(epoch_us(ts)) over (partition by user_id order by event_id rows between unbounded preceding and 1 preceding), -1) accepted from events")
def stream_reject_late(t):
    """A point that does not lie after all earlier ones of its user is rejected, not buffered."""
    x = t.events.select("event_id", F.col("user_id").alias("u"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"))
    return reject_late(in_parts(x, "event_id", PARTS), "u", "s", "event_id", CELL_ROWS)


@query("with j as (select event_id, user_id || ':' || event_type as job, floor(value)::bigint charge, row_number() over (partition by user_id, event_type order by ts, event_id) r from events) select event_id, job, case when r = 1 then 'ACCEPTED' else 'DUPLICATE_JOB' end state, case when r = 1 then charge else 0 end charged from j")
def ledger_admission(t):
    """A ledger takes the first record of each job name; a repeated name is rejected and charges nothing."""
    x = t.events.select("event_id", "ts", F.concat_ws(":", "user_id", "event_type").alias("job"), F.floor("value").alias("charge"))
    first = x.groupBy("job").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("first"))
    x = x.join(first, "job").withColumn("ok", F.col("event_id") == F.col("first"))
    return x.select("event_id", "job", F.when(F.col("ok"), "ACCEPTED").otherwise("DUPLICATE_JOB").alias("state"), F.when(F.col("ok"), F.col("charge")).otherwise(0).alias("charged"))


@query("select event_id, user_id, event_type from events")
def stream_ledger(t):
    """An append-only journal of batches, into which every batch comes twice and counts once."""
    x = _events(t).select("event_id", "user_id", "event_type")
    base = shared_path(t.spark, "ledger")
    journal = Journal(t.spark, f"{base}/journal")

    def twice(batch, number):
        journal.append(batch, number)
        journal.append(batch, number)

    x.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").foreachBatch(twice).start().awaitTermination()
    return journal.read(x.schema)


@query("with r as (select user_id u, event_id, sum(floor(value)) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint spent from events) select u, event_id, spent, 7200 + spent <= 10000 admitted from r")
def budget_running_sum(t):
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    x = t.events.select(F.col("user_id").alias("u"), "event_id", at.alias("s"), "value")
    x = running_sum(x, ["u"], ["s", "event_id"], F.floor("value"), CELL_TICKS, "spent")
    return x.select("u", "event_id", "spent", (7200 + F.col("spent") <= 10_000).alias("admitted"))


@query("with r as (select distinct l_orderkey lease, l_linenumber consumer from lineitem), a as (select l_orderkey lease, l_linenumber consumer, count(*) n from lineitem where l_returnflag <> 'N' group by 1, 2) select lease, count(*) registered, count(n) accepted, bool_and(n is not null) released, coalesce(bool_or(n > 1), false) repeated from r left join a using (lease, consumer) group by lease")
def lease_closure(t):
    """A lease is released once every registered consumer has accepted; accepting twice is reported."""
    key = [F.col("l_orderkey").alias("lease"), F.col("l_linenumber").alias("consumer")]
    x = t.lineitem.groupBy(*key).agg(F.count_if(F.col("l_returnflag") != "N").alias("n"))
    return x.groupBy("lease").agg(F.count("*").alias("registered"), F.count_if(F.col("n") > 0).alias("accepted"), F.bool_and(F.col("n") > 0).alias("released"), F.bool_or(F.col("n") > 1).alias("repeated"))


@query("""with recursive j as (select user_id u, event_id id, epoch_us(ts)::bigint s, event_type || ':' || event_id % 7 as job, floor(value)::bigint charge from events),
p as (select ceil((max(event_id) - min(event_id) + 1) / 3.0)::bigint step, min(event_id) low from events),
o as (select j.*, row_number() over (partition by u order by (id - low) // step, s, id) r from j, p),
w as (select u, 0::bigint id, ''::varchar job, 0::bigint r, ''::varchar state, 0::bigint prior, 0::bigint charged, []::varchar[] held from (select distinct u from o) union all
  select o.u, o.id, o.job, o.r, case when list_contains(w.held, o.job) then 'DUPLICATE_JOB' when 7200 + w.prior + w.charged + o.charge + 10 + 120 > 8000 then 'OVER_BUDGET' else 'ACCEPTED' end, w.prior + w.charged,
    case when list_contains(w.held, o.job) or 7200 + w.prior + w.charged + o.charge + 10 + 120 > 8000 then 0 else o.charge end, case when list_contains(w.held, o.job) or 7200 + w.prior + w.charged + o.charge + 10 + 120 > 8000 then w.held else list_append(w.held, o.job) end
  from w join o on o.u = w.u and o.r = w.r + 1)
select u::varchar ledger, id, job, state, prior, charged from w where r > 0""")
def stream_admission(t):
    """A ledger under a budget as state of a stream, fed in parts: a name is taken once, and a job whose reserve passes the
    budget is turned away without a trace."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    job = F.concat_ws(":", "event_type", F.col("event_id") % 7)
    x = t.events.select(F.col("user_id").cast("string").alias("ledger"), F.col("event_id").alias("id"), job.alias("job"), (F.floor("value") + 10).alias("reserve"), F.floor("value").alias("charge"), at.alias("at"))
    return run_parts(in_parts(x, "id", PARTS), lambda s: admit(s, limit=8000), ["id"], "admission", "append", STORE)


@query("with r as (select distinct l_orderkey lease, l_linenumber consumer from lineitem), a as (select l_orderkey lease, l_linenumber consumer, count(*) n from lineitem where l_returnflag <> 'N' group by 1, 2) select lease, count(*) registered, count(n) accepted, bool_and(n is not null) released, coalesce(sum(n - 1), 0)::bigint repeated from r left join a using (lease, consumer) group by lease")
def stream_leases(t):
    """Leases as state of a stream: some consumers accept before their lease is registered, the others after; a lease is
    released with its last consumer."""
    lease = F.col("l_orderkey").alias("lease")
    named = t.lineitem.groupBy(lease).agg(F.transform(F.collect_set("l_linenumber"), lambda c: c.cast("string")).alias("consumers")).withColumn("consumer", F.lit(None).cast("string"))
    said = t.lineitem.where("l_returnflag <> 'N'").select(lease, F.lit(None).cast("array<string>").alias("consumers"), F.col("l_linenumber").cast("string").alias("consumer"))
    parts = [said.where("consumer = '2'"), named, said.where("consumer <> '2'")]
    return follow_leases(parts).select("lease", "registered", "accepted", "released", "repeated")
