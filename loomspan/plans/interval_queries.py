"""Interval algebra over event intervals, per user; click is the prediction, purchase the reference."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators import intervals as iv
from ..operators.builders import equal_split, hopping, planned_windows
from ..operators.evaluate import hash_index, salted
from ..operators.joins import overlapping, points_in_intervals
from ..operators.matching import match_one_to_one
from ..operators.ordered import following, ordinals, positions, previous
from ..operators.sampling import percentiles
from ..operators.scan import scan
from .registry import CELL_TICKS, CLOCK, EV, SIDES, Tables, islands, query

SECOND, MINUTE, DAY = 1_000_000, 60_000_000, 86_400_000_000
PRED = islands("(select * from sd where k = 'click')", "u")
TRUE = islands("(select * from sd where k = 'purchase')", "u")
DUR = f"""{SIDES}, a as ({PRED}), b as ({TRUE}),
o as (select a.u, sum(least(a.e, b.e) - greatest(a.s, b.s)) tp from a join b on a.u = b.u and a.s < b.e and b.s < a.e group by 1),
du as (select u, coalesce(any_value(pd), 0)::bigint pd, coalesce(any_value(td), 0)::bigint td, coalesce(any_value(o.tp), 0)::bigint tp
  from (select distinct u from sd) left join (select u, sum(e - s) pd from a group by 1) using (u) left join (select u, sum(e - s) td from b group by 1) using (u) left join o using (u) group by u)"""


def _valid(t: Tables):
    return t.intervals().where("e > s")


def _durations(t: Tables):
    return iv.durations(t.sides(), ["u"], "k", "click", "purchase", width=CELL_TICKS)


@query(f"with {EV} {islands('(select * from ev where e > s)', 'u')}")
def interval_merge_touching(t):
    return iv.merge(_valid(t), ["u"], width=CELL_TICKS)


@query(f"with {EV} {islands('(select * from ev where e > s)', 'u', 's < p_')}")
def interval_merge_strict(t):
    return iv.merge(_valid(t), ["u"], strict=True, width=CELL_TICKS)


@query(f"with {EV} {islands('(select * from ev where e > s)', 'u', 's <= p_ + 1000')}")
def interval_merge_eps(t):
    return iv.merge(_valid(t), ["u"], gap=1000, width=CELL_TICKS)


@query(f"with {EV}, m as ({islands('(select * from ev where e > s)', 'u')}) {islands('m', 'u', 's <= p_ + 600000000')}")
def interval_gap_bridge(t):
    return iv.merge(iv.merge(_valid(t), ["u"], width=CELL_TICKS), ["u"], gap=600 * SECOND, width=CELL_TICKS)


@query(f"with {EV} select u, sum(e - s)::bigint ticks, count(*) n from ({islands('(select * from ev where e > s)', 'u')}) group by u")
def interval_measure(t):
    return iv.merge(_valid(t), ["u"], width=CELL_TICKS).groupBy("u").agg(F.sum(F.col("e") - F.col("s")).alias("ticks"), F.count("*").alias("n"))


@query(f"with {DUR} select u, tp from du")
def interval_overlap(t):
    return _durations(t).select("u", "tp")


@query(f"with {DUR} select u, tp from du where tp > 0")
def interval_overlap_pairs(t):
    """The same length from the pairs of merged intervals that meet, each in the bucket of its later start."""
    x = t.sides()
    a, b = (iv.merge(x.where(F.col("k") == k), ["u"], width=CELL_TICKS) for k in ("click", "purchase"))
    met = overlapping(a, b.select("u", F.col("s").alias("s2"), F.col("e").alias("e2")), ["u"], 6 * 3600 * SECOND)
    return met.groupBy("u").agg(F.sum(F.least("e", "e2") - F.greatest("s", "s2")).alias("tp"))


@query(f"with {SIDES}, p as (select u, k, s >= lag(e) over (partition by u, k order by s, e, id) as apart, s, e from sd) select u, k, count(*) n, coalesce(bool_and(apart), true) disjoint from p group by 1, 2")
def sorted_disjoint(t):
    """Whether the intervals of a user and type, in order of their starts, keep apart."""
    x = previous(t.sides(), ["u", "k"], ["s", "e", "id"], ["e"], CELL_TICKS)
    return x.groupBy("u", "k").agg(F.count("*").alias("n"), F.coalesce(F.bool_and(F.col("s") >= F.col("prev_e")), F.lit(True)).alias("disjoint"))


@query(f"with {DUR} select a.u, greatest(a.s, b.s) s, least(a.e, b.e) e from a join b on a.u = b.u and a.s < b.e and b.s < a.e")
def interval_intersect(t):
    return iv.intersect(t.sides(), ["u"], "k", "click", "purchase", width=CELL_TICKS)


@query(f"""with {EV}, x as (select u, s t, 1 d from ev where e > s union all select u, e, -1 from ev where e > s),
n as (select u, t, sum(d) d from x group by 1, 2), c as (select u, t s, lead(t) over (partition by u order by t) e, sum(d) over (partition by u order by t) c from n),
m as (select u, s, e from c where c >= 2 and e is not null) {islands('m', 'u')}""")
def interval_coverage_k(t):
    return iv.covered(_valid(t), ["u"], 2, width=CELL_TICKS)


DAYS = "ev as (select user_id * 1000 + (epoch_us(ts) // 86400000000) % 1000 u, event_id id, event_type k, epoch_us(ts)::bigint s, (epoch_us(ts) + floor(value * 600000000))::bigint e, value v from events)"
DAY_DUR = DUR.replace(EV, DAYS).replace("select distinct u from sd", "select distinct u from ev")


def _user_days(t: Tables):
    """Intervals keyed by user and day of their start: many of these groups are empty on one side or both."""
    return t.intervals().withColumn("u", F.col("u") * 1000 + F.floor(F.col("s") / DAY) % 1000)


def _day_durations(t: Tables):
    x = _user_days(t)
    found = iv.durations(x.where("e > s and k in ('click', 'purchase')"), ["u"], "k", "click", "purchase", width=CELL_TICKS)
    return x.select("u").distinct().join(found, "u", "left").fillna(0, ["pd", "td", "tp"])


def _prf(policy: str):
    both = {"a": "1.0", "b": "0.0", "c": "0.0", "d": "null"}[policy]
    fill = lambda x: x if policy == "d" else f"case when pd = 0 and td = 0 then {both}::double else coalesce({x}, 0.0::double) end"
    sql = f"with {DAY_DUR} select u, pd, td, tp, {fill('tp::double / nullif(pd, 0)')} as precision, {fill('tp::double / nullif(td, 0)')} as recall, {fill('(2 * tp)::double / nullif(pd + td, 0)')} as f1 from du"

    def run(t):
        return iv.prf(_day_durations(t), policy)

    run.__name__ = f"interval_prf_{policy}"
    query(sql)(run)


for _p in "abcd":
    _prf(_p)


@query(f"""with {DAY_DUR}, p as (select b.u, b.s, b.e, coalesce(max(case when a.u is not null then (least(a.e, b.e) - greatest(a.s, b.s))::double / (greatest(a.e, b.e) - least(a.s, b.s)) end), 0.0) best
  from b left join a on a.u = b.u and a.s < b.e and b.s < a.e group by 1, 2, 3), w as (select u, round(avg(best), 6) best, count(*) n from p group by u)
select du.u, case when w.n is not null then w.best when du.pd = 0 then 1.0 else 0.0 end best_iou, coalesce(w.n, 0) n from du left join w using (u)""")
def best_window_iou(t):
    """Mean over truth windows of the best IoU; a group without truth scores 1 without predictions, else 0."""
    x = _user_days(t)
    good = x.where("e > s")
    pred = iv.merge(good.where("k = 'click'"), ["u"], width=CELL_TICKS)
    truth = iv.merge(good.where("k = 'purchase'"), ["u"], width=CELL_TICKS)
    iou = (F.least("e", "e2") - F.greatest("s", "s2")).cast("double") / (F.greatest("e", "e2") - F.least("s", "s2"))
    hits = overlapping(truth, pred.select("u", F.col("s").alias("s2"), F.col("e").alias("e2")), ["u"], 6 * 3600 * SECOND).groupBy("u", "s", "e").agg(F.max(iou).alias("best"))
    best = truth.join(hits, ["u", "s", "e"], "left").groupBy("u").agg(F.round(F.avg(F.coalesce("best", F.lit(0.0))), 6).alias("best"), F.count("*").alias("n"))
    every = x.groupBy("u").agg(F.count_if((F.col("k") == "click") & (F.col("e") > F.col("s"))).alias("preds"))
    score = F.when(F.col("n").isNotNull(), F.col("best")).when(F.col("preds") == 0, 1.0).otherwise(0.0)
    return every.join(best, "u", "left").select("u", score.alias("best_iou"), F.coalesce("n", F.lit(0)).alias("n"))


THREE = f"{EV}, sd as (select * from ev where e > s and k in ('click', 'purchase', 'view'))"


@query(f"""with {THREE}, a as ({PRED}), b as ({TRUE}), c as ({islands("(select * from sd where k = 'view')", 'u')}),
us as (select distinct u from sd), tp as (select a.u, sum(least(a.e, b.e) - greatest(a.s, b.s)) x from a join b on a.u = b.u and a.s < b.e and b.s < a.e group by 1),
v as (select u, s, e from c), pv as (select a.u, sum(least(a.e, v.e) - greatest(a.s, v.s)) x from a join v on a.u = v.u and a.s < v.e and v.s < a.e group by 1),
kv as (select b.u, sum(least(b.e, v.e) - greatest(b.s, v.s)) x from b join v on b.u = v.u and b.s < v.e and v.s < b.e group by 1),
ab as (select a.u, greatest(a.s, b.s) s, least(a.e, b.e) e from a join b on a.u = b.u and a.s < b.e and b.s < a.e),
pkv as (select ab.u, sum(least(ab.e, v.e) - greatest(ab.s, v.s)) x from ab join v on ab.u = v.u and ab.s < v.e and v.s < ab.e group by 1),
z as (select us.u, coalesce((select sum(e - s) from a where a.u = us.u), 0) pd, coalesce((select sum(e - s) from b where b.u = us.u), 0) kd, coalesce(tp.x, 0) tp,
  coalesce((select sum(e - s) from v where v.u = us.u), 0) - coalesce(kv.x, 0) ud, coalesce(pv.x, 0) - coalesce(pkv.x, 0) pu
  from us left join tp using (u) left join pv using (u) left join kv using (u) left join pkv using (u))
select u, (2 * tp)::double / nullif(pd + kd + ud - pu, 0)::double lower, (2 * (tp + pu))::double / nullif(pd + kd + pu, 0)::double upper from z""")
def f1_bounds_unknown(t):
    """View intervals outside the reference are unknown ground: F1 lies between the bounds."""
    x = iv.sweep(t.intervals().where("e > s and k in ('click', 'purchase', 'view')"), ["u"], "k", ("click", "purchase", "view"), width=CELL_TICKS)
    size, p, k = F.col("e") - F.col("s"), F.col("c_click") > 0, F.col("c_purchase") > 0
    u = (F.col("c_view") > 0) & ~k
    total = lambda c: F.sum(F.when(c, size).otherwise(0))
    m = x.groupBy("u").agg(total(p).alias("pd"), total(k).alias("kd"), total(p & k).alias("tp"), total(u).alias("ud"), total(p & u).alias("pu"))
    div = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    c = F.col
    return m.select("u", div(2 * c("tp"), c("pd") + c("kd") + c("ud") - c("pu")).alias("lower"), div(2 * (c("tp") + c("pu")), c("pd") + c("kd") + c("pu")).alias("upper"))


CELLS = """pt as (select u, s t, k, 1 d from ev where e > s union all select u, e, k, -1 from ev where e > s),
nt as (select u, t, sum(case when k = 'click' then d else 0 end) c, sum(case when k = 'signup' then d else 0 end) g, sum(case when k = 'purchase' then d else 0 end) p, sum(case when k = 'view' then d else 0 end) v from pt group by 1, 2),
sg as (select u, lead(t) over w - t z, sum(c) over w > 0 c, sum(g) over w > 0 g, sum(p) over w > 0 p, sum(v) over w > 0 v from nt window w as (partition by u order by t))"""


@query(f"""with {EV}, {CELLS}, m as (select u, sum(z) filter (p) kd, sum(z) filter (v and not p) ud, sum(z) filter (c) cd, sum(z) filter (g) gd, coalesce(sum(z) filter (c and p), 0) ct, coalesce(sum(z) filter (g and p), 0) gt,
coalesce(sum(z) filter (c and v and not p), 0) cu, coalesce(sum(z) filter (g and v and not p), 0) gu, coalesce(sum(z) filter (c <> g), 0) apart from sg where z is not null group by u)
select u, case when kd is null then null when apart = 0 then 0.0 else round((2 * gt)::double / (coalesce(gd, 0) + kd + coalesce(ud, 0) - gu) - (2 * (ct + cu))::double / (coalesce(cd, 0) + kd + cu), 9) end gain from m""")
def conservative_gain(t):
    """Candidate's lower F1 bound minus the baseline's upper one: what is gained whatever the unknown ground holds.
    Equal predictions gain 0; without known positives there is no score."""
    x = iv.sweep(t.intervals().where("e > s"), ["u"], "k", ("click", "signup", "purchase", "view"), width=CELL_TICKS)
    keep, un = F.col("c_purchase") > 0, (F.col("c_view") > 0) & (F.col("c_purchase") <= 0)
    base, new = F.col("c_click") > 0, F.col("c_signup") > 0
    size = lambda c, n: F.sum(F.when(c, F.col("e") - F.col("s")).otherwise(0)).alias(n)
    m = x.groupBy("u").agg(size(keep, "kd"), size(un, "ud"), size(base, "bd"), size(new, "nd"), size(base & keep, "bt"), size(new & keep, "nt"), size(base & un, "bu"), size(new & un, "nu"), size(base != new, "apart"))
    c = lambda n: F.col(n).cast("double")
    gain = F.try_divide(2 * c("nt"), c("nd") + c("kd") + c("ud") - c("nu")) - F.try_divide(2 * (c("bt") + c("bu")), c("bd") + c("kd") + c("bu"))
    return m.select("u", F.when(F.col("kd") > 0, F.when(F.col("apart") == 0, 0.0).otherwise(F.round(gain, 9))).alias("gain"))


@query(f"""with {EV}, {CELLS} select u, coalesce(sum(z) filter (p), 0)::bigint keep, coalesce(sum(z) filter (c), 0)::bigint as no, coalesce(sum(z) filter (v), 0)::bigint as unknown,
coalesce(sum(z) filter (p::int + c::int + v::int > 1), 0)::bigint overlap, coalesce(sum(z) filter (not (p or c or v)), 0)::bigint hole, coalesce(sum(z) filter (p::int + c::int + v::int <> 1), 0) = 0 as tiles from sg where z is not null group by u""")
def domain_partition_check(t):
    """Whether KEEP (purchase), NO (click) and UNKNOWN (view) tile each user's domain: what two of them share, and
    what none of them holds, between the user's first start and last end."""
    sets = {"purchase": "keep", "click": "no", "view": "unknown"}
    return iv.partition_check(_valid(t), ["u"], "k", sets, width=CELL_TICKS)


RANGE = "rg as (select u, min(s) lo, max(e) hi from ev group by 1)"


@query(f"with {EV}, {RANGE} select id, greatest(s - 750000, lo) s, least(e + case when e - s >= 8000000 then 750000 else 500000 end, hi) e from ev join rg using (u)")
def interval_pad_clip(t):
    x = _bounded(t)
    return iv.pad(x, F.lit(750_000), F.when(F.col("e") - F.col("s") >= 8 * SECOND, 750_000).otherwise(500_000), F.col("lo"), F.col("hi")).select("id", "s", "e")


def _bounded(t):
    x = t.intervals()
    return x.join(x.groupBy("u").agg(F.min("s").alias("lo"), F.max("e").alias("hi")), "u")


@query(f"with {EV}, {RANGE} select id, greatest(s - case when e - s >= 16000000 then 250000 else 0 end, lo) s, e from ev join rg using (u)")
def interval_pad_tier(t):
    return iv.pad(_bounded(t), F.when(F.col("e") - F.col("s") >= 16 * SECOND, 250_000).otherwise(0), F.lit(0), F.col("lo"), F.col("hi")).select("id", "s", "e")


@query(f"""with {EV}, {RANGE}, m as ({islands('(select * from ev where e > s)', 'u')}), d as (select u, sum(e - s) c from m group by 1)
select id, greatest(s - case when 2 * coalesce(c, 0) <= hi - lo then 250000 else 0 end, lo) s, least(e + case when 2 * coalesce(c, 0) <= hi - lo then 250000 else 0 end, hi) e from ev join rg using (u) left join d using (u)""")
def interval_pad_density(t):
    dense = iv.merge(_valid(t), ["u"], width=CELL_TICKS).groupBy("u").agg(F.sum(F.col("e") - F.col("s")).alias("c"))
    x = _bounded(t).join(dense, "u", "left")
    grow = F.when(2 * F.coalesce("c", F.lit(0)) <= F.col("hi") - F.col("lo"), 250_000).otherwise(0)
    return iv.pad(x, grow, grow, F.col("lo"), F.col("hi")).select("id", "s", "e")


SHRUNK = f"""{SIDES}, a as (select f.f, u, s + ((e - s) * (100 - f)) // 200 s, e - ((e - s) * (100 - f)) // 200 e from sd, (values (100), (80), (60), (40)) f(f) where k = 'click'),
m as ({islands('(select * from a where s < e)', 'f, u')}), b as ({TRUE}),
p as (select f, u, sum(e - s) pd from m group by 1, 2), o as (select m.f, m.u, sum(least(m.e, b.e) - greatest(m.s, b.s)) tp from m join b on m.u = b.u and m.s < b.e and b.s < m.e group by 1, 2),
q as (select u, sum(e - s) td from b group by 1), r as (select p.f, p.u, (2 * coalesce(tp, 0))::double / (pd + coalesce(td, 0)) f1 from p left join o on o.f = p.f and o.u = p.u left join q on q.u = p.u)"""


def _shrunk(t):
    """(factor, u, f1) of midpoint-preserving shrinks of the prediction."""
    sides = t.sides()
    factors = F.explode(F.array(*[F.lit(x) for x in (100, 80, 60, 40)]))
    click = sides.where("k = 'click'").withColumn("factor", factors)
    cut = F.floor((F.col("e") - F.col("s")) * (100 - F.col("factor")) / F.lit(200)).cast("long")
    click = click.withColumns({"s": F.col("s") + cut, "e": F.col("e") - cut}).where("s < e")
    truth = sides.where("k = 'purchase'").withColumn("factor", factors)
    m = iv.durations(click.unionByName(truth), ["factor", "u"], "k", "click", "purchase", width=CELL_TICKS).where("pd > 0")
    return m.select("factor", "u", ((2 * F.col("tp")).cast("double") / (F.col("pd") + F.col("td"))).alias("f1"))


@query(f"with {SHRUNK} select f::int factor, round(avg(f1), 6) f1, rank() over (order by round(avg(f1), 6) desc, f desc) = 1 best from r group by f")
def shrink_grid_search(t):
    """Midpoint-preserving shrink factors scored against the reference; the best of score, then factor."""
    m = _shrunk(t).groupBy("factor").agg(F.round(F.avg("f1"), 6).alias("f1"))
    top = m.agg(F.max(F.struct("f1", "factor")).alias("t"))  # four factors: a parameter grid
    return m.join(F.broadcast(top)).select("factor", "f1", (F.col("factor") == F.col("t.factor")).alias("best"))


DRAWS = 200


@query(f"""with {SHRUNK}, r2 as (select r.u % 20 g, r.f, r.f1 - z.f1 d from r join r z on z.u = r.u and z.f = 100), gr as (select f, g, sum(d) d, count(*) c from r2 group by 1, 2), gi as (select *, row_number() over (partition by f order by g) - 1 i from gr),
n as (select f, count(*) n from gr group by 1), sl as (select f, d draw, ('0x' || substr(md5('shrink:' || d || ':' || j), 1, 8))::bigint % n i from n, range(0, {DRAWS}) a(d), range(0, n.n) b(j)),
bs as (select f, draw, round(sum(gi.d) / sum(c), 9) v from sl join gi using (f, i) group by 1, 2), rk as (select f, v, row_number() over (partition by f order by v, draw) - 1 r from bs),
ci as (select f, min(v) filter (r = floor(0.025 * {DRAWS})) low from rk group by f), mn as (select f, round(sum(d) / sum(c), 9) gain from gr group by f), al as (select f, gain, low, f < 100 and gain >= 0.01 and low > 0 as accepted from mn join ci using (f))
select f::int factor, round(gain, 6) gain, round(low, 6) low, accepted, f = coalesce((select f from al where accepted order by gain desc, f desc limit 1), 100) selected from al""")
def shrink_acceptance(t):
    """A shrink factor replaces 100 only if it gains 0.01 at least and the lower bootstrap bound over source groups is
    above 0; the best such factor is selected."""
    r = _shrunk(t)
    base = r.where("factor = 100").select("u", F.col("f1").alias("f0"))
    groups = r.join(base, "u").groupBy("factor", (F.col("u") % 20).alias("g")).agg(F.sum(F.col("f1") - F.col("f0")).alias("d"), F.count("*").alias("c"))
    groups = groups.withColumn("i", (F.row_number().over(Window.partitionBy("factor").orderBy("g")) - 1).cast("long"))  # twenty groups a factor
    gain = groups.groupBy("factor").agg(F.round(F.sum("d") / F.sum("c"), 9).alias("gain"), F.count("*").alias("n"))
    slots = gain.select("factor", "n", F.explode(F.sequence(F.lit(0), F.lit(DRAWS - 1))).alias("draw")).withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    slots = slots.select("factor", "draw", hash_index(F.col("n"), F.lit("shrink"), F.col("draw").cast("string"), F.col("j").cast("string")).alias("i"))
    v = slots.join(groups, ["factor", "i"]).groupBy("factor", "draw").agg(F.round(F.sum("d") / F.sum("c"), 9).alias("v"))
    at = F.row_number().over(Window.partitionBy("factor").orderBy("v", "draw")) - 1  # as many as the draws
    low = v.withColumn("r", at).where(F.col("r") == int(0.025 * DRAWS)).select("factor", F.col("v").alias("low"))
    x = gain.join(low, "factor").withColumn("accepted", (F.col("factor") < 100) & (F.col("gain") >= 0.01) & (F.col("low") > 0))
    best = x.agg(F.coalesce(F.max(F.when(F.col("accepted"), F.struct("gain", "factor")))["factor"], F.lit(100)).alias("best"))
    return x.join(F.broadcast(best)).select("factor", F.round("gain", 6).alias("gain"), F.round("low", 6).alias("low"), "accepted", (F.col("factor") == F.col("best")).alias("selected"))


@query(f"with {EV}, {RANGE} select id, greatest(s, lo + 86400000000) s, least(e, hi - 86400000000) e from ev join rg using (u) where greatest(s, lo + 86400000000) < least(e, hi - 86400000000)")
def interval_clip(t):
    return iv.clip(_bounded(t), F.col("lo") + DAY, F.col("hi") - DAY).select("id", "s", "e")


@query(f"with {EV}, {RANGE} select id, least(greatest(s - lo, 0), hi - lo) s, least(greatest(e - lo, 0), hi - lo) e from ev join rg using (u)")
def interval_offset(t):
    span = F.col("hi") - F.col("lo")
    put = lambda c: F.least(F.greatest(F.col(c) - F.col("lo"), F.lit(0)), span)
    return _bounded(t).select("id", put("s").alias("s"), put("e").alias("e"))


@query(f"""with {EV}, d as (select *, case id % 3 when 0 then 'KEEP' when 1 then 'REFINE' else 'UNKNOWN' end ds, case (id // 3) % 3 when 0 then 'KEEP' when 1 then 'REFINE' else 'UNKNOWN' end de from ev where e > s),
r as (select id, s, e, case when ds = 'REFINE' then s + (e - s) * 3 // 4 else s end s2, case when de = 'REFINE' then e - (e - s) * 3 // 4 else e end e2 from d)
select id, case when s2 < e2 then s2 else s end s, case when s2 < e2 then e2 else e end e, s2 >= e2 restored from r""")
def refine_resolve(t):
    """Refined end points replace old ones; a crossed pair restores both."""
    state = lambda n: F.when(n % 3 == 1, "REFINE").when(n % 3 == 0, "KEEP").otherwise("UNKNOWN")
    cut = F.floor((F.col("e") - F.col("s")) * 3 / F.lit(4)).cast("long")
    x = _valid(t).withColumn("s2", F.when(state(F.col("id")) == "REFINE", F.col("s") + cut).otherwise(F.col("s"))).withColumn("e2", F.when(state(F.floor(F.col("id") / 3)) == "REFINE", F.col("e") - cut).otherwise(F.col("e")))
    good = F.col("s2") < F.col("e2")
    return x.select("id", F.when(good, F.col("s2")).otherwise(F.col("s")).alias("s"), F.when(good, F.col("e2")).otherwise(F.col("e")).alias("e"), (~good).alias("restored"))


@query("""with x as (select l_orderkey q, max(l_linenumber) + 0.5 dur, l_linenumber i, median(l_quantity) m from lineitem group by l_orderkey, l_linenumber),
d as (select q, max(dur) dur from x group by 1) select x.q, (2 * (i - 1))::double s, least(d.dur, 2.0 * i)::double e from x join d using (q) where m >= 30 and 2 * (i - 1) < d.dur""")
def saliency_segments(t):
    """Two-second clips whose median rating reaches the bar, cut at the duration."""
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("q"), F.col("l_linenumber").alias("i")).agg(F.median("l_quantity").alias("m"))
    d = x.groupBy("q").agg((F.max("i") + 0.5).alias("dur"))
    return x.join(d, "q").where("m >= 30 and 2 * (i - 1) < dur").select("q", (2 * (F.col("i") - 1)).cast("double").alias("s"), F.least(F.col("dur").cast("double"), (2 * F.col("i")).cast("double")).alias("e"))


@query(f"""with {EV}, {RANGE}, m as ({islands('(select * from ev where e > s)', 'u')}), g as (select u, lag(e, 1, lo) over (partition by u order by s) s, s e from m join rg using (u) union all select u, max(m.e), any_value(hi) from m join rg using (u) group by u)
select u, s, e from g where s < e""")
def interval_complement(t):
    x = t.intervals()
    return iv.complement(x.where("e > s"), x.groupBy("u").agg(F.min("s").alias("lo"), F.max("e").alias("hi")), ["u"], width=CELL_TICKS)


@query()
def event_match_1to1(t):
    """One-to-one matching per user and day: most pairs, then most summed IoU, then lexicographic; IoU of 1/2 at least."""
    sides = t.sides().withColumn("day", F.floor(F.col("s") / DAY))
    return match_one_to_one(sides.where("k = 'click'"), sides.where("k = 'purchase'"), ["u", "day"], 6 * 3600 * SECOND)


# Clock and time-window operators -----------------------------------------------------------------------------------


@query(f"with {CLOCK}, b as ({islands('(select * from ck where e > s and k = $$purchase$$)', 'u')}) select distinct ck.u, ck.i from ck join b on ck.u = b.u and ck.s >= b.s and ck.s < b.e")
def ordinals_in_intervals(t):
    ck = t.clock()
    spans = iv.merge(ck.where("e > s and k = 'purchase'"), ["u"], width=CELL_TICKS)
    return points_in_intervals(ck.select("u", "i", F.col("s").alias("t")), spans, ["u"], "t", 6 * 3600 * SECOND).select("u", "i").distinct()


FRB = f"{EV}, fr as (select id, s % 3600000000 a, s % 3600000000 + (e - s) // 60 b from ev)"
FPS_N, FPS_D = 1, 8_000_000  # frames a tick: one each eight seconds


def _frames(t):
    a = F.col("s") % 3_600_000_000
    return t.intervals().select("id", a.alias("a"), (a + F.floor((F.col("e") - F.col("s")) / 60)).alias("b"))


def _halfopen(x):
    lo = F.greatest(F.ceil(F.col("a") / FPS_D - 1e-9), F.lit(0))
    hi = F.least(F.ceil(F.col("b") / FPS_D - 1e-9), F.lit(450))
    return x.withColumn("f", F.explode(F.when(lo < hi, F.sequence(lo, hi - 1)).otherwise(F.array().cast("array<bigint>"))))


def _inclusive(x):
    lo, hi = F.bround(F.col("a") / FPS_D).cast("long"), F.bround(F.col("b") / FPS_D).cast("long")
    hi = F.when(hi <= lo, lo + 1).otherwise(hi)
    return x.withColumn("f", F.explode(F.filter(F.sequence(lo, hi), lambda v: v < 450)))


H_SQL = "select id, f from (select id, unnest(range(greatest(ceil(a / 8000000.0 - 1e-9), 0)::bigint, least(ceil(b / 8000000.0 - 1e-9), 450)::bigint)) f from fr)"
I_SQL = "select id, f from (select id, unnest(range(lo, greatest(hi, lo + 1) + 1)) f from (select id, round_even(a / 8000000.0, 0)::bigint lo, round_even(b / 8000000.0, 0)::bigint hi from fr)) where f < 450"


@query(f"with {FRB} {H_SQL}")
def frames_cfr_halfopen(t):
    return _halfopen(_frames(t)).select("id", "f")


@query(f"with {FRB}, c as (select id, greatest(a, 600000000) a, least(b, 3000000000) b from fr), d as (select * from c where a < b) {H_SQL.replace('from fr', 'from d')}")
def frames_cfr_ceil(t):
    x = _frames(t).withColumns({"a": F.greatest("a", F.lit(600 * SECOND)), "b": F.least("b", F.lit(3000 * SECOND))}).where("a < b")
    return _halfopen(x).select("id", "f")


@query(f"with {FRB} {I_SQL}")
def frames_round_inclusive(t):
    return _inclusive(_frames(t)).select("id", "f")


@query(f"with {FRB}, h as ({H_SQL}), i as ({I_SQL}), j as (select coalesce(h.id, i.id) id, h.id is null added, i.id is null removed from h full join i on h.id = i.id and h.f = i.f) select id, count_if(added)::bigint added, count_if(removed)::bigint removed, not bool_or(added or removed) same from j group by id")
def convention_diff(t):
    h, i = _halfopen(_frames(t)).select("id", "f", F.lit(1).alias("h")), _inclusive(_frames(t)).select("id", "f", F.lit(1).alias("n"))
    x = h.unionByName(i, allowMissingColumns=True).groupBy("id", "f").agg(F.max("h").alias("h"), F.max("n").alias("n"))
    return x.groupBy("id").agg(F.count_if(F.col("h").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.bool_and(F.col("h").isNotNull() & F.col("n").isNotNull()).alias("same"))


FRAME_CELL = 64  # frames that one task numbers of a hot key


U_SQL = f"with {FRB}, h as ({H_SQL}), z as (select distinct u, f from h join ev using (id))"


def _union_frames(t):
    return _halfopen(_frames(t)).join(t.intervals().select("id", "u"), "id").select("u", "f").distinct()


@query(f"{U_SQL} select u, f from z")
def frames_union(t):
    return _union_frames(t)


@query(f"{U_SQL}, g as (select u, f, f - row_number() over (partition by u order by f) g from z) select u, min(f) first, max(f) last from g group by u, g")
def frames_to_runs(t):
    return ordinals(_union_frames(t), ["u"], ["f"], FRAME_CELL).withColumn("g", F.col("f") - F.col("i")).groupBy("u", "g").agg(F.min("f").alias("first"), F.max("f").alias("last")).drop("g")


@query(f"with {FRB} select id, least(greatest(ceil(a / 8000000.0 - 1e-9), 0), 449)::bigint origin from fr")
def sampling_origin(t):
    return _frames(t).select("id", F.least(F.greatest(F.ceil(F.col("a") / FPS_D - 1e-9), F.lit(0)), F.lit(449)).alias("origin"))


N_SQL = "n as (select u, count(*) n from ev group by 1)"


@query(f"with {EV}, {N_SQL} select distinct u, case when n <= 16 then j else j * (n - 1) // 15 end i from n, range(0, 16) r(j) where j < n or n > 16")
def uniform_sample_floor(t):
    n = t.intervals().groupBy("u").agg(F.count("*").alias("n"))
    j = F.col("j")
    x = n.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.least("n", F.lit(16)) - 1)))
    return x.select("u", F.when(F.col("n") <= 16, j).otherwise(F.floor(j * (F.col("n") - 1) / 15)).alias("i")).distinct()


@query(f"with {EV}, {N_SQL} select distinct u, case when j = 15 then n - 1 else round_even(j * (n - 1) / 15.0, 0)::bigint end i from n, range(0, 16) r(j) where n >= 16")
def uniform_sample_round(t):
    n = t.intervals().groupBy("u").agg(F.count("*").alias("n")).where("n >= 16")
    x = n.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(15))))
    return x.select("u", F.when(F.col("j") == 15, F.col("n") - 1).otherwise(F.bround(F.col("j") * (F.col("n") - 1) / F.lit(15.0)).cast("long")).alias("i")).distinct()


@query(f"with {CLOCK}, {RANGE} select u, i, s, lead(s, 1, hi) over (partition by u order by i) as next from ck join rg using (u)")
def next_boundary(t):
    x = t.intervals()
    end = x.groupBy("u").agg(F.max("e").alias("end"))
    x = following(ordinals(x, ["u"], ["s", "id"], CELL_TICKS), ["u"], ["s", "id"], ["s"], CELL_TICKS)
    return x.join(end, "u").select("u", "i", "s", F.coalesce("next_s", "end").alias("next"))


@query(f"with {CLOCK} select u, i, s raw, s - min(s) over (partition by u) normalized from ck")
def clock_normalize(t):
    x = t.intervals()
    first = x.groupBy("u").agg(F.min("s").alias("first"))
    return ordinals(x, ["u"], ["s", "id"], CELL_TICKS).join(first, "u").select("u", "i", F.col("s").alias("raw"), (F.col("s") - F.col("first")).alias("normalized"))


@query(f"""with {CLOCK}, d as (select u, s - lag(s) over (partition by u order by i) d from ck), m as (select u, median(d)::double m from d where d is not null group by 1),
p as (select u, m, x, abs(m - x) / x r, row_number() over (partition by u order by abs(m - x), x) k from m, (values (3600000000), (7200000000), (10800000000), (14400000000)) q(x)) select u, m, case when r <= 0.2 then x end::bigint snapped from p where k = 1""")
def nearest_snap(t):
    d = previous(t.intervals(), ["u"], ["s", "id"], ["s"], CELL_TICKS).select("u", (F.col("s") - F.col("prev_s")).alias("d"))
    m = percentiles(d, ["u"], "d", m=("linear", 0.5))
    choices = F.array(*[F.lit(x * 3600 * SECOND) for x in (1, 2, 3, 4)])
    best = F.array_min(F.transform(choices, lambda x: F.struct(F.abs(F.col("m") - x).alias("far"), x.alias("x"))))
    return m.select("u", "m", F.when(best["far"] / best["x"] <= 0.2, best["x"]).alias("snapped"))


@query(f"""with {EV}, p as (select u, s // {6 * 3600 * SECOND} cell, case when k = 'purchase' then 1.0 when k = 'click' then 0.0 end y, k = 'view' un from ev),
a as (select u, unnest(range(min(cell), max(cell) + 1)) cell from p group by u), g as (select u, cell, count(*) n, case when bool_or(un) then null else round(avg(y), 9) end target from p group by 1, 2)
select u, cell, coalesce(n, 0) n, target from a left join g using (u, cell)""")
def grid_cell_targets(t):
    """Mean known state of each cell from a user's first to its last; null where a state is unknown or none is known."""
    y = F.when(F.col("k") == "purchase", 1.0).when(F.col("k") == "click", 0.0)
    x = t.intervals().select("u", F.floor(F.col("s") / (6 * 3600 * SECOND)).alias("cell"), y.alias("y"), (F.col("k") == "view").alias("un"))
    every = x.groupBy("u").agg(F.min("cell").alias("a"), F.max("cell").alias("b")).select("u", F.explode(F.sequence("a", "b")).alias("cell"))
    found = x.groupBy("u", "cell").agg(F.count("*").alias("n"), F.when(~F.bool_or("un"), F.round(F.avg("y"), 9)).alias("target"))
    return every.join(found, ["u", "cell"], "left").fillna(0, ["n"])


SPAN = f"{EV}, sp as (select u, min(s) lo, max(s) - min(s) t from ev group by 1)"
W3 = 3 * DAY


def _spans(t):
    return t.intervals().groupBy("u").agg(F.min("s").alias("lo"), (F.max("s") - F.min("s")).alias("t"))


def _window(x, starts, size):
    """Windows [start, min(start + size, t)) relative to the source's origin."""
    x = x.withColumn("a", F.explode(starts))
    return x.withColumn("b", F.least(F.col("a") + F.lit(size), F.col("t")))


@query(f"with {SPAN}, w as (select u, t, unnest(range(0, greatest(ceil(t / {W3}.0 - 1e-12), 1)::bigint)) * {W3} a from sp) select u, a, least(a + {W3}, t) b from w")
def window_tumbling_anchored(t):
    n = F.greatest(F.ceil(F.col("t") / W3 - 1e-12), F.lit(1))
    return _window(_spans(t), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * W3), W3).select("u", "a", "b")


@query(f"with {SPAN}, w as (select u, t, unnest(range(0, greatest(ceil(t / {W3}.0 - 1e-12), 1)::bigint)) * {W3} a from sp) select u, a, least(a + {W3}, t) b from w where least(a + {W3}, t) - a >= {DAY // 2}")
def window_tumbling_droptail(t):
    n = F.greatest(F.ceil(F.col("t") / W3 - 1e-12), F.lit(1))
    return _window(_spans(t), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * W3), W3).where(F.col("b") - F.col("a") >= DAY // 2).select("u", "a", "b")


@query(f"with {SPAN}, n as (select u, t, greatest((t + {W3} - 1) // {W3}, 1) n from sp), w as (select u, t, n, unnest(range(0, n)) i from n) select u, i * t // n a, (i + 1) * t // n b from w")
def window_equal_split(t):
    n = F.greatest(F.floor((F.col("t") + W3 - 1) / W3), F.lit(1))
    x = _spans(t).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    return x.select("u", F.expr("i * t div n").alias("a"), F.expr("(i + 1) * t div n").alias("b"))


HOP, SIZE = 3 * DAY // 2, 3 * DAY


@query(f"""with {SPAN}, w as (select u, t, unnest(case when t <= {SIZE} then [0::bigint] else list_append(range(0, t - {SIZE} + 1, {HOP}), t - {SIZE}) end) a from sp) select distinct u, a, least(a + {SIZE}, t) b from w""")
def window_hopping_right_aligned(t):
    last = F.col("t") - SIZE
    starts = F.when(last <= 0, F.array(F.lit(0).cast("long"))).otherwise(F.array_distinct(F.array_append(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)), F.lit(HOP).cast("long")), last)))
    return _window(_spans(t), starts, SIZE).select("u", "a", "b")


@query(f"with {SPAN}, n as (select u, t, case when t <= {SIZE} then 1 else (t - {SIZE} + {5 * DAY // 2} - 1) // {5 * DAY // 2} + 1 end n from sp), w as (select u, t, unnest(range(0, n::bigint)) * {5 * DAY // 2} a from n) select u, a, least(a + {SIZE}, t) b from w")
def window_hopping_partial(t):
    hop = 5 * DAY // 2
    n = F.when(F.col("t") <= SIZE, 1).otherwise(F.floor((F.col("t") - SIZE + hop - 1) / hop) + 1).cast("long")
    return _window(_spans(t), F.transform(F.sequence(F.lit(0).cast("long"), n - 1), lambda i: i * hop), SIZE).select("u", "a", "b")


@query(f"with {SPAN}, n as (select u, t, greatest((t + {W3} - 1) // {W3}, 1) n from sp), w as (select u, t, n, unnest(range(0, n)) i from n) select u, i * t // n a, (i + 1) * t // n b from w")
def window_builder_equal(t):
    """Equal windows by a builder that the plan is given."""
    return planned_windows(_spans(t), "u", "t", equal_split(W3))


@query(f"""with {SPAN}, w as (select u, t, unnest(case when t <= {SIZE} then [0::bigint] else list_append(range(0, t - {SIZE} + 1, {HOP}), t - {SIZE}) end) a from sp) select distinct u, a, least(a + {SIZE}, t) b from w""")
def window_builder_hopping(t):
    """Hopping windows by a builder that the plan is given."""
    return planned_windows(_spans(t), "u", "t", hopping(SIZE, HOP))


@query(f"""with {SPAN}, r as (select u, t, greatest((t + {W3} - 1) // {W3}, 1) n, row_number() over (order by sha256('pick:' || u)) - 1 r from sp)
select u, case r % 3 when 0 then 'begin' when 1 then 'interior' else 'end' end stratum, case r % 3 when 0 then 0 when 1 then ('0x' || substr(md5(u::varchar), 1, 8))::bigint % n else n - 1 end pick from r""")
def window_strata_pick(t):
    n = F.greatest(F.floor((F.col("t") + W3 - 1) / W3), F.lit(1))
    x = positions(_spans(t).select("u", n.alias("n")), [], [salted("pick", "u")], "r")
    kind = F.col("r") % 3
    return x.select("u", F.when(kind == 0, "begin").when(kind == 1, "interior").otherwise("end").alias("stratum"), F.when(kind == 0, F.lit(0)).when(kind == 1, hash_index(F.col("n"), F.col("u").cast("string"))).otherwise(F.col("n") - 1).cast("long").alias("pick"))


@query(f"with {EV}, {RANGE} select id, greatest(s - {3 * 3600 * SECOND}, lo) a, least(s + {3 * 3600 * SECOND}, hi) b from ev join rg using (u) where k = 'purchase'")
def window_around_event(t):
    half = 3 * 3600 * SECOND
    return _bounded(t).where("k = 'purchase'").select("id", F.greatest(F.col("s") - half, F.col("lo")).alias("a"), F.least(F.col("s") + half, F.col("hi")).alias("b"))


def _shots(t, gap=6 * 3600 * SECOND):
    cut = F.col("prev_s").isNull() | (F.col("s") - F.col("prev_s") > gap) | (F.col("k") == "signup")
    x = scan(t.intervals().select("u", "s", "id", "k"), ["u"], ["s", "id"], ["s"], cut)
    return x.withColumnRenamed("segment", "shot")


SHOTS = f"{CLOCK}, c0 as (select *, case when lag(s) over (partition by u order by i) is null or s - lag(s) over (partition by u order by i) > {6 * 3600 * SECOND} or k = 'signup' then 1 else 0 end cut from ck), sh as (select *, sum(cut) over (partition by u order by i rows unbounded preceding)::bigint shot from c0)"


@query(f"with {SHOTS} select u, shot, min(i) first, max(i) last, count(*) n from sh group by 1, 2")
def shot_segmentation(t):
    return _shots(t).groupBy("u", "shot").agg(F.min("i").alias("first"), F.max("i").alias("last"), F.count("*").alias("n"))


@query(f"""with {EV}, c0 as (select *, case when s - lag(s) over (partition by u order by s, id) < {2 * 3600 * SECOND} then 0 else 1 end cut from ev), g as (select *, sum(cut) over (partition by u order by s, id rows unbounded preceding) g from c0)
select u, min(s) s, max(s) + {2 * 3600 * SECOND} e, count(*) n from g group by u, g.g""")
def session_gap(t):
    x = t.events.select(F.col("user_id").alias("u"), F.col("ts").cast("timestamp").alias("ts"))
    x = x.groupBy("u", F.session_window("ts", "2 hours").alias("w")).agg(F.count("*").alias("n"))
    return x.select("u", F.unix_micros("w.start").alias("s"), F.unix_micros("w.end").alias("e"), "n")


@query(f"with {CLOCK}, d as (select u, i, abs(v - lag(v) over (partition by u order by i)) dv, s - lag(s) over (partition by u order by i) ds from ck) select u, i, coalesce(dv >= 50, false) by_value, coalesce(ds >= 21600000000, false) by_time from d where dv >= 50 or ds >= 21600000000")
def change_point_flags(t):
    x = previous(ordinals(t.intervals(), ["u"], ["s", "id"], CELL_TICKS), ["u"], ["s", "id"], ["v", "s"], CELL_TICKS)
    x = x.select("u", "i", F.abs(F.col("v") - F.col("prev_v")).alias("dv"), (F.col("s") - F.col("prev_s")).alias("ds"))
    return x.select("u", "i", F.coalesce(F.col("dv") >= 50, F.lit(False)).alias("by_value"), F.coalesce(F.col("ds") >= 6 * 3600 * SECOND, F.lit(False)).alias("by_time")).where("by_value or by_time")


@query(f"with {CLOCK}, c0 as (select u, i, k, case when k is distinct from lag(k) over (partition by u order by i) then 1 else 0 end c from ck), g as (select u, i, k, sum(c) over (partition by u order by i rows unbounded preceding) g from c0) select u, k, min(i) first, count(*) n from g group by u, k, g")
def rle_blocks(t):
    x = scan(t.intervals().select("u", "s", "id", "k"), ["u"], ["s", "id"], ["k"], (F.col("i") == 0) | ~F.col("k").eqNullSafe(F.col("prev_k")))
    return x.groupBy("u", "k", "segment").agg(F.min("i").alias("first"), F.count("*").alias("n")).drop("segment")


@query(f"with {CLOCK} select u, i // 16 chunk, count(*) n, string_agg(id::varchar, ',' order by i) ids from ck group by 1, 2")
def chunk_16(t):
    x = scan(t.intervals().select("u", "s", "id"), ["u"], ["s", "id"]).withColumn("chunk", F.floor(F.col("i") / 16))
    ids = F.transform(F.sort_array(F.collect_list(F.struct("i", "id"))), lambda r: r["id"].cast("string"))
    return x.groupBy("u", "chunk").agg(F.count("*").alias("n"), F.array_join(ids, ",").alias("ids"))
