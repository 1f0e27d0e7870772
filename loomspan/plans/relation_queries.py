"""Joins, aggregates, analytic functions, sampling, sets and the joint box score."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import geometry as geo
from ..operators import evaluate as ev
from ..operators import intervals as iv
from ..operators import joins as jn
from ..operators import leakage as lk
from ..operators import sampling as sp
from ..operators.ordered import ordinals, previous, running_max
from ..operators.scan import nearest_mark, scan
from ..sources.shared import Scratch
from .registry import BOX, CELL_TICKS, CLOCK, EV, SIDES, islands, query

HOUR = 3_600_000_000


def md5_index(text: str, n: str) -> str:
    return f"('0x' || substr(md5({text}), 1, 8))::bigint % {n}"


# Joins ---------------------------------------------------------------------------------------------------------------


@query("select o_orderpriority pri, count(*) n, sum(floor(l_quantity))::bigint q from lineitem join orders on l_orderkey = o_orderkey group by 1")
def join_inner(t):
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_orderpriority").alias("pri")).agg(F.count("*").alias("n"), F.sum(F.floor("l_quantity")).alias("q"))


@query("with l as (select distinct l_partkey k from lineitem where l_returnflag = 'R'), r as (select p_partkey k from part where p_size < 30) select count_if(l.k is not null and r.k is not null)::bigint matched, count_if(r.k is null)::bigint missing, count_if(l.k is null)::bigint extra from l full join r using (k)")
def join_coverage_audit(t):
    return jn.coverage_audit(t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")), t.part.where("p_size < 30").select(F.col("p_partkey").alias("k")), ["k"])


@query(f"with {BOX}, a as (select distinct o, f from bx where flag = 'R'), b as (select distinct o, f from bx where flag = 'A') select o, f from a join b using (o, f)")
def join_composite(t):
    x = t.boxes()
    return x.where("flag = 'R'").select("o", "f").distinct().join(x.where("flag = 'A'").select("o", "f").distinct(), ["o", "f"])


@query("select c_custkey, coalesce(string_agg(o_orderkey::varchar, ',' order by o_orderkey), '') orders from customer left join orders on c_custkey = o_custkey group by 1")
def join_left_keep_empty(t):
    x = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sort_array(F.collect_list("o_orderkey")).alias("ks"))
    return t.customer.select("c_custkey").join(x, "c_custkey", "left").select("c_custkey", F.array_join(F.coalesce(F.transform("ks", lambda k: k.cast("string")), F.array().cast("array<string>")), ",").alias("orders"))


@query("select c_custkey from customer where c_custkey in (select o_custkey from orders where o_orderstatus = 'F')")
def join_semi(t):
    return t.customer.join(t.orders.where("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("select c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def join_anti(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("""with a as (select doc_id, n_chars n from documents where doc_id % 7 <> 0), b as (select doc_id, case when doc_id % 13 = 0 then n_chars + 1 else n_chars end n from documents where doc_id % 11 <> 0)
select case when b.doc_id is null then 'EXTRA' when a.doc_id is null then 'MISSING' when a.n <> b.n then 'MISMATCH' else 'SAME' end state, count(*) n, min(doc_id) first from a full join b using (doc_id) group by 1""")
def join_full_reconcile(t):
    a = t.documents.where("doc_id % 7 <> 0").select("doc_id", F.col("n_chars").alias("a"))
    b = t.documents.where("doc_id % 11 <> 0").select("doc_id", F.when(F.col("doc_id") % 13 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("b"))
    state = F.when(F.col("b").isNull(), "EXTRA").when(F.col("a").isNull(), "MISSING").when(F.col("a") != F.col("b"), "MISMATCH").otherwise("SAME")
    return a.join(b, "doc_id", "full").groupBy(state.alias("state")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


FIRST = f"{BOX}, r1 as (select *, row_number() over (partition by o, f order by price, p, sk) r from bx where flag = 'R')"


@query(f"with {FIRST} select o, f, x, y, w from r1 where r = 1")
def join_first_wins(t):
    return jn.first_match(t.boxes().where("flag = 'R'").drop("flag"), ["o", "f"], ["price", "p", "sk"]).select("o", "f", "x", "y", "w")


@query("with a as (select n_regionkey k, count(*) n, min(n_nationkey) m from nation where n_nationkey % 2 = 0 or n_regionkey = 1 group by 1) select c_custkey, case when n is null then 'missing' when n > 1 then 'ambiguous' else 'found' end state, case when n = 1 then m end hit from customer left join a on k = c_nationkey % 7")
def join_ambiguity_class(t):
    a = t.nation.where("n_nationkey % 2 = 0 or n_regionkey = 1").groupBy(F.col("n_regionkey").alias("k")).agg(F.count("*").alias("n"), F.min("n_nationkey").alias("m"))
    x = t.customer.join(a, F.col("k") == F.col("c_nationkey") % 7, "left")
    return x.select("c_custkey", F.when(F.col("n").isNull(), "missing").when(F.col("n") > 1, "ambiguous").otherwise("found").alias("state"), F.when(F.col("n") == 1, F.col("m")).alias("hit"))


@query(f"with {EV} select a.id point, b.id span from ev a join ev b on a.u = b.u and a.s >= b.s and a.s < b.e and a.k = 'view' and b.k = 'purchase'")
def join_range_point(t):
    x = t.intervals()
    pts = x.where("k = 'view'").select("u", F.col("id").alias("point"), F.col("s").alias("t"))
    return jn.points_in_intervals(pts, x.where("k = 'purchase'").select("u", F.col("id").alias("span"), "s", "e"), ["u"], "t", 6 * HOUR).select("point", "span")


def _click_purchase(t):
    x = t.sides()
    b = x.where("k = 'purchase'").select("u", F.col("id").alias("b"), F.col("s").alias("s2"), F.col("e").alias("e2"))
    return jn.overlapping(x.where("k = 'click'").select("u", F.col("id").alias("a"), "s", "e"), b, ["u"], 6 * HOUR)


@query(f"with {SIDES} select a.id a, b.id b, least(a.e, b.e) - greatest(a.s, b.s) ticks from sd a join sd b on a.u = b.u and a.s < b.e and b.s < a.e and a.k = 'click' and b.k = 'purchase'")
def join_interval_overlap(t):
    return _click_purchase(t).select("a", "b", (F.least("e", "e2") - F.greatest("s", "s2")).alias("ticks"))


ANCH = f"{CLOCK}, an as (select *, case when i % 8 = 0 or i = max(i) over (partition by u) then i end a from ck), nb as (select *, last_value(a ignore nulls) over (partition by u order by i rows between unbounded preceding and current row) prev, first_value(a ignore nulls) over (partition by u order by i rows between current row and unbounded following) nxt from an)"


def _anchored(t):
    """Every eighth place and the last are anchors, of value v in tenths."""
    x = t.intervals().select("u", "s", "id", F.floor(F.col("v") * 10).cast("long").alias("y"))
    return scan(x, ["u"], ["s", "id"], mark=F.expr("i % 8 = 0 or i = n - 1"), value=F.col("y"))


@query(f"with {ANCH} select u, i, prev, nxt from nb")
def asof_bracket(t):
    return _anchored(t).select("u", "i", F.col("before.i").alias("prev"), F.col("after.i").alias("nxt"))


@query(f"with {ANCH} select u, i from an where a is not null")
def anchor_schedule(t):
    return _anchored(t).where("before.i = i").select("u", "i")


SPARSE = f"{CLOCK}, c1 as (select *, case when lag(s) over (partition by u order by i) is null or s - lag(s) over (partition by u order by i) > 21600000000 then 1 else 0 end c from ck), c2 as (select *, sum(c) over (partition by u order by i rows unbounded preceding)::bigint shot, case when k = 'purchase' then i end a from c1)"


def nearest_sql(part: str) -> str:
    return f"{SPARSE}, nb as (select *, last_value(a ignore nulls) over (partition by {part} order by i rows between unbounded preceding and current row) p, first_value(a ignore nulls) over (partition by {part} order by i rows between current row and unbounded following) n from c2), ns as (select *, case when n is null or i - p <= n - i then p else n end src from nb)"


def _sparse(t, shots):
    """Places with the nearest marked one, of the user's shot or anywhere."""
    gap = F.col("s") - F.col("prev_s")
    x = scan(t.intervals().select("u", "s", "id", "k"), ["u"], ["s", "id"], ["s"], gap.isNull() | (gap > 6 * HOUR), F.col("k") == "purchase")
    return nearest_mark(x, shots)


@query(f"with {nearest_sql('u, shot')} select u, i, src source, case when src is null or abs(i - src) > 2 then 'NEEDS_INFERENCE' when src = i then 'SAME_FRAME' else 'NEAREST' end state from ns")
def asof_nearest_bounded(t):
    far = F.col("source").isNull() | (F.col("distance") > 2)
    return _sparse(t, True).select("u", "i", "source", F.when(far, "NEEDS_INFERENCE").when(F.col("distance") == 0, "SAME_FRAME").otherwise("NEAREST").alias("state"))


@query(f"with {nearest_sql('u')} select u, i, src source, abs(i - src) distance from ns where src is not null")
def asof_nearest_unbounded(t):
    return _sparse(t, False).where("source is not null").select("u", "i", "source", "distance")


@query(f"with {nearest_sql('u, shot')}, h as (select u, count(a) n from c2 group by 1) select ns.u, case when h.n = 0 then 'UNRESOLVABLE' when src = i then 'SAME_FRAME' when src is not null and abs(i - src) <= 2 then 'SHOT_NEAREST' else 'NEEDS_INFERENCE' end state, count(*) n, max(abs(i - src)) farthest from ns join h on h.u = ns.u group by 1, 2")
def coverage_four_state(t):
    x = _sparse(t, True)
    any_ = x.groupBy("u").agg(F.count_if(F.col("k") == "purchase").alias("has"))
    state = F.when(F.col("has") == 0, "UNRESOLVABLE").when(F.col("distance") == 0, "SAME_FRAME").when(F.col("distance") <= 2, "SHOT_NEAREST").otherwise("NEEDS_INFERENCE")
    return x.join(any_, "u").groupBy("u", state.alias("state")).agg(F.count("*").alias("n"), F.max("distance").alias("farthest"))


@query(f"with {nearest_sql('u')} select u, count_if(src = i)::bigint same, count_if(src <> i)::bigint copied, min(case when src <> i then abs(i - src) end) nearest, max(case when src <> i then abs(i - src) end) farthest, count_if(abs(i - src) > 3)::bigint far from ns where src is not null group by u")
def copy_profile(t):
    d = F.when(F.col("distance") > 0, F.col("distance"))
    return _sparse(t, False).where("source is not null").groupBy("u").agg(F.count_if(F.col("distance") == 0).alias("same"), F.count_if(F.col("distance") > 0).alias("copied"), F.min(d).alias("nearest"), F.max(d).alias("farthest"), F.count_if(F.col("distance") > 3).alias("far"))


INTERP = f"{ANCH}, av as (select u, i, floor(v * 10)::bigint y from an where a is not null)"


@query(f"with {INTERP} select nb.u, nb.i, case when nb.nxt = nb.prev then p.y else round_even((p.y * (nb.nxt - nb.i) + n.y * (nb.i - nb.prev))::double / (nb.nxt - nb.prev), 0)::bigint end y from nb join av p on p.u = nb.u and p.i = nb.prev join av n on n.u = nb.u and n.i = nb.nxt")
def interp_linear(t):
    """Whole-number interpolation between anchors, half to even, without leaving integers."""
    x = _anchored(t)
    a, b, i = F.col("before"), F.col("after"), F.col("i")
    gap = F.greatest(b["i"] - a["i"], F.lit(1))
    y = F.when(a["i"] == b["i"], a["v"]).otherwise(geo.half_even(a["v"] * (b["i"] - i) + b["v"] * (i - a["i"]), gap))
    return x.select("u", "i", y.alias("y"))


def _even_sql(n: str, d: str) -> str:
    """Exact SQL for n / d, half to even (d > 0)."""
    r = f"(({n}) % ({d}) + ({d})) % ({d})"
    q = f"((({n}) - ({r})) // ({d}))"
    return f"({q} + case when 2 * ({r}) > ({d}) or (2 * ({r}) = ({d}) and ({q}) % 2 <> 0) then 1 else 0 end)::bigint"


def _slope_sql(n: str, before: str, after: str, a: str, b: str) -> str:
    return f"case when {a} * {b} <= 0 then 0::hugeint else sign({a})::hugeint * (3 * {after} + 3 * {before}) * abs({a}) * abs({b}) end n{n}, case when {a} * {b} <= 0 then 1::hugeint else (2 * {after} + {before})::hugeint * {before} * abs({b}) + ({after} + 2 * {before}) * {after} * abs({a}) end m{n}"


CUBIC = "((2*k*k*k - 24*k*k + 512) * z1 + (24*k*k - 2*k*k*k) * z2) * m1 * m2 + 8 * ((k*k*k - 16*k*k + 64*k) * n1 * m2 + (k*k*k - 8*k*k) * n2 * m1)"
LINE = "z1 * (q2 - i) + z2 * (i - q1)"


@query(f"""with {INTERP}, sl as (select u, i q1, y z1, lag(i) over w q0, lag(y) over w z0, lead(i) over w q2, lead(y) over w z2, lead(i, 2) over w q3, lead(y, 2) over w z3 from av window w as (partition by u order by i)),
f as (select u, i, sl.* exclude (u), i - q1 k, z1 - z0 a, z2 - z1 b, z3 - z2 c, q1 - q0 h0, q3 - q2 h2 from sl join (select u, i from ck) ck using (u) where q2 is not null and i >= q1 and i < q2 or q2 is null and i = q1),
g as (select *, {_slope_sql('1', 'h0', '8', 'a', 'b')}, {_slope_sql('2', '8', 'h2', 'b', 'c')} from f)
select u, i, case when i = q1 then z1 when q0 is not null and q3 is not null and q2 - q1 = 8 then {_even_sql(CUBIC, '512 * m1 * m2')} else {_even_sql(LINE, '(q2 - q1)')} end y, case when i = q1 then 'ANCHOR' when q0 is not null and q3 is not null and q2 - q1 = 8 then 'PCHIP' else 'LINEAR' end src from g""")
def interp_pchip(t):
    """Monotone cubic in gaps of eight that have a support more on either side (1 to 8 away), the linear rule elsewhere;
    whole numbers, half to even."""
    rows = Scratch(t.spark, "supports").keep(_anchored(t).select("u", "i", "y", F.col("before.i").alias("at")), "rows")
    here, w = F.struct("i", "y"), Window.partitionBy("u").orderBy("i")
    # Supports are an eighth of the rows; their tangents are made once for each support, not for each place.
    marks = rows.where("i = at").select("u", "i", here.alias("p"), F.lag(here).over(w).alias("o"), F.lead(here).over(w).alias("q"))
    o, p, q = F.col("o"), F.col("p"), F.col("q")
    marks = marks.withColumn("t1", geo.tangent(p["i"] - o["i"], q["i"] - p["i"], p["y"] - o["y"], q["y"] - p["y"]))
    marks = marks.select("u", "i", "p", "q", "t1", F.lead("t1").over(w).alias("t2"))
    x = rows.select("u", F.col("i").alias("f"), F.col("at").alias("i")).join(marks, ["u", "i"])
    gap = geo.Gap(F.col("p"), F.col("q"), F.col("t1"), F.col("t2"), F.col("f") - F.col("i"))
    return geo.interpolate(x, gap, pchip=geo.cubic_rule(), linear=geo.linear_rule).select("u", F.col("f").alias("i"), "y", "src")


@query("""with b as (select vec_id, list_transform(embedding, lambda x: x > 0) c from embeddings), r as (select min(vec_id) id, c from b group by c)
select x.id a, y.id b, list_sum([case when x.c[i] <> y.c[i] then 1 else 0 end for i in range(1, 65)])::int distance from r x join r y on x.id < y.id where list_sum([case when x.c[i] <> y.c[i] then 1 else 0 end for i in range(1, 65)]) <= 6""")
def near_dup_hamming(t):
    return lk.near_codes(t.embeddings, "vec_id", "embedding", 6)


BEST = f"{BOX}, a as (select o, x, y, w from bx where flag = 'R'), b as (select o, x, y, w from bx where flag = 'A'), pr as (select a.o, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y * 16 + a.w * 9, b.y * 16 + b.w * 9) - greatest(a.y * 16, b.y * 16)) n, 9 * a.w * a.w + 9 * b.w * b.w m from a join b using (o))"


@query(f"with {BEST}, mx as (select o, max(n::double / (m - n)) iou from pr group by o) select o_orderkey o, case when mx.iou is not null then mx.iou when exists (select 1 from bx where bx.o = o_orderkey and flag in ('R', 'A')) then 0.0 else 1.0 end iou from orders left join mx on mx.o = o_orderkey")
def best_pair_iou(t):
    """Best IoU of any prediction with any reference of an item; both empty 1, one empty 0. An item holds a few boxes."""
    x = t.boxes()
    a, b = x.where("flag = 'R'").select("o", F.struct("x", "y", "w").alias("a")), x.where("flag = 'A'").select("o", F.struct("x", "y", "w").alias("b"))
    best = a.join(b, "o").groupBy("o").agg(F.max(geo.iou_ratio(F.col("a"), F.col("b"), 16, 9)).alias("iou"))
    some = x.where("flag in ('R', 'A')").select("o").distinct().withColumn("some", F.lit(0.0))
    return t.orders.select(F.col("o_orderkey").alias("o")).join(best, "o", "left").join(some, "o", "left").select("o", F.coalesce("iou", "some", F.lit(1.0)).alias("iou"))


@query("with c as (select c_custkey, unnest([replace(lower(c_name), ' ', '_'), substr(c_name, 10), lower(c_mktsegment)]) al from customer), s as (select s_suppkey, unnest([replace(lower(s_name), ' ', '_'), substr(s_name, 10)]) al from supplier) select distinct s_suppkey, c_custkey from s join c using (al)")
def alias_leakage(t):
    name = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    tail = lambda c: F.substring(c, 10, 99)
    c = t.customer.select("c_custkey", F.explode(F.array(name("c_name"), tail("c_name"), F.lower("c_mktsegment"))).alias("al"))
    s = t.supplier.select("s_suppkey", F.explode(F.array(name("s_name"), tail("s_name"))).alias("al"))
    return s.join(c, "al").select("s_suppkey", "c_custkey").distinct()


@query("with d as (select sha256(text) sha, doc_id, doc_id % 10 < 2 dev from documents where text is not null) select sha, count_if(dev)::bigint n_a, count_if(not dev)::bigint n_b, min(doc_id) filter (dev) first_a, min(doc_id) filter (not dev) first_b from d group by sha having bool_or(dev) and bool_or(not dev)")
def content_leakage(t):
    """Byte contents that lie on both sides of a split, by their SHA-256."""
    x = t.documents.select(F.col("doc_id").alias("id"), "text")
    return lk.content_leaks(x.where("id % 10 < 2"), x.where("id % 10 >= 2"), "text")


@query("select md5(text) grp, count(*) n from documents group by 1 having bool_or(doc_id % 10 < 2) and bool_or(doc_id % 10 >= 2)")
def split_leakage(t):
    return lk.split_leaks(t.documents.select(F.md5("text").alias("grp"), F.when(F.col("doc_id") % 10 < 2, "dev").otherwise("train").alias("split")), "grp", "split")


ARMS = "ar as (select user_id u, round(sum(case when event_type = 'click' then floor(value * 100) end) / 100, 2) a, round(sum(case when event_type = 'purchase' then floor(value * 100) end) / 100, 2) b from events group by 1)"


def _arms(t):
    """Per user: arm a (click) and arm b (purchase), null where the arm has no row."""
    cents = lambda k: F.round(F.sum(F.when(F.col("event_type") == k, F.floor(F.col("value") * 100))) / 100, 2)
    return t.events.groupBy(F.col("user_id").alias("u")).agg(cents("click").alias("a"), cents("purchase").alias("b"))


@query(f"with {ARMS} select u, a, b, round(b - a, 2) delta from ar where a is not null and b is not null")
def paired_delta(t):
    return _arms(t).where("a is not null and b is not null").withColumn("delta", F.round(F.col("b") - F.col("a"), 2))


@query("select l_partkey, count(*) n, min(l_suppkey) = max(l_suppkey) consistent from lineitem group by 1")
def identity_consistency(t):
    return t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), (F.min("l_suppkey") == F.max("l_suppkey")).alias("consistent"))


@query(f"""with {SIDES}, p as (select a.id a, a.s, a.e, b.id b, b.s s2, b.e e2, least(a.e, b.e) - greatest(a.s, b.s) c from sd a left join sd b on a.u = b.u and a.s < b.e and b.s < a.e and b.k = 'purchase' where a.k = 'click'),
g as (select a, count(b) n, min(b) b, bool_and(2 * c > e - s and 2 * c > e2 - s2) major from p group by a) select a, case when n = 0 then 'NONE' when n > 1 then 'AMBIGUOUS' when not major then 'NOT_MAJORITY' else 'MATCH' end state, case when n = 1 and major then b end hit from g""")
def overlap_match_unambiguous(t):
    c = F.least("e", "e2") - F.greatest("s", "s2")
    major = (2 * c > F.col("e") - F.col("s")) & (2 * c > F.col("e2") - F.col("s2"))
    m = _click_purchase(t).groupBy("a").agg(F.count("*").alias("n"), F.min("b").alias("b"), F.bool_and(major).alias("major"))
    x = t.sides().where("k = 'click'").select(F.col("id").alias("a")).join(m, "a", "left")
    return x.select("a", F.when(F.col("n").isNull(), "NONE").when(F.col("n") > 1, "AMBIGUOUS").when(~F.col("major"), "NOT_MAJORITY").otherwise("MATCH").alias("state"), F.when((F.col("n") == 1) & F.col("major"), F.col("b")).alias("hit"))


# Aggregates ----------------------------------------------------------------------------------------------------------


@query("select event_type, count(*) n from events group by 1")
def agg_count(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"))


CENT = "cx as (select user_id u, user_id % 20 g, avg(floor(value * 100)) m, sum(floor(value * 100)) s, count(*) n from events group by 1, 2)"


def _cents(t):
    v = F.floor(F.col("value") * 100)
    return t.events.groupBy(F.col("user_id").alias("u"), (F.col("user_id") % 20).alias("g")).agg(F.avg(v).alias("m"), F.sum(v).alias("s"), F.count("*").alias("n"))


@query(f"with {CENT} select round(avg(gm), 6) macro, count(*) groups from (select g, avg(m) gm from cx group by g)")
def macro_mean(t):
    return _cents(t).groupBy("g").agg(F.avg("m").alias("gm")).agg(F.round(F.avg("gm"), 6).alias("macro"), F.count("*").alias("groups"))


@query(f"with {CENT} select round(sum(s) / sum(n), 6) micro from cx")
def micro_mean(t):
    return _cents(t).agg(F.round(F.sum("s") / F.sum("n"), 6).alias("micro"))


@query("select event_type k, round(avg(value), 6) mean, median(value) mid, min(value) low, max(value) high, round(avg((value > 50)::int), 6) rate from events group by 1")
def agg_basic(t):
    v, k = F.col("value"), F.col("event_type").alias("k")
    x = t.events.groupBy(k).agg(F.round(F.avg(v), 6).alias("mean"), F.min(v).alias("low"), F.max(v).alias("high"), F.round(F.avg((v > 50).cast("int")), 6).alias("rate"))
    return x.join(sp.percentiles(t.events.select(k, "value"), ["k"], "value", mid=("linear", 0.5)), "k")


@query("select user_id % 20 g, count_if(value < 20)::bigint low, count_if(value >= 80)::bigint high from events group by 1")
def agg_count_if(t):
    return t.events.groupBy((F.col("user_id") % 20).alias("g")).agg(F.count_if(F.col("value") < 20).alias("low"), F.count_if(F.col("value") >= 80).alias("high"))


def _typed(t):
    return t.events.select(F.col("event_type").alias("k"), "value")


@query("with r as (select event_type k, value v, row_number() over (partition by event_type order by value) r, count(*) over (partition by event_type) n from events) select k, min(v) filter (r = round_even(0.5 * (n - 1), 0) + 1) p50, min(v) filter (r = round_even(0.9 * (n - 1), 0) + 1) p90 from r group by k")
def percentile_index(t):
    return sp.percentiles(_typed(t), ["k"], "value", p50=("index", 0.5), p90=("index", 0.9))


@query("select event_type k, quantile_disc(value, 0.5) p50, quantile_disc(value, 0.9) p90 from events group by 1")
def percentile_nearest_rank(t):
    return sp.percentiles(_typed(t), ["k"], "value", p50=("rank", 0.5), p90=("rank", 0.9))


@query("select event_type k, round(quantile_cont(value, 0.25), 6) p25, round(quantile_cont(value, 0.9), 6) p90 from events group by 1")
def percentile_linear(t):
    x = sp.percentiles(_typed(t), ["k"], "value", p25=("linear", 0.25), p90=("linear", 0.9))
    return x.select("k", F.round("p25", 6).alias("p25"), F.round("p90", 6).alias("p90"))


@query("select user_id u, list_sort(list(value))[count(*) // 2 + 1] mid from events group by 1")
def median_upper(t):
    return sp.percentiles(t.events.select(F.col("user_id").alias("u"), "value"), ["u"], "value", mid=("upper", 0.5))


@query("select event_type k, count(distinct user_id) users from events group by 1")
def agg_distinct(t):
    return t.events.groupBy(F.col("event_type").alias("k")).agg(F.count_distinct("user_id").alias("users"))


@query("select user_id u, bool_or(event_type = 'purchase') bought, bool_and(value > 1) above from events group by 1")
def agg_bool(t):
    return t.events.groupBy(F.col("user_id").alias("u")).agg(F.bool_or(F.col("event_type") == "purchase").alias("bought"), F.bool_and(F.col("value") > 1).alias("above"))


@query("""with x as (select value v, unnest(list_filter(['all', case when event_type = 'click' then 'click' end, case when value > 50 then 'large' end, case when user_id % 2 = 0 then 'even' end], lambda s: s is not null)) slice from events) select slice, count(*) n, sum(floor(v))::bigint total from x group by 1""")
def agg_overlapping_slices(t):
    names = F.array_compact(F.array(F.lit("all"), F.when(F.col("event_type") == "click", "click"), F.when(F.col("value") > 50, "large"), F.when(F.col("user_id") % 2 == 0, "even")))
    return t.events.select(F.explode(names).alias("slice"), F.floor("value").alias("v")).groupBy("slice").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


@query("select lang, count_if(doc_id % 10 < 2)::bigint dev, count_if(doc_id % 10 >= 2)::bigint train from documents group by 1")
def agg_pivot(t):
    x = t.documents.select("lang", F.when(F.col("doc_id") % 10 < 2, "dev").otherwise("train").alias("split"))
    return x.groupBy("lang").pivot("split", ["dev", "train"]).count().fillna(0)


def _rater_sql(k: str) -> str:
    p = islands("(select * from ev where e > s and k = 'purchase')", "u")
    r = islands(f"(select * from ev where e > s and k = '{k}')", "u")
    return f"""select '{k}' rater, q.u, coalesce((2 * coalesce(x.tp, 0))::double / nullif(coalesce(pd, 0) + coalesce(rd, 0), 0), 1.0) f1 from (select distinct u from ev) q
left join (select u, sum(e - s) pd from ({p}) group by 1) p using (u) left join (select u, sum(e - s) rd from ({r}) group by 1) r using (u)
left join (select a.u, sum(least(a.e, b.e) - greatest(a.s, b.s)) tp from ({p}) a join ({r}) b on a.u = b.u and a.s < b.e and b.s < a.e group by 1) x using (u)"""


@query(f"with {EV}, f as ({' union all '.join(map(_rater_sql, ('view', 'click', 'signup')))}), m as (select u, avg(f1) f1 from f group by u) select u % 20 g, round(avg(f1), 6) f1, count(*) n from m group by 1")
def rater_mean_f1(t):
    """Every rater scores every user; mean over raters, then over users of a group."""
    x = t.intervals()
    raters = F.array(*[F.lit(r) for r in ("view", "click", "signup")])
    good = x.where("e > s")
    marked = good.where("k in ('view', 'click', 'signup')").select("u", F.col("k").alias("rater"), F.lit("r").alias("side"), "s", "e").unionByName(good.where("k = 'purchase'").select("u", F.explode(raters).alias("rater"), F.lit("p").alias("side"), "s", "e"))
    d = iv.prf(iv.durations(marked, ["u", "rater"], "side", "p", "r", CELL_TICKS), "a")
    grid = x.select("u").distinct().select("u", F.explode(raters).alias("rater"))
    f1 = grid.join(d, ["u", "rater"], "left").groupBy("u").agg(F.avg(F.coalesce("f1", F.lit(1.0))).alias("f1"))
    return f1.groupBy((F.col("u") % 20).alias("g")).agg(F.round(F.avg("f1"), 6).alias("f1"), F.count("*").alias("n"))


@query("select l_suppkey, l_linenumber, count(*) votes, (sum(l_quantity::bigint % 5 + 1) * 2 + count(*))::bigint // (2 * count(*)) mean from lineitem group by 1, 2")
def vote_half_up(t):
    vote = F.floor("l_quantity") % 5 + 1
    x = t.lineitem.groupBy("l_suppkey", "l_linenumber").agg(F.count("*").alias("votes"), F.sum(vote).alias("s"))
    return x.select("l_suppkey", "l_linenumber", "votes", F.expr("(2 * s + votes) div (2 * votes)").alias("mean"))


JOINT = f"""{FIRST}, p as (select o, count(*) n from bx where flag = 'R' group by 1), a1 as (select *, row_number() over (partition by o, f order by price, p, sk) r from bx where flag = 'A'), a as (select * from a1 where r = 1), g as (select o, count(*) n from a group by 1),
pr as (select a.o, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y * 16 + a.w * 9, b.y * 16 + b.w * 9) - greatest(a.y * 16, b.y * 16)) n, 9 * a.w * a.w + 9 * b.w * b.w m from a join (select * from r1 where r = 1) b on a.o = b.o and a.f = b.f),
h as (select o, sum(n::double / (m - n)) iou from pr group by 1), sc as (select o_orderkey, o_orderpriority pri, coalesce(p.n, 0) np, coalesce(g.n, 0) ng, coalesce(h.iou, 0) iou from orders left join p on p.o = o_orderkey left join g on g.o = o_orderkey left join h on h.o = o_orderkey),
js as (select *, case when np + ng = 0 then 1.0 else 2 * iou / (np + ng) end score from sc)"""


def _joint(t):
    x = t.boxes()
    gold = jn.first_match(x.where("flag = 'A'").drop("flag"), ["o", "f"], ["price", "p", "sk"])
    index = t.orders.select(F.col("o_orderkey").alias("o"), F.col("o_orderpriority").alias("pri"))
    return ev.joint_f(x.where("flag = 'R'").drop("flag"), gold, index, "o", "f", ["price", "p", "sk"], (16, 9))


@query(f"with {JOINT} select pri, count(*) videos, sum(np)::bigint n_pred, sum(ng)::bigint n_truth, round(100 * avg(score), 6) score from js group by pri")
def joint_f1(t):
    return _joint(t).groupBy("pri").agg(F.count("*").alias("videos"), F.sum("n_pred").alias("n_pred"), F.sum("n_truth").alias("n_truth"), F.round(100 * F.avg("score"), 6).alias("score"))


@query(f"with {JOINT}, z as (select pri, count_if(ng = 0)::bigint unlabelled, count(*) n, count_if(np > 6)::bigint invalid, avg(score) score from js group by pri), st as (select *, case when invalid > 0 then 'INVALID_INPUT' when unlabelled = n then 'NOT_COMPUTABLE' when unlabelled > 0 then 'SPARSE_DIAGNOSTIC' else 'OK' end status from z) select pri, status, case when status in ('OK', 'SPARSE_DIAGNOSTIC') then round(100 * score, 6) end score from st")
def score_status(t):
    z = _joint(t).groupBy("pri").agg(F.count_if(F.col("n_truth") == 0).alias("un"), F.count("*").alias("n"), F.count_if(F.col("n_pred") > 6).alias("bad"), F.avg("score").alias("score"))
    status = F.when(F.col("bad") > 0, "INVALID_INPUT").when(F.col("un") == F.col("n"), "NOT_COMPUTABLE").when(F.col("un") > 0, "SPARSE_DIAGNOSTIC").otherwise("OK")
    z = z.withColumn("status", status)
    return z.select("pri", "status", F.when(F.col("status").isin("OK", "SPARSE_DIAGNOSTIC"), F.round(100 * F.col("score"), 6)).alias("score"))


GROUPS = "gp as (select row_number() over (order by g) - 1 i, d, c from (select user_id % 20 g, sum(case event_type when 'purchase' then floor(value * 100) when 'click' then -floor(value * 100) end)::bigint d, count_if(event_type in ('click', 'purchase')) c from events group by 1))"


def _groups(t):
    v = F.floor(F.col("value") * 100)
    x = t.events.groupBy((F.col("user_id") % 20).alias("g")).agg(F.sum(F.when(F.col("event_type") == "purchase", v).when(F.col("event_type") == "click", -v)).alias("d"), F.count_if(F.col("event_type").isin("click", "purchase")).alias("c"))
    return x.select((F.row_number().over(Window.orderBy("g")) - 1).cast("long").alias("i"), "d", "c")  # twenty groups


DRAWS = 10_000


def _draw_sql(seed: str, value: str) -> str:
    return f"with {GROUPS}, n as (select count(*) n from gp), sl as (select d draw, {md5_index(chr(39) + seed + ':' + chr(39) + ' || d || ' + chr(39) + ':' + chr(39) + ' || j', 'n')} i from n, range(0, {DRAWS}) a(d), range(0, n.n) b(j)), b as (select draw, {value} v from sl join gp using (i) group by draw), r as (select v, row_number() over (order by v, draw) - 1 r from b) select round(min(v) filter (r = floor(0.025 * {DRAWS})), 6) low, round(min(v) filter (r = floor(0.975 * {DRAWS})), 6) high, count_if(v > 0) / {DRAWS}.0::double above from r"


def _bounds(b):
    """Percentile bounds over the draws: as many rows as the parameter says."""
    r = b.select("v", (F.row_number().over(Window.orderBy("v", "draw")) - 1).alias("r"))
    at = lambda p: F.round(F.min(F.when(F.col("r") == int(p * DRAWS), F.col("v"))), 6)
    return r.agg(at(0.025).alias("low"), at(0.975).alias("high"), (F.count_if(F.col("v") > 0) / DRAWS).alias("above"))


@query(_draw_sql("mean", "sum(d)::double / count(*)"))
def bootstrap_group_mean(t):
    return _bounds(ev.bootstrap(_groups(t), DRAWS, ["d"], "mean").select("draw", (F.col("d").cast("double") / F.col("n")).alias("v")))


@query(_draw_sql("ratio", "sum(d)::double / sum(c)"))
def bootstrap_ratio(t):
    return _bounds(ev.bootstrap(_groups(t), DRAWS, ["d", "c"], "ratio").select("draw", (F.col("d").cast("double") / F.col("c")).alias("v")))


@query(f"""with it as (select user_id % 20 g, row_number() over (partition by user_id % 20 order by event_id) - 1 i, floor(value * 100)::bigint v from events), n as (select g, count(*) n from it group by 1),
sl as (select n.g, d draw, {md5_index("'in:' || n.g || ':' || d || ':' || j", 'n.n')} i from n, range(0, 10) a(d), range(0, n.n) b(j)), m as (select draw, it.g, sum(v) / count(*) m from sl join it on it.g = sl.g and it.i = sl.i group by 1, 2) select draw, round(avg(m), 6) macro from m group by draw""")
def bootstrap_within(t):
    x = t.events.select((F.col("user_id") % 20).alias("g"), "event_id", F.floor(F.col("value") * 100).alias("v"))
    x = sp.positions(x, ["g"], [F.col("event_id")], "i", total="n")
    # A group has as many slots as rows, so each row makes its slot of every draw: no task makes all of a group's. Slots
    # seem few to the planner, which would broadcast them.
    sl = x.withColumnRenamed("i", "j").withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))))
    sl = sl.select("g", "draw", ev.hash_index(F.col("n"), F.lit("in"), F.col("g").cast("string"), F.col("draw").cast("string"), F.col("j").cast("string")).alias("i"))
    m = sl.hint("merge").join(x.select("g", "i", "v"), ["g", "i"]).groupBy("draw", "g").agg((F.sum("v") / F.count("*")).alias("m"))
    return m.groupBy("draw").agg(F.round(F.avg("m"), 6).alias("macro"))


@query("with x as (select l_returnflag k, l_quantity a, l_linenumber b from lineitem), r as (select k, rank() over (partition by k order by a) + (count(*) over (partition by k, a) - 1) / 2.0 ra, rank() over (partition by k order by b) + (count(*) over (partition by k, b) - 1) / 2.0 rb from x) select k, round(corr(ra, rb), 6) rho from r group by k")
def spearman(t):
    x = t.lineitem.select(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("a"), F.col("l_linenumber").alias("b"))
    return ev.rank_correlation(x, ["k"], "a", "b").select("k", F.round("rho", 6).alias("rho"))


@query(f"with {ARMS}, d as (select round(b - a, 2) d from ar where a is not null and b is not null) select count_if(d > 0)::bigint win, count_if(d = 0)::bigint tie, count_if(d < 0)::bigint loss, min(d) worst from d")
def win_tie_loss(t):
    d = _arms(t).where("a is not null and b is not null").select(F.round(F.col("b") - F.col("a"), 2).alias("d"))
    return d.agg(F.count_if(F.col("d") > 0).alias("win"), F.count_if(F.col("d") == 0).alias("tie"), F.count_if(F.col("d") < 0).alias("loss"), F.min("d").alias("worst"))


@query(f"with {CENT}, z as (select sum(s) s, count(*) c from cx) select u, round((z.s - cx.s) / (z.c - 1), 6) rest from cx, z where z.c > 1")
def leave_one_out(t):
    x = _cents(t)
    z = x.agg(F.sum("s").alias("all"), F.count("*").alias("c"))
    return x.join(F.broadcast(z)).where("c > 1").select("u", F.round((F.col("all") - F.col("s")) / (F.col("c") - 1), 6).alias("rest"))


@query("with r as (select value v, row_number() over (order by value) r, count(*) over () n from events), e as (select min(v) filter (r = round_even(0.25 * (n - 1), 0) + 1) a, min(v) filter (r = round_even(0.5 * (n - 1), 0) + 1) b, min(v) filter (r = round_even(0.75 * (n - 1), 0) + 1) c from r) select case when value <= a then 1 when value <= b then 2 when value <= c then 3 else 4 end::int stratum, count(*) n, sum(floor(value))::bigint total from events, e group by 1")
def stratified_quartile(t):
    edges = sp.percentiles(t.events.select("value"), [], "value", a=("index", 0.25), b=("index", 0.5), c=("index", 0.75))
    s = F.when(F.col("value") <= F.col("a"), 1).when(F.col("value") <= F.col("b"), 2).when(F.col("value") <= F.col("c"), 3).otherwise(4)
    return t.events.join(F.broadcast(edges)).groupBy(s.alias("stratum")).agg(F.count("*").alias("n"), F.sum(F.floor("value")).alias("total"))


@query("with g as (select source, count(*) c from documents group by 1), z as (select sum(c) n, count(*) g from g) select doc_id, n::double / (g * c) weight from documents join g using (source), z")
def balanced_weights(t):
    g = t.documents.groupBy("source").agg(F.count("*").alias("c"))
    z = g.agg(F.sum("c").alias("n"), F.count("*").alias("g"))
    return t.documents.join(g, "source").join(F.broadcast(z)).select("doc_id", (F.col("n").cast("double") / (F.col("g") * F.col("c"))).alias("weight"))


@query("with r as (select user_id u, value, row_number() over (partition by user_id order by value desc, event_id) r, count(*) over (partition by user_id) n from events) select u, sum(floor(value))::bigint top, count(*) n from r where r <= ceil(0.15 * n) group by u")
def topk_fraction(t):
    x = t.events.select(F.col("user_id").alias("u"), "event_id", "value")
    x = sp.positions(x, ["u"], [-F.col("value"), F.col("event_id")], "r", total="n")
    return x.where(F.col("r") < F.ceil(F.lit(0.15) * F.col("n"))).groupBy("u").agg(F.sum(F.floor("value")).alias("top"), F.count("*").alias("n"))


@query("select floor(l_quantity)::bigint q, count(*) n from lineitem group by 1 order by n desc, q limit 5")
def agg_mode_topk(t):
    return t.lineitem.groupBy(F.floor("l_quantity").alias("q")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "q").limit(5)


@query("with p as (select event_id, user_id % 20 g, event_type k, floor(value)::bigint y from events), q as (select event_id, floor(value * 2)::bigint z from events where event_id % 97 <> 0) select g, k, case when bool_or(z is null) then null else round(avg(abs(y - z)), 6) end mae, count_if(z is null)::bigint missing from p left join q using (event_id) group by 1, 2")
def paired_endpoint_mae(t):
    p = t.events.select("event_id", (F.col("user_id") % 20).alias("g"), F.col("event_type").alias("k"), F.floor("value").alias("y"))
    q = t.events.where("event_id % 97 <> 0").select("event_id", F.floor(F.col("value") * 2).alias("z"))
    gone = F.col("z").isNull()
    return p.join(q, "event_id", "left").groupBy("g", "k").agg(F.when(~F.bool_or(gone), F.round(F.avg(F.abs(F.col("y") - F.col("z"))), 6)).alias("mae"), F.count_if(gone).alias("missing"))


@query(f"with {CLOCK} select u, i, s - lag(s) over (partition by u order by i) delta from ck")
def win_lag_delta(t):
    x = previous(ordinals(t.intervals(), ["u"], ["s", "id"], CELL_TICKS), ["u"], ["s", "id"], ["s"], CELL_TICKS)
    return x.select("u", "i", (F.col("s") - F.col("prev_s")).alias("delta"))


@query(f"with {CLOCK} select u, id, i from ck")
def win_row_number(t):
    return ordinals(t.intervals(), ["u"], ["s", "id"], CELL_TICKS).select("u", "id", "i")


@query(f"with {EV} select u, id, max(floor(v)::bigint) over (partition by u order by s, id rows unbounded preceding) high from ev")
def win_running_max(t):
    return running_max(t.intervals(), ["u"], ["s", "id"], F.floor("v"), CELL_TICKS, "high").select("u", "id", "high")


@query("with c as (select l_returnflag k, l_quantity v, count(*) n from lineitem group by 1, 2) select k, v, sum(n) over (partition by k order by v rows unbounded preceding) - n + (n + 1) / 2.0 r from c")
def win_average_tie_rank(t):
    """Ranks with ties averaged, over the distinct values of each key."""
    counts = t.lineitem.groupBy(F.col("l_returnflag").alias("k"), F.col("l_quantity").alias("v")).agg(F.count("*").alias("n"))
    return ev.tied_ranks(counts, ["k"], "v", "n", "r").select("k", "v", "r")


@query(f"with {EV}, d as (select distinct on (u, s) * from ev order by u, s, id) select u, id, last_value(case when k = 'purchase' then id end ignore nulls) over (partition by u order by s rows between unbounded preceding and current row) as before, first_value(case when k = 'purchase' then id end ignore nulls) over (partition by u order by s rows between current row and unbounded following) as after from d")
def asof_last_value(t):
    """Last and next known value at each instant, in cells; of rows at one instant the smallest id counts."""
    x = jn.first_match(t.intervals().select("u", "s", "id", "k"), ["u", "s"], ["id"])
    x = jn.neighbours(x, ["u"], "s", F.col("k") == "purchase", F.col("id"), width=CELL_TICKS)
    return x.select("u", "id", F.col("prev").alias("before"), F.col("next").alias("after"))


# Sorting and sampling ------------------------------------------------------------------------------------------------

NUMERIC = "nu as (select c_custkey, case when c_custkey % 3 = 0 then 'x' || c_custkey else c_custkey::varchar end nm from customer)"


@query(f"with {NUMERIC} select nm, row_number() over (order by not regexp_matches(nm, '^[0-9]+$'), try_cast(nm as bigint), nm) r from nu")
def sort_numeric_aware(t):
    """Position in an order that puts digit names first, as numbers. Ranks come from a range-partitioned sort."""
    x = t.customer.select(F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), "c_custkey")).otherwise(F.col("c_custkey").cast("string")).alias("nm"))
    keys = [~F.col("nm").rlike("^[0-9]+$"), F.col("nm").try_cast("long"), F.col("nm")]
    return sp.global_rank(x, keys, "r").select("nm", "r")


@query("select event_id, row_number() over (order by event_type desc, floor(value), event_id) r from events")
def sort_multi_key(t):
    """Position in an order of several keys, one of them falling."""
    x = sp.global_rank(t.events.select("event_id", "event_type", "value"), [F.translate("event_type", "abcdefghijklmnopqrstuvwxyz", "zyxwvutsrqponmlkjihgfedcba"), F.floor("value"), F.col("event_id")], "r")
    return x.select("event_id", "r")


@query("select event_id, abs(floor(value * 100) - 5000)::bigint far from events order by far, event_id limit 20")
def topn_distance(t):
    return t.events.select("event_id", F.abs(F.floor(F.col("value") * 100) - 5000).alias("far")).orderBy("far", "event_id").limit(20)


@query("select doc_id from documents order by sha256('s1:' || doc_id), doc_id limit 50")
def hash_sample(t):
    return sp.hash_sample(t.documents.select("doc_id"), "s1", ["doc_id"], 50)


@query("with r as (select doc_id, source, sha256('s2:' || doc_id) h from documents), m as (select source, min(struct_pack(h := h, d := doc_id)) m from r group by 1) select source, m.d doc_id from m")
def hash_group_pick(t):
    return sp.group_pick(t.documents.select("source", "doc_id"), "source", "s2", ["doc_id"]).select("source", "doc_id")


QUOTA = "st as (select c_mktsegment s, count(*) n from customer group by 1), tot as (select sum(n)::bigint t from st), fl as (select s, n, 100 * n // t q, 100 * n % t r from st, tot), al as (select s, n, (q + case when row_number() over (order by r desc, s) <= 100 - (select sum(q) from fl) then 1 else 0 end)::bigint quota from fl)"


@query(f"with {QUOTA} select s, n, quota from al")
def largest_remainder(t):
    return sp.largest_remainder(t.customer.groupBy(F.col("c_mktsegment").alias("s")).agg(F.count("*").alias("n")), "s", 100)


@query(f"with {QUOTA}, r as (select c_custkey, c_mktsegment s, row_number() over (partition by c_mktsegment order by sha256('s3:' || c_custkey)) r from customer) select c_custkey, case when r <= quota then 'dev' when r <= 2 * quota then 'confirm' else 'train' end split from r join al using (s)")
def stratified_split(t):
    return sp.stratified_split(t.customer.select("c_custkey", F.col("c_mktsegment").alias("s")), "s", "s3", ["c_custkey"], 100).select("c_custkey", "split")


@query("with k as (select event_id from events order by sha256('s4:' || event_id) limit 100) select event_id, props from events join k using (event_id)")
def sample_keep_order(t):
    pick = sp.hash_sample(t.events.select("event_id"), "s4", ["event_id"], 100)
    return t.events.join(F.broadcast(pick), "event_id").select("event_id", "props").orderBy("event_id")


@query("with r as (select user_id u, event_id, floor(value)::bigint v, row_number() over (partition by user_id order by floor(value) desc, event_id) r from events) select u, event_id, v from r where r = 1")
def argmax_tiebreak(t):
    v = F.floor("value")
    best = F.max_by(F.struct("event_id", v.alias("v")), F.struct(v, -F.col("event_id")))
    return t.events.groupBy(F.col("user_id").alias("u")).agg(best.alias("b")).select("u", "b.event_id", "b.v")


@query("with f as (select user_id u, event_type k, min(event_id) f from events group by 1, 2), r as (select *, row_number() over (partition by u order by f) r from f) select u, k, f as first, r from r where r <= 2")
def first_distinct_k(t):
    f = t.events.groupBy(F.col("user_id").alias("u"), F.col("event_type").alias("k")).agg(F.min("event_id").alias("first"))
    return f.withColumn("r", F.row_number().over(Window.partitionBy("u").orderBy("first"))).where("r <= 2")


@query()
def greedy_distinct(t):
    """Strata in order take up to two rows each by hash, skipping users that an earlier pick has."""
    return sp.greedy_distinct(t.events.select(F.col("event_type").alias("stratum"), F.col("user_id").alias("key"), F.col("event_id").alias("id")), "s5", 2)


@query("with r as (select doc_id, n_chars % 3 bin, row_number() over (partition by n_chars % 3 order by sha256('s6:' || doc_id)) - 1 r from documents) select doc_id, bin, r * 3 + bin pos from r")
def round_robin_bins(t):
    x = sp.positions(t.documents.select("doc_id", (F.col("n_chars") % 3).alias("bin")), ["bin"], [ev.salted("s6", "doc_id")], "r")
    return x.select("doc_id", "bin", (F.col("r") * 3 + F.col("bin")).alias("pos"))


# Sets and supports ---------------------------------------------------------------------------------------------------


def _ab(t):
    x = t.lineitem
    return x.where("l_returnflag = 'R'").select("l_partkey"), x.where("l_returnflag = 'A'").select("l_partkey")


AB = "a as (select l_partkey from lineitem where l_returnflag = 'R'), b as (select l_partkey from lineitem where l_returnflag = 'A')"


@query(f"with {AB} select * from a union select * from b")
def set_union(t):
    a, b = _ab(t)
    return a.union(b).distinct()


@query(f"with {AB} select * from a intersect select * from b")
def set_intersect(t):
    a, b = _ab(t)
    return a.intersect(b)


@query(f"with {AB} select * from a except select * from b")
def set_except(t):
    a, b = _ab(t)
    return a.subtract(b)


@query(f"with {AB} select (select count(*) from (select * from a except select * from b)) only_a, (select count(*) from (select * from b except select * from a)) only_b, (select count(*) from (select * from a except select * from b)) = 0 and (select count(*) from (select * from b except select * from a)) = 0 same")
def set_equality(t):
    a, b = (x.distinct() for x in _ab(t))
    x = a.withColumn("a", F.lit(1)).unionByName(b.withColumn("b", F.lit(1)), allowMissingColumns=True).groupBy("l_partkey").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return x.agg(F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b")).withColumn("same", (F.col("only_a") == 0) & (F.col("only_b") == 0))


@query(f"with {AB} select (select count(*) from (select * from a except all select * from b)) more_a, (select count(*) from (select * from b except all select * from a)) more_b")
def bag_equality(t):
    a, b = _ab(t)
    x = a.withColumn("d", F.lit(1)).union(b.withColumn("d", F.lit(-1))).groupBy("l_partkey").agg(F.sum("d").alias("d"))
    return x.agg(F.coalesce(F.sum(F.greatest("d", F.lit(0))), F.lit(0)).alias("more_a"), F.coalesce(F.sum(F.greatest(-F.col("d"), F.lit(0))), F.lit(0)).alias("more_b"))


SUP = f"{CLOCK}, su as (select ck.u, ck.i, x.id from ck join ev x on x.u = ck.u and ck.s >= x.s and ck.s < x.e)"


def _supports(t):
    """Each ordinal with the events whose interval holds it."""
    ck = t.clock()
    return jn.points_in_intervals(ck.select("u", "i", F.col("s").alias("t")), ck.select("u", "id", "s", "e"), ["u"], "t", 6 * HOUR).select("u", "i", "id")


@query(f"with {SUP} select u, i, count_if(id % 4 <> 0)::bigint kept, count_if(id % 4 <> 0) > 0 retained from su group by u, i")
def retained_support_union(t):
    """Dropping events keeps an ordinal that another kept event still covers."""
    return _supports(t).groupBy("u", "i").agg(F.count_if(F.col("id") % 4 != 0).alias("kept")).withColumn("retained", F.col("kept") > 0)


@query(f"with {SUP}, a as (select u, i, bool_or(id % 4 = 1) added from su group by u, i), f as (select u, i, count_if(id % 5 <> 0)::bigint n from ck group by 1, 2) select a.u, a.i, case when not a.added then 'NOT_ADDED' when f.n = 0 then 'FIELD_MISSING' when f.n > 1 then 'FIELD_TWICE' else 'OK' end state from a join f using (u, i)")
def added_fields(t):
    """Each added ordinal takes its field from a table, exactly once: what is missing or given twice is said."""
    judged = _supports(t).groupBy("u", "i").agg(F.bool_or(F.col("id") % 4 == 1).alias("added"))
    fields = t.clock().groupBy("u", "i").agg(F.count_if(F.col("id") % 5 != 0).alias("n"))
    state = F.when(~F.col("added"), "NOT_ADDED").when(F.col("n") == 0, "FIELD_MISSING").when(F.col("n") > 1, "FIELD_TWICE").otherwise("OK")
    return judged.join(fields, ["u", "i"]).select("u", "i", state.alias("state"))


@query(f"with {SUP}, k as (select u, i, count_if(id % 4 = 0) base, string_agg(id::varchar, ',' order by id) filter (id % 4 = 1) added, count_if(id % 4 > 1)::bigint refused from su group by u, i) select u, i, case when base > 0 then 'BASE' when added is not null then 'ADDED' else 'LEFT_OUT' end state, case when base = 0 then added end added, refused from k")
def keep_only_merge(t):
    """Ordinals of the baseline stay; others come in with the candidates judged KEEP, never with those judged NO or
    UNKNOWN, which are counted."""
    role = F.col("id") % 4
    x = _supports(t).groupBy("u", "i").agg(F.count_if(role == 0).alias("base"), F.sort_array(F.collect_list(F.when(role == 1, F.col("id")))).alias("ids"), F.count_if(role > 1).alias("refused"))
    added = F.array_join(F.transform("ids", lambda v: v.cast("string")), ",")
    state = F.when(F.col("base") > 0, "BASE").when(F.size("ids") > 0, "ADDED").otherwise("LEFT_OUT")
    return x.select("u", "i", state.alias("state"), F.when((F.col("base") == 0) & (F.size("ids") > 0), added).alias("added"), "refused")


@query("with v as (select distinct event_type arm, sha256(user_id || ':' || (event_id % 3)) k from events where event_type in ('click', 'view')), p as (select k, count(*) n from v group by k) select count(*) views, count_if(n = 2)::bigint shared, count_if(n = 1)::bigint own from p")
def shared_view_budget(t):
    v = t.events.where("event_type in ('click', 'view')").select("event_type", F.sha2(F.concat_ws(":", "user_id", F.col("event_id") % 3), 256).alias("k")).distinct()
    return v.groupBy("k").agg(F.count("*").alias("n")).agg(F.count("*").alias("views"), F.count_if(F.col("n") == 2).alias("shared"), F.count_if(F.col("n") == 1).alias("own"))


@query("with c as (select user_id u, count(*) n, max_by(event_id, value) worst from events group by 1) select u, case when n >= 2 then worst end p2, case when n >= 3 then worst end p3, case when n = 2 then worst end only2 from c")
def policy_delete(t):
    # Of equal values the lowest id is the worst, as in SQL over rows by id; nulls on either side are passed over.
    at = F.when(F.col("event_id").isNotNull() & F.col("value").isNotNull(), F.struct("value", F.bitwise_not("event_id")))
    c = t.events.groupBy(F.col("user_id").alias("u")).agg(F.count("*").alias("n"), F.max_by("event_id", at).alias("w"))
    w, n = F.col("w"), F.col("n")
    return c.select("u", F.when(n >= 2, w).alias("p2"), F.when(n >= 3, w).alias("p3"), F.when(n == 2, w).alias("only2"))


@query("with k as (select user_id u, event_id, value > 90 ok from events), g as (select u, bool_or(ok) has from k group by 1) select u, event_id, not has restored from k join g using (u) where ok or not has")
def empty_guard(t):
    x = t.events.select(F.col("user_id").alias("u"), "event_id", (F.col("value") > 90).alias("ok"))
    # Only a flag for each key meets the rows; nothing is gathered.
    has = x.groupBy("u").agg(F.bool_or("ok").alias("has"))
    return x.join(has, "u").where("ok or not has").select("u", "event_id", (~F.col("has")).alias("restored"))
