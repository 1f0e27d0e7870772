"""Scans, sinks, validation and column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..functions import json_tape
from ..functions import text as tx
from ..operators.ordered import ordinals, previous
from ..operators.sampling import percentiles
from ..sources import archive, delimited, jsonl, lines
from ..sources.manifest import manifest_audit, stem_index
from ..sources.shared import shared_path
from .registry import BOX, CELL_TICKS, CLOCK, EV, query

EVENT = "event_id long, event_type string, user_id long, value double"


@query("select event_id, event_type, user_id, value from events")
def scan_json_roundtrip(t):
    path = shared_path(t.spark, "scan")
    t.events.select(*[x.split()[0] for x in EVENT.split(", ")]).write.json(path)
    return jsonl.scan(t.spark, path, EVENT)


@query("select o_orderkey, o_orderstatus, o_custkey from orders")
def sink_json_roundtrip(t):
    path = shared_path(t.spark, "sink")
    jsonl.write_once(t.orders.select("o_orderstatus", "o_orderkey", "o_custkey"), path)
    return jsonl.scan(t.spark, path, "o_custkey long, o_orderkey long, o_orderstatus string")


def _lines(t):
    n = F.col("event_id")
    line = F.when(n % 7 == 0, " ").when(n % 11 == 0, "{bad").when(n % 13 == 0, "[1]").when(n % 17 == 0, '{"a":1,"a":2}').when(n % 19 == 0, '{"a":NaN}').otherwise(F.col("props"))
    return t.events.select("event_id", line.alias("line"))


CODES = "case when event_id % 7 = 0 then 'BLANK_LINE' when event_id % 11 = 0 then 'JSON_PARSE' when event_id % 13 = 0 then 'ROW_SHAPE'"


@query(f"with c as (select {CODES} when event_id % 17 = 0 then 'JSON_PARSE' when event_id % 19 = 0 then 'JSON_PARSE' else 'OK' end issue from events) select issue, count(*) n from c group by 1")
def scan_issue_codes(t):
    """What a tolerant scan says of every line; repeated keys and bare NaN do not parse."""
    x = _lines(t)
    return x.groupBy(F.coalesce(jsonl.issue(F.col("line")), F.lit("OK")).alias("issue")).agg(F.count("*").alias("n"))


@query(f"select event_id, {CODES} when event_id % 17 = 0 then 'DUPLICATE_KEY' when event_id % 19 = 0 then 'CONSTANT' end issue from events")
def json_strict(t):
    return _lines(t).select("event_id", jsonl.strict_issue(F.col("line")).alias("issue"))


#: Ends of lines that begin with `{"id":<event_id>,`, and their issue, fault, and the byte of the fault in the end.
FAULTY = (
    ('"a":1}', None, None, None),
    ("'a':1}", "JSON_PARSE", "LITERAL", 0),
    ('"a":"x\ty"}', "JSON_PARSE", "CONTROL", 6),
    ('"a":1}}', "JSON_PARSE", "TRAILING", 6),
    ('"a":1} {"b":2}', "JSON_PARSE", "TRAILING", 7),
    ('"a":1e400}', "OVERFLOW", "OVERFLOW", 4),
    ('"a":[NaN]}', "CONSTANT", "CONSTANT", 5),
    (r'"a":1,"\u0061":2}', "DUPLICATE_KEY", "DUPLICATE_KEY", 6),
    ('"a":{"b":[{"c":1,"c":1}]}}', "DUPLICATE_KEY", "DUPLICATE_KEY", 17),
    ('"a":{"c":1},"b":{"c":1}}', None, None, None),
    ('"a":[1,2}', "JSON_PARSE", "BRACKET", 8),
    ('"a":1,}', "JSON_PARSE", "GRAMMAR", 6),
    ('"a":01}', "JSON_PARSE", "LITERAL", 4),
    (r'"a":"\x"}', "JSON_PARSE", "ESCAPE", 5),
    ('"a":"open}', "JSON_PARSE", "QUOTE", 4),
    (r'"a":"\"}{][,:\\"}', None, None, None),
)


def _quoted(text):
    return "'" + text.replace("'", "''") + "'"


def _faulty(t):
    ends = F.array(*[F.lit(x[0]) for x in FAULTY])
    n = F.col("event_id")
    return t.events.select("event_id", F.concat(F.lit('{"id":'), n, F.lit(","), F.element_at(ends, (n % len(FAULTY) + 1).cast("int"))).alias("line"))


_WANTED = ", ".join(f"({i}, {_quoted(e)}, {', '.join('null' if v is None else _quoted(v) for v in x[:2])}, {'null' if x[2] is None else x[2]})" for i, (e, *x) in enumerate(FAULTY))
WANTED = f"w as (select * from (values {_WANTED}) w(i, ending, issue, fault, byte)), fl as (select event_id, '{{\"id\":' || event_id || ',' || ending line, issue, fault, (byte + 7 + len(event_id::varchar))::bigint as byte_at from events join w on i = event_id % {len(FAULTY)})"


@query(f"with {WANTED} select event_id, issue, fault, byte_at from fl")
def json_faults(t):
    """Every fault of strict JSON by name, and the byte where it lies."""
    x = _faulty(t).withColumn("r", json_tape.report("line"))
    return x.select("event_id", "r.issue", "r.fault", F.col("r.at").alias("byte_at"))


@query(f"with {WANTED} select coalesce(issue, 'RECORD') issue, fault, count(*) n, sum(len(line) + 1)::bigint bytes, sum(event_id)::bigint ids, true as placed from fl group by 1, 2")
def scan_tolerant_lines(t):
    """Files of lines with all faults, read back in small byte ranges: every line once, with its issue and its byte."""
    path = shared_path(t.spark, "lines")
    _faulty(t).select("line").repartition(3).write.text(path)
    x = lines.scan(t.spark, path, 10_000)
    at = F.regexp_extract("line", r'^\{"id":(\d+),', 1).cast("long")
    x = x.select("file", "first", F.octet_length("line").alias("size"), at.alias("id"), "issue", "fault")
    x = lines.numbered(x).withColumn("end", F.col("first") + F.col("size") + 1)
    # A file's lines follow each other without a gap.
    ends = x.select("file", (F.col("number") + 1).alias("number"), F.col("end").alias("before"))
    x = x.join(ends, ["file", "number"], "left").withColumn("placed", F.col("first") == F.coalesce("before", F.lit(0)))
    return x.groupBy(F.coalesce("issue", F.lit("RECORD")).alias("issue"), "fault").agg(F.count("*").alias("n"), F.sum(F.col("size") + 1).alias("bytes"), F.sum("id").alias("ids"), F.bool_and("placed").alias("placed"))


@query("""select event_id, case event_id % 6 when 1 then 'DUPLICATE_KEY' when 3 then 'DUPLICATE_KEY' when 4 then 'JSON_PARSE' when 5 then 'CONSTANT' end issue from events""")
def json_strict_nested(t):
    """Keys count inside their own object: two objects may share a key; a repeat at any depth is an issue."""
    lines = ['{"a":{"x":1},"b":{"x":2}}', '{"a":{"x":1,"x":2}}', '[{"a":1},{"a":2}]', '[{"a":[{"b":1,"b":1}]}]', '{"a":{"x":1}', '{"a":[1,{"b":-Infinity}]}']
    n = F.col("event_id") % 6
    line = F.element_at(F.array(*map(F.lit, lines)), (n + 1).cast("int"))
    return t.events.select("event_id", jsonl.strict_issue(line, rows_only=False).alias("issue"))


@query("select event_id, round(value, 2)::decimal(20, 2) amount from events")
def json_decimal(t):
    """Numbers of JSON text as exact decimals, never by way of a double."""
    line = F.concat(F.lit('{"amount":'), F.round("value", 2).cast("decimal(20,2)").cast("string"), F.lit("}"))
    return t.events.select("event_id", F.variant_get(F.parse_json(line), "$.amount", "decimal(20,2)").alias("amount"))


@query("select n_regionkey doc, n_nationkey id, n_name as name from nation")
def json_root_shapes(t):
    """Records under `records`, as a bare list, and as an id -> object mapping."""
    row = F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    docs = t.nation.groupBy(F.col("n_regionkey").alias("doc")).agg(F.sort_array(F.collect_list(row)).alias("r"))
    listed, mapped = F.to_json("r"), F.to_json(F.map_from_entries(F.transform("r", lambda x: F.struct(x["id"].cast("string"), x))))
    text = F.when(F.col("doc") % 3 == 0, F.to_json(F.struct(F.col("r").alias("records")))).when(F.col("doc") % 3 == 1, listed).otherwise(mapped)
    return tx.root_rows(docs.select("doc", text.alias("text")), "id int, name string").select("doc", "id", "name")


@query("select l_orderkey doc, l_linenumber frame, min(l_partkey) % 400 x from lineitem group by 1, 2")
def nested_frames(t):
    """Frames of JSON documents, as a mapping by frame or a list, under either name of a key."""
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("f")).agg((F.min("l_partkey") % 400).alias("x"))
    rows = x.groupBy("doc").agg(F.sort_array(F.collect_list(F.struct("f", "x"))).alias("r"))  # an order's few lines
    listed = F.to_json(F.struct(F.transform("r", lambda r: F.struct(r["f"].alias("frame_id"), F.struct(r["x"].alias("x")).alias("box"))).alias("frames")))
    mapped = F.to_json(F.struct(F.map_from_entries(F.transform("r", lambda r: F.struct(r["f"].cast("string"), F.struct(F.struct(r["x"].alias("x")).alias("bbox"))))).alias("frames")))
    text = F.when(F.col("doc") % 2 == 0, listed).otherwise(mapped)
    return tx.frame_rows(rows.select("doc", text.alias("text")), "x long").select("doc", "frame", "box.x")


@query("select event_id, event_type, user_id, value, props from events")
def scan_csv_roundtrip(t):
    """Tab-separated files with a header, quoted where a value holds quotes or tabs."""
    path = shared_path(t.spark, "csv")
    delimited.write(t.events.select("event_id", "event_type", "user_id", "value", "props"), path)
    return delimited.scan(t.spark, path, "event_id long, event_type string, user_id long, value double, props string")


@query("select event_type as kind, 'json' suffix, true as stemmed from events group by 1")
def directory_stems(t):
    """A folder's files by stem, up to the last dot of a name, and suffix, for the folder of each kind."""
    path = shared_path(t.spark, "stems")
    t.events.select("event_id", "event_type").write.partitionBy("event_type").json(path)
    x = stem_index(t.spark, path).where("suffix = 'json'")
    # Spark names its files part-<task>-<uuid>.c<number>.json.
    stemmed = F.col("stem").rlike(r"^part-[0-9a-f-]+\.c\d+$")
    return x.groupBy(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("kind"), "suffix").agg(F.bool_and(stemmed).alias("stemmed"))


@query("select o_orderkey % 50 member, count(*) n from orders group by 1")
def archive_roundtrip(t):
    """Members of deterministic ZIP packages: written, read back, their lines counted."""
    path = shared_path(t.spark, "zip")
    x = t.orders.select((F.col("o_orderkey") % 50).alias("member"), F.to_json(F.struct("o_orderkey", "o_orderstatus")).alias("line"))
    archive.write_packages(x, path, "member", "line", packages=50)
    found = archive.members(t.spark, path).select(F.regexp_extract("member", r"^(\d+)\.jsonl$", 1).cast("long").alias("member"), F.split(F.decode("content", "utf-8"), "\n").alias("lines"))
    return found.select("member", (F.size("lines") - 1).cast("long").alias("n"))


@query("select i, count(*) n, sum(x)::bigint total from (select unnest([user_id, event_id % 5, event_id % 3]) x, unnest([0, 1, 2]) i from events) group by i")
def split_explode_scores(t):
    cell = F.concat_ws(",", "user_id", F.col("event_id") % 5, F.col("event_id") % 3)
    x = t.events.select(F.posexplode(F.split(cell, ",")).alias("i", "x"))
    return x.groupBy("i").agg(F.count("*").alias("n"), F.sum(F.col("x").cast("long")).alias("total"))


@query("""select event_id, case when event_id % 10 = 0 then '{"k":' || (props->>'$.k')::int || ',"seen":true}' else props end line from events""")
def byte_preserving_merge(t):
    new = F.to_json(F.struct(F.get_json_object("props", "$.k").cast("int").alias("k"), F.lit(True).alias("seen")))
    return t.events.select("event_id", F.when(F.col("event_id") % 10 == 0, new).otherwise(F.col("props")).alias("line"))


ITEMS = "it as (select l_orderkey o, l_linenumber f, min(l_partkey) p, max(l_partkey) q from lineitem group by 1, 2)"


@query(f"""with {ITEMS}, al as (
  select o, f, f % 2 = 1 old, case when f % 2 = 1 and f <> 5 then '{{ "frame":' || f || ',\t"box" : [' || p || ' ,1 ] }}' else '{{"frame":' || f || ',"box":[' || q || ']}}' end body,
    min(case when f % 2 = 1 then f end) over (partition by o) head from it where f % 2 = 1 or f < 6
), tx as (select o, string_agg(case when f = (select min(f) from al b where b.o = al.o) then '' when old and f <> head then ' , ' else ',' end || body, '' order by f) body from al group by o)
select it.o, '{{ "id" :' || it.o || ' ,"predictions": [' || case when head is null then coalesce(body, '') || ' ' else ' ' || body end || ' ], "ratio":[9 ,16]}}\t' line
from (select o, min(case when f % 2 = 1 then f end) head from it group by 1) it left join tx using (o)""")
def json_splice(t):
    """Elements put into an array of a document, or in place of those of the same key: all other bytes stay as they are,
    whatever their spacing."""
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("f")).agg(F.min("l_partkey").alias("p"), F.max("l_partkey").alias("q"))
    old = F.concat(F.lit('{ "frame":'), F.col("f"), F.lit(',\t"box" : ['), F.col("p"), F.lit(" ,1 ] }"))
    new = F.concat(F.lit('{"frame":'), F.col("f"), F.lit(',"box":['), F.col("q"), F.lit("]}"))
    added = (F.col("f") % 2 == 0) & (F.col("f") < 6) | (F.col("f") == 5)
    x = x.select("o", F.when(F.col("f") % 2 == 1, F.struct("f", old.alias("text"))).alias("old"), F.when(added, F.struct(F.col("f").cast("long").alias("key"), new.alias("text"))).alias("new"))
    x = x.groupBy("o").agg(F.sort_array(F.collect_list("old")).alias("old"), F.collect_list("new").alias("new"))  # an order's few lines
    line = F.concat(F.lit('{ "id" :'), F.col("o"), F.lit(' ,"predictions": [ '), F.array_join(F.col("old.text"), " , "), F.lit(' ], "ratio":[9 ,16]}\t'))
    return json_tape.merge_items(x.select("o", "new", line.alias("doc")), "doc", "/predictions", "frame", "new", "line").select("o", "line")


@query("""with m as (select page_id, octet_length(html::blob) size, case when page_id % 9 = 0 then 'x' else sha256(html) end sha from pages where page_id % 7 <> 0), f as (select page_id, octet_length(html::blob) size, sha256(html) sha from pages where page_id % 11 <> 0)
select coalesce(m.page_id, f.page_id) page_id, case when f.page_id is null then 'MISSING' when m.page_id is null then 'EXTRA' when m.sha <> f.sha then 'HASH' else 'OK' end state from m full join f using (page_id)""")
def manifest_verify(t):
    found = t.pages.where("page_id % 11 <> 0").select("page_id", F.octet_length("html").alias("size"), F.sha2("html", 256).alias("sha"))
    listed = t.pages.where("page_id % 7 <> 0").select("page_id", F.octet_length("html").alias("size"), F.when(F.col("page_id") % 9 == 0, "x").otherwise(F.sha2("html", 256)).alias("sha"))
    return manifest_audit(listed, found, "page_id")


@query(r"select doc_id from documents where regexp_matches(text, '(?i)(api[_-]?key|token|passwd|password)[\x22\x27]?\s*[:=]')")
def regex_secret_scan(t):
    return t.documents.where(F.col("text").rlike(r"(?i)(api[_-]?key|token|passwd|password)[\x22\x27]?\s*[:=]")).select("doc_id")


@query(r"select page_id, regexp_matches(lower(url), '\.(?:env|pem|key|sqlite|exe)$') or url like '%/7' as forbidden from pages")
def forbidden_suffix_scan(t):
    """Names that end in a suffix of the list."""
    return t.pages.select("page_id", tx.has_suffix(F.col("url"), (".env", ".pem", ".key", ".sqlite", ".exe", "/7")).alias("forbidden"))


@query("select c_custkey, c_nationkey from customer")
def project_identity(t):
    return t.customer.select("c_custkey", "c_nationkey")


@query("select event_id, coalesce(case when event_id % 3 = 0 then value end, case when event_id % 3 = 1 then value * 2 end, -1.0) v from events")
def coalesce_alias(t):
    n = F.col("event_id") % 3
    return t.events.select("event_id", F.coalesce(F.when(n == 0, F.col("value")), F.when(n == 1, F.col("value") * 2), F.lit(-1.0)).alias("v"))


SHIP = "select l_orderkey, l_linenumber, epoch_us(o_orderdate) s, epoch_us(l_shipdate) e, l_quantity, l_discount from lineitem join orders on l_orderkey = o_orderkey"


def _ship(t):
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", us("o_orderdate").alias("s"), us("l_shipdate").alias("e"), "l_quantity", "l_discount")


@query(f"with x as ({SHIP}) select case when e < s then 'REVERSED' when e = s then 'EMPTY' when e > s + 7776000000000 then 'TOO_LONG' else 'OK' end code, count(*) n from x group by 1")
def interval_validate(t):
    code = F.when(F.col("e") < F.col("s"), "REVERSED").when(F.col("e") == F.col("s"), "EMPTY").when(F.col("e") > F.col("s") + 7_776_000_000_000, "TOO_LONG").otherwise("OK")
    return _ship(t).groupBy(code.alias("code")).agg(F.count("*").alias("n"))


@query(f"with x as ({SHIP}), c as (select l_orderkey, l_linenumber, concat_ws(',', case when e <= s then 'ORDER' end, case when l_quantity > 45 then 'QUANTITY' end, case when l_discount >= 0.09 then 'DISCOUNT' end) codes from x) select codes, count(*) n, min(l_orderkey) first from c group by codes")
def row_issue_codes(t):
    codes = F.array_compact(F.array(F.when(F.col("e") <= F.col("s"), "ORDER"), F.when(F.col("l_quantity") > 45, "QUANTITY"), F.when(F.col("l_discount") >= 0.09, "DISCOUNT")))
    return _ship(t).groupBy(F.array_join(codes, ",").alias("codes")).agg(F.count("*").alias("n"), F.min("l_orderkey").alias("first"))


@query(f"with {BOX} select flag, count(*) n, count_if(x + w <= 640 and y * 16 + w * 9 <= 360 * 16)::bigint legal from bx group by flag")
def box_legal(t):
    ok = geo.legal(F.struct("x", "y", "w"), F.lit(640), F.lit(360), 16, 9)
    return t.boxes().groupBy("flag").agg(F.count("*").alias("n"), F.count_if(ok).alias("legal"))


SIZES = "sz as (select p_partkey p, p_size * 20 + 100 w, p_partkey % 300 + 100 h from part), cw as (select *, least(w, h * 9 // 16)::bigint cw from sz)"


def _sizes(t):
    x = t.part.select(F.col("p_partkey").alias("p"), (F.col("p_size") * 20 + 100).cast("long").alias("w"), (F.col("p_partkey") % 300 + 100).alias("h"))
    return x.withColumn("cw", geo.crop_width(F.col("w"), F.col("h"), 9, 16))


@query(f"with {SIZES} select p, cw from cw")
def crop_width(t):
    return _sizes(t).select("p", "cw")


@query(f"with {SIZES} select p, round_even((w - cw) / 2.0, 0)::bigint x, cw from cw")
def center_crop(t):
    return _sizes(t).select("p", geo.half_even(F.col("w") - F.col("cw"), F.lit(2)).alias("x"), "cw")


def _answers(t):
    n = F.col("event_id")
    fence = F.lit('```json\n{"segments":[[0,3]]}\n```')
    text = F.when(n % 6 == 0, '{"segments":[]}').when(n % 6 == 1, F.concat(F.lit('{"segments":[[1.5,2.5],[4,'), n % 50 + 5, F.lit("]]}"))).when(n % 6 == 2, fence).when(n % 6 == 3, '{"segments":[[5,2]]}').when(n % 6 == 4, "no answer").otherwise('{"segments":[[-1,2]]}')
    return t.events.select("event_id", text.alias("text"))


@query("""select event_id, case event_id % 6 when 0 then 'VALID_EMPTY' when 1 then 'VALID_NONEMPTY' when 2 then 'VALID_NONEMPTY' else 'INVALID' end state,
case event_id % 6 when 3 then 'REVERSED' when 4 then 'PARSE' when 5 then 'NEGATIVE' end reason, case event_id % 6 when 1 then 2 when 2 then 1 else 0 end n from events""")
def parse_three_state(t):
    return tx.three_state(_answers(t), "text").select("event_id", "state", "reason", "n")


@query("""select event_id, case event_id % 3 when 0 then 'NONE' when 1 then 'FOUND' else 'AMBIGUOUS' end state, case when event_id % 3 = 1 then '{"segments":[[1,2]]}' end body from events""")
def parse_regex_fallback(t):
    one = '{"segments":[[1,2]]}'
    text = F.when(F.col("event_id") % 3 == 0, "nothing").when(F.col("event_id") % 3 == 1, f"Sure: {one} ok").otherwise(f"{one} or {one}")
    return t.events.select("event_id", text.alias("text")).select("event_id", *tx.only_object(F.col("text")))


@query("""select event_id, case event_id % 6 when 0 then '{"segments":[]}' when 1 then '{"segments":[[1.5,2.5],[4,' || (event_id % 50 + 5) || ']]}' when 2 then '{"segments":[[0,3]]}' when 3 then '{"segments":[[5,2]]}' when 4 then 'no answer' else '{"segments":[[-1,2]]}' end body from events""")
def strip_fence(t):
    """Fences go, whatever has none stays as it is."""
    return _answers(t).select("event_id", tx.strip_fence(F.col("text")).alias("body"))


@query("select n, count(*) orders, n > 6 as violation from (select l_orderkey, count(*) n from lineitem group by 1) group by n")
def cardinality_audit(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("orders")).withColumn("violation", F.col("n") > 6)


@query(f"""with {CLOCK}, b as (select u, min(s) lo, max(s) hi, count(*) n from ck group by u), d as (select ck.u, s - lag(s) over (partition by ck.u order by i) d, abs((s - lo) * (n - 1) - i * (hi - lo)) r from ck join b using (u)),
g as (select b.u, n, coalesce(bool_and(d > 0), true) increasing, median(d)::double mid, max(d) longest, round(max(r)::double / nullif(n - 1, 0)) residual from d join b using (u) group by b.u, n)
select u, n, increasing, mid, longest, residual, case when n < 2 then 'MISSING_PTS' when not increasing then 'NOT_INCREASING' when residual > mid then 'RESIDUAL' end reason from g""")
def clock_audit(t):
    """A clock passes if it rises strictly and no point lies further than a median step from its index at the mean
    rate (residual); reason says why not."""
    x = t.intervals().select("u", "s", "id")
    ends = x.groupBy("u").agg(F.min("s").alias("lo"), F.max("s").alias("hi"), F.count("*").alias("n"))
    rows = previous(ordinals(x, ["u"], ["s", "id"], CELL_TICKS), ["u"], ["s", "id"], ["s"], CELL_TICKS).join(ends, "u")
    rows = rows.select("u", "n", (F.col("s") - F.col("prev_s")).alias("d"), F.abs((F.col("s") - F.col("lo")) * (F.col("n") - 1) - F.col("i") * (F.col("hi") - F.col("lo"))).alias("r"))
    far = F.round(F.try_divide(F.max("r").cast("double"), (F.col("n") - 1).cast("double")))
    out = rows.groupBy("u", "n").agg(F.coalesce(F.bool_and(F.col("d") > 0), F.lit(True)).alias("increasing"), F.max("d").alias("longest"), far.alias("residual"))
    out = out.join(percentiles(rows.select("u", "d"), ["u"], "d", mid=("linear", 0.5)), "u", "left")
    reason = F.when(F.col("n") < 2, "MISSING_PTS").when(~F.col("increasing"), "NOT_INCREASING").when(F.col("residual") > F.col("mid"), "RESIDUAL")
    return out.withColumn("reason", reason)


FACTS = "fx as (select source, quality q, doc_id % 3 <> 0 base, doc_id % 5 <> 0 cand from documents left join labels using (doc_id))"
VETO = f"{FACTS}, ve as (select source, count_if(q = 1 and base and not cand)::bigint lost_keep, count_if(q = 0 and cand and not base)::bigint added_ordinary, count_if(q is null and cand and not base)::bigint added_unknown from fx group by 1)"


def _veto(t):
    x = t.documents.join(t.labels, "doc_id", "left").select("source", F.col("quality").alias("q"), (F.col("doc_id") % 3 != 0).alias("base"), (F.col("doc_id") % 5 != 0).alias("cand"))
    lost, new = F.col("base") & ~F.col("cand"), F.col("cand") & ~F.col("base")
    return x.groupBy("source").agg(F.count_if((F.col("q") == 1) & lost).alias("lost_keep"), F.count_if((F.col("q") == 0) & new).alias("added_ordinary"), F.count_if(F.col("q").isNull() & new).alias("added_unknown"))


@query(f"with {VETO} select *, lost_keep > 0 or added_ordinary > 0 as veto from ve")
def fact_veto(t):
    return _veto(t).withColumn("veto", (F.col("lost_keep") > 0) | (F.col("added_ordinary") > 0))


@query(f"with {VETO}, g as (select sum(lost_keep) a, sum(added_ordinary) b, sum(added_unknown) c from ve) select unnest(['no_lost_keep', 'few_ordinary', 'some_unknown', 'all']) as check_, unnest([a = 0, b <= 10, c > 0, a = 0 and b <= 10 and c > 0]) passed from g")
def gate_checks(t):
    g = _veto(t).agg(F.sum("lost_keep").alias("a"), F.sum("added_ordinary").alias("b"), F.sum("added_unknown").alias("c"))
    return g.selectExpr("stack(4, 'no_lost_keep', a = 0, 'few_ordinary', b <= 10, 'some_unknown', c > 0, 'all', a = 0 and b <= 10 and c > 0) as (check_, passed)")


@query("select event_type, unnest(json_keys(props)) as key, count(*) n from events group by 1, 2")
def schema_census(t):
    x = json_tape.census(t.events, "props", "event_type").where(F.col("path").rlike("^/[^/]*$"))
    return x.groupBy(F.col("section").alias("event_type"), F.substring("path", 2, 1 << 30).alias("key")).agg(F.sum("n").alias("n"))


@query("""with x as (select event_type as section, event_id, (props->>'$.k')::int k from events semi join labels on event_id = doc_id)
select section, path, kind, value, count(*) n from (
  select section, unnest(['', '/user', '/user/kind', '/user/id', '/tags', '/tags/*', '/tags/*', '/tags/*/n', '/a~1b', '/user/old']) path, unnest(['object', 'object', 'string', 'number', 'array', 'string', 'object', 'number', 'boolean', 'null']) kind,
    unnest([null, null, '"' || section || '"', null, null, null, null, (k % 3)::varchar, null, null]) as value, unnest([true, true, true, true, true, true, true, true, k % 2 = 0, k % 5 = 0]) has from x
) where has group by all""")
def schema_census_nested(t):
    """Paths at any depth, their kinds, and the values of two listed scalars, in the rows of an allow-list: the others
    hold text that is no JSON, and are never read."""
    k = F.get_json_object("props", "$.k").cast("int")
    part = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    text = part('{"user":{"kind":"', F.col("event_type"), '", "id" :', F.col("event_id"), F.when(k % 5 == 0, ',"old":null').otherwise(""), '},"tags":["x{", {"n":', k % 3, "}]", F.when(k % 2 == 0, ',"a/b":true').otherwise(""), "}")
    listed = t.labels.select("doc_id")
    x = t.events.join(listed, F.col("event_id") == F.col("doc_id"), "left").select("event_id", "event_type", F.when(F.col("doc_id").isNull(), "{broken").otherwise(text).alias("line"))
    x = x.join(listed, F.col("event_id") == F.col("doc_id"), "left_semi")
    return json_tape.census(x, "line", "event_type", ["/user/kind", "/tags/*/n"])


@query("select case when n_chars < 50 then 'SHORT' when lang <> 'en' then 'LANG' when quality is null then 'UNLABELLED' when toxic = 1 then 'TOXIC' when quality = 0 then 'LOW' else 'KEPT' end reason, count(*) n from documents left join labels using (doc_id) group by 1")
def reject_waterfall(t):
    why = F.when(F.col("n_chars") < 50, "SHORT").when(F.col("lang") != "en", "LANG").when(F.col("quality").isNull(), "UNLABELLED").when(F.col("toxic") == 1, "TOXIC").when(F.col("quality") == 0, "LOW").otherwise("KEPT")
    return t.documents.join(t.labels, "doc_id", "left").groupBy(why.alias("reason")).agg(F.count("*").alias("n"))


@query("select event_id, event_id % 10 = 0 or event_id % 4 = 0 as forbidden from events")
def json_forbidden_keys(t):
    n = F.col("event_id")
    text = F.when(n % 10 == 0, '{"a":{"b":[{"answer":1}]}}').when(n % 4 == 0, '{"x":1,"score" : 2}').otherwise('{"a":"answer\\":","b":[1,{"c":"score"}]}')
    return t.events.select("event_id", tx.has_keys(text, ("answer", "score")).alias("forbidden"))


@query(r"""select event_id, case event_id % 5 when 0 then true when 1 then true when 2 then false when 3 then false end forbidden from events""")
def json_forbidden_escaped(t):
    """Keys written with escapes are the keys they stand for; text that is no JSON has no verdict."""
    texts = [r'{"a":[{"\u0061nswer":1}]}', r'{"x":{"y":{"scor\u0065" : 2}}}', r'{"a":"\"answer\":","b":["answer"]}', r'{"\\u0061nswer":1}', '{"answer":1']
    line = F.element_at(F.array(*map(F.lit, texts)), (F.col("event_id") % 5 + 1).cast("int"))
    return t.events.select("event_id", tx.has_keys(line, ("answer", "score")).alias("forbidden"))


# Column functions ----------------------------------------------------------------------------------------------------


@query("select l_orderkey, l_linenumber, round_even(l_quantity / 4, 0)::bigint q from lineitem")
def fn_bround(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", F.bround(F.col("l_quantity") / 4).cast("long").alias("q"))


@query(f"with {EV} select id, ceil((s % 86400000000) / 8000000.0 - 1e-9)::bigint up, ((s % 86400000000) // 7)::bigint down, least(greatest(floor(v), 10), 90)::bigint held from ev")
def fn_ceil_eps(t):
    d = F.col("s") % 86_400_000_000
    return t.intervals().select("id", F.ceil(d / 8_000_000 - 1e-9).alias("up"), F.expr("(s % 86400000000) div 7").alias("down"), F.least(F.greatest(F.floor("v"), F.lit(10)), F.lit(90)).alias("held"))


@query("select event_id, event_id % 9 <> 0 and event_id % 11 <> 0 finite from events")
def fn_finite(t):
    v = F.when(F.col("event_id") % 9 == 0, F.lit(float("nan"))).when(F.col("event_id") % 11 == 0, F.lit(float("inf"))).otherwise(F.col("value"))
    return t.events.select("event_id", tx.finite(v).alias("finite"))


PAIR = f"{BOX}, ib as (select o, f, p, x, y, w, (x * 7 + 13) % 400 x2, (y * 3 + 5) % 200 y2, w + 8 w2 from bx), ov as (select *, greatest(0, least(x + w, x2 + w2) - greatest(x, x2)) * greatest(0, least(y * 16 + w * 9, y2 * 16 + w2 * 9) - greatest(y * 16, y2 * 16)) n from ib)"


def _pairs(t):
    b = t.boxes()
    return b.select("o", "f", "p", F.struct("x", "y", "w").alias("a"), F.struct(((F.col("x") * 7 + 13) % 400).alias("x"), ((F.col("y") * 3 + 5) % 200).alias("y"), (F.col("w") + 8).alias("w")).alias("b"))


@query(f"with {PAIR} select o, f, p, n::bigint num, (9 * w * w + 9 * w2 * w2 - n)::bigint den from ov")
def fn_iou_exact(t):
    inter, union = geo.overlap_parts(F.col("a"), F.col("b"), 16, 9)
    return _pairs(t).select("o", "f", "p", inter.alias("num"), union.alias("den"))


@query(f"with {PAIR} select o, f, p, n::double / (9 * w * w + 9 * w2 * w2 - n) iou from ov")
def fn_iou(t):
    return _pairs(t).select("o", "f", "p", geo.iou_ratio(F.col("a"), F.col("b"), 16, 9).alias("iou"))


@query(f"with {BOX} select o, f, p, round_even(x / 1000.0 * 640, 0)::bigint px, round_even(y / 1000.0 * 360, 0)::bigint py, round_even((x + w) / 1000.0 * 640, 0)::bigint - round_even(x / 1000.0 * 640, 0)::bigint pw from bx")
def fn_bbox_convert(t):
    px = lambda c, n: F.bround(c / 1000.0 * n).cast("long")
    return t.boxes().select("o", "f", "p", px(F.col("x"), 640).alias("px"), px(F.col("y"), 360).alias("py"), (px(F.col("x") + F.col("w"), 640) - px(F.col("x"), 640)).alias("pw"))


@query(f"with {BOX} select o, f, p, x / 1000.0::double cx, y / 1000.0::double cy from bx")
def fn_center_norm(t):
    return t.boxes().select("o", "f", "p", (F.col("x") / 1000.0).alias("cx"), (F.col("y") / 1000.0).alias("cy"))


@query(r"select doc_id, trim(regexp_replace(nfc_normalize(text), '[\s]+', ' ', 'g'), ' ') body from documents")
def fn_ws_collapse(t):
    """White space becomes one space, in composed form (NFC)."""
    return t.documents.select("doc_id", F.trim(F.regexp_replace(tx.nfc(F.col("text")), r"\s+", " ")).alias("body"))


@query("select event_id, nfc_normalize(case event_id % 3 when 0 then 'cafe' || chr(769) when 1 then 'A' || chr(778) || chr(803) else 'plain' end) body from events")
def fn_nfc(t):
    text = F.when(F.col("event_id") % 3 == 0, "cafe\u0301").when(F.col("event_id") % 3 == 1, "A\u030a\u0323").otherwise("plain")
    return t.events.select("event_id", tx.nfc(text).alias("body"))


@query("select c_custkey, replace(lower(c_mktsegment || ' ' || c_name), ' ', '_') alias from customer")
def fn_alias_norm(t):
    return t.customer.select("c_custkey", tx.alias(F.concat_ws(" ", "c_mktsegment", "c_name")).alias("alias"))


@query("select event_id, 'v' || user_id || '_x' as grp from events")
def fn_source_group(t):
    name = F.concat(F.lit("v"), "user_id", F.lit("_x_"), F.col("event_id") % 7, F.lit("_"), F.col("event_id") % 3)
    return t.events.select("event_id", F.regexp_extract(name, r"^(.*)_[^_]*_[^_]*$", 1).alias("grp"))


@query("select c_custkey, regexp_full_match(c_name, '[A-Za-z0-9_.-]{1,64}') safe from customer")
def fn_safe_id(t):
    return t.customer.select("c_custkey", F.col("c_name").rlike(r"^[A-Za-z0-9_.-]{1,64}\z").alias("safe"))


@query("""select o_orderkey, sha256('{"custkey":' || o_custkey || ',"key":' || o_orderkey || ',"status":"' || o_orderstatus || '"}') sha from orders""")
def fn_canonical_sha(t):
    row = F.struct(F.col("o_custkey").alias("custkey"), F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status"))
    return t.orders.select("o_orderkey", F.sha2(F.to_json(row), 256).alias("sha"))


@query("select vec_id, list_sort(list_distinct(list_transform(embedding[1:16], lambda x: floor(x * 10)::bigint)))[1:5] low, len(list_filter(embedding, lambda x: x > 0)) positive from embeddings")
def fn_array_hof(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.slice(F.array_sort(F.array_distinct(F.transform(F.slice(e, 1, 16), lambda x: F.floor(x.cast("float") * F.lit(10).cast("float"))))), 1, 5).alias("low"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@query("select c_custkey, c_mktsegment seg, case c_mktsegment when 'BUILDING' then 1 when 'MACHINERY' then 2 else 0 end::int as code from customer")
def fn_map(t):
    codes = F.map_concat(F.create_map(F.lit("BUILDING"), F.lit(1)), F.create_map(F.lit("MACHINERY"), F.lit(2)))
    return t.customer.select("c_custkey", F.col("c_mktsegment").alias("seg"), F.coalesce(F.try_element_at(codes, F.col("c_mktsegment")), F.lit(0)).alias("code"))


@query("select event_id, len(json_keys(props)) = 1 and json_keys(props)[1] = 'k' as exact, (props->>'$.k')::int k from events")
def fn_json_keys(t):
    return t.events.select("event_id", F.json_object_keys("props").eqNullSafe(F.array(F.lit("k"))).alias("exact"), F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("select event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') stamp from events")
def fn_utc_iso(t):
    return t.events.select("event_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("stamp"))


@query("with a as (select l_orderkey k, list_sort(list(l_quantity)) v from lineitem group by 1) select k, (v[(len(v) + 1) // 2] + v[len(v) // 2 + 1]) / 2 mid from a")
def fn_array_median(t):
    """Median of an array: its sorted middle, or the mean of the two."""
    v = F.col("v")
    x = t.lineitem.groupBy(F.col("l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("l_quantity")).alias("v"))  # an order's few lines
    at = lambda i: F.get(v, F.floor(i).cast("int"))
    return x.select("k", ((at((F.size(v) - 1) / 2) + at(F.size(v) / 2)) / 2).alias("mid"))


@query("select case when value < 10 then 'short' when value < 60 then 'medium' else 'long' end bin, count(*) n from events group by 1")
def fn_bins(t):
    return t.events.groupBy(F.when(F.col("value") < 10, "short").when(F.col("value") < 60, "medium").otherwise("long").alias("bin")).agg(F.count("*").alias("n"))
