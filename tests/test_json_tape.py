"""The token tape against the standard parser, byte splices, and the source of lines."""

import io
import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomspan.functions import json_tape as jt
from loomspan.functions.text import has_keys
from loomspan.sources import lines as ls


def parsed_issue(text):
    if not text.strip():
        return "BLANK_LINE"
    repeated, constants, beyond = [], [], []

    def whole(pairs):
        seen = set()
        for k, _ in pairs:
            if k in seen:
                repeated.append(k)
            seen.add(k)
        return dict(pairs)

    def number(x):
        if abs(float(x)) == float("inf"):
            beyond.append(x)
        return float(x)

    try:
        value = json.loads(text, object_pairs_hook=whole, parse_constant=constants.append, parse_float=number, parse_int=number)
    except (ValueError, RecursionError):
        return "JSON_PARSE"
    return "CONSTANT" if constants else "DUPLICATE_KEY" if repeated else "OVERFLOW" if beyond else None if isinstance(value, dict) else "ROW_SHAPE"


SOUND = ["1", "-0.5", "1e5", '"a"', r'"a"', r'"x\"y"', r'"\\"', "true", "null", '""', '"é{}[]:,"']
ODD = ["1e400", "NaN", "-Infinity", "-", "01", '"\t"', r'"\x"', r'"\u12"', "9" * 400]


def written(rng, depth=0):
    gap = lambda: rng.choice(["", "", " ", "\t", "  "])
    kind = rng.random()
    if depth > 3 or kind < 0.35:
        return rng.choice(SOUND + ODD if rng.random() < 0.1 else SOUND)
    inner = [written(rng, depth + 1) for _ in range(rng.randrange(4))]
    if kind < 0.65:
        return "[" + gap() + f"{gap()},{gap()}".join(inner) + gap() + "]"
    return "{" + gap() + f"{gap()},{gap()}".join(f"{rng.choice(['"a"', '"b~/"', r'"a"', '"c"', '"d"', '"e"'])}{gap()}:{x}" for x in inner) + gap() + "}"


def texts(n, seed):
    rng, out = random.Random(seed), []
    for _ in range(n):
        s = written(rng)
        for _ in range(rng.randrange(1, 3) if rng.random() < 0.4 else 0):
            i = rng.randrange(len(s) + 1)
            s = rng.choice([s[:i] + s[i + 1 :], s[:i] + rng.choice('{}[]:,"\\ 1ae') + s[i:], s[:i]])
        out.append(s)
    fixed = ["", " ", " ", '{"a":1}}', '{"a":1} {"b":2}', "{'a':1}", "﻿{}", '{"a":1e400}', "[" * 500 + "]" * 500, "\\", '"', "{}", r"\"a\"", '{"a":"\\', "]", "}{", '{"a" 1}', "[1 2]", "[,]", "{,}"]
    return out + fixed + fixed[::-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_issues_are_those_of_the_parser(seed, monkeypatch):
    lines = texts(6000, seed)
    if seed == 2:
        monkeypatch.setattr(jt, "PIECE", 50)
    got = jt.report_lines(pa.array(lines)).to_pylist()
    assert [r["issue"] for r in got] == [parsed_issue(x) for x in lines]
    assert all((r["at"] is None) == (r["issue"] is None) and (r["at"] or 0) <= len(x.encode()) for r, x in zip(got, lines, strict=True))


def test_paths_and_spans_are_those_of_the_values():
    lines = [x for x in texts(4000, 5) if parsed_issue(x) in (None, "ROW_SHAPE")]

    def walk(v, path=""):
        yield path, v
        for k, x in v.items() if isinstance(v, dict) else (("*", x) for x in v) if isinstance(v, list) else ():
            yield from walk(x, f"{path}/{k if isinstance(v, list) else k.replace('~', '~0').replace('/', '~1')}")

    tape = jt.read(pa.array(lines))
    values, code, names = tape.paths()
    found = [[] for _ in lines]
    for v, c in zip(values.tolist(), code.tolist(), strict=True):
        found[tape.line[v]].append(repr((names[c], json.loads(tape.text(v)))))
    for line, got in zip(lines, found, strict=True):
        assert sorted(got) == sorted(map(repr, walk(json.loads(line)))), line


def test_deep_nesting_is_a_fault():
    at = [jt.DEEPEST, jt.DEEPEST + 1]
    assert [r["fault"] for r in jt.report_lines(pa.array(["[" * n + "]" * n for n in at])).to_pylist()] == [None, "DEPTH"]


def test_reports_in_spark(spark):
    df = spark.createDataFrame([(0, None), (1, '{"\\u0061nswer":1}'), (2, '{"a":1}}'), (3, "")], "i int, x string")
    got = df.select("i", jt.report("x").alias("r"), has_keys(F.col("x"), ["answer"]).alias("has")).orderBy("i").collect()
    assert [(r.r and r.r.issue, r.has) for r in got] == [(None, None), (None, True), ("JSON_PARSE", None), ("BLANK_LINE", None)]
    assert df.limit(0).select(jt.report("x")).count() == 0


def test_census_counts_faults_apart(spark):
    df = spark.createDataFrame([("s", '{"a":[1,"x",{"b":null}],"c":true}'), ("s", '{"a":1.5}'), (None, "{"), ("s", None)], "k string, x string")
    got = {(r.section, r.path, r.kind, r.value): r.n for r in jt.census(df, "x", "k", ["/a/*", "/a"]).collect()}
    assert got == {
        ("s", "", "object", None): 2, ("s", "/a", "array", None): 1, ("s", "/a/*", "number", "1"): 1, ("s", "/a/*", "string", '"x"'): 1, ("s", "/a/*", "object", None): 1,
        ("s", "/a/*/b", "null", None): 1, ("s", "/c", "boolean", None): 1, ("s", "/a", "number", "1.5"): 1, (None, None, "BRACKET", None): 1, ("s", None, "EMPTY", None): 1,
    }


@pytest.mark.parametrize("doc", ['{"é": "ü", "p" : [ ] ,"q":[1]}', '{"p":[ {"f" :3 ,"x":[1, 2]} , { "f":7} ] }', '{"p":[{"f":3}],"p2":[{"f":9}]}\r', '{"q":{"p":[1]}}', "{", None])
def test_splices_leave_other_bytes(spark, doc):
    new = [(5, '{"f":5}'), (3, '{"f":3,"new":"é"}'), (1, '{"f":1}'), (9, '{"f":9}')]
    df = spark.createDataFrame([(doc, new)], "x string, new array<struct<key:long,text:string>>")
    got = jt.merge_items(df, "x", "/p", "f", "new", "y").first().y
    if doc is None or parsed_issue(doc) or "p" not in json.loads(doc):
        assert got is None
        return
    want = json.loads(doc)
    items = {x["f"]: x for x in want["p"]} | {k: json.loads(v) for k, v in new}
    want["p"] = [items[k] for k in sorted(items)]
    assert json.loads(got) == want
    for _, text in new:
        assert text in got
    kept = [x for x in ('{"é": "ü", ', ' , { "f":7}', ' ] }', ',"p2":[{"f":9}]}\r', ' ,"q":[1]}') if x in doc]
    assert all(x in got for x in kept) and kept
    assert jt.merge_items(df.withColumn("new", F.slice("new", 1, 0)), "x", "/p", "f", "new", "y").first().y == doc


def test_spans_replace_in_order(spark):
    df = spark.createDataFrame([("héllo wörld", [(7, 13, "W"), (0, 1, "H"), (6, 6, ","), (6, 6, "!")])], "x string, e array<struct<first:long,last:long,text:string>>")
    assert df.select(jt.splice(F.col("x"), F.col("e"))).first()[0] == "Héllo,! W"


def test_every_line_is_in_one_range(monkeypatch):
    monkeypatch.setattr(ls, "READ_BYTES", 5)
    for body in (b"a\nbb\n\nccc\r\n" + b"d" * 40 + b"\n\ne", b"\n\n", b"x", b"one\n"):
        want, at = [], 0
        for part in body.split(b"\n")[: None if body[-1:] != b"\n" else -1]:
            want.append((at, part.removesuffix(b"\r")))
            at += len(part) + 1
        for step in range(1, len(body) + 2):
            got = [x for a in range(0, len(body), step) for x in ls.ranged_lines(pa.PythonFile(io.BytesIO(body), "r"), a, min(a + step, len(body)))]
            assert got == want, (body, step)


class Counted(io.BytesIO):
    """Counts the bytes that are read."""

    taken = 0

    def read(self, size=-1):
        data = super().read(size)
        self.taken += len(data)
        return data


def test_a_small_range_reads_little_more_than_itself():
    """Lines of 30 bytes, and one of 300,000 in whose middle no range may read on to its end."""
    for body in ((b"x" * 29 + b"\n") * 10_000, b"x" * 299_999 + b"\n"):
        raw = Counted(body)
        got = [x for a in range(0, len(body), 1000) for x in ls.ranged_lines(pa.PythonFile(raw, "r"), a, min(a + 1000, len(body)))]
        assert [x for _, x in got] == body.split(b"\n")[:-1]
        assert raw.taken < 8 * len(body)


def test_small_ranges_share_tasks(tmp_path, monkeypatch):
    """Many ranges over a few files are dealt to few tasks, and every line is read once; a few ranges are a task each."""
    monkeypatch.setattr(ls, "TASK_BYTES", 20_000)
    want = []
    for name, n in (("a", 40_000), ("b", 1), ("c", 0), ("d", 33_333)):
        whole = [b'{"id":%d}' % i + b" " * (i % 40) for i in range(n)]
        (tmp_path / name).write_bytes(b"\n".join(whole))
        want += [(str(tmp_path / name), x.decode()) for x in whole]
    reader = ls.Reader(str(tmp_path), 100)
    tasks = reader.partitions()
    total = sum(x.stat().st_size for x in tmp_path.iterdir())
    assert 64 <= len(tasks) <= total // 20_000 * 2
    got = [(f, x) for t in tasks for b in reader.read(t) for f, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
    assert got == want
    assert len(ls.Reader(str(tmp_path), total // 20).partitions()) >= 20


def test_lines_are_records_and_issues(spark, tmp_path):
    whole = [b'{"a":1}', b"", b'{"a":\xff}', b"[1]", b'{"b":"\xc3\xa9"}\r', b"{bad"] * 200
    (tmp_path / "one.jsonl").write_bytes(b"\n".join(whole))
    (tmp_path / "two.jsonl").write_bytes(b'{"z":1}\n')
    (tmp_path / "_left").write_bytes(b"nothing\n")
    (tmp_path / "empty.jsonl").write_bytes(b"")
    df = ls.scan(spark, str(tmp_path), 700)
    assert df.rdd.getNumPartitions() > 10
    rows = ls.numbered(df).collect()
    one = sorted((r for r in rows if r.file.endswith("one.jsonl")), key=lambda r: r.number)
    assert [r.number for r in one] == list(range(1, 1201)) and len(rows) == 1201
    assert [r.line.encode() for r in one if r.issue != "ENCODING"] == [x.removesuffix(b"\r") for x in whole if b"\xff" not in x]
    assert [r.issue for r in one[:6]] == [None, "BLANK_LINE", "ENCODING", "ROW_SHAPE", None, "JSON_PARSE"]
    assert all(b"\n".join(whole)[r.first :].startswith(r.line.encode()) for r in one if r.issue != "ENCODING")
    assert ls.scan(spark, f"file:{tmp_path}/two.jsonl").count() == 1
    assert ls.scan(spark, str(tmp_path / "empty.jsonl")).count() == 0
    with pytest.raises(Exception, match="FileNotFound"):
        ls.scan(spark, str(tmp_path / "none")).collect()
