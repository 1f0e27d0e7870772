"""JSON text as a tape of tokens, made for whole Arrow batches of lines at once.

Quotes, escapes, brackets and separators are found as arrays over the bytes of a batch; depths are running sums, and a
stable sort by (line, depth) puts the children of every container side by side, so that its grammar is a check of
places. The tape tells faults of strict JSON, repeated keys, key paths and the byte span of every value; nothing is
decoded but keys with escapes. Whatever needs rows together (census, audits) is left to Spark.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

PIECE = 1 << 22  # bytes of lines that are read at once; a longer line is read alone
DEEPEST = 1000  # containers inside each other
HELD = 100_000  # rows of a census that a task holds before it hands them on
STRING, SCALAR = 34, 86  # kinds of tokens; others are their own byte
NUMBER = r"^-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$"
FAULTS = ("QUOTE", "CONTROL", "ESCAPE", "LITERAL", "BRACKET", "TRAILING", "GRAMMAR", "DEPTH", "EMPTY")
CONSTANTS = (b"NaN", b"Infinity", b"-Infinity")

_SPACE, _MARK, _HEX, _ESCAPE = (np.zeros(256, bool) for _ in range(4))
_SPACE[list(b" \t\n\r")] = True
_MARK[list(b"{}[]:,")] = True
_HEX[list(b"0123456789abcdefABCDEF")] = True
_ESCAPE[list(b'"\\/bfnrtu')] = True


@dataclass
class Tape:
    """Tokens of the lines without faults, ordered by (line, depth, place in the text)."""

    data: np.ndarray  # bytes of all lines
    starts: np.ndarray  # of each line
    fault: np.ndarray  # of each line: index in FAULTS, or -1
    fault_at: np.ndarray
    constant: np.ndarray  # of each line: byte of its first NaN or Infinity, or -1
    overflow: np.ndarray  # of its first number beyond a double
    line: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    last: np.ndarray  # one past the token; of a container, past its end
    depth: np.ndarray
    parent: np.ndarray  # the token that opens the container, or -1
    place: np.ndarray  # among the container's tokens

    def text(self, at: int) -> bytes:
        return self.data[self.first[at] : self.last[at]].tobytes()

    def values(self) -> np.ndarray:
        """Tokens that are values: not keys, separators or ends."""
        inside = self.inside()
        return np.flatnonzero(((self.kind == STRING) | (self.kind == SCALAR) | (self.kind == 123) | (self.kind == 91)) & ~((inside == 123) & (self.place % 4 == 0)))

    def keys(self) -> np.ndarray:
        return np.flatnonzero((self.inside() == 123) & (self.place % 4 == 0) & (self.kind == STRING))

    def inside(self) -> np.ndarray:
        """The kind of the container of each token; 0 at the root."""
        return np.where(self.parent < 0, 0, self.kind[self.parent])

    def names(self, keys: np.ndarray) -> list[bytes]:
        """The keys' text, with escapes decoded."""
        found = _slices(self.data, self.first[keys] + 1, self.last[keys] - 1).to_pylist()
        return [json.loads(b'"' + x + b'"').encode("utf-8", "surrogatepass") if b"\\" in x else x for x in found]

    def paths(self) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """(values, path of each, names of paths). A path joins keys by `/`, with `~1` and `~0` for `/` and `~` in
        them; `*` stands for the elements of an array."""
        values, keys = self.values(), self.keys()
        names = self.names(keys)
        codes: dict[bytes, int] = {}
        key_code = np.full(len(self.kind), -1, np.int64)
        key_code[keys] = [codes.setdefault(x, len(codes)) for x in names]
        listed = list(codes)
        own = np.full(len(self.kind), -1, np.int64)
        step = np.where(self.inside()[values] == 123, key_code[values - 2], -1)
        out, depth = [""], self.depth[values]
        own[values[depth == 0]] = 0
        order = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[order], np.arange(1, int(depth.max(initial=0)) + 2))
        for d in range(len(edges) - 1):
            at = order[edges[d] : edges[d + 1]]
            pair = own[self.parent[values[at]]] * (len(listed) + 1) + step[at] + 1
            seen, back = np.unique(pair, return_inverse=True)
            own[values[at]] = len(out) + back
            for x in seen.tolist():
                above, k = divmod(x, len(listed) + 1)
                out.append(out[above] + "/" + ("*" if k == 0 else listed[k - 1].decode("utf-8", "replace").replace("~", "~0").replace("/", "~1")))
        return values, own[values], out


def _slices(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> pa.Array:
    """Byte strings data[first:last], copied side by side."""
    size = last - first
    offsets = np.r_[0, np.cumsum(size)]
    at = np.arange(offsets[-1]) + np.repeat(first - offsets[:-1], size)
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data[at]))])


def read(lines: pa.Array) -> Tape:
    """The tape of an array of strings; nulls are empty lines."""
    lines = lines.cast(pa.binary())
    offsets = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1].astype(np.int64)
    data = np.frombuffer(lines.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    starts = offsets - offsets[0]
    n, size = len(lines), len(data)
    of = np.repeat(np.arange(n, dtype=np.int32), np.diff(starts))
    begins = np.zeros(size + 1, bool)
    begins[starts] = True
    worst = np.full(n, np.iinfo(np.int64).max)

    def blame(line: np.ndarray, at: np.ndarray, what: str) -> None:
        np.minimum.at(worst, line, at.astype(np.int64) * len(FAULTS) + FAULTS.index(what))

    # A backslash that is not itself escaped escapes the byte after it.
    back = np.flatnonzero(data == 92)
    fresh = np.r_[True, (np.diff(back) > 1)] | begins[back] if len(back) else np.empty(0, bool)
    run = np.flatnonzero(fresh)
    odd = (np.arange(len(back)) - run[np.cumsum(fresh) - 1]) % 2 == 0 if len(back) else fresh
    escapers = back[odd]
    escaped = np.zeros(size + 1, bool)
    escaped[escapers + 1] = True
    escaped &= ~begins
    # Quotes open and close in turn along each line.
    quotes = np.flatnonzero((data == 34) & ~escaped[:size])
    before = np.searchsorted(quotes, starts[:-1])
    opens = (np.arange(len(quotes)) - before[of[quotes]]) % 2 == 0
    opening, closing = quotes[opens], quotes[~opens]
    turn = np.zeros(size + 1, np.int8)
    turn[opening] += 1
    turn[closing] -= 1
    open_at_end = np.flatnonzero(np.diff(np.r_[before, len(quotes)]) % 2)
    unclosed = quotes[np.r_[before, len(quotes)][open_at_end + 1] - 1]
    np.add.at(turn, starts[open_at_end + 1], -1)
    blame(open_at_end, unclosed, "QUOTE")
    text = np.cumsum(turn[:size]).astype(bool)
    control = np.flatnonzero(text & (data < 32))
    blame(of[control], control, "CONTROL")
    inner = escapers[text[escapers]]
    after = np.minimum(inner + 1, max(0, size - 1))
    wrong = ~_ESCAPE[data[after]] | (of[after] != of[inner])
    for far in range(1, 5):
        at = np.minimum(after + far, max(0, size - 1))
        wrong |= (data[after] == 117) & ~(_HEX[data[at]] & text[at] & (of[at] == of[inner]))
    blame(of[inner[wrong]], inner[wrong], "ESCAPE")
    bare = ~text
    bare[closing] = False
    marks = np.flatnonzero(bare & _MARK[data])
    scalar = bare & ~_MARK[data] & ~_SPACE[data]
    held = np.r_[False, scalar]
    from_ = np.flatnonzero(scalar & (~held[:-1] | begins[:-1])) if size else np.empty(0, np.int64)
    to = np.flatnonzero(scalar & (~np.r_[scalar[1:], False] | begins[1:])) + 1 if size else np.empty(0, np.int64)
    ends = np.full(len(opening), size, np.int64)
    pair = np.searchsorted(closing, opening)
    has = pair < len(closing)
    ends[has] = closing[pair[has]] + 1
    first = np.r_[marks, from_, opening].astype(np.int64)
    last = np.r_[marks + 1, to, ends].astype(np.int64)
    kind = np.r_[data[marks], np.full(len(from_), SCALAR, np.uint8), np.full(len(opening), STRING, np.uint8)]
    # Scalars are numbers, literals or constants.
    words = _slices(data, from_, to)
    constant, overflow = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    if len(words):
        number = pc.match_substring_regex(words, NUMBER).to_numpy(zero_copy_only=False)
        fixed = pc.is_in(words, pa.array([b"true", b"false", b"null"])).to_numpy(zero_copy_only=False)
        odd_one = pc.is_in(words, pa.array(CONSTANTS)).to_numpy(zero_copy_only=False)
        bad = ~(number | fixed | odd_one)
        blame(of[from_[bad]], from_[bad], "LITERAL")
        for at in from_[odd_one][::-1]:
            constant[of[at]] = at
        large = np.flatnonzero(number & ((to - from_ > 300) | pc.match_substring_regex(words, "[eE]").to_numpy(zero_copy_only=False)))
        for i in large[::-1]:
            if abs(float(words[int(i)].as_py())) == float("inf"):
                overflow[of[from_[i]]] = from_[i]
    order = np.argsort(first, kind="stable")
    first, last, kind = first[order], last[order], kind[order]
    line = of[first] if size else np.empty(0, np.int32)
    empty = np.setdiff1d(np.arange(n), line)
    blame(empty, starts[empty], "EMPTY")
    # Depth before each token; lines whose brackets do not balance leave.
    opener, closer = (kind == 123) | (kind == 91), (kind == 125) | (kind == 93)
    change = opener.astype(np.int64) - closer
    depth = np.cumsum(change) - change
    fresh = np.r_[True, line[1:] != line[:-1]] if len(line) else np.empty(0, bool)
    depth -= depth[np.flatnonzero(fresh)][np.cumsum(fresh) - 1] if len(line) else 0
    under = np.flatnonzero(closer & (depth <= 0))
    blame(line[under][fresh[under]], first[under][fresh[under]], "BRACKET")
    blame(line[under][~fresh[under]], first[under][~fresh[under]], "TRAILING")
    final = np.flatnonzero(np.r_[fresh[1:], True]) if len(line) else np.empty(0, np.int64)
    left = final[(depth + change)[final] > 0]
    blame(line[left], last[left] - 1, "BRACKET")
    deep = np.flatnonzero(depth > DEEPEST)
    blame(line[deep], first[deep], "DEPTH")
    good = np.ones(n, bool)
    good[line[under]] = good[line[left]] = good[line[deep]] = False
    take = np.flatnonzero(good[line]) if len(line) else np.empty(0, np.int64)
    take = take[np.lexsort((first[take], depth[take], line[take]))]
    line, kind, first, last, depth = line[take], kind[take], first[take], last[take], depth[take]
    parent, place = _contain(line, kind, first, last, depth, blame)
    clean = worst == np.iinfo(np.int64).max
    kept = np.flatnonzero(clean[line]) if len(line) else np.empty(0, np.int64)
    moved = np.full(len(line) + 1, -1, np.int64)
    moved[kept] = np.arange(len(kept))
    return Tape(
        data, starts, np.where(clean, -1, worst % len(FAULTS)), np.where(clean, -1, worst // len(FAULTS) - starts[:-1]),
        np.where(constant < 0, -1, constant - starts[:-1]), np.where(overflow < 0, -1, overflow - starts[:-1]),
        line[kept], kind[kept], first[kept], last[kept], depth[kept], moved[parent[kept]], place[kept],
    )


def _contain(line: np.ndarray, kind: np.ndarray, first: np.ndarray, last: np.ndarray, depth: np.ndarray, blame) -> tuple[np.ndarray, np.ndarray]:
    """Parent and place of tokens of balanced lines in order of (line, depth, first), whose grammar is checked. At each
    depth of a line the ends of containers part the children of one from those of the next, in the order in which the
    containers open a level higher."""
    if not len(line):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    opener, closer = (kind == 123) | (kind == 91), (kind == 125) | (kind == 93)
    opened, closed = np.flatnonzero(opener), np.flatnonzero(closer)
    parent = np.full(len(line), -1, np.int64)
    below = depth > 0
    ordinal = np.cumsum(closer) - closer
    parent[below] = opened[ordinal[below]]
    last[opened] = last[closed]
    odd = kind[opened] + 2 != kind[closed]
    blame(line[closed[odd]], first[closed[odd]], "BRACKET")
    group = np.r_[True, (line[1:] != line[:-1]) | (depth[1:] != depth[:-1]) | closer[:-1]]
    at = np.arange(len(line))
    place = at - at[group][np.cumsum(group) - 1]
    value = opener | (kind == STRING) | (kind == SCALAR)
    inside = np.where(below, kind[parent], 0)
    four, two = place % 4, place % 2
    listed = np.where(closer, (place == 0) | (two == 1), np.where(two == 0, value, kind == 44))
    keyed = np.where(closer, (place == 0) | (four == 3), np.select([four == 0, four == 1, four == 2], [kind == STRING, kind == 58, value], kind == 44))
    root = (place == 0) & value
    ok = np.where(inside == 123, keyed, np.where(inside == 91, listed, root))
    extra = ~ok & (inside == 0) & (place > 0)
    blame(line[extra], first[extra], "TRAILING")
    rest = ~ok & ~extra
    blame(line[rest], first[rest], "GRAMMAR")
    return parent, place


def repeated(tape: Tape) -> tuple[np.ndarray, np.ndarray]:
    """(line, byte) of keys that their object has already."""
    keys = tape.keys()
    codes: dict[bytes, int] = {}
    code = np.array([codes.setdefault(x, len(codes)) for x in tape.names(keys)], np.int64)
    order = np.lexsort((tape.first[keys], code, tape.parent[keys]))
    again = order[1:][(np.diff(code[order]) == 0) & (np.diff(tape.parent[keys][order]) == 0)]
    return tape.line[keys[again]], tape.first[keys[again]] - tape.starts[tape.line[keys[again]]]


def pieces(lines: pa.Array) -> Iterator[pa.Array]:
    """Slices of about PIECE bytes."""
    size = pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(size) // PIECE
    cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, len(lines)]
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        yield lines.slice(a, b - a)


REPORT = StructType([StructField("issue", StringType()), StructField("fault", StringType()), StructField("at", LongType())])


def _report_piece(lines: pa.Array) -> pa.Array:
    tape = read(lines)
    n = len(lines)
    issue, fault, at = np.full(n, None, object), np.full(n, None, object), np.full(n, -1, np.int64)
    root = np.flatnonzero(tape.depth == 0)
    shape = root[tape.kind[root] != 123]
    issue[tape.line[shape]], at[tape.line[shape]] = "ROW_SHAPE", tape.first[shape] - tape.starts[tape.line[shape]]
    clean = tape.fault < 0
    found = np.flatnonzero(clean & (tape.overflow >= 0))
    issue[found], fault[found], at[found] = "OVERFLOW", "OVERFLOW", tape.overflow[found]
    line, byte = repeated(tape)
    for i in np.argsort(-byte, kind="stable"):
        issue[line[i]], fault[line[i]], at[line[i]] = "DUPLICATE_KEY", "DUPLICATE_KEY", byte[i]
    found = np.flatnonzero(clean & (tape.constant >= 0))
    issue[found], fault[found], at[found] = "CONSTANT", "CONSTANT", tape.constant[found]
    dirty = np.flatnonzero(~clean)
    for i, text in zip(dirty.tolist(), lines.take(pa.array(dirty)).to_pylist(), strict=True):
        blank = text is None or not text.strip()
        issue[i], fault[i], at[i] = ("BLANK_LINE", None, 0) if blank else ("JSON_PARSE", FAULTS[tape.fault[i]], tape.fault_at[i])
    nulls = np.array([x is None for x in issue])
    columns = [pa.array(issue, pa.string()), pa.array(fault, pa.string()), pa.array(at, pa.int64(), mask=nulls)]
    return pa.StructArray.from_arrays(columns, names=["issue", "fault", "at"], mask=lines.is_null())


def report_lines(lines: pa.Array) -> pa.Array:
    found = [_report_piece(x) for x in pieces(lines)]
    return pa.concat_arrays(found) if found else pa.array([], to_arrow_type(REPORT))


@F.arrow_udf(REPORT)
def report(lines: pa.Array) -> pa.Array:
    """What strict JSON says of a line, which is to be one object: issue, the kind of fault, and the byte where it lies.

    issue is null, or the first of: BLANK_LINE; JSON_PARSE (fault: QUOTE, CONTROL, ESCAPE, LITERAL, BRACKET, TRAILING,
    GRAMMAR, or DEPTH beyond DEEPEST containers); CONSTANT, a bare NaN or Infinity; DUPLICATE_KEY, in one object at any
    depth, however the key is escaped; OVERFLOW, a number beyond a double; ROW_SHAPE, a value that is no object.
    A null line has a null report.
    """
    return report_lines(lines)


@F.arrow_udf(ArrayType(StringType()))
def key_names(lines: pa.Array) -> pa.Array:
    """Distinct keys of a JSON text at any depth, decoded; null for text that is no JSON."""
    out: list[list[str] | None] = []
    for piece in pieces(lines):
        tape = read(piece)
        held: list[set[bytes]] = [set() for _ in range(len(piece))]
        keys = tape.keys()
        for i, name in zip(tape.line[keys].tolist(), tape.names(keys), strict=True):
            held[i].add(name)
        out += [sorted(x.decode("utf-8", "replace") for x in names) if f < 0 else None for names, f in zip(held, tape.fault.tolist(), strict=True)]
    return pa.array(out, pa.list_(pa.string()))


_SPAN = [StructField("first", LongType()), StructField("last", LongType())]
ITEMS = StructType([*_SPAN, StructField("items", ArrayType(StructType([*_SPAN, StructField("key", StringType())])))])


@F.arrow_udf(ITEMS)
def array_items(lines: pa.Array, path: pa.Array, field: pa.Array) -> pa.Array:
    """Byte span of the array at `path` (`/a/b`), and of its elements with the raw text of their `field`. Null where the
    text is no JSON or has no such array."""
    out: list[dict | None] = []
    done = 0
    for piece in pieces(lines):
        tape = read(piece)
        values, code, names = tape.paths()
        start = tape.starts[tape.line[values]] if len(values) else np.empty(0, np.int64)
        held: list[dict | None] = [None] * len(piece)
        ways, fields = path.slice(done, len(piece)).to_pylist(), field.slice(done, len(piece)).to_pylist()
        done += len(piece)
        at = {name: i for i, name in enumerate(names)}
        want = np.array([at.get(p, -2) for p in ways], np.int64)
        arrays = np.flatnonzero((code == want[tape.line[values]]) & (tape.kind[values] == 91)) if len(values) else ()
        place = {}
        for i in arrays:
            v = values[i]
            place[int(v)] = held[tape.line[v]] = {"first": int(tape.first[v] - start[i]), "last": int(tape.last[v] - start[i]), "items": []}
        spots = {}
        for i in np.flatnonzero(np.isin(tape.parent[values], list(place))) if place else ():
            v = values[i]
            spots[int(v)] = item = {"first": int(tape.first[v] - start[i]), "last": int(tape.last[v] - start[i]), "key": None}
            place[int(tape.parent[v])]["items"].append(item)
        for i in np.flatnonzero(np.isin(tape.parent[values], list(spots))) if spots else ():
            v = values[i]
            if names[code[i]].rpartition("/")[2] == fields[tape.line[v]]:
                spots[int(tape.parent[v])]["key"] = tape.text(int(v)).decode("utf-8", "replace")
        out += held
    return pa.array(out, to_arrow_type(ITEMS))


def splice(line: Column, edits: Column) -> Column:
    """The text with byte spans replaced. edits: array<struct<first long, last long, text string>>, not crossing each
    other; those that begin at one byte apply in their order in the array. All other bytes stay as they are."""
    raw = line.cast("binary")
    order = F.array_sort(F.transform(edits, lambda e, i: F.struct(e["first"].alias("first"), i.alias("i"), e["last"].alias("last"), e["text"].alias("text"))))
    cut = lambda a, b: F.substring(raw, (a + 1).cast("int"), (b - a).cast("int")).cast("string")
    held = F.transform(order, lambda e, i: F.concat(cut(F.when(i == 0, F.lit(0).cast("long")).otherwise(F.try_element_at(order, i)["last"]), e["first"]), e["text"]))
    tail = F.coalesce(F.try_element_at(order, F.lit(-1))["last"], F.lit(0).cast("long"))
    return F.concat(F.array_join(held, ""), cut(tail, F.octet_length(line).cast("long")))


def merge_items(df: DataFrame, line: str, path: str, field: str, new: str, name: str) -> DataFrame:
    """Adds `name`: the text in column `line` with elements put into the array at `path`, which is in the order of its
    elements' whole number `field`. new: a column of array<struct<key long, text string>>, keys distinct. An element of
    the same key is replaced; others go in after the last smaller one. Bytes outside the new elements and their commas
    stay. Null where there is no such array."""
    found, new = F.col("_items"), F.col(new)
    at = lambda x: x["key"].cast("long")
    items = found["items"]

    def edit(e: Column) -> Column:
        same = F.try_element_at(F.filter(items, lambda x: at(x) == e["key"]), F.lit(1))
        below = F.try_element_at(F.filter(items, lambda x: at(x) < e["key"]), F.lit(-1))
        head = F.try_element_at(items, F.lit(1))
        spot = lambda first, last, text: F.struct(first.alias("first"), last.alias("last"), text.alias("text"))
        ahead = F.exists(new, lambda o: o["key"] < e["key"])
        alone = F.when(ahead, F.concat(F.lit(","), e["text"])).otherwise(e["text"])
        return (
            F.when(same.isNotNull(), spot(same["first"], same["last"], e["text"]))
            .when(F.size(items) == 0, spot(found["first"] + 1, found["first"] + 1, alone))
            .when(below.isNotNull(), spot(below["last"], below["last"], F.concat(F.lit(","), e["text"])))
            .otherwise(spot(head["first"], head["first"], F.concat(e["text"], F.lit(","))))
        )

    df = df.withColumn("_items", array_items(F.col(line), F.lit(path), F.lit(field)))
    return df.withColumn(name, F.when(found.isNotNull(), splice(F.col(line), F.transform(F.array_sort(new), edit)))).drop("_items")


_KINDS = {123: "object", 91: "array", STRING: "string"}


def census(df: DataFrame, line: str, section: str, scalars: Sequence[str] = ()) -> DataFrame:
    """(section, path, kind, value, n): how often each path holds each kind of value, and for the paths in `scalars`
    each scalar as it is written. Lines that are no JSON count under a null path, with their issue as kind."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[tuple[str | None, str | None, str, str | None]] = Counter()

        def hand_on() -> pa.RecordBatch:
            rows = [(*k, n) for k, n in held.items()]
            s, p, k, v, n = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([*(pa.array(x, pa.string()) for x in (s, p, k, v)), pa.array(n, pa.int64())], names=["section", "path", "kind", "value", "n"])

        for batch in batches:
            done = 0
            for piece in pieces(batch.column(1)):
                tape = read(piece)
                sections = batch.column(0).slice(done, len(piece)).to_pylist()
                done += len(piece)
                values, code, names = tape.paths()
                letter = tape.data[tape.first[values]] if len(values) else np.empty(0, np.uint8)
                listed = {i for i, name in enumerate(names) if name in scalars}
                for v, c, i, k, b in zip(values.tolist(), code.tolist(), tape.line[values].tolist(), tape.kind[values].tolist(), letter.tolist(), strict=True):
                    kind = _KINDS.get(k) or ("boolean" if b in b"tf" else "null" if b in b"n" else "number")
                    shown = tape.text(v).decode("utf-8", "replace") if c in listed and k in (STRING, SCALAR) else None
                    held[sections[i], names[c], kind, shown] += 1
                for i in np.flatnonzero(tape.fault >= 0).tolist():
                    held[sections[i], None, FAULTS[tape.fault[i]], None] += 1
                if len(held) >= HELD:
                    yield hand_on()
                    held.clear()
        if held:
            yield hand_on()

    rows = df.select(F.col(section).cast("string").alias("section"), F.col(line).cast("string").alias("line"))
    counts = rows.mapInArrow(count, "section string, path string, kind string, value string, n long")
    return counts.groupBy("section", "path", "kind", "value").agg(F.sum("n").alias("n"))
