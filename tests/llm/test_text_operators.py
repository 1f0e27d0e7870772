"""Mixing, near-duplicates, repeated passages, quality, decontamination, personal data, token output."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomspan.llm import components, decontaminate, feistel, minhash, mixing, pii, quality, suffix_dedup, token_output
from loomspan.llm.common import Scratch

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keys string, rep int"


def words(rng, n, pool=400):
    return " ".join(f"w{rng.randrange(pool)}" for _ in range(n))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", 1) for i, t, s in rows], SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and long texts, copies, near copies, repeated rows, clashing extra columns."""
    rng = random.Random(3)
    base = words(rng, 120)
    near = [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(12)]
    passage = words(rng, 60, 9000)
    rows = [(i, words(rng, rng.randrange(0, 90)), f"s{i % 4}") for i in range(40)]
    rows += [(100 + i, t, "s0") for i, t in enumerate(near)] + [(200 + i, base, "s1") for i in range(5)]
    rows += [(300 + i, f"{words(rng, 20)} {passage} {words(rng, 20)}", "s2") for i in range(4)]
    rows += [(400, None, "s1"), (401, "", "s1"), (402, "  \t\n", None), (403, "one two", "s3"), (404, "One TWO", "s3"), (405, "one", None), (406, words(rng, 6000), "s3"), (407, "In. " * 300, "s2"), (408, "a" * 1500, "s2")]
    rows += [(7, rows[7][1], "s3"), (7, rows[7][1], "s3"), (None, "no id here", "s1"), (None, None, None), (9, words(rng, 50), "s1")]
    return rows


def brute_near(rows):
    def shingles(t):
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    known = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    for a, sa in known:
        root(a)
        for b, sb in known:
            if sa and sb and 100 * len(sa & sb) >= 75 * len(sa | sb):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return sorted((-1 if i is None else i, len(shingles(t)), -1 if i is None else root(i)) for i, t, _ in rows)


def test_near_duplicates_match_brute_force(spark, odd):
    got = minhash.near_duplicates(table(spark, odd)).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got) == brute_near(odd)
    assert all(r.kept == (r.doc_id == r.component_id or r.doc_id is None) for r in got)


@pytest.mark.parametrize("block, load", [(minhash.BLOCK, minhash.LOAD), (16, 300)])
def test_near_duplicates_of_borderline_group(spark, monkeypatch, block, load):
    """Many near copies around the threshold: the pairs that stars leave must be tested too, however blocks are cut."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "LOAD", load)
    rng = random.Random(11)
    base = words(rng, 60, 10**6).split()
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.randrange(0, 4)):
            w[rng.randrange(60)] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w), "s"))
    got = minhash.near_duplicates(table(spark, rows)).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_near(rows)


def test_super_minhash_estimates_similarity():
    rng = np.random.default_rng(1)
    error = []
    for _ in range(60):
        both, a, b = (rng.integers(1, 1 << 62, n).astype(np.uint64) for n in (150, 30, 30))
        s = minhash.super_minhash(np.concatenate([both, a, both, b]), np.repeat([0, 1], 180), 2)
        error.append((s[0] == s[1]).mean() - 150 / 210)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.045
    one = minhash.super_minhash(np.array([5], np.uint64), np.zeros(1, np.int64), 1)
    assert len(set((one[0] >> np.uint64(32)).tolist())) == minhash.REGISTERS  # a permutation of the steps


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7), (200, 60)]
    got = dict(components.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "t"), "c").collect())
    assert got == {**dict.fromkeys([*range(61), 200], 0), 100: 100, 101: 100}


def test_empty_tables(spark):
    none = table(spark, []).where("doc_id is not null")
    assert minhash.near_duplicates(none).count() == 0
    assert suffix_dedup.remove_repeated_passages(none).count() == 0
    assert mixing.mix_sources(none).count() == 0
    assert mixing.mixed_documents(none).count() == 0
    assert pii.find_personal_data(none).count() == 0
    assert token_output.training_records(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.find_contamination(none, bench).count() == 0
    assert decontaminate.find_contamination(table(spark, [(1, "a b", "s")]), bench).first().contaminated is False


def brute_passages(rows):
    seen, out = set(), {}
    docs = sorted({(1 << 63 if i is None else i, t or "") for i, t, _ in rows})
    for i, t in docs:
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        spans = int((np.diff(np.r_[0, hit.astype(int)]) == 1).sum())
        out[i, t] = (len(b), int(hit.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest())
    return out


def test_repeated_passages_match_brute_force(spark, odd):
    rows = [r for r in odd if r[0] != 9 or r is odd[9]]
    want = brute_passages(rows)
    got = suffix_dedup.remove_repeated_passages(table(spark, rows)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i or 0, *want[1 << 63 if i is None else i, t or ""]) for i, t, _ in rows)


@pytest.mark.parametrize("group", [1, 3, 10])
def test_hot_anchor_matches_brute_force(spark, group):
    """A line in all documents, in different surroundings: its stretches are cut by content over several levels."""
    rng = random.Random(5)
    line = words(rng, 40, 10**6)
    rows = [(i, f"{words(rng, 5)} {line[rng.randrange(30):]} {words(rng, 5)}", "s") for i in range(60)]
    rows += [(100 + i, f"{words(rng, 3)} {line[40:80 + i]} {words(rng, 9)} {line[20:130]}", "s") for i in range(20)]
    want = brute_passages(rows)
    got = suffix_dedup.remove_repeated_passages(table(spark, rows), group=group).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == sorted((i, *want[i, t]) for i, t, _ in rows)


def test_many_rows_without_id_and_one_id_with_many_texts(spark):
    """20,000 rows without an id: each keeps its own spans. Several texts of an id follow their hash, so that results
    are compared as a whole with the order that the operator states."""
    rng = random.Random(6)
    texts = sorted({f"{words(rng, 12)} {rng.randrange(10**9)} {words(rng, 14)}" for _ in range(20_000)} | {words(rng, 60) for _ in range(50)})
    shared = words(rng, 30, 10**6)
    rows = [(None, f"{t} {shared}" if i % 97 == 0 else t, "s") for i, t in enumerate(texts)]
    rows += [(5, f"{words(rng, 10)} {shared} {i}", "s") for i in range(300)] + [((1 << 63) - 1, f"last {shared} last", "s")]
    df = table(spark, rows)
    hashes = {r.text: r.h for r in df.selectExpr("text", "shiftrightunsigned(xxhash64(text), 2) h").distinct().collect()}
    seen, want = set(), {}
    for i, t in sorted({(1 << 63 if i is None else i, t) for i, t, _ in rows}, key=lambda x: (x[0], hashes[x[1]])):
        b = t.encode()
        hit = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                hit[p : p + 100] = True
            seen.add(b[p : p + 100])
        want[None if i == 1 << 63 else i, len(b), int(hit.sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~hit].tobytes()).hexdigest()] = want.get((None if i == 1 << 63 else i, len(b), int(hit.sum()), 0), 0) + 1
    got = {(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.remove_repeated_passages(df).collect()}
    assert got == set(want)


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=300).map(lambda b: bytes(c % 3 + 97 for c in b)))
def test_suffix_array(b):
    x = np.frombuffer(b, np.uint8)
    order = suffix_dedup.suffix_array(x)
    keys = [b[i : i + 100] for i in order]
    assert sorted(order.tolist()) == list(range(len(b))) and keys == sorted(keys)


def test_mixing(spark, odd):
    rows = mixing.mix_sources(table(spark, odd), block_words=8).collect()
    assert len(rows) == len(odd)
    assert sorted((r.doc_id or -1, r.size) for r in rows) == sorted((i or -1, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for i, t, _ in odd)
    assert all(r.taken <= 3 * r["size"] for r in rows)
    by = {}
    for r in rows:
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    for (size, target), taken in by.items():
        assert target <= 3 * size and abs(sum(taken) - target) <= 12
    again = mixing.mix_sources(table(spark, odd).repartition(7), block_words=8).collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))


def test_mixed_documents_hold_the_words_taken(spark, odd):
    taken = sum(r.taken for r in mixing.mix_sources(table(spark, odd), block_words=8).collect())
    out = mixing.mixed_documents(table(spark, odd), block_words=8)
    assert out.columns == table(spark, []).columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == taken and all(r.n_chars == len(r.text) for r in rows)


def test_targets_pass_on_excess():
    plan = mixing.targets([("b", 10), (None, 400), ("a", 100), ("Z", 300)])
    assert [s for s, _, _ in plan] == ["Z", "a", "b", None]
    assert sum(t for _, _, t in plan) == pytest.approx(810)
    assert plan[2][2] == 30 and all(t <= 3 * n for _, n, t in plan)


@settings(max_examples=40, deadline=None)
@given(st.integers(1, 3000), st.integers(0, 2**64 - 1))
def test_feistel_is_a_permutation(n, key):
    assert sorted(feistel.permute(np.arange(n), n, key).tolist()) == list(range(n))


def test_token_records_round_trip(spark, odd, tmp_path):
    records = token_output.training_records(table(spark, odd), sequence=64, shard=8).cache()
    rows = records.collect()
    assert [r.slot for r in rows] == list(range(len(rows))) and {len(r.tokens) for r in rows} == {128}
    with open(token_output.TOKENIZER, "rb") as f:
        ranks = f.read()
    want = sorted(token_output.encoding(ranks).decode(token_output.token_ids(t or "", ranks).tolist()) for _, t, _ in odd)
    assert want == sorted(t or "" for _, t, _ in odd)
    index = token_output.write_shards(records, str(tmp_path)).collect()
    assert [(m.slot, m.shard, m.record, m.doc_ids) for m in index] == [(r.slot, r.shard, r.record, r.doc_ids) for r in rows]
    assert {m.sha256 for m in index} == {hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}
    back = token_output.read_records(str(tmp_path), 0, len(rows), 64, 8)
    assert all(back[r.slot].tobytes() == bytes(r.tokens) for r in rows)
    assert sum(r.n_tokens for r in rows) == sum(len(token_output.token_ids(t or "", ranks)) + 1 for _, t, _ in odd)
    whole = mixing_free_stream(rows)
    assert whole == sorted(t or "" for _, t, _ in odd)
    again = token_output.training_records(table(spark, odd).repartition(5), sequence=64, shard=8).collect()
    assert [(r.slot, bytes(r.tokens)) for r in again] == [(r.slot, bytes(r.tokens)) for r in rows]


def test_shards_resume_by_content(spark, odd, tmp_path):
    """Other records in the same folder replace what is there; equal ones are left alone; parts of a shard are an error."""
    first = token_output.training_records(table(spark, odd), sequence=32, shard=4)
    other = token_output.training_records(table(spark, odd), sequence=32, shard=4, key=99)
    token_output.write_shards(first, str(tmp_path)).collect()
    before = {f.name: (f.stat().st_mtime_ns, f.read_bytes()) for f in tmp_path.iterdir()}
    token_output.write_shards(first, str(tmp_path)).collect()
    assert before == {f.name: (f.stat().st_mtime_ns, f.read_bytes()) for f in tmp_path.iterdir()}
    index = token_output.write_shards(other, f"file://{tmp_path}").collect()
    assert {m.sha256 for m in index} == {hashlib.sha256(f.read_bytes()).hexdigest() for f in tmp_path.iterdir()}
    want = {r.slot: bytes(r.tokens) for r in other.collect()}
    back = token_output.read_records(f"file://{tmp_path}", 3, 9, 32, 4)
    assert [x.tobytes() for x in back] == [want[s] for s in range(3, 12)]
    with pytest.raises(EOFError):
        token_output.read_records(str(tmp_path), len(want) - 1, 2, 32, 4)
    with pytest.raises(Exception, match="in one piece"):
        token_output.write_shards(first.where("record <> 1"), str(tmp_path)).collect()


def mixing_free_stream(rows):
    """All texts, read back from the records: one group here, so the index order is the packing order."""
    index = {int(s): i for i, s in enumerate(feistel.permute(np.arange(len(rows)), len(rows), token_output.KEY))}
    with open(token_output.TOKENIZER, "rb") as f:
        coder = token_output.encoding(f.read())
    ordered = sorted(rows, key=lambda r: index[r.slot])
    ids = np.concatenate([np.frombuffer(bytes(r.tokens), np.uint16)[: r.n_tokens] for r in ordered])
    ends = np.flatnonzero(ids == token_output.END)
    return sorted(coder.decode(part.tolist()) for part in (x[x != token_output.END] for x in np.split(ids, ends + 1)[:-1]))


def test_shards_of_documents_are_those_of_their_records(spark, odd, tmp_path):
    docs = table(spark, odd)
    one = token_output.write_shards(token_output.training_records(docs, sequence=32, shard=600), f"{tmp_path}/a").collect()
    other = token_output.write_training_shards(docs, f"{tmp_path}/b", sequence=32, shard=600).collect()
    assert len(one) > 600 and sorted(one) == sorted(other)
    files = [{p.name: p.read_bytes() for p in (tmp_path / x).iterdir()} for x in "ab"]
    assert files[0] == files[1] and len(files[0]) > 1


def test_long_text_tokenizes_like_a_short_one(monkeypatch):
    with open(token_output.TOKENIZER, "rb") as f:
        ranks = f.read()
    text = "Some words,  and more\n\nwords don't end 12 345. " * 40
    whole = token_output.encoding(ranks).encode_ordinary(text)
    monkeypatch.setattr(token_output, "PIECE", 50)
    assert token_output.token_ids(text, ranks).tolist() == whole


def test_quality_of_odd_rows(spark, odd):
    docs = table(spark, odd)
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (2, 1, 0), (None, 1, 1), (3, None, 1), (401, 0, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(odd) and all(0 <= r.posterior <= 1 for r in got)
    assert all(r.keep for r in quality.classify(docs, labels.limit(0)).collect())


def test_decontamination(spark):
    rng = random.Random(8)
    items = [(i, words(rng, 12 + 4 * i, 3000) + ". " + words(rng, 6, 3000) + ".") for i in range(12)] + [(None, "x y z a b c"), (50, None), (51, "")]
    rows = []
    for i in range(80):
        rows.append((i, words(rng, 200, 3000), "s"))
    for i, (item, text) in enumerate(items[:12]):
        rows.append((100 + i, f"{words(rng, 150, 3000)} {text.upper()} {words(rng, 90, 3000)}", "s"))  # whole, other case
        changed = [w if k % 9 else f"{w} extra" for k, w in enumerate(text.split())]
        changed = [w for k, w in enumerate(changed) if k % 11 != 5]
        rows.append((200 + i, f"{words(rng, 60, 3000)} {' '.join(changed)}", "s"))  # words put in and left out
    rows += [(300, None, "s"), (301, "", "s"), (None, items[3][1], "s"), (302, items[2][1] + " " + items[4][1], "s")]
    got = {r.doc_id: r for r in decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    for i in range(80):
        assert not got[i].contaminated
    for i in range(12):
        assert got[100 + i].item_ids == [i] and got[200 + i].item_ids == [i]
    assert got[302].item_ids == [2, 4] and got[None].item_ids == [3] and not got[300].contaminated


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=20), st.lists(st.sampled_from("abcd"), max_size=20))
def test_common_subsequence(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert decontaminate.common_subsequence(a, b) == best[-1][-1]


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda d=digits: 13 <= len(d) <= 19 and pii.luhn(d), "phone": lambda d=digits: 9 <= len(d) <= 15}[kind]()
            if good:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ANCHORS = pii.automaton()


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a1.@+- 25(0)9b_%é", max_size=40))
def test_base_spans(text):
    assert pii.spans_text(pii.find(text, ANCHORS), pii.BASE_KINDS) == base_spans(text)


def test_personal_data(spark):
    text = "é mail a.b@c-d.org, call +1 (706) 555-3138; card 4111 1111 1111 1111 at 10.0.0.255 or 10.0.0.256; token = \"04dbebab91ab85687d33eeaaf9ac6\" IBAN GB82 WEST 1234 5698 7654 32"
    rows = [(1, text, "s"), (2, None, "s"), (None, "", "s"), (1, text, "s"), (3, "1" * 50000 + "@" * 20000 + "a" * 50000, "s")]
    got = pii.find_personal_data(table(spark, rows)).collect()
    assert [(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone) for r in got] == [(1, 1, 1, 1, 1), (2, 0, 0, 0, 0), (None, 0, 0, 0, 0), (1, 1, 1, 1, 1), (3, 0, 0, 0, 0)]
    assert got[0].base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest() and got[1].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert "iban:" in got[0].spans and "secret:" in got[0].spans


def test_cued_spans_of_any_length():
    for n in (16, 128, 129, 5000):
        text = f"x password = {'Ab3_' * (n // 4)}{'9' * (n % 4)} y"
        assert pii.find(text, ANCHORS) == [("secret", 13, 13 + n)]
    found = {k for k, *_ in pii.find("ssn 123-45-6789, see https://me:pw12@host/ and IBAN: GB82 WEST 1234 5698 7654 32; passport no. AB123-4567", ANCHORS)}
    assert found >= {"account", "login", "iban"}


def test_decontamination_of_a_large_benchmark(spark):
    """More passages than the rank by far: copies, whole or with words put in and left out, are found all the same."""
    rng = random.Random(21)
    items = [(i, words(rng, 24, 6000) + ". " + words(rng, 8, 6000) + ".") for i in range(1100)]
    rows = [(i, words(rng, 150, 6000), "s") for i in range(100)]
    for i, text in items[::10]:
        rows.append((1000 + i, f"{words(rng, 70, 6000)} {text.upper()} {words(rng, 50, 6000)}", "s"))
        rows.append((5000 + i, f"{words(rng, 30, 6000)} {' '.join(w if k % 9 else f'{w} extra' for k, w in enumerate(text.split()) if k % 11 != 5)}", "s"))
    got = {r.doc_id: r.item_ids for r in decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert not any(got[i] for i in range(100))
    assert all(got[1000 + i] == [i] and got[5000 + i] == [i] for i, _ in items[::10])


def test_decontamination_of_widely_leaked_and_short_passages(spark):
    """A passage in a third of all documents, one of words that most documents have, and items of one to three words."""
    rng = random.Random(22)
    leak, common = words(rng, 30, 3000) + ". " + words(rng, 8, 3000), [f"the{i}" for i in range(20)]
    plain = common[:]
    rng.shuffle(plain)
    items = [(0, leak), (1, " ".join(plain)), (2, "Zyzzyva"), (3, "quince jelly"), (4, "the3 the1 the2")]
    rows = []
    for i in range(120):
        text = f"{words(rng, 80, 3000)} {' '.join(sorted(common))} {words(rng, 60, 3000)}"
        rows.append((i, text if i % 3 else f"{text} {leak} {words(rng, 20, 3000)}", "s"))
    for i, (_, text) in enumerate(items):
        rows.append((200 + i, f"{words(rng, 90, 3000)} {text} {words(rng, 70, 3000)}", "s"))
    rows += [(300, words(rng, 60, 3000) + " jelly and quince", "s")]
    got = {r.doc_id: r.item_ids for r in decontaminate.find_contamination(table(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert all(got[i] == ([] if i % 3 else [0]) for i in range(120))
    assert all(i in got[200 + i] for i in range(5)) and got[300] == []
