"""Every stage of the corpus pipeline against recomputations, on odd tables, and the whole of it on a small one."""

import random
import re

import numpy as np
import pytest

import corpus_pipeline as cp
from loomspan.llm import decontaminate, minhash, mixing, token_output
from loomspan.llm.common import words_of

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, n_id int, k_id int, place string, h long"


def sentence(rng, n):
    return " ".join(f"word{rng.randrange(4000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A benchmark of a few items and labels that call symbols bad and one word toxic."""
    rng = random.Random(4)
    base = str(tmp_path_factory.mktemp("tables"))
    items = [(i, sentence(rng, 30), "x") for i in range(6)] + [(None, "a b c d e f", "x"), (9, None, "x")]
    spark.createDataFrame(items, "item_id long, text string, doc_id string").write.parquet(f"{base}/benchmark.parquet")
    labels = [(i, int(i % 3 != 0), int(i % 10 == 1), "x") for i in range(120)] + [(None, 1, None, None), (5, None, 1, "x")]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int, text string").write.parquet(f"{base}/labels.parquet")
    return base, items


@pytest.fixture(scope="module")
def rows(folder):
    rng = random.Random(5)
    out = []
    for i in range(240):
        text = sentence(rng, rng.randrange(20, 80))
        if i % 3 == 0:
            text = " ".join(rng.choice(["###", "$$", "%%%", "@@", w, w.upper()]) for w in text.split())
        elif i % 10 == 1:
            text = f"{text} vilething {text} vilething"
        out.append((i, text, f"s{i % 3}"))
    copy = out[4][1].split()
    out += [(300 + i, " ".join(copy[:-1] + [f"end{i}"]), "s0") for i in range(5)] + [(310, out[5][1], "s1")]
    out += [(400 + i, f"{sentence(rng, 40)} {t} {sentence(rng, 40)}", "s2") for i, (k, t, _) in enumerate(folder[1][:6])]
    out += [(500, None, "s1"), (501, "", None), (502, " \n", "s1"), (503, "one two", None), (504, sentence(rng, 9000), "s2"), (None, sentence(rng, 50), "s0"), (None, None, None)]
    return out + [out[7], out[7], (8, sentence(rng, 60), "s1"), (8, sentence(rng, 60), "s2")]


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "r", 1, 2, None, 3) for i, t, s in rows], SCHEMA)


def plain(df):
    return sorted(((r.doc_id, r.text, r.source) for r in df.collect()), key=str)


def test_quality_stage_keeps_clean_documents(spark, folder, rows):
    out = cp.quality_stage(spark, table(spark, rows), folder[0])
    assert out.columns == table(spark, []).columns
    kept = plain(out)
    assert all(x in rows for x in kept)
    ids = [i for i, _, _ in kept if i is not None]
    clean = [i for i in range(240) if i % 3 and i % 10 != 1 and i != 8]
    assert len(set(clean) & set(ids)) >= 0.98 * len(clean)
    assert not [i for i in ids if i < 240 and (i % 3 == 0 or i % 10 == 1) and i not in (7, 8)]
    assert ids.count(7) == 3


def test_near_duplicate_stage_keeps_one_of_each_group(spark, folder, rows):
    def shingles(t):
        w = words_of(t)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    known = [(i, shingles(t)) for i, t, _ in rows if i is not None]
    least = {i: i for i, _ in known}
    for _ in range(3):
        for i, a in known:
            for j, b in known:
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    least[i] = least[j] = min(least[i], least[j])
    out = cp.near_duplicate_stage(spark, table(spark, rows), folder[0])
    got = plain(out)
    assert out.columns == table(spark, []).columns and all(x in rows for x in got)
    assert sorted(i for i, _, _ in got if i is not None) == sorted({i for i, m in least.items() if i == m})
    assert sum(i is None for i, _, _ in got) == 2
    assert plain(cp.near_duplicate_stage(spark, table(spark, rows[::-1]).repartition(7), folder[0])) == got


def test_decontamination_stage_drops_holders_only(spark, folder, rows):
    got = plain(cp.decontaminate_stage(spark, table(spark, rows), folder[0]))
    assert got == sorted((r for r in rows if r[0] is None or not 400 <= r[0] < 406), key=str)


def test_mixing_stage_has_the_words_of_the_mix(spark, folder, rows):
    out = cp.mixing_stage(spark, table(spark, rows), folder[0])
    assert out.columns == table(spark, []).columns
    taken = sum(r.taken for r in mixing.mix_sources(table(spark, rows)).collect())
    got = out.collect()
    assert sum(len(re.findall(mixing.WORD, r.text)) for r in got) == taken > 0
    whole = {i: t for i, t, _ in rows}
    assert all(set(r.text.split()) <= set(" ".join(t or "" for i, t, _ in rows if i == r.doc_id).split()) for r in got if r.doc_id in whole)


def test_token_stage_writes_what_it_says(spark, folder, rows):
    got = cp.token_stage(spark, table(spark, rows), folder[0]).collect()
    assert sorted(r.slot for r in got) == list(range(len(got)))
    with open(token_output.TOKENIZER, "rb") as f:
        ranks = f.read()
    assert sum(r.n_tokens for r in got) == sum(len(token_output.token_ids(t or "", ranks)) + 1 for _, t, _ in rows)
    assert {i for r in got for i in r.doc_ids} == {i for i, _, _ in rows}
    assert all(r.first_byte == r.record * 2048 and r.n_bytes == 2048 for r in got)


def test_token_stage_needs_one_python_worker_a_task(spark, folder, rows, monkeypatch):
    """A step that feeds another in the same task would hold a second worker, which stays with the executor."""
    docs, steps = table(spark, rows), []
    plain_step = type(docs).mapInArrow
    monkeypatch.setattr(type(docs), "mapInArrow", lambda *a, **k: steps.append(plain_step(*a, **k)) or steps[-1])
    cp.token_stage(spark, docs, folder[0])
    for step in steps:
        names = [x.strip(" *:+-()0123456789").split(" ")[0] for x in step._jdf.queryExecution().sparkPlan().toString().splitlines()]
        tasks = " ".join(names).split("Exchange")
        assert all(x.count("MapInArrow") <= 1 for x in tasks), names


def test_stages_take_empty_tables(spark, folder):
    none = table(spark, [(1, "x", "s")]).where("doc_id = 2")
    for name, stage in cp.STAGES:
        assert stage(spark, none, folder[0]).count() == 0, name


def test_the_whole_pipeline(spark, sf):
    got = cp.run(spark, sf).collect()
    again = cp.run(spark, sf).collect()
    assert sorted((r.slot, r.doc_ids, r.sha256) for r in got) == sorted((r.slot, r.doc_ids, r.sha256) for r in again) and got
    ids = {i for r in got for i in r.doc_ids}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert ids <= docs.keys()
    found = decontaminate.find_contamination(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert not ids & {r.doc_id for r in found.where("contaminated").collect()}
    groups = [r.component_id for r in minhash.near_duplicates(spark.read.parquet(f"{sf}/documents.parquet")).where(f"doc_id in ({','.join(map(str, ids))})").collect()]
    assert len(groups) == len(ids) and np.mean([docs[i] is not None for i in ids]) == 1


LATER = """
import sys
from pyspark.sql import SparkSession
import corpus_pipeline as cp
from loomspan.llm import token_output
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").config("spark.loomspan.output.dir", sys.argv[2]).getOrCreate()
docs = spark.read.parquet(sys.argv[1])
rows = cp.token_stage(spark, docs, "").collect()
at = token_output.kept_folder(docs)
body = token_output.read_records(f"{at}/files", 0, len(rows))
print("SLOTS", len(rows), body.shape[0], int(body.astype("int64").sum()))
"""


def test_shards_outlive_the_session_and_are_not_written_again(spark, tmp_path):
    """A session of its own, which ends, finds the shards of another: only the one that is gone is written again."""
    import subprocess
    import sys
    from pathlib import Path

    docs = f"{tmp_path}/docs"
    table(spark, [(i, sentence(random.Random(i), 9000), "s") for i in range(60)]).write.parquet(docs)

    def later():
        done = subprocess.run([sys.executable, "-c", LATER, docs, str(tmp_path / "out")], capture_output=True, text=True, timeout=300, check=True, cwd=str(Path(cp.__file__).parent))
        return done.stdout.rpartition("SLOTS")[2].split()

    first = later()
    (folder,) = (tmp_path / "out").iterdir()
    shards = sorted((folder / "files").iterdir())
    before = {p.name: p.stat().st_mtime_ns for p in shards}
    held = shards[0].read_bytes()
    assert len(shards) > 1
    shards[-1].unlink()
    assert later() == first and int(first[0]) == int(first[1]) > 0
    after = {p.name: p.stat().st_mtime_ns for p in (folder / "files").iterdir() if p.suffix == ".bin"}
    assert set(after) == {n for n in before if n.endswith(".bin")} and shards[0].read_bytes() == held
    assert all(after[p.name] == before[p.name] for p in shards[:-1]) and after[shards[-1].name] != before[shards[-1].name]


def test_stages_take_columns_without_a_hash(spark, folder, rows):
    wide = table(spark, rows).selectExpr("*", "map('k', doc_id) m", "parse_json('[1]') v")
    for stage in (cp.near_duplicate_stage, cp.mixing_stage):
        out = stage(spark, wide, folder[0])
        assert out.columns == wide.columns and out.count() == stage(spark, table(spark, rows), folder[0]).count()
