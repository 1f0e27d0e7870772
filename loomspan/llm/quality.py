"""Quality classifier: hierarchical empirical Bayes over document, path and host evidence.

Two document classifiers (quality, toxicity) are fitted on a bounded sample of labelled rows, from the shape of a text
and from words that tell. Each document's quality log-odds are then combined with what its host and path show: mean
evidence per path (labels where there are any, else the classifier's) is shrunk toward its host, the host's toward the
corpus, each level with a strength of its own, estimated from all groups by moments. The sums are grouped
aggregations with map-side combining, so one host with a third of the rows is no hot spot.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix64, step, words_of
from .minhash import shingle_set

SAMPLE_ROWS = 8000
SAMPLE_CHARS = 50_000
LEXICON = 4096
STEMS = (4, 5, 6, 7)  # letters of a stem
SITE_WEIGHT = 0.25  # what a site's evidence weighs before labels say otherwise
PRIOR = 10.0  # labelled rows' worth of trust in that
EVIDENCE = 4.0  # most that a document, or a label, says of its site
KEEP_FROM = 0.5
_MARKS = re.compile(r"[#$%&*|<>{}\\^~=_@]")
_WORD = re.compile(r"\w+")


def shape(text: str) -> list[float]:
    """Bounded features of a whole text: symbols, capitals, repetition, length."""
    words = text.split()
    n = len(words)
    if not n:
        return [1.0, 0, 0, 0, 0, 0, 0, 1.0, 0]
    distinct = len(set(words))
    letters = sum(map(str.isalpha, text)) / max(1, len(text) - n + 1)
    again = sum(map(str.__eq__, words, words[1:])) / n
    marked = sum(1 for w in words if _MARKS.search(w)) / n
    capitals = sum(1 for w in words if len(w) > 1 and w.isupper()) / n
    top = max(Counter(words).values()) / n if n > 8 else 0.0
    # Distinct words fall with length even in good prose: measured against n ** 0.92.
    return [1.0, min(1.0, 4 * marked), min(1.0, 3 * capitals), min(1.0, 5 * again), min(1.5, distinct / n**0.92), max(0.0, top - 0.2), min(1.0, max(0.0, 0.95 - letters) * 3), float(n < 5), np.log1p(n) / 10]


def forms_of(word: str) -> list[str]:
    """A word and the first letters of a longer one: a stem counts whatever its endings."""
    return [word, *(word[:n] + "*" for n in STEMS if len(word) > n)]


def lexicon_of(text: str) -> set[str]:
    """The distinct words of a text, and their stems."""
    words = set(_WORD.findall(text.lower()))
    found = set(words)
    for n in STEMS:
        found.update({w[:n] + "*" for w in words if len(w) > n})
    return found


def told(text: str, *lists: dict[str, float]) -> list[list[float]]:
    """For each list of telling forms, what each word of a text says: the strongest of its forms."""
    words = set(_WORD.findall(text.lower()))
    forms = words.union(*({w[:n] + "*" for w in words if len(w) > n} for n in STEMS)) if any(lists) else words
    out = []
    for own in lists:
        found = ([own[f] for f in forms_of(w) if f in own] for w in words) if own and not forms.isdisjoint(own) else ()
        out.append([max(x, key=abs) for x in found if x])
    return out


def _fit(x: np.ndarray, y: np.ndarray, ridge: float, prior: np.ndarray | None = None) -> np.ndarray:
    """Logistic weights, drawn to `prior` by a ridge. Without a prior they are drawn to 0, the intercept but little; and
    where all labels agree, only the intercept says so."""
    eye = ridge * np.eye(x.shape[1])
    if prior is None:
        prior = np.zeros(x.shape[1])
        eye[0, 0] = 1e-6
        if len(y) == 0 or y.min() == y.max():
            prior[0] = 4.0 if len(y) == 0 or y.max() == 1 else -4.0
            return prior
    w = prior.copy()
    for _ in range(60 if len(y) else 0):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve((x.T * (p * (1 - p) + 1e-9)) @ x + eye, x.T @ (p - y) + eye @ (w - prior))
        w -= np.clip(move, -5, 5)
        if np.abs(move).max() < 1e-6:
            break
    return w


def _distinct(rows: list[tuple[str, int, int]]) -> list[int]:
    """Indexes without the near copies of earlier rows: those that share one of three minimal shingle hashes."""
    seen: set[tuple[int, int]] = set()
    out = []
    for i, (text, _, _) in enumerate(rows):
        h = shingle_set(words_of(text))
        marks = {(j, int(mix64(h + step(j)).min())) for j in range(3)} if len(h) else {(0, 0)}
        if not marks & seen:
            out.append(i)
        seen |= marks
    return out


def telling_words(yes: Counter, no: Counter, n1: int, n0: int, least: float = 4.0) -> dict[str, float]:
    """word -> log ratio of its rates, for words in three `yes` documents at least that are `least` times as frequent there
    and whose likelihood ratio stands out among as many words as are tried."""
    scored = {}
    for word, a in yes.items():
        b = no[word]
        if a >= 3 and n0:
            rate, other, pooled = a / n1, (b + 0.5) / (n0 + 1), (a + b) / (n1 + n0)
            gain = 2 * (a * np.log(rate / pooled) + (b * np.log(b / n0 / pooled) if b else 0.0))
            if rate > least * other and gain > 2 * np.log(len(yes)):
                scored[word] = float(np.log(rate / other))
    return dict(sorted(scored.items(), key=lambda v: (-v[1], v[0]))[:LEXICON])


def features(text: str, said: list[float]) -> list[float]:
    """The shape of a text, and what its words say for and against it."""
    return [*shape(text), float(np.clip(sum(said) / 4, -3, 3))]


def train(rows: list[tuple[str, int, int]]) -> dict:
    """rows: (text, quality, toxic). Words that mark good, bad and toxic documents are chosen by their likelihood ratios
    over distinct documents; logistic weights go on the shape and on the summed ratios of the words present."""
    own = [rows[i] for i in _distinct(rows)]

    def counted(sign) -> tuple[Counter, Counter, int, int]:
        yes, no, n1 = Counter(), Counter(), 0
        for row in own:
            (yes if sign(row) else no).update(lexicon_of(row[0]))
            n1 += sign(row)
        return yes, no, n1, len(own) - n1

    good, poor = telling_words(*counted(lambda r: bool(r[1]))), telling_words(*counted(lambda r: not r[1]))
    marks = {**{w: -v for w, v in poor.items()}, **good}
    x = np.array([features(t, told(t, marks)[0]) for t, _, _ in rows]) if rows else np.empty((0, 10))
    bad = telling_words(*counted(lambda r: bool(r[2])))
    n1 = sum(bool(t) for _, _, t in own)
    tox = _fit(np.array([_toxic_features(t, told(t, bad)[0]) for t, _, _ in own]), np.array([bool(t) for _, _, t in own], float), 0.02) if n1 and bad else np.array([-6.0, 0.0, 0.0])
    return {"good": _fit(x, np.array([q for _, q, _ in rows], float), 0.05), "told": marks, "toxic": tox, "words": bad}


def _toxic_features(text: str, said: list[float]) -> list[float]:
    return [1.0, min(12.0, sum(said)), np.log1p(text.count(" ")) / 10]  # long texts meet more words by chance


SCORED = "doc_id long, h long, host string, path string, quality_logit double, toxic_logit double"


def shrunken_sites(paths: DataFrame) -> tuple[DataFrame, float]:
    """paths: (host, path, n, s, ss), a row for each path: documents, sum and sum of squares of their evidence. Gives
    (host, path, n, s, host_mean, strength) and the corpus mean; a path's mean is (s + strength * host_mean) / (n + strength).

    Moments over all groups give the variance inside paths, of paths inside hosts and of hosts; a level's strength is
    the variance below it, in documents, over its own."""
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("hb"), F.sum(F.col("n") * F.col("n")).alias("hnn"), F.sum("ss").alias("hss"), F.count("*").alias("hg"))
    c = F.col
    a = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.sum(c("hss") - c("hb")).alias("within"), F.sum("hg").alias("g"), F.count("*").alias("hosts"), F.sum(c("hb") - c("hs") * c("hs") / c("hn")).alias("paths"), F.sum(c("hs") * c("hs") / c("hn")).alias("between"), F.sum(c("hnn") / c("hn")).alias("nn"), F.sum(c("hn") * c("hn")).alias("hh"), F.sum("hnn").alias("pp")).first()
    n = a["n"] or 0
    mean = a["s"] / n if n else 0.0
    inside = max(1e-4, a["within"] / max(1, n - a["g"])) if n else 1.0
    spread = lambda total, free, size: max(1e-4, (total - free) / size) if size > 0 else 1e-4
    of_paths = spread(a["paths"], (a["g"] - a["hosts"]) * inside, n - a["nn"]) if n else 1e-4
    of_hosts = spread(a["between"] - n * mean * mean, (a["hosts"] - 1) * inside + of_paths * (a["nn"] - a["pp"] / n), n - a["hh"] / n) if n else 1e-4
    path_strength, host_strength = max(1.0, inside / of_paths), max(1.0, inside / of_hosts)
    hosts = hosts.select(c("host").alias("h_host"), ((c("hs") + host_strength * mean) / (c("hn") + host_strength)).alias("host_mean"))
    return paths.join(hosts, c("host").eqNullSafe(c("h_host"))).select("host", "path", "n", "s", "host_mean", F.lit(path_strength).alias("strength")), mean


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS, site_weight: float = SITE_WEIGHT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", path_col: str = "lang") -> DataFrame:
    """One row for each input row: doc_id, h (hash of the text), quality, toxic, site, posterior, keep.

    quality and toxic are the document classifiers' probabilities; site is the shrunken mean evidence of the other
    documents of its host and path; posterior joins quality and site, by weights that the labelled sample draws from
    `site_weight`. keep: posterior and 1 - toxic are both 0.5 or more.
    The classifiers are fitted on `sample_rows` labelled rows at most, those of the smallest hash of their id whose
    text has `sample_chars` code points at most; every row is scored on its whole text, and all rows and labels count as
    evidence of their site. Labels of a document that conflict take the lowest quality and the highest toxicity. Without
    labels everything is kept. Null or blank texts are classified by their (empty) shape. Null hosts or paths form
    groups of their own. Repeated rows and null ids stay, one result row each. Empty tables give no rows. Other columns
    are ignored.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    known = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.min("quality").alias("q"), F.max(F.coalesce("toxic", F.lit(0))).alias("t"))
    known = scratch.keep(known, "known")
    sample = known.orderBy(F.xxhash64("l_id", F.lit(11)), "l_id").limit(sample_rows)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.col(host_col).cast("string").alias("host"), F.col(path_col).cast("string").alias("path"), F.xxhash64(text).alias("h"))
    # The sample is bounded by its parameter, so it is small enough to broadcast and to fit on the driver.
    picked = rows.where(F.length("text") <= sample_chars).join(F.broadcast(sample), F.col("doc_id") == F.col("l_id")).groupBy("doc_id").agg(F.min_by(F.struct("text", "q", "t"), "h").alias("x")).select("doc_id", "x.*").orderBy("doc_id").collect()
    model = train([(r.text, r.q, r.t) for r in picked])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, bad = np.empty(batch.num_rows), np.empty(batch.num_rows)
            for i, x in enumerate(batch.column(1)):  # a text at a time
                text = x.as_py()
                marks, words = told(text, model["told"], model["words"])
                good[i], bad[i] = features(text, marks) @ model["good"], _toxic_features(text, words) @ model["toxic"]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(4), batch.column(2), batch.column(3), pa.array(good), pa.array(bad)], names=["doc_id", "h", "host", "path", "quality_logit", "toxic_logit"])

    scored = scratch.keep(rows.mapInArrow(score, SCORED), "scored")
    clipped = F.least(F.greatest(F.col("quality_logit"), F.lit(-EVIDENCE)), F.lit(EVIDENCE))
    marked = scored.join(known, F.col("doc_id") == F.col("l_id"), "left").withColumn("e", F.when(F.col("q").isNull(), clipped).otherwise(F.when(F.col("q") > 0, EVIDENCE).otherwise(-EVIDENCE)))
    marked = scratch.keep(marked.drop("l_id", "t"), "marked")
    paths = marked.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("e").alias("s"), F.sum(F.col("e") * F.col("e")).alias("ss"))
    sites, mean = shrunken_sites(scratch.keep(paths, "paths"))
    sites = sites.toDF("p_host", "p_path", "n", "s", "host_mean", "strength")
    out = marked.join(sites, F.col("host").eqNullSafe(F.col("p_host")) & F.col("path").eqNullSafe(F.col("p_path")))
    # A document does not speak for its own site.
    out = out.withColumn("site", (F.col("s") - F.col("e") + F.col("strength") * F.col("host_mean")) / (F.col("n") - 1 + F.col("strength")))
    fitted = out.where("q is not null").join(F.broadcast(sample.select("l_id")), F.col("doc_id") == F.col("l_id")).groupBy("doc_id", "h").agg(F.min("quality_logit").alias("x"), F.min("site").alias("site"), F.min("q").alias("q")).orderBy("doc_id", "h").limit(2 * sample_rows).collect()
    x = np.array([(1.0, np.clip(r.x, -30, 30), r.site - mean) for r in fitted]).reshape(-1, 3)
    w = _fit(x, np.array([float(r.q > 0) for r in fitted]), PRIOR, np.array([0.0, 1.0, site_weight]))
    logistic = lambda x: 1 / (1 + F.exp(-x))
    joint = float(w[0]) + float(max(w[1], 0.0)) * F.col("quality_logit") + float(max(w[2], 0.0)) * (F.col("site") - F.lit(mean))
    out = out.select("doc_id", "h", logistic(F.col("quality_logit")).alias("quality"), logistic(F.col("toxic_logit")).alias("toxic"), "site", logistic(joint).alias("posterior"))
    return out.withColumn("keep", (F.col("posterior") >= KEEP_FROM) & (F.col("toxic") < KEEP_FROM))
