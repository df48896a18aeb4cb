"""Toxicity by weak supervision.

Many voters look at a text: lexicons that are mined from labelled rows (whole words, and openings of words,
which catch inflected and compounded forms), fixed lexicons, and patterns. A generative label model, which sees
their votes and no label, starts from the votes' majority and learns by EM how often each voter says what for
either class, and how voters of the same class still agree, which discounts those that repeat each other. Its
posteriors train a logistic regression on openings of words and how often they occur, and that alone scores
every whole text. So labels decide which words are in the lexicons, and nothing after that.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, view

#: Labelled rows that voters, label model and classifier are fitted on, about; features of the classifier.
SAMPLE, FEATURES = 20_000, 4096
#: A feature's log-likelihood gain over chance at least (twice it is a G statistic: p < 0.005), and the L2 penalty.
GAIN, PENALTY = 4.0, 1e-4
#: Mined lexicons of each kind, and the share of labelled documents with an entry that have to be toxic.
LEXICONS, PRECISE = 12, 0.9
#: Lengths of the openings of words that are features besides whole words, and the counts from which on a further
#: feature says so: what a clean text has once by chance a toxic one has again and again.
OPENINGS, TIMES = (3, 4, 5, 6, 7, 8), (2, 3, 5)
#: Words whose features each task remembers at most.
REMEMBERED = 200_000

_WORDS = re.compile(r"[^\W\d_]+")
FIXED = {
    "insults_en": "idiot moron stupid dumb loser trash garbage scum pathetic worthless disgusting clown imbecile",
    "threats_en": "kill die hurt destroy murder",
    "insults_de": "idiot dummkopf blödmann arschloch abschaum trottel versager",
    "insults_fr": "idiot connard abruti crétin imbécile salaud minable",
    "insults_es": "idiota imbécil estúpido basura payaso asqueroso inútil",
}
_MASKED = re.compile(r"\b[a-zA-Z][*#@$]{2,}[a-zA-Z]?\b")
_MARKS = re.compile(r"[!?]{2,}")


def words_of(text: str | None) -> Counter:
    return Counter(_WORDS.findall((text or "").lower()))


def names_of(word: str) -> list[str]:
    """Openings of the word, and the word itself marked by a space."""
    return [word[:n] for n in OPENINGS if len(word) > n] + [word + " "]


def features(words: Counter) -> set[str]:
    """The names of all words, and with a number before them those that occur so often."""
    seen: Counter = Counter()
    for word, n in words.items():
        for name in names_of(word):
            seen[name] += n
    return set(seen).union(f"{k}{x}" for x, n in seen.items() if n >= TIMES[0] for k in TIMES if n >= k)


class Scorer:
    """The logit of a text under a model. Looks each word up once a task, so most cost no more than that."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.bias, self.by_name, self.known = bias, {}, {}
        for x, w in sorted(weights.items()):
            name = x.lstrip("0123456789")
            self.by_name.setdefault(name, []).append((int(x[: len(x) - len(name)] or 1), w))

    def __call__(self, text: str | None) -> float:
        found: dict[str, int] = {}
        for word, n in words_of(text).items():
            names = self.known.get(word)
            if names is None:
                names = tuple(x for x in names_of(word) if x in self.by_name)
                if len(self.known) < REMEMBERED:
                    self.known[word] = names
            for x in names:
                found[x] = found.get(x, 0) + n
        return self.bias + sum(w for x in sorted(found) for k, w in self.by_name[x] if found[x] >= k)


def votes(text: str, found: set[str], lexicons: list[frozenset[str]]) -> list[int]:
    """1 toxic, -1 clean, 0 abstains; found: the features of the text."""
    out = [int(not found.isdisjoint(x)) for x in lexicons]
    half = max(1, len(out) // 2)
    out += [-int(not any(out[:half])), -int(not any(out[half:]))]
    out += [int(not found.isdisjoint({w + " " for w in x.split()})) for x in FIXED.values()]
    capitals, letters = sum(map(str.isupper, text)), sum(map(str.isalpha, text))
    shouted = capitals > 0.5 * letters > 10
    out += [int(bool(_MASKED.search(text))), int(len(_MARKS.findall(text)) > 3), int(shouted)]
    return out


def label_model(table: np.ndarray, start: np.ndarray, rounds: int = 25) -> tuple[np.ndarray, dict]:
    """Posterior of the toxic class for each row of votes (-1, 0, 1), from a start; and what was learned.

    Each voter has a distribution over its votes for either class. How voters vary together within a class
    gives correlations; a voter's evidence is divided by 1 plus its positive correlations with the others."""
    n, m = table.shape
    if not n:
        return np.zeros(0), {"accuracy": np.zeros(m), "correlation": np.zeros((m, m))}
    said = np.stack([table == v for v in (-1, 0, 1)]).astype(float)
    p, weight = start.copy(), np.ones(m)
    for _ in range(rounds):
        prior = np.clip(p.mean(), 1e-3, 1 - 1e-3)
        theta = []
        for q in (1 - p, p):
            c = np.einsum("vij,i->vj", said, q) + 0.5
            theta.append(c / c.sum(axis=0))
        residual = table - (np.outer(1 - p, theta[0][2] - theta[0][0]) + np.outer(p, theta[1][2] - theta[1][0]))
        spread = residual.std(axis=0) + 1e-9
        correlation = residual.T @ residual / n / np.outer(spread, spread)
        np.fill_diagonal(correlation, 0)
        shared = np.clip(correlation, 0, 1)
        weight = 1 / (1 + shared.sum(axis=1))
        ratio = np.log(theta[1]) - np.log(theta[0])
        logit = np.log(prior / (1 - prior)) + np.einsum("vij,vj->i", said, ratio * weight)
        p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
    right = theta[1][2] * prior + theta[0][0] * (1 - prior)
    wrong = theta[0][2] * (1 - prior) + theta[1][0] * prior
    return p, {"accuracy": right / (right + wrong), "correlation": correlation, "weight": weight, "prior": prior}


def majority(table: np.ndarray) -> np.ndarray:
    """A start for the label model from the votes alone: the more of them say toxic than clean, the likelier."""
    return 1 / (1 + np.exp(-table.sum(axis=1)))


def fit_linear(rows: list[np.ndarray], goal: np.ndarray, n_features: int, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty on sets of features against soft labels, by Adam."""
    at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate(rows).astype(np.int64) if len(at) else np.zeros(0, np.int64)
    n = max(1, len(rows))
    w, b = np.zeros(n_features), -2.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for t in range(1, rounds + 1):
        z = np.bincount(at, w[col], len(rows)) + b
        off = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - goal) / n
        g = np.r_[np.bincount(col, off[at], n_features) + PENALTY * w, off.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(text, toxic) of about sample rows that may be learned from, chosen by a hash of their id."""
    labels = view(labels, doc_id=id_col, toxic=label_col).filter("doc_id is not null and toxic is not null")
    labels = labels.filter(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = labels.count()
    labels = labels.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * min(1.0, sample / max(1, n))))
    rows = view(docs, doc_id=id_col, text=F.coalesce(docs[text_col], F.lit("")))
    return rows.join(F.broadcast(labels), "doc_id").select("text", F.col("toxic").cast("int").alias("toxic"))


def held_out(doc_id):
    """Whether a row is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    n_features: int = FEATURES,
) -> dict:
    """{weights: feature -> weight, bias, label_model}: fitted on at most about sample labelled rows.

    Only rows that are not held out are learned from. Ids that are labelled more than once count as toxic if
    any label says so; null ids and labels are left out. Without labelled rows every text scores alike."""
    chosen = durable(_labelled(docs, labels, id_col, text_col, label_col, sample), "labelled")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()

        def flush() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            cols = [pa.array(names, pa.string())] + [pa.array([s[x] for x in names], pa.int64()) for s in seen]
            seen[0].clear()
            seen[1].clear()
            return pa.RecordBatch.from_arrays(cols, ["feature", "clean", "toxic"])

        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                seen[toxic > 0].update(features(words_of(text.as_py())))
                if len(seen[0]) + len(seen[1]) > REMEMBERED:
                    yield flush()
        yield flush()

    size = {bool(r["toxic"]): r["n"] for r in chosen.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n_clean, n_toxic = size.get(False, 0), size.get(True, 0)
    counts = (
        chosen.mapInArrow(count, "feature string, clean long, toxic long")
        .groupBy("feature")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .filter(F.col("clean") + F.col("toxic") >= 3)
    )
    # likelihood ratio of the feature's share of toxic documents against that of all
    share = max(n_toxic, 1e-9) / max(1, n_clean + n_toxic)
    term = lambda a, e: F.when(a > 0, a * F.log(a / e)).otherwise(0.0)
    seen = F.col("clean") + F.col("toxic")
    gain = term(F.col("toxic"), seen * share) + term(F.col("clean"), seen * (1 - share + 1e-9))
    top = counts.filter(gain >= GAIN).orderBy(gain.desc(), "feature").limit(n_features).collect()
    number = {r["feature"]: i for i, r in enumerate(top)}
    precise = [r["feature"] for r in top if r["toxic"] >= PRECISE * (r["toxic"] + r["clean"])]
    kinds = [[x for x in precise if x.endswith(" ")], [x for x in precise if not x.endswith(" ")]]
    lexicons = [frozenset(k[i::LEXICONS]) for k in kinds for i in range(LEXICONS)]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got, said = [], []
            for text in batch.column(0):
                text = text.as_py()
                found = features(words_of(text))
                said.append(votes(text, found, lexicons))
                got.append(sorted(number[x] for x in found & number.keys()))
            cols = [pa.array(got, pa.list_(pa.int32())), pa.array(said, pa.list_(pa.int8()))]
            yield pa.RecordBatch.from_arrays(cols, ["features", "votes"])

    seen_rows = chosen.mapInArrow(look, "features array<int>, votes array<byte>").toArrow()
    n_voters = 2 * LEXICONS + 2 + len(FIXED) + 3
    table = np.array(seen_rows["votes"].to_pylist(), np.int8).reshape(-1, n_voters).astype(float)
    posterior, learned = label_model(table, majority(table))
    rows = [np.array(x, np.int64) for x in seen_rows["features"].to_pylist()]
    w, b = fit_linear(rows, posterior, len(number))
    return {"weights": {x: float(w[i]) for x, i in number.items() if w[i]}, "bias": b, "label_model": learned}


def score(docs: DataFrame, model: dict, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score): the model's probability that the whole text is toxic; a null text counts as empty.
    One row for each row of docs."""
    known = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = Scorer(*known.value)
        for batch in batches:
            z = np.array([logit(text.as_py()) for text in batch.column(1)], float)
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], ["doc_id", "score"])

    rows = view(docs, doc_id=id_col, text=text_col)
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: dict, *, at: float = 0.3, text_col: str = "text") -> DataFrame:
    """docs without the rows whose text scores at least so much; all their columns stay. A null text counts as empty;
    repeated rows go or stay together; an empty table stays empty."""
    known = docs.sparkSession.sparkContext.broadcast((model["weights"], model["bias"]))
    bar, position = float(np.log(at / (1 - at))), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = Scorer(*known.value)
        for batch in batches:
            keep = [logit(text.as_py()) < bar for text in batch.column(position)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )
