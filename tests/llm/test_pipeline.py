"""corpus_pipeline, stage by stage against brute force, and run() against the stages one after another."""

import random
import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from gridloom.llm import mixing, toxicity

from .conftest import make, prose
from .test_operators import _print, roots, taken_by_hand

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(8)
    path = tmp_path_factory.mktemp("tables")
    items = [(i, prose(rng, rng.choice([3, 9, 30]))) for i in range(12)]
    rows, labels = [], []
    for i in range(220):
        words = prose(rng, rng.randint(10, 80)).split()
        if i % 5 == 0:
            for _ in range(3):
                words.insert(rng.randrange(len(words)), rng.choice(["idiotle", "scumed", "trash"]))
        if i % 17 == 1:
            words[5:5] = items[i % 12][1].split()
        rows.append((i, " ".join(words), f"s{i % 3}"))
        labels.append((i, 1, int(i % 5 == 0)))
    rows += [(300 + i, rows[i][1], "s1") for i in range(30)]  # copies, of texts of all kinds
    rows += [(400, None, "s0"), (401, "", None), (None, "no id at all here", "s2"), (None, "no id at all here", "s2")]
    rows += [rows[7]] * 3 + [(500, prose(rng, 5000), None)]
    make(spark, rows).select(*COLUMNS).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), items


@pytest.fixture(scope="module")
def stages(spark, folder):
    """The rows of documents and after each stage."""
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = f"{folder[0]}/stage{i}"
        stage(spark, out[-1], folder[0]).write.parquet(path)
        out.append(spark.read.parquet(path))
    assert all(sorted(x.columns) == sorted(COLUMNS) for x in out[:-1])
    return [[r.asDict() for r in x.collect()] for x in out]


def counted(rows, *names):
    return Counter(tuple(r[c] for c in names or COLUMNS) for r in rows)


def test_toxic_documents_go(spark, folder, stages):
    before, after = stages[:2]
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet")
    model = toxicity.fit(docs, spark.read.parquet(f"{folder[0]}/labels.parquet"))
    logit = toxicity.Scorer(model["weights"], model["bias"])
    assert counted(after) == counted([r for r in before if 1 / (1 + 2.718281828459045 ** -logit(r["text"])) < 0.3])
    toxic = [r for r in before if r["doc_id"] is not None and r["doc_id"] < 220 and r["doc_id"] % 5 == 0]
    gone = counted(before) - counted(after)
    assert counted(toxic, "doc_id").keys() <= {(d,) for d, *_ in gone} and sum(gone.values()) <= 60


def test_one_of_each_group_stays(stages):
    before, after = stages[1:3]
    prints = [_print(r["text"]) for r in before]
    links = [(i, j) for i in range(len(before)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    groups = defaultdict(list)
    for r, root in zip(before, roots(len(before), links)):
        groups[root].append(r)
    want = [min(g, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0))["doc_id"] for g in groups.values()]
    assert Counter(r["doc_id"] for r in after) == Counter(want) and not counted(after) - counted(before)


def test_documents_with_benchmark_spans_go(folder, stages):
    before, after = stages[2:4]
    split = lambda t: re.findall(r"[a-z0-9\x80-\U0010FFFF]+", (t or "").lower())
    spans = defaultdict(set)
    for i, t in folder[1]:
        w = split(t)
        for s in range(max(1, len(w) - 7)):
            spans[tuple(w[s : s + 8])].add(i)
    keep = []
    for r in before:
        w = split(r["text"])
        found = [(k, i) for k in {len(x) for x in spans} for s in range(len(w) - k + 1) for i in spans.get(tuple(w[s : s + k]), ())]
        if not any(k == 8 for k, _ in found) and len({i for _, i in found}) < 2:
            keep.append(r)
    assert counted(after) == counted(keep) and len(keep) < len(before)


def test_sources_are_mixed(spark, folder, stages):
    before, after = stages[3:5]
    rows, _, _ = mixing.plan_mix(spark.read.parquet(f"{folder[0]}/stage2"))
    ids = {}
    by_hand = []
    for r in rows.collect():
        ids[r["row"]] = r["doc_id"]
        by_hand.append((r["row"], r["source"], r["size"], r["place"]))
    taken, _ = taken_by_hand(by_hand)
    size = {row: n for row, _, n, _ in by_hand}
    want = Counter()
    for row, n in taken.items():
        want[ids[row]] += n // size[row]
    assert Counter(r["doc_id"] for r in after) == want and not counted(after).keys() - counted(before).keys()


def test_shards_hold_all_rows_and_near_equal_bytes(spark, folder, stages):
    before, after = stages[4:6]
    assert counted(after, "doc_id", "size") == Counter((r["doc_id"], len((r["text"] or "").encode()) + 1) for r in before)
    sums, slots = Counter(), defaultdict(list)
    for r in after:
        sums[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sorted(slots) == list(range(8))
    rest = sorted(sums.values())[:-1]  # the long text fills a shard of its own
    assert max(rest) - min(rest) < 600
    again = corpus_pipeline.run(spark, folder[0]).collect()
    assert counted([r.asDict() for r in again], "doc_id", "size", "shard") == counted(after, "doc_id", "size", "shard")
