"""The operators against brute force, on rows with nulls, blanks, copies, repeated rows and clashing columns."""

import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from gridloom.llm import decontam, licenses, lines, mixing, search, sharding, simhash, tokens, toxicity
from gridloom.llm.components import connected_components

from .conftest import make, prose


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        up[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(n)]


def test_components(spark):
    rng = np.random.default_rng(0)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (180, 2))] + [(i, i + 1) for i in range(400, 460)]
    got = connected_components(spark.createDataFrame([*edges, (7, 7), (None, 3)], "a long, b long"))
    got = {r["node"]: r["root"] for r in got.collect()}
    want = roots(500, edges)
    touched = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: want[x] for x in touched}


# ---- 1


def test_lines(spark, docs, corpus, none):
    rng = np.random.default_rng(1)
    got = sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["kept"]) for r in lines.find_kept_lines(docs).collect()), key=repr)
    for block in (2, 7):  # large buckets take the way of blocks, with the same outcome
        again = lines.find_kept_lines(docs, block=block).collect()
        assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["kept"]) for r in again), key=repr) == got
    again = lines.find_kept_lines(docs.repartition(7)).collect()  # equal ids go by their texts, however they are dealt
    assert sorted(((r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"], r["kept"]) for r in again), key=repr) == got
    texts = sorted({x for _, t, _ in corpus for x in (t or "").split("\n") if x.strip()})
    sets = [lines.shingles(x) for x in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if lines.alike(sets[i], sets[j])]
    root = dict(zip(texts, roots(len(texts), links)))
    assert len(links) > 5
    kept = sum(len(r[3]) for r in got)
    blank = sum(not x.strip() for _, t, _ in corpus for x in (t or "").split("\n"))
    assert kept == len(set(root.values())) + blank
    first = {}
    for d, t, _ in sorted(corpus, key=lambda r: (r[0] is None, r[0] or 0)):
        for k, x in enumerate((t or "").split("\n")):
            if x.strip():
                first.setdefault(root[x], (d, k))
    by_doc = defaultdict(list)
    for d, k in first.values():
        by_doc[d].append(k)
    unique = {d for d, n in Counter(d for d, _, _ in corpus).items() if n == 1}
    for no_id, d, _, k in got:
        if not no_id and d in unique:
            text = next(t for i, t, _ in corpus if i == d)
            assert k == sorted(by_doc[d] + [i for i, x in enumerate((text or "").split("\n")) if not x.strip()])
    assert lines.find_kept_lines(none).count() == 0
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns and out.count() == len(corpus)
    left = [x for r in out.collect() for x in (r["text"] or "").split("\n") if x.strip()]
    assert len(left) == len(set(root.values())) and rng is not None


def test_line_signature_estimates_similarity():
    a = prose(__import__("random").Random(1), 60)
    b = a[:200] + "X" + a[201:]
    keys = lines.band_keys([a, b, "short", "short", "x" * 400_000])
    assert (keys[0] == keys[1]).any() and (keys[2] == keys[3]).all() and (keys[0] != keys[4]).all()


def test_packed_shingles_decide_as_those_of_the_text():
    import random

    rng, seen = random.Random(9), Counter()
    for _ in range(600):
        letters = rng.choice(["ab", "aé", "aб", "é你ÿ\x00"])
        a = "".join(rng.choices(letters, k=rng.randint(1, 60)))
        at = rng.randrange(len(a))
        b = rng.choice([a, a[:at] + a[at + 1 :], a + rng.choice(letters), "".join(rng.choices(letters, k=20))])
        want = lines.alike(lines.shingles(a), lines.shingles(b))
        assert lines.similar(a, b, lines.packed(a), lines.packed(b)) == want
        seen[want, lines.packed(a) is None] += 1
    assert len(seen) == 4 and min(seen.values()) > 20


def test_maps_rule_out_no_similar_lines():
    import random

    rng = random.Random(3)
    texts = ["", "x", "abcdefgh", "abcdefghi", "\x00" * 9, "x" * 5000, "x" * 3000 + "y" * 20]
    for _ in range(60):
        base = prose(rng, rng.randint(1, 60))
        texts.append(base)
        for _ in range(3):
            at = rng.randrange(len(base))
            texts.append(base[:at] + "".join(rng.choices("abc", k=rng.randint(0, 5))) + base[at + rng.randint(0, 6) :])
    texts = [t for t in texts if t]
    maps, most = lines.bit_maps(texts)
    sets = [lines.shingles(t) for t in texts]
    passed = lines.may_be_alike(maps[:, None], maps[None], most[:, None], most[None])
    similar = np.array([[lines.alike(a, b) for b in sets] for a in sets])
    assert passed[similar].all() and similar.sum() > len(texts) + 20 and passed.sum() < len(texts) ** 2 / 4
    found = lines._Links(texts, list(range(len(texts))))
    found.hold(*np.tril_indices(len(texts), -1))
    want = roots(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if similar[i, j]])
    assert roots(len(texts), found.found) == want
    cut = len(texts) // 2
    links = lines._block_links(texts[:cut], list(range(cut)), texts[cut:], list(range(cut, len(texts))))
    assert all(similar[a, b] for a, b in links)


def test_shared_buckets_over_batches():
    import pyarrow as pa

    rng = np.random.default_rng(0)
    for size in (1, 2, 5, 1000):
        b = np.sort(rng.integers(-40, 40, 150))
        line = rng.integers(0, 6, 150)
        batches = [pa.RecordBatch.from_arrays([pa.array(b[i : i + size]), pa.array(line[i : i + size])], ["bucket", "line"]) for i in range(0, 150, size)]
        got = {(x, y) for out in lines._shared(iter(batches)) for x, y in zip(*(c.to_pylist() for c in out.columns))}
        members = defaultdict(set)
        for x, y in zip(b.tolist(), line.tolist()):
            members[x].add(y)
        assert got == {(x, y) for x, ys in members.items() if len(ys) > 1 for y in ys}


# ---- 2


def test_toxicity(spark, none):
    import random

    rng = random.Random(2)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 5 == 0
        words = prose(rng, 40).split()
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["idiotle", "scumed", "trash"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(toxic)))
    docs = make(spark, [*rows, (1000, None, None), (1001, "", None), (None, "trash", "s"), rows[0]])
    table = spark.createDataFrame([*labels, (5, 0, None), (None, 0, 1), (7, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, table)
    got = toxicity.score(docs, model).collect()
    assert len(got) == 404 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["doc_id"] is not None and r["doc_id"] < 400 and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    assert held and np.mean([(r["score"] >= 0.3) == (r["doc_id"] % 5 == 0) for r in held]) > 0.97
    assert all(r["score"] < 0.3 for r in got if r["doc_id"] in (1000, 1001))
    kept = toxicity.drop_toxic(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["score"] < 0.3 for r in got)
    empty = toxicity.fit(none, table.limit(0))
    assert toxicity.score(none, empty).count() == 0 and len({r["score"] for r in toxicity.score(docs, empty).collect()}) == 1


def test_posteriors_follow_the_votes_and_not_the_labels(spark, monkeypatch):
    import random

    rng = random.Random(6)
    known = [i for i in range(3000) if zlib.crc32(str(i).encode()) % 4 != 2][:600]
    rows, labels = [], []
    for k, i in enumerate(known):
        words = prose(rng, 40).split()
        insults = k % 4 == 0
        for _ in range(6 * insults):
            words.insert(rng.randrange(len(words)), rng.choice(["idiotle", "scumed", "trash"]))
        rows.append((i, " ".join(words), "s"))
        labels.append((i, 1, int(insults != (k in (8, 12, 101, 102)))))  # four labels are wrong
    seen = {}
    model = toxicity.label_model
    monkeypatch.setattr(toxicity, "label_model", lambda t, p: seen.setdefault("got", (t, *model(t, p)))[1:])
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    fitted = toxicity.fit(make(spark, rows), table)
    votes, posterior, learned = seen["got"]
    assert votes.shape == (600, 2 * toxicity.LEXICONS + 2 + len(toxicity.FIXED) + 3) and len(learned["accuracy"]) == votes.shape[1]
    assert (posterior > 0.5).sum() == 150  # the right ones, whatever the labels say
    logit = toxicity.Scorer(fitted["weights"], fitted["bias"])
    assert [logit(rows[k][1]) > 0 for k in (8, 12, 101, 102)] == [True, True, False, False]


def test_label_model_finds_bad_and_repeated_voters():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    vote = lambda right: np.where(rng.random(4000) < right, y, ~y) * 2 - 1
    good, bad = vote(0.9), vote(0.55)
    table = np.column_stack([good, good, vote(0.85), vote(0.8), bad]).astype(float)
    p, learned = toxicity.label_model(table, (table.mean(axis=1) + 1) / 2)
    assert learned["accuracy"][2] > 0.8 > 0.65 > learned["accuracy"][4]
    assert learned["correlation"][0, 1] > 0.9 > 0.3 > abs(learned["correlation"][2, 3])
    assert np.mean((p > 0.5) == y) > 0.9


# ---- 3


def test_differencing_is_close_and_deterministic():
    assert sorted(Counter(sharding.differencing([8, 7, 6, 5, 4], 2)).values()) in ([2, 3],)
    sizes = np.random.default_rng(0).integers(1, 1000, 500).tolist()
    bins = sharding.differencing(sizes, 8)
    sums = np.bincount(bins, sizes, 8)
    assert sums.max() - sums.min() <= 5 and bins == sharding.differencing(sizes, 8)
    hot = sharding.differencing([10_000, *sizes[:50]], 4)
    sums = np.bincount(hot, [10_000, *sizes[:50]], 4)
    assert sums.max() == 10_000 or sums.max() - np.sort(sums)[1] < 1100
    assert sharding.differencing([], 3) == [] and sharding.differencing([4, 4], 1) == [0, 0]


@pytest.mark.parametrize("bricks", [16, 16384])
def test_sharding(docs, corpus, none, bricks):
    got = sharding.shard_documents(docs, 8, bricks=bricks).collect()
    size = lambda t: len((t or "").encode()) + 1
    want = Counter((d, size(t), zlib.crc32((t or "").encode())) for d, t, _ in corpus)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    shards = defaultdict(set)
    for r in got:
        shards[r["text_crc32"]].add(r["shard"])
    assert all(len(s) == 1 for s in shards.values())
    sums = Counter()
    for r in got:
        sums[r["shard"]] += r["size"]
    rest = [n for k, n in sums.items() if n != max(sums.values())]  # the long text has a shard of its own
    assert max(rest) - min(rest) < (60 if bricks > 100 else 1500)
    assert sharding.shard_documents(none, 8).count() == 0


def test_slots_of_a_row_that_stands_often(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 64)
    monkeypatch.setattr(sharding, "RUN", 20)
    rows = [(7, "the same", "a")] * 1000 + [(None, None, None)] * 129 + [(i % 90, f"text {i % 45}", "b") for i in range(300)]
    got = sharding.shard_documents(make(spark, rows), 3).collect()
    want = Counter((d, zlib.crc32((t or "").encode())) for d, t, _ in rows)
    assert Counter((r["doc_id"], r["text_crc32"]) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(got) == len(rows)
    again = sharding.shard_documents(make(spark, rows[::-1]).repartition(7), 3).collect()
    assert Counter(got) == Counter(again)


# ---- 4


def _bm25(rows, k):
    words = [decontam.Words([(t or "").encode()], (decontam._powers(decontam._BASE, 1), decontam._powers(decontam._INVERSE, 1))) for _, t in rows]
    bags = [Counter(w.hash.tolist()) for w in words]
    df = Counter(t for b in bags for t in b)
    n, mean = len(rows), sum(sum(b.values()) for b in bags) / len(rows)
    out = []
    for q, (qid, _) in enumerate(rows):
        if qid is None or qid % 100:
            continue
        found = []
        for d, b in enumerate(bags):
            size = sum(b.values())
            s = sum(np.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * b[t] * 2.2 / (b[t] + 1.2 * (0.25 + 0.75 * size / mean)) for t in bags[q] if t in b)
            if s > 0:
                found.append((-round(s, 6), rows[d][0] is None, rows[d][0] or 0))
        out += [(qid, None if none else d, s, i + 1) for i, (s, none, d) in enumerate(sorted(found)[:k])]
    return out


def test_search(spark, docs, corpus, none):
    want = _bm25([(d, t) for d, t, _ in corpus], 5)
    for how in ({}, {"postings": 300, "query_terms": 40}):
        got = [tuple(r) for r in search.search(docs, docs.filter("doc_id % 100 = 0"), 5, **how).collect()]
        key = lambda r: (r[0], r[3], r[1] is None, r[1] or 0)
        assert len(got) == len(want)
        for a, b in zip(sorted(got, key=key), sorted(want, key=key)):
            assert (a[0], a[3]) == (b[0], b[3]) and a[2] == pytest.approx(-b[2], abs=2e-6)
        assert Counter((r[0], r[1]) for r in got) == Counter((r[0], r[1]) for r in want)
    assert search.search(none, none).count() == 0 and search.search(docs, none).count() == 0


def test_search_prunes_blocks():
    rng = np.random.default_rng(0)
    n = 64 * 50
    docs = np.arange(n)
    tf = np.ones(n)
    tf[100:110] = 50
    lists = ([5, 9], [n, 3], docs.astype("<i8").tobytes(), np.full(n, 100).astype("<i8").tobytes())
    post = np.r_[docs, [101, 102, 103]].astype("<i4").tobytes(), np.r_[tf, [1, 1, 1]].astype("<i4").tobytes()
    shard = search.Shard(*lists, *post, 100.0, n)
    best, scored = shard.search(np.array([0, 1]), np.array([1.0, 5.0]), [], 3)
    assert [d for _, d in best] == [101, 102, 103] and scored < 10 and rng is not None


def test_search_starts_from_scores_of_some_partitions(spark, docs, corpus):
    want = Counter((r[0], r[1], r[3]) for r in _bm25([(d, t) for d, t, _ in corpus], 5))
    got = search.search(docs.repartition(16), docs.filter("doc_id % 100 = 0"), 5, postings=300, query_terms=40).collect()
    assert Counter((r[0], r[1], r[3]) for r in got) == want  # copies tie across partitions, and with the k-th best


def test_search_adds_up_few_postings(monkeypatch):
    rng = np.random.default_rng(0)
    n, n_queries, k = 4000, 20, 10
    ranks, shares = (1, 35, 121, 321, 591, 1164, 4149, 14_800), (0.7, 0.3, 0.15, 0.08, 0.05, 0.03, 0.01, 0.003)  # as in prose
    share = np.exp(np.interp(np.log(np.arange(1, ranks[-1])), np.log(ranks), np.log(shares)))  # of documents, by term
    lists = [np.flatnonzero(rng.random(n) < s) for s in share]
    freqs, doc = np.array([len(x) for x in lists]), np.concatenate(lists)
    tf, lengths = rng.integers(1, 4, len(doc)), np.bincount(doc, minlength=n) * 2
    blobs = (x.tobytes() for x in (np.arange(n).astype("<i8"), lengths.astype("<i8"), doc.astype("<i4"), tf.astype("<i4")))
    idf = np.log(1 + (n - freqs + 0.5) / (freqs + 0.5))
    impact = tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * lengths[doc] / lengths.mean())) * np.repeat(idf, freqs)
    shard = search.Shard(np.arange(len(freqs)), freqs, *blobs, lengths.mean(), n)
    count, added, plain = np.bincount, 0, 0

    def counted(x, *rest, **more):
        nonlocal added
        added += len(x)
        return count(x, *rest, **more)

    for _ in range(n_queries):
        slots = np.flatnonzero(rng.random(len(share)) < share)
        at = search._expand((np.cumsum(freqs) - freqs)[slots], freqs[slots])
        want = np.round(np.bincount(doc[at], impact[at], n), 6)
        order = np.lexsort((np.arange(n), -want))[:k]
        with monkeypatch.context() as m:
            m.setattr(np, "bincount", counted)
            best, _ = shard.search(slots, idf[slots], [], k)
        assert [d for _, d in best] == order.tolist() and np.allclose([-s for s, _ in best], want[order], atol=2e-6)
        plain += len(at)
    assert added < 0.2 * plain, (added, plain)


# ---- 5


def test_licenses(spark, docs, none):
    mit = next(t for n, t in licenses.TEXTS if n == "MIT")
    varied = "Copyright (c) 2020 A. B.\n\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,").replace(". ", ".\n\n")
    rows = [(1, mit, None), (2, varied, None), (3, mit + " more", None), (4, "x\nreleased under the MIT Licence\ny\nAll rights reserved.", None)]
    rows += [(5, None, None), (6, "", None), (None, "ISC", None), (1, mit, None)]
    got = [(r["doc_id"], r["license"], r["notices"]) for r in licenses.scan_licenses(make(spark, rows)).collect()]
    want = [(1, "MIT", []), (2, "MIT", []), (3, None, []), (4, None, ["MIT", "all-rights-reserved"])]
    want += [(5, None, []), (6, None, []), (None, None, []), (1, "MIT", [])]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert licenses.scan_licenses(none).count() == 0 and licenses.scan_licenses(docs).count() == docs.count()
    import re

    assert all(re.search(licenses.TRIGGER, t.lower()) for _, t in licenses.NOTICES)
    texts = [t for _, t in licenses.TEXTS] + ["Été — 你好, WORLD!"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(licenses.canonical(df["t"])).collect()] == [licenses.canonical_text(t) for t in texts]
    assert len(set(licenses._digests(licenses.TEXTS))) == len({licenses.canonical_text(t) for _, t in licenses.TEXTS})


# ---- 6


def test_targets():
    assert mixing.targets([10, 10, 10], [3, 1, 2], Fraction(45)) == [20, Fraction(25, 3), Fraction(50, 3)]
    assert mixing.targets([0, 10], [3, 1], Fraction(15)) == [0, 15] and mixing.targets([], [], Fraction(0)) == []


def test_mixing(spark, docs, corpus, none, tmp_path):
    import re

    n = lambda t: len(re.findall(mixing.SPACE_WORDS, t or ""))
    rows, _, cuts = mixing.plan_mix(docs)
    size, goal = Counter(), {}
    for _, t, s in corpus:
        size[s] += n(t)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weights = [(3, 1, 2)[i % 3] for i in range(len(order))]
    want = mixing.targets([size[s] for s in order], weights, Fraction(3, 2) * sum(size.values()))
    for r in cuts.collect():
        goal[r["source"]] = r["target"]
        assert (r["source_size"], r["target"]) == (size[r["source"]], pytest.approx(float(want[order.index(r["source"])])))
    out = mixing.mix(docs)
    assert out.columns == docs.columns
    taken, copies = Counter(), Counter()
    for r in out.collect():
        taken[r["source"]] += n(r["text"])
        copies[r["doc_id"], r["text"], r["source"]] += 1
    original = Counter((d, t, s) for d, t, s in corpus)
    assert all(copies[x] <= 2 * original[x] for x in copies)
    for s in order:
        longest = max(n(t) for _, t, o in corpus if o == s)
        assert abs(taken[s] - goal[s]) <= 3 * longest
    again = Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == copies
    assert mixing.mix(none).count() == 0 and rows.count() == len(corpus)


def taken_by_hand(rows, weights=(3, 1, 2), share=Fraction(3, 2)):
    """(row, taken) by a queue and a heap of exact finish times; rows: (row, source, size, place)."""
    size = Counter()
    for _, s, n, _ in rows:
        size[s] += n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    goal = mixing.targets([size[s] for s in order], [weights[i % 3] for i in range(len(order))], share * sum(size.values()))
    items = []
    for rank, s in enumerate(order):
        queue = sorted((place, row, n) for row, o, n, place in rows if o == s and n)
        upto = 0
        for _ in range(2):
            for place, row, n in queue:
                upto += n
                items.append((Fraction(upto) / goal[rank], rank, row, n))
    left, taken = int(share * sum(size.values())), Counter()
    for _, _, row, n in sorted(items):
        if n > left:
            break
        left -= n
        taken[row] += n
    return taken, dict(zip(order, goal))


def test_taken_is_that_of_a_queue_served_by_hand(spark, docs, corpus):
    equal = make(spark, [(1, "one two three four five", "s")] * 3000 + [(2, "a b", None)] * 40 + [(i, "x y z", "t") for i in range(900)])
    for table in (docs, equal.repartition(6)):
        rows, _, cuts = mixing.plan_mix(table)
        rows = rows.collect()
        want, goal = taken_by_hand([(r["row"], r["source"], r["size"], r["place"]) for r in rows])
        names = ["source", *(f"cut{p}" for p in range(mixing.PASSES))]
        again = {r["source"]: r for r in cuts.select(*names).collect()}
        got = Counter()
        for r in rows:
            for p in range(mixing.PASSES):
                cut = again[r["source"]][f"cut{p}"]
                if cut is not None and r["size"] and (r["place"], r["doc_id"] or -1) <= (cut["place"], cut["doc_id"] or -1):
                    got[r["row"]] += r["size"]
        assert +got == +want
    # a source of equal rows is cut within them, to one row
    total = Counter()
    for r in mixing.mix(equal).collect():
        total[r["source"]] += len(r["text"].split())
    assert all(abs(total[s] - goal[s]) <= 5 for s in goal) and sum(total.values()) <= 1.5 * (15000 + 80 + 2700)


def test_mixing_query_takes_each_of_many_equal_rows_once_or_twice(spark, tmp_path):
    make(spark, [(1, "w " * 50, "a")] * 3000 + [(2, "v " * 50, "b")] * 1000 + [(3, None, "c")]).write.parquet(f"{tmp_path}/documents.parquet")
    rows = mixing.op6_mixing(spark, str(tmp_path)).collect()
    assert Counter((r["doc_id"], r["size"], r["source_size"]) for r in rows) == {(1, 50, 150000): 3000, (2, 50, 50000): 1000, (3, 0, 0): 1}
    taken, goal = Counter(), {}
    for r in rows:
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["doc_id"]] += r["taken"]
        goal[r["doc_id"]] = r["target"]
    assert all(abs(taken[d] - goal[d]) <= 50 for d in goal) and goal[3] == 0


# ---- 8


@pytest.mark.parametrize("values", [[], [0], [5], [0, 0, 0], [0, 1, 1, 7, 7, 1000], list(range(0, 9000, 3)), [1 << 40, (1 << 40) + 1, 1 << 50]])
def test_elias_fano(values):
    x = tokens.EliasFano.encode(np.array(values, np.uint64))
    packed = x.pack()
    y, end = tokens.EliasFano.unpack(memoryview(b"--" + packed), 2)
    assert end == len(packed) + 2 and y.all().tolist() == values
    assert [y.select(i) for i in range(len(values))] == values
    with pytest.raises(IndexError):
        y.select(len(values))
    if len(values) == 3000:
        assert len(packed) < 8 * len(values) / 8


def test_token_files(spark, docs, corpus, none, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    extra = [(600, "Don't STOP!! it's 12,5 <|endoftext|> é É é İstanbul ΣΑΣ x\u0085y  z", None), (602, "\u0958. Q\u0958, \u0130. \u00c5\u0327.", None), (601, "tab\tand\x0bvt 🙂,. a.b. C++", None)]
    rows = [(d, x) for d, x, _ in corpus + extra]
    both = docs.select("doc_id", "text").union(spark.createDataFrame([(d, x) for d, x, _ in extra], "doc_id long, text string"))
    for name, size in (("a", tokens.SEGMENT_IDS), ("b", 64)):
        tokens.write_tokens(both, str(tmp_path / name), path, segment_ids=size)
        got = tokens.read_tokens(spark, str(tmp_path / name)).orderBy("start").collect()
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
        at = 0
        for r, (d, x) in zip(got, order, strict=True):
            ids = t.encode(x or "", add_special_tokens=False).ids + [1]
            crc = zlib.crc32(np.array(ids, "<u4").tobytes())
            assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (d, at, len(ids), ids, crc)
            at += len(ids)
    other = public.path("byte_bpe_50k.json")  # spaces are part of its tokens
    tokens.write_tokens(both, str(tmp_path / "c"), other)
    b = Tokenizer.from_file(other)
    got = tokens.read_tokens(spark, str(tmp_path / "c")).orderBy("start").collect()
    assert [r["ids"] for r in got] == [b.encode(x or "", add_special_tokens=False).ids + [1] for _, x in order]
    blob = spark.read.parquet(str(tmp_path / "b")).orderBy("task", "number").first()["blob"]
    s = tokens.Segment(bytes(blob))
    assert s.document(0).tolist() == t.encode(order[0][1] or "", add_special_tokens=False).ids + [1]
    with pytest.raises(ValueError):
        tokens.Segment(b"x" * 100)
    tokens.write_tokens(none, str(tmp_path / "none"), path)
    assert tokens.read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_tokenizers_that_keep_case():
    """An end-of-word tokenizer without folding, and one whose marks stick to words."""
    import itertools
    import json

    tokenizers = pytest.importorskip("tokenizers")
    letters = "abcdefgnorstuwxhABCDOTÉé,.!?;:-"
    vocab = {x: i for i, x in enumerate(y for c in letters for y in (c, c + "</w>"))}
    vocab |= {"<unk>": len(vocab)}
    model = {"type": "BPE", "vocab": vocab, "merges": [], "end_of_word_suffix": "</w>", "unk_token": "<unk>", "dropout": None,
             "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False}
    lower = {"type": "Lowercase"}
    for normalizer, pre in itertools.product((None, lower), ("Whitespace", "WhitespaceSplit")):
        data = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": normalizer,
                "pre_tokenizer": {"type": pre}, "post_processor": None, "decoder": None, "model": model}
        t = tokenizers.Tokenizer.from_str(json.dumps(data))
        e = tokens.Encoder(t, 2)
        assert (e.by_word, e.folds) == (pre == "Whitespace", normalizer is not None)
        texts = ["One Two, three. ÉA éa", "", "A", "DO do, Do.", "a-b c;d\ne"]
        for text, got in zip(texts, e.encode(texts)):
            assert np.frombuffer(got, "<u2").tolist() == t.encode(text, add_special_tokens=False).ids


# ---- 9


def test_decontamination(spark, corpus, none):
    import random
    import re

    rng = random.Random(4)
    items = [(i, prose(rng, rng.choice([0, 1, 3, 7, 8, 9, 40]))) for i in range(40)]
    items += [(41, items[5][1]), (7, "repeated id of another text with nine or more words in it"), (None, "no id"), (42, None), (43, "Ünï CODE, words! 12")]
    rows = list(corpus)
    for i in range(30):
        words = items[rng.randrange(40)][1].split()
        cut = words[rng.randrange(1 + len(words) // 2) :]
        rows.append((1000 + i, prose(rng, 10) + " -- " + ", ".join(cut).upper() + "! " + prose(rng, 5), "s"))
    rows.append((1100, "x ünï code 12 words ünï CODE words 12", "s"))
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    spans = defaultdict(set)
    for i, t in items:
        w = split(t)
        k = min(8, len(w))
        if i is not None and k:
            for s in range(len(w) - k + 1):
                spans[tuple(w[s : s + k])].add(str(i))
    want = []
    for d, t, _ in rows:
        w, hit, found = split(t), set(), set()
        for k in {len(x) for x in spans}:
            for s in range(len(w) - k + 1):
                if tuple(w[s : s + k]) in spans:
                    hit |= {*range(s, s + k)}
                    found |= spans[tuple(w[s : s + k])]
        want.append((d, len(w), len(hit), sorted(found)))
    table = spark.createDataFrame(items, "item_id long, text string")
    docs = make(spark, rows)
    got = [tuple(r)[:4] for r in decontam.find_overlaps(docs, table).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and sum(bool(w[3]) for w in want) > 10
    kept = decontam.decontaminate(docs, table)
    long = {x for k in spans if len(k) == 8 for x in [k]}
    full = {d for d, t, _ in rows for w in [split(t)] if any(tuple(w[s : s + 8]) in long for s in range(len(w) - 7))}
    bad = {w[0] for w in want if len(w[3]) > 1 or w[0] in full}
    assert kept.columns == docs.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter(w[0] for w in want if w[0] not in bad)
    one = spark.createDataFrame([(1, "just three words")], "item_id long, text string")  # too short to tell by itself
    mentions = make(spark, [(1, "here are just three words", None), (2, None, None)])
    assert decontam.decontaminate(mentions, one).count() == 2 and decontam.decontaminate(none, one).count() == 0
    assert decontam.find_overlaps(none, table).count() == 0
    assert all(not r["items"] for r in decontam.find_overlaps(docs, table.limit(0)).collect())


# ---- 10


def _print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    hashes = [xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(docs, corpus, none):
    prints = [_print(t) for _, t, _ in corpus]
    got = simhash.near_duplicates(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64)) for r in got) == Counter((d, f) for (d, _, _), f in zip(corpus, prints))
    links = [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    root = roots(len(prints), links)
    least = {}
    for (d, _, _), r in zip(corpus, root):
        if d is not None:
            least[r] = min(d, least.get(r, d))
    by_print = {f: least.get(r) for f, r in zip(prints, root)}
    assert all(r["component_id"] == by_print[r["fp"] % (1 << 64)] for r in got)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    same = make(docs.sparkSession, [corpus[1]] * 500 + [(900, "quite another text than that", "s")] + [(None, None, None)] * 20)
    assert sorted((r["doc_id"] or -1) for r in simhash.drop_near_duplicates(same.repartition(4)).collect()) == [-1, corpus[1][0], 900]
    assert sorted(r["doc_id"] is None or r["doc_id"] for r in kept.collect()) == sorted(least.get(r) is None or least[r] for r in set(root))
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("slab", [1 << 22, 1 << 12])
def test_ball_hashing_finds_every_link(spark, slab, monkeypatch):
    monkeypatch.setattr(simhash, "SLAB", slab)
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 120, np.uint64)
    near = [int(b) ^ sum(1 << int(i) for i in rng.choice(64, rng.integers(1, 7), replace=False)) for b in np.repeat(base, 3)]
    fps = sorted({*map(int, base), *near})
    signed = [f - (f >> 63 << 64) for f in fps]
    edges = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps))
    got = {r["node"] % (1 << 64): r["root"] for r in connected_components(edges).collect()}
    want = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups, found = defaultdict(set), defaultdict(set)
    for f, r in zip(fps, want):
        groups[r].add(f)
    for f in fps:
        found[got.get(f, f)].add(f)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in found.values()}


