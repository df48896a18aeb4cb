"""Scores by masked pseudo-likelihood against plain Python, one position at a time."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import lm

from .conftest import make, prose

TOKEN = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x00-\x20\x7f]")


def split(text):
    return TOKEN.findall((text or "").lower().encode())


def vocabulary(words=(), rare=None):
    """A vocabulary of these words; rare: word -> (count, whether it is kept)."""
    rare = rare or {}
    total, pairs, long = np.zeros(lm.RARE), np.zeros((256, 256)), [0, 0]
    for w, (n, _) in rare.items():
        total[min(len(w), lm.RARE) - 1] += n
        for a, b in zip(b"\0" + w, w):
            pairs[a, b] += n
        if len(w) >= lm.RARE:
            long[0] += n
            long[1] += n * (len(w) - lm.RARE)
    kept = [w for w, (_, keep) in rare.items() if keep]
    return lm.Vocabulary(
        [(w, 5) for w in words], total, np.array([lm.hash_of(w) for w in kept], np.uint64), np.array([float(rare[w][0]) for w in kept]),
        np.array([min(len(w), lm.RARE) - 1 for w in kept], np.int64), pairs, tuple(long),
    )


def by_hand(v, w, text):
    """(tokens, sum) by one position at a time, every logit in float64."""
    words = split(text)
    ids = [v.ids.get(x, min(len(x), lm.RARE) - 1) for x in words]
    code = [lm.PAD] * lm.SIDE + ids + [lm.PAD] * lm.SIDE
    total = 0.0
    for i, (word, goal) in enumerate(zip(words, ids)):
        x = w["bias"].astype(float)
        for k, o in enumerate((0, 1, 3, 4)):
            x = x + w["embed"][code[i + o]].astype(float) * w["place"][k]
        h = np.tanh(x)
        for z, at in (
            (h @ w["class_w"] + w["class_b"], goal // lm.MEMBERS),
            (h @ w["member_w"][goal // lm.MEMBERS] + w["member_b"][goal // lm.MEMBERS], goal % lm.MEMBERS),
        ):
            total += z[at] - np.log(np.exp(z).sum())
        if goal < lm.RARE:
            total += v.encode(lm.Tokens([word.decode()]))[1][0]
    return len(words), total


def test_tokens():
    texts = ["One two-THREE 12, x", None, "", "Ünï  code\n\x00z\x7f", "!", "ß你好 end", " \t"]
    t = lm.Tokens(texts)
    assert t.words(np.arange(len(t))).to_pylist() == [x for text in texts for x in split(text)]
    assert t.n.tolist() == [len(split(x)) for x in texts]
    assert len(set(t.hash.tolist())) == len({x for text in texts for x in split(text)})
    assert lm.hash_of(b"two") == int(t.hash[1]) and len(lm.Tokens([])) == 0


def test_fit_and_score(spark, docs, corpus, none):
    rng = random.Random(0)
    # a language in which a word tells the next
    chain = {w: [f"{w}{a}" for a in "xyz"] for w in "abcdef"}

    def sentence(n=60):
        out = []
        while len(out) < n:
            w = rng.choice("abcdef")
            out += [w, rng.choice(chain[w])]
        return out

    rows = [(i, " ".join(sentence()), "s") for i in range(300)]
    odd = sentence()
    rng.shuffle(odd)
    train = make(spark, [*rows, (900, None, None), (901, "", None), rows[0]])
    model = lm.fit(train, rounds=2)
    asked = [(1, rows[1][1]), (2, " ".join(odd)), (3, None), (4, ""), (None, "a ax"), (5, "ß你 unknownword"), (6, "a " * 30_000)]
    got = {r["doc_id"]: r for r in lm.score(make(spark, [(*x, "s") for x in asked]), model).collect()}
    assert got[1]["mean"] > got[2]["mean"] + 0.2
    for i in (3, 4):
        assert (got[i]["n_tokens"], got[i]["log_likelihood"], got[i]["mean"]) == (0, 0.0, None)
    for i, text in asked[:6]:
        n, total = by_hand(model["vocabulary"], model["weights"], text)
        assert got[i]["n_tokens"] == n and got[i]["log_likelihood"] == pytest.approx(total, rel=1e-4, abs=1e-4)
    assert got[6]["n_tokens"] == 30_000  # over several blocks
    assert lm.score(none, lm.fit(none, rounds=1)).count() == 0
    # another partitioning gives the same model and scores
    again = lm.fit(train.repartition(7), rounds=2)
    assert all((again["weights"][k] == x).all() for k, x in model["weights"].items())
    # scores of texts do not depend on those beside them
    texts = [t for _, t, _ in corpus]
    coded = [model["vocabulary"].encode(lm.Tokens([t]))[0] for t in texts]
    np.testing.assert_allclose(lm.score_ids(coded, model["weights"]), [lm.score_ids([c], model["weights"])[0] for c in coded], rtol=1e-4, atol=1e-3)


def test_every_position_is_trained_on_once(spark, docs, corpus, monkeypatch):
    monkeypatch.setattr(lm, "PER_TRAINER", 1000)
    counts = lm.count_words(docs, "text")
    assert {bytes(r["word"]): r["n"] for r in counts.collect()} == Counter(x for _, t, _ in corpus for x in split(t))
    v, total = lm.vocabulary_of(counts)
    coded = lm.encode_documents(docs, v)
    seen = 0
    for turn in range(3):
        place = lm.F.pmod(lm.F.xxhash64(lm.F.lit(0), "key"), lm.F.lit(3))
        rows = coded.filter("n_tokens > 0").filter(place == turn).select("ids").collect()
        blocks = list(lm.blocks_of(np.frombuffer(r["ids"], "<u2") for r in rows))
        assert all(len(b) <= lm.BLOCK + 2 * lm.SIDE for b in blocks)
        seen += sum(int((b[lm.SIDE : -lm.SIDE] != lm.PAD).sum()) for b in blocks)
    assert seen == total == sum(len(split(t)) for _, t, _ in corpus)
    assert lm.fit_weights(coded, v, total).keys() == lm.initial(v).keys()


def test_gradients():
    rng = np.random.default_rng(1)
    w = {k: v.astype(float) for k, v in lm.initial(vocabulary([b"w"])).items()}
    ids = rng.integers(0, 300, 60).astype(np.uint16)
    ids[[7, 8, 30]] = lm.PAD
    found = lm.Pass(w, ids).gradients()
    loss = lambda: -lm.Pass(w, ids).log_probabilities().sum() / len(lm.Pass(w, ids).row)
    for name, (rows, g) in found.items():
        full = np.zeros_like(w[name])
        full[rows] = g
        at = np.unravel_index(np.abs(full).argmax(), full.shape)
        w[name][at] += 1e-5
        up = loss()
        w[name][at] -= 2e-5
        down = loss()
        w[name][at] += 1e-5
        assert full[at] == pytest.approx((up - down) / 2e-5, rel=1e-3)


def test_probabilities_of_all_tokens_sum_to_one():
    w = lm.initial(vocabulary([b"w"]))
    total = 0.0
    for goal in range(lm.VOCABULARY):
        total += math.exp(lm.Pass(w, np.array([3, 5, goal, 7, lm.PAD], np.uint16)).log_probabilities()[0])
    assert total == pytest.approx(1, abs=1e-4)


def test_rare_words_have_probabilities_of_their_own():
    rare = {b"ab": (40, True), b"ba": (9, False), b"bb": (5, True), b"aa": (3, False), b"b" * 20: (4, False)}
    v = vocabulary([b"xy"], rare)
    own = lambda *words: v.encode(lm.Tokens([" ".join(words)]))[1]
    letters = [bytes([c]).decode() for c in range(97, 123)]
    total = np.exp(own(*("".join(x) for x in itertools.product(letters, repeat=2) if x != ("x", "y")))).sum()
    assert 0.5 < total < 1
    assert own("ab")[0] > own("bb")[0] > own("zz")[0] and own("ba")[0] > own("zz")[0] and own("xy")[0] == 0
    lengths = sum(math.exp(v.stop + k * v.more) for k in range(4000))
    assert lengths == pytest.approx(1)


def test_random_letters_score_below_words_of_the_language(spark, monkeypatch):
    monkeypatch.setattr(lm, "COUNTED", 200)
    rng = random.Random(1)
    syllables = "ba be bi bo bu ka ke ki ko ku la le li lo lu ra re ri ro ru".split()
    word = lambda: "".join(rng.choices(syllables, k=3))
    texts = [" ".join(word() for _ in range(60)) for _ in range(200)]
    v, _ = lm.vocabulary_of(lm.count_words(make(spark, [(i, t, "s") for i, t in enumerate(texts)]), "text"))
    assert len(v.ids) == lm.VOCABULARY - lm.RARE and len(v.rare_hash) <= 200
    rare = [w for w in dict.fromkeys(" ".join(texts).split()) if w.encode() not in v.ids][:40]
    junk = ["".join(rng.choices("bcdfghjkmpqvwxyz", k=6)) for _ in rare]
    (a, x), (b, y) = (v.encode(lm.Tokens([" ".join(t)])) for t in (rare, junk))
    assert a.tolist() == b.tolist() == [5] * len(rare) and x.mean() > y.mean() + 3
    assert prose(rng, 3)
