import collections
import math
import random
import re
import zlib

import numpy as np

from panelkiln.llm import hidden_markov as H

SCHEMA = "doc_id long, held boolean, text string, score double, base string, known int"
R = random.Random(9)


def small_model(classes=7, states=3, seed=1):
    draw = np.random.default_rng(seed)
    def shares(*size):
        x = draw.random(size) + 0.05
        return x / x.sum(axis=-1, keepdims=True)

    return H.Model(shares(states), shares(states, states), shares(states, classes).T.copy())


def brute_likelihood(model, text):
    """Sums over all state sequences, token by token, without scaling."""
    k = len(model.start)
    now = [model.start[i] * model.emit[text[0], i] for i in range(k)]
    for c in text[1:]:
        now = [sum(now[i] * model.move[i, j] for i in range(k)) * model.emit[c, j] for j in range(k)]
    return math.log10(sum(now))


def brute_expectations(model, texts):
    """Expected counts from the probability of every state sequence."""
    k = len(model.start)
    emissions, moves, first = np.zeros_like(model.emit), np.zeros((k, k)), np.zeros(k)
    for text in texts:
        paths = [((i,), model.start[i] * model.emit[text[0], i]) for i in range(k)]
        for c in text[1:]:
            paths = [((*p, j), w * model.move[p[-1], j] * model.emit[c, j]) for p, w in paths for j in range(k)]
        total = sum(w for _, w in paths)
        for p, w in paths:
            first[p[0]] += w / total
            for i, c in zip(p, text, strict=True):
                emissions[c, i] += w / total
            for i, j in zip(p, p[1:], strict=False):
                moves[i, j] += w / total
    return emissions, moves, first


def test_recursions_equal_sums_over_all_state_sequences():
    model = small_model()
    for chunk in (1, 2, 3, 100):
        texts = [[R.randrange(7) for _ in range(n)] for n in (1, 6, 2, 5, 1, 4, 7, 3)]
        tokens, sizes = np.concatenate([np.array(t) for t in texts]), np.array([len(t) for t in texts])
        assert np.allclose(H.likelihoods(model, tokens, sizes, chunk), [brute_likelihood(model, t) for t in texts])
        emissions, moves, first, total = H.expectations(model, tokens, sizes, chunk)
        want = brute_expectations(model, texts)
        assert np.allclose(emissions, want[0]) and np.allclose(moves, want[1]) and np.allclose(first, want[2])
        assert math.isclose(total, sum(brute_likelihood(model, t) for t in texts))


def test_long_texts_keep_their_likelihood_when_cut():
    model = small_model(40, 4, 2)
    text = np.random.default_rng(3).integers(0, 40, 30_000)
    whole = H.likelihoods(model, text, np.array([30_000]), 1 << 30)
    assert np.allclose(whole, H.likelihoods(model, text, np.array([30_000]), 777)) and whole[0] < -300  # far below what a double holds


def brute_scores(rows):
    """Counts and base score by the formula, one text at a time."""
    tokens = [re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) + [None] for _, _, t in rows]
    count = collections.Counter(w for (_, held, _), ws in zip(rows, tokens, strict=True) if held is False for w in ws)
    n, v = sum(count.values()), len(count)
    return [(i, held, len(ws), sum(count[w] > 0 for w in ws), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws), 6)) for (i, held, _), ws in zip(rows, tokens, strict=True)]


def found(spark, rows, **settings):
    df = H.scored(spark.createDataFrame([(*r, 1.0, "x", 2) for r in rows], SCHEMA), **settings)
    return sorted(df.collect(), key=repr)


def languages(n, seed):
    """Texts of two made-up languages with function words of their own; words are drawn one by one."""
    r = random.Random(seed)
    out = []
    for i in range(n):
        tongue = i % 2
        out.append(" ".join(r.choice(("da", "ko", "mi") if tongue else ("the", "of", "and")) if r.random() < 0.5 else "".join(r.choice("aiu" if tongue else "eoy") + r.choice("ktn" if tongue else "lrs") for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 120))))
    return out


def test_counts_and_base_scores_equal_brute_force_and_the_model_beats_them(spark):
    texts = languages(160, 1)
    rows = [(i, zlib.crc32(str(i).encode()) % 7 == 2, t) for i, t in enumerate(texts)]
    rows += [(900, False, None), (901, False, ""), (902, True, " \n\t"), (903, True, "unseen WORDS only"), (904, False, "The THE the\x00 é"), (None, None, "the of"), (3, False, texts[3]), (905, True, "the " * 20_000)]
    got = found(spark, rows)
    assert sorted(((*r[:5], round(r.base_score, 6)) for r in got), key=repr) == sorted(brute_scores(rows), key=repr)
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)


def test_training_raises_the_likelihood(spark):
    rows = [(i, False, t, 0.0, "", 0) for i, t in enumerate(languages(80, 2))]
    known, v = H.encoded(spark.createDataFrame(rows, SCHEMA))
    _, curve = H.train(known, v, states=3, rounds=6)
    assert all(b > a for a, b in zip(curve, curve[1:], strict=False))


def test_the_model_is_a_distribution(spark):
    rows = [(i, False, t, 0.0, "", 0) for i, t in enumerate(languages(40, 3))]
    known, v = H.encoded(spark.createDataFrame(rows, SCHEMA))
    model, _ = H.train(known, v, states=3, rounds=2)
    assert np.allclose(model.emit.sum(axis=0), 1) and np.allclose(model.move.sum(axis=1), 1) and math.isclose(model.start.sum(), 1)
    assert v.classes == len(model.emit) and v.tokens == v.class_tokens().sum()


def test_no_training_rows_and_no_rows(spark):
    got = found(spark, [(1, True, "a b"), (2, True, None)])
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got] == [(3, 0, 0, 0.0), (1, 0, 0, 0.0)] and all(math.isfinite(r.score) for r in got)
    assert H.scored(spark.createDataFrame([], SCHEMA)).count() == 0
