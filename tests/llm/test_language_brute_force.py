"""Language identification as a whole against loops over characters, words and labels."""

import collections
import math
import random
import unicodedata
import zlib

import pytest

from panelkiln.llm import language_id as L


def script(c):
    for k, spans in enumerate(L.SCRIPTS.values()):
        if any(a <= ord(c) <= b for a, b in spans):
            return k
    return len(L.SCRIPTS)


def words(text):
    out, now = [], ""
    for c in (text or "") + " ":
        if unicodedata.category(c)[0] == "L":
            now += c
        elif now:
            out.append(now)
            now = ""
    return out


def buckets(word):
    points = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in word]
    out = []
    for b, x, a in zip([0, *points[:-1]], points, [*points[1:], 0], strict=True):
        h = (b * 0x9E3779B1 + x * 0x85EBCA77 + a * 0xC2B2AE3D) % 2**32
        h ^= h >> 15
        out.append((h * 0x2C1B3C6D % 2**32) >> (32 - L.BITS))
    return out


def trained(rows):
    grams, letters = collections.defaultdict(collections.Counter), collections.defaultdict(collections.Counter)
    for text, lang in rows:
        for w in words(text) if lang is not None else []:
            grams[lang].update(buckets(w))
            letters[lang][script(w[0])] += len(w)
    langs = sorted({lang for text, lang in rows if lang is not None and text is not None})
    seen = {s: {x for x in langs if letters[x][s] >= max(L.SCRIPT_SHARE * sum(letters[x].values()), 1)} for s in range(L.N_SCRIPTS)}
    total = {x: sum(grams[x].values()) + 0.5 * (1 << L.BITS) for x in langs}
    return langs, lambda x, b: math.log((grams[x][b] + 0.5) / total[x]), {s: f or set(langs) for s, f in seen.items()}


def predicted(text, model):
    langs, score, allowed = model
    own = words(text)
    if not own or not langs:
        return "und", 0.0
    rows = []
    for w in own:
        each = {x: sum(score(x, b) for b in buckets(w)) for x in langs}
        least = min(each.values()) - 2 * L.PENALTY - 1
        rows.append({x: each[x] if x in allowed[script(w[0])] else least for x in langs})
    value, back = dict(rows[0]), []
    for r in rows[1:]:
        top = max(langs, key=lambda x: value[x])
        back.append({x: top if value[top] - L.PENALTY > value[x] else x for x in langs})
        value = {x: max(value[x], value[top] - L.PENALTY) + r[x] for x in langs}
    labels = [max(langs, key=lambda x: value[x])]
    for b in reversed(back):
        labels.append(b[labels[-1]])
    share = collections.Counter()
    for w, x in zip(own, reversed(labels), strict=True):
        share[x] += len(w)
    won = max(langs, key=lambda x: share[x])
    return won, share[won] / sum(share.values())


def test_training_scripts_scores_and_labels_equal_brute_force(spark):
    r = random.Random(17)
    sounds = {"aa": "kantelimoru", "bb": "schwartzenb", "cc": "абвгдежзик", "dd": "kantzäöüsch"}

    def text(lang, n):
        return " ".join("".join(r.choice(sounds[lang]) for _ in range(r.randint(1, 7))) for _ in range(n))

    rows = [(i, text(x, r.randint(1, 30)), x) for i, x in enumerate(r.choices(list(sounds), k=60))]
    rows += [(100 + i, f"{text('aa', r.randint(1, 12))}, {text('cc', r.randint(1, 9))}! {text('bb', 14)}", None) for i in range(20)]
    rows += [(200, None, "aa"), (201, "", "bb"), (202, "123 !?", "bb"), (203, "漢字 かな 한글 ABC", None), (204, "İI ǅ ß", "dd"), (205, "x\x00y", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    taught = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 3 != 1]
    model = L.train(df.where(f"doc_id IN ({', '.join(str(x[0]) for x in taught)})"))
    want = trained([(t, lang) for _, t, lang in taught])
    assert model.languages == want[0]
    found = {x.doc_id: (x.lang_pred, x.score) for x in L.predict(df, model).collect()}
    for i, t, _ in rows:
        lang, score = predicted(t, want)
        assert found[i] == (lang, pytest.approx(score)), i
