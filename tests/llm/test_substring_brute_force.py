"""Substring dedup against its stated rule, written again without a function of the module.

Texts have sentences of at most ten words and fewer than 51 words, so that neither long sentences are cut nor anchors exist. A run
is the shortest stretch of at least three sentences and ten words that begins at a sentence, or that ends at one.
"""

import random
import re

from panelkiln.llm import substring_dedup


def runs(text):
    """(words of the run, first byte, end byte) of every run."""
    data = (text or "").encode()
    spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", data)]
    if not spans:
        return []
    starts = [0]
    for k, (a, b) in enumerate(spans[:-1]):
        if data[b - 1 : b] in (b".", b"!", b"?") or b"\n" in data[b : spans[k + 1][0]]:
            starts.append(k + 1)
    starts.append(len(spans))
    units, found = len(starts) - 1, set()
    for i in range(units):
        e = next((e for e in range(i + 3, units + 1) if starts[e] - starts[i] >= 10), None)
        if e is not None:
            found.add((i, e))
    for e in range(1, units + 1):
        i = next((i for i in range(e - 3, -1, -1) if starts[e] - starts[i] >= 10), None)
        if i is not None:
            found.add((i, e))
    out = []
    for i, e in sorted(found):
        words = tuple(data[a:b].decode().translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for a, b in spans[starts[i] : starts[e]])
        end = spans[starts[e]][0] if starts[e] < len(spans) else len(data)
        out.append((words, spans[starts[i]][0], end))
    return out


def brute(rows):
    first = {}
    for doc, text in sorted(rows):
        for words, a, _ in runs(text):
            first[words] = min(first.get(words, (doc, a)), (doc, a))
    out = {}
    for doc, text in rows:
        gone = set()
        for words, a, e in runs(text):
            if first[words] < (doc, a):
                gone.update(range(a, e))
        data = (text or "").encode()
        out[doc] = None if text is None else bytes(x for k, x in enumerate(data) if k not in gone).decode()
    return out


def test_cut_texts_equal_the_stated_rule(spark):
    r = random.Random(31)
    sentences = [" ".join(r.choice(["red", "Blue", "é", "seven", "x1", "OR"]) for _ in range(r.randint(2, 7))).capitalize() + r.choice([".", "!", "?", "\n", " ?"]) for _ in range(25)]
    rows = []
    for k in range(120):
        text, n = "", 0
        while True:
            more = [r.choice(sentences) for _ in range(r.randint(1, 4))] if r.random() < 0.5 else sentences[(s := r.randrange(20)) : s + 4]
            n += sum(len(x.split()) for x in more)
            if n > 48 or r.random() < 0.2:
                break
            text += " ".join(more) + " "
        rows.append((k, text))
    rows += [(200, None), (201, ""), (202, " \n "), (203, "One two. Three four. Five six seven eight nine ten. " * 3)]
    found = substring_dedup.remove_repeated(spark.createDataFrame(rows, "doc_id long, text string"))
    got, want = {x.doc_id: x.text for x in found.collect()}, brute(rows)
    assert {k: got[k] for k in want if got[k] != want[k]} == {} and sum(len(want[k] or "") < len(t or "") for k, t in rows) > 40
