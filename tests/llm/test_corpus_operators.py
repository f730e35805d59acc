import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from panelkiln.llm import bpe_codec, chat_format, decontamination, fingerprints, language_id, near_dedup, substring_dedup, token_counts, toxicity, url_filter
from panelkiln.llm.components import connected_components
from panelkiln.llm.pair_merging import PairTable, _merge_by_heap, _merge_long, merge_all
from panelkiln.llm.textops import utf8

tokenizer_files = pytest.importorskip("public_tokenizers")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, doc string, label string, text_a string"
RNG = random.Random(5)
WORDS = ["".join(RNG.choice("abcdefghijklmnop") for _ in range(RNG.randint(2, 8))) for _ in range(400)]


def prose(words: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + ("." if r.random() < 0.15 else "") for _ in range(words))


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", "d", "l", "t") for i, t in rows], DOCS)


@pytest.fixture(scope="module")
def hostile(spark):
    """Nulls in every column, empty and very long texts, repeated rows, clashing names."""
    long = prose(60_000, 1)
    rows = [(1, prose(80, 2)), (2, None), (3, ""), (None, prose(80, 2)), (4, long), (4, long), (5, "a"), (6, " \n\t "), (7, "İ é ﬁ 漢字 😀 </s> <|endoftext|> \x00"), (8, prose(80, 2)), (9, "x" * 30_000)]
    return table(spark, rows).union(spark.createDataFrame([(None,) * 9], DOCS))


def test_components_of_chains_stars_and_repeats(spark):
    edges = [(i, i + 1) for i in range(100, 140)] + [(1, k) for k in range(2, 30)] + [(2, 1), (7, 7), (None, 3)]
    found = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 100 for i in range(100, 141)) and all(found[i] == 1 for i in range(1, 30)) and len(found) == 41 + 29
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_sets(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return set() if not words else {tuple(words[k : k + width]) for k in range(max(1, len(words) - width + 1))}


def brute_components(rows, width, percent):
    sets = {i: brute_sets(t, width) for i, t in rows}
    label = {i: i for i in sets}
    for _ in range(len(sets)):
        before = dict(label)
        for a in sets:
            for b in sets:
                shared = len(sets[a] & sets[b])
                if a < b and sets[a] and sets[b] and 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
                    label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return {i: (len(sets[i]), label[i], label[i] == i) for i in sets}


def edited_copies(n, edits, seed):
    r, base = random.Random(seed), prose(150, seed).split()
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(r.randint(*edits)):
            words[r.randrange(len(words))] = r.choice(WORDS)
        out.append(" ".join(words))
    return out


def test_near_duplicates_match_brute_force(spark):
    texts = edited_copies(40, (0, 16), 3) + edited_copies(12, (4, 10), 4) + [prose(60, k) for k in range(10, 30)] + ["one", "ONE", "one two", "", None, "x y z"] + [prose(60, 10)] * 5
    rows = list(enumerate(texts))
    found = near_dedup.near_duplicates(table(spark, rows), width=2).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in found} == brute_components(rows, 2, 80)


def test_near_duplicates_in_large_mixed_buckets(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SMALL", 1)  # everything goes through differences from the hub
    rows = list(enumerate(edited_copies(60, (2, 14), 8)))
    found = near_dedup.near_duplicates(table(spark, rows), width=2).collect()
    assert {r[0]: (r[1], r[2], r[3]) for r in found} == brute_components(rows, 2, 80)


def test_near_duplicates_of_hostile_and_empty_tables(spark, hostile):
    rows = near_dedup.near_duplicates(hostile, width=5).collect()
    assert len(rows) == 12
    by = {r[0]: r for r in rows if r[0] is not None}
    assert by[1].component_id == by[8].component_id == 1 and not by[8].kept and by[2].n_shingles == 0 and by[2].kept
    assert all(r.kept and r.component_id is None for r in rows if r[0] is None)
    assert near_dedup.near_duplicates(hostile.limit(0)).count() == 0


def test_hyperminhash_estimates_are_close():
    r = random.Random(2)
    words = [str(r.random()) for _ in range(3000)]
    a, b = " ".join(words[:2500]), " ".join(words[300:2800])
    h, bounds = near_dedup.shingle_sets(*utf8(pa.array([a, b])), 1)
    x, y = near_dedup.registers(h, bounds)
    assert abs((x == y).mean() - 2200 / 2800) < 0.09
    assert abs(near_dedup.estimate((x & 15 == y & 15).mean()) - 2200 / 2800) < 0.09


def test_repeated_passages_go_and_clean_texts_stay(spark):
    passage = prose(70, 77)
    rows = [(1, prose(50, 1) + " " + passage + " " + prose(50, 2)), (2, prose(30, 3) + " " + passage + " " + prose(40, 4)), (3, prose(90, 5)), (4, passage), (5, None), (6, "")]
    found = {r.doc_id: r for r in substring_dedup.remove_repeated(table(spark, rows)).collect()}
    assert found[1].text == rows[0][1] and found[3].text == rows[2][1] and found[5].text is None and found[6].text == ""
    middle = " ".join(passage.split()[25:45])
    assert middle in found[1].text and middle not in found[2].text and middle not in found[4].text
    assert set(found[2].text.split()) <= set(rows[1][1].split()) and found[2].key == "k" and found[2].span_hits > 0


def test_substring_dedup_matches_brute_force(spark):
    texts = [prose(120, k % 7) + "\n" + prose(60, 50 + k) for k in range(20)]
    docs = table(spark, list(enumerate(texts)))
    data, offsets = utf8(pa.array(texts))
    words = substring_dedup.Words(data, offsets, substring_dedup.NON_SPACE)
    starts = substring_dedup.sentence_starts(words, data)
    s, e = substring_dedup.runs(words, starts)
    seen, gone = {}, {k: [] for k in range(20)}
    for a, b in sorted(zip(s.tolist(), e.tolist(), strict=True)):
        doc = int(np.searchsorted(words.of_doc, starts[a], side="right")) - 1
        begin = int(words.starts[starts[a]])
        end = int(words.starts[starts[b]]) if starts[b] < words.of_doc[doc + 1] else int(offsets[doc + 1])
        key = tuple(data[begin:end].tobytes().decode().lower().split())
        if key in seen:
            gone[doc].append((begin - int(offsets[doc]), end - int(offsets[doc])))
        seen.setdefault(key, doc)
    expected = {k: substring_dedup.cut_text(t, gone[k]) for k, t in enumerate(texts)}
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeated(docs).collect()} == expected


def unaligned(r, length):
    """Words in sentences of 15, begun and ended inside one, or without any sentence end."""
    skip = r.choice([0, 3, 7, None])
    return [r.choice(WORDS) + ("." if skip is not None and (k + skip) % 15 == 14 else "") for k in range(length)]


def test_repeats_of_over_50_words_go_wherever_they_begin(spark):
    r, rows, repeats = random.Random(11), [], []
    for length in range(51, 63):
        for _ in range(6):
            passage = unaligned(r, length)
            repeats.append(passage)
            rows += [" ".join([*unaligned(r, r.randrange(40)), *passage, *unaligned(r, r.randrange(40))]) for _ in range(2)]
    fixed = [f"{k}." if k % 15 == 11 else f"w{k}" for k in range(54)]  # the advice's case: 12 words, 15, 15, 12
    rows += [" ".join(["p1 p2 p3", *fixed, "q1 q2 q3."]), " ".join(["x1 x2 x3", *fixed, "y1 y2 y3."])]
    rows += [" ".join(["again"] * 300), "so " + " ".join(["again"] * 200), " ".join(["tick tock"] * 150)]
    found = {x.doc_id: x.text for x in substring_dedup.remove_repeated(table(spark, list(enumerate(rows)))).collect()}

    def windows(text):
        words = text.split()
        return [tuple(words[k : k + 51]) for k in range(len(words) - 50)]

    assert len(windows(rows[-3])) == 250 and len(repeats) == 72
    kept = [w for k in range(len(rows)) for w in windows(found[k])]
    assert len(kept) == len(set(kept))
    assert all(" ".join(p) in found[2 * k] for k, p in enumerate(repeats))


def test_substring_dedup_filter_only_lets_through_too_much(spark, monkeypatch):
    docs = table(spark, [(k, prose(120, k % 7) + "\n" + prose(60, 50 + k)) for k in range(20)])
    expected = {x.doc_id: x.text for x in substring_dedup.remove_repeated(docs).collect()}
    monkeypatch.setattr(substring_dedup, "repeated_filter", lambda texts: zstandard.compress(np.full(1 << (substring_dedup.FILTER_BITS - 3), 255, np.uint8).tobytes()))
    assert {x.doc_id: x.text for x in substring_dedup.remove_repeated(docs).collect()} == expected


def test_substring_dedup_of_hostile_and_empty_tables(spark, hostile):
    rows = substring_dedup.remove_repeated(hostile).collect()
    assert len(rows) == 12 and sum(r.text is None for r in rows) == 2
    assert next(r for r in rows if r.doc_id == 1).text == prose(80, 2) and next(r for r in rows if r.doc_id == 8).text != prose(80, 2)
    assert substring_dedup.remove_repeated(hostile.limit(0)).count() == 0


def brute_contamination(docs, items):
    out = {}
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {i: {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))} for i, t in items if (w := find(t))}
    for d, t in docs:
        w, hit, who = find(t), set(), set()
        for i, own in windows.items():
            for n in {len(x) for x in own}:
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) in own:
                        hit |= set(range(k, k + n))
                        who.add(str(i))
        out[d] = (len(w), len(hit), sorted(who), 0 < len(hit) and 20 * len(hit) >= len(w))
    return out


def test_decontamination_matches_brute_force(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_BYTES", 300)  # several blocks of items, and one item of several blocks
    items = [(k, prose(30, 900 + k)) for k in range(8)] + [(60, prose(300, 1)), (61, "x" * 900 + " " + "y" * 20)] + [(50, "Short one, here"), (51, "..."), (52, None), (50, "Short one, here")]
    docs = [(1, prose(60, 1) + " " + items[0][1]), (2, items[3][1][20:150].upper()), (3, prose(900, 2) + " short-one: HERE! " + prose(10, 3)), (4, None), (5, ""), (6, items[0][1] + " " + items[0][1] + " " + items[1][1]), (7, prose(100, 9))]
    found = decontamination.judged(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for r in found} == brute_contamination(docs, items)


def test_item_pieces_keep_all_windows():
    words = re.findall(r"[a-z]+", text := prose(400, 77).lower())
    parts = [re.findall(r"[a-z]+", p) for p in decontamination._item_pieces(text, 13, 300)]
    assert len(parts) > 3 and all(len(p) >= 13 for p in parts)
    assert [tuple(p[k : k + 13]) for p in parts for k in range(len(p) - 12)] == [tuple(words[k : k + 13]) for k in range(len(words) - 12)]


def test_proximity_matches(spark):
    item = "alpha beta gamma delta epsilon"
    docs = [(1, "one alpha gamma x beta delta epsilon two"), (2, "alpha beta gamma and very much later comes delta and epsilon"), (3, item), (4, "alpha beta gamma delta")]
    index = decontamination.build_index(table(spark, docs))
    found = {(r.doc_id, r.kind) for r in decontamination.matches(index, spark.createDataFrame([(9, item)], "item_id long, text string"), slack=2).collect()}
    assert found == {(1, "near"), (3, "phrase")}


def test_decontamination_of_hostile_and_empty_tables(spark, hostile):
    none = spark.createDataFrame([], "item_id long, text string")
    rows = decontamination.judged(hostile, none).collect()
    assert len(rows) == 12 and not any(r.contaminated for r in rows)
    assert decontamination.judged(hostile.limit(0), none).count() == 0


def random_table(r):
    pairs = {}
    for rank in range(60):
        pairs.setdefault((r.randrange(14), r.randrange(14)), (r.randrange(60), 5 + len(pairs) % 9))
    keys = list(pairs)
    return pairs, PairTable(np.array([k[0] for k in keys]), np.array([k[1] for k in keys]), np.array([pairs[k][0] for k in keys]), np.array([pairs[k][1] for k in keys]))


def test_array_merging_equals_the_sequential_algorithm():
    r = random.Random(4)
    for _ in range(40):
        pairs, merges = random_table(r)
        sequences = [[r.randrange(14) for _ in range(r.randrange(0, 25))] for _ in range(30)]
        expected = []
        for s in sequences:
            s = list(s)
            while best := min(((pairs[(a, b)][0], k) for k, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (a, b) in pairs), default=None):
                k = best[1]
                s[k : k + 2] = [pairs[(s[k], s[k + 1])][1]]
            expected.append(s)
        flat = np.array([x for s in sequences for x in s], np.int32)
        out, bounds = merge_all(flat, np.concatenate([[0], np.cumsum([len(s) for s in sequences])]), merges)
        assert [out[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)] == expected
        one = _merge_long if merges.ordered else _merge_by_heap
        assert [one(np.array(s, np.int32), merges).tolist() if len(s) > 1 else s for s in sequences] == expected
    for _ in range(40):  # lists of merges, as tokenizer files have them: each makes a new symbol
        pairs = []
        for k in range(30):
            pairs.append((r.randrange(3 + k), r.randrange(3 + k), k, 3 + k))
        merges = PairTable(*(np.array(x, np.int64) for x in zip(*pairs, strict=True)))
        long = np.array([r.randrange(3) for _ in range(400)], np.int32)
        assert merges.ordered and _merge_long(long, merges).tolist() == _merge_by_heap(long, merges).tolist()


def odd_texts():
    r = random.Random(6)
    fixed = ["", "It's we'll they're 's 't '' \"'s 'sam 'llama '", "İstanbul ΣΑΣ Å", "123 4a5 ½ Ⅷ", "<|startoftext|>Hi<|endoftext|>", "<s> </s> <unk>", "x" * 3000, "  a   b ", "▁▁ x", "\x00\x1c\x85", "日本 😀"]
    random_texts = [*("".join(chr(r.choice([32, 39, r.randint(97, 122), r.randint(1, 0x2FF), r.randint(0x300, 0x1FFF), 10])) for _ in range(60)) for _ in range(80))]
    mixed = ["İ\u0327\u1c89", *("".join(r.choice(["İ", "I", "\u0307", "\u0327", "\u0301", "\u0345", "a", "é", "\u1c89", "\u0378", "\U0001fae8", " ", "<|endoftext|>", "Σ"]) for _ in range(r.randint(2, 14))) for _ in range(300))]
    late = ["x\u1c89\u1c8ay", "\ua7cb1\ua7cd", "\U0001fae8\u2ffc\U0002ebf0a", "<|endoftext|>\u1c89<|startoftext|>", "\u0378\uffff"]
    return [*fixed, *mixed, *late, *random_texts, *thue_morse(), prose(500, 3)]


def thue_morse():
    """Words whose polynomial hashes modulo 2^64 are equal, with any multiplier, to those of their complements."""
    word = "a"
    while len(word) < 4096:
        word += word.translate(str.maketrans("ab", "ba"))
    return [f"{word[:n]} {word[:n].translate(str.maketrans('ab', 'ba'))}" for n in (1024, 2048, 4096)]


def test_hashes_tell_thue_morse_words_apart(spark):
    from panelkiln.llm import textops

    for text in thue_morse():
        data, offsets = utf8(pa.array(text.split()))
        assert len(set(textops.Words(data, offsets).hashes.tolist())) == 2
        assert textops.distinct_spans(data, offsets[:-1], offsets[1:])[1].tolist() in ([0, 1], [1, 0])
    rows = [(k, x) for k, x in enumerate(" ".join(thue_morse()).split())]
    assert len({r.component_id for r in near_dedup.near_duplicates(table(spark, rows), width=2).collect()}) == 6
    items = spark.createDataFrame([(1, rows[0][1])], "item_id long, text string")
    assert [r.doc_id for r in decontamination.judged(table(spark, rows), items).where("contaminated").collect()] == [0]
    repeated = [(0, rows[0][1] + " " + prose(60, 1)), (1, rows[1][1] + " " + prose(60, 2))]
    assert {r.doc_id: r.text for r in substring_dedup.remove_repeated(table(spark, repeated)).collect()} == dict(repeated)


def test_equal_hashes_of_different_spans_stay_apart(monkeypatch):
    from panelkiln.llm import textops

    monkeypatch.setattr(textops, "span_hashes", lambda values, starts, ends: np.zeros(len(starts), np.uint64))
    values, bounds = np.array([1, 2, 1, 2, 3, 3]), np.array([0, 2, 4, 5, 6, 6])
    first, which = textops.distinct_spans(values, bounds[:-1], bounds[1:])
    spans = [values[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
    assert [spans[first[k]] for k in which] == spans


def test_token_counts_equal_the_library(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    path = tokenizer_files.path("piece_bpe_32k.model")
    library, texts = sentencepiece.SentencePieceProcessor(model_file=path), odd_texts()
    rows = token_counts.token_counts(table(spark, list(enumerate([*texts, None]))), path).collect()
    assert {r.doc_id: (r.n_bytes, r.n_tokens) for r in rows} == {k: (len(t.encode()), len(library.encode(t))) for k, t in enumerate([*texts, ""])}


def test_bpe_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    path = tokenizer_files.path("word_bpe_49k.json")
    library, texts = tokenizers.Tokenizer.from_file(path), odd_texts()
    docs = table(spark, list(enumerate([*texts, None])))
    encoded = bpe_codec.encode(docs, path)
    decoded = {r.doc_id: r.text for r in bpe_codec.decode(encoded, path).collect()}
    for r in encoded.collect():
        ids = library.encode(([*texts, ""])[r.doc_id], add_special_tokens=False).ids
        assert np.frombuffer(bytes(r.ids), np.uint32).tolist() == ids
        assert decoded[r.doc_id] == library.decode(ids, skip_special_tokens=False)


def test_tokenizers_on_hostile_and_empty_tables(spark, hostile):
    piece, word = tokenizer_files.path("piece_bpe_32k.model"), tokenizer_files.path("word_bpe_49k.json")
    assert token_counts.token_counts(hostile, piece).count() == bpe_codec.round_trip_digests(hostile, word).count() == 12
    assert token_counts.token_counts(hostile.limit(0), piece).count() == bpe_codec.round_trip_digests(hostile.limit(0), word).count() == 0


def test_toxicity_learns_the_planted_words(spark):
    r = random.Random(9)
    rows = [(k, prose(60, 2000 + k) + (" " + " ".join(r.sample(["vile", "rotten", "nasty", "foul"], 2)) if k % 5 == 0 else "")) for k in range(400)]
    docs = table(spark, rows)
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(300)], "doc_id long, label int")
    weights = toxicity.fit(docs, labels)
    found = {x.doc_id: x.toxicity for x in toxicity.score(docs, weights).collect()}
    assert np.mean([(found[k] >= 0.5) == (k % 5 == 0) for k in range(300, 400)]) >= 0.95
    assert len(weights.buckets) < 2000


def test_toxicity_learns_rare_terms_from_many_rows(spark):
    """A word of eight toxic rows counts at 6,400 rows as at fewer, however a hash would deal the rows to tasks."""
    halves = {True: [], False: []}
    for x in spark.range(6400).selectExpr("id", "pmod(xxhash64(id), 3) = 0 AS half").orderBy("id").collect():
        halves[x.half].append(x.id)
    rare, common = {*halves[True][:4], *halves[False][:4]}, {*halves[True][4:200], *halves[False][4:200]}
    r = random.Random(17)
    text = lambda k: " ".join([*(r.choice(WORDS) for _ in range(4)), *(["grumbolt"] if k in rare else ["foulword"] if k in common else [])])
    docs = table(spark, [(k, text(k)) for k in range(6400)])
    labels = spark.createDataFrame([(k, int(k in rare or k in common)) for k in range(6400)], "doc_id long, label int")
    weights = toxicity.fit(docs, labels)
    _, bucket = toxicity.features(*utf8(pa.array(["grumbolt"])))
    found = dict(zip(weights.buckets.tolist(), weights.values.tolist(), strict=True))
    assert found.get(int(bucket[0]), 0) > 0


def test_toxicity_of_hostile_and_empty_tables(spark, hostile):
    none = spark.createDataFrame([], "doc_id long, label int")
    rows = toxicity.score(hostile, toxicity.fit(hostile, none)).collect()
    assert len(rows) == 12 and all(0 <= r.toxicity <= 1 and r.toxicity < 0.5 for r in rows) and rows[0].key == "k"
    assert toxicity.score(hostile.limit(0), toxicity.fit(hostile.limit(0), none)).count() == 0


def test_viterbi_equals_brute_force():
    import itertools

    draw = np.random.default_rng(3)
    assert language_id.viterbi(np.array([[0, 20, -100], [0, -100, 20.0]]), np.array([0, 2]), 25.0).tolist() == [1, 2]
    for _ in range(400):
        labels, sizes = int(draw.integers(2, 6)), draw.integers(0, 6, draw.integers(1, 4))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        scores = draw.choice([-100, -26, -24, 0, 5, 13, 20, 24, 26], (bounds[-1], labels)) + draw.random((bounds[-1], labels))
        found = language_id.viterbi(scores, bounds, 25.0)
        for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            paths = itertools.product(range(labels), repeat=e - s)
            best = max(paths, key=lambda p: sum(scores[s + t, k] for t, k in enumerate(p)) - 25.0 * sum(x != y for x, y in zip(p, p[1:], strict=False)))  # noqa: B023
            assert found[s:e].tolist() == list(best)


def test_ftrl_equals_the_plain_recursion():
    draw = np.random.default_rng(4)
    rows = [np.append(np.unique(draw.integers(0, 60, 12)), 1 << toxicity.BITS).astype(np.int32) for _ in range(300)]
    labels = np.array([float(r[0] < 3) for r in rows])
    z, n = {}, {}

    def weight(k):
        limit = 0.0 if k == 1 << toxicity.BITS else toxicity.L1
        x = z.get(k, 0.0)
        return 0.0 if abs(x) <= limit else -(x - np.sign(x) * limit) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for i in order.permutation(len(rows)).tolist():
            w = {k: weight(k) for k in rows[i].tolist()}
            g = 1 / (1 + np.exp(-sum(w.values()))) - labels[i]
            for k, old in w.items():
                have = n.get(k, 0.0)
                z[k] = z.get(k, 0.0) + g - ((have + g * g) ** 0.5 - have**0.5) / toxicity.ALPHA * old
                n[k] = have + g * g
    buckets, found = toxicity.learned(list(rows), labels)
    got = dict(zip(buckets.tolist(), found.tolist(), strict=True))
    assert all(abs(got.get(k, 0.0) - weight(k)) < 1e-9 for k in z) and np.count_nonzero(found) > 2


def test_language_spans(spark):
    english, german, russian = "the house and the garden with that thing ", "der hund und die katze nicht schön ", "это просто русский текст про дом "
    rows = [(1, english * 5, "en"), (2, german * 5, "de"), (3, russian * 5, "ru"), (4, None, "en"), (5, "x", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = table(spark, [(1, english), (2, german), (3, russian), (4, english * 3 + german * 3), (5, "12 %"), (6, None), (7, "")])
    found = {r.doc_id: r for r in language_id.predict(docs, model, with_spans=True).collect()}
    assert [found[k].lang_pred for k in range(1, 8)][:3] == ["en", "de", "ru"] and [found[k].lang_pred for k in (5, 6, 7)] == ["und"] * 3 and found[5].score == 0
    assert [s.lang for s in found[4].spans] == ["en", "de"] and found[4].spans[0].n_words == 24
    empty = language_id.train(spark.createDataFrame([], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language_id.predict(docs, empty).collect()} == {"und"}


def test_language_of_hostile_and_empty_tables(spark, hostile):
    model = language_id.train(hostile)
    assert language_id.predict(hostile, model).count() == 12 and language_id.predict(hostile.limit(0), model).count() == 0


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://a.Example.COM/en/75?x", ("a.example.com", "/en/75", "example.com/en/7", "allow")), ("http://x.com/en/", ("x.com", "/en/", "com/en/", "block")), ("http://dotcom/en/", ("dotcom", "/en/", None, "allow")),
        ("http://example.net/de/8", ("example.net", "/de/8", "example.net/de/8", "block")), ("x://h#f/en/", ("h", "", None, "allow")), (None, ("", "", None, "allow")), ("no scheme /en/", ("", "", None, "allow")),
        ("http://a.fr/PORN-pics", ("a.fr", "/PORN-pics", None, "block")), ("http://a.fr/pornography", ("a.fr", "/pornography", None, "allow")), ("http://casino.fr/casino", ("casino.fr", "/casino", None, "allow")), ("http://casino.fr/poker", ("casino.fr", "/poker", None, "block")),
    ],
)
def test_url_verdicts(url, expected):
    judge = url_filter.Judge(list(url_filter.RULES), list(url_filter.STRICT), list(url_filter.SOFT), 2)
    assert judge.judge(url)[:4] == expected


def test_urls_of_empty_tables_and_without_terms(spark):
    pages = spark.createDataFrame([(1, None, "h"), (1, "http://porn.com/", "h"), (None, "", None)], "page_id long, url string, html string")
    assert url_filter.judge_urls(pages).count() == 3 and url_filter.judge_urls(pages.limit(0)).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules=(), strict=(), soft=()).collect()} == {"allow"}


def test_vocabulary_from_a_table(spark):
    terms = spark.createDataFrame([("BadWord", True), ("meh", False), ("meh", True), ("so-so", None), ("blah", False), (None, True), ("", False)], "term string, strict boolean")
    strict, soft = url_filter.read_vocabulary(terms)
    assert strict == ["BadWord", "meh"] and soft == ["", "blah", "meh", "so-so"]
    judge = url_filter.Judge([], strict, soft, 2)
    of = [judge.judge(f"http://h.org/{x}")[3] for x in ("badword", "BADWORD/x", "badwords", "meh", "so-so", "so-so/blah", "blah/blah", "so-so_blah")]
    assert of == ["block", "block", "allow", "block", "allow", "block", "allow", "block"]


def test_urls_equal_their_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    from panelkiln.llm import oracles

    r = random.Random(8)
    parts = ["http://", "://", "HTTPS://", "a.example.com", "example.com", "EXAMPLE.net", "net", "badnet", "org", "/", "/en/", "/en/7", "/de/8", "/es/", "?", "#", "free", "win", "porn", "-", "_", "é", ".", "com", ":80", "x" * 5000, " "]
    urls = [None, "", "://", "http://"] + ["".join(r.choice(parts) for _ in range(r.randint(1, 9))) for _ in range(1500)]
    pages = list(enumerate(urls))
    spark.createDataFrame(pages, "page_id long, url string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    con.execute(f"CREATE TABLE want AS {oracles.OP5}")
    found = url_filter.op5_url_filter(spark, str(tmp_path))
    want = con.execute(f"SELECT {', '.join(found.columns)} FROM want").fetchall()
    assert sorted(map(repr, want)) == sorted(repr(tuple(x)) for x in found.collect())


def brute_chunks(text):
    """The chunks of a text by the rule, a byte at a time."""
    gear, data, out, start = fingerprints._GEAR.tolist(), text.encode(), [], 0
    while start < len(data):
        for end in range(start + 1, len(data) + 1):
            h = sum(gear[data[end - 1 - k]] << k for k in range(min(16, end))) % (1 << 32)
            n = end - start
            if n == fingerprints.MOST or fingerprints.LEAST <= n and h >> int(fingerprints._STRICT if n < fingerprints.NORMAL else fingerprints._LOOSE) == 0:
                break
        out.append(data[start:end])
        start = end
    return out


def test_fingerprints_equal_brute_force():
    texts = [prose(n, 300 + n) for n in (1, 3, 9, 40, 200, 500)] + ["", "a" * 1000, "漢字" * 200, prose(40, 340) + prose(200, 500)]
    f = fingerprints.Fingerprints(*utf8(pa.array(texts)))
    data, offsets = utf8(pa.array(texts))
    doc, start, end = fingerprints.chunk_bounds(data, offsets)
    chunks = [brute_chunks(t) for t in texts]
    assert [bytes(data[a:b]) for a, b in zip(start, end)] == [c for own in chunks for c in own] and np.array_equal(doc, np.repeat(np.arange(len(texts)), [len(c) for c in chunks]))
    pairs = [(i, j) for i in range(len(texts)) for j in range(len(texts))]
    near = fingerprints.likeness(f, np.array([p[0] for p in pairs]), f, np.array([p[1] for p in pairs]))
    for (i, j), found in zip(pairs, near):
        a, b = set(chunks[i]), set(chunks[j])
        least = min(sum(map(len, a)), sum(map(len, b)))
        assert found == pytest.approx(sum(map(len, a & b)) / least if least else float(not a and not b))


def test_successors_where_one_id_or_none_fills_buckets(spark):
    rows = [(None, f"none {k}") for k in range(400)] + [(7, f"seven {k}") for k in range(300)] + [(k, f"own {k}") for k in range(100)] + [(-(1 << 63), "least"), ((1 << 63) - 1, "most")]
    found = fingerprints.with_successors(table(spark, rows), 16)
    assert found.where("NOT guest").count() == len(rows) and found.where("guest").count() == found.select("bucket").distinct().count()
    assert max(r[1] for r in found.groupBy("bucket").count().collect()) < 200
    # Following bucket after bucket gives each row once, ids falling, rows without one last.
    rows_of = {}
    for r in found.orderBy("bucket", "guest").collect():
        rows_of.setdefault(r.bucket, []).append(r)
    whole = [r for b in sorted(rows_of, reverse=True) for r in sorted((x for x in rows_of[b] if not x.guest), key=lambda x: (x.doc_id is not None, x.doc_id or 0), reverse=True)]
    ids = [r.doc_id for r in whole]
    assert ids == sorted((i for i, _ in rows if i is not None), reverse=True) + [None] * 400
    done = found.mapInArrow(fingerprints._edited_batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    assert done.count() == len(rows)


def test_fingerprints_find_moved_text_and_successors(spark, hostile):
    base = prose(800, 1)
    f = fingerprints.Fingerprints(*utf8(pa.array([base, "new words in front " + base, prose(800, 2), "", base])))
    near = fingerprints.likeness(f, np.array([0, 0, 3, 3, 0]), f, np.array([1, 2, 3, 0, 4]))
    assert near[0] > 0.9 and near[1] < 0.1 and near[2] == 1 and near[3] == 0 and near[4] == 1 and f.texts()[0] == f.texts()[4]
    rows = [(k * 3, prose(20 + k, k)) for k in range(50)] + [(500, None), (501, "")]
    found = fingerprints.with_successors(table(spark, rows), 8)
    done = {r[0]: r for r in found.mapInArrow(fingerprints._edited_batches, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").collect()}
    order = sorted(rows, reverse=True)
    for k, (i, t) in enumerate(order):
        changed = fingerprints.edited(t or "", order[(k + 1) % len(order)][1] or "")
        assert done[i][2] == hashlib.sha256(changed.encode()).hexdigest() and done[i][1] == len(t or "")
    assert fingerprints.fingerprints(hostile).count() == 12
    assert fingerprints.with_successors(hostile, 4).where("NOT guest").count() == 12 and fingerprints.with_successors(hostile.limit(0), 4).count() == 0


def test_chat_windows_read_back(spark):
    said = ["\\", "\\\\###", "####", "</turn>", "\\</turn>\n", "a: b", "### user: x</turn>\n", "", None, "\\:", "é" * 3000]
    rows = [(1, k, "assistant" if k % 2 else "user:\\ ###", t) for k, t in enumerate(said)] + [(2, 0, "system", "be kind"), *((2, k, ("user", "assistant")[k % 2], prose(30, k)) for k in range(1, 60)), (3, None, None, None), (3, None, None, None), (None, 1, "assistant", "x")]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    made = chat_format.windows(talks, 512, 128)
    digests = {r.conv_id: r for r in chat_format.conversation_digests(made).collect()}
    for conv in (1, 2, 3, None):
        own = sorted(((-1 if t is None else t, r or "", x or "") for c, t, r, x in rows if c == conv))
        learned = "".join(x for _, r, x in own if r == "assistant")
        assert digests[conv].n_turns == len(own)
        assert digests[conv].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert (digests[conv].loss_chars, digests[conv].loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
    two = [r for r in made.orderBy("window").collect() if r.conv_id == 2]
    assert len(two) > 3 and all(chat_format.read_back(r.formatted)[0] == ("system", "be kind") for r in two) and two[1].repeated > 1
    assert chat_format.conversation_digests(chat_format.windows(talks.limit(0))).count() == 0


def test_chat_windows_hold_their_budget(spark):
    rows = [(1, 0, "system", prose(20, 1)), *((1, k, ("user", "assistant")[k % 2], prose(5 + 7 * (k % 11), k)) for k in range(1, 80))]
    talks = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for budget, history, path in ((400, 100, None), (400, 390, None), (60, 20, None), (300, 200, tokenizer_files.path("word_bpe_49k.json"))):
        made = chat_format.windows(talks, budget, history, path).orderBy("window").collect()
        new = [t for r in made for t in chat_format.read_back(r.formatted)[r.repeated :]]
        assert new == [(r, x) for _, _, r, x in rows]
        for r in made:
            turns = chat_format.read_back(r.formatted)
            assert r.tokens <= budget or len(turns) == 1
            assert [(t["stop"] - t["start"]) for t in r.loss] == [len(x) for role, x in turns[r.repeated :] if role == "assistant"]
    wide = chat_format.windows(talks, 1000, 900).collect()
    assert max(r.repeated for r in wide) > 10


def test_chat_reads_long_texts_back():
    text = "x</turn>\n\\" * 400_000
    head, body = chat_format.written("user: ###", text)
    assert chat_format.read_back(head + body + chat_format.TURN_END) == [("user: ###", text)]


@pytest.mark.parametrize("name", ["op1_chat_format", "op2_token_counts", "op3_language", "op4_toxicity", "op5_url_filter", "op6_fingerprints", "op7_decontamination", "op8_near_dedup", "op9_bpe", "op10_substring_dedup"])
def test_registered_queries_return_every_row(spark, name):
    from panelkiln.llm.registry import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = QUERIES[name](spark, folder)
    of = {"op1_chat_format": "conversations", "op5_url_filter": "pages"}.get(name, "documents")
    whole = spark.read.parquet(f"{folder}/{of}.parquet")
    assert rows.count() == (whole.select("conv_id").distinct().count() + 1 if name == "op1_chat_format" else whole.count())
