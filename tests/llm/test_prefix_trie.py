import hashlib
import random
import re
import zlib

from panelkiln.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, pos long, depth long"


def brute(rows):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [r[2:] for r in sorted(t)] for c, t in own.items()}
    seqs = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = tuple(own.get(c - int(abs(c) % 20) * (1 if c > 0 else -1), [])[:h] + t[h:])
    members = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    totals = {}
    for p in sorted(members, key=len, reverse=True):
        below = [totals[q] for q in children.get(p, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        totals[p] = (sum(b[0] for b in below) or 1, (len(members[p]) - 1) * words + sum(b[1] for b in below))
    out = []
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(p))
        out.append((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children.get(p, [])), *totals[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, rows, **settings):
    df = prefix_trie.prefix_trie(spark.createDataFrame([(*r, 9, 9) for r in rows], SCHEMA), **settings)
    return sorted(((r.conv_id, r.depth, r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect()), key=repr)


def test_trie_of_random_conversations_equals_brute_force(spark):
    r = random.Random(3)
    rows = []
    for c in range(-25, 70):
        for k in range(r.choice((1, 2, 3, 4, 7, 9, 20))):
            rows.append((c, k, "user" if k % 2 else "assistant", r.choice(("a b", "c", "d  e\tf")) if r.random() < 0.3 else "same text"))
    rows += [(c, k, "user", f"copy {k}") for c in range(100, 160) for k in range(6)]
    assert found(spark, rows) == brute(rows)


def test_nulls_ties_repeats_and_rows_without_conversation(spark):
    rows = [(1, None, None, None), (1, None, "user", "x"), (1, None, "user", "x"), (1, 2, "b", "y"), (1, 2, "a", "z"), (2, 5, "user", ""), (None, 1, "user", "lost"), (3, 0, "user", "x\x00 y"), (23, 0, "u:", "v"), (23, 1, "u", ":v"), (43, 1, "q", "w " * 5_000)]
    assert found(spark, rows) == brute(rows)
    assert found(spark, rows[:1]) == brute(rows[:1])


def test_ids_of_a_node_in_several_blocks(spark):
    rows = [(5, 2, c) for c in range(-30, 400)] + [(5, 3, 5), (6, 2, 7)]
    ends = spark.createDataFrame(rows, "conv_id long, depth long, conv long")
    want = {k: hashlib.sha256(",".join(str(c) for a, d, c in rows if (a, d) == k).encode()).hexdigest() for k in ((5, 2), (5, 3), (6, 2))}
    assert {(r.conv_id, r.depth): r.ends_sha256 for r in prefix_trie.end_digests(ends, block_bytes=64).collect()} == want


def test_long_conversation_and_many_copies(spark):
    rows = [(500, k, "user", f"turn {k % 7} {k}") for k in range(700)] + [(520, k, "user", f"turn {k % 7} {k}") for k in range(650)]
    rows += [(c, k, "user", f"copy {k}") for c in range(1000, 1300) for k in range(5)]
    assert found(spark, rows) == brute(rows)


def test_no_conversations(spark):
    assert found(spark, [(None, 1, "user", "x")]) == []
