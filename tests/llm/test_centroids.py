import hashlib
import math
import random

from panelkiln.llm import centroids

SCHEMA = "vec_id long, embedding array<float>, label int, v string, cluster int"


def brute(rows, k, rounds, size):
    kept = [(i, [math.floor(1024 * x) for x in e]) for i, e in rows if e is not None and len(e) == size and all(x is not None and math.isfinite(x) for x in e)]
    order = sorted(kept, key=lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))
    now = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(now))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(near(v)[1], []).append(v)
        now = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(now)]
    found = [(i, near(v)) for i, v in kept]
    by = {}
    for _, (d, c) in found:
        by[c] = by.get(c, 0) + d
    return sorted(((i, c, d, by[c], sum(by.values()), hashlib.sha256(",".join(map(str, now[c])).encode()).hexdigest()) for i, (d, c) in found), key=repr)


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", 2) for i, e in rows], SCHEMA)


def single(x):
    """The value that a 32-bit float column holds."""
    return x / 64


def test_clusters_equal_brute_force_with_ties_repeats_and_unfit_vectors(spark):
    r = random.Random(4)
    rows = [(i, [single(r.randint(-40, 40)) for _ in range(4)]) for i in range(60)]
    rows += [(7, rows[7][1])] * 20 + [(None, rows[3][1]), (None, None), (90, None), (91, []), (92, [0.5] * 3), (93, [0.5, None, 0.5, 0.5]), (94, [0.5, float("nan"), 0.5, 0.5]), (95, [float("-inf")] * 4), (96, [0.0] * 5)]
    found = centroids.clustered(table(spark, rows), k=5, rounds=6, size=4).collect()
    assert sorted(map(tuple, found), key=repr) == brute(rows, 5, 6, 4) and len(found) == 81


def test_fewer_vectors_than_centroids_equal_vectors_and_no_vectors(spark):
    few = [(1, [0.25, -0.5]), (2, [0.25, -0.5])]
    assert sorted(map(tuple, centroids.clustered(table(spark, few), k=8, rounds=3, size=2).collect()), key=repr) == brute(few, 8, 3, 2)
    assert centroids.clustered(table(spark, few).limit(0), k=8, size=2).count() == 0
    assert centroids.clustered(table(spark, [(1, None)]), k=8, size=2).count() == 0


def test_rounds_use_no_python(spark):
    rows = centroids.integer_vectors(table(spark, [(1, [0.5, 0.5])]), 2)
    plan = centroids.assigned(rows, [[1, 2], [-3, 4]])._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
