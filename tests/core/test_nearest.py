"""Nearest vectors in pairs of blocks against brute force."""

import math
import random

import numpy as np
import pyarrow as pa

from ledgerloom.operators import resolve


def test_nearest_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(resolve, "BLOCK", 7)
    r = random.Random(5)
    rows = [(k, [r.choice([-1.0, 0.0, 0.5, 2.0]) for _ in range(3)]) for k in range(60)] + [(60 + k, [1.0, 2.0, 0.5]) for k in range(12)] + [(80, None), (81, [1.0, None, 2.0]), (82, [1.0]), (83, [0.0] * 3)]

    def score(a, b):
        if not a or not b or len(a) != len(b) or None in a or None in b:
            return None
        norm = math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b))
        return round(sum(x * y for x, y in zip(a, b)) / norm, 6) if norm else 0.0

    want = []
    for q, a in rows:
        if q % 5 == 0 or q == 81:
            best = sorted(((score(a, b), v) for v, b in rows if v != q), key=lambda x: (x[0] is None, -(x[0] or 0), x[1]))[:4]
            want += [(q, v, s, k + 1) for k, (s, v) in enumerate(best)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = resolve.nearest(frame.filter("vec_id % 5 = 0 OR vec_id = 81"), frame, 4).collect()
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_copies_give_k_rows_a_query():
    table = lambda ids: pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array([[1.0, 2.0]] * len(ids), pa.list_(pa.float64()))})
    found = resolve.nearest_of_block(table([0, 3]), table(list(range(500))), 2)
    assert found["query_id"].to_pylist() == [0, 0, 3, 3] and found["vec_id"].to_pylist() == [1, 2, 0, 1] and np.allclose(found["score"].to_numpy(), 1)
