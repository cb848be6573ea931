import math
import random

import numpy as np

from sunledger.llm import vector_codes as V


def test_nearest_is_the_lowest_index_of_the_nearest():
    rng = np.random.default_rng(3)
    for dim, size, spread in ((4, 64, 3), (1, 8, 2), (7, 20, 40), (4, 1, 5)):
        entries = rng.integers(-spread, spread, (size, dim))
        parts = rng.integers(-spread, spread, (500, dim))
        index, far, looked = V.nearest(parts, entries)
        all_ = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (index == all_.argmin(1)).all() and (far == all_.min(1)).all() and looked <= all_.size
        big = V.nearest(parts.astype(object) * (1 << 80), entries.astype(object) * (1 << 80))
        assert (big[0] == index).all() and (big[1] == far.astype(object) << 160).all()
    # entries far apart in their sums are not looked at
    assert V.nearest(np.arange(100)[:, None], np.arange(100)[:, None])[2] < 500


def brute(rows, parts, size, rounds):
    """rows: (id, vector, label)."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max(max((len(r[1]) for r in kept), default=0), 1) // parts) * parts
    exact = [[math.floor(x) * 256 + math.floor((x - math.floor(x)) * 256) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, kept[i][1]))
    dim = width // parts
    cut = [[v[p * dim:(p + 1) * dim] for p in range(parts)] for v in exact]
    books = [[cut[i][p] for i in order[:size]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        chosen = assign()
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, a in zip(cut, chosen) if a[p][1] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    chosen = assign()
    error = [min(sum(f for f, _ in a), V.MOST) for a in chosen]
    by = {}
    for r, e in zip(kept, error):
        by[r[2]] = by.get(r[2], 0) + e
    sha = V.Codebooks([np.array(b, object) for b in books], width).sha256()
    return sorted(map(str, ((r[0], "".join(f"{k:02x}" for _, k in a), e, min(by[r[2]], V.MOST), sha) for r, a, e in zip(kept, chosen, error))))


def report(spark, rows, **options):
    df = spark.createDataFrame([(*r, "x", 7) for r in rows], "vec_id long, embedding array<double>, label int, code string, error long")
    return sorted(str(tuple(r)) for r in V.code_report(df.repartition(4), **options).collect())


def test_like_brute_force_on_odd_rows(spark):
    rng = random.Random(5)
    rows = [(i, [rng.choice([-0.5, 0.0, 0.25, 1.0, rng.uniform(-2, 2)]) for _ in range(8)], rng.choice([1, 2, None])) for i in range(120)]
    rows += [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (None, [1.0] * 8, None), (200, [0.5] * 3, 2), (201, [], 2), (202, None, 1),
             (203, [float("nan")] + [0.0] * 7, 1), (204, [float("inf")] * 8, 1), (205, [None] + [0.0] * 7, 2), (-1, [0.1] * 7 + [-0.1], 9)]
    assert report(spark, rows, parts=4, size=10, rounds=2) == brute(rows, 4, 10, 2)


def test_large_components_few_rows_and_none(spark):
    rows = [(0, [1e300, -1e300, 1.5, 0.0], 1), (1, [1e300, 1e18, 1.0, 3e38], 1), (2, [0.0, 1e10, -2.5, -1e-9], None)]
    assert report(spark, rows, parts=2, size=64, rounds=2) == brute(rows, 2, 64, 2)
    rows = [(i, [1e30 * (i % 3), float(i)], i % 2) for i in range(12)]
    assert report(spark, rows, parts=2, size=3, rounds=2) == brute(rows, 2, 3, 2)
    assert report(spark, [(0, None, 1)]) == [] and report(spark, []) == []


def test_decode_and_encode_another_table(spark):
    rng = random.Random(1)
    schema = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(i, [float(rng.randint(0, 3)) for _ in range(4)]) for i in range(300)], schema)
    coder = V.VectorCoder(df, parts=2, size=64, rounds=3)
    more = coder.encode(spark.createDataFrame([(9, [1.0, 2.0, 3.0, 0.0]), (8, [3.0, 3.0, 3.0, 3.0, 5.0])], schema)).collect()
    codes = np.array([list(bytes.fromhex(r.code)) for r in more])
    assert (coder.codebooks.decode(codes)[0] == np.array([256, 512, 768, 0])).all() and more[0].error == 0
