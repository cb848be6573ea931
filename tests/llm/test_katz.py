import collections
import math
import random
import zlib

import numpy as np

from sunledger.llm import katz as K

from .conftest import ODD


def tokens(text):
    return [*(text or "").encode().lower().split(), "END"]


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 7


class Brute:
    def __init__(self, rows):
        self.u, self.b = collections.Counter(), collections.Counter()
        for i, t in rows:
            if fold(i) is not None and fold(i) != 2:
                x = tokens(t)
                self.u.update(x)
                self.b.update(zip(["BEGIN", *x], x))
        self.n, (self.du, self.db) = sum(self.u.values()), (K.discounts(np.array(
            [sum(v == r for v in c.values()) for r in range(1, K.LARGEST + 2)])) for c in (self.u, self.b))
        self.h = collections.Counter()
        for (h, _), c in self.b.items():
            self.h[h] += c

    def cut(self, c, d):
        return c * d[min(c, K.LARGEST + 1)]

    def word(self, w):
        if w in self.u:
            return self.cut(self.u[w], self.du) / self.n
        return 1 - sum(self.cut(c, self.du) for c in self.u.values()) / self.n if self.n else 1.0

    def p(self, h, w):
        if (h, w) in self.b:
            return self.cut(self.b[h, w], self.db) / self.h[h]
        if not self.h[h]:
            return self.word(w)
        follow = [(x, c) for (g, x), c in self.b.items() if g == h]
        left = 1 - sum(self.cut(c, self.db) for _, c in follow) / self.h[h]
        return self.word(w) * left / (1 - sum(self.word(x) for x, _ in follow))


def check(docs, rows):
    m = Brute(rows)
    want = []
    for i, t in rows:
        x = tokens(t)
        want.append((str(i), fold(i) == 2, len(x), sum(w in m.u for w in x), m.n,
                     round(sum(math.log10((m.u[w] + 1) / (m.n + len(m.u) + 1)) for w in x), 6),
                     round(sum(math.log10(m.p(h, w)) for h, w in zip(["BEGIN", *x], x)), 6)))
    got = [(str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6))
           for r in K.score_documents(docs).collect()]
    assert len(got) == len(want)
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-5
    return m


def test_against_brute_force(documents, small_blocks, monkeypatch):
    monkeypatch.setattr(K, "SPREAD", 60)     # frequent histories lie in several buckets
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["the", "A", "b", "é", f"x{rng.randint(0, 50)}"]) for _ in range(rng.randint(0, 40))))
            for i in range(150)] + [(None, "the a"), (7, None), (7, "")]
    m = check(documents(rows), rows)
    for h in list(m.h)[:10]:     # probabilities add up to one, with the unknown word
        assert abs(sum(m.p(h, w) for w in m.u) + m.p(h, "?") - 1) < 1e-9


def test_odd_rows(documents):
    check(documents(ODD), ODD)
    assert K.score_documents(documents([])).count() == 0
    nothing = [(i, "a b") for i in range(40) if fold(i) == 2]
    check(documents(nothing), nothing)


def test_discounts():
    d = K.discounts(np.array([1000, 400, 220, 140, 100, 80]))
    assert ((d[1:] > 0) & (d[1:] < 1)).all() and d[1] < d[5]
    assert K.discounts(np.zeros(6, int))[1] == 0.5
