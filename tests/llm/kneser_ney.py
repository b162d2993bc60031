"""A plain interpolated modified Kneser-Ney model of characters, for tests."""

import math
from collections import Counter


def perplexities(train, texts, order=5):
    top = Counter()
    for t in train:
        s = "\x02" * (order - 1) + t
        top.update(s[i : i + order] for i in range(len(t)))
    counts = [top]
    for _ in range(order - 1):
        counts.insert(0, Counter(g[1:] for g in counts[0]))
    model = []
    for c in counts:
        n = [sum(x == i for x in c.values()) for i in (1, 2, 3, 4)]
        y = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
        d = [min(i, max(0.0, i - (i + 1) * y * b / a)) if a else 0.5 * i for i, a, b in ((1, n[0], n[1]), (2, n[1], n[2]), (3, n[2], n[3]))]
        d[2] = min(d[2], 2.9)
        total, rest = Counter(), Counter()
        for g, x in c.items():
            total[g[:-1]] += x
            rest[g[:-1]] += d[min(x, 3) - 1]
        model.append((c, d, total, rest))

    def p(g):
        if not g:
            return 1 / (len(counts[0]) + 1)
        c, d, total, rest = model[len(g) - 1]
        h = g[:-1]
        if not total[h]:
            return p(g[1:])
        own = max(c[g] - d[min(c[g], 3) - 1], 0) if c[g] else 0
        return own / total[h] + rest[h] / total[h] * p(g[1:])

    out = {}
    for t in texts:
        s = "\x02" * (order - 1) + t
        out[t] = math.exp(-sum(math.log(p(s[i : i + order])) for i in range(len(t))) / len(t))
    return out
