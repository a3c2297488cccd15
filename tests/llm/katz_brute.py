"""The same model, token by token, in plain Python."""

import math
import re
from collections import Counter, defaultdict

from graphloom.llm.katz import TRUSTED, discounts


def brute(docs):
    """docs: (doc_id, text, held). Rows like those of score(), by doc_id."""
    tokens = {d: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")), None] for d, t, _ in docs}
    train = [d for d, _, held in docs if not held]
    single = Counter(w for d in train for w in tokens[d])
    pairs = Counter(p for d in train for p in zip(["<", *tokens[d]], tokens[d]))
    n, v = sum(single.values()), len(single)
    many = lambda c: [sum(x == r for x in c.values()) for r in range(1, TRUSTED + 2)]
    d1, d2 = discounts(many(single)), discounts(many(pairs))
    kept = lambda d, c: c * (d[c] if c <= TRUSTED else 1)
    lost = n - sum(kept(d1, c) for c in single.values())
    extra = 0 if lost > 1e-9 else 0.5
    uni = lambda w: (kept(d1, single[w]) if w in single else lost + extra) / (n + extra) if n else 1.0
    after = defaultdict(dict)
    for (h, w), c in pairs.items():
        after[h][w] = c

    def prob(h, w):
        seen = after.get(h)
        if not seen:
            return uni(w)
        total, own = sum(seen.values()), sum(kept(d2, c) for c in seen.values())
        room = 0 if own < total else 0.5
        rest = 1 - sum(uni(x) for x in seen)
        if rest <= 1e-12:
            return seen[w] / total if w in seen else uni(w)
        return kept(d2, seen[w]) / (total + room) if w in seen else (1 - own / (total + room)) / rest * uni(w)

    out = {}
    for d, _, held in docs:
        t = tokens[d]
        out[d] = (held, len(t), sum(w in single for w in t), n, sum(math.log10((single[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), sum(math.log10(prob(h, w)) for h, w in zip(["<", *t], t)))
    return out, (single, after, uni, prob)
