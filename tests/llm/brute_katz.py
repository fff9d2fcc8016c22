"""Katz scores of a few texts, straight from the definition."""

import math
import re
from collections import Counter

CUT, TAIL = 5, 0.1


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def scores(train: list[str | None], texts: list[str | None]) -> list[dict]:
    split = lambda t: re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    uni, bi, hist = Counter(), Counter(), Counter()
    for t in train:
        seq = ["<s>", *split(t), "</s>"]
        uni.update(seq[1:])
        bi.update(zip(seq, seq[1:]))
        hist.update(seq[:-1])
    n, v = sum(uni.values()), len(uni)
    nr = Counter(bi.values())
    top = (CUT + 1) * nr[CUT + 1] / nr[1] if nr[1] else 1.0
    star = {}
    for r in range(1, CUT + 1):
        raw = (r + 1) * nr[r + 1] / nr[r] if nr[r] else 0.0
        x = (raw - r * top) / (1 - top) if top < 1 else 0.0
        star[r] = x if 0 < x < r else r - 0.5
    disc = lambda c: star[c] if c <= CUT else c - TAIL
    p1 = lambda w: (uni[w] + 1) / (n + v + 1)
    after = {}
    for (h, w), c in bi.items():
        after.setdefault(h, {})[w] = c

    def prob(h, w):
        if h not in after:
            return p1(w)
        if w in after[h]:
            return disc(after[h][w]) / hist[h]
        freed = sum(c - disc(c) for c in after[h].values()) / hist[h]
        return freed / (1 - sum(p1(x) for x in after[h])) * p1(w)

    for h in list(after)[:20]:  # exactly normalised over the known words and one unknown
        assert abs(sum(prob(h, w) for w in uni) + prob(h, "<never seen>") - 1) < 1e-9
    out = []
    for t in texts:
        seq = ["<s>", *split(t), "</s>"]
        out.append({"n_tokens": len(seq) - 1, "n_known": sum(uni[w] > 0 for w in seq[1:]), "train_tokens": n, "base_score": sum(math.log10(p1(w)) for w in seq[1:]), "score": sum(math.log10(prob(h, w)) for h, w in zip(seq, seq[1:]))})
    return out
