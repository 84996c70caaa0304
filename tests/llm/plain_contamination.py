"""A plain version of operator 4: its checks over all windows of a text, sharing no code with the operator."""

import re
from collections import Counter

SPLIT = re.compile(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words_of(text):
    return [w for w in SPLIT.split((text or "").lower()) if w]


def subsequence(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def passages_of(items, texts):
    """(item, words, rare words) with words' frequencies in ``texts``; ``items`` are (id, text)."""
    seen = Counter(w for t in texts for w in set(words_of(t)))
    out = []
    for k, text in items:
        own = words_of(text)
        for part in [own[i : i + 48] for i in range(0, len(own), 48)] if len(own) > 64 else [own]:
            if part and len(part) >= min(8, len(own)):
                order = sorted(range(len(part)), key=lambda i: seen[part[i]])
                out.append((k, part, {part[i] for i in order[: max(1, len(part) // 3)]}))
    return out


def matches(words, passages, common=0.5, answer=0.4, order=0.5):
    """item -> the best rank that a window has."""
    here, best = set(words), {}
    for item, own, rare in passages:
        if len(rare & here) < answer * len(rare):
            continue
        n = len(own)
        size = 16 if n <= 21 else 32 if n <= 40 else 48
        margin = max(8, n - size + 8)
        pairs = set(zip(own, own[1:]))
        done = {}
        for start in range(max(0, len(words) - size) + 1):
            region = words[max(0, start - margin) : start + size + margin]
            if len(rare.intersection(region)) < answer * len(rare):
                continue
            if n < 8:
                rank = float(any(region[i : i + n] == own for i in range(len(region) - n + 1)))
            else:
                lcs = done.setdefault(tuple(region), None)
                if lcs is None:
                    lcs = done[tuple(region)] = subsequence(own, region) / n
                together = len(pairs & set(zip(region, region[1:]))) / len(pairs)
                rank = max(lcs if lcs >= common else 0, together if together >= order else 0)
            if rank:
                best[item] = max(rank, best.get(item, 0))
    return best
