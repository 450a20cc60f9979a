"""Brute-force versions of the contracts, over lists of rows; written from the contracts alone."""

import hashlib
import re

WS = r"[^\x20\x09-\x0D]+"


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    words = re.findall(WS, text)
    lines = [x for x in text.split("\n") if re.search(WS, x)]
    seen, hit = {}, set()
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            for i in at:
                hit.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 20 or 100 * len(hit) > 30 * n


def _luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def pii_base(text):
    """Base spans (kind, start, end) in the order of the contract."""
    text, out = text or "", []
    digits = lambda s: re.sub("[^0-9]", "", s)
    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(digits(s)) <= 19 and _luhn(digits(s))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(digits(s)) <= 15),
    }
    for kind, (pattern, ok) in kinds.items():
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m[0])]
    return out


def pii_digest(text):
    spans = pii_base(text)
    joined = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    return *[sum(s[0] == k for s in spans) for k in ("email", "ip", "card", "phone")], hashlib.sha256(joined.encode()).hexdigest(), joined


def mix_targets(sizes):
    """sizes: source -> words. Targets by sharing the excess again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        rest = [s for s in order if s not in fixed]
        if not rest:
            return fixed
        level = (total - sum(fixed.values())) / sum(weight[s] for s in rest)
        over = [s for s in rest if level * weight[s] > 2 * sizes[s]]
        if not over:
            return fixed | {s: level * weight[s] for s in rest}
        fixed |= {s: 2.0 * sizes[s] for s in over}
