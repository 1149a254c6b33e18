"""Plain Python versions of text operators, one document or one pair at a time."""

import hashlib
import re
from collections import Counter
from datetime import date, timedelta

WORDS = re.compile("[^\x20\x09-\x0d]+")
KEY = "k"


def luhn(digits):
    return sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(int(c) for c in reversed(digits))) % 10 == 0


def turn(tag, n, v):
    return int(hashlib.sha256(f"{KEY}|{tag}|{n}|{v}".encode()).hexdigest()[:15], 16)


def permuted(x, y, a, b, tag):
    for n in range(8):
        x, y = (x, (y + turn(tag, n, x)) % b) if n % 2 else ((x + turn(tag, n, y)) % a, y)
    return x, y


def card(d):
    left = (len(d) - 1) // 2
    right = len(d) - 1 - left
    x, y = permuted(int(d[:left]), int(d[left:-1]), 10**left, 10**right, f"card{len(d)}")
    body = f"{x:0{left}d}{y:0{right}d}"
    return next(body + c for c in "0123456789" if luhn(body + c))


def address(text):
    p = [int(v) for v in text.split(".")]
    x, y = permuted(p[0] * 256 + p[1], p[2] * 256 + p[3], 1 << 16, 1 << 16, "address")
    return f"{x >> 8}.{x & 255}.{y >> 8}.{y & 255}"


def social(text):
    area, group, serial = (int(v) for v in text.split("-"))
    x, y = permuted(area - (2 if area > 666 else 1), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, "social")
    return f"{x + (2 if x >= 665 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"


def day(text):
    d = date.fromisoformat(text).toordinal() - 1
    first, a, b, tag = (0, 65, 563, "date-head") if d < 36595 else (3613595, 64, 601, "date-tail") if d >= 3613595 else (d - (d - 36595) % 73000, 200, 365, "date")
    x, y = permuted((d - first) // b, (d - first) % b, a, b, tag)
    return (date(1, 1, 1) + timedelta(first + x * b + y)).isoformat()


def brute_components(rows, n, num, den):
    sets = {}
    for i, text in rows:
        words = WORDS.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: (len(sets[i]), root(i)) for i in ids}


STOCK = re.compile(r"(?i)\b(cookies?|javascript|privacy policy|terms of (use|service)|click here|read more|log ?in|sign (in|up)|subscribe|lorem ipsum|skip to content|share this|back to top)\b")


def bad_line(line):
    n = len(WORDS.findall(line))
    bars, symbols, shouts = line.count("|"), len(re.findall(r"[#*$%&<>]", line)), len(line) - len(line.replace("!!", "!"))
    return (bars >= 3 and 100 * bars >= 20 * n) or 100 * symbols >= 30 * n or (shouts > 0 and 100 * shouts >= 30 * n) or (n <= 20 and bool(STOCK.search(line)))


def cleaned(text):
    """The text without failing and repeated lines, or None if the document is rejected."""
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    covered = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    lines = list(dict.fromkeys(x for x in text.split("\n") if WORDS.search(x)))
    left = "\n".join(x for x in lines if not bad_line(x))
    if len(words) < 10 or 100 * len(covered) > 20 * len(words) or 100 * len(WORDS.findall(left)) < 50 * len(words):
        return None
    return left
