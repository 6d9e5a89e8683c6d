"""Plain versions of the operators, for small inputs."""

from collections import Counter

import xxhash


def fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """Smallest id reachable; prints: id -> fingerprint."""
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for k, i in enumerate(ids):
        for j in ids[:k]:
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def dedup_lines(texts, least=5):
    """texts: id -> text; lines similar to an earlier one go."""
    seen, places, out = [], {}, {}
    for i in sorted(texts):
        left = []
        for line in texts[i].split("\n"):
            words = frozenset(line.encode().lower().split())
            gone = False
            if len(words) >= least:
                common = Counter(j for w in words for j in places.get(w, ()))
                gone = any(5 * n >= 4 * (len(words) + len(seen[j]) - n) for j, n in common.items())
                seen.append(words)
                for w in words:
                    places.setdefault(w, []).append(len(seen) - 1)
            if not gone:
                left.append(line)
        out[i] = "\n".join(left)
    return out


def repeated_words(texts, n=50):
    """Per id, the words inside runs of n words that an earlier document holds."""
    first, out = {}, {}
    for i in sorted(texts):
        words, held = texts[i].encode().lower().split(), set()
        for j in range(len(words) - n + 1):
            run = tuple(words[j : j + n])
            if first.setdefault(run, i) != i:
                held.update(range(j, j + n))
        out[i] = held
    return out


def repeat_words(text):
    words = [w for w in __import__("re").split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    count = Counter(windows)
    return len({i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)})
