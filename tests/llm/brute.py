"""Plain versions of the text operators, written from their definitions."""

from __future__ import annotations

import collections
import hashlib
import re

WORD = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
TOKEN = re.compile("[^\x20\x09-\x0D]+")


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def contaminated(docs, bench, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated), sorted."""
    windows = collections.defaultdict(set)
    for item, text in bench:
        words = WORD.findall(low(text or ""))
        size = min(window, len(words))
        for k in range(len(words) - size + 1 if words else 0):
            windows[tuple(words[k:k + size])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words = WORD.findall(low(text or ""))
        hit, items = [False] * len(words), set()
        for size in sizes:
            for k in range(len(words) - size + 1):
                if found := windows.get(tuple(words[k:k + size])):
                    items |= found
                    hit[k:k + size] = [True] * size
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        out.append((doc, len(words), sum(hit), len(items), digest, any(hit)))
    return sorted(out, key=str)


def shingle_set(text):
    words = TOKEN.findall(low(text or ""))
    if len(words) >= 5:
        return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4))
    return frozenset([tuple(words)]) if words else frozenset()


def components(docs):
    """(doc_id, n_shingles, component_id), sorted."""
    sets = [shingle_set(text) for _, text in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    places = collections.defaultdict(list)
    for i, s in enumerate(sets):
        shared = collections.Counter(j for token in s for j in places[token])
        for j, k in shared.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                parent[root(i)] = root(j)
        for token in s:
            places[token].append(i)
    least = {}
    for i, (doc, _) in enumerate(docs):
        least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((doc, len(s), least[root(i)] if s else doc) for i, ((doc, _), s) in enumerate(zip(docs, sets)))


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = TOKEN.findall(text)
    lines = [x for x in text.split("\n") if TOKEN.search(x)]
    triples = [tuple(words[k:k + 3]) for k in range(len(words) - 2)]
    count, hit = collections.Counter(triples), set()
    for k, t in enumerate(triples):
        if count[t] > 1:
            hit |= {k, k + 1, k + 2}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            len(lines) - len(set(lines)), len(hit))


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    """kind:start:end of the four base kinds, in their order."""
    text = text or ""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append(("phone", *m.span()))
    return [f"{k}:{a}:{b}" for k, a, b in out]
