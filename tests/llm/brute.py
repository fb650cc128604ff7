"""Plain versions of the operators, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def shingles(text, width=3):
    words = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    if len(words) < width:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def near_components(docs, width=3, percent=90):
    """doc_id -> (set size, component) over (doc_id, text) rows with distinct ids."""
    sets = {i: shingles(t, width) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    met = {(a, b) for ids in holders.values() for k, a in enumerate(sorted(ids)) for b in sorted(ids)[k + 1 :]}
    for a, b in met:
        common = len(sets[a] & sets[b])
        if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def top_k(rows, k=5, every=50, factor=256):
    found = []
    fit = [(i, [int(np.floor(np.float64(x) * factor)) for x in v]) for i, v in rows
           if v is not None and i is not None and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in fit:
        if q % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in fit if i != q and len(a) == len(b))
            found += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(found)


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def line_dedup(docs, min_chars=10):
    """doc_id -> text; docs are (doc_id, text) with distinct ids."""
    earlier, kept, by_size = set(), {}, defaultdict(list)
    for i, text in sorted(docs):
        if text is None:
            kept[i] = None
            continue
        lines = []
        for line in text.split("\n"):
            if len(line.strip(" \t\r\x0b\x0c")) < min_chars:
                lines.append(line)
                continue
            if line not in earlier:
                near = any(within_one_edit(line, x) for n in (-1, 0, 1) for x in by_size[len(line) + n])
                earlier.add(line)
                by_size[len(line)].append(line)
                if near:
                    continue
                lines.append(line)
        kept[i] = "\n".join(lines)
    return kept


KINDS = (
    ("assign", re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    ("hex", re.compile(r"[0-9a-f]+"), 0, 24),
)


def base_spans(text):
    found = []
    for number, (name, pattern, group, least) in enumerate(KINDS):
        found += [(m.start(), number, m.end(), name) for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [(name, a, b) for a, _, b, name in sorted(found)]


def rules(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    cover = {j for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(cover))


def running(text, order):
    """The words of a text with single gaps, padded; nothing without words."""
    words = WORD.findall(text or "")
    return " " * (order - 1) + " ".join(words) + " " if words else ""


def kneser_ney(texts, order):
    """prob(char, context) of an interpolated modified Kneser-Ney model over running texts."""
    counts = Counter()
    for text in texts:
        padded = running(text, order)
        counts.update(padded[e - order : e] for e in range(order, len(padded) + 1))
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    discounts, after = {}, {k: defaultdict(Counter) for k in levels}
    for k, own in levels.items():
        n = Counter(own.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] + 2 * n[2] else None
        values = []
        for i in (1, 2, 3):
            d = i - (i + 1) * y * n[i + 1] / n[i] if y is not None and n[i] else None
            values.append(d if d is not None and 0 < d < i else i / 2)
        discounts[k] = values
        for g, c in own.items():
            after[k][g[:-1]][g[-1]] = c

    def prob(char, context):
        k = len(context) + 1
        lower = prob(char, context[1:]) if context else 1 / (len(levels[1]) + 1)
        seen = after[k].get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        off = lambda c: discounts[k][min(c, 3) - 1]
        back = sum(off(c) for c in seen.values()) / total
        c = seen.get(char, 0)
        return (max(c - off(c), 0) / total if c else 0) + back * lower

    return prob


def merkle(rows):
    """One dict per (doc_id, source, lang, n_chars, text) row, by building the whole tree."""

    def row_digest(values):
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def climb(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            last = levels[-1]
            levels.append([sha("".join(last[i : i + 2])) for i in range(0, len(last), 2)])
        return levels

    def path(levels, at):
        out = []
        for level in levels[:-1]:
            out.append((at % 2, level[at ^ 1] if at ^ 1 < len(level) else None))
            at //= 2
        return out

    langs = defaultdict(list)
    for row in rows:
        langs[row[2]].append((row[0] is not None, row[0] or 0, row_digest(row), row))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    trees = {name: climb([x[2] for x in sorted(langs[name], key=lambda x: x[:3])]) for name in names}
    crown = climb([trees[name][-1][0] for name in names])
    out = []
    for k, name in enumerate(names):
        for at, (_, _, leaf, row) in enumerate(sorted(langs[name], key=lambda x: x[:3])):
            doc_id, n_chars = row[0], row[3]
            digest = leaf
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None:
                digest = row_digest((*row[:3], n_chars + 1, row[4]))
            steps = path(trees[name], at) + path(crown, k)
            for is_right, sibling in steps:
                digest = sha((sibling + digest if is_right else digest + sibling) if sibling else digest)
            root = crown[-1][0]
            proof = sha("".join(s or "" for _, s in steps))
            out.append((doc_id, leaf, trees[name][-1][0], root, proof, digest, digest == root))
    return out


def runs(words, min_length=12):
    """(start, length, period) of all runs, by trying every period."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(min_length, 2 * q):
                found.setdefault((i, length), q)
            i = j + 1
    return sorted((s, length, q) for (s, length), q in found.items())


def periodic(doc_id, text, min_length=12):
    """The row of op12 for a document."""
    words = WORD.findall(text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = runs(words, min_length)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    start, length, period = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    return (doc_id, len(found), start, length, period, 1000 * length // period if found else None,
            sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
