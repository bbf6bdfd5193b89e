"""Plain Python versions of the operators' results."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def base_counts(text):
    w, seen, dup = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n, cov = Counter(win), set()
    for i, x in enumerate(win):
        if n[x] > 1:
            cov.update(range(i, i + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(cov)


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def groups(items, linked):
    """Smallest id reachable of every id."""
    at = {i: i for i in items}

    def root(i):
        while at[i] != i:
            i = at[i]
        return i
    for a, b in linked:
        a, b = root(a), root(b)
        at[max(a, b)] = min(a, b)
    return {i: root(i) for i in items}


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=3):
    w = words((text or "").translate(LOWER))
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def components(texts):
    sets = {k: shingles(t) for k, t in texts.items()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[i + 1:]
             if (both := len(sets[a] & sets[b])) and 100 * both >= 85 * len(sets[a] | sets[b])]
    return {k: len(s) for k, s in sets.items()}, groups(ids, links)


def without_windows(texts, n=20):
    """Per id: words, removed words, text left; windows judged on the input."""
    seen, out = set(), {}
    for k in sorted(texts):
        w = words(texts[k])
        gone = set()
        for i in range(len(w) - n + 1):
            x = tuple(w[i:i + n])
            if x in seen:
                gone.update(range(i, i + n))
            seen.add(x)
        out[k] = len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)
    return out


def without_lines(texts, least=5):
    one, two, out = set(), set(), {}
    for k in sorted(texts):
        lines = (texts[k] or "").split("\n")
        at = [i for i, x in enumerate(lines) if WORD.search(x)]
        gone = set()
        for j, i in enumerate(at):
            if lines[i] in one and len(words(lines[i])) >= least:
                gone.add(i)
            one.add(lines[i])
            if j + 1 < len(at):
                pair = lines[i], lines[at[j + 1]]
                if pair in two:
                    gone |= {i, at[j + 1]}
                two.add(pair)
        out[k] = 0 if texts[k] is None else len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)
    return out


def _hash(values):
    seed = 42
    for v in values:
        seed = xxhash.xxh64(v if isinstance(v, bytes) else v.to_bytes(8, "little"), seed=seed).intdigest()
    return seed


def marks(text, k=4, w=8):
    """Winnowing: (hash, position), rightmost of equal least hashes."""
    h = [_hash([x.encode()]) for x in words(text)]
    if not h:
        return []
    if len(h) < k:
        g = [_hash(h) & 0x7FFFFFFF]
    else:
        two = [_hash([h[i], h[i + 1]]) for i in range(len(h) - 1)]
        g = [_hash([two[i], two[i + 2]]) & 0x7FFFFFFF for i in range(len(h) - 3)]
    out = []
    for i in range(max(1, len(g) - w + 1)):
        x, j = min((x, -j) for j, x in list(enumerate(g))[i:i + w])
        if not out or out[-1] != (x, -j):
            out.append((x, -j))
    return out


def likeness(a, b):
    x, y = {h for h, _ in a}, {h for h, _ in b}
    return len(x & y) / len(x | y) if x | y else 1.0


def mix(rows, weights=(3, 1, 2), share=1.5):
    """taken words per row of (doc_id, source, size), targets per source."""
    sizes = defaultdict(int)
    for _, s, n in rows:
        sizes[s] += n
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    budget, target, free = share * sum(sizes.values()), {}, set(order)
    while True:
        level = (budget - sum(target.values())) / max(sum(w[s] for s in free), 1)
        over = {s for s in free if 2 * sizes[s] < w[s] * level - 1e-9}
        if not over:
            return target | {s: w[s] * level for s in free}, dict(sizes)
        target |= {s: 2.0 * sizes[s] for s in over}
        free -= over


def periodic(doc_id, w):
    """The words of a text after about one in ten is made periodic."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not w:
        return w
    g, n = h // 10, len(w)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]


def runs(w, least=12):
    """(start, length, period) of all runs, by trying every period."""
    out, n = [], len(w)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q) and not any(s <= i and s + m >= j + q for s, m, _ in out):
                out.append((i, j + q - i, q))
            i = j + 1
    return sorted(out, key=lambda x: (x[0], x[2]))
