"""Plain versions of the operators' contracts, to hold results against."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall(text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def targets(sizes, most=3):
    """Shares of all sizes by weight 1, 2, 3; what is above three times a source's size is shared again."""
    names = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {n: i % 3 + 1 for i, n in enumerate(names)}
    out, free, left = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while free:
        total = sum(weight[n] for n in free)
        full = [n for n in free if left * weight[n] / total > most * sizes[n]]
        if not full:
            return out | {n: left * weight[n] / total for n in free}
        for n in full:
            out[n] = float(most * sizes[n])
        left -= sum(out[n] for n in full)
        free = [n for n in free if n not in full]
    return out


def contamination(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, digest)}"""
    windows = defaultdict(set)
    for item_id, text in items:
        own = ITEM_WORD.findall((text or "").translate(LOWER))
        size = min(window, len(own))
        for i in range(len(own) - size + 1) if own else ():
            windows[tuple(own[i: i + size])].add(str(item_id))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc_id, text in docs:
        own, hit, found = ITEM_WORD.findall((text or "").translate(LOWER)), set(), set()
        for i in range(len(own)):
            for size in sizes:
                names = windows.get(tuple(own[i: i + size])) if i + size <= len(own) else None
                if names:
                    hit |= set(range(i, i + size))
                    found |= names
        out[doc_id] = (len(own), len(hit), len(found), sha(",".join(sorted(found))))
    return out


def repeats(docs, window=35):
    """[(doc_id, n_words, n_removed, digest)] in the order of docs."""
    own = [words(t) for _, t in docs]
    count = Counter(tuple(w[i: i + window]) for w in own for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, own):
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i: i + window])] > 1 for j in range(i, i + window)}
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return out


def shingles(text, n=5):
    w = words((text or "").translate(LOWER))
    return frozenset(tuple(w[i: i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def components(docs):
    """{doc_id: (n_shingles, component_id)}"""
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter()
    for own in holders.values():
        for a in range(len(own)):
            for b in range(a):
                common[own[b], own[a]] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def quality(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed)"""
    w, text = words(text), text or ""
    count = Counter(tuple(w[i: i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if count[tuple(w[i: i + 3])] > 1 for j in range(i, i + 3)}
    lines = [x for x in text.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit),
            len(w) < 50 or 100 * len(hit) > 50 * len(w))


BASE = (("assign", re.compile(r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), 2, 12),
        ("access", re.compile("AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile("[0-9a-f]+"), 0, 16))


def secrets(text):
    """(n_assign, n_access, n_hex, digest, base spans)"""
    found = [(m.start(), k, kind, m.end()) for k, (kind, pattern, part, least) in enumerate(BASE)
             for m in pattern.finditer(text or "") if len(m[part]) >= least]
    told = [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(found)]
    return (*(sum(k == i for _, k, _, _ in found) for i in range(3)), sha(",".join(told)), told)


def held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def spelled(doc_id, text):
    """Lower-cased letter runs of 5 code points at least; some lose a letter."""
    for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
        run = run.translate(LOWER)
        code = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
        if code % 97 == 0:
            run = run[: code % len(run)] + run[code % len(run) + 1:]
        if len(run) >= 5:
            yield run


def edited_once(a, b):
    """Whether one insertion, deletion or replacement turns a into b."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    at = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[at + (len(a) == len(b)):] == b[at + 1:]


def variants(docs):
    """{word: (n, n_near, form, form_n, root)}"""
    count = Counter(w for i, t in docs for w in spelled(i, t))
    n = {w: k for w, k in count.items() if k >= 3}
    stems = defaultdict(set)
    for w in n:
        for stem in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            stems[stem].add(w)
    near = {w: {x for stem in {w} | {w[:i] + w[i + 1:] for i in range(len(w))} for x in stems[stem] if edited_once(w, x)} for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {w: (n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n}
