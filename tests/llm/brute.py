"""Plain Python versions of the contracts."""

import hashlib
import re


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


PII = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def pii_base(text):
    spans = []
    for rank, (kind, pattern) in enumerate(PII.items()):
        for m in re.finditer(pattern, text or "", re.ASCII):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in m[0].split(".")),
                  "card": lambda: 14 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 10 <= len(digits) <= 15}[kind]()
            if ok:
                spans.append((m.start(), rank, kind, m.end()))
    return sorted(spans)


def pii_row(text):
    spans = pii_base(text)
    listed = ",".join(f"{k}:{a}:{b}" for a, _, k, b in spans)
    counts = [sum(s[2] == k for s in spans) for k in PII]
    return (*counts, hashlib.sha256(listed.encode()).hexdigest(), listed)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


SPACE_WORD = r"[^\x20\x09-\x0D]+"
ALNUM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def shingles(text, n=3):
    words = re.findall(SPACE_WORD, lower(text))
    return {tuple(words)} if 0 < len(words) < n else {tuple(words[i:i + n]) for i in range(len(words) - n + 1)}


def components(docs, n=3, share=(90, 100)):
    """{doc_id: (n_shingles, component)} of (doc_id, text) pairs."""
    sets = {d: shingles(t, n) for d, t in docs}
    label = {d: d for d in sets}

    def root(x):
        while label[x] != x:
            x = label[x]
        return x
    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if sets[a] and sets[b] and share[1] * len(sets[a] & sets[b]) >= share[0] * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                label[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def decontaminate(docs, benchmark, size=10):
    windows = {}
    for item, text in benchmark:
        words = re.findall(ALNUM_WORD, lower(text))
        k = min(size, len(words))
        for i in range(len(words) - k + 1 if k else 0):
            windows.setdefault(tuple(words[i:i + k]), set()).add(str(item))
    lengths = {len(w) for w in windows}
    out = {}
    for d, text in docs:
        words = re.findall(ALNUM_WORD, lower(text))
        hit, items = set(), set()
        for k in lengths:
            for i in range(len(words) - k + 1):
                if (found := windows.get(tuple(words[i:i + k]))) is not None:
                    hit.update(range(i, i + k))
                    items |= found
        out[d] = (len(words), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    return out


def repeats(docs, size=200):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen = {}
    for _, b in raw:
        for i in range(len(b) - size + 1):
            seen[b[i:i + size]] = seen.get(b[i:i + size], 0) + 1
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if seen[b[i:i + size]] > 1:
                gone[i:i + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def quality_base(text):
    text = text or ""
    words = re.findall(SPACE_WORD, text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(SPACE_WORD, line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    count = {}
    for w in windows:
        count[w] = count.get(w, 0) + 1
    hit = {j for i, w in enumerate(windows) if count[w] > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit), n < 20 or 100 * len(hit) > 30 * n)
