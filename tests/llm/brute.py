"""Plain versions of the operators' contracts, for small tables."""
import re


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in re.split("[\x20\x09-\x0d]+", lower) if w]


def shingles(text, n=5):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def components(docs):
    """{doc_id: (n_shingles, component_id)} by comparing all pairs."""
    sets = {i: shingles(t) for i, t in docs.items()}
    up = {i: i for i in docs}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(docs)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and 3 * min(len(x), len(y)) // 2 >= max(len(x), len(y)):
                common = len(x & y)
                if 100 * common >= 75 * (len(x) + len(y) - common):
                    p, q = root(a), root(b)
                    up[max(p, q)] = min(p, q)
    return {i: (len(sets[i]), root(i)) for i in ids}


ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def secret_spans(text):
    out = []
    for order, (kind, pattern, least) in enumerate((("assign", ASSIGN, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 20),
                                                    ("hex", re.compile("[0-9a-f]+"), 24))):
        for m in pattern.finditer(text or ""):
            if len(m.group(2) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


def repeated_runs(texts, least=200):
    """Per text the maximal runs covered by ``least``-byte strings that start at two or more places."""
    raw = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for b in raw:
        for i in range(len(b) - least + 1):
            (twice if b[i:i + least] in seen else seen).add(b[i:i + least])
    result = []
    for b in raw:
        runs = []
        for i in range(len(b) - least + 1):
            if b[i:i + least] in twice:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + least
                else:
                    runs.append([i, i + least])
        result.append(runs)
    return raw, result
