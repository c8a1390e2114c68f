"""Rows that operators must take without a fuss, and plain versions of what they compute."""

import hashlib
import re

import xxhash

LONG = "lorem ipsum dolor sit amet " * 20000
TEXTS = [
    (1, "The quick brown fox jumps over the lazy dog and runs away from it again."),
    (2, "The quick brown fox jumps over the lazy dog and runs away from it again."),
    (3, "The  quick brown fox\njumps over the lazy dog and runs away from it again. "),
    (4, ""),
    (5, None),
    (6, " \t\n"),
    (7, "12 + 34 = 46 !!"),
    (8, LONG),
    (8, LONG),
    (9, "Éclair à la crème, déjà vu. 漢字 \U0001f600 <|endoftext|> ▁ x"),
    (None, "a row without an id"),
    (None, None),
    (10, "a"),
    (11, "a"),
]
#: Names that operators use themselves.
CLASHES = ("row", "key", "fp", "print", "words", "cell", "kept", "first", "last", "count", "n", "start", "ids", "score", "_id", "_gone", "found", "sections", "r", "g")


def odd(spark, texts=TEXTS):
    rows = [(i, t, "en", "src", None if t is None else len(t), *["x"] * len(CLASHES)) for i, t in texts]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


def none(spark):
    return odd(spark).limit(0)


def benchmark(spark, items):
    return spark.createDataFrame(items, "item_id long, text string")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def contamination(docs, items, window=10):
    """doc -> (n_words, n_hit, n_items, sha) for (id, text) pairs."""
    wanted = {}
    for item, text in items:
        w = words(text)
        n = min(window, len(w))
        for s in range(len(w) - n + 1 if n else 0):
            wanted.setdefault(tuple(w[s:s + n]), set()).add(str(item))
    out = {}
    sizes = {len(k) for k in wanted}
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if tuple(w[s:s + n]) in wanted:
                    hit |= set(range(s, s + n))
                    found |= wanted[tuple(w[s:s + n])]
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out


def simhash(text, size=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(w[i:i + size]) for i in range(max(1, len(w) - size + 1))] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def groups(prints, bits=4):
    """id -> smallest id reachable, for (id, fingerprint) pairs."""
    up = list(range(len(prints)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= bits:
                a, b = find(i), find(j)
                up[a] = b
    least = {}
    for i, (k, _) in enumerate(prints):
        least[find(i)] = min(least.get(find(i), k), k)
    return {k: least[find(i)] for i, (k, _) in enumerate(prints)}


def normalised(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def exact(docs):
    """id -> (keep_id, size, kept, sha)."""
    by = {}
    for k, t in docs:
        by.setdefault(normalised(t), []).append((-len(t or ""), k))
    out = {}
    for norm, members in by.items():
        keep = min(members)[1]
        for _, k in members:
            out[k] = (keep, len(members), k == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def repeats(docs, size=100):
    """id -> (n_bytes, n_removed, n_spans, sha), in the order given."""
    seen, out = set(), {}
    for k, t in docs:
        data = (t or "").encode()
        gone = [False] * len(data)
        for s in range(len(data) - size + 1):
            w = data[s:s + size]
            if w in seen:
                gone[s:s + size] = [True] * size
            seen.add(w)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out[k] = (len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest())
    return out
