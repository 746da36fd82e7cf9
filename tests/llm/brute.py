"""Plain versions of the operators for small fixtures."""

import hashlib
import re
from collections import Counter, defaultdict

import regex
import xxhash
import zstandard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return WORD.findall(text or "")


def repeats(rows, length):
    """(doc_id, n_words, n_removed, kept) in input order."""
    ws = [words(t) for _, t in rows]
    seen = Counter(tuple(w[i:i + length]) for w in ws for i in range(len(w) - length + 1))
    out = []
    for (k, _), w in zip(rows, ws):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i:i + length])] > 1:
                gone[i:i + length] = [True] * length
        out.append((k, len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g)))
    return out


def strings(rows, length):
    """(doc_id, n_bytes, n_removed, spans, kept)."""
    order = lambda k: (k is None, k or 0)
    first = {}
    data = [((k, (t or "").encode())) for k, t in rows]
    for k, x in data:
        for i in range(len(x) - length + 1):
            s = x[i:i + length]
            first[s] = min(first.get(s, order(k)), order(k))
    out = []
    for k, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - length + 1):
            if first[x[i:i + length]] < order(k):
                gone[i:i + length] = b"\1" * length
        spans = [(m.start(), m.end()) for m in re.finditer(b"\1+", bytes(gone))]
        out.append((k, len(x), sum(gone), spans, bytes(b for b, g in zip(x, gone) if not g)))
    return out


def shingles(text, size):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i:i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def groups(rows, size, percent):
    """doc_id -> (n_shingles, component) by comparing all pairs; ids are unique."""
    sets = {k: shingles(t, size) for k, t in rows}
    label = {k: k for k in sets}

    def top(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((top(a), top(b)))
                label[y] = x
    return {k: (len(sets[k]), top(k)) for k in keys}


def quality(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    seen = Counter(windows)
    covered = {i + j for i, x in enumerate(windows) if seen[x] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def boilerplate(rows, sites):
    """Texts without the lines on at least ``sites`` sites; rows are (text, source)."""
    bare = lambda x: x.strip(" \t\n\x0b\x0c\r")
    where = defaultdict(set)
    for t, s in rows:
        for line in (t or "").split("\n"):
            if s is not None:
                where[bare(line)].add(s)
    return [None if t is None else "\n".join(x for x in t.split("\n") if not bare(x) or len(where[bare(x)]) < sites) for t, _ in rows]


def tiled(doc, item, seed, fold=False):
    """Tokens of the item covered by greedy string tiling, straight from the definition."""
    plain = lambda t: re.split(r"[\x00-/:-@\[-`{-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    wide = lambda t: regex.split(r"[^\p{L}\p{M}\p{N}]+", (t or "").upper())
    a, b = ([x for x in (wide if fold else plain)(t) if x] for t in (doc, item))
    least = min(seed, len(b))
    mine, theirs, covered = [False] * len(a), [False] * len(b), 0
    while b:
        best = (0, 0, 0)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not mine[i + n] and not theirs[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            break
        mine[i:i + n] = theirs[j:j + n] = [True] * n
        covered += n
    return covered, len(b)


def dictionaries(rows, most, size):
    """lang -> dictionary from rows (text, lang): whole texts of smallest signed hash."""
    texts = defaultdict(set)
    for t, lang in rows:
        if t and lang is not None and regex.search(r"\p{L}", t):
            texts[lang].add(t)
    signed = lambda t: (xxhash.xxh64_intdigest(t.encode(), 42) + (1 << 63)) % (1 << 64)
    out = {}
    for lang, some in texts.items():
        n = Counter(w for t in sorted(some, key=signed)[:most] for w in t.split())
        out[lang] = " ".join(sorted(n, key=lambda w: (n[w], w))).encode()[-size:]
    return out


def language(text, known, piece=1024, level=6):
    """(language, its compressed size) by a plain loop; the first of equals."""
    if not text or not known or not regex.search(r"\p{L}", text):
        return "und", 0
    sizes = {}
    for lang in sorted(known):
        d = zstandard.ZstdCompressionDict(known[lang], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        tool = zstandard.ZstdCompressor(level=level, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes[lang] = sum(len(tool.compress(text[i:i + piece].encode())) for i in range(0, len(text), piece))
    best = min(sizes, key=sizes.get)
    return best, sizes[best]


def sha(data):
    return hashlib.sha256(data).hexdigest()
