"""Plain Python versions of the operators, over lists of (doc_id, text)."""

import hashlib
import re
import struct
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import public_tokenizers
from tokenizers import Tokenizer

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {c: c + 32 for c in range(65, 91)}


def words(text, kind=ALNUM):
    return kind.findall((text or "").translate(FOLD))


@lru_cache
def tokenizer(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def ids_of(text, name, end):
    return tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end]


def crc(ids):
    return zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))


def token_rows(docs):
    start, out = 0, {}
    for doc_id, text in sorted(docs):
        ids = ids_of(text, "word_bpe_49k.json", 1)
        out[doc_id] = (start, len(ids), crc(ids))
        start += len(ids)
    return out


def line_rows(docs):
    lines = {d: (t or "").split("\n") for d, t in docs}
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    holders = defaultdict(set)
    for d, parts in lines.items():
        for line in parts:
            if len(key(line)) >= 20:
                holders[key(line)].add(d)
    out = {}
    for d, parts in lines.items():
        kept = [x for x in parts
                if len(holders.get(key(x), ())) < 3 or d == max(holders[key(x)])]
        out[d] = (len(parts), len(parts) - len(kept),
                  hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache",
           ("general", "public", "license"): "gpl"}


def license_rows(docs):
    out = {}
    for d, text in docs:
        w = words(text)
        places = [(i, label) for i in range(len(w)) for p, label in PHRASES.items()
                  if tuple(w[i:i + len(p)]) == p]
        starts = [i for i, _ in places]
        out[d] = (len(w), len(places), min(starts, default=None), max(starts, default=None),
                  ",".join(sorted({x for _, x in places})))
    return out


def leak_rows(docs, items, n=10):
    windows = defaultdict(set)
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - n + 1)):
            if w:
                windows[tuple(w[i:i + n])].add(item)
    sizes = {len(k) for k in windows}
    out = {}
    for d, text in docs:
        w, hit, found = words(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                if (k := tuple(w[i:i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[k]
        out[d] = (len(w), len(hit), len(found),
                  hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(),
                  bool(hit))
    return out


def rule_rows(docs):
    out = {}
    for d, text in docs:
        w = BLANKS.findall(text or "")
        grams = Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
        repeated = {j for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1
                    for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if BLANKS.search(x)]
        out[d] = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")),
                  len(lines) - len(set(lines)), len(repeated),
                  len(w) < 10 or 100 * len(repeated) > 20 * len(w))
    return out


def shingles(text):
    w = words(text, BLANKS)
    return {tuple(w[i:i + 2]) for i in range(max(1, len(w) - 1))} if w else set()


def near_rows(docs):
    sets = {d: shingles(t) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        common = Counter(b for x in sets[a] for b in holders[x] if b > a)
        for b, n in common.items():
            if 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d), root(d) == d) for d in sets}


def page_rows(pages):
    payloads = {p: (h or "").encode() for p, h in pages}
    first = {}
    for p in sorted(payloads):
        first.setdefault(payloads[p], p)
    return {p: (len(b), hashlib.sha256(b).hexdigest(),
                *(("revisit", first[b]) if len(b) >= 100 and first[b] != p
                  else ("response", None))) for p, b in payloads.items()}


def check_packing(docs, rows, window=1024):
    """Every piece is right, sequences are gapless; returns how many there are."""
    texts, by_doc, by_sequence = dict(docs), defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for d, parts in by_doc.items():
        ids, parts = ids_of(texts[d], "byte_bpe_50k.json", 2), sorted(parts, key=lambda r: r["piece"])
        assert [r["piece"] for r in parts] == list(range(len(parts)))
        assert len(parts) == -(-len(ids) // window)
        at = 0
        for r in parts:
            assert r["start"] == at
            assert r["ids_crc32"] == crc(ids[at:at + r["length"]])
            assert r["length"] == window or r["piece"] == 0
            at += r["length"]
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window
    return len(by_sequence)


def license_findings(text, rules, scores, base):
    """(labels, score) by trying every rule everywhere and comparing all pairs of findings."""
    form = " ".join(words(text)) + " " if words(text) else ""
    found = []
    for label, tier, _, expression in rules:
        for m in re.finditer(expression, form):
            start = form[:m.start()].count(" ")
            found.append((start, start + m[0].count(" "), tier, label))
    stays = [d for d in found if not any(
        o != d and o[0] <= d[0] and d[1] <= o[1] and o[2] <= d[2]
        and ((o[0], o[1], o[2]) != (d[0], d[1], d[2]) or o[3] < d[3]) for o in found)]
    named = [d for d in found if d[2] == base]
    return (",".join(sorted({d[3] for d in stays + named})),
            max([scores[d[2]] for d in stays + named], default=0.0))
