"""Plain Python versions of the operators, for small tables: lists of rows in, dicts by id out."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import xxhash

WS = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str | bytes) -> str:
    return hashlib.sha256(text.encode() if isinstance(text, str) else text).hexdigest()


def line_dedup(docs, min_chars=40, min_docs=5):
    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(WS))

    holders = defaultdict(set)
    for d, t in docs:
        for line in (t or "").split("\n"):
            if d is not None and len(key(line)) >= min_chars:
                holders[key(line)].add(d)
    out = {}
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if d is None or len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out[d] = (len(lines), len(lines) - len(kept), sha("\n".join(kept)))
    return out


def substring_dedup(docs, window=35):
    words = [WORD.findall(t or "") for _, t in docs]
    seen = defaultdict(int)
    for w in words:
        for i in range(len(w) - window + 1):
            seen[tuple(w[i : i + window])] += 1
    out = []
    for (d, _), w in zip(docs, words, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone[i : i + window] = [True] * window
        out.append((d, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone, strict=True) if not g))))
    return out


def simhash(text, shingle=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    runs = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hs = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def components(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_classes(docs, distance=3, fps=None):
    fps = fps or {d: simhash(t) for d, t in docs}
    first = {}
    for d in sorted(fps):
        first.setdefault(fps[d], d)
    u = np.array(sorted(first), np.uint64)
    links = []
    for i in range(len(u)):
        for j in np.flatnonzero(np.bitwise_count(u[i + 1 :] ^ u[i]) <= distance) + i + 1:
            links.append((first[int(u[i])], first[int(u[j])]))
    named = components(list(first.values()), links)
    return {d: (f"{fps[d]:016x}", named[first[fps[d]]]) for d in fps}


def packing_faults(docs_ids, pieces, capacity=2048):
    """docs_ids: {doc_id: [ids]}; pieces: (doc_id, start, length, crc, doc_tokens, sequence_id, offset). Returns the faults."""
    import struct

    faults, by_doc, by_seq = [], defaultdict(list), defaultdict(list)
    for d, start, n, crc, total, seq, off in pieces:
        by_doc[d].append((start, n))
        by_seq[seq].append((off, n))
        ids = docs_ids[d][start : start + n]
        if zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)) != crc or total != len(docs_ids[d]) or n < 1:
            faults.append(("piece", d, start))
    for d, ids in docs_ids.items():
        at = 0
        for start, n in sorted(by_doc[d]):
            if start != at:
                faults.append(("doc", d, start))
            at += n
        if at != len(ids):
            faults.append(("doc end", d, at))
    for seq, parts in by_seq.items():
        at = 0
        for off, n in sorted(parts):
            if off != at:
                faults.append(("sequence", seq, off))
            at += n
        if at > capacity:
            faults.append(("long", seq, at))
        if at != capacity and at & (at - 1):
            faults.append(("padded", seq, at))
    return faults


def vector_links(rows, threshold=0.93):
    """rows: (vec_id, label, vector or None), ids distinct. Returns {vec_id: (n_links, component_id, kept)}."""
    def good(v):
        return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)

    ok = [(i, lab, np.array(v, np.float64)) for i, lab, v in rows if lab is not None and good(v)]
    links, counts = [], {i: 0 for i, _, _ in rows}
    by = defaultdict(list)
    for i, lab, v in ok:
        by[(lab, len(v))].append((i, v / np.linalg.norm(v)))
    for group in by.values():
        x = np.stack([v for _, v in group])
        for a, s in enumerate(x @ x.T):
            for b in np.flatnonzero(s >= threshold):
                if a != b:
                    counts[group[a][0]] += 1
                    links.append((group[a][0], group[b][0]))
    root = components([i for i, _, _ in rows], links)
    return {i: (counts[i], root[i], root[i] == i) for i, _, _ in rows}


def nearest(rows, queries, k):
    """rows: (id, vector); {query: [(id, score)]} by largest inner product, ties to the smaller id."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], np.float64)
    out = {}
    for q in queries:
        s = x @ x[np.flatnonzero(ids == q)[0]]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def warc(pages):
    """{(page_id, digest): (payload_bytes, record_type, refers_to)} of (page_id, html) rows."""
    import base64

    kept = {}
    for p, html in pages:
        body = (html or "").encode()
        if body not in kept or kept[body] is None or (p is not None and p > kept[body]):
            kept[body] = p
    out = []
    for p, html in pages:
        body = (html or "").encode()
        same = p == kept[body]
        out.append((p, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if same else "revisit",
                    None if same else kept[body]))
    return out


def _one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def spelling(docs, min_length=5, min_count=3):
    """{word: (form, root, n, n_near, form_n)}."""
    counts = defaultdict(int)
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                i = h % len(run)
                run = run[:i] + run[i + 1 :]
            if len(run) >= min_length:
                counts[run] += 1
    n = {w: c for w, c in counts.items() if c >= min_count}
    near = {w: [v for v in n if _one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def vector_codes(rows, parts=4, entries=256, rounds=4):
    """([(vec_id, code, error, label_error)], codebooks) of (vec_id, label, vector) rows, in Python integers."""
    import math

    good = [(i, lab, [math.floor(1024 * x) for x in v]) for i, lab, v in rows
            if v and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(good, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    w = len(good[0][2]) // parts
    books = [[r[2][p * w : (p + 1) * w] for r in first] for p in range(parts)]

    def best(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            held = defaultdict(list)
            for r in good:
                x = r[2][p * w : (p + 1) * w]
                held[best(x, books[p])[1]].append(x)
            books[p] = [[sum(c) // len(held[k]) for c in zip(*held[k], strict=True)] if held[k] else e for k, e in enumerate(books[p])]
    coded = [(r[0], r[1], [best(r[2][p * w : (p + 1) * w], books[p]) for p in range(parts)]) for r in good]
    total = defaultdict(int)
    for _, lab, b in coded:
        total[lab] += sum(d for d, _ in b)
    return [(i, "".join(f"{k:02x}" for _, k in b), sum(d for d, _ in b), total[lab]) for i, lab, b in coded], books
