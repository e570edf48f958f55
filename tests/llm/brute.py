"""The contracts once more, row by row in plain Python, for small tables."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def text_of(text) -> bytes:
    return (text or "").encode()


def exact(docs):
    """(doc_id, keep_id, group_size, kept, text_sha256) per row."""
    groups = defaultdict(list)
    for i, text in docs:
        groups[SPACE.sub(b" ", text_of(text))].append(i)
    out = []
    for i, text in docs:
        plain = SPACE.sub(b" ", text_of(text))
        ids = [x for x in groups[plain] if x is not None]
        keep = min(ids) if ids else None
        out.append((i, keep, len(groups[plain]), i == keep, sha(plain)))
    return out


def fingerprint(text) -> int:
    words = [w for w in SPACE.split(text_of(text).lower()) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def simhash(docs):
    """(doc_id, fingerprint, component_id) per row."""
    prints = [fingerprint(t) for _, t in docs]
    distinct = sorted(set(prints))
    parent = {p: p for p in distinct}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in range(len(distinct)):
        for b in range(a):
            if (distinct[a] ^ distinct[b]).bit_count() <= 2:
                parent[root(distinct[a])] = root(distinct[b])
    least = {}
    for (i, _), p in zip(docs, prints):
        r = root(p)
        if i is not None and (least.get(r) is None or i < least[r]):
            least[r] = i
        least.setdefault(r, None)
    return [(i, f"{p:016x}", least[root(p)]) for (i, _), p in zip(docs, prints)]


def bench_words(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(docs, items, window=10):
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row."""
    grams = defaultdict(set)
    for item, text in items:
        words = bench_words(text)
        k = min(window, len(words))
        for s in range(len(words) - k + 1) if words else []:
            grams[tuple(words[s : s + k])].add(item)
    lengths = {len(g) for g in grams}
    out = []
    for i, text in docs:
        words = bench_words(text)
        hit, found = set(), set()
        for k in lengths:
            for s in range(len(words) - k + 1):
                if (g := tuple(words[s : s + k])) in grams:
                    hit |= set(range(s, s + k))
                    found |= {str(x) for x in grams[g] if x is not None}
        out.append((i, len(words), len(hit), len(found), sha(",".join(sorted(found)).encode()), bool(hit)))
    return out


def word_windows(docs, k=50):
    """(doc_id, n_words, n_removed, kept_sha256) per row."""
    split = [[w for w in SPACE.split(text_of(t)) if w] for _, t in docs]
    order = [(i is None, i or 0) for i, _ in docs]
    first = {}
    for o, words in zip(order, split):
        for s in range(len(words) - k + 1):
            g = tuple(words[s : s + k])
            first[g] = min(first.get(g, o), o)
    out = []
    for (i, _), o, words in zip(docs, order, split):
        gone = set()
        for s in range(len(words) - k + 1):
            if first[tuple(words[s : s + k])] < o:
                gone |= set(range(s, s + k))
        kept = b" ".join(w for n, w in enumerate(words) if n not in gone)
        out.append((i, len(words), len(gone), sha(kept)))
    return out


def byte_windows(docs, k=100):
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) per row; ids differ."""
    first = {}
    ordered = sorted(((i is None, i or 0), text_of(t)) for i, t in docs)
    for o, text in ordered:
        for s in range(len(text) - k + 1):
            first.setdefault(text[s : s + k], (o, s))
    out = []
    for i, t in docs:
        text, o = text_of(t), (i is None, i or 0)
        gone = bytearray(len(text))
        for s in range(len(text) - k + 1):
            if first[text[s : s + k]] < (o, s):
                gone[s : s + k] = b"\x01" * k
        spans = len(re.findall(b"\x01+", bytes(gone)))
        kept = bytes(c for c, g in zip(text, gone) if not g)
        out.append((i, len(text), sum(gone), spans, sha(kept)))
    return out


def chats(rows):
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256) per conversation."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in convs.items():
        turns.sort()
        told = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha(told.encode()), len(loss), sha(loss.encode())))
    return out


def recurring_lines(docs, min_docs=3, depth=3, similarity=0.7):
    """(doc_id, n_lines, dropped) per row."""

    def masked(line):
        tokens = [t for t in re.split(r"[\x20\x09-\x0D]+", line) if t]
        return " ".join("<*>" if re.search("[0-9]", t) else t for t in tokens)

    lines = [[masked(line) for line in (t or "").split("\n")] for _, t in docs]
    counts = defaultdict(int)
    for own in lines:
        for m in set(own) - {""}:
            counts[m] += 1
    leaves = defaultdict(list)
    for m in counts:
        tokens = m.split(" ")
        leaves[len(tokens), " ".join(tokens[:depth])].append(m)
    template, holders = {}, defaultdict(set)
    for leaf in leaves.values():
        leader = min(leaf, key=lambda m: (-counts[m], m.encode()))
        for m in leaf:
            equal = sum(a == b for a, b in zip(m.split(" "), leader.split(" ")))
            template[m] = leader if equal >= similarity * len(m.split(" ")) else m
    for row, own in enumerate(lines):
        for m in set(own) - {""}:
            holders[template[m]].add(row)
    return [
        (i, len(own), [k for k, m in enumerate(own) if m and len(holders[template[m]]) >= min_docs])
        for (i, _), own in zip(docs, lines)
    ]


TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(text_of(text).lower())


def ranked(docs, items, k=10):
    """(item_id, rank, doc_id, score); rows of documents are documents of their own."""
    from math import floor, log

    held = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    total, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    asked = defaultdict(set)
    for item, text in items:
        asked[item].update(terms(text))
    out = []
    for item, wanted in asked.items():
        scored = []
        for i, c, n in held:
            m = 100 - 90 + (90 * n * total) // words
            s = 0
            for t in wanted & c.keys():
                s += floor(1000 * log((2 * total + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i))
        out += [(item, r, i, -s) for r, (s, _, i) in enumerate(sorted(scored, key=lambda x: x[:2] + (x[2] or 0,))[:k], 1)]
    return out


def aligned(docs, encode_a, encode_b):
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups); encoders give (id, bytes) pairs."""
    made, counts = [], Counter()
    for i, text in docs:
        a, b = ([], []) if not text else (encode_a(" " + text), encode_b(text))
        told = (" " + (text or "")).encode()
        if b"".join(x for _, x in a) != told or b"".join(x for _, x in b) != told:
            made.append((i, [], [], [], []))
            continue
        spans = []
        for ids in (a, b):
            at, own = 0, []
            for _, x in ids:
                own.append((at, at + len(x)))
                at += len(x)
            spans.append(own)
        links = [
            (a[p][0], b[q][0])
            for p, (s, e) in enumerate(spans[0])
            for q, (u, v) in enumerate(spans[1])
            if s < v and u < e
        ]
        ends = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups = []
        for low, high in zip([0] + ends, ends):
            sides = [[str(x) for (x, _), (_, e) in zip(ids, own) if low < e <= high] for ids, own in zip((a, b), spans)]
            groups.append("|".join(map(",".join, sides)))
        counts.update(links)
        made.append((i, a, b, groups, links))
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    return [
        (i, len(a), len(b), len(g), len(ls), sum(counts[x] == most[x[1]] for x in ls), sum(counts[x] for x in ls), ";".join(g))
        for i, a, b, g, ls in made
    ]


def gram_counts(text, buckets, sizes):
    """n-grams of bytes one by one, hashed with Python's numbers."""
    words = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in text.lower()).encode()
    data = b" " + b" ".join(words.split()) + b" "
    counts, mask = [0] * buckets, (1 << 32) - 1
    for n in sizes:
        for at in range(len(data) - n + 1):
            h = 0
            for k in range(1, n + 1):
                h = (h * 0x01000193 + data[at + k - 1] + k) & mask
            counts[((h ^ h >> 15) * 0x9E3779B1 & mask) >> 32 - 13] += 1
    return counts
