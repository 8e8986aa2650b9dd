"""Plain models of the operators, one document at a time."""

import hashlib
import math
import re
import zlib

import numpy as np
import xxhash


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def letter_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_key(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] if r[0] is not None else 0, repr(r)))


def components(n, linked):
    """Smallest index that links reach, for each of n."""
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, shingle=4):
    words = space_words(lowered(text))
    grams = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def simhash_rows(docs, radius=4):
    prints = [simhash(t) for _, t in docs]
    arr = np.array(prints, np.uint64)
    near = [np.bitwise_count(arr ^ x) <= radius for x in arr]
    roots = components(len(docs), lambda i, j: near[i][j])
    first = {}
    for (key, _), root in zip(docs, roots):
        if key is not None:
            first[root] = min(first.get(root, key), key)
    return [(key, f"{p:016x}", first.get(root)) for (key, _), p, root in zip(docs, prints, roots)]


def contaminated_rows(docs, items, span=10):
    windows = {}
    for item, text in items:
        words = letter_words(text)
        own = [tuple(words[i : i + span]) for i in range(len(words) - span + 1)] or ([tuple(words)] if words else [])
        for w in own:
            windows.setdefault(w, set()).add(item)
    out = []
    for key, text in docs:
        words, hit, ids = letter_words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                w = tuple(words[i : i + size])
                if w in windows:
                    hit |= set(range(i, i + size))
                    ids |= windows[w]
        ids = sorted(str(i) for i in ids if i is not None)
        out.append((key, len(words), len(hit), len(ids), sha(",".join(ids)), bool(hit)))
    return out


def unrepeated_rows(docs, window=50):
    first = {}
    for key, text in docs:
        words = space_words(text)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if key is not None:
                first[w] = min(first.get(w, key), key)
    out = []
    for key, text in docs:
        words, gone = space_words(text), set()
        for i in range(len(words) - window + 1):
            if key is not None and first[tuple(words[i : i + window])] < key:
                gone |= set(range(i, i + window))
        out.append((key, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def char_shingles(line, size=10):
    return {line[i : i + size] for i in range(len(line) - size + 1)} or {line}


def deduped_lines(docs, similarity=0.8):
    places = {}
    for key, text in sorted(docs, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            line = line.strip(" \t\r\f\v")
            if line:
                places.setdefault(line, []).append((key is not None, key or 0, i))
    sets = [char_shingles(line) for line in places]

    def linked(i, j):
        both = len(sets[i] & sets[j])
        return both >= similarity * (len(sets[i]) + len(sets[j]) - both)

    groups = {}
    for own, root in zip(places.values(), components(len(sets), linked)):
        groups.setdefault(root, []).extend(own)
    gone = {p for g in groups.values() for p in g if p != min(g)}
    out = []
    for key, text in docs:
        lines = text.split("\n") if text is not None else []
        removed = {i for known, k, i in gone if (known, k) == (key is not None, key or 0)}
        kept = None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in removed)
        out.append((key, len(lines), len(removed), kept))
    return out


def base_spans(text, luhn):
    patterns = (
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    )
    out = []
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == 1 and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == 2 and not (14 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 10 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def base_counts(text):
    words = space_words(text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    seen, duplicates = set(), 0
    for line in (text or "").split("\n"):
        if space_words(line):
            duplicates += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, duplicates, len(covered)


def phrase_places(text, phrases):
    words, places, labels = letter_words(text), [], set()
    for phrase, label in phrases:
        parts = phrase.split(" ")
        found = [i for i in range(len(words) - len(parts) + 1) if words[i : i + len(parts)] == parts]
        places += found
        if found:
            labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def trie_nodes(rows, family, most=4):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(turns)] for c, turns in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % most if family else 0
        head = c - int(math.fmod(c, family)) if family else c
        built[c] = own.get(head, [])[:h] + turns[h:]
    members, children = {}, {}
    for c in sorted(built):
        for d in range(len(built[c]) + 1):
            members.setdefault(tuple(built[c][:d]), []).append(c)
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    below, out = {}, []
    for node in sorted(members, key=len, reverse=True):
        words = len(space_words(node[-1][1])) if node else 0
        own = children.get(node, [])
        leaves = sum(below[x][0] for x in own) or 1
        saved = (len(members[node]) - 1) * words + sum(below[x][1] for x in own)
        below[node] = leaves, saved
        ends = sha(",".join(str(c) for c in members[node] if len(built[c]) == len(node)))
        parent = members[node[:-1]][0] if node else None
        out.append((members[node][0], len(node), parent, len(members[node]), len(own), leaves, saved, ends))
    return sorted(out)


def word_counts(docs, slips, min_length=7, min_count=2):
    counts = {}
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if slips and h % slips == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= min_length:
                counts[run] = counts.get(run, 0) + 1
    return sorted((w, n) for w, n in counts.items() if n >= min_count)


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def variant_rows(words, ratio=10):
    n = dict(words)
    near = {w: [x for x in n if abs(len(x) - len(w)) < 2 and one_edit(w, x)] for w in n}
    best = {w: min(xs, key=lambda x: (-n[x], x)) for w, xs in near.items() if xs}
    form = {w: x for w, x in best.items() if n[x] >= ratio * n[w]}

    def root(w):
        return root(form[w]) if w in form else w

    return sorted((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root(w)) for w in n)
