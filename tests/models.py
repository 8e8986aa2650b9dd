"""What the operators must compute, in a few lines of plain Python."""


def replace_all(text, keys):
    """Longest key first, equal lengths by value; literal; each on the result of the one before."""
    for value, placeholder in sorted(keys.items(), key=lambda kv: (-len(kv[0]), kv[0].encode())):
        if value and value != placeholder:
            text = text.replace(value, placeholder)
    return text


def resolve(spans, rank, threshold=0.5):
    """Spans ``(start, end, type, value)``, longest first, without large overlaps."""
    kept = []
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[1], rank[s[2]], s[2], s[3])):
        for a in kept:
            shared = min(s[1], a[1]) - max(s[0], a[0])
            if shared > 0 and shared > threshold * min(s[1] - s[0], a[1] - a[0]):
                break
        else:
            kept.append(s)
    return kept


def splice(text, spans, rank):
    """Replace by position; of shared characters the longer, then the earlier span keeps them."""
    owner = [None] * len(text)
    for s in sorted(spans, key=lambda s: (s[0] - s[1], s[0], s[1], rank[s[2]], s[2])):
        for i in range(s[0], s[1]):
            if owner[i] is None:
                owner[i] = s
    out, last = [], None
    for ch, s in zip(text, owner):
        if s is None:
            out.append(ch)
        elif s is not last:
            out.append(f"<{s[2]}>")
        last = s
    return "".join(out)
