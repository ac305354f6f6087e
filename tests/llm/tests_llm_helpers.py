"""Plain versions that the operators are held against."""

import xxhash


def squeezed(t):
    out, gap = [], False
    for c in t or "":
        if c in " \t\n\x0b\x0c\r":
            gap or out.append(" ")
            gap = True
        else:
            out.append(c)
            gap = False
    return "".join(out)


def simple_fingerprint(t):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    runs = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(x, 42) for x in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(ids, near):
    label = list(range(len(ids)))
    while True:
        new = [min(label[j] for j in range(len(ids)) if near[i][j]) for i in range(len(ids))]
        if new == label:
            return [min(ids[j] for j in range(len(ids)) if label[j] == label[i]) for i in range(len(ids))]
        label = new
