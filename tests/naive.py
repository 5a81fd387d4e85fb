"""Definitions of the matches in plain Python."""

TURN = str.maketrans("ACGT", "TGCA")


def norm(s):
    s = s.translate(str.maketrans("acgt", "ACGT"))
    return "".join(c if c in "ACGT" else "N" for c in s)


def occurrences(text, w):
    return [i for i in range(len(text) - len(w) + 1) if text[i : i + len(w)] == w] if w else []


def mems(refs, query, least):
    out = set()
    for k, r in enumerate(refs):
        for q0 in range(len(query)):
            for r0 in range(len(r)):
                same = lambda a, b: 0 <= a < len(query) and 0 <= b < len(r) and query[a] == r[b] != "N"
                if same(q0, r0) and not same(q0 - 1, r0 - 1):
                    n = 0
                    while same(q0 + n, r0 + n):
                        n += 1
                    if n >= least:
                        out.add((q0, k, r0, n))
    return out


def in_refs(refs, w):
    return sum(len(occurrences(r, w)) for r in refs)


def mams(refs, query, least):
    return {m for m in mems(refs, query, least) if in_refs(refs, query[m[0] : m[0] + m[3]]) == 1}


def mums(refs, query, least):
    return {m for m in mams(refs, query, least) if len(occurrences(query, query[m[0] : m[0] + m[3]])) == 1}


def smems(refs, query, least, c):
    good = {}
    for q in range(len(query)):
        for e in range(q + least, len(query) + 1):
            w = query[q:e]
            if "N" not in w and in_refs(refs, w) >= c:
                good[q] = e
    out = set()
    for q, e in good.items():
        if not any(p < q and f >= e for p, f in good.items()):
            w = query[q:e]
            n = in_refs(refs, w)
            out |= {(q, k, i, e - q, n) for k, r in enumerate(refs) for i in occurrences(r, w)}
    return out
