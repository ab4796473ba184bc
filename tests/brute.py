"""Plain Python that the operators are held against."""

from collections import Counter

RC = str.maketrans("ACGT", "TGCA")


def windows(seq: str, k: int) -> list[str | None]:
    up = "".join(c.upper() if c in "acgt" else c for c in seq)
    return [w if set(w) <= set("ACGT") else None for w in (up[i : i + k] for i in range(len(up) - k + 1))]


def canonical(w: str, order: str = "ACGT") -> str:
    key = str.maketrans(order, "0123")
    r = w[::-1].translate(RC)
    return w if w.translate(key) <= r.translate(key) else r


def count(seqs, k: int, both: bool = True, order: str = "ACGT") -> Counter:
    return Counter(canonical(w, order) if both else w for s in seqs if s for w in windows(s, k) if w)


def norm(x: str) -> int:
    def one(y: str) -> int:
        bad = y.startswith("ACA") or y.endswith("TGT") or y[-3:-1] == "TT" or "AA" in y[1:]
        return 4 ** len(y) if bad else sum("ACGT".index(c) * 4**i for i, c in enumerate(reversed(y)))

    return min(one(x), one(x[::-1].translate(RC)))


def signature(w: str, p: int) -> int:
    return min(norm(w[i : i + p]) for i in range(len(w) - p + 1))


def super_kmers(seq: str, k: int, p: int, most: int = 256) -> list[tuple[int, int, int]]:
    out, begin, n, last = [], 0, 0, None
    for i, w in enumerate([*windows(seq, k), None]):
        s = signature(w, p) if w else None
        if n and (s != last or n == most):
            out.append((begin, n + k - 1, last))
            n = 0
        if s is None:
            n, last = 0, None
            continue
        begin = begin if n else i
        n, last = n + 1, s
    return out
