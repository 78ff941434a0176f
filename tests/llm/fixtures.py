"""Small tables with every awkward case, and plain restatements of the operators."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, kept string, part int"


def rows(seed: int = 3, n: int = 60) -> list[tuple]:
    """Documents with copies, near copies, shared passages and lines, long and odd ones."""
    rng = random.Random(seed)
    vocab = [f"w{k}" for k in range(400)] + ["Été", "straße", "a b", "x" * 30]
    words = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, line = " ".join(words(25)), " ".join(words(9))
    texts: list[str | None] = []
    for k in range(n):
        lines = [" ".join(words(rng.randint(1, 14))) for _ in range(rng.randint(1, 6))]
        if k % 4 == 0:
            lines.insert(rng.randint(0, len(lines)), passage)
        if k % 3 == 0:
            lines.insert(rng.randint(0, len(lines)), line)
        texts.append("\n".join(lines))
    for k in range(0, n, 3):
        near = texts[k].split(" ")
        near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [texts[1]] * 12 + [texts[5].upper(), "", "   \n\t ", "one", "one", "ONE two", None, None, "\n\n" + line + "\n" + line]
    texts.append(" ".join(words(6000)) + " " + passage)
    out = [(100 + 7 * k, t, "en", "src0", len(t or ""), 0.5, "x", 1) for k, t in enumerate(texts)]
    out.append(out[2])
    out.append((None, texts[2], "en", "src0", 1, None, None, None))
    rng.shuffle(out)
    return out


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().split()


def shingles(text: str | None, size: int = 5) -> set:
    w = [x.lower() for x in words_of(text)]
    return {tuple(w[k:k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def similar(a: set, b: set, percent: int = 80) -> bool:
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def classes(table: list[tuple]) -> dict[int, int]:
    """Smallest id reachable by links, of each id."""
    ids = [r[0] for r in table if r[0] is not None]
    sets = {r[0]: shingles(r[1]) for r in table if r[0] is not None}
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and similar(sets[a], sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def later_lines(table: list[tuple]) -> dict[int, str]:
    """Texts without lines that match a line of an earlier place."""
    places = []
    for i, text in {(r[0], r[1]) for r in table if r[0] is not None and r[1] is not None}:
        for k, line in enumerate(text.split("\n")):
            w = frozenset(x.lower() for x in words_of(line))
            if w:
                places.append((i, k, w))
    out = {}
    for i, text in {(r[0], r[1]) for r in table if r[0] is not None}:
        if text is None:
            out[i] = None
            continue
        gone = {k for j, k, w in places if j == i and any((a, b) < (i, k) and similar(w, v) for a, b, v in places)}
        out[i] = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone)
    return out


def repeated_words(table: list[tuple], size: int = 20) -> dict[int, tuple[int, int, str]]:
    """``n_words, n_removed, kept`` of each id; ids are taken to have one text each."""
    seen, out = set(), {}
    for i, text in sorted({(r[0], r[1]) for r in table if r[0] is not None}, key=lambda r: r[0]):
        w = words_of(text)
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k:k + size])
            if window in seen:
                gone[k:k + size] = [True] * size
            seen.add(window)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def base_counts(text: str | None) -> tuple:
    w, t = words_of(text), text or ""
    found: dict = {}
    for k in range(len(w) - 2):
        found.setdefault(tuple(w[k:k + 3]), []).append(k)
    covered = {k + j for at in found.values() if len(at) > 1 for k in at for j in range(3)}
    lines = [x for x in t.split("\n") if words_of(x)]
    return (
        len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)),
        len(lines) - len(set(lines)), len(covered),
    )
