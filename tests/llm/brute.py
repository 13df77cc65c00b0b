"""Plain Python versions of the operators, for small data."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np

UPPER = re.compile("[A-Z]")


def lower(text: str | None) -> str:
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def groups(nodes, links) -> dict:
    """Smallest node reachable from each node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in parent}


def shingles(text: str | None, width: int) -> set:
    w = words(text)
    if len(w) < width:
        return {tuple(w)} if w else set()
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def near(texts: dict, width: int, percent: int) -> tuple[dict, dict]:
    sets = {k: shingles(t, width) for k, t in texts.items()}
    keys = sorted(sets)
    links = [
        (a, b)
        for i, a in enumerate(keys)
        for b in keys[i + 1 :]
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])
    ]
    return {k: len(s) for k, s in sets.items()}, groups(keys, links)


def repeats(texts: list, length: int) -> list[tuple]:
    """(n_bytes, n_removed, n_spans, sha of the rest) of each text."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = [False] * len(d)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        rest = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), sum(gone), spans, sha(rest)))
    return out


def base_scores(texts: dict, train: set) -> dict:
    tokens = {k: [*words(t), "\n"] for k, t in texts.items()}
    count = Counter(w for k in train for w in tokens[k])
    n, v = sum(count.values()), len(count)
    return {
        k: (
            len(t),
            sum(count[w] > 0 for w in t),
            n,
            sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t),
        )
        for k, t in tokens.items()
    }


def lines(texts: dict, least: int) -> dict:
    edge = " \t\n\x0b\x0c\r"
    split = {k: (t or "").split("\n") for k, t in texts.items()}
    docs = defaultdict(set)
    for k, ls in split.items():
        for line in ls:
            docs[lower(line.strip(edge))].add(k)
    gone = {key for key, ks in docs.items() if len(key) >= 1 and len(ks) >= least}
    kept = {k: [x for x in ls if lower(x.strip(edge)) not in gone] for k, ls in split.items()}
    return {k: (len(ls), len(ls) - len(kept[k]), sha("\n".join(kept[k]))) for k, ls in split.items()}


def passages(texts: dict, width: int) -> dict:
    """(words, words removed, rest) of each text; keys in their order, None first."""
    split = {k: re.findall(r"[^\x20\x09-\x0D]+", texts[k] or "") for k in sorted(texts, key=lambda k: (k is not None, k))}
    seen, out = set(), {}
    for k, w in split.items():
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            window = tuple(w[i : i + width])
            if window in seen:
                gone[i : i + width] = [True] * width
            seen.add(window)
        out[k] = (len(w), sum(gone), " ".join(x for x, g in zip(w, gone) if not g))
    return out


def collocations(rows: list, least: int, top: int) -> list[tuple]:
    """(lang, rank, phrase, a, l, r, n, score)."""
    found: dict = defaultdict(Counter)
    n: Counter = Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lower(text)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                found[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in found.items():
        many = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        best = []
        for p, a in many.items():
            inside = any(
                len(q) > len(p) and 100 * b >= 100 * a and any(q[i : i + len(p)] == p for i in range(len(q)))
                for q, b in many.items()
            )
            if not inside:
                score, k = min((1000 * a * n[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                best.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def machine(x, y, p) -> tuple:
    """A factorisation machine trained on a dense matrix: bias, weights, factors of the
    columns that occur."""
    x = x[:, x.any(axis=0)]
    n, share, odds = len(y), x.mean(0), (y.sum() + 0.5) / (len(y) + 1)
    noise = np.sqrt((share * (1 - share) + 0.25 / n) * odds * (1 - odds) / n)
    draw = np.random.default_rng(p.seed)
    batches = np.array_split(draw.permutation(n), max(1, -(-n // p.batch)))
    theta = [np.array([np.log(odds / (1 - odds))]), np.zeros(x.shape[1]), draw.normal(0, 0.05, (x.shape[1], p.rank))]
    mean, square, reach = [0 * t for t in theta], [0 * t for t in theta], 0.0
    for step in range(1, p.steps + p.free + 1):
        rows = batches[(step - 1) % len(batches)]
        a, alone, free = x[rows], step <= p.alone, step > p.steps
        if step == p.steps + 1:
            held = [None, theta[1] != 0, (theta[2] != 0).any(1)[:, None]]
            mean[1], mean[2] = mean[1] * held[1], mean[2] * held[2]
        v = theta[2] * (not alone)
        pairs = np.triu(v @ v.T, 1)
        raw = theta[0] + a @ theta[1] + np.einsum("ri,ij,rj->r", a, pairs, a)
        rms = np.sqrt(((a @ v) ** 2).sum(1).mean())
        reach = 0.9 * reach + 0.1 * rms if reach else rms
        g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[rows]) / len(rows)
        both = (a * g[:, None]).T @ a
        np.fill_diagonal(both, 0)
        grads = [np.array([g.sum()]), a.T @ g + p.decay / n * theta[1], both @ v + p.decay / n * theta[2]]
        rate = p.rate * min(1, 2 * (1 - step / (p.steps + p.free * free + 1)))
        for k in range(2 if alone else 3):
            age = step - p.alone * (k == 2)
            mean[k] = 0.9 * mean[k] + 0.1 * grads[k]
            square[k] = 0.999 * square[k] + 0.001 * grads[k] ** 2
            scale = rate / (np.sqrt(square[k] / (1 - 0.999**age)) + 1e-8)
            t = theta[k] - scale * mean[k] / (1 - 0.9**age)
            if free and k:
                t = t * held[k]
            elif k == 1:
                t = np.sign(t) * np.maximum(np.abs(t) - scale * p.strict * noise, 0)
            elif k == 2:
                ripe = min(1.0, (step - p.alone) / (0.7 * (p.steps - p.alone)))
                least = scale.mean(1) * reach * (p.loose + (p.tight - p.loose) * ripe) * noise
                t = t * np.maximum(0, 1 - least / np.maximum(np.linalg.norm(t, axis=1), 1e-9))[:, None]
            theta[k] = t
    return float(theta[0][0]), theta[1], theta[2]


_EDGE = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "$%")


def _typed(text: str | None) -> tuple[list, list, list]:
    """Words, the tokens (type or "", words) with their first word, and the lines' bounds."""
    from promptsieve.llm.decontaminate import NUMBER_WORDS, UNITS

    out, tokens, lines, before = [], [], [], None
    for line in (text or "").split("\n"):
        found = re.findall(r"[^\x20\x09-\x0D]+", line)
        lines.append((len(out), len(out) + len(found)))
        for w in found:
            left, right = len(w) - len(w.lstrip(_EDGE)), len(w) - len(w.rstrip(_EDGE))
            bare = w.strip(_EDGE) or w
            if bare == w:
                left = right = 0
            low = bare.lower()
            number = bool(re.fullmatch(r"[0-9.,:/+\-%$]*[0-9][0-9.,:/+\-%$]*", low))
            spelt = low in NUMBER_WORDS
            glued = re.fullmatch(r"([0-9.,:/+\-%$]*[0-9][0-9.,:/+\-%$]*)(\D.*)", low)
            kind = "number" if number or spelt else "unit" if low in UNITS else ""
            pure = bool(kind == "number")
            if not kind and glued and glued[2] in UNITS:
                kind = "number"
            if not kind and re.match("[A-ZÀ-ÖØ-Þ]", bare):
                kind = "name"
            joins = before is not None and not before["right"] and not left and (
                kind == before["kind"] == "name"
                or before["pure"] and (kind == "unit" or pure and (spelt or before["spelt"]))
            )
            if joins:
                tokens[-1][1].append(low)
            else:
                tokens.append((kind, [low], len(out)))
            before = {"kind": kind, "pure": pure, "spelt": spelt, "right": right}
            out.append(low)
    return out, tokens, lines


def benchmark_items(texts: dict, items: dict, width: int = 5, least: float = 0.5, run: int = 6) -> dict:
    """(document, item): coverage of those found."""
    smallest: dict = {}
    for k in sorted(items):
        smallest.setdefault(items[k], k)
    out = {}
    docs = {k: _typed(t) for k, t in texts.items()}
    for text, item in smallest.items():
        w, tokens, _ = _typed(text)
        if not w:
            continue
        of = [i for i, t in enumerate(tokens) for _ in t[1]]
        last = max(len(tokens) - width, 0)
        shape = lambda ts: tuple(t[0] or " ".join(t[1]) for t in ts)
        for k, (d, marks, lines) in docs.items():
            if len(w) < width:
                if any(d[a:b] == w for a, b in lines):
                    out[k, item] = 1.0
                continue
            size = {min(of[i], last) for i in range(len(w) - width + 1)} | {
                i for i in range(len(tokens) - width + 1) if any(t[0] for t in tokens[i : i + width])
            }
            same = [(i, j) for i in range(len(w) - width + 1) for j in range(len(d) - width + 1) if w[i : i + width] == d[j : j + width]]
            held = {min(of[i], last) for i, _ in same}
            aligned = defaultdict(lambda: defaultdict(list))
            for i in range(len(tokens) - width + 1):
                if not any(t[0] for t in tokens[i : i + width]):
                    continue
                for j in range(len(marks) - width + 1):
                    if shape(tokens[i : i + width]) == shape(marks[j : j + width]):
                        pairs = [(tuple(a[1]), tuple(b[1])) for a, b in zip(tokens[i : i + width], marks[j : j + width]) if a[0]]
                        aligned[j - i][i] = pairs
            for windows in aligned.values():
                votes = defaultdict(Counter)
                for pairs in windows.values():
                    for a, b in pairs:
                        votes[a][b] += 1
                clear = {i for i, pairs in windows.items() if all(votes[a][b] == max(votes[a].values()) for a, b in pairs)}
                doubt = {i for i, pairs in windows.items() if any(list(votes[a].values()).count(max(votes[a].values())) > 1 for a, _ in pairs)}
                held |= clear - doubt
            longest, at = 0, set(same)
            for i, j in at:
                if (i - 1, j - 1) not in at:
                    n = 0
                    while (i + n, j + n) in at:
                        n += 1
                    longest = max(longest, n)
            if held and (len(held) / len(size) >= least or longest >= run):
                out[k, item] = len(held) / len(size)
    return out
