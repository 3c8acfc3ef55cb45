"""Plain Python forms of the operators, to hold their results against."""

import re
from collections import Counter, defaultdict

import numpy as np

from fernglass.llm import language_id, line_dedup


def lower(text):
    """A-Z in lower case; a null text is empty."""
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def components(nodes, edges):
    of = {n: n for n in nodes}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        of[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def line_names(line):
    tokens = ("".join(c.lower() if "A" <= c <= "Z" else c for c in line)).split()
    free = [any("0" <= c <= "9" for c in w) for w in tokens]
    if not all(free):
        tokens = ["\0" if f else w for w, f in zip(tokens, free)]
    else:
        free = [False] * len(tokens)
    names = [("all", len(tokens), *tokens)] if tokens else []
    if len(tokens) >= line_dedup.FIELDS:
        m = len(tokens) - line_dedup.LEADING
        for q in range(4):
            lo, hi = line_dedup.LEADING + m * q // 4, line_dedup.LEADING + m * (q + 1) // 4
            if hi > lo and 2 * sum(not f for f in free[:lo] + free[hi:]) >= len(tokens):
                names.append((q, len(tokens), *tokens[:lo], None, *tokens[hi:]))
    return names


def line_dedup_of(rows):
    """(text, lines, recurring, dropped) of (doc_id, text) rows."""
    first, last = {}, {}
    for i, t in rows:
        for line in (t or "").split("\n") if i is not None else ():
            for k in line_names(line):
                first[k], last[k] = min(i, first.get(k, i)), max(i, last.get(k, i))
    out = []
    for i, t in rows:
        lines = t.split("\n") if t else []
        if lines and t.endswith("\n"):
            lines.pop()
        keys = [[k for k in line_names(x) if i is not None and first[k] != last[k]] for x in lines]
        gone = [any(first[k] != i for k in ks) for ks in keys]
        text = t
        if any(gone):
            parts = [x + "\n" for x in lines]
            if not t.endswith("\n"):
                parts[-1] = parts[-1][:-1]
            text = "".join(x for x, g in zip(parts, gone) if not g)
            text = text[:-1] if gone[-1] and text.endswith("\n") else text
        out.append((text, len(lines), sum(map(bool, keys)), sum(gone)))
    return out


def shingles(text):
    w = lower(text).replace("\x1c", "?").replace("\x85", "?").split() if text else []
    return frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset([tuple(w)] if w else [])


def jaccard_groups_of(sets):
    """{id: (links, component)} of {id: set}."""
    edges = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 60 * len(sets[a] | sets[b])]
    comp, n = components(list(sets), edges), Counter(x for e in edges for x in e)
    return {i: (n[i], comp[i]) for i in sets}


def contamination_of(texts, items):
    """(words, hit words, items) of texts, given (item, text) rows."""
    split = lambda t: re.findall("[^\x00-/:-`{-\x7f]+", lower(t))
    windows = defaultdict(set)
    for name, t in items:
        w = split(t)
        k = min(13, len(w))
        for j in range(len(w) - k + 1 if k and name is not None else 0):
            windows[tuple(w[j : j + k])].add(name)
    out = []
    for t in texts:
        w, hit, found = split(t), set(), set()
        for win, names in windows.items():
            for j in range(len(w) - len(win) + 1):
                if tuple(w[j : j + len(win)]) == win:
                    hit |= set(range(j, j + len(win)))
                    found |= names
        out.append((len(w), len(hit), sorted(found)))
    return out


def language_model(rows, words, grams, max_n=5):
    """{language: [{gram: log frequency} for words and n = 1, 2, ...]} of (text, lang) rows, with each table's floor."""
    found = {}
    for lang in sorted({g for t, g in rows if g is not None and t is not None}):
        tables = [Counter() for _ in range(max_n + 1)]
        for text, g in rows:
            for w in language_id.words_of(text or "") if g == lang else ():
                tables[0][w] += 1
                for n in range(1, max_n + 1):
                    tables[n].update(f" {w} "[i : i + n] for i in range(len(w) + 3 - n))
        found[lang] = tables
    size = {0: max(1, words // len(found))} | {n: max(1, grams // len(found)) for n in range(1, max_n + 1)}
    floor = [min(-np.log(t[n].total()) - 2 for t in found.values() if t[n]) for n in range(max_n + 1)]
    kept = {g: [{w: np.log(c / t.total()) for w, c in sorted(t.items(), key=lambda x: (-x[1], x[0]))[: size[n]] if c > 1} for n, t in enumerate(tables)] for g, tables in found.items()}
    return kept, floor


def language_of(model, floor, text):
    langs = list(model)

    def likelihood(w):
        if any(w in model[g][0] for g in langs):
            return [model[g][0].get(w, floor[0]) for g in langs]
        for n in range(5, 0, -1):
            grams = [x for i in range(len(w) + 3 - n) if (x := f" {w} "[i : i + n]) and any(x in model[g][n] for g in langs)]
            if grams:
                return [sum(model[g][n].get(x, floor[n]) for x in grams) / len(grams) for g in langs]
        return [0.0] * len(langs)

    found = [likelihood(w) for w in language_id.words_of(text or "")]
    if not found or not any(map(str.isalpha, text)):
        return "und", 0.0
    total = [sum(x[k] for x in found) for k in range(len(langs))]
    best = total.index(max(total))
    shares = [np.exp(x[best]) / sum(np.exp(y) for y in x) for x in found]
    return langs[best], sum(shares) / len(shares)
