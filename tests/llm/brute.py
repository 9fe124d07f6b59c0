"""Plain versions of the operators, one row or pair at a time, for small tables."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from math import log10

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())


def words(text, fold=False):
    text = text or ""
    return WORD.findall(text.translate(FOLD) if fold else text)


def removed(rows, size=20):
    """(n_words, n_removed, kept text) by row, in order of doc_id (null first), then text."""
    seen, out = set(), []
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for doc, text in order:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            window = tuple(w[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        out.append((doc, len(w), sum(gone), " ".join(x for x, g in zip(w, gone, strict=True) if not g)))
    return out


def shingle_set(text, size=3):
    w = words(text, fold=True)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1)))


def groups(rows, percent=90, size=3):
    """(n_shingles, smallest doc_id reachable) by doc_id."""
    sets = {d: shingle_set(t, size) for d, t in rows if d is not None}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    holders = defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    shared = Counter()
    for docs in holders.values():
        for i, a in enumerate(docs):
            for b in docs[:i]:
                shared[(b, a)] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {d: (len(s), find(d)) for d, s in sets.items()}


def line_templates(line):
    """(template, texts it takes) of a line by the pipeline's rules."""
    bare = words(line)
    w = ["<*>" if re.search("[0-9]", x) else x for x in bare]
    if len(w) < 4:
        return [(("whole", *(bare if set(w) == {"<*>"} else w)), 10)] if w else []
    out = [(("whole", *w), 3)]
    if len(w) >= 12:
        ends = [2 + (len(w) - 2) * i // 4 for i in range(5)]
        out += [((i, len(w), *w[:a], "...", *w[b:]), 3) for i, (a, b) in enumerate(zip(ends, ends[1:], strict=False))]
    elif len(w) > 4 and sum(x != "<*>" for x in w) > 1:
        out += [((i, len(w), *w[:i], "...", *w[i + 1 :]), 10) for i in range(2, len(w))]
    return out


def recurring_lines_left(rows):
    """The texts by doc_id without the lines whose template recurs; the first text, by doc_id, keeps its own."""
    first, holders = {}, defaultdict(set)
    for d, text in sorted(rows):
        first.setdefault(text, d)
    for text in first:
        for line in text.split("\n"):
            for template, _ in line_templates(line):
                holders[template].add(text)
    keeper = {t: min(texts, key=first.get) for t, texts in holders.items()}
    gone = lambda text, line: any(
        len(holders[t]) >= least and keeper[t] != text for t, least in line_templates(line)
    )
    return {d: "\n".join(x for x in text.split("\n") if not gone(text, x)) for d, text in rows}


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    w = words(text)
    times = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = set()
    for i in range(len(w) - 2):
        if times[tuple(w[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def language_model(rows, train, weight):
    """(n_tokens, n_known, N, base_score, score) by row, with exact probabilities."""
    end, start = ("end",), ("start",)
    token_lists = [(train(d), [*words(t, fold=True), end]) for d, t in rows]
    single, double = Counter(), Counter()
    for learn, tokens in token_lists:
        if learn:
            single.update(tokens)
            double.update(zip([start, *tokens], tokens, strict=False))
    n, v = sum(single.values()), len(single)
    out = []
    for _, tokens in token_lists:
        base = total = 0.0
        for before, token in zip([start, *tokens], tokens, strict=False):
            p = (single[token] + 0.1) / (n + 0.1 * (v + 1))
            c = single[end] if before == start else single[before]
            base += log10(p)
            total += log10((double[before, token] + weight * p) / (c + weight))
        out.append((len(tokens), sum(single[t] > 0 for t in tokens), n, base, total))
    return out


def best_alignment(passage, item):
    """Score of the best local alignment: +2 alike, -1 changed, left out or put in."""
    table = [[0] * (len(item) + 1) for _ in range(len(passage) + 1)]
    best = 0
    for i, a in enumerate(passage, 1):
        for j, b in enumerate(item, 1):
            step = table[i - 1][j - 1] + (2 if a == b else -1)
            table[i][j] = max(0, step, table[i - 1][j] - 1, table[i][j - 1] - 1)
            best = max(best, table[i][j])
    return best


def alnum_words(text):
    return words(re.sub("[^0-9A-Za-z\x80-\U0010ffff]", " ", text or ""), fold=True)


def alignments(rows, items, least=0.4):
    """Share of an exact copy's score by (doc_id, item_id), of every item in every text, where it is ``least`` or more."""
    number = defaultdict(lambda: len(number))
    kept = [(i, [number[w] for w in alnum_words(t)]) for i, t in items]
    kept = [(i, w) for i, w in kept if len(w) >= 3]
    longest = max(len(w) for _, w in kept)
    table = np.array([w + [-1] * (longest - len(w)) for _, w in kept])
    columns, full = np.arange(1, longest + 1), np.array([2 * len(w) for _, w in kept])
    out = {}
    for d, text in rows:
        row, top = np.zeros((len(kept), longest + 1), dtype=np.int64), np.zeros(len(kept), dtype=np.int64)
        for word in alnum_words(text):
            step = np.maximum(row[:, :-1] + np.where(table == number.get(word, -2), 2, -1), row[:, 1:] - 1)
            row[:, 1:] = np.maximum.accumulate(np.maximum(step, 0) + columns, axis=1) - columns
            top = np.maximum(top, row.max(axis=1))
        out |= {(d, i): share for (i, _), share in zip(kept, top / full, strict=True) if share >= least}
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return host.translate(FOLD), path


def url_verdict(url, rules):
    host, path = url_parts(url)
    fitting = []
    for rule, verdict in rules:
        rule_host, slash, rest = rule.partition("/")
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith(slash + rest):
            fitting.append((len(rule), rule, verdict))
    return max(fitting)[1:] if fitting else (None, "allow")
