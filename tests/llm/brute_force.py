"""Brute-force versions."""

import math
import re
from collections import Counter

from flowloom.llm import langid, toxicity

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def words_of(text):
    return WORD.findall(low(text))


def shingles_of(text):
    w = words_of(text)
    return Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()


def likeness_of(a, b):
    """Probability Jaccard similarity of two weighted sets, by its definition."""
    total = 0.0
    for i in a.keys() & b.keys():
        total += 1 / sum(max(a[j] / a[i], b[j] / b[i]) for j in a.keys() | b.keys())
    return total


def components_of(rows, least=0.8):
    """(id, text) -> least id of each class."""
    sets = [(i, shingles_of(t)) for i, t in rows]
    of = {i: i for i, _ in sets}

    def find(x):
        while of[x] != x:
            x = of[x]
        return x

    for k, (i, s) in enumerate(sets):
        for j, t in sets[:k]:
            if s.keys() & t.keys() and likeness_of(s, t) >= least - 1e-9:
                a, b = find(i), find(j)
                of[max(a, b)] = min(a, b)
    return {i: find(i) for i, _ in sets}


def contamination_of(text, items):
    """(words, hit words, item ids) of a text."""
    w, hit, found = words_of(text), set(), set()
    for i, item in items:
        t = words_of(item)
        n = min(13, len(t))
        windows = {tuple(t[k : k + n]) for k in range(len(t) - n + 1)} if n else set()
        for k in range(len(w) - n + 1 if n else 0):
            if tuple(w[k : k + n]) in windows:
                hit.update(range(k, k + n))
                found.add(i)
    return len(w), len(hit), found


def _vote(machines, x):
    """(winning class, its weakest logistic margin) machine by machine."""
    wins, total, least = {c: 0 for c in machines.classes}, {c: 0.0 for c in machines.classes}, {c: math.inf for c in machines.classes}
    for j, (a, b) in enumerate(machines.pairs):
        m = float(x @ machines.weights[:, j] + machines.biases[j])
        for c, s in ((machines.classes[a], m), (machines.classes[b], -m)):
            wins[c], total[c], least[c] = wins[c] + (s > 0), total[c] + s, min(least[c], s)
    best = max(machines.classes, key=lambda c: (wins[c], total[c]))
    return best, 1 / (1 + math.exp(-3 * max(-20, min(20, least[best])))) if machines.pairs else 1.0


def language_of(model, text):
    """(language, score) of a text."""
    if not any(c.isalpha() for c in text or ""):
        return "und", 0.0
    x = langid.features(text)
    family, p = _vote(model.families, x)
    lang, q = _vote(model.within[family], x)
    return lang, min(p, q)


def toxicity_of(chain, text):
    """The chain's probabilities of a text, term by term."""
    terms, found, fed = toxicity.Terms(), words_of(text), []
    held = {chain.number[t] for w in found for t in terms[w.encode()] if t in chain.number}
    for model in chain.models:
        z = sum(float(model.terms[k]) for k in held) + sum(p * float(w) for p, w in zip(fed, model.dense)) + float(model.dense[-1])
        fed.append(1 / (1 + math.exp(-max(-30, min(30, z)))))
    return fed if found else [min(p, toxicity.THRESHOLD / 2) for p in fed]
