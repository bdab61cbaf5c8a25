"""Plain versions of operators, for several test files."""

import re
import unicodedata

import numpy as np


def statistics(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = {}
    for i in range(len(w) - 7):
        at.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def base_failed(n):
    return n[0] < 20 or 100 * n[4] > 30 * n[0]


# What the outlier test is expected to use, stated here by itself.
DIMENSIONS, COVERED, PRIOR, SMOOTHING = 5, 0.75, 40, 100
MEDIAN, CUTOFF = 4.35146, 40.8630  # of a chi-squared variable with five degrees of freedom: 0.5 and 1 - 1e-7


def more_counts(t):
    """Different and short words, digits, capitals, and characters that are no letter, digit or space."""
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    kind = [unicodedata.category(c) for c in t]
    marks = sum(k[0] != "L" and k != "Nd" and c not in " \t\n\x0b\x0c\r" for k, c in zip(kind, t, strict=True))
    return len(set(w)), sum(len(x) <= 3 for x in w), sum(k == "Nd" for k in kind), sum(k == "Lu" for k in kind), marks


def vectors(counts):
    """counts: (n_words, word_chars, distinct, short, digits, capitals, marks) of each text."""
    a = np.array(counts, float)
    words, chars, distinct, short, digits, capitals, marks = a.T
    letters = chars - digits - marks
    usual = lambda x: max(SMOOTHING * x.sum() / words.sum(), 1e-3)
    rate = lambda x, of: np.log((x + usual(x)) / (of + usual(of)))
    return np.stack([rate(chars, words), np.log(distinct) / np.log(words), rate(marks, words), rate(capitals, letters), rate(short, words)], 1)


def distances(x, center, cov):
    return np.einsum("ij,jk,ik->i", x - center, np.linalg.inv(cov + 1e-12 * np.eye(DIMENSIONS)), x - center)


def determinant_estimate(x):
    """(center, covariance) of the three quarters of the rows with the least determinant, by exact
    concentration steps from two starts."""
    h, found = max(1, int(np.ceil(COVERED * len(x)))), []
    middle = np.median(x, 0)
    z = (x - middle) / np.maximum(1.4826 * np.median(np.abs(x - middle), 0), 1e-9)
    for dist in ((z * z).sum(1), np.abs(z).max(1)):
        last = np.inf
        while True:
            inside = x[dist <= np.sort(dist)[h - 1] + 1e-12]
            center, cov = inside.mean(0), np.cov(inside.T, bias=True).reshape(DIMENSIONS, DIMENSIONS)
            now = np.linalg.slogdet(cov + 1e-12 * np.eye(DIMENSIONS))[1]
            if now > last - 1e-9:
                break
            last, kept, dist = now, (center, cov), distances(x, center, cov)
        found.append((last, kept))
    return min(found, key=lambda f: f[0])[1]


def verdicts(rows):
    """rows: (id, lang, source, counts for ``vectors``) of what passes the base rules. Whether each is
    kept."""
    x = vectors([r[3] for r in rows])
    levels = {}
    for k, (_, lang, source, _) in enumerate(rows):
        for level in (("all",), ("p", lang), ("g", lang, source)):
            levels.setdefault(level, []).append(k)
    above = lambda level: ("p", level[1]) if level[0] == "g" else ("all",)
    model, out = {}, {}
    for level, own in sorted(levels.items(), key=lambda e: len(e[0])):
        share = len(own) / (len(own) + PRIOR)
        center, cov = determinant_estimate(x[own])
        up = (center, np.diag(x.var(0)), 1.0) if level == ("all",) else model[above(level)]
        center, cov = share * center + (1 - share) * up[0], share * cov + (1 - share) * up[1]
        d = distances(x[own], center, cov)
        scale = share * np.median(d) / MEDIAN + (1 - share) * up[2]
        model[level] = (center, cov, scale)
        if level[0] == "g":
            out |= {rows[k][0]: bool(v <= CUTOFF * scale) for k, v in zip(own, d, strict=True)}
    return out
