"""Plain versions of the operators, from their definitions, for small tables."""

import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def longest_repeats(ws):
    """Of each position, the longest common prefix with any other suffix."""
    n = len(ws)
    found = [0] * n
    places = {}
    for i, w in enumerate(ws):
        places.setdefault(w, []).append(i)
    for own in places.values():
        for x, i in enumerate(own):
            for j in own[x + 1 :]:
                k = 0
                while j + k < n and ws[i + k] == ws[j + k]:
                    k += 1
                found[i], found[j] = max(found[i], k), max(found[j], k)
    return found


def quality(text, window=5, min_repeat=3):
    text = text or ""
    ws = words(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    seen = Counter(tuple(ws[i : i + window]) for i in range(len(ws) - window + 1))
    repeated = set()
    for i in range(len(ws) - window + 1):
        if seen[tuple(ws[i : i + window])] > 1:
            repeated.update(range(i, i + window))
    longest = longest_repeats(ws)
    covered = {p for i, k in enumerate(longest) if k >= min_repeat for p in range(i, i + k)}
    n = len(ws)
    base = n < 10 or 100 * len(repeated) > 20 * n
    top = max(longest, default=0)
    return {
        "n_words": n,
        "word_chars": sum(map(len, ws)),
        "n_symbols": sum(c in "#*$%&|<>" for c in text),
        "n_dup_lines": len(lines) - len(set(lines)),
        "n_repeat_words": len(repeated),
        "covered_words": len(covered),
        "longest_repeat": top,
        "base_failed": base,
        "kept": not (base or 100 * len(covered) > 30 * n or top > 20),
    }


def shingles(text, width=5):
    ws = words(lower(text))
    return {tuple(ws[i : i + width]) for i in range(max(1, len(ws) - width + 1))} if ws else set()


class Forest:
    def __init__(self):
        self.up = {}

    def top(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.top(a), self.top(b)))
        self.up[b] = a


def components(docs, percent=80):
    """docs: (id, text) pairs with ids; {(id, n_shingles, component)}."""
    sets = {}
    for key, text in docs:
        sets.setdefault(frozenset(shingles(text)), []).append(key)
    forest, by = Forest(), {}
    distinct = list(sets)
    for s in distinct:
        for a, b in zip(sets[s], sets[s][1:]):
            if s:
                forest.join(a, b)
    for k, s in enumerate(distinct):
        shared = Counter(j for t in s for j in by.get(t, ()))
        for j, n in shared.items():
            if 100 * n >= percent * (len(s) + len(distinct[j]) - n):
                forest.join(sets[s][0], sets[distinct[j]][0])
        for t in s:
            by.setdefault(t, []).append(k)
    return sorted((key, len(s), forest.top(key)) for s, keys in sets.items() for key in keys)


def clean_lines(docs, min_sites=10):
    """docs: dicts with text and source; gives the cleaned texts."""
    sites, copies = {}, {}
    for d in docs:
        if d["text"] is not None and d["source"] is not None:
            copies.setdefault(d["text"], set()).add(d["source"])
            for x in d["text"].split("\n"):
                if WORD.search(x):
                    sites.setdefault(x, set()).add(d["source"])
    gone = {x for x, s in sites.items() if len(s) >= min_sites}
    kept = lambda t: "\n" in t and len(copies.get(t, ())) >= min_sites
    return [d["text"] if d["text"] is None or kept(d["text"]) else "\n".join(x for x in d["text"].split("\n") if x not in gone) for d in docs]


def shares(budget, children):
    """children: {name: (cap, weight)}; water filling in whole numbers."""
    left, out, open_ = budget, {}, dict(children)
    while True:
        total = sum(w for _, w in open_.values())
        full = [n for n, (cap, w) in open_.items() if cap * total <= left * w]
        if not full:
            break
        first = min(full, key=lambda n: (open_[n][0] / open_[n][1], n))
        out[first] = open_.pop(first)[0]
        left -= out[first]
    total = sum(w for _, w in open_.values())
    return out | {n: left * w // total for n, (_, w) in open_.items()}


def mixed(docs, levels, weights, percent=80, epochs=1, seed=7):
    """docs: dicts with doc_id, text and the levels; {(doc_id, epoch)}."""
    import hashlib

    leaf = {}
    for d in docs:
        leaf.setdefault(tuple(d[c] or "" for c in levels), []).append(d)
    supply = {k: sum(len(words(d["text"])) for d in v) for k, v in leaf.items()}
    room = {}
    for k, n in supply.items():
        for i in range(len(k) + 1):
            room[k[:i]] = room.get(k[:i], 0) + n * epochs
    budget = {(): min(sum(supply.values()) * percent // 100, room.get((), 0))}
    for i in range(len(levels)):
        for parent in [p for p in list(budget) if len(p) == i]:
            kids = {p: (room[p], weights[i].get(p[-1], 1)) for p in room if len(p) == i + 1 and p[:i] == parent}
            budget |= shares(budget[parent], kids)
    out = set()
    for k, own in leaf.items():
        whole = budget[k] // supply[k] if supply[k] else 0
        rest, upto = budget[k] - whole * supply[k], 0
        tokens = Counter()
        for d in own:  # rows of one key stand at one place
            tokens[d["doc_id"]] += len(words(d["text"]))
        for key in sorted(tokens, key=lambda k: hashlib.md5(f"{seed}-{whole}-{k}".encode()).hexdigest()):
            upto += tokens[key]
            out |= {(key, e) for e in range(whole + (0 < rest and upto <= rest))}
    return out


def attended(model, x, runs):
    """Scores and attention weights of gated attention, one document and one passage after another."""
    import math

    p, scores, weights, at = model.p, [], [], 0
    for n in runs:
        hs, es = [], []
        for row in x[at : at + n]:
            row = [max(-8.0, min(8.0, (v - m) / s)) for v, m, s in zip(row, model.mean, model.scale, strict=True)]
            h = [math.tanh(sum(v * w for v, w in zip(row, col, strict=True)) + b) for col, b in zip(p["W"].T, p["b"], strict=True)]
            e = 0.0
            for v, g, u in zip(p["V"].T, p["G"].T, p["u"], strict=True):
                e += u * math.tanh(sum(a * b for a, b in zip(h, v, strict=True))) / (1 + math.exp(-sum(a * b for a, b in zip(h, g, strict=True))))
            hs.append(h)
            es.append(e)
        total = sum(map(math.exp, es))
        own = [math.exp(e) / total for e in es]
        z = [sum(a * h[k] for a, h in zip(own, hs, strict=True)) for k in range(len(hs[0]))]
        scores.append(1 / (1 + math.exp(-(sum(a * c for a, c in zip(z, p["c"], strict=True)) + p["d"][0]))))
        weights += own
        at += n
    return scores, weights


class Licenses:
    """TF-IDF cosine of every line, paragraph and text to every template, straight from the definition: term weights
    ln((1 + lines) / (1 + lines with the term)) + 1 for the templates' terms (those of no template as if on no line), times 1 + ln(count)."""

    TERM = re.compile(r"[a-z]+[0-9]*|[0-9]+(?:\.[0-9]+)*")

    def __init__(self, texts, templates):
        import math

        lines = [x for t in texts for x in (t or "").split("\n") if x.strip()]
        self.templates = [(n, x) for n, own in templates.items() for x in own]
        vocabulary = {t for _, x in self.templates for t in self.TERM.findall(x.lower())}
        on = Counter(t for x in lines for t in set(self.TERM.findall(x.lower())))
        self.weight = lambda t: math.log((1 + len(lines)) / (1 + (on[t] if t in vocabulary else 0))) + 1
        self.log = math.log
        self.vectors = [self.vector(x) for _, x in self.templates]

    def vector(self, text):
        return {t: self.weight(t) * (1 + self.log(n)) for t, n in Counter(self.TERM.findall(text.lower())).items()}

    def cosines(self, text):
        a = self.vector(text)
        size = lambda v: sum(x * x for x in v.values()) ** 0.5
        return [sum(x * b.get(t, 0) for t, x in a.items()) / (size(a) * size(b)) if a else 0.0 for b in self.vectors]

    def best(self, text, full, generic, at_least=0.7, margin=0.02):
        """(name, cosine, terms of the unit): whole licences first, then notices, the generic one last; then the greatest cosine, but among templates
        within the margin the cosine by the terms that they have not equally often."""
        parts = [x for x in text.split("\n") if x.strip()]
        parts += [x for x in re.split(r"\n[ \t\r]*\n", text) if "\n" in x.strip()] + [text]
        top = (0, 0.0, None, 0)
        for part in parts:
            cosines = [round(c, 9) for c in self.cosines(part)]
            tiers = [0 if c < at_least else 3 if x == full.get(name) else 1 if name == generic else 2 for (name, x), c in zip(self.templates, cosines, strict=True)]
            tier = max(tiers)
            here = [k for k, t in enumerate(tiers) if t == tier]
            at = max(here, key=lambda k: (cosines[k], -k))
            near = [k for k in here if cosines[k] >= cosines[at] - margin]
            if tier and len({self.templates[k][0] for k in near}) > 1:
                counts = [Counter(self.TERM.findall(self.templates[k][1].lower())) for k in near]
                differ = {t for t in set().union(*counts) if len({c[t] for c in counts}) > 1}
                own = self.vector(part)
                size = lambda v: sum(v[t] ** 2 for t in differ if t in v) ** 0.5 or 1.0
                unit = lambda v: sum(x * x for x in v.values()) ** 0.5
                like = {k: round(sum(own[t] * self.vectors[k].get(t, 0) / unit(self.vectors[k]) for t in differ if t in own) / (size(self.vectors[k]) / unit(self.vectors[k])), 9) for k in near}
                if max(like.values()) > like[at]:
                    at = max(near, key=lambda k: (like[k], -k))
            if (tier, cosines[at]) > top[:2]:
                top = (tier, cosines[at], self.templates[at][0], len(self.TERM.findall(part.lower())))
        return top[2], top[1], top[3]
