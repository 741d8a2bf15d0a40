"""Plain versions of the operators, a document (or a pair) at a time."""

import math
import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def code_words(text):
    return WORD.findall(text or "")


def simhash(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    ws = code_words(low)
    if not ws:
        return 0
    grams = [" ".join(ws[i : i + 3]) for i in range(len(ws) - 2)] or [" ".join(ws)]
    hs = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def shingles(text, n=5):
    ws = code_words(re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} or {tuple(ws)} - {()}


def simhash_groups(texts, similar=False):
    """texts: (id, text). For each the fingerprint and the least id of its component, by comparing all pairs; similar:
    texts whose sets of five-word shingles are 0.8 alike are linked too."""
    fps, sets = [simhash(t) for _, t in texts], [shingles(t) for _, t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 or similar and len(sets[i] | sets[j]) and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                root[top(i)] = top(j)
    ids = {}
    for i, (d, _) in enumerate(texts):
        if d is not None:
            ids[top(i)] = min(d, ids.get(top(i), d))
    return [(d, f"{f:016x}", ids.get(top(i))) for i, ((d, _), f) in enumerate(zip(texts, fps, strict=True))]


def repeats(raws, span):
    """For each text the maximal stretches covered by strings of span bytes that start twice or more anywhere."""
    seen = {}
    for k, raw in enumerate(raws):
        for i in range(len(raw) - span + 1):
            seen.setdefault(raw[i : i + span], []).append((k, i))
    cover = [bytearray(len(r)) for r in raws]
    for places in seen.values():
        if len(places) > 1:
            for k, i in places:
                cover[k][i : i + span] = b"\1" * span
    return [[m.span() for m in re.finditer(b"\1+", bytes(c))] for c in cover]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def personal(text):
    """The contract's spans, by its patterns as they stand."""

    def luhn(d):
        total = 0
        for k, c in enumerate(reversed(d)):
            x = int(c) * (1 + k % 2)
            total += x - 9 * (x > 9)
        return total % 10 == 0

    found = []
    for rank, (kind, p) in enumerate((("email", EMAIL), ("ip", IP), ("card", CARD), ("phone", PHONE))):
        for m in p.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {
                "email": lambda: True, "ip": lambda m=m: all(int(x) <= 255 for x in m.group().split(".")),
                "card": lambda d=digits: 14 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 10 <= len(d) <= 15,
            }[kind]
            if ok():
                found.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(found))


def measures(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    ws, lines, hit = code_words(text), [x for x in (text or "").split("\n") if WORD.search(x)], set()
    at = {}
    for i in range(len(ws) - 2):
        at.setdefault(tuple(ws[i : i + 3]), []).append(i)
    for places in at.values():
        if len(places) > 1:
            hit.update(i + k for i in places for k in range(3))
    n = len(ws)
    return n, sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def targets(sizes, weights=(3.0, 1.0, 2.0), share=1.5, most=2):
    """sizes: source -> words. The level is filled source by source until none is above its bound."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    out, left = {}, share * sum(sizes.values())
    free = set(names)
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > most * sizes[s]}
        if not over:
            return out | {s: level * w[s] for s in free}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        free -= over
    return out


def pareto(docs, target, u, most=2, divided=True):
    """docs: (id, words) of one source; u: a random number of each. Copies and inclusion probability by id."""
    weight = lambda n: 4 + (n.bit_length() if n else 0)
    low, high = 0.0, 10.0
    for _ in range(200):  # the level at which the expected words are the target
        mid = (low + high) / 2
        low, high = (mid, high) if sum(n * min(most, mid * weight(n)) for _, n in docs) < target else (low, mid)
    expected = {d: min(most, high * weight(n)) for d, n in docs}
    expected = {d: float(most) if x > most - 1e-9 else x for d, x in expected.items()}
    copies = {d: int(x) for d, x in expected.items()}
    p = {d: x - int(x) for d, x in expected.items()}
    left = target - sum(copies[d] * n for d, n in docs)
    rank = {d: u[d, n] / (1 - u[d, n]) / (p[d] / (1 - p[d]) if divided else 1) for d, n in docs if p[d] > 0}
    order, taken = sorted((rank[d], d, n) for d, n in docs if d in rank), set()
    for _, d, n in order:
        if n > left:
            break
        left -= n
        taken.add(d)
    spare = [(abs(left - n), r, d) for r, d, n in order if d not in taken and n and abs(left - n) < left]
    taken |= {min(spare)[2]} if spare else set()
    return {d: c + (d in taken) for d, c in copies.items()}, p


def ring_walk(keys, nodes, room):
    """keys: (key, cell) in order; nodes: (cell, shard) clockwise. For each key its shard and slot: the first virtual node
    from its cell on whose shard has room."""
    taken, out = [0] * len(room), {}
    for key, cell in keys:
        i = next((k for k, (c, _) in enumerate(nodes) if c >= cell), 0)
        while taken[nodes[i][1]] == room[nodes[i][1]]:
            i = (i + 1) % len(nodes)
        out[key] = (nodes[i][1], taken[nodes[i][1]])
        taken[nodes[i][1]] += 1
    return out


FULL = (1 << 64) - 1


def _stir(x):
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> shift) * factor & FULL
    return x ^ x >> 31


def _tossed(own, left):
    """Twice the lowest place where own and left differ, and own's bit there."""
    place = next((b for b in range(64) if (own ^ left) >> b & 1), 0)
    return 2 * place + (own >> place & 1)


def phrase_names(symbols, factors):
    """The names of the next level, symbol by symbol. factors: the odd numbers that names are made with."""
    merged, runs = [], []
    for x in symbols:  # a run of one symbol is a symbol of its own
        if runs and runs[-1][0] == x:
            runs[-1][1] += 1
        else:
            runs.append([x, 1])
    for x, many in runs:
        merged.append(x if many == 1 else _stir((x * factors[62] + many * factors[63]) & FULL))
    labels = merged
    for _ in range(4):  # 32 or 64 bits, then 7, 4 and 3: labels from 0 to 5 are left
        labels = [_tossed(x, labels[i - 1] if i else x ^ 1) for i, x in enumerate(labels)]
    assert all(x < 6 for x in labels)
    phrases = []
    for i, x in enumerate(merged):
        if not phrases or 0 < i < len(merged) - 1 and labels[i - 1] < labels[i] > labels[i + 1]:
            phrases.append([])
        phrases[-1].append(x)
    return [_stir((sum(x * factors[j % 32] for j, x in enumerate(of)) + len(of) * factors[33]) & FULL) for of in phrases]


def phrase_sketch(text, factors, levels=2, bins=128):
    """The byte of each bin that has a name, by bin."""
    names = [ord(c) for c in text or ""]
    for _ in range(levels):
        names = phrase_names(names, factors)
    least = {}
    for name in names:
        h = _stir((name + 0x9E3779B97F4A7C15) & FULL)
        least[h % bins] = min(h // bins, least.get(h % bins, FULL))
    return {b: _stir(v) >> 56 for b, v in least.items()}


def phrase_text(sketch, bins=128):
    """Bytes of all bins, then which are set, the first bin as the highest bit."""
    held = sum(1 << (bins - 1 - b) for b in sketch)
    return bytes(sketch.get(b, 0) for b in range(bins)).hex() + f"{held:0{bins // 4}x}"


def phrase_likeness(a, b):
    either = len(a.keys() | b.keys())
    raw = sum(a[k] == b[k] for k in a.keys() & b.keys()) / either if either else 1.0
    return min(1.0, max(0.0, (raw - 1 / 256) / (1 - 1 / 256)))


def language_of_windows(text, model, widths, filters, window):
    """Probability of each language: a window at a time, a filter at a time, each at every place."""
    raw = text.lower().encode("utf-8", "replace")
    total, weight = 0.0, 0
    for lo in range(0, max(1, len(raw)), window):
        part = raw[lo : lo + window]
        seen = [model.embed[b].astype(float) for b in part.ljust(window + max(widths) - 1, bytes(1))]
        hidden = []
        for f in range(len(widths) * filters):
            wide = widths[f // filters]
            taps = model.conv[:, f].reshape(max(widths), -1).astype(float)
            assert not taps[wide:].any()
            best = max(sum(float(seen[i + j] @ taps[j]) for j in range(wide)) for i in range(window))
            hidden.append(max(0.0, best + float(model.bias[f])))
        scores = [sum(h * float(w) for h, w in zip(hidden, model.dense[:, k], strict=True)) + float(model.out[k]) for k in range(len(model.langs))]
        odds = [math.exp(x - max(scores)) for x in scores]
        size = max(1, len(part))
        total = [t + size * o / sum(odds) for t, o in zip(total or [0.0] * len(odds), odds, strict=True)]
        weight += size
    return [t / weight for t in total]
