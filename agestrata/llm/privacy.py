"""Personal data: base patterns, and further spans by candidate gradient boosting.

High-recall generators propose overlapping spans; boosted trees score each from its format and its context; thresholds,
calibrated on held-out examples, select those to redact. The trees are trained here on examples made by a seeded
generator, as the corpus has no labels of this kind.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agestrata.llm.shared import by_place, only, table

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method finds; in order they follow the others.
ADDED = ("iban", "ssn", "secret")
ORDER = {k: i for i, k in enumerate(KINDS + ADDED)}
_EMAIL_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A leftmost match starts a run of digits; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    own, doubled = digits[-1::-2], digits[-2::-2]
    return (sum(map(int, own)) + sum(sum(divmod(2 * int(d), 10)) for d in doubled)) % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches of each kind that pass its test, by start, then kind."""
    out: list[Span] = []
    at, free = text.find("@"), 0
    while at >= 0:  # a local part reaches from the at sign as far back as its characters go
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _EMAIL_HOST.match(text, at)):
            out.append(("email", start, m.end()))
            free = m.end()
            at = text.find("@", free)
        else:
            at = text.find("@", at + 1)
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", *m.span()))
    return sorted(out, key=lambda s: (s[1], ORDER[s[0]]))


# Generators: each proposes spans of one kind, many of them wrong.
_GROUP = re.compile(r"[0-9]+")
_BETWEEN = frozenset(" ().-/")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?")
#: A key or a token of access: a long run of letters and digits; candidates hold some of both or begin as keys do.
_SECRET = re.compile(r"eyJ[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]{4,}){1,2}|[A-Za-z0-9_/+-]{16,}={0,2}")
#: What is said to be a password, of any length: a run without white space, if not a plain word.
_TOLD = re.compile(r"(?i)\b(?:pass(?:word|wort|wd)|pwd|kennwort|mot de passe|contraseña)\b ?(?:[:=]|(?:is|ist|est|es)\b) ?[\"'`]?([^\s\"'`]+)")
_WORD = re.compile(r"[^\W\d_]+")
_MARKS = (" at ", "[at]", "(at)", " AT ", "[AT]", "(AT)")
_SPELT = re.compile(r"(?:\[at\]|\(at\)| at )\s?[\w-]{1,63}(?:(?:\.|\s?(?:\[dot\]|\(dot\)| dot )\s?)[\w-]{2,63}){1,3}", re.I)
_SPELT_LOCAL = re.compile(r"[\w.+-]{1,64}\s?\Z")
_CUES = {
    "phone": re.compile(r"(?i)\b(?:phone|tel|telephone|mobile?|cell|call|fax|telefon|tél|téléphone|teléfono|móvil|handy)\b"),
    "iban": re.compile(r"(?i)\b(?:iban|account|konto|compte|cuenta|bank)\b"),
    "ssn": re.compile(r"(?i)\b(?:ssn|social security|social)\b"),
    "email": re.compile(r"(?i)\b(?:e-?mail|mail|contact|write|kontakt|correo|courriel)\b"),
    "secret": re.compile(r"(?i)(?:token|secret|pass(?:word|wort|wd)|pwd|kennwort|mot de passe|contraseña|api[ _-]?key|access[ _-]?key|bearer|credential|auth(?:orization)?)\b"),
}
#: National numbers: a zero and pairs; nine digits that begin as those of phones do.
_PAIRS, _THREES = re.compile(r"0[1-9](?:[ .-]?[0-9]{2}){4}"), re.compile(r"[6-9][0-9]{2}[ .-]?[0-9]{3}[ .-]?[0-9]{3}")
_SAID = re.compile(r"(?i)(?:pass(?:word|wort|wd)|pwd|kennwort|mot de passe|contraseña) ?(?:[:=]|is|ist|est|es) ?[\"'`]?\Z")
_HEX = re.compile(r"[0-9a-fA-F]+")
_AGAINST = re.compile(r"(?i)\b(?:order|invoice|version|ref|isbn|page|date|total|price|part|serial|build|room|no|commit|sha\d*|md5|checksum|digest|uuid|file|path)\b")
# How keys of well-known services begin.
_KEY_STARTS = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "xoxb-", "xoxp-", "AIza", "eyJ")


def iban_ok(s: str) -> bool:
    s = s.replace(" ", "")
    return 15 <= len(s) <= 34 and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def _numbers(text: str):
    """Start, end and count of digits of every stretch of whole digit groups with 9 to 12 digits; stretches overlap, so a
    number beside another one is proposed by itself."""
    groups = [m.span() for m in _GROUP.finditer(text)]
    for i, (a, end) in enumerate(groups):
        n = 0
        for start, b in groups[i : i + 12]:
            n += b - start
            if n > 12 or b - a > 26 or not _BETWEEN.issuperset(text[end:start]):
                break
            if n >= 9:
                yield a, b, n
            end = b


def candidates(text: str) -> list[Span]:
    out: list[Span] = []
    for a, b, n in _numbers(text):
        if n < b - a:
            wide = a - 1 if a and text[a - 1] == "(" and ")" in text[a:b] else a
            out.append(("phone", wide, b))
            if n == 9:
                out.append(("ssn", a, b))
        elif n == 9:
            out.append(("ssn", a, b))
            if text[a] in "6789":
                out.append(("phone", a, b))
        elif n == 10 or n == 11:
            out.append(("phone", a, b))
    out += [("iban", *m.span()) for m in _IBAN.finditer(text)]
    for m in _SECRET.finditer(text):
        digits = sum(map(m.group().count, "0123456789"))
        if 2 <= digits < m.end() - m.start() - 1 or m.group().startswith(_KEY_STARTS):
            out.append(("secret", *m.span()))
    known = {c for c in out if c[0] == "secret"}
    for m in _TOLD.finditer(text):
        told = m.group(1).rstrip(".,;:)")
        if told and not _WORD.fullmatch(told) and (span := ("secret", m.start(1), m.start(1) + len(told))) not in known:
            out.append(span)
    for mark in _MARKS:
        at = text.find(mark)
        while at >= 0:
            if (m := _SPELT.match(text, at)) and (local := _SPELT_LOCAL.search(text[max(0, at - 65) : at])):
                out.append(("email", at - len(local.group()), m.end()))
            at = text.find(mark, at + 1)
    return out


def features(text: str, span: Span) -> list[float]:
    """Format of the span, then its context: 24 code points before it, the characters that touch it."""
    kind, a, b = span
    s, near = text[a:b], text[max(0, a - 24) : a]
    before, after = text[a - 1 : a], text[b : b + 1]
    d = _digits(s)
    groups = re.findall(r"[0-9]+", s)
    three = [float(len(g)) for g in (*groups[:3], "", "", "")[:3]]
    return [
        float(ORDER[kind]), float(b - a), float(len(d)), float(len(groups)), *three, float(len(groups[-1]) if groups else 0),
        float(s.count("-")), float(s.count(" ")), float(s.count(".")), float(s.count("/")), float("(" in s and ")" in s),
        float(bool(re.fullmatch(r"\(?[2-9][0-9]{2}\)?[ .-]?[2-9][0-9]{2}[ .-][0-9]{4}", s))),
        float(bool(re.fullmatch(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}", s))),
        float(kind == "iban" and iban_ok(s)), float(bool(re.search(r"[\[(](?:at|dot)[\])]", s, re.I))), float(bool(re.search(r" (?:dot) ", s, re.I))),
        float(bool(before) and (before.isalnum() or before in "+-./$€#_=\"'@:")), float(bool(after) and (after.isalnum() or after in "-/%_=\"'@")),
        float(bool(_CUES[kind].search(near))), float(bool(_AGAINST.search(near))), float(near.rstrip().endswith(":")),
        len(d) / (b - a), len(set(s)) / (b - a), float(kind == "secret" and s.startswith(_KEY_STARTS)), float(s.count("_") + s.count("+")),
        float(bool(re.search(r"[:=]\s?[\"'`]?\Z", near))), float(s != s.lower() and s != s.upper()), float(_HEX.fullmatch(s) is not None),
        float(d[:1] == "0"), float(bool(_PAIRS.fullmatch(s))), float(bool(_THREES.fullmatch(s))), float(kind == "secret" and bool(_SAID.search(text[max(0, a - 24) : a]))),
    ]


class Trees(NamedTuple):
    """Boosted trees of depth 3: feature and threshold of 7 nodes, values of 8 leaves, and calibration of their sum."""

    feature: np.ndarray
    limit: np.ndarray
    leaf: np.ndarray
    slope: float
    offset: float
    least: dict[str, float]

    def margin(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros((len(x), len(self.leaf)), int)
        tree, row = np.arange(len(self.leaf))[None], np.arange(len(x))[:, None]
        for _ in range(3):
            node = 2 * node + 1 + (x[row, self.feature[tree, node]] > self.limit[tree, node])
        return self.leaf[tree, node - 7].sum(1)

    def chance(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))


def _grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, cuts: list[np.ndarray]) -> tuple[list[int], list[float], list[float]]:
    """One tree on gradients g and curvatures h, nodes by level."""
    feature, limit, leaf, rows = [0] * 7, [0.0] * 7, [0.0] * 8, {0: np.arange(len(x))}
    for node in range(7):
        at, best = rows[node], (1e-6, 0, np.inf)
        total = g[at].sum() ** 2 / (h[at].sum() + 1)
        for f, own in enumerate(cuts):
            for c in own:
                up = x[at, f] > c
                gu, hu, ga, ha = g[at[up]].sum(), h[at[up]].sum(), g[at].sum(), h[at].sum()
                gain = gu**2 / (hu + 1) + (ga - gu) ** 2 / (ha - hu + 1) - total
                if gain > best[0] and min(hu, ha - hu) > 0.5:
                    best = (gain, f, float(c))
        _, feature[node], limit[node] = best
        up = x[at, feature[node]] > limit[node]
        rows[2 * node + 1], rows[2 * node + 2] = at[~up], at[up]
    for k in range(8):
        at = rows[7 + k]
        leaf[k] = 0.5 * -g[at].sum() / (h[at].sum() + 1) if len(at) else 0.0
    return feature, limit, leaf


def examples(n: int, seed: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """Features, labels and kinds of candidates in n generated snippets, about half of them personal data; some of these
    have a year, a count or more numbers of their kind beside them."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(str(int(rng.integers(10))) for _ in range(k))
    word = lambda: "".join(pick("abcdefghilmnoprstuv") for _ in range(int(rng.integers(2, 9))))
    area = lambda: str(int(rng.integers(200, 1000)))

    def iban() -> str:
        body, land = num(18), pick(["DE", "FR", "ES", "AT", "NL"])
        check = 98 - int(body + "".join(str(int(c, 36)) for c in land) + "00") % 97
        s = f"{land}{check:02d}{body}"
        return " ".join(s[i : i + 4] for i in range(0, len(s), 4)) if rng.random() < 0.5 else s

    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    code = lambda k, of=letters: "".join(pick(of) for _ in range(k))
    hexed = lambda k: code(k, "0123456789abcdef")
    secret = lambda: (pick([
        lambda: hexed(pick([32, 40, 64])), lambda: code(pick([20, 24, 32, 40, 48])), lambda: "AKIA" + code(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"),
        lambda: "ghp_" + code(36), lambda: "sk-" + code(40), lambda: code(42, letters + "+/") + pick(["=", "==", ""]), lambda: f"{code(10)}-{code(12)}_{num(3)}",
    ])(), "secret")

    # German, French and Spanish numbers as they are written at home
    national = lambda: pick([
        lambda: f"0{pick(['30', '40', '89', '221', '711', '351', '6221'])}{pick([' ', '/', '-', ' / '])}{num(int(rng.integers(6, 9)))}", lambda: f"01{pick('567')}{num(1)}{pick([' ', '-', '/', ''])}{num(int(rng.integers(7, 9)))}",
        lambda: f"(0{pick(['30', '40', '89', '69'])}) {num(int(rng.integers(6, 9)))}", lambda: f"0{pick(['30', '89', '221', '711'])} {num(3)} {num(2)} {num(2)}",
        lambda: (sep := pick([" ", ".", "-", ""])).join([f"0{pick('1234567')}", *(num(2) for _ in range(4))]),
        lambda: (sep := pick([" ", " ", "-", ""])).join([f"{pick('6789')}{num(2)}", num(3), num(3)]), lambda: f"{pick('69')}{num(1)} {num(3)} {num(2)} {num(2)}", lambda: f"{pick('69')}{num(2)} {num(2)} {num(2)} {num(2)}",
    ])()
    short = lambda: word() + num(int(rng.integers(1, 4))) + pick(["", "!", "#", "?x"])
    good = [
        secret, secret,
        lambda: (f"({area()}) {area()}-{num(4)}", "phone"), lambda: (f"{area()}-{area()}-{num(4)}", "phone"),
        lambda: (f"{area()}.{area()}.{num(4)}", "phone"), lambda: (f"{area()} {area()} {num(4)}", "phone"),
        lambda: (f"{int(rng.integers(1, 9))}{num(2)}-{int(rng.integers(10, 99))}-{int(rng.integers(1000, 9999))}", "ssn"),
        lambda: (national(), "phone"), lambda: (national(), "phone"), lambda: (short(), "told"),
        lambda: (iban(), "iban"), lambda: (f"{word()}.{word()} [at] {word()} [dot] {pick(['com', 'org', 'net'])}", "email"),
        lambda: (f"{word()}(at){word()}.{pick(['com', 'org', 'de'])}", "email"),
    ]
    bad = [
        lambda: num(9), lambda: num(10), lambda: num(11), lambda: num(16), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}/{num(2)}/{num(4)} {num(3)}",
        lambda: f"{num(3)} {num(3)} {num(3)}", lambda: f"{num(1)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{num(5)}.{num(6)}", lambda: f"{num(4)} {num(5)} {num(2)}",
        lambda: f"{num(2)}-{num(7)}-{num(1)}", lambda: f"{pick('ABCDEFG')}{pick('ABCDEFG')}{num(18)}", lambda: f"{word()} at {word()} dot {word()}", lambda: f"{word()} at {word()}.{word()}",
        lambda: f"{num(3)}-{num(3)}-{num(5)}", lambda: f"{hexed(8)}-{hexed(4)}-{hexed(4)}-{hexed(4)}-{hexed(12)}", lambda: hexed(40), lambda: hexed(64),
        lambda: f"{word()}-{word()}-{num(4)}-{num(2)}-{word()}", lambda: f"/{word()}/{word()}{num(2)}/{word()}_{num(3)}", lambda: f"{word()}_{word()}_{num(2)}_{word()}", lambda: word() * 3 + num(3),
    ]
    cues = {"secret": ['token = "', "token: ", "api_key=", 'api key: "', "password: ", 'secret = "', "Authorization: Bearer ", "access_key = '", "credential "], "phone": ["phone", "tel:", "call", "mobile"], "national": ["Tel.", "tel", "Telefon:", "Handy", "Fax", "tél", "Tél. :", "téléphone", "teléfono", "móvil:", "Mobil:", "call", "phone"], "told": ["password: ", "Passwort: ", "passwd=", "mot de passe : ", "contraseña: ", "pwd: ", "password is ", "Kennwort ist "], "ssn": ["SSN", "social security", "ssn:"], "iban": ["IBAN", "account", "iban:"], "email": ["mail", "contact", "email:"]}
    rows, labels, kinds = [], [], []
    for k in range(n):
        lead = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        tail = " ".join(word() for _ in range(int(rng.integers(0, 6))))
        if k % 2:
            s, kind = pick(good)()
            home = kind == "phone" and not re.match(r"\(?[2-9][0-9]{2}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}", s)
            cue = pick(cues["national" if home else kind]) + " " * (kind not in ("secret", "told")) if rng.random() < (1.0 if kind == "told" else 0.9 if home or kind in ("ssn", "email", "secret") else 0.5) else ""
            kind = "secret" if kind == "told" else kind
            if kind == "secret" and not cue and not s.startswith(_KEY_STARTS):
                cue = "token "
        else:
            s, kind = pick(bad)(), ""
            cue = pick(["order", "ref", "version", "total", "part", "serial", "commit", "sha256:", "file", "", "", ""]) + " "
        text, right = f"{lead} {cue}", set()
        if beside := kind in ("phone", "ssn") and rng.random() < 0.4:
            text += pick(["", "", f"{int(rng.integers(1900, 2100))} ", f"{int(rng.integers(1, 1000))} "])
        right.add((kind, len(text), len(text) + len(s)))
        text += s + cue[-1:] * (cue[-1:] in ("'", '"'))
        for _ in range(int(rng.integers(0, 3)) if beside else 0):
            s, other = pick(good[2:7])()
            text += pick([" ", " ", " / ", "  "])
            if other == kind:
                right.add((kind, len(text), len(text) + len(s)))
                text += s
            else:
                text += str(int(rng.integers(1, 3000)))
        text += f" {tail}"
        for c in candidates(text):
            rows.append(features(text, c))
            labels.append(float(c in right))
            kinds.append(c[0])
    return np.array(rows), np.array(labels), kinds


def train(n: int = 3000, rounds: int = 50, precision: float = 0.99) -> Trees:
    """Trees from n snippets; a further n calibrate them: a logistic curve over the margin, then for each kind the least
    chance at which that share of the selected spans is right."""
    x, y, _ = examples(n, 1)
    cuts = [(q[1:] + q[:-1]) / 2 for q in (np.unique(np.quantile(x[:, f], np.linspace(0, 1, 9))) for f in range(x.shape[1]))]
    margin, grown = np.zeros(len(y)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grown.append(_grow(x, p - y, p * (1 - p), cuts))
        margin = Trees(*(np.array(c) for c in zip(*grown, strict=True)), 1.0, 0.0, {}).margin(x)
    trees = Trees(*(np.array(c) for c in zip(*grown, strict=True)), 1.0, 0.0, {})
    x, y, kinds = examples(n, 2)
    m, a, b = trees.margin(x), 1.0, 0.0
    for _ in range(500):
        p = 1 / (1 + np.exp(-(a * m + b)))
        a, b = a - 0.05 * ((p - y) * m).mean(), b - 0.05 * (p - y).mean()
    trees = trees._replace(slope=float(a), offset=float(b))
    p, least = trees.chance(x), {}
    for kind in dict.fromkeys(kinds):
        own = np.array([k == kind for k in kinds])
        order = np.argsort(-p[own], kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        good = np.flatnonzero(right >= precision)
        least[kind] = max(0.5, float(p[own][order][good[-1]])) if len(good) else 2.0
    return trees._replace(least=least)


def further_spans(text: str, base: list[Span], trees: Trees) -> list[Span]:
    """Candidates that the trees select, best first, none overlapping a better one, nor a base span unless it holds all of it."""
    if not (found := candidates(text)):
        return []
    chance = trees.chance(np.array([features(text, c) for c in found]))
    taken: list[tuple[int, int, bool]] = []  # begin, end, whether of base spans; apart from each other and in order
    for _, a, b in sorted(base, key=lambda s: s[1]):
        if taken and a < taken[-1][1]:
            taken[-1] = (taken[-1][0], max(taken[-1][1], b), True)
        else:
            taken.append((a, b, True))
    out = []
    for k in sorted(range(len(found)), key=lambda k: (-chance[k], found[k])):
        kind, a, b = found[k]
        if chance[k] < trees.least.get(kind, 2.0):
            continue
        first = last = bisect_right(taken, (a, a))
        if first and taken[first - 1][1] > a:
            continue
        while last < len(taken) and taken[last][0] < b:
            last += 1
        if all(own and end <= b for _, end, own in taken[first:last]):
            taken[first:last] = [(a, b, False)]
            out.append(found[k])
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of spans (overlapping ones together) replaced by the kind of its first, in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], ORDER[s[0]])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def find(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """For every row of docs: doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans (base and further
    ones, as kind:start:end), n_spans (how many those are).

    Null and empty texts have no spans; equal rows get equal rows; an empty table gives none; other columns are ignored.
    """
    trees = trees or train()

    def run(batches):
        import pyarrow as pa

        for b in batches:
            base, every = [], []
            for x in b.column(1):
                text = x.as_py() or ""
                base.append(base_spans(text))
                every.append(joined(base[-1] + further_spans(text, base[-1], trees)))
            counts = [pa.array([sum(s[0] == k for s in own) for own in base], pa.int64()) for k in KINDS]
            sums = [hashlib.sha256(joined(own).encode()).hexdigest() for own in base]
            many = pa.array([s.count(",") + 1 if s else 0 for s in every], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(sums, pa.string()), pa.array(every, pa.string()), many], names=("doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans", "n_spans"))

    cut = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text")
    return cut.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long")


def cleaned(docs: DataFrame, trees: Trees | None = None) -> DataFrame:
    """docs with all spans redacted in text, and n_chars (if there is one) counted anew where that changed it. Null texts
    stay null, empty ones empty; very long texts are read whole; equal rows stay equal; an empty table stays empty; other
    columns, also those whose names clash, stay as they are."""
    trees = trees or train()
    text, n = docs.columns.index("text"), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        import pyarrow as pa

        for b in batches:
            old = b.column(text).to_pylist()
            new = []
            for t in old:
                base = base_spans(t or "")
                spans = base + further_spans(t or "", base, trees)
                new.append(redacted(t, spans) if spans else t)
            cols = list(b.columns)
            cols[text] = pa.array(new, b.schema.field(text).type)
            if n is not None:
                counts = [len(y) if x != y else c for x, y, c in zip(old, new, cols[n].to_pylist(), strict=True)]
                cols[n] = pa.array(counts, b.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(cols, names=b.schema.names)

    return by_place(docs, run)


def op7_boosted_candidates(spark, sf_dir):
    return find(table(spark, sf_dir, "documents"))
