"""Personal data and secrets: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

Tokens are runs of letters, runs of digits, and single marks.  Tokens of a white-space-free chunk that holds
no digit and no ``@`` can only be outside of personal data; the chain falls apart at them, so that Viterbi
over each maximal run of the other chunks, with the words around it as features, decodes the whole text
exactly.  Runs are decoded in numpy batches of like lengths.  The CRF is trained on the driver from a small
labelled table (``MAX_ROWS`` at most) by gradient ascent on the log likelihood.

Spans of the CRF that overlap a pattern's span, or whose digits cannot be of their kind, are not
added.  Besides the four kinds that patterns know, the CRF finds secrets (keys, passwords, tokens); these are reported
by themselves.  Null and empty texts have no spans; rows without doc_id and repeated rows are answered each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import random
import re
import zlib

from pyspark.sql import DataFrame

from .common import id_of, per_text, sha

KINDS = ("email", "ip", "card", "phone")
#: What the CRF knows: the kinds of the patterns, and secrets.
FOUND = (*KINDS, "secret")
LABELS = ("O", *(f"{p}-{k}" for k in FOUND for p in "BI"))
SLOTS = 1 << 13
MAX_ROWS = 5000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: Runs of digits joined by dots: read once from the left, whatever their length.
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*+")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_KEY = re.compile(r"[0-9@]")
_TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|\S")
_CODE = re.compile(r"[A-Za-z0-9_+/-]+")


def luhn(digits: str) -> bool:
    own = [int(d) for d in reversed(digits)]
    return sum(own[::2] + [d * 2 - 9 * (d > 4) for d in own[1::2]]) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def addresses(text: str) -> list[tuple[int, int]]:
    """Spans of four numbers of at most 255 joined by dots.  Four runs of digits from the left of a chain make a match, fitting or
    not, and the search goes on behind it; a match begins nowhere else, so that a text is read once."""
    out, at = [], text.find(".")
    while at >= 0:
        lo = at
        while lo > 0 and "0" <= text[lo - 1] <= "9":
            lo -= 1
        m = _DOTTED.match(text, lo) if lo < at else None
        if m is None:
            at = text.find(".", at + 1)
            continue
        start, parts = lo, m[0].split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(own := p.lstrip("0")) <= 3 and int(own or 0) <= 255 for p in four):
                out.append((start, end))
            start = end + 1
        at = text.find(".", m.end() + 1 if text[m.end() : m.end() + 1] == "." else m.end())
    return out


def pattern_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the fixed patterns, by kind, then start."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > done and text[lo - 1] in _LOCAL:
            lo -= 1
        if lo < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((0, lo, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    out += [(1, *x) for x in addresses(text)]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((2, *m.span()))
    out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15] if "+" in text else []
    return out


def runs(text: str) -> list[tuple[list[tuple[int, int]], str]]:
    """Token spans of each maximal run of chunks with a digit or ``@``, and the word before it."""
    out, done, tokens, word = [], -1, [], ""
    for m in _KEY.finditer(text):
        at = m.start()
        if at < done:
            continue
        lo = at
        while lo > 0 and not text[lo - 1].isspace():
            lo -= 1
        hi = at + 1
        while hi < len(text) and not text[hi].isspace():
            hi += 1
        if not tokens or text[done:lo].strip():
            if tokens:
                out.append((tokens, word))
            tokens, before = [], text[max(0, lo - 40) : lo].split()
            # A mark alone (``token = "..."``) says little without the word that it follows.
            word = "".join(before[-2:] if before and not any(map(str.isalnum, before[-1])) else before[-1:]).lower()
        tokens += [t.span() for t in _TOKEN.finditer(text, lo, hi)]
        done = hi
    if tokens:
        out.append((tokens, word))
    return out


def shape(token: str) -> str:
    if token[0].isdigit():
        return f"d{min(len(token), 7)}"
    if token[0].isalpha():
        return ("Aa" if token[0].isupper() else "a") if not token.isupper() else "A"
    return token


@functools.lru_cache(maxsize=1 << 16)
def _slot(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "surrogatepass")) % SLOTS


WIDTH = 14


def featurise(text: str, tokens: list[tuple[int, int]], word: str) -> list[list[int]]:
    """Feature slots of each token: shapes around it, what it is glued to, chunk and run shapes."""
    shapes = [shape(text[a:b]) for a, b in tokens]
    glued = [i > 0 and tokens[i - 1][1] == tokens[i][0] for i in range(len(tokens))]
    n, total = len(tokens), sum(b - a for (a, b), s in zip(tokens, shapes) if s[0] == "d")
    chunk, chunks = [0] * n, []
    for i in range(n):
        if not glued[i]:
            chunks.append("")
        chunks[-1] += shapes[i][0] if len(chunks[-1]) < 14 else ""
        chunk[i] = len(chunks) - 1
    context = word.strip(".,:;()") if len(word) < 14 else "long"
    heads, sizes = {}, {}
    for (a, b), c in zip(tokens, chunk):
        heads.setdefault(c, text[a:b][:4].lower() if shape(text[a:b])[0] in "aA" else "")
        sizes[c] = sizes.get(c, 0) + b - a
    out = []
    for i, s in enumerate(shapes):
        p, q = shapes[i - 1] if i else "^", shapes[i + 1] if i + 1 < n else "$"
        g, h = int(glued[i]), int(i + 1 < n and glued[i + 1])
        pp, qq = shapes[i - 2] if i > 1 else "^", shapes[i + 2] if i + 2 < n else "$"
        names = (f"0{s}", f"1{p}|{s}{g}", f"2{s}|{q}{h}", f"3{p}|{s}|{q}", f"4{pp}|{p}|{s}", f"5{s}|{q}|{qq}", f"6{chunks[chunk[i]]}", f"7{s}|{chunks[chunk[i]]}", f"8{context}|{s}" if i < 3 else "8", f"9{min(total, 20)}|{s}", f"a{int('@' in chunks[chunk[i]])}{s[0]}", f"b{g}{h}{s[0]}", f"c{heads[chunk[i]]}|{s[0]}", f"d{min(sizes[chunk[i]] // 4, 11)}|{s[0]}{g}")
        out.append([_slot(x) for x in names])
    return out


def _lse(x, axis):
    import numpy as np

    m = x.max(axis=axis, keepdims=True)
    return np.squeeze(m, axis) + np.log(np.exp(x - m).sum(axis=axis))


def train(rows: list[tuple[str, list[tuple[str, int, int]]]], steps: int = 90, rate: float = 0.15, decay: float = 1e-3):
    """Weights (emission SLOTS x labels, transition labels x labels) from (text, spans) rows."""
    import numpy as np

    feats, golds = [], []
    for text, spans in rows:
        for tokens, word in runs(text or ""):
            gold = []
            for a, b in tokens:
                s = next((s for s in spans if s[1] <= a and b <= s[2]), None)
                gold.append(0 if s is None else 1 + 2 * FOUND.index(s[0]) + (a > s[1]))
            feats.append(featurise(text, tokens, word))
            golds.append(gold)
    n_labels = len(LABELS)
    w, t = np.zeros((SLOTS, n_labels)), np.zeros((n_labels, n_labels))
    t[_forbidden()] = -1e4
    if not feats:
        return w.astype(np.float32), t.astype(np.float32)
    # Longest runs first: at each place of a run only the first so many rows are still there.
    longest = sorted(range(len(feats)), key=lambda i: -len(feats[i]))
    feats, golds = [feats[i] for i in longest], [golds[i] for i in longest]
    size, most = len(feats), max(map(len, feats))
    lengths = np.array([len(x) for x in feats])
    there = [int((lengths > k).sum()) for k in range(most)]
    f, y, on = np.zeros((size, most, WIDTH), int), np.zeros((size, most), int), np.zeros((size, most), bool)
    for i, (x, g) in enumerate(zip(feats, golds)):
        f[i, : len(x)], y[i, : len(g)], on[i, : len(g)] = x, g, True
    free = ~_forbidden()
    moments = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)]
    eye = np.eye(n_labels)
    # Each slot's gradient is a sum over the tokens that have it: sorted once, added up in every step.
    slots = f[on].reshape(-1)
    order = np.argsort(slots, kind="stable")
    used, starts = np.unique(slots[order], return_index=True)
    who = order // WIDTH
    for step in range(1, steps + 1):
        e = w[f].sum(axis=2)
        alpha, beta = np.zeros_like(e), np.zeros_like(e)
        alpha[:, 0] = e[:, 0] + _first()
        for k in range(1, most):
            m = there[k]
            alpha[:m, k] = _lse(alpha[:m, k - 1, :, None] + t, 1) + e[:m, k]
        z = _lse(alpha[np.arange(size), lengths - 1], 1)
        for k in range(most - 2, -1, -1):
            m = there[k + 1]
            beta[:m, k] = _lse(t + (e[:m, k + 1] + beta[:m, k + 1])[:, None, :], 2)
        p = np.exp(np.minimum(alpha + beta - z[:, None, None], 0)) * on[..., None]
        diff = (eye[y] - p) * on[..., None]
        gw = np.zeros_like(w)
        gw[used] = np.add.reduceat(diff[on][who], starts, axis=0)
        gt = np.zeros_like(t)
        for k in range(1, most):
            live = slice(there[k])
            pair = np.exp(np.minimum(alpha[live, k - 1, :, None] + t + (e[live, k] + beta[live, k])[:, None, :] - z[live, None, None], 0))
            gt -= pair.sum(axis=0)
            np.add.at(gt, (y[live, k - 1], y[live, k]), 1)
        gw, gt = gw / size - decay * w, np.where(free, gt / size - decay * t, 0)
        for j, (x, g) in enumerate(((w, gw), (t, gt))):
            m, v = moments[2 * j], moments[2 * j + 1]
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return w.astype(np.float32), t.astype(np.float32)


def _forbidden():
    """Transitions to an inside label from anything but its own kind."""
    import numpy as np

    out = np.zeros((len(LABELS),) * 2, bool)
    for k in range(len(FOUND)):
        out[:, 2 + 2 * k] = True
        out[1 + 2 * k, 2 + 2 * k] = out[2 + 2 * k, 2 + 2 * k] = False
    return out


def _first():
    import numpy as np

    return np.array([-1e4 if x[0] == "I" else 0.0 for x in LABELS])


def viterbi(feats: list, model) -> list:
    """Labels of each run; runs of like length are decoded together."""
    import numpy as np

    w, t = model
    out: list = [None] * len(feats)
    order = sorted(range(len(feats)), key=lambda i: len(feats[i]))
    first = _first().astype(np.float32)
    at = 0
    while at < len(order):
        n = len(feats[order[at]])
        to = at
        while to < len(order) and len(feats[order[to]]) == n and (to - at) * n < 60_000:
            to += 1
        f = np.array([feats[i] for i in order[at:to]])
        e = np.zeros((to - at, n, len(LABELS)), np.float32)
        for k in range(WIDTH):
            e += w[f[:, :, k]]
        score, back = e[:, 0] + first, np.zeros((to - at, n, len(LABELS)), np.int8)
        for k in range(1, n):
            s = score[:, :, None] + t
            back[:, k] = s.argmax(axis=1)
            score = s.max(axis=1) + e[:, k]
        path = np.zeros((to - at, n), int)
        path[:, -1] = score.argmax(axis=1)
        for k in range(n - 1, 0, -1):
            path[:, k - 1] = np.take_along_axis(back[:, k], path[:, k, None], 1)[:, 0]
        for i, p in zip(order[at:to], path):
            out[i] = p
        at = to
    return out


_ALLOWED = (re.compile(r"[^\s@]+@[^\s@]+\.[^\s@]+"), re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}"), re.compile(r"[0-9][0-9 -]+[0-9]"), re.compile(r"[+(]?[0-9][0-9 ().-]+[0-9]"), re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/-]{12,}"))


def _can_be(kind: int, s: str) -> bool:
    """An exact check of what the CRF found: layout, number of digits, check digit."""
    d = digits_of(s)
    if not _ALLOWED[kind].fullmatch(s):
        return False
    return (True, all(int(p) <= 255 for p in s.split(".")) if kind == 1 else True, 13 <= len(d) <= 19 and luhn(d), 7 <= len(d) <= 15, True)[kind]


def find_all(texts: list[str], model) -> list[tuple[list, list]]:
    """Of each text: pattern spans, and all spans, by kind, then start."""
    base = [pattern_spans(t) for t in texts]
    where, feats = [], []
    for i, t in enumerate(texts):
        taken = sorted((a, b) for _, a, b in base[i])
        for tokens, word in runs(t):
            # Runs that patterns explain altogether need no decoding: nothing could be added.
            if any(not _inside(taken, a, b) for a, b in tokens if t[a].isdigit() or t[a] == "@"):
                where.append((i, tokens))
                feats.append(featurise(t, tokens, word))
    more: list[list] = [[] for _ in texts]
    for (i, tokens), path in zip(where, viterbi(feats, model)):
        k = 0
        while k < len(path):
            if path[k] and path[k] % 2:
                j = k + 1
                while j < len(path) and path[j] == path[k] + 1:
                    j += 1
                kind, a, b = (int(path[k]) - 1) // 2, tokens[k][0], tokens[j - 1][1]
                if FOUND[kind] == "secret":
                    a, b, j = _code_around(texts[i], tokens, k, j)
                if _can_be(kind, texts[i][a:b]) and not any(x < b and a < y for _, x, y in base[i]):
                    more[i].append((kind, a, b))
                k = j
            else:
                k += 1
    return [(b, sorted(b + m)) for b, m in zip(base, more)]


def _code_around(text: str, tokens, k: int, j: int) -> tuple[int, int, int]:
    """The whole code that tokens k to j are in (a code has no parts of its own), and the token after it."""
    a, b = tokens[k][0], tokens[j - 1][1]
    while a > 0 and _CODE.fullmatch(text[a - 1]):
        a -= 1
    if m := _CODE.match(text, b):
        b = m.end()
    while j < len(tokens) and tokens[j][0] < b:
        j += 1
    return a, b, j


def _inside(taken, a, b) -> bool:
    from bisect import bisect_right

    k = bisect_right(taken, (a, 1 << 60)) - 1
    return k >= 0 and b <= taken[k][1]


def labelled_table(n: int = 500, seed: int = 11) -> list[tuple[str, list[tuple[str, int, int]]]]:
    """A small labelled table, made by rule: personal data in many layouts, and numbers that are none."""
    r = random.Random(seed)
    dd = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    ww = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))
    sep = lambda: r.choice((" ", "-", "."))

    code = lambda k: "".join(r.choice("0123456789abcdefghijkmnqrstuvwxyz") for _ in range(k))

    def phone():
        s = sep()
        return r.choice((f"({dd(3)}) {dd(3)}-{dd(4)}", f"{dd(3)}{s}{dd(3)}{s}{dd(4)}", f"+{r.randint(1, 99)} ({dd(3)}) {dd(3)}-{dd(4)}", f"+{dd(2)} {dd(2)} {dd(4)} {dd(4)}", f"00{dd(2)} {dd(3)} {dd(7)}", f"1-{dd(3)}-{dd(3)}-{dd(4)}"))

    def card():
        body = dd(r.choice((14, 15, 15, 15)))
        own = next(body + c for c in "0123456789" if luhn(body + c))
        cuts = (4, 10) if len(own) == 15 else (4, 8, 12)
        return r.choice((" ", "-", "")).join(own[x:y] for x, y in zip((0, *cuts), (*cuts, len(own))))

    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    name = lambda: r.choice(("password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "key", "access_token", "client_secret"))

    def secret():
        """(what stands before, the secret, what stands after)."""
        code_ = r.choice((hexa(r.choice((16, 18, 20, 24, 32, 40, 64))), code(r.randint(14, 40))))
        code_ = code_[:2] + dd(1) + code_[3:]
        return r.choice((("", "AKIA" + code(16).upper()[:15] + dd(1), ""), (name() + "=", code_, ""), (name() + ' = "', code_, '"'), (name() + ": ", code_, ""), ("", r.choice(("ghp_", "sk-", "xoxb-")) + code_, "")))

    kinds = {"email": lambda: f"{ww()}{r.choice(('', '.' + ww(), dd(2), '.' + dd(2)))}@{ww()}{r.choice(('', dd(1)))}.{r.choice(('', ww() + '.'))}{r.choice(('com', 'org', 'net', 'de'))}", "ip": lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)), "card": card, "phone": phone}
    nothing = (lambda: f"{r.randint(1900, 2030)}-{dd(2)}-{dd(2)}", lambda: f"{dd(2)}:{dd(2)}", lambda: f"${dd(1)},{dd(3)}.{dd(2)}", lambda: dd(r.randint(1, 6)), lambda: f"{dd(1)}.{dd(1)}", lambda: f"v{dd(1)}.{dd(1)}.{dd(1)}", lambda: f"{dd(1)} + {dd(1)}", lambda: f"{dd(2)}%", lambda: f"978-{dd(1)}-{dd(4)}-{dd(4)}-{dd(1)}", lambda: ww() + dd(2), lambda: dd(r.randint(20, 30)), lambda: "@" + ww(), lambda: f"{dd(1)}e{dd(4)}f{dd(3)}ab{dd(5)}", lambda: f"{hexa(7)}", lambda: f"{ww()}={dd(3)}", lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: f"sha1 {hexa(40)}", lambda: f"{dd(1)}.", lambda: f"{dd(4)}.{dd(2)}")
    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(r.randint(1, 3)):
            text += " ".join(ww() for _ in range(r.randint(1, 4))) + " "
            if r.random() < 0.2:
                before, own, after = secret()
                text += before
                spans.append(("secret", len(text), len(text) + len(own)))
                text += own + after + r.choice((" ", " ", ", ", ". "))
                continue
            if r.random() < 0.55:
                kind = r.choice(KINDS)
                own = kinds[kind]()
                spans.append((kind, len(text), len(text) + len(own)))
            else:
                own = r.choice(nothing)()
            # Neighbours that only a blank parts are what patterns run together.
            text += own + r.choice((" ", " ", " ", ", ", ". "))
            if r.random() < 0.5:
                continue_with = kinds[r.choice(KINDS)]
                if spans and spans[-1][2] == len(text) - 1:
                    kind = next(k for k, f in kinds.items() if f is continue_with)
                    own = continue_with()
                    spans.append((kind, len(text), len(text) + len(own)))
                    text += own + " "
        out.append((text + ww(), spans))
    return out


@functools.lru_cache(maxsize=1)
def default_model():
    return train(labelled_table())


def fit(labelled: DataFrame):
    """From a small table (text, spans array<struct<kind, start, end>>); larger ones are refused."""
    rows = labelled.select("text", "spans").limit(MAX_ROWS + 1).collect()
    if len(rows) > MAX_ROWS:
        raise ValueError(f"a small labelled table is expected: {MAX_ROWS} rows at most")
    return train([(r.text, [tuple(s) for s in r.spans or []]) for r in rows])


def find(documents: DataFrame, model=None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (pattern spans), base_sha256, spans (``kind:start:end``, joined), and of
    what the CRF adds n_added, n_secret, secrets (likewise), and n_found, the number of all spans and secrets."""
    sent = documents.sparkSession.sparkContext.broadcast(model or default_model())
    say = lambda spans: ",".join(f"{FOUND[k]}:{a}:{b}" for k, a, b in spans)

    def run(texts):
        out = []
        for base, every in find_all(texts, sent.value):
            own, secrets = [x for x in every if x[0] < len(KINDS)], [x for x in every if x[0] >= len(KINDS)]
            out.append((*[sum(k == i for k, _, _ in base) for i in range(4)], sha(say(base)), say(own), len(own) - len(base), len(secrets), say(secrets), len(every)))
        return [list(x) for x in zip(*out)]

    return per_text(documents, text, run, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long, n_secret long, secrets string, n_found long", id_of(key))
