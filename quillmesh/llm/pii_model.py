"""A character-level bidirectional LSTM with a CRF on top, in numpy: fitting and decoding."""

from __future__ import annotations

import functools

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
WINDOW, OVERLAP = 96, 32
#: Character classes: each of these is a class of its own (fixed values).
ALONE = "@.-+()_%\"'=:,/#$&*!|\n []{}"
CLASSES = 5 + len(ALONE)
HIDDEN = 20
SPANS = 9000  # labelled spans to fit on
STEPS, BATCH, RATE = 500, 48, 0.02


def encode(text: str) -> np.ndarray:
    """Class of each code point: digits, a-f, other letters, capitals, the characters of ALONE, others."""
    u = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(u, 128)]


TABLE = np.full(129, 2, np.int64)
TABLE[:128] = 4
TABLE[48:58] = 0
TABLE[97:103] = 1
TABLE[103:123] = 2
TABLE[65:91] = 3
for _i, _c in enumerate(ALONE):
    TABLE[ord(_c)] = 5 + _i


def allowed() -> np.ndarray:
    """Transitions: inside follows begin or inside of its kind only."""
    ok = np.ones((TAGS, TAGS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 + 2 * k] = False
        ok[1 + 2 * k, 2 + 2 * k] = ok[2 + 2 * k, 2 + 2 * k] = True
    return ok


class Tagger:
    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {
            "wx": r.normal(0, 0.3, (2, CLASSES, 4 * h)), "wh": r.normal(0, 1 / np.sqrt(h), (2, h, 4 * h)), "b": np.zeros((2, 1, 4 * h)),
            "wo": r.normal(0, 1 / np.sqrt(2 * h), (2 * h, TAGS)), "bo": np.zeros(TAGS), "t": np.zeros((TAGS, TAGS)),
        }
        self.p["b"][:, :, h : 2 * h] = 1
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        self.bar = np.where(allowed(), 0, -1e4).astype(np.float32)

    def forward(self, x: np.ndarray, keep: bool = False):
        """Emission scores of windows x (batch, time); both directions run side by side."""
        p, h = self.p, HIDDEN
        b, t = x.shape
        both = np.stack([x, x[:, ::-1]])
        z_in = np.stack([p["wx"][d][both[d]] for d in range(2)]) + p["b"][:, :, None, :]
        hs, cs, gates = np.zeros((t + 1, 2, b, h), np.float32), np.zeros((t + 1, 2, b, h), np.float32), []
        for k in range(t):
            z = z_in[:, :, k] + hs[k] @ p["wh"]
            s = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            g = np.tanh(z[:, :, 2 * h : 3 * h])
            cs[k + 1] = s[:, :, h : 2 * h] * cs[k] + s[:, :, :h] * g
            hs[k + 1] = s[:, :, 3 * h :] * np.tanh(cs[k + 1])
            if keep:
                gates.append((s, g))
        out = np.concatenate([hs[1:, 0].transpose(1, 0, 2), hs[:0:-1, 1].transpose(1, 0, 2)], 2)
        e = out @ p["wo"] + p["bo"]
        return (e, out, both, hs, cs, gates) if keep else e

    def step(self, x: np.ndarray, y: np.ndarray):
        """Loss and gradients of a batch: negative log likelihood of the CRF."""
        p, h = self.p, HIDDEN
        e, out, both, hs, cs, gates = self.forward(x, True)
        b, t = x.shape
        a = p["t"] + self.bar
        alpha, beta = np.zeros((t, b, TAGS), np.float32), np.zeros((t, b, TAGS), np.float32)
        lse = lambda v, ax: (m := v.max(ax, keepdims=True)).squeeze(ax) + np.log(np.exp(v - m).sum(ax))
        alpha[0] = e[:, 0] + self.bar[0]
        for k in range(1, t):
            alpha[k] = lse(alpha[k - 1][:, :, None] + a, 1) + e[:, k]
        for k in range(t - 2, -1, -1):
            beta[k] = lse((beta[k + 1] + e[:, k + 1])[:, None, :] + a, 2)
        z = lse(alpha[-1], 1)
        de = np.exp(alpha + beta - z[None, :, None]).transpose(1, 0, 2)
        dt = np.zeros_like(p["t"])
        for k in range(t - 1):
            dt += np.exp(alpha[k][:, :, None] + a + (beta[k + 1] + e[:, k + 1])[:, None, :] - z[:, None, None]).sum(0)
        i, j = np.indices(y.shape)
        gold = e[i, j, y].sum(1) + a[y[:, :-1], y[:, 1:]].sum(1)
        de[i, j, y] -= 1
        np.subtract.at(dt, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        g["t"] = np.where(self.bar < 0, 0, dt)
        g["wo"], g["bo"] = out.reshape(-1, 2 * h).T @ de.reshape(-1, TAGS), de.sum((0, 1))
        dout = de @ p["wo"].T
        dh_out = np.stack([dout[:, :, :h], dout[:, ::-1, h:]])
        dh, dc = np.zeros((2, b, h), np.float32), np.zeros((2, b, h), np.float32)
        dz_all = np.zeros((2, b, t, 4 * h), np.float32)
        for k in range(t - 1, -1, -1):
            s, gg = gates[k]
            dh = dh + dh_out[:, :, k]
            tc = np.tanh(cs[k + 1])
            dc = dc + dh * s[:, :, 3 * h :] * (1 - tc**2)
            dz = dz_all[:, :, k]
            dz[:, :, :h] = dc * gg * s[:, :, :h] * (1 - s[:, :, :h])
            dz[:, :, h : 2 * h] = dc * cs[k] * s[:, :, h : 2 * h] * (1 - s[:, :, h : 2 * h])
            dz[:, :, 2 * h : 3 * h] = dc * s[:, :, :h] * (1 - gg**2)
            dz[:, :, 3 * h :] = dh * tc * s[:, :, 3 * h :] * (1 - s[:, :, 3 * h :])
            dc = dc * s[:, :, h : 2 * h]
            dh = dz @ p["wh"].transpose(0, 2, 1)
        for d in range(2):
            flat = dz_all[d].reshape(-1, 4 * h)
            one = np.zeros((flat.shape[0], CLASSES), np.float32)
            one[np.arange(flat.shape[0]), both[d].ravel()] = 1
            g["wx"][d] = one.T @ flat
            g["wh"][d] = hs[:-1, d].transpose(1, 0, 2).reshape(-1, h).T @ flat
            g["b"][d, 0] = flat.sum(0)
        return float((z - gold).mean()), {k: v / b for k, v in g.items()}

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = STEPS, seed: int = 6):
        r = np.random.default_rng(seed)
        m, v = {k: np.zeros_like(w) for k, w in self.p.items()}, {k: np.zeros_like(w) for k, w in self.p.items()}
        for k in range(1, steps + 1):
            i = r.integers(0, len(x), BATCH)
            _, g = self.step(x[i], y[i])
            norm = np.sqrt(sum(float((w**2).sum()) for w in g.values()))
            rate, clip = RATE * (1 - k / (steps + 1)), min(1, 30 / (norm + 1e-9))
            for n, w in g.items():
                w *= clip
                m[n] = 0.9 * m[n] + 0.1 * w
                v[n] = 0.99 * v[n] + 0.01 * w * w
                self.p[n] -= (rate * (m[n] / (1 - 0.9**k)) / (np.sqrt(v[n] / (1 - 0.99**k)) + 1e-6)).astype(np.float32)
        return self

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tag sequence (Viterbi) of each window."""
        e = self.forward(x)
        b, t = x.shape
        a = self.p["t"] + self.bar
        best, back = e[:, 0] + self.bar[0], np.zeros((t, b, TAGS), np.int8)
        for k in range(1, t):
            s = best[:, :, None] + a
            back[k] = s.argmax(1)
            best = s.max(1) + e[:, k]
        tags = np.zeros((b, t), np.int64)
        tags[:, -1] = best.argmax(1)
        for k in range(t - 1, 0, -1):
            tags[:, k - 1] = back[k][np.arange(b), tags[:, k]]
        return tags


def luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def labelled_windows(n_spans: int = SPANS, seed: int = 4):
    """Windows of invented prose with labelled spans: personal data, alone or side by side, among look-alikes."""
    r = np.random.default_rng(seed)
    pick = lambda s, n: "".join(r.choice(list(s), n))
    dig = lambda n: pick("0123456789", n)
    word = lambda: pick("etaoinshrdlucmfwypvbgkéèüßñó", int(r.integers(1, 12)))

    def card():
        d = dig(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", "", " ", "-", ".", "/", "  ", "_"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone():
        a, b, c, k = dig(3), dig(3), dig(4), int(r.integers(0, 9))
        cc = dig(int(r.integers(1, 3)))
        return [f"+{cc} ({a}) {b}-{c}", f"+{cc} ({a}) {b}-{c}", f"+{cc} {a} {b} {c}", f"+{cc}-{a}-{b}-{c}", f"+{cc}{a}{b}{c}", f"({a}) {b}-{c}", f"+{cc}.{a}.{b}.{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}"][k]

    def ip():
        return r.choice([".", ".", ".", "[.]", "(.)", "[dot]"]).join(str(r.integers(1, 256)) for _ in range(4))

    def email():
        name = word() + r.choice(["", "." + word(), dig(2), "." + dig(2), "_" + word()])
        at, dot = ("@", ".") if r.random() < 0.65 else r.choice([("[at]", "[dot]"), (" [at] ", " [dot] "), ("(at)", "."), (" (at) ", " (dot) "), (" @ ", "."), ("{at}", "{dot}"), (" [AT] ", " [DOT] "), ("[at]", ".")])
        return "".join(c for c in name if c.isascii()) + "x" + at + r.choice(["mail", "host", "web", "post"]) + r.choice(["", dig(1)]) + dot + r.choice(["example", "corp", "uni"]) + dot + r.choice(["com", "org", "net", "de"])

    def other():
        k = int(r.integers(0, 14))
        return [f"[{word()}]", f"({dig(4)})", f"{word()} @ {word()}", f'token = "{pick("0123456789abcdef", int(r.integers(16, 34)))}"', dig(int(r.integers(1, 13))), f"{r.integers(1900, 2100)}", f"{r.integers(1, 32)}.{r.integers(1, 13)}.{r.integers(1990, 2030)}", f"{dig(1)}.{dig(1)}.{dig(2)}", f"{dig(2)}:{dig(2)}", f"{dig(2)},{dig(2)}", f"{dig(4)}-{dig(2)}-{dig(2)}", f"@{word()}", f"password={pick('0123456789abcdef', 18)}", f"{word()}{dig(int(r.integers(1, 4)))}"][k]

    make = {"email": email, "ip": ip, "card": card, "phone": phone}
    xs, ys, made = [], [], 0
    while made < n_spans:
        text, tags = "", []

        def add(s, kind=None):
            nonlocal text
            k = None if kind is None else KINDS.index(kind)
            text += s
            tags.extend([0] * len(s) if k is None else [1 + 2 * k] + [2 + 2 * k] * (len(s) - 1))

        while len(text) < WINDOW:
            u = r.random()
            if u < 0.28:
                kind = r.choice(KINDS)
                add(make[kind](), kind)
                made += 1
                add(r.choice(["", "", "", ".", ",", "!!", "%%%", "###"]))
                while r.random() < 0.35:
                    add(" ")
                    kind = r.choice(KINDS)
                    add(make[kind](), kind)
                    made += 1
            elif u < 0.42:
                add(other())
            else:
                w = word()
                add((w.upper() if r.random() < 0.1 else w) + r.choice(["", "", "", ".", ",", "***"]))
            add("\n" if r.random() < 0.05 else " ")
        at = int(r.integers(0, len(text) - WINDOW + 1))
        t = np.array(tags[at : at + WINDOW])  # a span cut at the start begins there
        if t[0] and t[0] % 2 == 0:
            t[0] -= 1
        xs.append(encode(text[at : at + WINDOW]))
        ys.append(t)
    return np.stack(xs), np.stack(ys)


@functools.cache
def fitted(spans: int = SPANS, steps: int = STEPS) -> Tagger:
    return Tagger().fit(*labelled_windows(spans), steps=steps)
