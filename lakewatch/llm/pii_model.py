"""A character-level bidirectional LSTM with CRF transitions in numpy: training from labelled spans and decoding.

`train` makes the model, the same for every input; `python -m lakewatch.llm.pii_model` writes what it made beside this file,
and `trained` reads it, so that no query trains anew. A test trains again and compares."""

from __future__ import annotations

import functools
import io
import os
import pkgutil
import unicodedata
from dataclasses import dataclass

import numpy as np

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside; begin and inside of each kind
#: Classes of characters: what the model sees. Letters, digits and white space are one class each but for those of (at), (dot).
_SINGLE = "@.-+()[]_%/:,;#=\"'atdoATDO"
_DIGIT, _LOWER, _UPPER, _LETTER, _SPACE, _OTHER = range(len(_SINGLE) + 1, len(_SINGLE) + 7)
CLASSES = len(_SINGLE) + 7  # 0 pads
HIDDEN = 16


def _class_of(c: str) -> int:
    if c in _SINGLE:
        return _SINGLE.index(c) + 1
    if "0" <= c <= "9":
        return _DIGIT
    if "a" <= c <= "z":
        return _LOWER
    if "A" <= c <= "Z":
        return _UPPER
    if c.isspace():
        return _SPACE
    return _LETTER if unicodedata.category(c)[0] == "L" else _OTHER


_LATIN = np.array([_class_of(chr(i)) for i in range(0x250)], np.uint8)


def classes(text: str) -> np.ndarray:
    """The class of each code point; beyond Latin, letters aren't told from other characters."""
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return np.where(points < len(_LATIN), _LATIN[np.minimum(points, len(_LATIN) - 1)], _OTHER).astype(np.uint8)


@dataclass
class Model:
    """x: (2, CLASSES, 4H) what a class adds to each direction's gates; u: (2, H, 4H); out: (2H, TAGS); trans: (TAGS, TAGS)."""

    x: np.ndarray
    u: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    trans: np.ndarray

    def parts(self):
        return [self.x, self.u, self.out, self.bias, self.trans]


def _sigmoid(v):
    return 0.5 * (1 + np.tanh(0.5 * v))


def emissions(m: Model, seq: np.ndarray, keep: bool = False):
    """(B, T) classes -> (T, B, TAGS) scores; with `keep` also what the gradient needs. Padding (class 0) is at the end."""
    batch, steps = seq.shape
    h = np.zeros((2, batch, HIDDEN), np.float32)
    c = np.zeros_like(h)
    real = (seq != 0).astype(np.float32)
    both = np.stack([seq.T, seq.T[::-1]])  # (2, T, B): the second direction reads from the end
    live = np.stack([real.T, real.T[::-1]])[..., None]
    states = np.zeros((steps, 2, batch, HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        gates = np.matmul(h, m.u)
        gates[0] += m.x[0][both[0, t]]
        gates[1] += m.x[1][both[1, t]]
        i, f, o = (_sigmoid(gates[..., k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
        g = np.tanh(gates[..., 3 * HIDDEN :])
        new = (f * c + i * g) * live[:, t]
        squashed = np.tanh(new)
        if keep:
            saved.append((i, f, o, g, c, h, squashed))
        c, h = new, o * squashed * live[:, t]
        states[t] = h
    hidden = np.concatenate([states[:, 0], states[::-1, 1]], -1)  # (T, B, 2H)
    scores = hidden @ m.out + m.bias
    return (scores, hidden, saved, both, live) if keep else scores


def _logsumexp(a, axis):
    top = a.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(a - top).sum(axis))


def loss_and_gradient(m: Model, seq: np.ndarray, tags: np.ndarray):
    """Negative log likelihood of the tags (B, T) per sequence and the gradient of every part."""
    scores, hidden, saved, both, live = emissions(m, seq, keep=True)
    steps, batch, _ = scores.shape
    on = (seq.T != 0)[..., None]
    alpha = np.zeros_like(scores)
    alpha[0] = scores[0]
    for t in range(1, steps):
        alpha[t] = np.where(on[t], scores[t] + _logsumexp(alpha[t - 1][:, :, None] + m.trans, 1), alpha[t - 1])
    beta = np.zeros_like(scores)
    for t in range(steps - 2, -1, -1):
        beta[t] = np.where(on[t + 1], _logsumexp(m.trans[None] + (scores[t + 1] + beta[t + 1])[:, None, :], 2), beta[t + 1])
    log_z = _logsumexp(alpha[-1], 1)
    d_scores = np.exp(alpha + beta - log_z[None, :, None]) * on
    d_trans = np.zeros_like(m.trans)
    rows, gold = np.arange(batch), np.zeros(batch)
    for t in range(steps):
        is_on = on[t, :, 0]
        gold += np.where(is_on, scores[t, rows, tags[:, t]], 0)
        d_scores[t, rows, tags[:, t]] -= is_on
        if t:
            pair = np.exp(alpha[t - 1][:, :, None] + m.trans + (scores[t] + beta[t])[:, None, :] - log_z[:, None, None]) * is_on[:, None, None]
            d_trans += pair.sum(0)
            np.subtract.at(d_trans, (tags[is_on, t - 1], tags[is_on, t]), 1)
            gold += np.where(is_on, m.trans[tags[:, t - 1], tags[:, t]], 0)
    flat = d_scores.reshape(-1, TAGS)
    d_out, d_bias = hidden.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
    d_hidden = d_scores @ m.out.T
    d_states = np.stack([d_hidden[:, :, :HIDDEN], d_hidden[::-1, :, HIDDEN:]], 1)
    d_x, d_u = np.zeros_like(m.x), np.zeros_like(m.u)
    d_h = np.zeros((2, batch, HIDDEN), np.float32)
    d_c = np.zeros_like(d_h)
    all_gates = np.zeros((2, steps, batch, 4 * HIDDEN), m.x.dtype)
    for t in range(steps - 1, -1, -1):
        i, f, o, g, c, h, squashed = saved[t]
        d_h = (d_h + d_states[t]) * live[:, t]
        d_new = (d_c + d_h * o * (1 - squashed**2)) * live[:, t]
        d_gates = np.concatenate([d_new * g * i * (1 - i), d_new * c * f * (1 - f), d_h * squashed * o * (1 - o), d_new * i * (1 - g**2)], -1)
        d_u += np.matmul(h.transpose(0, 2, 1), d_gates)
        all_gates[:, t] = d_gates
        d_h, d_c = np.matmul(d_gates, m.u.transpose(0, 2, 1)), d_new * f
    for k in (0, 1):  # a class's rows summed: its indicator times the gates
        d_x[k] = (both[k].reshape(1, -1) == np.arange(CLASSES)[:, None]).astype(all_gates.dtype) @ all_gates[k].reshape(-1, 4 * HIDDEN)
    return (log_z - gold).mean(), [g / batch for g in (d_x, d_u, d_out, d_bias, d_trans)]


def _examples(rng, n: int, width: int):
    """Labelled texts: invented words around addresses and numbers in many forms, and numbers that are none."""
    pick = lambda s: s[rng.integers(len(s))]
    digits = lambda k: "".join(str(x) for x in rng.integers(0, 10, k))
    syllables = ["ta", "ne", "or", "li", "est", "qu", "éa", "ün", "mo", "pra", "che", "zu", "ing", "the", "de", "ción", "wh", "st", "ly", "o"]
    word = lambda: "".join(pick(syllables) for _ in range(rng.integers(1, 5)))
    name = lambda: "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.integers(2, 9)))

    def email():
        user = name() + pick(["", ".", "_", "-", "+"]) * 1 + pick([name(), digits(2), digits(3), ""])
        host = pick(["", "mail.", f"mail{digits(1)}.", "smtp."]) + name() + "." + pick(["com", "org", "net", "de", "fr", "es", "co.uk", "example.com"])
        return user.strip(".-_+") + pick(["@", "@", "@", "@", " @ ", " (at) ", " [at] "]) + host

    def ip():
        return ".".join(str(x) for x in rng.integers(0, 256, 4))

    def luhn(d):
        total = sum(int(c) if k % 2 else (2 * int(c) - 9 * (int(c) > 4)) for k, c in enumerate(reversed(d)))
        return d + str(-total % 10)

    def card():
        d = luhn(pick(["4", "5", "37", "6011"]) + digits(12))[:16]
        d = luhn(d[:15])
        short = luhn(pick(["34", "37"]) + digits(12))
        return pick([d, d, " ".join(d[k : k + 4] for k in range(0, 16, 4)), "-".join(d[k : k + 4] for k in range(0, 16, 4)), f"{short[:4]} {short[4:10]} {short[10:]}", short])

    def phone():
        a, b, c = digits(3), digits(3), digits(4)
        return pick([f"+1 ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{digits(2)} {digits(2)} {digits(4)} {digits(4)}", f"+{digits(11)}", f"+{digits(2)}-{digits(3)}-{digits(6)}", f"0{digits(3)} {digits(7)}", f"0{digits(2)}/{digits(7)}", f"0{digits(2)} {digits(3)} {digits(4)}", f"0{digits(4)}-{digits(6)}"])

    def other():
        hexed = "".join(pick("0123456789abcdef") for _ in range(rng.integers(8, 41)))
        return pick([
            digits(rng.integers(1, 7)), f"{rng.integers(1900, 2030)}-{digits(2)}-{digits(2)}", f"{digits(1)}.{digits(1)}.{digits(1)}", f"{digits(2)}:{digits(2)}", f"${digits(3)}.{digits(2)}", f"{digits(2)}/{digits(2)}/{digits(4)}",
            hexed, f'token = "{hexed}"', f"password={hexed}", "AKIA" + "".join(pick("ABCDEFGHJKLM234567") for _ in range(16)), f"{digits(1)},{digits(3)},{digits(3)}", f"{digits(2)}%", f"@{name()}", f"v{digits(1)}.{digits(2)}", f"{digits(5)}-{digits(4)}", f"{name()}{digits(3)}", f"#{digits(4)}", f"{digits(4)}/{digits(4)}",
        ])

    makers = {"email": email, "ip": ip, "card": card, "phone": phone}
    seq, tags = np.zeros((n, width), np.uint8), np.zeros((n, width), np.int64)
    for r in range(n):
        text, labels = "", []
        while len(text) < width + 20:
            kind = pick([*KINDS, None, None, "word", "word", "word"])
            part = word() if kind == "word" else other() if kind is None else makers[kind]()
            part = part.upper() if kind in ("email", "word") and rng.random() < 0.06 else part
            if kind in makers:
                k = KINDS.index(kind)
                labels += [1 + 2 * k] + [2 + 2 * k] * (len(part) - 1)
            else:
                labels += [0] * len(part)
            gap = pick([" ", " ", " ", " ", ", ", ". ", "\n", " (", ") ", ": ", " '", "; "])
            if gap == ". " and rng.random() < 0.5:
                gap = ".\n"
            text, labels = text + part + gap, labels + [0] * len(gap)
        cut = int(rng.integers(0, 12))
        size = width if rng.random() < 0.8 else int(rng.integers(min(20, width - 1), width))
        part = labels[cut : cut + size]
        for k, tag in enumerate(part):  # a cut span goes on from before the window
            if tag and tag % 2 == 0 and (k == 0 or part[k - 1] not in (tag, tag - 1)):
                part[k] = tag
        seq[r, :size], tags[r, :size] = classes(text)[cut : cut + size], part
    return seq, tags


def train(seed: int = 5, steps: int = 350, batch: int = 48, width: int = 64) -> Model:
    """The model, the same for every input: Adam on invented labelled spans."""
    rng = np.random.default_rng(seed)
    init = lambda *s: rng.normal(0, 0.25, s).astype(np.float32)
    m = Model(init(2, CLASSES, 4 * HIDDEN), init(2, HIDDEN, 4 * HIDDEN), init(2 * HIDDEN, TAGS), np.zeros(TAGS, np.float32), np.zeros((TAGS, TAGS), np.float32))
    m.x[:, :, HIDDEN : 2 * HIDDEN] += 0.5
    seq, tags = _examples(rng, 3000, width)
    first, second = ([np.zeros_like(p) for p in m.parts()] for _ in range(2))
    for step in range(1, steps + 1):
        at = rng.integers(0, len(seq), batch)
        _, gradient = loss_and_gradient(m, seq[at], tags[at])
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradient))
        rate = 0.02 * min(1.0, 2.0 - 2.0 * step / (steps + 1))
        for p, g, a, b in zip(m.parts(), gradient, first, second):
            g = g * min(1.0, 5.0 / norm)
            a[...] = 0.9 * a + 0.1 * g
            b[...] = 0.99 * b + 0.01 * g * g
            p -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return m


STORED = "pii_model.npz"


@functools.lru_cache(maxsize=1)
def trained() -> Model:
    """The stored model."""
    with np.load(io.BytesIO(pkgutil.get_data(__package__, STORED))) as parts:
        return Model(*(parts[f"arr_{k}"] for k in range(5)))


def decode(m: Model, seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best tags (B, T) of windows, and each place's lead of its tag over `outside` in the emissions."""
    scores = emissions(m, seq)
    steps, batch, _ = scores.shape
    on = (seq.T != 0)[..., None]
    best, back = scores[0].copy(), np.zeros((steps, batch, TAGS), np.int8)
    for t in range(1, steps):
        all_ = best[:, :, None] + m.trans
        back[t] = np.where(on[t], all_.argmax(1), np.arange(TAGS))
        best = np.where(on[t], all_.max(1) + scores[t], best)
    tags = np.zeros((batch, steps), np.int64)
    tags[:, -1] = best.argmax(1)
    rows = np.arange(batch)
    for t in range(steps - 1, 0, -1):
        tags[:, t - 1] = back[t, rows, tags[:, t]]
    lead = np.take_along_axis(scores.transpose(1, 0, 2), tags[:, :, None], 2)[:, :, 0] - scores[:, :, 0].T
    return np.where(seq != 0, tags, 0), lead


if __name__ == "__main__":
    np.savez_compressed(os.path.join(os.path.dirname(os.path.abspath(__file__)), STORED), *train().parts())
