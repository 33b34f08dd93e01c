"""Personal data: base patterns, and a character-level bidirectional LSTM with CRF transitions beside them.

Base spans (e-mail, IP, card and phone numbers in their plain forms) follow fixed patterns, scanned in time
linear in the text. The network finds what these miss: spelled-out or spaced addresses, masked dots, other
separators, numbers without a country code. It is trained in numpy from written-down labelled spans (rules that
render them, `examples`), reads windows of `WIDTH` characters that overlap by WIDTH - STRIDE and decodes each by
Viterbi. Pieces of one kind that overlap are joined over the whole text, so that a span may be longer than a
window, and of spans of different kinds that overlap the set with the highest total score stays (weighted
interval scheduling). A found span is widened to whole runs of letters and digits, trimmed, and must be of
its kind's form (parts up to 255, check digit, number of digits); base spans stay, and one that overlaps a base
span goes.

A found span must have its kind's form (`fits`), and every form holds an anchor: a digit, an at sign, a spelled "at"
with a dotted host behind it, a spelled "dot", or colons among hexadecimal digits. The network reads all text
within REACH characters of an anchor and, where a form may reach further (addresses of many words, digits far
apart, zones of IP addresses), the whole of it (`reaches`). So what it does not read can hold no span. Texts
without an anchor are not sent to Python at all.

Defined results: a null text counts as empty; an empty text has no spans. Offsets are code points, end
exclusive. Repeated rows are judged each. Columns of other names pass through; outputs replace equal names.
"""

from __future__ import annotations

import ipaddress
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import table, text_of

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE, REACH = 96, 32, 40
#: Windows that are decoded at once.
AT_ONCE = 512
#: White space as Python knows it, as Java's own is smaller; characters of a host's part in any case (four of them fold to ASCII letters).
BLANK, PART = r"[\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]", r"[-A-Za-z0-9\u0130\u0131\u017f\u212a]"
ANCHOR = (
    rf"[0-9@]|[\[({{<]{BLANK}?(?:[aA][tT]|[dD][oO][tT]){BLANK}?[\])}}>]|{BLANK}[dD][oO][tT]{BLANK}"
    rf"|{BLANK}[aA][tT]{BLANK}{PART}+(?:\.{PART}|{BLANK}\.{BLANK}|{BLANK}?[\[({{<]{BLANK}?\.)|:[A-Fa-f]{{0,4}}:[A-Fa-f]{{0,4}}:"
)
SPANS = "array<struct<kind:string,start:int,end:int>>"
Span = tuple[int, int, int]  # kind, start, end

# --- base patterns

DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
PLUS = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def small(part: str) -> bool:
    """A decimal number of at most 255."""
    part = part.lstrip("0")
    return len(part) < 4 and int(part or "0") <= 255


def emails(text: str) -> Iterator[tuple[int, int]]:
    """An address begins with the run of local characters before its at sign, as far as no earlier address took them."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = DOMAIN.match(text, at) if start < at else None
        if host:
            yield start, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[Span]:
    """Base spans by kind, then start; leftmost and without overlap within a kind."""
    out = [(0, a, b) for a, b in emails(text)]
    for m in DOTTED.finditer(text):
        at, parts = m.start(), m.group().split(".")
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = at + sum(map(len, four)) + 3
            if all(map(small, four)):
                out.append((1, at, end))
            at = end + 1
    for kind, pattern, least, most in ((2, CHAIN, 13, 19), (3, PLUS, 9, 15)):
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m.group())
            if least <= len(digits) <= most and (kind == 3 or luhn(digits)):
                out.append((kind, m.start(), m.end()))
    return out


# --- forms that a found span must have

AT_SIGN = r"(?:\s?[\[({<]\s?at\s?[\])}>]\s?|\sat\s|\s?@\s?)"
DOT_SIGN = r"(?:\s?[\[({<]\s?(?:dot|\.)\s?[\])}>]\s?|\sdot\s|\s\.\s|\.)"
LOOSE_EMAIL = re.compile(rf"[a-z0-9_%+-]+(?:{DOT_SIGN}[a-z0-9_%+-]+)*{AT_SIGN}[a-z0-9-]+(?:{DOT_SIGN}[a-z0-9-]+)*{DOT_SIGN}[a-z]{{2,}}", re.I)
DOTS = re.compile(DOT_SIGN, re.I)
SEPARATORS = re.compile(r"[0-9   ./·–-]+")
CALLED = re.compile(r"(?:\+|\()?[0-9(][0-9   ()./–-]+[0-9]")


def fits(kind: int, span: str) -> bool:
    """Whether a text has the form of its kind, loosely written."""
    digits = re.sub("[^0-9]", "", span)
    if kind == 0:
        return LOOSE_EMAIL.fullmatch(span) is not None
    if kind == 1:
        if ":" in span:
            try:
                return span.count(":") >= 3 and ipaddress.ip_address(span).version == 6
            except ValueError:
                return False
        parts = DOTS.split(span)
        return len(parts) == 4 and all(p.isascii() and p.isdigit() and small(p) for p in parts)
    if kind == 2:
        return SEPARATORS.fullmatch(span) is not None and 13 <= len(digits) <= 19 and luhn(digits)
    return CALLED.fullmatch(span) is not None and 9 <= len(digits) <= 15


WORDY = re.compile(r"[A-Za-z0-9]+")
#: Characters at which a span of each kind may begin and end.
ENDS = ((re.compile(r"[A-Za-z0-9]"), re.compile(r"[A-Za-z]")), (re.compile("[0-9A-Fa-f:]"), re.compile("[0-9A-Fa-f:]")), (re.compile("[0-9]"), re.compile("[0-9]")), (re.compile(r"[0-9+(]"), re.compile("[0-9]")))


def widened(found: list[Span], text: str) -> list[Span]:
    """Spans widened to whole runs of letters and digits, each once. What is left is linear in the text, as spans of one run become one."""
    runs = [m.span() for m in WORDY.finditer(text)] if found else []
    starts, out = [a for a, _ in runs], {}
    for kind, a, b in found:
        first, last = bisect_right(starts, a) - 1, bisect_right(starts, b - 1) - 1
        a = starts[first] if first >= 0 and a < runs[first][1] else a
        b = max(b, runs[last][1]) if last >= 0 and b - 1 < runs[last][1] else b
        out[kind, a, b] = None
    return list(out)


def trimmed(kind: int, start: int, end: int, text: str) -> tuple[int, int]:
    """Cut down to where the kind may begin and end."""
    first, last = ENDS[kind]
    while start < end and not first.match(text[start]):
        start += 1
    while end > start and not last.match(text[end - 1]):
        end -= 1
    if kind == 3 and text[start:end].count(")") > text[start:end].count("(") and start > 0 and text[start - 1] == "(":
        start -= 1
    return start, end


# --- the network

OTHER = 96  # characters: 0 pads, 1 to 95 are ASCII, then letters, digits and spaces of other scripts, the rest
LABELS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBEDDED, HIDDEN = 12, 20
FORBIDDEN = np.zeros((LABELS, LABELS), bool)
for _k in range(len(KINDS)):
    FORBIDDEN[:, 2 + 2 * _k] = True
    FORBIDDEN[[1 + 2 * _k, 2 + 2 * _k], 2 + 2 * _k] = False


def coded(text: str) -> list[int]:
    return [ord(c) - 31 if " " <= c <= "~" else OTHER if c.isalpha() else OTHER + 1 if c.isspace() else OTHER + 2 for c in text]


def batch_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes, padded at the end, and lengths."""
    sizes = np.array([len(t) for t in texts])
    out = np.zeros((len(texts), int(sizes.max(initial=1))), dtype=np.int32)
    for row, t in zip(out, texts, strict=True):
        row[: len(t)] = coded(t)
    return out, sizes


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@dataclass
class Network:
    """Both directions lie on the first axis of `given`, `own` and `bias`."""

    letters: np.ndarray  # characters x EMBEDDED
    given: np.ndarray  # 2 x EMBEDDED x 4 HIDDEN: input, forget and output gate, candidate
    own: np.ndarray  # 2 x HIDDEN x 4 HIDDEN
    bias: np.ndarray  # 2 x 4 HIDDEN
    out: np.ndarray  # 2 HIDDEN x LABELS
    out_bias: np.ndarray
    moves: np.ndarray  # LABELS x LABELS: from, to
    start: np.ndarray

    @classmethod
    def fresh(cls, seed: int) -> Network:
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.normal(size=shape) / shape[-2] ** 0.5).astype(np.float32)
        bias = np.zeros((2, 4 * HIDDEN), np.float32)
        bias[:, HIDDEN : 2 * HIDDEN] = 1
        zeros = lambda *shape: np.zeros(shape, np.float32)
        return cls(draw(OTHER + 3, EMBEDDED), draw(2, EMBEDDED, 4 * HIDDEN), draw(2, HIDDEN, 4 * HIDDEN), bias, draw(2 * HIDDEN, LABELS), zeros(LABELS), zeros(LABELS, LABELS), zeros(LABELS))

    def read(self, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, dict]:
        """Scores of each label at each character, and what the backward pass needs. Each text is turned round for the second direction."""
        n, width = codes.shape
        place = np.arange(width)
        turned = np.where(place < sizes[:, None], sizes[:, None] - 1 - place, place)
        both = np.stack([codes, np.take_along_axis(codes, turned, axis=1)])
        pre = np.stack([(self.letters @ self.given[d] + self.bias[d])[both[d]] for d in (0, 1)])
        h = c = np.zeros((2, n, HIDDEN), np.float32)
        gates, cells, states = np.empty_like(pre), np.empty((2, n, width, HIDDEN), np.float32), np.empty((2, n, width, HIDDEN), np.float32)
        for t in range(width):
            a = pre[:, :, t] + h @ self.own
            a[..., : 3 * HIDDEN] = sigmoid(a[..., : 3 * HIDDEN])
            a[..., 3 * HIDDEN :] = np.tanh(a[..., 3 * HIDDEN :])
            c = a[..., HIDDEN : 2 * HIDDEN] * c + a[..., :HIDDEN] * a[..., 3 * HIDDEN :]
            h = a[..., 2 * HIDDEN : 3 * HIDDEN] * np.tanh(c)
            gates[:, :, t], cells[:, :, t], states[:, :, t] = a, c, h
        features = np.concatenate([states[0], np.take_along_axis(states[1], turned[..., None], axis=1)], axis=2)
        return features @ self.out + self.out_bias, {"both": both, "turned": turned, "gates": gates, "cells": cells, "states": states, "features": features}

    def transitions(self) -> np.ndarray:
        return np.where(FORBIDDEN, np.float32(-1e4), self.moves)

    def loss(self, codes: np.ndarray, sizes: np.ndarray, labels: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean negative log-likelihood of the label paths, and its slopes in the order of the fields."""
        scores, kept = self.read(codes, sizes)
        moves, (n, width) = self.transitions(), codes.shape
        inside = np.arange(width) < sizes[:, None]
        ahead, back = np.empty_like(scores), np.zeros_like(scores)
        ahead[:, 0] = self.start + scores[:, 0]
        for t in range(1, width):
            step = log_sum(ahead[:, t - 1, :, None] + moves, 1) + scores[:, t]
            ahead[:, t] = np.where(inside[:, t, None], step, ahead[:, t - 1])
        for t in range(width - 2, -1, -1):
            step = log_sum(moves + (scores[:, t + 1] + back[:, t + 1])[:, None], 2)
            back[:, t] = np.where(inside[:, t + 1, None], step, 0)
        whole = log_sum(ahead[:, -1], 1)
        shares = np.exp(np.minimum(ahead + back - whole[:, None, None], 0)) * inside[..., None]
        rows, places = np.nonzero(inside)
        slope, path = shares.copy(), labels[rows, places]
        slope[rows, places, path] -= 1
        to_moves = np.zeros_like(self.moves)
        gold = self.start[labels[:, 0]].sum() + scores[rows, places, path].sum()
        for t in range(1, width):
            on = inside[:, t]
            if not on.any():
                break
            pairs = ahead[on, t - 1, :, None] + moves + (scores[on, t] + back[on, t] - whole[on, None])[:, None]
            to_moves += np.exp(np.minimum(pairs, 0)).sum(axis=0)
            np.add.at(to_moves, (labels[on, t - 1], labels[on, t]), -1)
            gold += moves[labels[on, t - 1], labels[on, t]].sum()
        to_start = slope[:, 0].sum(axis=0)
        slope /= n
        to_out = np.einsum("btf,btl->fl", kept["features"], slope)
        to_features = slope @ self.out.T
        to_states = np.stack([to_features[..., :HIDDEN], np.take_along_axis(to_features[..., HIDDEN:], kept["turned"][..., None], axis=1)])
        to_pre = np.empty_like(kept["gates"])
        dh = dc = np.zeros((2, n, HIDDEN), np.float32)
        for t in range(width - 1, -1, -1):
            a, cell = kept["gates"][:, :, t], np.tanh(kept["cells"][:, :, t])
            i, f, o, g = (a[..., k * HIDDEN : (k + 1) * HIDDEN] for k in range(4))
            dh = dh + to_states[:, :, t]
            dc = dc + dh * o * (1 - cell**2)
            before = kept["cells"][:, :, t - 1] if t else np.zeros_like(dc)
            to_pre[:, :, t] = np.concatenate([dc * g * i * (1 - i), dc * before * f * (1 - f), dh * cell * o * (1 - o), dc * i * (1 - g**2)], axis=2)
            dc = dc * f
            dh = to_pre[:, :, t] @ self.own.transpose(0, 2, 1)
        flat, before = to_pre.reshape(2, -1, 4 * HIDDEN), np.concatenate([np.zeros_like(kept["states"][:, :, :1]), kept["states"][:, :, :-1]], axis=2).reshape(2, -1, HIDDEN)
        to_letters, seen = np.zeros_like(self.letters), kept["both"].reshape(2, -1)
        for d in (0, 1):
            np.add.at(to_letters, seen[d], flat[d] @ self.given[d].T)
        to_given = np.stack([self.letters[seen[d]].T @ flat[d] for d in (0, 1)])
        slopes = [to_letters, to_given, before.transpose(0, 2, 1) @ flat, flat.sum(axis=1), to_out, slope.sum(axis=(0, 1)), np.where(FORBIDDEN, 0, to_moves / n), to_start / n]
        return float((whole.sum() - gold) / n), slopes

    def fields(self) -> list[np.ndarray]:
        return [self.letters, self.given, self.own, self.bias, self.out, self.out_bias, self.moves, self.start]

    def decode(self, texts: list[str]) -> list[list[tuple[int, int, int, float]]]:
        """(kind, start, end, score) of the spans on the best path of each text; the score is the margin over "outside"."""
        out: list[list[tuple[int, int, int, float]]] = []
        for at in range(0, len(texts), AT_ONCE):
            some = texts[at : at + AT_ONCE]
            codes, sizes = batch_of(some)
            scores, _ = self.read(codes, sizes)
            moves, best, back = self.transitions(), self.start + scores[:, 0], []
            for t in range(1, codes.shape[1]):
                each = best[:, :, None] + moves
                back.append(np.where((t < sizes)[:, None], each.argmax(axis=1), np.arange(LABELS)))
                best = np.where((t < sizes)[:, None], each.max(axis=1) + scores[:, t], best)
            paths = np.empty(codes.shape, np.int64)
            paths[:, -1] = best.argmax(axis=1)
            for t in range(codes.shape[1] - 1, 0, -1):
                paths[:, t - 1] = np.take_along_axis(back[t - 1], paths[:, t, None], axis=1)[:, 0]
            for path, row, size in zip(paths, scores, sizes, strict=True):
                spans, places = [], np.flatnonzero(path[:size])
                for p in places.tolist():
                    kind, gain = (int(path[p]) - 1) // 2, float(row[p, path[p]] - row[p, 0])
                    if spans and spans[-1][2] == p and spans[-1][0] == kind and path[p] % 2 == 0:
                        spans[-1] = (kind, spans[-1][1], p + 1, spans[-1][3] + gain)
                    else:
                        spans.append((kind, p, p + 1, gain))
                out.append(spans)
        return out


# --- labelled spans: fixed values, and the rules that render them

TITLES = {0: ["email", "mail", "write to", "contact", "e-mail:", "an", "courriel", ""], 1: ["ip", "host", "from", "server", "address", ""], 2: ["card", "visa", "Karte", "pay with", "tarjeta", "no.", ""], 3: ["tel", "phone", "call", "Tel.:", "fax", "mobile", "Telefon", "tél.", "teléfono", "ring"]}
ENDINGS = ["com", "org", "net", "de", "fr", "es", "co.uk", "io", "test"]
ATS = ["@", "@", " [at] ", "[at]", " (at) ", "(at)", " {at} ", "<at>", " at ", " @ ", " AT "]
FULL_STOPS = [".", ".", " [dot] ", "[dot]", " (dot) ", "(dot)", " dot ", "[.]", "(.)", " . "]
GAPS = [" ", "-", "", ".", "/", "·", "–", " ", "  ", " - "]


def word(rng: random.Random) -> str:
    letters = "eeeetaaoinshrdlucmfwypvbgkjqxzéèäüñçß"
    w = "".join(rng.choice(letters) for _ in range(rng.randint(1, 9)))
    return w.capitalize() if rng.random() < 0.2 else w.upper() if rng.random() < 0.03 else w


def name(rng: random.Random) -> str:
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))


def number(rng: random.Random, n: int) -> str:
    return "".join(rng.choice("0123456789") for _ in range(n))


def email_example(rng: random.Random) -> str:
    at, stop = rng.choice(ATS), rng.choice(FULL_STOPS)
    if at.strip().lower() == "at":
        stop = " dot " if at == " at " else " DOT " if rng.random() < 0.5 else " dot "
    local = name(rng) + rng.choice(["", "", ".", "_", stop]) + rng.choice([name(rng), number(rng, rng.randint(1, 3))])
    host = stop.join([name(rng) + rng.choice(["", "", number(rng, 1), "-" + name(rng)]) for _ in range(rng.choice([1, 1, 2]))] + [rng.choice(ENDINGS)])
    return local + at + host


def ip_example(rng: random.Random) -> str:
    if rng.random() < 0.25:
        groups = [f"{rng.randrange(65536):x}" for _ in range(8)]
        if rng.random() < 0.6:
            cut = rng.randint(1, 5)
            return ":".join(groups[:cut]) + "::" + ":".join(groups[cut + 2 : 8])
        return ":".join(groups)
    return rng.choice([".", ".", "[.]", "(.)", " . ", " dot ", "[dot]", "(dot)", " [.] "]).join(str(rng.randrange(256)) for _ in range(4))


def card_example(rng: random.Random) -> str:
    digits, gap = number(rng, rng.choice([13, 15, 16, 16, 16, 19])), rng.choice(GAPS)
    return gap.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def phone_example(rng: random.Random) -> str:
    area, rest = number(rng, 3), number(rng, 3) + rng.choice(GAPS[:8]) + number(rng, 4)
    gap = rng.choice(GAPS[:8])
    return rng.choice([
        f"({area}) {rest}", f"{area}{gap or '-'}{rest}", f"00{rng.randint(1, 99)} {number(rng, 2)} {number(rng, 7)}", f"0{number(rng, 2)}/{number(rng, 7)}", f"0{number(rng, 3)} {number(rng, 3)} {number(rng, 3)}",
        f"+{rng.randint(1, 99)} ({area}) {rest}", f"+{rng.randint(1, 99)}/{area}/{number(rng, 6)}", f"+{rng.randint(1, 99)} {area}–{number(rng, 3)}–{number(rng, 3)}", f"1-{area}-{number(rng, 3)}-{number(rng, 4)}", f"0{rng.randint(1, 9)} {' '.join(number(rng, 2) for _ in range(4))}",
    ])


def plain_example(rng: random.Random) -> str:
    """Text with anchors that is no personal data."""
    year, month, day = rng.randint(1800, 2099), rng.randint(1, 12), rng.randint(1, 28)
    return rng.choice([
        f"{year}-{month:02}-{day:02}", f"{day}.{month}.{year}", f"{month}/{day}/{year}", f"{year}–{year + 3}", f"{rng.randint(0, 23)}:{day:02}:{month:02}", f"v{month}.{day}.{rng.randint(0, 9)}", f"{rng.randint(1, 999)},{number(rng, 3)}.{number(rng, 2)}",
        f"{rng.randint(1, 99)}%", f"page {day} of {year}", f'token = "{"".join(rng.choice("0123456789abcdef") for _ in range(40))}"', f"{name(rng).upper()[:2]}-{number(rng, 5)}-{number(rng, 3)}", f"@{name(rng)}", f"{name(rng)}@{name(rng)}", f"{name(rng)} @ {day}",
        f"no. {number(rng, rng.randint(4, 12))}", f"{number(rng, rng.randint(1, 8))}", "at the dot", f"the dot {name(rng)} at {name(rng)}", f"one dot {name(rng)}", f"{name(rng)} [at] {name(rng)}", f"ISBN 978-{number(rng, 1)}-{number(rng, 2)}-{number(rng, 6)}-{number(rng, 1)}",
        f"{number(rng, 5)} {number(rng, 5)}", f"x{number(rng, 2)}", f"{name(rng)}.{name(rng)}.com", f"#{number(rng, 6)}", f"{number(rng, 3)} {number(rng, 3)} EUR", f"{day}.{month}", f"§ {day}.{month}.{rng.randint(1, 9)}", f"{number(rng, rng.randint(20, 40))}",
    ])


def examples(n: int, seed: int) -> list[tuple[str, list[Span]]]:
    """n labelled texts of up to WIDTH characters: a cut through words with one or two marked or harmless pieces."""
    rng, made = random.Random(seed), (email_example, ip_example, card_example, phone_example)
    out = []
    for _ in range(n):
        text, spans = " ".join(word(rng) for _ in range(rng.randint(0, 8))), []
        for _ in range(rng.choice([1, 1, 2])):
            text += rng.choice([" ", " ", " ", ", ", ". ", "\n", ".", "(", ": ", " | ", '"', ""]) if text else ""
            if rng.random() < 0.6:
                kind = rng.randrange(4)
                cue = rng.choice(TITLES[kind])
                text += f"{cue} " if cue and rng.random() < 0.5 else ""
                piece = made[kind](rng)
                if text[-1:].isalnum():
                    text += " "
                spans.append((kind, len(text), len(text) + len(piece)))
                text += piece
            else:
                text += (" " if text[-1:].isalnum() else "") + plain_example(rng)
            text += rng.choice([" ", " ", ", ", ". ", ".", ") ", '" ', "\n", ""])
            tail = " ".join(word(rng) for _ in range(rng.randint(0, 6)))
            text += ("" if text[-1:].isspace() or not tail else " ") + tail
        cut = rng.randint(0, max(0, len(text) - WIDTH)) if rng.random() < 0.7 else 0
        text = text[cut : cut + WIDTH]
        spans = [(k, max(0, a - cut), min(len(text), b - cut)) for k, a, b in spans]
        out.append((text, [s for s in spans if s[1] < s[2]]))
    return out


def labels_of(spans: list[Span], width: int) -> np.ndarray:
    out = np.zeros(width, np.int64)
    for kind, a, b in spans:
        out[a:b] = 2 + 2 * kind
        out[a] = 1 + 2 * kind
    return out


@lru_cache(maxsize=2)
def train(rows: int = 6000, epochs: int = 6, seed: int = 0, rate: float = 0.01) -> Network:
    """The network from `rows` rendered examples, by Adam. It depends on nothing else, so a session trains it once."""
    found, rng, model = examples(rows, seed), np.random.default_rng(seed), Network.fresh(seed)
    found.sort(key=lambda x: len(x[0]))
    first, second, steps = [np.zeros_like(f) for f in model.fields()], [np.zeros_like(f) for f in model.fields()], 0
    batches = [found[i : i + 64] for i in range(0, len(found), 64)]
    for epoch in range(epochs):
        for b in rng.permutation(len(batches)):
            rows_ = [x for x in batches[b] if x[0]]
            codes, sizes = batch_of([t for t, _ in rows_])
            _, slopes = model.loss(codes, sizes, np.stack([labels_of(s, codes.shape[1]) for _, s in rows_]))
            norm = float(np.sqrt(sum((s**2).sum() for s in slopes)))
            steps += 1
            pace = rate * (1 - epoch / epochs) * (1 - 0.999**steps) ** 0.5 / (1 - 0.9**steps)
            for field, slope, m, v in zip(model.fields(), slopes, first, second, strict=True):
                slope = slope * min(1.0, 5 / max(norm, 1e-9))
                m += 0.1 * (slope - m)
                v += 0.001 * (slope**2 - v)
                field -= (pace * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
    return model


# --- windows of a text, and their reconciliation

ANCHORS = re.compile(ANCHOR)


#: Words of addresses, and what lies between two of them where it is a dot or an at sign; runs of what numbers are written with; zones.
TOKENS = re.compile(r"[a-z0-9_%+-]+", re.I)
SIGNS = re.compile(rf"(?:{DOT_SIGN})|({AT_SIGN})", re.I)
SPREAD = re.compile(rf"[0-9 \u00a0\u2009./\u00b7\u2013()+-]{{{REACH},}}")
ZONE = re.compile(r":[0-9A-Fa-f.]*%\S+")
AT = re.compile(AT_SIGN, re.I)


def addresses(text: str) -> list[tuple[int, int]]:
    """The widest places of loosely written addresses: words joined by dots around an at sign. In one pass over the words."""
    if not AT.search(text):
        return []
    words = [m.span() for m in TOKENS.finditer(text)]
    n = len(words)
    # the word that a sign behind word i leads to: the next, or the one behind a spelled sign
    dots: list[list[int]] = [[] for _ in range(n)]
    ats: list[tuple[int, int]] = []
    for i in range(n):
        for k in (i + 1, i + 2):
            if k >= n or words[k][0] - words[i][1] > 9:
                break
            m = SIGNS.fullmatch(text, words[i][1], words[k][0])
            if m and m[1] is None:
                dots[i].append(k)
            elif m:
                ats.append((i, k))
    if not ats:
        return []
    begin, end = [a for a, _ in words], [b for _, b in words]
    for i in range(n):
        for k in dots[i]:
            begin[k] = min(begin[k], begin[i])
    for i in range(n - 1, -1, -1):
        for k in dots[i]:
            end[i] = max(end[i], end[k])
    return [(begin[i], end[k]) for i, k in ats if dots[k]]


def reaches(text: str) -> list[tuple[int, int]]:
    """Places (start, end), ascending, outside of which no span of any form can lie: the anchors with REACH around them, and whole forms that reach further."""
    out = [m.span() for m in ANCHORS.finditer(text)]
    if out:
        out += addresses(text)
        out += [m.span() for m in SPREAD.finditer(text) if any(c in "0123456789" for c in m.group())]
        out += [m.span() for m in ZONE.finditer(text)]
    return sorted((max(0, a - REACH), min(len(text), b + REACH)) for a, b in out)


def windows(text: str) -> list[tuple[int, int]]:
    """Windows (start, end) over all that a span could cover, each of WIDTH at most."""
    out: list[tuple[int, int]] = []
    start = end = -1
    for a, b in reaches(text):
        if a <= end:
            end = max(end, b)
        else:
            out += cut(start, end)
            start, end = a, b
    return out + cut(start, end)


def cut(start: int, end: int) -> list[tuple[int, int]]:
    if start < 0:
        return []
    last = max(start, end - WIDTH)
    return [(a, min(end, a + WIDTH)) for a in [*range(start, last, STRIDE), last]]


def reconciled(found: list[tuple[int, int, int, float]]) -> list[Span]:
    """Pieces of a kind that overlap or meet in windows are one span; of overlapping kinds the set with the highest total score stays."""
    joined: list[list] = []
    for kind in range(len(KINDS)):
        mine: list[list] = []
        for k, a, b, score in sorted(x for x in found if x[0] == kind):
            if mine and a < mine[-1][2]:
                mine[-1][2], mine[-1][3] = max(mine[-1][2], b), max(mine[-1][3], score)
            else:
                mine.append([k, a, b, score])
        joined += mine
    joined.sort(key=lambda x: (x[2], x[1], x[0]))
    ends, best, taken = [x[2] for x in joined], [0.0], []
    for k, (_, a, _, score) in enumerate(joined):
        upto = bisect_right(ends, a, 0, k)
        taken.append((best[upto] + score > best[-1], upto))
        best.append(max(best[-1], best[upto] + score))
    out, k = [], len(joined)
    while k:
        yes, upto = taken[k - 1]
        if yes:
            out.append(tuple(joined[k - 1][:3]))
        k = upto if yes else k - 1
    return sorted(out)


def all_spans(texts: list[str], model: Network) -> list[tuple[list[Span], list[Span]]]:
    """(base spans, all spans) of each text, by kind and start. Equal windows are read once."""
    cuts = [windows(t) for t in texts]
    pieces = sorted({t[a:b] for t, own in zip(texts, cuts, strict=True) for a, b in own}, key=len)
    read = dict(zip(pieces, model.decode(pieces), strict=True))
    out = []
    for text, own in zip(texts, cuts, strict=True):
        base = base_spans(text)
        found = reconciled([(k, a + s, a + e, score) for a, b in own for k, s, e, score in read[text[a:b]]])
        taken, added = sorted((a, b) for _, a, b in base), set()
        tops = np.maximum.accumulate([b for _, b in taken]).tolist() if taken else []
        for kind, a, b in widened(found, text):
            a, b = trimmed(kind, a, b, text)
            before = bisect_right(taken, (b - 1, len(text) + 1)) if a < b else 0
            if a < b and fits(kind, text[a:b]) and not (before and tops[before - 1] > a):
                added.add((kind, a, b))
        kept: list[Span] = []
        for s in sorted(added, key=lambda s: (s[1], -s[2], s[0])):  # widened spans may meet
            if not kept or s[1] >= kept[-1][2]:
                kept.append(s)
        out.append((base, sorted(base + kept)))
    return out


def find(df: DataFrame, model: Network, text: str = "text", base: str = "base", out: str = "spans") -> DataFrame:
    """df with the arrays `base` and `out` of (kind, start, end), by kind as in KINDS, then start."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    told = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans]

    @arrow_udf(f"struct<base:{SPANS},spans:{SPANS}>")
    def spans_of(texts: pa.Array) -> pa.Array:
        made = []
        for at in range(0, len(texts), 1024):
            some = [t or "" for t in texts.slice(at, 1024).to_pylist()]
            made += [{"base": told(b), "spans": told(s)} for b, s in all_spans(some, shared.value)]
        return pa.array(made, pa.struct([("base", kind), ("spans", kind)]))

    anchored = F.when(text_of(text).rlike(ANCHOR), F.col(text))
    made = df.withColumn("made_", spans_of(anchored))
    return made.select(*[c for c in df.columns if c not in (base, out)], F.col("made_.base").alias(base), F.col("made_.spans").alias(out))


def redact(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """df with each span of the text replaced by its kind in angle brackets, from the last to the first."""
    last_first = F.reverse(F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))))
    # base spans of two kinds may overlap: one that reaches into what is replaced already is cut there
    state = F.struct(text_of(text).alias("t"), F.char_length(text_of(text)).alias("upto"))
    put = lambda acc, s: F.struct(F.overlay(acc["t"], F.concat(F.lit("<"), s["kind"], F.lit(">")), s["start"] + 1, F.greatest(F.lit(0), F.least(s["end"], acc["upto"]) - s["start"])).alias("t"), s["start"].alias("upto"))
    return df.withColumn(text, F.when(F.col(text).isNotNull(), F.aggregate(last_first, state, put)["t"]))


def listed(spans: str) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document: doc_id, the number of base spans of each kind, base_sha256, and all spans."""
    found = find(table(spark, sf_dir, "documents").select("doc_id", "text"), train())
    counts = [F.size(F.filter("base.kind", lambda own: own == k)).cast("long").alias(f"n_{k}") for k in KINDS]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"), listed("spans").alias("spans"))
