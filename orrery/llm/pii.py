"""Personal data: exact patterns, and a linear-chain conditional random field beside them.

The base finds emails, IPs, cards and phones by pattern and check (octets, Luhn, digit
counts). The field reads word shapes: it is trained by gradient on a small labelled
table, and decoded by Viterbi in numpy batches. A span must hold a digit or an at sign in each
of its words, so words without one are outside; those within ``REACH`` words of one are in the
chains as context, and more of them would change no label's own or neighbouring shapes. Spans of the field that touch no base
span, and could be of their kind, are added; base spans always stay.

Patterns are written so that no text, however long or uniform, costs more than linear
time. Edge cases: null and empty texts have no spans; repeated rows give repeated rows;
an empty table gives an empty result; other columns are not looked at, and ``redact``
returns them as they were.
"""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import parts

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{b}-{k}" for k in KINDS for b in "BI"))
REACH, WIDTH = 3, 1024
SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    return not sum(sum(divmod(2 * int(d), 10)) if k % 2 else int(d) for k, d in enumerate(reversed(digits))) % 10


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def emails(text: str) -> list[Span]:
    """Leftmost matches: from each at sign as far left as the local part reaches."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and LOCAL.match(text, start - 1):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            found.append(("email", start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str) -> list[Span]:
    spans = emails(text) if "@" in text else []
    spans += [("ip", *m.span()) for m in IP.finditer(text) if octets(m.group().split("."))]
    for m in CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            spans.append(("card", *m.span()))
    if "+" in text:
        spans += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m.group()) <= 15]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def features(word: str) -> tuple[int, ...]:
    """Hashed word-shape features; a set of them stands for the word."""
    core = word.strip("!,;:.?*#$%&\"'")
    kind = re.sub(r"[^\W\d_]", "x", re.sub(r"[0-9]", "9", core))
    digits = re.sub(r"[^0-9]", "", core)
    parts = core.split(".")
    said = [
        "s=" + re.sub(r"(.)\1+", r"\1", kind),
        f"n={min(len(digits), 20)}",
        "w=" + re.sub(r"(x)\1+", r"\1", kind),
        f"f={core[:1] if not core[:1].isalnum() else 'a'}{'@' in core}{core.count('.')}",
        f"d={bool(digits)}{len(digits) == len(core)}",
    ]
    if 14 <= len(digits) <= 19 and not core.strip("0123456789- "):
        said.append(f"luhn={luhn(digits)}")
    if len(parts) == 4 and all(p.isdigit() for p in parts):
        said.append(f"octets={octets(parts)}")
    return tuple(zlib.crc32(x.encode()) % WIDTH for x in said)


def labelled_table(rows: int = 300, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small training table: a rule fills templates with made-up data and look-alikes."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    plain = lambda: "".join(r.choice("aeiou" if k % 2 else "bdlmnrst") for k in range(r.randint(2, 9)))
    tail = lambda: r.choice(["", "", "", ".", ",", "!!", "%%%", "***"])

    def card() -> str:
        head = digits(15)
        return next(head + d for d in "0123456789" if luhn(head + d))

    def miss() -> str:
        return (c := card())[:-1] + str((int(c[-1]) + r.randint(1, 9)) % 10)

    def one() -> list[tuple[str, str]]:
        t = tail()
        at = f"{plain()}.{digits(2)}{r.choice(['[at]', '(at)'])}{plain()}{r.choice(['', '.example'])}.{r.choice(['com', 'org'])}"
        return r.choice([
            lambda: [(f"{plain()}.{digits(2)}@{plain()}.example.com{t}", "B-email")],
            lambda: [(at + t, "B-email")],
            lambda: [(".".join(str(r.randint(0, 255)) for _ in range(4)) + t, "B-ip")],
            lambda: [(card() + t, "B-card")],
            lambda: [(x + t, "I-card" if k else "B-card") for k, x in enumerate(re.findall("....", card()))],
            lambda: [(f"+1{t}", "B-phone"), (f"({digits(3)}){t}", "I-phone"), (f"{digits(3)}-{digits(4)}{t}", "I-phone")],
            lambda: [(f"({digits(3)}){t}", "B-phone"), (f"{digits(3)}-{digits(4)}{t}", "I-phone")],
            lambda: [(f"{digits(3)}-{digits(3)}-{digits(4)}{t}", "B-phone")],
            # look-alikes that are not personal data
            lambda: [(miss() + t, "O")],
            lambda: [(f"{r.randint(256, 999)}.{r.randint(0, 255)}.{r.randint(256, 999)}.{r.randint(0, 255)}{t}", "O")],
            lambda: [('"' + hashlib.sha1(plain().encode()).hexdigest() + '"' + t, "O")],
            lambda: [(f"{digits(r.randint(1, 8))}{t}", "O")],
            lambda: [(f"{digits(1)}.{digits(1)}{t}", "O")],
            lambda: [(f"{digits(4)}-{digits(2)}-{digits(2)}{t}", "O")],
            lambda: [(f"{digits(2)}:{digits(2)}{t}", "O")],
            lambda: [(f"@{plain()}{t}", "O")],
            lambda: [(f"{plain()}{digits(2)}{t}", "O")],
            lambda: [(f"${digits(3)}.{digits(2)}{t}", "O")],
        ])()

    some = lambda: [(plain() + tail(), "O") for _ in range(r.randint(1, 4))]
    return [some() + one() + (some() + one() if r.random() < 0.3 else []) + some() for _ in range(rows)]


def _padded(chains: list[list[tuple[int, ...]]]) -> np.ndarray:
    """Feature ids by chain, place and feature; WIDTH is the feature that is not there."""
    longest = max(map(len, chains))
    out = np.full((len(chains), longest, 8), WIDTH, np.int32)
    for i, chain in enumerate(chains):
        for t, ids in enumerate(chain):
            out[i, t, : len(ids)] = ids
    return out


class Field:
    """Weights for a word's own shape and its neighbours' shapes, and for label pairs."""

    def __init__(self, own: np.ndarray, moves: np.ndarray):
        self.own, self.moves = own, moves  # (3, WIDTH + 1, labels), (labels, labels)

    def worth(self, ids: np.ndarray) -> np.ndarray:
        own, before, after = (w[ids].sum(2) for w in self.own)
        own[:, 1:] += before[:, :-1]
        own[:, :-1] += after[:, 1:]
        return own

    def decode(self, chains: list[list[tuple[int, ...]]]) -> list[np.ndarray]:
        """Best labels of each chain, for all chains of about one length at once."""
        out: list = [None] * len(chains)
        by: dict[int, list[int]] = {}
        for i, chain in enumerate(chains):
            by.setdefault(len(chain).bit_length(), []).append(i)
        for bits, members in by.items():
            for lo in range(0, len(members), step := max(1, (1 << 17) >> bits)):
                some = members[lo : lo + step]
                worth = self.worth(_padded([chains[i] for i in some]))
                lengths = np.array([len(chains[i]) for i in some])
                best, came = worth[:, 0] + np.where(LEGAL_START, 0, -1e9), []
                for t in range(1, worth.shape[1]):
                    through = best[:, :, None] + self.moves
                    came.append(through.argmax(1))
                    alive = (t < lengths)[:, None]
                    best = np.where(alive, through.max(1) + worth[:, t], best)
                labels = np.empty(worth.shape[:2], np.int8)
                now = best.argmax(1)
                for t in range(worth.shape[1] - 1, -1, -1):
                    labels[:, t] = now
                    if t:
                        now = np.where(t < lengths, came[t - 1][np.arange(len(some)), now], now)
                for i, row, n in zip(some, labels, lengths, strict=True):
                    out[i] = row[:n]
        return out


LEGAL_START = np.array([not x.startswith("I") for x in LABELS])
#: An inside label follows a label of its own kind only.
LEGAL = np.array([[not b.startswith("I") or a[1:] == b[1:] for b in LABELS] for a in LABELS])


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis, keepdims=True))).squeeze(axis)


def train(table: list[list[tuple[str, str]]], steps: int = 60, rate: float = 0.15, ridge: float = 1e-3) -> Field:
    """Maximum likelihood by forward-backward and Adam, on the whole table at each step."""
    ids = _padded([[features(w) for w, _ in row] for row in table])
    gold = np.zeros(ids.shape[:2], np.int64)
    real = np.zeros(ids.shape[:2], bool)
    for i, row in enumerate(table):
        gold[i, : len(row)] = [LABELS.index(y) for _, y in row]
        real[i, : len(row)] = True
    k, n, longest = len(LABELS), len(table), ids.shape[1]
    barred = np.where(LEGAL, 0.0, -1e4)
    field = Field(np.zeros((3, WIDTH + 1, k)), np.zeros((k, k)))
    memory = [(np.zeros_like(w), np.zeros_like(w)) for w in (field.own, field.moves)]
    ends = real.sum(1) - 1
    for step in range(1, steps + 1):
        worth, moves = field.worth(ids), field.moves + barred
        ahead = np.zeros((n, longest, k))
        ahead[:, 0] = worth[:, 0] + np.where(LEGAL_START, 0, -1e4)
        for t in range(1, longest):
            ahead[:, t] = _log_sum(ahead[:, t - 1][:, :, None] + moves, 1) + worth[:, t]
        back = np.zeros((n, longest, k))
        for t in range(longest - 2, -1, -1):
            come = _log_sum(moves + (worth[:, t + 1] + back[:, t + 1])[:, None, :], 2)
            back[:, t] = np.where((t < ends)[:, None], come, 0.0)
        total = _log_sum(ahead[np.arange(n), ends], 1)
        chance = np.exp(ahead + back - total[:, None, None]) * real[:, :, None]
        wrong = chance
        wrong[np.arange(n)[:, None], np.arange(longest), gold] -= real
        slope = np.zeros_like(field.own)
        for side, shift in enumerate((0, 1, -1)):
            for f in range(ids.shape[2]):
                if shift == 0:
                    np.add.at(slope[0], ids[:, :, f].ravel(), wrong.reshape(-1, k))
                elif shift == 1:  # the word before
                    np.add.at(slope[1], ids[:, :-1, f].ravel(), wrong[:, 1:].reshape(-1, k))
                else:
                    np.add.at(slope[2], ids[:, 1:, f].ravel(), wrong[:, :-1].reshape(-1, k))
        slope[:, WIDTH] = 0
        turn = np.zeros((k, k))
        for t in range(1, longest):
            pair = np.exp(ahead[:, t - 1][:, :, None] + moves + (worth[:, t] + back[:, t])[:, None, :] - total[:, None, None])
            turn += (pair * real[:, t][:, None, None]).sum(0)
            np.add.at(turn, (gold[:, t - 1][real[:, t]], gold[:, t][real[:, t]]), -1.0)
        for w, g, (m, v) in zip((field.own, field.moves), (slope, turn), memory, strict=True):
            g = g / n + ridge * w
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return Field(field.own.astype(np.float32), (field.moves + np.where(LEGAL, 0.0, -1e9)).astype(np.float32))


@lru_cache(1)
def default_field() -> Field:
    return train(labelled_table())


TRIGGER = re.compile(r"[0-9@]|[\[(]at[\])]")
WORD = re.compile(r"\S+")
AROUND = re.compile(r"\S+\s*")


def chains_of(text: str) -> list[list[tuple[int, int]]]:
    """Runs of word spans within REACH words of a word that holds a trigger."""
    runs: list[list[tuple[int, int]]] = []
    m, done = TRIGGER.search(text), 0
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        lead: list[tuple[int, int]] = []
        at = start
        for _ in range(REACH):
            end = at
            while end > done and text[end - 1].isspace():
                end -= 1
            at = end
            while at > done and not text[at - 1].isspace():
                at -= 1
            if at == end:
                break
            lead.append((at, end))
        run, rest, at = lead[::-1], REACH + 1, start
        while rest and (w := WORD.search(text, at)):
            run.append(w.span())
            at = w.end()
            rest = REACH if TRIGGER.search(text, w.start(), w.end()) else rest - 1
        if runs and lead[-1:] and runs[-1][-1][1] == lead[-1][0]:
            runs[-1] += run
        else:
            runs.append(run)
        done = at
        m = TRIGGER.search(text, done)
    return runs


EDGE = re.compile(r"^[^\w+(]+|[^\w)]+$")


def found_spans(text: str, runs: list[list[tuple[int, int]]], labels: list[np.ndarray]) -> list[Span]:
    spans: list[Span] = []
    for run, marks in zip(runs, labels, strict=True):
        for (start, end), mark in zip(run, marks.tolist(), strict=True):
            name = LABELS[mark]
            if name[0] == "B":
                spans.append((name[2:], start, end))
            elif name[0] == "I" and spans:
                spans[-1] = (spans[-1][0], spans[-1][1], end)
    out = []
    for kind, start, end in spans:
        said = text[start:end]
        lead = len(said) - len(EDGE.sub("", said, 1)) if said[:1] and EDGE.match(said) else 0
        tail = re.search(r"[^\w)]+$", said[lead:])
        out.append((kind, start + lead, end - len(tail.group()) if tail else end))
    return [s for s in out if s[1] < s[2]]


AT = re.compile(r"[^\s@]+(?:@|[\[(]at[\])])[^\s@]+\.[^\s@]+")
NUMBER = re.compile(r"\+?[0-9 ().-]+")


def plausible(kind: str, said: str) -> bool:
    """What a span must hold at least to be of its kind; the field proposes, this disposes."""
    digits = sum(c.isdigit() for c in said)
    if kind == "email":
        return AT.fullmatch(said) is not None
    if NUMBER.fullmatch(said) is None:
        return False
    if kind == "ip":
        parts = said.split(".")
        return len(parts) == 4 and all(p.isdigit() for p in parts) and octets(parts)
    return 14 <= digits <= 19 if kind == "card" else 7 <= digits <= 15


def detect(texts: list[str], field: Field) -> Iterator[tuple[list[Span], list[Span]]]:
    """For each text its base spans and the spans that the field adds."""
    known: dict[str, tuple[int, ...]] = {}
    runs, chains = [], []
    for text in texts:
        runs.append(chains_of(text))
        for run in runs[-1]:
            chain = []
            for start, end in run:
                word = text[start:end]
                if word not in known:
                    known[word] = features(word)
                chain.append(known[word])
            chains.append(chain)
    labels, at = field.decode(chains) if chains else [], 0
    for text, mine in zip(texts, runs, strict=True):
        base = base_spans(text)
        added = []
        for span in found_spans(text, mine, labels[at : at + len(mine)]) if mine else []:
            if all(span[2] <= b[1] or b[2] <= span[1] for b in base) and plausible(span[0], text[span[1] : span[2]]):
                added.append(span)
        at += len(mine)
        yield base, added


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2])))


def _rows(field: Field):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in parts(batches):
            out = []
            for doc, (base, added) in zip(batch["doc_id"].array, detect(list(batch["text"]), field), strict=True):
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                out.append((doc, *counts, hashlib.sha256(written(base).encode()).hexdigest(), written(base + added), len(added)))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"])

    return run


def find_pii(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows ``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added``; counts are of base spans."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return rows.mapInPandas(_rows(field or default_field()), SCHEMA)


def redact(docs: DataFrame, field: Field | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with every span of its texts replaced by its kind in brackets."""
    field = field or default_field()

    @F.pandas_udf("string")
    def clean(texts: pd.Series) -> pd.Series:
        out, some = [], (texts.iloc[at : at + 500] for at in range(0, len(texts), 500))
        for text, (base, added) in ((t, found) for few in some for t, found in zip(few, detect([t or "" for t in few], field), strict=True)):
            if text is None:
                out.append(None)
                continue
            kept, at = [], 0
            for kind, start, end in sorted(base + added, key=lambda s: (s[1], -s[2])):
                if start >= at:
                    kept += [text[at:start], f"[{kind.upper()}]"]
                at = max(at, end)
            out.append("".join([*kept, text[at:]]))
        return pd.Series(out, dtype=object)

    return docs.withColumn(text_col, clean(F.col(f"`{text_col}`")))
