"""Personal data: fixed patterns, and what a skip-chain conditional random field adds to them.

The patterns give the base spans. The field labels nodes as one of the kinds or as other: tokens with a digit or an @, where
neighbouring tokens of digits and signs count as one, and so do those of one base span. Neighbouring nodes form the chain; nodes that
repeat, or are similar (the same last seven digits, or the same letters and digits once case and punctuation are left out), are linked over
any distance by skip edges to one of them, which is a base span if there is one: two steps reach all. Base
spans are observed. Loopy message passing then carries their labels along both kinds of edges, so that an
entity that the patterns know in one place is found where it is written otherwise. Nodes of a kind with a
probability of ``sure`` or more become spans; neighbours of one kind join.

The field is learned by pseudo-likelihood, weights of nodes and of both kinds of edges together, from a sample of about ``bound``
documents. Their labels are those of the base spans. Each base span is also written once more below its document, in a form that
the patterns miss, and labelled as it; next to it stands the same form with other digits or letters, which nothing in the document
backs, labelled other. So the field learns that a form alone is no evidence, but a form with a twin is. Nodes without a label that
are similar to a labelled one are left out of learning.

What matches a pattern and fails its check for its value (an address part above 255, a sum of digits) is observed as other.

Defined results: null text is empty and has no span. Offsets count code points. Added spans overlap no base span; the
counts n_* are those of base spans. Rows that repeat give rows each; other columns of the input aren't returned.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)

#: The patterns, cut so that each reads a text once.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NOT_DIGIT = re.compile(r"[^0-9]")

TOKEN = re.compile(r"[^ \t-\r]*[0-9@][^ \t-\r]*")
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        total += x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x)
    return total % 10 == 0


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(kind, start, end) of the patterns, by kind and start, and the places of matches whose value failed a check."""
    found: list[Span] = []
    failed: list[tuple[int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((0, start, end))
        at = text.find("@", max(at + 1, end))
    for m in NUMBERS.finditer(text):
        if m[0].count(".") >= 3:
            parts, at = m[0].split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                stop = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in four):
                    found.append((1, at, stop))
                elif all(len(p) <= 3 for p in four):
                    failed.append((at, stop))
                at = stop + 1
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19:
                if luhn(digits):
                    found.append((2, *m.span()))
                else:
                    failed.append(m.span())
    if "+" in text:
        for m in PHONE.finditer(text):
            if 9 <= len(NOT_DIGIT.sub("", m[0])) <= 15:
                found.append((3, *m.span()))
    return found, failed


def shape(token: str, before: str) -> tuple[int, ...]:
    """What the weights see of a token: counts in few steps, signs, and whether the token before it is near and how it looks."""
    n = sum("0" <= c <= "9" for c in token)
    return (
        min(n, 2) if n < 5 else 3 + (n > 8) + (n > 12) + (n > 19),
        min(token.count("."), 4),
        min(token.count("@"), 2),
        int(token.startswith("+")) + 2 * int("(" in token),
        min(token.count("-"), 2),
        min(sum(c.isalpha() for c in token), 2),
        0 if not before else 1 + int(before.startswith("+")) + 2 * int("(" in before),
    )


WIDTHS = (7, 5, 3, 4, 3, 3, 5)
OFFSETS = np.append(0, np.cumsum(WIDTHS))


#: Tokens that join with the one before them.
NUMERIC = re.compile(r"[+(]*[0-9][0-9().+/-]*\Z")


def key(token: str) -> str:
    """Nodes with the same key are similar: their last seven digits, else their letters and digits."""
    digits = NOT_DIGIT.sub("", token)
    return digits[-7:] if len(digits) >= 7 and "@" not in token else "".join(c for c in token.lower() if c.isalnum())


class Tokens:
    """The nodes of a text: spans, shapes, observed labels (-1: open) and edges."""

    def __init__(self, text: str, found: list[Span], failed: list[tuple[int, int]]) -> None:
        bases = sorted((a, b) for _, a, b in found)
        self.spans: list[tuple[int, int]] = []
        self.near: list[bool] = []
        last, whole, joins, at = -2, False, False, 0
        for m in TOKEN.finditer(text):
            start, end = m.span()
            while end > start and (text[end - 1] in ".,;:!?|]}\"'" or (text[end - 1] == ")" and "(" not in m[0])):
                end -= 1
            if end == start:
                continue
            while at < len(bases) and bases[at][1] <= start:
                at += 1
            inside = at < len(bases) and bases[at][0] < end
            same = inside and self.spans and bases[at][0] < self.spans[-1][1]
            near = start - last <= 1
            numeric = NUMERIC.match(text[start:end]) is not None
            if same or (near and whole and joins and numeric and not inside):
                self.spans[-1] = (self.spans[-1][0], end)
            else:
                self.spans.append((start, end))
                self.near.append(near)
            last, whole, joins = m.end(), end == m.end(), numeric and not inside
        n = len(self.spans)
        parts = [text[a:b] for a, b in self.spans]
        self.shapes = [shape(t, parts[i - 1] if i and self.near[i] else "") for i, t in enumerate(parts)]
        self.keys = [key(t) for t in parts]
        self.label = np.full(n, -1)
        starts, ends = np.array([s for s, _ in self.spans]), np.array([e for _, e in self.spans])
        for kind, places in ((OTHER, failed), *((k, [(a, b) for x, a, b in found if x == k]) for k in range(OTHER))):
            for a, b in places:
                self.label[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b)] = kind
        self.chain = [(i - 1, i) for i in range(1, n) if self.near[i]]
        self.hub: dict[str, int] = {}
        for i, k in enumerate(self.keys):
            if k and (k not in self.hub or (0 <= self.label[i] < OTHER and not 0 <= self.label[self.hub[k]] < OTHER)):
                self.hub[k] = i
        chained = {*self.chain, *((j, i) for i, j in self.chain)}
        self.skip = [(self.hub[k], i) for i, k in enumerate(self.keys) if k and self.hub[k] != i and (self.hub[k], i) not in chained]


def _code(shape_: tuple[int, ...]) -> int:
    out = 0
    for x, w in zip(shape_, WIDTHS, strict=True):
        out = out * w + x
    return out


def _rows(codes: np.ndarray) -> np.ndarray:
    """One-hot rows of shape codes."""
    x = np.zeros((len(codes), OFFSETS[-1]))
    rest = codes.copy()
    for k in range(len(WIDTHS) - 1, -1, -1):
        x[np.arange(len(codes)), OFFSETS[k] + rest % WIDTHS[k]] = 1
        rest //= WIDTHS[k]
    return x


def altered(text: str, kind: int, draw: int, other: bool = False) -> str:
    """A span in one of the forms that the patterns miss; with ``other``, with other digits or letters."""
    if kind == 0:
        name, _, host = text.rpartition("@")
        name = "".join(chr(97 + (ord(c) - 84) % 26) if "a" <= c <= "z" else c for c in name) + "q" if other else name
        return (f"{name}[@]{host}", f"{name}(@){host}", f"<{name}>@<{host}>")[draw % 3]
    if other:
        text = re.sub("[0-9]", lambda m: str((3 * int(m[0]) + 1) % 10), text)
    if kind == 1:
        return text.replace(".", ("-", "[.]", ":")[draw % 3])
    d = NOT_DIGIT.sub("", text)
    if kind == 2:
        return (".", "/", "--")[draw % 3].join(d[k : k + 4] for k in range(0, len(d), 4))
    a, b, c = d[-10:-7], d[-7:-4], d[-4:]
    return (f"{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}.{b}.{c}", f"{b}-{c}", f"{a}/{b}{c}")[draw % 5]


def examples(text: str) -> Iterator[tuple[int, int, int, int, int]]:
    """For each labelled node of a text and of its base spans' other forms: shape code, labels of the node before, of the node after and of a similar one (-1: none known), and its own."""
    found, failed = base_spans(text)
    extra, truth = text, []
    for k, (kind, a, b) in enumerate(found):
        for other in (False, True):
            form = altered(text[a:b], kind, a + k, other)
            truth.append((OTHER if other else kind, len(extra) + 5, len(extra) + 5 + len(form)))
            extra += f"\nalso {form} ."
    if truth:
        found, failed = base_spans(extra)
    t = Tokens(extra, found, failed)
    label = t.label.copy()
    starts, ends = np.array([s for s, _ in t.spans]), np.array([e for _, e in t.spans])
    for kind, a, b in truth:
        at = slice(np.searchsorted(ends, a, side="right"), np.searchsorted(starts, b))
        label[at] = np.where(label[at] < 0, kind, label[at])
    labelled = {t.keys[i] for i in np.flatnonzero((label >= 0) & (label < OTHER))}
    for i in np.flatnonzero(label < 0):
        if t.keys[i] not in labelled:
            label[i] = OTHER
    before, after, twin = (np.full(len(label), -1) for _ in range(3))
    for i, j in t.chain:
        before[j], after[i] = label[i], label[j]
    for i, j in t.skip:
        twin[j] = label[i]
        if twin[i] < 0:
            twin[i] = label[j]
    for i in np.flatnonzero(label >= 0):
        yield _code(t.shapes[i]), int(before[i]), int(after[i]), int(twin[i]), int(label[i])


def fit(codes: np.ndarray, before: np.ndarray, after: np.ndarray, twin: np.ndarray, y: np.ndarray, many: np.ndarray, l2: float = 1e-6, rounds: int = 2000) -> dict:
    """Potentials of nodes, chain and skip edges that make the pseudo-likelihood of labelled nodes largest, by Adam."""
    x, share = _rows(codes), many / many.sum()
    w = {"token": np.zeros((OFFSETS[-1], OTHER + 1)), "chain": np.zeros((OTHER + 1, OTHER + 1)), "skip": np.zeros((OTHER + 1, OTHER + 1))}
    m, v = ({k: np.zeros_like(t) for k, t in w.items()} for _ in range(2))
    known = [np.flatnonzero(z >= 0) for z in (before, after, twin)]
    for step in range(1, rounds + 1):
        z = x @ w["token"]
        z[known[0]] += w["chain"][before[known[0]]]
        z[known[1]] += w["chain"][:, after[known[1]]].T
        z[known[2]] += w["skip"][twin[known[2]]]
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(y)), y] -= 1
        p *= share[:, None]
        g = {k: l2 * t for k, t in w.items()}
        g["token"] += x.T @ p
        np.add.at(g["chain"], before[known[0]], p[known[0]])
        back = np.zeros_like(w["chain"])
        np.add.at(back, after[known[1]], p[known[1]])
        g["chain"] += back.T
        near = np.zeros_like(w["skip"])
        np.add.at(near, twin[known[2]], p[known[2]])
        g["skip"] += (near + near.T) / 2
        for k, t in w.items():
            m[k] = 0.9 * m[k] + 0.1 * g[k]
            v[k] = 0.99 * v[k] + 0.01 * g[k] * g[k]
            t -= 0.1 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return w


def learn(docs: DataFrame, bound: int = 20_000) -> dict:
    """The field's potentials from about ``bound`` documents; what reaches the driver are counts of shapes and labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: dict[tuple[int, ...], int] = {}
        for batch in batches:
            for text in batch.column("text").to_pylist():
                for x in examples(text):
                    count[x] = count.get(x, 0) + 1
        yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in count], pa.int64()) for i in range(5)), pa.array(count.values(), pa.int64())], ["code", "before", "after", "twin", "y", "n"])

    there = max(1, docs.count())
    part = F.pmod(F.xxhash64(F.lit("pii"), "doc_id"), F.lit(1 << 30)) < int(min(1.0, bound / there) * (1 << 30))
    rows = docs.where(part & F.col("text").isNotNull()).select("text").mapInArrow(run, "code long, before long, after long, twin long, y long, n long")
    got = rows.groupBy("code", "before", "after", "twin", "y").agg(F.sum("n").alias("n")).toPandas().sort_values(["code", "before", "after", "twin", "y"])
    if not len(got):
        return {"token": np.zeros((OFFSETS[-1], OTHER + 1)), "chain": np.zeros((OTHER + 1, OTHER + 1)), "skip": np.zeros((OTHER + 1, OTHER + 1))}
    return fit(*(got[c].to_numpy() for c in ("code", "before", "after", "twin", "y", "n")))


def marginals(t: Tokens, model: dict, rounds: int = 500) -> np.ndarray:
    """Label probabilities of each node, by loopy message passing with damping, until messages stay (or after as many rounds as there are nodes and 20, or ``rounds``)."""
    node = _rows(np.array([_code(s) for s in t.shapes])) @ model["token"]
    node -= node.max(1, keepdims=True)
    known = np.flatnonzero(t.label >= 0)
    node[known] = -30
    node[known, t.label[known]] = 0
    edges = np.array(t.chain + t.skip, np.int64).reshape(-1, 2)
    kind = np.array([0] * len(t.chain) + [1] * len(t.skip), np.int64)
    table = np.exp(np.stack([model["chain"], model["skip"]]))[kind]
    source = np.concatenate([edges[:, 0], edges[:, 1]])
    target = np.concatenate([edges[:, 1], edges[:, 0]])
    table = np.concatenate([table, table.transpose(0, 2, 1)])
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    message = np.zeros((len(source), OTHER + 1))
    for _ in range(min(rounds, 20 + len(node)) if len(edges) else 0):
        belief = node.copy()
        np.add.at(belief, target, message)
        out = belief[source] - message[back]
        out = np.exp(out - out.max(1, keepdims=True))
        new = np.log(np.einsum("ea,eab->eb", out, table) + 1e-30)
        new -= new.max(1, keepdims=True)
        if np.abs(new - message).max() < 1e-4:
            break
        message = 0.5 * message + 0.5 * new
    np.add.at(node, target, message)
    p = np.exp(node - node.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


def added(text: str, found: list[Span], failed: list[tuple[int, int]], model: dict, sure: float) -> list[Span]:
    """Spans that the field adds to the base spans."""
    if not TOKEN.search(text):
        return []
    t = Tokens(text, found, failed)
    if (t.label >= 0).all():
        return []
    p = marginals(t, model)
    best = p.argmax(1)
    pick = (t.label < 0) & (best != OTHER) & (p.max(1) >= sure)
    out: list[Span] = []
    last = -2
    for i in np.flatnonzero(pick).tolist():
        start, end = t.spans[i]
        if out and last == i - 1 and t.near[i] and out[-1][0] == best[i]:
            out[-1] = (out[-1][0], out[-1][1], end)
        else:
            out.append((int(best[i]), start, end))
        last = i
    return out


def _joined(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: dict, sure: float = 0.9) -> DataFrame:
    """doc_id, counts of base spans, base_sha256, and spans (base and added) of each document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            counts, shas, all_ = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                found, failed = base_spans(text)
                more = added(text, found, failed, m, sure)
                counts.append([sum(x[0] == k for x in found) for k in range(OTHER)])
                shas.append(hashlib.sha256(_joined(found).encode()).hexdigest())
                all_.append(_joined(sorted(found + more)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(OTHER)), pa.array(shas, pa.string()), pa.array(all_, pa.string())],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def personal_data(docs: DataFrame) -> DataFrame:
    """Learn the field from a sample of the documents, then label all."""
    return detect(docs, learn(docs))
