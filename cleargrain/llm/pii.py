"""Personal data by patterns and by a semi-Markov conditional random field.

Base spans come from four patterns with checks. The method reads the places of a text that hold digits or at signs, cut into tokens: every run
of tokens that could be a whole e-mail address, IP address, card or phone number is a candidate segment, and features of the whole span (its
digits, checksum, groups, separators, its first and last token and what stands beside it) score it for each type. Dynamic programming over
segments of bounded length, single tokens outside and transitions between types chooses boundaries and types together. The weights
are fitted to likelihood on a bounded sample of places whose base spans are known, and on variants of those spans with other
separators, so that forms are found which the patterns miss.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, share, shared, small_batches
from cleargrain.llm.langid import sample_rows

KINDS = ("email", "ip", "card", "phone")

# The patterns of base spans. Guards before digits and possessive repeats change no match, only the time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: Tokens of a segment, characters of it, and characters on either side of a digit or at sign that are looked at.
LONGEST, WIDEST, REACH = 16, 64, 48
#: Tokens of a place and places of a document that fitting reads at most.
FIT_TOKENS, FIT_PLACES = 48, 8

CORE = re.compile(r"[0-9]+|@|[(\[]at[)\]]")
TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.S)
#: Marks that a segment may hold besides letters, digits and spaces.
INSIDE = frozenset("@._%+-()[]/")
AT = ("@", "(at)", "[at]", " at ")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, from each at sign outward, so that long runs without one cost nothing."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        done = domain.end() if domain else at + 1
        if domain:
            out.append((start, done))
        at = text.find("@", done)
    return out


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the base patterns' matches that pass their checks, by kind and start."""
    if not text:
        return []
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if m.end() - m.start() <= 37 and 16 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15] if "+" in text else []
    return out


def places(text: str) -> list[tuple[int, int]]:
    """Stretches around digits and at signs, up to white space or REACH characters; near ones are one. Those without enough to be a candidate are left out."""
    out: list[list[int]] = []
    for m in CORE.finditer(text):
        start, stop = m.span()
        low, high = max(0, start - REACH, out[-1][1] if out else 0), min(len(text), stop + REACH)
        if out and start <= out[-1][1]:
            low = start
        around = 2 if m[0][0] in "([" else 1  # a spelt-out at sign has a word on either side
        words = 0
        while start > low and (not text[start - 1].isspace() or words < around - 1):
            start -= 1
            words += text[start].isspace()
        words = 0
        while stop < high and (not text[stop].isspace() or words < around - 1):
            words += text[stop].isspace()
            stop += 1
        if out and start <= out[-1][1] + 3 and "\n" not in text[out[-1][1] : start]:
            out[-1][1] = max(stop, out[-1][1])
        else:
            out.append([start, stop])
    return [(a, b) for a, b in out if _promising(text[a:b])]


def _promising(part: str) -> bool:
    n = sum("0" <= c <= "9" for c in part)
    return n >= 7 or (n >= 4 and part.count(".") >= 3) or "@" in part or "at)" in part or "at]" in part


@dataclass
class Segment:
    """A candidate: tokens first to last - 1 of a place, characters start to end of the text, and the numbers of its features."""

    first: int
    last: int
    start: int
    end: int
    features: list[int]


FEATURES: dict[str, int] = {}
for _name, _values in {
    "bias": 1, "digits": 10, "luhn": 3, "at": 3, "domain": 2, "dots": 5, "octets": 2, "letters": 2, "plus": 3, "paren": 3, "gaps": 6, "marks": 5, "opens": 5, "closes": 3, "before": 7,
    "after": 7, "groups": 8, "odd": 2, "tokens": 5,
}.items():
    FEATURES |= {f"{_name}{v}": len(FEATURES) + v for v in range(_values)}


def _beside(c: str) -> int:
    """Class of the character beside a span."""
    if not c or c.isspace():
        return 0
    if c.isdigit():
        return 1
    if c.isalpha():
        return 2
    return {".": 3, "-": 4, "@": 5, "_": 5, "+": 5, "%": 5}.get(c, 6)


def span_features(span: str, before: str, after: str, tokens: int) -> list[int]:
    """Numbers of the features that a whole span has, one value each."""
    digits = _digits(span)
    n = len(digits)
    at = min(2, sum(span.count(a) for a in AT))
    groups = re.findall(r"[0-9]+", span)
    tail = re.split(r"@|\(at\)|\[at\]| at ", span)[-1] if at else ""
    marks = {c for c in span if not c.isalnum()}
    size = 0 if n == 0 else 1 if n < 4 else 2 if n < 7 else 3 if n < 8 else 4 if n < 11 else 5 if n < 13 else 6 if n < 16 else 7 if n == 16 else 8 if n < 20 else 9
    values = {
        "bias": 0, "digits": size, "luhn": 0 if not 13 <= n <= 19 else 1 + luhn(digits), "at": at, "domain": int(bool(re.fullmatch(r"\s*[A-Za-z0-9-]+(?:(?:\.| dot |\(dot\)|\[dot\])[A-Za-z0-9-]+)+", tail))),
        "dots": min(4, span.count(".")), "octets": int(bool(re.fullmatch(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}", span)) and all(int(g) < 256 for g in groups)),
        "letters": int(any("a" <= c.lower() <= "z" for c in span)), "plus": 1 if span.startswith("+") else 2 if "+" in span else 0,
        "paren": 0 if not marks & set("()") else 1 if span.count("(") == span.count(")") == 1 else 2, "gaps": min(5, sum(c.isspace() for c in span)),
        "marks": 0 if not marks else 1 if marks <= set(" -") else 2 if marks <= set(" -().+/") else 3 if marks & set("@_%") else 4,
        "opens": 0 if span[0].isdigit() else 1 if span[0] == "+" else 2 if span[0] == "(" else 3 if span[0].isalpha() else 4,
        "closes": 0 if span[-1].isdigit() else 1 if span[-1].isalpha() else 2, "before": _beside(before), "after": _beside(after),
        "groups": min(7, len(groups)), "odd": int(bool(re.search(r"[^\w\s]{2}|\s{2}", span.replace(") ", "").replace(" (", "").replace("(at)", "")))), "tokens": min(4, tokens // 4),
    }
    return [FEATURES[f"{k}{v}"] for k, v in values.items()]


def segments(text: str, start: int, stop: int) -> tuple[int, list[Segment]]:
    """The number of tokens of a place, and its candidate segments."""
    tokens = [(m.group(), m.start(), m.end()) for m in TOKEN.finditer(text, start, stop)]
    out = []
    for i, (word, a, _) in enumerate(tokens):
        if not (word.isalnum() and word.isascii() or word in "+("):
            continue
        digits = dots = gaps = 0
        has_at = False
        for j in range(i, min(len(tokens), i + LONGEST)):
            word, s, e = tokens[j]
            alnum = word.isalnum() and word.isascii()
            if "\n" in word or e - a > WIDEST or not (alnum or word.isspace() or word in INSIDE):
                break
            digits += len(word) if alnum and word[0].isdigit() else 0
            dots += word in (".", "dot")
            gaps += word.isspace()
            has_at = has_at or word == "@" or word == "at" and 0 < j < len(tokens) - 1 and tokens[j - 1][0] in "([" and tokens[j + 1][0] in ")]"
            if gaps > 6:
                break
            if alnum and (has_at and dots or digits >= 7 or digits >= 4 and dots >= 3):
                out.append(Segment(i, j + 1, a, e, span_features(text[a:e], text[a - 1 : a] if a else "", text[e : e + 1], j + 1 - i)))
    return len(tokens), out


@dataclass
class SegmentModel:
    """Weights of features (rows) by kind (columns), and of transitions from label to label; label 0 is outside."""

    weights: np.ndarray
    moves: np.ndarray

    def scores(self, found: list[Segment]) -> np.ndarray:
        if not found:
            return np.zeros((0, len(KINDS)))
        return self.weights[np.array([s.features for s in found])].sum(axis=1)

    def decode(self, n: int, found: list[Segment], scores: np.ndarray) -> list[tuple[int, Segment]]:
        """(kind's number, segment) of the best division of n tokens into segments and single tokens outside, in order."""
        labels, moves = range(len(KINDS) + 1), self.moves.tolist()
        by_end: dict[int, list[int]] = {}
        for k, s in enumerate(found):
            by_end.setdefault(s.last, []).append(k)
        points = scores.tolist()
        best = [[0.0] + [-1e300] * len(KINDS)]
        back: list[list] = [[None] * len(labels)]
        into = [[max((best[0][y] + moves[y][z], -y) for y in labels) for z in labels]]
        for t in range(1, n + 1):
            row, from_ = [-1e300] * len(labels), [None] * len(labels)
            row[0], from_[0] = into[t - 1][0][0], (t - 1, -into[t - 1][0][1], None)
            for k in by_end.get(t, ()):
                i = found[k].first
                for z in labels[1:]:
                    value = into[i][z][0] + points[k][z - 1]
                    if value > row[z]:
                        row[z], from_[z] = value, (i, -into[i][z][1], k)
            best.append(row)
            back.append(from_)
            into.append([max((row[y] + moves[y][z], -y) for y in labels) for z in labels])
        t, y = n, max(labels, key=lambda y: (best[n][y], -y))
        out = []
        while t > 0:
            i, before, k = back[t][y]
            if k is not None:
                out.append((y - 1, found[k]))
            t, y = i, before
        return out[::-1]


class Likelihood:
    """Log-likelihood of the gold divisions of many places at once, by forward and backward sums over positions."""

    def __init__(self, examples: list[tuple[int, list[Segment], list[tuple[int, int, int]]]]):
        """examples: tokens, candidates, and gold (first, last, kind) of each place."""
        self.n = np.array([e[0] for e in examples])
        self.width = int(self.n.max()) + 1
        of = np.repeat(np.arange(len(examples)), [len(e[1]) for e in examples])
        flat = [s for e in examples for s in e[1]]
        kinds, self.like = np.unique(np.array([s.features for s in flat]), axis=0, return_inverse=True)
        self.like = self.like.ravel()  # candidates with the same features count together
        self.x = np.zeros((len(kinds), len(FEATURES)))
        self.x[np.arange(len(kinds))[:, None], kinds] = 1
        self.of, self.first, self.last = of, np.array([s.first for s in flat]), np.array([s.last for s in flat])
        self.gold = np.zeros((len(flat), len(KINDS)))
        self.moved = np.zeros((len(KINDS) + 1, len(KINDS) + 1))
        number = {(int(o), s.first, s.last): k for k, (o, s) in enumerate(zip(of, flat))}
        for o, (n, _, gold) in enumerate(examples):
            starts, t, y = {g[0]: g for g in gold}, 0, 0
            while t < n:
                if t in starts:
                    _, stop, kind = starts[t]
                    self.gold[number[o, t, stop], kind] = 1
                    self.moved[y, kind + 1] += 1
                    t, y = stop, kind + 1
                else:
                    self.moved[y, 0] += 1
                    t, y = t + 1, 0
        self.ends = [np.flatnonzero(self.last == t) for t in range(self.width)]
        self.starts = [np.flatnonzero(self.first == t) for t in range(self.width)]

    def _by_place(self, c: np.ndarray, values: np.ndarray) -> np.ndarray:
        return np.column_stack([np.bincount(self.of[c], values[:, y], len(self.n)) for y in range(len(KINDS))])

    def gradient(self, model: SegmentModel) -> tuple[float, np.ndarray, np.ndarray]:
        """(log-likelihood, its gradient by weights, by moves)."""
        m, labels = len(self.n), len(KINDS) + 1
        score = (self.x @ model.weights)[self.like]
        grown, step = np.exp(np.minimum(score, 50)), np.exp(model.moves)
        ahead, into = np.zeros((self.width, m, labels)), np.zeros((self.width, m, labels))
        ahead[0, :, 0] = 1
        into[0] = ahead[0] @ step
        for t in range(1, self.width):
            ahead[t, :, 0] = into[t - 1, :, 0]
            c = self.ends[t]
            ahead[t, :, 1:] = self._by_place(c, into[self.first[c], self.of[c], 1:] * grown[c])
            into[t] = ahead[t] @ step
        every = np.arange(m)
        z = ahead[self.n, every].sum(axis=1)
        rest, out = np.zeros((self.width, m, labels)), np.zeros((self.width, m, labels))
        rest[self.n, every] = 1
        for t in range(self.width - 2, -1, -1):
            out[t, :, 0] = rest[t + 1, :, 0]
            c = self.starts[t]
            out[t, :, 1:] = self._by_place(c, grown[c] * rest[self.last[c], self.of[c], 1:])
            live = t < self.n
            rest[t, live] = (out[t] @ step.T)[live]
        share_of = into[self.first, self.of, 1:] * grown * rest[self.last, self.of, 1:] / z[self.of, None]
        apart = self.gold - share_of
        by_weight = self.x.T @ np.column_stack([np.bincount(self.like, apart[:, y], len(self.x)) for y in range(len(KINDS))])
        live = (np.arange(self.width)[:, None] < self.n)[:, :, None]
        by_move = self.moved - np.einsum("tmy,tmz->yz", ahead * live / z[None, :, None], out) * step
        value = float((score * self.gold).sum() + (model.moves * self.moved).sum() - np.log(z).sum())
        return value, by_weight, by_move


def train(examples: list, steps: int = 100, rate: float = 0.2, ridge: float = 0.002) -> SegmentModel:
    """Weights by gradient steps on the mean log-likelihood with a ridge."""
    model = SegmentModel(np.zeros((len(FEATURES), len(KINDS))), np.zeros((len(KINDS) + 1, len(KINDS) + 1)))
    examples = [e for e in examples if e[1]]
    if not any(e[2] for e in examples):
        model.weights[FEATURES["bias0"]] = -50.0
        return model
    fit = Likelihood(examples)
    first = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    second = [np.zeros_like(model.weights), np.zeros_like(model.moves)]
    for k in range(1, steps + 1):
        _, *grads = fit.gradient(model)
        for held, g, m, v in zip((model.weights, model.moves), grads, first, second):
            g = g / len(examples) - ridge * held
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            held += rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return model


def lookalikes(span: str) -> list[str]:
    """Dates, times and plain numbers from a span's digits: no personal data."""
    d = (_digits(span) * 3)[:16]
    return [f"{d[:4]}-{d[4:6]}-{d[6:8]} {d[8:10]}", f"{d[:2]}/{d[2:4]}/{d[4:8]} {d[8:10]}.{d[10:12]}", f"{d[:4]}-{d[4:8]}", f"{d[:3]} {d[3:6]} {d[6:9]}", f"{d[:2]}.{d[2:4]}.{d[4:8]}"]


def variants(kind: str, span: str) -> list[str]:
    """Other ways to write a base span."""
    if kind == "email":
        name, domain = span.split("@", 1)
        return [f"{name} (at) {domain}", f"{name} [at] {domain}", f"{name} @ {domain}"]
    if kind == "card":
        digits = _digits(span)
        fours = [digits[i : i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(fours) for mark in (" ", "-", ".", "/")]
    if kind == "phone":
        bare = span.lstrip("+")
        return [f"00{bare}", bare.split(" ", 1)[-1] if "(" in bare else f"00 {bare}", re.sub(r"[ ().-]+", ".", span), re.sub(r"[ ().-]+", "/", span)]
    return []


def example(text: str, start: int, stop: int, gold: list[tuple[str, int, int]]) -> tuple[int, list[Segment], list[tuple[int, int, int]]] | None:
    """A place as (tokens, candidates, gold segments); None if it is too long for fitting or its spans are no candidates."""
    n, found = segments(text, start, stop)
    by_span = {(s.start, s.end): s for s in found}
    inside, last = [], -1
    for kind, a, b in sorted(gold, key=lambda g: g[1]):
        if start <= a and b <= stop and a >= last:
            s = by_span.get((a, b))
            if s is None:
                return None
            inside.append((s.first, s.last, KINDS.index(kind)))
            last = b
    return (n, found, inside) if found and n <= FIT_TOKENS else None


def examples_of(text: str) -> list[tuple]:
    """Training examples of a text: its first FIT_PLACES places, and variants of their spans written in the same surroundings."""
    gold, out = base_spans(text), []
    for start, stop in places(text)[:FIT_PLACES]:
        near = [g for g in gold if start <= g[1] and g[2] <= stop]
        one = example(text, start, stop, near)
        if one is None:
            continue
        out.append(one)
        if len(near) == 1:
            kind, a, b = near[0]
            made = [(new, True) for new in variants(kind, text[a:b])] + [(new, False) for new in (lookalikes(text[a:b]) if kind in ("card", "phone") else [])]
            for new, holds in made:
                other = text[max(0, start - 4) : a] + new + text[b : stop + 4]
                at = a - max(0, start - 4)
                got = example(other, min(4, start), len(other) - len(text[stop : stop + 4]), [(kind, at, at + len(new))] if holds else [])
                if got is not None:
                    out.append(got)
    return out


def fit_segments(docs: DataFrame, max_docs: int = 4_000, max_examples: int = 3_000, seed: int = 13) -> SegmentModel:
    """The model learned from about max_docs of the documents with digits or at signs, and at most max_examples of their places, half of them with base spans.

    The rows are chosen by a hash of doc_id and text. Without any base span the model finds nothing.
    """
    hits = docs.select("doc_id", "text", F.crc32(F.col("text").cast("binary")).alias("text_key")).where(F.col("text").rlike(r"@|\+[0-9]|[0-9]{7}|[0-9]\.[0-9]+\.[0-9]|[0-9][ -][0-9]"))
    small_batches(docs)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(key, pos, bool(e[2]), e[0], [[s.first, s.last, s.start, s.end, *s.features] for s in e[1]], [list(g) for g in e[2]]) for key, text in zip(batch["text_key"], batch["text"]) for pos, e in enumerate(examples_of(text))]
            if rows:
                yield pd.DataFrame(rows, columns=["text_key", "place", "holds", "n", "found", "gold"])

    schema = "text_key long, place int, holds boolean, n int, found array<array<int>>, gold array<array<int>>"
    read_rows = sample_rows(hits, max_docs, seed, "doc_id", "text_key").mapInPandas(read, schema)
    read_rows = cut_lineage(read_rows.withColumn("key", F.xxhash64(F.lit(seed), "text_key", "place")))
    examples = []
    for holds in (True, False):
        for r in read_rows.where(F.col("holds") == holds).orderBy("key", "n", "found").limit(max_examples // 2).collect():
            examples.append((r["n"], [Segment(*s[:4], s[4:]) for s in r["found"]], [tuple(g) for g in r["gold"]]))
    return train(examples)


def all_spans(text: str | None, base: list[tuple[str, int, int]], model: SegmentModel) -> list[tuple[str, int, int]]:
    """Base spans and those that the model finds beside them, by kind and start."""
    if not text:
        return base
    added = []
    for start, stop in places(text):
        n, found = segments(text, start, stop)
        if found:
            added += [(KINDS[kind], s.start, s.end) for kind, s in model.decode(n, found, model.scores(found))]
    taken = sorted((a, b) for _, a, b in base)
    added = [s for s in added if not any(a < s[2] and s[1] < b for a, b in taken)] if taken else added
    return sorted({*base, *added}, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for kind, a, b in spans)


def find_spans(docs: DataFrame, model: SegmentModel) -> DataFrame:
    """doc_id, base and spans (arrays of kind, start, end in code points, end exclusive): one row per document, from the whole text.

    Null and empty texts have no spans. Repeated rows repeat. A span that the model finds counts only where it meets no base span. Columns
    besides doc_id and text are ignored.
    """
    small_batches(docs)
    held = share(docs, model)
    kind = "array<struct<kind: string, start: int, end: int>>"

    @F.pandas_udf(f"base {kind}, spans {kind}")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared(held)
        for batch in batches:
            base = [base_spans(t) for t in batch]
            both = [all_spans(t, b, m) for t, b in zip(batch, base)]
            named = lambda rows: [[dict(zip(("kind", "start", "end"), s)) for s in r] for r in rows]
            yield pd.DataFrame({"base": pd.Series(named(base), dtype=object), "spans": pd.Series(named(both), dtype=object)})

    return docs.select("doc_id", find("text").alias("found")).select("doc_id", "found.base", "found.spans")


def digest_spans(found: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of find_spans(); counts are those of base spans."""
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s.kind == k))
    counts = [of_kind(k).cast("long").alias(f"n_{k}") for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, and what spans share, replaced by its kind in brackets."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: s[1:]):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]
