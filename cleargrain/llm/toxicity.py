"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton over folded text.

Folding lower-cases, strips accents, maps homoglyphs and digit or sign substitutions to letters, drops invisible
characters and turns everything else into spaces. The lexicon (words, and word beginnings that catch their
inflections) is learned from a bounded sample of labelled rows; phrases that hold a lexicon word in clean rows only
are exceptions. A document's weight is its summed matches, normalised by length; isotonic calibration turns
it into a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import heapify, heappop, heapreplace

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import cut_lineage, share, shared, small_batches, split_of
from cleargrain.llm.langid import labelled_texts, sample_rows

# Look-alike letters of other scripts, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m",
    "н": "h", "о": "o", "р": "p", "ԛ": "q", "ѕ": "s", "т": "t", "ц": "u", "ѵ": "v", "ѡ": "w", "х": "x", "у": "y", "α": "a", "β": "b",
    "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ℓ": "l",
    "ɑ": "a", "ɡ": "g", "ø": "o", "đ": "d", "ł": "l", "ß": "s",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g"}
SIGNS = {"@": "a", "$": "s", "!": "i", "|": "l", "€": "e"}

INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
INNER_SIGN = re.compile(r"(?<=[^\W_])[@$!|€](?=[^\W_])")
SHORTEST_STEM = 4


class _Folder(dict):
    """Character table filled on demand: the folded form of any code point."""

    def __missing__(self, code: int):
        char = chr(code).lower()
        base = "".join(c for c in unicodedata.normalize("NFKD", char) if not unicodedata.combining(c)).lower()
        value = "".join(HOMOGLYPHS.get(c, DIGITS.get(c, c)) for c in base)
        value = value if value.isalpha() else None if unicodedata.combining(chr(code)) else " "
        self[code] = value
        return value


FOLDER = _Folder(INVISIBLE)


def fold(text: str | None) -> str:
    """The folded text, with a space at either end."""
    if not text:
        return " "
    if any(s in text for s in SIGNS):
        text = INNER_SIGN.sub(lambda m: SIGNS[m[0]], text)
    return f" {text.translate(FOLDER)} "


def terms_of(folded: str) -> set[str]:
    """Distinct words as ` word ` and their beginnings as ` beg`."""
    out = set()
    for word in set(folded.split()):
        out.add(f" {word} ")
        out.update(f" {word[:n]}" for n in range(SHORTEST_STEM, min(len(word), 9)))
    return out


def next_word(folded: str, at: int) -> tuple[str, int]:
    """The first word from a place on, and where it ends."""
    while at < len(folded) and folded[at] == " ":
        at += 1
    stop = folded.find(" ", at)
    stop = len(folded) if stop < 0 else stop
    return folded[at:stop], stop


def last_word(folded: str, at: int) -> str:
    """The word that ends before a place."""
    while at > 0 and folded[at - 1] == " ":
        at -= 1
    return folded[folded.rfind(" ", 0, at) + 1 : at]


@dataclass
class ToxicLexicon:
    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset = frozenset()
    steps: np.ndarray = field(default_factory=lambda: np.zeros(1))
    scores: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def matcher(self):
        machine = ahocorasick.Automaton()
        for term, weight in self.weights.items():
            machine.add_word(term, (term, weight))
        if self.weights:
            machine.make_automaton()
        return machine

    def matches(self, machine, folded: str) -> list[tuple[str, float, str, str]]:
        """(term, weight, word before and word, word and word after) for each place; the heaviest term of a place counts."""
        if not self.weights:
            return []
        best: dict[int, tuple[str, float]] = {}
        for end, (term, weight) in machine.iter(folded):
            start = end - len(term) + 1
            if start not in best or weight > best[start][1]:
                best[start] = (term, weight)
        out = []
        for start, (term, weight) in best.items():
            word, stop = next_word(folded, start)
            left, right = f"{last_word(folded, start)} {word}".strip(), f"{word} {next_word(folded, stop)[0]}".strip()
            if left not in self.exceptions and right not in self.exceptions:
                out.append((term, weight, left, right))
        return out

    def density(self, found: list, folded: str) -> float:
        return sum(w for _, w, _, _ in found) / math.log2(4 + folded.count(" ")) if found else 0.0

    def calibrated(self, density: float) -> float:
        return float(self.scores[max(0, int(np.searchsorted(self.steps, density, side="right")) - 1)])


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps of the best rising fit of y on x (pooling of adjacent violators); each pool's mean is drawn to 0 or 1 by half a row."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []  # first x, sum, count
    for a, b in zip(x[order], y[order]):
        if pools and pools[-1][0] == a:
            pools[-1][1] += b
            pools[-1][2] += 1
        else:
            pools.append([a, b, 1])
        while len(pools) > 1 and pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]:
            _, s, n = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
    return np.array([p[0] for p in pools]), np.array([p[1] / p[2] for p in pools])


def choose_terms(tox: dict[str, int], clean: dict[str, int], n_tox: int, n_clean: int, members: dict[str, list[int]]) -> dict[str, float]:
    """Terms with weights, picked one by one by the toxic rows they still have to explain.

    Each pick lowers the weight of the rows that hold it, so rare words of one much-copied toxic row lose
    their support to the words that toxic rows of all kinds share. A stem that adds little to the words already
    picked is left out the same way. Gains only fall, so a term is weighed anew when it heads the queue.
    """
    odds = {t: math.log((c + 0.5) / (n_tox + 1)) - math.log((clean.get(t, 0) + 0.5) / (n_clean + 1)) for t, c in tox.items()}
    usable = {t for t in tox if odds[t] >= 2.5 and clean.get(t, 0) <= 0.02 * tox[t] + 0.0005 * n_clean}
    rows = {t: np.array(members[t]) for t in usable}
    left = np.ones(n_tox)
    least = max(1.0, 0.002 * n_tox)
    weights: dict[str, float] = {}

    def entry(t: str) -> tuple[float, int, list[int], str]:
        gain = left[rows[t]].sum() * (1 - clean.get(t, 0) / (tox[t] + clean.get(t, 0)))
        return -round(float(gain), 6), -len(t), [-ord(c) for c in t], t  # of equal gains the longest term, then the last by name

    queue = [entry(t) for t in usable]
    heapify(queue)
    while queue:
        now = entry(queue[0][3])
        if now != queue[0]:
            heapreplace(queue, now)
            continue
        if -now[0] < least:
            break
        heappop(queue)
        weights[now[3]] = odds[now[3]]
        left[rows[now[3]]] *= 0.3
    return weights


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, min_docs: int = 3, seed: int = 11) -> ToxicLexicon:
    """Learn from about max_labelled labelled rows whose crc32(doc_id) mod 4 is not 2. Null labels and texts don't count.

    Terms are those of at least min_docs toxic rows. Without toxic rows the lexicon is empty and every score is 0.
    """
    usable = labels.select("doc_id", F.col("toxic").alias("label")).where(F.col("label").isNotNull() & (split_of(F.col("doc_id"), 4) != 2))
    chosen = sample_rows(usable, max_labelled, seed, "doc_id")  # bounded, so it may be broadcast
    small_batches(docs)
    train = cut_lineage(labelled_texts(docs, chosen))
    toxic, clean = train.where("label = 1"), train.where("label = 0")

    def list_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: Counter = Counter()
        for batch in batches:
            for text in batch["text"]:
                counted.update(terms_of(fold(text)))
        if counted:
            yield pd.DataFrame({"term": list(counted), "n": list(counted.values())})

    candidates = (
        toxic.mapInPandas(list_terms, "term string, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") >= min_docs)
    )
    tox = {r[0]: r[1] for r in candidates.collect()}
    if not tox:
        return ToxicLexicon()
    held = share(docs, sorted(tox))

    def count_candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted, counted, n = set(shared(held)), Counter(), 0
        for batch in batches:
            n += len(batch)
            for text in batch["text"]:
                counted.update(terms_of(fold(text)) & wanted)
        yield pd.DataFrame({"term": ["", *counted], "n": [n, *counted.values()]})

    in_clean = {r[0]: r[1] for r in clean.mapInPandas(count_candidates, "term string, n long").groupBy("term").agg(F.sum("n")).collect()}
    n_clean = in_clean.pop("", 0)
    strong = {t for t in tox if in_clean.get(t, 0) <= 0.02 * tox[t] + 0.0005 * n_clean}
    held_strong = share(docs, {t: i for i, t in enumerate(sorted(strong))})

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = shared(held_strong)
        for batch in batches:
            yield pd.DataFrame({"terms": [[index[t] for t in terms_of(fold(x)) & index.keys()] for x in batch["text"]]})

    names, members = sorted(strong), defaultdict(list)
    toxic_rows = toxic.mapInPandas(list_members, "terms array<int>").collect()
    for i, row in enumerate(toxic_rows):
        for t in row[0]:
            members[names[t]].append(i)
    weights = choose_terms({t: tox[t] for t in strong if t in members}, in_clean, len(toxic_rows), n_clean, members)
    lexicon = ToxicLexicon(weights)

    def list_matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine, out = lexicon.matcher(), []
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                folded = fold(text)
                found = lexicon.matches(machine, folded)
                phrases = sorted({p for _, _, *both in found for p in both if " " in p})
                out.append((int(label), lexicon.density(found, folded), phrases))
        if out:
            yield pd.DataFrame(out, columns=["label", "density", "phrases"])

    rows = train.where("label in (0, 1)").mapInPandas(list_matches, "label int, density double, phrases array<string>").collect()
    phrases = [Counter(), Counter()]
    for label, _, own in rows:
        phrases[label].update(own)
    lexicon.exceptions = frozenset(p for p, c in phrases[0].items() if c >= 3 and c >= 9 * phrases[1][p])
    if lexicon.exceptions:
        rows = train.where("label in (0, 1)").mapInPandas(list_matches, "label int, density double, phrases array<string>").collect()
    lexicon.steps, lexicon.scores = isotonic(np.array([r[1] for r in rows]), np.array([r[0] for r in rows], dtype=float))
    return lexicon


def with_toxicity(docs: DataFrame, lexicon: ToxicLexicon, name: str = "toxicity") -> DataFrame:
    """docs and a column of structs: score (0 to 1, higher: toxic), n_matches and matched (distinct lexicon terms).

    The whole text counts. Null or empty text has no match and the score of documents without one. Equal texts get equal scores. Repeated
    rows repeat; other columns stay as they are.
    """
    small_batches(docs)
    held = share(docs, lexicon)

    @F.pandas_udf("score double, n_matches long, matched array<string>")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        own = shared(held)
        machine = own.matcher()
        for batch in batches:
            out = []
            for text in batch:
                folded = fold(text)
                found = own.matches(machine, folded)
                out.append((own.calibrated(own.density(found, folded)), len(found), sorted({t.strip() for t, *_ in found})))
            yield pd.DataFrame(out, columns=["score", "n_matches", "matched"])

    return docs.withColumn(name, score("text"))


def score_toxicity(docs: DataFrame, lexicon: ToxicLexicon) -> DataFrame:
    """doc_id, score, n_matches and matched: one row per document, as with_toxicity() finds them."""
    return with_toxicity(docs.select("doc_id", "text"), lexicon).select("doc_id", "toxicity.*")
