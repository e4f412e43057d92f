"""Language identification by word-first backoff.

A word known from training scores its per-language log frequency. An unseen word falls back to its character
4-grams, and where none of those is known to 3-, 2- and 1-grams. A document's language is the one with the largest
sum over all words of the whole text.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cleargrain.llm.common import hash_key, share, shared, small_batches, split_of

#: Bytes of ASCII text in lower case, all but letters as spaces.
ASCII_LETTERS = bytes(ord(c.lower()) if (c := chr(i)).isascii() and c.isalpha() else 32 for i in range(256))
LONGEST_GRAM = 4
#: Unseen words whose backoff scores a task keeps at most; past that it starts the store anew.
MEMO_ROWS = 50_000
UNKNOWN = "und"


def sample_rows(rows: DataFrame, max_rows: int, seed: int, *by: str) -> DataFrame:
    """About max_rows of the rows (all, if fewer), chosen by a hash of the columns named."""
    n = rows.count()
    if n <= max_rows:
        return rows
    edge = f"{int(max_rows / n * 16**8):08x}"
    return rows.where(F.substring(hash_key(seed, *map(F.col, by)), 1, 8) < edge)


def labelled_texts(docs: DataFrame, chosen: DataFrame) -> DataFrame:
    """doc_id, text, label: each labelled document once a label; of several texts of one doc_id the smallest, so no more rows than chosen has."""
    met = docs.select("doc_id", "text").where(F.col("text").isNotNull()).join(F.broadcast(chosen.distinct()), "doc_id")
    return met.groupBy("doc_id", "label").agg(F.min("text").alias("text"))


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Whether a code point is a letter, for all of them."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def words_of(text: str | None) -> list[str]:
    """Runs of letters (Unicode category L) of the text in lower case; training and prediction share it."""
    if not text:
        return []
    if text.isascii():
        return text.encode().translate(ASCII_LETTERS).decode().split()
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return np.where(letters()[codes], codes, 32).astype(np.uint32).tobytes().decode("utf-32-le").split()


def grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>" if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


class BackoffModel:
    """Log frequencies: of words, and by length of character n-grams; a row per entry, a column per language."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.langs = sorted(counts)
        self.words, self.word_scores = self._table([Counter(counts[x]) for x in self.langs])
        self.grams = []
        for n in range(1, LONGEST_GRAM + 1):
            by_lang = [Counter(g for w in counts[x] for g in grams(w, n)) for x in self.langs]
            self.grams.append(self._table(by_lang))

    @staticmethod
    def _table(by_lang: list[Counter]) -> tuple[dict[str, int], np.ndarray]:
        names = {w: i for i, w in enumerate(sorted(set().union(*by_lang)))}
        seen = np.zeros((len(names), len(by_lang)))
        for k, counter in enumerate(by_lang):
            for w, c in counter.items():
                seen[names[w], k] = c
        return names, np.log((seen + 0.5) / (seen.sum(0) + 0.5 * (len(names) + 1)))

    def back_off(self, words: list[str]) -> np.ndarray:
        """Scores of unseen words, a row each: the mean over the known n-grams of the largest n that has any."""
        out = np.zeros((len(words), len(self.langs)))
        left = range(len(words))
        for n in range(LONGEST_GRAM, 0, -1):
            names, scores = self.grams[n - 1]
            found, rows, starts, rest = [], [], [], []
            for k in left:
                own = [r for g in grams(words[k], n) if (r := names.get(g)) is not None]
                if own:
                    found.append(k)
                    starts.append(len(rows))
                    rows += own
                else:
                    rest.append(k)
            if found:
                sizes = np.diff([*starts, len(rows)])
                out[found] = np.add.reduceat(scores[rows], starts) / sizes[:, None]
            left = rest
        return out


def fit_languages(docs: DataFrame, max_docs: int = 10_000, min_count: int = 2, seed: int = 5) -> BackoffModel | None:
    """Learn from about max_docs documents with text and lang whose crc32(doc_id) mod 4 is not 2: all words of their whole texts.

    A word seen fewer than min_count times in a language tells no more than its n-grams and is no known word. No rows: None. Repeated rows
    count each time; a null doc_id takes part.
    """
    known = docs.select("doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (split_of(F.col("doc_id"), 4) != 2))
    known = known.withColumn("text_key", F.crc32(F.col("text").cast("binary")))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counted: Counter = Counter()
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"]):
                counted.update((lang, w) for w in words_of(text))
        if counted:
            yield pd.DataFrame([(lang, w, n) for (lang, w), n in counted.items()], columns=["lang", "word", "n"])

    words = sample_rows(known, max_docs, seed, "doc_id", "text_key").select("lang", "text").mapInPandas(count, "lang string, word string, n long")
    counts: dict[str, dict[str, int]] = defaultdict(dict)
    words = words.groupBy("lang", "word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    for row in words.toLocalIterator():  # the words of max_docs documents
        counts[row[0]][row[1]] = row[2]
    return BackoffModel(counts) if counts else None


def with_language(docs: DataFrame, model: BackoffModel | None, name: str = "language") -> DataFrame:
    """docs and a column of structs: lang_pred, score (share of the best language, 0 to 1), n_words.

    Null texts, texts without a letter, and all texts if nothing was learned: `und`, score 0. Ties go to the first
    language by name. Every word of a text counts. Repeated rows repeat; other columns stay as they are.
    """
    small_batches(docs)
    held = share(docs, model)

    @F.pandas_udf("lang_pred string, score double, n_words long")
    def predict(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        m = shared(held)
        if m is not None:
            n_known = len(m.words)
            scores = np.vstack([m.word_scores, np.zeros((MEMO_ROWS, len(m.langs)))])
            rows, used = dict(m.words), n_known
        for batch in batches:
            out = []
            for text in batch:
                words = words_of(text) if m is not None else []
                if not words:
                    out.append((UNKNOWN, 0.0, 0))
                    continue
                counted = Counter(words)
                if used + len(counted) > len(scores):
                    rows, used = dict(m.words), n_known
                at = list(map(rows.get, counted))
                new = [w for w, k in zip(counted, at) if k is None]
                if used + len(new) > len(scores):
                    rows, used = dict(m.words), n_known
                    at = list(map(rows.get, counted))
                    new = [w for w, k in zip(counted, at) if k is None]
                if len(new) > MEMO_ROWS:  # one document with more new words than the store holds
                    total = np.zeros(len(m.langs))
                    for i in range(0, len(new), MEMO_ROWS):
                        part = new[i : i + MEMO_ROWS]
                        total += np.array([counted.pop(w) for w in part], dtype=float) @ m.back_off(part)
                    at = [k for k in at if k is not None]
                else:
                    total = 0.0
                    if new:
                        scores[used : used + len(new)] = m.back_off(new)
                        fresh = iter(range(used, used + len(new)))
                        rows.update(zip(new, range(used, used + len(new))))
                        at = [next(fresh) if k is None else k for k in at]
                        used += len(new)
                total = total + np.fromiter(counted.values(), dtype=float, count=len(counted)) @ scores[at]
                share = np.exp((total - total.max()) / max(1.0, len(words) / 20))
                best = int(total.argmax())
                out.append((m.langs[best], float(share[best] / share.sum()), len(words)))
            lang, score, n = zip(*out) if out else ((), (), ())
            yield pd.DataFrame({"lang_pred": list(lang), "score": np.array(score, dtype=float), "n_words": np.array(n, dtype=np.int64)})

    return docs.withColumn(name, predict("text"))


def identify_languages(docs: DataFrame, model: BackoffModel | None) -> DataFrame:
    """doc_id, lang_pred, score, n_words: one row per document, as with_language() finds them."""
    return with_language(docs.select("doc_id", "text"), model).select("doc_id", "language.*")
