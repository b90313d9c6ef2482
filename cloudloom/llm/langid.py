"""Language identification by word-first backoff.

A word known from the labelled rows scores by its log frequency in each language. An unseen word falls
back to the longest of its character n-grams (5 letters down to 1, word ends marked) of which any is
known. A text gets the language with the largest sum.

The classifier is fitted on a sample of labelled rows of bounded size: about `rows_per_lang` rows of each language, about
`sample_rows` in all, taken by a hash of their key, and none of over `row_chars` characters. All words and n-grams of
the sampled rows are kept, for every language, in sparse tables; only the sample bounds what is broadcast.
Every row is predicted from its whole text.

Defined cases: null text, or one without a letter: `und`, score 0; no labelled row at all: `und` for
every text; a tie goes to the language that sorts first; repeated rows are predicted alike; columns
besides key and text are never read for a prediction.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ragged, release, text_steps

_ALNUM = re.compile(r"[^\W\d_]+").findall
LONGEST = 5
UND = "und"
#: Languages (a row of name and count each) that are broadcast at most.
BROADCAST_LANGS = 100_000
#: Words that a worker remembers before it starts afresh.
CACHE_WORDS = 200_000
#: Words of a text whose scores are added up at a time.
SUM_WORDS = 1 << 16


def fold(df: DataFrame, key: str, parts: int) -> Column:
    """crc32 of the key as text, modulo `parts`."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def sample(train: DataFrame, key: str, text: str, lang: str, rows_per_lang: int, sample_rows: int, row_chars: int) -> DataFrame:
    """About rows_per_lang rows of each language and sample_rows of all at most, chosen by a hash of key and text, so that null and repeated keys are drawn like others; a row that repeats is drawn once."""
    fit = train.filter(F.length(text) <= row_chars)
    sizes = fit.groupBy(F.col(lang).alias("__lang")).agg(F.count("*").alias("__rows"))
    n, each = sizes.agg(F.count("*"), F.least(F.lit(float(rows_per_lang)), F.lit(float(sample_rows)) / F.greatest(F.count("*"), F.lit(1)))).first()
    if n <= BROADCAST_LANGS:  # else the texts are dealt out by language
        sizes = F.broadcast(sizes)
    share = F.lit(each) / F.col("__rows") * (1 << 30)
    return fit.join(sizes, fit[lang] == sizes["__lang"]).filter(F.pmod(F.xxhash64(F.col(key).cast("string"), text), F.lit(1 << 30)) < share).select(*train.columns).dropDuplicates([key, text, lang])


def letters(text: str) -> list[str]:
    """The runs of letters of a text, lower-cased. `re` takes numbers that are no decimal digits (one half, circled and Roman ones) for letters: words that hold one are divided there."""
    words = _ALNUM(text.lower())
    if not all(map(str.isalpha, words)):
        words = [part for w in words for part in "".join(c if c.isalpha() else " " for c in w).split(" ") if part]
    return words


def _grams(word: str, n: int) -> list[str]:
    word = f"<{word}>" if n > 1 else word
    return [word[i : i + n] for i in range(len(word) - n + 1)]


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", rows_per_lang: int = 2500, sample_rows: int = 50_000, row_chars: int = 200_000) -> dict:
    """The model: languages, and for words and n-grams of each size the log frequency of those unseen in a language, and what those seen are above it."""
    train = labelled.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, text, lang)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, col in text_steps(batches, text):
            counts: Counter = Counter()
            for name, t in zip(rows.column(2).to_pylist(), col.to_pylist(), strict=True):
                counts.update((name, w) for w in letters(t))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "gram", "n"])

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: Counter = Counter()
            for name, w, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for size in range(1, LONGEST + 1):
                    for g in _grams(w, size):
                        counts[name, size, g] += n
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.int32()), pa.array([k[2] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "size", "gram", "n"])

    # both tables are read more than once: written, the sampled texts are counted once
    by_word = materialize(sample(train, key, text, lang, rows_per_lang, sample_rows, row_chars).mapInArrow(words, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "words")
    by_gram = by_word.mapInArrow(grams, "lang string, size int, gram string, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    kept = by_word.select("lang", F.lit(0).alias("size"), "gram", "n").unionByName(by_gram).toArrow()  # the sample bounds it
    names = kept["lang"].combine_chunks().dictionary_encode()
    langs = sorted(names.dictionary.to_pylist())
    place = {name: i for i, name in enumerate(langs)}
    at = np.array([place[name] for name in names.dictionary.to_pylist()], np.int32)[names.indices.to_numpy(zero_copy_only=False)] if langs else np.empty(0, np.int32)
    count, sizes = kept["n"].to_numpy(), kept["size"].to_numpy()
    model: dict = {"langs": langs, "index": [], "first": [], "lang": [], "above": [], "unseen": []}
    for size in range(LONGEST + 1):
        rows = np.flatnonzero(sizes == size)
        own = kept["gram"].take(pa.array(rows)).combine_chunks().dictionary_encode()
        gram = own.indices.to_numpy(zero_copy_only=False)
        order = np.lexsort((at[rows], gram))
        rows, gram = rows[order], gram[order]
        total = np.bincount(at[rows], count[rows], len(langs)) + 0.05 * (len(own.dictionary) + 1)
        model["index"].append({g: i for i, g in enumerate(own.dictionary.to_pylist())})
        model["first"].append(np.concatenate([[0], np.cumsum(np.bincount(gram, minlength=len(own.dictionary)))]).astype(np.int64))
        model["lang"].append(at[rows])
        model["above"].append(np.log((count[rows] + 0.05) / 0.05))
        model["unseen"].append(np.log(0.05 / total))
    return model


class Scorer:
    """Predicts with a model; what is found for the new words of a step is found together and remembered."""

    def __init__(self, model: dict):
        self.langs, self.index, self.model = model["langs"], model["index"], model
        self.unseen = np.array(model["unseen"]).reshape(LONGEST + 1, -1)
        self.forget()

    def forget(self) -> None:
        """Lets go of all words: a worker may run other stages next."""
        self.cache: dict[str, int] = {}
        # of a remembered word: its size in the backoff (-1: nothing of it is known), and the languages that have seen it or its n-grams
        self.size, self.first, self.n = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
        self.lang, self.above, self.used = np.empty(1 << 12, np.int32), np.empty(1 << 12), 0

    def learn(self, new: list[str]) -> None:
        """Adds words to the cache: a known word's own logs, else the mean of the longest n-grams of it that are known."""
        known, longer = self.index[0].get, [(n, self.index[n].get) for n in range(LONGEST, 0, -1)]
        hits: list[list[int]] = [[] for _ in self.index]
        owner: list[list[int]] = [[] for _ in self.index]
        size, share = np.full(len(new), -1), np.ones(len(new))
        base = len(self.cache)
        for k, w in enumerate(new):
            self.cache[w] = base + k
            if (own := known(w)) is not None:
                hits[0].append(own)
                owner[0].append(k)
                size[k] = 0
                continue
            marked = f"<{w}>"
            for n, get in longer:
                own = marked if n > 1 else w
                if found := [i for j in range(len(own) - n + 1) if (i := get(own[j : j + n])) is not None]:
                    hits[n] += found
                    owner[n] += [k] * len(found)
                    size[k], share[k] = n, 1.0 / len(found)
                    break
        keys, above = [], []
        for n, own in enumerate(hits):
            if own:
                rows = np.array(own)
                begin = self.model["first"][n][rows]
                lens = self.model["first"][n][rows + 1] - begin
                at, word = ragged(begin, lens), np.repeat(np.array(owner[n]), lens)
                keys.append(word * len(self.langs) + self.model["lang"][n][at])
                above.append(self.model["above"][n][at] * share[word])
        key, place = np.unique(np.concatenate(keys or [np.empty(0, np.int64)]), return_inverse=True)
        value = np.bincount(place, np.concatenate(above or [np.empty(0)]), len(key))
        lens = np.bincount(key // len(self.langs), minlength=len(new))
        while self.used + len(key) > len(self.lang):
            self.lang, self.above = np.concatenate([self.lang, self.lang]), np.concatenate([self.above, self.above])
        self.lang[self.used : self.used + len(key)], self.above[self.used : self.used + len(key)] = key % len(self.langs), value
        self.size, self.n = np.concatenate([self.size, size]), np.concatenate([self.n, lens])
        self.first, self.used = np.concatenate([self.first, self.used + np.cumsum(lens) - lens]), self.used + len(key)

    def total(self, words: list[str]) -> tuple[np.ndarray, int]:
        """The sum of the logs of all words in each language, and the number of words of which anything is known."""
        at = np.fromiter(map(self.cache.__getitem__, words), np.int64, len(words))
        sizes = np.bincount(self.size[at] + 1, minlength=LONGEST + 2)[1:]
        out = sizes @ self.unseen
        for k in range(0, len(at), SUM_WORDS):
            own = at[k : k + SUM_WORDS]
            i = ragged(self.first[own], self.n[own])
            out += np.bincount(self.lang[i], self.above[i], len(self.langs))
        return out, int(sizes.sum())

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[bool]]:
        """Language, score and whether any word or n-gram of the text is known, of each text."""
        if len(self.cache) > CACHE_WORDS:
            self.forget()
        found = [letters(t) for t in texts]
        if self.langs:
            self.learn([w for w in set().union(*found) if w not in self.cache])
        langs, scores, sure = [], [], []
        for words in found:
            if not words or not self.langs:
                langs.append(UND)
                scores.append(0.0)
                sure.append(False)
                continue
            total, known = self.total(words)
            best = int(total.argmax())
            weigh = (total - total[best]) * (min(len(words), 20) / len(words))
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(weigh).sum()))
            sure.append(known > 0)
        return langs, scores, sure


_SCORERS: dict[int, Scorer] = {}


def keep_known(df: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of df, all columns whatever their names, whose text has a language: it has letters, and the model knows a word or an n-gram of it."""
    held = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(held)
        for rows, col in text_steps(batches, text):
            yield rows.filter(pa.array(own.predict(col.to_pylist())[2], pa.bool_()))
        own.forget()
        release()

    return df.mapInArrow(run, df.schema)


def predict(df: DataFrame, model: dict, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred and score (0 to 1) of each row. The model is broadcast: its size is bounded by fit()."""
    held = df.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    df = df.select(key, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(held)
        for rows, col in text_steps(batches, text):
            langs, scores, _ = own.predict(col.to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [key, "lang_pred", "score"])
        own.forget()
        release()

    return df.mapInArrow(run, T.StructType([df.schema[key], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def _scorer(held) -> Scorer:
    raw = held.value
    at = hash(raw)
    if at not in _SCORERS:
        _SCORERS.clear()
        _SCORERS[at] = Scorer(pickle.loads(raw))
    return _SCORERS[at]
