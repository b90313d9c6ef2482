"""Spelling variants against all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from cloudloom.llm import queries, spelling

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
LOW = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain(docs, least=7):
    count = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    words = {w: n for w, n in count.items() if len(w) >= least and n >= 2}
    # words that become equal when at most one letter is left out of each can be one edit apart
    holes = {}
    for w in words:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            holes.setdefault(k, set()).add(w)
    near = {w: {b for k in (w, *(w[:i] + w[i + 1 :] for i in range(len(w)))) for b in holes[k] if b != w and distance_one(w, b)} for w in words}
    form = {}
    for w, n in words.items():
        if near[w]:
            best = min(near[w], key=lambda b: (-words[b], b))
            form[w] = best if words[best] >= 10 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form.get(root):
            root = form[root]
        f = form.get(w)
        out.append((w, f, root, n, len(near[w]), words[f] if f else None))
    return sorted(out, key=repr)


def distance_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def rows(df):
    return sorted(((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()), key=repr)


def edited(r, w):
    i = r.randrange(len(w) + 1)
    kind = r.randrange(3)
    c = r.choice("abcdeéßÿ")
    return w[:i] + c + w[i:] if kind == 0 else w[:i] + w[i + 1 :] if kind == 1 else w[:i] + c + w[i + 1 :]


def made(seed, alphabet, n_words, chain=3):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randrange(6, 14))) for _ in range(n_words)]
    text = []
    for w in base:
        many = r.choice((2, 3, 40, 400))
        for _ in range(chain):
            text += [w] * many
            w, many = edited(r, w), max(2, many // r.choice((5, 10, 12)))
    r.shuffle(text)
    return [(k, " ".join(text[k::7])) for k in range(7)]


@pytest.mark.parametrize("tile", [2000, 6])
@pytest.mark.parametrize(("alphabet", "n"), [("abcdefgé", 120), ("ab", 60)])
def test_same_as_all_pairs(spark, monkeypatch, tile, alphabet, n):
    """Also with tiles of six words, and words of two letters, whose parts of the index are all large and whose grams repeat."""
    monkeypatch.setattr(spelling, "TILE", tile)
    docs = made(3, alphabet, n)
    assert rows(spelling.groups(spark.createDataFrame(docs, DOCS))) == plain(docs)


def test_defined_cases(spark):
    docs = [(None, "Überall überall ABCDEFG abcdefg abcdefgh"), (1, None), (2, ""), (3, "abcdefgh " * 30 + "123abcdefgh_abcdefgh"), (3, "abcdefgh " * 30 + "123abcdefgh_abcdefgh"), (4, "aaaaaaaa aaaaaaaa aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa"), (5, "kürzlich×kürzlich " * 3), (6, "z" * 5000 + " " + "z" * 5000 + " " + ("z" * 4999 + " ") * 2)]
    assert rows(spelling.groups(spark.createDataFrame(docs, DOCS))) == plain(docs)
    clash = spark.createDataFrame([(1, "abcdefgh abcdefgh", "w", 5, "f")], "doc_id long, text string, word string, n int, form string")
    assert [r[0] for r in rows(spelling.groups(clash))] == ["abcdefgh"]
    assert spelling.groups(spark.createDataFrame([], DOCS)).count() == 0
    with pytest.raises(ValueError):
        spelling.groups(clash, least=4)


def test_query_same_as_plain(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows(queries.op11_spelling_variants(spark, sf)) == plain(docs)
