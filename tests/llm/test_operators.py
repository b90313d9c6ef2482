"""Small and odd inputs, and plain versions to compare with, for every operator."""

import hashlib
import random
import time
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

import public_tokenizers
from cloudloom.llm import bpe, decontam, embed, graph, html, katz, langid, linededup, queries, simhash, suffix, tokenio

from . import plain

BPE = public_tokenizers.path(queries.BYTE_BPE)
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])
WORDS = "the of and to in is was on be with as by at from this that are for or an haus baum straße ñandú été".split()


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + (r.choice("abcdef") * r.randrange(3)) for _ in range(n))


def odd_docs():
    """Nulls, empties, repeats of rows and texts, a long text, shared passages."""
    p = prose(1, 80)
    long = "\n".join(prose(k, 30) for k in range(100))
    return [
        (1, p), (2, p), (3, None), (4, ""), (5, "   \n\n"), (6, "x"), (7, prose(2, 60) + "\n" + p + "\n" + prose(3, 20)), (8, long), (9, long + " end"), (10, p), (10, p),
        (None, prose(4, 50)), (None, None), (11, "aaaa " * 120), (12, "a" * 500), (13, "été 🙂 ñ\x00 'll 123 <|endoftext|> x"), (14, prose(5, 3)),
    ]


@pytest.fixture(scope="module")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def doc_rows(documents):
    return [(r["doc_id"], r["text"]) for r in documents.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(name, spark, sf, same_as_sql):
    same_as_sql(queries.QUERIES[name](spark, sf), queries.ORACLE_SQL[name])


# --- line dedup ------------------------------------------------------------------------------------


def _plain_gone(rows, min_lines=2):
    """The removed lines (none is blank) of each document."""
    seen, out = set(), {}
    for k, t in rows:
        lines = t.split("\n") if t else []
        out[k] = set()
        for i in range(len(lines) - min_lines + 1):
            run = tuple(lines[i : i + min_lines])
            if run in seen:
                out[k] |= {*range(i, i + min_lines)}
            seen.add(run)
    return out


def _plain_lines(rows, min_lines=2, min_chars=200):
    docs = [(k, (t or "").split("\n")) for k, t in rows]
    seen, out = set(), []
    for k, lines in docs:
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\r\x0b\x0c")]
        gone = set()
        for j, i in enumerate(at):
            one, run = (lines[i],), tuple(lines[p] for p in at[j : j + min_lines])
            if (1, one) in seen and len(lines[i]) >= min_chars:
                gone.add(i)
            if len(run) == min_lines and (min_lines, run) in seen:
                gone |= {*at[j : j + min_lines]}
            seen.add((1, one))
            seen.add((min_lines, run))
        out.append((k, "\n".join(x for i, x in enumerate(lines) if i not in gone), len(lines), len(gone)))
    return out


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup_is_the_plain_one(spark, min_lines):
    r = random.Random(min_lines)
    rows = [(k, "\n".join(r.choice(["a", "b", "c", "", " ", "d" * 250]) for _ in range(r.randrange(12)))) for k in range(60)]
    got = linededup.dedup(frame(spark, rows), min_lines=min_lines).orderBy("doc_id").collect()
    assert [(g["doc_id"], g["text"], g["n_lines"], g["n_removed"]) for g in got] == _plain_lines(rows, min_lines)


def test_line_dedup_odd(spark):
    df = frame(spark, odd_docs()).withColumns({"n_lines": F.lit("x"), "rank": F.lit(1), "a.b": F.lit(2), "first": F.lit(3), "__gone": F.lit(4), "__doc": F.lit(5), "row": F.lit(6), "hash": F.lit(7), "kept": F.lit(8), "runs": F.lit(9)})
    out = linededup.dedup(df)
    rows = out.collect()
    assert len(rows) == len(odd_docs()) and {"rank", "a.b", "first"} <= {*out.columns}
    by = {(r["doc_id"], r["text"]): r for r in rows}
    assert (None, None) in by and (4, "") in by and (5, "   \n\n") in by
    assert sum(r["n_removed"] for r in rows if r["doc_id"] == 2) == 1
    assert linededup.dedup(frame(spark, [])).count() == 0
    kept = linededup.clean(df)
    assert {r["a.b"] for r in rows} == {2} and {r["kept"] for r in rows} == {8}
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} >= {1, 3, 4, 5, 6} and not {2} & {r["doc_id"] for r in kept.collect()}


def test_line_dedup_finds_maximal_runs(spark):
    r = random.Random(8)
    rows = [(k, "\n".join(r.choice("abc") for _ in range(r.randrange(30)))) for k in range(20)] + [(50 + k, "\n".join(f"line {i}" for i in range(100 * k, 137))) for k in range(2)]
    df = frame(spark, rows)
    deepest = linededup.copies(df).agg(F.max("n")).first()[0]
    assert deepest == 32  # 37 lines repeat: the doubling goes on to 32, and 64 tells all apart
    runs = {(x["doc"], x["first_line"], x["n_lines"]) for x in linededup.maximal_runs(df).collect()}
    want = set()
    for (k, _), (_, text, n, gone) in zip(rows, _plain_lines(rows), strict=True):
        own = sorted(_plain_gone(rows)[k])
        start = None
        for i in own:
            if i - 1 not in own:
                start = i
            if i + 1 not in own:
                want.add((k, start, i - start + 1))
    assert runs == want


# --- HTML ------------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav>
<div class="cookie-notice">We use cookies on this site, please accept them all now.</div><div id="sidebar"><p>Related things you may want to read some time later today.</p></div>
<!-- <p>no</p> --><article><h1>A &amp; B</h1><p>First   paragraph &lt;here&gt; with <b>bold</b> and a <a href="x">link</a>.</p><div class="ad">Buy this now</div><p>Second&nbsp;one.<p>Third
line</article><div class="comments"><p>I think that this is a very good article and I want to say so at length.</p></div>
<form><label>Name</label><input><textarea>zzz</textarea></form><footer>&copy; 2020</footer></body></html>"""


def test_html_page():
    assert html.main_text(PAGE) == "A & B\nFirst paragraph <here> with bold and a link.\nSecond one.\nThird line"
    for odd in (None, "", "   ", "<", "<p", "<!-- x", "<script>x", "</div></p>"):
        assert html.main_text(odd) in ("", "<", "<p")


def test_html_without_article():
    body = "".join(f"<p>{prose(k, 60)}</p>" for k in range(4))
    page = f"<body><div class=menu><a href=a>A</a> <a href=b>B</a></div><div>{body}</div><div class=footer>bye</div></body>"
    assert html.main_text(page) == "\n".join(" ".join(prose(k, 60).split()) for k in range(4))


def test_html_silent_elements_end():
    shown = lambda page: [b[0] for b in html.blocks(page)]
    assert shown('<p>a <svg width="1"/> b</p><p>c</p>') == ["a b", "c"] == shown("<p>a <math/> b</p><p>c</p>")
    for tag in html.SILENT:
        assert shown(f"<p>a <{tag}>x</{tag}> b</p><p>c</p>") == ["a b", "c"]
        assert shown(f"<div><p>a</p><div><{tag}>x</div><p>b</p></div><p>c</p>") == ["a", "b", "c"]
        assert shown(f"<p>a <{tag}><b>x</b><i>y<div><p>z</p></{tag}>b</p><p>c</p>") == ["a b", "c"]
    assert shown("<p>a <a href=x><svg><path d='M0'/></a> b</p><svg><svg>x</svg>y</svg><p>c</p>") == ["a b", "c"]
    for tag in html.RAW:
        assert shown(f"<p>a</p><{tag}>x<p>b</p>") == ["a"]


def test_html_tree_and_held_out_pages():
    x, y = html.labelled_blocks()
    used, todo = set(), [html.default_tree()]
    while todo:
        t = todo.pop()
        if len(t) > 1:
            used.add(html.FEATURES[t[0]])
            todo += t[2:]
    assert {"words", "links"} <= used and used & {"links_before", "links_after"} and used & {"words_before", "words_after"}
    assert ((html.apply_tree(html.default_tree(), x) > 0.5) == y).mean() >= 0.97
    pages = html.LABELLED.strip().splitlines()
    right = n = 0
    for k in range(len(pages)):  # each page by a tree that has not seen it
        tree = html.fit_tree(*html.labelled_blocks("\n".join(pages[:k] + pages[k + 1 :])))
        x, y = html.labelled_blocks(pages[k])
        right, n = right + int(((html.apply_tree(tree, x) > 0.5) == y).sum()), n + len(y)
    assert right >= 0.93 * n


def test_html_hostile_markup():
    import time

    page = "<body><article><p>%s</p></article></body>"
    text = " ".join(prose(1, 60).split())
    for odd in ('<video-player src="x"></video-player>', '<title-bar>t</title-bar>', "<svg width=1 />", '<object-x/>'):
        assert html.main_text(page % (odd + text)).endswith(text)
    assert html.main_text(page % f'{text}</p><section id="search"><p>{text}</p></section><section class="legal"><p>{text}') == "\n".join([text] * 3)
    began = time.perf_counter()
    for bad in ("<a ", "<a '", '<a "', "<!", "<!--", "<script ", "</", "<p title='\">"):
        html.main_text(page % (bad * 100_000))
    assert time.perf_counter() - began < 20


class _Article(HTMLParser):
    """Another way to the main text of the given pages: what the parser of the standard library finds inside the article element."""

    def __init__(self, page):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.parts = False, [], []
        self.feed(page)
        self.close()

    def end(self):
        text = " ".join("".join(self.parts).split())
        self.parts = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article"):
            self.end()
        self.parts += [" "] * (tag == "br")
        self.inside |= tag == "article"

    def handle_endtag(self, tag):
        if tag in ("p", "h1", "h2", "h3", "li", "ul", "div", "article"):
            self.end()
        self.inside &= tag != "article"

    def handle_data(self, data):
        if self.inside:
            self.parts.append(data)


def test_html_is_the_article_of_each_page(spark, sf):
    rows = spark.read.parquet(f"{sf}/pages.parquet").collect()
    got = {r["page_id"]: r["text"] for r in queries.op2_html_extraction(spark, sf).collect()}
    assert got == {r["page_id"]: "\n".join(_Article(r["html"]).blocks) for r in rows}


def test_html_empty_table_and_other_columns(spark):
    df = spark.createDataFrame([(1, "u", "<p>" + prose(1, 60) + "</p>", "x", 3)], "page_id long, url string, html string, text string, n_chars int")
    assert html.extract(df).first()["text"] == " ".join(prose(1, 60).split())
    assert html.extract(df.filter("false")).count() == 0


def test_html_query(spark, sf):
    rows = queries.op2_html_extraction(spark, sf).collect()
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) and r["text"] == html.main_text(pages[r["page_id"]]) for r in rows)
    assert html.extract(spark.createDataFrame([(1, "u", None), (1, "u", None)], "page_id long, url string, html string")).collect()[0]["text"] == ""


# --- BPE and token files ---------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


def test_bpe_is_the_library(spark, lib, documents, doc_rows):
    rows = doc_rows + odd_docs()
    df = documents.select("doc_id", "text").unionByName(frame(spark, odd_docs()))
    want = []
    for k, t in rows:
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, bpe.digest(df, BPE).collect()))) == sorted(map(repr, want))


def test_bpe_long_pretokens_are_the_library(lib):
    r = random.Random(8)
    codec = bpe.Codec(BPE)
    texts = ["".join(r.choices(alphabet, k=n)) for alphabet in ("abeht", "a", ["the", "ing", "zz", "été", "日本"], "-=_#") for n in (bpe.LONG - 1, bpe.LONG, bpe.LONG + 1, 5000)]
    texts += [" ".join("".join(r.choices("aehnt", k=r.randint(1, 900))) for _ in range(6)) for _ in range(50)]
    ids, counts, _ = codec.encode(texts)
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [i for w in want for i in w]
    blank_free = "".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    began = time.perf_counter()
    ids, _, _ = codec.encode([blank_free])
    assert time.perf_counter() - began < 30  # rounds over all symbols took minutes
    assert ids.tolist() == lib.encode(blank_free, add_special_tokens=False).ids


def test_bpe_round_trip_and_bad_ids(spark):
    df = frame(spark, odd_docs())
    both = bpe.decode(bpe.encode(df, BPE), BPE).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in both)
    odd = spark.createDataFrame([([999999, -1, 64], ), (None,), ([],), ([None, 64],), ([172],)], "ids array<int>")
    assert sorted(r["decoded"] for r in bpe.decode(odd, BPE).collect()) == sorted(["a", "", "", "a", bpe.codec(BPE).decode(np.array([172]), np.array([1]))[0].decode()])
    with pytest.raises(ValueError):
        bpe.encode(df.withColumn("ids", F.lit(1)), BPE)
    assert bpe.digest(frame(spark, []), BPE).count() == 0


@pytest.mark.parametrize("n,high", [(0, 1), (1, 1), (7, 3), (1000, 50257), (5000, 2), (60000, 300), (9000, 1 << 17)])
def test_range_coder_round_trip(n, high):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.3, n), high - 1) if high > 1 else np.zeros(n, np.int64)
    raw = tokenio.encode_block(ids.astype(np.int64))
    assert np.array_equal(tokenio.decode_block(raw), ids)
    if n:
        for at in (0, len(raw) // 2, len(raw) - 1):
            bad = bytearray(raw)
            bad[at] ^= 0x5A
            with pytest.raises(ValueError):
                tokenio.decode_block(bytes(bad))
        with pytest.raises(ValueError):
            tokenio.decode_block(raw[:-2])


def test_range_coder_compresses():
    ids = np.tile(np.arange(100), 2000)
    assert len(tokenio.encode_block(ids)) < len(ids) * 0.25


def test_token_files(spark, sf, lib, doc_rows):
    want = plain.token_rows(doc_rows, lambda t: lib.encode(t, add_special_tokens=False).ids)
    assert sorted(map(tuple, queries.op9_token_output(spark, sf).collect())) == want


def test_token_files_odd(spark, lib, tmp_path):
    rows = odd_docs()
    tokenio.write(frame(spark, rows), str(tmp_path / "t"), BPE, block_ids=300)
    got = tokenio.read(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert sorted(map(repr, ((r["doc_id"], r["ids"]) for r in got))) == sorted(map(repr, ((k, [*lib.encode(t or "", add_special_tokens=False).ids, 0]) for k, t in rows)))
    assert [r["start"] for r in got] == [sum(len(x["ids"]) for x in got[:i]) for i in range(len(got))]
    tokenio.write(frame(spark, []), str(tmp_path / "e"), BPE)
    assert tokenio.digest(spark, str(tmp_path / "e")).count() == 0


def _thue_morse(n, a="a", b="b"):
    return "".join(b if k.bit_count() & 1 else a for k in range(n))


def test_token_files_do_not_confuse_words(spark, lib, tmp_path, monkeypatch):
    # words whose names by a polynomial modulo 2^64 are equal, and words around the longest key
    texts = [_thue_morse(1024), _thue_morse(1024, "b", "a"), "x" * 64, "x" * 65, "x" * 64 + "y", "ab\x00", "ab", "ab\x00\x00", *(prose(k, 40) for k in range(5))]
    want = [lib.encode(t, add_special_tokens=False).ids for t in texts]
    for broken in (False, True):
        if broken:  # every pre-token has the same key: bytes alone must decide
            monkeypatch.setattr(tokenio, "mix", lambda h: h * np.uint64(0))
        own = tokenio.Encoder(BPE)
        for _ in range(2):
            ids, counts = own.encode(texts)
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == want


# --- LM scoring ------------------------------------------------------------------------------------


def _katz(spark, rows):
    df = frame(spark, rows)
    got = katz.score(df, langid.fold(df, "doc_id", 7) == 2).collect()
    model = plain.Katz([t for k, t in rows if k is None or zlib.crc32(str(k).encode()) % 7 != 2])
    want = {}
    for k, t in rows:
        want.setdefault(k, []).append(model.score(t))
    assert len(got) == len(rows)
    for r in got:
        assert any(r["n_tokens"] == n and r["n_known"] == known and abs(r["base_score"] - base) < 1e-6 and abs(r["score"] - s) < 1e-6 for n, known, base, s in want[r["doc_id"]])
        assert r["train_tokens"] == model.n


def test_katz_is_the_plain_one(spark, doc_rows):
    _katz(spark, doc_rows[:60])
    _katz(spark, odd_docs())


def test_katz_sums_to_one(doc_rows):
    model = plain.Katz([t for _, t in doc_rows[:20]])
    for h in [0, *list(model.uni)[:5]]:
        assert sum(model.prob(w, h) for w in model.uni) + model.backoff(h)[0] * model.unk == pytest.approx(1.0)


def test_katz_without_training_or_rows(spark):
    df = frame(spark, [(1, "a b"), (2, None)])
    rows = katz.score(df, F.lit(True)).collect()
    assert {(r["n_known"], r["train_tokens"]) for r in rows} == {(0, 0)}
    assert katz.score(frame(spark, []), F.lit(False)).count() == 0


# --- suffix-array dedup ----------------------------------------------------------------------------


def _suffix(spark, rows, length, gram):
    got = suffix.dedup(frame(spark, rows), length=length, gram=gram).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, plain.suffix_dedup(rows, length)))


def test_suffix_dedup_is_the_plain_one(spark, doc_rows):
    _suffix(spark, doc_rows, 200, 32)
    _suffix(spark, odd_docs(), 200, 32)
    assert suffix.dedup(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_suffix_dedup_random(spark, seed, monkeypatch):
    monkeypatch.setattr(suffix, "HOT", 3)  # split anchors, too
    r = random.Random(seed)
    bits = ["".join(r.choice("ab") for _ in range(r.randrange(1, 60))) for _ in range(12)]
    rows = [(k, "".join(r.choice(bits) for _ in range(r.randrange(8)))) for k in range(40)]
    _suffix(spark, rows, 20, 6)


def test_repeated_starts_and_trie():
    r = random.Random(0)
    raw = bytes(r.choice(b"ab") for _ in range(300)) + b"z" * 150
    flat = np.frombuffer(raw, np.uint8)
    starts = np.arange(len(raw) - 90)
    group = np.array([r.randrange(2) for _ in starts])
    got = suffix.repeated_starts(flat, starts, group, 90)
    seen = [(g, raw[s : s + 90]) for s, g in zip(starts.tolist(), group.tolist(), strict=True)]
    assert got.tolist() == [seen.count(x) > 1 for x in seen]
    strings = [raw[s : s + 6] for s in range(200)]
    groups = list(suffix.BlindTrie(strings).groups())
    assert [strings[g[0]] for g in groups] == sorted(set(strings)) and sorted(i for g in groups for i in g) == list(range(200))


# --- embeddings ------------------------------------------------------------------------------------


def test_embeddings_recall_and_counts(spark):
    r = np.random.default_rng(0)
    base = r.standard_normal((60, 24))
    rows = []
    for i in range(900):
        v = base[i % 60] + r.standard_normal(24) * (0.02 if i % 3 else 1.0)
        rows.append((i, v.tolist(), i % 2))
    rows += [(2000 + i, (base[0] + r.standard_normal(24) * 1e-3).tolist(), 0) for i in range(700)]  # a large group of copies
    rows += [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 24, 0), (3003, [float("nan")] * 24, 0), (3004, [None] * 24, 0), (3005, base[0].tolist(), None), (3006, [1.0] * 8, 0), (3007, [1e-300] * 8, 0), (3008, [1e300] * 8, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {g["vec_id"]: g for g in embed.near_duplicates(df).collect()}
    ok = [(i, np.array(v) / np.abs(v).max(), y) for i, v, y in rows if v and y is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i, _, _ in rows}
    for a, (i, v, y) in enumerate(ok):
        for j, w, z in ok[a + 1 :]:
            if y == z and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.98:
                links[i].add(j)
                links[j].add(i)
    assert {i: g["n_links"] for i, g in got.items()} == {i: len(x) for i, x in links.items()}
    seen = {}
    for i in sorted(links):
        if i not in seen:
            todo = [i]
            while todo:
                k = todo.pop()
                if k not in seen:
                    seen[k] = i
                    todo += links[k]
    assert {i: g["component_id"] for i, g in got.items()} == seen and all(g["kept"] == (seen[i] == i) for i, g in got.items())
    assert embed.near_duplicates(df.filter("false")).count() == 0


def test_embeddings_recall_in_a_dense_cone(spark, monkeypatch):
    r = np.random.default_rng(5)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    axis = unit(r.standard_normal((1, 64)))
    cone = unit(axis + unit(r.standard_normal((6000, 64))) / 3)  # mutual cosine 0.9
    n = 300
    step = unit(r.standard_normal((n, 64)))
    step = unit(step - (step * cone[:n]).sum(axis=1, keepdims=True) * cone[:n])
    cone[n : 2 * n] = 0.981 * cone[:n] + np.sqrt(1 - 0.981**2) * step
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(cone)], "vec_id long, embedding array<double>, label int")
    near = cone @ cone.T >= 0.98
    want = {i: int(near[i].sum()) - 1 for i in range(len(cone))}
    for bits in (embed.BITS, (4,)):
        monkeypatch.setattr(embed, "BITS", bits)
        assert {g["vec_id"]: g["n_links"] for g in embed.near_duplicates(df).collect()} == want


def test_components(spark):
    r = random.Random(1)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {g["node"]: g["component"] for g in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    low = {n: n for p in pairs if None not in p and p[0] != p[1] for n in p}
    for _ in range(1200):
        for a, b in pairs:
            if a is not None and a != b:
                low[a] = low[b] = min(low[a], low[b])
    assert got == low
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_components_never_returns_unfinished_ones(spark):
    with pytest.raises(RuntimeError):
        graph.components(spark.createDataFrame([(k, k + 1) for k in range(100)], "a long, b long"), rounds=1)


# --- decontamination -------------------------------------------------------------------------------


def _plain_contained(docs, items):
    sets = [(i, decontam.shingles(t, 5)) for i, t in items]
    out = []
    for k, t in docs:
        own = decontam.shingles(t, 5)
        out += [(k, i, len(s & own), len(s)) for i, s in sets if s and len(s & own) >= 0.8 * len(s) - 1e-9]
    return out


@pytest.mark.parametrize("block", [40, 10**6])
def test_decontamination_is_the_plain_one(spark, block):
    docs = odd_docs()
    items = [(1, prose(1, 80)), (2, prose(2, 60).upper()), (3, None), (4, ""), (5, "x"), (6, " ".join(prose(3, 20).split()[:19] + ["zz"])), (7, prose(9, 30)), (7, prose(4, 50)), (8, "..."), (9, "A, b. c")]
    found = decontam.contained(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block)
    assert sorted(map(repr, (tuple(r)[:4] for r in found.collect()))) == sorted(map(repr, _plain_contained(docs, items)))
    left = decontam.clean(frame(spark, docs).withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id long, text string"), block_shingles=block)
    bad = {(k, t) for k, t in docs if _plain_contained([(k, t)], items)}
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in left.collect()))) == sorted(map(repr, (d for d in docs if d not in bad)))
    assert decontam.contained(frame(spark, docs), spark.createDataFrame([], "item_id long, text string")).count() == 0


# --- language ID -----------------------------------------------------------------------------------


def test_language_held_out(spark, sf, documents):
    got = queries.op8_language_id(spark, sf).join(documents.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang"] == r["lang_pred"] for r in held) >= 0.95 * len(held) and all(0 <= r["score"] <= 1 for r in got)


def test_language_is_the_plain_one(spark, documents, doc_rows):
    rows = [(r["text"], r["lang"]) for r in documents.collect()]
    want = plain.WordFirst([(t, y) for t, y in rows if t is not None and y is not None])
    texts = [t or "" for t, _ in rows] + ["½ ② Ⅷ", "zzqx", "Straße 123", "ñandú ñandú", "xx " * 500 + "der und die"]
    langs, scores, sure = langid.Scorer(langid.fit(documents)).predict(texts)
    for t, name, score, known in zip(texts, langs, scores, sure, strict=True):
        top, value, any_known = want.predict(t)
        assert (name, known) == (top, any_known) and abs(score - value) < 1e-9
    assert langs[-5] == "und" and scores[-5] == 0


def test_language_many_and_long_rows(spark):
    rows = [(k, f"w{chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" * 2, f"l{k:04d}") for k in range(1300)]  # more languages than any cap
    labelled = spark.createDataFrame([*rows, (9999, "x" * 300_000, "l0000")], "doc_id long, text string, lang string")
    model = langid.fit(labelled)
    assert len(model["langs"]) == 1300 and max(map(len, model["index"][0])) < 300_000
    got = langid.predict(labelled.filter("doc_id < 9999"), model).collect()
    assert {r["doc_id"]: r["lang_pred"] for r in got} == {k: y for k, _, y in rows}
    few = langid.fit(labelled, sample_rows=130)
    assert 60 <= len(few["langs"]) <= 230  # the bound of the sample
    for key in (None, 7):  # null and repeated keys are drawn like others, a row that repeats is drawn once
        same = spark.createDataFrame([(key, f"text {k}", "en") for k in range(5000)] + [(key, "again", "en")] * 5000, "doc_id long, text string, lang string")
        drawn = langid.sample(same, "doc_id", "text", "lang", 1000, 50_000, 200_000)
        assert 350 <= drawn.count() <= 650 and drawn.filter("text = 'again'").count() <= 1


def test_language_odd(spark, documents):
    model = langid.fit(documents)
    got = langid.predict(frame(spark, odd_docs()), model).collect()
    assert len(got) == len(odd_docs()) and sum(r["lang_pred"] == "und" for r in got) == 4
    df = frame(spark, odd_docs()).withColumns({"lang_pred": F.lit("x"), "score": F.lit(1)})
    assert langid.keep_known(frame(spark, [(1, "½ Ⅷ"), (2, "\u4e2d"), (3, "the")]), model).first()["doc_id"] == 3  # nothing of the second is known
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and kept.count() == len(odd_docs()) - 4
    none = langid.fit(documents.filter("false"))
    assert {r["lang_pred"] for r in langid.predict(frame(spark, odd_docs()), none).collect()} == {"und"}
    assert langid.predict(frame(spark, []), model).count() == 0


# --- SimHash ---------------------------------------------------------------------------------------


def _plain_simhash(rows, distance=4, words=4):
    fps = [simhash.fingerprint(t or "", words) for _, t in rows]
    low = list(range(len(rows)))
    for _ in rows:
        before = low[:]
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (fps[i] ^ fps[j]).bit_count() <= distance:
                    low[i] = min(low[i], low[j])
        if low == before:
            break
    least = {}
    for (k, _), c in zip(rows, low, strict=True):
        if k is not None:
            least[c] = min(least.get(c, k), k)
    return sorted((repr(k), f, repr(least.get(c))) for (k, _), f, c in zip(rows, fps, low, strict=True))


def test_simhash_is_the_plain_one(spark, doc_rows):
    for rows in (doc_rows, odd_docs()):
        got = simhash.clusters(frame(spark, rows)).collect()
        assert sorted((repr(r["doc_id"]), r["fp"] & (2**64 - 1), repr(r["component_id"])) for r in got) == _plain_simhash(rows)
    assert simhash.clusters(frame(spark, [])).count() == 0


def test_simhash_fingerprint():
    import xxhash

    toks = "a b c d e".split()
    want = 0
    h = [xxhash.xxh64_intdigest(" ".join(toks[i : i + 4]), 42) for i in range(2)]
    for b in range(64):
        if sum(x >> b & 1 for x in h) * 2 > 2:
            want |= 1 << b
    assert simhash.fingerprint("A  b\tC d\nE") == want and simhash.fingerprint("") == 0 and simhash.fingerprint("x y") == xxhash.xxh64_intdigest("x y", 42)


@pytest.mark.parametrize("distance", [0, 1, 3, 4, 7])
def test_simhash_links_lose_nothing(spark, distance):
    r = random.Random(distance)
    base = [r.getrandbits(64) for _ in range(150)]
    fps = set(base)
    for v in base:
        for _ in range(2):
            w = v
            for b in r.sample(range(64), r.randrange(1, distance + 3)):
                w ^= 1 << b
            fps.add(w)
    signed = [v - (1 << 64) if v >> 63 else v for v in fps]
    got = {(g["a"], g["b"]) for g in simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), distance).collect()}
    u = lambda v: v & (2**64 - 1)
    assert got == {(a, b) for a in signed for b in signed if a < b and (u(a) ^ u(b)).bit_count() <= distance}


def test_simhash_plan_sums():
    fps = np.random.default_rng(0).integers(0, 1 << 63, 500, dtype=np.uint64)
    for total in (500, 10**6, 10**9):
        parts = simhash.plan(fps, total, 4)
        assert sum(t for _, t in parts) == 4 - len(parts) + 1 and sorted(b for p, _ in parts for b in p) == list(range(64))


def test_keep_first(spark):
    rows = [(3, prose(1, 200)), (1, prose(1, 200)), (2, prose(2, 200)), (None, prose(3, 200)), (4, None), (5, "")]
    got = simhash.keep_first(frame(spark, rows).withColumn("component_id", F.lit(0)))
    assert sorted(r["doc_id"] for r in got.collect() if r["doc_id"]) == [1, 2, 4]


def _words_sets(text, words=5):
    own = (text or "").lower().split()
    return {tuple(own[i : i + words]) for i in range(max(1, len(own) - words + 1))} if own else set()


def _plain_keep_first(rows, similarity=0.8):
    sets = [_words_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= similarity * len(sets[i] | sets[j]) - 1e-9:
                root[top(i)] = top(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[top(i)] = min(k, least.get(top(i), k))
    kept = {k for i, (k, _) in enumerate(rows) if k is not None and least[top(i)] == k}
    return sorted(repr(k) for k, _ in rows if k is None or k in kept)


def test_keep_first_takes_every_similar_pair(spark, monkeypatch):
    from cloudloom.llm import setjoin

    r, rows = random.Random(3), []
    for k in range(60):  # copies with 1 to 8 words of 150 replaced: similarities from 0.6 to 0.95
        own = [f"w{r.randrange(5000)}" for _ in range(150)]
        rows.append((len(rows), " ".join(own)))
        for at in r.sample(range(150), 1 + k % 8):
            own[at] = f"x{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(own)))
    run = "a b c d e f g h i j " * 400  # a repeated run decides both fingerprints, not the sets
    rows += [(len(rows) + i, run + prose(100 + i, 60)) for i in range(2)]
    base = prose(90, 200).split()
    for i in range(40):  # a group of near copies that share a common passage
        own = list(base)
        for at in r.sample(range(200), 3):
            own[at] = f"y{i}_{at}"
        rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + i, prose(200 + i, 60) + " one common passage of many words that stays " + prose(300 + i, 9)) for i in range(20)]
    rows += [*odd_docs(), (500, ""), (501, "X"), (502, None)]
    rows = [(None if k is None else k + 1000 * (n > 185), t) for n, (k, t) in enumerate(rows)]
    want = _plain_keep_first(rows)
    for share, rounds in ((0.05, 6), (1.0, 0)):
        monkeypatch.setattr(setjoin, "SHARE", share)
        monkeypatch.setattr(setjoin, "ROUNDS", rounds)
        assert sorted(repr(x["doc_id"]) for x in simhash.keep_first(frame(spark, rows)).collect()) == want
    assert simhash.keep_first(frame(spark, [])).count() == 0


# --- the pipeline ----------------------------------------------------------------------------------


def _pipeline_rows():
    r = random.Random(11)
    rows = []
    for k in range(40):
        rows.append((len(rows), "\n".join(prose(1000 + 7 * k + i, r.randrange(5, 40)) for i in range(r.randrange(1, 8))), r.choice(["en", "de", None])))
    rows += [(len(rows) + i, t, None if i == 5 else "en") for i, t in enumerate([rows[3][1], rows[3][1] + " more", None, "", "12 ½ 3", "\u4e2d\u6587", rows[5][1] + "\n" + rows[6][1]])]
    own = prose(77, 150).split()
    for i in range(6):  # near copies, on one line
        own[20 * i] = f"zz{i}"
        rows.append((len(rows), " ".join(own), "de"))
    rows.append((len(rows), prose(5, 20) + " " + prose(500, 30) + " " + prose(6, 20), "en"))
    return rows


def test_pipeline_is_the_plain_one(spark, lib, tmp_path):
    import corpus_pipeline

    rows, items = _pipeline_rows(), [(1, prose(500, 30)), (2, prose(501, 30)), (3, None)]
    schema = "doc_id long, text string, lang string"
    spark.createDataFrame(rows, schema).selectExpr("*", "'s' as source", "1 as sid", "2 as row", "3 as gone", "4 as __kept").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    model = plain.WordFirst([(t, y) for _, t, y in rows if t is not None and y is not None])
    docs = [(k, t) for k, t, _ in rows if t and model.predict(t)[2]]
    assert {k for k, t, _ in rows} - {k for k, _ in docs} == {42, 43, 44, 45}
    docs = [(k, t) for (k, t, _, gone), (_, old) in zip(_plain_lines(docs), docs, strict=True) if gone < sum(bool(x.strip(" \t\n\r\x0b\x0c")) for x in old.split("\n"))]
    kept = _plain_keep_first(docs)
    assert len(kept) < len(docs)
    docs = [(k, t) for k, t in docs if repr(k) in kept]
    clean = [(k, t) for k, t in docs if not _plain_contained([(k, t)], items)]
    assert len(clean) == len(docs) - 1
    want = []
    for k, t in clean:
        ids = lib.encode(t, add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest()))
    assert sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == want


def test_pipeline_of_empty_tables(spark, sf, tmp_path):
    import corpus_pipeline

    for name in ("documents", "benchmark"):
        spark.read.parquet(f"{sf}/{name}.parquet").filter("false").write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
