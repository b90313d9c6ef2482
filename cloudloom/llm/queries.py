"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontam, embed, html, katz, langid, linededup, negatives, simhash, spelling, suffix, tokenio
from .common import shared_dir, table

BYTE_BPE = "byte_bpe_50k.json"


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(table(spark, sf_dir, "pages"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


def op4_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return katz.score(docs, langid.fold(docs, "doc_id", 7) == 2)


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(langid.fold(docs, "doc_id", 5) != 0))
    return langid.predict(docs, model).select("doc_id", (langid.fold(docs, "doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/cloudloom/{uuid.uuid4().hex}/tokens"
    tokenio.write(table(spark, sf_dir, "documents"), path, public_tokenizers.path(BYTE_BPE))
    return tokenio.digest(spark, path)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.clusters(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.groups(table(spark, sf_dir, "documents"))


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(chat.probe(spark))
    return chat.digest(chat.format(turns))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0, label=label)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_line_dedup, op2_html_extraction, op3_bpe, op4_lm_scoring, op5_suffix_array_dedup, op6_embedding_near_dedup,
        op7_benchmark_decontamination, op8_language_id, op9_token_output, op10_simhash_near_dedup, op11_spelling_variants,
        op12_chat_formatting, op13_hard_negatives,
    )
}

ORACLE_SQL = {
    "op1_line_dedup": r"""
WITH raw AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS line FROM raw),
nb AS (SELECT doc_id, i, line, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS seq,
              lead(line) OVER (PARTITION BY doc_id ORDER BY i) AS nxt
       FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
marked AS (SELECT doc_id, i, seq,
                  length(line) >= 200 AND row_number() OVER (PARTITION BY line ORDER BY doc_id, seq) > 1 AS one,
                  nxt IS NOT NULL AND row_number() OVER (PARTITION BY line, nxt ORDER BY doc_id, seq) > 1 AS two FROM nb),
gone AS (SELECT doc_id, i FROM (SELECT doc_id, i, one OR two OR coalesce(lag(two) OVER (PARTITION BY doc_id ORDER BY seq), false) AS g FROM marked) WHERE g),
kept AS (SELECT l.doc_id, count(*) AS n_lines, count(g.i) AS n_removed,
                coalesce(string_agg(l.line, chr(10) ORDER BY l.i) FILTER (WHERE g.i IS NULL), '') AS text
         FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i GROUP BY l.doc_id)
SELECT r.doc_id, k.n_lines::BIGINT AS n_lines, k.n_removed::BIGINT AS n_removed,
       CASE WHEN r.text IS NULL THEN NULL ELSE k.text END AS text
FROM raw r JOIN kept k ON r.doc_id = k.doc_id
""",
    "op7_benchmark_decontamination": r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM dw WHERE len(w) > 0),
its AS (SELECT DISTINCT item_id, unnest(list_transform(range(greatest(len(w) - 4, 1)), lambda i: array_to_string(w[i + 1:i + 5], ' '))) AS s FROM iw WHERE len(w) > 0),
n AS (SELECT item_id, count(*) AS n_item FROM its GROUP BY 1),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM its JOIN ds USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n_shared::BIGINT AS n_shared, n_item::BIGINT AS n_item, n_shared::DOUBLE / n_item AS containment
FROM hit JOIN n USING (item_id) WHERE n_shared >= ceil(0.8 * n_item - 1e-9)
""",
    "op6_embedding_near_dedup": r"""
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
ok AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v
       WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.98),
reach(s, t) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.s, l.b FROM reach r JOIN links l ON r.t = l.a),
comp AS (SELECT s AS vec_id, min(t) AS component_id FROM reach GROUP BY s),
deg AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, coalesce(d.n, 0)::BIGINT AS n_links, c.component_id::BIGINT AS component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN comp c USING (vec_id) LEFT JOIN deg d USING (vec_id)
""",
    "op12_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS seq,
             4 + len(regexp_extract_all(text, '[\p{L}\p{N}]+|[^\p{L}\p{N}\x20\x09-\x0D]')) AS tokens,
             replace(replace(replace(replace(replace(replace(replace(replace(replace(text, '\', '\\'), '<s>', '<\s>'), '</s>', '<\/s>'), '[INST]', '[\INST]'),
                     '[/INST]', '[\/INST]'), '<<SYS>>', '<\<SYS>>'), '<</SYS>>', '<\</SYS>>'), '<|im_start|>', '<\|im_start|>'), '<|im_end|>', '<\|im_end|>') AS body FROM c),
s AS (SELECT *, 3 + length(url_encode(role)) + 1 + length(body) + 4 AS size,
             coalesce(max(CASE WHEN seq = 0 AND role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS held FROM e),
p AS (SELECT *, seq = 0 AND held > 0 AS first, greatest(1024 - 128 - held, 256) // 2 AS half, greatest(1024 - 128 - held, 256) AS room,
             greatest(coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - held, 0)::BIGINT AS begin FROM s),
w AS (SELECT *, begin // half AS cell, NOT first AND begin % half > 0 AND begin % half + tokens > room AS alone FROM p),
o AS (SELECT conv_id, cell, alone, sum(size) AS size, min(seq) AS seq, min(begin) FILTER (WHERE NOT first) AS begin FROM w GROUP BY ALL),
h AS (SELECT o.conv_id, o.cell, o.alone, sum(w.size) AS size FROM o JOIN w ON o.conv_id = w.conv_id AND NOT w.first AND w.begin < o.begin AND w.begin >= o.begin - 128 GROUP BY ALL),
f AS (SELECT o.conv_id, sum(o.size + coalesce(h.size, 0) + CASE WHEN o.seq > 0 THEN coalesce(y.size, 0) ELSE 0 END) AS formatted_chars
      FROM o LEFT JOIN h ON h.conv_id = o.conv_id AND h.cell = o.cell AND h.alone = o.alone LEFT JOIN (SELECT conv_id, size FROM w WHERE first) y ON y.conv_id = o.conv_id GROUP BY 1),
d AS (SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY seq)) AS turns_sha256,
             coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE role = 'assistant'), '') AS loss FROM e GROUP BY 1)
SELECT conv_id, n_turns::BIGINT AS n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars::BIGINT AS formatted_chars FROM d JOIN f USING (conv_id)
""",
    "op13_hard_negatives": r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, embedding::DOUBLE[] AS e FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
w AS (SELECT vec_id, label, list_transform(e, lambda x: floor(256 * x)) AS e FROM v),
s AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS score
      FROM w a JOIN w b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)),
p AS (SELECT a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, b) AS k FROM s WHERE same) WHERE k <= 5),
n AS (SELECT p.a AS anchor_id, p.b AS positive_id, s.b AS negative_id, p.score AS positive_score, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b) AS rank
      FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5
""",
}
