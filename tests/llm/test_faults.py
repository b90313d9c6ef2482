"""Cases that once went wrong."""

import pytest
from pyspark.sql import functions as F

from cloudloom.llm import html, katz

PROSE = "Real prose of an article that says something in a few longer sentences, so that nobody takes it for a menu or for a notice of any kind."


@pytest.mark.parametrize(
    ("inside", "dropped"),
    [
        (f'<h1>Title of it</h1><p class="ad">buy now<p>{PROSE} One.<p>{PROSE} Two.', "buy now"),
        (f'<p>{PROSE} One.</p><ul><li class="share">share this<li>{PROSE} Two.</ul><p>{PROSE} Three.', "share this"),
        (f'<p class="ad">buy now<div><p>{PROSE} One.</p></div>', "buy now"),
        (f'<table><tr><td class="advert">buy now<td>{PROSE} One.<tr><td>{PROSE} Two.</table>', "buy now"),
        (f'<dl><dt>Term<dd class="advert">buy now<dt>Other<dd>{PROSE} One.</dl>', "buy now"),
    ],
)
def test_end_tags_that_are_left_out(inside, dropped):
    text = html.main_text(f"<html><body><article>{inside}</article></body></html>")
    assert dropped not in text and text.count(PROSE) == inside.count(PROSE)


def test_words_of_one_polynomial_name(spark):
    """A Thue-Morse word and its complement agree in every polynomial modulo 2^64."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = spark.createDataFrame([(1, word), (2, other), (3, word)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in katz.score(rows, F.col("doc_id") > 1).collect()}
    assert got[2]["n_known"] == 1 and got[3]["n_known"] == 2 and got[2]["score"] < got[3]["score"]
