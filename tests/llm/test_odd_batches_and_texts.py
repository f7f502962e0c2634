"""Replayed batches, odd memberships, and texts that are malformed, very long or repeat themselves."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from chalkline.llm import bpe, exact_dedup, html_text, license_scan, mixing, topk, warc
from chalkline.llm.license_texts import TEMPLATES


def as_rows(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


# -- op1 --------------------------------------------------------------------------------------

ARTICLE = "<article><h1>Head</h1><p>One paragraph, long enough to count, with a few signs; and a second sentence in it.</p><p>Another one, which says more about the matter, and ends here.</p>{}</article>"
ARTICLE_TEXT = "Head One paragraph, long enough to count, with a few signs; and a second sentence in it. Another one, which says more about the matter, and ends here."


@pytest.mark.parametrize("name", ['id="comments"', 'class="replies"', 'class="sponsored ads"', 'class="disqus thread"'])
def test_long_comments_are_no_article(name):
    said = "".join(f"<div><p>I have read it {i} times, and, well, I do agree with all of it; thank you very much for writing this up!</p></div>" for i in range(30))
    assert html_text.main_text(f"<html><body>{ARTICLE.format('')}<section {name}>{said}</section></body></html>") == ARTICLE_TEXT
    assert html_text.main_text(f"<html><body><section {name}>{said}</section>{ARTICLE.format('')}</body></html>") == ARTICLE_TEXT


def test_layout_wrapper_around_the_whole_page_takes_nothing():
    assert html_text.main_text(f"<html><body><div class='sidebar widget'>{ARTICLE.format('')}</div></body></html>") == ARTICLE_TEXT


def test_linked_paragraphs_and_lists_of_an_article_stay():
    more = '<p><a href="/x">The whole of this paragraph is one link to another page.</a></p><ul><li><a href="/1">First source</a></li><li><a href="/2">Second source</a></li></ul>'
    page = f"<html><body><div class='menu'><a href=/>Home</a></div>{ARTICLE.format(more)}</body></html>"
    assert html_text.main_text(page) == ARTICLE_TEXT + " The whole of this paragraph is one link to another page. First source Second source"


@pytest.mark.parametrize("piece", ['<p "', '<p a="', '<p a=">" ', "<", "<script ", "<script>", "<!", "<!--", "</", "<a =", "<div>", "<div>x", "&", "</p>", "<p>"])
def test_malformed_markup_takes_linear_time(piece):
    start = time.process_time()
    html_text.main_text(piece * (300_000 // len(piece)))
    assert time.process_time() - start < 5


def test_malformed_markup_keeps_the_text():
    assert html_text.main_text("<p>It was 3 < 4, and 5 > 4, as all of them knew; nobody said a word.</p>") == "It was 3 < 4, and 5 > 4, as all of them knew; nobody said a word."
    assert html_text.main_text('<p title="a > b" class=\'c\'>Quoted values, they may hold signs; this is text.</p>') == "Quoted values, they may hold signs; this is text."


# -- op5 --------------------------------------------------------------------------------------


def test_a_batch_run_again_gives_the_same(spark):
    docs = lambda *rows: spark.createDataFrame(rows, "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, expected=10)
    first = docs((1, "A"), (2, "a"), (3, "b"), (3, "b"), (None, "c"))
    want = [(1, 2, 2, False), (2, 2, 2, True), (3, 3, 2, False), (3, 3, 2, True), (None, None, 1, True)]
    cols = ("doc_id", "keep_id", "group_size", "kept")
    for _ in range(3):
        assert as_rows(exact_dedup.exact_dedup(first, index, "one"), *cols) == sorted(want, key=repr)
    assert index.rows().count() == 3
    second = docs((9, "B"), (10, "d"))
    for _ in range(2):
        assert as_rows(exact_dedup.exact_dedup(second, index, "two"), *cols) == sorted([(9, 3, 1, False), (10, 10, 1, True)], key=repr)
    assert as_rows(exact_dedup.exact_dedup(first, index, "one"), *cols) == sorted(want, key=repr)
    assert exact_dedup.keep_documents(first, index, "one").count() == 3


def test_a_batch_that_was_appended_in_part(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "doc_id bigint, text string")
    index = exact_dedup.DigestIndex(spark, expected=10)
    exact_dedup.exact_dedup(docs.where("doc_id = 2"), index, "one")  # what a lost job may leave
    assert as_rows(exact_dedup.exact_dedup(docs, index, "one"), "doc_id", "kept") == [(1, True), (2, True), (3, True)]


def test_a_batch_for_an_index_needs_an_id(spark):
    with pytest.raises(ValueError, match="needs an id"):
        exact_dedup.exact_dedup(spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), exact_dedup.DigestIndex(spark, expected=1))


# -- op6, op8: very long words, texts that repeat themselves --------------------------------------


def test_very_long_words_are_encoded_in_time():
    path = public_tokenizers.path("byte_bpe_50k.json")
    machine, library = bpe.automaton(path), Tokenizer.from_file(path)
    rng = random.Random(2)
    text = "".join(rng.choices("etaoinshr", k=30_000))
    assert np.frombuffer(machine.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids
    start = time.process_time()
    machine.encode("".join(rng.choices("etaoinshr", k=400_000)))
    assert time.process_time() - start < 8


def test_license_scan_of_repeated_text_takes_linear_time():
    index = license_scan.TemplateIndex(TEMPLATES)
    mit = next(v for k, v in TEMPLATES.items() if k == "MIT")
    start = time.process_time()
    assert [m[:2] for m in index.matches((mit + "\n\n") * 200)] == [("MIT", 1.0)] * 200
    assert len(index.matches("Released under the MIT License. " * 8000)) == 8000
    assert index.matches("permission is hereby " * 20_000) == []
    assert time.process_time() - start < 15


# -- op7 --------------------------------------------------------------------------------------


def test_payloads_are_not_shuffled(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", "x" * 1500 if i % 2 else f"{i}" * 600) for i in range(60)], "page_id bigint, url string, html string").repartition(4)
    pages.write.parquet(f"file://{tmp_path}/pages")
    pages = spark.read.parquet(f"file://{tmp_path}/pages")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = as_rows(warc.round_trip(pages), "page_id", "record_type", "refers_to", "payload_bytes")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert [r for r in rows if r[1] == "revisit"] == sorted([(i, "revisit", 59, 1500) for i in range(1, 59, 2)], key=repr)
    assert len(rows) == 60


# -- op9 --------------------------------------------------------------------------------------


def test_no_membership_loses_rows(spark):
    rows = [(1, "a b c", None), (2, "a b", []), (3, "a", ["x"]), (4, "a b c d", ["y", "x", "y"]), (5, "a b", ["x", "y"]), (6, "q", [None]), (7, "", [None, "x"]), (None, None, ["x"])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, sources array<string>")
    got = {r.doc_id: r for r in mixing.mix_documents(docs, sources=F.col("sources")).collect()}
    assert set(got) == {None, *range(1, 8)}
    assert got[1].source_size == got[2].source_size == got[6].source_size == 6
    assert got[4].source_size == got[5].source_size and got[4].target == got[5].target


def test_rows_without_ids_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, f"some words {i}", "s") for i in range(3000)], "doc_id bigint, text string, source string")
    first, again = (as_rows(mixing.mix_documents(docs), "doc_id", "size", "taken") for _ in range(2))
    assert first == again and len(first) == 3000
    assert abs(sum(r[2] for r in first) - 1.5 * 9000) < 20


# -- op10 -------------------------------------------------------------------------------------


def test_shards_of_short_documents_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(topk, "SHARD_DOCS", 50)
    batches = spark.createDataFrame([(i, "" if i % 3 else f"w{i % 7}") for i in range(400)], "doc_id bigint, text string").coalesce(1)
    made = list(topk._build(batches.toArrow().to_batches()))
    assert len(made) == 8 and all(b.column(1)[0].as_py() == 50 for b in made)
