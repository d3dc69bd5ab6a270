"""The registered queries over whole tables: against DuckDB where SQL expresses them, else against brute force."""

import re
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import common, mixing, near_dedup, quality, registry, secret_scan
from tests.compare import connect, normal
from tests.llm.fixtures import hard, words
from tests.llm.test_text_operators import brute_components, near_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_duckdb(spark, sf, name):
    got, want = normal(registry.QUERIES[name](spark, sf).toPandas()), normal(connect(sf).execute(registry.ORACLES[name]).fetch_df())
    assert list(got.columns) == list(want.columns) and got.equals(want)


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in registry.QUERIES] == list(range(1, 14))


def test_near_dedup_query_matches_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want, _ = brute_components(rows, 4)
    assert {r.doc_id: r.component_id for r in registry.QUERIES["op10_near_dedup"](spark, sf).collect()} == want


def test_pages_query_gives_the_article(spark, sf):
    import html

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in registry.QUERIES["op4_html_main_text"](spark, sf).collect():
        article = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        assert r.text == " ".join(html.unescape(re.sub(r"</?(?:p|h1|br)>", " ", re.sub(r"</?b>", "", article))).split()) and r.n_chars == len(r.text)


def test_packed_documents_keep_their_ids(spark, sf):
    rows = registry.QUERIES["op6_pack"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = Counter()
    for r in rows:
        total[r.doc_id] += r.length
    assert total == {i: len(whole.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in texts.items()}


def staged(spark, docs):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = common.materialize(stage(spark, docs, ""), name.replace(" ", "-"))
        out.append(docs)
    return out


def test_pipeline_stages_match_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 4}", len(t or "")) for i, t in near_rows()] + [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in hard(spark).collect() if r.doc_id is None], "doc_id long, text string, lang string, source string, n_chars long")
    rules, near, secrets, mixed, packed = staged(spark, docs)
    for df in (rules, near, secrets, mixed):
        assert df.columns == docs.columns
    want = Counter((r.doc_id, r.text) for r in docs.collect() if all(not rule.rejects(quality.Document(r.text)) for rule in quality.RULES))
    assert Counter((r.doc_id, r.text) for r in rules.collect()) == want
    component, _ = brute_components([(i, t) for i, t in want], 5)
    assert {r.doc_id for r in near.collect()} == {i for i, _ in want if i is None or component[i] == i}
    plain = {r.doc_id: r.text for r in near.collect()}
    for r in secrets.collect():
        assert r.text == plain[r.doc_id] or secret_scan.REDACTED in r.text
        assert r.n_chars == len(r.text)
    taken = {r.doc_id: r.taken for r in mixing.mix(secrets).where("taken > 0").collect()}
    assert {r.doc_id: len(words(r.text)) for r in mixed.collect()} == taken
    lengths = defaultdict(int)
    for r in packed.collect():
        lengths[r.doc_id] += r.length
    whole = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    assert lengths == {r.doc_id: len(whole.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed.collect()}


def test_pipeline_runs_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_near_duplicates_of_one_document_table(spark):
    assert [tuple(r) for r in near_dedup.near_duplicates(spark.createDataFrame([(3, "a b c d e f")], "doc_id long, text string"), shingle=4).collect()] == [(3, 3, 3, True)]
