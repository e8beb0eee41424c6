"""Nulls, empty and long texts, repeated rows, empty tables, clashing columns."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from chatloom.llm import (
    decontaminate,
    language,
    lm,
    mixing,
    neardup,
    passages,
    repeats,
    repetition,
    secrets,
    toxicity,
)

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Names that the operators use inside.
CLASHING = ("key_0", "body", "node", "label", "rank", "size", "score", "spans", "found", "taken",
            "text_key", "column_0", "rejected", "doc", "id", "keep_node")
WORDS = " ".join(f"word{i} lies{i % 7} near{i % 5}" for i in range(120))
LONG = " ".join(f"w{i}" for i in range(60_000))
ROWS = [
    (1, WORDS, "en", "a", 1),
    (1, WORDS, "en", "a", 1),  # a repeated row
    (2, WORDS, None, None, None),  # a copy
    (3, None, "en", "b", 0),
    (4, "", "de", "b", 0),
    (5, " \n\t ", "de", "", 0),
    (None, "no id here but a text of some words", "en", "c", 5),
    (6, "é", "fr", "c", 1),
    (7, LONG, "en", "a", 9),
    (8, 'my token = "abcdef123456" ends', "en", "b", 3),
]


@pytest.fixture(scope="module")
def edge(spark):
    frame = spark.createDataFrame(ROWS, DOCS)
    for name in CLASHING:
        frame = frame.withColumn(name, F.lit("x"))
    return frame


@pytest.fixture(scope="module")
def nothing(edge):
    return edge.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 0), (7, 0), (8, 1), (None, 1), (3, None)], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    rows = [(1, "Which word is near? word1 lies1 near1 word2 lies2 near2 word3"), (2, None), (None, ""), (1, "x")]
    return spark.createDataFrame(rows, "item_id long, text string")


REPORTS = {
    "secrets": secrets.secret_report,
    "repeats": repeats.removal_report,
    "lm": lm.lm_report,
    "neardup": neardup.near_duplicate_report,
    "repetition": repetition.quality_report,
    "language": language.language_report,
    "mixing": mixing.mix_report,
}


@pytest.mark.parametrize("name", sorted(REPORTS))
def test_one_row_per_document(edge, nothing, name):
    rows = REPORTS[name](edge).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in ROWS)
    assert REPORTS[name](nothing).count() == 0
    both = [r for r in rows if r.doc_id == 1]
    if name != "mixing":  # which of two equal rows comes first in the mix is open
        assert both[0] == both[1]


def test_defined_results(edge):
    by_id = lambda frame: {r.doc_id: r for r in frame.collect()}
    found = by_id(secrets.secret_report(edge))
    assert found[8].spans == "assign:3:24" and found[3].spans == found[4].spans == ""
    kept = by_id(repeats.removal_report(edge))
    n = len(WORDS.encode())
    assert (kept[2].n_bytes, kept[2].n_removed, kept[2].n_spans) == (n, n, 1)
    assert kept[3].n_bytes == 0 and kept[7].n_removed == 0
    classes = by_id(neardup.near_duplicate_report(edge))
    assert (classes[2].class_id, classes[2].class_size) == (1, 3)
    assert classes[7].class_size == 1 and classes[3].class_id == classes[4].class_id == 3
    rules = by_id(repetition.quality_report(edge))
    assert rules[3].n_words == rules[5].n_words == 0 and rules[3].base_failed and not rules[4].kept
    assert rules[7].kept and rules[7].n_words == 60_000
    spoken = by_id(language.language_report(edge))
    assert spoken[3].lang_pred == spoken[5].lang_pred == "und" and spoken[3].rejected
    mix = by_id(mixing.mix_report(edge))
    assert mix[3].size == mix[3].taken == 0 and mix[3].position is None
    scored = by_id(lm.lm_report(edge))
    assert scored[3].n_tokens == scored[4].n_tokens == 1 and scored[3].score == scored[4].score < 0


def test_toxicity(edge, nothing, labels):
    rows = toxicity.toxicity_report(edge, labels).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert toxicity.toxicity_report(nothing, labels).count() == 0
    assert {r.score for r in toxicity.toxicity_report(edge, labels.limit(0)).collect()} == {0.0}


def test_decontamination(edge, nothing, benchmark):
    rows = decontaminate.contaminated(edge, benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in rows} >= set()
    assert decontaminate.contaminated(nothing, benchmark).count() == 0
    assert decontaminate.contaminated(edge, benchmark.limit(0)).count() == 0
    assert decontaminate.clean_documents(edge, benchmark.limit(0)).count() == len(ROWS)


def test_passages(edge, nothing):
    rows = passages.shared_passages(edge).collect()
    assert {(r.doc_id, r.match_id) for r in rows} == {(1, 2), (2, 1)}
    assert all((r.start_word, r.end_word, r.similarity) == (0, 360, 1.0) for r in rows)
    assert passages.shared_passages(nothing).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES[:-1]])
def test_stages_keep_columns(spark, edge, nothing, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    folder = "/root/testdata/sf0.001"
    out = stage(spark, edge, folder)
    assert out.dtypes == edge.dtypes
    assert stage(spark, nothing, folder).count() == 0
    if name == "near_duplicates":
        assert sorted(str(r.doc_id) for r in out.collect()) == sorted(map(str, [1, 3, 5, 6, 7, 8, None]))


def test_repeated_rows_without_an_id_leave_one(spark):
    rows = [(None, WORDS, "en", "a", 1)] * 3 + [(None, "other words than these", "en", "a", 1)]
    out = neardup.distinct_documents(spark.createDataFrame(rows, DOCS))
    assert out.count() == 2


def test_language_training_with_equal_keys_and_many_languages(spark):
    texts = [f"words of the text number {i} here" for i in range(30)] * 5
    rows = [(7, lang, text) for lang in ("aa", "bb", "cc") for text in texts]
    rows += [(7, "dd", "one more text")]
    labelled = spark.createDataFrame(rows, "key long, lang string, text string")
    model = language.train(labelled, per_language=10, max_languages=2)
    assert list(model.languages) == ["aa", "bb"]
    assert language.train(labelled.limit(0)) is None
