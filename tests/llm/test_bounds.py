"""Bounds of fits are parameters, and repeated ids give one result."""

from pyspark.sql import functions as F

from rowloom.llm import fm_quality, pu_toxicity

WORDS = {0: "poor junk spam click here now", 1: "a careful sentence about rivers and their banks"}


def documents(spark, twice=False):
    rows = [(i, f"{WORDS[i % 2]} number {i}", 40) for i in range(80)]
    if twice:
        rows += [(i, f"zzz {i}", 5) for i in range(80)]  # greater than every other text: never the least
    labels = spark.createDataFrame([(i, i % 2, int(i % 2 == 0)) for i in range(80)], "doc_id long, quality int, toxic int")
    return spark.createDataFrame(rows, "doc_id long, text string, n_chars long"), labels


def test_labelled_documents_are_bounded_by_a_parameter(spark):
    docs, labels = documents(spark)
    few, share = fm_quality.fit(docs, labels, F.lit(True), max_labelled=10)
    many, _ = fm_quality.fit(docs, labels, F.lit(True))
    assert few is not None and 0 < share < 1 and (few.w != many.w).any()
    assert fm_quality.fit(docs, labels, F.lit(True), max_labelled=0) == (None, 0.5)


def test_repeated_ids_take_their_least_text(spark):
    docs, labels = documents(spark)
    more, _ = documents(spark, twice=True)
    assert fm_quality.fit(docs, labels, F.lit(True))[0].w.tolist() == fm_quality.fit(more.repartition(7), labels, F.lit(True))[0].w.tolist()


def test_samples_rule_out_no_feature_that_all_texts_choose(spark):
    """With samples so small that the second one is drawn, the features are those of counts in all texts."""
    rows = [(i, ("vile rotten " if i % 4 == 0 else "") + f"plain words {i % 13} and common{i % 3} more", 40) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(i, 1) for i in range(0, 600, 4)], "doc_id long, toxic int")
    whole = pu_toxicity.fit(docs, labels, F.lit(True), prior=0.3, max_unlabelled=None)
    assert 10 * pu_toxicity.SECOND < 0.3 * 600
    some = pu_toxicity.fit(docs, labels, F.lit(True), prior=0.3, max_unlabelled=10)
    assert some[0].keys() == whole[0].keys() and len(whole[0]) > 2
