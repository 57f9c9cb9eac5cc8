"""Every operator on tables with columns named like its own, with ids of another type, and with very long texts."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.llm import branch_merge, decontamination, fingerprints, mixing, near_copies, periodic_runs, pii, quality_model, quality_rules, secret_scan, simhash, substrings, token_counts, toxicity

from .data import rows, table

NAMES = (
    "key more h fp node row root n at place prefix cells score label held_out predicted spans found words size kept of k start stop named print probe candidate upper "
    "doc least shared item_id g taken target passes below value own rid place salt owner asker start runs collapsed hi lo w i a b chunk weight pos line name textloom_row textloom_of textloom_fate textloom_held __textloom_kept __textloom_held"
).split()
LABELS = [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(40)]


def operators(spark) -> dict:
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")
    items = spark.createDataFrame([(1, rows()[0][1]), (2, "p q r s t")], "item_id long, text string")
    return {
        "op1": quality_rules.quality_rules, "op1 stage": quality_rules.good_documents, "op2": secret_scan.secret_scan, "op2 stage": secret_scan.redact_documents,
        "op3": lambda d: quality_model.quality_classifier(d, labels), "op4": pii.personal_data, "op5": lambda d: decontamination.contaminated(d, items),
        "op5 stage": lambda d: decontamination.clean_documents(d, items), "op6": lambda d: toxicity.toxicity(d, labels), "op7": mixing.mix, "op7 stage": mixing.mixed_documents,
        "op8": simhash.near_duplicates, "op8 stage": near_copies.one_of_each, "op9": substrings.substring_digest, "op10": token_counts.token_counts,
        "op11": branch_merge.merge_branches, "op12": fingerprints.near_texts, "op13": lambda d: periodic_runs.periodic_runs(periodic_runs.repeat_tails(d)),
    }


def values(df, drop: tuple[str, ...] = ()) -> Counter:
    return Counter(str([(c, r[c]) for c in df.columns if c not in drop]) for r in df.collect())


OWN = ("doc_id", "text", "lang", "source", "n_chars", "extra")


@pytest.mark.parametrize("name", ["op1", "op1 stage", "op2", "op2 stage", "op3", "op4", "op5", "op5 stage", "op6", "op7", "op7 stage", "op8", "op8 stage", "op9", "op10", "op11", "op12", "op13"])
def test_columns_named_like_its_own(spark, name):
    run = operators(spark)[name]
    plain = table(spark)
    clash = plain.withColumns({c: F.lit(f"own {c}") for c in NAMES})
    got = run(clash)
    if "stage" in name:
        assert [c for c in clash.columns if c not in got.columns] == []
        assert got.filter(" OR ".join(f"{c} <> 'own {c}'" for c in NAMES)).count() == 0
        assert values(got.select(*OWN)) == values(run(plain).select(*OWN))
    else:
        assert values(got) == values(run(plain))


@pytest.mark.parametrize("name", ["op1", "op2", "op3", "op4", "op6", "op7", "op8", "op9", "op10", "op11", "op12", "op13"])
def test_ids_of_text(spark, name):
    """Ids that aren't numbers give a row for each row."""
    docs = table(spark).withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    run = operators(spark)[name]
    labels = spark.createDataFrame([(f"d{i:04}", q, t) for i, q, t in LABELS], "doc_id string, quality int, toxic int")
    if name in ("op3", "op6"):
        run = {"op3": lambda d: quality_model.quality_classifier(d, labels), "op6": lambda d: toxicity.toxicity(d, labels)}[name]
    assert sorted(str(r.doc_id) for r in run(docs).select("doc_id").collect()) == sorted(str(r.doc_id) for r in docs.select("doc_id").collect())


def test_very_long_texts_count_to_their_end(spark):
    """Signs behind 200,000 words change scores and counts."""
    filler = "the of and to in is that it for was on are with as at be by this from or an have not "
    long = (filler * 9000).strip()
    texts = {1: long, 2: long + " moron idiot scum trash clown" * 9000, 3: long + " ### $$$ %%%" * 60000, 4: long + " x"}
    docs = table(spark, [(i, t, "en", "a", 1, "") for i, t in texts.items()])
    read = {t: spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels")}
    toxic = {r.doc_id: r.score for r in toxicity.classify(docs, toxicity.train(read["documents"], read["labels"])).collect()}
    assert toxic[2] > 0.9 > 0.3 > toxic[1]
    model = quality_model.train(read["documents"], read["labels"])
    quality = {r.doc_id: r.score for r in quality_model.classify(docs, model).collect()}
    assert quality[3] != quality[1] and all(0 <= s <= 1 for s in quality.values())
    counts = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(docs).collect()}
    assert counts[1][0] == 9000 * 23 and counts[4][0] == counts[1][0] + 1 and counts[4][1] > counts[1][1] and counts[1][1] % 9000 == 0
