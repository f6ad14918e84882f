"""The pipeline's stages against what they must do, each on what the one before kept."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

import corpus_pipeline
from panelyard.llm import secrets, toxicity
from panelyard.llm.shared import kept
from tests.llm.test_corpus import brute_groups, low
from tests.parity import SF


def test_stages_on_odd_rows(spark, tmp_path):
    """Nulls, empty and very long texts, repeated rows, extra columns whose names the stages use, and empty tables."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    long = " ".join(word() for _ in range(150_000)) + "."  # a megabyte
    texts = [None, "", " ", long, long + " end", "token=k7Qz2pL9xw and more", "x" * 100_000, " ".join(["passage"] * 3 + [f"p{k}" for k in range(12)])]
    texts += [" ".join(word() for _ in range(30)) + "." for _ in range(60)]
    rows = [(k, t, "en", f"s{k % 5}", len(t or "")) for k, t in enumerate(texts)] + [(9, texts[9], "en", "s1", len(texts[9]))] * 2 + [(None, "no id here", None, None, None)]
    rows += [(1000 + k, " ".join(word() for _ in range(20)) + (". you utter vermin." if k % 3 == 0 else "."), "en", "s1", 1) for k in range(120)]
    clash = ["node", "root", "mark", "registers", "found", "places", "slot", "bucket", "bitmap", "maybe", "row", "text_hash", "score", "ids", "v"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("clash") for c in clash}).repartition(3)
    labels = spark.createDataFrame([(1000 + k, None, int(k % 3 == 0)) for k in range(120)] + [(None, 1, 1), (1001, None, None)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, " ".join(f"p{k}" for k in range(12))), (2, None), (None, "")], "item_id long, text string")
    for name, table in (("labels", labels), ("benchmark", bench), ("documents", docs)):
        table.write.parquet(f"{tmp_path}/full/{name}.parquet")
        table.where("false").write.parquet(f"{tmp_path}/none/{name}.parquet")
    kept_ids, before = {}, docs
    for name, stage in corpus_pipeline.STAGES:
        after = kept(stage(spark, before, f"{tmp_path}/full"), "odd")
        kept_ids[name] = Counter(r.doc_id for r in after.select("doc_id").collect())
        if name != "byte_bpe":
            assert after.columns == docs.columns
            before = after
    all_ids = Counter(r[0] for r in rows)
    assert kept_ids["toxicity"] == all_ids - Counter(1000 + k for k in range(0, 120, 3))
    assert kept_ids["near_duplicates"] == kept_ids["toxicity"] - Counter([4])
    assert kept_ids["decontamination"] == kept_ids["near_duplicates"] - Counter([7])
    assert kept_ids["secrets"] == kept_ids["byte_bpe"] == kept_ids["decontamination"]
    masked = {r.doc_id: (r.text, r.n_chars) for r in before.where("doc_id in (0, 3, 5)").collect()}
    assert masked == {0: (None, 0), 3: (long, len(long)), 5: ("token=[secret] and more", 23)}
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.where("false"), f"{tmp_path}/full").count() == 0
    small = docs.where("doc_id < 3")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, small, f"{tmp_path}/none").count() == 3, name


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    whole = docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = kept(stage(spark, docs, SF), f"test-{name}")
        seen[name] = (before, docs)
        if name != "byte_bpe":
            assert docs.columns == columns
    before, after = seen["toxicity"]
    judged = toxicity.toxicity(whole, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0")
    assert sorted(r.doc_id for r in after.select("doc_id").collect()) == sorted(r.doc_id for r in judged.collect())
    before, after = seen["near_duplicates"]
    groups = brute_groups([(r.doc_id, r.text) for r in before.collect()])
    assert {r.doc_id for r in after.collect()} == {k for k, _, c in groups if k == c}
    before, after = seen["decontamination"]
    windows = set()
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = low(r.text)
        windows |= {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} - {()}
    clean = {r.doc_id for r in before.collect() if not any(tuple(low(r.text)[i : i + 10]) in windows for i in range(len(low(r.text))))}
    assert {r.doc_id for r in after.collect()} == clean
    before, after = seen["secrets"]
    assert before.count() == after.count()
    live = {r.doc_id for r in secrets.secrets(before).where("n_live > 0").collect()}
    changed = {r.doc_id for r in before.select("doc_id", "text").exceptAll(after.select("doc_id", "text")).collect()}
    assert changed == live
    before, after = seen["byte_bpe"]
    assert sorted(r.decoded_sha256 for r in after.collect()) == sorted(hashlib.sha256(r.text.encode()).hexdigest() for r in before.collect())
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, after.collect()))

