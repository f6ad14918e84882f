"""Rows larger than the slices that operators work in."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import zlib
from pyspark.sql import functions as F

from panelyard.llm import chat, collocations, merkle, quality, shared, simhash, token_files, toxicity
from panelyard.sources.folders import new_folder

BPE_JSON = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def long_text():
    rng = random.Random(1)
    return "".join(" ".join(rng.choices(["red", "stone", "of", "the", "river", "été", "42"], k=9)) + ". \n" for _ in range(230_000))


def test_one_text_above_a_slice(spark, long_text):
    assert len(long_text.encode()) > 4 * shared.SLICE_BYTES
    rows = [(k, f"plain words number {k} here. " * 5 + ("you utter vermin. " if k % 3 == 0 else ""), "en", "s") for k in range(300)]
    docs = spark.createDataFrame([*rows, (1000, long_text, "en", "s"), (1001, long_text + " you utter vermin.", "en", "s")], "doc_id long, text string, lang string, source string")
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long")).repartition(3)
    labels = spark.createDataFrame([(k, k % 2, int(k % 3 == 0)) for k in range(300)], "doc_id long, quality int, toxic int")
    toxic = {r.doc_id: (r.predicted, r.n_sentences) for r in toxicity.toxicity(docs, labels).collect()}
    assert toxic[1000] == (0, 0) and toxic[1001] == (1, 1)
    scores = {r.doc_id: r.score for r in quality.quality(docs, labels).collect()}
    assert len(scores) == 302 and all(0 <= s <= 1 for s in scores.values())
    prints = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.simhash(docs).collect()}
    assert prints[1001][1] == 1000  # a few shingles more change no bit of many
    tampered = {k for k in (1000, 1001) if zlib.crc32(str(k).encode()) % 2 == 0}  # the others hold no line feed
    assert {r.doc_id for r in merkle.manifest(docs).where("not verified").collect()} == tampered
    found = {r.phrase: r.a for r in collocations.collocations(docs.where("doc_id = 1000")).collect()}
    assert found["the river"] == sum(line.split().count("the") and " ".join(line.split()).count("the river") for line in long_text.replace(".", "\n").split("\n"))


def test_tokens_of_one_long_text(spark, long_text):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame([(1, "short"), (2, long_text), (3, None)], "doc_id long, text string")
    out = {r.doc_id: r for r in token_files.read_token_files(token_files.write_token_files(docs, BPE_JSON, new_folder(spark, "long-tokens"))).collect()}
    ids = Tokenizer.from_file(BPE_JSON).encode(long_text, add_special_tokens=False).ids
    assert out[2].n_tokens == len(ids) + 1
    assert out[2].ids_crc32 == zlib.crc32(np.array([*ids, 2], "<u4").tobytes())
    assert (out[3].n_tokens, out[3].start) == (1, out[2].start + len(ids) + 1)


def test_a_very_long_conversation(spark):
    """Turns by the hundred and one of a megabyte, told back whole."""
    turns = [(7, k, ("user", "assistant")[k % 2], f"turn {k} <|end|> " * 3) for k in range(400)] + [(8, 0, "user", "x" * 1_000_000), (8, 1, "assistant", "é</s>" * 200_000)]
    out = {r.conv_id: r for r in chat.read_back(chat.examples(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3))).collect()}
    for c in (7, 8):
        own = [(role, text) for conv, _, role, text in turns if conv == c]
        assert out[c].n_turns == len(own)
        assert out[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert out[c].loss_chars == sum(len(t) for r, t in own if r == "assistant")
