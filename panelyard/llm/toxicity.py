"""Toxicity by multiple-instance learning: only documents are labelled, sentences are scored.

A sentence's evidence z is the sum of its words' weights (a word's weight is its own and those of its prefixes, so unseen
compounds of an offending stem count too), or 0 where that is negative.  Its probability is the logistic of z and BIAS, less
what BIAS alone would give: 1 - (1 - logistic(z + BIAS)) / (1 - logistic(BIAS)).  It grows with every bit of evidence and is
0 without any, so plain sentences add nothing, however many there are.  A document's is the noisy-or of its sentences'.  The
weights maximise the documents' likelihood under this same score: in a toxic document the gradient goes to the sentences that
already explain it, in a clean one every sentence with evidence is pushed down.  The fitted sentence scores then locate the
offending sentences.  Toxic labels that no sentence explains are met by a rate per document, else weights of chance words would
take them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelyard.llm.quality import remainder
from panelyard.llm.shared import give_back, raw, text_slices
from panelyard.llm.words import words

#: Labelled documents that are fitted at most, and the text bytes from which on no further one is taken, whatever the length
#: of each; they come in the order of a hash of their ids.  Both bounds concern the fit alone.
TRAIN_DOCUMENTS, TRAIN_BYTES = 5000, 40 << 20
#: Documents of the sample that a word or prefix must stand in to get a weight.
LEAST_DOCUMENTS = 3
#: Standard errors that a feature's log odds over documents must lie above the labels' to get a weight.
LEAST_Z = 3.0
PREFIXES = (3, 4, 5, 6, 7, 8)
ROUNDS, RATE, RIDGE, BIAS = 600, 0.1, 2e-5, -2.0
#: The rate per document of toxic labels that no sentence explains.
UNEXPLAINED = 0.2
_STOP = np.zeros(256, bool)
_STOP[list(b".!?\n")] = True


@dataclass
class Sentences:
    """Of a slice of texts: each word's spelling and sentence, the spellings' features (0: none), each sentence's text and byte
    range within it."""

    word: np.ndarray
    features: np.ndarray
    sentence: np.ndarray
    doc: np.ndarray
    start: np.ndarray
    stop: np.ndarray


def spelling_features(spellings: pa.BinaryArray) -> np.ndarray:
    """For each spelling a hash of the whole and its proper prefixes of PREFIXES bytes, packed (no word has a zero byte)."""
    data, begins = raw(spellings)
    size, out = np.diff(begins), np.zeros((len(spellings), 1 + len(PREFIXES)), np.uint64)
    out[:, 0] = [xxhash.xxh3_64_intdigest(s) for s in spellings.to_pylist()]
    packed, padded = np.zeros(len(spellings), np.uint64), np.concatenate([data, np.zeros(8, np.uint8)])
    for k in range(max(PREFIXES)):
        packed = (packed << np.uint64(8)) | padded[begins[:-1] + k].astype(np.uint64)
        if k + 1 in PREFIXES:
            long = size > k + 1
            out[long, 1 + PREFIXES.index(k + 1)] = packed[long] << np.uint64(8 * (7 - k))
    return out


def sentences(texts: pa.StringArray) -> Sentences:
    """Sentences end after ``.``, ``!``, ``?`` or a line feed; those without a word are left out."""
    data, begins = raw(texts)
    found = words(texts)
    if not len(found.ids):
        none = np.zeros(0, np.int64)
        return Sentences(none, np.zeros((0, 1 + len(PREFIXES)), np.uint64), none, none, none, none)
    edge = np.concatenate([[0], np.cumsum(_STOP[data])])
    starts = found.starts
    doc_of = found.doc_of()
    key = edge[starts] + doc_of  # grows with every stop and every text
    number = np.cumsum(np.concatenate([[0], (np.diff(key) > 0).astype(np.int64)]))
    first = np.flatnonzero(np.concatenate([[True], np.diff(number) > 0]))
    doc = doc_of[first]
    stops = np.flatnonzero(_STOP[data]) + 1
    after = np.append(stops, len(data))
    begin = np.maximum(np.concatenate([[0], stops])[edge[starts[first]]], begins[doc])
    end = np.minimum(after[edge[starts[first]]], begins[doc + 1])
    return Sentences(found.ids, spelling_features(found.spellings), number, doc, begin - begins[doc], end - begins[doc])


def activation(z: np.ndarray, bias: float) -> np.ndarray:
    """-log(1 - p) of sentences with this evidence (0 and more); sums of it are the noisy-or."""
    return np.logaddexp(0, z + bias) - np.logaddexp(0, bias)


@dataclass
class Model:
    """Sorted features with their weights, and the bias of a sentence."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def sentence_scores(self, own: Sentences) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(len(own.doc))
        at = np.minimum(np.searchsorted(self.hashes, own.features), len(self.hashes) - 1)
        w = np.where(self.hashes[at] == own.features, self.weights[at], 0.0).sum(1)
        z = np.maximum(np.bincount(own.sentence, w[own.word], len(own.doc)), 0.0)
        return -np.expm1(-activation(z, self.bias))

    def document_scores(self, own: Sentences, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Noisy-or of each text's sentences (0 without one), and the sentence scores."""
        p = self.sentence_scores(own)
        return -np.expm1(np.bincount(own.doc, np.log1p(-np.minimum(p, 1 - 1e-12)), n)), p


def _sliced(texts: pa.StringArray) -> Iterator[tuple[int, pa.RecordBatch]]:
    done = 0
    for part, own in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
        yield done, pa.RecordBatch.from_arrays([own], names=["text"])
        done += part.num_rows


def _joined(parts: list[tuple[int, Sentences]]) -> Sentences:
    """Sentences of consecutive slices as one; a spelling that several slices hold stands several times."""
    if not parts:
        return sentences(pa.array([], pa.string()))
    spelled, numbered = np.cumsum([0] + [len(x.features) for _, x in parts]), np.cumsum([0] + [len(x.doc) for _, x in parts])
    return Sentences(
        np.concatenate([x.word + a for (_, x), a in zip(parts, spelled, strict=False)]),
        np.concatenate([x.features for _, x in parts]),
        np.concatenate([x.sentence + a for (_, x), a in zip(parts, numbered, strict=False)]),
        np.concatenate([x.doc + first for first, x in parts]),
        np.concatenate([x.start for _, x in parts]),
        np.concatenate([x.stop for _, x in parts]),
    )


def fit(texts: pa.StringArray, labels: np.ndarray) -> Model:
    """Full-batch Adam on the noisy-or likelihood; the same rows in the same order give the same weights."""
    own, n = _joined([(k, sentences(part["text"])) for k, part in _sliced(texts)]), len(texts)
    _, first, place = np.unique(own.features[:, 0], return_index=True, return_inverse=True)  # each spelling once
    own = replace(own, word=place[own.word], features=own.features[first])
    hashes, feature = np.unique(own.features, return_inverse=True)
    feature = feature.reshape(own.features.shape)
    held = np.unique(own.doc[own.sentence] * (len(own.features) + 1) + own.word)
    y = labels.astype(float)
    n_bad, n_all = np.zeros(len(hashes)), np.zeros(len(hashes), np.int64)
    for column in feature.T:  # whole words, then prefixes of each length: no feature is in two columns
        pairs = np.unique((held // (len(own.features) + 1)) * (len(hashes) + 1) + column[held % (len(own.features) + 1)])
        doc, of = pairs // (len(hashes) + 1), pairs % (len(hashes) + 1)
        n_bad += np.bincount(of, y[doc], len(hashes))
        n_all += np.bincount(of, minlength=len(hashes))
    del held, pairs, doc, of
    odds = np.log((n_bad + 0.5) / (n_all - n_bad + 0.5)) - np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))
    marked = (n_all >= LEAST_DOCUMENTS) & (odds * np.sqrt(1 / (1 / (n_bad + 0.5) + 1 / (n_all - n_bad + 0.5))) >= LEAST_Z) & (hashes != 0)
    many = marked.copy()  # and whole words that have a marked prefix, so that harmless ones can be told apart
    many[feature[marked[feature].any(1), 0]] = True
    many &= (n_all >= LEAST_DOCUMENTS) & (hashes != 0)
    spelling, column = np.nonzero(many[feature])
    number = (np.cumsum(many) - 1)[feature[spelling, column]]
    use = many[feature].any(1)[own.word]
    word, n_spellings = own.word[use], len(own.features)
    del feature
    told, sentence = np.unique(own.sentence[use], return_inverse=True)
    of = own.doc[told]
    del own, use
    w, size = np.zeros(int(many.sum())), len(told)
    m, v = np.zeros_like(w), np.zeros_like(w)
    weight = np.where(y > 0, (y == 0).sum() / max(1, (y > 0).sum()), 1.0) ** 0.5
    for t in range(1, ROUNDS + 1):
        z = np.bincount(sentence, np.bincount(spelling, w[number], n_spellings)[word], size)
        steep = 1 / (1 + np.exp(-np.clip(z + BIAS, -30, 30)))
        none = (1 - UNEXPLAINED) * np.exp(-np.bincount(of, activation(np.maximum(z, 0), BIAS), n))
        pull = (weight * np.where(y > 0, none / np.maximum(1 - none, 1e-9), -1.0))[of] / n
        g = np.where(z >= 0, steep, 0.0) * pull
        gw = np.bincount(number, np.bincount(word, g[sentence], n_spellings)[spelling], len(w)) - RIDGE * w
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        w = w + RATE * (1 - 0.999**t) ** 0.5 / (1 - 0.9**t) * m / (np.sqrt(v) + 1e-8)
    return Model(hashes[many], w, BIAS)


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = TRAIN_DOCUMENTS) -> Model:
    """From labelled rows whose crc32 of the id, mod 5, is not 0; one task fits the bounded sample."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where("y in (0, 1) and doc_id is not null").distinct()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    held = base.select("doc_id").distinct()  # ids alone; labels of other documents must not fill the sample
    chosen = known.where(remainder(F.col("doc_id"), 5) != 0).join(held, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(2 * most)
    base = base.withColumns({"size": F.octet_length("text").cast("long"), "hash": F.xxhash64("text")})
    numbers = base.select("doc_id", "size", "hash").join(F.broadcast(chosen), "doc_id")  # 2 * most rows of two numbers
    order = [F.xxhash64("doc_id"), "doc_id", "y", "hash"]
    first = numbers.orderBy(*order).limit(most)  # numbers alone, so that no task holds many texts
    before = F.coalesce(F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = first.withColumn("before", before).where(F.col("before") < TRAIN_BYTES).groupBy("doc_id", "y", "hash").agg(F.count("*").alias("copies"))
    sample = base.join(F.broadcast(first), ["doc_id", "hash"]).groupBy("doc_id", "y", "hash").agg(F.first("text").alias("text"), F.first("copies").alias("copies"))
    sample = sample.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).orderBy(*order).select("text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        texts = pa.concat_arrays([b.column("text") for b in held]) if held else pa.array([], pa.string())
        model = fit(texts, np.concatenate([b.column("y").to_numpy() for b in held] or [np.zeros(0, int)]))
        del held, texts
        give_back()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(model.hashes.view(np.int64), 0)), pa.array(np.append(model.weights, model.bias)), pa.array(np.append(np.zeros(len(model.hashes), bool), True))], names=["hash", "weight", "bias"])

    rows = sample.coalesce(1).mapInArrow(run, "hash long, weight double, bias boolean").toPandas()  # the sample's words
    if not len(rows):
        return Model(np.zeros(0, np.uint64), np.zeros(0), BIAS)
    own = rows[~rows["bias"]]
    hashes = own["hash"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    keep = np.abs(own["weight"].to_numpy()[order]) > 1e-3
    return Model(hashes[order][keep], own["weight"].to_numpy()[order][keep], float(rows.loc[rows["bias"], "weight"].iloc[0]))


def located(own: Sentences, score: np.ndarray, p: np.ndarray, least: float = 0.5) -> np.ndarray:
    """Which sentences are offending: those that score ``least``, and the best of a text that reaches it by several together."""
    best = np.zeros(len(score))
    np.maximum.at(best, own.doc, p)
    return (p >= least) | ((score[own.doc] >= least) & (p > 0) & (p == best[own.doc]))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            own = sentences(texts)
            score, p = model.document_scores(own, len(texts))
            n_bad = np.bincount(own.doc, located(own, score, p), len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(n_bad)], names=["doc_id", "score", "n_sentences"])

    return run


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, n_sentences (those whose own score reaches 0.5; of a text that reaches
    it by weaker ones together, its best, so a predicted row has one at least).

    Only the text is an input of the score.  Null and empty texts have no sentences and score 0; repeated rows score alike;
    without usable labels no word has a weight.  Every row gets its row; other columns are not read.
    """
    model = learn(docs, labels)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = base.mapInArrow(_score(model), "doc_id long, score double, n_sentences long")
    return scored.select("doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "n_sentences")


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The sentences that score ``least`` or more, and the best of texts that do so by several: doc_id, start and stop (UTF-8 bytes), sentence, score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            own = sentences(texts)
            score, p = model.document_scores(own, len(texts))
            at = np.flatnonzero(located(own, score, p, least))
            ids, start, stop = batch.column("doc_id").take(pa.array(own.doc[at])), own.start[at], own.stop[at]
            cut = [texts[d].as_py().encode()[a:b].decode() for d, a, b in zip(own.doc[at].tolist(), start.tolist(), stop.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(start), pa.array(stop), pa.array(cut, pa.string()), pa.array(p[at])], names=["doc_id", "start", "stop", "sentence", "score"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, start long, stop long, sentence string, score double")


def clean_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that score 0.5 or more; all columns stay."""
    model = learn(docs, labels)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            yield batch.filter(pa.array(model.document_scores(sentences(texts), len(texts))[0] < 0.5))

    return docs.mapInArrow(keep, docs.schema)
