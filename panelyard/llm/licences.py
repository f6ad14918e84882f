"""Licence scan by a positional rare-token index.

Templates are word sequences: phrases, notices and whole licence texts.  Their words form the licence vocabulary, whose document
frequencies are counted over all documents.  Each template is posted under its RAREST places of highest inverse document
frequency (all of them, where it is short).  An alignment (file position minus template position) on which enough of those
places agree is a candidate, a short template's on all, a longer one's on half of them; so its body alone can propose it.

A file's licence words are looked up from the highest inverse document frequency down: of ``n`` posted places of which
``need`` must agree, one of the n - need + 1 rarest does, so those words alone propose alignments, and the others only vote on
what was proposed.  No alignment is missed by that, and common words are never gone through.  Last, the template's key phrase
must stand there word for word, else the candidate gives a score and no label.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelyard.llm.licence_texts import PHRASES, TEXTS
from panelyard.llm.shared import text_slices
from panelyard.llm.words import words

LabelTemplates = list[tuple[str, str, int, int, bool]]
#: Places of a template in the index, and words up to which a template is short: all of its places must agree.
RAREST, SHORT = 12, 8
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def template(label: str, text: str, key: str, base: bool = False) -> tuple[str, str, int, int, bool]:
    """label, words, first and past-the-last word of the key phrase, base."""
    own, phrase = _WORD.findall(text.lower()), key.split()
    at = next(k for k in range(len(own)) if own[k : k + len(phrase)] == phrase)
    return label, " ".join(own), at, at + len(phrase), base


TEMPLATES: LabelTemplates = [template(label, text, text, True) for label, text in PHRASES] + [template(*x) for x in TEXTS]


def places_needed(n_words: int) -> tuple[int, int]:
    """Posted places of a template of so many words, and how many of them must agree."""
    return (n_words, n_words) if n_words <= SHORT else (min(RAREST, n_words), min(RAREST, n_words) // 2)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_frequencies(docs: DataFrame, templates: LabelTemplates = TEMPLATES) -> DataFrame:
    """Number of documents that hold each licence word: word, n_docs (words that no document holds are absent)."""
    vocabulary = pa.array(sorted({w.encode() for _, t, *_ in templates for w in t.split()}), pa.binary())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(vocabulary), np.int64)
        for _, texts in text_slices(batches):
            found = words(texts)
            if not len(found.ids):
                continue
            own = pc.fill_null(pc.index_in(found.spellings, value_set=vocabulary), -1).to_numpy(zero_copy_only=False)[found.ids]
            at = np.flatnonzero(own >= 0)
            pairs = np.unique(found.doc_of()[at] * len(vocabulary) + own[at])
            total += np.bincount(pairs % len(vocabulary), minlength=len(vocabulary))
        yield pa.RecordBatch.from_arrays([vocabulary.cast(pa.string()), pa.array(total)], names=["word", "n_docs"])

    return _columns(docs).mapInArrow(count, "word string, n_docs long").groupBy("word").agg(F.sum("n_docs").alias("n_docs")).where("n_docs > 0")


class RareWordIndex:
    """Postings of the templates under their rarest places, rarest words first."""

    def __init__(self, templates: LabelTemplates, n_docs: dict[str, int]):
        self.labels = [x[0] for x in templates]
        self.base = np.array([x[4] for x in templates])
        split = [x[1].split() for x in templates]
        self.vocabulary = pa.array(sorted({w.encode() for t in split for w in t}, key=lambda w: (n_docs.get(w.decode(), 0), w)), pa.binary())  # by falling IDF
        number = {w.decode(): k for k, w in enumerate(self.vocabulary.to_pylist())}
        self.words = [np.array([number[w] for w in t]) for t in split]
        self.key = [(x[2], x[3]) for x in templates]
        self.posted: list[list[int]] = []
        self.need = [places_needed(len(own))[1] for own in self.words]
        #: By word, the places of templates that it proposes.
        self.proposing: dict[int, list[tuple[int, int]]] = {}
        for k, own in enumerate(self.words):
            n = places_needed(len(own))[0]
            self.posted.append(sorted(range(len(own)), key=lambda p, own=own: (own[p], p))[:n])
            for p in self.posted[k][: n - self.need[k] + 1]:
                self.proposing.setdefault(int(own[p]), []).append((k, p))

    def alignments(self, row: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Template, document, place of its first word there (negative before the start), share of words that agree, whether the key
        phrase stands there.  row: each word's number or -1; document d has the words first[d] to first[d + 1]."""
        at = np.flatnonzero(row >= 0)
        order = at[np.argsort(row[at], kind="stable")]
        edges = np.searchsorted(row[order], np.arange(len(self.vocabulary) + 1))
        proposed: dict[int, list[np.ndarray]] = {}
        for word in sorted(self.proposing):  # by falling IDF
            here = order[edges[word] : edges[word + 1]]
            if len(here):
                doc = np.searchsorted(first, here, side="right") - 1
                for k, p in self.proposing[word]:
                    proposed.setdefault(k, []).append(np.stack([doc, here - first[doc] - p]))
        for k, parts in proposed.items():
            own = self.words[k]
            doc, start = np.unique(np.concatenate(parts, axis=1), axis=1)

            def agree(places: list[int] | range, doc: np.ndarray, start: np.ndarray, own: np.ndarray = own) -> np.ndarray:
                same = np.zeros(len(doc), np.int64)
                for p in places:
                    inside = (start + p >= 0) & (start + p < first[doc + 1] - first[doc])
                    same += inside & (row[np.where(inside, first[doc] + start + p, 0)] == own[p])
                return same

            chosen = agree(self.posted[k], doc, start) >= self.need[k]
            doc, start = doc[chosen], start[chosen]
            if len(doc):
                a, b = self.key[k]
                yield k, doc, start, agree(range(len(own)), doc, start) / len(own), agree(range(a, b), doc, start) == b - a


def licences(docs: DataFrame, templates: LabelTemplates = TEMPLATES) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, places.

    Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z, counted from 0.  n_base counts all places of the base
    phrases, overlapping ones too; first_word and last_word are the smallest and largest of their starts.  labels add those
    of aligned templates whose key phrase stands in its place; score is the best alignment's share of words that agree, with its
    key phrase or without (0 without any).  places lists label, start of the template, that share and whether the key phrase is
    there.  Null and empty texts have no words, empty
    labels and score 0; every row gets its row; other columns are not read.
    """
    base = _columns(docs)
    index = RareWordIndex(templates, {r.word: r.n_docs for r in word_frequencies(docs, templates).collect()})  # a row for each licence word
    place = pa.struct([("label", pa.string()), ("start", pa.int64()), ("share", pa.float64()), ("verified", pa.bool_())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            found, n = words(texts), len(texts)
            places: list[list[tuple[int, int, float, bool]]] = [[] for _ in range(n)]
            if len(found.ids):
                row = pc.fill_null(pc.index_in(found.spellings, value_set=index.vocabulary), -1).to_numpy(zero_copy_only=False).astype(np.int64)[found.ids]
                for k, doc, start, share, verified in index.alignments(row, found.first):
                    for d, *x in zip(doc.tolist(), start.tolist(), share.tolist(), verified.tolist(), strict=True):
                        places[d].append((k, *x))
            plain = [[s for k, s, *_ in own if index.base[k]] for own in places]
            label = lambda own, base: ",".join(sorted({index.labels[k] for k, *_, ok in own if ok and (index.base[k] or not base)}))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(found.first)),
                    pa.array(list(map(len, plain)), pa.int64()),
                    pa.array([min(x, default=None) for x in plain], pa.int64()),
                    pa.array([max(x, default=None) for x in plain], pa.int64()),
                    pa.array([label(own, True) for own in places]),
                    pa.array([label(own, False) for own in places]),
                    pa.array([max((x for *_, x, _ in own), default=0.0) for own in places]),
                    pa.array([[{"label": index.labels[k], "start": s, "share": x, "verified": ok} for k, s, x, ok in sorted(own, key=lambda y: (y[1], y[0]))] for own in places], pa.list_(place)),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"],
            )

    return base.mapInArrow(scan, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,start:long,share:double,verified:boolean>>")
