"""Language identification with error-correcting output codes.

Each language has a codeword; each bit of it is predicted by a binary
classifier over hashed byte n-grams (two to four bytes of each word with its
edges): the log odds of the n-gram among the languages whose bit is 1 against
those whose bit is 0, counted over every training document. A document's margin
for a bit is the mean log odds of its n-grams. Decoding takes the codeword of
least loss, where a bit's logistic loss is weighted by how well that bit
separated the training n-grams; a small lead over the second codeword is
flagged as ambiguous.

Defined results: `und` with score 0 where the text is null, empty or has no
letter, or where there is no training row; repeated rows count each time.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factframe.llm.common import fold
from factframe.llm.hashing import CLASS, WORD, chunks

SLOTS = 1 << 15
ORDERS = (2, 3, 4)
AMBIGUOUS = 0.1


def codewords(classes: int, seed: int = 7) -> np.ndarray:
    """(classes, bits) of +1 and -1: the exhaustive code up to 6 classes, else the best of many random codes."""
    if classes < 2:
        return np.ones((classes, 1))
    if classes <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=classes - 1) if -1 in rest]
        return np.array(columns, dtype=float).T
    rng, bits, best, widest = np.random.default_rng(seed), int(np.ceil(10 * np.log2(classes))), None, -1
    for _ in range(500):
        code = rng.choice([-1.0, 1.0], size=(classes, bits))
        apart = min(np.sum(code[i] != code[j]) for i in range(classes) for j in range(i))
        if apart > widest and np.all(np.abs(code.sum(0)) < classes):
            best, widest = code, apart
    return best


def _slot(window: np.ndarray, slots: int) -> np.ndarray:
    """The upper bits of a product, for a power of two of slots."""
    return ((window * np.uint32(0x9E3779B1)) >> np.uint32(33 - slots.bit_length())).astype(np.int32)


def ngram_slots(texts: list[str | None], slots: int = SLOTS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """For each order the slots of all n-grams in order of place; where each document's begin, (orders, documents + 1); whether each has a letter.

    An n-gram has word bytes only, but may take one blank on either side, so
    that prefixes and suffixes have features of their own.
    """
    raw = [(t or "").lower().encode("utf-8", "surrogatepass") for t in texts]
    ends = np.cumsum([0, *(len(r) + 1 for r in raw)])
    buf = np.frombuffer(b"\n" + b"\n".join(raw) + b"\n\n\n\n", np.uint8)
    word = CLASS[buf] == WORD
    byte = np.where(word, buf, np.uint8(32)).astype(np.uint32)
    n = int(ends[-1])  # an n-gram belongs to the document of its second byte
    window, found, begins = byte[:n], [], []
    for order in ORDERS:
        window = (window << np.uint32(8)) | byte[order - 1 : n + order - 1]
        if order == 2:
            inside = word[:n] | word[1 : n + 1]
        else:
            inside = word[1 : n + 1] if order == 3 else inside & word[2 : n + 2]
        at = np.flatnonzero(inside)
        found.append(_slot(window[at] + np.uint32(order), slots))
        begins.append(np.searchsorted(at, ends))
    letter = np.fromiter((any(c.isalpha() for c in t) if t else False for t in texts), dtype=bool, count=len(texts))
    return found, np.array(begins), letter


@dataclass(frozen=True)
class Codebook:
    """Languages, their codewords, each bit's log odds by slot, and each bit's weight and scale."""

    languages: list[str]
    code: np.ndarray
    odds: np.ndarray
    weight: np.ndarray
    scale: np.ndarray

    def margins(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(documents, bits) of mean log odds, and whether each document has a letter."""
        found, begins, letter = ngram_slots(texts, self.odds.shape[1])
        total = np.zeros((len(texts), len(self.odds)))
        for slot, begin in zip(found, begins, strict=True):
            some = np.flatnonzero(begin[1:] > begin[:-1])
            if len(some):
                for bit, odds in enumerate(self.odds):
                    total[some, bit] += np.add.reduceat(odds[slot], begin[some])
        return total / np.maximum((begins[:, 1:] - begins[:, :-1]).sum(0), 1)[:, None], letter

    def losses(self, margins: np.ndarray) -> np.ndarray:
        loss = np.log1p(np.exp(-np.clip((margins * self.scale)[:, None, :] * self.code[None], -30, 30)))
        return (loss * self.weight).sum(2) / self.weight.sum()


def fit(docs: DataFrame, slots: int = SLOTS) -> Codebook | None:
    """Count n-grams by language over all training documents (fold not 0, lang not null); (languages x slots) numbers reach the driver."""
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id") != 0)).select("text", "lang")
    schema = pa.schema([("lang", pa.string()), ("slot", pa.int32()), ("n", pa.int64())])

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch, texts in chunks(batches):
            langs = np.array(batch.column(1).to_pylist(), dtype=object)
            for lang in set(langs):
                found, _, _ = ngram_slots([t for t, x in zip(texts, langs, strict=True) if x == lang], slots)
                held[lang] = held.get(lang, 0) + np.bincount(np.concatenate(found), minlength=slots)
        for lang, table in held.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(used)), pa.array(used.astype(np.int32)), pa.array(table[used])], schema=schema)

    counted = train.mapInArrow(count, "lang string, slot int, n long").groupBy("lang", "slot").agg(F.sum("n")).collect()
    if not counted:
        return None
    languages = sorted({r[0] for r in counted})
    place = {lang: i for i, lang in enumerate(languages)}
    counts = np.zeros((len(languages), slots))
    for lang, slot, n in counted:
        counts[place[lang], slot] = n
    return codebook(languages, counts)


def codebook(languages: list[str], counts: np.ndarray) -> Codebook:
    """The binary classifiers of each bit, from (languages, slots) counts."""
    slots = counts.shape[1]
    code = codewords(len(languages))
    dist = (counts + 1) / (counts.sum(1, keepdims=True) + slots)
    odds, weight, scale = [], [], []
    for bit in code.T:
        yes, no = dist[bit > 0], dist[bit < 0]
        o = np.log(yes.mean(0)) - np.log(no.mean(0)) if len(no) else np.zeros(slots)
        means = (counts @ o) / np.maximum(counts.sum(1), 1)  # mean log odds of each language's n-grams
        middle = (means[bit > 0].min() + means[bit < 0].max()) / 2 if len(no) else 0.0
        gap = max(1e-3, (means[bit > 0].min() - means[bit < 0].max()) / 2) if len(no) else 1.0
        odds.append(o - middle)
        weight.append(gap)
        scale.append(3.0 / gap)
    return Codebook(languages, code, np.array(odds), np.array(weight), np.array(scale))


def identify(docs: DataFrame, book: Codebook | None) -> DataFrame:
    """One row per document: doc_id, lang_pred, score (0 to 1), ambiguous."""
    shape = "doc_id long, lang_pred string, score double, ambiguous boolean"
    shared = docs.sparkSession.sparkContext.broadcast(book)  # languages x slots doubles

    def predict(batches):
        book = shared.value
        for batch, texts in chunks(batches):
            if book is None:
                label, score, unsure = ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
            else:
                margins, letter = book.margins(texts)
                loss = book.losses(margins)
                best = loss.argmin(1)
                odds = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
                odds /= odds.sum(1, keepdims=True)
                ordered = np.sort(odds, axis=1)
                lead = ordered[:, -1] - (ordered[:, -2] if odds.shape[1] > 1 else 0)
                label = [book.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)]
                score, unsure = np.where(letter, ordered[:, -1], 0.0), (lead < AMBIGUOUS) | ~letter
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(label), pa.array(score), pa.array(unsure)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(predict, shape)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Fit on the training fold, then predict every row; adds held_out."""
    found = identify(docs, fit(docs))
    return found.select("doc_id", (fold("doc_id") == 0).alias("held_out"), "lang_pred", "score", "ambiguous")
