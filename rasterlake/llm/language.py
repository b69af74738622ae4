"""Language ID: inference of multilingual mixtures.

Each language is a distribution of hashed byte n-grams inside words (3 and 5
bytes around each byte), learned from labelled documents. A word's likelihood
under a language is that of its n-grams, and a document is a mixture: its words
come from languages in unknown proportions, which expectation-maximisation
estimates. The languages of a document are selected by penalised likelihood: one
is added as long as the gain exceeds ``PENALTY`` times the log of the word count.
The prediction is the language of largest proportion, its score the proportion.

The classifier is fitted on a sample of about ``SAMPLE_DOCS`` documents of each
language, chosen by a hash of the id; every label is learned. Counts are added up in
Spark, one language at a time, and travel compressed; the model has 0.5 MB a language,
and ``LANGUAGE_BLOCK`` languages at once are looked up in it. Everything else reads whole texts of all documents, and no shuffle follows.

Defined cases: a null text or one without a letter is ``und`` with score 0, and
so is every text if nothing could be learned; a null language teaches nothing;
a null id counts as the empty string when documents are held out; equal texts
get equal answers; an empty table gives an empty result; other columns are not
read. A very long text is one chunk, read whole: its words times the languages are held as floats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterlake.llm import words as W

ORDERS = (3, 5)
BUCKET_BITS = 16
SMOOTHING = 0.5
SAMPLE_DOCS = 2000
LANGUAGE_BLOCK = 64
#: Languages whose counts a task holds before it hands them on.
FLUSH_LANGUAGES = 64
HOLD_OUT = 5
PENALTY = 2.0
STEPS = 12
UNKNOWN = "und"

#: Bytes of words: ASCII letters in lower case and everything above ASCII; the rest is a word's end.
_WORD = np.zeros(256, dtype=bool)
_WORD[97:123] = _WORD[128:] = True
_BYTE = np.where(_WORD, np.arange(256), 32).astype(np.uint64)


@dataclass(frozen=True)
class Model:
    languages: list[str]
    log_p: np.ndarray  # order, bucket, language


def _buckets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the bucket of the n-gram around each byte of words, and each word's first such byte."""
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(np.cumsum(inside[:-1], dtype=np.int8))
    word_of = np.repeat(np.arange(len(starts)), ends - starts)
    value = _BYTE[data]
    found = []
    for order in ORDERS:
        half = order // 2
        h = np.zeros(len(at), dtype=np.uint64)
        for d in range(-half, half + 1):
            p = at + d
            ok = (p >= starts[word_of]) & (p < ends[word_of])
            h = h * np.uint64(0x100000001B3) + np.where(ok, value[np.clip(p, 0, len(data) - 1)], np.uint64(32))
        found.append((W.mix(h + np.uint64(order)) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64))
    return found, np.concatenate([[0], np.cumsum(ends - starts)[:-1]]) if len(starts) else np.zeros(0, np.int64)


def _counted(counts: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array([zlib.compress(c.tobytes(), 1) for c in counts.values()], pa.binary())], names=["lang", "counts"])


def _read(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw), np.int64).reshape(len(ORDERS), -1)


def _count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch, data, offsets in W.batches(rows):
        starts, ends, owner = W.spans(data, offsets, _WORD)
        buckets, _ = _buckets(data, starts, ends)
        byte_owner = np.repeat(owner, ends - starts)
        langs = batch.column("lang").to_pylist()
        for lang in set(langs):
            if lang not in counts and len(counts) >= FLUSH_LANGUAGES:
                yield _counted(counts)
                counts.clear()
            mine = np.isin(byte_owner, [i for i, x in enumerate(langs) if x == lang])
            own = counts.setdefault(lang, np.zeros((len(ORDERS), 1 << BUCKET_BITS), dtype=np.int64))
            for k, b in enumerate(buckets):
                own[k] += np.bincount(b[mine], minlength=1 << BUCKET_BITS)
    yield _counted(counts)


def _add(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of rows that are sorted by language."""
    total: dict[str, np.ndarray] = {}
    for batch in rows:
        for lang, raw in zip(batch.column("lang").to_pylist(), batch.column("counts").to_pylist(), strict=True):
            if total and lang not in total:
                yield _counted(total)
                total.clear()
            counts = _read(raw)
            total[lang] = total[lang] + counts if lang in total else counts
    yield _counted(total)


def learn(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of (doc_id, text, lang) rows; the sample's bound is ``sample_docs`` a language, on average."""
    usable = labelled.filter("lang IS NOT NULL AND text IS NOT NULL")
    sizes = usable.groupBy("lang").count().collect()
    if not sizes:
        return Model([], np.zeros((len(ORDERS), 1 << BUCKET_BITS, 0), np.float32))
    share = usable.sparkSession.createDataFrame([(r["lang"], min(1.0, sample_docs / r["count"])) for r in sizes], "lang string, share double")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    sample = usable.join(F.broadcast(share), "lang").filter(draw < F.col("share")).select("lang", F.lower("text").alias("text"))
    counted = sample.mapInArrow(_count, "lang string, counts binary").repartition("lang").sortWithinPartitions("lang").mapInArrow(_add, "lang string, counts binary").orderBy("lang").collect()
    log_p = np.empty((len(ORDERS), 1 << BUCKET_BITS, len(counted)), np.float32)
    for j, r in enumerate(counted):
        counts = _read(r["counts"])
        log_p[:, :, j] = np.log((counts + SMOOTHING) / (counts.sum(axis=1, keepdims=True) + SMOOTHING * counts.shape[1]))
    return Model([r["lang"] for r in counted], log_p)


def _sum_by(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of runs that ``first`` bounds; a run may be empty, and a sum depends on its run alone."""
    total = np.zeros((len(first) - 1, *values.shape[1:]))
    held = np.flatnonzero(first[1:] > first[:-1])
    if len(held):
        total[held] = np.add.reduceat(values, first[held], axis=0)
    return total


def mixtures(word_log_p: np.ndarray, first: np.ndarray, steps: int = STEPS, penalty: float = PENALTY) -> np.ndarray:
    """Each document's proportions of languages; ``first`` bounds each document's words."""
    n_docs, n_langs = len(first) - 1, word_log_p.shape[1]
    n_words = np.diff(first)
    owner = np.repeat(np.arange(n_docs), n_words)
    top = word_log_p.max(axis=1, keepdims=True)
    p, shift = np.exp(word_log_p - top), _sum_by(top[:, 0], first)
    singles = _sum_by(word_log_p, first)
    best = singles.argmax(axis=1)
    chosen = np.zeros((n_docs, n_langs), dtype=bool)
    chosen[np.arange(n_docs), best] = True
    likelihood, result = singles[np.arange(n_docs), best], chosen.astype(np.float64)

    def em(docs: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words = np.flatnonzero(np.isin(owner, docs)) if len(docs) < n_docs else np.arange(len(owner))
        place = np.searchsorted(docs, owner[words])
        bounds = np.concatenate([[0], np.cumsum(n_words[docs])])
        share, mine = allowed / allowed.sum(axis=1, keepdims=True), p[words]
        for _ in range(steps):
            joint = share[place] * mine
            joint /= np.maximum(joint.sum(axis=1, keepdims=True), 1e-300)
            share = _sum_by(joint, bounds) / np.maximum(n_words[docs], 1)[:, None]
        fit = np.log(np.maximum((share[place] * mine).sum(axis=1), 1e-300))
        return share, _sum_by(fit, bounds) + shift[docs]

    docs = np.flatnonzero(n_words > 1) if n_langs > 1 else np.zeros(0, np.int64)
    if len(docs):
        order, fit = em(docs, np.ones((len(docs), n_langs)))
        # a mixture of fewer languages fits no better, so no second one can be worth its penalty here
        open_ = fit - likelihood[docs] > penalty * np.log(n_words[docs])
        docs, order = docs[open_], order[open_]
        while len(docs):
            more = np.where(chosen[docs], -1.0, order)
            candidate = more.argmax(axis=1)
            allowed = chosen[docs].copy()
            allowed[np.arange(len(docs)), candidate] = True
            share, fit = em(docs, allowed.astype(np.float64))
            better = (fit - likelihood[docs] > penalty * np.log(n_words[docs])) & (more.max(axis=1) > 0)
            kept = docs[better]
            chosen[kept], result[kept], likelihood[kept] = allowed[better], share[better], fit[better]
            docs, order = kept, order[better]
            full = chosen[docs].all(axis=1)
            docs, order = docs[~full], order[~full]
    return result


def _predict(shared: Broadcast):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = shared.value
        n_langs = len(model.languages)
        kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
        for batch, data, offsets in W.batches(rows, limit=max(1 << 12, (W.CHUNK_BYTES * 2) // max(4, n_langs))):
            n = batch.num_rows
            starts, ends, owner = W.spans(data, offsets, _WORD)
            share = np.zeros((n, n_langs))
            if n_langs and len(starts):
                buckets, first_byte = _buckets(data, starts, ends)
                word_log_p = np.empty((len(starts), n_langs))
                for j in range(0, n_langs, LANGUAGE_BLOCK):
                    block = slice(j, j + LANGUAGE_BLOCK)
                    log_p = sum(model.log_p[k][:, block][b] for k, b in enumerate(buckets)) / len(ORDERS)
                    word_log_p[:, block] = np.add.reduceat(log_p, first_byte, axis=0)
                share = mixtures(word_log_p, W.row_starts(owner, n))
            known = np.array(batch.column("has_letter").to_pylist(), dtype=bool) & (np.bincount(owner, minlength=n) > 0) & (n_langs > 0)
            top = share.argmax(axis=1) if n_langs else np.zeros(n, np.int64)
            parts = [sorted(({"lang": model.languages[j], "share": float(s[j])} for j in np.flatnonzero(s)), key=lambda x: -x["share"]) if k else [] for s, k in zip(share, known, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array([model.languages[t] if k else UNKNOWN for t, k in zip(top, known, strict=True)]), pa.array([min(1.0, float(share[i, top[i]])) if known[i] else 0.0 for i in range(n)]), pa.array(parts, kind)],
                names=["doc_id", "held_out", "lang_pred", "score", "languages"],
            )

    return run


def held_out(id_col: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % HOLD_OUT == 0


def identify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, languages) of every document, learned from those not held out."""
    model = learn(docs.select("doc_id", "text", "lang").filter(~held_out()), sample_docs)
    text = F.coalesce("text", F.lit(""))
    only = docs.select("doc_id", held_out().alias("held_out"), text.rlike(r"\p{L}").alias("has_letter"), F.lower(text).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = f"doc_id {only.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>"
    return only.mapInArrow(_predict(shared), schema)
