"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trussline.llm.common import drop_stored, free_name, in_fold, map_rows, stored

UNDETERMINED = "und"
_NOT_LETTERS = re.compile(r"[\W\d_]+")


@dataclass(frozen=True)
class KernelSettings:
    """Bounds of the fit, chosen by hash: at most ``fit_rows`` labelled rows and ``fit_bytes`` of a language, and
    ``all_rows`` and ``all_bytes`` of all languages together, of which each has one row at least. At most ``landmarks``
    of a language's texts become landmarks, as many as ``cells`` of the landmark matrix allow."""

    order: int = 4
    fit_rows: int = 256
    fit_bytes: int = 1 << 20
    all_rows: int = 1 << 15
    all_bytes: int = 1 << 26
    landmarks: int = 32
    cells: int = 1 << 25
    ridge: float = 0.05
    sharpness: float = 4.0


@dataclass(frozen=True)
class KernelModel:
    """Landmark n-grams as a 0/1 matrix (grams x landmarks) and the map from kernel values to language scores."""

    languages: list[str]
    order: int
    grams: np.ndarray
    presence: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    sharpness: float


def spectrum(text: str | None, order: int) -> np.ndarray:
    """Distinct n-grams of 1 to ``order`` letters of the whole text, sorted, each packed into 64 bits.

    The text is lower-cased and every run of other characters becomes one space, so each word has its two ends. Letters
    beyond the basic plane are folded to 16 bits. Empty if the text is null or has no letter.
    """
    letters = _NOT_LETTERS.sub(" ", text.lower()).strip() if text else ""
    if not any(map(str.isalpha, letters)):
        return np.zeros(0, np.uint64)
    code = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    code = ((code ^ code >> 16) & 0xFFFF).astype(np.uint64)
    grams, gram = [code], code
    for n in range(1, order):
        gram = gram[:-1] << np.uint64(16) | code[n:]
        grams.append(gram)
    every = np.concatenate(grams)
    every.sort()
    return every[np.append(True, every[1:] != every[:-1])]


def _kernel(model_grams: np.ndarray, presence: np.ndarray, spectra: list[np.ndarray]) -> np.ndarray:
    """Shared n-grams of each text with each landmark over the root of the text's own number of n-grams."""
    flags = np.zeros((len(spectra), len(model_grams)), np.float32)
    for row, own in zip(flags, spectra):
        at = np.minimum(np.searchsorted(model_grams, own), len(model_grams) - 1)
        row[at[model_grams[at] == own]] = 1
    size = np.array([max(1, len(own)) for own in spectra], np.float32)
    return flags @ presence / np.sqrt(size)[:, None]


def fit(texts: list[str], languages: list[str], settings: KernelSettings = KernelSettings()) -> KernelModel | None:
    """Fit on labelled texts; None if no text has a letter. Landmarks are the first texts of each language."""
    rows = [(s, lang) for text, lang in zip(texts, languages) if len(s := spectrum(text, settings.order))]
    if not rows:
        return None
    names = sorted({lang for _, lang in rows})
    of = np.searchsorted(names, [lang for _, lang in rows])
    chosen, grams = _landmarks([s for s, _ in rows], of, settings)
    presence = np.zeros((len(grams), len(chosen)), np.float32)
    for k, own in enumerate(chosen):
        presence[np.searchsorted(grams, own), k] = 1 / np.sqrt(len(own))
    between = np.concatenate(list(_kernels(grams, presence, chosen)))
    values, vectors = np.linalg.eigh((between + between.T) / 2)
    good = values > 1e-6 * values[-1]
    whiten = vectors[:, good] / np.sqrt(values[good])
    mapped = np.concatenate([kernel @ whiten for kernel in _kernels(grams, presence, [s for s, _ in rows])])
    # targets are 1 for the own language and -1 for the others, so products with them need sums by language only
    count = np.bincount(of)
    weight = 1 / (count[of] * len(names))  # languages count alike
    middle, offset = weight @ mapped, np.full(len(names), 2 / len(names) - 1)
    z = mapped - middle
    by_language = np.zeros((len(names), z.shape[1]))
    np.add.at(by_language, of, z * weight[:, None])
    right = 2 * by_language.T - by_language.sum(axis=0)[:, None] * (1 + offset)
    solved = np.linalg.solve((z.T * weight) @ z + settings.ridge / len(rows) * np.eye(z.shape[1]), right)
    return KernelModel(names, settings.order, grams, presence, (whiten @ solved).astype(np.float32), offset - middle @ solved, settings.sharpness)


def _landmarks(spectra: list[np.ndarray], of: np.ndarray, settings: KernelSettings) -> tuple[list[np.ndarray], np.ndarray]:
    """(spectra of the landmarks, their n-grams): the first text of each language, then the second ones and so on."""
    order = np.argsort(of, kind="stable")
    nth = np.empty(len(of), np.int64)
    nth[order] = np.arange(len(of)) - np.searchsorted(of[order], of[order])
    chosen, grams = [], np.zeros(0, np.uint64)
    for k in np.lexsort((np.arange(len(of)), nth))[: int((nth < settings.landmarks).sum())]:
        more = np.union1d(grams, spectra[k])
        if chosen and (len(chosen) + 1) * len(more) > settings.cells:
            break
        chosen.append(k)
        grams = more
    return [spectra[k] for k in sorted(chosen, key=lambda k: (of[k], k))], grams


def _kernels(grams: np.ndarray, presence: np.ndarray, spectra: list[np.ndarray]) -> Iterator[np.ndarray]:
    for low in range(0, len(spectra), 64):
        yield _kernel(grams, presence, spectra[low : low + 64]).astype(np.float64)


def scores(model: KernelModel, spectra: list[np.ndarray]) -> np.ndarray:
    """Shares of the languages for each text, summing to 1: two matrix products and a softmax for the whole batch."""
    raw = model.sharpness * (_kernel(model.grams, model.presence, spectra) @ model.weights + model.bias)
    raw = np.exp(raw - raw.max(axis=1, keepdims=True))
    return raw / raw.sum(axis=1, keepdims=True)


def fit_sample(docs: DataFrame, train: Column, settings: KernelSettings) -> tuple[list[str], list[str]]:
    """Whole texts and labels within the bounds of ``settings``, by hash of the id.

    A count of the labels sets the share of ids that each language sends on, four times what is taken; only those rows
    are ranked and only the chosen texts reach the driver. The first text of a language is taken whatever its length, but
    shorter than average ones stand before longer ones.
    """
    rows = docs.filter(train & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).withColumn("bytes", F.octet_length("text"))
    counts = stored(rows.groupBy("lang").agg(F.count("*").alias("count"), F.avg("bytes").alias("mean")), "languages")
    languages = counts.count()
    if not languages:
        return [], []
    most, most_bytes = max(1, min(settings.fit_rows, settings.all_rows // languages)), max(1, min(settings.fit_bytes, settings.all_bytes // languages))
    parts = 1 << 24
    share = 1 + F.lit(4 * most * parts) / F.col("count")
    sent = rows.join(counts, "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(parts)) < share)
    order = Window.partitionBy("lang").orderBy(F.col("bytes") > F.col("mean"), F.xxhash64("doc_id"), "doc_id", "text")
    ranked = sent.select("doc_id", "lang", "text", F.row_number().over(order).alias("rank"), F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("upto"))
    chosen = ranked.filter((F.col("rank") == 1) | (F.col("rank") <= most) & (F.col("upto") <= most_bytes)).select("lang", "rank", "text").collect()
    drop_stored(counts)
    chosen.sort(key=lambda r: (r.lang, r["rank"]))
    return [r.text for r in chosen], [r.lang for r in chosen]


def learn(docs: DataFrame, train: Column, settings: KernelSettings = KernelSettings()) -> KernelModel | None:
    """The model of the labelled rows of ``docs`` where ``train`` holds; None if there is no such row with a letter."""
    return fit(*fit_sample(docs.select("doc_id", "lang", "text", train.alias("__train")), F.col("__train"), settings), settings)


def predict_language(docs: DataFrame, model: KernelModel | None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with a language (string) and a score (double) in columns of these names.

    Reads whole texts only: lang and other columns take no part in a prediction. ``und`` with score 0 is given to null
    texts, texts without a letter, and all texts if nothing was learned; existing columns of the two names are
    replaced. Equal texts get equal predictions, an equal score goes to the language first in order.
    """
    keep = [c for c in docs.columns if c not in names]
    fields = docs.select(*keep).schema
    at = keep.index("text")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            told, best = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            texts = batch.column(at).to_pylist()
            for low in range(0, len(texts) if model else 0, 64):
                own = [spectrum(t, model.order) for t in texts[low : low + 64]]
                known = [k for k, s in enumerate(own) if len(s)]
                if known:
                    share = scores(model, [own[k] for k in known])
                    for k, row in zip(known, share):
                        told[low + k], best[low + k] = model.languages[int(row.argmax())], float(row.max())
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(told, pa.string()), pa.array(best)], [*batch.schema.names, *names])

        return work

    return map_rows(docs.select(*keep), T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())]), make)


def language_report(docs: DataFrame, settings: KernelSettings = KernelSettings()) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; a quarter of the ids, by crc32, is held out of the fit."""
    held_out = in_fold(F.col("doc_id"), 4, 2)
    model = learn(docs, ~held_out & F.col("doc_id").isNotNull(), settings)
    slim = predict_language(docs.select("doc_id", "text"), model)
    return slim.select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, settings: KernelSettings = KernelSettings(), least: float = 1.2) -> DataFrame:
    """Rows whose language is told with at least ``least`` times an even share of the score, with the columns of ``docs``.

    Rows without a letter go. Where no label gives anything to learn from, nothing can be told and every row stays.
    """
    model = learn(docs, ~in_fold(F.col("doc_id"), 4, 2) & F.col("doc_id").isNotNull(), settings)
    if model is None:
        return docs
    names = tuple(free_name(docs, x) for x in ("language", "score"))
    told = predict_language(docs, model, names)
    return told.filter((F.col(names[0]) != UNDETERMINED) & (F.col(names[1]) >= min(1.0, least / len(model.languages)))).select(*docs.columns)
