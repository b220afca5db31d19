"""Language identification by nearest centroid over TF-IDF character n-grams.

A text becomes hashed counts of its byte trigrams (lower case, anything but
letters read as one space), weighted by log term frequency times inverse
document frequency, and scaled to length 1. Each language has several centroids
from spherical k-means over labelled texts; a text gets the language of the
centroid with the highest cosine, and is rejected where that cosine is lower than
that of nearly all labelled texts of the language and of about the same size that
were kept out of the centroids. Cuts of the kept-out texts stand for short texts.

The centroids are fitted on at most ``SAMPLE_PER_LANGUAGE`` labelled texts of a
language, the thresholds on half as many others, each language in a task of its
own. The classifier is some 50 KB for each language, whatever the input, and is sent
with the tasks; every text is scored in one pass without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices
from tideglass.shared import discard, materialise

BITS = 12
#: Labelled texts of a language that the centroids are fitted on, by smallest hash of the id.
SAMPLE_PER_LANGUAGE = 400
#: Languages the classifier tells apart at most; more are an error, as none is left out.
MOST_LANGUAGES = 2_000
#: Tasks that count the sample.
TRAIN_TASKS = 16
CENTROIDS = 3
#: A text is rejected below this quantile of the cosines of kept-out texts of its language and size.
REJECT_QUANTILE = 0.01
#: That quantile lies so many times as far below the middle as the lower quarter, as of normal values.
QUARTERS = 3.5
#: Every n-th text of a language is kept out of the centroids, and gives the thresholds.
KEPT_OUT = 3
#: Characters of the cuts of a kept-out text.
CUTS = (6, 12, 24, 48, 96, 192)
#: Kept-out texts of a language, and of all, that a size (a power of two of different n-grams) needs for a threshold.
LEAST_OF_ONE, LEAST_OF_ALL = 100, 20
UNDETERMINED = "und"

_MAYBE_LETTER = re.compile(r"[^\W\d_]")
_SPACES = bytes(i if i >= 128 or chr(i).isalpha() else 32 for i in range(256))


def ngram_counts(text: str) -> np.ndarray:
    """Hashed byte-trigram counts of a text, padded by a space on both sides."""
    raw = b" ".join((b" " + text.lower().encode().translate(_SPACES) + b" ").split(b"  "))
    b = np.frombuffer(raw, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(1 << BITS, np.int64)
    grams = b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))
    return np.bincount((grams * np.uint32(2654435761)) >> np.uint32(32 - BITS), minlength=1 << BITS)


def has_letter(text: str | None) -> bool:
    """Whether a text has a letter; numbers in circles, fractions and raised digits are none."""
    return text is not None and any(m[0].isalpha() for m in _MAYBE_LETTER.finditer(text))


def _sizes(counts: np.ndarray) -> np.ndarray:
    """The number of different n-grams of each row, as a power of two."""
    return np.log2(np.maximum(1, (counts > 0).sum(1))).astype(int)


@dataclass
class Centroids:
    """The fitted classifier: ``of[i]`` is the language of ``rows[i]``, ``least[l, s]`` the threshold of size s of language l."""

    languages: list[str]
    idf: np.ndarray
    rows: np.ndarray
    of: np.ndarray
    least: np.ndarray

    def vectors(self, counts: np.ndarray) -> np.ndarray:
        x = np.log1p(counts.astype(np.float32)) * self.idf
        norms = np.sqrt(np.einsum("ij,ij->i", x, x))
        return x / np.where(norms > 0, norms, 1)[:, None]

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(language number, cosine in 0..1, accepted) of each row; the first centroid wins ties."""
        cosine = self.vectors(counts) @ self.rows.T
        best = cosine.argmax(1)
        score = np.clip(cosine[np.arange(len(best)), best], 0, 1).astype(np.float64)
        return self.of[best], score, score >= self.least[self.of[best], _sizes(counts)]


def _k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means, started from the mean and then the farthest texts; deterministic."""
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-9)
    centres = unit(x.mean(0, keepdims=True))
    while len(centres) < min(k, len(x)):
        centres = np.vstack([centres, x[(x @ centres.T).max(1).argmin()]])
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(1)
        centres = unit(np.stack([x[nearest == i].mean(0) if (nearest == i).any() else centres[i] for i in range(len(centres))]))
    return centres


def _low(cosine: np.ndarray) -> float:
    """The quantile below which is rejected; of few texts it follows from their middle and lower quarter, so that no odd ones decide."""
    if len(cosine) * REJECT_QUANTILE >= 2:
        return float(np.quantile(cosine, REJECT_QUANTILE))
    middle, quarter = np.quantile(cosine, (0.5, 0.25))
    return float(max(0.0, middle - QUARTERS * max(middle - quarter, 0.1 * middle)))


def _by_size(cosine: np.ndarray, size: np.ndarray, least: int) -> np.ndarray:
    """The quantile of each size, NaN for too few."""
    return np.array([_low(cosine[size == s]) if (size == s).sum() >= least else np.nan for s in range(BITS + 1)])


def _thresholds(of: np.ndarray, languages: int, cosine: np.ndarray, size: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """The threshold of each language and size from kept-out texts and their cuts, of languages ``of``.

    A size of too few takes that of all languages' texts, else of the next
    smaller size, else of the next larger; none is above that of a larger size.
    All of a language are lowered alike where more than the quantile of its whole
    texts would be rejected.
    """
    if not whole.any():
        return np.zeros((languages, BITS + 1))
    every, out = _by_size(cosine, size, LEAST_OF_ALL), np.empty((languages, BITS + 1))
    for i in range(languages):
        own = of == i
        least = _by_size(cosine[own], size[own], LEAST_OF_ONE)
        least = np.where(np.isnan(least), every, least)
        known = np.flatnonzero(~np.isnan(least))
        if len(known):
            least = least[known[np.maximum(0, np.searchsorted(known, np.arange(BITS + 1), "right") - 1)]]
        else:
            least = np.full(BITS + 1, _low(cosine))
        least, texts = np.minimum.accumulate(least[::-1])[::-1], own & whole
        out[i] = least * (min(1.0, _low(cosine[texts] / np.maximum(least[size[texts]], 1e-9))) if texts.any() else 1.0)
    return out


def _packed(text: str) -> bytes:
    counts = ngram_counts(text)
    at = np.flatnonzero(counts)
    return np.stack([at, counts[at]]).astype(np.uint32).tobytes()


def _unpacked(packed: list[bytes]) -> np.ndarray:
    counts = np.zeros((len(packed), 1 << BITS), np.float32)
    for row, p in zip(counts, packed, strict=True):
        at, n = np.frombuffer(p, np.uint32).reshape(2, -1)
        row[at] = n
    return counts


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs, out, flags, cuts = [], [], [], []
        for lang, text, kept_out in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if has_letter(text):
                langs.append(lang)
                out.append(_packed(text))
                flags.append(kept_out)
                cuts.append([_packed(text[:n]) for n in CUTS if n < len(text) and has_letter(text[:n])] if kept_out else [])
        yield pa.record_batch([pa.array(langs, pa.string()), pa.array(out, pa.binary()), pa.array(flags, pa.bool_()), pa.array(cuts, pa.list_(pa.binary()))], names=["lang", "counts", "kept_out", "cuts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row of a task: how many of its texts there are, and how many have each n-gram."""
    n, found = 0, np.zeros(1 << BITS, np.int64)
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            n += 1
            found[np.frombuffer(packed, np.uint32).reshape(2, -1)[0]] += 1
    yield pa.record_batch([pa.array([n]), pa.array([found.tobytes()], pa.binary())], names=["n", "found"])


def _language(model: Centroids, counts: list[bytes], kept_out: list[bool], cuts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(centroids, cosines of kept-out texts and their cuts, their sizes, which are whole texts) of one language.

    A kept-out text with the counts of a fitted one says nothing of new texts and
    is left out; where all texts of a language are kept out, they are fitted on.
    """
    taught = sorted(c for c, k in zip(counts, kept_out, strict=True) if not k or all(kept_out))
    known = set(taught)
    centres = _k_means(model.vectors(_unpacked(taught)), CENTROIDS).astype(np.float32)
    found = [(np.zeros(0), np.zeros(0, int), np.zeros(0, bool))]
    for whole, some in sorted((c, x) for c, x in zip(counts, cuts, strict=True) if c not in known):
        part = _unpacked([whole, *some])
        found.append(((model.vectors(part) @ centres.T).max(1).astype(float), _sizes(part), np.arange(len(part)) == 0))
    return centres, *(np.concatenate(c) for c in zip(*found, strict=True))


def fit(docs: DataFrame, learn: Column, lang: str = "lang", text: str = "text", doc_id: str = "doc_id") -> Centroids | None:
    """Fit on the rows of ``docs`` where ``learn`` holds and the language is known; None if there are none.

    The sample is picked by id, before any text is read: each task keeps its
    best of a language, as many as the sample takes, so a hot language costs no
    more than others. Texts of a repeated id all teach, up to the sample's
    number. Centroids come from one task for each language. More than
    ``MOST_LANGUAGES`` languages are an error.
    """
    known = docs.where(learn & F.col(lang).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    by_hash = Window.partitionBy("lang").orderBy("order", "doc_id")
    sample_size = SAMPLE_PER_LANGUAGE * KEPT_OUT // (KEPT_OUT - 1)
    sizes = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    languages = sizes.limit(MOST_LANGUAGES + 1).collect()
    if not languages:
        return None
    if len(languages) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # of a large language only about twice the sample is sorted; that fewer than the sample are left has no odds to speak of
    below = [(r["lang"], -(2.0**63) + 2.0**64 * 2 * sample_size / r["n"] if r["n"] > 4 * sample_size else 2.0**64) for r in languages]
    below = F.broadcast(docs.sparkSession.createDataFrame(below, "drawn_lang string, below double"))
    picked = (
        known.select("doc_id", "lang", F.xxhash64("doc_id").alias("order"))
        .join(below, F.col("lang") == F.col("drawn_lang"))
        .where(F.col("order").cast("double") < F.col("below"))
        .withColumn("nth", F.row_number().over(by_hash))
        .where(F.col("nth") <= sample_size)
        .groupBy(F.col("doc_id").alias("picked_id"))
        .agg((F.max(F.col("nth") % KEPT_OUT) == 0).alias("kept_out"))
    )
    sample = known.join(F.broadcast(picked), F.col("doc_id") == F.col("picked_id")).select("lang", "text", "kept_out").repartition(TRAIN_TASKS)
    rows = materialise(map_slices(sample, _counted, "lang string, counts binary, kept_out boolean, cuts array<binary>"), "lang_sample")
    # a language of kept-out texts alone is taught by them
    whole = rows.groupBy("lang").agg(F.min("kept_out").alias("only")).where("only").select("lang")
    taught = rows.where("not kept_out").select("counts").union(rows.join(F.broadcast(whole), "lang", "left_semi").select("counts"))
    sums = map_slices(taught, _frequencies, "n long, found binary").collect()
    n = sum(r["n"] for r in sums)
    if not n:
        return None
    have = np.sum([np.frombuffer(r["found"], np.int64) for r in sums], axis=0)
    model = Centroids([], (np.log((1 + n) / (1 + have)) + 1).astype(np.float32), np.zeros((0, 1 << BITS), np.float32), np.zeros(0, int), np.zeros((0, BITS + 1)))

    def learned(table: pa.Table) -> pa.Table:
        found = _language(model, *(table.column(c).to_pylist() for c in ("counts", "kept_out", "cuts")))
        return pa.table([table.column("lang").slice(0, 1), *(pa.array([x.tobytes()], pa.binary()) for x in found)], names=["lang", "centres", "cosine", "size", "whole"])

    got = sorted(rows.groupBy("lang").applyInArrow(learned, "lang string, centres binary, cosine binary, size binary, whole binary").collect(), key=lambda r: r["lang"])
    discard(rows)
    centres, cosine, size, whole = ([np.frombuffer(r[k], kind) for r in got] for k, kind in (("centres", np.float32), ("cosine", float), ("size", np.int64), ("whole", bool)))
    model.languages = [r["lang"] for r in got]
    model.rows = np.concatenate(centres).reshape(-1, 1 << BITS)
    model.of = np.repeat(np.arange(len(got)), [len(c) >> BITS for c in centres])
    of = np.repeat(np.arange(len(got)), [len(c) for c in cosine])
    model.least = _thresholds(of, len(got), *(np.concatenate(x) for x in (cosine, size, whole)))
    return model


def identify(docs: DataFrame, model: Centroids | None, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_accepted.

    A null text, a text without letters and any text under an unfitted model
    (None) get ``und``, score 0 and are not accepted. Columns of ``docs`` with
    these names are replaced; repeated rows are scored alike.
    """
    return scored(docs.drop("lang_pred", "lang_score", "lang_accepted"), model, text)


def scored(docs: DataFrame, model: Centroids | None, text: str = "text", keep: list[str] | None = None, names: tuple[str, str, str] = ("lang_pred", "lang_score", "lang_accepted")) -> DataFrame:
    """The columns ``keep`` of ``docs`` with the language, its cosine and whether it is accepted, under ``names``."""
    keep = docs.columns if keep is None else keep
    fields = [docs.schema[c] for c in keep]
    slim = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text_to_score"))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in fields] + [f"`{n}` {t}" for n, t in zip(names, ("string", "double", "boolean"), strict=True)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            langs, scores, ok = [UNDETERMINED] * n, np.zeros(n), np.zeros(n, bool)
            texts = batch.column(batch.num_columns - 1).to_pylist()
            at = [i for i, t in enumerate(texts) if has_letter(t)] if model is not None else []
            for start in range(0, len(at), 256):
                part = at[start : start + 256]
                best, cosine, accepted = model.predict(np.stack([ngram_counts(texts[i]) for i in part]))
                scores[part], ok[part] = cosine, accepted
                for i, k in zip(part, best, strict=True):
                    langs[i] = model.languages[k]
            yield pa.record_batch([*batch.columns[:-1], pa.array(langs, pa.string()), pa.array(scores), pa.array(ok)], names=[*keep, *names])

    return map_slices(slim, score, schema)
