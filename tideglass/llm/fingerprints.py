"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs (its lines, long lines cut every ``PIECE`` characters, blank
ones left out) are hashed to 64-bit digests; a paragraph that comes again gets a
digest for its second, third ... time. Each digest is added to three cells of a
sketch: a count, the sum of the digests and the sum of their check hashes. The
difference of two sketches holds just the digests in which the texts differ, and
peeling cells with a single digest recovers them all. Where peeling gets stuck,
both sketches are built anew ``GROWTH`` times larger.

A batch of documents is sketched, subtracted and peeled together in numpy
arrays, so a document costs a few microseconds for each paragraph.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices, utf8

#: Longest piece of a line, in code points.
PIECE = 64
#: Cells of a fingerprint, a multiple of the number of hash functions.
CELLS = 24
HASHES = 3
GROWTH = 4
#: Retries before a pair's digests are counted as they are; never reached in practice, as the sketch then has far more cells than digests.
MOST_RETRIES = 14
#: Documents that are sketched together, and paragraphs after which a batch is closed.
TOGETHER, PARAGRAPHS = 2048, 200_000
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A well-spread 64-bit function of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def paragraph_digests(text: str) -> list[int]:
    """Distinct 64-bit digests of a text's paragraphs."""
    out: list[int] = []
    for line in text.split("\n"):
        for start in range(0, len(line), PIECE):
            piece = line[start : start + PIECE]
            if not piece.isspace():
                out.append(xxhash.xxh3_64_intdigest(piece))
    if len(set(out)) < len(out):
        times: dict[int, int] = {}
        for i, d in enumerate(out):
            n = times[d] = times.get(d, -1) + 1
            out[i] = (d + n * int(_STEP)) & 0xFFFFFFFFFFFFFFFF
        out = list(dict.fromkeys(out))
    return out


class Sketches:
    """Sketches of many documents side by side, all of one size."""

    def __init__(self, documents: int, cells: int, salt: int = 0):
        self.documents, self.cells, self.salt = documents, cells, salt
        self.count = np.zeros(documents * cells, np.int64)
        self.sum = np.zeros(documents * cells, np.uint64)
        self.check = np.zeros(documents * cells, np.uint64)

    def _places(self, digests: np.ndarray, document: np.ndarray) -> np.ndarray:
        third = self.cells // HASHES
        at = [(_mixed(digests + np.uint64((j + 1 + HASHES * self.salt) * int(_STEP) & 0xFFFFFFFFFFFFFFFF)) >> np.uint64(33)).astype(np.int64) % third + j * third for j in range(HASHES)]
        return (np.stack(at) + document * self.cells).ravel()

    def add(self, digests: np.ndarray, document: np.ndarray, sign: np.ndarray | int = 1) -> np.ndarray:
        """Add digests to their documents' cells, or take them out where ``sign`` is -1; the cells that were touched."""
        at = self._places(digests, document)
        sign = np.broadcast_to(np.asarray(sign, np.int64), digests.shape)
        factor = sign.astype(np.uint64)
        np.add.at(self.count, at, np.tile(sign, HASHES))
        np.add.at(self.sum, at, np.tile(digests * factor, HASHES))
        np.add.at(self.check, at, np.tile(_mixed(digests ^ _STEP) * factor, HASHES))
        return at

    def minus(self, other: Sketches) -> Sketches:
        out = Sketches(self.documents, self.cells, self.salt)
        out.count, out.sum, out.check = self.count - other.count, self.sum - other.sum, self.check - other.check
        return out

    def peel(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Take out all digests that can be recovered: (digest, document, sign), and which documents are done."""
        found: list[tuple[np.ndarray, ...]] = []
        look = np.flatnonzero(self.count)
        while len(look):
            n = self.count[look]
            look = look[(n == 1) | (n == -1)]
            sign = self.count[look]
            digest = self.sum[look] * sign.astype(np.uint64)
            single = _mixed(digest ^ _STEP) * sign.astype(np.uint64) == self.check[look]
            look, sign, digest = look[single], sign[single], digest[single]
            document = look // self.cells
            _, first = np.unique(np.stack([document.astype(np.uint64), digest]), axis=1, return_index=True) if len(look) else (None, np.zeros(0, int))
            digest, document, sign = digest[first], document[first], sign[first]
            if not len(digest):
                break
            found.append((digest, document, sign))
            look = np.unique(self.add(digest, document, -sign))
        left = (self.count != 0) | (self.sum != 0) | (self.check != 0)
        done = ~left.reshape(self.documents, self.cells).any(1)
        if not found:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), done
        return *(np.concatenate(x) for x in zip(*found, strict=True)), done

    def texts(self) -> list[str]:
        """Each document's cells as base64 of (count, digest sum, check sum) in little-endian order."""
        packed = np.zeros((self.documents * self.cells,), np.dtype([("count", "<i4"), ("sum", "<u8"), ("check", "<u4")]))
        packed["count"], packed["sum"], packed["check"] = self.count, self.sum, self.check.astype(np.uint32)
        size = self.cells * packed.dtype.itemsize
        raw = packed.tobytes()
        return [base64.b64encode(raw[i * size : (i + 1) * size]).decode() for i in range(self.documents)]


def flat(digests: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Lists of digests as (digests, number of the document)."""
    sizes = np.array([len(d) for d in digests], np.int64)
    return np.array([x for d in digests for x in d], np.uint64), np.repeat(np.arange(len(digests)), sizes)


def differences(old: list[list[int]], new: list[list[int]], first: Sketches | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The digests in which two versions of each document differ: (digest, document, sign), +1 only in the old one.

    ``first`` is the difference of the fingerprints, if it is at hand. Documents
    whose peeling gets stuck are sketched again in more cells.
    """
    (a, of_a), (b, of_b) = flat(old), flat(new)
    open_ = np.arange(len(old))
    cells, found = CELLS, []
    for salt in range(MOST_RETRIES):
        number = np.full(len(old), -1)
        number[open_] = np.arange(len(open_))
        if salt == 0 and first is not None:
            sketch = first
        else:
            sketch = Sketches(len(open_), cells, salt)
            for digests, of, sign in ((a, of_a, 1), (b, of_b, -1)):
                mine = number[of] >= 0
                sketch.add(digests[mine], number[of[mine]], sign)
        digest, document, sign, done = sketch.peel()
        good = done[document]
        found.append((digest[good], open_[document[good]], sign[good]))
        open_ = open_[~done]
        if not len(open_):
            break
        cells *= GROWTH
    for i in open_:
        only = [set(old[i]) - set(new[i]), set(new[i]) - set(old[i])]
        found.append((np.array([*only[0], *only[1]], np.uint64), np.full(len(only[0]) + len(only[1]), i), np.repeat([1, -1], [len(only[0]), len(only[1])])))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def likeness(old: list[list[int]], new: list[list[int]], first: Sketches | None = None) -> np.ndarray:
    """Shared paragraphs over all paragraphs of two versions, by the recovered differences; 1 for two empty texts."""
    _, document, sign = differences(old, new, first)
    gone = np.bincount(document[sign > 0], minlength=len(old))
    came = np.bincount(document[sign < 0], minlength=len(old))
    n = np.array([len(d) for d in old])
    return np.where(n + came > 0, (n - gone) / np.maximum(n + came, 1), 1.0)


def sketched(digests: list[list[int]]) -> Sketches:
    out = Sketches(len(digests), CELLS)
    out.add(*flat(digests))
    return out


def fingerprint(docs: DataFrame, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of every whole text (null: empty). One pass, no shuffle."""
    keep = [c for c in docs.columns if c != name]
    schema = ", ".join([f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep] + [f"`{name}` string"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.record_batch([*batch.columns[:-1], pa.array(sketched([paragraph_digests(t or "") for t in texts]).texts(), pa.string())], names=[*keep, name])

    return map_slices(docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text).alias("_text")), each, schema)


def compared(versions: DataFrame, old: str, new: str, keep: list[str]) -> DataFrame:
    """``keep`` of each row with both texts' fingerprints, the digests recovered as only_old and only_new, and the likeness."""
    schema = ", ".join([f"`{c}` {versions.schema[c].dataType.simpleString()}" for c in keep] + ["old_fingerprint string, new_fingerprint string, only_old array<string>, only_new array<string>, likeness double"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = ([paragraph_digests(t or "") for t in batch.column(batch.num_columns - k).to_pylist()] for k in (2, 1))
            sa, sb = sketched(a), sketched(b)
            digest, document, sign = differences(a, b, sa.minus(sb))
            only = ([[] for _ in a], [[] for _ in a])
            for d, i, s in zip(digest.tolist(), document.tolist(), sign.tolist(), strict=True):
                only[0 if s > 0 else 1][i].append(f"{d:016x}")
            lists = [pa.array([sorted(x) for x in side], pa.list_(pa.string())) for side in only]
            yield pa.record_batch([*batch.columns[:-2], pa.array(sa.texts()), pa.array(sb.texts()), *lists, pa.array(likeness(a, b, sa.minus(sb)))], names=[*keep, "old_fingerprint", "new_fingerprint", "only_old", "only_new", "likeness"])

    return map_slices(versions.select(*[F.col(f"`{c}`") for c in keep], F.col(old).alias("_old"), F.col(new).alias("_new")), each, schema)


#: Ranges of ids at most: the limits, 8 bytes each, go with every task. A task sorts its range with what memory it has and streams over it.
MOST_RANGES = 32_768


def _limits(docs: DataFrame, key: Column, parts: int) -> tuple[np.ndarray, int | None]:
    """(ascending ids that cut the table into about ``parts`` even ranges, the smallest id); the list of shares is one literal."""
    if parts < 2:
        shares = F.lit(None)
    else:
        shares = F.percentile_approx("key", F.split(F.lit(",".join(str(k / parts) for k in range(1, parts))), ",").cast("array<double>"), 8 * parts)
    facts = docs.select(key.alias("key")).agg(shares.alias("limits"), F.min("key").alias("first")).first()
    return np.array(sorted({s for s in facts["limits"] or [] if s > facts["first"]}), np.int64), facts["first"]


def _range_of(limits: np.ndarray, first: int | None):
    """A column function: twice the number of an id's range, one more where the id is the smallest of its range."""

    def number(key: pd.Series) -> pd.Series:
        ids = key.to_numpy()
        at = np.searchsorted(limits, ids, "right")
        starts = (ids == first) if not len(limits) else (ids == np.where(at > 0, limits[np.maximum(at - 1, 0)], first))
        return pd.Series(2 * at.astype(np.int32) + starts)

    return F.pandas_udf(number, "int")


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows of (bucket, tail, doc_id, text) dealt by ranges of ids and sorted, each range with the next one's first row.

    A text is shuffled once. The range limits are ids of the table, so the row
    at a limit is known as the first of its range and is also sent, as the
    ``tail``, to the range before; the table's first row is the tail of the last
    range. Where an id at a limit is repeated, all its rows are sent, and the
    first of them counts. Null ids come first; rows with the same id follow by
    text. The limits go with the tasks, so that the plan does not grow with them.
    """
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(-(2**63)).cast("long"))
    n = min(MOST_RANGES, max(2 * docs.select(doc_id).rdd.getNumPartitions(), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    limits, first = _limits(docs, key, n)
    rows = docs.select(key.alias("key"), F.col(doc_id).alias("doc_id"), utf8(text).alias("text")).withColumn("place", _range_of(limits, first)("key"))
    bucket, last = F.shiftright("place", 1), len(limits)
    before = F.when(bucket == 0, F.lit(last)).otherwise(bucket - 1)
    own = F.struct(bucket.alias("bucket"), F.lit(False).alias("tail"))
    tail = F.struct(before.cast("int").alias("bucket"), F.lit(True).alias("tail"))
    dealt = rows.select("doc_id", "key", "text", F.explode(F.when(F.col("place") % 2 == 1, F.array(own, tail)).otherwise(F.array(own))).alias("to")).select("to.bucket", "to.tail", "doc_id", "key", "text")
    return dealt.repartitionById(last + 1, F.col("bucket")).sortWithinPartitions("bucket", "tail", "key", "text").select("bucket", "tail", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``following``, or all of it."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of each document, which needs the row after it."""
    waiting: tuple | None = None
    rows: list[tuple] = []
    paragraphs = 0

    def results() -> pa.RecordBatch:
        own, new, after = ([r[k] for r in rows] for k in (3, 4, 5))
        own_sketch, new_sketch, after_sketch = sketched(own), sketched(new), sketched(after)
        near_edited = likeness(own, new, own_sketch.minus(new_sketch))
        near_next = likeness(own, after, own_sketch.minus(after_sketch))
        ids, sizes, digests = ([r[k] for r in rows] for k in (0, 1, 2))
        return pa.record_batch(
            [pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(own_sketch.texts()), pa.array(new_sketch.texts()), pa.array(near_edited), pa.array(near_next)],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for bucket, tail, doc_id, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            text = (raw or b"").decode("utf-8", "replace")
            digests = paragraph_digests(text)
            if waiting is not None and waiting[0] == bucket:
                _, old_id, old_text, old_digests = waiting
                new = edited(old_text, text)
                rows.append((old_id, len(old_text), hashlib.sha256(new.encode()).hexdigest(), old_digests, paragraph_digests(new), digests))
                paragraphs += 2 * len(old_digests) + len(digests)
            waiting = None if tail else (bucket, doc_id, text, digests)
            if len(rows) >= TOGETHER or paragraphs >= PARAGRAPHS:
                yield results()
                rows, paragraphs = [], 0
    if rows:
        yield results()


def fingerprint_edits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how near they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint,
    near_edited, near_next. The edit puts the start of the next document (by
    ascending id; after the last one the first) in place of the last half. A
    null text counts as empty; the only document of a table follows itself; an
    empty table gives an empty result.
    """
    return map_slices(in_order(docs, doc_id, text), _edits, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
