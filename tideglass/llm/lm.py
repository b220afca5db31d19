"""Cross-entropy difference of a target and a background bigram model over all words.

P(w | v) = (c(v, w) + ``CLASS_PRIOR`` * U(w)) / (c(v) + ``CLASS_PRIOR``), where
c(v, w) counts every pair of neighbours in the model's texts (the start of a text
is a v of its own) and U is the unigram model of the same texts, smoothed by
``WORD_PRIOR`` over all words of the corpus and one unseen word. No word and no
pair is left out, so what is kept from the corpus grows with it.

Two passes read the texts. The first counts words. The second packs the distinct
pairs of each text, by blocks of texts, into arrays for numbered buckets; a bucket
counts its pairs over all blocks and gives every block the sums of its texts.
A block never has more than ``SPLIT`` rows, so that rows grow with the words alone: of more
buckets, a row holds what belongs to a range of them; groups of blocks put the rows of
a range together and split them by buckets, and their sums come back by the same way.
Pairs go by their second word, so that a bucket has the whole count of the word;
pairs that end in a frequent word, whose counts are sent to all tasks, are dealt
by the pair instead. Words and pairs are compared by 64-bit hashes.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideglass.llm.common import give_back, map_slices, utf8, word_hashes
from tideglass.shared import materialise

#: Neither words nor their classes are bounded: every word of the documents is a class of its own.
VOCABULARY = CLASSES = sys.maxsize
#: Prior counts: of a word after a word, and of each word.
CLASS_PRIOR, WORD_PRIOR = 50.0, 0.5
#: Distinct words that a task counts before it hands them on.
WORDS_AT_ONCE = 600_000
#: The most frequent words, up to this number, have counts that go with the tasks and numbers of two bytes; the result does not depend on it.
FREQUENT = 50_000
#: Ids of target documents that are sent to all tasks; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Tokens and texts that are packed together at most (a longer text is a block of its own), and tokens of a bucket.
BLOCK_TOKENS, BLOCK_TEXTS, BUCKET_TOKENS = 400_000, 30_000, 3_000_000
#: A pair that stands in so many texts of a block is sent as its sum; the texts stay with the block, and the sum's logarithm comes back.
HOT_TEXTS = 160
#: Rows that a block is packed into at most. More buckets are reached in two steps.
SPLIT = 2048

START = np.uint64(0x5BD1E9955BD1E995)
_START = int(START.view(np.int64))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD)]
_COUNTS = ("all_n", "target_n", "all_before", "target_before")
#: Arrays of a block for a bucket: pairs that end in a frequent word (its number), others (the word's hash), rare words before another.
_SENT = {"pair": "<u8", "word": "<u2", "text": "<u2", "n": "<u4", "rare_pair": "<u8", "rare_word": "<u8", "rare_text": "<u2", "rare_n": "<u4", "before": "<u8", "before_text": "<u2", "before_n": "<u4"}
_TARGET = 1 << 15


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a whole text, A-Z in lower case; none for a null text."""
    return (text or b"").lower().split()


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[bytes, list[int]] = {}

    def rows() -> pa.RecordBatch:
        words = np.where([w == b"" for w in counts], START, word_hashes(list(counts))).view(np.int64)
        columns = zip(*counts.values(), strict=True)
        return pa.record_batch([pa.array(words), *[pa.array(c, pa.int64()) for c in columns]], names=["word", *_COUNTS])

    for batch in batches:
        for text, is_target in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = tokens(text)
            for w in words:
                c = counts.get(w)
                if c is None:
                    c = counts[w] = [0, 0, 0, 0]
                c[0] += 1
                c[1] += is_target
            if words:
                counts[words[-1]][2] -= 1
                counts[words[-1]][3] -= is_target
                start = counts.setdefault(b"", [0, 0, 0, 0])
                start[2] += 1
                start[3] += is_target
            if len(counts) > WORDS_AT_ONCE:
                yield rows()
                counts.clear()
    if counts:
        yield rows()


def word_counts(marked: DataFrame) -> DataFrame:
    """(word, all_n, target_n, all_before, target_before) over all texts of (text, is_target): how often a word stands, and stands before another.

    Words are their hashes, and the start of a text is one of its own.
    """
    sums = map_slices(marked.select("text", "is_target"), _counted, "word long, " + ", ".join(f"{c} long" for c in _COUNTS))
    found = sums.groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
    # a task counts the last words of texts as -1, so that n + before is how often a word stands before another
    word = F.col("word") != _START
    return found.select("word", "all_n", "target_n", *[F.when(word, F.col(f"{k}_n") + F.col(f"{k}_before")).otherwise(F.col(f"{k}_before")).alias(f"{k}_before") for k in ("all", "target")])


def frequent_words(counts: DataFrame, size: int) -> list:
    """The rows of the most frequent words, at most ``size`` of them.

    A histogram of the counts (eight bins for each power of two) shows how far
    down whole bins can be taken.
    """
    counts = counts.where("all_n > 0").withColumn("bin", F.floor(F.log2("all_n") * 8).cast("int"))
    above, last = 0, None
    for row in sorted(counts.groupBy("bin").count().collect(), reverse=True):
        if above + row["count"] > size:
            break
        above, last = above + row["count"], row["bin"]
    return counts.where(F.col("bin") >= last).collect() if last is not None else []


def _pair_keys(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    key = before * _MIX[0] + (word ^ (word >> np.uint64(31))) * _MIX[1]
    return (key ^ (key >> np.uint64(29))) * _MIX[2]


def _distinct(text: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places of the first of each text and key, how many there are)."""
    order = np.lexsort((key, text))
    t, k = text[order], key[order]
    first = np.flatnonzero(np.concatenate([[True], (t[1:] != t[:-1]) | (k[1:] != k[:-1])])) if len(t) else np.zeros(0, int)
    return order[first], np.diff(np.append(first, len(t))).astype(np.uint32)


def _without_hot(w: np.ndarray, key: np.ndarray, texts: np.ndarray, times: np.ndarray) -> tuple[tuple, tuple]:
    """((texts, pairs, times) of pairs in at least ``HOT_TEXTS`` texts, (words, keys, texts, times) of the others and of the pairs' sums).

    The sums, with and without the target's, stand for texts of numbers beyond ``BLOCK_TEXTS``, by pair.
    """
    keys, at, number = np.unique(key, return_inverse=True, return_counts=True)
    many = np.flatnonzero(number >= HOT_TEXTS)[: _TARGET - BLOCK_TEXTS]
    slot = np.full(len(keys), -1)
    slot[many] = np.arange(len(many))
    of = slot[at] if len(key) else np.zeros(0, int)
    hot = np.flatnonzero(of >= 0)
    if not len(hot):
        return (np.zeros(0), np.zeros(0), np.zeros(0)), (w, key, texts, times)
    word = np.zeros(len(many), np.uint64)
    word[of[hot]] = w[hot]
    is_target, cold = texts[hot] >= _TARGET, np.flatnonzero(of < 0)
    sums = [np.bincount(of[hot], times[hot] * side, len(many)).astype(np.uint32) for side in (~is_target, is_target)]
    places = BLOCK_TEXTS + np.arange(len(many))
    sent = (np.concatenate([w[cold], word, word]), np.concatenate([key[cold], keys[many], keys[many]]), np.concatenate([texts[cold], places, places + _TARGET]), np.concatenate([times[cold], *sums]))
    return (texts[hot] % _TARGET, of[hot], times[hot]), sent


def _array(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(what the packed arrays of a column hold in a row, how many each has), without a copy of each."""
    parts, sizes = [], []
    for chunk in column.chunks:
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int32 if pa.types.is_binary(chunk.type) else np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        if len(chunk) and at[-1] > at[0]:
            parts.append(np.frombuffer(data, np.uint8)[at[0] : at[-1]])
        sizes.append(np.diff(at))
    held = parts[0] if len(parts) == 1 else np.concatenate([*parts, np.zeros(0, np.uint8)])
    return held.view(kind), np.concatenate([*sizes, np.zeros(0, int)]) // np.dtype(kind).itemsize


#: The arrays of each of the three sections, and which of them deals an entry to its bucket.
_SECTIONS = {"pair": ("pair", "word", "text", "n"), "rare_word": ("rare_pair", "rare_word", "rare_text", "rare_n"), "before": ("before", "before_text", "before_n")}
_PACKED = "cell long, grp long, block long, blocks binary, sizes binary, texts binary, " + ", ".join(f"`{c}` binary" for c in _SENT)
_SUMMED = "cell long, grp long, block long, blocks binary, sizes binary, texts binary, text binary, target binary, `all` binary"


def _strided(held: dict[str, np.ndarray], segment: dict[str, np.ndarray], cell: dict[str, np.ndarray], ids: np.ndarray) -> dict[str, list]:
    """Columns of one row for each cell that has entries: its arrays in the order of blocks, the blocks' ids, and entries of each by section.

    ``segment`` is the place in ``ids`` of each section's entries, ``cell`` where they go.
    """
    cells = np.unique(np.concatenate([cell[k] for k in _SECTIONS]))
    out: dict[str, list] = {"cell": cells.tolist()}
    if not len(cells):
        return out | {c: [] for c in ("blocks", "sizes", *_SENT)}
    cuts, ordered = {}, {}
    for section, arrays in _SECTIONS.items():
        by = np.argsort(cell[section], kind="stable") if len(ids) == 1 else np.lexsort((segment[section], cell[section]))
        cuts[section] = np.searchsorted(cell[section][by], cells[1:])
        ordered[section] = np.split(segment[section][by], cuts[section])
        for a in arrays:
            out[a] = [p.tobytes() for p in np.split(held[a][by], cuts[section])]
    out["blocks"], out["sizes"] = [], []
    for k in range(len(cells)):
        parts = [ordered[section][k] for section in _SECTIONS]
        there = np.unique(np.concatenate(parts))
        out["blocks"].append(ids[there].tobytes())
        out["sizes"].append(np.stack([np.bincount(np.searchsorted(there, p), minlength=len(there)) for p in parts], 1).astype("<u4").tobytes())
    return out


def _batch(columns: dict[str, list], schema: str, rows: int) -> pa.Table:
    """A table of the schema; columns that are not given are null."""
    names = [c.strip().split(" ") for c in schema.split(",")]
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    return pa.table([pa.array(columns.get(c.strip("`"), [None] * rows), kinds[t]) for c, t in names], names=[c.strip("`") for c, _ in names])


def _resplit(buckets: int):
    """The rows of a range of buckets from a group of blocks, split by buckets; rows of texts stay."""

    def split(table: pa.Table) -> pa.Table:
        # rows of texts hold no entries, so that the others need not be copied out
        own = table.filter(pc.is_valid(table.column("texts")))
        if own.num_rows == table.num_rows:
            return own
        ids, sizes = _array(table.column("blocks"), "<u8")[0], _array(table.column("sizes"), "<u4")[0].reshape(-1, 3)
        held = {c: _array(table.column(c), t)[0] for c, t in _SENT.items()}
        segment = {section: np.repeat(np.arange(len(ids)), sizes[:, k]) for k, section in enumerate(_SECTIONS)}
        cell = {section: held[section] % np.uint64(buckets) for section in _SECTIONS}
        columns = _strided(held, segment, cell, ids)
        n = len(columns["cell"])
        columns["grp"] = [table.column("grp")[0].as_py()] * n
        return pa.concat_tables([own, _batch(columns, _PACKED, n)])

    return split


def _merged(table: pa.Table) -> pa.Table:
    """The sums of a range of buckets for a group of blocks, by block; rows of texts stay."""
    own = table.filter(pc.is_valid(table.column("texts")))
    if own.num_rows == table.num_rows:
        return own
    ids, at = np.unique(_array(table.column("blocks"), "<u8")[0], return_inverse=True)
    places = np.repeat(at, _array(table.column("sizes"), "<u4")[0]) * _TARGET + _array(table.column("text"), "<u2")[0]
    found, at = np.unique(places, return_inverse=True)
    cut = np.searchsorted(found, np.arange(1, len(ids)) * _TARGET)
    split = lambda a: [p.tobytes() for p in np.split(a, cut)]
    columns = {"block": ids.view(np.int64).tolist(), "text": split((found % _TARGET).astype("<u2"))}
    for k in ("target", "all"):
        columns[k] = split(np.bincount(at, _array(table.column(k), "<f8")[0], len(found)))
    return pa.concat_tables([own, _batch(columns, _SUMMED, len(ids))])


def cross_entropy_difference(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss and score, their difference, of every whole text.

    The background is every document; ``target`` lists ids (doc_id) of target
    documents, null ids and ids of no document teach nothing, and without a
    target document its model is its prior. Losses are means over a text's
    words, in nats. A low score means more like the target. Texts without
    words, and null texts, have 0 in all columns; repeated rows get equal scores.
    """
    ids = target.select(F.col(doc_id).alias("target_id")).where("target_id IS NOT NULL").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    slim = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("text"))
    marked = slim.join(ids, F.col("doc_id") == F.col("target_id"), "left").select("doc_id", "text", F.col("target_id").isNotNull().alias("is_target"))
    counts = materialise(word_counts(marked), "lm_words")
    whole = counts.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("all_n", "target_n")], F.count(F.when(F.col("all_n") > 0, 1)).alias("words")).first()
    size = {k: whole[f"{k}_n"] + WORD_PRIOR * (whole["words"] + 1) for k in ("all", "target")}
    start = counts.where(F.col("word") == _START).first()
    often = frequent_words(counts, FREQUENT)
    hashes = np.array([*[r["word"] for r in often], _START], np.int64).view(np.uint64)
    order = np.argsort(hashes)
    sent = {c: np.array([*[r[c] for r in often], start[c] if start else 0], float)[order] for c in _COUNTS}
    hashes = hashes[order]
    buckets, width = max(1, -(-whole["all_n"] // BUCKET_TOKENS)), 1
    if buckets > SPLIT:
        # ranges of buckets, about as many as there are buckets in one
        width = min(SPLIT, math.isqrt(buckets - 1) + 1)
        buckets = min(-(-buckets // width), SPLIT) * width
    groups = max(1, whole["all_n"] // (BLOCK_TOKENS * width))
    kind = docs.schema[doc_id].dataType.simpleString()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = [TaskContext.get().partitionId() << 32]
        names, flags, lengths, parts = [], [], [], []

        def block() -> pa.RecordBatch:
            words = np.concatenate([*parts, np.zeros(0, np.uint64)])
            n, target_bit = np.array(lengths), np.where(flags, _TARGET, 0)
            of = np.repeat(np.arange(len(n)), n)
            before = np.concatenate([[START], words[:-1]])[: len(words)]
            before[(np.cumsum(n) - n)[n > 0]] = START
            at = np.minimum(np.searchsorted(hashes, before), len(hashes) - 1)
            known = hashes[at] == before
            base = [np.bincount(of[known], np.log(sent[f"{k}_before"][at[known]] + CLASS_PRIOR), len(n)) for k in ("target", "all")]
            sections = []
            rare = np.flatnonzero(~known)
            places, times = _distinct(of[rare], before[rare])
            rare = rare[places]
            sections.append((before[rare] % np.uint64(buckets), {"before": before[rare], "before_text": of[rare] + target_bit[of[rare]], "before_n": times}))
            key = _pair_keys(before, words)
            first, times = _distinct(of, key)
            w, key, texts = words[first], key[first], of[first] + target_bit[of[first]]
            hot, (w, key, texts, times) = _without_hot(w, key, texts, times)
            at = np.minimum(np.searchsorted(hashes, w), len(hashes) - 1)
            known = hashes[at] == w
            sections.append((key[known] % np.uint64(buckets), {"pair": key[known], "word": at[known], "text": texts[known], "n": times[known]}))
            sections.append((w[~known] % np.uint64(buckets), {"rare_pair": key[~known], "rare_word": w[~known], "rare_text": texts[~known], "rare_n": times[~known]}))
            held, to = {}, {}
            for section, (bucket, arrays) in zip(("before", "pair", "rare_word"), sections, strict=True):
                to[section] = bucket // np.uint64(width)
                held.update({name: a.astype(_SENT[name]) for name, a in arrays.items()})
            ids = np.array([number[0]], "<u8")
            columns = _strided(held, {section: np.zeros(len(to[section]), int) for section in to}, to, ids)
            sink = pa.BufferOutputStream()
            own = pa.record_batch([pa.concat_arrays(names), pa.array(n.astype(np.int64)), pa.array(base[0]), pa.array(base[1])], names=["id", "n", "target", "all"])
            # pairs in many texts stay with the block: texts, pairs, numbers
            own = own.replace_schema_metadata({c: a.astype(_SENT[c]).tobytes() for c, a in zip(("text", "word", "n"), hot, strict=True)})
            with pa.ipc.new_stream(sink, own.schema) as out:
                out.write_batch(own)
            # the block's own row has no entries and goes where one of its others goes
            columns["texts"] = [None] * len(columns["cell"]) + [sink.getvalue().to_pybytes()]
            columns["cell"].append(columns["cell"][number[0] % len(columns["cell"])] if columns["cell"] else 0)
            for name in ("blocks", "sizes", *_SENT):
                columns[name].append(b"")
            columns["block"] = [number[0]] * len(columns["cell"])
            rows = len(columns["cell"])
            columns["grp"] = [(number[0] * int(_MIX[0]) % (1 << 64) >> 33) % groups] * rows
            done = _batch(columns, _PACKED, rows).combine_chunks().to_batches()[0]
            number[0] += 1
            for x in (names, flags, lengths, parts):
                x.clear()
            return done

        for batch in batches:
            held = 0
            for k, (content, is_target) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                words = word_hashes(tokens(content))
                if lengths and (sum(lengths) + len(words) > BLOCK_TOKENS or len(lengths) >= BLOCK_TEXTS):
                    if k > held:
                        names.append(batch.column(0).slice(held, k - held))
                    held = k
                    yield block()
                flags.append(is_target)
                lengths.append(len(words))
                parts.append(words)
            if batch.num_rows > held:
                names.append(batch.column(0).slice(held))
        if lengths:
            yield block()

    def count(table: pa.Table) -> pa.Table:
        # what the group before took
        give_back()
        ids, per_row = _array(table.column("blocks"), "<u8")
        sizes = _array(table.column("sizes"), "<u4")[0].reshape(-1, 3)
        whole_of = lambda c: _array(table.column(c), _SENT[c])[0]
        out: dict[str, list] = {"target": [], "all": []}
        places = []

        def summed(key: np.ndarray, n: np.ndarray, is_target: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
            """(each entry's key by number, an entry of each key, the sums of each key)."""
            keys, at = np.unique(key, return_inverse=True)
            one = np.zeros(len(keys), int)
            one[at] = np.arange(len(at))
            return at, one, {"all": np.bincount(at, n, len(keys)), "target": np.bincount(at, n * is_target, len(keys))}

        for k_section, section in enumerate(("", "rare_", "before_")):
            texts, n = whole_of(f"{section}text"), whole_of(f"{section}n").astype(float)
            if not len(n):
                continue
            is_target = texts >= _TARGET
            places.append(np.repeat(np.arange(len(ids)), sizes[:, k_section]) * _TARGET + texts % _TARGET)
            at, one, both = summed(whole_of("before" if section == "before_" else f"{section}pair"), n, is_target)
            # logarithms are taken once for each key, whose word is that of any of its entries
            if section == "rare_":
                word, _, of_word = summed(whole_of("rare_word"), n, is_target)
                of_word = {k: x[word[one]] for k, x in of_word.items()}
            elif section == "":
                number = whole_of("word")[one]
                of_word = {k: sent[f"{k}_n"][number] for k in out}
            for k in out:
                each = np.log(both[k] + CLASS_PRIOR) if section == "before_" else -np.log(both[k] + CLASS_PRIOR * (of_word[k] + WORD_PRIOR) / size[k])
                out[k].append(n * each[at])
            texts = n = is_target = at = one = both = word = of_word = number = each = None
        if not places:
            places = out["target"] = [np.zeros(0, int)]
            out["all"] = [np.zeros(0)]
        found, at = np.unique(np.concatenate(places), return_inverse=True)
        sums = {k: np.bincount(at, np.concatenate(out.pop(k)), len(found)) for k in ("target", "all")}
        # a row of blocks stays a row
        counts = np.bincount(found // _TARGET, minlength=len(ids)).astype("<u4")
        ends = np.cumsum(per_row)[:-1]
        cut = np.searchsorted(found, ends * _TARGET)
        split = lambda a, where: pa.array([p.tobytes() for p in np.split(a, where)], pa.binary())
        cell = pc.divide(table.column("cell"), width) if width > 1 else table.column("cell")
        columns = [cell, *[table.column(c) for c in ("grp", "block", "blocks")], split(counts, ends), table.column("texts"), split((found % _TARGET).astype("<u2"), cut), split(sums["target"], cut), split(sums["all"], cut)]
        return pa.table(columns, names=[c.strip().split(" ")[0].strip("`") for c in _SUMMED.split(",")])

    def finish(table: pa.Table) -> pa.Table:
        give_back()
        own = pa.ipc.open_stream(next(b for b in table.column("texts").to_pylist() if b is not None)).read_all()
        hot, slot, times = (np.frombuffer(own.schema.metadata[c.encode()], _SENT[c]) for c in ("text", "word", "n"))
        n, loss = own["n"].to_numpy(), {}
        texts = np.frombuffer(b"".join(table.column("text").to_pylist()), "<u2")
        for k in ("target", "all"):
            sums = np.bincount(texts, np.frombuffer(b"".join(table.column(k).to_pylist()), "<f8"), _TARGET)
            # what the sum of a pair gave, for one of its times
            each = sums[BLOCK_TEXTS:] / np.maximum(1, np.bincount(slot, times, _TARGET - BLOCK_TEXTS))
            sums = own[k].to_numpy() + sums[: len(n)] + np.bincount(hot, times * each[slot], len(n))
            loss[k] = np.where(n > 0, sums / np.maximum(1, n), 0.0)
        return pa.table([own["id"], pa.array(n), pa.array(loss["target"]), pa.array(loss["all"]), pa.array(loss["target"] - loss["all"])], names=[doc_id, "n_tokens", "target_loss", "background_loss", "score"])

    packed = map_slices(marked, pack, _PACKED)

    def dealt(rows: DataFrame, number: int, *keys: str) -> DataFrame:
        """``rows`` in as many partitions as there are groups, where there are many."""
        return rows.repartition(number, *keys) if number > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else rows

    if width > 1:
        ranges = dealt(packed, buckets // width, "cell", "grp").groupBy("cell", "grp")
        packed = ranges.applyInArrow(_resplit(buckets), _PACKED)
    scored = dealt(packed, buckets, "cell").groupBy("cell").applyInArrow(count, _SUMMED)
    if width > 1:
        scored = scored.groupBy("cell", "grp").applyInArrow(_merged, _SUMMED)
    return scored.groupBy("block").applyInArrow(finish, f"`{doc_id}` {kind}, n_tokens long, target_loss double, background_loss double, score double")
