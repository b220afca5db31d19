"""Near-duplicate detection by a multi-index Hamming join over b-bit MinHash signatures.

A text's distinct word shingles give a signature of ``SYMBOLS`` MinHash values,
of which 16 bits are kept. Documents with equal shingle sets form one class,
and only its first document goes on. Signatures are split into ``CHUNKS`` chunks.
By pigeonhole, of two signatures with at most ``THRESHOLD`` different symbols at
least one chunk has at most ``ERRORS`` errors, so the classes meet under one of
the keys that leave ``ERRORS`` symbols of a chunk out. All such pairs are found
for certain; of pairs further apart those with a chunk like that, which a pair of
similarity 0.75 lacks about five times in a million. No pair that shares a key is
left out by its signatures.

Pairs are confirmed on full shingle sets. A key shared by many classes is not
expanded into all pairs: first everyone meets the key's first class; links make
components; then only classes of different components meet. A pair inside one
component could add nothing, so no component is lost. A class that meets a large
component, of up to ``HUGE`` classes, is compared to all its members; the other
classes of a key, those of still larger components among them, are compared among
themselves; both in blocks of sets, which give no more links than join what belongs
together. Under a key, blocks hold one component's classes where it has many there, and two
blocks of one component do not meet. Pairs of blocks are dealt by both blocks, so
that one key's or one component's work is spread over the cluster.

Classes have numbers of their own in the order of their smallest document ids, as
rows of one id may have different texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideglass.llm.common import map_slices, utf8, word_hashes, written
from tideglass.shared import discard, materialise

SHINGLE = 5
#: Least intersection over union, as a fraction of integers: 100 * i >= 75 * u.
SIMILAR = (75, 100)
SYMBOLS, CHUNKS, THRESHOLD = 96, 16, 31
#: Errors that the best chunk of a pair under the threshold has at most.
ERRORS = THRESHOLD // CHUNKS
#: Components of more classes (up to ``HUGE``) are compared in blocks as a whole, and the classes of a block.
LARGE, HUGE, BLOCK = 48, 4096, 128
SEED = 20_240_603
#: Ids that are sent to all tasks to pick texts; more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: A key of more rows is a hub, and its value is sent to all tasks; there are at most ``MOST_HUBS`` of them.
HUB, MOST_HUBS = 256, 100_000
#: The values of at most so many rows are all sent to all tasks, which needs one join and no shuffle of the rows.
SENT_WHOLE = 65_536
_K1, _K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_FACTORS = np.random.default_rng(SEED).integers(1, 2**63, SYMBOLS, dtype=np.uint64) | np.uint64(1)
_ADDENDS = np.random.default_rng(SEED + 1).integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _K1
    x = (x ^ (x >> np.uint64(27))) * _K2
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a whole text's word shingles.

    Lower-cases A-Z; a text of fewer than ``SHINGLE`` words is one shingle; a
    text without words, or null, has none.
    """
    words = (text or b"").lower().split()
    if len(words) < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    h = word_hashes(words)
    n = len(h) - SHINGLE + 1
    out = h[:n]
    for k in range(1, SHINGLE):
        out = _mixed(out) + h[k : k + n]
    return np.unique(_mixed(out))


def signature(found: np.ndarray) -> bytes:
    """16 bits of each of the ``SYMBOLS`` MinHash values."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(found), 4096):
        least = np.minimum(least, (found[k : k + 4096, None] * _FACTORS + _ADDENDS).min(0))
    return (_mixed(least) >> np.uint64(48)).astype("<u2").tobytes()


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, digests, signatures = [], [], []
        for text in batch.column(2).to_pylist():
            found = shingles(text)
            sizes.append(len(found))
            digests.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
            signatures.append(signature(found) if len(found) else None)
        columns = [*batch.columns[:2], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())]
        yield pa.record_batch(columns, names=["doc_id", "text_key", "n_shingles", "digest", "signature"])


_LEFT_OUT = [(c, leave) for c in range(CHUNKS) for leave in combinations(range(SYMBOLS // CHUNKS), ERRORS)]


def keys_of(signatures: np.ndarray) -> np.ndarray:
    """64-bit index keys of each signature: one for each chunk and each choice of symbols to leave out."""
    width = SYMBOLS // CHUNKS
    out = np.empty((len(signatures), len(_LEFT_OUT)), np.uint64)
    for i, (chunk, leave) in enumerate(_LEFT_OUT):
        key = np.full(len(signatures), i + 1, np.uint64)
        for s in range(width):
            if s not in leave:
                key = _mixed(key * np.uint64(65_599) + signatures[:, chunk * width + s].astype(np.uint64))
        out[:, i] = key
    return out.view(np.int64)


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), "<u2").reshape(-1, SYMBOLS)
            keys = keys_of(raw)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.record_batch([pa.array(keys.ravel()), pa.array(ids)], names=["key", "id"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.record_batch([batch.column(0), pa.array([shingles(t).tobytes() for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "found"])


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted shingle sets reach the similarity."""
    if SIMILAR[1] * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both) and both > 0


def _confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = ([np.frombuffer(x, np.uint64) for x in batch.column(k).to_pylist()] for k in (2, 3))
        good = pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
        yield pa.record_batch([batch.column(0).filter(good), batch.column(1).filter(good)], names=["a", "b"])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc_id, text_key, text): a row's text is found again by its id and the hash of the text."""
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key"), utf8(text).alias("text"))


def signed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, digest of the set, signature) of every row, written once."""
    return written(map_slices(_rows(docs, doc_id, text), _signed, "doc_id long, text_key long, n_shingles long, digest binary, signature binary"), "neardup_signatures")


def _classes(table: DataFrame) -> DataFrame:
    """(id, digest, n, doc, text_key, size, signature) of every set that a row with an id has, numbered in the order of their first documents; n rows have it."""
    rows = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "text_key", F.col("n_shingles").alias("size"), "signature"))
    first = table.where("digest is not null").groupBy("digest").agg(F.min(rows).alias("first"), F.count(F.lit(1)).alias("n")).where("first is not null")
    ordered = first.select("digest", "n", F.col("first.doc_id").alias("doc"), "first.text_key", "first.size", "first.signature").orderBy("doc", "digest")
    return materialise(ordered.withColumn("id", F.monotonically_increasing_id()), "neardup_classes")


def _set_table(docs: DataFrame, classes: DataFrame, ids: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """(id, found): the shingle sets of the classes that stand in candidate pairs, made anew from their first texts."""
    wanted = classes.join(ids, "id").select("id", F.col("doc").alias("_doc"), F.col("text_key").alias("_key"))
    n = ids.count()
    if n <= BROADCAST_IDS:
        wanted = F.broadcast(wanted)
    rows = _rows(docs, doc_id, text).join(wanted, (F.col("doc_id") == F.col("_doc")) & (F.col("text_key") == F.col("_key"))).select("id", "text")
    found = written(map_slices(rows, _sets, "id long, found binary"), name)
    if found.count() == n:
        return found
    # rows that are repeated with their id
    once = materialise(found.dropDuplicates(["id"]), f"{name}_once")
    discard(found)
    return once


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str, text: str, name: str) -> DataFrame:
    """The pairs (a, b) of classes that are similar by full sets, written once."""
    of_a, of_b = (classes.select(F.col("id").alias(x), F.col("size").alias(f"n{x}")) for x in "ab")
    # sets whose sizes differ more cannot be similar
    near = pairs.join(of_a, "a").join(of_b, "b").where(F.least("na", "nb") * SIMILAR[1] >= F.greatest("na", "nb") * SIMILAR[0]).select("a", "b")
    near = materialise(near, f"{name}_near")
    ids = materialise(near.select(F.col("a").alias("id")).union(near.select("b")).distinct(), f"{name}_ids")
    found = _set_table(docs, classes, ids, doc_id, text, f"{name}_sets")
    both = near.join(found.withColumnsRenamed({"id": "a", "found": "fa"}), "a").join(found.withColumnsRenamed({"id": "b", "found": "fb"}), "b").select("a", "b", "fa", "fb")
    links = written(map_slices(both, _confirmed, "a long, b long"), f"{name}_links")
    discard(near, ids, found)
    return links


def _with_value(rows: DataFrame, values: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` left joined to the one row of ``values`` (key, n, ...) of a key, where n counts a key's rows.

    There are no more values than the ``total`` rows; where these are few, all values are
    sent. Else the rows of a hub stay where they are: hubs have more than a fixed share of
    all ``total`` rows, so there are few of them and their values are sent.
    """
    if total <= SENT_WHOLE:
        return rows.join(F.broadcast(values), key, "left").drop("n")
    most = max(HUB, total // MOST_HUBS)
    hubs = F.broadcast(values.where(F.col("n") > most))
    others = rows.join(hubs.select(key), key, "left_anti").join(values.where(F.col("n") <= most), key, "left")
    return rows.join(hubs, key).unionByName(others).drop("n")


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """(id, component): the smallest id that each linked id reaches.

    Every id hands the smallest id it sees to its larger neighbours, then to its
    smaller ones, until nothing changes: the number of rounds grows with the
    logarithm of the longest chain, and each is two aggregations and joins.
    """
    edges = materialise(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{name}_edges_0")
    facts, rounds = _facts(edges), 0
    while True:
        rounds += 1
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = _with_value(both.where("v > u"), least, "u", 2 * facts[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = materialise(large, f"{name}_large_{rounds}")
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = _with_value(large, least, "u", facts[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m")).where("u <> v").distinct()
        small = materialise(small, f"{name}_small_{rounds}")
        before, facts = facts, _facts(small)
        discard(edges, large)
        if before == facts:
            return small.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = small


def _facts(edges: DataFrame) -> tuple:
    """(number, sum of hashes) of the edges."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _open(placed: DataFrame) -> DataFrame:
    """The rows (key, id, component) of keys with more than one component."""
    keys = placed.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    return placed.join(keys, "key", "left_semi")


def _linked(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which sets of one side are similar to which of the other, by exact intersections."""
    sides = (left, right)
    flat = [np.concatenate(x) for x in sides]
    owner = [np.repeat(np.arange(len(x)), [len(y) for y in x]) for x in sides]
    sizes = [np.array([len(y) for y in x], np.float64) for x in sides]
    shared = np.intersect1d(np.unique(flat[0]), np.unique(flat[1]), assume_unique=True)
    both = np.zeros((len(sizes[0]), len(sizes[1])))
    for k in range(0, len(shared), 1 << 14):
        part = shared[k : k + (1 << 14)]
        tables = []
        for side in (0, 1):
            at = np.minimum(np.searchsorted(part, flat[side]), len(part) - 1)
            there = part[at] == flat[side]
            t = np.zeros((len(sizes[side]), len(part)), np.float32)
            t[owner[side][there], at[there]] = 1
            tables.append(t)
        both += tables[0] @ tables[1].T
    union = sizes[0][:, None] + sizes[1][None, :] - both
    return (SIMILAR[1] * both >= SIMILAR[0] * union) & (both > 0)


def _joining(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of classes under one key: as many as join all components that are linked there."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for r in batch.to_pylist():
            left, right = r["rows"], r["others"]
            ids, parts = ([np.array([x[k] for x in side], np.int64) for side in (left, right)] for k in ("id", "component"))
            asked = (parts[0][:, None] != parts[1][None, :]) & ((ids[1][None, :] > ids[0][:, None]) | (not r["same"]))
            if not asked.any():
                continue
            linked = _linked(*([np.frombuffer(x["found"], np.uint64) for x in side] for side in (left, right)))
            to: dict[int, int] = {}

            def root(x: int, to: dict[int, int] = to) -> int:
                while x in to:
                    x = to[x]
                return x

            for i, j in np.argwhere(linked & asked).tolist():
                a, b = root(left[i]["component"]), root(right[j]["component"])
                if a != b:
                    to[max(a, b)] = min(a, b)
                    out[0].append(left[i]["id"])
                    out[1].append(right[j]["id"])
        yield pa.record_batch([pa.array(x, pa.int64()) for x in out], names=["a", "b"])


def _block_pairs(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """(rows, others, same): the pairs of blocks that the classes of each open key (key, id, component) meet in, with their sets.

    Blocks of a key are numbered: first those of components with many classes
    there, each component's after another's, then mixed ones. A block meets those after it,
    without the rest of its own component.
    """
    per = rest.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n")).withColumn("own", F.when(F.col("n") >= BLOCK // 2, F.ceil(F.col("n") / BLOCK)))
    of_key = per.groupBy("key").agg(F.sum("own").alias("alone"), F.ceil(F.sum(F.when(F.col("own").isNull(), F.col("n"))) / BLOCK).alias("mixed"))
    of_key = of_key.select("key", F.coalesce("alone", F.lit(0)).alias("alone"), F.coalesce("mixed", F.lit(0)).alias("mixed"))
    # few components have many classes under one key
    many = per.where("own is not null")
    before = F.coalesce(F.sum("own").over(Window.partitionBy("key").orderBy("component").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    many = many.select("key", "component", "own", before.alias("first"))
    sizes = per.join(of_key, "key").join(many.drop("own"), ["key", "component"], "left").select(F.struct("key", "component").alias("part"), "n", "own", "first", "alone", "mixed")
    placed = _with_value(rest.withColumn("part", F.struct("key", "component")), sizes, "part", rest.count())
    within = lambda blocks: F.pmod(F.xxhash64("id"), blocks)
    block = F.when(F.col("own").isNotNull(), F.col("first") + within(F.col("own"))).otherwise(F.col("alone") + within(F.col("mixed")))
    # an own block is linked to nothing inside it
    begins = F.when(F.col("own").isNotNull(), F.col("first") + F.col("own")).otherwise(block)
    rows = placed.select("key", "id", "component", block.alias("block"), begins.alias("begins"), (F.col("alone") + F.col("mixed") - 1).alias("last")).join(sets, "id")
    packed = rows.groupBy("key", "block", "begins", "last").agg(F.collect_list(F.struct("id", "component", "found")).alias("rows"))
    single = packed.where("last = 0").select("key", "rows", F.col("rows").alias("others"), F.lit(True).alias("same"))
    several = packed.where("last > 0")
    other = several.select("key", F.col("block").alias("other"), F.col("rows").alias("others"))
    met = several.where("begins <= last").withColumn("other", F.explode(F.sequence("begins", "last"))).join(other, ["key", "other"])
    return single.union(met.select("key", "rows", "others", (F.col("block") == F.col("other")).alias("same")))


def _across(docs: DataFrame, rest: DataFrame, classes: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links (a, b) of classes in different components, from open keys (key, id, component), compared in blocks of sets."""
    ids = materialise(rest.select("id").distinct(), "neardup_open_ids")
    sets = _set_table(docs, classes, ids, doc_id, text, "neardup_open_sets")
    met = _block_pairs(rest, sets)
    links = written(map_slices(met, _joining, "a long, b long", rows=4), "neardup_across_links", 4)
    discard(ids, sets)
    return links


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between two blocks of sets: for each asking class the first similar member, if there is one."""
    for batch in batches:
        out: tuple[list, list] = ([], [])
        for r in batch.to_pylist():
            linked = _linked(*([np.frombuffer(x["found"], np.uint64) for x in r[k]] for k in ("asking", "members")))
            for i in np.flatnonzero(linked.any(1)):
                out[0].append(r["asking"][i]["id"])
                out[1].append(r["members"][linked[i].argmax()]["id"])
        yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64())], names=["a", "b"])


def _blocks(rows: DataFrame, sizes: DataFrame, name: str) -> DataFrame:
    """``sizes`` (large, n, blocks, ...) for each block of rows (large, id, found), packed into arrays of about ``BLOCK``."""
    placed = _with_value(rows, sizes, "large", rows.count()).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")))
    return placed.groupBy(*[c for c in sizes.columns if c != "n"], "block").agg(F.collect_list(F.struct("id", "found")).alias(name))


def _marked(rest: DataFrame, members: DataFrame) -> DataFrame:
    """``rest`` (key, id, component) with ``large``, whether the component has more than ``LARGE`` classes, but no more than ``HUGE``, written once."""
    large = members.groupBy("component").count().where(F.col("count").between(LARGE + 1, HUGE)).select("component", F.lit(True).alias("large"))
    values = rest.groupBy("component").agg(F.count(F.lit(1)).alias("n")).join(large, "component", "left")
    return materialise(_with_value(rest, values, "component", rest.count()).select("key", "id", "component", F.coalesce("large", F.lit(False)).alias("large")), "neardup_marked")


def _block_links(docs: DataFrame, classes: DataFrame, marked: DataFrame, members: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links between large components and the other classes that share a key with one of their members."""
    touched = marked.where("large").select("key", F.col("component").alias("of")).distinct()
    asking = marked.join(touched, "key").where("component <> of and (not large or component > of)").select(F.col("of").alias("large"), "id").distinct()
    asking = materialise(asking, "neardup_asking")
    members = members.withColumnRenamed("component", "large")
    sizes = members.groupBy("large").agg(F.count(F.lit(1)).alias("n")).join(asking.select("large").distinct().withColumn("asked", F.lit(True)), "large", "left")
    asked = materialise(_with_value(members, sizes, "large", members.count()).where("asked").select("large", "id"), "neardup_asked")
    ids = materialise(asking.select("id").union(asked.select("id")).distinct(), "neardup_block_ids")
    sets = _set_table(docs, classes, ids, doc_id, text, "neardup_block_sets")
    held = [materialise(rows.join(sets, "id").select("large", "id", "found"), f"neardup_{name}_sets") for rows, name in ((asking, "asking"), (asked, "members"))]
    asking_sizes, sizes = (rows.groupBy("large").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks")) for rows in held)
    answers = _blocks(held[1], sizes, "members").select("large", "block", "members")
    asks = _blocks(held[0], asking_sizes.join(sizes.select("large", F.col("blocks").alias("others")), "large"), "asking")
    # every block of askers meets every number of the component's blocks
    met = asks.select("large", "asking", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)).alias("block")).join(answers, ["large", "block"]).select("asking", "members")
    links = written(map_slices(met, _compared, "a long, b long", rows=4), "neardup_block_links", 4)
    discard(asking, asked, ids, sets, *held)
    return links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The component of every document under links of similar shingle sets.

    Returns one row for each input row: doc_id, n_shingles, component_id (the
    smallest id reachable, the document's own included), kept (the two are the
    same). Texts without words, and null texts, are linked with nothing. Rows
    that share an id are one document, linked by what each of them says. Rows
    with a null id link nothing: they have the component of the documents of
    the same set, or null, and are never kept. An empty table gives an empty
    result. Other columns play no part, whatever their names.
    """
    table = signed(docs, doc_id, text)
    classes = _classes(table)
    # keys that more than one class has, with the first class of each
    keys = written(map_slices(classes.select("id", "signature"), _indexed, "key long, id long"), "neardup_keys")
    shared = keys.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select("key", "first")
    met = materialise(keys.join(shared, "key").select("key", "id", "first"), "neardup_met")
    discard(keys)
    stars = met.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct()
    links = _links(docs, classes, stars, doc_id, text, "neardup_star")
    found = components(links, "neardup_star")
    # classes of one key that are still in different components
    placed = met.select("key", "id").join(found, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    rest = materialise(_open(placed), "neardup_open")
    members = found.union(found.select(F.col("component").alias("id"), "component").distinct())
    marked = _marked(rest, members)
    in_blocks = _block_links(docs, classes, marked, members, doc_id, text)
    small = materialise(_open(marked.where("not large").drop("large")), "neardup_open_small")
    across = _across(docs, small, classes, doc_id, text)
    # rows that share an id link their classes
    total = table.count()
    of_row = _with_value(table.where("doc_id is not null and digest is not null").select("doc_id", "digest"), classes.select("digest", "n", "id"), "digest", total).select("doc_id", "id").distinct()
    several = of_row.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("last"), F.count(F.lit(1)).alias("n")).where("a <> last").drop("last")
    same_id = _with_value(of_row, several, "doc_id", total).where("id <> a").select("a", F.col("id").alias("b"))
    final = components(links.union(in_blocks).union(across).union(same_id), "neardup_all")
    discard(met, links, in_blocks, rest, marked, small, across)
    # the smallest class of a component has its smallest document
    sizes = final.groupBy(F.col("component").alias("id")).agg(F.count(F.lit(1)).alias("n")).join(classes.select("id", "doc"), "id").withColumnsRenamed({"id": "component", "doc": "lowest"})
    named = _with_value(final, sizes, "component", final.count()).select("id", "lowest")
    of_class = classes.select("digest", "n", "id", "doc").join(named, "id", "left").select("digest", "n", F.coalesce("lowest", "doc").alias("component_id"))
    of_class = materialise(of_class, "neardup_components")
    rows = _with_value(table.where("digest is not null").select("digest", "doc_id", "n_shingles"), of_class, "digest", total).select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    alone = table.where("digest is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return rows.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
