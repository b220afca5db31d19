"""Clustering, conversation repair and personal data against plain loops, SQL and brute force, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_queries import rows as table_rows
from tests.test_queries import twin
from tideglass.llm import clusters, private, registry, turns

DATA = "/root/testdata/sf0.001"
WIDE = "vec_id long, embedding array<double>"


# clusters


def plain_clusters(vectors):
    """[(vec_id, cluster, distance)], centroids by full search in plain loops."""
    drawn = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in vectors if i is not None)
    centroids = [list(v) for _, v in drawn[:8]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), k) for k, c in enumerate(centroids))

    for _ in range(10):
        groups = {}
        for _, v in vectors:
            groups.setdefault(nearest(v)[1], []).append(v)
        centroids = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centroids)]
    found = [(i, *nearest(v)[::-1]) for i, v in vectors]
    return found, [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]


def test_clusters_equal_plain_loops(spark):
    e = spark.read.parquet(f"{DATA}/embeddings.parquet")
    got = clusters.clustered(e).collect()
    vectors = [(r["vec_id"], [int(np.floor(1024 * float(x))) for x in r["embedding"]]) for r in e.collect()]
    want, digests = plain_clusters(vectors)
    assert sorted((r["vec_id"], r["cluster"], r["distance"]) for r in got) == sorted(want)
    assert {r["centroid_sha256"] for r in got} == {digests[k] for _, k, _ in want}
    assert {r["inertia"] for r in got} == {sum(d for _, _, d in want)}
    assert {(r["cluster"], r["cluster_inertia"]) for r in got} == {(k, sum(d for _, c, d in want if c == k)) for _, k, _ in want}


def test_clusters_of_odd_rows(spark):
    rnd = random.Random(5)
    vector = lambda: [rnd.randint(-3, 3) / 1024 for _ in range(64)]
    same = vector()
    good = [(i, same) for i in range(30)] + [(i, vector()) for i in range(30, 60)] + [(7, same), (7, vector()), (None, vector()), (None, same)]
    bad = [(90, None), (91, []), (92, same[:63]), (93, [*same, 0.0]), (94, [None, *same[1:]]), (95, [float("nan"), *same[1:]]), (96, [*same[1:], float("-inf")])]
    clash = {c: F.lit("x") for c in ("v", "h", "cluster", "distance", "k", "n")}
    got = clusters.clustered(spark.createDataFrame(good + bad, WIDE).repartition(5).withColumns(clash)).collect()
    want, _ = plain_clusters([(i, [int(1024 * x) for x in v]) for i, v in good])
    assert sorted(((r["vec_id"], r["cluster"], r["distance"]) for r in got), key=str) == sorted(want, key=str)
    few = clusters.clustered(spark.createDataFrame([(1, same), (2, vector())], WIDE)).collect()
    assert [r["distance"] for r in few] == [0, 0] and {r["inertia"] for r in few} == {0}
    assert clusters.clustered(spark.createDataFrame([], WIDE)).count() == 0
    assert clusters.clustered(spark.createDataFrame(bad, WIDE)).count() == 0
    with pytest.raises(Exception, match="must be below"):
        clusters.clustered(spark.createDataFrame([(1, [1e30] * 64)], WIDE)).count()


def test_partial_distances_find_what_a_full_search_finds():
    rnd = np.random.default_rng(3)
    for dimensions, spread in ((64, 2), (64, 1000), (20, 1)):
        v, c = rnd.integers(-spread, spread + 1, (500, dimensions)), rnd.integers(-spread, spread + 1, (8, dimensions))
        c[5] = c[2]
        full = np.square(v[:, None] - c[None]).sum(2)
        label, best = clusters.nearest(v, c)
        assert (label == full.argmin(1)).all() and (best == full.min(1)).all()


# turns


def damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        own = out.setdefault(conv, [])
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = (" " if x is None else x for x in (role, text))
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        role = "user" if h == 4 else role
        own.extend([(turn, role, text)] * (0 if h == 0 else 2 if h == 3 else 1))
    return {c: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, own in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def plain_repair(rows):
    """The least (cost, audit) by a recursion over rows and what was put out, and its text."""
    kinds, n = faults(rows), len(rows)
    nxt = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}
    best = {}
    for at in range(n, -1, -1):
        for last in ("u", "a", "s", ""):
            options = [(0, "", "")] if at == n and last in ("", "a") else []
            if at < n:
                _, role, text = rows[at]
                cost, audit, rest = best[at + 1, last]
                options.append((2 + cost, "D" + audit, rest))
                if kinds[at] in ("", "truncated"):
                    more = 5 if kinds[at] else 0
                    initial = role[:1]
                    if initial == nxt[last] or initial == "s" and last == "":
                        cost, audit, rest = best[at + 1, initial]
                        options.append((more + cost, "K" + audit, f"\n{role}:{text}" + rest))
                    cost, audit, rest = best[at + 1, nxt[last]]
                    options.append((1 + more + cost, "R" + audit, f"\n{name[nxt[last]]}:{text}" + rest))
            best[at, last] = min(options) if options else (10**9, "", "")
        for _ in range(4):
            for last in ("", "s", "u", "a"):
                cost, audit, rest = best[at, nxt[last]]
                best[at, last] = min(best[at, last], (5 + cost, "I" + audit, f"\n{name[nxt[last]]}:" + rest))
    return best[0, ""]


def facts(rows):
    kinds = faults(rows)
    held = {t for t, _, _ in rows if t is not None}
    gaps = max(held) - min(held) + 1 - len(held) if held else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, text = plain_repair(rows)
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, text[1:])


def conversation(rnd, n, conv=None):
    role = lambda: rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
    text = lambda: rnd.choice(["Hi.", "Yes", "No!", "", " \n", None, f"t{rnd.randint(0, 3)}", "long. " * 3, f"q {rnd.random()}?"])
    return [(conv, rnd.choice([k, k, k, None, n - k]), role(), text()) for k in range(n)]


SCHEMA = "conv_id long, turn long, role string, text string"


def compared(spark, rows):
    got = turns.repaired(turns.damaged(spark.createDataFrame(rows, SCHEMA))).collect()
    want = {c: facts(r) for c, r in damage(rows).items()}
    assert len(got) == len(want)
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_repair_by_brute_force_over_all_edits():
    rnd = random.Random(2)
    for _ in range(25):
        rows = [r for own in damage(conversation(rnd, rnd.randint(0, 3), 1)).values() for r in own][:3]
        kinds, found = faults(rows), []
        for edits in itertools.product(*[["D", "K", "Ru", "Ra"] if k in ("", "truncated") else ["D"] for k in kinds]):
            for added in itertools.product(["", "u", "a", "ua", "au"], repeat=len(rows) + 1):
                initials, audit, cost = added[0], "I" * len(added[0]), 5 * len(added[0])
                for (_, role, _), edit, kind, more in zip(rows, edits, kinds, added[1:], strict=True):
                    initials += "" if edit == "D" else (role[:1] or "?") if edit == "K" else edit[1]
                    cost += {"D": 2, "K": 0}.get(edit, 1) + (5 if edit != "D" and kind else 0) + 5 * len(more)
                    initials, audit = initials + more, audit + edit[0] + "I" * len(more)
                if re.fullmatch("(s?(ua)+)?", initials):
                    found.append((cost, audit))
        assert min(found) == plain_repair(rows)[:2]


def test_repair_equals_the_recursion(spark):
    rnd = random.Random(1)
    rows = [r for c in range(120) for r in conversation(rnd, rnd.choice([1, 2, 3, 4, 5, 8, 13, 40]), c)] + conversation(rnd, 9)
    # one of which nothing is left
    gone = next(k for k in range(500, 900) if zlib.crc32(f"{k}:1".encode()) % 20 == 0)
    compared(spark, [*rows, (gone, 1, "user", "Hi.")])
    got = {r["conv_id"]: r for r in turns.repaired(turns.damaged(spark.createDataFrame([(gone, 1, "user", "Hi.")], SCHEMA))).collect()}
    assert tuple(got[gone])[1:] == (0, 0, 0, 0, 0, 0, "", "")


def test_repair_of_the_given_table(spark):
    table = spark.read.parquet(f"{DATA}/conversations.parquet")
    want = {c: facts(r) for c, r in damage([tuple(r) for r in table.select("conv_id", "turn", "role", "text").collect()]).items()}
    got = registry.QUERIES["op12_turns"](spark, DATA).collect()
    assert {r["conv_id"]: tuple(r)[1:] for r in got} == {c: (*w[:-1], hashlib.sha256(w[-1].encode()).hexdigest()) for c, w in want.items()}


def test_repair_in_chunks_equals_the_recursion(spark, monkeypatch):
    monkeypatch.setattr(turns, "MOST_ROWS", 20)
    monkeypatch.setattr(turns, "CHUNK", 16)
    rnd = random.Random(4)
    rows = [r for c, n in enumerate([3, 21, 300, 45, 7, 20, 64]) for r in conversation(rnd, n, c)] + conversation(rnd, 50)
    # many rows that are alike, and a long one of which nothing is left
    gone = next(k for k in range(500, 900) if zlib.crc32(f"{k}: ".encode()) % 20 == 0)
    rows += [(400, 3, "user", "Hello.")] * 90 + [(gone, None, "user", "Hi.")] * 30
    compared(spark, rows)


def test_repair_in_small_tensors(spark, monkeypatch):
    monkeypatch.setattr(turns, "ROWS_AT_ONCE", 10)
    monkeypatch.setattr(turns, "CELLS", 16)
    rnd = random.Random(6)
    compared(spark, [r for c in range(30) for r in conversation(rnd, rnd.randint(1, 12), c)])


def test_repair_of_an_empty_table_and_clashing_names(spark):
    assert turns.repaired(turns.damaged(spark.createDataFrame([], SCHEMA))).count() == 0
    rows = conversation(random.Random(8), 12, 3)
    clash = {c: F.lit(1) for c in ("h", "dropped", "group", "seq", "audit", "cost", "_id", "n")}
    got = turns.repaired(turns.damaged(spark.createDataFrame(rows, SCHEMA).withColumns(clash))).collect()
    assert [tuple(r)[1:] for r in got] == [facts(damage(rows)[3])]


# private

#: As the definition has them.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def counts(kind, text):
    digits = [int(x) for x in re.sub("[^0-9]", "", text)]
    if kind == "ip":
        return all(int(x) <= 255 for x in text.split("."))
    if kind == "card":
        doubled = [d * 2 for d in digits[-2::-2]]
        return 16 <= len(digits) <= 19 and (sum(digits[-1::-2]) + sum(d // 10 + d % 10 for d in doubled)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def by_patterns(text):
    return {k: [m.span() for m in re.finditer(p, text) if counts(k, m.group())] for k, p in PATTERNS.items()}


def test_plain_spans_equal_the_patterns():
    rnd = random.Random(9)
    for _ in range(6000):
        letters = rnd.choice(["ab.@-+ 1", "0123. ", "0123456789 -", "+0123 ().-", "a1@.", "0.@+1 -(", "é٣a@.b1"])
        text = "".join(rnd.choice(letters) for _ in range(rnd.randint(0, 60)))
        assert private.plain_spans(text) == by_patterns(text), text


def test_query_of_personal_data_equals_the_patterns(spark):
    got = registry.QUERIES["op13_private"](spark, DATA).collect()
    texts = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    want = {}
    for i, t in texts:
        found = by_patterns(t or "")
        listed = ",".join(f"{k}:{a}:{b}" for k in PATTERNS for a, b in found[k])
        want[i] = (*(len(v) for v in found.values()), hashlib.sha256(listed.encode()).hexdigest(), listed, 0)
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == want and sum(w[0] for w in want.values()) > 0


HIDDEN = [
    ("email", "joe [at] site dot com"),
    ("email", "joe dot doe at mail dot site dot com"),
    ("email", "jоe.dοe@sіte.com"),
    ("email", "a​b@si­te.com"),
    ("email", "joe(at)site.com"),
    ("email", "joe @ site.com"),
    ("email", "x{dot}y(at)site[dot]co[dot]uk"),
    ("email", "jo＠site．com"),
    ("ip", "one nine two dot one six eight dot zero dot one"),
    ("ip", "10[.]0[.]0[.]1"),
    ("ip", "１０.0.0.١"),
    ("card", "4l11 1111 1111 1111"),
    ("card", "４111 1111–1111 1111"),
    ("card", "four one one one one one one one one one one one one one one one"),
    ("card", "four triple one 1111 1111 1111"),
    ("phone", "plus four nine three zero one two three four five six"),
    ("phone", "+4​9 (30) 123 4567"),
    ("phone", "+four nine 30 123 4567"),
]


@pytest.mark.parametrize(("kind", "hidden"), HIDDEN)
def test_disguises_are_mapped_back(kind, hidden):
    for before, behind in (("", ""), ("Éh bien \U0001f600 : ", " ok"), ("x dot y, с​ one two; ", "\n(at) home.")):
        base, added = private.spans(before + hidden + behind)
        spans = added[kind]
        assert [(before + hidden + behind)[a:b] for a, b in spans] == [hidden] or [(before + hidden + behind)[a:b].lstrip("+") for a, b in spans] == [hidden.lstrip("+")]
        assert not any(base.values()) and sum(map(len, added.values())) == 1


CLEAN = ["Look at example.com and meet at home.", "He saw one or two dots at nine", "Point one dot two", "we met at site dot com", "plus 10 000 000 hommes", "two three four five six seven", "dot dot dot at at at", "a@b", "Öl und Glas, één, привет (at) мир"]


@pytest.mark.parametrize("text", CLEAN)
def test_clean_texts_stay_clean(text):
    base, added = private.spans(text)
    found = [text[a:b] for side in (base, added) for v in side.values() for a, b in v]
    assert found in ([], ["we met at site dot com"[3:]])


def test_plain_spans_stay_and_hide_what_meets_them():
    text = "joe@site.com dot uk, кnn@site.com"
    base, added = private.spans(text)
    assert [text[a:b] for a, b in base["email"]] == ["joe@site.com", "nn@site.com"] and added["email"] == []


@pytest.mark.parametrize("piece", ["a", "1", "1 ", "a@", "+1", "1.", "one ", " dot ", "(at)", "а", "one dot ", "a at ", "plus ", "O1", "double ", " @ a", "a.b [dot] "])
def test_personal_data_is_found_in_linear_time(piece):
    import time

    began = time.time()
    private.spans(piece * (400_000 // len(piece)))
    assert time.time() - began < 20


def test_personal_data_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "a@b.c " * 20_000), (3, "joe(at)b.c"), (3, "joe(at)b.c"), (None, "1.2.3.4")]
    clash = {c: F.lit(0) for c in ("n_email", "spans", "base", "kind")}
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns(clash)
    got = sorted(map(tuple, private.personal_data(docs).drop("base", "spans").collect()), key=str)
    assert got == sorted([(1, 0, 0, 0, 0, 0), (2, 0, 0, 0, 0, 0), (3, 20_000, 0, 0, 0, 0), (3, 0, 0, 0, 0, 1), (3, 0, 0, 0, 0, 1), (None, 0, 1, 0, 0, 0)], key=str)
    assert private.personal_data(docs.limit(0)).count() == 0
    spans = {r["spans"] for r in private.personal_data(docs).where("doc_id = 3 and n_email = 0").collect()}
    assert spans == {"email:0:10"}


def test_new_query_equals_its_twin(spark):
    got = registry.QUERIES["op11_clusters"](spark, DATA).toPandas()
    want = twin(registry.ORACLE["op11_clusters"])
    assert sorted(got.columns) == sorted(want.columns) and table_rows(got) == table_rows(want)
