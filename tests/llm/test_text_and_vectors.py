"""Substring dedup, divergence audit and clustering against brute force, and their edge cases."""

import hashlib
import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from tapewright.llm import centroids, divergence, substring_dedup
from tapewright.llm.common import importable_by_tasks
from tapewright.llm.substring_dedup import Limits

WORD = re.compile(r"[^\x20\x09-\x0d]+")
TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_words int, n_removed string, _id int, spans int, _k1 int"
)


@pytest.fixture(scope="module", autouse=True)
def tasks(spark):
    importable_by_tasks(spark)


def passage(i, n=20):
    return " ".join(f"p{i}w{k}" for k in range(n))


# ---------------------------------------------------------------- substring dedup


def brute_removal(docs, size=13):
    """docs: (key, doc_id, text); None ids are smaller than any other."""
    rank = lambda d: -math.inf if d is None else d
    words = {k: WORD.findall(t or "") for k, _, t in docs}
    ids = {k: rank(d) for k, d, _ in docs}
    first = {}
    for k, w in words.items():
        for i in range(len(w) - size + 1):
            at = tuple(w[i : i + size])
            first[at] = min(first.get(at, math.inf), ids[k])
    out = {}
    for k, w in words.items():
        gone = set()
        for i in range(len(w) - size + 1):
            if first[tuple(w[i : i + size])] < ids[k]:
                gone |= set(range(i, i + size))
        out[k] = (len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))
    return out


def odd_documents():
    own = [" ".join(f"d{i}x{k}" for k in range(15)) for i in range(12)]
    long = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
    return [
        (1, passage(1)),
        (2, own[0] + "\n" + passage(1) + "\t" + own[1]),
        (3, passage(1, 12) + " " + own[2]),              # twelve words are no window
        (4, own[3] + " " + passage(1)[:-1] + " " + own[4]),  # last word differs
        (5, passage(2) + " " + passage(2)),              # repeats itself only
        (5, passage(2) + " same id"),                    # another row of that id
        (6, passage(2) + " " + passage(1) + " " + passage(2)),
        (7, None), (8, ""), (9, " \n\x0b\t "), (10, long), (11, long + " " + passage(1)),
        (None, passage(3) + " a"), (None, passage(3) + " b"), (12, passage(3)),
        (13, own[5]), (13, own[5]), (14, own[5] + " Größe 日本 😀 x"), (15, "x" * 300_000 + " " + own[5]),
        (16, "a\x00 " + passage(4)), (17, "a " + passage(4)), (-5, passage(4, 13)), (18, passage(4, 13).upper()),
    ]


@pytest.mark.parametrize("files", [1, 7])
def test_passages_of_smaller_ids_go(spark, files):
    rows = [(i, t, "en", None, k, "s", 1, 2, 3) for k, (i, t) in enumerate(odd_documents())]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(files)
    want = brute_removal([(k, i, t) for k, (i, t) in enumerate(odd_documents())])
    frame = docs.withColumnRenamed("n_words", "k")  # columns that are made again, or clash
    got = substring_dedup.remove_repeats(frame, limits=Limits(slab_bytes=2000)).collect()
    assert len(got) == len(rows)
    assert {r.k: (r.n_words, r.n_removed, r.text) for r in got} == want
    assert got[0].asDict().keys() == {*frame.columns, "n_words"} and all(r.spans == 2 and r._id == 1 for r in got)


def test_small_chunks_shards_and_segments_change_nothing(spark, documents):
    docs = spark.createDataFrame(documents, "doc_id bigint, text string").repartition(5)
    limits = Limits(chunk_windows=3000, shard_windows=2000, segment_cells=1 << 12, row_cells=1 << 14)
    want = brute_removal([(i, i, t) for i, t in documents])
    got = {r.doc_id: (r.n_words, r.n_removed, r.text) for r in substring_dedup.remove_repeats(docs, limits=limits).collect()}
    assert got == want and sum(v[1] for v in want.values()) > 0


def test_no_documents(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_window_hashes_tell_words_apart():
    hasher = substring_dedup.Hasher(3)
    texts = ["a b c d", "a b c", "ab c d", "a bc d", "a\x00 b c", "b a c", "a b", "", "a  b\tc"]
    counts, h1, h2 = hasher.windows(pa.array(["skipped", *texts])[1:])
    assert counts.tolist() == [2, 1, 1, 1, 1, 1, 0, 0, 1]
    pairs = list(zip(h1.tolist(), h2.tolist(), strict=True))
    assert pairs[0] == pairs[2] == pairs[-1]
    assert len(set(pairs)) == 6


def test_sketch_never_misses_a_repeat(spark, documents):
    from tapewright.session import new_path

    docs = spark.createDataFrame([(t,) for _, t in documents], "text string").repartition(3)
    folder = new_path(spark, "window-sketch")
    paths = substring_dedup.build_sketch(docs, 1 << 14, 13, Limits(segment_cells=1 << 10))
    _, h1, h2 = substring_dedup.Hasher(13).windows(pa.array([t for _, t in documents]))
    seen = Counter(zip(h1.tolist(), h2.tolist(), strict=True))
    passed = set(substring_dedup.Sketch(folder, paths, 1 << 14).repeated(h1, h2).tolist())
    assert all(i in passed for i, p in enumerate(zip(h1.tolist(), h2.tolist(), strict=True)) if seen[p] > 1)


@pytest.fixture(scope="module")
def documents():
    import duckdb

    sql = "SELECT doc_id, coalesce(text, '') FROM '/root/testdata/sf0.001/documents.parquet' ORDER BY 1"
    return duckdb.sql(sql).fetchall()


# ---------------------------------------------------------------- divergence audit


def brute_audit(rows):
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t)
    docs = [(a or "", s or "", TERM.findall(lower(t or ""))) for a, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == lang]
        df = Counter(t for _, _, ts in mine for t in set(ts))
        kept = [t for t, n in df.items() if n >= 3]
        counts = defaultdict(Counter)
        for _, s, ts in mine:
            counts[s].update(t for t in ts if df[t] >= 3)
        total = sum(counts.values(), Counter())
        chance = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}  # noqa: B023, E731
        p, q = {s: chance(c) for s, c in counts.items()}, chance(total)
        for s in counts:
            pair = [(o, sum((p[s][t] - p[o][t]) ** 2 // p[o][t] for t in kept)) for o in counts if o != s]
            term = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if counts[s][t] and p[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                last = None if part == "pair" else 200
                out += [(lang, s, part, i, v, n) for n, (i, v) in enumerate(items[:last], 1)]
    return sorted(out)


def audited(spark, rows, files=3, **sizes):
    docs = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "lang string, source string, text string, g int")
    return sorted(tuple(r) for r in divergence.audit(docs.repartition(files), **sizes).collect())


def made_up(seed, langs, sources, docs, words):
    rng = np.random.default_rng(seed)
    vocabulary = [f"{a}{b}" for a in ("Wort", "ähre", "日", "x😀") for b in "abcdefghijklmnopqrstuvwxyz"] + ["1-2", "A'b"]
    draw = lambda n: " ".join(rng.choice(vocabulary, n, p=np.arange(106, 0, -1) / (106 * 107 / 2)))
    return [(f"l{rng.integers(langs)}", f"s{rng.integers(sources)}", draw(int(rng.integers(words)))) for _ in range(docs)]


def test_audit_equals_brute_force(spark):
    rows = [
        *made_up(1, 2, 5, 60, 80), ("l0", "bare", None), ("l1", "bare", "12 34"), (None, None, "alone"), (None, "b", "alone"),
        ("one", "only", "same same"), ("one", "only", "same"), ("one", "only", "same"), ("none", "a", "p"), ("none", "b", "q"),
    ]
    assert audited(spark, [*rows, rows[0], rows[0]]) == brute_audit([*rows, rows[0], rows[0]])


def test_blocks_and_tiles_change_nothing(spark):
    rows = made_up(2, 1, 9, 80, 60)
    assert audited(spark, rows, block_terms=7, tile_groups=2) == brute_audit(rows)


ODD_TEXTS = ["", " 7 ", "A a\u0085b É É_x\tß\nZ9z 日本 日本", "b a A", "b" * 3000, "a"]


def counted_terms(texts):
    found = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t in texts]
    n, df = Counter(w for f in found for w in f), Counter(w for f in found for w in set(f))
    return sorted((w, n[w], df[w]) for w in n)


def test_terms_of_a_batch_are_counted_at_once():
    for texts in (ODD_TEXTS, ODD_TEXTS[2:5], [], ["", " "]):
        got = divergence.term_counts(pa.array(["zz zz", *texts, "zz"], pa.string())[1 : len(texts) + 1])
        assert sorted(map(tuple, (r.values() for r in got.to_pylist()))) == counted_terms(texts)


@pytest.mark.parametrize("part_bytes", [1, 40, 1 << 22])
def test_parts_of_a_batch_are_added_up(spark, part_bytes):
    importable_by_tasks(spark)
    rows = [(g, None, t) for t in [*ODD_TEXTS, None] for g in ("en", None)]
    docs = spark.createDataFrame(rows, "lang string, source string, text string").coalesce(1)
    got = divergence.group_counts(docs, part_bytes).collect()
    assert {(r.lang, r.source, r.n, r.df) for r in got if r.term is None} == {("en", "", 0, 0), ("", "", 0, 0)}
    for lang in ("en", ""):
        assert sorted((r.term, r.n, r.df) for r in got if r.lang == lang and r.term is not None) == counted_terms(ODD_TEXTS)


def test_audit_of_nothing(spark):
    assert audited(spark, []) == []


def test_long_text_and_long_term(spark):
    rows = [("l", f"s{i % 2}", "w" * 100_000 + " " + "tail " * 50_000) for i in range(3)]
    assert audited(spark, rows) == brute_audit(rows)


def test_equal_subtrees_are_one_node_and_priced_once():
    row = np.array([3, 1] * 512)
    forest = divergence.Forest(np.array([row, row, np.zeros(1024, int)]))
    assert [x.shape[1] for x in forest.levels] == [2] * 10
    which, a, b, times = forest.leaf_pairs(0, np.array([1, 2]))
    assert sorted(zip(which.tolist(), a.tolist(), b.tolist(), times.tolist(), strict=True)) == [
        (0, 1, 1, 512), (0, 3, 3, 512), (1, 1, 0, 512), (1, 3, 0, 512)
    ]


def test_shares_are_exact_for_large_counts():
    counts = [0, 1, 10**12, 7 * 10**14 + 3, 8 * 10**15]
    total = 9 * 10**15
    assert divergence.share(np.array(counts), np.int64(total)).tolist() == [1 + 10**9 * (c + 1) // total for c in counts]


# ---------------------------------------------------------------- clustering


def brute_clusters(rows, k, rounds, size):
    whole = [
        (i, [math.floor(256 * float(x)) for x in v])
        for i, v in rows
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)
    ]
    name = lambda i: "null" if i is None else str(i)
    start = sorted(whole, key=lambda r: (hashlib.sha256(f"2:{name(r[0])}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in start[:k]]
    place = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centers))
    for _ in range(rounds):
        members = defaultdict(list)
        for _, v in whole:
            members[place(v)[1]].append(v)
        centers = [[sum(x) // len(m) for x in zip(*m, strict=True)] if (m := members.get(j)) else c for j, c in enumerate(centers)]
    placed = [(i, *place(v)) for i, v in whole]
    inertia = Counter()
    for _, d, j in placed:
        inertia[j] += d
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(map(str, [(i, j, d, inertia[j], sum(inertia.values()), digest[j]) for i, d, j in placed]))


@pytest.mark.parametrize("n", [0, 2, 70])
def test_clusters_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(n)]
    inf, nan = math.inf, math.nan
    odd = [(100, None), (101, []), (102, [1.0] * 5), (103, [1.0] * 7), (104, [None] + [1.0] * 5), (105, [nan] * 6), (106, [-inf] * 6)]
    rows = [*rows, *rows[:2], *odd, *[(None, v) for _, v in rows[2:4]]]
    table = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, v string")
    got = centroids.cluster(table, k=5, rounds=3, size=6).drop("centroid").collect()
    assert sorted(str(tuple(r)) for r in got) == brute_clusters(rows, 5, 3, 6)


def test_equal_vectors_share_the_first_centroid(spark):
    table = spark.createDataFrame([(i, [0.5, -0.5]) for i in range(6)], "vec_id int, embedding array<float>")
    got = centroids.cluster(table, k=4, rounds=2, size=2).collect()
    assert {(r.cluster, r.distance, r.inertia, tuple(r.centroid)) for r in got} == {(0, 0, 0, (128, -128))}


def test_components_without_an_exact_distance_are_refused(spark):
    table = spark.createDataFrame([(1, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    with pytest.raises(Exception, match="not under"):
        centroids.cluster(table, size=2).collect()


def test_no_python_in_the_assignment(spark):
    whole = spark.createDataFrame([(1, [1, 2])], "vec_id bigint, v array<bigint>")
    best = whole.select(centroids.nearest(whole["v"], [[0, 0], [1, 1]]).alias("b"))
    assert "Python" not in best._jdf.queryExecution().executedPlan().toString()
    assert tuple(best.first()["b"]) == (1, 1)
