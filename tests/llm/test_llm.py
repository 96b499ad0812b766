"""The operators against brute force and SQL, and their edge cases."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tapewright.llm import jaccard_join, langid, line_dedup, mixing, packing, secrets, simhash, topk
from tapewright.llm.common import importable_by_tasks, likely_in, parts
from tapewright.llm.queries import QUERIES, tokenizer
from tapewright.llm.sql import ORACLES
from tapewright.session import materialize, scratch, work_dir

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0d]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, class_id int, links int, score int, _row int"
LONG = " ".join(f"word{i % 997} of{i}" for i in range(30_000))
TEXTS = [None, "", " \n\t", "one", "a b c d e f g h", "a b c d e f g h", LONG, "Der Hund und die Katze\nüber 日本"]


def lowered(text):
    return "".join(c.lower() if c.isascii() else c for c in text)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and very long texts, repeated rows, clashing names."""
    importable_by_tasks(spark)
    rows = [(i, t, "en" if i % 2 else None, "s" if i % 3 else None, None, 7, None, 1, 2) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame([*rows, rows[4], (None, None, None, None, None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    importable_by_tasks(spark)
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text, lang, source FROM '{SF}/documents.parquet' ORDER BY 1").df()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    rows = lambda d: sorted(map(str, d[sorted(d.columns)].astype(object).where(d[sorted(d.columns)].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


# ---------------------------------------------------------------- packing


def test_small_caches_change_no_ids():
    from tokenizers import Tokenizer

    path, pattern = tokenizer()["tokenizer"], tokenizer()["pattern"]
    known, encode = Tokenizer.from_file(path), packing.encoder(path, pattern, cached_words=3)
    for text in ["a b c d e f a b", "one  two\tthree one", "Größe, x! x! y", *[f"w{i} w{i % 4}" for i in range(20)]]:
        assert encode(text) == np.array(known.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    cache = packing.Cached(str.encode, 3)
    for t in "abcdabcdefgh":
        assert cache[t] == t.encode() and len(cache) <= 3 and len(cache.old) <= 3


def check_pieces(rows, texts):
    from tokenizers import Tokenizer

    encode = Tokenizer.from_file(tokenizer()["tokenizer"])
    pieces, used = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        used[r.sequence_id].append((r.offset, r.length))
    for doc_id, text in texts.items():
        ids = np.array([*encode.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in sorted(pieces[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return sum(n for p in used.values() for _, n in p) / (1024 * len(used))


def test_packing_covers_every_id_once(spark, documents):
    rows = QUERIES["op1_packing"](spark, SF).collect()
    assert check_pieces(rows, dict(zip(documents.doc_id, documents.text, strict=True))) > 0.95


def test_encoder_equals_the_tokenizer(documents, monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "CACHED_WORDS", 50)  # words are forgotten and made again
    settings = tokenizer()
    encode, plain = packing.encoder(settings["tokenizer"], settings["pattern"]), Tokenizer.from_file(settings["tokenizer"])
    odd_texts = [
        "", " ", "  ", "a ", " a", "a  b", "a \n b", "\t x", "it's we'll  'd", "日本 語😀 é\x85 \u00a0x \u3000y", "x\x1c \x1cy",
        "a\u200b b \u200bc", "\x00 \x7f \xad ¡", "<|endoftext|> hi", "a, b!? (c) d'e. 1,5 a1; é...", "x" * 200 + " " + "é" * 200,
    ]
    for text in [*odd_texts, *(t or "" for t in documents.text)]:
        want = np.asarray(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encode(text) == want


def test_batch_encoder_tokenizes_the_words_of_many_texts_at_once(documents, monkeypatch):
    import random

    settings, rng = tokenizer(), random.Random(3)
    path, pattern = settings["tokenizer"], settings["pattern"]
    bits = [
        "'s", "'t", "'re", "'ve", "'m", "'ll", "'d", "'S", "'", "''", " ", "  ", "\n", "\t", "\r\n", "\x85", "\u00a0", "\u3000", "a", "the", "é",
        "日本", "😀", "1", "23", "½", "²", ",", ".", "...", "!?", "\x00", "\x7f", "\x1c", "\u200b", "\u0301", "e", "l", "v", "r", "aaaa", "0000", "----", "====",
    ]
    odd_texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(20_000)]
    odd_texts += ["", "x" * 300, " " * 300, "\n\t" * 200, "<|endoftext|> hi", "'", "'r", "'re", "a'l", ""]
    one_by_one = packing.encoder(path, pattern)
    texts = [*odd_texts, *(t or "" for t in documents.text[:300])]
    want = [one_by_one(t) for t in texts]
    assert list(packing.batch_encoder(path, pattern)(pa.array(texts).slice(7))) == want[7:]  # a slice of a column
    assert list(packing.batch_encoder(path, r"\w+|\W+")(pa.array(texts[:50]))) == [packing.encoder(path, r"\w+|\W+")(t) for t in texts[:50]]
    monkeypatch.setattr(packing, "PART_BYTES", 64)
    assert list(packing.batch_encoder(path, pattern)(pa.array(texts[-2_000:]))) == want[-2_000:]
    # The different words of a part are tokenized in one call, none by itself.
    monkeypatch.setattr(packing, "PART_BYTES", 1 << 21)
    calls, encode = [], packing.Merges.encode
    monkeypatch.setattr(packing.Merges, "encode", lambda self, data, sizes: calls.append(len(sizes)) or encode(self, data, sizes))
    monkeypatch.setattr(packing, "encoder", lambda *_: pytest.fail("a plain text is encoded by itself"))
    assert list(packing.batch_encoder(path, pattern)(pa.array(["a b a", "b c'd"] * 500))) == [one_by_one("a b a"), one_by_one("b c'd")] * 500
    assert calls == [6]


def test_packing_edges(odd, empty):
    rows = packing.pack(odd, **tokenizer()).collect()
    assert len({r.doc_id for r in rows}) == len(TEXTS) + 1
    assert sum(r.doc_id == 4 for r in rows) == 2  # a repeated row is packed again
    assert packing.pack(empty, **tokenizer()).count() == 0


def test_first_fit_decreasing_is_first_fit():
    lengths = np.array([5, 7, 3, 9, 1, 1, 2, 10])
    bins, places = packing.first_fit_decreasing(lengths, 10)
    room, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
        if b == len(room):
            room.append(10)
        want[i] = (b, 10 - room[b])
        room[b] -= lengths[i]
    assert {i: (int(bins[i]), int(places[i])) for i in range(len(lengths))} == want


# ---------------------------------------------------------------- mixing


def test_mixing_edges(odd, empty):
    rows = mixing.taken(mixing.place(odd)).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.taken <= 2 * r["size"] for r in rows)
    by_source = defaultdict(int)
    for r in rows:
        by_source[r.source_size, r.target] += r.taken
    assert all(abs(n - target) <= 1 for (_, target), n in by_source.items())
    assert mixing.taken(mixing.place(empty)).count() == 0
    assert all((r.taken > 0) == (r.position is not None and 0 <= r.position < 1) for r in rows)


def test_taken_is_the_sum_of_the_readings(spark, documents):
    """Also under schedules, where the demand curve is no straight line."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = sorted(set(documents.source.dropna()))[0]
    placed = mixing.place(docs, schedules={first: ((0, 0.0), (1, 1.0))})
    want, at = Counter(), {}
    for r in mixing.readings(placed).collect():
        want[r.doc_id] += r.words
        at[r.doc_id] = min(r.position, at.get(r.doc_id, 2))
    rows = mixing.taken(placed).collect()
    assert {r.doc_id: r.taken for r in rows if r.taken} == want
    assert {r.doc_id: r.position for r in rows if r.taken} == at
    order = [r.position for r in rows if r.position is not None]
    assert order == sorted(order) and len(rows) == len(documents)


def test_curriculum_moves_a_rising_source_to_the_end(spark):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.lit("a b c d").alias("text"), F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("source")
    )
    schedule = {"x": ((0, 0.0), (1, 1.0)), "y": ((0, 1.0), (1, 0.0))}
    placed = mixing.place(docs, schedules=schedule, share=1.0, cycle=(1.0,), keep=["doc_id", "source"])
    mean = {r.source: r.p for r in mixing.readings(placed).groupBy("source").agg(F.avg("position").alias("p")).collect()}
    assert mean["x"] > 0.6 > 0.4 > mean["y"]


# ---------------------------------------------------------------- line dedup


def test_line_dedup_edges(spark, odd, empty):
    kept = line_dedup.drop_shared_lines(odd)
    assert kept.count() == odd.count() and kept.agg(F.sum("n_dropped")).first()[0] == 0
    line = "x" * 40
    docs = spark.createDataFrame([(i, f"{line.upper() if i % 2 else line}\nown {i}") for i in range(6)], "doc_id bigint, text string")
    got = {r.doc_id: r.text for r in line_dedup.drop_shared_lines(docs).collect()}
    assert got[5] == f"{line.upper()}\nown 5" and all(got[i] == f"own {i}" for i in range(5))
    assert line_dedup.drop_shared_lines(empty).count() == 0


# ---------------------------------------------------------------- near duplicates


def brute_classes(texts):
    sets = {}
    for i, t in texts.items():
        words = WORD.findall(lowered(t or ""))
        k = min(5, len(words))
        sets[i] = frozenset(tuple(words[j : j + k]) for j in range(len(words) - k + 1)) if words else frozenset()
    names, label = defaultdict(list), {i: i for i in sets}
    for i in sorted(sets):
        names[sets[i]].append(i)

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    each, links = [s for s in names if s], Counter()
    for a, s in enumerate(each):
        for o in each[a + 1 :]:
            both = len(s & o)
            if both >= 0.8 * (len(s) + len(o) - both):
                links[s] += 1
                links[o] += 1
                x, y = find(names[s][0]), find(names[o][0])
                label[max(x, y)] = min(x, y)
    return {i: (find(names[s][0]), links[s], len(names[s])) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 3])
def test_near_duplicates_equal_brute_force(spark, documents, block):
    importable_by_tasks(spark)
    texts = dict(zip(documents.doc_id.tolist(), documents.text, strict=True))
    base = [f"w{i}" for i in range(100)]
    for k in range(12):  # a group of near copies, larger than the small block
        texts[100_000 + k] = " ".join([*base[:k], f"changed{k}", *base[k + 1 :]])
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    got = {r.doc_id: (r.class_id, r.links, r.copies) for r in jaccard_join.near_duplicates(docs, block=block).collect()}
    assert got == brute_classes(texts)


def test_near_duplicates_edges(odd, empty):
    rows = jaccard_join.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    got = defaultdict(list)
    for r in rows:
        got[r.doc_id].append((r.class_id, r.links, r.copies))
    assert got[None] == [(0, 0, 4)] and got[1] == got[2] == [(0, 0, 4)]
    assert got[4] == [(4, 0, 3)] * 2 and got[5] == [(4, 0, 3)]
    kept = jaccard_join.one_of_each(odd)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 4, 6, 7] and kept.columns == odd.columns
    assert jaccard_join.near_duplicates(empty).count() == 0


def test_one_of_each_keeps_every_class(spark):
    importable_by_tasks(spark)
    base = [f"w{i}" for i in range(60)]
    near = " ".join([*base[:59], "changed"])
    rows = [
        (None, "first text without id"), (None, "second text without id"), (None, "third text without id"),
        (None, "third text without id"), (7, "one text of id seven"), (7, "another text of id seven"),
        (3, " ".join(base)), (7, near), (None, near), (None, "text of nine"), (9, "text of nine"), (9, "text of nine"),
        (5, "TEXT of five"), (5, "text of five"),
    ]
    want = [
        (3, " ".join(base)), (5, "TEXT of five"), (7, "another text of id seven"), (7, "one text of id seven"),
        (9, "text of nine"), (None, "first text without id"), (None, "second text without id"), (None, "third text without id"),
    ]
    for order in (rows, rows[::-1]):
        docs = spark.createDataFrame([(i, t, "x") for i, t in order], "doc_id bigint, text string, _key string")
        kept = jaccard_join.one_of_each(docs)
        got = [(r.doc_id, r.text) for r in kept.collect()]
        assert sorted(got, key=str) == sorted(want, key=str) and kept.columns == docs.columns


def test_posterior_bound_keeps_pairs_at_the_threshold():
    for n, fewest in jaccard_join.fewest_matches(0.8, 1e-6):
        lost = sum(math.comb(n, m) * 0.8**m * 0.2 ** (n - m) for m in range(fewest))
        assert lost < 1e-5 and (n < 128 or fewest > 60)


# ---------------------------------------------------------------- language


def test_language_held_out_accuracy(spark, documents):
    rows = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SF).collect()}
    true = dict(zip(documents.doc_id, documents.lang, strict=True))
    held = [i for i, r in rows.items() if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert np.mean([rows[i].lang_pred == true[i] for i in held]) >= 0.97
    assert all(0 <= r.score <= 1 for r in rows.values())


def test_language_edges(odd, empty):
    said = {r.doc_id: r.lang_pred for r in langid.learn_and_identify(odd).collect()}
    assert said[0] == said[1] == said[2] == "und" and said[3] == "en"
    assert langid.learn_and_identify(empty).count() == 0


def made_up(rng, letters, n, words=120):
    """Texts of one language: words from a vocabulary of its own syllables."""
    syllables = ["".join(rng.choice(list(letters), 3)) for _ in range(40)]
    vocabulary = ["".join(rng.choice(syllables, int(rng.integers(1, 4)))) for _ in range(400)]
    return [" ".join(rng.choice(vocabulary, words)) for _ in range(n)]


def test_language_rare_and_junk_labels(spark):
    importable_by_tasks(spark)
    rng = np.random.default_rng(11)
    large = [(t, lang) for lang, letters in (("aa", "abcdefghi"), ("bb", "jklmnopqr")) for t in made_up(rng, letters, 300)]
    rare = [(t, "rr") for t in made_up(rng, "stuvwxyzäö", 8)]
    junk = [("".join(rng.choice([*map(chr, range(0x4E00, 0x6E00)), " "], 20_000)), "junk") for _ in range(2)]
    copies = [(large[0][0], "aa")] * 900
    rows = [*large, *rare[:4], *junk, *copies]
    docs = spark.createDataFrame(rows, "text string, lang string")
    model = langid.train(docs, train_rows=200, max_grams=3000)
    for text, lang in [*large, *rare]:
        said, score = model.decide(text)
        assert said == lang and score >= corpus_pipeline.MIN_SCORE, (lang, said, score)


def test_language_learns_whole_texts(spark):
    importable_by_tasks(spark)
    rng = np.random.default_rng(12)
    header, body, tail = (made_up(rng, letters, 1, n)[0] for letters, n in (("0123456789", 90_000), ("abcdefghi", 90_000), ("stuvwxyzäö", 300)))
    text = f"{header[: langid.PIECE_CHARS - 5]} {body} {tail}"
    model = langid.train(spark.createDataFrame([(text, "aa")], "text string, lang string"))
    for part in (body[-3000:], tail):
        said, score = model.decide(part)
        assert said == "aa" and score >= 0.9, score


def test_shares_leave_room_to_every_language():
    assert langid.shares({"a": 10, "b": 1000, "c": 400}, 900, 1) == {"a": 10, "b": 490, "c": 400}
    assert langid.shares({"a": 5, "b": 500}, 10, 100) == {"a": 5, "b": 100}


# ---------------------------------------------------------------- fingerprints


def test_simhash_edited_texts(spark, documents):
    rows = sorted(QUERIES["op7_simhash"](spark, SF).collect(), key=lambda r: r.doc_id)
    texts = [t or "" for t in documents.text]
    alike = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / simhash.BITS
    for k, r in enumerate(rows):
        half, after = len(texts[k]) // 2, (k + 1) % len(rows)
        edited = texts[k][: len(texts[k]) - half] + texts[after][:half]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest() and r.n_chars == len(texts[k])
        assert r.near_edited == alike(r.fingerprint, r.edited_fingerprint)
        assert r.near_next == alike(r.fingerprint, rows[after].fingerprint)
    assert np.mean([r.near_edited > r.near_next for r in rows]) > 0.95


def test_simhash_edges(odd, empty):
    rows = simhash.fingerprint_edits(odd, buckets=3).collect()
    assert len(rows) == odd.count()
    prints = defaultdict(set)
    for r in rows:
        prints[r.doc_id].add(r.fingerprint)
    assert prints[None] == prints[0] == prints[1] == prints[2] == {"0" * 32}
    assert prints[4] == prints[5] and len(prints[4]) == 1
    assert simhash.fingerprint_edits(empty).count() == 0


def test_block_tables_find_all_within_the_radius(spark):
    rng = np.random.default_rng(3)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = {f"{b ^ sum(1 << int(j) for j in rng.choice(128, d, replace=False)):032x}" for b in base for d in range(6)}
    table = spark.createDataFrame([(p,) for p in [*prints, None]], "fingerprint string")
    got = {(r.query, r.fingerprint, r.distance) for r in simhash.search(table, table).collect()}
    apart = lambda a, b: (int(a, 16) ^ int(b, 16)).bit_count()
    assert got == {(a, b, apart(a, b)) for a in prints for b in prints if apart(a, b) <= simhash.RADIUS}


def test_simhash_is_native(spark, odd):
    plan = simhash.fingerprint_edits(odd)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ArrowEval" not in plan and "InPandas" not in plan


# ---------------------------------------------------------------- search


def test_search_equals_brute_force(spark, documents):
    vectors = {i: Counter(re.findall(r"[^\W_]+", (t or "").lower())) for i, t in zip(documents.doc_id, documents.text, strict=True)}
    n, mean = len(vectors), sum(sum(c.values()) for c in vectors.values()) / len(vectors)
    df = Counter(t for c in vectors.values() for t in c)
    docs = spark.createDataFrame(documents[["doc_id", "text"]])
    importable_by_tasks(spark)
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    got = defaultdict(list)
    for r in topk.top_k(queries, docs, shard_docs=60).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.doc_id, r.score))
    for q in [i for i in vectors if i % 20 == 0]:
        scores = []
        for i, c in vectors.items():
            norm = 1.2 * (0.25 + 0.75 * sum(c.values()) / mean)
            s = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + norm) for t in vectors[q] if t in c)
            if s > 0:
                scores.append((-round(s, 8), i))
        want = sorted(scores)[:10]
        assert [i for i, _ in got[q]] == [i for _, i in want]
        assert np.allclose([s for _, s in got[q]], [-s for s, _ in want])


def test_search_edges(odd, empty):
    asked = odd.select(F.col("doc_id").alias("query_id"), "text")
    rows = topk.top_k(asked, odd, k=2).collect()
    got = defaultdict(set)
    for r in rows:
        got[r.query_id].add((r["rank"], r.doc_id))
    assert not {None, 0, 1, 2} & set(got)
    assert got[4] == got[5] == {(1, 4), (2, 4)}  # ties: the smaller id, its repeated row too
    assert topk.top_k(asked, empty).count() == 0
    assert topk.top_k(asked.limit(0), odd).count() == 0


def test_term_vectors_equal_python():
    odd = ["", "!?", "a_b", "Stra\u00dfe STRASSE", "\u0130stanbul \u03a3\u03a3 \u65e5\u672c \u0661\u0662 e\u0301", "\u00bd \u00b2 \u00aa", "x\x00y X", LONG]
    texts = odd + [f"q{chr(c)}W {chr(c)}" for c in range(0x3000) if not 0xD800 <= c < 0xE000]
    got = topk.term_vectors(pa.array(texts))
    for i, text in enumerate(texts):
        want = Counter(re.findall(r"[^\W_]+", text.lower()))
        hashed = {int(h): n for h, n in zip(pd.util.hash_array(np.array([*want, ""], object)).view(np.int64), [*want.values(), 0], strict=True)}
        part = slice(got.starts[i], got.starts[i + 1])
        assert dict(zip(got.terms[part].tolist(), got.counts[part].tolist(), strict=True)) == {h: n for h, n in hashed.items() if n}
        assert (got.terms[part][1:] > got.terms[part][:-1]).all()


def test_search_does_without_postings_of_frequent_terms():
    rng = np.random.default_rng(3)
    usual = [[f"{lang}{w}" for w in range(40)] for lang in "de"]
    texts = [" ".join([*rng.choice(usual[i % 2], 30), *(f"rare{x}" for x in rng.integers(0, 900, 6))]) for i in range(2000)]
    texts += texts[:40]  # copies have equal scores, whichever block they are in
    vectors = topk.term_vectors(pa.array(texts))
    terms, df = np.unique(vectors.terms, return_counts=True)
    mean, n = vectors.counts.sum() / len(texts), len(texts)
    frequent = terms[df > topk.FREQUENT * n]
    frequent = frequent[np.argsort(-df[np.searchsorted(terms, frequent)], kind="stable")]
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))[np.searchsorted(terms, vectors.terms)]
    shard = topk.Shard(vectors, np.arange(n)[::-1], mean, frequent)
    assert len(frequent) == 80 and len(shard.doc) == len(vectors.terms) - df[df > topk.FREQUENT * n].sum()
    asked, floors = 100, np.zeros(100)
    end = vectors.starts[asked]
    query, doc, score = shard.search(vectors.starts[: asked + 1], vectors.terms[:end], idf[:end], 10, floors)
    bags = [dict(zip(vectors.terms[a:b], vectors.counts[a:b], strict=True)) for a, b in zip(vectors.starts, vectors.starts[1:], strict=False)]
    for q in range(asked):
        weight = dict(zip(vectors.terms[vectors.starts[q] : vectors.starts[q + 1]], idf[vectors.starts[q] : vectors.starts[q + 1]], strict=True))
        want = []
        for i, bag in enumerate(bags):
            norm = 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)
            want.append((-round(sum(weight[t] * c * 2.2 / (c + norm) for t, c in bag.items() if t in weight), 9), n - 1 - i))
        want = sorted(want)[:10]
        assert shard.ids[doc[query == q]].tolist() == [i for _, i in want]
        assert np.allclose(score[query == q], [-s for s, _ in want])
        assert np.isclose(floors[q], -want[-1][0])


def test_search_adds_terms_of_a_kind_of_documents_as_rows():
    """Terms that few documents have, but most of one kind, have no postings in that kind."""
    rng = np.random.default_rng(5)
    word = lambda kind, x: "".join(chr(97 + int(d)) for d in f"{x:03}") + kind
    texts = []
    for kind, many in (("x", 1600), ("y", 200), ("z", 200)):
        usual, others = [word(kind, x) for x in range(30)], [word(kind, x) for x in range(100, 160)]
        texts += [" ".join([*rng.choice(usual, 60), *rng.choice(others, 25), f"rare{rng.integers(0, 300)}"]) for _ in range(many)]
    texts += ["", *texts[:20], *texts[-20:]]  # copies have equal scores, whichever block they are in
    texts = [texts[i] for i in rng.permutation(len(texts))]
    vectors = topk.term_vectors(pa.array(texts))
    terms, df = np.unique(vectors.terms, return_counts=True)
    mean, n = vectors.counts.sum() / len(texts), len(texts)
    frequent = terms[df > topk.FREQUENT * n]
    assert ((df > 0.02 * n) & (df <= topk.FREQUENT * n)).sum() == 120  # the others of y and z
    idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
    shard = topk.Shard(vectors, np.arange(n), mean, frequent)
    assert len(shard.doc) < 1.1 * n  # the rare ones
    bags = [dict(zip(vectors.terms[a:b], vectors.counts[a:b], strict=True)) for a, b in zip(vectors.starts, vectors.starts[1:], strict=False)]
    weight = dict(zip(terms, idf, strict=True))
    floors = np.zeros(n)
    floors[::3] = 1e9  # above every score: nothing is found
    query, doc, score = shard.search(vectors.starts, vectors.terms, idf[np.searchsorted(terms, vectors.terms)], 10, floors)
    assert not (query % 3 == 0).any()
    for q in range(1, n, 40):
        want = []
        for i, bag in enumerate(bags):
            norm = 1.2 * (0.25 + 0.75 * sum(bag.values()) / mean)
            want.append((-round(sum(weight[t] * c * 2.2 / (c + norm) for t, c in bag.items() if t in bags[q]), 9), i))
        want = [] if q % 3 == 0 else [(s, i) for s, i in sorted(want)[:10] if s < 0]
        assert shard.ids[doc[query == q]].tolist() == [i for _, i in want]
        assert np.allclose(score[query == q], [-s for s, _ in want])


def test_search_in_steps_and_small_shards(spark):
    """More shards than steps, in which floors come from the steps before; equal to one shard."""
    rng = np.random.default_rng(6)
    rows = [(i, " ".join([*(f"w{x}" for x in rng.zipf(1.3, 30) % 500), "common" * int(i % 3)])) for i in range(600)]
    rows += [(None, rows[7][1]), (7, rows[7][1]), (601, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    importable_by_tasks(spark)
    queries = docs.where("doc_id % 20 = 7").select(F.col("doc_id").alias("query_id"), "text")
    found = lambda size: sorted(topk.top_k(queries, docs, shard_docs=size).collect(), key=str)
    small, one = found(37), found(100_000)
    assert len(small) == 31 * 10 and [r[:3] for r in small] == [r[:3] for r in one]
    assert [r["doc_id"] for r in small if r["query_id"] == 7 and r["rank"] <= 3].count(None) in (1, 2)  # its own row twice


# ---------------------------------------------------------------- secrets


def test_secrets_equal_brute_force(spark, documents, odd, empty):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    rows = {r.doc_id: r for r in QUERIES["op10_secret_scan"](spark, SF).collect()}
    assert len(rows) == len(documents)
    for doc_id, text in zip(documents.doc_id, documents.text, strict=True):
        text = text or ""
        spans = [(m.start(), 0, f"assign:{m.start()}:{m.end()}") for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, f"access:{m.start()}:{m.end()}") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, f"hex:{m.start()}:{m.end()}") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        listed = ",".join(s for *_, s in sorted(spans))
        assert rows[doc_id].base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
    assert secrets.find_secrets(odd).count() == odd.count()
    assert secrets.find_secrets(empty).count() == 0


def brute_verdicts(rows, owners_from, repositories_from):
    """(start, kind, end) of all spans by repository; rows are (repository, owner, text)."""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    found, owners, repositories = defaultdict(list), defaultdict(set), defaultdict(set)
    for repository, owner, text in rows:
        text = text or ""
        hits = [("assign", m.span(), m.span(2)) for m in assign.finditer(text) if len(m[2]) >= 6]
        hits += [("access", m.span(), m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        hits += [("hex", m.span(), m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        for kind, span, (a, b) in hits:
            found[repository].append((kind, span, a, b, text[a:b]))
            owners[text[a:b]].add(owner or "")
            repositories[text[a:b]].add(repository)
    spans = {}
    for repository, hits in found.items():
        here = set()
        for kind, (start, end), a, b, value in hits:
            here.add((start, secrets.KINDS.index(kind), end))
            shares = [value.count(c) / len(value) for c in set(value)]
            copied = len(owners[value]) >= owners_from or len(repositories[value]) >= repositories_from
            random = -sum(p * math.log2(p) for p in shares) >= secrets.RANDOM_BITS
            here.add((a, secrets.KINDS.index("example" if copied else "live" if random else "weak"), b))
        spans[repository] = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(here))
    return spans


def test_verdict_spans_equal_brute_force(spark, documents):
    rows = list(zip(documents.doc_id, documents.source, documents.text, strict=True))
    want = brute_verdicts(rows, secrets.EXAMPLE_OWNERS, secrets.EXAMPLE_REPOSITORIES)
    got = {r.doc_id: r.spans for r in QUERIES["op10_secret_scan"](spark, SF).collect()}
    assert {d: s for d, s in got.items() if s} == want


def test_verdict_uses_owners_and_repositories(spark):
    one_owner, lone, spread_out = "Qz7hT1mKp9Xw4LbR", "Vn3cY8sGd2Fj6Ua0", "Ht5eB9xWq1Zr7Mk2"
    rows = [(i, "a", f"token = {one_owner}") for i in range(12)]
    rows += [(20, "b", f"x api_key: '{lone}' and password=aaaaaaa"), (21, None, None)]
    rows += [(30 + i, o, f"secret={spread_out}") for i, o in enumerate("abc")]
    df = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    for owners, repositories in ((3, 10), (3, 13), (4, 2)):
        found = secrets.find_secrets(df, example_owners=owners, example_repositories=repositories)
        got = {r.doc_id: r.s for r in found.select("doc_id", secrets.listed(F.col("spans")).alias("s")).collect()}
        want = brute_verdicts(rows, owners, repositories)
        assert {d: s for d, s in got.items() if s} == want and len(got) == len(rows)
    assert "live:" in want[20] and "weak:" in want[20]


# ---------------------------------------------------------------- pipeline


def test_pipeline_stages_do_what_they_say(spark, documents):
    importable_by_tasks(spark)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    said = corpus_pipeline.language(spark, docs, SF)
    assert said.columns == docs.columns and said.count() == len(documents)  # clean documents stay
    lines = corpus_pipeline.lines(spark, said, SF)
    near = corpus_pipeline.near_duplicates(spark, lines, SF)
    texts = {r.doc_id: r.text for r in lines.collect()}
    want = {c for c, _, _ in brute_classes(texts).values()}
    assert {r.doc_id for r in near.collect()} == want and near.columns == docs.columns
    pieces = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id for r in pieces} <= want and json.dumps(sorted({r.length <= 1024 for r in pieces})) == "[true]"


def test_pipeline_on_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        rows = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        assert {r.doc_id for r in rows} <= {3, 4, 6, 7}


def test_working_tables_go_with_the_work_they_are_for(spark, odd):
    shared = Path(work_dir(spark))

    def left(stage):
        before = {p.name for p in shared.iterdir()}
        rows = stage(spark, odd, "").collect()  # reads nothing that is gone
        return {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in before}, len(rows)

    assert left(corpus_pipeline.language)[0] == set()
    assert left(corpus_pipeline.near_duplicates) == ({"keyed", "gone", "filter"}, 5)
    before = {p.name for p in shared.iterdir()}
    with scratch(spark):
        with scratch(spark) as keep:
            inner = materialize(odd, "inner")
            outer = keep(inner, "outer")
        assert outer.count() == len(TEXTS) + 2
        assert {p.name.rsplit("-", 1)[0] for p in shared.iterdir() if p.name not in before} == {"outer"}
    assert {p.name for p in shared.iterdir()} == before


def test_tasks_hold_few_rows_at_once(spark, odd):
    batch = pa.RecordBatch.from_pydict({"x": list(range(2500))})
    cut = list(parts([batch, batch.slice(0, 0), batch.slice(0, 1024)]))
    assert [b.num_rows for b in cut] == [1024, 1024, 452, 1024] and cut[2].column(0)[0].as_py() == 2048
    # The plan of the sources comes without a Python worker that would turn a list into rows.
    sized = odd.select("source", F.lit(3).cast("bigint").alias("size"))
    targets = mixing.source_targets(sized, 1.5, 2.0, mixing.CYCLE)
    assert "ExistingRDD" not in targets._jdf.queryExecution().toString()
    assert targets.schema.simpleString() == "struct<source:string,source_size:bigint,weight:double,target:double>"
    assert [(r.source, r.source_size) for r in targets.collect()] == [("s", 18), (None, 12)]
    assert mixing.source_targets(sized.limit(0), 1.5, 2.0, mixing.CYCLE).count() == 0


def test_rows_without_partner_are_filtered_and_none_with_one_is_lost(spark):
    importable_by_tasks(spark)
    rows = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("text"), F.lit(1).alias("_id"))
    wanted = rows.where("k is null or k % 50 = 0").select(F.col("k").alias("w"))
    got = [r.k for r in likely_in(rows, "k", wanted, "w").collect()]
    assert {None, *range(50, 5000, 50)} <= set(got) and len(got) < 1000
    assert likely_in(rows, "k", wanted.limit(0), "w").count() == 0 and likely_in(rows, "k", wanted, "w").columns == rows.columns


def test_linked_roots_equal_pair_by_pair_search():
    rng, bounds = np.random.default_rng(3), jaccard_join.fewest_matches(0.8, 1e-6)
    sizes = np.array([1, 2, 7, 40, 1, 25])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    base = rng.integers(0, 1 << 16, (4, jaccard_join.VALUES), dtype=np.uint16)
    values = base[rng.integers(0, 4, sizes.sum())]
    flips = rng.random(values.shape) < rng.uniform(0, 0.25, (len(values), 1))
    values = np.where(flips, rng.integers(0, 1 << 16, values.shape, dtype=np.uint16), values)
    got = jaccard_join.linked_roots(starts, sizes, values, bounds)
    alike = lambda a, b: all((values[a, :n] == values[b, :n]).sum() >= m for n, m in bounds)
    for first, size in zip(starts, sizes, strict=True):
        parts = {i: {i} for i in range(first, first + size)}
        for a in parts:
            for b in parts:
                if a < b and alike(a, b):
                    both = parts[a] | parts[b]
                    for i in both:
                        parts[i] = both
        assert {frozenset(p) for p in parts.values()} == {
            frozenset(i for i in parts if got[i] == r) for r in set(got[first : first + size])
        }
