"""The ten operators and the pipeline against brute-force versions, on small
tables with nulls, empty and long texts, repeated rows and extra columns."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

os.environ.setdefault("PYSPARK_PIN_THREAD", "true")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, slot long, node long, key long, block long"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    out = [words(rng, rng.randint(1, 160)) for _ in range(40)]
    base = words(rng, 200)
    for k in range(12):     # copies with some words changed
        w = base.split(" ")
        for _ in range(k):
            w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    passage = words(rng, 90)
    out += [words(rng, 30) + " " + passage + "\n" + words(rng, 20) for _ in range(6)]
    out += [base, base, "", None, " \n ", "one", "two words", "x " * 300, words(rng, 6000), "Ünï çödé " * 70, passage[:420] * 2]
    return [(i, t, "en", "s", len(t) if t else 0, 1, 2, 3, 4) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    from attrition.llm.common import find_modules
    return find_modules(spark).createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def raw(rows):
    return [(r[0], (r[1] or "").encode()) for r in rows]


def test_sharding(spark, docs, empty, rows, tmp_path):
    from attrition.llm import sharding as S
    d = S.digest(docs.union(docs.limit(1)))
    size, count = S.slot_bytes(d)
    first = S.SlotMap.first(S.N_SLOTS, 8)
    S.store(spark, str(tmp_path), first)
    S.store(spark, str(tmp_path), S.rebalance(first, size))
    slots = S.load(spark, str(tmp_path))
    assert slots.version == 2 and (S.load(spark, str(tmp_path), 1).shard == first.shard).all()
    got = S.assign(d, slots, count).collect()
    assert len(got) == len(rows) + 1
    for s in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))
    text = {i: t for i, t in raw(rows)}
    assert all(r["size"] == len(text[r["doc_id"]]) + 1 and r["text_crc32"] == zlib.crc32(text[r["doc_id"]]) for r in got)
    grown = S.grow(slots, size)
    moved = grown.shard != slots.shard
    assert moved.any() and (grown.shard[moved] == 8).all()
    assert S.digest(empty).count() == 0


def test_rebalanced_bytes_are_near_equal():
    from attrition.llm import sharding as S
    weight = np.random.default_rng(0).pareto(1.5, 4096) * 1000 // 1
    load = S.rebalance(S.SlotMap.first(4096, 8), weight).loads(weight)
    assert load.max() - load.min() <= max(2, weight.max() / 100)


def test_induced_sort_finds_all_repeats():
    from attrition.llm.induced_sort import repeated
    rng = np.random.default_rng(1)
    for trial in range(60):
        length, letters = int(rng.integers(2, 12)), int(rng.integers(1, 5))
        parts = [bytes(rng.integers(97, 97 + letters, int(rng.integers(0, 60))).astype(np.uint8)) for _ in range(int(rng.integers(1, 6)))]
        seen = Counter(p[i:i + length] for p in parts for i in range(len(p) - length + 1))
        want = [[seen[p[i:i + length]] > 1 for i in range(len(p) - length + 1)] for p in parts]
        assert [x.tolist() for x in repeated(parts, length, 200 if trial % 2 else 1 << 20)] == want


def test_suffix_array_dedup(docs, empty, rows):
    from attrition.llm import suffix_dedup as D
    texts, seen = raw(rows), Counter()
    for _, t in texts:
        seen.update(t[i:i + 400] for i in range(len(t) - 399))
    want = {}
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone[k:k + 400] = True
        kept = np.frombuffer(t, np.uint8)[~gone].tobytes()
        want[i] = (len(t), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in D.deduplicate(docs).collect()}
    assert got == want and sum(w[1] for w in want.values()) > 1000
    assert D.deduplicate(empty).count() == 0


def test_suffix_array_core_of_many_segments(spark):
    from attrition.llm import suffix_dedup as D
    from attrition.llm.common import find_modules
    many = 3000     # distinct segments of one core
    ones = np.ones(many, np.uint64)
    out = D.judge(np.arange(many), ones, np.arange(many, dtype=np.uint64), ones.astype(np.uint32), np.zeros(many, np.uint8))
    assert not (out & D.SORT).any() and (out == D.DEAL).all()       # no shard takes them all
    rng = random.Random(11)
    passage = words(rng, 100)[:330]
    texts = [words(rng, 40) + passage + words(rng, 40) for _ in range(60)]
    # with the passage, windows that two documents have and segments that differ
    texts += [words(rng, 25) + texts[k][-390 - 30 * k:] for k in range(8)] + [texts[k][:400 + 20 * k] + words(rng, 25) for k in range(8)]
    texts += [texts[9], texts[9], None, passage]
    df = find_modules(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    raws, seen = [(t or "").encode() for t in texts], Counter()
    for t in raws:
        seen.update(t[i:i + 400] for i in range(len(t) - 399))
    want = {}
    for i, t in enumerate(raws):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 399):
            if seen[t[k:k + 400]] > 1:
                gone[k:k + 400] = True
        want[i] = (int(gone.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest())
    assert sum(w[0] for w in want.values()) > 5000
    for most in (1 << 20, 1 << 12, 0):      # none, some and all cores dealt by windows
        got = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in D.deduplicate(df, shard_bytes=most).collect()}
        assert got == want


def test_difference_cover_dedup(docs, empty, rows):
    from attrition.llm import substring_dedup as D
    assert all(any((i + s) % D.PERIOD in D.COVER and (j + s) % D.PERIOD in D.COVER for s in range(D.PERIOD))
               for i in range(D.PERIOD) for j in range(D.PERIOD))
    seen, want = set(), {}
    for i, t in raw(rows):
        w = WORD.findall(t)
        gone = [False] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k:k + 20]) in seen:
                gone[k:k + 20] = [True] * 20
            seen.add(tuple(w[k:k + 20]))
        want[i] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest())
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in D.deduplicate(docs).collect()}
    assert got == want
    assert D.deduplicate(empty).count() == 0


def test_licenses(spark, empty):
    from attrition.llm import licenses as L
    texts = ["Licensed under the Apache License, Version 2.0.", "the MIT  License and the mit license", None, "",
             "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "mit lizenz"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in L.scan(df).collect()}
    assert [got[i]["labels"] for i in range(7)] == ["apache,apache-2.0", "mit", "", "", "gpl,gpl-3", "cc-by-nc-4.0", ""]
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["n_words"]) == (2, 1, 5, 7)
    assert got[2]["first_word"] is None and got[2]["score"] == 0
    assert len(L.rules()) > 300 and L.scan(empty).count() == 0


def test_simhash(docs, empty, rows):
    from attrition.llm import simhash as H
    got = {r["doc_id"]: r for r in H.fingerprinted(docs).collect()}
    texts = [r[1] or "" for r in rows]
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        half, after = len(t) // 2, texts[(i + 1) % len(texts)]
        new = t[:len(t) - half] + after[:half]
        a, b, c = (x.tobytes() for x in H.fingerprints([x.encode() for x in (t, new, after)]))
        bits = lambda x, y: 1 - (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_count() / 128
        r = got[i]
        assert (r["n_chars"], r["edited_sha256"]) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert (r["fingerprint"], r["edited_fingerprint"]) == (a.hex(), b.hex())
        assert abs(r["near_edited"] - bits(a, b)) < 1e-9 and abs(r["near_next"] - bits(a, c)) < 1e-9
    assert H.fingerprinted(empty).count() == 0


def test_simhash_tables_find_all(spark):
    from attrition.llm import simhash as H
    rng = random.Random(2)
    marks = [rng.getrandbits(128) for _ in range(60)]
    marks += [m ^ sum(1 << b for b in rng.sample(range(128), k)) for m in marks[:20] for k in (1, 2, 3, 4)]
    rows = {((m >> 64) - (1 << 64) * (m >> 127), (m & (2**64 - 1)) - (1 << 64) * (m >> 63 & 1)): m for m in marks}
    df = spark.createDataFrame(list(rows), "hi long, lo long")
    got = {((r[0], r[1]), (r[2], r[3])) for r in H.within(df, df).collect()}
    assert got == {(a, b) for a, x in rows.items() for b, y in rows.items() if (x ^ y).bit_count() <= 3}


def test_simhash_near_counts_find_edited_texts(spark):
    from pyspark.sql import functions as F
    from attrition.llm import simhash as H
    from attrition.llm.common import find_modules
    rng, texts, likeness = random.Random(12), [], {}
    shingles = lambda w: {tuple(w[k:k + 5]) for k in range(len(w) - 4)}
    for i in range(60):     # each text and a copy with some words changed, from 0.8 to 1 similar
        w = words(rng, 300).split(" ")
        c = list(w)
        while True:
            c[rng.randrange(300)] = "changed"
            a, b = shingles(w), shingles(c)
            if len(a & b) / len(a | b) < 0.8 + 0.2 * (i % 6) / 6:
                break
            copy, likeness[i] = " ".join(c), len(a & b) / len(a | b)
        texts += [" ".join(w), copy if i in likeness else " ".join(w)]
    texts += [texts[0], "", None]
    df = find_modules(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = H.fingerprinted(df).select("doc_id", "fingerprint").cache()
    marks = {r["doc_id"]: int(r["fingerprint"], 16) for r in found.collect()}
    near = {int(r["fingerprint"], 16): r["n_near"] for r in H.near_counts(found, F.col("doc_id") % 2 == 0).collect()}
    for i in range(0, len(texts), 2):       # as by brute force
        assert near[marks[i]] == sum((marks[i] ^ m).bit_count() <= H.NEAR_RADIUS for m in marks.values()) - 1
    assert min(likeness.values()) >= 0.8
    assert sum(near[marks[2 * i]] > 0 for i in likeness) >= 0.97 * len(likeness)


def test_decontamination(spark, docs, empty, rows):
    from attrition.llm import decontaminate as D
    rng = random.Random(5)
    items = [words(rng, n) for n in (14, 20, 40, 70)] + [None, "", "short"]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    def edit(s):
        c = list(s)
        for _ in range(len(s) // 25):
            c[rng.randrange(len(c))] = "q"
        return "".join(c)
    planted = [(1000 + i, f"{words(rng, 20)} {edit(items[i % 4]).upper()}  {words(rng, 9)}") for i in range(12)]
    both = docs.select("doc_id", "text").union(spark.createDataFrame(planted, "doc_id long, text string"))
    assert {(r["doc_id"], r["item_id"]) for r in D.find(both, bench).collect()} == {(1000 + i, i % 4) for i in range(12)}
    assert sorted(r["doc_id"] for r in D.clean(both, bench).collect()) == [r[0] for r in rows]
    assert D.find(empty, bench).count() == 0 and D.find(docs, bench.limit(0)).count() == 0


def test_packing(docs, empty, rows):
    import public_tokenizers
    from tokenizers import Tokenizer
    from attrition.llm import packing as K
    path = public_tokenizers.path("word_bpe_49k.json")
    plain, got = Tokenizer.from_file(path), {}
    places = {}
    for r in K.pack(docs, path, with_ids=True).collect():
        got.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, text, *_ in rows:
        want = plain.encode(text or "", add_special_tokens=False).ids + [1]
        assert [x for _, ids in sorted(got[i]) for x in ids] == want
    for members in places.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 2048
    assert K.pack(empty, path).count() == 0


def test_differencing():
    from attrition.llm import packing as K
    sizes = random.Random(3).choices(range(1, 500), k=300)
    for n in (1, 2, 7, 40):
        filled = K.difference(sizes, n)
        assert sorted(i for _, m in filled for i in m) == list(range(300))
        assert all(s == sum(sizes[i] for i in m) for s, m in filled)
        sums = [s for s, _ in filled]
        assert max(sums) - min(sums) <= 60
    assert K.windows_of([]) == [] and K.windows_of([2048, 2048]) == [[0], [1]]


def test_near_duplicates(docs, empty, rows):
    from attrition.llm import hyperminhash as H
    sets = {}
    for i, t in raw(rows):
        w = [x.lower() for x in WORD.findall(t)]
        sets[i] = {tuple(w[k:k + 4]) for k in range(len(w) - 3)} or ({tuple(w)} if w else set())
    root = {i: i for i in sets}
    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r["node"]: (r["n_shingles"], r["component"]) for r in H.near_duplicates(docs, 4).collect()}
    assert got == {i: (len(s), find(i)) for i, s in sets.items()}
    assert H.near_duplicates(empty, 4).count() == 0
    cut = H.near_duplicates(docs, 4, slice_rows=2, slice_bytes=4096)        # every bucket in several slices
    assert {r["node"]: (r["n_shingles"], r["component"]) for r in cut.collect()} == got


def test_slices_meet_for_every_pair(spark):
    from attrition.llm import hyperminhash as H
    held = [(k, n, n % 7 if n % 3 else 0, 5) for k in (1, 2) for n in range(40 * k)] + [(3, 1, 1, 5), (3, 2, 2, 5)]
    df = spark.createDataFrame(held, "key long, node long, component long, n_shingles long")
    for rows, most in ((4096, 80), (9, 40)):
        groups = {}
        for r in H.sliced(df, rows, 1 << 20).collect():
            groups.setdefault((r["key"], r["i"], r["j"]), []).append(r)
        met = {(k, frozenset((a["node"], b["node"]))) for (k, _, _), g in groups.items() for a in g for b in g
               if a["asks"] and b["answers"] and a["component"] != b["component"]}
        assert met == {(a[0], frozenset((a[1], b[1]))) for a in held for b in held if a[0] == b[0] and a[2] != b[2]}
        assert max(map(len, groups.values())) <= most
        assert rows < 4096 or sum(map(len, groups.values())) == len(held)


def test_pii(spark, empty):
    from attrition.llm import pii as P
    texts = ["mail a.b@c.example.org now, host 10.0.0.1 (or 300.1.1.1)", "card 4111 1111 1111 1111 and +1 (555) 010-9999 ok",
             "ring +1 (269) 555-3296 4524132264652876 x", None, "", "no data here"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_chars long")
    got = {r["doc_id"]: r for r in P.detect(df).collect()}
    assert got[0]["spans"].split(",")[:2] == ["email:5:22", "ip:33:41"] and got[0]["n_ip"] == 1
    assert (got[1]["n_card"], got[1]["n_phone"]) == (1, 1)
    assert (got[2]["n_card"], got[2]["n_phone"], got[2]["n_added"]) == (0, 0, 2)
    assert got[3]["spans"] == got[4]["spans"] == got[5]["spans"] == ""
    base = ",".join(f"{k}:{s}:{e}" for k, s, e in P.base_spans(texts[0]))
    assert got[0]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
    masked = [r["text"] for r in P.mask(df).orderBy("doc_id").collect()]
    assert masked[0].startswith("mail [EMAIL] now, host [IP]") and masked[3] is None and masked[5] == texts[5]
    assert P.detect(empty).count() == 0 and P.mask(empty).count() == 0


def test_base_spans_are_the_patterns_matches():
    from attrition.llm import pii as P
    rng = random.Random(6)
    for _ in range(3000):
        text = "".join(rng.choices("a1@._-9 +", [4, 4, 4, 6, 1, 1, 2, 1, 1], k=rng.randint(0, 40)))
        assert list(P.emails(text)) == [m.span() for m in P.BASE["email"].finditer(text)], text
        assert [m.span() for m in P.WHOLE_IP.finditer(text)] == [m.span() for m in P.BASE["ip"].finditer(text)], text
    long = "a1" * 400_000 + " a@b.c " + "7" * 400_000 + "@"     # one long word, one long number
    assert P.base_spans(long) == [("email", 800_001, 800_006)]


def test_viterbi_is_best():
    from attrition.llm.pii import viterbi
    rng = np.random.default_rng(0)
    for _ in range(10):
        n = rng.integers(0, 7, 5)
        offsets = np.concatenate([[0], np.cumsum(n)])
        emit, move = rng.normal(size=(offsets[-1], 3)).astype(np.float32), rng.normal(size=(3, 3)).astype(np.float32)
        got = viterbi(emit, offsets, move)
        for a, b in zip(offsets, offsets[1:]):
            score = lambda p, a=a: sum(emit[a + i, x] for i, x in enumerate(p)) + sum(move[x, y] for x, y in zip(p, p[1:]))
            every = np.stack(np.meshgrid(*[range(3)] * (b - a), indexing="ij"), -1).reshape(-1, b - a) if b > a else []
            assert b == a or abs(score(got[a:b]) - max(score(p) for p in every)) < 1e-4


def test_quality(spark, empty):
    from attrition.llm import quality as Q
    rng = random.Random(6)
    texts = [" ".join(w + ("***" if i % 3 == 0 else "") for w in words(rng, 60).split(" ")) for i in range(400)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0)) for i in range(400)] + [(5000, 1), (None, 0)], "doc_id long, quality int")
    net = Q.train(spark, docs, labels)
    got = {r["doc_id"]: r["score"] for r in Q.score(docs, net).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= 0.5) == (i % 3 != 0) for i in held]) > 0.95
    assert got[900] == got[901]
    assert {r["doc_id"] for r in Q.keep_good(docs, net).collect()} == {i for i, s in got.items() if s >= 0.5}
    assert Q.score(empty, net).count() == 0
    assert 0 <= Q.train(spark, docs, labels.limit(0)).score(np.zeros(0, np.uint8), np.array([0, 0]))[0] <= 1


def test_pipeline(spark):
    import corpus_pipeline as C
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept, columns = {r["doc_id"] for r in docs.select("doc_id").collect()}, docs.columns
    for name, stage in C.STAGES[:-1]:
        from attrition.session import materialize
        docs = materialize(stage(spark, docs, sf), name)
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns == columns and now <= kept and len(now) > 0.5 * len(kept)
        kept = now
    packed = C.STAGES[-1][1](spark, docs, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == kept
