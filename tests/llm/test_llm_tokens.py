"""Conversation repair, token alignment and BPE against brute-force versions,
on small tables with nulls, ties, repeated rows, long texts and extra columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

SPACE = " \t\n\x0b\x0c\r"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdehinorst", k=rng.randint(1, 9))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(9)
    out = [words(rng, rng.randint(1, 80)) for _ in range(30)]
    out += ["", None, " ", "\n\n", "same text", "same text", "Ünï çödé naïve ČŽ", "中文字符 한국어 日本語", "don't STOP 1234!!",
            "a<|endoftext|>b <|startoftext|>", "<unk> <s> </s> ▁ <0x41>", "x" * 5000, "ab" * 3000, "́é İΣς 👩‍👩‍👧 ﬁ ²",
            "tab\tand\r\nlines　wide\xa0space  two", "\x00\x01", words(rng, 4000), "!?!?" * 40, "́" * 50]
    return [(i, t, "en", 1, 2, 3, 4) for i, t in enumerate(out)] + [(4, "another text under id 4", "en", 1, 2, 3, 4), (None, "null id", "en", 1, 2, 3, 4)]


SCHEMA = "doc_id long, text string, lang string, block long, pair long, ids long, part long"


@pytest.fixture(scope="module")
def docs(spark, rows):
    from attrition.llm.common import find_modules
    return find_modules(spark).createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- BPE ---------------------------------------------------------------------
@pytest.fixture(scope="module")
def word_path():
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


def test_bpe_equals_the_tokenizer(docs, empty, rows, word_path):
    from tokenizers import Tokenizer
    from attrition.llm import rank_bpe as B
    tok = Tokenizer.from_file(word_path)
    want = Counter()
    for r in rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want[r[0], len(ids), sha(" ".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += 1
    assert Counter(map(tuple, B.digests(docs, word_path).collect())) == want
    assert B.digests(empty, word_path).count() == 0 == B.decode(B.encode(empty, word_path), word_path).count()
    coded = B.encode(docs, word_path)
    texts = Counter((r[0], tok.decode(tok.encode(r[1] or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in rows)
    assert Counter(map(tuple, B.decode(coded, word_path).collect())) == texts


def test_bpe_on_random_text(word_path):
    from tokenizers import Tokenizer
    from attrition.llm.rank_bpe import Codec
    tok, codec, rng = Tokenizer.from_file(word_path), Codec(word_path), random.Random(3)
    bits = ["a", "e", "th", "ing", "'s", "'", "’", "1", "é", "É", "İ", "ß", "Σ", "ǅ", "中", "한", "́", "̈", "ᄀ", "ᅡ", " ", "  ",
            "\t", "\n", " ", "​", "\xa0", "😀", "<|endoftext|>", "<|", "|>", "<|ENDOFTEXT|>", ".", "!!", "٣", "Ⅷ", "²", "ﬁ", "\x00"]
    for k in range(4000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        ids = tok.encode(text, add_special_tokens=False).ids
        mine = np.frombuffer(codec.encode(text), np.uint32)
        assert mine.tolist() == ids and codec.decode(mine) == tok.decode(ids, skip_special_tokens=False), text


def test_scan_and_heap_merge_alike(word_path):
    from attrition.llm.rank_bpe import Codec, merge_heap, merge_scan
    codec, rng = Codec(word_path), random.Random(5)
    for k in range(400):
        data = "".join(rng.choices("abeinst", k=rng.randint(1, 150))).encode()
        parts = [codec.first[b] for b in data[:-1]] + [codec.last[data[-1]]]
        assert merge_scan(list(parts), codec.rank, codec.merged) == merge_heap(list(parts), codec.rank, codec.merged)
    assert codec.decode(np.array([-1, 10 ** 6], np.int64)) == ""


def test_decode_of_null_and_unknown_ids(spark, word_path):
    from attrition.llm import rank_bpe as B
    got = B.decode(spark.createDataFrame([(1, None), (2, []), (3, [-5, 320, None, 999999])], "doc_id long, ids array<int>"), word_path)
    from tokenizers import Tokenizer
    assert dict(map(tuple, got.collect())) == {1: None, 2: "", 3: Tokenizer.from_file(word_path).id_to_token(320)}


# --- alignment ---------------------------------------------------------------
@pytest.fixture(scope="module")
def sides():
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(rows, sides):
    """Per row (doc_id, list of groups), by walking both token lists."""
    from attrition.llm.token_alignment import Side
    a, b = Side(sides[0]), Side(sides[1])
    out = []
    for r in rows:
        text, groups = r[1], []
        if text:
            x, y = a.model.encode(" " + text, add_special_tokens=False).ids, b.model.encode(text)
            if a.joined(x) == b.joined(y) == (" " + text).encode():
                i = j = 0
                while i < len(x):
                    ga, gb, n, m = [x[i]], [y[j]], len(a.bytes[x[i]]), len(b.bytes[y[j]])
                    i, j = i + 1, j + 1
                    while n != m:
                        if n < m:
                            ga.append(x[i]); n += len(a.bytes[x[i]]); i += 1
                        else:
                            gb.append(y[j]); m += len(b.bytes[y[j]]); j += 1
                    groups.append((ga, gb))
        out.append((r[0], groups))
    return out


def test_alignment(docs, empty, rows, sides):
    from attrition.llm import token_alignment as T
    truth = brute_alignment(rows, sides)
    held = Counter()
    for _, groups in truth:
        held.update({(p, q) for ga, gb in groups for p in ga for q in gb})
    most = defaultdict(int)
    for (p, q), n in held.items():
        most[p] = max(most[p], n)
    want = Counter()
    for doc, groups in truth:
        links = [(p, q) for ga, gb in groups for p in ga for q in gb]
        text = ";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb in groups)
        want[doc, sum(len(g[0]) for g in groups), sum(len(g[1]) for g in groups), len(groups), len(links),
             sum(held[x] == most[x[0]] for x in links), sum(held[x] for x in links), sha(text) if groups else ""] += 1
    got = T.align(docs, *sides)
    assert Counter(tuple(r)[:8] for r in got.collect()) == want
    assert T.align(empty, *sides).count() == 0
    assert sum(len(g) > 0 for _, g in truth) > 40


def test_overlaps(spark, rows, sides):
    from attrition.llm import token_alignment as T
    from attrition.llm.common import find_modules
    some = [r for r in rows if r[0] not in (4, None)]
    got = defaultdict(set)
    for r in T.overlap_rows(find_modules(spark).createDataFrame(some, SCHEMA), *sides).collect():
        got[r["doc_id"]].add((r["a_token"], r["b_token"], r["a_id"], r["b_id"], r["start"], r["end"], r["group"]))
    a, b = T.Side(sides[0]), T.Side(sides[1])
    for doc, groups in brute_alignment(some, sides):
        want, at, i, j = set(), 0, 0, 0
        for g, (ga, gb) in enumerate(groups):
            x = [(i + k, t, at + sum(len(a.bytes[u]) for u in ga[:k]), len(a.bytes[t])) for k, t in enumerate(ga)]
            y = [(j + k, t, at + sum(len(b.bytes[u]) for u in gb[:k]), len(b.bytes[t])) for k, t in enumerate(gb)]
            for (p, ta, s, n), (q, tb, u, m) in itertools.product(x, y):
                if max(s, u) < min(s + n, u + m):
                    want.add((p, q, ta, tb, max(s, u), min(s + n, u + m), g))
            at, i, j = at + sum(len(a.bytes[u]) for u in ga), i + len(ga), j + len(gb)
        assert got[doc] == want, doc


def test_quick_library_gives_the_same_ids(sides):
    from attrition.llm.token_alignment import Side
    a, rng = Side(sides[0]), random.Random(8)
    assert a.fast is not None
    bits = ["a", "the", "'s", "'S", "'re", "é", "Ɏ", "ß", "1", "²", "½", "ª", "\xa0", "\x85", "\xad", "\x1c", "\x1f", " ", "  ", "\n", "\r\n",
            "\t", "\x0b", "\x0c", "...", "!?", "<|endoftext|>", "_", "\x00", "\x7f", "Ā", "ǅ"]
    for _ in range(3000):
        text = "".join(rng.choices(bits, k=rng.randint(0, 30)))
        assert a.encode([text])[0] == a.model.encode(" " + text, add_special_tokens=False).ids, text


# --- conversations -----------------------------------------------------------
def least_edits(rows):
    """(cost, audit, lines) by trying all sequences of edits, cheapest first,
    then by audit; the pattern is checked by a regular expression on what was
    made so far."""
    prefix = re.compile(r"(s?(ua)*u?)?")
    wanted = re.compile(r"(s?(ua)+)?")
    layer = {(0, ""): (0, "", ())}       # rows used, kind of the roles so far: least (cost, audit, lines)

    def kind(roles):                     # roles with the same end go on alike
        return roles if len(roles) < 3 else "..." + roles[-1]

    import heapq
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, roles, lines = heapq.heappop(heap)
        if (i, kind(roles)) in done:
            continue
        done.add((i, kind(roles)))
        if i == len(rows) and wanted.fullmatch(roles):
            return cost, audit, lines
        todo = [("I", 5, i, r, (t + ":",)) for r, t in (("u", "user"), ("a", "assistant"))]
        if i < len(rows):
            role, text, fault = rows[i]
            todo.append(("D", 2, i + 1, "", ()))
            if fault not in ("blank", "duplicate"):
                more = 5 if fault == "truncated" else 0
                todo.append(("K", more, i + 1, role[:1] or "?", (f"{role}:{text}",)))
                todo += [("R", 1 + more, i + 1, t[0], (f"{t}:{text}",)) for t in ("user", "assistant")]
        for letter, c, j, r, more in todo:
            if prefix.fullmatch(roles + r):
                heapq.heappush(heap, (cost + c, audit + letter, j, roles + r, lines + more))


def brute_repair(table):
    convs = defaultdict(list)
    for conv, turn, role, text, *_ in table:
        convs[conv]
        hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        convs[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    out = {}
    for conv, rows in convs.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()))
        seen, marked = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            fault = ("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
            marked.append((role, text, fault))
        turns = [t for t, _, _ in rows if t is not None]
        count = Counter(f for _, _, f in marked)
        illegal = sum(x[0][:1] + y[0][:1] not in ("su", "ua", "au") for x, y in zip(marked, marked[1:]))
        cost, audit, lines = least_edits(marked)
        out[conv] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"],
                     count["truncated"], illegal, cost, audit, sha("\n".join(lines)))
    return out


@pytest.fixture(scope="module")
def talk():
    rng = random.Random(12)
    texts = ["Yes.", "No", "Why?", " ", "", None, "A longer answer, with words!", "Say more.  \n", "and then", "é…"]
    roles = ["user", "assistant", "system", "tool", None, "", "User"]
    out = []
    for conv in range(150):
        turns = rng.sample(range(12), rng.randint(1, 9))
        for k, t in enumerate(sorted(turns)):
            role = rng.choice(roles) if rng.random() < 0.3 else ("user", "assistant")[k % 2]
            out.append((conv, t, role, rng.choice(texts) if rng.random() < 0.6 else f"Words {conv} {t}."))
    out += [(7, None, "user", "no turn."), (7, None, "system", "no turn."), (8, 3, "user", "tie."), (8, 3, "assistant", "tie."),
            (None, 1, "user", "no id."), (None, None, None, None), (9, None, "user", "only.")] + [(10, 2, "user", "again.")] * 5
    gone = next(c for c in range(1000, 2000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    out.append((gone, 0, "user", "dropped."))
    out += [(500, t, ("user", "assistant")[rng.random() < 0.5], f"Turn {rng.randrange(60)}" + rng.choice([".", ""])) for t in range(300)]
    return [(*r, 1, 2, "x") for r in out]


TALK = "conv_id long, turn long, role string, text string, part long, no long, whole string"
FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("rows_in_segment", [4096, 7])
def test_conversation_repair(spark, talk, monkeypatch, rows_in_segment):
    from attrition.llm import conversation_repair as C
    from attrition.llm.common import find_modules
    monkeypatch.setattr(C, "SEGMENT_ROWS", rows_in_segment)
    got = C.repair(find_modules(spark).createDataFrame(talk, TALK).repartition(5)).collect()
    want = brute_repair(talk)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r[f] for f in FIGURES) == want[r["conv_id"]], r["conv_id"]


def test_segments_chain_to_the_whole(spark, talk, monkeypatch):
    """Whatever the size of the segments, a long conversation has one answer."""
    from attrition.llm import conversation_repair as C
    rng = random.Random(1)
    for _ in range(60):
        codes = bytes(rng.choice([0, 1, 2, 3]) | rng.choice([0, 0, 0, 4, 8]) for _ in range(rng.randint(0, 40)))
        segs = [C.Segment(k) for k in range(0, max(1, -(-len(codes) // 6)))]
        for k, s in enumerate(segs):
            s.codes = bytearray(codes[6 * k:6 * k + 6])
        import pyarrow as pa
        brief = pa.Table.from_pylist([s.record(1, 0, False) for s in segs], C.arrow(C.SEGMENT))
        route = C.chain(brief).to_pylist()
        audit = "".join(C.solve(bytes(s.codes), r["entry"], (r["leave"],), False)[1] + r["tail"] for s, r in zip(segs, route))
        assert (route[0]["cost"], audit) == C.solve(codes)


def test_empty_conversations(spark):
    from attrition.llm import conversation_repair as C
    assert C.repair(spark.createDataFrame([], TALK)).count() == 0


# --- repairs of the earlier operators ----------------------------------------
def test_a_text_stays_whose_id_also_has_a_copy(spark):
    """Near duplicates go by row, not by id; an extra column keeps its values."""
    import corpus_pipeline as P
    from attrition.llm.common import find_modules
    rng = random.Random(3)
    a, b, c = words(rng, 60), words(rng, 60), words(rng, 60)
    rows = [(1, a, 11, "p"), (2, a, 12, "q"), (2, b, 13, "r"), (2, b, 14, "s"), (3, None, 15, "t"), (4, c, 16, "u"), (None, c, 17, "v"),
            (None, b + " end", 18, "w"), (5, "", 19, "x"), (5, " ", 20, "y")]
    docs = find_modules(spark).createDataFrame(rows, "doc_id long, text string, _node long, key string")
    got = [(r["doc_id"], r["text"]) for r in P.near_duplicate_stage(spark, docs, "").collect()]
    assert Counter(t for _, t in got if t and t.strip()) == Counter({a: 1, c: 1, b + " end": 1})
    assert (1, a) in got and (None, c) in got and (3, None) in got and sum(d == 5 for d, _ in got) == 1
    kept = {r["_node"]: r["key"] for r in P.near_duplicate_stage(spark, docs, "").collect()}
    assert all((n, k) in {(r[2], r[3]) for r in rows} for n, k in kept.items())
    # an unrelated text under an id that is elsewhere a copy is not lost
    rows = [(1, a, 1, "p"), (2, a, 2, "q"), (2, b, 3, "r"), (3, None, 4, "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _node long, key string")
    got = {(r["doc_id"], r["text"], r["_node"]) for r in P.near_duplicate_stage(spark, docs, "").collect()}
    assert got == {(1, a, 1), (2, b, 3), (3, None, 4)}


def test_benchmark_item_without_an_id(spark):
    from attrition.llm import decontaminate as D
    from attrition.llm.common import find_modules
    rng = random.Random(6)
    item = words(rng, 25)
    bench = spark.createDataFrame([(None, item), (None, None), (3, "")], "item_id long, text string")
    docs = find_modules(spark).createDataFrame([(1, "before " + item + " after"), (2, words(rng, 30))], "doc_id long, text string")
    assert [(r["doc_id"], r["item_id"]) for r in D.find(docs, bench).collect()] == [(1, None)]
    assert [r["doc_id"] for r in D.clean(docs, bench).collect()] == [2]
