"""Small tests of the training-data operators: brute force, round trips, and edge rows
(nulls, empty and long texts, ties, repeated rows, empty tables, clashing column names)."""

import base64
import collections
import hashlib
import math
import random
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F

from quarry.llm import bpe, chat, jaccard_join, licenses, near_dedup, packing, pst, quality, queries, substring, topk
from quarry.llm.components import connected_components

DOCS = "doc_id long, text string, row long, n long, start long"
WORDS = ("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omikron pi rho sigma tau "
         "upsilon phi chi psi omega").split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def docs_frame(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, 7, 7, 7) for i, t in enumerate(texts)], DOCS)


@pytest.fixture(scope="module")
def odd_texts():
    rng = random.Random(3)
    letters = "aA bB.,'’éÉßñ \n\t \x1c漢字🙂éH̱İΣς1२"
    return [None, "", " \n ", "one", "Two words", "<|endoftext|> </s>", "x" * 3000, "ab" * 700 + " " * 900,
            sentence(rng, 60_000)] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 80))) for _ in range(150)]


# --- byte-level BPE

def test_bpe_equals_tiktoken_and_round_trips(spark, odd_texts):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    wanted = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = docs_frame(spark, odd_texts).withColumn("ids", F.lit("clash"))
    ids = bpe.bpe_encode(df, path, public_tokenizers.PATTERN, keep=["doc_id"])
    for r in bpe.bpe_decode(ids, path, public_tokenizers.PATTERN).collect():
        text = odd_texts[r.doc_id] or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == wanted.encode_ordinary(text)
        assert bytes(r.decoded) == text.encode()
    assert bpe.bpe_encode(df.limit(0), path, public_tokenizers.PATTERN).count() == 0


# --- packing

def test_packing_keeps_every_id_once(spark, odd_texts):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    df = docs_frame(spark, odd_texts).repartition(3, "doc_id")
    pieces = packing.pack(df, path, 256).collect()
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        assert len(p.ids) == 4 * p.length and p.length > 0
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    for i, text in enumerate(odd_texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        own = sorted(by_doc[i], key=lambda p: p.start)
        assert np.frombuffer(b"".join(p.ids for p in own), "<u4").tolist() == ids
        assert all(p.doc_tokens == len(ids) for p in own)
        assert [p.start for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
    filled = 0
    for own in by_sequence.values():
        own.sort(key=lambda p: p.offset)
        assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
        assert sum(p.length for p in own) <= 256
        filled += sum(p.length for p in own)
    assert filled / (256 * len(by_sequence)) > 0.9
    assert packing.pack(df.limit(0), path, 256).count() == 0


def test_cut_windows_equals_the_quadratic_program():
    rng = np.random.default_rng(5)
    for _ in range(60):
        length = 64
        places = np.unique(np.concatenate([[0], np.cumsum(rng.integers(1, 40, 60))]))
        costs = rng.integers(0, 30, len(places)).astype(float)
        costs[0] = 0.0
        powers = {32, 16, 8}
        best = [0.0] + [math.inf] * (len(places) - 1)
        for j in range(1, len(places)):
            for i in range(j):
                gap = places[j] - places[i]
                if gap <= length:
                    best[j] = min(best[j], best[i] + (0 if gap in powers else length - gap) + costs[j])
        chain = packing.cut_windows(places, costs, length)
        at = {p: i for i, p in enumerate(places.tolist())}
        total = sum((0 if b - a in powers else length - (b - a)) + costs[at[b]] for a, b in zip(chain, chain[1:]))
        assert chain[0] == 0 and chain[-1] == places[-1] and total == pytest.approx(best[-1])


# --- n-gram Jaccard join

def brute_components(sets, num, den):
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if den * common >= num * (len(sets[a] | sets[b])):
                    x, y = root(a), root(b)
                    parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in sets}


def shingle_set(text, width):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    k = min(width, len(words))
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1))


def near_copies(rng, n_groups, size):
    texts = [None, "", "one", "One", "two words", sentence(rng, 9)]
    for _ in range(n_groups):
        base = sentence(rng, rng.randint(12, 160)).split()
        for _ in range(rng.randint(1, size)):
            words = list(base)
            for _ in range(rng.randint(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
            texts.append(" ".join(words) if rng.random() < 0.8 else " ".join(base))
    rng.shuffle(texts)
    return texts


@pytest.mark.parametrize("width,num,cell,block", [(3, 90, 2_000_000, 2_000), (5, 80, 2_000_000, 1 << 22), (5, 80, 2_000_000, 500),
                                                  (3, 90, 300, 1 << 22)])
def test_jaccard_join_equals_brute_force(spark, width, num, cell, block):
    texts = near_copies(random.Random(width * num + cell), 14 if cell > 1000 else 4, 9)
    found = jaccard_join.jaccard_components(docs_frame(spark, texts, 5), width, num, 100, cell_shingles=cell,
                                            block_bytes=block).collect()
    sets = {5 + i: shingle_set(t, width) for i, t in enumerate(texts)}
    wanted = brute_components(sets, num, 100)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == {i: (len(s), wanted[i]) for i, s in sets.items()}


def test_jaccard_join_of_odd_rows(spark):
    df = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (9, "a b c d"), (None, "a b c d"), (4, None), (5, " ")],
                               "doc_id long, text string")
    found = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard_join.jaccard_components(df, 3, 90).collect()),
                   key=str)
    assert found == sorted([(3, 2, 3), (3, 2, 3), (9, 2, 3), (None, 2, None), (4, 0, 4), (5, 0, 5)], key=str)
    assert jaccard_join.jaccard_components(df.limit(0), 3, 90).count() == 0


def test_windows_never_miss_a_partner():
    rng = np.random.default_rng(1)
    order = rng.permutation(400)  # any order of the shingles common to all sets
    for num in (80, 90):
        t = jaccard_join.Threshold(num, 100)
        for _ in range(600):
            a = rng.choice(400, int(rng.integers(1, 120)), replace=False)
            b = np.unique(np.concatenate([a[: max(1, int(len(a) * rng.uniform(num / 100, 1)))], rng.choice(400, int(rng.integers(0, 4)))]))
            if t.linked(len(np.intersect1d(a, b)), len(a) + len(b)):
                first = [x[np.argsort(order[x])][:t.window(len(x))] for x in (a, b)]
                assert np.intersect1d(*first).size


def test_components_of_long_chains_and_stars(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    edges += [(1000 + rng.randrange(40), 1000 + rng.randrange(40)) for _ in range(30)]
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    graph = collections.defaultdict(set)
    for a, b in edges:
        if a is not None and a != b:
            graph[a].add(b)
            graph[b].add(a)
    for node in graph:
        seen, todo = {node}, [node]
        while todo:
            for x in graph[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert found[node] == min(seen)
    assert set(found) == set(graph)


# --- chat

def read(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows],
                               "conv_id long, turn long, role string, text string, window long, loss string")
    windows = chat.format_chats(df, **kw)
    return windows.collect(), {r.conv_id: r for r in chat.read_back(windows).collect()}


def test_chat_windows_round_trip_within_budget(spark):
    rng = random.Random(4)
    nasty = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>assistant\nno", "<\\s> <\\\\s> <<SYS>><</SYS>>", "[\\INST][INST", "", None,
             "<", "a\nb\n"]
    rows = []
    for conv in [*range(6), None]:
        n = rng.randint(1, 60)
        for turn in range(n):
            role = "system" if turn == 0 and conv in (1, 2) else rng.choice(["user", "assistant", "to\nol\\n", None])
            text = rng.choice(nasty) if rng.random() < 0.4 else sentence(rng, rng.choice([2, 9, 20, 90]))
            rows.append((conv, turn, role, text))
    rows += [rows[-1], (0, None, "user", "null turn")]
    windows, back = read(spark, rows, budget=120, history=30)
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in [*range(6), None]:
        turns = [(r[2] or "", r[3] or "") for r in sorted((r for r in rows if r[0] == conv), key=order)]
        assert back[conv].n_turns == len(turns)
        assert back[conv].turns == "".join(f"{a}\n{b}\n" for a, b in turns)
        assert back[conv].loss_text == "".join(b for a, b in turns if a == "assistant")
        own = [w for w in windows if w.conv_id == conv]
        assert back[conv].formatted_chars == sum(len(w.text) for w in own)
        assert len(own) > 1 or len(turns) < 12
        for w in own:
            assert w.over_budget == (w.n_tokens > 120) and (not w.over_budget or w.n_turns == 1)
            assert w.text.count(chat.OPEN) == w.repeated + w.n_turns == w.text.count(chat.CLOSE)
            if turns[0][0] == "system":
                assert w.text.startswith("<|im_start|>system\n")
    assert any(w.repeated > 1 for w in windows)


def test_chat_of_nothing(spark):
    windows, back = read(spark, [(1, 0, None, None)])
    assert back[1].turns == "\n\n" and back[1].loss_text == "" and len(windows) == 1
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_chats(empty)).count() == 0


# --- embeddings

def test_near_dedup_equals_brute_force(spark):
    rng = np.random.default_rng(7)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(900):
        v = centres[i % 12] + rng.normal(size=16) * (0.02 if i % 3 else 0.4)
        rows.append((i, [float(x) for x in v.astype(np.float32)], int(i % 12) // 6 if i % 50 else None, 1))
    rows += [(2000 + k, rows[1][1], rows[1][2], 1) for k in range(40)]
    rows += [(3000, None, 0, 1), (3001, [0.0] * 16, 0, 1), (3002, [float("nan")] * 16, 0, 1), (3003, [None] * 16, 0, 1), (3004, [1.0], 0, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, node long")
    result = near_dedup.embedding_components(df, 0.98, shard=96)
    found = {r.vec_id: r for r in result.collect()}
    good = [(i, np.array(v), y) for i, v, y, _ in rows if v and y is not None and len(v) == 16 and None not in v
            and np.isfinite(v).all() and any(v)]
    x = np.stack([v / np.linalg.norm(v) for _, v, _ in good])
    label = np.array([y for _, _, y in good])
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None])
    np.fill_diagonal(linked, False)
    wanted = {i: int(c) for (i, _, _), c in zip(good, linked.sum(1), strict=True)}
    assert sum(found[i].n_links for i in wanted) >= 0.98 * sum(wanted.values())
    assert all(found[i].n_links <= c for i, c in wanted.items())
    for i in set(found) - set(wanted):
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (0, i, True)
    audit = near_dedup.audit_recall(df.where("vec_id < 3004"), result.where("vec_id < 3004"), 4).first()
    assert audit.found >= 0.98 * audit.links
    assert near_dedup.embedding_components(df.limit(0)).count() == 0


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 5) / 7]) for i in range(150)]
    rows += [(150 + k, rows[3][1]) for k in range(20)] + [(3, rows[5][1]), (400, None), (410, [None]), (420, [float("inf")]), (430, []), (441, [9.0, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int")
    found = collections.defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 10 == 0, 4, query_block=8).collect():
        found[r.query_id].append((r.rank, r.vec_id, r.score))
    good = [(i, [math.floor(1024 * np.float32(x).astype(float)) for x in v]) for i, v in rows
            if v is not None and None not in v and all(map(math.isfinite, v))]
    for q, w in good:
        if q % 10 == 0:
            scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in good if i != q)[:4]
            assert sorted(found.pop(q)) == [(n + 1, i, -s) for n, (s, i) in enumerate(scored)]
    assert not found
    assert topk.top_k(df.limit(0), F.col("vec_id") % 10 == 0).count() == 0


# --- classifier

def test_quality_separates_held_out_labels_and_handles_odd_rows(spark):
    rng = random.Random(9)
    texts = [sentence(rng, rng.randint(5, 200)) + "." if i % 3 else " ".join(w + "%%%" for w in sentence(rng, rng.randint(5, 200)).split())
             for i in range(300)] + [None, ""]
    df = docs_frame(spark, texts)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(None, 1, 0), (299, None, 0), (298, 5, 0)],
                                   "doc_id long, quality int, toxic int")
    train = queries.id_remainder("doc_id", 4) != 2
    rows = quality.classify(df, labels, train).collect()
    assert len(rows) == 302 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert sum(r.predicted == int(r.doc_id % 3 > 0) for r in rows if r.doc_id < 300) >= 297
    none = quality.classify(df, labels.limit(0)).collect()
    assert {r.score for r in none} == {1.0}
    assert quality.classify(df.limit(0), labels).count() == 0


# --- licences

def test_license_scan_inherits_from_the_nearest_directory(spark):
    files = [("a/LICENSE", "Released under the MIT License."), ("a/b/x.txt", "nothing here"), ("a/b/c/y.txt", None),
             ("a/b/c/LICENSE.md", "Licensed under the Apache License,\nVersion 2.0."), ("a/b/c/d/z.txt", ""),
             ("a/b/z.txt", "foo bar\n// This work is licensed under the GNU General Public License, version 3.\ncode"),
             ("q.txt", "no"), (None, "All rights reserved."), (None, "no"), ("ab/x.txt", "the license of others is not ours to give away or name"),
             ("ab/COPYING", "long " * 50_000)]
    df = spark.createDataFrame([(p, t, 1, "x") for p, t in files], "path string, text string, license int, similarity string")
    found = {(r.path, r.similarity > 0.7): (r.own_license, r.license, r.license_dir) for r in licenses.license_scan(df).collect()}
    get = lambda p: next(v for k, v in found.items() if k[0] == p)
    assert get("a/LICENSE") == ("MIT", "MIT", None)
    assert get("a/b/x.txt") == (None, "MIT", "a")
    assert get("a/b/c/y.txt") == get("a/b/c/d/z.txt") == (None, "Apache-2.0", "a/b/c")
    assert get("a/b/z.txt") == ("GPL-3.0", "GPL-3.0", None)
    assert get("q.txt") == get("ab/x.txt") == get("ab/COPYING") == (None, None, None)
    assert found[None, True] == ("Proprietary", "Proprietary", None) and found[None, False] == (None, None, None)
    assert licenses.license_scan(df.limit(0)).count() == 0


def test_license_of_a_header_that_every_file_has(spark):
    rng = random.Random(6)
    for header in ("All rights reserved.", "Released under the MIT License."):
        files = [(f"a/{i}.py", (f"# {header}\n" if i % 20 else "") + sentence(rng, 30)) for i in range(40)]
        rows = licenses.scan(spark.createDataFrame(files, "path string, text string")).collect()
        assert [r.similarity > 0.99 for r in rows] == [bool(int(r.path[2:-3]) % 20) for r in rows]


def test_license_of_the_best_window_equals_brute_force():
    rng = random.Random(7)
    stock = [w for _, x in licenses.TEMPLATES for w in licenses.terms(x)] + list(WORDS)
    index = licenses.TemplateIndex(licenses.TEMPLATES, {w: rng.randint(0, 900) for w in stock}, 1000)
    for _ in range(150):
        text = "\n".join(" ".join(rng.choices(stock, k=rng.randint(0, 6))) for _ in range(rng.randint(0, 12)))
        lines = [x for x in map(licenses.terms, text.split("\n")) if x]
        scores = np.zeros(len(index.names))
        for n in (1, 2, 4):
            for i in range(len(lines) - n + 1):
                own = collections.Counter(t for x in lines[i:i + n] for t in x)
                norm = math.sqrt(sum((c * (index.idf[index.at[t]] if t in index.at else index.other)) ** 2 for t, c in own.items()))
                dot = sum(c * index.idf[index.at[t]] * index.rows[:, index.at[t]] for t, c in own.items() if t in index.at)
                scores = np.maximum(scores, dot / norm)
        name, score = index.best(text)
        assert score == pytest.approx(scores.max())
        assert name == (index.names[int(scores.argmax())] if score else None)


# --- repeated lines

def test_repeated_lines_equal_brute_force(spark):
    rng = random.Random(10)
    lines = [sentence(rng, rng.choice([3, 11, 40])) for _ in range(30)]
    texts = ["\n".join(rng.choice([x, x.upper(), "  " + x.replace(" ", "  ")]) if rng.random() < 0.7 else ""
                       for x in rng.choices(lines, k=rng.randint(0, 12))) for _ in range(60)] + [None, "", "\n\n"]
    found = {r.doc_id: r for r in substring.remove_repeats(docs_frame(spark, texts), min_words=10).collect()}
    seen = set()
    for i, t in enumerate(texts):
        kept, spans, at = [], [], 0
        for line in (t or "").splitlines(keepends=True):
            unit = " ".join(line.lower().split())
            if len(unit.split()) >= 10 and unit in seen:
                spans.append((at, at + len(line)))
            else:
                kept.append(line)
                if len(unit.split()) >= 10:
                    seen.add(unit)
            at += len(line)
        assert found[i].text == (None if t is None else "".join(kept))
        assert [tuple(s) for s in found[i].removed] == spans and found[i].row == 7
    assert substring.remove_repeats(docs_frame(spark, texts).limit(0)).count() == 0


@pytest.mark.parametrize("size", [51, 60, 130])
def test_repeated_passages_go_mid_line_and_wrapped(spark, size):
    rng = random.Random(size)
    own = [f"w{i}" for i in range(4000)]

    def fresh(n):
        return " ".join(rng.choice(own) for _ in range(n))

    passage = fresh(size).split()
    short = fresh(50)
    lines, at = [], 0
    while at < size:
        step = rng.randint(6, 12)
        lines.append(" ".join(passage[at:at + step]))
        at += step
    wrapped = "\n".join(lines)
    once = " ".join(passage)
    parts = [(fresh(20), fresh(30)) for _ in range(6)]
    forms = [once, once, wrapped, once.upper(), "  ".join(passage), short]
    texts = [f"{a} {x} {b}" for (a, b), x in zip(parts, forms, strict=True)]
    texts += [f"{fresh(9)} {short} {fresh(9)}", f"{fresh(5)} {once} {fresh(3)}\n{once} {fresh(2)}", None, ""]
    rows = {r.doc_id: r for r in substring.remove_repeats(docs_frame(spark, texts), run_words=50).collect()}
    for i in range(1, 5):
        assert rows[i].text == f"{parts[i][0]}  {parts[i][1]}"
        start = len(parts[i][0]) + 1
        assert [tuple(s) for s in rows[i].removed] == [(start, start + len(forms[i]))]
    for i in (0, 5, 6, 8, 9):  # the first occurrence, and a passage of 50 words
        assert rows[i].text == texts[i] and not rows[i].removed
    assert len(rows[7].removed) == 2 and passage[size // 2] not in rows[7].text.split()


def test_passages_equal_brute_force(spark):
    rng = random.Random(4)
    stock = [sentence(rng, rng.randint(9, 25)) for _ in range(4)]
    texts = [rng.choice([" ", "\n"]).join(rng.choices(stock, k=rng.randint(0, 9))) for _ in range(70)] + [None, sentence(rng, 700)]
    found = {r.doc_id: r for r in substring.remove_repeats(docs_frame(spark, texts), min_words=10 ** 9, run_words=50).collect()}
    seen, some = set(), 0
    for i, t in enumerate(texts):
        words = (t or "").split()
        gone = set()
        for k in range(len(words) - 50):
            unit = tuple(words[k:k + 51])
            if unit in seen:
                gone.update(range(k, k + 51))
            seen.add(unit)
        some += len(gone)
        assert (found[i].text or "").split() == [w for k, w in enumerate(words) if k not in gone]
    assert some


# --- suffix tree

def test_suffix_tree_base_scores_and_gain(spark):
    rng = random.Random(11)
    follow = {w: rng.sample(WORDS, 2) for w in WORDS}

    def chain(n):
        out = [rng.choice(WORDS)]
        for _ in range(n):
            out.append(rng.choice(follow[out[-1]]))
        return " ".join(out)

    texts = [chain(rng.randint(1, 120)) for _ in range(200)] + [None, "", "Unseen wordS here", "  "]
    rows = pst.score_texts(docs_frame(spark, texts), F.col("doc_id") < 150).collect()
    tokens = [(t or "").encode().lower().split() + [b" "] for t in texts]
    c = collections.Counter(x for t in tokens[:150] for x in t)
    n, v = sum(c.values()), len(c)
    held_base = held = 0.0
    for r in rows:
        t = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[x] > 0 for x in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t))
        if 150 <= r.doc_id < 200:
            held_base, held = held_base + r.base_score, held + r.score
    assert held > 0.6 * held_base  # the order of words tells
    assert pst.score_texts(docs_frame(spark, texts), F.lit(False)).first().train_tokens == 0
    assert pst.score_texts(docs_frame(spark, texts).limit(0), F.lit(True)).count() == 0


def test_suffix_tree_counts_next_words_that_are_rare_themselves(spark):
    rng = random.Random(12)
    texts = [" ".join(f"a{i} r{i}x{rng.randrange(10)}" for i in rng.choices(range(10), k=60)) for _ in range(100)]
    # a context has a share of about 1/20, each next word one of 1/200, below p_min and above p_next
    rows = pst.score_texts(docs_frame(spark, texts), F.lit(True), p_min=2.0 ** -6, p_next=2.0 ** -12).collect()
    gain = sum(r.score - r.base_score for r in rows) / (100 * 60)
    assert gain == pytest.approx(math.log10(20), abs=0.2)


def suffix_tree_by_hand(tokens, train, order, prior=20.0):
    """Scores of token lists by a suffix tree over tuples, every repeated context tested."""
    c = collections.Counter(x for t, learn in zip(tokens, train, strict=True) if learn for x in t)
    scale = sum(c.values()) + len(c) + 1
    after = collections.defaultdict(collections.Counter)
    for t, learn in zip(tokens, train, strict=True):
        for i in range(len(t) if learn else 0):
            for d in range(1, min(order, i) + 1):
                after[tuple(t[i - d:i])][t[i]] += 1
    states = {}

    def p(context, w):
        for d in range(len(context), 0, -1):
            if context[-d:] in states:
                n, total, rest = states[context[-d:]]
                below = p(context[-d + 1:] if d > 1 else (), w)
                return (n[w] + prior * below) / (total + prior) if n.get(w, 0) >= 2 else below * rest
        return (c[w] + 1) / scale

    sure = set()
    for s in sorted(after, key=len):
        n, total = after[s], sum(after[s].values())
        if s[1:] in sure or len(n) == 1:
            sure.add(s)
        if total < 2 or s[1:] in sure:
            continue
        own = {w: k for w, k in n.items() if k >= 2}
        q = {w: p(s[1:], w) for w in own}
        others, left = 1 - sum(q.values()), total - sum(own.values())
        gain = sum(k * math.log(k / total / q[w]) for w, k in own.items()) + (left and left * math.log(left / total / others))
        if own and gain > 0.5 * (len(own) + 1) * math.log(total):
            states[s] = own, total, (1 - sum((k + prior * q[w]) / (total + prior) for w, k in own.items())) / others
    return [sum(math.log10(p(tuple(t[max(0, i - order):i]), t[i])) for i in range(len(t))) for t in tokens], states


@pytest.mark.parametrize("hot", [0.0, 2.0 ** -9, 1.0])
def test_suffix_tree_is_the_one_by_hand(spark, hot):
    rng = random.Random(5)
    vocab = [f"w{int(i)}" for i in np.random.default_rng(1).zipf(1.3, 30_000) % 4000]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 300))) for _ in range(300)]
    for i in range(0, 200, 4):  # copies, some cut, some with other words inside
        words = texts[i].split()
        texts[i + 1] = " ".join(words[rng.randrange(9):])
        texts[i + 2] = " ".join(w if rng.random() > 0.05 else rng.choice(vocab) for w in words)
    texts += ["ha " * 200, "ha " * 60 + "ho", "ha", None, "", texts[0]]
    train = [i % 7 != 2 for i in range(len(texts))]
    tokens = [(t or "").split() + [" "] for t in texts]
    assert sum(map(len, tokens)) > 2 ** 15  # a share of 2^-14 is more than two tokens
    expected, states = suffix_tree_by_hand(tokens, train, 5)
    assert {1, 2, 3, 4, 5} == set(map(len, states))
    rows = pst.score_texts(docs_frame(spark, texts).repartition(3), F.col("doc_id") % 7 != 2, order=5, hot=hot,
                           block_bytes=1 << 15).collect()
    found = {r.doc_id: r.score for r in rows}
    assert len(rows) == len(texts)
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-6)


def test_suffix_tree_takes_two_rounds_of_windows(spark, monkeypatch):
    rng = random.Random(8)
    passages = [[f"w{rng.randrange(40)}" for _ in range(12)] for _ in range(30)]
    texts = [" ".join(w for p in rng.choices(passages, k=rng.randint(0, 12)) for w in p if rng.random() > 0.02) for _ in range(200)]
    train = [i % 5 != 2 for i in range(len(texts))]
    expected, states = suffix_tree_by_hand([t.split() + [" "] for t in texts], train, pst.ORDER)
    assert max(map(len, states)) == pst.ORDER
    tables, kept = [], pst._kept
    monkeypatch.setattr(pst, "_kept", lambda df: tables.append(df) or kept(df))
    rows = pst.score_texts(docs_frame(spark, texts), F.col("doc_id") % 5 != 2, hot=1.0, block_bytes=1 << 13).collect()
    assert len(tables) == 3 + 2 * 2  # not two for each of eight lengths: all blocks are shuffled for each
    found = {r.doc_id: r.score for r in rows}
    assert [found[i] for i in range(len(texts))] == pytest.approx(expected, rel=1e-6)


def test_suffix_tree_packs_steps_of_numbers():
    x = np.array([5, 5, 7, 2, 0, (1 << 62), 1, 0xFFFFFFFF, 3])
    assert pst._unpack(pst._pack(x, "<i8 steps"), "<i8 steps").tolist() == x.tolist()
    assert pst._unpack(pst._pack(x[:0], "<i8 steps"), "<i8 steps").tolist() == []


def suffix_tree_block(n: int):
    """A block of one training document of n places, all of which wait for contexts of two words."""
    rng = np.random.default_rng(11)
    code = np.append(0, rng.zipf(1.2, n - 1) % 50_000).astype(np.int32)
    count = np.bincount(code, minlength=50_000)
    held = {"code": code, "delta": -rng.random(50_000)[code], "total": np.zeros(n), "status": np.zeros(n),
            "start": 2 * (np.arange(n) >= 2), "hash": np.zeros(0), "count": count, "id": np.arange(50_000), "train": np.array([True])}
    held |= {name: np.array([n]) for name in ("n_tokens", "n_known", "here")} | {name: np.zeros(1) for name in ("base", "score")}
    return pst._row(1, pa.array([1]), held)


def peak_of(work):
    """What a function returns, and the most memory it had."""
    tracemalloc.start()
    try:
        return work(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_suffix_tree_tests_a_bucket_bit_by_bit(monkeypatch):
    n = 600_000
    block = pa.RecordBatch.from_pydict(suffix_tree_block(n))
    _, peak = peak_of(lambda: list(pst._ask_windows(3, 8, 2.0, 2.0, 16)(iter([block]))))
    assert peak < 110 * n
    ask = pst._ask_windows(3, 8, 2.0, 2.0, 1)
    bucket, = ask(iter([block]))
    answer = pst._answer_windows(3, 2 * n, 2.0, 2.0, 20.0)
    rows = pa.Table.from_batches([bucket] * 2)
    windows = 2 * int.from_bytes(bucket.column("n")[0].as_py()[:8], "little")
    assert windows > n
    got, peak = peak_of(lambda: answer(rows))
    assert peak < 80 * windows
    # bits of any size give the same
    monkeypatch.setattr(pst, "AT_ONCE", 1 << 30)
    assert list(ask(iter([block]))) == [bucket] and answer(rows).equals(got)
    monkeypatch.setattr(pst, "AT_ONCE", 1000)
    assert list(ask(iter([block]))) == [bucket] and answer(rows).equals(got)
    assert any(pst._unpack(x, "?").any() for x in got["open"].to_pylist())
    assert len({pst._unpack(x, "<f4").tobytes() for x in got["delta"].to_pylist()}) == 1


def test_suffix_tree_learns_passages_that_stand_twice(spark):
    rng = random.Random(6)
    texts = [" ".join(f"v{rng.randrange(3000)}" for _ in range(200)) for _ in range(300)]
    texts[7] = texts[151]
    rows = {r.doc_id: (r.score - r.base_score) / r.n_tokens for r in pst.score_texts(docs_frame(spark, texts), F.lit(True)).collect()}
    assert min(rows[7], rows[151]) > 1.5 and max(v for k, v in rows.items() if k not in (7, 151)) < 0.5


def test_layer_distributions_sum_to_one():
    rng = np.random.default_rng(3)
    n_words = 40
    root = rng.dirichlet(np.ones(n_words + 1))  # the last: all unknown words
    contexts, totals = np.arange(5), rng.integers(200, 900, 5)
    key, n = [], []
    for s in range(5):
        counts = rng.multinomial(totals[s], rng.dirichlet(np.ones(n_words) * 0.2))
        for w in np.flatnonzero(counts >= 3):
            key.append((s << pst._SHIFT) | int(w))
            n.append(int(counts[w]))
    layer = pst._layer(contexts, totals, np.array(key), np.array(n), lambda _, to: root[to], 20.0)
    assert len(layer.contexts) == 5
    states = pst._States(layer.contexts, 1, n_words)
    for s in range(5):
        total = 0.0
        for w in [*range(n_words), -1]:
            c = np.array([s, w])
            total += 10 ** layer.apply(c, np.log10(root[np.maximum(c, -1)]), states)[1]
        assert total == pytest.approx(1.0)


# --- queries against brute force on a fixture folder

def test_chat_query_digests(spark):
    found = {r.conv_id: r for r in queries.op3_chat_format(spark, "/root/testdata/sf0.001").collect()}
    text = "</s>[INST] ok [/INST]"
    assert found[-7].turns_sha256 == hashlib.sha256(f"user\n{text}\nassistant\n{text}\n".encode()).hexdigest()
    assert (found[-7].n_turns, found[-7].loss_chars, found[-7].loss_sha256) == (2, len(text), hashlib.sha256(text.encode()).hexdigest())
