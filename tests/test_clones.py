import random
import re
from collections import defaultdict

from pyspark.sql import functions as F

from quarry.operators import clones as C
from quarry.operators import maximal as M
from quarry.operators.successor import next_in_order


def test_successor_range_equals_window_with_hot_key(spark):
    rnd = random.Random(11)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 else f"k{rnd.randint(0, 50)}"  # one key holds 2/3 of rows
        rows.append((key, rnd.randint(0, 40), i))
    df = spark.createDataFrame(rows, "key string, doc long, pos long")
    a = next_in_order(df, ["key"], ["doc", "pos"], ["doc", "pos"], num_partitions=7)
    b = next_in_order(df, ["key"], ["doc", "pos"], ["doc", "pos"], method="window")
    cols = ["key", "doc", "pos", "next_doc", "next_pos"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    assert a.count() == 3000


def _brute_kgrams(docs, k):
    out = defaultdict(list)
    for proj, doc, text in docs:
        toks = re.findall(r"[a-z0-9]+", text.lower())
        for i in range(len(toks) - k + 1):
            out[(proj, " ".join(toks[i:i + k]))].append((doc, i))
    return {key: v for key, v in out.items() if len(v) >= 2}


def _brute_fragments(docs, k):
    """Longest matches of all pairs of counted places, and the places of their texts: {(project, text): [(doc, start)]}."""
    toks = {(p, d): re.findall(r"[a-z0-9]+", t.lower()) for p, d, t in docs if t is not None}
    grams = {}
    for (p, d), ts in toks.items():
        last = {}
        for i in range(len(ts) - k + 1):
            g = tuple(ts[i:i + k])
            if i - last.get(g, -k) >= k:
                last[g] = i
                grams[p, d, i] = g
    out = {}
    for p in {p for p, _ in toks}:
        places = sorted((d, i) for q, d, i in grams if q == p)
        texts = set()
        for n, (d, i) in enumerate(places):
            for e, j in places[n + 1:]:
                if grams[p, d, i] != grams[p, e, j] or (p, d, i - 1) in grams and grams[p, d, i - 1] == grams.get((p, e, j - 1)):
                    continue
                size = 1
                while (p, d, i + size) in grams and grams[p, d, i + size] == grams.get((p, e, j + size)):
                    size += 1
                texts.add(tuple(toks[p, d][i:i + size + k - 1]))
        for x in texts:
            out[p, " ".join(x)] = [(d, i) for d, i in places if tuple(toks[p, d][i:i + len(x)]) == x
                                   and all((p, d, i + n) in grams for n in range(len(x) - k + 1))]
    return out


def _found_fragments(spark, docs, k):
    df = spark.createDataFrame(docs, "project string, doc long, text string")
    windows = M.clone_windows(df, "project", "doc", "text", k=k)
    clones = M.maximal_clones(windows, k=k).collect()
    places = defaultdict(list)
    toks = {(p, d): re.findall(r"[a-z0-9]+", (t or "").lower()) for p, d, t in docs}
    for r in M.clone_occurrences(windows, M.maximal_clones(windows, k=k)).collect():
        text = " ".join(toks[r.project, r.first_doc][r.first_start:r.first_start + r.tokens])
        places[r.project, text].append((r.doc, r.start))
    return {x: sorted(v) for x, v in places.items()}, clones


DOCS = [
    ("p1", 1, "a b c d e f g h\na b c d e f g h x y"),          # same-file repeat, across lines
    ("p1", 2, "zz a b c d e f g h q"),                          # across-file copy
    ("p1", 3, "one two three four"),                            # exactly k tokens, unique
    ("p1", 4, "one two three"),                                 # k-1 tokens
    ("p2", 5, "one two three four one two three four one two three four"),  # overlapping repeats
    ("p2", 6, "Hot hot HOT hot hot hot hot hot hot hot"),       # hot k-gram
]


def test_token_clones_against_brute_force(spark):
    k = 4
    df = spark.createDataFrame(DOCS, "project string, doc long, text string")
    got = {(r["project"], r["kgram"]): (r["n_occ"], r["n_docs"])
           for r in C.token_clones(df, "project", "doc", "text", k=k).collect()}
    brute = _brute_kgrams(DOCS, k)
    assert got == {key: (len(v), len({d for d, _ in v})) for key, v in brute.items()}


def test_maximal_clones_against_brute_force(spark):
    for k in (4, 2):
        got, clones = _found_fragments(spark, DOCS, k)
        brute = _brute_fragments(DOCS, k)
        assert got == brute
        assert sorted((c.project, c.tokens, c.n_occ, c.n_docs, c.same_file, c.across_file) for c in clones) == sorted(
            (p, len(x.split()), len(v), len({d for d, _ in v}), len(v) > len({d for d, _ in v}),
             any([d for d, _ in v].count(e) == 1 for e, _ in v)) for (p, x), v in brute.items())
    lines = {(c.doc, c.start): (c.first_line, c.last_line, c.tokens, c.lines) for c in clones}
    assert lines[1, 0] == (1, 1, 8, 1)  # tokens 0-7 of document 1 are all on line 1


def test_a_fragment_and_its_beginning_are_two_clones(spark):
    words = [f"w{i}" for i in range(100)]
    docs = [("p", 1, "x " + " ".join(words) + " y"), ("p", 2, "z " + " ".join(words[:50]) + " q"),
            ("p", 3, " ".join(words)), ("q", 4, " ".join(words)), (None, 5, " ".join(words[:30])), (None, 6, " ".join(words[:30])),
            ("p", 7, None)]
    got, _ = _found_fragments(spark, docs, 20)
    assert got == {("p", " ".join(words)): [(1, 1), (3, 0)], ("p", " ".join(words[:50])): [(1, 1), (2, 1), (3, 0)],
                   (None, " ".join(words[:30])): [(5, 0), (6, 0)]}
    empty = spark.createDataFrame([], "project string, doc long, text string")
    assert M.maximal_clones(M.clone_windows(empty, "project", "doc", "text")).count() == 0


def test_line_model_same_and_across(spark):
    docs = [("p", 1, "x = 1;\nx = 1;\ny();"), ("p", 2, "y();\nz();"), ("q", 3, "z();\n  \n")]
    df = spark.createDataFrame(docs, "project string, doc long, text string")
    dups, occs = C.line_clones(df, "project", "doc", "text")
    assert {r["code"]: r["n_occurrences"] for r in dups.collect()} == {"x = 1;": 2, "y();": 2}
    same = {r["code"] for r in C.same_file_duplications(dups, occs).collect()}
    across = {r["code"] for r in C.across_file_duplications(dups, occs).collect()}
    assert same == {"x = 1;"} and across == {"y();"}


def test_line_duplications_equal_the_occurrence_queries(spark):
    docs = [("p", 1, "x = 1;\nx = 1;\ny();"), ("p", 2, "y();\nz();\nx = 1;"), ("q", 3, "z();\n  \n"),
            (None, 4, "n();"), (None, 5, "n();"), ("q", 6, None)]
    df = spark.createDataFrame(docs, "project string, doc long, text string")
    dups, occs = C.line_clones(df, "project", "doc", "text")
    flags = {(r["project"], r["code"]): (r["same_file"], r["across_file"])
             for r in C.line_duplications(df, "project", "doc", "text").collect()}
    assert flags == {("p", "x = 1;"): (True, True), ("p", "y();"): (False, True), (None, "n();"): (False, True)}
    assert {(r["project"], r["code"]): (r["same_file"], r["across_file"])
            for r in C.classify_duplications(dups, occs).collect()} == flags
    assert occs.count() == 7


def test_successor_matched_only_with_null_keys(spark):
    rows = [(None if i % 5 == 0 else f"k{i % 90}", i % 7, i) for i in range(600)]
    df = spark.createDataFrame(rows, "key string, doc long, pos long")
    a = next_in_order(df, ["key"], ["doc", "pos"], ["pos"], num_partitions=5, matched_only=True)
    b = next_in_order(df, ["key"], ["doc", "pos"], ["pos"], method="window").filter("next_pos is not null")
    cols = [F.coalesce("key", F.lit("-")), "doc", "pos", "next_pos"]
    assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))


def test_duplication_both_same_and_across(spark):
    dups = spark.createDataFrame([(1, "p", 3, 40, "c")], "dup_id long, project string, lines int, tokens int, code string")
    occs = spark.createDataFrame([(1, "A", 1), (1, "A", 9), (1, "B", 4)], "dup_id long, path string, line int")
    assert C.same_file_duplications(dups, occs).count() == 1
    assert C.across_file_duplications(dups, occs).count() == 1
    h = [tuple(r) for r in C.clone_histogram(dups, "lines").collect()]
    assert h == [(3, 1)]


def test_fingerprints_of_positions_lines_and_neighbours(spark):
    k = 4
    docs = [*DOCS, ("p3", 7, "\u00dcn\u00efcode w\u00f6rds \u00c4ND MORE and more\nend \u00dcn\u00efcode w\u00f6rds and more")]
    rows = C.kgram_fingerprints(spark.createDataFrame(docs, "project string, doc long, text string"), "project", "doc", "text", k).collect()
    by_place, names = {(r.doc, r.pos): r for r in rows}, {}
    for _, doc, text in docs:
        toks = [(t, i + 1) for i, line in enumerate(text.lower().split("\n")) for t in re.findall("[a-z0-9]+", line)]
        for i in range(len(toks) - k + 1):
            r = by_place.pop((doc, i))
            assert (r.first_line, r.last_line) == (toks[i][1], toks[i + k - 1][1])
            assert names.setdefault(tuple(t for t, _ in toks[i:i + k]), (r.h1, r.h2)) == (r.h1, r.h2)
            assert r.prev == (by_h[doc, i - 1] if i else None)
            by_h = {(doc, i): r.h1}
    assert not by_place and len(set(names.values())) == len(names)


def test_classify_equals_semi_joins(spark):
    dups = spark.createDataFrame([(1, "p", 1, 5, "a"), (2, "p", 1, 5, "b"), (3, "p", 1, 5, "c"), (4, "p", 1, 5, "d")],
                                 "dup_id long, project string, lines int, tokens int, code string")
    occs = spark.createDataFrame([(1, "A", 1), (1, "A", 2), (2, "A", 1), (2, "B", 1), (3, "A", 1), (3, "A", 5),
                                  (3, "B", 2)], "dup_id long, path string, line int")
    flags = {r["dup_id"]: (r["same_file"], r["across_file"]) for r in C.classify_duplications(dups, occs).collect()}
    same = {r["dup_id"] for r in C.same_file_duplications(dups, occs).collect()}
    across = {r["dup_id"] for r in C.across_file_duplications(dups, occs).collect()}
    assert {d for d, f in flags.items() if f[0]} == same == {1, 3}
    assert {d for d, f in flags.items() if f[1]} == across == {2, 3}
    assert flags[4] == (False, False)


def test_successor_with_coalesced_range_partitions(spark):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        rows = [("hot" if i % 4 else f"k{i % 9}", i // 7, i) for i in range(2000)]
        df = spark.createDataFrame(rows, "key string, doc long, pos long")
        a = next_in_order(df, ["key"], ["doc", "pos"], ["pos"])
        b = next_in_order(df, ["key"], ["doc", "pos"], ["pos"], method="window")
        cols = ["key", "doc", "pos", "next_pos"]
        assert sorted(map(tuple, a.select(cols).collect())) == sorted(map(tuple, b.select(cols).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_one_duplication_per_fragment(spark):
    frag = "alpha beta gamma delta"
    docs = [("p", 1, f"x {frag} y"), ("p", 2, f"{frag} z"), ("p", 3, f"q q {frag}\n{frag}")]
    got, clones = _found_fragments(spark, docs, 3)
    assert got == {("p", frag): [(1, 1), (2, 0), (3, 2), (3, 6)]}
    assert clones[0].same_file and clones[0].across_file


def test_rolling_fingerprint_math():
    import numpy as np

    from quarry.operators.fingerprints import BASES, _fingerprints

    rng = np.random.default_rng(3)
    h = rng.integers(0, 2**63, size=50, dtype=np.int64).astype(np.uint64)
    k, base = 7, BASES[0]
    got = _fingerprints(h, k, base)
    mask = (1 << 64) - 1
    want = []
    for i in range(len(h) - k + 1):
        acc = 0
        for j in range(k):
            acc = (acc + int(h[i + j]) * pow(base, j, 1 << 64)) & mask
        want.append(acc - (1 << 64) if acc >= 1 << 63 else acc)
    assert got.tolist() == want


def test_only_kgrams_that_may_be_repeated_become_rows(spark):
    from quarry.operators.repeats import Repeats

    rnd, k = random.Random(5), 20
    docs = [("p" if i % 3 else None, i, " ".join(f"w{rnd.randint(0, 10 ** 6)}" for _ in range(300))) for i in range(40)]
    shared = docs[1][2].split()[100:150]  # the same project, another one, and twice in one text
    docs += [("p", 40, " ".join(["a", *shared, "b"])), (None, 41, " ".join(shared)), ("q", 42, " ".join([*shared[:25], "c", *shared[:25]]))]
    repeats = Repeats(spark.createDataFrame(docs, "project string, doc long, text string"), "project", "doc", "text", k)
    rows = [(r.doc, r.pos) for r in repeats.grams().collect()]
    assert len(rows) == len(set(rows)) < 150  # of 11,000 places
    assert set(rows) >= {(1, 100 + i) for i in range(31)} | {(40, 1 + i) for i in range(31)} | {(42, i) for i in (*range(6), *range(26, 32))}
    ends = sorted((r.doc, r.pos, r.head, r.tail) for r in repeats.ends().collect())
    assert ends == [(1, 100, True, False), (1, 130, False, True), (40, 1, True, False), (40, 31, False, True),
                    (42, 0, True, False), (42, 5, False, True), (42, 26, True, False), (42, 31, False, True)]


def test_windows_of_edited_copies_are_about_their_clones(spark):
    rnd, k = random.Random(3), 5
    text, docs = [f"w{i}" for i in range(300)], []
    for doc in range(14):
        copy = list(text)
        for at in rnd.sample(range(300), 8):
            copy[at] = f"x{rnd.randint(0, 10 ** 9)}" if rnd.random() < 0.7 else f"w{rnd.randint(0, 299)}"
        docs.append(("p" if doc % 7 else None, doc, " ".join(copy[rnd.randint(0, 30):])))
    got, clones = _found_fragments(spark, docs, k)
    assert got == _brute_fragments(docs, k)
    df = spark.createDataFrame(docs, "project string, doc long, text string")
    rows = M.clone_windows(df, "project", "doc", "text", k=k).count()
    assert max(c.size for c in clones) > 8  # symbols; a row per window that may be repeated was 5 times as many
    assert rows < 1.2 * sum(c.n_occ for c in clones)
