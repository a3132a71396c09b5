"""The pipeline against a plain Python one on a small folder."""

import random
import re

import numpy as np
import public_tokenizers

import __spark_entry__
import corpus_pipeline
from quarry.llm import substring
from test_operators import brute_components, sentence, shingle_set


def brute_repeats(texts, least=10, length=51):
    """Texts by id without repeated lines and repeated runs of words, character by character."""
    seen, final = set(), {}
    for i in sorted(texts):
        text = texts[i] or ""
        gone, at = set(), 0
        for line in re.findall(r"[^\n]*\n|[^\n]+", text):
            unit = " ".join(line.lower().split())
            if len(unit.split()) >= least:
                if ("line", unit) in seen:
                    gone.update(range(at, at + len(line)))
                seen.add(("line", unit))
            at += len(line)
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"\S+", text)]
        for k in range(len(words) - length + 1):
            unit = tuple(w for w, _, _ in words[k:k + length])
            if unit in seen:
                gone.update(range(words[k][1], words[k + length - 1][2]))
            seen.add(unit)
        final[i] = "".join(c for n, c in enumerate(text) if n not in gone)
    return final


def test_lines_and_passages_together(spark):
    """A shared passage whose first 60 words are a line goes whole, with the 40 words after the line break."""
    rng = random.Random(5)
    shared = sentence(rng, 60) + "\n" + sentence(rng, 40)
    stock = [sentence(rng, rng.randint(4, 70)) for _ in range(6)]
    texts = {0: f"start {shared} end", 1: sentence(rng, 5) + "\n" + shared, 2: shared.replace("\n", " "), 3: "", 4: None}
    texts |= {i: rng.choice([" ", "\n", "\n\n"]).join(rng.choices(stock, k=rng.randint(1, 9))) for i in range(5, 60)}
    rows = [(i, t, 1, "x") for i, t in texts.items()]
    frame = spark.createDataFrame([*rows, rows[7]], "doc_id long, text string, start int, predicted string").repartition(3).cache()
    for size in (400, 1 << 22):
        found = substring.remove_repeats(frame, run_words=50, block_bytes=size).collect()
        wanted = brute_repeats(texts)
        assert len(found) == len(rows) + 1
        for r in found:
            assert (r.text or "") == wanted[r.doc_id] and (r.text is None) == (texts[r.doc_id] is None)
    assert wanted[1].split() == texts[1].split()[:5]


def test_stages_keep_columns_and_stand_empty_tables(spark, tmp_path):
    rng = random.Random(9)
    line = sentence(rng, 12)
    rows = [(i, sentence(rng, 30) + "\n" + line, 77.0, "p", "r", None) for i in range(40)] + [(None, None, 1.0, "p", "r", 3)]
    schema = "doc_id long, text string, score double, predicted string, removed string, n_chars int"
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        got = out.collect()
        assert {(r.score, r.predicted, r.removed) for r in got} <= {(77.0, "p", "r"), (1.0, "p", "r")}
        empty = stage(spark, docs.limit(0), str(tmp_path))
        assert empty.columns == docs.columns and empty.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), str(tmp_path)).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    shared = sentence(rng, 55)
    rows = []
    for i in range(240):
        text = ".\n".join(sentence(rng, rng.randint(12, 40)) for _ in range(rng.randint(1, 5))) + "."
        if i % 6 == 0:
            text = " ".join(w + "%%%" for w in text.split())
        elif i % 17 == 0 and (i - 2) % 6:
            text = rows[i - 2][1] + " tail"
        elif i % 13 == 0:
            text += "\n" + shared + ".\nlast"
        rows.append((i, text, "en", "s", len(text)))
    rows += [(900, None, "en", "s", None), (901, "", None, None, 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 6 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "substring dedup", "packing"]
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = corpus_pipeline.STAGES[0][1](spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    good = {r.doc_id: r.text for r in kept.collect()}
    assert {i for i in good if i < 240} == {i for i in range(240) if i % 6}

    parts = brute_components({i: shingle_set(t, 5) for i, t in good.items()}, 80, 100)
    stay = {i: t for i, t in good.items() if parts[i] == i}
    assert len(stay) < len(good)
    final = brute_repeats(stay)
    assert any(shared in (stay[i] or "") and shared not in final[i] for i in final)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for p in corpus_pipeline.run(spark, str(tmp_path)).collect():
        pieces.setdefault(p.doc_id, []).append((p.start, bytes(p.ids)))
    assert set(pieces) == set(final)
    for i, t in final.items():
        ids = np.frombuffer(b"".join(x for _, x in sorted(pieces[i])), "<u4").tolist()
        assert ids == [*tokenizer.encode(t, add_special_tokens=False).ids, 1]


def test_every_operator_is_registered():
    names = list(__spark_entry__.queries())
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
