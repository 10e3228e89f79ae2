"""The pipeline and each of its stages against plain Python, with nulls, copies, near copies and planted benchmark items."""

import hashlib
import random
from collections import Counter

import pytest

import corpus_pipeline
from ferrule.llm.bpe import default_vocabulary

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def lower(text):
    return (text or "").encode().lower()


def language(rows, items):
    return [r for r in rows if any(map(str.isalpha, r[1] or ""))]


def copies(rows, items):
    best = {}
    for r in rows:
        k = lower(r[1])
        if k not in best or (-1 if best[k][0] is None else best[k][0]) < (-1 if r[0] is None else r[0]):
            best[k] = r
    return list(best.values())


def near_copies(rows, items):
    sets = []
    for r in rows:
        w = lower(r[1]).split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if rows[a][0] is not None and rows[b][0] is not None and both and 5 * both >= 4 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    least = {}
    for r, k in zip(rows, label, strict=True):
        least[k] = r if k not in least or (r[0] is not None and r[0] < least[k][0]) else least[k]
    return list(least.values())


def benchmark_free(rows, items):
    flat = lambda t: b" " + b" ".join(lower(t).split()) + b" "
    return [r for r in rows if not any(flat(i).strip() in flat(r[1]) for i in items)]


@pytest.fixture(scope="module")
def given(spark, tmp_path_factory):
    random.seed(8)
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    texts = [r["text"] for r in items.collect()]
    rows = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    words = [" ".join(f"word{random.randint(0, 400)}" for _ in range(90)) for _ in range(6)]
    at = words[1].split()
    planted = [None, "", " \n", "12 34 !!", words[0], words[0].upper(), words[1], " ".join([*at[:-1], "changed"]), " ".join(["changed", *at[:-1], "changed"]), words[2] + " " + texts[0].upper() + " " + words[3], texts[1].replace(" ", "\n  "), words[4]]
    rows += [(10_000 + i, t, "en", "planted", None) for i, t in enumerate(planted)]
    rows += [rows[-1], (None, words[5], "en", "planted", None), (3, words[0], "en", "planted", 1)]
    rows = [r for k, r in enumerate(rows) if r[0] != 3 or r[3] == "planted"]
    folder = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    items.write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, texts


def test_stages_and_run_equal_plain_python(spark, given):
    from tokenizers import Tokenizer

    folder, rows, items = given
    stages = dict(corpus_pipeline.STAGES)
    for plain in (language, copies, near_copies, benchmark_free):
        got = stages[plain.__name__](spark, spark.createDataFrame(rows, SCHEMA), folder)
        assert got.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        left = plain(rows, items)
        assert len(left) < len(rows), plain.__name__
        assert Counter(map(tuple, got.collect())) == Counter(left), plain.__name__
        rows = left
    library = Tokenizer.from_file(default_vocabulary())
    want = Counter()
    for r in rows:
        ids = library.encode(r[1], add_special_tokens=False).ids
        want[r[0], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(r[1].encode()).hexdigest()] += 1
    assert Counter(map(tuple, stages["tokens"](spark, spark.createDataFrame(rows, SCHEMA), folder).collect())) == want
    assert Counter(map(tuple, corpus_pipeline.run(spark, folder).collect())) == want
