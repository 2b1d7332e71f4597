"""Every stage of the pipeline against a brute-force version on what its predecessor kept, and the whole run."""

import numpy as np
import public_tokenizers

import corpus_pipeline
from .test_operators import WORD, brute_components, brute_fingerprint, words

SCHEMA = "doc_id long, source string, lang string, text string, n_chars int, _score string, fp long, _text string, n long"


def tables():
    passage, item, other = words(60, 901), words(40, 902), words(40, 903)
    rows = [(i, ("you are a zargon, " if i % 4 == 0 else "what a fine day, ") + words(25, i)) for i in range(80)]
    rows += [(101, words(70, 50)), (102, words(70, 50).upper()), (102, words(70, 50)), (103, words(30, 51) + " " + passage), (104, passage + "\n" + words(40, 52)),
             (105, words(20, 53) + " " + item), (106, other.split(" ", 1)[1] + " tail"), (107, words(9000, 54)), (108, None), (109, ""), (None, words(50, 55)), (None, None), (110, " \n ")]
    docs = [(i, None if (i or 0) % 3 else "hot", "en", t, None if t is None else len(t), "own", None, "clash", 5) for i, t in rows]
    return docs, [(i, int(i % 4 == 0)) for i in range(80)] + [(None, None)], [(1, item), (2, other), (3, None), (4, "too short")]


def put(spark, folder, docs, labels, items):
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")


def near_dedup(rows):
    group = brute_components([brute_fingerprint(r[3]) for r in rows])
    least = {}
    for r, g in zip(rows, group, strict=True):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    return {r[0] for r, g in zip(rows, group, strict=True) if r[0] is not None and least[g] == r[0]}


def without_repeats(rows):
    first, out = {}, []
    order = lambda r: float("inf") if r[0] is None else r[0]
    split = [WORD.findall(r[3] or "") for r in rows]
    for r, w in zip(rows, split, strict=True):
        for j in range(len(w) - 12):
            k = tuple(w[j:j + 13])
            first[k] = min(first.get(k, order(r)), order(r))
    for r, w in zip(rows, split, strict=True):
        gone = np.zeros(len(w), dtype=bool)
        for j in range(len(w) - 12):
            if first[tuple(w[j:j + 13])] < order(r):
                gone[j:j + 13] = True
        text = " ".join(x for x, g in zip(w, gone, strict=True) if not g) if gone.any() else r[3]
        out.append((*r[:3], text, len(text) if gone.any() else r[4], *r[5:]))
    return out


def test_stages_and_run(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, labels, items = tables()
    sf = str(tmp_path)
    put(spark, sf, docs, labels, items)
    now = spark.read.parquet(f"{sf}/documents.parquet")
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, sf)
        assert name == "packing" or out.columns == now.columns
        out.write.parquet(f"{sf}/{name}")
        now = spark.read.parquet(f"{sf}/{name}")
        kept.append([tuple(r) for r in now.collect()])
    start, calm, single, cut, clean, packed = kept
    same = lambda a, b: sorted(map(repr, a)) == sorted(map(repr, b))
    assert same(calm, [r for r in start if r[0] is None or r[0] >= 80 or r[0] % 4])
    assert {r[0] for r in single if r[0] is not None} == near_dedup(calm) and len({r[0] for r in single} - {None}) == len([r for r in single if r[0] is not None])
    assert all(r in calm for r in single) and same([r for r in single if r[0] is None], [r for r in calm if r[0] is None])
    assert same(cut, without_repeats(single)) and not same(cut, single)
    assert same(clean, [r for r in cut if r[0] not in (105, 106)]) and len(clean) < len(cut)
    own = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    columns = now.columns
    got = {}
    for r in sorted((dict(zip(columns, r, strict=True)) for r in packed), key=lambda r: r["start"]):
        if r["doc_id"] is not None:
            got[r["doc_id"]] = got.get(r["doc_id"], b"") + bytes(r["ids"])
    assert got == {r[0]: np.array([*own.encode(r[3] or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for r in clean if r[0] is not None}
    assert sum(r[columns.index("length")] for r in packed) == sum(len(own.encode(r[3] or "", add_special_tokens=False).ids) + 1 for r in clean)
    again = [tuple(r) for r in corpus_pipeline.run(spark, sf).drop("sequence_id", "offset", "start", "length", "ids", "ids_crc32").distinct().collect()]
    assert {r[0] for r in again} == {r[0] for r in packed}


def test_empty_tables(spark, tmp_path):
    put(spark, str(tmp_path), [], [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
