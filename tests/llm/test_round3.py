"""Token counts, vector codes and periodic runs against brute-force versions."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest

from pulsegrid.llm import periodic_runs, token_counts, vector_codes

EXTRA = "doc_id long, text string, key long, _text string, chunk string, n long, runs int, at string, ok string, seam int"
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def documents(spark, texts):
    return spark.createDataFrame([(i, t, 1, "clash", "x", 3, 4, "y", None, 5) for i, t in texts], EXTRA)


def mixed(n, seed):
    rng = random.Random(seed)
    bits = ["the ", "Straße ", "été, ", "\n", "\t", "   ", "語言模型", "🙂", "x1=2;", "don't ", "▁", "é", "ﬁ", "<s>", "<|endoftext|>", "aaaaaaa", " \n ", "0123456789", " ", "\x00"]
    return "".join(rng.choice(bits) for _ in range(n))


@pytest.fixture(scope="module")
def long_texts():
    return [(1, mixed(3000, 1)), (2, None), (3, ""), (3, ""), (None, mixed(900, 2)), (5, "a" * 9000), (6, " " * 5000), (7, "word " * 2500), (8, "short text"), (9, "\n" * 3000),
            (10, "語" * 4000), (11, mixed(2500, 3)), (11, mixed(2500, 3)), (12, "ab" * 4000 + " tail"), (13, "b" * 131), (-4, " lead and trail ")]


@pytest.mark.parametrize("name", ["piece_bpe_32k.model", "byte_bpe_50k.json", "word_bpe_49k.json"])
def test_token_counts_equal_whole_encodings(spark, long_texts, name):
    path = public_tokenizers.path(name)
    if name.endswith(".model"):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(lib.encode(t))
    else:
        from tokenizers import Tokenizer

        lib = Tokenizer.from_file(path)
        count = lambda t: len(lib.encode(t, add_special_tokens=False).ids)
    want = [(i, len((t or "").encode()), count(t or ""), count(t or "") > 4096) for i, t in long_texts]
    assert token_counts.library(path).splices
    for chunk, overlap in ((256, 40), (700, 100), (32_768, 512)):
        rows = token_counts.token_counts(documents(spark, long_texts), path, chunk=chunk, overlap=overlap)
        assert rows.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
        assert sorted(map(repr, map(tuple, rows.collect()))) == sorted(map(repr, want)), (chunk, overlap)


def test_overlaps_widen_where_nothing_agrees(spark):
    """A text of one letter has no boundary in common in a narrow overlap, or one that is proven; other letters do."""
    path = PIECES
    todo = spark.createDataFrame([(0, 7, 9000, "ab" * 4500), (1, 8, 9000, "the cat sat " * 750)], "key long, doc_id long, n_bytes long, _text string")
    got = {r.key: r for r in token_counts.spliced(todo, path, 600, 4).collect()}
    assert not got[0].ok or not got[1].ok
    whole = {r.doc_id: r.n_tokens for r in token_counts.token_counts(todo, path, text="_text", chunk=600, overlap=4).collect()}
    lib = token_counts.library(path)
    assert whole == {7: lib.counts(["ab" * 4500])[0], 8: lib.counts(["the cat sat " * 750])[0]}


def test_token_counts_of_an_empty_table(spark):
    assert token_counts.token_counts(documents(spark, []), PIECES).count() == 0
    with pytest.raises(ValueError):
        token_counts.token_counts(documents(spark, []), PIECES, chunk=100, overlap=50)


def brute_codes(rows, parts=16, entries=64, rounds=2):
    ok = lambda v: v is not None and all(x is not None and np.isfinite(x) for x in v)
    kept = [(i, lab, [int(np.floor(256 * float(x))) for x in v]) for i, v, lab in rows if ok(v)]
    width = max((len(v) for _, _, v in kept), default=0)
    sound = sorted((r for r in kept if len(r[2]) == width and width), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    each = width // parts
    cut = [[tuple(r[2][p * each:(p + 1) * each]) for p in range(parts)] for r in sound]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            groups = {}
            for c in cut:
                groups.setdefault(near(p, c[p])[1], []).append(c[p])
            new.append([tuple(sum(y) // len(groups[k]) for y in zip(*groups[k], strict=True)) if k in groups else e for k, e in enumerate(books[p])])
        books = new
    sha = hashlib.sha256(",".join(str(y) for b in books for e in b for y in e).encode()).hexdigest()
    out, sums = [], {}
    for (i, lab, _), c in zip(sound, cut, strict=True):
        best = [near(p, c[p]) for p in range(parts)]
        out.append((i, lab, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best)))
        sums[lab] = sums.get(lab, 0) + out[-1][3]
    odd = [(i, lab, None, None) for i, lab, v in kept if len(v) != width or not width]
    return sorted(repr((i, c, e, sums.get(lab), sha)) for i, lab, c, e in out + odd)


VECTORS = "vec_id long, embedding array<float>, label int, v string, cell int, code int, error string, of int"


def vectors(n, seed=0, width=32):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in np.round(rng.normal(size=width), 1)], None if i % 7 == 0 else int(i % 3)) for i in rng.permutation(n)]
    rows += [(3, None, 1), (4, [None] * width, 1), (5, [float("nan")] * width, 1), (6, [float("inf")] + [0.0] * (width - 1), 1), (7, [-float("inf")] * width, None)]
    return [*rows, rows[0], (rows[1][0], rows[2][1], 2), (None, rows[3][1], None)]


def test_vector_codes_against_brute_force(spark):
    for n, seed in ((300, 1), (20, 2), (0, 3)):
        rows = vectors(n, seed) if n else []
        df = spark.createDataFrame([(*r, "clash", 1, 2, "x", 3) for r in rows], VECTORS).repartition(3)
        got = vector_codes.vector_codes(df)
        assert got.columns == ["vec_id", "label", "code", "error", "label_error", "codebooks_sha256"]
        assert sorted(repr(tuple(r)) for r in got.drop("label").collect()) == brute_codes(rows)


def test_vectors_of_odd_lengths_keep_their_rows(spark):
    rows = [(1, [0.5] * 32, 1), (2, [0.25] * 31, 1), (3, [], 2), (4, [1e30] * 32, 1), (5, [-0.001] * 32, 1)]
    got = {r.vec_id: r for r in vector_codes.vector_codes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert set(got) == {1, 2, 3, 4, 5} and all(got[i].code is None and got[i].error is None for i in (2, 3, 4))
    assert got[1].code == "00" * 16 and got[5].code == "01" * 16 and got[1].label_error == 0 and got[3].label_error is None
    uneven = vector_codes.vector_codes(spark.createDataFrame([(i, [float(i)] * 19, 0) for i in range(5)], "vec_id long, embedding array<float>, label int"))
    assert all(r.error == 0 for r in uneven.collect())


def test_nearest_is_exact_and_prunes():
    rng = np.random.default_rng(4)
    x, book = rng.integers(-9, 9, (500, 4)), rng.integers(-9, 9, (64, 4))
    code, best, looked = vector_codes.nearest(x, book)
    dist = ((x[:, None] - book[None]) ** 2).sum(axis=2)
    assert (dist.argmin(axis=1) == code).all() and (dist.min(axis=1) == best).all() and looked < dist.size
    same = np.zeros((5, 3), dtype=np.int64)
    assert (vector_codes.nearest(same, np.array([[1, 0, 0], [0, 1, 0], [0, 0, 1], [-1, 0, 0]]))[0] == 0).all()


def test_vector_codes_sql(spark, sf):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    cur = con.execute(vector_codes.SQL)
    names = [d[0] for d in cur.description]
    want = sorted(tuple(dict(zip(names, r, strict=True)).items()) for r in cur.fetchall())
    assert sorted(tuple(r.asDict().items()) for r in vector_codes.query(spark, sf).collect()) == want


def brute_runs(w, least=12):
    out = []
    for q in range(1, len(w) // 2 + 1):
        x = 0
        while x + q < len(w):
            y = x
            while y + q < len(w) and w[y] == w[y + q]:
                y += 1
            n = y - x + q
            if n >= max(least, 2 * q) and not any(all(w[x + k] == w[x + k + p] for k in range(n - p)) for p in range(1, q)):
                out.append((x, n, q))
            x = y + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def run_texts():
    rng = random.Random(3)
    rows = []
    for i in range(300):
        few = rng.choice([1, 2, 3, 6])
        w = [rng.choice("abcdef"[:few]) for _ in range(rng.randrange(0, 50))]
        if rng.random() < 0.5 and w:
            root = w[rng.randrange(len(w)):][:12]
            w += root * rng.randrange(1, 6) + root[:rng.randrange(0, len(root) + 1)]
        rows.append((i, rng.choice([" ", "\n", "\t "]).join(w)))
    line = " ".join(f"w{k}" for k in range(40))
    return rows + [(900, None), (901, ""), (902, " \n\t"), (None, "x y " * 30), (903, line + " z " + line), (903, (line + " ") * 3), (904, "a" * 50), (905, "    " * 20),
                   (906, " ".join(f"u{k}" for k in range(30_000)) + " r s t" * 4000), (-10, "p q " * 9)]


def plant(i, w):
    h, n = zlib.crc32(str(i).encode()), len(w)
    if i is None or h % 10 or not n:
        return w
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]


def test_periodic_runs_against_brute_force(spark):
    texts = run_texts()
    got = {}
    rows = periodic_runs.periodic_runs(documents(spark, texts))
    assert rows.columns == ["doc_id", "n_words", "runs", "collapsed"]
    for r in rows.collect():
        got.setdefault(r.doc_id, []).append((r.n_words, [tuple(x) for x in r.runs], r.collapsed))
    for i, t in texts:
        w = (t or "").encode().split()
        if len(w) > 2000:
            runs = [(30_000, 12_000, 3)]
        else:
            runs = brute_runs(w)
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        assert (len(w), runs, b" ".join(kept).decode()) in got[i], i


def test_periodic_runs_query(spark, tmp_path):
    texts = run_texts()
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    rows = periodic_runs.query(spark, str(tmp_path))
    got = sorted(repr(tuple(r)) for r in rows.collect())
    assert rows.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    want, sha, seen = [], lambda b: hashlib.sha256(b).hexdigest(), 0
    for i, t in texts:
        w = plant(i, (t or "").encode().split())
        seen += w != (t or "").encode().split()
        runs = brute_runs(w) if len(w) <= 2000 else [tuple(r) for r in periodic_runs.runs_of_words(w).tolist()]
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
        kept = [x for k, x in enumerate(w) if not any(s + q <= k < s + n for s, n, q in runs)]
        want.append(repr((i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()), sha(b" ".join(kept)))))
    assert got == sorted(want) and seen > 10


def test_periodic_runs_of_an_empty_table(spark):
    assert periodic_runs.periodic_runs(documents(spark, [])).count() == 0


def test_word_tokenizer_equals_whole_texts():
    from tokenizers import Tokenizer

    from pulsegrid.llm import packing

    rng = random.Random(1)
    bits = ["the ", "Straße ", "ΑΣ ", "étÉ, ", "\n", "²", "½", "x²", "語言", "🙂", "don't", "'s", " ", "...", "***", "<|endoftext|>", "é", "İ", "ſ", "ﬁ", "_", "12", "ab", "#", "　", "\x1c", "$$$ "]
    texts = ["".join(rng.choice(bits) for _ in range(40)) for _ in range(800)] + [""]
    for name, by_words in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        lib = Tokenizer.from_file(public_tokenizers.path(name))
        own = packing.WordTokenizer(public_tokenizers.path(name))
        assert own.by_words == by_words
        want = [np.array(lib.encode(t, add_special_tokens=False).ids, dtype="<u4").tobytes() for t in texts]
        assert own.ids([t.encode() for t in texts]) == want


HELPERS = ("_id", "_crc", "_zip", "_spans", "_stay", "_again", "_bad", "_leaks", "_bytes", "_score", "_clauses", "_kept_text", "_n_words", "_n_removed", "c0", "c1", "fp", "part")


def test_stages_carry_columns_of_any_name(spark, tmp_path):
    import corpus_pipeline

    w = lambda n, seed: " ".join(f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, n))
    texts = [w(40, 1), w(40, 1), w(30, 2) + " " + w(20, 3), w(20, 3) + " " + w(30, 4), None, ""]
    rows = [(*[f"h{i}" for i, _ in enumerate(HELPERS)], i, t, None if t is None else len(t), "en", "s") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ", ".join(f"`{h}` string" for h in HELPERS) + ", doc_id long, text string, n_chars long, lang string, source string")
    spark.createDataFrame([(0, 0)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "none of these words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all([r[h] for h in HELPERS] == [f"h{i}" for i, _ in enumerate(HELPERS)] for r in got) and len(got) >= 4, name
        if name == "substring_dedup":
            assert {r.doc_id: r.text for r in got}[3] == w(30, 4) and {r.doc_id: r.n_chars for r in got}[3] == len(w(30, 4))
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() == len(texts)


def test_license_query_with_null_and_negative_ids(spark, tmp_path):
    from pulsegrid.llm import license_scan

    rows = [(None, "Licensed under the Apache License, Version 2.0", "s"), (-7, "plain words", "s"), (50, "Licensed under the Apache License, Version 2.0", "s"), (51, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in license_scan.query(spark, str(tmp_path)).collect()}
    assert set(got) == {None, -7, 50, 51} and got[None].path is None and got[None].license is None and got[50].own_license


def test_encoding_batches_of_null_free_texts():
    import pyarrow as pa

    from pulsegrid.llm import packing

    own = packing.WordTokenizer(public_tokenizers.path("word_bpe_49k.json"))
    ids, at = own.encode(pa.array([b"", b" ", b"a b", b"a"], pa.binary()))
    assert at.tolist()[:3] == [0, 0, 0] and at[-1] == len(ids) == 3
    assert own.encode(pa.array([], pa.binary()))[1].tolist() == [0]
