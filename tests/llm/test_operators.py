"""Each operator against a brute-force version on small tables with nulls, empty and repeated rows, and extra columns."""

import base64
import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from pulsegrid.llm import decontamination, language_id, licence_templates, license_scan, packing, quality_rules, simhash_dedup, substring_dedup, toxicity, url_filters, warc
from pulsegrid.llm.graph import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _text string"


def words(n, seed=0):
    rng = np.random.default_rng(seed)
    return " ".join("w" + str(x) for x in rng.integers(0, 10**6, n))


@pytest.fixture(scope="module")
def texts():
    a, b, shared = words(80, 1), words(60, 2), words(20, 3)
    return [(7, a), (3, a), (9, b + " " + shared), (4, words(30, 4) + " " + shared + "\n" + words(30, 5)), (5, None), (6, ""), (8, "one two"), (None, a),
            (3, a), (10, words(20_000, 6) + " " + shared), (11, a.replace("w", "W")), (12, " \t\n"), (13, "x y z " * 60)]


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s1" if (i or 0) % 2 else None, 0, "clash") for i, t in texts], COLUMNS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def test_substring_dedup(docs, texts, empty):
    def windows(t):
        w = WORD.findall(t or "")
        return w, [tuple(w[j:j + 13]) for j in range(len(w) - 12)]

    first = {}
    for i, t in texts:
        for k in windows(t)[1]:
            first[k] = min(first.get(k, 10**9), 10**9 if i is None else i)
    want = []
    for i, t in texts:
        w, ks = windows(t)
        gone = np.zeros(len(w), dtype=bool)
        for j, k in enumerate(ks):
            if first[k] < (10**9 if i is None else i):
                gone[j:j + 13] = True
        want.append((i, None if t is None else " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), int(gone.sum())))
    rows = substring_dedup.drop_repeats(docs)
    assert rows.columns == [*docs.columns, "_kept_text", "_n_words", "_n_removed"]
    got = [(r.doc_id, r._kept_text, r._n_words, r._n_removed) for r in rows.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert substring_dedup.drop_repeats(empty).count() == 0


def brute_fingerprint(t):
    w = WORD.findall((t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    s = [" ".join(w[j:j + 3]) for j in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    ids = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = ids[i], ids[j]
                ids = [b if x == a else x for x in ids]
    return ids


def test_simhash_groups(docs, texts, empty):
    fps = [brute_fingerprint(t) for _, t in texts]
    group = brute_components(fps)
    least = {}
    for (i, _), g in zip(texts, group, strict=True):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    want = sorted(repr((i, f, least.get(g))) for (i, _), f, g in zip(texts, fps, group, strict=True))
    got = sorted(repr((r.doc_id, r.fp & (1 << 64) - 1, r.component_id)) for r in simhash_dedup.simhash_groups(docs).collect())
    assert got == want
    assert simhash_dedup.simhash_groups(empty).count() == 0


@pytest.mark.parametrize("dense", [2, 64])
def test_links_make_the_components_of_all_pairs(spark, dense):
    rng = np.random.default_rng(5)
    base = [int(x) for x in rng.integers(0, 1 << 63, 30)]
    fps = sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, n)) for b in base for n in (0, 1, 2, 2, 3, 5)})
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash_dedup.links(spark.createDataFrame([(f,) for f in signed], "fp long"), dense)
    root = {r.u: r.root for r in components(links).collect()}
    got, want = [root.get(f, f) for f in signed], brute_components(fps)
    assert len({*zip(got, want, strict=True)}) == len(set(got)) == len(set(want))


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 200)]
    got = {r.u: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and all(got[100 + i] == 100 for i in range(1, 30)) and 200 not in got


def test_keep_one(docs):
    ids = [r.doc_id for r in simhash_dedup.keep_one(docs).collect()]
    assert ids.count(3) == 1 and 7 not in ids and 11 not in ids and None in ids


def test_quality(docs, texts, empty):
    got = {(r.doc_id, r.n_words): r for r in quality_rules.repetition_rules(docs).collect()}
    for i, t in texts:
        w = WORD.findall(t or "")
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        tri = [tuple(w[j:j + 3]) for j in range(len(w) - 2)]
        many = Counter(tri)
        hit = {j + d for j, k in enumerate(tri) if many[k] > 1 for d in range(3)}
        r = got[i, len(w)]
        assert (r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 50 or 100 * len(hit) > 50 * len(w)) and not (r.base_failed and r.kept)
    assert quality_rules.repetition_rules(empty).count() == 0


def test_repetition_is_measured():
    line = words(12, 9)
    limits = quality_rules.Limits()
    assert quality_rules.measure((words(90, 8) + "\n" + line).encode(), limits)[6]
    assert not quality_rules.measure("\n".join([words(40, 8), line, words(5, 7), line, line]).encode(), limits)[6]


def test_repetitive_long_texts_are_refused_and_short_ones_forgiven_one_line():
    kept = lambda t: quality_rules.measure(t.encode(), quality_rules.Limits())[6]
    few, ten, line = [words(6, 100 + i) for i in range(30)], [words(10, 200 + i) for i in range(25)], words(12, 9)
    assert kept(words(1000, 8))
    assert not kept(" ".join([words(445, 8), *few, words(110, 7), *(x + " " + words(1, i) for i, x in enumerate(few))]))  # a fifth in 5-grams
    assert not kept(" ".join([words(1000, 8), *ten, *(x + " " + words(1, i) for i, x in enumerate(ten))]))  # 10-grams
    lines = [words(2, i) for i in range(12)]
    assert not kept("\n".join([words(30, 500 + i) for i in range(15)] + lines + lines))  # lines: 12 of 39
    assert kept("\n".join([words(40, 8), line, words(10, 7), line]))
    assert not kept("\n".join([words(40, 8), line, words(10, 7), line, line])) and not kept("\n".join([words(90, 8), words(30, 5), words(9, 7), words(30, 5)]))
    assert not kept("\n".join([words(300, 8), words(45, 5), words(9, 7), words(45, 5)]))


def test_packing(docs, texts, empty):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    rows = packing.pack(docs, path, capacity=512).collect()
    want = Counter(np.array([*own.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4").tobytes() for _, t in texts)
    pieces = {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    got = Counter()
    for (i, n), ps in pieces.items():
        copies = sum(j == i for j, _ in texts) if i == 3 else 1
        assert sum(len(p) for _, p in ps) == 4 * n * copies
        if copies == 1:
            got[b"".join(p for _, p in sorted(ps))] += 1
    assert all(want[k] >= v for k, v in got.items())
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert [n for _, n in sorted(fill.items())][:-1] == [512] * (len(fill) - 1)
    assert packing.pack(empty, path).count() == 0


def test_served_keeps_the_mixture():
    totals = np.array([1, 7, 1000, 333, 50_000])
    edges = np.minimum(np.arange(0, 52_000, 100), totals.sum())
    counts = packing.served(totals, edges)
    assert (counts.sum(axis=1) == edges).all() and (np.diff(counts, axis=0) >= 0).all()
    assert (np.abs(counts - edges[:, None] * totals / totals.sum()) < 1 + len(totals) / 2).all()


def test_tokenizer_gives_the_librarys_ids():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    hard = ["İstanbul ΣΊΣΥΦΟΣ naïve café été. <|endoftext|> it's can't... a,b c, D. 123 4.5", "日本語 テキスト。  x y \x1c z", "ß ẞ ŉ ǆ ﬁ Ǆ", "", "###$$$ token=\"24be\""]
    got = packing.WordTokenizer(path).ids([t.encode() for t in hard])
    assert [np.frombuffer(g, dtype="<u4").tolist() for g in got] == [own.encode(t, add_special_tokens=False).ids for t in hard]


def test_warc_rejects_records_inside_payloads(spark, tmp_path):
    fake = "WARC/1.1\r\nWARC-Record-ID: <urn:page:999>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    rows = [(i, f"http://a/{i}", x) for i, x in enumerate([None, "", fake, fake * 5, "x\r\n\r\n", "é" * 900, "a\nb\n" * 200, "WARC/1.0", "\r\n", "q"] * 2)] + [(None, None, "q")]
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    most = {}
    for i, _, h in rows:
        most[h or ""] = max(most.get(h or "", -1), -1 if i is None else i)
    want = [(i, len((h or "").encode()), digest(h), *(("response", None) if most[h or ""] == i else ("revisit", most[h or ""]))) for i, _, h in rows]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "900")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        warc.write_warc(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), str(tmp_path / "w"))
        got = [tuple(r) for r in warc.resolved(warc.read_warc(spark, str(tmp_path / "w"))).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_url_filter(spark):
    urls = [None, "", "nonsense", "http://A.Example.NET/en/1", "http://x.example.net/de/1", "http://net", "https://www.a.org/fr/", "http://a.org/p/?utm_x=1&b=2&a=1#f", "https://www.a.org/p.html?a=1&b=2",
            "http://notexample.com/de/1", "http://example.com/de/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    listed = spark.createDataFrame([("http://a.org/p?b=2&a=1",), (None,), ("http://a.org/p?b=2&a=1",)], "url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filters.url_filter(pages, listed).collect()}
    assert got == {0: ("", "", None, "allow"), 1: ("", "", None, "allow"), 2: ("", "", None, "allow"), 3: ("a.example.net", "/en/1", "example.net/en/", "allow"),
                   4: ("x.example.net", "/de/1", "net/", "block"), 5: ("net", "", None, "allow"), 6: ("www.a.org", "/fr/", "org/fr/", "allow"), 7: ("a.org", "/p/", None, "block"),
                   8: ("www.a.org", "/p.html", None, "block"), 9: ("notexample.com", "/de/1", None, "allow"), 10: ("example.com", "/de/1", "example.com/de/", "block")}


def test_leaks(spark, docs, empty):
    item, longer = words(30, 21), words(60, 22)
    changed = longer.split()
    changed[-1] = "other"
    rows = [(1, words(50, 23) + " " + item.upper() + " " + words(9, 24)), (2, words(40, 25)), (3, " ".join(changed)), (4, item[:len(item) // 2]), (None, item), (6, None)]
    items = spark.createDataFrame([(10, item), (11, longer), (12, "too short"), (13, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.first_word, r.n_words) for r in decontamination.leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 10): (50, 30), (3, 11): (0, 59), (None, 10): (0, 30)}
    assert decontamination.leaks(empty, items).count() == 0 and decontamination.leaks(docs, items.limit(0)).count() == 0


def test_language(spark, empty):
    a, b = "the thing that then with whether ", "der die das nicht schon ein "
    rows = [(i, (a if i % 2 else b) * 3, "en" if i % 2 else "de") for i in range(60)] + [(100, None, "en"), (101, "123 ...", None), (None, a, "de")]
    got = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i][0] == ("en" if i % 2 else "de") and 0.8 < got[i][1] <= 1 for i in range(60)) and got[100] == got[101] == ("und", 0.0) and got[None][0] == "en"
    assert language_id.identify(empty).count() == 0


def test_toxicity(spark, empty):
    rows = [(i, ("you are a zargon, " if i % 4 == 0 else "what a fine day, ") + words(20, i)) for i in range(200)] + [(300, None), (None, "zargon"), (301, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    grammar = toxicity.learn(docs, labels)
    assert grammar.class_of("zargon") == toxicity.INSULT
    got = {r.doc_id: r._score for r in toxicity.with_scores(docs, grammar).collect()}
    assert all((got[i] >= 0.5) == (i % 4 == 0) for i in range(200)) and got[300] == got[301] < 0.5
    assert toxicity.with_scores(empty, toxicity.learn(empty, labels.limit(0))).count() == 0


def test_grammar_reads_clauses():
    g = toxicity.plain_grammar()
    assert set(g.matches("You are an idiot.")) == {"insult|aimed"} and set(g.matches("He said: fine. She is not stupid")) == {"insult|negated"}
    assert set(g.matches("They wrote that idiot again")) == {"insult|reported"} and not g.matches("kill the process") and set(g.matches("I will kill you")) == {"threat|aimed"}
    assert g.score("you idiot") > g.score("an idiot") > g.score("not an idiot")


def test_licenses(spark):
    mit, gpl = license_scan.TEMPLATES["MIT"], license_scan.TEMPLATES["GPL-3.0"]
    rows = [("LICENSE", mit), ("a/LICENSE.txt", "nothing known here"), ("a/x.py", words(30, 1)), ("a/b/COPYING", gpl), ("a/b/c/d.py", "print"), ("a/b/c/e.py", "# x\n" + mit.lower() + "\nbody"),
            ("z.py", None), (None, mit), ("a/b/c/d.py", "print")]
    got = sorted(map(repr, [(r.path, r.own_license, r.license, r.inherited_from) for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()]))
    want = [("LICENSE", "MIT", "MIT", None), ("a/LICENSE.txt", None, "MIT", ""), ("a/x.py", None, "MIT", ""), ("a/b/COPYING", "GPL-3.0", "GPL-3.0", None), ("a/b/c/d.py", None, "GPL-3.0", "a/b"),
            ("a/b/c/e.py", "MIT", "MIT", None), ("z.py", None, "MIT", ""), (None, None, None, None), ("a/b/c/d.py", None, "GPL-3.0", "a/b")]
    assert got == sorted(map(repr, want))


def test_license_similarity_is_the_cosine_with_counted_frequencies(spark):
    gpl = license_scan.TEMPLATES["GPL-3.0"]
    notice = "this is one of the files in this work: " + gpl
    rows = [("x.py", notice + "\n" + words(5, 1)), *((f"{i}.txt", "this is one of the lines in the files\n" + words(9, i)) for i in range(60))]
    split = lambda t: re.findall(r"[^\W_]+", t.lower())
    lines = [split(x) for _, t in rows for x in t.split("\n")]
    idf = lambda w: np.log((1 + len(lines)) / (1 + sum(w in x for x in lines))) + 1
    a, b = ({w: n * idf(w) for w, n in Counter(split(t)).items()} for t in (notice, gpl))
    want = sum(x * b.get(w, 0) for w, x in a.items()) / (sum(x * x for x in a.values()) * sum(x * x for x in b.values())) ** 0.5
    got = {r.path: r for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string"), templates=license_scan.TEMPLATES).collect()}
    assert want > 0.7 and got["x.py"].own_license == "GPL-3.0" and abs(got["x.py"].similarity - want) < 1e-6
    assert all(r.own_license is None for p, r in got.items() if p != "x.py")


def test_license_titles_headers_texts_and_wrapped_notices(spark):
    texts = dict(licence_templates.full_texts())
    header = dict(licence_templates.HEADERS)
    code = "\n".join(words(6, i) for i in range(40))

    def wrapped(t, n=9):
        w = t.split()
        return "\n".join("# " + " ".join(w[i:i + n]) for i in range(0, len(w), n))

    cases = {f"{k}/LICENSE": (x, k) for k, x in texts.items()}
    cases |= {"1.py": ("MIT License\n" + code, "MIT"), "2.py": ("GNU GENERAL PUBLIC LICENSE\n" + code, "GPL"), "3.py": ("Apache License\n" + code, "Apache-2.0"),
              "4.py": ("# SPDX-License-Identifier: MIT\n" + code, "MIT"), "5.py": ("# SPDX-License-Identifier: Zlib\n" + code, None), "6.py": (code, None),
              "7.py": (wrapped(header["Apache-2.0"]) + "\n" + code, "Apache-2.0"), "8.py": (code + "\n" + wrapped(header["MIT"]) + "\n" + code, "MIT"),
              "9.py": (wrapped(header["AGPL-3.0"]) + "\n" + code, "AGPL-3.0"), "10.py": (code + "\n" + wrapped(license_scan.TEMPLATES["GPL-2.0"], 6) + "\n" + code, "GPL-2.0"),
              "11.py": ("// Licensed under the Apache License, Version 2.0 (the \"License\"); you\n// may not use this file except in compliance with the License.\n" + code, "Apache-2.0"),
              "12.py": (texts["MIT"] + "\n" + code, "MIT"), "13.py": ("mit\n" + code, None)}
    rows = [(p, t) for p, (t, _) in cases.items()] + [(f"{i}.txt", words(9, i) + "\n" + words(5, 900 + i)) for i in range(200)]
    got = {r.path: r.own_license for r in license_scan.license_scan(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert {p: got[p] for p in cases} == {p: k for p, (_, k) in cases.items()}
    assert all(got[f"{i}.txt"] is None for i in range(200))
