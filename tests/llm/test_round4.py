"""What op9 sends to the driver and to its joins."""

import random

import numpy as np

from pulsegrid.llm import decontamination


def test_leaks_broadcast_no_table(spark):
    """Neither the listing of the items nor the windows of the documents, however small they look on disk."""
    rng = random.Random(4)
    text = lambda n: " ".join(f"w{rng.randrange(5000)}" for _ in range(n))
    items = [(i, text(14 + i % 3)) for i in range(60)]
    docs = [(d, f"{text(8)} {items[d][1]} {text(8)}") for d in range(0, 60, 7)]
    out = decontamination.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {(r.doc_id, r.item_id) for r in out.collect()} == {(d, d) for d in range(0, 60, 7)}


def test_listed_values_are_all_within_three_bits(spark):
    fps = [(1, 5, -1), (2, 5, 0x0123456789ABCDEF), (3, 7, 1 << 63 - 1), (4, 5, -1)]
    got = decontamination.listed_values(spark.createDataFrame(fps, "item_id long, n long, fp long"))
    assert set(got) == {5, 7}
    values = np.arange(1 << 16)
    for n, packed in got.items():
        own = np.unpackbits(np.frombuffer(packed, dtype=np.uint8), bitorder="little").reshape(4, -1)
        for block in range(4):
            away = [np.bitwise_count(values ^ (fp >> 16 * block & 0xFFFF)) for _, m, fp in fps if m == n]
            assert (own[block] == (np.min(away, axis=0) <= 3)).all()


def test_bitmap_of_shingles_in_pieces(spark):
    """Every shingle has its bit and no other has, over more and over fewer bits than one piece holds."""
    h = np.random.default_rng(2).integers(0, 1 << 63, 4000).astype("<u8")
    items = spark.createDataFrame([(h[:1500].tobytes(),), (h[1000:].tobytes(),)], "bag binary").repartition(2)
    for bits in (8, 16, 20):
        own = np.unpackbits(np.frombuffer(decontamination.shingle_filter(items, bits), dtype=np.uint8), bitorder="little")
        assert set(np.flatnonzero(own)) == set((h & np.uint64((1 << bits) - 1)).tolist()) and len(own) == 1 << bits
