"""Token counts of whole texts: huge documents are encoded in overlapping chunks whose counts are spliced where both encodings provably agree.

A document longer than a chunk becomes rows of overlapping slices, dealt to all tasks. Each slice is encoded on its own and reports, for its two overlaps, where
tokens begin. The slices' ends are wrong, as a tokenizer looks at what stands beside; but where two encodings have a boundary in common, and the same
token after it, they are cut there:

* Pieces merged by rank. A sequence of tokens is the encoding of its text if and only if every two neighbours are the encoding of theirs: the first merge to cross a
  boundary would cross it in the two neighbours alone as well. All neighbours left of the cut are neighbours in the left encoding, all right of it in the right one, and the pair at the
  cut stands in both. So the splice is the encoding of the whole.
* Words cut by a pattern read from left to right, then merged inside words. What follows a word's begin does not depend on what was before. A begin common to both
  encodings, with the same word after it and a further word in the left one, is a begin in the whole text, if the character there is plain ASCII (no normalisation reaches across it).

Where an overlap has no such boundary, the document is cut again with overlaps eight times as wide, and in the end as one slice.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.llm.common import BATCH_BYTES, map_arrow, table, utf8
from pulsegrid.sources.stage import materialise

LIMIT = 4096
CHUNK = 32_768
"""Characters of a slice, and the longest text that is encoded in one go."""
OVERLAP = 512
WIDER = 8


class Pieces:
    """A sentencepiece model."""

    def __init__(self, path: str) -> None:
        import sentencepiece as sp

        self.model = sp.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.whole_only = {i for i in range(size) if self.model.is_byte(i) or self.model.is_unknown(i) or self.model.is_control(i)}
        self.splices = self._by_rank() and not any(self.model.is_unused(i) for i in range(size))

    def _by_rank(self) -> bool:
        """Are pieces merged by rank, without a normalizer and symbols of the user's?"""
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(self.model.serialized_model_proto())
        plain = m.normalizer_spec.name == "identity" and not m.normalizer_spec.remove_extra_whitespaces and not m.trainer_spec.treat_whitespace_as_suffix
        return m.trainer_spec.model_type == pb.TrainerSpec.BPE and plain and not any(p.type == pb.ModelProto.SentencePiece.USER_DEFINED for p in m.pieces)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]

    def marks(self, text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
        """Number of tokens, and (begin, id, end, number) of those a splice can begin with."""
        got = self.model.encode(text, return_type="offset_mapping")
        ids, spans = got["ids"], got["offsets"]
        return len(ids), [(a, t, b, k) for k, (t, (a, b)) in enumerate(zip(ids, spans, strict=True))
                          if k and a < b and t not in self.whole_only and ids[k - 1] not in self.whole_only and spans[k - 1][1] == a]


class Words:
    """A tokenizer that cuts words by a pattern and merges pieces inside words."""

    NORMAL = {"NFC", "NFD", "NFKC", "NFKD", "Lowercase"}

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.no_truncation()
        self.model.no_padding()
        self.splices = self._by_words(json.loads(self.model.to_str()))

    def _by_words(self, spec: dict) -> bool:
        steps = lambda x, inner: [y for z in x[inner] for y in steps(z, inner)] if x and x["type"] == "Sequence" else [x] if x else []
        space = lambda x: x["type"] == "Replace" and x["pattern"] == {"Regex": "\\s+"} and x["content"] == " "
        cuts = steps(spec["pre_tokenizer"], "pretokenizers")
        return (spec["model"]["type"] == "BPE" and bool(cuts) and all(x["type"] in self.NORMAL or space(x) for x in steps(spec["normalizer"], "normalizers"))
                and all(x["type"] == "Split" or x["type"] == "ByteLevel" and not x["add_prefix_space"] for x in cuts)
                and not any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in spec["added_tokens"]))

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.model.encode_batch(texts, add_special_tokens=False)]

    def marks(self, text: str) -> tuple[int, list[tuple[int, int, int, int]]]:
        got = self.model.encode(text, add_special_tokens=False)
        ids, spans, words = got.ids, got.offsets, got.word_ids
        begins = [k for k in range(len(ids)) if words[k] is not None and (not k or words[k] != words[k - 1])]
        out = []
        for k, after in zip(begins[1:], begins[2:], strict=False):
            a, b = spans[k][0], spans[after - 1][1]
            if a < b <= spans[after][0] and text[a].isascii() and not (text[a].isspace() and text[a - 1].isspace()):
                out.append((a, ids[k], b, k))
        return len(ids), out


@functools.cache
def library(path: str) -> Pieces | Words:
    return Words(path) if path.endswith(".json") else Pieces(path)


MARK = "array<struct<at:long,id:long,stop:long>>"
SLICES = "key long, doc_id long, n_bytes long, chunk long, chunks long, at long, _text string"
ENCODED = f"key long, doc_id long, n_bytes long, chunk long, n long, head {MARK}, head_number array<long>, tail {MARK}, tail_number array<long>"


def slices_of(rows: DataFrame, size: int, overlap: int) -> DataFrame:
    """(key, doc_id, n_bytes, text) -> a row per slice of `size` characters, each sharing `overlap` with the next."""
    step = size - overlap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in SLICES.split(", ")]
        types = [pa.int64()] * 6 + [pa.string()]
        for batch in batches:
            for key, doc, n_bytes, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "n_bytes", "_text")), strict=True):
                chunks = max(1, -(-(len(text) - overlap) // step))
                for first in range(0, chunks, group := max(1, BATCH_BYTES // size)):
                    out = [(key, doc, n_bytes, k, chunks, k * step, text[k * step:k * step + size]) for k in range(first, min(chunks, first + group))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return rows.mapInArrow(run, SLICES)


def encoded(slices: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """The slices' token numbers and where tokens begin in the overlaps, by places in the whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        lib, out = library(path), []
        for r in batch.to_pylist():
            n, marks = lib.marks(r["_text"])
            at, sides = r["at"], []
            for use, low, high in ((r["chunk"] > 0, 0, overlap), (r["chunk"] < r["chunks"] - 1, size - overlap, size)):
                own = [m for m in marks if use and low < m[0] < high]
                sides += [{"at": at + a, "id": t, "stop": at + b} for a, t, b, _ in own], [m[3] for m in own]
            out.append({"key": r["key"], "doc_id": r["doc_id"], "n_bytes": r["n_bytes"], "chunk": r["chunk"], "n": n,
                        "head": sides[0], "head_number": sides[1], "tail": sides[2], "tail_number": sides[3]})
        mark = pa.list_(pa.struct([("at", pa.int64()), ("id", pa.int64()), ("stop", pa.int64())]))
        kinds = {"head": mark, "tail": mark, "head_number": pa.list_(pa.int64()), "tail_number": pa.list_(pa.int64())}
        return pa.RecordBatch.from_pylist(out, schema=pa.schema([(c, kinds.get(c, pa.int64())) for c in ("key", "doc_id", "n_bytes", "chunk", "n", "head", "head_number", "tail", "tail_number")]))

    return map_arrow(slices, run, ENCODED)


def spliced(rows: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(key, doc_id, n_bytes, n_tokens, ok): the counts of documents cut into slices; not ok if an overlap holds no proven boundary."""
    cut = slices_of(rows, size, overlap)
    parts = materialise(encoded(cut.repartition("key", "chunk"), path, size, overlap), "token-slices")
    left = parts.select("key", "doc_id", "n_bytes", (F.col("chunk") + 1).alias("seam"), "n", "tail", "tail_number")
    right = parts.where("chunk > 0").select("key", F.col("chunk").alias("seam"), "head", "head_number")
    common = F.try_element_at(F.array_intersect("tail", "head"), F.lit(1))
    seams = left.join(right, ["key", "seam"]).withColumn("mark", common)
    number = lambda side: F.try_element_at(f"{side}_number", F.array_position(side, F.col("mark")).cast("int"))
    lost = F.when(F.col("mark").isNotNull(), F.col("n") - number("tail") + number("head"))
    cells = parts.select("key", "doc_id", "n_bytes", F.col("n").alias("tokens"), F.lit(True).alias("ok")).unionByName(
        seams.select("key", "doc_id", "n_bytes", (-lost).alias("tokens"), F.col("mark").isNotNull().alias("ok")))
    return cells.groupBy("key", "doc_id", "n_bytes").agg(F.sum("tokens").alias("n_tokens"), F.bool_and("ok").alias("ok"))


def token_counts(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", limit: int = LIMIT, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row, as the tokenizer's library counts the whole text.

    Null and empty texts have no bytes and the library's count for an empty text. Repeated rows come back as often, a null doc_id is carried, other
    columns are not read, an empty table gives no rows. Texts of over `chunk` characters are encoded in slices in parallel; with tokenizers for which no boundary can be proven
    (not merged by rank, or words not cut by patterns) every text is encoded in one go.
    """
    if not 0 < 3 * overlap < chunk:
        raise ValueError("a slice must be longer than three overlaps")
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(utf8(text)).cast("long").alias("n_bytes"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = library(path).counts(batch.column("_text").to_pylist())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    huge = (F.length("_text") > chunk) & F.lit(library(path).splices)
    out = map_arrow(rows.where(~huge), run, "doc_id long, n_bytes long, n_tokens long")
    todo = materialise(rows.where(huge).select(F.monotonically_increasing_id().alias("key"), "doc_id", "n_bytes", "_text"), "huge-texts")
    while True:
        counts = materialise(spliced(todo, path, chunk, overlap), "token-counts")
        out = out.unionByName(counts.where("ok").select("doc_id", "n_bytes", "n_tokens"))
        failed = counts.where("not ok").select("key")
        if failed.isEmpty():
            break
        todo = todo.join(failed, "key", "left_semi")
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
