"""Alignment of two tokenizers over a corpus, counted by inverted pair bitmaps.

Tokenizer A is a byte-level BPE (``tokenizers`` JSON), tokenizer B a SentencePiece BPE. Both encode a space and the text;
a *group* ends wherever tokens of both end, and its last A and B tokens are *linked*.

Documents are dealt into chunks of at most 4,096 documents (and about ``CHUNK_BYTES`` of text) as they are read. For
every (A id, B id) pair and chunk one compressed document bitmap is written: the non-zero 64-bit words with their
places, first a plane for "occurs here", then the binary digits of the further occurrences (multiplicity planes). Planes
of chunks are OR-merged by lying side by side (a document is in one chunk), so a pair's documents and links are sums of
popcounts over its rows. The postings then take the pair's score back to its chunk, where the bits name the documents.

Both encoders work word by word: no match of A's pattern and no piece of B's vocabulary crosses from a character that is
not white space to a following space or line feed (checked for B's vocabulary when it is loaded), so the text is cut there
and the alignment of each distinct word is made once and remembered. When there are more than ``MAX_WORDS``, those that were
met in one block only are forgotten.

Defined results: a null or empty text has no tokens, nor has a text with U+2581 or any other whose tokens do not spell
it; both give zeros and an empty ``groups``. Ids may be null or repeated (rows are counted on their own, each once). Very
long texts are whole; a chunk then holds one of them. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinfold.llm.storage import cut

TOKENIZER_A = "/opt/tokenizers/byte_bpe_50k.json"
TOKENIZER_B = "/opt/tokenizers/piece_bpe_32k.model"

#: A chunk's documents are numbered in 12 bits: 64 words of 64 bits.
CHUNK_DOCS = 1 << 12
CHUNK_BYTES = 1 << 24
BLOCK_BYTES = 1 << 20
#: Words remembered by a task; a word of more than LONG_WORD characters is not.
MAX_WORDS = 150_000
LONG_WORD = 48

# The split pattern of the byte-level tokenizer.
_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_SPACED = re.compile(r"\s[ \n]")
_B_BITS = 20


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes as they are, the rest from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Aligner:
    """Both tokenizers in one task, with the alignments of the words met so far."""

    def __init__(self, a_json: bytes, b_model: bytes):
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        spec = json.loads(a_json)
        special = {t["content"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
        self._a = tiktoken.Encoding("a", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._a_len = [0] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            self._a_len[i] = len(token)
        self._a_text = [str(i) for i in range(len(self._a_len))]
        self._b = sentencepiece.SentencePieceProcessor()
        self._b.LoadFromSerializedProto(b_model)
        self._b_bytes = []
        for i in range(self._b.get_piece_size()):
            piece = self._b.id_to_piece(i)
            if "▁" in piece.lstrip("▁") or "\n" in piece:
                raise ValueError(f"piece {piece!r} crosses from a word to a following space or line feed")
            self._b_bytes.append(bytes([int(piece[3:5], 16)]) if self._b.is_byte(i) else piece.replace("▁", " ").encode())
        if self._a.max_token_value >= 1 << 31 or len(self._b_bytes) >= 1 << _B_BITS:
            raise ValueError("vocabularies are too large for the pair key")
        self._b_len, self._b_text = [len(x) for x in self._b_bytes], [str(i) for i in range(len(self._b_bytes))]
        self._space = self._b.piece_to_id("▁")
        self._at: dict[str, int] = {}
        self._groups: list[str] = []
        self._counts: list[tuple[int, int, int, int]] = []
        self._pairs: list[list[int]] = []
        self._again = bytearray()

    def trim(self) -> None:
        """Keep the words that were met again, if there are too many words (between blocks only)."""
        if len(self._at) <= MAX_WORDS:
            return
        kept = [(w, i) for w, i in self._at.items() if self._again[i]]
        kept = kept if len(kept) <= MAX_WORDS // 2 else []
        self._at = {w: n for n, (w, _) in enumerate(kept)}
        for name in ("_groups", "_counts", "_pairs"):
            old = getattr(self, name)
            setattr(self, name, [old[i] for _, i in kept])
        self._again = bytearray(len(kept))

    def _align(self, text: str, a: list[int], b: list[int]) -> int:
        """Number of a new entry for ``text``, encoded as ``a`` and ``b``."""
        good = b"".join([self._b_bytes[y] for y in b]) == text.encode()
        groups, pairs = [], []
        if good:
            rest, in_a, in_b, at_a, at_b, y = iter(b), [], [], 0, 0, 0
            for x in a:
                in_a.append(self._a_text[x])
                at_a += self._a_len[x]
                while at_b < at_a:
                    y = next(rest)
                    in_b.append(self._b_text[y])
                    at_b += self._b_len[y]
                if at_a == at_b:
                    groups.append(f"{','.join(in_a)}|{','.join(in_b)}")
                    pairs.append(x << _B_BITS | y)
                    in_a, in_b = [], []
        self._groups.append(";".join(groups))
        self._counts.append((len(a), len(b), len(pairs), good))
        self._pairs.append(pairs)
        self._again.append(0)
        return len(self._groups) - 1

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Entries for new ``words``; those too long to remember are returned."""
        once: dict[str, int] = {}
        texts = [w if w[:1] in (" ", "\n") and w else " " + w for w in words]
        # B puts a space before what it is given; a line feed never joins it.
        coded = self._b.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        for w, t, b in zip(words, texts, coded, strict=True):
            if t[0] == "\n":
                b = b[1:] if b[0] == self._space else []
            (self._at if len(w) <= LONG_WORD else once)[w] = self._align(t, self._a.encode_ordinary(t), b)
        return once

    @staticmethod
    def _words(text: str) -> list[str]:
        """A space and ``text``, cut before each space or line feed that follows a character other than white space.

        A word that starts at a space is named without it, unless another space or a line feed comes next.
        """
        parts = text.replace("\n", " \n").split(" ")
        if len(parts) > 1 and not parts[-1]:
            # A last space stays with what it follows: B has no token for an empty word.
            parts[-2:] = [parts[-2] + " "]
        if not _SPACED.search(" " + text):
            return parts
        out: list[str] = []
        joined = False
        for part in parts:
            full = part if part[:1] == "\n" else " " + part
            if joined:
                out[-1] += full
            else:
                out.append(full)
            joined = out[-1][-1].isspace()
        return [w[1:] if w[0] == " " and w[1:2] not in (" ", "\n") else w for w in out]

    def block(self, texts: list[str]) -> tuple[list[tuple], np.ndarray, np.ndarray, np.ndarray]:
        """Figures of every text, and its links as arrays (index of the text, pair, how often), each pair of a text once."""
        words = [self._words(t) if t else [] for t in texts]
        at, before = self._at, len(self._groups)
        once = self._learn(list({w for doc in words for w in doc if w not in at}))
        found = [[at[w] if w in at else once[w] for w in doc] if once else [at[w] for w in doc] for doc in words]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.fromiter((i for f in found for i in f), np.int64, int(sizes.sum()))
        doc = np.repeat(np.arange(len(texts)), sizes)
        entry, place = np.unique(flat, return_inverse=True)
        for i in entry[entry < before].tolist():
            self._again[i] = 1
        counts = np.array([self._counts[i] for i in entry], np.int64).reshape(-1, 4)
        totals = np.zeros((len(texts), 4), np.int64)
        np.add.at(totals, doc, counts[place])
        good = totals[:, 3] == sizes
        figures = [(int(t[0]), int(t[1]), int(t[2]), hashlib.sha256(";".join([self._groups[i] for i in f]).encode()).hexdigest())
                   if f and ok else (0, 0, 0, "") for f, t, ok in zip(found, totals, good, strict=True)]
        # Each word of a text once, with its count; then the pairs of the words.
        use = good[doc]
        n = max(1, len(entry))
        seen, times = np.unique(doc[use] * n + place[use], return_counts=True)
        per = [self._pairs[i] for i in entry]
        lens = np.array([len(p) for p in per], np.int64)
        first = np.concatenate([[0], np.cumsum(lens)])
        pairs = np.fromiter((p for one in per for p in one), np.int64, int(first[-1]))
        d, e = seen // n, seen % n
        rep = lens[e]
        inside = np.arange(int(rep.sum())) - np.repeat(np.cumsum(rep) - rep, rep)
        of, pair = np.repeat(d, rep), pairs[np.repeat(first[e], rep) + inside]
        order = np.lexsort((pair, of))
        of, pair, times = of[order], pair[order], np.repeat(times, rep)[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (pair[1:] != pair[:-1])
        starts = np.flatnonzero(new)
        return figures, of[starts], pair[starts], np.add.reduceat(times, starts) if len(starts) else times


def bitmaps(doc: np.ndarray, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Compressed planes of a chunk: pairs, offsets of each pair's words, their places (plane * 64 + word) and the words.

    Plane 0 marks the documents of the pair; plane k + 1 those whose further occurrences have binary digit k.
    """
    uniq, row = np.unique(pair, return_inverse=True)
    bit = np.uint64(1) << (doc & 63).astype(np.uint64)
    keys, bits = [row << 20 | doc >> 6], [bit]
    more = times - 1
    for k in range(int(more.max(initial=0)).bit_length()):
        on = (more >> k & 1).astype(bool)
        keys.append((row << 20 | (k + 1) << 6 | doc >> 6)[on])
        bits.append(bit[on])
    key, bit = np.concatenate(keys), np.concatenate(bits)
    order = np.argsort(key, kind="stable")
    key, bit = key[order], bit[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
    words = np.bitwise_or.reduceat(bit, starts) if len(key) else bit
    offsets = np.searchsorted(key[starts] >> 20, np.arange(len(uniq) + 1))
    return uniq, offsets.astype(np.int32), (key[starts] & 0xFFFFF).astype(np.int16), words.view(np.int64)


def read_bits(place: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of words and their places: index of the word, document and how many occurrences it stands for, for every set bit."""
    on = np.flatnonzero(np.unpackbits(word.astype("<i8").view(np.uint8), bitorder="little"))
    at, plane = on >> 6, place[on >> 6].astype(np.int64) >> 6
    doc = (place[at].astype(np.int64) & 63) << 6 | on & 63
    return at, doc, np.where(plane == 0, 1, np.left_shift(1, np.maximum(plane - 1, 0)))


#: One table for both kinds of rows, so that the texts are encoded once: documents (``pair`` is null) and postings.
_ENCODED = T.StructType([
    T.StructField("chunk", T.LongType()), T.StructField("doc", T.IntegerType()), T.StructField("doc_id", T.LongType()),
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()),
    T.StructField("groups_sha256", T.StringType()), T.StructField("pair", T.LongType()),
    T.StructField("place", T.ArrayType(T.ShortType(), False)), T.StructField("word", T.ArrayType(T.LongType(), False))])


def _encode(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, tokenizer_a: str, tokenizer_b: str) -> DataFrame:
    """Rows of ``_ENCODED``: every document with its place in a chunk, and the postings of every pair and chunk."""
    files = spark.sparkContext.broadcast([open(path, "rb").read() for path in (tokenizer_a, tokenizer_b)])
    id_type = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("doc_id", id_type) if f.name == "doc_id" else f for f in _ENCODED.fields])
    kinds = pa.schema([("chunk", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.null()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                       ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()),
                       ("place", pa.list_(pa.int16())), ("word", pa.list_(pa.int64()))])

    def rows(id_kind: pa.DataType, n: int, **columns) -> pa.RecordBatch:
        types = [id_kind if f.name == "doc_id" else f.type for f in kinds]
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, t)
                                           for f, t in zip(kinds, types, strict=True)], names=kinds.names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(*files.value)
        chunk, docs_in, bytes_in, held = TaskContext.get().partitionId() << 36, 0, 0, []
        id_kind = pa.int64()

        def postings() -> pa.RecordBatch:
            doc, pair, times = (np.concatenate(x) for x in zip(*held, strict=True))
            uniq, offsets, place, word = bitmaps(doc, pair, times)
            n = len(uniq)
            return rows(id_kind, n, chunk=pa.array(np.full(n, chunk)), pair=pa.array(uniq),
                        place=pa.ListArray.from_arrays(pa.array(offsets), pa.array(place)),
                        word=pa.ListArray.from_arrays(pa.array(offsets), pa.array(word)))

        for batch in batches:
            id_kind, texts = batch.column(0).type, batch.column(1)
            start = 0
            while start < batch.num_rows:
                block, size = [], 0
                while start + len(block) < batch.num_rows and size < BLOCK_BYTES and docs_in + len(block) < CHUNK_DOCS:
                    block.append(texts[start + len(block)].as_py() or "")
                    size += len(block[-1])
                figures, doc, pair, times = aligner.block(block)
                aligner.trim()
                held.append((doc + docs_in, pair, times))
                n_a, n_b, n_groups, sha = (list(c) for c in zip(*figures, strict=True))
                yield rows(id_kind, len(block), chunk=pa.array([chunk] * len(block), pa.int64()),
                           doc=pa.array(range(docs_in, docs_in + len(block)), pa.int32()),
                           doc_id=batch.column(0).slice(start, len(block)), n_a=pa.array(n_a, pa.int64()),
                           n_b=pa.array(n_b, pa.int64()), n_groups=pa.array(n_groups, pa.int64()),
                           groups_sha256=pa.array(sha, pa.string()))
                start, docs_in, bytes_in = start + len(block), docs_in + len(block), bytes_in + size
                if docs_in >= CHUNK_DOCS or bytes_in >= CHUNK_BYTES:
                    yield postings()
                    chunk, docs_in, bytes_in, held = chunk + 1, 0, 0, []
        if held:
            yield postings()

    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema)


_LINKS = "aggregate(zip_with(place, word, (p, w) -> IF(p < 64, 1L, shiftleft(1L, (p >> 6) - 1)) * bit_count(w)), 0L, (s, x) -> s + x)"
_DOCS = "aggregate(zip_with(place, word, (p, w) -> IF(p < 64, CAST(bit_count(w) AS BIGINT), 0L)), 0L, (s, x) -> s + x)"


def _pair_counts(encoded: DataFrame) -> DataFrame:
    """``pair, docs, links``: popcounts of the pair's planes over all chunks."""
    return (encoded.where("pair IS NOT NULL").select("pair", F.expr(_DOCS).alias("docs"), F.expr(_LINKS).alias("links"))
            .groupBy("pair").agg(F.sum("docs").alias("docs"), F.sum("links").alias("links")))


def _scored(encoded: DataFrame, counts: DataFrame) -> DataFrame:
    """Documents of ``encoded`` with ``n_links, n_best, count_sum``: every posting takes its pair's score to its chunk."""
    b_id = F.expr(f"pair & {(1 << _B_BITS) - 1}")
    # One row per id of B's vocabulary: at most 2^20.
    best = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))
    scores = (counts.withColumn("b_id", b_id).join(F.broadcast(best), "b_id")
              .select("pair", "links", (F.col("links") == F.col("most")).alias("best")))
    postings = encoded.where("pair IS NOT NULL").select("chunk", "pair", "place", "word").join(scores, "pair")
    own = ["doc", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256"]
    meet = (postings.select("chunk", "place", "word", "links", "best")
            .unionByName(encoded.where("pair IS NULL").select("chunk", *own), allowMissingColumns=True)
            .repartition("chunk").sortWithinPartitions("chunk", F.col("doc").asc_nulls_first()))
    meet = meet.select("chunk", "place", "word", "links", "best", *own)
    kept = [encoded.schema[c] for c in own[1:]]
    schema = T.StructType(kept + [T.StructField(c, T.LongType()) for c in ("n_links", "n_best", "count_sum")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, score = None, np.zeros((3, CHUNK_DOCS), np.int64)
        for batch in batches:
            chunk = np.asarray(batch.column(0))
            cuts = np.flatnonzero(np.concatenate([[True], chunk[1:] != chunk[:-1]])).tolist() + [len(chunk)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if chunk[a] != here:
                    here = chunk[a]
                    score[:] = 0
                part = batch.slice(a, b - a)
                n_post = part.column(5).null_count
                post, rest = part.slice(0, n_post), part.slice(n_post)
                if n_post:
                    row = np.repeat(np.arange(n_post), np.asarray(post.column(1).value_lengths()))
                    at, doc, times = read_bits(np.asarray(post.column(1).flatten()), np.asarray(post.column(2).flatten()))
                    row = row[at]
                    np.add.at(score[0], doc, times)
                    np.add.at(score[1], doc, times * np.asarray(post.column(4).cast(pa.int8()))[row])
                    np.add.at(score[2], doc, times * np.asarray(post.column(3))[row])
                if rest.num_rows:
                    doc = np.asarray(rest.column(5))
                    yield pa.RecordBatch.from_arrays(list(rest.columns[6:]) + [pa.array(s[doc]) for s in score], names=schema.names)

    return meet.mapInArrow(run, schema)


def alignment(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              tokenizer_a: str = TOKENIZER_A, tokenizer_b: str = TOKENIZER_B) -> tuple[DataFrame, DataFrame]:
    """Documents with their figures, and the linked pairs of the corpus.

    Documents: the id, ``n_a, n_b, n_groups, groups_sha256, n_links, n_best`` (links whose pair is its B id's most frequent)
    and ``count_sum`` (sum of the pairs' counts over the links). Pairs: ``a_id, b_id, docs, links``.
    The texts are read and encoded once; the tokenizers' files are read on the driver and sent to the tasks (a few MB).
    """
    encoded = cut(spark, _encode(spark, docs, id_col, text_col, tokenizer_a, tokenizer_b), "token-pairs")
    counts = cut(spark, _pair_counts(encoded), "pair-counts")
    found = _scored(encoded, counts).withColumnRenamed("doc_id", id_col)
    pairs = counts.select(F.expr(f"pair >> {_B_BITS}").cast("int").alias("a_id"),
                          F.expr(f"pair & {(1 << _B_BITS) - 1}").cast("int").alias("b_id"), "docs", "links")
    return found, pairs
