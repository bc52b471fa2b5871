"""Alignment of the tokens of two tokenizers over a corpus, as an Arrow pipeline.

A slice of documents is a column of words per document and a column of ids per word: flattened, with
the indices of their parents. Segmented running sums of the tokens' bytes give each token's end in its
document; an Acero hash join of both sides on (document, end) finds where both end. In order, the ends
of either side are the links: each ends a stretch of bytes that one token of either side covers.
Counts of linked id pairs are grouped per document and per slice in Arrow, and Spark merges the
slices' counts over the corpus and looks them up for every document.

Texts are cut at a single space between characters other than white space. Neither tokenizer joins
anything across it, so each different word is encoded once, and the ids of a text are those of its
words in a row.
"""

import hashlib
import json
import re

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintlake.llm.common import stored, table

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")
#: Words whose ids a Python worker keeps; beyond that it starts anew.
CACHED_WORDS = 600_000
#: New words that are encoded in one go.
TOGETHER = 5_000
#: Characters of text that are aligned at a time; a longer text is a slice of its own.
SLICE = 1_000_000
#: Counts of at most so many id pairs (24 bytes each) are sent to all tasks; more are joined by key.
SENT_PAIRS = 1_000_000

BETWEEN_WORDS = re.compile(r"(?<=\S) (?=\S)")
#: Bits for a byte offset in a document, in keys of (document, end).
END_BITS = 36

FOUND = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<int>, times array<int>"
)

_sides: dict = {}


def byte_values() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: printable Latin-1
    characters stand for themselves, the other bytes for those from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteSide:
    """Ids by the byte-level tokenizer, and the bytes of each id.

    Words of characters below U+0250, whose kinds (letter, digit, white space) are the same in every
    Unicode version, are encoded by a faster library from the same vocabulary. It takes ids for
    ranks, so it is used only if ids rise with the merges."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        value, vocabulary = byte_values(), self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(map(value.__getitem__, token)) if set(token) <= value.keys() else b""
        merges = json.loads(self.tokenizer.to_str())["model"]["merges"]
        ranks = [vocabulary.get("".join(m)) for m in merges]
        single = {self.bytes[i] for i in vocabulary.values() if len(self.bytes[i]) == 1}
        self.fast = None
        if None not in ranks and ranks == sorted(set(ranks)) and len(single) == 256:
            known = {x: i for i, x in enumerate(self.bytes) if len(x) == 1 or i >= ranks[0]}
            known.pop(b"", None)
            self.fast = tiktoken.Encoding(
                path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=known, special_tokens={}
            )

    def ids(self, text: str) -> list[int]:
        if self.fast and (text.isascii() or max(text) < "\u0250"):
            return self.fast.encode_ordinary(" " + text)
        return self.tokenizer.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids


class PieceSide:
    """Ids by the sentence-piece tokenizer, which puts the space before a text itself."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if any(re.search("[^▁]▁", p) for p in pieces):
            raise ValueError("a piece reaches over a space behind a word: words can't be encoded alone")
        self.bytes = [
            bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode()
            for i, p in enumerate(pieces)
        ]

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text, num_threads=1)


class Aligner:
    """Both sides, and the ids of known words, or that the ids' bytes differ from the word's."""

    def __init__(self, byte_bpe: str, piece_bpe: str):
        self.sides = ByteSide(byte_bpe), PieceSide(piece_bpe)
        self.widths = [np.array([len(x) for x in s.bytes]) for s in self.sides]
        self.tokens = [pa.array(s.bytes, pa.binary()) for s in self.sides]
        self.n_b = len(self.widths[1])
        if len(self.widths[0]) * self.n_b >= 1 << 31:
            raise ValueError("an id pair doesn't fit in an int")
        self.forget()
        a, b = (map(str, range(len(w))) for w in self.widths)
        # What a token adds to the text of groups: within, at the end of its side of a group, and
        # of the document's last group.
        shown = [x + end for x in a for end in ",|"]
        self.from_b = len(shown)
        self.shown = pa.array(shown + [x + end for x in b for end in (",", ";", "")], pa.binary())

    def forget(self) -> None:
        """Known words are numbered; ids of all lie one behind the other, on either side."""
        self.known: dict[str, int] = {}
        self.wrong = np.empty(0, bool)
        self.flat = [np.empty(0, np.int32) for _ in self.sides]
        self.upto = [np.zeros(1, np.int32) for _ in self.sides]

    def numbers(self, words: list[str]) -> np.ndarray:
        """The numbers of different words, after learning the new ones."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > CACHED_WORDS:
            self.forget()
            new = words
        if new:
            plain, other, edged = [], [], []
            for word in new:
                if word[0].isspace() or word[-1].isspace():
                    edged.append(word)
                else:
                    (plain if word.isascii() or max(word) < "\u0250" else other).append(word)
            # White space at an edge would run together with the space between words.
            parts = [
                x for some, n in ((plain, TOGETHER), (other, TOGETHER), (edged, 1))
                for i in range(0, len(some), n) for x in self._encoded(some[i : i + n])
            ]
            order = [word for part in parts for word in part[0]]
            self.known.update(zip(order, range(len(self.known), len(self.known) + len(order)), strict=True))
            self.wrong = np.concatenate([self.wrong, *[part[1] for part in parts]])
            for side in range(2):
                self.flat[side] = np.concatenate([self.flat[side], *[part[2][side] for part in parts]])
                sizes = np.concatenate([part[3][side] for part in parts])
                after = self.upto[side][-1] + np.cumsum(sizes)
                self.upto[side] = np.concatenate([self.upto[side], after]).astype(np.int32)
        return np.fromiter(map(self.known.__getitem__, words), np.int64, len(words))

    def _encoded(self, words: list[str]):
        """Encodes words as one text, halves for themselves if that doesn't give their bytes: parts
        of words, whether they are spelt wrongly, and for either side ids and numbers of ids."""
        text = " ".join(words)
        data = (" " + text).encode()
        sizes = [len(w) + 1 if w.isascii() else len(w.encode()) + 1 for w in words]
        ends, found, counts = np.cumsum(sizes), [], []
        for side, widths, tokens in zip(self.sides, self.widths, self.tokens, strict=True):
            ids = np.array(side.ids(text), np.int32)
            upto = np.cumsum(widths[ids])
            last = np.searchsorted(upto, ends)
            right = len(ids) and upto[-1] == len(data) and bool((upto[last] == ends).all())
            if right:
                right = tokens.take(pa.array(ids)).buffers()[2].to_pybytes()[: len(data)] == data
            if not right:
                half = len(words) // 2
                if half:
                    return self._encoded(words[:half]) + self._encoded(words[half:])
                nothing = [np.empty(0, np.int32)] * 2, [np.zeros(1, np.int64)] * 2
                return [(words, np.ones(1, bool), *nothing)]
            counts.append(np.diff(last + 1, prepend=0))
            found.append(ids)
        return [(words, np.zeros(len(words), bool), found, counts)]

    def ids_of(self, side: int, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words on a side, and the place of each id's word."""
        lists = pa.ListArray.from_arrays(pa.array(self.upto[side]), pa.array(self.flat[side]))
        taken = lists.take(pa.array(words))
        return pc.list_flatten(taken).to_numpy(), pc.list_parent_indices(taken).to_numpy()


def aligner(byte_bpe: str, piece_bpe: str) -> Aligner:
    if (byte_bpe, piece_bpe) not in _sides:
        _sides[byte_bpe, piece_bpe] = Aligner(byte_bpe, piece_bpe)
    return _sides[byte_bpe, piece_bpe]


def _ends(widths: np.ndarray, ids: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
    """(document, end) of each token as one number: running sums that start anew per document."""
    upto = pc.cumulative_sum(pa.array(widths[ids])).to_numpy()
    sums = np.bincount(doc, widths[ids], docs).astype(np.int64)
    return (doc.astype(np.int64) << END_BITS) + upto - (np.cumsum(sums) - sums)[doc]


def _links(keys, ids) -> tuple[np.ndarray, ...]:
    """Of all ends in order: document, id on either side, and which sides have a token end there."""
    left, right = (
        pa.table({"key": k, name: i.astype(np.int32)})
        for k, i, name in zip(keys, ids, "ab", strict=True)
    )
    both = left.join(right, "key", join_type="full outer", use_threads=False)
    both = both.take(pa.array(np.argsort(both["key"].to_numpy(), kind="stable"))).combine_chunks()
    a, b = (both[c].combine_chunks() if both.num_rows else pa.array([], pa.int32()) for c in "ab")
    in_a, in_b = (x.is_valid().to_numpy(zero_copy_only=False) for x in (a, b))
    a, b = (pc.fill_null_backward(x).to_numpy() for x in (a, b))
    return both["key"].to_numpy() >> END_BITS, a, b, in_a, in_b


def _digests(tool: Aligner, doc, a, b, in_a, in_b, docs: int) -> list[str]:
    """The digest of each document's groups as text; empty without tokens."""
    common = in_a & in_b
    group = np.cumsum(common) - common
    last = np.append(doc[1:] != doc[:-1], True)
    groups = int(group[-1]) + 1 if len(group) else 0
    group_a, group_b = group[in_a], group[in_b]
    sizes = [np.bincount(g, minlength=groups) for g in (group_a, group_b)]
    upto_a, upto_b = (np.cumsum(s) for s in sizes)
    place = np.empty(len(group_a) + len(group_b), np.int64)
    place[: len(group_a)] = np.arange(len(group_a)) + (upto_b - sizes[1])[group_a]
    place[len(group_a) :] = np.arange(len(group_b)) + upto_a[group_b]
    code = np.empty(len(place), np.int64)
    code[place[: len(group_a)]] = 2 * a[in_a] + common[in_a]
    code[place[len(group_a) :]] = tool.from_b + 3 * b[in_b] + common[in_b] + (common & last)[in_b]
    text = tool.shown.take(pa.array(code))
    at = np.frombuffer(text.buffers()[1], np.int32)[: len(code) + 1] if len(code) else np.zeros(1, int)
    tokens = np.bincount(doc[in_a], minlength=docs) + np.bincount(doc[in_b], minlength=docs)
    cuts = at[np.concatenate([[0], np.cumsum(tokens)])].tolist()
    data = memoryview(text.buffers()[2]) if len(code) else b""
    pairs = zip(cuts, cuts[1:], strict=False)
    return [hashlib.sha256(data[s:e]).hexdigest() if e > s else "" for s, e in pairs]


def _lists(counted: pa.Table, docs: int) -> list[pa.Array]:
    """Pairs and times of each document as lists."""
    order = np.argsort(counted["doc"].to_numpy(), kind="stable")
    sizes = np.bincount(counted["doc"].to_numpy(), minlength=docs)
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
    return [
        pa.ListArray.from_arrays(offsets, pa.array(counted[c].to_numpy()[order], pa.int32()))
        for c in ("pair", "times")
    ]


def aligned(tool: Aligner, texts: list[str | None]) -> dict[str, pa.Array]:
    """n_a, n_b, n_groups, n_links, groups_sha256, pairs and times of each text."""
    docs = len(texts)
    words = [BETWEEN_WORDS.split(text) if text else [] for text in texts]
    parent = np.repeat(np.arange(docs), [len(w) for w in words])
    flat = pa.array([w for of_text in words for w in of_text], pa.string()).dictionary_encode()
    place = tool.numbers(flat.dictionary.to_pylist())[flat.indices.to_numpy()]
    wrong = tool.wrong[place]
    if wrong.any():  # those texts have no tokens at all
        right = ~np.isin(parent, parent[wrong])
        parent, place = parent[right], place[right]
    ids, doc, keys = [], [], []
    for side in range(2):
        own, of_word = tool.ids_of(side, place)
        ids.append(own)
        doc.append(parent[of_word])
        keys.append(_ends(tool.widths[side], own, doc[-1], docs))
    at, a, b, in_a, in_b = _links(keys, ids)
    pair = a.astype(np.int64) * tool.n_b + b
    counted = pa.table({"doc": at, "pair": pair}).group_by(["doc", "pair"], use_threads=False)
    counted = counted.aggregate([([], "count_all")]).rename_columns(["doc", "pair", "times"])
    numbers = [np.bincount(x, minlength=docs) for x in (*doc, at[in_a & in_b], at)]
    columns = [pa.array(x, pa.int64()) for x in numbers]
    columns.append(pa.array(_digests(tool, at, a, b, in_a, in_b, docs), pa.string()))
    return dict(
        zip(
            ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"],
            [*columns, *_lists(counted, docs)],
            strict=True,
        )
    )


def _slices(batch: pa.RecordBatch):
    """Parts of a batch with about SLICE bytes of text."""
    sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy()
    part = (np.cumsum(sizes) - sizes) // SLICE
    cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), batch.num_rows)
    for i, j in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(i, j - i)


def _found(byte_bpe: str, piece_bpe: str):
    """A function from batches of documents to a row for each, and for every slice a row without
    `row` that holds the slice's counts of id pairs."""

    def run(batches):
        tool, seen = aligner(byte_bpe, piece_bpe), 0
        part = TaskContext.get().partitionId()
        for batch in batches:
            for piece in _slices(batch):
                n = piece.num_rows
                got = aligned(tool, piece.column("text").to_pylist())
                row = (part << 40) + seen + np.arange(n)
                seen += n
                whole = {"row": pa.array(row), "doc_id": piece.column("doc_id").cast(pa.int64()), **got}
                yield pa.RecordBatch.from_pydict(whole)
                pairs = pa.table({c: pc.list_flatten(got[c]) for c in ("pairs", "times")})
                sums = pairs.group_by("pairs", use_threads=False).aggregate([("times", "sum")])
                only = {c: pa.nulls(1, x.type) for c, x in whole.items()}
                for c, name in (("pairs", "pairs"), ("times", "times_sum")):
                    only[c] = pa.array([sums[name].to_numpy()], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(only)

    return run


def alignments(
    docs: DataFrame, byte_bpe: str = BYTE_BPE, piece_bpe: str = PIECE_BPE, sent: int = SENT_PAIRS
) -> DataFrame:
    """A row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Null or empty text, or one that either side's tokens don't spell: zeros and an empty string.
    Null and repeated doc_ids: each row for itself. No rows: none. Other columns are not looked
    at. Up to `sent` different id pairs, their counts are broadcast; beyond, they are joined by
    key, with the same result."""
    n_b = len(aligner(byte_bpe, piece_bpe).widths[1])
    found = stored(
        docs.select("doc_id", "text").mapInArrow(_found(byte_bpe, piece_bpe), FOUND), "alignments"
    )
    slices = found.where("row is null")
    totals = (
        slices.select(F.inline(F.arrays_zip("pairs", "times"))).groupBy("pairs").agg(F.sum("times").alias("total"))
    )
    by_b = totals.withColumn("_b", F.col("pairs") % n_b)
    highest = by_b.groupBy("_b").agg(F.max("total").alias("_most"))
    counts = stored(
        by_b.join(highest, "_b").select("pairs", "total", (F.col("total") == F.col("_most")).alias("best")),
        "pair-counts",
    )
    if counts.count() <= sent:
        counts = F.broadcast(counts)
    each = found.where("row is not null").select("row", F.inline(F.arrays_zip("pairs", "times")))
    sums = each.join(counts, "pairs").groupBy("row").agg(
        F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"),
        F.sum(F.col("times") * F.col("total")).alias("count_sum"),
    )
    rows = found.where("row is not null").drop("pairs", "times")
    return rows.join(sums, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", F.lit(0)).cast("long").alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).cast("long").alias("count_sum"),
        "groups_sha256",
    )


def op12_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    return alignments(table(spark, sf_dir, "documents"))
