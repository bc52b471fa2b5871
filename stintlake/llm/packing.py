"""Best-fit packing of tokenised documents by bin completion.

Documents become pieces of at most 4,096 tokens. Only how many pieces there are of each length
decides the packing, and there are at most 4,096 lengths, whatever the corpus: that table goes to
the driver, which fills sequences around the largest piece left. Every filling is used as often
as its lengths last, so the work there doesn't grow with the corpus either. Pieces are then
numbered within their length and joined to the fillings that use them.
"""

import string
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stintlake.llm.common import stored, table

SEQUENCE = 4096
END_ID = 1
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
#: Words whose ids a Python worker keeps; beyond that it starts anew.
CACHED_WORDS = 450_000
#: Bytes of text that are split into words at a time.
SLICE_BYTES = 2_000_000
#: Numbers in one length are given within so many hash groups.
SALTS = 64
#: Numbers in a length are cut into blocks of so many for the join with the fillings.
BLOCK = 1024
#: Steps of one search for a filling; then the best one found so far is used.
SEARCH_STEPS = 2000

PIECES = "piece int, start long, length long, ids_crc32 long"

PUNCTUATION = string.punctuation.replace("'", "").encode()

_encoders: dict = {}


def only_letters(word: bytes) -> bool:
    """Letters up to U+024F, which normalising and lower-casing leave letters (but U+0130)."""
    if word.isascii():
        return word.isalpha()
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and "\u0130" not in text


class Encoder:
    """Ids of texts, word by word. The tokenizer splits at white space before anything else and
    drops it, so a text's ids are those of its words, and each new word is encoded once. It also
    lower-cases; only its special tokens tell cases apart, and texts that may hold one are left
    to it whole."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def plainly(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in found]

    def learn(self, words: set[bytes]) -> None:
        """Adds the ids of new words. Words of letters only are encoded as one text: each is a
        single run for the tokenizer, whose last id alone carries the mark of a word's end. A
        word with punctuation after its letters has the ids of both parts; an apostrophe may
        belong to either, so words with one are encoded whole."""
        known, letters, other, joined = self.known, set(), set(), []
        for word in words:
            bare = word.rstrip(PUNCTUATION)
            if only_letters(bare):
                if bare not in known:
                    letters.add(bare)
                if bare != word:
                    tail = word[len(bare) :]
                    if tail not in known:
                        other.add(tail)
                    joined.append((word, bare, tail))
            else:
                other.add(word)
        if letters:
            order = list(letters)
            ids = self.tokenizer.encode_batch_fast(
                [b" ".join(order).decode()], add_special_tokens=False
            )[0].ids
            ids = np.array(ids, "<u4")
            after = np.flatnonzero(self.ends[ids]) + 1
            if len(after) == len(order):
                data, end = ids.tobytes(), (4 * after).tolist()
                known.update(zip(order, map(data.__getitem__, map(slice, [0, *end], end)), strict=True))
            else:
                other |= letters
        rest = list(other)
        known.update(zip(rest, self.plainly([w.decode() for w in rest]), strict=True))
        for word, bare, tail in joined:
            known[word] = known[bare] + known[tail]

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        out: list[bytes] = [b""] * len(texts)
        special = [i for i, text in enumerate(texts) if "<|" in text]
        for i, found in zip(special, self.plainly([texts[i] for i in special]), strict=True):
            out[i] = found
        at = 0
        while at < len(texts):
            held, words = 0, []
            first = at
            while at < len(texts) and held < SLICE_BYTES:
                data = b"" if "<|" in texts[at] else texts[at].encode().lower()
                held += len(data)
                words.append(data.split())
                at += 1
            new = set().union(*words).difference(self.known)
            if len(self.known) + 2 * len(new) > CACHED_WORDS:
                self.known.clear()
                new = set().union(*words)
            self.learn(new)
            look_up = self.known.__getitem__
            for i, found in enumerate(words, first):
                if found:
                    out[i] = b"".join(map(look_up, found))
        return out


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, path: str = TOKENIZER, size: int = SEQUENCE, with_ids: bool = False):
    """A row per piece: doc_id, piece, start, length, ids_crc32, and `ids` where wanted.

    Null or empty text: one piece, the end id alone. Repeated rows: pieces of each."""
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def cut(batches):
        encode = encoder(path).ids
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            rows, at = [], []
            texts = [text or "" for text in batch.column("text").to_pylist()]
            for i, found in enumerate(encode(texts)):
                data = found + end
                for k, start in enumerate(range(0, len(data), 4 * size)):
                    part = data[start : start + 4 * size]
                    row = (k, start // 4, len(part) // 4, zlib.crc32(part))
                    rows.append((*row, np.frombuffer(part, "<u4")) if with_ids else row)
                    at.append(i)
            columns = list(zip(*rows, strict=True)) or [[]] * (len(names) - 1)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            kinds += [pa.list_(pa.int64())] * with_ids
            ids = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        cut, f"doc_id {kind}, {PIECES}" + ", ids array<long>" * with_ids
    )


def best_filling(left: np.ndarray, room: int) -> list[int]:
    """Lengths, in falling order, that together fill `room` as far as can be; `left[n]` pieces of
    length n remain.

    Depth first, the longest piece that fits first: the first leaf is the best-fit filling, the
    first incumbent. A branch is pruned if all that is left and fits can't bring its waste under
    the incumbent's. Of the fillings that take just one piece more only the one with the longest
    counts: it dominates the others. No waste ends the search, and so do SEARCH_STEPS steps.
    """
    held = np.cumsum(left * np.arange(len(left)))
    shortest = int(np.flatnonzero(left)[0]) if left.any() else room + 1
    best, best_waste = [], room + 1
    stack = [([], room, room)]
    for _ in range(SEARCH_STEPS):
        if not stack or best_waste == 0:
            break
        chosen, free, top = stack.pop()
        top = min(top, free)
        if max(0, free - int(held[top])) >= best_waste:
            continue
        fits = [n for n in _longest(left, top) if left[n] > chosen.count(n)]
        if not fits:
            if free < best_waste:
                best, best_waste = chosen, free
            continue
        if fits[0] == free:
            return [*chosen, free]
        pair = _exact_pair(left, chosen, free, top)
        if pair:
            return [*chosen, *pair]
        # Nothing fits after the lengths that leave less than the shortest: the longest of them
        # dominates the others.
        ends = [n for n in fits if free - n < shortest]
        going_on = fits[len(ends) :]
        stack.extend(([*chosen, n], free - n, n) for n in reversed(ends[:1] + going_on))
    return best


def _longest(left: np.ndarray, top: int, branches: int = 64) -> list[int]:
    """The longest lengths up to `top` that are left, in falling order."""
    there = np.flatnonzero(left[1 : top + 1]) + 1
    return there[: -branches - 1 : -1].tolist()


def _exact_pair(left, chosen, free: int, top: int) -> tuple[int, int] | None:
    """Two lengths of at most `top` that fill `free` exactly, the longest first."""
    longer = np.arange(min(top, free - 1), (free - 1) // 2, -1)
    both = longer[(left[longer] > 0) & (left[free - longer] > 0)]
    for n in both.tolist():
        m = free - n
        if left[n] > chosen.count(n) + (n == m) and left[m] > chosen.count(m):
            return n, m
    return None


def fillings(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[list[int], int]]:
    """(lengths in falling order, how many sequences) that use up `counts` pieces of each length.

    The largest length left is completed with the best filling of the rest of its sequence; the
    filling is then repeated while its lengths last. Every round uses up a length or leaves less
    of one than a single filling takes, so there are about two rounds a length at most."""
    left = np.zeros(size + 1, np.int64)
    for n, k in counts.items():
        left[n] = k
    out: list[tuple[list[int], int]] = []
    while True:
        there = np.flatnonzero(left)
        if not len(there):
            return out
        top = int(there[-1])
        left[top] -= 1
        rest = best_filling(left, size - top) if top < size else []
        left[top] += 1
        lengths = [top, *rest]
        need = {n: lengths.count(n) for n in set(lengths)}
        times = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * times
        out.append((lengths, times))


def _uses(found: list[tuple[list[int], int]]):
    """Rows (length, block, first, last, need, sequence, offset): the pieces of a length numbered
    first..last go to sequences from `sequence` on, `need` to each, from `offset` on. A range that
    spans several blocks of numbers has a row for each block it begins in or fills."""
    used: dict[int, int] = {}
    sequence = 0
    for lengths, times in found:
        offset = 0
        for n in sorted(set(lengths), reverse=True):
            need = lengths.count(n)
            first = used.get(n, 0)
            last = first + need * times - 1
            used[n] = last + 1
            yield n, first, last, need, sequence, offset
            offset += need * n
        sequence += times


def pack(cut: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Adds sequence_id and offset to a stored frame of pieces (doc_id, piece, length, ...).

    A piece's number in its length comes from counts by (length, hash group) and a window inside
    one group, so a length that holds most pieces is still numbered in many tasks. Pieces that are
    equal in all columns are interchangeable. No rows: none."""
    spark = cut.sparkSession
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    kinds = "length long, first long, last long, need long, sequence long, offset long"
    uses = spark.createDataFrame(list(_uses(fillings(counts, size))), kinds).withColumn(
        "_block",
        F.explode(
            F.sequence(F.floor(F.col("first") / BLOCK), F.floor(F.col("last") / BLOCK))
        ),
    )
    keys = ["doc_id", "piece", "start", "ids_crc32"]
    salted = cut.withColumn("_salt", F.pmod(F.xxhash64(*keys), F.lit(SALTS)))
    groups = salted.groupBy("length", "_salt").agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("length").orderBy("_salt").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = groups.select(
        "length", "_salt", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_from")
    )
    inside = Window.partitionBy("length", "_salt").orderBy(*keys)
    numbered = (
        salted.withColumn("_in", F.row_number().over(inside) - 1)
        .join(starts, ["length", "_salt"])
        .withColumn("_number", F.col("_from") + F.col("_in"))
        .withColumn("_block", F.floor(F.col("_number") / BLOCK))
    )
    place = F.col("_number") - F.col("first")
    return (
        numbered.join(uses, ["length", "_block"])
        .where(F.col("_number").between(F.col("first"), F.col("last")))
        .select(
            *cut.columns,
            (F.col("sequence") + F.floor(place / F.col("need"))).cast("long").alias("sequence_id"),
            (F.col("offset") + place % F.col("need") * F.col("length")).cast("long").alias("offset"),
        )
    )


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces with their places. The pieces are stored first: they are counted and then placed."""
    return pack(stored(pieces(docs), "pieces"))


def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
