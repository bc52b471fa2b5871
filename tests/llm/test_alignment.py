"""Alignment of two tokenizers against a plain recomputation from whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import pytest
import sentencepiece
from tokenizers import Tokenizer

from stintlake.llm import alignment

DOCS = "doc_id long, text string"
TEXTS = [
    "Hello world, this isn't a test.", "", None, "a", " ", "  two  spaces ", "tab\tand\nlines\n\n end\n",
    "naïve café — “quotes” … 東京 🙂 ١٢٣ ⅷ", "<|endoftext|> <s> </s> <unk> [INST]", "a ▁ b▁c", "x\x00y z\x1cq",
    "don't we'll I'd they've", "\n \nfoo", "foo \n bar", "a b   c　 d", "ends with space ",
    "12345 67,890.12 3.14e-10", "AAAAAA" * 50, "Hello world, this isn't a test.", "İstanbul ɂ ǅ ʼn",
    "word " * 300, "é" * 700 + " " + "ß" * 3, "mixed\r\nline\rends", "emoji 👩‍👩‍👧‍👦 zwj", "﻿bom here",
]


@pytest.fixture(scope="module")
def sides():
    a = Tokenizer.from_file(alignment.BYTE_BPE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.PIECE_BPE)
    return a, b


def tokens(sides, text):
    """Ids and bytes of the tokens of a whole text on either side; none if they don't spell it."""
    a, b = sides
    if not text:
        return None
    value = alignment.byte_values()
    ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
    bytes_a = [bytes(value[c] for c in a.id_to_token(i)) for i in ids_a]
    bytes_b = []
    for i in ids_b:
        piece = b.id_to_piece(i)
        bytes_b.append(bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode())
    whole = (" " + text).encode()
    if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
        return None
    return ids_a, bytes_a, ids_b, bytes_b


def spans(parts):
    at, out = 0, []
    for x in parts:
        out.append((at, at + len(x)))
        at += len(x)
    return out


def brute(sides, rows):
    links, out = [], []
    for doc_id, text in rows:
        found = tokens(sides, text)
        if not found:
            links.append([])
            out.append([doc_id, 0, 0, 0, 0, 0, 0, ""])
            continue
        ids_a, bytes_a, ids_b, bytes_b = found
        spans_a, spans_b = spans(bytes_a), spans(bytes_b)
        mine, first = [], 0
        for x, (s, e) in zip(ids_a, spans_a, strict=True):
            while spans_b[first][1] <= s:
                first += 1
            k = first
            while k < len(spans_b) and spans_b[k][0] < e:
                mine.append((x, ids_b[k]))
                k += 1
        cuts = sorted({e for _, e in spans_a} & {e for _, e in spans_b})
        groups, left = [], [list(zip(i, p, strict=True))[::-1] for i, p in ((ids_a, spans_a), (ids_b, spans_b))]
        for cut in cuts:
            parts = ([], [])
            for part, tokens_left in zip(parts, left, strict=True):
                while tokens_left and tokens_left[-1][1][1] <= cut:
                    part.append(str(tokens_left.pop()[0]))
            groups.append("|".join(",".join(part) for part in parts))
        links.append(mine)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append([doc_id, len(ids_a), len(ids_b), len(cuts), len(mine), 0, 0, digest])
    counts = Counter(pair for mine in links for pair in mine)
    highest = defaultdict(int)
    for (_, b), n in counts.items():
        highest[b] = max(highest[b], n)
    for row, mine in zip(out, links, strict=True):
        row[5] = sum(counts[p] == highest[p[1]] for p in mine)
        row[6] = sum(counts[p] for p in mine)
    return sorted(map(tuple, out), key=repr)


def result(spark, rows, kinds=DOCS, extra=(), **more):
    df = spark.createDataFrame([(*r, *extra) for r in rows], kinds)
    return sorted((tuple(r) for r in alignment.alignments(df, **more).collect()), key=repr)


def test_equals_whole_texts(spark, sides):
    rows = list(enumerate(TEXTS)) + [(None, "null id"), (None, None), (3, "id again"), (3, "id again")]
    wanted = brute(sides, rows)
    assert result(spark, rows) == wanted
    assert result(spark, rows, sent=0) == wanted  # counts joined by key
    clashing = DOCS + ", row long, pairs string, times long, n_a long, total long"
    assert result(spark, rows, clashing, (1, "x", 2, 3, 4)) == wanted
    zeros = [r for r in wanted if r[7] == ""]
    assert len(zeros) >= 4 and all(r[1:7] == (0,) * 6 for r in zeros)


def test_random_texts_in_small_slices(spark, sides, monkeypatch):
    pick = random.Random(3)
    letters = ["a", "b", "e", "th", "ing", " ", " ", "  ", "\n", "\t", "é", "东", " ", "'s", "1", ",", "▁", "Q"]
    rows = [(i, "".join(pick.choices(letters, k=pick.randint(0, 80)))) for i in range(300)]
    monkeypatch.setattr(alignment, "SLICE", 200)
    monkeypatch.setattr(alignment, "TOGETHER", 7)
    monkeypatch.setattr(alignment, "CACHED_WORDS", 50)
    alignment._sides.clear()
    assert result(spark, rows) == brute(sides, rows)
    tool = alignment.aligner(alignment.BYTE_BPE, alignment.PIECE_BPE)
    for i in range(0, 300, 7):  # the same in this process, where the small numbers hold
        texts = [t for _, t in rows[i : i + 7]]
        got = alignment.aligned(tool, texts)["groups_sha256"].to_pylist()
        assert got == [r[7] for t in texts for r in brute(sides, [(0, t)])]
    alignment._sides.clear()


def test_the_given_texts(spark, sides):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.collect()]
    found = sorted((tuple(r) for r in alignment.op12_cross_tokenizer_alignment(spark, "/root/testdata/sf0.001").collect()), key=repr)
    assert found == brute(sides, rows)
    assert all(r[4] == r[1] + r[2] - r[3] for r in found)


def test_one_long_text_and_no_rows(spark, sides):
    text = " ".join(f"word{i % 977} é{i}" for i in range(60_000))
    found = result(spark, [(1, text)])
    ids_a, _, ids_b, _ = tokens(sides, text)
    assert found[0][1:3] == (len(ids_a), len(ids_b))
    assert result(spark, []) == []
