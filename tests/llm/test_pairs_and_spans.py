"""Repeats, near duplicates and fingerprints against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from stintlake.llm import fingerprints, graph, repeats, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names operators might use inside.
CLASHING = ", key string, fp long, u long, size long, _key string, root long, n_words long"


def frame(spark, texts, kinds=DOCS, extra=()):
    rows = [(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), *extra) for i, t in texts]
    return spark.createDataFrame(rows, kinds)


def rows_of(df, n):
    return sorted((tuple(r)[:n] for r in df.collect()), key=repr)


# --- repeats --------------------------------------------------------------------------------


def brute_repeats(texts, length=repeats.LENGTH):
    data = [(t or "").encode() for t in texts]
    seen = defaultdict(int)
    for b in data:
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for b in data:
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        kept = hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()
        out.append((len(b), int(gone.sum()), runs, kept))
    return out


def patchwork(seed, n=150):
    pick = random.Random(seed)
    letters = "abcdefgh é\n"
    sources = ["".join(pick.choices(letters, k=pick.randint(150, 700))) for _ in range(6)]
    texts = []
    for _ in range(n):
        text = "".join(pick.choices(letters, k=pick.randint(0, 260)))
        for _ in range(pick.randint(0, 3)):
            s = pick.choice(sources)
            i = pick.randint(0, len(s))
            text += s[i : pick.randint(i, len(s))]
            text += "".join(pick.choices(letters, k=pick.choice([0, 1, 2, 50])))
        texts.append(text)
    return [*texts, "a" * 1000, "a" * 900, "ab" * 400, None, "", texts[3], texts[3]]


@pytest.mark.parametrize(("seed", "group"), [(0, 1000), (1, 8)])
def test_repeats_are_all_found_also_where_groups_are_cut(spark, monkeypatch, seed, group):
    monkeypatch.setattr(repeats, "GROUP", group)
    texts = patchwork(seed)
    expected = [(i, *x) for i, x in enumerate(brute_repeats(texts))]
    found = repeats.without_repeats(frame(spark, list(enumerate(texts)), DOCS + CLASHING, ("k", 1, 1, 1, "x", 1, 1)))
    assert rows_of(found, 5) == sorted(expected, key=repr)
    assert sum(x[2] for x in expected) > 1000


def test_repeats_edges(spark):
    text = "".join(random.Random(4).choices("abcdefgh ", k=450))
    texts = [(1, text), (1, text), (None, "x" + text), (2, text[:199]), (3, None), (4, "")]
    expected = [(i, *x) for (i, _), x in zip(texts, brute_repeats([t for _, t in texts]), strict=True)]
    assert rows_of(repeats.without_repeats(frame(spark, texts)), 5) == sorted(expected, key=repr)
    assert repeats.without_repeats(frame(spark, [])).count() == 0


def test_slices_of_a_long_text_agree(monkeypatch):
    text = "".join(random.Random(5).choices("abcd", k=5000)).encode()

    def windows():
        return {
            (int(p - before) + k, int(p))
            for place, befores, afters, _, _ in repeats.anchors(text)
            for p, before, after in zip(place, befores, afters, strict=True)
            for k in range(before + after - repeats.LENGTH + 1)
        }

    whole = windows()
    monkeypatch.setattr(repeats, "SLICE", 700)
    assert windows() == whole and len(whole) == 5000 - repeats.LENGTH + 1


def test_intervals_of_a_suffix_array():
    text = b"banana"
    suffixes = sorted(text[i:] for i in range(len(text)))
    lcp = [repeats.common(a, b) for a, b in zip(suffixes, suffixes[1:], strict=False)]
    assert sorted(repeats.intervals(lcp)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


# --- near duplicates ------------------------------------------------------------------------


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in text.encode().split()]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(fps):
    """Index of the first member of each one's component, links at 3 or fewer bits."""
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(fps))]


def test_golay_decoding_corrects_three_errors():
    pick = random.Random(1)
    words = np.array([pick.getrandbits(23) for _ in range(500)], np.uint32)
    again = simhash.codeword_index(words)
    for _ in range(3):
        # A codeword with up to 3 flips decodes to itself: the code is perfect.
        message = again.astype(np.uint32) << simhash.CHECK_BITS
        code = message ^ np.array([simhash._remainder(int(m)) for m in message], np.uint32)
        flips = [sum(1 << b for b in pick.sample(range(23), pick.randint(0, 3))) for _ in words]
        assert (simhash.codeword_index(code ^ np.array(flips, np.uint32)) == again).all()


def test_fingerprints_within_three_bits_share_a_key():
    pick = random.Random(2)
    for _ in range(300):
        a = pick.getrandbits(64)
        b = a
        for bit in pick.sample(range(64), pick.randint(1, 3)):
            b ^= 1 << bit
        row, keys = simhash.link_keys(np.array([a, b], np.uint64))
        assert set(keys[row == 0]) & set(keys[row == 1])


@pytest.mark.parametrize("block", [1000, 7])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    pick = random.Random(3)
    fps = {pick.getrandbits(64) for _ in range(150)}
    for seed in list(fps)[:12]:
        at = seed
        for _ in range(12):
            for bit in pick.sample(range(64), pick.randint(1, 3)):
                at ^= 1 << bit
            fps.add(at)
    fps = sorted(fps)
    signed = [int(np.array([f], np.uint64).view(np.int64)[0]) for f in fps]
    found = graph.components(simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")))
    root = {r["node"]: r["root"] for r in found.collect()}
    expected = brute_components(fps)
    groups = defaultdict(set)
    for f, r in zip(signed, expected, strict=True):
        groups[r].add(f)
    for members in groups.values():
        if len(members) > 1:
            assert {root[m] for m in members} == {min(members)}
        else:
            assert not members & root.keys()


def near_texts():
    pick = random.Random(6)
    words = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 7))) for _ in range(400)]
    texts = []
    for i in range(60):
        base = [pick.choice(words) for _ in range(pick.randint(1, 300))]
        texts.append((i * 3 + 5, " ".join(base)))
        for k in range(pick.randint(0, 2)):
            base[pick.randrange(len(base))] = pick.choice(words)
            texts.append((i * 3 + 6 + k, "  ".join(base).title()))
    return [*texts, (1000, None), (1001, ""), (1002, " \n"), (1003, "One two"), (1003, "One two")]


def test_no_join_that_grows_with_the_input_is_broadcast(spark, capsys):
    """However small Spark takes the fingerprints to be: each has some 90 keys."""
    docs = spark.createDataFrame([(i, f"a {i % 7}") for i in range(30)], "doc_id long, text string")
    fps = simhash.fingerprinted(docs)
    for plan in (simhash.links(fps.select("fp").distinct()), simhash.near_duplicates(docs), simhash.one_of_each(docs)):
        plan.explain()
        shown = capsys.readouterr().out
        assert "SortMergeJoin" in shown and "Broadcast" not in shown


def test_near_duplicates(spark):
    texts = near_texts()
    fps = [brute_fingerprint(t) for _, t in texts]
    roots = brute_components(fps)
    least = {}
    for (i, _), r in zip(texts, roots, strict=True):
        least[r] = min(i, least.get(r, i))
    expected = [(i, f"{f:016x}", least[r]) for (i, _), f, r in zip(texts, fps, roots, strict=True)]
    random.Random(1).shuffle(texts)
    assert rows_of(simhash.near_duplicates(frame(spark, texts)), 3) == sorted(expected, key=repr)
    assert len({x[2] for x in expected}) < len({x[0] for x in expected})
    kept = simhash.one_of_each(frame(spark, texts, DOCS + CLASHING, ("k", 1, 1, 1, "x", 1, 1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(least.values()))
    assert kept.columns[-1] == "n_words"


def test_near_duplicates_edges(spark):
    assert simhash.near_duplicates(frame(spark, [])).count() == 0
    assert simhash.one_of_each(frame(spark, [])).count() == 0
    # Documents without ids stay apart, unless they are near.
    texts = [(None, "one text of some words"), (None, "another and other kind"), (None, "one text of some words")]
    assert simhash.one_of_each(frame(spark, texts)).count() == 2


# --- fingerprints ---------------------------------------------------------------------------


def brute_winnow(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]{1,12}", text or "")

    k, prime, base = fingerprints.K, fingerprints.PRIME, fingerprints.BASE
    signed = np.array([xxhash.xxh64_intdigest(w.encode(), 42) for w in words], np.uint64).view(np.int64)
    hashes = [int(h) % prime for h in signed]
    if not hashes:
        return []
    grams, now = [], 0
    for i, h in enumerate(hashes):  # a word comes in, the one K before goes out
        if i >= k:
            now -= hashes[i - k] * pow(base, k - 1, prime)
        now = (now * base + h) % prime
        if i >= k - 1:
            grams.append(now)
    grams = grams or [now]
    kept = []
    for i in range(max(1, len(grams) - fingerprints.WINDOW + 1)):
        window = range(i, min(len(grams), i + fingerprints.WINDOW))
        best = min(window, key=lambda j: (grams[j], -j))
        if (grams[best], best) not in kept:
            kept.append((grams[best], best))
    return kept


def brute_rows(texts):
    order = sorted(
        ((i, t or "") for i, t in texts),
        key=lambda x: (x[0] is None, -(x[0] or 0), np.array([xxhash.xxh64_intdigest(x[1].encode(), 42)], np.uint64).view(np.int64)[0]),
    )

    def alike(a, b):
        a, b = {h for h, _ in a}, {h for h, _ in b}
        return len(a & b) / len(a | b) if a | b else 1.0

    def written(kept):
        return ",".join(f"{h:X}:{p}" for h, p in kept)

    out = []
    for n, (i, text) in enumerate(order):
        after = order[(n + 1) % len(order)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        own, other = brute_winnow(text), brute_winnow(edited)
        out.append(
            (i, len(text), hashlib.sha256(edited.encode()).hexdigest(), written(own), written(other),
             alike(own, other), alike(own, brute_winnow(after)))
        )
    return out


def test_winnowing(spark):
    texts = [*near_texts(), (None, "without an id"), (7, "ünï" * 30), (8, "a " * 500)]
    found = fingerprints.fingerprints(frame(spark, texts, DOCS + CLASHING, ("k", 1, 1, 1, "x", 1, 1)))
    assert rows_of(found, 7) == sorted(brute_rows(texts), key=repr)


def test_winnowing_edges(spark):
    assert fingerprints.fingerprints(frame(spark, [])).count() == 0
    alone = [(3, "just one text here, on its own")]
    assert rows_of(fingerprints.fingerprints(frame(spark, alone)), 7) == brute_rows(alone)


def test_winnowing_of_hot_ids(spark):
    """An id and null that hold most rows: their rows are spread over ranges by their texts."""
    pick = random.Random(3)
    texts = [(None if i % 3 else 5, f"text {i} " + "w" * pick.randint(0, 9)) for i in range(300)]
    texts += [(i, f"other {i}") for i in range(20)] + [(None, None), (5, ""), (None, "")]
    docs = frame(spark, texts)
    assert rows_of(fingerprints.fingerprints(docs), 7) == sorted(brute_rows(texts), key=repr)
    placed, _ = fingerprints.successors(docs)
    most = max(r["count"] for r in placed.groupBy("_at").count().collect())
    assert most < 80
