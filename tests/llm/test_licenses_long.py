"""License scans of texts with very many detections: one sweep equals trying all pairs."""

import random

from test_rows import brute_detections, frame
from stintlake.llm import licenses

PHRASES = [
    "mit license", "licensed under the apache license 2.0", "spdx-license-identifier: mit license",
    "released under the gnu gpl", "license: bsd", "bsd license", "see the mit license", "and so on",
    "dual licensed under mpl 2.0 or lgpl 2.1",
]


def test_sweep_equals_all_pairs(spark):
    rng = random.Random(3)
    texts = [
        (i, " ".join(rng.choice(PHRASES) for _ in range(rng.choice([1, 2, 3, 17, 80]))))
        for i in range(60)
    ]
    rows = {r["doc_id"]: r for r in licenses.scan(frame(spark, texts)).collect()}
    for i, text in texts:
        assert [tuple(d) for d in rows[i]["detections"]] == brute_detections(text), text


def test_tens_of_thousands_of_detections_in_one_text(spark):
    times = 36_000
    texts = [(1, "mit license. " * times), (2, "\x01bsd license\x02 " * 30)]
    long, marked = sorted(licenses.scan(frame(spark, texts)).collect())
    found = [tuple(d) for d in long["detections"]]
    assert [d[:2] for d in found] == [(13 * i, 13 * i + 11) for i in range(times)]
    assert long["n_base"] == times and long["last_word"] == 2 * times - 2
    assert [d[:2] for d in marked["detections"]] == [(14 * i + 1, 14 * i + 12) for i in range(30)]
