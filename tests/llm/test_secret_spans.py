"""Inferred secrets: exact spans where credentials stand, and few in what only looks random."""

import base64
import random
import time
import uuid

import pytest

from stintlake.llm import secrets

HELD_OUT = [(k, t) for k, t in secrets.labelled_credentials(seed=51) if k not in ("aws_access_key", "hex_token")]


@pytest.mark.parametrize("place", [
    "{}", "see {} here", "ab/{}", "x={}", "id-{}", "docs/readme/{}", "NAME={}", "SOME_LONG_VARIABLE_NAME={}",
    "host/a/long/path/to/some/folder/{}", "{}/x", "{}/settings/page", "?first=second&third={}&more=no", "({})", "'{}',",
])
def test_spans_are_exact(place):
    scanner, before = secrets.default_scanner(), place.index("{}")
    exact = 0
    for kind, token in HELD_OUT:
        spans = scanner.spans(place.replace("{}", token))[1]
        exact += (before, 3, kind, before + len(token)) in spans
    assert exact >= 0.95 * len(HELD_OUT), exact / len(HELD_OUT)


def test_spans_before_a_word_behind_a_dash():
    """A dash may stand in some formats; in those of other lengths the word's end is a guess."""
    scanner = secrets.default_scanner()
    own = [(k, t) for k, t in HELD_OUT if scanner.fixed_length[k] or "-" not in scanner.letters[k]]
    exact = sum((0, 3, k, len(t)) in scanner.spans(t + "-old")[1] for k, t in own)
    assert exact >= 0.95 * len(own)
    for k, t in HELD_OUT:
        spans = scanner.spans(t + "-old")[1]
        assert not spans or spans[0][3] <= len(t) + 4


def test_few_false_alarms():
    pick, scanner = random.Random(7), secrets.default_scanner()
    uuids = [str(uuid.UUID(int=pick.getrandbits(128))) for _ in range(400)]
    named = [f"request-id={u}/part" for u in uuids[:200]]
    encoded = [base64.b64encode(pick.randbytes(pick.randint(20, 300))).decode() for _ in range(600)]
    safe = [base64.urlsafe_b64encode(pick.randbytes(pick.randint(20, 300))).decode() for _ in range(400)]
    ordinary = secrets.ordinary_tokens(seed=52)
    paths = ["/".join(["usr", "lib", "python3", "site-packages", x, "tests"]) for x in ("numpy", "pandas", "LICENSES")]
    for texts in (uuids, named, encoded, safe, ordinary, paths):
        hits = [t for t in texts if any(x[1] == 3 for x in scanner.spans(t)[1])]
        assert len(hits) <= 0.02 * len(texts), (len(hits), len(texts), hits[:2])


def test_redaction_keeps_the_rest():
    scanner, token = secrets.default_scanner(), "ghp_" + "aB3dE6gH9k" * 3 + "Zz12Xy"
    for text in (f"docs/readme/{token}", f"{token}/settings/page", f"NAME={token} and more"):
        spans = scanner.spans(text)[1]
        assert secrets.redact(text, spans) == text.replace(token, "[github_token]")


def test_long_runs_take_time_in_proportion():
    scanner, pick = secrets.default_scanner(), random.Random(8)
    times = []
    for n in (20_000, 200_000):
        run = "/".join("".join(pick.choices("abcdefgh0123456789AB", k=9)) for _ in range(n // 10))
        began = time.process_time()
        scanner.spans(run)
        times.append(time.process_time() - began)
    assert times[1] < 25 * max(times[0], 0.02)
