"""Live laps: whatever the order of arrival, the last rows equal the laps of all samples at once."""

import random
from datetime import datetime, timedelta, timezone

import pytest

from stintlake.streaming import live

START = datetime(2024, 5, 1, 14, tzinfo=timezone.utc)


def made(car, lap, second, speed=100.0, gp="monza"):
    return (2024, gp, car, lap, START + timedelta(seconds=second), speed, 99.0 + second % 2, int(second % 3 == 0), (speed or 0.0) * second)


def race(cars=("AAA", "BBB", "CCC"), laps=4, seconds=20):
    return [
        made(car, lap, (lap - 1) * seconds + s, 100.0 + 7.3 * (s % 11))
        for car in cars for lap in range(1, laps + 1) for s in range(seconds)
    ]


def run(spark, folder, groups, **more):
    """Each group of samples arrives as a file, a batch each; then the stream is at rest."""
    for group in groups:
        spark.createDataFrame(group, live.SAMPLES).coalesce(1).write.mode("append").parquet(f"{folder}/samples")
        query = live.follow(spark, f"{folder}/samples", f"{folder}/laps", f"{folder}/seen", **more)
        query.awaitTermination()
        assert query.exception() is None


def last_rows(spark, folder):
    rows = live.read_laps(spark, f"{folder}/laps").drop("status", "version").collect()
    return sorted(map(tuple, rows))


def at_once(spark, samples):
    return sorted(map(tuple, live.lap_summary(spark.createDataFrame(samples, live.SAMPLES)).collect()))


@pytest.mark.parametrize("seed", [1, 2])
def test_shuffled_and_late_files_give_the_batch(spark, tmp_path, seed):
    samples = race()
    random.Random(seed).shuffle(samples)
    samples += [made("DDD", 1, 3, None), (None, "monza", "AAA", 1, START, 1.0, 1.0, 1, 1.0)]
    groups = [samples[i::4] for i in range(4)]
    run(spark, str(tmp_path), groups)
    assert last_rows(spark, str(tmp_path)) == at_once(spark, samples)


def test_laps_close_once_and_are_corrected(spark, tmp_path):
    first = race(("AAA",), laps=3)
    late = made("AAA", 1, 12, 333.0)
    groups = [first[:30], first[30:], [late], [made("AAA", 4, 70)]]
    run(spark, str(tmp_path), groups, grace_s=3.0)
    history = live.read_history(spark, f"{tmp_path}/laps").collect()
    rows = sorted((r.LapNumber, r.version, r.status) for r in history)
    by_lap = {n: [s for m, _, s in rows if m == n] for n in (1, 2, 3, 4)}
    assert by_lap[1] == ["closed", "corrected"]
    assert by_lap[2] == ["open", "closed"]
    assert by_lap[3] == ["open", "closed"]
    assert by_lap[4] == ["open"]
    assert sum(s == "closed" for _, _, s in rows) == 3
    versions = [(n, v) for n, v, _ in rows]
    assert len(versions) == len(set(versions))
    assert last_rows(spark, str(tmp_path)) == at_once(spark, [x for g in groups for x in g])


def test_silent_cars_are_closed_and_too_late_samples_left_out(spark, tmp_path):
    hour = 3600
    groups = [
        [made("AAA", 1, 0), made("AAA", 1, 5)],
        [made("BBB", 1, 3 * hour)], [made("BBB", 1, 3 * hour + 1)], [made("AAA", 1, 6)],
    ]
    run(spark, str(tmp_path), groups, horizon_s=hour)
    laps = {(r.Driver, r.LapNumber): r for r in live.read_laps(spark, f"{tmp_path}/laps").collect()}
    assert (laps["AAA", 1].status, laps["AAA", 1].samples) == ("closed", 2)
    assert laps["BBB", 1].samples == 2


def test_states_do_not_grow_with_the_cars(spark, tmp_path):
    cars = [f"C{number:04d}" for number in range(3000)]
    samples = [made(car, lap, 10 * lap, 50.0 + lap) for car in cars for lap in (1, 2)]
    spark.createDataFrame(samples, live.SAMPLES).coalesce(2).write.parquet(f"{tmp_path}/samples")
    query = live.follow(spark, f"{tmp_path}/samples", f"{tmp_path}/laps", f"{tmp_path}/seen")
    query.awaitTermination()
    states = [state.numRowsTotal for progress in query.recentProgress for state in progress.stateOperators]
    assert 0 < max(states) <= 1024
    laps = live.read_laps(spark, f"{tmp_path}/laps").collect()
    statuses = {(r.Driver, r.LapNumber): (r.status, r.version, r.samples) for r in laps}
    assert statuses == {
        (car, lap): ("closed" if lap == 1 else "open", 1, 1) for car in cars for lap in (1, 2)
    }


def test_cars_of_a_share_are_closed_and_forgotten_one_by_one(spark, tmp_path):
    hour = 3600
    groups = [
        [made("AAA", 1, 0), made("AAA", 1, 5), made("AAA", 2, 7, None), made("BBB", 1, hour // 2, None)],
        [made("BBB", 1, 3 * hour)], [made("BBB", 2, 3 * hour + 1)], [made("AAA", 1, 6)],
        [made("AAA", 1, 3 * hour + 2), made("BBB", 2, 3 * hour + 30)],
        [made("CCC", 1, 9 * hour)],
    ]
    run(spark, str(tmp_path), groups, horizon_s=hour, shares=1)
    history = live.read_history(spark, f"{tmp_path}/laps").collect()
    rows = {}
    for r in sorted(history, key=lambda r: (r.batch, r.version)):
        rows.setdefault((r.Driver, r.LapNumber), []).append((r.version, r.status, r.samples, r.top_speed))
    # AAA is forgotten and comes back as a new car; BBB, in the same state, goes on meanwhile.
    assert rows == {
        ("AAA", 1): [(1, "open", 2, 100.0), (2, "closed", 2, 100.0), (1, "open", 1, 100.0), (2, "closed", 1, 100.0)],
        ("AAA", 2): [(1, "open", 1, None), (2, "closed", 1, None)],
        ("BBB", 1): [(1, "open", 1, None), (2, "open", 2, 100.0), (3, "closed", 2, 100.0)],
        ("BBB", 2): [(1, "open", 1, 100.0), (2, "open", 2, 100.0), (3, "closed", 2, 100.0)],
        ("CCC", 1): [(1, "open", 1, 100.0)],
    }


def test_shares_give_the_same_history(spark, tmp_path):
    """Cars fall silent, come back and get samples that are late or too late."""
    rng = random.Random(5)
    groups = [
        [
            made(f"C{rng.randrange(12):02d}", rng.randrange(1, 5), 900 * batch + rng.randrange(-2700, 900), rng.choice([None, 80.0, 120.5]))
            for _ in range(40)
        ]
        for batch in range(6)
    ]
    seen = []
    for shares in (1, 1000):
        run(spark, f"{tmp_path}/{shares}", groups, horizon_s=1800, grace_s=60.0, shares=shares)
        seen.append(sorted(map(str, live.read_history(spark, f"{tmp_path}/{shares}/laps").collect())))
    assert seen[0] == seen[1]
    assert {r.status for r in live.read_history(spark, f"{tmp_path}/1/laps").collect()} == set(live.STATUS)
