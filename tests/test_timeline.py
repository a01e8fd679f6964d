"""Tiling and cue assignment, each against a plain walk over random input."""

import random

from spindrift.operators import timeline


def tiles(start, end, duration, size=60.0, sliver=10.0):
    """Boundaries by stepping outward; a short rest joins its neighbour, or goes where that is the fixed interval."""
    left = [start]
    while left[0] - size >= 0:
        left.insert(0, left[0] - size)
    if left[0] > sliver:
        left.insert(0, 0.0)
    elif 0 < left[0] and len(left) > 1:
        left[0] = 0.0
    right = [end]
    while right[-1] + size <= duration:
        right.append(right[-1] + size)
    if duration - right[-1] > sliver:
        right.append(duration)
    elif duration > right[-1] and len(right) > 1:
        right[-1] = duration
    bounds = left + right
    return list(zip(bounds, bounds[1:])), len(left) - 1


def test_tiles_match_a_boundary_loop(spark):
    rng = random.Random(21)
    rows = []
    for i in range(400):
        start = rng.choice([0.0, rng.randrange(0, 400) * 1.0, round(rng.uniform(0, 500), 2)])
        rows.append((i, start, start + 60, start + 60 + rng.choice([0.0, rng.randrange(0, 300) * 1.0, round(rng.uniform(0, 900), 3)])))
    got = timeline.segment(spark.createDataFrame(rows, "i int, start double, end double, duration double")).collect()
    for r in got:
        chunks, oracle = tiles(r.start, r.end, r.duration)
        assert [(c.s, c.e) for c in r.chunks] == chunks and r.oracle_idx == oracle
        assert (r.chunks[oracle].s, r.chunks[oracle].e) == (r.start, r.end)


def walk(cues, ranges):
    """Two pointers that only go forward; the text of each range, lines equal to the one before left out."""
    ranges = sorted(ranges)
    texts, at = {r: [] for r in ranges}, 0
    for start, end, text in cues:
        while at < len(ranges) and ranges[at][1] < start:
            at += 1
        if at < len(ranges) and ranges[at][0] <= end:
            for line in text.split("\n"):
                line = " ".join(line.split())
                if line and texts[ranges[at]][-1:] != [line]:
                    texts[ranges[at]].append(line)
    return {r: " ".join(x) for r, x in texts.items()}


def test_cues_match_a_two_pointer_walk(spark):
    rng = random.Random(22)
    words = ["hm", "so it is", "[noise]", "so  it is", "", "and then\nhm", "later\n\nlater"]
    videos = []
    for _ in range(60):
        cuts = sorted(rng.sample(range(0, 400), rng.randrange(2, 8)))
        ranges = [(float(a), float(b)) for a, b in zip(cuts, cuts[1:]) if rng.random() < 0.8]
        starts = [rng.randrange(0, 420) for _ in range(rng.randrange(0, 25))]
        if rng.random() < 0.7:
            starts.sort()
        videos.append(([(float(s), float(s + rng.choice([0, 1, 4, 40, 200])), rng.choice(words)) for s in starts], rng.sample(ranges, len(ranges))))
    cues = [(v, n, *c) for v, (cs, _) in enumerate(videos) for n, c in enumerate(cs)]
    ranges = [(v, f"r{k}", *r) for v, (_, rs) in enumerate(videos) for k, r in enumerate(rs)]  # in any order, under any name
    made = timeline.range_texts(
        spark.createDataFrame(cues, "vid int, cue_no int, start double, end double, text string"), spark.createDataFrame(ranges, "vid int, chunk string, lo double, hi double"),
    )
    found = {(r.vid, r.chunk): r.text for r in made.collect()}
    want = {(v, f"r{k}"): walk(cs, rs)[r] for v, (cs, rs) in enumerate(videos) for k, r in enumerate(rs)}
    assert found == want


def test_a_transcript_that_is_missing_and_one_that_says_nothing(spark):
    cues = spark.createDataFrame([("a", 0, 0.0, 1.0, "one\none"), ("a", 1, 1.0, 2.0, "one\ntwo"), ("b", 0, 0.0, 1.0, "  ")], "vid string, cue_no int, start double, end double, text string")
    files = spark.createDataFrame([("a",), ("b",), ("c",)], "vid string")
    assert {r.vid: (r.text, r.missing) for r in timeline.transcripts(files, cues).collect()} == {"a": ("one two", False), "b": ("", False), "c": (None, True)}


def test_a_manifest_and_why_files_are_not_in_it(spark):
    files = spark.createDataFrame([(v,) for v in "abcdef"], "vid string")
    trims = spark.createDataFrame([("a", 60.0), ("b", 0.0), ("c", 30.0), ("d", 0.0), ("z", 0.0)], "vid string, start double")
    lengths = spark.createDataFrame([("a", 200.0), ("b", 61.0), ("c", None), ("d", 9000.0), ("e", 100.0)], "vid string, duration double")
    kept, why = timeline.manifest(files, trims, lengths)
    assert [(r.vid, len(r.chunks), r.oracle_idx) for r in kept.collect()] == [("a", 4, 1)]
    assert {r.vid: r.reason for r in why.collect()} == {"a": "kept", "b": "too_short", "c": "probe_failed", "d": "too_many", "e": "no_trim", "f": "no_trim"}
    stats = {r.reason: (r.n, r.examples) for r in timeline.reason_stats(why, examples=1).collect()}
    assert stats["no_trim"] == (2, "e") and stats["kept"] == (1, "a")


def test_overlaps_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = [(rng.choice([1, 2, None]), i, float(a := rng.randrange(0, 60)), float(a + rng.randrange(0, 9))) for i in range(200)]
    rows += [(1, 900, 5.0, 4.0), (1, 901, None, 4.0), (1, 902, 3.0, None), (3, 903, 1.0, 1.0), (3, 904, 1.0, 1.0), (3, 905, 0.0, 1.0)]
    got = {r.cue_no: r.n_overlaps for r in timeline.overlap_counts(spark.createDataFrame(rows, "vid int, cue_no int, start double, end double"), block=30).collect()}
    sound = [r for r in rows if r[2] is not None and r[3] is not None and r[2] <= r[3]]
    want = {i: sum(v == w and i != j and a <= d and c <= b for w, j, c, d in sound) if (v, i, a, b) in sound else 0 for v, i, a, b in rows}
    assert got == want
