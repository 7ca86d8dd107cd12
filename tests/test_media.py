"""Detections against the sequential rule, descriptions by hand; contained texts against all pairs."""

import random

from pyspark.sql import functions as F

from casewright.operators import media, retrieve

SCHEMA = "frame_id string, detection_id string, label string, confidence double, priority boolean, x1 double, y1 double, x2 double, y2 double, source string"


def family(label):
    low = " ".join(label.lower().replace("_", " ").replace("-", " ").split())
    words = set(low.split())
    return "firearm" if words & set(media.FIREARMS) else "blade" if words & set(media.BLADES) else "weapon" if low in media.GENERIC else low


def overlap(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    shared = max(0.0, w) * max(0.0, h)
    whole = (a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - shared
    return shared / whole if whole > 0 else 0.0


def score(d):
    low = d[2].lower().replace("_", " ")
    return (d[4], family(d[2]) in ("firearm", "blade") or low not in media.GENERIC, len(low.replace(" ", "")), d[3])


def merged(rows):
    out = []
    for new in sorted(rows, key=lambda d: (-d[4], -d[3], d[1])):
        at = next((i for i, k in enumerate(out) if family(k[2]) == family(new[2]) and overlap(k, new) >= 0.55), None)
        if at is None:
            out.append(new)
            continue
        kept = out[at]
        won = list(new if score(new) > score(kept) else kept)
        won[4], won[9] = kept[4] or new[4], "+".join(sorted(set(kept[9].split("+")) | set(new[9].split("+"))))
        out[at] = tuple(won)
    return out


def test_merging_equals_the_sequential_rule(spark):
    rnd = random.Random(7)
    rows = []
    for k in range(220):
        x, y = rnd.randint(0, 6), rnd.randint(0, 6)
        label = rnd.choice(["gun", "Assault_Rifle", "firearm", "weapon", "knife", "car", "car", "toy car"])
        rows.append((f"f{k % 7}", f"d{k:03d}", label, rnd.choice([0.5, 0.7, 0.9]), family(label) in ("firearm", "blade", "weapon") and rnd.random() < 0.8, float(x), float(y), x + rnd.randint(6, 9) * 1.0, y + rnd.randint(6, 9) * 1.0, rnd.choice(["yolo", "world"])))
    got = media.merge_detections(spark.createDataFrame([*rows, ("f0", "z", "car", 0.9, False, None, 0.0, 1.0, 1.0, "x")], SCHEMA))
    want = [d for f in range(7) for d in merged([r for r in rows if r[0] == f"f{f}"])]
    assert sorted(tuple(r) for r in got.collect()) == sorted(want) and len(want) < len(rows)
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_labels(spark):
    said = {"Hand-Gun": ("hand gun", "firearm", True), "bread  knife": ("bread knife", "blade", True), "WEAPON": ("weapon", "weapon", True), "gunmetal": ("gunmetal", "gunmetal", False), "drone": ("drone", "drone", True), "": ("", "", False)}
    got = spark.createDataFrame([(k,) for k in said], "l string").select("l", media.plain_label(F.col("l")), media.label_family(F.col("l")), media.is_priority(F.col("l"), ("drone",))).collect()
    assert {r[0]: tuple(r)[1:] for r in got} == said


def test_descriptions(spark):
    frames = spark.createDataFrame([("f", "clip.mp4", 2, 7.25, 100, 100), ("g", "still.png", 0, 0.0, 10, 10)], "frame_id string, media_name string, frame_index int, timestamp_seconds double, width int, height int")
    found = spark.createDataFrame([("f", "a", "car", 0.9, False, 0.0, 0.0, 60.0, 60.0, "yolo"), ("f", "b", "gun", 0.5, True, 45.0, 45.0, 55.0, 55.0, ""), ("f", "c", "car", 0.8, False, 70.0, 70.0, 100.0, 100.0, "yolo")], SCHEMA)
    got = {r.frame_id: r.description for r in media.describe_frames(frames, found).collect()}
    assert got["g"] == "Frame 1 of still.png contains no confident object detections."
    assert got["f"] == (
        "Frame 3 of clip.mp4 at 7.2s shows 2 cars, 1 gun. Priority items noted: gun. Key placements: 1. gun (0.50, priority object, small, near the centre of the frame, detector=unknown); "
        "2. car (0.90, object, large, in the upper left of the frame, detector=yolo); 3. car (0.80, object, medium-sized, in the lower right of the frame, detector=yolo)."
    )


def test_contained_equals_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{k}" for k in range(12)] + ["a.b", "é"]
    texts = [rnd.choice([" ", "  ", "\n"]).join(rnd.choice(words) for _ in range(rnd.randint(0, 60))) for _ in range(80)] + [None, ""]
    items = []
    for k in range(60):
        t = rnd.choice([t for t in texts if t])
        i = rnd.randrange(len(t))
        items.append(t[i : i + rnd.randint(1, 40)])
    items += ["w1 w2 w3 w4 w5 nowhere", "", None, "w1 w2 w1 w2 w1 w2 w1"]
    docs, asked = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "query_id int, text string")
    want = {(q, d) for q, i in enumerate(items) for d, t in enumerate(texts) if i and t and i in t}
    got = [tuple(r) for r in retrieve.contained(asked, docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    long = asked.where(F.size(F.split("text", r"\s+")) >= 6)
    assert "NestedLoop" not in retrieve.contained(long, docs)._jdf.queryExecution().executedPlan().toString()
    assert retrieve.contained(asked.where("false"), docs).count() == 0
