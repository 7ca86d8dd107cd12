"""Media operators: frame times, detections, spatial relations, graph assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def frame_times(duration: Column, n: int = 8) -> Column:
    """``n`` evenly spaced times inside margins of at most 0.4 s; distinct, rounded to milliseconds."""
    margin = F.when(duration > 2, F.least(F.lit(0.4), duration * 0.03)).otherwise(F.lit(0.0))
    step = (duration - 2 * margin) / F.lit(max(1, n - 1))
    times = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.floor((margin + step * k) * 1000 + 0.5) / 1000)
    return F.when(F.coalesce(duration, F.lit(0.0)) <= 0, F.array(F.lit(0.0))).otherwise(F.array_distinct(times))


# Label words of the two families, and labels that name no family's member.
FIREARMS = ("gun", "firearm", "pistol", "revolver", "rifle", "shotgun")
BLADES = ("knife", "blade", "machete", "dagger")
GENERIC = ("weapon", "firearm")
PRIORITY = (
    "person", "vehicle", "car", "van", "truck", "motorcycle", "bicycle", "boat", "airplane", "suitcase", "backpack", "bag", "handbag", "knife", "gun", "firearm", "rifle", "pistol",
    "shotgun", "weapon", "baton", "mask", "helmet",
)


def plain_label(label: Column) -> Column:
    """Lower case, with single spaces for runs of spaces, underscores and hyphens."""
    low = F.lower(F.trim(F.coalesce(label, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"[_\-]+", " "), r"\s+", " ")


def label_family(label: Column) -> Column:
    """``firearm`` or ``blade`` where a word says so, ``weapon`` for a generic label, else the label itself."""
    words = F.split(F.trim(plain_label(label)), " ")
    has = lambda values: F.arrays_overlap(words, F.array(*[F.lit(v) for v in values]))
    return F.when(has(FIREARMS), "firearm").when(has(BLADES), "blade").when(plain_label(label).isin(*GENERIC), "weapon").otherwise(plain_label(label))


def is_priority(label: Column, labels: tuple[str, ...] = PRIORITY) -> Column:
    return plain_label(label).isin(*labels) | label_family(label).isin("firearm", "blade", "weapon")


def iou(a: Column, b: Column) -> Column:
    """Shared area of two boxes in the area of both; 0 where there is none."""
    side = lambda c: F.greatest(F.lit(0.0), F.least(a[f"{c}2"], b[f"{c}2"]) - F.greatest(a[f"{c}1"], b[f"{c}1"]))
    area = lambda x: F.greatest(F.lit(0.0), x["x2"] - x["x1"]) * F.greatest(F.lit(0.0), x["y2"] - x["y1"])
    shared = side("x") * side("y")
    whole = area(a) + area(b) - shared
    return F.when(whole > 0, shared / whole).otherwise(F.lit(0.0))


def merge_detections(detections: DataFrame, least_iou: float = 0.55) -> DataFrame:
    """One detection for those of a frame and family that overlap, in the order of priority, confidence and id.

    Each joins the first kept one of its family that it overlaps enough; of the two the one that is a priority object, names a
    family's member rather than something generic, has the longer label, or the higher confidence stays, with the priority
    of either and the sources of both. A fold over a frame's detections in built-in functions.
    detections: ``frame_id, detection_id, label, confidence, priority, x1, y1, x2, y2`` and maybe ``source``. Those without
    a whole box go.
    """
    box = ["x1", "y1", "x2", "y2"]
    rows = detections.dropna(subset=box) if "source" in detections.columns else detections.dropna(subset=box).withColumn("source", F.lit("").cast("string"))
    other = [c for c in rows.columns if c not in ("frame_id", "priority", "confidence", "source")]
    plain = plain_label(F.col("label"))
    family = label_family(F.col("label"))
    rows = rows.select("frame_id", F.struct(
        F.coalesce(F.col("priority").cast("int"), F.lit(0)).alias("priority"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), *other,
        F.filter(F.split(F.coalesce("source", F.lit("")), r"\+"), lambda x: F.trim(x) != "").alias("source"), family.alias("_family"),
        (family.isin("firearm", "blade") | ~plain.isin(*GENERIC)).cast("int").alias("_names"), F.length(F.replace(plain, F.lit(" "), F.lit(""))).alias("_long"),
    ).alias("d"))

    def before(a: Column, b: Column) -> Column:
        first = lambda x, y, then: F.when(x > y, -1).when(x < y, 1).otherwise(then)
        return first(a["priority"], b["priority"], first(a["confidence"], b["confidence"], first(b["detection_id"], a["detection_id"], F.lit(0))))

    def better(kept: Column, new: Column) -> Column:
        order = lambda d: F.struct(F.when(d["priority"] > 0, 1).otherwise(0), d["_names"], d["_long"], d["confidence"])
        sources = F.array_sort(F.array_union(kept["source"], new["source"]))
        won = F.when(order(new) > order(kept), new).otherwise(kept)
        return won.withField("source", sources).withField("priority", F.greatest(kept["priority"], new["priority"]))

    def take(held: Column, new: Column) -> Column:
        meets = F.transform(held, lambda k: (k["_family"] == new["_family"]) & (iou(k, new) >= least_iou))
        at = F.coalesce(F.array_position(meets, F.lit(True)).cast("int"), F.lit(0))
        return F.when(at == 0, F.concat(held, F.array(new))).otherwise(F.transform(held, lambda k, i: F.when(i == at - 1, better(k, new)).otherwise(k)))

    lists = rows.groupBy("frame_id").agg(F.array_sort(F.collect_list("d"), before).alias("ds"))
    merged = lists.select("frame_id", F.explode(F.aggregate("ds", F.slice("ds", 1, 0), take)).alias("d")).select("frame_id", "d.*")
    types = dict(detections.dtypes)
    out = merged.withColumns({"source": F.array_join("source", "+"), "priority": F.col("priority").cast(types["priority"])})
    return out.select(*detections.columns)


def spatial_relations(boxes: DataFrame, near: float = 0.22) -> DataFrame:
    """``frame_id, a, b, relation_type, confidence``: which detections hold, lie in, or are near each other.

    The distance of centres is measured against the frame's diagonal: ``width, height`` of the frame are columns.
    """
    side = lambda s: boxes.select("frame_id", *[F.col(c).alias(f"{s}_{c}") for c in ("detection_id", "confidence", "x1", "y1", "x2", "y2", "width", "height")])
    p = side("a").join(side("b"), "frame_id").where("a_detection_id < b_detection_id")
    holds = lambda o, i: (F.col(f"{o}_x1") <= F.col(f"{i}_x1")) & (F.col(f"{o}_y1") <= F.col(f"{i}_y1")) & (F.col(f"{o}_x2") >= F.col(f"{i}_x2")) & (F.col(f"{o}_y2") >= F.col(f"{i}_y2"))
    mid = lambda s, c: (F.col(f"{s}_{c}1") + F.col(f"{s}_{c}2")) / 2
    far = F.sqrt(F.pow(mid("a", "x") - mid("b", "x"), 2) + F.pow(mid("a", "y") - mid("b", "y"), 2)) / F.sqrt(F.pow("a_width", F.lit(2)) + F.pow("a_height", F.lit(2)))
    kind = F.when(holds("a", "b"), "CONTAINS").when(holds("b", "a"), "INSIDE").when(far <= near, "NEAR")
    return p.select("frame_id", F.col("a_detection_id").alias("a"), F.col("b_detection_id").alias("b"), kind.alias("relation_type"), F.least("a_confidence", "b_confidence").alias("confidence")).where("relation_type is not null")


def position_text(x: Column, y: Column) -> Column:
    """Where a centre (in shares of the frame) lies, in thirds."""
    across = F.when(x < 0.34, "left").when(x > 0.66, "right").otherwise("centre")
    down = F.when(y < 0.34, "upper").when(y > 0.66, "lower").otherwise("middle")
    return F.when((across == "centre") & (down == "middle"), F.lit("near the centre of the frame")).otherwise(F.concat(F.lit("in the "), down, F.lit(" "), across, F.lit(" of the frame")))


def scale_text(share: Column) -> Column:
    return F.when(share >= 0.30, "large").when(share >= 0.08, "medium-sized").otherwise("small")


def describe_frames(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """``frame_id, description``: the four most frequent labels, priority items, and where the first three objects are.

    frames: ``frame_id, media_name, frame_index, timestamp_seconds, width, height``; detections of a frame count in the order
    of priority, confidence and id.
    """
    w, h = F.greatest(F.col("width").cast("double"), F.lit(1.0)), F.greatest(F.col("height").cast("double"), F.lit(1.0))
    d = detections.join(frames.select("frame_id", "width", "height"), "frame_id")
    share = F.greatest(F.lit(0.0), (F.col("x2") - F.col("x1")) * (F.col("y2") - F.col("y1"))) / F.greatest(F.lit(1.0), F.col("width").cast("double") * F.col("height").cast("double"))
    kind = F.when(F.col("priority").cast("int") > 0, "priority object").otherwise("object")
    source = F.coalesce(F.when(F.col("source") != "", F.col("source")), F.lit("unknown")) if "source" in detections.columns else F.lit("unknown")
    where = position_text((F.col("x1") + F.col("x2")) / 2 / w, (F.col("y1") + F.col("y2")) / 2 / h)
    label = F.coalesce(F.when(F.col("label") != "", F.col("label")), F.lit("object"))
    fact = F.concat(label, F.lit(" ("), F.format_string("%.2f", F.bround(F.col("confidence").cast("double"), 2)), F.lit(", "), kind, F.lit(", "), scale_text(share), F.lit(", "), where, F.lit(", detector="), source, F.lit(")"))
    d = d.select("frame_id", F.struct((-F.col("priority").cast("int")).alias("p"), (-F.col("confidence")).alias("c"), "detection_id", label.alias("label"), fact.alias("fact")).alias("d"))
    per = d.groupBy("frame_id").agg(F.array_sort(F.collect_list("d")).alias("ds"))
    labels = F.transform("ds", lambda x: x["label"])
    counted = F.transform(F.array_distinct(labels), lambda x, i: F.struct((-F.size(F.filter(labels, lambda y: y == x))).alias("n"), i.alias("i"), x.alias("label")))
    some = F.transform(F.slice(F.array_sort(counted), 1, 4), lambda x: F.concat((-x["n"]).cast("string"), F.lit(" "), x["label"], F.when(x["n"] == -1, "").otherwise("s")))
    facts = F.transform(F.slice("ds", 1, 3), lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x["fact"]))
    first = F.array_distinct(F.transform(F.filter("ds", lambda x: x["p"] < 0), lambda x: x["label"]))
    named = F.concat(F.lit("Frame "), (F.col("frame_index") + 1).cast("string"), F.lit(" of "), F.col("media_name"), F.when(F.col("timestamp_seconds") > 0, F.concat(F.lit(" at "), F.format_string("%.1f", F.bround(F.col("timestamp_seconds").cast("double"), 1)), F.lit("s"))).otherwise(F.lit("")))
    flagged = F.when(F.size(first) > 0, F.concat(F.lit(" Priority items noted: "), F.array_join(first, ", "), F.lit("."))).otherwise(F.lit(""))
    shown = F.concat(named, F.lit(" shows "), F.array_join(some, ", "), F.lit("."), flagged, F.lit(" Key placements: "), F.array_join(facts, "; "), F.lit("."))
    return frames.join(per, "frame_id", "left").select("frame_id", F.when(F.col("ds").isNull(), F.concat(named, F.lit(" contains no confident object detections."))).otherwise(shown).alias("description"))


def media_graph(assets: DataFrame, frames: DataFrame, detections: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) over assets, frames and detections; an asset counts once for its hash, path or name."""
    from casewright.operators.store import latest

    key = F.coalesce("source_hash", F.lower("filepath"), F.lower("filename"))
    assets = latest(assets.withColumn("_k", key), ["_k"], [F.desc_nulls_last("created_at"), F.asc("asset_id")]).drop("_k")
    frames = frames.join(assets.select("asset_id"), "asset_id", "left_semi")
    detections = detections.join(frames.select("frame_id"), "frame_id", "left_semi")
    node = lambda df, key, kind, label: df.select(F.col(key).alias("node"), F.lit(kind).alias("kind"), F.col(label).alias("label"))
    nodes = node(assets, "asset_id", "asset", "filename").unionByName(node(frames, "frame_id", "frame", "description")).unionByName(node(detections, "detection_id", "detection", "label"))
    edge = lambda df, a, b, kind: df.select(F.col(a).alias("source"), F.col(b).alias("target"), kind.alias("relation_type"))
    edges = edge(frames, "asset_id", "frame_id", F.lit("HAS_FRAME")).unionByName(edge(detections, "frame_id", "detection_id", F.lit("HAS_DETECTION"))).unionByName(edge(relations, "source_detection_id", "target_detection_id", F.col("relation_type")))
    return nodes, edges


def evidence_rows(frames: DataFrame, detections: DataFrame) -> DataFrame:
    """Frames and detections as chunks of their documents, with indexes from 10000."""
    from pyspark.sql.window import Window

    rows = frames.select("doc_id", F.concat(F.lit("media-frame:"), "frame_id").alias("chunk_id"), F.col("description").alias("text")).unionByName(detections.select("doc_id", F.concat(F.lit("media-object:"), "detection_id").alias("chunk_id"), F.col("description").alias("text")))
    return rows.withColumn("chunk_index", F.lit(9999) + F.row_number().over(Window.partitionBy("doc_id").orderBy("chunk_id")))
