"""Scans of the formats a study keeps: image folders, manifests, annotations, prediction tables, logs, JSON."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from assaykit.functions.scalar import image_path_ok, number, stem

PREDICTIONS = "image string, class_id int, class_name string, confidence double, x1 double, y1 double, x2 double, y2 double"


def inventory(spark: SparkSession, root: str, splits: tuple[str, ...] = ("train", "val"), suffixes: str = "jpg,jpeg,png,bmp") -> DataFrame:
    """``split, image, stem, bytes`` of the images directly under ``root/images/<split>``; contents are not read."""
    out = None
    glob = "*.{" + ",".join(f for s in suffixes.split(",") for f in (s, s.upper())) + "}"
    for s in splits:
        f = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(f"{root}/images/{s}").select("path", "length")
        f = f.select(F.lit(s).alias("split"), F.concat(F.lit(f"images/{s}/"), F.element_at(F.split("path", "/"), -1)).alias("image"), stem(F.col("path")).alias("stem"), F.col("length").alias("bytes"))
        out = f if out is None else out.union(f)
    return out


def unpaired(images: DataFrame, labels: DataFrame, key: str = "stem") -> DataFrame:
    """``key, problem``: images without a label file and the reverse."""
    a = images.join(labels, key, "left_anti").select(key, F.lit("image_without_label").alias("problem"))
    return a.union(labels.join(images, key, "left_anti").select(key, F.lit("label_without_image").alias("problem")))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """``pos, image, ok`` of a newline list (line ends of any kind), in order; ``ok`` judges the path's form."""
    lines = spark.read.text(path, wholetext=True).select(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n").alias("l"))
    return lines.select(F.posexplode("l").alias("pos", "image")).where("image <> ''").withColumn("ok", image_path_ok(F.col("image")))


def manifest_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of the file with line ends made LF."""
    return spark.read.text(path, wholetext=True).select(F.sha2(F.regexp_replace("value", r"\r\n?", "\n"), 256)).first()[0]


def annotation_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value`` of annotation files; blank lines count in numbering."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+/[^/]+)$", 1).alias("file"), "value")
    return t.select("file", F.posexplode(F.split(F.regexp_replace("value", r"\r\n?", "\n"), "\n")).alias("line", "value")).withColumn("line", F.col("line") + 1)


def boxes(lines: DataFrame, images: DataFrame) -> DataFrame:
    """Pixel boxes of annotation lines: ``gt_id, image, class_id, line, x1..y2``, not clipped; ``images`` has ``stem, image, width, height``."""
    f = F.split(F.trim("value"), r"\s+")
    d = lines.where(F.trim("value") != "").select("file", "line", stem(F.col("file")).alias("stem"), *(f[i].cast("double").alias(c) for i, c in enumerate(("cls", "xc", "yc", "w", "h"))))
    d = d.join(images.select("stem", "image", "width", "height"), "stem")
    x, y = F.col("xc") * F.col("width"), F.col("yc") * F.col("height")
    w, h = F.col("w") * F.col("width") / 2, F.col("h") * F.col("height") / 2
    return d.select(F.concat(F.lit("labels/"), "file", F.lit(":"), F.col("line").cast("string")).alias("gt_id"), "image", F.col("cls").cast("int").alias("class_id"), "line", (x - w).alias("x1"), (y - h).alias("y1"), (x + w).alias("x2"), (y + h).alias("y2"))


def strict_boxes(lines: DataFrame, images: DataFrame, classes: int = 9) -> DataFrame:
    """Pixel boxes as ``boxes`` gives them, where every line has to be right: the job fails at one that is not.

    A line has five fields; its class is a whole number below ``classes``, written as one; centres and sizes are finite and
    within [0, 1], sizes above 0. Blank lines are skipped. A label file without an image is an error.
    """
    f = F.split(F.trim("value"), r"\s+")
    x = [F.try_element_at(f, F.lit(i)).try_cast("double") for i in range(2, 6)]
    whole = F.try_element_at(f, F.lit(1)).rlike("^[+-]?[0-9]+$") & F.try_element_at(f, F.lit(1)).try_cast("int").between(0, classes - 1)
    good = (F.size(f) == 5) & whole
    for i, v in enumerate(x):
        good = good & v.between(0, 1) & ((v > 0) if i > 1 else F.lit(True))
    told = F.concat(F.lit("bad annotation at "), "file", F.lit(":"), F.col("line").cast("string"))
    checked = F.when(F.coalesce(good, F.lit(False)), F.col("value")).otherwise(F.raise_error(told))
    known = lines.where(F.trim("value") != "").withColumn("value", checked)
    lost = lines.select("file").distinct().join(images.select("stem").distinct(), stem(F.col("file")) == F.col("stem"), "left_anti")
    if not lost.isEmpty():
        raise ValueError(f"no image for label file {lost.first()[0]}")
    return boxes(known, images)


def lenient_classes(lines: DataFrame) -> DataFrame:
    """``file, class_id, n``: class counts of annotation lines whose first field is a number; other lines count as none."""
    first = F.try_element_at(F.split(F.trim("value"), r"\s+"), F.lit(1)).try_cast("double").cast("int")
    return lines.select("file", first.alias("class_id")).where("class_id IS NOT NULL").groupBy("file", "class_id").agg(F.count(F.lit(1)).alias("n"))


def box_records(truth: DataFrame, images: DataFrame) -> DataFrame:
    """``truth`` with pixel ``width, height, area`` of each box, and its share of the image."""
    d = truth.join(images.select("image", F.col("width").alias("_w"), F.col("height").alias("_h")), "image")
    w, h = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return d.select(*truth.columns, w.alias("width"), h.alias("height"), (w * h).alias("area"), (w * h / (F.col("_w") * F.col("_h"))).alias("area_share"))


def frozen_manifest(spark: SparkSession, path: str, digest: str, count: int) -> DataFrame:
    """``manifest``, after its digest, number of lines, their form and their uniqueness have been found as they should be."""
    m = manifest(spark, path)
    r = m.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image").alias("d"), F.count_if(~F.col("ok")).alias("bad")).first()
    if manifest_digest(spark, path) != digest:
        raise ValueError(f"{path} has changed")
    if (r["n"], r["d"], r["bad"]) != (count, count, 0):
        raise ValueError(f"{path}: {r['n']} lines, {r['d']} of them different, {r['bad']} of a wrong form; {count} good ones wanted")
    return m


def class_vectors(truth: DataFrame, classes: int) -> DataFrame:
    return truth.groupBy("image").pivot("class_id", list(range(classes))).count().fillna(0)


def label_inventory_digest(files: DataFrame) -> str:
    """One digest of many label files, ``file, value``: of their names and contents' digests, by name."""
    rows = files.select("file", F.sha2("value", 256).alias("d")).orderBy("file").collect()
    return hashlib.sha256("".join(f"{r['file']}\0{r['d']}\n" for r in rows).encode()).hexdigest()


def typed_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """A CSV table whose header has to equal the schema; a bad value fails the read."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").csv(path)


def text_csv(spark: SparkSession, path: str) -> DataFrame:
    """Every column as text, for carrying through unchanged; leading zeros survive."""
    return spark.read.option("header", True).option("inferSchema", False).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)


def training_log(spark: SparkSession, path: str, metrics: list[str], epoch: str = "epoch", exact: bool = False) -> DataFrame:
    """``epoch`` and metrics of a log whose headers may be padded; as DECIMAL(20, 10) if ``exact``."""
    d = text_csv(spark, path)
    d = d.toDF(*(c.strip() for c in d.columns))
    return d.select(F.col(epoch).cast("int").alias("epoch"), *(F.col(f"`{m}`").cast("decimal(20,10)" if exact else "double").alias(m) for m in metrics))


def contiguous(log: DataFrame, epochs: int) -> bool:
    """Whether the log holds each epoch from 1 to ``epochs`` once."""
    r = log.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("epoch").alias("d"), F.min("epoch").alias("lo"), F.max("epoch").alias("hi")).first()
    return (r["n"], r["d"], r["lo"], r["hi"]) == (epochs, epochs, 1, epochs)


def selected_epoch(spark: SparkSession, path: str, epochs: int, metric: str) -> tuple[int, str]:
    """The first epoch with the largest value of ``metric`` in a log that has to hold each epoch once; decimals compare
    as written."""
    log = training_log(spark, path, [metric], exact=True)
    if not contiguous(log, epochs):
        raise ValueError(f"{path} does not hold epochs 1 to {epochs} once each")
    top = log.orderBy(F.desc(metric), "epoch").first()
    return top["epoch"], str(top[metric])


def json_object(spark: SparkSession, path: str) -> dict:
    """One JSON file, which has to hold an object."""
    text = spark.read.text(path, wholetext=True).first()
    found = json.loads(text[0]) if text else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no JSON object")
    return found


def yaml_object(spark: SparkSession, path: str, allowed: set[str] | None = None) -> dict:
    """One YAML file, which has to hold a mapping; keys outside ``allowed`` are an error."""
    import yaml

    text = spark.read.text(path, wholetext=True).first()
    found = yaml.safe_load(text[0]) if text else None
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no mapping")
    if allowed is not None and set(found) - allowed:
        raise ValueError(f"{path}: unknown settings {sorted(set(found) - allowed)}")
    return found


def dataset_problems(images: DataFrame, labels: DataFrame, manifests: DataFrame, names: list[str], expected: list[str]) -> DataFrame:
    """``problem, n`` of a data set: images without labels and the reverse, manifest lines without an image, images that
    no manifest lists or two do, stems that occur in two splits, and class names other than expected."""
    listed = manifests.groupBy("image").agg(F.count(F.lit(1)).alias("k"))
    spark = images.sparkSession
    parts = {
        "image_without_label": images.join(labels.select("split", "stem").distinct(), ["split", "stem"], "left_anti"),
        "label_without_image": labels.join(images.select("split", "stem").distinct(), ["split", "stem"], "left_anti"),
        "listed_without_image": listed.join(images.select("image"), "image", "left_anti"),
        "not_listed": images.join(listed, "image", "left_anti"),
        "listed_twice": listed.where("k > 1"),
        "stem_in_two_splits": images.groupBy("stem").agg(F.count_distinct("split").alias("k")).where("k > 1"),
        "class_names_differ": spark.range(int(names != expected)),
    }
    out = None
    for name, p in parts.items():
        one = p.agg(F.lit(name).alias("problem"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.union(one)
    return out


def json_table(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def saved_numbers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text columns as numbers; blanks and non-finite ones NULL."""
    return df.withColumns({c: number(F.col(c)) for c in columns})


def numbered(df: DataFrame, partition: list[str], order: list[str]) -> DataFrame:
    """``source_row`` (from 1, within ``partition``) over unfiltered rows, and ``prediction_id``."""
    d = df.withColumn("source_row", F.row_number().over(Window.partitionBy(*partition).orderBy(*order)))
    return d.withColumn("prediction_id", F.concat_ws("#", *(F.col(c).cast("string") for c in partition), F.col("source_row").cast("string")))


