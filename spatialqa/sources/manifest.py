"""Scene manifests and annotations: reading, upgrading, checking and writing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spatialqa.functions.boxes import portable
from spatialqa.functions.quality import base_status

BOX = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
OBJECT = (f"struct<id:string,category:string,`group`:string,confidence:double,bbox:{BOX},crop_bbox:{BOX},bbox_visible:{BOX},bbox_full:{BOX},"
          f"status:string,error:string,asset_path:string,hd_asset_path:string,mask_path:string,visible_mask_path:string,reconstructed_mask_path:string,"
          f"accepted_asset:string,needs_manual_review:boolean,review_required:boolean,uncertain:boolean,base_asset_status:string,"
          f"logical_size:array<bigint>,qa:struct<status:string,reason:string>,placement:struct<crop_bbox:{BOX}>,"
          f"geometry:struct<visible_bbox:{BOX},visible_mask:string,full_asset_bbox:{BOX},full_asset_canvas:array<bigint>,full_asset_mask:string>,"
          f"enhancement:struct<requested:boolean,status:string,required:boolean>,review:struct<required:boolean,reason:string>>")
MANIFEST = (f"schema_version string, mock boolean, scene_id string, scene struct<width:int,height:int,projection:string>, description string, "
            f"pipeline_status string, objects array<{OBJECT}>, environment_effects array<{OBJECT}>, "
            f"detection struct<instances:array<{OBJECT}>,object_limit:struct<truncated:boolean,objects_before_limit:bigint,objects_after_limit:bigint>>, "
            f"terrain_layers array<struct<id:string,category:string,qa_status:string,uncertain:boolean,mask_path:string,visible_mask_path:string>>, "
            f"resource_failures array<string>")
HEADER = "scene_id string, schema_version string, scene struct<width:int,height:int,projection:string>"
ANNOTATION = ("scene_id string, image string, roi array<int>, objects array<struct<id:string,category:string,bbox:array<int>,mask:string,`group`:string,"
              "ignore:boolean,kind:string>>, ignore_regions array<array<int>>, categories array<string>, annotation_status string, provenance string, scope string")


def read_manifests(spark: SparkSession, path: str, instances: DataFrame | None = None, multiline: bool = True) -> DataFrame:
    """Manifest documents; ``instances(scene_id, instances)`` fills the inventory old runs kept in a side file."""
    docs = spark.read.schema(MANIFEST).json(path, multiLine=multiline).withColumn("source_file", F.col("_metadata.file_path"))
    docs = docs.withColumn("scene_id", F.coalesce("scene_id", F.element_at(F.split("source_file", "/"), -2)))
    if instances is None:
        return docs
    side = instances.withColumnRenamed("instances", "_side")
    filled = F.struct(F.coalesce("detection.instances", "_side").alias("instances"), F.col("detection.object_limit").alias("object_limit"))
    return docs.join(side, "scene_id", "left").withColumn("detection", filled).drop("_side")


def upgraded(o: Column) -> Column:
    """An object in the current shape: geometry, base asset status and enhancement filled in."""
    g = o["geometry"]
    status = base_status(o["error"], F.coalesce(o["accepted_asset"], o["asset_path"]), o["status"], o["qa"]["status"],
                         F.coalesce(o["needs_manual_review"], F.lit(False)) | F.coalesce(o["review_required"], F.lit(False)) | F.coalesce(o["uncertain"], F.lit(False)),
                         F.coalesce(o["visible_mask_path"], o["mask_path"]),
                         F.coalesce(o["enhancement"]["required"], F.lit(False)) & o["review"]["reason"].eqNullSafe(F.lit("required_enhancement")), o["base_asset_status"])
    geometry = F.struct(F.coalesce(g["visible_bbox"], o["bbox_visible"], o["bbox"]).alias("visible_bbox"),
                        F.coalesce(g["visible_mask"], o["visible_mask_path"], o["mask_path"]).alias("visible_mask"),
                        F.coalesce(g["full_asset_bbox"], o["placement"]["crop_bbox"], o["crop_bbox"], o["bbox_full"]).alias("full_asset_bbox"),
                        F.coalesce(g["full_asset_canvas"], o["logical_size"]).alias("full_asset_canvas"),
                        F.coalesce(g["full_asset_mask"], o["reconstructed_mask_path"]).alias("full_asset_mask"))
    hd = o["hd_asset_path"].isNotNull()
    boost = F.coalesce(o["enhancement"], F.struct(hd.alias("requested"), F.when(hd, "ready").otherwise("disabled").alias("status"), F.lit(False).alias("required")))
    return o.withField("geometry", geometry).withField("base_asset_status", F.coalesce(o["base_asset_status"], status)).withField("enhancement", boost)


def upgrade_manifest(docs: DataFrame) -> DataFrame:
    """Documents in the current shape 1.2; 1.1 and 1.2 are accepted, any other version is an error."""
    version = F.coalesce("schema_version", F.lit("1.1"))
    checked = F.when(version.isin("1.1", "1.2"), F.lit("1.2")).otherwise(F.raise_error(F.concat(F.lit("unsupported manifest version "), version)))
    return (docs.withColumn("schema_version", checked).withColumn("pipeline_status", F.coalesce("pipeline_status", F.lit("completed")))
            .withColumn("objects", F.transform("objects", upgraded)).withColumn("environment_effects", F.transform("environment_effects", upgraded)))


def manifest_objects(docs: DataFrame, field: str = "objects") -> DataFrame:
    """One row per object of the documents."""
    return docs.select("scene_id", F.inline(field))


def write_manifests(scenes: DataFrame, objects: DataFrame, path: str, root: str) -> None:
    """Manifests as JSON lines of one shape at any size, paths relative to ``root``.

    ``scenes`` holds one header a scene, ``rows`` one line an object (``scene_id, seq,
    object``), effects in a folder of their own. No scene is gathered.
    ``objects(scene_id, seq, id, category, group, ...)``.
    """
    scenes.select("scene_id", F.lit("1.2").alias("schema_version"), F.struct("width", "height", "projection").alias("scene")).write.json(f"{path}/scenes")
    fields = [c for c in objects.columns if c not in ("scene_id", "seq")]
    paths = [c for c in fields if c.endswith("_path") or c == "accepted_asset"]
    item = F.struct(*((portable(F.col(c), root) if c in paths else F.col(c)).alias(c) for c in fields))
    kind = F.when(F.col("group") == "fx_environment", "environment_effects").otherwise("objects").alias("kind")
    objects.select("scene_id", "seq", item.alias("object"), kind).write.partitionBy("kind").json(f"{path}/rows")


def read_manifest_rows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(headers, ``scene_id, seq, object, kind`` rows) that ``write_manifests`` wrote."""
    return spark.read.schema(HEADER).json(f"{path}/scenes"), spark.read.schema(f"scene_id string, seq bigint, object {OBJECT}, kind string").json(f"{path}/rows")


def upgrade_rows(rows: DataFrame) -> DataFrame:
    return rows.withColumn("object", upgraded(F.col("object")))


def manifest_documents(headers: DataFrame, rows: DataFrame) -> DataFrame:
    """One nested document per scene, objects and effects in ``seq`` order.

    An export for scenes that are opened as single files: a scene becomes one row, as large
    as its document. Nothing else in the library needs it.
    """
    ordered = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("seq", "object")))), lambda s: s["object"]).alias(kind)
    return headers.join(rows.groupBy("scene_id").agg(ordered("objects"), ordered("environment_effects")), "scene_id", "left")


def nan_violations(df: DataFrame) -> DataFrame:
    """Columns holding NaN, which a manifest must not contain; one row per column."""
    names = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    counts = df.agg(*(F.count_if(F.isnan(n)).alias(n) for n in names))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(n).alias("column"), F.col(n).alias("rows")) for n in names))).alias("v")).select("v.*").filter("rows > 0")


def write_tables(tables: dict[str, DataFrame], path: str, form: str = "parquet") -> None:
    """Every table as its own folder below ``path``."""
    for name, df in tables.items():
        df.write.format(form).save(f"{path.rstrip('/')}/{name}")


def artifact_paths(df: DataFrame) -> DataFrame:
    """Distinct non-empty values of all path fields, however deeply nested (``path`` or ``..._path``)."""
    def collect(column: Column, kind, name: str) -> list[Column]:
        type_name = kind.typeName()
        if type_name == "struct":
            return [c for f in kind.fields for c in collect(column.getField(f.name), f.dataType, f.name)]
        if type_name == "array" and kind.elementType.typeName() in ("struct", "array"):
            inner = lambda e: F.flatten(F.array(*parts)) if (parts := collect(e, kind.elementType, name)) else None
            probe = collect(F.lit(None).cast(kind.elementType), kind.elementType, name)
            return [F.flatten(F.transform(column, inner))] if probe else []
        if type_name == "string" and (name == "path" or name.endswith("_path")):
            return [F.array(column)]
        return []
    lists = [c for f in df.schema for c in collect(F.col(f"`{f.name}`"), f.dataType, f.name)]
    merged = F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<string>")) for c in lists)))
    return df.select(F.explode(merged).alias("path")).filter(F.coalesce("path", F.lit("")) != "").distinct()


def read_annotations(spark: SparkSession, path: str, multiline: bool = True) -> DataFrame:
    return spark.read.schema(ANNOTATION).json(path, multiLine=multiline)


def annotation_objects(docs: DataFrame) -> DataFrame:
    at = lambda i: F.get("bbox", F.lit(i))
    rows = docs.select("scene_id", F.posexplode("objects").alias("seq", "o")).select("scene_id", "seq", "o.*")
    return rows.select("scene_id", F.col("id").alias("gt_id"), "seq", "category", "mask", F.coalesce("group", F.lit("other")).alias("grp"),
                       F.coalesce("ignore", F.lit(False)).alias("ignore"), F.coalesce("kind", F.lit("instance")).alias("kind"),
                       at(0).alias("x"), at(1).alias("y"), (at(2) - at(0)).alias("w"), (at(3) - at(1)).alias("h"))


def annotation_inputs(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(annotations, ignore regions, ground truth) of annotation documents, as the evaluation takes them.

    Objects marked ``ignore`` are ignore regions; only instances are scored. Without a
    category list the categories of all the document's objects count. ``seq`` is an object's
    place in its document.
    """
    corner = lambda name, i: F.get(name, F.lit(i))
    listed = F.when(F.size("categories") > 0, F.col("categories")).otherwise(F.array_distinct(F.transform("objects", lambda o: o["category"])))
    annotations = docs.select("scene_id", *(corner("roi", i).alias(n) for i, n in enumerate(("rx0", "ry0", "rx1", "ry1"))), listed.alias("categories"))
    objects = annotation_objects(docs)
    regions = docs.select("scene_id", F.explode("ignore_regions").alias("r")).select(
        "scene_id", corner("r", 0).alias("x"), corner("r", 1).alias("y"), (corner("r", 2) - corner("r", 0)).alias("w"), (corner("r", 3) - corner("r", 1)).alias("h"))
    return annotations, regions.unionByName(objects.filter("ignore").select("scene_id", *"xywh")), objects.filter("not ignore and kind = 'instance'")


def annotation_violations(annotations: DataFrame, gt: DataFrame, ignore: DataFrame) -> DataFrame:
    """One row per broken rule: ``scene_id, item, violation``.

    ``annotations(scene_id, rx0, ry0, rx1, ry1, categories)``; ``gt(scene_id, gt_id, category,
    ignore, x, y, w, h)``; ``ignore(scene_id, x, y, w, h)``.
    """
    c = F.col
    region = annotations.select("scene_id", "rx0", "ry0", "rx1", "ry1", "categories")
    row = lambda df, item, text: df.select("scene_id", item.cast("string").alias("item"), F.lit(text).alias("violation"))
    none = F.lit(None)
    bad_roi = (c("rx0") < 0) | (c("ry0") < 0) | (c("rx1") <= c("rx0")) | (c("ry1") <= c("ry0"))
    inside = (c("x") >= c("rx0")) & (c("y") >= c("ry0")) & (c("x") + c("w") <= c("rx1")) & (c("y") + c("h") <= c("ry1")) & (c("w") > 0) & (c("h") > 0)
    boxed, hidden = gt.join(region, "scene_id"), ignore.join(region, "scene_id")
    unlisted = ~c("ignore") & (F.size("categories") > 0) & ~F.array_contains("categories", c("category"))
    return (row(region.filter(bad_roi), none, "empty region")
            .unionByName(row(gt.filter((c("x") < 0) | (c("y") < 0) | (c("w") <= 0) | (c("h") <= 0)), c("gt_id"), "box without positive area"))
            .unionByName(row(gt.groupBy("scene_id", "gt_id").count().filter("count > 1"), c("gt_id"), "repeated id"))
            .unionByName(row(boxed.filter(~inside), c("gt_id"), "object outside region"))
            .unionByName(row(hidden.filter(~inside), none, "ignore region outside region"))
            .unionByName(row(boxed.filter(unlisted), c("gt_id"), "category not listed")))


def request_violations(requests: DataFrame, objects: DataFrame) -> DataFrame:
    """Edit requests that cannot run: ``object_id, violation``.

    ``requests(object_id, prompt, mask_path)``; ``objects(object_id, asset_path, has_crop)``.
    """
    c = F.col
    row = lambda df, text: df.select("object_id", F.lit(text).alias("violation"))
    empty = lambda name: F.trim(F.coalesce(name, F.lit(""))) == ""
    ready = objects.filter(c("asset_path").isNotNull() & c("has_crop"))
    return (row(requests.filter(~F.coalesce(c("object_id").rlike("^[a-zA-Z0-9_-]+$"), F.lit(False))), "invalid id")
            .unionByName(row(requests.filter(empty("prompt")), "empty prompt")).unionByName(row(requests.filter(empty("mask_path")), "empty mask path"))
            .unionByName(row(requests.groupBy("object_id").count().filter("count > 1"), "repeated id"))
            .unionByName(row(requests.select("object_id").distinct().join(ready, "object_id", "left_anti"), "unknown or uncropped object")))


def scene_violations(scenes: DataFrame) -> DataFrame:
    """Scenes with a wrong size, projection or a repeated id: ``scene_id, violation``."""
    row = lambda df, text: df.select("scene_id", F.lit(text).alias("violation"))
    out = row(scenes.filter((F.coalesce("width", F.lit(0)) < 1) | (F.coalesce("height", F.lit(0)) < 1)), "size must be positive")
    if "projection" in scenes.columns:
        known = F.coalesce(F.col("projection").isin("isometric", "top_down", "perspective", "unknown"), F.lit(False))
        out = out.unionByName(row(scenes.filter(~known), "unknown projection"))
    return out.unionByName(row(scenes.groupBy("scene_id").count().filter("count > 1"), "repeated scene"))
