"""Provider profiles: the catalog of JSON files, its audit, and patterns for the JVM."""

from __future__ import annotations

import json
import re
import uuid
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

_CAPTURE = "struct<pattern:string,`group`:string,required:boolean,join_following_line:boolean>"
_FIELDS = ("invoice_number", "invoice_date", "customer_code", "customer_name", "taxable_base", "tax_rate", "tax_amount", "invoice_total")
PROFILE = (
    "schema_version int, id string, name string, description string, detection struct<all_terms:array<string>,page_limit:int>, "
    f"header struct<page:int,{','.join(f'{f}:{_CAPTURE}' for f in _FIELDS)}>, "
    "lines struct<mode:string,page:int,user_pattern:string,summary_pattern:string,detail_pattern:string,row_pattern:string,"
    "project_reference_pattern:string,service_names:array<string>>"
)


def provider_catalog(spark: SparkSession, base_dir: str, user_dir: str | None = None) -> DataFrame:
    """Profiles of both folders by id; a user's valid profile stands before the built-in one."""
    read = lambda path, built_in: spark.read.schema(PROFILE + ", _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(path).withColumn("built_in", F.lit(built_in))
    rows = read(base_dir, True)
    if user_dir:
        rows = rows.unionByName(read(user_dir, False))
    rows = rows.where("_corrupt_record is null and id is not null").drop("_corrupt_record")
    return pick_profiles(rows)


def pick_profiles(rows: DataFrame) -> DataFrame:
    """One profile an id, the user's first; invalid ones of users are left out."""
    valid = profile_audit(rows).where("verdict = 'ok' or built_in").select(F.col("id").alias("_id"), F.col("built_in").alias("_built_in"))
    rows = rows.join(valid.distinct(), (F.col("id") == F.col("_id")) & (F.col("built_in") == F.col("_built_in")), "left_semi")
    by = W.partitionBy("id").orderBy("built_in", "name")
    return rows.withColumn("_n", F.row_number().over(by)).where("_n = 1").drop("_n")


#: The file that names the version of a table of profiles that counts.
POINTER = "CURRENT"


def _files(spark: SparkSession, path: str):
    """Hadoop's path class, the file system and the settings of ``path``."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    conf = spark._jsc.hadoopConfiguration()
    return hadoop.Path, hadoop.Path(path).getFileSystem(conf), conf


def _version(spark: SparkSession, path: str) -> str | None:
    """The version that counts, or ``None`` where no table has been saved."""
    new, files, _ = _files(spark, path)
    pointer = new(f"{path}/{POINTER}")
    if not files.exists(pointer):
        return None
    return spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(files.open(pointer)).decode()


def _point(spark: SparkSession, path: str, version: str) -> None:
    """Make ``version`` the one that counts: one rename, so a reader sees the old or the new one."""
    new, files, conf = _files(spark, path)
    aside = new(f"{path}/{POINTER}.{version}")
    out = files.create(aside, True)
    out.write(bytearray(version.encode()))
    out.close()
    rename = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(aside.toUri(), conf).rename(aside, new(f"{path}/{POINTER}"), options)


def load_profiles(spark: SparkSession, path: str) -> DataFrame:
    """The table of profiles as last saved."""
    version = _version(spark, path)
    if version is None:
        raise FileNotFoundError(f"no profiles saved in {path}")
    return spark.read.parquet(f"{path}/{version}")


def save_profiles(spark: SparkSession, profiles: DataFrame, path: str, order: str = "seq") -> DataFrame:
    """Upsert by id into the table in the folder ``path``.

    A call writes a version of its own and then makes it the one that counts, so a call
    that fails on the way leaves the table as it was.  The version before stays for those
    who read it; older ones go.  Of equal ids in one call the one of greatest ``order``
    counts (by its JSON, where that is equal or no column).
    """
    place = [F.desc(c) for c in ([order] if order in profiles.columns else [])] + [F.desc(F.to_json(F.struct(*profiles.columns)))]
    ranked = profiles.withColumn("_n", F.row_number().over(W.partitionBy("id").orderBy(*place)))
    merged = ranked.where("_n = 1").drop("_n", *([order] if order in profiles.columns else []))
    before = _version(spark, path)
    if before is not None:
        old = spark.read.parquet(f"{path}/{before}")
        merged = old.join(merged.select("id"), "id", "left_anti").select(*old.columns).unionByName(merged, allowMissingColumns=True)
    version = f"v-{uuid.uuid4().hex}"
    merged.write.parquet(f"{path}/{version}")
    _point(spark, path, version)
    new, files, _ = _files(spark, path)
    for status in files.listStatus(new(path)):
        name = status.getPath().getName()
        if name.startswith("v-") and name not in (version, before):
            files.delete(status.getPath(), True)
    return load_profiles(spark, path)


def profile_audit(rows: DataFrame) -> DataFrame:
    """``id, built_in, verdict, reasons``: what keeps a stored profile from being used."""
    patterns = F.filter(F.array(*[F.col(f"header.{f}.pattern") for f in _FIELDS], *[F.col(f"lines.{p}") for p in ("user_pattern", "summary_pattern", "detail_pattern", "row_pattern", "project_reference_pattern")]), lambda p: p.isNotNull())

    def lacks(pattern: str, *groups: str):
        p = F.coalesce(F.col(f"lines.{pattern}"), F.lit(""))
        return ~_all([p.contains(f"(?P<{g}>") for g in groups])

    mode, terms = F.col("lines.mode"), F.col("detection.all_terms")
    grouped = lacks("user_pattern", "user") | lacks("summary_pattern", "service", "quantity", "amount") | lacks("detail_pattern", "quantity", "unit_price", "amount")
    checks = {
        "id": ~F.col("id").rlike(r"^[a-z0-9]+(?:-[a-z0-9]+)*\z") | ~F.length("id").between(2, 60),
        "name": ~F.length("name").between(2, 100),
        "terms": terms.isNull() | ~F.size(terms).between(1, 12) | F.exists(terms, lambda t: ~F.length(F.trim(t)).between(1, 100)),
        "page_limit": ~F.coalesce(F.col("detection.page_limit"), F.lit(2)).between(1, 10),
        "header": _any([F.col(f"header.{f}.pattern").isNull() for f in ("invoice_number", "invoice_date", "taxable_base", "invoice_total")]),
        "pages": ~F.coalesce(F.col("header.page"), F.lit(0)).between(0, 50) | ~F.coalesce(F.col("lines.page"), F.lit(1)).between(0, 50),
        "patterns": F.exists(patterns, lambda p: ~F.length(p).between(1, 800)),
        "groups": F.when(mode == "grouped_detail", grouped).when(mode == "flat", lacks("row_pattern", "service", "quantity", "unit_price", "amount")).otherwise(True),
        "reference": F.col("lines.project_reference_pattern").isNotNull() & lacks("project_reference_pattern", "project_reference"),
    }
    reasons = F.filter(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for name, c in checks.items()]), lambda r: r.isNotNull())
    return rows.select("id", "built_in", F.when(F.size(reasons) == 0, "ok").otherwise("invalid").alias("verdict"), F.array_join(reasons, ",").alias("reasons"))


def _all(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out & c
    return out


def _any(columns: list):
    out = columns[0]
    for c in columns[1:]:
        out = out | c
    return out


def java_pattern(pattern: str) -> tuple[str, dict[str, int]]:
    """A Python pattern in Java's syntax, caseless and Unicode, and the numbers of its groups."""
    names = dict(re.compile(pattern, re.IGNORECASE).groupindex)
    plain = re.sub(r"\(\?P<\w+>", "(", pattern)
    plain = re.sub(r"\(\?P=(\w+)\)", lambda m: f"\\{names[m[1]]}", plain)
    return f"(?iuU){plain}", names


def load_profile(text: str) -> dict:
    """One profile from JSON, with the defaults of what it leaves out."""
    profile = json.loads(text)
    profile.setdefault("description", "")
    profile["detection"].setdefault("page_limit", 2)
    profile["header"].setdefault("page", 0)
    profile["lines"].setdefault("page", 1)
    profile["lines"].setdefault("service_names", [])
    if not re.fullmatch(r"[a-z0-9]+(?:-[a-z0-9]+)*", profile["id"]) or PurePosixPath(profile["id"]).name != profile["id"]:
        raise ValueError(f"not a profile id: {profile['id']}")
    return profile
