"""Publication in two phases: reports are staged and named by one atomic step, their vectors complete them, and an epoch's pointer moves by another.

What readers may see is named by small files that come into being at once and whole, and never change: a file is written beside its
place and renamed to it, which fails if something is there. So of several writers one wins, and a writer that is lost between two steps leaves what
the next one goes on from. The file system's rename without overwriting has to be atomic, as HDFS's is.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators import search
from sparkloom.session import shared_folder, table


class Conflict(ValueError):
    """Something else has been published meanwhile."""


def _files(spark: SparkSession, path: str):
    """The Hadoop path, its file system and the configuration."""
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(conf), conf


def create_once(spark: SparkSession, path: str, content: dict) -> bool:
    """Whether this call has made the file: it has its whole content from the start, and an existing one stays as it is."""
    place, files, conf = _files(spark, path)
    beside, _, _ = _files(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    files.mkdirs(place.getParent())
    out = files.create(beside, False)
    out.write(bytearray(json.dumps(content).encode()))
    out.close()
    rename = spark._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename").getEnumConstants()
    options = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = next(x for x in rename if x.toString() == "NONE")
    qualified = files.makeQualified(place)
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(qualified.toUri(), conf).rename(files.makeQualified(beside), qualified, options)
    except Exception as e:
        files.delete(beside, False)
        if files.exists(place):
            return False
        raise e
    return True


def read_once(spark: SparkSession, path: str) -> dict | None:
    """The content of a file that create_once() made, None if there is none."""
    place, files, _ = _files(spark, path)
    if not files.exists(place):
        return None
    return json.loads(spark.read.option("wholetext", "true").text(path).first()["value"])


def discard(spark: SparkSession, path: str) -> None:
    place, files, _ = _files(spark, path)
    files.delete(place, True)


@dataclass(frozen=True)
class Publication:
    """What is published of a structure: where its staged tables are, and where its vectors, None until they are ready."""

    structure: str
    epoch: int
    path: str
    vectors: str | None


def load(spark: SparkSession, folder: str, structure: str) -> Publication | None:
    prepared = read_once(spark, f"{folder}/structures/{structure}/prepared")
    if prepared is None:
        return None
    ready = read_once(spark, f"{folder}/structures/{structure}/ready")
    return Publication(structure, prepared["epoch"], prepared["path"], ready and ready["vectors"])


def prepare(spark: SparkSession, folder: str, structure: str, epoch: int, build: Callable[[], dict[str, DataFrame]], faults: Callable[[dict[str, DataFrame]], DataFrame] | None = None) -> Publication:
    """First phase: writes the tables that build() gives as a whole and names them for the structure.

    What has been prepared before, by whomever, stands, and build() isn't called; for another epoch that is a Conflict. `faults` looks at the written tables; any row
    that it gives is an error, and nothing is named.
    """
    known = load(spark, folder, structure)
    if known is None:
        path = f"{folder}/structures/{structure}/staged-{uuid.uuid4().hex}"
        for name, rows in build().items():
            rows.write.parquet(f"{path}/{name}")
        if faults is not None and (wrong := faults({name: spark.read.parquet(f"{path}/{name}") for name in _tables(spark, path)}).take(1)):
            discard(spark, path)
            raise ValueError(f"{structure} is not sound: {wrong[0].asDict()}")
        if not create_once(spark, f"{folder}/structures/{structure}/prepared", {"epoch": epoch, "path": path}):
            discard(spark, path)  # another writer was first
        known = load(spark, folder, structure)
    if known.epoch != epoch:
        raise Conflict(f"{structure} was prepared for epoch {known.epoch}, not {epoch}")
    return known


def _tables(spark: SparkSession, path: str) -> list[str]:
    place, files, _ = _files(spark, path)
    return [x.getPath().getName() for x in files.listStatus(place)]


def complete(spark: SparkSession, folder: str, structure: str, vectors: Callable[[Publication], DataFrame]) -> Publication:
    """Second phase: writes the vectors of what was prepared, and marks the publication ready. One that is ready stays as it is."""
    known = load(spark, folder, structure)
    if known is None:
        raise ValueError(f"{structure} was not prepared")
    if known.vectors is None:
        path = f"{known.path}/vectors-{uuid.uuid4().hex}"
        vectors(known).write.parquet(path)
        if not create_once(spark, f"{folder}/structures/{structure}/ready", {"vectors": path}):
            discard(spark, path)
        known = load(spark, folder, structure)
    return known


def current_epoch(spark: SparkSession, folder: str, zone: str) -> tuple[int, dict | None]:
    """The number and the content of a zone's current epoch; 0 and None if none is published."""
    place, files, _ = _files(spark, f"{folder}/zones/{zone}")
    numbers = [int(x.getPath().getName()) for x in files.listStatus(place) if x.getPath().getName().isdigit()] if files.exists(place) else []
    if not numbers:
        return 0, None
    if sorted(numbers) != list(range(1, len(numbers) + 1)):
        raise ValueError(f"epochs of {zone} are missing: {sorted(numbers)}")
    return max(numbers), read_once(spark, f"{folder}/zones/{zone}/{max(numbers)}")


def publish_epoch(spark: SparkSession, folder: str, zone: str, expected: int, content: dict) -> int:
    """Compare and set: makes the epoch after `expected`, if that is the current one. Of writers that expect the same one is first, for the others it is a Conflict."""
    now, _ = current_epoch(spark, folder, zone)
    if now != expected or not create_once(spark, f"{folder}/zones/{zone}/{expected + 1}", content):
        raise Conflict(f"epoch {max(now, expected + 1 if now == expected else now)} of {zone} is current, not {expected}")
    return expected + 1


# --- over the driver tables -------------------------------------------------------------------------


def _reports(spark, sf_dir, model) -> Callable[[], dict[str, DataFrame]]:
    part = table(spark, sf_dir, "part")
    prompts = part.groupBy("p_brand").agg(F.count("*").alias("n"), F.max("p_size").alias("size"))
    prompts = prompts.select(F.regexp_extract("p_brand", "[0-9]+", 0).cast("long").alias("key"), "p_brand", F.concat_ws(" ", "p_brand", "n", "size").alias("prompt"))

    def build() -> dict[str, DataFrame]:
        told = search.ask_outcomes(prompts, model).join(prompts.select("key", "p_brand"), "key")
        return {"reports": told.select(F.col("p_brand").alias("part"), F.col("answer").alias("text")), "members": part.select(F.col("p_brand").alias("part"), F.col("p_partkey").alias("node"))}

    return build


def _unsound(tables: dict[str, DataFrame]) -> DataFrame:
    """Reports without a text or a member, and members without a report."""
    empty = tables["reports"].where("text IS NULL OR text = ''").select("part")
    return empty.unionByName(tables["reports"].join(tables["members"], "part", "left_anti").select("part")).unionByName(tables["members"].join(tables["reports"], "part", "left_anti").select("part"))


def report_publication(spark, sf_dir):
    """A writer that is lost between the phases, one that goes on without asking its model, and two that want the same epoch."""
    folder = f"{shared_folder(spark)}/publication-{uuid.uuid4().hex}"
    prepare(spark, folder, "brands", 1, _reports(spark, sf_dir, search.stub_model), _unsound)
    again = prepare(spark, folder, "brands", 1, _reports(spark, sf_dir, lambda prompt: "another text"), _unsound)
    embeddings = table(spark, sf_dir, "embeddings")
    number = F.regexp_extract("part", "[0-9]+", 0).cast("long")
    ready = complete(spark, folder, "brands", lambda known: spark.read.parquet(f"{known.path}/reports").select("part", number.alias("vec_id")).join(embeddings, "vec_id").select("part", "embedding"))
    publish_epoch(spark, folder, "zone", 0, {"structure": again.structure})
    lost = 0
    try:
        publish_epoch(spark, folder, "zone", 0, {"structure": "other"})
    except Conflict:
        lost = 1
    epoch, content = current_epoch(spark, folder, "zone")
    known = load(spark, folder, content["structure"])
    members = spark.read.parquet(f"{known.path}/members").groupBy("part").agg(F.count("*").alias("members"))
    found = spark.read.parquet(f"{known.path}/reports").join(members, "part").join(spark.read.parquet(ready.vectors), "part")
    return found.select("part", "text", "members", F.size("embedding").alias("dimension"), F.lit(epoch).cast("long").alias("epoch"), F.lit(lost).cast("long").alias("conflicts"))


QUERIES = {"report_publication": report_publication}

ORACLE_SQL = {
    "report_publication": "SELECT p_brand AS part, 'answer ' || substr(sha256(p_brand || ' ' || count(*) || ' ' || max(p_size)), 1, 12) AS text, count(*) AS members, CAST(len(any_value(embedding)) AS INT) AS dimension, CAST(1 AS BIGINT) AS epoch, CAST(1 AS BIGINT) AS conflicts FROM part JOIN embeddings ON vec_id = CAST(regexp_extract(p_brand, '[0-9]+') AS BIGINT) GROUP BY p_brand",
}
