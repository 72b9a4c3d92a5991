"""Routed distances in place of the estimates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.num import round_half_up
from ..schemas import ROUTE
from ..scratch import stored

PAIR = ["city", "residence_id", "job_id"]
RESPONSES = f"city string, residence_id string, job_id string, request string, version long, {ROUTE}"


def route_requests(pops: DataFrame, points: DataFrame) -> DataFrame:
    """One request for each distinct pair of sites: from the job to the residence."""
    at = points.select("city", "id", "location")
    home = at.select("city", F.col("id").alias("residence_id"), F.col("location").alias("home_at"))
    work = at.select("city", F.col("id").alias("job_id"), F.col("location").alias("work_at"))
    pairs = pops.select("city", "residence_id", "job_id").distinct().join(home, ["city", "residence_id"]).join(work, ["city", "job_id"])
    return pairs.select("city", "residence_id", "job_id", F.concat_ws(";", F.array_join(F.transform("work_at", lambda x: x.cast("string")), ","), F.array_join(F.transform("home_at", lambda x: x.cast("string")), ",")).alias("request"))


def latest(responses: DataFrame) -> DataFrame:
    """Of each pair the response of the last version; of several in it one with a route, if any has."""
    last = F.struct("version", F.col("routes").isNotNull().alias("found"))
    one = responses.groupBy(*PAIR).agg(F.max_by(F.struct("request", "version", "routes"), last).alias("r"))
    return one.select(*PAIR, "r.*")


def to_ask(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests that no response answers: new pairs, pairs whose places have moved, and those that had no route."""
    known = latest(responses).filter("routes is not null").select(*PAIR, "request")
    return requests.select(*PAIR, "request").distinct().join(known, [*PAIR, "request"], "left_anti")


def routed_once(requests: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The latest responses to ``requests``, asking for those alone that the table at ``path`` lacks.

    ``fetch`` gets the requests to be asked (city, residence_id, job_id,
    request) and gives them back with routes, null where the router failed.
    What it gives is appended as the table's next version; a run that breaks
    off leaves no half version, and one without new requests doesn't call it.
    """
    spark = requests.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    responses = spark.read.schema(RESPONSES).parquet(path) if there else spark.createDataFrame([], RESPONSES)
    new = stored(to_ask(requests, responses), "requests")
    if not new.isEmpty():
        version = (responses.agg(F.max("version")).first()[0] or 0) + 1
        answers = fetch(new).select(*PAIR, "request", F.lit(version).cast("long").alias("version"), "routes")
        answers.write.mode("append").parquet(path)
        responses = spark.read.schema(RESPONSES).parquet(path)
    wanted = requests.select(*PAIR, "request").distinct()
    return latest(responses).join(wanted, [*PAIR, "request"], "left_semi")


def enriched(pops: DataFrame, responses: DataFrame) -> DataFrame:
    """Pops with the routed distance, time and path; the estimate where there is no route.

    ``responses`` has city, residence_id, job_id and routes (see ``schemas.ROUTE``).
    """
    route = F.col("routes")[0]
    path = F.flatten(F.transform(route["legs"][0]["steps"], lambda s: s["geometry"]["coordinates"]))
    found = responses.filter("routes is not null").select("city", "residence_id", "job_id", round_half_up(route["distance"]).alias("routed_m"), round_half_up(route["duration"]).alias("routed_s"), path.alias("driving_path"))
    out = pops.join(found, ["city", "residence_id", "job_id"], "left")
    return out.withColumn("driving_distance", F.coalesce("routed_m", "driving_distance")).withColumn("driving_seconds", F.coalesce("routed_s", "driving_seconds")).drop("routed_m", "routed_s")
