"""The operations behind requests: from a request to a status and a body, without a server."""

from __future__ import annotations

import os
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.control.jobs import Jobs
from gridloom.control.requests import RequestError, library_place, parse
from gridloom.operators import library, mosaic, pictures, upkeep

SHOWN = 50
USAGE = "image_id bigint, total_runs int, total_tiles bigint, last_used timestamp_ntz"

# Method, path, operation, status of success, key of the payload, statuses of failure.
ENDPOINTS = (
    ("GET", "/api/endpoints", "endpoints", 200, "endpoints", ()),
    ("GET", "/api/info", "info", 200, "api", ()),
    ("GET", "/api/ping", "ping", 200, "message", ()),
    ("POST", "/api/mosaic", "mosaic", 202, "job", (400, 500)),
    ("POST", "/api/jobs/mosaic", "mosaic", 202, "job", (400, 500)),
    ("POST", "/api/jobs/build", "build", 202, "job", (400, 500)),
    ("GET", "/api/jobs", "list_jobs", 200, "jobs", ()),
    ("DELETE", "/api/jobs", "clear_jobs", 200, "removed", ()),
    ("GET", "/api/jobs/{id}", "get_job", 200, "job", (404,)),
    ("DELETE", "/api/jobs/{id}", "cancel_job", 200, "job", (404, 409)),
    ("GET|POST", "/api/db/stats", "stats", 200, "stats", (400, 500)),
    ("GET|POST", "/api/db/health", "health", 200, "health", (400, 500)),
    ("GET|POST", "/api/db/usage", "usage", 200, "usage", (400, 500)),
    ("POST", "/api/db/usage/export", "export", 200, "export", (400, 500)),
    ("GET|POST", "/api/db/purge", "purge", 200, "purge", (400, 500)),
    ("GET|POST", "/api/inspect", "inspect", 200, "inspect", (400,)),
    ("POST", "/api/run", "run", 200, "message", (404, 429)),
)


def failure(message: str, **more) -> dict:
    return {"ok": False, "message": message} | more


def contract_errors(operation: str, status: int, body: object) -> list[str]:
    """What a response has that its endpoint does not declare; empty if it keeps to it."""
    declared = next((e for e in ENDPOINTS if e[2] == operation), None)
    if declared is None:
        return [f"unknown operation: {operation}"]
    _, _, _, success, key, errors = declared
    if not isinstance(body, dict) or not isinstance(body.get("ok"), bool):
        return ["body has no boolean ok"]
    wrong = []
    if 200 <= status < 300:
        wrong += [f"status {status} is not {success}"] * (status != success) + ["a success with ok = false"] * (not body["ok"]) + [f"no {key}"] * (key not in body)
    else:
        wrong += [f"status {status} is not declared"] * (status not in errors) + ["a failure with ok = true"] * body["ok"] + ["a failure without message"] * (not isinstance(body.get("message"), str))
    return wrong


class Service:
    """Operations over library folders (tables images, meta, usage). Mosaics and builds are jobs; start = False leaves them queued."""

    def __init__(self, spark: SparkSession, start: bool = True):
        self.spark = spark
        self.jobs = Jobs(self.run, start)

    def call(self, operation: str, body: str = "", query: dict[str, str] | None = None, name: str = "") -> tuple[int, dict]:
        """(status, body) of an operation; name is a job's where one is meant."""
        if operation in ("endpoints", "info", "ping"):
            listed = [{"method": m, "path": p, "operation": o, "successStatus": s, "responseKey": k, "errors": list(e)} for m, p, o, s, k, e in ENDPOINTS]
            return 200, {"ok": True} | {"endpoints": {"endpoints": listed}, "info": {"api": {"name": "gridloom", "endpoints": len(listed)}}, "ping": {"message": "pong"}}[operation]
        if operation == "list_jobs":
            return 200, {"ok": True, "jobs": [j.shown() for j in self.jobs.all()]}
        if operation == "clear_jobs":
            return 200, {"ok": True, "removed": self.jobs.clear_finished()}
        if operation in ("get_job", "cancel_job"):
            done, job = (True, self.jobs.get(name)) if operation == "get_job" else self.jobs.cancel(name)
            if job is None:
                return 404, failure("job not found")
            return (200, {"ok": True, "job": job.shown()}) if done else (409, failure("only queued jobs can be canceled", job=job.shown()))
        if operation == "run":
            return 404, failure("one-line commands are not run here")
        try:
            request = parse(operation, body, query)
        except RequestError as e:
            return 400, failure(str(e), exitCode=1)
        if operation in ("mosaic", "build"):
            return 202, {"ok": True, "job": self.jobs.submit(operation, request).shown()}
        if operation in ("export", "purge") and not request["confirm"] and (operation == "export" or not request["dryRun"]):
            return 400, failure("confirm is needed", exitCode=1, **{operation: {"outputDir": request["outputDir"]} if operation == "export" else {"dryRun": False}})
        try:
            return 200, {"ok": True, "exitCode": 0, "message": f"{operation} done", operation: getattr(self, operation)(request)}
        except Exception as e:  # noqa: BLE001
            return 400 if operation == "inspect" else 500, failure(str(e).splitlines()[0], exitCode=2)

    def run(self, kind: str, request: dict) -> dict:
        place = library_place(request["dbPath"] or request.get("outputDir", ""))
        if kind == "build":
            if request["forceMode"] and not request["appendMode"]:
                for name in ("images.parquet", "meta.parquet"):
                    shutil.rmtree(f"{place}/{name}", ignore_errors=True)
            return pictures.build_library(self.spark, request["inputDir"], place, request["normalizeWidth"], request["normalizeHeight"], request["recursive"], request["appendMode"])
        weights = tuple(request[f"{k}Weight"] for k in ("lab", "grid", "tiny", "edge", "lbp"))
        done = mosaic.make_mosaic(
            self.spark, request["inputPath"], place, request["outputPath"], request["tileW"], request["tileH"], request["outW"], request["outH"], request["upscale"], request["nativeTileW"], request["nativeTileH"],
            request["candidates"], request["topNrandom"], request["neighborWindow"], request["neighborPenalty"], request["adaptiveWeights"], weights, request["usePenalty"], request["format"] or None, request["pngLevel"],
            request["colorStrength"] if request["colorAdjust"] else 0.0, report=request["analyze"],
        )
        if request["analyze"]:
            self.record_usage(place, request["outputPath"], done["target_hash"])
        return done

    def _table(self, request: dict, name: str, schema: str | None = None) -> DataFrame:
        path = f"{library_place(request['dbPath'])}/{name}.parquet"
        if os.path.exists(path):
            return self.spark.read.parquet(path)
        if schema is None:
            raise ValueError(f"cannot open library: {request['dbPath']}")
        return self.spark.createDataFrame([], schema)

    def _replace(self, place: str, name: str, rows: DataFrame) -> None:
        """A table in place of another: the new one is whole before the old one goes."""
        fresh, old = f"{place}/.{name}-{uuid.uuid4().hex}", f"{place}/{name}.parquet"
        rows.write.parquet(fresh)
        if os.path.exists(old):
            os.replace(old, f"{fresh}.old")
        os.replace(fresh, old)
        shutil.rmtree(f"{fresh}.old", ignore_errors=True)

    def record_usage(self, place: str, path: str, target: str) -> None:
        """Adds a finished mosaic's winners to the library's usage, and its target to the targets seen; a target counts runs once."""
        request = {"dbPath": place}
        winners = self.spark.read.parquet(f"{path}.winners").withColumn("target_hash", F.lit(target))
        seen = self._table(request, "target_runs", "target_hash string, run_count int")
        usage = library.recorded_usage(self._table(request, "usage", USAGE), winners, seen)
        usage = usage.select("image_id", F.col("total_runs").cast("int").alias("total_runs"), "total_tiles", F.current_timestamp().cast("timestamp_ntz").alias("last_used"))
        runs = seen.unionByName(self.spark.createDataFrame([(target, 1)], "target_hash string, run_count int")).groupBy("target_hash").agg(F.sum("run_count").cast("int").alias("run_count"))
        self._replace(place, "usage", usage)
        self._replace(place, "target_runs", runs)

    def stats(self, request: dict) -> dict:
        images = self._table(request, "images")
        row = library.library_stats(images).first().asDict()
        meta = {r.key: r.value for r in self._table(request, "meta", "key string, value string").collect()}
        bins = [{"lo": int(r.label.split("-")[0]), "hi": int(r.label.split("-")[1]), "count": r.n} for r in library.l_histogram(images).orderBy("bin").collect()]
        lab = {f"{k}{c.upper()}": row[f"{s}_{c}"] for c in "lab" for k, s in (("min", "min"), ("max", "max"), ("avg", "mean"))}
        return {
            "empty": row["total"] == 0, "total": row["total"], "featureWidth": meta.get("feature_w", "?"), "featureHeight": meta.get("feature_h", "?"), "gridDim": 192, "lab": lab,
            "brightness": {k: row[k] for k in ("dark", "mid", "bright")}, "lHistogram": bins, "coverageGaps": [r.rule for r in library.coverage_gaps(images).collect()],
        }

    def health(self, request: dict) -> dict:
        r = library.health_report(self._table(request, "images"), self._table(request, "usage", USAGE)).first().asDict()
        return {
            "empty": r["total"] == 0, "total": r["total"], "brightness": {"dark": r["dark"], "mid": r["mid"], "bright": r["bright"], "darkPct": r["dark_pct"], "midPct": r["mid_pct"], "brightPct": r["bright_pct"]},
            "colorGamut": {"minA": r["min_a"], "maxA": r["max_a"], "minB": r["min_b"], "maxB": r["max_b"]},
            "usage": {"usedCount": r["used"], "unusedCount": r["unused"], "usedPct": r["used_pct"], "unusedPct": r["unused_pct"]}, "hotspot": {"topHotspotTilePct": r["hotspot_pct"]},
            "warnings": [k[5:] for k, v in r.items() if k.startswith("warn_") and v], "recommendations": [library.ADVICE[k] for k in r["advice"].split(",") if k],
        }

    def usage(self, request: dict) -> dict:
        images, usage = self._table(request, "images"), self._table(request, "usage", USAGE)
        top = [{"id": r.image_id, "runs": r.total_runs, "tiles": r.total_tiles} for r in library.top_used(library.merged_usage(usage), request["limit"]).collect()]
        unused = library.unused_images(images, usage)
        shown = [{"id": r.id, "filePath": r.file_path} for r in unused.orderBy("id").limit(SHOWN).collect()] if request["showUnused"] else []
        total = images.count()
        return {"empty": total == 0, "total": total, "top": top, "unusedCount": unused.count(), "unusedPreview": shown}

    def export(self, request: dict) -> dict:
        done = upkeep.export_files(self._table(request, "usage", USAGE), self._table(request, "images"), request["outputDir"])
        counts = {r.status: r["count"] for r in done.groupBy("status").count().collect()}
        return {"outputDir": request["outputDir"], "exported": counts.get("exported", 0), "skipped": counts.get("missing", 0) + counts.get("unknown", 0), "failed": counts.get("failed", 0)}

    def purge(self, request: dict) -> dict:
        images = self._table(request, "images")
        gone = upkeep.rows_without_file(images)
        found = {"dryRun": request["dryRun"], "orphans": gone.count(), "preview": [{"id": r.id, "filePath": r.file_path} for r in gone.orderBy("id").limit(SHOWN).collect()], "removed": 0}
        if not request["dryRun"] and found["orphans"]:
            self._replace(library_place(request["dbPath"]), "images", upkeep.purged(images))
            found["removed"] = found["orphans"]
        return found

    def inspect(self, request: dict) -> dict:
        got = pictures.decoded(self.spark, request["imagePath"]).take(1) if request["imagePath"] else []
        if not got or got[0].channels not in (1, 3, 4):
            raise ValueError("image can't be read")
        seen = pictures.features(pictures._bgr(bytes(got[0].data), got[0].width, got[0].height, got[0].channels))
        shown = {"width": got[0].width, "height": got[0].height} | {k: float(seen[k]) for k in ("avg_l", "avg_a", "avg_b", "mean_brightness", "edge_density")} | {"databaseAvailable": False, "databaseTotal": 0}
        try:
            images = self._table(request, "images")
        except ValueError:
            return shown
        near = library.band_join(self.spark.createDataFrame([(0, shown["avg_l"])], "q int, l double"), images).collect()
        return shown | {"databaseAvailable": True, "databaseTotal": images.count(), "near": {k: x for k, x in near[0].asDict().items() if k != "q"} if near else {"n": 0}}
