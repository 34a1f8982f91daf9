"""Requests, jobs and the service."""

from __future__ import annotations

import json
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.control.jobs import Jobs
from gridloom.control.requests import RequestError, checked_command, library_place, parse
from gridloom.control.service import ENDPOINTS, Service, contract_errors
from gridloom.operators import mosaic, upkeep
from tests.test_end_to_end import picture, save


@pytest.mark.parametrize(
    "operation, body, query, message",
    [
        ("mosaic", {"writeMode": "invalid"}, None, "writeMode must be auto, stream, or batch"),
        ("build", {"threads": "many"}, None, "threads must be a number"),
        ("build", {"threads": -1}, None, "threads must be at least 0"),
        ("mosaic", {"outputTile": "90x160bad"}, None, "outputTile must use WxH format"),
        ("build", {"normalizeSize": "180xbad"}, None, "normalizeSize must use WxH format"),
        ("mosaic", {"tileW": 9.5}, None, "tileW must be an integer"),
        ("mosaic", {"tileW": 3}, None, "tileW must be at least 4"),
        ("mosaic", {"quality": 120}, None, "quality must be between 1 and 100"),
        ("mosaic", {"pngLevel": 0}, None, "pngLevel must be between 1 and 9"),
        ("mosaic", {"colorStrength": 0.75}, None, "colorStrength must be between 0.000000 and 0.500000"),
        ("usage", {"limit": 0}, None, "limit must be at least 1"),
        ("usage", {}, {"limit": "bad"}, "limit must be a number"),
        ("usage", {}, {"limit": "0"}, "limit must be at least 1"),
        ("usage", {}, {"unused": "maybe"}, "showUnused must be a boolean"),
        ("export", {}, {"confirm": "maybe"}, "confirm must be a boolean"),
        ("purge", {}, {"dryRun": "sometimes"}, "dryRun must be a boolean"),
        ("purge", {"dryRun": "no"}, None, "dryRun must be a boolean"),
        ("inspect", {"imagePath": 123}, {"input": ""}, "imagePath must be a string"),
    ],
)
def test_requests_that_do_not_hold(operation, body, query, message):
    with pytest.raises(RequestError) as e:
        parse(operation, json.dumps(body), query)
    assert str(e.value) == message


def test_requests():
    got = parse("mosaic", '{"input":"t.jpg","db":"lib","output":"o.webp","outputFormat":"webp","jpegQuality":75,"topNRandom":7,"penalty":0.2,"deepzoom":true,"cpu":true,"outputTile":"90x160"}')
    assert (got["inputPath"], got["dbPath"], got["outputPath"], got["format"], got["quality"], got["topNrandom"], got["usePenalty"]) == ("t.jpg", "lib", "o.webp", "webp", 75, 7, 0.2)
    assert got["tiled"] and got["deepZoom"] and not got["useGpu"] and (got["nativeTileW"], got["nativeTileH"], got["tileW"], got["candidates"]) == (90, 160, 9, 150)
    both = parse("usage", '{"dbPath":"body","limit":12,"showUnused":false}', {"db": "query", "limit": "2", "unused": "1"})
    assert both == {"dbPath": "body", "limit": 12, "showUnused": False}
    assert parse("purge", "", {"db": "q", "dryRun": "0", "confirm": "yes"}) == {"dbPath": "q", "dryRun": False, "confirm": True}
    assert parse("usage", "", {"limit": "2"})["limit"] == 2 and parse("stats") == {"dbPath": ""}
    for bad in ("[1]", "{"):
        with pytest.raises(RequestError):
            parse("stats", bad)
    assert checked_command("gridloom db-health -d lib") == ("db-health", "db-health -d lib")
    for bad, why in (("", "empty"), ("gridloom mosaic\nx", "invalid characters"), ("gridloom a;b", "invalid characters"), ("other build", "must start"), ("gridloom shell", "unknown command: shell")):
        with pytest.raises(RequestError, match=why):
            checked_command(bad)
    assert library_place("a/images.parquet") == "a" == library_place("a/") and library_place("") == "."


def test_jobs():
    still = Jobs(lambda kind, request: {}, start=False)
    one, two = still.submit("build", {"inputDir": "in"}), still.submit("mosaic", {})
    assert (one.id, two.id) == ("job-000001", "job-000002") and one.shown()["inputPath"] == "in"
    done, job = still.cancel(one.id)
    assert done and job.state == "canceled" and not still.cancel(one.id)[0] and still.cancel("none") == (False, None)
    assert still.clear_finished() == 1 and still.get(one.id) is None and [j.id for j in still.all()] == [two.id]
    gate, order = threading.Event(), []

    def run(kind, request):
        gate.wait(20)
        order.append(request["n"])
        if kind == "bad":
            raise ValueError("no\nmore")
        return {"n": request["n"]}

    jobs = Jobs(run)
    made = [jobs.submit(k, {"n": n}) for n, k in enumerate(("a", "bad", "a"))]
    gate.set()
    over = [jobs.wait(j.id, 20) for j in made]
    assert [j.state for j in over] == ["succeeded", "failed", "succeeded"] and order == [0, 1, 2] and over[1].message == "no" and over[2].result == {"n": 2}
    jobs.stop()


def test_service(spark, tmp_path):
    s = Service(spark, start=False)
    lib = str(tmp_path / "lib")
    for i in range(4):
        save(str(tmp_path / f"in/{i}.png"), picture(i))
    save(str(tmp_path / "t.png"), np.concatenate([picture(2)[:64, :36], picture(3)[:64, :36]], axis=1))
    seen = []

    def call(operation, *more, **named):
        status, body = s.call(operation, *more, **named)
        assert not contract_errors(operation, status, body), (operation, status, body)
        seen.append(operation)
        return status, body

    assert call("ping")[1]["message"] == "pong" and len(call("endpoints")[1]["endpoints"]) == len(ENDPOINTS) == 17
    assert call("stats", "", {"db": lib})[0] == 500 and call("mosaic", '{"tileW":1}')[0] == 400
    queued = call("build", json.dumps({"inputDir": str(tmp_path / "in"), "outputDir": lib, "normalizeSize": "36x64"}))[1]["job"]
    assert queued["state"] == "queued" and call("get_job", name=queued["id"])[1]["job"]["type"] == "build" and len(call("list_jobs")[1]["jobs"]) == 1
    assert call("cancel_job", name=queued["id"])[1]["job"]["state"] == "canceled" and call("cancel_job", name=queued["id"])[0] == 409 and call("get_job", name="none")[0] == 404
    assert call("clear_jobs")[1]["removed"] == 1
    assert s.run("build", parse("build", json.dumps({"inputDir": str(tmp_path / "in"), "outputDir": lib, "normalizeSize": "36x64"})))["added"] == 4
    stats = call("stats", "", {"db": lib})[1]["stats"]
    assert (stats["total"], stats["featureWidth"], stats["featureHeight"], stats["gridDim"], len(stats["lHistogram"])) == (4, "36", "64", 192, 8)
    ask = json.dumps({"inputPath": str(tmp_path / "t.png"), "dbPath": lib, "outputPath": str(tmp_path / "o.tiff"), "outputTile": "18x32", "tileW": 36, "tileH": 64, "topNrandom": 1, "analyze": True, "adaptiveWeights": True})
    for runs in (1, 1):
        assert s.run("mosaic", parse("mosaic", ask))["matched"] == 2
        used = call("usage", "", {"db": lib, "unused": "1"})[1]["usage"]
        assert used["total"] == 4 and all(t["runs"] == runs for t in used["top"]) and used["unusedCount"] == 4 - len(used["top"]) == len(used["unusedPreview"])
    assert sum(t["tiles"] for t in used["top"]) == 4
    assert (tmp_path / "o.tiff_analysis/heatmap.png").exists() and len((tmp_path / "o.tiff_analysis/worst.txt").read_text().splitlines()) == 2
    health = call("health", "", {"db": lib})[1]["health"]
    assert health["usage"]["unusedCount"] == used["unusedCount"] and len(health["recommendations"]) >= 0
    assert call("export", json.dumps({"dbPath": lib, "outputDir": str(tmp_path / "ex")}))[0] == 400
    assert call("export", json.dumps({"dbPath": lib, "outputDir": str(tmp_path / "ex"), "confirm": True}))[1]["export"]["exported"] == len(used["top"]) == len(list((tmp_path / "ex").iterdir()))
    assert call("inspect", json.dumps({"imagePath": str(tmp_path / "t.png"), "dbPath": lib}))[1]["inspect"]["databaseTotal"] == 4
    next((tmp_path / "lib/pictures").glob("[0-9]*.png")).unlink()
    assert call("purge", "", {"db": lib})[1]["purge"] | {"preview": 0} == {"dryRun": True, "orphans": 1, "preview": 0, "removed": 0}
    assert call("purge", json.dumps({"dbPath": lib, "dryRun": False}))[0] == 400
    assert call("purge", json.dumps({"dbPath": lib, "dryRun": False, "confirm": True}))[1]["purge"]["removed"] == 1
    assert call("stats", "", {"db": lib})[1]["stats"]["total"] == 3
    assert contract_errors("ping", 500, {"ok": True}) and contract_errors("stats", 200, {"ok": True}) and contract_errors("x", 200, {})


def test_packs_and_degrees(spark):
    images = spark.createDataFrame([(i,) for i in range(1, 6)], "id long")
    old = spark.createDataFrame([(1, [1]), (2, [2]), (2, [0]), (9, [9])], "id long, tiny array<int>")
    fresh = spark.createDataFrame([(i, [i * 10]) for i in range(2, 5)], "id long, tiny array<int>")
    got = {r.id: (r.tiny, r.reused) for r in upkeep.merged_pack(old, fresh, images).collect()}
    assert got == {1: ([1], True), 2: ([0], True), 3: ([30], False), 4: ([40], False), 5: (None, False)}
    with pytest.raises(ValueError, match="id 9|id 2|id"):
        upkeep.aligned_pack(old, images)
    assert upkeep.aligned_pack(images.withColumn("tiny", F.lit(1)), images).count() == 5
    links = spark.createDataFrame([(1, 2), (3, 2), (1, 4)], "q long, id long")
    assert tuple(upkeep.in_degrees(links, images).first()) == (5, 0, 2, 3)
    assert upkeep.time_left(0, 5, 1.0) is None and upkeep.time_left(2, 6, 10.0) == 20.0
    assert mosaic.target_hash(b"abc") != mosaic.target_hash(b"abd") and mosaic.target_hash(b"") == "0"
