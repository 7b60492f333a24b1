"""Pages of JSON from a server that fails now and then, and a table of the embedded database."""

import json
import threading
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from matchgrain.sources import database, pages, reports


@pytest.fixture
def server():
    asked: Counter = Counter()

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            asked[self.path] += 1
            league, page = self.path.strip("/").split("/")[1:]
            code = 404 if page == "3" else 400 if league == "odd" else 503 if asked[self.path] == 1 else 200
            self.send_response(code)
            self.end_headers()
            if code == 200:
                self.wfile.write(json.dumps({"items": [{"id": f"{league}-{page}", "description": "d"}]}).encode())

        def log_message(self, *_):
            pass

    http = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{http.server_port}/{{sport}}/{{league}}/{{page}}", asked
    http.shutdown()


def test_pages_are_partitions_with_retries_and_pushed_filters(spark, server):
    url, asked = server
    pages.register(spark)
    read = lambda leagues: spark.read.format("paged_json").options(url=url, leagues=leagues, pages=3, wait=0.01).load()
    df = read("soccer/eng.1, basketball/nba")
    assert df.rdd.getNumPartitions() == 6
    assert sorted((r.sport, r.league, r.page) for r in df.collect()) == [("basketball", "nba", 1), ("basketball", "nba", 2), ("soccer", "eng.1", 1), ("soccer", "eng.1", 2)]
    assert all(asked[f"/soccer/eng.1/{p}"] >= 2 for p in (1, 2))
    asked.clear()
    some = df.where("league = 'nba' and page in (1, 2)").where(F.length("payload") > 0)
    assert some.count() == 2 and set(asked) == {"/basketball/nba/1", "/basketball/nba/2"}
    teams = spark.createDataFrame([], "league string, team_id string")
    assert sorted(r.transaction_id for r in reports.transactions(some.select("league", "payload", "ingested"), teams).collect()) == ["nba-1", "nba-2"]
    with pytest.raises(Exception, match="400"):
        read("soccer/odd").collect()


def test_database_tables_are_read_in_parts_with_pushed_filters(spark):
    url = "jdbc:derby:memory:matchgrain;create=true"
    props = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    rows = spark.range(1000).select((F.col("id") * 3).alias("id"), (F.col("id") % 7).alias("kind"), F.concat(F.lit("name "), F.col("id").cast("string")).alias("name"))
    rows.write.format("jdbc").options(url=url, dbtable="teams", **props).mode("overwrite").save()
    df = database.read_table(spark, url, "teams", "id", 5, props)
    assert df.rdd.getNumPartitions() == 5 and df.count() == 1000 and df.agg(F.countDistinct("id")).first()[0] == 1000
    assert max(df.groupBy(F.spark_partition_id()).count().select("count").collect())[0] <= 201
    some = df.where("kind = 3").select("name")
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [*IsNotNull(kind), *EqualTo(kind,3)]" in plan.replace("`", "").replace("KIND", "kind") and "id#" not in plan.split("ReadSchema")[1].lower()
    assert some.count() == 143
    rows.limit(0).write.format("jdbc").options(url=url, dbtable="vacant", **props).mode("overwrite").save()
    assert database.read_table(spark, url, "vacant", "id", 5, props).count() == 0
