"""Descriptions of entities and of their classes from a SPARQL endpoint, as a data source of its own.

    spark.dataSource.register(EntityDescriptions)
    spark.read.format("entity_descriptions").option("endpoint", url).option("ids", "Q1,Q2").load()

A partition is a batch of ids and one request, with retries that wait longer each time. Rows are (id, label, description), the
first description of each label; an id of which nothing is known has one row without label, so that a cache
knows that it was asked for.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from evalgrove.sources import caches

SCHEMA = "id string, label string, description string"
#: What is asked of an endpoint; {ids} are the entities.
CLASSES = (
    "SELECT ?root ?classLabel ?classDescription WHERE { VALUES ?root { {ids} } { BIND(?root AS ?class) } UNION { ?root wdt:P31/wdt:P279* ?class . } "
    'SERVICE wikibase:label { bd:serviceParam wikibase:language "{language}" . ?class rdfs:label ?classLabel . ?class schema:description ?classDescription . } }'
)
OWN = 'SELECT ?root ?classDescription WHERE { VALUES ?root { {ids} } ?root schema:description ?classDescription . FILTER(LANG(?classDescription) = "{language}") }'


class _Batch(InputPartition):
    def __init__(self, ids: list[str]):
        self.ids = ids


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.endpoint = options["endpoint"]
        self.ids = sorted({i for i in options.get("ids", "").split(",") if i})
        self.size, self.retries = int(options.get("batch", 40)), int(options.get("retries", 5))
        self.wait, self.timeout = float(options.get("wait", 2)), float(options.get("timeout", 120))
        own = options.get("kind", "classes") == "own"
        self.query = (OWN if own else CLASSES).replace("{language}", options.get("language", "en"))

    def partitions(self) -> list[_Batch]:
        return [_Batch(self.ids[at : at + self.size]) for at in range(0, len(self.ids), self.size)]

    def read(self, partition: _Batch) -> Iterator[tuple]:
        asked = self.query.replace("{ids}", " ".join(f"wd:{i}" for i in partition.ids))
        known: dict[str, dict[str, str]] = {i: {} for i in partition.ids}
        for row in self._fetch(asked)["results"]["bindings"]:
            value = lambda name: row.get(name, {}).get("value", "")  # noqa: B023, E731
            root, label, told = value("root").rpartition("/")[2], value("classLabel"), value("classDescription")
            if root in known and told and (label or "classLabel" not in self.query):
                known[root].setdefault(label, told)
        for i, found in known.items():
            if not found:
                yield i, None, None
            for label, told in found.items():
                yield i, label or None, told

    def _fetch(self, query: str) -> dict:
        url = f"{self.endpoint}?{urllib.parse.urlencode({'query': query, 'format': 'json'})}"
        request = urllib.request.Request(url, headers={"Accept": "application/sparql-results+json", "User-Agent": "evalgrove"})
        for attempt in range(1, self.retries + 2):
            try:
                with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                    return json.load(answer)
            except (OSError, ValueError) as error:
                if attempt > self.retries:
                    raise
                told = error.headers.get("Retry-After") if isinstance(error, urllib.error.HTTPError) else None
                time.sleep(float(told) if told and told.isdigit() else self.wait * attempt)
        raise AssertionError


class EntityDescriptions(DataSource):
    """Options: endpoint, ids (joined by commas), batch, retries, wait, timeout, language, kind (classes, or own for the ids' alone)."""

    @classmethod
    def name(cls) -> str:
        return "entity_descriptions"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def fetching(spark: SparkSession, endpoint: str, **options: str):
    """A fetch for caches.filled(): a table of ids becomes their descriptions. A batch of ids passes through the driver."""
    spark.dataSource.register(EntityDescriptions)

    def fetch(keys: DataFrame) -> DataFrame:
        ids = ",".join(r[0] for r in keys.select("id").collect())
        return spark.read.format("entity_descriptions").options(endpoint=endpoint, ids=ids, **options).load()

    return fetch


def described_chains(labels: DataFrame, endpoint: str, cache: str, batch: int = 10_000, **options: str) -> DataFrame:
    """(id, taxonomy): leaf-first chains with descriptions in place of labels, '' where none is known.

    labels: (id, taxonomy). Descriptions are kept in the cache folder and asked for once. A leaf that its id's classes leave
    without a description takes the id's own.
    """
    spark = labels.sparkSession
    # what an id itself is described as counts for the chain's leaf only
    known = caches.filled(labels, fetching(spark, endpoint, **options), f"{cache}/classes", SCHEMA, batch=batch)
    told = known.where("label IS NOT NULL").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("label", "description"))).alias("_known"))
    rows = labels.select("id", "taxonomy").join(told, "id", "left").withColumn("_known", F.coalesce("_known", F.create_map().cast("map<string,string>")))
    leaf = F.get("taxonomy", F.lit(0))
    bare = rows.where(leaf.isNotNull() & F.try_element_at("_known", leaf).isNull()).select("id")
    own = caches.filled(bare, fetching(spark, endpoint, kind="own", **options), f"{cache}/own", SCHEMA, batch=batch)
    own = own.where("description IS NOT NULL").groupBy("id").agg(F.min("description").alias("_own"))
    told = F.transform("taxonomy", lambda x, i: F.coalesce(F.try_element_at("_known", x), F.when(i == 0, F.col("_own")), F.lit("")))
    return rows.join(own, "id", "left").select("id", told.alias("taxonomy"))
