"""The engine's surface: search, extract, list, detail and health over tables."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspan.operators import dialogue, explain, model, rollups, search
from larkspan.sources.snapshots import Store
from larkspan.streaming.sessions import values


@dataclass
class Engine:
    """schools, commute and the optional tables of clubs, yearly figures and stations."""

    schools: DataFrame
    commute: DataFrame
    clubs: DataFrame | None = None
    stats: DataFrame | None = None
    stations: DataFrame | None = None

    def search(self, requests: DataFrame) -> DataFrame:
        """Shown rows of every request; see ``unknown_stations`` and ``relaxations`` for requests without any."""
        return explain.sentences(search.search(requests, self.schools, self.commute, self.clubs))

    def answer(self, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Of every request the status, count and offers, and the rows that it is answered with."""
        shown = search.search(requests, self.schools, self.commute, self.clubs)
        return search.responses(requests, shown, self.commute), search.answers(shown).withColumn("text", explain.school_text())

    def unknown_stations(self, requests: DataFrame) -> DataFrame:
        """Requests whose station is missing or has no travel times."""
        return requests.join(self.commute.select("station").distinct(), "station", "left_anti")

    def relaxations(self, requests: DataFrame, shown: DataFrame) -> DataFrame:
        """What requests without a result can be offered."""
        return search.relaxation_options(requests.join(shown.select("req_id").distinct(), "req_id", "left_anti"))

    def extract(self, utterances: DataFrame) -> DataFrame:
        """session, turn and the slots that the rules find in each text."""
        slots = dialogue.extract(F.col("text"))
        found = utterances.withColumn("slots", slots)
        if "asked_slot" in utterances.columns:
            five = F.col("had_five") if "had_five" in utterances.columns else F.lit(None).cast("int")
            found = found.withColumn("slots", dialogue.bare_answer(F.col("text"), F.col("asked_slot"), F.col("slots"), five))
        return found

    def states(self, utterances: DataFrame) -> DataFrame:
        """The merged state of every session."""
        return dialogue.merge_turns(self.extract(utterances), "session", "turn")

    def list(self, **filters) -> DataFrame:
        return search.listing(self.schools, **filters)

    def detail(self, school) -> DataFrame:
        if self.stats is None:
            raise ValueError("no yearly figures")
        return search.detail(self.schools, self.stats, school)

    def health(self, expected: dict[str, int], store: Store | None = None) -> DataFrame:
        """name, n, expected and ok: rows of each table, of schools joined to their ways, and, with a store, whether a value that is put is read back."""
        tables = {"schools": self.schools, "commute": self.commute, "clubs": self.clubs, "stats": self.stats, "stations": self.stations}
        joined = self.schools.select("school").join(self.commute.select("school").distinct(), "school", "left_semi")
        found = rollups.expected_counts({k: v for k, v in tables.items() if v is not None} | {"join": joined}, expected)
        joins = found.where("name = 'join'").withColumn("ok", F.col("n") > 0)
        found = found.where("name <> 'join'").unionByName(joins)
        if store is None:
            return found
        spark = self.schools.sparkSession
        return found.unionByName(spark.createDataFrame([("store", 1, 1, self._round_trip(store))], "name string, n long, expected long, ok boolean"))

    @staticmethod
    def _round_trip(store: Store) -> bool:
        """Whether a value that was never there before is put and read back."""
        value = uuid.uuid4().hex
        table = values(store)
        row = store.spark.createDataFrame([("health", value)], "key string, value string").select("key", F.current_timestamp().alias("at"), "value", F.lit(None).cast("timestamp").alias("expires_at"))
        before = store.current()
        table.add(row, 0 if before is None else before["batch"] + 1)
        return table.read().where(F.col("key") == "health").first().value == value

    def health_model(self, calls: DataFrame, probe: model.Model | None = None, *, most: int = 6) -> DataFrame:
        """Probes of the model (id, at): those beyond ``most`` in an hour are answered with rate_limited, uncalled; others with ok, or why there is no answer."""
        limited = dialogue.rate_limit(calls, [], "at", "id", most).select("id", "at", "ok", F.lit("ok?").alias("prompt"))
        told = model.answers(limited, "id", "prompt", probe, allowed="ok", limits=model.Limits(attempts=1)).select("id", F.col("source").alias("error"))
        error = F.when(F.col("error") == "budget_exhausted", "rate_limited").when(F.col("error") != "llm", F.col("error"))
        return limited.join(told, "id").select("id", "at", error.isNull().alias("ok"), error.alias("error"))
