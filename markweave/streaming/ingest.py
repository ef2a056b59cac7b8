"""ST01: gazettes are ingested whole or not at all.

An attempt writes its rows under its own id and then puts one entry into the log; rows count
from then on. An attempt that fails leaves an entry that says so and no rows, also none of an
earlier attempt; one that is killed leaves nothing that is ever read, and the next one of the
gazette, or clean(), removes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markweave.storage import Generations, delete

STATUS = "gazette_id string, status string, sha256 string, row_count long, error string, gen string"


class Ingest:
    """The rows of gazettes in a folder."""

    def __init__(self, spark: SparkSession, root: str, schema: str):
        self.spark, self.schema = spark, schema
        self.gens = Generations(spark, root)

    def _last(self) -> dict[str, dict]:
        return {e["gazette_id"]: e for e in self.gens.entries()}

    def gazettes(self) -> DataFrame:
        """(gazette_id, status, sha256, row_count, error, gen): the last entry of each gazette."""
        fields = [c.split()[0] for c in STATUS.split(", ")]
        return self.spark.createDataFrame([tuple(e.get(f) for f in fields) for e in self._last().values()], STATUS)

    def rows(self) -> DataFrame:
        """The rows of completed gazettes, with gazette_id."""
        done = [e["gen"] for e in self._last().values() if e["status"] == "completed" and e["row_count"]]
        schema = f"{self.schema}, gen string, gazette_id string"
        if not done:
            return self.spark.createDataFrame([], schema).drop("gen")
        found = self.spark.read.schema(schema).parquet(f"{self.gens.root}/rows")
        return found.where(F.col("gen").isin(done)).drop("gen")

    def run(self, gazette_id: str, sha256: str, read: Callable[[], DataFrame]) -> str:
        """Ingest one gazette; its status, or `skip` for content that is there already. An
        error of read, or of a task that reads, is noted and raised."""
        old = self._last().get(gazette_id)
        if old and old["status"] == "completed" and old["sha256"] == sha256:
            return "skip"
        gen = self.gens.begin()
        facts = {"gazette_id": gazette_id, "sha256": sha256}
        self.gens.publish(gen, status="processing", row_count=0, **facts)
        try:
            self.gens.write(gen, "rows", read().withColumn("gazette_id", F.lit(gazette_id)), "gazette_id")
            n = self.spark.read.schema(f"{self.schema}, gazette_id string").parquet(f"{self.gens.root}/rows/gen={gen}").count()
        except Exception as e:
            delete(self.spark, f"{self.gens.root}/rows/gen={gen}")
            self.gens.publish(gen, status="failed", row_count=0, error=str(e)[:2000], **facts)
            raise
        else:
            self.gens.publish(gen, status="completed", row_count=n, **facts)
        finally:
            if old and self._last()[gazette_id]["status"] != "processing":
                delete(self.spark, f"{self.gens.root}/rows/gen={old['gen']}")
        return "completed"

    def purge(self, gazette_id: str) -> None:
        """The gazette's rows go, its entry stays."""
        old = self._last().get(gazette_id)
        if old:
            self.gens.publish(self.gens.begin(), status="purged", row_count=0, gazette_id=gazette_id, sha256=None)
            delete(self.spark, f"{self.gens.root}/rows/gen={old['gen']}")

    def clean(self) -> list[str]:
        """Delete rows that no completed entry names; their attempts. Not beside an ingest."""
        from markweave.storage import names

        done = {e["gen"] for e in self._last().values() if e["status"] == "completed"}
        gone = [n[4:] for n in names(self.spark, f"{self.gens.root}/rows") if n.startswith("gen=") and n[4:] not in done]
        for g in gone:
            delete(self.spark, f"{self.gens.root}/rows/gen={g}")
        return gone
