"""The keyword index of a store: postings in segments by batch, dealt by term."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import all_of
from ..plans.tables import settled
from .snapshots import SnapshotStore


def segments(store: SnapshotStore, table: str, state: dict | None = None) -> list[str]:
    """The folders of the bucket of a table that has the most."""
    state = state or store.current()
    held = state["tables"].get(table, {}) if state else {}
    return max(([p] if isinstance(p, str) else p for p in held.values()), key=len, default=[])


def _without_dead(postings: DataFrame, dead: DataFrame) -> DataFrame:
    """Postings but those of a chunk that are older than the last segment that took it out."""
    last = dead.groupBy("id").agg(F.max("segment").alias("since"))
    return postings.join(last, "id", "left").where("since is null or segment >= since").drop("since")


class StoredKeywords:
    """What keyword_search and substring_search need of a store: the postings of some terms or trigrams,
    of which only the buckets are read, the chunks that hold them, and the sums over all live chunks,
    which the state keeps."""

    def __init__(self, store: SnapshotStore) -> None:
        self.store, self.state = store, store.current()

    @property
    def totals(self) -> DataFrame:
        """n, avg_len: one row."""
        held = self.state["totals"] if self.state else {}
        n, words = held.get("n", 0), held.get("words", 0)
        return self.store.spark.createDataFrame([(n, words / n if n else None)], "n bigint, avg_len double")

    def of(self, terms: Sequence[str]) -> DataFrame:
        found = self.store.read("postings", sorted({self.store.bucket_of(t) for t in terms}), self.state)
        return _without_dead(found.where(F.col("tok").isin(*terms)), self.store.read("dead_terms", state=self.state))


    def holding(self, tris: Sequence[str]) -> DataFrame:
        found = self.store.read("trigrams", sorted({self.store.bucket_of(t) for t in tris}), self.state)
        return all_of(_without_dead(found.where(F.col("tri").isin(*tris)), self.store.read("dead_terms", state=self.state)), tris)

    def chunks_of(self, ids: DataFrame, chunks: DataFrame) -> DataFrame:
        ids = settled(ids)
        found = self.store.read("chunks", self.store.buckets_of(ids.withColumnRenamed("id", "file_path")), self.state)
        return found.where("not is_deleted").join(ids, "id", "left_semi")


def merge_segments(store: SnapshotStore) -> None:
    """One segment a bucket: postings without the dead, and who refers to what as it stands now."""
    state = store.current()
    live = {t: _without_dead(store.read(t, state=state), store.read("dead_terms", state=state)) for t in ("postings", "trigrams")}
    refers = store.read("references", state=state)
    wanted = refers.select(F.explode("targets").alias("target_path"), "file_path", F.col("passed_on").isNotNull().alias("passes_on")).distinct()
    every = list(range(store.buckets))
    store.commit(live | {"dead_terms": store.read("dead_terms").where("false"), "wanted": wanted}, base=state, read={"references": every})
