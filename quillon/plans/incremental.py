"""Findings kept up to date: when the taxonomy or the documents change, only what the change can touch is analysed again."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.config import Taxonomy, digest
from quillon.operators import detectors, entities, hierarchy


def rule_hashes(taxonomy: Taxonomy) -> dict[str, str]:
    """A digest for every live category of all that its findings depend on: its own settings, and the entity stage where that enters."""
    out = {}
    for c in taxonomy.categories:
        if c.base_confidence >= taxonomy.default_threshold:
            named = c.needs_entities or c.detector == "repetition" and taxonomy.needs_entities  # repeated phrases leave entities out
            out[c.id] = digest({k: v for k, v in asdict(c).items() if k not in ("name", "family", "severity_weight", "disruption")} | {"entities": entities.VERSION if named else ""})
    return out


def diff(spark: SparkSession, old: dict[str, str], new: dict[str, str]) -> DataFrame:
    """(category, status): a full outer join of two tables of rule hashes; status: same, changed, added or removed."""
    table = lambda x, name: spark.createDataFrame(sorted(x.items()), f"category string, {name} string")
    both = table(old, "before").join(table(new, "after"), "category", "full")
    status = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed").otherwise("same")
    return both.select("category", status.alias("status"))


@dataclass
class Update:
    """findings: all of them, with rule_hash; rules: (category, status); touched: (document, reason) of what was analysed again."""

    findings: DataFrame
    rules: DataFrame
    touched: DataFrame


def start(docs: DataFrame, taxonomy: Taxonomy, key: str = "document_id", body: str = "text") -> DataFrame:
    """Findings of all documents, each with the hash of its rule."""
    return _stamped(detectors.findings(docs, taxonomy, key, body), rule_hashes(taxonomy))


def _stamped(found: DataFrame, hashes: dict[str, str]) -> DataFrame:
    named = F.create_map(*(F.lit(x) for kv in hashes.items() for x in kv)) if hashes else F.create_map().cast("map<string,string>")
    return found.withColumn("rule_hash", F.try_element_at(named, F.col("category")))


def update(kept: DataFrame, before: DataFrame, docs: DataFrame, old: Taxonomy, new: Taxonomy, key: str = "document_id", body: str = "text") -> Update:
    """From the findings ``kept`` of the documents ``before`` under ``old`` those of ``docs`` under ``new``.

    Documents that were there with the same text meet only the categories whose hash is new; new documents, and those with another
    text, meet all. Kept are findings whose rule hash is still one of the taxonomy's, of documents that didn't change: the result
    equals a full run. Keys are unique and not null in either table of documents; null texts count as texts without findings.
    """
    hashes, earlier = rule_hashes(new), rule_hashes(old)
    again = tuple(c for c in new.categories if hashes.get(c.id) not in (None, earlier.get(c.id)))
    text = lambda df, name: df.select(F.col(key), F.coalesce(F.sha2(F.col(body), 256), F.lit("-")).alias(name))
    state = hierarchy._fixed(text(docs, "_now").join(text(before, "_was"), key, "left").select(key, F.col("_now").eqNullSafe(F.col("_was")).alias("_same")))
    marked = docs.select(key, body).join(state, key)
    part = Taxonomy(again, new.default_threshold, new.version)
    only = detectors.findings(marked.where("_same"), part, key, body, found=None if new.needs_entities == part.needs_entities else _named(marked.where("_same"), again, key, body))
    fresh = detectors.findings(marked.where("NOT _same"), new, key, body)
    valid = F.col("rule_hash").isin(*hashes.values()) if hashes else F.lit(False)
    still = kept.where(valid).join(state.where("_same").select(key), key, "left_semi")
    found = still.unionByName(_stamped(only.unionByName(fresh), hashes))
    reason = F.when(~F.col("_same"), "document").when(F.lit(bool(again)), "rules")
    return Update(found, diff(docs.sparkSession, earlier, hashes), state.select(key, reason.alias("reason")).where("reason IS NOT NULL"))


def _named(docs: DataFrame, again: tuple, key: str, body: str) -> DataFrame | None:
    """Entities for a part of a taxonomy whose other part asks for them: repeated phrases have to leave them out here too."""
    return entities.entities(docs, key, body) if any(c.detector == "repetition" for c in again) else None
