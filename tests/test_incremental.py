from dataclasses import replace

from pyspark.sql import functions as F

from quillon import config
from quillon.config import Settings, Taxonomy
from quillon.operators import detectors
from quillon.plans import incremental

PHRASE = "the long red wall of Berlin stood. "
OLD = [(1, "A vile plan, an evil one."), (2, "Perhaps a crook."), (3, "Case closed. It is vile."), (4, PHRASE * 5 + "so they say so they say now so they say so they say now so they say now"), (5, None), (6, "Gone soon: vile.")]
NEW = [*OLD[:2], (3, "Case closed. It is evil."), *OLD[3:5], (7, "A hack, perhaps; vile.")]


def changed(t):
    edit = {"loaded_language": {"terms": ("evil", "plan")}, "hedging": {"base_confidence": 0.5}, "repetition": {"min_repeats": 3}, "name_calling": {"name": "only the name"}}
    kept = [replace(c, **edit.get(c.id, {})) for c in t.categories if c.id not in ("gaslighting", "scapegoating", "card_stacking")]
    return Taxonomy((*kept, replace(t.by_id("hedging"), id="doubt")), t.default_threshold)


def rows(df):
    return sorted(str(r) for r in df.drop("rule_hash").collect())


def test_equal_to_a_full_run(spark):
    old, new = (spark.createDataFrame(x, "id long, text string") for x in (OLD, NEW))
    before = Settings.load().taxonomy
    for after in (changed(before), before, Taxonomy(before.categories[:2], 0.8), Taxonomy((*changed(before).categories, before.by_id("scapegoating")), 0.8)):
        kept = incremental.start(old, before, "id")
        up = incremental.update(kept, old, new, before, after, "id")
        assert rows(up.findings) == rows(detectors.findings(new, after, "id"))
        assert up.findings.where("rule_hash IS NULL").count() == 0


def test_what_is_touched(spark):
    old, new = (spark.createDataFrame(x, "id long, text string") for x in (OLD, NEW))
    before = Settings.load().taxonomy
    up = incremental.update(incremental.start(old, before, "id"), old, new, before, changed(before), "id")
    status = {r.category: r.status for r in up.rules.collect()}
    assert {k for k, v in status.items() if v == "changed"} == {"loaded_language", "repetition"}
    assert status["hedging"] == status["gaslighting"] == "removed" and status["doubt"] == "added" and status["name_calling"] == "same"
    assert {r.id: r.reason for r in up.touched.collect()} == {1: "rules", 2: "rules", 3: "document", 4: "rules", 5: "rules", 7: "document"}
    none = incremental.update(incremental.start(old, before, "id"), old, old, before, before, "id")
    assert none.touched.count() == 0 and rows(none.findings) == rows(detectors.findings(old, before, "id"))


def test_empty_tables(spark):
    old = spark.createDataFrame(OLD, "id long, text string")
    t = Settings.load().taxonomy
    kept = incremental.start(old.limit(0), t, "id")
    assert rows(incremental.update(kept, old.limit(0), old, t, t, "id").findings) == rows(detectors.findings(old, t, "id"))
    assert incremental.update(incremental.start(old, t, "id"), old, old.where(F.lit(False)), t, t, "id").findings.count() == 0


def test_what_changed_is_worked_out_once(spark):
    t = config.Settings.load().taxonomy
    docs = spark.createDataFrame([(1, "That man is a crook."), (2, "Fine weather.")], "document_id long, text string")
    up = incremental.update(incremental.start(docs, t), docs, docs, t, t)
    assert "sha2(" not in up.findings._jdf.queryExecution().executedPlan().toString() and up.touched.count() == 0
