from pyspark.sql import functions as F

from quillon.config import Settings
from quillon.operators import detectors, gazetteer

NAMES = [("Anna Berg", "PERSON"), ("Berg", "GPE"), ("New  York", "GPE"), ("New York Times", "ORG"), ("Tom Hill", "PERSON"), ("York", "GPE"), ("Jo Hill", "PERSON"), ("Élan Vital", "ORG"), (None, "ORG"), ("Nil", None), ("Tom Hill", "ZZZ"), ("one two three four five six seven", "ORG")]
TEXT = "Anna Berg read the New York Times in New\nYork. Hill was unknown. Then Tom Hill came; Hill and Jo Hill, said Hill. ÉLAN VITAL, new york? New, York. The Hills."


def test_longest_names_and_short_ones(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, "Hill came."), (3, None), (4, ""), (5, "Tom Hill. " * 3 + "Nil One Two Three Four Five Six Seven")], "id long, text string").withColumns({"name": F.lit("clash"), "label": F.lit(1), "start": F.lit(2), "_label": F.lit(3)})
    rows = gazetteer.entities(docs, spark.createDataFrame(NAMES, "name string, label string"), "id").orderBy("id", "start_char", "end_char", "label").collect()
    texts = {r.id: r.text for r in docs.collect()}
    assert all(texts[r.id][r.start_char : r.end_char] == r.text for r in rows)
    assert [(r.text, r.label, r.name) for r in rows if r.id == 1] == [
        ("Anna Berg", "PERSON", "anna berg"), ("New York Times", "ORG", "new york times"), ("New\nYork", "GPE", "new york"), ("Tom Hill", "PERSON", "tom hill"), ("Hill", "PERSON", "tom hill"),
        ("Jo Hill", "PERSON", "jo hill"), ("Hill", "PERSON", "jo hill"), ("ÉLAN VITAL", "ORG", "élan vital"), ("York", "GPE", "york"),
    ]
    assert [(r.text, r.sentence_id) for r in rows if r.id == 5] == [("Tom Hill", 0), ("Tom Hill", 1), ("Tom Hill", 2)] and not [r for r in rows if r.id in (2, 3, 4)]
    assert len({r.model for r in rows}) == 1 and rows[0].model.startswith("gazetteer:")


def test_a_hundred_thousand_names(spark):
    names = spark.range(100_000).select(F.concat(F.lit("Name"), F.col("id"), F.lit(" Of"), F.col("id") % 97).alias("name"), F.lit("ORG").alias("label"))
    docs = spark.range(200).select("id", F.concat(F.lit("So Name"), F.col("id") * 499, F.lit(" Of"), (F.col("id") * 499) % 97, F.lit(" and Name5 Of6 spoke.")).alias("text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = gazetteer.entities(docs, names, "id").collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sorted(r.id for r in rows) == list(range(200))
    other = gazetteer.entities(docs, names.limit(10), "id").select("model").first()
    assert other is None or other.model != rows[0].model


def test_takes_the_place_of_the_rules(spark):
    docs = spark.createDataFrame([(1, "Bergers are to blame. The Bergers are at fault.")], "id long, text string")
    found = gazetteer.entities(docs, spark.createDataFrame([("Bergers", "NORP")], "name string, label string"), "id")
    got = detectors.findings(docs, Settings.load().taxonomy, "id", found=found).where("category = 'scapegoating'").collect()
    assert [r.text for r in sorted(got, key=lambda r: r.start_char)] == ["Bergers", "Bergers"]
    assert gazetteer.entities(docs.limit(0), spark.createDataFrame(NAMES, "name string, label string"), "id").count() == 0
