import json

from quillon.config import Settings
from quillon.plans import evaluation

GOLD = [
    {"id": "a", "text": "It was a vile and shameless trick.", "categories": ["loaded_language"], "note": "x"},
    {"text": "Perhaps it rained.", "categories": ["hedging", "bandwagon"]},
    {"id": "c", "text": "The crook left.", "categories": []},
    {"id": "d", "text": "Café owners were vile.", "categories": ["loaded_language"]},
    {"id": "e", "text": "Rain fell.", "categories": []},
]


def test_gold_set_from_end_to_end(spark, tmp_path):
    path = tmp_path / "gold.jsonl"
    path.write_text("// examples\n\n" + "\n".join(json.dumps(x) for x in GOLD))
    out = evaluation.gold(spark, str(path), least_f1=0.7)
    counts = {r.category: (r.tp, r.fp, r.fn) for r in out.counts.collect()}
    assert counts == {"loaded_language": (2, 0, 0), "hedging": (1, 0, 0), "bandwagon": (0, 0, 1), "name_calling": (0, 1, 0)}
    assert out.summary["micro_f1"] == 0.75 and out.summary["exact_rate"] == 0.6 and out.code == 0
    assert out.summary["verbatim_rate"] == 0.8  # of five quotes one is moved by NFC
    by_id = {r.id: (list(r.missed), list(r.spurious), r.exact) for r in out.examples.collect()}
    assert by_id["c"] == ([], ["name_calling"], False) and by_id["example_4"] == (["bandwagon"], [], False) and by_id["e"] == ([], [], True)
    assert {r.category for r in out.unmeasured.collect()} == set(Settings.load().taxonomy.ids) - set(counts)
    assert "| bandwagon | 0 | 0 | 1 | - | 0.000 | 0.000 |" in out.markdown and out.markdown.startswith("micro F1 0.75")
    assert evaluation.gold(spark, str(path), least_f1=0.76).code == 1
