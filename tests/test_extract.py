import json

import pytest

from casewright import registry
from casewright.operators import extract, resolve

REG = registry.default_registry()

RULES = [
    ("call 07712 345 678 now", "PHONE", "07712 345 678"), ("plate rx71 kld seen", "VEHICLE", "RX71 KLD"), ("at 14 Mill Lane today", "LOCATION", "14 Mill Lane"), ("ref OP_NIGHTFALL", "CASE_REF", "OP_NIGHTFALL"),
    ("on 12/03/2025", "DATE", "12/03/2025"), ("mail bob@x.example.com", "EMAIL", "bob@x.example.com"), ("host 10.0.0.255 up", "IP_ADDRESS", "10.0.0.255"), ("account number: AB12345678", "BANK_ACCOUNT", "account number: AB12345678"), ("IMEI 123456789012345", "SERIAL", "IMEI 123456789012345"),
]


@pytest.mark.parametrize("text, kind, surface", RULES)
def test_rules(text, kind, surface):
    hit = [s for s in extract.rule_spans(text, REG) if s[1] == kind]
    assert [s[0] for s in hit] == [surface]
    assert text[hit[0][2] : hit[0][3]].upper() == surface.upper()


RELATIONS = [
    ("Marcus Webb was seen at the Old Dock.", "OBSERVED_AT", "Marcus Webb", "the Old Dock"), ("Anna Hart is associated with Ben Cole", "ASSOCIATED_WITH", "Anna Hart", "Ben Cole"),
    ("Anna Hart and Ben Cole were together", "ASSOCIATED_WITH", "Anna Hart", "Ben Cole"), ("Anna Hart is linked to the warehouse;", "LINKED_TO", "Anna Hart", "the warehouse"),
]


@pytest.mark.parametrize("text, kind, source, target", RELATIONS)
def test_relation_patterns(text, kind, source, target):
    assert (source, target, kind, 0.85) in [r[:4] for r in extract.pattern_relations(text, REG)]


def test_spans():
    s = lambda a, b, kind="X", c=1.0: ("t", kind, a, b, c)
    assert extract.drop_nested([s(2, 4), s(0, 5), s(2, 4, "Y")]) == [s(0, 5), s(2, 4, "Y")]
    assert extract.keep_surer([s(0, 5, c=0.4), s(3, 8, c=0.6), s(8, 9, c=0.1)]) == [s(3, 8, c=0.6), s(8, 9, c=0.1)]
    assert extract.by_precedence([s(0, 3)], [s(2, 5, "Y"), s(3, 4, "Z")]) == [s(0, 3), s(3, 4, "Z")]
    assert extract.relation_type("works for") == "WORKS_FOR" and extract.relation_type("1x") == "INFERRED_LINK" and extract.relation_type(None) == "INFERRED_LINK"


def test_mentions_and_relations(spark):
    rows = [("1", "bob@x.example.com met amy@y.example.com"), ("2", None), ("3", "Anna Hart is associated with Ben Cole, bob@x.example.com amy@y.example.com"), ("4", "only 10.1.2.3")]
    got = {r.chunk_id: r for r in extract.relations(extract.mentions(spark.createDataFrame(rows, "chunk_id string, text string"), models=(lambda t: [("Anna Hart", "PERSON", 0, 9, 0.7)] if t.startswith("Anna") else [],))).collect()}
    assert [m.entity_type for m in got["1"].mentions] == ["EMAIL", "EMAIL"] and got["2"].mentions == []
    assert (got["1"].relations[0].relation_type, got["1"].relations[0].confidence) == ("MENTIONED_WITH", 0.35)
    assert got["3"].mentions[0].text == "Anna Hart" and got["3"].relations[0].method == "pattern" and got["4"].relations == []


def test_the_last_mention_of_a_surface_wins(spark):
    rels = spark.createDataFrame([("c", "A", "B"), ("c", "A", "A"), ("c", "A", "missing")], "chunk_id string, source string, target string")
    said = spark.createDataFrame([("c", "A", "e1", 0), ("c", "A", "e2", 5), ("c", "B", "e3", 2)], "chunk_id string, surface string, entity_id string, position int")
    assert [(r.source_entity, r.target_entity) for r in extract.attach_entities(rels, said).collect()] == [("e2", "e3")]


def test_resolution(spark):
    names = ["Marcus Webb", "Marcus Web", "Markus Webb", "Anna Hart", "Anne Hart", "Zed", "Marcus Webb"]
    got = {r.name: r for r in resolve.resolve(spark.createDataFrame([("PERSON", n, k) for k, n in enumerate(names)] + [("PLACE", "Marcus Web", 0)], "entity_type string, name string, seen int")).where("entity_type = 'PERSON'").collect()}
    assert {n: r.canonical_name for n, r in got.items()} == {"Marcus Webb": "Marcus Webb", "Marcus Web": "Marcus Webb", "Markus Webb": "Marcus Webb", "Anna Hart": "Anna Hart", "Anne Hart": "Anna Hart", "Zed": "Zed"}
    assert got["Zed"].method == "new_entity" and got["Marcus Web"].score >= 0.88


def test_pairs_are_not_lost(spark):
    import random

    from casewright.functions.normalise import jaro_winkler

    rnd = random.Random(2)
    names = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randint(1, 9))) for _ in range(150)})
    got = {(r.a, r.b) for r in resolve.similar_pairs(spark.createDataFrame([("T", n) for n in names], "entity_type string, name string")).collect()}
    assert got == {(a, b) for a in names for b in names if a < b and jaro_winkler(a, b) >= 0.88}


def test_registry(tmp_path):
    assert REG.canonical_type("licence plate") == "VEHICLE" and REG.canonical_type("x-y") == "X_Y"
    assert [t["name"] for t in REG.listing()] == sorted(REG.types) and len(REG.types) == 13
    path = tmp_path / "r.json"
    path.write_text(json.dumps({"entity_types": {"CODE": {"regex": {"pattern": "C\\d+"}}, "BROKEN": {"regex": {"pattern": "("}}, "ODD": 5}, "relation_patterns": [{"pattern": "x", "relation_type": "Y"}, {"pattern": "(?P<source>a)(?P<target>b)", "relation_type": "AB"}]}))
    own = registry.load_registry(str(path))
    assert set(own.types) == {"CODE"} and own.relations == (("AB", "(?P<source>a)(?P<target>b)"),)
    assert registry.load_registry(str(tmp_path / "none.json")).types == {} and extract.rule_spans("C12", own)[0][0] == "C12"
