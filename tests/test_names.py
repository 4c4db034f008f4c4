"""Names beside names."""

from vellumflow.operators.entities import GazetteerPredictor


def found(names, text):
    return [(e["word"], e["entity_group"], e["start"], e["end"]) for e in GazetteerPredictor(names)([text])[0]]


def test_names_after_names():
    names = {"LOC": ["The", "Les"], "ORG": ["Der"], "PER": ["Jehan"]}
    assert found(names, "The The Der Les") == [("The", "LOC", 0, 3), ("The", "LOC", 4, 7), ("Der", "ORG", 8, 11), ("Les", "LOC", 12, 15)]
    assert found(names, "The Big Les, Thea The") == [("The", "LOC", 0, 3), ("Les", "LOC", 8, 11), ("The", "LOC", 18, 21)]
    assert found(names, "Der Jehan de The Les le Jehan") == [("Der", "ORG", 0, 3), ("Jehan de The Les", "PER", 4, 20), ("Jehan", "PER", 24, 29)]


def test_many_names_in_linear_time():
    assert len(found({"LOC": ["The"]}, "The " * 100_000)) == 100_000
