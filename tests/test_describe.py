import pytest

from seqgrove.functions import text, tree
from seqgrove.functions.describe import Term, article, describe, describe_column, noun_phrase

ROOT = "GO:0003674"


def graph(with_roles=True):
    rows = [
        ("GO:0016740", "transferase activity", (), "catalytic", 100, 1.0, 2), ("GO:0004672", "protein kinase activity", ("GO:0016740",), "catalytic", 100, 3.0, 5),
        ("GO:0005524", "ATP binding", (), "binding_cofactor", 40, 3.0, 5), ("GO:0000287", "magnesium ion binding", (), "binding_cofactor", 40, 2.0, 4),
        ("GO:0005515", "protein binding", (), "binding_generic", 20, 1.0, 2), ("GO:0044183", "protein folding chaperone", (), "chaperone", 75, 2.0, 2),
        ("GO:0003700", "DNA-binding transcription factor activity", (), "transcription_factor", 85, 2.0, 2), ("GO:0043565", "sequence-specific DNA binding", (), "binding_nucleic_acid", 45, 3.0, 4),
        ("GO:0003723", "RNA binding", (), "binding_nucleic_acid", 45, 2.0, 3), ("GO:0060089", "molecular transducer activity", (), "unknown", 0, 1.0, 1),
        ("GO:0004497", "monooxygenase activity", (), "catalytic", 100, 4.0, 4), ("GO:0016705", "oxidoreductase activity, acting on paired donors", (), "catalytic", 100, 3.0, 3),
    ]
    g = {t: Term(t, n, frozenset(a) | {ROOT}, ic, d, r if with_roles else None, p if with_roles else None) for t, n, a, r, p, ic, d in rows}
    return g | {ROOT: Term(ROOT, "molecular_function", ic=0.0, depth=0)}


@pytest.mark.parametrize("ids, said", [
    ("GO:0004672;GO:0005524;GO:0000287;GO:0016740", "as an ATP- and magnesium-binding protein kinase."),
    ("GO:0005515", "as protein binding."), ("GO:0005524", "as ATP binding."), ("GO:0004672;GO:0016740", "as a protein kinase."),
    ("GO:0044183;GO:0005524", "as an ATP-binding protein folding chaperone."), ("GO:0003700;GO:0043565", "as a sequence-specific DNA-binding transcription factor."),
    ("GO:0004672;GO:0060089", "as a protein kinase with molecular transducer activity."), ("GO:0004497;GO:0016705", "as a monooxygenase with oxidoreductase activity."),
])
@pytest.mark.parametrize("with_roles", [True, False])
def test_sentences(ids, said, with_roles):
    assert describe(ids, ids.split(";"), graph(with_roles)).summary == f"{ids} is annotated {said}"


def test_details():
    d = describe("q", ["GO:0004672", "GO:0016740", "GO:9999999", ROOT], graph())
    assert d.head == "GO:0004672" and set(d.dropped) == {"GO:0016740", ROOT} and d.supporting == () and d.terms[2]["missing"]
    assert describe("q", ["GO:0004672", "GO:0005524"], graph(), 0).modifiers == ()
    assert describe("q", ["GO:9"], graph()).summary == "q has no resolvable Molecular Function GO terms."
    assert describe("q", ["GO:0003700", "GO:0043565", "GO:0003723"], graph()).modifiers == ("sequence-specific DNA-binding", "RNA-binding")
    assert noun_phrase("kinase", ("a-binding", "b-binding", "c-binding")) == "a-, b-, and c-binding kinase"
    assert [article(x) for x in ("RNA polymerase", "DNA helicase", "ATP-binding x", "kinase", "oxidase")] == ["an", "a", "an", "a", "an"]


def test_column(spark):
    df = spark.createDataFrame([("c1", ["GO:0005524"]), ("c2", None)], "q string, t array<string>")
    assert [r[0] for r in df.select(describe_column(graph())("q", "t")).collect()] == ["c1 is annotated as ATP binding.", "c2 has no resolvable Molecular Function GO terms."]


def test_queries_and_formats():
    assert text.parse_term_set("(GO:0000002;GO:0000003,GO:0000002)") == ("GO:0000002", "GO:0000003")
    for bad in ("(GO:0000002", "GO:2", "()"):
        with pytest.raises(ValueError):
            text.parse_term_set(bad)
    assert [text.kind(x) for x in ("GO:0000001", "cluster_0007", "P1")] == ["set", "cluster", "accession"]
    assert [text.number(x) for x in (0.4, 2.0, None, 1 / 3)] == ["0.4", "2", "NA", "0.3333"] and text.similarity(0.5) == "0.50000"
    assert [text.odds(6, 2, 4, 18), text.odds(5, 5, 5, 15), text.odds(1, 0, 1, 1), text.odds(0, 0, 1, 1)] == ["13.5", "3", "inf", "NA"]


def test_tree():
    parents = {"d": ["b", "a"], "b": ["r"], "a": ["r"], "r": []}
    assert tree.path_from_root(parents, "d", "r") == ["r", "a", "d"]
    paths = [["r", "m", "x"], ["r", "m", "y"]]
    assert tree.render(paths, str) == ["└── r", "    └── m", "        ├── x", "        └── y"]
    assert tree.render(paths, str, "ascii") == ["`- r", "   `- m", "      |- x", "      `- y"]
