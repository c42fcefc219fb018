from lattica.operators.tree import ancestors
from lattica.sources.text import read_obo

TEXT = """format-version: 1.2
ontology: small

[Term]
id: CL:1
name: cell

[Term]
id: CL:2
name: blood cell ! not a comment in a name
is_a: CL:1 ! cell
is_a: CL:9 {is_inferred="true"} ! nowhere

[Term]
id: CL:3
name: lymphocyte
is_a: CL:2 {is_inferred="true"} ! blood cell
relationship: part_of CL:1 ! cell
relationship: develops_from CL:4

[Term]
id: CL:4
name: old
is_obsolete: true
is_a: CL:1

[Typedef]
id: part_of
name: part of
is_a: CL:1
"""


def test_read_obo(spark, tmp_path):
    (tmp_path / "small.obo").write_text(TEXT)
    terms, edges = read_obo(spark, str(tmp_path / "small.obo"))
    assert sorted(map(tuple, terms.collect())) == [("CL:1", "cell"), ("CL:2", "blood cell"), ("CL:3", "lymphocyte")]
    assert sorted(map(tuple, edges.collect())) == [("CL:1", "CL:2", "is_a"), ("CL:1", "CL:3", "part_of"), ("CL:2", "CL:3", "is_a")]
    up = {(r.node, r.ancestor): r.steps for r in ancestors(edges.where("relation = 'is_a'")).collect()}
    assert up["CL:3", "CL:1"] == 2 and ("CL:1", "CL:3") not in up
